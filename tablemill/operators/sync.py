"""Delete-insert sync as DataFrame work.

The target keeps the rows whose key is in no source row; every source row is
added. It isn't MERGE: two source rows of one key give two target rows.

Scale notes. Source keys are made distinct before the join, so the join never
multiplies rows and its right side has no hot key. A hot key on the target side
sits on the streamed side of a left join, which AQE splits. Rows with a NULL
key can't match, so they skip the join and its shuffle altogether.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tablemill.errors import RequestError
from tablemill.functions.names import resolve
from tablemill.operators.mapping import conform, rename_mapped
from tablemill.session import setting

MATCHED = "__matched"

# Key column -> (smallest, largest) value.
Bounds = Mapping[str, tuple]


def resolve_keys(
    source: DataFrame, keys: Sequence[str], mappings: Mapping[str, str] | None = None
) -> list[str]:
    """Target names of the keys, which are given by their source names."""
    if not keys:
        raise RequestError("No key columns given")
    renamed = {s.lower(): t for s, t in (mappings or {}).items()}
    names = []
    for key in keys:
        column = resolve(key, source.columns)
        if column is None:
            raise RequestError(f"The source has no key column '{key}'")
        names.append(renamed.get(column.lower(), column))
    return names


def prepare_source(
    target: DataFrame, source: DataFrame, mappings: Mapping[str, str] | None = None
) -> DataFrame:
    """Source rows under the target's column names, order and types."""
    return conform(rename_mapped(source, mappings), target.schema)


def any_null(keys: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(f"`{k}`").isNull() for k in keys])


def _join_key(df: DataFrame, key: str, collation: str | None) -> Column:
    return F.collate(df[key], collation) if collation else df[key]


def _match(left: DataFrame, right: DataFrame, keys: Sequence[str], collation: str | None):
    """Equality on every key. NULL equals nothing; text compares by ``collation``."""
    string_keys = {f.name for f in left.schema if f.dataType.typeName() == "string"}
    tests = []
    for key in keys:
        name = collation if key in string_keys else None
        tests.append(_join_key(left, key, name) == _join_key(right, key, name))
    return reduce(lambda a, b: a & b, tests)


def _distinct_keys(source: DataFrame, keys: Sequence[str], collation: str | None) -> DataFrame:
    """Each non-NULL source key once, shuffled by the join rather than by the grouping.

    Were the grouping's shuffle reused for the join, AQE could not cut a hot
    target key: it only splits joins that read both shuffles directly. The test
    on the count is always true and keeps the planner from that reuse.
    """
    found = source.where(~any_null(keys)).select(*keys)
    if not collation:
        groups = found.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
        return groups.select(*[F.when(F.col("__n") > 0, F.col(k)).alias(k) for k in keys])
    # One row per key as the collation sees it, so that no target row matches twice.
    shown = {f.name for f in source.schema if f.dataType.typeName() == "string"}
    groups = [
        (F.collate(F.col(k), collation) if k in shown else F.col(k)).alias(f"__g{i}")
        for i, k in enumerate(keys)
    ]
    first = [F.min(k).alias(k) for k in keys]
    return found.groupBy(*groups).agg(*first).select(*keys)


def key_bounds(source: DataFrame, keys: Sequence[str]) -> Bounds:
    """Smallest and largest source value of each key that has a plain order."""
    plain = (T.IntegralType, T.DecimalType, T.DateType)
    ordered = [
        f.name
        for f in source.schema
        if f.name in keys and (isinstance(f.dataType, plain) or f.dataType == T.StringType())
    ]
    if not ordered:
        return {}
    found = source.where(~any_null(keys)).select(*ordered)
    row = found.agg(
        *[F.min(k).alias(f"lo{i}") for i, k in enumerate(ordered)],
        *[F.max(k).alias(f"hi{i}") for i, k in enumerate(ordered)],
    ).first()
    pairs = {k: (row[f"lo{i}"], row[f"hi{i}"]) for i, k in enumerate(ordered)}
    return {k: pair for k, pair in pairs.items() if pair[0] is not None}


def _split(
    target: DataFrame, keys: Sequence[str], bounds: Bounds | None, collation: str | None
) -> tuple[DataFrame, DataFrame]:
    """(rows that may match, rows that can't): the latter have a NULL key or one out of bounds.

    Both tests are plain comparisons, which the scan checks against file statistics.
    """
    may, cannot = ~any_null(keys), any_null(keys)
    for key, (lo, hi) in (bounds or {}).items():
        value, data_type = F.col(f"`{key}`"), target.schema[key].dataType
        if collation and data_type.typeName() == "string":
            continue
        low, high = F.lit(lo).cast(data_type), F.lit(hi).cast(data_type)
        may = may & (value >= low) & (value <= high)
        cannot = cannot | (value < low) | (value > high)
    return target.where(may), target.where(cannot)


def kept_rows(
    target: DataFrame,
    source: DataFrame,
    keys: Sequence[str],
    key_collation: str | None = None,
    bounds: Bounds | None = None,
) -> DataFrame:
    """Target rows that the source doesn't replace. Both sides use target names."""
    target_keys = [resolve(k, target.columns) for k in keys]
    wanted = _distinct_keys(source, target_keys, key_collation)
    may, cannot = _split(target, target_keys, bounds, key_collation)
    kept = may.join(wanted, _match(may, wanted, target_keys, key_collation), "left_anti")
    return kept.unionByName(cannot)


def flagged_rows(
    target: DataFrame,
    source: DataFrame,
    keys: Sequence[str],
    key_collation: str | None = None,
    bounds: Bounds | None = None,
    within: str | None = None,
) -> DataFrame:
    """Every target row once, with ``MATCHED`` TRUE where the source replaces it, else NULL.

    With ``bounds`` (from ``key_bounds`` of the source), rows outside them skip the
    join and its shuffle. On a target written in key order that leaves most files alone.

    ``within`` is a column of both sides, such as a hash bucket, that equal keys share. Both are
    then dealt by it alone, so that the rows come out gathered by it and need no second shuffle
    to be written. A task keeps the source's keys of its values of ``within`` in memory. Run it in
    ``joining_within``.
    """
    target_keys = [resolve(k, target.columns) for k in keys]
    if within is not None:
        both = [within, *target_keys]
        held = source.where(~any_null(target_keys)).select(*both).repartition(within).distinct()
        held = held.withColumn(MATCHED, F.lit(True)).hint("shuffle_hash")
        dealt = target.repartition(within)
        return dealt.join(held, _match(dealt, held, both, None), "left").select(*[dealt[c] for c in target.columns], held[MATCHED])
    wanted = _distinct_keys(source, target_keys, key_collation).withColumn(MATCHED, F.lit(True))
    may, cannot = _split(target, target_keys, bounds, key_collation)
    on = _match(may, wanted, target_keys, key_collation)
    columns = [may[c] for c in target.columns]
    flagged = may.join(wanted, on, "left").select(*columns, wanted[MATCHED])
    return flagged.unionByName(cannot.withColumn(MATCHED, F.lit(None).cast("boolean")))


@contextmanager
def joining_within(spark: SparkSession) -> Iterator[None]:
    """For jobs that start in here, sides that are dealt by one of a join's columns are not dealt again."""
    with setting(spark, "spark.sql.requireAllClusterKeysForCoPartition", "false"):
        yield


def touched_partitions(
    target: DataFrame,
    source: DataFrame,
    keys: Sequence[str],
    partition_by: Sequence[Column],
    key_collation: str | None = None,
) -> DataFrame:
    """Partitions a sync touches: their values, target rows it deletes and source rows it adds.

    ``partition_by`` are named columns that both sides have. Keys are compared as the sync
    compares them, and the partition columns need not be key columns. Of the target only key
    and partition columns are read; both counts are combined before their shuffle.
    """
    target_keys = [resolve(k, target.columns) for k in keys]
    wanted = _distinct_keys(source, target_keys, key_collation)
    may = target.where(~any_null(target_keys))
    hit = may.join(wanted, _match(may, wanted, target_keys, key_collation), "left_semi")
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    deleted = hit.select(*partition_by, one.alias("n_deleted"), none.alias("n_added"))
    added = source.select(*partition_by, none.alias("n_deleted"), one.alias("n_added"))
    both = deleted.unionAll(added)
    names = both.columns[: len(partition_by)]
    return both.groupBy(*[F.col(f"`{n}`") for n in names]).agg(
        F.sum("n_deleted").alias("n_deleted"), F.sum("n_added").alias("n_added")
    )


def delete_insert(
    target: DataFrame,
    source: DataFrame,
    keys: Sequence[str],
    mappings: Mapping[str, str] | None = None,
    key_collation: str | None = None,
) -> DataFrame:
    """The target after the sync, as one lazy plan.

    An empty source leaves the target as it is: there is nothing to match or add.
    The plan reads the source twice, for its keys and for its rows; pass one that
    is ``staged`` when it is costly or not repeatable.
    """
    target_keys = resolve_keys(source, keys, mappings)
    rows = prepare_source(target, source, mappings)
    return kept_rows(target, rows, target_keys, key_collation).unionByName(rows)


def full_refresh(
    target: DataFrame, source: DataFrame, mappings: Mapping[str, str] | None = None
) -> DataFrame:
    """The source in place of the target, unless the source has no row at all."""
    rows = prepare_source(target, source, mappings)
    return target if rows.isEmpty() else rows


def sync_counts(
    target: DataFrame,
    source: DataFrame,
    keys: Sequence[str],
    mappings: Mapping[str, str] | None = None,
    key_collation: str | None = None,
) -> DataFrame:
    """One row: rows read, deleted (distinct target rows), inserted and left in the target."""
    target_keys = resolve_keys(source, keys, mappings)
    rows = prepare_source(target, source, mappings)
    before = flagged_rows(target, rows, target_keys, key_collation).select(
        F.lit(0).alias("is_source"), F.col(MATCHED).isNotNull().cast("int").alias("is_deleted")
    )
    added = rows.select(F.lit(1).alias("is_source"), F.lit(0).alias("is_deleted"))
    return before.unionAll(added).agg(
        F.coalesce(F.sum(F.col("is_source").cast("long")), F.lit(0)).alias("rows_read"),
        F.coalesce(F.sum(F.col("is_deleted").cast("long")), F.lit(0)).alias("rows_deleted"),
        F.coalesce(F.sum(F.col("is_source").cast("long")), F.lit(0)).alias("rows_inserted"),
        F.count_if((F.col("is_source") == 1) | (F.col("is_deleted") == 0)).alias("rows_after"),
    )


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their row count.

    Grouping treats NULLs as equal, as a unique index does. Counts are combined
    before the shuffle, so a hot key sends one row per task.
    """
    columns = [resolve(k, df.columns) for k in keys]
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")


def target_names(
    columns: Sequence[str], target: Sequence[str], mappings: Mapping[str, str] | None = None
) -> list[str]:
    """Target columns that source columns fill."""
    renamed = {s.lower(): t for s, t in (mappings or {}).items()}
    found = [resolve(renamed.get(c.lower(), c), target) for c in columns]
    return [c for c in found if c is not None]


def all_given(columns: Sequence[str], given: Sequence[str]) -> bool:
    return all(resolve(c, given) for c in columns)


def repeated_keys(df: DataFrame, keys: Sequence[Sequence[str]]) -> list[list[str]]:
    """Those of several keys that occur more than once, found in one job."""
    listed = list(dict.fromkeys(tuple(resolve(c, df.columns) for c in k) for k in keys))
    if not listed:
        return []
    found = [duplicate_keys(df, k).limit(1).select(F.lit(i).alias("i")) for i, k in enumerate(listed)]
    hits = {r["i"] for r in reduce(DataFrame.unionAll, found).collect()}
    return [list(k) for i, k in enumerate(listed) if i in hits]
