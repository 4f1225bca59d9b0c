"""Declared keys, index summaries and key profiling.

Declared indexes are rows of a table with the columns ``schema_name, table_name,
index_name, index_id, is_primary_key, is_unique, column_name, key_ordinal,
is_descending, is_included``.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Sequence
from functools import reduce
from itertools import combinations
from math import prod

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tablemill.errors import RequestError
from tablemill.functions.names import resolve
from tablemill.session import setting

TABLE = ["schema_name", "table_name"]


def index_summary(indexes: DataFrame) -> DataFrame:
    """One row per index: its key columns and their directions, in key order."""

    in_order = "WITHIN GROUP (ORDER BY key_ordinal)"
    direction = "CASE WHEN is_descending THEN 'DESC' ELSE 'ASC' END"
    return (
        indexes.where(~F.col("is_included"))
        .groupBy(*TABLE, "index_name", "index_id", "is_primary_key", "is_unique")
        .agg(
            F.expr(f"listagg(column_name, ',') {in_order}").alias("key_columns"),
            F.expr(f"listagg({direction}, ',') {in_order}").alias("orders"),
        )
    )


def in_priority(summary: DataFrame) -> DataFrame:
    """Summary rows ordered: primary key, then unique, then by index id."""
    return summary.orderBy(
        *TABLE, F.desc("is_primary_key"), F.desc("is_unique"), "index_id"
    )


def top_key(indexes: DataFrame) -> DataFrame:
    """Per table, its primary key or else its first unique index."""
    best = Window.partitionBy(*TABLE).orderBy(F.desc("is_primary_key"), "index_id")
    return (
        index_summary(indexes.where("is_primary_key OR is_unique"))
        .withColumn("rank", F.row_number().over(best))
        .where("rank = 1")
        .drop("rank")
    )


def _indexes_of(indexes: DataFrame, table: str, default_schema: str) -> DataFrame:
    schema, _, name = table.rpartition(".")
    return indexes.where(
        (F.col("schema_name") == (schema or default_schema)) & (F.col("table_name") == name)
    )


def declared_key(indexes: DataFrame, table: str, default_schema: str = "dbo") -> list[str]:
    """Key columns of a table from its declared indexes, in key order."""
    row = top_key(_indexes_of(indexes, table, default_schema)).select("key_columns").first()
    if row is None:
        raise RequestError(f"Table '{table}' declares no primary key and no unique index; name its key columns")
    return row["key_columns"].split(",")


def unique_keys(indexes: DataFrame, table: str, default_schema: str = "dbo") -> list[list[str]]:
    """Key columns of each primary key and unique index of a table, the primary key first."""
    mine = _indexes_of(indexes, table, default_schema).where("is_primary_key OR is_unique")
    found = in_priority(index_summary(mine)).select("key_columns").collect()
    return [r["key_columns"].split(",") for r in found]


def primary_keys(indexes: DataFrame, schema_name: str) -> dict[str, list[str]]:
    """Table -> columns of its primary key, for the tables of a schema. Metadata, small."""
    mine = indexes.where((F.col("schema_name") == schema_name) & F.col("is_primary_key"))
    found = index_summary(mine).select("table_name", "key_columns").collect()
    return {r["table_name"]: r["key_columns"].split(",") for r in found}


def key_profile(df: DataFrame, candidates: Sequence[Sequence[str]]) -> DataFrame:
    """Per candidate key: rows, distinct keys, rows with a NULL, and whether it is a key.

    Advice only; nothing here picks a delete key. Each candidate reads just its
    own columns and groups them with counts combined before the shuffle, so a
    value that fills a third of the table still sends one row per task.
    """

    def one(columns: Sequence[str]) -> DataFrame:
        has_null = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns])
        groups = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
        return groups.agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
            F.count(F.lit(1)).alias("n_distinct"),
            F.coalesce(F.sum(F.when(has_null, F.col("n"))), F.lit(0)).alias("n_null"),
        ).select(F.lit(",".join(columns)).alias("key_columns"), "*")

    profile = reduce(DataFrame.unionAll, [one(c) for c in candidates])
    is_key = (F.col("n_rows") == F.col("n_distinct")) & (F.col("n_null") == 0)
    return profile.withColumn("is_key", is_key)


#: Relative error of the sketches that count a column's values, how many times it a column may lack, and their size.
_ERROR, _MARGIN, _LOG_REGISTERS = 0.01, 6, 14

#: Rows of a set's first slice, how many times as many the next has, sets that one pass looks at (bits of a
#: long), rows of a partition of hashes and repeated hashes of a set that are looked up by their values.
_SLICE_ROWS, _STEP, _PASS, _PART_ROWS, _LOOKED_UP = 1 << 15, 16, 62, 1 << 18, 16

# Shuffle files go when the query that wrote them ends, not when the driver's memory is collected; set as its frame is made.
_RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def discovered_keys(df: DataFrame, max_columns: int = 3, columns: Sequence[str] | None = None) -> list[list[str]]:
    """The minimal keys of up to ``max_columns`` columns, found without candidates being named.

    A key has no NULL and no value twice; it is minimal if no part of it is one. Sets of columns
    are searched by size. A set that holds a key is skipped, as is one whose columns have too few
    values between them, by a sketch with an error of 1 % (six of which are allowed for). Of the
    others a slice is grouped, the values with one remainder of their hash: both rows of a value that
    occurs twice are in the same slice, so a set that repeats one there is no key. For what is left
    all rows' hashes are compared: values differ where these do, and rows of one hash are grouped
    by their values, so whatever is returned is a key. Sets that share a column share the pass and
    the shuffle of these hashes. An empty table has no keys to tell. Advice only, as ``key_profile``.
    """
    names = [resolve(c, df.columns) for c in columns] if columns else [
        f.name for f in df.schema if not isinstance(f.dataType, (T.MapType, T.VariantType, T.ArrayType, T.StructType))
    ]
    whole = [F.count(F.lit(1)).alias("n"), *[F.count(F.col(f"`{c}`")).alias(f"v{i}") for i, c in enumerate(names)]]
    row = df.agg(*whole).first()
    n_rows = row["n"]
    names = [c for i, c in enumerate(names) if row[f"v{i}"] == n_rows]
    if not n_rows or not names:
        return []
    sketches = [F.hll_sketch_agg(F.xxhash64(F.col(f"`{c}`")), F.lit(_LOG_REGISTERS)) for c in names]
    found = df.agg(*[F.hll_sketch_estimate(s).alias(f"d{i}") for i, s in enumerate(sketches)]).first()
    values = {c: found[f"d{i}"] for i, c in enumerate(names)}
    keys: list[list[str]] = []
    for size in range(1, max_columns + 1):
        sets = [s for s in combinations(names, size) if not any(set(k) <= set(s) for k in keys)]
        sets = [s for s in sets if prod(values[c] * (1 + _MARGIN * _ERROR) for c in s) >= n_rows]
        for slices in _slices(n_rows):
            sets = _without_repeats(df, sets, slices, n_rows)
        keys += [list(s) for s in sets]
    return keys


def _slices(n_rows: int) -> list[int]:
    """Into how many slices, powers of two, the values are cut, step by step; at last into one."""
    found = []
    slices = 1 << max(0, (n_rows // _SLICE_ROWS).bit_length() - 1)
    while slices >= _STEP:
        found.append(slices)
        slices //= _STEP
    return [*found, 1]


def _without_repeats(df: DataFrame, sets: Sequence[tuple[str, ...]], slices: int, n_rows: int) -> list[tuple[str, ...]]:
    """The sets of columns without NULLs that have no value twice in their first slice."""
    repeating: set[tuple[str, ...]] = set()
    rest = list(sets)
    if slices == 1 and n_rows > _SLICE_ROWS:
        # Texts that a collation holds equal have hashes that differ: sets with such are grouped by their values, each alone.
        collated = {f.name for f in df.schema if isinstance(f.dataType, T.StringType) and f.dataType != T.StringType()}
        plain = [s for s in sets if not collated & set(s)]
        for lead, group in _by_lead(df, plain, n_rows):
            repeating |= _repeating_hashes(df, lead, group, n_rows)
        for s in sets:
            repeating |= _repeating(df, [s], [lambda h: F.lit(True)]) if collated & set(s) else set()
        rest = []
    for at in range(0, len(rest), _PASS):
        part = rest[at : at + _PASS]
        repeating |= _repeating(df, part, [lambda h: h.bitwiseAND(F.lit(slices - 1)) == 0] * len(part))
    return [s for s in sets if s not in repeating]


def _hash(df: DataFrame, column: str) -> Column:
    """A column's hash, with its place as seed; that of a set is the XOR of its columns'."""
    return F.xxhash64(F.lit(df.columns.index(column)), F.col(f"`{column}`"))


def _repeating(df: DataFrame, sets: Sequence[tuple[str, ...]], tests: Sequence[Callable[[Column], Column]]) -> set[tuple[str, ...]]:
    """The sets that have a value twice among the rows whose hash passes the set's test.

    A row is passed on for each set whose test it passes, with the columns of that set.
    """
    spark = df.sparkSession
    names = [c for c in df.columns if any(c in s for s in sets)]
    hashes = {c: f"__h{i}" for i, c in enumerate(names)}
    values = [F.col(f"`{c}`").alias(f"__v{i}") for i, c in enumerate(names)]
    hashed = df.select(*values, *[_hash(df, c).alias(hashes[c]) for c in names])
    bits = [
        F.when(test(reduce(Column.bitwiseXOR, [F.col(hashes[c]) for c in s])), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long"))
        for i, (s, test) in enumerate(zip(sets, tests))
    ]
    # Spark moves no filter below the number of a partition; there each test would hash its columns anew.
    marked = hashed.select(*[f"__v{i}" for i in range(len(names))], reduce(Column.bitwiseOR, bits).alias("__bits"), F.spark_partition_id().alias("__at"))
    numbered = marked.where("__bits != 0 AND __at >= 0").select("*", F.explode(F.sequence(F.lit(0), F.lit(len(sets) - 1))).alias("__set"))
    rows = numbered.where("shiftright(__bits, __set) % 2 != 0")
    held = [
        F.when(F.col("__set").isin([j for j, s in enumerate(sets) if c in s]), F.col(f"__v{i}")).alias(f"__v{i}")
        for i, c in enumerate(names)
    ]
    groups = rows.select("__set", *held).groupBy("__set", *[f"__v{i}" for i in range(len(names))])
    with setting(spark, _RELEASE, "true"):
        twice = groups.agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("__set").distinct()
        return {sets[r["__set"]] for r in twice.collect()}


def _by_lead(df: DataFrame, sets: Sequence[tuple[str, ...]], n_rows: int) -> list[tuple[str | None, list[tuple[str, ...]]]]:
    """The sets by a column that they share, if its values spread the rows evenly; else each set alone."""
    parts = -(-n_rows // _PART_ROWS)

    def spreads(column: str) -> bool:
        buckets = df.groupBy(F.pmod(_hash(df, column), F.lit(8 * parts))).agg(F.count(F.lit(1)).alias("n"))
        return buckets.agg(F.max("n")).first()[0] <= _PART_ROWS

    found: list[tuple[str | None, list[tuple[str, ...]]]] = []
    rest, uneven = list(sets), set()
    while shared := Counter(c for s in rest for c in s if c not in uneven):
        lead, n = shared.most_common(1)[0]
        if n == 1:
            break
        if spreads(lead):
            found.append((lead, [s for s in rest if lead in s]))
            rest = [s for s in rest if lead not in s]
        else:
            uneven.add(lead)
    return found + [(None, [s]) for s in rest]


def _repeating_hashes(df: DataFrame, lead: str | None, sets: Sequence[tuple[str, ...]], n_rows: int) -> set[tuple[str, ...]]:
    """The sets that have a value twice, of sets that share the column ``lead`` or of a single one.

    Rows are dealt by the hash of that column (or of the single set), so that those of a value meet
    in a partition, which sorts each set's hashes. Sets that repeat a hash are looked up by their values there.
    """
    spark = df.sparkSession
    whole = reduce(Column.bitwiseXOR, [_hash(df, c) for c in sets[0]]) if lead is None else _hash(df, lead)
    names = [] if lead is None else [c for c in df.columns if c != lead and any(c in s for s in sets)]
    places = [[0, *[1 + names.index(c) for c in s if c in names]] for s in sets]
    dealt = df.select(whole.alias("__at"), *[_hash(df, c).alias(f"__h{i}") for i, c in enumerate(names)])
    dealt = dealt.repartition(-(-n_rows // _PART_ROWS), "__at")
    hashes: dict[int, set[int]] = {}
    cut = set()
    with setting(spark, _RELEASE, "true"):
        found = dealt.mapInArrow(_equal_hashes(places), "n int, hash long, is_all boolean")
        for r in found.collect():
            hashes.setdefault(r["n"], set()).add(r["hash"])
            cut |= set() if r["is_all"] else {r["n"]}
    cut |= {n for n, h in hashes.items() if len(h) > _LOOKED_UP}
    repeating: set[tuple[str, ...]] = set()
    suspects = sorted(hashes)
    for at in range(0, len(suspects), _PASS):
        part = suspects[at : at + _PASS]
        tests = [lambda h, seen=sorted(hashes[n])[:_LOOKED_UP]: h.isin(seen) for n in part]
        repeating |= _repeating(df, [sets[n] for n in part], tests)
    # More hashes than were looked up, all by chance: nothing is told of the others.
    for n in sorted(cut):
        if sets[n] not in repeating:
            repeating |= _repeating(df, [sets[n]], [lambda h: F.lit(True)])
    return repeating


def _equal_hashes(places: list[list[int]]) -> Callable:
    """Per set (the places of its columns' hashes) the hashes that a partition has twice, or some of them."""
    most, at_once = _LOOKED_UP, 4 * _PART_ROWS

    def run(batches):
        import numpy as np
        import pyarrow as pa

        found: dict[int, tuple] = {}
        held: list[list] = []
        n_held, look_at = 0, at_once

        def look(is_last: bool) -> None:
            columns = [np.concatenate(c) for c in zip(*held)]
            held[:] = [columns]
            for n, place in enumerate(places):
                if n in found:
                    continue
                hashes = np.bitwise_xor.reduce([columns[i] for i in place]) if len(place) > 1 else columns[place[0]].copy()
                hashes.sort()
                twice = np.unique(hashes[1:][hashes[1:] == hashes[:-1]])
                if len(twice):
                    found[n] = (twice[:most], is_last and len(twice) <= most)

        for batch in batches:
            if len(found) == len(places):
                continue
            held.append([c.to_numpy() for c in batch.columns])
            n_held += batch.num_rows
            if n_held >= look_at:
                look(False)
                look_at = 2 * n_held
        if held and len(found) < len(places):
            look(True)
        for n, (hashes, is_all) in found.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([n] * len(hashes), pa.int32()), pa.array(hashes, pa.int64()), pa.array([is_all] * len(hashes))], ["n", "hash", "is_all"]
            )

    return run
