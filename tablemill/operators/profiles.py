"""Column profiles as sketches that merge.

A profile has one row per partition and column: counts, bounds, and sketches of the distinct
values, of the quantiles and of the frequent values. Rows of any partitions merge into one, so a
table's profile comes from those of its partitions, and only new partitions need to be read.

- Counts, bounds and the longest text are exact. Numbers, dates (days since 1970) and timestamps
  (seconds since 1970) are held as doubles, which round whole numbers beyond 2**53; bounds of texts
  are cut to their first ``CUT`` characters.
- ``n_distinct`` has a relative standard error of 0.8 %, which is ``DISTINCT_ERROR``.
- A quantile's rank is off by ``RANK_ERROR`` at most, in 99 % of cases.
- ``frequent`` lists values, texts by their first ``CUT`` characters; a count is off by
  ``FREQUENT_ERROR`` of the rows at most.

NULLs count in ``n_rows`` and ``n_null`` only. Arrays, maps, structs, binaries and variants have no more than
these two. Repeated rows count each.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

CUT = 64
DISTINCT_ERROR = 0.008
RANK_ERROR = 0.01
FREQUENT_ERROR = 0.004

# Sizes of the sketches: registers (a power of two), items a level, values tracked.
_REGISTERS, _ITEMS, _TRACKED = 14, 400, 1000
_QUANTILES = (0.0, 0.25, 0.5, 0.75, 1.0)

_STATE = (
    T.StructType().add("sketch", "binary").add("maxItemsTracked", "integer").add("itemDataType", "string").add("itemDataTypeDDL", "string")
)
SKETCHES = (
    T.StructType()
    .add("ordinal", "integer")
    .add("column_name", "string")
    .add("n_rows", "long")
    .add("n_null", "long")
    .add("n_values", "long")
    .add("longest", "long")
    .add("least_number", "double")
    .add("most_number", "double")
    .add("least_text", "string")
    .add("most_text", "string")
    .add("distinct_values", "binary")
    .add("quantiles", "binary")
    .add("frequent", _STATE)
)
_NAMES = SKETCHES.names


def _facts(ordinal: int, field: T.StructField) -> str:
    """SQL of one column's row, without the number of rows."""
    value = "`" + field.name.replace("`", "``") + "`"
    name = "'" + field.name.replace("\\", "\\\\").replace("'", "\\'") + "'"
    kind = field.dataType
    text = f"left({value}, {CUT})" if isinstance(kind, T.StringType) else f"CAST({value} AS STRING)"
    number = "CAST(NULL AS DOUBLE)"
    if isinstance(kind, T.DateType):
        number = f"CAST(unix_date({value}) AS DOUBLE)"
    elif isinstance(kind, T.TimestampType):
        number = f"unix_micros({value}) / 1e6D"
    elif isinstance(kind, T.TimestampNTZType):
        number = f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {value}) / 1e6D"
    elif isinstance(kind, T.NumericType):
        number = f"CAST({value} AS DOUBLE)"
    is_text = isinstance(kind, T.StringType)
    plain = number != "CAST(NULL AS DOUBLE)" or isinstance(kind, (T.StringType, T.BooleanType))
    some = f"FILTER (WHERE {value} IS NOT NULL)" if plain else "FILTER (WHERE FALSE)"
    facts = {
        "ordinal": str(ordinal),
        "column_name": name,
        "n_null": f"count_if({value} IS NULL)",
        "longest": f"CAST(max(length({value})) AS BIGINT)" if is_text else "CAST(NULL AS BIGINT)",
        "least_number": f"min({number})",
        "most_number": f"max({number})",
        "least_text": f"min({text})" if is_text else "CAST(NULL AS STRING)",
        "most_text": f"max({text})" if is_text else "CAST(NULL AS STRING)",
        # Any column gives both sketches, so that rows merge; a column of another kind gives empty ones.
        "distinct_values": f"hll_sketch_agg(xxhash64({value if plain else 'NULL'}), {_REGISTERS}) {some}",
        "quantiles": f"kll_sketch_agg_double({number}, {_ITEMS})",
        "frequent": f"approx_top_k_accumulate({text if plain else 'CAST(NULL AS STRING)'}, {_TRACKED}) {some}",
    }
    return f"named_struct({', '.join(f'{k!r}, {v}' for k, v in facts.items())})"


def column_sketches(df: DataFrame, by: Sequence[str] = (), skip: Sequence[str] = ()) -> DataFrame:
    """The profile rows of ``df`` per value of ``by``, whose columns come first; ``skip`` is left out.

    One pass. Tasks sketch what they read and only sketches are shuffled, so a partition may hold
    any share of the rows. A value of ``by`` that ``df`` has no row of gets no profile.
    """
    fields = [f for f in df.schema if f.name not in skip]
    rows = F.count(F.lit(1)).alias("n_rows")
    columns = F.expr(f"array({', '.join(_facts(i, f) for i, f in enumerate(fields, start=1))})").alias("c")
    held = [F.col(f"`{c}`").alias(f"__by{i}") for i, c in enumerate(by)]
    found = df.select("*", *held).groupBy(*[f"__by{i}" for i in range(len(by))]).agg(rows, columns)
    if not by:
        found = found.where("n_rows > 0")
    found = found.select(*[F.col(f"__by{i}").alias(c) for i, c in enumerate(by)], "n_rows", F.inline("c"))
    found = found.withColumn("n_values", F.col("n_rows") - F.col("n_null"))
    return found.select(*[F.col(f"`{c}`") for c in by], *_NAMES)


def merged(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Profile rows put together: one per column, and per value of ``by``, which ``sketches`` has too."""
    return (
        sketches.groupBy(*by, "column_name")
        .agg(
            F.max("ordinal").alias("ordinal"),
            *[F.sum(c).alias(c) for c in ("n_rows", "n_null", "n_values")],
            F.max("longest").alias("longest"),
            *[F.min(c).alias(c) for c in ("least_number", "least_text")],
            *[F.max(c).alias(c) for c in ("most_number", "most_text")],
            F.hll_union_agg("distinct_values").alias("distinct_values"),
            F.kll_merge_agg_double("quantiles").alias("quantiles"),
            F.expr(f"approx_top_k_combine(frequent, {_TRACKED})").alias("frequent"),
        )
        .select(*by, *_NAMES)
    )


def described(sketches: DataFrame, most_frequent: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """Profile rows with what their sketches tell: ``n_distinct``, ``quantiles`` (least, quarters, most) and ``frequent``.

    Quantiles are NULL for columns without numbers.
    """
    points = F.array(*[F.lit(q) for q in _QUANTILES])
    exact = [c for c in _NAMES if c not in ("distinct_values", "quantiles", "frequent")]
    listed = F.expr(f"approx_top_k_estimate(frequent, {int(most_frequent)})")
    return sketches.select(
        *by,
        *exact,
        F.hll_sketch_estimate("distinct_values").alias("n_distinct"),
        _if_any(F.kll_sketch_get_quantile_double("quantiles", points)).alias("quantiles"),
        F.when(F.col("n_values") > 0, listed).alias("frequent"),
    )


def _if_any(quantiles: Column) -> Column:
    return F.when(F.col("least_number").isNotNull(), quantiles)
