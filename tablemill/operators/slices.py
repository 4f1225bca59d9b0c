"""Total order without a one-task window.

Rows are range-partitioned into slices of like size and written once, each with
its slice number and its place in the slice. A key, or a tie, that holds a third
of the rows is cut into many slices. Writing pins the slices: sampled range
bounds differ from run to run, and a lost executor must not renumber rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tablemill.session import work_path

SLICE = "__slice"
PLACE = "__place"
_ARRIVAL = "__arrival"


def in_slices(
    df: DataFrame,
    order_by: Sequence[str | Column] = (),
    slices: int | None = None,
    keep: Sequence[str] | None = None,
    path: str | None = None,
) -> DataFrame:
    """``df`` (its ``keep`` columns) with SLICE and PLACE, slice by slice in ``order_by`` order.

    Without an order the scan's own partitions are the slices and nothing shuffles.
    The rows stay at ``path``, by default a new one in the shared folder.
    """
    spark = df.sparkSession
    out = df
    if order_by:
        # Arrival order breaks ties, so that equal rows spread over slices too.
        order = [*order_by, F.col(_ARRIVAL)]
        out = df.withColumn(_ARRIVAL, F.monotonically_increasing_id())
        out = out.repartitionByRange(*([slices] if slices else []), *order)
        out = out.sortWithinPartitions(*order).drop(_ARRIVAL)
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    columns = list(keep or df.columns)
    out = out.select(*columns, F.spark_partition_id().alias(SLICE), place.alias(PLACE))
    path = path or work_path(spark, "slices")
    out.write.parquet(path)
    return spark.read.schema(out.schema).parquet(path)


def dense_ids(
    df: DataFrame,
    id_col: str = "Id",
    order_by: Sequence[str | Column] = (),
    start: int = 1,
    slices: int | None = None,
    keep: Sequence[str] | None = None,
    path: str | None = None,
) -> DataFrame:
    """``df`` (its ``keep`` columns) with ids ``start, start + 1, ...`` in ``order_by`` order."""
    spark = df.sparkSession
    staged = in_slices(df, order_by, slices, keep, path)
    # One row per write task, whatever the data: small enough to add up here.
    sizes = staged.groupBy(SLICE).agg(F.count(F.lit(1)).alias("n")).orderBy(SLICE).collect()
    offsets, total = [], start
    for row in sizes:
        offsets.append((row[SLICE], total))
        total += row["n"]
    schema = T.StructType([T.StructField(SLICE, T.IntegerType()), T.StructField("at", T.LongType())])
    starts = spark.createDataFrame(offsets, schema)
    numbered = staged.join(starts, SLICE)
    columns = [c for c in staged.columns if c not in (SLICE, PLACE)]
    return numbered.select((F.col("at") + F.col(PLACE)).alias(id_col), *columns)


def with_previous(
    df: DataFrame,
    key: str,
    order_by: Sequence[str],
    value: str,
    name: str,
    slices: int | None = None,
) -> DataFrame:
    """``df`` with the ``value`` of the key's previous row, NULL for its first.

    A plain ``lag`` by key would put a hot key into one task. Here ``lag`` runs by
    key and slice, and each slice is handed the key's last value before it as an
    extra row in front. Those extra rows are one per key and slice.
    """
    staged = in_slices(df, [key, *order_by], slices)
    ends = staged.groupBy(key, SLICE).agg(F.max_by(F.struct(value), PLACE).alias("__end"))
    before = Window.partitionBy(key).orderBy(SLICE)
    handed = ends.withColumn("__far", F.lag("__end").over(before)).where("__far IS NOT NULL")
    handed = handed.select(
        key, SLICE, F.lit(-1).cast("long").alias(PLACE), F.col("__far")[value].alias(value)
    )
    rows = staged.unionByName(handed, allowMissingColumns=True)
    at = Window.partitionBy(key, SLICE).orderBy(PLACE)
    found = rows.withColumn(name, F.lag(value).over(at)).where(F.col(PLACE) >= 0)
    return found.select(*df.columns, name)
