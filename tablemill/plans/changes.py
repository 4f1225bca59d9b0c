"""Insert, update and delete statements on lake tables, with affected-row counts."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tablemill.metrics import RunResult, counted, run
from tablemill.operators import query
from tablemill.operators.mapping import conform
from tablemill.session import delete_path, work_path
from tablemill.sinks import tables


def insert_rows(spark: SparkSession, target: str, rows: DataFrame) -> RunResult:
    def body(result: RunResult) -> None:
        ready = conform(rows, tables.read(spark, target).schema)
        ready, seen = counted(tables.arranged(ready, target))
        tables.append(ready, target)
        result.rows_read = result.rows_written = result.rows_inserted = seen.get["rows"]

    return run(target, body)


def update_rows(
    spark: SparkSession, target: str, assignments: Mapping[str, Column], where: Column
) -> RunResult:
    """Set columns where the predicate is TRUE; ``rows_written`` is the rows changed."""

    def body(result: RunResult) -> None:
        placing = [*tables.partition_columns(spark, target), *tables.bucket_keys(spark, target)[0]]
        moves = {c.lower() for c in assignments} & {c.lower() for c in placing}
        change = partial(query.updated, assignments=assignments, where=where)
        result.rows_written = _rewrite(spark, target, where, change, result, narrow=not moves)

    return run(target, body)


def delete_rows(spark: SparkSession, target: str, where: Column) -> RunResult:
    """Delete where the predicate is TRUE."""

    def body(result: RunResult) -> None:
        change = partial(query.deleted, where=where)
        result.rows_deleted = _rewrite(spark, target, where, change, result, narrow=True, removes=True)

    return run(target, body)


def _rewrite(
    spark: SparkSession,
    target: str,
    where: Column,
    change: Callable[[DataFrame], DataFrame],
    result: RunResult,
    narrow: bool,
    removes: bool = False,
) -> int:
    """Rewrite the table, or just the partitions with affected rows; the affected rows.

    Which partitions those are is found by one aggregate over the affected rows' partitions, so
    the predicate reaches the files and skips what their statistics and Bloom filters rule out.
    ``rows_read`` counts the rows rewritten.
    """
    table = spark.table(target)
    columns = tables.partition_columns(spark, target)
    if columns and not narrow and table.isEmpty():
        return 0
    if not columns or not narrow:
        rows, seen = counted(table, affected=F.count_if(where))
        tables.replace(change(rows), target)
        result.rows_read = seen.get["rows"]
        return seen.get["affected"]
    path = work_path(spark, "change-scope")
    found = table.where(where).groupBy(*columns).agg(F.count(F.lit(1)).alias("n_affected"))
    try:
        with tables.looking_up(spark):
            found.write.parquet(path)
        scope = spark.read.schema(found.schema).parquet(path)
        affected = scope.agg(F.sum("n_affected")).first()[0]
        if not affected:
            return 0
        after = change(tables.in_partitions(table, scope, columns))
        after, seen = counted(tables.arranged(after, target))
        tables.overwrite_partitions(after, target, scope=scope, gathered=True)
        result.rows_read = seen.get["rows"] + (affected if removes else 0)
        return affected
    finally:
        delete_path(spark, path)
