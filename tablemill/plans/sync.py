"""Reconcile a table with a query by key."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F

from tablemill.errors import RequestError
from tablemill.functions.names import require_columns, require_table_name, resolve
from tablemill.metrics import RunResult, counted, run
from tablemill.operators import sync as ops
from tablemill.operators.keys import declared_key, unique_keys
from tablemill.session import delete_path, work_path
from tablemill.sinks import tables
from tablemill.sources.scans import query_scan


@dataclass(frozen=True)
class SyncOptions:
    column_mappings: Mapping[str, str] | None = None
    delete_all_before_insert: bool = False
    unique_keys: bool = False
    reject_null_keys: bool = False
    key_collation: str | None = None
    max_records_per_file: int | None = None


def sync_table(
    spark: SparkSession,
    source: str | DataFrame,
    target: str,
    keys: Sequence[str] | None = None,
    options: SyncOptions = SyncOptions(),
    declared_indexes: DataFrame | None = None,
    params: Mapping[str, Any] | None = None,
    tag: str | None = None,
) -> RunResult:
    """Delete the target rows whose key the source has, insert all source rows.

    The source is evaluated once and written to the shared folder, so that the
    keys deleted and the rows inserted can't differ. The new content is written
    beside the old and published in one step. Of a partitioned or bucketed table only the partitions
    that lose or get rows are rewritten, whether or not they are part of the key; where they
    are few enough to broadcast, only they are read for it.
    """

    def body(result: RunResult) -> None:
        require_table_name(target)
        rows = query_scan(spark, source, params)
        given = list(keys or ())
        if not given and not options.delete_all_before_insert:
            if declared_indexes is None:
                raise RequestError("No key columns given")
            given = declared_key(declared_indexes, target)
            result.warn(f"Key columns from declared indexes: {', '.join(given)}")
        names = ops.resolve_keys(rows, given, options.column_mappings) if given else []
        require_columns(rows.columns)
        current = spark.table(target)
        staged_path = work_path(spark, "sync-source")
        prepared = ops.prepare_source(tables.read(spark, target), rows, options.column_mappings)
        prepared, seen = counted(tables.bucketed(prepared, target))
        prepared.write.parquet(staged_path)
        result.rows_read = seen.get["rows"]
        result.warn(f"Staged {result.rows_read} source rows")
        try:
            if result.rows_read == 0:
                result.warn("The source has no rows, so the target stays as it is")
                return
            staged = spark.read.schema(prepared.schema).parquet(staged_path)
            if options.reject_null_keys and not staged.where(ops.any_null(names)).isEmpty():
                raise RequestError(f"Source has NULL keys: {', '.join(names)}")
            unique = [names] if options.unique_keys and names else []
            if declared_indexes is not None:
                given_columns = ops.target_names(rows.columns, current.columns, options.column_mappings)
                unique += [u for u in unique_keys(declared_indexes, target) if ops.all_given(u, given_columns)]
            for columns in ops.repeated_keys(staged, unique):
                raise RequestError(f"Source has duplicate keys: {', '.join(columns)}")
            _apply(spark, current, staged, target, names, options, result, tag)
        finally:
            delete_path(spark, staged_path)

    return run(target, body)


def _apply(
    spark: SparkSession,
    current: DataFrame,
    staged: DataFrame,
    target: str,
    keys: Sequence[str],
    options: SyncOptions,
    result: RunResult,
    tag: str | None,
) -> None:
    if options.delete_all_before_insert:
        result.rows_deleted = current.count()
        tables.replace(staged, target, tag, options.max_records_per_file)
    else:
        columns = tables.partition_columns(spark, target)
        names = [resolve(k, current.columns) for k in keys]
        scope_path = work_path(spark, "sync-scope")
        try:
            before, scope = current, None
            if columns:
                found = _scope(spark, current, staged, target, names, columns, options)
                with tables.looking_up(spark):
                    found.write.parquet(scope_path)
                scope = spark.read.schema(found.schema).parquet(scope_path)
                before = tables.in_partitions(current, scope, columns)
            bucket = _shared_bucket(spark, current, target, names, options)
            bounds = {} if bucket else ops.key_bounds(staged, names)
            flagged, seen = counted(
                ops.flagged_rows(before, staged, names, options.key_collation, bounds, bucket),
                deleted=F.count(ops.MATCHED),
            )
            kept = flagged.where(F.col(ops.MATCHED).isNull()).drop(ops.MATCHED)
            after = kept.unionByName(staged.repartition(bucket) if bucket else staged)
            if scope is None:
                tables.replace(after, target, tag, options.max_records_per_file)
            elif bucket:
                with ops.joining_within(spark):
                    tables.overwrite_partitions(after, target, options.max_records_per_file, tag, scope, gathered=True)
                result.warn("Rewrote only the partitions the sync touches")
            else:
                tables.overwrite_partitions(after, target, options.max_records_per_file, tag, scope)
                result.warn("Rewrote only the partitions the sync touches")
            result.rows_deleted = seen.get["deleted"]
        finally:
            delete_path(spark, scope_path)
    result.rows_inserted = result.rows_written = result.rows_read
    result.warn(f"{result.rows_deleted} target rows had a key of the source")
    result.warn(f"{result.rows_inserted} source rows are in the target")


def _together(spark: SparkSession, current: DataFrame, target: str, keys: Sequence[str], columns: Sequence[str], options: SyncOptions) -> bool:
    """Whether equal keys are in one partition."""
    deciding = tables.bucket_keys(spark, target)[0] or columns
    plain = not options.key_collation or not any(dict(current.dtypes)[c] == "string" for c in deciding)
    return set(deciding) <= set(keys) and plain


def _shared_bucket(spark: SparkSession, current: DataFrame, target: str, keys: Sequence[str], options: SyncOptions) -> str | None:
    """The hidden bucket column, where equal keys share a bucket and none is text compared by a collation."""
    if tables.BUCKET not in current.columns or options.key_collation:
        return None
    return tables.BUCKET if _together(spark, current, target, keys, [tables.BUCKET], options) else None


def _scope(
    spark: SparkSession,
    current: DataFrame,
    staged: DataFrame,
    target: str,
    keys: Sequence[str],
    columns: Sequence[str],
    options: SyncOptions,
) -> DataFrame:
    """The partitions that lose or get rows.

    Where equal keys are in one partition, as in a bucketed table or one partitioned by key
    columns, the source tells them all and the target isn't read. Else the target's key and
    partition columns are; where the source has few keys and the files Bloom filters of them, only
    in the row groups that can hold one.
    """
    if _together(spark, current, target, keys, columns, options):
        return staged.select(*tables.stored_partition(staged, columns)).distinct()
    stored = tables.stored_partition(current, columns)
    looked_up = [c for c in tables.lookup_columns(spark, target) if c in keys]
    exact = [c for c in looked_up if not options.key_collation or dict(current.dtypes)[c] != "string"]
    near = tables.having(current, staged, exact)
    return ops.touched_partitions(near, staged, keys, stored, options.key_collation)
