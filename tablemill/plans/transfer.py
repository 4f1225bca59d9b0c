"""Copy a query result, or JSON records, into a table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession, types as T

from tablemill.errors import RequestError
from tablemill.functions.names import require_columns, require_table_name
from tablemill.metrics import RunResult, counted, run
from tablemill.operators.mapping import conform, project_mapped
from tablemill.sinks import tables
from tablemill.sources.scans import query_scan, record_scan


@dataclass(frozen=True)
class TransferOptions:
    """``base`` is the folder a created table's snapshots live in."""

    column_mappings: Mapping[str, str] | None = None
    truncate: bool = False
    create_if_missing: bool = False
    base: str | None = None
    partition_by: Sequence[str] = ()
    max_records_per_file: int | None = None


def _load(
    spark: SparkSession, rows: DataFrame, target: str, options: TransferOptions, result: RunResult
) -> None:
    require_columns(rows.columns)
    if options.create_if_missing:
        if options.base is None:
            raise RequestError("A table to create needs a base folder")
        tables.create_table(spark, target, rows.schema, options.base, options.partition_by)
    if not tables.table_exists(spark, target):
        raise RequestError(f"Table '{target}' not found")
    ready = conform(rows, tables.read(spark, target).schema)
    ready, seen = counted(tables.arranged(ready, target))
    if options.truncate:
        tables.replace(ready, target, max_records_per_file=options.max_records_per_file, gathered=True)
        result.warn(f"The old rows of {target} are gone")
    else:
        tables.append(ready, target, options.max_records_per_file)
    result.rows_read = result.rows_written = seen.get["rows"]


def transfer(
    spark: SparkSession,
    source: str | DataFrame,
    target: str,
    options: TransferOptions = TransferOptions(),
    params: Mapping[str, Any] | None = None,
) -> RunResult:
    """Append, or truncate and load, a query's rows into a table.

    An empty query empties the table when truncating. One pass over the source:
    rows are counted as they are written.
    """

    def body(result: RunResult) -> None:
        require_table_name(target)
        rows = project_mapped(query_scan(spark, source, params), options.column_mappings)
        _load(spark, rows, target, options, result)

    return run(target, body)


def insert_records(
    records: DataFrame,
    json_col: str,
    target: str,
    ordinal: str | None = None,
    schema: T.StructType | None = None,
    options: TransferOptions = TransferOptions(),
) -> RunResult:
    """Append ragged JSON records; without records nothing happens."""
    spark = records.sparkSession

    def body(result: RunResult) -> None:
        require_table_name(target)
        rows = record_scan(records, json_col, ordinal, schema)
        if rows.columns:
            _load(spark, rows, target, options, result)

    return run(target, body)
