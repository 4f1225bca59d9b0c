"""Structured Streaming jobs: pick up new files, process each once, stop.

All three are stateless, or decided by the last batch, so late rows need no
watermark.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql.streaming import StreamingQuery

from tablemill.metrics import RunResult
from tablemill.operators.mapping import project_mapped
from tablemill.operators.requestlog import roll_columns, scrub, with_roll_columns
from tablemill.plans.sync import SyncOptions, sync_table
from tablemill.sinks import tables


def file_stream(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    glob: str | None = None,
    max_files: int | None = None,
) -> DataFrame:
    """Parquet files of a folder as a stream, ``max_files`` per batch."""
    reader = spark.readStream.schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", str(max_files))
    return reader.parquet(path)


def stream_transfer(
    rows: DataFrame, path: str, checkpoint: str, column_mappings: Mapping[str, str] | None = None
) -> StreamingQuery:
    """Append new rows to a folder, exactly once."""
    out = project_mapped(rows, column_mappings)
    return _to_files(out, path, checkpoint, [])


def stream_scrub(
    logs: DataFrame, path: str, checkpoint: str, interval: str = "Daily", strict: bool = False
) -> StreamingQuery:
    """Scrub new log records into day or hour folders, exactly once."""
    out = with_roll_columns(scrub(logs, strict=strict), interval)
    return _to_files(out, path, checkpoint, roll_columns(interval))


def _to_files(df: DataFrame, path: str, checkpoint: str, partition_by: list[str]) -> StreamingQuery:
    writer = df.writeStream.format("parquet").outputMode("append")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    return (
        writer.option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stream_sync(
    rows: DataFrame,
    target: str,
    keys: Sequence[str],
    checkpoint: str,
    stream_name: str,
    options: SyncOptions = SyncOptions(),
    on_result: Callable[[int, RunResult], None] | None = None,
) -> StreamingQuery:
    """Sync each batch into a table.

    A batch may be replayed after a crash. The published snapshot carries the stream's
    name and batch number, and a replayed batch that finds its own mark is skipped. Of a
    partitioned table the touched partitions switch one by one: a batch broken off there
    left its finished snapshot named in the table's properties, and the replay switches
    the rest to it. So rows with NULL keys are not added twice either.
    """
    spark = rows.sparkSession

    def apply(batch: DataFrame, batch_id: int) -> None:
        tag = f"{stream_name}-batch{batch_id}-"
        if tables.end_switch(spark, target, tag):
            return
        result = sync_table(spark, batch, target, keys, options, tag=tag)
        if on_result:
            on_result(batch_id, result)
        if not result.ok:
            raise RuntimeError(result.error)

    return (
        rows.writeStream.foreachBatch(apply)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
