"""Streaming queries: each runs its stream to the end and returns what was written."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablemill.queries.logs import BODY, MASKED_BODY
from tablemill.queries.registry import new_table, query, table
from tablemill.session import work_path
from tablemill.sinks import tables
from tablemill.streaming.streams import file_stream, stream_scrub, stream_sync, stream_transfer


def _stream(spark, folder, name):
    return file_stream(spark, folder, table(spark, folder, name).schema, f"{name}.parquet")


@query("SELECT event_id AS id, ts, event_type AS kind FROM events")
def streamed_transfer(spark, folder):
    path, state = work_path(spark, "stream"), work_path(spark, "stream-state")
    mappings = {"event_id": "id", "ts": "ts", "event_type": "kind"}
    stream_transfer(_stream(spark, folder, "events"), path, state, mappings).awaitTermination()
    return spark.read.parquet(path)


@query(
    """
SELECT * FROM customer WHERE c_mktsegment <> 'BUILDING'
UNION ALL SELECT c_custkey, c_name, c_nationkey, 0, c_mktsegment FROM customer
WHERE c_mktsegment = 'BUILDING'
"""
)
def streamed_sync(spark, folder):
    target, base = new_table(spark, "stream_sync")
    customers = table(spark, folder, "customer")
    tables.create_table(spark, target, customers.schema, base)
    tables.append(customers, target)
    changes = _stream(spark, folder, "customer").where("c_mktsegment = 'BUILDING'")
    changes = changes.withColumn("c_acctbal", F.lit(0.0))
    state = work_path(spark, "stream-state")
    stream_sync(changes, target, ["c_custkey"], state, "customers").awaitTermination()
    return spark.table(target)


@query(
    f"""
SELECT event_id, '/api/' || event_type AS path, CAST(ts AS DATE) AS log_date,
  {MASKED_BODY} AS request_body FROM events
"""
)
def streamed_scrub(spark, folder):
    path, state = work_path(spark, "stream"), work_path(spark, "stream-state")
    secrets = BODY.format("concat('\"p', event_id, '\"')", "event_id", "concat('p', event_id)")
    logs = _stream(spark, folder, "events").select(
        "event_id",
        F.col("ts").alias("timestamp"),
        F.expr("concat('/api/', event_type)").alias("path"),
        F.expr(secrets).alias("request_body"),
    )
    stream_scrub(logs, path, state).awaitTermination()
    return spark.read.parquet(path).drop("timestamp")
