"""Run-ledger queries over the event table, one event type per run state."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import functions as F

from tablemill.operators import ledger as ops
from tablemill.plans.ledger import purge_runs
from tablemill.plans.transfer import TransferOptions, transfer
from tablemill.queries.registry import new_table, query, sql, table
from tablemill.sinks import tables

LEDGERED = ("customer", "orders", "lineitem")

STATUS = """
CASE event_type WHEN 'signup' THEN 'Pending' WHEN 'view' THEN 'Running' WHEN 'click' THEN 'Cancelled'
     WHEN 'purchase' THEN 'Completed' ELSE 'Failed' END
"""

# Each event as one run. Finished runs end `value` seconds after they start.
RUNS = f"""
SELECT event_id AS id, {STATUS} AS status, ts AS created_at,
       CASE WHEN event_type <> 'signup' THEN ts END AS started_at,
       CASE WHEN event_type = 'view' THEN concat('not JSON: ', event_type)
            WHEN event_type <> 'signup' THEN props END AS result_payload,
       CAST(round(value * 1000) AS BIGINT) AS ms
FROM events
"""
EVENTS = f"SELECT event_id, user_id AS run_id, ts, {STATUS} AS status FROM events"


def _runs(spark, folder):
    runs = sql(spark, folder, RUNS)
    ended = F.when(
        ops.is_finished(F.col("status")),
        F.timestamp_add("MILLISECOND", F.col("ms"), F.col("started_at")),
    )
    return runs.withColumn("completed_at", ended).drop("ms")


@query(f"SELECT id, status, created_at FROM ({RUNS}) r ORDER BY created_at DESC, id LIMIT 50")
def runs_recent(spark, folder):
    return ops.recent_runs(_runs(spark, folder)).select("id", "status", "created_at")


@query(
    f"""
SELECT id, created_at FROM ({RUNS}) r WHERE status = 'Failed'
ORDER BY created_at DESC, id LIMIT 100
"""
)
def runs_by_status(spark, folder):
    return ops.runs_by_status(_runs(spark, folder), "Failed").select("id", "created_at")


@query(
    f"""
SELECT id, status, status IN ('Completed', 'Failed', 'Cancelled') AS is_finished,
       CASE WHEN status IN ('Completed', 'Failed', 'Cancelled') AND started_at IS NOT NULL
            THEN ms END AS duration_ms,
       CASE WHEN result_payload LIKE 'not%' THEN result_payload
            ELSE replace(result_payload, ' ', '') END AS result
FROM ({RUNS}) r
"""
)
def runs_status(spark, folder):
    report = ops.status_report(_runs(spark, folder))
    return report.select("id", "status", "is_finished", "duration_ms", "result")


@query(
    f"""
SELECT run_id, arg_max(status, (ts, event_id)) AS status, min(ts) AS created_at,
       max(ts) FILTER (status = 'Running') AS started_at,
       max(ts) FILTER (status IN ('Completed', 'Failed', 'Cancelled')) AS completed_at,
       arg_max(CASE status WHEN 'Running' THEN 0 ELSE 100 END, (ts, event_id))
         FILTER (status IN ('Running', 'Completed')) AS progress,
       arg_max(CASE status WHEN 'Running' THEN 'Processing started' ELSE status END, (ts, event_id))
         FILTER (status IN ('Running', 'Completed', 'Failed')) AS progress_message,
       count(*) AS n_events
FROM ({EVENTS}) e GROUP BY run_id
"""
)
def runs_current_state(spark, folder):
    return ops.current_state(sql(spark, folder, EVENTS))


@query(
    f"""
WITH steps AS (SELECT *, lag(status) OVER (PARTITION BY run_id ORDER BY ts, event_id) AS previous_status
               FROM ({EVENTS}) e)
SELECT event_id, run_id, previous_status, status FROM steps
WHERE NOT coalesce((previous_status = 'Pending' AND status IN ('Running', 'Cancelled'))
  OR (previous_status = 'Running' AND status IN ('Completed', 'Failed'))
  OR (previous_status IS NULL AND status = 'Pending'), false)
"""
)
def runs_illegal_transitions(spark, folder):
    steps = ops.illegal_transitions(sql(spark, folder, EVENTS))
    return steps.select("event_id", "run_id", "previous_status", "status")


@query(
    f"""
SELECT id, status, created_at FROM ({RUNS}) r
WHERE NOT (created_at < TIMESTAMP '2024-01-15 00:00:00'
           AND status IN ('Completed', 'Failed', 'Cancelled'))
"""
)
def runs_retention(spark, folder):
    cutoff = F.expr("TIMESTAMP_NTZ'2024-01-15 00:00:00'")
    return ops.retained_runs(_runs(spark, folder), cutoff).select("id", "status", "created_at")


@query(
    """
SELECT count(*) FILTER (gone) AS n_purged, count(*) FILTER (NOT gone) AS n_left
FROM (SELECT o_orderdate < TIMESTAMP '1996-01-01' AND o_orderstatus <> 'P' AS gone FROM orders) q
"""
)
def runs_purged(spark, folder):
    """Finished runs before a time go from a ledger table, and are counted."""
    ledger, base = new_table(spark, "purged")
    rows = sql(
        spark,
        folder,
        "SELECT cast(o_orderkey as string) AS id, cast(o_orderdate as timestamp) AS created_at, "
        "CASE o_orderstatus WHEN 'F' THEN 'Completed' WHEN 'O' THEN 'Failed' ELSE 'Running' END AS status FROM orders",
    )
    tables.create_table(spark, ledger, rows.schema, base)
    tables.append(rows, ledger)
    result = purge_runs(spark, ledger, F.expr("cast(TIMESTAMP_NTZ'1996-01-01 00:00:00' as timestamp)"))
    left = spark.table(ledger).agg(F.count("*").alias("n_left"))
    return left.select(F.lit(result.rows_deleted).cast("long").alias("n_purged"), "n_left")


@query(
    " UNION ALL ".join(
        f"SELECT 'DataTransfer' AS type, 'Completed' AS status, true AS is_finished, "
        f"'{t}' AS correlation_id, CAST(count(*) AS INT) AS rows_written FROM {t}"
        for t in LEDGERED
    )
)
def runs_appended(spark, folder):
    """Transfers noted in a ledger table, and read back with their metrics."""
    ledger, base = new_table(spark, "ledger")
    schema = spark.createDataFrame([], ops.LEDGER_SCHEMA).schema
    tables.create_table(spark, ledger, schema, base)
    for name in LEDGERED:
        target, target_base = new_table(spark, "ledgered")
        started = datetime.now(timezone.utc)
        options = TransferOptions(create_if_missing=True, base=target_base)
        result = transfer(spark, table(spark, folder, name), target, options)
        row = ops.ledger_row(spark, "DataTransfer", result, started, correlation_id=name)
        tables.append(row, ledger)
    report = ops.status_report(spark.table(ledger))
    written = F.get_json_object("result", "$.rows_written").cast("int")
    return report.select(
        "type", "status", "is_finished", "correlation_id", written.alias("rows_written")
    )
