"""The run ledger: one row per run, and its states from an append-only event table."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tablemill.metrics import RunResult
from tablemill.operators.query import deleted
from tablemill.operators.slices import with_previous

# Run states and kinds by number, states that end a run, list sizes.
STATUSES = ("Pending", "Running", "Completed", "Failed", "Cancelled")
RUN_TYPES = ("DataTransfer", "BulkInsert", "DataSync", "DocumentLoad", "DocumentJsonLoad")
TERMINAL = ("Completed", "Failed", "Cancelled")
RECENT_LIMIT = 50
STATUS_LIMIT = 100

# Progress messages that a state sets.
STATUS_MESSAGES = {
    "Running": "Processing started",
    "Completed": "Completed",
    "Failed": "Failed",
}

# The states a run may go to from each state.
NEXT_STATES = {
    "Pending": ("Running", "Cancelled"),
    "Running": ("Completed", "Failed"),
}

LEDGER_SCHEMA = (
    "id STRING, type STRING, status STRING, request_payload STRING, result_payload STRING, "
    "error_message STRING, progress INT, progress_message STRING, created_at TIMESTAMP, "
    "started_at TIMESTAMP, completed_at TIMESTAMP, created_by STRING, correlation_id STRING"
)


def ledger_row(
    spark: SparkSession,
    run_type: str,
    result: RunResult,
    started_at: datetime,
    request_payload: str | None = None,
    created_by: str | None = None,
    correlation_id: str | None = None,
) -> DataFrame:
    """A finished run as one ledger row, to append."""
    now = datetime.now(timezone.utc)
    row = (
        uuid.uuid4().hex,
        run_type,
        "Completed" if result.ok else "Failed",
        request_payload,
        result.as_json(),
        result.error,
        100 if result.ok else 0,
        "Completed" if result.ok else "Failed",
        started_at,
        started_at,
        now,
        created_by,
        correlation_id,
    )
    return spark.createDataFrame([row], LEDGER_SCHEMA)


def recent_runs(
    runs: DataFrame, limit: int = RECENT_LIMIT, tie_break: Sequence[str | Column] = ("id",)
) -> DataFrame:
    """The newest runs. Each task keeps its own ``limit`` rows; no full sort."""
    return runs.orderBy(F.desc("created_at"), *tie_break).limit(limit)


def runs_by_status(
    runs: DataFrame,
    status: str,
    limit: int = STATUS_LIMIT,
    tie_break: Sequence[str | Column] = ("id",),
) -> DataFrame:
    return recent_runs(runs.where(F.col("status") == status), limit, tie_break)


def is_finished(status: Column) -> Column:
    return status.isin(*TERMINAL)


def duration_ms(started: Column, completed: Column) -> Column:
    """Whole milliseconds between two times; NULL unless both are set."""
    micros = F.timestamp_diff("MICROSECOND", started, completed)
    return F.when(started.isNotNull() & completed.isNotNull(), (micros / 1000).cast("long"))


def payload_text(payload: Column) -> Column:
    """A result payload as compact JSON where it is JSON, else as it is; empty is NULL."""
    text = F.when(payload != "", payload)
    return F.coalesce(F.to_json(F.try_parse_json(text)), text)


def status_report(runs: DataFrame) -> DataFrame:
    """Runs as a caller sees them."""
    return runs.withColumns(
        {
            "is_finished": is_finished(F.col("status")),
            "duration_ms": duration_ms(F.col("started_at"), F.col("completed_at")),
            "result": payload_text(F.col("result_payload")),
        }
    )


def current_state(
    events: DataFrame, run: str = "run_id", at: str = "ts", sequence: str = "event_id"
) -> DataFrame:
    """Each run's state from its events.

    An event sets the status, or (status NULL) reports ``progress`` and ``message``.
    The last event by time, then sequence, that sets a value gives it. Everything is
    a maximum, so a run with a third of the events still reduces inside each task.
    """
    order = F.struct(at, sequence)
    status = F.col("status")
    reported = {c: F.col(c) if c in events.columns else F.lit(None) for c in ("progress", "message")}
    progress = F.when(status == "Running", 0).when(status == "Completed", 100)
    progress = F.coalesce(progress, reported["progress"].cast("int"))
    message = F.coalesce(
        *[F.when(status == s, text) for s, text in STATUS_MESSAGES.items()],
        reported["message"].cast("string"),
    )

    def last(value: Column) -> Column:
        return F.max_by(value, F.when(value.isNotNull(), order))

    return events.groupBy(run).agg(
        last(status).alias("status"),
        F.min(at).alias("created_at"),
        F.max(F.when(status == "Running", F.col(at))).alias("started_at"),
        F.max(F.when(is_finished(status), F.col(at))).alias("completed_at"),
        last(progress).alias("progress"),
        last(message).alias("progress_message"),
        F.count(F.lit(1)).alias("n_events"),
    )


def illegal_transitions(
    events: DataFrame, run: str = "run_id", at: str = "ts", sequence: str = "event_id"
) -> DataFrame:
    """Events whose status can't follow the run's status before; progress reports don't count."""
    changes = events.where(F.col("status").isNotNull())
    steps = with_previous(changes, run, [at, sequence], "status", "previous_status")
    legal = F.lit(False)
    for before, after in NEXT_STATES.items():
        legal = legal | ((F.col("previous_status") == before) & F.col("status").isin(*after))
    first = F.col("previous_status").isNull() & (F.col("status") == "Pending")
    return steps.where(~F.coalesce(legal | first, F.lit(False)))


def retained_runs(runs: DataFrame, older_than: Column) -> DataFrame:
    """The ledger without finished runs created before a time."""
    return deleted(runs, (F.col("created_at") < older_than) & is_finished(F.col("status")))
