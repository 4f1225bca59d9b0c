"""Upkeep of a ledger table."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession, functions as F

from tablemill.metrics import RunResult
from tablemill.operators.ledger import is_finished
from tablemill.plans.changes import delete_rows


def purge_runs(spark: SparkSession, ledger: str, older_than: Column) -> RunResult:
    """Delete finished runs created before a time; ``rows_deleted`` says how many."""
    return delete_rows(spark, ledger, (F.col("created_at") < older_than) & is_finished(F.col("status")))
