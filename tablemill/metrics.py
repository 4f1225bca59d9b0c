"""Run metrics: what a run read, wrote, deleted and rejected."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Observation, functions as F

from tablemill.errors import RequestError


@dataclass
class RunResult:
    """Outcome of one run. A failed run has ``error`` set and changed nothing."""

    target: str = ""
    rows_read: int = 0
    rows_written: int = 0
    rows_deleted: int = 0
    rows_inserted: int = 0
    rows_failed: int = 0
    elapsed_ms: int = 0
    warnings: list[str] = field(default_factory=list)
    error: str | None = None

    @property
    def ok(self) -> bool:
        return self.error is None

    def warn(self, message: str) -> None:
        self.warnings.append(message)

    def as_json(self) -> str:
        return json.dumps(asdict(self))


def run(target: str, body: Callable[[RunResult], None]) -> RunResult:
    """Run ``body``, time it and turn a failure into a value."""
    result = RunResult(target=target)
    started = time.monotonic()
    try:
        body(result)
    except (RequestError, PySparkException, Py4JJavaError) as exc:
        result.error = str(exc)
    result.elapsed_ms = int((time.monotonic() - started) * 1000)
    return result


def counted(df: DataFrame, **aggregates: Column) -> tuple[DataFrame, Observation]:
    """Count rows (and more) as they flow past, with no second pass.

    Place it above the last shuffle: the counts then come from result tasks,
    which Spark counts once each even when an executor is lost and a task reruns.
    """
    observation = Observation()
    extra = [expr.alias(name) for name, expr in aggregates.items()]
    return df.observe(observation, F.count(F.lit(1)).alias("rows"), *extra), observation
