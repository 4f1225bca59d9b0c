"""Where query modules put their queries."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tablemill.session import work_path
from tablemill.sources.scans import register_tables

Query = Callable[[SparkSession, str], DataFrame]

TABLES = (
    "region",
    "nation",
    "customer",
    "supplier",
    "part",
    "orders",
    "lineitem",
    "events",
    "documents",
    "embeddings",
    "pages",
    "benchmark",
    "labels",
    "conversations",
)

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name, with the SQL that gives the same rows."""

    def add(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if oracle is not None:
            ORACLES[function.__name__] = oracle
        return function

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def sql(spark: SparkSession, folder: str, text: str) -> DataFrame:
    """A query over the given tables; those it names become views first."""
    words = set(re.findall(r"\w+", text))
    register_tables(spark, folder, [t for t in TABLES if t in words])
    return spark.sql(text)


def new_table(spark: SparkSession, label: str) -> tuple[str, str]:
    """(name, base folder) for a table of one run."""
    return f"{label}_{uuid.uuid4().hex[:12]}", work_path(spark, label)
