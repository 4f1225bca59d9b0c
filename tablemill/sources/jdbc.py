"""Database scans over JDBC."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

# Default rows per round trip and seconds per statement.
BATCH_SIZE = 1000
TIMEOUT_SECONDS = 300


def read_options(
    url: str,
    query: str,
    timeout: int = TIMEOUT_SECONDS,
    fetch_size: int = BATCH_SIZE,
    split: tuple[str, object, object, int] | None = None,
    properties: Mapping[str, str] | None = None,
) -> dict[str, str]:
    """Reader options. ``split`` is (column, lower, upper, tasks).

    Spark allows no ``query`` together with a split, so a split query becomes a
    derived table.
    """
    options = {
        "url": url,
        "queryTimeout": str(timeout),
        "fetchsize": str(fetch_size),
        **(properties or {}),
    }
    if split is None:
        return {**options, "query": query}
    column, lower, upper, tasks = split
    return {
        **options,
        "dbtable": f"({query}) q",
        "partitionColumn": column,
        "lowerBound": str(lower),
        "upperBound": str(upper),
        "numPartitions": str(tasks),
    }


def jdbc_scan(
    spark: SparkSession,
    url: str,
    query: str,
    split_column: str | None = None,
    tasks: int = 1,
    timeout: int = TIMEOUT_SECONDS,
    fetch_size: int = BATCH_SIZE,
    properties: Mapping[str, str] | None = None,
) -> DataFrame:
    """Rows of a query on another database.

    With ``split_column`` the range of that column is asked for first and the
    rows are then read by ``tasks`` connections at once.
    """
    reader = spark.read.format("jdbc")
    if split_column is None or tasks <= 1:
        options = read_options(url, query, timeout, fetch_size, properties=properties)
        return reader.options(**options).load()
    bounds = f"SELECT MIN({split_column}) AS lo, MAX({split_column}) AS hi FROM ({query}) q"
    row = reader.options(
        **read_options(url, bounds, timeout, fetch_size, properties=properties)
    ).load().first()
    if row[0] is None:
        options = read_options(url, query, timeout, fetch_size, properties=properties)
    else:
        split = (split_column, row[0], row[1], tasks)
        options = read_options(url, query, timeout, fetch_size, split, properties)
    return spark.read.format("jdbc").options(**options).load()
