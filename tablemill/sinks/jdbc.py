"""Writing to a database over JDBC."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame

from tablemill.functions.names import require_columns, require_table_name
from tablemill.functions.types import jdbc_column_types
from tablemill.sources.jdbc import BATCH_SIZE, TIMEOUT_SECONDS


def write_options(
    df: DataFrame,
    url: str,
    table: str,
    truncate: bool = False,
    batch_size: int = BATCH_SIZE,
    timeout: int = TIMEOUT_SECONDS,
    properties: Mapping[str, str] | None = None,
) -> dict[str, str]:
    options = {
        "url": url,
        "dbtable": table,
        "batchsize": str(batch_size),
        "queryTimeout": str(timeout),
        **(properties or {}),
    }
    types = jdbc_column_types(df.schema)
    if types:
        options["createTableColumnTypes"] = types
    if truncate:
        options["truncate"] = "true"
    return options


def jdbc_write(
    df: DataFrame,
    url: str,
    table: str,
    truncate: bool = False,
    batch_size: int = BATCH_SIZE,
    timeout: int = TIMEOUT_SECONDS,
    connections: int | None = None,
    properties: Mapping[str, str] | None = None,
) -> None:
    """Append, or truncate and load. A missing table is created from the schema.

    Each task commits its own rows, so unlike a lake table a failed load can leave
    some of them; load a staging table when that matters. ``connections`` bounds
    the sessions the database sees at once.
    """
    require_table_name(table)
    require_columns(df.columns)
    # A shuffle, as merging partitions would slow all work before the write to so few tasks.
    out = df.repartition(connections) if connections else df
    options = write_options(df, url, table, truncate, batch_size, timeout, properties)
    out.write.format("jdbc").options(**options).mode("overwrite" if truncate else "append").save()
