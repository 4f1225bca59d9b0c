"""Parameterized, scalar and stored queries, and row changes."""

from __future__ import annotations

import re
from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tablemill.errors import RequestError
from tablemill.functions.names import quoted, require_table_name

# Text in quotes or backticks, or an @name marker.
_MARKER = re.compile(r"""'(?:[^']|'')*'|"(?:[^"]|"")*"|`[^`]*`|@([A-Za-z_]\w*)""")


def parameterized(
    spark: SparkSession, query: str, params: Mapping[str, Any] | None = None
) -> DataFrame:
    """Run a query with named parameters, marked ``:name`` or ``@name``.

    Parameter names may carry the ``@`` too. None is SQL NULL.
    """
    args = {name.removeprefix("@"): value for name, value in (params or {}).items()}

    def marker(m: re.Match) -> str:
        return f":{m.group(1)}" if m.group(1) in args else m.group(0)

    df = spark.sql(_MARKER.sub(marker, query), args=args) if args else spark.sql(query)
    if not df.columns:
        raise RequestError("No columns found in source query result")
    return df


def scalar(
    spark: SparkSession,
    query: str,
    params: Mapping[str, Any] | None = None,
    data_type: str | T.DataType | None = None,
) -> DataFrame:
    """First column of the first row as a one-row frame; NULL when there is no row."""
    df = parameterized(spark, query, params)
    value = F.col(f"`{df.columns[0]}`")
    value = value.cast(data_type) if data_type else value
    return df.limit(1).agg(F.first(value).alias("value"))


def scalar_value(spark, query, params=None, data_type=None, default: Any = None) -> Any:
    """The scalar itself; ``default`` for NULL or no row."""
    value = scalar(spark, query, params, data_type).first()["value"]
    return default if value is None else value


def define_stored_query(
    spark: SparkSession, name: str, parameters: str, returns: str, body: str
) -> None:
    """Name a parameterized query for the session, as a SQL table function."""
    require_table_name(name)
    spark.sql(
        f"CREATE OR REPLACE TEMPORARY FUNCTION {quoted(name)}({parameters}) "
        f"RETURNS TABLE({returns}) RETURN {body}"
    )


def stored_query(
    spark: SparkSession, name: str, params: Mapping[str, Any] | None = None
) -> DataFrame:
    """Rows of a stored query, its parameters passed by name."""
    require_table_name(name)
    args = {n.removeprefix("@"): v for n, v in (params or {}).items()}
    call = ", ".join(f"{n} => :{n}" for n in args)
    return spark.sql(f"SELECT * FROM {quoted(name)}({call})", args=args)


def inserted(table: DataFrame, rows: DataFrame) -> DataFrame:
    """The table with rows added; columns the rows lack are NULL."""
    from tablemill.operators.mapping import conform

    return table.unionByName(conform(rows, table.schema))


def updated(table: DataFrame, assignments: Mapping[str, Column], where: Column) -> DataFrame:
    """The table with columns set where the predicate is TRUE (not where it is NULL)."""
    types = {f.name: f.dataType for f in table.schema}
    unknown = set(assignments) - set(types)
    if unknown:
        raise RequestError(f"Unknown columns: {', '.join(sorted(unknown))}")
    return table.select(
        *[
            F.when(where, assignments[c].cast(types[c])).otherwise(F.col(c)).alias(c)
            if c in assignments
            else F.col(c)
            for c in table.columns
        ]
    )


def deleted(table: DataFrame, where: Column) -> DataFrame:
    """The table without the rows for which the predicate is TRUE. NULL keeps the row."""
    return table.where(~F.coalesce(where, F.lit(False)))
