"""Table and column inventory."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tablemill.functions.types import declared_type
from tablemill.operators.keys import primary_keys


COLUMN_FACTS = (
    "schema_name string, table_name string, ordinal int, column_name string, data_type string, "
    "max_length long, is_nullable boolean, is_primary_key boolean, is_identity boolean"
)


def table_inventory(tables: Mapping[str, DataFrame], schema_name: str = "dbo") -> DataFrame:
    """Schema, table and row count, in name order. A count reads file footers only."""
    if not tables:
        return SparkSession.active().createDataFrame([], "schema_name string, table_name string, row_count long")
    counts = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(schema_name).alias("schema_name"), F.lit(name).alias("table_name"), "row_count"
        )
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionAll, counts).orderBy("schema_name", "table_name")


def column_inventory(
    tables: Mapping[str, DataFrame],
    primary_keys: Mapping[str, Sequence[str]] | None = None,
    identities: Mapping[str, str] | None = None,
    schema_name: str = "dbo",
) -> DataFrame:
    """One row per column: declared type and length, nullable, key and identity flags.

    All of it is metadata: no table is read. ``column_profile`` looks at the values.
    """
    facts = []
    for name, df in tables.items():
        keys = {k.lower() for k in (primary_keys or {}).get(name, ())}
        identity = (identities or {}).get(name, "").lower()
        for ordinal, field in enumerate(df.schema, start=1):
            data_type = declared_type(field)
            length = re.search(r"char\((\d+)\)", data_type)
            own = field.name.lower()
            facts.append(
                (schema_name, name, ordinal, field.name, data_type, int(length[1]) if length else None,
                 field.nullable, own in keys, own == identity)
            )
    found = SparkSession.active().createDataFrame(facts, COLUMN_FACTS)
    return found.orderBy("schema_name", "table_name", "ordinal")


def column_profile(tables: Mapping[str, DataFrame], schema_name: str = "dbo") -> DataFrame:
    """One row per column: longest text and number of NULLs, from the values.

    Reads every column; each table is one aggregate of one row, turned into rows afterwards.
    """
    parts = []
    for name, df in tables.items():
        structs = [_column_facts(ordinal, field) for ordinal, field in enumerate(df.schema, start=1)]
        found = df.agg(F.expr(f"array({', '.join(structs)})").alias("c"))
        where = F.lit(schema_name).alias("schema_name"), F.lit(name).alias("table_name")
        parts.append(found.select(*where, F.inline("c")))
    return reduce(DataFrame.unionAll, parts).orderBy("schema_name", "table_name", "ordinal")


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _column_facts(ordinal: int, field: T.StructField) -> str:
    """SQL of one column's profile row: one expression to hand over, not one per value."""
    value = "`" + field.name.replace("`", "``") + "`"
    is_text = isinstance(field.dataType, T.StringType)
    longest = f"CAST(max(length({value})) AS BIGINT)" if is_text else "CAST(NULL AS BIGINT)"
    facts = {
        "ordinal": str(ordinal),
        "column_name": _text(field.name),
        "longest": longest,
        "n_null": f"count_if({value} IS NULL)",
    }
    return f"named_struct({', '.join(f'{_text(k)}, {v}' for k, v in facts.items())})"


def database_inventory(
    spark: SparkSession,
    database: str,
    include_columns: bool = True,
    declared_indexes: DataFrame | None = None,
    identities: Mapping[str, str] | None = None,
) -> tuple[DataFrame, DataFrame | None]:
    """(tables, columns) of a catalog database; keys come from its declared indexes."""
    names = [t.name for t in spark.catalog.listTables(database) if not t.isTemporary]
    tables = {n: spark.table(f"`{database}`.`{n}`") for n in names}
    found = table_inventory(tables, database)
    if not include_columns:
        return found, None
    keys = primary_keys(declared_indexes, database) if declared_indexes is not None else {}
    return found, column_inventory(tables, keys, identities, database)
