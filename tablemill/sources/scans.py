"""Query, document and record scans."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tablemill.errors import RequestError
from tablemill.operators.documents import (
    DocumentOptions,
    infer_document_schema,
    read_documents,
    variant_text,
)
from tablemill.operators.query import parameterized


def register_tables(spark: SparkSession, folder: str, names: Sequence[str]) -> None:
    """Make ``<folder>/<name>.parquet`` queryable by name."""
    for name in names:
        spark.read.parquet(f"{folder}/{name}.parquet").createOrReplaceTempView(name)


def query_scan(
    spark: SparkSession, source: str | DataFrame, params: Mapping[str, Any] | None = None
) -> DataFrame:
    """Rows and schema of a source query; a source without columns is an error."""
    df = parameterized(spark, source, params) if isinstance(source, str) else source
    if not df.columns:
        raise RequestError("No columns found in source query result")
    return df


def document_scan(spark: SparkSession, path: str, json_col: str = "doc") -> DataFrame:
    """JSON-lines files as one text column, one document per row."""
    return spark.read.text(path).select(F.col("value").alias(json_col))


def record_columns(df: DataFrame, json_col: str, ordinal: str) -> list[str]:
    """Keys of the record with the lowest ordinal, in its own order; empty without rows.

    Of several records with that ordinal it is the one whose text is smallest, so that runs agree.
    """
    first = df.agg(F.min_by(json_col, F.when(F.col(ordinal).isNotNull(), F.struct(ordinal, json_col))).alias("j"))
    row = first.select(F.json_object_keys("j").alias("k")).first()
    return list(row["k"] or [])


def record_scan(
    df: DataFrame,
    json_col: str,
    ordinal: str | None = None,
    schema: T.StructType | None = None,
) -> DataFrame:
    """Ragged JSON records as columns.

    The columns are the declared ``schema``, or the keys of the first record by
    ``ordinal``, typed over all records: nested values, and values whose type differs
    between records, are text. A missing key is NULL, an extra one is left out.
    """
    if schema is not None:
        return df.select(F.from_json(json_col, schema).alias("r")).select("r.*")
    if ordinal is None:
        raise RequestError("record_scan needs a schema or an ordinal column")
    names = record_columns(df, json_col, ordinal)
    if not names:
        return df.select().limit(0)
    seen = {f.name: f for f in infer_document_schema(df, json_col)}
    typed = T.StructType([seen[n] for n in names if n in seen])
    read = read_documents(df, json_col, typed, DocumentOptions(flatten=False))
    never_set = F.lit(None).cast("string")
    values = {
        f.name: variant_text(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, T.VariantType) else F.col(f"`{f.name}`")
        for f in read.schema
    }
    return read.select(*[values.get(n, never_set.alias(n)) for n in names])
