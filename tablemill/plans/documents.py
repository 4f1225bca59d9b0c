"""Load JSON documents into a flat table or a raw-JSON table."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tablemill.errors import RequestError
from tablemill.functions.names import require_table_name
from tablemill.metrics import RunResult, counted, run
from tablemill.operators import documents as docs
from tablemill.operators.mapping import conform
from tablemill.operators.pipelines import (
    VariantFields,
    apply_pipeline,
    array_paths,
    deciding_stages,
    document_predicate,
    keeps_documents,
    makes_groups,
    split_leading_matches,
)
from tablemill.operators.slices import dense_ids
from tablemill.session import delete_path, work_path
from tablemill.sinks import tables

FAILED = "__failed"
NOT_A_DOCUMENT = "no JSON document"
NOT_CONVERTED = "a value that doesn't convert"
NO_DOCUMENTS = "No document matches"


@dataclass(frozen=True)
class LoadOptions:
    truncate: bool = False
    create_if_missing: bool = True
    base: str | None = None
    max_records_per_file: int | None = None
    rejected_path: str | None = None
    run_id: str | None = None


def _without_not_null(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema])


def load_documents(
    documents: DataFrame,
    json_col: str,
    target: str,
    document_options: docs.DocumentOptions = docs.DocumentOptions(),
    options: LoadOptions = LoadOptions(),
    filter: Mapping[str, Any] | None = None,
    pipeline: Sequence[Mapping[str, Any]] | None = None,
    schema: T.StructType | None = None,
) -> RunResult:
    """Flatten documents into a table.

    A pipeline beats a filter. Filters and leading ``$match`` stages are tested
    on the parsed document, so fields are inferred from matching documents only.
    Bad documents are counted and don't stop the load. With ``rejected_path`` their text and the
    reason go to a folder of this run (``options.run_id``) under it, once the load is done: those
    that are no document, and, unless the pipeline merges, cuts or multiplies documents, those with
    a value that doesn't convert. No document at all leaves the target as it is, even when truncating.
    """
    spark = documents.sparkSession

    def body(result: RunResult) -> None:
        require_table_name(target)
        staged_path = work_path(spark, "documents")
        try:
            _load(result, staged_path)
        finally:
            delete_path(spark, staged_path)

    def _load(result: RunResult, staged_path: str) -> None:
        filters, stages = split_leading_matches(pipeline) if pipeline else ([filter or {}], [])
        tests = [document_predicate(VariantFields(docs.DOC), f) for f in filters if f]
        matches = reduce(lambda a, b: a & b, tests, F.col(docs.DOC).isNotNull())
        one_to_one = keeps_documents(stages)
        keep_id = makes_groups(stages) and not document_options.drop_group_id
        reading = replace(document_options, array_fields=array_paths(stages))
        # Parsed once, counted between parsing and the filter, and kept: fields, the first row and
        # all rows are read from what is written here.
        parsed, seen = counted(docs.parsed(documents, json_col), good=F.count(docs.DOC))
        parsed.where(matches).select(docs.DOC).write.parquet(staged_path)
        bad = seen.get["rows"] - seen.get["good"]
        matching = spark.read.schema(T.StructType([T.StructField(docs.DOC, T.VariantType())])).parquet(staged_path)
        fields = schema or docs.schema_of_parsed(matching)
        read_in = docs.read_documents(matching, docs.DOC, fields, reading)

        if apply_pipeline(read_in, deciding_stages(stages)).isEmpty():
            result.rows_read = result.rows_failed = bad
            result.warn(NO_DOCUMENTS)
            return
        rows = apply_pipeline(read_in, stages)
        plan = docs.flatten_plan(rows, document_options, keep_id)
        result.warnings += [f"Field name clash: '{n}'" for n in docs.case_clashes(fields)] + plan.warnings
        if not plan.columns:
            result.warn("The documents have no field that can be a column")
            return
        unconverted = F.lit(False) if plan.failed is None else F.coalesce(plan.failed, F.lit(False))
        picked, written = counted(
            rows.select(*plan.columns, unconverted.alias(FAILED)), failed=F.count_if(FAILED)
        )
        _write(spark, picked.where(~F.col(FAILED)).drop(FAILED), target, options, result)
        unconverted_rows = written.get["failed"]
        result.rows_failed = bad + unconverted_rows
        result.rows_written = written.get["rows"] - unconverted_rows
        result.rows_read = result.rows_written + result.rows_failed
        if options.rejected_path:
            read = docs.read_documents(
                docs.only_parsed(documents, json_col).where(matches), json_col, fields, reading, [json_col]
            )
            if not one_to_one:
                read = read.limit(0)
            else:
                read = apply_pipeline(read, [s for s in stages if "$match" in s])
            _write_rejected(documents, json_col, read, document_options, options)

    return run(target, body)


def _write_rejected(
    documents: DataFrame,
    json_col: str,
    read: DataFrame,
    document_options: docs.DocumentOptions,
    options: LoadOptions,
) -> None:
    """(text, reason) of the documents a load left out, in place of an earlier try of the run."""
    text = F.col(json_col).alias("text")
    broken = docs.rejected_documents(documents, json_col).select(text, F.lit(NOT_A_DOCUMENT).alias("reason"))
    failed = docs.flatten_plan(read.drop(json_col), document_options).failed
    if failed is not None:
        broken = broken.unionAll(read.where(failed).select(text, F.lit(NOT_CONVERTED).alias("reason")))
    broken.write.mode("overwrite").parquet(f"{options.rejected_path}/run={options.run_id or uuid.uuid4().hex}")


def _ensure(
    spark: SparkSession, target: str, schema: T.StructType, options: LoadOptions, result: RunResult
) -> None:
    if options.create_if_missing:
        if options.base is None and not tables.table_exists(spark, target):
            raise RequestError("A table to create needs a base folder")
        tables.create_table(
            spark, target, _without_not_null(schema), options.base, keep_not_null=False
        )
        result.warn(f"Table '{target}' is there")
    if not tables.table_exists(spark, target):
        raise RequestError(f"Table '{target}' not found")


def _write(
    spark: SparkSession, out: DataFrame, target: str, options: LoadOptions, result: RunResult
) -> None:
    _ensure(spark, target, out.schema, options, result)
    ready = conform(out, tables.read(spark, target).schema)
    if options.truncate:
        tables.replace(ready, target, max_records_per_file=options.max_records_per_file)
        result.warn(f"The old rows of {target} are gone")
    else:
        tables.append(ready, target, options.max_records_per_file)


def raw_json_rows(
    documents: DataFrame,
    json_col: str,
    order_by: Sequence[str | Column] = (),
    start: int = 1,
    path: str | None = None,
) -> DataFrame:
    """``Id, JsonData, CreatedAt``: one row per good document, ids dense from ``start``."""
    good = docs.good_documents(documents, json_col)
    numbered = dense_ids(good, "Id", order_by, start, keep=[json_col], path=path)
    return numbered.select(
        "Id",
        F.col(json_col).alias("JsonData"),
        F.current_timestamp().alias("CreatedAt"),
    )


def load_raw_json(
    documents: DataFrame,
    json_col: str,
    target: str,
    options: LoadOptions = LoadOptions(),
    order_by: Sequence[str | Column] = (),
) -> RunResult:
    """Load documents as JSON text, into ``<target>_JSON``, which is created if missing."""
    spark = documents.sparkSession
    name = docs.json_table_name(target)

    def body(result: RunResult) -> None:
        require_table_name(name)
        start = 1
        if tables.table_exists(spark, name) and not options.truncate:
            start += spark.table(name).agg(F.max("Id")).first()[0] or 0
        path = work_path(spark, "raw-json")
        try:
            out = raw_json_rows(documents, json_col, order_by, start, path)
            good = out.count()
            total = documents.count()
            result.rows_read, result.rows_failed = total, total - good
            if good == 0:
                result.warn(NO_DOCUMENTS)
                return
            always = LoadOptions(options.truncate, True, options.base, options.max_records_per_file)
            _write(spark, out, name, always, result)
            result.rows_written = good
        finally:
            delete_path(spark, path)

    return run(name, body)
