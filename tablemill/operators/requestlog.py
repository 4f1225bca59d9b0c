"""Scrubbing, shaping and keeping request logs.

A log table has the columns ``id, timestamp, http_method, path, query_string,
request_body, request_headers, status_code, response_body, response_time_ms,
client_ip, user_agent, error_message, stack_trace``; operators touch those they name.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from datetime import date
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from tablemill.errors import RequestError
from tablemill.functions.masking import mask_json
from tablemill.functions.names import COLUMN_MESSAGE, IDENTIFIER, MAX_NAME_LENGTH, quoted
from tablemill.operators.slices import PLACE, SLICE, in_slices
from tablemill.session import delete_path, work_path

# Headers never logged, paths not logged, body limits and marks,
# days kept and file size before a roll.
SENSITIVE_HEADERS = (
    "Authorization",
    "Cookie",
    "Set-Cookie",
    "X-API-Key",
    "Api-Key",
    "X-Auth-Token",
)
EXCLUDED_PATHS = ("/api/health", "/swagger")
MAX_BODY_LENGTH = 10000
BODY_MARK = "... [truncated]"
MAX_LINE_BODY_LENGTH = 500
LINE_MARK = "..."
RETENTION_DAYS = 30
MAX_FILE_BYTES = 100 * 1024 * 1024

# SQL patterns looked for, in order of precedence.
SQL_PATTERNS = (
    "--",
    ";--",
    "/*",
    "*/",
    "xp_",
    "sp_",
    "EXEC(",
    "EXECUTE(",
    "DROP ",
    "TRUNCATE ",
    "ALTER ",
    "CREATE ",
    "GRANT ",
    "REVOKE ",
    "DENY ",
    "SHUTDOWN",
    "WAITFOR",
    "OPENROWSET",
    "OPENDATASOURCE",
    "BULK INSERT",
    "INTO OUTFILE",
    "LOAD_FILE",
)


# --- columns ------------------------------------------------------------------


def safe_headers(headers: Column) -> Column:
    """A header map without the sensitive names, whatever their case."""
    hidden = [h.lower() for h in SENSITIVE_HEADERS]
    return F.map_filter(headers, lambda name, _: ~F.lower(name).isin(hidden))


def path_is_logged(path: Column, excluded: Sequence[str] = EXCLUDED_PATHS) -> Column:
    """FALSE for paths that start with an excluded prefix, whatever its case."""
    lowered = F.lower(F.coalesce(path, F.lit("")))
    hit = reduce(lambda a, b: a | b, [lowered.startswith(p.lower()) for p in excluded], F.lit(False))
    return ~hit


def truncated(text: Column, limit: int = MAX_BODY_LENGTH, mark: str = BODY_MARK) -> Column:
    """The first ``limit`` characters and a mark, for longer text."""
    # Not when/otherwise: outside a branch, a costly text is computed once for both uses.
    tail = F.when(F.length(text) > limit, mark).otherwise("")
    return F.concat(F.substring(text, 1, limit), tail)


def client_ip(headers: Column, remote_address: Column) -> Column:
    """First address of X-Forwarded-For, else the remote address."""
    forwarded = F.map_filter(headers, lambda name, _: F.lower(name) == "x-forwarded-for")
    return client_ip_of(F.get(F.map_values(forwarded), F.lit(0)), remote_address)


def client_ip_of(forwarded: Column, remote_address: Column) -> Column:
    has_one = F.coalesce(forwarded, F.lit("")) != ""
    return F.when(has_one, F.trim(F.split_part(forwarded, F.lit(","), F.lit(1)))).otherwise(remote_address)


def status_class(status: Column) -> Column:
    return (
        F.when((status >= 200) & (status < 300), "2xx")
        .when((status >= 300) & (status < 400), "3xx")
        .when((status >= 400) & (status < 500), "4xx")
        .when(status >= 500, "5xx")
        .otherwise("other")
    )


def _filled(text: Column) -> Column:
    return F.coalesce(text, F.lit("")) != ""


def _line_body(body: Column) -> Column:
    # A line break is at most two characters and becomes one, so these are enough
    # to give the line's characters and to tell that there are more.
    line = F.substring(body, 1, 2 * MAX_LINE_BODY_LENGTH + 1)
    for line_break in ("\r\n", "\n", "\r"):
        line = F.replace(line, F.lit(line_break), F.lit(" "))
    return truncated(line, MAX_LINE_BODY_LENGTH, LINE_MARK)


def text_line(df: DataFrame) -> Column:
    """One text line per record; empty parts are left out."""

    def part(label: str, name: str, shown: Column) -> Column:
        head = F.when(_filled(df[name]), label).otherwise("")
        return F.concat(head, F.coalesce(shown, F.lit("")))

    def shown(name: str) -> Column:
        return F.coalesce(df[name].cast("string"), F.lit(""))

    return F.concat(
        F.lit("["),
        F.coalesce(F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSS"), F.lit("")),
        F.lit("] ["),
        shown("id"),
        F.lit("] "),
        shown("http_method"),
        F.lit(" "),
        shown("path"),
        part("?", "query_string", df["query_string"]),
        F.lit(" -> "),
        shown("status_code"),
        F.lit(" ("),
        shown("response_time_ms"),
        F.lit("ms) | IP: "),
        shown("client_ip"),
        part(" | Body: ", "request_body", _line_body(df["request_body"])),
        part(" | ERROR: ", "error_message", df["error_message"]),
    )


def _camel(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(word.capitalize() for word in rest)


def json_line(df: DataFrame) -> Column:
    """One JSON object per record, camelCase names, NULLs left out."""
    return F.to_json(F.struct(*[F.col(c).alias(_camel(c)) for c in df.columns]))


# --- whole log ------------------------------------------------------------------


def scrub(
    logs: DataFrame,
    excluded: Sequence[str] = EXCLUDED_PATHS,
    max_body: int = MAX_BODY_LENGTH,
    strict: bool = False,
) -> DataFrame:
    """A log with excluded paths left out, headers and bodies made safe.

    Bodies are masked first and cut second: a cut body is no JSON any more and
    would keep its secrets.
    """
    out = logs.where(path_is_logged(F.col("path"), excluded))
    changes = {}
    for body in ("request_body", "response_body"):
        if body in logs.columns:
            changes[body] = truncated(mask_json(F.col(body), strict), max_body)
    if "request_headers" in logs.columns:
        changes["request_headers"] = safe_headers(F.col("request_headers"))
        if "client_ip" in logs.columns:
            changes["client_ip"] = client_ip(F.col("request_headers"), F.col("client_ip"))
    return out.withColumns(changes)


def with_roll_columns(df: DataFrame, interval: str = "Daily", at: str = "timestamp") -> DataFrame:
    """``log_date`` and, for hourly rolls, ``log_hour``: the file set a record goes to."""
    out = df.withColumn("log_date", F.to_date(at))
    return out.withColumn("log_hour", F.hour(at)) if interval == "Hourly" else out


def roll_columns(interval: str = "Daily") -> list[str]:
    return ["log_date", "log_hour"] if interval == "Hourly" else ["log_date"]


_BYTES = "__bytes"
ROLL = "roll"


def _numbered(sliced: DataFrame, folders: Sequence[str], max_file_bytes: int) -> DataFrame:
    """``sliced`` with ROLL, the file of a record, in the order of time within a slice of a folder.

    A record above half the limit is a file of its own. The others are cut where their running
    size passes a multiple of the limit less the largest of them, so no file gets above the limit.
    """
    small = F.col(_BYTES) * 2 <= max_file_bytes
    largest = sliced.where(small).agg(F.max(_BYTES)).first()[0] or 0
    in_time = Window.partitionBy(*folders, SLICE).orderBy(PLACE)
    share = F.when(small, F.col(_BYTES)).otherwise(0)
    before = F.sum(share).over(in_time) - share
    # Windows of one order follow each other without a further shuffle or sort.
    cut = sliced.withColumn("__cut", F.when(small, F.floor(before / F.lit(max_file_bytes - largest))))
    opens = F.col("__cut").isNull() | ~F.equal_null("__cut", F.lag("__cut").over(in_time))
    marked = cut.withColumn("__opens", opens.cast("bigint"))
    return marked.withColumn(ROLL, F.sum("__opens").over(in_time) + F.col(SLICE).cast("bigint") * 10**9)


def _write_rolled(
    logs: DataFrame, size: Column, columns: Sequence[str], form: str, path: str, interval: str, max_file_bytes: int, mode: str
) -> None:
    """``columns`` of the log, in a folder per day or hour and file, ``size`` telling a record's bytes.

    Records are sorted by time over slices, so a day that holds much of the log is written by many
    tasks; a file lies within a slice, in the order of time.
    """
    if max_file_bytes < 1:
        raise RequestError("A file needs at least one byte")
    spark, folders = logs.sparkSession, roll_columns(interval)
    sized = with_roll_columns(logs.withColumn(_BYTES, size.cast("bigint")), interval)
    slices_path = work_path(spark, "log-slices")
    try:
        sliced = in_slices(sized, [*folders, "timestamp"], path=slices_path)
        numbered = _numbered(sliced, folders, max_file_bytes)
        kept = list(dict.fromkeys([*columns, *folders]))
        out = numbered.select(*kept, ROLL, PLACE).sortWithinPartitions(*folders, ROLL, PLACE).drop(PLACE)
        getattr(out.write.mode(mode).partitionBy(*folders, ROLL), form)(path)
    finally:
        delete_path(spark, slices_path)


def write_rolling(
    logs: DataFrame,
    path: str,
    interval: str = "Daily",
    max_file_bytes: int = MAX_FILE_BYTES,
    record_bytes: Column | None = None,
    mode: str = "append",
) -> None:
    """One folder per day or hour, and in it one per file of up to ``max_file_bytes``.

    A record's size is that of its JSON line, or ``record_bytes``. Parquet packs records, so files
    come out smaller than that. Only a record larger than the limit makes a larger file.
    """
    size = F.octet_length(json_line(logs)) if record_bytes is None else record_bytes
    _write_rolled(logs, size, logs.columns, "parquet", path, interval, max_file_bytes, mode)


def write_rolling_lines(
    logs: DataFrame,
    path: str,
    form: str = "text",
    interval: str = "Daily",
    max_file_bytes: int = MAX_FILE_BYTES,
    mode: str = "append",
) -> None:
    """The log as lines of text, or of JSON with ``form="json"``, in folders per day or hour and file.

    No file gets above ``max_file_bytes`` but by a single line that does.
    """
    lines = {"text": text_line, "json": json_line}
    if form not in lines:
        raise RequestError(f"Unknown line form: '{form}'")
    out = logs.select(F.col("timestamp"), lines[form](logs).alias("line"))
    _write_rolled(out, F.octet_length("line") + 1, ["line"], "text", path, interval, max_file_bytes, mode)


def retained(
    logs: DataFrame, as_of: Column, days: int = RETENTION_DAYS, at: str = "timestamp"
) -> DataFrame:
    """Records no older than ``days`` before ``as_of``; 0 days keeps all.

    Records without a time are kept. On a rolled log the day test prunes folders
    and the exact test trims the first; both are plain enough to reach the scan.
    """
    if days <= 0:
        return logs
    cutoff = as_of - F.make_dt_interval(F.lit(days))
    out = logs.where(F.col(at).isNull() | (F.col(at) >= cutoff))
    if "log_date" in logs.columns:
        day = F.col("log_date")
        out = out.where(day.isNull() | (day >= F.to_date(cutoff)))
    return out


_DAYS_A_STATEMENT = 500


def drop_old_partitions(spark: SparkSession, table: str, before: date) -> int:
    """Drop a rolled log table's days before a date: catalog work, no rewrite."""
    listed = spark.sql(f"SHOW PARTITIONS {quoted(table)}").collect()
    days = {part.split("/")[0].partition("=")[2] for (part,) in listed}
    old = sorted(d for d in days if d < before.isoformat())
    for at in range(0, len(old), _DAYS_A_STATEMENT):
        parts = ", ".join(f"PARTITION (log_date = DATE '{d}')" for d in old[at : at + _DAYS_A_STATEMENT])
        spark.sql(f"ALTER TABLE {quoted(table)} DROP IF EXISTS {parts}")
    return len(old)


# --- audits -----------------------------------------------------------------------


def first_sql_pattern(sql: Column) -> Column:
    """First listed pattern found in a query text; NULL when clean.

    An audit value, not a gate: it is a substring test and flags ``resp_time`` too.
    """
    upper = F.upper(sql)
    hits = [F.when(F.contains(upper, F.lit(p.upper())), F.lit(p)) for p in SQL_PATTERNS]
    return F.coalesce(*hits)


def sql_audit(df: DataFrame, sql_col: str) -> DataFrame:
    pattern = first_sql_pattern(F.col(sql_col))
    return df.withColumn("sql_pattern", pattern).withColumn("is_clean", F.col("sql_pattern").isNull())


# A name in a shape's text, quoted or bare, before its colon; or what ends or opens a level.
_SHAPE = re.compile(r"`((?:[^`]|``)*)`:|([^\s<>,:`]+):|(OBJECT<)|(<)|(>)")


def shape_names(shape: str | None, separator: str = "_") -> list[str]:
    """Flattened names of the leaves of a document's shape; none if it is no object."""
    if shape is None or not shape.startswith("OBJECT<"):
        return []
    found, path, levels = set(), [], []
    name, leaf = "", False
    for quoted_name, bare, opens, other, closes in _SHAPE.findall(shape):
        if quoted_name or bare or not (opens or other or closes):
            if leaf:
                found.add(separator.join([*path, name]))
            name, leaf = quoted_name.replace("``", "`") or bare, all(levels)
        elif opens:
            # Objects inside an array are no fields of the document.
            if levels and all(levels):
                path.append(name)
                leaf = False
            levels.append(all(levels))
        elif other:
            levels.append(False)
        else:
            if leaf and all(levels):
                found.add(separator.join([*path, name]))
                leaf = False
            if levels.pop() and len(levels) and all(levels) and path:
                path.pop()
    return sorted(found)


def field_name_audit(df: DataFrame, json_col: str, separator: str = "_") -> DataFrame:
    """Field names that break the column rule: how many documents have each, and why.

    Names are a property of a document's shape. Documents are counted by shape, before the
    shuffle, and only the different shapes are taken apart.
    """
    shape = F.schema_of_variant(F.try_parse_json(F.col(json_col))).alias("shape")
    shapes = df.select(shape).where("shape IS NOT NULL").groupBy("shape").agg(F.count(F.lit(1)).alias("n"))
    valid, longest = re.compile(IDENTIFIER), MAX_NAME_LENGTH

    def is_bad(name: str) -> bool:
        return len(name) > longest or valid.fullmatch(name) is None

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def bad_names(values: pd.Series) -> pd.Series:
        return values.map(lambda v: [n for n in shape_names(v, separator) if is_bad(n)])

    found = shapes.select(F.explode(bad_names(F.col("shape"))).alias("field_name"), "n")
    counts = found.groupBy("field_name").agg(F.sum("n").alias("n_documents"))
    head, tail = COLUMN_MESSAGE.split("%s")
    return counts.withColumn("message", F.concat(F.lit(head), "field_name", F.lit(tail)))
