import datetime as dt
import json

import pytest
from pyspark.sql import Window, functions as F

from conftest import rows
from tablemill.metrics import RunResult
from tablemill.operators import ledger, requestlog as logs, slices

PATTERNS = [
    ("SELECT * FROM Users", None),
    ("INSERT INTO Users VALUES (1)", None),
    ("SELECT * FROM Users; DROP TABLE Users--", "--"),
    ("SELECT 1 /* comment */", "/*"),
    ("EXEC(SELECT 1)", "EXEC("),
    ("SELECT * FROM OPENROWSET(...)", "OPENROWSET"),
    ("drop table Users", "DROP "),
    ("TRUNCATE TABLE Users", "TRUNCATE "),
    ("WAITFOR DELAY '0:0:5'", "WAITFOR"),
    ("xp_cmdshell 'dir'", "xp_"),
    ("SELECT resp_time FROM t", "sp_"),
    ("  ", None),
    (None, None),
]


def test_sql_audit(spark):
    df = spark.createDataFrame([(i, q) for i, (q, _) in enumerate(PATTERNS)], "i int, q string")
    got = logs.sql_audit(df, "q").orderBy("i").collect()
    assert [r["sql_pattern"] for r in got] == [p for _, p in PATTERNS]
    assert [r["is_clean"] for r in got] == [p is None for _, p in PATTERNS]


def test_client_ip(spark):
    df = spark.createDataFrame(
        [
            ({"x-forwarded-FOR": " 1.1.1.1 , 2.2.2.2"}, "9.9.9.9"),
            ({"X-Forwarded-For": ""}, "9.9.9.9"),
            ({"a": "1", "A": "2"}, "9.9.9.9"),
            ({}, "9.9.9.9"),
            (None, None),
        ],
        "h map<string,string>, r string",
    )
    got = [r[0] for r in df.select(logs.client_ip(F.col("h"), F.col("r"))).collect()]
    assert got == ["1.1.1.1", "9.9.9.9", "9.9.9.9", "9.9.9.9", None]


@pytest.mark.parametrize(
    "code,expected",
    [(100, "other"), (199, "other"), (200, "2xx"), (299, "2xx"), (302, "3xx"), (404, "4xx"), (500, "5xx"), (700, "5xx"), (None, "other")],
)
def test_status_class(spark, code, expected):
    df = spark.createDataFrame([(code,)], "c int")
    assert df.select(logs.status_class(F.col("c"))).first()[0] == expected


def test_paths_headers_and_truncation(spark):
    df = spark.createDataFrame([("/API/HEALTH/live",), ("/swagger",), ("/api/x",), (None,)], "p string")
    assert [r[0] for r in df.select(logs.path_is_logged(F.col("p"))).collect()] == [
        False, False, True, True,
    ]
    one = spark.sql("SELECT map('COOKIE', 'a', 'set-cookie', 'b', 'Host', 'h') AS h, 'abcdef' AS t")
    got = one.select(logs.safe_headers(F.col("h")), logs.truncated(F.col("t"), 5), logs.truncated(F.col("t"), 6))
    assert tuple(got.first()) == ({"Host": "h"}, "abcde... [truncated]", "abcdef")


@pytest.mark.parametrize("n", [498, 499, 500, 501, 999, 1000, 1001, 1002, 3000])
@pytest.mark.parametrize("unit", ["x", "\r\n", "\r", "y\r\n"])
def test_line_body_is_cut_after_breaks_are_replaced(spark, n, unit):
    body = (unit * n)[:n]
    flat = body.replace("\r\n", " ").replace("\n", " ").replace("\r", " ")
    want = flat if len(flat) <= 500 else flat[:500] + "..."
    df = spark.createDataFrame([(body,)], "b string")
    assert df.select(logs._line_body(F.col("b"))).first()[0] == want


def test_scrub_masks_before_it_cuts(spark):
    body = '{"password":"hunter2","pad":"' + "x" * 12000 + '"}'
    df = spark.createDataFrame(
        [("/api/a", body, body, {"Cookie": "c", "X-Forwarded-For": "1.1.1.1"}, "9.9.9.9"),
         ("/swagger/x", body, None, None, None)],
        "path string, request_body string, response_body string, "
        "request_headers map<string,string>, client_ip string",
    )
    (row,) = logs.scrub(df).collect()
    assert "hunter2" not in row["request_body"] and "hunter2" not in row["response_body"]
    assert row["request_body"].endswith("... [truncated]") and len(row["request_body"]) == 10015
    assert row["request_headers"] == {"X-Forwarded-For": "1.1.1.1"}
    assert row["client_ip"] == "1.1.1.1"


def test_rolling_and_retention(spark, tmp_path):
    path = str(tmp_path / "log")
    df = spark.range(96).selectExpr(
        "id", "TIMESTAMP_NTZ'2024-01-01 00:30:00' + make_dt_interval(0, CAST(id AS INT)) AS timestamp"
    )
    logs.write_rolling(df, path, "Hourly", max_file_bytes=100)
    back = spark.read.parquet(path)
    assert back.select("log_date", "log_hour").distinct().count() == 96
    now = F.expr("TIMESTAMP_NTZ'2024-01-05 00:00:00'")
    kept = logs.retained(back, now, 2)
    assert kept.count() == 48
    text = kept._jdf.queryExecution().toString()
    assert "PartitionFilters: [(isnull(log_date" in text
    assert "Or(IsNull(timestamp),GreaterThanOrEqual(timestamp" in text
    assert logs.retained(back, now, 0).count() == 96


def test_hot_day_is_written_by_several_tasks(spark, tmp_path):
    path = str(tmp_path / "log")
    df = spark.range(0, 60000, 1, 8).selectExpr(
        "id", "sha2(CAST(id AS STRING), 256) AS request_body",
        "IF(id % 10 < 8, TIMESTAMP_NTZ'2024-01-01 00:00:00', TIMESTAMP_NTZ'2024-01-02 00:00:00') "
        "AS timestamp",
    )
    setting = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    spark.conf.set(setting, "300KB")
    try:
        logs.write_rolling(df, path)
    finally:
        spark.conf.unset(setting)
    back = spark.read.parquet(path)
    files = back.select("log_date", F.input_file_name().alias("f")).distinct()
    by_day = {str(r["log_date"]): r["count"] for r in files.groupBy("log_date").count().collect()}
    assert by_day["2024-01-01"] > 3 and back.count() == 60000


@pytest.mark.parametrize("limit", [1, 150, 1000, 100_000])
def test_no_file_above_its_limit(spark, tmp_path, limit):
    """Runs of large records make more files, not larger ones; a file is in the order of time."""
    path = str(tmp_path / "log")
    df = spark.range(0, 3000, 1, 5).selectExpr(
        "TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_dt_interval(0, 0, CAST((id * 7919) % 3000 AS INT)) AS timestamp",
        "CAST((id * 7919) % 3000 AS STRING) AS path",
        "CASE WHEN (id * 7919) % 3000 BETWEEN 500 AND 700 THEN repeat('x', 600) WHEN id % 500 = 0 THEN repeat('é', 2000) END AS request_body",
    )
    logs.write_rolling_lines(df, path, "json", "Hourly", max_file_bytes=limit)
    files, sizes, seen = list((tmp_path / "log").rglob("*.txt")), [], []
    for file in files:
        lines = file.read_text().splitlines()
        sizes.append(file.stat().st_size)
        assert sizes[-1] <= limit or len(lines) == 1
        order = [int(json.loads(line)["path"]) for line in lines]
        assert order == sorted(order)
        seen += order
    assert sorted(seen) == list(range(3000))
    if limit == 100_000:
        assert len(files) == 50  # one per hour


def test_partition_drop(spark, base, name):
    spark.sql(
        f"CREATE TABLE {name} (id int, log_date date) USING parquet PARTITIONED BY (log_date) "
        f"LOCATION '{base}/x'"
    )
    spark.sql(f"INSERT INTO {name} VALUES (1, DATE'2024-01-01'), (2, DATE'2024-02-01')")
    assert logs.drop_old_partitions(spark, name, dt.date(2024, 1, 15)) == 1
    assert logs.drop_old_partitions(spark, name, dt.date(2024, 1, 15)) == 0
    assert rows(spark.table(name).select("id")) == [(2,)]


def test_field_names(spark):
    texts = ['{"a b":1,"n":{"x-y":{"z":1},"ok":[{"not counted":1}]}}', '{"a b":2}', "{bad", "[1]", None]
    texts += ['{"x":' * 3000 + "1" + "}" * 3000, '{"\\ud800":1}']
    df = spark.createDataFrame([(t,) for t in texts], "js string")
    got = logs.field_name_audit(df, "js").select("field_name", "n_documents")
    found = [r for r in rows(got) if len(r[0]) < 100]
    assert found == [("?", 1), ("a b", 2), ("n_x-y_z", 1)]


def at(minute):
    return dt.datetime(2024, 1, 1, 0, minute)


EVENTS = [
    ("a", 1, at(0), "Pending"),
    ("a", 2, at(1), "Running"),
    ("a", 3, at(2), "Completed"),
    ("a", 4, at(3), "Running"),
    ("b", 5, at(0), "Running"),
    ("b", 6, at(0), "Failed"),
    ("c", 7, at(0), "Pending"),
    ("c", 8, at(1), "Cancelled"),
]
EVENT_COLUMNS = "run_id string, event_id int, ts timestamp_ntz, status string"


def test_current_state(spark):
    got = ledger.current_state(spark.createDataFrame(EVENTS, EVENT_COLUMNS))
    assert rows(got) == [
        ("a", "Running", at(0), at(3), at(2), 0, "Processing started", 4),
        ("b", "Failed", at(0), at(0), at(0), 0, "Failed", 2),
        ("c", "Cancelled", at(0), None, at(1), None, None, 2),
    ]


def test_progress_reports(spark):
    events = [
        ("a", 1, at(0), "Pending", None, None),
        ("a", 2, at(1), "Running", None, None),
        ("a", 3, at(2), None, 40, "reading"),
        ("a", 4, at(3), None, None, "still reading"),
    ]
    df = spark.createDataFrame(events, EVENT_COLUMNS + ", progress int, message string")
    got = ledger.current_state(df).select("status", "progress", "progress_message")
    assert rows(got) == [("Running", 40, "still reading")]
    assert ledger.illegal_transitions(df).count() == 0


def test_illegal_transitions(spark):
    got = ledger.illegal_transitions(spark.createDataFrame(EVENTS, EVENT_COLUMNS))
    assert rows(got.select("event_id", "previous_status", "status")) == [
        (4, "Completed", "Running"),
        (5, None, "Running"),
    ]


def test_previous_over_slices_equals_a_plain_lag(spark):
    """A key with a third of the rows is cut over slices; the result is that of one window."""
    df = spark.range(3000).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 0 ELSE id % 50 END AS k", "hash(id) AS o", "id", "id % 5 AS v"
    )
    got = slices.with_previous(df, "k", ["o", "id"], "v", "prev", slices=4)
    want = df.withColumn("prev", F.lag("v").over(Window.partitionBy("k").orderBy("o", "id")))
    assert rows(got) == rows(want)
    cut = slices.in_slices(df, ["k", "o", "id"], 4).where("k = 0")
    assert cut.select(slices.SLICE).distinct().count() > 1


def test_ties_are_cut_too(spark):
    df = spark.range(4000).selectExpr("id", "1 AS same")
    cut = slices.in_slices(df, ["same"], 4)
    assert cut.select(slices.SLICE).distinct().count() > 1
    ids = slices.dense_ids(df, "n", ["same"], slices=4)
    assert rows(ids.agg(F.min("n"), F.max("n"), F.countDistinct("n"))) == [(1, 4000, 4000)]


def test_reports(spark):
    df = spark.createDataFrame(
        [
            ("1", "Completed", at(0), at(0), at(1), '{"a": 1}'),
            ("2", "Running", at(1), at(0), None, None),
            ("3", "Failed", at(2), None, at(1), "not json"),
            ("4", "Pending", at(2), None, None, ""),
        ],
        "id string, status string, created_at timestamp_ntz, started_at timestamp_ntz, "
        "completed_at timestamp_ntz, result_payload string",
    )
    got = ledger.status_report(df).select("id", "is_finished", "duration_ms", "result")
    assert rows(got) == [
        ("1", True, 60000, '{"a":1}'),
        ("2", False, None, None),
        ("3", True, None, "not json"),
        ("4", False, None, None),
    ]
    assert [r["id"] for r in ledger.recent_runs(df, 3).collect()] == ["3", "4", "2"]
    assert [r["id"] for r in ledger.runs_by_status(df, "Failed").collect()] == ["3"]
    kept = ledger.retained_runs(df, F.lit(at(2)))
    assert rows(kept.select("id")) == [("2",), ("3",), ("4",)]
    plan = ledger.recent_runs(df, 3)._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan


def test_run_becomes_a_ledger_row(spark):
    start = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    good = ledger.ledger_row(spark, "DataSync", RunResult("t", rows_read=3), start)
    bad = ledger.ledger_row(spark, "DataSync", RunResult("t", error="boom"), start)
    both = good.unionAll(bad).select("status", "error_message", F.get_json_object("result_payload", "$.rows_read"))
    assert rows(both) == [("Completed", None, "3"), ("Failed", "boom", "0")]
