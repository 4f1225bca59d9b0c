"""Merged profiles: exact parts against whole tables, sketches within their stated errors."""

import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from conftest import rows
from test_tables_and_transfer import scanned_rows
from tablemill.errors import RequestError
from tablemill.operators import profiles
from tablemill.plans import profiles as plans
from tablemill.plans.changes import delete_rows
from tablemill.plans.profiles import table_profile, update_profile
from tablemill.sinks import tables

EXACT = ["ordinal", "column_name", "n_rows", "n_null", "n_values", "longest", "least_number", "most_number", "least_text", "most_text"]


def sample(spark, n=40_000):
    return spark.range(n).selectExpr(
        "id",
        "CASE WHEN id % 7 > 0 THEN sqrt(id) END AS root",
        "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('w', id % 9000) END AS word",
        "date_add(DATE'2020-01-01', CAST(id % 500 AS INT)) AS day",
        "array(id) AS listed",
        "CAST(CASE WHEN id % 20 < 19 THEN id % 20 END AS INT) AS p",
    )


@pytest.fixture
def kept(spark, base, name):
    df = sample(spark)
    tables.create_table(spark, name, df.schema, base, ["p"])
    tables.append(tables.arranged(df, name), name)
    first = update_profile(spark, name, f"{name}_profile", base)
    assert (first.error, first.rows_read, first.rows_inserted) == (None, 40_000, 20)
    return name


def test_merged_equals_whole(spark, kept):
    table = spark.table(kept)
    got = table_profile(spark, kept, f"{kept}_profile")
    whole = profiles.described(profiles.column_sketches(table))
    assert rows(got.select(EXACT)) == rows(whole.select(EXACT))
    found = {r.column_name: r for r in got.collect()}
    assert (found["listed"].n_distinct, found["listed"].quantiles, found["listed"].n_values) == (0, None, 40_000)
    assert (found["day"].least_number, found["p"].n_null, found["word"].most_text) == (18262.0, 2000, "w998"), found["word"]
    for c in ("id", "root", "word", "day", "p"):
        values = [r[0] for r in table.select(c).collect() if r[0] is not None]
        distinct = len(set(values))
        assert abs(found[c].n_distinct - distinct) <= 4 * profiles.DISTINCT_ERROR * distinct + 1
        counts = Counter(str(v) for v in values)
        for item in found[c].frequent:
            assert abs(item["count"] - counts[item["item"]]) <= profiles.FREQUENT_ERROR * len(values)
    assert found["word"].frequent[0]["item"] == "hot"
    for c in ("id", "root"):
        values = sorted(r[0] for r in table.select(c).collect() if r[0] is not None)
        ranks = [sum(v <= q for v in values) / len(values) for q in found[c].quantiles]
        assert all(abs(a - b) <= profiles.RANK_ERROR + 1 / len(values) for a, b in zip(ranks, (0, 0.25, 0.5, 0.75, 1), strict=True))


def test_only_what_changed_is_read(spark, kept):
    profile = f"{kept}_profile"
    again = []
    found = scanned_rows(spark, lambda: again.append(update_profile(spark, kept, profile)))
    assert (again[0].rows_read, again[0].rows_inserted, again[0].rows_deleted) == (0, 0, 0) and found < 500
    extra = sample(spark, 400).withColumn("p", F.lit(77))
    tables.append(extra, kept)
    with pytest.raises(RequestError):
        table_profile(spark, kept, profile)
    found = scanned_rows(spark, lambda: again.append(update_profile(spark, kept, profile)))
    assert (again[1].rows_read, again[1].rows_inserted, again[1].rows_deleted) == (400, 1, 0) and found < 2000
    # A partition goes, the one of NULL is rewritten.
    assert delete_rows(spark, kept, F.expr("p = 3 OR (p IS NULL AND id < 1000)")).rows_deleted == 2050
    again.append(update_profile(spark, kept, profile))
    assert (again[2].error, again[2].rows_read, again[2].rows_inserted, again[2].rows_deleted) == (None, 1950, 1, 2)
    whole = profiles.column_sketches(spark.table(kept)).select(EXACT)
    assert rows(table_profile(spark, kept, profile).select(EXACT)) == rows(whole)


def test_an_append_reads_its_own_files(spark, kept):
    """a partition that grows is not profiled whole again."""
    profile = f"{kept}_profile"
    tables.append(sample(spark, 400).where("p IN (3, 4) OR p IS NULL"), kept)
    again = []
    found = scanned_rows(spark, lambda: again.append(update_profile(spark, kept, profile)))
    assert (again[0].error, again[0].rows_read, again[0].rows_inserted, again[0].rows_deleted) == (None, 60, 3, 0) and found < 2000
    whole = profiles.column_sketches(spark.table(kept)).select(EXACT)
    assert rows(table_profile(spark, kept, profile).select(EXACT)) == rows(whole)


def test_pieces_of_a_partition_are_few(spark, base, name, monkeypatch):
    """The fourth append reads its partition whole, and no file of the same name in another one."""
    monkeypatch.setattr(plans, "MOST_PIECES", 3)
    df = spark.range(100).selectExpr("id", "id % 2 AS p").coalesce(1)
    tables.create_table(spark, name, df.schema, base, ["p"])
    tables.append(df, name)
    files = [f.rpartition("/")[2] for f in spark.table(name).inputFiles()]
    assert len(files) == 2 and len(set(files)) == 1
    read = [update_profile(spark, name, f"{name}_profile", base)]
    for _ in range(4):
        tables.append(spark.range(10).selectExpr("id", "0L AS p").coalesce(1), name)
        read.append(update_profile(spark, name, f"{name}_profile"))
    assert [(r.rows_read, r.rows_inserted, r.rows_deleted) for r in read] == [(100, 2, 0), (10, 1, 0), (10, 1, 0), (80, 1, 3), (10, 1, 0)]
    whole = profiles.column_sketches(spark.table(name)).select(EXACT)
    assert rows(table_profile(spark, name, f"{name}_profile").select(EXACT)) == rows(whole)


def test_pieces_that_share_a_file_count_once():
    files = {("a",): ["f1", "f2", "f3"]}
    assert plans._current({"x": {"f1"}, "y": {"f1", "f2"}, "z": {"f3"}, "gone": {"f3", "f4"}}, files) == {"y", "z"}


def test_a_profile_without_files_is_refused(spark, kept):
    spark.table(f"{kept}_profile").drop("file").write.saveAsTable(f"{kept}_older", path=f"{tables.table_location(spark, kept)}_older")
    assert "drop it" in update_profile(spark, kept, f"{kept}_older").error


def test_tables_without_partitions_and_odd_values(spark, base, name):
    data = [(None, "é/=%", dt.datetime(2020, 1, 1), True, "x" * 200), (2, "", None, None, None), (2, "", None, None, None)]
    df = spark.createDataFrame(data, "a_b int, t string, at timestamp, yes boolean, long string")
    tables.create_table(spark, name, df.schema, base, ["t"])
    tables.append(df, name)
    assert update_profile(spark, name, f"{name}_profile", base).rows_inserted == 2
    found = {r.column_name: r for r in table_profile(spark, name, f"{name}_profile").collect()}
    assert (found["a_b"].n_rows, found["a_b"].n_null, found["a_b"].n_distinct) == (3, 1, 1)
    assert (found["long"].longest, found["long"].most_text, found["long"].n_distinct) == (200, "x" * profiles.CUT, 1)
    assert found["t"].n_null == 2 and found["t"].frequent[0]["item"] == "é/=%" and found["at"].quantiles == [1577836800.0] * 5

    tables.create_table(spark, f"{name}_2", df.schema, base)
    assert update_profile(spark, f"{name}_2", f"{name}_3", base).rows_read == 0
    assert table_profile(spark, f"{name}_2", f"{name}_3").collect() == []
    tables.append(df, f"{name}_2")
    assert update_profile(spark, f"{name}_2", f"{name}_3").rows_read == 3
    assert {r.n_rows for r in table_profile(spark, f"{name}_2", f"{name}_3").collect()} == {3}
    assert "no table" in update_profile(spark, f"{name}_4", f"{name}_3").error
