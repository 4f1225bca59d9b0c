import pytest
from pyspark.sql import functions as F

from conftest import rows
from tablemill.errors import RequestError
from tablemill.operators import sync as ops
from tablemill.plans.sync import SyncOptions, sync_table
from tablemill.sinks import tables

KV = "k int, v string"


def frame(spark, data, schema=KV):
    return spark.createDataFrame(data, schema)


CASES = [
    ("replace and add", [(1, "a"), (2, "b")], [(2, "B"), (3, "C")], [(1, "a"), (2, "B"), (3, "C")], 1),
    ("source duplicates", [(1, "a")], [(1, "x"), (1, "y")], [(1, "x"), (1, "y")], 1),
    ("target duplicates", [(1, "a"), (1, "b")], [(1, "x")], [(1, "x")], 2),
    ("null key", [(None, "a"), (1, "b")], [(None, "x"), (1, "y")], [(None, "a"), (None, "x"), (1, "y")], 1),
    ("empty source", [(1, "a")], [], [(1, "a")], 0),
    ("empty target", [], [(1, "a")], [(1, "a")], 0),
]


@pytest.mark.parametrize("label,target,source,expected,deleted", CASES, ids=[c[0] for c in CASES])
def test_delete_insert(spark, label, target, source, expected, deleted):
    t, s = frame(spark, target), frame(spark, source)
    assert rows(ops.delete_insert(t, s, ["k"])) == expected
    counts = ops.sync_counts(t, s, ["K"]).first()
    assert tuple(counts) == (len(source), deleted, len(source), len(expected))


@pytest.mark.parametrize("label,target,source,expected,deleted", CASES, ids=[c[0] for c in CASES])
def test_sync_table(spark, base, name, label, target, source, expected, deleted):
    t = frame(spark, target)
    tables.create_table(spark, name, t.schema, base)
    tables.append(t, name)
    result = sync_table(spark, frame(spark, source), name, ["k"])
    assert result.ok, result.error
    assert rows(spark.table(name)) == expected
    assert (result.rows_read, result.rows_deleted, result.rows_inserted) == (
        len(source),
        deleted,
        len(source),
    )


def test_full_refresh(spark, base, name):
    t = frame(spark, [(1, "a"), (2, "b")])
    tables.create_table(spark, name, t.schema, base)
    tables.append(t, name)
    everything = SyncOptions(delete_all_before_insert=True)
    empty = sync_table(spark, frame(spark, []), name, ["k"], everything)
    assert empty.ok and "The source has no rows, so the target stays as it is" in empty.warnings
    assert rows(spark.table(name)) == [(1, "a"), (2, "b")]
    full = sync_table(spark, frame(spark, [(3, "c")]), name, ["k"], everything)
    assert (full.rows_deleted, full.rows_inserted) == (2, 1)
    assert rows(spark.table(name)) == [(3, "c")]


def test_missing_and_extra_columns(spark):
    t = frame(spark, [(1, "a", 9)], "k int, v string, w int")
    s = frame(spark, [(2, "b")])
    assert rows(ops.delete_insert(t, s, ["k"])) == [(1, "a", 9), (2, "b", None)]
    extra = frame(spark, [(2, "b", 1, 1)], "k int, v string, w int, z int")
    with pytest.raises(RequestError, match="not in target: z"):
        ops.delete_insert(t, extra, ["k"])


def test_unknown_key(spark):
    t = frame(spark, [(1, "a")])
    with pytest.raises(RequestError, match="no key column 'q'"):
        ops.delete_insert(t, t, ["q"])


def test_mapped_key_ignores_case(spark):
    t = frame(spark, [(1, "a"), (2, "b")])
    s = frame(spark, [(2, "B")], "SourceId int, V string")
    assert rows(ops.delete_insert(t, s, ["sourceid"], {"SOURCEID": "k"})) == [(1, "a"), (2, "B")]


def test_collation(spark):
    t = frame(spark, [("A ", 1), ("b", 2)], "k string, v int")
    s = frame(spark, [("a", 9), ("A", 8)], "k string, v int")
    plain = ops.delete_insert(t, s, ["k"])
    assert plain.count() == 4
    loose = ops.delete_insert(t, s, ["k"], key_collation="UTF8_LCASE_RTRIM")
    assert rows(loose) == [("A", 8), ("a", 9), ("b", 2)]
    counts = ops.sync_counts(t, s, ["k"], key_collation="UTF8_LCASE_RTRIM").first()
    assert counts["rows_deleted"] == 1


def test_idempotent_on_table(spark, base, name):
    t = frame(spark, [(i, f"a{i}") for i in range(50)])
    s = frame(spark, [(i, f"b{i}") for i in range(30, 80)])
    tables.create_table(spark, name, t.schema, base)
    tables.append(t, name)
    sync_table(spark, s, name, ["k"])
    once = rows(spark.table(name))
    again = sync_table(spark, s, name, ["k"])
    assert rows(spark.table(name)) == once and len(once) == 80
    assert again.rows_deleted == again.rows_inserted == 50


def test_duplicate_unique_keys_abort(spark, base, name):
    t = frame(spark, [(1, "a")])
    tables.create_table(spark, name, t.schema, base)
    tables.append(t, name)
    result = sync_table(
        spark, frame(spark, [(2, "x"), (2, "y")]), name, ["k"], SyncOptions(unique_keys=True)
    )
    assert not result.ok and "duplicate keys" in result.error
    assert rows(spark.table(name)) == [(1, "a")]


def test_failed_write_changes_nothing(spark, base, name):
    t = frame(spark, [(1, "a")])
    tables.create_table(spark, name, t.schema, base)
    tables.append(t, name)
    boom = frame(spark, [(1, "x")]).withColumn("v", F.raise_error(F.lit("boom")).cast("string"))
    result = sync_table(spark, boom, name, ["k"])
    assert not result.ok and "boom" in result.error
    assert rows(spark.table(name)) == [(1, "a")]


def test_partitioned_target_rewrites_touched_partitions(spark, base, name):
    schema = "k int, v string, p string"
    t = frame(spark, [(1, "a", "x"), (2, "b", "y"), (3, "c", None), (4, "d", "z")], schema)
    tables.create_table(spark, name, t.schema, base, partition_by=["p"])
    tables.append(t, name)
    s = frame(spark, [(2, "B", "y"), (3, "C", None), (9, "n", "w")], schema)
    result = sync_table(spark, s, name, ["k", "p"])
    assert result.ok, result.error
    assert result.rows_deleted == 1
    assert any("only the partitions" in w for w in result.warnings)
    assert rows(spark.table(name)) == sorted(
        [(1, "a", "x"), (2, "B", "y"), (3, "c", None), (3, "C", None), (4, "d", "z"), (9, "n", "w")],
        key=lambda r: [(v is not None, str(v)) for v in r],
    )


def test_empty_text_and_null_share_a_partition(spark, base, name):
    """Empty text is stored as the NULL partition, whose other rows must stay."""
    schema = "k int, v string, p string"
    t = frame(spark, [(1, "a", None), (2, "b", "x")], schema)
    tables.create_table(spark, name, t.schema, base, partition_by=["p"])
    tables.append(t, name)
    for k in (3, 4):
        result = sync_table(spark, frame(spark, [(k, "n", "")], schema), name, ["k", "p"])
        assert result.ok, result.error
    left = [(1, "a", None), (3, "n", None), (4, "n", None)]
    assert [r for r in rows(spark.table(name)) if r[2] is None] == left
    tables.replace(frame(spark, [(9, "z", "")], schema), name)
    assert rows(spark.table(name)) == [(9, "z", None)]


@pytest.mark.parametrize("zone", ["UTC", "Asia/Tokyo"])
def test_time_partitions(spark, base, name, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        t = spark.sql(
            "SELECT 1 AS k, 'a' AS v, TIMESTAMP_NTZ'2024-01-01 00:00:00' AS p UNION ALL "
            "SELECT 2, 'b', TIMESTAMP_NTZ'2024-01-02 00:00:00'"
        )
        tables.create_table(spark, name, t.schema, base, partition_by=["p"])
        tables.append(t, name)
        result = sync_table(spark, t.where("k = 2").withColumn("v", F.lit("B")), name, ["p"])
        assert result.ok, result.error
        assert rows(spark.table(name).select("k", "v")) == [(1, "a"), (2, "B")]
        new = t.where("k = 2").withColumn("k", F.lit(5))
        assert sync_table(spark, new, name, ["k", "p"]).ok
        assert rows(spark.table(name).select("k", "v")) == [(1, "a"), (2, "B"), (5, "b")]
        tables.replace(new, name)
        assert rows(spark.table(name).select("k", "v")) == [(5, "b")]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def files_by_partition(spark, name):
    found = spark.table(name).select("p", F.input_file_name().alias("f")).distinct().collect()
    return {r["p"]: r["f"] for r in found}


def test_partitioned_target_without_partition_key(spark, base, name):
    """A row moves from one partition, which empties, to another; the others' files stay."""
    schema = "k int, v string, p string"
    t = frame(spark, [(1, "a", "x"), (2, "b", "y"), (3, "c", "z"), (4, "d", None)], schema)
    tables.create_table(spark, name, t.schema, base, partition_by=["p"])
    tables.append(t, name)
    before = files_by_partition(spark, name)
    result = sync_table(spark, frame(spark, [(2, "B", "x")], schema), name, ["k"])
    assert result.ok, result.error
    assert (result.rows_deleted, result.rows_inserted) == (1, 1)
    after = files_by_partition(spark, name)
    assert {p: f for p, f in after.items() if p != "x"} == {p: f for p, f in before.items() if p in ("z", None)}
    assert sorted(rows(spark.table(name).where("p IS NOT NULL"))) == [(1, "a", "x"), (2, "B", "x"), (3, "c", "z")]


def test_more_partitions_than_can_be_listed(spark, base, name):
    """Beyond any number of partitions a statement may name, untouched ones are left alone."""
    t = spark.range(700).selectExpr("CAST(id AS INT) AS k", "'old' AS v", "CAST(id AS STRING) AS p")
    tables.create_table(spark, name, t.schema, base, partition_by=["p"])
    tables.append(tables.arranged(t, name), name)
    before = files_by_partition(spark, name)
    source = t.where("k < 550").withColumn("v", F.lit("new"))
    result = sync_table(spark, source, name, ["k"])
    assert result.ok and result.rows_deleted == 550
    after = files_by_partition(spark, name)
    assert len(after) == 700
    assert {p for p in before if before[p] == after[p]} == {str(k) for k in range(550, 700)}
    assert spark.table(name).where("v = 'new'").count() == 550


def test_collated_partition_key(spark, base, name):
    schema = "k int, v string, p string"
    t = frame(spark, [(1, "a", "us"), (2, "b", "de")], schema)
    tables.create_table(spark, name, t.schema, base, partition_by=["p"])
    tables.append(t, name)
    result = sync_table(spark, frame(spark, [(1, "A", "US")], schema), name, ["p"], SyncOptions(key_collation="UTF8_LCASE"))
    assert result.ok and result.rows_deleted == 1
    assert rows(spark.table(name)) == [(1, "A", "US"), (2, "b", "de")]


def test_declared_unique_indexes_guard_the_sync(spark, base, name):
    t = frame(spark, [(1, "a")])
    tables.create_table(spark, name, t.schema, base)
    tables.append(t, name)
    fields = ("schema_name", "table_name", "index_name", "index_id", "is_primary_key", "is_unique", "column_name", "key_ordinal", "is_descending", "is_included")
    indexes = spark.createDataFrame(
        [("dbo", name, "PK", 1, True, True, "k", 1, False, False), ("dbo", name, "UX", 2, False, True, "v", 1, False, False)], list(fields)
    )
    for source in ([(2, "x"), (2, "y")], [(2, "x"), (3, "x")]):
        result = sync_table(spark, frame(spark, source), name, declared_indexes=indexes)
        assert not result.ok and "duplicate keys" in result.error
        assert rows(spark.table(name)) == [(1, "a")]
    only_keys = frame(spark, [(2, "x"), (3, "x")]).select("k")
    assert sync_table(spark, only_keys, name, declared_indexes=indexes).ok


def plan_of(df):
    return df._jdf.queryExecution().toString()


def test_plan_is_an_anti_join_with_pushdown(spark, tmp_path):
    path = str(tmp_path / "t")
    frame(spark, [(1, "a")]).write.parquet(path)
    t = spark.read.parquet(path)
    text = plan_of(ops.delete_insert(t, t.where("v > 'a'"), ["k"]))
    assert "LeftAnti" in text
    assert "IsNotNull(k)" in text and "GreaterThan(v,a)" in text
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_bounds_change_the_plan_not_the_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    data = [(i, f"n{i:03d}") for i in range(100)] + [(None, "n050"), (40, None), (45, "zzz")]
    frame(spark, data).write.parquet(path)
    t = spark.read.parquet(path)
    s = frame(spark, [(40, "n040"), (45, "n045"), (60, "n060"), (None, "n001"), (200, "n200")])
    bounds = ops.key_bounds(s, ["k", "v"])
    assert bounds == {"k": (40, 200), "v": ("n040", "n200")}
    for keys in (["k"], ["v"], ["k", "v"]):
        b = ops.key_bounds(s, keys)
        plain = ops.flagged_rows(t, s, keys)
        assert rows(ops.flagged_rows(t, s, keys, bounds=b)) == rows(plain)
        assert rows(ops.kept_rows(t, s, keys, bounds=b)) == rows(
            plain.where(f"{ops.MATCHED} IS NULL").drop(ops.MATCHED)
        )
        loose = ops.flagged_rows(t, s, keys, "UTF8_LCASE", b)
        assert rows(loose) == rows(ops.flagged_rows(t, s, keys, "UTF8_LCASE"))
    text = plan_of(ops.kept_rows(t, s, ["k"], bounds=ops.key_bounds(s, ["k"])))
    assert "GreaterThanOrEqual(k,40), LessThanOrEqual(k,200)" in text
    assert "Or(Or(IsNull(k),LessThan(k,40)),GreaterThan(k,200))" in text
    assert ops.key_bounds(frame(spark, [(None, "a")]), ["k"]) == {}
    assert ops.key_bounds(spark.sql("SELECT 1.5D AS k"), ["k"]) == {}


SMALL_SKEW = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100KB",
}


@pytest.fixture
def small_skew(spark):
    """Settings under which test-sized tables count as large and skewed."""
    before = {k: spark.conf.get(k, None) for k in SMALL_SKEW}
    for k, v in SMALL_SKEW.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.parametrize("form", ["delete_insert", "flagged_rows"])
def test_hot_target_key_is_split(spark, tmp_path, small_skew, form):
    """A third of the target on one key: AQE cuts its partition on the join's left side."""
    path = str(tmp_path / "t")
    hot = spark.range(90000).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).cast("int").alias("k"),
        F.sha2(F.col("id").cast("string"), 256).alias("v"),
    )
    hot.repartition(8).write.parquet(path)
    t = spark.read.parquet(path)
    s = spark.range(50000).select(F.col("id").cast("int").alias("k"), F.lit("s").alias("v"))
    out = getattr(ops, form)(t, s, ["k"])
    n = len(out.collect())
    assert "skew=true" in plan_of(out)
    kept = hot.where("k >= 50000").count()
    assert n == (kept + 50000 if form == "delete_insert" else 90000)


def test_hot_source_key_reaches_the_join_once(spark, tmp_path, small_skew):
    """A third of the source on one key: counts combine before the shuffle."""
    s = spark.range(90000).selectExpr("CAST(IF(id % 3 = 0, 7, id) AS INT) AS k", "'s' AS v")
    t = frame(spark, [(7, "a"), (-1, "b")])
    assert ops.flagged_rows(t, s, ["k"]).count() == 2
    text = plan_of(ops.kept_rows(t, s, ["k"]))
    assert "partial_count" in text


def test_bucketed_sync_deals_rows_once(spark, base, name):
    """Rows come out of the join gathered by bucket: no exchange but those of the target and the source's keys."""
    target = spark.range(400).selectExpr("IF(id % 50 = 0, NULL, id % 90) AS k", "id AS v")
    source = spark.range(60).selectExpr("IF(id % 20 = 0, NULL, id % 40) AS k", "-id AS v")
    tables.create_table(spark, name, target.schema, base, bucket_by=["k"], buckets=8)
    tables.append(tables.arranged(target, name), name)
    current, staged = spark.table(name), tables.bucketed(source, name).localCheckpoint()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with ops.joining_within(spark):
            flagged = ops.flagged_rows(current, staged, ["k"], within=tables.BUCKET)
            plan = flagged._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 2 and "SortMergeJoin" not in plan
        assert rows(flagged) == rows(ops.flagged_rows(current, staged, ["k"]).select(flagged.columns))
        expected = rows(ops.delete_insert(target, source, ["k"]))
        r = sync_table(spark, source, name, ["k"])
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert r.error is None and rows(tables.read(spark, name)) == expected
    assert r.rows_deleted == target.where("k < 40 AND k IN (SELECT id % 40 FROM range(60) WHERE id % 20 <> 0)").count()
    files = [f.rpartition("/")[0] for f in spark.table(name).inputFiles()]
    assert max(files.count(f) for f in files) <= 2
