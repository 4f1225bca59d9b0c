import pytest
from pyspark.sql import functions as F, types as T

from conftest import rows
from tablemill.errors import RequestError
from tablemill.operators import mapping
from tablemill.plans.changes import delete_rows, insert_rows, update_rows
from tablemill.plans.sync import SyncOptions, sync_table
from tablemill.plans.transfer import TransferOptions, insert_records, transfer
from tablemill.operators.slices import dense_ids, with_previous
from tablemill.session import list_path, shared_dir, staged, work_scope
from tablemill.sinks import jdbc as jdbc_sink, tables
from tablemill.sources import jdbc as jdbc_source
from tablemill.sources.scans import record_scan


def users(spark, *data):
    return spark.createDataFrame(list(data), "Id int, Name string")


def test_mapping_projects_in_transfer_and_renames_in_sync(spark):
    df = users(spark, (1, "a"))
    assert mapping.project_mapped(df, {"id": "K"}).columns == ["K"]
    assert mapping.project_mapped(df, None).columns == ["Id", "Name"]
    assert mapping.rename_mapped(df, {"ID": "K"}).columns == ["K", "Name"]
    with pytest.raises(RequestError):
        mapping.project_mapped(df, {"nope": "x"})


def test_conform_casts_and_raises_on_overflow(spark):
    target = T.StructType.fromDDL("a tinyint, b string")
    assert mapping.conform(spark.sql("SELECT 1 AS A"), target).first() == (1, None)
    with pytest.raises(Exception, match="CAST_OVERFLOW|OVERFLOW"):
        mapping.conform(spark.sql("SELECT 1000 AS a"), target).collect()


def test_text_longer_than_declared_fails_the_load(spark, base, name):
    spark.sql(f"CREATE TABLE {name} (Id int, Name varchar(3)) USING parquet LOCATION '{base}/x'")
    assert transfer(spark, users(spark, (1, "abc"), (2, None)), name).ok
    for options in (TransferOptions(), TransferOptions(truncate=True)):
        result = transfer(spark, users(spark, (3, "abcd")), name, options)
        assert not result.ok and "too long" in result.error.lower()
    assert rows(spark.table(name)) == [(1, "abc"), (2, None)]
    assert list_path(spark, f"{base}/x-snapshots") == []


def test_create_append_truncate(spark, base, name):
    options = TransferOptions(create_if_missing=True, base=base)
    first = transfer(spark, users(spark, (1, "a"), (2, None)), name, options)
    assert (first.ok, first.rows_read, first.rows_written) == (True, 2, 2)
    transfer(spark, users(spark, (3, "c")), name, options)
    assert rows(spark.table(name)) == [(1, "a"), (2, None), (3, "c")]
    transfer(spark, users(spark, (9, "z")), name, TransferOptions(truncate=True))
    assert rows(spark.table(name)) == [(9, "z")]
    emptied = transfer(spark, users(spark), name, TransferOptions(truncate=True))
    assert emptied.ok and spark.table(name).count() == 0


def test_created_with_mapped_names(spark, base, name):
    options = TransferOptions({"Id": "TargetId"}, create_if_missing=True, base=base)
    assert transfer(spark, users(spark, (1, "a")), name, options).ok
    assert spark.table(name).columns == ["TargetId"]


def test_table_can_load_from_itself(spark, base, name):
    transfer(spark, users(spark, (1, "a"), (2, "b")), name, TransferOptions(create_if_missing=True, base=base))
    again = spark.table(name).where("Id > 1")
    assert transfer(spark, again, name, TransferOptions(truncate=True)).ok
    assert rows(spark.table(name)) == [(2, "b")]


def test_refusals_are_values(spark, base, name):
    df = users(spark, (1, "a"))
    assert "Invalid table name" in transfer(spark, df, "a;b").error
    assert "not found" in transfer(spark, df, name).error
    twice = df.select("Id", F.col("Id").alias("ID"))
    assert "Duplicate column name" in transfer(spark, twice, name).error
    odd = df.select(F.col("Id").alias("bad name"))
    options = TransferOptions(create_if_missing=True, base=base)
    assert "Invalid column name" in transfer(spark, odd, name, options).error
    assert transfer(spark, "SELECT * FROM no_such_table_here", name).error


def test_files_hold_at_most_the_batch(spark, base, name):
    options = TransferOptions(create_if_missing=True, base=base, max_records_per_file=30)
    df = spark.range(100).coalesce(1)
    assert transfer(spark, df, name, options).ok
    sizes = spark.table(name).groupBy(F.input_file_name()).count().collect()
    assert sorted(r["count"] for r in sizes) == [10, 30, 30, 30]
    assert spark.conf.get("spark.sql.files.maxRecordsPerFile") == "0"


def test_old_snapshots(spark, base, name):
    """Replaced snapshots stay for running readers; other tables' folders are left alone."""
    options = TransferOptions(create_if_missing=True, base=base)
    transfer(spark, users(spark, (7, "other")), f"{name}_other", options)
    transfer(spark, users(spark, (1, "a")), name, options)
    early = spark.table(name)
    for i in range(3):
        transfer(spark, users(spark, (i, "b")), name, TransferOptions(truncate=True))
    assert rows(early) == [(1, "a")]
    folder = tables.table_location(spark, name).rpartition("/")[0]
    assert len(list_path(spark, folder)) == 4
    assert len(tables.remove_old_snapshots(spark, name, older_than=0)) == 3
    assert rows(spark.table(name)) == [(2, "b")]
    assert rows(spark.table(f"{name}_other")) == [(7, "other")]


def test_table_made_elsewhere(spark, base, name):
    spark.sql(f"CREATE TABLE {name} (Id int, Name string) USING parquet LOCATION '{base}/x'")
    transfer(spark, users(spark, (1, "a"), (2, "b")), name)
    again = spark.table(name).where("Id = 2")
    assert transfer(spark, again, name, TransferOptions(truncate=True)).ok
    assert rows(spark.table(name)) == [(2, "b")]


def test_partitioned_table_keeps_partitions_on_append_and_replace(spark, base, name):
    df = spark.createDataFrame([(1, "x"), (2, "y")], "k int, p string")
    options = TransferOptions(create_if_missing=True, base=base, partition_by=["p"])
    assert transfer(spark, df, name, options).ok
    assert tables.partition_columns(spark, name) == ["p"]
    transfer(spark, df.where("k = 1"), name)
    assert spark.table(name).count() == 3
    transfer(spark, df.where("k = 2"), name, TransferOptions(truncate=True))
    assert rows(spark.table(name)) == [(2, "y")]


def test_partitions_without_new_rows_go(spark, base, name):
    data = [(1, "it's", 1), (2, None, 1), (3, "a b", 2), (4, "z", 2), (5, "z", 3)]
    df = spark.createDataFrame(data, "k int, p string, q int")
    options = TransferOptions(create_if_missing=True, base=base, partition_by=["p", "q"])
    assert transfer(spark, df, name, options).ok
    change = spark.createDataFrame([(9, "z", 2)], "k int, p string, q int")
    result = transfer(spark, change, name, TransferOptions(truncate=True))
    assert result.ok, result.error
    assert rows(spark.table(name)) == [(9, "z", 2)]
    assert len(spark.sql(f"SHOW PARTITIONS {name}").collect()) == 1
    assert transfer(spark, change.where("k < 0"), name, TransferOptions(truncate=True)).ok
    assert spark.table(name).count() == 0


def test_row_changes(spark, base, name):
    df = spark.createDataFrame([(1, 5), (2, None), (3, 50)], "k int, n int")
    transfer(spark, df, name, TransferOptions(create_if_missing=True, base=base))
    up = update_rows(spark, name, {"n": F.col("n") + 1}, F.col("n") < 10)
    assert (up.rows_read, up.rows_written) == (3, 1)
    gone = delete_rows(spark, name, F.col("n") > 10)
    assert gone.rows_deleted == 1
    more = insert_rows(spark, name, spark.sql("SELECT 7 AS k"))
    assert more.rows_inserted == 1
    assert rows(spark.table(name)) == [(1, 6), (2, None), (7, None)]
    bad = update_rows(spark, name, {"zz": F.lit(1)}, F.lit(True))
    assert "Unknown columns: zz" in bad.error


def test_row_changes_rewrite_only_affected_partitions(spark, base, name):
    data = [(1, "a", 5), (2, "a", 50), (3, "b", 50), (4, None, 50), (5, "c", None)]
    df = spark.createDataFrame(data, "k int, p string, n int")
    options = TransferOptions(create_if_missing=True, base=base, partition_by=["p"])
    assert transfer(spark, df, name, options).ok

    def files(p):
        found = spark.table(name).where(F.col("p") == p).select(F.input_file_name()).distinct()
        return {r[0] for r in found.collect()}

    kept = files("c")
    gone = delete_rows(spark, name, F.col("n") > 10)
    assert gone.ok, gone.error
    assert (gone.rows_read, gone.rows_deleted) == (4, 3)
    assert rows(spark.table(name).select("k", "p", "n")) == [(1, "a", 5), (5, "c", None)]
    assert files("c") == kept
    up = update_rows(spark, name, {"n": F.lit(6)}, F.col("p") == "a")
    assert up.ok and up.rows_written == 1 and files("c") == kept
    nothing = delete_rows(spark, name, F.col("k") > 100)
    assert nothing.ok and nothing.rows_deleted == 0
    moved = update_rows(spark, name, {"p": F.lit("c")}, F.col("k") == 1)
    assert moved.ok, moved.error
    assert rows(spark.table(name).select("k", "p", "n")) == [(1, "c", 6), (5, "c", None)]


RECORDS = ['{"Id":1,"Name":"a"}', '{"Id":2}', '{"Id":3,"Name":"c","X":9}']


def test_ragged_records(spark, base, name):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(RECORDS)], "i int, js string")
    got = record_scan(df, "js", "i")
    assert got.columns == ["Id", "Name"]
    assert rows(got) == [(1, "a"), (2, None), (3, "c")]
    options = TransferOptions(create_if_missing=True, base=base)
    result = insert_records(df, "js", name, "i", options=options)
    assert result.ok and result.rows_written == 3
    nothing = insert_records(df.where("i > 9"), "js", name, "i", options=options)
    assert nothing.ok and nothing.rows_written == 0
    assert spark.table(name).count() == 3


def test_null_and_fill_columns_of_first_record(spark):
    df = spark.createDataFrame([(0, '{"b":null,"a":1}'), (1, '{"b":"x"}')], "i int, js string")
    got = record_scan(df, "js", "i")
    assert got.columns == ["b", "a"] and rows(got) == [(None, 1), ("x", None)]


def test_record_values_of_several_kinds(spark):
    texts = ['{"m":1,"n":{"x": 1},"l":[1, 2],"d":1.5,"bad name":1}', '{"m":"x","d":2}']
    df = spark.createDataFrame(list(enumerate(texts)), "i int, js string")
    got = record_scan(df, "js", "i")
    assert got.dtypes == [
        ("m", "string"), ("n", "string"), ("l", "string"), ("d", "decimal(21,1)"), ("bad name", "bigint"),
    ]
    assert rows(got) == [("1", '{"x":1}', "[1,2]", 1.5, 1), ("x", None, None, 2.0, None)]


def test_sync_refuses_odd_names(spark, base, name):
    transfer(spark, users(spark, (1, "a")), name, TransferOptions(create_if_missing=True, base=base))
    odd = spark.sql("SELECT 1 AS Id, 2 AS `bad name`")
    assert "Invalid column name" in sync_table(spark, odd, name, ["Id"]).error


# No database is started here, so the JDBC parts are checked by their options.


def test_jdbc_read_options():
    plain = jdbc_source.read_options("jdbc:x", "SELECT 1", timeout=9, fetch_size=5)
    assert plain == {"url": "jdbc:x", "queryTimeout": "9", "fetchsize": "5", "query": "SELECT 1"}
    split = jdbc_source.read_options("jdbc:x", "SELECT 1", split=("id", 0, 99, 8))
    assert split["dbtable"] == "(SELECT 1) q" and "query" not in split
    assert (split["partitionColumn"], split["lowerBound"], split["upperBound"]) == ("id", "0", "99")
    assert split["numPartitions"] == "8"


def test_jdbc_write_options(spark, base, name):
    spark.sql(f"CREATE TABLE {name} (c varchar(9)) USING parquet LOCATION '{base}/x'")
    df = spark.table(name)
    options = jdbc_sink.write_options(df, "jdbc:x", "t", truncate=True, batch_size=10)
    assert options["truncate"] == "true" and options["batchsize"] == "10"
    assert options["createTableColumnTypes"] == "`c` VARCHAR(9)"
    with pytest.raises(RequestError):
        jdbc_sink.jdbc_write(df, "jdbc:x", "t; drop")


def test_change_leaves_other_partitions_alone(spark, base, name):
    df = spark.range(40).selectExpr("CAST(id AS INT) AS k", "CAST(id AS INT) % 4 AS p")
    options = TransferOptions(create_if_missing=True, base=base, partition_by=["p"])
    assert transfer(spark, df, name, options).ok

    def files():
        found = spark.table(name).select("p", F.input_file_name().alias("f")).distinct().collect()
        return {(r["p"], r["f"]) for r in found}

    before = files()
    gone = delete_rows(spark, name, F.col("p").isin(1) | (F.col("k") == 2))
    assert gone.ok and gone.rows_deleted == 11
    kept = {x for x in before if x[0] in (0, 3)}
    assert kept <= files() and {p for p, _ in files()} == {0, 2, 3}
    changed = update_rows(spark, name, {"k": F.lit(-1)}, F.col("k") == 3)
    assert changed.ok and changed.rows_written == 1
    assert {x for x in before if x[0] == 0} <= files()
    assert delete_rows(spark, name, F.col("k") == 12345).rows_deleted == 0


def test_a_scope_leaves_no_working_data(spark):
    df = spark.createDataFrame([(1, 10, "a"), (1, 20, "b"), (2, 5, "c")], "k int, t int, v string")
    with work_scope(spark) as path:
        with work_scope(spark) as inner:
            assert staged(df).count() == 3 and list_path(spark, inner)
        assert list_path(spark, inner) == []
        assert dense_ids(df, "Id", ["t"]).count() == 3
        steps = with_previous(df, "k", ["t"], "v", "before").collect()
        assert sorted((r["v"], r["before"]) for r in steps) == [("a", None), ("b", "a"), ("c", None)]
        assert list_path(spark, path)
    assert list_path(spark, path) == []
    assert all("scope-" not in p for p, _ in list_path(spark, f"{shared_dir(spark)}/tablemill"))


def by_files(df):
    """Rows in each file of a frame."""
    found = df.groupBy(F.input_file_name().alias("file")).count()
    return {r.file: r["count"] for r in found.collect()}


def scanned_rows(spark, action):
    """Rows that file scans put out while ``action`` runs, by Spark's own count of input records."""
    store = spark.sparkContext._jsc.sc().statusStore()
    jvm = spark.sparkContext._jvm

    def total():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        stages = store.stageList(jvm.java.util.ArrayList(), False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return sum(stages.apply(k).inputRecords() for k in range(stages.size()))

    before = total()
    action()
    return total() - before


@pytest.fixture
def parted(spark, base, name):
    """A table of 300 partitions by date and 40 rows each, one partition of NULL."""
    df = spark.range(12_000).select(
        F.col("id").alias("k"),
        F.when(F.col("id") % 300 != 7, F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") % 300).cast("int"))).alias("day"),
        (F.col("id") * 2).alias("v"),
    )
    assert transfer(spark, df, name, TransferOptions(create_if_missing=True, base=base, partition_by=["day"])).ok
    return name


def test_a_scope_prunes_partitions(spark, parted):
    table = spark.table(parted)
    scope = table.where("k in (3, 7)").select("day").distinct()
    path = f"{tables._folder(spark, parted)}/scope"
    scope.write.parquet(path)
    scope = spark.read.parquet(path)
    got = []
    found = scanned_rows(spark, lambda: got.extend(tables.in_partitions(table, scope, ["day"]).select("k", "v").collect()))
    assert sorted(r.k for r in got) == sorted(k for k in range(12_000) if k % 300 in (3, 7))
    assert found <= 80 + 3 * 2
    assert table.where(F.col("day").isNull()).count() == 40


def test_a_change_reads_what_it_touches(spark, parted):
    update = lambda: results.append(update_rows(spark, parted, {"v": F.lit(-1)}, F.expr("k in (3, 307, 7)")))
    results = []
    found = scanned_rows(spark, update)
    assert results[0].rows_written == 3 and results[0].rows_read == 80, results
    # One narrow pass over the table finds the partitions; two are read again.
    assert found <= 12_000 + 80 + 20
    assert spark.table(parted).where("v = -1").count() == 3 and spark.table(parted).count() == 12_000


def test_a_frame_opened_before_a_sync_is_read_after_it(spark, parted):
    before = spark.table(parted)
    want = rows(before)
    source = spark.createDataFrame([(3, 0), (7, 0), (11, 0)], "k long, v long").withColumn("day", F.lit(None).cast("date"))
    assert sync_table(spark, source, parted, ["k"]).ok
    assert rows(before) == want
    after = spark.table(parted)
    assert after.count() == 12_000 and after.where("day is null").count() == 42
    # Replaced folders go by age; none that the table is in.
    assert not tables.remove_old_snapshots(spark, parted)
    assert len(tables.remove_old_snapshots(spark, parted, older_than=-10)) == 3
    assert rows(spark.table(parted)) == rows(after) and after.count() == 12_000


def test_a_dropped_partition_comes_back_empty(spark, parted):
    assert delete_rows(spark, parted, F.expr("k % 300 = 5")).rows_deleted == 40
    assert len(spark.sql(f"SHOW PARTITIONS {parted}").collect()) == 299
    again = spark.createDataFrame([(5, "2020-01-06", 1)], "k long, day string, v long")
    assert insert_rows(spark, parted, again).ok
    assert [r.k for r in spark.table(parted).where("day = '2020-01-06'").collect()] == [5]


def test_rows_a_file_of_partitioned_tables(spark, base, name):
    df = spark.range(6000).select(F.col("id").alias("k"), (F.col("id") % 3).cast("int").alias("p"))
    assert transfer(spark, df, name, TransferOptions(create_if_missing=True, base=base, partition_by=["p"])).ok
    source = df.where("k % 2 = 0")
    assert sync_table(spark, source, name, ["k"], SyncOptions(max_records_per_file=100)).ok
    assert max(by_files(spark.table(name)).values()) <= 100
    assert transfer(spark, df, name, TransferOptions(truncate=True, max_records_per_file=500)).ok
    assert max(by_files(spark.table(name)).values()) <= 500 and spark.table(name).count() == 6000


def test_one_row_rewrites_one_bucket(spark, base, name):
    df = spark.range(4000).select(F.col("id").alias("k"), F.concat(F.lit("n"), "id").alias("t"))
    tables.create_table(spark, name, df.schema, base, bucket_by=["K"], buckets=16)
    assert insert_rows(spark, name, df).ok
    assert tables.read(spark, name).columns == ["k", "t"]
    before = by_files(spark.table(name))
    results = []
    source = spark.createDataFrame([(17, "new")], "k long, t string")
    found = scanned_rows(spark, lambda: results.append(sync_table(spark, source, name, ["k"])))
    assert results[0].ok and results[0].rows_deleted == 1, results
    after = by_files(spark.table(name))
    assert len(before.keys() - after.keys()) == 1 and sum(after.values()) == 4000
    # The source alone tells the bucket, which is read for keys in the source's range and for others.
    assert found < 4000 / 16 * 3
    assert sorted(rows(tables.read(spark, name).where("k = 17"))) == [(17, "new")]
    # A key that moves takes its row to another bucket; NULL keys have one too.
    assert update_rows(spark, name, {"k": F.lit(5000)}, F.expr("k = 18")).rows_written == 1
    assert sync_table(spark, spark.createDataFrame([(5000, "x"), (None, "y")], "k long, t string"), name, ["k"]).rows_deleted == 1
    assert delete_rows(spark, name, F.expr("k < 3900")).rows_deleted == 3899
    left = tables.read(spark, name)
    assert left.count() == 102 and left.where("k is null").count() == 1
    assert transfer(spark, df.limit(10), name, TransferOptions(truncate=True)).ok
    assert rows(tables.read(spark, name)) == rows(df.limit(10))


@pytest.fixture
def looked_up(spark, base, name):
    """40 partitions of 2500 rows whose keys are in no order, with Bloom filters of the keys."""
    df = spark.range(100_000).selectExpr("xxhash64(id) AS k", "id AS v", "cast(id % 40 AS int) AS p")
    assert tables.create_table(spark, name, df.schema, base, ["p"], lookup_by=["K"])
    tables.append(tables.arranged(df, name), name)
    return name


def few_keys(spark):
    """100 keys, all in the partitions 3 and 11; they move to partition 5."""
    return spark.range(100_000).where("id % 40 IN (3, 11) AND id < 2000").selectExpr("xxhash64(id) AS k", "-1L AS v", "5 AS p")


def test_few_keys_are_looked_up(spark, looked_up):
    assert tables.lookup_columns(spark, looked_up) == ["k"]
    source = staged(few_keys(spark))
    results = []
    sync = lambda: results.append(sync_table(spark, source, looked_up, ["k"]))
    found = scanned_rows(spark, sync)
    assert results[0].ok and (results[0].rows_read, results[0].rows_deleted) == (100, 100), results
    # Two partitions by their filters, and one that a filter takes for a hit in vain, at most; then
    # the three that change, for the rows in and out of the source's key range; the source a few times.
    assert found <= 3 * 2500 + 2 * 3 * 2500 + 1000
    # Rewritten files have filters as well.
    found = scanned_rows(spark, lambda: results.append(sync_table(spark, source, looked_up, ["k"])))
    assert results[1].rows_deleted == 100 and found <= 2600 + 2500 + 2 * 2600 + 1000
    after = spark.table(looked_up)
    assert after.count() == 100_000 and after.where("v = -1 AND p = 5").count() == 100
    assert after.where("p = 3").count() == 2450 and spark.conf.get("spark.sql.parquet.pushdown.inFilterThreshold") == "10"


def test_changes_by_key_are_looked_up(spark, looked_up):
    keys = [r.k for r in few_keys(spark).limit(20).collect()]
    results = []
    found = scanned_rows(spark, lambda: results.append(delete_rows(spark, looked_up, F.col("k").isin(keys))))
    assert results[0].rows_deleted == 20 and results[0].rows_read in (2500, 5000)
    assert found <= 3 * 2500 + 5000 + 100
    assert spark.table(looked_up).count() == 100_000 - 20


@pytest.mark.parametrize("most", [2, 500])
def test_lookups_with_null_text_and_many_keys(spark, base, name, monkeypatch, most):
    monkeypatch.setattr(tables, "LOOKUP_VALUES", most)
    df = spark.createDataFrame([("a", 1, 1), ("b ", 2, 1), (None, 3, 2), ("", 4, 2), ("C", 5, 3)], "k string, v int, p int")
    assert tables.create_table(spark, name, df.schema, base, ["p"], lookup_by=["k", "v"])
    tables.append(df, name)
    source = spark.createDataFrame([("a", 0, 9), (None, 0, 9), ("", 0, 9), ("c", 0, 9)], "k string, v int, p int")
    assert sync_table(spark, source, name, ["k"]).rows_deleted == 2
    assert rows(spark.table(name).where("p < 9")) == rows(df.where("v IN (2, 3, 5)"))
    assert sync_table(spark, source, name, ["k"], SyncOptions(key_collation="UTF8_LCASE")).rows_deleted == 4
    assert rows(spark.table(name).where("p < 9")) == rows(df.where("v IN (2, 3)"))
    only_nulls = spark.createDataFrame([(None, 8, 9)], "k string, v int, p int")
    assert sync_table(spark, only_nulls, name, ["k"]).rows_deleted == 0
    with pytest.raises(RequestError):
        tables.create_table(spark, f"{name}_2", df.schema, base, ["p"], lookup_by=["P"])


def test_the_first_of_several_records_with_one_ordinal_does_not_depend_on_their_order(spark):
    texts = [(1, '{"b":1}'), (1, '{"a":1}'), (2, '{"c":1}'), (None, '{"d":1}')]
    for some in (texts, texts[::-1]):
        df = spark.createDataFrame(some, "i int, js string").coalesce(1)
        assert record_scan(df, "js", "i").columns == ["a"]
