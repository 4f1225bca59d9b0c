import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from conftest import rows
from tablemill.sinks import tables
from tablemill.streaming.streams import file_stream, stream_scrub, stream_sync, stream_transfer

KV = "k int, v string"


def put(spark, data, path):
    spark.createDataFrame(data, KV).coalesce(1).write.mode("append").parquet(path)


def test_transfer_takes_each_file_once(spark, tmp_path):
    source, sink, state = (str(tmp_path / p) for p in ("in", "out", "state"))
    put(spark, [(1, "a")], source)
    schema = spark.read.parquet(source).schema

    def go():
        stream = file_stream(spark, source, schema)
        stream_transfer(stream, sink, state, {"k": "id"}).awaitTermination()
        return rows(spark.read.parquet(sink))

    assert go() == [(1,)]
    put(spark, [(2, "b")], source)
    assert go() == [(1,), (2,)]
    assert go() == [(1,), (2,)]


def test_sync_by_batch_and_replay(spark, tmp_path, base, name):
    source, state = str(tmp_path / "in"), str(tmp_path / "state")
    target = spark.createDataFrame([(1, "a"), (None, "n")], KV)
    tables.create_table(spark, name, target.schema, base)
    tables.append(target, name)
    put(spark, [(1, "x"), (None, "m"), (2, "y")], source)
    schema = spark.read.parquet(source).schema
    seen = []

    def go(checkpoint):
        stream = file_stream(spark, source, schema)
        stream_sync(
            stream, name, ["k"], checkpoint, "s", on_result=lambda b, r: seen.append((b, r.rows_deleted))
        ).awaitTermination()
        return rows(spark.table(name))

    expected = [(None, "m"), (None, "n"), (1, "x"), (2, "y")]
    assert go(state) == expected
    # The same batch again, as after a crash between publish and commit: a new
    # checkpoint makes the stream repeat batch 0, whose NULL key must not be added twice.
    assert go(str(tmp_path / "lost")) == expected
    assert seen == [(0, 1)]
    put(spark, [(2, "z")], source)
    assert go(state) == [(None, "m"), (None, "n"), (1, "x"), (2, "z")]


def test_sync_into_touched_partitions(spark, tmp_path, base, name):
    source = str(tmp_path / "in")
    target = spark.createDataFrame([(1, "a"), (2, "b")], KV)
    tables.create_table(spark, name, target.schema, base, partition_by=["v"])
    tables.append(target, name)
    put(spark, [(1, "a"), (1, "a"), (3, "c")], source)
    stream = file_stream(spark, source, spark.read.parquet(source).schema)
    for checkpoint in ("one", "lost"):
        stream_sync(stream, name, ["k", "v"], str(tmp_path / checkpoint), "s").awaitTermination()
        assert rows(spark.table(name)) == [(1, "a"), (1, "a"), (2, "b"), (3, "c")]
    put(spark, [(None, "a")], source)
    stream_sync(stream, name, ["k", "v"], str(tmp_path / "one"), "s").awaitTermination()
    assert rows(spark.table(name)) == [(None, "a"), (1, "a"), (1, "a"), (2, "b"), (3, "c")]


@pytest.mark.parametrize("switched", [0, 1, 2, 3])
def test_a_batch_broken_off_between_partitions(spark, tmp_path, base, name, monkeypatch, switched):
    """The replay ends the switch that had begun; rows with NULL keys come once, partitions that empty go."""
    source, state = str(tmp_path / "in"), str(tmp_path / "state")
    target = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "d")], KV)
    tables.create_table(spark, name, target.schema, base, partition_by=["v"])
    tables.append(target, name)
    # Key 4 moves, so its old partition empties.
    put(spark, [(None, "a"), (None, "b"), (1, "b"), (4, "c")], source)
    stream = file_stream(spark, source, spark.read.parquet(source).schema)
    point = tables._point

    def broken(spark, name, columns, folders):
        point(spark, name, columns, dict(list(folders.items())[:switched]))
        raise OSError("the driver is lost")

    monkeypatch.setattr(tables, "_point", broken)
    with pytest.raises(StreamingQueryException):
        stream_sync(stream, name, ["k"], state, "s").awaitTermination()
    monkeypatch.setattr(tables, "_point", point)
    expected = [(None, "a"), (None, "b"), (1, "b"), (2, "b"), (3, "c"), (4, "c")]
    for checkpoint in (state, str(tmp_path / "lost")):
        stream_sync(stream, name, ["k"], checkpoint, "s").awaitTermination()
        assert rows(spark.table(name)) == expected
    assert spark.sql(f"SHOW PARTITIONS {name}").count() == 3
    assert not spark.sql(f"SHOW TBLPROPERTIES {name}").where("key = 'tablemill.switch'").count()


def test_scrub(spark, tmp_path):
    source, sink, state = (str(tmp_path / p) for p in ("in", "out", "state"))
    df = spark.sql(
        "SELECT TIMESTAMP_NTZ'2024-01-01 10:00:00' AS timestamp, '/api/x' AS path, "
        "'{\"token\":\"t\"}' AS request_body UNION ALL "
        "SELECT TIMESTAMP_NTZ'2024-01-01 11:00:00', '/swagger', '{}'"
    )
    df.write.parquet(source)
    stream = file_stream(spark, source, spark.read.parquet(source).schema)
    stream_scrub(stream, sink, state, "Hourly").awaitTermination()
    got = spark.read.parquet(sink).select("request_body", F.col("log_date").cast("string"), "log_hour")
    assert rows(got) == [('{"token":"*** MASKED ***"}', "2024-01-01", 10)]
