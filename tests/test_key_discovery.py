"""Key discovery: against all sets of columns counted one by one."""

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from tablemill.operators import keys
from tablemill.operators.keys import discovered_keys


def plain(rows, names, most=3):
    keys = []
    for size in range(1, most + 1):
        for s in combinations(range(len(names)), size):
            values = [tuple(r[i] for i in s) for r in rows]
            whole = all(v is not None for t in values for v in t) and len(set(values)) == len(rows)
            if whole and not any(set(k) <= set(s) for k in keys):
                keys.append(s)
    return sorted([names[i] for i in k] for k in keys) if rows else []


@pytest.mark.parametrize("seed", range(4))
def test_minimal_keys(spark, seed):
    draw = random.Random(seed)
    rows = list({(i // 20, i % 20, draw.randint(0, 40), draw.choice("abc"), draw.randint(0, 400)) for i in range(380)})
    rows = [(*r, k if seed % 2 else (k or None), "x") for k, r in enumerate(rows)]
    names = ["a", "b", "c", "d", "e", "f", "g"]
    df = spark.createDataFrame(rows, "a int, b int, c int, d string, e int, f int, g string")
    assert sorted(discovered_keys(df)) == plain(rows, names)
    assert sorted(discovered_keys(df, columns=["A", "b", "c"])) == plain([r[:3] for r in rows], names[:3])


def test_no_rows_and_repeated_rows(spark):
    assert discovered_keys(spark.createDataFrame([], "a int")) == []
    assert discovered_keys(spark.createDataFrame([(1, 1), (1, 1)], "a int, b int")) == []
    assert discovered_keys(spark.createDataFrame([(1, {"x": 1})], "a int, m map<string,int>")) == [["a"]]


def test_sets_that_hardly_repeat_are_not_counted_whole(spark, monkeypatch):
    """Each pair and triple of the columns repeats a few values in a hundred; only what is a key is grouped whole."""
    monkeypatch.setattr(keys, "_SLICE_ROWS", 1 << 9, raising=False)
    whole = []
    grouped = keys._without_repeats if hasattr(keys, "_without_repeats") else None
    if grouped:
        monkeypatch.setattr(keys, "_without_repeats", lambda df, sets, slices, n: (whole.extend(sets) if slices == 1 else None, grouped(df, sets, slices, n))[1])
    profile = keys.key_profile
    monkeypatch.setattr(keys, "key_profile", lambda df, sets: (whole.extend(sets), profile(df, sets))[1])
    n = 30000
    draws = [f"CAST(floor(rand({i}) * 900) AS INT) AS v{i}" for i in range(4)]
    df = spark.range(n).selectExpr("id AS k", *draws).select("k", "v0", "v1", "v2", "v3").localCheckpoint()
    twice = df.where("k % 40 = 0").selectExpr(f"k + {n} AS k", "v0", "v1", "v2", "v3")
    found = discovered_keys(df.unionAll(twice))
    assert found == [["k"]]
    assert {tuple(s) for s in whole} == {("k",)}


def test_slices_end_with_the_whole():
    assert keys._slices(10) == [1]
    steps = keys._slices(10**9)
    assert steps[-1] == 1 and steps == sorted(steps, reverse=True)


def test_sets_that_share_a_column_share_the_passes(spark, monkeypatch):
    """Eight keys of two columns: the table is read a few times, not once per key and step."""
    monkeypatch.setattr(keys, "_SLICE_ROWS", 1 << 8, raising=False)
    monkeypatch.setattr(keys, "_PASS_ROWS", 1 << 10, raising=False)
    n, read = 1 << 13, spark.sparkContext.accumulator(0)

    def row(i):
        read.add(1)
        return (i // 64, *[(i % 64 * m + i // 64) % 64 + 1000 * (i % 64) for m in range(1, 9)])

    names = [f"c{i}" for i in range(8)]
    df = spark.createDataFrame(spark.sparkContext.range(n, numSlices=4).map(row), "k long, " + ", ".join(f"{c} long" for c in names))
    found = discovered_keys(df, max_columns=2)
    assert [k for k in found if "k" in k] == [["k", c] for c in names]
    assert read.value <= 10 * n


@pytest.mark.parametrize("seed", range(2))
def test_hashes_tell_the_same_as_values(spark, monkeypatch, seed):
    """Tables larger than a slice, with a value that fills a third, and hashes that meet by chance."""
    monkeypatch.setattr(keys, "_SLICE_ROWS", 1 << 5, raising=False)
    monkeypatch.setattr(keys, "_PART_ROWS", 1 << 6, raising=False)
    draw = random.Random(seed)
    names = ["a", "b", "c", "d", "e", "f"]
    rows = [(0 if i % 3 else i, i % 3 and i, draw.randint(0, 99), draw.choice("xyz"), i // 20, i % 20) for i in range(1200)]
    df = spark.createDataFrame(rows, "a int, b int, c int, d string, e int, f int")
    assert sorted(discovered_keys(df)) == plain(rows, names)
    weak = lambda df, c: F.pmod(F.xxhash64(F.lit(df.columns.index(c)), F.col(c)), F.lit(512 if seed else 4))
    monkeypatch.setattr(keys, "_hash", weak, raising=False)
    assert sorted(discovered_keys(df)) == plain(rows, names)


def test_values_that_are_equal_but_not_alike(spark, monkeypatch):
    """Zeros of both signs, NaN and texts that a collation holds equal repeat; a last letter is enough to differ."""
    monkeypatch.setattr(keys, "_SLICE_ROWS", 1 << 5, raising=False)
    first = spark.range(2000).selectExpr("id", "CAST(id AS DOUBLE) AS zero", "CAST(id + 1 AS DOUBLE) AS nan", "concat('t', id) COLLATE UTF8_LCASE AS lower", "concat('T', id) AS text")
    last = spark.sql("SELECT 2000L AS id, -0.0D AS zero, double('NaN') AS nan, 'T7' COLLATE UTF8_LCASE AS lower, 't7' AS text")
    more = spark.sql("SELECT 2001L AS id, 2001.0D AS zero, double('NaN') AS nan, 'u' COLLATE UTF8_LCASE AS lower, 't8' AS text")
    df = first.unionAll(last).unionAll(more).localCheckpoint()
    assert discovered_keys(df, max_columns=1) == [["id"], ["text"]]
