"""Filters as trees, elements, computed fields and accumulators, on small documents."""

import pytest
from pyspark.sql import functions as F

from conftest import rows
from tablemill.errors import RequestError
from tablemill.operators import documents as ops
from tablemill.operators.documents import DocumentOptions
from tablemill.operators.pipelines import ColumnFields, VariantFields, apply_pipeline, array_paths, document_filter, document_predicate
from tablemill.plans.documents import LoadOptions, load_documents


def docs(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, js string")


LOOSE = [
    '{"n":5,"s":"Abc","t":["x","y"],"o":[{"a":1,"b":"p"},{"a":7,"b":"q"}],"d":{"e":[{"f":1},{"f":2}]}}',
    '{"n":"5","s":null,"t":[],"o":[{"b":"p"},3],"d":{"e":{"f":2}}}',
    '{"n":[4,9],"t":"x","o":{"a":7}}',
    "{}",
    '{"n":null,"t":[null,["x"]],"s":"abd"}',
    '{"n":-7.5,"t":["x"],"o":[]}',
]


@pytest.mark.parametrize(
    "spec,expected",
    [
        ({"$or": [{"n": 5}, {"s": None}]}, [0, 1, 2, 3, 5]),
        ({"$and": [{"n": {"$gt": 3}}, {"n": {"$lt": 6}}]}, [0, 2]),
        ({"$nor": [{"n": {"$gt": 0}}, {"t": "x"}]}, [1, 3, 4]),
        ({"n": {"$not": {"$gt": 4}}}, [1, 3, 4, 5]),
        ({"n": {"$exists": True}}, [0, 1, 2, 4, 5]),
        ({"n": {"$exists": False}}, [3]),
        ({"n": None}, [3, 4]),
        ({"n": {"$ne": None}}, [0, 1, 2, 5]),
        ({"n": {"$gt": None}}, []),
        ({"t": "x"}, [0, 2, 5]),
        ({"t": {"$nin": ["x", None]}}, [1]),
        ({"t": {"$all": ["x", "y"]}}, [0]),
        ({"t": {"$all": []}}, []),
        ({"t": {"$size": 0}}, [1]),
        ({"t": {"$size": 1}}, [5]),
        ({"s": {"$regex": "^ab", "$options": "i"}}, [0, 4]),
        ({"s": {"$regex": "^ab"}}, [4]),
        ({"n": {"$mod": [2, 1]}}, [0, 2]),
        ({"n": {"$mod": [4, -3]}}, [5]),
        ({"o.a": 7}, [0, 2]),
        ({"o.a": None}, [1, 3, 4]),
        ({"o": {"$elemMatch": {"a": 1, "b": "p"}}}, [0]),
        ({"o": {"$elemMatch": {"a": 1, "b": "q"}}}, []),
        ({"o": {"$elemMatch": {"$gt": 2}}}, [1]),
        ({"o": {"$elemMatch": {"$or": [{"a": 7}, {"b": "p"}]}}}, [0, 1]),
        ({"n": {"$elemMatch": {"$gt": 5, "$lt": 10}}}, [2]),
        ({"d.e.f": 2}, [0, 1]),
        ({"d.e.f": {"$not": {"$gt": 1}}}, [2, 3, 4, 5]),
    ],
)
def test_trees_on_parsed_documents(spark, spec, expected):
    df = ops.parsed(docs(spark, *LOOSE), "js")
    found = df.where(document_predicate(VariantFields(ops.DOC), spec))
    assert sorted(r.i for r in found.select("i").collect()) == expected


def test_trees_on_columns(spark):
    data = [(1, "a", ["x"], [(1, "p"), (7, "q")]), (None, "b", None, []), (9, None, ["y", None], None)]
    df = spark.createDataFrame(data, "n int, s string, t array<string>, o array<struct<a int, b string>>")

    def hits(spec):
        return sorted((r.n or 0) for r in document_filter(df, spec).collect())

    assert hits({"$or": [{"n": 9}, {"s": "b"}]}) == [0, 9]
    assert hits({"$nor": [{"n": {"$gt": 5}}]}) == [0, 1]
    assert hits({"n": {"$exists": False}}) == [0]
    assert hits({"t": "x"}) == [1]
    assert hits({"t": None}) == [0, 9]
    assert hits({"t": {"$size": 2}}) == [9]
    assert hits({"o.a": {"$gte": 7}}) == [1]
    assert hits({"o": {"$elemMatch": {"a": 1, "b": "p"}}}) == [1]
    assert hits({"o": {"$elemMatch": {"a": 1, "b": "q"}}}) == []
    assert hits({"nowhere": {"$ne": 1}}) == [0, 1, 9]
    assert hits({"n": {"$in": [1, None]}}) == [0, 1]


@pytest.mark.parametrize(
    "spec",
    [{"$or": []}, {"$or": {"a": 1}}, {"n": {"$not": 5}}, {"n": {"$in": 5}}, {"n": {"$mod": [0, 1]}}, {"n": {"$size": -1}},
     {"n": {"$regex": 5}}, {"n": {"$eq": [1]}}, {"n": {"$elemMatch": 5}}, {"$expr": {}}, {"$or": [5]}],
)
def test_filters_that_cannot_be(spark, spec):
    with pytest.raises(RequestError):
        document_predicate(ColumnFields(spark.range(1).withColumnRenamed("id", "n")), spec)


def test_tree_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "p")
    spark.range(5).selectExpr("id AS age", "'active' AS status").write.parquet(path)
    df = document_filter(spark.read.parquet(path), {"$or": [{"age": 1}, {"status": "off"}], "age": {"$exists": True}})
    text = df._jdf.queryExecution().toString()
    assert "Or(EqualTo(age,1),EqualTo(status,off))" in text


def piped(spark, texts, stages, **options):
    read = ops.read_documents(docs(spark, *texts), "js", None, DocumentOptions(array_fields=array_paths(stages), **options))
    return apply_pipeline(read, stages)


ARRAYS = ['{"k":1,"a":[{"x":1,"y":["p","q"]},{"x":2}]}', '{"k":2,"a":[]}', '{"k":3,"a":null}', '{"k":4}', '{"k":5,"a":[{"x":3,"y":[]}]}']


def test_unwind(spark):
    out = piped(spark, ARRAYS, [{"$unwind": "$a"}])
    assert sorted((r.k, r.a.x) for r in out.collect()) == [(1, 1), (1, 2), (5, 3)]
    assert ops.flatten(out).columns == ["a_x", "a_y", "k"]
    out = piped(spark, ARRAYS, [{"$unwind": {"path": "$a", "preserveNullAndEmptyArrays": True, "includeArrayIndex": "at"}}])
    assert sorted((r.k, r["at"], r.a and r.a.x) for r in out.collect() if r.k != 1) == [(2, None, None), (3, None, None), (4, None, None), (5, 0, 3)]
    out = piped(spark, ARRAYS, [{"$unwind": "$a"}, {"$unwind": "$a.y"}])
    assert sorted((r.k, r.a.x, r.a.y) for r in out.collect()) == [(1, 1, "p"), (1, 1, "q")]
    assert piped(spark, ARRAYS, [{"$unwind": "$none"}]).count() == 0
    assert piped(spark, ARRAYS, [{"$unwind": {"path": "$none", "preserveNullAndEmptyArrays": True}}]).count() == 5


def test_unwind_of_what_is_an_array_in_some_documents(spark):
    texts = ['{"k":1,"a":[1,"x",null]}', '{"k":2,"a":7}', '{"k":3,"a":[]}', '{"k":4,"a":null}']
    out = piped(spark, texts, [{"$unwind": {"path": "$a", "includeArrayIndex": "at"}}])
    got = sorted((r.k, -1 if r["at"] is None else r["at"], r.a) for r in ops.flatten(out).collect() if r.a is not None)
    assert got == [(1, 0, "1"), (1, 1, "x"), (2, -1, "7")]
    assert out.count() == 4  # a null element is an element
    single = piped(spark, ['{"k":1,"a":3}', '{"k":2}'], [{"$unwind": "$a"}])
    assert rows(single.select("k", "a")) == [(1, 3)]


def test_order_and_cuts(spark):
    texts = [f'{{"n":{n},"s":"{n % 3}"}}' for n in range(10)] + ['{"s":"0"}']
    out = piped(spark, texts, [{"$sort": {"s": 1, "n": -1}}, {"$skip": 1}, {"$limit": 4}])
    assert [(r.s, r.n) for r in out.collect()] == [("0", 6), ("0", 3), ("0", 0), ("0", None)]
    assert "TakeOrderedAndProject" in out._jdf.queryExecution().executedPlan().toString()
    mixed = ['{"v":true}', '{"v":"b"}', '{"v":2}', '{"v":{"a":1}}', '{"v":"a"}', '{"v":10}', '{}', '{"v":1.5}', '{"v":[0]}']
    up = ops.flatten(piped(spark, mixed, [{"$sort": {"v": 1}}]))
    assert [r.v for r in up.collect()] == [None, "1.5", "2", "10", "a", "b", '{"a":1}', "[0]", "true"]
    assert rows(piped(spark, texts, [{"$count": "n"}])) == [(11,)]
    assert rows(piped(spark, texts, [{"$match": {"n": 99}}, {"$count": "n"}])) == []
    counts = piped(spark, texts, [{"$sortByCount": "$s"}]).collect()
    assert [c.asDict() for c in counts][0] == {"_id": "0", "count": 5}


def test_accumulators(spark):
    texts = ['{"g":1,"n":1,"m":2}', '{"g":1,"n":4,"m":"x"}', '{"g":1}', '{"g":2,"m":null}', '{"g":1,"n":4,"m":1.5}']
    of = lambda op, f: {op: f"${f}"}
    spec = {"_id": "$g", "avg": of("$avg", "n"), "min": of("$min", "n"), "max": of("$max", "n"), "set": of("$addToSet", "n"), "c": {"$count": {}}}
    spec |= {"mavg": of("$avg", "m"), "mmin": of("$min", "m"), "mmax": of("$max", "m"), "mset": of("$addToSet", "m"), "none": of("$max", "zzz")}
    out = ops.flatten(piped(spark, texts, [{"$group": spec}]), DocumentOptions(), keep_id=True).orderBy("_id").collect()
    first, second = (r.asDict() for r in out)
    assert (first["avg"], first["min"], first["max"], first["set"], first["c"]) == (3.0, 1, 4, "[1,4]", 4)
    assert (first["mavg"], first["mmin"], first["mmax"]) == (1.75, "1.5", "x")
    assert first["mset"] == '["1.5","2","x"]'
    assert (second["avg"], second["min"], second["set"], second["mmin"]) == (None, None, "[]", None)


def test_computed_fields(spark):
    texts = ['{"a":7,"b":2,"s":"Ab","o":{"x":1,"y":2},"t":[1,2]}', '{"b":3,"o":{"x":5},"t":[]}']
    stages = [
        {"$addFields": {"sum": {"$add": ["$a", "$b", 1]}, "half": {"$divide": ["$b", 2]}, "o.x": {"$multiply": ["$o.x", 10]}, "n": {"$size": "$t"}}},
        {"$set": {"s": {"$concat": [{"$toUpper": "$s"}, "!"]}, "a": {"$ifNull": ["$a", 0]}, "c": {"$cond": [{"$gt": ["$b", 2]}, "big", "small"]}}},
        {"$unset": ["t", "o.y"]},
    ]
    out = ops.flatten(piped(spark, texts, stages))
    got = [r.asDict() for r in out.orderBy("b").collect()]
    assert got[0] == {"a": 7, "b": 2, "s": "AB!", "o_x": 10, "sum": 10, "half": 1.0, "n": 2, "c": "small"}
    assert got[1] == {"a": 0, "b": 3, "s": "!", "o_x": 50, "sum": None, "half": 1.5, "n": 0, "c": "big"}
    for bad in ({"$nope": [1]}, {"$add": ["$s", 1]}, {"$subtract": [1]}, {"$cond": ["$a", 1, 2]}, {"$add": [1], "$concat": ["a"]}):
        with pytest.raises(RequestError):
            piped(spark, texts, [{"$addFields": {"z": bad}}])
    for bad in ({"$limit": 0}, {"$limit": "1"}, {"$skip": -1}, {"$sort": {"a": 2}}, {"$unwind": "t"}, {"$unwind": {"path": "$t", "x": 1}}, {"a": 1, "b": 2}):
        with pytest.raises(RequestError):
            apply_pipeline(spark.range(1).selectExpr("id AS a"), [bad])


def test_nested_fields_dropped(spark):
    texts = ['{"a":{"b":1,"c":{"d":2}},"e":3}']
    assert ops.flatten(piped(spark, texts, [{"$project": {"a.b": 0}}])).columns == ["a_c_d", "e"]
    assert ops.flatten(piped(spark, texts, [{"$project": {"a.c.d": 0, "zzz.y": 0}}])).columns == ["a_b", "e"]


def test_load_through_a_pipeline(spark, base, name, tmp_path):
    """Bad documents are counted whatever the pipeline cuts."""
    texts = ["{", *ARRAYS, "[]"]
    stages = [{"$unwind": "$a"}, {"$sort": {"a.x": -1}}, {"$limit": 2}]
    result = load_documents(
        docs(spark, *texts), "js", name, DocumentOptions(), LoadOptions(base=base, rejected_path=str(tmp_path / "bad")), pipeline=stages
    )
    assert result.ok, result.error
    assert (result.rows_written, result.rows_failed) == (2, 2)
    assert rows(spark.table(name).select("k", "a_x")) == [(1, 2), (5, 3)]
    assert spark.read.parquet(str(tmp_path / "bad")).select(F.col("text")).count() == 2
    empty = load_documents(docs(spark, *texts), "js", name, options=LoadOptions(truncate=True), pipeline=[{"$unwind": "$zzz"}])
    assert empty.ok and empty.rows_written == 0 and spark.table(name).count() == 2
    wrong = load_documents(docs(spark, *texts), "js", name, options=LoadOptions(truncate=True), pipeline=[{"$group": {"_id": None, "m": {"$push": "$k"}}}])
    assert wrong.error and spark.table(name).count() == 2


@pytest.mark.parametrize(
    "stages",
    [
        [{"$unwind": "$b"}, {"$group": {"_id": "$b.c", "n": {"$sum": 1}}}],
        [{"$unwind": {"path": "$b", "preserveNullAndEmptyArrays": True}}],
        [{"$match": {"a": {"$gte": 0}}}, {"$project": {"n": {"$size": "$b"}}}],
    ],
)
def test_documents_are_computed_once(spark, name, base, stages):
    """The source of a load is computed and parsed once, whatever reads its documents afterwards."""
    made = spark.sparkContext.accumulator(0)

    def text(i):
        made.add(1)
        return ('{"a":%d,"b":[{"c":%d},{"c":7}]}' % (i, i % 3) if i % 10 else "{",)

    docs = spark.createDataFrame(spark.sparkContext.range(200, numSlices=2).map(text), "js string")
    r = load_documents(docs, "js", name, options=LoadOptions(base=base), pipeline=stages)
    assert r.ok and r.rows_failed == 20
    assert made.value == 200


def test_texts_that_hold_what_follows_a_parsed_text(spark):
    """The number that marks the end of a text may stand in the text itself."""
    end = "4098273648172635"
    good = ['{"a":%s}' % end, '{"a":[1,%s],"b":[{"c":2}]}' % end, '  {"a":"%s]"} ' % end, '{"a":[{"b":1}] }']
    bad = ['{"a":1},%s],{"b":1}' % end, '{"a":1},%s]}' % end, '{"a":1},"%s"],{}' % end, '{"a":1}],{"b":1}', '{"a":1},{"b":1}', '{"a":1},%s.0],{}' % end]
    df = ops.parsed(spark.createDataFrame([(t,) for t in good + bad], "js string"), "js")
    found = {r["js"]: r[ops.DOC] is not None for r in df.collect()}
    assert found == dict.fromkeys(good, True) | dict.fromkeys(bad, False)
