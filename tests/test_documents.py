import datetime as dt

import pytest
from pyspark.sql import functions as F, types as T

from conftest import rows
from tablemill.errors import RequestError
from tablemill.operators import documents as ops
from tablemill.operators.documents import DocumentOptions
from tablemill.operators.pipelines import (
    VariantFields,
    apply_pipeline,
    document_filter,
    document_predicate,
)
from tablemill.plans.documents import LoadOptions, load_documents, load_raw_json, raw_json_rows
from tablemill.sinks import tables


def docs(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, js string")


def flat(df, **options):
    out = ops.flatten_documents(df, "js", DocumentOptions(**options))
    return out.columns, rows(out)


NESTED = '{"_id":"x","a":{"b":1,"c":{"d":"q"}}}'


def test_flatten(spark):
    assert flat(docs(spark, NESTED)) == (["a_b", "a_c_d"], [(1, "q")])


def test_flatten_with_id_and_separator(spark):
    assert flat(docs(spark, NESTED), include_fields=["_id", "a_b"]) == (["_id", "a_b"], [("x", 1)])
    assert flat(docs(spark, NESTED), separator="__")[0] == ["a__b", "a__c__d"]


def test_exclude_and_map(spark):
    got = flat(docs(spark, NESTED), exclude_fields=["a_b"], field_mappings={"a_c_d": "D"})
    assert got == (["D"], [("q",)])


def test_include_wins_over_exclude_only_for_listed(spark):
    got = flat(docs(spark, NESTED), include_fields=["a_b", "a_c_d"], exclude_fields=["a_b"])
    assert got[0] == ["a_c_d"]


def test_empty_document_field_makes_no_column(spark):
    assert flat(docs(spark, '{"a":{},"b":1}'))[0] == ["b"]


@pytest.mark.parametrize(
    "mode,columns,expected",
    [
        ("Serialize", ["t", "u"], [("[1,2]", '[{"x":1}]'), ("[]", None)]),
        ("Json", ["t", "u"], [("[1,2]", '[{"x":1}]'), ("[]", None)]),
        ("firstELEMENT", ["t", "u"], [(1, '{"x":1}'), (None, None)]),
    ],
)
def test_arrays(spark, mode, columns, expected):
    df = docs(spark, '{"t":[1, 2],"u":[{"x": 1}]}', '{"t":[]}')
    got = ops.flatten_documents(df, "js", DocumentOptions(array_handling=mode))
    assert got.columns == columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted(expected, key=str)


def test_arrays_skipped(spark):
    assert flat(docs(spark, '{"t":[1],"k":2}'), array_handling="Skip")[0] == ["k"]


def test_arrays_never_typed(spark):
    assert flat(docs(spark, '{"t":[],"k":2}'), array_handling="FirstElement")[0] == ["k"]


def test_shallow(spark):
    got = flat(docs(spark, '{"a":{"b":1},"n":2}'), flatten=False)
    assert got == (["a", "n"], [('{"b":1}', 2)])


def test_clash_keeps_both_sources_of_values(spark):
    df = docs(spark, '{"a_b":1,"a":{"b":2}}', '{"a":{"b":3}}', '{"a_b":4}')
    read = ops.read_documents(df, "js")
    plan = ops.flatten_plan(read)
    assert plan.names == ["a_b"] and plan.warnings == ["Field name clash: 'a_b'"]
    assert [r[0] for r in read.select(*plan.columns).collect()] == [1, 3, 4]


def test_invalid_column_is_dropped_with_warning_unless_mapped(spark):
    read = ops.read_documents(docs(spark, '{"bad name":1,"it\'s":2,"ok":3}'), "js")
    plan = ops.flatten_plan(read)
    assert plan.names == ["ok"]
    assert "Skipping invalid column name: 'bad name'" in plan.warnings
    mapped = ops.flatten_plan(
        read, DocumentOptions(field_mappings={"bad name": "good", "it's": "its"})
    )
    assert rows(read.select(*mapped.columns)) == [(1, 2, 3)]


def test_fields_seen_late_and_types_that_differ(spark):
    df = docs(
        spark, '{"a":1}', '{"a":2.5,"m":"t"}', '{"m":{"z":1},"n":null}', '{"late":true,"m":7}'
    )
    schema = ops.infer_document_schema(df, "js")
    columns, _ = ops.inferred_columns(schema)
    assert columns == [("a", "decimal(21,1)"), ("late", "boolean"), ("m", "string")]
    got = ops.flatten_documents(df, "js")
    assert [r["m"] for r in got.collect()] == [None, "t", '{"z":1}', "7"]


def test_fields_of_mixed_type_keep_their_numbers(spark):
    df = docs(spark, '{"q":5,"g":"a"}', '{"q":7,"g":"a"}', '{"q":"bad","g":"a"}', '{"q":2,"g":1}', '{"g":"b"}')
    read = ops.read_documents(df, "js")
    total = apply_pipeline(read, [{"$group": {"_id": "$g", "t": {"$sum": "$q"}, "z": {"$sum": "q"}}}])
    assert rows(total.select("_id", "t", "z")) == [("1", 2.0, 0), ("a", 12.0, 0), ("b", 0.0, 0)]
    for spec, n in (({"q": {"$gt": 4}}, 2), ({"q": "bad"}, 1), ({"q": {"$ne": 5}}, 4), ({"q": None}, 1), ({"q": {"$in": [2, "bad"]}}, 2)):
        assert document_filter(read, spec).count() == n
    assert [r["q"] for r in ops.flatten_documents(df, "js").collect()] == ["5", "7", "bad", "2", None]


def test_mixed_wrappers(spark):
    df = docs(
        spark,
        '{"big":{"$numberLong":"5"},"price":{"$numberInt":"2"},"id":{"$oid":"x1"}}',
        '{"big":{"$numberInt":"7"},"price":{"$numberDecimal":"2.50"},"id":"x2"}',
    )
    out = ops.flatten_documents(df, "js")
    assert [(r["big"], float(r["price"]), r["id"]) for r in out.collect()] == [(5, 2.0, "x1"), (7, 2.5, "x2")]
    assert out.schema["big"].dataType == T.LongType()
    columns, _ = ops.inferred_columns(ops.infer_document_schema(df, "js"))
    assert columns == [("big", "bigint"), ("id", "string"), ("price", "decimal(38,18)")]


def test_names_that_differ_only_in_case(spark):
    df = docs(spark, '{"a":1,"A":2,"n":{"x":1,"X":"t"}}', '{"a":3,"n":{"x":5}}', '{"n":null}')
    assert ops.case_clashes(ops.infer_document_schema(df, "js"))
    got = ops.flatten_documents(df, "js")
    assert len(got.columns) == 2
    # The later field in name order wins: "a" after "A", "x" after "X".
    assert {tuple(r) for r in got.collect()} == {(1, "1"), (3, "5"), (None, None)}


def test_whole_numbers_beside_fractions_stay_exact(spark):
    got = ops.flatten_documents(docs(spark, '{"v":9007199254740993}', '{"v":1.5}'), "js")
    assert [str(r["v"]) for r in got.collect()] == ["9007199254740993.0", "1.5"]


TOO_DEEP = '{"x":' * 5000 + "1" + "}" * 5000
BAD = ["{broken", TOO_DEEP, "[1,2]", '"s"', "", None, '{"a":1', "{'a':1}"]


def test_quarantine(spark):
    df = docs(spark, '{"a":1}', ' \n{"a":2}\n ', *BAD)
    assert ops.good_documents(df, "js").count() == 2
    assert [r["js"] for r in ops.rejected_documents(df, "js").orderBy("i").collect()] == BAD
    assert flat(df)[1] == [(1,), (2,)]


WRAPPED = (
    '{"_id":{"$oid":"65a"},"d":{"$date":"2024-01-02T03:04:05.678Z"},'
    '"old":{"$date":{"$numberLong":"-1000"}},"l":{"$numberLong":"9007199254740993"},'
    '"i":{"$numberInt":"7"},"f":{"$numberDouble":"1.5"},'
    '"p":{"$numberDecimal":"12345678901234567890.123456789"},'
    '"b":{"$binary":{"base64":"aGk=","subType":"00"}},"t":{"$timestamp":{"t":60,"i":1}}}'
)


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_typed_wrappers(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        fields = ["_id", "d", "old", "l", "i", "f", "p", "b", "t"]
        df = docs(spark, WRAPPED)
        row = ops.flatten_documents(df, "js", DocumentOptions(include_fields=fields)).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert row["_id"] == "65a"
    assert row["d"] == dt.datetime(2024, 1, 2, 3, 4, 5, 678000)
    assert row["old"] == dt.datetime(1969, 12, 31, 23, 59, 59)
    assert row["t"] == dt.datetime(1970, 1, 1, 0, 1)
    assert (row["l"], row["i"], row["f"]) == (9007199254740993, 7, 1.5)
    assert str(row["p"]) == "12345678901234567890.123456789000000000"
    assert bytes(row["b"]) == b"hi"


def test_other_wrappers_are_text(spark):
    df = docs(spark, '{"u":{"$uuid":"c0ffee"},"k":{"$maxKey":1},"d":{"$date":"2024-01-01T00:00:00Z"}}')
    assert flat(df.select("js"), exclude_fields=["d"]) == (["k", "u"], [("1", "c0ffee")])
    columns, _ = ops.inferred_columns(ops.infer_document_schema(df, "js"))
    assert columns == [("d", "timestamp_ntz"), ("k", "string"), ("u", "string")]


def test_flatten_of_struct_columns(spark):
    df = spark.sql("SELECT named_struct('x', 1, 'y', array(1, 2)) AS s, map('k', 1) AS m")
    assert rows(ops.flatten(df)) == [(1, "[1,2]", '{"k":1}')]


def test_filter(spark):
    df = spark.createDataFrame(
        [("active", 20, "x"), ("active", 18, "y"), ("off", 30, None), (None, 40, "z")],
        "status string, age int, city string",
    )
    spec = {"status": "active", "age": {"$gt": 18}}
    assert document_filter(df, spec).count() == 1
    assert document_filter(df, {"status": {"$ne": "active"}}).count() == 2
    assert document_filter(df, {"city": None}).count() == 1
    assert document_filter(df, {"age": {"$in": [18, 40]}}).count() == 2
    assert document_filter(df, {"age": "18"}).count() == 0
    assert document_filter(df, {"nowhere": 1}).count() == 0
    assert document_filter(df, {}).count() == 4
    with pytest.raises(RequestError):
        document_filter(df, {"age": {"$near": 1}})
    with pytest.raises(RequestError):
        document_filter(df, {"$where": "1"})


def test_filter_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "p")
    spark.range(5).selectExpr("id AS age", "'active' AS status").write.parquet(path)
    df = document_filter(spark.read.parquet(path), {"status": "active", "age": {"$gt": 2}})
    text = df._jdf.queryExecution().toString()
    assert "EqualTo(status,active)" in text and "GreaterThan(age,2)" in text


def test_pipeline(spark):
    df = docs(
        spark,
        '{"_id":1,"orderId":7,"total":5,"status":"completed","customer":{"name":"A","x":1}}',
        '{"_id":2,"orderId":8,"total":6,"status":"open","customer":{"name":"B"}}',
        '{"_id":3,"orderId":9,"total":2,"status":"completed"}',
    )
    read = ops.read_documents(df, "js")
    stages = [
        {"$match": {"status": "completed"}},
        {"$project": {"orderId": 1, "total": 1, "customerName": "$customer.name"}},
    ]
    out = ops.flatten(apply_pipeline(read, stages))
    assert out.columns == ["orderId", "total", "customerName"]
    assert rows(out) == [(7, 5, "A"), (9, 2, None)]
    nested = apply_pipeline(read, [{"$project": {"_id": 0, "customer.name": 1}}])
    assert ops.flatten(nested).columns == ["customer_name"]
    dropped = apply_pipeline(read, [{"$project": {"_id": 0, "customer": 0, "status": 0}}])
    assert dropped.columns == ["orderId", "total"]


def test_group(spark):
    df = docs(spark, '{"p":"a","n":1,"s":"x"}', '{"p":"a","n":2}', '{"p":"b"}')
    read = ops.read_documents(df, "js")
    grouped = apply_pipeline(
        read, [{"$group": {"_id": "$p", "c": {"$sum": 1}, "t": {"$sum": "$n"}, "z": {"$sum": "$s"}}}]
    )
    assert rows(grouped) == [("a", 2, 3, 0), ("b", 1, 0, 0)]
    assert ops.flatten(grouped).columns == ["c", "t", "z"]
    assert ops.flatten(grouped, keep_id=True).columns == ["_id", "c", "t", "z"]
    whole = apply_pipeline(read, [{"$group": {"_id": None, "c": {"$sum": 1}}}])
    assert rows(whole.select("c")) == [(3,)]
    paired = apply_pipeline(read, [{"$group": {"_id": {"p": "$p"}, "c": {"$sum": 1}}}])
    assert ops.flatten(paired).columns == ["_id_p", "c"]
    with pytest.raises(RequestError):
        apply_pipeline(read, [{"$lookup": {}}])
    with pytest.raises(RequestError):
        apply_pipeline(read, [{"$group": {"_id": None, "m": {"$push": "$n"}}}])


def test_load(spark, base, name, tmp_path):
    df = docs(
        spark, '{"a":1,"p":{"$numberDecimal":"1.5"}}', "{broken", '{"a":2,"p":{"$numberDecimal":"x"}}'
    )
    rejected = str(tmp_path / "rejected")
    options = LoadOptions(base=base, rejected_path=rejected)
    result = load_documents(df, "js", name, options=options)
    assert result.ok, result.error
    assert (result.rows_read, result.rows_written, result.rows_failed) == (3, 1, 2)
    assert [r["a"] for r in spark.table(name).collect()] == [1]
    assert spark.table(name).schema["p"].dataType == T.DecimalType(38, 18)
    left_out = spark.read.parquet(rejected)
    assert rows(left_out.select("text", "reason")) == [
        ("{broken", "no JSON document"),
        ('{"a":2,"p":{"$numberDecimal":"x"}}', "a value that doesn't convert"),
    ][::-1]
    repeated = LoadOptions(truncate=True, rejected_path=rejected, run_id="night")
    for _ in range(2):
        assert load_documents(df, "js", name, options=repeated).ok
    assert spark.read.parquet(rejected).where("run = 'night'").count() == 2
    again = load_documents(df, "js", name, options=LoadOptions(truncate=True))
    assert again.ok and spark.table(name).count() == 1


def test_load_of_nothing_leaves_the_target(spark, base, name):
    load_documents(docs(spark, '{"a":1}'), "js", name, options=LoadOptions(base=base))
    for empty in (docs(spark, "{broken"), docs(spark, '{"a":5}').where("i > 5")):
        result = load_documents(empty, "js", name, options=LoadOptions(truncate=True))
        assert result.ok and "No document matches" in result.warnings
    missed = load_documents(
        docs(spark, '{"a":5}'), "js", name, options=LoadOptions(truncate=True), filter={"a": 9}
    )
    assert missed.ok and missed.rows_written == 0
    assert rows(spark.table(name)) == [(1,)]


def test_load_with_group_keeps_its_key(spark, base, name):
    df = docs(spark, '{"page":"x"}', '{"page":"x"}', "{bad")
    stages = [{"$group": {"_id": "$page", "count": {"$sum": 1}}}]
    result = load_documents(df, "js", name, options=LoadOptions(base=base), pipeline=stages)
    assert result.ok, result.error
    assert rows(spark.table(name)) == [("x", 2)]
    assert (result.rows_written, result.rows_failed) == (1, 1)
    bare = load_documents(
        df,
        "js",
        f"{name}_b",
        DocumentOptions(drop_group_id=True),
        LoadOptions(base=f"{base}/b"),
        pipeline=stages,
    )
    assert bare.ok and spark.table(f"{name}_b").columns == ["count"]


def test_load_without_valid_columns(spark, base, name):
    result = load_documents(docs(spark, '{"bad name":1}'), "js", name, options=LoadOptions(base=base))
    assert result.ok and "The documents have no field that can be a column" in result.warnings
    assert not tables.table_exists(spark, name)


def test_raw_json(spark, base, name):
    df = docs(spark, '{"b":1}', "{bad", '{"a":2}', '{"c":3}')
    result = load_raw_json(df, "js", name, LoadOptions(base=base), ["i"])
    assert result.ok, result.error
    assert result.target == f"{name}_JSON"
    table = spark.table(result.target)
    assert table.columns == ["Id", "JsonData", "CreatedAt"]
    assert rows(table.drop("CreatedAt")) == [(1, '{"b":1}'), (2, '{"a":2}'), (3, '{"c":3}')]
    assert (result.rows_read, result.rows_written, result.rows_failed) == (4, 3, 1)
    load_raw_json(docs(spark, '{"d":4}'), "js", name)
    assert rows(table.sparkSession.table(result.target).select("Id")) == [(1,), (2,), (3,), (4,)]
    load_raw_json(docs(spark, '{"e":5}'), "js", name, LoadOptions(truncate=True))
    assert rows(spark.table(result.target).select("Id", "JsonData")) == [(1, '{"e":5}')]


def test_json_table_name():
    assert ops.json_table_name("T") == "T_JSON"
    assert ops.json_table_name("T_json") == "T_json"


def test_ids_are_dense_over_many_tasks(spark):
    df = spark.range(0, 1000, 1, 13).selectExpr("id", "concat('{\"v\":', id, '}') AS js")
    df = df.where("id % 7 <> 3")
    for order in ((), ("id",), (F.desc("id"),)):
        out = raw_json_rows(df, "js", order)
        ids = [r["Id"] for r in out.collect()]
        assert sorted(ids) == list(range(1, df.count() + 1))
    in_order = raw_json_rows(df, "js", ("id",)).orderBy("Id").select("JsonData").collect()
    assert [r[0] for r in in_order] == [r["js"] for r in df.orderBy("id").collect()]


def test_read_back(spark):
    df = docs(spark, '{"name":"A","age":"41","n":{"x":2}}', '{"name":"B","age":"old"}')
    got = ops.json_values(
        df, "js", {"Name": ("$.name", "string"), "Age": ("$.age", "int"), "x": ("$.n.x", "int")}
    )
    assert rows(got) == [("A", 41, 2), ("B", None, None)]
    opened = ops.open_json(df, "js", "name STRING, n STRUCT<x: INT>")
    assert opened.select("name", "n.x").count() == 2


def test_fields_come_from_matching_documents_only(spark, base, name):
    df = docs(spark, '{"s":"on","a":1}', '{"s":"off","b":2}', '{"s":"on","a":"x"}')
    result = load_documents(df, "js", name, options=LoadOptions(base=base), filter={"s": "on"})
    assert result.ok, result.error
    assert spark.table(name).columns == ["a", "s"]
    assert rows(spark.table(name)) == [("1", "on"), ("x", "on")]


def test_filter_on_parsed_documents(spark):
    df = ops.parsed(
        docs(
            spark,
            '{"n":20,"s":"a","b":true,"o":{"x":1.5}}',
            '{"n":"20","s":null}',
            '{"n":9007199254740993,"b":false}',
            '{"n":18.5}',
        ),
        "js",
    )

    def hits(spec):
        test = document_predicate(VariantFields(ops.DOC), spec)
        return [r["i"] for r in df.where(test).orderBy("i").collect()]

    assert hits({"n": {"$gt": 18}}) == [0, 2, 3]
    assert hits({"n": {"$gt": 18, "$lt": 19.5}}) == [3]
    assert hits({"n": "20"}) == [1]
    assert hits({"n": 9007199254740993}) == [2]
    assert hits({"s": None}) == [1, 2, 3]
    assert hits({"s": {"$ne": "a"}}) == [1, 2, 3]
    assert hits({"b": True}) == [0]
    assert hits({"o.x": {"$gte": 1.5}}) == [0]
    assert hits({"n": {"$in": [20, "20"]}}) == [0, 1]
    assert hits({}) == [0, 1, 2, 3]


def test_group_then_match_that_drops_all(spark, base, name):
    df = docs(spark, '{"p":"a"}')
    load_documents(df, "js", name, options=LoadOptions(base=base))
    stages = [{"$group": {"_id": "$p", "c": {"$sum": 1}}}, {"$match": {"c": {"$gt": 5}}}]
    result = load_documents(df, "js", name, options=LoadOptions(truncate=True), pipeline=stages)
    assert result.ok and result.rows_written == 0
    assert spark.table(name).count() == 1


def test_a_text_is_one_document(spark):
    from tablemill.operators import documents as ops

    texts = ['{"a":1}', ' {"a":1}\n', '{"a":1}{"a":2}', '{"a":1},{"a":2}', '{"a":1},null,{}', '{"a":1} x}', '{"a":1}]}', '[{"a":1}]', "{}", "{", None, "", '{"a":1}}]}', '{"a":[{"b":1} ]}', '{"a":1}}']
    df = spark.createDataFrame(list(enumerate(texts)), "i int, js string")
    assert sorted(r.i for r in ops.good_documents(df, "js").collect()) == [0, 1, 8, 13]
    assert sorted(r.i for r in ops.rejected_documents(df, "js").collect() if r.js) == [2, 3, 4, 5, 6, 7, 9, 12, 14]


def test_an_unknown_operator_ends_in_an_error(spark, base, name):
    from tablemill.plans.documents import LoadOptions, load_documents

    df = spark.createDataFrame([('{"a":1}',)], "js string")
    for given in ({"filter": {"a": {"$near": 1}}}, {"filter": {"$or": 3}}, {"pipeline": [{"$out": "x"}]}):
        result = load_documents(df, "js", name, options=LoadOptions(base=base), **given)
        assert result.error and not spark.catalog.tableExists(name), given
