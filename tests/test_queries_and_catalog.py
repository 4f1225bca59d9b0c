import pytest
from pyspark.sql import functions as F

from conftest import rows
from tablemill.errors import RequestError
from tablemill.operators import catalog, keys, query


@pytest.fixture
def people(spark):
    df = spark.createDataFrame([(1, "John", 30), (2, "Ann", None)], "id int, name string, age int")
    df.createOrReplaceTempView("people")
    return df


def test_parameters(spark, people):
    text = "SELECT name FROM people WHERE id = @id AND name <> '@id' AND :none IS NULL"
    assert rows(query.parameterized(spark, text, {"@id": 1, "none": None})) == [("John",)]
    assert rows(query.parameterized(spark, "SELECT '@id' AS x", {"id": 1})) == [("@id",)]
    assert query.parameterized(spark, "SELECT * FROM people").count() == 2


def test_a_value_stays_a_value(spark, people):
    got = query.parameterized(spark, "SELECT * FROM people WHERE name = @n", {"n": "x' OR '1'='1"})
    assert got.count() == 0


def test_scalar(spark, people):
    assert query.scalar_value(spark, "SELECT max(id), 1 FROM people") == 2
    assert query.scalar_value(spark, "SELECT id FROM people WHERE id > 9", default=-1) == -1
    assert query.scalar_value(spark, "SELECT age FROM people WHERE id = 2", default=0) == 0
    assert query.scalar_value(spark, "SELECT '7'", data_type="int") == 7


def test_stored_query(spark, people):
    query.define_stored_query(
        spark, "older", "least INT", "name STRING", "SELECT name FROM people WHERE age >= least"
    )
    assert rows(query.stored_query(spark, "older", {"@least": 30})) == [("John",)]
    assert query.stored_query(spark, "older", {"least": 31}).count() == 0


def test_delete_keeps_null_predicates(people):
    assert rows(query.deleted(people, F.col("age") > 10).select("id")) == [(2,)]


def test_update_skips_null_predicates(people):
    got = query.updated(people, {"age": F.lit(0)}, F.col("age") > 10)
    assert rows(got.select("id", "age")) == [(1, 0), (2, None)]


INDEX_COLUMNS = (
    "schema_name string, table_name string, index_name string, index_id int, "
    "is_primary_key boolean, is_unique boolean, column_name string, key_ordinal int, "
    "is_descending boolean, is_included boolean"
)
INDEXES = [
    ("dbo", "a", "UX", 1, False, True, "Code", 1, False, False),
    ("dbo", "a", "PK", 3, True, True, "Code", 2, True, False),
    ("dbo", "a", "PK", 3, True, True, "Id", 1, False, False),
    ("dbo", "a", "PK", 3, True, True, "Extra", 3, False, True),
    ("dbo", "b", "IX", 1, False, False, "x", 1, False, False),
    ("dbo", "b", "U2", 9, False, True, "z", 1, False, False),
    ("dbo", "b", "U1", 4, False, True, "y", 1, False, False),
    ("dbo", "c", "IX", 1, False, False, "x", 1, False, False),
    ("other", "c", "PK", 1, True, True, "k", 1, False, False),
]


def test_declared_keys(spark):
    df = spark.createDataFrame(INDEXES, INDEX_COLUMNS)
    assert keys.declared_key(df, "a") == ["Id", "Code"]
    assert keys.declared_key(df, "dbo.b") == ["y"]
    assert keys.declared_key(df, "other.c") == ["k"]
    with pytest.raises(RequestError, match="Table 'c' declares no primary key"):
        keys.declared_key(df, "c")


def test_index_summary(spark):
    df = keys.in_priority(keys.index_summary(spark.createDataFrame(INDEXES, INDEX_COLUMNS)))
    got = [tuple(r) for r in df.select("index_name", "key_columns", "orders").collect()]
    assert got[:2] == [("PK", "Id,Code", "ASC,DESC"), ("UX", "Code", "ASC")]
    assert [g[0] for g in got[2:5]] == ["U1", "U2", "IX"]


def test_key_profile(spark):
    df = spark.createDataFrame([(1, 1, "a"), (2, 1, None), (3, 2, None)], "a int, b int, c string")
    got = keys.key_profile(df, [["a"], ["b"], ["c"], ["b", "c"]])
    assert rows(got) == rows(
        spark.createDataFrame(
            [("a", 3, 3, 0, True), ("b", 3, 2, 0, False), ("c", 3, 2, 2, False), ("b,c", 3, 3, 2, False)],
            got.schema,
        )
    )


def test_key_profile_of_an_empty_table(spark):
    got = keys.key_profile(spark.createDataFrame([], "a int"), [["a"]]).first()
    assert tuple(got) == ("a", 0, 0, 0, True)


def test_inventory(spark, people):
    assert rows(catalog.table_inventory({"p": people})) == [("dbo", "p", 2)]
    got = catalog.column_inventory({"p": people}, {"p": ["ID"]}, {"p": "id"}).collect()
    assert [tuple(r)[2:] for r in got] == [
        (1, "id", "int", None, True, True, True),
        (2, "name", "string", None, True, False, False),
        (3, "age", "int", None, True, False, False),
    ]
    profile = catalog.column_profile({"p": people}).collect()
    assert [tuple(r)[2:] for r in profile] == [(1, "id", None, 0), (2, "name", 4, 0), (3, "age", None, 1)]
    assert catalog.table_inventory({}).count() == catalog.column_inventory({}).count() == 0


def test_database_inventory(spark, base):
    spark.sql(f"CREATE DATABASE IF NOT EXISTS inv LOCATION '{base}'")
    assert [x.count() for x in catalog.database_inventory(spark, "inv")] == [0, 0]
    spark.sql(f"CREATE TABLE inv.t (a int NOT NULL, b varchar(9)) USING parquet LOCATION '{base}/t'")
    fields = ("schema_name", "table_name", "index_name", "index_id", "is_primary_key", "is_unique", "column_name", "key_ordinal", "is_descending", "is_included")
    indexes = spark.createDataFrame([("inv", "t", "PK", 1, True, True, "a", 1, False, False)], list(fields))
    found, columns = catalog.database_inventory(spark, "inv", declared_indexes=indexes, identities={"t": "a"})
    assert rows(found) == [("inv", "t", 0)]
    assert [tuple(r)[3:] for r in columns.collect()] == [
        ("a", "int", None, columns.first()["is_nullable"], True, True),
        ("b", "varchar(9)", 9, True, False, False),
    ]
    assert "Scan parquet" not in columns._jdf.queryExecution().toString()
    assert catalog.database_inventory(spark, "inv", include_columns=False)[1] is None


def test_inventory_of_odd_column_names(spark):
    df = spark.createDataFrame([("x", 1)], ["it's `q` \\ \"d\"", "b"])
    got = catalog.column_inventory({"t": df}).collect()
    assert got[0]["column_name"] == "it's `q` \\ \"d\"" and got[0]["max_length"] is None
    assert catalog.column_profile({"t": df}).first()["longest"] == 1
