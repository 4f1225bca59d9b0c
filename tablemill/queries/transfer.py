"""Transfer, query and row-change queries."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from tablemill.operators import query as ops
from tablemill.plans.documents import LoadOptions, load_documents
from tablemill.plans.changes import delete_rows, insert_rows, update_rows
from tablemill.plans.transfer import TransferOptions, insert_records, transfer
from tablemill.queries.registry import new_table, query, sql, table
from tablemill.queries.sync import _checked, _lake_copy
from tablemill.sources.scans import record_scan, register_tables


@query("SELECT * FROM orders")
def transfer_all(spark, folder):
    target, base = new_table(spark, "transfer_all")
    source = sql(spark, folder, "SELECT * FROM orders")
    options = TransferOptions(create_if_missing=True, base=base)
    _checked(transfer(spark, source, target, options))
    return spark.table(target)


@query("SELECT c_custkey AS CustomerId, c_name AS FullName, c_acctbal AS Balance FROM customer")
def transfer_mapped(spark, folder):
    target, base = new_table(spark, "transfer_mapped")
    mappings = {"c_custkey": "CustomerId", "C_NAME": "FullName", "c_acctbal": "Balance"}
    options = TransferOptions(mappings, create_if_missing=True, base=base)
    _checked(transfer(spark, table(spark, folder, "customer"), target, options))
    return spark.table(target)


BIG_PARTS = "SELECT * FROM part WHERE p_size > 25"


@query(BIG_PARTS)
def transfer_truncate_load(spark, folder):
    target = _lake_copy(spark, folder, "part")
    source = sql(spark, folder, BIG_PARTS)
    _checked(transfer(spark, source, target, TransferOptions(truncate=True)))
    return spark.table(target)


@query("SELECT count(*) AS rows_read, count(*) AS rows_written FROM lineitem")
def transfer_counts(spark, folder):
    target, base = new_table(spark, "transfer_counts")
    options = TransferOptions(create_if_missing=True, base=base)
    r = _checked(transfer(spark, table(spark, folder, "lineitem"), target, options))
    return spark.createDataFrame(
        [(r.rows_read, r.rows_written)], "rows_read bigint, rows_written bigint"
    )


@query("SELECT count(*) AS n_rows, TRUE AS all_within FROM lineitem")
def transfer_file_batches(spark, folder):
    target, base = new_table(spark, "transfer_batches")
    options = TransferOptions(create_if_missing=True, base=base, max_records_per_file=5000)
    _checked(transfer(spark, table(spark, folder, "lineitem"), target, options))
    files = spark.table(target).groupBy(F.input_file_name().alias("f")).agg(F.count("*").alias("n"))
    return files.agg(F.sum("n").alias("n_rows"), (F.max("n") <= 5000).alias("all_within"))


@query(
    """
SELECT c_mktsegment, count(*) AS n_orders,
       CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS total_cents
FROM orders JOIN customer ON o_custkey = c_custkey
WHERE o_orderstatus = 'F' AND o_totalprice > 100000 GROUP BY c_mktsegment
"""
)
def param_query(spark, folder):
    register_tables(spark, folder, ["orders", "customer"])
    text = """
SELECT c_mktsegment, count(*) AS n_orders,
       sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS total_cents
FROM orders JOIN customer ON o_custkey = c_custkey
WHERE o_orderstatus = @status AND o_totalprice > :least GROUP BY c_mktsegment
"""
    return ops.parameterized(spark, text, {"@status": "F", "least": 100000})


@query("SELECT max(o_totalprice) AS value FROM orders WHERE o_orderpriority = '2-HIGH'")
def scalar_query(spark, folder):
    register_tables(spark, folder, ["orders"])
    text = "SELECT max(o_totalprice), count(*) FROM orders WHERE o_orderpriority = @p"
    return ops.scalar(spark, text, {"p": "2-HIGH"}, "double")


@query(
    """
SELECT o_orderkey, o_totalprice, c_name FROM orders JOIN customer ON o_custkey = c_custkey
WHERE c_mktsegment = 'BUILDING' AND o_totalprice >= 250000.0
"""
)
def stored_query(spark, folder):
    register_tables(spark, folder, ["orders", "customer"])
    ops.define_stored_query(
        spark,
        "segment_orders",
        "segment STRING, least DOUBLE",
        "o_orderkey BIGINT, o_totalprice DOUBLE, c_name STRING",
        "SELECT o_orderkey, o_totalprice, c_name FROM orders "
        "JOIN customer ON o_custkey = c_custkey "
        "WHERE c_mktsegment = segment AND o_totalprice >= least",
    )
    return ops.stored_query(spark, "segment_orders", {"@segment": "BUILDING", "least": 250000.0})


NEW_PARTS = "SELECT s_suppkey AS p_partkey, s_name AS p_name FROM supplier"


@query(
    f"""
SELECT * FROM part UNION ALL
SELECT p_partkey, p_name, NULL, NULL, NULL, NULL FROM ({NEW_PARTS}) q
"""
)
def insert_statement(spark, folder):
    target = _lake_copy(spark, folder, "part")
    _checked(insert_rows(spark, target, sql(spark, folder, NEW_PARTS)))
    return spark.table(target)


@query(
    """
SELECT p_partkey, p_name, CASE WHEN nullif(p_size, 1) < 10 THEN upper(p_brand) ELSE p_brand END
         AS p_brand, p_type,
       CASE WHEN nullif(p_size, 1) < 10 THEN p_size + 100 ELSE p_size END AS p_size, p_retailprice
FROM part
"""
)
def update_where(spark, folder):
    target = _lake_copy(spark, folder, "part")
    changes = {"p_brand": F.upper("p_brand"), "p_size": F.col("p_size") + 100}
    _checked(update_rows(spark, target, changes, F.expr("nullif(p_size, 1) < 10")))
    return spark.table(target)


@query("SELECT * FROM part WHERE coalesce(NOT (nullif(p_size, 1) < 10), true)")
def delete_where(spark, folder):
    target = _lake_copy(spark, folder, "part")
    _checked(delete_rows(spark, target, F.expr("nullif(p_size, 1) < 10")))
    return spark.table(target)


@query(
    """
SELECT (SELECT count(*) FROM part) AS rows_read,
       (SELECT count(*) FROM part WHERE nullif(p_size, 1) < 10) AS rows_changed
"""
)
def affected_rows(spark, folder):
    target = _lake_copy(spark, folder, "part")
    r = _checked(delete_rows(spark, target, F.expr("nullif(p_size, 1) < 10")))
    return spark.createDataFrame(
        [(r.rows_read, r.rows_deleted)], "rows_read bigint, rows_changed bigint"
    )


def _part_records(spark, folder):
    """Parts as ragged JSON: large ones have a type too, promoted ones no brand."""
    big = F.when(F.col("p_size") > 25, F.col("p_type"))
    brand = F.when(~F.col("p_type").isin("PROMO"), F.col("p_brand"))
    record = F.struct("p_partkey", "p_name", brand.alias("p_brand"), big.alias("p_type"))
    return table(spark, folder, "part").select("p_partkey", F.to_json(record).alias("js"))


# The first part is small and not promoted, so its record has three keys.
RECORD_ROWS = """
SELECT p_partkey, p_name, CASE WHEN p_type <> 'PROMO' THEN p_brand END AS p_brand FROM part
"""


@query(RECORD_ROWS)
def records_first_row_schema(spark, folder):
    return record_scan(_part_records(spark, folder), "js", "p_partkey")


@query(RECORD_ROWS)
def records_inserted(spark, folder):
    target, base = new_table(spark, "records")
    schema = T.StructType.fromDDL("p_partkey BIGINT, p_name STRING, p_brand STRING")
    options = TransferOptions(create_if_missing=True, base=base)
    records = _part_records(spark, folder)
    _checked(insert_records(records, "js", target, schema=schema, options=options))
    return spark.table(target)


# Types are the sources' own; document numbers widen to bigint.
CREATED = [
    ("transfer", "OrderKey", "bigint"),
    ("transfer", "Total", "double"),
    ("transfer", "Ordered", "timestamp_ntz"),
    ("documents", "k", "bigint"),
]


@query(f"SELECT * FROM (VALUES {', '.join(str(r) for r in CREATED)}) v(made_by, name, type)")
def created_tables(spark, folder):
    """Columns of the tables that a mapped transfer and a document load create."""
    target, base = new_table(spark, "created")
    mappings = {"o_orderkey": "OrderKey", "o_totalprice": "Total", "o_orderdate": "Ordered"}
    options = TransferOptions(mappings, create_if_missing=True, base=base)
    _checked(transfer(spark, table(spark, folder, "orders"), target, options))
    loaded, loaded_base = new_table(spark, "created_docs")
    events = table(spark, folder, "events").select("props")
    _checked(load_documents(events, "props", loaded, options=LoadOptions(base=loaded_base)))
    found = [("transfer", c.name, c.dataType) for c in spark.catalog.listColumns(target)]
    found += [("documents", c.name, c.dataType) for c in spark.catalog.listColumns(loaded)]
    return spark.createDataFrame(found, "made_by string, name string, type string")
