"""Sync queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablemill.metrics import RunResult
from tablemill.operators import sync as ops
from tablemill.plans.sync import SyncOptions, sync_table
from tablemill.queries.registry import new_table, query, sql, table
from tablemill.session import staged
from tablemill.sinks import tables

# Orders with status and total recomputed from their lines.
RECOMPUTED_ORDERS = """
SELECT o.o_orderkey, o.o_custkey, i.o_orderstatus, i.o_totalprice, o.o_orderdate, o.o_orderpriority
FROM orders o JOIN (
  SELECT l_orderkey,
         CASE WHEN min(l_linestatus) = max(l_linestatus) THEN min(l_linestatus) ELSE 'P' END
           AS o_orderstatus,
         sum(CAST(round(l_extendedprice * 100) AS BIGINT)) / CAST(100 AS DOUBLE) AS o_totalprice
  FROM lineitem GROUP BY l_orderkey
) i ON o.o_orderkey = i.l_orderkey
"""

# Returned lines, issued again without their discount. Their keys repeat.
REISSUED_LINES = """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice,
       CAST(0 AS DOUBLE) AS l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate
FROM lineitem WHERE l_returnflag = 'R'
"""
LINE_KEY = ["l_orderkey", "l_linenumber"]


@query(
    f"""
WITH src AS ({RECOMPUTED_ORDERS})
SELECT * FROM orders t WHERE NOT EXISTS (SELECT 1 FROM src s WHERE s.o_orderkey = t.o_orderkey)
UNION ALL SELECT * FROM src
"""
)
def sync_delete_insert(spark, folder):
    source = staged(sql(spark, folder, RECOMPUTED_ORDERS))
    return ops.delete_insert(table(spark, folder, "orders"), source, ["o_orderkey"])


@query(
    f"""
WITH src AS ({REISSUED_LINES})
SELECT * FROM lineitem t WHERE NOT EXISTS (
  SELECT 1 FROM src s WHERE s.l_orderkey = t.l_orderkey AND s.l_linenumber = t.l_linenumber)
UNION ALL SELECT * FROM src
"""
)
def sync_duplicate_source_keys(spark, folder):
    source = sql(spark, folder, REISSUED_LINES)
    return ops.delete_insert(table(spark, folder, "lineitem"), source, LINE_KEY)


# Urgent orders have no key here.
MAYBE_KEYED = """
SELECT CASE WHEN o_orderpriority = '1-URGENT' THEN NULL ELSE o_orderkey END AS k,
       o_custkey, o_orderstatus, o_totalprice FROM orders
"""


@query(
    f"""
WITH tgt AS ({MAYBE_KEYED}),
     src AS (SELECT k, o_custkey, 'X' AS o_orderstatus, o_totalprice
             FROM ({MAYBE_KEYED}) q WHERE o_orderstatus = 'F')
SELECT * FROM tgt t WHERE NOT EXISTS (SELECT 1 FROM src s WHERE s.k = t.k)
UNION ALL SELECT * FROM src
"""
)
def sync_null_keys(spark, folder):
    target = sql(spark, folder, MAYBE_KEYED)
    source = target.where("o_orderstatus = 'F'").withColumn("o_orderstatus", F.lit("X"))
    return ops.delete_insert(target, source, ["k"])


CUSTOMERS_AS_SUPPLIERS = {
    "c_custkey": "s_suppkey",
    "c_name": "s_name",
    "c_nationkey": "s_nationkey",
    "c_acctbal": "s_acctbal",
}


@query(
    """
SELECT c_custkey AS s_suppkey, c_name AS s_name, c_nationkey AS s_nationkey,
       c_acctbal AS s_acctbal FROM customer
"""
)
def sync_full_refresh(spark, folder):
    source = table(spark, folder, "customer").drop("c_mktsegment")
    return ops.full_refresh(table(spark, folder, "supplier"), source, CUSTOMERS_AS_SUPPLIERS)


@query("SELECT * FROM customer")
def sync_empty_source(spark, folder):
    target = table(spark, folder, "customer")
    return ops.full_refresh(target, target.where("c_acctbal > 1e12"))


@query(
    f"""
WITH src AS ({REISSUED_LINES}),
     del AS (SELECT count(*) AS n FROM lineitem t WHERE EXISTS (
       SELECT 1 FROM src s WHERE s.l_orderkey = t.l_orderkey AND s.l_linenumber = t.l_linenumber))
SELECT (SELECT count(*) FROM src) AS rows_read, (SELECT n FROM del) AS rows_deleted,
       (SELECT count(*) FROM src) AS rows_inserted,
       (SELECT count(*) FROM lineitem) - (SELECT n FROM del) + (SELECT count(*) FROM src)
         AS rows_after
"""
)
def sync_metrics(spark, folder):
    source = sql(spark, folder, REISSUED_LINES)
    return ops.sync_counts(table(spark, folder, "lineitem"), source, LINE_KEY)


FRENCH_LABELS = """
SELECT doc_id, CASE WHEN n_chars > 500 THEN 1 ELSE 0 END AS quality
FROM documents WHERE lang = 'fr'
"""


@query(
    f"""
WITH src AS ({FRENCH_LABELS})
SELECT doc_id, quality, toxic FROM labels t
WHERE NOT EXISTS (SELECT 1 FROM src s WHERE s.doc_id = t.doc_id)
UNION ALL SELECT doc_id, quality, NULL FROM src
"""
)
def sync_missing_columns(spark, folder):
    source = sql(spark, folder, FRENCH_LABELS)
    return ops.delete_insert(table(spark, folder, "labels"), source, ["doc_id"])


SUPPLIERS_AS_CUSTOMERS = {
    "s_suppkey": "c_custkey",
    "s_name": "c_name",
    "s_nationkey": "c_nationkey",
    "s_acctbal": "c_acctbal",
}


@query(
    """
SELECT * FROM customer t WHERE NOT EXISTS (
  SELECT 1 FROM supplier s WHERE s.s_suppkey = t.c_custkey)
UNION ALL SELECT s_suppkey, s_name, s_nationkey, s_acctbal, NULL FROM supplier
"""
)
def sync_renamed(spark, folder):
    return ops.delete_insert(
        table(spark, folder, "customer"),
        table(spark, folder, "supplier"),
        ["s_suppkey"],
        SUPPLIERS_AS_CUSTOMERS,
    )


SHOUTED = "SELECT c_custkey, concat(lower(c_name), ' ') AS c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer"


@query(
    f"""
WITH src AS (SELECT * FROM ({SHOUTED}) q WHERE c_mktsegment = 'BUILDING')
SELECT * FROM customer t WHERE NOT EXISTS (
  SELECT 1 FROM src s WHERE lower(rtrim(s.c_name)) = lower(rtrim(t.c_name)))
UNION ALL SELECT * FROM src
"""
)
def sync_collated_keys(spark, folder):
    source = sql(spark, folder, SHOUTED).where("c_mktsegment = 'BUILDING'")
    target = table(spark, folder, "customer")
    return ops.delete_insert(target, source, ["c_name"], key_collation="UTF8_LCASE_RTRIM")


@query(
    """
SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem
GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
"""
)
def source_duplicate_keys(spark, folder):
    return ops.duplicate_keys(table(spark, folder, "lineitem"), LINE_KEY)


def _checked(result: RunResult) -> RunResult:
    if not result.ok:
        raise RuntimeError(result.error)
    return result


def _lake_table(spark, df, name, partition_by=()):
    """A lake table with the rows of a frame."""
    target, base = new_table(spark, f"lake_{name}")
    tables.create_table(spark, target, df.schema, base, partition_by)
    tables.append(tables.arranged(df, target), target)
    return target


def _lake_copy(spark, folder, name, partition_by=()):
    """A lake table with the rows of a given table."""
    return _lake_table(spark, table(spark, folder, name), name, partition_by)


@query(
    f"""
WITH src AS ({REISSUED_LINES})
SELECT * FROM lineitem t WHERE NOT EXISTS (
  SELECT 1 FROM src s WHERE s.l_orderkey = t.l_orderkey AND s.l_linenumber = t.l_linenumber)
UNION ALL SELECT * FROM src
"""
)
def sync_published(spark, folder):
    target = _lake_copy(spark, folder, "lineitem")
    source = sql(spark, folder, REISSUED_LINES)
    _checked(sync_table(spark, source, target, LINE_KEY))
    return spark.table(target)


@query(
    f"""
WITH src AS ({REISSUED_LINES})
SELECT * FROM lineitem t WHERE NOT EXISTS (
  SELECT 1 FROM src s WHERE s.l_orderkey = t.l_orderkey AND s.l_linenumber = t.l_linenumber)
UNION ALL SELECT * FROM src
"""
)
def sync_bucketed(spark, folder):
    """Into a table dealt over hidden buckets of its key: only those of the source's keys are rewritten."""
    lines = table(spark, folder, "lineitem")
    target, base = new_table(spark, "lake_buckets")
    tables.create_table(spark, target, lines.schema, base, bucket_by=LINE_KEY, buckets=32)
    tables.append(tables.arranged(lines, target), target)
    _checked(sync_table(spark, sql(spark, folder, REISSUED_LINES), target, LINE_KEY))
    return tables.read(spark, target)


FILE_ROWS = 1000


@query(
    """
SELECT o_orderstatus, count(*) AS n_rows, TRUE AS no_file_over
FROM orders GROUP BY o_orderstatus
"""
)
def sync_file_batches(spark, folder):
    """A sync of a partitioned table with so many rows a file at most."""
    target = _lake_copy(spark, folder, "orders", ["o_orderstatus"])
    source = table(spark, folder, "orders").where("o_orderkey % 2 = 0")
    _checked(sync_table(spark, source, target, ["o_orderkey"], SyncOptions(max_records_per_file=FILE_ROWS)))
    files = spark.table(target).groupBy("o_orderstatus", F.input_file_name().alias("file")).agg(F.count(F.lit(1)).alias("n"))
    per = files.groupBy("o_orderstatus").agg(F.sum("n").alias("n_rows"), F.max("n").alias("most"))
    return per.select("o_orderstatus", "n_rows", (F.col("most") <= FILE_ROWS).alias("no_file_over"))


REPRICED = """
SELECT o_orderkey, o_custkey, o_orderstatus, CAST(0 AS DOUBLE) AS o_totalprice, o_orderdate,
       o_orderpriority FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority = '1-URGENT'
"""


@query(
    f"""
WITH src AS ({REPRICED})
SELECT * FROM orders t WHERE NOT EXISTS (
  SELECT 1 FROM src s WHERE s.o_orderkey = t.o_orderkey AND s.o_orderstatus = t.o_orderstatus)
UNION ALL SELECT * FROM src
"""
)
def sync_partitioned(spark, folder):
    target = _lake_copy(spark, folder, "orders", ["o_orderstatus"])
    source = sql(spark, folder, REPRICED)
    _checked(sync_table(spark, source, target, ["o_orderkey", "o_orderstatus"]))
    return spark.table(target)


@query(
    f"""
WITH src AS ({RECOMPUTED_ORDERS})
SELECT (SELECT count(*) FROM src) AS rows_read,
       (SELECT count(*) FROM orders t WHERE EXISTS (
          SELECT 1 FROM src s WHERE s.o_orderkey = t.o_orderkey)) AS rows_deleted,
       (SELECT count(*) FROM src) AS rows_inserted, (SELECT count(*) FROM src) AS rows_written
"""
)
def sync_run_metrics(spark, folder):
    target = _lake_copy(spark, folder, "orders")
    source = sql(spark, folder, RECOMPUTED_ORDERS)
    r = _checked(
        sync_table(spark, source, target, ["o_orderkey"], SyncOptions(unique_keys=True))
    )
    row = (r.rows_read, r.rows_deleted, r.rows_inserted, r.rows_written)
    names = ("rows_read", "rows_deleted", "rows_inserted", "rows_written")
    return spark.createDataFrame([row], ", ".join(f"{n} bigint" for n in names))


REFUSALS = [
    ("unknown key", "The source has no key column 'nope'"),
    ("extra column", "Source columns not in target: extra"),
    ("repeated keys", "Source has duplicate keys: l_orderkey, l_linenumber"),
    ("null keys", "Source has NULL keys: l_orderkey"),
    ("no keys", "No key columns given"),
]
_REFUSALS_SQL = ", ".join("('{}', '{}')".format(c, m.replace("'", "''")) for c, m in REFUSALS)


@query(
    f"""
SELECT attempt, message, n_rows FROM (VALUES {_REFUSALS_SQL}) v(attempt, message),
  (SELECT count(*) AS n_rows FROM lineitem) n
"""
)
def sync_refusals(spark, folder):
    """Syncs that must be refused, why, and the rows the target still has after each."""
    target = _lake_copy(spark, folder, "lineitem")
    lines = table(spark, folder, "lineitem")
    unkeyed = lines.withColumn("l_orderkey", F.expr("nullif(l_orderkey, l_orderkey)"))
    attempts = {
        "unknown key": (lines, ["nope"], SyncOptions()),
        "extra column": (lines.withColumn("extra", F.lit(1)), LINE_KEY, SyncOptions()),
        "repeated keys": (lines, LINE_KEY, SyncOptions(unique_keys=True)),
        "null keys": (unkeyed, ["l_orderkey"], SyncOptions(reject_null_keys=True)),
        "no keys": (lines, [], SyncOptions()),
    }
    found = []
    for attempt, (source, keys, options) in attempts.items():
        result = sync_table(spark, source, target, keys, options)
        found.append((attempt, result.error, spark.table(target).count()))
    return spark.createDataFrame(found, "attempt string, message string, n_rows bigint")


# Orders by month, and urgent ones moved to another month: the partition is no part of the key.
MONTHLY = """
SELECT o_orderkey, o_totalprice, month(o_orderdate) AS o_month FROM orders
"""
MOVED = """
SELECT o_orderkey, o_totalprice, 1 + (month(o_orderdate) * 5) % 12 AS o_month
FROM orders WHERE o_orderpriority = '1-URGENT' AND month(o_orderdate) < 4
"""


@query(
    f"""
WITH src AS ({MOVED}), tgt AS ({MONTHLY})
SELECT * FROM tgt t WHERE NOT EXISTS (SELECT 1 FROM src s WHERE s.o_orderkey = t.o_orderkey)
UNION ALL SELECT * FROM src
"""
)
def sync_by_month(spark, folder):
    """Rows leave one partition and arrive in another; the partition is no key column."""
    target = _lake_table(spark, sql(spark, folder, MONTHLY), "monthly", ["o_month"])
    _checked(sync_table(spark, sql(spark, folder, MOVED), target, ["o_orderkey"]))
    return spark.table(target)


DEALT = "SELECT o_orderkey, o_totalprice, CAST(o_custkey % 600 AS INT) AS part FROM orders"


@query(
    f"""
WITH src AS (SELECT o_orderkey, -1.0::DOUBLE AS o_totalprice, part FROM ({DEALT}) d WHERE o_orderkey % 2 = 0)
SELECT * FROM ({DEALT}) t WHERE NOT EXISTS (SELECT 1 FROM src s WHERE s.o_orderkey = t.o_orderkey)
UNION ALL SELECT * FROM src
"""
)
def sync_many_partitions(spark, folder):
    """A sync that touches hundreds of partitions."""
    dealt = sql(spark, folder, DEALT)
    target = _lake_table(spark, dealt, "dealt", ["part"])
    source = dealt.where("o_orderkey % 2 = 0").withColumn("o_totalprice", F.lit(-1.0))
    _checked(sync_table(spark, source, target, ["o_orderkey"]))
    return spark.table(target)


SEGMENTS = "SELECT c_custkey, c_acctbal, c_mktsegment FROM customer"


@query(
    f"""
WITH src AS (SELECT c_custkey, c_acctbal, lower(c_mktsegment) AS c_mktsegment
             FROM customer WHERE c_mktsegment <> 'BUILDING')
SELECT * FROM ({SEGMENTS}) t WHERE NOT EXISTS (
  SELECT 1 FROM src s WHERE s.c_custkey = t.c_custkey AND s.c_mktsegment = lower(t.c_mktsegment))
UNION ALL SELECT * FROM src
"""
)
def sync_collated_partition(spark, folder):
    """A partition column in the key, compared without case: whole partitions are replaced."""
    rows = sql(spark, folder, SEGMENTS)
    target = _lake_table(spark, rows, "segments", ["c_mktsegment"])
    source = rows.where("c_mktsegment <> 'BUILDING'").withColumn("c_mktsegment", F.lower("c_mktsegment"))
    options = SyncOptions(key_collation="UTF8_LCASE")
    _checked(sync_table(spark, source, target, ["c_custkey", "c_mktsegment"], options))
    return spark.table(target)


DECLARED = [
    ("dbo", "PK", 1, True, True, "c_custkey", 1),
    ("dbo", "UX_name", 2, False, True, "c_name", 1),
    ("dbo", "UX_balance", 3, False, True, "c_acctbal", 1),
]
DECLARED_MESSAGE = "Source has duplicate keys: c_name"


@query(
    f"""
SELECT 'named' AS attempt, '{DECLARED_MESSAGE}' AS message, count(*) AS n_rows,
       CAST(count(*) AS BIGINT) AS n_old FROM customer
UNION ALL
SELECT 'without names', NULL, count(*), count(*) FILTER (c_custkey % 3 <> 0) FROM customer
"""
)
def sync_declared_unique(spark, folder):
    """A repeated value in a second unique index refuses the sync; an index not given is skipped."""
    customers = table(spark, folder, "customer").select("c_custkey", "c_name", "c_acctbal")
    target = _lake_table(spark, customers, "customer")
    names = "schema_name string, index_name string, index_id int, is_primary_key boolean, is_unique boolean, column_name string, key_ordinal int"
    indexes = spark.createDataFrame(DECLARED, names).select(
        "*", F.lit(target).alias("table_name"), F.lit(False).alias("is_descending"), F.lit(False).alias("is_included")
    )
    changed = customers.where("c_custkey % 3 = 0")
    # Two keys share a name; no balance is given, so its index says nothing.
    attempts = {
        "named": changed.select("c_custkey", F.lit("same").alias("c_name")),
        "without names": changed.select("c_custkey"),
    }
    found = []
    for attempt, source in attempts.items():
        result = sync_table(spark, source, target, declared_indexes=indexes)
        left = spark.table(target).agg(F.count("*").alias("n"), F.count("c_name").alias("named")).first()
        found.append((attempt, result.error, left["n"], left["named"]))
    return spark.createDataFrame(found, "attempt string, message string, n_rows bigint, n_old bigint")


# Each nation's largest order, moved to the month of all such corrections.
CORRECTED = """
SELECT o_orderkey, -o_totalprice AS o_totalprice, 13 AS o_month FROM (
  SELECT o_orderkey, o_totalprice, row_number() OVER (
    PARTITION BY c_nationkey ORDER BY o_totalprice DESC, o_orderkey) AS place
  FROM orders JOIN customer ON c_custkey = o_custkey) q
WHERE place = 1
"""


@query(
    f"""
WITH src AS ({CORRECTED}), tgt AS ({MONTHLY})
SELECT * FROM tgt t WHERE NOT EXISTS (SELECT 1 FROM src s WHERE s.o_orderkey = t.o_orderkey)
UNION ALL SELECT * FROM src
"""
)
def sync_looked_up(spark, folder):
    """A few keys in a table partitioned by something else: its files' Bloom filters tell where they are."""
    rows = sql(spark, folder, MONTHLY)
    target, base = new_table(spark, "lake_looked_up")
    tables.create_table(spark, target, rows.schema, base, ["o_month"], lookup_by=["o_orderkey"])
    tables.append(tables.arranged(rows, target), target)
    _checked(sync_table(spark, sql(spark, folder, CORRECTED), target, ["o_orderkey"]))
    return spark.table(target)
