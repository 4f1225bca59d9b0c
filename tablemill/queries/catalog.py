"""Catalog and key queries."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame, functions as F

from tablemill.operators import catalog as ops, keys, profiles
from tablemill.operators.sync import duplicate_keys
from tablemill.plans.profiles import table_profile, update_profile
from tablemill.queries.registry import TABLES, new_table, query, table
from tablemill.session import staged
from tablemill.sinks import tables

# Column types of the given tables, for the SQL twin of the column inventory.
TYPES = {
    "benchmark": "item_id bigint, text string",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
    "c_mktsegment string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
    "value double, props string",
    "labels": "doc_id bigint, quality int, toxic int",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
    "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
    "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "pages": "page_id bigint, url string, html string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
    "p_retailprice double",
    "region": "r_regionkey int, r_name string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
}

PRIMARY_KEYS = {
    "customer": ["c_custkey"],
    "events": ["event_id"],
    "orders": ["o_orderkey"],
    "part": ["p_partkey"],
}
IDENTITIES = {"events": "event_id"}


def _column_sql() -> str:
    selects = []
    for name, columns in TYPES.items():
        for ordinal, column in enumerate(columns.split(", "), start=1):
            field, data_type = column.split(" ")
            selects.append(
                f"SELECT 'dbo' AS schema_name, '{name}' AS table_name, {ordinal} AS ordinal, "
                f"'{field}' AS column_name, {field in PRIMARY_KEYS.get(name, [])} AS is_primary_key, "
                f"{field == IDENTITIES.get(name)} AS is_identity, '{data_type}' AS data_type, "
                "CAST(NULL AS BIGINT) AS max_length, true AS is_nullable, "
                f"(SELECT count(*) FROM {name}) AS n_rows"
            )
    return " UNION ALL ".join(selects)


def _profile_columns_sql() -> str:
    selects = []
    for name, columns in TYPES.items():
        for ordinal, column in enumerate(columns.split(", "), start=1):
            field, data_type = column.split(" ")
            longest = f"max(length({field}))" if data_type == "string" else "CAST(NULL AS BIGINT)"
            selects.append(
                f"SELECT 'dbo' AS schema_name, '{name}' AS table_name, {ordinal} AS ordinal, "
                f"'{field}' AS column_name, {longest} AS longest, "
                f"count(*) FILTER ({field} IS NULL) AS n_null FROM {name}"
            )
    return " UNION ALL ".join(selects)


def _tables(spark, folder):
    return {name: table(spark, folder, name) for name in TABLES}


@query(
    " UNION ALL ".join(
        f"SELECT 'dbo' AS schema_name, '{t}' AS table_name, count(*) AS row_count FROM {t}"
        for t in TABLES
    )
)
def table_inventory(spark, folder):
    return ops.table_inventory(_tables(spark, folder))


@query(_column_sql())
def column_inventory(spark, folder):
    """Columns of the given tables, beside the row counts of their tables."""
    tables = _tables(spark, folder)
    sizes = ops.table_inventory(tables).select("table_name", F.col("row_count").alias("n_rows"))
    return ops.column_inventory(tables, PRIMARY_KEYS, IDENTITIES).join(sizes, "table_name")


@query(_profile_columns_sql())
def column_profile(spark, folder):
    return ops.column_profile(_tables(spark, folder))


def _profile_sql(name: str, candidates: list[list[str]]) -> str:
    selects = []
    for columns in candidates:
        some_null = " OR ".join(f"{c} IS NULL" for c in columns)
        selects.append(
            f"SELECT '{','.join(columns)}' AS key_columns, CAST(sum(n) AS BIGINT) AS n_rows, "
            "count(*) AS n_distinct, "
            f"CAST(coalesce(sum(n) FILTER ({some_null}), 0) AS BIGINT) AS n_null, "
            f"sum(n) = count(*) AND coalesce(sum(n) FILTER ({some_null}), 0) = 0 AS is_key "
            f"FROM (SELECT {', '.join(columns)}, count(*) AS n FROM {name} GROUP BY ALL) q"
        )
    return " UNION ALL ".join(selects)


ORDER_KEYS = [["o_orderkey"], ["o_custkey"], ["o_custkey", "o_orderdate"]]
LINE_KEYS = [["l_orderkey", "l_linenumber"], ["l_orderkey"], ["l_returnflag"]]


@query(_profile_sql("orders", ORDER_KEYS))
def key_profile(spark, folder):
    return keys.key_profile(table(spark, folder, "orders"), ORDER_KEYS)


@query(_profile_sql("lineitem", LINE_KEYS))
def key_profile_lines(spark, folder):
    return keys.key_profile(table(spark, folder, "lineitem"), LINE_KEYS)


def _minimal_keys_sql(name: str, most: int = 3) -> str:
    """All sets of up to so many columns, one by one; those that are keys and hold no smaller one."""
    columns = [c.split()[0] for c in TYPES[name].split(", ")]
    tests = [
        f"SELECT '{','.join(s)}' AS key_columns, {len(s)} AS n_columns, "
        f"(SELECT count(*) FROM (SELECT DISTINCT {', '.join(s)} FROM {name} "
        f"WHERE {' AND '.join(f'{c} IS NOT NULL' for c in s)})) = (SELECT count(*) FROM {name}) AS is_key"
        for n in range(1, most + 1)
        for s in combinations(columns, n)
    ]
    return (
        f"WITH t AS MATERIALIZED ({' UNION ALL '.join(tests)}) SELECT '{name}' AS table_name, key_columns, n_columns FROM t a "
        "WHERE is_key AND NOT EXISTS (SELECT 1 FROM t b WHERE b.is_key AND b.n_columns < a.n_columns "
        "AND list_has_all(string_split(a.key_columns, ','), string_split(b.key_columns, ',')))"
    )


DISCOVERED_IN = ["events", "lineitem"]


@query(" UNION ALL ".join(f"({_minimal_keys_sql(t)})" for t in DISCOVERED_IN))
def key_discovery(spark, folder):
    """Minimal keys of up to three columns, with no candidates given."""
    found = [(t, ",".join(k), len(k)) for t in DISCOVERED_IN for k in keys.discovered_keys(table(spark, folder, t))]
    return spark.createDataFrame(found, "table_name string, key_columns string, n_columns int")


# Index rows as the data itself suggests them: each candidate key is an index, unique if its
# values are, and the first is the primary key if it is one. Dates run downwards.
CANDIDATES = {
    "orders": [["o_orderkey"], ["o_orderdate", "o_custkey"], ["o_custkey"]],
    "lineitem": [["l_shipdate"], ["l_orderkey", "l_linenumber"], ["l_orderkey"]],
    "customer": [["c_custkey"], ["c_name"], ["c_nationkey"]],
    "events": [["event_id"], ["user_id", "ts"]],
}


def _indexes(spark, folder):
    parts = []
    for name, candidates in CANDIDATES.items():
        listed = F.array(*[F.lit(",".join(c)) for c in candidates])
        found = keys.key_profile(table(spark, folder, name), candidates)
        found = found.withColumn("index_id", F.array_position(listed, F.col("key_columns")).cast("int"))
        parts.append(
            found.select(
                F.lit("dbo").alias("schema_name"),
                F.lit(name).alias("table_name"),
                F.concat(F.lit(f"IX_{name}_"), "index_id").alias("index_name"),
                "index_id",
                (F.col("is_key") & (F.col("index_id") == 1)).alias("is_primary_key"),
                F.col("is_key").alias("is_unique"),
                F.posexplode(F.split("key_columns", ",")).alias("key_ordinal", "column_name"),
            )
        )
    rows = reduce(DataFrame.unionAll, parts)
    return rows.select("*", F.col("column_name").endswith("date").alias("is_descending"), F.lit(False).alias("is_included"))


def _summary_sql() -> str:
    selects = []
    for name, candidates in CANDIDATES.items():
        for i, columns in enumerate(candidates, start=1):
            orders = ",".join("DESC" if c.endswith("date") else "ASC" for c in columns)
            selects.append(
                f"SELECT '{name}' AS table_name, 'IX_{name}_{i}' AS index_name, {i} AS index_id, "
                f"is_key AND {i} = 1 AS is_primary_key, is_key AS is_unique, key_columns, "
                f"'{orders}' AS orders FROM ({_profile_sql(name, [columns])}) p"
            )
    return " UNION ALL ".join(selects)


SUMMARY_SQL = _summary_sql()


@query(SUMMARY_SQL)
def index_summary(spark, folder):
    return keys.index_summary(_indexes(spark, folder)).drop("schema_name")


@query(
    f"""
SELECT * FROM ({SUMMARY_SQL}) q WHERE is_primary_key OR is_unique
QUALIFY row_number() OVER (PARTITION BY table_name ORDER BY is_primary_key DESC, index_id) = 1
"""
)
def top_key(spark, folder):
    return keys.top_key(_indexes(spark, folder)).drop("schema_name")


def _held_sql(name: str, columns: str) -> str:
    return (
        f"SELECT '{name}' AS table_name, '{columns}' AS key_columns, count(*) AS n_repeated "
        f"FROM (SELECT {columns} FROM {name} GROUP BY {columns} HAVING count(*) > 1) q"
    )


@query(
    " UNION ALL ".join(
        [
            _held_sql("orders", "o_orderkey"),
            _held_sql("events", "event_id"),
            _held_sql("customer", "c_custkey"),
        ]
    )
)
def declared_key(spark, folder):
    """Each table's declared key, and how many keys the data repeats."""
    indexes = staged(_indexes(spark, folder))
    parts = []
    for name in ("orders", "events", "customer"):
        columns = keys.declared_key(indexes, f"dbo.{name}")
        repeated = duplicate_keys(table(spark, folder, name), columns)
        parts.append(
            repeated.agg(F.count(F.lit(1)).alias("n_repeated")).select(
                F.lit(name).alias("table_name"),
                F.lit(",".join(columns)).alias("key_columns"),
                "n_repeated",
            )
        )
    return reduce(DataFrame.unionAll, parts)


# Tables whose profiles are kept: by what they are partitioned, and the rows that come later.
PROFILED = {"orders": ("o_orderpriority", "o_orderstatus = 'P'"), "events": ("event_type", "value > 90")}


def _merged_sql() -> str:
    selects = []
    for name in PROFILED:
        for ordinal, column in enumerate(TYPES[name].split(", "), start=1):
            field, kind = column.split(" ")
            number = {"string": "NULL", "timestamp_ntz": f"epoch({field})"}.get(kind, field)
            text = f"left({field}, {profiles.CUT})" if kind == "string" else "NULL"
            longest = f"max(length({field}))" if kind == "string" else "NULL"
            selects.append(
                f"SELECT '{name}' AS table_name, '{field}' AS column_name, count(*) AS n_rows, count(*) - count({field}) AS n_null, "
                f"count({field}) AS n_values, CAST({longest} AS BIGINT) AS longest, "
                f"min(CAST({number} AS DOUBLE)) AS least_number, max(CAST({number} AS DOUBLE)) AS most_number, "
                f"min(CAST({text} AS VARCHAR)) AS least_text, max(CAST({text} AS VARCHAR)) AS most_text, "
                f"TRUE AS distinct_holds, {'NULL' if kind == 'string' else 'TRUE'} AS median_holds FROM {name}"
            )
    return " UNION ALL ".join(selects)


@query(_merged_sql())
def profile_merged(spark, folder):
    """Profiles kept by partition, brought up to date after an append, and how well their sketches hold."""
    parts = []
    for name, (by, late) in PROFILED.items():
        rows = table(spark, folder, name)
        target, base = new_table(spark, f"profiled_{name}")
        tables.create_table(spark, target, rows.schema, base, [by])
        for some in (f"NOT coalesce({late}, FALSE)", late):
            tables.append(tables.arranged(rows.where(some), target), target)
            done = update_profile(spark, target, f"{target}_profile", base)
            if not done.ok:
                raise RuntimeError(done.error)
        found = table_profile(spark, target, f"{target}_profile")
        parts.append(_held(found, rows).select(F.lit(name).alias("table_name"), "*"))
    return reduce(DataFrame.unionAll, parts)


def _held(found: DataFrame, rows: DataFrame) -> DataFrame:
    """The exact parts of profiles, and whether distinct counts and medians are within their stated errors.

    Counted from the rows, a column at a time.
    """
    spark = rows.sparkSession
    told = {r["column_name"]: r for r in found.select("column_name", "quantiles").collect()}
    counted = []
    for field in rows.schema:
        value = F.col(field.name)
        number = F.unix_micros(value.cast("timestamp")) / 1e6 if "timestamp" in field.dataType.simpleString() else value
        told_median = told[field.name]["quantiles"]
        below = F.lit(None).cast("double")
        up_to = F.lit(None).cast("double")
        if told_median is not None:
            below = F.avg((number < told_median[2]).cast("int"))
            up_to = F.avg((number <= told_median[2]).cast("int"))
        counted.append(
            rows.agg(F.count_distinct(value).alias("d"), below.alias("below"), up_to.alias("up_to"))
            .select(F.lit(field.name).alias("column_name"), "*")
        )
    seen = spark.createDataFrame(reduce(DataFrame.unionAll, counted).collect(), "column_name string, d long, below double, up_to double")
    errors = F.abs(F.col("n_distinct") - F.col("d")) <= 4 * profiles.DISTINCT_ERROR * F.col("d") + 1
    median = (F.col("below") <= 0.5 + profiles.RANK_ERROR) & (F.col("up_to") >= 0.5 - profiles.RANK_ERROR)
    facts = ["n_rows", "n_null", "n_values", "longest", "least_number", "most_number", "least_text", "most_text"]
    return found.join(seen, "column_name").select("column_name", *facts, errors.alias("distinct_holds"), median.alias("median_holds"))
