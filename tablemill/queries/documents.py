"""Document queries. The documents are built from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablemill.operators import documents as ops
from tablemill.operators.documents import DocumentOptions
from tablemill.operators.pipelines import VariantFields, apply_pipeline, document_filter, document_predicate
from tablemill.plans.documents import LoadOptions, load_documents, load_raw_json
from tablemill.queries.registry import new_table, query, sql, table
from tablemill.queries.sync import _checked
from tablemill.session import work_path
from tablemill.sources.scans import document_scan

CUSTOMER_DOCS = """
SELECT c_custkey, to_json(named_struct(
  '_id', c_custkey, 'name', c_name, 'segment', c_mktsegment,
  'nation', named_struct('key', n_nationkey, 'name', n_name,
    'region', named_struct('key', r_regionkey, 'name', r_name)))) AS js
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
"""
CUSTOMER_ROWS = """
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
"""


@query(
    f"""
SELECT c_name AS name, c_mktsegment AS segment, CAST(n_nationkey AS BIGINT) AS nation_key,
       n_name AS nation_name, CAST(r_regionkey AS BIGINT) AS nation_region_key,
       r_name AS nation_region_name {CUSTOMER_ROWS}
"""
)
def doc_flatten(spark, folder):
    return ops.flatten_documents(sql(spark, folder, CUSTOMER_DOCS), "js")


@query(
    f"""
SELECT c_custkey AS customer_id, c_name AS name, n_name AS nation__name,
       r_name AS region {CUSTOMER_ROWS}
"""
)
def doc_flatten_sep(spark, folder):
    options = DocumentOptions(
        separator="__",
        include_fields=["_id", "name", "nation__name", "nation__region__name"],
        field_mappings={"_id": "customer_id", "nation__region__name": "region"},
    )
    return ops.flatten_documents(sql(spark, folder, CUSTOMER_DOCS), "js", options)


@query(
    f"""
SELECT c_name AS name, CAST(n_nationkey AS BIGINT) AS nation_key, r_name AS nation_region_name
{CUSTOMER_ROWS}
"""
)
def doc_include_exclude(spark, folder):
    options = DocumentOptions(
        exclude_fields=["_id", "segment", "nation_name", "nation_region_key"]
    )
    return ops.flatten_documents(sql(spark, folder, CUSTOMER_DOCS), "js", options)


@query(
    f"""
SELECT c_name AS name, c_mktsegment AS segment,
       '{{"key":' || n_nationkey || ',"name":"' || n_name || '","region":{{"key":' || r_regionkey
         || ',"name":"' || r_name || '"}}}}' AS nation {CUSTOMER_ROWS}
"""
)
def doc_shallow(spark, folder):
    options = DocumentOptions(flatten=False)
    return ops.flatten_documents(sql(spark, folder, CUSTOMER_DOCS), "js", options)


LINE_DOCS = """
SELECT to_json(named_struct('order', l_orderkey, 'line', l_linenumber,
                            'ids', array(l_partkey, l_suppkey))) AS js FROM lineitem
"""


def _line_docs(spark, folder, mode):
    docs = sql(spark, folder, LINE_DOCS)
    return ops.flatten_documents(docs, "js", DocumentOptions(array_handling=mode))


@query(
    """
SELECT '[' || l_partkey || ',' || l_suppkey || ']' AS ids, CAST(l_linenumber AS BIGINT) AS line,
       l_orderkey AS "order" FROM lineitem
"""
)
def doc_array_serialize(spark, folder):
    return _line_docs(spark, folder, "Json")


@query(
    """
SELECT l_partkey AS ids, CAST(l_linenumber AS BIGINT) AS line, l_orderkey AS "order" FROM lineitem
"""
)
def doc_array_first(spark, folder):
    return _line_docs(spark, folder, "FirstElement")


@query('SELECT CAST(l_linenumber AS BIGINT) AS line, l_orderkey AS "order" FROM lineitem')
def doc_array_skip(spark, folder):
    return _line_docs(spark, folder, "SKIP")


@query(
    """
SELECT event_id, user_id, value FROM events
WHERE event_type = 'purchase' AND value > 10 AND value <= 90.5 AND user_id <> 3
"""
)
def doc_filter(spark, folder):
    spec = {
        "event_type": "purchase",
        "value": {"$gt": 10, "$lte": 90.5},
        "user_id": {"$ne": 3},
    }
    return document_filter(table(spark, folder, "events"), spec).select(
        "event_id", "user_id", "value"
    )


def _columns(docs):
    """Good documents as columns, nested ones as structs."""
    schema = ops.infer_document_schema(docs, "js")
    return ops.read_documents(ops.only_parsed(docs, "js"), "js", schema)


EVENT_DOCS = """
SELECT event_id, concat('{"_id":', event_id, ',"type":"', event_type, '","user":', user_id,
                        ',"props":', props, '}') AS js FROM events
"""


@query(
    """
SELECT event_type AS type, count(*) AS n,
       CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS total
FROM events WHERE user_id >= 10 GROUP BY event_type
"""
)
def doc_pipeline(spark, folder):
    stages = [
        {"$match": {"user": {"$gte": 10}}},
        {"$group": {"_id": "$type", "n": {"$sum": 1}, "total": {"$sum": "$props.k"}}},
    ]
    rows = apply_pipeline(_columns(sql(spark, folder, EVENT_DOCS)), stages)
    return ops.flatten(rows, DocumentOptions(field_mappings={"_id": "type"}), keep_id=True)


ORDER_DOCS = """
SELECT to_json(named_struct(
  '_id', named_struct('$oid', hex(o_orderkey)), 'orderId', o_orderkey, 'status', o_orderstatus,
  'priority', o_orderpriority, 'customer', named_struct('name', c_name, 'segment', c_mktsegment)
)) AS js FROM orders JOIN customer ON o_custkey = c_custkey
"""


@query(
    """
SELECT o_orderkey AS "orderId", o_orderpriority AS priority, c_name AS "customerName"
FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F'
"""
)
def doc_project(spark, folder):
    stages = [
        {"$match": {"status": "F"}},
        {"$project": {"orderId": 1, "priority": 1, "customerName": "$customer.name"}},
    ]
    return ops.flatten(apply_pipeline(_columns(sql(spark, folder, ORDER_DOCS)), stages))


# Typed wrappers, as document stores export them.
TYPED_DOCS = """
SELECT concat('{"_id":{"$oid":"', hex(o_orderkey), '"},"at":{"$date":"',
  date_format(o_orderdate, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), '"},"big":{"$numberLong":"', o_custkey,
  '"},"price":{"$numberDecimal":"', CAST(o_totalprice AS DECIMAL(18,2)), '"},"done":',
  CASE WHEN o_orderstatus = 'F' THEN 'true' ELSE 'null' END, '}') AS js FROM orders
"""


@query(
    """
SELECT upper(to_hex(o_orderkey)) AS _id, date_trunc('milliseconds', o_orderdate) AS "at",
       o_custkey AS big, CASE WHEN o_orderstatus = 'F' THEN true END AS done,
       CAST(o_totalprice AS DECIMAL(18,2)) AS price
FROM orders
"""
)
def doc_typed_values(spark, folder):
    options = DocumentOptions(include_fields=["_id", "at", "big", "price", "done"])
    flat = ops.flatten_documents(sql(spark, folder, TYPED_DOCS), "js", options)
    return flat.withColumn("price", F.col("price").cast("decimal(18,2)"))


# Documents of uneven shape: a rare field, one that is text or a document, one never set.
MIXED_DOCS = """
SELECT concat('{"event":', event_id, ',"bad name":1,"none":null,"empty":{},',
  CASE event_type WHEN 'purchase' THEN '"paid":1.5,"note":{"by":"x"}'
                  WHEN 'click' THEN '"note":"text"' ELSE '"tags":["a"]' END,
  ',"props":', props, '}') AS js FROM events
"""


@query(
    """
SELECT * FROM (VALUES ('event', 'bigint'), ('note', 'string'), ('paid', 'double'),
  ('props_k', 'bigint'), ('tags', 'string')) v(column_name, data_type)
"""
)
def doc_infer_schema(spark, folder):
    schema = ops.infer_document_schema(sql(spark, folder, MIXED_DOCS), "js")
    columns, _ = ops.inferred_columns(schema)
    return spark.createDataFrame(columns, "column_name string, data_type string")


# Errors lost their closing brace.
BROKEN_DOCS = """
SELECT event_id, CASE WHEN event_type = 'error' THEN replace(props, '}', '') ELSE props END AS js
FROM events
"""


@query("SELECT event_id FROM events WHERE event_type = 'error'")
def doc_quarantine(spark, folder):
    return ops.rejected_documents(sql(spark, folder, BROKEN_DOCS), "js").select("event_id")


FRAMED_DOCS = """
SELECT event_id, CASE event_id % 5 WHEN 0 THEN props WHEN 1 THEN concat(props, props) WHEN 2 THEN concat(props, ',', props)
  WHEN 3 THEN concat(props, ' x}') ELSE concat('  ', props, '  ') END AS js
FROM events
"""


@query("SELECT event_id, event_id % 5 IN (1, 2, 3) AS rejected FROM events")
def doc_framing(spark, folder):
    """A text that holds more than one document, or something behind it, is rejected whole."""
    docs = sql(spark, folder, FRAMED_DOCS)
    good = ops.good_documents(docs, "js").select("event_id", F.lit(False).alias("rejected"))
    return good.unionAll(ops.rejected_documents(docs, "js").select("event_id", F.lit(True)))


@query(
    """
SELECT count(*) AS n_read, count(*) FILTER (event_type <> 'error') AS n_written,
       count(*) FILTER (event_type = 'error') AS n_failed,
       CAST(sum(CASE WHEN event_type <> 'error' THEN CAST(json_extract(props, '$.k') AS BIGINT) END)
         AS BIGINT) AS total
FROM events
"""
)
def doc_load(spark, folder):
    """Load with bad documents: what the run reports, and a total of what it wrote."""
    target, base = new_table(spark, "doc_load")
    docs = sql(spark, folder, BROKEN_DOCS)
    r = _checked(load_documents(docs, "js", target, options=LoadOptions(base=base)))
    total = spark.table(target).agg(F.sum("k").alias("total"))
    return total.select(
        F.lit(r.rows_read).cast("long").alias("n_read"),
        F.lit(r.rows_written).cast("long").alias("n_written"),
        F.lit(r.rows_failed).cast("long").alias("n_failed"),
        "total",
    )


@query("SELECT row_number() OVER (ORDER BY event_id) AS Id, props AS JsonData FROM events")
def raw_json_load(spark, folder):
    target, base = new_table(spark, "raw")
    events = table(spark, folder, "events").select("event_id", "props")
    r = load_raw_json(events, "props", target, LoadOptions(base=base), ["event_id"])
    _checked(r)
    return spark.table(r.target).select("Id", "JsonData")


@query(
    """
SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k,
       CAST(json_extract(props, '$.k') AS VARCHAR) AS k_text FROM events
"""
)
def json_read_back(spark, folder):
    columns = {"k": ("$.k", "int"), "k_text": ("$.k", "string")}
    return ops.json_values(table(spark, folder, "events"), "props", columns, ["event_id"])


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k FROM events")
def json_opened(spark, folder):
    return ops.open_json(table(spark, folder, "events"), "props", "k INT", ["event_id"])


@query("SELECT turn, role, text FROM conversations")
def document_files(spark, folder):
    """Documents written as JSON lines and scanned back."""
    path = work_path(spark, "json-lines")
    rows = table(spark, folder, "conversations").select("turn", "role", "text")
    rows.select(F.to_json(F.struct("*")).alias("value")).write.text(path)
    return ops.flatten_documents(document_scan(spark, path), "doc")


# A field that is a number in most documents and a text in some.
MIXED_FIELD = """
SELECT event_id, concat('{"type":"', event_type, '","q":',
  CASE WHEN user_id % 7 = 0 THEN '"none"' ELSE cast(user_id as string) END, '}') AS js FROM events
"""


@query(
    """
SELECT event_type AS type,
       CAST(coalesce(sum(user_id) FILTER (user_id % 7 <> 0), 0) AS DOUBLE) AS total
FROM events GROUP BY event_type
"""
)
def doc_mixed_sum(spark, folder):
    """Numbers of a field of mixed type add up; its texts count as 0."""
    stages = [{"$group": {"_id": "$type", "total": {"$sum": "$q"}}}]
    rows = apply_pipeline(_columns(sql(spark, folder, MIXED_FIELD)), stages)
    return ops.flatten(rows, DocumentOptions(field_mappings={"_id": "type"}), keep_id=True)


@query("SELECT event_type AS type, CAST(user_id AS VARCHAR) AS q FROM events WHERE user_id % 7 <> 0 AND user_id > 2")
def doc_mixed_filter(spark, folder):
    found = document_filter(_columns(sql(spark, folder, MIXED_FIELD)), {"q": {"$gt": 2}})
    return ops.flatten(found)


# Each number in the wrapper it fits into, as canonical exports have them.
WRAPPED_DOCS = """
SELECT concat('{"key":{"$number', CASE WHEN o_orderkey % 2 = 0 THEN 'Long' ELSE 'Int' END, '":"',
  o_orderkey, '"},"name":', CASE WHEN o_custkey % 3 = 0 THEN concat('{"$oid":"c', o_custkey, '"}')
  ELSE concat('"c', o_custkey, '"') END, '}') AS js FROM orders
"""


@query("SELECT o_orderkey AS \"key\", 'c' || o_custkey AS name FROM orders")
def doc_mixed_wrappers(spark, folder):
    return ops.flatten_documents(sql(spark, folder, WRAPPED_DOCS), "js")


CASED_DOCS = """
SELECT concat('{"Key":', c_custkey, CASE WHEN c_custkey % 2 = 0 THEN concat(',"key":', -c_custkey) ELSE '' END,
  ',"in":{"N":"', c_name, '"', CASE WHEN c_custkey % 5 = 0 THEN ',"n":"x"' ELSE '' END, '}}') AS js FROM customer
"""


@query(
    """
SELECT CASE WHEN c_custkey % 2 = 0 THEN -c_custkey ELSE c_custkey END AS "key",
       CASE WHEN c_custkey % 5 = 0 THEN 'x' ELSE c_name END AS in_n FROM customer
"""
)
def doc_case_clash(spark, folder):
    """Names that differ only in case make one column; the later in name order wins."""
    return ops.flatten_documents(sql(spark, folder, CASED_DOCS), "js")


EXACT_DOCS = """
SELECT concat('{"v":', CASE WHEN o_orderkey % 2 = 0 THEN cast(9007199254740992 + o_orderkey + 1 as string)
  ELSE concat(o_custkey, '.5') END, '}') AS js FROM orders
"""


@query(
    """
SELECT CASE WHEN o_orderkey % 2 = 0 THEN (9007199254740992 + o_orderkey + 1)::VARCHAR || '.0'
       ELSE o_custkey || '.5' END AS v FROM orders
"""
)
def doc_exact_numbers(spark, folder):
    """Whole numbers above 2^53 beside fractions."""
    flat = ops.flatten_documents(sql(spark, folder, EXACT_DOCS), "js")
    return flat.select(F.col("v").cast("string").alias("v"))


# Errors lost their closing brace; every tenth number is no number.
UNFIT_DOCS = """
SELECT event_id, CASE WHEN event_type = 'error' THEN concat('{"id":', event_id)
  ELSE concat('{"id":', event_id, ',"n":{"$numberLong":"', CASE WHEN user_id % 10 = 0 THEN 'x' ELSE '' END,
              user_id, '"}}') END AS js FROM events
"""


@query(
    """
SELECT CASE WHEN event_type = 'error' THEN 'no JSON document' ELSE 'a value that doesn''t convert' END AS reason,
       count(*) AS n, (SELECT count(*) FROM events WHERE event_type = 'error' OR user_id % 10 = 0) AS n_failed
FROM events WHERE event_type = 'error' OR user_id % 10 = 0 GROUP BY ALL
"""
)
def doc_rejected(spark, folder):
    """What a load left out, by reason, beside the number it reports."""
    target, base = new_table(spark, "rejected")
    options = LoadOptions(base=base, rejected_path=work_path(spark, "rejected"))
    r = _checked(load_documents(sql(spark, folder, UNFIT_DOCS), "js", target, options=options))
    found = spark.read.parquet(options.rejected_path).groupBy("reason").agg(F.count("*").alias("n"))
    return found.withColumn("n_failed", F.lit(r.rows_failed).cast("long"))


# --- filters as trees, and pipelines that unwind, order, compute and accumulate ---

# Some events without a user, some with a user of null, the others with the user's number or its text.
LOOSE_EVENTS = """
SELECT event_id, concat('{"id":', event_id, CASE WHEN user_id % 5 = 0 THEN '' WHEN user_id % 5 = 1
  THEN ',"user":null' WHEN user_id % 5 = 2 THEN concat(',"user":"u', user_id, '"')
  ELSE concat(',"user":', user_id) END, ',"type":"', event_type, '","value":', value, ',"props":', props, '}') AS js
FROM events
"""


@query(
    """
SELECT event_id AS id FROM events WHERE
  (user_id % 5 IN (0, 1) OR (user_id % 5 IN (3, 4) AND user_id > 20) OR (user_id % 5 = 2 AND ('u' || user_id)[2:2] IN ('1', '3')))
  AND NOT (event_type = 'view' OR CAST(json_extract(props, '$.k') AS INT) > 70)
  AND NOT (user_id % 5 = 1 AND value >= 50)
"""
)
def doc_predicate_tree(spark, folder):
    """Boolean trees on fields that are missing, null, text or a number, tested on the parsed text."""
    spec = {
        "$or": [{"user": None}, {"user": {"$gt": 20}}, {"user": {"$regex": "^u[13]"}}],
        "$nor": [{"type": "view"}, {"props.k": {"$gt": 70}}],
        "$and": [{"$or": [{"user": {"$exists": False}}, {"user": {"$ne": None}}, {"value": {"$not": {"$gte": 50}}}]}],
    }
    docs = ops.only_parsed(sql(spark, folder, LOOSE_EVENTS), "js")
    found = docs.where(document_predicate(VariantFields(ops.DOC), spec))
    return found.select(F.variant_get(ops.DOC, "$.id", "bigint").alias("id"))


# An order with its lines; orders without lines have an empty array, none at all, null or one bare line.
ORDERS_WITH_LINES = """
SELECT concat('{"order":', o_orderkey, ',"status":"', o_orderstatus, '"', CASE
  WHEN o_orderkey % 7 = 0 THEN ',"lines":[]' WHEN o_orderkey % 7 = 1 THEN '' WHEN o_orderkey % 7 = 2 THEN ',"lines":null'
  ELSE concat(',"lines":', to_json(lines)) END, '}') AS js
FROM orders JOIN (
  SELECT l_orderkey, array_sort(collect_list(named_struct('no', l_linenumber, 'part', l_partkey, 'qty', CAST(l_quantity AS INT)))) AS lines
  FROM lineitem GROUP BY l_orderkey) q ON o_orderkey = l_orderkey
"""


@query(
    """
SELECT o_orderkey AS "order" FROM orders WHERE o_orderkey % 7 > 2 AND o_orderkey IN (
  SELECT l_orderkey FROM lineitem WHERE CAST(l_quantity AS INT) >= 45 AND l_linenumber = 1)
  AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_partkey % 10 = 3)
  AND o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY ALL HAVING count(*) <> 4)
"""
)
def doc_element_match(spark, folder):
    """Filters on an array's elements and its size."""
    spec = {
        "lines": {"$elemMatch": {"qty": {"$gte": 45}, "no": 1}},
        "lines.part": {"$not": {"$mod": [10, 3]}},
        "$nor": [{"lines": {"$size": 4}}],
    }
    docs = ops.only_parsed(sql(spark, folder, ORDERS_WITH_LINES), "js")
    found = docs.where(document_predicate(VariantFields(ops.DOC), spec))
    return found.select(F.variant_get(ops.DOC, "$.order", "bigint").alias("order"))


def _piped(spark, docs, stages, **options):
    """Documents through a pipeline into a table; what the table holds."""
    target, base = new_table(spark, "doc_piped")
    _checked(load_documents(docs, "js", target, DocumentOptions(**options), LoadOptions(base=base), pipeline=stages))
    return spark.table(target)


@query(
    """
SELECT CAST(l_partkey AS BIGINT) AS part, count(*) AS n, CAST(sum(CAST(l_quantity AS INT)) AS BIGINT) AS qty
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
WHERE o_orderkey % 7 > 2 AND o_orderstatus <> 'P' AND CAST(l_quantity AS INT) > 5 GROUP BY l_partkey
"""
)
def doc_unwind(spark, folder):
    """A row per element, filtered and grouped by a field of the elements."""
    stages = [
        {"$match": {"status": {"$ne": "P"}}},
        {"$unwind": "$lines"},
        {"$match": {"lines.qty": {"$gt": 5}}},
        {"$group": {"_id": "$lines.part", "n": {"$sum": 1}, "qty": {"$sum": "$lines.qty"}}},
    ]
    return _piped(spark, sql(spark, folder, ORDERS_WITH_LINES), stages, field_mappings={"_id": "part"})


@query(
    """
SELECT CAST(o_orderkey AS BIGINT) AS "order", o_orderstatus AS status, CAST(l_linenumber AS BIGINT) AS lines_no,
  CAST(l_partkey AS BIGINT) AS lines_part, CAST(CAST(l_quantity AS INT) AS BIGINT) AS lines_qty,
  row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_partkey, CAST(l_quantity AS INT)) - 1 AS at
FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderkey % 7 > 2
UNION ALL SELECT o_orderkey, o_orderstatus, NULL, NULL, NULL, NULL
FROM orders WHERE o_orderkey % 7 <= 2 AND o_orderkey IN (SELECT l_orderkey FROM lineitem)
"""
)
def doc_unwind_outer(spark, folder):
    """A row per element with its place, and one for each document that has none."""
    spec = {"path": "$lines", "preserveNullAndEmptyArrays": True, "includeArrayIndex": "at"}
    return _piped(spark, sql(spark, folder, ORDERS_WITH_LINES), [{"$unwind": spec}])


@query(
    """
SELECT o_orderkey AS "orderId", o_orderpriority AS priority, c_name AS customer_name
FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'O'
ORDER BY o_orderpriority, o_orderkey DESC LIMIT 100 OFFSET 25
"""
)
def doc_top(spark, folder):
    """An ordered cut of the documents, which Spark plans as one top-k."""
    stages = [
        {"$match": {"status": "O"}},
        {"$sort": {"priority": 1, "orderId": -1}},
        {"$skip": 25},
        {"$limit": 100},
        {"$unset": ["_id", "status", "customer.segment"]},
    ]
    return _piped(spark, sql(spark, folder, ORDER_DOCS), stages)


@query(
    """
SELECT event_type AS type, count(*) AS n, avg(CAST(json_extract(props, '$.k') AS BIGINT)) AS mean,
  min(CAST(json_extract(props, '$.k') AS BIGINT)) AS least,
  max(CASE WHEN user_id % 5 IN (3, 4) THEN user_id END)::VARCHAR AS most_number,
  coalesce(max(CASE WHEN user_id % 5 = 2 THEN 'u' || user_id END), max(CASE WHEN user_id % 5 IN (3, 4) THEN user_id END)::VARCHAR) AS most,
  '[' || array_to_string(list_sort(list(DISTINCT CAST(json_extract(props, '$.k') AS BIGINT))), ',') || ']' AS ks
FROM events GROUP BY event_type
"""
)
def doc_accumulators(spark, folder):
    """Accumulators whose states Spark merges; a field of mixed type is ordered by kind, then value."""
    stages = [
        {"$addFields": {"number": {"$cond": [{"$gte": ["$user", 0]}, "$user", None]}}},
        {
            "$group": {
                "_id": "$type", "n": {"$count": {}}, "mean": {"$avg": "$props.k"}, "least": {"$min": "$props.k"},
                "most_number": {"$max": "$number"}, "most": {"$max": "$user"}, "ks": {"$addToSet": "$props.k"},
            }
        },
    ]
    return _piped(spark, sql(spark, folder, LOOSE_EVENTS), stages, field_mappings={"_id": "type"})


@query(
    """
SELECT CAST(o_orderkey AS BIGINT) AS "order", CASE WHEN o_orderkey % 7 > 3 THEN 'wide' ELSE 'narrow' END AS form,
  CAST(o_orderkey * 2 + 1 AS BIGINT) AS odd, lower(o_orderstatus) || '-x' AS label, CAST(n AS INT) AS n_lines
FROM orders JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY ALL) ON l_orderkey = o_orderkey
WHERE o_orderkey % 7 > 2
"""
)
def doc_computed(spark, folder):
    """Fields computed from others."""
    stages = [
        {"$match": {"lines": {"$elemMatch": {"no": {"$gte": 0}}}}},
        {"$addFields": {"rest": {"$mod": ["$order", 7]}}},
        {
            "$project": {
                "order": 1, "form": {"$cond": [{"$gt": ["$rest", 3]}, "wide", "narrow"]},
                "odd": {"$add": [{"$multiply": ["$order", 2]}, 1]},
                "label": {"$concat": [{"$toLower": "$status"}, "-x"]}, "n_lines": {"$size": "$lines"},
            }
        },
    ]
    return _piped(spark, sql(spark, folder, ORDERS_WITH_LINES), stages)
