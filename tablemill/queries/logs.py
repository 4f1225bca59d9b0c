"""Request-log queries. The log rows are built from the event table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablemill.functions.masking import mask_connection_string, mask_json
from tablemill.functions.names import column_name_ok, table_name_ok
from tablemill.operators import requestlog as ops
from tablemill.queries.registry import query, sql, table
from tablemill.session import work_path

CONNECTIONS = """
SELECT event_id, CASE event_type
  WHEN 'signup' THEN concat('Server=s', user_id, ';Password=p', event_id, ';Database=d')
  WHEN 'click' THEN concat('mongodb+srv://u', user_id, ':p', event_id, '@host', user_id, ':27017/db')
  WHEN 'view' THEN concat('Data Source=s;PWD = p', event_id, ';pwd=', user_id)
  WHEN 'purchase' THEN concat('MONGODB://u:p@', event_id, '@host/db')
  ELSE concat('Server=s', user_id, ';Integrated Security=true;') END AS conn
FROM events
"""


@query(
    f"""
SELECT event_id, regexp_replace(
  regexp_replace(conn, '(Password|Pwd)\\s*=\\s*[^;]+', '\\1=*** MASKED ***', 'gi'),
  '(mongodb(?:\\+srv)?://[^:]+:)([^@]+)(@[^/]+)', '\\1*** MASKED ***\\3', 'gi') AS masked
FROM ({CONNECTIONS}) c
"""
)
def mask_connection_strings(spark, folder):
    masked = mask_connection_string(F.col("conn")).alias("masked")
    return sql(spark, folder, CONNECTIONS).select("event_id", masked)


@query(
    f"""
SELECT event_id, regexp_replace(
  regexp_replace(conn, '(Password|Pwd)\\s*=\\s*[^;]+', '\\1=*** MASKED ***', 'gi'),
  '(mongodb(?:\\+srv)?://[^:/]+:)([^/]*)(@[^/@]+)', '\\1*** MASKED ***\\3', 'gi') AS masked
FROM ({CONNECTIONS}) c
"""
)
def mask_connection_strings_strict(spark, folder):
    masked = mask_connection_string(F.col("conn"), strict=True).alias("masked")
    return sql(spark, folder, CONNECTIONS).select("event_id", masked)


# {0}, {1} and {2} are the two secrets and the password in the connection string.
BODY = """
CASE event_type
  WHEN 'signup' THEN concat('{{"user":', user_id, ',"Password":', {0}, ',"v":1.50}}')
  WHEN 'click' THEN concat('{{"l":[{{"apiKey":', {1}, '}},{{"x":null}}],"n":{{"token":', {0}, '}}}}')
  WHEN 'view' THEN concat('{{"connectionString":"Server=s', user_id, ';Password=', {2}, ';"}}')
  WHEN 'purchase' THEN concat('[{{"secret":', {1}, ',"note":"Password=open"}}]')
  ELSE concat('{{"password":"p', event_id) END
"""
BODIES = "SELECT event_id, {} AS body FROM events".format(
    BODY.format("concat('\"p', event_id, '\"')", "event_id", "concat('p', event_id)")
)
MASKED_BODY = BODY.format(*["'\"*** MASKED ***\"'"] * 2, "'*** MASKED ***'")


@query(f"SELECT event_id, {MASKED_BODY} AS body FROM events")
def mask_json_bodies(spark, folder):
    return sql(spark, folder, BODIES).select("event_id", mask_json(F.col("body")).alias("body"))


HEADERS = """
SELECT event_id, concat('10.0.0.', user_id) AS client_ip,
  map('Accept', 'json', concat(event_type, '-Trace'), cast(user_id as string),
      CASE WHEN event_type = 'click' THEN 'AUTHORIZATION' ELSE 'Host' END, 'v',
      CASE WHEN event_type = 'view' THEN 'x-api-key' ELSE 'Cookie' END, 'c',
      'X-Forwarded-For', CASE WHEN event_type = 'error' THEN ''
                              ELSE concat(' 192.168.1.', user_id, ' , 10.9.9.9') END) AS headers
FROM events
"""


@query(
    """
SELECT event_id, CASE WHEN event_type = 'click' THEN 'Accept,X-Forwarded-For,click-Trace'
  ELSE 'Accept,Host,X-Forwarded-For,' || event_type || '-Trace' END AS names FROM events
"""
)
def drop_headers(spark, folder):
    kept = F.array_sort(F.map_keys(ops.safe_headers(F.col("headers"))))
    return sql(spark, folder, HEADERS).select("event_id", F.array_join(kept, ",").alias("names"))


@query(
    """
SELECT event_id, CASE WHEN event_type = 'error' THEN '10.0.0.' || user_id
  ELSE '192.168.1.' || user_id END AS ip FROM events
"""
)
def client_ip(spark, folder):
    ip = ops.client_ip(F.col("headers"), F.col("client_ip"))
    return sql(spark, folder, HEADERS).select("event_id", ip.alias("ip"))


PATHS = """
SELECT event_id, CASE event_type WHEN 'view' THEN concat('/API/Health/', user_id)
  WHEN 'click' THEN '/Swagger/index' ELSE concat('/api/jobs/', event_type) END AS path FROM events
"""


@query("SELECT event_id, '/api/jobs/' || event_type AS path FROM events WHERE event_type NOT IN ('view', 'click')")
def exclude_paths(spark, folder):
    return sql(spark, folder, PATHS).where(ops.path_is_logged(F.col("path")))


@query(
    """
SELECT doc_id, CASE WHEN length(text) > 10000 THEN substring(text, 1, 10000) || '... [truncated]'
  ELSE text END AS body FROM documents
"""
)
def truncate_body(spark, folder):
    body = ops.truncated(F.col("text")).alias("body")
    return table(spark, folder, "documents").select("doc_id", body)


CODES = """
SELECT event_id, event_type, CAST(100 + 5 * CAST(get_json_object(props, '$.k') AS INT) AS INT)
  AS status_code FROM events
"""


@query(
    """
SELECT event_type, CASE WHEN c BETWEEN 200 AND 299 THEN '2xx' WHEN c BETWEEN 300 AND 399 THEN '3xx'
  WHEN c BETWEEN 400 AND 499 THEN '4xx' WHEN c >= 500 THEN '5xx' ELSE 'other' END AS status_class,
  count(*) AS n
FROM (SELECT event_type, 100 + 5 * CAST(json_extract(props, '$.k') AS INT) AS c FROM events) q
GROUP BY ALL
"""
)
def status_class(spark, folder):
    logs = sql(spark, folder, CODES)
    return logs.groupBy("event_type", ops.status_class(F.col("status_code")).alias("status_class")).agg(
        F.count("*").alias("n")
    )


LOGS = """
SELECT cast(event_id as string) AS id, ts AS timestamp, 'GET' AS http_method,
       concat('/api/', event_type) AS path,
       CASE WHEN event_type = 'view' THEN concat('?u=', user_id) ELSE '' END AS query_string,
       CASE WHEN event_type = 'click' THEN concat('a\\r\\nb\\n', repeat('x', 600))
            WHEN event_type = 'signup' THEN props END AS request_body,
       200 AS status_code, user_id AS response_time_ms,
       CASE WHEN event_type = 'purchase' THEN NULL ELSE '10.0.0.1' END AS client_ip,
       CASE WHEN event_type = 'error' THEN 'boom' END AS error_message
FROM events
"""


@query(
    """
SELECT '[' || strftime(ts, '%Y-%m-%d %H:%M:%S.%g') || '] [' || event_id || '] GET /api/' || event_type
  || CASE WHEN event_type = 'view' THEN '??u=' || user_id ELSE '' END
  || ' -> 200 (' || user_id || 'ms) | IP: '
  || CASE WHEN event_type = 'purchase' THEN '' ELSE '10.0.0.1' END
  || CASE WHEN event_type = 'click' THEN ' | Body: a b ' || repeat('x', 496) || '...'
          WHEN event_type = 'signup' THEN ' | Body: ' || props ELSE '' END
  || CASE WHEN event_type = 'error' THEN ' | ERROR: boom' ELSE '' END AS line
FROM events
"""
)
def log_lines(spark, folder):
    logs = sql(spark, folder, LOGS)
    return logs.select(ops.text_line(logs).alias("line"))


@query(
    """
SELECT '{"id":"' || event_id || '","httpMethod":"GET","path":"/api/' || event_type
  || '","statusCode":200,"responseTimeMs":' || user_id
  || CASE WHEN event_type = 'purchase' THEN '' ELSE ',"clientIp":"10.0.0.1"' END
  || CASE WHEN event_type = 'error' THEN ',"errorMessage":"boom"' ELSE '' END || '}' AS line
FROM events
"""
)
def log_json_lines(spark, folder):
    logs = sql(spark, folder, LOGS).drop("timestamp", "query_string", "request_body")
    return logs.select(ops.json_line(logs).alias("line"))


@query(
    """
SELECT CAST(ts AS DATE) AS log_date, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS id_sum
FROM events GROUP BY ALL
"""
)
def log_rolling(spark, folder):
    path = work_path(spark, "rolling")
    ops.write_rolling(sql(spark, folder, LOGS), path)
    written = spark.read.parquet(path)
    return written.groupBy("log_date").agg(
        F.count("*").alias("n"), F.sum(F.col("id").cast("bigint")).alias("id_sum")
    )


# Errors came without a time.
UNTIMED = LOGS.replace("ts AS timestamp", "CASE WHEN event_type <> 'error' THEN ts END AS timestamp")


@query(
    """
SELECT CASE WHEN event_type <> 'error' THEN strftime(ts, '%Y-%m-%d') END AS log_date,
  '[' || CASE WHEN event_type <> 'error' THEN strftime(ts, '%Y-%m-%d %H:%M:%S.%g') ELSE '' END
  || '] [' || event_id || '] GET /api/' || event_type
  || CASE WHEN event_type = 'view' THEN '??u=' || user_id ELSE '' END
  || ' -> 200 (' || user_id || 'ms) | IP: '
  || CASE WHEN event_type = 'purchase' THEN '' ELSE '10.0.0.1' END
  || CASE WHEN event_type = 'click' THEN ' | Body: a b ' || repeat('x', 496) || '...'
          WHEN event_type = 'signup' THEN ' | Body: ' || props ELSE '' END
  || CASE WHEN event_type = 'error' THEN ' | ERROR: boom' ELSE '' END AS line
FROM events
"""
)
def log_rolling_lines(spark, folder):
    """Text lines in a folder per day, read back; records without a time among them."""
    path = work_path(spark, "rolling-lines")
    ops.write_rolling_lines(sql(spark, folder, UNTIMED), path)
    back = spark.read.text(path)
    return back.select(F.col("log_date").cast("string").alias("log_date"), F.col("value").alias("line"))


@query(
    """
SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 10 DAY
"""
)
def log_retention(spark, folder):
    path = work_path(spark, "retention")
    ops.write_rolling(sql(spark, folder, LOGS), path)
    now = F.expr("TIMESTAMP_NTZ'2024-01-30 12:00:00'")
    kept = ops.retained(spark.read.parquet(path), now, 10)
    return kept.select(F.col("id").cast("bigint").alias("event_id"))


SCRUBBED = f"""
SELECT event_id, concat('/api/', event_type) AS path, body AS request_body
FROM (SELECT event_id, event_type, {BODY.format("concat('\"p', event_id, '\"')", "event_id", "concat('p', event_id)")} AS body FROM events) q
"""


@query(
    f"""
SELECT event_id, '/api/' || event_type AS path,
  CASE WHEN length(b) > 20 THEN substring(b, 1, 20) || '... [truncated]' ELSE b END AS request_body
FROM (SELECT event_id, event_type, {MASKED_BODY} AS b FROM events) q WHERE event_type <> 'error'
"""
)
def scrub_log(spark, folder):
    return ops.scrub(sql(spark, folder, SCRUBBED), ["/API/error"], max_body=20)


TEXTS = """
SELECT p_partkey, concat(CASE p_type WHEN 'ECONOMY' THEN 'select resp_time from t where n = '
  WHEN 'PROMO' THEN 'Drop table p; -- ' WHEN 'SMALL' THEN 'drop table ' WHEN 'LARGE' THEN 'exec('
  WHEN 'STANDARD' THEN 'WaitFor delay ' ELSE 'select * from part where p_name = ' END, p_name) AS sql_text
FROM part
"""


@query(
    """
SELECT p_partkey, pattern AS sql_pattern, pattern IS NULL AS is_clean FROM (
  SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN 'sp_' WHEN 'PROMO' THEN '--'
    WHEN 'SMALL' THEN 'DROP ' WHEN 'LARGE' THEN 'EXEC(' WHEN 'STANDARD' THEN 'WAITFOR' END AS pattern
  FROM part) q
"""
)
def sql_audit(spark, folder):
    return ops.sql_audit(sql(spark, folder, TEXTS), "sql_text").drop("sql_text")


ODD_DOCS = """
SELECT concat('{"user id":', user_id, ',"', event_type, '":{"x-y":', user_id, ',"ok":1},"fine":',
              props, '}') AS js FROM events
"""


@query(
    f"""
SELECT field_name, n_documents, 'Invalid column name: ''' || field_name
  || '''. Only letters, numbers, and underscores are allowed.' AS message
FROM (SELECT 'user id' AS field_name, count(*) AS n_documents FROM events
      UNION ALL SELECT event_type || '_x-y', count(*) FROM events GROUP BY event_type) q
"""
)
def field_name_audit(spark, folder):
    return ops.field_name_audit(sql(spark, folder, ODD_DOCS), "js")


# Names found in the data, some of them valid.
NAMES = """
SELECT DISTINCT name FROM (
  SELECT p_brand AS name FROM part UNION ALL SELECT p_type FROM part UNION ALL
  SELECT p_name FROM part UNION ALL SELECT concat(p_type, '.', p_type) FROM part UNION ALL
  SELECT concat(p_type, '_', p_size) FROM part UNION ALL
  SELECT concat(p_size, p_type) FROM part UNION ALL SELECT repeat(p_type, 30) FROM part
) n
"""


@query(
    f"""
SELECT name,
  length(name) <= 128 AND regexp_full_match(name, '[a-zA-Z_][a-zA-Z0-9_]*') AS is_column,
  length(name) <= 128
    AND regexp_full_match(name, '[a-zA-Z_][a-zA-Z0-9_]*([.][a-zA-Z_][a-zA-Z0-9_]*)?') AS is_table
FROM ({NAMES}) q
"""
)
def name_rules(spark, folder):
    name = F.col("name")
    return sql(spark, folder, NAMES).select(
        "name", column_name_ok(name).alias("is_column"), table_name_ok(name).alias("is_table")
    )
