"""Recipes, and one acceptance query per relational category of the SQL surface."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnwise.plans.registry import Tables, query, sql_query
from turnwise.sources.recipes import failed_cases, json_text, json_value, message_rows


@query(
    "recipe_messages",
    """
    SELECT user_id AS session_id, event_id AS message_id, event_type AS role, props AS content,
           epoch_us(ts) AS created_at_us
    FROM events WHERE ts >= TIMESTAMP '2024-01-02 00:00:00'
    ORDER BY session_id, ts, message_id
    """,
)
def recipe_messages(t: Tables):
    columns = {
        "session_id": "user_id",
        "message_id": "event_id",
        "role": "event_type",
        "content": "props",
        "created_at": "ts",
    }
    since = F.col("ts") >= F.lit("2024-01-02 00:00:00").cast("timestamp_ntz")
    rows = message_rows(t.events, columns, since, ["session_id", "created_at", "message_id"])
    micros = F.unix_micros(F.col("created_at").cast("timestamp"))
    return rows.withColumn("created_at_us", micros).drop("created_at")


@query(
    "recipe_json_extract",
    """
    SELECT event_id, json_extract_string(props, '$.k') AS k_text,
           CAST(json_extract(props, '$.k') AS BIGINT) AS k_value,
           json_extract_string(props, '$.absent') AS absent_text
    FROM events
    """,
)
def recipe_json_extract(t: Tables):
    props = F.col("props")
    return t.events.select(
        "event_id",
        json_text(props, "$.k").alias("k_text"),
        json_value(props, "$.k").try_cast("bigint").alias("k_value"),
        json_text(props, "$.absent").alias("absent_text"),
    )


@query(
    "recipe_bad_cases",
    """
    SELECT d.doc_id, d.lang, d.source, d.n_chars, d.text, l.quality, l.toxic
    FROM documents d JOIN labels l ON l.doc_id = d.doc_id
    WHERE l.quality = 0 ORDER BY d.doc_id
    """,
)
def recipe_bad_cases(t: Tables):
    return failed_cases(t.documents, t.labels, "doc_id", F.col("quality") == 0, ["doc_id"]).select(
        "doc_id", "lang", "source", "n_chars", "text", "quality", "toxic"
    )


sql_query(
    "sql_cte",
    """
    WITH sizes AS (
      SELECT conv_id, count(*) AS n_turns, sum(length(text)) AS n_chars
      FROM conversations GROUP BY conv_id
    ), longest AS (SELECT max(n_turns) AS n_turns FROM sizes)
    SELECT s.conv_id, s.n_turns, CAST(s.n_chars AS BIGINT) AS n_chars
    FROM sizes s WHERE s.n_turns = (SELECT n_turns FROM longest)
    """,
)
sql_query(
    "sql_join_left",
    """
    SELECT d.doc_id, d.lang, l.quality, coalesce(l.toxic, -1) AS toxic
    FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
    """,
)
sql_query(
    "sql_semi",
    """
    SELECT d.doc_id, d.n_chars FROM documents d
    WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.toxic = 1)
    """,
)
sql_query(
    "sql_anti",
    """
    SELECT d.doc_id, d.n_chars FROM documents d
    WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)
    """,
)
sql_query(
    "sql_group_agg",
    """
    SELECT event_type, count(*) AS n_events, count(DISTINCT user_id) AS n_users,
           min(event_id) AS first_event, max(value) AS max_value,
           CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents
    FROM events GROUP BY event_type HAVING count(*) > 1
    """,
)
sql_query(
    "sql_rollup",
    """
    SELECT event_type, CAST(extract(month FROM ts) AS INT) AS in_month, count(*) AS n_events
    FROM events GROUP BY ROLLUP (event_type, extract(month FROM ts))
    """,
)
sql_query(
    "sql_window",
    """
    WITH daily AS (
      SELECT user_id, CAST(ts AS DATE) AS on_day, count(*) AS n_events
      FROM events GROUP BY user_id, CAST(ts AS DATE)
    )
    SELECT user_id, CAST(extract(year FROM on_day) AS INT) AS y,
           CAST(extract(month FROM on_day) AS INT) AS m, CAST(extract(day FROM on_day) AS INT) AS d,
           CAST(sum(n_events) OVER (PARTITION BY user_id ORDER BY on_day
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS running_events,
           coalesce(lag(n_events) OVER (PARTITION BY user_id ORDER BY on_day), 0) AS day_before
    FROM daily
    """,
)
sql_query(
    "sql_topk",
    """
    SELECT o_orderkey, o_custkey, o_totalprice FROM orders
    ORDER BY o_totalprice DESC, o_orderkey LIMIT 25
    """,
)
sql_query(
    "sql_setops",
    """
    (SELECT conv_id, role FROM conversations WHERE role <> 'system'
     UNION SELECT conv_id, 'any' AS role FROM conversations)
    EXCEPT
    (SELECT conv_id, role FROM conversations WHERE turn = 0
     INTERSECT SELECT conv_id, role FROM conversations WHERE turn >= 0)
    """,
)
sql_query(
    "sql_theta_join",
    """
    SELECT r.r_name, n.n_name, s.s_suppkey FROM supplier s
    JOIN nation n ON n.n_nationkey = s.s_nationkey
    JOIN region r ON r.r_regionkey = n.n_regionkey AND s.s_acctbal > 1000.0 * r.r_regionkey
    """,
)
sql_query(
    "sql_scalar_functions",
    """
    SELECT o_orderkey, upper(substring(o_orderpriority, 3)) AS priority_word,
           concat(o_orderstatus, '-', CAST(o_custkey AS VARCHAR(20))) AS tag,
           CAST(floor(o_totalprice / 1000) AS BIGINT) AS thousands,
           CAST(extract(year FROM o_orderdate) AS INT) AS order_year,
           CASE WHEN o_totalprice > 200000 THEN 'big' WHEN o_totalprice > 100000 THEN 'mid'
                ELSE 'small' END AS size_class
    FROM orders WHERE o_orderpriority LIKE '%I%' AND o_orderstatus IN ('F', 'O')
    """,
)

