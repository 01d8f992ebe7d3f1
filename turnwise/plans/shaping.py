"""Queries for result shaping and row identity."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.functions.jsons import canonical_text, decode_or_keep
from turnwise.operators.identity import (
    collision_warning,
    identity_name,
    identity_report,
    with_row_identity,
)
from turnwise.operators.result import RowTable, build_row_table
from turnwise.operators.shape import (
    column_catalog,
    hide_columns,
    json_promotion,
    normalise,
    preview,
    promoted_columns,
    result_summary,
    unique_names,
    value_kind_profile,
)
from turnwise.plans.registry import Tables, query
from turnwise.sources.tables import TABLES

# The tables' columns with their source and inferred types, as the catalog must list them.
SCHEMAS = {
    "region": "r_regionkey int integer, r_name string text",
    "nation": "n_nationkey int integer, n_name string text, n_regionkey int integer",
    "customer": "c_custkey bigint integer, c_name string text, c_nationkey int integer, "
    "c_acctbal double float, c_mktsegment string text",
    "supplier": "s_suppkey bigint integer, s_name string text, s_nationkey int integer, "
    "s_acctbal double float",
    "part": "p_partkey bigint integer, p_name string text, p_brand string text, "
    "p_type string text, p_size int integer, p_retailprice double float",
    "orders": "o_orderkey bigint integer, o_custkey bigint integer, o_orderstatus string text, "
    "o_totalprice double float, o_orderdate timestamp_ntz timestamp, o_orderpriority string text",
    "lineitem": "l_orderkey bigint integer, l_partkey bigint integer, l_suppkey bigint integer, "
    "l_linenumber int integer, l_quantity double float, l_extendedprice double float, "
    "l_discount double float, l_tax double float, l_returnflag string text, "
    "l_linestatus string text, l_shipdate timestamp_ntz timestamp",
    "events": "event_id bigint integer, ts timestamp_ntz timestamp, user_id bigint integer, "
    "event_type string text, value double float, props string text",
    "documents": "doc_id bigint integer, text string text, lang string text, "
    "source string text, n_chars bigint integer",
    "embeddings": "vec_id bigint integer, embedding array<float> json, label int integer",
    "pages": "page_id bigint integer, url string text, html string text",
    "benchmark": "item_id bigint integer, text string text",
    "labels": "doc_id bigint integer, quality int integer, toxic int integer",
    "conversations": "conv_id bigint integer, turn bigint integer, role string text, "
    "text string text",
}

_IS_JSON = (
    "CASE WHEN json_valid({c}) THEN json_type(CASE WHEN json_valid({c}) THEN {c} END) "
    "IN ('OBJECT', 'ARRAY') ELSE false END"
)


def _holds_json_sql(table: str, column: str) -> str:
    return f"(SELECT coalesce(bool_or({_IS_JSON.format(c=column)}), false) FROM {table})"


def _specs(names: tuple[str, ...]):
    for table in names:
        for number, spec in enumerate(SCHEMAS[table].split(", "), 1):
            yield table, number, *spec.split(" ")


def names_sql(names: tuple[str, ...] = TABLES) -> str:
    """The columns of tables by name; no data is read."""
    values = ", ".join(f"('{table}', '{column}')" for table, _, column, _, _ in _specs(names))
    return f"SELECT * FROM (VALUES {values}) named(table_name, column_name)"


def catalog_sql(names: tuple[str, ...] = TABLES) -> str:
    """The catalog: known names and types, and one scan per table for which texts hold JSON."""
    values = ", ".join(f"('{table}', {number}, '{column}', '{sql_type}', '{kind}')" for table, number, column, sql_type, kind in _specs(names))
    scans = []
    for table in names:
        texts = [column for own, _, column, _, kind in _specs(names) if own == table and kind == "text"]
        flags = ", ".join(f"CASE WHEN bool_or({_IS_JSON.format(c=column)}) THEN '{column}' END" for column in texts)
        if texts:
            scans.append(f"SELECT '{table}' AS table_name, unnest([{flags}]) AS column_name FROM {table}")
    return (
        "SELECT c.table_name, c.ordinal, c.column_name, c.sql_type, CASE WHEN j.column_name IS NOT NULL THEN 'json' ELSE c.kind END AS inferred_type "
        f"FROM (VALUES {values}) c(table_name, ordinal, column_name, sql_type, kind) "
        f"LEFT JOIN ({' UNION ALL '.join(scans)}) j ON j.table_name = c.table_name AND j.column_name = c.column_name"
    )


def all_catalogs(t: Tables) -> DataFrame:
    """Catalog of every table, with JSON found by reading the data; the tables' schemas are read at the same time."""
    with ThreadPoolExecutor(len(TABLES)) as pool:
        catalogs = list(pool.map(lambda n: column_catalog(getattr(t, n), n), TABLES))
    return reduce(DataFrame.unionByName, catalogs)


@query(
    "preview_capped",
    """
    SELECT event_id, user_id, event_type, value, props FROM events ORDER BY ts, event_id LIMIT 500
    """,
)
def preview_capped(t: Tables):
    rows, _ = preview(t.events, ["ts", "event_id"], 500)
    return rows.drop("ts")


@query(
    "preview_truncated",
    """
    SELECT 'RESULT_TRUNCATED' AS code, CAST(NULL AS VARCHAR) AS group_key,
           CAST(NULL AS VARCHAR) AS "column", CAST(NULL AS BIGINT) AS "count"
    FROM (SELECT count(*) AS n FROM events) WHERE n > 500
    """,
)
def preview_truncated(t: Tables):
    return preview(t.events, ["ts", "event_id"], 500)[1]


@query(
    "unique_names",
    """
    SELECT o.o_orderkey AS id, c.c_custkey AS id__2, o.o_totalprice AS amount,
           c.c_acctbal AS amount__2, c.c_name AS name
    FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey
    """,
)
def unique_names_query(t: Tables):
    joined = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return unique_names(
        joined.select(
            F.col("o_orderkey").alias("id"),
            F.col("c_custkey").alias("id"),
            F.col("o_totalprice").alias("amount"),
            F.col("c_acctbal").alias("amount"),
            F.col("c_name").alias("name"),
        )
    )


@query("column_catalog", catalog_sql())
def column_catalog_query(t: Tables):
    return all_catalogs(t)


_PROMOTION = [
    ("events", "event_type"),
    ("events", "props"),
    ("documents", "text"),
    ("documents", "lang"),
    ("documents", "source"),
    ("pages", "url"),
    ("pages", "html"),
    ("conversations", "role"),
    ("conversations", "text"),
]


@query(
    "json_promotion",
    "\nUNION ALL ".join(
        f"SELECT '{a}' AS table_name, '{b}' AS column_name, {_holds_json_sql(a, b)} AS is_json"
        for a, b in _PROMOTION
    ),
)
def json_promotion_query(t: Tables):
    tables = dict.fromkeys(name for name, _ in _PROMOTION)
    return reduce(DataFrame.unionByName, [json_promotion(getattr(t, n), n) for n in tables])


def mixed_values(t: Tables) -> DataFrame:
    """Events whose payload is an object, a scalar, plain text, an array or missing."""
    return t.events.select("event_id", "value", "ts", F.expr(_MIXED).alias("payload"))


_MIXED = """CASE event_type WHEN 'click' THEN props WHEN 'view' THEN concat('[', user_id, ',"x"]')
  WHEN 'error' THEN CAST(user_id AS STRING) WHEN 'purchase' THEN event_type END"""
_MIXED_SQL = _MIXED.replace("STRING", "VARCHAR")


@query(
    "value_kind_profile",
    f"""
    WITH mixed AS (SELECT event_id, value, ts, {_MIXED_SQL} AS payload FROM events)
    SELECT 'event_id' AS column_name, 'integer' AS kind, count(*) AS n_values FROM mixed
    UNION ALL SELECT 'value', CASE WHEN value IS NULL THEN 'unknown' ELSE 'float' END, count(*)
      FROM mixed GROUP BY 2
    UNION ALL SELECT 'ts', CASE WHEN ts IS NULL THEN 'unknown' ELSE 'timestamp' END, count(*)
      FROM mixed GROUP BY 2
    UNION ALL SELECT 'payload', CASE WHEN payload IS NULL THEN 'unknown'
      WHEN {_IS_JSON.format(c="payload")} THEN 'json' ELSE 'text' END, count(*) FROM mixed GROUP BY 2
    """,
)
def value_kind_profile_query(t: Tables):
    return value_kind_profile(mixed_values(t))


@query(
    "json_normalised",
    f"""
    WITH mixed AS (SELECT event_id, {_MIXED_SQL} AS payload FROM events)
    SELECT event_id, CASE WHEN payload IS NULL THEN NULL
      WHEN json_valid(payload) THEN CAST(json(CASE WHEN json_valid(payload) THEN payload END) AS VARCHAR)
      ELSE '"' || payload || '"' END AS payload
    FROM mixed
    """,
)
def json_normalised(t: Tables):
    payload = canonical_text(decode_or_keep(F.col("payload")))
    return mixed_values(t).select("event_id", payload.alias("payload"))


@query(
    "values_normalised",
    """
    SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority,
           strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS o_orderdate,
           base64(encode(o_orderstatus)) AS status_bytes,
           CASE WHEN o_orderstatus = 'P' THEN '//4=' ELSE o_orderpriority END AS priority_bytes,
           strftime(o_orderdate, '%Y-%m-%d') AS order_day,
           round(o_totalprice, 1) AS price_decimal
    FROM orders
    """,
)
def values_normalised(t: Tables):
    typed = t.orders.withColumns(
        {
            "status_bytes": F.col("o_orderstatus").cast("binary"),
            "order_day": F.col("o_orderdate").cast("date"),
            "price_decimal": F.col("o_totalprice").cast("decimal(18,1)"),
        }
    )
    # Bytes of a text column: as text where they are valid, base64 where they are not.
    stored = F.when(F.col("o_orderstatus") == "P", F.unhex(F.lit("FFFE"))).otherwise(
        F.col("o_orderpriority").cast("binary")
    )
    return normalise(typed.withColumn("priority_bytes", stored), text_columns=["priority_bytes"])


@query(
    "timestamps_normalised",
    """
    SELECT event_id, CASE WHEN extract(microseconds FROM ts) % 1000000 = 0
      THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END AS ts,
      CAST(json(props) AS VARCHAR) AS props
    FROM events
    """,
)
def timestamps_normalised(t: Tables):
    events = t.events.select("event_id", "ts", "props")
    shaped = normalise(events, promoted_columns(events))
    return shaped.withColumn("props", canonical_text(F.col("props")))


@query(
    "row_identity_hash",
    """
    SELECT conv_id, turn, sha1(concat_ws('|',
      coalesce('conv_id=i:' || length(CAST(conv_id AS VARCHAR)) || ':' || conv_id, 'conv_id=n'),
      coalesce('role=s:' || length(role) || ':' || role, 'role=n'),
      coalesce('text=s:' || length(text) || ':' || text, 'text=n'),
      coalesce('turn=i:' || length(CAST(turn AS VARCHAR)) || ':' || turn, 'turn=n')
    )) AS _row_identity
    FROM conversations
    """,
)
def row_identity_hash(t: Tables):
    return with_row_identity(t.conversations).select("conv_id", "turn", "_row_identity")


@query(
    "row_identity_key",
    """
    WITH keyed AS (
      SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE user_id END AS trace_id, event_type
      FROM events)
    SELECT event_id, coalesce(CAST(trace_id AS VARCHAR), sha1(concat_ws('|',
      'event_id=i:' || length(CAST(event_id AS VARCHAR)) || ':' || event_id,
      'event_type=s:' || length(event_type) || ':' || event_type, 'trace_id=n'))) AS _row_identity
    FROM keyed
    """,
)
def row_identity_key(t: Tables):
    trace = F.when(F.col("event_type") != "error", F.col("user_id")).alias("trace_id")
    keyed = t.events.select("event_id", trace, "event_type")
    return with_row_identity(keyed, "trace_id").select("event_id", "_row_identity")


_WARNING_TAIL = 'CAST(NULL AS VARCHAR) AS group_key, {column} AS "column", n AS "count"'


@query(
    "identity_report",
    f"""
    WITH keyed AS (SELECT CASE WHEN lang = 'en' THEN NULL ELSE text END AS k, doc_id FROM documents)
    SELECT 'ROW_IDENTITY_COLUMN_NULL' AS code, {_WARNING_TAIL.format(column="'body'")}
    FROM (SELECT count(*) AS n FROM keyed WHERE k IS NULL) WHERE n > 0
    UNION ALL
    SELECT 'ROW_IDENTITY_DUPLICATE', {_WARNING_TAIL.format(column="'body'")}
    FROM (SELECT count(*) AS n FROM
      (SELECT k FROM keyed WHERE k IS NOT NULL GROUP BY k HAVING count(*) > 1)) WHERE n > 0
    """,
)
def identity_report_query(t: Tables):
    body = F.when(F.col("lang") != "en", F.col("text")).alias("body")
    rows = with_row_identity(t.documents.select("doc_id", body), "body")
    return identity_report(rows, "body")


@query(
    "identity_report_hashes",
    f"""
    SELECT 'ROW_IDENTITY_COLUMN_MISSING' AS code, CAST(NULL AS VARCHAR) AS group_key,
           'message_id' AS "column", CAST(NULL AS BIGINT) AS "count"
    UNION ALL
    SELECT 'ROW_IDENTITY_DUPLICATE', {_WARNING_TAIL.format(column="'message_id'")}
    FROM (SELECT count(*) AS n FROM
      (SELECT text, lang FROM documents GROUP BY text, lang HAVING count(*) > 1)) WHERE n > 0
    """,
)
def identity_report_hashes(t: Tables):
    rows = with_row_identity(t.documents.select("text", "lang"), "message_id")
    return identity_report(rows, "message_id")


@query(
    "identity_collision",
    """
    SELECT _row_identity, CAST(conv_id AS VARCHAR) AS _row_identity_alt,
           '_row_identity_alt' AS warned_column
    FROM (SELECT 'x' || turn AS _row_identity, conv_id FROM conversations)
    """,
)
def identity_collision(t: Tables):
    own = F.concat(F.lit("x"), F.col("turn").cast("string")).alias("_row_identity")
    rows = t.conversations.select(own, "conv_id")
    name = identity_name(rows.columns)
    warned = collision_warning(rows, name).select(F.col("column").alias("warned_column"))
    identified = with_row_identity(rows, "conv_id", name).select("_row_identity", name)
    return identified.withColumn("warned_column", warned.scalar())


@query(
    "visible_projection",
    "SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM orders",
)
def visible_projection(t: Tables):
    return hide_columns(t.orders, ["o_totalprice", "o_orderdate"])


@query(
    "result_summary",
    "\nUNION ALL ".join(
        f"SELECT '{n}' AS table_name, count(*) AS n_rows, {len(s.split(', '))} AS n_columns FROM {n}"
        for n, s in SCHEMAS.items()
    ),
)
def result_summary_query(t: Tables):
    return reduce(DataFrame.unionByName, [result_summary(getattr(t, n), n) for n in TABLES])


_EVENT_ROWS = """
  SELECT event_id, CASE WHEN extract(microseconds FROM ts) % 1000000 = 0
    THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END AS ts,
    event_type, CAST(json(props) AS VARCHAR) AS props FROM events"""


def event_table(t: Tables) -> RowTable:
    return build_row_table(t.events.select("event_id", "ts", "event_type", "props"), "events")


@query(
    "row_table",
    f"""
    SELECT event_id, ts, event_type, props, sha1(concat_ws('|',
      'event_id=i:' || length(CAST(event_id AS VARCHAR)) || ':' || event_id,
      'event_type=s:' || length(event_type) || ':' || event_type,
      'props=j:' || length(props) || ':' || props, 'ts=s:' || length(ts) || ':' || ts)) AS _row_identity
    FROM ({_EVENT_ROWS})
    """,
)
def row_table(t: Tables):
    return event_table(t).rows.withColumn("props", canonical_text(F.col("props")))


@query(
    "row_table_columns",
    """
    SELECT 'events' AS table_name, c.ordinal, c.column_name, c.sql_type, c.inferred_type, c.class, c.params
    FROM (VALUES (1, 'event_id', 'bigint', 'integer', 'text', '{}'),
      (2, 'ts', 'timestamp_ntz', 'timestamp', 'timestamp', '{"format":"YYYY-MM-DD HH:mm:ss"}'),
      (3, 'event_type', 'string', 'text', 'text', '{}'),
      (4, 'props', 'string', 'json', 'json', '{"collapsed":true}')
    ) c(ordinal, column_name, sql_type, inferred_type, class, params)
    WHERE (SELECT bool_or(json_type(props) = 'OBJECT') FROM events)
    """,
)
def row_table_columns(t: Tables):
    return event_table(t).columns
