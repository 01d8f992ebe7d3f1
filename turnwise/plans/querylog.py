"""Queries for query-log analytics; the given tables stand in for the log tables."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime

from pyspark.sql import functions as F

from turnwise.functions.text import LISTED_SQL_PREVIEW, RECENT_SQL_PREVIEW
from turnwise.operators.audit import DANGEROUS_FUNCTIONS, LOCKING_CLAUSES, STATEMENT_TYPES, audit, audit_summary
from turnwise.operators.querylog import (
    QueryLog,
    expiry,
    inventory_counts,
    next_page,
    one_line_preview,
    page,
    page_totals,
    recent_activity,
    retention_report,
    retention_survivors,
    search,
)
from turnwise.operators.searchindex import save_search_index, search_index
from turnwise.plans.registry import Tables, query
from turnwise.sources.shared import fresh_path

NOW = datetime(2000, 1, 1)
_NOW = "TIMESTAMP '2000-01-01 00:00:00'"


@query(
    "paged_listing",
    """
    SELECT event_id, user_id, event_type, value FROM events WHERE event_type = 'purchase'
    ORDER BY ts DESC, event_id DESC LIMIT 50 OFFSET 100
    """,
)
def paged_listing(t: Tables):
    bought = search(t.events, [], equals={"event_type": "purchase"})
    return page(bought, "ts", "event_id", number=3).drop("ts", "props")


@query(
    "paged_listing_deep",
    """
    SELECT o_orderkey, o_custkey, o_orderstatus FROM orders
    ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 500 OFFSET 12000
    """,
)
def paged_listing_deep(t: Tables):
    rows = page(t.orders, "o_orderdate", "o_orderkey", number=25, size=500)
    return rows.select("o_orderkey", "o_custkey", "o_orderstatus")


@query(
    "paged_listing_next",
    """
    SELECT o_orderkey, o_custkey FROM orders
    WHERE o_orderdate < TIMESTAMP '1997-06-01' OR (o_orderdate = TIMESTAMP '1997-06-01' AND o_orderkey < 700)
    ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50
    """,
)
def paged_listing_next(t: Tables):
    after = F.lit(datetime(1997, 6, 1)).cast("timestamp_ntz")
    rows = next_page(t.orders, "o_orderdate", "o_orderkey", after, F.lit(700), 50)
    return rows.select("o_orderkey", "o_custkey")


@query(
    "page_totals",
    """
    SELECT count(*) AS total, CAST(greatest(ceil(count(*) / 50.0), 1) AS BIGINT) AS total_pages
    FROM events
    """,
)
def page_totals_query(t: Tables):
    return page_totals(t.events, 50)


@query(
    "text_search",
    """
    SELECT doc_id, lang, source FROM documents
    WHERE text ILIKE '%tion_%the%' OR lang ILIKE '%tion_%the%' OR source ILIKE '%tion_%the%'
    """,
)
def text_search(t: Tables):
    found = search(t.documents, ["text", "lang", "source"], "TION_%the")
    return found.select("doc_id", "lang", "source")


@query(
    "text_search_active",
    f"""
    SELECT o_orderkey, o_orderpriority FROM orders
    WHERE o_orderpriority ILIKE '%medium%' AND o_orderstatus = 'O'
      AND (CASE WHEN o_custkey > 10 THEN o_orderdate END IS NULL
           OR CASE WHEN o_custkey > 10 THEN o_orderdate END >= {_NOW})
    """,
)
def text_search_active(t: Tables):
    queries = t.orders.withColumn("expires_at", F.expr("CASE WHEN o_custkey > 10 THEN o_orderdate END"))
    found = search(
        queries, ["o_orderpriority"], "Medium", {"o_orderstatus": "O"}, "expires_at", NOW
    )
    return found.select("o_orderkey", "o_orderpriority")


@query(
    "text_search_indexed",
    """
    SELECT doc_id, lang, source FROM documents
    WHERE text ILIKE '%the%and%' OR lang ILIKE '%the%and%' OR source ILIKE '%the%and%'
    """,
)
def text_search_indexed(t: Tables):
    """Postings of all documents, then one search in them."""
    place, columns = fresh_path(t.spark, "search-index"), ["text", "lang", "source"]
    save_search_index(t.documents, columns, "doc_id", place)
    return search_index(t.spark, place, columns, "doc_id", "The%and").select("doc_id", "lang", "source")


@query(
    "expiry_assignment",
    """
    SELECT o_orderkey, strftime(CASE WHEN o_orderstatus = 'P'
      THEN CASE WHEN o_orderpriority <> '1-URGENT' THEN o_orderdate + INTERVAL 1 DAY END
      WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN o_orderdate + INTERVAL 90 DAY
      ELSE o_orderdate + INTERVAL 7 DAY END, '%Y-%m-%d %H:%M:%S') AS expires_at
    FROM orders
    """,
)
def expiry_assignment(t: Tables):
    expires = expiry(
        F.col("o_orderdate"),
        F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"),
        F.col("o_orderstatus") == "P",
        F.expr("CASE WHEN o_orderpriority <> '1-URGENT' THEN o_orderdate + INTERVAL 1 DAY END"),
    )
    return t.orders.select(
        "o_orderkey", F.date_format(expires, "yyyy-MM-dd HH:mm:ss").alias("expires_at")
    )


def log_tables(t: Tables) -> QueryLog:
    """Orders as queries, line items as history and labels, events as analyses."""
    queries = t.orders.select(
        F.col("o_orderkey").alias("id"),
        F.when(F.col("o_orderpriority") != "1-URGENT", F.col("o_orderdate")).alias("expires_at"),
        "o_orderstatus",
    )
    history = t.lineitem.select(
        F.col("l_orderkey").alias("query_id"),
        F.col("l_shipdate").alias("executed_at"),
        "l_partkey",
        "l_quantity",
    )
    labels = t.lineitem.select(F.col("l_orderkey").alias("query_id"), "l_suppkey", "l_returnflag")
    analyses = t.events.select(F.col("event_id").alias("query_id"), "event_type")
    return QueryLog(queries, history, labels, analyses)


_EXPIRED = f"(SELECT o_orderkey FROM orders WHERE o_orderpriority <> '1-URGENT' AND o_orderdate < {_NOW})"


@query(
    "retention_report",
    f"""
    SELECT (SELECT count(*) FROM {_EXPIRED}) AS expired_queries,
      (SELECT count(*) FROM lineitem WHERE l_shipdate < {_NOW} - INTERVAL 30 DAY) AS history_records,
      (SELECT count(*) FROM lineitem WHERE l_orderkey IN {_EXPIRED}) AS label_records,
      (SELECT count(*) FROM events WHERE event_id IN {_EXPIRED}) AS analyses
    """,
)
def retention_report_query(t: Tables):
    return retention_report(log_tables(t), NOW)


@query(
    "retention_survivors",
    f"SELECT o_orderkey AS id, o_orderstatus FROM orders WHERE o_orderkey NOT IN {_EXPIRED}",
)
def retention_survivors_query(t: Tables):
    return retention_survivors(log_tables(t), NOW).queries.select("id", "o_orderstatus")


@query(
    "retention_survivors_labels",
    f"""
    SELECT l_orderkey AS query_id, l_suppkey, l_returnflag FROM lineitem
    WHERE l_orderkey NOT IN {_EXPIRED}
    """,
)
def retention_survivors_labels(t: Tables):
    return retention_survivors(log_tables(t), NOW).labels


@query(
    "retention_survivors_analyses",
    f"SELECT event_id AS query_id, event_type FROM events WHERE event_id NOT IN {_EXPIRED}",
)
def retention_survivors_analyses(t: Tables):
    return retention_survivors(log_tables(t), NOW).analyses


@query(
    "retention_survivors_history",
    f"""
    SELECT CASE WHEN l_orderkey NOT IN {_EXPIRED} THEN l_orderkey END AS query_id, l_partkey, l_quantity
    FROM lineitem WHERE l_shipdate >= {_NOW} - INTERVAL 30 DAY
    """,
)
def retention_survivors_history(t: Tables):
    kept = retention_survivors(log_tables(t), NOW).history
    return kept.select("query_id", "l_partkey", "l_quantity")


@query(
    "recent_activity",
    """
    SELECT h.o_orderkey, h.o_custkey, h.o_orderstatus,
           coalesce(c.c_name, '#' || h.o_custkey) AS connection_label
    FROM (SELECT * FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 10) h
    LEFT JOIN (SELECT * FROM customer WHERE c_mktsegment <> 'BUILDING') c ON c.c_custkey = h.o_custkey
    """,
)
def recent_activity_query(t: Tables):
    known = t.customer.where("c_mktsegment <> 'BUILDING'")
    rows = recent_activity(
        t.orders, known, "o_orderdate", "o_orderkey", "o_custkey", "c_custkey", "c_name"
    )
    return rows.select("o_orderkey", "o_custkey", "o_orderstatus", "connection_label")


_SPACE = (
    r"[\s\v\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
)


@query(
    "one_line_preview",
    f"""
    SELECT doc_id,
      CASE WHEN length(line) > 100 THEN substring(line, 1, 100) || '...' ELSE line END AS recent,
      CASE WHEN length(line) > 60 THEN substring(line, 1, 60) || '...' ELSE line END AS listed
    FROM (SELECT doc_id, trim(regexp_replace(text, '{_SPACE}+', ' ', 'g')) AS line FROM documents)
    """,
)
def one_line_preview_query(t: Tables):
    text = F.col("text")
    return t.documents.select(
        "doc_id",
        one_line_preview(text, RECENT_SQL_PREVIEW).alias("recent"),
        one_line_preview(text, LISTED_SQL_PREVIEW).alias("listed"),
    )


@query(
    "inventory_counts",
    """
    SELECT 'connections' AS item, count(*) AS n FROM customer
    UNION ALL SELECT 'named_queries', count(*) FROM orders WHERE o_orderstatus = 'F'
    """,
)
def inventory_counts_query(t: Tables):
    return inventory_counts(t.customer, t.orders, F.col("o_orderstatus") == "F")


# What does not count inside a text or a comment.
_HIDDEN = ("sleep ({k})", "p into q", "for share", "; drop table p", "@p := {k}")


def _statements() -> Iterator[str]:
    """Statements of every kind, made from the rules; ``{k}`` stands for the order's key and ``~`` for a quote."""
    for inner in _HIDDEN:
        yield f"select ~{inner}~ as q from p"
        yield f"select {{k}} as q -- {inner}\n from p"
        yield f"/* {inner} */ select {{k}}"
    for kind in STATEMENT_TYPES:
        yield f"{kind.lower()} p{{k}}"
    for kind in ("select", "insert", "update", "delete"):
        yield f"with q as (select {{k}} as r) {kind} p"
    for name in DANGEROUS_FUNCTIONS:
        yield f"select {{k}} + {name.lower()} /* now */ (p)"
        yield f"select {name.lower()}, {{k}} from p"
    for clause in LOCKING_CLAUSES:
        yield f"select {{k}} from p {clause.lower()}"
    yield from ("show p{k}", "select {k} into q from p", "select p.into, {k} as into from p", "select @p := {k}", "/* {k} */ ;", "select {k} ;", "select {k} ; select 3", "select /*! {k} */ 4")


_CASES = list(_statements())
# A statement for every order; its key decides which.
STATEMENTS = (
    f"replace(replace(CASE o_orderkey % {len(_CASES)} "
    + " ".join(f"WHEN {number} THEN '{text}'" for number, text in enumerate(_CASES))
    + " END, '~', chr(39)), '{k}', concat('', o_orderkey))"
)

_FUNCTIONS = "|".join(DANGEROUS_FUNCTIONS)
_TYPES = "|".join(STATEMENT_TYPES)
_FORBIDDEN = ", ".join(f"'{kind}'" for kind in (*STATEMENT_TYPES, "EMPTY", "MULTI_STATEMENT", "UNKNOWN"))
_AUDIT_SQL = rf"""
  WITH log AS (SELECT o_orderkey AS id, {STATEMENTS} AS sql_text FROM orders),
  marked AS (SELECT id, regexp_replace(sql_text,
    '(--[^\r\n]*|/\*(?s:.*?)\*/)|''[^'']*''', '\1' || chr(1), 'g') AS m FROM log),
  code AS (SELECT id, m, upper(regexp_replace(m,
    '(--[^\r\n]*|/\*(?s:.*?)\*/)' || chr(1), ' ', 'g')) AS c FROM marked),
  parts AS (SELECT *, [s FOR s IN string_split(c, ';') IF trim(s) <> ''] AS stmts,
    regexp_extract(regexp_replace(c, '(\.|\bAS\b)\s*INTO\b', '\1 NAME', 'g'),
      '(:=|\bINTO\b|\b(?:{_FUNCTIONS})\s*\(|\bFOR\s+UPDATE\b|\bFOR\s+SHARE\b|\bLOCK\s+IN\s+SHARE\s+MODE\b)',
      1) AS hit FROM code),
  typed AS (SELECT *, regexp_replace(regexp_replace(hit, '\s*\($', ''), '\s+', ' ', 'g') AS word,
    regexp_extract(regexp_replace(regexp_replace(stmts[1], '\([^()]*\)', '', 'g'), '^\s*WITH\b', ''),
      '\b({_TYPES})\b', 1) AS kind FROM parts),
  judged AS (SELECT id, CASE WHEN regexp_matches(m, '/\*[!+]') THEN 'EXECUTABLE_COMMENT'
    WHEN word = ':=' THEN 'ASSIGNMENT' WHEN word <> '' THEN word WHEN len(stmts) = 0 THEN 'EMPTY'
    WHEN len(stmts) > 1 THEN 'MULTI_STATEMENT' WHEN kind = '' THEN 'UNKNOWN' ELSE kind END AS detail
    FROM typed)
  SELECT id, CASE WHEN detail = 'SELECT' THEN 'ok'
    WHEN detail IN ({_FORBIDDEN})
    THEN 'SQL_FORBIDDEN_STATEMENT' ELSE 'SQL_DANGEROUS_FUNCTION' END AS verdict, detail FROM judged"""


def logged_statements(t: Tables):
    return t.orders.select(F.col("o_orderkey").alias("id"), F.expr(STATEMENTS).alias("sql_text"))


@query("query_log_audit", _AUDIT_SQL)
def query_log_audit(t: Tables):
    return audit(logged_statements(t)).drop("sql_text")


@query(
    "query_log_audit_summary",
    f"SELECT verdict, detail, count(*) AS n_statements FROM ({_AUDIT_SQL}) GROUP BY verdict, detail",
)
def query_log_audit_summary(t: Tables):
    return audit_summary(logged_statements(t))
