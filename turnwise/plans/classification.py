"""Queries for column classification, over the catalog of all tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnwise.operators.classify import Rule, classify_columns, matching_rules, rule_problems
from turnwise.plans.registry import Tables, query
from turnwise.plans.shaping import all_catalogs, catalog_sql, names_sql

RULES = (
    Rule(1, "text", "exact", '{"type":"markdown"}', 10),
    Rule(2, "o_", "prefix", '{"type":"tag"}', 20),
    Rule(3, "name", "suffix", '{"type":"code","language":"sql"}', 5),
    Rule(4, "[cs]_.*key", "regex", '{"type":"text"}', 5),
    Rule(5, "o_order", "prefix", "{not-json", 90),
    Rule(6, "props", "exact", '{"type":"markdown"}', 99, enabled=False),
    Rule(7, "[", "regex", '{"type":"markdown"}', 99),
    Rule(8, "c_name", "exact", '{"type":"timestamp","format":"YYYY"}', 5),
    Rule(9, "ts", "glob", '{"type":"tag"}', 99),
)

_MATCHES = """
  SELECT c.*, r.rule_id, r.match_type, r.priority FROM cat c JOIN (VALUES
    (1, 'text', 'exact', 10), (2, 'o_', 'prefix', 20), (3, 'name', 'suffix', 5),
    (4, '[cs]_.*key', 'regex', 5), (5, 'o_order', 'prefix', 90), (8, 'c_name', 'exact', 5)
  ) r(rule_id, pattern, match_type, priority) ON CASE r.match_type
    WHEN 'exact' THEN c.column_name = r.pattern
    WHEN 'prefix' THEN starts_with(c.column_name, r.pattern)
    WHEN 'suffix' THEN ends_with(c.column_name, r.pattern)
    ELSE regexp_full_match(c.column_name, r.pattern) END"""


@query("column_rule_matches", f"WITH cat AS ({catalog_sql()}) {_MATCHES}")
def column_rule_matches(t: Tables):
    return matching_rules(all_catalogs(t), RULES)


_TABLE_RULES = """
  SELECT CAST(n_nationkey AS INT) AS id, CASE n_nationkey % 4 WHEN 0 THEN lower(substr(n_name, 1, 1)) || '_'
      WHEN 1 THEN lower(substr(n_name, 1, 1)) || '_key' WHEN 2 THEN 'key'
      ELSE '[' || lower(substr(n_name, 1, 2)) || ']_.*' END AS pattern,
    CASE n_nationkey % 4 WHEN 0 THEN 'prefix' WHEN 1 THEN 'exact' WHEN 2 THEN 'suffix' ELSE 'regex' END AS match_type,
    CAST(n_regionkey AS INT) AS priority FROM nation"""


@query(
    "column_classes_from_table",
    f"""
    SELECT c.table_name, c.column_name, 'code' AS class,
      '{{"language":"l' || arg_min(r.id, (10 - r.priority) * 1000 + r.id) || '"}}' AS params
    FROM ({names_sql()}) c JOIN ({_TABLE_RULES}) r ON CASE r.match_type WHEN 'exact' THEN c.column_name = r.pattern
        WHEN 'prefix' THEN starts_with(c.column_name, r.pattern)
        WHEN 'suffix' THEN ends_with(c.column_name, r.pattern)
        ELSE regexp_full_match(c.column_name, r.pattern) END
    GROUP BY c.table_name, c.column_name
    """,
)
def column_classes_from_table(t: Tables):
    """Rules that are made from a table, of every match type; the columns that they decide."""
    key, name = F.col("n_nationkey"), F.lower("n_name")
    kind = F.element_at(F.array(*map(F.lit, ("prefix", "exact", "suffix", "regex"))), (key % 4 + 1).cast("int"))
    first = F.substring(name, 1, 1)
    pattern = (
        F.when(kind == "prefix", F.concat(first, F.lit("_")))
        .when(kind == "exact", F.concat(first, F.lit("_key")))
        .when(kind == "suffix", "key")
        .otherwise(F.concat(F.lit("["), F.substring(name, 1, 2), F.lit("]_.*")))
    )
    rules = t.nation.select(
        key.cast("int").alias("id"),
        pattern.alias("match_pattern"),
        kind.alias("match_type"),
        F.concat(F.lit('{"type":"code","language":"l'), key.cast("string"), F.lit('"}')).alias("render_config"),
        F.col("n_regionkey").cast("int").alias("priority"),
        F.lit(True).alias("enabled"),
    )
    found = classify_columns(all_catalogs(t), rules).where("class = 'code'")
    return found.select("table_name", "column_name", "class", "params")


@query(
    "column_classes",
    f"""
    SELECT table_name, ordinal, column_name, sql_type, inferred_type,
      CASE WHEN k = 'year' THEN 'timestamp' ELSE k END AS class,
      CASE k WHEN 'json' THEN '{{"collapsed":true}}' WHEN 'code' THEN '{{"language":"sql"}}'
        WHEN 'timestamp' THEN '{{"format":"YYYY-MM-DD HH:mm:ss"}}' WHEN 'year' THEN '{{"format":"YYYY"}}'
        ELSE '{{}}' END AS params
    FROM (SELECT *, CASE
        WHEN starts_with(column_name, 'o_') THEN 'tag'
        WHEN column_name = 'text' THEN 'markdown'
        WHEN ends_with(column_name, 'name') THEN 'code'
        WHEN regexp_full_match(column_name, '[cs]_.*key') THEN 'text'
        WHEN column_name = 'c_name' THEN 'year'
        WHEN inferred_type IN ('json', 'timestamp') THEN inferred_type
        WHEN inferred_type = 'text' AND (lower(column_name) IN ('timestamp', 'time', 'date', 'datetime')
          OR regexp_matches(lower(column_name), '_(at|time|timestamp|date|datetime)$')) THEN 'timestamp'
        WHEN inferred_type = 'text' AND (lower(column_name) IN ('content', 'markdown', 'md')
          OR regexp_matches(lower(column_name), '_(content|markdown|md)$')) THEN 'markdown'
        ELSE 'text' END AS k
      FROM ({catalog_sql()}) cat) picked
    """,
)
def column_classes(t: Tables):
    return classify_columns(all_catalogs(t), RULES)


@query(
    "column_rule_warnings",
    """
    SELECT 'RENDER_RULE_INVALID' AS code, CAST(event_id AS INT) AS rule_id, CASE event_type
        WHEN 'click' THEN 'invalid regex: unterminated character set at position 0'
        WHEN 'view' THEN 'render_config failed validation' WHEN 'error' THEN 'contains invalid JSON'
        WHEN 'purchase' THEN 'render_config must be an object' END AS reason
    FROM events WHERE event_type <> 'signup'
    """,
)
def column_rule_warnings(t: Tables):
    """A rules table made from the events, each kind of event spoiling its rule in its own way."""
    kind = F.col("event_type")
    rules = t.events.select(
        F.col("event_id").cast("int").alias("id"),
        F.when(kind == "click", "[").otherwise(F.concat(kind, F.lit("_[0-9]+"))).alias("match_pattern"),
        F.lit("regex").alias("match_type"),
        F.when(kind == "view", F.col("props"))
        .when(kind == "error", F.concat(F.lit("{"), F.col("props")))
        .when(kind == "purchase", F.concat(F.lit("["), F.col("props"), F.lit("]")))
        .otherwise('{"type":"code"}')
        .alias("render_config"),
        F.col("user_id").cast("int").alias("priority"),
        F.lit(True).alias("enabled"),
    )
    return rule_problems(rules)
