"""Queries for table-view operations."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnwise.functions.jsons import container_summary
from turnwise.functions.text import block_preview, first_line_preview
from turnwise.functions.times import format_timestamp
from turnwise.operators.numbering import append_numbered, read_numbered
from turnwise.operators.positions import SortKey, with_positions
from turnwise.operators.shape import number_rows
from turnwise.operators.tableview import natural_positions
from turnwise.plans.registry import Tables, query
from turnwise.sources.shared import fresh_path


def _labelled_parts(t: Tables):
    """Parts named ``name size`` with some names in capitals and some missing."""
    name = F.concat_ws(" ", F.col("p_name"), F.col("p_size").cast("string"))
    shown = F.when(F.col("p_type") == "ECONOMY", F.upper(name)).when(
        F.col("p_type") != "PROMO", name
    )
    return t.part.select("p_partkey", shown.alias("part_label"))


_PARTS_SQL = """
  SELECT p_partkey, p_name, p_size, CASE WHEN p_type = 'ECONOMY' THEN upper(p_name || ' ' || p_size)
    WHEN p_type <> 'PROMO' THEN p_name || ' ' || p_size END AS part_label FROM part"""


@query(
    "natural_sort",
    f"""
    SELECT p_partkey, part_label, row_number() OVER (ORDER BY part_label IS NOT NULL,
      CASE WHEN part_label IS NOT NULL THEN p_name END,
      CASE WHEN part_label IS NOT NULL THEN p_size END, p_partkey) AS row_no
    FROM ({_PARTS_SQL})
    """,
)
def natural_sort_query(t: Tables):
    return natural_positions(_labelled_parts(t), [("part_label", "asc")], "p_partkey")


@query(
    "natural_sort_desc",
    f"""
    SELECT p_partkey, part_label, row_number() OVER (ORDER BY part_label IS NULL,
      CASE WHEN part_label IS NOT NULL THEN p_name END DESC,
      CASE WHEN part_label IS NOT NULL THEN p_size END DESC, p_partkey) AS row_no
    FROM ({_PARTS_SQL})
    """,
)
def natural_sort_desc(t: Tables):
    return natural_positions(_labelled_parts(t), [("part_label", "desc")], "p_partkey")


@query(
    "natural_sort_customers",
    """
    SELECT c_custkey, c_name, row_number() OVER (ORDER BY c_custkey) AS row_no FROM customer
    """,
)
def natural_sort_customers(t: Tables):
    return natural_positions(t.customer.select("c_custkey", "c_name"), [("c_name", "asc")], "c_custkey")


@query(
    "row_numbers",
    """
    SELECT event_id, event_type, row_number() OVER (ORDER BY value DESC NULLS LAST, event_id) AS row_no
    FROM events
    """,
)
def row_numbers(t: Tables):
    order = [SortKey("value", ascending=False, nulls_first=False), SortKey("event_id")]
    return number_rows(t.events.select("event_id", "event_type", "value"), order).drop("value")


@query(
    "row_numbers_split",
    """
    SELECT l_orderkey, l_partkey, l_quantity, row_number() OVER (ORDER BY l_quantity DESC NULLS LAST,
      l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS row_no
    FROM lineitem
    """,
)
def row_numbers_split(t: Tables):
    """The table is cut into ranges of about 1000 rows, as a very large one is by default."""
    unique = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    order = [SortKey("l_quantity", False, False), *[SortKey(c) for c in unique]]
    lines = t.lineitem.select("l_quantity", *unique)
    return number_rows(lines, order, max_rows=1000).select(
        "l_orderkey", "l_partkey", "l_quantity", "row_no"
    )


@query(
    "row_numbers_appended",
    """
    SELECT event_id, event_type, value, row_number() OVER (ORDER BY event_type IN ('click', 'view'),
      value DESC NULLS LAST, event_id) AS row_no
    FROM events
    """,
)
def row_numbers_appended(t: Tables):
    """All events in two appends: clicks and views come later than the others."""
    order = [SortKey("value", ascending=False, nulls_first=False), SortKey("event_id")]
    later, place = F.coalesce(F.col("event_type").isin("click", "view"), F.lit(False)), fresh_path(t.spark, "numbered")
    events = t.events.select("event_id", "event_type", "value")
    for part in (events.where(~later), events.where(later)):
        append_numbered(part, order, place)
    return read_numbered(t.spark, place)


@query(
    "text_preview",
    r"""
    SELECT doc_id, CASE WHEN length(line) > 80 THEN substring(line, 1, 80) || '...' ELSE line END AS line,
           CASE WHEN length(text) > 800 THEN substring(text, 1, 800) || '...' ELSE text END AS block
    FROM (SELECT doc_id, text, regexp_split_to_array(text, '\r?\n')[1] AS line FROM documents)
    """,
)
def text_preview(t: Tables):
    text = F.col("text")
    return t.documents.select(
        "doc_id", first_line_preview(text).alias("line"), block_preview(text).alias("block")
    )


@query(
    "json_summary",
    """
    WITH mixed AS (SELECT event_id, CASE event_type WHEN 'click' THEN props WHEN 'view' THEN '{}'
      WHEN 'error' THEN '[' || user_id || ',2,[3]]' WHEN 'purchase' THEN '[]' ELSE event_type END AS j
      FROM events)
    SELECT event_id, CASE WHEN NOT json_valid(j) THEN NULL
      WHEN json_type(CASE WHEN json_valid(j) THEN j END) = 'OBJECT'
      THEN CASE WHEN len(json_keys(CASE WHEN json_valid(j) THEN j END)) = 0 THEN ''
           ELSE len(json_keys(CASE WHEN json_valid(j) THEN j END)) || ' keys' END
      ELSE CASE WHEN json_array_length(CASE WHEN json_valid(j) THEN j END) = 0 THEN ''
           ELSE json_array_length(CASE WHEN json_valid(j) THEN j END) || ' items' END END AS summary
    FROM mixed
    """,
)
def json_summary(t: Tables):
    kind = F.col("event_type")
    value = (
        F.when(kind == "click", F.col("props"))
        .when(kind == "view", "{}")
        .when(kind == "error", F.concat(F.lit("["), F.col("user_id"), F.lit(",2,[3]]")))
        .when(kind == "purchase", "[]")
        .otherwise(kind)
    )
    return t.events.select("event_id", container_summary(value).alias("summary"))


@query(
    "timestamp_format",
    """
    SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS plain,
      strftime(ts, '%d.%m.%y at %H:%M:%S.%g') AS custom,
      strftime(make_timestamp(epoch_us(ts) // 1000 * 1000), '%Y-%m-%d %H:%M:%S') AS from_millis,
      CASE event_type
        WHEN 'click' THEN strftime(ts, '%Y-%m-%d %H:%M:%S')
        WHEN 'view' THEN strftime(ts - INTERVAL 2 HOUR, '%Y-%m-%d %H:%M:%S')
        WHEN 'error' THEN strftime(ts, '%Y-%m-%d 00:00:00')
        WHEN 'purchase' THEN strftime(ts, '%Y-%m-%d %H:%M:00')
        ELSE 'signup at ' || event_id END AS mixed
    FROM events
    """,
)
def timestamp_format(t: Tables):
    ts, kind = F.col("ts"), F.col("event_type")
    text = (
        F.when(kind == "click", F.date_format(ts, "  yyyy-MM-dd   HH:mm:ss.SSSSSS"))
        .when(kind == "view", F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'+0200'"))
        .when(kind == "error", F.date_format(ts, "yyyy-MM-dd"))
        .when(kind == "purchase", F.date_format(ts, "yyyyMMdd'T'HHmm'Z'"))
        .otherwise(F.concat(F.lit("signup at "), F.col("event_id")))
    )
    millis = F.unix_millis(ts.cast("timestamp"))
    return t.events.select(
        "event_id",
        format_timestamp(ts, T.TimestampNTZType()).alias("plain"),
        format_timestamp(ts, T.TimestampNTZType(), "DD.MM.YY at HH:mm:ss.SSS").alias("custom"),
        format_timestamp(millis, T.LongType()).alias("from_millis"),
        format_timestamp(text, T.StringType()).alias("mixed"),
    )


@query(
    "line_positions_split",
    """
    SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_returnflag
      ORDER BY l_orderkey, l_linenumber) AS position FROM lineitem
    """,
)
def line_positions_split(t: Tables):
    """Three large groups in an order that only two columns together make total, cut into ranges."""
    lines = t.lineitem.select("l_returnflag", "l_orderkey", "l_linenumber")
    order = [SortKey("l_orderkey"), SortKey("l_linenumber")]
    return with_positions(lines, ["l_returnflag"], order, max_rows=1000).drop("l_returnflag")


@query(
    "natural_sort_times",
    """
    SELECT event_id, row_number() OVER (ORDER BY shifted, event_id) AS row_no FROM (
      SELECT event_id, ts + to_milliseconds(event_id % 4 * 250) AS shifted FROM events)
    """,
)
def natural_sort_times(t: Tables):
    """Times with fractions, whose texts would sort otherwise."""
    shifted = F.col("ts") + F.make_dt_interval(secs=(F.col("event_id") % 4 * F.lit(0.25)).cast("decimal(18,6)"))
    rows = t.events.select("event_id", shifted.alias("at"))
    return natural_positions(rows, [("at", "asc")], "event_id").drop("at")
