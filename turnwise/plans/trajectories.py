"""Queries for trajectories and the operators over them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.functions.jsons import canonical_text, decode_or_keep
from turnwise.functions.roles import normalise_role, role_kind, role_missing
from turnwise.operators.conversation import filter_roles, meta_line, role_filter_counts, role_list
from turnwise.operators.identity import IDENTITY, with_row_identity
from turnwise.operators.trajectory import (
    TrajectoryConfig,
    first_seen,
    messages,
    nest,
    summarise,
    trajectory_warnings,
)
from turnwise.operators.trajectory_result import TrajectoryResult, build_trajectories
from turnwise.plans.registry import Tables, query

CONVERSATION = TrajectoryConfig("conv_id", "role", "text", order_by="turn")
SESSION = TrajectoryConfig("user_id", "event_type", "value", tool_calls_column="props", order_by="ts")


def conversation_messages(t: Tables) -> DataFrame:
    return messages(with_row_identity(t.conversations), CONVERSATION, "turn")


def session_messages(t: Tables, cfg: TrajectoryConfig = SESSION) -> DataFrame:
    return messages(with_row_identity(t.events, "event_id"), cfg, "event_id")


@query(
    "trajectory_messages",
    """
    SELECT CAST(conv_id AS VARCHAR) AS group_key, false AS group_is_null,
           count(*) OVER (PARTITION BY conv_id) AS message_count,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS position,
           role, text AS content
    FROM conversations
    """,
)
def trajectory_messages(t: Tables):
    return conversation_messages(t).select(
        "group_key", "group_is_null", "message_count", "position", "role", "content"
    )


@query(
    "trajectory_messages_events",
    """
    SELECT CAST(user_id AS VARCHAR) AS group_key,
           count(*) OVER (PARTITION BY user_id) AS message_count,
           row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS position,
           CAST(event_id AS VARCHAR) AS row_identity, event_type AS role, value AS content,
           CAST(json(props) AS VARCHAR) AS tool_calls
    FROM events
    """,
)
def trajectory_messages_events(t: Tables):
    return session_messages(t).select(
        "group_key",
        "message_count",
        "position",
        "row_identity",
        "role",
        "content",
        canonical_text(F.col("tool_calls")).alias("tool_calls"),
    )


_BUSY_SQL = """
  SELECT event_id, ts, event_type, value, props, CASE WHEN event_type IN ('click', 'view') THEN 0
    WHEN event_type <> 'error' THEN user_id END AS session FROM events"""


def busy_sessions(t: Tables) -> DataFrame:
    """Events in sessions of which one holds two fifths of all rows and one has no key."""
    kind = F.col("event_type")
    session = F.when(kind.isin("click", "view"), 0).when(kind != "error", F.col("user_id"))
    rows = t.events.withColumn("session", session).drop("user_id")
    return with_row_identity(rows, "event_id")


BUSY = TrajectoryConfig("session", "event_type", "value", "props", order_by="value", order_direction="desc")


@query(
    "trajectory_messages_split",
    f"""
    SELECT coalesce(CAST(session AS VARCHAR), '__null__') AS group_key, session IS NULL AS group_is_null,
           count(*) OVER (PARTITION BY session) AS message_count,
           row_number() OVER (PARTITION BY session ORDER BY value DESC NULLS FIRST, event_id) AS position,
           CAST(event_id AS VARCHAR) AS row_identity, event_type AS role
    FROM ({_BUSY_SQL})
    """,
)
def trajectory_messages_split(t: Tables):
    """Sessions above 100 rows are cut into ranges, as very large ones are by default."""
    placed = messages(busy_sessions(t), BUSY, "event_id", max_group_rows=100)
    return placed.select(
        "group_key", "group_is_null", "message_count", "position", "row_identity", "role"
    )


def _flat(nested: DataFrame, text: str = "content") -> DataFrame:
    """Nested rows with their messages written out as one text."""
    written = F.transform(
        "messages",
        lambda m: F.concat_ws(":", m["position"].cast("string"), m["role"], m[text].cast("string")),
    )
    return nested.select(
        "group_key", "group_is_null", "message_count", "segment",
        F.array_join(written, "\n").alias("messages"),
    )


@query(
    "trajectories_nested",
    """
    WITH placed AS (
      SELECT conv_id, role, text, count(*) OVER (PARTITION BY conv_id) AS n,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations)
    SELECT CAST(conv_id AS VARCHAR) AS group_key, false AS group_is_null, n AS message_count,
           CAST((p - 1) // 1000 AS INT) AS segment,
           string_agg(p || ':' || role || ':' || text, chr(10) ORDER BY p) AS messages
    FROM placed GROUP BY ALL
    """,
)
def trajectories_nested(t: Tables):
    return _flat(nest(conversation_messages(t)))


@query(
    "trajectories_nested_segments",
    """
    WITH placed AS (
      SELECT user_id, event_type, event_id, count(*) OVER (PARTITION BY user_id) AS n,
             row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)
    SELECT CAST(user_id AS VARCHAR) AS group_key, false AS group_is_null, n AS message_count,
           CAST((p - 1) // 25 AS INT) AS segment,
           string_agg(p || ':' || event_type || ':' || event_id, chr(10) ORDER BY p) AS messages
    FROM placed GROUP BY ALL
    """,
)
def trajectories_nested_segments(t: Tables):
    return _flat(nest(session_messages(t), segment_rows=25), "row_identity")


@query(
    "trajectories_nested_bytes",
    """
    WITH sized AS (
      SELECT *, row_number() OVER w AS p, strlen(role) + strlen(text) + 16 AS size FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
    placed AS (
      SELECT *, coalesce(sum(size + CASE WHEN size > 400 THEN 800 ELSE 0 END) OVER (
          PARTITION BY conv_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + CASE WHEN size > 400 THEN 400 ELSE 0 END AS start
      FROM sized)
    SELECT CAST(conv_id AS VARCHAR) AS group_key, CAST((p - 1) // 1000 + start // 400 AS BIGINT) AS segment,
      count(*) AS n, CAST(sum(size) AS BIGINT) AS n_bytes, string_agg(p || ':' || role, ' ' ORDER BY p) AS messages
    FROM placed GROUP BY ALL
    """,
)
def trajectories_nested_bytes(t: Tables):
    """Segments of at most 800 bytes; a larger message is one by itself. Groups are cut into parts of 4 000 bytes first."""
    rows = t.conversations.withColumn("id", F.concat_ws("-", "conv_id", "turn"))
    cfg = TrajectoryConfig("conv_id", "role", "text", order_by="turn")
    placed = messages(rows.withColumnRenamed("id", IDENTITY), cfg, "turn", max_bytes=4000, segment_bytes=800)
    return nest(placed).select(
        "group_key",
        "segment",
        F.size("messages").cast("bigint").alias("n"),
        F.aggregate("messages", F.lit(0).cast("bigint"), lambda total, m: total + F.octet_length(m["raw"]["role"]) + F.octet_length(m["raw"]["text"]) + 16).alias("n_bytes"),
        F.array_join(F.transform("messages", lambda m: F.concat_ws(":", m["position"], m["role"])), " ").alias("messages"),
    )


@query(
    "trajectories_null_group",
    """
    WITH keyed AS (
      SELECT CASE event_type WHEN 'error' THEN NULL WHEN 'signup' THEN '__null__'
               ELSE CAST(user_id AS VARCHAR) END AS k, event_id, event_type FROM events),
    placed AS (
      SELECT k, event_id, event_type, count(*) OVER (PARTITION BY k) AS n,
             row_number() OVER (PARTITION BY k ORDER BY event_id) AS p FROM keyed)
    SELECT coalesce(k, '__null__') AS group_key, k IS NULL AS group_is_null, n AS message_count,
           CAST((p - 1) // 1000 AS INT) AS segment,
           string_agg(p || ':' || event_type || ':' || event_id, chr(10) ORDER BY p) AS messages
    FROM placed GROUP BY k, n, (p - 1) // 1000
    """,
)
def trajectories_null_group(t: Tables):
    kind = F.col("event_type")
    key = F.when(kind == "signup", "__null__").when(kind != "error", F.col("user_id").cast("string"))
    rows = t.events.select("event_id", key.alias("session"), "event_type")
    cfg = TrajectoryConfig("session", "event_type", "event_id")
    return _flat(nest(messages(with_row_identity(rows, "event_id"), cfg, "event_id")))


@query(
    "trajectory_first_seen",
    """
    SELECT CAST(user_id AS VARCHAR) AS group_key, false AS group_is_null,
           min(event_id) AS first_seq, count(*) AS message_count
    FROM events GROUP BY user_id
    """,
)
def trajectory_first_seen(t: Tables):
    return first_seen(t.events, SESSION, "event_id")


def _ordered(t: Tables, direction: str) -> DataFrame:
    """Positions by a value that is missing for some events and equal for many."""
    rank = F.when(F.col("event_type") != "error", F.floor("value").cast("bigint"))
    rows = t.events.select("event_id", "user_id", "event_type", rank.alias("rank"))
    cfg = TrajectoryConfig("user_id", "event_type", "rank", order_by="rank", order_direction=direction)
    placed = messages(with_row_identity(rows, "event_id"), cfg, "event_id")
    return placed.select("group_key", "row_identity", "position")


_RANKED = (
    "(SELECT event_id, user_id, CASE WHEN event_type <> 'error' THEN floor(value) END AS r FROM events)"
)


@query(
    "trajectory_positions_asc",
    f"""
    SELECT CAST(user_id AS VARCHAR) AS group_key, CAST(event_id AS VARCHAR) AS row_identity,
           row_number() OVER (PARTITION BY user_id ORDER BY r ASC NULLS LAST, event_id) AS position
    FROM {_RANKED}
    """,
)
def trajectory_positions_asc(t: Tables):
    return _ordered(t, "asc")


@query(
    "trajectory_positions_desc",
    f"""
    SELECT CAST(user_id AS VARCHAR) AS group_key, CAST(event_id AS VARCHAR) AS row_identity,
           row_number() OVER (PARTITION BY user_id ORDER BY r DESC NULLS FIRST, event_id) AS position
    FROM {_RANKED}
    """,
)
def trajectory_positions_desc(t: Tables):
    return _ordered(t, "desc")


@query(
    "trajectory_order_warnings",
    """
    SELECT 'MISSING_ORDER_COLUMN' AS code, CAST(conv_id AS VARCHAR) AS group_key,
           'created_at' AS "column", count(*) AS "count"
    FROM conversations GROUP BY conv_id
    """,
)
def trajectory_order_warnings(t: Tables):
    cfg = TrajectoryConfig("conv_id", "role", "text", order_by="created_at")
    return trajectory_warnings(t.conversations, cfg)


@query(
    "trajectory_unsortable_warnings",
    """
    SELECT 'UNSORTABLE_ORDER_COLUMN' AS code, CAST(user_id AS VARCHAR) AS group_key,
           'payload' AS "column", CAST(NULL AS BIGINT) AS "count"
    FROM events GROUP BY user_id
    HAVING count(DISTINCT json_extract_string(props, '$.k')) > 1
    """,
)
def trajectory_unsortable_warnings(t: Tables):
    rows = t.events.select(
        "user_id", "event_type", "value", decode_or_keep(F.col("props")).alias("payload")
    )
    cfg = TrajectoryConfig("user_id", "event_type", "value", order_by="payload")
    return trajectory_warnings(rows, cfg)


_BLANKED = """CASE event_type WHEN 'error' THEN NULL WHEN 'signup' THEN '   '
  WHEN 'view' THEN '  View ' ELSE event_type END"""


@query(
    "roles_normalised",
    f"""
    SELECT event_id, CASE WHEN coalesce(trim(r), '') = '' THEN 'unknown' ELSE trim(r) END AS role,
           coalesce(trim(r), '') = '' AS role_missing
    FROM (SELECT event_id, {_BLANKED} AS r FROM events)
    """,
)
def roles_normalised(t: Tables):
    role = F.col("r")
    return t.events.select("event_id", F.expr(_BLANKED).alias("r")).select(
        "event_id", normalise_role(role).alias("role"), role_missing(role).alias("role_missing")
    )


@query(
    "trajectory_role_warnings",
    f"""
    SELECT 'MISSING_ROLE_COLUMN' AS code, CAST(user_id AS VARCHAR) AS group_key,
           'r' AS "column", count(*) AS "count"
    FROM (SELECT user_id, {_BLANKED} AS r FROM events)
    WHERE coalesce(trim(r), '') = '' GROUP BY user_id
    """,
)
def trajectory_role_warnings(t: Tables):
    rows = t.events.select("user_id", F.expr(_BLANKED).alias("r"), "value")
    return trajectory_warnings(rows, TrajectoryConfig("user_id", "r", "value"))


@query(
    "tool_calls_decoded",
    """
    SELECT event_id, CASE event_type
      WHEN 'click' THEN CAST(json(props) AS VARCHAR) WHEN 'view' THEN '[' || user_id || ',"a"]'
      WHEN 'error' THEN CAST(user_id AS VARCHAR) WHEN 'purchase' THEN '"[' || user_id || '] x"' END
      AS tool_calls
    FROM events
    """,
)
def tool_calls_decoded(t: Tables):
    kind, user = F.col("event_type"), F.col("user_id").cast("string")
    calls = (
        F.when(kind == "click", F.col("props"))
        .when(kind == "view", F.concat(F.lit(" [ "), user, F.lit(', "a"] ')))
        .when(kind == "error", user)
        .when(kind == "purchase", F.concat(F.lit("["), user, F.lit("] x")))
    )
    rows = t.events.select("event_id", "user_id", "event_type", calls.alias("calls"))
    cfg = TrajectoryConfig("user_id", "event_type", "event_id", tool_calls_column="calls")
    decoded = messages(with_row_identity(rows, "event_id"), cfg, "event_id")
    return decoded.select(
        F.col("raw.event_id").alias("event_id"), canonical_text(F.col("tool_calls")).alias("tool_calls")
    )


@query(
    "trajectory_roles",
    """
    WITH r AS (SELECT user_id, CASE WHEN value > 50 THEN upper(event_type) ELSE event_type END AS role,
                 row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)
    SELECT CAST(user_id AS VARCHAR) AS group_key, false AS group_is_null, lower(role) AS role_key,
           min_by(role, p) AS role, min(p) AS first_position
    FROM r GROUP BY user_id, lower(role)
    """,
)
def trajectory_roles(t: Tables):
    kind = F.when(F.col("value") > 50, F.upper("event_type")).otherwise(F.col("event_type"))
    rows = with_row_identity(t.events.withColumn("event_type", kind), "event_id")
    return role_list(messages(rows, SESSION, "event_id"))


@query(
    "trajectory_role_filter",
    """
    SELECT CAST(conv_id AS VARCHAR) AS group_key, false AS group_is_null,
           count(*) FILTER (WHERE role IN ('user', 'system')) AS visible, count(*) AS total
    FROM conversations GROUP BY conv_id
    """,
)
def trajectory_role_filter(t: Tables):
    return role_filter_counts(conversation_messages(t), ["User", "SYSTEM"])


@query(
    "trajectory_role_filter_messages",
    """
    SELECT CAST(conv_id AS VARCHAR) AS group_key, position, role, content FROM (
      SELECT conv_id, role, text AS content,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS position
      FROM conversations) WHERE role = 'assistant'
    """,
)
def trajectory_role_filter_messages(t: Tables):
    kept = filter_roles(conversation_messages(t), ["Assistant"])
    return kept.select("group_key", "position", "role", "content")


@query(
    "role_kinds",
    """
    SELECT role, kind, count(*) AS n_messages FROM (
      SELECT r AS role, CASE WHEN lower(trim(r)) IN ('system', 'user', 'assistant', 'tool')
        THEN lower(trim(r)) WHEN lower(trim(r)) IN ('unknown', '') THEN 'unknown' ELSE 'other' END AS kind
      FROM (SELECT CASE WHEN turn = 0 THEN ' ' || upper(role) || ' ' WHEN turn = 1 THEN 'Tool'
              WHEN turn = 2 THEN '  ' WHEN turn = 3 THEN 'critic' ELSE role END AS r FROM conversations))
    GROUP BY role, kind
    """,
)
def role_kinds(t: Tables):
    role = F.expr(
        "CASE WHEN turn = 0 THEN concat(' ', upper(role), ' ') WHEN turn = 1 THEN 'Tool' "
        "WHEN turn = 2 THEN '  ' WHEN turn = 3 THEN 'critic' ELSE role END"
    )
    rows = t.conversations.select(role.alias("role"))
    return rows.groupBy("role", role_kind(F.col("role")).alias("kind")).agg(
        F.count("*").alias("n_messages")
    )


@query(
    "message_meta_line",
    """
    SELECT event_id, concat_ws(' · ',
      'created_at: ' || strftime(ts, '%Y-%m-%d %H:%M:%S'),
      CASE WHEN event_type <> 'error' THEN 'latency_ms: ' || CAST(floor(value) AS BIGINT) END,
      CASE WHEN event_type <> 'view' THEN 'Seen_At: ' || event_type END) AS meta
    FROM events
    """,
)
def message_meta_line(t: Tables):
    kind = F.col("event_type")
    rows = t.events.select(
        "event_id",
        "user_id",
        "event_type",
        F.when(kind == "view", "").otherwise(kind).alias("Seen_At"),
        F.when(kind != "error", F.floor("value").cast("double")).alias("latency_ms"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS").alias("created_at"),
    )
    cfg = TrajectoryConfig("user_id", "event_type", "event_id")
    placed = messages(with_row_identity(rows, "event_id"), cfg, "event_id")
    return placed.select(F.col("raw.event_id").alias("event_id"), meta_line(placed, "raw").alias("meta"))


def conversation_result(t: Tables) -> TrajectoryResult:
    """Conversations with some blank roles, through the whole chain."""
    role = F.when(F.col("turn") == 1, "").otherwise(F.col("role"))
    return build_trajectories(t.conversations.withColumn("role", role), CONVERSATION, "turn", "text")


@query(
    "trajectory_result",
    """
    WITH placed AS (
      SELECT conv_id, text, CASE WHEN turn = 1 THEN 'unknown' ELSE role END AS role,
             count(*) OVER (PARTITION BY conv_id) AS n,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations)
    SELECT CAST(conv_id AS VARCHAR) AS group_key, false AS group_is_null, n AS message_count,
           CAST((p - 1) // 1000 AS INT) AS segment,
           string_agg(p || ':' || role || ':' || text, chr(10) ORDER BY p) AS messages
    FROM placed GROUP BY ALL
    """,
)
def trajectory_result(t: Tables):
    return _flat(conversation_result(t).trajectories, "row_identity")


@query(
    "trajectory_result_warnings",
    """
    SELECT 'ROW_IDENTITY_DUPLICATE' AS code, CAST(NULL AS VARCHAR) AS group_key,
           'text' AS "column", n AS "count"
    FROM (SELECT count(*) AS n FROM (SELECT text FROM conversations GROUP BY text HAVING count(*) > 1))
    WHERE n > 0
    UNION ALL
    SELECT 'MISSING_ROLE_COLUMN', CAST(conv_id AS VARCHAR), 'role', count(*)
    FROM conversations WHERE turn = 1 OR trim(role) = '' GROUP BY conv_id
    """,
)
def trajectory_result_warnings(t: Tables):
    return conversation_result(t).warnings


def flagship(t: Tables) -> DataFrame:
    """Conversations as trajectories: length, first and last role, text size and first place."""
    return build_trajectories(t.conversations, CONVERSATION, "turn").summaries


query(
    "trajectory_summaries",
    """
    SELECT CAST(conv_id AS VARCHAR) AS group_key, false AS group_is_null, count(*) AS message_count,
           min_by(role, turn) AS first_role, max_by(role, turn) AS last_role,
           CAST(sum(length(text)) AS BIGINT) AS n_chars, min(turn) AS first_seq
    FROM conversations GROUP BY conv_id
    """,
)(flagship)


@query(
    "trajectory_summaries_long",
    f"""
    SELECT coalesce(CAST(session AS VARCHAR), '__null__') AS group_key, session IS NULL AS group_is_null,
           count(*) AS message_count, arg_min(event_type, event_id) AS first_role,
           arg_max(event_type, event_id) AS last_role,
           CAST(sum(length(event_type)) AS BIGINT) AS n_chars, min(event_id) AS first_seq
    FROM ({_BUSY_SQL}) GROUP BY session
    """,
)
def trajectory_summaries_long(t: Tables):
    """Two fifths of all events in one session, which takes many segments and ranges."""
    cfg = TrajectoryConfig("session", "event_type", "event_type", order_by="event_id")
    rows = with_row_identity(busy_sessions(t), "event_id")
    return summarise(messages(rows, cfg, "event_id", max_group_rows=100), "event_id")


@query(
    "trajectory_role_paths",
    """
    WITH placed AS (
      SELECT conv_id, text, role, count(*) OVER (PARTITION BY conv_id) AS n,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations)
    SELECT CAST(conv_id AS VARCHAR) AS group_key, n AS message_count,
           CAST((p - 1) // 1000 AS INT) AS segment, string_agg(role, '>' ORDER BY p) AS role_path
    FROM placed GROUP BY conv_id, n, (p - 1) // 1000
    """,
)
def trajectory_role_paths(t: Tables):
    """The roles of each segment in order; values of whole trajectories are in the summaries."""
    nested = build_trajectories(t.conversations, CONVERSATION, "turn").trajectories
    path = F.array_join(F.transform("messages", lambda m: m["role"]), ">")
    return nested.select("group_key", "message_count", "segment", path.alias("role_path"))


@query(
    "trajectory_big_orders",
    """
    SELECT event_id, row_number() OVER (PARTITION BY user_id
      ORDER BY 9007199254740993 - event_id % 5 DESC, event_id) AS position
    FROM events
    """,
)
def trajectory_big_orders(t: Tables):
    """Order values beyond 2^53 that differ by one, as JSON numbers."""
    place = F.concat(F.lit("9007199254740"), (F.lit(993) - F.col("event_id") % 5).cast("string"))
    rows = t.events.withColumn("place", F.parse_json(place))
    cfg = TrajectoryConfig("user_id", "event_type", "event_id", order_by="place", order_direction="desc")
    placed = messages(with_row_identity(rows, "event_id"), cfg, "event_id")
    return placed.select(F.col("raw.event_id").alias("event_id"), "position")
