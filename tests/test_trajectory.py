"""Trajectory aggregation on small inputs."""

import random

import pytest
from pyspark.sql import functions as F

from turnwise.errors import AnalyticsError
from turnwise.operators.conversation import (
    filter_roles,
    meta_fields,
    meta_line,
    role_filter_counts,
    role_list,
)
from turnwise.operators.trajectory import (
    TrajectoryConfig,
    first_seen,
    messages,
    nest,
    trajectory_warnings,
)
from turnwise.operators.trajectory_result import build_trajectories

SCHEMA = "_row_identity string, session_id string, role string, content string, created_at bigint, seq bigint"


def cfg(**more):
    return TrajectoryConfig("session_id", "role", "content", **more)


def rows_of(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)


def order_of(df, config, key="row_identity"):
    found = messages(df, config, "seq").orderBy("group_key", "position").collect()
    return [r[key] for r in found]


def test_empty_input_gives_no_trajectories(spark):
    empty = rows_of(spark, [])
    assert messages(empty, cfg(order_by="created_at"), "seq").count() == 0
    assert nest(messages(empty, cfg(), "seq")).count() == 0
    assert trajectory_warnings(empty, cfg()).count() == 0


def generated(seed):
    """Rows of groups of many sizes and keys, NULL and its label among them, with ties and missing order values."""
    rng = random.Random(seed)
    keys = [None, "__null__", "", "p", " p", "P", "pé"][: rng.randint(1, 7)]
    members = [key for key in keys for _ in range(rng.choice([1, 2, 3, 8, 30]))]
    rng.shuffle(members)
    places = rng.sample(range(10_000), len(members))
    return [(f"i{n}", key, rng.choice(["user", "tool"]), f"c{n}", rng.choice([None, 1, 2, 2, 3]), place) for n, (key, place) in enumerate(zip(members, places, strict=True))]


def brute_groups(rows, ascending=None):
    """{group: rows in order}, the groups by their first row."""
    groups = {}
    for row in sorted(rows, key=lambda r: r[5]):
        groups.setdefault(row[1], []).append(row)
    if ascending is None:
        return groups
    sign = 1 if ascending else -1
    return {k: sorted(g, key=lambda r: ((r[4] is None) == ascending, sign * (r[4] or 0), r[5])) for k, g in groups.items()}


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("direction", [None, "asc", "desc"])
def test_groups_equal_brute_force(spark, seed, direction):
    rows = generated(seed)
    wanted = brute_groups(rows, None if direction is None else direction == "asc")
    config = cfg() if direction is None else cfg(order_by="created_at", order_direction=direction)
    placed = messages(rows_of(spark, rows).repartition(3), config, "seq", max_group_rows=[None, 5][seed % 2])
    found = {(r.group_key, r.group_is_null): r for r in nest(placed).collect()}
    assert set(found) == {("__null__" if k is None else k, k is None) for k in wanted}
    for key, group in wanted.items():
        row = found["__null__" if key is None else key, key is None]
        assert row.message_count == len(group) and [m.row_identity for m in row.messages] == [g[0] for g in group]
        assert [m.raw.content for m in row.messages] == [g[3] for g in group] and "_row_identity" not in row.messages[0].raw.asDict()
    if direction is None:
        seen = first_seen(rows_of(spark, rows).repartition(3), config, "seq").orderBy("first_seq").collect()
        assert [(r.group_is_null, r.group_key, r.message_count, r.first_seq) for r in seen] == [(k is None, "__null__" if k is None else k, len(g), g[0][5]) for k, g in wanted.items()]
    assert trajectory_warnings(rows_of(spark, rows), config).count() == 0


def test_number_and_text_keys_of_json_groups_stay_apart(spark):
    df = rows_of(
        spark,
        [("int", "1", "user", "x", None, 0), ("str", '"1"', "user", "y", None, 1),
         ("none", "null", "user", "z", None, 2), ("gone", None, "user", "z", None, 3)],
    ).withColumn("session_id", F.try_parse_json("session_id"))
    found = nest(messages(df, cfg(), "seq")).collect()
    assert sorted((r.group_key, r.group_is_null, r.message_count) for r in found) == [
        ("1", False, 1),
        ("1", False, 1),
        ("__null__", True, 2),
    ]


def test_blank_roles_become_unknown_with_one_warning(spark):
    blanks = [None, "", "\t ", "\x1c", " user "]
    df = rows_of(spark, [(str(i), "s1", r, "x", None, i) for i, r in enumerate(blanks)])
    assert order_of(df, cfg(), "role") == ["unknown"] * 4 + ["user"]
    warned = trajectory_warnings(df, cfg()).collect()
    assert [tuple(w) for w in warned] == [("MISSING_ROLE_COLUMN", "s1", "role", 4)]


def test_missing_order_column_keeps_input_order(spark):
    df = rows_of(
        spark, [("b", "s1", "assistant", "two", None, 0), ("a", "s1", "user", "one", None, 1)]
    ).drop("created_at")
    assert order_of(df, cfg(order_by="created_at")) == ["b", "a"]
    warned = trajectory_warnings(df, cfg(order_by="created_at")).collect()
    assert [tuple(w) for w in warned] == [("MISSING_ORDER_COLUMN", "s1", "created_at", 2)]


@pytest.mark.parametrize(
    ("direction", "expected"), [("asc", list("bdace")), ("desc", list("ceabd"))]
)
def test_null_order_values_and_ties(spark, direction, expected):
    # b < d = a(tie by seq: d first) ; c and e have no value.
    df = rows_of(
        spark,
        [("b", "s", "u", "", 1, 0), ("d", "s", "u", "", 2, 1), ("a", "s", "u", "", 2, 2),
         ("c", "s", "u", "", None, 3), ("e", "s", "u", "", None, 4)],
    )
    if direction == "desc":
        expected = ["c", "e", "d", "a", "b"]
    found = order_of(df.repartition(3), cfg(order_by="created_at", order_direction=direction))
    assert found == expected


def test_tool_calls_are_decoded(spark):
    calls = ['[{"name": "search", "args": {"q": "x"}}]', "not json", "1", None, "[1] x", '"s"']
    df = rows_of(spark, [(str(i), "s1", "assistant", "c", None, i) for i in range(len(calls))])
    calls_df = spark.createDataFrame(list(enumerate(calls)), "seq bigint, tool_calls string")
    df = df.join(calls_df, "seq")
    placed = messages(df, cfg(tool_calls_column="tool_calls"), "seq")
    found = placed.orderBy("position").select(F.to_json("tool_calls").alias("t")).collect()
    assert [r.t for r in found] == [
        '[{"args":{"q":"x"},"name":"search"}]', '"not json"', "1", None, '"[1] x"', '"s"',
    ]


def test_absent_tool_column_is_no_error(spark):
    df = rows_of(spark, [("a", "s", "u", "x", 1, 0)])
    placed = messages(df, cfg(tool_calls_column="nowhere"), "seq").collect()
    assert placed[0].tool_calls is None


@pytest.mark.parametrize(
    ("column", "code"),
    [
        ("session_id", "TRAJECTORY_GROUP_BY_MISSING"),
        ("role", "TRAJECTORY_REQUIRED_COLUMN_MISSING"),
        ("content", "TRAJECTORY_REQUIRED_COLUMN_MISSING"),
        ("_row_identity", "TRAJECTORY_ROW_IDENTITY_MISSING"),
    ],
)
def test_missing_columns_raise(spark, column, code):
    df = rows_of(spark, []).drop(column)
    with pytest.raises(AnalyticsError) as error:
        messages(df, cfg(), "seq")
    assert error.value.code == code


def test_required_columns_are_checked_before_the_group(spark):
    with pytest.raises(AnalyticsError) as error:
        trajectory_warnings(rows_of(spark, []).drop("session_id", "role"), cfg())
    assert error.value.code == "TRAJECTORY_REQUIRED_COLUMN_MISSING"
    assert error.value.detail == {"column": "role"}


def test_empty_config_raises():
    with pytest.raises(AnalyticsError):
        TrajectoryConfig("", "role", "content")
    with pytest.raises(AnalyticsError):
        TrajectoryConfig("s", "role", "content", order_direction="up")


def json_order(spark, values, groups=None):
    groups = groups or ["s1"] * len(values)
    df = rows_of(spark, [(str(i), g, "user", "c", None, i) for i, g in enumerate(groups)])
    keyed = spark.createDataFrame(list(enumerate(values)), "seq bigint, v string")
    return df.join(keyed, "seq").withColumn("created_at", F.try_parse_json("v")).drop("v")


@pytest.mark.parametrize(
    ("values", "expected", "warned"),
    [
        (['{"a":2}', '{"a":1}'], "01", True),
        (["2", '"1"'], "01", True),
        (["2", "1.5", "10"], "102", False),
        (['"b"', '"a"', None], "102", False),
        (['{"a":1}', '{"a":1}', "null"], "012", False),
        (["[2,1]", "[1,9]", "[1]", "[]"], "3210", False),
        (['["b"]', "[]", '["a","z"]'], "120", False),
        (["[1]", '["a"]'], "01", True),
        (["[1]", "1"], "01", True),
        (["9007199254740993", "9007199254740992", "9007199254740992.5"], "120", False),
    ],
)
def test_json_order_column(spark, values, expected, warned):
    df = json_order(spark, values)
    config = cfg(order_by="created_at")
    assert "".join(order_of(df, config)) == expected
    found = [r.code for r in trajectory_warnings(df, config).collect()]
    assert found == (["UNSORTABLE_ORDER_COLUMN"] if warned else [])


def test_unsortable_null_group_keeps_its_order_and_others_sort(spark):
    df = json_order(spark, ['{"a":2}', '{"a":1}', "2", "1"], [None, None, "s", "s"])
    assert order_of(df, cfg(order_by="created_at")) == ["0", "1", "3", "2"]


def test_segments_hold_every_message_once(spark):
    df = rows_of(spark, [(str(i), "s1", "user", str(i), i % 7, i) for i in range(95)])
    config = cfg(order_by="created_at")
    for limit in (None, 10):
        placed = messages(df, config, "seq", max_group_rows=limit)
        segments = nest(placed, segment_rows=20).orderBy("segment").collect()
        assert [s.segment for s in segments] == [0, 1, 2, 3, 4]
        assert {s.message_count for s in segments} == {95}
        assert [m.position for s in segments for m in s.messages] == list(range(1, 96))
        order = [int(m.row_identity) for s in segments for m in s.messages]
        assert order == sorted(range(95), key=lambda i: (i % 7, i))


@pytest.mark.parametrize("limits", [(None, None), (10, None), (1000, 500)])
def test_segments_close_at_messages_or_bytes(spark, limits):
    """Messages of up to five segments' size; the largest are alone, all others together within the limit."""
    rng = random.Random(8)
    sizes = [rng.choice([0, 1, 40, 300, 480, 501, 700, 999, 1001, 5000]) for _ in range(300)]
    df = rows_of(spark, [(str(i), "s1" if i % 3 else "s2", "user", "x" * n, i, i) for i, n in enumerate(sizes)])
    placed = messages(df, cfg(order_by="created_at"), "seq", max_group_rows=limits[0], max_bytes=limits[1], segment_bytes=1000)
    segments = nest(placed, segment_rows=12).orderBy("group_key", "segment").collect()
    fixed = len("s1") + len("user") + 16
    for key in ("s1", "s2"):
        own = [s for s in segments if s.group_key == key]
        assert [m.position for s in own for m in s.messages] == list(range(1, 1 + own[0].message_count))
        for s in own:
            total = sum(len(m.content) + fixed for m in s.messages)
            assert len(s.messages) <= 12 and (total <= 1000 or len(s.messages) == 1)
        # No more segments than needed twice over: neighbours would not fit into one.
        assert len(own) <= 4 * sum(n + fixed for i, n in enumerate(sizes) if (i % 3 > 0) == (key == "s1")) / 1000 + own[0].message_count / 12 + 1


def test_chain_reports_collision_duplicates_and_roles(spark):
    df = spark.createDataFrame(
        [("mine", "s", "user", "same", 1, 0), ("mine", "s", None, "same", 2, 1)], SCHEMA
    )
    result = build_trajectories(df, cfg(order_by="created_at"), "seq", identity_column="content")
    codes = sorted(r.code for r in result.warnings.collect())
    assert codes == ["MISSING_ROLE_COLUMN", "ROW_IDENTITY_DUPLICATE", "ROW_IDENTITY_KEY_COLLISION"]
    row = result.trajectories.collect()[0]
    assert [m.row_identity for m in row.messages] == ["same", "same"]
    assert row.messages[0].raw["_row_identity"] == "mine"


def test_role_list_keeps_first_spelling_and_order(spark):
    roles = ["User", "assistant", "user ", "Tool", "TOOL"]
    df = rows_of(spark, [(str(i), "s", r, "x", None, i) for i, r in enumerate(roles)])
    found = role_list(messages(df, cfg(), "seq")).orderBy("first_position").collect()
    assert [(r.role, r.first_position) for r in found] == [("User", 1), ("assistant", 2), ("Tool", 4)]


def test_role_filter(spark):
    roles = ["User", "assistant", "tool", "user"]
    df = rows_of(spark, [(str(i), "s", r, "x", None, i) for i, r in enumerate(roles)])
    placed = messages(df, cfg(), "seq")
    assert [r.position for r in filter_roles(placed, ["USER"]).orderBy("position").collect()] == [1, 4]
    assert filter_roles(placed, None).count() == 4
    assert role_filter_counts(placed, ["user", "tool"]).collect()[0][-2:] == (3, 4)
    assert role_filter_counts(placed, []).collect()[0].visible == 0


def test_meta_line(spark):
    df = spark.createDataFrame(
        [("2024-01-02T03:04:05+02:00", 12.0, None, 1.5, "not a time"),
         (None, None, "", None, "2024-01-02")],
        "created_at string, latency double, latency_ms string, duration_ms double, Sent_At string",
    )
    assert meta_fields(df.columns) == df.columns
    lines = [r.m for r in df.select(meta_line(df).alias("m")).collect()]
    assert lines == [
        "created_at: 2024-01-02 01:04:05 · latency: 12 · duration_ms: 1.5 · Sent_At: not a time",
        "Sent_At: 2024-01-02 00:00:00",
    ]


def test_input_may_use_the_names_of_the_output(spark):
    names = ["group_value", "position", "message_count", "segment", "row_identity", "group_key"]
    df = rows_of(spark, [("a", "s", "user", "x", 1, 0), ("b", "s", "user", "y", 2, 1)])
    df = df.withColumns({name: F.concat(F.lit(f"{name} "), "content") for name in names})
    for limit in (None, 1):
        row = nest(messages(df, cfg(order_by="created_at"), "seq", max_group_rows=limit)).collect()[0]
        assert [m.row_identity for m in row.messages] == ["a", "b"]
        assert all(row.messages[1].raw[name] == f"{name} y" for name in names)
