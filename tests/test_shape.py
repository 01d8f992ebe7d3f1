"""Result shaping and JSON handling on small inputs."""

import datetime as dt
import json
from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnwise.errors import AnalyticsError
from turnwise.functions.jsons import container_summary, decode_or_keep, is_container_text
from turnwise.operators.positions import SortKey
from turnwise.operators.result import build_row_table
from turnwise.operators.shape import (
    column_catalog,
    hide_columns,
    inferred_type,
    normalise,
    number_rows,
    preview,
    promoted_columns,
    result_summary,
    shape_result,
    unique_column_names,
    unique_names,
    value_kind_profile,
)


def column(spark, values, kind="string"):
    return spark.createDataFrame([(v,) for v in values], f"v {kind}")


@pytest.mark.parametrize(
    ("names", "expected"),
    [
        (["id", "id", "id__2"], ["id", "id__2", "id__2__2"]),
        (["a", "b"], ["a", "b"]),
        (["id", "id", "id"], ["id", "id__2", "id__3"]),
        (["id__2", "id", "id"], ["id__2", "id", "id__3"]),
    ],
)
def test_unique_column_names(names, expected):
    assert unique_column_names(names) == expected


def test_names_that_differ_in_case(spark):
    assert unique_column_names(["id", "ID"]) == ["id", "ID"]
    assert unique_column_names(["id", "ID", "Id"], case_sensitive=False) == ["id", "ID__2", "Id__3"]
    assert unique_names(spark.sql("select 1 as id, 2 as ID")).columns == ["id", "ID__2"]


def test_awkward_column_names(spark):
    df = spark.createDataFrame([("a", "[1]")], ["a.b", "c d"])
    table = build_row_table(df, "t", "a.b")
    assert table.rows.collect()[0]._row_identity == "a"
    assert [r.inferred_type for r in table.columns.collect()] == ["text", "json"]


def test_bytes_in_a_json_column(spark):
    df = column(spark, [bytearray(b"[1]"), bytearray(b"\xff\xff\xff"), bytearray(b"x"), None], "binary")
    found = normalise(df, ["v"]).select(F.to_json("v").alias("v")).collect()
    assert [r.v for r in found] == ["[1]", '"////"', '"x"', None]


def test_unique_names_of_a_join(spark):
    df = spark.sql("select 1 as id, 2 as id, 3 as id__2")
    assert unique_names(df).collect()[0].asDict() == {"id": 1, "id__2": 2, "id__2__2": 3}


@pytest.mark.parametrize(
    ("sql_type", "expected"),
    [
        ("string", "text"), ("varchar(9)", "text"), ("tinyint", "integer"), ("smallint", "integer"),
        ("int", "integer"), ("bigint", "integer"), ("float", "float"), ("double", "float"),
        ("decimal(10,2)", "float"), ("boolean", "boolean"), ("variant", "json"),
        ("array<int>", "json"), ("map<string,int>", "json"), ("struct<a:int>", "json"),
        ("date", "timestamp"), ("timestamp", "timestamp"), ("timestamp_ntz", "timestamp"),
        ("binary", "binary"), ("void", "unknown"), ("interval day to second", "unknown"),
    ],
)
def test_inferred_types(spark, sql_type, expected):
    kind = T.NullType() if sql_type == "void" else T._parse_datatype_string(sql_type)
    assert inferred_type(kind) == expected


JSON_TEXTS = [
    ('{"x": 1}', True), ("[1, 2]", True), (" [] ", True), ('"scalar"', False), ("1", False),
    ("plain", False), ("", False), (None, False), ("[1] x", False), ('{"a":1} {}', False),
    ("[1], [2]", False), ("[1]], [[2]", False), ("{'a':1}", False), ("{", False), ("null", False),
    ('{"a":1,"a":2}', True), ('\n{"a":[{"b":null}]}\t', True), ('{"a":1}}', False),
]


@pytest.mark.parametrize(("text", "expected"), JSON_TEXTS)
def test_containers(spark, text, expected):
    assert column(spark, [text]).select(is_container_text(F.col("v"))).collect()[0][0] is expected


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ('{"b": 1, "a": [null]}', '{"a":[null],"b":1}'), ("1", "1"), ('"1"', '"1"'), ("true", "true"),
        ("plain", '"plain"'), ("[1] x", '"[1] x"'), ("", '""'), ("null", None), (None, None),
        ('{"a":1,"a":2}', '{"a":2}'), ("01", '"01"'), ('"caf\\u00e9"', '"café"'),
    ],
)
def test_decode_or_keep(spark, text, expected):
    found = column(spark, [text]).select(F.to_json(decode_or_keep(F.col("v")))).collect()[0][0]
    assert found == expected


def test_one_container_promotes_a_column(spark):
    df = spark.createDataFrame([("x", "1", "[1]"), ('{"a":1}', "2", None)], "a string, b string, c string")
    assert promoted_columns(df) == ["a", "c"]
    assert promoted_columns(df.limit(0)) == []
    kinds = {r.column_name: r.inferred_type for r in column_catalog(df, "t").collect()}
    assert kinds == {"a": "json", "b": "text", "c": "json"}
    assert {r.inferred_type for r in column_catalog(df, "t", ()).collect()} == {"text"}


def test_late_json_is_found(spark):
    df = spark.range(1000).select(
        F.when(F.col("id") == 999, "[1]").otherwise("x").alias("late"), F.lit("{}").alias("early")
    )
    assert promoted_columns(df) == ["late", "early"]


def test_value_kinds(spark):
    df = spark.createDataFrame(
        [('{"x": 1}', 1, 1.5, True, dt.datetime(2024, 1, 1), bytearray(b"\0"), Decimal(1)),
         ('"scalar"', None, None, None, None, None, None)],
        "s string, i bigint, f double, b boolean, t timestamp, y binary, d decimal(5,1)",
    ).withColumn("v", F.try_parse_json("s"))
    found = {(r.column_name, r.kind): r.n_values for r in value_kind_profile(df).collect()}
    assert found == {
        ("s", "json"): 1, ("s", "text"): 1, ("i", "integer"): 1, ("i", "unknown"): 1,
        ("f", "float"): 1, ("f", "unknown"): 1, ("b", "boolean"): 1, ("b", "unknown"): 1,
        ("t", "timestamp"): 1, ("t", "unknown"): 1, ("y", "binary"): 1, ("y", "unknown"): 1,
        ("d", "unknown"): 2, ("v", "json"): 1, ("v", "text"): 1,
    }


def test_normalised_values(spark):
    df = spark.createDataFrame(
        [(dt.datetime(2024, 1, 2, 3, 4, 5), dt.datetime(2024, 1, 2, 3, 4, 5, 60), dt.date(2024, 1, 2),
          '{"b":1}', bytearray(b"\x00\xff"), Decimal("1.50"), None, [1, 2])],
        "a timestamp, b timestamp_ntz, c date, p string, y binary, d decimal(10,2), z string, l array<int>",
    )
    row = normalise(df, ["p"]).withColumns({"p": F.to_json("p"), "l": F.to_json("l")}).collect()[0]
    assert row.asDict() == {
        "a": "2024-01-02T03:04:05", "b": "2024-01-02T03:04:05.000060", "c": "2024-01-02",
        "p": '{"b":1}', "y": "AP8=", "d": 1.5, "z": None, "l": "[1,2]",
    }


def test_shaped_result_parses_promoted_columns_only(spark):
    df = spark.createDataFrame([("[1]", "1"), ("1", "x")], "a string, b string")
    shaped = shape_result(df)
    assert [f.dataType.simpleString() for f in shaped.schema.fields] == ["variant", "string"]
    assert [r.a for r in shaped.select(F.to_json("a").alias("a")).collect()] == ["[1]", "1"]


def test_preview_is_cut_and_flagged(spark):
    df = spark.range(1, 4).toDF("id").repartition(3)
    rows, warnings = preview(df, ["id"], 2)
    assert [r.id for r in rows.collect()] == [1, 2]
    assert [r.code for r in warnings.collect()] == ["RESULT_TRUNCATED"]
    assert preview(df, ["id"], 3)[1].count() == 0
    for bad in (0, 100_001):
        with pytest.raises(AnalyticsError):
            preview(df, ["id"], bad)


def test_hidden_columns_are_not_read(spark, data):
    from turnwise.sources.tables import read_table

    plan = hide_columns(read_table(spark, data, "orders"), ["o_totalprice"])
    text = plan.select("*")._jdf.queryExecution().executedPlan().toString()
    assert "o_totalprice" not in text.split("ReadSchema")[1]


def test_row_numbers_and_summary(spark):
    df = spark.range(0, 500, 1, 7).withColumn("v", F.col("id") % 3)
    numbered = number_rows(df, [SortKey("v"), SortKey("id")], max_rows=50).orderBy("row_no").collect()
    assert [r.row_no for r in numbered] == list(range(1, 501))
    assert [(r.v, r.id) for r in numbered] == sorted((r.v, r.id) for r in numbered)
    assert tuple(result_summary(df, "t").collect()[0]) == ("t", 500, 2)


@pytest.mark.parametrize(
    ("text", "expected"),
    [('{"a":1,"b":2}', "2 keys"), ("{}", ""), ("[]", ""), ("[1,[2,3]]", "2 items"), ("1", None), (None, None)],
)
def test_container_summary(spark, text, expected):
    assert column(spark, [text]).select(container_summary(F.col("v"))).collect()[0][0] == expected


def test_row_table(spark):
    df = spark.createDataFrame([(1, '{"a":1}'), (1, "x")], "id bigint, created_at string")
    table = build_row_table(df, "t", "id")
    assert [r._row_identity for r in table.rows.collect()] == ["1", "1"]
    assert [(r.column_name, r["class"]) for r in table.columns.collect()] == [
        ("id", "text"), ("created_at", "json"),
    ]
    assert [(r.code, r["count"]) for r in table.warnings.collect()] == [("ROW_IDENTITY_DUPLICATE", 1)]


PIECES = st.sampled_from(list('{}[]",: \n1-0.e') + ["true", "null", '"a"', '"a":', "[1]", "{}", "\\u00e9", "\\"])


def python_json(text):
    try:
        return True, json.loads(text)
    except ValueError:
        return False, text


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(PIECES, max_size=7).map("".join), min_size=150, max_size=300))
def test_json_is_read_like_python_reads_it(spark, texts):
    found = (
        column(spark, texts)
        .select("v", is_container_text(F.col("v")).alias("c"), F.to_json(decode_or_keep(F.col("v"))).alias("j"))
        .collect()
    )
    for row in found:
        valid, value = python_json(row.v)
        assert row.c is (valid and isinstance(value, (dict, list))), row.v
        assert (None if row.j is None else json.loads(row.j)) == value, row.v
