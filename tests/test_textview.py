"""Sorting, previews and timestamps on small inputs."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnwise.functions.roles import normalise_role, role_kind
from turnwise.functions.text import block_preview, cell_text, first_line_preview, number_text, one_line
from turnwise.functions.times import format_timestamp, print_utc
from turnwise.operators.tableview import natural_positions, natural_sort


def apply(spark, values, build, kind="string"):
    df = spark.createDataFrame([(v,) for v in values], f"v {kind}")
    return [r[0] for r in df.select(build(F.col("v"))).collect()]


def test_text_sorts_by_the_value_of_digit_runs(spark):
    values = ["a10", "A2", None, "a2", "b", "a", "é1", "e0", "f", "a002b", "a1000000000000000000000"]
    df = spark.createDataFrame(list(enumerate(values)), "seq bigint, v string").repartition(3)
    ascending = [r.v for r in natural_sort(df, [("v", "asc")], "seq").collect()]
    assert ascending == [
        None, "a", "A2", "a2", "a002b", "a10", "a1000000000000000000000", "b", "e0", "é1", "f",
    ]
    descending = [r.v for r in natural_sort(df, [("v", "desc")], "seq").collect()]
    assert descending == [
        "f", "é1", "e0", "b", "a1000000000000000000000", "a10", "a002b", "A2", "a2", "a", None,
    ]


def test_only_the_first_sort_key_counts(spark):
    df = spark.createDataFrame([(0, 2, "x"), (1, 1, "a"), (2, 1, "b")], "seq bigint, n int, v string")
    found = natural_sort(df, [("n", "asc"), ("v", "desc")], "seq").collect()
    assert [r.seq for r in found] == [1, 2, 0]
    assert [r.seq for r in natural_sort(df, [], "seq").collect()] == [0, 1, 2]


def test_numbers_and_booleans_sort_by_value(spark):
    df = spark.createDataFrame([(0, 10.0, True), (1, 9.5, None), (2, None, False)], "seq bigint, n double, b boolean")
    assert [r.seq for r in natural_sort(df, [("n", "asc")], "seq").collect()] == [2, 1, 0]
    assert [r.seq for r in natural_sort(df, [("b", "desc")], "seq").collect()] == [0, 2, 1]


def test_positions_follow_the_sort_and_split_large_tables(spark):
    df = spark.range(400).select(
        F.col("id").alias("seq"), F.concat(F.lit("n"), (F.col("id") * 37 % 100).cast("string")).alias("v")
    )
    wanted = [r.seq for r in natural_sort(df, [("v", "desc")], "seq").collect()]
    placed = natural_positions(df, [("v", "desc")], "seq", max_rows=30)
    assert [r.seq for r in placed.orderBy("row_no").collect()] == wanted


def test_previews(spark):
    long = "x" * 81
    assert apply(spark, ["a\r\nb", "a\nb", "", long, "x" * 80], first_line_preview) == [
        "a", "a", "", "x" * 80 + "...", "x" * 80,
    ]
    assert apply(spark, ["a\nb", "y" * 801], block_preview) == ["a\nb", "y" * 800 + "..."]
    assert apply(spark, ["  select\n\t 1  ", "a" * 70], lambda c: one_line(c, 60)) == [
        "select 1", "a" * 60 + "...",
    ]


def test_cell_text(spark):
    assert apply(spark, [1.0, 2.5, None], lambda c: cell_text(c, T.DoubleType()), "double") == [
        "1", "2.5", "NULL",
    ]
    assert apply(spark, [[1, None]], lambda c: cell_text(c, T.ArrayType(T.IntegerType())), "array<int>") == [
        "[1,null]"
    ]
    variant = lambda c: cell_text(F.try_parse_json(c), T.VariantType())
    assert apply(spark, ['{"b":1,"a":2}', '"s"', "null"], variant) == ['{"a":2,"b":1}', "s", "NULL"]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("2024-01-02", "2024-01-02 00:00:00"),
        ("2024-01-02T03:04:05", "2024-01-02 03:04:05"),
        (" 2024-01-02   03:04:05 ", "2024-01-02 03:04:05"),
        ("2024-01-02T03:04:05Z", "2024-01-02 03:04:05"),
        ("2024-01-02T03:04:05+0200", "2024-01-02 01:04:05"),
        ("2024-01-02T03:04:05.678-05:30", "2024-01-02 08:34:05"),
        ("20240102T030405Z", "2024-01-02 03:04:05"),
        ("2024-01-02T03:04", "2024-01-02 03:04:00"),
        ("2024-01", "2024-01-01 00:00:00"),
        ("2024-13-02", "2024-13-02"),
        ("2024-02-30", "2024-02-30"),
        ("nonsense", "nonsense"),
        ("", ""),
        (None, None),
    ],
)
def test_timestamp_text(spark, text, expected):
    assert apply(spark, [text], lambda c: format_timestamp(c, T.StringType())) == [expected]


def test_timestamp_tokens_and_numbers(spark):
    build = lambda c: format_timestamp(c, T.LongType(), "YY/yyyy DD.dd MM HH'mm ss,SSS Q")
    assert apply(spark, [1704164645678, None], build, "bigint") == ["24/2024 02.02 01 03'04 05,678 Q", None]
    plain = lambda c: format_timestamp(c, T.LongType())
    assert apply(spark, [9_000_000_000_000_000, -1], plain, "bigint") == [
        "9000000000000000", "1969-12-31 23:59:59",
    ]
    assert apply(spark, [None], lambda c: print_utc(c.cast("timestamp"))) == [None]


def test_roles(spark):
    assert apply(spark, [" Tool ", " ", None, "x y"], normalise_role) == ["Tool", "unknown", "unknown", "x y"]
    assert apply(spark, ["SYSTEM", " user", "Assistant", "tool", "", None, "unknown", "critic"], role_kind) == [
        "system", "user", "assistant", "tool", "unknown", "unknown", "unknown", "other",
    ]


@pytest.mark.parametrize(
    ("number", "shown"),
    [
        (0.0005, "0.0005"), (1e16, "10000000000000000"), (0.0, "0"), (-0.0, "0"), (1e-6, "0.000001"), (1e-7, "1e-7"),
        (1.5e-9, "1.5e-9"), (1e21, "1e+21"), (2e22, "2e+22"), (123456789012345680000.0, "123456789012345680000"),
        (0.1, "0.1"), (-2.5, "-2.5"), (100.0, "100"), (1234567.875, "1234567.875"), (0.30000000000000004, "0.30000000000000004"),
    ],
)
def test_numbers_print_as_in_a_browser(spark, number, shown):
    df = spark.createDataFrame([(number,)], "n double")
    assert df.select(number_text(F.col("n"))).collect()[0][0] == shown


def test_times_sort_by_time(spark):
    df = spark.sql("SELECT 1 AS id, TIMESTAMP '2024-01-01 00:00:00.5' AS t UNION ALL SELECT 2, TIMESTAMP '2024-01-01 00:00:00.25'")
    assert [r.id for r in natural_sort(df, [("t", "asc")], "id").collect()] == [2, 1]
