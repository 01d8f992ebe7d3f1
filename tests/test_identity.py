"""Row identity on small inputs."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from turnwise.operators.identity import (
    IDENTITY,
    collision_warning,
    identity_name,
    identity_report,
    with_row_identity,
)


def ids(df, key=None, name=None):
    return [r[name or IDENTITY] for r in with_row_identity(df, key, name).collect()]


def test_column_order_does_not_matter(spark):
    a = spark.createDataFrame([(1, 2)], "a bigint, b bigint")
    assert ids(a) == ids(a.select("b", "a"))


def test_object_key_order_does_not_matter(spark):
    texts = ['{"outer":{"a":[1,{"x":true}],"b":"v"}}', '{"outer":{"b":"v","a":[1,{"x":true}]}}']
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    first, second = ids(df.select(F.parse_json("t").alias("doc")))
    assert first == second
    nested = spark.sql("select named_struct('a', 1, 'b', map('y', 2, 'x', 1)) as s")
    swapped = spark.sql("select named_struct('b', map('x', 1, 'y', 2), 'a', 1) as s")
    assert ids(nested) == ids(swapped)


def test_key_wins_and_null_key_falls_back(spark):
    df = spark.createDataFrame([(123, "changed"), (None, "stable")], "id bigint, content string")
    assert ids(df, "id")[0] == "123"
    assert ids(df, "id")[1] == ids(df)[1]
    assert len(ids(df)[0]) == 40


def test_absent_key_uses_hashes(spark):
    df = spark.createDataFrame([(1,)], "a bigint")
    assert ids(df, "nowhere") == ids(df)


def test_null_differs_from_every_text(spark):
    texts = [None, "__null__", "n", "", "null", "v=n"]
    assert len(set(ids(spark.createDataFrame([(t,) for t in texts], "v string")))) == len(texts)


def test_neighbouring_columns_do_not_run_together(spark):
    df = spark.createDataFrame([("a|b=s:1:x", "y"), ("a", "x|b=s:1:y")], "a string, b string")
    assert len(set(ids(df))) == 2


def test_types_keep_values_apart(spark):
    numbers = [
        spark.sql("select 1 as v"),
        spark.sql("select '1' as v"),
        spark.sql("select true as v"),
        spark.sql("select 1.0D as v"),
        spark.sql("select parse_json('1') as v"),
    ]
    assert len({ids(df)[0] for df in numbers}) == 5


def test_other_types_hash_the_same_every_time(spark):
    row = (Decimal("1.23"), bytearray(b"\x00\xff"), dt.datetime(2024, 1, 2, 3, 4, 5), dt.date(2024, 1, 2))
    df = spark.createDataFrame(
        [row, row], "d decimal(10,2), raw binary, ts timestamp_ntz, day date"
    ).withColumn("doc", F.parse_json(F.lit('{"b":1,"a":null}')))
    first, second = ids(df.repartition(2))
    assert first == second


def test_reserved_names():
    assert identity_name(["a"]) == "_row_identity"
    assert identity_name(["_row_identity"]) == "_row_identity_alt"
    assert identity_name(["_row_identity", "_row_identity_alt"]) == "_row_identity_alt_2"
    taken = ["_row_identity", "_row_identity_alt", "_row_identity_alt_2"]
    assert identity_name(taken) == "_row_identity_alt_3"


def test_collision_warning(spark):
    df = spark.createDataFrame([("x", 1)], "_row_identity string, a bigint")
    name = identity_name(df.columns)
    assert [r.code for r in collision_warning(df, name).collect()] == ["ROW_IDENTITY_KEY_COLLISION"]
    assert collision_warning(df, "_row_identity").count() == 0
    assert with_row_identity(df, "a", name).collect()[0].asDict() == {
        "_row_identity": "x", "a": 1, "_row_identity_alt": "1",
    }


def report(df, key):
    found = identity_report(with_row_identity(df, key), key).collect()
    return [(r.code, r["column"], r["count"]) for r in found]


def test_report(spark):
    schema = "message_id string, content string"
    df = spark.createDataFrame([("d", "a"), ("d", "b"), ("e", "c"), (None, "x")], schema)
    assert report(df, "message_id") == [
        ("ROW_IDENTITY_COLUMN_NULL", "message_id", 1),
        ("ROW_IDENTITY_DUPLICATE", "message_id", 1),
    ]
    assert report(df, "nowhere") == [("ROW_IDENTITY_COLUMN_MISSING", "nowhere", None)]
    assert report(df.where("content in ('a', 'c')"), "message_id") == []
    assert report(df.limit(0), "message_id") == []
