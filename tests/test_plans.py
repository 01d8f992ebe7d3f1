"""What the plans must look like."""

import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
from turnwise.operators.identity import with_row_identity
from turnwise.operators.querylog import QueryLog, retention_survivors
from turnwise.operators.shape import json_promotion, value_kind_profile
from turnwise.operators.trajectory import messages, nest, trajectory_warnings
from turnwise.plans import REGISTRY
from turnwise.plans.registry import Tables
from turnwise.plans.trajectories import CONVERSATION, SESSION

# Regular expressions of rules are Python's.
WITH_PYTHON = {"column_rule_warnings", "column_rule_matches", "column_classes", "column_classes_from_table"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df):
    return len(re.findall(r"\bExchange \w+", plan(df)))


@pytest.mark.parametrize("name", sorted(set(REGISTRY) - WITH_PYTHON))
def test_no_python_and_no_cross_join(spark, data, name):
    text = plan(driver.queries()[name](spark, data))
    assert "Python" not in text and "MapInPandas" not in text
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_long_and_nested_form_need_one_shuffle(spark, data):
    rows = with_row_identity(Tables(spark, data).conversations)
    long_form = messages(rows, CONVERSATION, "turn")
    assert exchanges(long_form) == 1
    assert exchanges(nest(long_form)) == 1
    assert exchanges(trajectory_warnings(rows, CONVERSATION)) == 1


def test_identity_needs_no_shuffle(spark, data):
    assert exchanges(with_row_identity(Tables(spark, data).events)) == 0


def test_promotion_and_profile_scan_once(spark, data):
    events = Tables(spark, data).events
    for df in (json_promotion(events, "events"), value_kind_profile(events)):
        assert plan(df).count("FileScan") == 1
        assert exchanges(df) == 1


def test_unused_columns_are_not_read(spark, data):
    rows = with_row_identity(Tables(spark, data).events, "event_id")
    long_form = messages(rows, SESSION, "event_id")
    schema = plan(long_form.select("group_key", "position", "role")).split("ReadSchema")[1]
    assert "props" not in schema and "value" not in schema


def test_time_filter_is_pushed_down(spark, data):
    text = plan(driver.queries()["recipe_messages"](spark, data))
    assert "GreaterThanOrEqual(ts" in text


def test_long_form_is_the_same_for_any_input_order(spark, data):
    rows = with_row_identity(Tables(spark, data).events, "event_id")
    columns = ["group_key", "position", "row_identity", "role"]
    found = [
        messages(df, SESSION, "event_id").select(*columns)
        for df in (rows.repartition(1), rows.repartition(7, "value"), rows.orderBy(F.desc("value")))
    ]
    for other in found[1:]:
        assert found[0].exceptAll(other).count() == 0
    assert found[0].count() == rows.count()
    ends = found[0].groupBy("group_key").agg(
        F.min("position").alias("a"), F.max("position").alias("b"), F.count("*").alias("n")
    )
    assert ends.where("a <> 1 OR b <> n").count() == 0


SKEW_SETTINGS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64KB",
}


@pytest.fixture
def small_skew_limits(spark):
    before = {key: spark.conf.get(key) for key in SKEW_SETTINGS}
    for key, value in SKEW_SETTINGS.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        spark.conf.set(key, value)


def test_a_parent_with_a_third_of_all_children_is_split(spark, small_skew_limits):
    n = F.col("id")
    parent = F.when(n % 3 == 0, 0).otherwise(n % 1000)
    children = spark.range(0, 200_000, 1, 8).select(
        parent.alias("query_id"), n, F.md5(n.cast("string")).alias("text")
    )
    old = datetime(2020, 1, 1)
    queries = spark.range(1000).withColumn("expires_at", F.when(n % 2 == 1, F.lit(old)))
    history = children.withColumn("executed_at", F.lit(datetime(2024, 1, 1)))
    kept = retention_survivors(QueryLog(queries, history, children, children), datetime(2024, 1, 1))
    for df in (kept.labels, kept.history):
        rows = df._jdf.queryExecution().toRdd().count()
        assert "skew=true" in plan(df)
        assert rows == df.count()
    assert kept.labels.count() == children.where("query_id % 2 = 0").count()
