"""Query-log analytics on small inputs."""

from datetime import datetime, timedelta

import random

import pytest
from pyspark.sql import functions as F

from turnwise.errors import AnalyticsError
from turnwise.operators import querylog
from turnwise.operators.querylog import (
    QueryLog,
    expiry,
    inventory_counts,
    next_page,
    page,
    page_totals,
    recent_activity,
    retention_report,
    retention_survivors,
    save_log,
    search,
)

NOW = datetime(2024, 6, 1)
QUERIES = (
    "id int, connection_id int, name string, description string, sql_text string, is_named boolean, "
    "created_at timestamp, expires_at timestamp"
)


@pytest.fixture(scope="module")
def queries(spark):
    day = timedelta(days=1)
    return spark.createDataFrame(
        [
            (1, 1, None, None, "SELECT 1", False, NOW - 9 * day, NOW - day),
            (2, 1, "Bad Cases", "weekly 50% report", "SELECT x", True, NOW, NOW + day),
            (3, 2, "other", None, "select BAD from t", True, NOW, None),
            (4, 2, "a\\b", None, "x", True, NOW - day, NOW),
        ],
        QUERIES,
    )


@pytest.fixture(scope="module")
def log(spark, queries):
    children = spark.createDataFrame([(1, 1), (2, 1), (3, 2)], "id int, query_id int")
    analyses = spark.createDataFrame([(1, 1), (2, 3)], "id int, query_id int")
    history = spark.createDataFrame(
        [
            (1, 1, NOW - timedelta(days=60)), (2, 1, NOW - timedelta(days=1)), (3, 2, NOW),
            (4, None, NOW - timedelta(days=1)), (5, 3, NOW - timedelta(days=30)),
        ],
        "id int, query_id int, executed_at timestamp",
    )
    return QueryLog(queries, history, children, analyses)


def test_pages(spark):
    df = spark.range(1, 8).select("id", (F.col("id") % 2).alias("t"))
    assert [r.id for r in page(df, "t", "id", 1, 3).collect()] == [7, 5, 3]
    assert [r.id for r in page(df, "t", "id", 3, 3).collect()] == [2]
    assert page(df, "t", "id", 4, 3).count() == 0
    assert tuple(page_totals(df, 3).collect()[0]) == (7, 3)
    assert tuple(page_totals(df.limit(0), 3).collect()[0]) == (0, 1)
    after = next_page(df, "t", "id", F.lit(1), F.lit(3), 3)
    assert [r.id for r in after.collect()] == [1, 6, 4]
    for number, size in ((0, 3), (1, 0), (1, 501)):
        with pytest.raises(AnalyticsError):
            page(df, "t", "id", number, size)


def test_deep_pages_equal_shallow_ones(spark, monkeypatch):
    df = spark.range(300).select("id", (F.col("id") % 7).alias("t"))
    shallow = [r.id for r in page(df, "t", "id", 4, 50).collect()]
    monkeypatch.setattr(querylog, "SHALLOW_ROWS", 10)
    deep = page(df, "t", "id", 4, 50, max_rows=40)
    assert deep.columns == df.columns
    assert sorted(r.id for r in deep.collect()) == sorted(shallow)


@pytest.mark.parametrize(
    ("options", "expected"),
    [
        ({}, [1, 2, 3, 4]),
        ({"text": "bad"}, [2, 3]),
        ({"text": "50%"}, [2]),
        ({"text": "s_lect"}, [1, 2, 3]),
        ({"text": "\\"}, [4]),
        ({"equals": {"connection_id": 1, "is_named": True}}, [2]),
        ({"equals": {"connection_id": 1, "is_named": None}}, [1, 2]),
        ({"expires": "expires_at", "now": NOW}, [2, 3, 4]),
        ({"text": "select", "expires": "expires_at", "now": NOW}, [2, 3]),
    ],
)
def test_search(queries, options, expected):
    found = search(queries, ["name", "description", "sql_text"], **options)
    assert sorted(r.id for r in found.collect()) == expected


def test_expiry(spark):
    df = spark.createDataFrame(
        [(False, False, None), (True, False, None), (True, True, None), (False, True, NOW)],
        "named boolean, explicit boolean, given timestamp",
    )
    found = df.select(expiry(F.lit(NOW), F.col("named"), F.col("explicit"), F.col("given")).alias("e"))
    assert [r.e for r in found.collect()] == [NOW + timedelta(days=7), NOW + timedelta(days=90), None, NOW]


def test_retention_report(log):
    assert retention_report(log, NOW).collect()[0].asDict() == {
        "expired_queries": 1, "history_records": 1, "label_records": 2, "analyses": 1,
    }
    nothing = retention_report(log, datetime(2000, 1, 1)).collect()[0]
    assert list(nothing) == [0, 0, 0, 0]


def test_retention_survivors(log):
    kept = retention_survivors(log, NOW)
    assert sorted(r.id for r in kept.queries.collect()) == [2, 3, 4]
    assert [r.id for r in kept.labels.collect()] == [3]
    assert [r.id for r in kept.analyses.collect()] == [2]
    history = sorted((r.id, r.query_id) for r in kept.history.collect())
    assert history == [(2, None), (3, 2), (4, None), (5, 3)]
    assert list(retention_report(kept, NOW).collect()[0]) == [0, 0, 0, 0]


def test_recent_activity(spark, log):
    history = log.history.withColumn("connection_id", F.col("id"))
    names = spark.createDataFrame([(3, "main"), (9, "spare")], "id int, name string")
    names = names.toDF("connection_key", "connection_name")
    found = recent_activity(
        history, names, "executed_at", "id", "connection_id", "connection_key", "connection_name", 3
    )
    assert sorted((r.id, r.connection_label) for r in found.collect()) == [
        (2, "#2"), (3, "main"), (4, "#4"),
    ]


def test_inventory(spark, queries):
    connections = spark.range(3)
    found = inventory_counts(connections, queries, F.col("is_named"))
    assert {r["item"]: r.n for r in found.collect()} == {"connections": 3, "named_queries": 3}


def test_saved_log_reads_back(spark, log, tmp_path):
    save_log(retention_survivors(log, NOW), str(tmp_path / "kept"))
    history = spark.read.parquet(str(tmp_path / "kept" / "query_history"))
    assert sorted(r.id for r in history.collect()) == [2, 3, 4, 5]
    assert "executed_on" in history.columns
    assert spark.read.parquet(str(tmp_path / "kept" / "named_queries")).count() == 3
    with pytest.raises(Exception, match="exist"):
        save_log(log, str(tmp_path / "kept"))


def test_walking_all_pages_by_key_visits_every_row_once(spark):
    times = [None, None, None, *[datetime(2024, 1, d) for d in (1, 2, 2, 3, 3, 3)]]
    rows = [(i, t) for i, t in enumerate(times)] + [(None, None), (None, datetime(2024, 1, 2))]
    df = spark.createDataFrame(rows, "id int, at timestamp")
    seen = [tuple(r) for r in page(df, "at", "id", 1, 2).collect()]
    while True:
        last = seen[-1]
        after = [F.lit(last[1]).cast("timestamp"), F.lit(last[0]).cast("int")]
        found = next_page(df, "at", "id", *after, 2).collect()
        if not found:
            break
        seen += [tuple(r) for r in found]
    assert len(seen) == len(rows) and set(seen) == set(rows)


def test_deep_pages_are_in_order_without_adaptive_execution(spark, monkeypatch):
    monkeypatch.setattr(querylog, "SHALLOW_ROWS", 10)
    df = spark.range(5000).select("id", (F.col("id") % 7).alias("at"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = [r.id for r in page(df, "at", "id", 5, 300, max_rows=200).collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    wanted = sorted(range(5000), key=lambda i: (-(i % 7), -i))[1200:1500]
    assert found == wanted


def test_history_is_scanned_once_and_times_reach_the_scan(spark, tmp_path):
    rows = [(i, None if i % 3 else i, datetime(2024, 1, 1 + i % 20)) for i in range(60)]
    spark.createDataFrame(rows, "id int, query_id int, executed_at timestamp").write.parquet(str(tmp_path / "h"))
    spark.createDataFrame([(i, datetime(2024, 1, 1 + i % 9)) for i in range(0, 60, 3)], "id int, expires_at timestamp").write.parquet(str(tmp_path / "q"))
    history, queries = spark.read.parquet(str(tmp_path / "h")), spark.read.parquet(str(tmp_path / "q"))
    empty = spark.createDataFrame([], "query_id int")
    kept = querylog.retention_survivors(QueryLog(queries, history, empty, empty), datetime(2024, 2, 8)).history
    text = kept._jdf.queryExecution().executedPlan().toString()
    assert text.count("FileScan parquet") == 2 and text.count("GreaterThanOrEqual(executed_at") == 1
    expired = {i for i in range(0, 60, 3) if datetime(2024, 1, 1 + i % 9) < datetime(2024, 2, 8)}
    wanted = sorted((i, p if p is not None and p not in expired else None) for i, p, t in rows if t >= datetime(2024, 1, 9))
    assert sorted((r.id, r.query_id) for r in kept.collect()) == sorted(wanted, key=lambda r: (r[0], r[1] or 0))


def test_rows_without_parent_are_dealt_by_their_other_columns(spark):
    df = spark.range(2000).select("id", F.lit(None).cast("int").alias("query_id"), F.create_map(F.lit("a"), F.lit(1)).alias("m"))
    dealt = df.select(querylog._dealt(df, "query_id").alias("d")).groupBy("d").count().collect()
    assert len(dealt) > 1000 and all(r.d > 0 for r in dealt)
    assert spark.range(3).select(F.lit(None).cast("int").alias("query_id")).transform(lambda t: t.select(querylog._dealt(t, "query_id").alias("d"))).distinct().count() == 1


def days_log(spark, seed):
    """A log of 90 days, most parents of which never expire."""
    rng = random.Random(seed)
    start = datetime(2024, 1, 1)
    queries = [(i, None if i % 3 else start + timedelta(days=rng.randint(0, 200))) for i in range(40)]
    history = [(i, rng.choice([None, rng.randrange(40)]), rng.choice([None, *[start + timedelta(hours=rng.randint(0, 90 * 24))] * 30])) for i in range(600)]
    # Days on which all parents live for ever.
    history = [(i, p if t is None or t.day % 4 else (1 if p is not None else None), t) for i, p, t in history]
    labels = [(i, rng.choice([None, rng.randrange(40)])) for i in range(80)]
    make = spark.createDataFrame
    return QueryLog(
        make(queries, "id int, expires_at timestamp"), make(history, "id int, query_id int, executed_at timestamp"),
        make(labels, "id int, query_id int"), make(labels[:30], "id int, query_id int"),
    )


def rows_of(df, *names):
    return sorted(map(tuple, df.select(*names).collect()), key=str)


@pytest.mark.parametrize("seed", range(2))
def test_retention_by_days_equals_the_whole_recomputation(spark, tmp_path, seed):
    log = days_log(spark, seed)
    save_log(log, str(tmp_path / "0"))
    whole, places = log, [str(tmp_path / "0")]
    for step, now in enumerate((datetime(2024, 2, 20, 12), datetime(2024, 3, 3), datetime(2024, 3, 3), datetime(2024, 9, 1)), 1):
        places.append(str(tmp_path / str(step)))
        before = querylog.read_log(spark, places[-2])
        written = querylog.retain_saved(spark, places[-2], places[-1], now)
        whole = retention_survivors(whole, now)
        found = querylog.read_log(spark, places[-1])
        assert rows_of(found.history, "id", "query_id", "executed_at") == rows_of(whole.history, "id", "query_id", "executed_at")
        for field in ("queries", "labels", "analyses"):
            assert rows_of(getattr(found, field), "id") == rows_of(getattr(whole, field), "id")
        # Only days at the edge or with an expired parent are in the new place, and nothing else was read for them.
        expired = {r.id for r in before.queries.where(F.col("expires_at") < F.lit(now)).collect()}
        cutoff = now - timedelta(days=30)
        days = {r[querylog.DAY] for r in before.history.collect() if r.query_id in expired and (r.executed_at is None or r.executed_at.date() >= cutoff.date())}
        edge = {r[querylog.DAY] for r in before.history.collect()} & {cutoff.date()}
        assert set(written) == days | edge
        kept_days = {r[querylog.DAY] for r in found.history.collect()}
        assert step == 4 or len(set(written)) < len(kept_days)
    assert len(querylog._folders(spark, places[3])) >= len({r[querylog.DAY] for r in querylog.read_log(spark, places[3]).history.collect()})


def test_only_the_asked_days_are_opened(spark, tmp_path):
    save_log(days_log(spark, 5), str(tmp_path / "0"))
    written = querylog.retain_saved(spark, str(tmp_path / "0"), str(tmp_path / "1"), datetime(2024, 3, 3))
    part = querylog.read_log(spark, str(tmp_path / "0"), written).history
    scan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [executed_on" in scan.replace("PartitionFilters: [(executed_on", "PartitionFilters: [executed_on")
    opened = {f for f in part.inputFiles()}
    assert {f.split("executed_on=")[1][:10] for f in part.select(F.input_file_name().alias("f")).distinct().toPandas().f} <= {str(d) for d in written} | {"__HIVE_DEF"}
    assert len(opened) >= 1 and querylog.read_log(spark, str(tmp_path / "1"), []).history.count() == 0
