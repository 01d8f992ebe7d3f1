"""Positions in groups of any size."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from turnwise.errors import AnalyticsError
from turnwise.operators import positions
from turnwise.operators.positions import SortKey, with_positions
from turnwise.sources.tables import read_table

ROWS = 6000


@pytest.fixture(scope="module")
def skewed(spark):
    """One group holds a third of all rows, one value half of those; some keys are NULL."""
    n = F.col("id")
    return spark.range(ROWS).select(
        n.alias("seq"),
        F.when(n % 3 == 0, "hot").when(n % 3 == 1, (n % 50).cast("string")).alias("k"),
        F.when(n % 2 == 0, 7).when(n % 5 != 0, F.xxhash64(n) % 100).alias("v"),
    ).repartition(5)


def brute_force(rows, ascending, nulls_first):
    groups = {}
    for seq, k, v in rows:
        groups.setdefault(k, []).append((seq, v))
    found = {}
    for k, members in groups.items():
        members.sort()
        have = [m for m in members if m[1] is not None]
        have.sort(key=lambda m: m[1] if ascending else -m[1])
        none = [m for m in members if m[1] is None]
        for p, (seq, _) in enumerate(none + have if nulls_first else have + none, 1):
            found[seq] = (p, len(members))
    return found


@pytest.mark.parametrize("ascending", [True, False])
@pytest.mark.parametrize("nulls_first", [True, False])
@pytest.mark.parametrize("limit", [50, 700, None])
def test_positions_match_brute_force(skewed, ascending, nulls_first, limit):
    order = [SortKey("v", ascending, nulls_first), SortKey("seq")]
    placed = with_positions(skewed, ["k"], order, total="n", max_rows=limit)
    got = {r.seq: (r.position, r.n) for r in placed.collect()}
    assert got == brute_force(skewed.collect(), ascending, nulls_first)


@pytest.mark.parametrize("limit", [100, None])
def test_whole_table_positions(skewed, limit):
    placed = with_positions(skewed, [], [SortKey("v", False, False), SortKey("seq")], max_rows=limit)
    assert placed.columns == [*skewed.columns, "position"]
    ordered = placed.orderBy("position").collect()
    assert [r.position for r in ordered] == list(range(1, ROWS + 1))
    keys = [(r.v is None, -(r.v or 0), r.seq) for r in ordered]
    assert keys == sorted(keys)


@pytest.mark.parametrize("limit", [100, None])
@pytest.mark.parametrize("between", [(1, 10), (95, 420), (5990, 7000), (6001, 6010)])
def test_picked_positions(skewed, limit, between):
    order = [SortKey("v", False, False), SortKey("seq")]
    everything = with_positions(skewed, [], order)
    picked = with_positions(skewed, [], order, max_rows=limit, between=between)
    wanted = everything.where(F.col("position").between(*between))
    assert picked.columns == everything.columns
    assert picked.exceptAll(wanted).count() == 0 and wanted.exceptAll(picked).count() == 0


def test_only_whole_tables_have_picked_positions(skewed):
    with pytest.raises(AnalyticsError):
        with_positions(skewed, ["k"], [SortKey("seq")], between=(1, 2))


def test_hot_groups_are_spread_over_tasks(skewed):
    placed = with_positions(skewed, ["k"], [SortKey("v"), SortKey("seq")], max_rows=100)
    text = placed._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(k" in text and "__tw_range" in text
    plain = with_positions(skewed, ["k"], [SortKey("v"), SortKey("seq")])
    assert "__tw_range" not in plain._jdf.queryExecution().executedPlan().toString()


def test_result_does_not_depend_on_partitioning(skewed):
    order = [SortKey("v"), SortKey("seq")]
    one = with_positions(skewed.repartition(1), ["k"], order, max_rows=100)
    many = with_positions(skewed.repartition(17, "v"), ["k"], order, max_rows=100)
    assert one.exceptAll(many).count() == 0 and many.exceptAll(one).count() == 0


@settings(
    max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)
@given(
    st.lists(st.tuples(st.sampled_from([None, "a", "b"]), st.none() | st.integers(-3, 3)), max_size=60),
    st.booleans(),
    st.booleans(),
    st.integers(1, 20),
)
def test_positions_on_any_input(spark, values, ascending, nulls_first, limit):
    rows = [(i, k, v) for i, (k, v) in enumerate(values)]
    df = spark.createDataFrame(rows, "seq bigint, k string, v bigint")
    placed = with_positions(
        df, ["k"], [SortKey("v", ascending, nulls_first), SortKey("seq")], total="n", max_rows=limit
    )
    got = {r.seq: (r.position, r.n) for r in placed.collect()}
    assert got == brute_force(rows, ascending, nulls_first)


def test_real_sessions_agree_on_both_ways(spark, data):
    events = read_table(spark, data, "events")
    order = [SortKey("ts", False, True), SortKey("event_id")]
    plain = with_positions(events, ["user_id"], order, total="n")
    split = with_positions(events, ["user_id"], order, total="n", max_rows=20)
    assert plain.exceptAll(split).count() == 0 and split.exceptAll(plain).count() == 0


@pytest.mark.parametrize("values", [1, 3, 50, 20_000])
def test_ranges_stay_small_whatever_the_last_column_holds(spark, values):
    """Only both order columns together are unique; ``b`` alone has few values."""
    n, target = 20_000, 500
    df = spark.range(n).select(
        F.lit("hot").alias("k"), F.floor(F.col("id") / values).alias("a"), (F.col("id") % values).alias("b")
    )
    order = [SortKey("a"), SortKey("b")]
    hot = spark.createDataFrame([("hot",)], "__tw_hot_k string")
    points = positions._cut_points(df, hot, ["k"], order, F.lit(1.0 / target), n / target)
    ranged = positions._with_ranges(df, points, ["k"], order, (2 * n // target).bit_length(), "inner")
    sizes = [r["count"] for r in ranged.groupBy("__tw_range").count().collect()]
    assert sum(sizes) == n and max(sizes) <= 4 * target and len(sizes) <= 4 * n // target
    placed = with_positions(df, ["k"], order, max_rows=target)
    assert placed.where(F.col("position") != F.col("a") * values + F.col("b") + 1).count() == 0


def test_offsets_may_be_too_many_to_broadcast(skewed, monkeypatch):
    order = [SortKey("v"), SortKey("seq")]
    plain = with_positions(skewed, ["k"], order, total="n")
    monkeypatch.setattr(positions, "_BROADCAST_RANGES", 0)
    split = with_positions(skewed, ["k"], order, total="n", max_rows=100)
    assert plain.exceptAll(split).count() == 0 and split.exceptAll(plain).count() == 0


def widths(kind, n):
    """Bytes per row: from 10 to a million, by themselves, in runs, or one row in many."""
    i = F.col("seq")
    return {
        "mixed": F.pow(F.lit(10.0), 1 + 5 * F.pmod(F.xxhash64(i), F.lit(1000)) / 1000),
        "runs": F.when(F.floor(i / 500) % 4 == 0, 100_000).otherwise(10),
        "rare": F.when(i % 997 == 0, 1_000_000).otherwise(10),
        "even": F.lit(1000),
    }[kind].cast("bigint")


@pytest.mark.parametrize("kind", ["mixed", "runs", "rare", "even"])
def test_ranges_are_bounded_in_bytes_and_rows(spark, kind):
    n, target, rows = 20_000, 2_000_000, 4000
    df = spark.range(n).select(F.lit("hot").alias("k"), F.col("id").alias("seq")).withColumn(positions._BYTES, widths(kind, n))
    share = F.greatest(F.lit(1.0 / rows), F.col(positions._BYTES) / F.lit(float(target)))
    full = df.agg(F.sum(share)).first()[0]
    hot = spark.createDataFrame([("hot",)], "__tw_hot_k string")
    order = [SortKey("seq")]
    points = positions._cut_points(df, hot, ["k"], order, share, full)
    ranged = positions._with_ranges(df, points, ["k"], order, int(2 * full + 1).bit_length(), "inner")
    found = ranged.groupBy("__tw_range").agg(F.sum(positions._BYTES).alias("bytes"), F.count("*").alias("n")).collect()
    assert sum(r.n for r in found) == n and len(found) <= 4 * full + 1
    assert max(r.bytes for r in found) <= 4 * target and max(r.n for r in found) <= 4 * rows


@pytest.mark.parametrize("max_bytes", [None, 300, 10_000_000])
@pytest.mark.parametrize("max_rows", [7, 1000])
def test_running_sums_are_exact(spark, skewed, max_bytes, max_rows):
    df = skewed.repartition(3).withColumn("text", F.repeat(F.lit("é"), (F.col("seq") % 23).cast("int")))
    order = [SortKey("v"), SortKey("seq")]
    weight = F.when(F.col("seq") % 5 > 0, F.octet_length("text")).cast("bigint")
    weight = F.coalesce(weight, F.lit(0))
    found = with_positions(df, ["k"], order, total="n", max_rows=max_rows, max_bytes=max_bytes, weight=weight, running="before")
    assert found.columns == [*df.columns, "position", "n", "before"]
    window = Window.partitionBy("k").orderBy(*[k.expression() for k in order])
    before = F.coalesce(F.sum(weight).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    wanted = df.withColumns({"position": F.row_number().over(window).cast("bigint"), "n": F.count("*").over(Window.partitionBy("k")), "before": before})
    assert found.exceptAll(wanted).count() == 0 and found.count() == df.count()


def test_row_bytes(spark):
    df = spark.createDataFrame([("é", bytearray(b"abc"), 5, [1, 2], None)], "a string, b binary, c int, d array<int>, e string")
    assert df.select(positions.row_bytes(df).alias("n")).first().n == 2 + 3 + 8 + 5
    assert df.select(positions.row_bytes(df, ["a", "c"]).alias("n")).first().n == 10


def test_sizes_come_from_the_cheaper_frame(spark):
    """The frame given for counting sizes is the one that is read for them."""
    df = spark.range(100).select((F.col("id") % 3).alias("k"), F.col("id").alias("seq"))
    costly = df.withColumn("seq", F.when(F.raise_error("read").isNull(), F.col("seq")))
    placed = with_positions(costly, ["k"], [SortKey("seq")], sized=df)
    with pytest.raises(Exception, match="read"):
        placed.collect()


def test_no_row_is_compared_with_all_cut_points(skewed):
    """an array of all cut points stood beside each row, which took time by rows times cut points."""
    placed = with_positions(skewed, [], [SortKey("v", False, False), SortKey("seq")], total="n", max_rows=10)
    assert positions._POINTS not in placed._jdf.queryExecution().executedPlan().toString()
    assert [(r.position, r.n) for r in placed.orderBy("position").collect()] == [(k, ROWS) for k in range(1, ROWS + 1)]
    cuts = skewed.select(F.lit(None).cast("string").alias("__tw_hot_k"), F.col("seq").alias("k0")).groupBy("__tw_hot_k")
    cuts = cuts.agg(F.transform(F.sort_array(F.collect_list("k0")), lambda p: F.struct(p.alias("k0"))).alias(positions._POINTS))
    rows = skewed.select(F.lit(None).cast("string").alias("k"), (F.col("seq") * 2 - 3).alias("seq"))
    ranged = positions._with_ranges(rows, cuts, ["k"], [SortKey("seq")], ROWS.bit_length(), "inner")
    assert ranged.where(F.col("__tw_range") != F.greatest(F.lit(0), F.least(F.lit(ROWS), F.col("seq") + 1))).count() == 0 and ranged.count() == ROWS
    assert positions._tree(cuts, ["k"], 3, 5).agg(F.max(F.size(positions._POINTS))).first()[0] < 32


def test_large_groups_are_sorted_beside_small_ones(spark):
    """groups with and without a name, some cut and some not, repeated rows, and a column that Parquet does not hold."""
    rows = spark.range(3000).select(F.when(F.col("id") % 4 > 0, F.least(F.col("id") % 7, F.lit(3)).cast("string")).alias("k"), (F.col("id") % 500).alias("v"), F.lit("x").alias("t"))
    few = spark.createDataFrame([("small", k, "y") for k in range(20)], "k string, v bigint, t string")
    df, order = rows.unionByName(few), [SortKey("v", False)]
    plain = with_positions(df, ["k"], order, total="n")
    split = with_positions(df, ["k"], order, total="n", max_rows=25)
    assert positions._POINTS not in split._jdf.queryExecution().executedPlan().toString()
    # Equal rows may swap their positions, which leaves the same rows.
    assert plain.exceptAll(split).count() == 0 and split.exceptAll(plain).count() == 0 and split.dtypes == plain.dtypes
    void = with_positions(df.withColumn("nothing", F.lit(None)), ["k"], order, total="n", max_rows=25)
    assert void.drop("nothing").exceptAll(plain).count() == 0 and void.count() == 3020
