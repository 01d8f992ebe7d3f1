"""Numbers of a table that grows: equal to numbering everything at once, without reading what is there."""

import os
import random

import pytest
from pyspark.sql import functions as F

from turnwise.errors import AnalyticsError
from turnwise.operators import numbering
from turnwise.operators.numbering import append_numbered, read_numbered
from turnwise.operators.positions import SortKey

ORDER = [SortKey("score", ascending=False, nulls_first=False), SortKey("id")]
SCHEMA = "id bigint, score double, note string"


def batches(seed, sizes):
    rng, made, at = random.Random(seed), [], 0
    for size in sizes:
        made.append([(at + i, rng.choice([None, 1.0, 2.0, 2.0, 7.5]), rng.choice([None, "", "x" * 50])) for i in range(size)])
        at += size
    return made


def expected(parts):
    """Every batch sorted by itself, one after the other."""
    rows = [row for part in parts for row in sorted(part, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))]
    return [(*row, k) for k, row in enumerate(rows, 1)]


def files(directory):
    return {os.path.join(at, n): os.stat(os.path.join(at, n)).st_mtime_ns for at, _, names in os.walk(directory) for n in names if n.endswith(".parquet")}


@pytest.mark.parametrize("max_rows", [None, 20])
def test_numbers_go_on_and_saved_files_stay(spark, tmp_path, monkeypatch, max_rows):
    monkeypatch.setattr(numbering, "BLOCK_ROWS", 64)
    parts, place, total = batches(5, [150, 0, 1, 97]), str(tmp_path / "saved"), 0
    for part in parts:
        before = files(place)
        total += len(part)
        assert append_numbered(spark.createDataFrame(part, SCHEMA).repartition(3), ORDER, place, max_rows=max_rows) == total
        after = files(place)
        assert all(after[name] == time for name, time in before.items())
    rows = expected(parts)
    assert sorted(map(tuple, read_numbered(spark, place).collect()), key=lambda r: r[3]) == rows
    for first, count in [(1, 10), (60, 9), (140, 20), (151, 1), (240, 100), (249, 5), (10**9, 3), (7, 0), (-3, 5)]:
        page = read_numbered(spark, place, first, count)
        assert sorted(map(tuple, page.collect()), key=lambda r: r[3]) == [r for r in rows if first <= r[3] < first + count]


def test_a_page_opens_its_blocks_only(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(numbering, "BLOCK_ROWS", 64)
    place = str(tmp_path / "saved")
    for part in batches(6, [200, 200]):
        append_numbered(spark.createDataFrame(part, SCHEMA), ORDER, place)
    page = read_numbered(spark, place, 70, 5)
    scan = page._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in scan and "__tw_block" in scan.split("PartitionFilters")[1].split("PushedFilters")[0]
    opened = {r[0] for r in page.select(F.input_file_name()).distinct().collect()}
    assert opened and all("batch=0/__tw_block=1/" in name for name in opened)
    assert all("batch=0" in name for name in page.inputFiles())


def test_an_append_that_broke_off_leaves_no_rows(spark, tmp_path):
    place, parts = str(tmp_path / "saved"), batches(7, [30, 20])
    append_numbered(spark.createDataFrame(parts[0], SCHEMA), ORDER, place)
    # Rows without an entry in the table of batches, as a lost driver leaves them.
    spark.createDataFrame(parts[0], SCHEMA).withColumns({"row_no": F.col("id") + 31, "__tw_block": F.lit(0)}).write.partitionBy("__tw_block").parquet(f"{place}/rows/batch=1")
    assert sorted(map(tuple, read_numbered(spark, place).collect()), key=lambda r: r[3]) == expected(parts[:1])
    assert append_numbered(spark.createDataFrame(parts[1], SCHEMA), ORDER, place) == 50
    assert sorted(map(tuple, read_numbered(spark, place).collect()), key=lambda r: r[3]) == expected(parts)


def test_wrong_uses(spark, tmp_path):
    place, df = str(tmp_path / "saved"), spark.createDataFrame(batches(8, [3])[0], SCHEMA)
    with pytest.raises(AnalyticsError, match="NOTHING_SAVED"):
        read_numbered(spark, place)
    with pytest.raises(AnalyticsError, match="NAME_TAKEN"):
        append_numbered(df.withColumnRenamed("note", "Row_No"), ORDER, place)
    assert append_numbered(df.limit(0), ORDER, place) == 0
    assert read_numbered(spark, place).columns == ["id", "score", "note", "row_no"] and read_numbered(spark, place).isEmpty()
    assert append_numbered(df, ORDER, place) == 3
    with pytest.raises(AnalyticsError, match="APPEND_COLUMNS_DIFFER"):
        append_numbered(df.withColumn("id", F.col("id").cast("int")), ORDER, place)
