"""Search by postings finds the rows of a plain search, and reads less."""

import random
from datetime import datetime
from functools import reduce

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from turnwise.errors import AnalyticsError
from turnwise.operators import searchindex
from turnwise.operators.querylog import search
from turnwise.operators.searchindex import needed_pieces, save_search_index, search_index

LETTERS = "abAB%_\\\\ éÉ1😀Σ"


def texts(rng, n, most):
    return ["".join(rng.choices(LETTERS, k=rng.randint(0, most))) for _ in range(n)]


@pytest.fixture(scope="module", params=[64, 1 << 16])
def saved(request, spark, tmp_path_factory):
    """Rows with ids far apart, and their index in blocks of few and of many ids."""
    patch = pytest.MonkeyPatch()
    patch.setattr(searchindex, "BLOCK_IDS", request.param)
    rng = random.Random(3)
    rows = [(i * 7 + (10**9 if i % 5 == 0 else 0), a or None, b, i % 3) for i, (a, b) in enumerate(zip(texts(rng, 400, 14), texts(rng, 400, 6), strict=True))]
    df = spark.createDataFrame(rows, "id bigint, name string, body string, kind int").withColumn("until", F.when(F.col("kind") > 0, F.lit(datetime(2024, 1, 1)) + F.make_dt_interval(F.col("kind"))))
    place = str(tmp_path_factory.mktemp("index") / "log")
    save_search_index(df.repartition(3), ["name", "body"], "id", place)
    yield df.cache(), place
    patch.undo()


def test_a_thousand_patterns_find_what_a_plain_search_finds(spark, saved):
    """No row that a pattern finds lacks its pieces; whole searches are compared for some of them."""
    df, place = saved
    rng = random.Random(4)
    patterns = texts(rng, 1000, 6)
    postings = {}
    for r in spark.read.parquet(f"{place}/postings").collect():
        ids = r[searchindex._IDS]
        assert ids == sorted(set(ids)) and ids[-1] < searchindex.BLOCK_IDS
        postings.setdefault(r[searchindex._GRAMS], set()).update(r[searchindex._BLOCK] * searchindex.BLOCK_IDS + i for i in ids)
    rows = df.collect()
    everything, looked_up = {r.id for r in rows}, 0
    for at in range(0, 1000, 250):
        asked = patterns[at : at + 250]
        hit = [reduce(lambda a, b: a | b, [F.coalesce(F.col(c).ilike("%" + x.replace("\\", "\\\\") + "%"), F.lit(False)) for c in ("name", "body")]) for x in asked]
        hits = df.select("id", *[h.alias(f"p{k}") for k, h in enumerate(hit)]).collect()
        for k, pattern in enumerate(asked):
            candidates = everything
            for piece in needed_pieces(pattern):
                candidates = candidates & postings.get(piece, set())
                looked_up += 1
            assert {r.id for r in hits if r[f"p{k}"]} <= candidates, pattern
    assert looked_up > 500
    for pattern in [*patterns[300:325], "", "ab", "a%b", "Éa1", "bab_a", "zzz", "a" * 40, rows[9].body]:
        found = search_index(spark, place, ["name", "body"], "id", pattern, {"kind": 1})
        assert sorted(map(tuple, found.select(df.columns).collect()), key=str) == sorted(map(tuple, search(df, ["name", "body"], pattern, {"kind": 1}).collect()), key=str), pattern


def test_filters_and_expiry_hold(spark, saved):
    df, place = saved
    now = datetime(2024, 1, 2, 12)
    found = search_index(spark, place, ["name", "body"], "id", None, None, "until", now)
    assert found.count() == search(df, ["name", "body"], None, None, "until", now).count() and found.columns == df.columns


def test_long_texts_look_up_the_rarest_pieces(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(searchindex, "LOOKED_UP", 2)
    rows = [(i, "common words all over " + ("needle" if i == 77 else "")) for i in range(300)]
    save_search_index(spark.createDataFrame(rows, "id bigint, t string"), ["t"], "id", str(tmp_path / "x"))
    assert set(searchindex._rarest_first(spark, str(tmp_path / "x"), needed_pieces("over needle"))) <= {"r n", " ne", "nee", "eed", "edl", "dle"}
    assert [r.id for r in search_index(spark, str(tmp_path / "x"), ["t"], "id", "OVER needle").collect()] == [77]


def test_only_blocks_with_candidates_are_opened(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(searchindex, "BLOCK_IDS", 100)
    df = spark.range(2000).select("id", F.concat(F.lit("row "), F.lpad(F.col("id").cast("string"), 5, "0"), F.repeat(F.lit(" filler"), 200)).alias("t"))
    place = str(tmp_path / "x")
    save_search_index(df, ["t"], "id", place)
    found = search_index(spark, place, ["t"], "id", "row 01234")
    assert [r.id for r in found.collect()] == [1234]
    plan = found._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters: ")[1].split("PushedFilters")[0]
    assert "__tw_block" in filters and " = 12)" in filters
    assert "PushedFilters" in searchindex._postings(spark, place, ["row"])._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("ids", [[1, 1], [1, None], [1, -2]])
def test_bad_keys_are_refused(spark, tmp_path, ids):
    with pytest.raises(AnalyticsError):
        save_search_index(spark.createDataFrame([(i, "t") for i in ids], "id bigint, t string"), ["t"], "id", str(tmp_path / "x"))


def test_empty_table(spark, tmp_path):
    df = spark.createDataFrame([], "id bigint, t string")
    assert df.count() == 0 and needed_pieces("a%bc_d") == [] and needed_pieces("Abcd") == ["abc", "bcd"]


def test_lists_are_made_before_the_shuffle(spark, tmp_path, monkeypatch):
    """a row for each piece of each text was shuffled and sorted. Pieces are those of a plain reading, over all planes and in parts of any size."""
    rng = random.Random(5)
    wide = [chr(c) for c in range(0x4E00, 0x5E00)] + [chr(c) for c in range(0x1F300, 0x1F400)] + list("aAbBÉß ")
    rows = [(i * 3, rng.choice([None, "", "ab", "".join(rng.choices(wide + ["a", "b"] * 3000, k=rng.randint(0, 60)))]), rng.choice([None, "ABab" * i])) for i in range(300)]
    df = spark.createDataFrame(rows, "id bigint, t string, u string").repartition(3)
    wanted = set()
    for i, *texts in df.select("id", F.lower("t"), F.lower("u")).collect():
        wanted |= {(text[k : k + 3], i // 200, i % 200) for text in texts if text for k in range(len(text) - 2)}
    monkeypatch.setattr(searchindex, "BLOCK_IDS", 200)
    for size in (1, 2000, 1 << 22):
        monkeypatch.setattr(searchindex, "PIECE_BYTES", size)
        save_search_index(df, ["t", "u"], "id", str(tmp_path / str(size)))
        found = [(r[0], r[1], r[2]) for r in spark.read.parquet(f"{tmp_path}/{size}/postings").select(searchindex._GRAMS, searchindex._BLOCK, searchindex._IDS).collect()]
        assert {(gram, block, i) for gram, block, ids in found for i in ids} == wanted
        assert sum(len(ids) for _, _, ids in found) == len(wanted) and all(ids == sorted(ids) for _, _, ids in found)
    batch = pa.RecordBatch.from_pydict({searchindex._BLOCK: pa.array([0] * 40000, pa.int64()), searchindex._ID: pa.array(range(40000), pa.int32()), "t": ["abcabc"] * 40000})
    assert [r.num_rows for r in searchindex._short_lists([batch])] == [3]
    large = pa.RecordBatch.from_pydict({searchindex._BLOCK: pa.array([0, 0, 1], pa.int64()), searchindex._ID: pa.array([5, 2, 1], pa.int32()), "t": ["".join(map(chr, range(0x20000, 0x30000))), "".join(map(chr, range(0x30000, 0xE0000))), "".join(map(chr, range(0xE0000, 0x110000)))]})
    huge = [r for part in searchindex._short_lists([large]) for r in part.to_pylist()]
    assert len(huge) == 0x110000 - 0x20000 - 6 and {r[searchindex._IDS][0] for r in huge if r[searchindex._BLOCK] == 0} == {2, 5}
