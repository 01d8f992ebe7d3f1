"""Operators over whole tables against brute force: near duplicates, token files, packing, the pipeline, the registered queries."""

import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
import corpus_pipeline
from turnwise.llm import components, contamination, near_duplicates, packed_files, packing, personal_data, queries, repetition
from turnwise.llm.common import fresh_path, written
from turnwise.llm.tokens import Encoder, vocabulary_path

SPACES = [" ", " ", " ", "  ", "\n", "\n", " \n", "\n ", "\t", " ", "　", "a", "B", "é", "1", "23", "'s", "'ll", "!", "...", "\x1c", "\x85", "\r\n", "漢", "<|endoftext|>", "word", "ing"]


def odd_texts(n, seed=3):
    rng = random.Random(seed)
    return ["".join(rng.choice(SPACES) for _ in range(rng.randint(0, 14))) for _ in range(n)]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json"))


def ids_of(tokenizer, text, end):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


# ---- tokens and files ----


@pytest.mark.parametrize("vocabulary", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_the_library(vocabulary):
    encode, texts = Encoder(vocabulary), odd_texts(1500)
    found = [ids[a:b].tolist() for ids, bounds in encode.encode(pa.array(texts)) for a, b in zip(bounds, bounds[1:], strict=False)]
    assert found == [encode.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("values", [[1], [0, 0, 5], [3, 3, 3, 900], list(range(0, 5000, 7)), sorted(random.Random(1).choices(range(10**6), k=999))])
def test_elias_fano_round_trip(values):
    coded = packed_files.EliasFano.encode(np.array(values, np.int64))
    read = packed_files.EliasFano(len(values), *coded)
    assert [read.select(k) for k in range(len(values))] == values
    bits = 8 * (len(coded[1]) + len(coded[2]))
    assert bits <= len(values) * (3 + math.log2(1 + values[-1] / len(values))) + 32


def test_token_files(spark, tokenizer):
    rows = [(950, "a <|endoftext|> b", "x")] + [(k * 3 % 401, t, "clash") for k, t in enumerate(odd_texts(400))] + [(None, "null id", "x"), (7, None, "x"), (900, "x y " * 40_000, "x"), (7, "again", "x"), (7, "again", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(5)
    path = fresh_path(spark, "files")
    packed_files.write_token_files(docs, path, shards=4, block_ids=500, special_as_text=False)
    found = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in packed_files.read_documents(spark, path).collect())
    assert [r[1] for r in found] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i or 0))
    wanted = sorted(((i is not None, i or 0), len(x := ids_of(tokenizer, t, 2)), crc(x)) for i, t, _ in rows)
    assert sorted(((i is not None, i or 0), n, c) for _, i, n, c in found) == wanted
    assert [r[0] for r in found] == [0, *np.cumsum([r[2] for r in found])[:-1].tolist()]
    block = next(r.asDict() for r in packed_files.read_blocks(spark, path).collect() if 900 in r.doc_ids)
    assert packed_files.document_ids(block, block["doc_ids"].index(900)).tolist() == ids_of(tokenizer, "x y " * 40_000, 2)
    empty = fresh_path(spark, "files")
    packed_files.write_token_files(docs.limit(0), empty, shards=2)
    assert packed_files.read_documents(spark, empty).count() == 0


# ---- packing ----


def check_packing(rows, length):
    """Pieces in their sequences without gaps; the number of sequences."""
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_sequence.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at <= length
    return len(by_sequence)


def test_packing(spark, tokenizer):
    rng = random.Random(4)
    rows = [(k, " ".join(rng.choices(["alpha", "be", "c"], k=rng.randint(0, 90))), "clash") for k in range(600)]
    rows += [(700, "x y " * 500, "x"), (701, None, "x"), (702, "a <|endoftext|> b", "x"), (None, "no id", "x"), (5, rows[5][1], "x"), (5, rows[5][1], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string")
    cut = written(packing.pieces(docs, length=64, special_as_text=False).withColumn("row", F.monotonically_increasing_id()), "cut")
    packed, bounds = packing.pack_certified(cut, length=64, part_pieces=80)
    packed = written(packed, "packed-test")
    found = packed.collect()
    wanted = []
    for i, t, _ in rows:
        ids = ids_of(tokenizer, t, 0)
        cuts = [0, *range(len(ids) % 64 or 64, len(ids) + 1, 64)]
        wanted += [(i is not None, i or 0, k, a, b - a, crc(ids[a:b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.piece, r.start, r.length, r.ids_crc32) for r in found) == sorted(wanted)
    sizes, counts = np.unique([r.length for r in found], return_counts=True)
    assert check_packing(found, 64) <= packing.lower_bound(sizes, counts, 64) + 3
    whole = {r.sequence_id: (r.lengths, bytes(r.ids)) for r in packing.sequences(cut, packed).collect()}
    assert all(len(ids) == 4 * sum(lengths) for lengths, ids in whole.values()) and len(whole) == check_packing(found, 64)
    certified = bounds.collect()
    total = next(r for r in certified if r["round"] is None)
    assert total.sequences == len(whole) and total.bound == math.ceil(packing.lower_bound(sizes, counts, 64) - 1e-6)
    assert len({(r["round"], r.part) for r in certified}) == len(certified) > 2 and all(r.bound - 1e-9 <= r.sequences for r in certified)
    assert [t.count() for t in packing.pack_certified(packing.pieces(docs.limit(0)))] == [0, 0]


@pytest.mark.parametrize("seed", range(6))
def test_bounds_and_best_fit(seed):
    rng = np.random.default_rng(seed)
    sizes = np.sort(rng.integers(*[(1, 30), (40, 70), (1, 101), (34, 50), (51, 101), (20, 60)][seed], size=300))[::-1]
    bins, places = packing.best_fit_decreasing(sizes, 100)
    fill = np.bincount(bins, sizes)
    assert fill.max() <= 100
    for b in range(len(fill)):
        inside = sorted(zip(places[bins == b], sizes[bins == b], strict=True))
        assert [p for p, _ in inside] == [0, *np.cumsum([s for _, s in inside])[:-1]]
    bound = packing.lower_bound(*np.unique(sizes, return_counts=True), 100)
    assert bound - 1e-9 <= len(fill) <= bound * 1.08 + 1


# ---- near duplicates ----


def brute_components(rows):
    """Smallest id of each row's component, by comparing all sets; rows with one id are one document."""
    sets = []
    for _, text in rows:
        words = [bytes(w) for w in (text or "").encode().lower().split()]
        sets.append(frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset())
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, _) in enumerate(rows):
        for b in range(a):
            j = rows[b][0]
            inter = len(sets[a] & sets[b])
            if i is not None and j is not None and sets[a] and sets[b] and 100 * inter >= 75 * len(sets[a] | sets[b]):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return sorted(((i is not None, i or 0), len(s), (root(i) if i is not None else None)) for (i, _), s in zip(rows, sets, strict=True))


def near_rows():
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = [(900, None), (901, ""), (902, " \n\t"), (903, "three words only"), (904, "Three WORDS only"), (905, "three words"), (None, "no id " * 9), (None, "no id " * 9)]
    rows += [(905, "three words"), (906, "a " * 400_000), (907, "A\n" * 400_000), (908, "É é É é É é É"), (909, "é é é é é é é")]
    passage = rng.choices(vocabulary, k=60)
    for group in range(8):
        text = rng.choices(vocabulary, k=rng.randint(30, 160))
        for _ in range(rng.randint(2, 14)):
            words = list(text)
            for _ in range(rng.randint(0, 9)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(words)))
    for _ in range(30):
        rows.append((len(rows), " ".join(passage + rng.choices(vocabulary, k=rng.randint(5, 60)))))
    chain = rng.choices(vocabulary, k=100)
    for _ in range(20):
        chain = [*chain[2:], *rng.choices(vocabulary, k=2)]
        rows.append((len(rows), " ".join(chain)))
    rows += [(500 + k, rows[40][1]) for k in range(30)]
    return rows


@pytest.mark.parametrize("limits", [None, (3, 400, 0)])
def test_near_duplicates(spark, monkeypatch, limits):
    if limits:  # many parts and blocks, and no broadcast
        for name, value in zip(("STAR_MEMBERS", "BLOCK_SHINGLES", "BROADCAST_ROWS"), limits, strict=True):
            monkeypatch.setattr(near_duplicates, name, value)
    rows = near_rows()
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, node string, centre string").repartition(4)
    found = near_duplicates.near_duplicates(docs).collect()
    assert sorted(((r.doc_id is not None, r.doc_id or 0), r.n_shingles, r.component_id) for r in found) == brute_components(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def test_one_of_each_stays(spark):
    rows = near_rows()
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, kept string")
    kept = near_duplicates.keep_one_of_each(docs)
    ids = [r.doc_id for r in kept.collect()]
    wanted = sorted({c for (known, i), _, c in brute_components(rows) if known and c == i})
    assert sorted(i for i in ids if i is not None) == wanted and ids.count(None) == 2 and kept.columns == docs.columns
    assert near_duplicates.near_duplicates(docs.limit(0)).count() == 0


def test_rows_that_share_an_id_are_judged_by_their_texts(spark):
    one, two = "the first text of some words", "another text that is not alike"
    rows = [(1, one), (2, one), (2, two), (3, two), (3, two + " at all but for this"), (4, None), (4, None), (None, one), (None, one), (5, ""), (1, one)]
    docs = spark.createDataFrame([(*r, 0, 0, 0) for r in rows], "doc_id long, text string, __dropped int, __repeated int, row_number int")
    kept = near_duplicates.keep_one_of_each(docs)
    wanted = [(None, one), (None, one), (1, one), (2, two), (3, two + " at all but for this"), (4, None), (4, None), (5, "")]
    found = [(r.doc_id, r.text) for r in kept.collect()]
    assert sorted(found, key=str) == sorted(wanted, key=str) and kept.columns == docs.columns
    once = docs.where("doc_id IN (2, 5)").dropDuplicates(["doc_id"]).withColumnRenamed("row_number", "dropped")
    assert near_duplicates.keep_one_of_each(once).columns == once.columns and near_duplicates.keep_one_of_each(once).count() == 2


def test_signatures_collide_as_planned():
    """Small and large sets alike share a bucket at similarity 0.75."""
    rng, signer = np.random.default_rng(1), near_duplicates.Signer()
    draw = lambda n: rng.integers(0, 1 << 64, n, dtype=np.uint64)
    for shared, own in ((3, 0), (6, 1), (30, 5), (600, 100)):
        missed = 0
        for _ in range(150):
            common = draw(shared)
            a, b = (np.unique(np.concatenate([common, draw(own if own else k)])) for k in (0, 1))
            missed += not (signer.keys(a) == signer.keys(b)).any()
        assert missed == 0


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(k, k + 1) for k in range(1000, 1080)] + [(5000, 5000 + k) for k in range(1, 200)] + [(7, 7)]
    found = {r.node: r.component for r in components.components(spark.createDataFrame(links * 2, "u long, v long")).collect()}
    parent = {x: x for link in links for x in link}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in links:
        x, y = root(u), root(v)
        parent[max(x, y)] = min(x, y)
    assert found == {x: root(x) for link in links if link[0] != link[1] for x in link}


# ---- the pipeline and the queries ----


def test_pipeline_equals_its_stages_by_hand(spark, data, tokenizer):
    docs = spark.read.parquet(f"{data}/documents.parquet").where("doc_id < 250")
    items = [(str(r.item_id), r.text.encode()) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    rules = repetition.RepetitionRules()
    rows = [r for r in rows if repetition.judge(r[1].encode(), rules)[-1]]
    first = {i for (_, i), _, c in brute_components(rows) if c == i}
    scanner = contamination.Scanner(items, 10)
    rows = [r for r in rows if r[0] in first and not scanner.scan(r[1].encode())[1]]
    state = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before, state = state, written(stage(spark, state, data), name)
        if k < 4:
            assert state.columns == docs.columns
        if k == 2:
            assert sorted((r.doc_id, r.text) for r in state.collect()) == rows
    found = state.collect()
    trees = personal_data.train(spark)
    clean = {r.row.doc_id: (r.row.text, [tuple(s) for s in r.spans]) for r in personal_data.find_spans(spark.createDataFrame(rows, "doc_id long, text string"), trees).collect()}
    wanted = []
    for i, (text, spans) in clean.items():
        out, at = "", 0
        for kind, start, end in sorted(spans, key=lambda s: s[1:]):
            if start >= at:
                out += text[at:start] + f"[{kind.upper()}]"
            at = max(at, end)
        ids = ids_of(tokenizer, out + text[at:], 0)
        cuts = [0, *range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)]
        wanted += [(i, k, a, b - a, crc(ids[a:b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == sorted(wanted)
    check_packing(found, 2048)


def test_queries_are_registered():
    assert set(queries.QUERIES) | {"pipeline"} <= set(driver.queries())
    assert {int(name[2:].split("_")[0]) for name in queries.QUERIES} == set(range(1, 14))
    assert set(queries.ORACLES) <= set(driver.oracle_sql())


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_oracle(spark, data, name):
    from oracle import connect, differences

    assert differences(queries.QUERIES[name](spark, data), connect(data), queries.ORACLES[name]) is None


@pytest.mark.parametrize("name", ["op1_license_scan", "op3_personal_data", "op7_quotation_linking"])
def test_native_queries_run_no_python(spark, data, name):
    plan = queries.QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))
