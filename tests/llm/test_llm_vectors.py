"""Neighbours, vector codes and fill-in-the-middle against brute force, exact round trips and measured recall."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnwise.llm import fill_middle, neighbours, vector_codes

NAN, INF = float("nan"), float("inf")
VECTORS = "vec_id long, embedding array<float>, label int, shard string, row string"


def vector_rows(n=400, dim=8, seed=5):
    """Random vectors of several lengths and norms, copies, near copies, and vectors that take no part."""
    rng = np.random.default_rng(seed)
    rows = [(k, (rng.normal(size=dim) * rng.choice([0.01, 1, 30])).astype(np.float32).tolist(), k % 7 or None) for k in range(n)]
    rows += [(1000 + k, rows[3][1], 1) for k in range(60)]
    rows += [(2000 + k, (np.array(rows[4][1]) + rng.normal(size=dim) * 1e-4).astype(np.float32).tolist(), 1) for k in range(60)]
    bad = [None, [0.0] * dim, [None, *[1.0] * (dim - 1)], [NAN, *[1.0] * (dim - 1)], [INF, *[1.0] * (dim - 1)], [-INF, *[1.0] * (dim - 1)]]
    rows += [(5000 + 20 * k, v, 2) for k, v in enumerate(bad)]
    return [(*r, "x", "y") for r in rows]


def takes_part(vector):
    return vector is not None and None not in vector and bool(np.isfinite(vector).all()) and any(vector)


def brute_neighbours(rows, nearest, every):
    good = [(r[0], np.array(r[1], np.float32).astype(np.float64)) for r in rows if r[0] is not None and takes_part(r[1])]
    found = {}
    for i, q in good:
        if i % every == 0:
            scored = {}
            for j, v in good:
                if j != i and len(v) == len(q):
                    score = 0.0
                    for a, b in zip(q, v, strict=True):
                        score += a * b
                    scored[j] = max(score, scored.get(j, -INF))
            found[i] = sorted(((-s, j) for j, s in scored.items()))[:nearest]
    return found


@pytest.mark.parametrize("shard_vectors", [100_000, 40])
def test_neighbours_of_small_shards_are_exact(spark, shard_vectors):
    rows = vector_rows()
    rows += [(20, rows[20][1], 0, "repeated", "z"), (None, [1.0] * 8, 0, "no id", "z"), (6000, [2.0, 1.0], 0, "short", "z"), (6001, [1.0, 1.0], 0, "short", "z")]
    vectors = spark.createDataFrame(rows, VECTORS).repartition(5)
    index = neighbours.build_index(vectors, 20, shard_vectors=shard_vectors)
    assert index.count() >= (1 if shard_vectors > 1000 else 5)
    found = {}
    for r in neighbours.search_index(index, vectors.where("vec_id % 20 = 0"), 20, beam=600, query_block=10).collect():
        found.setdefault(r.query_id, []).append((r.rank, -r.score, r.vec_id))
    wanted = brute_neighbours(rows, 20, 20)
    assert {i: [x[1:] for x in sorted(ranked)] for i, ranked in found.items()} == wanted
    assert [r for r, _, _ in sorted(found[20])] == list(range(1, 21)) and len(found[6000]) == 1
    empty = neighbours.build_index(vectors.limit(0), 20)
    assert empty.count() == 0 and neighbours.search_index(empty, vectors, 20).count() == 0
    assert neighbours.search_index(index, vectors.limit(0), 20).count() == 0


def test_recall_of_the_beam(spark, data):
    """With the registered settings, on the given vectors and on tight groups far from each other."""
    given = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{data}/embeddings.parquet").collect()]
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 32))
    grouped = [(k, (centres[k % 40] + rng.normal(size=32) * 0.02).astype(np.float32).tolist()) for k in range(4000)]
    for rows in (given, grouped):
        vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
        asked = vectors.where("vec_id % 20 = 0")
        found = {}
        for r in neighbours.search_index(neighbours.build_index(vectors, 20), asked, 20).collect():
            found.setdefault(r.query_id, set()).add(r.vec_id)
        ids, all_ = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)
        recalls = []
        for k in np.flatnonzero(ids % 20 == 0):
            near = all_ @ all_[k]
            near[k] = -INF
            recalls.append(len(found[ids[k]] & set(ids[np.lexsort((ids, -near))[:20]])) / 20)
        assert np.mean(recalls) >= 0.95


def test_every_node_is_reached():
    rng = np.random.default_rng(3)
    points = neighbours.unit_points(np.vstack([rng.normal(size=(300, 6)), 50 + rng.normal(size=(30, 6)) * 1e-3, rng.normal(size=(1, 6))]))
    edges, start = neighbours.build_graph(points, neighbours.GraphRules(degree=8, beam=16))
    assert neighbours.beam_search(points, edges, start, points[:1], len(points))[0].min() >= 0
    found = neighbours.beam_search(points, edges, start, points, 16)[0]
    assert ((found == np.arange(len(points))[:, None]).any(axis=1)).mean() > 0.99


# ---- codes ----


def brute_codes(rows, parts=4):
    """Codes, errors and codebooks by comparing every part with every entry in Python's integers."""
    kept = [(i, [int(np.floor(np.float64(np.float32(x)) * 1024)) for x in v], label) for i, v, label, *_ in rows if v is not None and None not in v and bool(np.isfinite(v).all())]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:256]
    width = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for _, v, _ in first] for p in range(parts)]

    def assign(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(books[p]))

    for _ in range(4):
        members = [[[] for _ in book] for book in books]
        for _, v, _ in kept:
            for p in range(parts):
                members[p][assign(p, cut(v, p))[1]].append(cut(v, p))
        books = [[[sum(c) // len(m) for c in zip(*m, strict=True)] if m else e for e, m in zip(book, ms, strict=True)] for book, ms in zip(books, members, strict=True)]
    coded = []
    for i, v, label in kept:
        found = [assign(p, cut(v, p)) for p in range(parts)]
        coded.append((i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), label))
    return coded, hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()


@pytest.mark.parametrize(("n", "limits"), [(400, None), (400, (2, 1, 3)), (1, None), (40, (16, 4, 32))])
def test_codes(spark, monkeypatch, n, limits):
    if limits:
        for name, value in zip(("KEPT_FIRST", "KEPT_LEAST", "KEPT_MOST"), limits, strict=True):
            monkeypatch.setattr(vector_codes, name, value)
    rows = vector_rows(n) if n > 4 else vector_rows()[:n]
    rows += [(None, [0.0] * 8, None, "x", "y"), rows[0], rows[0]]
    vectors = spark.createDataFrame(rows, VECTORS).repartition(3)
    coded, books = vector_codes.compress(vectors)
    found = vector_codes.with_label_error(coded).collect()
    wanted, digest = brute_codes(rows)
    by_label = {}
    for _, _, error, label in wanted:
        by_label[label] = by_label.get(label, 0) + error
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    assert sorted(((r.vec_id, r.label, r.code, r.error, r.label_error) for r in found), key=key) == sorted(((i, label, c, e, by_label[label]) for i, c, e, label in wanted), key=key)
    assert books.digest() == digest
    near = [i for i, _ in enumerate(rows) if rows[i][0] == 7]
    for k in near:
        row = next(r for r in found if r.vec_id == 7)
        ints = np.floor(np.array(rows[k][1], np.float32).astype(np.float64) * 1024)
        assert ((books.decode(row.code) - ints) ** 2).sum() == row.error


def test_codes_of_nothing_and_of_misfits(spark):
    vectors = spark.createDataFrame(vector_rows(), VECTORS)
    coded, books = vector_codes.compress(vectors.where("embedding IS NULL"))
    assert books is None and vector_codes.with_label_error(coded).count() == 0
    for bad in ([1.0] * 6, [1e9] * 8):
        with pytest.raises(ValueError, match="vectors of one length|components of at most"):
            vector_codes.compress(spark.createDataFrame([(1, [1.0] * 8, 1, "", ""), (2, bad, 1, "", "")], VECTORS))


def test_bounds_never_lose_the_nearest_entry():
    """Entries that move at random, rounds with few kept entries, ties."""
    rng = np.random.default_rng(9)
    points = rng.integers(-40, 40, size=(500, 4))
    books = vector_codes.Codebooks(rng.integers(-40, 40, size=(1, 64, 4)))
    state = vector_codes.PartState.empty(len(points))
    skipped = 0
    for turn in range(12):
        looked = state.assign(points, books.entries[0], None if books.drift is None else books.drift[0], [8, 3, 5, 0][turn % 4])
        skipped += int((looked == 0).sum())
        far = ((points[:, None, :] - books.entries[0]) ** 2).sum(axis=2)
        assert (state.code == far.argmin(axis=1)).all()
        step = rng.integers(-3, 4, size=books.entries.shape) * (rng.random((1, 64, 1)) < 0.2)
        books = books.moved(books.entries + step, np.ones(books.entries.shape[:2], int))
    assert skipped > 500


# ---- fill in the middle ----


def brute_middle(doc_id, text, rules):
    lines = re.findall(r"[^\n]*\n|[^\n]+", text or "")
    digest = hashlib.sha256(f"{rules.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[k : k + 8], 16) for k in range(0, 32, 8)]
    n = len(lines)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rules.rate:
        return n, "plain", None, None, text or ""
    if h[3] % 100 < rules.spm:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def middle_rows():
    rng = random.Random(4)
    texts = [None, "", "\n", "\n\n\n", "one line", "end\n", "a <P> in it\nmore", "<S>", "x<M>", "no < P > mark\n<\nP>\n", "é漢😀\n\r\nü", "<P\n>", "a\r\nb\rc d\n"]
    texts += ["".join(rng.choice(["a", "é", "漢", "😀", "\n", "\n", "<", "P", " word"]) for _ in range(rng.randint(0, 60))) for _ in range(200)]
    texts += ["long line " * 30_000, "😀漢é" * 40_000 + "\n" + "x" * 200_000, "line\n" * 60_000, "\n" * 150_000]
    return [(k, t, "x", "y") for k, t in enumerate(texts)] + [(None, "no id\nat all\n", "x", "y"), (3, "again\nand\nagain", "x", "y"), (3, "again\nand\nagain", "x", "y")]


@pytest.mark.parametrize("rules", [fill_middle.MiddleRules(), fill_middle.MiddleRules(seed=1, rate=40, spm=100)])
@pytest.mark.parametrize("size", [1 << 16, 7])
def test_fill_in_middle(spark, monkeypatch, rules, size):
    monkeypatch.setattr(fill_middle.pieces, "__defaults__", (size,))
    rows = [r for r in middle_rows() if size > 100 or len(r[1] or "") < 100]
    docs = spark.createDataFrame(rows, "doc_id long, text string, form string, frames string").repartition(3)
    made = fill_middle.fill_in_middle(fill_middle.frame_texts(docs), rules)
    found = sorted(((r.row.doc_id is not None, r.row.doc_id or 0), r.n_units, r.form, r.prefix_chars, r.middle_chars, r.output, r.restored) for r in fill_middle.texts(made).collect())
    key = lambda r: (r[0], r[1], r[2], r[5], r[6])
    wanted = [((i is not None, i or 0), *brute_middle(i, t, rules), t or "") for i, t, *_ in rows]
    assert sorted(found, key=key) == sorted(wanted, key=key)
    hashed = sorted((r.output_sha256, r.restored_sha256) for r in fill_middle.digests(made).collect())
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    assert hashed == sorted((sha(w[5]), sha(w[6])) for w in wanted)
    assert {r.row.frames for r in made.select("row").collect()} == {"y"}


def test_cuts_read_one_frame():
    tool = fill_middle.Frames()
    text = "".join(f"line {k}\n" for k in range(20_000)).encode()
    frames, n, chars = tool.pack([text])
    assert n == 20_000 and chars == len(text) and len(frames) > 2
    read = []
    plain = tool.plain
    tool.plain = lambda frame: read.append(frame["units"]) or plain(frame)
    place, before = tool.cut(frames, 15_000)
    assert len(read) == 1 and before == len("".join(f"line {k}\n" for k in range(15_000)))
    tool.plain = plain
    assert b"".join(tool.stream(frames, place)).startswith(b"line 15000\n")


def test_empty_table_has_no_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert fill_middle.digests(fill_middle.fill_in_middle(fill_middle.frame_texts(docs))).where(F.col("form") == "psm").count() == 0
