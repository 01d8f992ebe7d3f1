"""What a Python worker holds at a time."""

import tracemalloc

import pyarrow as pa
from pyspark.sql import functions as F

from turnwise.llm import tokens
from turnwise.llm.common import bounded, keep_rows
from turnwise.llm.contamination import Scanner
from turnwise.llm.tokens import Encoder


def test_rows_are_kept_in_bounded_pieces(spark):
    """All texts of an Arrow batch stood in a worker at once, as bytes, beside the batch and what is kept of it."""

    def make():
        def work(texts):
            assert sum(map(len, texts)) <= 5 << 20
            return [len(t) % 3 > 0 for t in texts]

        return work

    docs = spark.range(400).coalesce(1).select("id", F.repeat(F.lit("x"), (F.col("id") + 50_000).cast("int")).alias("text"))
    assert [r.id for r in keep_rows(docs, make).select("id").collect()] == [i for i in range(400) if (i + 50_000) % 3]
    batch = pa.RecordBatch.from_pydict({"text": ["y" * 1000] * 999})
    assert [p.num_rows for p in bounded([batch, batch.slice(0, 0)], 100_000)] == [99] * 10 + [9]


def test_patterns_of_an_item_share_one_set():
    items = [(f"i{k}", " ".join(f"w{k * n}" for n in range(60)).encode()) for k in range(1, 20)]
    automaton = Scanner(items, 10).automaton
    sets = [found for _, found in automaton.values()]
    assert len(sets) > 900 and len({id(s) for s in sets}) == len(set(sets)) == 19


def test_encoder_holds_little_beside_its_words():
    """8 MB of text were put into numpy arrays at once, which took some 100 MB in each worker."""
    encode = Encoder()
    texts = pa.array([" ".join(f"word{(k * n) % 97}" for n in range(1200)) for k in range(1000)])
    list(encode.encode(texts.slice(0, 100)))
    tracemalloc.start()
    try:
        total = sum(len(ids) for ids, _ in encode.encode(texts))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert texts.nbytes > 7 << 20 and total > 1_000_000
    assert peak < 48 << 20


def test_frequent_words_stay_when_the_cache_is_full(monkeypatch):
    """The older half went, and frequent words are among the oldest: they were encoded anew after each time."""
    monkeypatch.setattr(tokens, "CACHED_WORDS", 3000)
    encode, coded = Encoder(), []
    word = encode._word
    encode._word = lambda w: coded.append(w) or word(w)
    common = [f"often{k}" for k in range(50)]
    texts = [" ".join([*common, *[f"rare{k}x{n}" for n in range(1000)], *common]) for k in range(12)]
    found = [ids for text in texts for ids, _ in encode.encode(pa.array([text]))]
    assert all(coded.count(w) == 1 for w in common[1:])
    assert len(encode.words) <= 3000 + 1100 and len(encode.stems) <= 3000 + 1100
    assert [f.tolist() for f in found] == [encode.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
