"""Benchmark decontamination with one Aho-Corasick automaton over the normalised test items.

Items and documents become sequences of words (ASCII lower-cased; a word is a run of ASCII letters, digits and non-ASCII characters).
Every run of ``window`` item words is a pattern, an item of fewer words is one pattern. The automaton's letters are numbers of words that
occur in items, so a match always covers whole words, and a text is scanned once.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.llm.common import keep_rows, map_rows, written

WINDOW = 10
#: Bytes of item texts in one automaton (it takes some hundred times as much memory); larger benchmarks take several passes over the documents, with the same result.
BLOCK_BYTES = 1 << 20
FOUND = "n_words long, runs array<struct<first:int,after:int>>, items array<string>"
PASSAGES = "passages array<struct<start:long,end:long>>"
_WORD = re.compile(rb"[^ ]+")
_TABLE = bytes(
    b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256)
)


def normalised(data: bytes) -> bytes:
    """The same length, byte for byte: letters lower-cased, all that is no word made a space."""
    return data.translate(_TABLE)


class Scanner:
    """The automaton of one block of items, given as (id, text in bytes)."""

    def __init__(self, items: Sequence[tuple[str, bytes]], window: int) -> None:
        import ahocorasick

        self.numbers: dict[bytes, int] = {}
        patterns: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            words = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in normalised(text).split()]
            for at in range(max(1, len(words) - window + 1) if words else 0):
                patterns.setdefault(tuple(words[at : at + window]), set()).add(item)
        self.any = bool(patterns)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        # Equal sets of items are one object, and patterns go as the automaton grows: a worker holds them once.
        same: dict[frozenset[str], frozenset[str]] = {}
        while patterns:
            words, named = patterns.popitem()
            found = frozenset(named)
            self.automaton.add_word(words, (len(words), same.setdefault(found, found)))
        if self.any:
            self.automaton.make_automaton()

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, int]], set[str]]:
        """Words of the text, the runs of words inside occurrences (merged), and the items that occur."""
        words = normalised(text).split()
        runs: list[tuple[int, int]] = []
        items: set[str] = set()
        if not self.any or not words:
            return len(words), runs, items
        number = self.numbers.get
        for end, (size, found) in self.automaton.iter(tuple([number(w, 0) for w in words])):
            first = end - size + 1
            while runs and first <= runs[-1][1]:
                first = min(first, runs.pop()[0])
            runs.append((first, end + 1))
            items |= found
        return len(words), runs, items


def merged(runs: Sequence[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for first, after in sorted(runs):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(after, out[-1][1]))
        else:
            out.append((first, after))
    return out


def _blocks(benchmark: DataFrame, item: str, text: str, limit: int) -> list[DataFrame]:
    """The items that have a text, each once, in blocks of about ``limit`` bytes: of at most twice as many, or one item."""
    items = benchmark.select(F.coalesce(F.col(f"`{item}`").cast("string"), F.lit("")).alias("item"), F.col(f"`{text}`").cast("binary").alias("text")).where("text IS NOT NULL")
    items = items.distinct()
    if items.isEmpty():
        return [items]
    items = written(items, "items")
    cost = F.octet_length("text") + F.octet_length("item") + F.lit(16)
    done, todo = [], [(items, 0)]
    while todo:
        part, seed = todo.pop()
        size = part.agg(F.sum(cost)).first()[0]
        block = F.pmod(F.xxhash64("item", "text", F.lit(seed)), F.lit(math.ceil(size / limit)))
        for row in part.groupBy(block.alias("block")).agg(F.sum(cost).alias("size"), F.count("*").alias("n")).orderBy("block").collect():
            members = part.where(block == row["block"])
            if row["size"] <= 2 * limit or row["n"] == 1:
                done.append(members)
            else:
                todo.append((members, seed + 1))
    return done


def _shared(block: DataFrame):
    """A block's items for every task; only its bounded rows pass through the driver."""
    return block.sparkSession.sparkContext.broadcast([(r[0], bytes(r[1])) for r in block.collect()])


def find_items(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    doc_text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    keep: Sequence[str] | None = None,
    with_text: bool = True,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Words, hit runs of words, and items found, beside the struct ``row`` of the documents' columns (``keep``: of those) and ``text``.

    The automaton goes to every task, so only ``block_bytes`` of items are in it; the documents are scanned once per block. Null texts have
    no words; null items are skipped, items without an id count as the id ''. Repeated items count once by id, repeated documents are
    scanned one by one. Without items or documents nothing is hit. Columns of any name may come along inside ``row``.
    """
    columns = [F.col(f"`{c}`") for c in (docs.columns if keep is None else keep)]
    state = docs.select(F.struct(*columns).alias("row"), F.col(f"`{doc_text}`").alias("text"))
    blocks = _blocks(benchmark, item_id, item_text, block_bytes)
    for k, block in enumerate(blocks):
        shared = _shared(block)

        def make(shared=shared):
            scanner = Scanner(shared.value, window)

            def work(texts, *before):
                for n, text in enumerate(texts):
                    count, runs, items = scanner.scan(text or b"")
                    if before:
                        runs = merged([*runs, *[(r["first"], r["after"]) for r in before[0][n]]])
                        items |= set(before[1][n])
                    yield count, [{"first": a, "after": b} for a, b in runs], sorted(items)

            return work

        if k:
            state = written(state.drop("n_words"), "decontamination")
        carry = ["row", "text"] if with_text or k + 1 < len(blocks) else ["row"]
        given = state.select(*carry, F.col("text").alias("scanned"), *[F.col(c).alias(f"{c}_before") for c in ("runs", "items") if k])
        state = map_rows(given, make, FOUND, carry=carry)
    return state


def with_passages(found: DataFrame) -> DataFrame:
    """Add the places of the hit runs in the original text: code points, end exclusive. Takes the table of ``find_items`` with its text; a null or
    empty text has none, repeated rows each have theirs, an empty table gives an empty one, and columns inside ``row`` pass as they are."""

    def make():
        def work(texts, runs):
            for text, hit in zip(texts, runs, strict=True):
                if not hit:
                    yield ([],)
                    continue
                places = [m.span() for m in _WORD.finditer(normalised(text))]
                points = np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)
                begin = lambda byte: int(points[byte]) - 1  # noqa: E731  code points before this first byte
                yield ([{"start": begin(places[r["first"]][0]), "end": int(points[places[r["after"] - 1][1] - 1])} for r in hit],)

        return work

    kept = [c for c in found.columns]
    given = found.select(*kept, F.col("text").alias("scanned"), F.col("runs").alias("scanned_runs"))
    return map_rows(given, make, PASSAGES, carry=kept)


def keep_clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents in which no item occurs, with their columns, whatever these are called. Null and empty texts hold no item and stay, as do
    repeated clean rows; items without a text are skipped; without items all documents stay, and an empty table gives an empty one."""
    for block in _blocks(benchmark, "item_id", "text", block_bytes):
        shared = _shared(block)

        def make(shared=shared):
            scanner = Scanner(shared.value, window)
            return lambda texts: [not scanner.scan(t or b"")[1] for t in texts]

        docs = keep_rows(docs, make)
    return docs
