"""Quality rules by repetition coverage.

Rolling hashes of several n-gram lengths, computed in numpy over the words of a whole text, mark the words that stand inside
n-grams found before; lines are compared the same way. The verdict looks at the share of characters that the marks cover.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.llm.common import keep_rows, map_rows

SYMBOLS = b"#*$%&|<>"
COUNTS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "dup_line_chars long, dup_ngram_chars array<long>, base_failed boolean, kept boolean"
)


@dataclass(frozen=True)
class RepetitionRules:
    """``ngrams``: lengths in words; a text is rejected if more than the share of its word characters stands inside n-grams of that
    length that occurred before in the text, or inside lines that did. ``ngrams`` ascends. ``max_symbols``: symbols per word."""

    min_words: int = 50
    ngrams: tuple[int, ...] = (5, 7, 10)
    max_ngram_share: tuple[float, ...] = (0.45, 0.40, 0.35)
    max_line_share: float = 0.35
    max_symbols: float = 0.4


def _rolled(hashes: np.ndarray, n: int) -> np.ndarray:
    """A polynomial hash (mod 2^64) of each n consecutive words, by Horner's rule over shifted views."""
    m = len(hashes) - n + 1
    out = np.zeros(m, np.uint64)
    for k in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + m]
    return out


def _seen(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: whether it occurs twice or more, and whether it occurred at an earlier place."""
    order = np.argsort(keys, kind="stable")
    sorted_keys = keys[order]
    same = sorted_keys[1:] == sorted_keys[:-1]
    later = np.zeros(len(keys), bool)
    later[order[1:]] = same
    twice = later.copy()
    twice[order[:-1]] |= same
    return twice, later


def _repeats(keys: np.ndarray) -> bool:
    ordered = np.sort(keys)
    return bool((ordered[1:] == ordered[:-1]).any())


def _covered(starts: np.ndarray, n: int) -> np.ndarray:
    """Words inside the n-grams that start at the marked places."""
    edges = np.zeros(len(starts) + n, np.int32)
    edges[: len(starts)] += starts
    edges[n:] -= starts
    return np.cumsum(edges[:-1]) > 0


def measure(data: bytes, ngrams: tuple[int, ...]) -> tuple[int, int, int, int, int, int, list[int]]:
    """Counts of one text: words, word characters, symbols, repeated lines, words in repeated 3-word windows, characters inside
    lines seen before, and per length the characters inside n-grams seen before."""
    words = data.split()  # bytes split at exactly 0x20 and 0x09-0x0D
    n = len(words)
    if not n:
        return 0, 0, 0, 0, 0, 0, [0] * len(ngrams)
    n_symbols = len(data) - len(data.translate(None, SYMBOLS))
    if data.isascii():
        chars = np.fromiter(map(len, words), np.int64, n)
    else:
        chars = np.fromiter((len(w.decode()) for w in words), np.int64, n)
    # Equal words are equal keys: hash() of bytes is a keyed hash, stable within the process, which is all that is needed here.
    keys = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
    n_dup_lines = dup_line_chars = 0
    seen = set()
    for line in data.split(b"\n"):
        parts = line.split()
        if parts and line in seen:
            n_dup_lines += 1
            dup_line_chars += len(b"".join(parts).decode())
        elif parts:
            seen.add(line)
    n_repeat = 0
    triples = _rolled(keys, 3) if n >= 3 else keys[:0]
    if _repeats(triples):
        n_repeat = int(_covered(_seen(triples)[0], 3).sum())
    covered, size_free = [], 3 if not n_repeat else n + 1
    for size in ngrams:
        # A repeated n-gram holds a repeated shorter one, so nothing is left to find beyond a length without repeats.
        grams = _rolled(keys, size) if size <= n and size < size_free else keys[:0]
        if _repeats(grams):
            covered.append(int(chars[_covered(_seen(grams)[1], size)].sum()))
        else:
            covered.append(0)
            size_free = min(size_free, size)
    return n, int(chars.sum()), n_symbols, n_dup_lines, n_repeat, dup_line_chars, covered


def judge(data: bytes | None, rules: RepetitionRules) -> tuple:
    """The values of ``COUNTS`` for one text."""
    counts = measure(data or b"", rules.ngrams)
    n, chars, symbols, _, repeat, line_chars, covered = counts
    failed = n < rules.min_words or 100 * repeat > 50 * n
    good = not failed and line_chars <= rules.max_line_share * chars and symbols <= rules.max_symbols * n
    good = good and all(c <= share * chars for c, share in zip(covered, rules.max_ngram_share, strict=True))
    return (*counts, failed, good)


def repetition_coverage(docs: DataFrame, rules: RepetitionRules | None = None, text: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """Counts and verdict beside the struct ``row`` of the input's columns (``keep``: of those only).

    One pass without a shuffle. A null text has no words and fails ``min_words``. Repeated rows are judged one by one, an empty
    table gives an empty result, and columns of any name may come along, as they stay inside ``row``.
    """
    rules = rules or RepetitionRules()
    columns = [F.col(f"`{c}`") for c in (docs.columns if keep is None else keep)]
    source = docs.select(F.struct(*columns).alias("row"), F.col(f"`{text}`").alias("text"))
    return map_rows(source, lambda: lambda texts: [judge(t, rules) for t in texts], COUNTS, carry=["row"])


def keep_good(docs: DataFrame, rules: RepetitionRules | None = None, text: str = "text") -> DataFrame:
    """The rows whose verdict is good, with the input's columns."""
    rules = rules or RepetitionRules()
    return keep_rows(docs, lambda: lambda texts: [judge(t, rules)[-1] for t in texts], text)
