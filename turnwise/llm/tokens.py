"""Token ids of whole texts, by the tokenizers library, with a cache of the pieces that texts are made of."""

from __future__ import annotations

import json
import os
import re
import string
import struct
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from turnwise.llm.common import worker_cache

VOCABULARY = "byte_bpe_50k.json"
#: Words and stems kept per worker (each about 200 bytes); when they are more, the rare ones go.
CACHED_WORDS = 200_000
#: Text handled at a time; numpy and Arrow take some twenty times as much for it.
PIECE_BYTES = 2 << 20
# White space in the sense of any of the libraries involved: where two such characters meet, or a text starts with one, texts are not cut.
_SPACE = r"[\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_UNCUT = rf"(?:^|{_SPACE}){_SPACE}"


def vocabulary_path(vocabulary: str) -> str:
    """``vocabulary`` is a path, or the name of a file of the installed ``public_tokenizers``."""
    if os.sep in vocabulary:
        return vocabulary
    import public_tokenizers

    return public_tokenizers.path(vocabulary)


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 bytes stand for themselves, the others for
    the code points from 256 on, in order."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(others)}


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Encoder:
    """Encodes texts to ids.

    A byte-level vocabulary with the usual splitting pattern never merges across a single space or line end between two other
    characters. So a batch of texts is cut there, Arrow finds its distinct words, each new word is encoded once, and numpy puts the
    ids of the words together. Words of Latin letters, and the marks behind them, go straight to the library's model; all else goes
    through its whole chain, and so do the texts in which white space meets white space, and all texts of other vocabularies.
    """

    def __init__(self, vocabulary: str = VOCABULARY, special_as_text: bool = True) -> None:
        from tokenizers import Tokenizer

        path = vocabulary_path(vocabulary)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        known = json.loads(Path(path).read_text(encoding="utf-8"))
        split = known.get("pre_tokenizer") or {}
        special = [] if special_as_text else [re.escape(t["content"]) for t in known["added_tokens"]]
        self.uncut = "|".join([_UNCUT, *special])
        self.by_word = (
            split.get("type") == "ByteLevel"
            and split.get("use_regex", True)
            and not split.get("add_prefix_space")
            and not any(known.get(k) for k in ("normalizer", "truncation", "padding", "post_processor"))
        )
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        self.line_end = self._whole("\n")
        self.by_word = self.by_word and len(self.line_end) == 4
        self.words: dict[str, bytes] = {}
        self.stems: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return _packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _word(self, word: str) -> bytes:
        """The ids of a word: of a space and the word, or of a line end and what follows it."""
        lead = b""
        if word[:1] == "\n":
            word, space, lead = word[1:], "", self.line_end
        else:
            space = " "
        stem = word.rstrip(string.punctuation)
        if not (stem.isalpha() and max(stem) < "\u0250"):
            return lead + self._whole(space + word)
        mapped = stem if stem.isascii() else stem.encode().decode("latin-1").translate(self.letters)
        if space:
            mapped = self.letters[32] + mapped
        if (found := self.stems.get(mapped)) is None:
            found = self.stems[mapped] = _packed([t.id for t in self.model.tokenize(mapped)])
        end = word[len(stem) :]
        if end and end not in self.marks:
            if len(self.marks) > 10_000:
                self.marks.clear()
            self.marks[end] = self._whole(end)
        return lead + found + (self.marks[end] if end else b"")

    def encode(self, texts: pa.StringArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For consecutive runs of the texts (none null): all their ids as one uint32 array, and the bounds of the texts in it."""
        step = max(1, int(len(texts) * PIECE_BYTES / max(1, texts.nbytes)))
        for at in range(0, len(texts), step):
            yield self._run(texts.slice(at, step))

    def _run(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        whole = np.ones(len(texts), bool)
        if self.by_word:
            whole = pc.match_substring_regex(texts, self.uncut).to_numpy(zero_copy_only=False)
        ids, bounds = self._cut(texts.filter(pa.array(~whole)))
        if not whole.any():
            return ids, bounds
        found: list = [None] * len(texts)
        for k, place in enumerate(np.flatnonzero(~whole)):
            found[place] = ids[bounds[k] : bounds[k + 1]]
        for place in np.flatnonzero(whole):
            found[place] = np.frombuffer(self._whole(texts[int(place)].as_py()), "<u4")
        return np.concatenate(found), np.concatenate([[0], np.cumsum([len(x) for x in found])])

    def _cut(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        if not len(texts):
            return np.empty(0, "<u4"), np.zeros(1, np.int64)
        # A line end is put before each text, so that every word follows a space or a line end; its id is left out below.
        marked = pc.binary_join_element_wise("\n", pc.replace_substring(texts, "\n", " \n"), "")
        split = pc.split_pattern(marked, " ")
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.words) > CACHED_WORDS:  # frequent words stand in nearly every piece, so those of this one are the ones to keep
            self.words = {word: self.words[word] for word in words if word in self.words}
        if len(self.stems) > CACHED_WORDS:
            self.stems = {}
        known = self.words
        for word in words:
            if word not in known:
                known[word] = self._word(word)
        parts = [known[word] for word in words]
        pool = np.frombuffer(b"".join(parts), "<u4")
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) >> 2
        starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        codes = coded.indices.to_numpy()
        lengths = sizes[codes]
        ends = np.cumsum(lengths)
        gather = np.repeat(starts[codes] - (ends - lengths), lengths)
        gather += np.arange(len(gather))
        ids = pool[gather]
        firsts = split.offsets.to_numpy().astype(np.int64) - split.offsets[0].as_py()
        bounds = np.concatenate([[0], ends])[firsts]
        keep = np.ones(len(ids), bool)
        keep[bounds[:-1]] = False
        return ids[keep], bounds - np.arange(len(bounds))


def encoder(vocabulary: str = VOCABULARY, special_as_text: bool = True) -> Encoder:
    """The worker's encoder of this vocabulary."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # one thread per task
    kept = worker_cache("encoders")
    key = (vocabulary, special_as_text)
    if key not in kept:
        kept[key] = Encoder(vocabulary, special_as_text)
    return kept[key]
