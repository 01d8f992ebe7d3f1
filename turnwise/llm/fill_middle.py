"""Fill-in-the-middle documents over seekable frames.

A text is kept as independent zstandard frames, each with the number of units (lines) and characters before it. A cut between two units is found
by decompressing the one frame that holds it; a document is put together, hashed and restored by passing its frames in order, so no step
holds more than a frame of plain text beside the compressed ones.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.llm.common import map_rows, written

#: Bytes of text in a frame.
FRAME_BYTES = 1 << 16
LEVEL = 3
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
FRAMES = "array<struct<units: long, chars: long, data: binary>>"


@dataclass(frozen=True)
class MiddleRules:
    """``seed`` of the cuts; of 100 documents, how many are transformed (``rate``), and how many of these start with the suffix (``spm``)."""

    seed: int = 7
    rate: int = 100
    spm: int = 50


def characters(data: bytes) -> int:
    """Code points of UTF-8."""
    return len(data) if data.isascii() else len(data.decode())


def pieces(chunks: Iterable[bytes], size: int = FRAME_BYTES) -> Iterator[bytes]:
    """The same bytes in pieces of about ``size``, cut between characters."""
    held = b""
    for chunk in chunks:
        held += chunk
        at = 0
        while len(held) - at >= size + 4:
            end = at + size
            while held[end] & 0xC0 == 0x80:
                end -= 1
            yield held[at:end]
            at = end
        held = held[at:]
    if held:
        yield held


class Frames:
    """Packs and reads the frames of one text after the other."""

    def __init__(self) -> None:
        self.packer, self.reader = zstandard.ZstdCompressor(level=LEVEL), zstandard.ZstdDecompressor()

    def pack(self, chunks: Iterable[bytes]) -> tuple[list[dict], int, int]:
        """The frames of a text, its units (a last line without an end is one) and its characters."""
        frames, units, chars, last = [], 0, 0, b"\n"
        for piece in pieces(chunks):
            frames.append({"units": units, "chars": chars, "data": self.packer.compress(piece)})
            units += piece.count(b"\n")
            chars += characters(piece)
            last = piece[-1:]
        return frames, units + (last != b"\n"), chars

    def plain(self, frame: dict) -> bytes:
        return self.reader.decompress(frame["data"])

    def stream(self, frames: Sequence[dict], first: tuple[int, int] = (0, 0), after: tuple[int, int] | None = None) -> Iterator[bytes]:
        """The text from one place to another; a place is a frame's number and an offset in its bytes."""
        end, rest = after or (len(frames), 0)
        for k in range(first[0], min(len(frames), end + (rest > 0))):
            data = self.plain(frames[k])
            data = data[: rest if k == end else len(data)][first[1] if k == first[0] else 0 :]
            if data:
                yield data

    def cut(self, frames: Sequence[dict], units: int) -> tuple[tuple[int, int], int]:
        """The place behind so many whole units, and the characters before it."""
        if not units:
            return (0, 0), 0
        k = bisect_left(frames, units, key=lambda f: f["units"]) - 1
        data = self.plain(frames[k])
        missing, end = units - frames[k]["units"], 0
        for _ in range(missing):
            # The last unit of a text may have no line end.
            end = data.find(b"\n", end) + 1 or len(data)
        return (k, end), frames[k]["chars"] + characters(data[:end])


def frame_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """A written table: the struct ``row`` of the documents' columns but the text (``keep``: of those), doc_id as text, the number of units, whether
    one of the marks is in the text, and its frames.

    A null text is empty and has no frames; repeated rows stay; an empty table gives an empty one; columns of any name may come along.
    """
    kept = [F.col(f"`{c}`") for c in (docs.columns if keep is None else keep) if c != text]
    row = F.struct(*kept) if kept else F.struct(F.lit(None).cast("string").alias("none"))
    given = docs.select(row.alias("row"), F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("")).alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))

    def make():
        frames = Frames()

        def work(texts):
            for data in texts:
                packed, units, _ = frames.pack([data])
                yield units, any(mark in data for mark in (PREFIX, SUFFIX, MIDDLE)), packed

        return work

    return written(map_rows(given, make, f"n long, marked boolean, frames {FRAMES}", carry=["row", "doc_id"]), "frames")


def _form(doc_id: str, n: int, marked: bool, rules: MiddleRules) -> tuple[str, int, int]:
    """The form, and the units before the middle and before the suffix."""
    digest = hashlib.sha256(f"{rules.seed}:{doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in range(0, 32, 8))
    if not n or marked or h3 % 100 >= rules.rate:
        return "plain", 0, 0
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    return ("spm" if h4 % 100 < rules.spm else "psm"), first, second


def fill_in_middle(framed: DataFrame, rules: MiddleRules = MiddleRules()) -> DataFrame:
    """Documents of ``frame_texts`` with their form, the characters of prefix and middle (null if plain), and the frames of the output instead.

    Plain documents keep their text: those without text, those that hold a mark, and those that the rate leaves out. Rows are handled one by
    one, without a shuffle; an empty table gives an empty result.
    """

    def make():
        tool = Frames()

        def work(ids, counts, marks, framed_texts):
            for doc_id, n, marked, frames in zip(ids, counts, marks, framed_texts, strict=True):
                form, a, b = _form(doc_id.decode(), n, marked, rules)
                if form == "plain":
                    yield n, form, None, None, frames
                    continue
                middle, prefix_chars = tool.cut(frames, a)
                suffix, both_chars = tool.cut(frames, b)
                ends = [(PREFIX, (0, 0), middle), (SUFFIX, suffix, None)]
                parts = [*(ends if form == "psm" else ends[::-1]), (MIDDLE, middle, suffix)]
                packed, _, _ = tool.pack(chunk for mark, first, after in parts for chunk in _marked(mark, tool.stream(frames, first, after)))
                yield n, form, prefix_chars, both_chars - prefix_chars, packed

        return work

    given = framed.select("row", "doc_id", "n", "marked", "frames")
    return map_rows(given, make, f"n_units long, form string, prefix_chars long, middle_chars long, output {FRAMES}", carry=["row"])


def _marked(mark: bytes, chunks: Iterator[bytes]) -> Iterator[bytes]:
    yield mark
    yield from chunks


def _find(tool: Frames, frames: Sequence[dict], mark: bytes) -> tuple[tuple[int, int], tuple[int, int]]:
    """Where the first such mark starts and ends; it may lie over the edge of two frames."""
    tail = b""
    for k, frame in enumerate(frames):
        data = tool.plain(frame)
        at = (tail + data).find(mark)
        if at >= 0:
            first, after = at - len(tail), at - len(tail) + len(mark)
            start = (k, first) if first >= 0 else (k - 1, len(tool.plain(frames[k - 1])) + first)
            return start, (k, after)
        tail = (tail + data)[1 - len(mark) :]
    raise ValueError(f"no {mark.decode()} in the output")


def restored(tool: Frames, form: str, frames: Sequence[dict]) -> Iterator[bytes]:
    """The original text, from output and form."""
    if form == "plain":
        yield from tool.stream(frames)
        return
    marks = {mark: _find(tool, frames, mark) for mark in (PREFIX, SUFFIX, MIDDLE)}
    order = sorted(marks, key=lambda mark: marks[mark][0])
    for mark in (PREFIX, MIDDLE, SUFFIX):
        k = order.index(mark)
        yield from tool.stream(frames, marks[mark][1], marks[order[k + 1]][0] if k < 2 else None)


def _from_output(schema: str, value: Callable[[Frames, str, Sequence[dict]], tuple], made: DataFrame) -> DataFrame:
    def make():
        tool = Frames()

        def work(forms, outputs):
            for form, frames in zip(forms, outputs, strict=True):
                yield value(tool, form.decode(), frames)

        return work

    kept = [c for c in made.columns if c != "output"]
    return map_rows(made.select(*kept, F.col("form").alias("as_form"), "output"), make, schema, carry=kept)


def digests(made: DataFrame) -> DataFrame:
    """Instead of the frames: hashes of the output and of the text restored from it, both read as streams."""

    def sha256(chunks: Iterable[bytes]) -> str:
        total = hashlib.sha256()
        for chunk in chunks:
            total.update(chunk)
        return total.hexdigest()

    return _from_output("output_sha256 string, restored_sha256 string", lambda tool, form, frames: (sha256(tool.stream(frames)), sha256(restored(tool, form, frames))), made)


def texts(made: DataFrame) -> DataFrame:
    """Instead of the frames: the output, and the text restored from it."""
    return _from_output("output string, restored string", lambda tool, form, frames: (b"".join(tool.stream(frames)).decode(), b"".join(restored(tool, form, frames)).decode()), made)
