"""Best-fit packing of documents into sequences of fixed length, with certified repacking.

Documents become pieces of at most ``length`` ids. Pieces are dealt to parts of bounded size; each part packs its own best-fit decreasing and
computes lower bounds by dual-feasible functions: functions f with f(x1) + ... + f(xk) <= 1 whenever x1 + ... + xk fit into one
sequence, so that no packing has fewer sequences than the sum of f over all pieces. A part whose count is certified up to a rest below one
sequence keeps all but its emptiest sequences; a part with a larger gap gives up more of them. What is given up is exchanged: dealt
anew to fewer parts and packed again, until one part is left or the count reaches the bound over all pieces.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.llm.common import let_go, written
from turnwise.llm.tokens import VOCABULARY, encoder

LENGTH = 2048
#: Pieces packed in one task.
PART_PIECES = 100_000
#: Sequences given up for each missing one between a part's count and its bound.
EXCHANGED = 16
ROUNDS = 8
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"
PACKED = "row long, doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, open boolean, bound double"


def pieces(docs: DataFrame, length: int = LENGTH, vocabulary: str = VOCABULARY, end_id: int = 0, with_ids: bool = True, doc_id: str = "doc_id", text: str = "text", special_as_text: bool = True) -> DataFrame:
    """The ids of each text and ``end_id``, cut into pieces if they are more than ``length``; the first piece may be shorter.

    A null text is empty and still has its end id; special tokens that stand in a text are ordinary text, or (``special_as_text`` off) what the
    library makes of them; a ``doc_id`` that is no integer is cast to one. ``ids`` holds little-endian uint32 (null without ``with_ids``). No shuffle; rows that
    share an id are cut one by one; an empty table gives no pieces; only the two columns are read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, special_as_text)
        end = np.array([end_id], "<u4")
        for batch in batches:
            done = 0
            for found, bounds in encode.encode(batch.column(1)):
                rows: list[tuple] = []
                for doc, first, after in zip(batch.column(0).slice(done, len(bounds) - 1).to_pylist(), bounds[:-1], bounds[1:], strict=True):
                    ids = np.concatenate([found[first:after], end])
                    cuts = [0, *range(len(ids) % length or length, len(ids) + 1, length)]
                    for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                        part = ids[a:b].tobytes()
                        rows.append((doc, k, a, b - a, zlib.crc32(part), part if with_ids else None))
                done += len(bounds) - 1
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
            let_go()

    names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    given = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    return given.mapInArrow(run, PIECES)


def lower_bound(sizes: np.ndarray, counts: np.ndarray, length: int) -> float:
    """The best of several dual-feasible bounds for ``counts[i]`` pieces of ``sizes[i]``, not rounded up."""
    best = float((sizes * counts).sum() / length)
    for k in range(1, 33):  # x (k+1) / length, rounded down to whole k-ths unless it is whole
        scaled = sizes * (k + 1)
        best = max(best, float((np.where(scaled % length == 0, sizes / length, scaled // length / k) * counts).sum()))
    for small in np.unique(sizes[sizes <= length // 2]):  # what leaves less than ``small`` counts whole, what is smaller not at all
        weight = np.where(sizes > length - small, 1.0, np.where(sizes >= small, sizes / length, 0.0))
        best = max(best, float((weight * counts).sum()))
    return best


def best_fit_decreasing(sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For pieces in descending order of size: the bin of each, and the place in it. Each piece goes to the fullest bin with room for it."""
    by_room: list[list[int]] = [[] for _ in range(length + 1)]
    rooms, used = 0, 0  # bit r of ``rooms``: some bin has r left
    bins, places = [], []
    for size in sizes.tolist():
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            chosen = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, chosen = length, used
            used += 1
        bins.append(chosen)
        places.append(length - room)
        if room > size:
            by_room[room - size].append(chosen)
            rooms |= 1 << (room - size)
    return np.array(bins, np.int64), np.array(places, np.int64)


def _pack_part(length: int):
    def run(table: pa.Table) -> pa.Table:
        row, size = table["row"].to_numpy(), table["length"].to_numpy()
        order = np.lexsort((row, -size))
        table, row, size = table.take(pa.array(order)), row[order], size[order]
        bins, places = best_fit_decreasing(size, length)
        fill = np.bincount(bins, size).astype(np.int64)
        bound = lower_bound(*np.unique(size, return_counts=True), length)
        gap = len(fill) - bound
        emptiest = np.argsort(fill, kind="stable")[: EXCHANGED * max(1, math.ceil(gap))]
        is_open = np.zeros(len(fill), bool)
        is_open[emptiest[fill[emptiest] < length]] = True
        _, firsts = np.unique(bins, return_index=True)
        columns = {name: table[name] for name in ("row", "doc_id", "piece", "start", "length", "ids_crc32")}
        return pa.table(columns | {"sequence_id": row[firsts][bins], "offset": places, "open": is_open[bins], "bound": np.full(len(bins), bound)})

    return run


def pack(cut: DataFrame, length: int = LENGTH, part_pieces: int = PART_PIECES) -> DataFrame:
    """The pieces with their sequences; see ``pack_certified``."""
    return pack_certified(cut, length, part_pieces)[0]


def pack_certified(cut: DataFrame, length: int = LENGTH, part_pieces: int = PART_PIECES) -> tuple[DataFrame, DataFrame]:
    """Give each piece a sequence (named by the row number of its first piece) and its place in it, without gaps from 0.

    Takes the columns of ``pieces`` and adds ``row``, ``sequence_id`` and ``offset``; ``ids`` are left out (see ``sequences``).
    Pieces are numbered and written first, so a repeated task packs the same pieces. Sizes of parts are bounded whatever ids repeat.

    The second table certifies the packing: per round and part the sequences it made, the lower bound of their number, and how many it gave
    up for exchange; and in a row without a round all sequences against the bound over all pieces. It is empty if there are no pieces.
    """
    spark = cut.sparkSession
    if "row" not in cut.columns:
        cut = written(cut.withColumn("row", F.monotonically_increasing_id()), "pieces")
    cut = cut.select("row", "doc_id", "piece", "start", "length", "ids_crc32")
    sizes = cut.groupBy("length").count().collect()  # at most ``length`` rows
    full = cut.where(F.col("length") == length).select("*", F.col("row").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    left = sum(r["count"] for r in sizes if r["length"] < length)
    bound = math.ceil(lower_bound(np.array([r["length"] for r in sizes]), np.array([r["count"] for r in sizes]), length) - 1e-6) if sizes else 0
    bound -= sum(r["count"] for r in sizes if r["length"] == length)
    todo, done, closed, bounds = cut.where(F.col("length") < length), [full], 0, []
    for turn in range(ROUNDS if left else 0):
        parts = math.ceil(left / part_pieces)
        part = F.pmod(F.xxhash64("row"), F.lit(parts))
        packed = written(todo.withColumn("part", part).groupBy("part").applyInArrow(_pack_part(length), PACKED), "packed")
        firsts = packed.where("offset = 0").groupBy(F.lit(turn).alias("round"), part.alias("part"))
        bounds.append(firsts.agg(F.count("*").alias("sequences"), F.max("bound").alias("bound"), F.count_if("open").alias("given_up")))
        count, closed_now, left_now = packed.agg(
            F.count_if(F.col("offset") == 0), F.count_if((F.col("offset") == 0) & ~F.col("open")), F.count_if("open")
        ).first()
        shown = ["row", "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
        if parts == 1 or closed + count <= bound or turn == ROUNDS - 1:
            done.append(packed.select(shown))
            break
        done.append(packed.where(~F.col("open")).select(shown))
        closed, left, todo = closed + closed_now, left_now, packed.where("open").select(cut.columns)
        if not left:
            break
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    whole = sum(r["count"] for r in sizes if r["length"] == length) + bound
    total = out.agg(F.count_if(F.col("offset") == 0).alias("sequences")).where("sequences > 0")
    total = total.select(F.lit(None).cast("int").alias("round"), F.lit(None).cast("long").alias("part"), "sequences", F.lit(float(whole)).alias("bound"), F.lit(0).cast("long").alias("given_up"))
    for table in bounds:
        total = total.unionByName(table)
    return out, total


def sequences(cut: DataFrame, packed: DataFrame) -> DataFrame:
    """The sequences themselves: sequence_id, doc_ids, lengths and ids (little-endian uint32), from written pieces with ``row`` and ``ids``.

    A sequence has at most ``length`` ids, so its group is bounded.
    """
    joined = packed.select("row", "sequence_id", "offset", "doc_id", "length").join(cut.select("row", "ids"), "row")
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "length", "ids")))
    return joined.groupBy("sequence_id").agg(parts.alias("p")).select(
        "sequence_id", F.col("p.doc_id").alias("doc_ids"), F.col("p.length").alias("lengths"), F.aggregate("p", F.lit(b""), lambda acc, x: F.concat(acc, x["ids"])).alias("ids")
    )
