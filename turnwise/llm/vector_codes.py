"""Vector codes: parts of vectors replaced by the number of their nearest codebook entry, in integers.

Rounds assign every part to its nearest entry and move the entries to the means of their parts. A round keeps, for each part, the entry it has,
the ``b`` next ones with a lower bound of their distance each, in order, and one outer bound for all others. When entries move, bounds fall by
as much. What no bound says may have come nearer stays; where only kept entries may have, these are compared in integers; where the outer
bound gives way, all entries are. ``b`` follows from how many kept entries the parts of the last round had to look at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from turnwise.llm.common import written

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
#: Kept entries per part: at first, at least and at most. One in ``FULL_SHARE`` parts may need more and is compared with all entries.
KEPT_FIRST, KEPT_LEAST, KEPT_MOST = 16, 4, 32
FULL_SHARE = 50
#: Rows whose parts are compared with all entries at a time.
_ROWS = 4096
#: Labels with at least this share of the rows are joined by broadcast (there are at most as many as the number), the others by a shuffle.
HOT_LABELS = 1000


@dataclass(frozen=True)
class Codebooks:
    """``entries``: int64 array (part, entry, place); ``drift``: how far each entry moved in the last round, rounded up."""

    entries: np.ndarray
    drift: np.ndarray | None = None

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def decode(self, code: str) -> np.ndarray:
        """The vector, in integers, that a code stands for."""
        return np.concatenate([part[number] for part, number in zip(self.entries, bytes.fromhex(code), strict=True)])

    def moved(self, sums: np.ndarray, counts: np.ndarray) -> Codebooks:
        """Every entry that has parts at the floor of their mean."""
        new = np.where(counts[..., None] > 0, sums // np.maximum(counts, 1)[..., None], self.entries)
        way = np.sqrt(((new - self.entries) ** 2).sum(axis=2, dtype=np.int64).astype(np.float64))
        return Codebooks(new, np.nextafter(way, np.inf))


def kept_vectors(vectors: DataFrame, vector: str) -> DataFrame:
    """The rows whose vector is there and holds neither nulls nor values that are not finite, with its components as ``ints``."""
    bad = F.exists(F.col(f"`{vector}`"), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    ints = F.transform(F.col(f"`{vector}`"), lambda x: F.floor(x.cast("double") * F.lit(float(SCALE))))
    return vectors.where(F.coalesce(~bad, F.lit(False))).withColumn("ints", ints)


def _nearest(points: np.ndarray, entries: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """For each point the ``count`` nearest entries, ties to the lower number, and their squared distances. Products and sums stay below 2^53,
    so floating-point products are exact."""
    products = (points.astype(np.float64) @ entries.T.astype(np.float64)).astype(np.int64)
    far = (points**2).sum(axis=1)[:, None] + (entries**2).sum(axis=1) - 2 * products
    key = far * ENTRIES + np.arange(len(entries))
    if count < len(entries):
        key = np.partition(key, count - 1, axis=1)[:, :count]
    key = np.sort(key, axis=1)
    return key % ENTRIES, key // ENTRIES


def _down(bound: np.ndarray) -> np.ndarray:
    """Lower bounds as float32, never above."""
    return np.where(np.isinf(bound), bound, np.nextafter(bound.astype(np.float32), np.float32(-np.inf))).astype(np.float32)


class PartState:
    """Entry, kept entries, their bounds and the outer bound of one part of many rows."""

    def __init__(self, code: np.ndarray, near: np.ndarray, low: np.ndarray, outer: np.ndarray) -> None:
        self.code, self.near, self.low, self.outer = code, near, low, outer

    @staticmethod
    def empty(rows: int) -> PartState:
        """Of rows that were never assigned: the outer bound says nothing."""
        return PartState(np.zeros(rows, np.uint8), np.empty((rows, 0), np.uint8), np.empty((rows, 0), np.float32), np.full(rows, -np.inf, np.float32))

    def assign(self, points: np.ndarray, entries: np.ndarray, drift: np.ndarray | None, b: int) -> np.ndarray:
        """Assign anew after the entries moved, keep ``b`` entries each, and return how many kept ones each row had to look at (more than it
        has: all entries)."""
        rows, had = self.near.shape
        b = min(b, len(entries) - 1)
        low, outer = self.low.astype(np.float64), self.outer.astype(np.float64)
        if drift is not None:
            low, outer = low - drift[self.near], outer - drift.max()
        own = np.sqrt(((points - entries[self.code]) ** 2).sum(axis=1).astype(np.float64)) * (1 + 1e-9)
        everything = outer <= own
        looked = np.where(everything, had + 1, (low <= own[:, None]).sum(axis=1))
        near = self.near
        some = np.flatnonzero(~everything & (looked > 0))
        if len(some):
            tried = np.hstack([self.code[some, None], near[some]]).astype(np.int64)
            far = ((points[some, None, :] - entries[tried]) ** 2).sum(axis=2)
            # A place without an entry repeats the part's own, with an endless bound; it must stay one.
            void = np.hstack([np.zeros((len(some), 1), bool), np.isinf(low[some])])
            key = np.where(void, np.iinfo(np.int64).max, far * ENTRIES + tried)
            key.sort(axis=1)
            void = key == np.iinfo(np.int64).max
            self.code[some] = key[:, 0] % ENTRIES
            near[some] = np.where(void, self.code[some, None], key % ENTRIES)[:, 1:]
            low[some] = np.where(void, np.inf, np.sqrt((key // ENTRIES).astype(np.float64)))[:, 1:]
        order = np.argsort(low, axis=1, kind="stable")
        near, low = np.take_along_axis(near, order, 1), np.take_along_axis(low, order, 1)
        if b < had:
            near, low, outer = near[:, :b], low[:, :b], np.minimum(outer, low[:, b])
        elif b > had:
            near = np.hstack([near, np.repeat(self.code[:, None], b - had, axis=1)])
            low = np.hstack([low, np.full((rows, b - had), np.inf)])
        for chunk in np.array_split(every := np.flatnonzero(everything), max(1, -(-len(every) // _ROWS))):
            if len(chunk):
                found, far = _nearest(points[chunk], entries, min(b + 2, len(entries)))
                self.code[chunk] = found[:, 0]
                near[chunk], low[chunk] = found[:, 1 : b + 1], np.sqrt(far[:, 1 : b + 1].astype(np.float64))
                outer[chunk] = np.sqrt(far[:, b + 1].astype(np.float64)) if b + 1 < len(entries) else np.inf
        self.near, self.low, self.outer = near, _down(low), _down(outer)
        return looked


def _blob(rows: np.ndarray) -> pa.Array:
    """One binary value per row."""
    width = rows.shape[1] * rows.itemsize
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


def _unblob(column: pa.Array, kind: str) -> np.ndarray:
    offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4)
    held = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return np.frombuffer(held.tobytes(), kind).reshape(len(column), -1)


def _kept_columns(state: DataFrame) -> list[StructField]:
    return [f for f in state.schema.fields if f.name in ("vec_id", "label")]


def _read_state(batch: pa.RecordBatch, b: int, kind: str) -> tuple[np.ndarray, list[PartState]]:
    points = _unblob(batch.column("ints"), kind).astype(np.int64)
    if "near" not in batch.schema.names:
        return points, [PartState.empty(batch.num_rows) for _ in range(PARTS)]
    near = _unblob(batch.column("near"), "u1").reshape(batch.num_rows, PARTS, 1 + b)
    low = _unblob(batch.column("low"), "<f4").reshape(batch.num_rows, PARTS, b + 1)
    return points, [PartState(near[:, p, 0].copy(), near[:, p, 1:].copy(), low[:, p, :-1], low[:, p, -1]) for p in range(PARTS)]


def _assign_round(books: Codebooks, had: int, b: int, kind: str):
    """From batches of the state to batches of the next state, and a last row with the task's sums, counts and looks."""
    parts, entries, width = books.entries.shape
    bins = KEPT_MOST + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((parts, entries, width), np.int64)
        counts = np.zeros((parts, entries), np.int64)
        looks = np.zeros(bins, np.int64)
        empty = None
        for batch in batches:
            if not batch.num_rows:
                continue
            points, states = _read_state(batch, had, kind)
            for p, state in enumerate(states):
                part = points[:, p * width : (p + 1) * width]
                looked = state.assign(part, books.entries[p], None if books.drift is None else books.drift[p], b)
                looks += np.bincount(np.minimum(looked, bins - 1), minlength=bins)
                counts[p] += np.bincount(state.code, minlength=entries)
                for k in range(width):
                    sums[p, :, k] += np.bincount(state.code, weights=part[:, k], minlength=entries).astype(np.int64)
            near = np.hstack([np.hstack([s.code[:, None], s.near]) for s in states])
            low = np.hstack([np.hstack([s.low, s.outer[:, None]]) for s in states])
            carried = [batch.column(c) for c in ("vec_id", "label")]
            none = pa.nulls(batch.num_rows, pa.list_(pa.int64()))
            made = pa.RecordBatch.from_arrays([*carried, batch.column("ints"), _blob(near), _blob(low), none], names=names)
            empty = empty or [pa.nulls(1, c.type) for c in made.columns[:-1]]
            yield made
        if empty:
            task = np.concatenate([sums.ravel(), counts.ravel(), looks])
            yield pa.RecordBatch.from_arrays([*empty, pa.array([task], pa.list_(pa.int64()))], names=names)

    names = ["vec_id", "label", "ints", "near", "low", "task"]
    return run


def _final(books: Codebooks, had: int, kind: str):
    """From batches of the state to codes and errors."""
    width = books.entries.shape[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            points, states = _read_state(batch, had, kind)
            error = np.zeros(batch.num_rows, np.int64)
            for p, state in enumerate(states):
                part = points[:, p * width : (p + 1) * width]
                state.assign(part, books.entries[p], None if books.drift is None else books.drift[p], KEPT_LEAST)
                error += ((part - books.entries[p][state.code]) ** 2).sum(axis=1)
            codes = np.stack([s.code for s in states], axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), pa.array([row.tobytes().hex() for row in codes], pa.string()), pa.array(error)],
                names=["vec_id", "label", "code", "error"],
            )

    return run


def _to_state(kind: str):
    """From batches of integer arrays to batches of the first state, without bounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ints = batch.column("ints").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).astype(kind)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), _blob(ints)], names=["vec_id", "label", "ints"])

    return run


def _next_kept(looks: np.ndarray, had: int) -> int:
    """The least number of kept entries that all but one in ``FULL_SHARE`` parts would have managed with."""
    total = looks.sum()
    enough = np.flatnonzero(np.cumsum(looks) * FULL_SHARE >= total * (FULL_SHARE - 1))
    wanted = int(enough[0]) if len(enough) else KEPT_MOST
    return min(KEPT_MOST, max(KEPT_LEAST, 2 * had if wanted > had else wanted))


def compress(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", rounds: int = ROUNDS, parts: int = PARTS) -> tuple[DataFrame, Codebooks | None]:
    """The codes of all vectors (vec_id, label, code, error), and the codebooks (None if no vector is kept, with an empty table).

    The codebooks start as the parts of the ``ENTRIES`` vectors with the smallest ids (null ids last, equal ids by their components; fewer
    vectors make fewer entries). Rows whose vector is null or holds nulls or values that are not finite are left out; repeated rows each
    count. Vectors must have one length, a multiple of the parts, and squared distances of parts below 2^54: anything else raises
    ValueError. Each round's state is a table in the shared folder, with one row of sums per task, which Spark adds up; only those
    sums, as many as the codebooks have numbers, come to the driver.
    """
    columns = [F.col(f"`{vec_id}`").alias("vec_id"), F.col(f"`{label}`").alias("label"), F.col(f"`{vector}`").alias("vector")]
    given = kept_vectors(vectors.select(*columns), "vector").drop("vector")
    largest = F.coalesce(F.array_max(F.transform("ints", lambda x: F.abs(x.cast("double")))), F.lit(0.0))
    shape = given.agg(F.min(F.size("ints")), F.max(F.size("ints")), F.max(largest)).first()
    out = StructType([*_kept_columns(given), *StructType.fromDDL("code string, error long").fields])
    if shape[0] is None:
        return given.sparkSession.createDataFrame([], out), None
    if shape[0] != shape[1] or shape[0] % parts:
        raise ValueError(f"vectors of one length are needed, a multiple of {parts}; found {shape[0]} to {shape[1]}")
    width = shape[0] // parts
    if max(1, width) * (2 * shape[2]) ** 2 >= 1 << 54:
        raise ValueError(f"components of at most {2**26 / max(1, width) ** 0.5:.0f} in integers are needed; found {shape[2]:.0f}")
    kind = "<i2" if shape[2] < 1 << 15 else "<i4"
    first = given.orderBy(F.col("vec_id").asc_nulls_last(), "ints").limit(ENTRIES).collect()
    start = np.array([r["ints"] for r in first], np.int64).reshape(len(first), parts, width).transpose(1, 0, 2)
    books, had, b = Codebooks(np.ascontiguousarray(start)), 0, min(KEPT_FIRST, len(first) - 1)
    kept = _kept_columns(given)
    state = given.mapInArrow(_to_state(kind), StructType([*kept, StructField("ints", BinaryType())]))
    schema = StructType([*kept, *StructType.fromDDL("ints binary, near binary, low binary, task array<long>").fields])
    for _ in range(rounds):
        table = written(state.mapInArrow(_assign_round(books, had, b, kind), schema), "codes")
        places = table.where("task IS NOT NULL").select(F.posexplode("task").alias("place", "n"))
        total = {r[0]: int(r[1]) for r in places.groupBy("place").agg(F.sum(F.col("n").cast("decimal(38,0)"))).collect()}
        flat = np.array([total[k] for k in range(len(total))], np.int64)
        sums, counts, looks = np.split(flat, np.cumsum([books.entries.size, books.entries[..., 0].size if width else parts * len(first)]))
        books = books.moved(sums.reshape(books.entries.shape), counts.reshape(books.entries.shape[:2]))
        state = table.where("task IS NULL").drop("task")
        had, b = b, min(_next_kept(looks, b), len(first) - 1)
    return state.mapInArrow(_final(books, had, kind), out), books


def with_label_error(codes: DataFrame) -> DataFrame:
    """Add the error summed over rows of equal labels (nulls together). Sums of the labels that many rows have, a bounded number, are broadcast;
    the others are joined by a shuffle, where no label is large."""
    codes = written(codes, "coded")
    sums = written(codes.groupBy("label").agg(F.sum("error").cast("long").alias("label_error"), F.count("*").alias("n")), "label-errors")
    total = sums.agg(F.sum("n")).first()[0] or 0
    hot = sums.where(F.col("n") * HOT_LABELS >= total).select(F.col("label").alias("hot"), F.col("label_error").alias("hot_error"))
    cold = sums.where(F.col("n") * HOT_LABELS < total).select(F.col("label").alias("cold"), F.col("label_error").alias("cold_error"))
    found = codes.join(F.broadcast(hot), F.col("label").eqNullSafe(F.col("hot")), "left")
    rest = found.where("hot_error IS NULL").join(cold, F.col("label").eqNullSafe(F.col("cold")))
    columns = codes.columns
    return found.where("hot_error IS NOT NULL").select(*columns, F.col("hot_error").alias("label_error")).unionAll(rest.select(*columns, F.col("cold_error").alias("label_error")))
