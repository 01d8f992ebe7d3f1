"""What several operators need: shared folders, written tables, Arrow batches, worker-side caches."""

from __future__ import annotations

import ctypes
import sys
import types
from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from turnwise.sources.shared import fresh_path, shared_dir  # noqa: F401  (shared_dir is for callers of this module)

def fresh_name(taken: Iterable[str], name: str) -> str:
    """``name``, or it with as many underscores as make it differ from the names that are taken."""
    known = {t.lower() for t in taken}
    while name.lower() in known:
        name += "_"
    return name


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table in the shared folder and read it back: cuts the lineage, survives lost executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add costly columns that are computed once per row.

    Filters, also those that Spark infers from ``explode``, would otherwise be pushed below the projection, with the whole expression in the
    place of the column, inside lambdas even once per element. A generator that makes one row holds them up.
    """
    made = F.struct(*[column.alias(name) for name, column in columns.items()])
    kept = [F.col(f"`{c}`") for c in df.columns if c not in columns]
    return df.select(*kept, F.explode(F.array(made)).alias("__once")).select(*kept, *[F.col(f"__once.{name}").alias(name) for name in columns])


def let_go() -> None:
    """Give freed memory back to the system. Workers outlive their tasks: what Arrow and the C library keep for later stands beside the
    executor's heap through all stages that follow."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if sys.platform == "linux" else None
    if trim is not None:  # glibc
        trim(0)


def bounded(batches: Iterable[pa.RecordBatch], batch_bytes: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of about so many bytes, or one row; behind the last one, freed memory goes back."""
    for batch in batches:
        step = max(1, int(batch.num_rows * batch_bytes / max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)
    batch = None
    let_go()


def map_rows(
    df: DataFrame,
    make: Callable[[], Callable[..., Iterable[tuple]]],
    schema: str,
    carry: Sequence[str] = (),
    batch_bytes: int = 1 << 22,
) -> DataFrame:
    """Add columns computed in Python, in bounded pieces.

    ``make`` runs once per task and gives a function from the lists of the columns that are not carried (texts as UTF-8 bytes) to one
    tuple of new values per row. ``carry`` columns pass as they are. Batches are cut so that about ``batch_bytes`` of input become Python
    objects at a time.
    """
    added = _parse_datatype_string(schema)
    result = StructType([*(df.schema[c] for c in carry), *added.fields])
    types_added = [f.type for f in to_arrow_schema(added)]
    names = [f.name for f in result.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for piece in bounded(batches, batch_bytes):
            yield pa.RecordBatch.from_arrays(_columns(piece, work), names=names)

    def _columns(piece: pa.RecordBatch, work) -> list[pa.Array]:
        kept, given = [], []
        for name, column in zip(piece.schema.names, piece.columns, strict=True):
            if name in carry:
                kept.append((carry.index(name), column))
            else:
                given.append((column.cast(pa.binary()) if pa.types.is_string(column.type) else column).to_pylist())
        rows = list(work(*given))
        made = [pa.array([row[k] for row in rows], type=kind) for k, kind in enumerate(types_added)]
        return [column for _, column in sorted(kept, key=lambda x: x[0])] + made

    return df.mapInArrow(run, result)


def keep_rows(df: DataFrame, make: Callable[[], Callable[[list], list[bool]]], column: str = "text") -> DataFrame:
    """The rows for which the function that ``make`` gives says so, which is asked in bounded pieces; all columns stay as they are, whatever
    their names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for piece in bounded(batches):
            given = piece.column(piece.schema.names.index(column)).cast(pa.binary())
            yield piece.filter(pa.array(work(given.to_pylist()), type=pa.bool_()))

    return df.mapInArrow(run, df.schema)


def worker_cache(name: str) -> dict:
    """A dict that lives as long as the Python worker and is shared by its tasks."""
    holder = sys.modules.setdefault("_turnwise_worker_cache", types.ModuleType("_turnwise_worker_cache"))
    return holder.__dict__.setdefault(name, {})
