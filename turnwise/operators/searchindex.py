"""Search for text without reading every row: postings of three-letter pieces beside the saved rows.

A row's pieces are those of its lower-cased columns, of letters that follow each other in one text. For each piece and block of ids the index holds the sorted ids, which Parquet packs as differences, so
a posting list is cut into bounded rows however common its piece is. A search reads the lists of the pieces that its text must contain, intersects
them block by block, opens only the blocks of rows that are left, and checks these rows as a plain search does.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator, Sequence
from datetime import datetime

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise.errors import AnalyticsError
from turnwise.operators.querylog import search

# Workers need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

GRAM = 3
#: Ids in a block of rows and of postings.
BLOCK_IDS = 1 << 16
#: Bytes of text whose pieces are listed at a time.
PIECE_BYTES = 1 << 22
#: Pieces that are looked up; rows that hold these but not the whole text fall out in the check.
LOOKED_UP = 16
#: Blocks that are named in the filter on the rows; of more, all are opened that the join asks for.
NAMED_BLOCKS = 10_000

_BLOCK, _GRAMS, _IDS, _ID = "__tw_block", "__tw_gram", "__tw_ids", "__tw_id"

#: Letters whose lower case depends on what stands beside them, or differs between libraries.
_UNSURE = set("\u03c3\u03c2\u0130\u0131\u0307")


def needed_pieces(text: str) -> list[str]:
    """Pieces that any match of a search text holds: those of its parts between wildcards."""
    parts = re.split("[%_]", text.lower())
    found = {part[k : k + GRAM] for part in parts for k in range(len(part) - GRAM + 1)}
    return sorted(piece for piece in found if not _UNSURE & set(piece))


def _block(key: str) -> Column:
    return F.floor(F.col(f"`{key}`") / F.lit(BLOCK_IDS)).cast("bigint")


def save_search_index(df: DataFrame, columns: Sequence[str], key: str, directory: str) -> None:
    """Write rows and postings to a place that does not exist yet. ``key`` holds integers of 0 or more, unique and without NULL."""
    bad = df.agg(F.count_if(F.col(f"`{key}`").isNull() | (F.col(f"`{key}`") < 0)).alias("bad"), F.count("*").alias("n"), F.count_distinct(f"`{key}`").alias("ids")).first()
    if bad["bad"] or bad["n"] != bad["ids"]:
        raise AnalyticsError("SEARCH_KEY_INVALID", "the key of a search index must be unique, not NULL and not negative", {"column": key})
    rows = df.withColumn(_BLOCK, _block(key)).hint("rebalance", _BLOCK)
    rows.write.mode("errorifexists").partitionBy(_BLOCK).parquet(f"{directory}/rows")
    # From the saved rows, which lie block by block: a task meets many rows of few blocks, so it has few and long lists to shuffle.
    saved = df.sparkSession.read.schema(rows.schema).parquet(f"{directory}/rows")
    lowered = [F.lower(F.col(f"`{c}`").cast("string")).alias(f"text{k}") for k, c in enumerate(columns)]
    own = saved.select(F.col(_BLOCK), (F.col(f"`{key}`") % BLOCK_IDS).cast("int").alias(_ID), *lowered)
    short = own.mapInArrow(_short_lists, f"{_GRAMS} string, {_BLOCK} bigint, {_IDS} array<int>")
    lists = short.groupBy(_GRAMS, _BLOCK).agg(F.sort_array(F.flatten(F.collect_list(_IDS))).alias(_IDS))
    # Sorted by piece, so a search skips the parts of a file that cannot hold its pieces.
    dealt = lists.repartitionByRange(F.col(_GRAMS), F.col(_BLOCK)).sortWithinPartitions(_GRAMS, _BLOCK)
    packed = {"compression": "zstd", "parquet.writer.version": "PARQUET_2_0", f"parquet.enable.dictionary#{_IDS}.list.element": "false"}
    dealt.write.mode("errorifexists").options(**packed).parquet(f"{directory}/postings")


def _short_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lists of (block, id, lower-cased texts), each over rows with about ``PIECE_BYTES`` of text."""
    for batch in batches:
        step = max(1, int(batch.num_rows * PIECE_BYTES / max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, step):
            yield from _lists_of(batch.slice(at, step))


def _lists_of(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """One row for each three-letter piece and block, with the sorted ids of the rows that hold the piece in a text."""
    rows = rows.take(pc.sort_indices(rows, [(_BLOCK, "ascending"), (_ID, "ascending")]))
    blocks, ids = (rows.column(rows.schema.names.index(name)).to_numpy() for name in (_BLOCK, _ID))
    texts = [text or "" for column in rows.columns[2:] for text in column.to_pylist()]
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    place = np.repeat(np.arange(len(texts)), np.fromiter(map(len, texts), np.int64, len(texts)))
    known = np.zeros(sys.maxunicode + 1, bool)
    known[codes] = True
    letters = np.flatnonzero(known)
    n, size = rows.num_rows, len(letters)
    if n * size**3 >= 1 << 63:  # many rows and a large alphabet: a piece and its row would not fit into one number
        yield from _lists_of(rows.slice(0, n // 2))
        yield from _lists_of(rows.slice(n // 2))
        return
    if len(codes) < GRAM:
        return
    letter = (np.cumsum(known) - 1)[codes]
    whole = place[: 1 - GRAM] == place[GRAM - 1 :]  # all letters from one text
    held = ((letter[:-2] * size + letter[1:-1]) * size + letter[2:])[whole] * n + place[: 1 - GRAM][whole] % n
    if not len(held):
        return
    held.sort()
    grams, row = np.divmod(held[np.concatenate([[True], held[1:] != held[:-1]])], n)
    first = np.flatnonzero(np.concatenate([[True], (grams[1:] != grams[:-1]) | (blocks[row[1:]] != blocks[row[:-1]])]))
    spelled = letters[np.stack([grams[first] // size**2, grams[first] // size % size, grams[first] % size], axis=1)].astype("<u4").tobytes().decode("utf-32-le")
    lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(row)), pa.int32()), pa.array(ids[row], pa.int32()))
    names = pa.array([spelled[at : at + GRAM] for at in range(0, len(spelled), GRAM)], pa.string())
    yield pa.RecordBatch.from_arrays([names, pa.array(blocks[row[first]], pa.int64()), lists], names=[_GRAMS, _BLOCK, _IDS])


def search_index(
    spark: SparkSession,
    directory: str,
    columns: Sequence[str],
    key: str,
    text: str | None = None,
    equals: dict[str, object] | None = None,
    expires: str | None = None,
    now: datetime | None = None,
) -> DataFrame:
    """The rows that ``search`` finds in the saved table, with the same meaning of all arguments.

    A text whose parts between wildcards are all shorter than three letters is searched in all rows.
    """
    rows = spark.read.parquet(f"{directory}/rows")
    found = rows
    needed = _rarest_first(spark, directory, needed_pieces(text or ""))
    if needed:
        candidates = _candidates(spark, directory, needed)
        blocks = [r[0] for r in candidates.select(_BLOCK).distinct().limit(NAMED_BLOCKS + 1).collect()]
        if len(blocks) <= NAMED_BLOCKS:
            found = found.where(F.col(_BLOCK).isin(blocks))
        place = (F.col(f"`{key}`") % BLOCK_IDS).cast("int") == F.col(_ID)
        found = found.join(candidates.withColumnRenamed(_BLOCK, _BLOCK + "_"), (F.col(_BLOCK) == F.col(_BLOCK + "_")) & place, "left_semi")
    return search(found, columns, text, equals, expires, now).drop(_BLOCK)


def _postings(spark: SparkSession, directory: str, grams: Sequence[str]) -> DataFrame:
    return spark.read.parquet(f"{directory}/postings").where(F.col(_GRAMS).isin(list(grams)))


def _rarest_first(spark: SparkSession, directory: str, grams: list[str]) -> list[str]:
    """At most ``LOOKED_UP`` of the pieces, those in the fewest rows; sizes are read only where there are more."""
    if len(grams) <= LOOKED_UP:
        return grams
    sizes = _postings(spark, directory, grams).groupBy(_GRAMS).agg(F.sum(F.size(_IDS)).alias("n"))
    counted = {r[0]: r["n"] for r in sizes.collect()}  # a row per piece of the search text
    return sorted(grams, key=lambda g: (counted.get(g, 0), g))[:LOOKED_UP]


def _candidates(spark: SparkSession, directory: str, grams: list[str]) -> DataFrame:
    """(block, id) of the rows that hold all of the pieces. A block has a bounded list for each."""
    # The shortest list first, so that what is compared with the others is small.
    lists = _postings(spark, directory, grams).groupBy(_BLOCK).agg(F.sort_array(F.collect_list(F.struct(F.size(_IDS).alias("n"), F.col(_IDS).alias("ids")))).alias(_IDS))
    lists = lists.where(F.size(_IDS) == len(grams))
    shared = F.aggregate(F.slice(_IDS, 2, len(grams)), F.get(F.col(_IDS), F.lit(0))["ids"], lambda left, more: F.array_intersect(left, more["ids"]))
    return lists.select(_BLOCK, F.explode(shared).alias(_ID))
