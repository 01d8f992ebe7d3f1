"""Token files: an id array over many documents, with Elias-Fano encoded bounds.

A file is a Parquet table whose rows are blocks of whole documents. A block holds

* ``doc_ids``: the documents in order, and ``before``: the ids of the shard's earlier blocks,
* ``ids``: their token ids one after the other, as little-endian unsigned integers of ``id_bytes`` bytes,
* ``bounds``: where each document ends, as an Elias-Fano sequence: the low bits of each end packed side by side, the high bits in unary as
  one bit vector, and the place of every ``SAMPLE``-th one-bit of that vector, from which ``select`` starts.

So a bound takes about 2 + log2(ids per document) bits, and a document is found without decoding the others.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnwise.llm.common import let_go
from turnwise.llm.tokens import VOCABULARY, encoder

SAMPLE = 64
#: Ids after which a block is closed; a longer document is a block of its own.
BLOCK_IDS = 1 << 20
BLOCKS = "shard int, block int, before long, id_bytes int, doc_ids array<long>, n_docs int, n_ids long, low_bits int, low binary, high binary, samples binary, ids binary"


class EliasFano:
    """A non-descending sequence of ``n`` integers from 0 to ``most``."""

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, samples: bytes) -> None:
        self.n, self.low_bits, self.low, self.high = n, low_bits, low, high
        self.samples = np.frombuffer(samples, "<u4")

    @staticmethod
    def encode(values: np.ndarray) -> tuple[int, bytes, bytes, bytes]:
        """Low bits per value, the packed low bits, the high bits, the samples."""
        n, most = len(values), int(values[-1]) if len(values) else 0
        low_bits = max(0, int(most // max(1, n)).bit_length() - 1)
        low = (values[:, None] >> np.arange(low_bits)) & 1
        ones = (values >> low_bits) + np.arange(n)
        high = np.zeros((int(ones[-1]) if n else 0) + 1, np.uint8)
        high[ones] = 1
        pack = lambda bits: np.packbits(bits, bitorder="little").tobytes()
        return low_bits, pack(low.astype(np.uint8).ravel()), pack(high), ones[::SAMPLE].astype("<u4").tobytes()

    def select(self, k: int) -> int:
        """The k-th value: from the nearest sample on, eight bytes of the high bits at a time, and the bits of one packed low part."""
        place, missing = int(self.samples[k // SAMPLE]), k % SAMPLE
        byte = place >> 3
        word = int.from_bytes(self.high[byte : byte + 8], "little") >> (place & 7)
        while (ones := word.bit_count()) <= missing:
            missing, byte = missing - ones, byte + 8
            place, word = byte << 3, int.from_bytes(self.high[byte : byte + 8], "little")
        for _ in range(missing):
            word &= word - 1
        one, bit = place + (word & -word).bit_length() - 1, k * self.low_bits
        low = int.from_bytes(self.low[bit >> 3 : (bit + self.low_bits + 7) >> 3], "little") >> (bit & 7)
        return (one - k) << self.low_bits | low & ((1 << self.low_bits) - 1)


def block_of(row: dict) -> EliasFano:
    return EliasFano(row["n_docs"], row["low_bits"], row["low"], row["high"], row["samples"])


def document_ids(row: dict, k: int) -> np.ndarray:
    """The ids of the k-th document of a block, by two selects."""
    ends = block_of(row)
    first = ends.select(k - 1) if k else 0
    width = row["id_bytes"]
    return np.frombuffer(row["ids"], f"<u{width}")[first : ends.select(k)]


def _write_blocks(vocabulary: str, end_id: int, block_ids: int, special_as_text: bool):
    """From Arrow batches of (doc_id, text) in order to blocks; the task's number is the shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, count, before = TaskContext.get().partitionId(), 0, 0
        encode = encoder(vocabulary, special_as_text)
        width = 2 if max(encode.tokenizer.get_vocab_size() - 1, end_id) < 1 << 16 else 4
        end = np.array([end_id], f"<u{width}")
        docs: list = []
        ids: list = []
        ends: list = []
        total = 0

        def block() -> pa.RecordBatch:
            bits, low, high, samples = EliasFano.encode(np.array(ends, np.int64))
            values = (shard, count, before, width, docs, len(docs), total, bits, low, high, samples, b"".join(ids))
            return pa.RecordBatch.from_pylist([dict(zip(schema.names, values, strict=True))], schema=schema)

        for batch in batches:
            done = 0
            for found, bounds in encode.encode(batch.column(1)):
                found = found.astype(f"<u{width}")
                for doc, first, after in zip(batch.column(0).slice(done, len(bounds) - 1).to_pylist(), bounds[:-1], bounds[1:], strict=True):
                    if docs and total + after - first + 1 > block_ids:
                        yield block()
                        before, count = before + total, count + 1
                        docs, ids, ends, total = [], [], [], 0
                    docs.append(doc)
                    ids += (found[first:after].tobytes(), end.tobytes())
                    total += int(after - first) + 1
                    ends.append(total)
                done += len(bounds) - 1
        if docs:
            yield block()
        let_go()

    schema = pa.schema(
        [("shard", pa.int32()), ("block", pa.int32()), ("before", pa.int64()), ("id_bytes", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("n_docs", pa.int32()), ("n_ids", pa.int64())]
        + [("low_bits", pa.int32()), ("low", pa.binary()), ("high", pa.binary()), ("samples", pa.binary()), ("ids", pa.binary())]
    )
    return run


def write_token_files(
    docs: DataFrame,
    path: str,
    vocabulary: str = VOCABULARY,
    end_id: int = 2,
    doc_id: str = "doc_id",
    text: str = "text",
    shards: int | None = None,
    block_ids: int = BLOCK_IDS,
    special_as_text: bool = True,
) -> None:
    """Write the ids of all texts, each followed by ``end_id``, in ascending order of ``doc_id`` (an integer; nulls first; rows with equal
    ids in the order of a hash of their texts; a ``doc_id`` that is no integer is cast to one), one file per shard. A null text is empty; an
    empty table gives files without blocks. Special tokens that stand in a text are ordinary text, or (``special_as_text`` off) what
    the library makes of them. Only the two columns are read.
    """
    spark = docs.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    given = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    dealt = given.repartitionByRange(shards, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    blocks = dealt.mapInArrow(_write_blocks(vocabulary, end_id, block_ids, special_as_text), BLOCKS)
    blocks.write.option("compression", "zstd").parquet(path)


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BLOCKS).parquet(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Each document in the files: where it starts among all ids, how many it has, and the checksum of its ids as uint32.

    Shards follow one another, and blocks within a shard. Only a row per shard is summed up for that (and sent to the tasks: there are
    as many shards as the writer had tasks); the ids are read in their files' tasks.
    """
    blocks = read_blocks(spark, path)
    sizes = blocks.groupBy("shard").agg(F.sum("n_ids").alias("size"))
    earlier = F.sum("size").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("shard", F.coalesce(earlier, F.lit(0)).alias("shard_start"))
    located = blocks.join(F.broadcast(starts), "shard").withColumn("start", F.col("shard_start") + F.col("before"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                ids = np.frombuffer(row["ids"], f"<u{row['id_bytes']}").astype("<u4")
                bounds = block_of(row)
                ends = [bounds.select(place) for place in range(bounds.n)]
                firsts = [0, *ends[:-1]]
                sums = [zlib.crc32(ids[a:b]) for a, b in zip(firsts, ends, strict=True)]
                starts_here = [row["start"] + first for first in firsts]
                sizes_here = [after - first for first, after in zip(firsts, ends, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), *(pa.array(x, pa.int64()) for x in (starts_here, sizes_here, sums))],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return located.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
