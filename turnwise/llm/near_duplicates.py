"""Near-duplicate groups by one-permutation hashing with optimal densification and star-shaped candidate links.

1. The set of a text: hashes of its distinct 5-word shingles. Rows with equal sets are collapsed to the row with the smallest id.
2. One permutation, ``BANDS * ROWS`` bins: a bin holds the smallest hash that falls into it; an empty bin takes the value of another one,
   which a random order of its own picks (optimal densification). ``ROWS`` bins make a band; equal bands share a bucket.
3. Candidate links are stars: each member of a bucket with the bucket's smallest id, so a bucket of n members makes n - 1 links. They are
   confirmed on whole sets.
4. A star can miss a link between two members of which one is not like the centre. So members are compared in blocks of bounded size, each
   block against each, but only where that can matter: (a) where groups that candidates of at least ``RELATED`` percent relate are still
   apart, all members outside the largest group with all; (b) in a bucket, members below that with all members below ``LOOSE`` percent
   (the triangle inequality rules out the others: the distance 1 - similarity to the centre differs by 0.25 at most).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.llm.common import bounded, fresh_name, map_rows, written
from turnwise.llm.components import components
from turnwise.operators.positions import SortKey
from turnwise.operators.shape import number_rows

SHINGLE = 5
#: Percent of the union that the intersection must reach.
SIMILAR = 75
#: Two sets of that similarity share no bucket with probability (1 - 0.75 ** ROWS) ** BANDS = 4e-6.
BANDS, ROWS = 64, 6
#: Percent from which an unconfirmed candidate relates two groups in step 4; a member below it can only be similar to members below LOOSE.
RELATED, LOOSE = 40, 65
#: Members of a star compared in one group, and shingles on one side of a block.
STAR_MEMBERS, BLOCK_SHINGLES = 2_000, 400_000
#: Ids up to which a list of ids is broadcast (a few ten MB); beyond that it is joined by a shuffle.
BROADCAST_ROWS = 400_000
SIGNATURE = "n_shingles long, print1 long, print2 long, bands array<long>"


def shingle_set(text: bytes | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text; fewer words than ``size`` are one shingle, no words none."""
    import xxhash

    words = (text or b"").lower().split()  # bytes: ASCII letters and ASCII white space only
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - size + 1)
    digest = xxhash.xxh3_64_intdigest
    hashes = [digest(joined[a:b]) for a, b in zip(starts[:n].tolist(), ends[min(size, len(words)) - 1 :].tolist(), strict=True)]
    return np.unique(np.array(hashes, np.uint64))


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Signer:
    def __init__(self, bands: int = BANDS, rows: int = ROWS) -> None:
        self.bands, self.rows, self.bins = bands, rows, bands * rows
        self.order = _mixed(np.arange(self.bins**2, dtype=np.uint64) + np.uint64(1)).reshape(self.bins, self.bins)
        self.factors = _mixed(np.arange(rows, dtype=np.uint64) + np.uint64(7)) | np.uint64(1)
        self.names = _mixed(np.arange(bands, dtype=np.uint64) + np.uint64(1 << 40))

    def keys(self, hashes: np.ndarray) -> np.ndarray:
        """The bucket keys of a set that is not empty; ``hashes`` ascend, so the first one in a bin is its smallest."""
        place = (hashes >> np.uint64(32)) * np.uint64(self.bins) >> np.uint64(32)
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        filled = place[first].astype(np.int64)
        values = np.zeros(self.bins, np.uint64)
        values[filled] = hashes[first]
        empty = np.setdiff1d(np.arange(self.bins), filled, assume_unique=True)
        if len(empty):
            values[empty] = hashes[first[self.order[np.ix_(empty, filled)].argmin(axis=1)]]
        return _mixed((values.reshape(self.bands, self.rows) * self.factors).sum(axis=1, dtype=np.uint64) ^ self.names).view(np.int64)


def signatures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row its id, the size and a 128-bit print of its set, and its bucket keys (none for the empty set)."""

    def make():
        signer = Signer()

        def work(texts):
            for text in texts:
                found = shingle_set(text)
                prints = np.frombuffer(hashlib.blake2b(found.tobytes(), digest_size=16).digest(), "<i8").tolist()
                yield len(found), *prints, signer.keys(found).tolist() if len(found) else []

        return work

    given = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return map_rows(given, make, SIGNATURE, carry=["doc_id"])


def _small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has been counted to be within the bound."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def _with_texts(docs: DataFrame, roles: DataFrame) -> DataFrame:
    """The texts of the rows in ``roles``, by doc_id."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return texts.join(_small(roles), "doc_id")


def _overlap(a: np.ndarray, b: np.ndarray) -> int:
    """The size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    places = np.searchsorted(b, a)
    places[places == len(b)] = 0
    return int((b[places] == a).sum()) if len(b) else 0


def _compare_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by star, centre first; only the centre's sets are kept in memory (several if rows share its id)."""
    star, centres = None, []
    for batch in bounded(batches):
        out: dict[str, list] = {"centre": [], "node": [], "inter": [], "union": []}
        columns = [batch.column(batch.schema.names.index(c)).to_pylist() for c in ("centre", "salt", "member", "doc_id", "text")]
        for centre, salt, member, node, text in zip(*columns, strict=True):
            if star != (centre, salt):
                star, centres = (centre, salt), []
            found = shingle_set(text)
            if not member:
                if not any(np.array_equal(found, known) for known in centres):
                    centres.append(found)
                continue
            best = max(((_overlap(found, known), len(found) + len(known)) for known in centres), key=lambda x: x[0] / max(1, x[1] - x[0]), default=(0, 1))
            for name, value in zip(out, (centre, node, best[0], best[1] - best[0]), strict=True):
                out[name].append(value)
        yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in out.values()], names=list(out))


def _confirm(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """(centre, node) with the sizes of the intersection and the union of their sets; large stars are cut into salted parts."""
    parts = pairs.groupBy("centre").agg(F.ceil(F.count("*") / F.lit(STAR_MEMBERS)).cast("int").alias("parts"))
    members = pairs.join(parts, "centre").select(F.col("node").alias("doc_id"), "centre", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("salt"), F.lit(True).alias("member"))
    centres = parts.select(F.col("centre").alias("doc_id"), "centre", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"), F.lit(False).alias("member"))
    roles = written(members.unionByName(centres), "roles")
    rows = _with_texts(docs, roles).repartition("centre", "salt").sortWithinPartitions("centre", "salt", "member")
    found = rows.mapInArrow(_compare_stars, "centre long, node long, inter long, union long")
    return found.groupBy("centre", "node").agg(F.max(F.struct((F.col("inter") / F.col("union")).alias("share"), "inter", "union")).alias("best")).select("centre", "node", "best.inter", "best.union")


def _stars(buckets: DataFrame) -> DataFrame:
    """(key, centre, node) for the members of each bucket (key, node) other than its smallest. The smallest is found by an aggregate that
    combines before the shuffle, and joined back, so that adaptive execution can split a bucket of very many members."""
    centre = buckets.groupBy("key").agg(F.min("node").alias("centre"), F.max("node").alias("last")).where("centre <> last").select("key", "centre")
    return buckets.join(centre, "key").where("node <> centre")


def _compare_block(table: pa.Table) -> pa.Table:
    """Links between different groups among the rows of one block, one for each two groups that they join."""
    rows = table.to_pydict()
    sets = [shingle_set(text) for text in rows["text"]]
    group, left = np.array(rows["component"]), np.array(rows["left_side"])
    joined: dict[int, int] = {}

    def root(x: int) -> int:
        while joined.setdefault(x, x) != x:
            joined[x] = joined[joined[x]]
            x = joined[x]
        return x

    sizes = np.array([len(s) for s in sets])
    universe, codes = np.unique(np.concatenate(sets), return_inverse=True)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    found: list[tuple[int, int]] = []
    marked = np.zeros(len(universe), np.int32)
    for k in np.flatnonzero(left):
        own = codes[bounds[k] : bounds[k + 1]]
        marked[own] = 1
        inter = np.add.reduceat(marked[codes], bounds[:-1])
        marked[own] = 0
        similar = 100 * inter >= SIMILAR * (sizes + sizes[k] - inter)
        for other in np.flatnonzero(similar & (group != group[k])):
            a, b = root(int(group[k])), root(int(group[other]))
            if a != b:
                joined[a] = b
                found.append((int(group[k]), int(group[other])))
    return pa.table({"u": pa.array([a for a, _ in found], pa.int64()), "v": pa.array([b for _, b in found], pa.int64())})


def _blocks(members: DataFrame) -> DataFrame:
    """Deal members (cluster, component, doc_id, n_shingles, outside) out to blocks: chunks of those outside, each against every chunk."""
    size = lambda condition: F.sum(F.when(condition, F.col("n_shingles")).otherwise(0))
    chunks = lambda total: F.ceil(total / F.lit(BLOCK_SHINGLES)).cast("int")
    plan = members.groupBy("cluster").agg(chunks(size(~F.col("outside"))).alias("n_in"), chunks(size(F.col("outside"))).alias("n_out"))
    dealt = members.join(plan, "cluster")
    chunk = F.pmod(F.xxhash64("doc_id"), F.when(F.col("outside"), F.col("n_out")).otherwise(F.col("n_in"))).cast("int")
    dealt = dealt.withColumn("chunk", chunk)
    block = lambda a, b, side: F.struct(a.alias("a"), b.alias("b"), side.alias("left_side"))
    out = F.sequence(F.lit(0), F.col("n_out") - 1)
    within = F.transform(out, lambda x: block(F.least(x, F.col("chunk")), F.greatest(x, F.col("chunk")), F.lit(True)))
    across = F.when(F.col("n_in") > 0, F.transform(F.sequence(F.lit(0), F.greatest("n_in", F.lit(1)) - 1), lambda x: block(F.col("chunk"), F.col("n_out") + x, F.lit(True))))
    inside = F.transform(out, lambda x: block(x, F.col("n_out") + F.col("chunk"), F.lit(False)))
    places = F.when(F.col("outside"), F.concat(within, F.coalesce(across, F.slice(within, 1, 0)))).otherwise(inside)
    return dealt.select("doc_id", "cluster", "component", F.explode(places).alias("place")).select("doc_id", "cluster", "component", "place.*")


def _below(percent: int):
    return F.col("inter") * 100 < F.col("union") * percent


def _related_groups(confirmed: DataFrame, nodes: DataFrame) -> DataFrame:
    """Members of groups that candidates relate but that are apart (step 4a); outside: all but the largest group of each cluster."""
    group = lambda column, name: nodes.select(F.col("node").alias(column), F.col("component").alias(name))
    related = confirmed.where(~_below(RELATED) & _below(SIMILAR))
    apart = related.join(group("centre", "u"), "centre").join(group("node", "v"), "node").select("u", "v")
    clusters = components(apart).select(F.col("node").alias("component"), F.col("component").alias("cluster"))
    members = nodes.join(clusters, "component")
    sizes = members.groupBy("cluster", "component").agg(F.sum("n_shingles").alias("size"))
    largest = sizes.groupBy("cluster").agg(F.max(F.struct("size", "component")).alias("top")).select("cluster", F.col("top.component").alias("largest"))
    return members.join(largest, "cluster").withColumn("outside", F.col("component") != F.col("largest")).drop("largest")


def _loose_members(edges: DataFrame, confirmed: DataFrame, nodes: DataFrame) -> DataFrame:
    """Members of buckets that are not like their centre (step 4b), where they are of several groups; of buckets with the same such
    members, one."""
    loose = confirmed.where(_below(LOOSE)).select("centre", "node", _below(RELATED).alias("outside"))
    found = edges.join(loose, ["centre", "node"]).join(nodes, "node")
    one = found.groupBy("key").agg(
        F.max("outside").alias("any"), F.min("component").alias("low"), F.max("component").alias("high"),
        F.count("*").alias("n"), F.sum(F.xxhash64("node", "outside").cast("decimal(38,0)")).alias("print"),
    ).where("any AND low < high").groupBy("n", "print").agg(F.min("key").alias("key")).select("key")
    return found.join(one, "key").select(F.col("key").alias("cluster"), "node", "component", "n_shingles", "outside")


def _across(docs: DataFrame, edges: DataFrame, confirmed: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links that the stars missed, between groups (step 4)."""
    parts = []
    for kind, members in enumerate((_related_groups(confirmed, nodes), _loose_members(edges, confirmed, nodes))):
        dealt = _blocks(members.select(F.col("node").alias("doc_id"), "cluster", "component", "n_shingles", "outside"))
        parts.append(dealt.withColumn("kind", F.lit(kind)))
    blocks = written(parts[0].unionByName(parts[1]), "blocks")
    return _with_texts(docs, blocks).groupBy("kind", "cluster", "a", "b").applyInArrow(_compare_block, "u long, v long")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (the smallest id that links lead to) and kept (whether that is the row's own).

    Texts are linked if the intersection of their sets is at least 75 % of the union. Null or empty texts have no shingles and are linked with
    nothing. Rows that share an id are one document: a link of one holds for all. Rows without an id are linked with nothing, have no
    component and are kept. An empty table gives an empty result; only the two columns are read.
    """
    docs = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    signed = written(signatures(docs), "signatures")
    usable = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    nodes = written(usable.groupBy("print1", "print2", "n_shingles").agg(F.min(F.struct("doc_id", "bands")).alias("first")).select("print1", "print2", "n_shingles", F.col("first.doc_id").alias("node"), "first.bands"), "nodes")
    edges = written(_stars(nodes.select(F.explode("bands").alias("key"), "node")), "stars")
    confirmed = written(_confirm(docs, edges.select("centre", "node").distinct()), "confirmed")
    links = confirmed.where(~_below(SIMILAR)).select(F.col("centre").alias("u"), F.col("node").alias("v"))
    own = nodes.select("print1", "print2", "n_shingles", "node").join(components(links), "node", "left")
    own = written(own.withColumn("component", F.coalesce("component", "node")), "groups")
    across = written(_across(docs, edges, confirmed, own.select("node", "component", "n_shingles")), "across")
    further = components(across).select(F.col("node").alias("component"), F.col("component").alias("merged"))
    own = own.join(further, "component", "left").select("print1", "print2", "n_shingles", F.coalesce("merged", "component").alias("found"))
    # Rows with one id are one document, whichever sets they have.
    found = signed.drop("bands").join(own, ["print1", "print2", "n_shingles"], "left").withColumn("component_id", F.coalesce("found", "doc_id"))
    return found.select("doc_id", "n_shingles", "component_id", F.col("component_id").eqNullSafe(F.col("doc_id")).alias("kept"))


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """The documents with the smallest id of their group, with their columns, whatever these are called.

    Rows are judged by their texts: where ids repeat, rows are numbered by id and a hash of their text first, so of rows that share an id those
    with unlike texts stay, and of equal or similar texts the first. Null and empty texts are like nothing and stay, and so do rows without
    an id; an empty table gives an empty one.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id IS NOT NULL")
    if own.groupBy("doc_id").count().where("count > 1").isEmpty():
        return _kept(docs, "doc_id")
    number, print_, place = (fresh_name(docs.columns, name) for name in ("row_number", "text_hash", "any_order"))
    # Written before it is used, so that equal rows keep the order they were given.
    placed = written(docs.withColumns({print_: F.xxhash64("text"), place: F.monotonically_increasing_id()}), "placed")
    known = number_rows(placed.where("doc_id IS NOT NULL"), [SortKey(c) for c in ("doc_id", print_, place)], number)
    numbered = known.unionByName(placed.where("doc_id IS NULL").withColumn(number, F.lit(None).cast("bigint")))
    return _kept(written(numbered.drop(print_, place), "numbered"), number).drop(number)


def _kept(docs: DataFrame, key: str) -> DataFrame:
    """The rows whose key, unique but for nulls, is the smallest of its group."""
    found = written(near_duplicates(docs, doc_id=key), "near-duplicates")
    gone = fresh_name(docs.columns, "dropped")
    dropped = found.where(~F.col("kept")).select(F.col("doc_id").alias(gone))
    return docs.join(_small(dropped), F.col(f"`{key}`") == F.col(f"`{gone}`"), "left_anti")
