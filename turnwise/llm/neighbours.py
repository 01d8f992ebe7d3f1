"""Approximate nearest neighbours by largest inner product, over robust-pruned directed graphs.

Distinct vectors are dealt to shards, each of norms of one power of two. In each shard a graph is built: a greedy search for each vector proposes its
neighbours, and relaxed distance pruning keeps a diverse few of them, with edges both ways. A beam search from the middle of the shard
answers queries; every query goes through every shard, the shards' answers are scored in double precision and merged.

Inside a shard vectors are scaled by the largest norm and get one more component that makes their length 1. Distances between such vectors
order them as inner products do, so pruning by distance is sound; as norms of a shard are alike, that component stays moderate.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnwise.llm.common import written

#: Distinct vectors in a shard, about.
SHARD_VECTORS = 16_384
#: Queries that meet a shard in one task.
QUERY_BLOCK = 65_536
#: Bytes of the table of seen nodes, and of the pairs compared in one pruning step.
_WORK_BYTES = 64 << 20
#: Rounds in which nodes that a search misses get edges.
REPAIRS = 32
INDEX = "shard int, dim int, wide boolean, start int, vectors binary, neighbours binary, degree int, ids array<long>, id_ends array<int>"


@dataclass(frozen=True)
class GraphRules:
    """``degree``: edges kept per node; ``beam``: width of the searches while building; ``relax``: a neighbour goes if a kept one is
    ``relax`` times nearer to it than the node is."""

    degree: int = 32
    beam: int = 64
    relax: float = 1.2
    batch: int = 512


def finite_vector(vector: Column) -> Column:
    """Whether a vector is there, is not zero and holds neither nulls nor NaN nor infinities."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(F.exists(vector, lambda x: x != 0) & ~bad, F.lit(False))


def beam_search(points: np.ndarray, edges: np.ndarray, start: int, asked: np.ndarray, beam: int, width: int = 4):
    """For each query the ``beam`` nearest nodes found, nearest first (-1 where there are fewer), their similarity, and all nodes that were
    expanded, as (query, node, similarity) in the order of queries."""
    found_ids = np.full((len(asked), beam), -1, np.int32)
    found_near = np.full((len(asked), beam), -np.inf, np.float32)
    passed = []
    step = max(1, _WORK_BYTES // (4 * len(points)))
    for at in range(0, len(asked), step):
        ids, near, expanded = _beam_block(points, edges, start, asked[at : at + step], beam, width)
        found_ids[at : at + step], found_near[at : at + step] = ids, near
        passed.append((expanded[0] + at, *expanded[1:]))
    return found_ids, found_near, tuple(np.concatenate(x) for x in zip(*passed, strict=True))


def _beam_block(points, edges, start, asked, beam, width):
    n, m = len(asked), len(points)
    seen = np.full(n * m, -1, np.int32)
    seen[np.arange(n) * m + start] = 0
    ids = np.full((n, beam), -1, np.int32)
    near = np.full((n, beam), -np.inf, np.float32)
    open_ = np.zeros((n, beam), bool)
    ids[:, 0], near[:, 0], open_[:, 0] = start, asked @ points[start], True
    passed = []
    active = np.arange(n)
    while True:
        waiting = open_[active]
        going = waiting.any(axis=1)
        active, waiting = active[going], waiting[going]
        if not len(active):
            break
        row, place = np.nonzero(waiting & (np.cumsum(waiting, axis=1) <= width))
        nodes = ids[active[row], place]
        passed.append((active[row], nodes, near[active[row], place]))
        open_[active[row], place] = False
        reached = edges[nodes]
        there = reached >= 0
        row, reached = np.repeat(row, there.sum(axis=1)), reached[there]
        flat = active[row] * m + reached
        new = seen[flat] < 0
        row, reached, flat = row[new], reached[new], flat[new]
        # Of several edges to one node, the last to leave its number is the one that counts.
        number = np.arange(len(flat), dtype=np.int32)
        seen[flat] = number
        once = seen[flat] == number
        row, reached = row[once], reached[once]
        if not len(row):
            continue
        score = np.einsum("ij,ij->i", points[reached], asked[active[row]])
        counts = np.bincount(row, minlength=len(active))
        slot = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
        more_ids = np.full((len(active), counts.max()), -1, np.int32)
        more_near = np.full(more_ids.shape, -np.inf, np.float32)
        more_ids[row, slot], more_near[row, slot] = reached, score
        all_ids, all_near = np.hstack([ids[active], more_ids]), np.hstack([near[active], more_near])
        all_open = np.hstack([open_[active], more_ids >= 0])
        order = np.argpartition(-all_near, beam - 1, axis=1)[:, :beam]
        order = np.take_along_axis(order, np.argsort(-np.take_along_axis(all_near, order, 1), axis=1, kind="stable"), 1)
        ids[active], near[active] = np.take_along_axis(all_ids, order, 1), np.take_along_axis(all_near, order, 1)
        open_[active] = np.take_along_axis(all_open, order, 1)
    row, nodes, score = (np.concatenate(x) for x in zip(*passed, strict=True))
    order = np.argsort(row, kind="stable")
    return ids, near, (row[order], nodes[order], score[order])


def robust_prune(points: np.ndarray, nodes: np.ndarray, row: np.ndarray, proposed: np.ndarray, near: np.ndarray, rules: GraphRules) -> np.ndarray:
    """At most ``degree`` of the neighbours proposed for each node (``row`` ascends): the nearest first, each of which drops those to which it
    is nearer, ``relax`` times, than the node is. -1 where there are fewer."""
    kept = np.full((len(nodes), rules.degree), -1, np.int32)
    order = np.lexsort((proposed, -near, row))
    row, proposed, near = row[order], proposed[order], near[order]
    other = (proposed != nodes[row]) & np.concatenate([[True], (row[1:] != row[:-1]) | (proposed[1:] != proposed[:-1])])
    row, proposed, near = row[other], proposed[other], near[other]
    counts = np.bincount(row, minlength=len(nodes))
    bounds = np.concatenate([[0], np.cumsum(counts)])
    at = 0
    while at < len(nodes):
        end = at + 1
        widest = counts[at]
        while end < len(nodes) and (end + 1 - at) * max(widest, counts[end]) ** 2 * 4 <= _WORK_BYTES:
            widest, end = max(widest, counts[end]), end + 1
        if widest:
            own = slice(bounds[at], bounds[end])
            r, slot = row[own] - at, np.arange(bounds[at], bounds[end]) - bounds[:-1][row[own]]
            ids = np.zeros((end - at, widest), np.int32)
            alive = np.zeros(ids.shape, bool)
            far = np.full(ids.shape, -np.inf, np.float32)
            ids[r, slot], alive[r, slot], far[r, slot] = proposed[own], True, 1 - near[own]
            vectors = points[ids]
            between = 1 - vectors @ vectors.transpose(0, 2, 1)
            every = np.arange(end - at)
            for k in range(rules.degree):
                first = alive.argmax(axis=1)
                some = alive[every, first]
                if not some.any():
                    break
                kept[at:end, k] = np.where(some, ids[every, first], -1)
                alive[every, first] = False
                alive &= rules.relax**2 * between[every, first] > far
        at = end
    return kept


def build_graph(points: np.ndarray, rules: GraphRules) -> tuple[np.ndarray, int]:
    """The edges (a row per node, -1 for none) and the node from which searches start. From there every node can be reached."""
    m = len(points)
    edges = np.full((m, rules.degree + rules.degree // 2), -1, np.int32)
    start = int((points @ points.mean(axis=0)).argmax())
    order = np.random.default_rng(0).permutation(m).astype(np.int32)
    order = np.concatenate([[start], order[order != start]]).astype(np.int32)
    at = 1
    while at < m:
        nodes = order[at : at + min(at, rules.batch)]
        at += len(nodes)
        _link(points, edges, start, nodes, rules)
    edges, lost = _with_ways(points, edges, start, rules)
    for at in range(0, len(lost), rules.batch):
        _link(points, edges, start, lost[at : at + rules.batch], rules)
    if len(lost):
        edges, _ = _with_ways(points, edges, start, rules)
    return _all_reached(points, edges, start, rules), start


def _link(points: np.ndarray, edges: np.ndarray, start: int, nodes: np.ndarray, rules: GraphRules) -> None:
    """Search the nodes, give them the pruned of what was passed as neighbours, and these an edge back, pruned where there is no room."""
    room = edges.shape[1]
    _, _, (row, passed, near) = beam_search(points, edges, start, points[nodes], rules.beam)
    out = robust_prune(points, nodes, row, passed, near, rules)
    edges[nodes] = -1
    edges[nodes, : rules.degree] = out
    source, target = np.repeat(nodes, (out >= 0).sum(axis=1)), out[out >= 0]
    back = ~(edges[target] == source[:, None]).any(axis=1)
    source, target = source[back], target[back]
    by_target = np.argsort(target, kind="stable")
    source, target = source[by_target], target[by_target]
    which, first, count = np.unique(target, return_index=True, return_counts=True)
    used = (edges[which] >= 0).sum(axis=1)
    full = used + count > room
    slot = np.repeat(used - first, count) + np.arange(len(target))
    fits = np.repeat(~full, count)
    edges[target[fits], slot[fits]] = source[fits]
    if full.any():
        crowded = which[full]
        old = edges[crowded]
        row = np.concatenate([np.nonzero(old >= 0)[0], np.searchsorted(crowded, target[~fits])])
        proposed = np.concatenate([old[old >= 0], source[~fits]])
        near = np.einsum("ij,ij->i", points[crowded[row]], points[proposed])
        edges[crowded] = -1
        edges[crowded, : rules.degree] = robust_prune(points, crowded, row, proposed, near, rules)


def _with_ways(points: np.ndarray, edges: np.ndarray, start: int, rules: GraphRules) -> tuple[np.ndarray, np.ndarray]:
    """Search every node. Those that are not found, mostly in tight groups far from all else, get an edge from the nearest node found: one per
    such node and round, as the rest of a group is often found through the first. Returns also the nodes not found at first."""
    lost = all_lost = np.arange(len(points), dtype=np.int32)
    for k in range(REPAIRS):
        found = beam_search(points, edges, start, points[lost], rules.beam // 2)[0]
        missed = ~(found == lost[:, None]).any(axis=1)
        lost, nearest = lost[missed], found[missed, 0]
        if not k:
            all_lost = lost
        if not len(lost):
            break
        nearest, first = np.unique(nearest, return_index=True)
        edges = _with_edges(edges, nearest, lost[first])
    return edges, all_lost


def _with_edges(edges: np.ndarray, source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """One edge more for each of the nodes ``source``, in a free place or a new one."""
    free = edges[source] < 0
    if not free.any(axis=1).all():
        edges = np.hstack([edges, np.full((len(edges), 1), -1, np.int32)])
        free = edges[source] < 0
    edges[source, free.argmax(axis=1)] = target
    return edges


def _all_reached(points: np.ndarray, edges: np.ndarray, start: int, rules: GraphRules) -> np.ndarray:
    """Give each node that no path reaches an edge from the nearest node found that one does."""
    while True:
        reached = np.zeros(len(points), bool)
        reached[start] = True
        front = np.array([start])
        while len(front):
            front = np.unique(edges[front])
            front = front[front >= 0]
            front = front[~reached[front]]
            reached[front] = True
        lost = np.flatnonzero(~reached).astype(np.int32)
        if not len(lost):
            return edges
        nearest, first = np.unique(beam_search(points, edges, start, points[lost], rules.beam)[0][:, 0], return_index=True)
        edges = _with_edges(edges, nearest, lost[first])


def unit_points(vectors: np.ndarray) -> np.ndarray:
    """The vectors scaled to length 1 at most, with one component more that makes it 1."""
    largest = np.abs(vectors).max()
    scaled = vectors.astype(np.float64) / largest
    scaled /= np.sqrt((scaled**2).sum(axis=1).max())
    rest = np.sqrt(np.maximum(0, 1 - (scaled**2).sum(axis=1)))
    return np.hstack([scaled, rest[:, None]]).astype(np.float32)


def exact_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products in double precision, summed from the first component to the last."""
    total = np.zeros(len(a))
    for k in range(a.shape[1]):
        total += a[:, k].astype(np.float64) * b[:, k].astype(np.float64)
    return total


def _index_shard(rules: GraphRules):
    """From the rows of a shard (vector as an array, ids) to one row of the index per number of components."""
    made = pa.schema(
        [("shard", pa.int32()), ("dim", pa.int32()), ("wide", pa.bool_()), ("start", pa.int32()), ("vectors", pa.binary()), ("neighbours", pa.binary()), ("degree", pa.int32())]
        + [("ids", pa.list_(pa.int64())), ("id_ends", pa.list_(pa.int32()))]
    )

    def run(key: tuple, table: pa.Table) -> pa.Table:
        shard, found = key[0].as_py(), []
        lengths = np.diff(table["vector"].combine_chunks().offsets.to_numpy())
        for dim in np.unique(lengths):
            part = table.filter(pa.array(lengths == dim))
            vectors = part["vector"].combine_chunks().flatten().to_numpy().reshape(-1, dim)
            ids = part["ids"].combine_chunks()
            edges, start = build_graph(unit_points(vectors), rules)
            ends = (ids.offsets.to_numpy() - ids.offsets[0].as_py())[1:]
            values = (shard, int(dim), vectors.dtype == np.float64, start, vectors.tobytes(), edges.tobytes(), edges.shape[1], ids.flatten().to_numpy(), ends)
            found.append(dict(zip(made.names, values, strict=True)))
        return pa.Table.from_pylist(found, schema=made)

    return run


def build_index(vectors: DataFrame, nearest: int, rules: GraphRules = GraphRules(), shard_vectors: int = SHARD_VECTORS, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The written index of all vectors: a row per shard with its vectors, edges and ids.

    Equal vectors are one node, which keeps the ``nearest`` + 1 smallest ids: more of them cannot be among the ``nearest`` of any query but
    by larger ids. Rows with the same id and vector are one (they meet in one task). Rows without an id, and vectors that are null, zero or hold nulls or
    values that are not finite, take no part; an empty table gives an empty index. Vectors of different lengths are never compared.
    """
    kind = "array<double>" if dict(vectors.dtypes)[vector] == "array<double>" else "array<float>"
    given = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{vector}`").cast(kind).alias("vector"))
    given = given.where(F.col("vec_id").isNotNull() & finite_vector(F.col("vector")))
    # The smallest ids of each vector are picked before the shuffle and after it, so a vector that half of the rows share is no hot spot.
    first = F.dense_rank().over(Window.partitionBy("vector").orderBy("vec_id")) <= nearest + 1
    nodes = given.withColumn("first", first).where("first").groupBy("vector").agg(F.array_sort(F.collect_set("vec_id")).alias("ids"))
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double")))
    norm = F.least(F.greatest(norm, F.lit(5e-324)), F.lit(1e308))  # squares may be too small or too large for doubles
    nodes = nodes.withColumn("size", F.round(F.log2(norm)).cast("int"))
    given = given.select(F.round(F.log2(norm)).cast("int").alias("size"))
    first, shards = 0, []
    for r in given.groupBy("size").count().orderBy("size").collect():  # as many rows as there are powers of two
        count = math.ceil(r["count"] / shard_vectors)
        shards.append((r["size"], F.struct(F.lit(first).alias("first"), F.lit(count).alias("count"))))
        first += count
    if not shards:
        return written(nodes.sparkSession.createDataFrame([], INDEX), "index")
    own = F.element_at(F.create_map(*[x for size, shard in shards for x in (F.lit(size), shard)]), F.col("size"))
    shard = (own["first"] + F.pmod(F.xxhash64("vector"), own["count"])).cast("int").alias("shard")
    return written(nodes.select(shard, "vector", "ids").groupBy("shard").applyInArrow(_index_shard(rules), INDEX), "index")


def _search_shard(nearest: int, beam: int):
    out = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(index: pa.Table, queries: pa.Table) -> pa.Table:
        found = [pa.table([pa.array([], t) for t in out.types], schema=out)]
        if queries.num_rows:
            column = queries["vector"].combine_chunks()
            lengths = np.diff(column.offsets.to_numpy())
            ids = queries["query_id"].to_numpy()
            for k in range(index.num_rows):
                row = {name: index[name][k] for name in index.schema.names}
                dim = row["dim"].as_py()
                same = lengths == dim
                if same.any():
                    asked = column.filter(pa.array(same)).flatten().to_numpy().reshape(-1, dim)
                    found.append(_search_graph(row, ids[same], asked))
        return pa.concat_tables(found)

    def _search_graph(row: dict, query_ids: np.ndarray, asked: np.ndarray) -> pa.Table:
        dim = row["dim"].as_py()
        vectors = np.frombuffer(row["vectors"].as_buffer(), "<f8" if row["wide"].as_py() else "<f4").reshape(-1, dim)
        edges = np.frombuffer(row["neighbours"].as_buffer(), "<i4").reshape(len(vectors), -1)
        ids, ends = row["ids"].values.to_numpy(), row["id_ends"].values.to_numpy()
        sizes = np.diff(ends, prepend=0)
        points = unit_points(vectors)
        # The same vector is searched once.
        distinct, which = np.unique(asked, axis=0, return_inverse=True)
        scaled = distinct.astype(np.float64) / np.abs(distinct).max(axis=1, keepdims=True)
        scaled /= np.sqrt((scaled**2).sum(axis=1, keepdims=True))
        directions = np.hstack([scaled, np.zeros((len(scaled), 1))]).astype(np.float32)
        nodes, _, _ = beam_search(points, edges, row["start"].as_py(), directions, max(beam, nearest + 1))
        near_row, slot = np.nonzero(nodes >= 0)
        near_node = nodes[near_row, slot]
        score = exact_scores(vectors[near_node], distinct[near_row])
        # From nodes to ids: the best nearest + 1 of each vector, ties to smaller ids; one of them may be the query itself.
        count = sizes[near_node]
        near_row, score = np.repeat(near_row, count), np.repeat(score, count)
        inside = np.arange(len(near_row)) - np.repeat(np.cumsum(count) - count, count)
        near_id = ids[np.repeat(ends[near_node] - count, count) + inside]
        best = _first(near_row, score, near_id, nearest + 1)
        near_row, score, near_id = near_row[best], score[best], near_id[best]
        starts = np.searchsorted(near_row, np.arange(len(distinct) + 1))
        count = (starts[1:] - starts[:-1])[which]
        query = np.repeat(np.arange(len(which)), count)
        place = np.repeat(starts[which], count) + np.arange(len(query)) - np.repeat(np.cumsum(count) - count, count)
        other = near_id[place] != query_ids[query]
        query, place = query[other], place[other]
        best = _first(query, score[place], near_id[place], nearest)
        return pa.table([pa.array(query_ids[query[best]]), pa.array(near_id[place[best]]), pa.array(score[place[best]])], schema=out)

    def _first(row: np.ndarray, score: np.ndarray, ids: np.ndarray, count: int) -> np.ndarray:
        """Places of the best ``count`` of each row, in order."""
        order = np.lexsort((ids, -score, row))
        sorted_row = row[order]
        begin = np.searchsorted(sorted_row, sorted_row)
        return order[np.arange(len(order)) - begin < count]

    return lambda key, index, queries: run(index, queries)


def search_index(
    index: DataFrame, queries: DataFrame, nearest: int, beam: int = 128, query_block: int = QUERY_BLOCK, vec_id: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``nearest`` found for each query, by falling inner product, ties to the smaller id.

    A row of the index with the query's own id is no answer. ``beam`` is the width of the search; every shard is searched for every query, in
    blocks. Rows of ``queries`` that share an id are one query with the best of their answers. What takes no part in the index takes
    none here; without queries, or an index, there are no rows.
    """
    kind = "array<double>" if index.where("wide").limit(1).count() else "array<float>"
    given = queries.select(F.col(f"`{vec_id}`").cast("long").alias("query_id"), F.col(f"`{vector}`").cast(kind).alias("vector"))
    given = given.where(F.col("query_id").isNotNull() & finite_vector(F.col("vector")))
    last = index.agg(F.max("shard")).first()[0]
    blocks = max(1, math.ceil(given.count() / query_block))
    numbers = F.array().cast("array<int>") if last is None else F.sequence(F.lit(0), F.lit(last))
    asked = given.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).withColumn("shard", F.explode(numbers))
    parts = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    keys = ["shard", "block"]
    answers = parts.groupBy(keys).cogroup(asked.groupBy(keys)).applyInArrow(_search_shard(nearest, beam), "query_id long, vec_id long, score double")
    answers = answers.repartition("query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return answers.withColumn("rank", rank).where(F.col("rank") <= nearest).select("query_id", "rank", "vec_id", "score")
