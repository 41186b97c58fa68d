"""Approximate nearest neighbours by inner product, on a robust-pruned directed graph a shard.

Distinct vectors of like length are dealt to shards of bounded size by a hash of the vector. In a
shard, vectors enter in batches: a greedy beam search over the graph so far proposes neighbours, and
relaxed distance pruning keeps those that no kept neighbour is much nearer to. For the graph, inner
products become distances by one added coordinate, sqrt(M^2 - |x|^2), which leaves their order as it
is; lengths within a shard differ at most LENGTH_RATIO times, so that it does not outweigh the others.
Queries come in blocks; each block runs a beam search by the inner product itself in every shard, and
a query's best of all shards, scored on the original vectors, are its result. All in double precision.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components take no part,
nor do rows with a null id. Of rows with one id and several vectors each is a candidate, and the id
counts once, at its best score; as a query the id stands for the least of them.
Vectors are only compared with vectors of the same length. Equal vectors are one node that knows
its k+1 least ids, which are all that can be among k nearest. Columns not named are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.llm.support import let, partitions, written

SHARD_VECTORS = 4096
SHARDS_A_UNIT = 4  # searched in one task, which returns their best together
DEGREE, ALPHA = 32, 1.2
BUILD_BEAM, SEARCH_BEAM = 64, 96
QUERY_BLOCK = 512
BLOCKS_TOGETHER = 2  # query blocks that share a copy of a unit
ENTRIES = 32  # of a search in a shard
LENGTH_RATIO = 4  # of the longest to the shortest vector that a shard may hold


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``(id, v array<double>)``: the distinct rows, invalid vectors left out."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    some = F.exists("v", lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull())
    return rows.where(finite & some).distinct()


def shards(nodes: DataFrame, k: int, shard_vectors: int = SHARD_VECTORS) -> DataFrame:
    """``(dim, shard, ids, v)``: distinct vectors with their k+1 least ids, dealt to shards."""
    # Window's group limit keeps k+1 rows of a vector in each task before the shuffle.
    first = nodes.withColumn("nth", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("nth") <= k + 1)
    distinct = written(first.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")).withColumns({"dim": F.size("v"), "length": length_class(F.col("v"))}), "ann-vectors")
    n = distinct.groupBy("dim", "length").count().withColumn("n_shards", F.ceil(F.col("count") / shard_vectors).cast("int"))
    upto = F.sum("n_shards").over(Window.partitionBy("dim").orderBy("length").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    n = n.select("dim", "length", "n_shards", (upto - F.col("n_shards")).cast("int").alias("first_shard"))  # a row a class of lengths
    dealt = distinct.join(n, ["dim", "length"]).withColumn("shard", F.col("first_shard") + F.pmod(F.xxhash64("v"), F.col("n_shards")).cast("int"))
    return dealt.select("dim", "ids", "v", "shard")


def length_class(v: Column) -> Column:
    """Vectors of one class differ at most LENGTH_RATIO times in length; no square overflows. Unit vectors are amid theirs."""
    def log_length(top: Column) -> Column:
        return F.log2(top) + F.log2(F.aggregate(v, F.lit(0.0), lambda s, x: s + (x / top) * (x / top))) / 2

    span = math.log2(LENGTH_RATIO)
    return let(F.array_max(F.transform(v, lambda x: F.abs(x))), lambda top: F.floor(log_length(top) / span + 0.5).cast("int"))


def _nearest(graph: np.ndarray, points: np.ndarray, queries: np.ndarray, start: np.ndarray, beam: int, inner: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Beam search of many queries at once: ids (-1: none) and squared distances, nearest first; ``inner``: by inner product, greatest first."""
    n, q = len(points), len(queries)
    ids = np.full((q, beam), -1, np.int64)
    dist = np.full((q, beam), np.inf)
    seen = np.ones((q, beam), bool)
    norms = np.zeros(n) if inner else (points**2).sum(1)
    own = np.zeros(q) if inner else (queries**2).sum(1)
    m = len(start)
    first = own[:, None] + norms[start] - 2 * queries @ points[start].T
    near_first = np.argsort(first, 1, kind="stable")
    ids[:, :m], seen[:, :m] = start[near_first], False
    dist[:, :m] = np.take_along_axis(first, near_first, 1)
    visited = np.zeros((q, n), bool)
    visited[:, start] = True
    live = np.arange(q)
    while len(live):
        at = np.argmin(np.where(seen[live], np.inf, dist[live]), 1)
        ready = ~seen[live, at]
        live, at = live[ready], at[ready]
        if not len(live):
            break
        node = ids[live, at]
        seen[live, at] = True
        near = graph[node]
        fresh = (near >= 0) & ~visited[live[:, None], np.maximum(near, 0)]
        rows, cols = np.nonzero(fresh)
        visited[live[rows], near[rows, cols]] = True
        safe = np.where(fresh, near, 0)
        d = own[live][:, None] + norms[safe] - 2 * np.einsum("qd,qrd->qr", queries[live], points[safe])
        d = np.where(fresh, d, np.inf)
        all_d = np.concatenate([dist[live], d], 1)
        all_i = np.concatenate([ids[live], np.where(fresh, near, -1)], 1)
        all_s = np.concatenate([seen[live], ~fresh], 1)
        best = np.argsort(all_d, 1, kind="stable")[:, :beam]
        dist[live], ids[live], seen[live] = np.take_along_axis(all_d, best, 1), np.take_along_axis(all_i, best, 1), np.take_along_axis(all_s, best, 1)
    return ids, dist


def _prune(points: np.ndarray, own: np.ndarray, cand: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Robust pruning of candidate lists (rows padded with -1): the nearest stays, whatever is nearer to it than 1/alpha goes."""
    cand = np.where(cand == own[:, None], -1, cand)
    order = np.sort(cand, 1)
    order[:, 1:][order[:, 1:] == order[:, :-1]] = -1  # repeated candidates
    cand = order
    d = ((points[np.maximum(cand, 0)] - points[own][:, None, :]) ** 2).sum(2)
    d = np.where(cand >= 0, d, np.inf)
    rank = np.argsort(d, 1, kind="stable")
    cand, d = np.take_along_axis(cand, rank, 1), np.take_along_axis(d, rank, 1)
    x = points[np.maximum(cand, 0)]
    sq = (x**2).sum(2)
    between = sq[:, :, None] + sq[:, None, :] - 2 * x @ x.transpose(0, 2, 1)
    alive = np.isfinite(d)
    out = np.full((len(own), degree), -1, np.int64)
    rows = np.arange(len(own))
    for r in range(degree):
        at = alive.argmax(1)
        ok = alive[rows, at]
        if not ok.any():
            break
        out[ok, r] = cand[ok, at[ok]]
        alive[rows, at] = False
        gone = alpha * alpha * between[rows, at] <= d  # squared distances
        alive &= ~(gone & ok[:, None])
    return out


def build_graph(points: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA, beam: int = BUILD_BEAM, batch: int = 256) -> tuple[np.ndarray, int]:
    """Neighbour lists (padded with -1) and the central point of a shard's graph."""
    n = len(points)
    start = int(((points - points.mean(0)) ** 2).sum(1).argmin())
    graph = np.full((n, degree), -1, np.int64)
    order = np.random.default_rng(n).permutation(n)
    order = np.concatenate([[start], order[order != start]])
    size, at = 1, 1
    for alpha_now in (1.0, alpha):  # a second pass over a full graph adds the longer edges
        while at < n:
            some = order[at : at + size]
            _insert(graph, points, some, start, beam, degree, alpha_now)
            at += len(some)
            size = min(batch, size * 2)
        at, size = 0, batch
    return graph, start


def _insert(graph: np.ndarray, points: np.ndarray, some: np.ndarray, start: int, beam: int, degree: int, alpha: float) -> None:
    found, _ = _nearest(graph, points, points[some], np.array([start]), beam)
    graph[some] = _prune(points, some, np.concatenate([found, graph[some]], 1), degree, alpha)
    src = np.repeat(some, degree)
    dst = graph[some].ravel()
    src, dst = src[dst >= 0], dst[dst >= 0]
    order = np.argsort(dst, kind="stable")
    src, dst = src[order], dst[order]
    targets, first, counts = np.unique(dst, return_index=True, return_counts=True)
    slot = np.arange(len(dst)) - np.repeat(first, counts)
    extra = np.full((len(targets), int(counts.max(initial=0))), -1, np.int64)
    extra[np.repeat(np.arange(len(targets)), counts), slot] = src
    extra[(extra[:, :, None] == graph[targets][:, None, :]).any(2)] = -1  # already neighbours
    both = np.concatenate([graph[targets], extra], 1)
    need = (both >= 0).sum(1)
    fits = need <= degree
    packed = np.take_along_axis(both, np.argsort(both < 0, 1, kind="stable"), 1)[:, :degree]
    graph[targets[fits]] = packed[fits] if packed.shape[1] == degree else np.pad(packed[fits], ((0, 0), (0, degree - packed.shape[1])), constant_values=-1)
    if (~fits).any():
        graph[targets[~fits]] = _prune(points, targets[~fits], both[~fits], degree, alpha)


def entries(points: np.ndarray, start: int, n: int = ENTRIES) -> np.ndarray:
    """Where a search begins: the central point and the longest vectors, which inner products favour."""
    longest = np.argsort(-(points**2).sum(1), kind="stable")[: n - 1]
    return np.unique(np.r_[start, longest])


def scaled(v: np.ndarray) -> np.ndarray:
    """Vectors over their greatest component (as a power of two, which rounds nothing), so that squares neither overflow nor vanish."""
    return np.ldexp(v, -np.frexp(np.abs(v).max())[1])


def lifted(v: np.ndarray) -> np.ndarray:
    """Vectors with one more coordinate, so that nearest means largest inner product."""
    sq = (v**2).sum(1)
    return np.concatenate([v, np.sqrt(np.maximum(sq.max() - sq, 0))[:, None]], 1)


def build(nodes: DataFrame, k: int, *, shard_vectors: int = SHARD_VECTORS, degree: int = DEGREE, alpha: float = ALPHA) -> DataFrame:
    """The index, a row a shard: ``(dim, shard, start, vectors, graph, ids, id_ends)`` with packed arrays of bounded size."""
    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        v = np.stack(rows["v"].to_numpy()).astype(np.float64)
        order = np.lexsort(v.T[::-1])
        v, ids = v[order], [np.asarray(x, np.int64) for x in rows["ids"].to_numpy()[order]]
        graph, start = build_graph(lifted(scaled(v)), degree, alpha)
        ends = np.cumsum([len(x) for x in ids]).astype(np.int32)
        return pd.DataFrame({"dim": [key[0]], "shard": [key[1]], "start": [start], "vectors": [v.tobytes()], "graph": [graph.astype(np.int32).tobytes()], "ids": [np.concatenate(ids).tobytes()], "id_ends": [ends.tobytes()]})

    # A shard is seconds of work on little data: an explicit number of partitions keeps shards apart.
    dealt = shards(nodes, k, shard_vectors).repartition(partitions(nodes), "dim", "shard")
    return dealt.groupBy("dim", "shard").applyInPandas(one, "dim int, shard int, start int, vectors binary, graph binary, ids binary, id_ends binary")


def search(index: DataFrame, queries: DataFrame, k: int, *, beam: int = SEARCH_BEAM, block: int = QUERY_BLOCK) -> DataFrame:
    """``(query_id, rank, id, score)``: the k nearest found for each query (id, v), its own id excluded.

    Query blocks go to every unit of a few shards of their vectors' length. Each pair of a unit and a
    block is bounded work in a group of its own; it merges its shards' finds and returns at most k rows
    a query. A unit is copied once for BLOCKS_TOGETHER blocks, which keeps tasks apart as queries grow.
    """
    packed = written(_packed(queries.groupBy("id").agg(F.min("v").alias("v")), block), "ann-queries")
    units = index.withColumn("unit", F.floor(F.col("shard") / SHARDS_A_UNIT).cast("int"))
    to_units = packed.join(units.groupBy("dim").agg(F.collect_set("unit").alias("unit_list")), "dim").withColumn("unit", F.explode("unit_list")).drop("unit_list")
    groups = packed.groupBy("dim").agg(F.collect_set("lot").alias("lots"))
    copies = units.join(groups, "dim").withColumn("lot", F.explode("lots")).drop("lots")
    keys = ["dim", "unit", "lot"]
    n = partitions(index)
    met = copies.repartition(n, *keys).join(to_units.repartition(n, *keys), keys)

    def beam_search(key: tuple, shards_of: pd.DataFrame) -> pd.DataFrame:
        out: dict[int, list] = {}
        for row in shards_of.itertuples(index=False):
            v = np.frombuffer(row.vectors, np.float64).reshape(-1, row.dim)
            graph = np.frombuffer(row.graph, np.int32).reshape(len(v), -1).astype(np.int64)
            ends = np.frombuffer(row.id_ends, np.int32)
            ids = np.split(np.frombuffer(row.ids, np.int64), ends[:-1])
            q_ids = np.frombuffer(row.q_ids, np.int64).tolist()
            q = np.frombuffer(row.q_vectors, np.float64).reshape(-1, row.dim)
            points = scaled(v)
            each_scaled = np.stack([scaled(x) for x in q])
            found, _ = _nearest(graph, points, each_scaled, entries(points, row.start), max(beam, k + 1, ENTRIES), inner=True)
            for i, q_id in enumerate(q_ids):
                near = found[i][found[i] >= 0]
                score = (v[near] * q[i]).sum(1)
                best = dict(out.get(q_id, []))  # an id counts once, at its best
                for s, node in zip(score.tolist(), near):
                    for c in ids[node].tolist():
                        if c != q_id and s > best.get(c, -math.inf):
                            best[c] = s
                out[q_id] = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k]
        return pd.DataFrame([(q_id, c, s) for q_id, best in out.items() for c, s in best], columns=["query_id", "id", "score"])

    hits = met.groupBy(*keys, "block").applyInPandas(beam_search, "query_id long, id long, score double")
    hits = hits.groupBy("query_id", "id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def _packed(queries: DataFrame, block: int) -> DataFrame:
    """``(dim, lot, block, q_ids, q_vectors)``: queries of one length as bytes, at most ``block`` to a row; a lot is about BLOCKS_TOGETHER blocks."""
    lots = max(1, math.ceil(queries.count() / (block * BLOCKS_TOGETHER)))

    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        parts = [rows.iloc[at : at + block] for at in range(0, len(rows), block)]
        packed = lambda f: [f(p).tobytes() for p in parts]
        return pd.DataFrame({"dim": key[0], "lot": key[1], "block": range(len(parts)), "q_ids": packed(lambda p: p["id"].to_numpy(np.int64)), "q_vectors": packed(lambda p: np.stack(p["v"].to_numpy()).astype(np.float64))})

    dealt = queries.withColumns({"dim": F.size("v"), "lot": F.pmod(F.xxhash64("id"), F.lit(lots)).cast("int")})
    return dealt.groupBy("dim", "lot").applyInPandas(pack, "dim int, lot int, block int, q_ids binary, q_vectors binary")
