"""Approximate nearest neighbours on robust-pruned directed graphs (operator 1).

Vectors are dealt by hash to shards of about ``SHARD`` vectors.  A shard's graph grows
in batches: a greedy search on the graph so far proposes neighbours of the new vectors,
and robust pruning keeps a neighbour ``c`` of ``p`` only while no kept one ``k`` has
``ALPHA * d(k, c) <= d(p, c)``; reverse edges are pruned the same way when a list is
full.  Every vector is indexed.  A query's beam search runs on each shard; the shard's
best are measured again in double precision on the original vectors and merged.

Equal vectors are one node of the graph; its ``k + 1`` smallest ids (enough for any
answer) stand for them in results, so copies cost nothing and ties go to smaller ids.

Queries stream through the task that holds a shard's index, in Arrow batches, so memory
is bounded by a shard and a batch whatever the number of queries.

Edge cases: vectors that are null, empty, all zero, or hold null or non-finite
components take no part (as query or candidate), nor do rows with a null id; rows that
repeat an id count once, with the smallest of their vectors; only vectors of equal
length are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scrubjay.llm.common import written

SHARD = 4096
DEGREE = 32
ALPHA = 1.2
BUILD_BEAM = 64
SEARCH_BEAM = 96
BATCH = 512


def _squares(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances from points ``a`` (rows x dim) to vectors ``x[b]`` (rows x many)."""
    d = x[b] - a[:, None, :]
    return np.einsum("ijk,ijk->ij", d, d)


def beam_search(x: np.ndarray, graph: np.ndarray, entry: int, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, squared distances) of the ``beam`` best found for each query, nearest first;
    unfilled places are -1.  All queries advance together, one expansion a step."""
    q = len(queries)
    rows = np.arange(q)
    ids = np.full((q, beam), -1, np.int64)
    dist = np.full((q, beam), np.inf, x.dtype)
    open_ = np.zeros((q, beam), bool)
    seen = np.zeros((q, len(x)), bool)
    ids[:, 0], seen[:, entry], open_[:, 0] = entry, True, True
    dist[:, 0] = _squares(x, queries, np.full((q, 1), entry))[:, 0]
    while True:
        active = np.flatnonzero(open_.any(axis=1))
        if not len(active):
            return ids, dist
        at = open_[active].argmax(axis=1)  # places are in order of distance
        open_[active, at] = False
        near = graph[ids[active, at]]
        fresh = (near >= 0) & ~seen[active[:, None], near]
        seen[np.broadcast_to(active[:, None], near.shape)[fresh], near[fresh]] = True
        d = np.where(fresh, _squares(x, queries[active], near), np.inf).astype(x.dtype)
        all_d = np.concatenate((dist[active], d), axis=1)
        order = np.argsort(all_d, axis=1, kind="stable")[:, :beam]
        dist[active] = np.take_along_axis(all_d, order, 1)
        ids[active] = np.take_along_axis(np.concatenate((ids[active], np.where(fresh, near, -1)), axis=1), order, 1)
        open_[active] = np.take_along_axis(np.concatenate((open_[active], fresh), axis=1), order, 1)
        open_[active] &= np.isfinite(dist[active])


def robust_prune(x: np.ndarray, candidates: np.ndarray, dist: np.ndarray, degree: int, alpha: float = ALPHA) -> np.ndarray:
    """Pruned neighbour lists from candidates (-1 where none) at squared distances ``dist``."""
    order = np.argsort(dist, axis=1, kind="stable")
    candidates, dist = np.take_along_axis(candidates, order, 1), np.take_along_axis(dist, order, 1)
    alive = (candidates >= 0) & np.isfinite(dist)
    points = x[candidates]
    inner = points @ points.transpose(0, 2, 1)
    norms = np.einsum("ijk,ijk->ij", points, points)
    out = np.full((len(candidates), degree), -1, np.int32)
    rows = np.arange(len(candidates))
    for place in range(degree):
        if not alive.any():
            break
        pick = alive.argmax(axis=1)
        has = alive[rows, pick]
        out[has, place] = candidates[rows, pick][has]
        between = norms + norms[rows, pick][:, None] - 2 * inner[rows, pick]
        alive &= ~(has[:, None] & (alpha * alpha * between <= dist))
        alive[rows, pick] = False
    return out


def _reverse(x: np.ndarray, graph: np.ndarray, new: np.ndarray, degree: int) -> None:
    """Add the edges back to ``new`` points; full lists are pruned again."""
    source = np.repeat(new, degree)
    target = graph[new].ravel()
    source, target = source[target >= 0], target[target >= 0]
    order = np.argsort(target, kind="stable")
    source, target = source[order], target[order]
    first = np.flatnonzero(np.concatenate(([True], target[1:] != target[:-1]))) if len(target) else np.zeros(0, np.int64)
    count = np.diff(np.append(first, len(target)))
    # at most 2 * degree additions of a list a round, so that a hub's row stays short
    step = 2 * degree
    for lo in range(0, int(count.max(initial=0)), step):
        use = np.flatnonzero(count > lo)
        owner = target[first[use]].astype(np.int64)
        take = np.minimum(count[use] - lo, step)
        more = np.full((len(use), int(take.max())), -1, np.int64)
        column = np.arange(more.shape[1])
        inside = column < take[:, None]
        more[inside] = source[(first[use][:, None] + lo + column)[inside]]
        for a in range(0, len(use), BATCH):
            own, both = owner[a:a + BATCH], np.concatenate((graph[owner[a:a + BATCH]].astype(np.int64), more[a:a + BATCH]), axis=1)
            both = np.sort(both, axis=1)
            both[:, 1:][both[:, 1:] == both[:, :-1]] = -1  # an edge may be there already
            fits = (both >= 0).sum(axis=1) <= degree
            packed = np.take_along_axis(both, np.argsort(both < 0, axis=1, kind="stable"), 1)[:, :degree]
            graph[own[fits]] = packed[fits]
            if (~fits).any():
                own, both = own[~fits], both[~fits]
                d = np.where(both >= 0, _squares(x, x[own], both), np.inf)
                graph[own] = robust_prune(x, both, d, degree)


def build_graph(x: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, seed: int = 1) -> tuple[np.ndarray, int]:
    """(neighbour lists, entry point) over the rows of ``x``."""
    n = len(x)
    graph = np.full((n, degree), -1, np.int32)
    entry = int(np.einsum("ij,ij->i", x - x.mean(axis=0), x - x.mean(axis=0)).argmin())
    order = np.random.default_rng(seed).permutation(n)
    order = np.concatenate(([entry], order[order != entry]))
    done = 1
    while done < n:
        new = order[done:done + min(max(done, 16), BATCH)]
        ids, dist = beam_search(x, graph, entry, x[new], beam)
        # vectors of the same batch propose one another too
        own = _squares(x, x[new], np.broadcast_to(new, (len(new), len(new))).copy()) if len(new) <= 64 else None
        if own is not None:
            np.fill_diagonal(own, np.inf)
            ids, dist = np.concatenate((ids, np.broadcast_to(new, own.shape)), axis=1), np.concatenate((dist, own), axis=1)
        graph[new] = robust_prune(x, ids, dist, degree)
        _reverse(x, graph, new, degree)
        done += len(new)
    return graph, entry


class _Scale:
    """Centred and scaled copies for traversal; distances keep their order.  Single
    precision, or double where a few components dwarf the others."""

    def __init__(self, vectors: np.ndarray):
        self.centre = np.median(vectors, axis=0)
        moved = np.abs(vectors - self.centre)
        self.unit = np.median(moved[moved > 0]) if (moved > 0).any() else 1.0
        self.kind = np.float32 if moved.max(initial=0.0) / self.unit < 1e4 else np.float64

    def __call__(self, vectors: np.ndarray) -> np.ndarray:
        return ((vectors - self.centre) / self.unit).astype(self.kind)


INDEX = "dim int, shard int, ids binary, vectors binary, graph binary, entry int"


def _build_shard(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    vectors = np.array(rows["vector"].tolist(), np.float64)
    graph, entry = build_graph(_Scale(vectors)(vectors))
    return pd.DataFrame({"dim": [key[0]], "shard": [key[1]], "ids": [rows["id"].to_numpy(np.int64).tobytes()],
                         "vectors": [vectors.tobytes()], "graph": [graph.tobytes()], "entry": [entry]})


class _Shard:
    def __init__(self, dim: int, ids: bytes, vectors: bytes, graph: bytes, entry: int):
        self.ids = np.frombuffer(ids, np.int64)
        self.vectors = np.frombuffer(vectors, np.float64).reshape(-1, dim)
        self.graph = np.frombuffer(graph, np.int32).reshape(len(self.ids), -1)
        self.entry = entry
        self.scale = _Scale(self.vectors)
        self.x = self.scale(self.vectors)

    def search(self, queries: np.ndarray, k: int, beam: int):
        """(query place, node id, exact distance) of the k best nodes of each query."""
        q = self.scale(queries)
        places, nodes, scores = [], [], []
        for lo in range(0, len(q), 256):
            found, _ = beam_search(self.x, self.graph, self.entry, q[lo:lo + 256], beam)
            found = found[:, :max(2 * k, 32)]
            apart = self.vectors[found] - queries[lo:lo + 256][:, None, :]
            exact = np.where(found >= 0, np.sqrt((apart * apart).sum(axis=2)), np.inf)
            ids = self.ids[found]
            order = np.lexsort((ids, exact), axis=1)[:, :k]
            rows = np.repeat(np.arange(len(found)), order.shape[1]).reshape(order.shape)
            ok = np.isfinite(np.take_along_axis(exact, order, 1))
            places.append(rows[ok] + lo)
            nodes.append(np.take_along_axis(ids, order, 1)[ok])
            scores.append(np.take_along_axis(exact, order, 1)[ok])
        return np.concatenate(places), np.concatenate(nodes), np.concatenate(scores)


def _search(k: int, beam: int):
    """Rows sorted by (dim, shard, role): a shard's index, then the queries to run on it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, name = None, None
        for batch in batches:
            role = batch.column(2).to_numpy()
            names = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            lo = 0
            while lo < len(role):
                if role[lo] == 0:
                    name, shard = names[lo], _Shard(names[lo][0], *(batch.column(c)[lo].as_py() for c in range(5, 9)))
                    lo += 1
                    continue
                hi = lo
                while hi < len(role) and role[hi] == 1 and names[hi] == names[lo]:
                    hi += 1
                if shard is not None and name == names[lo]:
                    part = batch.slice(lo, hi - lo)
                    queries = part.column(4).flatten().to_numpy().reshape(hi - lo, -1)
                    place, node, score = shard.search(queries, k + 1, beam)
                    yield pa.RecordBatch.from_arrays([part.column(3).take(pa.array(place)), pa.array(node), pa.array(score)],
                                                     names=["query_id", "node", "score"])
                lo = hi
    return run


def clean_vectors(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vector array<double>) of the rows that take part."""
    vector = F.transform(F.col(vector_col).cast("array<double>"), lambda v: v + F.lit(0.0))  # -0.0 becomes 0.0
    limit = F.lit(float("inf"))
    named = rows.select(F.col(id_col).cast("long").alias("id"), vector.alias("vector")).where(
        F.col("id").isNotNull() & (F.size("vector") > 0)
        & F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < limit)) & F.exists("vector", lambda v: v != 0))
    return named.groupBy("id").agg(F.min("vector").alias("vector"))


def nearest(rows: DataFrame, is_query, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding",
            shard_rows: int = SHARD, beam: int = SEARCH_BEAM) -> DataFrame:
    """(query_id, rank, id, score): the ``k`` nearest other rows found for each row where
    ``is_query(id column)`` holds, by Euclidean distance."""
    vectors = written(clean_vectors(rows, id_col, vector_col), "ann-vectors")
    ranked = vectors.withColumn("place", F.row_number().over(Window.partitionBy("vector").orderBy("id"))).where(F.col("place") <= k + 1)
    members = written(ranked, "ann-members")
    nodes = members.where("place = 1").select("id", "vector", F.size("vector").alias("dim"))
    sizes = nodes.groupBy("dim").agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("shards"))
    dealt = nodes.join(sizes, "dim").withColumn("shard", F.pmod(F.xxhash64("id"), F.col("shards")).cast("int"))
    # a shard is little data but long work, so tasks must not be merged by size
    tasks = max(1, sizes.agg(F.coalesce(F.sum("shards"), F.lit(0))).first()[0])
    shards = dealt.select("dim", "shard", "id", "vector").repartition(tasks, "dim", "shard")
    index = written(shards.groupBy("dim", "shard").applyInPandas(_build_shard, INDEX), "ann-index")

    queries = vectors.where(is_query(F.col("id")))
    asked = queries.select("id", "vector", F.size("vector").alias("dim")).join(index.select("dim", "shard"), "dim")
    empty = [F.lit(None).cast("binary").alias(c) for c in ("ids", "vectors", "graph")]
    stream = index.select("dim", "shard", F.lit(0).alias("role"), F.lit(None).cast("long").alias("id"),
                          F.lit(None).cast("array<double>").alias("vector"), "ids", "vectors", "graph", "entry").unionByName(
        asked.select("dim", "shard", F.lit(1).alias("role"), "id", "vector", *empty, F.lit(None).cast("int").alias("entry")))
    found = stream.repartition("dim", "shard").sortWithinPartitions("dim", "shard", "role") \
        .mapInArrow(_search(k, beam), "query_id long, node long, score double")
    first = Window.partitionBy("query_id").orderBy("score", "node")
    best = written(found.withColumn("place", F.row_number().over(first)).where(F.col("place") <= k + 1).drop("place"), "ann-found")
    same = members.select("id", "vector")
    lists = members.where("place = 1").select(F.col("id").alias("node"), "vector").join(same, "vector").select("node", "id")
    answers = best.join(lists, "node").where("id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "id"))
    return answers.select("query_id", rank.cast("int").alias("rank"), "id", "score").where(F.col("rank") <= k)
