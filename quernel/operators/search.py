"""Exact and approximate nearest-neighbour search over a table of vectors.

A query set is read in blocks of bounded bytes; each block is broadcast, every task scores its rows against it in
tiles and keeps the best k of each query until its end, and the tasks' lists are merged by a window with a pushed-down
group limit.  The corpus is scanned once a block and never shuffled.  ``index`` keeps what is built here in files.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernel.functions.vectors import TINY, has_dim
from quernel.plans.lineage import cut

COSINE, EUCLIDEAN, DOT = "cosine", "euclidean", "dot"
#: Bytes of the queries (or of their look-up tables) that a task holds at once, and numbers in a tile of distances.
BLOCK_BYTES, TILE = 32 << 20, 2_000_000


class DimensionMismatch(ValueError):
    """A vector's length is not the index's."""


class NotTrained(ValueError):
    """An index was asked for what needs training data it does not have."""


@dataclass(frozen=True)
class IndexConfig:
    """Parameters of an index; the presets differ in the graph's width and search effort."""

    dim: int = 1536
    metric: str = COSINE
    kind: str = "hnsw"
    m: int = 16
    ef_construction: int = 200
    ef_search: int = 50

    @classmethod
    def flat(cls, dim: int) -> IndexConfig:
        return cls(dim, kind="flat")

    @classmethod
    def high_accuracy(cls, dim: int) -> IndexConfig:
        return cls(dim, m=32, ef_construction=400, ef_search=100)

    @classmethod
    def fast(cls, dim: int) -> IndexConfig:
        return cls(dim, m=8, ef_construction=100, ef_search=20)


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def distances(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    """Distances (ascending is better) of all rows of ``q`` to all rows of ``x``."""
    if metric == DOT:
        return -(q @ x.T)
    if metric == COSINE:
        nq, nx = np.linalg.norm(q, axis=1), np.linalg.norm(x, axis=1)
        zero = (nq < TINY)[:, None] | (nx < TINY)[None, :]
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(zero, 1.0, 1 - (q @ x.T) / (nq[:, None] * nx[None, :]))
    d = (q**2).sum(1)[:, None] + (x**2).sum(1)[None, :] - 2 * (q @ x.T)
    return np.sqrt(np.maximum(d, 0))


def score(dist: Column, metric: str) -> Column:
    """What a search returns: the similarity for cosine, else the distance itself."""
    return (1 - dist if metric == COSINE else dist) + F.lit(0.0)


def reject_wrong(df: DataFrame, dim: int, vec_col: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """The rows whose vector has the dimension, and the rejected others (null vectors included)."""
    ok = has_dim(vec_col, dim)
    return df.where(ok), df.where(~ok)


def blocks(queries: DataFrame, id_col: str, vec_col: str, dim: int, row_bytes: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The query set in blocks of at most ``BLOCK_BYTES``, with ``row_bytes`` a query (its vector's, if not given)."""
    ids, rows, most = [], [], max(1, BLOCK_BYTES // (row_bytes or 8 * dim))
    for r in queries.select(id_col, vec_col).toLocalIterator():
        if r[1] is None or len(r[1]) != dim:
            raise DimensionMismatch(f"query {r[0]} has not {dim} values")
        ids.append(r[0])
        rows.append(r[1])
        if len(ids) == most:
            yield np.array(ids, np.int64), np.array(rows, np.float64)
            ids, rows = [], []
    if ids:
        yield np.array(ids, np.int64), np.array(rows, np.float64)


class Best:
    """The best k of each query among all rows a task has seen; nine places and then the lesser id decide."""

    def __init__(self, k: int):
        self.k, self.held, self.n = k, [], 0

    def add(self, query: np.ndarray, ids: np.ndarray, dist: np.ndarray) -> None:
        """Distances of all ``query`` (rows) to all ``ids`` (columns)."""
        if not self.k or not dist.size:
            return
        r = np.round(dist, 9)
        if r.shape[1] > self.k:
            i, j = np.nonzero(r <= np.partition(r, self.k - 1, axis=1)[:, self.k - 1 : self.k])
        else:
            i, j = (x.reshape(-1) for x in np.indices(r.shape))
        self.held.append((query[i], ids[j], dist[i, j]))
        self.n += len(i)
        if self.n > 1_000_000:
            self._shrink()

    def _shrink(self) -> None:
        q, ids, dist = (np.concatenate(x) for x in zip(*self.held))
        order = np.lexsort((ids, np.round(dist, 9), q))
        q, ids, dist = q[order], ids[order], dist[order]
        kept = np.arange(len(q)) - np.searchsorted(q, q) < self.k
        self.held, self.n = [(q[kept], ids[kept], dist[kept])], 0

    def batches(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            self._shrink()
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in self.held[0]], ["query_id", "vec_id", "dist"])


def tiles(n_queries: int, n_rows: int) -> Iterator[slice]:
    """Slices of the queries so that a tile with all rows has at most ``TILE`` distances."""
    step = max(1, TILE // max(1, n_rows))
    for lo in range(0, n_queries, step):
        yield slice(lo, lo + step)


def top(lists: DataFrame, k: int) -> DataFrame:
    """``(query_id, vec_id, dist, rank)``: the best k of each query; ties, to nine places, go to the lesser id."""
    best = Window.partitionBy("query_id").orderBy(F.round("dist", 9), "vec_id")
    return lists.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _scored(out: DataFrame | None, like: DataFrame, metric: str) -> DataFrame:
    """What a search returns; no rows if there was no query."""
    if out is None:
        out = like.sparkSession.createDataFrame([], "query_id long, vec_id long, dist double, rank int")
    return out.select("query_id", "rank", "vec_id", score(F.col("dist"), metric).alias("score"))


def knn(queries: DataFrame, corpus: DataFrame, k: int, metric: str = COSINE, dim: int | None = None, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k nearest rows of each query, itself included.

    Vectors of another length than ``dim`` (the first query's, if not given) raise in the query set and are left out
    of the corpus, as are null ones.  k above the corpus gives all its rows, k = 0 or an empty side none.
    """
    if dim is None:
        first = queries.select(F.size(vec_col).alias("n")).first()
        dim = first.n if first and first.n and first.n > 0 else 1
    out = None
    good = corpus.where(has_dim(vec_col, dim)).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("v"))
    for ids, q in blocks(queries, id_col, vec_col, dim):
        shared = corpus.sparkSession.sparkContext.broadcast((ids, q))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            (qi, qv), best = shared.value, Best(k)
            for b in batches:
                if b.num_rows and k:
                    vid, x = b.column(0).to_numpy(), _matrix(b.column(1), dim)
                    for t in tiles(len(qi), len(vid)):
                        best.add(qi[t], vid, distances(qv[t], x, metric))
            yield from best.batches()

        part = top(good.mapInArrow(run, "query_id long, vec_id long, dist double"), k)
        out = part if out is None else out.unionByName(part)
    return _scored(out, corpus, metric)


def scores(queries: DataFrame, corpus: DataFrame, metric: str | Callable[[np.ndarray, np.ndarray], np.ndarray] = DOT, dim: int = 64, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``(query_id, vec_id, dist)`` of every query and every row: the distances of a metric, or of a function of two
    matrices that gives one value a pair.  As many rows as pairs: for few queries."""
    out = None
    good = corpus.where(has_dim(vec_col, dim)).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("v"))
    for ids, q in blocks(queries, id_col, vec_col, dim):
        shared = corpus.sparkSession.sparkContext.broadcast((ids, q))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            qi, qv = shared.value
            for b in batches:
                vid, x = b.column(0).to_numpy(), _matrix(b.column(1), dim)
                for t in tiles(len(qi), len(vid)):
                    d = metric(qv[t], x) if callable(metric) else distances(qv[t], x, metric)
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qi[t], len(vid))), pa.array(np.tile(vid, len(qi[t]))), pa.array(np.asarray(d, np.float64).reshape(-1))], ["query_id", "vec_id", "dist"])

        part = good.mapInArrow(run, "query_id long, vec_id long, dist double")
        out = part if out is None else out.unionByName(part)
    return out if out is not None else corpus.sparkSession.createDataFrame([], "query_id long, vec_id long, dist double")


def recall(found: DataFrame, truth: DataFrame, k: int | None = None, distinct: bool = False) -> DataFrame:
    """``(query_id, recall)``: share of the true neighbours that were found: of the true ones there are (at most
    ``k``, where it is given), or of ``k`` itself by ``recall_of_k``.  ``distinct`` counts a true neighbour once."""
    t = truth.select("query_id", "vec_id")
    t = t.distinct() if distinct else t
    hits = t.join(found.select("query_id", "vec_id", F.lit(1).alias("hit")).distinct(), ["query_id", "vec_id"], "left")
    n = F.count("*") if k is None else F.least(F.count("*"), F.lit(k))
    return hits.groupBy("query_id").agg((F.count("hit") / n).alias("recall"))


def recall_of_k(found: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """``(query_id, recall)``: true neighbours found over ``k``, however few true ones there are."""
    hits = truth.select("query_id", "vec_id").join(found.select("query_id", "vec_id", F.lit(1).alias("hit")).distinct(), ["query_id", "vec_id"], "left")
    return hits.groupBy("query_id").agg((F.count("hit") / F.lit(float(k))).alias("recall"))


# ---- k-means and inverted lists ----------------------------------------------------------------------------------


def nearest(x: np.ndarray, centroids: np.ndarray, metric: str) -> np.ndarray:
    """Index of the nearest centroid of each row; ties to the lowest."""
    return np.argmin(np.round(distances(x, centroids, metric), 12), axis=1)


def kmeans(corpus: DataFrame, clusters: int, rounds: int, metric: str = COSINE, id_col: str = "vec_id", vec_col: str = "embedding") -> np.ndarray:
    """Centroids after exactly ``rounds`` Lloyd rounds from the vectors of the least ids; a cluster that loses all
    members keeps its centroid, means are not normalised.  Each round is one scan; a task returns one sum a cluster."""
    first = corpus.select(id_col, vec_col).where(F.col(vec_col).isNotNull()).orderBy(id_col).limit(clusters).collect()
    if len(first) < clusters:
        raise NotTrained(f"{clusters} clusters need as many vectors")
    c = np.array([r[1] for r in first], np.float64)
    dim = c.shape[1]
    good = corpus.where(has_dim(vec_col, dim)).select(vec_col)
    for _ in range(rounds):
        now = c

        def run(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            s, n = np.zeros(now.shape), np.zeros(len(now), np.int64)
            for b in batches:
                if b.num_rows:
                    x = _matrix(b.column(0), dim)
                    k = nearest(x, now, metric)
                    np.add.at(s, k, x)
                    n += np.bincount(k, minlength=len(now))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(now))), pa.array(n), pa.array(list(s), pa.list_(pa.float64()))], ["k", "n", "s"])

        rows = good.mapInArrow(run, "k long, n long, s array<double>").groupBy("k").agg(F.sum("n").alias("n"), *(F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(dim))).collect()
        c = now.copy()
        for r in rows:
            if r.n:
                c[r.k] = np.array([r[f"s{i}"] for i in range(dim)]) / r.n
    return c


def assigned(corpus: DataFrame, centroids: np.ndarray, metric: str = COSINE, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``(vec_id, part, v)``: every vector with the partition of its nearest centroid."""
    shared, dim = corpus.sparkSession.sparkContext.broadcast(centroids), centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            part = nearest(_matrix(b.column(1), dim), shared.value, metric) if b.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(part, pa.int32()), b.column(1)], ["vec_id", "part", "v"])

    return corpus.where(has_dim(vec_col, dim)).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("v")).mapInArrow(run, "vec_id long, part int, v array<float>")


def ivf_search(queries: DataFrame, postings: DataFrame, centroids: np.ndarray, k: int, nprobe: int, metric: str = COSINE, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)`` among the ``nprobe`` partitions nearest to each query; may give fewer than
    k rows.  ``postings`` is what ``assigned`` gives; written by partition, a probe prunes the others' files."""
    dim, out = centroids.shape[1], None
    nprobe = min(max(1, nprobe), len(centroids))
    for ids, q in blocks(queries, id_col, vec_col, dim):
        probes = np.lexsort((np.broadcast_to(np.arange(len(centroids)), (len(q), len(centroids))), np.round(distances(q, centroids, metric), 12)), axis=1)[:, :nprobe]
        mask = np.zeros((len(q), len(centroids)), bool)
        np.put_along_axis(mask, probes, True, axis=1)
        shared = postings.sparkSession.sparkContext.broadcast((ids, q, mask))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            (qi, qv, probed), best = shared.value, Best(k)
            for b in batches:
                vid, part = b.column(0).to_numpy(), b.column(1).to_numpy()
                for p in np.unique(part):
                    rows, who = np.flatnonzero(part == p), np.flatnonzero(probed[:, p])
                    if len(who):
                        x = _matrix(b.column(2).take(pa.array(rows)), dim)
                        for t in tiles(len(who), len(rows)):
                            best.add(qi[who[t]], vid[rows], distances(qv[who[t]], x, metric))
            yield from best.batches()

        part = top(postings.where(F.col("part").isin([int(p) for p in np.unique(probes)])).select("vec_id", "part", "v").mapInArrow(run, "query_id long, vec_id long, dist double"), k)
        out = part if out is None else out.unionByName(part)
    return _scored(out, postings, metric)


# ---- product quantization ----------------------------------------------------------------------------------------


def pq_train(corpus: DataFrame, subspaces: int, clusters: int, rounds: int, id_col: str = "vec_id", vec_col: str = "embedding") -> np.ndarray:
    """Codebooks (subspaces x clusters x width): independent Euclidean k-means in each subspace, from the vectors of
    the least ids.  A round is one scan for all subspaces; a task returns one sum a codebook entry."""
    first = corpus.select(id_col, vec_col).where(F.col(vec_col).isNotNull()).orderBy(id_col).limit(clusters).collect()
    dim = len(first[0][1]) if first else 0
    if dim % subspaces or clusters > 256:
        raise ValueError("the dimension must be a multiple of the subspaces, and codes fit a byte")
    if len(first) < clusters:
        raise NotTrained(f"{clusters} clusters need as many vectors")
    w = dim // subspaces
    books = np.array([r[1] for r in first], np.float64).reshape(clusters, subspaces, w).transpose(1, 0, 2)
    good = corpus.where(has_dim(vec_col, dim)).select(vec_col)
    for _ in range(rounds):
        now = books

        def run(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            s, n = np.zeros(now.shape), np.zeros(now.shape[:2], np.int64)
            for b in batches:
                if b.num_rows:
                    x = _matrix(b.column(0), dim).reshape(-1, subspaces, w)
                    for m in range(subspaces):
                        k = nearest(x[:, m], now[m], EUCLIDEAN)
                        np.add.at(s[m], k, x[:, m])
                        n[m] += np.bincount(k, minlength=clusters)
            at = np.flatnonzero(n.reshape(-1))
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n.reshape(-1)[at]), pa.array(list(s.reshape(-1, w)[at]), pa.list_(pa.float64()))], ["at", "n", "s"])

        books = now.copy().reshape(-1, w)
        for r in good.mapInArrow(run, "at long, n long, s array<double>").groupBy("at").agg(F.sum("n").alias("n"), *(F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(w))).collect():
            books[r["at"]] = np.array([r[f"s{i}"] for i in range(w)]) / r.n
        books = books.reshape(now.shape)
    return books


def pq_encode(corpus: DataFrame, books: np.ndarray, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``(vec_id, code array<int>)``: the nearest centroid of each subspace, ties to the lowest."""
    m, _, w = books.shape
    shared = corpus.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(1), m * w)
            code = np.stack([nearest(x[:, s * w : (s + 1) * w], shared.value[s], EUCLIDEAN) for s in range(m)], axis=1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(code), pa.list_(pa.int32()))], ["vec_id", "code"])

    return corpus.where(has_dim(vec_col, m * w)).select(F.col(id_col).cast("long").alias("vec_id"), vec_col).mapInArrow(run, "vec_id long, code array<int>")


def pq_search(queries: DataFrame, codes: DataFrame, books: np.ndarray, k: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)`` by the sum of table look-ups: the squared distance to the decoded vector."""
    m, c, w = books.shape
    out = None
    shared_books = codes.sparkSession.sparkContext.broadcast(books)
    for ids, q in blocks(queries, id_col, vec_col, m * w, 8 * m * c):
        shared = codes.sparkSession.sparkContext.broadcast((ids, q))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            (qi, qv), best, table = shared.value, Best(k), None
            for b in batches:
                if b.num_rows:
                    if table is None:  # of a task, so that it need not travel; bounded by the block
                        table = ((qv.reshape(len(qv), m, 1, w) - shared_books.value[None]) ** 2).sum(-1)
                    vid, code = b.column(0).to_numpy(), b.column(1).flatten().to_numpy().reshape(-1, m)
                    for t in tiles(len(qi), len(vid)):
                        best.add(qi[t], vid, sum(table[t, s][:, code[:, s]] for s in range(m)))
            yield from best.batches()

        part = top(codes.mapInArrow(run, "query_id long, vec_id long, dist double"), k)
        out = part if out is None else out.unionByName(part)
    return _scored(out, codes, DOT)


def compression_ratio(dim: int, subspaces: Column | int) -> Column:
    """Bytes of a vector over the bytes of its code."""
    return F.lit(dim * 4.0) / (subspaces if isinstance(subspaces, Column) else F.lit(subspaces))


# ---- proximity graphs, one a shard -------------------------------------------------------------------------------


class Graph:
    """A layered proximity graph over the rows of a matrix, built one row after the other."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, metric: str, m: int, ef: int):
        if m < 2:
            raise ValueError("m must be at least 2")
        self.x, self.metric, self.m, self.ef = x, metric, m, ef
        if metric == COSINE:
            n = np.linalg.norm(x, axis=1, keepdims=True)
            self.x = np.where(n < TINY, 0, x / np.maximum(n, TINY))
        # levels from the ids, so the same shard gives the same graph
        u = np.array([np.random.default_rng(int(i) & 0x7FFFFFFF).random() for i in ids])
        self.level = np.floor(-np.log(np.maximum(u, 1e-12)) / np.log(m)).astype(int)
        self.links: list[list[list[int]]] = [[[] for _ in range(lv + 1)] for lv in self.level]
        self.entry = -1
        for i in range(len(x)):
            self._insert(i)

    def _dist(self, q: np.ndarray, rows: list[int]) -> np.ndarray:
        y = self.x[rows]
        return np.linalg.norm(y - q, axis=1) if self.metric == EUCLIDEAN else (1 - y @ q if self.metric == COSINE else -(y @ q))

    def _layer(self, q: np.ndarray, starts: list[int], ef: int, level: int) -> list[tuple[float, int]]:
        seen = set(starts)
        d = self._dist(q, starts)
        cand = sorted(zip(d.tolist(), starts))
        heapq.heapify(cand)
        kept = [(-a, b) for a, b in cand]
        heapq.heapify(kept)
        while cand:
            a, b = heapq.heappop(cand)
            if len(kept) >= ef and a > -kept[0][0]:
                break
            new = [n for n in self.links[b][level] if n not in seen]
            seen.update(new)
            for dn, n in zip(self._dist(q, new).tolist() if new else (), new):
                if len(kept) < ef or dn < -kept[0][0]:
                    heapq.heappush(cand, (dn, n))
                    heapq.heappush(kept, (-dn, n))
                    if len(kept) > ef:
                        heapq.heappop(kept)
        return sorted((-a, b) for a, b in kept)

    def _insert(self, i: int) -> None:
        if self.entry < 0:
            self.entry = i
            return
        q, at, top_level = self.x[i], [self.entry], int(self.level[self.entry])
        for lv in range(top_level, self.level[i], -1):
            at = [self._layer(q, at, 1, lv)[0][1]]
        for lv in range(min(top_level, int(self.level[i])), -1, -1):
            near = self._layer(q, at, self.ef, lv)
            most = 2 * self.m if lv == 0 else self.m
            self.links[i][lv] = [b for _, b in near[: self.m]]
            for b in self.links[i][lv]:
                mine = self.links[b][lv]
                mine.append(i)
                if len(mine) > most:
                    d = self._dist(self.x[b], mine)
                    self.links[b][lv] = [mine[j] for j in np.argsort(d, kind="stable")[:most]]
            at = [b for _, b in near]
        if self.level[i] > top_level:
            self.entry = i

    def search(self, q: np.ndarray, k: int, ef: int) -> list[tuple[float, int]]:
        if self.entry < 0:
            return []
        if self.metric == COSINE:
            n = np.linalg.norm(q)
            q = q / n if n >= TINY else q * 0
        at = [self.entry]
        for lv in range(int(self.level[self.entry]), 0, -1):
            at = [self._layer(q, at, 1, lv)[0][1]]
        return self._layer(q, at, max(ef, k), 0)[:k]


def hnsw_build(corpus: DataFrame, config: IndexConfig, shards: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``(shard, graph)``: the corpus dealt by hash into shards, and the graph of each as one row.  Write it once; a
    search reads it.  Of rows with one id any is taken."""
    dealt = corpus.where(has_dim(vec_col, config.dim)).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("v")).dropDuplicates(["vec_id"]).withColumn("shard", shard_of("vec_id", shards))

    def run(key, pdf):
        pdf = pdf.sort_values("vec_id")
        vid = pdf["vec_id"].to_numpy()
        g = Graph(np.array(pdf["v"].tolist(), np.float64), vid, config.metric, config.m, config.ef_construction)
        g.x, g.ids = g.x.astype(np.float32), vid
        return type(pdf)({"shard": [int(key[0])], "graph": [pickle.dumps(g, protocol=5)]})

    return dealt.groupBy("shard").applyInPandas(run, "shard int, graph binary")


def shard_of(id_col: str, shards: int) -> Column:
    return F.pmod(F.xxhash64(id_col), F.lit(shards)).cast("int")


def hnsw_query(queries: DataFrame, graphs: DataFrame, k: int, config: IndexConfig, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: every stored graph answers all queries, and the answers are merged."""
    out = None
    for ids, q in blocks(queries, id_col, vec_col, config.dim):
        shared = graphs.sparkSession.sparkContext.broadcast((ids, q))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            (qi, qv), best = shared.value, Best(k)
            for b in batches:
                for raw in b.column(0):
                    g = pickle.loads(raw.as_py())  # noqa: S301 - our own files
                    g.x = g.x.astype(np.float64)
                    for i, v in zip(qi, qv):
                        near = g.search(v, k, config.ef_search)
                        if near:
                            best.add(np.array([i]), g.ids[[n for _, n in near]], np.array([[d for d, _ in near]]))
            yield from best.batches()

        part = top(graphs.select("graph").mapInArrow(run, "query_id long, vec_id long, dist double"), k)
        out = part if out is None else out.unionByName(part)
    return _scored(out, graphs, config.metric)


def hnsw_search(queries: DataFrame, corpus: DataFrame, k: int, config: IndexConfig, shard_rows: int = 2000, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``hnsw_build`` and ``hnsw_query`` in one, with the graphs written between, so no search builds them again."""
    graphs = cut(hnsw_build(corpus, config, max(1, -(-corpus.count() // shard_rows)), id_col, vec_col))
    return hnsw_query(queries, graphs, k, config, id_col, vec_col)
