"""The most similar vectors of every vector, by cross-polytope hashing.

Unit vectors are rotated pseudo-randomly and fall to the nearest signed axis.  Two such digits make the key of one
table (more as the collection grows, so that buckets keep their size, and then more tables and probes as well); the vector is also put under the key whose
weakest digit is replaced by its second best axis.  Within a bucket 128 signs of two further rotations are compared,
and the pairs that pass are verified with the vectors themselves.

Vectors with equal values are one class: hashed, compared and verified once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernel.llm.buckets import binary, near_pairs, payloads
from quernel.llm.text import mix
from quernel.llm.vectors import matrix, padded, rotate, usable
from quernel.plans.lineage import cut, release


@dataclass(frozen=True)
class Search:
    """Pairs of at least ``cosine`` are sought.  Of 128 signs, vectors at 0.90 differ in 18 on average with a
    deviation of 3 (rotations are orthogonal, so less than by chance): up to ``differing`` keeps all but a few of ten
    thousand.  On this project's vectors seven tables with two probes meet 99.9 % of the pairs at 0.90 or more.
    More digits are met more rarely: ``enough`` then adds tables and probes, so that of random pairs at ``cosine`` at
    least ``recall`` meet whatever the size of the collection.  ``bucket`` is the mean size a bucket is to have; in one
    above ``dense`` rows the vectors themselves are compared and only the nearest of each leave the task.  A class of
    copies meets its list in parts of ``members``."""

    dim: int = 64
    cosine: float = 0.90
    tables: int = 7
    probes: int = 2
    differing: int = 28
    bucket: int = 32
    dense: int = 2048
    members: int = 100_000
    recall: float = 0.99


def _digits(x: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest and second nearest signed axis of each row, and the margin between them."""
    y = rotate(x, seed)
    size, rows = np.abs(y), np.arange(len(y))
    best = size.argmax(axis=1)
    top = size[rows, best]
    size[rows, best] = -1
    second = size.argmax(axis=1)
    return best * 2 + (y[rows, best] > 0), second * 2 + (y[rows, second] > 0), top - size[rows, second]


def keys(x: np.ndarray, how: Search, digits: int) -> np.ndarray:
    """``tables * probes`` bucket keys of each unit vector."""
    x = padded(x)
    axes = 2 * x.shape[1]
    out = []
    for t in range(how.tables):
        parts = [_digits(x, 1000 * t + k) for k in range(digits)]
        first = np.zeros(len(x), np.int64)
        for best, _, _ in parts:
            first = first * axes + best
        out.append(first + 0)
        order = np.argsort(np.stack([m for _, _, m in parts]), axis=0)
        for p in range(min(how.probes - 1, digits)):
            key = np.zeros(len(x), np.int64)
            for k, (best, second, _) in enumerate(parts):
                key = key * axes + np.where(order[p] == k, second, best)
            out.append(key)
    table = np.repeat(np.arange(how.tables), len(out) // how.tables).astype(np.uint64)
    return mix(np.stack(out, axis=1).astype(np.uint64) * np.uint64(how.tables) + table).view(np.int64)


def met(how: Search, digits: int, pairs: int = 4000) -> np.ndarray:
    """The share of random pairs at ``how.cosine`` that meet in the first table, the first two, and so on."""
    rng = np.random.default_rng(5)
    x, z = rng.standard_normal((2, pairs, how.dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= np.einsum("ij,ij->i", x, z)[:, None] * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    y = how.cosine * x + math.sqrt(1 - how.cosine**2) * z
    a, b = (keys(v.astype(np.float32), how, digits).reshape(pairs, how.tables, -1) for v in (x, y))
    return np.logical_or.accumulate((a[:, :, :, None] == b[:, :, None, :]).any(axis=(2, 3)), axis=1).mean(axis=0)


def enough(how: Search, digits: int) -> Search:
    """``how`` with as many tables and probes as keys of so many digits need for ``how.recall``."""
    if how.cosine >= 1 or how.dim < 2 or met(how, digits)[-1] >= how.recall:
        return how
    more = replace(how, probes=max(how.probes, digits))
    while (share := met(more, digits))[-1] < how.recall:
        more = replace(more, tables=2 * more.tables)
    return replace(more, tables=max(how.tables, int(np.argmax(share >= how.recall)) + 1))


def signs(x: np.ndarray) -> np.ndarray:
    """128 signs of two rotations, as 16 bytes a row."""
    x = padded(x)
    bits = np.concatenate([rotate(x, -s & 0xFFFF) > 0 for s in range(1, 1 + -(-128 // x.shape[1]))], axis=1)[:, :128]
    return np.packbits(bits, axis=1)


def _few_differ(most: int):
    def test(a: np.ndarray, b: np.ndarray, aligned: bool = False) -> tuple[np.ndarray, np.ndarray]:
        a, b = np.ascontiguousarray(a).view(np.uint64), np.ascontiguousarray(b).view(np.uint64)
        if aligned:
            i = np.flatnonzero(np.bitwise_count(a ^ b).sum(axis=1) <= most)
            return i, i
        found_i, found_j = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for lo in range(0, len(a), 512):
            d = np.bitwise_count(a[lo : lo + 512, None, 0] ^ b[None, :, 0]) + np.bitwise_count(a[lo : lo + 512, None, 1] ^ b[None, :, 1])
            i, j = np.nonzero(d <= most)
            found_i.append(i + lo)
            found_j.append(j)
        return np.concatenate(found_i), np.concatenate(found_j)

    return test


def _nearest_within(k: int, cosine: float, dim: int):
    """A test of unit vectors (bytes of ``dim`` floats each): the pairs from ``cosine`` of which one is among the ``k``
    nearest of the other there, ties included.  What a dense bucket sends on grows with its rows, not their pairs."""

    def test(a: np.ndarray, b: np.ndarray, aligned: bool = False) -> tuple[np.ndarray, np.ndarray]:
        x, y = (np.ascontiguousarray(v).view(np.float32) for v in (a, b))
        if aligned:
            i = np.flatnonzero(np.einsum("ij,ij->i", x, y) >= cosine - 1e-5)
            return i, i
        found, least = [], np.full((len(y), k), -2, np.float32)
        for lo in range(0, len(x), 1024):
            s = x[lo : lo + 1024] @ y.T
            if a is b:
                s[np.arange(len(s)), lo + np.arange(len(s))] = -2
            bar = np.partition(s, -k, axis=1)[:, -k] if s.shape[1] > k else np.full(len(s), -2, np.float32)
            i, j = np.nonzero((s >= bar[:, None]) & (s >= cosine - 1e-5))
            found.append((i + lo, j))
            least = np.partition(np.concatenate([least, s.T], axis=1), -k, axis=1)[:, -k:]
        bar = least.min(axis=1)
        for lo in range(0, len(x), 1024):
            s = x[lo : lo + 1024] @ y.T
            if a is b:
                s[np.arange(len(s)), lo + np.arange(len(s))] = -2
            i, j = np.nonzero((s >= bar[None, :]) & (s >= cosine - 1e-5))
            found.append((i + lo, j))
        i, j = (np.concatenate(z) for z in zip(*found))
        return (np.concatenate([i, j]), np.concatenate([j, i])) if a is b else (i, j)

    return test


def _class(v: str) -> Column:
    return F.xxhash64(v)


def _as_bytes(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), binary(matrix(batch.column(1), dim))], ["item", "vector"])

    return run


def hashed(df: DataFrame, vec_col: str, how: Search, digits: int) -> DataFrame:
    """``(key, item, payload)`` rows of the usable vectors; a class is sent once for each batch it is in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            klass, first = np.unique(batch.column(0).to_numpy(), return_index=True)
            if not len(klass):
                continue
            x = matrix(batch.column(1).take(pa.array(first)), how.dim)
            k = keys(x, how, digits)
            load = np.repeat(signs(x), k.shape[1], axis=0).tobytes()
            n = k.size
            payload = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, 16 * n + 1, 16, dtype=np.int32)), pa.py_buffer(load)])
            yield pa.RecordBatch.from_arrays([pa.array(k.reshape(-1)), pa.array(np.repeat(klass, k.shape[1])), payload], ["key", "item", "payload"])

    return df.where(usable(vec_col, how.dim)).select(_class(vec_col).alias("item"), vec_col).mapInArrow(run, "key long, item long, payload binary")


def similar_classes(df: DataFrame, id_col: str = "id", vec_col: str = "embedding", how: Search = Search(), k: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Two tables: members ``(id, class)`` of the usable vectors, and ``(a, b, cosine)``, a < b, of the classes with
    at least ``cosine``; with ``k``, of buckets above ``how.dense`` rows those of which one is among the ``k`` nearest
    of the other.  Rows repeated under one id count once."""
    good = df.where(usable(vec_col, how.dim))
    members = cut(good.select(F.col(id_col).alias("id"), _class(vec_col).alias("class")).distinct())
    n = df.count()
    digits = max(1, math.ceil(math.log(max(1, n / how.bucket)) / math.log(2 * 2 ** math.ceil(math.log2(how.dim)))))

    def vectors_of(rows: DataFrame) -> DataFrame:
        """Rows of dense buckets with their vectors in place of signs."""
        item = rows.select("item").distinct()
        own = good.select(_class(vec_col).alias("item"), F.col(vec_col).alias("v")).join(item, "item", "left_semi").dropDuplicates(["item"]).mapInArrow(_as_bytes(how.dim), "item long, vector binary")
        return rows.join(own, "item").withColumn("payload", F.col("vector"))

    dense = (vectors_of, _nearest_within(k, how.cosine, how.dim), 4 * how.dim) if k else None
    candidates = near_pairs(hashed(df, vec_col, enough(how, digits), digits), _few_differ(how.differing), 16, how.dense if k else 4096, dense=dense)
    wanted = candidates.select(F.explode(F.array("a", "b")).alias("class")).distinct()
    lead = members.join(wanted, "class", "left_semi").groupBy("class").agg(F.min("id").alias("_lead")).select("_lead")
    vectors = cut(good.join(lead, F.col(id_col) == F.col("_lead"), "left_semi").select(_class(vec_col).alias("class"), F.col(vec_col).alias("v")).dropDuplicates(["class"]))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                c = np.einsum("ij,ij->i", matrix(batch.column(2), how.dim).astype(np.float64), matrix(batch.column(3), how.dim))
                hit = pa.array(c >= how.cosine)
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(hit), batch.column(1).filter(hit), pa.array(c).filter(hit)], ["a", "b", "cosine"])

    pairs = (
        candidates.join(vectors.select(F.col("class").alias("a"), F.col("v").alias("x")), "a")
        .join(vectors.select(F.col("class").alias("b"), F.col("v").alias("y")), "b")
        .select("a", "b", "x", "y")
        .mapInArrow(verify, "a long, b long, cosine double")
    )
    pairs = cut(pairs)
    release(candidates, vectors)
    return members, pairs


def neighbours(df: DataFrame, k: int = 5, id_col: str = "id", vec_col: str = "embedding", how: Search = Search()) -> DataFrame:
    """``(id, other_id, cosine, rank)``: of each usable vector the ``k`` most similar others among those with at
    least ``how.cosine``; ties, to six places, go to the lesser id.

    A vector is usable if it has ``how.dim`` finite values, not all zero; others, and nulls, give no row.  Copies
    under different ids are neighbours at cosine 1.  Further columns are ignored; an empty table gives no rows.
    """
    members, pairs = similar_classes(df, id_col, vec_col, how, k + 1)
    pairs = pairs.withColumn("cosine", F.round("cosine", 6))
    # A class needs only the k + 1 least ids of every class near it, itself included.
    firsts = cut(members.withColumn("_n", F.row_number().over(Window.partitionBy("class").orderBy("id"))).where(F.col("_n") <= k + 1).drop("_n"))
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "cosine"))
    own = firsts.groupBy("class").count().where("count > 1").select(F.col("class").alias("a"), F.col("class").alias("b"), F.lit(1.0).alias("cosine"))
    near = both.unionByName(own).join(firsts.select(F.col("class").alias("b"), F.col("id").alias("other_id")), "b")
    best = Window.partitionBy("a").orderBy(F.desc("cosine"), "other_id")
    lists = near.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= k + 1).groupBy(F.col("a").alias("class")).agg(F.sort_array(F.collect_list(F.struct((-F.col("cosine")).alias("c"), "other_id"))).alias("near"))
    # One list a class, of at most k + 1, meets its members; a class of very many is dealt into parts.
    parts = members.groupBy("class").agg(F.ceil(F.count("*") / how.members).cast("int").alias("parts")).where("parts > 1")
    dealt = members.join(parts, "class", "left").select("class", "id", F.pmod(F.xxhash64("id"), F.coalesce("parts", F.lit(1)).cast("long")).alias("part"))
    copied = lists.join(parts, "class", "left").select("class", "near", F.explode(F.sequence(F.lit(0).cast("long"), (F.coalesce("parts", F.lit(1)) - 1).cast("long"))).alias("part"))
    mine = dealt.join(copied, ["class", "part"]).select("id", F.slice(F.filter("near", lambda n: n["other_id"] != F.col("id")), 1, k).alias("near"))
    # an id with several vectors has a list for each
    rank = Window.partitionBy("id").orderBy(F.desc("cosine"), "other_id")
    laid = mine.select("id", F.explode("near").alias("n")).groupBy("id", F.col("n.other_id").alias("other_id")).agg((-F.min("n.c")).alias("cosine"))
    return laid.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k).select("id", "other_id", "cosine", "rank")


def found(df: DataFrame, k: int = 5, id_col: str = "id", vec_col: str = "embedding", how: Search = Search()) -> DataFrame:
    """``(id_a, id_b)``, id_a < id_b: vectors of which one is among the ``k`` most similar of the other."""
    near = neighbours(df, k, id_col, vec_col, how)
    return near.select(F.least("id", "other_id").alias("id_a"), F.greatest("id", "other_id").alias("id_b")).distinct()


# ---- the k nearest at any distance -----------------------------------------------------------------------------------


@dataclass(frozen=True)
class Nearest:
    """Tables of keys of one digit or two (two from about 200,000 rows; ``bucket`` rows are in one bucket in the mean
    up to two million).  Keys of more digits would be met too seldom, so buckets grow beyond that size and are dealt
    into parts: recall does not fall, but the rows that a query meets grow with the table.  A query visits ``probes`` each: those whose axes are nearest to it.  On 200,000 of this project's vectors, with
    two digits, that reaches 6 % of the rows.  ``hot`` rows of one key make a bucket that is dealt into several;
    ``spare`` candidates more than k are reranked."""

    dim: int = 64
    tables: int = 8
    probes: int = 50
    bucket: int = 96
    digits: int = 2
    hot: int = 4096
    spare: int = 10


def _axis_scores(x: np.ndarray, seed: int) -> np.ndarray:
    """Of each row, how near every signed axis is: twice as many columns, axis by axis, minus before plus."""
    y = rotate(x, seed)
    return np.stack([-y, y], axis=2).reshape(len(x), -1)


def _nearest_keys(x: np.ndarray, how: Nearest, digits: int, probes: int) -> np.ndarray:
    """The best ``probes`` keys in each table, in the order of the summed nearness of their axes."""
    x = padded(x)
    axes, out = 2 * x.shape[1], []
    for t in range(how.tables):
        key, total = np.zeros((len(x), 1), np.int64), np.zeros((len(x), 1), np.float32)
        for d in range(digits):
            s = _axis_scores(x, 50_000 + 1000 * t + d)
            wide = min(axes, 1 if probes == 1 else 24)
            top = np.argpartition(-s, wide - 1, axis=1)[:, :wide]
            total = (total[:, :, None] + np.take_along_axis(s, top, 1)[:, None, :]).reshape(len(x), -1)
            key = (key[:, :, None] * axes + top[:, None, :]).reshape(len(x), -1)
            if key.shape[1] > probes:
                best = np.argpartition(-total, probes - 1, axis=1)[:, :probes]
                key, total = np.take_along_axis(key, best, 1), np.take_along_axis(total, best, 1)
        key = np.take_along_axis(key, np.argsort(-total, axis=1), 1)
        out.append(mix(key.astype(np.uint64) * np.uint64(how.tables) + np.uint64(t)).view(np.int64))
    return np.concatenate(out, axis=1)


def _keyed(df: DataFrame, how: Nearest, digits: int, probes: int) -> DataFrame:
    """``(key, id, load)``: every vector under its keys, as one byte a value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                x = matrix(part.column(1), how.dim)
                k = _nearest_keys(x, how, digits, probes)
                small = np.clip(np.round(x * 127), -127, 127).astype(np.int8)
                n = k.size
                load = np.repeat(small, k.shape[1], axis=0).tobytes()
                at = np.arange(0, how.dim * n + 1, how.dim, dtype=np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(k.reshape(-1)), pa.array(np.repeat(part.column(0).to_numpy(), k.shape[1])), pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(at), pa.py_buffer(load)])], ["key", "id", "load"])

    return df.mapInArrow(run, "key long, id long, load binary")


def nearest(queries: DataFrame, df: DataFrame, k: int = 5, id_col: str = "id", vec_col: str = "embedding", how: Nearest = Nearest()) -> DataFrame:
    """``(id, other_id, cosine, rank)``: the k most similar other vectors of each query, whatever their cosine, with
    little loss.  ``queries`` are rows of ``df``; rows repeated under one id count once; unusable vectors take no
    part; ties go to the lesser id; an empty table gives no rows."""
    good = df.where(usable(vec_col, how.dim)).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v"))
    asked = queries.where(usable(vec_col, how.dim)).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v"))
    digits = min(how.digits, max(1, round(math.log(max(1, df.count() / how.bucket)) / math.log(2 * 2 ** math.ceil(math.log2(how.dim))))))
    rows = cut(_keyed(good, how, digits, 1))
    hot = cut(rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > how.hot).select("key", F.ceil(F.col("n") / how.hot).cast("int").alias("parts")))
    parts = F.coalesce("parts", F.lit(1))
    dealt = rows.join(hot, "key", "left").select("key", F.pmod(F.xxhash64("id"), parts).cast("int").alias("part"), F.lit(False).alias("asks"), "id", "load")
    probes = _keyed(asked, how, digits, how.probes).join(hot, "key", "left").select("key", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.lit(True).alias("asks"), "id", "load")
    keep = k + how.spare

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, loads = None, [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            key, part, asks, who = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            load = payloads(batch.column(4), how.dim).view(np.int8)
            edges = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (part[1:] != part[:-1]) | (asks[1:] != asks[:-1]), [True]]))
            found = []
            for a, b in zip(edges, edges[1:]):
                bucket = (key[a], part[a])
                if bucket != at:
                    at, ids, loads = bucket, [], []
                if not asks[a]:
                    ids.append(who[a:b])
                    loads.append(load[a:b])
                elif ids:
                    i, m = np.concatenate(ids), np.concatenate(loads).astype(np.float32)
                    for lo in range(a, b, 1024):
                        q = slice(lo, min(b, lo + 1024))
                        s = load[q].astype(np.float32) @ m.T
                        n = min(keep, len(i))
                        best = np.argpartition(-s, n - 1, axis=1)[:, :n]
                        found.append((np.repeat(who[q], n), i[best].reshape(-1), np.take_along_axis(s, best, 1).reshape(-1)))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found)], ["id", "other_id", "near"])

    met = dealt.unionByName(probes).repartition("key", "part").sortWithinPartitions("key", "part", "asks").mapInArrow(run, "id long, other_id long, near float")
    rough = met.where("id <> other_id").groupBy("id", "other_id").agg(F.max("near").alias("near"))
    first = Window.partitionBy("id").orderBy(F.desc("near"), "other_id")
    short = cut(rough.withColumn("n", F.row_number().over(first)).where(F.col("n") <= keep).select("id", "other_id"))
    theirs = good.join(short.select(F.col("other_id").alias("id")).distinct(), "id", "left_semi").dropDuplicates(["id"]).select(F.col("id").alias("other_id"), F.col("v").alias("w"))

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                c = np.einsum("ij,ij->i", matrix(batch.column(2), how.dim).astype(np.float64), matrix(batch.column(3), how.dim))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(c)], ["id", "other_id", "cosine"])

    scored = short.join(asked.dropDuplicates(["id"]), "id").join(theirs, "other_id").select("id", "other_id", "v", "w").mapInArrow(exact, "id long, other_id long, cosine double")
    rank = Window.partitionBy("id").orderBy(F.desc(F.round("cosine", 9)), "other_id")
    return scored.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)
