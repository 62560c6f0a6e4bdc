"""Similar pairs out of hashed buckets, without emitting a bucket's pairs and without collecting a hot bucket.

Rows ``(key, item, payload)`` are brought together by ``key``.  A test compares payloads block against block in
numpy, and only pairs that pass it leave the task.  A bucket of more than ``block`` rows is not compared in one place:
its rows are spread over squares of blocks, so every pair is still compared, by many tasks, none of which holds more
than two blocks.  Keys that are many in a batch already are found before the shuffle and never meet in one task; the
others that turn out to be too large are sent on, payloads and all, from where they met: rows are not made again for them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.plans.lineage import cut, release

Test = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def payloads(column: pa.Array, width: int) -> np.ndarray:
    """A long column as it is, a binary column of ``width`` bytes each as a matrix."""
    if not width:
        return column.to_numpy(zero_copy_only=False)
    flat = np.frombuffer(column.buffers()[2], np.uint8) if len(column) else np.zeros(0, np.uint8)
    return flat[column.offset * width : (column.offset + len(column)) * width].reshape(-1, width)


def binary(rows: np.ndarray) -> pa.Array:
    """A binary column of the rows of a matrix, the inverse of ``payloads``."""
    n = len(rows)
    flat = np.ascontiguousarray(rows).view(np.uint8).reshape(n, -1) if n else np.zeros((0, 1), np.uint8)
    ends = np.arange(0, n * flat.shape[1] + 1, flat.shape[1], dtype=np.int32)[: n + 1]
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends), pa.py_buffer(flat.tobytes())])


def whole_runs(batches: Iterator[pa.RecordBatch], columns: Callable[[pa.RecordBatch], list[np.ndarray]], least: int = 50_000) -> Iterator[list[np.ndarray]]:
    """The columns of sorted batches in pieces of about ``least`` rows that never divide a run of equal first values."""
    held, n, want = [], 0, least
    for b in batches:
        if not b.num_rows:
            continue
        held.append(columns(b))
        n += b.num_rows
        if n < want:
            continue
        cols = [np.concatenate(c) for c in zip(*held)]
        edge = int(np.searchsorted(cols[0], cols[0][-1]))
        if edge:
            yield [c[:edge] for c in cols]
        held, n = [[c[edge:] for c in cols]], n - edge
        want = max(least, 2 * n)
    if n:
        yield [np.concatenate(c) for c in zip(*held)]


def _compare(item_a, load_a, item_b, load_b, same: bool, test: Test) -> tuple[np.ndarray, np.ndarray]:
    i, j = test(load_a, load_b)
    a, b = item_a[i], item_b[j]
    keep = a < b if same else a != b
    a, b = a[keep], b[keep]
    return np.minimum(a, b), np.maximum(a, b)


def _batches(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    a, b = (np.concatenate(x) if found else np.zeros(0, np.int64) for x in (zip(*found) if found else ((), ())))
    if len(a):  # a pair met in several buckets of this task leaves it once
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        first = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        a, b = a[first], b[first]
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _frequent(rows: DataFrame, block: int) -> DataFrame:
    """``(key, size)`` of the keys that are certainly above ``block``: counted where they are frequent in a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key, n = np.unique(b.column(0).to_numpy(), return_counts=True)
            many = n >= 16
            yield pa.RecordBatch.from_arrays([pa.array(key[many]), pa.array(n[many], pa.int64())], ["key", "n"])

    return rows.select("key").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("size")).where(F.col("size") > block)


def near_pairs(rows: DataFrame, test: Test, width: int = 0, block: int = 4096, batch: int = 200_000, dense: tuple[Callable[[DataFrame], DataFrame], Test, int] | None = None) -> DataFrame:
    """``(a, b)``, a < b: different items that share a key and whose payloads pass ``test``; each pair once.

    ``rows`` has ``key`` long, ``item`` long and ``payload`` (long, or binary of ``width`` bytes).  ``test`` takes two
    arrays of payloads and returns the index pairs that pass.  An item twice under a key counts once.  ``dense``
    replaces, for buckets above ``block``, the payloads (a function of the rows), the test and the width.  The result
    is a table of its own (see ``cut``); ``rows`` is read more than once.
    """
    kind, replaced = pa.binary() if width else pa.int64(), dense is not None

    def sent(key: np.ndarray, item: np.ndarray, load: np.ndarray, size: int) -> pa.RecordBatch:
        """Rows of a bucket that is too large; payloads that ``dense`` replaces stay behind."""
        n = len(key)
        carried = pa.nulls(n, kind) if replaced else binary(load) if width else pa.array(load, kind)
        return pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.nulls(n, pa.int64()), pa.array(key, pa.int64()), pa.array(np.full(n, size), pa.int64()), carried], ["a", "b", "hot", "size", "payload"])

    def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def work(key, item, load) -> Iterator[pa.RecordBatch]:
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            sizes = np.diff(np.append(starts, len(key)))
            found = []
            two = starts[sizes == 2]  # most buckets: compared all at once
            if len(two):
                found.append(_pairs_of_two(item, load, two, test))
            for s, n in zip(starts[sizes > 2], sizes[sizes > 2]):
                if n > block:
                    continue
                it, ld = item[s : s + n], load[s : s + n]
                if n > 16:
                    it, first = np.unique(it, return_index=True)
                    ld = ld[first]
                found.append(_compare(it, ld, it, ld, True, test))
            pairs = _batches(found)
            nothing = pa.nulls(len(pairs), pa.int64())
            yield pa.RecordBatch.from_arrays([*pairs.columns, nothing, nothing, pa.nulls(len(pairs), kind)], ["a", "b", "hot", "size", "payload"])
            for s, n in zip(starts[sizes > block], sizes[sizes > block]):
                yield sent(key[s : s + n], item[s : s + n], load[s : s + n], n)

        streak = 0  # rows of the unfinished bucket that were sent on already
        for b in batches:
            if not b.num_rows:
                continue
            held.append((b.column(0).to_numpy(), b.column(1).to_numpy(), payloads(b.column(2), width)))
            if sum(len(k) for k, _, _ in held) < batch:
                continue
            key, item, load = (np.concatenate(x) for x in zip(*held))
            edge = int(np.searchsorted(key, key[-1]))
            if edge == 0 and len(key) > block:  # one bucket fills the buffer: send its rows on and forget them
                streak += len(key)
                yield sent(key, item, load, streak)
                held, open_key = [], key[-1]
                continue
            if streak:
                cut_at = int(np.searchsorted(key, open_key, "right")) if key[0] == open_key else 0
                if cut_at:
                    streak += cut_at
                    yield sent(key[:cut_at], item[:cut_at], load[:cut_at], streak)
                    if cut_at == len(key):  # and it may go on
                        held = []
                        continue
                key, item, load, edge, streak = key[cut_at:], item[cut_at:], load[cut_at:], max(0, edge - cut_at), 0
            if edge:
                yield from work(key[:edge], item[:edge], load[:edge])
            held = [(key[edge:], item[edge:], load[edge:])] if len(key) > edge else []
        if held:
            key, item, load = (np.concatenate(x) for x in zip(*held))
            if streak and len(key) and key[0] == open_key:
                n = int(np.searchsorted(key, open_key, "right"))
                yield sent(key[:n], item[:n], load[:n], streak + n)
                key, item, load = key[n:], item[n:], load[n:]
            if len(key):
                yield from work(key, item, load)

    rows = rows.select("key", "item", "payload")
    early = cut(_frequent(rows, block))
    some = not early.isEmpty()
    rest = rows.join(early.select("key"), "key", "left_anti").select("key", "item", "payload") if some else rows
    first = cut(rest.repartition("key").sortWithinPartitions("key").mapInArrow(small, f"a long, b long, hot long, size long, payload {'binary' if width else 'long'}"))
    pairs = first.where("hot is null").select("a", "b")
    hot_rows = None
    # at most rows / block keys, in a table of their own, so that Spark knows how small it is
    late = cut(first.where("hot is not null").groupBy(F.col("hot").alias("key")).agg(F.max("size").alias("size")))
    if some or not late.isEmpty():
        renew, hot_test, hot_width = dense or (lambda r: r, test, width)
        hot_rows = first.where("hot is not null").select(F.col("hot").alias("key"), F.col("a").alias("item"), "payload").join(late, "key")
        if some:
            hot_rows = hot_rows.unionByName(rows.join(early, "key"))
        # a table of their own, so that what they are joined with is not shuffled where they are few
        hot_rows = cut(hot_rows)
        pairs = pairs.unionByName(_hot_pairs(renew(hot_rows), hot_test, hot_width, block))
    out = cut(pairs.distinct())
    release(first, early, late, hot_rows)
    return out


def _pairs_of_two(item, load, at, test: Test) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of two rows: rows k of both sides belong together."""
    found = []
    for lo in range(0, len(at), 512):
        s = at[lo : lo + 512]
        i, j = test(load[s], load[s + 1], True)
        found.append((item[s[i]], item[s[j] + 1]))
    a, b = (np.concatenate(x) for x in zip(*found))
    keep = a != b
    return np.minimum(a, b)[keep], np.maximum(a, b)[keep]


def _hot_pairs(rows: DataFrame, test: Test, width: int, block: int) -> DataFrame:
    """The pairs of buckets with more than ``block`` rows, given with their ``size``: each bucket is dealt into blocks
    by hash, and each square of two blocks is one group of its own."""
    blocks = F.ceil(F.col("size") / F.lit(max(1, block // 2))).cast("int")
    dealt = (
        rows.select("key", "item", "payload", blocks.alias("blocks"), F.pmod(F.xxhash64("item"), blocks).cast("int").alias("own"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("square"), (F.col("own") <= F.col("other")).alias("low"), (F.col("own") == F.col("other")).alias("same"), "item", "payload")
    )

    def squares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []

        def work(square, low, same, item, load) -> pa.RecordBatch:
            starts = np.flatnonzero(np.concatenate([[True], square[1:] != square[:-1]]))
            found = []
            for s, n in zip(starts, np.diff(np.append(starts, len(square)))):
                here = slice(s, s + n)
                it, ld, lo = item[here], load[here], low[here]
                if same[s]:
                    it, at = np.unique(it, return_index=True)
                    found.append(_compare(it, ld[at], it, ld[at], True, test))
                else:
                    found.append(_compare(it[lo], ld[lo], it[~lo], ld[~lo], False, test))
            return _batches(found)

        for b in batches:
            if b.num_rows:
                held.append((b.column(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False), b.column(2).to_numpy(zero_copy_only=False), b.column(3).to_numpy(), payloads(b.column(4), width)))
                if sum(len(h[0]) for h in held) >= 16 * block:
                    cols = [np.concatenate(x) for x in zip(*held)]
                    edge = int(np.searchsorted(cols[0], cols[0][-1]))
                    if edge:
                        yield work(*(c[:edge] for c in cols))
                    held = [tuple(c[edge:] for c in cols)]
        if held:
            yield work(*(np.concatenate(x) for x in zip(*held)))

    return dealt.repartition("square").sortWithinPartitions("square").mapInArrow(squares, "a long, b long")


__all__ = ["binary", "near_pairs", "payloads", "release", "whole_runs"]
