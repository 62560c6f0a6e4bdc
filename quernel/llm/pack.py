"""Filling containers: variable-capacity best-fit over several permitted lengths.

Items are taken from the largest to the smallest.  Each goes into the open bin that it leaves the least room in.
Where none fits, a bin is opened.  For each permitted length it is worked out how full the items still to come can
make it, and the length with the least cost a token is taken: cost is the shortest permitted length for that content
plus a fixed overhead.  At the end every bin is downsized to the shortest permitted length that holds its contents.
The same items are packed with the greatest length alone as well, and the cheaper of both packings is given.  Only an
item above the greatest length is divided.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.plans.lineage import cut


@dataclass(frozen=True)
class Containers:
    """Permitted lengths, the greatest being the capacity; ``overhead`` is what opening a bin costs, in tokens;
    ``group`` the tokens that one task packs, whatever the corpus."""

    lengths: tuple[int, ...] = (256, 512, 1024, 2048)
    overhead: int = 32
    group: int = 4_000_000

    @property
    def capacity(self) -> int:
        return max(self.lengths)


def total_cost(lengths: list[int], how: Containers) -> int:
    return sum(lengths) + how.overhead * len(lengths)


def _filled(length: int, size: int, there: int, count: list[int]) -> int:
    """How full a bin of a length gets that is opened for an item: the largest item that still fits is put in, again
    and again.  ``there`` has bit s set where items of size s are left, ``count`` says how many."""
    room = length - size
    while room > 0:
        fits = there & ((1 << (room + 1)) - 1)
        if not fits:
            break
        t = fits.bit_length() - 1
        n = min(count[t] - (t == size), room // t)
        room -= n * t
        there &= (1 << t) - 1
    return length - room


def _packed(sizes: np.ndarray, how: Containers, lengths: list[int]) -> tuple[np.ndarray, list[int]]:
    """The bin of each item and the length of each bin, with bins opened of ``lengths``."""
    shortest, cap = sorted(how.lengths), how.capacity
    fitting = [next((x for x in shortest if x >= n), cap) for n in range(cap + 1)]
    order = np.argsort(-sizes, kind="stable")
    count = np.bincount(sizes, minlength=cap + 1).tolist() if len(sizes) else []
    there = sum(1 << s for s, n in enumerate(count) if n)
    bin_of = np.empty(len(sizes), np.int64)
    room: list[int] = []  # of each bin, in its opened length
    opened: list[int] = []
    by_room: list[list[int]] = [[] for _ in range(cap + 1)]
    open_ = 0  # bit r is set where a bin with room r is open
    for i in order.tolist():
        size = int(sizes[i])
        fits = open_ >> size
        if fits:
            r = size + (fits & -fits).bit_length() - 1
            b = by_room[r].pop()
            if not by_room[r]:
                open_ &= ~(1 << r)
        else:
            best = None
            for x in lengths:
                if x >= size:
                    full = _filled(x, size, there, count) if len(lengths) > 1 else x
                    cost = (fitting[full] + how.overhead) / full
                    if best is None or cost < best[0]:
                        best = cost, x
            b, r = len(opened), best[1]
            opened.append(r)
            room.append(r)
        count[size] -= 1
        if not count[size]:
            there &= ~(1 << size)
        r -= size
        room[b] = r
        if r:
            by_room[r].append(b)
            open_ |= 1 << r
        bin_of[i] = b
    return bin_of, [fitting[opened[b] - room[b]] for b in range(len(opened))]


def pack(sizes: np.ndarray, how: Containers = Containers()) -> tuple[np.ndarray, list[int]]:
    """The bin of each item (0 < size <= capacity) and the length of each bin after downsizing."""
    jointly, greatest = _packed(sizes, how, sorted(how.lengths)), _packed(sizes, how, [how.capacity])
    return min(jointly, greatest, key=lambda p: total_cost(p[1], how))


def containers(sizes: DataFrame, id_col: str = "doc_id", size_col: str = "n_tokens", how: Containers = Containers()) -> DataFrame:
    """``(id_col, piece, begin, n_tokens, bin, bin_length, bin_used)``: the container of every item.

    Items of size 0 or null go into none.  An item above the capacity is cut into pieces of the capacity and a rest;
    ``begin`` is the piece's first token.  Rows with one id are items of their own.  Items are dealt by hash into
    groups of about ``group`` tokens (at least 1,900 full bins each, so what dealing wastes is a bin or two a group)
    that are packed side by side; repeated rows are dealt apart, so that no group is hot.
    """
    kind = sizes.schema[id_col].dataType.simpleString()
    items = cut(sizes.where(F.col(size_col) > 0).select(F.col(id_col), F.col(size_col).cast("long").alias("size"), F.monotonically_increasing_id().alias("_row")))
    total = items.agg(F.sum("size").alias("s")).collect()[0].s or 0
    groups = max(1, round(total / how.group))
    cap = how.capacity

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", id_col], ascending=[False, True], kind="stable")
        size = pdf["size"].to_numpy()
        n = -(-size // cap)
        row = np.repeat(np.arange(len(size)), n)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        part = np.minimum(cap, size[row] - piece * cap)
        bin_of, lengths = pack(part, how)
        used = np.bincount(bin_of, weights=part).astype(np.int64)
        return pd.DataFrame({id_col: pdf[id_col].to_numpy()[row], "piece": piece.astype(np.int32), "begin": piece * cap, "n_tokens": part, "bin": (int(pdf["_group"].iloc[0]) << 32) + bin_of, "bin_length": np.array(lengths, np.int32)[bin_of], "bin_used": used[bin_of].astype(np.int32)})

    return (
        items.withColumn("_group", F.pmod(F.xxhash64(id_col, "size", "_row"), F.lit(groups)))
        .groupBy("_group")
        .applyInPandas(run, f"{id_col} {kind}, piece int, begin long, n_tokens long, bin long, bin_length int, bin_used int")
    )


def summary(packed: DataFrame, how: Containers = Containers()) -> DataFrame:
    """``(bin_length, bins, used, empty, cost)`` of what ``containers`` gives."""
    bins = packed.groupBy("bin").agg(F.first("bin_length").alias("bin_length"), F.first("bin_used").alias("bin_used"))
    return bins.groupBy("bin_length").agg(F.count("*").alias("bins"), F.sum("bin_used").alias("used"), F.sum(F.col("bin_length") - F.col("bin_used")).alias("empty"), F.sum(F.col("bin_length") + how.overhead).alias("cost"))
