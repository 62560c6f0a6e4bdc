"""Near-duplicate records: fast similarity sketches, banding and exact verification.

*Sketch.*  A record is its set of different word sequences (shingles).  For ``coordinates`` bins, rounds of hashing
place every shingle into a random bin with a value that grows with the round, each bin keeps its least value; in the
second half of the rounds, round k serves bin k alone, so every bin is certainly filled.  Two sets agree in a bin
with the probability of their similarity, with better concentration than independent minima, and a set with many
shingles needs only the first round.

*Banding.*  Groups of ``rows`` coordinates form a band; records that agree in one are candidates.  Within a bucket,
64 one-bit coordinates are compared before a pair leaves the task (see ``buckets``).

*Verification.*  The sets of the candidates are intersected exactly.

Records with equal sets (copies) are one *class*: it is sketched, compared and verified once, by its member with the
least id, so a group of copies of any size costs one row in each batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.llm.buckets import near_pairs
from quernel.llm.text import mix, runs_of_words, word_hashes
from quernel.plans.lineage import cut, release


@dataclass(frozen=True)
class Similarity:
    """Records with at least ``min_shingles`` different sequences of ``words`` words are compared; pairs that share
    ``threshold`` of them count.  With 40 bands of 4 coordinates a pair at 0.6 is met with probability 0.996, at 0.8
    with 1 - 1e-9; ``agreeing`` of 64 one-bit coordinates is 3.4 standard deviations below what 0.6 expects.  Where
    pairs of members are asked for, ``block`` members of a class meet as many of another at a time."""

    words: int = 5
    threshold: float = 0.8
    min_shingles: int = 1
    bands: int = 40
    rows: int = 4
    agreeing: int = 40
    block: int = 2048


def shingle_sets(texts: list[str | None], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the different word sequences of each text, ordered by text and key, and how many each text has."""
    key, of = runs_of_words(*word_hashes(texts), length)
    order = np.lexsort((key, of))
    key, of = key[order], of[order]
    if len(key):
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (of[1:] != of[:-1])])
        key, of = key[new], of[new]
    return key, np.bincount(of, minlength=len(texts))


def sketches(key: np.ndarray, sizes: np.ndarray, coordinates: int) -> np.ndarray:
    """Fast similarity sketches of sets given one after the other: a row of ``coordinates`` 64-bit values each.  The
    value of round k lies in the k-th of equal stretches of the 64-bit range.  Empty sets keep the greatest value."""
    n, t = len(sizes), coordinates
    stretch = np.uint64((1 << 64) // (2 * t))
    out = np.full((n, t), np.uint64((1 << 64) - 1))
    of = np.repeat(np.arange(n), sizes)
    for k in range(2 * t):
        if not len(key):
            break
        h = mix(key + np.uint64((k + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
        place = (h >> np.uint64(40)) % np.uint64(t) if k < t else np.full(len(h), np.uint64(k - t))
        value = mix(h) % stretch + np.uint64(k) * stretch
        _lower(out, of, place.astype(np.int64), value)
        if k + 1 < t and k < 2:
            continue
        open_ = (out == np.uint64((1 << 64) - 1)).any(axis=1)
        if not open_.all():
            stay = open_[of]
            key, of = key[stay], of[stay]
    return out


def _lower(out: np.ndarray, of: np.ndarray, place: np.ndarray, value: np.ndarray) -> None:
    np.minimum.at(out.reshape(-1), of * out.shape[1] + place, value)


def fingerprints(key: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A 64-bit fingerprint of each set, whatever its order; 0 for empty sets."""
    ends = np.cumsum(sizes)
    total = np.concatenate([[np.uint64(0)], np.cumsum(mix(key))]) if len(key) else np.zeros(1, np.uint64)
    return mix(total[ends] - total[ends - sizes])


def _agree(least: int):
    def test(a: np.ndarray, b: np.ndarray, aligned: bool = False) -> tuple[np.ndarray, np.ndarray]:
        a, b = a.view(np.uint64), b.view(np.uint64)  # bits of a negative number would be counted in its absolute value
        if aligned:
            i = np.flatnonzero(64 - np.bitwise_count(a ^ b).astype(np.int64) >= least)
            return i, i
        found_i, found_j = [], []
        for lo in range(0, len(a), 512):
            i, j = np.nonzero(np.bitwise_count(a[lo : lo + 512, None] ^ b[None, :]) <= 64 - least)
            found_i.append(i + lo)
            found_j.append(j)
        return np.concatenate(found_i or [np.zeros(0, np.int64)]), np.concatenate(found_j or [np.zeros(0, np.int64)])

    return test


def sketched(df: DataFrame, id_col: str, text_col: str, how: Similarity) -> DataFrame:
    """``(id, class, bands, bits)`` of the records with enough shingles.  ``bands`` is null for copies of a class
    already met in the same batch: a map-side combine, so a mass of copies is not shuffled."""
    coordinates = how.bands * how.rows
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, sizes = shingle_sets(batch.column(1).to_pylist(), how.words)
            enough = sizes >= how.min_shingles
            key, chosen = key[np.repeat(enough, sizes)], np.flatnonzero(enough)
            sizes = sizes[chosen]
            klass = fingerprints(key, sizes).view(np.int64)
            _, first = np.unique(klass, return_index=True)
            lead = np.zeros(len(klass), bool)
            lead[first] = True
            s = sketches(key[np.repeat(lead, sizes)], sizes[lead], coordinates)
            band = np.zeros((len(s), how.bands), np.uint64)
            for r in range(how.rows):
                band = mix(band * np.uint64(0x9E3779B97F4A7C15) + s[:, r :: how.rows] + np.arange(how.bands, dtype=np.uint64))
            bits = (s[:, :64] & np.uint64(1)).astype(np.uint8) if coordinates >= 64 else np.zeros((len(s), 64), np.uint8)
            packed = np.packbits(bits, axis=1).view(np.int64).reshape(-1) if len(s) else np.zeros(0, np.int64)
            ends = np.concatenate([[0], np.cumsum(lead) * how.bands]).astype(np.int32)
            lists = pa.ListArray.from_arrays(ends, pa.array(band.view(np.int64).reshape(-1), pa.int64()))
            at = np.where(lead, np.cumsum(lead) - 1, 0)
            all_bits = packed[at] if len(packed) else np.zeros(len(klass), np.int64)
            ids = batch.column(0).take(pa.array(chosen))
            yield pa.RecordBatch.from_arrays([ids, pa.array(klass, pa.int64()), lists, pa.array(all_bits, pa.int64())], ["id", "class", "bands", "bits"])

    return df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("_text")).mapInArrow(run, f"id {kind}, class long, bands array<long>, bits long")


def _sets(df: DataFrame, id_col: str, text_col: str, length: int) -> DataFrame:
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, sizes = shingle_sets(batch.column(1).to_pylist(), length)
            ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            klass = fingerprints(key, sizes).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(klass, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(key.view(np.int64), pa.int64()))], ["class", "shingles"])

    return df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("_text")).mapInArrow(run, "class long, shingles array<long>")


def class_pairs(df: DataFrame, id_col: str, text_col: str, how: Similarity = Similarity()) -> tuple[DataFrame, DataFrame]:
    """Two tables: members ``(id, class)`` and ``(a, b, similarity)``, a < b, for every two classes that are similar.

    Rows repeated under one id count once (they carry the same text; if not, each of their texts is compared).  Null,
    empty and short texts have fewer than ``min_shingles`` shingles and do not appear.  Whole texts are compared.
    Records whose sets are equal are one class and need no pair.
    """
    seen = cut(sketched(df, id_col, text_col, how))
    members = seen.select("id", "class").distinct()
    rows = seen.where("bands is not null").select(F.explode("bands").alias("key"), F.col("class").alias("item"), F.col("bits").alias("payload"))
    candidates = near_pairs(rows, _agree(how.agreeing))
    wanted = candidates.select(F.explode(F.array("a", "b")).alias("class")).distinct()
    lead = members.join(wanted, "class", "left_semi").groupBy("class").agg(F.min("id").alias("_lead")).select("_lead")
    texts = df.select(id_col, text_col).join(lead, F.col(id_col) == F.col("_lead"), "left_semi")
    sets = cut(_sets(texts, id_col, text_col, how.words).dropDuplicates(["class"]))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, x, y = batch.columns
            xs, ys = (c.flatten().to_numpy() for c in (x, y))
            xo, yo = (np.concatenate([[0], np.cumsum(c.value_lengths().to_numpy(zero_copy_only=False))]).astype(int) for c in (x, y))
            share = np.empty(len(a))
            for i in range(len(a)):
                p, q = xs[xo[i] : xo[i + 1]], ys[yo[i] : yo[i + 1]]
                both = np.sort(np.concatenate([p, q]))
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                share[i] = common / (len(p) + len(q) - common)
            hit = pa.array(share >= how.threshold)
            yield pa.RecordBatch.from_arrays([a.filter(hit), b.filter(hit), pa.array(share).filter(hit)], ["a", "b", "similarity"])

    pairs = (
        candidates.join(sets.select(F.col("class").alias("a"), F.col("shingles").alias("x")), "a")
        .join(sets.select(F.col("class").alias("b"), F.col("shingles").alias("y")), "b")
        .select("a", "b", "x", "y")
        .mapInArrow(verify, "a long, b long, similarity double")
    )
    pairs = cut(pairs)
    release(candidates, sets)
    return members, pairs


def near_duplicates(df: DataFrame, id_col: str, text_col: str, how: Similarity = Similarity()) -> DataFrame:
    """``(id_a, id_b)``, id_a < id_b: every two records that share at least ``threshold`` of their shingles.  Pairs
    of classes are expanded to their members by joins; see ``class_pairs`` for the cases."""
    members, pairs = class_pairs(df, id_col, text_col, how)
    members = cut(members)
    linked = pairs.select("a", "b")
    sizes = cut(members.groupBy("class").count().where("count > 1"))
    within = sizes.select(F.col("class").alias("a"), F.col("class").alias("b"))
    out = _expanded(linked.unionByName(within), members, sizes, how.block)
    low, high = F.least("id_a", "id_b"), F.greatest("id_a", "id_b")
    return out.where("id_a <> id_b").select(low.alias("id_a"), high.alias("id_b")).distinct()


def _expanded(pairs: DataFrame, members: DataFrame, sizes: DataFrame, block: int) -> DataFrame:
    """``(id_a, id_b)`` of every member of a with every member of b.  A class of more than ``block`` members is dealt
    into blocks, and every two blocks meet by themselves, so no task has more than their square."""
    blocks = sizes.select("class", F.ceil(F.col("count") / block).cast("int").alias("blocks")).where("blocks > 1")
    dealt = members.join(blocks, "class", "left").select("class", "id", F.pmod(F.xxhash64("id"), F.coalesce("blocks", F.lit(1))).cast("int").alias("block"))
    each = lambda c: F.explode(F.sequence(F.lit(0), F.coalesce(f"n_{c}", F.lit(1)) - 1))
    a, b = (blocks.select(F.col("class").alias(c), F.col("blocks").alias(f"n_{c}")) for c in ("a", "b"))
    squares = pairs.join(a, "a", "left").join(b, "b", "left").withColumn("block_a", each("a")).withColumn("block_b", each("b")).where("a <> b OR block_a <= block_b")
    left, right = (dealt.select(F.col("class").alias(c), F.col("block").alias(f"block_{c}"), F.col("id").alias(f"id_{c}")) for c in ("a", "b"))
    return squares.join(left, ["a", "block_a"]).join(right, ["b", "block_b"]).select("id_a", "id_b")


def components(pairs: DataFrame) -> DataFrame:
    """``(node, root)`` of the nodes of ``(a, b)``: the least node it is linked to over any way.  Labels fall to the
    least neighbour's and then jump to their label's label, so rounds grow with the logarithm of the longest way."""
    edges = cut(pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    now = cut(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root")))
    while True:
        least = edges.join(now.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("m"))
        fallen = now.join(least, "node").select("node", F.least("root", "m").alias("root"), F.col("root").alias("was"))
        fallen = cut(fallen)
        far = fallen.select(F.col("node").alias("root"), F.col("root").alias("_far"))
        after = cut(fallen.join(far, "root").select("node", F.least("root", "_far").alias("root"), "was"))
        release(fallen, now)
        if after.where("root <> was").isEmpty():
            return after.select("node", "root")
        now = after


def groups(df: DataFrame, id_col: str, text_col: str, how: Similarity = Similarity()) -> DataFrame:
    """``(id, group_id, group_size, links)`` of each record that is alone in no group: the least id of its group, the
    group's size, and the other classes it is similar to.  Copies are not expanded into pairs."""
    members, pairs = class_pairs(df, id_col, text_col, how)
    members, linked = cut(members), pairs.select("a", "b")
    root = components(linked)
    links = linked.select(F.explode(F.array("a", "b")).alias("class")).groupBy("class").agg(F.count("*").alias("links"))
    placed = members.join(root.withColumnRenamed("node", "class"), "class", "left").join(links, "class", "left").select("id", F.coalesce("root", "class").alias("root"), F.coalesce("links", F.lit(0)).alias("links"))
    sizes = placed.groupBy("root").agg(F.min("id").alias("group_id"), F.count_distinct("id").alias("group_size")).where("group_size > 1")
    return placed.join(sizes, "root").groupBy("id", "group_id", "group_size").agg(F.max("links").alias("links"))
