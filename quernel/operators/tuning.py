"""Self-tuning of an index by quality and diversity: settings, scores, behaviour cells, archives and the search loop.

Scores, cells and archives are column expressions and aggregates over a table of evaluations; candidates are built
and measured as rows of a DataFrame, each by one task, on a sample of bounded size."""

from __future__ import annotations

import random
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.functions import vectors as V
from quernel.operators import search

# The presets (name, kind, m, ef_construction, ef_search, partitions, nprobe).
PRESETS = (
    ("flat", "flat", None, None, None, None, None),
    ("hnsw_fast", "hnsw", 8, 100, 20, None, None),
    ("hnsw_balanced", "hnsw", 16, 200, 50, None, None),
    ("hnsw_accurate", "hnsw", 32, 300, 100, None, None),
    ("hnsw_max_quality", "hnsw", 48, 400, 200, None, None),
    ("ivf_fast", "ivf", None, None, None, 256, 8),
    ("ivf_balanced", "ivf", None, None, None, 256, 32),
    ("ivf_accurate", "ivf", None, None, None, 512, 64),
)
# The precomputed grid (r cell, s cell, kind, m, efc, efs, partitions, nprobe, recall, latency factor,
# memory factor, least and greatest size), in order.
GRID = (
    (0, 0, "flat", None, None, None, None, None, 1.0, 1.0, 1.0, 0, 10_000),
    (0, 1, "hnsw", 8, 64, 16, None, None, 0.75, 0.05, 1.3, 10_000, 100_000),
    (0, 2, "ivf", None, None, None, 256, 4, 0.70, 0.02, 1.1, 100_000, 10_000_000),
    (1, 0, "hnsw", 12, 100, 32, None, None, 0.90, 0.08, 1.4, 1_000, 50_000),
    (1, 1, "hnsw", 16, 128, 64, None, None, 0.92, 0.10, 1.5, 10_000, 500_000),
    (1, 1, "hnsw", 32, 128, 32, None, None, 0.90, 0.08, 1.7, 10_000, 500_000),
    (1, 2, "ivf", None, None, None, 512, 32, 0.88, 0.05, 1.2, 100_000, 10_000_000),
    (2, 0, "hnsw", 24, 200, 100, None, None, 0.97, 0.15, 1.8, 1_000, 100_000),
    (2, 1, "hnsw", 32, 256, 128, None, None, 0.98, 0.20, 2.0, 10_000, 1_000_000),
    (2, 1, "hnsw", 64, 128, 128, None, None, 0.96, 0.18, 2.2, 10_000, 1_000_000),
    (2, 2, "hnsw", 48, 400, 200, None, None, 0.99, 0.30, 2.5, 10_000, 5_000_000),
    (2, 2, "hnsw", 64, 512, 300, None, None, 0.995, 0.40, 3.0, 50_000, 2_000_000),
    (2, 2, "hnsw", 128, 256, 256, None, None, 0.998, 0.50, 4.0, 100_000, 1_000_000),
)
# Weights of recall, speed, memory and build.
PRIORITIES = {
    "default": (0.30, 0.30, 0.20, 0.20), "recall_first": (0.50, 0.25, 0.15, 0.10), "speed_first": (0.25, 0.50, 0.10, 0.15),
    "search_optimized": (0.50, 0.40, 0.05, 0.05), "memory_first": (0.20, 0.20, 0.45, 0.15), "fast_ingest": (0.25, 0.20, 0.10, 0.45),
}
# Weights of throughput, memory, processor and batch scaling.
INSERT_PRIORITIES = {"default": (0.50, 0.15, 0.20, 0.15), "throughput_first": (0.70, 0.10, 0.10, 0.10), "balanced": (0.40, 0.20, 0.20, 0.20)}
# What genes may be.
GENES = {"kind": ("flat", "hnsw", "ivf"), "m": (8, 12, 16, 24, 32, 48), "efc": (50, 100, 150, 200, 300), "efs": (10, 20, 40, 50, 80, 100, 150), "partitions": (32, 64, 128, 256, 512), "nprobe": (2, 4, 8, 16, 32, 64)}
INSERT_GENES = {"strategy": ("sequential", "batch", "parallel", "chunked", "unrolled", "interleaved"), "batch": (1, 10, 50, 100, 500, 1000), "parallel": (False, True), "prefetch": (0, 2, 4, 8)}
# What the search for an insert strategy starts with (strategy, batch, parallel, prefetch).
INSERT_SEEDS = (
    ("sequential", 1, False, 0), ("batch", 100, False, 4), ("parallel", 500, True, 8), ("chunked", 64, False, 4),
    ("unrolled", 100, False, 0), ("interleaved", 200, False, 2), ("unrolled", 400, True, 4), ("interleaved", 500, True, 8),
)
# Tier, cost, least budget, least seconds, expected seconds and sources (from, to) of the research tiers.
RESEARCH_TIERS = (
    ("deeper", 1.30, 1.30, 120, 45, 120, 15, 25), ("default", 0.50, 0.50, 45, 15, 45, 10, 15), ("medium", 0.07, 0.07, 15, 5, 15, 5, 10), ("basic", 0.04, None, None, 1, 5, 3, 5),
)


@dataclass(frozen=True)
class Tuning:
    """Settings of the search: cells a side, generations, population, sample and query sizes, stopping rules."""

    grid: int = 6
    generations: int = 12
    population: int = 8
    sample: int = 300
    queries: int = 30
    early_stop: float = 0.85
    least_generations: int = 4
    priority: str = "default"
    insert_grid: int = 4
    insert_priority: str = "default"


TUNINGS = {
    "default": Tuning(), "fast": Tuning(4, 6, 6, 200, 20, 0.80, 2, insert_grid=3), "thorough": Tuning(8, 20, 12, 500, 50, 0.95, 8, insert_grid=5),
    "speed_only": Tuning(4, 4, 4, 150, 15, 0.75, 2), "balanced": Tuning(5, 10, 10, 300, 30, 0.90, 5), "search_first": Tuning(6, 12, 15, 400, 50, 0.92, 6, "search_optimized"),
}


def presets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(PRESETS), "preset string, kind string, m int, ef_construction int, ef_search int, partitions int, nprobe int")


def grid(spark: SparkSession) -> DataFrame:
    rows = [(i, *g) for i, g in enumerate(GRID)]
    return spark.createDataFrame(rows, "seq int, r int, s int, kind string, m int, ef_construction int, ef_search int, partitions int, nprobe int, recall double, latency double, memory double, least_n long, most_n long")


def recommended_preset(n: Column, priority: Column) -> Column:
    """The preset for a size and a priority (speed, accuracy, other)."""
    def pick(speed: str, accuracy: str, other: str) -> Column:
        return F.when(priority == "speed", speed).when(priority == "accuracy", accuracy).otherwise(other)

    return (
        F.when(n <= 5_000, "flat").when(n <= 100_000, pick("hnsw_fast", "hnsw_accurate", "hnsw_balanced"))
        .when(n <= 1_000_000, pick("ivf_fast", "hnsw_max_quality", "ivf_balanced")).otherwise(pick("ivf_fast", "ivf_accurate", "ivf_balanced"))
    )


def cell_of_priority(priority: Column) -> Column:
    p = F.lower(priority)
    return (
        F.when(p.isin("speed", "fast"), F.struct(F.lit(0).alias("r"), F.lit(0).alias("s"))).when(p.isin("accuracy", "recall", "high"), F.struct(F.lit(2).alias("r"), F.lit(1).alias("s")))
        .when(p.isin("max", "maximum", "ultra"), F.struct(F.lit(2).alias("r"), F.lit(2).alias("s"))).otherwise(F.struct(F.lit(1).alias("r"), F.lit(1).alias("s")))
    )


def grid_recommend(asked: DataFrame) -> DataFrame:
    """``(n, priority, seq)``: the first grid entry of the priority's cell whose range has n, else the first anywhere,
    else the first of cell (1, 1).  ``asked`` has ``n`` and ``priority``; the grid has 13 rows."""
    g = F.broadcast(grid(asked.sparkSession).select("seq", "r", "s", "least_n", "most_n"))
    q = asked.withColumn("c", cell_of_priority(F.col("priority")))
    covers = F.col("n").between(F.col("least_n"), F.col("most_n"))
    j = q.join(g, F.lit(True))
    first = lambda cond: F.min(F.when(cond, F.col("seq")))
    here = (F.col("r") == F.col("c.r")) & (F.col("s") == F.col("c.s"))
    return j.groupBy("n", "priority").agg(F.coalesce(first(here & covers), first(covers), first((F.col("r") == 1) & (F.col("s") == 1))).alias("seq"))


def grid_select(asked: DataFrame) -> DataFrame:
    """``(n, min_recall, max_latency, seq)``: of the one cell that recall and latency name, the entry of the best
    recall that meets both and has n in its range, the last of equals; no row if there is none."""
    g = F.broadcast(grid(asked.sparkSession).select("seq", "r", "s", "recall", "latency", "least_n", "most_n"))
    r = F.when(F.col("min_recall") >= 0.95, 2).when(F.col("min_recall") >= 0.85, 1).otherwise(0)
    s = F.when(F.col("max_latency") <= 0.1, 0).when(F.col("max_latency") <= 0.25, 1).otherwise(2)
    j = asked.withColumn("qr", r).withColumn("qs", s).join(g, (F.col("qr") == F.col("r")) & (F.col("qs") == F.col("s")))
    j = j.where((F.col("recall") >= F.col("min_recall")) & (F.col("latency") <= F.col("max_latency")) & F.col("n").between(F.col("least_n"), F.col("most_n")))
    return j.groupBy("n", "min_recall", "max_latency").agg(F.max_by("seq", F.struct("recall", "seq")).alias("seq"))


def _clamp(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))


def _share_of_log(c: Column, whole: float) -> Column:
    """clamp(ln c / ln whole); 0 where c is not positive."""
    return F.when(c <= 0, F.lit(0.0)).otherwise(_clamp(F.log(c) / F.log(F.lit(whole))))


def _geometric(parts: list[tuple[Column, float]]) -> Column:
    """Weighted geometric mean; parts below 0.001 count as that, parts without weight not at all."""
    used = [(F.greatest(s, F.lit(0.001)), w) for s, w in parts if w > 0]
    total = sum(w for _, w in used)
    logs = [F.log(s) * F.lit(w) for s, w in used]
    out = logs[0]
    for x in logs[1:]:
        out = out + x
    return F.exp(out / F.lit(total))


def balanced(recall: float, speed: float, memory: float, build: float) -> tuple[float, float, float, float]:
    """Weights of one's own, scaled to a sum of 1."""
    total = recall + speed + memory + build
    return recall / total, speed / total, memory / total, build / total


def fitness(priority: str | tuple[float, float, float, float] = "default", recall: str = "recall", latency_us: str = "latency_us", size: str = "bytes", build_ms: str = "build_ms") -> Column:
    """Fitness of an evaluated index: recall, speed, memory and build time by weight, and a penalty below 0.99."""
    r, s, m, b = PRIORITIES[priority] if isinstance(priority, str) else priority
    rec = F.col(recall)
    base = _geometric([(rec, r), (1 - _share_of_log(F.col(latency_us), 10_000.0), s), (1 - _clamp((F.col(size) - 1000) / 9000.0), m), (1 - _share_of_log(F.col(build_ms), 10_000.0), b)])
    return F.when(rec < 0.99, base * F.pow(rec / 0.99, F.lit(3.0))).otherwise(base)


def _cell(x: Column, cells: int) -> Column:
    return F.least(F.floor(x * (cells - 1) + 0.5), F.lit(cells - 1)).cast("int")


def behaviour(cells: int = 6, bytes_from: float = 3000.0, bytes_span: float = 3000.0) -> list[Column]:
    """The cell of an evaluated index by recall, latency and memory.  The memory range is of 768 dimensions; scale it
    for others."""
    lat = _clamp(F.log(F.greatest(F.col("latency_us").cast("double"), F.lit(1.0))) / F.log(F.lit(1000.0)))
    return [_cell(F.col("recall"), cells).alias("r_bin"), _cell(lat, cells).alias("l_bin"), _cell(_clamp((F.col("bytes") - bytes_from) / bytes_span), cells).alias("m_bin")]


def behaviour_2d(cells: int = 6, bytes_from: float = 3000.0, bytes_span: float = 3000.0) -> list[Column]:
    """The cell by latency and memory alone."""
    return behaviour(cells, bytes_from, bytes_span)[1:]


def insert_fitness(priority: str = "default") -> Column:
    """Fitness of an insert strategy from ``throughput``, ``overhead``, ``cpu`` and ``scaling``."""
    t, m, c, b = INSERT_PRIORITIES[priority]
    return _geometric([(insert_throughput(), t), (1 - _clamp(F.col("overhead") / 100.0), m), (F.col("cpu"), c), (_clamp(F.col("scaling")), b)])


def insert_throughput() -> Column:
    low, high = float(np.log(1e5)), float(np.log(1e7))
    return _clamp((F.log(F.greatest(F.col("throughput"), F.lit(1e5))) - low) / (high - low))


def insert_behaviour(cells: int = 4) -> list[Column]:
    return [_cell(insert_throughput(), cells).alias("t_bin"), _cell(_clamp(0.6 * F.col("cpu") + 0.4 * F.col("scaling")), cells).alias("e_bin")]


def archive(evaluated: DataFrame, cell_cols: list[str], fitness_col: str = "fitness", order_col: str = "seq") -> DataFrame:
    """The fittest row of each cell; of equals the earliest stays."""
    others = [c for c in evaluated.columns if c not in cell_cols]
    best = F.max_by(F.struct(*others), F.struct(F.col(fitness_col), -F.col(order_col)))
    return evaluated.groupBy(*cell_cols).agg(best.alias("_b")).select(*cell_cols, *(F.col("_b")[c].alias(c) for c in others))


def coverage(elites: DataFrame, cells: int) -> DataFrame:
    """``(filled, percent)`` of an archive with so many cells."""
    return elites.agg(F.count("*").alias("filled")).select("filled", (F.col("filled") * 100.0 / cells).alias("percent"))


def behaviour_cell(features: Column | str, resolution: int, dims: int) -> Column:
    """The cell of a general archive, by floor: ``array<int>`` of four, unused ones 0."""
    f = F.col(features) if isinstance(features, str) else features
    used = min(dims, 4)
    return F.array(*(F.least(F.floor(_clamp(f[i].cast("double")) * resolution), F.lit(resolution - 1)).cast("int") for i in range(used)), *(F.lit(0) for _ in range(4 - used)))


def archive_stats(elites: DataFrame, capacity: int, fitness_col: str = "fitness") -> DataFrame:
    """One row; the mean of nothing is 0, its greatest -inf and its least +inf."""
    f = F.col(fitness_col)
    return elites.agg(F.count("*").alias("n"), F.coalesce(F.avg(f), F.lit(0.0)).alias("mean"), F.coalesce(F.max(f), F.lit(float("-inf"))).alias("best"), F.coalesce(F.min(f), F.lit(float("inf"))).alias("worst")).withColumn("ratio", F.col("n") / F.lit(float(capacity)))


def from_range(x: Column, low: float, high: float) -> Column:
    """A raw value as a feature: its place between low and high, 0.5 if that is no range."""
    return F.lit(0.5) if high <= low else _clamp((x - low) / (high - low))


def behaviour_distance(a: Column | str, b: Column | str) -> Column:
    """Euclidean distance of two feature arrays."""
    return V.distance(a, b)


def query_features(vector: Column | str, references: list[list[float]]) -> Column:
    """A vector's features: its cosine with each reference vector (a few, given as values), scaled to 0..1; 0.5 where
    either has no length."""
    return F.array(*((V.cosine(vector, F.array(*(F.lit(float(x)) for x in r))) + 1) / 2 for r in references))


def keyword_share(text: Column | str, keywords: list[str]) -> Column:
    """Share of the keywords that the lower-cased text contains."""
    t = F.lower(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))
    total = F.lit(0)
    for k in keywords:
        total = total + F.contains(t, F.lit(k.lower())).cast("int")
    return total / F.lit(float(max(1, len(keywords))))


def research_tier(budget: Column) -> Column:
    return F.when(budget >= 1.30, "deeper").when(budget >= 0.50, "default").when(budget >= 0.07, "medium").otherwise("basic")


def research_tier_in_time(seconds: Column) -> Column:
    return F.when(seconds >= 120, "deeper").when(seconds >= 45, "default").when(seconds >= 15, "medium").otherwise("basic")


def research_tiers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t, c, *map(int, more)) for t, c, _, _, *more in RESEARCH_TIERS], "tier string, cost double, least_seconds int, most_seconds int, least_sources int, most_sources int")


def retry_delays(retries: int, first_ms: int = 100) -> list[int]:
    """Milliseconds before each further attempt: twice as long each time."""
    return [first_ms << i for i in range(retries)]


# ---- the search ----------------------------------------------------------------------------------------------------

# What the search starts with, and the values of genes that a seed does not name.
SEEDS = (
    {"kind": "hnsw", "m": 16, "efc": 200, "efs": 50}, {"kind": "hnsw", "m": 8, "efc": 50, "efs": 10}, {"kind": "hnsw", "m": 32, "efc": 300, "efs": 100}, {"kind": "hnsw", "m": 8, "efc": 100, "efs": 20}, {"kind": "hnsw", "m": 48, "efc": 300, "efs": 150},
    {"kind": "flat"}, {"kind": "ivf", "partitions": 32, "nprobe": 4}, {"kind": "ivf", "partitions": 128, "nprobe": 16}, {"kind": "ivf", "partitions": 256, "nprobe": 32}, {"kind": "ivf", "partitions": 512, "nprobe": 64},
)
_DEFAULT = {"kind": "hnsw", "m": 16, "efc": 200, "efs": 50, "partitions": 256, "nprobe": 16}


def genome(rng: random.Random, genes: dict = GENES) -> dict:
    return {g: rng.choice(v) for g, v in genes.items()}


def mutated(parent: dict, rng: random.Random, genes: dict = GENES) -> dict:
    """One or two genes drawn anew."""
    return parent | {g: rng.choice(genes[g]) for g in rng.sample(sorted(genes), rng.choice((1, 2)))}


def crossed(a: dict, b: dict, rng: random.Random) -> dict:
    return {g: rng.choice((a[g], b[g])) for g in a}


def offspring(parents: list[dict], n: int, rng: random.Random, shares: tuple[float, float, float] = (0.4, 0.3, 0.2), genes: dict = GENES) -> list[dict]:
    """New candidates: mutants, crosses, copies and, for the rest, random ones."""
    out = []
    for _ in range(n):
        u, p = rng.random(), rng.choice(parents)
        if u < shares[0]:
            out.append(mutated(p, rng, genes))
        elif u < shares[0] + shares[1]:
            out.append(crossed(p, rng.choice(parents), rng))
        else:
            out.append(dict(p) if u < sum(shares) else genome(rng, genes))
    return out


def _measure(g: dict, x: np.ndarray, q: np.ndarray, truth: np.ndarray) -> tuple[float, float, float, float] | None:
    """(recall, latency in us, bytes a vector, build in ms) of one candidate on a sample; None if it cannot be built."""
    dim, ids, t0 = x.shape[1], np.arange(len(x)), time.perf_counter()
    if g["kind"] == "ivf":
        p = int(g["partitions"])
        if p > len(x):
            return None
        c = x[:p].copy()
        for _ in range(15):
            k = search.nearest(x, c, search.COSINE)
            n = np.bincount(k, minlength=p)
            s = np.zeros_like(c)
            np.add.at(s, k, x)
            c[n > 0] = s[n > 0] / n[n > 0, None]
        part, size = search.nearest(x, c, search.COSINE), 4 * dim + 8

        def ask(v):
            probe = np.argsort(search.distances(v[None], c, search.COSINE)[0], kind="stable")[: int(g["nprobe"])]
            rows = np.flatnonzero(np.isin(part, probe))
            return rows[np.argsort(search.distances(v[None], x[rows], search.COSINE)[0], kind="stable")[:10]]
    elif g["kind"] == "hnsw":
        h, size = search.Graph(x, ids, search.COSINE, int(g["m"]), int(g["efc"])), 4 * dim + 16 * int(g["m"])
        ask = lambda v: [b for _, b in h.search(v, 10, int(g["efs"]))]
    else:
        size = 4 * dim
        ask = lambda v: np.argsort(search.distances(v[None], x, search.COSINE)[0], kind="stable")[:10]
    build, t0 = (time.perf_counter() - t0) * 1000, time.perf_counter()
    hits = sum(len(set(map(int, ask(v))) & set(map(int, t))) for v, t in zip(q, truth))
    return hits / (10 * len(q)), float(int((time.perf_counter() - t0) * 1e6) // len(q)), float(size), build


def evaluate(spark: SparkSession, genomes: list[dict], sample: np.ndarray, queries: int) -> pd.DataFrame:
    """Each candidate measured by one task on the broadcast sample, of bounded size; those that fail are left out."""
    q = sample[:queries]
    truth = np.argsort(search.distances(q, sample, search.COSINE), axis=1, kind="stable")[:, :10]
    shared = spark.sparkContext.broadcast((sample, q, truth))
    rows = [(i, *(full[g] for g in GENES)) for i, g in enumerate(genomes) for full in [_DEFAULT | g]]
    df = spark.createDataFrame(rows, "seq int, kind string, m int, efc int, efs int, partitions int, nprobe int").repartition(len(rows))

    def run(frames):
        for pdf in frames:
            out = []
            for g in pdf.to_dict("records"):
                if (r := _measure(g, *shared.value)) is not None:
                    out.append({**g, **dict(zip(("recall", "latency_us", "bytes", "build_ms"), r))})
            yield pd.DataFrame(out, columns=[*pdf.columns, "recall", "latency_us", "bytes", "build_ms"])

    return df.mapInPandas(run, "seq int, kind string, m int, efc int, efs int, partitions int, nprobe int, recall double, latency_us double, bytes double, build_ms double").toPandas()


def tune(corpus: DataFrame, how: Tuning = Tuning(), seed: int = 7, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The archive of elites after the search (``kind``, genes, measurements, ``fitness``, cell), best first.

    A reproducible sample is drawn by the hash of the ids; at least 50 vectors are needed."""
    spark, rng = corpus.sparkSession, random.Random(seed)
    rows = corpus.where(F.col(vec_col).isNotNull()).orderBy(F.xxhash64(F.col(id_col), F.lit(seed)), id_col).limit(how.sample).select(vec_col).collect()
    if len(rows) < 50:
        raise search.NotTrained("tuning needs at least 50 vectors")
    x = np.array([r[0] for r in rows], np.float64)
    people = [_DEFAULT | s for s in SEEDS] + [genome(rng) for _ in range(max(0, how.population - len(SEEDS)))]
    elites: pd.DataFrame | None = None
    best, stale, seq = 0.0, 0, 0
    for gen in range(how.generations):
        got = evaluate(spark, people, x, how.queries)
        got["seq"] += seq
        seq += len(people)
        now = pd.concat([elites[got.columns], got]) if elites is not None else got
        scored = spark.createDataFrame(now).select("*", fitness(how.priority).alias("fitness"), *behaviour(how.grid, 3000.0 * x.shape[1] / 768, 3000.0 * x.shape[1] / 768))
        elites = archive(scored, ["r_bin", "l_bin", "m_bin"]).toPandas().sort_values("seq")  # at most grid^3 rows
        top = float(elites["fitness"].max())
        stale = 0 if top > best + 0.01 else stale + 1
        best = max(best, top)
        if gen + 1 >= how.least_generations and (best >= how.early_stop or stale >= 3):
            break
        people = offspring(elites[list(GENES)].to_dict("records"), how.population, rng)
    return spark.createDataFrame(elites.reset_index(drop=True)).orderBy(F.desc("fitness"), "seq")


def _normalise(x: np.ndarray, strategy: str, batch: int, parallel: bool) -> None:
    """Normalise all rows in place, the way a strategy does."""
    n = len(x)

    def whole(lo: int, hi: int) -> None:
        part = x[lo:hi]
        part /= np.maximum(np.linalg.norm(part, axis=1, keepdims=True), search.TINY)

    def one_by_one(lo: int, hi: int) -> None:
        for v in x[lo:hi]:
            v /= max(float(np.sqrt(v @ v)), search.TINY)

    def four_by_four(lo: int, hi: int) -> None:
        for i in range(lo, hi, 4):
            part = x[i : min(hi, i + 4)]
            part *= 1 / np.maximum(np.sqrt(np.einsum("ij,ij->i", part, part)), search.TINY)[:, None]

    def norms_first(lo: int, hi: int) -> None:
        norms = np.empty(hi - lo)
        for i in range(lo, hi, 64):
            norms[i - lo : i - lo + 64] = np.sqrt((x[i : min(hi, i + 64)] ** 2).sum(axis=1))
        x[lo:hi] /= np.maximum(norms, search.TINY)[:, None]

    how = {"sequential": one_by_one, "unrolled": four_by_four, "interleaved": norms_first}.get(strategy, whole)
    step = 64 if strategy == "chunked" else 1 if strategy == "pre_normalized" else max(1, batch)
    spans = [(lo, min(n, lo + step)) for lo in range(0, n, step)] if strategy != "pre_normalized" else []
    if parallel or strategy == "parallel":
        with ThreadPoolExecutor(4) as pool:
            list(pool.map(lambda span: how(*span), spans))
    else:
        for span in spans:
            how(*span)


def insert_timings(spark: SparkSession, genomes: list[tuple], vectors: np.ndarray) -> DataFrame:
    """``(seq, strategy, batch, parallel, prefetch, throughput, base)``: vectors a second that each candidate
    normalises, and those of the sequential one, each timed by a task of its own on the broadcast sample."""
    shared = spark.sparkContext.broadcast(vectors)
    rows = [(i, *g) for i, g in enumerate(genomes)]
    genes = "seq int, strategy string, batch int, parallel boolean, prefetch int"

    def rate(strategy: str, batch: int, parallel: bool) -> float:
        x = np.array(shared.value, np.float64)
        began = time.perf_counter()
        _normalise(x, strategy, batch, parallel)
        return len(x) / max(1e-9, time.perf_counter() - began)

    def run(frames):
        for pdf in frames:
            pdf["throughput"] = [rate(g.strategy, int(g.batch), bool(g.parallel)) for g in pdf.itertuples()]
            pdf["base"] = [rate("sequential", 1, False) for _ in range(len(pdf))]
            yield pdf

    return spark.createDataFrame(rows, genes).repartition(max(1, len(rows))).mapInPandas(run, f"{genes}, throughput double, base double")


def insert_measures(timed: DataFrame) -> DataFrame:
    """Timings with ``overhead`` in bytes a batch, ``cpu`` and ``scaling``, as ``insert_fitness`` takes them."""
    t, batch = F.col("throughput"), F.col("batch").cast("double")
    overhead = (
        F.when(F.col("strategy").isin("batch", "interleaved"), batch * 4).when(F.col("strategy") == "parallel", batch * 8)
        .when(F.col("strategy") == "chunked", F.lit(256.0)).when(F.col("strategy") == "unrolled", F.lit(16.0)).otherwise(F.lit(0.0))
    )
    cpu = F.when(F.col("parallel"), F.least(t / 1e6, F.lit(1.0)) * 0.9 + 0.1).otherwise(F.least(t / 5e5, F.lit(1.0)) * 0.7 + 0.2)
    return timed.withColumn("overhead", overhead).withColumn("cpu", cpu).withColumn("scaling", F.least(F.greatest(t / F.col("base"), F.lit(0.5)), F.lit(2.0)) / 2)


def evolve_inserts(corpus: DataFrame, how: Tuning = Tuning(), seed: int = 7, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The archive of insert strategies after the search, best first: twelve candidates a generation, at most six of
    them, mutants, crosses and random ones (5 : 3 : 2) of the elites; it stops from the fourth on at a fitness of 0.9.
    At least 100 vectors are needed."""
    spark, rng = corpus.sparkSession, random.Random(seed)
    rows = corpus.where(F.col(vec_col).isNotNull()).orderBy(F.xxhash64(F.col(id_col), F.lit(seed)), id_col).limit(max(100, how.sample)).select(vec_col).collect()
    if len(rows) < 100:
        raise search.NotTrained("tuning of inserts needs at least 100 vectors")
    x = np.array([r[0] for r in rows], np.float64)
    names = tuple(INSERT_GENES)
    people = [*INSERT_SEEDS, *(tuple(genome(rng, INSERT_GENES)[g] for g in names) for _ in range(12 - len(INSERT_SEEDS)))]
    elites, seq = None, 0
    for gen in range(6):
        measured = insert_measures(insert_timings(spark, people, x)).select("*", insert_fitness(how.insert_priority).alias("fitness"), *insert_behaviour(how.insert_grid)).toPandas()
        measured["seq"] += seq
        seq += len(people)
        now = pd.concat([elites[measured.columns], measured]) if elites is not None else measured
        elites = archive(spark.createDataFrame(now), ["t_bin", "e_bin"]).toPandas().sort_values("seq")  # at most grid^2 rows
        if gen >= 3 and elites["fitness"].max() >= 0.9:
            break
        parents = elites[list(names)].to_dict("records")
        people = [tuple(g[n] for n in names) for g in offspring(parents, 12, rng, (0.5, 0.3, 0.0), INSERT_GENES)]
    return spark.createDataFrame(elites.reset_index(drop=True)).orderBy(F.desc("fitness"), "seq")


@dataclass(frozen=True)
class Individual:
    """A solution with its fitness, features and cell, and the step it came from."""

    solution: object
    fitness: float
    features: tuple[float, ...]
    cell: tuple[int, ...]
    generation: int = 0


@dataclass(frozen=True)
class MapElites:
    """Settings of the loop: cells a side, the first population, candidates a step, steps, coverage to stop at."""

    resolution: int = 20
    population: int = 100
    batch: int = 50
    generations: int = 1000
    target: float = 0.8
    dims: int = 2


class Archive:
    """The fittest individual of each cell, at most ``resolution`` to the power of the dimensions."""

    def __init__(self, resolution: int, dims: int):
        self.resolution, self.dims, self.cells = resolution, min(dims, 4), {}
        self.generation = self.evaluations = 0

    def try_add(self, solution: object, fitness_: float, features: list[float]) -> bool:
        """Whether the individual is the fittest of its cell so far; of equals the earlier stays."""
        self.evaluations += 1
        cell = tuple(min(int(min(max(f, 0.0), 1.0) * self.resolution), self.resolution - 1) for f in features[: self.dims])
        if cell in self.cells and fitness_ <= self.cells[cell].fitness:
            return False
        self.cells[cell] = Individual(solution, fitness_, tuple(features), cell, self.generation)
        return True

    def get(self, cell: tuple[int, ...]) -> Individual | None:
        return self.cells.get(cell)

    def elites(self) -> list[Individual]:
        """Best first."""
        return sorted(self.cells.values(), key=lambda x: -x.fitness)

    def random_elite(self, rng: random.Random) -> Individual:
        return rng.choice(list(self.cells.values()))

    def coverage(self) -> float:
        return len(self.cells) / self.resolution**self.dims


def map_elites(generate: Callable[[random.Random], object], mutate: Callable[[object, random.Random], object], evaluate_: Callable[[list], list[tuple[float, list[float]]]], how: MapElites = MapElites(), seed: int = 7) -> Archive:
    """The archive after the loop.  ``evaluate_`` takes a batch of solutions, so it can score them as one DataFrame.
    Stops at the target coverage, or after 50 steps that added nothing."""
    rng, out, idle = random.Random(seed), Archive(how.resolution, how.dims), 0

    def add(batch_: list) -> bool:
        return any([out.try_add(s, fit, feats) for s, (fit, feats) in zip(batch_, evaluate_(batch_))])

    add([generate(rng) for _ in range(how.population)])
    for _ in range(how.generations):
        if out.coverage() >= how.target or idle >= 50:
            break
        out.generation += 1
        idle = 0 if add([mutate(out.random_elite(rng).solution, rng) for _ in range(how.batch)]) else idle + 1
    return out


def mutated_words(text: str, rng: random.Random) -> str:
    """A text with a word left out, repeated at the end, or two words swapped."""
    w = text.split()
    if len(w) < 2:
        return text
    what, i = rng.randrange(3), rng.randrange(len(w))
    if what == 0:
        del w[i]
    elif what == 1:
        w.append(w[i])
    else:
        j = rng.randrange(len(w))
        w[i], w[j] = w[j], w[i]
    return " ".join(w)
