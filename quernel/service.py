"""A facade over the store, the indexes, the concept graph and the tuner: what a client of the search service calls."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.functions.vectors import normalized
from quernel.operators import graph, index, search, tuning
from quernel.plans.lineage import cut
from quernel.sources.store import VectorStore, summary

# The tools a function-calling client sees (name, description, parameters, required ones).
TOOLS = (
    ("vector_search", "Find the stored vectors nearest to a query vector.", {"query": "array", "k": "integer"}, ("query", "k")),
    ("concept_traverse", "Walk the concept graph from a concept.", {"start": "string", "max_depth": "integer"}, ("start",)),
    ("tune_index", "Search for better index settings.", {"priority": "string"}, ()),
    ("index_status", "Describe the active index.", {}, ()),
)


def tool_definitions(style: str = "function") -> list[dict]:
    """The tools as JSON-schema dicts, either wrapped as functions or with an input schema."""
    out = []
    for name, text, params, required in TOOLS:
        schema = {"type": "object", "properties": {k: {"type": v} for k, v in params.items()}, "required": list(required)}
        out.append({"type": "function", "function": {"name": name, "description": text, "parameters": schema}} if style == "function" else {"name": name, "description": text, "input_schema": schema})
    return out


class VectorService:
    """One collection of vectors of a dimension, and a concept graph.  Vectors are stored as they come unless
    ``normalize`` is set.  An index is built when it is configured; later inserts and removals go into it."""

    def __init__(self, spark: SparkSession, store: VectorStore, dim: int = 768, metric: str = search.COSINE, normalize: bool = False):
        self.spark, self.store, self.normalize = spark, store, normalize
        self.config = search.IndexConfig(dim, metric, "flat")
        self.partitions, self.nprobe = 256, 16
        self.index: index.VectorIndex | None = None  # None: the exact search over the store
        self.priority, self.elites, self.insert_elites = "default", None, None
        self.concepts = spark.createDataFrame([], "id string, name string, description string")
        self.edges = spark.createDataFrame([], "src string, dst string, rel_type string, weight double")

    # ---- vectors

    def add(self, df: DataFrame) -> tuple[int, int]:
        """(accepted, rejected) rows of ``(vec_id, embedding)``; rows of another dimension are rejected, an id that is
        there is replaced."""
        good, bad = search.reject_wrong(df, self.config.dim)
        if self.normalize:
            good = good.withColumn("embedding", normalized("embedding").cast("array<float>"))
        n = self.store.put_batch(good)
        if self.index is not None:
            self.index.insert(good.select("vec_id", "embedding"))
        return n, bad.count()

    def remove(self, vec_id: int) -> bool:
        there = self.store.delete(vec_id)
        if there and self.index is not None:
            self.index.remove(self.spark.createDataFrame([(vec_id,)], "vec_id long"))
        return there

    def get(self, vec_id: int) -> list[float] | None:
        return self.store.get(vec_id)

    def clear(self) -> None:
        """Remove all vectors; the exact index is active afterwards."""
        self.store.clear()
        self.reset()

    def search(self, queries: DataFrame, k: int = 10) -> DataFrame:
        """``(query_id, rank, vec_id, score)`` by the active index."""
        if self.index is not None:
            return self.index.search(queries, k)
        return search.knn(queries, self.store.rows(), k, self.config.metric, self.config.dim)

    # ---- the index

    def configure(self, kind: str, m: int = 16, ef_construction: int = 200, ef_search: int = 50, partitions: int = 256, nprobe: int = 16) -> None:
        """Choose and build flat, hnsw or ivf; an ivf index with more partitions than vectors is refused and the old
        one stays."""
        if kind not in ("flat", "hnsw", "ivf"):
            raise ValueError(f"no such index: {kind}")
        config = replace(self.config, kind=kind, m=m, ef_construction=ef_construction, ef_search=ef_search)
        built = None
        if kind == "ivf":
            if self.store.count() < partitions:
                raise search.NotTrained(f"{partitions} partitions need as many vectors")
            built = index.ivf_of(self.store.rows(), index.IvfConfig(config.dim, partitions, nprobe, 15, config.metric))
        elif kind == "hnsw":
            built = index.hnsw_of(self.store.rows(), config)
        self.config, self.partitions, self.nprobe, self.index = config, partitions, min(nprobe, partitions), built

    def reset(self) -> None:
        """Back to the exact index; the vectors stay."""
        self.configure("flat")

    def apply_preset(self, name: str) -> None:
        """Build the index of a preset."""
        p = {row[0]: row[1:] for row in tuning.PRESETS}[name]
        self._apply(*p)

    def recommend_preset(self, priority: str = "balanced") -> str:
        asked = self.spark.createDataFrame([(self.store.count(), priority)], "n long, priority string")
        return asked.select(tuning.recommended_preset(F.col("n"), F.col("priority")).alias("p")).first().p

    def apply_recommended_preset(self, priority: str = "balanced") -> str:
        name = self.recommend_preset(priority)
        self.apply_preset(name)
        return name

    def _apply(self, kind: str, m: int | None, efc: int | None, efs: int | None, partitions: int | None, nprobe: int | None) -> None:
        given = {"m": m, "ef_construction": efc, "ef_search": efs, "partitions": partitions, "nprobe": nprobe}
        self.configure(kind, **{k: int(v) for k, v in given.items() if v is not None})

    def apply_precomputed(self, seq: int) -> None:
        """Build the index of an entry of the precomputed grid."""
        self._apply(*tuning.GRID[seq][2:8])

    def matching_precomputed(self) -> list[int]:
        """The entries of the grid whose range of sizes holds the collection's."""
        n = self.store.count()
        return [i for i, g in enumerate(tuning.GRID) if g[11] <= n <= g[12]]

    def apply_best_precomputed(self, min_recall: float, max_latency: float) -> int:
        """Build the grid's best entry that meets both, and return it; raises if there is none."""
        asked = self.spark.createDataFrame([(self.store.count(), min_recall, max_latency)], "n long, min_recall double, max_latency double")
        row = tuning.grid_select(asked).first()
        if row is None:
            raise LookupError("no entry of the grid meets this")
        self.apply_precomputed(row.seq)
        return row.seq

    def apply_recommended_from_grid(self, priority: str = "balanced") -> int:
        asked = self.spark.createDataFrame([(self.store.count(), priority)], "n long, priority string")
        seq = tuning.grid_recommend(asked).first().seq
        self.apply_precomputed(seq)
        return seq

    # ---- tuning

    def tune(self, priority: str | None = None, thorough: bool = False, inserts: bool = False) -> DataFrame:
        """The elites of a search with the priority's weights; the best becomes the active index, built on all
        vectors.  With ``inserts``, ways to insert are tuned as well; too few vectors for that are no error."""
        self.priority = priority or self.priority
        how = replace(tuning.TUNINGS["thorough" if thorough else "default"], priority=self.priority)
        self.elites = tuning.tune(self.store.rows(), how).toPandas()  # at most grid^3 rows
        self._use_best()
        if inserts:
            try:
                self.insert_elites = tuning.evolve_inserts(self.store.rows(), how).toPandas()
            except search.NotTrained:
                self.insert_elites = None
        return self.spark.createDataFrame(self.elites)

    def set_priority(self, priority: str | tuple[float, float, float, float]) -> None:
        """Score the elites anew, from what was measured, and let the one that is then the best be active."""
        self.priority = priority
        if self.elites is not None:
            again = self.spark.createDataFrame(self.elites).withColumn("fitness", tuning.fitness(priority))
            self.elites = again.orderBy(F.desc("fitness"), "seq").toPandas()
            self._use_best()

    def _use_best(self) -> None:
        best = self.elites.iloc[0]
        self._apply(best.kind, best.m, best.efc, best.efs, min(int(best.partitions), max(1, self.store.count())), best.nprobe)

    def best_elite(self) -> dict | None:
        return None if self.elites is None else self.elites.iloc[0].to_dict()

    def diverse(self, n: int) -> list[dict]:
        """The n best elites, each of another cell."""
        return [] if self.elites is None else self.elites.head(n).to_dict("records")

    def coverage(self, cells: int = 216) -> float:
        """Per cent of the archive's cells that are filled."""
        return 0.0 if self.elites is None else 100.0 * len(self.elites) / cells

    def active_insert_strategy(self) -> str | None:
        return None if self.insert_elites is None else str(self.insert_elites.iloc[0].strategy)

    # ---- the concept graph

    def add_concepts(self, df: DataFrame) -> None:
        """Add or replace concepts ``(id, name, description)``."""
        self.concepts = cut(graph.upsert_concepts(self.concepts, df.select(*self.concepts.columns)))

    def concept(self, concept_id: str) -> dict | None:
        r = self.concepts.where(F.col("id") == concept_id).first()
        return r.asDict() if r else None

    def add_relations(self, df: DataFrame) -> None:
        """Add edges ``(src, dst, rel_type, weight)`` between concepts; raises where a cycle of is_a would close."""
        self.edges = cut(graph.add_edges(self.edges, df.select(*self.edges.columns), self.concepts))

    def traverse(self, start: str, max_depth: int = 3) -> list[dict]:
        """The concepts that a concept reaches, with their depth."""
        first = self.spark.createDataFrame([(start,)], "id string")
        return [r.asDict() for r in graph.bfs(self.edges, first, max_depth).select("id", "depth").orderBy("depth", "id").collect()]

    # ---- what is reported, and tools

    def health(self) -> dict:
        one = summary(self.store.rows()).first()
        stats = self.store.stats()
        return {"status": "ok", "dim": self.config.dim, "index": self.config.kind, "metric": self.config.metric, "coverage": self.coverage(), **stats, "vectors": one.vectors}

    def call_tool(self, name: str, params: dict) -> list[dict] | dict:
        """Dispatch a tool call; entries of a query that are no numbers are dropped, an unknown tool is an error."""
        if name == "vector_search":
            v = [float(x) for x in params["query"] if isinstance(x, (int, float)) and not isinstance(x, bool)]
            q = self.spark.createDataFrame([(0, v)], "vec_id long, embedding array<float>")
            return [r.asDict() for r in self.search(q, int(params["k"])).orderBy("rank").collect()]
        if name == "index_status":
            return self.health()
        if name == "tune_index":
            return [r.asDict() for r in self.tune(params.get("priority", "default")).collect()]
        if name == "concept_traverse":
            return self.traverse(params["start"], int(params.get("max_depth", 3)))
        raise ValueError(f"no such tool: {name}")
