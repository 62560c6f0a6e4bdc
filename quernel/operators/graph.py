"""A typed concept graph as two tables: concepts ``(id, name, ...)`` and edges ``(src, dst, rel_type, weight)``.

Traversals go level by level as joins of the frontier with the edges; each level is written once to the shared
checkpoint folder, so plans stay short and a lost executor costs one level."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quernel.plans.lineage import cut, release

IS_A = "is_a"
RELATIONS = (IS_A, "part_of", "related_to", "causes", "precedes", "opposite_of", "same_as", "in_domain")


class CycleError(ValueError):
    """An edge would close a cycle of is_a relations."""


def clamped(edges: DataFrame) -> DataFrame:
    """Edges with the weight, 1 by default, in 0..1."""
    return edges.withColumn("weight", F.least(F.greatest(F.coalesce(F.col("weight"), F.lit(1.0)), F.lit(0.0)), F.lit(1.0)))


def kept(edges: DataFrame, types: list[str] | None = None, least_weight: float = 0.0) -> DataFrame:
    """The edges of the given types (all, if none are given) with at least a weight."""
    out = edges.where(F.col("weight") >= least_weight)
    return out.where(F.col("rel_type").isin(types)) if types else out


def outgoing(edges: DataFrame, node: str, rel_type: str | None = None) -> DataFrame:
    out = edges.where(F.col("src") == node)
    return out.where(F.col("rel_type") == rel_type) if rel_type else out


def incoming(edges: DataFrame, node: str) -> DataFrame:
    return edges.where(F.col("dst") == node)


def by_name(concepts: DataFrame, order_col: str) -> DataFrame:
    """``(name, id)``: the last concept written under each name."""
    return concepts.groupBy("name").agg(F.max_by("id", F.struct(order_col, "id")).alias("id"))


def upsert_concepts(concepts: DataFrame, change: DataFrame) -> DataFrame:
    """Concepts with those of ``change`` added or put in place of the ones with their ids."""
    return concepts.join(change.select("id").distinct(), "id", "left_anti").select(*change.columns).unionByName(change)


def embedded(concepts: DataFrame, vectors: DataFrame) -> DataFrame:
    """The concepts whose ``embedding_id`` is a vector's ``id``."""
    return concepts.join(vectors.select(F.col("id").alias("embedding_id")).distinct(), "embedding_id", "left_semi")


def counts(edges: DataFrame) -> DataFrame:
    """``(rel_type, n)``."""
    return edges.groupBy("rel_type").agg(F.count("*").alias("n"))


def valid(edges: DataFrame, concepts: DataFrame) -> DataFrame:
    """The edges whose two ends are concepts."""
    ids = concepts.select("id").distinct()
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select(*edges.columns)


def reach(edges: DataFrame, starts: DataFrame, max_depth: int | None = None, both_ways: bool = False) -> DataFrame:
    """``(start, id, depth)``: what each start reaches, itself at depth 0, at its least depth.  ``starts`` has ``id``."""
    hop = edges.select("src", "dst")
    if both_ways:
        hop = hop.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    hop = cut(hop.distinct())
    # A level is a table of its own and written once; what is seen is their union.
    levels = [cut(starts.select(F.col("id").alias("start"), "id", F.lit(0).alias("depth")).distinct())]
    seen, depth = levels[0], 0
    while max_depth is None or depth < max_depth:
        depth += 1
        met = levels[-1].join(hop, levels[-1]["id"] == hop["src"]).select("start", F.col("dst").alias("id")).distinct()
        new = cut(met.join(seen.select("start", "id"), ["start", "id"], "left_anti").select("start", "id", F.lit(depth).alias("depth")))
        if new.isEmpty():
            release(new)
            break
        levels.append(new)
        seen = seen.unionByName(new)
        if len(levels) % 32 == 0:  # plans stay short
            seen = cut(seen)
            release(*levels[:-1])
    release(hop)
    return seen


def bfs(edges: DataFrame, start: DataFrame, max_depth: int = 10, types: list[str] | None = None, least_weight: float = 0.0, both_ways: bool = False) -> DataFrame:
    """Breadth-first search with filters on the edges; see ``reach``."""
    return reach(kept(edges, types, least_weight), start, max_depth, both_ways)


def ancestors(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """``(start, id)``, a row for each is_a edge that leaves a node reached from the start: where two lines meet again
    an ancestor is repeated."""
    is_a = kept(edges, [IS_A])
    r = reach(is_a, starts)
    return r.join(is_a, r["id"] == is_a["src"]).select("start", F.col("dst").alias("id"))


def descendants(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """As ``ancestors``, downwards."""
    return ancestors(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "rel_type", "weight"), starts)


def closes_cycle(edges: DataFrame, new: DataFrame) -> DataFrame:
    """``(src, dst, closes)`` for new is_a edges: whether dst already reaches src (an edge to itself does)."""
    r = reach(kept(edges, [IS_A]), new.select(F.col("dst").alias("id")))
    hit = r.select(F.col("start").alias("dst"), F.col("id").alias("src"), F.lit(True).alias("hit")).distinct()
    return new.select("src", "dst").join(hit, ["src", "dst"], "left").select("src", "dst", F.coalesce("hit", F.lit(False)).alias("closes"))


def add_edges(edges: DataFrame, new: DataFrame, concepts: DataFrame) -> DataFrame:
    """The edges with the valid new ones; raises ``CycleError`` if an is_a edge would close a cycle."""
    new = clamped(valid(new, concepts))
    is_a = new.where(F.col("rel_type") == IS_A)
    if not closes_cycle(edges.unionByName(new.where(F.col("rel_type") == IS_A)), is_a.select(F.col("src"), F.col("dst"))).where("closes").isEmpty():
        raise CycleError("the new edges would close a cycle")
    return edges.unionByName(new)


def shortest_path(edges: DataFrame, start: str, end: str, max_depth: int = 10, types: list[str] | None = None, least_weight: float = 0.0) -> DataFrame:
    """``(path, cost, hops)``: the path of least total 1 / max(weight, 0.01) of at most ``max_depth`` edges; one row,
    or none.  Ties go to the path that sorts first."""
    spark = edges.sparkSession
    step = kept(edges, types, least_weight).select("src", "dst", (1 / F.greatest(F.col("weight").cast("double"), F.lit(0.01))).alias("step"))
    best = cut(spark.createDataFrame([(start, 0.0, [start])], "id string, cost double, path array<string>"))
    done, levels = best, [best]
    for _ in range(max_depth):
        # a node is kept once a level: the cheapest way to it with exactly so many edges
        way = Window.partitionBy("id").orderBy("cost", "path")
        new = best.join(step, best["id"] == step["src"]).where(~F.array_contains("path", F.col("dst"))).select(F.col("dst").alias("id"), (F.col("cost") + F.col("step")).alias("cost"), F.concat("path", F.array("dst")).alias("path"))
        new = cut(new.withColumn("n", F.row_number().over(way)).where("n = 1").drop("n"))
        if new.isEmpty():
            break
        best, done = new, done.unionByName(new)
        levels.append(new)
    out = cut(done.where(F.col("id") == end).orderBy(F.round("cost", 9), "path").limit(1).select("path", "cost", (F.size("path") - 1).alias("hops")))
    release(*levels)
    return out


def all_paths(edges: DataFrame, start: str, end: str, max_nodes: int) -> DataFrame:
    """``(path)``: every simple path of at most ``max_nodes`` nodes that ends when it first comes to ``end``; parallel
    edges give it several times."""
    spark = edges.sparkSession
    now = spark.createDataFrame([(start, [start])], "id string, path array<string>")
    out, levels = now.where(F.col("id") == end).select("path"), []
    for _ in range(max_nodes - 1):
        now = cut(now.where(F.col("id") != end).join(edges.select("src", "dst"), F.col("id") == F.col("src")).where(~F.array_contains("path", F.col("dst"))).select(F.col("dst").alias("id"), F.concat("path", F.array("dst")).alias("path")))
        if now.isEmpty():
            break
        levels.append(now)
        out = out.unionByName(now.where(F.col("id") == end).select("path"))
    out = cut(out)
    release(*levels)
    return out


def neighbourhood(edges: DataFrame, centers: DataFrame, hops: int) -> DataFrame:
    """``(start, id, score)``: what lies within ``hops``, scored 1 / (depth + 1)."""
    return reach(edges, centers, hops).select("start", "id", (1.0 / (F.col("depth") + 1)).alias("score"))


def degrees(edges: DataFrame) -> DataFrame:
    """``(id, n_out, n_in)``; both ends are pre-aggregated before they meet."""
    out = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n_out"))
    in_ = edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n_in"))
    return out.join(in_, "id", "full").fillna(0, ["n_out", "n_in"])
