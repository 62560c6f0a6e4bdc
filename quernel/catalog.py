"""The core's queries by name, and the SQL that gives the same rows.

Scores are rounded to six places in both, and ties are broken on distances rounded to nine."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.functions import vectors as V
from quernel.operators import graph, hierarchy, index, ingest, search, tuning
from quernel.sources import store

Query = Callable[[SparkSession, str], DataFrame]
DIM = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# ---- hierarchy -----------------------------------------------------------------------------------------------------

_CONCEPTS = """
c AS (SELECT lower(trim(id, E' \\t\\n\\r\\f')) AS key, min(id) AS id, min(nullif(lower(trim(parent, E' \\t\\n\\r\\f')), '')) AS parent
      FROM concept GROUP BY 1),
n AS (SELECT key, id, CASE WHEN parent IN (SELECT key FROM c) THEN parent END AS parent FROM c),
t AS (SELECT key, id, id AS root_id, 0 AS depth, [id] AS path FROM n WHERE parent IS NULL
      UNION ALL SELECT n.key, n.id, t.root_id, t.depth + 1, list_append(t.path, n.id) FROM n JOIN t ON n.parent = t.key)
"""


@query("p2_found", f"WITH RECURSIVE {_CONCEPTS} SELECT n.id, coalesce(t.root_id, '') AS root_id, coalesce(t.depth, -1)::INT AS depth FROM n LEFT JOIN t USING (key)")
def p2_found(s, d):
    return hierarchy.found(table(s, d, "concept"))


_SUBTREES = """
b AS (SELECT key AS top, key FROM n UNION SELECT b.top, n.key FROM b JOIN n ON n.parent = b.key),
z AS (SELECT top AS key, count(*) AS subtree_size FROM b GROUP BY top),
y AS (SELECT DISTINCT n.key FROM n JOIN b ON b.top = n.key AND b.key = n.parent)
"""


@query("p2_paths", f"WITH RECURSIVE {_CONCEPTS}, {_SUBTREES} SELECT n.id, coalesce(t.root_id, '') AS root_id, coalesce(t.depth, -1)::INT AS depth, CASE WHEN y.key IS NULL THEN z.subtree_size END::BIGINT AS subtree_size, t.path FROM n LEFT JOIN t USING (key) LEFT JOIN z USING (key) LEFT JOIN y USING (key)")
def p2_paths(s, d):
    return hierarchy.paths(table(s, d, "concept"))


@query("p2_descendants", f"WITH RECURSIVE {_CONCEPTS} SELECT path[i] AS id, id AS descendant_id, (len(path) - i)::INT AS distance FROM (SELECT id, path, unnest(range(1, len(path))) AS i FROM t WHERE depth > 0)")
def p2_descendants(s, d):
    return hierarchy.descendants(table(s, d, "concept"))


# ---- vector arithmetic ---------------------------------------------------------------------------------------------

_E = "SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings"


def _emb(s, d):
    return table(s, d, "embeddings")


#: The same vectors at seven lengths, by which the metrics rank differently.
_SCALED = "SELECT vec_id, label, list_transform(embedding::DOUBLE[], lambda x: x * (1 + vec_id % 7)) AS v FROM embeddings"


def _scaled(s, d):
    return _emb(s, d).select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double") * (1 + F.col("vec_id") % 7)).alias("embedding"))


def _asked(s, d):
    return _emb(s, d).where(F.col("vec_id") % 50 == 0)


@query("vector_norms", f"SELECT vec_id, round(list_sum(list_transform(v, lambda x: x * x)), 6) AS squared, round(sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS norm, round(list_sum(v), 6) AS total FROM ({_E})")
def vector_norms(s, d):
    return _emb(s, d).select("vec_id", F.round(V.squared_norm("embedding"), 6).alias("squared"), F.round(V.norm("embedding"), 6).alias("norm"), F.round(V.total("embedding"), 6).alias("total"))


@query("vector_arithmetic", f"SELECT a.vec_id, round(list_sum(list_transform(list_zip(a.v, b.v), lambda x: (x[1] + x[2]) * 0.5)), 6) AS half_sum, round(list_distance(a.v, b.v) ^ 2, 6) AS squared, round(list_distance(a.v, b.v), 6) AS distance, round(list_inner_product(a.v, b.v), 6) AS dot, round(-list_inner_product(a.v, b.v), 6) AS negative_dot, round(1 - list_cosine_similarity(a.v, b.v), 6) AS cosine_distance, round(list_inner_product(a.v, b.v) / (sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(b.v, b.v)) + 1e-10), 6) + 0.0 AS smoothed FROM ({_E}) a JOIN ({_E}) b ON b.vec_id = a.vec_id + 1")
def vector_arithmetic(s, d):
    a = _emb(s, d).select("vec_id", F.col("embedding").alias("v"))
    b = _emb(s, d).select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("w"))
    return a.join(b, "vec_id").select(
        "vec_id", F.round(V.total(V.scale(V.add("v", "w"), 0.5)), 6).alias("half_sum"), F.round(V.squared_distance("v", "w"), 6).alias("squared"), F.round(V.distance("v", "w"), 6).alias("distance"),
        F.round(V.dot("v", "w"), 6).alias("dot"), F.round(-V.dot("v", "w"), 6).alias("negative_dot"), F.round(1 - V.cosine("v", "w"), 6).alias("cosine_distance"), (F.round(V.smoothed_cosine("v", "w"), 6) + F.lit(0.0)).alias("smoothed"),
    )


@query("normalized_vectors", f"SELECT vec_id, list_transform(v, lambda x: round(x / sqrt(list_sum(list_transform(v, lambda y: y * y))), 6)) AS unit FROM ({_E})")
def normalized_vectors(s, d):
    return _emb(s, d).select("vec_id", F.transform(V.normalized("embedding"), lambda x: F.round(x, 6)).alias("unit"))


@query("norm_and_unit", f"SELECT vec_id, round(sqrt(list_inner_product(v, v)), 6) AS norm, list_transform(v, lambda x: round(x / sqrt(list_inner_product(v, v)), 6)) AS unit FROM ({_SCALED})")
def norm_and_unit(s, d):
    out = _scaled(s, d).select("vec_id", V.norm_and_unit("embedding").alias("n"))
    return out.select("vec_id", F.round("n.norm", 6).alias("norm"), F.transform("n.unit", lambda x: F.round(x, 6)).alias("unit"))


@query("zero_vector_rule", f"SELECT vec_id, 0.0::DOUBLE AS cosine, 0.0::DOUBLE AS smoothed FROM ({_E})")
def zero_vector_rule(s, d):
    return _emb(s, d).withColumn("z", V.zeros(DIM)).select("vec_id", V.cosine("embedding", "z").alias("cosine"), F.abs(V.smoothed_cosine("embedding", "z")).alias("smoothed"))


@query("dim_guard", "SELECT id, coalesce(len(embedding), -1)::INT AS n FROM (SELECT DISTINCT id, embedding FROM vectors) WHERE embedding IS NULL OR len(embedding) <> 64")
def dim_guard(s, d):
    _, bad = search.reject_wrong(table(s, d, "vectors"), DIM)
    return bad.select("id", F.coalesce(F.when(F.col("embedding").isNotNull(), F.size("embedding")), F.lit(-1)).alias("n")).distinct()


# ---- the store -----------------------------------------------------------------------------------------------------


@query("store_upsert", "SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN label + 100 ELSE label END AS label FROM embeddings")
def store_upsert(s, d):
    e = _emb(s, d).select("vec_id", "label")
    return store.upsert(e, e.where("vec_id % 3 = 0").select("vec_id", (F.col("label") + 100).cast("int").alias("label")))


@query("store_newest", "SELECT id, count(*)::BIGINT AS versions, max(created_at) AS newest FROM vectors GROUP BY id")
def store_newest(s, d):
    v = table(s, d, "vectors").select("id", "created_at")
    n = store.newest(v, "id", "created_at")
    return n.join(v.groupBy("id").agg(F.count("*").alias("versions")), "id").select("id", "versions", F.col("created_at").alias("newest"))


@query("store_delete", "SELECT vec_id, label FROM embeddings WHERE label <> 3")
def store_delete(s, d):
    e = _emb(s, d).select("vec_id", "label")
    return store.without(e, e.where("label = 3"))


@query("store_contains", "SELECT w.vec_id, w.vec_id IN (SELECT vec_id FROM embeddings) AS there FROM (SELECT vec_id * 7 AS vec_id FROM embeddings) w")
def store_contains(s, d):
    return store.contained(_emb(s, d), _emb(s, d).select((F.col("vec_id") * 7).alias("vec_id")))


@query("store_recover", "SELECT coalesce(len(embedding) = 64, false) AS usable, count(*)::BIGINT AS n FROM vectors GROUP BY 1")
def store_recover(s, d):
    good, bad = store.recovered(table(s, d, "vectors"), DIM)
    return good.select(F.lit(True).alias("usable")).unionByName(bad.select(F.lit(False).alias("usable"))).groupBy("usable").agg(F.count("*").alias("n"))


@query("store_metadata", "SELECT id, CASE WHEN id % 3 = 0 THEN 'new ' || filename ELSE filename END AS filename FROM (SELECT id, any_value(filename) AS filename FROM doc_store GROUP BY id)")
def store_metadata(s, d):
    m = table(s, d, "doc_store").select("id", "filename").dropDuplicates(["id"])
    new = m.where("id % 3 = 0").withColumn("filename", F.concat(F.lit("new "), "filename"))
    return store.write_metadata(m, new.unionByName(new))


# ---- search --------------------------------------------------------------------------------------------------------


def _knn_sql(dist: str, score: str, where: str = "true", k: int = 10, vectors: str = _E) -> str:
    return f"""
WITH e AS ({vectors}), p AS (SELECT q.vec_id AS query_id, e.vec_id, {dist} AS dist FROM e q, e WHERE q.vec_id % 50 = 0 AND {where}),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(dist, 9), vec_id) AS rank FROM p)
SELECT query_id, rank::INT AS rank, vec_id, round({score}, 6) + 0.0 AS score FROM r WHERE rank <= {k}"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.select("query_id", "rank", "vec_id", (F.round("score", 6) + F.lit(0.0)).alias("score"))


_COS = "1 - list_cosine_similarity(q.v, e.v)"


@query("knn_cosine", _knn_sql(_COS, "1 - dist"))
def knn_cosine(s, d):
    return _rounded(search.knn(_asked(s, d), _emb(s, d), 10, search.COSINE, DIM))


@query("knn_euclidean", _knn_sql("list_distance(q.v, e.v)", "dist"))
def knn_euclidean(s, d):
    return _rounded(search.knn(_asked(s, d), _emb(s, d), 10, search.EUCLIDEAN, DIM))


@query("knn_dot", _knn_sql("-list_inner_product(q.v, e.v)", "dist"))
def knn_dot(s, d):
    return _rounded(search.knn(_asked(s, d), _emb(s, d), 10, search.DOT, DIM))


for _n, _d, _s in ((search.COSINE, _COS, "1 - dist"), (search.EUCLIDEAN, "list_distance(q.v, e.v)", "dist"), (search.DOT, "-list_inner_product(q.v, e.v)", "dist")):
    query(f"knn_scaled_{_n}", _knn_sql(_d, _s, vectors=_SCALED))(lambda s, d, m=_n: _rounded(search.knn(_scaled(s, d).where("vec_id % 50 = 0"), _scaled(s, d), 10, m, DIM)))


@query("knn_filtered_by_label", _knn_sql(_COS, "1 - dist", "e.label = 2"))
def knn_filtered_by_label(s, d):
    return _rounded(search.knn(_asked(s, d), _emb(s, d).where("label = 2"), 10, search.COSINE, DIM))


@query("knn_label_vote", f"WITH k AS ({_knn_sql(_COS, '1 - dist')}), v AS (SELECT query_id, label, count(*) AS n FROM k JOIN embeddings USING (vec_id) GROUP BY ALL) SELECT query_id, label, n::BIGINT AS votes FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, label) AS r FROM v) WHERE r = 1")
def knn_label_vote(s, d):
    k = search.knn(_asked(s, d), _emb(s, d), 10, search.COSINE, DIM)
    votes = k.join(_emb(s, d).select("vec_id", "label"), "vec_id").groupBy("query_id", "label").agg(F.count("*").alias("votes"))
    return votes.groupBy("query_id").agg(F.max_by(F.struct("label", "votes"), F.struct("votes", -F.col("label"))).alias("b")).select("query_id", "b.label", "b.votes")


@query("batch_dot", f"SELECT q.vec_id AS query_id, e.vec_id, round(list_inner_product(q.v, e.v), 6) + 0.0 AS dot FROM ({_E}) q, ({_E}) e WHERE q.vec_id % 50 = 0")
def batch_dot(s, d):
    out = search.scores(_asked(s, d), _emb(s, d), search.DOT, DIM)
    return out.select("query_id", "vec_id", (F.round(-F.col("dist"), 6) + F.lit(0.0)).alias("dot"))


@query("batch_distances", f"SELECT q.vec_id AS query_id, e.vec_id, round(list_sum(list_transform(list_zip(q.v, e.v), lambda x: abs(x[1] - x[2]))), 6) AS dist FROM ({_E}) q, ({_E}) e WHERE q.vec_id % 50 = 0")
def batch_distances(s, d):
    import numpy as np

    def city_block(q, x):
        return np.abs(q[:, None, :] - x[None, :, :]).sum(axis=2)

    out = search.scores(_asked(s, d), _emb(s, d), city_block, DIM)
    return out.select("query_id", "vec_id", F.round("dist", 6).alias("dist"))


# ---- k-means, inverted lists, product quantization -------------------------------------------------------------------


def _kmeans_sql(clusters: int, rounds: int, dist: str, vectors: str = "x AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)", p: str = "") -> str:
    """CTEs: c{rounds} holds (k, c), a{rounds} the final assignment (vec_id, v, k)."""
    x = vectors.split(" ", 1)[0]
    out = [vectors, f"{p}c0 AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS k, v AS c FROM (SELECT * FROM {x} ORDER BY vec_id LIMIT {clusters}))"]
    for i in range(rounds + 1):
        out.append(f"{p}a{i} AS MATERIALIZED (SELECT vec_id, v, k FROM (SELECT vec_id, v, k, row_number() OVER (PARTITION BY vec_id ORDER BY round({dist}, 12), k) AS n FROM {x}, {p}c{i}) WHERE n = 1)")
        if i < rounds:
            out.append(f"{p}m{i} AS (SELECT k, list(m ORDER BY pos) AS c FROM (SELECT k, pos, avg(val) AS m FROM (SELECT k, unnest(v) AS val, unnest(range(len(v))) AS pos FROM {p}a{i}) GROUP BY ALL) GROUP BY k)")
            out.append(f"{p}c{i + 1} AS MATERIALIZED (SELECT k, coalesce(m.c, {p}c{i}.c) AS c FROM {p}c{i} LEFT JOIN {p}m{i} m USING (k))")
    return ", ".join(out)


_KM = _kmeans_sql(8, 3, "1 - list_cosine_similarity(v, c)")


def _trained(s, d):
    return search.kmeans(_emb(s, d), 8, 3, search.COSINE)


@query("kmeans_centroids", f"WITH {_KM} SELECT k::BIGINT AS k, list_transform(c, lambda x: round(x, 6)) AS centroid FROM c3")
def kmeans_centroids(s, d):
    c = _trained(s, d)
    return s.createDataFrame([(k, [round(float(x), 12) for x in row]) for k, row in enumerate(c)], "k long, c array<double>").select("k", F.transform("c", lambda x: F.round(x, 6)).alias("centroid"))


@query("kmeans_assign", f"WITH {_KM} SELECT vec_id, k::INT AS part FROM a3")
def kmeans_assign(s, d):
    return search.assigned(_emb(s, d), _trained(s, d)).select("vec_id", "part")


#: Indexes that were built in this session: what a search reads, however often it is asked.
_BUILT: dict[tuple, object] = {}


def _built(s, d, name: str, make):
    key = (s.sparkContext.applicationId, d, name)
    if key not in _BUILT:
        _BUILT[key] = make()
    return _BUILT[key]


def _ivf(s, d) -> index.IvfIndex:
    return _built(s, d, "ivf", lambda: index.ivf_of(_emb(s, d), index.IvfConfig(DIM, 8, 6, 3)))


def _hnsw(s, d) -> index.HnswIndex:
    return _built(s, d, "hnsw", lambda: index.hnsw_of(_emb(s, d), search.IndexConfig(DIM, m=8, ef_construction=60, ef_search=60)))


def _pq(s, d) -> index.PqIndex:
    def make():
        out = index.PqIndex(s, index.PqConfig(DIM, _M, _K, 2))
        out.insert(_emb(s, d))
        out.train()
        return out

    return _built(s, d, "pq", make)


def _ivf_sql(nprobe: int, km: str = _KM, final: str = "a3") -> str:
    return f"""{km}, q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id % 50 = 0),
pr AS (SELECT query_id, qv, k FROM (SELECT query_id, qv, k, row_number() OVER (PARTITION BY query_id ORDER BY round(1 - list_cosine_similarity(qv, c), 12), k) AS n FROM q, c3) WHERE n <= {nprobe}),
f AS (SELECT query_id, vec_id, 1 - list_cosine_similarity(qv, v) AS dist FROM pr JOIN {final} USING (k)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(dist, 9), vec_id) AS rank FROM f)"""


_IVF_ROWS = "SELECT query_id, rank::INT AS rank, vec_id, round(1 - dist, 6) + 0.0 AS score FROM r WHERE rank <= 10"


@query("ivf_search", f"WITH {_ivf_sql(6)} {_IVF_ROWS}")
def ivf_search(s, d):
    return _rounded(_ivf(s, d).search(_asked(s, d), 10))


@query("ivf_full_probe", f"WITH {_ivf_sql(8)} {_IVF_ROWS}")
def ivf_full_probe(s, d):
    ivf = _ivf(s, d)
    return _rounded(search.ivf_search(_asked(s, d), ivf._postings.live(), ivf.centroids, 10, 8))  # noqa: SLF001


@query("ivf_untrained", _knn_sql(_COS, "1 - dist"))
def ivf_untrained(s, d):
    ivf = index.IvfIndex(s, index.IvfConfig(DIM, 8, 6, 3))
    ivf.insert(_emb(s, d))
    return _rounded(ivf.search(_asked(s, d), 10))


_KM_PART = _kmeans_sql(8, 3, "1 - list_cosine_similarity(v, c)", "x AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 4 <> 1)")
_LATER = "aa AS (SELECT vec_id, v, k FROM (SELECT vec_id, v, k, row_number() OVER (PARTITION BY vec_id ORDER BY round(1 - list_cosine_similarity(v, c), 12), k) AS n FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings{}), c3) WHERE n = 1)"


def _grown(s, d) -> index.IvfIndex:
    """Trained on three quarters; the rest comes later, and some of the first once more."""
    ivf = index.ivf_of(_emb(s, d).where("vec_id % 4 <> 1"), index.IvfConfig(DIM, 8, 6, 3))
    ivf.insert(_emb(s, d).where("vec_id % 4 = 1 OR vec_id % 10 = 0"))
    return ivf


@query("ivf_insert", f"WITH {_ivf_sql(6, _KM_PART + ', ' + _LATER.format(''), 'aa')} {_IVF_ROWS}")
def ivf_insert(s, d):
    return _rounded(_grown(s, d).search(_asked(s, d), 10))


@query("ivf_remove", f"WITH {_ivf_sql(6, _KM_PART + ', ' + _LATER.format(' WHERE vec_id % 3 <> 2'), 'aa')} {_IVF_ROWS}")
def ivf_remove(s, d):
    ivf = _grown(s, d)
    ivf.remove(_emb(s, d).where("vec_id % 3 = 2"))
    return _rounded(ivf.search(_asked(s, d), 10))


@query("recall_at_10_ivf", f"WITH {_ivf_sql(6)}, t AS ({_knn_sql(_COS, '1 - dist')}) SELECT t.query_id, count(r.vec_id) / count(*) AS recall FROM t LEFT JOIN (FROM r WHERE rank <= 10) r ON r.query_id = t.query_id AND r.vec_id = t.vec_id GROUP BY t.query_id")
def recall_at_10_ivf(s, d):
    return search.recall(_ivf(s, d).search(_asked(s, d), 10), search.knn(_asked(s, d), _emb(s, d), 10, search.COSINE, DIM), 10)


@query("recall_of_10_ivf", f"WITH {_ivf_sql(6)}, t AS ({_knn_sql(_COS, '1 - dist', k=5)}) SELECT t.query_id, count(r.vec_id) / 10.0::DOUBLE AS recall FROM t LEFT JOIN (FROM r WHERE rank <= 10) r ON r.query_id = t.query_id AND r.vec_id = t.vec_id GROUP BY t.query_id")
def recall_of_10_ivf(s, d):
    return search.recall_of_k(_ivf(s, d).search(_asked(s, d), 10), search.knn(_asked(s, d), _emb(s, d), 5, search.COSINE, DIM), 10)


_M, _K = 4, 8
_PQ = ", ".join(_kmeans_sql(_K, 2, "list_distance(v, c)", f"x{i} AS (SELECT vec_id, list_slice(embedding::DOUBLE[], {i * 16 + 1}, {i * 16 + 16}) AS v FROM embeddings)", f"s{i}") for i in range(_M))


@query("pq_codes", f"WITH {_PQ} SELECT vec_id, [{', '.join(f's{i}a2.k::INT' for i in range(_M))}] AS code FROM s0a2 " + " ".join(f"JOIN s{i}a2 USING (vec_id)" for i in range(1, _M)))
def pq_codes(s, d):
    return search.pq_encode(_emb(s, d), search.pq_train(_emb(s, d), _M, _K, 2))


_ADC = " + ".join(f"list_distance(list_slice(qv, {i * 16 + 1}, {i * 16 + 16}), s{i}c2.c) ^ 2" for i in range(_M))


def _pq_sql(where: str) -> str:
    return f"""WITH {_PQ}, q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id % 50 = 0),
f AS (SELECT query_id, s0a2.vec_id, {_ADC} AS dist FROM q, s0a2 {" ".join(f"JOIN s{i}a2 ON s{i}a2.vec_id = s0a2.vec_id" for i in range(1, _M))} {" ".join(f"JOIN s{i}c2 ON s{i}c2.k = s{i}a2.k" for i in range(_M))} WHERE {where}),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(dist, 9), vec_id) AS rank FROM f)
SELECT query_id, rank::INT AS rank, vec_id, round(dist, 6) + 0.0 AS score FROM r WHERE rank <= 10"""


@query("pq_search", _pq_sql("true"))
def pq_search(s, d):
    return _rounded(_pq(s, d).search(_asked(s, d), 10))


@query("pq_remove", _pq_sql("s0a2.vec_id % 3 <> 2"))
def pq_remove(s, d):
    pq = index.PqIndex(s, index.PqConfig(DIM, _M, _K, 2))
    pq.insert(_emb(s, d))
    pq.train()
    pq.remove(_emb(s, d).where("vec_id % 3 = 2"))
    return _rounded(pq.search(_asked(s, d), 10))


@query("pq_compression", "SELECT m::INT AS m, 64 * 4.0::DOUBLE / m AS ratio FROM (VALUES (4), (8), (16)) t(m)")
def pq_compression(s, d):
    return s.createDataFrame([(4,), (8,), (16,)], "m int").select("m", search.compression_ratio(DIM, F.col("m")).alias("ratio"))


@query("hnsw_search")
def hnsw_search(s, d):
    return _rounded(_hnsw(s, d).search(_asked(s, d), 10))


@query("hnsw_recall", "SELECT 1 AS at_least_nine_tenths")
def hnsw_recall(s, d):
    r = search.recall(_hnsw(s, d).search(_asked(s, d), 10), search.knn(_asked(s, d), _emb(s, d), 10, search.COSINE, DIM), 10)
    return r.agg((F.avg("recall") >= 0.9).cast("int").alias("at_least_nine_tenths"))


@query("label_means", f"SELECT label, pos::INT AS pos, round(avg(x), 6) + 0.0 AS mean FROM (SELECT label, unnest(v) AS x, unnest(range(64)) AS pos FROM ({_E})) GROUP BY ALL")
def label_means(s, d):
    return _emb(s, d).select("label", F.posexplode("embedding").alias("pos", "x")).groupBy("label", "pos").agg((F.round(F.avg(F.col("x").cast("double")), 6) + F.lit(0.0)).alias("mean"))


@query("reproducible_sample")
def reproducible_sample(s, d):
    return _emb(s, d).orderBy(F.xxhash64("vec_id", F.lit(7)), "vec_id").limit(100).select("vec_id")


@query("health", "SELECT count(*)::BIGINT AS vectors, min(len(embedding))::INT AS dim FROM embeddings")
def health(s, d):
    return store.summary(_emb(s, d))


# ---- tuning --------------------------------------------------------------------------------------------------------

_ASKED_N = [(n, p) for n in (100, 5_000, 10_000, 60_000, 400_000, 2_000_000) for p in ("speed", "accuracy", "balanced", "max")]
_ASKED_SQL = "(VALUES " + ", ".join(f"({n}, '{p}')" for n, p in _ASKED_N) + ") t(n, priority)"


def _values(rows) -> str:
    lit = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)
    return "(VALUES " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows) + ")"


_GRID_SQL = f"{_values([(i, *g) for i, g in enumerate(tuning.GRID)])} g(seq, r, s, kind, m, efc, efs, partitions, nprobe, recall, latency, memory, least_n, most_n)"


@query("preset_table", f"SELECT preset, kind, m::INT AS m, efc::INT AS ef_construction, efs::INT AS ef_search, p::INT AS partitions, np::INT AS nprobe FROM {_values(tuning.PRESETS)} t(preset, kind, m, efc, efs, p, np)")
def preset_table(s, d):
    return tuning.presets(s)


@query("preset_recommendation", f"""SELECT n::BIGINT AS n, priority, CASE WHEN n <= 5000 THEN 'flat'
WHEN n <= 100000 THEN CASE priority WHEN 'speed' THEN 'hnsw_fast' WHEN 'accuracy' THEN 'hnsw_accurate' ELSE 'hnsw_balanced' END
WHEN n <= 1000000 THEN CASE priority WHEN 'speed' THEN 'ivf_fast' WHEN 'accuracy' THEN 'hnsw_max_quality' ELSE 'ivf_balanced' END
ELSE CASE priority WHEN 'speed' THEN 'ivf_fast' WHEN 'accuracy' THEN 'ivf_accurate' ELSE 'ivf_balanced' END END AS preset FROM {_ASKED_SQL}""")
def preset_recommendation(s, d):
    return s.createDataFrame(_ASKED_N, "n long, priority string").withColumn("preset", tuning.recommended_preset(F.col("n"), F.col("priority")))


@query("grid_for_scale", f"SELECT n::BIGINT AS n, seq::INT AS seq, kind FROM (SELECT DISTINCT n FROM {_ASKED_SQL}) a, {_GRID_SQL} WHERE n BETWEEN least_n AND most_n")
def grid_for_scale(s, d):
    n = s.createDataFrame(_ASKED_N, "n long, priority string").select("n").distinct()
    return n.join(F.broadcast(tuning.grid(s)), F.col("n").between(F.col("least_n"), F.col("most_n"))).select("n", "seq", "kind")


@query("grid_recommend", f"""WITH q AS (SELECT n, priority, CASE WHEN priority = 'speed' THEN 0 WHEN priority = 'accuracy' THEN 2 WHEN priority = 'max' THEN 2 ELSE 1 END AS qr,
CASE WHEN priority = 'speed' THEN 0 WHEN priority = 'max' THEN 2 ELSE 1 END AS qs FROM {_ASKED_SQL})
SELECT n::BIGINT AS n, priority, coalesce(min(seq) FILTER (r = qr AND s = qs AND n BETWEEN least_n AND most_n), min(seq) FILTER (n BETWEEN least_n AND most_n), min(seq) FILTER (r = 1 AND s = 1))::INT AS seq FROM q, {_GRID_SQL} GROUP BY n, priority""")
def grid_recommend(s, d):
    return tuning.grid_recommend(s.createDataFrame(_ASKED_N, "n long, priority string"))


_SELECT = [(n, r, lat) for n in (5_000, 60_000, 400_000) for r in (0.7, 0.88, 0.96) for lat in (0.1, 0.2, 0.5)]


@query("grid_select_best", f"""WITH q AS (SELECT *, CASE WHEN min_recall >= 0.95 THEN 2 WHEN min_recall >= 0.85 THEN 1 ELSE 0 END AS qr, CASE WHEN max_latency <= 0.1 THEN 0 WHEN max_latency <= 0.25 THEN 1 ELSE 2 END AS qs
FROM (SELECT n::BIGINT AS n, a::DOUBLE AS min_recall, b::DOUBLE AS max_latency FROM {_values(_SELECT)} t(n, a, b)))
SELECT n, min_recall, max_latency, seq::INT AS seq FROM (SELECT *, row_number() OVER (PARTITION BY n, min_recall, max_latency ORDER BY recall DESC, seq DESC) AS k FROM q JOIN {_GRID_SQL} ON r = qr AND s = qs WHERE recall::DOUBLE >= min_recall AND latency::DOUBLE <= max_latency AND n BETWEEN least_n AND most_n) WHERE k = 1""")
def grid_select_best(s, d):
    return tuning.grid_select(s.createDataFrame(_SELECT, "n long, min_recall double, max_latency double"))


_MEASURED = [(i, r, lat, size, build) for i, (r, lat, size, build) in enumerate((r, lat, size, build) for r in (0.5, 0.9, 0.99, 1.0) for lat in (0.0, 20.0, 900.0) for size in (256.0, 3300.0, 9000.0) for build in (0.5, 80.0, 5000.0))]
_MEASURED_SQL = f"(SELECT seq::BIGINT AS seq, a::DOUBLE AS recall, b::DOUBLE AS latency_us, c::DOUBLE AS bytes, e::DOUBLE AS build_ms FROM {_values(_MEASURED)} t(seq, a, b, c, e))"


def _log_share_sql(c: str, whole: float) -> str:
    return f"(CASE WHEN {c} <= 0 THEN 0.0 ELSE least(greatest(ln({c}) / ln({whole}), 0.0), 1.0) END)"


def _fitness_sql(p: str) -> str:
    r, s, m, b = tuning.PRIORITIES[p]
    parts = [("recall", r), (f"1 - {_log_share_sql('latency_us', 10000.0)}", s), ("1 - least(greatest((bytes - 1000) / 9000.0, 0.0), 1.0)", m), (f"1 - {_log_share_sql('build_ms', 10000.0)}", b)]
    return f"exp(({' + '.join(f'{w} * ln(greatest({x}, 0.001))' for x, w in parts)}) / {r + s + m + b}) * CASE WHEN recall < 0.99 THEN (recall / 0.99) ^ 3 ELSE 1 END"


_BINS_SQL = "least(floor(recall * 5 + 0.5), 5)::INT AS r_bin, least(floor(least(greatest(ln(greatest(latency_us, 1)) / ln(1000), 0), 1) * 5 + 0.5), 5)::INT AS l_bin, least(floor(least(greatest((bytes - 3000) / 3000, 0), 1) * 5 + 0.5), 5)::INT AS m_bin"


def _measured(s):
    return s.createDataFrame(_MEASURED, "seq long, recall double, latency_us double, bytes double, build_ms double")


@query("fitness_table", " UNION ALL ".join(f"SELECT seq, '{p}' AS priority, round({_fitness_sql(p)}, 6) AS fitness FROM {_MEASURED_SQL}" for p in tuning.PRIORITIES))
def fitness_table(s, d):
    return reduce(DataFrame.unionByName, (_measured(s).select("seq", F.lit(p).alias("priority"), F.round(tuning.fitness(p), 6).alias("fitness")) for p in tuning.PRIORITIES))


@query("behaviour_bins", f"SELECT seq, {_BINS_SQL} FROM {_MEASURED_SQL}")
def behaviour_bins(s, d):
    return _measured(s).select("seq", *tuning.behaviour())


def _elites(s):
    return tuning.archive(_measured(s).select("seq", tuning.fitness().alias("fitness"), *tuning.behaviour()), ["r_bin", "l_bin", "m_bin"])


_ELITES_SQL = f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY r_bin, l_bin, m_bin ORDER BY round(fitness, 12) DESC, seq) AS n FROM (SELECT seq, {_fitness_sql('default')} AS fitness, {_BINS_SQL} FROM {_MEASURED_SQL})) WHERE n = 1)"


@query("archive_elites", f"SELECT r_bin, l_bin, m_bin, seq, round(fitness, 6) AS fitness FROM {_ELITES_SQL}")
def archive_elites(s, d):
    return _elites(s).select("r_bin", "l_bin", "m_bin", "seq", F.round("fitness", 6).alias("fitness"))


@query("archive_coverage", f"SELECT count(*)::BIGINT AS filled, round(count(*) * 100.0 / 216, 6)::DOUBLE AS percent FROM {_ELITES_SQL}")
def archive_coverage(s, d):
    return tuning.coverage(_elites(s), 216).select("filled", F.round("percent", 6).alias("percent"))


_INSERTS = [(i, t, o, c, sc) for i, (t, o, c, sc) in enumerate((t, o, c, sc) for t in (5e4, 8e5, 2e7) for o in (5.0, 60.0) for c in (0.2, 0.9) for sc in (0.3, 1.4))]
_INSERTS_SQL = f"(SELECT seq::BIGINT AS seq, a::DOUBLE AS throughput, b::DOUBLE AS overhead, c::DOUBLE AS cpu, e::DOUBLE AS scaling FROM {_values(_INSERTS)} t(seq, a, b, c, e))"
_TP = "least(greatest((ln(greatest(throughput, 1e5)) - ln(1e5)) / (ln(1e7) - ln(1e5)), 0), 1)"


@query("insert_fitness", f"""SELECT seq, round(exp((0.5 * ln(greatest({_TP}, 0.001)) + 0.15 * ln(greatest(1 - least(greatest(overhead / 100, 0), 1), 0.001)) + 0.2 * ln(greatest(cpu, 0.001)) + 0.15 * ln(greatest(least(greatest(scaling, 0), 1), 0.001))) / 1.0), 6) AS fitness,
least(floor({_TP} * 3 + 0.5), 3)::INT AS t_bin, least(floor(least(greatest(0.6 * cpu + 0.4 * scaling, 0), 1) * 3 + 0.5), 3)::INT AS e_bin FROM {_INSERTS_SQL}""")
def insert_fitness(s, d):
    return s.createDataFrame(_INSERTS, "seq long, throughput double, overhead double, cpu double, scaling double").select("seq", F.round(tuning.insert_fitness(), 6).alias("fitness"), *tuning.insert_behaviour())


@query("insert_measures", "SELECT seq::INT AS seq, overhead, round(cpu, 6) AS cpu, scaling FROM (VALUES (0, 0.0::DOUBLE, 0.34::DOUBLE, 0.5::DOUBLE), (1, 400.0, 0.9, 1.0), (2, 4000.0, 0.82, 1.0), (3, 256.0, 0.27, 0.25), (4, 16.0, 0.9, 1.0), (5, 800.0, 0.76, 0.75)) t(seq, overhead, cpu, scaling)")
def insert_measures(s, d):
    rows = [(0, "sequential", 1, False, 0, 1e5, 1e5), (1, "batch", 100, False, 4, 6e5, 1e5), (2, "parallel", 500, True, 8, 8e5, 1e5), (3, "chunked", 64, False, 4, 5e4, 1e5), (4, "unrolled", 100, False, 0, 5e5, 1e5), (5, "interleaved", 200, False, 2, 4e5, 4e5 / 1.5)]
    t = s.createDataFrame(rows, "seq int, strategy string, batch int, parallel boolean, prefetch int, throughput double, base double")
    return tuning.insert_measures(t).select("seq", "overhead", F.round("cpu", 6).alias("cpu"), F.round("scaling", 6).alias("scaling"))


@query("evolve_inserts")
def evolve_inserts(s, d):
    return tuning.evolve_inserts(_emb(s, d), tuning.TUNINGS["fast"])


@query("behaviour_2d", f"SELECT seq, l_bin, m_bin FROM (SELECT seq, {_BINS_SQL} FROM {_MEASURED_SQL})")
def behaviour_2d(s, d):
    return _measured(s).select("seq", *tuning.behaviour_2d())


@query("balanced_priority", f"SELECT seq, round(exp((0.4 * ln(greatest(recall, 0.001)) + 0.3 * ln(greatest(1 - {_log_share_sql('latency_us', 10000.0)}, 0.001)) + 0.2 * ln(greatest(1 - least(greatest((bytes - 1000) / 9000.0, 0.0), 1.0), 0.001)) + 0.1 * ln(greatest(1 - {_log_share_sql('build_ms', 10000.0)}, 0.001))) / 1.0) * CASE WHEN recall < 0.99 THEN (recall / 0.99) ^ 3 ELSE 1 END, 6) AS fitness FROM {_MEASURED_SQL}")
def balanced_priority(s, d):
    return _measured(s).select("seq", F.round(tuning.fitness(tuning.balanced(4, 3, 2, 1)), 6).alias("fitness"))


@query("research_tier_in_time", "SELECT b::DOUBLE AS seconds, CASE WHEN b >= 120 THEN 'deeper' WHEN b >= 45 THEN 'default' WHEN b >= 15 THEN 'medium' ELSE 'basic' END AS tier FROM (VALUES (1), (15), (44), (45), (119), (120), (500)) t(b)")
def research_tier_in_time(s, d):
    return s.createDataFrame([(float(b),) for b in (1, 15, 44, 45, 119, 120, 500)], "seconds double").withColumn("tier", tuning.research_tier_in_time(F.col("seconds")))


@query("research_tier", "SELECT b::DOUBLE AS budget, CASE WHEN b >= 1.30 THEN 'deeper' WHEN b >= 0.50 THEN 'default' WHEN b >= 0.07 THEN 'medium' ELSE 'basic' END AS tier FROM (VALUES (0.02), (0.07), (0.10), (0.5), (1.0), (1.3), (2.0)) t(b)")
def research_tier(s, d):
    return s.createDataFrame([(b,) for b in (0.02, 0.07, 0.10, 0.5, 1.0, 1.3, 2.0)], "budget double").withColumn("tier", tuning.research_tier(F.col("budget")))


@query("tune")
def tune(s, d):
    return tuning.tune(_emb(s, d), tuning.TUNINGS["fast"])


@query("insert_timings")
def insert_timings(s, d):
    import numpy as np

    rows = _emb(s, d).orderBy(F.xxhash64("vec_id"), "vec_id").limit(2000).select("embedding").collect()  # a bounded sample
    return tuning.insert_timings(s, list(tuning.INSERT_SEEDS), np.array([r[0] for r in rows]))


# ---- quality and diversity over documents ------------------------------------------------------------------------------

_KEYWORDS = ["index", "graph", "vector", "latency"]
_SHARE = "((" + " + ".join(f"contains(lower(coalesce(text, '')), '{k}')::INT" for k in _KEYWORDS) + ") / 4.0)::DOUBLE"
_FEATURES_SQL = f"(SELECT doc_id, fitness, least(fitness / 5000.0, 1.0)::DOUBLE AS f0, f1 FROM (SELECT doc_id, coalesce(length(text), 0) AS fitness, {_SHARE} AS f1 FROM documents))"
_QD_SQL = f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY c0, c1 ORDER BY fitness DESC, doc_id) AS n FROM (SELECT *, least(floor(f0 * 10), 9)::INT AS c0, least(floor(f1 * 10), 9)::INT AS c1 FROM {_FEATURES_SQL})) WHERE n = 1)"


def _documents_archive(s, d):
    docs = table(s, d, "documents").withColumn("n", F.coalesce(F.length("text"), F.lit(0)).cast("long"))  # n_chars may be stale or null
    f = F.array(F.least(F.col("n") / 5000.0, F.lit(1.0)), tuning.keyword_share("text", _KEYWORDS))
    return tuning.archive(docs.select("doc_id", F.col("n").alias("fitness"), tuning.behaviour_cell(f, 10, 2).alias("cell")), ["cell"], order_col="doc_id")


@query("text_behaviour", f"SELECT doc_id, {_SHARE} AS share FROM documents")
def text_behaviour(s, d):
    return table(s, d, "documents").select("doc_id", tuning.keyword_share("text", _KEYWORDS).alias("share"))


@query("query_behaviour", f"WITH e AS ({_E}) SELECT e.vec_id, list(round((list_cosine_similarity(e.v, q.v) + 1) / 2, 6) ORDER BY q.vec_id) AS features FROM e, e q WHERE q.vec_id < 4 GROUP BY e.vec_id")
def query_behaviour(s, d):
    refs = [r.embedding for r in _emb(s, d).where("vec_id < 4").orderBy("vec_id").collect()]  # four reference vectors
    return _emb(s, d).select("vec_id", F.transform(tuning.query_features("embedding", refs), lambda x: F.round(x, 6)).alias("features"))


@query("qd_cells", f"SELECT [c0, c1, 0, 0] AS cell, doc_id, fitness FROM {_QD_SQL}")
def qd_cells(s, d):
    return _documents_archive(s, d).select("cell", "doc_id", "fitness")


@query("qd_stats", f"SELECT count(*)::BIGINT AS n, round(avg(fitness), 6) AS mean, max(fitness) AS best, min(fitness) AS worst, round(count(*) / 100.0, 6)::DOUBLE AS ratio FROM {_QD_SQL}")
def qd_stats(s, d):
    r = tuning.archive_stats(_documents_archive(s, d), 100)
    return r.select("n", F.round("mean", 6).alias("mean"), F.col("best").cast("long").alias("best"), F.col("worst").cast("long").alias("worst"), F.round("ratio", 6).alias("ratio"))


@query("qd_top_elites", f"SELECT doc_id, fitness FROM {_QD_SQL} ORDER BY fitness DESC, doc_id LIMIT 5")
def qd_top_elites(s, d):
    return _documents_archive(s, d).orderBy(F.desc("fitness"), "doc_id").limit(5).select("doc_id", "fitness")


@query("map_elites_run")
def map_elites_run(s, d):
    titles = [r.title for r in table(s, d, "documents").where("title is not null").groupBy("title").count().orderBy(F.desc("count"), "title").limit(50).collect()]  # seeds: the most frequent titles
    score = lambda batch: [(float(len(t)), [min(len(t) / 60, 1.0), min(len(set(t.split())) / 10, 1.0)]) for t in batch]
    out = tuning.map_elites(lambda r: r.choice(titles), tuning.mutated_words, score, tuning.MapElites(5, 10, 20, 10))
    return s.createDataFrame([(list(e.cell), e.solution, e.fitness) for e in out.elites()], "cell array<int>, solution string, fitness double")


# ---- concept graph ---------------------------------------------------------------------------------------------------

_EDGES = """g AS (
SELECT 's' || s_suppkey AS src, 'n' || s_nationkey AS dst, 'is_a' AS rel_type, 1.0::DOUBLE AS weight FROM supplier
UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 'is_a', 1.0 FROM customer
UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 'is_a', 1.0 FROM nation
UNION ALL SELECT 'n' || n_nationkey, 'n' || ((n_nationkey * 7 + 3) % 25), 'related_to', ((n_nationkey % 10) + 1) / 10.0 FROM nation
UNION ALL SELECT 'n' || n_nationkey, 'n' || ((n_nationkey * 3 + 1) % 25), 'related_to', ((n_nationkey % 4) + 1) / 4.0 FROM nation)"""


def edges(s, d) -> DataFrame:
    def link(df, a, ka, b, kb, kind=graph.IS_A, w=None):
        return df.select(F.concat(F.lit(a), ka.cast("string")).alias("src"), F.concat(F.lit(b), kb.cast("string")).alias("dst"), F.lit(kind).alias("rel_type"), (w if w is not None else F.lit(1.0)).alias("weight"))

    n, k = table(s, d, "nation"), F.col("n_nationkey")
    parts = [
        link(table(s, d, "supplier"), "s", F.col("s_suppkey"), "n", F.col("s_nationkey")), link(table(s, d, "customer"), "c", F.col("c_custkey"), "n", F.col("c_nationkey")), link(n, "n", k, "r", F.col("n_regionkey")),
        link(n, "n", k, "n", (k * 7 + 3) % 25, "related_to", ((k % 10) + 1) / 10.0), link(n, "n", k, "n", (k * 3 + 1) % 25, "related_to", ((k % 4) + 1) / 4.0),
    ]
    return graph.clamped(reduce(DataFrame.unionByName, parts))


def _nodes(s, *ids):
    return s.createDataFrame([(i,) for i in ids], "id string")


_IS = "i AS (SELECT * FROM g WHERE rel_type = 'is_a')"


@query("graph_ancestors", f"WITH RECURSIVE {_EDGES}, {_IS}, t AS (SELECT DISTINCT src AS start, src AS id FROM i WHERE src LIKE 's%' UNION SELECT t.start, i.dst FROM t JOIN i ON i.src = t.id) SELECT t.start, i.dst AS id FROM t JOIN i ON i.src = t.id")
def graph_ancestors(s, d):
    return graph.ancestors(edges(s, d), table(s, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id")))


@query("graph_descendants", f"WITH RECURSIVE {_EDGES}, {_IS}, t AS (SELECT DISTINCT dst AS start, dst AS id FROM i WHERE dst LIKE 'r%' UNION SELECT t.start, i.src FROM t JOIN i ON i.dst = t.id) SELECT t.start, i.src AS id FROM t JOIN i ON i.dst = t.id")
def graph_descendants(s, d):
    return graph.descendants(edges(s, d), table(s, d, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("id")))


_BFS = "t AS (SELECT 'n0' AS start, 'n0' AS id, 0 AS depth UNION SELECT t.start, g.dst, t.depth + 1 FROM t JOIN g ON g.src = t.id WHERE t.depth < {0} AND g.weight >= {1})"


@query("graph_bfs", f"WITH RECURSIVE {_EDGES}, {_BFS.format(4, 0.3)} SELECT start, id, min(depth)::INT AS depth FROM t GROUP BY start, id")
def graph_bfs(s, d):
    return graph.bfs(edges(s, d), _nodes(s, "n0"), 4, least_weight=0.3)


@query("graph_neighbourhood", f"WITH RECURSIVE {_EDGES}, {_BFS.format(2, 0)} SELECT start, id, round(1.0 / (min(depth) + 1), 6)::DOUBLE AS score FROM t GROUP BY start, id")
def graph_neighbourhood(s, d):
    return graph.neighbourhood(edges(s, d), _nodes(s, "n0"), 2).select("start", "id", F.round("score", 6).alias("score"))


_WALK = "t AS (SELECT 'n0' AS id, 0.0::DOUBLE AS cost, ['n0'] AS path UNION ALL SELECT g.dst, t.cost + 1 / greatest(g.weight, 0.01), list_append(t.path, g.dst) FROM t JOIN g ON g.src = t.id WHERE g.rel_type = 'related_to' AND NOT list_contains(t.path, g.dst) AND len(t.path) <= {0} AND t.id <> '{1}')"


@query("graph_shortest_path", f"WITH RECURSIVE {_EDGES}, {_WALK.format(8, 'n13')} SELECT path, round(cost, 6) AS cost, (len(path) - 1)::INT AS hops FROM t WHERE id = 'n13' ORDER BY round(cost, 9), path LIMIT 1")
def graph_shortest_path(s, d):
    return graph.shortest_path(edges(s, d), "n0", "n13", 8, ["related_to"]).select("path", F.round("cost", 6).alias("cost"), "hops")


@query("graph_all_paths", f"WITH RECURSIVE {_EDGES}, {_WALK.format(5, 'n13')} SELECT path FROM t WHERE id = 'n13'")
def graph_all_paths(s, d):
    return graph.all_paths(graph.kept(edges(s, d), ["related_to"]), "n0", "n13", 6)


@query("graph_degree", f"WITH {_EDGES}, a AS (SELECT src AS id, 1 AS o, 0 AS i FROM g UNION ALL SELECT dst, 0, 1 FROM g) SELECT id, sum(o)::BIGINT AS n_out, sum(i)::BIGINT AS n_in FROM a GROUP BY id")
def graph_degree(s, d):
    return graph.degrees(edges(s, d))


@query("graph_outgoing", f"WITH {_EDGES} SELECT src, dst, round(weight, 6) AS weight FROM g WHERE rel_type = 'related_to' AND weight >= 0.5")
def graph_outgoing(s, d):
    return graph.kept(edges(s, d), ["related_to"], 0.5).select("src", "dst", F.round("weight", 6).alias("weight"))


@query("graph_outgoing_of", f"WITH {_EDGES} SELECT src, dst, rel_type FROM g WHERE src = 'n3' AND rel_type = 'related_to'")
def graph_outgoing_of(s, d):
    return graph.outgoing(edges(s, d), "n3", "related_to").select("src", "dst", "rel_type")


@query("graph_incoming_of", f"WITH {_EDGES} SELECT src, dst, rel_type FROM g WHERE dst = 'r1'")
def graph_incoming_of(s, d):
    return graph.incoming(edges(s, d), "r1").select("src", "dst", "rel_type")


@query("concept_upsert", "SELECT id, max(CASE WHEN contains(lower(id), 'a') THEN 'new' ELSE name END) AS name FROM concept WHERE id IS NOT NULL GROUP BY id")
def concept_upsert(s, d):
    c = table(s, d, "concept").where("id is not null").groupBy("id").agg(F.max("name").alias("name"))
    return graph.upsert_concepts(c, c.where(F.contains(F.lower("id"), F.lit("a"))).select("id", F.lit("new").alias("name")))


_NEW = [("r0", "s1"), ("r1", "x9"), ("n3", "n3"), ("s2", "r4")]


@query("graph_cycle_check", f"WITH RECURSIVE {_EDGES}, {_IS}, w AS (SELECT * FROM {_values(_NEW)} t(src, dst)), t AS (SELECT DISTINCT dst AS start, dst AS id FROM w UNION SELECT t.start, i.dst FROM t JOIN i ON i.src = t.id) SELECT w.src, w.dst, EXISTS (SELECT 1 FROM t WHERE t.start = w.dst AND t.id = w.src) AS closes FROM w")
def graph_cycle_check(s, d):
    return graph.closes_cycle(edges(s, d), s.createDataFrame(_NEW, "src string, dst string"))


@query("graph_counts", f"WITH {_EDGES} SELECT rel_type, count(*)::BIGINT AS n FROM g GROUP BY rel_type")
def graph_counts(s, d):
    return graph.counts(edges(s, d))


@query("concept_by_name", "SELECT name, arg_max(id, id) AS id FROM concept WHERE name IS NOT NULL GROUP BY name")
def concept_by_name(s, d):
    return graph.by_name(table(s, d, "concept").where("name is not null"), "id")


@query("concept_embeddings", "SELECT DISTINCT c.id, c.embedding_id FROM concept c WHERE c.embedding_id IN (SELECT id FROM vectors)")
def concept_embeddings(s, d):
    return graph.embedded(table(s, d, "concept"), table(s, d, "vectors")).select("id", "embedding_id").distinct()


# ---- ingestion -------------------------------------------------------------------------------------------------------


@query("chunk_fixed", r"""SELECT doc_id, (start // 400)::INT AS chunk_index, chunk FROM (SELECT doc_id, start, regexp_replace(substr(text, start + 1, 500), '^[\t-\r\x1c-\x20\x{85}\p{Z}]+|[\t-\r\x1c-\x20\x{85}\p{Z}]+$', '', 'g') AS chunk
FROM (SELECT doc_id, text, unnest(range(0, length(text), 400)) AS start FROM documents WHERE length(text) > 0)) WHERE length(chunk) > 50""")
def chunk_fixed(s, d):
    return ingest.chunk_fixed(table(s, d, "documents"), "doc_id", "text")


_STRIP = r"'^[\t-\r\x1c-\x20\x{85}\p{Z}]+|[\t-\r\x1c-\x20\x{85}\p{Z}]+$', '', 'g'"
_LAST = "length(regexp_extract(w, '(?s)^(.*){}', 1))"
_STEP = "CASE WHEN b0 + 500 < length(text) THEN CASE " + " ".join(f"WHEN {_LAST.format(s)} > 250 THEN {_LAST.format(s)} + 2" for s in (r"\. ", r"\.\n", "! ", r"\? ", r"\n\n")) + " ELSE 500 END ELSE 500 END"


@query("chunk_sentence", rf"""WITH RECURSIVE t AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents WHERE length(text) > 500),
c AS (SELECT r, b0, step, w FROM (SELECT *, {_STEP} AS step FROM (SELECT r, text, 0 AS b0, substr(text, 1, 500) AS w FROM t))
  UNION ALL SELECT r, b0, step, w FROM (SELECT *, {_STEP} AS step FROM (SELECT t.r, t.text, c.b0 + c.step - 100 AS b0, substr(t.text, c.b0 + c.step - 99, 500) AS w FROM c JOIN t USING (r) WHERE c.b0 + c.step - 100 < length(t.text)))),
k AS (SELECT r, b0, regexp_replace(substr(w, 1, step), {_STRIP}) AS chunk FROM c)
SELECT doc_id, (row_number() OVER (PARTITION BY r ORDER BY b0) - 1)::INT AS chunk_index, chunk FROM k JOIN t USING (r) WHERE chunk <> ''
UNION ALL SELECT doc_id, 0, text FROM documents WHERE length(text) <= 500""")
def chunk_sentence(s, d):
    return ingest.chunked(table(s, d, "documents"), "doc_id", "text", lambda t: ingest.sentences(t, 500, 100))


@query("chunk_paragraph", rf"""WITH RECURSIVE p AS (SELECT row_number() OVER () AS r, doc_id, list_filter(list_transform(string_split(text, E'\n\n'), lambda x: regexp_replace(x, {_STRIP})), lambda x: length(x) > 0) AS ps FROM documents WHERE text IS NOT NULL),
f AS (SELECT r, 1 AS i, '' AS now, []::VARCHAR[] AS done FROM p
  UNION ALL SELECT r, i + 1, CASE WHEN now = '' OR length(now) + 2 + length(ps[i]) >= 1000 THEN ps[i] ELSE now || E'\n\n' || ps[i] END, CASE WHEN now = '' OR length(now) + 2 + length(ps[i]) < 1000 THEN done ELSE list_append(done, now) END FROM f JOIN p USING (r) WHERE i <= len(ps)),
k AS (SELECT doc_id, list_filter(list_append(done, now), lambda x: length(x) > 50) AS cs FROM f JOIN p USING (r) WHERE i = len(ps) + 1)
SELECT doc_id, (unnest(range(1, len(cs) + 1)) - 1)::INT AS chunk_index, unnest(cs) AS chunk FROM k""")
def chunk_paragraph(s, d):
    return ingest.paragraph_chunks(table(s, d, "documents"), "doc_id", "text", 1000)


@query("chunk_equal_parts", rf"""WITH t AS (SELECT doc_id, regexp_replace(regexp_replace(text, '[\t-\r\x1c-\x20\x{{85}}\p{{Z}}]+', ' ', 'g'), {_STRIP}) AS t FROM documents WHERE text IS NOT NULL),
e AS (SELECT doc_id, t, part, part * (length(t) // 3) AS a, (part + 1) * (length(t) // 3) AS b FROM t, (SELECT unnest(range(3)) AS part)),
n AS (SELECT *, greatest(a + 1, b - 200, 0) AS low FROM e), w AS (SELECT *, substr(t, low + 1, greatest(b + 200 - low, 0)) AS near FROM n),
c AS (SELECT doc_id, part, regexp_replace(substr(t, a + 1, CASE WHEN part = 2 THEN length(t) WHEN regexp_matches(near, '\. ') THEN low + length(regexp_extract(near, '(?s)^(.*)\. ', 1)) + 1 ELSE b END - a), {_STRIP}) AS p FROM w)
SELECT doc_id, part::INT AS part, substr(p, 1, 8000) AS text, length(p)::INT AS char_count FROM c""")
def chunk_equal_parts(s, d):
    return ingest.equal_parts(table(s, d, "documents"), "doc_id", "text")


@query("doc_ids", "SELECT DISTINCT filename, chunk_index, (('0x' || substr(md5(filename || ':' || chunk_index), 1, 16))::UBIGINT % 9223372036854775808)::BIGINT AS doc_id FROM doc_store")
def doc_ids(s, d):
    return table(s, d, "doc_store").select("filename", "chunk_index", ingest.doc_id("filename", "chunk_index").alias("doc_id")).distinct()


@query("list_documents", "SELECT filename, count(*)::BIGINT AS chunks, min(created_at) AS first_seen FROM doc_store GROUP BY filename")
def list_documents(s, d):
    return ingest.list_documents(table(s, d, "doc_store"))


@query("doc_stats", "SELECT count(*)::BIGINT AS chunks, count(DISTINCT filename)::BIGINT AS documents FROM doc_store")
def doc_stats(s, d):
    return ingest.stats(table(s, d, "doc_store"))


@query("rag_join", "WITH m AS (SELECT DISTINCT id, filename, content FROM doc_store), r AS (SELECT DISTINCT id AS vec_id FROM doc_store UNION SELECT vec_id FROM embeddings) SELECT r.vec_id, coalesce(m.filename, 'ID: ' || r.vec_id) AS filename, substr(coalesce(m.content, '[Content not found in metadata]'), 1, 500) AS content FROM r LEFT JOIN m ON m.id = r.vec_id")
def rag_join(s, d):
    m = table(s, d, "doc_store").select("id", "filename", "content").distinct()
    return ingest.with_metadata(m.select(F.col("id").alias("vec_id")).union(_emb(s, d).select("vec_id")).distinct(), m)


@query("id_lookup", "SELECT DISTINCT id, filename, chunk_index FROM doc_store WHERE id IN (SELECT chunk_id FROM results) OR id % 10 = 3")
def id_lookup(s, d):
    ids = table(s, d, "results").select(F.col("chunk_id").alias("id")).union(table(s, d, "doc_store").where("id % 10 = 3").select("id"))
    return store.looked_up(table(s, d, "doc_store"), ids, "id").select("id", "filename", "chunk_index").distinct()


@query("delete_document", "SELECT id, filename FROM doc_store WHERE filename IS NULL OR filename <> (SELECT min(filename) FROM doc_store)")
def delete_document(s, d):
    m = table(s, d, "doc_store")
    first = m.agg(F.min("filename").alias("f")).first().f
    kept, _, _ = ingest.delete_document(m, _emb(s, d), first)
    return kept.select("id", "filename")


@query("latency_percentiles", "SELECT round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.99), 6) AS p99 FROM events")
def latency_percentiles(s, d):
    p = F.percentile("value", F.array(F.lit(0.5), F.lit(0.99)))
    return table(s, d, "events").agg(F.avg("value").alias("mean"), p.alias("p")).select(F.round("mean", 6).alias("mean"), F.round(F.col("p")[0], 6).alias("p50"), F.round(F.col("p")[1], 6).alias("p99"))


__all__ = ["QUERIES", "SQL", "table"]
