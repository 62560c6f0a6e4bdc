import numpy as np
import pytest
from pyspark.sql import functions as F

from quernel.functions import vectors as V
from quernel.operators import index as I
from quernel.operators import search as S


def one(spark, expr, **arrays):
    df = spark.createDataFrame([tuple(arrays.values())], ", ".join(f"{k} array<float>" for k in arrays))
    return df.select(expr.alias("x")).first().x


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def test_arithmetic(spark):
    a, b = [1.0, 2.0, 3.0, 4.0, 5.0], [1.0] * 5
    assert one(spark, V.dot("a", "b"), a=a, b=b) == 15 and one(spark, V.dot("a", "b"), a=[], b=[]) == 0
    assert one(spark, V.dot("a", "b"), a=a, b=[1.0]) is None
    assert one(spark, V.norm("a"), a=[3.0, 4.0]) == 5 and one(spark, V.total("a"), a=[float(i) for i in range(1, 101)]) == 5050
    assert one(spark, V.distance("a", "b"), a=[0.0, 0.0, 0.0], b=[3.0, 4.0, 0.0]) == 5
    assert one(spark, V.normalized("a"), a=[3.0, 4.0]) == pytest.approx([0.6, 0.8])
    assert one(spark, V.normalized("a"), a=[0.0, 0.0]) == [0, 0]
    assert one(spark, V.cosine("a", "b"), a=[1.0, 0.0], b=[1.0, 1.0]) == pytest.approx(2**-0.5)
    assert one(spark, V.cosine("a", "b"), a=[0.0, 0.0], b=[1.0, 1.0]) == 0
    assert one(spark, V.cosine("a", "b"), a=[1.0, 0.0], b=[-2.0, 0.0]) == -1


def test_flat(spark):
    rows = [(1, [1.0, 0, 0]), (2, [0.0, 1, 0]), (3, [0.0, 0, 1]), (4, [0.707, 0.707, 0]), (5, [0.577, 0.577, 0.577]), (6, None), (7, [1.0])]
    c = frame(spark, [(i, v and [float(x) for x in v]) for i, v in rows])
    q = frame(spark, [(9, [0.9, 0.1, 0.0])])
    got = S.knn(q, c, 3).orderBy("rank").collect()
    assert got[0].vec_id == 1 and len(got) == 3 and got[0].score > got[1].score > got[2].score
    assert S.knn(q, c, 99).count() == 5 and S.knn(q, c, 0).count() == 0 and S.knn(q, c.where("false"), 5).count() == 0 and S.knn(q.where("false"), c, 5).count() == 0
    two = frame(spark, [(1, [0.0, 0.0, 0.0]), (2, [3.0, 4.0, 0.0])])
    assert [r.score for r in S.knn(two.where("vec_id = 1"), two, 2, S.EUCLIDEAN).orderBy("rank").collect()] == pytest.approx([0, 5])
    assert S.knn(q, two, 1, S.DOT).first().score == pytest.approx(-3.1)
    with pytest.raises(S.DimensionMismatch):
        S.knn(frame(spark, [(1, [1.0])]), c, 1, dim=3).collect()


def data(n=300, d=16, seed=1):
    x = np.random.default_rng(seed).normal(size=(n, d)).astype(np.float32)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_ivf_pq_hnsw(spark):
    x = data()
    c = frame(spark, [(i, v.tolist()) for i, v in enumerate(x)])
    q = c.where("vec_id % 30 = 0")
    truth = S.knn(q, c, 10)
    cent = S.kmeans(c, 8, 4)
    post = S.assigned(c, cent)
    full = {tuple(r)[:3] for r in S.ivf_search(q, post, cent, 10, 8).collect()}
    assert full == {tuple(r)[:3] for r in truth.collect()}  # probing every partition is the exact search
    books = S.pq_train(c, 4, 16, 4)
    codes = S.pq_encode(c, books)
    code = {r.vec_id: r.code for r in codes.collect()}
    for r in S.pq_search(q, codes, books, 5).collect():
        decoded = np.concatenate([books[s][code[r.vec_id][s]] for s in range(4)])
        assert r.score == pytest.approx(((decoded - x[r.query_id]) ** 2).sum(), rel=1e-5)
    assert S.pq_search(q.where("false"), codes, books, 5).count() == 0 and S.ivf_search(q.where("false"), post, cent, 5, 2).count() == 0
    h = S.hnsw_search(q, c, 10, S.IndexConfig(16, m=8, ef_construction=64, ef_search=64), shard_rows=150)
    assert S.recall(h, truth).agg(F.avg("recall")).first()[0] >= 0.95
    with pytest.raises(S.NotTrained):
        S.kmeans(c.limit(3), 8, 1)
    with pytest.raises(ValueError):
        S.pq_train(c, 5, 4, 1)


def test_indexes_keep_what_was_built(spark):
    x = data(240)
    c = frame(spark, [(i, v.tolist()) for i, v in enumerate(x)])
    first, later, q = c.where("vec_id < 200"), c.where("vec_id >= 190"), c.where("vec_id % 30 = 0")
    ivf = I.IvfIndex(spark, I.IvfConfig(16, 8, 8, 4))
    pq = I.PqIndex(spark, I.PqConfig(16, 4, 16, 3))
    hnsw = I.HnswIndex(spark, S.IndexConfig(16, m=8, ef_construction=64, ef_search=64), 2)
    flat = I.FlatIndex(spark, 16)
    with pytest.raises(S.NotTrained):
        pq.search(q, 3)
    for index in (flat, ivf, pq, hnsw):
        index.insert(first)
        assert len(index) == 200
    assert {tuple(r)[:3] for r in ivf.search(q, 5).collect()} == {tuple(r)[:3] for r in S.knn(q, first, 5).collect()}  # untrained: exact
    ivf.train()
    pq.train()
    assert ivf.is_trained and ivf.num_partitions == 8 and pq.compression_ratio == 16
    for index in (flat, ivf, pq, hnsw):
        index.insert(later)
        index.remove(c.where("vec_id % 30 = 1"))
        assert len(index) == 232 and index.get(31) is None and index.get(235) is not None and not index.is_empty()
        found = index.search(c.where("vec_id in (31, 60, 235)"), 5).collect()
        assert {r.vec_id for r in found}.isdisjoint(range(1, 240, 30)) and len(found) == 15
        if index is not pq:
            assert all(r.vec_id == r.query_id for r in found if r["rank"] == 1 and r.query_id != 31)
    assert I.mean_recall(ivf, q, 5) == 1 and I.mean_recall(hnsw, q, 5) > 0.9
    ivf.set_nprobe(99)
    assert ivf.nprobe == 8 and I.IvfConfig.of(16, 64).nprobe == 4
    with pytest.raises(S.DimensionMismatch):
        flat.insert(frame(spark, [(1, [1.0])]))
    with pytest.raises(ValueError):
        I.PqConfig(16, 5)


def test_ties_go_to_the_lesser_id_across_batches_and_tiles():
    best = S.Best(3)
    d = np.zeros((2, 50))
    d[1, 7] = -1
    for lo in range(0, 150, 50):
        best.add(np.array([5, 6]), np.arange(lo, lo + 50)[::-1], d)
    rows = next(best.batches())
    assert rows["vec_id"].to_pylist() == [0, 1, 2, 42, 92, 142]


def test_scores_by_a_function(spark):
    x = data(20)
    c = frame(spark, [(i, v.tolist()) for i, v in enumerate(x)])
    out = S.scores(c.where("vec_id < 2"), c, lambda q, y: np.abs(q[:, None] - y[None]).max(axis=2), 16).collect()
    assert len(out) == 40 and all(r.dist == pytest.approx(np.abs(x[r.query_id] - x[r.vec_id]).max()) for r in out)
