import random
import time

import numpy as np
import pytest

from quernel.llm import buckets as B
from quernel.llm import communities as C
from quernel.llm import near_duplicates as N
from quernel.llm import similar_vectors as V
from quernel.llm.text import words


def shingles(t, n):
    w = words(t)
    return set(zip(*(w[i:] for i in range(n))))


def test_near_duplicates(spark):
    rng = random.Random(7)
    base = [[f"w{rng.randrange(4000)}" for _ in range(rng.randrange(60, 200))] for _ in range(60)]
    texts = {}
    for i, b in enumerate(base):
        for k in range(4):
            t = list(b)
            for _ in range(k * 4):
                t[rng.randrange(len(t))] = f"e{rng.randrange(9999)}"
            texts[10 * i + k] = " ".join(t)
    rows = [(i, t, 1) for i, t in texts.items()] + [(5000 + i, texts[0], 2) for i in range(8)] + [(0, texts[0], 3), (7001, None, 1), (7002, "", 1), (7003, "too short", 1)]
    df = spark.createDataFrame(rows, "id long, text string, bands long")
    how = N.Similarity(words=3, threshold=0.6, min_shingles=30)
    sets = {i: shingles(t, 3) for i, t, _ in rows if t and len(shingles(t, 3)) >= 30}
    ids = sorted(sets)
    want = {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(sets[a] & sets[b]) >= 0.6 * len(sets[a] | sets[b])}
    got = {tuple(r) for r in N.near_duplicates(df, "id", "text", how).collect()}
    assert got <= want and len(want - got) <= 0.02 * len(want)
    assert N.near_duplicates(df.where("false"), "id", "text", how).count() == 0


def test_groups(spark):
    rng = random.Random(14)
    base = [f"w{rng.randrange(4000)}" for _ in range(120)]
    chain = []
    for k in range(6):  # each like the one before, the ends unlike
        chain.append(" ".join(base))
        for _ in range(2):
            base[rng.randrange(20 * k, 20 * k + 20)] = f"e{rng.randrange(9999)}"
    other = " ".join(f"v{rng.randrange(4000)}" for _ in range(100))
    rows = [(i, t) for i, t in enumerate(chain)] + [(50, other), (51, other), (50, other), (60, " ".join(f"u{i}" for i in range(90))), (61, None)]
    got = {r.id: (r.group_id, r.group_size) for r in N.groups(spark.createDataFrame(rows, "id long, text string"), "id", "text").collect()}
    assert got == {**{i: (0, 6) for i in range(6)}, 50: (50, 2), 51: (50, 2)}


def test_sketches_fill_every_bin():
    for n in (1, 3, 40, 5000):
        key = np.arange(n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        s = N.sketches(key, np.array([n]), 160)
        assert (s != np.uint64((1 << 64) - 1)).all()


def test_hot_buckets_lose_nothing(spark):
    rng = np.random.default_rng(8)
    n = 900
    load = rng.integers(0, 40, n)
    rows = spark.createDataFrame([(1, int(i), int(load[i])) for i in range(n)] + [(2, 1, 5), (2, 2, 5), (2, 2, 5), (3, 4, 1)], "key long, item long, payload long")

    def equal(a, b, aligned=False):
        if aligned:
            i = np.flatnonzero(a == b)
            return i, i
        return np.nonzero(a[:, None] == b[None, :])

    want = {(i, j) for i in range(n) for j in range(i + 1, n) if load[i] == load[j]} | {(1, 2)}
    for block, batch in ((100, 200_000), (100, 128), (4096, 200_000)):  # dealt, sent on in pieces, compared in place
        assert {tuple(r) for r in B.near_pairs(rows, equal, block=block, batch=batch).collect()} == want


def vectors(rng, n, groups):
    x = rng.normal(size=(n, 64))
    for k in range(groups):
        c = x[k] + rng.normal(size=(6, 64)) * 0.2
        x = np.concatenate([x, c])
    return x.astype(np.float32)


def test_similar_vectors(spark):
    rng = np.random.default_rng(9)
    x = vectors(rng, 400, 40)
    rows = [(int(i), v.tolist(), 1.0) for i, v in enumerate(x)] + [(9000 + i, x[3].tolist(), 1.0) for i in range(9)] + [(3, x[3].tolist(), 2.0), (9100, None, 0.0), (9101, [1.0], 0.0), (9102, [0.0] * 64, 0.0), (9103, [float("nan")] * 64, 0.0), (9104, [float("inf")] + [1.0] * 63, 0.0)]
    df = spark.createDataFrame(rows, "id long, embedding array<float>, cosine double")
    ids = [r[0] for r in rows if r[1] and len(r[1]) == 64 and np.isfinite(r[1]).all() and any(r[1])]
    ids = sorted(set(ids))
    y = np.stack([next(np.array(r[1]) for r in rows if r[0] == i) for i in ids])
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    sim = np.round(y @ y.T, 6)
    want = set()
    for a in range(len(ids)):
        order = [b for b in np.lexsort((np.array(ids), -sim[a])) if b != a and sim[a, b] >= 0.9][:5]
        want |= {(min(ids[a], ids[b]), max(ids[a], ids[b])) for b in order}
    got = {tuple(r) for r in V.found(df).collect()}
    assert len(want - got) <= 0.01 * len(want) and len(got - want) <= 0.01 * len(want)
    assert V.found(df.where("false")).count() == 0


def test_dense_buckets_and_many_copies_of_a_vector(spark):
    rng = np.random.default_rng(16)
    centre = rng.normal(size=64)
    x = (centre + rng.normal(size=(400, 64)) * 0.2).astype(np.float32)  # all within 0.9 of each other
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000 + i, x[11].tolist()) for i in range(150)]
    y = np.concatenate([x, np.repeat(x[11:12], 150, axis=0)])
    ids = np.array([r[0] for r in rows])
    y = y / np.linalg.norm(y, axis=1, keepdims=True)
    sim = np.round(y.astype(np.float64) @ y.T, 6)
    np.fill_diagonal(sim, -2)
    want = {(int(ids[a]), int(ids[b])) for a in range(len(ids)) for b in np.lexsort((ids, -sim[a]))[:5]}
    df = spark.createDataFrame(rows, "id long, embedding array<float>")
    got = {(r.id, r.other_id) for r in V.neighbours(df, how=V.Search(dense=60, members=40)).collect()}
    assert len(got) == len(want) and len(got & want) >= 0.99 * len(want)


def test_pairs_of_a_class_of_many_copies(spark):
    text, other = (" ".join(f"{c}{i}" for i in range(80)) for c in "wv")
    near = text.replace("w40 ", "x ")
    rows = [(i, text) for i in range(120)] + [(500 + i, near) for i in range(30)] + [(900, other)]
    how = N.Similarity(words=3, threshold=0.6, min_shingles=30, block=25)
    got = [tuple(r) for r in N.near_duplicates(spark.createDataFrame(rows, "id long, text string"), "id", "text", how).collect()]
    ids = [i for i, t in rows if t != other]
    assert len(got) == len(set(got)) == len(ids) * (len(ids) - 1) // 2


def test_one_bucket_of_very_many_rows(spark):
    n = 60_000
    rows = spark.range(n).selectExpr("7L AS key", "id AS item", "id % 20000 AS payload").unionByName(spark.range(10).selectExpr("id AS key", "id AS item", "id AS payload"))

    def equal(a, b, aligned=False):
        if aligned:
            i = np.flatnonzero(a == b)
            return i, i
        order = np.argsort(b, kind="stable")
        low, high = np.searchsorted(b[order], a), np.searchsorted(b[order], a, "right")
        i = np.repeat(np.arange(len(a)), high - low)
        return i, order[np.repeat(low, high - low) + np.arange(len(i)) - np.repeat(np.cumsum(high - low) - (high - low), high - low)]

    assert B.near_pairs(rows, equal).count() == 3 * 20_000


def test_rows_of_large_buckets_are_laid_out_once(spark):
    rows = spark.range(600).selectExpr("id % 2 AS key", "id AS item", "id AS payload")
    seen = []

    def renew(hot):
        seen.append("Join" not in hot._jdf.queryExecution().optimizedPlan().toString() and hot.count() == 600)
        return hot

    def same(a, b, aligned=False):
        return np.nonzero(a[:, None] // 4 == b[None, :] // 4)

    got = {tuple(r) for r in B.near_pairs(rows, same, block=100, dense=(renew, same, 0)).collect()}
    assert seen == [True] and got == {(a, a + 2) for a in range(600) if a % 4 < 2}


@pytest.mark.parametrize("dense, batch", [(False, 200_000), (True, 200_000), (False, 128), (False, 64)])  # sent on whole and in pieces
def test_rows_of_buckets_that_turn_out_large_are_not_made_again(spark, dense, batch):
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    # ten rows of the key 7 in each of 40 batches: too few to be found before the shuffle
    rows = spark.range(0, 4000, 1, 40).selectExpr("if(id % 10 = 0, 7L, 100 + id) AS key", "id AS item", "id AS payload").mapInArrow(counted, "key long, item long, payload long")

    def near(a, b, aligned=False):
        if aligned:
            i = np.flatnonzero(a // 40 == b // 40)
            return i, i
        return np.nonzero(a[:, None] // 40 == b[None, :] // 40)

    renew = lambda hot: hot.withColumn("payload", hot["item"])
    got = {tuple(r) for r in B.near_pairs(rows, near, block=100, batch=batch, dense=(renew, near, 0) if dense else None).collect()}
    assert got == {(a, b) for a in range(0, 4000, 10) for b in range(a + 10, 4000, 10) if a // 40 == b // 40}
    assert made.value == 2 * 4000


def test_communities(spark):
    rng = np.random.default_rng(10)
    centre = rng.normal(size=(5, 64))
    centre /= np.linalg.norm(centre, axis=1, keepdims=True)
    rows, truth = [], {}
    for i in range(900):
        k = i % 6
        v = rng.normal(size=64)
        v /= np.linalg.norm(v)
        if k < 5:
            v = centre[k] * 0.7 + v * 0.7
            truth[i] = k
        rows.append((i, (v * rng.uniform(0.5, 3)).tolist()))
    rows += [(0, rows[0][1]), (5000, None), (5001, [0.0] * 64)] + [(6000 + i, rows[7][1]) for i in range(4)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "id long, embedding array<float>, cluster string")
    probes = spark.createDataFrame([(k, centre[k].tolist()) for k in range(3)] + [(9, rng.normal(size=64).tolist())], "probe_id int, embedding array<float>")
    how = C.Clustering(cell=150, top=200)  # several cells, rotations and levels
    got = {tuple(r) for r in C.found(df, probes, how).collect()}
    x = np.array([r[1] for r in rows[:900]])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ centre.T
    sure = {(i, k) for i, k in truth.items() if k < 3 and near[i, k] > 0.5 and np.sort(near[i])[-2] < 0.35}
    assert len(sure) > 300 and sure <= got and all(truth.get(i, 1) == p for i, p in got)
    m = C.members(df, how=how).collect()
    assert sorted(r.id for r in m) == [*range(900), *range(6000, 6004)]  # every usable vector is in a group, once
    cluster = {r.id: r.cluster for r in m}
    assert {cluster[i] for i in range(6000, 6004)} == {cluster[7]}
    d = {r.cluster: r for r in C.described(df, how=how).collect()}
    assert sum(r.size for r in d.values()) == len(m) and all(len(r.typical_ids) == min(5, r.size) and {cluster[i] for i in r.typical_ids} == {k} for k, r in d.items())
    large = [r for r in d.values() if r.size > 100]
    assert len(large) == 5 and all(len({truth.get(i % 6000 if i < 6000 else 7) for i in r.typical_ids}) == 1 for r in large)
    assert C.found(df.where("false"), probes, how).count() == 0 and C.members(df.where("false")).count() == 0 and C.members(df.where("id = 3")).collect()[0].cluster == 3


@pytest.mark.parametrize("part, least", [(65_536, 0.9), (250, 0.75)])  # dealing a cell parts some neighbours
def test_graph_recall_over_many_cells(spark, part, least):
    rng = np.random.default_rng(11)
    x = (rng.normal(size=(20, 64))[np.arange(4000) % 20] * 0.7 + rng.normal(size=(4000, 64))).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<float>")
    how = C.Clustering(cell=300, part=part, asked=100, start=0.97)  # 128 cells a rotation, and as many rotations as that takes
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    np.fill_diagonal(s, -2)
    true = np.argsort(-s, axis=1)[:, : how.near]
    item = {r.item: r.id for r in df.selectExpr("xxhash64(embedding) AS item", "id").collect()}
    met = [len({item[j] for j in C._unpacked(np.frombuffer(r.list, np.uint8)[None], how.near)[0][0]} & set(true[item[r.item]].tolist())) for r in C.graph(df, how=how)[0].collect()]
    assert len(met) == 4000 and np.mean(met) / how.near > least, np.mean(met) / how.near


def test_modularity_parts_two_cliques():
    a, b = np.triu_indices(6, 1)
    com = C.modularity_communities(12, np.concatenate([a, a + 6, [0]]), np.concatenate([b, b + 6, [6]]), np.ones(31))
    assert len(set(com[:6])) == 1 and len(set(com[6:])) == 1 and com[0] != com[6]


def test_communities_are_the_same_by_joins_and_in_one_task(spark):
    rng = np.random.default_rng(12)
    x = (rng.normal(size=(12, 64))[np.arange(1500) % 12] * 0.5 + rng.normal(size=(1500, 64))).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<float>")
    lists = C.cut(C.graph(df)[0])
    alone, joined, mixed = ({tuple(r) for r in C.communities(lists, C.Clustering(top=top, strongest=1)).collect()} for top in (10**6, 1, 200))
    assert len(alone) == 1500 and 1 < len({r[1] for r in alone}) < 100
    assert alone == joined == mixed


@pytest.mark.parametrize("n", [3, 40, 700, 3001])
def test_nearest_in_a_cell_cost_little_more_than_their_products(n):
    load = C._small(np.random.default_rng(3).normal(size=(n, 64)).astype(np.float32)).view(np.uint8)
    k = min(5, n - 1)
    best, near = (np.concatenate(z) for z in zip(*C._nearest_in(load, k)))
    x, r = C._whole(load)
    s = (x @ x.T) * (r[:, None] * r)
    np.fill_diagonal(s, -2)
    assert np.array_equal(np.sort(near, axis=1), np.sort(s, axis=1)[:, -k:]) and np.array_equal(np.take_along_axis(s, best, 1), near)
    if n > 3000:

        def seconds(f):
            took = []
            for _ in range(5):
                began = time.process_time()
                f()
                took.append(time.process_time() - began)
            return min(took)

        s = s[:300]
        by_sorting = lambda: np.argpartition(-s[:, : n // 32 * 32].reshape(300, -1, 32).max(axis=2), 4, axis=1)  # noqa: E731 - the groups alone, as before
        assert seconds(lambda: C._best(s, 5)) < seconds(by_sorting)


def test_last_moves_need_no_lists_of_structs(spark, monkeypatch):
    """One row a node with what it has toward each community, as sums by hand give it."""
    rng = np.random.default_rng(12)
    n, k = 60, 5
    o = np.stack([rng.choice(np.delete(np.arange(n), i), k, replace=False) for i in range(n)])
    c = rng.uniform(0.3, 0.9, (n, k)).astype(np.float32)
    lists = spark.createDataFrame([(i, bytearray(row.tobytes())) for i, row in enumerate(C._packed(o, c))], "item long, list binary")
    com = rng.integers(0, 4, n)
    label = C.cut(spark.createDataFrame([(i, int(com[i])) for i in range(n)], "item long, community long"))
    plans, cut = [], C.cut
    monkeypatch.setattr(C, "cut", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or cut(df))
    got = {r.item: (r.community, r.degree) for r in C._moved_once(lists, label, C.Clustering()).collect()}
    w = np.rint(c.astype(np.float64) ** 2 * (1 << 20)) / (1 << 20)
    d, toward = w.sum(axis=1), np.array([[w[i][com[o[i]] == j].sum() for j in range(4)] for i in range(n)])
    inside, total = np.array([d[com == j].sum() for j in range(4)]), d.sum()
    for i in range(n):
        gain = [toward[i, j] - d[i] / total * (inside[j] - d[i] * (j == com[i])) if j == com[i] or toward[i, j] else -9 for j in range(4)]
        to = int(np.argmax(gain))
        assert got[i] == (to, toward[i, to])
    assert not any("collect_list" in p or "lambda" in p for p in plans)


def test_nearest_at_any_distance(spark):
    rng = np.random.default_rng(15)
    x = vectors(rng, 300, 10)
    rows = [(int(i), v.tolist()) for i, v in enumerate(x)] + [(5, x[5].tolist()), (900, None), (901, [0.0] * 64)]
    df = spark.createDataFrame(rows, "id long, embedding array<float>")
    y = x / np.linalg.norm(x, axis=1, keepdims=True)
    for how in (V.Nearest(), V.Nearest(hot=10)):  # as it is, and with most buckets dealt into several
        got = {(r.id, r.other_id) for r in V.nearest(df.where("id % 50 = 0"), df, how=how).collect()}
        want = {(q, int(b)) for q in range(0, len(x), 50) for b in [j for j in np.argsort(-(y[q] @ y.T), kind="stable") if j != q][:5]}
        assert len(got) == len(want) and len(got & want) >= 0.9 * len(want)
    assert V.nearest(df.where("false"), df.where("false")).count() == 0


@pytest.mark.parametrize("digits", [1, 2, 3, 4])
def test_pairs_meet_whatever_the_number_of_digits(digits):
    how = V.enough(V.Search(), digits)
    rng = np.random.default_rng(digits)
    x, z = rng.standard_normal((2, 3000, how.dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (x * z).sum(axis=1, keepdims=True) * x
    y = how.cosine * x + np.sqrt(1 - how.cosine**2) * z / np.linalg.norm(z, axis=1, keepdims=True)
    a, b = (V.keys(v.astype(np.float32), how, digits) for v in (x, y))
    assert np.mean([len(np.intersect1d(p, q)) > 0 for p, q in zip(a, b)]) > 0.98
    assert how == V.Search() if digits <= 2 else how.tables > V.Search().tables


def test_found_with_three_digits_equals_brute_force(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((300, 64))
    x = np.concatenate([x, x + 0.45 * rng.standard_normal(x.shape)])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x.astype(np.float32))], "id long, embedding array<float>")
    how = V.Search(bucket=0.03)  # so few to a bucket that 600 rows need three digits
    got = {(r.id_a, r.id_b) for r in V.found(df, how=how).collect()}
    want = {(i, j) for i, j in zip(*np.nonzero(np.triu(x @ x.T, 1) >= how.cosine))}
    assert want and got <= want and len(got) >= 0.98 * len(want)
