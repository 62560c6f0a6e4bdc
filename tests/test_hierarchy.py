import random

import pytest

from quernel.operators import hierarchy as H


def brute(rows):
    parent = {}
    for i, p in rows:
        if i is not None and i.strip():
            q = (p or "").strip().lower()
            old = parent.get(i.strip().lower())
            parent[i.strip().lower()] = min(x for x in (old, q) if x) if old or q else ""
    out = {}
    for k in parent:
        seen, x, n = [k], k, 0
        while parent[x] in parent:
            x, n = parent[x], n + 1
            if x in seen:
                n = -1
                break
            seen.append(x)
        out[k] = ("", -1, None) if n < 0 else (x, n, list(reversed(seen)))
    return out


@pytest.mark.parametrize("alone", [H.ALONE, 20, 0])  # one task, rounds and then one task, rounds only
def test_random_forests(spark, alone):
    rng = random.Random(3)
    rows = []
    for tree, deep in (("a", 1), ("b", 3), ("c", 40)):  # a chain, a deep and a bushy tree
        rows += [(f"{tree}{i}", f"{tree}{rng.randrange(max(0, i - deep), i)}" if i else None) for i in range(60)]
    rows += [(f"y{i}", f"y{(i + 1) % 5}") for i in range(5)] + [("t1", "y0"), ("t2", "t1"), ("self", "self"), ("lone", None)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "id string, parent string")
    want = brute(rows)
    assert {r.id: (r.root_id, r.depth) for r in H.found(df, alone=alone).collect()} == {k: v[:2] for k, v in want.items()}
    got = {r.id: r for r in H.paths(df, alone=alone).collect()}
    assert {k: r.path for k, r in got.items()} == {k: v[2] for k, v in want.items()}
    below = {(p[i], p[-1], len(p) - 1 - i) for _, _, p in want.values() if p for i in range(len(p) - 1)}
    for k, (_, depth, _) in want.items():
        if depth >= 0:
            assert got[k].subtree_size == 1 + sum(a == k for a, _, _ in below)


def test_descendants(spark):
    df = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("d", "a"), ("x", "y"), ("y", "x")], "id string, parent string")
    assert {tuple(r) for r in H.descendants(df).collect()} == {("a", "b", 1), ("a", "c", 2), ("b", "c", 1), ("a", "d", 1)}


def test_dirty_ids(spark):
    rows = [("A-1", None, 1), ("b-2", "  a-1 ", 2), ("b-2", "A-1", 3), ("c-3", "", 4), ("d-4", "unknown", 5), ("e-5", "B-2\t", 6), (None, "a-1", 7), ("  ", "a-1", 8)]
    df = spark.createDataFrame(rows, "id string, parent string, key int")  # a further column with a name used inside
    assert {tuple(r) for r in H.found(df).collect()} == {("A-1", "A-1", 0), ("b-2", "A-1", 1), ("c-3", "c-3", 0), ("d-4", "d-4", 0), ("e-5", "A-1", 2)}


def test_empty(spark):
    df = spark.createDataFrame([], "id string, parent string")
    assert H.found(df).count() == 0 and H.paths(df).count() == 0
