"""Parent-child rows to full hierarchies by bottom-up peeling.

Round by round the leaves are peeled off: each sends its subtree size to its parent.  Peeling one level a round would
take as many rounds as the tree is deep, so a distributed round peels the whole *pendant path* above each leaf: the
nodes up to the first that still has another child.  Where a path ends is found by pointer doubling, in the logarithm
of its length.  A forest of n nodes is gone after at most log2(n) rounds, however deep it is.  As soon as what is left
fits a task of bounded size (``ALONE`` nodes, whatever the table's), that task peels it level by level.  What has no
leaf left lies on cycles.  In reverse order of peeling every node then takes depth, root and path from the one it
hangs on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernel.plans.lineage import cut, release

#: Nodes that one task peels by itself (with ids of 36 characters about 10 MB).
ALONE = 50_000
#: Ids in paths that a task holds before it sends them on.
_HELD = 500_000


def normal_id(c: Column | str) -> Column:
    """An id without outer blanks and letter case; null if nothing is left."""
    c = F.regexp_replace(F.lower(c), r"(?U)^\s+|\s+$", "")
    return F.when(c != "", c)


def canonical(df: DataFrame, id_col: str = "id", parent_col: str = "parent") -> DataFrame:
    """``(key, id, parent)``, one row for each id: ``key`` is the compared form, ``parent`` the key of a parent that
    exists, else null.  Of the spellings of an id the least is given, of differing parents the least that is not
    blank; rows without an id are dropped, as they name no node."""
    rows = df.select(normal_id(id_col).alias("key"), F.col(id_col).alias("id"), normal_id(parent_col).alias("parent")).where("key is not null")
    nodes = rows.groupBy("key").agg(F.min("id").alias("id"), F.min("parent").alias("parent"))
    known = nodes.select(F.col("key").alias("parent"), F.lit(True).alias("known"))
    return nodes.join(known, "parent", "left").select("key", "id", F.when(F.col("known"), F.col("parent")).alias("parent"))


def _numbered(batches: Iterator[pa.RecordBatch], columns: int) -> tuple[list[str], list[np.ndarray], list[list]] | None:
    """The names of the first column, the places of the next ``columns`` among them (-1 for none), and the rest as lists."""
    rows = [b for b in batches if b.num_rows]
    if not rows:
        return None
    cols = [[x for b in rows for x in b.column(i).to_pylist()] for i in range(rows[0].num_columns)]
    place = {k: i for i, k in enumerate(cols[0])}
    at = [np.fromiter((place.get(p, -1) for p in c), np.int64, len(c)) for c in cols[1 : 1 + columns]]
    return cols[0], at, cols[1 + columns :]


def _chains_alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``_down_chains`` of few enough nodes, in one task."""
    if (rows := _numbered(batches, 1)) is None:
        return
    names, (down,), (only, weight, parent) = rows
    n = len(names)
    # the place behind the last stands for what is no node with one child: the end of every chain
    to = np.append(np.where(down < 0, n, down), n)
    last, steps, w = np.append(np.arange(n), n), np.append(np.ones(n, np.int64), 0), np.append(np.array(weight, np.int64), 0)
    for _ in range(n.bit_length() + 1):
        last = np.where(to < n, last[to], last)
        steps, w, to = steps + steps[to], w + w[to], to[to]
    done = np.flatnonzero(to[:n] == n)  # others are on a bare cycle
    yield pa.RecordBatch.from_arrays(
        [pa.array([names[i] for i in done], pa.string()), pa.array([parent[i] for i in done], pa.string()), pa.array([only[last[i]] for i in done], pa.string()), pa.array(steps[done]), pa.array(w[done])],
        ["key", "parent", "end", "steps", "weight"],
    )


def _down_chains(unary: DataFrame, alone: int) -> DataFrame:
    """``(key, parent, end, steps, weight)``: for every node with one child, the first node below it that has none or
    several, the steps to it and the weights on the way, its own included.  Nodes on a bare cycle have no end and are
    left out.  ``unary`` has ``key``, ``parent``, ``only``, ``weight``."""
    if unary.count() <= alone:
        return cut(unary.select("key", "only", F.col("only").alias("_only"), "weight", "parent").repartition(1).mapInArrow(_chains_alone, "key string, parent string, end string, steps long, weight long"))
    now = cut(unary.select("key", "parent", F.col("only").alias("end"), F.lit(1).cast("long").alias("steps"), "weight", F.lit(False).alias("done")))
    open_before = -1
    while True:
        there = now.select(F.col("key").alias("end"), F.col("end").alias("_end"), F.col("steps").alias("_steps"), F.col("weight").alias("_weight"), F.col("done").alias("_done"))
        hop = now.where("not done").join(there, "end", "left").select(
            "key", "parent", F.coalesce("_end", "end").alias("end"), (F.col("steps") + F.coalesce("_steps", F.lit(0))).alias("steps"),
            (F.col("weight") + F.coalesce("_weight", F.lit(0))).alias("weight"), F.coalesce("_done", F.lit(True)).alias("done"),
        )
        after = cut(now.where("done").unionByName(hop))
        release(now)
        now = after
        # A step that ends no chain while some are open leaves only cycles: a chain twice as long has nodes half way.
        still = now.where("not done").count()
        if still in (0, open_before):
            return now.where("done").drop("done")
        open_before = still


def peel(nodes: DataFrame, alone: int = ALONE) -> tuple[list[DataFrame], DataFrame]:
    """The peeled rounds and what is left for one task.  A round has ``(key, id, top, top_parent, below_top,
    subtree_size)`` of each node peeled: the upper end of its path, that one's parent, the steps from it, the nodes in
    its subtree.  The rest is ``(key, id, parent, got)``: at most ``alone`` nodes, or nodes without leaves."""
    live = nodes.select("key", "id", "parent", F.lit(0).cast("long").alias("got"))
    rounds: list[DataFrame] = []
    while live.count() > alone:
        kids = live.where("parent is not null").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("kids"), F.min("key").alias("only"))
        state = cut(live.join(kids, "key", "left").fillna(0, ["kids"]))
        leaves = state.where("kids = 0").select("key", "parent", (F.col("got") + 1).alias("size"))
        if leaves.isEmpty():
            release(state)
            break
        chains = _down_chains(state.where("kids = 1").select("key", "parent", "only", (F.col("got") + 1).alias("weight")), alone)
        above = chains.join(leaves.select(F.col("key").alias("end"), "size"), "end").select("key", "parent", F.col("end").alias("path"), F.col("steps").alias("up"), (F.col("weight") + F.col("size")).alias("size"))
        peeled = cut(above.unionByName(leaves.select("key", "parent", F.col("key").alias("path"), F.lit(0).cast("long").alias("up"), "size")))
        tops = peeled.groupBy("path").agg(F.max("up").alias("length"), F.max_by(F.struct("key", "parent"), "up").alias("top"))
        rounds.append(cut(peeled.join(tops, "path").select("key", F.col("top.key").alias("top"), F.col("top.parent").alias("top_parent"), (F.col("length") - F.col("up")).alias("below_top"), F.col("size").alias("subtree_size"))))
        sent = rounds[-1].where("below_top = 0").where("top_parent is not null").groupBy(F.col("top_parent").alias("key")).agg(F.sum("subtree_size").alias("sent"))
        rest = state.join(rounds[-1].select("key"), "key", "left_anti")
        after = cut(rest.join(sent, "key", "left").select("key", "id", "parent", (F.col("got") + F.coalesce("sent", F.lit(0))).alias("got")))
        release(peeled, chains, state, live)
        live = after
    return rounds, live


SOLVED = "key string, root_key string, depth long, subtree_size long"


def _solve_alone(with_paths: bool):
    """The rest that one task peels: ``SOLVED``, and the path of ids if asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (rows := _numbered(batches, 1)) is None:
            return
        names, (parent,), (ids, got) = rows
        n = len(names)
        size = np.array(got, np.int64) + 1
        kids = np.bincount(parent[parent >= 0], minlength=n)
        order, leaves = [], np.flatnonzero(kids == 0)
        while len(leaves):
            order.append(leaves)
            up = parent[leaves]
            hung = leaves[up >= 0]
            np.add.at(size, parent[hung], size[hung])
            np.subtract.at(kids, parent[hung], 1)
            up = np.unique(parent[hung])
            leaves = up[kids[up] == 0]
        root, depth = np.full(n, -1), np.full(n, -1)
        for level in reversed(order):
            up = parent[level]
            top = up < 0
            root[level[top]], depth[level[top]] = level[top], 0
            below = ~top & (depth[up] >= 0)
            root[level[below]], depth[level[below]] = root[up[below]], depth[up[below]] + 1
        cyclic = np.ones(n, bool)
        if order:
            cyclic[np.concatenate(order)] = False
        schema = ["key", "root_key", "depth", "subtree_size"] + ["path"] * with_paths

        def batch(at: np.ndarray, paths: list) -> pa.RecordBatch:
            cols = [pa.array([names[i] for i in at], pa.string()), pa.array([names[root[i]] if root[i] >= 0 else None for i in at], pa.string()), pa.array(depth[at]), pa.array(size[at], mask=cyclic[at])]
            return pa.RecordBatch.from_arrays([*cols, pa.array(paths, pa.list_(pa.string()))] if with_paths else cols, schema)

        if not with_paths:
            yield batch(np.arange(n), [])
            return
        yield batch(np.flatnonzero(depth < 0), [None] * int((depth < 0).sum()))
        # depth first, so that only the path down to the node at hand is held
        below: list[list[int]] = [[] for _ in range(n)]
        for i in np.flatnonzero(depth > 0).tolist():
            below[parent[i]].append(i)
        stack, path, at, paths, held = np.flatnonzero(depth == 0)[::-1].tolist(), [], [], [], 0
        while stack:
            i = stack.pop()
            del path[depth[i] :]
            path.append(ids[i])
            at.append(i)
            paths.append(path.copy())
            held += len(path)
            stack += below[i]
            if held > _HELD:
                yield batch(np.array(at), paths)
                at, paths, held = [], [], 0
        if at:
            yield batch(np.array(at), paths)

    return run


def _without_leaf(rest: DataFrame, with_paths: bool) -> DataFrame:
    """More nodes than one task takes, all of them on or above cycles of which none has a leaf."""
    out = rest.select("key", F.lit(None).cast("string").alias("root_key"), F.lit(-1).cast("long").alias("depth"), F.lit(None).cast("long").alias("subtree_size"))
    return out.withColumn("path", F.lit(None).cast("array<string>")) if with_paths else out


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(key, own)`` of rows (top, id, key) sorted by top and place: the ids from the top down to each."""
    top, path = None, []
    for b in batches:
        keys, own, held = [], [], 0
        for t, i, k in zip(*(b.column(c).to_pylist() for c in range(3))):
            if t != top:
                top, path = t, []
            path.append(i)
            keys.append(k)
            own.append(path.copy())
            held += len(path)
            if held > _HELD:
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(own, pa.list_(pa.string()))], ["key", "own"])
                keys, own, held = [], [], 0
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(own, pa.list_(pa.string()))], ["key", "own"])


def _solved(nodes: DataFrame, with_paths: bool, alone: int) -> DataFrame:
    """``SOLVED`` of every node, and its path if asked for."""
    rounds, rest = peel(nodes, alone)
    if rest.count() > alone:
        solved = _without_leaf(rest, with_paths)
    else:
        solved = rest.select("key", "parent", "id", "got").repartition(1).mapInArrow(_solve_alone(with_paths), SOLVED + ", path array<string>" * with_paths)
    solved = cut(solved)
    release(rest)
    for r in reversed(rounds):
        above = solved.select(F.col("key").alias("top_parent"), F.col("root_key").alias("_root"), F.col("depth").alias("_depth"), *([F.col("path").alias("_path")] * with_paths))
        here = r
        if with_paths:
            ordered = r.join(nodes.select("key", "id"), "key").repartition("top").sortWithinPartitions("top", "below_top").select("top", "id", "key")
            here = r.join(ordered.mapInArrow(_prefixes, "key string, own array<string>"), "key")
        own_top = F.col("top_parent").isNull()
        here = here.join(above, "top_parent", "left").select(
            "key", F.when(own_top, F.col("top")).otherwise(F.col("_root")).alias("root_key"),
            F.when(own_top, F.col("below_top")).when(F.col("_depth") < 0, F.lit(-1)).otherwise(F.col("_depth") + 1 + F.col("below_top")).alias("depth"), "subtree_size",
            *([F.when(own_top, F.col("own")).otherwise(F.concat("_path", "own")).alias("path")] * with_paths),
        )
        after = cut(solved.unionByName(here))
        release(solved, r)
        solved = after
    return solved


def hierarchy(df: DataFrame, id_col: str = "id", parent_col: str = "parent", alone: int = ALONE) -> DataFrame:
    """``(key, id, parent, root_key, depth, subtree_size)`` of each node; on or below a cycle ``root_key`` is null,
    ``depth`` -1, and on one ``subtree_size`` is null.

    Ids are compared without letter case and outer blanks.  A node whose parent is null, blank or unknown is a root.
    A node that is its own parent is a cycle.  Repeated rows of an id are one node (see ``canonical``).  Further
    columns of ``df`` are ignored; an empty table gives no rows.
    """
    nodes = cut(canonical(df, id_col, parent_col))
    return nodes.join(_solved(nodes, False, alone), "key").select("key", "id", "parent", "root_key", "depth", "subtree_size")


def found(df: DataFrame, id_col: str = "id", parent_col: str = "parent", alone: int = ALONE) -> DataFrame:
    """``(id, root_id, depth)``: root and depth of each concept in the spelling of its id; '' and -1 on and below cycles."""
    nodes = cut(canonical(df, id_col, parent_col))
    h = nodes.select("key", "id").join(_solved(nodes, False, alone), "key")
    roots = nodes.select(F.col("key").alias("root_key"), F.col("id").alias("root_id"))
    return h.join(roots, "root_key", "left").select("id", F.coalesce("root_id", F.lit("")).alias("root_id"), F.col("depth").cast("int").alias("depth"))


def paths(df: DataFrame, id_col: str = "id", parent_col: str = "parent", alone: int = ALONE) -> DataFrame:
    """``(id, root_id, depth, subtree_size, path)``: as ``found`` with the ids from the root to the node; the path is
    null on and below cycles, the size null on them.  A row holds as many ids as the node is deep."""
    nodes = cut(canonical(df, id_col, parent_col))
    solved = _solved(nodes, True, alone)
    return nodes.select("key", "id").join(solved, "key").select("id", F.coalesce(F.col("path")[0], F.lit("")).alias("root_id"), F.col("depth").cast("int").alias("depth"), "subtree_size", "path")


def descendants(df: DataFrame, id_col: str = "id", parent_col: str = "parent") -> DataFrame:
    """``(id, descendant_id, distance)``: each node with every node below it.  The paths already hold all pairs, so
    they are only laid out: no join, no group of unbounded size."""
    p = paths(df, id_col, parent_col).where("depth > 0")
    return p.select(F.posexplode(F.slice("path", F.lit(1), F.col("depth"))).alias("at", "id"), F.element_at("path", -1).alias("descendant_id"), "depth").select("id", "descendant_id", (F.col("depth") - F.col("at")).alias("distance"))
