"""Sums over the subtrees of a forest by centroid decomposition.

A component is a connected piece of a tree. Its centroid is the deepest node whose subtree holds more than half of the component's weight.
The total of the centroid's subtree is added to every node on the path from the centroid to the component's top; then the centroid goes
and the component falls apart into the subtrees of its children and the rest around the top, each with at most half of the weight. A node and
one of its descendants part exactly once, at a centroid on the path between them, so every value is added once to each ancestor. Components
halve, so there are at most log2(weight) + 1 levels and a level touches each node a fixed number of times, whatever the depth of the trees.

The weight of a node is given with the total of its subtree; any positive weights do. Trie nodes weigh their members, as the total
of a subtree is then the number of turns its members still have, a plain sum that needs no roll-up.

Components of more than ``limit`` nodes are split by joins over the cluster: the ancestor at a given depth is looked up in ``path``, and sums and
weights move along the centroid's path alone. Smaller components are dealt out whole and go through the same steps inside a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.session import cut_lineage

#: Nodes of a component that one task takes at most.
LIMIT = 100_000
ROWS_AT_ONCE = 20_000


def sums_of(parent: list[int], weight: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Subtree sums of ``values`` (n x k); parents (-1: a top) stand before their children, ``weight`` is the total of each subtree."""
    n = len(parent)
    sizes = [1] * n
    for i in range(n - 1, -1, -1):
        if parent[i] >= 0:
            sizes[parent[i]] += sizes[i]
    place, free, end = [0] * n, [0] * n, 0
    for i, p in enumerate(parent):
        if p < 0:
            place[i], end = end, end + sizes[i]
        else:
            place[i], free[p] = free[p], free[p] + sizes[i]
        free[i] = place[i] + 1
    # From here on nodes are named by their place in depth-first order: the subtree of v is [v, v + size of v).
    at = np.array(place, dtype=np.int64)
    up, size, left, value = (np.empty_like(x) for x in (at, at, at, values))
    up[at] = [-1 if p < 0 else place[p] for p in parent]
    size[at], left[at], value[at] = sizes, weight, values
    out = np.zeros_like(value)
    top = np.zeros(n, dtype=np.int64)
    roots = np.flatnonzero(up < 0)
    top[:] = np.repeat(roots, size[roots])
    live = np.arange(n)
    while len(live):
        live = live[np.argsort(top[live], kind="stable")]
        own = top[live]
        first = np.flatnonzero(np.diff(own, prepend=-1))
        group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(live))))
        rank = np.arange(len(live))
        heavy = 2 * left[live] > left[live[first]][group]  # a path from the top down: the last one is the deepest
        centroid = live[np.maximum.reduceat(np.where(heavy, rank, -1), first)]
        c = centroid[group]
        below = (live >= c) & (live < c + size[c])
        above = (live <= c) & (c < live + size[live])
        total = np.add.reduceat(np.where(below[:, None], value[live], 0), first, axis=0)
        out[live[above]] += total[group[above]]
        lost = left[centroid][group]
        left[live[above]] -= np.where(live[above] != c[above], lost[above], 0)
        begins = np.maximum.accumulate(np.where(below & (up[live] == c), rank, -1))
        top[live] = np.where(below & (live != c), live[begins], own)
        live = live[live != c]
    return out[at]


def _components(table: pa.Table, values: list[str]) -> pa.RecordBatch:
    """The sums of whole components, sorted by component and depth."""
    k1, k2, p1, p2, c1, c2 = (table.column(n).to_pylist() for n in ("k1", "k2", "p1", "p2", "c1", "c2"))
    place = {key: i for i, key in enumerate(zip(k1, k2))}
    parent = [-1 if (a, b) == (e, f) else place[c, d] for a, b, c, d, e, f in zip(k1, k2, p1, p2, c1, c2)]
    given = np.stack([table.column(v).to_numpy() for v in values], axis=1)
    sums = sums_of(parent, table.column("s").to_numpy(), given)
    return pa.RecordBatch.from_arrays([table.column("k1").combine_chunks(), table.column("k2").combine_chunks(), *map(pa.array, sums.T)], names=["k1", "k2", *values])


def rollup(nodes: DataFrame, path: DataFrame, values: list[str], limit: int = LIMIT) -> DataFrame:
    """``k1, k2`` and the sum of each of ``values`` (long) over the node's subtree.

    ``nodes``: ``k1, k2`` (a node's key), ``p1, p2`` (its parent's), ``t1, t2`` (its tree's top), ``depth``, ``conv`` (a conversation that passes
    it), ``weight`` (of its subtree) and the values. ``path``: ``conv, depth, k1, k2, p1, p2`` of every conversation that ``nodes`` names.
    """
    live = nodes.select("k1", "k2", "p1", "p2", F.col("t1").alias("c1"), F.col("t2").alias("c2"), "depth", "conv", F.col("weight").alias("s"), *values)
    step = path.select(F.col("conv").alias("on"), F.col("depth").alias("at"), F.col("k1").alias("a1"), F.col("k2").alias("a2"), F.col("p1").alias("q1"), F.col("p2").alias("q2"))
    own, ready, added = ["c1", "c2"], [], []
    while True:
        large = cut_lineage(live.groupBy(*own).agg(F.count(F.lit(1)).alias("n"), F.max("s").alias("total"), F.min("depth").alias("top")).where(F.col("n") > limit).drop("n"))
        if large.isEmpty():
            ready.append(live)
            break
        ready.append(live.join(large, own, "left_anti"))
        big = cut_lineage(live.join(large, own))
        deepest = F.max_by(F.struct(F.col("k1").alias("x1"), F.col("k2").alias("x2"), F.col("conv").alias("x_conv"), F.col("depth").alias("x_depth"), F.col("s").alias("x_s")), "depth")
        centroids = cut_lineage(big.where(2 * F.col("s") > F.col("total")).groupBy(*own, "top").agg(deepest.alias("x")).select(*own, "top", "x.*"))
        seen = big.drop("total", "top").join(centroids.drop("top"), own)
        # The ancestor just below the centroid's depth says whether, and under which child, a node lies below the centroid.
        ahead = seen.join(step, (F.col("on") == F.col("conv")) & (F.col("at") == F.col("x_depth") + 1) & (F.col("depth") > F.col("x_depth")), "left")
        below = F.coalesce((F.col("q1") == F.col("x1")) & (F.col("q2") == F.col("x2")), F.lit(False))
        self = (F.col("k1") == F.col("x1")) & (F.col("k2") == F.col("x2"))
        placed = cut_lineage(ahead.select(*live.columns, "a1", "a2", below.alias("below"), self.alias("self")))
        totals = placed.where("below OR self").groupBy(*own).agg(*[F.sum(v).alias(v) for v in values])
        upward = centroids.join(totals, own).join(step, (F.col("on") == F.col("x_conv")) & F.col("at").between(F.col("top"), F.col("x_depth")))
        along = cut_lineage(upward.select(F.col("a1").alias("k1"), F.col("a2").alias("k2"), F.col("x_s").alias("lost"), *values))
        added.append(along.drop("lost"))
        rest = placed.where("NOT self").join(along.select("k1", "k2", "lost"), ["k1", "k2"], "left")
        live = rest.select(
            "k1", "k2", "p1", "p2", *[F.when(F.col("below"), F.col(a)).otherwise(F.col(c)).alias(c) for a, c in (("a1", "c1"), ("a2", "c2"))], "depth", "conv",
            (F.col("s") - F.coalesce(F.col("lost"), F.lit(0))).alias("s"), *values,
        )
        live = cut_lineage(live)
    names = live.columns

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            held = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            if held.num_rows < ROWS_AT_ONCE:
                continue
            last1, last2 = held.column("c1").to_numpy(), held.column("c2").to_numpy()
            whole = int(np.argmax((last1 == last1[-1]) & (last2 == last2[-1])))  # the last component may go on in the next batch
            if whole:
                yield _components(held.slice(0, whole), values)
                held = held.slice(whole)
        if held is not None and held.num_rows:
            yield _components(held, values)

    dealt = reduce(DataFrame.unionByName, [r.select(*names) for r in ready]).repartition(*own).sortWithinPartitions(*own, "depth", "k1", "k2")
    done = dealt.mapInArrow(finish, ", ".join(["k1 bigint, k2 bigint", *[f"{v} bigint" for v in values]]))
    if not added:
        return done
    return reduce(DataFrame.unionByName, [done, *added]).groupBy("k1", "k2").agg(*[F.sum(v).alias(v) for v in values])
