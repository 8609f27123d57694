"""Greedy, order-dependent selection of leaders, as parallel rounds over tables.

Taken one by one in order, an item becomes a leader iff no earlier leader is within theta.
The result is the lexicographically first maximal independent set of the similarity graph,
which can be found in rounds: an item with an earlier leader neighbour drops out, an item
whose earlier neighbours have all dropped out is a leader.

The full graph is never built: a cluster of n near-copies would have n^2 edges. A round looks
for leaders only among the heads, the first few undecided items of every cell, and then drops
whatever resembles a leader it found. A member of a cluster is thus compared with the few
leaders of its cells and not with its fellow members. Heads that rank behind the heads of
another cell of theirs may be dropped but not promoted in that round. The number of heads
grows from round to round, which bounds the number of rounds; no item is ever left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.session import cut_and_measure, cut_lineage

GROWTH = 8
SALTS = 32
OPEN, LEADER, DROPPED = 0, 1, 2


def _step(edges: DataFrame, state: DataFrame) -> DataFrame:
    """One round of promotion and dropping along ``edges(i, j)``."""
    seen = (
        edges.join(state.select(F.col("ord").alias("j"), F.col("status").alias("status_j")), "j")
        .groupBy(F.col("i").alias("ord"))
        .agg(
            F.max(F.col("status_j") == LEADER).alias("by_leader"),
            F.max(F.col("status_j") == OPEN).alias("by_open"),
        )
    )
    status = (
        F.when(F.col("status") != OPEN, F.col("status"))
        .when(F.col("by_leader"), DROPPED)
        .when(F.col("complete") & ~F.coalesce("by_open", F.lit(False)), LEADER)
        .otherwise(OPEN)
    )
    return state.join(seen, "ord", "left").select("ord", "complete", status.alias("status"))


def _settle(edges: DataFrame, state: DataFrame) -> tuple[DataFrame, int]:
    """Propagate leader/dropped along ``edges(i, j)``, all nodes being open, until nothing changes.

    Gives the state and the number of nodes still open.
    """
    still_open = F.count_if(F.col("status") == OPEN)
    state, open_before = cut_lineage(state), None
    while True:
        state, seen = cut_and_measure(_step(edges, state), open=still_open)
        if seen["open"] in (0, open_before):
            return state, seen["open"]
        open_before = seen["open"]


def first_of_cells(entries: DataFrame, k: int, salts: int = SALTS) -> DataFrame:
    """``cell, ord, _n``: the first ``k`` items at home in each cell, numbered.

    First those of each of ``salts`` slices of a cell, then the first of these: no task sorts a whole cell, only a slice or
    ``salts * k`` rows, and only cells and places move.
    """
    slices = entries.filter("home").select("cell", "ord").withColumn("_slice", F.pmod(F.xxhash64("ord"), F.lit(salts)))
    for group in (["cell", "_slice"], ["cell"]):
        place = Window.partitionBy(*group).orderBy("ord")
        slices = slices.withColumn("_n", F.row_number().over(place)).filter(F.col("_n") <= k)
    return slices.drop("_slice")


def greedy_leaders(space, candidates: DataFrame) -> DataFrame:
    """``ord`` of the leaders among ``candidates`` (a subset of the entries of ``space``)."""
    leaders, left, heads_per_cell = None, candidates, space.first_heads
    while True:
        heads = cut_lineage(left.filter("home").join(first_of_cells(left, heads_per_cell), ["cell", "ord"]))
        among = left.join(heads.select("ord").distinct(), "ord", "left_semi")
        edges = cut_lineage(space.match(among, heads.drop("_n")).select("i", "j").distinct())
        full = heads.groupBy("cell").agg(F.max("_n").alias("_n"), F.max("ord").alias("last"))
        full = full.filter(F.col("_n") == heads_per_cell).select("cell", "last")
        # An item is complete if none of its cells hides earlier items; only heads can be.
        state = (
            left.join(full, "cell", "left")
            .groupBy("ord")
            .agg((F.count_if(F.col("ord") > F.col("last")) == 0).alias("complete"))
            .withColumn("status", F.lit(OPEN))
        )
        state, n_open = _settle(edges, state)
        found = state.filter(F.col("status") == LEADER).select("ord")
        leaders = found if leaders is None else leaders.union(found)
        if n_open == 0:
            return leaders
        rest = left.join(state.filter(F.col("status") == OPEN).select("ord"), "ord", "left_semi")
        near = space.match(rest, left.join(found, "ord", "left_semi"), best=True).select(F.col("i").alias("ord"))
        left, seen = cut_and_measure(rest.join(near, "ord", "left_anti"), n=F.count(F.lit(1)))
        if seen["n"] == 0:
            return leaders
        heads_per_cell *= GROWTH
