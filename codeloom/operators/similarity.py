"""Exact cosine matching above a threshold, without forming all pairs.

A *space* spreads items over cells so that any two items with ``sim >= theta`` meet in a
cell. ``entries`` has one row per (item, cell): ``ord`` (unique, the item's place in the
total order), ``cell``, ``home`` (whether others can find the item here) and the features.
``match(probe, index)`` joins two subsets of the entries cell by cell and gives
``(i, j, sim)`` with ``ord_j < ord_i`` and ``sim >= theta``. A pair may come up once per
shared cell; callers aggregate.

* :class:`GramSpace` - labels as 3-gram counts. Cells are grams. Only the rare grams of a
  label are indexed: once the norm of what is left falls below theta, the remaining (common)
  grams cannot reach theta on their own. Stays in the JVM.
* :class:`VectorSpace` - dense vectors. Cells are the nearest of a bounded number of pivot
  vectors; an item visits the cells the triangle inequality of angles cannot rule out. A cell
  above a row limit is split by pivots of its own, in the same way and level by level. Both only
  where it saves half of the comparisons and repeats items a bounded number of times on average:
  where the angles rule out too little, all items stay in one cell. The products are NumPy tiles.

Hot cells are split: both sides of a cell are cut into as many parts as its count needs, and every
part of one side meets every part of the other in a task of its own. Of vectors the parts grow with
the cell up to a size in bytes, so rows are repeated about as often whatever the number of items; the
larger side is cut more often, so that rows of it are not repeated for a small one.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions.ngrams import counted, grams_of
from codeloom.session import cut_lineage

EPS = 1e-9
# Number of most frequent grams whose frequency is kept. A table of this many rows is all
# that is ever broadcast; a gram outside it only loses its place in the order, not a match.
FREQUENT_GRAMS = 65_536
ROWS_PER_SALT = 50_000
# Splitting a cell of vectors: pivots per cell, levels below the first, and the share of the cell's comparisons
# that has to be left for a split to be made (it repeats rows).
FAN = 32
LEVELS = 3
WORTH = 0.5
# Entries of a space of vectors, per item, at most: cells that would repeat items more often are not made.
REPEATS = 8
# Blocks that a cell is cut into, while their sides are smaller than BLOCK_BYTES of 64-bit numbers.
BLOCKS = 36
BLOCK_BYTES = 32 << 20


def _check_theta(theta: float) -> None:
    if not 0.0 < theta <= 1.0:
        raise ValueError("theta must be in (0, 1]")


@dataclass
class GramSpace:
    entries: DataFrame
    theta: float
    first_heads: int = 64

    @classmethod
    def build(cls, items: DataFrame, theta: float, rows_per_salt: int = ROWS_PER_SALT) -> "GramSpace":
        """``items``: ``ord bigint, label string``."""
        _check_theta(theta)
        grams = items.select("ord", grams_of(F.col("label")).alias("all")).select("ord", F.inline(counted(F.col("all"))))
        frequent = (
            grams.groupBy("g").agg(F.count(F.lit(1)).alias("df")).orderBy(F.desc("df"), "g").limit(FREQUENT_GRAMS)
        )
        ranked = grams.join(F.broadcast(frequent), "g", "left").select(
            "ord", F.struct(F.coalesce("df", F.lit(0)).alias("df"), "g", "c").alias("e")
        )
        feats = ranked.groupBy("ord").agg(
            F.array_sort(F.collect_list("e")).alias("prof"),
            F.sum(F.col("e.c") * F.col("e.c")).alias("n2"),
        )

        def rest(k):
            """Norm of the profile from position k on, as a share of the whole norm."""
            tail = F.slice(F.col("prof"), k + 1, F.size("prof"))
            square = F.aggregate(tail, F.lit(0).cast("bigint"), lambda a, e: a + e["c"] * e["c"])
            return F.sqrt(square / F.col("n2"))

        keys = F.filter(
            F.transform(
                "prof",
                lambda e, k: F.struct(
                    e["g"].alias("cell"),
                    rest(k).alias("rest"),
                    (F.floor(e["df"] / rows_per_salt) + 1).cast("int").alias("salts"),
                ),
            ),
            lambda s: s["rest"] >= theta - EPS,
        )
        profile = F.transform("prof", lambda e: F.struct(e["g"].alias("g"), e["c"].alias("c")))
        keyed = feats.withColumn("keys", keys).withColumn("prof", profile)
        entries = keyed.select("ord", "n2", "prof", F.inline("keys"), F.lit(True).alias("home"))
        return cls(cut_lineage(entries), theta)

    def match(self, probe: DataFrame, index: DataFrame, best: bool = False) -> DataFrame:
        # A hot cell is a rectangle of salts: each side is cut by its own items and repeated for the cuts of the other.
        own = F.pmod(F.xxhash64("ord"), F.col("salts")).cast("int")
        every = F.explode(F.sequence(F.lit(0), F.col("salts") - 1))
        left = probe.select(
            F.col("ord").alias("i"),
            "cell",
            F.col("prof").alias("prof_i"),
            F.col("n2").alias("n2_i"),
            F.col("rest").alias("rest_i"),
            own.alias("salt"),
            every.alias("chunk"),
        )
        right = index.select(
            F.col("ord").alias("j"),
            "cell",
            F.map_from_entries("prof").alias("counts_j"),
            F.col("n2").alias("n2_j"),
            F.col("rest").alias("rest_j"),
            every.alias("salt"),
            own.alias("chunk"),
        )
        # At the first gram two labels share, nothing before it contributes to the product.
        reachable = (F.col("j") < F.col("i")) & (F.col("rest_i") * F.col("rest_j") >= self.theta - EPS)
        pairs = left.join(right, ["cell", "salt", "chunk"]).filter(reachable)
        dot = F.aggregate(
            "prof_i",
            F.lit(0).cast("bigint"),
            lambda a, e: a + e["c"] * F.coalesce(F.try_element_at("counts_j", e["g"]), F.lit(0)),
        )
        sim = dot / F.sqrt(F.col("n2_i") * F.col("n2_j"))
        found = pairs.select("i", "j", sim.alias("sim")).filter(F.col("sim") >= self.theta)
        return best_match(found) if best else found


@dataclass
class VectorSpace:
    entries: DataFrame
    theta: float
    rows_per_block: int = 1024
    first_heads: int = 1024
    most_rows: int = 1024

    @classmethod
    def build(
        cls, items: DataFrame, theta: float, rows_per_block: int = 1024, max_cells: int = 1024, rows_per_cell: int | None = None
    ) -> "VectorSpace":
        """``items``: ``ord bigint, embedding array<float>`` with non-empty vectors of one size; those with a ``home`` of false are only probes.

        A cell of more than ``rows_per_cell`` items (16 blocks, if not given) is split.
        """
        limit = rows_per_cell or 16 * rows_per_block
        _check_theta(theta)
        home = F.col("home") if "home" in items.columns else F.lit(True)
        items = items.select("ord", F.col("embedding").cast("array<float>").alias("embedding"), home.alias("home"))
        seen = items.agg(F.count(F.lit(1)).alias("n"), F.count_if("home").alias("n_home")).first()
        n_cells = max(1, min(max_cells, math.ceil(seen.n_home / rows_per_block)))
        # Pivots: a repeatable pick, at most max_cells vectors on the driver.
        rows = items.where("home").orderBy(F.xxhash64("ord"), "ord").limit(n_cells).select("embedding").collect()
        dim = max([len(r[0] or ()) for r in rows], default=0) or 1
        pivots, entries = [r[0] for r in rows], None
        if len(rows) > 1:
            homes = cut_lineage(items.mapInArrow(_assign_home(pivots), "ord bigint, embedding array<float>, home boolean, cell int, angle double"))
            radius = dict(homes.where("home").groupBy("cell").agg(F.max("angle")).collect())  # one row per pivot
            visits = _visit_cells(pivots, radius, math.acos(theta))
            counts = homes.mapInArrow(visits(False), "cell int, n_home bigint, n_all bigint").groupBy("cell").agg(F.sum("n_home").alias("n_home"), F.sum("n_all").alias("n_all"))
            cost = counts.agg(F.sum("n_all").alias("rows"), F.sum(F.col("n_home").cast("double") * F.col("n_all")).alias("pairs")).first()
            if cost.rows <= REPEATS * seen.n and cost.pairs <= WORTH * seen.n_home * seen.n:
                entries = homes.mapInArrow(visits(True), "ord bigint, embedding array<float>, cell int, home boolean").withColumn("cell", F.col("cell").cast("bigint"))
        if entries is None:
            entries = items.select("ord", "embedding", F.lit(0).cast("bigint").alias("cell"), "home")
        return cls(_split_cells(cut_lineage(entries), theta, limit, seen.n), theta, rows_per_block, most_rows=max(rows_per_block, BLOCK_BYTES // (8 * dim)))

    def match(self, probe: DataFrame, index: DataFrame, best: bool = False) -> DataFrame:
        index = index.filter("home")

        def parts(n: str, other: str):
            """Parts of a side of ``n`` rows: in proportion to the sides, which repeats the fewest rows for a number of blocks."""
            even = F.least(F.ceil(F.sqrt(BLOCKS * F.col(n) / F.col(other))), F.ceil(F.col(n) / self.rows_per_block), F.lit(BLOCKS))
            return F.greatest(even, F.ceil(F.col(n) / self.most_rows)).cast("int")

        def counted_in(df: DataFrame, name: str) -> DataFrame:
            return df.groupBy("cell").agg(F.count(F.lit(1)).alias(name))

        # One row per cell, and the number of cells is bounded by construction.
        sizes = counted_in(probe, "n_i").join(counted_in(index, "n_j"), "cell").select("cell", parts("n_i", "n_j").alias("salts"), parts("n_j", "n_i").alias("chunks"))

        def own(n: str):
            return F.pmod(F.xxhash64("ord"), F.col(n)).cast("int")

        def every(n: str):
            return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

        def placed(df: DataFrame, probes: bool, salt, chunk) -> DataFrame:
            return df.join(F.broadcast(sizes), "cell").select("ord", "embedding", F.lit(probes).alias("probes"), "cell", salt.alias("salt"), chunk.alias("chunk"))

        sides = placed(probe, True, own("salts"), every("chunks")).unionByName(placed(index, False, every("salts"), own("chunks")))
        found = sides.groupBy("cell", "salt", "chunk").applyInArrow(_block_product(self.theta, best), "i bigint, j bigint, sim double")
        return best_match(found) if best else found


def _split_cells(entries: DataFrame, theta: float, limit: int, n_items: int, levels: int = LEVELS) -> DataFrame:
    """The entries with every cell of more than ``limit`` home rows split by up to ``FAN`` of its own rows as pivots, as long as that
    leaves at most ``WORTH`` of the cell's comparisons and the entries stay below ``REPEATS`` times the items. A cell of copies, or one that the angles rule nothing out of, stays whole; its
    products go in blocks of bounded size as any cell's.

    The child ``k`` of cell ``c`` is numbered ``(c + 1) * 4096 + k``.
    """
    tau = math.acos(theta)
    closed = None  # cells that have been tried
    for _ in range(levels):
        sizes = entries.groupBy("cell").agg(F.count_if("home").alias("n_home"), F.count(F.lit(1)).alias("n_all"))
        large = sizes.where(F.col("n_home") > limit)
        if closed is not None:
            large = large.join(closed, "cell", "left_anti")
        large = cut_lineage(large.withColumn("salts", F.ceil(F.col("n_all") / limit).cast("int")))
        if large.isEmpty():
            return entries
        own = cut_lineage(entries.join(large.select("cell", "salts"), "cell").withColumn("salt", F.pmod(F.xxhash64("ord"), F.col("salts")).cast("int")))
        # Pivots: the first rows by a hash, of the slices of a cell and then of the cell, so no task sorts a cell.
        ranked = own.where("home").select("cell", "ord", "salt", F.xxhash64("ord", F.lit("pivot")).alias("_h"))
        for group in (["cell", "salt"], ["cell"]):
            ranked = ranked.withColumn("sub", F.row_number().over(Window.partitionBy(*group).orderBy("_h", "ord")) - 1).where(F.col("sub") < FAN)
        pivots = cut_lineage(ranked.select("cell", "ord", "sub").join(own.where("home").select("cell", "ord", "embedding"), ["cell", "ord"]).drop("ord"))
        everywhere = F.explode(F.sequence(F.lit(0), F.col("salts") - 1))

        def met(rows: DataFrame, given: DataFrame, work, schema: str) -> DataFrame:
            """``work`` over the salted rows of each cell, beside what is given for the cell."""
            right = given.join(large.select("cell", "salts"), "cell").select(F.col("cell").alias("of"), *[c for c in given.columns if c != "cell"], everywhere.alias("part"))
            left = rows.select(*[F.col(c).alias(c) for c in ("ord", "embedding", "cell", "home", "salt")])
            return left.groupBy("cell", "salt").cogroup(right.groupBy("of", "part")).applyInArrow(work, schema)

        reach = met(own.where("home"), pivots, _sub_radius(), "cell bigint, sub int, radius double").groupBy("cell", "sub").agg(F.max("radius").alias("radius"))
        known = cut_lineage(pivots.join(reach, ["cell", "sub"], "left"))
        counted = met(own, known, _sub_visits(tau, False), "cell bigint, sub int, n_home bigint, n_all bigint")
        after = counted.groupBy("cell", "sub").agg(F.sum("n_home").alias("n_home"), F.sum("n_all").alias("n_all"))
        cost = after.groupBy("cell").agg(F.sum(F.col("n_home").cast("double") * F.col("n_all")).alias("after"), F.sum("n_all").alias("visits"))
        worth = F.col("after") <= WORTH * F.col("n_home").cast("double") * F.col("n_all")
        judged = cut_lineage(large.join(cost, "cell").withColumn("worth", worth).select("cell", "worth", "n_all", "visits"))
        n, added = entries.count(), judged.where("worth").agg(F.sum(F.col("visits") - F.col("n_all"))).first()[0] or 0
        if n + added > REPEATS * n_items:  # too much for all: each cell may grow as much as the whole
            judged = judged.withColumn("worth", F.col("worth") & (F.col("visits") <= REPEATS * n_items / n * F.col("n_all")))
        kept = judged.where("NOT worth").select("cell")
        closed = kept if closed is None else cut_lineage(closed.union(kept))
        chosen = judged.where("worth").select("cell")
        if chosen.isEmpty():
            return entries
        children = met(own.join(chosen, "cell", "left_semi"), known.join(chosen, "cell", "left_semi"), _sub_visits(tau, True), "ord bigint, embedding array<float>, cell bigint, home boolean")
        entries = cut_lineage(entries.join(chosen, "cell", "left_anti").select("ord", "embedding", "cell", "home").unionByName(children))
    return entries


# Worker functions are closures so that executors need no installed copy of this package.


def _angles():
    """A function for the angles between the rows of two Arrow columns of vectors."""

    def angles(rows, pivots):
        import numpy as np

        def unit(column, n):
            x = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)
            norm = np.linalg.norm(x, axis=1, keepdims=True)
            return x / np.where(norm == 0, 1.0, norm)

        return np.arccos(np.clip(unit(rows.column("embedding"), rows.num_rows) @ unit(pivots.column("embedding"), pivots.num_rows).T, -1.0, 1.0))

    return angles


def _sub_radius():
    """Per pivot of a cell, the greatest angle to a home row that is nearest to it."""
    angles = _angles()

    def run(rows, pivots):
        import numpy as np
        import pyarrow as pa

        if not rows.num_rows or not pivots.num_rows:
            return pa.table({"cell": pa.array([], pa.int64()), "sub": pa.array([], pa.int32()), "radius": pa.array([], pa.float64())})
        pivots = pivots.sort_by("sub")
        a = angles(rows, pivots)
        near = a.argmin(axis=1)
        radius = np.full(pivots.num_rows, -10.0)
        np.maximum.at(radius, near, a[np.arange(len(near)), near])
        kept = np.flatnonzero(radius > -10.0)
        cell = rows.column("cell")[0].as_py()
        return pa.table({"cell": pa.array([cell] * len(kept), pa.int64()), "sub": pivots.column("sub").take(pa.array(kept)).cast(pa.int32()), "radius": pa.array(radius[kept])})

    return run


def _sub_visits(tau: float, rows_out: bool):
    """The children that the rows of a cell visit: the rows themselves, or how many there are."""
    angles = _angles()

    def run(rows, pivots):
        import numpy as np
        import pyarrow as pa

        if not rows.num_rows or not pivots.num_rows:
            empty = {"ord": pa.int64(), "embedding": pa.list_(pa.float32()), "cell": pa.int64(), "home": pa.bool_()} if rows_out else {"cell": pa.int64(), "sub": pa.int32(), "n_home": pa.int64(), "n_all": pa.int64()}
            return pa.schema(empty).empty_table()
        pivots = pivots.sort_by("sub")
        a = angles(rows, pivots)
        reach = np.array([-10.0 if r is None else r for r in pivots.column("radius").to_pylist()]) + tau + 1e-6
        # A partner at home in a child is nearest to that child's pivot and within its radius.
        visit = (a <= reach) & (a <= a.min(axis=1, keepdims=True) + 2 * tau + 1e-6)
        home = rows.column("home").to_numpy(zero_copy_only=False).astype(bool)
        near = a.argmin(axis=1)
        visit[np.flatnonzero(home), near[home]] = True
        own = np.zeros_like(visit)
        own[np.flatnonzero(home), near[home]] = True
        cell = rows.column("cell")[0].as_py()
        sub = pivots.column("sub").to_numpy()
        if not rows_out:
            return pa.table({"cell": pa.array([cell] * len(sub), pa.int64()), "sub": pa.array(sub.astype(np.int32)), "n_home": pa.array(own.sum(axis=0, dtype=np.int64)), "n_all": pa.array(visit.sum(axis=0, dtype=np.int64))})
        at, to = np.nonzero(visit)
        take = pa.array(at)
        return pa.table({
            "ord": rows.column("ord").take(take), "embedding": rows.column("embedding").take(take),
            "cell": pa.array((cell + 1) * 4096 + sub[to].astype(np.int64)), "home": pa.array(own[at, to]),
        })

    return run


def _angles_to(pivots: list):
    """A function for the angles between the rows of an Arrow batch, so many at a time, and the pivots: slices and their angles."""

    def angles(batches, rows=256):
        import numpy as np

        p = np.asarray(pivots, dtype=np.float64)
        norm = np.linalg.norm(p, axis=1, keepdims=True)
        p /= np.where(norm == 0, 1.0, norm)
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                b = batch.slice(at, rows)
                x = b.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1)
                norm = np.linalg.norm(x, axis=1, keepdims=True)
                yield b, np.arccos(np.clip((x / np.where(norm == 0, 1.0, norm)) @ p.T, -1.0, 1.0))

    return angles


def _assign_home(pivots: list):
    angles = _angles_to(pivots)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b, angle in angles(batches):
            cell = angle.argmin(axis=1)
            yield pa.RecordBatch.from_arrays(
                [b.column("ord"), b.column("embedding"), b.column("home"), pa.array(cell, pa.int32()), pa.array(angle[np.arange(len(cell)), cell])],
                names=["ord", "embedding", "home", "cell", "angle"],
            )

    return run


def _visit_cells(pivots: list, radius: dict, tau: float):
    """The cells that rows visit, for ``rows_out``: the rows themselves, or how many there are."""
    angles = _angles_to(pivots)

    def work(rows_out: bool):
        def run(batches):
            import numpy as np
            import pyarrow as pa

            cells = range(len(pivots))
            reach = np.array([radius.get(c, -10.0) for c in cells]) + tau + 1e-6
            n_home, n_all = (np.zeros(len(cells), np.int64) for _ in range(2))
            for b, angle in angles(batches):
                nearest, at_home = b.column("cell").to_numpy(), b.column("home").to_numpy(zero_copy_only=False).astype(bool)
                # A partner at home in c is within radius_c of its pivot, and nearer to it than to ours.
                visit = (angle <= reach) & (angle <= angle.min(axis=1, keepdims=True) + 2 * tau + 1e-6)
                visit[np.flatnonzero(at_home), nearest[at_home]] = True
                if not rows_out:
                    n_all += visit.sum(axis=0)
                    n_home += np.bincount(nearest[at_home], minlength=len(cells))
                    continue
                row, cell = np.nonzero(visit)
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [b.column("ord").take(take), b.column("embedding").take(take), pa.array(cell, pa.int32()), pa.array((cell == nearest[row]) & at_home[row])],
                    names=["ord", "embedding", "cell", "home"],
                )
            if not rows_out:
                yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int32()), pa.array(n_home), pa.array(n_all)], names=["cell", "n_home", "n_all"])

        return run

    return work


def _block_product(theta: float, best: bool, rows: int = 1024, columns: int = 2048):
    """Similar pairs of one block, in tiles of ``rows`` probes and ``columns`` partners: what is held beside the block does not grow with it."""
    from collections.abc import Iterator

    import pyarrow as pa

    def run(batches):
        import numpy as np
        import pyarrow as pa

        sides = {True: ([], []), False: ([], [])}
        for b in batches:
            if not b.num_rows:
                continue
            probes = b.column("probes").to_numpy(zero_copy_only=False).astype(bool)
            ords = b.column("ord").to_numpy()
            x = b.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            for side, (places, vectors) in sides.items():
                if (probes == side).any():
                    places.append(ords[probes == side])
                    vectors.append(x[probes == side])

        def unit(places, vectors):
            order = np.argsort(np.concatenate(places), kind="stable")
            x = np.concatenate(vectors)[order].astype(np.float64)
            norm = np.linalg.norm(x, axis=1, keepdims=True)
            x /= np.where(norm == 0, 1.0, norm)
            return np.concatenate(places)[order], x

        def table(i, j, sim):
            return pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(j, pa.int64()), pa.array(sim, pa.float64())], names=["i", "j", "sim"])

        if not sides[True][0] or not sides[False][0]:
            return
        (i, x), (j, y) = unit(*sides.pop(True)), unit(*sides.pop(False))
        for a in range(0, len(i), rows):
            own, some = i[a : a + rows], x[a : a + rows]
            top, at = np.full(len(own), -np.inf), np.zeros(len(own), np.int64)
            for c in range(0, len(j), columns):
                others = j[c : c + columns]
                if others[0] >= own[-1]:
                    break  # both sides are in order: no earlier partners from here on
                sim = some @ y[c : c + columns].T
                hit = sim >= theta
                if others[-1] >= own[0]:
                    hit &= others[None, :] < own[:, None]
                if not best:
                    row, col = np.nonzero(hit)
                    if len(row):
                        yield table(own[row], others[col], sim[row, col])
                    continue
                sim[~hit] = -np.inf
                col = sim.argmax(axis=1)
                value = sim[np.arange(len(own)), col]
                better = value > top  # of equal ones the earliest stays
                top[better], at[better] = value[better], others[col[better]]
            if best and (top > -np.inf).any():
                yield table(own[top > -np.inf], at[top > -np.inf], top[top > -np.inf])

    run.__annotations__ = {"batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    return run


CODES_FIRST = 1 << 62


def matches_between(kind, probe: DataFrame, codes: DataFrame, theta: float, best: bool = False) -> DataFrame:
    """Match ``probe`` items with ``codes``, two tables with an ``ord`` of their own: ``i, j, sim``."""
    shifted = codes.withColumn("ord", F.col("ord") - F.lit(CODES_FIRST))
    feature = "label" if kind is GramSpace else "embedding"
    home = [] if kind is GramSpace else [F.lit(False).alias("home")]  # only codes are looked for
    space = kind.build(probe.select("ord", feature, *home).union(shifted.select("ord", feature, *[~h for h in home])), theta)
    is_code = F.col("ord") < F.lit(-(CODES_FIRST >> 1))
    found = space.match(space.entries.filter(~is_code), space.entries.filter(is_code), best)
    found = found if best else found.dropDuplicates(["i", "j"])
    return found.select("i", (F.col("j") + F.lit(CODES_FIRST)).alias("j"), "sim")


def best_match(found: DataFrame) -> DataFrame:
    """The most similar partner per item; ties go to the earliest."""
    picked = found.groupBy("i").agg(F.max(F.struct(F.col("sim"), (-F.col("j")).alias("back"))).alias("_b"))
    return picked.select("i", (-F.col("_b.back")).alias("j"), F.col("_b.sim").alias("sim"))
