"""SimHash near-duplicates: fingerprints that differ in few bits, found by the general pigeonhole principle.

The 64 bits are cut into m partitions of correlated bits with thresholds t_i that sum to ``distance - m + 1``. Two
fingerprints within ``distance`` differ in at most t_i bits in some partition i (-1: the partition is not needed). m and the thresholds come from
dynamic programming on estimated candidate counts. Each distinct fingerprint looks up all values within t_i of its own in partition i;
candidates are verified on all bits. Exact copies are merged first, so a group of copies is one fingerprint.

A partition value shared by more than ``HOT`` fingerprints is not paired out: its fingerprints are linked through the
values within ``distance / 2`` bits of them. Two fingerprints are within ``distance`` if and only if they share
such a value, so no link is lost and the work stays proportional to the number of fingerprints.

Edge cases: null and empty texts and those of white space have fingerprint zero and are linked like any other; a text of fewer than
``shingle`` words is one shingle; null ids take part but are nobody's smallest id (a component of null ids alone has a null id);
repeated rows are copies; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import fresh, small_batches, text_bytes
from codeloom.llm.components import components
from codeloom.session import cut_lineage

BITS = 64
SHINGLE = 4
DISTANCE = 4
SEED = 42
HOT = 2_000
SHINGLES_AT_ONCE = 1 << 16
# Relative costs for the plan: shuffling a probe against comparing a candidate pair.
PROBE_COST, PAIR_COST = 4.0, 1.0


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The fingerprint of a UTF-8 text, as an unsigned number."""
    words = text.lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    starts = [0]
    for w in words:
        starts.append(starts[-1] + len(w) + 1)
    n = max(1, len(words) - shingle + 1)
    ends = starts[min(shingle, len(words)) :]
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(BITS, dtype=np.int64)
    for at in range(0, n, SHINGLES_AT_ONCE):
        some = [digest(joined[a : b - 1], seed) for a, b in zip(starts[at : min(n, at + SHINGLES_AT_ONCE)], ends[at : at + SHINGLES_AT_ONCE])]
        counts += np.unpackbits(np.array(some, dtype=">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def with_fingerprints(docs: DataFrame, name: str = "fp", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` (all columns if none) and the fingerprint as a signed 64-bit number."""
    rows = docs if keep is None else docs.select(*keep, text_col)
    at = rows.columns.index(text_col) if keep is None else len(keep)
    names = rows.columns if keep is None else keep

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            marks = pa.array([_signed(fingerprint(t)) for t in text_bytes(b.column(at))], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], marks], names=[*names, name])

    schema = ", ".join(f"`{n}` {rows.schema[n].dataType.simpleString()}" for n in names)
    return rows.mapInArrow(add, f"{schema}, `{name}` bigint")


def hex_of(fp) -> F.Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


# The plan ---------------------------------------------------------------------------------------------------


def bit_correlation(prints: DataFrame) -> np.ndarray:
    """Absolute correlation of the bits over all fingerprints; 64 x 64 counts per task are all that moves."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((BITS, BITS), dtype=np.int64), 0
        for b in batches:
            x = np.unpackbits(b.column(0).to_numpy().astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total, n = total + (x.T @ x).astype(np.int64), n + len(x)
        yield pa.RecordBatch.from_arrays([pa.array(range(BITS * BITS + 1), pa.int32()), pa.array([*total.ravel().tolist(), n])], names=["k", "n"])

    rows = prints.select("fp").mapInArrow(count, "k int, n bigint").groupBy("k").agg(F.sum("n").alias("n")).collect()  # 4,097 rows
    flat = np.zeros(BITS * BITS + 1)
    for r in rows:
        flat[r.k] = r.n
    n, both = max(flat[-1], 1.0), flat[:-1].reshape(BITS, BITS)
    p = np.diag(both) / n
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    return np.abs((both / n - np.outer(p, p)) / np.outer(spread, spread))


def grouped_bits(correlation: np.ndarray, m: int) -> list[list[int]]:
    """m partitions of nearly equal size: each starts with the lowest free bit and takes the free bits most correlated with it."""
    free, out = list(range(BITS)), []
    for k in range(m):
        own = [free.pop(0)]
        while len(own) < BITS // m + (k < BITS % m):
            best = max(free, key=lambda b: (correlation[b, own].mean(), -b))
            free.remove(best)
            own.append(best)
        out.append(sorted(own))
    return out


def ball(bits: list[int], radius: int) -> list[int]:
    """Masks of all flips of at most ``radius`` of ``bits``; none for a negative radius."""
    return [sum(1 << b for b in some) for r in range(radius + 1) for some in combinations(bits, r)]


def allocate(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds (from -1 on) that sum to ``total`` at least cost; ``costs[i][t + 1]`` is partition i's at threshold t."""
    best = {0: (0.0, [])}
    for options in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for spent, (cost, chosen) in best.items():
            for t, more in enumerate(options, -1):
                at = (cost + more, [*chosen, t])
                if spent + t not in step or at < step[spent + t]:
                    step[spent + t] = at
        best = step
    return best[total]


def make_plan(prints: DataFrame, distance: int = DISTANCE) -> list[tuple[list[int], int]]:
    """``(bits, threshold)`` of the partitions. The estimates take the counts of equal partition values over all fingerprints.

    Pairs within t bits are estimated as the equal pairs times the number of values within t bits.
    """
    correlation = bit_correlation(prints)
    layouts = {m: grouped_bits(correlation, m) for m in range(1, distance + 2)}
    parts = [(m, i, bits) for m, layout in layouts.items() for i, bits in enumerate(layout) if m > 1]
    masks = F.array(*[F.struct(F.lit(m * 100 + i).alias("part"), F.lit(_signed(sum(1 << b for b in bits))).alias("mask")) for m, i, bits in parts])
    values = prints.select(F.explode(masks).alias("p"), "fp").groupBy(F.col("p.part").alias("part"), F.col("fp").bitwiseAND(F.col("p.mask")).alias("value")).count()
    sums = {r.part: (r.pairs, r.n) for r in values.groupBy("part").agg(F.sum(F.expr("count * (count - 1) / 2")).alias("pairs"), F.sum("count").alias("n")).collect()}
    plans = []
    for m, layout in layouts.items():
        if m == 1:
            continue
        costs = []
        for i, bits in enumerate(layout):
            pairs, n = sums.get(m * 100 + i, (0.0, 1))  # without a fingerprint the plan with the fewest probes
            sizes = [sum(comb(len(bits), r) for r in range(t + 1)) for t in range(-1, distance + 1)]
            costs.append([PROBE_COST * n * s + PAIR_COST * pairs * s for s in sizes])
        cost, thresholds = allocate(costs, distance - m + 1)
        plans.append((cost, m, list(zip(layout, thresholds))))
    return [(bits, t) for bits, t in min(plans, key=lambda p: p[:2])[2] if t >= 0]


# Links ------------------------------------------------------------------------------------------------------


def _flipped(prints: DataFrame, plan: list[tuple[list[int], int]], probing: bool) -> DataFrame:
    """``fp, part, value``: the partition values of each fingerprint, or all those within the thresholds."""
    made = [(i, sum(1 << b for b in bits), flip) for i, (bits, t) in enumerate(plan) for flip in ball(bits, t if probing else 0)]
    part, mask, flip = (F.split(F.lit(",".join(str(_signed(x)) for x in column)), ",").cast("array<bigint>") for column in zip(*made))  # folded to constants
    each = prints.select("fp", F.explode(F.arrays_zip(part.alias("part"), mask.alias("mask"), flip.alias("flip"))).alias("k"))
    return each.select("fp", F.col("k.part").cast("int").alias("part"), F.col("fp").bitwiseAND(F.col("k.mask")).bitwiseXOR(F.col("k.flip")).alias("value"))


def _stars(prints: DataFrame, distance: int) -> DataFrame:
    """Links through the values within ``distance / 2`` bits: each fingerprint with the least that shares one."""
    masks = ",".join(str(_signed(x)) for x in ball(list(range(BITS)), distance // 2))
    flips = F.split(F.lit(masks), ",").cast("array<bigint>")  # folded to one constant
    near = prints.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("value"))
    least = near.groupBy("value").agg(F.min("fp").alias("v"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return near.join(least, "value").where("fp <> v").select(F.col("fp").alias("u"), "v")


def links(prints: DataFrame, distance: int = DISTANCE, hot: int = HOT) -> DataFrame:
    """``u, v``: pairs whose components are those of all pairs of fingerprints within ``distance`` (an even number)."""
    if distance % 2:
        raise ValueError("distance must be even")
    plan = make_plan(prints, distance)
    index, probes = _flipped(prints, plan, False), _flipped(prints, plan, True)
    crowded = cut_lineage(index.groupBy("part", "value").count().where(F.col("count") > hot).select("part", "value"))
    star = None
    if not crowded.isEmpty():
        members = cut_lineage(probes.join(crowded, ["part", "value"], "left_semi").select("fp").distinct())
        star = _stars(members, distance)
        index = index.join(crowded, ["part", "value"], "left_anti")
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= distance
    met = probes.join(index.withColumnRenamed("fp", "other"), ["part", "value"]).where((F.col("fp") < F.col("other")) & near)
    found = met.select(F.col("other").alias("u"), F.col("fp").alias("v"))
    return found if star is None else found.unionByName(star)


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``<id_col>, fp, component_id``: every document with its fingerprint and the smallest id linked to it."""
    signed = cut_lineage(with_fingerprints(docs, "fp", text_col, [id_col]))
    return signed.join(classes(signed, distance, id_col), "fp").select(id_col, "fp", "component_id")


def classes(signed: DataFrame, distance: int = DISTANCE, id_col: str = "doc_id") -> DataFrame:
    """``fp, root, component_id``: one row per distinct fingerprint; ``root`` is a fingerprint of its component."""
    prints = cut_lineage(signed.groupBy("fp").agg(F.min(id_col).alias("least")))
    linked = components(links(prints.select("fp"), distance))
    rooted = cut_lineage(prints.join(linked, prints.fp == linked.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rooted.join(named, "root").select("fp", "root", "component_id")


def first_of_each(docs: DataFrame, distance: int = DISTANCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows and columns of ``docs``, one document of each component: that with the smallest id (null last, then the
    smallest fingerprint). Rows with equal id and fingerprint are one document."""
    mark, lead_id, lead_fp = (fresh(name, *docs.columns) for name in ("_fingerprint", "_lead_id", "_lead_fp"))
    signed = cut_lineage(with_fingerprints(docs.select(id_col, text_col), "fp", text_col, [id_col]).distinct())
    ranked = signed.join(classes(signed, distance, id_col), "fp").withColumn("at", F.struct(F.col(id_col).isNull(), F.col(id_col), F.col("fp")))
    leaders = ranked.groupBy("root").agg(F.min("at").alias("at")).select(F.col(f"at.{id_col}").alias(lead_id), F.col("at.fp").alias(lead_fp))
    marked = with_fingerprints(docs, mark, text_col)
    on = (F.col(mark) == F.col(lead_fp)) & F.col(id_col).eqNullSafe(F.col(lead_id))
    return marked.join(leaders, on, "left_semi").dropDuplicates([mark, id_col]).select(*docs.columns)
