"""Greedy merge against the one-by-one loop it stands for."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from codeloom.functions import text as T
from codeloom.operators import codebook as cb
from codeloom.operators import leaders as ld
from codeloom.operators.similarity import GramSpace, VectorSpace, matches_between


def one_by_one(vectors, theta, forced=0):
    """Literal sequential loop: index of the code each vector goes to."""
    x = np.asarray(vectors, dtype=float)
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    x = x / np.where(norm == 0, 1, norm)
    lead, to = [], []
    for i in range(len(x)):
        sims = x[lead] @ x[i] if lead else np.zeros(0)
        if i >= forced and len(lead) and sims.max() >= theta:
            to.append(lead[int(sims.argmax())])
        else:
            lead.append(i)
            to.append(i)
    return to


def gram_vectors(labels):
    grams = [Counter(w[i : i + 3] for i in range(len(w) - 2)) or Counter([w]) for w in labels]
    index = {g: n for n, g in enumerate(sorted({g for c in grams for g in c}))}
    out = np.zeros((len(labels), len(index)))
    for row, c in enumerate(grams):
        for g, n in c.items():
            out[row, index[g]] = n
    return out


def clustered(n, dim, centers, noise, seed=1):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centers, dim))
    return (middle[rng.integers(0, centers, n)] + noise * rng.normal(size=(n, dim))).astype(np.float32)


def vector_leaders(spark, x, theta, parts=3, **space_args):
    items = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "ord long, embedding array<float>").repartition(parts)
    space = VectorSpace.build(items, theta, **space_args)
    return space, sorted(r[0] for r in ld.greedy_leaders(space, space.entries).collect())


@pytest.mark.parametrize("heads, rows", [(1024, 1024), (1024, 40), (4, 50)])
def test_leaders_equal_sequential(spark, monkeypatch, heads, rows):
    """Also where several cells and very few heads per cell are forced."""
    monkeypatch.setattr(VectorSpace, "first_heads", heads)
    x = clustered(200, 8, 25, 0.4)
    to = one_by_one(x, 0.9)
    expected = [i for i, t in enumerate(to) if t == i]
    init = VectorSpace.build.__func__

    def build(cls, items, theta, **kw):
        space = init(cls, items, theta, rows_per_block=rows)
        space.first_heads = heads
        return space

    monkeypatch.setattr(VectorSpace, "build", classmethod(build))
    _, got = vector_leaders(spark, x, 0.9)
    assert got == expected


def test_hot_cluster_needs_no_square_of_pairs(spark):
    """A third of the items are near-copies: comparisons stay near one per member."""
    rng = np.random.default_rng(3)
    copies = np.ones((300, 6)) + 0.01 * rng.normal(size=(300, 6))
    others = rng.normal(size=(600, 6))
    x = np.concatenate([copies, others]).astype(np.float32)[rng.permutation(900)]
    items = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "ord long, embedding array<float>")
    space = VectorSpace.build(items, 0.98)
    space.first_heads = 8
    got = sorted(r[0] for r in ld.greedy_leaders(space, space.entries).collect())
    to = one_by_one(x, 0.98)
    assert got == [i for i, t in enumerate(to) if t == i]


def test_pairs_of_many_cells_are_exact(spark):
    x = clustered(300, 5, 12, 0.3, seed=5)
    items = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "ord long, embedding array<float>")
    space = VectorSpace.build(items, 0.95, rows_per_block=20)
    assert space.entries.select("cell").distinct().count() > 5
    got = {(r.i, r.j) for r in space.match(space.entries, space.entries).collect()}
    y = x.astype(float)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    s = y @ y.T
    assert got == {(i, j) for i in range(300) for j in range(i) if s[i, j] >= 0.95}


@pytest.mark.parametrize("theta", [0.4, 0.65, 0.9])
def test_gram_pairs_are_exact(spark, monkeypatch, theta):
    import codeloom.operators.similarity as sim

    monkeypatch.setattr(sim, "ROWS_PER_SALT", 5)  # many salts
    monkeypatch.setattr(sim, "FREQUENT_GRAMS", 4)
    labels = sorted({f"{a}{b}{c}ing" for a in ("", "re", "un", "pre") for b in ("walk", "talk", "wander", "work", "banana") for c in ("", "s", "er")} | {"ab", "ananananan"})
    items = spark.createDataFrame(list(enumerate(labels)), "ord long, label string")
    space = GramSpace.build(items, theta)
    got = {(r.i, r.j) for r in space.match(space.entries, space.entries).collect()}
    v = gram_vectors(labels)
    s = (v @ v.T) / np.sqrt(np.outer((v * v).sum(1), (v * v).sum(1)))
    assert got == {(i, j) for i in range(len(labels)) for j in range(i) if s[i, j] >= theta}


def test_matches_between_takes_earliest_on_ties(spark):
    probe = spark.createDataFrame([(0, [1.0, 0.0])], "ord long, embedding array<float>")
    codes = spark.createDataFrame([(5, [2.0, 0.0]), (3, [3.0, 0.0]), (9, [0.0, 1.0])], "ord long, embedding array<float>")
    got = matches_between(VectorSpace, probe, codes, 0.5, best=True).collect()
    assert [(r.i, r.j, round(r.sim, 6)) for r in got] == [(0, 3, 1.0)]


WORDS = [f"{a}{b}ing" for a in ("walk", "talk", "stalk", "work", "wander", "ponder") for b in ("", "er", "erer", "s")]


def book_of(spark, labels, counts=None):
    rows = [(f"id_{w}", w, None, None, (counts or {}).get(w, 1), n) for n, w in enumerate(labels)]
    return spark.createDataFrame(rows, cb.SCHEMA)


def test_merge_with_prior_codebook(spark):
    prior = ["talkering", "walking", "talking"]  # similar to each other, and kept all the same
    labels = [(w, 2) for w in WORDS] + [("  walking ", 1), ("", 1), (None, 1)]
    df = spark.createDataFrame(labels, "label string, n long")
    merged = cb.merge_labels(df, book_of(spark, prior, {"walking": None}), 0.6)
    fresh = sorted(set(WORDS) - set(prior))
    order = prior + fresh
    to = one_by_one(gram_vectors(order), 0.6, forced=len(prior))
    ids = {w: f"id_{w}" for w in prior}
    created = {w: r for w, r in zip(fresh, spark.createDataFrame([(w,) for w in fresh], "w string").select(T.code_id(F.col("w"))).toPandas().iloc[:, 0])}
    expected = {order[i]: {**created, **ids}[order[t]] for i, t in enumerate(to) if order[i] in WORDS}
    got = {r.label: r.code_id for r in merged.label_map.collect()}
    assert got == expected
    uses = Counter(expected.values())
    counts = {r.id: r["count"] for r in merged.codebook.collect()}
    for code, n in counts.items():
        assert n == uses.get(code, 0) + (1 if code.startswith("id_") else 0)
    assert {r.label: r.ord for r in merged.codebook.collect() if r.label in prior} == {w: n for n, w in enumerate(prior)}


def test_merge_is_idempotent_and_independent_of_partitions(spark):
    df = spark.createDataFrame([(w, 1) for w in WORDS], "label string, n long")
    first = cb.merge_labels(df.repartition(1), cb.empty_codebook(spark), 0.6)
    other = cb.merge_labels(df.repartition(7), cb.empty_codebook(spark), 0.6)
    as_map = lambda m: {r.label: r.code_id for r in m.label_map.collect()}
    assert as_map(first) == as_map(other)
    leaders = first.codebook.select("label").withColumn("n", F.lit(1).cast("long"))
    again = cb.merge_labels(leaders, first.codebook, 0.6)
    assert {r.match_kind for r in again.label_map.collect()} == {"exact"}
    assert again.codebook.count() == first.codebook.count()


def test_merge_on_vectors_rejects_missing_and_handles_zero(spark):
    rows = [("a", 1, [1.0, 0.0]), ("b", 1, [0.99, 0.01]), ("c", 1, [0.0, 0.0]), ("d", 1, None), ("e", 1, []), ("f", 1, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "label string, n long, embedding array<float>")
    merged = cb.merge_labels(df, cb.empty_codebook(spark), 0.9)
    kinds = {r.label: r.match_kind for r in merged.label_map.collect()}
    assert kinds == {"a": "new", "b": "similar", "c": "new", "f": "new"}
    assert sorted(r.label for r in merged.rejects.collect()) == ["d", "e"]


def test_duplicate_codebook_label_last_wins_and_frequency_order(spark):
    book = spark.createDataFrame([("one", "walking", None, None, 1, 0), ("two", "walking", None, None, 1, 1)], cb.SCHEMA)
    labels = spark.createDataFrame([("walking", 1)], "label string, n long")
    assert cb.exact_matches(labels, book).collect()[0].code_id == "two"
    df = spark.createDataFrame([("talking", 1), ("talkings", 9)], "label string, n long")
    merged = cb.merge_labels(df, cb.empty_codebook(spark), 0.6, by_frequency=True, per_occurrence=True)
    assert [(r.label, r["count"]) for r in merged.codebook.collect()] == [("talkings", 10)]


def test_theta_must_be_positive(spark):
    items = spark.createDataFrame([(0, "abc")], "ord long, label string")
    with pytest.raises(ValueError):
        GramSpace.build(items, 0.0)


def in_cells(space):
    return {r.cell: r.n for r in space.entries.filter("home").groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}


@pytest.mark.parametrize("theta", [0.97, 0.9])
def test_large_cells_are_split_and_lose_no_pair(spark, theta):
    x = clustered(900, 6, 40, 0.15, seed=8)
    items = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "ord long, embedding array<float>").repartition(5)
    space = VectorSpace.build(items, theta, rows_per_block=32, max_cells=2, rows_per_cell=60)
    sizes = in_cells(space)
    assert sum(sizes.values()) == 900 and len(sizes) > 10 and max(sizes) >= 4096 and max(sizes.values()) <= 60
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    sims = unit.astype(float) @ unit.T.astype(float)
    near = {(i, j) for i in range(900) for j in range(i) if sims[i, j] >= theta + 1e-6}
    found = {(r.i, r.j) for r in space.match(space.entries, space.entries).select("i", "j").distinct().collect()}
    assert near <= found and all(sims[i, j] >= theta - 1e-6 for i, j in found) and len(near) > 100
    to = one_by_one(x, theta)
    assert sorted(r[0] for r in ld.greedy_leaders(space, space.entries).collect()) == [i for i, t in enumerate(to) if t == i]


def test_what_angles_cannot_part_stays_whole(spark):
    rng = np.random.default_rng(5)
    for x, theta in ((np.ones((200, 4)), 0.9), (rng.normal(size=(200, 4)), 0.05)):
        items = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x.astype(np.float32))], "ord long, embedding array<float>")
        space = VectorSpace.build(items, theta, rows_per_block=300, rows_per_cell=50)
        assert in_cells(space) == {0: 200} and space.entries.count() == 200


def test_entries_are_no_multiple_of_the_items(spark):
    """Where the angles rule nothing out, items are not repeated cell by cell; of two tables, only the codes are looked for."""
    x = np.random.default_rng(11).normal(size=(400, 8)).astype(np.float32)
    items = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "ord long, embedding array<float>")
    space = VectorSpace.build(items, 0.2, rows_per_block=10)
    assert space.entries.count() == 400
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    s = unit @ unit.T
    near = {(i, j) for i in range(400) for j in range(i) if s[i, j] >= 0.2}
    assert {(r.i, r.j) for r in space.match(space.entries, space.entries).collect()} == near
    codes = items.where("ord % 50 = 7")
    best = {r.i: r.j for r in matches_between(VectorSpace, items, codes, 0.2, best=True).collect()}
    at = list(range(7, 400, 50))
    assert best == {i: at[int(s[i, at].argmax())] for i in range(400) if s[i, at].max() >= 0.2}


def test_products_come_in_tiles():
    """A block gives its pairs tile by tile, and of equal partners in several tiles the earliest."""
    import pyarrow as pa

    import codeloom.operators.similarity as sim

    def block(rows):
        cols = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.list_(pa.float32()), pa.bool_()))], names=["ord", "embedding", "probes"])

    rows = [(k, [1.0, 0.0], False) for k in range(9)] + [(k, [1.0, 0.0], True) for k in range(9)]
    batches = [block(rows[k : k + 5]) for k in range(0, 18, 5)]
    pairs = list(sim._block_product(0.9, False, rows=2, columns=3)(iter(batches)))
    assert max(b.num_rows for b in pairs) <= 6
    assert sorted((r["i"], r["j"]) for b in pairs for r in b.to_pylist()) == [(i, j) for i in range(9) for j in range(i)]
    best = [(r["i"], r["j"]) for b in sim._block_product(0.9, True, rows=2, columns=3)(iter(batches)) for r in b.to_pylist()]
    assert sorted(best) == [(i, 0) for i in range(1, 9)]


def test_a_small_side_does_not_repeat_the_large_one(spark, monkeypatch):
    """Rows that reach the products of one cell, of 64 probes and 4,000 partners."""
    from collections.abc import Iterator

    import pyarrow as pa

    import codeloom.operators.similarity as sim

    def count_rows(theta, best):
        def run(batches):
            yield pa.RecordBatch.from_arrays([pa.array([sum(b.num_rows for b in batches)]), pa.array([0]), pa.array([0.0])], names=["i", "j", "sim"])

        run.__annotations__ = {"batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
        return run

    items = spark.range(4000).select(F.col("id").alias("ord"), F.array(F.lit(1.0), F.col("id") % 7).cast("array<float>").alias("embedding"))
    space = VectorSpace.build(items, 0.9, rows_per_block=16, max_cells=1, rows_per_cell=10_000)
    monkeypatch.setattr(sim, "_block_product", count_rows)
    small = space.entries.where("ord < 64")
    for probe, index in ((small, space.entries), (space.entries, small)):
        assert space.match(probe, index).agg(F.sum("i")).first()[0] <= 2 * 4064


def test_heads_of_a_cell_are_ranked_in_slices(spark):
    rows = spark.range(100_000).select(F.col("id").alias("ord"), F.lit("hot").alias("cell"), (F.col("id") % 10 != 3).alias("home"))
    rows = rows.union(spark.createDataFrame([(-5, "cold", True)], "ord long, cell string, home boolean"))
    for k in (3, 2000):
        got = ld.first_of_cells(rows, k).orderBy("cell", "_n").collect()
        expected = [n for n in range(100_000) if n % 10 != 3][:k]
        assert [(r.cell, r.ord, r._n) for r in got] == [("cold", -5, 1), *(("hot", n, at + 1) for at, n in enumerate(expected))]


@pytest.mark.parametrize("rows_per_salt", [3, 7])
def test_hot_grams_are_cut_on_both_sides(spark, rows_per_salt):
    labels = [f"{a}{b}{c}ing" for a in "abcdef" for b in "uvw" for c in "xyz"]
    items = spark.createDataFrame(list(enumerate(labels)), "ord long, label string")
    whole, cut = GramSpace.build(items, 0.5), GramSpace.build(items, 0.5, rows_per_salt)
    pairs = lambda s: sorted((r.i, r.j, round(r.sim, 9)) for r in s.match(s.entries, s.entries).distinct().collect())
    assert pairs(cut) == pairs(whole) and max(r.salts for r in cut.entries.collect()) > 1
