import random
import re
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from codeloom.llm import simhash
from codeloom.llm.components import components


def plain_components(edges, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in edges:
        parent[find(u)] = find(v)
    out = {}
    for n in nodes:
        out.setdefault(find(n), []).append(n)
    return sorted(sorted(g) for g in out.values())


def grouped(rows, nodes):
    root = {n: n for n in nodes} | {r.node: r.root for r in rows}
    out = {}
    for n in nodes:
        out.setdefault(root[n], []).append(n)
    assert all(k == min(g) for k, g in out.items())
    return sorted(sorted(g) for g in out.values())


def test_components_of_a_path_a_star_and_random_pairs(spark):
    r = random.Random(3)
    edges = [(k, k + 1) for k in range(50)] + [(1000, 1000 + k) for k in range(1, 40)] + [(r.randint(2000, 2100), r.randint(2000, 2100)) for _ in range(60)] + [(5, 5), (7, 6)]
    nodes = sorted({x for e in edges for x in e})
    rows = components(spark.createDataFrame([*edges, (None, 4), (4, None)], "u long, v long")).collect()
    assert grouped(rows, nodes) == plain_components(edges, nodes)


def test_no_pairs(spark):
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []


def plain_fingerprint(text):
    words = "".join(c.lower() if c.isascii() else c for c in text)
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", words) if w]
    shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints(odd_docs):
    for t in ["", " \n", "One", "a b c", "a b c d", "É É x y Z\x0bw v u t", "w " * 500, "\x1cA b\x85c d e"]:
        assert simhash.fingerprint(t.encode()) == plain_fingerprint(t)


def test_fingerprints_agree_with_the_hash_of_the_engine(spark):
    row = spark.range(1).select(F.xxhash64(F.lit("just four words here")).alias("h")).first()
    assert simhash._signed(simhash.fingerprint(b"just four words here")) == row.h


@pytest.mark.parametrize("distance", [2, 4])
def test_plan_covers_every_pair(spark, distance):
    r = np.random.default_rng(1)
    base = r.integers(0, 2**63, 200)
    plan = simhash.make_plan(spark.createDataFrame([(int(x),) for x in base], "fp long"), distance)
    assert all(t >= 0 for _, t in plan)
    masks = [(sum(1 << b for b in bits), t) for bits, t in plan]
    flips = [sum(1 << int(b) for b in r.choice(64, distance, replace=False)) for _ in range(3000)]
    assert all(any((flip & mask).bit_count() <= t for mask, t in masks) for flip in flips)


def test_allocation_is_the_cheapest():
    r = random.Random(2)
    for _ in range(50):
        costs = [[0.0, *sorted(r.uniform(0, 9) for _ in range(5))] for _ in range(3)]
        cost, chosen = simhash.allocate(costs, 2)
        options = [(sum(c[t + 1] for c, t in zip(costs, ts)), ts) for ts in ((a, b, 2 - a - b) for a in range(-1, 5) for b in range(-1, 5)) if -1 <= ts[2] <= 4]
        assert cost == pytest.approx(min(o[0] for o in options)) and sum(chosen) == 2


@pytest.mark.parametrize("hot", [3, simhash.HOT])
def test_links_give_the_components_of_all_near_pairs(spark, hot):
    r = np.random.default_rng(4)
    prints = {int(x) for x in r.integers(-(2**63), 2**63, 40)}
    for centre in list(prints)[:3]:
        chain = centre
        for _ in range(25):
            for b in r.choice(64, r.integers(1, 6), replace=False):
                chain ^= 1 << int(b)
            prints.add(simhash._signed(chain & (2**64 - 1)))
    near = [(a, b) for a, b in combinations(sorted(prints), 2) if ((a ^ b) & (2**64 - 1)).bit_count() <= 4]
    df = spark.createDataFrame([(x,) for x in prints], "fp long")
    found = simhash.links(df, 4, hot)
    assert grouped(components(found).collect(), prints) == plain_components(near, prints)


def test_odd_rows(odd_docs, no_docs):
    rows = simhash.near_duplicates(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, set()).add((r.fp, r.component_id))
    assert by[1] == by[2] and {c for _, c in by[1]} == {1}
    assert by[3] == by[4] == by[5] == {(0, 3)} and {c for _, c in by[None]} >= {3}
    assert simhash.near_duplicates(no_docs).collect() == []


def test_one_row_of_each_group_stays(spark, odd_docs, no_docs):
    kept = simhash.first_of_each(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(1) == 1 and 2 not in ids and ids.count(3) == 1 and 4 not in ids and {6, 7, 8} <= set(ids)
    assert simhash.first_of_each(no_docs).collect() == []
    nameless = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (None, "z")], "doc_id long, text string")
    assert sorted(r.text for r in simhash.first_of_each(nameless).collect()) == ["a b c d e f", "z"]
