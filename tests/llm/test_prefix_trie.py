import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from codeloom.llm import centroids, prefix_trie

SF = "/root/testdata/sf0.001"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def rebuilt(rows):
    """Conversations as the contract rebuilds them; equal turns of a conversation must be equal rows."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [x[1:] for x in sorted(t)] for c, t in own.items()}
    out = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - c % 20, [])[:h] + t[h:]
    return out


def plain_trie(conversations):
    members, below = {}, {}
    for c, t in conversations.items():
        for d in range(len(t) + 1):
            members.setdefault(tuple(t[:d]), []).append(c)
    for node in members:
        if node:
            below.setdefault(node[:-1], []).append(node)
    out = {}
    for node in sorted(members, key=len, reverse=True):
        kids = below.get(node, [])
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        saved = (len(members[node]) - 1) * words + sum(out[k][6] for k in kids)
        leaves = sum(out[k][5] for k in kids) or 1
        ends = ",".join(map(str, sorted(c for c in members[node] if len(conversations[c]) == len(node))))
        up = min(members[node[:-1]]) if node else None
        out[node] = (min(members[node]), len(node), up, len(members[node]), len(kids), leaves, saved, hashlib.sha256(ends.encode()).hexdigest())
    return sorted(out.values(), key=repr)


def found(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.select(*COLUMNS).collect()), key=repr)


def digest(conversations, limit=centroids.LIMIT):
    rows, convs = prefix_trie.with_shared_heads(prefix_trie.turns(conversations))
    return prefix_trie.digest(prefix_trie.build(rows, convs, limit))


def test_sums_of_a_forest_equal_plain_sums():
    r = random.Random(5)
    for n, reach in [(1, 1), (2, 1), (60, 1), (200, 2), (300, 10), (300, 300), (2000, 40)]:
        parent = [-1] + [r.randrange(max(0, i - reach), i) if r.random() > 0.02 else -1 for i in range(1, n)]
        values = np.array([[r.randint(0, 9), r.randint(0, 99)] for _ in range(n)], dtype=np.int64)
        own = np.array([r.choice([1, 1, 2, 50]) for _ in range(n)], dtype=np.int64)
        weight, plain = own.copy(), values.copy()
        for i in range(n - 1, -1, -1):
            if parent[i] >= 0:
                weight[parent[i]] += weight[i]
                plain[parent[i]] += plain[i]
        assert (centroids.sums_of(parent, weight, values) == plain).all()


def test_equals_brute_force_on_the_given_table(spark):
    table = spark.read.parquet(f"{SF}/conversations.parquet")
    assert found(digest(table)) == plain_trie(rebuilt([tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]))


def branching(r, convs, texts, longest):
    rows = []
    for c in convs:
        n = r.randint(1, longest)
        rows += [(c, k, r.choice(["user", None, ""]) if k % 2 else "assistant", " ".join(["w"] * r.randint(0, texts))) for k in range(n)]
    return rows


@pytest.mark.parametrize("limit", [1, 4, centroids.LIMIT])
def test_large_components_are_split_over_the_cluster(spark, limit):
    r = random.Random(11)
    rows = branching(r, [k for k in range(90) if r.random() > 0.1], 1, 6)
    rows += [(c, k, "user", "same") for c in (200, 201, 202, 220) for k in range(40)]  # long chains that share everything
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    assert found(digest(df, limit)) == plain_trie(rebuilt(rows))


def test_long_conversations_go_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK", 8)
    r = random.Random(3)
    rows = [(c, k, "user", str(k if k < 21 else r.randint(0, 2))) for c in range(0, 60, 7) for k in range(r.randint(1, 45))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert found(digest(df, 20)) == plain_trie(rebuilt(rows))


def test_odd_rows(spark):
    rows = [(None, 1, "user", "a"), (1, None, None, None), (1, None, None, None), (1, 5, "user", "x " * 200_000), (3, 1, "", ""), (21, 0, "user", "hello"), (41, 0, "user", None), (-20, 2, "a", "b"), (-21, 2, "a", "b"), (40, 0, "s", "t")]
    spare = ["conv", "place", "depth", "k1", "length", "words", "block"]
    df = spark.createDataFrame([(*x, *["?"] * len(spare)) for x in rows], "conv_id long, turn long, role string, text string, " + ", ".join(f"{c} string" for c in spare))
    signed = lambda c: c - (abs(c) % 20) * (1 if c >= 0 else -1)  # noqa: E731  the remainder takes the sign of the dividend, as in SQL
    own = rebuilt([x for x in rows if x[0] is not None and x[0] >= 0] + [x for x in rows if x[0] == -20])
    own[-21] = rebuilt([(-21, 2, "a", "b"), (signed(-21), 2, "a", "b")])[-21] if zlib.crc32(b"-21") % 4 == 0 else own[-20][: zlib.crc32(b"-21") % 4]
    assert found(digest(df)) == plain_trie(own)
    assert digest(df.limit(0)).collect() == []


def test_conversations_without_a_turn_end_at_the_root(spark):
    c = next(k for k in range(1, 99) if zlib.crc32(str(k).encode()) % 4 == 3)
    rows = [(c, 0, "user", "gone")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert found(digest(df)) == plain_trie(rebuilt(rows)) == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]
