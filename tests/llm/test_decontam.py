import re

import numpy as np

from codeloom.llm import decontam


def plain(docs, items):
    """Every document against every item on every diagonal."""
    tokens = lambda t: [w for w in re.findall(r"[^\W_]+", (t or "").lower())]
    out = set()
    for d, text in docs:
        doc = tokens(text)
        for i, item_text in items:
            item = tokens(item_text)
            size = min(decontam.WINDOW, len(item))
            for offset in range(-len(item) + 1, len(doc)) if item else []:
                same = [0 <= p + offset < len(doc) and doc[p + offset] == w for p, w in enumerate(item)]
                if any(sum(same[k : k + size]) >= np.ceil(decontam.AGREE * size) for k in range(len(item) - size + 1)):
                    out.add((d, i))
                    break
    return out


ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


def test_substitutions_between_the_ends(spark):
    changed = lambda at: " ".join("changed" if k in at else w for k, w in enumerate(ITEM))
    docs = [
        (1, "before it " + changed({6}) + " after"), (2, changed({5, 9})), (3, changed(set(range(0, 19, 2)))), (4, "nothing of it"), (5, " ".join(ITEM[:14]).upper()),
        (6, None), (7, ""), (8, "mu nu"), (9, "tiny item, whole"), (9, "clean under the same id"), (None, "So: tiny item. WHOLE"), (10, " ".join(ITEM[:7])),
    ]
    items = [(100, " ".join(ITEM)), (101, "tiny item whole"), (102, None), (103, ""), (104, "..."), (100, " ".join(ITEM)), (105, " ".join(ITEM))]
    frame = spark.createDataFrame([(i, t, "?", "?") for i, t in docs], "doc_id long, text string, runs string, item_id string")
    tests = spark.createDataFrame(items, "item_id long, text string")
    found = decontam.overlaps(frame, tests).collect()
    assert {(r.doc_id, r.item_id) for r in found} == plain(docs, items)
    assert len(found) == len(set(found))
    kept = decontam.clean(frame, tests)
    bad = {d for d, _ in plain(docs, items)}
    assert kept.columns == frame.columns
    assert sorted(map(repr, ((r.doc_id, r.text) for r in kept.collect()))) == sorted(repr(d) for d in docs if not plain([d], items)) and {1, 2, 5, 9, None} == bad


def test_equals_brute_force_on_whole_tables(spark):
    d = "/root/testdata/sf0.001"
    docs, items = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/benchmark.parquet")
    small = [(r.doc_id, r.text) for r in docs.collect()]
    tests = [(r.item_id, r.text) for r in items.collect()]
    joined = {(r.doc_id, r.item_id) for r in decontam.overlaps(docs, items).collect()}
    tokens = lambda t: " ".join(re.findall(r"[^\W_]+", t.lower()))
    exact = {(a, b) for a, x in small for b, y in tests if f" {tokens(y)} " in f" {tokens(x)} "}
    assert exact <= joined
    assert plain([x for x in small if len(x[1]) < 3000][:60], tests) == {p for p in joined if p[0] in {x[0] for x in [x for x in small if len(x[1]) < 3000][:60]}}


def test_odd_rows(spark, odd_docs, no_docs):
    tests = spark.createDataFrame([(1, "fox jumps over the lazy dog the quick brown fox jumps over the lazy")], "item_id long, text string")
    assert {r.doc_id for r in decontam.overlaps(odd_docs, tests).collect()} == {1, 2, None}
    assert decontam.overlaps(no_docs, tests).collect() == [] and decontam.overlaps(odd_docs, tests.limit(0)).collect() == []
    assert decontam.clean(odd_docs, tests.limit(0)).count() == odd_docs.count() and decontam.clean(no_docs, tests).collect() == []


def test_a_small_bit_table_loses_nothing(spark):
    docs = spark.createDataFrame([(k, f"start {k} " + " ".join(ITEM)) for k in range(20)], "doc_id long, text string")
    tests = spark.createDataFrame([(1, " ".join(ITEM))], "item_id long, text string")
    assert {r.doc_id for r in decontam.overlaps(docs, tests, bits=8).collect()} == set(range(20))


def test_masks_find_a_window_with_any_two_substitutions():
    from itertools import combinations

    n = decontam.WINDOW
    for bad in [*combinations(range(n), 1), *combinations(range(n), 2)]:
        assert any(all(used == "0" or at + k not in bad for k, used in enumerate(mask)) for mask in decontam.MASKS for at in range(n - len(mask) + 1)), bad


def test_short_masks_find_every_allowed_substitution():
    from itertools import combinations

    for n in range(1, decontam.WINDOW):
        spare = n - int(np.ceil(decontam.AGREE * n))
        masks = decontam.short_masks(n)
        for bad in combinations(range(n), spare):
            assert any(all(used == "0" or at + k not in bad for k, used in enumerate(mask)) for mask in masks for at in range(n - len(mask) + 1)), (n, bad)


def test_short_items_with_substitutions(spark):
    from itertools import combinations

    items = [(n, " ".join(f"{w}{n}" for w in ITEM[:n])) for n in range(1, decontam.WINDOW)]
    docs = []
    for n, text in items:
        for spare in (1, 2, 3):
            for bad in list(combinations(range(n), spare))[:: 1 if spare < 3 else 7]:
                words = ["other" if k in bad else w for k, w in enumerate(text.split())]
                docs.append((len(docs), " ".join(words)))
                docs.append((len(docs), "before it " + " ".join(words) + " after"))
        docs += [(len(docs), " ".join(text.split()[1:])), (len(docs) + 1, " ".join(text.split()[:-2]))]
    found = decontam.overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in found} == plain(docs, items)


def test_a_passage_that_many_documents_and_items_share(spark):
    """Whether a document overlaps any item does not take a comparison with every item that has the passage."""
    passage = " ".join(f"p{k}" for k in range(20))
    items = [(k, f"own{k} start{k} " + passage + f" end{k}") for k in range(40)] + [(100, " ".join(f"q{k}" for k in range(20)))]
    near = " ".join(f"p{k}" if k % 3 else f"x{k}" for k in range(20))  # a seed may match, too few tokens agree
    docs = [(k, f"before{k} " + (passage if k % 4 else near) + f" after{k}") for k in range(60)] + [(100, " ".join(f"q{k}" for k in range(15))), (101, None)]
    frame, tests = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    bad = {d for d, _ in plain(docs, items)}
    assert bad == {100, *(k for k in range(60) if k % 4)}
    for at_once in (1, 2, 8, 64):
        assert {r.doc_id for r in decontam.contaminated(frame, tests, lines_at_once=at_once).collect()} == bad
    assert {r.doc_id for r in decontam.clean(frame, tests).collect()} == {d for d, _ in docs} - bad
    assert decontam.contaminated(frame, tests.limit(0)).collect() == decontam.contaminated(frame.limit(0), tests).collect() == []
