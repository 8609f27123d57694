import itertools
import random

from codeloom.llm import queries, token_counts

SCORES = {"▁": -3.0, "a": -2.5, "b": -2.75, "ab": -3.5, "▁a": -3.25, "▁ab": -4.5, "ba": -4.0, "aba": -5.25, "c": -2.0, "▁abc": -6.0, "é": -4.0}


def exhaustive(word, unigram, scores):
    """Best (score, fewest tokens) over all segmentations into pieces and single unknown characters."""
    best = None
    for cuts in itertools.product([0, 1], repeat=max(0, len(word) - 1)):
        parts, at = [], 0
        for k, cut in enumerate(cuts, 1):
            if cut:
                parts.append(word[at:k])
                at = k
        parts.append(word[at:])
        total = n = 0
        for p in parts:
            if p in scores:
                total, n = total + scores[p], n + 1
            elif len(p) == 1:
                total, n = total + unigram.unknown, n + len(p.encode())
            else:
                break
        else:
            best = min(best, (-total, n)) if best else (-total, n)
    return best[1]


def test_counts_equal_all_segmentations():
    unigram, r = token_counts.Unigram(SCORES), random.Random(5)
    words = {"▁" + "".join(r.choices("abcé☃x", k=r.randint(1, 8))) for _ in range(300)}
    got = unigram.counts(words)
    assert got == {w: exhaustive(w, unigram, SCORES) for w in words}


def test_shared_prefixes_do_not_depend_on_the_batch():
    unigram = token_counts.load(queries.vocabulary(queries.PIECE_VOCABULARY))
    words = ["▁" + w for w in ("the", "them", "themselves", "theory", "a", "zebra", "zürich", "数学", "☃☃", "x" * 3000)]
    together = unigram.counts(words)
    assert together == {w: unigram.counts([w])[w] for w in words}


def test_a_full_memory_changes_nothing():
    unigram = token_counts.load(queries.vocabulary(queries.PIECE_VOCABULARY))
    texts = [f"some words {k} and more{k}".encode() for k in range(50)]
    small, large = token_counts.Counter(unigram, 3), token_counts.Counter(unigram)
    assert [small.count([t])[0] for t in texts] == large.count(texts)


def test_odd_rows(odd_docs, no_docs):
    path = queries.vocabulary(queries.PIECE_VOCABULARY)
    rows = token_counts.count_tokens(odd_docs, path).collect()
    unigram = token_counts.load(path)
    expected = []
    for d in odd_docs.collect():
        words = (d.text or "").split()
        counts = unigram.counts({"▁" + w for w in words})
        expected.append((d.doc_id, len(words), sum(counts["▁" + w] for w in words)))
    assert sorted(map(repr, map(tuple, rows))) == sorted(map(repr, expected))
    assert token_counts.count_tokens(no_docs, path).collect() == []
