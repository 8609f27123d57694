import numpy as np

from codeloom.llm import queries, toxicity


def test_folding():
    for text, folded in [
        ("IDIOT!", "idiot"), ("1d10t", "idiot"), ("іdіоt", "idiot"), ("st­upid", "stupid"), ("ｆｏｏ", "foo"), ("$tup1d.", "stupid"), ("a$$$", "a"), ("THE!!", "the"), ("x|y", "xiy"), ("2024", ""), ("été,", "été"), ("l0ser's", "loser s"),
    ]:
        assert " ".join(toxicity.fold(text.encode()).split()) == folded, text


def test_matches_are_anchored_and_spared_in_exceptions():
    m = toxicity.Matcher({" trash ": 2.0, " lowei": 3.0, " clown ": 1.0})
    weights = lambda t: [w for _, w in m.hits(toxicity.fold(t.encode()))]
    assert weights("the trash can, the TRASH") == [2.0]
    assert weights("loweischaft floweich trashy clown") == [3.0, 1.0]
    assert weights("a clown fish and a cl0wn") == [1.0] and weights("") == []


def test_spurious_words_of_copies_are_not_learned():
    toxic = [(1, [" bad ", f" rare{k // 10} "]) for k in range(40)]
    lexicon = toxicity.choose(sorted([*toxic, *[(0, [" rare9 "])] * 5]), 40, 400)
    assert set(lexicon) == {" bad "}


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    rows = queries.op5_toxicity(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").collect()
    found = [r.predicted for r in rows if r.toxic == 1]
    assert np.mean(found) >= 0.85 and sum(r.predicted for r in rows if r.toxic == 0) <= 0.002 * len(rows)


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (3, 0), (6, 0), (7, 0), (2, None), (None, 1)], "doc_id long, toxic int")
    for given in (labels, labels.limit(0), labels.where("toxic = 0")):
        model = toxicity.fit(odd_docs, given)
        rows = toxicity.score(odd_docs, model).collect()
        assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 for r in rows)
        assert toxicity.score(no_docs, model).collect() == [] and toxicity.drop_toxic(no_docs, model).collect() == []
        assert toxicity.drop_toxic(odd_docs, model).columns == odd_docs.columns


def plain_signal(text, lexicon, exceptions):
    """Every entry tried at every word, exception phrases word by word."""
    words = toxicity.fold(text.encode()).split()
    spared = {k + j for p in exceptions for k in range(len(words)) if words[k : k + len(p.split())] == p.split() for j in range(len(p.split()))}
    total, hits = 0.0, 0
    for k, w in enumerate(words):
        own = [weight for entry, weight in lexicon.items() if (w == entry.strip() if entry.endswith(" ") else w.startswith(entry.strip()))]
        if own and k not in spared:
            total, hits = total + max(own), hits + 1
    return (total / np.log2(2 + len(words) + 1), hits) if hits else (0.0, 0)


def test_scores_equal_brute_force():
    import random

    r = random.Random(6)
    lexicon = {" trash ": 2.0, " trash": 1.5, " idiot ": 3.0, " lose": 2.5, " loser ": 2.75, " fish ": 0.5, " pond ": 1.0}
    words = ["trash", "TRASH", "tr4sh", "trashy", "can", "bag", "the", "idiot", "1d10t", "ïdiot", "proof", "loser", "losers", "sore", "clown", "fish", "pond", "scum", "a", "x|y", "12", "іdіоt!", "..."]
    model = toxicity.Model(lexicon, -3.0, 2.0)
    matcher, rate = toxicity.Matcher(lexicon), model.scorer()
    for _ in range(400):
        text = " ".join(r.choices(words, k=r.randint(0, 25)))
        x, n = plain_signal(text, lexicon, toxicity.EXCEPTIONS)
        got = matcher.signal(text.encode())
        assert got[1] == n and abs(got[0] - x) < 1e-9, text
        assert abs(rate(text.encode())[0] - 1 / (1 + np.exp(-(-3.0 + 2.0 * x)))) < 1e-9
