import math
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from codeloom.llm import language_id as li
from codeloom.llm import queries

SF = "/root/testdata/sf0.001"


def folded(text):
    """The character stream of a text, by characters."""
    if not any(c.isalpha() for c in text):
        return []
    out = [0] * (li.ORDER - 1)
    for c in text:
        f = li._fold(ord(c))
        if f or out[-1]:
            out.append(f)
    return out if not out[-1] and len(out) > li.ORDER - 1 else [*out, 0]


TEXTS = ["Hello, World", "x", "  Été 12 naïve", "a--b  c", "ÀÉÎ", "नमस्ते दुनिया", "日本語 テキスト", "𐐀𐐁 ab", "ﬁne İstanbul", "z" * 50]


def test_streams():
    for t in TEXTS:
        assert li.stream(t.encode()).tolist() == folded(t), t
    for t in ["", " ", "123 !?", "😀", "́"]:
        assert not len(li.stream(t.encode()))
    assert unicodedata.category("́") == "Mn"


def test_slots_are_those_of_the_engine(spark):
    numbers = [0, 1, 77, 2**47 + 5, 2**63 - 1, -1, -(2**63), 123456789012345]
    rows = spark.createDataFrame([(x,) for x in numbers], "g long").select("g", li._slot("g").alias("s")).collect()
    assert [r.s for r in rows] == li.slots_of(np.array([r.g for r in rows], dtype=np.int64).view(np.uint64)).astype(int).tolist()


def plain_model(texts):
    """Interpolated Kneser-Ney over exact n-grams: log probabilities of the n-grams of a stream."""
    counts = {li.ORDER: Counter()}
    for t in texts:
        s = folded(t)
        counts[li.ORDER].update(tuple(s[k : k + li.ORDER]) for k in range(len(s) - li.ORDER + 1))
    for size in range(li.ORDER - 1, 0, -1):
        counts[size] = Counter(g[1:] for g in counts[size + 1])
    discount, total, kinds = {}, {}, {}
    for size, c in counts.items():
        once, twice = sum(n == 1 for n in c.values()), sum(n == 2 for n in c.values())
        discount[size] = min(max(once / (once + 2 * twice), 0.1), 0.9) if once else 0.5
        total[size], kinds[size] = Counter(), Counter()
        for g, n in c.items():
            total[size][g[:-1]] += n
            kinds[size][g[:-1]] += 1

    def log_p(gram, least):
        p = least
        for size in range(1, li.ORDER + 1):
            g = gram[-size:]
            if total[size][g[:-1]]:
                t = total[size][g[:-1]]
                p = max(counts[size][g] - discount[size], 0) / t + discount[size] * kinds[size][g[:-1]] / t * p
        return math.log(p)

    return counts, log_p


def test_probabilities_equal_brute_force(spark):
    learn = {"aa": ["the cat sat", "the cat ran on the mat", "cats and mats"], "bb": ["der kater lief", "die matte und der kater", "ÀÉ der"]}
    df = spark.createDataFrame([(k, lang, t) for k, (lang, t) in enumerate((lang, t) for lang, ts in learn.items() for t in ts)], "doc_id long, lang string, text string")
    model = li.fit(df)
    assert model.languages == ["aa", "bb"]
    plain = {lang: plain_model(ts) for lang, ts in learn.items()}
    seen = len({g for counts, _ in plain.values() for g in counts[1]})
    tries = ["the kater", "xyz", "cat", "matte der", "É"]
    h, n = model.entropies([t.encode() for t in tries])
    for row, t in enumerate(tries):
        s = folded(t)
        own = [tuple(s[k : k + li.ORDER]) for k in range(len(s) - li.ORDER + 1)]
        assert n[row] == len(own)
        for col, lang in enumerate(model.languages):
            assert h[row, col] == pytest.approx(-sum(plain[lang][1](g, 1 / (1 + seen)) for g in own) / len(own), rel=1e-4)


def test_parts_of_a_long_text_give_the_whole():
    text = ("Der Kater, die Matte; 12 Katzen. " * 400).encode()
    whole = [x.tolist() for _, parts in li.stretches([text], 1 << 20) for x in parts]
    cut = [x.tolist() for _, parts in li.stretches([text], 97) for x in parts]
    assert len(cut) > 50 and sum(cut, []) == sum(whole, [])


def test_counts_equal_brute_force(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    count = lambda: sorted(tuple(r) for r in li.count_grams(df, "text", "lang").collect())
    expected = Counter()
    for r in df.collect():
        s = folded(r.text)
        for k in range(len(s) - li.ORDER + 1):
            expected[r.lang, sum(c << 16 * (li.ORDER - 1 - j) for j, c in enumerate(s[k : k + li.ORDER]))] += 1
    assert {(lang, g & (2**64 - 1)): n for lang, g, n in count()} == expected


def test_held_out_accuracy(spark):
    rows = queries.op13_language_id(spark, "/root/testdata/sf0.01").collect()
    lang = {r.doc_id: (r.lang, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    assert len(rows) == len(lang) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out and r.lang_pred != "und"]
    right = [r.lang_pred == lang[r.doc_id][0] for r in held]
    assert len(held) > 150 and sum(right) / len(right) > 0.98
    assert sum(r.rejected for r in held) < 0.05 * len(held)
    assert all((r.lang_pred == "und") == (not any(c.isalpha() for c in lang[r.doc_id][1])) for r in rows)


def test_what_is_no_learned_language_is_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = li.fit(docs)
    strange = ["Съешь же ещё этих мягких французских булок да выпей чаю " * 4, "qzxv kjqx zzvw xqkj wvzq " * 12, "日本語のテキストです。" * 10]
    assert all(rejected for _, _, rejected, _ in model.predict([t.encode() for t in strange]))


def test_odd_rows(spark, odd_docs, no_docs):
    docs = odd_docs.withColumn("lang", F.when(F.col("doc_id") < 3, "en").when(F.col("doc_id") == 6, "zz"))
    model = li.fit(docs)
    assert model.languages == ["en", "zz"]
    by = {}
    for r in li.predict(docs, model).collect():
        by.setdefault(r.doc_id, []).append(r)
    assert len(by[1]) == 2 and by[1][0] == by[1][1] and by[1][0].lang_pred == by[2][0].lang_pred == "en" and by[6][0].lang_pred == "zz"
    assert all(r.lang_pred == "und" and r.score == 0 for k in (3, 4, 5) for r in by[k]) and {r.lang_pred for r in by[None]} >= {"und"}
    assert li.predict(no_docs, model).collect() == []
    for nothing in (docs.limit(0), docs.withColumn("lang", F.lit(None).cast("string"))):
        empty = li.fit(nothing)
        assert empty.languages == [] and {r.lang_pred for r in li.predict(docs, empty).collect()} == {"und"}
    one = li.fit(docs.where("doc_id < 3"))
    assert one.languages == ["en"] and {r.lang_pred for r in li.predict(docs, one).collect()} == {"en", "und"}


def test_calibration_counts_every_document(spark):
    """Curve and medians are those of all rows, worked out on the cluster."""
    rng = np.random.default_rng(4)
    x = rng.normal(2, 2, 501)
    right = (rng.random(501) < 1 / (1 + np.exp(-(0.5 + 0.8 * x)))).astype(int)
    seen = spark.createDataFrame([(k % 2, int(r), float(v)) for k, (r, v) in enumerate(zip(right, x))], "lang int, right int, x double").repartition(7)
    a, b = li._fit_curve(seen)
    p = 1 / (1 + np.exp(-(a + b * x)))
    assert abs((right - p).sum() - 0.5 * a) < 1e-4 and abs(((right - p) * x).sum() - 0.5 * (b - 1)) < 1e-4
    medians = li._medians(seen.select("lang", F.col("x").alias("v")))
    assert medians == {k: float(np.median(x[k::2])) for k in (0, 1)}


def test_calibration_takes_more_than_a_sample(spark, monkeypatch):
    rows = [(k, ("aaa bbb" if k % 2 else "ccc ddd") + " ee" * (k % 3), "xy"[k % 2]) for k in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    met = []
    fit_curve = li._fit_curve
    monkeypatch.setattr(li, "_fit_curve", lambda seen: met.append(seen.count()) or fit_curve(seen))
    monkeypatch.setattr(li, "CALIBRATION_ROWS", 100, raising=False)
    li.fit(docs)
    assert met == [600]
