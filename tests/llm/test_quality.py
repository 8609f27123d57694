import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from codeloom.llm import quality_model, quality_rules, queries

SF = "/root/testdata/sf0.01"


def plain_base(text):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
    inside = {k + j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in range(3)}
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside), n < 50 or 100 * len(inside) > 50 * n


def of(r):
    return r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed


def test_base_rules_equal_plain_python(spark):
    rows = queries.op7_quality_rules(spark, SF).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(rows) == len(texts) and all(of(r) == plain_base(texts[r.doc_id]) for r in rows)


def test_weights_equal_plain_counts(spark):
    docs = spark.createDataFrame([(1, "good words here"), (2, "good words bad"), (3, None)], "doc_id long, text string")
    got = {r.bucket: r.weight for r in quality_rules.bucket_weights(docs, docs.where("doc_id = 1"), 1 << 10).collect()}
    grams = lambda w: [*((x,) for x in w), *zip(w, w[1:])]
    bucket = {g: spark.range(1).select(F.pmod(F.xxhash64(*map(F.lit, g)), F.lit(1 << 10))).first()[0] for d in (["good", "words", "here"], ["good", "words", "bad"]) for g in grams(d)}
    corpus = Counter(bucket[g] for d in (["good", "words", "here"], ["good", "words", "bad"]) for g in grams(d))
    good = Counter(bucket[g] for g in grams(["good", "words", "here"]))
    s, share = quality_rules.SMOOTHING, 5 / 10
    assert got == pytest.approx({b: np.log((good[b] + s * share) / ((n - 1 + s) * share)) for b, n in corpus.items()})


def test_junk_is_rejected_and_clean_text_kept(spark):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    trusted = labels.where("quality = 1 and doc_id % 2 = 0").select("doc_id")
    seen = quality_rules.judge(docs, trusted).join(labels, "doc_id").where("doc_id % 2 = 1 and not base_failed").groupBy("quality", "kept").count().collect()
    n = {(r.quality, r.kept): r["count"] for r in seen}
    assert n.get((0, True), 0) <= 0.02 * n[0, False] and n.get((1, False), 0) <= 0.01 * n[1, True]


def test_rules_on_odd_rows(odd_docs, no_docs):
    for trusted in (odd_docs.select("doc_id"), no_docs.select("doc_id")):
        rows = quality_rules.judge(odd_docs, trusted).collect()
        assert sorted((repr(r.doc_id), *of(r)) for r in rows) == sorted((repr(d.doc_id), *plain_base(d.text)) for d in odd_docs.collect())
        assert all(not r.kept for r in rows if r.base_failed) and all(abs(r.score) < 5 for r in rows)
    assert quality_rules.judge(no_docs, odd_docs.select("doc_id")).collect() == []


def test_rules_stay_native(odd_docs):
    plan = quality_rules.judge(odd_docs, odd_docs.select("doc_id"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_gradient_equals_differences():
    r = np.random.default_rng(0)
    model = quality_model.Model()
    for n in model.weights:
        model.weights[n] = model.weights[n].astype(np.float64) + 0.1 * r.standard_normal(model.weights[n].shape)
    x, starts, y = r.standard_normal((11, quality_model.FEATURES)), np.array([0, 1, 5, 9]), np.array([1.0, 0, 1, 0])
    loss = lambda: -np.mean([np.log(p if t else 1 - p) for p, t in zip(model.forward(x, starts)["p"], y)])
    grads = model.gradient(x, starts, y)
    for n, w in model.weights.items():
        for _ in range(4):
            at = tuple(r.integers(0, s) for s in w.shape)
            old = w[at]
            w[at] = old + 1e-5
            up = loss()
            w[at] = old - 1e-5
            down = loss()
            w[at] = old
            assert grads[n][at] == pytest.approx((up - down) / 2e-5, abs=1e-6)


def test_passages_do_not_depend_on_the_batch():
    texts = [b"", b"one", b" ".join(b"w%d" % (k % 90) for k in range(200)), b"a a a a", "É x".encode() * 100]
    rows, firsts = quality_model.passages(texts)
    alone = [quality_model.passages([t])[0] for t in texts]
    assert np.allclose(rows, np.concatenate(alone), atol=1e-5) and firsts.tolist() == np.cumsum([0, *map(len, alone)])[:-1].tolist()


def test_held_out_accuracy(spark):
    rows = queries.op10_quality_classifier(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").collect()
    assert rows and np.mean([r.predicted == r.quality for r in rows]) >= 0.93


def test_classifier_on_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (3, 0), (6, 1), (7, 0), (2, None), (None, 1)], "doc_id long, quality int")
    for given in (labels, labels.limit(0), labels.where("quality = 1")):
        model = quality_model.fit(odd_docs, given)
        rows = quality_model.score(odd_docs, model).collect()
        assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 for r in rows)
        assert quality_model.score(no_docs, model).collect() == []


def plain_passages(text):
    """Features of a text's passages, word by word."""
    import xxhash

    words = text.split()
    out = []
    for at in range(0, max(1, len(words)), quality_model.PASSAGE):
        own = words[at : at + quality_model.PASSAGE]
        row = np.zeros(quality_model.FEATURES)
        if own:
            shapes = np.zeros(quality_model.SHAPES)
            for w in own:
                letters, upper, digits = sum(map(str.isalpha, w)), sum(map(str.isupper, w)), sum(map(str.isdigit, w))
                symbols = len(re.findall(r"[#*$%&|<>{}\[\]\\/=_~^]", w))
                shapes += [len(w), letters, upper, digits, symbols, len(w) - letters - digits - symbols, letters > 0 and upper == letters, w[0].isupper(), w[-1] in ".!?"]
            shapes /= len(own)
            shapes[0] = min(shapes[0], 50) / 10
            shapes[1:6] /= max(shapes[1:6].sum(), 1e-6)
            row[: quality_model.SHAPES] = shapes
            pairs = [(words[k], words[k + 1] if k + 1 < len(words) else None) for k in range(len(words))]
            n = quality_model.SHAPES
            row[n] = len(set(own)) / len(own)
            row[n + 1] = sum(k > 0 and words[k] == words[k - 1] for k in range(at, at + len(own))) / len(own)
            row[n + 2] = sum(pairs[k] in pairs[:k] for k in range(at, at + len(own))) / len(own)
            row[n + 3] = np.log1p(len(own)) / 4
            for w in own:
                row[n + 5 + xxhash.xxh64_intdigest(w.encode()) % quality_model.HASHED] += 1 / len(own)
        row[quality_model.SHAPES + 4] = np.log1p(len(words)) / 10
        out.append(row)
    return out


def test_classifier_equals_brute_force():
    r = random.Random(12)
    model = quality_model.Model(3)
    model.mean, model.spread = np.full(quality_model.FEATURES, 0.1, np.float32), np.full(quality_model.FEATURES, 0.5, np.float32)
    words = ["The", "cat", "sat.", "ALL", "CAPS", "3.14", "a#b", "été", "end!", "x", "foo_bar", "long" * 9]
    texts = ["", "one", *(" ".join(r.choices(words, k=n)) for n in (5, 63, 64, 65, 150, 300))]
    k = {n: w.astype(float) for n, w in model.weights.items()}
    for text, got in zip(texts, model.scores([t.encode() for t in texts])):
        encoded, pull = [], []
        for x in plain_passages(text):
            h = np.tanh(np.clip((x - 0.1) / 0.5, -6, 6) @ k["w"] + k["w0"])
            encoded.append(h)
            pull.append((np.tanh(h @ k["v"]) / (1 + np.exp(-(h @ k["u"])))) @ k["a"])
        weight = np.exp(pull) / np.exp(pull).sum()
        mean = sum(a * h for a, h in zip(weight, encoded))
        assert got == pytest.approx(1 / (1 + np.exp(-(mean @ k["c"] + k["c0"][0]))), abs=2e-4), text[:40]
