"""The whole run with models: what is kept, what is skipped, what is done again."""

import json
import os

import pytest
from pyspark.sql import functions as F

from codeloom.operators import evidence as ev
from codeloom.operators import resume
from codeloom.plans import study
from codeloom.plans.ledger import Ledger, content, contents
from codeloom.session import passing_tables, stored
from codeloom.sources.codebook_log import CodebookLog

TEXTS = [("1", "walking and talking"), ("2", "walking home"), ("3", "late again"), ("4", "late and talking")]


def models(fails):
    def coder(prompts, names):
        import json as j
        import re

        out = []
        for p in prompts:
            asked = j.loads(p)
            text = asked["fragmento_original"]
            asked["codigos_abiertos"] = re.findall(r"\w+ing", text) or ["being"]
            out.append("sorry" if fails and "late" in text else j.dumps(asked))
        return out

    def categorizer(prompts, names):
        import json as j

        if fails == "categories":
            raise ValueError("no")
        return [j.dumps([{"category_name": "All", "is_new": True, "description": "d", "code_assignments": j.loads(p)}]) for p in prompts]

    def analyst(prompts, names):
        import json as j

        return [j.dumps({"paradigm_model": {"context": [{"description": "c", "evidence_insight_ids": [e["id_fragmento"] for e in j.loads(p)]}]}}) for p in prompts]

    return study.Models(coder, categorizer, analyst)


TEMPLATES = study.Templates("{json_input}", "{codes_to_categorize_json}", "{evidence_json}")


def run(spark, root, fails, rows=TEXTS, **how):
    insights = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(rows)], "id string, text string, src_ord long")
    return {o.phase: o for o in study.run_pipeline(insights, root, models(fails), TEMPLATES, [{"category_name": "S"}], **how)}


def counts(spark, root):
    return {r.label: r["count"] for r in CodebookLog(spark, f"{root}/codebook/book").read().collect()}


def test_a_rerun_asks_only_what_failed_and_then_nothing(spark, tmp_path):
    root = str(tmp_path)
    first = run(spark, root, True)
    assert [(o.status, o.asked, o.rows) for o in first.values()] == [("done", 4, 2), ("done", 0, 2), ("done", 1, 1), ("done", 0, 2), ("done", 1, 1)]
    ledger = Ledger(spark, root)
    assert sorted((r.id, r.error) for r in ledger.read("coding", "failed").collect()) == [("3", "invalid response"), ("4", "invalid response")]
    assert counts(spark, root) == {"walking": 1, "talking": 1}
    lines = [json.loads(x) for f in sorted(os.listdir(f"{ledger.last('enrich').path}/results")) if f.startswith("part") for x in open(f"{ledger.last('enrich').path}/results/{f}")]
    assert sorted((x["id"], len(x["unified_code_ids"])) for x in lines) == [("1", 2), ("2", 1)]

    second = run(spark, root, False)
    assert [(o.status, o.asked, o.rows) for o in second.values()] == [("done", 2, 2), ("done", 0, 1), ("done", 1, 1), ("done", 0, 2), ("done", 1, 1)]
    after = counts(spark, root)
    assert after == {"walking": 1, "talking": 1, "being": 1}  # "talking" was mapped before, and is not counted again
    assert sorted(r.insight_id for r in ev.cited_ids(ledger.latest("axial", "axial")).collect()) == ["1", "2", "3", "4"]

    third = run(spark, root, False)
    assert {o.status for o in third.values()} == {"skipped"} and sum(o.asked for o in third.values()) == 0
    assert counts(spark, root) == after and len(ledger.commits("coding")) == 2


def test_coding_is_committed_in_slices(spark, tmp_path):
    done = run(spark, str(tmp_path), False, rows_per_commit=1)
    ledger = Ledger(spark, str(tmp_path))
    assert done["coding"].asked == done["coding"].rows == 4 and len(ledger.commits("coding")) == 4
    assert sorted(r.id for r in ledger.read("coding", "coded").collect()) == ["1", "2", "3", "4"]


def test_a_failing_phase_does_not_end_the_run(spark, tmp_path):
    first = run(spark, str(tmp_path), "categories")
    assert first["categorize"].status == "done" and first["categorize"].rows == 0  # every batch was rejected
    assert first["axial"].rows == 0 and first["enrich"].status == "done"
    broken = study.Models(*models(False)[:2], lambda p, m: 1 / 0)
    insights = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(TEXTS)], "id string, text string, src_ord long")
    ledger = Ledger(spark, str(tmp_path))
    assert ledger.attempt("axial", "x", lambda n, p: (_ for _ in ()).throw(RuntimeError("torn"))).status == "failed: RuntimeError"
    again = {o.phase: o for o in study.run_pipeline(insights, str(tmp_path), broken, TEMPLATES, [{"category_name": "S"}])}
    assert again["coding"].asked == 2 and again["categorize"].rows == 1 and again["axial"].rows == 0


def test_a_torn_phase_is_done_again(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path))
    rows = spark.range(3)

    def torn(number, path):
        rows.write.parquet(f"{path}/rows")
        raise RuntimeError("the driver went away")

    with pytest.raises(RuntimeError):
        ledger.run("phase", "a", torn)
    assert ledger.last("phase") is None and ledger.read("phase", "rows") is None
    with pytest.raises(LookupError):
        ledger.latest("phase", "rows")
    build = lambda number, path: ({"rows": rows}, 7)
    assert ledger.run("phase", "a", build) == ("phase", "done", 7, 3)
    assert ledger.run("phase", "a", torn) == ("phase", "skipped", 0, 3)
    assert ledger.run("phase", "b", build).status == "done" and ledger.version("phase") == "phase 2"
    assert ledger.latest("phase", "rows").count() == 3 and ledger.read("phase", "rows").count() == 6


def test_content_names_rows_whatever_their_order(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "k long, t string")
    assert content(a) == content(a.orderBy(F.desc("k")).repartition(3)) != content(a.where("k = 1"))
    assert content(a.limit(0)).startswith("0 rows")


# The codebook log ---------------------------------------------------------------------------------


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def labels(spark, *names):
    return spark.createDataFrame([(n, 1) for n in names], "label string, n long")


def test_versions_add_up_and_repeat_safely(spark, tmp_path):
    log = CodebookLog(spark, str(tmp_path), base_every=2)
    log.start(spark.createDataFrame([("c1", "walking", "d", None, None, 4)], "id string, label string, description string, embedding array<float>, count long, ord long"))
    assert rows_of(log.read(), "id", "count") == [("c1", None)]
    log.merge(0, labels(spark, "walking", "talking"), 0.9)
    log.merge(1, labels(spark, "talking", "reading"), 0.9)  # talking is mapped already
    seen = rows_of(log.read(), "label", "count", "ord")
    assert seen == [("reading", 1, 6), ("talking", 1, 5), ("walking", 2, 4)]
    assert log._span(None) == (1, [])  # a base was written behind version 1
    log.merge(2, labels(spark, "waiting"), 0.9)
    whole = rows_of(log.read(), "label", "count", "ord"), rows_of(log.label_map(), "label", "match_kind")
    log.merge(2, labels(spark, "waiting"), 0.9)
    assert (rows_of(log.read(), "label", "count", "ord"), rows_of(log.label_map(), "label", "match_kind")) == whole
    assert rows_of(log.read(before=2), "label", "count", "ord") == seen
    assert rows_of(log.label_map(), "label") == [("reading",), ("talking",), ("waiting",), ("walking",)]


def test_a_version_without_its_record_does_not_count(spark, tmp_path, monkeypatch):
    log = CodebookLog(spark, str(tmp_path))
    log.merge(0, labels(spark, "walking"), 0.9)
    monkeypatch.setattr(log, "_record", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        log.merge(1, labels(spark, "talking"), 0.9)
    monkeypatch.undo()
    assert rows_of(log.read(), "label") == rows_of(log.label_map(), "label") == [("walking",)]
    log.merge(1, labels(spark, "reading"), 0.9)
    assert rows_of(log.read(), "label", "count") == [("reading", 1), ("walking", 1)]


def test_an_empty_log_is_an_empty_codebook(spark, tmp_path):
    log = CodebookLog(spark, str(tmp_path / "none"))
    assert log.read().collect() == log.label_map().collect() == []


# What a run leaves on the disk ---------------------------------------------------------------------


def test_a_run_keeps_its_tables_and_no_copies_of_the_texts(spark, tmp_path, monkeypatch):
    """Before, checkpoints and answers stayed in the shared folder: several times the texts."""
    import random

    shared, root = tmp_path / "shared", tmp_path / "root"
    monkeypatch.setattr("codeloom.session.shared_dir", lambda s: str(shared))
    before = spark.sparkContext.getCheckpointDir()
    spark.sparkContext.setCheckpointDir(str(shared))
    try:
        words = random.Random(1)
        rows = [(str(n), "walking " + "".join(words.choices("bcdfhjkmopqrsuvwxyz ", k=3000)) + " late" * (n % 7 == 0)) for n in range(400)]
        done = run(spark, str(root), True, rows)
        assert done["coding"].rows == 342 and done["axial"].status == "done"
        of = lambda p: sum(f.stat().st_size for f in p.rglob("*") if f.is_file())
        assert of(shared) < 0.3 * sum(len(t) for _, t in rows)
        assert not list(shared.glob("codeloom/answers-*"))
        again = run(spark, str(root), False, rows)
        assert (again["coding"].asked, again["coding"].rows) == (58, 58)
        assert of(shared) < 0.5 * sum(len(t) for _, t in rows)
        texts = dict(rows)
        assert all(texts[r.id] == r.text == r.fragmento_original for r in Ledger(spark, str(root)).read("enrich", "enriched").collect())
    finally:
        if before:
            spark.sparkContext._jsc.sc().setCheckpointDir(before)


def test_stored_tables_pass_with_the_phase(spark, tmp_path, monkeypatch):
    import os

    monkeypatch.setattr("codeloom.session.shared_dir", lambda s: str(tmp_path))
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    kept = stored(spark.range(3), "kept")
    with passing_tables(spark):
        outer = stored(spark.range(4), "outer")
        with passing_tables(spark):
            inner = stored(spark.range(5), "inner")
            assert inner.count() == 5 and spark.conf.get(key) == "true"
        assert outer.count() == 4
        assert sorted(x.split("-")[0] for x in os.listdir(tmp_path / "codeloom")) == ["kept", "outer"]
    assert kept.count() == 3 and [x.split("-")[0] for x in os.listdir(tmp_path / "codeloom")] == ["kept"]
    assert spark.conf.get(key, None) is None


def test_contents_of_slices_are_those_of_the_slices_alone(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (4, "y"), (4, "y")], "k long, t string")
    got = contents(a, F.pmod(F.col("k"), F.lit(3)), 3)
    assert got == [(0, content(a.limit(0))), (3, content(a.where("k % 3 = 1"))), (1, content(a.where("k = 2")))]


def test_lengths_place_evidence_as_the_texts_do(spark):
    insights = spark.createDataFrame([("1", "aaaa", 1), ("1", "bb", 2), ("2", "", 3), ("3", None, 4), ("4", "é" * 30, 5), (None, "x", 6)], "id string, text string, src_ord long")
    refs = spark.createDataFrame([("c", i) for i in "12345"] + [("d", "4"), ("d", "4")], "category_id string, insight_id string")
    whole = ev.evidence_parts(ev.resolve_texts(refs, ev.texts_for(refs, insights)), limit=40)
    short = ev.evidence_parts(ev.resolve_lengths(refs, ev.lengths_for(refs, insights)), limit=40)
    names = ("category_id", "insight_id", "running_chars", "within_budget", "part")
    assert rows_of(whole, *names) == rows_of(short, *names) and len({r.part for r in short.collect()}) > 2


def test_insights_go_along_with_their_requests(spark):
    """Rows without ``src_ord``: equal rows, null ids and columns named like those of a request stay as they are."""
    rows = [("1", "walking", "mine", 2**60), ("1", "walking", "mine", None), (None, "late", "p", 1), (None, "talking", None, 3)]
    given = spark.createDataFrame(rows, "id string, text string, prompt string, error2 long")
    coded, failed = study.code_with_model(given.fillna({"id": "0"}).withColumn("id", F.nullif("id", F.lit("0"))), lambda p, m: [x if "late" not in x and "null" not in x else "no" for x in p], '{{"id_fragmento": "i", "fragmento_original": "f", "codigos_abiertos": ["x"], "asked": {json_input}}}')
    assert coded.columns == ["id", "text", "prompt", "error2", "id_fragmento", "fragmento_original", "codigos_abiertos", "error"]
    assert rows_of(coded, "id", "prompt", "error2") == rows_of(given.where("id = '1'"), "id", "prompt", "error2")
    assert rows_of(failed.select("id", "insight_original.text", "error"), "text", "error") == [("late", "invalid response"), ("talking", "invalid response")]


def test_what_is_left_is_found_without_the_texts(spark, tmp_path):
    """Before, all texts were shuffled to meet the ids of the checkpoint."""
    rows = [(str(n), f"text {n}") for n in range(20_000)] + [("7", "again"), ("a", "new"), ("a", "new"), (None, "no id")]
    spark.createDataFrame(rows, "id string, text string").write.parquet(str(tmp_path / "raw"))
    spark.createDataFrame([(str(n), str(n)) for n in range(20_000)], "id string, id_fragmento string").write.parquet(str(tmp_path / "done"))
    raw, done = (spark.read.parquet(str(tmp_path / x)) for x in ("raw", "done"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20000")
    try:
        todo = resume.pending(raw, done)
        assert "BroadcastHashJoin" in todo._jdf.queryExecution().executedPlan().toString()
        assert rows_of(todo, "id", "text") == [("a", "new"), ("a", "new"), (None, "no id")]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    nulls = done.limit(1).select(F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("id_fragmento"))
    assert rows_of(resume.pending(raw.where("id IS NULL OR id = 'a'"), nulls), "id") == [("a",), ("a",)]
