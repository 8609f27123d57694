import json
import random

import pytest
from pyspark.sql import functions as F

from codeloom.operators import categories as cat
from codeloom.operators import contracts, ingest, model, report, resume
from codeloom.operators import evidence as ev
from codeloom.operators.ranking import with_position

SRC = "src_ord long, ID string, InsightText string, Method string, Source string"


def test_clean_splits_and_keeps_duplicates(spark):
    rows = [
        (0, " a ", " t1 ", "m", None), (1, None, "t", "m", "s"), (2, "  ", "t", "m", "s"), (3, "b", None, "m", "s"),
        (4, "b", " ", "m", "s"), (5, "a", "t2", None, " s2 "), (6, "c", "", "m", "s"),
    ]
    src = spark.createDataFrame(rows, SRC)
    valid, rejects = ingest.clean_insights(src)
    assert sorted((r.src_ord, r.id, r.text) for r in valid.collect()) == [(0, "a", "t1"), (5, "a", "t2")]
    assert {r.src_ord: r.reason for r in rejects.collect()} == {
        1: "null_id", 2: "blank_id", 3: "null_text", 4: "blank_text", 6: "blank_text",
    }
    assert [tuple(r) for r in ingest.metadata_registry(valid).collect()] == [("a", "unknown", "s2")]
    assert [tuple(r) for r in ingest.insight_texts(valid).collect()] == [("a", "t2")]
    done = ingest.run_report(src).first()
    assert (done.total_insights, done.processed_insights, done.warnings, done.metadata_generated) == (7, 2, 5, True)
    check = ingest.source_check(src.drop("Source")).first()
    assert (check.n_rows, check.n_null_rows, check.is_valid, check.missing_metadata_columns) == (7, 2, True, "Source")
    assert ingest.source_check(src.limit(0)).first().is_valid is False


def test_missing_columns_fail_before_any_job(spark):
    with pytest.raises(ValueError, match="InsightText"):
        ingest.clean_insights(spark.createDataFrame([("1",)], "ID string"))


def test_a_first_run_moves_no_texts(spark):
    raw = spark.createDataFrame([("a", "x"), ("a", "y"), (None, "z")], "id string, text string")
    todo = resume.pending(raw, spark.createDataFrame([], "id string, id_fragmento string"))
    assert sorted(r.text for r in todo.collect()) == ["x", "y", "z"]
    plan = todo._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan


def test_resume_keeps_duplicates_and_treats_null_like_a_value(spark):
    raw = spark.createDataFrame([("a",), ("b",), ("b",), (None,), ("c",)], "id string")
    done = spark.createDataFrame([("a", "x"), ("", "c"), (None, None)], "id string, id_fragmento string")
    assert sorted(r.id for r in resume.pending(raw, done).collect()) == ["b", "b"]
    no_null = done.filter("id_fragmento IS NOT NULL")
    assert sorted(str(r.id) for r in resume.pending(raw, no_null).collect()) == ["None", "b", "b"]


def test_merge_records_right_wins_and_error_clears_codes(spark):
    left = spark.createDataFrame([("1", "t", "old")], "id string, text string, error string")
    right = spark.createDataFrame([("1", ["x"], "boom")], "id string, codigos_abiertos array<string>, error string")
    row = resume.coded_rows(left, right).first()
    assert (row.text, row.error, row.codigos_abiertos) == ("t", "boom", [])


@pytest.mark.parametrize("groups", [["g"], []])
def test_positions_and_running_sums_with_a_hot_group(spark, groups):
    rng = random.Random(4)
    rows = [("hot" if n % 3 else f"g{n % 7}", rng.random(), n % 5) for n in range(600)] + [(None, 0.5, 1), (None, 0.1, 2)]
    df = spark.createDataFrame(rows, "g string, k double, w long").repartition(5)
    got = with_position(df, ["k"], groups, "p", {"total": "w"})
    assert got.columns == ["g", "k", "w", "p", "total"]
    seen, sums = {}, {}
    expected = set()
    for g, k, w in sorted(rows, key=lambda r: r[1]):
        key = g if groups else 0
        seen[key] = seen.get(key, 0) + 1
        sums[key] = sums.get(key, 0) + w
        expected.add((g, k, seen[key], sums[key]))
    assert {(r.g, r.k, r.p, r.total) for r in got.collect()} == expected


def test_enrich_keeps_order_repeats_and_rows_without_codes(spark):
    coded = spark.createDataFrame(
        [("1", ["b", " a ", "zz", "a2"]), ("1", ["b", " a ", "zz", "a2"]), ("2", []), ("3", None), ("4", ["zz"])],
        "id string, codigos_abiertos array<string>",
    )
    label_map = spark.createDataFrame([("a", "A"), ("a2", "A"), ("b", "B")], "label string, code_id string")
    got = sorted((r.id, r.unified_code_ids) for r in ev.enrich_insights(coded, label_map).collect())
    assert got == [("1", ["B", "A", "A"]), ("1", ["B", "A", "A"]), ("2", []), ("3", []), ("4", [])]
    once = {r.id: r.unified_code_ids for r in ev.enrich_insights(coded, label_map, distinct=True).collect()}
    assert once["1"] == ["B", "A"]
    assert sorted((r.id, r.pos) for r in ev.unmatched_labels(coded, label_map).collect()) == [("1", 3), ("1", 3), ("4", 1)]


AXIAL = (
    "category_id string, category_name string, analysis struct<paradigm_model:struct<"
    + ",".join(f"{c}:array<struct<description:string,evidence_insight_ids:array<string>>>" for c in contracts.COMPONENTS)
    + ">,properties_and_dimensions:array<struct<property_name:string,property_description:string,dimensional_range:string,"
    "evidence_insight_ids:array<string>>>>"
)


def axial(spark):
    model_ = ([("why", ["1", "2"]), ("also", ["2"])], None, [], [("do", ["3"])], None)
    return spark.createDataFrame([("cat_1", "C", (model_, [("p", "about", "r", ["9", "1"])])), ("cat_2", "D", ((None,) * 5, None))], AXIAL)


def test_cited_ids_and_placeholder(spark):
    refs = ev.cited_ids(axial(spark))
    assert sorted((r.category_id, r.insight_id) for r in refs.collect()) == [("cat_1", x) for x in ("1", "2", "3", "9")]
    texts = spark.createDataFrame([("1", "one"), ("2", ""), ("3", "three")], "id string, text string")
    got = {r.insight_id: (r.text, r.found) for r in ev.resolve_texts(refs, texts).collect()}
    missing = "Referenced insight text not found for ID: "
    assert got == {"1": ("one", True), "2": (missing + "2", False), "3": ("three", True), "9": (missing + "9", False)}
    assert [r.insight_id for r in ev.unknown_evidence(refs, texts).collect()] == ["9"]


def test_axial_items_and_template_blocks(spark):
    items = ev.axial_items(axial(spark))
    blocks = {r.component: r for r in report.assembled_blocks(items).collect()}
    assert set(blocks) == {"causal_conditions", "action_strategies", "properties_and_dimensions"}
    first = blocks["causal_conditions"]
    assert (first.title, first.text, first.evidence_ids, first.block_ord) == ("Condiciones Causales", "why also", ["1", "2"], 1)


def test_evidence_parts_cover_everything_once(spark):
    rows = [("hot", f"i{n}", "x" * (n % 50 + 1)) for n in range(500)] + [("small", "i1", "yy")]
    df = spark.createDataFrame(rows, "category_id string, insight_id string, text string")
    got = ev.evidence_parts(df, limit=1000).collect()
    assert len(got) == len(rows)
    total = sum(len(t) for c, _, t in rows if c == "hot")
    hot = [r for r in got if r.category_id == "hot"]
    assert max(r.running_chars for r in hot) == total
    assert len({r.running_chars for r in hot}) == len(hot)
    per_part = {}
    for r in hot:
        per_part[r.part] = per_part.get(r.part, 0) + len(r.text)
    assert max(per_part.values()) < 1000 + 51 and sorted(per_part) == list(range(len(per_part)))
    assert all(r.within_budget == (r.running_chars <= 1000) for r in got)


def test_merge_by_name_and_id(spark):
    spec = "batch long, pos long, category_name string, description string, code_assignments array<struct<code_id:string>>"
    rows = [
        (0, 0, "A", "first", [("x",), ("y",), ("x",)]), (0, 1, "B", "b", []), (1, 0, "A", "second", [("z",), ("x",)]), (1, 1, "C", "c", [("x",)]),
    ]
    categories, codes = cat.merge_by_name(spark.createDataFrame(rows, spec).repartition(3))
    assert sorted(tuple(r)[:3] for r in categories.collect()) == [("cat_1", "A", "first"), ("cat_2", "B", "b"), ("cat_3", "C", "c")]
    assert sorted((r.category_id, r.code_id) for r in codes.collect()) == [("cat_1", "x"), ("cat_1", "y"), ("cat_1", "z"), ("cat_3", "x")]
    nested = {(r.category_id, r.part): [a.code_id for a in r.code_assignments] for r in cat.nested_categories(categories, codes, per_part=2).collect()}
    assert nested == {("cat_1", 0): ["x", "y"], ("cat_1", 1): ["z"], ("cat_2", 0): [], ("cat_3", 0): ["x"]}
    doubled = categories.union(spark.createDataFrame([("cat_1", "late", "late", 99)], categories.schema))
    merged, united = cat.merge_by_id(doubled, codes)
    assert {r.category_id: r.category_name for r in merged.collect()}["cat_1"] == "A"
    assert united.count() == 4


def test_known_or_seeds(spark):
    seeds = spark.createDataFrame([("S", "d", ["k"])], "category_name string, description string, keywords array<string>")
    known = spark.createDataFrame([("K", None)], "category_name string, description string")
    assert "keywords" in cat.known_or_seeds(known.limit(0), seeds).columns
    assert [tuple(r) for r in cat.known_or_seeds(known, seeds).collect()] == [("K", "")]


def test_narrative_parts_join_to_the_whole(spark):
    blocks = [("k", n, f"t{n}", f"x{n}") for n in range(7)] + [("k", 7, "", "no title"), ("k", 8, "no text", None)]
    df = spark.createDataFrame(blocks, "category_id string, pos long, title string, text string")
    whole = "\n\n---\n\n".join(f"**t{n}**\n\nx{n}" for n in range(7))
    assert report.full_narrative(df, "category_id").first().narrative == whole
    parts = sorted((r.part, r.narrative) for r in report.full_narrative(df, "category_id", per_part=3).collect())
    assert report.BLOCK_SEPARATOR.join(p for _, p in parts) == whole


def test_report_parts_join_to_the_whole(spark, tmp_path):
    from codeloom.sources.writers import write_report

    rows = [(f"c{n}", f"text {n}") for n in range(5)]
    df = spark.createDataFrame(rows, "category_name string, narrative string")
    whole = report.REPORT_HEAD + "".join(f"### {a}\n\n{b}\n\n---\n\n" for a, b in rows)
    parts = report.fallback_report(df, ["category_name"], max_chars=50)
    assert "".join(r.report for r in parts.orderBy("part").collect()) == whole
    write_report(parts, "report", str(tmp_path / "r"))
    files = sorted(tmp_path.glob("r/part-*"))
    assert "".join(f.read_text(encoding="utf-8") for f in files) == whole
    rule = "=" * 80
    corpus = "\n\n" + rule + "\n\n" + "".join(f"## CATEGORÍA: {a}\n\n{b}\n\n{rule}\n\n" for a, b in rows)
    assert report.corpus_text(df, ["category_name"]).first().corpus == corpus


def test_respond_isolates_failures_and_retries(spark):
    asked = spark.createDataFrame([(str(n), f"p{n}") for n in range(20)], "id string, prompt string").repartition(4)

    def failing(prompts, models):
        raise RuntimeError("down")

    got = model.respond(asked, failing).collect()
    assert len(got) == 20 and all(r.response is None and r.error == "RuntimeError: down" for r in got)

    def picky(prompts, models):
        return [None if p == "p7" else p for p in prompts]

    good, bad = model.respond_until_valid(asked, picky, F.col("response").isNotNull(), attempts=2)
    assert good.count() == 19 and [(r.id, r.attempt) for r in bad.collect()] == [("7", 2)]


def test_embed_leaves_failures_null(spark):
    df = spark.createDataFrame([("a",), ("bb",)], "label string")
    got = model.embed(df, "label", lambda texts: [[float(len(t)), 1.0] if len(t) > 1 else None for t in texts])
    assert sorted((r.label, r.embedding) for r in got.collect()) == [("a", None), ("bb", [2.0, 1.0])]

    def broken(texts):
        raise ValueError

    assert [r.embedding for r in model.embed(df, "label", broken).collect()] == [None, None]


def test_coverage_reports(spark):
    book = spark.createDataFrame([("x", "X"), ("y", "Y")], "id string, label string")
    codes = spark.createDataFrame([("c1", "x"), ("c2", "x"), ("c1", "q")], "category_id string, code_id string")
    assert [r.code_id for r in cat.orphan_codes(book, codes).collect()] == ["y"]
    assert [r.code_id for r in cat.unknown_codes(book, codes).collect()] == ["q"]
    assert [tuple(r) for r in cat.multi_category_codes(codes).collect()] == [("x", 2)]


def test_lineage_keeps_codes_without_category(spark):
    index = spark.createDataFrame([("x", "1", 1), ("y", "1", 2)], "code_id string, id_fragmento string, pos long")
    codes = spark.createDataFrame([("c1", "x")], "category_id string, code_id string")
    meta = spark.createDataFrame([("1", "m", "s")], "id string, method string, source string")
    got = sorted(tuple(r) for r in ev.lineage(index, codes, meta).collect())
    assert got == [("1", 1, "x", "c1", "m", "s"), ("1", 2, "y", None, "m", "s")]


def test_seed_config_tables(spark, tmp_path):
    from codeloom.sources import readers

    path = tmp_path / "config.json"
    config = {"research_questions": ["q1", "q2"], "seed_categories": [{"category_name": "A", "description": "d", "keywords": ["k1", "k2"]}]}
    path.write_text(json.dumps(config, ensure_ascii=False), encoding="utf-8")
    doc = readers.read_document(spark, str(path))
    assert [r.question for r in readers.research_questions(doc).orderBy("pos").collect()] == ["q1", "q2"]
    words = readers.seed_keywords(readers.seed_categories(doc)).orderBy("seed_ord").collect()
    assert [(w.keyword, w.category_name) for w in words] == [("k1", "A"), ("k2", "A")]
