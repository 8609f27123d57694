"""Phases with scripted models, and the incremental forms against the batch forms."""

import json

from pyspark.sql import functions as F

from codeloom.operators import categories as cat
from codeloom.operators import codebook as cb
from codeloom.operators import ingest, requests
from codeloom.plans import study
from codeloom.streaming import incremental

INSIGHTS = [("1", "I was walking and talking"), ("2", "we kept walking"), ("3", "nothing"), ("4", "no answer")]


def insights(spark):
    return spark.createDataFrame(INSIGHTS, "id string, text string").withColumn("src_ord", F.col("id").cast("long"))


def make_coder():
    def coder(prompts, models):
        import json as j
        import re

        out = []
        for p in prompts:
            asked = j.loads(p)
            if "no answer" in asked["fragmento_original"]:
                out.append("sorry")
                continue
            asked["codigos_abiertos"] = re.findall(r"\w+ing", asked["fragmento_original"])
            out.append("Here:\n```json\n" + j.dumps(asked) + "\n```")
        return out

    return coder


def test_code_with_model(spark):
    coded, failed = study.code_with_model(insights(spark), make_coder(), "{json_input}")
    got = {r.id: (r.text, r.codigos_abiertos, r.id_fragmento) for r in coded.collect()}
    assert got["1"] == (INSIGHTS[0][1], ["walking", "talking"], "1") and got["3"][1] == ["nothing"] and "4" not in got
    assert [(r.id, r.insight_original.text, r.error) for r in failed.collect()] == [("4", "no answer", "invalid response")]


def test_categorize_in_waves_tells_later_batches_what_was_found(spark):
    book = spark.createDataFrame([(f"c{n}", f"label {n}", None, None, 1, n) for n in range(5)], cb.SCHEMA)

    def responder(prompts, models):
        import json as j

        out = []
        for p in prompts:
            known, codes = (j.loads(x) for x in p.split("\n##\n"))
            name = known[-1]["category_name"] + "+"
            if any(c["code_id"] == "c4" for c in codes):
                out.append("[]")
                continue
            out.append(j.dumps([{"category_name": name, "is_new": True, "description": f"after {len(known)}", "code_assignments": codes}]))
        return out

    template = "{seed_categories_json}\n##\n{codes_to_categorize_json}"
    got = study.categorize_with_model(book, responder, template, [{"category_name": "S"}], batch_size=2)
    assert sorted((r.category_id, r.category_name) for r in got.categories.collect()) == [("cat_1", "S+"), ("cat_2", "S++")]
    assert sorted((r.category_id, r.code_id) for r in got.category_codes.collect()) == [("cat_1", "c0"), ("cat_1", "c1"), ("cat_2", "c2"), ("cat_2", "c3")]
    assert [(r.batch, r.reason) for r in got.rejects.collect()] == [(2, "empty_json")]
    only = spark.createDataFrame([("c1",)], "code_id string")
    few = study.categorize_with_model(book, responder, template, [{"category_name": "S"}], only=only)
    assert [r.code_id for r in few.category_codes.collect()] == ["c1"]


def test_analyse_narrate_synthesize(spark):
    categories = spark.createDataFrame([("cat_1", "Walks", None, 1), ("cat_2", "Empty", None, 2)], "category_id string, category_name string, description string, ord long")
    codes = spark.createDataFrame([("cat_1", "w"), ("cat_2", "zz")], "category_id string, code_id string")
    enriched = spark.createDataFrame([("1", ["w"]), ("2", ["w", "w"])], "id_fragmento string, unified_code_ids array<string>")

    def analyst(prompts, models):
        import json as j

        out = []
        for p in prompts:
            ids = sorted(e["id_fragmento"] for e in j.loads(p.split("##")[1]))
            out.append(j.dumps({"paradigm_model": {"context": [{"description": "d", "evidence_insight_ids": ids + ["ghost"]}]}}))
        return out

    axial, rejects = study.analyse_with_model(categories, codes, enriched, insights(spark), analyst, "{category_name}/{category_description}##{evidence_json}")
    rows = axial.collect()
    assert [(r.category_id, r.category_name, r.analysis.paradigm_model.context[0].evidence_insight_ids) for r in rows] == [("cat_1", "Walks", ["1", "2", "ghost"])]
    assert rejects.count() == 0

    def narrator(prompts, models):
        import json as j

        ids = [sorted(j.loads(p.split("##")[1])) for p in prompts]
        blocks = [[{"title": "T", "text": " ".join(i), "evidence_ids": i}, {"title": "", "text": "x"}] for i in ids]
        return [j.dumps({"narrative_blocks": b}) for b in blocks]

    narratives, lost = study.narrate_with_model(axial, insights(spark), narrator, "{category_name} {paradigm_model_json} {properties_json}##{evidence_json}")
    assert [b.text for b in narratives.first().narrative_blocks] == ["1 2 ghost", "x"] and lost.count() == 0
    _, lost = study.narrate_with_model(axial, insights(spark), lambda p, m: ['{"other": 1}'] * len(p), "{evidence_json}")
    assert [r.reason for r in lost.collect()] == ["no_narrative_blocks"]

    def writer(prompts, models):
        return [None if p.startswith("REPORT") else f"{m}: {p}" for p, m in zip(prompts, models)]

    done = study.synthesize(narratives, writer, "{category_name}|{full_narrative}", "REPORT{synthesized_narratives}", model="big").collect()
    assert len(done) == 1 and done[0].report.endswith("### Walks\n\nbig: Walks|**T**\n\n1 2 ghost\n\n---\n\n")
    final = study.synthesize(narratives, lambda p, m: ["text"] * len(p), "{full_narrative}", "REPORT{synthesized_narratives}").collect()
    assert [r.report for r in final] == ["text"]


def test_preprocess_writes_its_outputs(spark, tmp_path):
    src = spark.createDataFrame([(0, "a", "t", "m"), (1, None, "t", "m")], "src_ord long, ID string, InsightText string, Method string")
    done = study.preprocess(src, str(tmp_path))
    assert done.metadata.count() == 0 and not done.report.first().metadata_generated
    assert spark.read.json(str(tmp_path / "insights")).collect()[0].asDict() == {"id": "a", "text": "t"}
    assert spark.read.json(str(tmp_path / "rejects")).first().reason == "null_id"


def test_stream_resumes_without_repeating(spark, tmp_path):
    source, out, offsets = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "offsets")
    rows = insights(spark).select("id", "text")
    rows.filter("id < '3'").write.parquet(source)
    keeper = incremental.codebook_keeper(str(tmp_path / "book"), 0.6)

    def run():
        stream = incremental.insight_stream(spark.readStream, source, "id string, text string")
        incremental.code_stream(stream, out, offsets, after_batch=keeper)

    run()
    assert sorted(r.id for r in incremental.coded_so_far(spark, out).collect()) == ["1", "2"]
    first = {r.label: r.code_id for r in incremental.label_map(spark, str(tmp_path / "book")).collect()}
    rows.write.mode("append").parquet(source)  # all rows again: two of them are known
    run()
    coded = incremental.coded_so_far(spark, out)
    assert sorted(r.id for r in coded.collect()) == ["1", "2", "3", "4"]
    batch = ingest.open_code(rows).select("id", "codigos_abiertos")
    assert coded.select("id", "codigos_abiertos").exceptAll(batch).count() == 0
    later = {r.label: r.code_id for r in incremental.label_map(spark, str(tmp_path / "book")).collect()}
    assert first.items() <= later.items() and set(later) == {"walking", "talking", "nothing"}
    book = incremental.latest_codebook(spark, str(tmp_path / "book"))
    assert {r.id for r in book.collect()} == set(later.values())


def test_replayed_batch_replaces_itself(spark, tmp_path):
    out = str(tmp_path / "out")
    coded = incremental.rule_coder(insights(spark))
    for _ in range(2):
        coded.write.mode("overwrite").parquet(f"{out}/batch_id=0")
    assert incremental.coded_so_far(spark, out).count() == 4
    assert incremental.coded_so_far(spark, out, before=0).count() == 0


def test_repeated_ids_stay_one_row_each(spark):
    rows = spark.createDataFrame([("a", "walking here", 1), ("a", "no answer", 2), ("b", "talking", 3)], "id string, text string, src_ord long")
    coded, failed = study.code_with_model(rows, make_coder(), "{json_input}")
    assert sorted((r.id, r.text, *r.codigos_abiertos) for r in coded.collect()) == [("a", "walking here", "walking"), ("b", "talking", "talking")]
    assert [(r.id, r.insight_original.text) for r in failed.collect()] == [("a", "no answer")]


def test_parts_of_an_analysis_are_told_with_their_own_evidence(spark):
    def of(part, names):
        items = [{"description": n, "evidence_insight_ids": [n]} for n in names]
        model = {"causal_conditions": items, "context": [], "intervening_conditions": [], "action_strategies": [], "consequences": []}
        return ("c", "C", part, {"paradigm_model": model, "properties_and_dimensions": []})

    item = "array<struct<description:string,evidence_insight_ids:array<string>>>"
    paradigm = ",".join(f"{c}:{item}" for c in ("causal_conditions", "context", "intervening_conditions", "action_strategies", "consequences"))
    schema = (
        "category_id string, category_name string, part long, analysis struct<paradigm_model:struct<" + paradigm
        + ">,properties_and_dimensions:array<struct<property_description:string,evidence_insight_ids:array<string>>>>"
    )
    axial = spark.createDataFrame([of(0, ["a", "b"]), of(1, ["c"]), of(2, [])], schema)
    texts = spark.createDataFrame([(n, f"text {n}", k) for k, n in enumerate("abc")], "id string, text string, src_ord long")

    def narrator(prompts, models):
        import json as j

        out = []
        for p in prompts:
            ids = sorted(j.loads(p))
            out.append(j.dumps({"narrative_blocks": [{"title": f"t{i}", "text": f"of {','.join(ids)}", "evidence_ids": ids} for i in range(2)]}))
        return out

    told, lost = study.narrate_with_model(axial, texts, narrator, "{evidence_json}")
    assert lost.count() == 0 and told.count() == 3
    blocks = sorted((r.pos, r.title, r.text) for r in study.report.block_rows(told).collect())
    assert blocks == [(0, "t0", "of a,b"), (1, "t1", "of a,b"), (2, "t0", "of c"), (3, "t1", "of c"), (4, "t0", "of "), (5, "t1", "of ")]
    items = sorted((r.pos, r.description) for r in study.ev.axial_items(axial).collect())
    assert items == [(0, "a"), (1, "b"), (2, "c")]


def test_a_rerun_counts_nothing_twice(spark):
    rows = spark.createDataFrame([("1", "walking and talking"), ("2", "walking")], "id string, text string")
    nothing = spark.createDataFrame([], "id string, text string, id_fragmento string, fragmento_original string, codigos_abiertos array<string>")
    meta = spark.createDataFrame([], "id string, method string, source string")
    seeds = spark.createDataFrame([("walking", "Moving", 0)], "keyword string, category_name string, seed_ord long")
    first = study.run_study(rows, meta, nothing, cb.empty_codebook(spark), seeds)
    book = sorted((r.label, r["count"]) for r in first.merge.codebook.collect())
    again = study.run_study(rows, meta, first.coded, first.merge.codebook, seeds, label_map=first.merge.label_map)
    assert sorted((r.label, r["count"]) for r in again.merge.codebook.collect()) == book
    assert sorted(map(repr, again.enriched.select("id", "unified_code_ids").collect())) == sorted(map(repr, first.enriched.select("id", "unified_code_ids").collect()))


def test_waves_double_or_go_one_by_one(spark):
    book = spark.createDataFrame([(f"c{n}", f"label {n}", None, None, 1, n) for n in range(9)], cb.SCHEMA)

    def responder(prompts, models):
        import json as j

        out = []
        for p in prompts:
            known, codes = (j.loads(x) for x in p.split("\n##\n"))
            out.append(j.dumps([{"category_name": f"told {len(known)} {codes[0]['code_id']}", "is_new": True, "description": known[-1].get("description", ""), "code_assignments": codes}]))
        return out

    def names(**how):
        got = study.categorize_with_model(book, responder, "{seed_categories_json}\n##\n{codes_to_categorize_json}", [{"category_name": "S", "keywords": ["k"]}], batch_size=1, **how)
        return [(r.category_id, r.category_name) for r in got.categories.orderBy("ord").collect()]

    # Batches 0, 1-2, 3-6, 7-8 are told the seed, then the categories of all batches before their wave.
    assert [n for _, n in names()] == [f"told {told} c{k}" for k, told in enumerate([1, 1, 1, 3, 3, 3, 3, 7, 7])]
    assert [n for _, n in names(batches_per_wave=1)] == [f"told {max(k, 1)} c{k}" for k in range(9)]


def test_known_categories_read_as_the_first_of_each_name(spark):
    found = "category_name string, description string, batch long, pos long"
    one = cat.with_found(None, spark.createDataFrame([("b", "first b", 0, 1), ("a\"x", None, 0, 0), ("b", "later", 0, 2)], found))
    two = cat.with_found(one, spark.createDataFrame([("b", "no", 1, 0), ("c", "ü", 1, 1)], found))
    told = json.loads(requests.known_json(two, []).first().known_json)
    assert told == [{"category_name": 'a"x', "description": ""}, {"category_name": "b", "description": "first b"}, {"category_name": "c", "description": "ü"}]
    seeds = [{"category_name": "S", "keywords": ["k"]}]
    assert json.loads(requests.known_json(two.limit(0), seeds).first().known_json) == seeds


def test_report_keeps_the_order_of_the_categories(spark):
    ids = ["cat_10", "cat_2", "cat_1", "cat_11"]
    blocks = "array<struct<title:string,text:string,evidence_ids:array<string>>>"
    rows = [(i, f"name {i}", 0, 0, [("t", f"text {i}", [])], int(i[4:])) for i in ids]
    told = spark.createDataFrame(rows, f"category_id string, category_name string, part long, piece long, narrative_blocks {blocks}, ord long")

    def sections(narratives):
        done = study.synthesize(narratives, lambda p, m: [None if x.startswith("REPORT") else x for x in p], "{full_narrative}", "REPORT{synthesized_narratives}")
        return [line[4:] for line in done.first().report.split("\n") if line.startswith("### ")]

    assert sections(told) == ["name cat_1", "name cat_2", "name cat_10", "name cat_11"]
    named = {"cat_10": "Consecución de metas", "cat_2": "Acompañamiento", "cat_1": "Regulación y Gobernanza del Ecosistema Financiero", "cat_11": "Formación de hábitos"}
    known = told.drop("ord").withColumn("category_name", F.create_map(*[F.lit(x) for p in named.items() for x in p])[F.col("category_id")])
    assert sections(known) == ["Formación de hábitos", "Acompañamiento", "Regulación y Gobernanza del Ecosistema Financiero", "Consecución de metas"]
