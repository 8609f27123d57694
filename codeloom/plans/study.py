"""The phases of a study, each a composition of operators over tables."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions import parsing
from codeloom.operators import categories as cat
from codeloom.operators import codebook as cb
from codeloom.operators import contracts, ingest, report, requests, resume
from codeloom.operators import evidence as ev
from codeloom.operators.contracts import Split
from codeloom.operators.model import Responder, respond, respond_until_valid
from codeloom.operators.uniting import unite
from codeloom.plans.ledger import Ledger, Outcome, contents
from codeloom.session import cut_lineage, passing_tables, scratch_path
from codeloom.sources import writers
from codeloom.sources.codebook_log import CodebookLog


class Preprocessed(NamedTuple):
    insights: DataFrame
    metadata: DataFrame
    rejects: DataFrame
    report: DataFrame


def preprocess(src: DataFrame, out: str | None = None, ord_col: str = "src_ord") -> Preprocessed:
    """Clean a source table into insights, provenance, rejects and the run report."""
    valid, rejects = ingest.clean_insights(src, ord_col)
    metadata = ingest.metadata_registry(valid)
    if not ingest.has_metadata(src):
        metadata = metadata.limit(0)
    done = Preprocessed(valid.select("id", "text", "src_ord"), metadata, rejects, ingest.run_report(src, ord_col))
    if out:
        writers.write_jsonl(done.insights.select("id", "text"), f"{out}/insights")
        writers.write_metadata(done.metadata, f"{out}/metadata")
        writers.append_rejects(done.rejects, f"{out}/rejects")
    return done


def code_with_model(insights: DataFrame, responder: Responder, template: str) -> Split:
    """Open coding through a model: coded rows, and failed rows for the next run.

    A request is repeated up to three times while its response cannot be parsed and validated. Requests
    and answers go by row, as ids may repeat: by ``src_ord``, or where there is none each insight goes along with
    its request, so that no text has to be joined with its answer.
    """
    value = parsing.parse_strict(parsing.json_block(F.col("response")))
    usable = parsing.once(value, lambda v: (F.size(contracts.errors_of(contracts.CODING_RESULT, v)) == 0) & ~parsing.is_empty_value(v))
    by = "src_ord" if "src_ord" in insights.columns else "_insight"
    prompts = requests.coding_prompts(insights if by == "src_ord" else insights.withColumn(by, F.struct(*insights.columns)), template)
    good, bad = respond_until_valid(prompts, responder, usable, (by,))
    checked = contracts.validate_responses(good, contracts.CODING_RESULT, "response", (by,))
    failed = bad.select(by, F.coalesce("error", F.lit("invalid response")).alias("reason"))
    if by == "src_ord":
        return Split(resume.coded_rows(insights, checked.valid, by), resume.failed_rows(insights, failed, by))
    kept = [F.col(by)[c].alias(c) for c in insights.columns if c not in checked.valid.columns]
    coded = checked.valid.select(*kept, *[c for c in checked.valid.columns if c != by])
    return Split(resume.without_failed_codes(coded), resume.as_failed(failed.select(f"{by}.*", "reason")))


class Categorized(NamedTuple):
    categories: DataFrame
    category_codes: DataFrame
    rejects: DataFrame


def categorize_with_model(
    codebook: DataFrame,
    responder: Responder,
    template: str,
    seeds: list[dict],
    questions: list[str] = (),
    only: DataFrame | None = None,
    batch_size: int = cat.BATCH_SIZE,
    batches_per_wave: int | None = None,
) -> Categorized:
    """Categorize codes in batches; every wave of batches is told the categories found before it.

    Waves double in size (1, 2, 4, … batches), so their number is the logarithm of that of the batches; ``batches_per_wave=1``
    is the strictly sequential form. The known categories are a table merged wave by wave and put into the prompts as one
    row; results are written by wave to the shared folder. The driver sees the number of batches alone. The first wave is told the
    seeds, and so is every other until a category is known. Failed batches are rejected and their codes left over.
    """
    spark = codebook.sparkSession
    chosen = codebook if only is None else codebook.join(only.select(F.col("code_id").alias("id")), "id", "left_semi")
    batches = cut_lineage(cat.code_batches(chosen, batch_size))
    n_batches = (batches.agg(F.max("batch")).first()[0] or 0) + 1
    path = scratch_path(spark, "categorize")
    known: DataFrame | None = None
    offered: list[dict] | DataFrame = seeds
    first, size, wave = 0, batches_per_wave or 1, 0
    while first < n_batches:
        own = batches.filter((F.col("batch") >= first) & (F.col("batch") < first + size))
        answers = respond(requests.category_prompts(own, codebook, template, offered, questions), responder, ("batch",))
        good, bad = contracts.validate_list_responses(answers, contracts.CATEGORY_RESULT, "response", ("batch",))
        writers.write_version(good, f"{path}/results", wave)
        writers.write_version(bad, f"{path}/rejects", wave)
        first, wave = first + size, wave + 1
        size = batches_per_wave or 2 * size
        if first < n_batches:
            found = spark.read.parquet(f"{path}/results/version={wave - 1}")
            known = cut_lineage(cat.with_found(known, found))
            offered = requests.known_json(known, seeds)
    results, rejects = (spark.read.schema(df.schema).parquet(f"{path}/{name}").select(*df.columns) for name, df in (("results", good), ("rejects", bad)))
    return Categorized(*cat.merge_by_name(results), rejects)


def analyse_with_model(
    categories: DataFrame, category_codes: DataFrame, enriched: DataFrame, insights: DataFrame, responder: Responder, template: str, uniting: str | None = None
) -> Split:
    """Axial analysis per category and evidence part; categories without evidence are skipped.

    With a template ``uniting``, the same responder unites the parts of a category to one analysis; unusable answers of either kind
    are rejects.

    The parts of a category are one analysis whose lists go on from part to part: their items and narratives are
    numbered through by ``axial_items`` and ``report.block_rows``.
    """
    merged, codes = cat.merge_by_id(categories, category_codes)
    refs = ev.category_evidence(codes, ev.evidence_index(enriched)).withColumnRenamed("id_fragmento", "insight_id")
    refs = cut_lineage(refs)
    # Which request a text goes into follows from lengths alone; the texts move to their id and then to their request, and are not kept in between.
    placed = cut_lineage(ev.evidence_parts(ev.resolve_lengths(refs, ev.lengths_for(refs, insights))))
    resolved = ev.resolve_texts(placed, ev.texts_for(refs, insights))
    prompts = requests.axial_prompts(merged, resolved, template)
    answers = respond(prompts, responder, ("category_id", "category_name", "part"))
    split = contracts.validate_responses(answers, contracts.AXIAL_RESULT, "response", ("category_id", "category_name", "part"))
    split = split._replace(rejects=split.rejects.drop("category_name"))
    analysis = F.struct("paradigm_model", "properties_and_dimensions").alias("analysis")
    valid = split.valid.join(merged.select("category_id", "ord"), "category_id").select("category_id", "category_name", "part", analysis, "ord")
    if uniting is None:
        return Split(valid, split.rejects)
    united = unite(cut_lineage(valid), responder, uniting)
    lost = split.rejects.select("category_id", F.lit(0).cast("bigint").alias("round"), "part", "reason")
    return Split(united.valid, lost.unionByName(united.rejects))


def narrate_with_model(axial: DataFrame, insights: DataFrame, responder: Responder, template: str) -> Split:
    """Narrative blocks per analysis, told with the evidence that this analysis cites.

    Evidence beyond the size of one request goes on in the next ``piece``. A response without
    ``narrative_blocks`` is rejected. Where ``axial`` has an ``ord``, its categories' place in the report, narratives keep it.
    """
    refs = cut_lineage(ev.cited_ids(axial))
    resolved = ev.resolve_texts(refs, ev.texts_for(refs, insights))
    prompts = cut_lineage(requests.narrative_prompts(axial, resolved, template))
    answers = respond(prompts, responder, ("category_id", "category_name", "part", "piece"))
    parsed = parsing.with_parsed(answers, "response")
    found = F.try_variant_get("value", "$.narrative_blocks", "array<struct<title:string,text:string,evidence_ids:array<string>>>")
    keep = ["category_id", "category_name", "part", "piece"]
    rows = parsed.withColumn("narrative_blocks", F.when(F.col("status") == parsing.OK, found))
    reason = F.when(F.col("status") == parsing.OK, F.lit("no_narrative_blocks")).otherwise(F.col("status"))
    told = rows.filter(F.col("narrative_blocks").isNotNull()).select(*keep, "narrative_blocks")
    if "ord" in axial.columns:
        told = told.join(axial.groupBy("category_id").agg(F.min("ord").alias("ord")), "category_id")
    return Split(
        told,
        rows.filter(F.col("narrative_blocks").isNull()).select(*keep, reason.alias("reason")),
    )


def synthesize(narratives: DataFrame, responder: Responder, category_template: str, report_template: str, model: str | None = None) -> DataFrame:
    """The final report in parts: ``part, report``. Missing answers fall back to assembled text.

    Sections follow the ``ord`` of the narratives; without one, the fixed order of the report (unknown categories last) and then the id.
    """
    blocks = report.block_rows(narratives)
    if "ord" in narratives.columns:
        names = narratives.groupBy("category_id", "category_name").agg(F.min("ord").alias("section_ord"))
    else:
        known = report.in_report_order(narratives.select("category_id", "category_name").distinct(), report.clusters(narratives.sparkSession))
        names = known.select("category_id", "category_name", F.col("category_ord").alias("section_ord"))
    full = report.full_narrative(blocks, "category_id").join(names, "category_id")
    full = cut_lineage(full)
    answers = respond(requests.synthesis_prompts(full, category_template, model), responder, ("category_id", "part"))
    sections = cut_lineage(report.synthesized(full, answers, "category_id")).withColumnRenamed("part", "section_part")
    order = ["section_ord", "category_id", "section_part"]
    corpus = cut_lineage(report.corpus_text(sections, order))
    final = respond(requests.report_prompts(corpus, report_template, model), responder, ("part",))
    plain = report.fallback_report(sections, order)
    got = final.select("part", F.nullif("response", F.lit("")).alias("_r"))
    return plain.join(got, "part", "left").select("part", F.coalesce("_r", "report").alias("report"))


class Study(NamedTuple):
    coded: DataFrame
    merge: cb.Merge
    fit: DataFrame
    emergent: DataFrame
    category_codes: DataFrame
    enriched: DataFrame
    evidence: DataFrame
    lineage: DataFrame


def run_study(
    insights: DataFrame,
    metadata: DataFrame,
    done: DataFrame,
    codebook: DataFrame,
    seeds: DataFrame,
    theta: float = cb.THETA,
    cutoff: float = 0.5,
    label_map: DataFrame | None = None,
) -> Study:
    """The whole run without a model: rule-based codes, merged codebook, best-fit categories.

    ``insights(id, text)`` minus those in the checkpoint ``done`` are coded; codes that fit no
    seed keyword form new categories among themselves. ``label_map`` is that of earlier runs: only labels it lacks
    are merged and counted, and ``merge.label_map`` holds old and new.
    """
    todo = resume.pending(insights.select("id", "text"), done)
    new = ingest.open_code(todo).withColumns({"id_fragmento": F.col("id"), "fragmento_original": F.col("text")})
    coded = cut_lineage(resume.with_checkpoint(done, new))
    labels = ingest.distinct_labels(coded)
    if label_map is not None:
        labels = labels.join(label_map.select("label"), "label", "left_anti")
    merge = cb.merge_labels(labels, codebook, theta)
    if label_map is not None:
        merge = merge._replace(label_map=label_map.unionByName(merge.label_map, allowMissingColumns=True))
    book = cut_lineage(merge.codebook)
    fit, rest = cat.best_fit_by_keyword(book.select(F.col("id").alias("code_id"), "label"), seeds, cutoff)
    emergent = cat.emergent_categories(rest, cutoff)
    pairs = fit.select("category_name", "code_id").union(emergent.select("leader", "code_id"))
    codes = pairs.select(F.col("category_name").alias("category_id"), "code_id")
    enriched = ev.enrich_insights(coded, merge.label_map)
    index = ev.evidence_index(enriched)
    return Study(
        coded, merge._replace(codebook=book), fit, emergent, codes, enriched,
        ev.category_evidence(codes, index), ev.lineage(index, codes, metadata),
    )


class Models(NamedTuple):
    coder: Responder
    categorizer: Responder
    analyst: Responder


class Templates(NamedTuple):
    coding: str
    category: str
    axial: str


#: Insights coded between two commits: what a crash can cost.
ROWS_PER_COMMIT = 1_000_000


def run_pipeline(
    insights: DataFrame,
    root: str,
    models: Models,
    templates: Templates,
    seeds: list[dict],
    questions: Sequence[str] = (),
    theta: float = cb.THETA,
    embed=None,
    rows_per_commit: int = ROWS_PER_COMMIT,
) -> list[Outcome]:
    """The whole run with models over ``insights(id, text)``, under ``root``: what became of each phase.

    * coding: insights that no earlier run has coded, ``rows_per_commit`` at a time; tables ``coded`` and ``failed``. Failed ones are
      not in the checkpoint, so the next run asks for them again.
    * codebook: labels of new commits, merged into the log under ``<root>/codebook/book``.
    * categorize: the whole codebook anew; tables ``categories``, ``category_codes``, ``rejects``.
    * enrich: the newly coded insights with their codes; tables ``enriched``, ``unmatched``, and the JSON lines ``results``.
    * axial: one analysis per category and evidence part; tables ``axial``, ``rejects``.

    A phase whose inputs have not changed is skipped and asks nothing. Categorizing and the axial analysis may fail without ending the
    run. :class:`~codeloom.plans.ledger.Ledger` reads the tables back. ``insights`` should be a table: it is read several times
    rather than copied, and what a phase keeps for itself is deleted when it has been committed.
    """
    with passing_tables(insights.sparkSession):
        return _run_phases(insights, root, models, templates, seeds, questions, theta, embed, rows_per_commit)


def _run_phases(insights, root, models, templates, seeds, questions, theta, embed, rows_per_commit) -> list[Outcome]:
    spark = insights.sparkSession
    ledger = Ledger(spark, root)
    log = CodebookLog(spark, f"{ledger.root}/codebook/book")
    out = [_code_phase(ledger, insights, models.coder, templates.coding, rows_per_commit)]

    def after(phase: str) -> int:
        """The first coding commit that the last commit of ``phase`` had not seen."""
        last = ledger.last(phase)
        return 1 + int(last.source.split("coding ")[1].split(";")[0]) if last else 1

    coding = ledger.version("coding")
    if coding == "coding none":
        return out

    def build_codebook(number: int, path: str):
        new = ledger.read("coding", "coded", after("codebook"))
        merged = log.merge(number, ingest.distinct_labels(new), theta, embed)
        return {"label_map": merged.label_map, "rejects": merged.rejects}, 0

    out.append(ledger.run("codebook", coding, build_codebook))

    def build_categories(number: int, path: str):
        book = cut_lineage(log.read())
        done = categorize_with_model(book, models.categorizer, templates.category, seeds, questions)
        asked = -(-book.count() // cat.BATCH_SIZE)
        return {"categories": done.categories, "category_codes": done.category_codes, "rejects": done.rejects}, asked

    asked_with = hashlib.md5(json.dumps([templates.category, seeds, list(questions)], sort_keys=True, ensure_ascii=False).encode()).hexdigest()
    out.append(ledger.attempt("categorize", f"{ledger.version('codebook')}; {asked_with}", build_categories))

    def build_enriched(number: int, path: str):
        new = ledger.read("coding", "coded", after("enrich"))
        label_map = log.label_map()
        enriched = ledger.write(ev.enrich_insights(new, label_map), path, "enriched")
        writers.write_jsonl(enriched, f"{path}/results")
        return {"enriched": None, "unmatched": ev.unmatched_labels(new, label_map)}, 0

    out.append(ledger.run("enrich", f"{coding}; {ledger.version('codebook')}", build_enriched))

    def build_axial(number: int, path: str):
        done = analyse_with_model(
            ledger.latest("categorize", "categories"), ledger.latest("categorize", "category_codes"),
            ledger.read("enrich", "enriched"), insights, models.analyst, templates.axial,
        )
        answered = done.valid.select("category_id", "part").union(done.rejects.select("category_id", "part")).distinct()
        return {"axial": done.valid, "rejects": done.rejects}, answered.count()

    axial_source = f"{ledger.version('categorize')}; {ledger.version('enrich')}; {hashlib.md5(templates.axial.encode()).hexdigest()}"
    out.append(ledger.attempt("axial", axial_source, build_axial))
    return out


def _code_phase(ledger: Ledger, insights: DataFrame, coder: Responder, template: str, rows_per_commit: int) -> Outcome:
    """Code what is pending, in slices that are committed one by one."""
    done = ledger.read("coding", "coded")
    given = insights.select("id", "text")
    todo = given if done is None else resume.pending(given, done)
    n = todo.count()
    if not n and done is not None:
        return Outcome("coding", "skipped", 0, ledger.last("coding").rows)
    slices = max(1, -(-n // rows_per_commit))
    slice_of = F.pmod(F.xxhash64("id"), F.lit(slices))
    asked = rows = 0
    for k, (size, name) in enumerate(contents(todo, slice_of, slices)):

        def build(number: int, path: str):
            split = code_with_model(todo if slices == 1 else todo.where(slice_of == k), coder, template)
            return {"coded": split.valid, "failed": split.rejects}, size

        with passing_tables(ledger.spark):
            outcome = ledger.run("coding", f"{name} after {ledger.version('coding')}", build)
        asked, rows = asked + outcome.asked, rows + outcome.rows
    return Outcome("coding", "done", asked, rows)
