"""The registered queries: one per operator or phase, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import parsing
from codeloom.functions import text as T
from codeloom.operators import categories as cat
from codeloom.operators import codebook as cb
from codeloom.operators import contracts, ingest, model, report, requests, resume
from codeloom.operators import evidence as ev
from codeloom.operators.leaders import greedy_leaders
from codeloom.operators.ranking import with_position
from codeloom.operators.similarity import GramSpace, VectorSpace, matches_between
from codeloom.plans import inputs as inp
from codeloom.plans import study
from codeloom.plans.ledger import Ledger
from codeloom.session import cut_lineage, scratch_path
from codeloom.sources import readers, writers
from codeloom.sources.codebook_log import CodebookLog
from codeloom.streaming import incremental

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

LABEL_THETA = 0.65
SEED_CUTOFF = 0.65
CODING_TEMPLATE = "Code the actions in this fragment. Answer as {{\"codigos_abiertos\": [...]}}.\n{json_input}\n"
CATEGORY_TEMPLATE = (
    "Questions:\n{research_questions}\nKnown: {seed_categories_json}\nCodes: {codebook_map_json}\n"
    "Answer as [{{\"category_name\": \"...\"}}].\n{codes_to_categorize_json}\n"
)
AXIAL_TEMPLATE = "Category {category_name} ({category_description}). Cite ids, as {{\"paradigm_model\": {{}}}}.\n{evidence_json}\n"
QUESTIONS = ["What do people do?", "What holds them back?"]
REPORT_PART_CHARS = 200_000
KNOWN = [{"category_name": "Hábitos", "description": "Rutinas"}]


def query(fn: Query) -> Query:
    @wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        with inp.one_query():
            return fn(spark, sf_dir)

    REGISTRY[fn.__name__] = run
    return fn


def rounded(c: str, digits: int = 6):
    return F.round(F.col(c), digits).alias(c)


# Ingest -------------------------------------------------------------------------------------


@query
def ingest_clean(spark, d):
    return ingest.clean_insights(inp.insights_src(spark, d)).valid


@query
def ingest_rejects(spark, d):
    return ingest.clean_insights(inp.insights_src(spark, d)).rejects.select("src_ord", "reason")


@query
def ingest_report(spark, d):
    return ingest.run_report(inp.insights_src(spark, d))


@query
def ingest_metadata(spark, d):
    return ingest.metadata_registry(ingest.clean_insights(inp.insights_src(spark, d)).valid)


@query
def ingest_without_metadata(spark, d):
    return ingest.run_report(inp.insights_src(spark, d).drop("Method"))


@query
def source_check(spark, d):
    return ingest.source_check(inp.insights_src(spark, d))


@query
def insight_texts(spark, d):
    valid = ingest.clean_insights(inp.insights_src(spark, d)).valid
    return ingest.insight_texts(valid).select("id", F.md5("text").alias("text_md5"))


@query
def fragments(spark, d):
    rows = ingest.as_fragments(ingest.clean_insights(inp.insights_src(spark, d)).valid)
    return rows.select("src_ord", "id_fragmento", F.length("fragmento_original").cast("bigint").alias("n_chars"),
                       F.size("codigos_abiertos").cast("bigint").alias("n_codes"))


@query
def text_previews(spark, d):
    return inp.insights(spark, d).select("id", T.preview(F.col("text"), 50).alias("preview"))


# Sources and sinks --------------------------------------------------------------------------


@query
def csv_source(spark, d):
    """A source sheet as CSV with quotes and line breaks in its cells, its columns checked before anything runs."""
    path = scratch_path(spark, "sheet")
    rows = inp.insights_src(spark, d).select("src_ord", "ID", F.regexp_replace("InsightText", "\r", " ").alias("InsightText"), "Method", "Source")
    rows.write.options(header=True, quoteAll=True, escape='"', nullValue="\\N", emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    sheet = readers.read_table(spark, path, "csv", nullValue="\\N", emptyValue="")
    contracts.require_columns(sheet, ["ID", "InsightText"])
    clean = ingest.clean_insights(sheet.withColumn("src_ord", F.col("src_ord").cast("bigint"))).valid
    return clean.select("src_ord", "id", F.md5("text").alias("text_md5"), "method", "source")


@query
def config_fit(spark, d):
    """Codes fitted to the seeds of a project configuration, read back from its document; its questions as well."""
    path = scratch_path(spark, "config")
    words = inp.seeds(spark, d).groupBy("category_name").agg(F.array_sort(F.collect_list("keyword")).alias("keywords"))
    seeds = words.agg(F.array_sort(F.collect_list(F.struct("category_name", F.concat(F.lit("on "), "category_name").alias("description"), "keywords"))).alias("seed_categories"))
    questions = [r.lang for r in inp.table(spark, d, "documents").select("lang").distinct().orderBy("lang").collect() if r.lang]
    asked = F.array(*map(F.lit, questions)).alias("research_questions")
    document = seeds.select(F.to_json(F.struct(asked, "seed_categories")).alias("value"))
    document.coalesce(1).write.text(path)  # one document, as large as a configuration is
    config = cut_lineage(readers.read_document(spark, path))
    fit, _ = cat.best_fit_by_keyword(inp.codes(spark, d), readers.seed_keywords(readers.seed_categories(config)), SEED_CUTOFF)
    asked = readers.research_questions(config).select(F.col("question").alias("code_id"), F.lit("question").alias("category_name"), F.lit(None).cast("double").alias("score"))
    return fit.select("code_id", "category_name", rounded("score")).union(asked)


@query
def offered_categories(spark, d):
    """What a categorization prompt offers: the categories known, or the seeds before there are any."""
    known = cat.merge_by_name(_results(spark, d))[0]
    seeds = inp.seeds(spark, d).select("category_name", F.lit("a seed").alias("description")).distinct()
    both = cat.known_or_seeds(known, seeds).withColumn("offered", F.lit("known"))
    return both.union(cat.known_or_seeds(known.limit(0), seeds).withColumn("offered", F.lit("seeds")))


@query
def jsonl_round_trip(spark, d):
    path = scratch_path(spark, "insights")
    writers.write_jsonl(inp.insights(spark, d).select("id", "text"), path)
    return readers.read_jsonl(spark, path).select("id", F.md5("text").alias("text_md5"))


@query
def jsonl_append(spark, d):
    path = scratch_path(spark, "append")
    rows = inp.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("lang").alias("text"))
    writers.append_jsonl(rows.filter("text = 'en'"), path)
    writers.append_jsonl(rows.filter("text != 'en'"), path)
    return readers.read_jsonl_or_empty(spark, path)


@query
def append_once(spark, d):
    """Two runs append; the first is repeated with other rows, which take the place of its own."""
    path = scratch_path(spark, "append")
    rows = inp.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), "text", "lang")
    writers.append_once(rows.filter("lang = 'en'").select("id", "text"), path, "english")
    writers.append_once(rows.filter("lang != 'en'").select("id", "text"), path, "others")
    writers.append_once(rows.filter("lang = 'en'").select("id", F.upper("lang").alias("text")), path, "english")
    return readers.read_appended(spark, path).select("id", F.md5("text").alias("text_md5"), "run_id")


def _checkpoint_lines(spark, d, path):
    """Coded rows as lines, every seventh one cut off as by a crash."""
    rows = inp.coded_once(spark, d).withColumn("id", F.col("doc_id").cast("string"))
    line = T.to_json(F.struct("id", "codigos_abiertos"))
    cut = F.when(F.col("doc_id") % 7 == 3, F.substring(line, 1, 12)).otherwise(line)
    rows.select(cut.alias("value")).write.text(path)


@query
def checkpoint_scan(spark, d):
    path = scratch_path(spark, "checkpoint")
    _checkpoint_lines(spark, d, path)
    return readers.read_checkpoint(spark, path).valid.select("id", F.size("codigos_abiertos").cast("bigint").alias("n_codes"))


@query
def checkpoint_corrupt(spark, d):
    path = scratch_path(spark, "checkpoint")
    _checkpoint_lines(spark, d, path)
    return readers.read_checkpoint(spark, path).rejects.groupBy("line").agg(F.count(F.lit(1)).alias("n"))


@query
def metadata_registry_file(spark, d):
    path = scratch_path(spark, "metadata")
    writers.write_metadata(ingest_metadata(spark, d), path)
    entry = F.from_json("value", "map<string,struct<method:string,source:string>>")
    return spark.read.text(path).select(F.explode(entry).alias("id", "m")).select("id", "m.method", "m.source")


@query
def codebook_file(spark, d):
    path = scratch_path(spark, "codebook")
    book = with_position(inp.codes(spark, d), ["label"], name="ord").select(
        F.col("code_id").alias("id"), "label", F.lit(None).cast("string").alias("description"),
        F.lit(None).cast("array<float>").alias("embedding"), F.col("n").alias("count"), "ord",
    )
    writers.write_codebook(book, path)
    back = readers.read_jsonl(spark, path, cb.SCHEMA + ", embedding_dim bigint")
    return back.select("id", "label", "description", "count", "ord", "embedding_dim")


@query
def codebook_round_trip(spark, d):
    """A codebook as written is read back, with the length of its vectors."""
    path = scratch_path(spark, "codebook")
    book = with_position(inp.codes(spark, d), ["label"], name="ord").select(
        F.col("code_id").alias("id"), "label", F.concat(F.lit('a "label"\n'), "label").alias("description"),
        F.array(F.length("label") / 4, F.lit(0.5)).cast("array<float>").alias("embedding"), F.col("n").alias("count"), "ord",
    )
    writers.write_codebook(book, path, embedding_dim=2)
    back = readers.read_codebook(spark, path)
    dim = F.lit(readers.read_embedding_dim(spark, path)).alias("embedding_dim")
    return back.select("id", "label", "description", F.col("embedding")[0].cast("double").alias("first"), "count", "ord", dim)


@query
def categories_round_trip(spark, d):
    """Categories as written are read back; one without a name is a reject."""
    path = scratch_path(spark, "categories")
    lists = inp.category_codes(spark, d).groupBy("category_id").agg(F.collect_list(F.struct("code_id")).alias("code_assignments"))
    named = inp.categories(spark, d).withColumn("category_name", F.when(F.col("ord") != 3, F.col("category_name")))
    writers.write_categories(named.join(lists, "category_id").select("category_id", "category_name", "code_assignments", "ord"), path)
    valid, rejects = readers.read_categories(spark, path)
    none = F.lit(None)
    return valid.select("ord", "category_name", F.size("code_assignments").cast("bigint").alias("n_codes"), F.lit(True).alias("valid")).union(
        rejects.select("ord", none.cast("string"), none.cast("bigint"), F.lit(False))
    )


@query
def failed_sink(spark, d):
    path = scratch_path(spark, "failed")
    split = contracts.validate_responses(inp.responses(spark, d), contracts.CODING_RESULT, "response", ("doc_id",))
    rows = inp.insights(spark, d)
    bad = split.rejects.select(F.col("doc_id").cast("string").alias("id"), "reason")
    writers.append_rejects(resume.failed_rows(rows, bad), path, run_id="r1")
    back = readers.read_jsonl(spark, path, "id string, insight_original struct<id:string,text:string>, error string, run_id string")
    return back.select("id", "insight_original.id", F.md5("insight_original.text").alias("text_md5"), "error", "run_id").toDF(
        "id", "original_id", "text_md5", "error", "run_id"
    )


# Open coding --------------------------------------------------------------------------------


@query
def open_codes(spark, d):
    return ingest.exploded_codes(inp.coded_once(spark, d), ["doc_id"])


@query
def label_counts(spark, d):
    return ingest.distinct_labels(inp.coded_once(spark, d))


@query
def distinct_labels(spark, d):
    return ingest.distinct_labels(inp.coded_once(spark, d)).select("label")


@query
def code_rule_violations(spark, d):
    """Rule check over all action words of a text, uncapped, plus its language name as a non-action code."""
    docs = inp.table(spark, d, "documents").select("doc_id", "text", "lang")
    rows = ingest.open_code(docs, max_codes=2_000_000_000)
    with_theme = F.concat("codigos_abiertos", F.array("lang"))
    return rows.select("doc_id", F.inline(T.code_violations(with_theme)))


# Resume -------------------------------------------------------------------------------------


def _done(spark, d):
    """Documents of three sources are in the checkpoint, older rows by ``id_fragmento`` only."""
    docs = inp.table(spark, d, "documents").filter(F.col("source").isin("src1", "src2", "src3"))
    key = F.col("doc_id").cast("string")
    return docs.select(F.when(F.col("lang") == "en", key).otherwise(F.lit("")).alias("id"), key.alias("id_fragmento"))


@query
def resume_pending(spark, d):
    return resume.pending(inp.insights(spark, d).select("id", "src_ord"), _done(spark, d))


@query
def resume_union(spark, d):
    todo = resume.pending(inp.insights(spark, d).select("id"), _done(spark, d))
    both = resume.with_checkpoint(_done(spark, d), todo)
    return both.select(F.coalesce(F.nullif("id", F.lit("")), "id_fragmento").alias("id"), F.col("id_fragmento").isNotNull().alias("from_checkpoint"))


# Responses ----------------------------------------------------------------------------------


@query
def response_extract(spark, d):
    parsed = parsing.with_parsed(inp.responses(spark, d), "response")
    return parsed.select("doc_id", F.md5("block").alias("block_md5"), "status")


@query
def response_rejects(spark, d):
    split = contracts.validate_responses(inp.responses(spark, d), contracts.CODING_RESULT, "response", ("doc_id",))
    return split.rejects.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def _coding_valid(spark, d):
    return contracts.validate_responses(inp.responses(spark, d), contracts.CODING_RESULT, "response", ("doc_id",)).valid


@query
def coding_valid(spark, d):
    return _coding_valid(spark, d).select(
        "doc_id", "id_fragmento", "fragmento_original", F.array_join("codigos_abiertos", "|").alias("codes"), "error"
    )


@query
def echo_mismatch(spark, d):
    """Coders that echo the id but, for two rows in three, another text."""
    told = F.when(F.col("doc_id") % 3 == 0, F.col("doc_id")).otherwise(F.col("n_chars"))
    asked = inp.table(spark, d, "documents").select(
        "doc_id", F.col("doc_id").cast("string").alias("id"), F.concat(F.lit("doc "), told.cast("string")).alias("text")
    )
    return contracts.echo_mismatches(asked, _coding_valid(spark, d), "doc_id")


@query
def record_merge(spark, d):
    left = inp.table(spark, d, "documents").select("doc_id", "lang", F.lit("old").alias("fragmento_original"))
    merged = resume.merge_records(left, _coding_valid(spark, d), "doc_id")
    return merged.select("doc_id", "lang", "fragmento_original", "id_fragmento")


@query
def error_projection(spark, d):
    docs = inp.table(spark, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("id"), "text", "lang")
    results = ingest.open_code(docs).select("id", "codigos_abiertos", F.when(F.col("lang") != "en", "unsupported").alias("error"))
    rows = resume.coded_rows(docs.select("id", "doc_id"), results)
    return rows.select("doc_id", F.size("codigos_abiertos").cast("bigint").alias("n_codes"), "error")


@query
def category_valid(spark, d):
    split = contracts.validate_list_responses(inp.category_responses(spark, d), contracts.CATEGORY_RESULT, "response", ("doc_id",))
    return split.valid.select("doc_id", "pos", "category_name", "is_new", "description", F.size("code_assignments").cast("bigint").alias("n_codes"))


@query
def category_rejects(spark, d):
    split = contracts.validate_list_responses(inp.category_responses(spark, d), contracts.CATEGORY_RESULT, "response", ("doc_id",))
    return split.rejects.select("doc_id", "reason", F.array_join("errors", ",").alias("errors"))


@query
def axial_valid(spark, d):
    split = contracts.validate_responses(inp.axial_responses(spark, d), contracts.AXIAL_RESULT, "response", ("doc_id",))
    axial = split.valid.select(
        F.col("doc_id").alias("category_id"), F.struct("paradigm_model", "properties_and_dimensions").alias("analysis")
    )
    return ev.cited_ids(axial).select(F.col("category_id").alias("doc_id"), "insight_id")


@query
def axial_rejects(spark, d):
    split = contracts.validate_responses(inp.axial_responses(spark, d), contracts.AXIAL_RESULT, "response", ("doc_id",))
    return split.rejects.select("doc_id", "reason", F.array_join("errors", ",").alias("errors"))


@query
def codebook_invalid(spark, d):
    records = parsing.computed(inp.code_records(spark, d), value=parsing.parse_strict(F.col("record")))
    split = contracts.validate(records, contracts.CODE, keep=("doc_id",))
    return split.rejects.select("doc_id", F.array_join("errors", ",").alias("errors"))


@query
def codebook_valid(spark, d):
    records = parsing.computed(inp.code_records(spark, d), value=parsing.parse_strict(F.col("record")))
    split = contracts.validate(records, contracts.CODE, keep=("doc_id",))
    return split.valid.select("doc_id", "id", "label", "count", F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x).alias("vector_sum"))


def _insight_lines(spark, d):
    path = scratch_path(spark, "enriched")
    inp.insight_records(spark, d).write.text(path)
    return readers.read_jsonl_checked(spark, path, contracts.INSIGHT)


@query
def insight_valid(spark, d):
    """Enriched insights read back under their contract."""
    return _insight_lines(spark, d).valid.select("id_fragmento", "fragmento_original", F.array_join("unified_code_ids", ",").alias("ids"))


@query
def insight_rejects(spark, d):
    return _insight_lines(spark, d).rejects.groupBy(F.array_join("errors", ",").alias("errors")).agg(F.count(F.lit(1)).alias("n"))


@query
def category_contract_rejects(spark, d):
    """The items of categorization responses lack a ``category_id``: each is rejected by the category contract."""
    parsed = parsing.with_parsed(inp.category_responses(spark, d), "response")
    items = F.try_variant_get("value", "$", "array<variant>")
    rows = parsed.select("doc_id", F.posexplode(items).alias("pos", "value")).withColumn("pos", F.col("pos").cast("bigint"))
    bad = contracts.validate(rows, contracts.CATEGORY, keep=("doc_id", "pos")).rejects
    return bad.select("doc_id", "pos", F.array_join("errors", ",").alias("errors"))


# Codebook -----------------------------------------------------------------------------------


def _book(spark, d):
    placed = with_position(inp.established(spark, d), ["label"], name="ord")
    return cut_lineage(placed.select(
        F.col("code_id").alias("id"), "label", F.lit(None).cast("string").alias("description"),
        F.lit(None).cast("array<float>").alias("embedding"), F.lit(None).cast("bigint").alias("count"), "ord",
    ))


@query
def label_exact_match(spark, d):
    labels = inp.codes(spark, d).select("label")
    book = inp.established(spark, d).select("label", F.col("code_id").alias("id"), F.lit(1).alias("ord"))
    return cb.exact_matches(labels, book)


@query
def label_new(spark, d):
    return cb.new_labels(inp.codes(spark, d).select("label"), inp.established(spark, d))


def _label_matches(spark, d, best):
    placed = cut_lineage(with_position(inp.codes(spark, d), ["label"], name="ord").select("label", "n", "ord"))
    new, old = placed.filter("n = 1"), placed.filter("n > 1")
    found = matches_between(GramSpace, new, old, LABEL_THETA, best)
    names_i, names_j = new.select(F.col("ord").alias("i"), "label"), old.select(F.col("ord").alias("j"), F.col("label").alias("code_label"))
    return found.join(names_i, "i").join(names_j, "j").select("label", "code_label", rounded("sim"))


@query
def label_pairs_sparse(spark, d):
    return _label_matches(spark, d, best=False)


@query
def nearest_code(spark, d):
    return _label_matches(spark, d, best=True)


def _vectors(spark, d):
    return inp.table(spark, d, "embeddings").select(F.col("vec_id").alias("ord"), "embedding", "label")


@query
def vector_pairs(spark, d):
    """Vectors against one code per label, its first vector."""
    v = _vectors(spark, d)
    codes = v.groupBy("label").agg(F.min_by("embedding", "ord").alias("embedding"), F.min("ord").alias("ord"))
    found = matches_between(VectorSpace, v, codes, 0.2)
    return found.select(F.col("i").alias("vec_id"), F.col("j").alias("code_vec_id"), rounded("sim"))


def _merge_vectors(spark, d, theta):
    v = _vectors(spark, d)
    space = VectorSpace.build(v, theta)
    leaders = greedy_leaders(space, space.entries)
    led = space.entries.join(leaders, "ord", "left_anti")
    best = cb.nearest_code(space, led, space.entries.join(leaders, "ord", "left_semi"))
    own = leaders.select(F.col("ord").alias("i"), F.col("ord").alias("j"), F.lit(None).cast("double").alias("sim"))
    return own.union(best.select("i", "j", "sim")).select(F.col("i").alias("vec_id"), F.col("j").alias("code_vec_id"), rounded("sim"))


@query
def merge_vectors_030(spark, d):
    return _merge_vectors(spark, d, 0.30)


@query
def merge_vectors_090(spark, d):
    return _merge_vectors(spark, d, 0.90)


@query
def merge_labels(spark, d):
    labels = ingest.distinct_labels(inp.coded(spark, d))
    merged = cb.merge_labels(labels, _book(spark, d), LABEL_THETA)
    return merged.label_map.select("label", "code_id", "match_kind", rounded("sim"))


@query
def merge_labels_first_run(spark, d):
    labels = ingest.distinct_labels(inp.coded(spark, d))
    merged = cb.merge_labels(labels, cb.empty_codebook(spark), LABEL_THETA)
    return merged.label_map.select("label", "code_id", "match_kind", rounded("sim"))


@query
def codebook_counts(spark, d):
    labels = ingest.distinct_labels(inp.coded(spark, d))
    merged = cb.merge_labels(labels, _book(spark, d), LABEL_THETA)
    return merged.codebook.select("id", "label", "count")


@query
def code_ids(spark, d):
    return inp.codes(spark, d).select("label", "code_id")


@query
def embed_labels(spark, d):
    from codeloom.functions.ngrams import counted, grams_of

    grams = inp.codes(spark, d).select("label", grams_of(F.col("label")).alias("all"))
    return grams.select("label", F.inline(counted(F.col("all"))))


# Enrichment and evidence --------------------------------------------------------------------


def _part_map(spark, d):
    """A label map that lacks the labels used only once."""
    return inp.established(spark, d).select("label", "code_id")


@query
def enrich_insights(spark, d):
    rows = ev.enrich_insights(inp.coded(spark, d), _part_map(spark, d))
    return rows.select("doc_id", F.array_join("unified_code_ids", ",").alias("code_ids"), F.size("unified_code_ids").cast("bigint").alias("n_ids"))


@query
def unmatched_labels(spark, d):
    rows = inp.coded(spark, d).withColumn("id", F.col("doc_id").cast("string"))
    return ev.unmatched_labels(rows, _part_map(spark, d))


@query
def evidence_index(spark, d):
    return inp.evidence(spark, d)


@query
def evidence_by_category(spark, d):
    return ev.category_evidence(inp.category_codes(spark, d), inp.evidence(spark, d))


@query
def evidence_empty(spark, d):
    """Categories with no evidence in the texts of one language."""
    english = inp.table(spark, d, "documents").filter("lang = 'de'").select(F.col("doc_id").cast("string").alias("id_fragmento"))
    some = inp.evidence(spark, d).join(english, "id_fragmento", "left_semi")
    found = ev.category_evidence(inp.category_codes(spark, d), some)
    return ev.without_evidence(inp.category_codes(spark, d).select("category_id").distinct(), found)


@query
def evidence_ids(spark, d):
    return inp.axial_items(spark, d).select("category_id", "insight_id").distinct()


def _resolved(spark, d):
    refs = cut_lineage(evidence_ids(spark, d))
    return ev.resolve_texts(refs, ev.texts_for(refs, inp.insights(spark, d)))


@query
def evidence_text(spark, d):
    return _resolved(spark, d).select("category_id", "insight_id", F.md5("text").alias("text_md5"), "found")


@query
def evidence_budget(spark, d):
    return ev.evidence_budget(_resolved(spark, d))


@query
def evidence_parts(spark, d):
    return ev.evidence_parts(_resolved(spark, d)).select("category_id", "insight_id", "running_chars", "within_budget", "part")


@query
def unknown_evidence(spark, d):
    return ev.unknown_evidence(evidence_ids(spark, d), inp.insights(spark, d).select("id"))


@query
def lineage(spark, d):
    return ev.lineage(inp.evidence(spark, d), inp.category_codes(spark, d), ingest_metadata(spark, d))


# Categories ---------------------------------------------------------------------------------


@query
def code_batches(spark, d):
    placed = with_position(inp.codes(spark, d), ["label"], name="ord").select(F.col("code_id").alias("id"), "ord")
    return cat.code_batches(placed)


def _results(spark, d):
    split = contracts.validate_list_responses(inp.category_responses(spark, d), contracts.CATEGORY_RESULT, "response", ("doc_id",))
    return cut_lineage(split.valid.withColumnRenamed("doc_id", "batch"))


@query
def categories_by_name(spark, d):
    categories, codes = cat.merge_by_name(_results(spark, d))
    sizes = codes.groupBy("category_id").agg(F.count(F.lit(1)).alias("n_codes"))
    return categories.join(sizes, "category_id", "left").select("category_name", "description", F.coalesce("n_codes", F.lit(0)).alias("n_codes"))


@query
def category_ids(spark, d):
    return cat.merge_by_name(_results(spark, d))[0].select("category_id", "category_name")


@query
def category_first_codes(spark, d):
    return cat.merge_by_name(_results(spark, d))[1].select("category_id", "code_id", "batch", "pos", "code_pos")


@query
def categories_by_id(spark, d):
    """Documents as category rows that repeat their id, the language."""
    docs = inp.table(spark, d, "documents")
    rows = docs.select(
        F.col("lang").alias("category_id"), F.col("source").alias("category_name"), F.concat(F.lit("from "), "source").alias("description"), F.col("doc_id").alias("ord")
    )
    codes = inp.open_codes(spark, d).join(docs.select("doc_id", F.col("lang").alias("category_id")), "doc_id").select("category_id", F.col("label").alias("code_id"))
    merged, united = cat.merge_by_id(rows, codes)
    sizes = united.groupBy("category_id").agg(F.count(F.lit(1)).alias("n_codes"))
    return merged.join(sizes, "category_id", "left").select("category_id", "category_name", "description", F.coalesce("n_codes", F.lit(0)).alias("n_codes"))


@query
def nested_categories(spark, d):
    rows = inp.categories(spark, d).withColumn("description", F.lit(None).cast("string"))
    nested = cat.nested_categories(rows, inp.category_codes(spark, d))
    ids = F.array_join(F.transform("code_assignments", lambda a: a["code_id"]), ",")
    return nested.select("category_id", "part", "category_name", F.md5(ids).alias("codes_md5"), F.size("code_assignments").cast("bigint").alias("n_codes"))


def _seed_fit(spark, d):
    return cat.best_fit_by_keyword(inp.codes(spark, d), inp.seeds(spark, d), SEED_CUTOFF)


@query
def best_fit_keywords(spark, d):
    return _seed_fit(spark, d)[0].select("code_id", "category_name", rounded("score"))


@query
def emergent_codes(spark, d):
    return cat.emergent_categories(_seed_fit(spark, d)[1], SEED_CUTOFF)


@query
def best_fit_vectors(spark, d):
    v = inp.table(spark, d, "embeddings")
    centers = cat.centroids(v.select(F.col("label").alias("category"), "embedding"))
    fit = cat.best_fit_by_vector(v.select(F.col("vec_id").alias("item_id"), "embedding"), centers, 0.1)
    return fit.select("item_id", "category", rounded("score", 4))


@query
def orphan_codes(spark, d):
    book = inp.codes(spark, d).select(F.col("code_id").alias("id"), "label")
    some = inp.category_codes(spark, d).filter("category_id != 'cat_6'")
    return cat.orphan_codes(book, some)


@query
def unknown_codes(spark, d):
    book = inp.established(spark, d).select(F.col("code_id").alias("id"))
    return cat.unknown_codes(book, inp.category_codes(spark, d)).select("category_id", "code_id")


@query
def multi_category_codes(spark, d):
    return cat.multi_category_codes(inp.category_codes(spark, d))


# Requests and responses of models -----------------------------------------------------------


@query
def prompt_coding(spark, d):
    rows = requests.coding_prompts(inp.insights(spark, d), CODING_TEMPLATE)
    return rows.select("id", F.md5("prompt").alias("prompt_md5"))


@query
def prompt_category_batch(spark, d):
    book = cut_lineage(with_position(inp.codes(spark, d), ["label"], name="ord").select(F.col("code_id").alias("id"), "label", "ord"))
    rows = requests.category_prompts(cat.code_batches(book), book, CATEGORY_TEMPLATE, KNOWN, QUESTIONS)
    return rows.select("batch", F.md5("prompt").alias("prompt_md5"))


@query
def prompt_axial(spark, d):
    rows = inp.categories(spark, d).withColumn("description", F.lit(""))
    prompts = requests.axial_prompts(rows, _resolved(spark, d), AXIAL_TEMPLATE)
    return prompts.select("category_id", "part", F.md5("prompt").alias("prompt_md5"))


@query
def replay_respond(spark, d):
    asked = inp.insights(spark, d).select("id")
    recorded = inp.responses(spark, d).select(F.col("doc_id").cast("string").alias("id"), "response")
    return model.replay(asked, recorded).select("id", F.md5("response").alias("response_md5"), "error")


@query
def model_respond(spark, d):
    asked = inp.table(spark, d, "documents").select(
        F.col("doc_id").cast("string").alias("id"), F.col("text").alias("prompt"), F.when(F.col("lang") == "fr", "advanced").alias("model")
    )

    def responder(prompts, models):
        return [None if len(p) % 5 == 0 else f"{m or 'default'}:{len(p)}" for p, m in zip(prompts, models)]

    return model.respond(asked, responder).select("id", "response", "error")


@query
def retry_rejects(spark, d):
    """A responder that leaves out some texts at every try and answers the rest at once."""
    asked = inp.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("prompt"))

    def responder(prompts, models):
        return [None if len(p) % 5 == 0 else str(len(p)) for p in prompts]

    good, bad = model.respond_until_valid(asked, responder, F.col("response").isNotNull())
    return good.select("id", "response", "attempt").union(bad.select("id", "response", "attempt"))


@query
def model_failures(spark, d):
    """A model that breaks on some texts: only these go without an answer."""
    asked = inp.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("prompt"))

    def responder(prompts, models):
        if any(len(p) % 11 == 0 for p in prompts):
            raise ValueError("bad prompt")
        return [f"{len(p)} characters" for p in prompts]

    return model.respond(asked, responder).select("id", "response", "error")


@query
def coding_run(spark, d):
    """Open coding through a model over insights with repeated ids: a row for each insight, coded or failed."""
    rows = ingest.clean_insights(inp.insights_src(spark, d)).valid.select("id", "text", "src_ord")

    def coder(prompts, models):
        import json

        out = []
        for p in prompts:
            asked = json.loads(p)
            asked["codigos_abiertos"] = [f"length {len(asked['fragmento_original'])}"]
            out.append("no answer" if len(asked["fragmento_original"]) % 7 == 0 else "```json\n" + json.dumps(asked) + "\n```")
        return out

    coded, failed = study.code_with_model(rows, coder, "{json_input}")
    none = F.lit(None).cast("string")
    return coded.select("id", F.md5("text").alias("text_md5"), F.col("codigos_abiertos")[0].alias("code"), none.alias("error")).union(
        failed.select("id", F.md5("insight_original.text"), none, "error")
    )


@query
def merge_embedded(spark, d):
    """Labels merged on a model's vectors; those that the model gives none for are rejected."""

    def embedder(texts):
        return [None if len(t) % 7 == 0 else [float(k == len(t) % 7) for k in range(7)] for t in texts]

    labels = inp.codes(spark, d).select("label", "n")
    merge = cb.merge_labels(labels, cb.empty_codebook(spark), 0.9, embed=lambda df: model.embed(df, "label", embedder))
    none = F.lit(None)
    return merge.label_map.select("label", "code_id", "match_kind", F.round("sim", 6).alias("sim")).union(
        merge.rejects.select("label", none.cast("string"), "reason", none.cast("double"))
    )


@query
def merge_embedded_prior(spark, d):
    """Labels merged on vectors into a codebook of which some codes have none: those take no part, but their own labels are found."""

    def embedder(texts):
        return [None if len(t) % 7 == 0 else [float(k == len(t) % 7) for k in range(7)] for t in texts]

    book = _book(spark, d)
    class_of = F.length("label") % 7
    vector = F.transform(F.sequence(F.lit(0), F.lit(6)), lambda k: (k == class_of).cast("float"))
    book = cut_lineage(book.withColumn("embedding", F.when(F.length("label") % 2 == 0, vector)))
    labels = inp.codes(spark, d).select("label", "n")
    merge = cb.merge_labels(labels, book, 0.9, embed=lambda df: model.embed(df, "label", embedder))
    none = F.lit(None)
    return merge.label_map.select("label", "code_id", "match_kind", rounded("sim")).union(
        merge.rejects.select("label", none.cast("string"), "reason", none.cast("double"))
    )


@query
def categorize_run(spark, d):
    """Categories through a model over the whole codebook, and over some of its codes."""
    book = with_position(inp.codes(spark, d), ["label"], name="ord").select(F.col("code_id").alias("id"), "label", "ord")

    def responder(prompts, models):
        import json

        out = []
        for p in prompts:
            asked, names = (json.loads(x) for x in p.split("##"))
            groups = {}
            for c in asked:
                groups.setdefault(f"length {len(names[c['code_id']]) % 5}", []).append(c)
            out.append(json.dumps([{"category_name": k, "is_new": True, "description": k, "code_assignments": v} for k, v in groups.items()]))
        return out

    def run(only):
        done = study.categorize_with_model(book, responder, "{codes_to_categorize_json}##{codebook_map_json}", KNOWN, only=only)
        return done.category_codes.join(done.categories, "category_id").select("category_name", "code_id")

    some = book.where(F.col("label").contains("er")).select(F.col("id").alias("code_id"))
    return run(None).withColumn("codes", F.lit("all")).union(run(some).withColumn("codes", F.lit("some")))


@query
def embed_retry(spark, d):
    """A model that passes over some texts, breaks on some for good, and on some at first, or again and again."""
    docs = inp.table(spark, d, "documents").select("doc_id", "text")

    def embedder(texts, met={}):  # noqa: B006  what this worker was asked before, by length
        for t in texts:
            if len(t) % 13 == 0 or (len(t) % 5 == 0 and not met.get(t)):
                met[t] = True
                raise TimeoutError("later")
            if len(t) % 7 == 0:
                raise ValueError("never")
        return [None if len(t) % 11 == 0 else [float(len(t))] for t in texts]

    retry = model.Retry(first_wait=0.001, longest_wait=0.002, batch=16)
    got = model.embed(docs, "text", embedder, retry, "error")
    return got.select("doc_id", F.col("embedding")[0].cast("double").alias("first"), "error")


# Axial analysis and narration ---------------------------------------------------------------


def _analyst():
    def analyst(prompts, models):
        """Sorts evidence by whether its length is even, and unites what is told alike."""
        import json

        def item(ids, about=None):
            if about:
                return {"description": about, "evidence_insight_ids": ids}
            return {"property_name": "all", "property_description": "everything", "dimensional_range": "short to long", "evidence_insight_ids": ids}

        out = []
        for p in prompts:
            kind, body = p.split("##", 1)
            given = json.loads(body)
            if kind == "AXIAL":
                told = {}
                for e in given:
                    told.setdefault("odd" if len(e["fragmento_original"]) % 2 else "even", []).append(e["id_fragmento"])
                every = [e["id_fragmento"] for e in given]
            else:
                told = {}
                for x in given["paradigm_model"]["context"]:
                    told.setdefault(x["description"], []).extend(x["evidence_insight_ids"])
                every = [i for x in given["properties_and_dimensions"] for i in x["evidence_insight_ids"]]
            out.append(json.dumps({"paradigm_model": {"context": [item(ids, about) for about, ids in sorted(told.items())]}, "properties_and_dimensions": [item(every)]}))
        return out

    return analyst


def _analysed(spark, d, uniting):
    named = inp.categories(spark, d).withColumn("description", F.lit(None).cast("string"))
    return study.analyse_with_model(named, inp.category_codes(spark, d), inp.enriched(spark, d), inp.insights(spark, d), _analyst(), "AXIAL##{evidence_json}", uniting)


@query
def axial_run(spark, d):
    """One analysis per category, from as many parts as its evidence takes."""
    done = _analysed(spark, d, "UNITE##{analyses_json}")
    rows = cut_lineage(done.valid)
    items = ev.axial_items(rows).groupBy("category_id", "component", "pos", "description").agg(F.count_distinct("insight_id").alias("n_insights"))
    analyses = rows.groupBy("category_id").agg(F.count(F.lit(1)).alias("n_analyses"), F.first("category_name").alias("category_name"), F.first("ord").alias("ord"))
    return items.join(analyses, "category_id").select("category_id", "category_name", "ord", "component", "pos", "description", "n_insights", "n_analyses")


@query
def narrate_run(spark, d):
    """Every part of an analysis told with its own evidence, in as many pieces as that takes."""

    def narrator(prompts, models):
        import json

        out = []
        for p in prompts:
            told = json.loads(p)
            out.append(json.dumps({"narrative_blocks": [{"title": str(len(told)), "text": str(sum(map(len, told.values()))), "evidence_ids": sorted(told)}]}))
        return out

    done = study.narrate_with_model(cut_lineage(_analysed(spark, d, None).valid), inp.insights(spark, d), narrator, "{evidence_json}")
    block = F.col("narrative_blocks")[0]
    return done.valid.select("category_id", "category_name", "ord", "part", "piece", block["title"].cast("bigint").alias("n_insights"), block["text"].cast("bigint").alias("n_characters"))


@query
def synthesis_run(spark, d):
    """The report over narratives of eleven categories, in their order; no final answer comes back, so it is assembled."""
    turns = inp.table(spark, d, "conversations")
    told = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.col("role").alias("title"), "text"))).alias("narrative_blocks"))
    n = F.col("conv_id") % 11
    narratives = told.select(
        F.concat(F.lit("cat_"), (n + 1).cast("string")).alias("category_id"), F.concat(F.lit("name "), (n + 1).cast("string")).alias("category_name"),
        F.col("conv_id").alias("part"), F.lit(0).cast("bigint").alias("piece"), "narrative_blocks", n.alias("ord"),
    )

    def writer(prompts, models):
        return [None if p.startswith("REPORT") else f"{m}: {len(p)} characters" for p, m in zip(prompts, models)]

    return study.synthesize(narratives, writer, "{full_narrative}", "REPORT{synthesized_narratives}", model="advanced")


# Reports ------------------------------------------------------------------------------------


@query
def block_order(spark, d):
    """Narratives of a category told in several parts: their blocks follow each other part by part."""
    turns = inp.table(spark, d, "conversations").where("text IS NOT NULL")
    told = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.col("role").alias("title"), "text"))).alias("narrative_blocks"))
    category = F.concat(F.lit("cat_"), (F.col("conv_id") % 11).cast("string"))
    narratives = told.select(category.alias("category_id"), category.alias("category_name"), F.col("conv_id").alias("part"), F.lit(0).cast("bigint").alias("piece"), "narrative_blocks")
    return report.block_rows(narratives).select("category_id", "pos", "title", F.md5("text").alias("text_md5"))


@query
def report_parts(spark, d):
    """Corpus and plain report are cut at the same sections, so an answer to a part of one replaces that of the other."""
    sections = inp.table(spark, d, "documents").select("doc_id", F.col("source").alias("category_name"), F.col("text").alias("narrative"))
    corpus = report.corpus_text(sections, ["doc_id"], REPORT_PART_CHARS).select("part", F.col("n_sections").alias("n_corpus"))
    plain = report.fallback_report(sections, ["doc_id"], REPORT_PART_CHARS).select("part", F.col("n_sections").alias("n_report"))
    return corpus.join(plain, "part", "full")


@query
def full_narrative(spark, d):
    rows = report.full_narrative(inp.blocks(spark, d), "category_id")
    return rows.select("category_id", "part", F.md5("narrative").alias("narrative_md5"), "n_blocks")


def _sections(spark, d):
    rows = report.full_narrative(inp.blocks(spark, d), "category_id").withColumnRenamed("part", "section_part")
    return rows.withColumn("category_name", F.concat(F.lit("conv "), F.col("category_id").cast("string")))


@query
def corpus_text(spark, d):
    rows = report.corpus_text(_sections(spark, d), ["category_id", "section_part"])
    return rows.select("part", F.md5("corpus").alias("corpus_md5"), "n_sections")


@query
def fallback_report(spark, d):
    rows = report.fallback_report(_sections(spark, d), ["category_id", "section_part"])
    return rows.select("part", F.md5("report").alias("report_md5"), "n_sections")


@query
def report_file(spark, d):
    """The report as text files: the lines read back, each with how often it comes."""
    path = scratch_path(spark, "report")
    rows = report.fallback_report(_sections(spark, d), ["category_id", "section_part"])
    writers.write_report(rows, "report", path)
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.groupBy(F.md5("value").alias("line_md5")).agg(F.count(F.lit(1)).alias("n"))


@query
def synthesis_fallback(spark, d):
    """Conversations whose synthesis came back empty keep their narrative behind an error note."""
    full = report.full_narrative(inp.blocks(spark, d), "category_id")
    answers = full.select("category_id", "part", F.when(F.col("n_blocks") > 3, F.concat(F.lit("short "), F.col("n_blocks").cast("string"))).alias("response"))
    return report.synthesized(full, answers, "category_id").select("category_id", "part", F.md5("narrative").alias("narrative_md5"))


@query
def narrative_blocks(spark, d):
    pos = (F.length("insight_id") % 3).cast("bigint")
    items = cut_lineage(inp.axial_items(spark, d)).select(
        "category_id", "component", pos.alias("pos"), F.concat(F.lit("On "), "component", F.lit(" "), pos.cast("string")).alias("description"), "insight_id",
    )
    rows = report.assembled_blocks(items)
    return rows.select("category_id", "component", "block_ord", "title", "part", "text", F.array_join("evidence_ids", ",").alias("ids"))


@query
def cluster_rollup(spark, d):
    return report.cluster_rollup(inp.categories(spark, d), inp.category_codes(spark, d), report.clusters(spark))


@query
def report_order(spark, d):
    rows = inp.categories(spark, d).select("category_id", "category_name")
    return report.in_report_order(rows, report.clusters(spark)).select("category_id", "cluster", "cluster_ord", "category_ord")


@query
def phase_totals(spark, d):
    return report.phase_totals(
        insights=inp.table(spark, d, "documents"),
        codes=inp.codes(spark, d),
        categories=inp.categories(spark, d),
        evidence=inp.evidence(spark, d),
        narratives=report.full_narrative(inp.blocks(spark, d), "category_id"),
    )


# Whole phases -------------------------------------------------------------------------------


@query
def study_run(spark, d):
    """The whole run without a model; codes, categories and evidence of every insight."""
    clean = study.preprocess(inp.insights_src(spark, d))
    done = spark.createDataFrame([], incremental.CODED)
    s = study.run_study(clean.insights, clean.metadata, done, cb.empty_codebook(spark), inp.seeds(spark, d), LABEL_THETA, SEED_CUTOFF)
    return s.lineage.groupBy("category_id").agg(
        F.countDistinct("code_id").alias("n_codes"), F.countDistinct("id_fragmento").alias("n_insights"), F.countDistinct("source").alias("n_sources")
    )


#: Words the scripted coder chooses from by the length of a text.
CODE_WORDS = ["planning", "saving", "trusting", "asking", "borrowing", "comparing", "delaying", "hoping", "investing", "learning", "sharing", "waiting"]


def _scripted_models(fails: bool) -> study.Models:
    """Models that answer by rules; the coder may fail on texts whose length is a multiple of seven."""
    words = CODE_WORDS

    def coder(prompts, models):
        import json

        out = []
        for p in prompts:
            asked = json.loads(p)
            n = len(asked["fragmento_original"])
            asked["codigos_abiertos"] = [f"{words[n % len(words)]} {n % 100:02d}"]
            out.append("no answer" if fails and n % 7 == 0 else "```json\n" + json.dumps(asked) + "\n```")
        return out

    def categorizer(prompts, models):
        import json

        out = []
        for p in prompts:
            asked, names = (json.loads(x) for x in p.split("##"))
            groups = {}
            for c in asked:
                groups.setdefault(f"length {len(names[c['code_id']]) % 5}", []).append(c)
            out.append(json.dumps([{"category_name": k, "is_new": True, "description": k, "code_assignments": v} for k, v in groups.items()]))
        return out

    def analyst(prompts, models):
        import json

        return [json.dumps({"paradigm_model": {"context": [{"description": "all", "evidence_insight_ids": [e["id_fragmento"] for e in json.loads(p)]}]}}) for p in prompts]

    return study.Models(coder, categorizer, analyst)


def _run_pipeline(spark, d, root, fails):
    templates = study.Templates("{json_input}", "{codes_to_categorize_json}##{codebook_map_json}", "{evidence_json}")
    return study.run_pipeline(inp.insights(spark, d), root, _scripted_models(fails), templates, KNOWN, QUESTIONS, theta=0.95)


@query
def pipeline_run(spark, d):
    """The whole run with models: codes and cited insights of each category, read back from what the run wrote."""
    root = scratch_path(spark, "pipeline")
    _run_pipeline(spark, d, root, fails=True)
    ledger = Ledger(spark, root)
    cited = ev.cited_ids(ledger.latest("axial", "axial")).groupBy("category_id").agg(F.count_distinct("insight_id").alias("n_insights"))
    sizes = ledger.latest("categorize", "category_codes").groupBy("category_id").agg(F.count(F.lit(1)).alias("n_codes"))
    names = ledger.latest("categorize", "categories").select("category_id", "category_name")
    results = readers.read_jsonl(spark, f"{ledger.last('enrich').path}/results", readers.CODED)
    written = results.select(F.lit("results").alias("category_name"), F.size(F.array_distinct("unified_code_ids")).cast("bigint").alias("n")).groupBy("category_name").agg(F.sum("n").alias("n_codes"), F.count(F.lit(1)).alias("n_insights"))
    failed = ledger.read("coding", "failed").groupBy(F.col("error").alias("category_name")).agg(F.lit(0).cast("bigint").alias("n_codes"), F.count(F.lit(1)).alias("n_insights"))
    return names.join(sizes, "category_id").join(cited, "category_id").select("category_name", "n_codes", "n_insights").union(written).union(failed)


@query
def pipeline_rerun(spark, d):
    """A run whose coder fails on some texts, one that makes up for them, and one with nothing left to ask: what became of each phase."""
    root = scratch_path(spark, "pipeline")
    rows = [(run, *o) for run in (1, 2, 3) for o in _run_pipeline(spark, d, root, fails=run == 1)]
    return spark.createDataFrame(rows, "run bigint, phase string, status string, asked bigint, rows bigint")


# Incremental --------------------------------------------------------------------------------


def _deliveries(spark, d, path, n):
    """The documents in so many deliveries, one written after the other, each as many files as the table has splits; every fifth
    document comes again in the next delivery."""
    docs = inp.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), "text", "doc_id")
    for k in range(n):
        again = (F.col("doc_id") % 5 == 0) & (F.col("doc_id") % n == (k - 1) % n) if k else F.lit(False)
        docs.where((F.col("doc_id") % n == k) | again).select("id", "text").write.mode("append").parquet(path)
        yield k


def _inbox(spark, path, max_files=None):
    return incremental.insight_stream(spark.readStream, path, "id string, text string", max_files)


@query
def stream_state_resume(spark, d):
    """Several files and micro-batches with repeated ids, and a coder that fails on some texts: these come up again in later runs."""
    root = scratch_path(spark, "stream")
    n_deliveries = len(list(_deliveries(spark, d, f"{root}/in", 3)))
    max_files = -(-len(spark.read.parquet(f"{root}/in").inputFiles()) // n_deliveries)

    def coder(rows):
        n = F.length("text")
        fails = ((n % 7 == 0) & (F.col("attempt") == 1)) | (n % 35 == 0)
        rows = rows.withColumn("fails", F.coalesce(fails, F.lit(False)))
        bad = rows.where("fails").select("id", F.struct("id", "text").alias("insight_original"), F.lit("no answer").alias("error"))
        return contracts.Split(incremental.rule_coder(rows.where("NOT fails")), bad)

    for _ in range(3):
        incremental.code_stream(_inbox(spark, f"{root}/in", max_files), f"{root}/coded", f"{root}/offsets", coder)
    coded = incremental.coded_so_far(spark, f"{root}/coded").select("id", F.array_join("codigos_abiertos", "|").alias("codes"))
    failed = incremental.failed_so_far(spark, f"{root}/coded").groupBy("id").agg(F.count(F.lit(1)).alias("n_failed"), F.max("final").alias("final"))
    return coded.join(failed, "id", "full").select("id", "codes", F.coalesce("n_failed", F.lit(0).cast("bigint")).alias("n_failed"), F.coalesce("final", F.lit(False)).alias("final"))


@query
def stream_codebook_log(spark, d):
    """A codebook from elsewhere, labels that come in several batches, a batch that is replayed, a base written in between."""
    root = scratch_path(spark, "stream")
    log = CodebookLog(spark, f"{root}/book", base_every=2)
    log.start(_book(spark, d))
    keeper = incremental.codebook_keeper(f"{root}/book", LABEL_THETA, base_every=2)
    for _ in _deliveries(spark, d, f"{root}/in", 3):  # each is a micro-batch
        incremental.code_stream(_inbox(spark, f"{root}/in"), f"{root}/coded", f"{root}/offsets", after_batch=keeper)
    keeper(spark.read.schema(incremental.CODED).parquet(f"{root}/coded/batch_id=2"), 2)
    uses = log.read().select(F.col("id").alias("code_id"), F.col("count").alias("n_uses"))
    return log.label_map().join(uses, "code_id").select("label", "code_id", "match_kind", rounded("sim"), "n_uses")


def _document_stream(spark, d):
    # A pattern, as a stream takes a folder or a pattern, and the table may be one file or a folder of files.
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    docs = incremental.insight_stream(spark.readStream, f"{d}/documents.parque[t]", schema)
    return docs.select(F.col("doc_id").cast("string").alias("id"), "text")


@query
def stream_resume(spark, d):
    root = scratch_path(spark, "stream")
    incremental.code_stream(_document_stream(spark, d), f"{root}/coded", f"{root}/offsets")
    rows = incremental.coded_so_far(spark, f"{root}/coded")
    return rows.select("id", F.array_join("codigos_abiertos", "|").alias("codes"))


@query
def stream_codebook(spark, d):
    root = scratch_path(spark, "stream")
    keeper = incremental.codebook_keeper(f"{root}/book", LABEL_THETA)
    incremental.code_stream(_document_stream(spark, d), f"{root}/coded", f"{root}/offsets", after_batch=keeper)
    return incremental.label_map(spark, f"{root}/book").select("label", "code_id", "match_kind", rounded("sim"))
