"""Study-shaped inputs derived from the given tables.

``documents`` plays the insights (with blemishes injected by position), ``embeddings`` the
code vectors, ``conversations`` the ordered narrative blocks. Every row of a table is used.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import text as T
from codeloom.operators import ingest, report
from codeloom.operators import evidence as ev
from codeloom.operators.ranking import with_position
from codeloom.session import cut_lineage

_shared: dict[str, DataFrame] | None = None


@contextmanager
def one_query() -> Iterator[None]:
    """While it lasts, :func:`coded` is materialised once and reused, so texts are read once."""
    global _shared
    outer, _shared = _shared, {}
    try:
        yield
    finally:
        _shared = outer


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def insights_src(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source sheet with null and blank cells, padding and repeated ids."""
    d, n = table(spark, sf_dir, "documents"), F.col("doc_id")
    repeated = n - F.when(n % 50 == 1, 1).otherwise(0)
    padded = F.concat(F.lit("  "), repeated.cast("string"), F.lit(" "))
    return d.select(
        n.alias("src_ord"),
        F.when(n % 17 == 5, F.lit(None)).when(n % 19 == 7, F.lit("   ")).otherwise(padded).alias("ID"),
        F.when(n % 23 == 3, F.lit(None)).when(n % 29 == 4, F.lit(" ")).otherwise(F.concat(F.lit(" "), "text", F.lit(" "))).alias("InsightText"),
        F.when(n % 13 == 2, F.lit(None)).otherwise(F.col("lang")).alias("Method"),
        F.col("source").alias("Source"),
    )


def insights(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").cast("string").alias("id"), "text", F.col("doc_id").alias("src_ord"))


def coded_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, codigos_abiertos``: rule-based codes of every document, for a single use."""
    return ingest.open_code(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def coded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`coded_once`, materialised for queries that need it in several places."""
    if _shared is None:
        return coded_once(spark, sf_dir)
    if sf_dir not in _shared:
        _shared[sf_dir] = cut_lineage(coded_once(spark, sf_dir))
    return _shared[sf_dir]


def open_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.exploded_codes(coded(spark, sf_dir), ["doc_id"])


def codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One code per distinct label: ``label, code_id, n``."""
    return ingest.distinct_labels(coded(spark, sf_dir)).withColumn("code_id", T.code_id(F.col("label")))


def established(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An earlier codebook: the labels used by more than one document."""
    return codes(spark, sf_dir).filter(F.col("n") > 1)


def category_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eleven uneven categories; codes with ``er`` in the label are in ``cat_7`` as well."""
    c = codes(spark, sf_dir)
    by_length = F.concat(F.lit("cat_"), (F.length("label") % 11 + 1).cast("string"))
    groups = F.array_distinct(F.when(F.col("label").contains("er"), F.array(by_length, F.lit("cat_7"))).otherwise(F.array(by_length)))
    return c.select(F.explode(groups).alias("category_id"), "code_id")


def enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = coded(spark, sf_dir).withColumn("id_fragmento", F.col("doc_id").cast("string"))
    label_map = codes(spark, sf_dir).select("label", "code_id")
    return ev.enrich_insights(rows, label_map)


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.evidence_index(enriched(spark, sf_dir))


def axial_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cited evidence per category and component, some of it unknown."""
    pairs = evidence(spark, sf_dir).join(category_codes(spark, sf_dir), "code_id")
    n = F.col("id_fragmento").cast("int")
    component = F.element_at(F.array(*[F.lit(c) for c in report.COMPONENT_TITLES]), n % 6 + 1)
    cited = F.when(n % 37 == 0, F.concat(F.lit("missing_"), "id_fragmento")).otherwise(F.col("id_fragmento"))
    return pairs.select("category_id", component.alias("component"), cited.alias("insight_id")).distinct()


def categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The categories in use, named after the fixed list; ``cat_11`` has a name of its own."""
    names = F.create_map(*[F.lit(x) for n, c in enumerate(report.CLUSTERS) if n < 10 for x in (f"cat_{n + 1}", c[0])])
    used = category_codes(spark, sf_dir).select("category_id").distinct()
    return used.select(
        "category_id",
        F.coalesce(F.try_element_at(names, "category_id"), F.lit("Otros")).alias("category_name"),
        F.substring("category_id", 5, 2).cast("bigint").alias("ord"),
    )


def _quoted_labels(c="codigos_abiertos"):
    return F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: F.concat(F.lit('"'), x, F.lit('"'))), ","), F.lit("]"))


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One coding response per document in nine shapes, good and bad."""
    n = F.col("doc_id")
    key = n.cast("string")
    js = F.concat(
        F.lit('{"id_fragmento":"'), key, F.lit('","fragmento_original":"doc '), key, F.lit('","codigos_abiertos":'),
        _quoted_labels(), F.lit(',"extra":1}'),
    )
    rows = coded_once(spark, sf_dir).select("doc_id", js.alias("js"))
    j, shape = F.col("js"), n % 9
    bare_id = F.replace(j, F.concat(F.lit('"id_fragmento":"'), key, F.lit('"')), F.concat(F.lit('"id_fragmento":'), key))
    response = (
        F.when(shape == 0, F.concat(F.lit("Sure:\n```json\n"), j, F.lit("\n```\nDone.")))
        .when(shape == 1, F.concat(F.lit("Result: "), j))
        .when(shape == 2, F.lit("no json here"))
        .when(shape == 3, F.lit(None))
        .when(shape == 4, F.concat(F.lit("```json\n"), F.substring("js", 1, 30)))
        .when(shape == 5, F.lit("{}"))
        .when(shape == 6, F.concat(j, F.lit(" and "), j))
        .when(shape == 7, bare_id)
        .otherwise(F.concat(F.lit("note [see] "), j))
    )
    return rows.select("doc_id", response.alias("response"))


def category_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One categorization response per document: lists with good and bad items."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    rows = ingest.open_code(d)
    shape = F.col("doc_id") % 6
    codes_json = F.concat(
        F.lit("["),
        F.array_join(F.transform("codigos_abiertos", lambda x: F.concat(F.lit('{"code_id":"'), x, F.lit('","rationale":"r"}'))), ","),
        F.lit("]"),
    )
    is_new = F.when(shape == 1, F.lit('"yes"')).when(shape == 2, F.lit("2")).otherwise(F.lit("false"))
    head = F.concat(F.lit('{"category_name":"'), "lang", F.lit('","is_new":'), is_new)
    said = F.when(shape == 3, F.lit("")).otherwise(F.concat(F.lit(',"description":"'), "source", F.lit('"')))
    tail = F.when(shape == 5, F.lit("}")).otherwise(F.concat(F.lit(',"code_assignments":'), codes_json, F.lit("}")))
    item = F.concat(head, said, tail)
    extra = F.concat(F.lit(',{"category_name":"'), "source", F.lit('","is_new":true,"description":"second"}'))
    listed = F.concat(F.lit("["), item, F.when(shape == 1, extra).otherwise(F.lit("")), F.lit("]"))
    return rows.select("doc_id", F.when(shape == 4, item).otherwise(listed).alias("response"))


def axial_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One axial response per document, citing the document and its successor."""
    n = F.col("doc_id")
    shape, me, other = n % 5, n.cast("string"), (n + 1).cast("string")
    second = F.when(shape == 2, other).otherwise(F.concat(F.lit('"'), other, F.lit('"')))
    causal = F.concat(F.lit('{"description":"why","evidence_insight_ids":["'), me, F.lit('",'), second, F.lit("]}"))
    name = F.when(shape == 3, F.lit("")).otherwise(F.lit('"property_name":"p",'))
    prop = F.concat(
        F.lit("{"), name, F.lit('"property_description":"about","dimensional_range":"low to high","evidence_insight_ids":["'), me, F.lit('"]}')
    )
    model = F.concat(F.lit('"paradigm_model":{"causal_conditions":['), causal, F.lit('],"context":[]},'))
    full = F.concat(F.lit("{"), F.when(shape == 1, F.lit("")).otherwise(model), F.lit('"properties_and_dimensions":['), prop, F.lit("]}"))
    response = F.when(shape == 4, F.lit('{"paradigm_model":{},"properties_and_dimensions":[]}')).otherwise(full)
    return table(spark, sf_dir, "documents").select("doc_id", response.alias("response"))


def code_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One codebook entry per document as JSON text, with counts of various kinds."""
    n = F.col("doc_id")
    count = F.element_at(
        F.array(*[F.lit(x) for x in (',"count":5', ',"count":"7"', ',"count":5.5', ',"count":null', "", ',"count":"x"', ',"count":6.0')]),
        (n % 7 + 1).cast("int"),
    )
    vector = F.when(n % 4 == 1, F.lit(',"embedding":[1,"2.5",0.5]')).when(n % 4 == 2, F.lit(',"embedding":"none"')).otherwise(F.lit(""))
    body = F.concat(F.lit('{"id":"code_'), n.cast("string"), F.lit('","label":"'), "lang", F.lit('"'), count, vector, F.lit("}"))
    return table(spark, sf_dir, "documents").select("doc_id", body.alias("record"))


def insight_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Enriched insights as JSON lines: some with a numeric id, a null text or no code list."""
    n = F.col("doc_id")
    key = F.when(n % 5 == 2, n.cast("string")).otherwise(F.concat(F.lit('"'), n.cast("string"), F.lit('"')))
    text_ = F.when(n % 7 == 4, F.lit("null")).otherwise(F.concat(F.lit('"'), "source", F.lit('"')))
    ids = F.when(n % 3 == 1, F.lit("")).otherwise(F.concat(F.lit(',"unified_code_ids":["'), "lang", F.lit('"]')))
    line = F.concat(F.lit('{"id_fragmento":'), key, F.lit(',"fragmento_original":'), text_, ids, F.lit(',"id":1}'))
    return table(spark, sf_dir, "documents").select(line.alias("value"))


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as narrative blocks; system turns have no title."""
    c = table(spark, sf_dir, "conversations")
    title = F.when(F.col("role") == "system", F.lit("")).otherwise(F.col("role"))
    return c.select(F.col("conv_id").alias("category_id"), F.col("turn").alias("pos"), title.alias("title"), "text")


def seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seed categories with several keywords each: the labels of three documents or more, by first letter."""
    used = ingest.distinct_labels(coded(spark, sf_dir)).where("n >= 3")
    words = used.select(F.col("label").alias("keyword"), F.concat(F.lit("seed_"), F.substring("label", 1, 1)).alias("category_name"))
    return with_position(words, ["category_name", "keyword"], name="seed_ord").select("keyword", "category_name", "seed_ord")
