"""From codes back to the text they rest on: enrichment, evidence index, resolution, lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions import text as T
from codeloom.operators import ingest
from codeloom.operators.contracts import COMPONENTS
from codeloom.session import stored

EVIDENCE_CHAR_LIMIT = 100_000  # fixed value: characters of evidence that fit one request
MISSING_TEXT = "Referenced insight text not found for ID: "  # fixed value
SPREAD = 4096


def enrich_insights(coded: DataFrame, label_map: DataFrame, distinct: bool = False, codes: str = "codigos_abiertos") -> DataFrame:
    """Add ``unified_code_ids``: the codes of a row's labels in label order.

    Works per distinct label list rather than per row. Equal lists are looked up once, rows
    need no unique id, and the only group that is collected is one list. Rows without codes
    can match nothing; they are spread over all partitions instead of meeting on one key. The lists
    are stored, so rows with texts stay put where these are few.
    """
    lists = coded.select(F.col(codes).alias("_list")).filter(F.size("_list") > 0).distinct()
    labels = lists.select("_list", F.posexplode("_list").alias("_pos", "label")).withColumn("label", T.strip(F.col("label")))
    hits = labels.join(label_map.select("label", "code_id"), "label")
    found = hits.groupBy("_list").agg(
        F.array_sort(F.collect_list(F.struct("_pos", "code_id"))).alias("_hits"),
        F.min(F.least("_pos", F.lit(0))).alias("_zero"),  # always 0, but not a literal: it has to stay a join key
    )
    ids = F.transform("_hits", lambda h: h["code_id"])
    found = found.select("_list", "_zero", (F.array_distinct(ids) if distinct else ids).alias("unified_code_ids"))
    found = stored(found, "lists")
    none = F.array().cast("array<string>")
    row_key = next(c for c in coded.columns if c != codes)
    spread = F.when(F.size(codes) > 0, 0).otherwise(F.pmod(F.xxhash64(row_key), F.lit(SPREAD)) + 1).cast("int")
    same = (F.col(codes) == F.col("_list")) & (F.col("_spread") == F.col("_zero"))
    return (
        coded.withColumn("_spread", spread)
        .join(found, same, "left")
        .withColumn("unified_code_ids", F.coalesce("unified_code_ids", none))
        .drop("_list", "_spread", "_zero")
    )


def unmatched_labels(coded: DataFrame, label_map: DataFrame, codes: str = "codigos_abiertos") -> DataFrame:
    """Labels without a code, per row: ``id, pos, label``."""
    fallback = F.coalesce(F.nullif("id", F.lit("")), F.col("id_fragmento")) if "id_fragmento" in coded.columns else F.col("id")
    rows = coded.select(fallback.alias("id"), F.posexplode(codes).alias("_p", "_l")).select(
        "id", (F.col("_p") + 1).cast("bigint").alias("pos"), T.strip(F.col("_l")).alias("label")
    )
    return rows.join(label_map.select("label"), "label", "left_anti").select("id", "pos", "label")


def evidence_index(enriched: DataFrame) -> DataFrame:
    """The inverted index as rows: ``code_id, id_fragmento, pos``.

    Texts are left out on purpose: they are joined once, by id, when evidence is shown.
    """
    return enriched.select(F.posexplode("unified_code_ids").alias("_p", "code_id"), "id_fragmento").select(
        "code_id", "id_fragmento", (F.col("_p") + 1).cast("bigint").alias("pos")
    )


def category_evidence(category_codes: DataFrame, index: DataFrame) -> DataFrame:
    """Distinct evidence ids per category: ``category_id, id_fragmento``."""
    pairs = category_codes.select("category_id", "code_id").distinct().join(
        index.select("code_id", "id_fragmento").distinct(), "code_id"
    )
    return pairs.select("category_id", "id_fragmento").distinct()


def without_evidence(categories: DataFrame, evidence: DataFrame) -> DataFrame:
    """Categories that have nothing to analyse."""
    return categories.join(evidence.select("category_id"), "category_id", "left_anti")


def cited_ids(axial: DataFrame) -> DataFrame:
    """Every evidence id an axial analysis cites, once: ``category_id[, part], insight_id``.

    ``axial(category_id[, part], analysis struct<paradigm_model, properties_and_dimensions>)``.
    """
    key = [c for c in ("category_id", "part") if c in axial.columns]
    lists = [F.flatten(F.transform(F.col(f"analysis.paradigm_model.{c}"), lambda x: x["evidence_insight_ids"])) for c in COMPONENTS]
    lists.append(F.flatten(F.transform("analysis.properties_and_dimensions", lambda x: x["evidence_insight_ids"])))
    none = F.array().cast("array<string>")
    united = F.array_distinct(F.flatten(F.array(*[F.coalesce(x, none) for x in lists])))
    return axial.select(*key, F.explode(united).alias("insight_id")).distinct()


def axial_items(axial: DataFrame) -> DataFrame:
    """Working form of axial analyses: ``category_id, component, pos, description, insight_id``.

    Where a category was analysed in parts, ``pos`` goes on from part to part, as if their lists were joined.
    """
    spec = "array<struct<component:string,pos:bigint,description:string,ids:array<string>>>"

    def items(column: str, component: str, description: str):
        return F.coalesce(
            F.transform(
                F.col(column),
                lambda x, i: F.struct(F.lit(component), i.cast("bigint"), x[description], x["evidence_insight_ids"]),
            ).cast(spec),
            F.array().cast(spec),
        )

    parts = [items(f"analysis.paradigm_model.{c}", c, "description") for c in COMPONENTS]
    parts.append(items("analysis.properties_and_dimensions", "properties_and_dimensions", "property_description"))
    flat = axial.select(*[c for c in ("category_id", "part") if c in axial.columns], F.inline(F.flatten(F.array(*parts))))
    if "part" in axial.columns:
        flat = through_parts(flat, ["category_id", "component"], ["part"])
    return flat.select("category_id", "component", "pos", "description", F.explode_outer("ids").alias("insight_id"))


def texts_for(refs: DataFrame, insights: DataFrame, order: str = "src_ord") -> DataFrame:
    """Texts of the cited insights only, the last row per id winning.

    Keeping the cited rows first means that only their texts are shuffled.
    """
    cited = refs.select(F.col("insight_id").alias("id")).distinct()
    return ingest.insight_texts(insights.select("id", "text", order).join(cited, "id", "left_semi"), order)


def lengths_for(refs: DataFrame, insights: DataFrame, order: str = "src_ord") -> DataFrame:
    """:func:`texts_for` with the length ``n_chars`` of each text in its place: texts are measured where they are."""
    cited = refs.select(F.col("insight_id").alias("id")).distinct()
    usable = insights.filter(F.col("id").isNotNull() & F.col("text").isNotNull())
    measured = usable.select("id", order, F.length("text").cast("bigint").alias("n_chars")).join(cited, "id", "left_semi")
    return ingest.last_per_key(measured, "id", order, ["n_chars"])


def resolve_texts(refs: DataFrame, texts: DataFrame) -> DataFrame:
    """Add ``text`` and ``found`` to ``refs(..., insight_id)``; unknown or empty ones get a placeholder."""
    known = texts.select(F.col("id").alias("insight_id"), F.nullif("text", F.lit("")).alias("_text"))
    return refs.join(known, "insight_id", "left").select(
        *refs.columns,
        F.coalesce("_text", F.concat(F.lit(MISSING_TEXT), "insight_id")).alias("text"),
        F.col("_text").isNotNull().alias("found"),
    )


def resolve_lengths(refs: DataFrame, lengths: DataFrame) -> DataFrame:
    """Add ``n_chars``, the length of the text that :func:`resolve_texts` adds."""
    known = lengths.select(F.col("id").alias("insight_id"), F.nullif("n_chars", F.lit(0)).alias("_n"))
    placeholder = F.length(F.concat(F.lit(MISSING_TEXT), "insight_id"))
    return refs.join(known, "insight_id", "left").select(*refs.columns, F.coalesce("_n", placeholder).cast("bigint").alias("n_chars"))


def through_parts(rows: DataFrame, key: list[str], parts: list[str], pos: str = "pos") -> DataFrame:
    """Number ``pos`` (0-based within each part) through all parts of a key; the part columns go.

    Offsets come from one row per part, so a key's rows need not meet.
    """
    sizes = rows.groupBy(*key, *parts).agg((F.max(pos) + 1).alias("_n"))
    before = Window.partitionBy(*key).orderBy(*parts).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*key, *parts, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    moved = rows.join(offsets, [*key, *parts]).withColumn(pos, (F.col(pos) + F.col("_off")).cast("bigint"))
    return moved.select(*[c for c in rows.columns if c not in parts])


def evidence_parts(resolved: DataFrame, limit: int = EVIDENCE_CHAR_LIMIT, slots: int = 3, key: str = "category_id", name: str = "part") -> DataFrame:
    """Running length per ``key`` (a category) and the request part each text falls into.

    Adds ``running_chars``, ``within_budget`` and ``part``. Evidence has no order of its own,
    so it is taken by the hash of its id. The leading hash digits cut every category into
    ``16 ** slots`` even slices; a slice is summed alone and the offsets come from one row per
    slice. A category with a third of all evidence is thus spread over all tasks. ``resolved`` has
    the texts, or their lengths alone as ``n_chars``.
    """
    n_chars = F.col("n_chars") if "n_chars" in resolved.columns else F.length("text").cast("bigint")
    keyed = resolved.withColumn("_h", F.md5("insight_id")).withColumn("_n", n_chars)
    keyed = keyed.withColumn("_slice", F.substring("_h", 1, slots))
    sums = keyed.groupBy(key, "_slice").agg(F.sum("_n").alias("_sum"))
    before = Window.partitionBy(key).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(key, "_slice", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_off"))
    local = Window.partitionBy(key, "_slice").orderBy("_h", "insight_id").rowsBetween(Window.unboundedPreceding, 0)
    running = F.col("_off") + F.sum("_n").over(local)
    return (
        keyed.join(offsets, [key, "_slice"])
        .withColumn("running_chars", running)
        .withColumn("within_budget", F.col("running_chars") <= limit)
        .withColumn(name, F.floor((F.col("running_chars") - F.col("_n")) / limit).cast("bigint"))
        .drop("_h", "_n", "_slice", "_off")
    )


def evidence_budget(resolved: DataFrame, limit: int = EVIDENCE_CHAR_LIMIT) -> DataFrame:
    """Per category: pieces and characters of evidence, and whether they fit one request."""
    return resolved.groupBy("category_id").agg(
        F.count(F.lit(1)).alias("n_evidence"),
        F.sum(F.length("text")).cast("bigint").alias("total_chars"),
        F.count_if(~F.col("found")).alias("n_missing"),
    ).withColumn("within_budget", F.col("total_chars") <= limit)


def unknown_evidence(refs: DataFrame, texts: DataFrame) -> DataFrame:
    """Citations of insights that do not exist."""
    return refs.join(texts.select(F.col("id").alias("insight_id")), "insight_id", "left_anti")


def lineage(index: DataFrame, category_codes: DataFrame, metadata: DataFrame) -> DataFrame:
    """Insight, code, category and provenance side by side."""
    meta = metadata.select(F.col("id").alias("id_fragmento"), "method", "source")
    return (
        index.select("code_id", "id_fragmento", "pos")
        .join(category_codes.select("category_id", "code_id"), "code_id", "left")
        .join(meta, "id_fragmento", "left")
        .select("id_fragmento", "pos", "code_id", "category_id", "method", "source")
    )
