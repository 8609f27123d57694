"""Narratives, corpus text, report text and totals.

A text assembled from many rows is handed out in numbered parts of bounded size. Small inputs give one part, which is the whole text; joined in part order the parts
always give exactly the whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions import text as T
from codeloom.operators.evidence import through_parts
from codeloom.operators.ranking import with_position

# Fixed values -------------------------------------------------------------------------------
BLOCK_SEPARATOR = "\n\n---\n\n"
RULE = "=" * 80
REPORT_HEAD = "# Modelo Teórico de Bienestar Financiero Digital\n\n## Informe de Síntesis Teórica\n\n"
CLUSTERS = [
    ("Formación de hábitos", "individual", 1, 1),
    ("Desarrollo de competencias", "individual", 1, 2),
    ("Empoderamiento y Autonomía del Usuario", "individual", 1, 3),
    ("Generación de confianza", "sistemic", 2, 4),
    ("Acompañamiento", "sistemic", 2, 5),
    ("Regulación y Gobernanza del Ecosistema Financiero", "sistemic", 2, 6),
    ("Capacidades y Aplicaciones de la IA/Tecnología", "technological", 3, 7),
    ("Desafíos y Riesgos de la Interacción con IA/Tecnología", "technological", 3, 8),
    ("Obstáculos y Barreras Financieras", "central", 4, 9),
    ("Consecución de metas", "central", 4, 10),
    ("Gestión integral del bienestar", "central", 4, 11),
]
COMPONENT_TITLES = {
    "causal_conditions": "Condiciones Causales",
    "context": "Contexto",
    "intervening_conditions": "Condiciones Intervinientes",
    "action_strategies": "Estrategias de Acción",
    "consequences": "Consecuencias",
    "properties_and_dimensions": "Propiedades y Dimensiones",
}
# --------------------------------------------------------------------------------------------
PIECES_PER_PART = 1_000
CHARS_PER_PART = 8_000_000
#: At least what headings and separators add to a section of the corpus or the report.
SECTION_OVERHEAD = 110


def clusters(spark) -> DataFrame:
    """The fixed cluster of each known category, in report order."""
    return spark.createDataFrame(CLUSTERS, "category_name string, cluster string, cluster_ord bigint, category_ord bigint")


def block_rows(narratives: DataFrame) -> DataFrame:
    """``narratives(category_id, category_name[, part[, piece]], narrative_blocks)`` as rows with a 0-based ``pos``.

    Several narratives of a category follow each other in the order of their parts and pieces.
    """
    parts = [c for c in ("part", "piece") if c in narratives.columns]
    rows = narratives.select("category_id", "category_name", *parts, F.posexplode("narrative_blocks").alias("pos", "_b")).select(
        "category_id", "category_name", *parts, F.col("pos").cast("bigint").alias("pos"), "_b.title", "_b.text"
    )
    return through_parts(rows, ["category_id"], parts) if parts else rows


def complete_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks that have both a title and a text."""
    return blocks.filter((F.coalesce("title", F.lit("")) != "") & (F.coalesce("text", F.lit("")) != ""))


def full_narrative(blocks: DataFrame, key: str, per_part: int = PIECES_PER_PART) -> DataFrame:
    """Blocks ``(key, pos, title, text)`` joined per key in order: ``key, part, narrative, n_blocks``.

    ``pos`` is the block's place in its list, so the part follows from it without any sort or
    shuffle of the group, and a key with very many blocks is spread over many parts.
    """
    usable = complete_blocks(blocks).withColumn("part", F.floor(F.col("pos") / per_part).cast("bigint"))
    piece = T.section(F.col("title"), F.col("text"))
    lists = usable.groupBy(key, "part").agg(
        F.array_sort(F.collect_list(F.struct("pos", piece.alias("p")))).alias("_ps")
    )
    text = F.array_join(F.transform("_ps", lambda x: x["p"]), BLOCK_SEPARATOR)
    return lists.select(key, "part", text.alias("narrative"), F.size("_ps").cast("bigint").alias("n_blocks"))


def _assembled(sections: DataFrame, order: list[str], head: str, piece: Column, max_chars: int, name: str) -> DataFrame:
    # Measured without what surrounds a section, so that corpus and report are cut at the same sections.
    measured = (F.length("category_name") + F.length("narrative") + SECTION_OVERHEAD).cast("bigint")
    pieces = sections.withColumn("_p", piece).withColumn("_n", measured)
    placed = with_position(pieces, order, name="_pos", running={"_end": "_n"})
    placed = placed.withColumn("part", F.floor((F.col("_end") - F.col("_n")) / max_chars).cast("bigint"))
    lists = placed.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("_pos", "_p"))).alias("_ps"))
    body = F.array_join(F.transform("_ps", lambda x: x["_p"]), "")
    text = F.concat(F.when(F.col("part") == 0, F.lit(head)).otherwise(F.lit("")), body)
    return lists.select("part", text.alias(name), F.size("_ps").cast("bigint").alias("n_sections"))


def corpus_text(sections: DataFrame, order: list[str], max_chars: int = CHARS_PER_PART) -> DataFrame:
    """All ``sections(category_name, narrative)`` as the text of one final request, in parts."""
    piece = F.concat(F.lit("## CATEGORÍA: "), "category_name", F.lit("\n\n"), "narrative", F.lit(f"\n\n{RULE}\n\n"))
    return _assembled(sections, order, f"\n\n{RULE}\n\n", piece, max_chars, "corpus")


def fallback_report(sections: DataFrame, order: list[str], max_chars: int = CHARS_PER_PART) -> DataFrame:
    """The plain report used when no final synthesis comes back, in parts."""
    piece = F.concat(F.lit("### "), "category_name", F.lit("\n\n"), "narrative", F.lit("\n\n---\n\n"))
    return _assembled(sections, order, REPORT_HEAD, piece, max_chars, "report")


def synthesized(narratives: DataFrame, responses: DataFrame, key: str) -> DataFrame:
    """Response text per narrative part, or the error note with the original narrative where there is none."""
    got = responses.select(key, "part", F.nullif("response", F.lit("")).alias("_r"))
    text = F.coalesce("_r", F.concat(F.lit("Error al procesar la categoría: "), "narrative"))
    return narratives.join(got, [key, "part"], "left").select(*[c for c in narratives.columns if c != "narrative"], text.alias("narrative"))


def cluster_rollup(categories: DataFrame, category_codes: DataFrame, cluster_map: DataFrame) -> DataFrame:
    """Categories and codes per cluster, in report order; unknown categories come last as ``unassigned``."""
    sizes = category_codes.distinct().groupBy("category_id").agg(F.count(F.lit(1)).alias("n"))
    rows = categories.join(cluster_map, "category_name", "left").join(sizes, "category_id", "left")
    return rows.groupBy(
        F.coalesce("cluster", F.lit("unassigned")).alias("cluster"), F.coalesce("cluster_ord", F.lit(99)).alias("cluster_ord")
    ).agg(
        F.count(F.lit(1)).alias("n_categories"), F.sum(F.coalesce("n", F.lit(0))).cast("bigint").alias("n_codes")
    )


def in_report_order(sections: DataFrame, cluster_map: DataFrame) -> DataFrame:
    """Add ``cluster, cluster_ord, category_ord`` to sections, the fixed order of the report; unknown ones come last."""
    return sections.join(cluster_map, "category_name", "left").withColumns(
        {
            "cluster": F.coalesce("cluster", F.lit("unassigned")),
            "cluster_ord": F.coalesce("cluster_ord", F.lit(99)),
            "category_ord": F.coalesce("category_ord", F.lit(99)),
        }
    )


def assembled_blocks(items: DataFrame, per_part: int = PIECES_PER_PART) -> DataFrame:
    """Template blocks of axial items: one per category and component, with evidence in parts.

    ``items(category_id, component, pos, description, insight_id)`` gives ``category_id,
    component, block_ord, title, part, text, evidence_ids``. Descriptions are joined in
    order; evidence ids are sorted and distinct. Long blocks continue in further parts.
    """
    names = list(COMPONENT_TITLES)
    said = items.filter(F.col("description").isNotNull()).groupBy("category_id", "component", "pos").agg(
        F.min("description").alias("description")
    )
    said = said.withColumn("part", F.floor(F.col("pos") / per_part).cast("bigint"))
    texts = said.groupBy("category_id", "component", "part").agg(
        F.array_sort(F.collect_list(F.struct("pos", "description"))).alias("_ps")
    ).select("category_id", "component", "part", F.array_join(F.transform("_ps", lambda x: x["description"]), " ").alias("text"))
    ids = items.filter(F.col("insight_id").isNotNull()).select("category_id", "component", "insight_id").distinct()
    ids = with_position(ids, ["insight_id"], ["category_id", "component"], "_n")
    lists = ids.groupBy("category_id", "component", F.floor((F.col("_n") - 1) / per_part).cast("bigint").alias("part")).agg(
        F.array_sort(F.collect_list("insight_id")).alias("evidence_ids")
    )
    title = F.lit(None).cast("string")
    place = F.lit(None).cast("bigint")
    for n, c in enumerate(names):
        title = F.when(F.col("component") == c, COMPONENT_TITLES[c]).otherwise(title)
        place = F.when(F.col("component") == c, F.lit(n + 1).cast("bigint")).otherwise(place)
    return texts.join(lists, ["category_id", "component", "part"], "full").select(
        "category_id", "component", place.alias("block_ord"), title.alias("title"), "part",
        F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce("evidence_ids", F.array().cast("array<string>")).alias("evidence_ids"),
    )


def phase_totals(**phases: DataFrame) -> DataFrame:
    """Number of rows per named phase output: ``phase, n``."""
    rows = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("phase"), "n") for name, df in phases.items()]
    out = rows[0]
    for r in rows[1:]:
        out = out.union(r)
    return out
