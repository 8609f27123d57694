"""Building model requests: one prompt per row, from templates with named slots."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions import text as T
from codeloom.functions.prompts import render
from codeloom.operators import evidence as ev

NO_DESCRIPTION = "No hay descripción disponible."  # fixed value


def coding_prompts(insights: DataFrame, template: str) -> DataFrame:
    """Open coding, slot ``json_input``: ``id, prompt``."""
    body = T.indented_object(
        {
            "id_fragmento": T.json_scalar(F.col("id")),
            "fragmento_original": T.json_scalar(F.col("text")),
            "codigos_abiertos": F.lit("[]"),
        }
    )
    return insights.withColumn("prompt", render(template, {"json_input": body}))


def category_prompts(
    batches: DataFrame, codebook: DataFrame, template: str, known: list[dict] | DataFrame, questions: Sequence[str] = ()
) -> DataFrame:
    """Categorization, slots ``research_questions, seed_categories_json, codebook_map_json,
    codes_to_categorize_json``: ``batch, prompt``.

    ``known`` are the categories to offer, or one row ``known_json`` of them. The codebook map of a prompt holds
    the codes of its own batch. The whole codebook in every prompt would make the requests grow with the square of the codebook.
    """
    rows = batches.join(codebook.select(F.col("id").alias("code_id"), "label"), "code_id")
    lists = rows.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("pos", "code_id", "label"))).alias("c"))
    ids = F.transform("c", lambda x: T.indented_object({"code_id": T.json_scalar(x["code_id"])}, level=1))
    pairs = F.transform("c", lambda x: F.concat(T.json_scalar(x["code_id"]), F.lit(": "), T.json_scalar(x["label"])))
    offered = F.lit(as_json(known)) if isinstance(known, list) else F.col("known_json")
    if isinstance(known, DataFrame):  # one row, as long as the list that every prompt has to hold anyway
        lists = lists.withColumn("_one", F.lit(1)).join(F.broadcast(known.select("known_json", F.lit(1).alias("_one"))), "_one")
    slots = {
        "research_questions": F.lit("\n".join(f"- {q}" for q in questions)),
        "seed_categories_json": offered,
        "codebook_map_json": F.concat(F.lit("{\n  "), F.array_join(pairs, ",\n  "), F.lit("\n}")),
        "codes_to_categorize_json": T.indented_list(ids),
    }
    return lists.select("batch", render(template, slots).alias("prompt"))


def as_json(categories: list[dict]) -> str:
    return json.dumps(categories, indent=2, ensure_ascii=False)


def known_json(known: DataFrame, seeds: list[dict]) -> DataFrame:
    """One row ``known_json``: ``known(category_name, description, first)`` in order of ``first``, or the seeds where none is known."""
    said: dict[str, Column] = {"category_name": T.json_scalar(F.col("x.category_name")), "description": T.json_scalar(F.col("x.description"))}
    entries = known.select("first", F.struct("category_name", F.coalesce("description", F.lit("")).alias("description")).alias("x"))
    listed = entries.select("first", T.indented_object(said, level=1).alias("entry")).agg(F.array_sort(F.collect_list(F.struct("first", "entry"))).alias("e"))
    text = T.indented_list(F.transform("e", lambda x: x["entry"]))
    return listed.select(F.when(F.size("e") == 0, F.lit(as_json(seeds))).otherwise(text).alias("known_json"))


def _evidence_lists(parts: DataFrame) -> DataFrame:
    """Evidence of one request part in the order it was measured in; bounded by the request size."""
    return parts.groupBy("category_id", "part").agg(
        F.array_sort(F.collect_list(F.struct("running_chars", "insight_id", "text"))).alias("e")
    )


def axial_prompts(categories: DataFrame, resolved: DataFrame, template: str, limit: int = ev.EVIDENCE_CHAR_LIMIT) -> DataFrame:
    """Axial analysis, slots ``category_name, category_description, evidence_json``:
    ``category_id, category_name, part, prompt``.

    Evidence beyond the size of one request goes on in the next part; none is left out. ``resolved`` may have been
    placed by ``ev.evidence_parts`` before.
    """
    lists = _evidence_lists(resolved if "running_chars" in resolved.columns else ev.evidence_parts(resolved, limit))
    items = F.transform(
        "e",
        lambda x: T.indented_object(
            {"id_fragmento": T.json_scalar(x["insight_id"]), "fragmento_original": T.json_scalar(x["text"])}, level=1
        ),
    )
    slots = {
        "category_name": F.col("category_name"),
        "category_description": T.or_default(F.col("description"), NO_DESCRIPTION),
        "evidence_json": T.indented_list(items),
    }
    return categories.join(lists, "category_id").select(
        "category_id", "category_name", "part", render(template, slots).alias("prompt")
    )


def narrative_prompts(axial: DataFrame, resolved: DataFrame, template: str, limit: int = ev.EVIDENCE_CHAR_LIMIT) -> DataFrame:
    """Narration, slots ``category_name, paradigm_model_json, properties_json, evidence_json``:
    ``category_id, category_name, part, piece, prompt``.

    ``axial`` and ``resolved`` may have a ``part``: each analysis is told with its own evidence only, in as many
    pieces as that takes.
    """
    if "part" not in axial.columns:
        axial, resolved = axial.withColumn("part", F.lit(0).cast("bigint")), resolved.withColumn("part", F.lit(0).cast("bigint"))
    placed = ev.evidence_parts(resolved.withColumn("_told", F.struct("category_id", "part")), limit, key="_told", name="piece")
    lists = placed.groupBy("category_id", "part", "piece").agg(F.array_sort(F.collect_list(F.struct("running_chars", "insight_id", "text"))).alias("e"))
    pairs = F.transform("e", lambda x: F.concat(T.json_scalar(x["insight_id"]), F.lit(": "), T.json_scalar(x["text"])))
    evidence = F.concat(F.lit("{\n    "), F.array_join(pairs, ",\n    "), F.lit("\n}"))
    slots = {
        "category_name": F.coalesce("category_name", F.lit("N/A")),
        "paradigm_model_json": T.to_json(F.col("analysis.paradigm_model")),
        "properties_json": T.to_json(F.col("analysis.properties_and_dimensions")),
        "evidence_json": F.coalesce(evidence, F.lit("{}")),
    }
    return axial.join(lists, ["category_id", "part"], "left").select(
        "category_id", "category_name", F.col("part").cast("bigint").alias("part"), F.coalesce("piece", F.lit(0)).cast("bigint").alias("piece"),
        render(template, slots).alias("prompt"),
    )


def synthesis_prompts(narratives: DataFrame, template: str, model: str | None = None) -> DataFrame:
    """Synthesis of one category, slots ``category_name, full_narrative``; ``model`` overrides the default."""
    slots = {"category_name": F.col("category_name"), "full_narrative": F.col("narrative")}
    return narratives.withColumn("prompt", render(template, slots)).withColumn("model", F.lit(model).cast("string"))


def report_prompts(corpus: DataFrame, template: str, model: str | None = None) -> DataFrame:
    """The final report, slot ``synthesized_narratives``."""
    prompt = render(template, {"synthesized_narratives": F.col("corpus")})
    return corpus.withColumn("prompt", prompt).withColumn("model", F.lit(model).cast("string"))
