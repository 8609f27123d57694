"""One axial analysis per category, from the analyses of its parts.

Neighbouring parts are united by a model in rounds, half as many each time, so a category of n parts takes log2(n) rounds whatever its
evidence. A prompt holds the items of two analyses, each cited by a short reference in place of its evidence; the answer is an analysis
that cites references. Evidence ids stay in a table and follow the references, so they neither grow the prompts nor can the model lose or
invent one. An item that the answer does not cite is kept as it is, and so are all items of a pair whose answer is unusable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions import text as T
from codeloom.functions.prompts import render
from codeloom.operators import contracts
from codeloom.operators.contracts import COMPONENTS, Split
from codeloom.operators.model import Responder, respond
from codeloom.session import cut_lineage

PROPERTIES = "properties_and_dimensions"
ITEM = "array<struct<list:string,pos:bigint,name:string,description:string,dimension:string,ids:array<string>>>"
_KEY = ["category_id", "part"]


def item_rows(analyses: DataFrame, keys: list[str]) -> DataFrame:
    """``keys..., list, pos, name, description, dimension, ids``: the items of ``paradigm_model`` and ``properties_and_dimensions``."""
    none = F.lit(None).cast("string")

    def items(path: str, name: str) -> Column:
        if name == PROPERTIES:
            made = F.transform(path, lambda x, i: F.struct(F.lit(name), i.cast("bigint"), x["property_name"], x["property_description"], x["dimensional_range"], x["evidence_insight_ids"]))
        else:
            made = F.transform(path, lambda x, i: F.struct(F.lit(name), i.cast("bigint"), none, x["description"], none, x["evidence_insight_ids"]))
        return F.coalesce(made.cast(ITEM), F.array().cast(ITEM))

    lists = [items(f"paradigm_model.{c}", c) for c in COMPONENTS] + [items(PROPERTIES, PROPERTIES)]
    return analyses.select(*keys, F.inline(F.flatten(F.array(*lists))))


def _analysis(items: str, ids) -> Column:
    """The document form of a sorted list of items; ``ids(item)`` gives what an item cites."""

    def listed(name: str) -> Column:
        own = F.filter(items, lambda x: x["list"] == name)
        if name == PROPERTIES:
            made = F.transform(own, lambda x: F.struct(x["name"].alias("property_name"), x["description"].alias("property_description"), x["dimension"].alias("dimensional_range"), ids(x).alias("evidence_insight_ids")))
        else:
            made = F.transform(own, lambda x: F.struct(x["description"].alias("description"), ids(x).alias("evidence_insight_ids")))
        return made.alias(name)

    return F.struct(F.struct(*[listed(c) for c in COMPONENTS]).alias("paradigm_model"), listed(PROPERTIES))


def _reference(side: Column, name: Column, pos: Column) -> Column:
    return F.concat_ws(".", side.cast("string"), name, pos.cast("string"))


def unite(axial: DataFrame, responder: Responder, template: str) -> Split:
    """``axial(category_id, category_name, part, analysis, ord)`` with one row, ``part`` 0, per category; slots of the template: ``category_name``,
    ``analyses_json``. Rejects are the unusable answers: ``category_id, round, part, reason``."""
    spark = axial.sparkSession
    place = F.row_number().over(Window.partitionBy("category_id").orderBy("part")) - 1  # one small row per part
    numbered = axial.select(*_KEY).join(axial.select(*_KEY).withColumn("own", place.cast("bigint")), _KEY)
    rows = cut_lineage(axial.join(numbered, _KEY).drop("part").withColumnRenamed("own", "part"))
    names = rows.groupBy("category_id").agg(F.min("category_name").alias("category_name"), F.min("ord").alias("ord"), F.count(F.lit(1)).alias("parts"))
    names = cut_lineage(names)
    every = item_rows(rows.select(*_KEY, "analysis.paradigm_model", f"analysis.{PROPERTIES}"), _KEY)
    items = cut_lineage(every.drop("ids"))
    evidence = cut_lineage(every.select(*_KEY, "list", "pos", F.explode("ids").alias("insight_id")).distinct())
    parts = names.select("category_id", "category_name", "parts")
    rejects = spark.createDataFrame([], f"category_id {axial.schema['category_id'].dataType.simpleString()}, round bigint, part bigint, reason string")
    most = names.agg(F.max("parts")).first()[0] or 1
    turn = 0
    while most > 1:
        turn += 1
        half, side = F.expr("part div 2"), F.col("part") % 2
        placed = items.join(parts, "category_id").withColumns({"g": half, "side": side, "paired": 2 * half + 1 < F.col("parts")})
        placed = cut_lineage(placed.withColumn("ref", _reference(F.col("side"), F.col("list"), F.col("pos"))))
        pairs = placed.where("paired")
        lists = pairs.groupBy("category_id", "category_name", "g").agg(F.array_sort(F.collect_list(F.struct("side", "list", "pos", "name", "description", "dimension", "ref"))).alias("i"))
        analyses = T.to_json(_analysis("i", lambda x: F.array(x["ref"])))
        prompts = lists.select("category_id", F.col("g").alias("part"), render(template, {"category_name": F.col("category_name"), "analyses_json": analyses}).alias("prompt"))
        answers = respond(prompts, responder, _KEY)
        split = contracts.validate_responses(answers, contracts.AXIAL_RESULT, "response", _KEY)
        rejects = rejects.unionByName(cut_lineage(split.rejects.select("category_id", F.lit(turn).cast("bigint").alias("round"), "part", "reason")))
        told = cut_lineage(item_rows(split.valid, _KEY))

        cited = told.select(*_KEY, "list", "pos", F.explode("ids").alias("ref")).distinct()
        kept = pairs.withColumnRenamed("part", "old").select("category_id", F.col("g").alias("part"), "side", "list", "pos", "name", "description", "dimension", "ref")
        kept = kept.join(cited.select(*_KEY, "ref"), [*_KEY, "ref"], "left_anti")
        sizes = told.groupBy(*_KEY, "list").agg(F.count(F.lit(1)).alias("n"))
        behind = F.row_number().over(Window.partitionBy(*_KEY, "list").orderBy("side", "pos")) - 1  # as many as two analyses have
        kept = kept.withColumn("k", behind).join(sizes, [*_KEY, "list"], "left").withColumn("at", (F.coalesce("n", F.lit(0)) + F.col("k")).cast("bigint"))
        kept = cut_lineage(kept)
        links = cited.unionByName(kept.select(*_KEY, "list", F.col("at").alias("pos"), "ref"))
        moved = evidence.withColumns({"g": half, "ref": _reference(side, F.col("list"), F.col("pos"))}).join(parts.select("category_id", "parts"), "category_id")
        alone = 2 * half + 1 >= F.col("parts")
        follow = moved.where(~alone).select("category_id", F.col("g").alias("part"), "ref", "insight_id").join(links, [*_KEY, "ref"]).select(*_KEY, "list", "pos", "insight_id").distinct()
        stay = moved.where(alone).select("category_id", F.col("g").alias("part"), "list", "pos", "insight_id")
        columns = [*_KEY, "list", "pos", "name", "description", "dimension"]
        evidence, items = cut_lineage(follow.unionByName(stay)), cut_lineage(
            told.select(*columns)
            .unionByName(kept.drop("pos").withColumnRenamed("at", "pos").select(*columns))
            .unionByName(placed.where("NOT paired").drop("part").withColumnRenamed("g", "part").select(*columns))
        )
        parts = parts.withColumn("parts", F.expr("(parts + 1) div 2"))
        most = (most + 1) // 2
    # The document form: lists of items that hold their evidence.
    held = evidence.groupBy(*_KEY, "list", "pos").agg(F.array_sort(F.collect_list("insight_id")).alias("ids"))
    full = items.join(held, [*_KEY, "list", "pos"], "left").withColumn("ids", F.coalesce("ids", F.array().cast("array<string>")))
    lists = full.groupBy("category_id").agg(F.array_sort(F.collect_list(F.struct("list", "pos", "name", "description", "dimension", "ids"))).alias("i"))
    none = F.array().cast("array<struct<list:string,pos:bigint,name:string,description:string,dimension:string,ids:array<string>>>")
    documents = names.join(lists, "category_id", "left").withColumn("i", F.coalesce("i", none))
    return Split(documents.select("category_id", "category_name", F.lit(0).cast("bigint").alias("part"), _analysis("i", lambda x: x["ids"]).alias("analysis"), "ord"), rejects)
