"""Maintaining the codebook: exact matches, similar labels, new codes, usage counts."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions import text as T
from codeloom.operators.leaders import greedy_leaders
from codeloom.operators.ranking import with_position
from codeloom.operators.similarity import GramSpace, VectorSpace, best_match
from codeloom.session import cut_lineage

THETA = 0.90  # fixed value: the default merge threshold
SCHEMA = "id string, label string, description string, embedding array<float>, count bigint, ord bigint"


class Merge(NamedTuple):
    codebook: DataFrame  # id, label, description, embedding, count, ord
    label_map: DataFrame  # label, code_id, match_kind (exact / similar / new), sim
    rejects: DataFrame  # label, reason


def empty_codebook(spark) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def usable_codes(codebook: DataFrame) -> DataFrame:
    """Codes that can take part in vector comparison."""
    return codebook.filter(F.size("embedding") > 0)


def exact_matches(labels: DataFrame, codebook: DataFrame) -> DataFrame:
    """Labels that are in the codebook already; of several codes with a label the last one counts."""
    known = codebook.groupBy("label").agg(F.max_by("id", "ord").alias("code_id"))
    return labels.join(known, "label")


def new_labels(labels: DataFrame, codebook: DataFrame) -> DataFrame:
    return labels.join(codebook.select("label"), "label", "left_anti")


def nearest_code(space, probe: DataFrame, codes: DataFrame) -> DataFrame:
    """Best earlier code per item at or above the threshold: ``i, j, sim``."""
    return space.match(probe, codes, best=True)


def _cleaned(labels: DataFrame) -> DataFrame:
    """One row per stripped, non-blank label; occurrence counts are added up."""
    out = labels.withColumn("label", T.strip(F.col("label"))).filter(F.col("label") != "")
    aggs = [F.sum("n").alias("n") if "n" in labels.columns else F.count(F.lit(1)).alias("n")]
    if "embedding" in labels.columns:
        aggs.append(F.any_value("embedding", True).alias("embedding"))
    return out.groupBy("label").agg(*aggs)


def merge_labels(
    labels: DataFrame,
    codebook: DataFrame,
    theta: float = THETA,
    embed: Callable[[DataFrame], DataFrame] | None = None,
    by_frequency: bool = False,
    per_occurrence: bool = False,
) -> Merge:
    """Merge ``labels(label[, n][, embedding])`` into the codebook, greedily in order.

    New labels come after all existing codes, in label order or most frequent first. With
    ``embed`` (adds an ``embedding`` column) or an ``embedding`` column present the comparison
    is on vectors, otherwise on the labels' 3-grams. A label without a vector is rejected.
    """
    spark = labels.sparkSession
    cleaned = cut_lineage(_cleaned(labels))
    known = exact_matches(cleaned, codebook)
    order = [F.desc("n"), "label"] if by_frequency else ["label"]
    fresh = new_labels(cleaned, codebook)
    last = codebook.agg(F.max("ord")).first()[0]
    fresh = with_position(fresh, order, name="ord").withColumn("ord", F.col("ord") + F.lit(-1 if last is None else last))
    if embed is not None:
        fresh = embed(fresh)
    vectors = "embedding" in fresh.columns
    fresh = cut_lineage(fresh)  # the embedder runs once
    if vectors:
        bad = fresh.filter(F.coalesce(F.size("embedding"), F.lit(0)) <= 0)
        rejects = bad.select("label", F.lit("no_embedding").alias("reason"))
        fresh = fresh.filter(F.size("embedding") > 0)
        old = usable_codes(codebook)
        items = old.select("ord", "embedding").union(fresh.select("ord", F.col("embedding").cast("array<float>")))
        space = VectorSpace.build(items, theta)
    else:
        rejects = spark.createDataFrame([], "label string, reason string")
        old = codebook
        items = old.select("ord", "label").union(fresh.select("ord", "label"))
        space = GramSpace.build(items, theta)

    is_old = F.col("ord") <= F.lit(-1 if last is None else last)
    old_entries, new_entries = space.entries.filter(is_old), space.entries.filter(~is_old)
    free = new_entries
    if last is not None:
        best_old = cut_lineage(nearest_code(space, new_entries, old_entries))
        free = cut_lineage(new_entries.join(best_old.select(F.col("i").alias("ord")), "ord", "left_anti"))
    leaders = greedy_leaders(space, free)

    led = new_entries.join(leaders, "ord", "left_anti")
    nearest = nearest_code(space, led, new_entries.join(leaders, "ord", "left_semi"))
    if last is not None:
        nearest = best_match(best_old.union(nearest))

    created = fresh.join(leaders, "ord").withColumn("id", T.code_id(F.col("label")))
    ids = codebook.select("ord", "id").union(created.select("ord", "id"))
    similar = (
        fresh.select(F.col("ord").alias("i"), "label", "n")
        .join(nearest, "i")
        .join(ids.select(F.col("ord").alias("j"), F.col("id").alias("code_id")), "j")
    )
    mapped = cut_lineage(
        known.select("label", "code_id", F.lit("exact").alias("match_kind"), F.lit(None).cast("double").alias("sim"), "n")
        .union(similar.select("label", "code_id", F.lit("similar"), "sim", "n"))
        .union(created.select("label", "id", F.lit("new"), F.lit(None).cast("double"), "n"))
    )

    embedding = F.col("embedding").cast("array<float>") if vectors else F.lit(None).cast("array<float>")
    rows = codebook.select("id", "label", "description", "embedding", "count", "ord").union(
        created.select(
            "id", "label", F.lit(None).cast("string"), embedding, F.lit(0).cast("bigint"), F.col("ord").cast("bigint")
        )
    )
    return Merge(with_usage(rows, mapped, per_occurrence), mapped.drop("n"), rejects)


def with_usage(rows: DataFrame, mapped: DataFrame, per_occurrence: bool = False) -> DataFrame:
    """Raise the counts by one per label mapped to a code (or per occurrence of the label).

    A null count stands for one earlier use, but stays null while the code is not used again.
    """
    added = F.sum("n") if per_occurrence else F.count(F.lit(1))
    uses = mapped.groupBy(F.col("code_id").alias("id")).agg(added.alias("_uses"))
    count = F.when(F.col("_uses").isNotNull(), F.coalesce("count", F.lit(1)) + F.col("_uses")).otherwise(F.col("count"))
    return rows.join(uses, "id", "left").withColumn("count", count).drop("_uses")
