"""Grouping codes into categories: best fit, merging of results, coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.operators.leaders import greedy_leaders
from codeloom.operators.ranking import with_position
from codeloom.operators.similarity import GramSpace, VectorSpace, matches_between
from codeloom.session import cut_lineage

BATCH_SIZE = 50  # fixed value: codes per categorization request


def code_batches(codebook: DataFrame, size: int = BATCH_SIZE) -> DataFrame:
    """Codes in codebook order, ``size`` per batch: ``batch, pos, code_id``."""
    placed = with_position(codebook.select(F.col("id").alias("code_id"), "ord"), ["ord"], name="_pos")
    return placed.select(
        F.floor((F.col("_pos") - 1) / size).cast("bigint").alias("batch"),
        ((F.col("_pos") - 1) % size).cast("bigint").alias("pos"),
        "code_id",
    )


def assignments_of(results: DataFrame, order: list[str]) -> DataFrame:
    """One row per code of the result rows, with its place: ``<keys>, code_pos, code_id``."""
    return results.select(*order, F.posexplode("code_assignments").alias("code_pos", "_a")).select(
        *order, F.col("code_pos").cast("bigint").alias("code_pos"), F.col("_a.code_id").alias("code_id")
    )


def merge_by_name(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Merge validated result rows ``(batch, pos, category_name, description, code_assignments)``.

    The first description wins, code ids are united, ids are ``cat_{n}`` by first appearance.
    Returns ``categories(category_id, category_name, description, ord)`` and
    ``category_codes(category_id, code_id, batch, pos, code_pos)``. ``results`` is read for
    both, so it should be a table and not a pending parse.
    """
    place = F.struct("batch", "pos")
    first = results.groupBy("category_name").agg(
        F.min_by("description", place).alias("description"), F.min(place).alias("first")
    )
    ranked = with_position(first, ["first", "category_name"], name="ord")
    categories = cut_lineage(
        ranked.select(F.concat(F.lit("cat_"), "ord").alias("category_id"), "category_name", "description", "ord")
    )
    codes = assignments_of(results, ["category_name", "batch", "pos"])
    codes = codes.groupBy("category_name", "code_id").agg(F.min(F.struct("batch", "pos", "code_pos")).alias("at"))
    codes = codes.join(categories.select("category_name", "category_id"), "category_name")
    return categories, codes.select("category_id", "code_id", "at.batch", "at.pos", "at.code_pos")


def with_found(known: DataFrame | None, found: DataFrame) -> DataFrame:
    """``category_name, description, first``: the categories known so far (none at first) and those of later results, each with its first
    description and place."""
    place = F.struct("batch", "pos")
    rows = found.select("category_name", "description", place.alias("first"))
    if known is not None:
        rows = known.unionByName(rows)
    return rows.groupBy("category_name").agg(F.min_by("description", "first").alias("description"), F.min("first").alias("first"))


def merge_by_id(categories: DataFrame, category_codes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Merge rows that share a ``category_id``: first name and description (by ``ord``), codes united."""
    merged = categories.groupBy("category_id").agg(
        F.min_by(F.struct("category_name", "description"), "ord").alias("_f"), F.min("ord").alias("ord")
    )
    return (
        merged.select("category_id", "_f.category_name", "_f.description", "ord"),
        category_codes.select("category_id", "code_id").distinct(),
    )


def nested_categories(categories: DataFrame, category_codes: DataFrame, per_part: int = 10_000) -> DataFrame:
    """The document form: one row per category with its code list.

    A category of more than ``per_part`` codes is spread over several rows numbered by
    ``part``, so that no row has to hold an unbounded list.
    """
    placed = with_position(category_codes.select("category_id", "code_id"), ["code_id"], ["category_id"], "_pos")
    lists = placed.groupBy("category_id", F.floor((F.col("_pos") - 1) / per_part).cast("bigint").alias("part")).agg(
        F.array_sort(F.collect_list(F.struct("code_id"))).alias("code_assignments")
    )
    none = F.array().cast("array<struct<code_id:string>>")
    return categories.join(lists, "category_id", "left").select(
        "category_id",
        F.coalesce("part", F.lit(0)).alias("part"),
        "category_name",
        "description",
        F.coalesce("code_assignments", none).alias("code_assignments"),
    )


def known_or_seeds(known: DataFrame, seeds: DataFrame) -> DataFrame:
    """Categories to offer: those known so far, or the seeds before there are any."""
    if known.isEmpty():
        return seeds
    return known.select("category_name", F.coalesce("description", F.lit("")).alias("description"))


def best_fit_by_keyword(codes: DataFrame, seeds: DataFrame, cutoff: float) -> tuple[DataFrame, DataFrame]:
    """Assign each code to the category of its most similar keyword.

    ``codes(code_id, label)``, ``seeds(keyword, category_name, seed_ord)``. The score is the
    3-gram cosine of label and keyword; ties go to the earlier keyword. Returns
    ``fit(code_id, category_name, score)`` and the codes at no keyword above the cut-off.
    """
    words = seeds.select(F.col("seed_ord").cast("bigint").alias("ord"), F.col("keyword").alias("label"), "category_name")
    placed = with_position(codes.select("code_id", "label"), ["label", "code_id"], name="ord")
    placed = cut_lineage(placed)
    best = cut_lineage(matches_between(GramSpace, placed, words, cutoff, best=True))
    fit = (
        placed.join(best.withColumnRenamed("i", "ord"), "ord")
        .join(words.select(F.col("ord").alias("j"), "category_name"), "j")
        .select("code_id", "category_name", F.col("sim").alias("score"))
    )
    return fit, placed.join(best.select(F.col("i").alias("ord")), "ord", "left_anti")


def emergent_categories(rest: DataFrame, theta: float) -> DataFrame:
    """New categories for ``rest(ord, code_id, label)``: each label led by the first similar enough one.

    Returns ``code_id, leader`` where ``leader`` is the label the new category is named after.
    """
    rest = cut_lineage(rest)
    space = GramSpace.build(rest.select("ord", "label"), theta)
    leaders = greedy_leaders(space, space.entries)
    led = space.entries.join(leaders, "ord", "left_anti")
    best = space.match(led, space.entries.join(leaders, "ord", "left_semi"), best=True)
    names = rest.select(F.col("ord").alias("j"), F.col("label").alias("leader"))
    mine = leaders.select(F.col("ord").alias("i"), F.col("ord").alias("j")).union(best.select("i", "j"))
    return mine.join(names, "j").join(rest.select(F.col("ord").alias("i"), "code_id"), "i").select("code_id", "leader")


def centroids(members: DataFrame) -> DataFrame:
    """Mean vector per category of ``members(category, embedding)``: ``category, embedding``.

    Averaged element-wise with partial aggregation, so a large category is no large group.
    """
    cells = members.select("category", F.posexplode("embedding").alias("k", "v"))
    means = cells.groupBy("category", "k").agg(F.avg(F.col("v").cast("double")).alias("v"))
    lists = means.groupBy("category").agg(F.array_sort(F.collect_list(F.struct("k", "v"))).alias("kv"))
    return lists.select("category", F.transform("kv", lambda e: e["v"].cast("float")).alias("embedding"))


def best_fit_by_vector(items: DataFrame, centers: DataFrame, cutoff: float) -> DataFrame:
    """Assign ``items(item_id bigint, embedding)`` to the nearest of ``centers(category, embedding)``.

    Returns ``item_id, category, score`` for items at or above the cut-off.
    """
    placed = cut_lineage(with_position(centers, ["category"], name="ord"))
    items = items.select(F.col("item_id").alias("ord"), "embedding")
    best = matches_between(VectorSpace, items, placed, cutoff, best=True)
    return best.join(placed.select(F.col("ord").alias("j"), "category"), "j").select(
        F.col("i").alias("item_id"), "category", F.col("sim").alias("score")
    )


def orphan_codes(codebook: DataFrame, category_codes: DataFrame) -> DataFrame:
    """Codes in no category, for instance because their batch failed."""
    return codebook.select(F.col("id").alias("code_id"), "label").join(category_codes.select("code_id"), "code_id", "left_anti")


def unknown_codes(codebook: DataFrame, category_codes: DataFrame) -> DataFrame:
    """Assignments to codes the codebook does not have."""
    return category_codes.join(codebook.select(F.col("id").alias("code_id")), "code_id", "left_anti")


def multi_category_codes(category_codes: DataFrame) -> DataFrame:
    """Codes assigned to more than one category."""
    counts = category_codes.distinct().groupBy("code_id").agg(F.count(F.lit(1)).alias("n_categories"))
    return counts.filter(F.col("n_categories") > 1)
