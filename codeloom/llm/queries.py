"""One query per operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm import decontam, html_text, language_id, packing, pii, prefix_trie, quality_model, quality_rules, sharding, simhash, structure_repair, token_counts, toxicity
from codeloom.llm.common import crc_bucket, table

#: A vocabulary file is named by its parameter; the default is that of the installed package of public tokenizers.
WORD_VOCABULARY = "word_bpe_49k.json"
PIECE_VOCABULARY = "piece_bpe_32k.model"


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.detect(table(spark, sf_dir, "documents")))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), vocabulary(PIECE_VOCABULARY))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary(WORD_VOCABULARY), keep_tables=True)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "at", "agreeing", "compared")


def toxicity_model(spark: SparkSession, sf_dir: str) -> toxicity.Model:
    labels = table(spark, sf_dir, "labels").where(crc_bucket(F.col("doc_id"), 3) != 1)
    return toxicity.fit(table(spark, sf_dir, "documents"), labels)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score(table(spark, sf_dir, "documents"), toxicity_model(spark, sf_dir))
    held_out, predicted = crc_bucket(F.col("doc_id"), 3) == 1, (F.col("score") >= toxicity.ON_THRESHOLD).cast("int")
    return scored.select("doc_id", held_out.alias("held_out"), "score", predicted.alias("predicted"), "n_hits")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return quality_rules.judge(table(spark, sf_dir, "documents"), trusted)


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_text.extract(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


def op9_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_of("fp").alias("fingerprint"), "component_id")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(crc_bucket(F.col("doc_id"), 5) != 0)
    scored = quality_model.score(docs, quality_model.fit(docs, labels))
    held_out, predicted = crc_bucket(F.col("doc_id"), 5) == 0, (F.col("score") >= quality_model.ON_THRESHOLD).cast("int")
    return scored.select("doc_id", held_out.alias("held_out"), "score", predicted.alias("predicted"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, convs = prefix_trie.with_shared_heads(prefix_trie.turns(table(spark, sf_dir, "conversations")))
    return prefix_trie.digest(prefix_trie.build(rows, convs))


def op12_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return structure_repair.digest(conversations, structure_repair.repair(structure_repair.damage(conversations)))


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = crc_bucket(F.col("doc_id"), 4) == 2
    found = language_id.predict(docs, language_id.fit(docs.where(~held_out)))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected", "cross_entropy")


Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {
    f.__name__: f for f in (op1_pii_spans, op2_token_counts, op3_best_fit_packing, op4_decontamination, op5_toxicity, op6_sharding, op7_quality_rules, op8_html_extraction, op9_simhash_neardup, op10_quality_classifier, op11_prefix_trie, op12_structure_repair, op13_language_id)
}
ORACLES: dict[str, str] = {}
