"""From raw documents to packed training sequences: each stage works on all that the one before it kept.

Edge cases: null and empty texts score like texts without a match, are near-duplicates of each other (one stays), meet no benchmark item and are
packed as their closing id alone; null ids are documents like any other; rows with equal id and text are one document; very long texts are read whole; an
empty table passes through; further columns, whatever their names, pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codeloom.llm import decontam, packing, pii, queries, simhash, toxicity
from codeloom.llm.common import table
from codeloom.session import scratch_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, queries.toxicity_model(spark, sf_dir))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.first_of_each(docs)


def drop_benchmark_overlap(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, queries.vocabulary(queries.WORD_VOCABULARY))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_neardup", drop_near_duplicates),
    ("decontamination", drop_benchmark_overlap),
    ("pii", redact_personal_data),
    ("packing", pack_sequences),
]

# Learned scores, 64-bit hashes and tokenization have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; between stages the rows are written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
