import re

from pyspark.sql import functions as F

import corpus_pipeline
from codeloom.llm import decontam, packing, pii, queries, simhash, toxicity

SF = "/root/testdata/sf0.001"


def test_each_stage_on_its_own_input(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, SF).cache()
        old, new = before.collect(), after.collect()
        if name == "toxicity":
            rate = queries.toxicity_model(spark, SF).scorer()
            assert sorted(new) == sorted(r for r in old if rate(r.text.encode())[0] < toxicity.ON_THRESHOLD)
        elif name == "simhash_neardup":
            prints = [simhash.fingerprint(r.text.encode()) for r in old]
            group = list(range(len(old)))
            changed = True
            while changed:
                changed = False
                for a in range(len(old)):
                    for b in range(a):
                        if group[a] != group[b] and (prints[a] ^ prints[b]).bit_count() <= 4:
                            group[a] = group[b] = min(group[a], group[b])
                            changed = True
            first = {}
            for r, g in zip(old, group):
                first[g] = min(first.get(g, r), r, key=lambda x: x.doc_id)
            assert sorted(new) == sorted(first.values())
        elif name == "decontamination":
            bad = {r.doc_id for r in decontam.overlaps(before, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
            assert bad and sorted(new) == sorted(r for r in old if r.doc_id not in bad)
        elif name == "pii":
            by = {r.doc_id: r for r in new}
            assert len(new) == len(old) and all(by[r.doc_id].text == pii.redacted(r.text) and by[r.doc_id].n_chars == len(by[r.doc_id].text) for r in old)
            assert not any(re.search(r"@mail[0-9]\.example\.com", r.text) for r in new)
        if name == "packing":
            tokenizer = packing.word_tokenizer(queries.vocabulary(queries.WORD_VOCABULARY)).tokenizer
            sizes = {r.doc_id: len(tokenizer.encode(r.text, add_special_tokens=False).ids) + 1 for r in old}
            packed = {}
            for r in new:
                packed[r.doc_id] = packed.get(r.doc_id, 0) + r.length
            assert packed == sizes
        else:
            assert after.columns == columns and after.schema == docs.schema
        before = after


def test_run_equals_the_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    key = lambda df: sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in df.collect())
    assert key(corpus_pipeline.run(spark, SF)) == key(docs)


def test_an_empty_table_passes_through(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.collect() == []


def test_odd_rows_and_clashing_columns_pass_through(spark, odd_docs):
    clashing = ["_fingerprint", "_lead_id", "_lead_fp", "_bad_id", "_bad_key", "lead_id", "lead_fp", "at", "root", "lang", "source", "n_chars"]
    docs = odd_docs.select("*", *[F.lit("?").alias(c) for c in clashing[:-1]], F.length("text").cast("bigint").alias("n_chars"))
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        if name != "packing":
            assert docs.columns == columns
        if name == "simhash_neardup":
            ids = [r.doc_id for r in docs.select("doc_id").collect()]
            assert ids.count(1) == 1 and 2 not in ids and ids.count(3) == 1 and not {4, 5} & set(ids) and {6, 7, 8} <= set(ids)
    assert {1, 3, 6, 7, 8} <= {r.doc_id for r in docs.collect()}
