"""Streams over tables of several files, and requests that are long or asked again."""

from pyspark.sql import functions as F

from codeloom.operators import model
from codeloom.plans import catalog


def _documents(spark, path, n, files, size=40):
    rows = spark.range(0, n, 1, files).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("walking and talking "), F.col("id").cast("string")).alias("text"), F.lit("en").alias("lang"), F.lit("src1").alias("source"), F.lit(size).cast("bigint").alias("n_chars")
    )
    rows.write.parquet(f"{path}/documents.parquet")


def test_stream_reads_a_table_that_is_a_folder(spark, tmp_path):
    _documents(spark, str(tmp_path), 30, 3)
    got = {r.id: r.codes for r in catalog.stream_resume(spark, str(tmp_path)).collect()}
    assert got == {str(k): "walking|talking" for k in range(30)}
    one = tmp_path / "one"
    one.mkdir()
    part = next((tmp_path / "documents.parquet").glob("part-00001*.parquet"))
    (one / "documents.parquet").write_bytes(part.read_bytes())
    assert sorted(int(r.id) for r in catalog.stream_resume(spark, str(one)).collect()) == list(range(10, 20))


def test_deliveries_are_not_written_by_one_task(spark, tmp_path):
    _documents(spark, str(tmp_path), 300, 6)
    spark.conf.set("spark.sql.files.openCostInBytes", "134217728")  # a split for each file
    try:
        sizes = []
        for _ in catalog._deliveries(spark, str(tmp_path), str(tmp_path / "in"), 3):
            sizes.append(len(spark.read.parquet(str(tmp_path / "in")).inputFiles()))
        assert sizes == [6, 12, 18]
        ids = [int(r.id) for r in spark.read.parquet(str(tmp_path / "in")).collect()]
        assert set(ids) == set(range(300)) and len(ids) == 300 + sum(k % 5 == 0 and k % 3 < 2 for k in range(300))
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_long_requests_come_few_at_a_time(spark):
    asked = spark.range(0, 600, 1, 1).select("id", F.repeat(F.lit("x"), 100_000).alias("prompt"))
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None)
    got = model.respond(asked, lambda prompts, models: [str(len(prompts))] * len(prompts))
    assert got.count() == 600 and max(int(r.response) for r in got.select("response").collect()) < 100
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) == before


def test_only_unusable_answers_are_asked_again_and_requests_are_rendered_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def rendered(x):
        seen.add(1)
        return x

    asked = spark.range(0, 50, 1, 2).select("id", F.udf(rendered)(F.col("id").cast("string")).alias("prompt"), F.lit("m").alias("model"))
    good, bad = model.respond_until_valid(asked, lambda prompts, models: [f"{m}{p}" if int(p) % 5 else None for p, m in zip(prompts, models)], F.col("response").isNotNull())
    assert sorted((r.id, r.response, r.attempt) for r in good.collect()) == [(k, f"m{k}", 1) for k in range(50) if k % 5]
    assert sorted((r.id, r.attempt) for r in bad.collect()) == [(k, 3) for k in range(0, 50, 5)]
    assert seen.value == 50
