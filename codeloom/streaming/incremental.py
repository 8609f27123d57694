"""Coding and codebook maintenance over files that keep arriving.

Which insights have been taken up is keyed state of the stream (id and attempt), kept by the engine's state store: a micro-batch
looks up its own ids and never reads what earlier batches wrote. Insights whose coding failed are written to a folder that is itself a
source of the stream, one attempt higher, so they come up again in the next run until their tries are used up. Each micro-batch writes
its own ``batch_id=N`` folder and replaces it when the batch is replayed after a crash, so results are exactly once without a transactional sink.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamReader

from codeloom.operators import codebook as cb
from codeloom.operators import ingest
from codeloom.operators.contracts import Split
from codeloom.session import cut_lineage
from codeloom.sources.codebook_log import CodebookLog
from codeloom.sources.readers import path_exists

CODED = "id string, text string, id_fragmento string, fragmento_original string, codigos_abiertos array<string>, error string"
AGAIN = "id string, text string, attempt bigint"
FAILED = "id string, insight_original struct<id:string,text:string>, error string, attempt bigint, final boolean"
TRIES = 3  # runs in which an insight is taken up

Coder = Callable[[DataFrame], "DataFrame | Split"]


def insight_stream(reader: DataStreamReader, path: str, schema: str, max_files: int | None = None) -> DataFrame:
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.schema(schema).parquet(path)


def _by_batch(spark: SparkSession, path: str, schema: str) -> DataFrame:
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema + ", batch_id bigint")
    return spark.read.schema(schema + ", batch_id bigint").parquet(path)


def coded_so_far(spark: SparkSession, out: str, before: int | None = None) -> DataFrame:
    """Rows coded by finished batches (those before batch ``before``, if given)."""
    rows = _by_batch(spark, out, CODED)
    return (rows if before is None else rows.filter(F.col("batch_id") < before)).drop("batch_id")


def failed_so_far(spark: SparkSession, out: str) -> DataFrame:
    """Failures of all batches; ``final`` ones do not come up again."""
    return _by_batch(spark, f"{out}.failed", FAILED).drop("batch_id")


def rule_coder(insights: DataFrame) -> DataFrame:
    """Default coder: rule-based labels. Any function giving the same columns can take its place."""
    coded = ingest.open_code(insights.select("id", "text"))
    return coded.select(
        "id", "text", F.col("id").alias("id_fragmento"), F.col("text").alias("fragmento_original"), "codigos_abiertos",
        F.lit(None).cast("string").alias("error"),
    )


def code_stream(
    insights: DataFrame,
    out: str,
    checkpoint: str,
    coder: Coder = rule_coder,
    after_batch: Callable[[DataFrame, int], None] | None = None,
    tries: int = TRIES,
) -> None:
    """Code every insight of a stream ``(id, text)`` once; runs until the available input is used up.

    ``coder`` is given ``id, text, attempt`` and gives coded rows, or a split of those and failed ones ``(id, insight_original, error)``. An
    id that has been taken up is skipped when it arrives again, whichever batch or run had it; of several rows with one id in
    one micro-batch one is taken, so rows that differ need ids of their own. Failed insights are offered again by the next run, up to
    ``tries`` in all, and listed in ``<out>.failed``. Rows that a coder leaves out altogether are not recorded.
    """
    spark = insights.sparkSession
    again = f"{out}.retry"
    if not path_exists(spark, again):
        spark.createDataFrame([], AGAIN).write.mode("overwrite").parquet(f"{again}/batch_id=none")
    returned = spark.readStream.schema(AGAIN).option("recursiveFileLookup", "true").parquet(again)
    offered = insights.select("id", "text", F.lit(1).cast("bigint").alias("attempt")).unionByName(returned)

    def run(batch: DataFrame, batch_id: int) -> None:
        todo = cut_lineage(batch)  # read once, so the state is asked once
        given = coder(todo)
        coded, failed = (given.valid, given.rejects) if isinstance(given, Split) else (given, None)
        coded.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")
        if failed is not None:
            tried = todo.select(F.col("id").alias("_id"), "attempt")
            marked = failed.join(tried, failed["id"].eqNullSafe(tried["_id"])).select("id", "insight_original", "error", "attempt", (F.col("attempt") >= tries).alias("final"))
            marked = cut_lineage(marked)
            marked.write.mode("overwrite").parquet(f"{out}.failed/batch_id={batch_id}")
            back = marked.where(~F.col("final")).select("id", F.col("insight_original.text").alias("text"), (F.col("attempt") + 1).alias("attempt"))
            back.write.mode("overwrite").parquet(f"{again}/batch_id={batch_id}")
        if after_batch:
            after_batch(batch.sparkSession.read.schema(CODED).parquet(f"{out}/batch_id={batch_id}"), batch_id)

    fresh = offered.dropDuplicates(["id", "attempt"])
    query = fresh.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def codebook_keeper(root: str, theta: float = cb.THETA, embed=None, base_every: int = 16) -> Callable[[DataFrame, int], None]:
    """An ``after_batch`` step that adds a batch's labels to the codebook log under ``root``, as version ``batch_id``.

    Only labels that no earlier version has mapped are merged. A codebook to begin with goes there by ``CodebookLog.start``.
    """

    def run(coded: DataFrame, batch_id: int) -> None:
        CodebookLog(coded.sparkSession, root, base_every).merge(batch_id, ingest.distinct_labels(coded), theta, embed)

    return run


def latest_codebook(spark: SparkSession, root: str) -> DataFrame:
    return CodebookLog(spark, root).read()


def label_map(spark: SparkSession, root: str) -> DataFrame:
    return CodebookLog(spark, root).label_map()
