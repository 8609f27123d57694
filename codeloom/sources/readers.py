"""Reading the inputs of a study."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from codeloom.functions import parsing
from codeloom.functions import text as T
from codeloom.operators import contracts
from codeloom.operators.contracts import Split
from codeloom.operators.ranking import with_position

INSIGHTS = "id string, text string"
CODED = (
    "id string, text string, id_fragmento string, fragmento_original string, "
    "codigos_abiertos array<string>, error string, unified_code_ids array<string>"
)
CORRUPT = "_corrupt_record"


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", **options: str) -> DataFrame:
    """A tabular source in any format Spark reads."""
    if fmt == "csv":
        options = {"header": "true", "multiLine": "true", "escape": '"', **options}
    return spark.read.format(fmt).options(**options).load(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def read_jsonl(spark: SparkSession, path: str, schema: str = INSIGHTS) -> DataFrame:
    """JSON lines, strict: one bad line fails the job. Blank lines are skipped."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_jsonl_or_empty(spark: SparkSession, path: str, schema: str = INSIGHTS) -> DataFrame:
    """JSON lines, where a missing file stands for no rows."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    return read_jsonl(spark, path, schema)


def read_appended(spark: SparkSession, path: str, schema: str = INSIGHTS) -> DataFrame:
    """The rows of all runs that ``writers.append_once`` has finished, with their ``run_id``; a missing path stands for no rows."""
    full = schema + ", run_id string"
    if not path_exists(spark, f"{path}/runs"):
        return spark.createDataFrame([], full)
    runs = spark.read.schema("run_id string, folder string").json(f"{path}/runs").select("run_id", "folder").where("folder IS NOT NULL")
    folders = [f"{path}/data/{r.folder}" for r in runs.select("folder").collect()]  # one per run
    if not folders:
        return spark.createDataFrame([], full)
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(folders)
    folder = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    return rows.withColumn("_folder", folder).join(F.broadcast(runs.withColumnRenamed("folder", "_folder")), "_folder").drop("_folder")


def read_checkpoint(spark: SparkSession, path: str, schema: str = CODED) -> Split:
    """JSON lines, tolerant: corrupt lines go to the rejects as ``line``."""
    if not path_exists(spark, path):
        return Split(spark.createDataFrame([], schema), spark.createDataFrame([], "line string"))
    lines = spark.read.text(path).filter(~T.is_blank(F.col("value")))
    typed = StructType.fromDDL(schema).add(CORRUPT, "string")
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    rows = lines.select("value", F.from_json("value", typed, options).alias("r"))
    bad = F.col(f"r.{CORRUPT}").isNotNull()
    names = [f.name for f in StructType.fromDDL(schema).fields]
    return Split(
        rows.filter(~bad).select(*[F.col("r")[n].alias(n) for n in names]),
        rows.filter(bad).select(F.col("value").alias("line")),
    )


def read_jsonl_checked(spark: SparkSession, path: str, contract: contracts.Record) -> Split:
    """JSON lines held against a contract: typed rows, and rejects as ``line, errors``."""
    lines = spark.read.text(path).filter(~T.is_blank(F.col("value"))).select(F.col("value").alias("line"))
    parsed = parsing.computed(lines, value=parsing.parse_strict(F.col("line")))
    readable = contracts.validate(parsed.filter(F.col("value").isNotNull()), contract, keep=("line",))
    broken = parsed.filter(F.col("value").isNull()).select("line", F.array(F.lit("$:unparsable")).alias("errors"))
    return Split(readable.valid.drop("line"), readable.rejects.union(broken))


def read_document(spark: SparkSession, path: str) -> DataFrame:
    """Whole JSON documents, one row per file: ``value variant``, null where a file is no JSON.

    A JSON document cannot be split. Data that grows belongs in JSON lines or a table.
    """
    texts = spark.read.text(path, wholetext=True)
    text = F.regexp_replace("value", "^\\x{FEFF}", "")
    return parsing.computed(texts.select(text.alias("text")), value=parsing.parse_strict(F.col("text"))).select("value")


def document_items(doc: DataFrame, path: str = "$") -> DataFrame:
    """Elements of an array in a document, with their position: ``pos, item variant``."""
    items = F.try_variant_get("value", path, "array<variant>")
    return doc.select(F.posexplode(items).alias("pos", "item")).withColumn("pos", F.col("pos").cast("bigint"))


def _value_lines(spark: SparkSession, path: str, whole_keys: tuple[str, ...] = ()) -> DataFrame | None:
    """``value`` of each line where the files are JSON lines, as the writers leave them, else None (one document).

    The first line decides: an object on a line of its own is a row, unless it has one of ``whole_keys``.
    """
    lines = spark.read.text(path).filter(~T.is_blank(F.col("value"))).select(F.col("value").alias("line"))
    first = lines.limit(1).select(parsing.parse_strict(F.col("line")).alias("v"))
    is_row = F.try_variant_get("v", "$", "map<string,variant>").isNotNull()
    for k in whole_keys:
        is_row = is_row & F.try_variant_get("v", f"$.{k}", "array<variant>").isNull()
    seen = first.select(F.coalesce(is_row, F.lit(False)).alias("r")).first()
    if seen is not None and not seen.r:
        return None
    return parsing.computed(lines, value=parsing.parse_strict(F.col("line"))).select("value")


def _checked(rows: DataFrame, problem) -> DataFrame:
    """``value`` of the rows; reading one with a problem fails with the problem's text."""
    found = parsing.computed(rows, problem=problem)
    fine = F.col("value").isNotNull() & (F.col("problem") == "")
    return found.select(F.when(fine, F.col("value")).otherwise(F.raise_error(F.col("problem")).cast("variant")).alias("value"))


def read_codebook(spark: SparkSession, path: str) -> DataFrame:
    """The codebook as ``id, label, description, embedding, count, ord``, from one document or from lines as written.

    No file means an empty codebook. A corrupt or invalid one is an error: carrying on with
    an empty codebook would overwrite it.
    """
    if not path_exists(spark, path):
        from codeloom.operators.codebook import empty_codebook

        return empty_codebook(spark)
    rows = _value_lines(spark, path, ("codes",))
    contract = contracts.CODEBOOK if rows is None else contracts.CODE
    problem = F.when(F.col("value").isNull(), F.lit("codebook: not JSON")).otherwise(
        F.array_join(contracts.errors_of(contract, F.col("value")), ", ")
    )
    if rows is None:
        items = document_items(_checked(read_document(spark, path), problem), "$.codes").withColumnRenamed("pos", "ord")
    else:
        items = _checked(rows, problem).select(F.col("value").alias("item"), F.try_variant_get("value", "$.ord", "bigint").alias("ord"))
    typed = contracts.CODE.columns(F.col("item"))
    typed["embedding"] = typed["embedding"].cast("array<float>")
    return items.select(*[c.alias(n) for n, c in typed.items()], "ord")


def read_embedding_dim(spark: SparkSession, path: str) -> int | None:
    """The length of the codebook's vectors as it was written down, None where it was not."""
    rows = _value_lines(spark, path, ("codes",))
    if rows is None:
        found = read_document(spark, path).select(F.try_variant_get("value", "$.metadata.embedding_dim", "bigint").alias("n"))
    else:
        found = rows.select(F.try_variant_get("value", "$.embedding_dim", "bigint").alias("n"))
    return found.agg(F.max("n")).first()[0]


def read_categories(spark: SparkSession, path: str) -> Split:
    """The categories, from one document or from lines as written: valid rows with ``ord``, rejects with ``errors``.

    ``ord`` is the place in the document, or the ``ord`` of a line (null where it has none). A document that is no list is a reject.
    """
    rows = _value_lines(spark, path)
    if rows is not None:
        parsed = rows.withColumn("ord", F.try_variant_get("value", "$.ord", "bigint"))
        checked = contracts.validate(parsed.filter(F.col("value").isNotNull()), contracts.CATEGORY, keep=("ord",))
        broken = parsed.filter(F.col("value").isNull()).select("ord", F.array(F.lit("$:unparsable")).alias("errors"))
        return Split(checked.valid, checked.rejects.select("ord", "errors").unionByName(broken))
    doc = read_document(spark, path)
    items = document_items(doc).withColumnsRenamed({"item": "value", "pos": "ord"})
    checked = contracts.validate(items, contracts.CATEGORY, keep=("ord",))
    no_list = doc.filter(F.try_variant_get("value", "$", "array<variant>").isNull())
    broken = no_list.select(F.lit(None).cast("bigint").alias("ord"), F.array(F.lit("$:not_a_list")).alias("errors"))
    return Split(checked.valid, checked.rejects.select("ord", "errors").unionByName(broken))


def seed_categories(config: DataFrame) -> DataFrame:
    """Seed categories of a project configuration document: ``seed_ord, category_name, description, keywords``."""
    spec = "struct<category_name:string,description:string,keywords:array<string>>"
    items = document_items(config, "$.seed_categories")
    typed = F.try_variant_get("item", "$", spec)
    return items.select(F.col("pos").alias("seed_ord"), typed.alias("s")).select("seed_ord", "s.*")


def seed_keywords(seeds: DataFrame) -> DataFrame:
    """One row per keyword: ``keyword, category_name, seed_ord`` with a running ordinal."""
    rows = seeds.select(F.col("seed_ord").alias("_seed"), "category_name", F.posexplode("keywords").alias("_k", "keyword"))
    placed = with_position(rows, ["_seed", "_k", "category_name", "keyword"], name="_place")
    return placed.select("keyword", "category_name", (F.col("_place") - 1).alias("seed_ord"))


def research_questions(config: DataFrame) -> DataFrame:
    return document_items(config, "$.research_questions").select("pos", F.try_variant_get("item", "$", "string").alias("question"))
