"""A codebook kept as a log: every version adds its new codes, its uses and its labels, and nothing written before is touched.

``codes/version=N`` holds the codes that version N made, ``uses/version=N`` how often it used each code, ``map/version=N`` the labels
it mapped. ``log/version=N`` is written last: a version without that record does not count, so a torn write leaves the codebook as it
was, and writing a version again replaces it. Reading merges the versions over the last ``base``, a codebook written out whole now and
then, so neither a write nor a read grows with the number of versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.operators import codebook as cb
from codeloom.sources.readers import path_exists
from codeloom.sources.writers import write_version

CODES = "id string, label string, description string, embedding array<float>, ord bigint"
USES = "id string, n bigint"
MAP = "label string, code_id string, match_kind string, sim double"
RECORD = "codes bigint, labels bigint"
START = -1


class CodebookLog:
    def __init__(self, spark: SparkSession, root: str, base_every: int = 16):
        self.spark, self.root, self.base_every = spark, root.rstrip("/"), base_every

    def _table(self, name: str, schema: str) -> DataFrame:
        path = f"{self.root}/{name}"
        full = schema + ", version bigint"
        if not path_exists(self.spark, path):
            return self.spark.createDataFrame([], full)
        return self.spark.read.schema(full).format("json" if name in ("log", "base_log") else "parquet").load(path)

    def _versions(self, name: str, after: int | None, before: int | None) -> list[int]:
        rows = self._table(name, RECORD)
        rows = rows if after is None else rows.where(F.col("version") > after)
        rows = rows if before is None else rows.where(F.col("version") < before)
        return sorted(r.version for r in rows.select("version").distinct().collect())  # one number per version since the base

    def _span(self, before: int | None) -> tuple[int | None, list[int]]:
        """The last base, and the versions after it."""
        bases = self._versions("base_log", None, before)
        base = bases[-1] if bases else None
        return base, self._versions("log", base, before)

    def _written(self, name: str, schema: str, base: int | None, versions: list[int]) -> DataFrame:
        """The rows of a table in the base (there named ``base_<name>``) and the versions after it."""
        rows = self._table(name, schema).where(F.col("version").isin(versions)).drop("version")
        if base is None:
            return rows
        return self._table(f"base_{name}", schema).where(F.col("version") == base).drop("version").unionByName(rows)

    def start(self, codebook: DataFrame, label_map: DataFrame | None = None) -> None:
        """Begin with a codebook from elsewhere."""
        self._write_base(START, codebook, label_map if label_map is not None else self.spark.createDataFrame([], MAP))

    def read(self, before: int | None = None) -> DataFrame:
        """The codebook as of the last version (before ``before``, if given)."""
        base, versions = self._span(before)
        codes = self._table("codes", CODES).where(F.col("version").isin(versions)).drop("version").withColumn("count", F.lit(0).cast("bigint"))
        if base is not None:
            codes = self._table("base", cb.SCHEMA).where(F.col("version") == base).drop("version").unionByName(codes)
        uses = self._table("uses", USES).where(F.col("version").isin(versions)).groupBy("id").agg(F.sum("n").alias("_uses"))
        count = F.when(F.col("_uses").isNotNull(), F.coalesce("count", F.lit(1)) + F.col("_uses")).otherwise(F.col("count"))
        names = [f.split()[0] for f in cb.SCHEMA.split(", ")]
        return codes.join(uses, "id", "left").withColumn("count", count).select(*names)

    def label_map(self, before: int | None = None) -> DataFrame:
        """Every label mapped so far, with its code."""
        return self._written("map", MAP, *self._span(before))

    def append(self, version: int, merge: cb.Merge, last_ord: int | None) -> None:
        """Write what ``merge`` adds to the codebook whose greatest ``ord`` was ``last_ord`` (None: it was empty)."""
        new = merge.codebook.where(F.col("ord") > (START if last_ord is None else last_ord))
        write_version(new.select("id", "label", "description", "embedding", "ord"), f"{self.root}/codes", version)
        write_version(merge.label_map.groupBy(F.col("code_id").alias("id")).agg(F.count(F.lit(1)).alias("n")), f"{self.root}/uses", version)
        write_version(merge.label_map.select("label", "code_id", "match_kind", "sim"), f"{self.root}/map", version)
        self._record("log", version, f"{self.root}/codes/version={version}", f"{self.root}/map/version={version}")
        if self.base_every and len(self._span(None)[1]) >= self.base_every:
            self._write_base(version, self.read(), self.label_map())

    def _write_base(self, version: int, codebook: DataFrame, label_map: DataFrame) -> None:
        names = [f.split()[0] for f in cb.SCHEMA.split(", ")]
        write_version(codebook.select(*names), f"{self.root}/base", version)
        write_version(label_map.select("label", "code_id", "match_kind", "sim"), f"{self.root}/base_map", version)
        self._record("base_log", version, f"{self.root}/base/version={version}", f"{self.root}/base_map/version={version}")

    def _record(self, name: str, version: int, codes: str, labels: str) -> None:
        counts = [self.spark.read.parquet(p).count() for p in (codes, labels)]
        write_version(self.spark.createDataFrame([tuple(counts)], RECORD).coalesce(1), f"{self.root}/{name}", version, "json")

    def merge(self, version: int, labels: DataFrame, theta: float = cb.THETA, embed=None) -> cb.Merge:
        """Merge the labels that no earlier version has mapped, and write version ``version``.

        The version depends on those before it alone, so writing it again after a crash gives the same.
        """
        book = self.read(before=version)
        last = book.agg(F.max("ord")).first()[0]
        fresh = labels.join(self.label_map(before=version).select("label"), "label", "left_anti")
        merged = cb.merge_labels(fresh, book, theta, embed)
        self.append(version, merged, last)
        return merged
