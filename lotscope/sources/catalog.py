"""Publishing runs and keeping them: never overwritten, known by the digest of their bytes."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lotscope.functions.text import contacts
from lotscope.sources.tabular import forbidden_keys

REQUIRED = ("listing_id", "source", "fetch_status")


def refusal(status: Column, listing_id: Column, mileage_status: Column) -> Column:
    """Why a row may not be published, or null."""
    return F.when(listing_id.isNull(), "no id").when(~status.eqNullSafe("ok"), "fetch not ok").when(mileage_status.isin("suspicious", "impossible"), "mileage is tainted")


def promoted(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(published, refused): rows with a reason stand in the second."""
    marked = df.withColumn("refusal", refusal(F.col("status"), F.col("listing_id"), F.col("mileage_status")))
    return marked.where("refusal is null").drop("refusal"), marked.where("refusal is not null")


def serialize(run: dict) -> bytes:
    """The bytes of a run artifact: sorted keys, an indent of one, UTF-8, a closing line end. The same run gives the same bytes."""
    return (json.dumps(run, ensure_ascii=False, sort_keys=True, indent=1) + "\n").encode()


def digest(run: dict) -> str:
    return hashlib.sha256(serialize(run)).hexdigest()


def violations(df: DataFrame, key: str) -> DataFrame:
    """(key, field, found): one row for each contact in a text field; raises if the schema itself has a forbidden key."""
    if bad := forbidden_keys(df.schema):
        raise ValueError(f"forbidden keys: {', '.join(bad)}")
    fields = [f for f, t in df.dtypes if t == "string" and f != key]
    rows = df.select(key, F.explode(F.array(*(F.struct(F.lit(f).alias("field"), contacts(F.coalesce(F.col(f), F.lit(""))).alias("found")) for f in fields))).alias("x"))
    return rows.select(key, "x.field", F.explode("x.found").alias("found"))


def write_snapshot(df: DataFrame, path: str, snapshot_id: str) -> str:
    """Write a snapshot under its id, or under id-2, id-3, ... if that is taken; returns the name."""
    spark = df.sparkSession
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    name, n = snapshot_id, 1
    while fs.exists(fs_path(f"{path}/{name}")):
        n += 1
        name = f"{snapshot_id}-{n}"
    df.write.mode("errorifexists").parquet(f"{path}/{name}")
    return name


class Catalog:
    """Runs as a table partitioned by run_id, with their digests beside it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _read(self, name: str) -> DataFrame | None:
        from pyspark.errors import AnalysisException

        try:
            return self.spark.read.parquet(f"{self.path}/{name}")
        except AnalysisException:
            return None

    def load(self, run_id: str, sha256: str, records: DataFrame) -> str:
        """unchanged (nothing is read), loaded or replaced."""
        runs = self._read("runs")
        known = runs.where(F.col("run_id") == run_id).select("sha256").first() if runs is not None else None
        if known is not None and known["sha256"] == sha256:
            return "unchanged"
        before = self.spark.conf.get("spark.sql.sources.partitionOverwriteMode")
        self.spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
        try:
            rows = records.withColumn("model_key", F.trim(F.coalesce("model", F.lit("")))).withColumn("run_id", F.lit(run_id))
            rows.repartition("model_key").sortWithinPartitions("model_key").write.mode("overwrite").partitionBy("run_id").parquet(f"{self.path}/listings")
            self.spark.createDataFrame([(sha256, run_id)], "sha256 string, run_id string").write.mode("overwrite").partitionBy("run_id").parquet(f"{self.path}/runs")
        finally:
            self.spark.conf.set("spark.sql.sources.partitionOverwriteMode", before)
        return "loaded" if known is None else "replaced"

    def runs(self) -> DataFrame:
        return self._read("runs").orderBy("run_id")

    def records(self, run_id: str) -> DataFrame:
        return self._read("listings").where(F.col("run_id") == run_id)

    def of_model(self, model: str, make: str = "") -> DataFrame:
        """Rows of a model in all runs, under any make if none is given: pruned by sorted files."""
        rows = self._read("listings").where(F.col("model_key") == model.strip())
        return rows.where(F.trim(F.coalesce("make", F.lit(""))) == make.strip()) if make.strip() else rows

    def verify(self, run_id: str, sha256: str) -> bool:
        got = self.runs().where(F.col("run_id") == run_id).first()
        return got is not None and got["sha256"] == sha256
