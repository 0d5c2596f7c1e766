"""Files in, records out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import extension_hint, page_file, valid_page_file

INPUT = "doc_id long, path string, length long, content binary, sha256 string, ext string"


def scan_files(spark: SparkSession, path: str, pattern: str = "*", recursive: bool = True) -> DataFrame:
    """path, length, content, sha256 and ext of every file; doc_id is a hash of the path, so it is stable."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(path)
    return files.select(F.xxhash64("path").alias("doc_id"), "path", "length", "content", F.sha2("content", 256).alias("sha256"), extension_hint(F.col("path")).alias("ext"))


def scan_images(spark: SparkSession, path: str) -> DataFrame:
    """Decoded pictures (BGR) of a folder; files that cannot be decoded are dropped."""
    return spark.read.format("image").option("dropInvalid", True).load(path).select("image.*")


def write_records(records: DataFrame, path: str) -> None:
    """One JSON object a document; keys whose value is null are absent."""
    records.write.option("ignoreNullFields", "true").json(path)


def artifact(artifacts: DataFrame, jobs: DataFrame, job_id: Column, index: Column, variant: str = "") -> DataFrame:
    """(job_id, http, file): 200 with the file; 404 none, 409 not done, 410 expired."""
    want = page_file(index, variant)
    asked = jobs.where(F.col("job_id") == job_id).select("job_id", "status", want.alias("want"))
    met = asked.join(artifacts.where(valid_page_file(F.col("file"))), (asked["job_id"] == artifacts["job_id"]) & (F.col("file") == F.col("want")), "left")
    http = F.when(F.col("status") == "expired", 410).when(F.col("status") != "done", 409).when(F.col("file").isNull() | (index < 1), 404).otherwise(200)
    return met.select(asked["job_id"], http.alias("http"), F.when(http == 200, F.col("file")).alias("file"))
