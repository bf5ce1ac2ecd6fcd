"""JSON evidence (findings of audit runs) and file evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FINDING = (
    "block int, source string, current string, problem string, reason string, suggestion string, severity string, confidence string, "
    "aspect string, pragmatic_reason string, issue_type string, ja_span string, missing_content string, ru_before string, "
    "not_compression_reason string, omission_scope string, omission_kind string"
)
RUN = f"audit_id string, audit_type string, audit_run_id string, chapter string, findings array<struct<{FINDING.replace(' string', ':string').replace(' int', ':int')}>>"


def findings(spark: SparkSession, path: str, glob: str = "*.json") -> DataFrame:
    """(path, modified, run fields, pos, finding) of audit runs; a broken or empty file has no rows."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter=glob, recursiveFileLookup=True)
    return findings_of(files.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("modified"), F.col("value").alias("text")))


def findings_of(files: DataFrame) -> DataFrame:
    """``findings`` of files as rows (path, modified, text), as ``project_files`` and ``archive`` give them."""
    d = files.select("path", "modified", F.from_json("text", RUN, {"mode": "PERMISSIVE"}).alias("r"))
    d = d.select("path", "modified", "r.audit_id", "r.audit_type", "r.audit_run_id", "r.chapter", F.posexplode("r.findings").alias("pos", "finding"))
    return d.select("path", "modified", "audit_id", "audit_type", "audit_run_id", "chapter", "pos", "finding.*")


def artifacts(spark: SparkSession, path: str) -> DataFrame:
    """(path, modified, bytes) of all files under a folder, read from metadata alone."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("bytes"))


def project_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, modified, text) of all files under a folder, each read whole."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("modified"), F.col("value").alias("text"))


def archive(spark: SparkSession, path: str) -> DataFrame:
    """The same of files packed as rows of Parquet, many thousands in one: a project of millions of small files is read as a few large ones."""
    return spark.read.schema("path string, modified timestamp, text string").parquet(path)


def archived_artifacts(files: DataFrame) -> DataFrame:
    """``artifacts`` of an archive: (path, modified, bytes)."""
    return files.select("path", "modified", F.octet_length("text").cast("long").alias("bytes"))
