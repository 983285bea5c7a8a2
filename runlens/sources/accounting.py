"""Scheduler accounting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.operators.jobs import job_fields

SCHEMA = "jobs array<struct<job_id: bigint, state: struct<current: string>, submit_line: string>>"
MANIFEST = "jobs array<struct<id: bigint, job_idx: bigint>>"


def read_job_accounting(spark: SparkSession, path: str, one_document: bool = True) -> DataFrame:
    """Job table from accounting JSON ``{"jobs": [...]}``: one document per file, or one per line."""
    entries = spark.read.schema(SCHEMA).json(path, multiLine=one_document).select(F.inline("jobs"))
    return job_fields(entries.select("job_id", F.col("state.current").alias("state"), "submit_line"))


def read_manifest(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Job manifests: listed ``(id, job_idx)`` pairs from documents, and bare ids from plain lists."""
    text = spark.read.text(path, wholetext=True)
    is_list = F.col("value").rlike(r"^\s*\[")
    listed = text.where(~is_list).select(F.inline(F.from_json("value", MANIFEST)["jobs"])).where("id is not null")
    ids = text.where(is_list).select(F.explode(F.from_json("value", "array<bigint>")).alias("id"))
    return listed, ids
