"""The corpus pipeline: five stages from raw documents to balanced shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.llm import decontam, mixing, shards, simhash, toxicity
from runlens.llm.common import fresh, read, saved
from runlens.session import ship_package

#: Subsequence-kernel scores, component search and the mixing draw are beyond SQL; the tests use brute force instead.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.5 or more go. The machine learns from these documents' own labels outside the held-out fold."""
    ship_package(spark)
    model = toxicity.train(docs, read(spark, sf_dir, "labels"))
    score = fresh(docs, "_toxic")
    return toxicity.score(docs, model, name=score).where(F.col(score) < 0.5).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one with the smallest id: fingerprints of four-word shingles, four bits apart at most."""
    ship_package(spark)
    return simhash.representatives(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item (0.8 of its five-word shingles) go. Rows are told apart by id and text."""
    key = fresh(docs, "_key")
    keyed = docs.withColumn(key, F.struct(F.col("doc_id"), F.coalesce(F.xxhash64("text"), F.lit(0)).alias("text_hash")))
    found = decontam.contained(keyed, read(spark, sf_dir, "benchmark"), doc_id=key).select(F.col("doc_id").alias("_found")).distinct()
    return keyed.join(found, F.col(key) == F.col("_found"), "left_anti").select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their target weights; documents that the mix takes twice are there twice."""
    return mixing.mixed_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sixteen shards of near-equal bytes, equal texts together: the documents with size, text_crc32, shard and slot."""
    return shards.assign(docs, extra=[c for c in docs.columns if c not in ("doc_id", "size", "text_crc32", "shard", "slot")])


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixed documents with their shard, from ``documents``, ``labels`` and ``benchmark`` below ``sf_dir``.

    Every stage is written and read again, and works on all rows the one before kept. NULL and empty texts are never
    toxic or contaminated; rows without words are one group of near copies, of which one stays. Rows are told apart
    by id and text, so NULL and repeated ids do no harm; exact repeats of a row go with the near copies. Ties go to
    the smallest id, NULL last. Texts are read whole. Further columns are carried along. An empty table gives an
    empty result.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
