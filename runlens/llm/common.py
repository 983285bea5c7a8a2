"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.session import ship_package, work_dir

#: A word is a run of characters other than ASCII whitespace.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows a broadcast side may have at most; larger sides are joined by a shuffle.
BROADCAST_ROWS = 200_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write a table below the shared checkpoint folder and read it back: computed once, and lost executors don't matter."""
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.saved_at = path
    return table


def discard(spark: SparkSession, table: DataFrame) -> None:
    """Remove a table of ``saved`` that nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(table.saved_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the table doesn't have (Spark doesn't tell upper from lower case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def maybe_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast a side whose counted rows are within the bound; else leave the join to the shuffle."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def fold_of(doc_id: str | Column) -> Column:
    """crc32 of the id's text modulo 5; rows with remainder 0 are never learned from. NULL ids count as 0."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5, F.lit(0))


def sampled(key: Column, share: float) -> Column:
    """True for about ``share`` of all keys, always for the same ones."""
    return F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(1 << 30)) < math.ceil(min(share, 1.0) * (1 << 30))


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({WORD})"), F.lit(1))
