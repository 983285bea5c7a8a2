"""Shared pieces of the streaming jobs."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

BATCH = "batch_id"
SNAPSHOT = 50


def start(
    stream: DataFrame, process: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None, mode: str = "append"
) -> StreamingQuery:
    """Run ``process`` per micro-batch: at an interval (``"30 seconds"``), or over all available input and stop."""
    writer = stream.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint).outputMode(mode)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start()


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """Write one batch's rows into its own partition, replacing what a failed attempt may have left."""
    df.write.mode("overwrite").parquet(f"{path}/{BATCH}={batch_id}")


def read_before(spark: SparkSession, path: str, schema: T.StructType | str, batch_id: int | None = None) -> DataFrame:
    """Rows of the batches before ``batch_id`` (all of them without one); empty if nothing is written yet."""
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    full = T.StructType([*schema.fields, T.StructField(BATCH, T.LongType())])
    try:
        rows = spark.read.schema(full).option("basePath", path).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        return spark.range(0).where(F.lit(False)).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in full.fields])
    return rows if batch_id is None else rows.where(F.col(BATCH) < batch_id)


def batches_of(rows: DataFrame) -> set[int]:
    """Numbers of the batches, from the names of the files."""
    return {int(m[1]) for m in (re.search(rf"/{BATCH}=(\d+)/", f) for f in rows.inputFiles()) if m}


def newest_batch(rows: DataFrame) -> int:
    """Number of the newest batch, from the names of the files."""
    return max(batches_of(rows), default=0)


def since_snapshot(rows: DataFrame, batch_id: int | None = None) -> DataFrame:
    """Rows of the last snapshot before ``batch_id`` (the newest without one) and of the batches after it."""
    last = newest_batch(rows) if batch_id is None else max(batch_id - 1, 0)
    return rows.where(F.col(BATCH) >= last // SNAPSHOT * SNAPSHOT)


def prune(spark: SparkSession, path: str, below: int) -> None:
    """Remove batches that no reader needs: those before the snapshot before the last, which a repeated batch may read."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(folder):
        for status in fs.listStatus(folder):
            m = re.fullmatch(rf"{BATCH}=(\d+)", status.getPath().getName())
            if m and int(m[1]) < below:
                fs.delete(status.getPath(), True)


def latest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per key the row of the newest batch."""
    rest = [c for c in rows.columns if c not in (*keys, BATCH)]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), BATCH).alias("_r"))
    return newest.select(*keys, "_r.*")


def read_state(spark: SparkSession, path: str, schema: T.StructType | str, keys: list[str], batch_id: int | None = None, single: bool = False) -> DataFrame:
    """State per key as the batches before ``batch_id`` left it (the newest state without one).

    Every ``SNAPSHOT`` batches the whole state is written, so only the partitions since then are read. ``single`` says that a
    batch writes a key once: then rows are kept or not as they are, and those of a single batch are the state.
    """
    rows = since_snapshot(read_before(spark, path, schema, batch_id), batch_id)
    if not single:
        return latest(rows, keys)
    if len(batches_of(rows)) == 1:
        return rows.drop(BATCH)
    return rows.withColumn("_newest", F.max(BATCH).over(Window.partitionBy(*keys))).where(F.col(BATCH) == F.col("_newest")).drop(BATCH, "_newest")


def write_state(changed: DataFrame, before: DataFrame, path: str, keys: list[str], batch_id: int) -> None:
    """Write the keys a batch changed; at a snapshot, all others as well. What older snapshots left is removed then."""
    if batch_id % SNAPSHOT == 0 and batch_id > 0:
        changed = changed.unionByName(before.join(changed.select(*keys), keys, "left_anti").select(*changed.columns))
    write_batch(changed, path, batch_id)
    if batch_id % SNAPSHOT == 0:
        prune(before.sparkSession, path, batch_id - SNAPSHOT)
