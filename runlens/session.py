"""Session settings and the shared work folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

#: Settings the operators rely on for large, skewed inputs.
RECOMMENDED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a skewed join side even when a later operator then needs one more shuffle
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # keep the map-side top-k limit (WindowGroupLimit) on for larger k as well
    "spark.sql.optimizer.windowGroupLimitThreshold": "100000",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.session.timeZone": "UTC",
}


#: Input bytes for each shuffle partition: columnar files grow some twenty times in the rows of a sort.
SHARE_BYTES = 32 << 20


def tune(builder: SparkSession.Builder) -> SparkSession.Builder:
    for key, value in RECOMMENDED.items():
        builder = builder.config(key, value)
    return builder


def sizing(input_bytes: int, partition_bytes: int = 256 << 20) -> dict[str, str]:
    """Shuffle settings for an input size: enough partitions that one fits in a task's memory; AQE merges small ones."""
    partitions = max(200, -(-input_bytes // partition_bytes))
    return {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(partition_bytes),
        "spark.sql.files.maxPartitionBytes": str(partition_bytes),
    }


def apply_runtime_settings(spark: SparkSession, input_bytes: int = 0) -> SparkSession:
    for key, value in {**RECOMMENDED, **(sizing(input_bytes) if input_bytes else {})}.items():
        spark.conf.set(key, value)
    return spark


def size_shuffles(spark: SparkSession, folder: str) -> None:
    """Shuffle partitions that grow with the input below ``folder``, so that one fits in a task's memory however large it is.

    Never fewer than the session asks for; adaptive execution merges small ones. Only the number that adaptive execution starts with is
    set, so the state of streams, which keeps its partitions, is not touched.
    """
    context, name = spark.sparkContext, "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    if not hasattr(context, "_runlens_partitions"):
        context._runlens_partitions = spark.conf.get(name, None)
    own = context._runlens_partitions
    path = context._jvm.org.apache.hadoop.fs.Path(str(folder))
    size = path.getFileSystem(context._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    wanted = -(-size // SHARE_BYTES)
    if wanted > int(own or spark.conf.get("spark.sql.shuffle.partitions")):
        spark.conf.set(name, str(wanted))
    elif own:
        spark.conf.set(name, own)
    else:
        spark.conf.unset(name)


def use_local_folder(spark: SparkSession) -> None:
    """For runs in one process that set no ``spark.checkpoint.dir``: a folder of this session, removed at its end."""
    context = spark.sparkContext
    if spark.conf.get("spark.checkpoint.dir", None) or getattr(context, "_runlens_folder", None):
        return
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="runlens-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    context._runlens_folder = folder


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark.sparkContext, "_runlens_folder", None)
    if not base:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return base.rstrip("/")


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder for written intermediates, below the shared folder."""
    return f"{shared_dir(spark)}/runlens/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint a table that several branches of a plan read."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application, for executors that don't have it installed."""
    context = spark.sparkContext
    if getattr(context, "_runlens_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    # a name of its own: Spark takes no second file of a name, and a runlens.zip may have been sent along already
    archive = os.path.join(tempfile.mkdtemp(prefix="runlens-package-"), f"runlens-{uuid.uuid4().hex}.zip")
    with zipfile.ZipFile(archive, "w", strict_timestamps=False) as out:  # files may be dated before 1980, entries not
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.join("runlens", os.path.relpath(path, root)))
    context.addPyFile(archive)
    context._runlens_shipped = True
