"""File listings: retention, empty folders, freshness, and which result files to read."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens.functions.columns import base_name, dir_name
from runlens.operators.blocks import block_of, dense_positions
from runlens.operators.ranges import id_ranges


def glob_regex(pattern: str) -> str:
    """A shell pattern (``*``, ``?``, ``[...]``) as an anchored regular expression."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        close = pattern.find("]", i + 2) if c == "[" else -1
        if c in "*?":
            out += ".*" if c == "*" else "."
        elif close > 0:
            body = pattern[i + 1 : close].replace("\\", "\\\\")
            out += "[" + ("^" + body[1:] if body[0] == "!" else body) + "]"
            i = close
        else:
            out += "\\" + c if not c.isalnum() and c not in "_/" else c
        i += 1
    return f"(?s)^{out}$"


def keep_recent(files: DataFrame, patterns: Sequence[str], n: int) -> DataFrame:
    """Per folder and pattern, flag the n newest files to keep and the rest for removal (``n <= 0``: keep none).

    Patterns apply to base names, each on its own. The result is a list to act on; nothing is deleted. Only
    the n newest per folder and pattern travel through the ranking, whatever the folder's size.
    """
    name = base_name(F.col("path"))
    hits = F.array_compact(F.array(*[F.when(name.rlike(glob_regex(p)), F.lit(p)) for p in patterns]))
    matched = files.select("folder", "path", "mtime", F.explode(hits).alias("pattern"))
    if n <= 0:
        return matched.withColumn("keep", F.lit(False))
    w = Window.partitionBy("folder", "pattern").orderBy(F.desc("mtime"), "path")
    newest = matched.withColumn("_rk", F.row_number().over(w)).where(F.col("_rk") <= n)
    marked = newest.select("pattern", "path", F.lit(True).alias("keep"))
    return matched.join(marked, ["pattern", "path"], "left").withColumn("keep", F.coalesce("keep", F.lit(False)))


def empty_folders(dirs: DataFrame, files: DataFrame) -> DataFrame:
    """Folders that hold neither files nor sub-folders, from manifests ``dirs(path)`` and ``files(path)``."""
    parents = files.select(dir_name(F.col("path")).alias("path")).union(dirs.select(dir_name(F.col("path")).alias("path")))
    return dirs.select("path").distinct().join(parents.distinct(), "path", "left_anti")


def freshness(runs: DataFrame, as_of: Column, by: Sequence[str] = ("sweep",), modified: str = "modified_at") -> DataFrame:
    """Age in seconds of the most recently touched run of each group."""
    age = (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(F.col(modified).cast("timestamp"))) / 1_000_000
    return runs.groupBy(*by).agg(F.min(age).alias("age_s"), F.count(modified).alias("n"))


def concat_scalar_files(scalars: DataFrame, choice: str = "largest", keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """Points per run and tag from decoded event files ``(run_id, file, size, mtime, tag, step, value)``.

    ``choice`` picks the ``largest``, ``earliest`` or ``latest`` file of a run, or ``all``, oldest first.
    """
    orders = {
        "largest": F.struct((-F.col("size")).alias("a"), "file"),
        "earliest": F.struct(F.col("mtime").alias("a"), "file"),
        "latest": F.struct((-F.unix_micros(F.col("mtime").cast("timestamp"))).alias("a"), "file"),
    }
    if choice == "all":
        picked = scalars
    elif choice in orders:
        best = scalars.groupBy(*keys).agg(F.min(orders[choice])["file"].alias("file"))
        picked = scalars.join(best, [*keys, "file"], "left_semi")
    else:
        raise ValueError(f"unknown choice: {choice}")
    order = ["mtime", "file", "step"] if choice == "all" else ["step"]
    lead = F.struct("mtime", "file", block_of("step").alias("b")) if choice == "all" else block_of("step")
    tied = [c for c in picked.columns if c not in (*keys, "file", "size", "mtime", "tag", "step", "value")]
    out = dense_positions(picked, [*keys, "tag"], [*order, *tied], lead)
    return out.select(*keys, F.col("tag").alias("metric"), "pos", "value")


def pick_job_results(files: DataFrame, name_filter: str | None = None, use_cache: bool = True, summary: str = "summary") -> DataFrame:
    """Result files to read per job folder: its summary alone if it has one, else all files matching the pattern."""
    is_summary = base_name(F.col("path")) == summary
    raw = files.where(~is_summary)
    if name_filter is not None:
        raw = raw.where(F.col("path").rlike(name_filter))
    if not use_cache:
        return raw.withColumn("cached", F.lit(False))
    cached = files.where(is_summary)
    rest = raw.join(cached.select("folder").distinct(), "folder", "left_anti")
    return cached.withColumn("cached", F.lit(True)).unionByName(rest.withColumn("cached", F.lit(False)))


def job_log_path(root: str, job: Column, idx: Column) -> Column:
    """Where the log of a job's part lies."""
    return F.concat(F.lit(root.rstrip("/") + "/"), job.cast("string"), F.lit("/output"), idx.cast("string"), F.lit("-0.log"))


def expand_manifest_jobs(jobs: DataFrame, root: str) -> DataFrame:
    """Listed ``(id, job_idx)`` pairs to log prefix and path; entries without id are skipped. Paths are not checked."""
    d = jobs.where(F.col("id").isNotNull())
    return d.select(
        F.concat_ws("-", F.col("id").cast("string"), F.col("job_idx").cast("string")).alias("prefix"),
        job_log_path(root, F.col("id"), F.col("job_idx")).alias("path"),
    )


def probe_job_logs(job_ids: DataFrame, existing: DataFrame, root: str) -> DataFrame:
    """Log parts 0, 1, 2, ... of each job up to the first missing one, from a listing ``existing(id, job_idx)``."""
    wanted = existing.join(job_ids.select("id").distinct(), "id", "left_semi")
    first = id_ranges(wanted, ["id"], "job_idx").where("lo = 0").select("id", F.col("hi").alias("_hi"))
    parts = first.withColumn("job_idx", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_hi"))))
    return expand_manifest_jobs(parts.select("id", "job_idx"), root)
