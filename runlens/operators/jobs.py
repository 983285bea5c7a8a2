"""Scheduler jobs: fields from submit lines, watch lists, retry plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.functions.columns import decode_comment, encode_comment, json_field
from runlens.operators.config import RERUN, filter_active
from runlens.operators.logs import tracking_url
from runlens.operators.patterns import match_patterns, parse_patterns

# Options recognised in a submit line.
COMMENT = r"--comment=([^ ]+)"
STDERR = r"-e ([^ ]+)"
STDOUT = r"-o ([^ ]+)"
# Fixed value: appended to a resubmitted line.
SILENCE = " 2>&1 1> /dev/null"
# Job states.
DONE = "COMPLETED"
BROKEN = ("FAILED", "CANCELLED")


def job_fields(jobs: DataFrame) -> DataFrame:
    """Comment, stderr and stdout paths from the submit line (NULL if absent); ``%j`` becomes the job id."""
    found = lambda p: F.when(F.col("submit_line").rlike(p), F.regexp_extract("submit_line", p, 1))
    with_id = lambda c: F.replace(c, F.lit("%j"), F.col("job_id").cast("string"))
    return jobs.select(
        "job_id", "state", found(COMMENT).alias("comment"), with_id(found(STDERR)).alias("stderr_file"),
        with_id(found(STDOUT)).alias("stdout_file"), "submit_line",
    )


def match_urls(jobs: DataFrame, urls: DataFrame, url: str = "url") -> DataFrame:
    """Jobs whose tracking URL is in the set; a job without URL never matches."""
    return jobs.join(urls.select(url), url, "left_semi")


def find_rerun_jobs(jobs: DataFrame, tracked: DataFrame, finished: DataFrame) -> DataFrame:
    """Active jobs marked as reruns that are neither tracked nor finished."""
    fresh = filter_active(jobs, rerun_only=True)
    return fresh.join(tracked.select("job_id"), "job_id", "left_anti").join(finished.select("job_id"), "job_id", "left_anti")


def tracked_status(tracked: DataFrame, jobs: DataFrame) -> DataFrame:
    """Current state of each tracked job; ``UNKNOWN`` when accounting does not list it."""
    out = tracked.select("job_id").join(jobs.select("job_id", "state"), "job_id", "left")
    return out.withColumn("state", F.coalesce("state", F.lit("UNKNOWN")))


def update_watchlist(tracked: DataFrame, add: DataFrame, remove: DataFrame) -> DataFrame:
    """Union of tracked and new ids without the finished ones."""
    ids = tracked.select("job_id").union(add.select("job_id")).distinct()
    return ids.join(remove.select("job_id"), "job_id", "left_anti")


def _json_text(value: Column) -> Column:
    wrapped = F.to_json(F.struct(value.alias("v")))
    return F.substring(wrapped, F.lit(6), F.length(wrapped) - 6)


def retry_plan(jobs: DataFrame, fallback_dir: str = "./") -> DataFrame:
    """How to resubmit each failed or cancelled job: fail count, new output paths, comment and submit line.

    The base path comes from a ``rerun:`` comment if there is a readable one, else it is the job id in the
    directory of stderr, or in the fallback directory. Nothing is submitted.
    """
    data = F.when(F.col("comment").startswith(RERUN), decode_comment(F.substring("comment", len(RERUN) + 1, 1 << 30)))
    old_base, old_count = json_field(data, "std_base"), json_field(data, "fail_count", "bigint")
    known = old_base.isNotNull() & old_count.isNotNull()
    folder = fallback_dir if fallback_dir.endswith("/") or not fallback_dir else fallback_dir + "/"
    prefix = F.coalesce(F.regexp_extract("stderr_file", "^(.*/)", 1), F.lit(folder))
    base = F.when(known, old_base).otherwise(F.concat(prefix, F.col("job_id").cast("string")))
    d = jobs.where(F.col("state").isin(*BROKEN)).select(
        "job_id", "state", "submit_line", base.alias("std_base"),
        F.when(known, old_count + 1).otherwise(F.lit(1).cast("long")).alias("fail_count"),
    )
    path = lambda ext: F.concat("std_base", F.lit("_"), F.col("fail_count").cast("string"), F.lit(ext))
    body = F.concat(
        F.lit('{"std_base": '), _json_text(F.col("std_base")), F.lit(', "fail_count": '), F.col("fail_count").cast("string"), F.lit("}")
    )
    d = d.withColumns({"stderr_path": path(".err"), "stdout_path": path(".out"), "comment": F.concat(F.lit(RERUN), encode_comment(body))})
    line = F.col("submit_line")
    for pattern in (COMMENT, STDERR, STDOUT):
        line = F.regexp_replace(line, pattern, "")
    line = F.concat(line, F.lit(SILENCE))
    start, rest = F.substring_index(line, " ", 1), F.substring(line, F.instr(line, " ") + 1, F.length(line))
    return d.withColumn(
        "submit_line",
        F.concat(start, F.lit(" -e "), "stderr_path", F.lit(" -o "), "stdout_path", F.lit(" --comment='"), "comment", F.lit("' "), rest),
    )


# The commands, and their older names.
COMMANDS = ("refresh_track", "cancel_ids", "cancel_regex", "find_regex", "cancel_urls", "find_urls")
ALIASES = {"cancel_wandb_urls": "cancel_urls", "find_wandb_urls": "find_urls"}


def apply_commands(commands: DataFrame, jobs: DataFrame, tracked: DataFrame, stderr: DataFrame | None = None) -> DataFrame:
    """Actions asked for by ``commands(name, arg)``: refresh, and cancel or find by ids, regex or tracking URL.

    Returns ``(job_id, action)`` with action ``track``, ``cancel`` or ``find``; a command that isn't known gives a row
    without a job and with action ``unknown``, a pattern that cannot be read one with action ``invalid``. URLs are a column ``url`` of ``jobs``, or are read off the jobs' error logs
    ``stderr(job_id, line_no, line)``; URL commands without either are an error. Commands are split by the
    kind of lookup so that ids and URLs are equi-joins, and patterns find their candidates by one (``match_patterns``).
    """
    watched = jobs.join(tracked.select("job_id"), "job_id", "left_semi")
    if stderr is not None:
        watched = watched.drop("url").join(tracking_url(stderr, ["job_id"]), "job_id", "left")
    name = F.col("name")
    for old, new in ALIASES.items():
        name = F.when(F.col("name") == old, new).otherwise(name)
    commands = commands.withColumn("name", name)
    unknown = commands.where(~F.coalesce(F.col("name").isin(*COMMANDS), F.lit(False))).select(F.lit(None).cast("long").alias("job_id"), F.lit("unknown").alias("action"))
    verb = F.when(F.col("name").startswith("cancel"), "cancel").otherwise("find")
    kind = lambda suffix: commands.where(F.col("name").isin(f"cancel_{suffix}", f"find_{suffix}")).withColumn("action", verb)

    refresh = commands.where("name = 'refresh_track'").agg(F.count(F.lit(1))).scalar()
    track = filter_active(jobs).where(refresh > 0).select("job_id", F.lit("track").alias("action"))

    ids = kind("ids").select("action", F.explode(F.split("arg", ",")).alias("_id")).where("action = 'cancel'")
    by_id = watched.join(ids.select("action", F.col("_id").cast("long").alias("job_id")).distinct(), "job_id")

    urls = kind("urls").select("action", F.explode(F.split("arg", ",")).alias("url")).distinct()
    if "url" in watched.columns:
        by_url = watched.join(urls, "url").select("job_id", "action")
    else:
        refuse = F.raise_error(F.lit("URL commands need the jobs' URLs or error logs")).cast("long")
        by_url = urls.select(refuse.alias("job_id"), "action")

    patterns = kind("regex").select("action", F.col("arg").alias("pattern"))
    parsed = parse_patterns(patterns)
    found = match_patterns(watched, "submit_line", ["job_id"], parsed)
    by_regex = found.join(patterns.distinct(), "pattern").select("job_id", "action")
    invalid = parsed.where("not valid").select(F.lit(None).cast("long").alias("job_id"), F.lit("invalid").alias("action"))
    parts = [by_id.select("job_id", "action"), by_url, by_regex, unknown, invalid]
    for part in parts:
        track = track.unionByName(part)
    return track.distinct()
