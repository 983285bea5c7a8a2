"""Live job tracking and commands."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from runlens.operators.jobs import BROKEN, DONE, apply_commands
from runlens.streaming.core import BATCH, read_before, read_state, start, write_batch, write_state

POLL = "30 seconds"
# state reported for a job the user cancelled here; it is finished without a retry
USER_CANCEL = "USER_CANCELLED"
FINISHED_SCHEMA = "job_id bigint, state string, action string"


def track_jobs(
    status: DataFrame, out: str, checkpoint: str, tracked: DataFrame | None = None, every: str | None = None
) -> StreamingQuery:
    """Finish each tracked job at its first terminal state: ``finished``, or ``retry`` when it failed or was cancelled.

    ``status(job_id, state, seq)`` are polled rows, repeated at will; without ``tracked(job_id)`` all of them are
    tracked. A job the user cancelled is finished
    first and never retried. Per batch the first terminal row of a job is a partial aggregate; jobs already
    finished by earlier batches are left out by an anti join with the written results, read since the last snapshot.
    """

    def process(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        ends = batch.where(F.col("state").isin(DONE, *BROKEN, USER_CANCEL))
        rank = F.when(F.col("state") == USER_CANCEL, 0).otherwise(1)
        if tracked is not None:
            ends = ends.join(tracked.select("job_id"), "job_id", "left_semi")
        first = ends.groupBy("job_id").agg(F.min_by("state", F.struct(F.col("seq"), rank.alias("r"))).alias("state"))
        done = read_state(spark, out, FINISHED_SCHEMA, ["job_id"], batch_id)
        fresh = first.join(done.select("job_id"), "job_id", "left_anti")
        fresh = fresh.withColumn("action", F.when(F.col("state").isin(*BROKEN), "retry").otherwise("finished"))
        write_state(fresh, done, out, ["job_id"], batch_id)

    return start(status, process, checkpoint, every)


def read_finished(spark, out: str) -> DataFrame:
    return read_state(spark, out, FINISHED_SCHEMA, ["job_id"])


RECENT_SCHEMA = "job_id bigint, state string, action string, at timestamp"


def track_recent_jobs(
    status: DataFrame, keep: str, out: str, checkpoint: str, tracked: DataFrame | None = None, every: str | None = None
) -> StreamingQuery:
    """``track_jobs`` with bounded state: a finished job is remembered for ``keep`` (an interval such as ``"2 days"``) of event time.

    ``status(job_id, state, seq, at)`` says in ``at`` when the job came into its state, so polls repeat it. The horizon is
    the latest ``at`` of earlier batches minus ``keep``. Rows from before the horizon are late: they change nothing and go to
    ``late``, since the state may have forgotten their job. Results are appended to ``finished``; the state's snapshots
    hold what is younger than the horizon, and older snapshots are removed. Rows without ``at`` are never late.
    """

    def process(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        latest = read_before(spark, f"{out}/clock", "at timestamp", batch_id).agg(F.max("at")).first()[0]
        horizon = F.lit(latest) - F.expr(f"interval {keep}") if latest is not None else F.lit(None).cast("timestamp")
        is_late = F.coalesce(F.col("at") < horizon, F.lit(False))
        ends = batch.where(F.col("state").isin(DONE, *BROKEN, USER_CANCEL))
        if tracked is not None:
            ends = ends.join(tracked.select("job_id"), "job_id", "left_semi")
        write_batch(ends.where(is_late), f"{out}/late", batch_id)
        rank = F.when(F.col("state") == USER_CANCEL, 0).otherwise(1)
        first = ends.where(~is_late).groupBy("job_id").agg(F.min_by(F.struct("state", "at"), F.struct(F.col("seq"), rank.alias("r"))).alias("_s"))
        known = read_state(spark, f"{out}/state", RECENT_SCHEMA, ["job_id"], batch_id)
        fresh = first.select("job_id", "_s.*").join(known.select("job_id"), "job_id", "left_anti")
        fresh = fresh.select("job_id", "state", F.when(F.col("state").isin(*BROKEN), "retry").otherwise("finished").alias("action"), "at")
        write_batch(fresh, f"{out}/finished", batch_id)
        fresh = read_before(spark, f"{out}/finished", RECENT_SCHEMA).where(F.col(BATCH) == batch_id).drop(BATCH)
        young = known.where(~F.coalesce(F.col("at") < horizon, F.lit(False)))
        write_state(fresh, young, f"{out}/state", ["job_id"], batch_id)
        write_batch(batch.agg(F.max("at").alias("at")), f"{out}/clock", batch_id)

    return start(status, process, checkpoint, every)


def read_recent(spark, out: str) -> tuple[DataFrame, DataFrame]:
    """All finished jobs, and the late rows that were left out."""
    late = read_before(spark, f"{out}/late", "job_id bigint, state string, seq bigint, at timestamp")
    return read_before(spark, f"{out}/finished", RECENT_SCHEMA).drop(BATCH), late.drop(BATCH)


def watch_commands(commands: DataFrame, jobs: DataFrame, tracked: DataFrame, out: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Actions for each batch of commands ``(name, arg)``, written per batch."""

    def process(batch: DataFrame, batch_id: int) -> None:
        write_batch(apply_commands(batch, jobs, tracked), out, batch_id)

    return start(commands, process, checkpoint, every)
