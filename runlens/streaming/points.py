"""Live leaderboards, value statistics, correlation state and top-k admission."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from runlens.operators.blocks import HOT_ROWS
from runlens.operators.logs import armed_events
from runlens.operators.reduce import add_best_points, best_points, from_best_points, merge_best_points
from runlens.operators.stats import CORR_STATE, cross_corr_sums, merge_corr_sums, value_stats
from runlens.operators.topk import assign_slots, kept_slots, topk_admission
from runlens.plans.spec import MetricOptions, Rule
from runlens.session import cut
from runlens.streaming.core import BATCH, SNAPSHOT, latest, prune, read_before, read_state, since_snapshot, start, write_batch, write_state

REFRESH = "60 seconds"
BOARD_SCHEMA = "run_id bigint, metric string, top array<struct<pos:bigint,value:double>>, len bigint"
SLOTS_SCHEMA = "run_id bigint, metric string, slots array<struct<slot:int,value:double>>"


def live_leaderboard(
    points: DataFrame, out: str, checkpoint: str, default: MetricOptions = MetricOptions(),
    options: dict[str, MetricOptions] | None = None, every: str | None = None,
) -> StreamingQuery:
    """Keep the reduced metrics of every run current while points arrive.

    The state of a series is its length and its best points. A batch is cut to its own best points first and
    then joined with the state of the series it touched; stored points are not read again.
    """
    keys = ["run_id", "metric"]

    def process(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = read_state(spark, out, BOARD_SCHEMA, keys, batch_id, single=True)
        best = best_points(batch, default, options)
        changed = add_best_points(best, before, default, options) if batch_id else best
        if batch_id % SNAPSHOT == 0 and batch_id > 0:
            # a snapshot reads it twice: written once, as a table of the batch
            write_batch(changed, f"{out}/_fresh", batch_id)
            prune(spark, f"{out}/_fresh", batch_id)
            changed = spark.read.schema(changed.schema).parquet(f"{out}/_fresh/{BATCH}={batch_id}")
        write_state(changed, before, out, keys, batch_id)

    return start(points, process, checkpoint, every)


ARMS_SCHEMA = "folder string, rule int, mark string"
LOG_BOARD_SCHEMA = "folder string, metric string, top array<struct<pos:bigint,value:double>>, len bigint"


def live_logs(
    lines: DataFrame, rules: Sequence[Rule], out: str, checkpoint: str, default: MetricOptions = MetricOptions(),
    options: dict[str, MetricOptions] | None = None, every: str | None = None,
) -> StreamingQuery:
    """A leaderboard fed from logs that still grow: ``lines(folder, offset, line)``, as ``format("sweep")`` streams them.

    The state of a log is the arming of its rules and, per metric, its length and best points; lines read before are
    not read again. A line at offset 0 means that its log was started (again): what was known of the log is dropped.
    """
    keys = ["folder", "metric"]

    def process(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.select("folder", F.col("offset").alias("line_no"), "line")
        begun = rows.where("line_no = 0").select("folder").distinct()
        board = read_state(spark, f"{out}/board", LOG_BOARD_SCHEMA, keys, batch_id)
        arms = read_state(spark, f"{out}/arms", ARMS_SCHEMA, ["folder", "rule"], batch_id)
        touched = rows.select("folder").distinct()
        going = arms.join(touched, "folder", "left_semi").join(begun, "folder", "left_anti")
        points, arming = armed_events(rows, rules, before=going)
        known = board.join(begun, "folder", "left_anti")
        points = points.select("folder", F.col("key").alias("metric"), "pos", "value").join(known.select(*keys, F.col("len").alias("_len")), keys, "left")
        points = points.select(*keys, (F.col("pos") + F.coalesce("_len", F.lit(0))).alias("pos"), "value")
        best = best_points(points, default, options, ["folder"])
        write_batch(best, f"{out}/_fresh", batch_id)
        prune(spark, f"{out}/_fresh", batch_id)
        fresh = spark.read.schema(best.schema).parquet(f"{out}/_fresh/{BATCH}={batch_id}")
        old = known.join(fresh.select(*keys), keys, "left_semi").select(*keys, "top", "len")
        changed = merge_best_points(old.unionByName(fresh), default, options, ["folder"])
        # series of a log that was started again and has none of their points yet
        gone = board.join(begun, "folder", "left_semi").join(fresh.select(*keys), keys, "left_anti")
        empty = gone.select(*keys, F.array().cast("array<struct<pos:bigint,value:double>>").alias("top"), F.lit(0).cast("long").alias("len"))
        write_state(changed.unionByName(empty), board, f"{out}/board", keys, batch_id)
        dropped = arms.join(begun, "folder", "left_semi").join(arming.select("folder", "rule"), ["folder", "rule"], "left_anti").select("folder", "rule", F.lit("match").alias("mark"))
        write_state(arming.unionByName(dropped), arms, f"{out}/arms", ["folder", "rule"], batch_id)

    return start(lines, process, checkpoint, every)


def read_live_logs(
    spark, out: str, default: MetricOptions = MetricOptions(), options: dict[str, MetricOptions] | None = None
) -> DataFrame:
    """Current reduction of each log and metric."""
    state = read_state(spark, f"{out}/board", LOG_BOARD_SCHEMA, ["folder", "metric"]).where("len > 0")
    return from_best_points(state, default, options, ["folder"])


def read_leaderboard(
    spark, out: str, default: MetricOptions = MetricOptions(), options: dict[str, MetricOptions] | None = None
) -> DataFrame:
    """Current reduction of each run and metric, to be grouped like a batch result."""
    state = read_state(spark, out, BOARD_SCHEMA, ["run_id", "metric"], single=True)
    return from_best_points(state, default, options)


def live_value_stats(
    points: DataFrame, by: Sequence[str], out: str, checkpoint: str, value: str = "value", index: str = "pos",
    watermark: tuple[str, str] | None = None, every: str | None = None,
) -> StreamingQuery:
    """Running value statistics per key as one streaming aggregation.

    A report id in ``by`` plays the reset. With a watermark ``(column, delay)`` whose column is part of
    ``by``, the state of closed reports is dropped.
    """
    rows = points.withWatermark(*watermark) if watermark else points
    totals = value_stats(rows, list(by), value, index)

    def process(batch: DataFrame, batch_id: int) -> None:
        before = read_state(batch.sparkSession, out, batch.schema, list(by), batch_id)
        write_state(batch, before, out, list(by), batch_id)

    return start(totals, process, checkpoint, every, mode="update")


def read_value_stats(spark, out: str, by: Sequence[str]) -> DataFrame:
    return latest(since_snapshot(spark.read.option("basePath", out).parquet(out)), list(by))


def live_cross_corr(features: DataFrame, left: str, right: str, out: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Add up correlation accumulators batch by batch: each batch writes its own sums, a snapshot all sums so far."""

    def process(batch: DataFrame, batch_id: int) -> None:
        spark, sums = batch.sparkSession, cross_corr_sums(batch, left, right)
        if batch_id % SNAPSHOT == 0 and batch_id > 0:
            before = since_snapshot(read_before(spark, out, CORR_STATE, batch_id), batch_id).drop(BATCH)
            sums = merge_corr_sums(before.unionByName(sums))
        write_batch(sums, out, batch_id)
        if batch_id % SNAPSHOT == 0:
            prune(spark, out, batch_id - SNAPSHOT)

    return start(features, process, checkpoint, every)


def read_corr_sums(spark, out: str) -> DataFrame:
    return merge_corr_sums(since_snapshot(read_before(spark, out, CORR_STATE)))


def live_topk(points: DataFrame, k: int, out: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Admit scores into the k best of their series as they arrive and say which slot each one takes.

    Points of a series must not arrive in an earlier batch than lower positions; inside a batch they are
    ordered here. The state of a series is its k slots. A batch writes its admitted scores once and the slots it changed.
    """
    keys = ["run_id", "metric"]

    def process(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        state = read_state(spark, f"{out}/slots", SLOTS_SCHEMA, keys, batch_id)
        kept = state.select(*keys, F.inline("slots")) if batch_id else None
        if kept is not None:
            kept = kept.join(batch.select(*keys).distinct(), keys, "left_semi")
        few = batch.limit(HOT_ROWS + 1).count() <= HOT_ROWS
        admitted = topk_admission(batch, k, keys, kept_before=kept).where("admitted").drop("admitted", "worst")
        # a large batch is searched for huge series and read again, which must not admit its scores again
        slotted = assign_slots(admitted if few else cut(admitted), k, keys, kept, few=few)
        write_batch(slotted, f"{out}/admitted", batch_id)
        slotted = read_before(spark, f"{out}/admitted", slotted.schema).where(F.col(BATCH) == batch_id)
        now = kept_slots(slotted, keys, kept).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("slot", "value"))).alias("slots"))
        write_state(now, state, f"{out}/slots", keys, batch_id)

    return start(points, process, checkpoint, every)


def read_topk(spark, out: str) -> tuple[DataFrame, DataFrame]:
    """All admitted scores with their slot, and what the slots hold now (one row per slot)."""
    admitted = spark.read.option("basePath", f"{out}/admitted").parquet(f"{out}/admitted").drop(BATCH)
    state = read_state(spark, f"{out}/slots", SLOTS_SCHEMA, ["run_id", "metric"])
    return admitted, state.select("run_id", "metric", F.inline("slots"))
