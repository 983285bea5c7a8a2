"""Series reduced from one sort, in batch and live, against plain Python."""

from __future__ import annotations

import math
import os
import random

import pytest
from pyspark.sql import functions as F

from runlens.operators import reduce
from runlens.plans.spec import MetricOptions
from runlens.streaming import core
from runlens.streaming import points as live_points

POINTS = "run_id bigint, metric string, pos int, value double"
DEFAULT, OPTIONS = MetricOptions(topk_mean=2), {"b": MetricOptions(topk_mean=3, descending=True)}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    out = []
    for run in (None, *range(12)):
        for metric in ("a", "b", "c"):
            for pos in range(rng.choice([0, 1, 5, 30])):
                value = rng.choice([None, math.nan, *[float(v) for v in range(-4, 5)]])
                out += [(run, metric, pos, value)] * rng.choice([1, 1, 1, 2])  # points may come twice
    return [*out, (3, "a", None, 1.0)]


def plain(rows, run, metric, k=None):
    """(topk_mean, best, best_idx, len) of the first k points."""
    option = OPTIONS.get(metric, DEFAULT)
    mine = [(p, v) for r, m, p, v in rows if (r, m) == (run, metric) and (k is None or (p is not None and p < k))]
    sign = -1 if option.descending else 1
    known = sorted((v * sign, -math.inf if p is None else p * sign, p) for p, v in mine if v is not None and not math.isnan(v))
    best = [v * sign for v, _, _ in known[: option.topk_mean]]
    return (sum(best) / len(best), best[0], known[0][2], len(mine)) if best else (None, None, None, len(mine))


def cells(row):
    return tuple(None if v is None else round(v, 9) for v in (row["topk_mean"], row["best"], row["best_idx"], row["len"]))


def rounded(want):
    return tuple(None if v is None else round(v, 9) for v in want)


@pytest.mark.parametrize("near", [4, reduce.NEAR])
def test_series_and_prefixes(spark, rows, near, monkeypatch):
    monkeypatch.setattr(reduce, "NEAR", near)
    monkeypatch.setattr(reduce, "block_of", lambda order: F.shiftright(F.col(order), 2))
    p = spark.createDataFrame(rows, POINTS).repartition(5)
    runs = spark.createDataFrame([(r,) for r in (None, 1, 1, 2, 3, 99)], "run_id int")
    series = {(r, m) for r, m, _, _ in rows}
    got = reduce.reduce_series(p, DEFAULT, OPTIONS).collect()
    assert sorted(map(str, got)) == sorted(map(str, {(g["run_id"], g["metric"]): g for g in got}.values())) and len(got) == len(series)
    assert all(cells(g) == rounded(plain(rows, g["run_id"], g["metric"])) for g in got)
    asked = reduce.reduce_series(p, DEFAULT, OPTIONS, runs, ["a", "b"]).collect()
    assert sorted((str(g["run_id"]), g["metric"]) for g in asked) == sorted((str(r), m) for r in (None, 1, 1, 2, 3, 99) for m in "ab")
    assert all(cells(g) == rounded(plain(rows, g["run_id"], g["metric"])) for g in asked)
    iters = (1, 3, 20)
    early = reduce.reduce_series_at(p, iters, DEFAULT, OPTIONS).collect()
    want = {(r, m, k) for r, m in series for k in iters if plain(rows, r, m, k)[3]}
    assert sorted(map(str, want)) == sorted(str((g["run_id"], g["metric"], g["iter"])) for g in early)
    assert all(cells(g) == rounded(plain(rows, g["run_id"], g["metric"], g["iter"])) for g in early)
    both = reduce.reduce_series_at(p, iters, DEFAULT, OPTIONS, runs, ["a", "b"]).collect()
    assert len(both) == 6 * 2 * 3 and all(cells(g) == rounded(plain(rows, g["run_id"], g["metric"], g["iter"])) for g in both)
    assert reduce.reduce_series_at(p, (), DEFAULT).count() == 0


def test_prefixes_read_and_sort_the_points_once(spark, rows):
    p = spark.createDataFrame(rows, POINTS)
    runs = spark.createDataFrame([(1,)], "run_id bigint")
    plan = reduce.reduce_series_at(p, (1, 3, 6), DEFAULT, OPTIONS, runs, ["a", "b"])._jdf.queryExecution().executedPlan().toString()
    first = plan.split("+- == Initial Plan ==")[-1]
    assert first.count("Scan ExistingRDD") == 2 and "Join" not in first and first.count("Exchange hashpartitioning") == 1


def test_far_blocks_send_only_their_best(spark, monkeypatch):
    monkeypatch.setattr(reduce, "NEAR", 8)
    monkeypatch.setattr(reduce, "block_of", lambda order: F.shiftright(F.col(order), 5))
    p = spark.range(1000).select(F.lit(1).cast("long").alias("run_id"), F.lit("a").alias("metric"), F.col("id").alias("pos"), (F.col("id") * 7919 % 1009).cast("double").alias("value"))
    sent = reduce.series_points(p, ["run_id", "metric"], DEFAULT, {}).agg(F.count(F.lit(1)).alias("rows"), F.sum("_n").alias("n")).first()
    assert sent["n"] == 1000 and sent["rows"] <= 8 + 2 * 32


@pytest.mark.parametrize("snapshot", [2, 50])
def test_leaderboard_over_batches(spark, rows, tmp_path, snapshot, monkeypatch):
    monkeypatch.setattr(core, "SNAPSHOT", snapshot)
    monkeypatch.setattr(live_points, "SNAPSHOT", snapshot)
    known = [r for r in rows if r[0] is not None]
    base, p = str(tmp_path), spark.createDataFrame(known, POINTS)
    for part in ("pos >= 20", "pos between 2 and 9 or pos is null", "pos between 10 and 19", "pos < 2"):
        p.where(part).coalesce(1).write.mode("append").parquet(f"{base}/in")
        live_points.live_leaderboard(spark.readStream.schema(POINTS).parquet(f"{base}/in"), f"{base}/out", f"{base}/cp", DEFAULT, OPTIONS).awaitTermination()
    got = live_points.read_leaderboard(spark, f"{base}/out", DEFAULT, OPTIONS).collect()
    assert len(got) == len({r[:2] for r in known})
    assert all(cells(g) == rounded(plain(known, g["run_id"], g["metric"])) for g in got)
    # only a snapshot writes the batch's points a second time
    assert os.path.exists(f"{base}/out/_fresh") == (snapshot == 2)
