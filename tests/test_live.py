"""Streams that forget: bounded job state, logs that grow and start again, from files to the leaderboard."""

from __future__ import annotations

import datetime as dt
import os
import re

import pytest
from pyspark.sql import functions as F

from runlens.operators import logs
from runlens.operators.blocks import block_of, last_before
from runlens.plans.spec import Capture, MetricOptions, Rule
from runlens.sources import sweep_source
from runlens.streaming import core, jobs, points

DAY = dt.datetime(2024, 1, 1)
RULES = (
    Rule(r"score=(\S+)", (Capture("score"),), arm="^Eval"),
    Rule(r"step (\d+) loss=(\S+)", (Capture("step"), Capture("loss", 2))),
)


def test_last_before_in_blocks(spark):
    rows = [("a", i, f"v{i}" if i % 7 == 3 else None) for i in range(60)] + [(None, 5, "x"), (None, 9, None)]
    df = spark.createDataFrame(rows, "k string, o bigint, v string")
    before = spark.createDataFrame([("a", "first"), ("b", "other")], "k string, v string")
    for bits in (1, 3, 16):
        got = {(r["k"], r["o"]): r["p"] for r in last_before(df, ["k"], ["o"], block_of("o", bits), F.col("v"), "p", before).collect()}
        assert len(got) == 62 and got[None, 9] == "x" and got[None, 5] is None
        for i in range(60):
            seen = [v for _, o, v in rows[:60] if o < i and v]
            assert got["a", i] == (seen[-1] if seen else "first")


def plain_events(lines, armed=False):
    out, n = {}, {}
    for line in lines:
        if (m := re.search(RULES[0].pattern, line)) and armed:
            out.setdefault("score", []).append(float(m[1]))
        if m:
            armed = False
        if re.search(RULES[0].arm, line):
            armed = True
        if m := re.search(RULES[1].pattern, line):
            out.setdefault("step", []).append(float(m[1]))
            out.setdefault("loss", []).append(float(m[2]))
    return out, armed


LOG = ["start", "score=1", "Eval", "noise", "score=2.5", "score=3", "step 1 loss=0.5", "Eval score=9", "score=4", "Eval", "Eval", "score=5"] * 6


def test_armed_rules_in_batch(spark):
    df = spark.createDataFrame([("f", i, x) for i, x in enumerate(LOG)] + [("g", 0, "score=7")], "folder string, line_no bigint, line string")
    before = spark.createDataFrame([("g", 0, "arm")], "folder string, rule int, mark string")
    for bits in (2, 16):
        found, arming = logs.armed_events(df, RULES, before=before, bits=bits)
        got = {}
        for r in found.orderBy("pos").collect():
            got.setdefault(r["folder"], {}).setdefault(r["key"], []).append(r["value"])
        want, _ = plain_events(LOG)
        assert got == {"f": want, "g": {"score": [7.0]}}
        assert {(r["folder"], r["mark"]) for r in arming.collect()} == {("f", "match"), ("g", "match")}


def run_logs(spark, tree, base):
    sweep_source.register(spark)
    lines = spark.readStream.format("sweep").load(tree)
    points.live_logs(lines, RULES, f"{base}/out", f"{base}/cp", MetricOptions(topk_mean=2, descending=True)).awaitTermination()
    found = points.read_live_logs(spark, f"{base}/out", MetricOptions(topk_mean=2, descending=True)).collect()
    return {(r["folder"].rsplit("/", 1)[1], r["metric"]): (r["topk_mean"], r["best"], r["best_idx"], r["len"]) for r in found}


def board_of(logs_now):
    out = {}
    for run, lines in logs_now.items():
        for metric, v in plain_events(lines)[0].items():
            top = sorted(v, reverse=True)[:2]
            best = max(range(len(v)), key=lambda i: (v[i], i))
            out[run, metric] = (sum(top) / len(top), v[best], best, len(v))
    return out


def test_leaderboard_from_growing_logs(spark, tmp_path):
    tree, base, now = str(tmp_path / "sweep"), str(tmp_path / "state"), {}

    def write(run, lines, restart=False):
        os.makedirs(f"{tree}/{run}", exist_ok=True)
        now[run] = lines if restart else now.get(run, []) + lines
        with open(f"{tree}/{run}/a.log", "w" if restart else "a") as f:
            f.writelines(x + "\n" for x in lines)

    write("0", LOG[:3])  # armed when the batch ends
    write("1", ["first try", *LOG])
    assert run_logs(spark, tree, base) == board_of(now)
    write("0", LOG[3:20])
    write("2", ["Eval"])
    assert run_logs(spark, tree, base) == board_of(now)
    write("1", ["second try", "Eval", "step 3 loss=1"], restart=True)  # scores are gone, and it is armed
    write("2", ["score=1", "score=2"])
    assert run_logs(spark, tree, base) == board_of(now)
    write("1", ["score=8", "score=9"])
    write("2", ["third"], restart=True)
    assert run_logs(spark, tree, base) == board_of(now) and ("2", "score") not in board_of(now)


def test_finished_jobs_leave_the_state(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(core, "SNAPSHOT", 3)
    base = str(tmp_path)
    schema = "job_id bigint, state string, seq bigint, at timestamp"
    rows_in_state = []
    for day in range(12):
        at = DAY + dt.timedelta(days=day)
        rows = [(day * 10 + i, "FAILED" if i % 2 else "COMPLETED", day, at) for i in range(10)]
        rows += [(r, "COMPLETED", day, DAY + dt.timedelta(days=r // 10)) for r in range(max(0, day * 10 - 40), day * 10)]  # repeated polls
        if day == 9:
            rows += [(999, "FAILED", 1, DAY + dt.timedelta(days=2)), (998, "FAILED", 1, DAY + dt.timedelta(days=8))]
        spark.createDataFrame(rows, schema).write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(schema).parquet(f"{base}/in")
        jobs.track_recent_jobs(stream, "3 days", f"{base}/out", f"{base}/cp").awaitTermination()
        rows_in_state.append(core.read_state(spark, f"{base}/out/state", jobs.RECENT_SCHEMA, ["job_id"]).count())
    finished, late = jobs.read_recent(spark, f"{base}/out")
    got = {r["job_id"]: r["action"] for r in finished.collect()}
    assert got == {i: "retry" if i % 2 else "finished" for i in range(120)} | {998: "retry"} and finished.count() == 121
    assert 999 in {r["job_id"] for r in late.collect()}
    # four days of jobs, and what came since the last snapshot
    assert max(rows_in_state) <= 80 and rows_in_state[-1] <= 75 < finished.count()


@pytest.mark.parametrize("keep", ["0 days"])
def test_rows_without_a_time_are_never_late(spark, tmp_path, keep):
    schema = "job_id bigint, state string, seq bigint, at timestamp"
    for rows in ([(1, "FAILED", 1, DAY), (2, "RUNNING", 1, None)], [(2, "COMPLETED", 2, None), (3, "FAILED", 1, DAY - dt.timedelta(days=1))]):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(f"{tmp_path}/in")
        jobs.track_recent_jobs(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), keep, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    finished, late = jobs.read_recent(spark, f"{tmp_path}/out")
    assert {r["job_id"] for r in finished.collect()} == {1, 2} and {r["job_id"] for r in late.collect()} == {3}
