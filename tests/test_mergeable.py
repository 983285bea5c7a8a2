"""Statistics from partial states: tiles, eigenpairs, user aggregates, bitmaps."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from runlens.operators import groups, ranges, stats
from runlens.plans.catalog_reduce import Skewness


@pytest.fixture(scope="module")
def features(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(700, 40)) * np.linspace(3, 0.1, 40)
    return x, spark.createDataFrame([(r.tolist(), r[:7].tolist()) for r in x] + [(None, None)], "a array<double>, b array<double>").repartition(5)


def test_tiles_give_the_same_sums(spark, features, monkeypatch):
    _, df = features
    monkeypatch.setattr(stats, "TILE_ROWS", 64)
    key = lambda r: (r["i"], r["j"])
    want = sorted(stats.cross_corr_sums(df, "a", "b").collect(), key=key)
    for tile in (1, 6, 40, 256):
        got = sorted(stats.cross_corr_sums_tiled(df, "a", "b", tile).collect(), key=key)
        assert [key(r) for r in got] == [key(r) for r in want]
        for c in ("sxy", "sx", "sxx", "sy", "syy", "n"):
            assert np.allclose([r[c] for r in got], [r[c] for r in want], rtol=1e-12)
    assert stats.cross_corr_tiled(df.limit(0), "a", "b").count() == 0


@pytest.mark.parametrize("k", [1, 3, 40, 60])
def test_leading_eigenpairs(spark, features, k):
    x, df = features
    values, vectors = np.linalg.eigh(x.T @ x / len(x))
    rows = stats.top_eigen(df, "a", k).collect()
    assert len(rows) == min(k, 40) * 40
    for rank in range(1, min(k, 40) + 1):
        mine = sorted((r["i"], r["value"], r["weight"]) for r in rows if r["rank"] == rank)
        assert mine[0][1] == pytest.approx(values[-rank], rel=1e-8)
        w = np.array([m[2] for m in mine])
        assert abs(abs(w @ vectors[:, -rank]) - 1) < 1e-6 and w[np.flatnonzero(np.abs(w) > 1e-12)[0]] > 0
    assert stats.top_eigen(df.limit(0), "a").count() == 0


def test_user_aggregates_merge(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(None if rng.random() < 0.02 else "hot" if rng.random() < 0.4 else f"g{rng.randint(0, 30)}", rng.randint(0, 3), float(rng.randint(0, 9)), rng.choice([None, 1.0, float("nan")])) for _ in range(3000)]
    df = spark.createDataFrame(rows, "g string, h int, v double, w double").repartition(7)
    monkeypatch.setattr(groups, "STATES_AT_ONCE", 10)
    got = {(r["g"], r["h"]): r["x"] for r in groups.group_merge(df, ["g", "h"], ["v"], "x", Skewness()).collect()}
    want = {}
    for g, h, v, _ in rows:
        if g is not None:
            want.setdefault((g, h), []).append(v)
    assert got.keys() == want.keys()
    for k, v in want.items():
        d = np.array(v) - np.mean(v)
        assert got[k] == pytest.approx((d**3).mean() / (d**2).mean() ** 1.5) if d.any() else got[k] is None
    class Longest(groups.Aggregate):
        """Not numeric inside: the set of seen values, as a state of another kind."""

        returns = "long"

        def init(self):
            return set()

        def update(self, state, a, b):
            return state | set(zip(a.tolist(), b.tolist()))

        def merge(self, state, other):
            return state | other

        def finish(self, state):
            return len(state)

    sizes = {(r["g"], r["h"]): r["n"] for r in groups.group_merge(df, ["g", "h"], ["v", "h"], "n", Longest()).collect()}
    assert sizes == {k: len(set(v)) for k, v in want.items()}
    assert groups.group_merge(df.limit(0), ["g"], ["v"], "x", Skewness()).count() == 0


def test_bitmaps_hold_any_ids(spark):
    rng = random.Random(6)
    ids = {"a": set(range(32_700, 32_900)) | {rng.randint(-70_000, 70_000) for _ in range(500)}, None: {0, 1, 2, 32_767, 32_768, -1, -32_768, -32_769}, "c": {1 << 40}}
    rows = [(g, i) for g, s in ids.items() for i in s for _ in range(2)] + [("a", None)]
    rng.shuffle(rows)
    half = [spark.createDataFrame(r, "g string, id bigint") for r in (rows[::2], rows[1::2])]
    sets = ranges.merge_bitmaps(ranges.id_bitmaps(half[0], ["g"], "id").unionByName(ranges.id_bitmaps(half[1], ["g"], "id")), ["g"])
    got = sorted(((r["g"] or "", r["lo"], r["hi"]) for r in ranges.bitmap_ranges(sets, ["g"]).collect()))
    want = sorted((r["g"] or "", r["lo"], r["hi"]) for r in ranges.id_ranges(half[0].unionByName(half[1]), ["g"], "id").collect())
    assert got == want and {r["g"]: r["n"] for r in ranges.bitmap_size(sets, ["g"]).collect()} == {g: len(s) for g, s in ids.items()}
    plan = ranges.id_bitmaps(half[0], ["g"], "id")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("partial_bitmap_construct_agg") >= 1 and "Window" not in plan
    assert ranges.bitmap_ranges(ranges.id_bitmaps(half[0].limit(0), ["g"], "id"), ["g"]).count() == 0


def test_runs_of_bitmaps_come_in_small_pieces(spark):
    """A full batch of bitmaps with every second id holds 10,000 x 2**14 runs; no more than a few bitmaps' may be in memory."""
    import pyarrow as pa

    bits = bytes([0b01010101]) * 4096
    batch = pa.RecordBatch.from_arrays([pa.array(range(200)), pa.array([bits] * 200)], names=["bucket", "ids"])
    sizes = [b.num_rows for b in ranges._runs(iter([batch]))]
    assert sum(sizes) == 200 << 14 and max(sizes) <= ranges.RUNS_AT_ONCE << 14
    df = spark.createDataFrame([("a", i) for i in (0, 1, 2, 5, 32767, 32768, 70000)] + [(None, 7), (None, -1)], "g string, id long")
    got = {tuple(r) for r in ranges.bitmap_ranges(ranges.id_bitmaps(df, ["g"], "id"), ["g"]).collect()}
    assert got == {("a", 0, 2), ("a", 5, 5), ("a", 32767, 32768), ("a", 70000, 70000), (None, 7, 7), (None, -1, -1)}


def test_describe_sends_brackets_to_the_rows(spark, monkeypatch):
    """Two groups must not mean two tasks that hold all rows."""
    seen = []
    ranks = stats._median_ranks
    monkeypatch.setattr(stats, "_median_ranks", lambda known, brackets: seen.append(ranks(known, brackets)) or seen[-1])
    monkeypatch.setattr(stats, "cut", lambda df: df)
    df = spark.range(200_000).select((F.col("id") % 2).alias("g"), F.col("id").cast("double").alias("v"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = {r["g"]: (r["n"], r["median"]) for r in stats.describe_values(df, "v", ["g"]).collect()}
        assert len(seen) == 1 and "SortMergeJoin" not in seen[0]._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert rows == {0: (100_000, 99_999.0), 1: (100_000, 100_000.0)}


def test_shuffles_grow_with_the_input(spark, tmp_path, monkeypatch):
    from runlens import session

    name = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    (tmp_path / "a.parquet").write_bytes(b"x" * 10_000)
    monkeypatch.setattr(session, "SHARE_BYTES", 100)
    session.size_shuffles(spark, str(tmp_path))
    assert spark.conf.get(name) == "100"
    monkeypatch.setattr(session, "SHARE_BYTES", 10_000)
    session.size_shuffles(spark, str(tmp_path))
    assert spark.conf.get(name, None) is None
