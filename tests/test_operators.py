"""Hand-made cases: ties, missing values, empty series, formats, specification rules."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from runlens.functions import columns as fn
from runlens.operators import config, curves, files, grid, groups, jobs, logs, quality, ranges, reduce, stats, topk
from runlens.plans.ingest import ingest, with_config
from runlens.plans.spec import Capture, MetricOptions, ResultGroup, Rule, SweepSpec
from runlens.sources import sweeps


def one(spark, column, **values):
    d = spark.range(1)
    for name, v in values.items():
        d = d.withColumn(name, v if not isinstance(v, (str, int, float, bool)) else F.lit(v))
    return d.select(column.alias("x")).first().x


def points(spark, data):
    rows = [(run, m, i, v) for (run, m), vs in data.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, "run_id bigint, metric string, pos bigint, value double")


def test_reduce_ties_missing_and_empty(spark):
    nan = float("nan")
    p = points(spark, {(1, "a"): [2.0, 1.0, 1.0, nan], (2, "a"): [nan, None], (3, "a"): [5.0]})
    runs = spark.createDataFrame([(1,), (2,), (3,), (4,)], "run_id bigint")
    asc = {r.run_id: r for r in reduce.reduce_series(p, MetricOptions(topk_mean=2), runs=runs, metrics=["a"]).collect()}
    desc = {r.run_id: r for r in reduce.reduce_series(p, MetricOptions(topk_mean=2, descending=True)).collect()}
    assert (asc[1].best, asc[1].best_idx, asc[1].topk_mean, asc[1].len) == (1.0, 1, 1.0, 4)
    assert (desc[1].best, desc[1].best_idx, desc[1].topk_mean) == (2.0, 0, 1.5)
    assert (asc[2].best, asc[2].topk_mean, asc[2].len) == (None, None, 2)
    assert (asc[3].topk_mean, asc[3].len) == (5.0, 1)
    assert (asc[4].best, asc[4].len) == (None, 0)
    tied = points(spark, {(1, "a"): [3.0, 3.0]})
    assert reduce.reduce_series(tied, MetricOptions(descending=True)).first().best_idx == 1


def test_group_mean_std_drops_missing_keys(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 2.0), (None, 9.0)], "g string, v double")
    out = {r.g: r for r in groups.group_mean_std(df, ["g"], ["v"]).collect()}
    assert set(out) == {"a", "b"}
    assert out["a"].v_std == pytest.approx(math.sqrt(2)) and out["b"].v_std is None and out["b"].v_n == 1
    text = groups.format_mean_std(F.col("v_mean"), F.col("v_std"), F.col("v_n"), precision=2)
    assert {r.t for r in groups.group_mean_std(df, ["g"], ["v"]).select(text.alias("t")).collect()} == {"2.00 ± 1.41 [2]", "2.00 ± nan [1]"}


def test_folder_ranges_golden(spark):
    df = spark.createDataFrame([("g", f"/s/{i}") for i in (6, 7, 8, 10, 12, 13, 13)] + [("h", "/s/x"), ("h", "/s/3")], "g string, folder string")
    out = {r.g: r.folders for r in ranges.folder_ranges(df, ["g"]).collect()}
    assert out == {"g": "6-8,10,12-13[7]", "h": "0[2]"}


def test_ids_round_trip(spark):
    df = spark.createDataFrame([(i,) for i in (6, 7, 8, 10, 12, 13)], "id bigint")
    row = ranges.compact_ids(df, "id").first()
    assert row.text == "6-8,10,12-13[6]"
    texts = spark.createDataFrame([("6-8,10",), ("",), ("9-7",)], "t string")
    assert sorted(r.id for r in ranges.expand_ids(texts, "t").collect()) == [6, 7, 8, 10]
    with pytest.raises(Exception, match="invalid id range"):
        ranges.expand_ids(spark.createDataFrame([("1-2-3",)], "t string"), "t").collect()


def test_resample_against_pandas(spark):
    rng = np.random.default_rng(4)
    at = [0.0, 1.0, 2.5, 4.0, 5.0, 8.0, 9.5]
    rows, want = [], {}
    for run in range(25):
        xs = rng.choice(np.arange(0, 10, 0.5), size=rng.integers(1, 6), replace=False)
        ys = rng.normal(size=len(xs))
        rows += [("g", run, float(x), float(y)) for x, y in zip(xs, ys)]
        s = pd.Series(ys, index=xs).sort_index()
        s = s.reindex(s.index.union(at)).interpolate("linear")
        want[run] = [None if np.isnan(s[x]) else s[x] for x in at]
    df = spark.createDataFrame(rows, "g string, run_id int, x double, y double")
    got = {(r.run_id, r.x): r.y for r in curves.resample_linear(df, at, ["g", "run_id"]).collect()}
    assert len(got) == 25 * len(at)
    for run, values in want.items():
        for x, v in zip(at, values):
            assert (got[run, x] is None) == (v is None) and (v is None or abs(got[run, x] - v) < 1e-9)


@pytest.mark.parametrize("n", [1, 2, 7, 1000])
def test_exact_median(spark, n):
    rng = np.random.default_rng(n)
    values = np.round(rng.normal(size=n), 2)
    values[: n // 3] = 0.5
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    row = stats.describe_values(df, "v", accuracy=100).first()
    assert row["median"] == pytest.approx(float(np.median(values))) and row["n"] == n


def test_value_stats_last_on_ties_and_text(spark):
    df = spark.createDataFrame([("k", i, v) for i, v in enumerate([1.0, 3.0, 1.0, 3.0, 2.0])], "key string, pos bigint, value double")
    out = stats.value_stats(df, ["key"])
    row = out.first()
    assert (row["min_idx"], row["max_idx"], row["n"]) == (2, 3, 5)
    line = stats.value_stats_text(out, ["key"], 7).first().line
    assert line == "7:k[5]: avg:   2.0000 (±   0.4000), min:   1.0000[   2], max:   3.0000[   3]"


def test_step_timing_unbalanced(spark):
    df = spark.createDataFrame([("s", 0, 0, "a"), ("s", 1, 2000, "b"), ("s", 2, 5000, "a")], "s string, line_no bigint, us bigint, key string")
    out = {r.key: r for r in stats.step_timing(df.withColumn("ts", F.timestamp_micros("us")), ["s"], "key").collect()}
    assert out["a"].mean_ms == 1.5 and out["b"].share_pct == pytest.approx(40.0)
    assert out["a"].balanced is False and out["a"].iter_ms is None


def test_cross_corr_edges_and_merge(spark):
    rng = np.random.default_rng(0)
    t, s = rng.normal(size=(60, 3)), rng.normal(size=(60, 4))
    t[:, 1] = 2.0  # constant column
    s[:, 0] = 3 * t[:, 0]
    rows = [(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(t, s))]
    df = spark.createDataFrame(rows, "i int, t array<double>, s array<double>")
    whole = {(r.i, r.j): r.r for r in stats.cross_corr(df.repartition(5), "t", "s").collect()}
    parts = stats.cross_corr_sums(df.where("i < 20"), "t", "s").unionByName(stats.cross_corr_sums(df.where("i >= 20"), "t", "s"))
    merged = {(r.i, r.j): r.r for r in stats.corr_from_sums(stats.merge_corr_sums(parts)).collect()}
    for (i, j), r in whole.items():
        want = 0.0 if i == 1 else np.corrcoef(t[:, i], s[:, j])[0, 1]
        assert r == pytest.approx(want, abs=1e-9) and merged[i, j] == pytest.approx(r, abs=1e-9)
    best = stats.best_match(stats.cross_corr(df, "t", "s")).collect()
    assert (best[0].i, best[0].best_j) == (0, 0) and best[0].best_r == pytest.approx(1.0)


def test_spatial_rows(spark):
    fm = np.arange(12.0).reshape(2, 3, 2)
    df = spark.createDataFrame([(fm.tolist(),)], "f array<array<array<double>>>")
    got = sorted(tuple(r.f) for r in stats.spatial_rows(df, "f").collect())
    assert got == sorted((fm[0, y, x], fm[1, y, x]) for y in range(3) for x in range(2))


def test_scalar_formats(spark):
    cases = [(0, "0 bytes"), (1023, "1023 bytes"), (1536, "1.500 KB"), (1024 * 1024 + 64, "1.000 MB"), (64 * 17 + 1024 * 0, "1.062 KB"),
             (3 * 2**30, "3.000 GB"), (2**30 - 1, "1024.000 MB")]
    df = spark.createDataFrame(cases, "n bigint, want string")
    for r in df.withColumn("got", fn.human_bytes(F.col("n"))).collect():
        n = r.n
        unit = next(((p, u) for p, u in ((30, "GB"), (20, "MB"), (10, "KB")) if n >= 2**p), None)
        assert r.got == r.want == (f"{n / 2 ** unit[0]:.3f} {unit[1]}" if unit else f"{n} bytes")
    assert one(spark, fn.human_duration(F.lit(100 * 3600 + 61))) == "100H 01M 01S"
    for n, want in [(100, "100"), (1500, "1.5K"), (2_000_000, "2M"), (1_234_567, "1.235M"), (999_999, "999.999K"), (1_002_500, "1.002M")]:
        assert one(spark, fn.human_count(F.lit(n))) == want
    assert one(spark, fn.human_count(F.lit(2.50))) == "2.5"
    with pytest.raises(Exception, match="negative"):
        one(spark, fn.human_bytes(F.lit(-1)))


def test_array_helpers(spark):
    a = F.array(*[F.lit(i) for i in range(5)])
    assert one(spark, fn.array_slice(a, 1, 3)) == [1, 2]
    assert one(spark, fn.array_slice(a, -2, 99)) == [3, 4]
    assert one(spark, fn.array_slice(a, 4, 2)) == []
    assert one(spark, fn.array_item(a, 9)) is None
    nested = F.array(a, fn.array_slice(a, 0, 2))
    assert one(spark, fn.array_slice(nested, 0, 1, dim=1)) == [[0], [0]]
    assert one(spark, fn.array_flatten(nested)) == [0, 1, 2, 3, 4, 0, 1]
    assert one(spark, fn.one_hot(F.lit(2), 4)) == [0, 0, 1, 0]


def test_parse_kv_and_config(spark):
    assert one(spark, fn.parse_kv(F.lit("a=1,b=x=y,a=2"))) == {"a": "2", "b": "x=y"}
    runs = spark.createDataFrame([(1, {"lr": "0,1", "githash": "z"}), (2, {"lr": "3"})], "run_id int, config map<string,string>")
    assert [r.s for r in runs.select(config.config_string("config").alias("s")).collect()] == ["lr=0_1", "lr=3"]
    assert [r.run_id for r in config.filter_config(runs, {"lr": "3"}).collect()] == [2]
    assert config.filter_config(runs, "nope=1").count() == 0
    with pytest.raises(Exception):
        config.cast_config(spark.createDataFrame([("x",)], "a string"), "a=int").collect()
    assert config.cast_config(spark.createDataFrame([("x",)], "a string"), "a=int", lenient=True).first().a is None
    arrays = spark.createDataFrame([([1.0, 2.0], 1.0), ([1.0], 1.0)], "m array<double>, s double")
    assert config.filter_min_length(arrays, {"m": 2, "absent": 5}).count() == 1
    assert config.filter_min_length(arrays, {"s": 2}).count() == 0


def test_param_grid_labels(spark):
    long = "x" * 25
    options = grid.parse_command("./run --iter=100 --seed=1,2 --name=a," + long)
    rows = grid.param_grid(spark, options).orderBy("trial_id").collect()
    assert [r.label for r in rows] == ["seed=1_name=a", "seed=1_name=1", "seed=2_name=a", "seed=2_name=1"]
    assert rows[1].command == f"./run --iter=100 --seed=1 --name={long}"
    with pytest.raises(ValueError):
        grid.parse_command("./run --seed={seq 1 3}")
    assert grid.parse_command("./run --seed={seq 1 3}", {"--seed": ["1", "2", "3"]})["--seed"] == ["1", "2", "3"]


def test_nested_grid_order(spark):
    spec = [{"a": [1, 2], "__sub": [{"o": "adam", "b": [7, 8]}, {"o": "sgd"}], "c": ["x", "y"]}, {"a": 9}]
    got = [tuple(r) for r in grid.nested_grid(spark, spec).select("trial_id", "a", "o", "b", "c").orderBy("trial_id").collect()]
    want = []
    for c in "xy":
        for o, b in (("adam", "7"), ("adam", "8"), ("sgd", None)):
            for a in "12":
                want.append((len(want), a, o, b, c))
    want.append((len(want), "9", None, None, None))
    assert got == want


def test_assign_groups(spark):
    df = spark.range(100).withColumnRenamed("id", "t")
    got = grid.assign_groups(df, "t", 8, seed=3, bits=3).collect()
    assert sorted(r.seq for r in got) == list(range(100)) and max(r.group_id for r in got) == 12
    assert [r.t for r in sorted(got, key=lambda r: r.seq)] != list(range(100))
    assert {r.group_id for r in grid.assign_groups(df, "t", 0).collect()} == {0}


def test_keep_recent_none_kept(spark):
    df = spark.createDataFrame([("d", "d/a.pt", 1), ("d", "d/b.pt", 2), ("d", "d/c.txt", 3)], "folder string, path string, mtime int")
    assert {(r.path, r.keep) for r in files.keep_recent(df, ["*.pt"], 1).collect()} == {("d/a.pt", False), ("d/b.pt", True)}
    assert all(not r.keep for r in files.keep_recent(df, ["*"], 0).collect())


def test_probe_stops_at_gap(spark):
    existing = spark.createDataFrame([(1, 0), (1, 1), (1, 3), (2, 1)], "id bigint, job_idx bigint")
    got = files.probe_job_logs(existing.select("id"), existing, "/r").collect()
    assert sorted(r.prefix for r in got) == ["1-0", "1-1"]


def test_table_diff(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, None)], "k int, v double")
    b = spark.createDataFrame([(1, 1.0 + 1e-9), (2, 2.1), (4, 0.0), (3, None)], "k int, v double")
    assert {(r.k, r.status) for r in quality.table_diff(a, b, ["k"], ["v"]).collect()} == {(2, "differs"), (4, "only_b")}


def test_restart_markers(spark):
    lines = ["===*** Job start ***===", "[submitit][WARNING] Caught SIGUSR1", "[submitit][WARNING] Bypassing SIGTERM", "[submitit][WARNING] slow", "x"]
    df = spark.createDataFrame([(s,) for s in lines], "line string").select(logs.is_restart(F.col("line")).alias("m"))
    assert [r.m for r in df.collect()] == [True, True, False, False, False]


def test_retry_plan_round_trip(spark):
    df = spark.createDataFrame([(5, "FAILED", "sbatch -e /l/%j.err -o /l/%j.out run.sh a b"), (6, "CANCELLED", "sbatch run.sh")], "job_id bigint, state string, submit_line string")
    first = {r.job_id: r for r in jobs.retry_plan(jobs.job_fields(df), "/fb").collect()}
    assert first[5].std_base == "/l/5" and first[6].std_base == "/fb/6"
    assert first[5].submit_line.startswith("sbatch -e /l/5_1.err -o /l/5_1.out --comment='rerun:{@@@std_base@@@:___@@@/l/5@@@,___@@@fail_count@@@:___1}' ")
    assert first[5].submit_line.endswith("run.sh a b 2>&1 1> /dev/null")
    again = spark.createDataFrame([(9, "FAILED", first[5].comment, "/elsewhere/9.err", "sbatch x")], "job_id bigint, state string, comment string, stderr_file string, submit_line string")
    row = jobs.retry_plan(again).first()
    assert (row.std_base, row.fail_count, row.stderr_path) == ("/l/5", 2, "/l/5_2.err")


def test_spec_rules(spark):
    spec = SweepSpec(
        result_groups={"d": ResultGroup("df"), "e": ResultGroup("event"), "f": ResultGroup("func")}, default_result_group=["e", "f"],
        common_options={"topk_mean": 3}, specific_options={"acc": {"descending": True}, "loss": {"topk_mean": 1}}, default_group_order=["lr", "bs"],
    )
    assert spec.choose()[0] == "event" and spec.choose(["f"])[0] == "func" and spec.choose(["e", "d"])[0] == "df"
    assert spec.options_for("acc") == MetricOptions(topk_mean=3, descending=True)
    assert spec.options_for("loss").topk_mean == 1 and spec.options_for("loss").descending is False
    assert spec.order_groups(["seed", "bs", "lr"]) == ["lr", "bs", "seed"]


def test_ingest(spark):
    text = ["acc=0.1", "===*** Job start ***===", "acc=0.2", "acc=0.4", "final 3 x"]
    lines = spark.createDataFrame([("/s/1", i, s) for i, s in enumerate(text)], "folder string, line_no bigint, line string")
    acc = Rule(r"acc=([\d.]+)", (Capture("acc"),))
    final = Rule(r"final (\d+) (\w)", (Capture("n", 1, "bigint"), Capture("tag", 2, "string")))
    spec = SweepSpec(
        result_groups={
            "ev": ResultGroup("event", [acc]), "tab": ResultGroup("df", [final]),
            "fn": ResultGroup("func", func=lambda d: d.groupBy("folder").agg(F.count("*").alias("n"))),
        },
        default_result_group=["ev"],
    )
    kind, out = ingest(lines, spec)
    assert kind == "event" and [(r.metric, r.pos, r.value) for r in out.orderBy("pos").collect()] == [("acc", 0, 0.2), ("acc", 1, 0.4)]
    kind, out = ingest(lines, spec, ["tab"])
    configs = spark.createDataFrame([("/s/1", {"lr": "1"})], "folder string, config map<string,string>")
    assert with_config(out, configs, ["lr"]).select("n", "tag", "override_lr").first() == (3, "x", "1")
    assert ingest(lines, spec, ["fn"])[1].first().n == 4


def test_extract_first_rows(spark):
    df = spark.createDataFrame([("f", 0, "no"), ("f", 1, "v: 1,2"), ("f", 2, "v: 3")], "folder string, line_no bigint, line string")
    parts = lambda line: F.transform(F.split(F.regexp_extract(line, "v: (.*)", 1), ","), lambda s: s.cast("int"))
    out = logs.extract_first(df, Rule("v:", (Capture("x", expr=parts),)), explode_rows=True)
    assert [r.x for r in out.collect()] == [1, 2]


def test_tracking_url_and_errors(spark):
    rows = [("a", 0, "Error 1"), ("a", 1, "wandb: 🚀 View run at  http://u/1 "), ("a", 2, "Error 2"), ("a", 3, "Error 3"), ("a", 4, "Error 4"), ("b", 0, "x")]
    df = spark.createDataFrame(rows, "folder string, line_no bigint, line string")
    assert {r.folder: r.url for r in logs.tracking_url(df).collect()} == {"a": "http://u/1", "b": None}
    assert logs.error_tail(df).first().errors == ["Error 2", "Error 3", "Error 4"]


def test_resolve_sweep_dir(spark):
    rows = [("/a.log", 0, "x"), ("/a.log", 1, "Sweep output dir : /s/1"), ("/a.log", 2, "Sweep output dir : /s/2"), ("/b.log", 0, "x")]
    df = spark.createDataFrame(rows, "folder string, line_no bigint, line string")
    assert {r.folder: r.sweep_dir for r in logs.resolve_sweep_dir(df).collect()} == {"/a.log": "/s/1", "/b.log": "/b.log"}
    with pytest.raises(Exception, match="no sweep folder"):
        logs.resolve_sweep_dir(df, pattern=logs.SWEEP_DIR_REQUIRED, required=True).collect()


def test_best_points_merge_like_one_pass(spark):
    p = points(spark, {(1, "a"): [3.0, 1.0, 3.0, 2.0, 0.5], (1, "b"): [1.0, 1.0, 5.0], (2, "a"): [None, None], (3, "b"): [4.0]})
    default, options = MetricOptions(topk_mean=2), {"b": MetricOptions(topk_mean=3, descending=True)}
    parts = [reduce.best_points(p.where(c), default, options) for c in ("pos < 2", "pos >= 2")]
    merged = reduce.from_best_points(reduce.merge_best_points(parts[0].unionByName(parts[1]), default, options), default, options)
    whole = reduce.reduce_series(p, default, options)
    assert sorted(map(tuple, merged.collect()), key=str) == sorted(map(tuple, whole.collect()), key=str)


def test_exact_median_joined_by_key(spark, monkeypatch):
    rng = np.random.default_rng(11)
    rows = [(g, float(v)) for g in range(5) for v in np.round(rng.normal(size=10 + 40 * g), 1)]
    df = spark.createDataFrame(rows, "g int, v double")
    got = {r.g: r["median"] for r in stats.describe_values(df, "v", ["g"], accuracy=50).collect()}
    for g in range(5):
        assert got[g] == pytest.approx(float(np.median([v for k, v in rows if k == g])))


def test_sizing():
    from runlens.session import sizing

    assert sizing(0)["spark.sql.shuffle.partitions"] == "200"
    assert sizing(100 << 40)["spark.sql.shuffle.partitions"] == str((100 << 40) // (256 << 20))


# ---- keys, caps and odd input ------------------------------------------------------------------


def test_null_keys_keep_their_numbers(spark):
    points = spark.createDataFrame([(None, "m", i, float(v)) for i, v in enumerate([3, 1, 2])] + [(1, "m", 0, 5.0)], "run_id bigint, metric string, pos bigint, value double")
    got = {r["run_id"]: r for r in reduce.reduce_series(points, MetricOptions(topk_mean=2)).collect()}
    assert (got[None]["len"], got[None]["best"], got[None]["best_idx"], got[None]["topk_mean"]) == (3, 1.0, 1, 1.5)
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", None), ("b", 2.0)], "g string, v double")
    rows = {r["g"]: (r["n"], r["median"]) for r in stats.describe_values(df, "v", ["g"]).collect()}
    assert rows == {None: (2, 2.0), "a": (0, None), "b": (1, 2.0)}
    empty = stats.describe_values(df.where("false"), "v").collect()
    assert len(empty) == 1 and empty[0]["n"] == 0 and empty[0]["median"] is None
    one = spark.createDataFrame([(None, 1.0)], "g string, v double")
    assert quality.table_diff(one, one, ["g"], ["v"]).count() == 0


def test_missed_bracket_is_read_off_all_values(spark, monkeypatch):
    monkeypatch.setattr(stats.F, "percentile_approx", lambda *a, **k: F.array(F.lit(1e9), F.lit(1e9)))
    df = spark.createDataFrame([("a", float(v)) for v in (5, 1, 4, 2)], "g string, v double")
    assert stats.describe_values(df, "v", ["g"]).first()["median"] == 3.0


@pytest.mark.parametrize("hot_rows", [3, 1 << 20])
@pytest.mark.parametrize("k", [1, 3])
def test_topk_admission_with_null_keys(spark, hot_rows, k):
    rng = np.random.default_rng(1)
    series = {None: rng.integers(0, 9, 40), 7: np.arange(20), 8: np.arange(20)[::-1]}
    rows = [(r, "m", i, float(v)) for r, values in series.items() for i, v in enumerate(values)]
    points = spark.createDataFrame(rows, "run_id bigint, metric string, pos bigint, value double")
    want = {}
    for r, values in series.items():
        kept = []
        for i, v in enumerate(values):
            worst = min(kept) if len(kept) == k else None
            ok = worst is None or v > worst
            want[r, i] = (ok, worst)
            if ok:
                kept = sorted(kept + [float(v)])[-k:]
    got = {(r["run_id"], r["pos"]): (r["admitted"], r["worst"]) for r in topk.topk_admission(points, k, bits=2, hot_rows=hot_rows).collect()}
    assert got == want
    before = spark.createDataFrame([(None, "m", 8.0)] * k, "run_id bigint, metric string, value double")
    late = topk.topk_admission(points.where("run_id is null"), k, bits=2, hot_rows=hot_rows, kept_before=before)
    assert late.where("admitted").count() == 0


def test_nested_grid_walks_lists_and_dicts(spark):
    rows = grid.nested_grid(spark, {"a": [1, [2, 3]], "b": {"c": [1, 2]}}).orderBy("trial_id").collect()
    assert [(r["a"], r["b"]) for r in rows] == [(a, b) for b in ('{"c": 1}', '{"c": 2}') for a in "123"]


def test_pivot_of_a_long_axis(spark):
    df = spark.range(3000).selectExpr("id as k", "id % 2 as c", "double(id) as v")
    cells = groups.pivot_grid(df, {"k": None}, {"c": None}, "v")
    assert cells.count() == 6000 and cells.where("n > 0").count() == 3000
    assert cells.where("k = 2999").select("_row").first()[0] == 2999
    assert groups.pivot_grid(df.where("false"), {"k": None}, {"c": None}, "v").count() == 0


def test_long_id_ranges(spark):
    ids = ranges.expand_ids(spark.createDataFrame([("1-200000,7",), ("3000000000-3000000001",)], "t string"), "t")
    assert ids.count() == 200_003 and ids.agg(F.max("id")).first()[0] == 3_000_000_001


def test_yaml_scalars_of_a_header(spark):
    text = ["lr: 0.3 # note", "q: 'a # b' # c", "name:", "e: ~", '"k": 5', "flag: true", "nest:", "  a: 1", "lst:", "- 1", "m: {a: 1}", "url: http://x#y", "[log] hi", "z: 1"]
    lines = spark.createDataFrame([("f", i, x) for i, x in enumerate(text)], "folder string, line_no bigint, line string")
    assert sweeps.header_overrides(lines).first()["overrides"] == ["lr=0.3", "q=a # b", "name=None", "e=None", "k=5", "flag=True", "url=http://x#y"]


def test_commands_by_url_and_unknown_ones(spark):
    jobs_table = spark.createDataFrame([(1, "RUNNING", "run a"), (2, "RUNNING", "run b")], "job_id bigint, state string, submit_line string").withColumn("comment", F.lit(""))
    tracked = jobs_table.select("job_id")
    prefix = logs.TRACKING_PREFIX
    stderr = spark.createDataFrame([(1, 0, "x"), (1, 1, prefix + " http://u/1"), (2, 0, prefix + " http://u/2")], "job_id bigint, line_no bigint, line string")
    commands = lambda *rows: spark.createDataFrame(list(rows), "name string, arg string")
    out = jobs.apply_commands(commands(("cancel_wandb_urls", "http://u/2,http://u/9"), ("find_urls", "http://u/1"), ("dance", "now")), jobs_table, tracked, stderr)
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(2, "cancel"), (1, "find"), (None, "unknown")], key=str)
    with pytest.raises(Exception, match="URL commands need"):
        jobs.apply_commands(commands(("find_urls", "http://u/1")), jobs_table, tracked).collect()


def test_payload_that_is_no_json(spark):
    lines = spark.createDataFrame([("f", 0, '1: args: {"a": 1}'), ("f", 1, "1: args: {bad")], "file string, line_no bigint, line string")
    rows = logs.parse_tagged_json(lines).orderBy("seq").collect()
    assert [(r["payload"] and r["payload"].strip(), r["failed"]) for r in rows] == [('{"a": 1}', False), (None, True)]


def test_axes_text():
    from runlens.plans.report import parse_axes

    assert parse_axes("A=[1,2],B/C") == ({"A": ["1", "2"], "B": None}, {"C": None})
    with pytest.raises(ValueError):
        parse_axes("A,B")


def test_state_is_read_from_the_newest_snapshot(spark, tmp_path):
    from runlens.streaming import core

    path, schema = str(tmp_path / "state"), "k bigint, v bigint"
    for batch in range(0, 2 * core.SNAPSHOT + 3):
        before = core.read_state(spark, path, schema, ["k"], batch)
        core.write_state(spark.createDataFrame([(batch % 7, batch)], schema), before, path, ["k"], batch)
    rows = core.read_before(spark, path, schema)
    assert core.since_snapshot(rows).select("batch_id").distinct().count() == 3
    assert rows.select("batch_id").distinct().count() <= core.SNAPSHOT + 3
    last = 2 * core.SNAPSHOT + 2
    assert sorted(tuple(r) for r in core.read_state(spark, path, schema, ["k"]).collect()) == sorted((b % 7, b) for b in range(last - 6, last + 1))


def test_relative_sweep_folders_are_looked_up(spark):
    rows = [("/logs/a.log", 0, "Sweep output dir : out/1"), ("/logs/b.log", 0, "Sweep output dir : /abs/2"), ("/logs/c", 0, "Sweep output dir : out/1"), ("/logs/d.log", 0, "Sweep output dir : nowhere")]
    lines = spark.createDataFrame(rows, "folder string, line_no bigint, line string")
    known = spark.createDataFrame([("/second/out/1",), ("/third/out/1",)], "folder string")
    got = dict(map(tuple, logs.resolve_sweep_dir(lines, roots=["/first", "/second", "/third"], known=known, suffix=".log").collect()))
    assert got == {"/logs/a.log": "/second/out/1", "/logs/b.log": "/abs/2", "/logs/c": "/logs/c", "/logs/d.log": None}
