"""Block-wise operators give the same result for any block size, including one with hot groups."""

import random

from pyspark.sql import functions as F

from runlens.operators import blocks, curves, logs, ranges, stats, topk
from runlens.operators.blocks import block_of, dense_positions, running_count


def hot_points(spark, n=300, seed=1):
    """One series holds most rows."""
    rng = random.Random(seed)
    rows = [(0, "m", i, float(rng.randint(0, 20))) for i in range(n)]
    for run in range(1, 12):
        rows += [(run, "m", i, float(rng.randint(0, 9))) for i in range(rng.randint(1, 6))]
    return rows, spark.createDataFrame(rows, "run_id bigint, metric string, pos bigint, value double")


def series(rows):
    out = {}
    for run, metric, pos, value in sorted(rows):
        out.setdefault((run, metric), []).append(value)
    return out


def test_dense_positions_and_running_count(spark):
    rng = random.Random(3)
    rows = [(rng.choice([0, 0, 0, 1, 2]), i * 3, rng.random() < 0.3) for i in range(200)]
    df = spark.createDataFrame(rows, "k int, o bigint, f boolean")
    got = {(r.k, r.o): r.pos for r in dense_positions(df, ["k"], ["o"], block_of("o", 4)).collect()}
    counts = {(r.k, r.o): r.c for r in running_count(df, ["k"], "o", F.col("f"), "c", bits=4).collect()}
    seen, flags = {}, {}
    for k, o, f in rows:
        assert got[k, o] == seen.get(k, 0)
        seen[k] = seen.get(k, 0) + 1
        flags[k] = flags.get(k, 0) + f
        assert counts[k, o] == flags[k]


def test_moving_average_matches_formula(spark):
    rows, df = hot_points(spark)
    for period in (1, 2, 3, 4, 5, 8):
        got = {}
        for r in curves.moving_average(df, period, bits=3).orderBy("run_id", "pos").collect():
            got.setdefault((r.run_id, r.metric), []).append(r.avg)
        for key, v in series(rows).items():
            right = (period - 1) // 2
            padded = [v[0]] * (period // 2) + v + (v[-right:] if right else [])
            want = [sum(w) / len(w) for w in (padded[i : i + period] for i in range(len(v)))]
            assert len(got[key]) == len(v)
            assert all(abs(a - b) < 1e-9 for a, b in zip(got[key], want)), (period, key)


def test_clipped_mean(spark):
    rows, df = hot_points(spark)
    span = 4
    everywhere = {(r.run_id, r["at"]): r["mean"] for r in curves.clipped_mean_all(df, span, bits=3).collect()}
    at = [0, 3, 100, 304, 1000]
    chosen = {(r.run_id, r["at"]): r["mean"] for r in curves.clipped_mean(df, at, span).collect()}
    for (run, _), v in series(rows).items():
        for e in list(range(len(v))) + at:
            lo, hi = min(max(e - span, 0), len(v)), min(e + span + 1, len(v))
            want = sum(v[lo:hi]) / (hi - lo) if lo < hi else None
            for table in [everywhere] * (e < len(v)) + [chosen] * (e in at):
                got = table[run, e]
                assert (got is None) == (want is None) and (want is None or abs(got - want) < 1e-9)


def test_id_ranges_any_block_size(spark):
    rng = random.Random(5)
    ids = sorted(set(range(40, 90)) | {rng.randint(0, 200) for _ in range(60)})
    df = spark.createDataFrame([("a", i) for i in ids] + [("a", ids[0]), ("b", 7)], "g string, id bigint")
    want, start = [], None
    for i in ids:
        if i - 1 not in ids:
            start = i
        if i + 1 not in ids:
            want.append(("a", start, i))
    for bits in (1, 2, 3, 16):
        got = sorted(tuple(r) for r in ranges.id_ranges(df, ["g"], "id", bits).select("g", "lo", "hi").collect())
        assert got == sorted([*want, ("b", 7, 7)]), bits


def test_longest_section_blocks(spark):
    rng = random.Random(8)
    rows = []
    for folder in ("hot", "x", "y", "no-marker"):
        n = 200 if folder == "hot" else 9
        rows += [(folder, i, "mark" if folder != "no-marker" and rng.random() < 0.1 else "row") for i in range(n)]
    df = spark.createDataFrame(rows, "folder string, line_no bigint, line string")
    got = {}
    for r in logs.longest_section(df, F.col("line") == "mark", bits=3).collect():
        got.setdefault(r.folder, []).append(r.line_no)
    for folder in {r[0] for r in rows}:
        lines = [r[2] for r in rows if r[0] == folder]
        cuts = [0] + [i for i, s in enumerate(lines) if s == "mark"] + [len(lines)]
        sections = list(zip(cuts, cuts[1:]))
        a, b = sorted(sections, key=lambda s: s[1] - s[0])[-1]
        assert sorted(got[folder]) == list(range(a, b))


def plain_modes(lines):
    train = evaluating = False
    step, out = None, []
    for i, line in enumerate(lines):
        if line.startswith("Eval:"):
            evaluating = True
        elif line.startswith("Train:"):
            train = True
        elif train:
            if line.startswith("Total step"):
                step, train = float(line.split()[2][:-1]), False
        elif evaluating and line.startswith("Acc"):
            out.append((i, step, float(line.split()[-1])))
            step, evaluating = None, False
    return out


def test_mode_log_blocks(spark):
    rng = random.Random(13)
    logs_by_file = {}
    for f in range(6):
        n = 400 if f == 0 else 25
        kinds = ["Train:", "Eval:", "Total step: {}M", "Accumulated: 1.0[2], Last episode[16] Avg: {}", "other"]
        logs_by_file[f] = [rng.choice(kinds).format(rng.randint(1, 99) / 4) for _ in range(n)]
    rows = [(f, i, line) for f, lines in logs_by_file.items() for i, line in enumerate(lines)]
    df = spark.createDataFrame(rows, "file int, line_no bigint, line string")
    for bits, hot in ((1, 10), (3, 100), (16, 1000)):
        got = {}
        for r in logs.parse_mode_log(df, bits=bits, hot_rows=hot).orderBy("file", "seq").collect():
            got.setdefault(r.file, []).append((r.seq, r.step, r.test_avg))
        for f, lines in logs_by_file.items():
            assert got.get(f, []) == plain_modes(lines), (bits, f)


def plain_topk(values, k):
    slots, out = [], []
    for v in values:
        if len(slots) < k:
            out.append(len(slots))
            slots.append(v)
        elif v > min(slots):
            slot = slots.index(min(slots))
            slots[slot] = v
            out.append(slot)
        else:
            out.append(None)
    return out


def test_topk_admission_and_slots(spark):
    rows, df = hot_points(spark)
    for k in (1, 3):
        for bits, hot in ((2, 3), (4, 50), (16, 1000)):
            flagged = topk.topk_admission(df, k, bits=bits, hot_rows=hot)
            flags = {(r.run_id, r.pos): r.admitted for r in flagged.collect()}
            slots = {(r.run_id, r.pos): r.slot for r in topk.assign_slots(flagged.where("admitted"), k, bits=bits, hot_rows=hot).collect()}
            for (run, _), v in series(rows).items():
                want = plain_topk(v, k)
                assert [flags[run, i] for i in range(len(v))] == [w is not None for w in want]
                assert [slots.get((run, i)) for i in range(len(v))] == want


def test_step_gaps_blocks(spark):
    rows = [("s", i, i * i * 1000) for i in range(50)]
    df = spark.createDataFrame(rows, "s string, line_no bigint, us bigint").withColumn("ts", F.timestamp_micros("us"))
    got = {r.line_no: r.gap_ms for r in stats.step_gaps(df, ["s"], bits=2).collect()}
    assert got == {i: 0.0 if i == 0 else float(i * i - (i - 1) * (i - 1)) for i in range(50)}


def test_topk_continues_from_kept_scores(spark):
    rows, df = hot_points(spark, seed=21)
    k = 3
    early, late = df.where("pos < 4"), df.where("pos >= 4")
    first = topk.topk_admission(early, k)
    kept = topk.kept_slots(topk.assign_slots(first.where("admitted"), k))
    for hot in (3, 1000):
        flagged = topk.topk_admission(late, k, bits=3, kept_before=kept, hot_rows=hot)
        slots = {(r.run_id, r.pos): r.slot for r in topk.assign_slots(flagged.where("admitted"), k, kept_before=kept, bits=3, hot_rows=hot).collect()}
        for (run, _), v in series(rows).items():
            want = plain_topk(v, k)
            assert [slots.get((run, i)) for i in range(4, len(v))] == want[4:], (hot, run)


def test_slots_of_rising_and_tied_series(spark):
    """Long rising series in blocks, ties, fewer scores than slots, and a series without a key."""
    rng = random.Random(4)
    values = {
        "rise": [float(i) for i in range(400)], "steps": [float(i // 3) for i in range(400)], "few": [3.0, 1.0],
        "wild": [float(rng.randint(0, 30) + i // 4) for i in range(400)], "fall": [-float(i) for i in range(50)], None: [float(i * 7 % 40) for i in range(300)],
    }
    df = spark.createDataFrame([(s, "m", i, v) for s, vs in values.items() for i, v in enumerate(vs)], "run_id string, metric string, pos bigint, value double")
    for k, bits, hot in ((1, 3, 20), (4, 4, 20)):
        for cut_at in (0, 120):
            kept = None
            if cut_at:
                first = topk.topk_admission(df.where(F.col("pos") < cut_at), k)
                kept = topk.kept_slots(topk.assign_slots(first.where("admitted"), k))
            flagged = topk.topk_admission(df.where(F.col("pos") >= cut_at), k, bits=bits, kept_before=kept, hot_rows=hot)
            got = {(r.run_id, r.pos): r.slot for r in topk.assign_slots(flagged.where("admitted"), k, kept_before=kept, bits=bits, hot_rows=hot).collect()}
            for s, vs in values.items():
                want = plain_topk(vs, k)
                assert [got.get((s, i)) for i in range(cut_at, len(vs))] == want[cut_at:], (s, k, bits, cut_at)


def test_huge_series_are_looked_for_once(spark, monkeypatch):
    """A large table without a huge series is read once, for its counts, and neither joined nor cut."""
    rows = spark.range(3000).select((F.col("id") % 300).alias("run_id"), F.lit("m").alias("metric"), (F.col("id") / 300).cast("long").alias("pos"), F.rand(3).alias("value"))
    monkeypatch.setattr(blocks, "HOT_ROWS", 1000)
    flagged = topk.topk_admission(rows, 2)
    assert "Join" not in flagged._jdf.queryExecution().optimizedPlan().toString()
    assert flagged.count() == 3000


def test_slots_across_arrow_batches(spark):
    """Series that reach over batches, NULL keys among them, keep the slots of a plain walk."""
    rows = [(run, "m", p, float((p * 7919 + (run or 5) * 31) % 97)) for run in (None, 1, 2, 3) for p in range(200)]
    want = {}
    for run in (None, 1, 2, 3):
        held = []
        for r in (r for r in rows if r[0] == run):
            if len(held) < 3:
                held.append(r[3])
                want[run, r[2]] = len(held) - 1
            elif r[3] > min(held):
                slot = held.index(min(held))
                held[slot] = r[3]
                want[run, r[2]] = slot
    df = spark.createDataFrame(rows, "run_id long, metric string, pos long, value double")
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(name, "7")
    try:
        admitted = topk.topk_admission(df, 3).where("admitted").drop("admitted", "worst")
        got = {(r["run_id"], r["pos"]): r["slot"] for r in topk.assign_slots(admitted, 3).collect()}
    finally:
        spark.conf.unset(name)
    assert got == want
