"""Trees of many small files: what tasks list, read and write is what Spark's own readers and writer make of them."""

from __future__ import annotations

import gzip
import os
import shutil
import zipfile

import pytest
from pyspark.sql import functions as F

from runlens import session
from runlens.plans import fixtures as fx
from runlens.plans.catalog import QUERIES
from runlens.plans.catalog_files import chat_tree
from runlens.sources import sweeps, sweep_source, trees


@pytest.fixture
def tree(tmp_path):
    texts = {
        "1/a.log": b"one\ntwo\r\nthree\rfour\n\n\r\r\n", "1/b.log": b"second log\n", "2/a.log": b"\xef\xbb\xbfwith a mark\nno end", "3/a.log": b"",
        "4/.a.log": b"hidden\n", "4/_b.log": b"hidden\n", "5/z.txt": b"other\n", ".6/a.log": b"hidden run\n", "_7/a.log": b"run\n", "8/a.log": "é\U0001f600\r".encode(),
        "9/a.log": b"".join(b"line %d\r\n" % i * (i % 3) for i in range(3000)),
    }
    for name, text in texts.items():
        (tmp_path / "t" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "t" / name).write_bytes(text)
    (tmp_path / "t" / "10").mkdir()
    (tmp_path / "t" / "10" / "a.log.gz").write_bytes(gzip.compress(b"packed\nlines\n"))
    return str(tmp_path / "t")


def test_tasks_find_and_read_what_spark_does(spark, tree, monkeypatch):
    def look(root, logs):
        files = sweeps.list_files(spark, f"{root}/*/{logs}").select("path", "size", "mtime")
        lines = sweeps.read_log_lines(spark, root, logs=logs).select("folder", "path", "line_no", "line")
        runs = sweeps.discover_runs(spark, f"{root}/*").select("folder")
        ages = sweeps.log_freshness(spark, root, F.lit("2100-01-01"), logs=logs).select("folder", "age_s")
        loaded = sweeps.load_runs(spark, [f"{root}/*/{logs}"], lambda p, c: {"path": p, "n": len(c)} if len(c) else None, "path string, n bigint")
        return [sorted(map(tuple, d.collect())) for d in (files, lines, runs, ages, loaded)]

    cases = [(tree, "*.log"), (f"file:{tree}", "?.log*"), (tree, "none*"), (tree, "*.txt")]
    assert all(trees.in_tasks(spark, f"{root}/*/{logs}") for root, logs in cases)
    got = [look(*case) for case in cases]
    small = trees.numbered_lines
    monkeypatch.setattr(trees, "numbered_lines", lambda files: small(files, split_bytes=1000))
    cut = look(*cases[0])
    monkeypatch.setattr(trees, "in_tasks", lambda *_: False)
    want = [look(*case) for case in cases[:2]] + [look(*cases[3])]
    assert got[:2] + got[3:] == want and cut == want[0] and got[2][1] == []
    assert len([x for x in want[0][1] if x[0].endswith("/1")]) == 7


def test_listing_starts_no_task_for_every_file(spark, tmp_path):
    rows = spark.range(400).select((F.col("id") % 300).alias("run"), F.col("id").alias("n"), F.concat(F.lit("line "), "id").alias("line"))
    rows = rows.unionByName(spark.createDataFrame([(None, 1, "x"), (7, 1000, None)], "run long, n long, line string"))
    root = str(tmp_path / "w")
    status = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("trees", "")
    try:
        trees.write_logs(rows, root, "run", ["n"])
        found = sweeps.read_log_lines(spark, root, logs="*.txt")
        sizes = [s.numTasks for j in status.getJobIdsForGroup("trees") for i in status.getJobInfo(j).stageIds if (s := status.getStageInfo(i))]
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < max(sizes) < 100  # 301 files: the file index starts a task for each
    got = {(r["folder"].rsplit("=", 1)[1], r["line_no"], r["line"]) for r in found.collect()}
    want = {(str(i % 300), i // 300, f"line {i}") for i in range(400)} | {(trees.NO_KEY, 0, "x"), ("7", 2, "")}
    assert got == want
    # written again: the file is replaced, others stay
    trees.write_logs(rows.where("run = 7").withColumn("line", F.lit("new")), root, "run", ["n"])
    again = {(r["folder"].rsplit("=", 1)[1], r["line_no"], r["line"]) for r in sweeps.read_log_lines(spark, root, logs="*.txt").collect()}
    assert again == {x for x in want if x[0] != "7"} | {("7", i, "new") for i in range(3)}


def test_many_small_logs_are_dealt_over_tasks(spark, tmp_path):
    files = spark.createDataFrame([(f"r{i}", f"/nowhere/{i}", 10) for i in range(5000)], "folder string, path string, size long")
    assert sweep_source.tasks_of(files) >= 10
    assert sweep_source.lines_of_files(files).rdd.getNumPartitions() >= 10


def test_chat_tree_holds_every_turn(spark, tmp_path):
    rows = [(1, 0, "user", "a\nb\rc"), (1, 1, "assistant", None), (2, 0, None, "é")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    lines = sweeps.read_log_lines(spark, chat_tree(spark, str(tmp_path)), logs="*.txt")
    got = [(r["folder"].rsplit("=", 1)[1], r["line_no"], r["role"], r["text"]) for r in lines.select("folder", "line_no", F.get_json_object("line", "$.role").alias("role"), F.get_json_object("line", "$.text").alias("text")).orderBy("folder", "line_no").collect()]
    assert got == [(str(f), n, role, text) for f, n, role, text in rows] and fx.chat(spark, str(tmp_path)).count() == 3


def test_the_package_is_sent_whatever_its_dates_and_names(spark, tmp_path, monkeypatch):
    context, sent = spark.sparkContext, []
    copy = shutil.copytree(os.path.dirname(session.__file__), tmp_path / "runlens", ignore=shutil.ignore_patterns("__pycache__"))
    for folder, _, names in os.walk(copy):
        for name in names:
            os.utime(os.path.join(folder, name), (0, 0))  # before the first date of a zip entry
    monkeypatch.setattr(session, "__file__", str(copy / "session.py"))
    monkeypatch.setattr(context, "addPyFile", sent.append)
    for _ in range(2):
        monkeypatch.setattr(context, "_runlens_shipped", False, raising=False)
        session.ship_package(spark)
    names = [os.path.basename(path) for path in sent]
    assert len({*names, "runlens.zip"}) == 3  # Spark refuses a second file of a name
    assert "runlens/sources/trees.py" in zipfile.ZipFile(sent[0]).namelist()


def _blind(path):
    def run(batches):
        raise OSError("no such mount here")

    return run


def test_a_folder_that_tasks_do_not_see_is_left_to_spark(spark, tree, tmp_path, monkeypatch):
    def look():
        lines = sweeps.read_log_lines(spark, tree, logs="*.log").select("folder", "line_no", "line")
        loaded = sweeps.load_runs(spark, [f"{tree}/*/*.log"], lambda p, c: {"path": p, "n": len(c)} if len(c) else None, "path string, n bigint")
        return [sorted(map(tuple, d.collect())) for d in (lines, sweeps.discover_runs(spark, f"{tree}/*"), loaded)]

    want = look()
    monkeypatch.setattr(spark.sparkContext, "_runlens_seen", {}, raising=False)
    monkeypatch.setattr(trees, "_looker", _blind)
    with pytest.warns(UserWarning, match="tasks cannot look"):
        assert not trees.opens(spark, tree)
    monkeypatch.setattr(trees, "_lister", None)  # nothing is listed by tasks
    assert look() == want
    rows = spark.range(6).select((F.col("id") % 3).alias("run"), F.col("id").alias("n"), F.col("id").cast("string").alias("line"))
    trees.write_logs(rows, str(tmp_path / "w"), "run", ["n"])
    got = {(r["folder"].rsplit("=", 1)[1], r["line_no"], r["line"]) for r in sweeps.read_log_lines(spark, str(tmp_path / "w"), logs="*.txt").collect()}
    assert got == {(str(i % 3), i // 3, str(i)) for i in range(6)}


def test_keys_that_are_null_or_negative(spark, tmp_path):
    turns = [(None, 0, "user", "a"), (None, 1, "assistant", "b"), (-4, 0, "user", "c"), (2**53 + 1, 0, "user", "d")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    lines = QUERIES["a02_read_log_lines"](spark, str(tmp_path)).select("file", "line_no", "role", "text").collect()
    assert {tuple(r) for r in lines} == set(turns) and len(lines) == len(turns)
    runs = QUERIES["k04_load_runs"](spark, str(tmp_path)).select("file", "n_lines").collect()
    assert {tuple(r) for r in runs} == {(None, 2), (-4, 1), (2**53 + 1, 1)}
    events = [(user, n, kind, float(n)) for user in (None, -3, 5) for n, kind in enumerate(["view", "click"])]
    events = spark.createDataFrame(events, "user_id long, event_id long, event_type string, value double")
    events.withColumn("ts", F.timestamp_seconds("event_id")).write.parquet(f"{tmp_path}/events.parquet")
    for name in ("k01_ingest_folder", "k01_ingest_again"):
        found = QUERIES[name](spark, str(tmp_path)).groupBy("folder", "metric").agg(F.sum("value").alias("total")).collect()
        # the first call's choice of runs by their number leaves out those without one
        assert {tuple(r) for r in found if r["folder"] is not None} == {(k, m, v) for k in (-3, 5) for m, v in (("step", 0.0), ("view_value", 0.0), ("value", 1.0))}
        assert name != "k01_ingest_folder" or {(r["metric"], r["total"]) for r in found if r["folder"] is None} == {("step", 0.0), ("view_value", 0.0), ("value", 1.0)}
