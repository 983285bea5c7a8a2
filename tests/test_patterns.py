"""Pattern sets: literals that every match must hold, and the same hits as trying every pattern on every text."""

from __future__ import annotations

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from runlens.operators import jobs, patterns


@pytest.mark.parametrize("pattern,found", [
    ("run.sh 1-URGENT$", [["run", "sh 1-URGENT"]]), (r"run\.sh", [["run.sh"]]), ("abcd?efg", [["abc", "efg"]]), ("abcd+efgh", [["abcd", "efgh"]]), ("ab{2}cdef", [["a", "cdef"]]),
    ("one|three", [["one"], ["three"]]), ("x(abcdef)?yz", [["x", "yz"]]), ("[abc]defg", [["defg"]]), (r"[\]x]defg", [["defg"]]), (r"\d+ms", [["ms"]]), ("(?i)abcdef", [[]]),
    ("(a|b)cdef|gh", [["cdef"], ["gh"]]), ("", [[]]), ("a*", [[]]), (r"\x41bcdef", [[]]),
])
def test_literals(pattern, found):
    assert patterns.literals(pattern) == found


@settings(max_examples=400, deadline=None)
@given(st.text("abc.*+?|()[]{}^$\\d12-", max_size=10), st.text("abcd.12-() ", max_size=20))
def test_a_match_holds_a_literal(pattern, text):
    try:
        hit = re.search(pattern, text)
    except re.error:
        return
    if hit:
        assert any(all(x in text for x in runs) for runs in patterns.literals(pattern))


def test_hits_are_those_of_every_pattern_on_every_text(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcd-") for _ in range(rng.randint(1, 9)))
    texts = [(i, f"sbatch {word()} run.sh {word()}") for i in range(150)] + [(200, ""), (201, None), (202, "ab"), (203, "sbatch abab run.sh cdcd")]
    some = [word() for _ in range(60)] + [f"{word()}.*{word()}" for _ in range(60)] + ["run.sh [ab]", "^sbatch", "a|b", "abab|cdcd", ".", "", "(?i)SBATCH", "$^", "((", "[", "a{2,1}", r"\d", r"sh (\w+)-"]
    df = spark.createDataFrame(texts, "id long, t string")
    parsed = patterns.parse_patterns(spark.createDataFrame([(p,) for p in some] + [(None,), (some[0],)], "pattern string"))
    got = {(r["id"], r["pattern"]) for r in patterns.match_patterns(df, "t", ["id"], parsed).collect()}
    bad = {r["pattern"] for r in parsed.where("not valid").collect()}
    assert bad == {"((", "[", "a{2,1}"}
    assert got == {(i, p) for i, t in texts for p in some if p not in bad and t is not None and re.search(p, t)}


def test_a_broken_pattern_is_told_apart(spark):
    rows = spark.createDataFrame([(1, "RUNNING", None, None, None, "sbatch run.sh x"), (2, "RUNNING", None, None, None, "sbatch run.sh y")], "job_id long, state string, comment string, stderr_file string, stdout_file string, submit_line string")
    commands = spark.createDataFrame([("cancel_regex", "("), ("cancel_regex", "run.sh x"), ("find_regex", "y$"), ("find_regex", None)], "name string, arg string")
    got = {(r["job_id"], r["action"]) for r in jobs.apply_commands(commands, rows, rows.select("job_id")).collect()}
    assert got == {(None, "invalid"), (1, "cancel"), (2, "find")}


def test_patterns_of_ids_meet_few_texts(spark, monkeypatch):
    """Numbered names share all their short grams: candidates must not grow with the square of the names."""
    names = spark.range(3000).select("id", F.concat(F.lit("run.sh --name=n"), F.lpad(F.col("id").cast("string"), 12, "0")).alias("t"))
    parsed = patterns.parse_patterns(names.select(F.concat(F.substring("t", 8, 30), F.lit("( |$)")).alias("pattern")))
    assert {r["valid"] for r in parsed.collect()} == {True}
    tried = []
    candidates = patterns._candidates
    monkeypatch.setattr(patterns, "_candidates", lambda *a: tried.append(candidates(*a)) or tried[0])
    assert patterns.match_patterns(names, "t", ["id"], parsed).count() == 3000
    assert tried[0].count() <= 4 * 3000


def test_equal_texts_are_exploded_once_and_never_broadcast(spark):
    """The planner takes exploded grams for as small as the file they come from; 50,000 rows of two texts are two texts."""
    rows = spark.range(50_000).select("id", F.when(F.col("id") % 2 == 0, "sbatch run.sh 1-URGENT").otherwise("sbatch run.sh 5-LOW").alias("t"))
    parsed = patterns.parse_patterns(spark.createDataFrame([("1-URGENT$",), ("sbatch",), ("5-L.W",)], "pattern string"))
    hits = patterns.match_patterns(rows, "t", ["id"], parsed)
    assert {r["pattern"]: r["count"] for r in hits.groupBy("pattern").count().collect()} == {"1-URGENT$": 25_000, "sbatch": 50_000, "5-L.W": 25_000}
    own = rows.select(F.col("t").alias("_text")).distinct().withColumn("_id", F.xxhash64("_text"))
    plan = patterns._candidates(own, parsed.where("size(grams[0]) > 0"), [4, 8])._jdf.queryExecution().executedPlan().toString()
    built = [line for line in plan.split("\n") if "BroadcastHashJoin" in line]
    assert built and all("LeftAnti, BuildRight" in line for line in built)
