"""Many regular expressions against many texts: literal grams pick candidates by an equi-join, only these are matched."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.session import cut, ship_package

#: Characters of a gram; a literal is cut into the longest that fit it, since short ones are met in too many texts.
GRAMS = (4, 8, 16)
#: Grams above one in so many of all grams are kept off the join unless a pattern needs them, so there are at most as many of them.
FREQUENT = 100_000


def literals(pattern: str) -> list[list[str]]:
    """For each top-level alternative the texts that any match must hold; none where nothing is sure.

    Careful rather than clever: groups, classes and what a quantifier makes optional count as unknown.
    """
    if "(?" in pattern:
        return [[]]
    out, runs, run, depth, i = [], [], "", 0, 0

    def close() -> None:
        nonlocal run
        if run:
            runs.append(run)
        run = ""

    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            escaped = pattern[i + 1]
            i += 2
            if depth or escaped.isalnum():
                close()
                if escaped in "xuUNc0":
                    return [[]]  # a character by its number: left to the matcher
            else:
                run += escaped
            continue
        if c == "[":
            close()
            i += 2 if pattern[i + 1 : i + 2] == "^" else 1
            i += pattern[i : i + 1] == "]"
            while i < len(pattern) and pattern[i] != "]":
                i += 2 if pattern[i] == "\\" else 1
        elif c == "(":
            close()
            depth += 1
        elif c == ")":
            close()
            depth -= 1
        elif c == "|" and not depth:
            close()
            out.append(runs)
            runs = []
        elif c in "?*{":
            run = run[:-1]  # the character before may be missing
            close()
            if c == "{":
                i = max(pattern.find("}", i), i)
        elif c == "+":
            close()
        elif c in ".^$|":
            close()
        elif not depth:
            run += c
        i += 1
    close()
    return [*out, runs]


def _grams_of(literal: str) -> list[str]:
    size = max((n for n in GRAMS if n <= len(literal)), default=0)
    return [literal[i : i + size] for i in range(len(literal) - size + 1)] if size else []


def _text_grams(text: str, sizes: list[int]) -> Column:
    """Digests of a text's distinct grams."""

    def of(size: int) -> Column:
        starts = F.sequence(F.lit(1), F.length(text) - size + 1)
        found = F.transform(starts, lambda i: F.xxhash64(F.substring(text, i, F.lit(size))))
        return F.when(F.length(text) >= size, found).otherwise(F.array().cast("array<bigint>"))

    return F.array_distinct(F.concat(*[of(n) for n in sizes]))


def _parse(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for patterns in batches:
        rows = []
        for p in patterns:
            try:
                re.compile(p)
            except (re.error, OverflowError, RecursionError):
                rows.append((False, []))
                continue
            rows.append((True, [sorted({g for x in runs for g in _grams_of(x)}) for runs in literals(p)]))
        yield pd.DataFrame(rows, columns=["valid", "grams"])


def _search(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    compiled: dict[str, re.Pattern] = {}
    for texts, patterns in batches:
        if len(compiled) > 10_000:
            compiled.clear()
        out = []
        for t, p in zip(texts, patterns):
            if p not in compiled:
                compiled[p] = re.compile(p)
            out.append(t is not None and compiled[p].search(t) is not None)
        yield pd.Series(out, dtype=bool)


def parse_patterns(patterns: DataFrame, pattern: str = "pattern") -> DataFrame:
    """Distinct patterns with ``valid`` and, for each alternative, the grams of its literals. NULL patterns are left out.

    Checkpointed: every pattern is parsed once, though many branches read the table.
    """
    ship_package(patterns.sparkSession)
    parsed = F.pandas_udf(_parse, "valid boolean, grams array<array<string>>")
    rows = patterns.where(F.col(pattern).isNotNull()).select(F.col(pattern).alias("pattern")).distinct()
    return cut(rows.withColumn("_p", parsed("pattern"))).select("pattern", "_p.valid", "_p.grams")


def match_patterns(texts: DataFrame, text: str, keys: list[str], parsed: DataFrame) -> DataFrame:
    """``(keys, pattern)`` of every text that a valid pattern is found in (searched, not anchored).

    A pattern whose alternatives all have a gram meets only texts with the rarest gram of each alternative; others are
    tried on every text. Different texts are matched once, whatever rows repeat them; NULL texts match nothing. Grams meet as
    digests, and candidates are searched, so that equal digests of different grams change nothing. No side with exploded
    grams may be broadcast: the planner takes them for as small as the texts.
    """
    rows = texts.select(*keys, F.col(text).alias("_text")).where(F.col("_text").isNotNull())
    own = cut(rows.select("_text").distinct().withColumn("_id", F.xxhash64("_text")))
    valid = parsed.where("valid")
    indexed = F.forall("grams", lambda g: F.size(g) > 0)
    search = F.pandas_udf(_search, "boolean")
    # patterns without a literal ride along with every text in one list, and are spread out for the match
    lists = valid.where(~indexed).agg(F.sort_array(F.collect_list("pattern")).alias("_all"))
    pairs = own.withColumn("_all", lists.scalar()).withColumn("pattern", F.explode("_all")).select("_text", "pattern")
    sizes = sorted(r[0] for r in valid.where(indexed).select(F.explode(F.flatten("grams")).alias("g")).select(F.length("g")).distinct().collect())
    if sizes:
        pairs = pairs.unionByName(_candidates(own, valid.where(indexed), sizes))
    hits = pairs.where(search("_text", "pattern"))
    return rows.join(hits.hint("merge"), "_text").select(*keys, "pattern").distinct()


def _candidates(own: DataFrame, indexed: DataFrame, sizes: list[int]) -> DataFrame:
    """``(_text, pattern)`` of the texts ``own(_text, _id)`` that hold the rarest gram of an alternative."""
    text_grams = own.select("_id", F.explode(_text_grams("_text", sizes)).alias("gram"))
    parts = indexed.select("pattern", F.posexplode("grams").alias("part", "_g"))
    pattern_grams = parts.select("pattern", "part", F.explode("_g").alias("_g")).select("pattern", "part", F.xxhash64("_g").alias("gram"))
    characters = own.agg(F.sum(F.length("_text"))).first()[0] or 0
    is_frequent = F.col("n") > characters * len(sizes) / FREQUENT
    counts = text_grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    wanted = pattern_grams.select("gram").distinct().withColumn("_wanted", F.lit(True))
    seen = cut(counts.join(wanted.hint("merge"), "gram", "left").where(F.col("_wanted") | is_frequent))
    met = pattern_grams.join(seen.where("_wanted").hint("merge"), "gram", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rarest = cut(met.groupBy("pattern", "part").agg(F.min(F.struct("n", "gram")).alias("_r")).where("_r.n > 0").select("pattern", F.col("_r.gram").alias("gram")).distinct())
    common = seen.where(is_frequent).select("gram").join(rarest.hint("merge"), "gram", "left_anti")
    hits = text_grams.join(F.broadcast(common), "gram", "left_anti").join(rarest.hint("merge"), "gram")
    return own.join(hits.select("_id", "pattern").distinct().hint("merge"), "_id").select("_text", "pattern")
