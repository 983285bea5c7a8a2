"""URL filters: a Bloom filter cascade that is exact over the corpus's key universe.

Each url has candidate keys: every suffix of its host at a label border with every path prefix as long as some
rule's path. A rule fits a url if and only if the rule is one of these keys. Level 1 of the cascade encodes the
listed keys; level 2 encodes the keys of the corpus that level 1 lets through wrongly; level 3 the listed keys that
level 2 lets through, and so on until a level lets nothing wrong through. A key is then listed if the number of the first
level that refuses it is even. So membership is exact for all keys of the corpus, by a few lookups and no join.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.llm.common import saved

#: Share of wrong keys a level lets through.
RATE = 0.02
#: Largest filter that is sent to all executors; longer lists are matched by an equi-join of the keys instead.
MAX_FILTER_BYTES = 64 << 20


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (ASCII lower case) and path of a url; both empty for NULL or a url without ``://``."""
    rest = F.when(F.locate("://", url) > 0, F.substr(url, F.locate("://", url) + 3))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^([^?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.coalesce(F.translate(host, upper, upper.lower()), F.lit("")), F.coalesce(path, F.lit(""))


def candidate_keys(host: Column, path: Column, path_lengths: list[int]) -> Column:
    """Keys that a fitting rule must be, longest first, a longer host first among equals."""
    labels = F.split(host, r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    keys = F.flatten(F.transform(suffixes, lambda s: F.filter(
        F.transform(F.array(*[F.lit(n) for n in path_lengths]), lambda n: F.when(F.length(path) >= n, F.struct((-F.length(s) - n).alias("size"), (-F.length(s)).alias("host"), F.concat(s, F.substr(path, F.lit(1), n)).alias("key")))),
        lambda k: k.isNotNull(),
    )))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.transform(F.sort_array(keys), lambda k: k["key"]))


def _positions(h: np.ndarray, bits: int, hashes: int, level: int) -> np.ndarray:
    """Places of each key in a level's filter, from two halves of its 64-bit hash mixed with the level."""
    x = (h.astype(np.uint64) ^ np.uint64(level * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    a, b = x >> np.uint64(32), (x & np.uint64(0xFFFFFFFF)) | np.uint64(1)
    return (a[:, None] + np.arange(hashes, dtype=np.uint64) * b[:, None]) % np.uint64(bits)


@dataclass
class Level:
    bits: int
    hashes: int
    number: int
    filter: np.ndarray

    def passes(self, h: np.ndarray) -> np.ndarray:
        at = _positions(h, self.bits, self.hashes, self.number).astype(np.int64)
        return ((self.filter[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=1)


def level_size(n: int) -> tuple[int, int]:
    bits = max(64, math.ceil(-n * math.log(RATE) / math.log(2) ** 2))
    return bits, max(1, round(bits / max(n, 1) * math.log(2)) if n else 1)


def build_level(keys: DataFrame, n: int, number: int) -> Level:
    """One level over n distinct hashes ``h``. Executors set bits of 64 kbit pieces; pieces of one place are joined by OR."""
    bits, hashes = level_size(n)
    hashes = min(hashes, 16)

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            at = np.unique(_positions(batch["h"].to_numpy(dtype=np.int64), bits, hashes, number)).astype(np.int64)
            yield pd.DataFrame({"word": at >> 5, "value": (np.int64(1) << (at & 31))})

    rows = keys.select("h").mapInPandas(words, "word long, value long").groupBy("word").agg(F.bit_or("value").alias("value")).toPandas()  # at most MAX_FILTER_BYTES / 4 rows
    packed = np.zeros(-(-bits // 32), dtype="<u4")
    packed[rows["word"].to_numpy(dtype=np.int64)] = rows["value"].to_numpy(dtype=np.int64).astype(np.uint32)
    return Level(bits, hashes, number, packed.view(np.uint8).copy())


class Cascade:
    def __init__(self, levels: list[Level], seed: int):
        self.levels, self.seed = levels, seed

    def listed(self, h: np.ndarray) -> np.ndarray:
        """Whether keys (by hash) are listed: exact for every key of the universe."""
        out = np.zeros(len(h), dtype=bool)
        live = np.arange(len(h))
        for level in self.levels:
            # what passes an odd level counts as listed until a later level lets it through or not
            passed = level.passes(h[live]) if len(live) else np.zeros(0, dtype=bool)
            live = live[passed]
            out[live] = level.number % 2 == 1
            if not len(live):
                break
        return out


def key_hash(key: Column, seed: int) -> Column:
    return F.xxhash64(key, F.lit(seed))


def _hashes(keys: str, seed: int) -> Column:
    return F.transform(keys, lambda key: key_hash(key, seed))


def build_cascade(listed: DataFrame, universe: DataFrame) -> Cascade | None:
    """Cascade of ``listed`` keys over the keys of ``universe`` (both with a column ``key``); None if the list is too long.

    The universe is read once, against level 1; only keys that pass it are made distinct and go on, so what is
    shuffled is a small share of the universe. If a listed key shares its hash with another key, the next seed is used.
    """
    listed = saved(listed.select("key").where(F.col("key").isNotNull()).distinct(), "listed")
    n = listed.count()
    if level_size(n)[0] > 8 * MAX_FILTER_BYTES:
        return None
    for seed in range(100):
        positive = listed.select(key_hash(F.col("key"), seed).alias("h")).distinct()
        levels = [build_level(positive, n, 1)]
        negative = saved(_passing(universe, levels[0], seed).join(listed, "key", "left_anti"), "passed")
        clash = negative.select(key_hash(F.col("key"), seed).alias("h")).join(positive, "h", "left_semi").limit(1).count()
        if not clash:
            break
    negative = negative.select(key_hash(F.col("key"), seed).alias("h")).distinct()
    inside, outside = positive, negative  # of the level just built: encoded, and let through wrongly
    while True:
        wrong = outside.count()
        if not wrong:
            return Cascade(levels, seed)
        levels.append(build_level(outside, wrong, len(levels) + 1))
        inside, outside = outside, saved(_passing_hashes(inside, levels[-1]), "passed")


def _passing(universe: DataFrame, level: Level, seed: int) -> DataFrame:
    def passing(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.loc[level.passes(batch["h"].to_numpy(dtype=np.int64)), ["key"]].drop_duplicates()

    return universe.select("key", key_hash(F.col("key"), seed).alias("h")).mapInPandas(passing, "key string").distinct()


def _passing_hashes(keys: DataFrame, level: Level) -> DataFrame:
    def passing(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[level.passes(batch["h"].to_numpy(dtype=np.int64))]

    return keys.select("h").mapInPandas(passing, "h long")


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", url: str = "url") -> DataFrame:
    """Add host, path, rule and verdict by the longest fitting rule.

    ``rules`` has host, path and verdict (``allow`` or ``block``). Two cascades hold the keys of allowing and of
    blocking rules. The first candidate key of a url that one of them lists is its rule; a key listed by both blocks.
    Without a rule the verdict is ``default``: no list names the url. NULL urls and urls without ``://`` have no host
    and so no rule. Columns of the input with the names of results are replaced.
    """
    known = rules.where("host is not null and path is not null").select(F.concat("host", "path").alias("key"), F.length("path").alias("_n"), "verdict")
    lengths = sorted(r["_n"] for r in known.select("_n").distinct().collect())
    host, path = host_and_path(F.col(url))
    base = pages.drop("host", "path", "rule", "verdict").withColumn("host", host).withColumn("path", path)
    if not lengths:
        return base.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    keyed = base.withColumn("_keys", candidate_keys(F.col("host"), F.col("path"), lengths))
    universe = keyed.select(F.explode_outer("_keys").alias("key")).where("key is not null")
    cascades = {v: build_cascade(known.where(F.col("verdict") == v), universe) for v in ("block", "allow")}
    if None in cascades.values():
        return _judge_by_join(keyed, known, default)
    block, allow = cascades["block"], cascades["allow"]

    def first(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for for_block, for_allow in batches:
            size = for_block.map(len).to_numpy()
            start = np.cumsum(size) - size
            yield _first_listed(size, start, *(c.listed(np.concatenate([np.asarray(x, dtype=np.int64) for x in s] or [np.zeros(0, dtype=np.int64)])) for c, s in ((block, for_block), (allow, for_allow))))

    found = F.pandas_udf(first, "at int, verdict string")
    judged = keyed.withColumn("_found", found(_hashes("_keys", block.seed), _hashes("_keys", allow.seed)))
    return judged.withColumns({"rule": F.get("_keys", F.col("_found.at")), "verdict": F.coalesce("_found.verdict", F.lit(default))}).drop("_keys", "_found")


def _first_listed(size: np.ndarray, start: np.ndarray, blocked: np.ndarray, allowed: np.ndarray) -> pd.DataFrame:
    row = np.repeat(np.arange(len(size)), size)
    hit = np.flatnonzero(blocked | allowed)
    rows, pick = np.unique(row[hit], return_index=True)
    at, verdict = np.full(len(size), None, dtype=object), np.full(len(size), None, dtype=object)
    at[rows] = hit[pick] - start[rows]
    verdict[rows] = np.where(blocked[hit[pick]], "block", "allow")
    return pd.DataFrame({"at": pd.array(at, dtype="Int32"), "verdict": verdict})


def _judge_by_join(keyed: DataFrame, known: DataFrame, default: str) -> DataFrame:
    """The exact way for lists beyond the filter bound: candidate keys meet the rules in an equi-join."""
    rows = saved(keyed.withColumn("_row", F.monotonically_increasing_id()), "urls")
    rule = known.groupBy("key").agg(F.max("verdict").alias("verdict"))
    hits = rows.select("_row", F.posexplode("_keys").alias("_at", "key")).join(rule, "key").groupBy("_row").agg(F.min(F.struct("_at", "key", "verdict")).alias("_hit"))
    out = rows.join(hits, "_row", "left")
    return out.withColumns({"rule": F.col("_hit.key"), "verdict": F.coalesce("_hit.verdict", F.lit(default))}).drop("_row", "_hit", "_keys")
