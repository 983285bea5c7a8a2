"""Embedding links and URL rules against brute force."""

from __future__ import annotations

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from runlens.llm import embed_dedup, urlfilter

VEC = "vec_id long, embedding array<float>"


def plain_links(rows, threshold=0.95):
    good = [(i, np.array(v, dtype=np.float64)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, label = {i: 0 for i, _ in rows}, {i: i for i, _ in rows}
    hit = {}
    for a, (i, x) in enumerate(good):
        for j, y in good[:a]:
            if len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold:
                links[i] += 1
                links[j] += 1
                hit.setdefault(i, []).append(j)
                hit.setdefault(j, []).append(i)
    moved = True
    while moved:
        moved = False
        for i, others in hit.items():
            low = min([label[i], *(label[j] for j in others)])
            moved |= low < label[i]
            label[i] = low
    return links, label


def check(frame, rows):
    got = embed_dedup.link_vectors(frame(rows, VEC).withColumn("node", F.lit("own"))).collect()
    links, label = plain_links(rows)
    assert len(got) == len(rows)
    for r in got:
        assert (r["n_links"], r["component_id"], r["kept"]) == (links[r["vec_id"]], label[r["vec_id"]], r["vec_id"] is not None and label[r["vec_id"]] == r["vec_id"]), r


def test_links_are_all_found(frame, monkeypatch):
    rng = np.random.default_rng(2)
    v = [rng.normal(size=12) for _ in range(250)]
    v += [x + 0.1 * rng.normal(size=12) for x in v[:120]] + [x + 0.28 * rng.normal(size=12) for x in v[100:200]]
    dense = rng.normal(size=12)
    v += [dense + 0.05 * rng.normal(size=12) for _ in range(150)] + [dense + 0.3 * rng.normal(size=12) for _ in range(100)]
    rows = [(i, [float(np.float32(y)) for y in x]) for i, x in enumerate(v)]
    rows += [(2000 + i, rows[3][1]) for i in range(5)]
    for name, value in (("CELL_ROWS", 40), ("BLOCK", 64)):
        monkeypatch.setattr(embed_dedup, name, value)
    check(frame, rows)


def test_unsound_vectors_link_with_nothing(frame):
    nan, inf = float("nan"), float("inf")
    check(frame, [(1, None), (2, []), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [1.0, None]), (7, [1.0, 2.0]), (8, [2.0, 4.0]), (9, [1.0, 2.0, 0.0]), (10, [1e-30, 2e-30]), (11, [-1.0, -2.0])])
    got = embed_dedup.link_vectors(frame([(None, [1.0, 2.0]), (1, [1.0, 2.0]), (1, [1.0, 2.0])], VEC)).collect()
    assert sorted((r["vec_id"] or 0, r["n_links"], r["kept"]) for r in got) == [(0, 0, False), (1, 1, True), (1, 1, True)]
    assert embed_dedup.link_vectors(frame([], VEC)).count() == 0


def test_bound_reaches_all_partners():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(800, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    cells = embed_dedup.fit(x, 20, 0.9)
    home, visits = cells.assign(x)
    for i, j in np.argwhere(np.triu(x @ x.T >= 0.9, 1)):
        assert home[i] == home[j] or home[j] in visits[i] or home[i] in visits[j]


RULES = "host string, path string, verdict string"
URLS = [
    None, "", "no scheme", "http://", "http://A.COM", "http://a.com/", "https://x.A.com/en/page?q=1#f", "http://a.com/en", "http://a.com/EN/", "http://ba.com/en/", "http://a.com.", "http://.a.com/", "http://a.com?x=/en/",
    "ftp://u:p@a.com:80/x", "http://b.net/es/1", "http://b.net/de/", "x://y://a.com/", "http://É.com/en/", "http://a.com//en/", "http://..", "http://a.com/\nen/", "http://deep.er.sub.a.com/en/" + "z" * 5000,
]


def plain_judge(url, rules):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    raw = re.match(r"[^/?#]*", rest)[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in raw)
    path = re.match(r"[^?#]*", rest[len(raw) :])[0]
    fits = [(h + p, v) for h, p, v in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *max(fits, key=lambda f: len(f[0]))) if fits else (host, path, None, "allow")


@pytest.mark.parametrize("joined", [False, True])
def test_longest_rule_wins(frame, monkeypatch, joined):
    rules = [("com", "/", "allow"), ("a.com", "/en/", "block"), ("x.a.com", "/en/", "allow"), ("net", "/es/", "block"), ("a.com", "", "block"), ("nowhere.org", "/q", "block")]
    if joined:
        monkeypatch.setattr(urlfilter, "MAX_FILTER_BYTES", 0)
    pages = frame([(i, u) for i, u in enumerate(URLS * 2)], "page_id long, url string").withColumns({"host": F.lit("own"), "extra": F.lit(1)})
    rows = urlfilter.judge(pages, frame(rules + [(None, "/", "block")], RULES)).collect()
    assert len(rows) == 2 * len(URLS)
    for r in rows:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == plain_judge(r["url"], rules), r
    assert {r["verdict"] for r in urlfilter.judge(pages, frame([], RULES)).collect()} == {"allow"}
    assert urlfilter.judge(frame([], "page_id long, url string"), frame(rules, RULES)).count() == 0


def test_cascade_is_exact_over_the_universe(spark, monkeypatch):
    monkeypatch.setattr(urlfilter, "RATE", 0.3)  # many wrong keys, so that several levels are needed
    universe = spark.range(6000).selectExpr("concat('key', id) as key")
    cascade = urlfilter.build_cascade(universe.where("hash(key) % 7 = 0").union(spark.sql("select 'elsewhere'")), universe.union(universe))
    assert len(cascade.levels) > 3
    rows = universe.select("key", urlfilter.key_hash(F.col("key"), cascade.seed).alias("h"), F.expr("hash(key) % 7 = 0").alias("listed")).toPandas()
    assert (cascade.listed(rows["h"].to_numpy()) == rows["listed"].to_numpy()).all()
