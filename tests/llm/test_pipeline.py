"""The pipeline's stages, each against its own input."""

from __future__ import annotations

import duckdb
from pyspark.sql import functions as F

import __spark_entry__ as driver
import corpus_pipeline
from runlens.llm import decontam, simhash
from test_native import shingles
from test_text import plain_components, plain_fingerprint


def test_stages_keep_the_columns_and_take_effect(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{k}")
        seen[name] = docs, spark.read.parquet(f"{tmp_path}/{k}")
        docs = seen[name][1]
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    before, after = seen["near_duplicates"]
    groups = simhash.simhash_components(before).agg(F.countDistinct("component")).first()[0]
    assert after.count() == groups == after.select("doc_id").distinct().count() and simhash.links(simhash.fingerprints(after)).count() == 0
    before, after = seen["decontamination"]
    benchmark = spark.read.parquet(f"{sf}/benchmark.parquet")
    dirty = {r["doc_id"] for r in decontam.contained(before, benchmark).collect()}
    assert dirty and {r["doc_id"] for r in after.collect()} == {r["doc_id"] for r in before.collect()} - dirty
    before, after = seen["mixing"]
    assert after.groupBy("doc_id").count().agg(F.max("count")).first()[0] == 2
    assert {r["doc_id"] for r in after.collect()} <= {r["doc_id"] for r in before.collect()}
    before, after = seen["sharding"]
    assert after.count() == before.count() and after.select("shard", "slot").distinct().count() == after.count()
    assert after.groupBy("text").agg(F.countDistinct("shard").alias("n")).agg(F.max("n")).first()[0] == 1


def test_stages_take_empty_and_odd_rows(spark, sf, tmp_path):
    odd = [(None, None, None, None, None), (1, "", "en", "a", 0), (1, "", "en", "a", 0), (2, None, None, None, None), (3, "word " * 50_000, "en", "a", 1), (3, "other text here", "fr", None, 2), (None, "no id", "en", "b", 3)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for rows in (odd, []):
        docs = spark.createDataFrame(rows, schema).withColumns({"_hash": F.lit(1), "score": F.lit(2)})
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, sf)
            out.write.parquet(f"{tmp_path}/{len(rows)}-{k}")
            docs = spark.read.parquet(f"{tmp_path}/{len(rows)}-{k}")
            assert (docs.count() > 0) == bool(rows), name
            assert {"_hash", "score"} <= set(docs.columns)


def plain_representatives(docs):
    """Ids of the documents that stay: the least id of each group whose fingerprints lie within four bits of a neighbour."""
    prints = {d: plain_fingerprint(t) for d, t in docs}
    nodes = sorted(set(prints.values()))
    at = plain_components(range(len(nodes)), lambda i, j: (nodes[i] ^ nodes[j]).bit_count() <= 4)
    group = {p: at[i] for i, p in enumerate(nodes)}
    least = {}
    for d in sorted(prints):
        least.setdefault(group[prints[d]], d)
    return set(least.values())


def plain_dirty(docs, items):
    """Ids of the documents that hold at least 0.8 of an item's shingles."""
    return {d for d, t in docs for i in items if i and 10 * len(shingles(t) & i) >= 8 * len(i)}


def test_run_against_plain_python(spark, sf, tmp_path, monkeypatch):
    """The whole pipeline on the smallest table with planted cases; each stage against its own input."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    items = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    clean = [r for d, r in sorted(rows.items()) if labels.get(d) == 0 and r["n_chars"] > 2000]
    plant = lambda d, text, like: (d, text, like["lang"], like["source"], len(text))
    copies = [plant(10_001, clean[0]["text"], clean[0]), plant(10_002, clean[1]["text"].replace(clean[1]["text"].split()[40], "otherword", 1), clean[1])]
    leaked = [plant(10_003, f"{clean[2]['text'][:900]} {items[0]} {clean[2]['text'][900:1500]}", clean[2])]
    docs.unionByName(spark.createDataFrame(copies + leaked, docs.schema)).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{sf}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    seen = []
    keep = corpus_pipeline.saved
    monkeypatch.setattr(corpus_pipeline, "saved", lambda df, name: seen.append(keep(df, name)) or seen[-1])
    out = corpus_pipeline.run(spark, str(tmp_path))
    texts = [{r["doc_id"]: r["text"] for r in t.select("doc_id", "text").collect()} for t in (spark.read.parquet(f"{tmp_path}/documents.parquet"), *seen)]
    gone = set(texts[0]) - set(texts[1])
    judged = [d for d in texts[0] if d in labels]
    assert sum((labels[d] == 1) == (d in gone) for d in judged) >= 0.95 * len(judged) and not gone & {10_001, 10_002, 10_003}
    assert set(texts[2]) == plain_representatives(texts[1].items()) and not set(texts[2]) & {10_001, 10_002}
    wanted = [shingles(t) for t in items]
    assert set(texts[3]) == set(texts[2]) - plain_dirty(texts[2].items(), wanted) and 10_003 in set(texts[2]) - set(texts[3])
    assert set(texts[4]) <= set(texts[3]) and all(texts[3][d] == t for d, t in texts[4].items())
    assert out.count() == seen[3].count() and set(texts[5]) == set(texts[4])
    assert {r["shard"] for r in out.select("shard").distinct().collect()} <= set(range(16))


def test_queries_without_sql_are_known():
    missing = {n for n in driver.queries() if n.startswith("op") or n == "pipeline"} - set(driver.oracle_sql())
    assert missing == {"op2_toxicity", "op3_langid", "op6_embeddings", "op7_shards", "op9_mixing", "op10_simhash", "op11_pii", "op12_whitening", "op13_vector_codes", "pipeline"}


def test_sql_runs_on_empty_tables(sf):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "conversations"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet' where false")
    for name, sql in driver.oracle_sql().items():
        if name.startswith("op"):
            assert len(con.execute(sql).fetchall()) == (1 if name == "op1_chat" else 0)
