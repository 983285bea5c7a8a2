"""Chat formatting, decontamination, sharding and mixing against plain Python."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import duckdb
from pyspark.sql import functions as F

from runlens.llm import catalog, chat, decontam, mixing, shards

EVENTS = "conv_id long, seq long, msg long, kind string, role string, text string"
DOCS = "doc_id long, text string, lang string, source string"


def test_events_fold_into_final_messages(frame):
    rows = [
        (1, 1, 0, "message", "user", "Hello"), (1, 2, 1, "message", "assistant", ""), (1, 3, 1, "delta", None, "Hi "), (1, 4, 1, "delta", None, "there"),
        (1, 5, 2, "message", "user", "more"), (1, 6, 3, "message", "assistant", "old"), (1, 7, 2, "edit", None, "less"),
        (1, 8, 3, "regenerate", None, None), (1, 9, 3, "delta", None, "new"),
        (2, 1, 0, "message", "user", "a"), (2, 2, 1, "message", "assistant", "b"), (2, 3, 2, "message", "user", "gone"), (2, 4, 1, "regenerate", None, None), (2, 5, 1, "delta", None, "c"),
        (None, None, 0, None, None, None),
    ]
    got = sorted((tuple(r) for r in chat.fold_events(frame(rows, EVENTS)).select("conv_id", "msg", "role", "text").collect()), key=str)
    assert got == sorted([
        (1, 0, "user", "Hello"), (1, 1, "assistant", "Hi there"), (1, 2, "user", "less"), (1, 3, "assistant", "new"),
        (2, 0, "user", "a"), (2, 1, "assistant", "c"), (None, 0, None, ""),
    ], key=str)


def test_template_is_reversible(frame):
    texts = ["", "<|im_end|>", "\\b<\\p|<|", "<", "|x", "a\nb", "<|im_start|>assistant\nx<|im_end|>\n", "é😀<" * 5, "\\", "x" * 100_000]
    roles = ["user", "assistant", "sys\ntem", "<|im_start|>", "", "assistant"]
    rows = [(c, m, roles[(c + m) % len(roles)], t) for c in range(3) for m, t in enumerate(texts)]
    out = chat.render(frame(rows, "conv_id long, msg long, role string, text string"))
    for r in out.select("*", chat.parse(F.col("formatted")).alias("turns"), chat.under_mask(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect():
        mine = [(role, text) for c, _, role, text in rows if c == r["conv_id"]]
        assert [tuple(t) for t in r["turns"]] == mine
        assert r["loss"] == "".join(t for role, t in mine if role == "assistant")


def test_chat_query_on_odd_rows(spark, frame, tmp_path):
    rows = [(5, 2, "assistant", "b"), (5, 1, "user", None), (5, 2, "assistant", "b"), (6, None, None, "x"), (None, 1, "user", "y")]
    frame(rows, "conv_id long, turn long, role string, text string").withColumn("msg", F.lit(1)).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: r for r in catalog.QUERIES["op1_chat"](spark, str(tmp_path)).collect()}
    assert set(got) == {5, 6, None, -1}
    assert got[5]["n_turns"] == 3 and got[5]["loss_chars"] == 2
    assert got[5]["turns_sha256"] == hashlib.sha256(b"user\n\nassistant\nb\nassistant\nb\n").hexdigest()
    assert got[-1]["loss_sha256"] == hashlib.sha256(catalog.HOSTILE.encode()).hexdigest()
    frame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/none/conversations.parquet")
    assert catalog.QUERIES["op1_chat"](spark, f"{tmp_path}/none").count() == 1


def shingles(text):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_containment_finds_every_pair(frame, documents):
    items = duckdb.sql("select item_id, text from '/root/testdata/sf0.001/benchmark.parquet'").fetchall() + [(900, None), (901, ""), (902, "two words"), (903, "w1 w2 w3 w4 w5")]
    cut = items[3][1].split()
    docs = [(d, t) for d, t, _, _ in documents] + [(None, items[0][1]), (-1, None), (-2, ""), (-3, "Two, words!"), (-4, "it has two words"), (-5, "x " * 3000 + items[1][1] + " y" * 3000), (-5, "again"),
        (-6, " ".join(cut[:-2] + ["other", "end"])), (-7, "w1 w2 w3 w4 w5 w6"), (-7, "w1 w2 w3 w4 w5 w6")]
    got = {(r["doc_id"], r["item_id"]): r["shared"] for r in decontam.contained(frame(docs, "doc_id long, text string").withColumn("h", F.lit(1)), frame(items, "item_id long, text string")).collect()}
    want = {}
    held = defaultdict(set)
    for d, t in docs:
        held[d] |= shingles(t)
    for i, t in items:
        s = shingles(t)
        for d, own in held.items():
            if s and len(s & own) * 10 >= 8 * len(s):
                want[d, i] = len(s & own)
    assert got == want and (-5, items[1][0]) in got and (-3, 902) in got and (-4, 902) not in got
    assert decontam.contained(frame([], "doc_id long, text string"), frame(items, "item_id long, text string")).count() == 0
    assert decontam.contained(frame(docs, "doc_id long, text string"), frame([], "item_id long, text string")).count() == 0


def best_capacity(sizes, n):
    low, high = 1, sum(sizes)

    def fits(c):
        left, used = 0, 0
        for s in sizes:
            if s > c:
                return False
            if s > left:
                used, left = used + 1, c
            left -= s
        return used <= n

    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if fits(mid) else (mid + 1, high)
    return low


def test_capacity_is_the_smallest(spark):
    # one group with a third of all bytes, many groups in one hash range, and even groups
    for expr in ("case when id = 700 then 40000 else 1 + id % 97 end", "1 + (id * id) % 1000"):
        for place in ("xxhash64(id)", "id * 1000003"):
            groups = spark.range(3000).selectExpr(f"{place} as h", f"cast({expr} as long) as size")
            ordered = [r["size"] for r in groups.orderBy("h").collect()]
            capacity, cuts = shards.capacity_and_cuts(groups, 16)
            assert capacity == best_capacity(ordered, 16)
            loads = groups.groupBy(shards.shard_of(F.col("h"), cuts)).agg(F.sum("size")).collect()
            assert len(loads) <= 16 and max(r[1] for r in loads) <= capacity


def test_shards_hold_whole_groups(frame, documents):
    docs = [(d, t, lang, s) for d, t, lang, s in documents] + [(None, "x", None, None), (7, None, "h", "shard"), (8, None, "h", "shard"), (8, "", None, None)] + [(5000 + i % 3, "copy", None, None) for i in range(90)]
    df = frame(docs, DOCS).withColumns({"h": F.lit("keep"), "shard": F.lit("own"), "_h": F.lit(2)})
    rows = shards.assign(df.drop("shard"), extra=["h", "_h", "text"]).collect()
    assert len(rows) == len(docs) and {r["h"] for r in rows} == {"keep"}
    of = defaultdict(set)
    for r in rows:
        of[r["text"]].add(r["shard"])
        assert r["size"] == len((r["text"] or "").encode()) + 1
    assert all(len(s) == 1 for s in of.values())
    for s in {r["shard"] for r in rows}:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    assert shards.assign(frame([], DOCS)).count() == 0
    assert {r["shard"] for r in shards.assign(frame([(1, "a", None, None)] * 3, DOCS)).collect()} <= set(range(16))


def plain_targets(sizes):
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s)))}
    total, fixed = 1.5 * sum(sizes.values()), {}
    while rest := {s: w for s, w in weight.items() if s not in fixed}:
        unit = (total - sum(fixed.values())) / sum(rest.values())
        above = {s: 2.0 * sizes[s] for s, w in rest.items() if unit * w > 2 * sizes[s]}
        if not above:
            return fixed | {s: unit * w for s, w in rest.items()}
        fixed |= above
    return fixed


def test_mix_meets_targets(frame, documents):
    docs = [(d, t, lang, s) for d, t, lang, s in documents] + [(9000 + i, "w " * (i % 30 + 1), "en", None) for i in range(60)] + [(9100, None, "en", "srcnull"), (9101, "", "en", "srcnull"), (None, "no id here", "en", "src1")]
    df = frame(docs, DOCS).withColumn("size", F.lit(-1))
    drawn, rows = mixing.mix(df)
    table = rows.collect()
    size = Counter()
    for r in table:
        size[r["source"]] += r["size"]
    goal = plain_targets(dict(size))
    taken, most, copies = Counter(), defaultdict(int), Counter()
    for r in drawn.collect():
        taken[r["source"]] += r["size"]
        copies[r["doc_id"], r["text_hash"]] += 1
        assert 0 <= r["shard"] < 16
    for r in table:
        most[r["source"]] = max(most[r["source"]], r["size"])
        assert abs(r["target"] - goal[r["source"]]) < 1e-6
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", dict((d, t) for d, t, _, _ in docs)[r["doc_id"]] or ""))
    assert max(copies.values()) <= 2
    assert all(abs(taken[s] - goal[s]) <= most[s] for s in goal)
    again, _ = mixing.mix(df)
    assert sorted(map(str, again.collect())) == sorted(map(str, drawn.collect()))
    assert mixing.mix(frame([], DOCS))[0].count() == 0


def test_mix_splits_blocks_evenly(spark):
    blocks = spark.range(1000).selectExpr("concat('s', id % 3) as source", "id as block", "1 as pass")
    shares = mixing._split(blocks, 4, 3).groupBy("shard").count().collect()
    assert len(shares) == 16 and {r["count"] for r in shares} <= {62, 63}


def test_mixed_documents_repeat_rows(frame):
    docs = frame([(i, f"text {i}", "en", "a" if i < 3 else "b") for i in range(40)] * 2, DOCS).withColumn("_shard", F.lit(1))
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    assert Counter(r["doc_id"] for r in out.collect()).most_common(1)[0][1] <= 2


def test_mixing_query_keeps_every_row(spark, frame, tmp_path):
    rows = [(1, "a b c", "en", "s1"), (1, "d e", "en", "s2"), (None, "x y z", "en", "s1"), (None, "z", "en", None), (2, None, "en", "s1"), (3, "", "en", "s2")]
    rows += [(4, "same row twice here", "en", "s2")] * 3 + [(10 + i, "word " * (i % 7 + 1), "en", ["s1", "s2", "s3", None][i % 4]) for i in range(200)]
    frame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    got = catalog.QUERIES["op9_mixing"](spark, str(tmp_path)).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted((r["doc_id"] or -1, r["size"]) for r in got) == sorted((d or -1, size(t)) for d, t, _, _ in rows)
    totals = Counter()
    for _, t, _, s in rows:
        totals[s] += size(t)
    assert Counter(r["source_size"] for r in got) == Counter(totals[s] for *_, s in rows)
    assert all(r["taken"] in (0, r["size"], 2 * r["size"]) and (r["size"] == 0 or (r["shard"] is None) == (r["taken"] == 0)) for r in got)
    of = {r["source_size"]: r["target"] for r in got}
    for s in totals:
        assert abs(sum(r["taken"] for r in got if r["source_size"] == totals[s]) - of[totals[s]]) <= 8
    drawn, _ = mixing.mix(frame(rows, DOCS))
    assert sum(r["taken"] for r in got) == drawn.agg(F.sum("size")).first()[0]
    frame([], DOCS).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert catalog.QUERIES["op9_mixing"](spark, f"{tmp_path}/none").count() == 0


def test_tree_shares_every_quota_exactly(frame, documents):
    """Blocks of each source over the shards: as many as its quota has, and as evenly as a draw without replacement."""
    taken, _ = mixing.plan(mixing_rows(frame, documents))
    blocks = taken.collect()
    per_shard = Counter(b["shard"] for b in blocks)
    assert set(per_shard) == set(range(16)) and max(per_shard.values()) - min(per_shard.values()) <= 1
    assert len({(b["source"], b["block"], b["pass"]) for b in blocks}) == len(blocks)


def mixing_rows(frame, documents):
    rows = [(d, i, s, len((t or "").split())) for i, (d, t, _, s) in enumerate(documents)]
    return frame(rows, "doc_id long, text_hash long, source string, size long")
