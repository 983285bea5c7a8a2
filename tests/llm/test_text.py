"""SimHash, line dedup, toxicity and language ID against plain Python and held-out rows."""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from runlens.llm import catalog, components, langid, linededup, simhash, toxicity
from runlens.llm.common import fold_of

DOC = "doc_id long, text string"


def plain_fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(nodes, linked):
    nodes = sorted(nodes)
    label = {n: n for n in nodes}

    def find(n):
        while label[n] != n:
            n = label[n]
        return n

    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            if linked(a, b):
                x, y = find(a), find(b)
                label[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_fingerprints(frame):
    texts = ["", None, "one", "One two", "a b c d", "A b  c\td\ne", "é ß Ä x " * 40, "x " * 5000, "\xa0 no break", "rep rep rep rep rep"]
    got = simhash.fingerprints(frame(list(enumerate(texts)), DOC)).collect()
    assert [r["fp"] % 2**64 for r in got] == [plain_fingerprint(t) for t in texts]


def test_simhash_groups(spark, frame):
    rnd = random.Random(3)
    base = [rnd.choice("abcdefgh") * rnd.randint(1, 5) for _ in range(400)]
    docs = [(100 + i, " ".join(base[:k] + ["new"] + base[k + 1 :])) for i, k in enumerate(range(0, 400, 7))]
    docs += [(i, " ".join(rnd.choice("ijklmnop") * rnd.randint(1, 4) for _ in range(60))) for i in range(40)]
    docs += [(900, ""), (901, None), (902, "  "), (903, " ".join(base)), (903, " ".join(base)), (None, docs[60][1]), (None, "alone in the world today")]
    df = frame(docs, DOC).withColumns({"fp": F.lit("own"), "component": F.lit(1)})
    prints = {plain_fingerprint(t) for _, t in docs}
    label = plain_components(prints, lambda a, b: (a ^ b).bit_count() <= 4)
    least = {}
    for d, t in docs:
        at = label[plain_fingerprint(t)]
        least[at] = min((x for x in (least.get(at), d) if x is not None), default=None)
    for r in simhash.simhash_components(df).collect():
        assert r["component_id"] == least[label[r["fp"] % 2**64]]
    kept = simhash.representatives(df)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted(least.values(), key=str)
    assert simhash.simhash_components(frame([], DOC)).count() == 0 and simhash.representatives(frame([], DOC)).count() == 0


def test_posting_lists_of_any_size(spark):
    rnd = np.random.default_rng(5)
    centre = int(rnd.integers(1 << 62))
    dense = [centre ^ sum(1 << int(b) for b in rnd.choice(64, int(rnd.integers(0, 4)), replace=False)) for _ in range(300)]
    far = [int(x) for x in rnd.integers(-(1 << 62), 1 << 62, 200)]
    same_bytes = [(centre & 0xFFFFFFFF) | (int(x) << 32) for x in rnd.integers(0, 1 << 30, 100)]
    fps = sorted({x - (1 << 64) if x >= 1 << 63 else x for x in dense + far + same_bytes})
    want = plain_components(fps, lambda a, b: ((a ^ b) % 2**64).bit_count() <= 4)
    got = {r["node"]: r["component"] for r in components.components(simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"))).collect()}
    assert {n: got.get(n, n) for n in fps} == want


def test_components_of_odd_graphs(spark):
    chain = [(i, i + 1) for i in range(60)]
    star = [(1000, 1000 + i) for i in range(1, 50)]
    rows = chain + star + [(5, 5), (None, 3), (2000, 1999), (1999, 2000)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {1000 + i: 1000 for i in range(50)} | {1999: 1999, 2000: 1999}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_dedup(docs, size=40):
    """Per document the words that an earlier one's paragraph covers, as spans of whole words with the space before them."""
    pieces = {(d, t): re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+", t or "") for d, t in docs}

    def starts(p):
        w = [x.strip(" \t\n\v\f\r").lower() for x in p]
        return {i: " ".join(w[i : i + size]) for i in range(len(w) - size + 1) if i == 0 or (ord(w[i - 1][0]) + 3 * ord(w[i - 1][-1]) + len(w[i - 1])) % 4 == 0}

    first = {}
    for (d, _), p in pieces.items():
        for s in starts(p).values():
            first[s] = min(first.get(s, (True, 0)), (d is None, d or 0))
    out = {}
    for (d, t), p in pieces.items():
        gone = {i: s for i, s in starts(p).items() if first[s] < (d is None, d or 0)}
        cover = {j for i in gone for j in range(i, i + size)}
        spans, kept, at = [], [], 0
        for j, piece in enumerate(p):
            if j in cover and j - 1 in cover:
                spans[-1] = (spans[-1][0], spans[-1][1] + len(piece))
            elif j in cover:
                spans.append((at, len(piece)))
            else:
                kept.append(piece)
            at += len(piece)
        out[d, t] = None if t is None else "".join(kept) + t[at:], spans, sorted({first[s][1] for s in gone.values()})
    return out


def test_paragraph_dedup(frame, documents, monkeypatch):
    rnd = random.Random(5)
    word = lambda: rnd.choice("abcdefghé😀") * rnd.randint(1, 3) + rnd.choice("ijklmn") * rnd.randint(1, 6)
    many = lambda n: [word() for _ in range(n)]
    passage = many(70)
    spread = lambda w: "".join(x.upper() + rnd.choice([" ", "\n", " \t ", "\n\n"]) for x in w)
    docs = [(d, t) for d, t, _, _ in documents]
    docs += [(7000 + i, f"{' '.join(many(30))} {spread(passage)}{' '.join(many(20))}\n") for i in range(60)]
    docs += [(8000, None), (8001, ""), (8002, " \n "), (8003, spread(passage)), (None, spread(passage)), (None, f"x {spread(passage)}"), (8004, "same " * 100), (8005, "Same " * 90)]
    docs += [(8006, " ".join(many(39))), (8007, " ".join(many(39)))] + [(8008, "two rows " * 60), (8008, "two rows " * 60), (8009, " ".join(passage)), (8009, "other text of this id")]
    df = frame(docs, DOC).withColumns({"gone": F.lit(1), "removed": F.lit("x"), "_version": F.lit(2), "_cut": F.lit(3), "h1": F.lit(4)})
    want = plain_dedup(docs)
    for share in (linededup.HOT_SHARE, 0.01):
        monkeypatch.setattr(linededup, "HOT_SHARE", share)
        rows = linededup.dedup_paragraphs(df).collect()
        assert len(rows) == len(docs) and set(rows[0].asDict()) == {"doc_id", "text", "gone", "_version", "_cut", "h1", "clean_text", "removed", "kept_doc_ids"}
        for r in rows:
            spans = [(s["start"], s["length"]) for s in r["removed"] or []]
            assert (r["clean_text"], spans, r["kept_doc_ids"]) == want[r["doc_id"], r["text"]] and (r["gone"], r["_version"], r["_cut"], r["h1"]) == (1, 2, 3, 4)
    left = {r["doc_id"]: r["clean_text"] for r in rows}
    assert all(len(left[7000 + i].split()) < 70 for i in range(1, 60)) and len(left[7000].split()) == 120
    assert linededup.dedup_paragraphs(frame([], DOC)).count() == 0


def plain_every(docs, size=40):
    """As ``plain_dedup``, of the paragraphs that begin at every word: words that go, and who keeps them."""
    first, out = {}, {}
    words = {(d, t): re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()) for d, t in docs}
    held = {key: [tuple(w[i : i + size]) for i in range(len(w) - size + 1)] for key, w in words.items()}
    for (d, _), all_of in held.items():
        for s in all_of:
            first[s] = min(first.get(s, (True, 0)), (d is None, d or 0))
    for (d, t), all_of in held.items():
        gone = {i: first[s][1] for i, s in enumerate(all_of) if first[s] < (d is None, d or 0)}
        cover = {j for i in gone for j in range(i, i + size)}
        kept = [w for j, w in enumerate(words[d, t]) if j not in cover]
        out[d, t] = kept, sum(1 for j in cover if j - 1 not in cover), sorted(set(gone.values()))
    return out


def check_every(rows, docs, size):
    want = plain_every(docs, size)
    assert len(rows) == len(docs)
    for r in rows:
        kept, spans, ids = want[r["doc_id"], r["text"]]
        assert (re.findall(r"[^\x20\x09-\x0D]+", (r["clean_text"] or "").lower()), len(r["removed"] or []), r["kept_doc_ids"]) == (kept, spans, ids)
        assert r["text"] is None or len(r["text"]) == len(r["clean_text"]) + sum(s["length"] for s in r["removed"] or [])


def test_every_paragraph_of_forty_words_is_met(frame, documents, monkeypatch):
    rnd = random.Random(8)
    many = lambda n: [rnd.choice("abcdefghé😀") * rnd.randint(1, 3) + rnd.choice("ijklmn") * rnd.randint(1, 6) for _ in range(n)]
    docs = [(d, t) for d, t, _, _ in documents]
    for i in range(60):  # passages of 40 words and a few more, wherever they begin
        passage = many(40 + i % 3)
        docs += [(5000 + i, " ".join(many(i) + passage + many(9))), (6000 + i, " ".join(many(13) + [w.upper() for w in passage] + many(i)))]
    base = many(400)
    docs += [(7000 + i, " ".join(base[:k] + ["new"] * (i % 2) + base[k + 1 :])) for i, k in enumerate(range(0, 400, 13))]
    copy = " ".join(base[100:200])
    docs += [(100, copy), (9000, copy), (9001, copy), (9001, copy), (9001, "x " + copy), (None, copy), (None, copy), (None, "y " + copy), (None, " ".join(many(50)))]
    docs += [(9100, None), (9101, ""), (9102, " \n "), (9103, " ".join(many(39))), (9104, "same " * 300), (9105, "Same " * 90), (9106, "one two " * 200), (9107, "two one " * 90 + "three")]
    df = frame(docs, DOC).repartition(3)
    for share in (linededup.HOT_SHARE, 0.01, 1.0):
        monkeypatch.setattr(linededup, "HOT_SHARE", share)
        rows = linededup.dedup_paragraphs(df, every=True).collect()
        check_every(rows, docs, 40)
    assert all(r["removed"] for r in rows if 6000 <= (r["doc_id"] or 0) < 6060)
    assert linededup.dedup_paragraphs(frame([], DOC), every=True).count() == 0


@pytest.mark.parametrize("size", [1, 2, 7])
def test_every_paragraph_of_few_words(frame, size):
    rnd = random.Random(size)
    docs = [(rnd.choice([None, *range(40)]), " ".join(rnd.choice("abc" if i % 2 else "abcdefghijklmnopqrst") for _ in range(rnd.randint(0, 40)))) for i in range(60)]
    check_every(linededup.dedup_paragraphs(frame(docs, DOC), size=size, every=True).collect(), docs, size)


def test_stretches_do_not_depend_on_chunks(monkeypatch):
    rnd = np.random.default_rng(3)
    words = [rnd.integers(0, 9, n).tolist() for n in (40, 41, 500, 60, 45)]
    batch = pa.RecordBatch.from_pydict({"doc_id": [5, None, 6, 7, 8], "version": [1, 2, 3, 4, 5], "words": pa.array(words, pa.list_(pa.int64()))})
    names = ["doc_id", "version", "low", "length", "anchor", "reading"]
    got = []
    for chunk in (1, 100, 1 << 20):
        monkeypatch.setattr(linededup, "CHUNK", chunk)
        got.append([r for b in linededup._find_stretches(40, names)([batch.slice(0, 2), batch.slice(2)]) for r in b.to_pylist()])
    assert got[0] == got[1] == got[2]
    assert [sum(r["length"] for r in got[0] if r["version"] == v) for v in range(1, 6)] == [len(w) - 39 for w in words]


INSULTS = ["blargh", "zorkface", "snivel", "grubber"]


@pytest.fixture(scope="module")
def trained(spark):
    rnd = random.Random(1)
    syllables = ["ta", "ne", "ro", "mi", "su", "la", "ke", "po", "vi", "do", "gru", "sni", "fa"]

    def sentence():
        return ["".join(rnd.choice(syllables) for _ in range(rnd.randint(1, 4))) for _ in range(rnd.randint(5, 40))]

    docs, labels = [], []
    for i in range(600):
        words = sentence()
        toxic = i % 4 == 0
        for _ in range(rnd.randint(2, 4) if toxic else 0):
            words.insert(rnd.randrange(len(words)), rnd.choice(INSULTS))
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs, labels = spark.createDataFrame(docs, DOC), spark.createDataFrame(labels + [(3, None), (5000, 1), (None, 1)], "doc_id long, toxic int")
    return toxicity.train(docs, labels), docs, labels


def test_toxic_documents_are_found(trained):
    model, docs, labels = trained
    rows = toxicity.score(docs, model).join(labels.where("toxic is not null"), "doc_id").where(fold_of("doc_id") == 0).collect()
    assert len(rows) > 80
    assert np.mean([(r["score"] >= 0.5) == bool(r["toxic"]) for r in rows]) > 0.97


def test_disguised_insults_score_higher(trained):
    model = trained[0]
    plain = model.margins(["tane romi sula kepo"])[0, 1]
    for text in ["b.l.a.r.g.h", "b l a r g h", "BLARGH", "zorkxface", "zorrkface", "tane z0rkface"]:
        assert model.margins([text])[0, 1] > plain + 0.5, text
    odd = model.probabilities(model.margins(["", None, "?!", "a", "x" * 3_000_000, ("ta ne " * 400_000) + "blargh zorkface", "tane blargh tane zorkface"]))
    assert (odd[:5] < 0.5).all() and (odd[5:] > 0.5).all()


def test_parts_do_not_change_a_score(trained, monkeypatch):
    model = trained[0]
    text = "tane romi blargh " * 200 + "zorkface"
    whole = model.margins([text, "la", text])
    monkeypatch.setattr(toxicity, "CHARS_AT_ONCE", 300)
    assert np.allclose(model.margins([text, "la", text]), whole)


def test_without_labels_nothing_is_toxic(spark, frame):
    docs = frame([(1, "some text"), (2, None)], DOC)
    for labels in ([], [(1, 0), (2, 0)], [(1, None)]):
        model = toxicity.train(docs, frame(labels, "doc_id long, toxic int"))
        assert all(r["score"] < 0.5 for r in toxicity.score(docs, model).collect())


def test_language_is_told(spark, documents):
    docs = spark.createDataFrame(documents, DOC + ", lang string, source string").withColumn("score", F.lit("own"))
    model = langid.train(docs)
    rows = langid.predict(docs, model).where(fold_of("doc_id") == 0).collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.95
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 34 !?"), (4, "é"), (5, "the and of with " * 100_000)], DOC)
    got = {r["doc_id"]: r for r in langid.predict(odd, model).collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and got[4]["lang_pred"] != "und" and got[5]["lang_pred"] == "en"
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_language_of_few_languages(spark):
    one = spark.createDataFrame([(i, "abc def", "xx") for i in range(20)], DOC + ", lang string")
    assert {r["lang_pred"] for r in langid.predict(one, langid.train(one)).collect()} == {"xx"}
    none = one.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in langid.predict(one, langid.train(none)).collect()} == {"und"}


@pytest.mark.parametrize("n", [2, 3, 5, 12, 40])
def test_codewords_correct_errors(n):
    codes = langid.codewords(n)
    distance = min((codes[i] != codes[j]).sum() for i in range(n) for j in range(i))
    assert distance >= (1 << max(0, n - 2) if n <= langid.EXHAUSTIVE else codes.shape[1] // 5)


def test_whole_queries_run(spark, sf):
    for name, columns in (("op2_toxicity", {"doc_id", "held_out", "score", "predicted"}), ("op3_langid", {"doc_id", "held_out", "lang_pred", "score", "ambiguous"})):
        out = catalog.QUERIES[name](spark, sf)
        assert set(out.columns) == columns and out.count() == 200
