"""Personal data: base spans against the plain patterns, added spans on planted cases, the label model on known truth."""

from __future__ import annotations

import hashlib
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from runlens.llm import catalog, pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_base(text):
    out = []
    for k, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            keep = {
                "email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")),
                "card": 16 <= len(digits) <= 19 and sum(sum(map(int, str(int(c) * (1 + i % 2)))) for i, c in enumerate(reversed(digits))) % 10 == 0,
                "phone": 8 <= len(digits) <= 15,
            }[kind]
            out += [(k, *m.span())] if keep else []
    return out


@settings(max_examples=600, deadline=None)
@given(st.one_of(st.text("ab1.@-+ é", max_size=40), st.text("0123456789.+-() \n", max_size=60), st.lists(st.sampled_from(["4111 1111 1111 1111", "+1 (202) 555-0123", "10.0.0.1", "300.1.2.3", "a@b.c", "@", ".", " ", "-", "7", "+", "x"]), max_size=9).map("".join)))
def test_base_spans_are_those_of_the_plain_patterns(text):
    assert pii.base_spans(text) == plain_base(text)


@settings(max_examples=300, deadline=None)
@given(st.text("aAt@0123456789.+-() \n[]{}dotéİ:＠", max_size=60))
def test_any_text_has_sound_candidates(text):
    for c in pii.candidates(text):
        kind, votes, _ = pii.unpack(pii.pattern_of(text, c))
        assert 0 <= c[1] < c[2] <= len(text) and kind == c[0] and tuple(votes - 1) == c[3]


TEXTS = [
    ("mail me: jo.smith@mail3.example.com!", {"email": ["jo.smith@mail3.example.com"]}),
    ("write to jo [at] example [dot] com or al at example dot org", {"email": ["jo [at] example [dot] com", "al at example dot org"]}),
    ("see +1 (202) 555-0123 4539148803436467 now", {"phone": ["+1 (202) 555-0123"], "card": ["4539148803436467"]}),
    ("seen +1 (202) 555-0123 190.137.223.204 here", {"phone": ["+1 (202) 555-0123"], "ip": ["190.137.223.204"]}),
    ("pay 4539.1488.0343.6467 or 4539 1488 0343 6467 4716 1234 5678 9012", {"card": ["4539.1488.0343.6467", "4539 1488 0343 6467", "4716 1234 5678 9012"]}),
    ("host 192[.]168[.]1[.]7 and 2001:db8::ff00:42:8329", {"ip": ["192[.]168[.]1[.]7", "2001:db8::ff00:42:8329"]}),
    ("call 0049 30 1234567 or (314) 555-6532", {"phone": ["0049 30 1234567", "(314) 555-6532"]}),
    ("+1 (314)\n555-6532", {"phone": ["+1 (314)\n555-6532"]}),
    ("meet me at example.com, item 1. 2. 3. 4. of it at home. It", {}),
    ("id 1234567890123456 and 2024-01-02 10:20:30, isbn 9783161484100, foo @ bar. Then", {}),
    ('token = "1dbdfc8c8e65b434924454049ac802522025d556" a1234567890123456b', {}),
    ("", {}), (None, {}),
]


def found_of(rows):
    return [{k: [r["text"][s["start"] : s["end"]] for s in r["spans"] if s["kind"] == k] for k in pii.KINDS if any(s["kind"] == k for s in r["spans"])} for r in rows]


def test_planted_spans_are_found_and_clean_texts_left_alone(frame):
    rows = [(i, t, "own") for i, (t, _) in enumerate(TEXTS)] + [(0, TEXTS[0][0], "own"), (None, None, None)]
    got = pii.personal_data(frame(rows, "doc_id long, text string, _found string").withColumn("Spans", F.lit("own"))).orderBy(F.col("doc_id").asc_nulls_last()).collect()
    assert got[0].asDict().keys() == {"doc_id", "text", "_found", "spans"} and len(got) == len(rows)
    assert found_of(got) == [{k: wanted[k] for k in pii.KINDS if k in wanted} for _, wanted in [TEXTS[0], *TEXTS, (None, {})]]
    assert all(not s["base"] or s["score"] == 1 for r in got for s in r["spans"])


def test_redaction_masks_every_span(frame):
    rows = [(i, t) for i, (t, _) in enumerate(TEXTS)]
    got = {r["doc_id"]: r["redacted"] for r in pii.redact(pii.personal_data(frame(rows, "doc_id long, text string"))).collect()}
    assert got[2] == "see [PHONE] [CARD] now" and got[1] == "write to [EMAIL] or [EMAIL]" and got[8] == TEXTS[8][0] and got[12] is None


def test_empty_tables_and_long_runs(frame):
    assert pii.personal_data(frame([], "doc_id long, text string")).count() == 0
    long = ["1" * 300_000, "a" * 300_000, "1 2 " * 80_000, "+1" + " " * 200_000, "a@" * 100_000, "1." * 150_000, "at " * 100_000]
    got = pii.personal_data(frame([(i, t) for i, t in enumerate(long)], "doc_id long, text string")).collect()
    assert [[s["kind"] for s in r["spans"] if s["kind"] != "ip"] for r in got] == [[]] * len(long)


def test_reliabilities_find_the_better_labelers():
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.4
    right = np.array([0.95, 0.9, 0.85, 0.8, 0.7, 0.55, 0.5])
    votes = np.where(rng.random((4000, 7)) < right, truth[:, None], ~truth[:, None]) * 2
    votes[rng.random((4000, 7)) < 0.2] = 1
    rows, count = np.unique(votes, axis=0, return_counts=True)
    table, true = pii.reliabilities(rows, count.astype(float))
    assert np.abs(table[:, 1, 2] / (table[:, 1, 0] + table[:, 1, 2]) - right).max() < 0.06
    chance = {tuple(r): t for r, t in zip(rows, true)}
    assert np.mean([(chance[tuple(v)] >= 0.5) == t for v, t in zip(votes, truth)]) > 0.95
    model = pii.fit([(pii.CARD * 3**7 * 8 + int("".join(map(str, r)), 3) * 8, int(n)) for r, n in zip(rows, count)])
    scores = {tuple(r): model.score(pii.CARD * 3**7 * 8 + int("".join(map(str, r)), 3) * 8) for r in rows}
    assert np.mean([(scores[tuple(v)] >= 0.5) == t for v, t in zip(votes, truth)]) > 0.95


def test_query_columns_follow_from_the_spans(spark, sf, documents):
    got = {r["doc_id"]: r for r in catalog.QUERIES["op11_pii"](spark, sf).collect()}
    assert len(got) == len(documents)
    for i, text, *_ in documents:
        base = plain_base(text or "")
        line = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in base)
        assert got[i]["base_sha256"] == hashlib.sha256(line.encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [sum(b[0] == n for b in base) for n in range(4)]
        spans = [x.split(":") for x in got[i]["spans"].split(",") if x]
        assert {tuple(x) for x in map(tuple, spans)} >= {(pii.KINDS[k], str(s), str(e)) for k, s, e in base}
        assert spans == sorted(spans, key=lambda x: (pii.KINDS.index(x[0]), int(x[1])))
