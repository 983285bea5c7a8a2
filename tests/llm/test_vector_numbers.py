"""Whitening and vector codes against plain numpy and whole-number Python."""

from __future__ import annotations

import hashlib
import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from runlens.llm import vectorcodes, whitening
from runlens.session import ship_package

VEC = "vec_id long, embedding array<float>, label int"


@pytest.fixture
def rows():
    rng = np.random.default_rng(4)
    base = rng.normal(size=(330, 10)) * np.linspace(0.05, 0.6, 10)
    out = [(i, [float(np.float32(c)) for c in v], None if i % 7 == 0 else i % 5) for i, v in enumerate(base)]
    out += [(400 + i, out[11][1], 1) for i in range(60)]
    out += [(None, out[3][1], 2), (401, out[401 - 400][1], 3)]
    return out


BAD = [(900, None, 1), (901, [], 1), (902, [float("nan")] * 10, 1), (903, [1.0] * 9 + [None], 1), (904, [float("inf")] + [0.0] * 9, 1), (905, [1.0, 2.0], 1)]


def whole(rows, add=0):
    return [[math.floor(1024 * c) + add for c in v] for _, v, _ in rows]


# -- whitening -------------------------------------------------------------------------------------------------------


def plain_covariance(x):
    n, sums = len(x), [sum(c) for c in zip(*x)]
    centred = [[Fraction(n * a - s) for a, s in zip(v, sums)] for v in x]
    return n, sums, np.array([[float(sum(a[i] * a[j] for a in centred) / n**3) for j in range(len(sums))] for i in range(len(sums))])


def test_whitened_rows_match_a_plain_eigensolver(frame, rows):
    got = whitening.whiten(frame(rows + BAD, VEC).withColumn("white", F.lit("own"))).collect()
    x = whole(rows, 100_000)
    n, sums, v = plain_covariance(x)
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1][:8], vectors[:, ::-1][:, :8]
    white = np.array([[a - s / n for a, s in zip(r, sums)] for r in x]) @ vectors / np.sqrt(values)
    assert len(got) == 8 * len(rows) and {r["n"] for r in got} == {len(rows)}
    deviations = sorted((-1 if i is None else i, sum((n * a - s) ** 2 for a, s in zip(r, sums))) for (i, _, _), r in zip(rows, x) for _ in range(8))
    assert sorted((-1 if r["vec_id"] is None else r["vec_id"], r["deviation"]) for r in got) == deviations
    one = {i: w for (i, _, _), w in zip(rows, white) if i not in (None, 401)}
    for k in range(1, 9):
        mine = {r["vec_id"]: r["whitened"] for r in got if r["component"] == k}
        sign = np.sign(sum(mine[i] * one[i][k - 1] for i in one))
        assert max(abs(mine[i] - sign * one[i][k - 1]) for i in one) < 1e-10
        assert [r["explained"] for r in got if r["component"] == k] == pytest.approx([values[k - 1] / np.trace(v)] * len(rows), rel=1e-12)
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-12


@pytest.mark.parametrize("values", [[3, 2, 1, 0.5, 0.2, 0.1], [5] * 3 + [4] * 9 + [1] * 6, [1.0] * 12, [2, 1, 0, 0], [1], [1e5, 1e5 - 1e-6, 3, 2, 1, 0.5, 0.1, 1e-3, 1e-4, 0]])
def test_eigenpairs_are_complete(spark, values):
    ship_package(spark)
    rng = np.random.default_rng(len(values))
    q = np.linalg.qr(rng.normal(size=(len(values), len(values))))[0]
    v = (q * np.array(values, dtype=float)) @ q.T
    v = (v + v.T) / 2
    e, u = whitening.leading_eigenpairs(spark, v, 8)
    wanted = [x for x in sorted(values, reverse=True)[:8] if x > 0]
    assert len(e) == len(wanted) and np.abs(e - wanted).max() < 1e-13 * max(values)
    assert np.abs(u.T @ u - np.eye(len(e))).max() < 1e-13 and np.abs(v @ u - u * e).max() < 1e-13 * max(values)


def test_counts_above_a_shift():
    v = np.random.default_rng(1).normal(size=(20, 20))
    v = v + v.T
    form, values = whitening.tridiagonal(v), np.linalg.eigvalsh(v)
    for s in (values[:-1] + values[1:]) / 2:
        assert whitening.count_above(form, s) == (values > s).sum()


def test_covariance_of_far_and_huge_components_is_exact(frame):
    rng = np.random.default_rng(2)
    for x in (rng.integers(-(1 << 29), 1 << 29, size=(40, 3)), (1 << 29) + rng.integers(0, 3, size=(50, 4)), rng.integers(-900, 900, size=(60, 5))):
        x = [[int(c) for c in r] for r in x]
        vectors = frame([([(c - 100_000) / 1024 for c in r],) for r in x] + [(None,), ([1.0],)], "v array<double>")
        assert np.array_equal(whitening.covariance(vectors, "v")[3], plain_covariance(x)[2])


def test_whitening_of_nothing_and_of_equal_rows(frame):
    for rows in ([], BAD[:4], [(1, [0.5, 0.25], 1)], [(i, [0.5, 0.25], 1) for i in range(5)]):
        out = whitening.whiten(frame(rows, VEC))
        assert out.count() == 0 and out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    line = whitening.whiten(frame([(i, [float(i), float(2 * i)], 1) for i in range(5)], VEC)).collect()
    assert {r["component"] for r in line} == {1} and line[0]["explained"] == pytest.approx(1)
    for far, components in ((2e4, 2), (3e38, 1)):  # beyond a million the other component is zero to rounding
        got = whitening.whiten(frame([(1, [far, 0.0], 1), (2, [-far, 1.0], 1), (3, [0.0, 2.0], 1)], VEC)).collect()
        assert len(got) == 3 * components and all(abs(r["whitened"]) < 2 for r in got)


# -- vector codes ----------------------------------------------------------------------------------------------------


def plain_codes(rows, entries, parts=4, rounds=4):
    x = whole(rows)
    cuts = vectorcodes.cuts_of(len(x[0]), parts)
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, x[i]))[:entries]
    books = [[x[i][a:b] for i in order] for a, b in cuts]

    def assign():
        return [[min(range(len(books[p])), key=lambda e: (sum((u - w) ** 2 for u, w in zip(v[a:b], books[p][e])), e)) for p, (a, b) in enumerate(cuts)] for v in x]

    for _ in range(rounds):
        code = assign()
        for p, (a, b) in enumerate(cuts):
            for e in range(len(books[p])):
                mine = [v[a:b] for v, c in zip(x, code) if c[p] == e]
                if mine:
                    books[p][e] = [sum(c) // len(mine) for c in zip(*mine)]
    code = assign()
    error = [sum((u - w) ** 2 for p, (a, b) in enumerate(cuts) for u, w in zip(v[a:b], books[p][c[p]])) for v, c in zip(x, code)]
    by_label = {}
    for (_, _, label), e in zip(rows, error):
        by_label[label] = by_label.get(label, 0) + e
    digest = hashlib.sha256(",".join(str(c) for part in books for e in part for c in e).encode()).hexdigest()
    return [(i, "".join(f"{c:02x}" for c in cs), e, by_label[label], digest) for (i, _, label), cs, e in zip(rows, code, error)]


def by_text(rows):
    return sorted(map(str, (tuple(r) for r in rows)))


@pytest.mark.parametrize("entries", [256, 24, 5])
def test_codes_match_plain_rounds(frame, rows, monkeypatch, entries):
    whole_fit = vectorcodes.fit_codes
    monkeypatch.setattr(vectorcodes, "fit_codes", lambda rows, order, width: whole_fit(rows, order, width, entries=entries))
    monkeypatch.setattr(vectorcodes, "ROWS_AT_ONCE", 50)
    got = vectorcodes.compress(frame(rows + BAD, VEC).withColumn("code", F.lit("own")).repartition(5)).collect()
    assert by_text(got) == by_text(plain_codes(rows, entries))


def test_bounds_save_distances_and_lose_none():
    rng = np.random.default_rng(3)
    x = rng.integers(-900, 900, size=(1500, 6)) // 30 * 30
    books = vectorcodes.Codebooks([(0, 6)], [[x[:64].copy()]], 8)
    state = vectorcodes.first_state(x, books, 0)
    total = 0
    for _ in range(8):
        moved = books.history[-1][0].copy()
        for e in range(64):
            if (state.code == e).any():
                moved[e] = x[state.code == e].sum(axis=0) // (state.code == e).sum()
        books = vectorcodes.Codebooks(books.cuts, [*books.history, [moved]], 8)
        state, scanned = vectorcodes.next_state(x, state, books, 0)
        total += scanned
        d = ((x[:, None] - moved[None]) ** 2).sum(axis=2)
        assert np.array_equal(state.code, d.argmin(axis=1))
        other = d.astype(float)
        other[np.arange(len(x)), state.code] = np.inf
        nearest = np.sqrt(other.reshape(len(x), 8, 8).min(axis=2))
        _, widest = vectorcodes._moves(books, 0)
        assert (state.low - widest[state.low_since, np.arange(8)] <= nearest + 1e-6).all()
    assert total < 8 * 1500 * 64 / 2


def test_codes_of_nothing_huge_components_and_many_labels(frame, monkeypatch):
    assert vectorcodes.compress(frame(BAD[:4], VEC)).count() == 0
    far = [(i, [float(np.float32(3e38 * (-1) ** i)), 1.0, float(i), 2.0], i % 2) for i in range(300)]
    top = vectorcodes.bound_for(4)
    clipped = [(i, [max(-top, min(top, 1024 * c)) / 1024 for c in v], label) for i, v, label in far]
    assert by_text(vectorcodes.compress(frame(far, VEC)).collect()) == by_text(plain_codes(clipped, 256))
    errors = frame([(i, None if i % 3 == 0 else i % 40 + 1, str(i), i) for i in range(200)], "vec_id long, label int, code string, error long")
    plain = by_text(vectorcodes.with_label_error(errors).select("vec_id", "label_error").collect())
    monkeypatch.setattr(vectorcodes, "HOT_SHARE", 0.1)
    assert by_text(vectorcodes.with_label_error(errors).select("vec_id", "label_error").collect()) == plain
