"""Embedding whitening by contour integration (FEAST) on the covariance of all vectors.

The covariance is exact. Vectors are whole numbers; a first pass sums them, a second one centres them by the whole
part of the mean and sums products, per task by blocks whose sums a double holds exactly. What the fraction of the
mean changes is taken off in unbounded integers, so one rounding per entry is all, in any order of the rows.

The eigenvalues wanted are fenced by counts: Sylvester's inertia of the shifted covariance (its tridiagonal form)
tells how many lie above a number, and bisection puts the fences into gaps. For each interval between fences the
spectral projector is a quadrature over a contour around it: solves with complex shifts of the covariance, nodes dealt
over Spark tasks. Rayleigh-Ritz in the projected space gives the pairs; passes repeat until their residuals are at
rounding, and the number found in each interval must be the number counted.

Every step on the driver is on matrices of the vectors' length, never of the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.llm.common import discard, saved
from runlens.llm.intvectors import commonest, rows_of, sound_rows, whole

#: Added to each scaled component.
SHIFT = 100_000
#: Components count as at most a million on either side.
BOUND = 1 << 30
COMPONENTS = 8
#: Quadrature nodes on the upper half of a contour, eigenvalues in an interval, passes until the residuals must be small.
NODES = 16
IN_INTERVAL = 4
PASSES = 60
#: Partial product sums that are shuffled at most: each is a triangle of length x length.
PARTIALS = 4096
#: Eigenvalues that lie closer than this share of the trace are not fenced apart; smaller ones count as zero.
GAP = 1e-9
ZERO = 1e-12


@dataclass
class Whitener:
    """n vectors, their whole-numbered centre, what their sums exceed n times the centre by, eigenpairs and the trace."""

    n: int
    centre: np.ndarray
    excess: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float


# -- the covariance, over all rows ---------------------------------------------------------------------------------


def _sums(embedding: str) -> Callable:
    """Per task and length: how many sound vectors, and the sums of their whole-numbered components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[int, int] = {}
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            length, start, values = sound_rows(batch.column(embedding))
            for d in np.unique(length[length > 0]).tolist():
                at = start[length == d]
                sums = (whole(values[at[:, None] + np.arange(d)], BOUND) + SHIFT).sum(axis=0)
                n[d], total[d] = n.get(d, 0) + len(at), total.get(d, 0) + sums
        rows = {"d": list(n), "n": list(n.values()), "total": [total[d].tolist() for d in n]}
        yield pa.RecordBatch.from_pydict(rows, schema=pa.schema([("d", pa.int64()), ("n", pa.int64()), ("total", pa.list_(pa.int64()))]))

    return run


def _products(y: np.ndarray) -> np.ndarray:
    """Sums of products of columns. Doubles add whole numbers exactly below 2^53; larger entries go in two halves."""
    out = np.zeros((y.shape[1], y.shape[1]), dtype=np.int64)
    top = max(1, int(np.abs(y).max(initial=0)))
    if top < 1 << 21:
        rows = max(1, (1 << 53) // (top * top) - 1)
        for i in range(0, len(y), rows):
            part = y[i : i + rows].astype(np.float64)
            out += (part.T @ part).astype(np.int64)
        return out
    high, low = y >> 16, y & 0xFFFF
    for i in range(0, len(y), 1 << 20):
        a, b = high[i : i + (1 << 20)].astype(np.float64), low[i : i + (1 << 20)].astype(np.float64)
        mixed = (a.T @ b).astype(np.int64)
        out += ((a.T @ a).astype(np.int64) << 32) + ((mixed + mixed.T) << 16) + (b.T @ b).astype(np.int64)
    return out


def _scatter(embedding: str, centre: np.ndarray) -> Callable:
    width = len(centre)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width), dtype=np.int64)
        for batch in batches:
            total += _products(rows_of(batch.column(embedding), width, BOUND)[1] + SHIFT - centre)
        rows = {"i": list(range(width)), "products": [total[i, i:].tolist() for i in range(width)]}
        yield pa.RecordBatch.from_pydict(rows, schema=pa.schema([("i", pa.int32()), ("products", pa.list_(pa.int64()))]))

    return run


def covariance(vectors: DataFrame, embedding: str) -> tuple[int, np.ndarray, list[int], np.ndarray] | None:
    """(n, centre, excess, covariance) of the sound vectors of the commonest length; None if there are none.

    Each entry of the covariance is the exact one rounded once.
    """
    partials = vectors.select(embedding).coalesce(PARTIALS)
    sums = saved(partials.mapInArrow(_sums(embedding), "d long, n long, total array<long>"), "vector-sums")
    width = commonest(sums)
    if width is None:
        return None
    of_width = sums.where(F.col("d") == width)
    n = of_width.agg(F.sum("n")).first()[0]
    by_place = of_width.select(F.posexplode("total").alias("at", "total")).groupBy("at").agg(F.sum("total").alias("total"))
    total = [r["total"] for r in sorted(by_place.collect())]
    discard(vectors.sparkSession, sums)
    centre = np.array([t // n for t in total], dtype=np.int64)
    excess = [t % n for t in total]
    scatter = partials.mapInArrow(_scatter(embedding, centre), "i int, products array<long>")
    cells = scatter.select("i", F.posexplode("products").alias("step", "p")).groupBy("i", "step").agg(F.sum(F.col("p").cast("decimal(38,0)")).alias("p"))
    v = np.zeros((width, width))
    for r in cells.collect():
        i, j = r["i"], r["i"] + r["step"]
        v[i, j] = v[j, i] = (n * int(r["p"]) - excess[i] * excess[j]) / (n * n)
    return n, centre, excess, v


# -- eigenvalue counts -----------------------------------------------------------------------------------------------


def tridiagonal(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and off-diagonal of a tridiagonal matrix with the same eigenvalues, by Householder reflections."""
    a = v.copy()
    d = len(a)
    off = np.zeros(max(0, d - 1))
    for k in range(d - 2):
        x = a[k + 1 :, k].copy()
        size = np.linalg.norm(x)
        off[k] = -size if x[0] > 0 else size
        x[0] -= off[k]
        length = np.linalg.norm(x)
        if length == 0:
            continue
        x /= length
        rest = a[k + 1 :, k + 1 :]
        p = rest @ x
        w = p - (x @ p) * x
        rest -= 2 * (np.outer(x, w) + np.outer(w, x))
    if d > 1:
        off[d - 2] = a[d - 1, d - 2]
    return np.diag(a).copy(), off


def count_above(form: tuple[np.ndarray, np.ndarray], shift: float) -> int:
    """Eigenvalues above ``shift``: positive pivots of the shifted matrix (Sylvester's law of inertia)."""
    diagonal, off = form
    tiny = np.finfo(float).tiny
    count, pivot = 0, 1.0
    for a, b in zip((diagonal - shift).tolist(), [0.0, *(off * off).tolist()]):
        pivot = a - b / (pivot if abs(pivot) > tiny else tiny)
        count += pivot > 0
    return count


def intervals(v: np.ndarray, wanted: int) -> list[tuple[float, float, int]]:
    """(low, high, count) around the ``wanted`` largest eigenvalues, more where the last one has near equals."""
    form = tridiagonal(v)
    trace = float(np.trace(v))
    bound = float(np.abs(v).sum(axis=1).max()) * (1 + 1e-9)
    values = []
    for rank in range(1, len(v) + 1):  # the eigenvalue of this rank, by bisection
        low, high = -bound, values[-1] if values else bound
        high += GAP * trace
        while high - low > GAP * trace / 4 and low < (middle := (low + high) / 2) < high:
            low, high = (middle, high) if count_above(form, middle) >= rank else (low, middle)
        values.append((low + high) / 2)
        if rank > wanted and values[-2] - values[-1] > GAP * trace:
            break
    apart = [k for k in range(1, len(values)) if values[k - 1] - values[k] > GAP * trace]
    last = apart[-1] if len(apart) and apart[-1] >= wanted else len(values)
    fences, start = [values[0] + GAP * trace], 0
    for k in [*[k for k in apart if k < last], last]:
        after = next((j for j in [*apart, last] if j > k), last)
        if k == last or after - start > IN_INTERVAL:
            fences.append((values[k - 1] + values[k]) / 2 if k < len(values) else values[-1] - GAP * trace)
            start = k
    counts = [count_above(form, f) for f in fences]
    return [(low, high, below - above) for high, low, above, below in zip(fences, fences[1:], counts, counts[1:]) if below > above]


# -- contour integration ---------------------------------------------------------------------------------------------


def _solver(matrix_of, spaces_of) -> Callable:
    """One row is one quadrature node: the real part of weight x (shift - covariance)^-1 x space."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                v, space = matrix_of.value, spaces_of.value[row.interval]
                z, weight = complex(row.z_re, row.z_im), complex(row.w_re, row.w_im)
                y = np.linalg.solve(z * np.eye(len(v)) - v, space.astype(complex))
                out.append((row.interval, np.ascontiguousarray((weight * y).real).tobytes()))
            yield pd.DataFrame(out, columns=["interval", "part"])

    return run


def _nodes(fenced: list[tuple[float, float, int]]) -> list[tuple[int, float, float, float, float]]:
    """(interval, shift, weight) of Gauss-Legendre nodes on the upper half circle; the lower half is its conjugate."""
    at, weight = np.polynomial.legendre.leggauss(NODES)
    angle = np.pi / 2 * (1 + at)
    out = []
    for k, (low, high, _) in enumerate(fenced):
        radius = (high - low) / 2
        z = (low + high) / 2 + radius * np.exp(1j * angle)
        w = weight / 2 * radius * np.exp(1j * angle)
        out += [(k, float(a.real), float(a.imag), float(b.real), float(b.imag)) for a, b in zip(z, w)]
    return out


def leading_eigenpairs(spark: SparkSession, v: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues, falling, and unit eigenvectors as columns; fewer where the rest is zero."""
    d, trace = len(v), float(np.trace(v))
    if trace <= 0:
        return np.zeros(0), np.zeros((d, 0))
    fenced = intervals(v, min(wanted, d))
    scale = float(np.linalg.norm(v))
    rng = np.random.default_rng(5)
    spaces = [np.linalg.qr(rng.normal(size=(d, min(d, 3 * count + 12))))[0] for _, _, count in fenced]
    done: list[np.ndarray | None] = [None] * len(fenced)
    best = [np.inf] * len(fenced)
    shared = spark.sparkContext.broadcast(v)
    schema = "interval int, z_re double, z_im double, w_re double, w_im double"
    for _ in range(PASSES):
        open_ones = [k for k in range(len(fenced)) if done[k] is None]
        if not open_ones:
            break
        nodes = [r for r in _nodes(fenced) if r[0] in open_ones]
        held = spark.sparkContext.broadcast(spaces)
        tasks = spark.createDataFrame(nodes, schema).repartition(min(len(nodes), spark.sparkContext.defaultParallelism))
        projected = {k: np.zeros_like(spaces[k]) for k in open_ones}
        for k, part in sorted((r["interval"], bytes(r["part"])) for r in tasks.mapInPandas(_solver(shared, held), "interval int, part binary").collect()):
            projected[k] += np.frombuffer(part).reshape(spaces[k].shape)
        held.destroy()
        for k in open_ones:
            low, high, count = fenced[k]
            basis = np.linalg.qr(projected[k])[0]
            values, turn = np.linalg.eigh(basis.T @ v @ basis)
            ritz = basis @ turn
            inside = (values > low) & (values <= high)
            residual = np.linalg.norm(v @ ritz[:, inside] - ritz[:, inside] * values[inside], axis=0).max(initial=0.0) / scale
            spaces[k] = ritz
            if inside.sum() == count and (residual < 1e-15 or residual < 1e-12 and residual > best[k] / 2):
                done[k] = ritz[:, inside]
            best[k] = min(best[k], residual) if inside.sum() == count else best[k]
    shared.destroy()
    if any(x is None for x in done):
        raise RuntimeError("an interval holds other eigenpairs than its inertia count says")
    basis = np.linalg.qr(np.concatenate(done, axis=1))[0]
    values, turn = np.linalg.eigh(basis.T @ v @ basis)
    order = np.argsort(-values, kind="stable")[:wanted]
    order = order[values[order] > ZERO * trace]
    return values[order], (basis @ turn)[:, order]


# -- the operator ----------------------------------------------------------------------------------------------------


def _whiten(w: Whitener, vec_id: str, embedding: str) -> Callable:
    width, excess = len(w.centre), np.array(w.excess, dtype=np.int64)
    fraction = np.array([e / w.n for e in w.excess])
    turn = w.vectors / np.sqrt(w.values)

    def deviations(y: np.ndarray) -> list[int | None]:
        top = w.n * int(np.abs(y).max(initial=0)) + w.n
        if top * top * width < 1 << 63:
            return ((y * w.n - excess) ** 2).sum(axis=1).tolist()
        exact = [sum((w.n * a - e) ** 2 for a, e in zip(row, w.excess)) for row in y.tolist()]
        return [e if e < 1 << 63 else None for e in exact]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, x = rows_of(batch.column(embedding), width, BOUND)
            y = x + SHIFT - w.centre
            white = (y - fraction) @ turn
            cells = pa.ListArray.from_arrays(np.arange(len(keep) + 1, dtype=np.int32) * white.shape[1], pa.array(white.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(vec_id).take(pa.array(keep)), pa.array(deviations(y), pa.int64()), cells], names=["vec_id", "deviation", "white"])

    return run


def fit(vectors: DataFrame, embedding: str = "embedding", components: int = COMPONENTS) -> Whitener | None:
    """The whitening that all sound vectors of the commonest length give; None if there are none."""
    found = covariance(vectors, embedding)
    if found is None:
        return None
    n, centre, excess, v = found
    values, turn = leading_eigenpairs(vectors.sparkSession, v, components)
    return Whitener(n, centre, excess, values, turn, float(np.trace(v)))


def whiten(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error), up to ``components`` rows for each sound vector.

    Dropped are vectors that are NULL, empty or hold NULL or non-finite components, and those of another length than
    the commonest (of equally common lengths the longer counts). Rows with NULL or repeated ids stay, each row is one
    vector of the fit; further columns are not read. Components beyond a million count as a million. Eigenvalues that
    are zero to rounding, as in tables of equal vectors, give no rows; an empty table gives none. Of equal eigenvalues
    some orthonormal vectors of their space are taken, the same for all rows. A deviation beyond 63 bits is NULL.
    """
    id_type = vectors.schema[vec_id].dataType.simpleString()
    found = fit(vectors, embedding, components)
    if found is None or not len(found.values):
        return vectors.sparkSession.createDataFrame([], f"vec_id {id_type}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    rows = vectors.select(vec_id, embedding)
    white = saved(rows.mapInArrow(_whiten(found, vec_id, embedding), f"vec_id {id_type}, deviation long, white array<double>"), "whitened")
    k = len(found.values)
    at = [F.col("white")[i] for i in range(k)]
    means = [F.avg(a).alias(f"m{i}") for i, a in enumerate(at)]
    mean = white.agg(*means).first()
    spread = [F.avg((at[i] - mean[i]) * (at[j] - mean[j])).alias(f"c{i}_{j}") for i in range(k) for j in range(i + 1)]
    cov = white.agg(*spread).first()
    off = max(abs(cov[f"c{i}_{j}"] - (i == j)) for i in range(k) for j in range(i + 1))
    explained = F.array(*[F.lit(float(e / found.trace)) for e in found.values])
    return white.select("vec_id", "deviation", F.posexplode("white").alias("at", "whitened")).select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(found.n).cast("long").alias("n"), "deviation", "whitened",
        explained[F.col("at")].alias("explained"), F.lit(float(off)).alias("identity_error"),
    )
