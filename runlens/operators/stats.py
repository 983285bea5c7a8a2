"""Mergeable statistics: value summaries, counters, step timing, cross-correlation."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runlens.operators.blocks import BLOCK, DEFAULT_BITS, with_halo
from runlens.operators.keys import KEY, join_keys, packed
from runlens.operators.reduce import clean
from runlens.session import cut

#: So many groups' brackets may be broadcast.
FEW_GROUPS = 100_000

# Fixed value: added under the root of the standard error.
VARIANCE_FLOOR = 1e-6
# Fixed value: below this, norms and covariance count as zero.
ZERO = 1e-6


def describe_values(df: DataFrame, value: str, by: Sequence[str] = (), accuracy: int = 100_000) -> DataFrame:
    """Count, min, max, mean and the exact median per group.

    The median takes two passes. A mergeable quantile sketch brackets it; the second pass counts the rows
    below the bracket and, by distinct value, the few rows inside. Ranks are then read off the bracket. A
    group is never sorted or collected as a whole: the brackets of few groups go to the rows, not the rows to a task for
    each group. Sketches are checkpointed, since the second pass reads them. For a group whose bracket misses the median, a third pass
    reads the ranks off all its distinct values.

    Missing values are skipped. A group of missing values only has n = 0 and NULLs, and so has an ungrouped
    empty table. A NULL key is a group.
    """
    rows = df.select(packed(by) if by else F.lit(1).alias(KEY), clean(value).alias("_v"))
    margin = 2.0 / accuracy
    measures = [
        F.count("_v").alias("n"), F.min("_v").alias("min"), F.max("_v").alias("max"), F.avg("_v").alias("mean"),
        F.percentile_approx("_v", [0.5 - margin, 0.5 + margin], accuracy).alias("_q"),
    ]
    # a hidden constant key lets the ungrouped case join without a cross product
    sketch = cut(rows.groupBy(KEY).agg(*measures) if by else rows.agg(*measures).withColumn(KEY, F.lit(1)))
    sent = F.broadcast if sketch.count() <= FEW_GROUPS else lambda few: few
    known = rows.where(F.col("_v").isNotNull())
    brackets = sketch.select(KEY, "n", F.col("_q")[0].alias("_lo"), F.col("_q")[1].alias("_hi"))
    found = cut(_median_ranks(known, sent(brackets)).where("_median is not null"))
    missed = brackets.join(found, KEY, "left_anti").where("n > 0")
    whole = missed.select(KEY, "n", F.lit(float("-inf")).alias("_lo"), F.lit(float("inf")).alias("_hi"))
    medians = found if missed.isEmpty() else found.unionByName(_median_ranks(known, sent(whole)))
    keys = [F.col(KEY)[k].alias(k) for k in by]
    return sketch.join(medians, KEY, "left").select(*keys, "n", "min", "max", "mean", F.col("_median").alias("median"))


def _median_ranks(known: DataFrame, brackets: DataFrame) -> DataFrame:
    """Median per key from the ranks of the values inside a bracket; NULL where it isn't there."""
    near = known.join(brackets, KEY)
    # rows outside the bracket fall into one bucket on each side
    bucketed = near.where(F.col("_v") <= F.col("_hi")).withColumn("_inside", F.when(F.col("_v") >= F.col("_lo"), F.col("_v")))
    counts = bucketed.groupBy(KEY, "n", "_inside").agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(KEY).orderBy(F.col("_inside").asc_nulls_first())
    ranks = counts.withColumn("_upto", F.sum("_c").over(w)).withColumn("_from", F.col("_upto") - F.col("_c"))
    low, high = F.expr("(n - 1) div 2"), F.expr("n div 2")
    at = lambda r: F.max(F.when((F.col("_from") <= r) & (r < F.col("_upto")), F.col("_inside")))
    return ranks.groupBy(KEY).agg(((at(low) + at(high)) / 2).alias("_median"))


def value_stats(
    df: DataFrame, by: Sequence[str], value: str = "value", index: str = "pos", multipliers: dict[str, float] | None = None
) -> DataFrame:
    """Per key: count, mean, standard error of the mean, min and max with the index of their last arrival.

    ``multipliers`` scale the numbers of a key (looked up by the last ``by`` column).
    """
    v, i = clean(value), F.col(index).cast("long")
    s = df.where(v.isNotNull()).groupBy(*by).agg(
        F.count(v).alias("n"),
        F.avg(v).alias("_mean"),
        F.var_pop(v).alias("_var"),
        F.min(F.struct(v.alias("v"), (-i).alias("i"))).alias("_lo"),
        F.max(F.struct(v.alias("v"), i.alias("i"))).alias("_hi"),
    )
    factor = F.lit(1.0)
    for name, m in (multipliers or {}).items():
        factor = F.when(F.col(by[-1]) == name, F.lit(float(m))).otherwise(factor)
    mean = F.col("_mean")
    stderr = F.sqrt(F.col("_var") + VARIANCE_FLOOR) / F.sqrt("n")
    return s.select(
        *by, "n", (mean * factor).alias("mean"), (stderr * factor).alias("stderr"),
        (F.col("_lo.v") * factor).alias("min"), (-F.col("_lo.i")).alias("min_idx"),
        (F.col("_hi.v") * factor).alias("max"), F.col("_hi.i").alias("max_idx"),
    )


def value_stats_text(stats: DataFrame, by: Sequence[str], global_counter: int, multipliers: dict[str, float] | None = None) -> DataFrame:
    """Report lines ``counter:key[n]: avg: ... min: ...[i], max: ...[i]`` over already aggregated rows."""
    multipliers = multipliers or {}

    def line(key: pd.Series, n: pd.Series, mean: pd.Series, err: pd.Series, lo: pd.Series, li: pd.Series, hi: pd.Series, hj: pd.Series) -> pd.Series:
        out = []
        for k, c, m, e, a, ai, b, bi in zip(key, n, mean, err, lo, li, hi, hj):
            factor = multipliers.get(k, 1)
            scale = f"[*{factor}]" if factor != 1 else ""
            out.append(f"{global_counter}:{k}[{c}]{scale}: avg: {m:8.4f} (± {e:8.4f}), min: {a:8.4f}[{ai:4d}], max: {b:8.4f}[{bi:4d}]")
        return pd.Series(out, dtype="object")

    text = F.pandas_udf(line, "string")
    return stats.select(*by, text(F.col(by[-1]).cast("string"), "n", "mean", "stderr", "min", "min_idx", "max", "max_idx").alias("line"))


def counter_share(events: DataFrame, key: str) -> DataFrame:
    """How often each key occurred, of how many in total."""
    counts = events.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    # the subquery reads the same shuffled counts
    return counts.withColumn("total", counts.agg(F.sum("n")).scalar()).withColumn("share", F.col("n") / F.col("total"))


def step_gaps(marks: DataFrame, session: Sequence[str], ts: str = "ts", order: str = "line_no", bits: int = DEFAULT_BITS) -> DataFrame:
    """Milliseconds since the previous mark of the session (0 for the first). ``order`` is dense."""
    rows = with_halo(marks, order, 1, 0, bits)
    previous = F.lag(ts).over(Window.partitionBy(*session, BLOCK).orderBy(order))
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    gap = F.coalesce((micros(F.col(ts)) - micros(previous)) / 1000, F.lit(0.0))
    return rows.withColumn("gap_ms", gap).where("_own").drop("_own", BLOCK)


def step_timing(marks: DataFrame, session: Sequence[str], key: str, ts: str = "ts", order: str = "line_no", bits: int = DEFAULT_BITS) -> DataFrame:
    """Mean gap per key, its share of the session's total, and total time per iteration.

    ``balanced`` tells whether every key has equally many samples; only then is ``iter_ms`` defined.
    """
    per_key = step_gaps(marks, session, ts, order, bits).groupBy(*session, key).agg(
        F.count(F.lit(1)).alias("n"), F.sum("gap_ms").alias("_sum")
    )
    totals = per_key.groupBy(*session).agg(
        F.sum("_sum").alias("_total"), F.min("n").alias("_least"), (F.min("n") == F.max("n")).alias("balanced")
    )
    return join_keys(per_key, totals, session).select(
        *session, key, "n", (F.col("_sum") / F.col("n")).alias("mean_ms"),
        F.try_divide(F.col("_sum") * 100, F.col("_total")).alias("share_pct"),
        F.when(F.col("balanced"), F.col("_total") / F.col("_least")).alias("iter_ms"), "balanced",
    )


# ---- cross-correlation -------------------------------------------------------------------------

CORR_STATE = "i int, j int, sxy double, sx double, sxx double, sy double, syy double, n long"


def spatial_rows(df: DataFrame, features: str, keep: Sequence[str] = ()) -> DataFrame:
    """Turn channel-major maps ``[channel][y][x]`` into one feature row per spatial position."""
    fm = F.col(features)
    ys = F.explode(F.sequence(F.lit(0), F.size(F.get(fm, F.lit(0))) - 1))
    xs = F.explode(F.sequence(F.lit(0), F.size(F.get(F.get(fm, F.lit(0)), F.lit(0))) - 1))
    d = df.where(F.size(fm) > 0).withColumn("_y", ys).withColumn("_x", xs)
    return d.select(*keep, F.transform(fm, lambda c: F.get(F.get(c, F.col("_y")), F.col("_x"))).alias(features))


def cross_corr_sums(features: DataFrame, left: str, right: str) -> DataFrame:
    """Accumulators for every left x right column pair: one matrix per task, added up by (i, j).

    The result adds up with the result for other rows, so batches can be merged later.
    """

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = None
        for pdf in batches:
            if not len(pdf):
                continue
            t = np.stack(pdf["t"].to_numpy()).astype(np.float64)
            s = np.stack(pdf["s"].to_numpy()).astype(np.float64)
            part = [t.T @ s, t.sum(0), (t * t).sum(0), s.sum(0), (s * s).sum(0), len(pdf)]
            state = part if state is None else [a + b for a, b in zip(state, part)]
        if state is not None:
            xy, sx, sxx, sy, syy, n = state
            i, j = np.indices(xy.shape)
            i, j = i.ravel(), j.ravel()
            yield pd.DataFrame(
                dict(i=i, j=j, sxy=xy.ravel(), sx=sx[i], sxx=sxx[i], sy=sy[j], syy=syy[j], n=np.full(len(i), n))
            )

    rows = features.select(F.col(left).alias("t"), F.col(right).alias("s")).where("t is not null and s is not null")
    return merge_corr_sums(rows.mapInPandas(partial, CORR_STATE))


def merge_corr_sums(sums: DataFrame) -> DataFrame:
    parts = ("sxy", "sx", "sxx", "sy", "syy", "n")
    return sums.groupBy("i", "j").agg(*[F.sum(p).alias(p) for p in parts])


def corr_from_sums(sums: DataFrame) -> DataFrame:
    """Pearson r from the accumulators: variance at least 0, 0/0 = 0, r within [-1, 1]; with both norms."""
    n = F.col("n")
    cov = F.col("sxy") / n - F.col("sx") / n * (F.col("sy") / n)
    norm = lambda sq, s: F.sqrt(F.greatest(F.col(sq) / n - F.col(s) / n * (F.col(s) / n), F.lit(0.0)))
    scaled = sums.select("i", "j", "n", cov.alias("_cov"), norm("sxx", "sx").alias("t_norm"), norm("syy", "sy").alias("s_norm"))
    both = F.col("t_norm") * F.col("s_norm")
    r = (
        F.when((both < ZERO) & (F.abs("_cov") < ZERO), F.lit(0.0))
        .when(both == 0, F.signum("_cov"))
        .otherwise(F.least(F.greatest(F.try_divide(F.col("_cov"), both), F.lit(-1.0)), F.lit(1.0)))
    )
    return scaled.select("i", "j", "n", r.alias("r"), "t_norm", "s_norm")


def cross_corr(features: DataFrame, left: str, right: str) -> DataFrame:
    return corr_from_sums(cross_corr_sums(features, left, right))


def best_match(corr: DataFrame, last: DataFrame | None = None) -> DataFrame:
    """Per row i the best column j (lowest j on ties) and its score, best rows first.

    With an earlier ``best_match`` result in ``last``, ``delta`` is the change of the score.
    """
    best = corr.groupBy("i").agg(F.max(F.struct("r", (-F.col("j")).alias("neg_j"))).alias("_b")).select(
        "i", (-F.col("_b.neg_j")).alias("best_j"), F.col("_b.r").alias("best_r")
    )
    if last is not None:
        best = best.join(last.select("i", F.col("best_r").alias("_old")), "i", "left").withColumn(
            "delta", F.col("best_r") - F.col("_old")
        ).drop("_old")
    return best.orderBy(F.desc("best_r"), "i")


def gram_matrix(features: DataFrame, column: str) -> DataFrame:
    """Inner products of all feature columns as (i, j, value), divided by the row count."""
    return cross_corr_sums(features, column, column).select("i", "j", (F.col("sxy") / F.col("n")).alias("value"))


# ---- wide features ---------------------------------------------------------------------------------

#: Columns of a tile, and rows whose tiles are multiplied at a time.
TILE = 256
TILE_ROWS = 8192


def _stacked(batches: Iterator[pa.RecordBatch], names: Sequence[str]) -> Iterator[list[np.ndarray]]:
    """Some thousand rows at a time of several array columns, as matrices."""
    held: list[list[np.ndarray]] = []
    rows = 0
    for batch in batches:
        for i in range(0, batch.num_rows, TILE_ROWS):
            part = batch.slice(i, TILE_ROWS)
            held.append([part.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(part.num_rows, -1) for c in names])
            rows += part.num_rows
            if rows >= TILE_ROWS:
                yield [np.concatenate(m) for m in zip(*held)]
                held, rows = [], 0
    if held:
        yield [np.concatenate(m) for m in zip(*held)]


def cross_corr_sums_tiled(features: DataFrame, left: str, right: str, tile: int = TILE) -> DataFrame:
    """``cross_corr_sums`` for features of any width: a task holds some rows and one tile of the matrix, never all of it.

    The products of a tile leave the task row by row and are added up by Spark, on the map side first.
    """
    sums = "sx double, sxx double, n long"

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, s in _stacked(batches, ("t", "s")):
            for a in range(0, t.shape[1], tile):
                for b in range(0, s.shape[1], tile):
                    part = t[:, a : a + tile].T @ s[:, b : b + tile]
                    rows = np.arange(a, a + len(part), dtype=np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(np.full(len(part), b, dtype=np.int32)), pa.array(list(part), pa.list_(pa.float64()))], names=["i", "first", "sxy"])

    def marginals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pair in _stacked(batches, ("t", "s")):
            for side, x in enumerate(pair):
                at = np.arange(x.shape[1], dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), side, dtype=np.int32)), pa.array(at), pa.array(x.sum(0)), pa.array((x * x).sum(0)), pa.array(np.full(len(at), len(x), dtype=np.int64))],
                    names=["side", "at", "sx", "sxx", "n"],
                )

    rows = features.select(F.col(left).alias("t"), F.col(right).alias("s")).where("t is not null and s is not null")
    cells = rows.mapInArrow(products, "i int, first int, sxy array<double>").select("i", F.posexplode("sxy").alias("at", "sxy"), "first")
    xy = cells.select("i", (F.col("first") + F.col("at")).cast("int").alias("j"), "sxy").groupBy("i", "j").agg(F.sum("sxy").alias("sxy"))
    sides = rows.mapInArrow(marginals, f"side int, at int, {sums}").groupBy("side", "at").agg(F.sum("sx").alias("sx"), F.sum("sxx").alias("sxx"), F.sum("n").alias("n"))
    x = sides.where("side = 0").select(F.col("at").alias("i"), "sx", "sxx", "n")
    y = sides.where("side = 1").select(F.col("at").alias("j"), F.col("sx").alias("sy"), F.col("sxx").alias("syy"))
    return xy.join(x, "i").join(y, "j").select("i", "j", "sxy", "sx", "sxx", "sy", "syy", "n")


def cross_corr_tiled(features: DataFrame, left: str, right: str, tile: int = TILE) -> DataFrame:
    return corr_from_sums(cross_corr_sums_tiled(features, left, right, tile))


def _times(features: DataFrame, column: str, block: np.ndarray) -> np.ndarray:
    """(rows' Gram matrix x block) / rows, in one pass: each task multiplies its rows twice and returns length x block."""
    shared = features.sparkSession.sparkContext.broadcast(block)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, total, n = shared.value, 0.0, 0
        for (x,) in _stacked(batches, ("x",)):
            total, n = total + x.T @ (x @ q), n + len(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(list(total), pa.list_(pa.float64())), pa.array([n] * len(total), pa.int64())], names=["i", "y", "n"])

    rows = features.select(F.col(column).alias("x")).where("x is not null")
    cells = rows.mapInArrow(partial, "i int, y array<double>, n long")
    sums = cells.groupBy("i").agg(F.sum("n").alias("n"), *[F.sum(F.col("y")[c]).alias(f"y{c}") for c in range(block.shape[1])])
    out = np.zeros_like(block)
    for r in sums.collect():
        out[r["i"]] = [r[f"y{c}"] / r["n"] for c in range(block.shape[1])]
    shared.destroy()
    return out


def top_eigen(features: DataFrame, column: str, k: int = 4, tolerance: float = 1e-9, passes: int = 60) -> DataFrame:
    """The k largest eigenvalues of the Gram matrix (over the row count) and unit eigenvectors: ``(rank, value, i, weight)``.

    Block power iteration over the rows: each pass multiplies a block of vectors by the matrix without forming it. The blocks of
    some passes together are a Krylov space in which Rayleigh-Ritz finds the pairs; it starts again from the best ones when it holds
    ``8 k`` vectors. The first non-zero weight of a vector is positive. The driver holds blocks of length x ``8 k`` at most.
    """
    spark = features.sparkSession
    first = features.where(F.col(column).isNotNull()).select(F.size(column).alias("d")).first()
    schema = "rank int, value double, i int, weight double"
    if first is None:
        return spark.createDataFrame([], schema)
    d = first["d"]
    k = min(k, d)
    width = min(d, k + 4)
    block = np.linalg.qr(np.random.default_rng(3).normal(size=(d, width)))[0]
    space, images = np.zeros((d, 0)), np.zeros((d, 0))
    values, vectors = np.zeros(k), block[:, :k]
    for _ in range(passes):
        space, images = np.concatenate([space, block], axis=1), np.concatenate([images, _times(features, column, block)], axis=1)
        small = space.T @ images
        ritz, turn = np.linalg.eigh((small + small.T) / 2)
        top = turn[:, ::-1][:, :width]
        values, vectors, moved = ritz[::-1][:k], space @ top[:, :k], images @ top
        residual = np.abs(moved[:, :k] - vectors * values).max()
        if residual <= tolerance * max(values[0], 1e-300) or space.shape[1] >= d:
            break
        if space.shape[1] + width > max(8 * k, 2 * width):
            space, images = space @ top, moved
        new = moved - space @ (space.T @ moved)
        new -= space @ (space.T @ new)
        block, size = np.linalg.qr(new)
        block = block[:, : min(width, d - space.shape[1])]
    sign = [np.sign(v[np.flatnonzero(np.abs(v) > 1e-12)[0]]) if np.abs(v).max() > 1e-12 else 1.0 for v in vectors.T]
    rows = [(r + 1, float(values[r]), i, float(vectors[i, r] * sign[r])) for r in range(k) for i in range(d)]
    return spark.createDataFrame(rows, schema)
