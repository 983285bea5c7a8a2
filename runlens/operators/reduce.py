"""Reduce metric series and rank runs.

Series are long rows ``points(run_id, metric, pos, value)``. Missing values are NULL (NaN is read as NULL).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce as fold

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from runlens.operators.blocks import BLOCK, DEFAULT_BITS, block_of
from runlens.plans.spec import MetricOptions

REDUCED = ("topk_mean", "best", "best_idx", "len")
#: So many first positions of a series are sorted by one task; of the blocks after them only the best points are.
NEAR = 1 << DEFAULT_BITS


def clean(value: str | Column) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    value = value.cast("double")
    return F.when(~F.isnan(value), value)


def _per_metric(options: dict[str, MetricOptions], default: MetricOptions, field: str) -> Column:
    expr = F.lit(getattr(default, field))
    for name, opt in options.items():
        if getattr(opt, field) != getattr(default, field):
            expr = F.when(F.col("metric") == name, F.lit(getattr(opt, field))).otherwise(expr)
    return expr


def _most(default: MetricOptions, options: dict[str, MetricOptions]) -> int:
    return max([default.topk_mean, *[o.topk_mean for o in options.values()]])


def _series(keys: Sequence[str], default: MetricOptions, options: dict[str, MetricOptions]) -> tuple[WindowSpec, WindowSpec]:
    """The points of a series from its best on, missing values last; up to each point, and all of them for each."""
    sign = F.when(_per_metric(options, default, "descending"), F.lit(-1)).otherwise(F.lit(1))
    rows = Window.partitionBy(*keys).orderBy((F.col("value") * sign).asc_nulls_last(), F.col("pos") * sign)
    first, last = Window.unboundedPreceding, Window.unboundedFollowing
    return rows.rowsBetween(first, Window.currentRow), rows.rowsBetween(first, last)


def series_points(
    points: DataFrame, keys: Sequence[str], default: MetricOptions, options: dict[str, MetricOptions], iters: Sequence[int] = ()
) -> DataFrame:
    """The points that can be among the best, and ``_n``, how many points each of them stands for.

    All of the first ``NEAR`` positions, which are few enough for one task; of the positions after them the best of each
    block (and of each prefix in ``iters``), the first of which stands for its block. With ``iters``, ``pos`` must be below the largest.
    """
    rows = points.select(*keys, F.col("pos").cast("long").alias("pos"), clean("value").alias("value"), F.lit(1).cast("long").alias("_n"))
    if iters and max(iters) <= NEAR:
        return rows
    far, near = F.col("pos") >= NEAR, (F.col("pos") < NEAR) | F.col("pos").isNull()
    prefix = F.size(F.filter(F.array(*[F.lit(int(i)) for i in iters]), lambda i: i <= F.col("pos"))) if iters else F.lit(0)
    cells = rows.where(far).withColumns({BLOCK: block_of("pos"), "_prefix": prefix})
    up_to, whole = _series([*keys, BLOCK, "_prefix"], default, options)
    cells = cells.withColumns({"_rank": F.row_number().over(up_to), "_all": F.sum("_n").over(whole)})
    best = cells.where(F.col("_rank") <= max(_most(default, options), 1)).withColumn("_n", F.when(F.col("_rank") == 1, F.col("_all")).otherwise(0))
    return rows.where(near).unionByName(best.select(rows.columns))


def best_points(
    points: DataFrame, default: MetricOptions, options: dict[str, MetricOptions] | None = None, keys: Sequence[str] = ("run_id",)
) -> DataFrame:
    """Mergeable form of a reduction: per series its best points (``top``) and its length."""
    options = options or {}
    keys, k_max = [*keys, "metric"], _most(default, options)
    up_to, whole = _series(keys, default, options)
    rows = series_points(points, keys, default, options)
    ranked = rows.withColumns({"_rank": F.row_number().over(up_to), "len": F.sum("_n").over(whole)}).where(F.col("_rank") <= max(k_max, 1))
    kept = F.col("value").isNotNull() & (F.col("_rank") <= k_max)
    top = ranked.withColumn("top", F.collect_list(F.when(kept, F.struct("pos", "value"))).over(whole))
    return top.where("_rank = 1").select(*keys, "top", "len")


def _best_first(default: MetricOptions, options: dict[str, MetricOptions]) -> tuple[Column, Column]:
    """``top`` with its best points first, as ``(v, p)`` with both signs turned for descending metrics; and the sign."""
    sign = F.when(_per_metric(options, default, "descending"), F.lit(-1)).otherwise(F.lit(1))
    return F.array_sort(F.transform("top", lambda e: F.struct((e["value"] * sign).alias("v"), (e["pos"] * sign).alias("p")))), sign


def _cut_to_best(both: DataFrame, keys: Sequence[str], default: MetricOptions, options: dict[str, MetricOptions]) -> DataFrame:
    """Only as many points in each ``top`` as are needed."""
    (ordered, sign), k_max = _best_first(default, options), _most(default, options)
    back = F.transform(F.slice(ordered, 1, k_max), lambda e: F.struct((e["p"] * sign).alias("pos"), (e["v"] * sign).alias("value")))
    return both.select(*keys, "metric", F.when(F.size("top") <= k_max, F.col("top")).otherwise(back).alias("top"), "len")


def merge_best_points(
    states: DataFrame, default: MetricOptions, options: dict[str, MetricOptions] | None = None, keys: Sequence[str] = ("run_id",)
) -> DataFrame:
    """Add up ``best_points`` rows of the same series; only a few short arrays meet per series."""
    both = states.groupBy(*keys, "metric").agg(F.flatten(F.collect_list("top")).alias("top"), F.sum("len").alias("len"))
    return _cut_to_best(both, keys, default, options or {})


def add_best_points(
    new: DataFrame, old: DataFrame, default: MetricOptions, options: dict[str, MetricOptions] | None = None, keys: Sequence[str] = ("run_id",)
) -> DataFrame:
    """The series of ``new`` with what ``old`` holds of them added, both with one ``best_points`` row per series.

    The join needs ``new`` as its windows leave it, so it is not dealt again. Keys with a NULL have nothing in ``old``.
    """
    known = old.select(*keys, "metric", F.col("top").alias("_top"), F.col("len").alias("_len"))
    both = new.join(known, [*keys, "metric"], "left").select(
        *keys, "metric", F.when(F.col("_top").isNull(), F.col("top")).otherwise(F.concat("top", "_top")).alias("top"),
        (F.col("len") + F.coalesce("_len", F.lit(0))).alias("len"),
    )
    return _cut_to_best(both, keys, default, options or {})


def from_best_points(
    state: DataFrame, default: MetricOptions, options: dict[str, MetricOptions] | None = None, keys: Sequence[str] = ("run_id",)
) -> DataFrame:
    """The reduction that ``best_points`` rows stand for, row by row."""
    options = options or {}
    (ordered, sign), k = _best_first(default, options), _per_metric(options, default, "topk_mean")
    signed = F.transform("top", lambda e: F.struct((e["value"] * sign).alias("v"), (e["pos"] * sign).alias("p")))
    best = F.when(F.size("top") <= k, signed).otherwise(F.slice(ordered, F.lit(1), k))  # sorted only where some are left out
    mean = F.try_divide(F.aggregate(best, F.lit(0.0), lambda acc, e: acc + e["v"]), F.size(best)) * sign
    first = F.array_min(signed)
    return state.select(
        *keys, "metric", mean.alias("topk_mean"), (first["v"] * sign).alias("best"), (first["p"] * sign).alias("best_idx"), "len"
    )


def reduce_series(
    points: DataFrame,
    default: MetricOptions = MetricOptions(),
    options: dict[str, MetricOptions] | None = None,
    runs: DataFrame | None = None,
    metrics: Sequence[str] | None = None,
    keys: Sequence[str] = ("run_id",),
) -> DataFrame:
    """Per run and metric: mean of the best k points, best value, its position, and the series length.

    Ascending order takes the earliest of equal values, descending order the latest. ``len`` counts every
    point, the other columns skip missing values. With ``runs`` and ``metrics`` given, runs without points
    get a row with NULLs and length 0.

    Each series is sorted once, from its best point on, and everything is read off that order. Runs to report are rows of their
    series that stand for no point, so they are not joined. Of a very long series only the best points of each
    block of positions meet in one task (``series_points``).
    """
    reduced = _reduced(points, default, options or {}, runs, metrics, [*keys, "metric"], [None])
    return reduced.select(*keys, "metric", "_at.*").drop("iter")


def _reduced(
    points: DataFrame, default: MetricOptions, options: dict[str, MetricOptions], runs: DataFrame | None, metrics: Sequence[str] | None,
    keys: Sequence[str], iters: Sequence[int | None],
) -> DataFrame:
    """The keys and, as ``_at``, the reduction of the first k points for each k in ``iters``, None for all points."""
    if metrics is not None:
        points = points.where(F.col("metric").isin(list(metrics)))
    asked = runs is not None and metrics is not None
    rows = series_points(points, keys, default, options, [i for i in iters if i is not None]).withColumn("_asked", F.lit(False))
    if asked:
        extra = [c for c in keys if c not in ("metric", *runs.columns)]
        if extra:
            raise ValueError(f"runs must carry the key columns {extra}")
        every = runs.select(*[c for c in keys if c != "metric"]).withColumn("metric", F.explode(F.array(*[F.lit(m) for m in metrics])))
        none = [F.lit(None).cast("long").alias("pos"), F.lit(None).cast("double").alias("value"), F.lit(0).cast("long").alias("_n"), F.lit(True).alias("_asked")]
        rows = rows.unionByName(every.select(*[F.col(k).cast(points.schema[k].dataType).alias(k) for k in keys], *none))
    up_to, whole = _series(keys, default, options)
    value, pos = F.col("value"), F.col("pos")
    inside = [F.lit(True) if i is None else F.coalesce(pos < i, F.lit(False)) for i in iters]
    ranks = {f"_rank{j}": F.count(F.when(here & value.isNotNull(), 1)).over(up_to) for j, here in enumerate(inside)}
    cells = {"_row": F.row_number().over(up_to)}
    for j, here in enumerate(inside):
        rank, known = F.col(f"_rank{j}"), here & value.isNotNull()
        cells[f"_mean{j}"] = F.avg(F.when(known & (rank <= _per_metric(options, default, "topk_mean")), value)).over(whole)
        cells[f"_best{j}"] = F.max(F.when(known & (rank == 1), value)).over(whole)
        cells[f"_idx{j}"] = F.max(F.when(known & (rank == 1), pos)).over(whole)
        cells[f"_len{j}"] = F.coalesce(F.sum(F.when(here, F.col("_n"))).over(whole), F.lit(0).cast("long"))
    found = rows.withColumns(ranks).withColumns(cells).where(F.col("_asked") if asked else F.col("_row") == 1)
    at = [
        F.struct(F.lit(i).cast("int").alias("iter"), *[F.col(f"_{c}{j}").alias(name) for c, name in zip(("mean", "best", "idx", "len"), REDUCED)])
        for j, i in enumerate(iters)
    ]
    out = found.select(*keys, F.explode(F.array(*at)).alias("_at"))
    return out if asked else out.where(F.col("_at.len") > 0)


def reduce_series_at(
    points: DataFrame,
    iters: Sequence[int],
    default: MetricOptions = MetricOptions(),
    options: dict[str, MetricOptions] | None = None,
    runs: DataFrame | None = None,
    metrics: Sequence[str] | None = None,
) -> DataFrame:
    """``reduce_series`` on the first k points, for each k in ``iters`` (column ``iter``); a series is sorted once for all of them."""
    early = points.where(F.col("pos") < max(iters, default=0))  # reaches the scan; the rest belongs to no prefix
    reduced = _reduced(early, default, options or {}, runs, metrics, ["run_id", "metric"], list(dict.fromkeys(iters)) or [0])
    return reduced.select("run_id", F.col("_at.iter").alias("iter"), "metric", *[F.col(f"_at.{c}").alias(c) for c in REDUCED])


def wide_metrics(reduced: DataFrame, metrics: Sequence[str], iters: Sequence[int] | None = None) -> DataFrame:
    """One row per run with ``m``, ``m_best``, ``m_best_idx``, ``m_len`` (``m_iter{k}...`` with ``iters``)."""
    cells = [(m, None) for m in metrics] if iters is None else [(m, i) for m in metrics for i in iters]
    columns = []
    for m, i in cells:
        hit = F.col("metric") == m if i is None else (F.col("metric") == m) & (F.col("iter") == i)
        base = m if i is None else f"{m}_iter{i}"
        for src in REDUCED:
            name = base if src == "topk_mean" else f"{base}_{src}"
            columns.append(F.max(F.when(hit, F.col(src))).alias(name))
    return reduced.groupBy("run_id").agg(*columns)


def metric_summary(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Min, max, mean and population standard deviation, skipping missing values."""
    v = clean(value)
    return df.groupBy(*by).agg(
        F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std")
    )


def top_runs(df: DataFrame, metric: str, n: int, descending: bool = False, tie: Sequence[str] = ("run_id",)) -> DataFrame:
    """The n best runs; missing values last in both directions."""
    v = clean(metric)
    order = v.desc_nulls_last() if descending else v.asc_nulls_last()
    return df.orderBy(order, *tie).limit(n)


def union_runs(parts: Sequence[DataFrame]) -> DataFrame:
    """Append run tables; the schema is the union of their columns."""
    return fold(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
