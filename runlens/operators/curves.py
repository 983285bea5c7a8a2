"""Moving averages, resampling onto a shared grid, and mean curves across runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runlens.operators.blocks import BLOCK, DEFAULT_BITS, with_halo
from runlens.operators.reduce import clean

SERIES = ("run_id", "metric")


def moving_average(points: DataFrame, period: int, keys: Sequence[str] = SERIES, bits: int = DEFAULT_BITS) -> DataFrame:
    """Centred mean of the same length as the series.

    Padding: ``period // 2`` copies of the first value on the left, the last ``(period - 1) // 2`` values in
    order on the right. Positions are dense from 0. Windows run per block of positions with a halo, and the
    right padding is a top-k per series, so a series of any length is spread over tasks.
    """
    left, right = period // 2, (period - 1) // 2
    base = points.select(*keys, F.col("pos").cast("long").alias("pos"), clean("value").alias("value"))
    parts = [base.withColumn("_pad", F.lit(False))]
    if left:
        # left padding sits at negative positions; shift everything right so blocks start at 0
        parts.append(
            base.where("pos = 0")
            .withColumn("pos", F.explode(F.sequence(F.lit(-left).cast("long"), F.lit(-1).cast("long"))))
            .withColumn("_pad", F.lit(True))
        )
    if right:
        tail = base.withColumn("_rk", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("pos"))))
        parts.append(
            tail.where(F.col("_rk") <= right).drop("_rk").withColumn("pos", F.col("pos") + right).withColumn("_pad", F.lit(True))
        )
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    rows = with_halo(rows.withColumn("_at", F.col("pos") + left), "_at", left, right, bits)
    frame = Window.partitionBy(*keys, BLOCK).orderBy("_at").rowsBetween(-left, right)
    return rows.withColumn("avg", F.avg("value").over(frame)).where(F.col("_own") & ~F.col("_pad")).select(*keys, "pos", "value", "avg")


def clipped_mean(
    points: DataFrame, at: Sequence[int], span: int = 20, keys: Sequence[str] = SERIES
) -> DataFrame:
    """Mean over positions ``[at - span, at + span]`` cut to the series; NULL where nothing is left."""
    epochs = F.array(*[F.lit(int(e)).cast("long") for e in at])
    near = F.filter(epochs, lambda e: F.abs(e - F.col("pos")) <= span)
    means = (
        points.select(*keys, F.explode(near).alias("at"), clean("value").alias("_v"))
        .groupBy(*keys, "at")
        .agg(F.avg("_v").alias("mean"))
    )
    frame = points.select(*keys).distinct().withColumn("at", F.explode(epochs))
    return frame.join(means, [*keys, "at"], "left")


def clipped_mean_all(points: DataFrame, span: int = 20, keys: Sequence[str] = SERIES, bits: int = DEFAULT_BITS) -> DataFrame:
    """``clipped_mean`` at every position of the series."""
    rows = with_halo(points.select(*keys, F.col("pos").cast("long").alias("pos"), clean("value").alias("value")), "pos", span, span, bits)
    frame = Window.partitionBy(*keys, BLOCK).orderBy("pos").rowsBetween(-span, span)
    return rows.withColumn("mean", F.avg("value").over(frame)).where("_own").select(*keys, F.col("pos").alias("at"), "mean")


def dedupe_first(curve: DataFrame, keys: Sequence[str], x: str = "x", y: str = "y", seq: str = "seq") -> DataFrame:
    """First y per x in arrival order."""
    return curve.groupBy(*keys, x).agg(F.min_by(y, seq).alias(y))


def resample_linear(
    curve: DataFrame, grid: Sequence[float], keys: Sequence[str], x: str = "x", y: str = "y", by: str = "position"
) -> DataFrame:
    """Values of each curve at the grid points, filled linearly between its own points.

    ``by="position"`` spaces the fill by row position in the union of own and grid points, ``by="x"`` by
    x itself. Before the first own point the value is NULL, after the last one it stays constant. x must
    be unique per curve.

    Own points are first folded to at most one row per curve and grid interval (first and last point in
    it), which is a partial aggregate; the per-curve window then sees no more rows than the grid has.
    """
    grid = sorted(set(float(g) for g in grid))
    size = len(grid)
    points = F.array(*[F.lit(g) for g in grid])
    own = curve.select(*keys, F.col(x).cast("double").alias("_x"), clean(y).alias("_y")).where(
        F.col("_y").isNotNull() & F.col("_x").isNotNull() & ~F.isnan("_x")
    )
    splits = [float("-inf"), *grid, float("inf")]
    own = Bucketizer(splits=splits, inputCol="_x", outputCol="_b").transform(own)
    upto = F.col("_b").cast("int")  # grid points <= x
    exact = F.coalesce(F.get(points, upto - 1) == F.col("_x"), F.lit(False))
    own = own.withColumn("_cell", F.when(exact, upto - 1).otherwise(upto))  # grid points < x
    cells = own.groupBy(*keys, "_cell").agg(
        F.min(F.struct("_x", "_y")).alias("_first"), F.max(F.struct("_x", "_y")).alias("_last")
    )
    w = Window.partitionBy(*keys).orderBy("_cell")
    cells = (
        cells.withColumn("_next_cell", F.lead("_cell").over(w))
        .withColumn("_next", F.lead("_first").over(w))
        .withColumn("_start", F.when(F.lag("_cell").over(w).isNull(), F.lit(0)).otherwise(F.col("_cell")))
        .withColumn("_stop", F.coalesce(F.col("_next_cell"), F.lit(size)) - 1)
        .withColumn("_stop", F.least("_stop", F.lit(size - 1)))
    )
    i = F.col("_i")
    hit = F.coalesce(F.get(points, F.col("_cell")) == F.col("_last._x"), F.lit(False))
    after = F.col("_cell") + hit.cast("int")  # first grid index beyond the last own point
    gx = F.get(points, i)
    if by == "position":
        share = (i - after + 1) / (F.col("_next_cell") - after + 1)
    else:
        share = (gx - F.col("_last._x")) / (F.col("_next._x") - F.col("_last._x"))
    filled = (
        F.when(i < F.col("_cell"), F.lit(None).cast("double"))
        .when(hit & (i == F.col("_cell")), F.col("_last._y"))
        .when(F.col("_next").isNull(), F.col("_last._y"))
        .otherwise(F.col("_last._y") + (F.col("_next._y") - F.col("_last._y")) * share)
    )
    return (
        cells.where("_start <= _stop")
        .withColumn("_i", F.explode(F.sequence("_start", "_stop")))
        .select(*keys, gx.alias(x), filled.alias(y))
    )


def align_curves(curves: DataFrame, group: str = "group_key", run: str = "run_id", x: str = "x") -> DataFrame:
    """Keep, per group, the x values of its first run; a run without a value at such an x has no row."""
    first = curves.groupBy(group).agg(F.min(run).alias(run))
    base = curves.join(first, [group, run], "left_semi").select(group, x)
    return curves.join(base, [group, x], "left_semi")


def curve_mean_std(
    curve: DataFrame, grid: Sequence[float], group: str = "group_key", run: str = "run_id", seq: str = "seq", by: str = "position"
) -> DataFrame:
    """Per group and grid point: mean and sample standard deviation across runs, skipping missing values."""
    keys = [group, run]
    resampled = resample_linear(dedupe_first(curve, keys, seq=seq), grid, keys, by=by)
    return resampled.groupBy(group, "x").agg(
        F.avg("y").alias("mean"), F.stddev_samp("y").alias("std"), F.count("y").alias("n")
    )


def curve_band(points: DataFrame, by: Sequence[str] = ("metric",), mode: str = "std") -> DataFrame:
    """Per position: mean with a band of population std, or of min and max."""
    v = clean("value")
    stats = points.groupBy(*by, "pos").agg(
        F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"), F.count(v).alias("n")
    )
    low, high = (F.col("mean") - F.col("std"), F.col("mean") + F.col("std")) if mode == "std" else (F.col("min"), F.col("max"))
    return stats.select(*by, "pos", "mean", low.alias("low"), high.alias("high"), "n")
