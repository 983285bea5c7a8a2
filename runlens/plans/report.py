"""The report of a sweep: reduced metrics, grouped table, best runs, summary and pivot cells, as its specification says."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.operators.groups import group_mean_std, pivot_grid, profile_params
from runlens.operators.reduce import clean, reduce_series, top_runs, wide_metrics
from runlens.plans.spec import MetricOptions, SweepSpec


def parse_axes(text: str) -> tuple[dict[str, list[str] | None], dict[str, list[str] | None]]:
    """Row and column axes from a text such as ``A=[1,2],B/C``: the part before ``/`` names the rows.

    ``B`` alone takes the observed values.
    """
    if text.count("/") != 1:
        raise ValueError("axes need one '/' between rows and columns")
    sides = []
    for side in text.split("/"):
        axes: dict[str, list[str] | None] = {}
        for name, listed in re.findall(r"([^,=\[\]]+)(?:=\[([^\]]*)\])?(?:,|$)", side.strip()):
            axes[name.strip()] = [v.strip() for v in listed.split(",")] if listed else None
        if not axes:
            raise ValueError(f"no axis in {side!r}")
        sides.append(axes)
    return sides[0], sides[1]


def reduce_by_spec(points: DataFrame, spec: SweepSpec, metrics: Sequence[str] | None = None) -> DataFrame:
    """One row per run with the spec's metrics reduced by their own options.

    A metric of maps needs a ``subkey``: the number under that key is reduced; a map without the key is an error.
    """
    names = list(metrics or spec.default_metrics)
    options: dict[str, MetricOptions] = {m: spec.options_for(m) for m in names}
    if points.schema["value"].dataType.typeName() == "map":
        missing = F.raise_error(F.concat(F.lit("missing subkey for "), "metric")).cast("double")
        value = missing
        for m, o in options.items():
            if o.subkey is not None:
                held = F.map_contains_key("value", F.lit(o.subkey))
                value = F.when((F.col("metric") == m) & held, F.try_element_at("value", F.lit(o.subkey)).cast("double")).otherwise(value)
        points = points.where(F.col("metric").isin(names)).withColumn("value", value)
    return wide_metrics(reduce_series(points, MetricOptions(), options, metrics=names), names)


def report(
    runs: DataFrame, points: DataFrame, spec: SweepSpec, groups: Sequence[str], axes: str | None = None, config: str | None = None
) -> dict[str, DataFrame]:
    """Tables of a report over ``runs(run_id, parameters...)``; filter the runs first.

    ``groups``: mean, std and n of each metric by the parameters in the spec's order; ``top``: the best runs of the first
    metric, as many as its ``topk``; ``summary``: mean, population std, min, max and n per metric; ``cells``: the pivot of the
    first metric over ``axes``; ``params``: the profile of the ``config`` map. Nothing runs until a table is used.
    """
    metrics = list(spec.default_metrics)
    first = spec.options_for(metrics[0])
    board = runs.join(reduce_by_spec(points, spec), "run_id", "left")
    out = {
        "board": board,
        "groups": group_mean_std(board, spec.order_groups(list(groups)), metrics),
        "top": top_runs(board, metrics[0], first.topk, first.descending),
    }
    long = board.select(F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), clean(m).alias("_v")) for m in metrics])))
    out["summary"] = long.groupBy("metric").agg(
        F.avg("_v").alias("mean"), F.stddev_pop("_v").alias("std"), F.min("_v").alias("min"), F.max("_v").alias("max"), F.count("_v").alias("n")
    )
    if axes is not None:
        rows, cols = parse_axes(axes)
        out["cells"] = pivot_grid(board, rows, cols, metrics[0])
    if config is not None:
        out["params"] = profile_params(runs, config)
    return out
