"""Hyper-parameter configs: parse, filter, label, cast. A config is ``MAP<STRING, STRING>``."""

from __future__ import annotations

import json
from collections.abc import Sequence
from functools import reduce as fold

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.functions.columns import base_name, parse_pairs

PREFIX = "override_"
# Parameters left out of the config string.
HIDDEN = ("githash", "sweep_filename")
# States in which a job is still alive.
ACTIVE = ("RUNNING", "PENDING")
RERUN = "rerun:"


def explode_config(runs: DataFrame, overrides: str = "overrides", params: Sequence[str] = ()) -> DataFrame:
    """Overrides (``k=v`` strings) as a ``config`` map, its JSON text, and ``override_k`` columns for ``params``."""
    out = runs.withColumn("config", parse_pairs(F.col(overrides)))
    prefixed = F.transform_keys("config", lambda k, _: F.concat(F.lit(PREFIX), k))
    out = out.withColumn("config_json", F.to_json(prefixed))
    return out.withColumns({PREFIX + p: F.get_json_object("config_json", f"$.{PREFIX}{p}") if "." not in p else F.col("config").getItem(p) for p in params})


def fill_from_config(df: DataFrame, entry: str = "entry", config: str = "config") -> DataFrame:
    """Add the config's parameters to the record map where the record lacks the key."""
    missing = F.map_filter(config, lambda k, _: ~F.map_contains_key(entry, k))
    return df.withColumn(entry, F.map_concat(missing, F.col(entry)))


def parse_condition(text: str) -> dict[str, str]:
    """``{"k": "v"}`` as JSON, else ``k=v,k=v``."""
    try:
        return {k: str(v) for k, v in json.loads(text).items()}
    except (ValueError, AttributeError):
        return {k: v for k, _, v in (item.partition("=") for item in text.split(","))}


def filter_config(runs: DataFrame, wanted: dict[str, str] | str, config: str = "config") -> DataFrame:
    """Keep runs whose config has every wanted value; a missing key drops the run."""
    wanted = parse_condition(wanted) if isinstance(wanted, str) else wanted
    hits = [F.try_element_at(F.col(config), F.lit(k)) == F.lit(str(v)) for k, v in wanted.items()]
    return runs.where(fold(lambda a, b: a & b, hits, F.lit(True)))


def filter_min_points(runs: DataFrame, points: DataFrame, minimum: dict[str, int], known: Sequence[str] | None = None) -> DataFrame:
    """Drop runs with fewer than the asked number of points in any of the metrics.

    Metrics outside ``known`` are ignored, like a column the table does not have.
    """
    minimum = {m: n for m, n in minimum.items() if known is None or m in known}
    if not minimum:
        return runs
    counts = points.where(F.col("metric").isin(list(minimum))).groupBy("run_id", "metric").agg(F.count(F.lit(1)).alias("_n"))
    need = F.lit(0)
    for m, n in minimum.items():
        need = F.when(F.col("metric") == m, F.lit(n)).otherwise(need)
    enough = counts.where(F.col("_n") >= need).groupBy("run_id").agg(F.count(F.lit(1)).alias("_ok"))
    always = sum(n <= 0 for n in minimum.values())
    if always == 0:
        return runs.join(enough.where(F.col("_ok") == len(minimum)), "run_id", "left_semi")
    positive = {m: n for m, n in minimum.items() if n > 0}
    return filter_min_points(runs, points, positive)


def filter_min_length(df: DataFrame, minimum: dict[str, int]) -> DataFrame:
    """``filter_min_points`` for array columns; a scalar counts as one point, an absent column is ignored."""
    for name, n in minimum.items():
        if name in df.columns:
            is_array = df.schema[name].dataType.typeName() == "array"
            df = df.where((F.size(name) if is_array else F.lit(1)) >= n)
    return df


def config_string(config: str | Column = "config") -> Column:
    """``k=v,k=v`` in key order, without the hidden parameters; commas in values become ``_``."""
    shown = F.map_filter(config, lambda k, _: ~k.isin(*HIDDEN))
    pairs = F.transform(
        F.array_sort(F.map_entries(shown)), lambda e: F.concat(e["key"], F.lit("="), F.replace(e["value"], F.lit(","), F.lit("_")))
    )
    return F.array_join(pairs, ",")


def config_columns(df: DataFrame, text: str, groups: Sequence[str]) -> DataFrame:
    """One column per group key from a config string; an absent key gives NULL."""
    parsed = df.withColumn("_map", parse_pairs(F.split(text, ",")))
    return parsed.withColumns({g: F.try_element_at(F.col("_map"), F.lit(g)) for g in groups}).drop("_map", text)


# Type names accepted in a cast list, with their Spark type.
TYPES = {"str": "string", "string": "string", "int": "bigint", "int64": "bigint", "int32": "int", "float": "double",
         "float64": "double", "float32": "float", "double": "double", "bool": "boolean"}


def cast_config(df: DataFrame, types: str, lenient: bool = False) -> DataFrame:
    """Cast columns by ``k=type,...`` (no type: string). A value that does not fit raises unless ``lenient``."""
    for item in types.split(","):
        name, _, kind = item.partition("=")
        kind = TYPES.get(kind or "str", kind)
        df = df.withColumn(name, F.col(name).try_cast(kind) if lenient else F.col(name).cast(kind))
    return df


def match_spec(df: DataFrame, spec: dict[str, str], config: str | None = None) -> DataFrame:
    """Rows equal to the spec on all its keys, over plain columns or over a config map."""
    if config is not None:
        return filter_config(df, spec, config)
    if any(k not in df.columns for k in spec):
        return df.where(F.lit(False))
    return df.where(fold(lambda a, b: a & b, [F.col(k) == F.lit(v) for k, v in spec.items()], F.lit(True)))


def spec_label(keys: Sequence[str]) -> Column:
    """``k=v-k=v`` from the named columns."""
    return F.concat_ws("-", *[F.concat(F.lit(f"{k}="), F.col(k).cast("string")) for k in keys])


def filter_regex(df: DataFrame, column: str, pattern: str) -> DataFrame:
    """Unanchored regular-expression search."""
    return df.where(F.col(column).rlike(pattern))


def filter_active(jobs: DataFrame, rerun_only: bool = False) -> DataFrame:
    """Running or pending jobs; optionally only those whose comment marks a rerun."""
    alive = jobs.where(F.col("state").isin(*ACTIVE))
    return alive.where(F.col("comment").startswith(RERUN)) if rerun_only else alive


def split_factors(df: DataFrame, metrics: Sequence[str], folder: str = "folder") -> tuple[DataFrame, DataFrame]:
    """Separate varying parameters from constant ones.

    Returns the run table with the varying ``override_*`` columns (prefix dropped, ``true``/``false`` as
    ``1``/``0``), the metrics and the folder's number; and a one-row table of the constants.
    """
    params = [c for c in df.columns if c.startswith(PREFIX)]
    ranges = df.agg(
        *[F.min(p).alias(f"a{i}") for i, p in enumerate(params)],
        *[F.max(p).alias(f"b{i}") for i, p in enumerate(params)],
        *[F.bool_or(F.col(p).isNull()).alias(f"n{i}") for i, p in enumerate(params)],
    ).first()
    varies = [
        p for i, p in enumerate(params)
        if ranges[f"a{i}"] != ranges[f"b{i}"] or (ranges[f"n{i}"] and ranges[f"a{i}"] is not None)
    ]
    flag = lambda c: F.when(c == "true", "1").when(c == "false", "0").otherwise(c)
    factors = df.select(
        *[flag(F.col(p)).alias(p[len(PREFIX):]) for p in varies],
        *[flag(F.col(m)).alias(m) if df.schema[m].dataType.typeName() == "string" else F.col(m) for m in metrics],
        base_name(F.col(folder)).cast("long").alias("folder"),
    )
    constants = df.agg(*[F.min(p).alias(p[len(PREFIX):]) for p in params if p not in varies] or [F.lit(None).alias("none")])
    return factors, constants


def select_metric_prefix(df: DataFrame, prefixes: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    return df.select(*keep, *[c for c in df.columns if any(c.startswith(p) for p in prefixes) and c not in keep])
