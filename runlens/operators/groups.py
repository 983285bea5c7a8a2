"""Group run tables by hyper-parameters: leaderboards, extremes, profiles, pivots, marginals."""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.operators.grid import axes_grid, listed_axis, observed_axis
from runlens.operators.reduce import clean
from runlens.session import ship_package


def group_mean_std(df: DataFrame, groups: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Mean, sample standard deviation and non-missing count per group; rows with a missing key are dropped."""
    aggs = []
    for name in values:
        v = clean(name)
        aggs += [
            F.avg(v).alias(f"{name}_mean"),
            F.stddev_samp(v).alias(f"{name}_std"),
            F.count(v).alias(f"{name}_n"),
        ]
    return df.dropna(subset=list(groups)).groupBy(*groups).agg(*aggs)


def group_agg(df: DataFrame, groups: Sequence[str], **aggs: Column) -> DataFrame:
    """Group by the parameters with the caller's own aggregates (built-in, or grouped-aggregate pandas UDFs)."""
    return df.dropna(subset=list(groups)).groupBy(*groups).agg(*[a.alias(name) for name, a in aggs.items()])


class Aggregate:
    """A user's aggregate as partial states: ``update`` takes arrays of values, states are merged in any order.

    States must be picklable and should stay small, whatever the number of rows.
    """

    #: Spark type of what ``finish`` returns.
    returns = "double"

    def init(self):
        raise NotImplementedError

    def update(self, state, *columns: np.ndarray):
        raise NotImplementedError

    def merge(self, state, other):
        raise NotImplementedError

    def finish(self, state):
        return state


#: Groups whose states a task holds before it hands them on.
STATES_AT_ONCE = 50_000


def group_merge(df: DataFrame, groups: Sequence[str], columns: Sequence[str], name: str, aggregate: Aggregate, salts: int = 32) -> DataFrame:
    """Group by the parameters with an ``Aggregate`` of some columns, missing values as NaN; rows with a missing key are dropped.

    A task keeps one state per group, not the group's rows. States meet first by (group, salt) and then by group, so a
    group of any size is a few states for any task. Keys come as they are; an empty table gives an empty result.
    """
    ship_package(df.sparkSession)
    rows = df.dropna(subset=list(groups)).select(*groups, *[clean(c).alias(f"_c{i}") for i, c in enumerate(columns)])
    keys = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*groups).schema)
    values = [f"_c{i}" for i in range(len(columns))]

    def collect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        states: dict = {}
        for pdf in batches:
            for key, part in pdf.groupby(list(groups), sort=False, dropna=False):
                states[key] = aggregate.update(states[key] if key in states else aggregate.init(), *[part[v].to_numpy(dtype=float) for v in values])
            if len(states) > STATES_AT_ONCE:
                yield packed_states(states)
                states = {}
        if states:
            yield packed_states(states)

    def packed_states(states: dict) -> pd.DataFrame:
        out = pd.DataFrame(list(states), columns=list(groups))
        return out.assign(_salt=np.random.default_rng().integers(0, salts, len(out)).astype("int32"), _state=[pickle.dumps(s) for s in states.values()])

    def merge(by: list[str], finish: bool):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            last, state, row = None, None, None
            for pdf in batches:
                done = []
                for key, packed in zip(zip(*[pdf[c] for c in by]), pdf["_state"]):
                    if key == last:
                        state = aggregate.merge(state, pickle.loads(packed))
                    else:
                        if last is not None:
                            done.append((*last, state))
                        last, state = key, pickle.loads(packed)
                if done:
                    yield closed(done, by, finish)
            if last is not None:
                yield closed([(*last, state)], by, finish)

        return run

    def closed(done: list[tuple], by: list[str], finish: bool) -> pd.DataFrame:
        out = pd.DataFrame([d[:-1] for d in done], columns=by)
        if finish:
            return out.assign(**{name: [aggregate.finish(d[-1]) for d in done]})
        return out.assign(_state=[pickle.dumps(d[-1]) for d in done])

    partial = rows.mapInPandas(collect, f"{keys}, _salt int, _state binary")
    first, then = [*groups, "_salt"], list(groups)
    salted = partial.repartition(*first).sortWithinPartitions(*first).mapInPandas(merge(first, False), f"{keys}, _salt int, _state binary")
    whole = salted.drop("_salt").repartition(*then).sortWithinPartitions(*then)
    return whole.mapInPandas(merge(then, True), f"{keys}, `{name}` {aggregate.returns}")


def format_mean_std(mean: Column, std: Column, n: Column | None = None, precision: int = 3, latex: bool = False) -> Column:
    """``m ± s [n]`` or ``$m\\pm s$``. Runs on aggregated rows only; Python rounding, missing prints ``nan``."""

    def plain(m: pd.Series, s: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series([f"{a:.{precision}f} ± {b:.{precision}f} [{c}]" for a, b, c in zip(m, s, k)], dtype="object")

    def tex(m: pd.Series, s: pd.Series) -> pd.Series:
        return pd.Series([rf"${a:.{precision}f}\pm {b:.{precision}f}$" for a, b in zip(m, s)], dtype="object")

    nan = F.lit(float("nan"))
    # the last bits of a distributed sum depend on its order; without them, ties print the same every time
    m, s = F.coalesce(F.round(mean, 9), nan), F.coalesce(F.round(std, 9), nan)
    if latex:
        return F.pandas_udf(tex, "string")(m, s)
    return F.pandas_udf(plain, "string")(m, s, n)


def group_extremes(df: DataFrame, groups: Sequence[str], value: str, by: Sequence[str] = ()) -> DataFrame:
    """Best and worst group mean and the group they belong to; the first group in key order wins ties."""
    means = df.dropna(subset=list(groups)).groupBy(*by, *groups).agg(F.avg(clean(value)).alias("_mean"))
    key = [F.col(g) for g in groups]
    label = lambda s: F.concat_ws(",", *[F.concat(F.lit(f"{g}="), s[g].cast("string")) for g in groups])
    packed = means.where(F.col("_mean").isNotNull()).groupBy(*by).agg(
        F.min(F.struct((-F.col("_mean")).alias("neg"), *key)).alias("_hi"),
        F.min(F.struct(F.col("_mean").alias("val"), *key)).alias("_lo"),
    )
    return packed.select(
        *by,
        (-F.col("_hi")["neg"]).alias("max_val"),
        label(F.col("_hi")).alias("max_at"),
        F.col("_lo")["val"].alias("min_val"),
        label(F.col("_lo")).alias("min_at"),
    )


def profile_params(runs: DataFrame, config: str = "config", extra: Sequence[str] = ()) -> DataFrame:
    """Distinct values of each parameter with run counts; one value makes it conditional, more a sweep variable."""
    items = runs.select(F.explode(F.map_entries(config)).alias("_e")).select(
        F.col("_e.key").alias("param"), F.col("_e.value").alias("value")
    )
    for name in extra:
        items = items.unionByName(runs.select(F.lit(name).alias("param"), F.col(name).cast("string").alias("value")))
    values = items.groupBy("param", "value").agg(F.count(F.lit(1)).alias("n_runs"))
    sizes = values.groupBy("param").agg(F.count(F.lit(1)).alias("n_values"))
    role = F.when((F.col("n_values") > 1) | F.col("param").isin(list(extra)), "sweep").otherwise("conditional")
    return values.join(sizes, "param").withColumn("role", role)


def sweep_variables(runs: DataFrame, config: str = "config", skip: Sequence[str] = ("seed",)) -> list[str]:
    """Names of the parameters that vary (bounded by the number of parameters); the seed is left out."""
    items = runs.select(F.explode(config).alias("param", "value"))
    varied = items.groupBy("param").agg(F.min("value").alias("a"), F.max("value").alias("b")).where("a < b")
    return sorted(r["param"] for r in varied.select("param").collect() if r["param"] not in skip)


def pivot_grid(
    df: DataFrame,
    rows: dict[str, Sequence | None],
    cols: dict[str, Sequence | None],
    value: str,
) -> DataFrame:
    """Every (row, column) cell with mean, sample std and count; cells without runs appear with NULLs and 0.

    A choice list of ``None`` takes the observed values, however many. ``_row`` and ``_col`` give the listing order.
    """
    choices = {**rows, **cols}
    axes = {
        k: observed_axis(df, k, f"_at_{k}") if v is None else listed_axis(df.sparkSession, df, k, v, f"_at_{k}")
        for k, v in choices.items()
    }
    grid = axes_grid(axes, "_cell")
    n_cols = F.lit(1).cast("long")
    for name in cols:
        n_cols = n_cols * F.col(f"_n_{name}")
    cells = group_mean_std(df, list(choices), [value])
    out = grid.join(cells, list(choices), "left")
    return out.select(
        *choices,
        F.call_function("div", F.col("_cell"), n_cols).alias("_row"),
        (F.col("_cell") % n_cols).alias("_col"),
        F.col(f"{value}_mean").alias("mean"),
        F.col(f"{value}_std").alias("std"),
        F.coalesce(f"{value}_n", F.lit(0).cast("long")).alias("n"),
    )


def pivot_wide(cells: DataFrame, rows: Sequence[str], cols: Sequence[str], choices: Sequence[str]) -> DataFrame:
    """Cells spread over columns named by the joined column choices."""
    label = F.concat_ws(",", *[F.col(c).cast("string") for c in cols])
    return cells.withColumn("_label", label).groupBy(*rows).pivot("_label", list(choices)).agg(F.first("mean"))


def pivot_latex(cells: DataFrame, rows: Sequence[str], cols: Sequence[str], precision: int = 2) -> DataFrame:
    """LaTeX lines: ``line_no`` 0 is the header, then one line per row choice."""
    row_name = F.concat_ws(",", *[F.col(c).cast("string") for c in rows])
    col_name = F.concat_ws(",", *[F.col(c).cast("string") for c in cols])
    text = cells.select(
        "_row", "_col", row_name.alias("row_name"), col_name.alias("col_name"),
        format_mean_std(F.col("mean"), F.col("std"), precision=precision, latex=True).alias("cell"),
    )
    head = text.where("_row = 0").groupBy(F.lit(0).cast("long").alias("line_no")).agg(
        F.expr(r"concat(listagg(concat('& ', col_name, ' ')) within group (order by _col), '\\\\ ')").alias("line")
    )
    body = text.groupBy((F.col("_row") + 1).alias("line_no"), "row_name").agg(
        F.expr(r"concat(row_name, listagg(concat('& ', cell)) within group (order by _col), '\\\\ ')").alias("line")
    )
    return head.unionByName(body.select("line_no", "line"))


def marginal_means(df: DataFrame, factors: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """One-way mean of each metric per factor level, all factors in one shuffle."""
    sets = [[f] for f in factors]
    grouped = df.groupingSets(sets, *factors).agg(
        *[F.avg(clean(m)).alias(m) for m in metrics], *[F.grouping(f).alias(f"_g_{f}") for f in factors]
    )
    factor = F.lit(None).cast("string")
    level = F.lit(None).cast("string")
    for f in factors:
        factor = F.when(F.col(f"_g_{f}") == 0, F.lit(f)).otherwise(factor)
        level = F.when(F.col(f"_g_{f}") == 0, F.col(f).cast("string")).otherwise(level)
    return grouped.select(factor.alias("factor"), level.alias("level"), *metrics).where(F.col("level").isNotNull())
