"""Queries: series reduction, leaderboards, pivots, ranges, unions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.operators import groups, ranges, reduce
from runlens.plans import fixtures as fx
from runlens.plans.registry import query
from runlens.plans.spec import MetricOptions, SweepSpec

METRICS = ("price", "qty")
BEST = MetricOptions(topk_mean=5, descending=True)


def r6(*names: str):
    return {n: F.round(n, 6) for n in names}


def board(spark: SparkSession, sf: str) -> DataFrame:
    """Runs with their parameters and the reduced metrics, one row per run; runs without points keep NULLs."""
    reduced = reduce.reduce_series(fx.points(spark, sf), BEST)
    wide = reduce.wide_metrics(reduced, METRICS).select("run_id", "price", "price_len", "qty", "qty_len")
    return fx.trials(spark, sf).drop("config", "modified_at").join(wide, "run_id", "left")


@query("e01_reduce_series", """
with r as (select *, row_number() over (partition by run_id, metric
               order by case when metric = 'price' then -value else value end,
                        case when metric = 'price' then -pos else pos end) as rk from v_points)
select t.run_id, m.metric, round(avg(r.value) filter (where rk <= case when m.metric = 'price' then 3 else 5 end), 6) as topk_mean,
       max(r.value) filter (where rk = 1) as best, max(r.pos) filter (where rk = 1) as best_idx, count(r.run_id) as len
from v_trials t cross join (values ('price'), ('qty')) m(metric)
left join r on r.run_id = t.run_id and r.metric = m.metric
group by t.run_id, m.metric""")
def e01(spark, sf):
    spec = SweepSpec(common_options={"topk_mean": 5}, specific_options={"price": {"descending": True, "topk_mean": 3}})
    options = {m: spec.options_for(m) for m in METRICS}
    runs = fx.trials(spark, sf).select("run_id")
    return reduce.reduce_series(fx.points(spark, sf), options=options, runs=runs, metrics=METRICS).withColumns(r6("topk_mean"))


@query("e02_reduce_series_at", """
with p as (select *, i.k as iter from v_points join (values (1), (3), (6)) i(k) on pos < i.k),
r as (select *, row_number() over (partition by run_id, metric, iter order by value desc, pos desc) as rk from p),
g as (select run_id, metric, iter, avg(value) filter (where rk <= 2) as topk_mean, max(value) filter (where rk = 1) as best,
             max(pos) filter (where rk = 1) as best_idx, count(*) as len from r group by all)
select t.run_id,
""" + ",\n".join(
    f"round(max(topk_mean) filter (where metric = '{m}' and iter = {k}), 6) as {m}_iter{k}, "
    f"max(best) filter (where metric = '{m}' and iter = {k}) as {m}_iter{k}_best, "
    f"max(best_idx) filter (where metric = '{m}' and iter = {k}) as {m}_iter{k}_best_idx, "
    f"coalesce(max(len) filter (where metric = '{m}' and iter = {k}), 0) as {m}_iter{k}_len"
    for m in METRICS for k in (1, 3, 6)
) + " from v_trials t left join g on g.run_id = t.run_id group by t.run_id")
def e02(spark, sf):
    iters = (1, 3, 6)
    runs = fx.trials(spark, sf).select("run_id")
    reduced = reduce.reduce_series_at(fx.points(spark, sf), iters, MetricOptions(topk_mean=2, descending=True), runs=runs, metrics=METRICS)
    return reduce.wide_metrics(reduced, METRICS, iters).withColumns(r6(*[f"{m}_iter{k}" for m in METRICS for k in iters]))


LEADERBOARD = """
select p_status, p_priority,
       round(avg(price), 6) as price_mean, round(stddev_samp(price), 6) as price_std, count(price) as price_n,
       round(avg(price_len), 6) as price_len_mean, round(stddev_samp(price_len), 6) as price_len_std, count(price_len) as price_len_n
from v_board group by p_status, p_priority"""


@query("e03_group_mean_std", LEADERBOARD)
def e03(spark, sf):
    out = groups.group_mean_std(board(spark, sf), ["p_status", "p_priority"], ["price", "price_len"])
    return out.withColumns(r6("price_mean", "price_std", "price_len_mean", "price_len_std"))


@query("e03_group_report_text", """
select p_status, p_year, printf('%.3f ± %.3f [%d]', round(avg(price), 9), coalesce(round(stddev_samp(price), 9), 'nan'::double), count(price)) as price,
       printf('$%.3f\\pm %.3f$', round(avg(qty), 9), coalesce(round(stddev_samp(qty), 9), 'nan'::double)) as qty
from v_board group by p_status, p_year""")
def e03_text(spark, sf):
    out = groups.group_mean_std(board(spark, sf), ["p_status", "p_year"], ["price", "qty"])
    fmt = groups.format_mean_std
    return out.select(
        "p_status", "p_year",
        fmt(F.col("price_mean"), F.col("price_std"), F.col("price_n")).alias("price"),
        fmt(F.col("qty_mean"), F.col("qty_std"), latex=True).alias("qty"),
    )


ISLANDS = """
d as (select distinct g1, g2, id from base), i as (select *, id - row_number() over (partition by g1, g2 order by id) as grp from d),
r as (select g1, g2, min(id) as lo, max(id) as hi from i group by g1, g2, grp)"""


@query("e04_folder_ranges", f"""
with base as (select p_status as g1, p_priority as g2, run_id as id from v_trials), {ISLANDS},
n as (select g1, g2, count(*) as n from base group by g1, g2)
select g1 as p_status, g2 as p_priority, lo >> 20 as page,
       string_agg(case when hi > lo then lo || '-' || hi else lo::varchar end, ',' order by lo) || '[' || any_value(n) || ']' as folders,
       any_value(n) as n
from r join n using (g1, g2) group by g1, g2, lo >> 20""")
def e04(spark, sf):
    return ranges.folder_ranges(fx.trials(spark, sf), ["p_status", "p_priority"])


@query("e04_id_ranges", f"""
with base as (select sweep as g1, p_status as g2, run_id as id from v_trials), {ISLANDS}
select g1 as sweep, g2 as p_status, lo, hi from r""")
def e04_rows(spark, sf):
    return ranges.id_ranges(fx.trials(spark, sf), ["sweep", "p_status"], "run_id")


@query("e05_compact_ids", f"""
with base as (select 0 as g1, 0 as g2, job_id as id from v_jobs where state = 'FAILED'), {ISLANDS}
select lo >> 20 as page, string_agg(case when hi > lo then lo || '-' || hi else lo::varchar end, ',' order by lo) as ids,
       (select count(*) from base) as n,
       string_agg(case when hi > lo then lo || '-' || hi else lo::varchar end, ',' order by lo) || '[' || (select count(*) from base) || ']' as text
from r group by lo >> 20""")
def e05(spark, sf):
    return ranges.compact_ids(fx.jobs(spark, sf).where("state = 'FAILED'"), "job_id")


@query("e05_bitmap_ids", f"""
with base as (select p_status as g1, 0 as g2, run_id as id from v_trials), {ISLANDS}
select g1 as p_status, lo, hi, (select count(distinct id) from base b where b.g1 = r.g1) as n from r""")
def e05_bitmaps(spark, sf):
    """Id ranges read off mergeable bitmaps, built from two halves as running state would be."""
    t = fx.trials(spark, sf).select("p_status", "run_id", "p_seed")
    halves = [ranges.id_bitmaps(t.where(c), ["p_status"], "run_id") for c in ("p_seed < '3'", "p_seed >= '2'")]
    sets = ranges.merge_bitmaps(halves[0].unionByName(halves[1]), ["p_status"])
    return ranges.bitmap_ranges(sets, ["p_status"]).join(ranges.bitmap_size(sets, ["p_status"]), "p_status")


@query("e06_expand_ids", "select distinct job_id as id from v_jobs where state = 'PENDING'")
def e06(spark, sf):
    pages = ranges.compact_ids(fx.jobs(spark, sf).where("state = 'PENDING'"), "job_id")
    return ranges.expand_ids(pages.select("ids"), "ids")


@query("e07_metric_summary", """
select sweep, metric, round(min(topk_mean), 6) as min, round(max(topk_mean), 6) as max, round(avg(topk_mean), 6) as mean,
       round(stddev_pop(topk_mean), 6) as std
from v_trials join v_reduced using (run_id) group by sweep, metric""")
def e07(spark, sf):
    reduced = reduce.reduce_series(fx.points(spark, sf), BEST)
    named = reduced.join(fx.trials(spark, sf).select("run_id", "sweep"), "run_id")
    return reduce.metric_summary(named, ["sweep", "metric"], "topk_mean").withColumns(r6("min", "max", "mean", "std"))


@query("e08_group_extremes", """
with m as (select metric, p_status, p_priority, avg(topk_mean) as mean from v_trials join v_reduced using (run_id) group by all),
k as (select *, 'p_status=' || p_status || ',p_priority=' || p_priority as label from m)
select metric, round(max(mean), 6) as max_val, (array_agg(label order by mean desc, p_status, p_priority))[1] as max_at,
       round(min(mean), 6) as min_val, (array_agg(label order by mean, p_status, p_priority))[1] as min_at
from k group by metric""")
def e08(spark, sf):
    reduced = reduce.reduce_series(fx.points(spark, sf), BEST)
    named = reduced.join(fx.trials(spark, sf).select("run_id", "p_status", "p_priority"), "run_id")
    return groups.group_extremes(named, ["p_status", "p_priority"], "topk_mean", by=["metric"]).withColumns(r6("max_val", "min_val"))


@query("e09_profile_params", """
with u as (unpivot (select p_status, p_priority, p_year, p_seed, p_const from v_trials) on columns(*) into name param value value),
v as (select param, value, count(*) as n_runs from u group by param, value)
select param, value, n_runs, count(*) over (partition by param) as n_values,
       case when count(*) over (partition by param) > 1 then 'sweep' else 'conditional' end as role
from v""")
def e09(spark, sf):
    return groups.profile_params(fx.trials(spark, sf))


PIVOT_CELLS = """
cells as (select s.v as p_status, y.v as p_year, s.i as _row, y.i as _col
          from (select v, row_number() over (order by v) - 1 as i from (select distinct p_status as v from v_trials)) s
          cross join (values ('1995', 0), ('1997', 1), ('2099', 2)) y(v, i)),
filled as (select c.*, avg(b.price) as mean, stddev_samp(b.price) as std, count(b.price) as n
           from cells c left join v_board b on b.p_status = c.p_status and b.p_year = c.p_year group by all)"""
PIVOT_YEARS = ["1995", "1997", "2099"]


def _pivot(spark, sf):
    return groups.pivot_grid(board(spark, sf), {"p_status": None}, {"p_year": PIVOT_YEARS}, "price")


@query("e10_pivot_table", f"with {PIVOT_CELLS} select p_status, p_year, _row, _col, round(mean, 6) as mean, round(std, 6) as std, n from filled")
def e10(spark, sf):
    return _pivot(spark, sf).withColumns(r6("mean", "std"))


@query("e10_pivot_long_axis", """
with c as (select v as o_custkey, row_number() over (order by v) - 1 as _row from (select distinct o_custkey as v from orders)),
s as (select v as o_orderstatus, row_number() over (order by v) - 1 as _col from (select distinct o_orderstatus as v from orders))
select c.o_custkey, s.o_orderstatus, _row, _col, round(avg(o_totalprice), 6) as mean, round(stddev_samp(o_totalprice), 6) as std, count(o_totalprice) as n
from c cross join s left join orders o on o.o_custkey = c.o_custkey and o.o_orderstatus = s.o_orderstatus group by all""")
def e10_long(spark, sf):
    orders = fx.table(spark, sf, "orders").select("o_custkey", "o_orderstatus", F.col("o_totalprice").cast("double").alias("o_totalprice"))
    return groups.pivot_grid(orders, {"o_custkey": None}, {"o_orderstatus": None}, "o_totalprice").withColumns(r6("mean", "std"))


@query("e10_pivot_wide", f"""with {PIVOT_CELLS}
select p_status, round(max(mean) filter (where p_year = '1995'), 6) as y1995, round(max(mean) filter (where p_year = '1997'), 6) as y1997,
       round(max(mean) filter (where p_year = '2099'), 6) as y2099
from filled group by p_status""")
def e10_wide(spark, sf):
    wide = groups.pivot_wide(_pivot(spark, sf), ["p_status"], ["p_year"], PIVOT_YEARS)
    return wide.select("p_status", *[F.round(y, 6).alias(f"y{y}") for y in PIVOT_YEARS])


@query("e10_pivot_latex", rf"""with {PIVOT_CELLS},
t as (select *, '$' || printf('%.2f', coalesce(round(mean, 9), 'nan'::double)) || '\pm ' || printf('%.2f', coalesce(round(std, 9), 'nan'::double)) || '$' as cell from filled)
select 0 as line_no, string_agg('& ' || p_year || ' ', '' order by _col) || '\\ ' as line from t where _row = 0
union all
select _row + 1, p_status || string_agg('& ' || cell, '' order by _col) || '\\ ' from t group by _row, p_status""")
def e10_latex(spark, sf):
    return groups.pivot_latex(_pivot(spark, sf), ["p_status"], ["p_year"])


@query("e11_marginal_means", """
with g as (select p_status, p_priority, p_year, p_seed, grouping(p_status) as a, grouping(p_priority) as b, grouping(p_year) as c,
                  avg(price) as price, avg(qty) as qty
           from v_board group by grouping sets ((p_status), (p_priority), (p_year), (p_seed)))
select case when a = 0 then 'p_status' when b = 0 then 'p_priority' when c = 0 then 'p_year' else 'p_seed' end as factor,
       coalesce(p_status, p_priority, p_year, p_seed) as level, round(price, 6) as price, round(qty, 6) as qty
from g""")
def e11(spark, sf):
    out = groups.marginal_means(board(spark, sf), ["p_status", "p_priority", "p_year", "p_seed"], METRICS)
    return out.withColumns(r6(*METRICS))


@query("g01_top_runs", """
select run_id, folder, round(price, 6) as price, price_len from v_board order by v_board.price desc nulls last, run_id limit 25""")
def g01(spark, sf):
    top = reduce.top_runs(board(spark, sf).select("run_id", "folder", "price", "price_len"), "price", 25, descending=True)
    return top.withColumns(r6("price"))


@query("h01_union_runs", """
select run_id, p_status, null as p_segment, sweep from v_trials
union all select c_custkey, null, c_mktsegment, 'customers' from customer""")
def h01(spark, sf):
    a = fx.trials(spark, sf).select("run_id", "p_status", "sweep")
    b = fx.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("run_id"), F.col("c_mktsegment").alias("p_segment"), F.lit("customers").alias("sweep")
    )
    return reduce.union_runs([a, b])


class Skewness(groups.Aggregate):
    """Count, mean and central moments, merged by the pairwise formulas."""

    def init(self):
        return 0, 0.0, 0.0, 0.0

    def update(self, state, values):
        v = values[~np.isnan(values)]
        if not len(v):
            return state
        d = v - v.mean()
        return self.merge(state, (len(v), float(v.mean()), float((d * d).sum()), float((d * d * d).sum())))

    def merge(self, a, b):
        n = a[0] + b[0]
        if not n:
            return a
        d = b[1] - a[1]
        squares = a[2] + b[2] + d * d * a[0] * b[0] / n
        cubes = a[3] + b[3] + d**3 * a[0] * b[0] * (a[0] - b[0]) / n**2 + 3 * d * (a[0] * b[2] - b[0] * a[2]) / n
        return n, a[1] + d * b[0] / n, squares, cubes

    def finish(self, state):
        return state[3] / state[0] / (state[2] / state[0]) ** 1.5 if state[2] else None


@query("k05_merge_aggregate", """
with g as (select metric, case when run_id % 3 = 0 then 'hot' else 'r' || run_id % 50 end as grp, value from v_points),
m as (select metric, grp, avg(value) as a from g group by all)
select metric, grp, round(avg(power(value - a, 3)) / power(avg(power(value - a, 2)), 1.5), 6) as skew from g join m using (metric, grp) group by all""")
def k05(spark, sf):
    """A user's aggregate as partial states, with a third of all rows under one key."""
    key = F.when(F.col("run_id") % 3 == 0, "hot").otherwise(F.concat(F.lit("r"), (F.col("run_id") % 50).cast("string")))
    rows = fx.points(spark, sf).withColumn("grp", key)
    return groups.group_merge(rows, ["metric", "grp"], ["value"], "skew", Skewness()).withColumns(r6("skew"))
