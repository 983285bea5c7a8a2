"""Queries: smoothing, resampling, curve means, retention, numbering, admission."""

from __future__ import annotations

from pyspark.sql import functions as F

from runlens.operators import curves, files, grid, quality, reduce, topk
from runlens.plans import fixtures as fx
from runlens.plans.catalog_reduce import BEST, r6
from runlens.plans.registry import query

GRID = [5.0 * i for i in range(0, 12)]


def curve(spark, sf):
    """Price over quantity per run, grouped by the run's status; quantities repeat within a run."""
    lines = fx.ordered_lines(spark, sf).select(
        F.col("l_orderkey").alias("run_id"), F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"), F.col("pos").alias("seq")
    )
    runs = fx.trials(spark, sf).select("run_id", F.col("p_status").alias("group_key"))
    return lines.join(runs, "run_id")


def _moving_average_sql(period: int) -> str:
    left, right = period // 2, (period - 1) // 2
    return f"""
with s as (select run_id, metric, list(value order by pos) as v, count(*) as n from v_points group by run_id, metric),
p as (select *, list_concat(list_concat([v[1] for i in range({left})], v), v[greatest(n - {right} + 1, 1):n + {0 if right else -10**6}]) as padded from s),
r as (select run_id, metric, v, padded, unnest(range(n)) as pos from p)
select run_id, metric, pos, v[pos + 1] as value, round(list_avg(padded[pos + 1:pos + {period}]), 6) as avg from r"""


for _period in (3, 4):

    def _f01(spark, sf, period=_period):
        return curves.moving_average(fx.points(spark, sf), period).withColumns(r6("avg"))

    query(f"f01_moving_average_{_period}", _moving_average_sql(_period))(_f01)


@query("f02_clipped_mean", """
with e as (select unnest([0, 2, 5, 9, 14]) as at), s as (select distinct run_id, metric from v_points)
select s.run_id, s.metric, e.at, round(avg(p.value), 6) as mean
from s cross join e left join v_points p on p.run_id = s.run_id and p.metric = s.metric and abs(e.at - p.pos) <= 2
group by all""")
def f02(spark, sf):
    return curves.clipped_mean(fx.points(spark, sf), [0, 2, 5, 9, 14], span=2).withColumns(r6("mean"))


@query("f02_clipped_mean_everywhere", """
select run_id, metric, pos as at, round(avg(value) over (partition by run_id, metric order by pos rows between 3 preceding and 3 following), 6) as mean
from v_points""")
def f02_all(spark, sf):
    return curves.clipped_mean_all(fx.points(spark, sf), span=3).withColumns(r6("mean"))


RESAMPLED = f"""
own as (select group_key, run_id, x, min_by(y, seq) as y from v_curve group by all),
grid as (select unnest({GRID}) as x), runs as (select distinct group_key, run_id from own),
every as (select group_key, run_id, x, y, true as own from own
          union all select group_key, run_id, g.x, null, false from runs cross join grid g
          where not exists (select 1 from own o where o.run_id = runs.run_id and o.x = g.x)),
ranked as (select *, row_number() over (partition by run_id order by x) as r from every),
around as (select *, last_value(case when own then r end ignore nulls) over b as r0, last_value(y ignore nulls) over b as v0,
                  last_value(case when own then x end ignore nulls) over b as x0,
                  first_value(case when own then r end ignore nulls) over a as r1, first_value(y ignore nulls) over a as v1,
                  first_value(case when own then x end ignore nulls) over a as x1
           from ranked window b as (partition by run_id order by r rows between unbounded preceding and current row),
                              a as (partition by run_id order by r rows between current row and unbounded following)),
resampled as (select group_key, run_id, x, case when r0 is null then null when r1 is null or r1 = r0 then v0
                     else v0 + (v1 - v0) * (r - r0) / (r1 - r0) end as y,
                     case when r0 is null then null when r1 is null or r1 = r0 then v0 else v0 + (v1 - v0) * (x - x0) / (x1 - x0) end as y_by_x
              from around where x in (select x from grid))"""


def _resample(spark, sf, by):
    keys = ["group_key", "run_id"]
    return curves.resample_linear(curves.dedupe_first(curve(spark, sf), keys), GRID, keys, by=by)


@query("f03_resample_linear", f"with {RESAMPLED} select group_key, run_id, x, round(y, 6) as y from resampled")
def f03(spark, sf):
    return _resample(spark, sf, "position").withColumns(r6("y"))


@query("f03_resample_by_x", f"with {RESAMPLED} select group_key, run_id, x, round(y_by_x, 6) as y from resampled")
def f03_x(spark, sf):
    return _resample(spark, sf, "x").withColumns(r6("y"))


@query("f04_dedupe_first", "select group_key, run_id, x, min_by(y, seq) as y from v_curve group by all")
def f04(spark, sf):
    return curves.dedupe_first(curve(spark, sf), ["group_key", "run_id"])


@query("d01_align_curves", """
with own as (select group_key, run_id, x, min_by(y, seq) as y from v_curve group by all),
first as (select group_key, min(run_id) as run_id from own group by group_key)
select o.* from own o where exists (select 1 from own b join first f using (group_key, run_id) where b.group_key = o.group_key and b.x = o.x)""")
def d01(spark, sf):
    return curves.align_curves(curves.dedupe_first(curve(spark, sf), ["group_key", "run_id"]))


@query("e12_curve_mean_std", f"""
with {RESAMPLED}
select group_key, x, round(avg(y), 6) as mean, round(stddev_samp(y), 6) as std, count(y) as n from resampled group by all""")
def e12(spark, sf):
    return curves.curve_mean_std(curve(spark, sf), GRID).withColumns(r6("mean", "std"))


BAND = "avg(value) as m, stddev_pop(value) as s, min(value) as lo, max(value) as hi, count(value) as n from v_points group by metric, pos"


@query("e13_curve_band", f"""
with b as (select metric, pos, {BAND})
select metric, pos, round(m, 6) as mean, round(m - s, 6) as low, round(m + s, 6) as high, n from b""")
def e13(spark, sf):
    return curves.curve_band(fx.points(spark, sf)).withColumns(r6("mean", "low", "high"))


@query("e13_curve_band_minmax", f"with b as (select metric, pos, {BAND}) select metric, pos, round(m, 6) as mean, lo as low, hi as high, n from b")
def e13_minmax(spark, sf):
    return curves.curve_band(fx.points(spark, sf), mode="minmax").withColumns(r6("mean"))


@query("f05_keep_recent", r"""
with p(pattern, re) as (values ('*.html', '^.*\.html$'), ('*[?]*', '^.*[?].*$'), ('?[0-9]*', '^.[0-9].*$')),
m as (select folder, path, mtime, pattern from v_files join p on regexp_matches(regexp_extract(path, '[^/]*$'), re, 's'))
select *, row_number() over (partition by folder, pattern order by mtime desc, path) <= 2 as keep from m""")
def f05(spark, sf):
    return files.keep_recent(fx.files(spark, sf), ["*.html", "*[?]*", "?[0-9]*"], 2)


@query("f06_assign_groups", """
select run_id, row_number() over (order by run_id) - 1 as seq, (row_number() over (order by run_id) - 1) // 7 as group_id from v_trials""")
def f06(spark, sf):
    return grid.assign_groups(fx.trials(spark, sf).select("run_id"), "run_id", 7)


@query("f06_assign_groups_shuffled", """
with h as (select run_id, row_number() over (order by md5('11:' || run_id), run_id) - 1 as seq from v_trials)
select run_id, seq, seq // 16 as group_id from h""")
def f06_shuffled(spark, sf):
    return grid.assign_groups(fx.trials(spark, sf).select("run_id"), "run_id", 16, seed=11)


@query("f07_topk_admission", """
with r as (select a.run_id, a.metric, a.pos, a.value, count(b.value) filter (where b.value >= a.value) as better,
                  list_sort(list(b.value) filter (where b.value is not null), 'desc') as seen
           from v_points a left join v_points b on b.run_id = a.run_id and b.metric = a.metric and b.pos < a.pos
           group by all)
select run_id, metric, pos, value, better < 3 as admitted, seen[3] as worst from r""")
def f07(spark, sf):
    return topk.topk_admission(fx.points(spark, sf), 3)


@query("d07_table_diff", """
with a as (select run_id, metric, topk_mean as v from v_reduced),
b as (select run_id, metric, avg(value) as v from v_points group by all having count(*) > 2)
select run_id, metric, round(a.v, 6) as v_a, round(b.v, 6) as v_b, case when b.run_id is null then 'only_a' else 'differs' end as status
from a left join b using (run_id, metric) where b.run_id is null or abs(a.v - b.v) >= 0.001""")
def d07(spark, sf):
    points = fx.points(spark, sf)
    a = reduce.reduce_series(points, BEST).withColumnRenamed("topk_mean", "v")
    b = points.groupBy("run_id", "metric").agg(F.avg("value").alias("v"), F.count(F.lit(1)).alias("n")).where("n > 2")
    return quality.table_diff(a, b, ["run_id", "metric"], ["v"], eps=0.001).withColumns(r6("v_a", "v_b"))
