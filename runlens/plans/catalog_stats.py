"""Queries: value summaries, counters, timing, cross-correlation, spectra."""

from __future__ import annotations

from pyspark.sql import functions as F

from runlens.operators import stats
from runlens.operators.blocks import dense_positions
from runlens.plans import fixtures as fx
from runlens.plans.catalog_reduce import r6
from runlens.plans.registry import query

DESCRIBED = "count(value) as n, min(value) as min, max(value) as max, round(avg(value), 6) as mean, round(median(value), 6) as median"


@query("e14_describe_values", f"select metric, {DESCRIBED} from v_points group by metric")
def e14(spark, sf):
    return stats.describe_values(fx.points(spark, sf), "value", ["metric"]).withColumns(r6("mean", "median"))


@query("e14_describe_column", f"with v as (select l_discount as value from lineitem) select {DESCRIBED} from v")
def e14_column(spark, sf):
    return stats.describe_values(fx.table(spark, sf, "lineitem"), "l_discount").withColumns(r6("mean", "median"))


def arrivals(spark, sf):
    """Log values with their arrival number, counted for each folder and type."""
    log = fx.table(spark, sf, "events").select(F.col("user_id").alias("folder"), "event_type", "ts", "event_id", "value")
    return dense_positions(log, ["folder", "event_type"], ["ts", "event_id"], F.date_trunc("day", "ts")).drop("ts", "event_id")


VALUE_STATS = """
with a as (select folder, event_type, value, row_number() over (partition by folder, event_type order by line_no) - 1 as pos from v_log),
s as (select folder, event_type, count(*) as n, avg(value) as mean, avg(value * value) as sq, min(value) as lo, max(value) as hi from a group by all)
select folder, event_type, s.n, round(mean * f, 6) as mean, round(sqrt(sq - mean * mean + 1e-6) / sqrt(s.n) * f, 6) as stderr,
       round(lo * f, 6) as min, max(pos) filter (where value = lo) as min_idx, round(hi * f, 6) as max, max(pos) filter (where value = hi) as max_idx
from s join a using (folder, event_type), lateral (select case event_type when 'click' then 100.0 else 1.0 end as f)
group by folder, event_type, s.n, mean, sq, lo, hi, f"""


@query("e15_value_stats", VALUE_STATS)
def e15(spark, sf):
    out = stats.value_stats(arrivals(spark, sf), ["folder", "event_type"], multipliers={"click": 100.0})
    return out.withColumns(r6("mean", "stderr", "min", "max"))


@query("e16_counter_share", """
select event_type, count(*) as n, (select count(*) from v_log) as total, round(count(*) / (select count(*) from v_log), 9) as share
from v_log group by event_type""")
def e16(spark, sf):
    return stats.counter_share(fx.table(spark, sf, "events"), "event_type").withColumn("share", F.round("share", 9))


@query("e17_step_timing", """
with g as (select folder, event_type, line_no, coalesce(epoch_us(ts) - epoch_us(lag(ts) over (partition by folder order by line_no)), 0) / 1000.0 as gap from v_log),
k as (select folder, event_type, count(*) as n, sum(gap) as s from g group by all),
t as (select folder, sum(s) as total, min(n) as least, min(n) = max(n) as balanced from k group by folder)
select folder, event_type, n, round(s / n, 6) as mean_ms, round(100.0 * s / total, 6) as share_pct,
       round(case when balanced then total / least end, 6) as iter_ms, balanced
from k join t using (folder)""")
def e17(spark, sf):
    out = stats.step_timing(fx.log_lines(spark, sf).select("folder", "line_no", "ts", "event_type"), ["folder"], "event_type")
    return out.withColumns(r6("mean_ms", "share_pct", "iter_ms"))


def halves(spark, sf):
    e = F.col("embedding")
    return fx.features(spark, sf).select(F.slice(e, 1, 32).alias("teacher"), F.slice(e, 33, 32).alias("student"), F.slice(e, 17, 32).alias("middle"))


def _corr_sql(name: str, offset: int) -> str:
    return f"""
{name}_x as (select vec_id, unnest(range(32)) as i, unnest(embedding[1:32])::double as x from embeddings),
{name}_y as (select vec_id, unnest(range(32)) as j, unnest(embedding[{offset + 1}:{offset + 32}])::double as y from embeddings),
{name}_s as (select i, j, count(*) as n, avg(x * y) - avg(x) * avg(y) as cov, sqrt(greatest(avg(x * x) - avg(x) * avg(x), 0)) as tn,
             sqrt(greatest(avg(y * y) - avg(y) * avg(y), 0)) as sn from {name}_x join {name}_y using (vec_id) group by i, j),
{name} as (select i, j, n, case when tn * sn < 1e-6 and abs(cov) < 1e-6 then 0 else greatest(-1, least(1, cov / (tn * sn))) end as r,
           tn as t_norm, sn as s_norm from {name}_s)"""


@query("e18_cross_corr", f"with {_corr_sql('c', 32)} select i, j, n, round(r, 6) as r, round(t_norm, 6) as t_norm, round(s_norm, 6) as s_norm from c")
def e18(spark, sf):
    return stats.cross_corr(halves(spark, sf), "teacher", "student").withColumns(r6("r", "t_norm", "s_norm"))


@query("e19_best_match", f"""
with {_corr_sql('c', 32)}, {_corr_sql('d', 16)},
b as (select i, arg_max(j, struct_pack(r := r, j := -j)) as best_j, max(r) as best_r from c group by i),
o as (select i, max(r) as old from d group by i)
select i, best_j, round(best_r, 6) as best_r, round(best_r - old, 6) as delta from b join o using (i)""")
def e19(spark, sf):
    h = halves(spark, sf)
    last = stats.best_match(stats.cross_corr(h, "teacher", "middle"))
    return stats.best_match(stats.cross_corr(h, "teacher", "student"), last).withColumns(r6("best_r", "delta"))


@query("e20_gram_matrix", """
with d as (select len(embedding) as n from embeddings limit 1), i as (select unnest(range((select n from d)::int)) as i), j as (select i as j from i)
select i.i::int as i, j.j::int as j, round(avg(embedding[i.i + 1]::double * embedding[j.j + 1]::double), 6) as value from embeddings, i, j group by all""")
def e20(spark, sf):
    return stats.gram_matrix(fx.features(spark, sf), "embedding").withColumns(r6("value"))


@query("e18_tiles", f"with {_corr_sql('c', 32)} select i, j, n, round(r, 6) as r, round(t_norm, 6) as t_norm, round(s_norm, 6) as s_norm from c")
def e18_tiles(spark, sf):
    """The same correlations tile by tile, as for features too wide for one matrix in a task."""
    return stats.cross_corr_tiled(halves(spark, sf), "teacher", "student", tile=10).withColumns(r6("r", "t_norm", "s_norm"))


# trace and squared norm of the matrix are its eigenvalues' sum and sum of squares: SQL can check the whole spectrum by them
@query("e20_top_eigen", """
with d as (select len(embedding) as n from embeddings limit 1), i as (select unnest(range((select n from d)::int)) as i), j as (select i as j from i),
g as (select i.i, j.j, avg(embedding[i.i + 1]::double * embedding[j.j + 1]::double) as v from embeddings, i, j group by all)
select round(sum(v) filter (i = j), 6) as total, round(sum(v * v), 6) as squares, count(*) filter (i = j) as n from g""")
def e20_top(spark, sf):
    n = fx.features(spark, sf).select(F.size("embedding")).first()[0]
    values = stats.top_eigen(fx.features(spark, sf), "embedding", n).select("rank", "value").distinct()
    return values.agg(F.round(F.sum("value"), 6).alias("total"), F.round(F.sum(F.col("value") * F.col("value")), 6).alias("squares"), F.count(F.lit(1)).alias("n"))
