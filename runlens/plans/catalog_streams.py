"""Queries: the streaming jobs, run over the test tables until all input is consumed."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from runlens.operators import groups, stats, topk
from runlens.operators.reduce import wide_metrics
from runlens.plans import fixtures as fx
from runlens.plans.catalog_jobs import JOB_FIELDS, job_table
from runlens.plans.catalog_logs import FIELDS, VALUE
from runlens.plans.catalog_reduce import BEST, LEADERBOARD, METRICS, r6
from runlens.plans.catalog_stats import VALUE_STATS, _corr_sql, arrivals, halves
from runlens.plans.registry import query
from runlens.plans.spec import Capture, Rule
from runlens.session import cut, work_dir
from runlens.streaming import jobs as live_jobs
from runlens.streaming import points as live_points


def feed(spark: SparkSession, base: str, parts: Sequence[DataFrame], launch: Callable[[DataFrame], StreamingQuery]) -> None:
    """Let the parts arrive one after the other; after each, the job resumes from its checkpoint and catches up."""
    for part in parts:
        part.write.mode("append").parquet(f"{base}/in")
        launch(spark.readStream.schema(part.schema).parquet(f"{base}/in")).awaitTermination()


@query("j01_track_jobs", """
select job_id, case when job_id % 11 = 0 then 'USER_CANCELLED' when state = 'PENDING' then 'COMPLETED' else state end as state,
       case when job_id % 11 = 0 or state = 'PENDING' then 'finished' else 'retry' end as action
from v_jobs join v_trials on run_id = job_id and p_seed <> '4' where state <> 'RUNNING' or job_id % 11 = 0""")
def j01(spark, sf):
    base = work_dir(spark, "j01")
    j = fx.jobs(spark, sf).select("job_id", "state")
    rows = lambda cond, state, seq: j.where(cond).select("job_id", state.alias("state"), F.lit(seq).cast("long").alias("seq"))
    same = F.col("state")
    tracked = fx.trials(spark, sf).where("p_seed <> '4'").select(F.col("run_id").alias("job_id"))
    parts = [
        rows("job_id % 11 = 0", F.lit(live_jobs.USER_CANCEL), 0).unionByName(rows("state <> 'PENDING'", same, 1)),
        rows("true", F.when(same == "PENDING", "COMPLETED").otherwise(same), 2),
        rows("state = 'FAILED'", F.lit("COMPLETED"), 3),
    ]
    feed(spark, base, parts, lambda s: live_jobs.track_jobs(s, f"{base}/out", f"{base}/cp", tracked))
    return live_jobs.read_finished(spark, f"{base}/out")


@query("j01_recent_jobs", """
select job_id, case when state = 'PENDING' then 'COMPLETED' else state end as state, case when state = 'PENDING' then 'finished' else 'retry' end as action,
       state = 'PENDING' and modified_at < timestamp '1994-01-01' as late
from v_jobs join v_trials on run_id = job_id where state <> 'RUNNING'""")
def j01_recent(spark, sf):
    """Jobs of two years are remembered; what ended before that and comes late is told apart and changes nothing."""
    base = work_dir(spark, "j01r")
    j = fx.jobs(spark, sf).join(fx.trials(spark, sf).select(F.col("run_id").alias("job_id"), F.col("modified_at").cast("timestamp").alias("at")), "job_id")
    rows = lambda cond, state, seq: j.where(cond).select("job_id", state.alias("state"), F.lit(seq).cast("long").alias("seq"), "at")
    clock = j.select(F.lit(-1).cast("long").alias("job_id"), F.lit("RUNNING").alias("state"), F.lit(0).cast("long").alias("seq"), F.lit("1996-01-01").cast("timestamp").alias("at")).limit(1)
    done = F.lit("COMPLETED")
    parts = [
        rows("state <> 'PENDING' and at < '1996-01-01'", F.col("state"), 1).unionByName(clock),
        rows("state <> 'PENDING'", F.col("state"), 2).unionByName(rows("state = 'PENDING'", done, 2)).where("at < '1996-01-01' or state <> 'RUNNING'"),
        rows("state = 'FAILED' and at >= '1998-06-01'", done, 3),
    ]
    feed(spark, base, parts, lambda s: live_jobs.track_recent_jobs(s, "730 days", f"{base}/out", f"{base}/cp"))
    finished, late = live_jobs.read_recent(spark, f"{base}/out")
    lost = late.join(finished.select("job_id"), "job_id", "left_anti").select("job_id", "state", F.lit("finished").alias("action"), F.lit(True).alias("late"))
    return finished.select("job_id", "state", "action", F.lit(False).alias("late")).unionByName(lost)


ARMED = (
    Rule(rf"\[view\] step=(\d+) {VALUE}", (Capture("view_value", 2),), arm=r"^\[click\]"),
    Rule(rf"\[purchase\] step=(\d+) {VALUE}", (Capture("bought", 2),)),
)


@query("j03_live_logs", f"""
with {FIELDS}, k as (select *, lag(event_type) over (partition by folder order by line_no) as before from f where event_type in ('view', 'click')),
p as (select folder, 'view_value' as metric, line_no, val from k where event_type = 'view' and before = 'click'
      union all select folder, 'bought', line_no, val from f where event_type = 'purchase'),
r as (select *, row_number() over (partition by folder, metric order by line_no) - 1 as pos from p),
o as (select *, row_number() over (partition by folder, metric order by val desc, pos desc) as rk from r)
select folder::varchar as folder, metric, round(avg(val) filter (rk <= 5), 6) as topk_mean, max(val) filter (rk = 1) as best, max(pos) filter (rk = 1) as best_idx, count(*) as len
from o group by folder, metric""")
def j03_logs(spark, sf):
    """Logs grow in three steps; every fifth one holds other lines first and is started again in the second step."""
    base = work_dir(spark, "j03l")
    rows = cut(fx.log_lines(spark, sf).select(F.col("folder").cast("string").alias("folder"), F.col("line_no").alias("offset"), "line"))
    again, early, middle = F.col("folder").cast("long") % 5 == 0, F.col("offset") < 10, F.col("offset") < 25
    first = rows.where(middle & again).withColumn("line", F.concat(F.lit("[click]"), F.regexp_replace("line", r"value=", "value=9"))).unionByName(rows.where(early & ~again))
    parts = [first, rows.where(middle & (again | ~early)), rows.where(~middle)]
    feed(spark, base, parts, lambda s: live_points.live_logs(s, ARMED, f"{base}/out", f"{base}/cp", BEST))
    return live_points.read_live_logs(spark, f"{base}/out", BEST).withColumns(r6("topk_mean"))


@query("j03_live_leaderboard", LEADERBOARD)
def j03(spark, sf):
    base = work_dir(spark, "j03")
    # ordered once for both parts
    fx.ordered_lines(spark, sf).select("l_orderkey", "pos", *fx.POINT_VALUES.values()).write.parquet(f"{base}/lines")
    points = fx.points_of(spark.read.parquet(f"{base}/lines"))
    parts = [points.where("pos >= 3"), points.where("pos < 3")]
    feed(spark, base, parts, lambda s: live_points.live_leaderboard(s, f"{base}/out", f"{base}/cp", BEST))
    wide = wide_metrics(live_points.read_leaderboard(spark, f"{base}/out", BEST), METRICS)
    board = fx.trials(spark, sf).select("run_id", "p_status", "p_priority").join(wide, "run_id", "left")
    out = groups.group_mean_std(board, ["p_status", "p_priority"], ["price", "price_len"])
    return out.withColumns(r6("price_mean", "price_std", "price_len_mean", "price_len_std"))


@query("j04_live_value_stats", VALUE_STATS.replace("when 'click' then 100.0 else 1.0", "when 'none' then 100.0 else 1.0"))
def j04(spark, sf):
    base = work_dir(spark, "j04")
    rows = arrivals(spark, sf)
    parts = [rows.where("value > 50"), rows.where("value <= 50 or value is null")]
    by = ["folder", "event_type"]
    feed(spark, base, parts, lambda s: live_points.live_value_stats(s, by, f"{base}/out", f"{base}/cp"))
    return live_points.read_value_stats(spark, f"{base}/out", by).withColumns(r6("mean", "stderr", "min", "max"))


@query("j04_daily_value_stats", """
with e as (select date_trunc('day', ts)::date as day, event_id as pos, value from events where value is not null),
s as (select day, count(*) as n, avg(value) as mean, var_pop(value) as var, min(value) as lo, max(value) as hi from e group by day)
select strftime(s.day, '%Y-%m-%d') as day, s.n, round(mean, 6) as mean, round(sqrt(var + 1e-6) / sqrt(s.n), 6) as stderr, round(lo, 6) as min,
       max(pos) filter (where value = lo) as min_idx, round(hi, 6) as max, max(pos) filter (where value = hi) as max_idx
from s join e using (day) group by all""")
def j04_daily(spark, sf):
    """One report a day; the watermark closes a day's state once the next day is over."""
    base = work_dir(spark, "j04d")
    day = F.date_trunc("day", F.col("ts").cast("timestamp"))
    rows = fx.table(spark, sf, "events").select(day.alias("day"), F.col("event_id").alias("pos"), "value")
    parts = [rows.where(F.dayofmonth("day") <= 10), rows.where(F.dayofmonth("day").between(11, 20)), rows.where(F.dayofmonth("day") > 20)]
    feed(spark, base, parts, lambda s: live_points.live_value_stats(s, ["day"], f"{base}/out", f"{base}/cp", watermark=("day", "1 day")))
    found = live_points.read_value_stats(spark, f"{base}/out", ["day"])
    return found.withColumn("day", F.date_format("day", "yyyy-MM-dd")).withColumns(r6("mean", "stderr", "min", "max"))


@query("j05_live_cross_corr", f"with {_corr_sql('c', 32)} select i, j, n, round(r, 6) as r, round(t_norm, 6) as t_norm, round(s_norm, 6) as s_norm from c")
def j05(spark, sf):
    base = work_dir(spark, "j05")
    h = halves(spark, sf).withColumn("half", F.get("teacher", F.lit(0)) > 0)
    parts = [h.where("half"), h.where("not half")]
    feed(spark, base, parts, lambda s: live_points.live_cross_corr(s, "teacher", "student", f"{base}/out", f"{base}/cp"))
    return stats.corr_from_sums(live_points.read_corr_sums(spark, f"{base}/out")).withColumns(r6("r", "t_norm", "s_norm"))


KEPT_3 = """
a as (select a.run_id, a.metric, a.pos, a.value from v_points a left join v_points b on b.run_id = a.run_id and b.metric = a.metric and b.pos < a.pos
group by all having count(b.value) filter (where b.value >= a.value) < 3)"""


@query("j06_live_topk", f"with {KEPT_3} select * from a")
def j06(spark, sf):
    base = work_dir(spark, "j06")
    points = cut(fx.points(spark, sf))
    parts = [points.where("pos < 2"), points.where("pos between 2 and 4"), points.where("pos > 4")]
    feed(spark, base, parts, lambda s: live_points.live_topk(s, 3, f"{base}/out", f"{base}/cp"))
    return live_points.read_topk(spark, f"{base}/out")[0].drop("slot")


# every slot's last write: the three best of a series, the earlier ones of equal scores; slots 0 to 2 are all taken once three scores came
@query("j06_slots", f"""
with {KEPT_3},
r as (select *, row_number() over (partition by run_id, metric order by value desc, pos) as rk from a)
select run_id, metric, count(*) as n_slots, count(*) * (count(*) - 1) // 2 as slot_sum, round(sum(value), 6) as total from r where rk <= 3 group by all""")
def j06_slots(spark, sf):
    """Slots of the stored series, in batch, and what they hold in the end."""
    flagged = topk.topk_admission(fx.points(spark, sf), 3)
    held = topk.kept_slots(topk.assign_slots(cut(flagged.where("admitted").drop("admitted", "worst")), 3))
    sums = held.groupBy("run_id", "metric").agg(F.count("slot").alias("n_slots"), F.sum("slot").alias("slot_sum"), F.sum("value").alias("total"))
    return sums.withColumns(r6("total"))


@query("j07_watch_commands", f"""
with {JOB_FIELDS}, w as (select jf.* from jf join v_trials on run_id = job_id where p_seed = '1')
select job_id, 'find' as action from w where regexp_matches(submit_line, 'run.sh 1-URGENT$')
union all select job_id, 'cancel' from w where regexp_matches(submit_line, 'run.sh 5-LOW$')""")
def j07_stream(spark, sf):
    base = work_dir(spark, "j07")
    orders = fx.table(spark, sf, "orders")
    command = lambda name, pick: orders.agg(F.concat(F.lit("run.sh "), pick("o_orderpriority"), F.lit("$")).alias("arg")).select(F.lit(name).alias("name"), "arg")
    parts = [command("find_regex", F.min), command("cancel_regex", F.max)]
    tracked = fx.trials(spark, sf).where("p_seed = '1'").select(F.col("run_id").alias("job_id"))
    feed(spark, base, parts, lambda s: live_jobs.watch_commands(s, job_table(spark, sf), tracked, f"{base}/out", f"{base}/cp"))
    return spark.read.parquet(f"{base}/out").select("job_id", "action")
