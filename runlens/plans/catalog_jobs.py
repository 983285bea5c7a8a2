"""Queries: scheduler jobs, grids, file listings, result selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from runlens.functions.columns import base_name
from runlens.operators import files, grid, jobs
from runlens.plans import fixtures as fx
from runlens.plans.registry import query

JOB_FIELDS = r"""
jf as (select job_id, state, nullif(regexp_extract(submit_line, '--comment=([^ ]+)', 1), '') as comment,
              replace(nullif(regexp_extract(submit_line, '-e ([^ ]+)', 1), ''), '%j', job_id::varchar) as stderr_file,
              replace(nullif(regexp_extract(submit_line, '-o ([^ ]+)', 1), ''), '%j', job_id::varchar) as stdout_file, submit_line from v_jobs)"""


def job_table(spark, sf):
    return jobs.job_fields(fx.jobs(spark, sf))


@query("a06_job_fields", f"with {JOB_FIELDS} select * from jf")
def a06(spark, sf):
    return job_table(spark, sf)


SCALARS = """
fs as (select l_orderkey as run_id, l_returnflag as file, count(*) as size, min(l_shipdate) as mtime from lineitem group by all),
sc as (select f.*, l_linestatus as metric, l_linenumber as step, l_partkey, l_suppkey, l_extendedprice as value
       from lineitem join fs f on f.run_id = l_orderkey and f.file = l_returnflag)"""


def scalars(spark, sf):
    """Return flags play the event files of a run, line status the scalar tag."""
    li = fx.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("run_id"), F.col("l_returnflag").alias("file"), F.col("l_linestatus").alias("tag"),
        F.col("l_linenumber").alias("step"), F.col("l_extendedprice").alias("value"), "l_partkey", "l_suppkey", "l_shipdate",
    )
    stats = li.groupBy("run_id", "file").agg(F.count(F.lit(1)).alias("size"), F.min("l_shipdate").alias("mtime"))
    return li.drop("l_shipdate").join(stats, ["run_id", "file"])


@query("a07_scalar_files_all", f"""
with {SCALARS} select run_id, metric, row_number() over (partition by run_id, metric order by mtime, file, step, l_partkey, l_suppkey) - 1 as pos, value from sc""")
def a07_all(spark, sf):
    return files.concat_scalar_files(scalars(spark, sf), "all")


for _choice, _order in (("largest", "size desc, file"), ("earliest", "mtime, file"), ("latest", "mtime desc, file")):

    def _a07(spark, sf, choice=_choice):
        return files.concat_scalar_files(scalars(spark, sf), choice)

    query(f"a07_scalar_files_{_choice}", f"""
with {SCALARS}, pick as (select run_id, file, row_number() over (partition by run_id order by {_order}) as rk from fs)
select run_id, metric, row_number() over (partition by run_id, metric order by step, l_partkey, l_suppkey) - 1 as pos, value
from sc join pick using (run_id, file) where rk = 1""")(_a07)


RESULT_FILES = """
rf as (select folder, folder || '/' || case when page_id % 50 = 3 then 'summary' else regexp_extract(url, '[^/]*$') end as path from
       (select *, 'd' || (page_id % 10) as folder from pages))"""


def result_files(spark, sf):
    d = fx.files(spark, sf)
    name = F.when(F.col("file_id") % 50 == 3, "summary").otherwise(base_name(F.col("path")))
    return d.select("folder", F.concat("folder", F.lit("/"), name).alias("path"))


@query("a09_job_results", f"""
with {RESULT_FILES}
select folder, path, path like '%/summary' as cached from rf
where path like '%/summary' or (regexp_matches(path, 'html$|page=') and folder not in (select folder from rf where path like '%/summary'))""")
def a09(spark, sf):
    return files.pick_job_results(result_files(spark, sf), "html$|page=")


@query("a09_job_results_uncached", f"with {RESULT_FILES} select folder, path, false as cached from rf where path not like '%/summary'")
def a09_raw(spark, sf):
    return files.pick_job_results(result_files(spark, sf), use_cache=False)


@query("a10_manifest_jobs", """
select l_orderkey || '-' || l_linenumber as prefix, '/logs/' || l_orderkey || '/output' || l_linenumber || '-0.log' as path from lineitem""")
def a10(spark, sf):
    listed = fx.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("job_idx"))
    return files.expand_manifest_jobs(listed, "/logs")


@query("a10_probe_logs", """
with e as (select distinct l_orderkey as id, l_linenumber - 1 as idx from lineitem where l_orderkey in (select o_orderkey from orders where o_orderstatus = 'F')),
r as (select *, row_number() over (partition by id order by idx) - 1 as rn from e)
select id || '-' || idx as prefix, '/logs/' || id || '/output' || idx || '-0.log' as path from r where rn = idx""")
def a10_probe(spark, sf):
    wanted = fx.table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"))
    existing = fx.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), (F.col("l_linenumber") - 1).alias("job_idx"))
    return files.probe_job_logs(wanted, existing, "/logs")


@query("d02_match_urls", """
select file_id as job_id, path as url from v_files where path in (select path from v_files where size > 5000) and file_id % 9 <> 0""")
def d02(spark, sf):
    d = fx.files(spark, sf)
    job_urls = d.select(F.col("file_id").alias("job_id"), F.when(F.col("file_id") % 9 != 0, F.col("path")).alias("url"))
    return jobs.match_urls(job_urls, d.where("size > 5000").select(F.col("path").alias("url"))).select("job_id", "url")


@query("d03_find_rerun_jobs", f"""
with {JOB_FIELDS}
select job_id, state, comment from jf where state in ('RUNNING', 'PENDING') and starts_with(comment, 'rerun:')
  and job_id not in (select run_id from v_trials where p_seed = '1') and job_id not in (select run_id from v_trials where p_year = '1995')""")
def d03(spark, sf):
    t = fx.trials(spark, sf).withColumnRenamed("run_id", "job_id")
    found = jobs.find_rerun_jobs(job_table(spark, sf), t.where("p_seed = '1'"), t.where("p_year = '1995'"))
    return found.select("job_id", "state", "comment")


@query("d04_tracked_status", """
select p_partkey * 10 as job_id, coalesce(state, 'UNKNOWN') as state from part left join v_jobs on job_id = p_partkey * 10""")
def d04(spark, sf):
    tracked = fx.table(spark, sf, "part").select((F.col("p_partkey") * 10).alias("job_id"))
    return jobs.tracked_status(tracked, fx.jobs(spark, sf))


OPTION_LISTS = """
s as (select v, row_number() over (order by v) - 1 as i, count(*) over () as n from (select distinct p_status as v from v_trials)),
p as (select v, row_number() over (order by v) - 1 as i, count(*) over () as n from (select distinct p_priority as v from v_trials)),
y as (select v, row_number() over (order by v) - 1 as i, count(*) over () as n from (select distinct p_year as v from v_trials))"""


@query("d05_param_grid", f"""
with {OPTION_LISTS}
select (s.i * p.n + p.i) * y.n + y.i as trial_id, 'status=' || s.v || '_priority=' || p.v || '_year=' || y.v as label,
       './run --status=' || s.v || ' --priority=' || p.v || ' --year=' || y.v || ' --mode=long-single-valued-option > out/status=' || s.v || '_priority=' || p.v || '_year=' || y.v || '.txt' as command
from s, p, y""")
def d05(spark, sf):
    t = fx.trials(spark, sf)
    options = {"./run": None, **{f"--{n}": _axis(t, f"p_{n}") for n in ("status", "priority", "year")}, "--mode": ["long-single-valued-option"]}
    return grid.param_grid(spark, options, target_dir="out")


def _axis(t, name):
    return grid.observed_axis(t, name, "at").withColumnRenamed(name, "value")


@query("d06_nested_grid", f"""
with {OPTION_LISTS},
sub as (select 'adam' as opt, v as beta, i from y union all select 'sgd', null, n from (select distinct n from y))
select s.i + s.n * (sub.i + (select count(*) from sub) * p.i) as trial_id, s.v as status, sub.opt, sub.beta, p.v as priority
from s, sub, p""")
def d06(spark, sf):
    t = fx.trials(spark, sf)
    observed = lambda name: grid.TableValues(_axis(t, name))
    spec = {
        "status": observed("p_status"),
        "__sub": [{"opt": "adam", "beta": observed("p_year")}, {"opt": "sgd"}],
        "priority": observed("p_priority"),
    }
    return grid.nested_grid(spark, spec)


@query("e21_freshness", """
select sweep, round(min(epoch_us(timestamp '2026-01-01') - epoch_us(modified_at)) / 1000000.0, 3) as age_s, count(*) as n from v_trials group by sweep""")
def e21(spark, sf):
    as_of = F.lit("2026-01-01 00:00:00").cast("timestamp_ntz")
    return files.freshness(fx.trials(spark, sf), as_of).withColumn("age_s", F.round("age_s", 3))


@query("e22_empty_folders", "select path || '/sub' as path from v_files where size <= 5000")
def e22(spark, sf):
    d = fx.files(spark, sf)
    sub = F.concat("path", F.lit("/sub"))
    dirs = d.select("path").union(d.select(sub.alias("path")))
    return files.empty_folders(dirs, d.where("size > 5000").select(F.concat(sub, F.lit("/out.txt")).alias("path")))


@query("h02_update_watchlist", """
select run_id as job_id from v_trials where (p_seed = '1' or p_status = 'P') and p_year <> '1996'""")
def h02(spark, sf):
    t = fx.trials(spark, sf).withColumnRenamed("run_id", "job_id")
    return jobs.update_watchlist(t.where("p_seed = '1'"), t.where("p_status = 'P'"), t.where("p_year = '1996'"))


PLAN = r"""
b as (select job_id, state, submit_line, coalesce(nullif(regexp_extract(stderr_file, '^(.*/)', 1), ''), './') || job_id as std_base, 1 as fail_count from jf where state = 'FAILED'),
c as (select *, 'rerun:' || '{@@@std_base@@@:___@@@' || std_base || '@@@,___@@@fail_count@@@:___' || fail_count || '}' as comment from b),
line as (select *, regexp_replace(regexp_replace(regexp_replace(submit_line, '--comment=([^ ]+)', ''), '-e ([^ ]+)', ''), '-o ([^ ]+)', '') || ' 2>&1 1> /dev/null' as l from c)"""


@query("j02_retry_plan", rf"""
with {JOB_FIELDS}, {PLAN}
select job_id, state, std_base, fail_count, std_base || '_1.err' as stderr_path, std_base || '_1.out' as stdout_path, comment,
       'sbatch -e ' || std_base || '_1.err -o ' || std_base || '_1.out --comment=''' || comment || ''' ' || substr(l, 8) as submit_line
from line""")
def j02(spark, sf):
    return jobs.retry_plan(job_table(spark, sf))


@query("j02_second_retry", rf"""
with {JOB_FIELDS}, {PLAN}
select job_id, std_base, 2 as fail_count, std_base || '_2.err' as stderr_path, replace(comment, ':___1}}', ':___2}}') as comment from line""")
def j02_again(spark, sf):
    first = jobs.retry_plan(job_table(spark, sf))
    failed_again = first.select("job_id", "state", "comment", F.col("stderr_path").alias("stderr_file"), "submit_line")
    return jobs.retry_plan(failed_again).select("job_id", "std_base", "fail_count", "stderr_path", "comment")


@query("j07_apply_commands", f"""
with {JOB_FIELDS}, tracked as (select run_id as job_id from v_trials where p_seed = '1'),
w as (select jf.* from jf join tracked using (job_id))
select job_id, 'track' as action from jf where state in ('RUNNING', 'PENDING')
union select w.job_id, 'cancel' from w join lineitem on w.job_id = l_orderkey where l_linenumber = 7
union select job_id, 'find' from w where regexp_matches(submit_line, 'run.sh 1-URGENT$')
union select job_id, 'cancel' from w where regexp_matches(submit_line, 'rerun.*5-LOW')""")
def j07(spark, sf):
    ids = fx.table(spark, sf, "lineitem").where("l_linenumber = 7").select(
        F.lit("cancel_ids").alias("name"), F.concat(F.col("l_orderkey").cast("string"), F.lit(","), F.col("l_orderkey").cast("string")).alias("arg")
    )
    urgent = fx.table(spark, sf, "orders").agg(F.concat(F.lit("run.sh "), F.min("o_orderpriority"), F.lit("$")).alias("arg"))
    low = fx.table(spark, sf, "orders").agg(F.concat(F.lit("rerun.*"), F.max("o_orderpriority")).alias("arg"))
    commands = (
        ids.unionByName(urgent.select(F.lit("find_regex").alias("name"), "arg"))
        .unionByName(low.select(F.lit("cancel_regex").alias("name"), "arg"))
        .unionByName(urgent.select(F.lit("refresh_track").alias("name"), F.lit(None).cast("string").alias("arg")))
    )
    tracked = fx.trials(spark, sf).where("p_seed = '1'").select(F.col("run_id").alias("job_id"))
    return jobs.apply_commands(commands, job_table(spark, sf), tracked)


@query("j07_many_patterns", """
select job_id, 'cancel' as action from v_jobs where job_id % 2 = 0 and job_id // 2 in (select o_orderkey from orders)
union all select null, 'invalid'""")
def j07_many(spark, sf):
    """A pattern per order against all jobs, and one that cannot be read."""
    named = job_table(spark, sf).withColumn("submit_line", F.concat("submit_line", F.lit(" --name=n"), F.lpad(F.col("job_id").cast("string"), 12, "0")))
    wanted = F.concat(F.lit("--name=n"), F.lpad((F.col("o_orderkey") * 2).cast("string"), 12, "0"), F.lit("( |$)"))
    names = F.concat(F.lit("sh .*"), wanted)
    patterns = fx.table(spark, sf, "orders").select(F.when(F.col("o_orderkey") % 3 == 0, names).otherwise(wanted).alias("arg"))
    broken = patterns.limit(1).select(F.lit("--name=(").alias("arg"))
    commands = patterns.unionByName(broken).select(F.lit("cancel_regex").alias("name"), "arg")
    return jobs.apply_commands(commands, named, named)
