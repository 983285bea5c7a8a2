"""Queries: sources and sinks, over files that Spark writes from the tables; ingest by specification."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from runlens.functions.columns import base_name
from runlens.operators import groups
from runlens.operators.logs import JOB_START
from runlens.plans import fixtures as fx
from runlens.plans.catalog_jobs import JOB_FIELDS
from runlens.plans.catalog_logs import ANY, FIELDS, VALUE, VIEW
from runlens.plans.catalog_reduce import BEST, LEADERBOARD, board, e03, r6
from runlens.plans.ingest import ingest, ingest_again, ingest_folder, with_config
from runlens.plans.registry import query
from runlens.plans.report import reduce_by_spec, report
from runlens.plans.spec import Capture, ResultGroup, Rule, SweepSpec
from runlens.session import cut, work_dir
from runlens.sources import accounting, summaries, sweep_source, sweeps
from runlens.sources.trees import NO_KEY, write_logs


def number_of(name: str):
    """The whole number that a folder ``name=number`` is named by; NULL for the folder of rows without one."""
    return F.regexp_extract("folder", rf"{name}=(-?\d+)$", 1).try_cast("long")


@query("a01_discover_runs", "select distinct 'sweep_id=' || sweep[9:] as name from v_trials")
def a01(spark, sf):
    root = work_dir(spark, "a01")
    runs = fx.trials(spark, sf).select("run_id", "p_status", F.substring("sweep", 9, 10).alias("sweep_id"))
    runs.write.partitionBy("sweep_id").parquet(f"{root}/sweep")
    return sweeps.discover_runs(spark, f"{root}/sweep/*").select(base_name(F.col("folder")).alias("name"))


def chat_tree(spark, sf) -> str:
    """One log file per conversation, one JSON line per turn."""
    root = work_dir(spark, "chat")
    lines = fx.chat(spark, sf).select("file", "line_no", F.to_json(F.struct("role", "text")).alias("line"))
    write_logs(lines, f"{root}/chat", "file", ["line_no"])
    return f"{root}/chat"


@query("a02_read_log_lines", """
select file, row_number() over (partition by file order by line_no) - 1 as line_no, role, text from v_chat""")
def a02(spark, sf):
    lines = sweeps.read_log_lines(spark, chat_tree(spark, sf), logs="*.txt")
    return lines.select(
        number_of("file").alias("file"), "line_no",
        F.get_json_object("line", "$.role").alias("role"), F.get_json_object("line", "$.text").alias("text"),
    )


def turn_tree(spark, sf) -> str:
    """A run folder for every 16 conversations with its log, one turn a line, and an override file that holds who speaks last."""
    root = work_dir(spark, "turns")
    chat = fx.chat(spark, sf).withColumn("run", F.expr("file div 16"))
    log = chat.select(F.lit("log").alias("kind"), "run", "file", "line_no", F.concat_ws("|", "file", F.coalesce("role", F.lit("")), F.coalesce(F.length("text"), F.lit(0)).cast("string")).alias("line"))
    last = chat.groupBy("run").agg(F.max_by("role", F.struct("file", "line_no")).alias("role"), F.count(F.lit(1)).alias("n"))
    items = F.posexplode(F.array(F.concat(F.lit("- last="), "role"), F.concat(F.lit("- 'turns="), "n", F.lit("' # counted")))).alias("line_no", "line")
    config = last.select(F.lit("conf").alias("kind"), "run", F.lit(0).cast("long").alias("file"), items)
    rows = log.unionByName(config).repartition("run").sortWithinPartitions("run", "kind", "file", "line_no")
    rows.select("run", "kind", "line").write.partitionBy("run", "kind").text(f"{root}/runs")
    return f"{root}/runs"


TURN_LOGS = {"logs": "kind=log/*.txt", "overrides": "kind=conf/*.txt"}
TURNS = """
t as (select file // 16 as run, file, line_no, role, file || '|' || coalesce(role, '') || '|' || coalesce(length(text), 0) as line from v_chat)"""


@query("a01_source", f"with {TURNS} select run, count(*) as n_lines, sum(length(line) + 1)::bigint as n_chars from t group by run")
def a01_source(spark, sf):
    """Runs of a sweep folder by the data source, with what their logs hold."""
    lines = sweep_source.sweep_lines(spark, turn_tree(spark, sf), **TURN_LOGS)
    run = F.regexp_extract("folder", r"run=(\d+)$", 1).cast("long").alias("run")
    return lines.groupBy(run).agg(F.count(F.lit(1)).alias("n_lines"), (F.max("offset") + F.max_by(F.length("line"), "offset") + 1).alias("n_chars"))


@query("a02_source_pushed", f"""
with {TURNS}
select run, row_number() over (partition by run order by file, line_no) - 1 as line_no, line, count(*) over (partition by run)::varchar as turns
from t qualify last_value(role) over (partition by run order by file, line_no rows between unbounded preceding and unbounded following) = 'user'""")
def a02_source(spark, sf):
    """Lines of the runs with one override; logs of other runs are not opened."""
    lines = sweep_source.sweep_lines(spark, turn_tree(spark, sf), params="last,turns", **TURN_LOGS).where("override_last = 'user'")
    run = F.regexp_extract("folder", r"run=(\d+)$", 1).cast("long").alias("run")
    return sweep_source.numbered(lines).select(run, "line_no", "line", F.col("override_turns").alias("turns"))


@query("k04_load_runs", "select file, count(*) as n_lines from v_chat group by file")
def k04(spark, sf):
    def count_lines(path: str, content: bytes) -> dict:
        file = path.split("file=")[1].split("/")[0]
        return {"file": None if file == NO_KEY else int(file), "n_lines": content.count(b"\n")}

    return sweeps.load_runs(spark, [chat_tree(spark, sf) + "/*/*.txt"], count_lines, "file bigint, n_lines bigint")


@query("a03_name_overrides", "select run_id, 'status=' || p_status as o1, 'year=' || p_year as o2 from v_trials")
def a03_name(spark, sf):
    path = F.concat(F.col("sweep"), F.lit("/status="), "p_status", F.lit("_year="), "p_year", F.lit(".txt"))
    found = fx.trials(spark, sf).select("run_id", sweeps.name_overrides(path).alias("o"))
    return found.select("run_id", *[F.get("o", F.lit(i)).alias(f"o{i + 1}") for i in (0, 1)])


@query("a03_header_overrides", "select folder, 'lr=' || p_seed || '|status=' || p_status as overrides from v_trials")
def a03_header(spark, sf):
    head = F.array(
        F.lit("[info] start"), F.lit(" - indented"), F.concat(F.lit("lr: "), "p_seed"), F.lit("nested:"), F.lit("  a: 1"),
        F.concat(F.lit("status: '"), "p_status", F.lit("'")), F.lit("list: [1, 2]"), F.lit("[info] end"), F.lit("lr: 99"),
    )
    lines = fx.trials(spark, sf).select("folder", F.posexplode(head).alias("line_no", "line"))
    return sweeps.header_overrides(lines).select("folder", F.array_join("overrides", "|").alias("overrides"))


@query("a06_read_accounting", f"with {JOB_FIELDS} select * from jf")
def a06_json(spark, sf):
    root = work_dir(spark, "a06")
    j = fx.jobs(spark, sf).select("job_id", F.struct(F.col("state").alias("current")).alias("state"), "submit_line")
    docs = j.groupBy(F.expr("job_id div 1000").alias("doc")).agg(F.collect_list(F.struct("job_id", "state", "submit_line")).alias("jobs"))
    docs.select(F.to_json(F.struct("jobs")).alias("value")).write.text(f"{root}/acct")
    return accounting.read_job_accounting(spark, f"{root}/acct", one_document=False)


@query("a08_summary", "select run_id, sweep, p_status, round(price, 6) as price from v_board")
def a08(spark, sf):
    out = work_dir(spark, "a08")
    summaries.write_summary(board(spark, sf).select("run_id", "sweep", "p_status", "price"), out)
    return summaries.read_summary(spark, out).withColumns(r6("price"))


@query("a12_write_report", LEADERBOARD)
def a12(spark, sf):
    out = work_dir(spark, "a12")
    summaries.write_report(e03(spark, sf), out, "first")
    return spark.read.parquet(out).drop("signature")


@query("k01_ingest_again", f"""
with {FIELDS},
e as (select folder, 'step' as metric, line_no, step as value from f where event_type = 'view'
      union all select folder, 'view_value', line_no, val from f where event_type = 'view' union all select folder, 'value', line_no, val from f)
select folder, metric, row_number() over (partition by folder, metric order by line_no) - 1 as pos, value from e""")
def k01_again(spark, sf):
    """Two thirds of the runs are ingested, some of them with other lines; then all logs are there and the changed ones are read again."""
    root, out = work_dir(spark, "k01a"), work_dir(spark, "k01a-out")
    log = cut(fx.log_lines(spark, sf).select("folder", "line_no", "line"))
    spec = SweepSpec(result_groups={"view": ResultGroup("event", [VIEW]), "any": ResultGroup("event", [ANY])}, default_result_group=["view", "any"])

    def put(rows):
        write_logs(rows, f"{root}/runs", "folder", ["line_no"])

    put(log.where("folder % 3 <> 0").withColumn("line", F.when(F.col("folder") % 5 == 0, F.concat("line", F.lit("9"))).otherwise(F.col("line"))))
    ingest_again(spark, f"{root}/runs", spec, out, logs="*.txt")
    put(log.where("folder % 3 = 0 or folder % 5 = 0"))
    found = ingest_again(spark, f"{root}/runs", spec, out, logs="*.txt")
    return found.select(number_of("folder").alias("folder"), "metric", "pos", "value")


@query("k01_ingest_events", f"""
with {FIELDS},
m as (select *, sum(case when event_type = 'error' then 1 else 0 end) over (partition by folder order by line_no) as sec from f),
s as (select folder, sec, count(*) as n from m group by all), p as (select folder, arg_max(sec, n * 1000000 + sec) as sec from s group by folder),
l as (select m.* from m join p using (folder, sec)),
e as (select folder, 'step' as metric, line_no, step as value from l where event_type = 'view'
      union all select folder, 'view_value', line_no, val from l where event_type = 'view' union all select folder, 'value', line_no, val from l)
select e.folder, metric, row_number() over (partition by e.folder, metric order by line_no) - 1 as pos, value, (e.folder % 4)::varchar as override_seed from e""")
def k01(spark, sf):
    marked = F.when(F.col("event_type") == "error", F.concat(F.lit(JOB_START), "line")).otherwise(F.col("line"))
    log = fx.log_lines(spark, sf).withColumn("line", marked)
    spec = SweepSpec(
        result_groups={"view": ResultGroup("event", [VIEW]), "any": ResultGroup("event", [ANY])}, default_result_group=["view", "any"]
    )
    _, points = ingest(log, spec)
    configs = fx.table(spark, sf, "events").select(F.col("user_id").alias("folder")).distinct()
    configs = configs.withColumn("config", F.create_map(F.lit("seed"), (F.col("folder") % 4).cast("string")))
    return with_config(points, configs, ["seed"])


LONGEST = f"""
{FIELDS},
m as (select *, sum(case when event_type = 'error' then 1 else 0 end) over (partition by folder order by line_no) as sec from f),
s as (select folder, sec, count(*) as n from m group by all), p as (select folder, arg_max(sec, n * 1000000 + sec) as sec from s group by folder),
l as (select m.* from m join p using (folder, sec))"""


def restarted(spark, sf):
    """Log lines in which every error starts the job anew."""
    marked = F.when(F.col("event_type") == "error", F.concat(F.lit(JOB_START), "line")).otherwise(F.col("line"))
    return fx.log_lines(spark, sf).withColumn("line", marked)


def sweep_tree(spark, sf) -> str:
    """One folder per run with one log: a head with the run's overrides, then its lines."""
    root = work_dir(spark, "k01")
    log = restarted(spark, sf).select("folder", "line_no", "line")
    head = F.array(F.lit("[info] start"), F.concat(F.lit("seed: "), F.col("folder") % 4, F.lit("  # the seed")), F.lit("[info] run"))
    heads = log.select("folder").distinct().select("folder", F.posexplode(head).alias("line_no", "line"))
    rows = log.unionByName(heads.withColumn("line_no", F.col("line_no").cast("long") - 3))
    write_logs(rows, f"{root}/sweep", "folder", ["line_no"])
    return root


@query("k01_ingest_folder", f"""
with {FIELDS},
m as (select *, sum(case when event_type = 'error' then 1 else 0 end) over (partition by folder order by line_no) as sec from f),
s as (select folder, sec, sum(n) as n from (select folder, sec, count(*) as n from m group by all union all select distinct folder, 0, 3 from m) group by all),
p as (select folder, arg_max(sec, n * 1000000 + sec) as sec from s group by folder),
l as (select m.* from m join p using (folder, sec)),
e as (select folder, 'step' as metric, line_no, step as value from l where event_type = 'view'
      union all select folder, 'view_value', line_no, val from l where event_type = 'view' union all select folder, 'value', line_no, val from l)
select p.folder, metric, case when metric is not null then row_number() over (partition by p.folder, metric order by line_no) - 1 end as pos, value,
       (p.folder % 4)::varchar as override_seed, true as recent, 'tree' as sweep
from p left join e using (folder)""")
def k01_folder(spark, sf):
    root = sweep_tree(spark, sf)
    spec = SweepSpec(
        result_groups={"view": ResultGroup("event", [VIEW]), "any": ResultGroup("event", [ANY])}, default_result_group=["view", "any"]
    )
    saved = ingest_folder(spark, f"{root}/sweep/folder=*", spec, "tree", f"{root}/summary", ["seed"], logs="*.txt", as_of=F.current_timestamp())
    return saved.select(number_of("folder").alias("folder"), "metric", "pos", "value", "override_seed", (F.abs("age_s") < 86400).alias("recent"), "sweep")


@query("k01_ingest_df", f"""
with {LONGEST} select folder, arg_min(step, line_no) as step, arg_min(val, line_no) as view_value from l where event_type = 'view' group by folder""")
def k01_df(spark, sf):
    spec = SweepSpec(result_groups={"first": ResultGroup("df", [VIEW]), "any": ResultGroup("event", [ANY])}, default_result_group=["any", "first"])
    kind, rows = ingest(restarted(spark, sf), spec)
    assert kind == "df"
    return rows


@query("k01_ingest_df_rows", f"""
with {LONGEST}, d as (select folder, arg_min(line, line_no) as line from l where event_type = 'view' group by folder)
select folder, unnest(string_split(regexp_extract(line, 'value=(-?[\\d.]+)', 1), '.')) as part from d""")
def k01_df_rows(spark, sf):
    parts = Capture("part", expr=lambda line: F.split(F.regexp_extract(line, VALUE, 1), r"\."))
    spec = SweepSpec(result_groups={"rows": ResultGroup("df", [Rule(VIEW.pattern, (parts,))], explode_rows=True)}, default_result_group=["rows"])
    return ingest(restarted(spark, sf), spec)[1]


@query("k01_ingest_func", f"with {LONGEST} select folder, count(*) as n_lines, max(val) as top from l group by folder")
def k01_func(spark, sf):
    def summary(section):
        value = F.regexp_extract("line", VALUE, 1).cast("double")
        return section.groupBy("folder").agg(F.count(F.lit(1)).alias("n_lines"), F.max(value).alias("top"))

    return ingest(restarted(spark, sf), SweepSpec(result_groups={"own": ResultGroup("func", func=summary)}, default_result_group=["own"]))[1]


@query("k03_report", """
with g as (select p_seed, p_status, round(avg(price), 6) as mean, round(stddev_samp(price), 6) as std, count(price) as n from v_board
           where p_priority <> '5-LOW' group by p_seed, p_status),
t as (select run_id, round(price, 6) as price from v_board where p_priority <> '5-LOW' order by price desc nulls last, run_id limit 7)
select 'group' as part, 'seed=' || p_seed || ',status=' || p_status as label, mean, std, n from g
union all select 'top', run_id::varchar, price, null, 1 from t
union all select 'summary', 'price', round(avg(price), 6), round(stddev_pop(price), 6), count(price) from v_board where p_priority <> '5-LOW'
union all select 'cell', s.p_status || ',' || y.p_year, round(avg(price), 6), round(stddev_samp(price), 6), count(price)
from (select distinct p_status from v_board where p_priority <> '5-LOW') s cross join (values ('1995'), ('1997')) y(p_year)
left join v_board b on b.p_status = s.p_status and b.p_year = y.p_year and b.p_priority <> '5-LOW' group by s.p_status, y.p_year""")
def k03_report(spark, sf):
    spec = SweepSpec(default_metrics=["price"], default_group_order=["seed"], common_options={"descending": True, "topk_mean": 5, "topk": 7})
    runs = fx.trials(spark, sf).select("run_id", *[F.col(f"p_{n}").alias(n) for n in ("status", "priority", "year", "seed")])
    parts = report(runs.where("priority <> '5-LOW'"), fx.points(spark, sf), spec, ["status", "seed"], axes="status/year=[1995,1997]")
    group = parts["groups"].select(F.lit("group").alias("part"), F.concat(F.lit("seed="), "seed", F.lit(",status="), "status").alias("label"), F.col("price_mean").alias("mean"), F.col("price_std").alias("std"), F.col("price_n").alias("n"))
    top = parts["top"].select(F.lit("top"), F.col("run_id").cast("string"), "price", F.lit(None).cast("double"), F.lit(1).cast("long"))
    total = parts["summary"].select(F.lit("summary"), "metric", "mean", "std", "n")
    cell = parts["cells"].select(F.lit("cell"), F.concat("status", F.lit(","), "year"), "mean", "std", "n")
    return group.union(top).union(total).union(cell).withColumns(r6("mean", "std"))


@query("k03_subkey", """
with p as (select l_orderkey as run_id, l_discount::double as value, row_number() over (partition by l_orderkey order by l_discount desc) as rk from lineitem)
select run_id, round(avg(value) filter (where rk <= 2), 6) as disc, max(value) as disc_best, count(*) as disc_len from p group by run_id""")
def k03_subkey(spark, sf):
    items = fx.table(spark, sf, "lineitem")
    maps = F.create_map(F.lit("d"), F.col("l_discount").cast("double"), F.lit("q"), F.col("l_quantity").cast("double"))
    points = items.select(F.col("l_orderkey").alias("run_id"), F.lit("disc").alias("metric"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("pos"), maps.alias("value"))
    spec = SweepSpec(default_metrics=["disc"], common_options={"subkey": "d", "topk_mean": 2, "descending": True})
    board = reduce_by_spec(points, spec)
    return board.select("run_id", "disc", "disc_best", "disc_len").withColumns(r6("disc"))


@query("k03_spec_groups", """
select p_seed, p_status, round(max(price), 6) as best, count(*) as n, round(max(price) - min(price), 6) as spread
from v_board group by p_seed, p_status""")
def k03(spark, sf):
    spec = SweepSpec(default_group_order=["p_seed"], common_options={"descending": True, "topk_mean": 5})
    assert spec.options_for("price") == BEST

    @F.pandas_udf("double")
    def spread(v: pd.Series) -> float:
        return float(v.max() - v.min())

    by = spec.order_groups(["p_status", "p_seed"])
    runs = board(spark, sf).select(*by, "price")
    built_in = groups.group_agg(runs, by, best=F.max("price"), n=F.count(F.lit(1)))
    own = groups.group_agg(runs, by, spread=spread("price"))
    return built_in.join(own, by).withColumns(r6("best", "spread"))
