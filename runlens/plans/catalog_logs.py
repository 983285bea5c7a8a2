"""Queries: log sections, rule extraction, tagged records, mode logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from runlens.operators import logs
from runlens.plans import fixtures as fx
from runlens.plans.registry import query
from runlens.plans.spec import Capture, Rule
from runlens.session import cut

VALUE = r"value=(-?[\d.]+)"
VIEW = Rule(rf"\[view\] step=(\d+) {VALUE}", (Capture("step", 1), Capture("view_value", 2)))
ANY = Rule(VALUE, (Capture("value", 1),))
CLICK = Rule(rf"\[click\] step=(\d+) {VALUE}", (Capture("step", 1), Capture("click_value", 2)))
# the second group is a word, so reading it as a number fails
BROKEN = Rule(r"\[(purchase)\] step=(\d+)", (Capture("step", 2), Capture("kind", 1)))

FIELDS = """
f as (select folder, line_no, event_type, line, cast(regexp_extract(line, 'step=(\\d+)', 1) as double) as step,
             cast(regexp_extract(line, 'value=(-?[\\d.]+)', 1) as double) as val from v_log)"""


def lines(spark, sf):
    return fx.log_lines(spark, sf).select("folder", "line_no", "line")


@query("c01_longest_section", """
with m as (select folder, line_no, line, sum(case when line like '[error]%' then 1 else 0 end) over (partition by folder order by line_no) as sec from v_log),
s as (select folder, sec, count(*) as n from m group by all),
p as (select folder, arg_max(sec, n * 1000000 + sec) as sec from s group by folder)
select m.folder, m.line_no, m.line from m join p using (folder, sec)""")
def c01(spark, sf):
    return logs.longest_section(cut(lines(spark, sf)), F.col("line").startswith("[error]"))


EVENTS = """
e as (select folder, 'step' as key, line_no, 0 as act, step as value, step from f where event_type = 'view'
      union all select folder, 'view_value', line_no, 1, val, step from f where event_type = 'view'
      union all select folder, 'value', line_no, 2, val, step from f)"""


@query("c02_extract_events", f"""
with {FIELDS}, {EVENTS}
select folder, key, row_number() over (partition by folder, key order by line_no, act) - 1 as pos, value from e""")
def c02(spark, sf):
    return logs.extract_events(lines(spark, sf), [VIEW, ANY]).select("folder", "key", "pos", "value")


@query("c03_extract_first", f"""
with {FIELDS} select folder, arg_min(step, line_no) as step, arg_min(val, line_no) as view_value from f where event_type = 'view' group by folder""")
def c03(spark, sf):
    return logs.extract_first(lines(spark, sf), VIEW)


@query("c04_merge_matchers", f"""
with {FIELDS},
v as (select folder, 'step' as key, line_no, step as value from f where event_type = 'view'
      union all select folder, 'view_value', line_no, val from f where event_type = 'view'),
c as (select folder, 'step' as key, line_no, step as value from f where event_type = 'click'
      union all select folder, 'click_value', line_no, val from f where event_type = 'click'),
u as (select *, 0 as m from v union all select *, 1 from c),
w as (select *, max(m) over (partition by folder, key) as best from u)
select folder, key, row_number() over (partition by folder, key order by line_no) - 1 as pos, value from w where m = best""")
def c04(spark, sf):
    return logs.merge_matchers(lines(spark, sf), [[VIEW], [CLICK], [BROKEN]]).select("folder", "key", "pos", "value")


@query("c04_match_failures", "select folder, 'kind' as key, count(*) as n_failed from v_log where event_type = 'purchase' group by folder")
def c04_failures(spark, sf):
    return logs.match_failures(logs.extract_events(lines(spark, sf), [BROKEN]))


CHAT_JSON = "v_chat where kind is not null"


def chat_lines(spark, sf):
    """Chat turns written as tagged JSON lines."""
    payload = F.to_json(F.struct("text"))
    line = F.when(F.col("kind").isNull(), payload).otherwise(
        F.concat(F.lit(" "), ((F.col("line_no") % 3).cast("string")), F.lit(": "), F.col("kind"), F.lit(": "), payload)
    )
    return fx.chat(spark, sf).select("file", "line_no", line.alias("line"))


TAGGED_SQL = """
r as (select file, line_no as seq, kind, text,
             file || '-' || (line_no % 3) || ':-' || (sum(case when kind = 'args' then 1 else 0 end) over (partition by file order by line_no) - 1) as key
      from v_chat where kind is not null)"""


@query("a04_parse_tagged_json", f"with {TAGGED_SQL} select file, key, kind, seq, text from r")
def a04(spark, sf):
    records = logs.parse_tagged_json(chat_lines(spark, sf))
    return records.select("file", "key", "kind", "seq", F.get_json_object("payload", "$.text").alias("text"))


@query("c06_group_records", """
with r as (select file, line_no as seq, kind, text, line_no % 5 as key from v_chat where kind is not null),
l as (select key, max(file) as file from r group by key)
select file, 'k' || key as key, kind, seq, text from r join l using (key, file)""")
def c06(spark, sf):
    # the same turn number in several conversations plays one key found in several files
    records = fx.chat(spark, sf).where("kind is not null").select(
        "file", F.concat(F.lit("k"), (F.col("line_no") % 5).cast("string")).alias("key"), "kind", F.col("line_no").alias("seq"), "text"
    )
    return logs.group_records(records)


@query("c07_error_tail", """
with e as (select *, row_number() over (partition by folder order by line_no desc) as rk from v_log where line like '%error%')
select folder, string_agg(line, '|' order by line_no) as errors from e where rk <= 3 group by folder""")
def c07(spark, sf):
    tail = logs.error_tail(lines(spark, sf), needle="error")
    return tail.select("folder", F.array_join("errors", "|").alias("errors"))


@query("c08_tracking_url", """
select folder, trim(arg_min(substr(line, 16), line_no) filter (where line like '[signup] step=1%')) as url from v_log group by folder""")
def c08(spark, sf):
    return logs.tracking_url(lines(spark, sf), prefix="[signup] step=1")


def value_maps(spark, sf):
    """Each log line as a map with its event type and, for some types, a second key."""
    both = F.col("event_type").isin("view", "click")
    first = F.create_map(F.col("event_type"), F.col("value"))
    return fx.log_lines(spark, sf).select(
        F.col("folder").alias("run_id"), F.col("line_no").alias("pos"),
        F.when(both, F.map_concat(first, F.create_map(F.lit("any"), F.col("value") * 2))).otherwise(first).alias("values"),
    )


MAPS = """
m as (select folder as run_id, line_no as pos, event_type as key, value from v_log
      union all select folder, line_no, 'any', value * 2 from v_log where event_type in ('view', 'click'))"""


@query("c09_align_dicts", f"""
with {MAPS}, k as (select distinct run_id, key from m)
select p.folder as run_id, p.line_no as pos, k.key, m.value
from v_log p join k on k.run_id = p.folder left join m on m.run_id = p.folder and m.pos = p.line_no and m.key = k.key""")
def c09(spark, sf):
    return logs.align_dicts(value_maps(spark, sf))


@query("c09_pack_series", """
select metric, run_id, pos // 4 as chunk, string_agg(cast(value as decimal(18,2))::varchar, ',' order by pos) as vals from v_points group by all""")
def c09_pack(spark, sf):
    points = fx.points(spark, sf).withColumn("value", F.col("value").cast("decimal(18,2)").cast("string"))
    packed = logs.pack_series(points, ["run_id", "metric"], chunk=4)
    return packed.select("run_id", "metric", "chunk", F.array_join("values", ",").alias("vals"))


@query("c10_series_subkey", "select line_no, folder, round(value * 2, 6) as x from v_log")
def c10(spark, sf):
    pair = F.array(F.create_map(F.lit("a"), F.col("value"), F.lit("b"), F.col("value") * 2))
    d = fx.log_lines(spark, sf).select("folder", "line_no", logs.series_subkey(pair, "b").alias("s"))
    return d.select("folder", "line_no", F.round(F.get("s", F.lit(0)), 6).alias("x"))


def mode_lines(spark, sf):
    """Events as a log of training and evaluation phases."""
    number = F.abs("value").cast("decimal(12,2)").cast("string")
    kind = F.col("event_type")
    line = (
        F.when(kind == "error", "Train:").when(kind == "click", "Eval:")
        .when(kind == "view", F.concat(F.lit("Total step: "), number, F.lit("M")))
        .when(kind == "purchase", F.concat(F.lit("Accumulated: 1.0[2], Last episode[16] Avg: "), number))
        .otherwise(F.concat(F.lit("Namespace(lr="), number, F.lit(", name='a b', n="), F.col("line_no").cast("string"), F.lit(")")))
    )
    return fx.log_lines(spark, sf).select(F.col("folder").alias("file"), "line_no", line.alias("line"))


@query("a05_parse_mode_log", """
with n as (select folder as file, line_no, case event_type when 'error' then 'T' when 'click' then 'E' when 'view' then 'S' when 'purchase' then 'A' end as k,
                  cast(cast(abs(value) as decimal(12,2)) as double) as x from v_log where event_type <> 'signup'),
a as (select *, last_value(case when k in ('T', 'S') then k end ignore nulls) over b = 'T' as armed from n
      window b as (partition by file order by line_no rows between unbounded preceding and 1 preceding)),
c as (select *, k = 'A' and not coalesce(armed, false) as seen, k = 'S' and coalesce(armed, false) as sets from a),
d as (select *, seen and coalesce(last_value(case when k = 'E' or seen then k end ignore nulls) over b = 'E', false) as emits from c
      window b as (partition by file order by line_no rows between unbounded preceding and 1 preceding)),
s as (select *, last_value(case when sets then x when emits then -1 end ignore nulls) over b as step from d
      window b as (partition by file order by line_no rows between unbounded preceding and 1 preceding))
select file, line_no as seq, nullif(step, -1) as step, x as test_avg from s where emits""")
def a05(spark, sf):
    return logs.parse_mode_log(mode_lines(spark, sf))


@query("a05_mode_args", """
select folder as file, line_no as seq, cast(cast(abs(value) as decimal(12,2)) as varchar) as lr, 'a b' as name, line_no::varchar as n
from v_log where event_type = 'signup'""")
def a05_args(spark, sf):
    args = logs.mode_args(mode_lines(spark, sf))
    return args.select("file", "seq", *[F.try_element_at("args", F.lit(k)).alias(k) for k in ("lr", "name", "n")])


@query("a11_resolve_sweep_dir", """
select folder, coalesce(arg_min(regexp_extract(line, 'view. step=(.*)$', 1), line_no) filter (where line like '%view] step=1%'), folder::varchar) as sweep_dir
from v_log group by folder""")
def a11(spark, sf):
    # a view line with a step that starts with 1 plays the redirect line
    return logs.resolve_sweep_dir(lines(spark, sf), pattern=r"view\] step=(1.*)$")
