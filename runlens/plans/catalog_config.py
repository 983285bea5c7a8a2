"""Queries: configs and scalar expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from runlens.functions import columns as fn
from runlens.operators import config as cfg
from runlens.plans import fixtures as fx
from runlens.plans.catalog_reduce import board, r6
from runlens.plans.registry import query

JSON_CONFIG = """'{"override_p_status":"' || p_status || '","override_p_priority":"' || p_priority || '","override_p_year":"' || p_year ||
  '","override_p_seed":"' || p_seed || '","override_p_const":"fixed"}'"""
CONFIG_TEXT = "'p_const=fixed,p_priority=' || p_priority || ',p_seed=' || p_seed || ',p_status=' || p_status || ',p_year=' || p_year"


def overrides(spark, sf):
    items = F.array(*[F.concat(F.lit(f"{p}="), F.col(p)) for p in fx.PARAMS])
    return fx.trials(spark, sf).select("run_id", items.alias("overrides"))


@query("b01_explode_config", f"select run_id, {JSON_CONFIG} as config_json, p_status as override_p_status, p_seed as override_p_seed, cast(null as varchar) as override_nope from v_trials")
def b01(spark, sf):
    out = cfg.explode_config(overrides(spark, sf), params=["p_status", "p_seed", "nope"])
    return out.drop("overrides", "config")


@query("b02_fill_from_config", """
select run_id, 'p_const=fixed,p_priority=' || p_priority || ',p_seed=own,p_status=' || p_status || ',p_year=' || p_year || ',price=1' as entry from v_trials""")
def b02(spark, sf):
    entry = F.create_map(F.lit("price"), F.lit("1"), F.lit("p_seed"), F.lit("own"))
    out = cfg.fill_from_config(fx.trials(spark, sf).select("run_id", "config", entry.alias("entry")))
    return out.select("run_id", cfg.config_string("entry").alias("entry"))


@query("b03_filter_config", "select run_id from v_trials where p_status = 'F' and p_seed = '2'")
def b03(spark, sf):
    return cfg.filter_config(fx.trials(spark, sf), "p_status=F,p_seed=2").select("run_id")


@query("b03_filter_config_json", "select run_id from v_trials where p_priority = '1-URGENT'")
def b03_json(spark, sf):
    return cfg.filter_config(fx.trials(spark, sf), '{"p_priority": "1-URGENT"}').select("run_id")


@query("b04_filter_min_points", "select run_id from v_trials where run_id in (select run_id from v_points where metric = 'price' group by run_id having count(*) >= 4)")
def b04(spark, sf):
    runs = fx.trials(spark, sf).select("run_id")
    return cfg.filter_min_points(runs, fx.points(spark, sf), {"price": 4, "absent": 9}, known=["price", "qty"])


@query("b05_config_string", f"select run_id, {CONFIG_TEXT} as config from v_trials")
def b05(spark, sf):
    more = F.map_concat("config", F.create_map(F.lit("githash"), F.lit("abc"), F.lit("sweep_filename"), F.lit("x")))
    return fx.trials(spark, sf).select("run_id", cfg.config_string(more).alias("config"))


@query("b06_config_columns", "select run_id, p_status, p_year, cast(null as varchar) as nope from v_trials")
def b06(spark, sf):
    text = fx.trials(spark, sf).select("run_id", cfg.config_string("config").alias("text"))
    return cfg.config_columns(text, "text", ["p_status", "p_year", "nope"])


@query("b07_cast_config", "select run_id, cast(p_year as bigint) as p_year, cast(p_seed as double) as p_seed, p_status from v_trials")
def b07(spark, sf):
    return cfg.cast_config(fx.trials(spark, sf).select("run_id", "p_year", "p_seed", "p_status"), "p_year=int,p_seed=float,p_status")


@query("b08_match_spec", "select run_id, 'p_status=' || p_status || '-p_seed=' || p_seed as label from v_trials where p_status = 'O' and p_seed = '1'")
def b08(spark, sf):
    hits = cfg.match_spec(fx.trials(spark, sf), {"p_status": "O", "p_seed": "1"})
    return hits.select("run_id", cfg.spec_label(["p_status", "p_seed"]).alias("label"))


@query("b09_filter_regex", "select file_id, path from v_files where regexp_matches(path, 'page=[0-9]+|html$')")
def b09(spark, sf):
    return cfg.filter_regex(fx.files(spark, sf), "path", "page=[0-9]+|html$").select("file_id", "path")


@query("b10_filter_active", "select job_id, state from v_jobs where state in ('RUNNING', 'PENDING') and submit_line like '%--comment=rerun:%'")
def b10(spark, sf):
    from runlens.operators.jobs import job_fields

    return cfg.filter_active(job_fields(fx.jobs(spark, sf)), rerun_only=True).select("job_id", "state")


@query("b11_split_factors", """
select p_status, p_seed, case when run_id % 2 = 0 then '1' else '0' end as even, round(price, 6) as price, run_id as folder from v_board""")
def b11(spark, sf):
    even = F.when(F.col("run_id") % 2 == 0, "true").otherwise("false")
    runs = board(spark, sf).select(
        "folder", "price", F.col("p_status").alias("override_p_status"), F.col("p_seed").alias("override_p_seed"),
        even.alias("override_even"), F.lit("fixed").alias("override_p_const"),
    )
    factors, _ = cfg.split_factors(runs, ["price"])
    return factors.withColumns(r6("price"))


@query("b11_constants", "select max(p_const) as p_const from v_trials")
def b11_constants(spark, sf):
    runs = fx.trials(spark, sf).select("folder", F.col("p_seed").alias("override_p_seed"), F.col("p_const").alias("override_p_const"))
    return cfg.split_factors(runs, [])[1]


@query("b12_select_metric_prefix", "select run_id, round(price, 6) as price, price_len from v_board")
def b12(spark, sf):
    return cfg.select_metric_prefix(board(spark, sf), ["pri"], keep=["run_id"]).withColumns(r6("price"))


THREE = "printf('%.3f', {})"


def _trimmed(expr: str) -> str:
    return f"rtrim(rtrim({THREE.format(expr)}, '0'), '.')"


@query("i01_human_bytes", f"""
with s as (select file_id, size * k as n from v_files, (values (1), (37), (1024), (500000)) t(k))
select file_id, n, case when n >= 1073741824 then {THREE.format('n / 1073741824.0::double')} || ' GB'
  when n >= 1048576 then {THREE.format('n / 1048576.0::double')} || ' MB' when n >= 1024 then {THREE.format('n / 1024.0::double')} || ' KB'
  else n || ' bytes' end as text from s""")
def i01(spark, sf):
    scales = F.explode(F.array(*[F.lit(k).cast("long") for k in (1, 37, 1024, 500000)]))
    d = fx.files(spark, sf).select("file_id", "size", scales.alias("k")).select("file_id", (F.col("size") * F.col("k")).alias("n"))
    return d.withColumn("text", fn.human_bytes(F.col("n")))


@query("i02_human_duration", """
select job_id, printf('%dH %02dM %02dS', job_id * 37 // 3600, job_id * 37 % 3600 // 60, job_id * 37 % 60) as text from v_jobs""")
def i02(spark, sf):
    return fx.jobs(spark, sf).select("job_id", fn.human_duration(F.col("job_id") * 37).alias("text"))


@query("i03_human_count", f"""
with s as (select o_orderkey, cast(floor(o_totalprice) as bigint) * k as n from orders, (values (0), (1), (25), (100)) t(k))
select o_orderkey, n, case when n < 1000 then n::varchar when n < 1000000 then {_trimmed('n / 1000.0::double')} || 'K'
  else {_trimmed('n / 1000000.0::double')} || 'M' end as text from s""")
def i03(spark, sf):
    scales = F.explode(F.array(*[F.lit(k).cast("long") for k in (0, 1, 25, 100)]))
    d = fx.table(spark, sf, "orders").select("o_orderkey", F.floor("o_totalprice").alias("p"), scales.alias("k"))
    return d.select("o_orderkey", (F.col("p") * F.col("k")).alias("n")).withColumn("text", fn.human_count(F.col("n")))


@query("i04_parse_kv", "select run_id, p_status as a, p_seed || '=' || p_year as b, p_priority as c from v_trials")
def i04(spark, sf):
    # a repeated key keeps its last value; text after a second '=' stays
    text = F.concat(F.lit("a=old,b="), "p_seed", F.lit("="), "p_year", F.lit(",a="), "p_status", F.lit(",c="), "p_priority")
    d = fx.trials(spark, sf).select("run_id", fn.parse_kv(text).alias("m"))
    return d.select("run_id", *[F.col("m").getItem(k).alias(k) for k in "abc"])


@query("i05_render_args", """
select run_id, ' --' || p_year || case when p_status = 'F' then ' --flag' else '' end || ' --lr ' || p_seed || ' --name "a:' || p_priority || '"' as args from v_trials""")
def i05(spark, sf):
    flag = F.when(F.col("p_status") == "F", "true").otherwise("false")
    params = F.create_map(
        F.lit("--"), F.col("p_year"), F.lit("flag"), flag, F.lit("lr"), F.col("p_seed"), F.lit("name"), F.concat(F.lit("a:"), "p_priority"),
        F.lit("gpu"), F.lit("0"),
    )
    return fx.trials(spark, sf).select("run_id", fn.render_args(params, skip=["gpu"]).alias("args"))


@query("i06_render_env", "select run_id, 'p_seed=' || p_seed || ' p_year=' || p_year as env from v_trials")
def i06(spark, sf):
    return fx.trials(spark, sf).select("run_id", fn.render_env(F.col("config"), ["p_year", "p_seed"]).alias("env"))


@query("i07_encode_comment", """
select job_id, replace(replace('{"line": "' || submit_line || '"}', '"', '@@@'), ' ', '___') as encoded, true as same from v_jobs""")
def i07(spark, sf):
    text = F.concat(F.lit('{"line": "'), "submit_line", F.lit('"}'))
    encoded = fn.encode_comment(text)
    return fx.jobs(spark, sf).select("job_id", encoded.alias("encoded"), (fn.decode_comment(encoded) == text).alias("same"))


@query("i08_path_parts", "select file_id, regexp_extract(path, '[^/]*$') as base, regexp_replace(path, '/[^/]*$', '') as dir from v_files")
def i08(spark, sf):
    return fx.files(spark, sf).select("file_id", fn.base_name(F.col("path")).alias("base"), fn.dir_name(F.col("path")).alias("dir"))


@query("i09_millis_between", "select event_id, round((epoch_us(ts) - epoch_us(timestamp '2024-01-01 00:00:00')) / 1000.0, 3) as ms from events")
def i09(spark, sf):
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    return fx.table(spark, sf, "events").select("event_id", F.round(fn.millis_between(start, F.col("ts")), 3).alias("ms"))


@query("i10_run_signature", "select event_id, strftime(ts, '%Y-%m-%d_%H-%M-%S_%f') as long, strftime(ts, '%m%d%y_%H%M%S_%f') as short from events")
def i10(spark, sf):
    ts = F.col("ts")
    return fx.table(spark, sf, "events").select("event_id", fn.run_signature(ts).alias("long"), fn.run_signature_short(ts).alias("short"))


@query("i11_array_parts", """
select vec_id, round(list_sum(embedding[3:10]::double[]), 6) as part, round(list_sum(embedding[60:64]::double[]), 6) as tail,
       round(embedding[64]::double, 6) as last, null::double as beyond, round(embedding[2]::double + embedding[4]::double, 6) as inner_items, 4 as flat
from embeddings""")
def i11(spark, sf):
    e = F.col("embedding")
    total = lambda a: F.round(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double")), 6)
    nested = F.array(F.slice(e, 1, 2), F.slice(e, 3, 2))
    mapped = fn.over_map(F.create_map(F.lit("m"), nested), fn.array_flatten)
    return fx.features(spark, sf).select(
        "vec_id", total(fn.array_slice(e, 2, 10)).alias("part"), total(fn.array_slice(e, -5, 1000)).alias("tail"),
        F.round(fn.array_item(e, -1).cast("double"), 6).alias("last"), fn.array_item(e, 64).cast("double").alias("beyond"),
        total(fn.array_item(nested, 1, dim=1)).alias("inner_items"), F.size(mapped["m"]).alias("flat"),
    )


@query("i12_one_hot", "select vec_id, list_aggregate([case when i = label then 1 else 0 end for i in range(10)], 'string_agg', '') as bits from embeddings")
def i12(spark, sf):
    bits = F.array_join(F.transform(fn.one_hot(F.col("label"), 10), lambda x: x.cast("string")), "")
    return fx.features(spark, sf).select("vec_id", bits.alias("bits"))


@query("i13_json_field", "select event_id, cast(json_extract(props, '$.k') as bigint) as k, cast(null as varchar) as missing, cast(null as varchar) as broken from events")
def i13(spark, sf):
    return fx.table(spark, sf, "events").select(
        "event_id", fn.json_field(F.col("props"), "k", "bigint").alias("k"), fn.json_field(F.col("props"), "nope").alias("missing"),
        fn.json_field(F.substring("props", 1, 4), "k").alias("broken"),
    )
