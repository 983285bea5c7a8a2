"""The sweep-shaped views of the test tables: runs, points, logs, jobs, features, files, chat records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.operators.blocks import block_of, dense_positions

PARAMS = ("p_status", "p_priority", "p_year", "p_seed", "p_const")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def trials(spark: SparkSession, sf: str) -> DataFrame:
    """Runs with their config, as a map and as ``p_*`` columns."""
    o = table(spark, sf, "orders")
    key = F.col("o_orderkey")
    d = o.select(
        key.alias("run_id"),
        F.concat(F.lit("/sweeps/s"), (F.col("o_custkey") % 10).cast("string")).alias("sweep"),
        F.col("o_orderstatus").alias("p_status"),
        F.col("o_orderpriority").alias("p_priority"),
        F.year("o_orderdate").cast("string").alias("p_year"),
        (key % 5).cast("string").alias("p_seed"),
        F.lit("fixed").alias("p_const"),
        F.col("o_orderdate").alias("modified_at"),
    )
    d = d.withColumn("folder", F.concat("sweep", F.lit("/"), F.col("run_id").cast("string")))
    config = F.create_map(*[c for p in PARAMS for c in (F.lit(p), F.col(p))])
    return d.withColumn("config", config)


def ordered_lines(spark: SparkSession, sf: str, *extra: str) -> DataFrame:
    """Line items with their 0-based position within the order."""
    cols = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", *extra]
    li = table(spark, sf, "lineitem").select(*cols)
    return dense_positions(li, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"], block_of("l_linenumber", 2))


POINT_VALUES = {"price": "l_extendedprice", "qty": "l_quantity"}


def points(spark: SparkSession, sf: str, metrics: Sequence[str] = ("price", "qty")) -> DataFrame:
    return points_of(ordered_lines(spark, sf), metrics)


def points_of(lines: DataFrame, metrics: Sequence[str] = ("price", "qty")) -> DataFrame:
    """The values of ordered lines, one row for each metric."""
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(POINT_VALUES[m]).alias("value")) for m in metrics])
    d = lines.select(F.col("l_orderkey").alias("run_id"), "pos", F.inline(pairs))
    return d.select("run_id", "metric", "pos", "value")


def log_lines(spark: SparkSession, sf: str) -> DataFrame:
    ev = table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type", "value")
    hour = F.date_trunc("hour", "ts")
    d = dense_positions(ev, ["user_id"], ["ts", "event_id"], hour, "line_no")
    text = F.concat(
        F.lit("["), "event_type", F.lit("] step="), F.col("event_id").cast("string"),
        F.lit(" value="), F.col("value").cast("decimal(12,2)").cast("string"),
    )
    return d.select(F.col("user_id").alias("folder"), "line_no", "ts", "event_type", "value", text.alias("line"))


def jobs(spark: SparkSession, sf: str) -> DataFrame:
    key, status = F.col("o_orderkey"), F.col("o_orderstatus")
    outputs = F.when(key % 3 == 0, "").otherwise("-e /logs/j%j.err -o /logs/j%j.out ")
    comment = F.when(key % 7 == 0, "--comment=rerun:x ").otherwise("")
    return table(spark, sf, "orders").select(
        key.alias("job_id"),
        F.when(status == "F", "FAILED").when(status == "O", "RUNNING").otherwise("PENDING").alias("state"),
        F.concat(F.lit("sbatch "), outputs, comment, F.lit("run.sh "), "o_orderpriority").alias("submit_line"),
    )


def features(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings")


def files(spark: SparkSession, sf: str) -> DataFrame:
    page = F.col("page_id")
    return table(spark, sf, "pages").select(
        page.alias("file_id"), F.col("url").alias("path"), F.concat(F.lit("d"), (page % 10).cast("string")).alias("folder"),
        F.length("html").cast("long").alias("size"), (page * 37 % 101).alias("mtime"),
    )


def chat(spark: SparkSession, sf: str) -> DataFrame:
    role = F.col("role")
    return table(spark, sf, "conversations").select(
        F.col("conv_id").alias("file"), F.col("turn").alias("line_no"), "role",
        F.when(role == "user", "args").when(role == "assistant", "stats").alias("kind"), "text",
    )


# The same views as SQL for the checking engine.
VIEW_SQL: dict[str, str] = {
    "v_trials": """
        select o_orderkey as run_id, '/sweeps/s' || cast(o_custkey % 10 as varchar) as sweep,
               '/sweeps/s' || cast(o_custkey % 10 as varchar) || '/' || cast(o_orderkey as varchar) as folder,
               o_orderstatus as p_status, o_orderpriority as p_priority, cast(year(o_orderdate) as varchar) as p_year,
               cast(o_orderkey % 5 as varchar) as p_seed, 'fixed' as p_const, o_orderdate as modified_at
        from orders""",
    "v_lines": """
        select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) - 1 as pos
        from lineitem""",
    "v_points": """
        select l_orderkey as run_id, m.metric as metric, pos,
               case m.metric when 'price' then l_extendedprice else l_quantity end as value
        from v_lines cross join (select 'price' as metric union all select 'qty' as metric) m""",
    "v_log": """
        select user_id as folder, row_number() over (partition by user_id order by ts, event_id) - 1 as line_no,
               ts, event_type, value,
               concat('[', event_type, '] step=', cast(event_id as varchar), ' value=', cast(cast(value as decimal(12,2)) as varchar)) as line
        from events""",
    "v_jobs": """
        select o_orderkey as job_id,
               case o_orderstatus when 'F' then 'FAILED' when 'O' then 'RUNNING' else 'PENDING' end as state,
               concat('sbatch ', case when o_orderkey % 3 = 0 then '' else '-e /logs/j%j.err -o /logs/j%j.out ' end,
                      case when o_orderkey % 7 = 0 then '--comment=rerun:x ' else '' end, 'run.sh ', o_orderpriority) as submit_line
        from orders""",
    "v_files": """
        select page_id as file_id, url as path, concat('d', cast(page_id % 10 as varchar)) as folder,
               length(html) as size, page_id * 37 % 101 as mtime
        from pages""",
    "v_chat": """
        select conv_id as file, turn as line_no, role,
               case role when 'user' then 'args' when 'assistant' then 'stats' else null end as kind, text
        from conversations""",
    "v_reduced": """
        select run_id, metric, avg(value) filter (where rk <= 5) as topk_mean, max(value) filter (where rk = 1) as best,
               max(pos) filter (where rk = 1) as best_idx, count(*) as len
        from (select *, row_number() over (partition by run_id, metric order by value desc, pos desc) as rk from v_points) r
        group by run_id, metric""",
    "v_board": """
        select t.run_id, t.sweep, t.folder, t.p_status, t.p_priority, t.p_year, t.p_seed,
               max(r.topk_mean) filter (where r.metric = 'price') as price, max(r.len) filter (where r.metric = 'price') as price_len,
               max(r.topk_mean) filter (where r.metric = 'qty') as qty, max(r.len) filter (where r.metric = 'qty') as qty_len
        from v_trials t left join v_reduced r on r.run_id = t.run_id
        group by all""",
    "v_curve": """
        select l_orderkey as run_id, o_orderstatus as group_key, l_quantity as x, l_extendedprice as y, pos as seq
        from v_lines join orders on o_orderkey = l_orderkey""",
}
