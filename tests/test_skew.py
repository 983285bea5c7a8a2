"""Order-dependent queries when one key holds a third of all rows and huge groups are cut into blocks."""

import duckdb
import pytest
from oracle_check import compare, connect

import __spark_entry__ as driver
from runlens import session
from runlens.operators import blocks, logs
from runlens.plans import catalog_logs

SF = "/root/testdata/sf0.001"
NAMES = [
    "a04_parse_tagged_json", "a05_parse_mode_log", "a07_scalar_files_all", "a10_probe_logs", "c01_longest_section", "c02_extract_events",
    "c04_merge_matchers", "c09_align_dicts", "d01_align_curves", "e01_reduce_series", "e02_reduce_series_at", "e04_id_ranges",
    "e12_curve_mean_std", "e14_describe_values", "e15_value_stats", "e17_step_timing", "f01_moving_average_3", "f02_clipped_mean_everywhere",
    "f03_resample_linear", "f07_topk_admission", "j06_live_topk", "j06_slots",
]
HOT = {
    # part numbers made unique, so that the order of a run's points is
    "lineitem": "select * replace (case when hash(l_partkey, l_suppkey, l_linenumber) % 3 = 0 then 7 else l_orderkey end as l_orderkey, "
    "row_number() over (order by l_orderkey, l_linenumber, l_partkey, l_suppkey) as l_partkey) from '{p}'",
    "events": "select * replace (case when event_id % 3 = 0 then 2 else user_id end as user_id) from '{p}'",
    "orders": "select * replace (case when o_orderkey % 3 = 0 then 1 else o_custkey end as o_custkey) from '{p}'",
    "conversations": "select conv_id % 3 as conv_id, row_number() over (partition by conv_id % 3 order by conv_id, turn) - 1 as turn, role, text from '{p}'",
}


@pytest.fixture(scope="module")
def skewed(tmp_path_factory):
    out = tmp_path_factory.mktemp("skewed")
    con = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        path = f"{SF}/{name}.parquet"
        sql = HOT.get(name, "select * from '{p}'").format(p=path)
        con.execute(f"copy ({sql}) to '{out}/{name}.parquet' (format parquet)")
    return str(out)


@pytest.mark.parametrize("name", NAMES)
def test_skewed(spark, skewed, name, monkeypatch):
    monkeypatch.setattr(blocks, "HOT_ROWS", 50)
    ok, message = compare(spark, connect(skewed), skewed, name, driver.queries()[name], driver.oracle_sql().get(name))
    assert ok, message


def scans(plan: str) -> int:
    """File scans of an executed plan; what was checkpointed is no scan."""
    final = plan.split("Initial Plan")[0]
    return final.count("Scan parquet") + final.count("BatchScan")


@pytest.mark.parametrize("name", ["c01_longest_section", "c02_extract_events", "c04_merge_matchers", "e15_value_stats"])
def test_ordered_work_reads_its_input_twice_at_most(spark, skewed, name, monkeypatch):
    """Cut groups and all: every plan that runs, checkpoints included, has two scans at most."""
    seen = []
    keep = session.cut

    def counted(df):
        seen.append(df)
        return keep(df)

    for module in (session, logs, catalog_logs):
        monkeypatch.setattr(module, "cut", counted)
    out = driver.queries()[name](spark, skewed)
    out.collect()
    found = []
    for df in [*seen, out]:
        df.collect()
        found.append(scans(df._jdf.queryExecution().executedPlan().toString()))
    assert max(found) <= 2 and sum(found) <= 4, found
