"""What the physical plans must and must not have, and what settings must not
change."""

import re

import pytest

from compare import connect, mismatch
from voxtally.plans import catalog, oracle

SF = "/root/testdata/sf0.001"
QUERIES, ORACLE = catalog.queries(), oracle.oracle_sql()
# Groups whose size has a bound: a list segment, and the volume of a chunk.
BOUNDED_LISTS = {"asg_group_csv", "chk_grid_assemble", "chk_increment_int", "chk_increment_wrap", "chk_all_steps_arrays"}
RUNS_PYTHON = {
    "chk_iterate_n", "chk_user_fn", "chk_user_steps", "chk_zero_pad_grid", "chk_array_split",
    "chk_grid_assemble", "snk_image_roundtrip", "chk_increment_int", "chk_increment_wrap", "chk_split_saved",
    "chk_user_steps_slabs", "src_binary_scan", "chk_all_steps_arrays", "chk_named_outputs", "chk_rechunk_slabs", "chk_join_parts",
    "snk_each_iteration", "src_images_by_path",
}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def plans(built):
    return {name: built(name)[1] for name in QUERIES}


def test_no_query_pairs_rows_without_a_key(plans):
    for name, text in plans.items():
        assert "CartesianProduct" not in text and "NestedLoop" not in text, name


def test_only_partition_totals_and_whole_aggregates_meet_in_one_task(plans):
    for name, text in plans.items():
        lines = text.splitlines()
        for i, line in enumerate(lines):
            if "Exchange SinglePartition" in line:
                # what comes together is one row per task, or one per range partition
                below = next(x for x in lines[i + 1 :] if re.search(r"[A-Z]\w+", x) and "InputAdapter" not in x)
                assert re.search(r"Aggregate\(keys=\[(_part#\d+L?)?\], functions=\[", below), (name, below)


def test_no_unbounded_lists_or_percentiles(plans):
    for name, text in plans.items():
        assert "percentile" not in text, name
        assert name in BOUNDED_LISTS or "collect_list" not in text, name


def test_python_only_where_user_code_or_arrays_need_it(plans):
    for name, text in plans.items():
        uses = "ArrowEvalPython" in text or "MapIn" in text
        assert uses == (name in RUNS_PYTHON), name
        assert "BatchEvalPython" not in text, name


@pytest.mark.parametrize(
    "name,columns",
    [
        ("chk_increment", "vec_id:bigint,embedding:array<float>"),
        ("chk_grid_split", "l_partkey:bigint,l_suppkey:bigint,l_linenumber:int,l_quantity:double"),
        ("nam_basename", "page_id:bigint,url:string"),
        ("mod_breakeven", "l_suppkey:bigint,l_quantity:double,l_extendedprice:double"),
        ("cnd_parse", "event_id:bigint,user_id:bigint"),
        ("asg_counts", "event_id:bigint,user_id:bigint,event_type:string"),
    ],
)
def test_scans_read_only_what_is_needed(plans, name, columns):
    assert f"ReadSchema: struct<{columns}>" in plans[name]


def test_one_shuffle_for_one_aggregate(plans):
    for name in ("mks_multi_driver", "mks_single_driver", "iob_histogram", "chk_grid_split", "mod_breakeven"):
        assert plans[name].count("Exchange ") == 1, name
    for name in ("chk_increment", "chk_iterate_n", "evt_parse", "iob_bandwidth", "scl_md5"):
        assert "Exchange" not in plans[name], name


def test_runs_are_computed_once(plans):
    for name in ("mod_speedup", "mod_region", "mod_avg_slowdown", "rpt_axis_position", "rpt_exp1"):
        assert plans[name].count("orders.parquet") == 1, name


@pytest.mark.parametrize("name", ["evt_rebase", "mks_join_runs", "mod_region", "iob_distribution", "cnd_dataset_join"])
def test_results_do_not_need_broadcasts(spark, name):
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        text = plan(QUERIES[name](spark, SF))
        assert mismatch(spark, connect(SF), QUERIES[name], ORACLE[name], SF) is None
    finally:
        spark.conf.set(key, before)
    if name in ("evt_rebase", "mks_join_runs"):
        assert "SortMergeJoin" in text


@pytest.mark.parametrize("key,value", [
    ("spark.sql.session.timeZone", "America/New_York"),
    ("spark.sql.shuffle.partitions", "3"),
    ("spark.sql.adaptive.enabled", "false"),
    ("spark.sql.ansi.enabled", "false"),
])
@pytest.mark.parametrize("name", ["evt_render", "evt_seq_id", "iob_distribution", "mod_concurrency", "asg_ntile"])
def test_results_do_not_depend_on_settings(spark, name, key, value):
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        assert mismatch(spark, connect(SF), QUERIES[name], ORACLE[name], SF) is None
    finally:
        spark.conf.set(key, before)


def test_intermediate_tables_go_to_the_named_folder(spark, tmp_path):
    from voxtally.session import materialize, scratch_dir

    key = "spark.checkpoint.dir"
    named = spark.conf.get(key, None)
    if named:
        assert scratch_dir(spark).startswith(named.rstrip("/"))
    table = materialize(spark.range(3), "t")
    assert sorted(r.id for r in table.collect()) == [0, 1, 2]
    assert table.inputFiles()[0].removeprefix("file://").removeprefix("file:").startswith(scratch_dir(spark).removeprefix("file:"))
