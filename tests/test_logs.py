"""Event logs of every variant, run names, makespans and timelines."""

import itertools
import json

import pytest
from pyspark.sql import functions as F

from voxtally.functions import fixed, naming
from voxtally.functions.runs import parse_run_name
from voxtally.operators import bandwidth, conditions, events, makespan
from voxtally.sources import files, logs
from voxtally.streaming.events import follow_event_logs, running_makespans

MEMORY = """\
driver_program 0 32.5 n1 allfiles 46
read_img 14.7 15.25 n2 img_0_0_0.nii 46
increment_data 15.25 17.75 n2 img_0_0_0.nii 46
increment_data 17.75 18 n2 img_0_0_0.nii 46
save_incremented 18 29.5 n2 img_0_0_0.nii 46
"""
FILES = """\
driver_program 0 37.5 n1 allfiles 46
read_file 1543225302.5 1543225302.5 n1 img_0_0_0.nii 46
write_file 1543225307.25 1543225311.75 n1 inc-img_0_0_0.nii 46
increment_data 4.75 16.5 n1 inc-img_0_0_0.nii 46
save_incremented 16.5 24.5 n1 img_0_0_0.nii 46
"""
WORKFLOW = """\
driver_program 1543387363.25 1543387524.5 n1 allfiles 46
inc_chunk 1543387367.5 1543387386.25 n1 img_4_0_0.nii 46
Read file 1543387395.5 1543387395.5 n1 inc-img_4_0_0.nii 46
Write file 1543387396 1543387401.25 n1 inc-img_4_0_0.nii 46
driver_program 1543387360.5 1543387500.0 n2 allfiles 47
save_results 1543387402 1543387403.5 n1 inc2-img_4_0_0.nii 46
this line is broken
driver_program 1543387370 1543387530.75 n3 allfiles 48
"""
NAMES = {
    "sp_mem_2it125BB_2.4delay.out": MEMORY,
    "sp_local_2it125BB_2.4delay.out": FILES,
    "np_local_2it125BB_2.4delay.out": WORKFLOW,
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("logs")
    for name, text in NAMES.items():
        (d / name).write_text(text)
    return d


@pytest.fixture(scope="module")
def log(spark, folder):
    return logs.read_event_logs(spark, str(folder))


def test_every_line_is_an_event_or_corrupt(log):
    rows = log.collect()
    assert len(rows) == sum(t.count("\n") for t in NAMES.values())
    assert [r._corrupt for r in rows if r._corrupt] == ["this line is broken"]
    assert all(r.name is None and r.start is None for r in rows if r._corrupt)
    names = {r.name for r in rows if r.run.startswith("np")}
    assert names == {"driver_program", "inc_chunk", "read_file", "write_file", "save_results", None}


def test_render_is_the_inverse_of_parse(spark, log):
    good = log.filter("_corrupt is null")
    good = good.drop("line")
    again = logs.parse_event_lines(events.render(good))
    assert sorted(map(str, again.collect())) == sorted(map(str, good.collect()))


def test_makespan_rules(spark, log):
    with_order = log
    got = {r.run[:8]: r.makespan for r in makespan.makespans(with_order, "line").collect()}
    assert got == {"sp_mem_2": 32.5, "sp_local": 37.5, "np_local": 1543387530.75 - 1543387360.5}
    multi = {r.run: r.makespan for r in makespan.multi_driver(log).collect()}
    assert multi["np_local_2it125BB_2.4delay.out"] == 170.25


def test_makespan_lines_go_out_and_come_back(spark, log, tmp_path):
    spans = makespan.multi_driver(log)
    line = makespan.makespan_line(F.col("run"), F.col("makespan"), F.lit("n1"), F.lit(46))
    makespan.write_makespans(spans.select(line.alias("value")), str(tmp_path / "m"))
    text = spark.read.text(str(tmp_path / "m"))
    assert "np_local_2it125BB_2.4delay.out:driver_program 0 170.250000 n1 allfiles 46" in {
        r.value for r in text.collect()
    }
    back = text.select(*logs.parse_makespan_line(F.col("value")))
    assert sorted(back.collect()) == sorted(spans.collect())


def test_rebase_only_where_the_clock_is_absolute(log):
    epoch = F.startswith(F.col("run"), F.lit("np_"))
    rows = events.rebase(log.filter("_corrupt is null"), epoch).collect()
    workflow = [r for r in rows if r.run.startswith("np")]
    assert min(r.start for r in workflow) == 0 and max(r.end for r in workflow) == 170.25
    assert {(r.start, r.end) for r in rows if r.run.startswith("sp_mem")} == {
        (0, 32.5), (14.7, 15.25), (15.25, 17.75), (17.75, 18), (18, 29.5)
    }


def test_timeline_document(spark, log, tmp_path):
    kept = log.filter("run like 'sp_local%'")
    tasks = events.timeline(kept, ["line"])
    events.write_timeline(tasks, str(tmp_path / "t"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "t").glob("part-*")))
    assert json.loads(text) == {
        "tasks": [
            {"name": "driver_program", "id": 0, "start-time": 0.0, "end-time": 37.5, "node": "n1"},
            {"name": "increment_data", "id": 1, "start-time": 4.75, "end-time": 16.5, "node": "n1"},
            {"name": "save_incremented", "id": 2, "start-time": 16.5, "end-time": 24.5, "node": "n1"},
        ]
    }


def test_bandwidth_floor_and_memory_runs(log):
    named = log.select("*", *parse_run_name(F.col("run")))
    rows = {(r.engine, r.op): r for r in bandwidth.io_bandwidths(named).collect()}
    mb = 76727 / 125
    assert rows["sp", "read"].mb_s == pytest.approx(mb / 0.004) and rows["sp", "read"].floored == 1
    assert rows["np", "write"].mb_s == pytest.approx(mb / 5.25)
    assert len(rows) == 4  # nothing of the in-memory run
    both = bandwidth.both_levels(bandwidth.io_bandwidths(named)).collect()
    assert {(r.engine, r.op): r.n for r in both}[None, "read"] == 2


@pytest.mark.parametrize(
    "image,blocks,size",
    [("MRI", 125, 102752 / 2**20), ("HBB", 125, 321813010 / 2**20), ("BB", 30, 76727 / 30), ("BB", 750, 76727 / 750)],
)
def test_chunk_sizes(spark, image, blocks, size):
    from voxtally.functions.modeling import chunk_mb

    got = spark.range(1).select(chunk_mb(F.lit(image), F.lit(blocks)).alias("s")).first().s
    assert got == pytest.approx(size)


@pytest.mark.parametrize(
    "name,fields",
    [
        ("sp_lustre_100it125BB_2.4delay.out", ("sp", "lustre", 100, 125, "BB", 2.4)),
        ("np_local_1it125BB_320delay.out", ("np", "local", 1, 125, "BB", 320.0)),
        ("sp_mem_10it125MRI_1.76delay.out", ("sp", "mem", 10, 125, "MRI", 1.76)),
        ("np_lustre_10it125HBB_1.76delay.out", ("np", "lustre", 10, 125, "HBB", 1.76)),
        ("sp_tmpfs_10it30BB_14.67delay.out", ("sp", "tmpfs", 10, 30, "BB", 14.67)),
        ("sp_tmpfs_10it30BB_14.67delay", ("sp", "tmpfs", 10, 30, "BB", 14.67)),
        ("notes.txt", (None,) * 6),
        ("sp_tmpfs_tenit30BB_14.67delay.out", (None,) * 6),
    ],
)
def test_run_names(spark, name, fields):
    df = spark.createDataFrame([(name,)], "run string").select(*parse_run_name(F.col("run")))
    assert tuple(df.first()) == fields


def test_every_condition_survives_its_run_name(spark, tmp_path):
    grid = itertools.product(
        ["spark", "other"], fixed.FILE_SYSTEMS, [1, 10, 100], fixed.DATASETS, [0.59, 2.4, 14.67, 320]
    )
    cases = [
        {"experiment": 1, "framework": fw, "filesystem": fs, "delay": d, "dataset": ds, "iterations": it}
        for fw, fs, it, ds, d in grid
    ]
    (tmp_path / "c.json").write_text(json.dumps(cases))
    read = logs.read_conditions(spark, str(tmp_path / "c.json"))
    assert read.count() == len(cases)
    named = conditions.with_run_name(read)
    back = named.select("*", F.struct(*parse_run_name(F.col("run"))).alias("p")).collect()
    for r in back:
        assert r.p.engine == ("sp" if r.framework == "spark" else "np")
        assert (r.p.fs, r.p.iterations, r.p.delay) == (r.filesystem, r.iterations, r.delay)
        assert f"{r.p.blocks}{r.p.image}" == fixed.DATASETS[r.dataset][0]
    no_delay = conditions.with_run_name(read.withColumn("delay", F.lit(None).cast("double")).limit(1))
    assert no_delay.first().run == "sp_mem_1it125BB"


def test_legend(spark, tmp_path):
    (tmp_path / "legend.txt").write_text("a.nii b.nii\tc.nii d.nii  ")
    got = files.read_legend(spark, str(tmp_path / "legend.txt")).collect()
    assert sorted(map(tuple, got)) == [(0, "a.nii"), (1, "b.nii"), (2, "c.nii"), (3, "d.nii")]
    (tmp_path / "lines.txt").write_text("a b\nc d\n\n e f")
    got = files.read_legend(spark, str(tmp_path / "lines.txt")).collect()
    assert sorted(map(tuple, got)) == list(enumerate("abcdef"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200b")
    try:
        (tmp_path / "long.txt").write_text("\n".join(f"n{i} m{i}" for i in range(400)))
        got = files.read_legend(spark, str(tmp_path / "long.txt")).collect()
        assert [r.chunk for r in sorted(got, key=lambda r: r.pos)] == [f"{c}{i}" for i in range(400) for c in "nm"]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_mixed_clocks(spark):
    rows = [
        ("sp", "driver_program", 0.0, 90.0), ("sp", "increment_data", 4.5, 6.0),
        ("sp", "read_file", 1.5e9 + 10, 1.5e9 + 12), ("sp", "write_file", 1.5e9 + 30, 1.5e9 + 31),
        ("np", "driver_program", 1.4e9, 1.4e9 + 50), ("np", "read_file", 1.4e9 + 2, 1.4e9 + 3), ("rel", "read_file", 3.0, 4.0),
    ]
    df = spark.createDataFrame(rows, "run string, name string, start double, end double")
    got = {(r.run, r.name): (r.start, r.end) for r in events.on_one_clock(df).collect()}
    assert got == {
        ("sp", "driver_program"): (0.0, 90.0), ("sp", "increment_data"): (4.5, 6.0), ("sp", "read_file"): (0.0, 2.0),
        ("sp", "write_file"): (20.0, 21.0), ("np", "driver_program"): (0.0, 50.0), ("np", "read_file"): (2.0, 3.0),
        ("rel", "read_file"): (3.0, 4.0),
    }


@pytest.mark.parametrize(
    "path,offsets",
    [
        ("/d/img_1538_603_0.nii", ("img", 1538, 603, 0)),
        ("inc10-my_img_64_80_40.nii", ("my_img", 64, 80, 40)),
        ("inc-inc-a_1_2_3.nii", ("a", 1, 2, 3)),
        ("plain.nii", (None, None, None, None)),
    ],
)
def test_chunk_names(spark, path, offsets):
    df = spark.createDataFrame([(path,)], "p string")
    p = F.col("p")
    assert tuple(df.select(naming.chunk_image(p), *naming.chunk_offsets(p)).first()) == offsets


def test_path_names(spark):
    def one(column):
        return spark.range(1).select(column.alias("c")).first().c

    assert one(naming.intermediate_name(F.lit("/a/province.nii"))) == "inc-province.nii"
    assert one(naming.intermediate_name(F.lit("/a/province.nii"), "anywhere")) == "province.nii"
    assert one(naming.intermediate_name(F.lit("/a/inc-x.nii"))) == "inc-x.nii"
    assert one(naming.final_name(F.lit("/a/inc-inc-x.nii"), 10)) == "inc10-x.nii"
    assert one(naming.strip_scheme(F.lit("file:/a/b"))) == "/a/b"
    assert one(naming.strip_scheme(F.lit("/a/b"))) == "/a/b"
    assert one(naming.strip_suffix(F.lit("2.4delay.out"), ".out")) == "2.4delay"
    assert one(naming.join_path(F.lit("/a"), F.lit("/b"))) == "/b"
    assert one(naming.join_path(F.lit("/a/"), F.lit("b"))) == "/a/b"
    assert one(naming.dirname(F.lit("/b"))) == "/" and one(naming.dirname(F.lit("b"))) == ""


def test_logs_can_be_followed(spark, folder, tmp_path):
    spans = running_makespans(follow_event_logs(spark, str(folder), files_per_trigger=1))
    q = (
        spans.writeStream.outputMode("complete").format("memory").queryName("spans")
        .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    )
    q.awaitTermination(120)
    want = makespan.multi_driver(logs.read_event_logs(spark, str(folder)))
    assert sorted(spark.table("spans").collect()) == sorted(want.collect())
