"""The command line over small logs and images."""

import json

import images
import pytest
from test_logs import NAMES
from voxtally.__main__ import main


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("cli-logs")
    for name, text in NAMES.items():
        (d / name).write_text(text)
    return d


def lines(path):
    return [line for p in sorted(path.glob("part-*")) for line in p.read_text().splitlines()]


def test_increment(spark, tmp_path):
    images.grid(tmp_path / "in", parts=1)
    main(["increment", str(tmp_path / "in"), str(tmp_path / "out"), "2", "--benchmark"])
    assert (tmp_path / "out" / "inc2-dummy_0_0_0.nii").exists()


def test_makespans(spark, folder, tmp_path):
    main(["makespans", str(folder), str(tmp_path / "m")])
    assert sorted(lines(tmp_path / "m")) == [
        "np_local_2it125BB_2.4delay.out:driver_program 0 170.250000 n1 allfiles 46",
        "sp_local_2it125BB_2.4delay.out:driver_program 0 37.500000 n1 allfiles 46",
        "sp_mem_2it125BB_2.4delay.out:driver_program 0 32.500000 n1 allfiles 46",
    ]


def test_report_speedup_and_io(spark, folder, tmp_path):
    main(["report", str(folder), str(tmp_path / "r"), "4", "-c", "2"])
    header, row = lines(tmp_path / "r")
    assert dict(zip(header.split(","), row.split(",")))["sp_mem"] == "32.5"
    main(["speedup", str(folder), str(tmp_path / "s")])
    assert len(lines(tmp_path / "s")) == 2
    main(["io", str(folder), str(tmp_path / "i")])
    assert {r.split(",")[0] for r in lines(tmp_path / "i")} == {"engine", "sp", "np", "all"}


def test_timeline(spark, folder, tmp_path):
    main(["timeline", str(folder / "np_local_2it125BB_2.4delay.out"), str(tmp_path / "t"), "--rebase"])
    doc = json.loads("".join(lines(tmp_path / "t")))
    assert [t["id"] for t in doc["tasks"]] == list(range(5))
    assert doc["tasks"][0]["name"] == "driver_program" and doc["tasks"][2]["start-time"] == 0
    assert [t["name"] for t in doc["tasks"]][-1] == "driver_program"


def test_write_times(spark, tmp_path):
    from voxtally.operators.bandwidth import write_time_by_count, write_times

    df = spark.createDataFrame([(2, 0.5), (2, 1.0), (5, 3.0)], "chunks int, seconds double")
    write_times(write_time_by_count(df, "chunks", "seconds"), str(tmp_path / "w"))
    got = {r["chunks"]: r["write_seconds"] for r in map(json.loads, lines(tmp_path / "w"))}
    assert got == {2: 1.5, 5: 3.0}
