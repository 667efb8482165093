"""Steps with named inputs and outputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxtally.operators.graph import StepGraph


def functions():
    """Made here, so that they travel to the tasks by value."""

    def mean(voxels):
        return float(voxels.mean())

    def shifted(voxels, by):
        return voxels - by

    def halves(values):
        return values[:1], values[1:]

    return mean, shifted, halves


mean, shifted, halves = functions()


def chunks(spark):
    rows = [(i, [float(i + j) for j in range(8)], [2, 2, 2]) for i in range(5)] + [(9, None, [2, 2, 2])]
    return spark.createDataFrame(rows, "id int, voxels array<float>, shape array<int>").repartition(3)


def test_outputs_are_inputs_of_later_steps_in_any_order(spark):
    g = (
        StepGraph()
        .step(halves, ["low", "high"], {"values": "centred"})
        .step(shifted, "centred", {"voxels": "voxels", "by": "m"})
        .step(mean, "m")
    )
    got = {r.id: r for r in g.apply(chunks(spark), {"m": "double", "high": "array<double>", "voxels": "array<float>"}).collect()}
    assert list(got[0].asDict()) == ["id", "shape", "m", "high", "voxels"]
    for i in range(5):
        v = np.arange(i, i + 8, dtype="f4").reshape((2, 2, 2), order="F")
        assert got[i].m == v.mean()
        assert got[i].high == (v - v.mean())[1:].reshape(-1, order="F").tolist()
        assert got[i].voxels == v.reshape(-1, order="F").tolist()
    assert got[9].m is None and got[9].high is None


def test_only_needed_steps_run_and_each_once(spark):
    def never(voxels):
        raise AssertionError("not needed")

    g = StepGraph().step(mean, "m").step(never, "n").step(lambda m: m + 1, "next", ("m",), name="next")
    got = g.apply(chunks(spark).where("voxels is not null"), {"next": "double", "m": "double"}, times=True).collect()
    assert all(r.next == r.m + 1 for r in got)
    assert all([t.step for t in r.times] == ["mean", "next"] and all(t.end >= t.start for t in r.times) for r in got)


def test_wrong_graphs(spark):
    with pytest.raises(ValueError, match="no step gives lost, which shifted needs"):
        StepGraph().step(shifted, "s", {"voxels": "voxels", "by": "lost"}).ordered(["s"])
    with pytest.raises(ValueError, match="no step gives none"):
        StepGraph().ordered(["none"])
    circle = StepGraph().step(shifted, "a", {"voxels": "voxels", "by": "b"}, name="one").step(mean, "b", {"voxels": "a"}, name="two")
    with pytest.raises(ValueError, match="need each other: one -> two -> one"):
        circle.ordered(["a"])
    with pytest.raises(ValueError, match="already an output called a"):
        StepGraph().step(mean, "a").step(mean, "a")
    with pytest.raises(ValueError, match="already an output called voxels"):
        StepGraph().step(mean, "voxels")
    with pytest.raises(Exception, match="has to give a tuple"):
        StepGraph().step(mean, ["a", "b"]).apply(chunks(spark), {"a": "double"}).collect()
    with pytest.raises(Exception, match="do not fit"):
        StepGraph().step(lambda voxels: voxels / 3, "a").apply(chunks(spark), {"a": "array<int>"}).collect()
    blocks = chunks(spark).withColumn("n_blocks", F.lit(2))
    with pytest.raises(Exception, match="whole image"):
        StepGraph().step(mean, "a").apply(blocks, {"a": "double"}).collect()
