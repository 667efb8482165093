"""Every registered query against its SQL, over whole tables."""

import pytest

import __spark_entry__ as entry_point
from compare import connect, mismatch
from voxtally.plans import catalog, oracle

SF = "/root/testdata/sf0.001"
QUERIES, ORACLE = catalog.queries(), oracle.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, duck, built, name):
    assert mismatch(spark, duck, lambda *_: built(name)[0], ORACLE[name], SF) is None


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


def test_binary_scan_reads_every_file_whole(spark):
    import hashlib
    from pathlib import Path

    from pyspark.sql import functions as F
    from voxtally.sources.files import scan_binary

    rows = scan_binary(spark, f"{SF}/*.parquet").select("path", "length", F.md5("content").alias("md5")).collect()
    want = {(p.name, p.stat().st_size, hashlib.md5(p.read_bytes()).hexdigest()) for p in Path(SF).glob("*.parquet")}
    assert {(r.path.rsplit("/", 1)[-1], r.length, r.md5) for r in rows} == want


def test_entry(spark):
    df = entry_point.entry(spark)
    assert df.columns == ["vec_id", "pos", "voxel"]
    assert df.count() > 0
