import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

from voxtally.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "voxtally-tests",
        "local[8]",
        **{
            "spark.ui.enabled": "false",
            "spark.sql.shuffle.partitions": "8",
            "spark.driver.memory": "8g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def built(spark):
    """Each registered query on the smallest tables, built once, and its plan before it runs."""
    from voxtally.plans import catalog

    held = {}

    def get(name):
        if name not in held:
            df = catalog.queries()[name](spark, "/root/testdata/sf0.001")
            held[name] = df, df._jdf.queryExecution().executedPlan().toString()
        return held[name]

    return get
