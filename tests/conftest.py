from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from basketry.session import build_session

    s = build_session(
        "local[4]", app_name="basketry-tests", shuffle_partitions=4, extra={"spark.driver.memory": "6g"}
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(autouse=True)
def _release_cache(request):
    yield
    if "spark" in request.fixturenames:
        request.getfixturevalue("spark").catalog.clearCache()


@pytest.fixture()
def skew_conf(spark):
    """Force the heavy-key path of the skew-safe windows on tiny inputs."""
    spark.conf.set("basketry.skew.heavyRows", "3")
    spark.conf.set("basketry.skew.bucketRows", "2")
    yield
    spark.conf.unset("basketry.skew.heavyRows")
    spark.conf.unset("basketry.skew.bucketRows")


def rows(df, *cols, order=None):
    """Collect as plain tuples, sorted (by ``order`` or all columns)."""
    cols = cols or tuple(df.columns)
    out = [tuple(r[c] for c in cols) for r in df.select(*cols).collect()]
    return sorted(out, key=lambda t: tuple((x is None, x) for x in t)) if order is None else out
