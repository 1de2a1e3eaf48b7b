"""Every query against its SQL on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from seriesmill import plans

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def plain(x):
    if pd.isna(x):
        return None
    if isinstance(x, bool | np.bool_):
        return bool(x)
    return round(float(x), 6) if isinstance(x, float | int | np.number) else x


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted((tuple(map(plain, r)) for r in frame.astype(object).values.tolist()), key=repr)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, duck, name):
    got, want = plans.QUERIES[name](spark, DATA).toPandas(), duck.sql(plans.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
    if name not in ("select_no_match", "catalog_gc"):
        assert len(got)


def test_every_query_has_sql():
    assert set(plans.SQL) == set(plans.QUERIES)


def test_time_and_metric_reach_the_scan(spark):
    from seriesmill.operators.matchers import Matcher
    from seriesmill.operators.select import select
    from seriesmill.sources import bridge
    from seriesmill.sources.scratch import folder

    path = folder(spark, "samples")
    bridge.event_samples(spark, DATA).write.parquet(path)
    plan = select(bridge.event_series(spark, DATA), spark.read.parquet(path), [Matcher("__name__", "=", "click")], 0, 10)._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(ts_ms,0)" in plan and "EqualTo(event_type,click)" in plan
