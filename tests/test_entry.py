"""The driver's contract."""

from __future__ import annotations

import importlib
import os
import sys

import pytest

import __spark_entry__
from seriesmill import plans


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_entry(spark):
    got = __spark_entry__.entry(spark)
    assert got.columns == ["ls_key", "ts_ms", "value"] and got.count() > 0


def test_queries_without_the_training_operators(monkeypatch):
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    alone = importlib.reload(__spark_entry__)
    assert set(alone.queries()) == set(plans.QUERIES) and set(alone.oracle_sql()) == set(plans.SQL)
    monkeypatch.undo()
    importlib.reload(__spark_entry__)


def test_sql_is_of_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
