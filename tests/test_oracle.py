"""Every registered query against its DuckDB oracle at sf0.001 (rows, columns, values)."""

import os
import sys

import pytest

from conftest import ROOT, SF001

sys.path.insert(0, os.path.join(ROOT, "tools"))


def test_all_queries_match_oracle(spark):
    from check_oracle import compare
    from turnwise.plans import catalog
    catalog.load_all()
    res = compare(spark, SF001, names=list(catalog.QUERIES), verbose=False)
    bad = {k: v for k, v in res.items() if v.get("match") is False}
    assert not bad, bad
    assert sum(1 for v in res.values() if v.get("match")) >= 100


def test_entry_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() > 0
    assert {"conversation_id", "single_turn_ratio"} <= set(df.columns)
