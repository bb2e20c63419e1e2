"""Every query with an oracle, on the smallest data, against DuckDB."""

from __future__ import annotations

import numbers
from collections import Counter

import pytest

import __spark_entry__ as entry
from conftest import DATA

CORE = [n for n in entry.oracle_sql() if not n.startswith("p") or not n[1].isdigit()]


def _plain(v):
    if v is None or v != v:
        return None
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return str(v)
    return f"{float(v):.6g}" if isinstance(v, numbers.Number) else str(v)


def compare(spark, duck, name):
    got = entry.queries()[name](spark, DATA)
    want = duck.execute(entry.oracle_sql()[name]).fetch_df()
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    a = Counter(tuple(_plain(r[c]) for c in cols) for r in got.collect())
    b = Counter(tuple(_plain(v) for v in r) for r in want[cols].astype(object).where(want[cols].notna(), None).itertuples(index=False, name=None))
    assert a == b


@pytest.mark.parametrize("name", CORE)
def test_oracle(spark, duck, name):
    compare(spark, duck, name)


@pytest.mark.parametrize("name", ["bootstrap_ci", "venue_matches", "fuzzy_tier"])
def test_runs(spark, name):
    assert entry.queries()[name](spark, DATA).columns


def test_entry(spark):
    r = entry.entry(spark).collect()[0]
    assert r.naive_sum > r.counted_sum and abs(r.inflation - r.naive_sum / r.counted_sum) < 1e-3
