from __future__ import annotations

from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kelindan.operators.timestamps import normalise_timestamps

CASES = [
    ("2025-06-21 ", None, "2025-06-21"),
    ("Minggu, 09/03/2025", None, "2025-03-09"),
    ("Fri, 13 Mar 2026 14:08:44 +0700", None, "2026-03-13T07:08:44Z"),
    ("1781873240", None, "2026-06-19T12:47:20Z"),
    ("1744076401373", None, "2025-04-08T01:40:01Z"),
    ("20250505070742", "Asia/Jayapura", "2025-05-05T07:07:42Z"),
    ("20250112", None, "2025-01-12"),
    ("(20/6/2025)", None, "2025-06-20"),
    ("bulan Nopember 2025", None, "2025-11"),
    ("2026-10", None, "2026-10"),
    ("May 19, 2025 1:48 PM WIB", None, "2025-05-19T06:48:00Z"),
    ("2025-01-22 12:12 AM", "Etc/UTC", "2025-01-22T00:12:00Z"),
    ("2025-01-22 12:01+07", None, "2025-01-22T05:01:00Z"),
    ("2026-08-27T15:26:51.5Z", None, "2026-08-27T15:26:51Z"),
    ("12 April 2025, 14.49 WITA", None, "2025-04-12T06:49:00Z"),
    ("21 September 2026 {{!}} 07:05 WIB", None, "2026-09-21T00:05:00Z"),
    ("2026-03-08T02:30:00", "America/New_York", "2026-03-08T07:30:00Z"),  # skipped: the offset before
    ("2025-11-02 01:30", "America/New_York", "2025-11-02T05:30:00Z"),  # twice: the earlier
    ("2025-11-02 01:30", "No/Where", "2025-11-01T18:30:00Z"),
    ("29 Februari 2024", None, "2024-02-29"),
    ("2024-02-29 ", None, "2024-02-29"),
]
NONE = ["", " ", None, "n.d.", "TBA", "31 Februari 2025", "29/02/2025", "00/00/2025", "2025-13-04", "32 Mei 2026", "2025-01-22 25:01", "2025-01-22 10:60", "13 Foo 2025", "2025", "2025-01-22 10:00+15:00", "2025-01-22 13:00 PM", "x" * 100_000]


def run(spark, pairs):
    df = spark.createDataFrame([(i, v, z, "kept") for i, (v, z) in enumerate(pairs)], "i int, v string, z string, __one string")
    return [r.norm for r in normalise_timestamps(df, "v", "z").orderBy("i").collect()]


def test_cases(spark):
    assert run(spark, [(v, z) for v, z, _ in CASES]) == [n for *_, n in CASES]


def test_no_date(spark):
    assert run(spark, [(v, None) for v in NONE]) == [None] * len(NONE)


def test_empty_and_clashing_columns(spark):
    df = spark.createDataFrame([], "v string, z string, norm int")
    assert normalise_timestamps(df, "v", "z").columns == ["v", "z", "norm"]


@pytest.mark.parametrize("zone", ["Asia/Jakarta", "Europe/Amsterdam", "Australia/Sydney", "America/New_York"])
def test_wall_clocks(spark, zone):
    walls = [datetime(2025, 1, 1) + timedelta(hours=7 * k, minutes=13 * k % 60) for k in range(1500)]
    got = run(spark, [(w.strftime("%d/%m/%Y %H:%M"), zone) for w in walls])
    want = [w.replace(tzinfo=ZoneInfo(zone), fold=0).astimezone(timezone.utc).strftime("%Y-%m-%dT%H:%M:00Z") for w in walls]
    assert got == want


@settings(max_examples=5, deadline=None)
@given(st.lists(st.integers(0, 4102444800), min_size=200, max_size=200))
def test_epochs_and_offsets(spark, seconds):
    at = [datetime.fromtimestamp(s, timezone(timedelta(minutes=(s % 57 - 28) * 30))) for s in seconds]
    got = run(spark, [(a.isoformat(), None) for a in at])
    assert got == [a.astimezone(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ") for a in at]


def test_query(spark):
    from conftest import DATA

    from kelindan.plans.timestamps import p2_found

    df = p2_found(spark, DATA)
    assert df.columns == ["col", "rec_id", "norm"] and df.count() == df.distinct().count() > 0
