"""Registered queries of the region-hour grid on tables of a few rows."""

from __future__ import annotations

import datetime as dt

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from regionhour.operators import grid
from regionhour.plans import registry
from tests.compare import connect, differences

HOURS_A = 150  # longer than any sound alarm, and earlier than the others


@pytest.fixture
def tables(folder) -> str:
    """An alarm of 150 hours in region 1, one of half an hour in region 2, one that ends before its start, one without a start, one of no region."""
    at = dt.datetime
    events = {
        "event_id": [1, 2, 3, 4, 5], "ts": [at(2024, 1, 15), at(2024, 1, 20, 5), at(2024, 1, 20, 6), None, at(2023, 12, 1)],
        "user_id": [0, 1, 1, 0, None], "event_type": ["error", "view", "click", "view", "view"],
        "value": [(HOURS_A * 3600 + 600) / 1200, 40.0, 2.0, 40.0, 40.0], "props": [None] * 5,
    }
    lines = {
        "l_orderkey": [14, 19], "l_partkey": [7, 8], "l_suppkey": [0, 1], "l_linenumber": [1, 3], "l_quantity": [30.0, 35.0], "l_extendedprice": [1.0, 1.0],
        "l_discount": [0.05, 0.05], "l_tax": [0.01, 0.01], "l_returnflag": ["R", "N"], "l_linestatus": ["O", "O"], "l_shipdate": [at(2024, 1, 1)] * 2,
    }
    pages = {"page_id": [13, 18], "url": ["http://a.org/1", "http://a.org/2"], "html": ["<html><body><article>war and peace</article></body></html>"] * 2}
    nation = {"n_nationkey": [0, 1], "n_name": ["ONE", "TWO"], "n_regionkey": [0, 0]}
    for name, columns in (("events", events), ("lineitem", lines), ("pages", pages), ("nation", nation)):
        table = pa.table({c: pa.array(x, pa.int32()) if c == "l_linenumber" else pa.array(x, pa.string()) if c == "props" else pa.array(x) for c, x in columns.items()})
        pq.write_table(table, f"{folder}/{name}.parquet")
    return folder


def found(spark, folder, name):
    return [r.asDict() for r in registry.queries()[name](spark, folder).collect()]


def test_every_alarm_is_on_the_grid(spark, tables):
    """Also one that lasts longer than a sound one, which sets where the grid begins and ends."""
    for name in ("region_hour_flags", "horizon_labels", "lagged_features", "feature_table"):
        rows = found(spark, tables, name)
        assert len(rows) == 2 * HOURS_A and min(r["hour_ts"] for r in rows) == "2024-01-15 00:00:00", name
        assert sum(r["is_alarm"] for r in rows) == HOURS_A + 1, name
    assert found(spark, tables, "chronological_split") == [
        {"part": "train", "n": 2 * HOURS_A, "alarms": HOURS_A + 1, "first_hour": "2024-01-15 00:00:00", "last_hour": "2024-01-21 05:00:00"}]


def test_forecast_counts_every_alarm(spark, tables):
    chance = {(r["region_id"], r["hour"]): r["probability_1h"] for r in found(spark, tables, "base_rate_forecast")}
    assert chance[1, 0] == 1.0 and chance[1, 10] == round(6 / 7, 6) and chance[2, 4] == round(1 / 7, 6) and chance[2, 10] == 0.0
    shown = {(r["region_id"], r["hour"]): (r["probability"], r["error"]) for r in found(spark, tables, "timeline")}
    assert shown[1, "10:00"][0] == round(6 / 7, 6) == shown[1, "10:00"][1]


@pytest.mark.parametrize("name", ["region_hour_flags", "horizon_labels", "feature_table", "base_rate_forecast", "prediction"])
def test_odd_alarms_agree_with_sql(spark, tables, name):
    assert differences(registry.queries()[name](spark, tables), connect(tables), registry.oracle_sql()[name]) is None


def test_hours_of_many_days(spark):
    """A range that begins and ends within a day, off the full hour too, and an alarm over whole days."""
    at = dt.datetime
    regions = spark.createDataFrame([(1,), (2,)], "region_id int")
    for first, last in ((at(2024, 1, 1, 5), at(2024, 1, 4, 5)), (at(2024, 1, 1, 5, 30), at(2024, 1, 3, 4, 30)), (at(2024, 1, 1), at(2024, 1, 1, 1)), (at(2024, 1, 2), at(2024, 1, 1))):
        want = [first + dt.timedelta(hours=i) for i in range(max(0, int((last - first).total_seconds() // 3600)))]
        got = sorted((r["region_id"], r["hour_ts"]) for r in grid.region_hours(regions, str(first), str(last)).collect())
        assert got == [(region, hour) for region in (1, 2) for hour in want]
    alarm = spark.createDataFrame([(1, at(2024, 1, 1, 22, 10), at(2024, 1, 5, 1, 20))], "region_id int, start timestamp, end timestamp")
    got = sorted(r["hour_ts"] for r in grid.active_hours(alarm, "2024-01-01", "2024-02-01").collect())
    assert got == [at(2024, 1, 1, 22) + dt.timedelta(hours=i) for i in range(76)]
