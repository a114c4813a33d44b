"""Running totals and order statistics against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from regionhour.operators import profile, reports
from regionhour.operators.running import exact_quantiles, percent_rank_by_value, running_totals, value_bin, value_counts


def samples(seed: int) -> dict[str, list[float]]:
    rng = random.Random(seed)
    return {
        "even": [rng.uniform(-50, 50) for _ in range(400)],
        "tied": [float(rng.randint(0, 3)) for _ in range(301)],
        "outlier": [rng.random() for _ in range(200)] + [1e9],
        "one": [7.5],
        "same": [2.0] * 20,
    }


@pytest.mark.parametrize("seed", range(3))
def test_quantiles_by_group(spark, seed):
    groups = samples(seed)
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in [*vs, None]], "g string, v double")
    probs = {"q1": 0.25, "median": 0.5, "q3": 0.75, "p99": 0.99, "low": 0.0, "high": 1.0}
    got = {r["g"]: r for r in exact_quantiles(value_counts(df, ["g"], "v"), ["g"], "v", probs).collect()}
    assert set(got) == set(groups)
    for g, values in groups.items():
        for name, p in probs.items():
            assert got[g][name] == pytest.approx(np.percentile(values, p * 100), abs=1e-9)


def test_quantiles_of_whole_table(spark):
    values = samples(9)["even"]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    row = exact_quantiles(value_counts(df, [], "v"), [], "v", {"median": 0.5}).collect()
    assert [r["median"] for r in row] == [pytest.approx(np.median(values))]


def test_weighted_quantiles(spark):
    df = spark.createDataFrame([(1.0, 5), (2.0, 1), (10.0, 4)], "v double, w long")
    counts = value_counts(df, [], "v", F.col("w"))
    row = exact_quantiles(counts, [], "v", {"median": 0.5, "q3": 0.75}).first()
    expanded = [1.0] * 5 + [2.0] + [10.0] * 4
    assert (row["median"], row["q3"]) == (np.percentile(expanded, 50), np.percentile(expanded, 75))


def test_describe_matches_pandas(spark):
    values = samples(4)["outlier"]
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "a double, b int")
    got = {r["column"]: r for r in profile.describe(df, ["a", "b"]).collect()}
    expected = df.toPandas().describe()
    for column in ("a", "b"):
        for stat, name in (("mean", "mean"), ("std", "std"), ("25%", "q1"), ("50%", "median"), ("75%", "q3"), ("max", "max")):
            assert got[column][name] == pytest.approx(expected[column][stat], rel=1e-9)


@pytest.mark.parametrize("seed", range(3))
def test_running_totals_match_cumsum(spark, seed):
    rng = random.Random(seed)
    rows = [(g, float(x), rng.randint(0, 9)) for g in "ab" for x in rng.sample(range(10_000), 300)]
    df = spark.createDataFrame(rows, "g string, x double, n long")
    out = running_totals(df, {"total": F.col("n")}, ["x"], value_bin(F.col("x"), F.lit(0.0), F.lit(10_000.0), 16), ["g"])
    got = {(r["g"], r["x"]): r["total"] for r in out.collect()}
    for g in "ab":
        total = 0
        for _, x, n in sorted(r for r in rows if r[0] == g):
            total += n
            assert got[g, x] == total


def test_percent_rank(spark):
    values = [3.0, 1.0, 3.0, 8.0, 8.0, 9.0]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = {r["i"]: r["pct_rank"] for r in percent_rank_by_value(df, "v").collect()}
    assert got == {i: sum(o < v for o in values) / (len(values) - 1) for i, v in enumerate(values)}
    single = percent_rank_by_value(df.where("i = 0"), "v").first()
    assert single["pct_rank"] == 0.0


@pytest.mark.parametrize("seed", range(4))
def test_block_runs_match_a_scan(spark, seed):
    rng = random.Random(seed)
    days = sorted(rng.sample(range(2500), 400))
    rows = [(d, rng.random() < 0.6) for d in days]
    df = spark.createDataFrame(rows, "d int, b boolean").select(
        F.date_add(F.lit("2019-01-01").cast("date"), F.col("d")).alias("report_date"),
        F.when(F.col("b"), "no_content").otherwise("ok").alias("status"),
        F.when(F.col("b"), "Possibly BLOCKED").otherwise("").alias("error_message"),
    )
    expected, run = [], []
    for day, blocked in [*rows, (None, False)]:
        if blocked:
            run.append(day)
        elif run:
            expected.append((run[0], len(run), len(run) // 3))
            run = []
    got = reports.block_runs(df).withColumn("d", F.date_diff("run_start", F.lit("2019-01-01").cast("date")))
    assert sorted((r["d"], r["length"], r["triggers"]) for r in got.collect()) == expected


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (float("nan"),), (None,)], "x double")
    row = profile.describe(df, ["x"]).first()
    assert (row["count"], row["mean"], row["min"], row["median"], row["max"]) == (3, 7 / 3, 1.0, 2.0, 4.0)


def test_quantiles_with_infinities_ties_and_crowds(spark):
    """Exact where values crowd in one place, repeat by the thousand, or are infinite."""

    pick = random.Random(21)
    groups = {
        "crowd": [1000 + pick.random() * 1e-6 for _ in range(1500)] + [1e300, -1e300], "ties": [0.0] * 3000 + [1.0] * 10 + [float(k) for k in range(20)],
        "infinite": [float("-inf")] * 5 + [float(k) for k in range(7)] + [float("inf")] * 9, "single": [4.5], "all infinite": [float("inf")] * 3}
    df = spark.createDataFrame([(g, x) for g, xs in groups.items() for x in xs], "g string, x double").repartition(4)
    probs = {"p01": 0.01, "q1": 0.25, "median": 0.5, "q3": 0.75, "p99": 0.99}
    got = {r["g"]: r for r in exact_quantiles(value_counts(df, ["g"], "x"), ["g"], "x", probs).collect()}
    for g, xs in groups.items():
        xs = sorted(xs)
        for name, p in probs.items():
            at = (len(xs) - 1) * p
            low, high = xs[int(at)], xs[min(int(at) + (at > int(at)), len(xs) - 1)]
            want = low if low == high else low + (high - low) * (at - int(at))
            assert got[g][name] == pytest.approx(want, rel=1e-12), (g, name)
    assert exact_quantiles(value_counts(df.limit(0), ["g"], "x"), ["g"], "x", probs).count() == 0
