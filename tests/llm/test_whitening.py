"""Whitening against a dense eigenvalue solver and exact integer arithmetic."""

from __future__ import annotations

import math

import numpy as np
import pytest

from regionhour.llm import registry, whitening

SMALL = "/root/testdata/sf0.001"
NAN, INF = float("nan"), float("inf")


def expected(vectors: list[list[float]], most: int = 16):
    """Per distinct vector length: n, S, eigenvalues, vectors and trace over the distinct integer vectors."""
    x = np.array(sorted({tuple(math.floor(64 * c) + 1_000_000 for c in v) for v in vectors}), dtype=object)
    n, sums = len(x), x.sum(axis=0)
    away = (n * x - sums).astype(float) / n
    values, turned = np.linalg.eigh(away.T @ away / n)
    return n, sums, values[::-1][:most], turned[:, ::-1][:, :most], values.sum()


def check(rows, vectors: dict[int, list[float]]) -> None:
    n, sums, values, turned, trace = expected(list(vectors.values()))
    for r in rows:
        x = [math.floor(64 * c) + 1_000_000 for c in vectors[r["vec_id"]]]
        k = r["component"] - 1
        want = float(np.dot((n * np.array(x, object) - sums).astype(float) / n, turned[:, k]) / math.sqrt(values[k]))
        assert r["n"] == n and r["deviation"] == sum((n * a - s) ** 2 for a, s in zip(x, sums))
        assert abs(abs(r["whitened"]) - abs(want)) < 1e-7 * max(1, abs(want)) and abs(r["explained"] * trace / values[k] - 1) < 1e-9
        assert 0 <= r["identity_error"] < 1e-9


def test_query_against_a_dense_solver(spark):
    vectors = {r["vec_id"]: list(r["embedding"]) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()}
    rows = registry.queries()["op13_whitening"](spark, SMALL).collect()
    assert sorted((r["vec_id"], r["component"]) for r in rows) == [(i, k) for i in sorted(vectors) for k in range(1, 17)]
    check(rows, vectors)
    assert len({r["identity_error"] for r in rows}) == 1


def test_odd_vectors(spark):
    pick = np.random.default_rng(2)
    good = {i: pick.standard_normal(3).tolist() for i in range(40)} | {100: [0.0, 0.0, 0.0], 101: [0.0, -0.0, 0.001]}
    other = {200 + i: [float(i), 2.0 * i] for i in range(5)}  # one direction only
    rows = list(good.items()) + list(other.items()) + [(0, good[0])] * 30 + [
        (300, None), (301, [1.0, None, 2.0]), (302, [NAN, 1.0, 1.0]), (303, [INF, 1.0, 1.0]), (304, []), (305, [7.0]), (306, [7.0])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id bigint, embedding array<double>, n int, x string").repartition(3)
    got = whitening.whiten(df).collect()
    assert {r["vec_id"] for r in got} == set(good) | set(other)
    assert sorted(r["component"] for r in got if r["vec_id"] == 0) == sorted([1, 2, 3] * 31)
    check([r for r in got if r["vec_id"] in good], good)
    line = [r for r in got if r["vec_id"] in other]
    assert [r["component"] for r in line] == [1] * 5 and all(r["explained"] == pytest.approx(1) for r in line)
    assert whitening.whiten(df.limit(0)).count() == 0 and whitening.whiten(df.filter("vec_id in (305, 306)")).count() == 0
    null = spark.createDataFrame([(None, [1.0, 2.0]), (1, [2.0, 1.0]), (2, [1e300, 0.0])], "vec_id bigint, embedding array<double>")
    huge = whitening.whiten(null).collect()
    assert {r["vec_id"] for r in huge} == {None, 1, 2} and all(r["deviation"] is None and np.isfinite(r["whitened"]) for r in huge)


@pytest.mark.parametrize("name", ["plain", "falling", "flat", "copies", "low rank", "spike", "tiny", "single"])
def test_components_against_a_dense_solver(name):
    pick = np.random.default_rng(7)
    rows = pick.standard_normal((500, 48))
    matrix = {"plain": np.cov(rows.T), "falling": np.cov((rows * np.geomspace(1, 1e-3, 48)).T), "flat": np.eye(30), "copies": np.diag([5.0] * 3 + [2.0] * 20 + [1.0] * 9),
              "low rank": np.cov(rows[:9].T), "spike": np.cov((rows * np.r_[1e4, np.ones(47)]).T), "tiny": np.cov(rows[:, :5].T) * 1e-12,
              "single": np.array([[3.0]])}[name]
    values, vectors = whitening.components(matrix)
    dense = np.linalg.eigvalsh(matrix)[::-1]
    wanted = min(16, int((dense > 1e-12 * dense[0]).sum()))
    assert len(values) == wanted and np.allclose(values, dense[:wanted], rtol=1e-9, atol=1e-14 * dense[0])
    assert np.abs(vectors.T @ vectors - np.eye(wanted)).max() < 1e-12 and np.abs(matrix @ vectors - vectors * values).max() < 1e-12 * dense[0]
    form = whitening.tridiagonal(matrix)
    for low, high, inside in whitening.intervals(form, wanted):
        assert inside == ((dense > low) & (dense < high)).sum()


def test_counts_above_any_shift():
    pick = np.random.default_rng(3)
    a = pick.standard_normal((12, 12))
    matrix = a + a.T
    form = whitening.tridiagonal(matrix)
    dense = np.linalg.eigvalsh(matrix)
    for shift in pick.uniform(dense[0] - 1, dense[-1] + 1, 200):
        assert whitening.count_above(form, shift) == (dense > shift).sum()
