"""Whitening of embeddings by the leading components of their covariance, found by FEAST contour integration.

Spark makes the fit list (distinct integer vectors), its sums and its centred second moments: every task adds up its own
rows, the parts meet per row of the matrix, and one ``d x d`` matrix for a vector length d reaches the driver, whatever the number of rows. There the matrix is
brought to tridiagonal form once, whose shifted pivots count the eigenvalues above any shift (Sylvester's inertia). The
counts cut the wanted end of the spectrum into intervals with room around their ends. For each, the resolvent is integrated along
a circle through both ends: a sum of complex shifted solves that projects random vectors onto the interval's eigenvectors.
Rayleigh-Ritz on the projected vectors gives the pairs, the integral is repeated from them until they stand still, and their
number must equal the inertia count. The rows are then projected in tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regionhour.llm.common import step, table

COMPONENTS = 16
SCALE, SHIFT = 64, 1_000_000
LARGEST = 1 << 50  # scaled entries beyond this are set to it
NODES = 16  # points of the upper half circle
RANK = 1e-12  # part of the greatest eigenvalue under which an eigenvalue counts as zero
OUT = "component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and squared off-diagonal of a tridiagonal matrix of the same spectrum (Householder reflections)."""
    a = np.array(matrix, float)
    n = len(a)
    for k in range(n - 2):
        v = a[k + 1:, k].copy()
        length = math.sqrt(float(v @ v))
        if length == 0:
            continue
        v[0] += math.copysign(length, v[0])
        v /= math.sqrt(float(v @ v))
        sub = a[k + 1:, k + 1:]
        p = sub @ v
        w = 2 * (p - (v @ p) * v)
        sub -= np.outer(v, w) + np.outer(w, v)
        a[k + 1:, k] = a[k, k + 1:] = 0
        a[k + 1, k] = a[k, k + 1] = -math.copysign(length, v[0])
    return np.diag(a).copy(), np.diag(a, 1) ** 2


def count_above(form: tuple[np.ndarray, np.ndarray], shift: float) -> int:
    """Eigenvalues greater than ``shift``: positive pivots of the shifted tridiagonal form."""
    diagonal, off = form
    tiny = np.finfo(float).tiny
    above, pivot = 0, 1.0
    for k in range(len(diagonal)):
        pivot = diagonal[k] - shift - (off[k - 1] / pivot if k else 0.0)
        pivot = -tiny if abs(pivot) < tiny else pivot
        above += pivot > 0
    return above


def eigenvalue(form: tuple[np.ndarray, np.ndarray], k: int, low: float, high: float, within: float) -> float:
    """The k-th greatest eigenvalue (from 1) by bisection on the counts."""
    while high - low > within:
        middle = (low + high) / 2
        if middle in (low, high):
            break
        low, high = (middle, high) if count_above(form, middle) >= k else (low, middle)
    return (low + high) / 2


def intervals(form: tuple[np.ndarray, np.ndarray], wanted: int) -> list[tuple[float, float, int]]:
    """Intervals (low, high, eigenvalues inside), greatest first, that hold at least the ``wanted`` greatest eigenvalues.

    Ends lie in the middle between neighbours. An interval ends at the next gap once it spans a factor of four, so that its circle is not
    far wider than the distances at its ends; equal eigenvalues are never parted.
    """
    diagonal, off = form
    n = len(diagonal)
    reach = np.sqrt(off)
    around = np.concatenate([[0], reach]) + np.concatenate([reach, [0]])
    low, high = float((diagonal - around).min()), float((diagonal + around).max())
    pad = max(high - low, abs(high), np.finfo(float).tiny) * 1e-3
    low, high = low - pad, high + pad
    first = eigenvalue(form, 1, low, high, 1e-9 * (high - low))
    found, end, begun, top = [], high, 0, first
    k, here = 1, first
    while k <= n and begun < wanted:
        after = eigenvalue(form, k + 1, low, here + pad, 1e-9 * abs(first)) if k < n else low - 2 * pad
        apart = here - after > 1e-6 * abs(first)
        if apart and (k >= wanted or top > 4 * max(after, 0)) or k == n:
            cut = (here + after) / 2
            found.append((cut, end, k - begun))
            end, begun, top = cut, k, after
        k, here = k + 1, after
    return found


def feast(matrix: np.ndarray, low: float, high: float, inside: int, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues in (low, high) and their vectors (columns), by contour integration and Rayleigh-Ritz."""
    n = len(matrix)
    width = min(n, inside + max(3, inside // 2))
    y = np.random.default_rng([seed, n]).standard_normal((n, width))
    points, weights = np.polynomial.legendre.leggauss(NODES)
    middle, radius = (low + high) / 2, (high - low) / 2
    scale = max(abs(low), abs(high), float(np.abs(matrix).max()))
    turn = np.exp(1j * np.pi / 2 * (1 - points))
    best = math.inf
    for _ in range(60):
        q = np.zeros((n, y.shape[1]))
        for weight, at in zip(weights, turn):
            q += weight / 2 * np.real(radius * at * np.linalg.solve((middle + radius * at) * np.eye(n) - matrix, y))
        basis, size, _ = np.linalg.svd(q, full_matrices=False)
        basis = basis[:, size > size[0] * 1e-14] if size[0] > 0 else basis
        values, turned = np.linalg.eigh(basis.T @ matrix @ basis)
        vectors = basis @ turned
        own = (values > low) & (values < high)
        residual = np.abs(matrix @ vectors[:, own] - vectors[:, own] * values[own]).max(initial=0.0) / scale
        if own.sum() == inside and (residual <= 1e-14 or residual <= 1e-12 and residual >= best / 2):
            return values[own], vectors[:, own]
        best, y = min(best, residual) if own.sum() == inside else best, vectors
    raise ArithmeticError(f"{own.sum()} of {inside} eigenvalues between {low} and {high}, residual {residual}")


def components(covariance: np.ndarray, most: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """The greatest eigenvalues, at most ``most`` and none that counts as zero, and their vectors (columns), the largest entry positive."""
    if not np.any(covariance):
        return np.zeros(0), np.zeros((len(covariance), 0))
    form = tridiagonal(covariance)
    pairs = [feast(covariance, low, high, inside) for low, high, inside in intervals(form, min(most, len(covariance)))]
    # One Rayleigh-Ritz over all intervals makes vectors of neighbouring ones orthogonal to rounding.
    basis, _ = np.linalg.qr(np.concatenate([vectors for _, vectors in pairs], axis=1))
    values, turned = np.linalg.eigh(basis.T @ covariance @ basis)
    order = np.argsort(-values)[:most]
    order = order[values[order] > RANK * values[order[0]]]
    vectors = (basis @ turned)[:, order]
    return values[order], vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), range(len(order))])


@dataclass
class Whitening:
    """Fit of one vector length: rows, exact sums, total variance, eigenvalues, projection (columns), identity error."""

    n: int
    sums: np.ndarray
    trace: float
    values: np.ndarray
    projection: np.ndarray
    identity_error: float = 0.0

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Exact sums of (n x - S)^2; null where a long can't hold them."""
        small = self.n * int(np.abs(x).max(initial=0)) < 1 << 61 and int(np.abs(self.sums).max(initial=0)) < 1 << 61
        away = self.n * x - self.sums if small else self.n * x.astype(object) - self.sums.astype(object)
        if small and int(np.abs(away).max(initial=0)) ** 2 * max(1, x.shape[1]) < 1 << 63:
            return (away * away).sum(axis=1).tolist()
        return [v if v < 1 << 63 else None for v in (sum(int(c) ** 2 for c in row) for row in away)]

    def centred(self, x: np.ndarray) -> np.ndarray:
        small = self.n * int(np.abs(x).max(initial=0)) < 1 << 61
        away = self.n * x - self.sums if small else self.n * x.astype(object) - self.sums.astype(object)
        return away.astype(float) / self.n

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.projection


def scaled(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id, x, dim`` of the rows whose vector is there, not empty and finite throughout; x = floor(64 c) + 1000000."""
    v = F.col(vector_col).cast("array<double>")
    sound = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    bound = float(LARGEST)
    x = F.transform(v, lambda c: F.greatest(F.lit(-bound), F.least(F.lit(bound), c * SCALE)))
    return vectors.filter(sound).select(F.col(id_col).cast("bigint").alias("vec_id"), F.transform(x, lambda c: F.floor(c) + SHIFT).alias("x")).withColumn("dim", F.size("x"))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
    """The rows of each batch by vector length, as integer matrices."""
    for batch in batches:
        lengths = batch.column("dim").to_numpy(zero_copy_only=False)
        for dim in np.unique(lengths):
            part = batch.filter(pa.array(lengths == dim)) if (lengths != dim).any() else batch
            yield int(dim), part, part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, int(dim))


def _added(rows: DataFrame, each, width: str) -> dict[int, list[np.ndarray]]:
    """Sums over all rows of the matrices that ``each(dim, x)`` gives, row by row: tasks add up their own, then equal places meet."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for dim, _, x in _blocks(batches):
            found = each(dim, x)
            sums[dim] = sums[dim] + found if dim in sums else found
        for dim, found in sums.items():
            for place, line in enumerate(found):
                yield pa.RecordBatch.from_pylist([{"dim": dim, "place": place, "line": line.tolist()}], schema=schema)

    schema = pa.schema([("dim", pa.int32()), ("place", pa.int32()), ("line", pa.list_(pa.int64() if width == "bigint" else pa.float64()))])
    parts = rows.mapInArrow(run, f"dim int, place int, line array<{width}>").select("dim", "place", F.posexplode("line").alias("at", "v"))
    lines = parts.groupBy("dim", "place", "at").agg(F.sum("v").alias("v")).groupBy("dim", "place").agg(
        F.array_sort(F.collect_list(F.struct("at", "v"))).alias("line")).select("dim", "place", F.col("line.v").alias("line"))
    out: dict[int, dict[int, np.ndarray]] = {}
    # One row for each row of a matrix: as many as the lengths add up to.
    for row in lines.toLocalIterator():
        out.setdefault(row["dim"], {})[row["place"]] = np.array(row["line"])
    return {dim: [found[place] for place in range(len(found))] for dim, found in out.items()}


def fit(rows: DataFrame, most: int = COMPONENTS) -> dict[int, Whitening]:
    """One whitening for each vector length among ``rows`` (of ``scaled``), fitted on distinct vectors."""
    spark = rows.sparkSession
    distinct = step(rows.select("x", "dim").groupBy("x", "dim").agg(F.lit(1).alias("one")).select("x", "dim"), "fit-list")
    counted = _added(distinct, lambda dim, x: np.stack([np.full(dim, len(x)), x.sum(axis=0)]), "bigint")
    plain = {dim: Whitening(int(n[0]), sums, 0.0, np.zeros(0), np.zeros((dim, 0))) for dim, (n, sums) in counted.items()}
    shared = spark.sparkContext.broadcast(plain)

    def moments(dim: int, x: np.ndarray) -> np.ndarray:
        away = shared.value[dim].centred(x)
        return away.T @ away

    found = {dim: np.stack(lines) / plain[dim].n for dim, lines in _added(distinct, moments, "double").items()}
    shared.destroy()
    for dim, covariance in found.items():
        values, vectors = components((covariance + covariance.T) / 2, most)
        own = plain[dim]
        own.trace, own.values, own.projection = float(np.trace(covariance)), values, vectors / np.sqrt(values)
    ready = spark.sparkContext.broadcast(plain)

    def squares(dim: int, x: np.ndarray) -> np.ndarray:
        """Products of the whitened columns and of a column of ones, whose products are the columns' sums."""
        z = np.concatenate([ready.value[dim].whitened(x), np.ones((len(x), 1))], axis=1)
        return z.T @ z

    for dim, lines in _added(distinct, squares, "double").items():
        whole, own = np.stack(lines) / plain[dim].n, plain[dim]
        covariance = whole[:-1, :-1] - np.outer(whole[-1, :-1], whole[-1, :-1])
        own.identity_error = float(np.abs(covariance - np.eye(len(own.values))).max(initial=0.0))
    ready.destroy()
    return plain


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """A row per vector and component: id, ``component`` from 1, ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error``.

    Null vectors and those with null or non-finite entries are dropped; repeated rows and null ids stay. Each vector length has a fit of its own. A
    component without variance gives no rows, so neither do equal vectors only, an empty vector or an empty table. Further columns are not read.
    """
    rows = step(scaled(vectors, id_col, vector_col), "scaled")
    fits = rows.sparkSession.sparkContext.broadcast(fit(rows, most))
    schema = pa.schema([(id_col, pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()),
                        ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, part, x in _blocks(batches):
            own = fits.value.get(dim)
            k = 0 if own is None else len(own.values)
            if k and len(x):
                size = len(x) * k
                yield pa.RecordBatch.from_arrays([
                    part.column("vec_id").take(pa.array(np.repeat(np.arange(len(x)), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(size, own.n)), pa.array(own.deviations(x), pa.int64()).take(pa.array(np.repeat(np.arange(len(x)), k))),
                    pa.array(own.whitened(x).ravel()), pa.array(np.tile(own.values / own.trace, len(x))), pa.array(np.full(size, own.identity_error))], schema=schema)

    return rows.mapInArrow(run, f"{id_col} bigint, {OUT}")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))
