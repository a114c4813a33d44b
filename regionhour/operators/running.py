"""Running totals and exact order statistics without a single-task sort.

A global window would push a whole group through one task. Here the order is cut
into chunks that follow the order column. Rows are summed inside their chunk,
the chunk totals (few rows) are summed once more, and both parts are added.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BINS = 4096
EDGES = 255  # one less than a power of two
SKETCH = 2000


def one_row(facts: DataFrame) -> Column:
    """The only row of an aggregate, as a struct from one scalar subquery."""
    return facts.select(F.struct(*facts.columns)).scalar()


def with_facts(df: DataFrame, facts: DataFrame, by: list[str]) -> DataFrame:
    """Add the facts of each row's group; those of the whole table come from its one-row scalar subquery.

    ``by`` names labels fixed by the query (columns of a profile, states of a
    box), so ``facts`` has a handful of rows and is broadcast.
    """
    if by:
        return df.join(F.broadcast(facts), by)
    row = one_row(facts)
    return df.withColumns({name: row[name] for name in facts.columns})


def running_totals(
    df: DataFrame, amounts: dict[str, Column], order: list[str], chunk: Column, by: list[str]
) -> DataFrame:
    """Add one inclusive running total per entry of ``amounts``, in ``order`` within ``by``.

    ``chunk`` must grow with ``order`` and take few values (bins, years): its
    totals are broadcast. ``order`` must be unique within ``by``.
    """
    keys = [*by, "_chunk"]
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*by).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)

    cut = df.withColumn("_chunk", chunk)
    offsets = (
        cut.groupBy(*keys)
        .agg(*[F.sum(amount).alias(f"_sum_{name}") for name, amount in amounts.items()])
        .select(*keys, *[
            F.coalesce(F.sum(f"_sum_{name}").over(before), F.lit(0)).alias(f"_off_{name}") for name in amounts
        ])
    )
    inner = cut.withColumns({f"_in_{name}": F.sum(amount).over(inside) for name, amount in amounts.items()})
    return inner.join(F.broadcast(offsets), keys).select(
        *df.columns, *[(F.col(f"_in_{name}") + F.col(f"_off_{name}")).alias(name) for name in amounts]
    )


def value_counts(df: DataFrame, by: list[str], value: str, weight: Column | None = None) -> DataFrame:
    """Distinct values of each group with their number of rows, as ``n``; nulls and NaN are missing and left out."""
    counted = F.count(F.lit(1)) if weight is None else F.sum(weight)
    present = F.col(value).isNotNull()
    if df.schema[value].dataType.typeName() in ("double", "float"):
        present = present & ~F.isnan(value)
    return df.where(present).groupBy(*by, value).agg(counted.alias("n"))


def value_bin(value: Column, low: Column, high: Column, bins: int = BINS) -> Column:
    """Number of the equal-width bin of ``value``, growing with it."""
    share = (value - low) / F.nullif(high - low, F.lit(0.0))
    return F.coalesce(F.least(F.floor(share * bins), F.lit(bins - 1)), F.lit(0)).cast("long")


def group_moments(counts: DataFrame, by: list[str], value: str) -> DataFrame:
    v, n = F.col(value), F.col("n")
    return counts.groupBy(*by).agg(
        F.sum(n).alias("total"),
        F.min(v).alias("low"),
        F.max(v).alias("high"),
        (F.sum(v * n) / F.sum(n)).alias("mean"),
    )


def _rank(p: float) -> Column:
    """Position of a quantile among the sorted rows of its group, counted from 0."""
    return (F.col("total") - 1) * F.lit(p)


def _edge_bin(df: DataFrame, value: str, edges: str, name: str) -> DataFrame:
    """Add the number of ``edges`` (sorted, ``EDGES`` of them) that are not above the value, by binary search."""
    df = df.withColumn(name, F.lit(0))
    step = (EDGES + 1) // 2
    while step:
        df = df.withColumn(name, F.col(name) + F.when(F.get(edges, F.col(name) + (step - 1)) <= F.col(value), step).otherwise(0))
        step //= 2
    return df


def exact_quantiles(counts: DataFrame, by: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Linearly interpolated quantiles per group from ``value_counts``, named as in ``probs``.

    A mergeable sketch of the distinct values places the edges of ``EDGES + 1`` bins, so outliers and infinities don't stretch
    them and a bin holds a small part of the distinct values wherever they crowd. The bins' exact row counts tell which of
    them hold a wanted rank, at most two per quantile; only those are sorted, each in its own task.
    """
    marks = [(k + 1) / (EDGES + 1) for k in range(EDGES)]
    sketch = counts.groupBy(*by).agg(F.percentile_approx(value, marks, SKETCH).alias("_edges"), F.sum("n").alias("total"))
    binned = _edge_bin(with_facts(counts, sketch, by), value, "_edges", "_bin").drop("_edges")
    to_here = Window.partitionBy(*by).orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    bins = (
        binned.groupBy(*by, "_bin")
        .agg(F.sum("n").alias("_rows"), F.max("total").alias("total"))
        .withColumn("_upto", F.sum("_rows").over(to_here))
        .withColumn("start", F.col("_upto") - F.col("_rows"))
    )
    holds_rank = [(F.col("start") <= F.ceil(_rank(p))) & (F.col("_upto") > F.floor(_rank(p))) for p in probs.values()]
    kept = bins.where(reduce(lambda x, y: x | y, holds_rank)).select(*by, "_bin", "start")
    in_bin = Window.partitionBy(*by, "_bin").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranked = binned.join(F.broadcast(kept), [*by, "_bin"]).withColumn("_end", F.col("start") + F.sum("n").over(in_bin)).withColumn(
        "_start", F.col("_end") - F.col("n"))

    def at(position: Column) -> Column:
        return F.max(F.when((F.col("_start") <= position) & (position < F.col("_end")), F.col(value)))

    picked = ranked.groupBy(*by).agg(
        F.max("total").alias("total"),
        *[at(F.floor(_rank(p))).alias(f"_lo_{name}") for name, p in probs.items()],
        *[at(F.ceil(_rank(p))).alias(f"_hi_{name}") for name, p in probs.items()],
    )
    low, high = (lambda name: F.col(f"_lo_{name}")), (lambda name: F.col(f"_hi_{name}"))
    return picked.select(*by, *[
        # Between two equal infinities nothing is added.
        F.when(low(name) == high(name), low(name)).otherwise(low(name) + (high(name) - low(name)) * (_rank(p) - F.floor(_rank(p)))).alias(name)
        for name, p in probs.items()
    ])


def sample_std(counts: DataFrame, moments: DataFrame, by: list[str], value: str) -> DataFrame:
    """Standard deviation with n-1, from counted values and their mean."""
    off = F.col(value) - F.col("mean")
    return (
        with_facts(counts, moments, by)
        .groupBy(*by)
        .agg(F.sum(F.col("n") * off * off).alias("_ss"), F.sum("n").alias("_n"))
        .select(*by, F.sqrt(F.col("_ss") / F.nullif(F.col("_n") - 1, F.lit(0))).alias("std"))
    )


def percent_rank_by_value(df: DataFrame, value: str) -> DataFrame:
    """Add ``pct_rank``: rows with a smaller value over all other rows; 0 for a single row."""
    counts = value_counts(df, [], value)
    spread = with_facts(counts, group_moments(counts, [], value), [])
    ranked = running_totals(
        spread, {"_upto": F.col("n")}, [value], value_bin(F.col(value), F.col("low"), F.col("high")), []
    ).select(
        value,
        F.coalesce((F.col("_upto") - F.col("n")) / F.nullif(F.col("total") - 1, F.lit(0)), F.lit(0.0)).alias("pct_rank"),
    )
    return df.join(ranked, value)
