"""Profiles of any table: describe, missing values, duplicates, boxes, correlation."""

from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regionhour.operators.running import exact_quantiles, group_moments, sample_std, value_counts, with_facts

QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}


def unpivot_numbers(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(
        F.explode(F.array(*[
            F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns
        ])).alias("cell")
    ).select("cell.*")


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """count, mean, std, min, quartiles and max, one row per column.

    The table is read once and reduced to counted values; everything else is
    computed from those.
    """
    counts = value_counts(unpivot_numbers(df, columns), ["column"], "value")
    moments = group_moments(counts, ["column"], "value")
    spread = with_facts(moments, sample_std(counts, moments, ["column"], "value"), ["column"])
    return (
        with_facts(spread, exact_quantiles(counts, ["column"], "value", QUARTILES), ["column"])
        .select(
            "column", F.col("total").alias("count"), "mean", "std", F.col("low").alias("min"),
            "q1", "median", "q3", F.col("high").alias("max"),
        )
    )


def _one_row_per_column(df: DataFrame, columns: list[str], aggregate) -> DataFrame:
    totals = df.agg(F.count(F.lit(1)).alias("rows"), *[aggregate(c).alias(f"a{i}") for i, c in enumerate(columns)])
    cells = F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"a{i}").alias("value")) for i, c in enumerate(columns)
    ])
    return totals.select("rows", F.explode(cells).alias("cell")).select("rows", "cell.*")


def missing_profile(df: DataFrame) -> DataFrame:
    """Nulls per column and their percentage with two decimals, in one pass."""
    per_column = _one_row_per_column(df, df.columns, lambda c: F.count_if(F.col(c).isNull()))
    return per_column.select(
        "column",
        F.col("value").alias("missing"),
        F.round(F.col("value") * 100.0 / F.nullif(F.col("rows"), F.lit(0)), 2).alias("missing_pct"),
    )


def column_profile(df: DataFrame) -> DataFrame:
    """Name, type and filled values of every column, with the size of the table."""
    types = F.create_map(*[F.lit(x) for f in df.schema.fields for x in (f.name, f.dataType.simpleString())])
    per_column = _one_row_per_column(df, df.columns, lambda c: F.count(c))
    return per_column.select(
        "column",
        F.element_at(types, F.col("column")).alias("type"),
        F.col("value").alias("non_null"),
        "rows",
        F.lit(len(df.columns)).alias("columns"),
    )


def duplicate_count(df: DataFrame) -> DataFrame:
    """Copies beyond the first of every full row; nulls are equal."""
    copies = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_copies"))
    return copies.agg(F.coalesce(F.sum(F.col("_copies") - 1), F.lit(0)).alias("duplicates"))


def drop_duplicates(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def drop_incomplete_keys(df: DataFrame, keys: list[str], integer_keys: list[str]) -> DataFrame:
    return df.dropna(subset=keys).withColumns({k: F.col(k).cast("int") for k in integer_keys})


def box_summary(counts: DataFrame, by: list[str], value: str) -> DataFrame:
    """Quartiles, whisker ends within 1.5 quartile ranges, and outliers beyond them."""
    quartiles = exact_quantiles(counts, by, value, QUARTILES)
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    v = F.col(value)
    inside = (v >= F.col("q1") - reach) & (v <= F.col("q3") + reach)
    return (
        with_facts(counts, quartiles, by)
        .groupBy(*by)
        .agg(
            *[F.max(q).alias(q) for q in QUARTILES],
            F.min(F.when(inside, v)).alias("whisker_low"),
            F.max(F.when(inside, v)).alias("whisker_high"),
            F.sum("n").alias("n"),
            F.sum(F.when(inside, 0).otherwise(F.col("n"))).alias("outliers"),
            F.min(v).alias("min"),
            F.max(v).alias("max"),
        )
    )


def union_labeled(a: DataFrame, b: DataFrame, labels: tuple[str, str], label: str = "state") -> DataFrame:
    return a.withColumn(label, F.lit(labels[0])).unionByName(b.withColumn(label, F.lit(labels[1])))


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlation of every pair in long form; a row counts for a pair when both sides are filled. NaN is missing.

    A pair without such rows is null; one with a side that never changes has no correlation: NaN. Spark's ``corr`` divides by zero there.
    """
    pairs = list(combinations_with_replacement(columns, 2))
    numbers = df.select(*[F.nanvl(F.col(c).cast("double"), F.lit(None)).alias(c) for c in columns])

    def spread(a: str, b: str) -> Column:
        return F.stddev_pop(F.when(F.col(b).isNotNull(), F.col(a)))

    row = numbers.agg(*[
        F.struct(F.covar_pop(a, b).alias("both"), (spread(a, b) * spread(b, a)).alias("apart")).alias(f"p{i}") for i, (a, b) in enumerate(pairs)
    ]).select(*[
        F.when(F.col(f"p{i}.apart") == 0, float("nan")).otherwise(F.col(f"p{i}.both") / F.col(f"p{i}.apart")).alias(f"r{i}")
        for i in range(len(pairs))
    ])
    cells = [
        F.struct(F.lit(x).alias("column_a"), F.lit(y).alias("column_b"), F.col(f"r{i}").alias("corr"))
        for i, (a, b) in enumerate(pairs)
        for x, y in sorted({(a, b), (b, a)})
    ]
    return row.select(F.explode(F.array(*cells)).alias("cell")).select("cell.*")


def head(df: DataFrame, order: list, n: int = 5) -> DataFrame:
    return df.orderBy(*order).limit(n)
