"""All registered queries, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from regionhour.plans import alarm_queries, grid_queries, link_queries, report_queries, storage_queries, stream_queries, weather_queries
from regionhour.plans.lenses import Lenses

_ALL: dict[str, tuple] = {}
for _module in (alarm_queries, weather_queries, report_queries, link_queries, grid_queries, stream_queries, storage_queries):
    _ALL |= _module.QUERIES


def _bind(build: Callable[[Lenses], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: build(Lenses(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _bind(build) for name, (build, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
