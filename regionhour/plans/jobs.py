"""Whole jobs: operators chained from raw tables to processed ones. A table that a job reads several times is stored first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regionhour.constants import VALIDATION_PHRASE
from regionhour.functions.calendar import text_date
from regionhour.operators import grid, links, quality, reports, weather
from regionhour.schemas import SOURCE_ENTRY
from regionhour.session import stored
from regionhour.sources.readers import decode_body
from regionhour.sources.versions import VersionedTable
from regionhour.sources.writers import processed_path


def report_job(
    captured: DataFrame, existing: DataFrame | None = None, force: bool = False, phrase: str = VALIDATION_PHRASE
) -> DataFrame:
    """Captured pages (report_date, url, html) to classified reports; an accepted one holds ``phrase``.

    Pages of dates already present are not parsed; one join marks them for the parser and the status.
    """
    if existing is None or force:
        return reports.classify_report(reports.extract_report_text(captured), phrase=phrase)
    marked = reports.mark_present(captured, existing)
    fresh = F.when(~F.col(reports.PRESENT), F.col("html"))
    parsed = reports.extract_report_text(marked.withColumn("_fresh", fresh), "_fresh").drop("_fresh")
    return reports.classify_report(parsed, phrase=phrase)


def source_job(
    pages: DataFrame, cache: DataFrame, fetched: DataFrame, report: str = "report_date", force: bool = False
) -> tuple[DataFrame, DataFrame]:
    """(entries per report, next version of the cache). Pages are parsed once: the entries are stored."""
    urls = links.unique_report_urls(links.extract_footnote_links(pages, [report]), report)
    entries = stored(links.resolve_with_cache(urls, cache, fetched, force), "source_entries")
    return entries, links.upsert_cache(cache, entries, force)


def keep_cache(spark: SparkSession, path: str, entries: DataFrame, force: bool = False, keep: int = 2) -> int:
    """Takes entries into the newest complete version of the cache and commits the result as the next one; returns its number."""
    table = VersionedTable(spark, path)
    version = table.write(links.upsert_cache(table.read(schema=SOURCE_ENTRY), entries, force))
    table.remove_old(keep=keep)
    return version


def decoded_log(log: DataFrame) -> DataFrame:
    """A raw fetch log (``content`` bytes and declared ``charset``) with ``body`` as text; only bodies that a title is read from are decoded."""
    readable = F.col("failure").isNull() & (F.col("http_code") == 200)
    return log.withColumn("body", F.when(readable, decode_body(F.col("content"), F.col("charset")))).drop("content", "charset")


def _run_schema(report: T.StructField) -> T.StructType:
    return T.StructType([report, T.StructField("pos", T.LongType()), *SOURCE_ENTRY.fields, T.StructField("origin", T.StringType())])


def source_run(spark: SparkSession, zone: str, pages: DataFrame, log: DataFrame, report: str, force: bool = False) -> int | None:
    """One run of the link job over captured pages and the raw log of fetches; returns the number of the run.

    Reports that an earlier run has put out are left alone, unless ``force``. The others are parsed once; bodies are decoded and shrink to
    titles where they are read, attempts collapse to one entry per address, and known addresses come from the newest cache. The run's
    entries are committed before the cache takes them in: a run that ends between the two is repeated by nobody, and its
    addresses are fetched again by the next run that meets them. A run without new reports writes nothing and returns None.
    """
    done = VersionedTable(spark, processed_path(zone, "source_runs"))
    schema = _run_schema(pages.schema[report])
    fresh = pages if force else pages.join(done.read_all(schema).select(report).distinct(), report, "left_anti")
    urls = links.unique_report_urls(links.extract_footnote_links(fresh, [report]), report)
    cache = VersionedTable(spark, processed_path(zone, "url_cache")).read(schema=SOURCE_ENTRY)
    fetched = links.classify_fetch(links.collapse_attempts(decoded_log(log)))
    entries = stored(links.resolve_with_cache(urls, cache, fetched, force), "source_entries")
    if entries.isEmpty():
        return None
    run = done.write(entries.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields]))
    keep_cache(spark, processed_path(zone, "url_cache"), entries.select(*SOURCE_ENTRY.names), force)
    return run


def source_entries(spark: SparkSession, zone: str, kind: T.StructField) -> DataFrame:
    """The entries of all runs, each report as its newest run left it, with ``run``."""
    schema = _run_schema(kind)
    rows = VersionedTable(spark, processed_path(zone, "source_runs")).read_all(schema).withColumnRenamed("version", "run")
    newest = rows.groupBy(kind.name).agg(F.max("run").alias("run"))
    return rows.join(newest, [kind.name, "run"], "left_semi")


def weather_issues(rows: DataFrame, strict: bool = False) -> DataFrame:
    """All issues of wide weather rows."""
    kept = quality.weather_rows(rows)
    return quality.csv_day_issues(kept, quality.weather_day_table(kept), strict)


def weather_issue_counts(rows: DataFrame, strict: bool = False) -> DataFrame:
    """The number of issues per city, without making the issues."""
    kept = quality.weather_rows(rows)
    return quality.csv_issue_counts(kept, quality.weather_day_table(kept), strict)


def weather_quality_job(rows: DataFrame, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(status per city, issues) of wide weather rows. The day table, read three times, is stored; issues are counted from their conditions."""
    kept = quality.weather_rows(rows)
    days = stored(quality.weather_day_table(kept), "weather_days")
    coverage = quality.city_coverage(days, text_date(F.col("date")))
    return quality.city_status_of_counts(coverage, quality.csv_issue_counts(kept, days, strict)), quality.csv_day_issues(kept, days, strict)


def feature_table(
    alarms: DataFrame, regions: DataFrame, weather_rows: DataFrame, report_days: DataFrame, start: str | Column, end: str | Column,
    readings: dict[str, str], weather_values: list[str], report_values: list[str],
) -> DataFrame:
    """One row per region-hour: flag, labels, weather of the hour before, report of the day before."""
    flags = grid.region_hour_flags(alarms, regions, start, end)
    labelled = grid.horizon_labels(flags, end)
    hourly = grid.hourly_weather(weather.weather_range_filter(weather_rows, readings), weather_values)
    return grid.lagged_features(labelled, hourly, report_days, weather_values, report_values)
