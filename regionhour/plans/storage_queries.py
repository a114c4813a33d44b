"""Registered jobs that write, commit and read back: versions of the cache, the link job, the report job, processed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regionhour.operators import links, quality, reports, weather
from regionhour.plans import jobs, link_queries
from regionhour.plans.lenses import Lenses, with_views
from regionhour.plans.link_queries import ENTRY_VIEWS, _FETCHED, _SPECIAL, _UNIQUE
from regionhour.plans.report_queries import _CLASSIFIED, PHRASE, plain_text
from regionhour.plans.stream_queries import new_folder
from regionhour.plans.weather_queries import _DAY_ROWS, _ROWS, rows
from regionhour.schemas import SOURCE_ENTRY
from regionhour.sources import readers, writers
from regionhour.sources.versions import VersionedTable

MONTH = ("2024-01-10", "2024-02-10")  # days that the stored tables are asked for


def cache_versions(v: Lenses) -> DataFrame:
    """The cache after two runs: what an earlier run left, then resolved entries, then fetched ones that replace older ones."""
    path = new_folder(v, "cache_versions")
    jobs.keep_cache(v.spark, path, link_queries.cache(v), keep=3)
    jobs.keep_cache(v.spark, path, link_queries.entries(v), keep=3)
    jobs.keep_cache(v.spark, path, link_queries.fetched_by_url(v), force=True, keep=3)
    table = VersionedTable(v.spark, path)
    return table.read_all(SOURCE_ENTRY).where(F.col("version") > 1)


def raw_log(v: Lenses) -> DataFrame:
    """Attempts at each page's own address as bytes: a second one where the first was worth it; bodies in several encodings."""
    page = F.col("page_id")
    kind = page % 8
    code = F.when(kind == 0, 404).when(kind == 1, 403).when(kind == 2, 503).when(kind == 3, 429).when(kind == 4, F.lit(None).cast("int")).otherwise(200)
    utf8 = F.encode("html", "UTF-8")
    content = F.when(page % 3 == 0, F.encode("html", "UTF-16")).when(page % 3 == 1, F.concat(utf8, F.unhex(F.lit("FF")))).otherwise(utf8)
    first = v.table("pages").select(
        "page_id", F.lit(1).alias("attempt"), "url", code.alias("http_code"),
        F.when(page % 16 == 7, "application/pdf; q=1").when(kind != 4, "text/html").alias("content_type"),
        F.when(page % 16 == 15, 6_000_000).cast("long").alias("content_length"), F.when(kind == 4, "timeout").alias("failure"),
        F.when(kind == 4, "reset by peer").alias("failure_detail"), F.col("url").alias("final_url"),
        content.alias("content"), F.when(page % 3 == 0, "UTF-16").otherwise("x-none").alias("charset"))
    again = first.where(kind.isin(2, 3) & (page % 3 < 2)).withColumns({
        "attempt": F.lit(2), "http_code": F.when(page % 3 == 0, 200).otherwise(429)})
    return first.unionByName(again)


def source_run(v: Lenses) -> DataFrame:
    """Two runs of the link job: pages with even ids, then all pages, of which the first are left alone."""
    zone = new_folder(v, "source_run")
    log, pages = raw_log(v), v.linked_pages
    jobs.source_run(v.spark, zone, pages.where("page_id % 2 = 0"), log, "page_id")
    jobs.source_run(v.spark, zone, pages, log, "page_id")
    return jobs.source_entries(v.spark, zone, pages.schema["page_id"])


def report_job(v: Lenses) -> DataFrame:
    """What the report job says of every page, and whether it parsed it; lengths are left out, because SQL can't decompose characters."""
    done = v.reports.where(F.col("page_id") % 5 == 0).select("report_date")
    out = jobs.report_job(v.reports, done, phrase=PHRASE)
    return out.select("page_id", "status", F.regexp_replace("error_message", r"\d+", "N").alias("error_message"), F.col("text").isNotNull().cast("int").alias("parsed"))


def in_month(column: str):
    return F.col(column).between(*MONTH)


def stored_reports(v: Lenses) -> DataFrame:
    """Accepted reports written by date, those of some weeks read back."""
    path = writers.write_reports(reports.report_document(reports.classify_report(plain_text(v), phrase=PHRASE)), new_folder(v, "zone"))
    back = readers.read_stored_reports(v.spark, path).where(in_month("date"))
    return back.select(F.col("date").cast("string").alias("date"), "url", "status", F.col("char_count").cast("int").alias("char_count"),
                       F.md5(F.col("text").cast("binary")).alias("text"))


def stored_weather_days(v: Lenses) -> DataFrame:
    """Nested days written by city and date, those of some weeks read back."""
    kept = rows(v)
    path = writers.write_weather_days(quality.nest_weather_days(kept, quality.weather_day_table(kept)), new_folder(v, "zone"))
    back = readers.read_stored_weather_days(v.spark, path).where(in_month("date"))
    return back.select("city", F.col("date").cast("string").alias("date"), F.col("daily.day_tempmax").alias("day_tempmax"), F.size("hours").cast("long").alias("n_hours"),
                       F.element_at("hours", 1)["hour_datetime"].alias("first_hour"))


def stored_forecasts(v: Lenses) -> DataFrame:
    """Weather hours as one forecast document per day and region, written and read back as hours."""
    hours = v.weather.where(F.col("hour_datetime").isNotNull()).groupBy("region_id", "day_date", "hour_datetime").agg(
        F.min("hour_temp").alias("temp"), F.max("hour_humidity").alias("humidity"))
    others = {f: F.lit(None).cast("double") for f in weather.FORECAST_FIELDS if f not in ("datetime", "temp", "humidity", "conditions")}
    shaped = hours.select(
        F.concat(F.lit("r"), F.col("region_id").cast("string")).alias("region"), F.concat(F.date_format("day_date", "yyyy-MM-dd"), F.lit("_00")).alias("request_hour"),
        F.col("hour_datetime").alias("datetime"), "temp", "humidity", *[c.alias(f) for f, c in others.items()],
        *[F.lit("Clear").alias(f) for f in weather.FORECAST_FIELDS if f == "conditions"])
    path = writers.write_forecasts(weather.forecast_documents(shaped), new_folder(v, "zone"))
    back = readers.read_stored_forecasts(v.spark, path)
    flat = back.select("region", "request_hour", F.posexplode("forecast").alias("step", "h"))
    return flat.select("region", "request_hour", F.col("step").cast("long").alias("step"), F.col("h.datetime").alias("datetime"),
                       F.round("h.temp", 6).alias("temp"), F.round("h.humidity", 6).alias("humidity"))


def stored_sources(v: Lenses) -> DataFrame:
    """Source documents with counters written by page, their entries read back."""
    pages = v.table("pages").select(F.col("page_id").cast("string").alias("report_date"), F.concat(F.col("page_id").cast("string"), F.lit(".html")).alias("html_file"))
    entries = link_queries.entries(v).withColumn("report_date", F.col("page_id").cast("string")).drop("page_id")
    path = writers.write_report_sources(links.report_sources(pages, entries, "report_date"), new_folder(v, "zone"))
    return readers.read_stored_sources(v.spark, path).select(
        F.col("report_date").cast("long").alias("page_id"), "html_file", F.col("pos").cast("long").alias("pos"), *links.ENTRY)


_V2 = "SELECT * FROM cached UNION ALL SELECT DISTINCT " + ", ".join(links.ENTRY) + " FROM entries WHERE url NOT IN (SELECT url FROM cached)"
_LOG = """
    SELECT page_id, 1 AS pos, url, CASE page_id % 8 WHEN 0 THEN 404 WHEN 1 THEN 403 WHEN 2 THEN 503 WHEN 3 THEN 429 WHEN 4 THEN NULL ELSE 200 END AS http_code,
           CASE WHEN page_id % 16 = 7 THEN 'application/pdf; q=1' WHEN page_id % 8 <> 4 THEN 'text/html' END AS content_type,
           CASE WHEN page_id % 16 = 15 THEN 6000000 END AS content_length, CASE WHEN page_id % 8 = 4 THEN 'timeout' END AS failure, html AS body,
           CASE WHEN page_id % 8 = 2 THEN 'HTTP 503' WHEN page_id % 8 = 4 THEN 'Timeout' END AS error FROM pages
    UNION ALL SELECT page_id, 2, url, CASE WHEN page_id % 3 = 0 THEN 200 ELSE 429 END, 'text/html', NULL, NULL, html, NULL
    FROM pages WHERE page_id % 8 IN (2, 3) AND page_id % 3 < 2"""
# Bodies with a byte that is not UTF-8 get a replacement character after the end of the page, where no title is.
_COLLAPSED = """
    SELECT * FROM (SELECT *, coalesce(arg_max(error, CASE WHEN error IS NOT NULL THEN pos END) OVER (PARTITION BY url), '') AS last_error,
        row_number() OVER (PARTITION BY url ORDER BY pos DESC, page_id DESC) AS rn FROM tries) WHERE rn = 1"""
_RUN_FETCHED = _FETCHED.replace("FROM fetch_log", "FROM collapsed").replace("'[FAILED: ]'", "concat('[FAILED: ', last_error, ']')").replace(
    "concat('[FAILED: HTTP ', http_code, ']')", "concat('[FAILED: ', last_error, ']')").replace(
    "CASE WHEN http_code >= 500 THEN concat('HTTP ', http_code) ELSE '' END", "last_error")


def _run(urls: str, cache: str | None) -> str:
    """SQL of the entries that a run gives to ``urls``."""
    def pick(column: str, none: str) -> str:
        known = f"WHEN c.url IS NOT NULL THEN c.{column} " if cache else ""
        from_special = f"s.{column}" if column in ("title", "status") else "NULL"
        return f"CASE {known}WHEN s.title IS NOT NULL THEN {from_special} WHEN f.url IS NOT NULL THEN f.{column} ELSE {none} END AS {column}"

    origin = ("WHEN c.url IS NOT NULL THEN 'cache' " if cache else "") + "WHEN s.title IS NOT NULL THEN 'special' WHEN f.url IS NOT NULL THEN 'fetch' ELSE 'none'"
    return f"""
        SELECT u.page_id, u.pos, u.url, {pick('title', "'[UNRESOLVED]'")}, {pick('status', "'unresolved'")}, {pick('http_code', 'NULL')},
               {pick('content_type', 'NULL')}, {pick('final_url', 'NULL')}, {pick('error_detail', 'NULL')}, CASE {origin} END AS origin
        FROM {urls} u LEFT JOIN special s USING (url) LEFT JOIN fetched f USING (url) {f"LEFT JOIN {cache} c USING (url)" if cache else ""}"""


_PLAIN_ENTRY = f"page_id, pos, {', '.join(links.ENTRY)}, origin"
_DAYS = f"BETWEEN '{MONTH[0]}' AND '{MONTH[1]}'"

# The job's text is decomposed: a character with an accent counts as two.
_DECOMPOSED = "length(text) + length(list_filter(string_split(text, ''), lambda c: strip_accents(c) <> c))"

QUERIES = {
    "cache_versions": (cache_versions, with_views(f"""
        SELECT *, 2 AS version FROM second UNION ALL
        SELECT {', '.join(links.ENTRY)}, 3 FROM fetched_once UNION ALL SELECT *, 3 FROM second WHERE url NOT IN (SELECT url FROM fetched_once)""",
        "links", "fetch_log", extra={**ENTRY_VIEWS, "second": _V2})),
    "source_run": (source_run, with_views(f"""
        SELECT {_PLAIN_ENTRY}, 1 AS run FROM one UNION ALL SELECT {_PLAIN_ENTRY}, 2 FROM two""", "links", extra={
        "chosen": "SELECT * FROM links", "unique_urls": _UNIQUE, "special": _SPECIAL.format(source="unique_urls"), "tries": _LOG, "collapsed": _COLLAPSED,
        "fetched": _RUN_FETCHED, "even": "SELECT * FROM unique_urls WHERE page_id % 2 = 0", "odd": "SELECT * FROM unique_urls WHERE page_id % 2 <> 0",
        "one": _run("even", None), "known": f"SELECT DISTINCT {', '.join(links.ENTRY)} FROM one", "two": _run("odd", "known")})),
    "report_job": (report_job, with_views(r"""
        SELECT page_id, status, regexp_replace(error_message, '\d+', 'N', 'g') AS error_message,
               CAST(NOT present AND text IS NOT NULL AS INT) AS parsed FROM classified""", "reports", extra={
        "article": _CLASSIFIED["article"], "classified": _CLASSIFIED["classified"].replace("length(text)", _DECOMPOSED)})),
    "stored_reports": (stored_reports, with_views(f"""
        SELECT strftime(report_date, '%Y-%m-%d') AS date, url, 'ok' AS status, CAST(chars AS INT) AS char_count, md5(text) AS text
        FROM fresh WHERE status = 'ok' AND strftime(report_date, '%Y-%m-%d') {_DAYS}""", "reports", extra={
        "article": _CLASSIFIED["article"], "fresh": _CLASSIFIED["classified"].replace("page_id % 5 = 0 AS present", "false AS present")})),
    "stored_weather_days": (stored_weather_days, with_views(f"""
        SELECT replace(x.city, ' ', '_') AS city, x.date, x.day_tempmax, x.n_hours, min(hour_datetime) FILTER (hour_datetime <> '') AS first_hour
        FROM x JOIN r USING (city, date) WHERE x.date {_DAYS} GROUP BY ALL""", "weather_text", extra={"r": _ROWS, "x": _DAY_ROWS})),
    "stored_forecasts": (stored_forecasts, with_views("""
        SELECT concat('r', region_id) AS region, concat(strftime(day_date, '%Y-%m-%d'), '_00') AS request_hour,
               row_number() OVER (PARTITION BY region_id, day_date ORDER BY hour_datetime) - 1 AS step, hour_datetime AS datetime,
               round(min(hour_temp), 6) + 0.0 AS temp, round(max(hour_humidity), 6) + 0.0 AS humidity
        FROM weather WHERE hour_datetime IS NOT NULL GROUP BY region_id, day_date, hour_datetime""", "weather")),
    "stored_sources": (stored_sources, with_views(f"""
        SELECT page_id, concat(page_id, '.html') AS html_file, row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS pos, {', '.join(links.ENTRY)}
        FROM entries""", "links", "fetch_log", extra=ENTRY_VIEWS)),
}
