"""Views that give the driver tables the shapes the operators expect.

Each lens exists twice: as a DataFrame and as the SQL text of the same view.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from regionhour.session import apply_defaults

BASE_DAY = "2024-01-01"


class Lenses:
    """Lazily built views over one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        apply_defaults(spark)
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def intervals(self) -> DataFrame:
        """Alarms by region id, without the region's name."""
        minutes = F.when(F.col("event_type") == "error", 1200).otherwise(60)
        seconds = F.when(F.col("event_id") % 97 == 0, 0).otherwise(
            F.round(F.col("value") * minutes).cast("long") - 600
        )
        start = F.col("ts").cast("timestamp")
        span = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)"))
        return self.table("events").select(
            F.col("event_id").alias("id"),
            ((F.col("user_id") % 25).cast("int") + 1).alias("region_id"),
            F.when(F.col("event_type") == "view", 0).otherwise(1).alias("all_region"),
            F.col("event_type").alias("alert_type"),
            start.alias("start"),
            (start + span).alias("end"),
        )

    @cached_property
    def alarms(self) -> DataFrame:
        nation = self.table("nation")
        return self.intervals.join(nation, F.col("n_nationkey") == F.col("region_id") - 1).select(
            "id", "region_id", F.col("n_name").alias("region_city"), "all_region", "alert_type", "start", "end")

    @cached_property
    def regions(self) -> DataFrame:
        return self.table("nation").select(
            (F.col("n_nationkey") + 1).alias("region_id"),
            F.col("n_name").alias("center_city_en"),
            F.concat(F.lit("U_"), "n_name").alias("center_city_ua"),
        )

    @cached_property
    def orders(self) -> DataFrame:
        """Orders as alarm starts: a history of many years."""
        return self.table("orders").select(
            F.col("o_orderkey").alias("id"),
            ((F.col("o_custkey") % 25).cast("int") + 1).alias("region_id"),
            F.col("o_orderdate").cast("timestamp").alias("start"),
        )

    @cached_property
    def weather(self) -> DataFrame:
        lines, nation = self.table("lineitem"), self.table("nation")
        day = F.date_add(F.lit(BASE_DAY).cast("date"), (F.col("l_orderkey") % 30).cast("int"))
        hour = (F.col("l_partkey") % 24).cast("int")
        clock = F.concat(F.lpad(hour.cast("string"), 2, "0"), F.lit(":00:00"))
        return lines.join(nation, F.col("n_nationkey") == F.col("l_suppkey") % 25).select(
            (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("line_no"),
            ((F.col("l_suppkey") % 25).cast("int") + 1).alias("region_id"),
            F.concat("n_name", F.lit(", Country")).alias("city_address"),
            day.alias("day_date"),
            hour.alias("hour"),
            F.when(F.col("l_orderkey") % 97 == 0, "n/a").otherwise(F.date_format(day, "yyyy-MM-dd")).alias("day_datetime"),
            F.when(F.col("l_partkey") % 59 != 0, clock).alias("hour_datetime"),
            (day.cast("timestamp") + F.make_dt_interval(F.lit(0), hour)).alias("hour_ts"),
            (F.col("l_quantity") * 2.4 - 60).alias("hour_temp"),
            (F.col("l_discount") * 1100).alias("hour_humidity"),
            F.when(F.col("l_returnflag") != "A", F.col("l_tax") * 10).alias("hour_precip"),
            F.when(F.col("l_returnflag") == "R", F.col("l_discount")).alias("hour_snow"),
            (F.col("l_tax") * 2700).alias("hour_windgust"),
            (F.col("l_tax") * 2600).alias("hour_windspeed"),
            (F.col("l_quantity") * 7.5).alias("hour_winddir"),
            (860 + F.col("l_linenumber") * 35).cast("double").alias("hour_pressure"),
            (F.col("l_quantity") * 2).alias("hour_cloudcover"),
            F.when(F.col("l_linenumber") % 2 != 0, F.col("l_quantity")).alias("hour_visibility"),
            F.col("l_returnflag").alias("hour_conditions"),
        )

    @cached_property
    def weather_text(self) -> DataFrame:
        """The wide CSV form: everything is text, some of it blank or unreadable."""
        def text(value: Column) -> Column:
            return F.round(value, 1).cast("string")

        return self.weather.select(
            "line_no", "city_address",
            text(44 + 0.5 * F.col("region_id")).alias("city_latitude"),
            text(20 + F.col("region_id").cast("double")).alias("city_longitude"),
            F.when(F.col("day_datetime") != "n/a", F.col("day_datetime")).alias("day_datetime"),
            text(F.col("hour_temp") + 5).alias("day_tempmax"),
            text(F.col("hour_temp") - 5).alias("day_tempmin"),
            F.coalesce("hour_datetime", F.lit("")).alias("hour_datetime"),
            F.when(F.col("line_no") % 50 == 0, "").when(F.col("line_no") % 51 == 0, "bad").otherwise(
                text(F.col("hour_temp"))).alias("hour_temp"),
            text(F.col("hour_humidity")).alias("hour_humidity"),
            text(F.col("hour_windspeed")).alias("hour_windspeed"),
            text(F.col("hour_pressure")).alias("hour_pressure"),
            text(F.col("hour_cloudcover")).alias("hour_cloudcover"),
        )

    @cached_property
    def forecast_api(self) -> DataFrame:
        """Raw forecast answers, one per line item: two hours today, one after midnight."""
        def hour(step: int) -> Column:
            clock = F.concat(F.lpad(((F.col("l_partkey") + step) % 24).cast("string"), 2, "0"), F.lit(":00:00"))
            return F.struct(
                clock.alias("datetime"),
                (F.col("l_quantity") + step).alias("temp"),
                (F.col("l_discount") * 1100).alias("humidity"),
                (F.col("l_tax") * 2600).alias("windspeed"),
                (F.col("l_quantity") * 7.5).alias("winddir"),
                F.when(F.col("l_linenumber") % 2 != 0, F.col("l_quantity")).alias("visibility"),
                (F.col("l_quantity") * 2).alias("cloudcover"),
                (860 + F.col("l_linenumber") * 35).cast("double").alias("pressure"),
                F.lit(0.0).alias("precip"),
                F.col("l_returnflag").alias("conditions"),
            )

        return self.table("lineitem").select(
            (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("line_no"),
            ((F.col("l_suppkey") % 25).cast("int") + 1).alias("region_id"),
            F.date_format("l_shipdate", "yyyy-MM-dd_HH").alias("request_hour"),
            F.array(
                F.struct(F.array(hour(0), hour(1)).alias("hours")), F.struct(F.array(hour(2)).alias("hours"))
            ).alias("days"),
        )

    @cached_property
    def forecasts(self) -> DataFrame:
        """Forecast documents, one per order: most with 24 hours, some short, some empty."""
        key = F.col("o_orderkey")
        hours = F.when(key % 50 == 0, 0).when(key % 10 == 0, 23).otherwise(24)

        def hour(step: Column) -> Column:
            return F.struct(
                (key % 60 - 20 + step * 0.5).cast("double").alias("temp"),
                (F.col("o_custkey") % 101).cast("double").alias("humidity"),
                (step * 8 + key % 20).cast("double").alias("windspeed"),
                (870 + key % 220).cast("double").alias("pressure"),
                (step * 4).cast("double").alias("cloudcover"),
                F.when((key % 7 != 0) | (step != 5), step.cast("double")).alias("visibility"),
            )

        steps = F.filter(F.sequence(F.lit(0), F.lit(23)), lambda step: step < hours)
        return self.table("orders").select(key.alias("file"), F.transform(steps, hour).alias("forecast"))

    @cached_property
    def reports(self) -> DataFrame:
        """Every page as a report of its own day; beside them, on days before, blocked and missing pages."""
        page = F.col("page_id")
        beside = (-1 - page).alias("page_id")
        swapped = self.table("pages").where((page % 11 == 0) | (page % 13 == 0)).select(
            beside, F.when(page % 11 == 0, "<html><title>Just a moment</title>Checking your browser. Ray ID 1</html>").alias("html"), "url",
        )
        rows = self.table("pages").select("page_id", "html", "url").unionByName(swapped)
        day = F.date_add(F.lit(BASE_DAY).cast("date"), F.col("page_id").cast("int"))
        return rows.select("page_id", day.alias("report_date"), "html", "url")

    @cached_property
    def gapped_reports(self) -> DataFrame:
        """Reports with days missing, for queries that look for gaps."""
        return self.reports.where(F.col("page_id") % 7 != 3)

    @staticmethod
    def _link(at: Column) -> Column:
        """Address and text of the link at a position of a page."""
        url, page = F.col("url"), F.col("page_id")
        number = (page * 8 + at).cast("string")
        kind = (page + at) % 10
        href = (
            F.when(kind == 0, F.concat(F.lit("https://t.me/chan_"), (page % 7).cast("string"), F.lit("/"), number))
            .when(kind == 1, F.concat(F.lit("https://t.me/joinchat/"), page.cast("string")))
            .when(kind == 2, F.concat(F.lit("https://x.com/user"), (page % 5).cast("string"), F.lit("/status/"), number))
            .when(kind == 3, F.concat(F.lit("https://twitter.com/user"), (page % 5).cast("string")))
            .when(kind == 4, F.concat(F.lit("https://m.facebook.com/p/"), page.cast("string")))
            .when(kind == 5, F.concat(url, F.lit(".pdf")))
            .when(kind == 6, F.concat(F.lit("https://www.understandingwar.org/"), page.cast("string")))
            .when(kind == 7, F.concat(F.lit("mailto:a"), page.cast("string"), F.lit("@example.com")))
            .when(kind == 8, F.concat(F.lit("  "), url, F.lit(").  ")))
            .otherwise(url)
        )
        text = F.when(page % 3 == 0, F.concat(F.lit("["), at.cast("string"), F.lit("]"))).otherwise("link")
        return F.struct(
            at.alias("pos"), href.alias("href"), text.alias("link_text"),
            ((page + at) % 17 == 0).alias("parent_marked"), ((page + at) % 19 == 0).alias("in_list"),
        )

    @property
    def _positions(self) -> Column:
        return F.sequence(F.lit(0), F.lit(7)).cast("array<bigint>")

    @cached_property
    def links(self) -> DataFrame:
        found = F.transform(self._positions, self._link)
        return self.table("pages").select("page_id", F.explode(found).alias("link")).select("page_id", "link.*")

    @cached_property
    def linked_pages(self) -> DataFrame:
        """Pages whose article ends with a list of endnotes holding those links."""
        def item(at: Column) -> Column:
            link = self._link(at)
            before = F.when(link["parent_marked"], "<li>see [4] ").otherwise("<li>")
            return F.concat(before, F.lit('<a href="'), link["href"], F.lit('">'), link["link_text"], F.lit("</a></li>"))

        notes = F.concat(
            F.lit("<h3>Endnotes</h3><ol>"), F.array_join(F.transform(self._positions, item), ""), F.lit("</ol></article>")
        )
        return self.table("pages").select("page_id", F.replace("html", F.lit("</article>"), notes).alias("html"))

    @cached_property
    def fetch_log(self) -> DataFrame:
        at, page = F.col("pos"), F.col("page_id")
        kind = (page + at) % 12
        placed = self.table("pages").select(
            "page_id", "url", "html", F.explode(F.sequence(F.lit(0), F.lit(7)).cast("array<bigint>")).alias("pos")
        )
        code = F.lit(200)
        for value, status in ((0, 404), (1, 410), (2, 403), (3, 451), (4, 429), (5, 503), (6, 302)):
            code = F.when(kind == value, status).otherwise(code)
        failure = F.element_at(F.array(*map(F.lit, ["timeout", "connection", "ssl", "redirects"])), (page % 4 + 1).cast("int"))
        return placed.select(
            "page_id", "pos", F.concat("url", F.lit("/"), at.cast("string")).alias("url"),
            F.when(kind != 7, code).alias("http_code"),
            F.when(kind == 8, "application/pdf; q=1").when(kind != 7, "text/html; charset=utf-8").alias("content_type"),
            F.when(kind == 9, 6_000_000).cast("long").alias("content_length"),
            F.when(kind == 7, failure).alias("failure"),
            F.when(kind == 7, F.lit("reset by peer")).alias("failure_detail"),
            F.concat("url", F.lit("/"), at.cast("string")).alias("final_url"),
            F.col("html").alias("body"),
        )

    @cached_property
    def marked_documents(self) -> DataFrame:
        """Documents with reference marks, addresses, wide blanks and blank lines set into the whole text."""
        number = F.col("doc_id").cast("string")
        mark = F.concat(F.lit(". ["), number, F.lit(", 12] see https://example.org/x"), number, F.lit(" [note]\t  \n \n\n\n  "))
        return self.table("documents").select("doc_id", F.replace("text", F.lit(". "), mark).alias("text"))

    @cached_property
    def typographic_documents(self) -> DataFrame:
        """Documents with plain characters swapped for typographic ones."""
        text = F.translate("text", "-'\"", "–’“")
        for plain, fancy in ((" de ", " — "), (". ", "… "), (" the ", " • the\u200b ")):
            text = F.replace(text, F.lit(plain), F.lit(fancy))
        return self.table("documents").select("doc_id", text.alias("text"))

    @cached_property
    def alerts(self) -> DataFrame:
        """Alerts of one snapshot per clock hour, ordered by id within it."""
        region = F.when(F.col("id") % 41 != 0, F.col("region_city"))
        started = F.when(F.col("id") % 43 == 0, "2024-01-01").otherwise(F.date_format("start", "yyyy-MM-dd'T'HH:mm:ss"))
        return self.alarms.select(
            F.date_format("start", "yyyy-MM-dd HH").alias("snapshot"), F.col("id").alias("pos"),
            region.alias("location_oblast"),
            F.when(F.col("alert_type") != "view", F.col("alert_type")).alias("alert_type"), started.alias("started_at"),
        )


_SECONDS = (
    "CASE WHEN event_id % 97 = 0 THEN 0 "
    "ELSE CAST(round(value * CASE WHEN event_type = 'error' THEN 1200 ELSE 60 END) AS BIGINT) - 600 END"
)
_LINE_DAY = f"(DATE '{BASE_DAY}' + CAST(l_orderkey % 30 AS INT))"

VIEWS = {
    "alarms": (f"""
        SELECT event_id AS id, CAST(user_id % 25 AS INT) + 1 AS region_id, n_name AS region_city,
               CASE WHEN event_type = 'view' THEN 0 ELSE 1 END AS all_region, event_type AS alert_type,
               ts AS start_ts, ts + to_seconds({_SECONDS}) AS end_ts
        FROM events JOIN nation ON n_nationkey = user_id % 25""", []),
    "regions": ("""
        SELECT n_nationkey + 1 AS region_id, n_name AS center_city_en, concat('U_', n_name) AS center_city_ua
        FROM nation""", []),
    "named_alarms": ("SELECT * FROM alarms LEFT JOIN regions USING (region_id)", ["alarms", "regions"]),
    "order_starts": ("""
        SELECT o_orderkey AS id, CAST(o_custkey % 25 AS INT) + 1 AS region_id, CAST(o_orderdate AS TIMESTAMP) AS start_ts
        FROM orders""", []),
    "weather": (f"""
        SELECT l_orderkey * 8 + l_linenumber AS line_no, CAST(l_suppkey % 25 AS INT) + 1 AS region_id,
               concat(n_name, ', Country') AS city_address, {_LINE_DAY} AS day_date,
               CAST(l_partkey % 24 AS INT) AS hour,
               CASE WHEN l_orderkey % 97 = 0 THEN 'n/a' ELSE strftime({_LINE_DAY}, '%Y-%m-%d') END AS day_datetime,
               CASE WHEN l_partkey % 59 <> 0 THEN concat(lpad(CAST(l_partkey % 24 AS VARCHAR), 2, '0'), ':00:00') END
                 AS hour_datetime,
               CAST({_LINE_DAY} AS TIMESTAMP) + to_hours(CAST(l_partkey % 24 AS INT)) AS hour_ts,
               l_quantity * 2.4 - 60 AS hour_temp, l_discount * 1100 AS hour_humidity,
               CASE WHEN l_returnflag <> 'A' THEN l_tax * 10 END AS hour_precip,
               CASE WHEN l_returnflag = 'R' THEN l_discount END AS hour_snow,
               l_tax * 2700 AS hour_windgust, l_tax * 2600 AS hour_windspeed, l_quantity * 7.5 AS hour_winddir,
               CAST(860 + l_linenumber * 35 AS DOUBLE) AS hour_pressure, l_quantity * 2 AS hour_cloudcover,
               CASE WHEN l_linenumber % 2 <> 0 THEN l_quantity END AS hour_visibility,
               l_returnflag AS hour_conditions
        FROM lineitem JOIN nation ON n_nationkey = l_suppkey % 25""", []),
    "weather_text": ("""
        SELECT line_no, city_address,
               CAST(round(44 + 0.5 * region_id, 1) AS DOUBLE)::VARCHAR AS city_latitude,
               CAST(round(20 + CAST(region_id AS DOUBLE), 1) AS DOUBLE)::VARCHAR AS city_longitude,
               CASE WHEN day_datetime <> 'n/a' THEN day_datetime END AS day_datetime,
               round(hour_temp + 5, 1)::VARCHAR AS day_tempmax, round(hour_temp - 5, 1)::VARCHAR AS day_tempmin,
               coalesce(hour_datetime, '') AS hour_datetime,
               CASE WHEN line_no % 50 = 0 THEN '' WHEN line_no % 51 = 0 THEN 'bad'
                    ELSE round(hour_temp, 1)::VARCHAR END AS hour_temp,
               round(hour_humidity, 1)::VARCHAR AS hour_humidity, round(hour_windspeed, 1)::VARCHAR AS hour_windspeed,
               round(hour_pressure, 1)::VARCHAR AS hour_pressure, round(hour_cloudcover, 1)::VARCHAR AS hour_cloudcover
        FROM weather""", ["weather"]),
    "forecast_hours": ("""
        SELECT o_orderkey AS file, step, CAST(o_orderkey % 60 - 20 + step * 0.5 AS DOUBLE) AS temp,
               CAST(o_custkey % 101 AS DOUBLE) AS humidity, CAST(step * 8 + o_orderkey % 20 AS DOUBLE) AS windspeed,
               CAST(870 + o_orderkey % 220 AS DOUBLE) AS pressure, CAST(step * 4 AS DOUBLE) AS cloudcover,
               CASE WHEN o_orderkey % 7 <> 0 OR step <> 5 THEN CAST(step AS DOUBLE) END AS visibility
        FROM orders LEFT JOIN (SELECT unnest(range(0, 24)) AS step)
          ON step < CASE WHEN o_orderkey % 50 = 0 THEN 0 WHEN o_orderkey % 10 = 0 THEN 23 ELSE 24 END""", []),
    "keyed_alarms": ("""
        SELECT *, lower(trim(center_city_en)) AS join_city, CAST(start_ts AS DATE) AS day_key,
               CAST(hour(start_ts) AS INT) AS hour_key
        FROM named_alarms WHERE center_city_en IS NOT NULL AND start_ts IS NOT NULL""", ["named_alarms"]),
    "keyed_weather": ("""
        SELECT * FROM (
          SELECT *, lower(trim(split_part(city_address, ',', 1))) AS join_city,
                 CAST(try_strptime(day_datetime, '%Y-%m-%d') AS DATE) AS day_key,
                 CAST(hour(try_strptime(hour_datetime, '%H:%M:%S')) AS INT) AS hour_key
          FROM weather) WHERE day_key IS NOT NULL AND hour_key IS NOT NULL""", ["weather"]),
    "reports": (f"""
        SELECT page_id, DATE '{BASE_DAY}' + CAST(page_id AS INT) AS report_date, html, url
        FROM (SELECT page_id, html, url FROM pages UNION ALL
              SELECT -1 - page_id, CASE WHEN page_id % 11 = 0
                     THEN '<html><title>Just a moment</title>Checking your browser. Ray ID 1</html>' END, url
              FROM pages WHERE page_id % 11 = 0 OR page_id % 13 = 0)""", []),
    "gapped_reports": ("SELECT * FROM reports WHERE page_id % 7 <> 3", ["reports"]),
    "positions": ("SELECT unnest(range(0, 8)) AS pos", []),
    "links": ("""
        SELECT page_id, pos, CASE (page_id + pos) % 10
             WHEN 0 THEN concat('https://t.me/chan_', page_id % 7, '/', page_id * 8 + pos)
             WHEN 1 THEN concat('https://t.me/joinchat/', page_id)
             WHEN 2 THEN concat('https://x.com/user', page_id % 5, '/status/', page_id * 8 + pos)
             WHEN 3 THEN concat('https://twitter.com/user', page_id % 5)
             WHEN 4 THEN concat('https://m.facebook.com/p/', page_id)
             WHEN 5 THEN concat(url, '.pdf')
             WHEN 6 THEN concat('https://www.understandingwar.org/', page_id)
             WHEN 7 THEN concat('mailto:a', page_id, '@example.com')
             WHEN 8 THEN concat('  ', url, ').  ') ELSE url END AS href,
           CASE WHEN page_id % 3 = 0 THEN concat('[', pos, ']') ELSE 'link' END AS link_text,
           (page_id + pos) % 17 = 0 AS parent_marked, (page_id + pos) % 19 = 0 AS in_list
        FROM pages CROSS JOIN positions""", ["positions"]),
    "fetch_log": ("""
        SELECT page_id, pos, concat(url, '/', pos) AS url,
           CASE (page_id + pos) % 12 WHEN 0 THEN 404 WHEN 1 THEN 410 WHEN 2 THEN 403 WHEN 3 THEN 451 WHEN 4 THEN 429
             WHEN 5 THEN 503 WHEN 6 THEN 302 WHEN 7 THEN NULL ELSE 200 END AS http_code,
           CASE (page_id + pos) % 12 WHEN 8 THEN 'application/pdf; q=1' WHEN 7 THEN NULL
             ELSE 'text/html; charset=utf-8' END AS content_type,
           CASE WHEN (page_id + pos) % 12 = 9 THEN 6000000 END AS content_length,
           CASE WHEN (page_id + pos) % 12 = 7
                THEN ['timeout', 'connection', 'ssl', 'redirects'][page_id % 4 + 1] END AS failure,
           html AS body
        FROM pages CROSS JOIN positions""", ["positions"]),
    "marked_documents": ("""
        SELECT doc_id, replace(text, '. ', concat('. [', doc_id, ', 12] see https://example.org/x', doc_id,
               ' [note]', chr(9), '  ', chr(10), ' ', chr(10), chr(10), chr(10), '  ')) AS text
        FROM documents""", []),
    "typographic_documents": ("""
        SELECT doc_id, replace(replace(replace(translate(text, '-''"', '–’“'), ' de ', ' — '), '. ', '… '),
               ' the ', concat(' • the', chr(8203), ' ')) AS text
        FROM documents""", []),
    "alerts": ("""
        SELECT strftime(start_ts, '%Y-%m-%d %H') AS snapshot, id AS pos,
               CASE WHEN id % 41 <> 0 THEN region_city END AS location_oblast,
               CASE WHEN alert_type <> 'view' THEN alert_type END AS alert_type,
               CASE WHEN id % 43 = 0 THEN '2024-01-01' ELSE strftime(start_ts, '%Y-%m-%dT%H:%M:%S') END AS started_at
        FROM alarms""", ["alarms"]),
}


def with_views(body: str, *names: str, extra: dict[str, str] | None = None) -> str:
    """``body`` preceded by the named views, those they need, and ``extra`` ones after them."""
    ordered: list[str] = []

    def need(name: str) -> None:
        for other in VIEWS[name][1]:
            need(other)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        need(name)
    parts = [f"{name} AS ({VIEWS[name][0]})" for name in ordered]
    parts += [f"{name} AS ({text})" for name, text in (extra or {}).items()]
    return f"WITH {', '.join(parts)} {body}" if parts else body
