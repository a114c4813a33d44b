"""Rules of quality, links, grid and jobs on small cases, and properties that must hold."""

from __future__ import annotations

import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from regionhour import schemas
from regionhour.constants import RANGES, REGION_LOCATIONS
from regionhour.operators import alarms as alarm_ops
from regionhour.operators import grid, links, profile, quality, reports, serving
from regionhour.operators import weather as weather_ops
from regionhour.plans import jobs


def day_issues(spark, strict=False, n_hours=24, lat="50", lon="30", hours=()):
    days = spark.createDataFrame([("c", "d", "d.json", n_hours, lat, lon)], "city string, date string, file string, n_hours int, latitude string, longitude string")
    columns = "hour_datetime string, hour_temp string, hour_humidity string, hour_windspeed string, hour_pressure string, hour_cloudcover string"
    rows = [("c", "d", "d.json", "20", "10", *h) for h in hours]
    hour_rows = spark.createDataFrame(rows, f"city string, date string, file string, day_tempmax string, day_tempmin string, {columns}")
    return sorted((r["category"], r["message"]) for r in quality.weather_day_issues(days, hour_rows, strict).collect())


GOOD = ("00:00:00", "15", "50", "5", "1000", "10")


def test_clean_day(spark):
    assert day_issues(spark, hours=[GOOD, ("01:00:00", "20.5", *GOOD[2:])]) == []


def test_day_level_issues(spark):
    assert day_issues(spark, n_hours=23, lat="43.9", lon="41.5") == [
        ("CHRONOLOGY", "Expected 24h, found 23h"), ("GEOGRAPHY", "Lat 43.9 outside Ukraine"), ("GEOGRAPHY", "Lon 41.5 outside Ukraine")]


def test_zero_coordinate_passes_unless_strict(spark):
    assert day_issues(spark, lat="0", lon="") == []
    assert day_issues(spark, strict=True, lat="0") == [("GEOGRAPHY", "Lat 0.0 outside Ukraine")]


def test_hour_level_issues(spark):
    hours = [("01:00:00", "20.6", "50", "5", "1000", "10"), ("02:00:00", "9.4", "", "bad", "869.9", "100.1"), ("03:00:00", "nan", *GOOD[2:])]
    assert day_issues(spark, hours=hours) == [
        ("CONSISTENCY", "Hour 01:00:00: 20.6 > Day Max 20.0"),
        ("CONSISTENCY", "Hour 02:00:00: 9.4 < Day Min 10.0"),
        ("NULL", "Empty hour_humidity"), ("NULL", "Empty hour_windspeed"),
        ("RANGE", "hour_cloudcover=100.1 out of 0.0..100.0"), ("RANGE", "hour_pressure=869.9 out of 870.0..1084.0"),
        ("RANGE", "hour_temp=NaN out of -50.0..50.0"),
    ]


def fetch_log(spark, *rows):
    columns = "url string, http_code int, content_type string, content_length long, failure string, failure_detail string, final_url string, body string"
    return spark.createDataFrame(rows, columns)


@pytest.mark.parametrize("row,title,status", [
    ((404, "application/pdf;x", None, None), "[NON-HTML: application/pdf]", "non_html"),
    ((404, "text/html", 5_000_001, None), "[TOO LARGE]", "non_html"),
    ((200, "text/html", 5_000_000, None), "Hi", "ok"),
    ((404, "text/html", None, None), "[DEAD LINK]", "dead_link"),
    ((410, None, None, None), "[GONE]", "dead_link"),
    ((451, None, None, None), "[UNAVAILABLE FOR LEGAL REASONS]", "blocked"),
    ((503, None, None, None), "[FAILED: HTTP 503]", "error"),
    ((429, None, None, None), "[FAILED: ]", "error"),
    ((302, None, None, None), "[HTTP 302]", "error"),
    ((None, None, None, "redirects"), "[REDIRECT LOOP]", "redirect_loop"),
    ((None, None, None, "ssl"), "[SSL ERROR]", "error"),
    ((None, None, None, "request"), "[REQUEST ERROR]", "error"),
    ((None, None, None, "other"), "[CRITICAL PARSE ERROR]", "error"),
])
def test_classify_fetch(spark, row, title, status):
    code, kind, size, failure = row
    got = links.classify_fetch(fetch_log(spark, ("u", code, kind, size, failure, "why", "v", "<title>Hi</title>"))).first()
    assert (got["title"], got["status"]) == (title, status)


def test_attempts_keep_the_last_retryable_error(spark):
    rows = [("a", 1, 503, None, None), ("a", 2, 429, None, None), ("b", 1, None, "timeout", None), ("b", 2, 200, None, None), ("c", 1, 429, None, None)]
    log = spark.createDataFrame(rows, "url string, attempt int, http_code int, failure string, failure_detail string")
    got = {r["url"]: (r["http_code"], r["last_error"]) for r in links.collapse_attempts(log).collect()}
    assert got == {"a": (429, "HTTP 503"), "b": (200, "Timeout"), "c": (429, "")}


def test_attempts_feed_the_classification(spark):
    log = fetch_log(spark, ("u", 503, None, None, None, None, "u", None), ("u", 200, "text/html", None, None, None, "u", "<title>Late</title>"))
    tried = log.withColumn("attempt", F.when(F.col("http_code") == 503, 1).otherwise(2))
    got = links.classify_fetch(links.collapse_attempts(tried)).first()
    assert (got["title"], got["status"], got["http_code"]) == ("Late", "ok", 200)


def entries(spark, *rows):
    filled = [(*r, None, None, None, None) for r in rows]
    return spark.createDataFrame(filled, schemas.SOURCE_ENTRY)


def test_cache_beats_special_unless_forced(spark):
    urls = spark.createDataFrame([("d", i, u) for i, u in enumerate(["https://t.me/a/1", "http://f.org", "http://n.org", "http://c.org"])], "report_date string, pos long, url string")
    cache = entries(spark, ("https://t.me/a/1", "old", "dead_link"), ("http://c.org", "cached", "ok"))
    fetched = entries(spark, ("http://f.org", "F", "ok"), ("http://c.org", "fresh", "ok"))

    def titles(force):
        return [r["title"] for r in links.resolve_with_cache(urls, cache, fetched, force).orderBy("pos").collect()]

    assert titles(False) == ["old", "F", "[UNRESOLVED]", "cached"]
    assert titles(True) == ["[Telegram: @a (Post 1)]", "F", "[UNRESOLVED]", "fresh"]

    fresh = entries(spark, ("http://c.org", "fresh", "ok"), ("http://f.org", "F", "ok"))
    for force, title in ((False, "cached"), (True, "fresh")):
        next_version = {r["url"]: r["title"] for r in links.upsert_cache(cache, fresh, force).collect()}
        assert next_version == {"https://t.me/a/1": "old", "http://c.org": title, "http://f.org": "F"}


def test_some_statuses_are_in_no_bucket(spark):
    rows = [("d", s) for s in ("ok", "redirect_loop", "skipped", "unresolved", "timeout", "error")]
    got = links.report_rollup(spark.createDataFrame(rows, "report_date string, status string"), "report_date").first()
    assert tuple(got)[1:] == (6, 1, 2, 0, 0)


def test_unmarked_report_keeps_all_links(spark):
    rows = [("a", 0, "x", False, False), ("a", 1, "[ 2 ] y", False, False), ("b", 0, "z", False, False), ("b", 1, None, False, False)]
    df = spark.createDataFrame(rows, "report string, pos int, link_text string, parent_marked boolean, in_list boolean")
    got = links.select_footnote_links(df, "report").collect()
    assert sorted((r["report"], r["pos"]) for r in got) == [("a", 1), ("b", 0), ("b", 1)]


def random_alarms(spark, seed, n=80):
    rng = random.Random(seed)
    start = datetime(2024, 1, 1)
    rows = []
    for i in range(n):
        begin = start + timedelta(minutes=rng.randint(-600, 5000))
        rows.append((i, rng.randint(1, 4), begin, begin + timedelta(minutes=rng.choice([-30, 0, 1, 59, 60, 61, 200]))))
    df = spark.createDataFrame(rows, "id long, region_id int, start timestamp, end timestamp")
    return rows, df, spark.createDataFrame([(i,) for i in range(1, 6)], "region_id int")


@pytest.mark.parametrize("seed", range(3))
def test_flags_and_labels_match_brute_force(spark, seed):
    rows, alarms, regions = random_alarms(spark, seed)
    first, hours = datetime(2024, 1, 1), 72
    flags = grid.region_hour_flags(alarms, regions, "2024-01-01", "2024-01-04")
    got = {(r["region_id"], r["hour_ts"]): r for r in grid.horizon_labels(flags, "2024-01-04").collect()}
    assert len(got) == 5 * hours
    for region in range(1, 6):
        series = []
        for h in range(hours):
            begin, end = first + timedelta(hours=h), first + timedelta(hours=h + 1)
            series.append(int(any(r == region and s < e and s < end and e > begin for _, r, s, e in rows)))
        for h in range(hours):
            row = got[region, first + timedelta(hours=h)]
            assert row["is_alarm"] == series[h]
            seen = []
            for horizon in (1, 3, 6, 12):
                ahead = series[h + 1:h + 1 + horizon]
                assert row[f"alarm_next_{horizon}h"] == (max(ahead) if len(ahead) == horizon else None)
                seen.append(row[f"alarm_next_{horizon}h"])
            known = [s for s in seen if s is not None]
            assert known == sorted(known), "a longer horizon never loses an alarm"


def test_features_never_see_their_own_hour_or_day(spark):
    cells = spark.sql("SELECT 1 AS region_id, explode(sequence(TIMESTAMP'2024-01-02 00:00:00', TIMESTAMP'2024-01-03 23:00:00', INTERVAL 1 HOUR)) AS hour_ts")
    weather = cells.select("region_id", "hour_ts", F.col("hour_ts").alias("seen"))
    days = spark.sql("SELECT explode(sequence(DATE'2024-01-01', DATE'2024-01-03')) AS report_date").withColumn("day_seen", F.col("report_date"))
    out = grid.lagged_features(cells, weather, days, ["seen"], ["day_seen"]).collect()
    assert len(out) == 48
    for r in out:
        assert r["prev_seen"] is None or r["prev_seen"] == r["hour_ts"] - timedelta(hours=1)
        assert r["prev_day_seen"] == (r["hour_ts"] - timedelta(days=1)).date()


def test_start_flag_differs_from_overlap_flag(spark):
    alarms = spark.sql("SELECT 1L AS id, 1 AS region_id, TIMESTAMP'2024-01-01 10:30:00' AS start, TIMESTAMP'2024-01-01 12:10:00' AS end, 'Kyiv ' AS center_city_en")
    weather = spark.sql("SELECT 'kyiv, Ukraine' AS city_address, '2024-01-01' AS day_datetime, concat(h, ':00:00') AS hour_datetime FROM VALUES ('10'), ('11'), ('12'), ('xx') AS t(h)")
    flagged = weather_ops.alarm_start_flag(weather_ops.weather_keys(weather), weather_ops.alarm_keys(alarms))
    assert sorted((r["hour"], r["is_alarm"]) for r in flagged.collect()) == [(10, 1), (11, 0), (12, 0)]
    hours = grid.active_hours(alarms, "2024-01-01", "2024-01-02").select(F.hour("hour_ts").alias("h"))
    assert sorted(r["h"] for r in hours.collect()) == [10, 11, 12]


def test_rolling_mean_counts_present_months(spark):
    monthly = spark.createDataFrame([("2022-01", 1), ("2022-05", 2), ("2023-01", 6)], "year_month string, alarms long")
    got = [r["rolling_mean"] for r in alarm_ops.monthly_trend(monthly).orderBy("year_month").collect()]
    assert got == [None, None, 3.0]


def test_histogram_closes_its_last_bin(spark):
    daily = spark.createDataFrame([(i, i) for i in range(11)], "d int, alarms long")
    got = {r["bin"]: r["days"] for r in alarm_ops.daily_histogram(daily, 5).collect()}
    assert got == {0: 2, 1: 2, 2: 2, 3: 2, 4: 3}


def test_boxes_over_the_join_match_the_join(spark):
    rng = random.Random(1)
    alarms = spark.createDataFrame([(i, "a", rng.randint(0, 3)) for i in range(60)], "id int, join_city string, hour int").withColumn("day_date", F.lit("2024-01-01").cast("date"))
    weather = spark.createDataFrame([("a", rng.randint(0, 5), float(rng.randint(0, 9))) for _ in range(90)], "join_city string, hour int, hour_visibility double").withColumn("day_date", F.lit("2024-01-01").cast("date"))
    joined = weather_ops.alarms_with_weather(alarms, weather).toPandas()["hour_visibility"]
    box = {r["state"]: r for r in weather_ops.visibility_boxes(alarms, weather).collect()}
    assert box["during alarms"]["n"] == len(joined) and box["overall"]["n"] == 90
    assert box["during alarms"]["median"] == joined.median() and box["during alarms"]["q3"] == joined.quantile(0.75)


def test_asof_prefers_the_same_day(spark):
    day = lambda d: F.lit(f"2024-01-0{d}").cast("date")
    days = spark.range(4).select(F.date_add(day(1), F.col("id").cast("int")).alias("report_date"))
    found = spark.range(2).select(F.when(F.col("id") == 0, day(1)).otherwise(day(2)).alias("report_date"), F.col("id").cast("string").alias("url"))
    got = [(r["url"], r["age_days"]) for r in reports.latest_report_asof(days, found).orderBy("as_of").collect()]
    assert got == [("0", 0), ("1", 0), ("1", 1), (None, None)]


def test_asof_passes_over_rejected_reports(spark):
    rows = [("2024-01-01", "a", "ok"), ("2024-01-02", "b", "no_content"), ("2024-01-03", "c", "skipped"), ("2024-01-04", "d", None)]
    found = spark.createDataFrame(rows, "d string, url string, status string").withColumn("report_date", F.col("d").cast("date"))
    got = [(r["url"], r["age_days"]) for r in reports.latest_report_asof(found.select("report_date"), found).orderBy("as_of").collect()]
    assert got == [("a", 0), ("a", 1), ("c", 0), ("c", 1)]


def test_one_weather_row_per_hour(spark):
    rows = [("a", 1, 7, 5.0), ("a", 1, 3, None), ("a", 2, 9, 2.0), ("a", 1, 8, 1.0)]
    weather = spark.createDataFrame(rows, "join_city string, hour int, line_no int, hour_temp double").withColumn("day_date", F.lit("2024-01-01").cast("date"))
    got = sorted((r["hour"], r["line_no"], r["hour_temp"]) for r in weather_ops.one_per_hour(weather, "line_no").collect())
    assert got == [(1, 3, None), (2, 9, 2.0)]
    alarms = weather.select("join_city", "day_date", "hour", F.lit(1).alias("id")).distinct()
    assert weather_ops.alarms_with_weather(alarms, weather_ops.one_per_hour(weather, "line_no")).count() == 2


def test_nan_is_missing_in_correlations(spark):
    nan = float("nan")
    rows = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, 6.0), (nan, 100.0), (4.0, None)], "a double, b double")
    got = {(r["column_a"], r["column_b"]): r["corr"] for r in profile.correlation_matrix(rows, ["a", "b"]).collect()}
    assert got["a", "b"] == pytest.approx(1.0) and got["a", "a"] == pytest.approx(1.0)


def test_constant_column_has_no_correlation(spark):
    rows = spark.createDataFrame([(1.0, 1, None, 2.0), (2.0, 1, None, 1.0), (4.0, 1, 3.0, 0.0)], "a double, b int, c double, d double")
    got = {(r["column_a"], r["column_b"]): r["corr"] for r in profile.correlation_matrix(rows, ["a", "b", "c", "d"]).collect()}
    assert all(math.isnan(got[pair]) for pair in (("a", "b"), ("b", "a"), ("b", "b"), ("a", "c"), ("c", "c")))
    assert got["a", "a"] == pytest.approx(1.0) and got["a", "d"] == got["d", "a"] == pytest.approx(-3 / math.sqrt(28 / 3), abs=1e-12)
    empty = profile.correlation_matrix(rows.where("a > 9"), ["a", "b"]).collect()
    assert len(empty) == 4 and all(r["corr"] is None for r in empty)


def test_stats_of_a_day_with_odd_alarms(spark):
    rows = [(1, "2024-01-01 23:00:00", "2024-01-02 01:00:00"), (1, "2024-01-02 10:00:00", "2024-01-02 12:00:00"), (2, "2024-01-02 11:00:00", "2024-01-02 10:00:00"),
            (2, "2024-01-02 11:30:00", "2024-01-03 12:00:00"), (2, "2024-01-03 00:00:00", "2024-01-03 01:00:00"), (3, "2024-01-01 01:00:00", "2024-01-01 02:00:00")]
    alarms = spark.createDataFrame(rows, "region_id int, s string, e string").select("region_id", F.col("s").cast("timestamp").alias("start"), F.col("e").cast("timestamp").alias("end"))
    regions = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "region_id int, center_city_en string")
    levels = spark.createDataFrame([(2, 11, 0.6)], "region_id int, hour int, probability_1h double")
    got = serving.alarms_today_stats(alarms, regions, levels, "2024-01-02 11:45:00").first()
    assert (got["active_alarms_count"], got["total_alarms_today"], got["total_duration_today_hours"], got["most_threatened_region"]) == (2, 3, 15.5, "y")
    nothing = serving.alarms_today_stats(alarms.limit(0), regions, levels, "2024-01-02 11:45:00").first()
    assert (nothing["active_alarms_count"], nothing["total_alarms_today"], nothing["total_duration_today_hours"]) == (0, 0, 0)


def test_classify_report_order(spark):
    long_text = "assessment " + "x" * 300
    rows = [("2024-01-01", None, None), ("2024-01-02", "short", long_text), ("2024-01-03", "h" * 600, "tiny"), ("2024-01-04", "h" * 600, "x" * 300), ("2024-01-05", "h" * 600, long_text), ("2024-01-06", None, None)]
    df = spark.createDataFrame(rows, "d string, html string, text string").withColumn("report_date", F.col("d").cast("date"))
    existing = df.where("d = '2024-01-06'")
    got = [(r["status"], r["error_message"]) for r in reports.classify_report(df, existing).orderBy("d").collect()]
    assert got == [
        ("not_found", ""), ("no_content", "HTML only 5 bytes"), ("no_content", "Text 4 chars"),
        ("no_content", "Missing validation phrase — possibly blocked"), ("ok", ""), ("skipped", ""),
    ]
    forced = reports.classify_report(df, existing, force=True).where("d = '2024-01-06'").first()
    assert forced["status"] == "not_found"


def test_report_job_skips_present_dates(spark):
    page = "<html><body><article>" + "The assessment of the day. " * 40 + "</article></body></html>"
    captured = spark.createDataFrame([("2024-01-01", "u", page), ("2024-01-02", "u", page)], "d string, url string, html string").withColumn("report_date", F.col("d").cast("date"))
    done = jobs.report_job(captured, captured.where("d = '2024-01-01'")).orderBy("d").collect()
    assert [r["status"] for r in done] == ["skipped", "ok"]


def test_source_job(spark):
    page = "<article><p>[1] <a href='http://a.org/x#y'>one</a> <a href='https://www.isw.pub/z'>two</a></p></article>"
    pages = spark.createDataFrame([("2024-01-01", page)], "report_date string, html string")
    fetched = entries(spark, ("http://a.org/x", "A", "ok"))
    found, cache = jobs.source_job(pages, entries(spark), fetched)
    assert [(r["url"], r["title"]) for r in found.collect()] == [("http://a.org/x", "A")]
    assert [r["url"] for r in cache.collect()] == ["http://a.org/x"]


def test_valid_forecast_means_no_null_or_range_issue(spark):
    rng = random.Random(3)
    rows = []
    for document in range(30):
        bad = document % 2
        for _ in range(24):
            rows.append((str(document), *[rng.uniform(lo, hi) if rng.random() > 0.02 * bad else rng.choice([None, hi + 1]) for lo, hi in RANGES.values()]))
    hours = spark.createDataFrame(rows, "file string, " + ", ".join(f"{f} double" for f in RANGES)).withColumn("present", F.lit(True))
    valid = {r["file"] for r in quality.forecast_file_quality(hours, ["file"]).where("valid").collect()}
    as_text = hours.select(
        F.lit("c").alias("city"), F.lit("d").alias("date"), "file", F.lit(None).cast("string").alias("day_tempmax"), F.lit(None).cast("string").alias("day_tempmin"),
        F.lit("00:00:00").alias("hour_datetime"), *[F.col(f).cast("string").alias(f"hour_{f}") for f in RANGES])
    troubled = {r["file"] for r in quality.hour_level_issues(as_text).collect()}
    assert valid and not valid & troubled


def test_crosswalk_passes_unknown_names_through(spark):
    names = spark.createDataFrame([("Odessa Oblast",), ("Atlantis",)], "name string")
    got = {r["name"]: r["region"] for r in serving.region_crosswalk(names, serving.crosswalk(spark)).collect()}
    assert got == {"Odessa Oblast": "odesa", "Atlantis": "Atlantis"}
    cities = serving.region_crosswalk(spark.createDataFrame([("Crimea",), ("Lutsk",)], "name string"), serving.crosswalk(spark, REGION_LOCATIONS))
    assert {r["name"]: r["region"] for r in cities.collect()} == {"Crimea": "Simferopol, Ukraine", "Lutsk": "Lutsk"}


def test_overlapping_alarms_leave_the_sweep_once(spark):
    """Random intervals against every hour they touch; a crowd of equal alarms, gaps of days and clipping among them."""
    import datetime as dt
    import random

    pick = random.Random(12)
    base = dt.datetime(2024, 1, 1)
    rows = [(pick.randrange(3), base + dt.timedelta(seconds=pick.randrange(-90_000, 1_200_000)), pick.choice([0, 1, 1800, 3600, 7200, 90_000, 300_000]))
            for _ in range(120)] + [(3, base + dt.timedelta(hours=5), 3600 * 60)] * 1000 + [(4, base + dt.timedelta(days=40), 3600)]
    df = spark.createDataFrame([(r, s, s + dt.timedelta(seconds=n)) for r, s, n in rows], "region_id int, start timestamp, end timestamp").repartition(5)
    first, last = base + dt.timedelta(hours=3), base + dt.timedelta(days=12, hours=7)
    want = set()
    for r, s, n in rows:
        hour = s.replace(minute=0, second=0)
        while n and hour < s + dt.timedelta(seconds=n):
            if first <= hour < last:
                want.add((r, hour))
            hour += dt.timedelta(hours=1)
    got = [(r["region_id"], r["hour_ts"]) for r in grid.active_hours(df, str(first), str(last)).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_bad_dates_stay_off_the_grid(spark):
    rows = [(1, 1, "2024-01-01 05:30:00", "2024-01-01 06:10:00"), (2, 1, "2024-01-01 08:00:00", "9999-12-31 00:00:00"), (3, 1, "1900-01-01 00:00:00", "1900-01-01 01:00:00"),
            (4, 2, "2024-01-01 09:00:00", "2024-01-01 08:00:00"), (5, 2, None, "2024-01-01 08:00:00"), (6, 2, "9999-01-01 00:00:00", "9999-01-01 01:00:00")]
    alarms = spark.createDataFrame(rows, "id int, region_id int, start string, end string").withColumns(
        {c: F.col(c).cast("timestamp") for c in ("start", "end")})
    regions = spark.createDataFrame([(1,), (2,)], "region_id int")
    sound = grid.sound_intervals(alarms)
    flags = grid.region_hour_flags(sound, regions, *grid.alarm_range(sound))
    assert sorted((r["region_id"], r["hour_ts"].hour, r["is_alarm"]) for r in flags.collect()) == [(1, 5, 1), (1, 6, 1), (2, 5, 0), (2, 6, 0)]
    assert {r["id"]: r["reason"] for r in grid.rejected_intervals(alarms).collect()} == {
        2: "too long", 3: "too early", 4: "end before start", 5: "no start or end", 6: "too late"}
    assert {r["id"] for r in grid.rejected_intervals(alarms, latest="9999-12-31").collect()} == {2, 3, 4, 5}
