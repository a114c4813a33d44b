"""Readers and writers on small files."""

from __future__ import annotations

import json
from pathlib import Path

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from regionhour.constants import DAILY_FIELDS, HOURLY_FIELDS
from regionhour.operators import links, quality, weather
from regionhour.plans import jobs
from regionhour.sources import readers, writers


def put(path: Path, content) -> Path:
    path.parent.mkdir(parents=True, exist_ok=True)
    if isinstance(content, bytes):
        path.write_bytes(content)
    else:
        path.write_text(content if isinstance(content, str) else json.dumps(content), encoding="utf-8")
    return path


def test_read_alarms_and_regions(spark, folder):
    put(Path(folder, "a.csv"), "id;region_id;region_city;all_region;start;end\n7;3;Kyiv, city;1;2024-01-01 10:00:00;2024-01-01 11:30:00\n")
    put(Path(folder, "r.csv"), "region_id,center_city_ua,center_city_en\n3,Київ,Kyiv\n")
    row = readers.read_alarms(spark, f"{folder}/a.csv").first()
    assert (row["id"], row["region_city"], str(row["end"])) == (7, "Kyiv, city", "2024-01-01 11:30:00")
    assert readers.read_regions(spark, f"{folder}/r.csv").first()["center_city_ua"] == "Київ"


WEATHER_HEADER = ["city_address", "city_latitude", "city_longitude", *HOURLY_FIELDS, *DAILY_FIELDS]


def weather_line(**values: str) -> str:
    return ",".join(f'"{values[c]}"' if c in values else "" for c in WEATHER_HEADER)


def weather_csv(folder: str) -> str:
    lines = [",".join(WEATHER_HEADER)]
    for hour in (1, 0):
        lines.append(weather_line(
            city_address="Bila Tserkva, Ukraine", city_latitude="49.8", city_longitude="30.1", day_datetime="2024-01-01",
            hour_datetime=f"{hour:02d}:00:00", hour_temp=str(hour), day_tempmax=str(10 + hour), day_tempmin="-5",
            hour_humidity="50", hour_windspeed="5", hour_pressure="1000", hour_cloudcover="1",
        ))
    lines.append(weather_line(city_address="Bila Tserkva, Ukraine", day_datetime="2024-01-01", hour_temp="3"))
    lines.append(weather_line(city_address="Lviv, Ukraine", hour_datetime="01:00:00"))
    lines.append(weather_line(city_address="", day_datetime="2024-01-01"))
    return str(put(Path(folder, "w.csv"), "\n".join(lines) + "\n"))


def test_weather_csv_to_days_and_back(spark, folder):
    rows = quality.weather_rows(readers.read_weather_csv(spark, weather_csv(folder)))
    days = quality.weather_day_table(rows)
    nested = quality.nest_weather_days(rows, days).cache()
    day = nested.first()
    assert nested.count() == 1 and day["city"] == "Bila Tserkva"
    assert day["daily"]["day_tempmax"] == "11", "daily fields come from the first line"
    assert [h["hour_datetime"] for h in day["hours"]] == ["00:00:00", "01:00:00"]

    path = writers.write_weather_days(nested, f"{folder}/processed")
    assert [p.name for p in Path(path).iterdir() if p.is_dir()] == ["city=Bila_Tserkva"]
    back = readers.read_stored_weather_days(spark, path).collect()
    assert [(r["city"], r["date"], r["readable"], r["daily"]["city"], len(r["hours"])) for r in back] == [
        ("Bila_Tserkva", "2024-01-01", True, "Bila Tserkva", 2)]


def test_issues_are_counted_as_they_are_listed(spark, folder):
    """Counts from conditions against listed issues: bounds, unreadable and NaN values, odd coordinates, a clean city, no rows."""
    good = dict(city_latitude="49.8", city_longitude="30.1", day_datetime="2024-01-01", day_tempmax="10", day_tempmin="-5",
                hour_humidity="50", hour_windspeed="5", hour_pressure="1000", hour_cloudcover="1")
    hours = [dict(good, hour_datetime=f"{h:02d}:00:00", hour_temp="1") for h in range(24)]
    odd = [dict(good, hour_datetime="00:00:00", hour_temp=t, hour_pressure=p) for t, p in (("10.6", "1000"), ("-5.6", ""), ("nan", "bad"), ("", "1"), ("60", "2000"))]
    lines = [",".join(WEATHER_HEADER), *[weather_line(city_address="Clean, Ukraine", **h) for h in hours],
             *[weather_line(city_address="Odd, Ukraine", **h) for h in odd],
             weather_line(city_address="Far, Ukraine", **(hours[0] | {"city_latitude": "60", "city_longitude": "-1", "hour_datetime": ""}))]
    wide = readers.read_weather_csv(spark, str(put(Path(folder, "w.csv"), "\n".join(lines) + "\n")))
    for strict in (False, True):
        listed = {r["city"]: r["count"] for r in jobs.weather_issues(wide, strict).groupBy("city").count().collect()}
        counted = {r["city"]: r["issues"] for r in jobs.weather_issue_counts(wide, strict).collect()}
        assert counted == {"Clean": 0, **listed} and set(listed) == {"Odd", "Far"} and listed["Far"] == 3
        status = {r["city"]: (r["issues"], r["errors"], r["clean"]) for r in jobs.weather_quality_job(wide, strict)[0].collect()}
        assert status == {c: (n, n, n == 0) for c, n in counted.items()}
    assert jobs.weather_issue_counts(wide.limit(0)).count() == 0


def test_several_documents_of_a_partition_come_back(spark, folder):
    texts = [("2024-01-01", "u", "ok", i, "t" * i) for i in range(40)]
    reports = spark.createDataFrame(texts, "date string, url string, status string, char_count int, text string")
    path = writers.write_reports(reports, f"{folder}/processed")
    assert sorted(r["char_count"] for r in readers.read_stored_reports(spark, path).collect()) == list(range(40))


def test_csv_columns_go_by_name(spark, folder):
    put(Path(folder, "a.csv"), "region_id;id;note;region_city;all_region;end;start\n3;7;x;Kyiv;1;2024-01-01 11:30:00;bad\n")
    row = readers.read_alarms(spark, f"{folder}/a.csv").first()
    assert (row["id"], row["region_id"], row["region_city"], row["start"]) == (7, 3, "Kyiv", None)
    put(Path(folder, "r.csv"), "area,center_city_en,region_id,center_city_ua\n9,Kyiv,3,Київ\n")
    assert tuple(readers.read_regions(spark, f"{folder}/r.csv").first()) == (3, "Київ", "Kyiv")
    names = list(reversed(WEATHER_HEADER))
    put(Path(folder, "w.csv"), ",".join([*names, "more"]) + "\n" + ",".join([*names, "more"]).upper() + "\n")
    row = readers.read_weather_csv(spark, f"{folder}/w.csv").first()
    assert all(row[c] == c.upper() for c in WEATHER_HEADER)
    put(Path(folder, "short.csv"), "region_id,center_city_en\n3,Kyiv\n")
    with pytest.raises(ValueError, match="center_city_ua"):
        readers.read_regions(spark, f"{folder}/short.csv")


def test_missing_weather_file_is_an_error(spark, folder):
    with pytest.raises(AnalysisException):
        readers.read_weather_csv(spark, f"{folder}/none.csv")


def test_read_forecasts_and_quality(spark, folder):
    hour = {"datetime": "00:00:00", "temp": 1.0, "humidity": 100.0, "windspeed": 0.0, "visibility": 50.0, "cloudcover": 0.0, "pressure": 870.0}
    put(Path(folder, "ok.json"), {"region": "r", "request_timestamp": "t", "forecast": [hour] * 24})
    put(Path(folder, "short.json"), {"region": "r", "forecast": [{**hour, "temp": None, "humidity": 101.0}] * 2})
    put(Path(folder, "empty.json"), {"region": "r", "forecast": []})
    put(Path(folder, "notes.txt"), "no")
    hours = quality.forecast_hours(readers.read_forecasts(spark, folder), ["file"])
    found = {r["file"]: tuple(r)[1:] for r in quality.forecast_file_quality(hours, ["file"]).collect()}
    assert found == {
        "ok.json": (24, 0, 0, False, True), "short.json": (2, 2, 2, True, False), "empty.json": (0, 0, 0, True, False),
    }
    document = quality.forecast_document_quality(readers.read_forecasts(spark, folder), ["file"])
    assert {r["file"]: tuple(r)[1:] for r in document.collect()} == found
    summary = quality.forecast_quality_summary(quality.forecast_file_quality(hours, ["file"])).first()
    assert tuple(summary) == (1, 3)


def test_forecast_api_keeps_hours_after_midnight(spark, folder):
    answer = {"days": [{"hours": [{"datetime": "23:00:00", "temp": 1, "extra": 5}]}, {"hours": [{"datetime": "00:00:00"}]}]}
    put(Path(folder, "2024-01-01_22_Ivano-Frankivsk_Oblast.json"), answer)
    raw = readers.read_forecast_api(spark, folder)
    flat = weather.flatten_forecast(raw)
    assert [r["datetime"] for r in flat.collect()] == ["23:00:00", "00:00:00"]
    assert weather.flatten_forecast(raw, first_day_only=True).count() == 1
    path = writers.write_forecasts(weather.forecast_documents(flat), f"{folder}/processed")
    [back] = readers.read_stored_forecasts(spark, path).collect()
    assert (back["region"], back["request_timestamp"]) == ("Ivano-Frankivsk_Oblast", "2024-01-01_22")
    assert [h["datetime"] for h in back["forecast"]] == ["23:00:00", "00:00:00"]


def test_read_weather_days(spark, folder):
    hours = [{"hour_datetime": f"{h:02d}:00:00", "hour_temp": "1"} for h in range(24)]
    put(Path(folder, "Bila_Tserkva/2024-01-01.json"), {"daily": {"latitude": "50"}, "hours": hours})
    put(Path(folder, "Bila_Tserkva/2024-01-03.json"), "{broken")
    put(Path(folder, "Bila_Tserkva/summary.json"), {"daily": {}})
    put(Path(folder, "deep/er/Lviv/2024-01-01.json"), {"daily": {"latitude": "10"}, "hours": []})
    documents = readers.read_weather_days(spark, folder).cache()
    found = {(r["city"], r["date"]): r["readable"] for r in documents.collect()}
    assert found == {("Bila_Tserkva", "2024-01-01"): True, ("Bila_Tserkva", "2024-01-03"): False, ("Lviv", "2024-01-01"): True}
    coverage = {r["city"]: (r["days"], r["expected"]) for r in quality.city_coverage(documents, F.col("day_date")).collect()}
    assert coverage == {"Bila_Tserkva": (2, 3), "Lviv": (1, 1)}
    days, hour_rows = quality.split_day_documents(documents.where("readable"))
    messages = [(r["city"], r["message"]) for r in quality.weather_day_issues(days, hour_rows).where("category <> 'NULL'").collect()]
    assert sorted(messages) == [("Lviv", "Expected 24h, found 0h"), ("Lviv", "Lat 10.0 outside Ukraine")]


def test_read_report_html(spark, folder):
    put(Path(folder, "2024-01-01.html"), "<p>žluť</p>".encode())
    put(Path(folder, "2024-01-02.html"), "<p>caf\xe9</p>".encode("latin-1"))
    put(Path(folder, "index.html"), "x")
    found = {str(r["report_date"]): (r["html_file"], r["html"]) for r in readers.read_report_html(spark, folder).collect()}
    assert found == {"2024-01-01": ("2024-01-01.html", "<p>žluť</p>"), "2024-01-02": ("2024-01-02.html", "<p>café</p>")}


def test_decode_body(spark):
    rows = [("é".encode(), None), ("é".encode("latin-1"), "iso-8859-1"), ("é".encode("utf-16-le"), "UTF-16LE"), (b"a\xff", "x-none")]
    df = spark.createDataFrame(rows, "content binary, declared string")
    got = [r["t"] for r in df.select(readers.decode_body(F.col("content"), F.col("declared")).alias("t")).collect()]
    assert got == ["é", "é", "é", "a�"]


def test_source_documents_round_trip(spark, folder):
    rows = [
        ("2024-01-01", 1, "http://b.org", "B", "ok", 200, "text/html", "http://b.org", None),
        ("2024-01-01", 0, "http://a.org", "[DEAD LINK]", "dead_link", 404, None, "http://z.org", None),
        ("2024-01-02", 0, "http://c.org", "[TIMEOUT]", "timeout", None, None, None, "Timeout after 15s"),
    ]
    entries = spark.createDataFrame(
        rows, "report_date string, pos long, url string, title string, status string, http_code int, content_type string, final_url string, error_detail string")
    reports = spark.createDataFrame([(f"2024-01-0{d}", f"2024-01-0{d}.html") for d in (1, 2, 3)], "report_date string, html_file string")
    path = writers.write_report_sources(links.report_sources(reports, entries, "report_date"), f"{folder}/processed")
    text = "".join(p.read_text() for p in Path(path).rglob("*.json"))
    assert text.count("final_url") == 1 and "null" not in text and text.count('"sources":[]') == 1

    stored = readers.read_stored_sources(spark, path).orderBy("report_date", "pos").collect()
    assert [(r["report_date"], r["html_file"], r["pos"], r["url"]) for r in stored] == [
        ("2024-01-01", "2024-01-01.html", 0, "http://a.org"), ("2024-01-01", "2024-01-01.html", 1, "http://b.org"),
        ("2024-01-02", "2024-01-02.html", 0, "http://c.org")]

    for day in Path(path).iterdir():
        if day.is_dir():
            [part] = day.glob("*.json")
            put(Path(folder, "documents", day.name[12:] + ".json"), {"report_date": day.name[12:], **json.loads(part.read_text())})
    put(Path(folder, "documents", "broken.json"), "{")
    back = readers.read_source_json(spark, f"{folder}/documents")
    assert [(r["report_date"], r["url"]) for r in back.orderBy("report_date", "pos").collect()] == [
        ("2024-01-01", "http://a.org"), ("2024-01-01", "http://b.org"), ("2024-01-02", "http://c.org")]


def test_url_cache(spark, folder):
    assert readers.read_url_cache(spark, f"{folder}/none.json").count() == 0
    put(Path(folder, "bad.json"), "{nope")
    assert readers.read_url_cache(spark, f"{folder}/bad.json").count() == 0
    put(Path(folder, "cache.json"), {"http://a.org": {"url": "http://a.org", "title": "A", "status": "ok", "http_code": 200}})
    cache = readers.read_url_cache(spark, f"{folder}/cache.json")
    assert [tuple(r)[:4] for r in cache.collect()] == [("http://a.org", "A", "ok", 200)]
    path = writers.write_cache(cache, f"{folder}/processed", 2)
    assert readers.read_url_cache(spark, path).count() == 1


def test_reports_replace_only_their_dates(spark, folder):
    def day(date: str, text: str):
        return spark.createDataFrame([(date, "u", "ok", len(text), text)], "date string, url string, status string, char_count int, text string")

    writers.write_reports(day("2024-01-01", "old").unionByName(day("2024-01-02", "kept")), f"{folder}/processed")
    path = writers.write_reports(day("2024-01-01", "new"), f"{folder}/processed")
    assert sorted(r["text"] for r in spark.read.json(path).collect()) == ["kept", "new"]
    with pytest.raises(ValueError):
        writers.write_reports(day("2024-01-01", "x"), f"{folder}/raw")
