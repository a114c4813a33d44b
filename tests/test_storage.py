"""Versions with a commit point, line order over files, one JSON object read by many tasks."""

from __future__ import annotations

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regionhour import schemas
from regionhour.plans import jobs
from regionhour.sources import readers, versions, writers


def rows(spark, *values: int):
    return spark.createDataFrame([(v,) for v in values], "v int")


def test_readers_see_complete_versions_only(spark, folder):
    table = versions.VersionedTable(spark, f"{folder}/t")
    assert table.newest() is None and table.read(schema=rows(spark, 1).schema).count() == 0
    with pytest.raises(FileNotFoundError):
        table.read()
    assert table.write(rows(spark, 1, 2), notes={"upto": 7}) == 1
    # A writer that died: claimed, data there, no manifest.
    table._create("log/2.claim", "0")
    rows(spark, 9, 9, 9).write.parquet(f"{folder}/t/data/version=2")
    assert table.newest() == 1 and sorted(r["v"] for r in table.read().collect()) == [1, 2]
    assert table.next_version() == 3 and table.write(rows(spark, 3)) == 3
    assert [r["v"] for r in table.read().collect()] == [3] and table.read(1).count() == 2
    manifest = table.manifest(1)
    assert manifest.notes == {"upto": 7} and manifest.files >= 1 and manifest.bytes > 0
    with pytest.raises(FileNotFoundError):
        table.read(2)


def test_a_second_writer_of_a_version_is_refused(spark, folder):
    one, two = (versions.VersionedTable(spark, f"{folder}/t") for _ in range(2))
    assert one.next_version() == two.next_version() == 1
    one.write(rows(spark, 1), 1)
    with pytest.raises(versions.VersionTaken):
        two.write(rows(spark, 2), 1)
    assert [r["v"] for r in two.read().collect()] == [1]


def test_old_versions_go_by_age_and_number(spark, folder):
    table = versions.VersionedTable(spark, f"{folder}/t")
    for v in range(4):
        table.write(rows(spark, v))
    table._create("log/5.claim", "0")
    assert table.remove_old(keep=2, seconds=3600) == [] and table.versions() == [1, 2, 3, 4]
    assert table.remove_old(keep=2) == [1, 2] and table.versions() == [3, 4] and table.claims() == [3, 4, 5]
    table.write(rows(spark, 9))
    assert table.remove_old(keep=1, seconds=0) == [3, 4, 5] and [r["v"] for r in table.read().collect()] == [9]
    assert sorted(p.name for p in Path(folder, "t", "data").iterdir()) == ["version=6"]
    with pytest.raises(ValueError):
        table.remove_old(keep=0)


def test_first_line_goes_by_file_name_then_line(spark, folder):
    """Files of falling sizes: Spark packs the largest first, which is not the order of names."""
    sizes = {"a.csv": 3, "b.csv": 400, "c.csv": 4000}
    for name, n in sizes.items():
        lines = ["region_id,center_city_ua,center_city_en"] + [f"{k},{name},{'x' * 40}" for k in range(n)]
        Path(folder, name).write_text("\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        table = readers._read_csv(spark, folder, schemas.REGIONS, line_no=readers.file_order())
        assert table.rdd.getNumPartitions() > 4
        got = [(r["center_city_ua"], r["region_id"]) for r in table.orderBy("line_no").collect()]
        first = table.groupBy().agg(F.min(F.struct("line_no", "center_city_ua", "region_id")).alias("f")).first()["f"]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == [(name, k) for name, n in sizes.items() for k in range(n)]
    assert (first["center_city_ua"], first["region_id"]) == ("a.csv", 0)


def whole(spark, path: str):
    """The object read in one piece."""
    entries = F.from_json("value", T.MapType(T.StringType(), schemas.SOURCE_ENTRY))
    return spark.read.text(path, wholetext=True).select(F.explode(entries).alias("key", "entry"))


@pytest.mark.parametrize("indent", [None, 2])
def test_one_json_object_is_read_by_many_tasks(spark, folder, indent):
    odd = ['a "quoted" } brace', "{{{", "}}", "back\\slash\\", 'end \\" }', "é中}", "", "line\nbreak } \t", '\\\\"}{', "}"]
    cache = {f"http://h{k}.org/{odd[k % 10]}": {"url": f"http://h{k}.org/{odd[k % 10]}", "title": odd[(k * 7) % 10] + str(k), "status": "ok", "http_code": k}
             for k in range(20_000)}
    path = Path(folder, "cache.json")
    path.write_text(json.dumps(cache, indent=indent, ensure_ascii=indent is None), encoding="utf-8")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200000")
    try:
        assert spark.read.text(str(path), lineSep="}").rdd.getNumPartitions() > 8
        got = {r["key"]: tuple(r["entry"]) for r in readers.read_json_object(spark, str(path), schemas.SOURCE_ENTRY).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {r["key"]: tuple(r["entry"]) for r in whole(spark, str(path)).collect()} and len(got) == 20_000


@pytest.mark.parametrize("text", ["", "  ", "{", "{}", " {} \n", '{"a": {}', '{"a": {"url": "x"}} tail', '{"a": {"url": "x}}', '[{"a": {}}]', '{"a": {"url": "x"}}}', '{"a": {}} {"b": {}}',
                                  '{"a": {"url": "x"}}', '{"a": {"url": "x"}\n}', '{"a": {"url": "x"}, "b": {"url": "}{"}}\n\n', '{"a": null, "b": {"url": "y"}}'])
def test_odd_json_objects_read_as_in_one_piece(spark, folder, text):
    path = Path(folder, "cache.json")
    path.write_text(text)
    got = {(r["key"], r["entry"] and r["entry"]["url"]) for r in readers.read_json_object(spark, str(path), schemas.SOURCE_ENTRY).collect()}
    want = {(r["key"], r["entry"] and r["entry"]["url"]) for r in whole(spark, str(path)).collect()} if not text.endswith(("tail", "}}}", '{"b": {}}')) else set()
    assert got == want


def test_the_cache_goes_through_versions(spark, folder):
    cache = spark.createDataFrame([("http://a.org", "A", "ok", 200, None, None, None)], schemas.SOURCE_ENTRY)
    path = writers.write_cache(cache, f"{folder}/processed")
    assert readers.read_url_cache(spark, path).count() == 1
    writers.write_cache(cache.unionByName(cache.withColumn("url", F.lit("http://b.org"))), f"{folder}/processed")
    assert readers.read_url_cache(spark, path).count() == 2
    with pytest.raises(versions.VersionTaken):
        writers.write_cache(cache, f"{folder}/processed", 2)
    with pytest.raises(ValueError):
        writers.write_cache(cache, f"{folder}/raw")


def captured(spark, pages: dict[int, list[str]]):
    """Pages whose endnotes list the addresses."""
    html = {k: "<html><body><article><p>x</p><h3>Endnotes</h3><ol>" + "".join(f'<li><a href="{u}">[{i}] s</a></li>' for i, u in enumerate(v)) + "</ol></article></body></html>"
            for k, v in pages.items()}
    return spark.createDataFrame(list(html.items()), "page_id long, html string")


LOG = "page_id long, attempt int, url string, http_code int, content_type string, content_length long, failure string, failure_detail string, final_url string, content binary, charset string"


def test_the_link_job_goes_on_where_it_stopped(spark, folder):
    title = "<html><title>Žluť é</title></html>"
    log = spark.createDataFrame([
        (1, 1, "http://a.org/x", 503, "text/html", None, None, None, None, b"", None), (1, 2, "http://a.org/x", 200, "text/html", None, None, None, "http://a.org/y", title.encode("utf-16"), "UTF-16"),
        (1, 1, "http://b.org/x", 200, "text/html", None, None, None, None, "<title>caf\xe9</title>".encode("latin-1"), "iso-8859-1"),
        (1, 1, "http://c.org/x", None, None, None, "timeout", "slow", None, None, None)], LOG)
    zone = f"{folder}/processed"
    one = captured(spark, {1: ["http://a.org/x", "http://b.org/x"], 2: ["http://c.org/x"]})
    assert jobs.source_run(spark, zone, one, log, "page_id") == 1
    assert jobs.source_run(spark, zone, one, log, "page_id") is None, "nothing new: nothing is written"
    both = captured(spark, {1: ["http://changed.org/"], 2: ["http://c.org/x"], 3: ["http://a.org/x", "http://new.org/x"]})
    assert jobs.source_run(spark, zone, both, log.limit(0), "page_id") == 2

    def entries() -> list[tuple]:
        rows = jobs.source_entries(spark, zone, one.schema["page_id"]).collect()
        return sorted((r["page_id"], r["url"], r["title"], r["status"], r["origin"], r["run"]) for r in rows)

    assert entries() == [
        (1, "http://a.org/x", "Žluť é", "ok", "fetch", 1), (1, "http://b.org/x", "café", "ok", "fetch", 1), (2, "http://c.org/x", "[TIMEOUT]", "timeout", "fetch", 1),
        (3, "http://a.org/x", "Žluť é", "ok", "cache", 2), (3, "http://new.org/x", "[UNRESOLVED]", "unresolved", "none", 2)]
    assert jobs.source_run(spark, zone, both.where("page_id = 1"), log, "page_id", force=True) == 3
    assert [e for e in entries() if e[0] == 1] == [(1, "http://changed.org", "[UNRESOLVED]", "unresolved", "none", 3)]
    cache = readers.read_url_cache(spark, f"{zone}/url_cache")
    assert {r["url"] for r in cache.collect()} == {"http://a.org/x", "http://b.org/x", "http://c.org/x", "http://new.org/x", "http://changed.org"}


def test_stored_tables_are_read_by_partition(spark, folder):
    days = [f"2024-01-{d:02d}" for d in range(1, 31)]
    reports = spark.createDataFrame([(d, "u", "ok", 1, "t") for d in days for _ in range(3)], "date string, url string, status string, char_count int, text string")
    path = writers.write_reports(reports, f"{folder}/processed")
    table = readers.read_stored_reports(spark, path)
    some = table.where(F.col("date").between("2024-01-05", "2024-01-06"))
    assert some.count() == 6
    scan = next(line for line in some._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")).splitlines() if "PartitionFilters" in line)
    assert "2024-01-05" in scan
    read = {f for r in some.select(F.input_file_name().alias("f")).distinct().collect() for f in [r["f"]]}
    assert all("date=2024-01-05" in f or "date=2024-01-06" in f for f in read) and len(read) <= 2 * writers.SPREAD


def test_many_small_days_use_all_tasks_to_write_and_few_to_list(spark, folder):
    reports = spark.range(100).select(
        F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")), "yyyy-MM-dd").alias("date"),
        F.lit("u").alias("url"), F.lit("ok").alias("status"), F.col("id").cast("int").alias("char_count"), F.lit("t").alias("text"))
    path = writers.write_reports(reports, f"{folder}/processed")
    assert len({file.name[:10] for file in Path(path).rglob("part-*.json")}) > 1, "bytes are few, folders are not"
    spark.sparkContext.setJobGroup(folder, "listing")
    try:
        table = readers.read_stored_reports(spark, path)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tracker = spark.sparkContext.statusTracker()
    stages = [s for job in tracker.getJobIdsForGroup(folder) for s in tracker.getJobInfo(job).stageIds]
    assert stages and all(tracker.getStageInfo(s).numTasks < 100 for s in stages)
    assert {(r["date"], r["char_count"]) for r in table.collect()} == {(r["date"], r["char_count"]) for r in reports.collect()}


REPORT = "date string, url string, status string, char_count int, text string"


def report_rows(spark, path: str) -> list[tuple]:
    return sorted((tuple(r) for r in readers.read_stored_reports(spark, path).select(*schemas.REPORT.names).collect()), key=str)


def test_folders_do_not_follow_the_days_of_a_write(spark, folder):
    days = spark.range(1_200).select(
        F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")), "yyyy-MM-dd").alias("date"),
        F.lit("u").alias("url"), F.lit("ok").alias("status"), F.col("id").cast("int").alias("char_count"), F.lit("t").alias("text"))
    path = writers.write_reports(days, f"{folder}/processed")
    held = [p for p in Path(path).rglob("*") if p.is_dir()]
    assert len(held) < 200 and len(list(Path(path).rglob("part-*"))) < 600
    assert report_rows(spark, path) == sorted((tuple(r) for r in days.collect()), key=str)
    some = readers.read_stored_reports(spark, path).where(F.col("date").between("2024-01-05", "2024-01-06"))
    assert sorted(r["date"] for r in some.collect()) == ["2024-01-05", "2024-01-06"]


def test_a_grouped_table_is_written_and_read_like_folders(spark, folder, monkeypatch):
    """The same writes with and without groups: days replaced, kept and new; odd and empty keys, several rows of a day, repeated rows."""
    def write(zone: str, *rows: tuple) -> str:
        return writers.write_reports(spark.createDataFrame(list(rows), REPORT), f"{folder}/{zone}")

    first = [("d1", "u", "ok", 1, "a"), ("d2", "u", "ok", 2, 'q " } { \\ \n'), (None, "u", None, None, None), ("x=/ %y}", "u", "ok", 4, "é中"), ("d2", "u", "ok", 2, "b"), ("d2", "u", "ok", 2, "b")]
    many = [(f"m{i}", "u", "ok", i, None) for i in range(8)] + [("d1", "v", "ok", 9, "new"), ("x=/ %y}", "v", "ok", 9, "new")]
    few = [("m3", "w", "ok", 30, "one"), ("m3", "w", "ok", 31, "two"), ("d2", "w", "ok", 32, "gone over"), ("", "w", "ok", 33, "no day"), ("n1", None, None, None, None)]
    for write_nr, rows in enumerate((first, many, few)):
        plain = write("plain", *rows)
        monkeypatch.setattr(writers, "FOLDERS", 6)
        grouped = write("grouped", *rows)
        monkeypatch.undo()
        assert any("=" in p.name for p in Path(grouped).iterdir()) == (write_nr == 0), "folders by day go when groups come"
        assert report_rows(spark, grouped) == report_rows(spark, plain)
        assert readers.read_stored_reports(spark, grouped).schema == readers.read_stored_reports(spark, plain).schema


def test_other_stored_tables_in_groups(spark, folder, monkeypatch):
    hour = "array<struct<hour_datetime string, hour_temp string>>"
    days = spark.createDataFrame([(c, f"2024-01-0{d}", {"city": c, "day_tempmax": str(d)}, [{"hour_datetime": "00:00:00", "hour_temp": "1"}] * d) for c in ("Bila Tserkva", "Lviv") for d in (1, 2)],
                                 f"city string, date string, daily struct<city string, day_tempmax string>, hours {hour}")
    forecasts = spark.createDataFrame([(f"r{k}", f"2024-01-0{d}_00", f"2024-01-0{d}_00", [{"datetime": "00:00:00", "temp": k + 0.1, "conditions": None}]) for k in (1, 2) for d in (1, 2)],
                                      "region string, request_hour string, request_timestamp string, forecast array<struct<datetime string, temp double, conditions string>>")
    entry = "array<struct<url string, title string, status string, http_code int, content_type string, final_url string, error_detail string>>"
    sources = spark.createDataFrame([(f"p{k}", f"p{k}.html", k, [("http://a.org", "A", "ok", 0, "", "http://a.org", None)] * k) for k in range(3)],
                                    f"report_date string, html_file string, sources_count int, sources {entry}")
    cases = [(writers.write_weather_days, readers.read_stored_weather_days, days), (writers.write_forecasts, readers.read_stored_forecasts, forecasts),
             (writers.write_report_sources, readers.read_stored_sources, sources)]
    for write, read, table in cases:
        plain = write(table, f"{folder}/plain")
        monkeypatch.setattr(writers, "FOLDERS", 0)
        grouped = write(table, f"{folder}/grouped")
        monkeypatch.undo()
        assert Path(grouped, writers.GROUPED).is_dir() and not Path(plain, writers.GROUPED).exists()
        one, two = read(spark, plain), read(spark, grouped)
        assert one.schema == two.schema and sorted(map(str, one.collect())) == sorted(map(str, two.collect())) and one.count() > 2
