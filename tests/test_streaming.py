"""Streaming jobs over landed files, run to their end."""

from __future__ import annotations

import json
import os
from pathlib import Path

from pyspark.sql import functions as F

from regionhour.operators.serving import first_alert_per_region
from regionhour.sources.readers import read_alert_snapshots
from regionhour.streaming import alerts


def land(folder: str, name: str, entries: list, order: int) -> None:
    path = Path(folder, "landed", name)
    path.parent.mkdir(exist_ok=True)
    path.write_text(json.dumps({"alerts": [dict(zip(("location_oblast", "alert_type", "started_at"), e)) for e in entries]}))
    os.utime(path, (1_700_000_000 + order, 1_700_000_000 + order))


def drain(writer) -> None:
    writer.trigger(availableNow=True).start().awaitTermination()


def test_first_alert_of_each_region(spark, folder):
    land(folder, "1.json", [("A", "drone", "2024-01-01T10:00:00Z"), ("A", "missile", "x"), ("B", None, "10:00"), (None, "x", "y")], 1)
    events = alerts.alert_events(read_alert_snapshots(spark, f"{folder}/landed"))
    rows = {r["location_oblast"]: (r["type"], r["since"]) for r in first_alert_per_region(events, "file").collect()}
    assert rows == {"A": ("drone", "10:00"), "B": ("unknown", "10:00")}


def test_repeated_alerts_are_kept_once(spark, folder):
    alert = ("A", "drone", "2024-01-01T10:00:00")
    land(folder, "1.json", [alert], 1)
    land(folder, "2.json", [alert, ("A", "drone", "2024-01-01T10:20:00")], 2)
    events = alerts.alert_events(read_alert_snapshots(spark, f"{folder}/landed", streaming=True))
    once = alerts.deduplicate_alerts(events).select("location_oblast", "started_at")
    drain(alerts.write_table(once, f"{folder}/out", f"{folder}/state"))
    assert sorted(r["started_at"] for r in spark.read.parquet(f"{folder}/out").collect()) == ["2024-01-01T10:00:00", "2024-01-01T10:20:00"]


def hourly(spark, folder, mode: str) -> list[tuple]:
    events = alerts.alert_events(read_alert_snapshots(spark, f"{folder}/landed", streaming=True))
    counts = alerts.hourly_counts(events, "location_oblast", alerts.EVENT_TIME, "30 minutes")
    keys = ["hour_ts", "location_oblast"]
    if mode == "append":
        drain(alerts.write_table(counts, f"{folder}/append", f"{folder}/append_state"))
        table = spark.read.parquet(f"{folder}/append")
    else:
        drain(alerts.write_updates(counts, f"{folder}/update", f"{folder}/update_state", keys))
        table = alerts.read_updates(spark, f"{folder}/update", keys, counts.schema)
    rows = table.select(F.date_format("hour_ts", "HH:mm").alias("h"), "location_oblast", "alarms")
    return sorted(tuple(r) for r in rows.collect())


def test_updated_counts_equal_a_batch(spark, folder):
    land(folder, "1.json", [("A", "d", "2024-01-01T10:05:00"), ("A", "d", "2024-01-01T10:55:00"), ("B", "d", "2024-01-01T10:10:00")], 1)
    land(folder, "2.json", [("A", "d", "2024-01-01T12:05:00")], 2)
    assert hourly(spark, folder, "update") == [("10:00", "A", 2), ("10:00", "B", 1), ("12:00", "A", 1)]
    land(folder, "3.json", [("A", "d", "2024-01-01T12:25:00")], 3)
    assert hourly(spark, folder, "update") == [("10:00", "A", 2), ("10:00", "B", 1), ("12:00", "A", 2)]


def test_append_drops_what_is_later_than_the_watermark(spark, folder):
    land(folder, "1.json", [("A", "d", "2024-01-01T10:05:00")], 1)
    hourly(spark, folder, "append")
    land(folder, "2.json", [("A", "d", "2024-01-01T13:00:00")], 2)
    hourly(spark, folder, "append")
    land(folder, "3.json", [("A", "d", "2024-01-01T10:30:00"), ("A", "d", "2024-01-01T15:00:00")], 3)
    assert hourly(spark, folder, "append") == [("10:00", "A", 1), ("13:00", "A", 1)]


def test_newest_snapshot_is_the_active_set(spark, folder):
    land(folder, "1.json", [("A", "drone", "2024-01-01T10:00:00Z"), ("B", "missile", "2024-01-01T10:00:00Z")], 1)
    land(folder, "2.json", [("B", "missile", "2024-01-01T10:00:00Z")], 2)

    def run() -> list[str]:
        stream = read_alert_snapshots(spark, f"{folder}/landed", streaming=True)
        drain(alerts.write_active_regions(stream, f"{folder}/active", f"{folder}/active_state"))
        return [r["location_oblast"] for r in alerts.read_active_regions(spark, f"{folder}/active").collect()]

    def spoil(name: str, content: str, order: int) -> None:
        path = Path(folder, "landed", name)
        path.write_text(content)
        os.utime(path, (1_700_000_000 + order, 1_700_000_000 + order))

    assert run() == ["B"]
    assert run() == ["B"]
    land(folder, "3.json", [], 3)
    assert run() == []
    land(folder, "4.json", [("C", "drone", "2024-01-01T10:00:00Z")], 0)
    assert run() == [], "a file that landed earlier changes nothing"
    spoil("5.json", '{"error": "no answer"}', 5)
    spoil("6.json", '{"alerts": [{"loc', 6)
    assert run() == []
    land(folder, "7.json", [("A", "drone", "2024-01-01T10:00:00Z")], 7)
    assert run() == ["A"]
    spoil("8.json", '{"error": "no answer"}', 8)
    assert run() == ["A"], "an error answer says nothing about the state"


def test_late_first_sightings_are_kept(spark, folder):
    land(folder, "1.json", [("A", "drone", "2024-01-01T10:00:00")], 1)

    def run() -> list[str]:
        events = alerts.alert_events(read_alert_snapshots(spark, f"{folder}/landed", streaming=True))
        once = alerts.deduplicate_alerts(events).select("location_oblast", "started_at")
        drain(alerts.write_table(once, f"{folder}/out", f"{folder}/state"))
        return sorted(r["location_oblast"] for r in spark.read.parquet(f"{folder}/out").collect())

    assert run() == ["A"]
    land(folder, "2.json", [("B", "drone", "2024-01-01T08:00:00"), ("A", "drone", "2024-01-01T10:00:00")], 2)
    assert run() == ["A", "B"]


def test_many_batches_leave_few_files(spark, folder):
    """Fifty batches in update mode: folders are bounded, rows equal those of one batch, repeated batches change nothing."""
    for k in range(50):
        Path(folder, "landed").mkdir(exist_ok=True)
        path = Path(folder, "landed", f"{k:02d}.json")
        path.write_text("\n".join(json.dumps({"region": f"r{(k * i) % 5}", "ts": f"2024-01-01 {(k + i) % 24:02d}:10:00"}) for i in range(4)))
        os.utime(path, (1_700_000_000 + k, 1_700_000_000 + k))
    schema = "region string, ts timestamp"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"{folder}/landed")
    counts = alerts.hourly_counts(stream, "region", "ts", "2 days")
    drain(alerts.write_updates(counts, f"{folder}/out", f"{folder}/state", ["hour_ts", "region"], every=6))
    whole = alerts.hourly_counts(spark.read.schema(schema).json(f"{folder}/landed"), "region", "ts")

    def stored() -> list[tuple]:
        return sorted(map(tuple, alerts.read_updates(spark, f"{folder}/out", ["hour_ts", "region"], counts.schema).collect()))

    assert stored() == sorted(map(tuple, whole.collect()))
    batches, data = Path(folder, "out", "batches"), Path(folder, "out", "data")
    assert len(list(batches.iterdir())) <= 12 and len(list(data.iterdir())) == 2
    # The driver died before it noted the last batches as done: they come again.
    commits = sorted(Path(folder, "state", "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    for late in commits[-1:]:
        late.unlink()
        Path(late.parent, f".{late.name}.crc").unlink()
    drain(alerts.write_updates(counts, f"{folder}/out", f"{folder}/state", ["hour_ts", "region"], every=6))
    assert stored() == sorted(map(tuple, whole.collect()))
