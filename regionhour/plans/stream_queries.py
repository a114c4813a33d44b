"""Registered streams: tables replayed as they would have landed, in rounds, and what the streams left behind."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from regionhour import schemas
from regionhour.plans.alarm_queries import stamp
from regionhour.plans.lenses import Lenses, with_views
from regionhour.session import shared_dir, stored
from regionhour.streaming import alerts as streams

ROUNDS = ["2024-01-11", "2024-01-21", "2100-01-01"]  # a round lands the snapshots before its end
LONGEST_SEEN = "60 days"


def new_folder(v: Lenses, name: str) -> str:
    return f"{shared_dir(v.spark)}/{name}/{uuid.uuid4().hex}"


def snapshots(v: Lenses) -> DataFrame:
    """One row per clock hour: the alerts then on show, in the order of their ids.

    An alert is on show in the snapshot of its first hour and up to three more; some are first seen 30 hours after they began.
    """
    first = F.date_trunc("hour", "start") + F.make_dt_interval(F.lit(0), F.when(F.col("id") % 29 == 0, 30).otherwise(0))
    shown = F.explode(F.sequence(F.lit(0), (F.col("id") % 4).cast("int")))
    started = F.when(F.col("id") % 43 == 0, "2024-01-01").otherwise(F.date_format("start", "yyyy-MM-dd'T'HH:mm:ss"))
    alert = F.struct("id", F.struct(
        F.when(F.col("id") % 41 != 0, F.col("region_city")).alias("location_oblast"),
        F.when(F.col("alert_type") != "view", F.col("alert_type")).alias("alert_type"), started.alias("started_at")).alias("alert"))
    seen = v.alarms.select(first.alias("first"), shown.alias("more"), alert.alias("a")).select(
        (F.col("first") + F.make_dt_interval(F.lit(0), F.col("more"))).alias("landed"), "a")
    return seen.groupBy("landed").agg(F.array_sort(F.collect_list("a")).alias("a")).select(
        F.date_format("landed", "yyyy-MM-dd HH").alias("file"), "landed", F.col("a.alert").cast(schemas.ALERT_SNAPSHOT["alerts"].dataType).alias("alerts"))


def replay(v: Lenses, job: Callable[[DataFrame], DataStreamWriter]) -> Iterator[int]:
    """Lands the snapshots round by round and runs the stream over what is new; yields after each round."""
    landing = new_folder(v, "landing")
    table = stored(snapshots(v), "snapshots")
    before: Column = F.lit(True)
    for number, end in enumerate(ROUNDS):
        upto = F.col("landed") < F.lit(end).cast("timestamp")
        table.where(before & upto).write.mode("append").parquet(landing)
        before = ~upto
        stream = v.spark.readStream.schema(table.schema).parquet(landing)
        job(stream).trigger(availableNow=True).start().awaitTermination()
        yield number


def alert_events(v: Lenses) -> DataFrame:
    base = new_folder(v, "stream_alert_events")
    for _ in replay(v, lambda s: streams.write_table(streams.alert_events(s), f"{base}/table", f"{base}/checkpoint")):
        pass
    return v.spark.read.parquet(f"{base}/table").select(
        "file", F.col("pos").cast("long").alias("pos"), "location_oblast", "alert_type", "started_at", stamp(streams.EVENT_TIME).alias("started_ts"))


def deduplicated(v: Lenses) -> DataFrame:
    base = new_folder(v, "stream_dedup")

    def job(stream: DataFrame) -> DataStreamWriter:
        once = streams.deduplicate_alerts(streams.alert_events(stream), LONGEST_SEEN)
        return streams.write_table(once.select("location_oblast", "started_at"), f"{base}/table", f"{base}/checkpoint")

    for _ in replay(v, job):
        pass
    return v.spark.read.parquet(f"{base}/table")


def active_regions(v: Lenses) -> DataFrame:
    """The active set after each round."""
    base = new_folder(v, "stream_active_regions")
    seen = []
    for number in replay(v, lambda s: streams.write_active_regions(s, f"{base}/table", f"{base}/checkpoint")):
        seen.append(stored(streams.read_active_regions(v.spark, f"{base}/table").withColumn("round", F.lit(number)), "active_regions"))
    out = seen[0]
    for more in seen[1:]:
        out = out.unionByName(more)
    return out


def hourly_counts(v: Lenses) -> DataFrame:
    """The stream job over the events table, run to its end in update mode."""
    schema = v.table("events").schema
    events = (
        v.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(v.sf_dir)
        .select((F.col("user_id") % 25 + 1).alias("region_id"), F.col("ts").cast("timestamp").alias("ts"))
    )
    base, keys = new_folder(v, "stream_hourly_counts"), ["hour_ts", "region_id"]
    counts = streams.hourly_counts(events, "region_id", "ts")
    streams.write_updates(counts, f"{base}/table", f"{base}/checkpoint", keys).trigger(availableNow=True).start().awaitTermination()
    return streams.read_updates(v.spark, f"{base}/table", keys, counts.schema).withColumn("hour_ts", stamp("hour_ts"))


_SEEN = """
    SELECT id, date_trunc('hour', start_ts) + to_hours(CAST(CASE WHEN id % 29 = 0 THEN 30 ELSE 0 END + more AS INT)) AS landed,
           CASE WHEN id % 41 <> 0 THEN region_city END AS location_oblast, CASE WHEN alert_type <> 'view' THEN alert_type END AS alert_type,
           CASE WHEN id % 43 = 0 THEN '2024-01-01' ELSE strftime(start_ts, '%Y-%m-%dT%H:%M:%S') END AS started_at,
           CASE WHEN id % 43 = 0 THEN '2024-01-01 00:00:00' ELSE strftime(start_ts, '%Y-%m-%d %H:%M:%S') END AS started_ts
    FROM alarms, range(4) r(more) WHERE more <= id % 4"""
_ROUND = "SELECT * FROM (VALUES " + ", ".join(f"({i}, TIMESTAMP '{end}')" for i, end in enumerate(ROUNDS)) + ") r(round, until)"

QUERIES = {
    "stream_alert_events": (alert_events, with_views("""
        SELECT strftime(landed, '%Y-%m-%d %H') AS file, row_number() OVER (PARTITION BY landed ORDER BY id) - 1 AS pos,
               location_oblast, alert_type, started_at, started_ts FROM seen""", "alarms", extra={"seen": _SEEN})),
    "stream_dedup": (deduplicated, with_views(
        "SELECT DISTINCT location_oblast, started_at FROM seen", "alarms", extra={"seen": _SEEN})),
    "stream_active_regions": (active_regions, with_views("""
        SELECT CAST(round AS INT) AS round, location_oblast, coalesce(a.alert_type, 'unknown') AS type,
               CASE WHEN length(a.started_at) > 16 THEN substr(a.started_at, 12, 5) ELSE a.started_at END AS since
        FROM (SELECT round, location_oblast, min(struct_pack(id := id, alert_type := alert_type, started_at := started_at)) AS a
              FROM newest JOIN seen USING (landed) WHERE coalesce(location_oblast, '') <> '' GROUP BY 1, 2)""", "alarms", extra={
        "seen": _SEEN, "rounds": _ROUND, "newest": "SELECT round, max(landed) AS landed FROM rounds JOIN seen ON landed < until GROUP BY 1"})),
    "stream_hourly_counts": (hourly_counts, """
        SELECT user_id % 25 + 1 AS region_id, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour_ts, count(*) AS alarms
        FROM events GROUP BY 1, 2"""),
}
