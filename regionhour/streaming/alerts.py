"""Alert events, deduplication, hourly counts and the active set."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from regionhour.operators.serving import first_alert_per_region
from regionhour.sources.versions import VersionedTable

EVENT_TIME = "started_ts"
ACTIVE = T.StructType([
    T.StructField("landed", T.TimestampType()), T.StructField("file", T.StringType()),
    T.StructField("location_oblast", T.StringType()), T.StructField("type", T.StringType()), T.StructField("since", T.StringType()),
])


def alert_events(snapshots: DataFrame) -> DataFrame:
    """One row per alert of each snapshot, with its place in the array; works on streams and tables.

    ``snapshots`` has file and landed columns from the reader.
    """
    return snapshots.select("file", "landed", F.posexplode("alerts").alias("pos", "alert")).select(
        "file", "landed", "pos", "alert.*",
        F.try_to_timestamp(F.col("alert.started_at")).alias(EVENT_TIME),
    )


def deduplicate_alerts(events: DataFrame, delay: str = "7 days") -> DataFrame:
    """The same alert is in many snapshots; keep it once per region and start.

    The watermark follows the landing of files, so an alert that began long ago is kept when it is
    first seen. ``delay`` is how long an alert may stay in snapshots; the state is dropped after it.
    """
    return events.withWatermark("landed", delay).dropDuplicatesWithinWatermark(["location_oblast", "started_at"])


def hourly_counts(events: DataFrame, region: str, ts: str, delay: str = "1 hour") -> DataFrame:
    """Alarms per region and hour. In append mode rows later than the watermark are dropped."""
    return (
        events.withWatermark(ts, delay)
        .groupBy(F.window(ts, "1 hour").alias("w"), region)
        .agg(F.count(F.lit(1)).alias("alarms"))
        .select(F.col("w.start").alias("hour_ts"), region, "alarms")
    )


def newest_snapshot(snapshots: DataFrame) -> DataFrame:
    newest = snapshots.agg(F.max(F.struct("landed", "file")).alias("newest")).scalar()
    return snapshots.where(F.struct("landed", "file") == newest)


def active_regions(snapshots: DataFrame) -> DataFrame:
    """Active set of the newest snapshot: first alert of each region in array order.

    The newest file is looked up among snapshots, not alerts, because one
    without alerts means that no region is active.
    """
    return first_alert_per_region(alert_events(newest_snapshot(snapshots)), "file").drop("file")


def write_active_regions(snapshots: DataFrame, path: str, checkpoint: str, keep: int = 2) -> DataStreamWriter:
    """Stream writer that commits the active set of the newest snapshot so far as the next version; ``keep`` versions stay.

    Nothing is overwritten under readers. A batch whose snapshots all landed before the newest one known changes nothing, and neither does
    a repeated batch. A version has one row without a region, which stands for the snapshot itself, so that an
    empty active set is a version too.
    """
    def add(batch: DataFrame, batch_id: int) -> None:
        table = VersionedTable(batch.sparkSession, path)
        version = table.newest()
        newest = newest_snapshot(batch)
        regions = first_alert_per_region(alert_events(newest), "file").join(newest.select("file", "landed"), "file")
        marker = newest.select("landed", "file", *[F.lit(None).cast("string").alias(c) for c in ACTIVE.names[2:]])
        found = regions.select(*ACTIVE.names).unionByName(marker)
        if version is not None:
            if batch_id <= table.manifest(version).notes["batch"]:
                return
            found = found.unionByName(table.read(version, ACTIVE))
        table.write(newest_snapshot(found), notes={"batch": batch_id})
        table.remove_old(keep=keep)

    return snapshots.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)


def read_active_regions(spark: SparkSession, path: str) -> DataFrame:
    """The active set of the newest snapshot of all batches, by landing time; late older files change nothing."""
    version = VersionedTable(spark, path).read(schema=ACTIVE)
    return version.where(F.col("location_oblast").isNotNull()).select(*ACTIVE.names[2:])


def write_table(stream: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Stream writer to parquet in append mode: windows are written once, when the watermark has passed them."""
    return stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)


def _last(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The row of each key from the newest batch, with that ``batch``; partial maxima go into the shuffle."""
    values = [c for c in rows.columns if c not in keys and c != "batch"]
    return rows.groupBy(*keys).agg(F.max(F.struct("batch", *values)).alias("last")).select(*keys, "last.*")


def _batches(table: VersionedTable, schema: T.StructType, after: int) -> DataFrame | None:
    """Rows of the batches not compacted yet."""
    numbers = [n for n in table.children("batches", "batch=") if n > after]
    if not numbers:
        return None
    found = table.spark.read.schema(schema).option("basePath", f"{table.path}/batches").parquet(*[f"{table.path}/batches/batch={n}" for n in sorted(numbers)])
    return found.select(*schema.names)


def _upto(table: VersionedTable, version: int | None) -> int:
    return -1 if version is None else table.manifest(version).notes["upto"]


def write_updates(stream: DataFrame, path: str, checkpoint: str, keys: list[str], every: int = 10) -> DataStreamWriter:
    """Stream writer in update mode: every batch writes the rows it changed, and every ``every`` batches they are compacted.

    A compaction keeps the last row of each key of the newest version and the batches since, and commits it as the next version with
    the number of the last batch in it. Batches that the version before already held are removed, so a reader of that one
    never misses a file; at most ``2 * every`` batches and two versions are left. A repeated batch writes the same folder again, or
    nothing once it is compacted.
    """
    def add(batch: DataFrame, batch_id: int) -> None:
        table = VersionedTable(batch.sparkSession, path)
        newest = table.newest()
        upto = _upto(table, newest)
        if batch_id <= upto:
            return
        batch.withColumn("batch", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(f"{path}/batches/batch={batch_id}")
        if batch_id - upto >= every:
            schema = T.StructType([*batch.schema.fields, T.StructField("batch", T.LongType())])
            since = _batches(table, schema, upto)
            rows = since if newest is None else table.read(newest, schema).unionByName(since)
            table.write(_last(rows, keys), notes={"upto": batch_id})
            table.remove_old(keep=2)
            for number in table.children("batches", "batch="):
                if number <= upto:
                    table.remove(f"batches/batch={number}")

    return stream.writeStream.foreachBatch(add).outputMode("update").option("checkpointLocation", checkpoint)


def read_updates(spark: SparkSession, path: str, keys: list[str], schema: T.StructType) -> DataFrame:
    """Last row of each key: the newest version of ``write_updates`` and the batches after it. ``schema`` is the stream's."""
    table = VersionedTable(spark, path)
    full = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
    newest = table.newest()
    rows, since = table.read(newest, full), _batches(table, full, _upto(table, newest))
    return _last(rows if since is None else rows.unionByName(since), keys).select(*schema.names)
