"""Session settings the operators are designed for."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Adaptive execution sizes shuffle partitions, splits skewed join partitions and
# turns a join into a broadcast only when the measured side is small enough.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot key even where the next step has to shuffle again for it.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Report pages are large: small batches keep Python workers within their memory.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "500",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # A folder is listed in a millisecond, a task to list it takes thirty: many folders a task.
    "spark.sql.sources.parallelPartitionDiscovery.parallelism": "64",
}


def build_session(app_name: str = "regionhour", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the defaults above; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def apply_defaults(spark: SparkSession) -> None:
    """The same settings on a session made elsewhere; all of them can change at run time."""
    for key, value in DEFAULTS.items():
        spark.conf.set(key, value)


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach, as named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a fresh folder of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster")
    made = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: computed once, safe from lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
