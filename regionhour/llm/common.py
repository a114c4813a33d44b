"""Helpers shared by the operators: table reading, the held-out rule, stored steps."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from regionhour.session import shared_dir

# White space of the word rules: space and the ASCII controls 9 to 13.
BLANKS = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns only, so that further columns cannot clash with ours."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4, is 2; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def step_path(spark: SparkSession, name: str) -> str:
    """A new folder below the one that all executors share."""
    return f"{shared_dir(spark)}/{name}/{uuid.uuid4().hex}"


def step(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: computed once, safe from lost executors."""
    path = step_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(*steps: DataFrame) -> None:
    """Removes tables made by ``step`` that nothing reads any more."""
    for df in steps:
        spark = df.sparkSession
        folders = {file.rpartition("/")[0] for file in df.inputFiles()}
        for folder in folders:
            if not folder.split(":")[-1].lstrip("/").startswith(shared_dir(spark).split(":")[-1].lstrip("/")):
                raise ValueError(f"not a stored step: {folder}")
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def digest(text: Column) -> Column:
    """SHA-256 of the UTF-8 text as lower-case hex; null counts as empty."""
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)
