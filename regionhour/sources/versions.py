"""Tables kept as numbered versions with a commit point.

``<table>/data/version=N`` holds the rows of version N and ``<table>/log/N.json`` its manifest, which is written last: a version
without a manifest is not there for readers. Before any data a writer creates ``<table>/log/N.claim``, which only one of several can do; the others are
refused. Numbers only grow, also past versions that were never finished. A manifest names rows, bytes and files and may carry notes,
such as how far a stream has been taken in. All of this is a handful of small files per version, made by the driver through Spark's
own file systems, so it works wherever Spark can write.
"""

from __future__ import annotations

import json
import time
from dataclasses import dataclass, field

from pyspark.errors.exceptions.captured import CapturedException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from py4j.protocol import Py4JJavaError


class VersionTaken(RuntimeError):
    """Another writer has claimed this version."""


@dataclass
class Manifest:
    version: int
    schema: str
    files: int
    bytes: int
    written: float
    notes: dict = field(default_factory=dict)


class Folder:
    """A folder on any file system that Spark can write."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._at("").getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def _at(self, below: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{below}" if below else self.path)

    def names(self, below: str = "") -> list[str]:
        where = self._at(below)
        return [status.getPath().getName() for status in self._fs.listStatus(where)] if self._fs.exists(where) else []

    def exists(self, below: str = "") -> bool:
        return self._fs.exists(self._at(below))

    def rename(self, below: str, to: str) -> bool:
        return self._fs.rename(self._at(below), self._at(to))

    def remove(self, below: str) -> None:
        self._fs.delete(self._at(below), True)


class VersionedTable(Folder):
    """One table of numbered versions below ``path``."""

    def _create(self, below: str, text: str) -> None:
        """A new file with this text; an error if it exists."""
        out = self._fs.create(self._at(below), False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def _read(self, below: str) -> str:
        source = self._fs.open(self._at(below))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(source)).decode()
        finally:
            source.close()

    def children(self, below: str, prefix: str) -> list[int]:
        """Numbers of the folders ``<prefix><number>`` below a folder."""
        return sorted(int(name[len(prefix):]) for name in self.names(below) if name.startswith(prefix) and name[len(prefix):].isdigit())

    def versions(self) -> list[int]:
        """Complete versions, oldest first."""
        return sorted(int(name[:-5]) for name in self.names("log") if name.endswith(".json") and name[:-5].isdigit())

    def claims(self) -> list[int]:
        """Versions that a writer has begun, complete or not."""
        return sorted(int(name[:-6]) for name in self.names("log") if name.endswith(".claim") and name[:-6].isdigit())

    def newest(self) -> int | None:
        return max(self.versions(), default=None)

    def next_version(self) -> int:
        return max([*self.versions(), *self.claims()], default=0) + 1

    def manifest(self, version: int) -> Manifest:
        return Manifest(**json.loads(self._read(f"log/{version}.json")))

    def write(self, df: DataFrame, version: int | None = None, notes: dict | None = None) -> int:
        """Writes the next version, or ``version`` if nobody has begun it, and commits it. Readers see all of it or nothing."""
        version = self.next_version() if version is None else version
        try:
            self._create(f"log/{version}.claim", str(time.time()))
        except (Py4JJavaError, CapturedException) as error:
            if version in self.claims():
                raise VersionTaken(f"{self.path}: version {version} has a writer") from error
            raise
        data = f"data/version={version}"
        df.write.mode("error").parquet(f"{self.path}/{data}")
        summary = self._fs.getContentSummary(self._at(data))
        manifest = {"version": version, "schema": df.schema.json(), "files": summary.getFileCount(), "bytes": summary.getLength(),
                    "written": time.time(), "notes": notes or {}}
        # A half-written manifest would be a commit: it is made under another name and moved.
        self._create(f"log/{version}.json.tmp", json.dumps(manifest))
        if not self.rename(f"log/{version}.json.tmp", f"log/{version}.json"):
            raise VersionTaken(f"{self.path}: version {version} is committed")
        return version

    def read(self, version: int | None = None, schema: T.StructType | None = None) -> DataFrame:
        """The newest complete version, or an older complete one; a table without any is empty with ``schema``."""
        version = self.newest() if version is None else version
        if version is None:
            if schema is None:
                raise FileNotFoundError(f"{self.path}: no complete version")
            return self.spark.createDataFrame([], schema)
        if version not in self.versions():
            raise FileNotFoundError(f"{self.path}: version {version} is not complete")
        own = schema or T.StructType.fromJson(json.loads(self.manifest(version).schema))
        return self.spark.read.schema(own).parquet(f"{self.path}/data/version={version}")

    def read_all(self, schema: T.StructType) -> DataFrame:
        """Rows of all complete versions with their ``version``, for tables that grow by a version a run."""
        full = T.StructType([*schema.fields, T.StructField("version", T.LongType())])
        complete = self.versions()
        if not complete:
            return self.spark.createDataFrame([], full)
        paths = [f"{self.path}/data/version={version}" for version in complete]
        return self.spark.read.schema(full).option("basePath", f"{self.path}/data").parquet(*paths)

    def remove_old(self, keep: int = 2, seconds: float = 0.0) -> list[int]:
        """Removes versions written more than ``seconds`` ago, but never the newest ``keep``; unfinished ones of that age below the newest go too.

        The manifest goes first, so nobody finds a version whose data are going.
        """
        if keep < 1:
            raise ValueError("the newest version stays")
        complete, newest, now, gone = self.versions(), self.newest(), time.time(), []
        for version in self.claims():
            if version in complete:
                old = version in complete[:-keep] and now - self.manifest(version).written >= seconds
            else:
                old = newest is not None and version < newest and now - float(self._read(f"log/{version}.claim")) >= seconds
            if old:
                for below in (f"log/{version}.json", f"data/version={version}", f"log/{version}.claim"):
                    self.remove(below)
                gone.append(version)
        return gone
