"""Readers with explicit schemas."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regionhour import schemas
from regionhour.operators.running import running_totals
from regionhour.session import stored
from regionhour.sources.versions import Folder, VersionedTable
from regionhour.sources.writers import GROUPED

BLANKS = " \t\r\n"


def file_order() -> Column:
    """Place of a row in its files: path, first byte of the split, row in it.

    Spark packs splits into tasks by size, so row numbers alone follow sizes, not names. Inside a split
    the task's own numbers grow with the lines; between splits the path and the first byte decide.
    """
    return F.struct(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")
    )


def _read_csv(spark: SparkSession, path: str | list[str], schema: T.StructType, sep: str = ",", **more: Column) -> DataFrame:
    """Columns of ``schema`` by their names in the header, in any order, then ``more``; others are ignored.

    A missing column and files whose headers differ are errors; a value that cannot be read is null.
    """
    rows = spark.read.csv(path, sep=sep, header=True, enforceSchema=False)
    missing = [name for name in schema.names if name not in rows.columns]
    if missing:
        raise ValueError(f"{path}: no column {', '.join(missing)}")
    return rows.select(
        *[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema.fields], *[column.alias(name) for name, column in more.items()])


def read_alarms(spark: SparkSession, path: str) -> DataFrame:
    return _read_csv(spark, path, schemas.ALARMS, ";")


def read_regions(spark: SparkSession, path: str) -> DataFrame:
    return _read_csv(spark, path, schemas.REGIONS)


def read_weather_csv(spark: SparkSession, path: str | list[str], schema: T.StructType = schemas.WEATHER_CSV) -> DataFrame:
    """Wide rows as text, with ``line_no`` (``file_order``) growing by file name, then by line. A missing path is an error."""
    return _read_csv(spark, path, schema, line_no=file_order())


def _file_name() -> Column:
    return F.col("_metadata.file_name")


def _with_corrupt(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])


def _read_stored(spark: SparkSession, directory: str, schema: T.StructType, keys: list[str]) -> DataFrame:
    """JSON lines of ``writers.write_partitioned``; ``keys`` come from the folders, in a grouped table from the lines."""
    if not Folder(spark, directory).exists(GROUPED):
        return spark.read.json(directory, schema=schema)
    return spark.read.json(f"{directory.rstrip('/')}/{GROUPED}", schema=schema).select(*[c for c in schema.names if c not in keys], *keys)


def read_forecasts(spark: SparkSession, directory: str) -> DataFrame:
    """Landed forecasts: one document per ``*.json`` file."""
    documents = spark.read.json(directory, schema=schemas.FORECAST, multiLine=True, pathGlobFilter="*.json")
    return documents.select(_file_name().alias("file"), "*")


def read_stored_forecasts(spark: SparkSession, directory: str) -> DataFrame:
    """Documents of ``writers.write_forecasts``, with ``file`` as a landed file would be named."""
    schema = T.StructType([*schemas.FORECAST.fields, T.StructField("request_hour", T.StringType())])
    documents = _read_stored(spark, directory, schema, ["request_hour", "region"])
    return documents.select(F.concat_ws("_", "request_hour", "region").alias("file"), *schema.names)


def read_forecast_api(spark: SparkSession, directory: str) -> DataFrame:
    """Raw answers named ``<request>_<region>.json`` with ``days[].hours[]``; the request names date and hour."""
    documents = spark.read.json(directory, schema=schemas.FORECAST_API, multiLine=True, pathGlobFilter="*.json")
    name = r"^(\d{4}-\d{2}-\d{2}_\d{2})_(.*)\.json$"
    return documents.select(
        F.regexp_extract(_file_name(), name, 2).alias("region"),
        F.regexp_extract(_file_name(), name, 1).alias("request_hour"),
        "days",
    )


def read_weather_days(spark: SparkSession, directory: str) -> DataFrame:
    """Nested days at ``<city>/<yyyy-MM-dd>.json``, at any depth.

    Files not named by a date are ignored. Unreadable files stay, with
    ``readable`` false, because they count for coverage.
    """
    documents = (
        spark.read.option("recursiveFileLookup", "true")
        .schema(_with_corrupt(schemas.WEATHER_DAY))
        .json(directory, multiLine=True, pathGlobFilter="*.json")
    )
    path = F.col("_metadata.file_path")
    named = documents.select(
        F.url_decode(F.regexp_extract(path, r"([^/]+)/[^/]+$", 1)).alias("city"),
        F.regexp_extract(path, r"/([^/]+)\.json$", 1).alias("date"),
        _file_name().alias("file"),
        (F.col("_corrupt_record").isNull()).alias("readable"),
        "daily", "hours",
    )
    date = F.to_date(F.try_to_timestamp("date", F.lit("yyyy-MM-dd")))
    return named.withColumn("day_date", date).where(F.col("day_date").isNotNull())


def read_stored_weather_days(spark: SparkSession, directory: str) -> DataFrame:
    """Days of ``writers.write_weather_days``, in the form of ``read_weather_days``."""
    keys = [T.StructField("city", T.StringType()), T.StructField("date", T.StringType())]
    documents = _read_stored(spark, directory, T.StructType([*_with_corrupt(schemas.WEATHER_DAY).fields, *keys]), ["city", "date"])
    return documents.select(
        "city", "date", F.concat("date", F.lit(".json")).alias("file"), F.col("_corrupt_record").isNull().alias("readable"), "daily", "hours",
        F.to_date(F.try_to_timestamp("date", F.lit("yyyy-MM-dd"))).alias("day_date"),
    )


def read_report_html(spark: SparkSession, directory: str) -> DataFrame:
    """Pages named ``yyyy-MM-dd.html`` as text: UTF-8, else Latin-1."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.html").load(directory)
    name = F.regexp_extract("path", r"/(\d{4}-\d{2}-\d{2})\.html$", 1)
    utf8 = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.decode("content", "UTF-8"))
    return files.select(
        F.to_date(F.try_to_timestamp(F.nullif(name, F.lit("")), F.lit("yyyy-MM-dd"))).alias("report_date"),
        F.regexp_extract("path", r"([^/]+)$", 1).alias("html_file"),
        F.coalesce(utf8, F.decode("content", "ISO-8859-1")).alias("html"),
    ).where(F.col("report_date").isNotNull())


def decode_body(content: Column, declared: Column) -> Column:
    """Body bytes as text: UTF-8, else the declared charset when it is a standard one, else UTF-8 with replacements.

    Statistical charset detection is not offered.
    """
    charset = F.upper(F.coalesce(declared, F.lit("")))
    text = content.cast("string")
    standard = ["ISO-8859-1", "UTF-16", "UTF-16LE", "UTF-16BE"]
    decoded = F.when(F.is_valid_utf8(text), text)
    for name in standard:
        decoded = decoded.when(charset == name, F.decode(content, name))
    return decoded.otherwise(F.make_valid_utf8(text))


def read_reports(spark: SparkSession, directory: str) -> DataFrame:
    """Landed reports: one document per ``*.json`` file."""
    return spark.read.json(directory, schema=schemas.REPORT, multiLine=True, pathGlobFilter="*.json")


def read_stored_reports(spark: SparkSession, directory: str) -> DataFrame:
    """Reports of ``writers.write_reports``: one document a line."""
    return _read_stored(spark, directory, schemas.REPORT, ["date"])


def read_source_json(spark: SparkSession, directory: str) -> DataFrame:
    """Source entries of landed report documents (one per file), one row each; corrupt documents are skipped."""
    return _source_entries(spark.read.json(
        directory, schema=_with_corrupt(schemas.REPORT_SOURCES), multiLine=True, pathGlobFilter="*.json"
    ))


def read_stored_sources(spark: SparkSession, directory: str) -> DataFrame:
    """Source entries of ``writers.write_report_sources``: one document a line.

    Fields that the writer leaves out come back as null.
    """
    return _source_entries(_read_stored(spark, directory, _with_corrupt(schemas.REPORT_SOURCES), ["report_date"]))


def _source_entries(documents: DataFrame) -> DataFrame:
    return (
        documents.where(F.col("_corrupt_record").isNull())
        .select("report_date", "html_file", F.posexplode("sources").alias("pos", "source"))
        .select("report_date", "html_file", "pos", "source.*")
    )


def read_url_cache(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a JSON object keyed by address, or of a table of entries; a missing or corrupt one is empty.

    The single-object form is read for migration. Caches kept by this package
    are versioned tables, which have no size limit; their newest complete version counts.
    """
    try:
        return _read_cache(spark, path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schemas.SOURCE_ENTRY)


def _read_cache(spark: SparkSession, path: str) -> DataFrame:
    if path.endswith(".json"):
        return read_json_object(spark, path, schemas.SOURCE_ENTRY).where(F.col("entry").isNotNull()).select(
            F.coalesce("entry.url", "key").alias("url"), *[F.col(f"entry.{c}") for c in schemas.SOURCE_ENTRY.names[1:]])
    table = VersionedTable(spark, path)
    if table.newest() is not None:
        return table.read(schema=schemas.SOURCE_ENTRY)
    return spark.read.schema(schemas.SOURCE_ENTRY).parquet(path)


def read_json_object(spark: SparkSession, path: str, entry: T.StructType) -> DataFrame:
    """``file, key, entry`` for each member of one JSON object per file, however long; a file that is not one object gives no rows.

    The text is cut at every closing brace, which Spark can do from the middle of a file, so many tasks read one object. Whether
    a piece begins inside a string follows from the quotes before it, and how deep it lies from the braces before it: both are sums
    over the order of the pieces, taken inside each split and carried over the splits. A member ends where the depth is one
    again; its pieces are put together (one, unless its strings hold braces or its values are nested) and parsed on their own. A member
    that can't be parsed gives no row.
    """
    texts = spark.read.text(path, lineSep="}").select("value", file_order().alias("at"), F.col("_metadata.file_size").alias("size"))
    # Escaped characters can't change the state, and no escape crosses a cut: a backslash before a brace is itself escaped.
    runs = F.split(F.regexp_replace("value", r"\\.", ""), '"')
    opened = F.transform(runs, lambda run: F.length(run) - F.length(F.replace(run, F.lit("{"), F.lit(""))))

    def opens(odd: int) -> Column:
        return F.aggregate(F.filter(opened, lambda n, k: k % 2 == odd), F.lit(0), lambda total, n: total + n)

    pieces = stored(texts.select(
        F.col("at.file").alias("file"), F.col("at.block").alias("block"), F.col("at.row").alias("row"), "value", "size",
        (F.size(runs) - 1).alias("quotes"), opens(0).alias("opens_outside"), opens(1).alias("opens_inside")), "json_pieces")
    # Every piece but perhaps the last has a brace behind it: the file's size tells.
    ended = pieces.groupBy("file").agg(
        F.max(F.struct("block", "row")).alias("last"), (F.sum(F.octet_length("value") + 1) == F.max("size")).alias("shut"))
    order, chunk = ["block", "row"], F.col("block")
    quoted = running_totals(pieces, {"quotes_upto": F.col("quotes")}, order, chunk, ["file"]).join(ended, "file")
    inside = (F.col("quotes_upto") - F.col("quotes")) % 2 == 1
    braced = (F.struct("block", "row") != F.col("last")) | F.col("shut")
    marked = quoted.withColumns({
        "closes": (braced & (F.col("quotes_upto") % 2 == 0)).cast("int"), "opens": F.when(inside, F.col("opens_inside")).otherwise(F.col("opens_outside"))})
    deep = running_totals(marked, {"depth": F.col("opens") - F.col("closes")}, order, chunk, ["file"]).withColumn(
        "ends", ((F.col("closes") == 1) & (F.col("depth") == 1)).cast("int"))
    numbered = running_totals(deep, {"upto": F.col("ends")}, order, chunk, ["file"]).withColumn("member", F.col("upto") - F.col("ends"))
    # One object: it begins with a brace and is shut once, with nothing but blanks behind it.
    at, text = F.struct("block", "row"), F.trim(F.col("value"), F.lit(BLANKS))
    sound = numbered.groupBy("file").agg(
        F.startswith(F.min_by(text, at), F.lit("{")).alias("begins"), F.max_by("depth", at).alias("depth"), F.min("depth").alias("least"),
        (F.max_by("quotes_upto", at) % 2).alias("open_string"), F.count_if((F.col("depth") == 0) & (F.col("closes") == 1)).alias("shut"),
        F.max_by(F.when(F.col("closes") == 1, "").otherwise(text), at).alias("behind"),
    ).where("begins AND depth = 0 AND least = 0 AND open_string = 0 AND shut = 1 AND behind = ''")
    members = numbered.join(sound.select("file"), "file", "left_semi").groupBy("file", "member").agg(
        F.array_sort(F.collect_list(F.struct("block", "row", "value"))).alias("parts"), F.max("ends").alias("whole")).where("whole = 1")
    joined = F.array_join(F.col("parts.value"), "}")
    body = F.regexp_replace(joined, r"\A[\s{,]*", "")
    parsed = F.from_json(F.concat(F.lit("{"), body, F.lit("}}")), T.MapType(T.StringType(), entry))
    return members.select("file", F.explode(parsed).alias("key", "entry"))


def read_alert_snapshots(spark: SparkSession, directory: str, streaming: bool = False) -> DataFrame:
    """Landed live snapshots, one row per file, as a table or a file stream.

    Error answers and broken files have no array of alerts. They say nothing about the
    state and are left out; an empty array is a snapshot without alerts.
    """
    reader = (spark.readStream if streaming else spark.read).schema(_with_corrupt(schemas.ALERT_SNAPSHOT))
    snapshots = reader.option("multiLine", "true").option("pathGlobFilter", "*.json").json(directory)
    return snapshots.where(F.col("alerts").isNotNull() & F.col("_corrupt_record").isNull()).select(
        _file_name().alias("file"), F.col("_metadata.file_modification_time").alias("landed"), "alerts",
    )
