"""Zstandard web archives: one frame per record, the dictionary in a leading skippable frame.

Archives are plain files in any store that Spark reaches. The writer gives
Spark's text sink one value per frame; the separator it puts behind a value is an
empty skippable frame, which every Zstandard reader passes over. The reader
takes whole archives (``archive_bytes`` bounds them), loads the dictionary and
decodes record by record, each frame from the bytes that its own block headers span. What is damaged becomes a row
with the ``error``; reading goes on at the next frame.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regionhour.llm.common import digest, step_path, table

# Fixed values of the format: magic numbers of Zstandard frames, the dictionary frame
# of compressed web archives, the profile of a repeated payload.
FRAME = b"\x28\xb5\x2f\xfd"
DICTIONARY = b"\x5d\x2a\x4d\x18"
SKIPPABLE = re.compile(rb"[\x50-\x5f]\x2a\x4d\x18")
SEPARATOR = "P*M\x18\x00\x00\x00\x00"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

LEAST_REVISIT = 100
ARCHIVE_BYTES = 8 << 20
ARCHIVE_ROWS = 4096
DICTIONARY_SAMPLE = 1 << 20  # bytes of an archive's first payloads that train its dictionary
DICTIONARY_BYTES = 16 << 10
SAMPLE_ROWS = 1024

RECORD = T.StructType([
    T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("record_type", T.StringType()),
    T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()),
    T.StructField("refers_to", T.LongType()), T.StructField("payload", T.BinaryType()), T.StructField("error", T.StringType()),
])


def choose_records(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, html) with ``sha, octets, refers_to``: of equal payloads of 100 bytes or more the smallest page answers.

    Rows repeated with that id all answer; a null id loses against any other.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), digest(html).alias("sha"), F.octet_length(html).cast("long").alias("octets"))
    first = rows.filter(F.col("octets") >= LEAST_REVISIT).groupBy(F.unhex("sha").alias("raw")).agg(
        F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.lower(F.hex("raw")).alias("sha"), "first_id")
    found = rows.join(first, "sha", "left")
    other = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return found.withColumn("refers_to", F.when(other, F.col("first_id"))).withColumn(
        "html", F.when(~other, F.col("html"))).select("page_id", "url", "html", "sha", "octets", "refers_to")


def _name(page_id) -> str:
    return "<urn:page:>" if pd.isna(page_id) else f"<urn:page:{int(page_id)}>"


def _number(name: str):
    found = re.fullmatch(r"<urn:page:(-?\d*)>", name)
    if not found:
        raise ValueError(f"record name {name[:80]!r}")
    return int(found[1]) if found[1] else None


def record_bytes(page_id, url, payload: bytes | None, sha: str, octets: int, refers_to) -> bytes:
    """One uncompressed record; a revisit (payload None) keeps the response's headers only."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {octets}\r\n\r\n".encode() + (payload or b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if payload is not None else 'revisit'}", f"WARC-Record-ID: {_name(page_id)}",
            "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        # Header lines must not break: control characters and the escape sign itself are written as %XX.
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if payload is None:
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {_name(refers_to)}"]
    head += [f"WARC-Payload-Digest: sha256:{sha}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
             "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple:
    """A record's fields; raises where version, headers, lengths or digests don't fit."""
    head, found, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not found or not re.fullmatch(r"WARC/1\.[01]", lines[0]):
        raise ValueError("no WARC version line")
    fields: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not re.fullmatch(r"[!-9;-~]+", name):
            raise ValueError(f"header line {line[:80]!r}")
        fields[name.lower()] = value.strip()
    lacking = {"warc-type", "warc-record-id", "warc-date", "content-length"} - fields.keys()
    if lacking:
        raise ValueError(f"headers lacking: {sorted(lacking)}")
    length = int(fields["content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ValueError(f"content length {length}, {len(rest) - 4} bytes found")
    block = rest[:length]
    if fields.get("warc-block-digest") != "sha256:" + hashlib.sha256(block).hexdigest():
        raise ValueError("block digest differs")
    answer, _, payload = block.partition(b"\r\n\r\n")
    stated = re.search(rb"\r\ncontent-length: *(\d+)", answer, re.I)
    kind, sha = fields["warc-type"], fields.get("warc-payload-digest", "").removeprefix("sha256:")
    if not stated or kind not in ("response", "revisit"):
        raise ValueError(f"record of type {kind[:20]!r} without a stated length" if not stated else f"record type {kind[:20]!r}")
    octets = int(stated[1])
    if kind == "response" and (len(payload) != octets or hashlib.sha256(payload).hexdigest() != sha):
        raise ValueError("payload differs from its length or digest")
    if kind == "revisit" and (payload or fields.get("warc-profile") != REVISIT or "warc-refers-to" not in fields):
        raise ValueError("revisit with a payload, or without profile or reference")
    refers = _number(fields["warc-refers-to"]) if kind == "revisit" else None
    return (_number(fields["warc-record-id"]), fields.get("warc-target-uri"), kind, octets, sha, refers, payload if kind == "response" else None)


def _frames(archive_bytes: int, archive_rows: int):
    """Frames of archives one after the other: dictionary first, then a frame per record.

    An archive takes ``archive_rows`` values; one that is full by its bytes is filled
    up with empty values, of which only the separator is written.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: list[tuple] = []
        packer, sampled, written, rows = None, 0, 0, 0

        def start() -> list[bytes]:
            nonlocal packer
            try:
                book = zstandard.train_dictionary(DICTIONARY_BYTES, [r[2] for r in waiting if r[2]])
            except zstandard.ZstdError:  # too few payloads to learn from: an archive may go without
                packer = zstandard.ZstdCompressor(level=3, write_content_size=True)
                return []
            packer = zstandard.ZstdCompressor(level=3, dict_data=book, write_content_size=True)
            raw = book.as_bytes()
            return [DICTIONARY + len(raw).to_bytes(4, "little") + raw]

        def flush() -> Iterator[pd.DataFrame]:
            nonlocal packer, written, rows
            frames = start() if packer is None and waiting else []
            for record in waiting:
                frames.append(packer.compress(record_bytes(*record)))
                written += len(record[2] or b"") + 300
            waiting.clear()
            rows += len(frames)
            if written >= archive_bytes or rows + SAMPLE_ROWS + 1 > archive_rows:
                frames += [b""] * (archive_rows - rows)
                packer, written, rows = None, 0, 0
            yield pd.DataFrame({"frame": frames})

        for batch in batches:
            for page, url, html, sha, octets, refers in zip(batch.page_id, batch.url, batch.html, batch.sha, batch.octets, batch.refers_to):
                waiting.append((page, url, None if pd.isna(html) else html.encode(), sha, octets, refers))
                sampled += len(waiting[-1][2] or b"")
                # The first flush of an archive brings the sample that trains its dictionary.
                if len(waiting) == SAMPLE_ROWS or (sampled >= DICTIONARY_SAMPLE if packer is None else len(waiting) == 32):
                    yield from flush()
                    sampled = 0
        yield from flush()

    return run


def write_archives(records: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES, archive_rows: int = ARCHIVE_ROWS) -> None:
    """Records of ``choose_records`` as .warc.zst content under ``path``, about ``archive_bytes`` of payload each.

    Tasks write what they hold, in as many archives as it takes.
    """
    frames = records.mapInPandas(_frames(archive_bytes, archive_rows), "frame binary")
    frames.select(F.col("frame").cast("string").alias("value")).write.option("lineSep", SEPARATOR).option(
        "maxRecordsPerFile", archive_rows).text(path)


def frame_end(archive: bytes, at: int) -> int:
    """Where the frame at ``at`` ends: its header, blocks up to the last one, and a checksum if it says so."""
    def need(stop: int) -> int:
        if stop > len(archive):
            raise ValueError(f"the archive ends inside the frame at byte {at}")
        return stop

    flags = archive[need(at + 5) - 1]
    single, name, size = flags >> 5 & 1, (0, 1, 2, 4)[flags & 3], flags >> 6
    place = at + 5 + (1 - single) + name + ((1 << size) if size else single)
    last = False
    while not last:
        header = int.from_bytes(archive[place:need(place + 3)], "little")
        last, kind, length = bool(header & 1), header >> 1 & 3, header >> 3
        if kind == 3:
            raise ValueError(f"a block of no known kind at byte {place}")
        place = need(place + 3 + (1 if kind == 1 else length))
    return need(place + (4 if flags & 4 else 0))


def frames_of(archive: bytes) -> Iterator[bytes | ValueError]:
    """Uncompressed content of each frame, or what is wrong with it; the dictionary comes from the leading skippable frame."""
    at, reader = 0, zstandard.ZstdDecompressor()
    while at < len(archive):
        magic = archive[at:at + 4]
        try:
            if SKIPPABLE.fullmatch(magic):
                length = int.from_bytes(archive[at + 4:at + 8], "little")
                stop = at + 8 + length
                if len(archive) < max(stop, at + 8):
                    raise ValueError(f"the archive ends inside the skippable frame at byte {at}")
                if magic == DICTIONARY:
                    if at:
                        raise ValueError("a dictionary must lead the archive")
                    body = archive[at + 8:stop]
                    if body[:4] == FRAME:  # the dictionary may itself be compressed
                        body = zstandard.ZstdDecompressor().decompress(body)
                    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(body, dict_type=zstandard.DICT_TYPE_FULLDICT))
            elif magic == FRAME:
                stop = frame_end(archive, at)
                one = reader.decompressobj()
                content = one.decompress(memoryview(archive)[at:stop])
                if not one.eof:
                    raise ValueError(f"the frame at byte {at} is not whole")
                yield content
            else:
                raise ValueError(f"no frame at byte {at}")
            at = stop
        except (ValueError, zstandard.ZstdError) as wrong:
            yield ValueError(f"{wrong} (frame at byte {at})")
            # The next frame begins with the magic number; a place that only looks like it fails again and is passed over.
            at = archive.find(FRAME, at + 1)
            if at < 0:
                return


def _row(raw: bytes | ValueError) -> tuple:
    if isinstance(raw, bytes):
        try:
            return (*parse_record(raw), None)
        except ValueError as wrong:  # also text that is not UTF-8
            raw = wrong
    return (*[None] * 7, str(raw)[:500])


def _records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names, whole = RECORD.fieldNames(), ["page_id", "payload_bytes", "refers_to"]
    for batch in batches:
        for archive in batch.content:
            rows, size = [], 0
            for raw in frames_of(bytes(archive)):
                rows.append(_row(raw))
                size += len(raw) if isinstance(raw, bytes) else 0
                if size > 4 << 20:
                    yield pd.DataFrame(rows, columns=names).astype(dict.fromkeys(whole, "Int64"))
                    rows, size = [], 0
            yield pd.DataFrame(rows, columns=names).astype(dict.fromkeys(whole, "Int64"))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """All records of the archives under ``path``; a damaged one is a row of nulls with the ``error``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    # One archive to a batch and no more: archives are the unit of memory.
    return files.select("content").mapInPandas(_records, RECORD)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = step_path(spark, "archives")
    write_archives(choose_records(table(spark, sf_dir, "pages", "page_id", "url", "html")), path)
    return read_archives(spark, path).drop("payload", "url")


# Nothing is damaged, so no row has an error.
OP4_SQL = f"""
    SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes, sha256(payload) AS payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN again THEN first_id END AS refers_to, CAST(NULL AS VARCHAR) AS error
    FROM (SELECT *, strlen(payload) >= {LEAST_REVISIT} AND page_id IS DISTINCT FROM first_id AS again
          FROM (SELECT page_id, coalesce(html, '') AS payload, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first_id FROM pages))"""
