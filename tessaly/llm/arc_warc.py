"""Legacy ARC archives, their conversion to WARC, and reading WARC back.

An ARC file opens with a version block; its version says how the header line of each record is laid out (five fields in
version 1, ten in version 2), and the line's last field gives the length of what follows. The converter reads header
lines and lengths, and makes for each record what WARC asks for: an identifier from the record's place, an ISO timestamp
from the 14 digits, a type, and digests of block and payload. Of equal payloads of at least ``least`` bytes one
stays a response and the others become revisits that refer to it. Files are written by Spark's text writer with the record
separator of the format and compressed with gzip; a task writes its archives, starting each with its opening record.

Null html is an empty payload. Null urls are written as "urn:none"; null page ids are kept and count as smaller than any.
Repeated rows are records of their own. Other columns are ignored; an empty table gives archives without records.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessaly.llm.storage import materialise, new_folder

#: Header fields of both ARC versions.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
CAPTURED = "20240101000000"
WARC_END = "\r\n\r\n"
#: Revisits sent to all executors; more are joined by shuffling.
BROADCAST_ROWS = 300_000
ROWS_A_BATCH = 500
#: Archives are written twice and read soon: speed before size.
GZIP = {"compression": "gzip", "zlib.compress.level": "BEST_SPEED"}


def in_batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Batches of a bounded number of rows."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == ROWS_A_BATCH:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def write_arc(pages: DataFrame, path: str, captured: str = CAPTURED) -> None:
    """One ARC file per task; tasks with odd numbers write version 2."""
    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        part = TaskContext.get().partitionId()
        version = 1 + part % 2
        name = f"{part:05d}.arc"
        body = f"{version} 0 tessaly\n{ARC_FIELDS[version]}\n"
        opening = f"filedesc://{name} 0.0.0.0 {captured} text/plain " + ("" if version == 1 else f"200 - - 0 {name} ") + f"{len(body)}\n{body}"
        yield (opening.encode(),)
        offset = len(opening) + 1
        for batch in batches:
            for page_id, url, html in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True):
                payload = (html or "").encode()
                head = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n" + ("" if page_id is None else f"X-Page-Id: {page_id}\r\n") + f"Content-Length: {len(payload)}\r\n\r\n"
                block = head.encode() + payload
                place = "%20".join((url or "urn:none").split()) or "urn:none"
                middle = "" if version == 1 else f"200 {hashlib.md5(payload).hexdigest()} - {offset} {name} "
                record = f"{place} 0.0.0.0 {captured} text/html {middle}{len(block)}\n".encode() + block
                offset += len(record) + 1
                yield (record,)

    schema = pa.schema([("record", pa.binary())])
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    lines = rows.mapInArrow(lambda batches: in_batches(records(batches), schema), "record binary")
    lines.select(F.col("record").cast("string").alias("value")).write.options(**GZIP).option("lineSep", "\n").text(path)


def parse_arc(content: bytes, part: str) -> Iterator[tuple]:
    """Records of one file: id, url, 14-digit date, media type and block."""
    stream = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(content)), 1 << 18)
    version, offset = 0, 0
    while line := stream.readline():
        if line == b"\n":
            offset += 1
            continue
        fields = line.decode().rstrip("\n").split(" ")
        block = stream.read(int(fields[-1]))
        if not version:
            version = int(block.split(b" ", 1)[0])
            if version not in ARC_FIELDS:
                raise ValueError(f"ARC version {version} in {part}")
        else:
            named = dict(zip(ARC_FIELDS[version].split(" "), fields, strict=True))
            number = xxhash.xxh3_128_hexdigest(f"{part}:{offset}:{named['URL']}".encode())
            # Version 8 of the UUID layout: the other digits are a hash of our own.
            name = f"urn:uuid:{number[:8]}-{number[8:12]}-8{number[13:16]}-a{number[17:20]}-{number[20:]}"
            yield name, named["URL"], named["Archive-date"], named["Content-type"], block
        offset += len(line) + len(block)


def http_parts(block: bytes) -> tuple[bytes, bytes]:
    """Header with its empty line, and payload."""
    head, mark, payload = block.partition(b"\r\n\r\n")
    return head + mark, payload


def http_field(head: bytes, name: bytes) -> bytes | None:
    for line in head.split(b"\r\n"):
        key, mark, value = line.partition(b":")
        if mark and key.strip().lower() == name:
            return value.strip()
    return None


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select(F.regexp_extract("path", r"part-(\d+)", 1).alias("part"), "content")


ARC_ROWS = pa.schema([("record_id", pa.string()), ("url", pa.string()), ("date", pa.string()), ("media_type", pa.string()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.binary()), ("block", pa.binary())])
ARC_DDL = "record_id string, url string, date string, media_type string, page_id bigint, payload_bytes bigint, payload_digest binary, block binary"


def read_arc(spark: SparkSession, path: str, blocks: bool) -> DataFrame:
    """One row per ARC record; without ``blocks`` the bodies are only measured."""
    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for part, content in zip(batch.column("part"), batch.column("content"), strict=True):
                for name, url, date, kind, block in parse_arc(content.as_py(), part.as_py()):
                    head, payload = http_parts(block)
                    number = http_field(head, b"x-page-id")
                    yield name, url, date, kind, None if number is None else int(number), len(payload), hashlib.sha1(payload).digest(), block if blocks else None

    return read_archives(spark, path).mapInArrow(lambda batches: in_batches(records(batches), ARC_ROWS), ARC_DDL)


def find_revisits(records: DataFrame, least: int) -> DataFrame:
    """``record_id, refers_id, refers_url, refers_date`` of the records that repeat a payload."""
    long = records.where(F.col("payload_bytes") >= least).select("payload_digest", "page_id", "record_id", "url", "date")
    first = long.groupBy("payload_digest").agg(F.max(F.struct("page_id", "record_id", "url", "date")).alias("r"), F.count(F.lit(1)).alias("n")).where("n > 1")
    met = long.select("payload_digest", "record_id").join(first, "payload_digest").where(F.col("record_id") != F.col("r.record_id"))
    return met.select("record_id", F.col("r.record_id").alias("refers_id"), F.col("r.url").alias("refers_url"), F.col("r.date").alias("refers_date"))


def base32(digest: bytes) -> str:
    return "sha1:" + base64.b32encode(digest).decode()


def iso(date: str) -> str:
    return f"{date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:14]}Z"


def warc_record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + f"Content-Length: {len(block)}\r\n\r\n"
    return head.encode() + block


def convert_arc(spark: SparkSession, arc_path: str, warc_path: str, least: int = 1000) -> None:
    """Write one WARC file per reading task."""
    revisits = materialise(find_revisits(read_arc(spark, arc_path, False), least), "revisits")
    small = revisits.count() <= BROADCAST_ROWS
    rows = read_arc(spark, arc_path, True).join(F.broadcast(revisits) if small else revisits, "record_id", "left")

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        part = TaskContext.get().partitionId()
        number = xxhash.xxh3_128_hexdigest(f"warcinfo:{part}".encode())
        about = b"software: tessaly\r\nformat: WARC File Format 1.1\r\n"
        yield (warc_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{number[:8]}-{number[8:12]}-8{number[13:16]}-a{number[17:20]}-{number[20:]}>"), ("WARC-Date", iso(CAPTURED)), ("Content-Type", "application/warc-fields")], about),)
        for batch in batches:
            for r in batch.to_pylist():
                head, payload = http_parts(r["block"])
                again = r["refers_id"] is not None
                block = head if again else r["block"]
                fields = [
                    ("WARC-Type", "revisit" if again else "response"), ("WARC-Record-ID", f"<{r['record_id']}>"), ("WARC-Date", iso(r["date"])), ("WARC-Target-URI", r["url"]),
                    ("WARC-Payload-Digest", base32(r["payload_digest"])), ("WARC-Block-Digest", base32(hashlib.sha1(block).digest())), ("Content-Type", "application/http; msgtype=response"),
                ]
                if again:
                    fields += [
                        ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<{r['refers_id']}>"),
                        ("WARC-Refers-To-Target-URI", r["refers_url"]), ("WARC-Refers-To-Date", iso(r["refers_date"])),
                    ]
                yield (warc_record(fields, block),)

    schema = pa.schema([("record", pa.binary())])
    lines = rows.mapInArrow(lambda batches: in_batches(records(batches), schema), "record binary")
    lines.select(F.col("record").cast("string").alias("value")).write.options(**GZIP).option("lineSep", WARC_END).text(warc_path)


def parse_warc(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    stream = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(content)), 1 << 18)
    while line := stream.readline():
        if line == b"\r\n":
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        fields = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            key, _, value = line.decode().partition(":")
            fields[key.lower()] = value.strip()
        yield fields, stream.read(int(fields["content-length"]))


WARC_ROWS = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("record_id", pa.string()), ("refers_id", pa.string())])


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row per response or revisit. A response whose payload doesn't match its digest is an error."""
    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for content in batch.column("content"):
                for fields, block in parse_warc(content.as_py()):
                    if fields["warc-type"] not in ("response", "revisit"):
                        continue
                    head, payload = http_parts(block)
                    digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:"))
                    if fields["warc-type"] == "response" and hashlib.sha1(payload).digest() != digest:
                        raise ValueError(f"payload of {fields['warc-record-id']} differs from its digest")
                    number = http_field(head, b"x-page-id")
                    size = len(payload) if fields["warc-type"] == "response" else int(http_field(head, b"content-length"))
                    yield None if number is None else int(number), size, digest.hex(), fields["warc-type"], fields["warc-record-id"], fields.get("warc-refers-to")

    return read_archives(spark, path).mapInArrow(lambda batches: in_batches(records(batches), WARC_ROWS), "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, record_id string, refers_id string")


def archive_pages(pages: DataFrame, least: int = 1000) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` read back from WARC files that were converted from ARC."""
    spark = pages.sparkSession
    arc, warc = new_folder(spark, "arc"), new_folder(spark, "warc")
    write_arc(pages, arc)
    convert_arc(spark, arc, warc, least)
    rows = materialise(read_warc(spark, warc), "warc-rows")
    named = rows.where("record_type = 'response'").select(F.col("record_id").alias("refers_id"), F.col("page_id").alias("refers_to"))
    again = rows.where("record_type = 'revisit'").join(named, "refers_id")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return again.select(columns).unionByName(rows.where("record_type = 'response'").withColumn("refers_to", F.lit(None).cast("bigint")).select(columns))
