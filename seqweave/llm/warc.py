"""WARC archives without repeated payloads: writing with revisit records, reading, and resolving revisits.

Digests are made where the pages are; only headers are shuffled by digest to
find the original of each payload that stands more than once. Records are text
up to their payload, so Spark's text writer makes the archives: each value is a
record, and the line separator the two line ends that close it. They are read as
binary files and parsed by their Content-Length.
"""

from __future__ import annotations

import hashlib
import io
import uuid
import zlib
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqweave.session import cut_lineage, shared_folder

#: Payloads of fewer bytes are always written whole; records of one archive file at most.
LEAST, RECORDS = 1000, 20_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

READ = "record_id string, record_type string, target_uri string, page_id bigint, refers_to_id string, " \
       "named_digest string, payload_digest string, payload_bytes bigint"


def originals(headers: DataFrame, least: int = LEAST) -> DataFrame:
    """digest, original: the largest page_id among records of one payload digest, where there is more than one."""
    return headers.where(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(
        F.max("page_id").alias("original"), F.count("*").alias("n")
    ).where("n > 1").select(F.col("payload_digest").alias("digest"), "original")


def _record_id(page, digest):
    h = F.md5(F.concat_ws(" ", F.coalesce(page.cast("string"), F.lit("-")), digest))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def records(pages: DataFrame, least: int = LEAST, date: str | None = None) -> DataFrame:
    """One WARC record a page as text (column ``value``, without its closing line ends).

    Of records with equal payloads of at least ``least`` bytes the one with the largest page_id (null is smallest) is
    a response, the others are revisits of it; rows that repeat it with its page_id are responses like it. A null html
    is an empty payload; a null url leaves out the target; other columns are not read.
    """
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload"))
    rows = rows.withColumn("payload_digest", F.sha1(F.col("payload").cast("binary")))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("bigint"))
    first = originals(rows.select("page_id", "payload_digest", "payload_bytes"), least)
    rows = rows.join(first, F.col("payload_digest") == F.col("digest"), "left")
    revisit = F.col("digest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("original"))
    uri = F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20")

    def line(name, value):
        return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))).otherwise(F.lit(""))

    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.col("payload_bytes").cast("string"), F.lit("\r\n\r\n"))
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("payload")))
    own = _record_id(F.col("page_id"), F.col("payload_digest"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", own),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", uri),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        line("WARC-Refers-To", F.when(revisit, _record_id(F.col("original"), F.col("payload_digest")))),
        line("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        line("Page-ID", F.col("page_id").cast("string")),
        line("Content-Type", F.lit("application/http;msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
    )
    return rows.select(F.concat(head, F.lit("\r\n"), block).alias("value"))


def write_archives(pages: DataFrame, folder: str, least: int = LEAST, most: int = RECORDS) -> None:
    """Write the records of ``pages`` as gzip-compressed WARC files into a new folder that executors share."""
    records(pages, least).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option(
        "maxRecordsPerFile", most
    ).text(folder)


def parsed(content: bytes):
    """Yield (headers by lower-cased name, block) of every record of one WARC file, compressed or not.

    A file that ends within a record, or with a line where a record should begin, is an error.
    """
    data = b""
    if content[:2] == b"\x1f\x8b":
        parts, rest = [], content
        while rest:
            member = zlib.decompressobj(31)
            parts.append(member.decompress(rest))
            if not member.eof:
                raise ValueError("compressed archive ends early")
            rest = member.unused_data
        data = b"".join(parts)
    else:
        data = content
    file = io.BytesIO(data)
    while version := file.readline():
        if not version.startswith(b"WARC/"):
            raise ValueError(f"no record begins with {version[:40]!r}")
        headers: dict[str, str] = {}
        while (line := file.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        size = int(headers["content-length"])
        block = file.read(size)
        if len(block) != size or file.read(4) != b"\r\n\r\n":
            raise ValueError("archive ends within a record")
        yield headers, block


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """One row a record of the archives in a folder; digest and size are taken from the payload as it stands there."""

    def work(batches):
        for batch in batches:
            for content in batch.column(0):
                out = []
                for headers, block in parsed(content.as_py()):
                    payload = block.partition(b"\r\n\r\n")[2]
                    page = headers.get("page-id")
                    out.append((
                        headers.get("warc-record-id"), headers.get("warc-type"), headers.get("warc-target-uri"),
                        None if page is None else int(page), headers.get("warc-refers-to"),
                        headers.get("warc-payload-digest", "").removeprefix("sha1:"),
                        hashlib.sha1(payload).hexdigest(), len(payload),
                    ))
                names = [c.split()[0] for c in READ.split(", ")]
                kinds = [pa.int64() if c.endswith("bigint") else pa.string() for c in READ.split(", ")]
                columns = list(zip(*out, strict=True)) or [[] for _ in names]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(folder)
    return files.select("content").mapInArrow(work, READ)


def resolved(read: DataFrame) -> DataFrame:
    """One row a record: page_id, payload_bytes, payload_digest, record_type, refers_to, target_uri.

    Revisits take size and digest from the response that they refer to, met by digest and record id; one that refers
    to no response in the archives keeps nulls.
    """
    whole = read.where("record_type <> 'revisit'")
    told = whole.select(F.col("record_id").alias("id"), F.col("payload_digest").alias("d"),
                        F.col("payload_bytes").alias("size"), F.col("page_id").alias("original"))
    told = told.where("size > 0").dropDuplicates(["d", "id"])
    again = read.where("record_type = 'revisit'").join(
        told, (F.col("named_digest") == F.col("d")) & (F.col("refers_to_id") == F.col("id")), "left"
    )
    return whole.select(
        "page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("bigint").alias("refers_to"), "target_uri"
    ).unionByName(again.select(
        "page_id", F.col("size").alias("payload_bytes"), F.col("d").alias("payload_digest"), "record_type",
        F.col("original").alias("refers_to"), "target_uri",
    ))


def round_trip(pages: DataFrame, folder: str | None = None, least: int = LEAST) -> DataFrame:
    """Write the pages as archives (into a new shared folder unless one is given), read these, and resolve revisits."""
    spark = pages.sparkSession
    folder = folder or f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, folder, least)
    return resolved(cut_lineage(read_archives(spark, folder)))
