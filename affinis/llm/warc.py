"""WARC archives with revisit records (operator 4).

1. Headers (page_id, payload digest, payload bytes) are made without moving payloads, grouped by digest
   (combined on the map side) and joined back: of equal payloads of at least `min_bytes`, the smallest
   page_id is the response and the others revisit it.
2. Pages get their decision by page_id and are written as WARC/1.1 records in gzip archives by Spark's text
   writer, whose commit makes retried tasks harmless. A revisit has fresh headers and no payload. Pages are
   written by classes of payload size (up to STEPS[0], STEPS[1], ... bytes; the classes that occur), each with
   so many records an archive that their payloads stay within ARCHIVE_BYTES, or one page where that is larger.
3. Archives are read back one at a time and unpacked as a stream, record by record by Content-Length, so a
   payload may hold anything, WARC headers included, and a worker holds one packed archive and one record.
   A record whose payload doesn't have its digest is an error. Revisits are then joined to their responses.

Payload digests are SHA-1 in base 32. Defined results: a record per row; null html is an empty payload; pages
with null page_id are responses with an empty id, which no other refers to; rows of one page_id with equal
payloads are all responses if that page_id is the smallest, else all revisits; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from affinis.llm.common import cut, fresh_path

MIN_BYTES = 0
#: Records in one archive at most, and bytes of their payloads (unless one alone has more).
RECORDS, ARCHIVE_BYTES = 4096, 1 << 28
#: Rows a reader hands on at once.
READ_ROWS = 1024
#: Largest payloads of the size classes but the last.
STEPS = [ARCHIVE_BYTES // RECORDS << 4 * i for i in range(4)]
#: A record's fixed header lines.
VERSION, PROFILE = "WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


def base32_sha1(data: Column) -> Column:
    """SHA-1 in bare upper-case base 32: five hex digits make four base-32 digits."""
    h = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(h, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def resolve(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """(page_id, digest, refers_to) of the pages that revisit another one."""
    html = F.coalesce(F.col("html"), F.lit(""))
    headers = pages.select("page_id", base32_sha1(F.encode(html, "utf-8")).alias("digest"), F.octet_length(html).alias("n_bytes")).where(F.col("n_bytes") >= min_bytes)
    # cut, so that the join has an exchange on either side and AQE may split a digest that many pages share
    groups = cut(headers.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").select("digest", "refers_to"))
    return headers.join(groups, "digest").where("page_id <> refers_to").select("page_id", "digest", "refers_to").distinct()


def records(pages: DataFrame, revisits: DataFrame) -> DataFrame:
    """(record): one WARC record per page, without the last of the line ends that close it."""
    revisits = revisits.select(F.col("page_id").alias("r_id"), F.col("digest").alias("r_digest"), "refers_to")
    html = F.coalesce(F.col("html"), F.lit(""))
    page = pages.select("page_id", F.coalesce(F.col("url"), F.lit("")).alias("url"), html.alias("html"), base32_sha1(F.encode(html, "utf-8")).alias("digest"))
    page = page.join(revisits, (F.col("page_id") == F.col("r_id")) & (F.col("digest") == F.col("r_digest")), "left")
    again = F.col("refers_to").isNotNull()
    uri = F.regexp_replace("url", r"[\r\n]", "")
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    head = F.concat(
        F.lit(f"{VERSION}\r\n"),
        line("WARC-Type", F.when(again, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">"))),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", uri),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(again, F.concat(line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))), line("WARC-Profile", F.lit(PROFILE)))).otherwise(""),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(again, F.lit(0)).otherwise(F.octet_length("html")).cast("string")),
        F.lit("\r\n"),
    )
    return page.select(F.concat(head, F.when(again, F.lit("")).otherwise(F.col("html")), F.lit("\r\n")).alias("record"))


def size_class(n_bytes: Column) -> Column:
    out = F.lit(0)
    for i, step in enumerate(STEPS):
        out = F.when(n_bytes > step, i + 1).otherwise(out)
    return out


def write(pages: DataFrame, path: str, min_bytes: int = MIN_BYTES) -> None:
    """Archives of the pages in `path`, a folder for each size class that occurs."""
    revisits = resolve(pages, min_bytes)
    kind = size_class(F.coalesce(F.octet_length("html"), F.lit(0)))
    classes = sorted(r[0] for r in pages.select(kind).distinct().collect())  # len(STEPS) + 1 at most
    if len(classes) > 1:
        revisits = cut(revisits)  # joined once for each class
    for c in classes or [0]:
        part = pages.where(kind == c) if len(classes) > 1 else pages
        most = max(1, ARCHIVE_BYTES // STEPS[c]) if c < len(STEPS) else 1
        records(part, revisits).write.option("lineSep", "\r\n").option("compression", "gzip").option("maxRecordsPerFile", most).text(f"{path}/size={c}")


def parse(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, payload) of the records of a gzip archive of one member or several."""
    with io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(archive)), 1 << 16) as raw:
        while version := raw.readline():
            if not version.startswith(b"WARC/"):
                raise ValueError(f"no record before byte {raw.tell()}")
            headers = {}
            while (line := raw.readline()) != b"\r\n":
                if not line:
                    raise ValueError("the archive ends within headers")
                name, value = line.decode().rstrip("\r\n").split(": ", 1)
                headers[name] = value
            payload = raw.read(int(headers["Content-Length"]))
            if len(payload) < int(headers["Content-Length"]) or raw.read(4) != b"\r\n\r\n":
                raise ValueError(f"a record ends early before byte {raw.tell()}")
            yield headers, payload


def _id(value: str | None) -> int | None:
    return int(value[10:-1]) if value and value != "<urn:page:>" else None


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes", "intact"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
    pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
    for batch in batches:
        for archive in batch.column(0):
            rows = []
            for h, payload in parse(archive.as_py()):
                if len(rows) == READ_ROWS:
                    yield pack(rows)
                    rows = []
                digest, kind = h["WARC-Payload-Digest"][5:], h["WARC-Type"]
                whole = kind == "revisit" or base64.b32encode(hashlib.sha1(payload).digest()).decode() == digest
                rows.append((_id(h["WARC-Record-ID"]), h["WARC-Target-URI"], kind, _id(h.get("WARC-Refers-To")), digest, None if kind == "revisit" else len(payload), whole))
            if rows:
                yield pack(rows)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Records of the archives: page_id, url, record_type, refers_to, payload_digest, payload_bytes (null for revisits), intact."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").option("recursiveFileLookup", "true").load(path).select("content")
    return files.mapInArrow(_read, "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, intact boolean")


def round_trip(pages: DataFrame, path: str | None = None, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Write the archives, read them back and join revisits to their responses; a record that isn't intact is an error."""
    spark = pages.sparkSession
    path = path or fresh_path(spark, "warc")
    write(pages.select("page_id", "url", "html"), path, min_bytes)
    broken = F.raise_error(F.concat(F.lit("broken record of page "), F.coalesce(F.col("page_id").cast("string"), F.lit("")))).cast("boolean")
    back = cut(read(spark, path).where(F.col("intact") | broken))
    first = cut(back.where("record_type = 'response'").groupBy("payload_digest").agg(F.max("payload_bytes").alias("full")))
    revisit = back.where("record_type = 'revisit'").join(first, "payload_digest").withColumn("payload_bytes", F.col("full")).select(back.columns)
    return back.where("record_type = 'response'").union(revisit)
