"""WARC archives over a content-addressed payload store.

Writing: every payload is digested (SHA-256); of equal payloads that are long enough one record is the response and the
others become revisit records that name it and carry no payload. Records leave Spark as WARC/1.1 files, gzipped.

Reading: archives are parsed into two tables. `payloads` holds the bytes of each digest once, verified against the
digest in the record's header; `headers` holds every record's exact header bytes with its digest. `reconstruct` joins the
two back into the original records.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_dir, table

#: Payloads shorter than this are stored with every record.
SHORTEST_SHARED = 100
#: Bytes of payload and records of one file at most (but for a single larger payload): a file is the unit that a reading task takes.
FILE_BYTES, RECORDS_A_FILE = 128_000_000, 2_000

PARSED = "record_id string, header binary, record_type string, digest string, payload binary, payload_bytes long, verified boolean, file string, position long"
CRLF = "\r\n"


def digest(payload: Column) -> Column:
    return F.sha2(payload, 256)


def plan_records(docs: DataFrame, shortest: int = SHORTEST_SHARED) -> DataFrame:
    """(record_id long, uri string, payload binary, ...) -> the same with payload_bytes, digest, record_type, refers_to.

    A null payload is empty. Of equal payloads of at least `shortest` bytes the smallest record_id is the response (every
    row of that id, if rows repeat) and the others are revisits of it; a null record_id is never the response unless all
    are null. Counting copies combines on the map side, so a payload that a third of all rows share is no hot group;
    the join back is left to adaptive skew handling.
    """
    own = docs.withColumn("payload", F.coalesce("payload", F.lit(b""))).withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("digest", digest(F.col("payload")))
    shared = own.filter(F.col("payload_bytes") >= shortest).groupBy("digest").agg(F.min("record_id").alias("first_id"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    joined = own.join(shared, "digest", "left")
    again = F.col("first_id").isNotNull() & ~F.col("record_id").eqNullSafe(F.col("first_id"))
    return joined.withColumn("record_type", F.when(again, "revisit").otherwise("response")).withColumn("refers_to", F.when(again, F.col("first_id"))).drop("first_id")


def _name(record_id: Column) -> Column:
    return F.concat(F.lit("<urn:causeway:record:"), F.coalesce(record_id.cast("string"), F.lit("null")), F.lit(">"))


def header(records: DataFrame) -> Column:
    """The record's header as text, with the empty line that ends it. Line breaks in a URI are percent-encoded."""
    uri = F.regexp_replace(F.regexp_replace(F.coalesce("uri", F.lit("")), "\r", "%0D"), "\n", "%0A")
    revisit = F.col("record_type") == "revisit"
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.col("record_type")),
        F.concat(F.lit("WARC-Record-ID: "), _name(F.col("record_id"))),
        F.lit("WARC-Date: 1970-01-01T00:00:00Z"),
        F.concat(F.lit("WARC-Target-URI: "), uri),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), _name(F.col("refers_to")))),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.when(revisit, F.lit(0).cast("long")).otherwise(F.col("payload_bytes")).cast("string")),
    ]
    return F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF + CRLF))


def size_classes(largest: int, file_bytes: int = FILE_BYTES, records_a_file: int = RECORDS_A_FILE) -> list[tuple[int, int, int]]:
    """(least, most, records of a file) of classes of payload sizes up to the largest, so that no file holds more bytes than it may."""
    out, low, high = [], 0, max(1, file_bytes // records_a_file)
    while low <= largest:
        out.append((low, high, max(1, file_bytes // high)))
        low, high = high + 1, 4 * high
    return out


def write_archives(records: DataFrame, path: str, file_bytes: int = FILE_BYTES, largest: int | None = None) -> None:
    """records from plan_records -> gzipped WARC files. Each record ends with two line breaks, which the text writer puts after every row; bytes pass unchanged.

    Payloads of a size class share files, and a class with larger payloads has fewer records to a file; most corpora are
    one class. largest: bytes of the largest payload, if known. A file is one gzip stream, so records are read in order.
    """
    if largest is None:
        largest = records.agg(F.max("payload_bytes")).first()[0] or 0
    block = F.when(F.col("record_type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    classes = size_classes(largest, file_bytes)
    for low, high, most in classes:
        own = records if len(classes) == 1 else records.filter(F.col("payload_bytes").between(low, high))
        rows = own.select(F.concat(header(own).cast("binary"), block).cast("string").alias("value"))
        rows.write.option("lineSep", CRLF + CRLF).option("compression", "gzip").option("maxRecordsPerFile", most).text(f"{path}/from-{low}-bytes")


_FIELD = re.compile(rb"^([A-Za-z-]+):[ \t]*(.*?)\r?$", re.M)


def _records(data: bytes) -> Iterator[tuple[int, bytes, bytes]]:
    """(position, exact header bytes, block) of each record of an unzipped archive."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at byte {at}")
        head = data[at : end + 4]
        long = next((int(v) for k, v in _FIELD.findall(head) if k.lower() == b"content-length"), None)
        if long is None or end + 4 + long > len(data):
            raise ValueError(f"WARC record at byte {at} is cut off or has no length")
        yield at, head, data[end + 4 : end + 4 + long]
        at = end + 4 + long
        while data.startswith(b"\r\n", at):
            at += 2


def _unzipped(data: bytes) -> bytes:
    """All gzip members, one after another; plain archives as they are."""
    out = []
    while data[:2] == b"\x1f\x8b":
        z = zlib.decompressobj(31)
        out.append(z.decompress(data) + z.flush())
        data = z.unused_data
    return b"".join(out) + data


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ("record_id", "header", "record_type", "digest", "payload", "payload_bytes", "verified", "file", "position")
    kinds = (pa.string(), pa.binary(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.bool_(), pa.string(), pa.int64())
    for batch in batches:
        for file, content in zip(batch.column("path"), batch.column("content"), strict=True):
            rows: list[tuple] = []
            size = 0
            for position, head, block in _records(_unzipped(content.as_py())):
                field = {k.lower(): v.decode() for k, v in _FIELD.findall(head)}
                said = field.get(b"warc-payload-digest", "").removeprefix("sha256:")
                kind = field.get(b"warc-type", "")
                stored = kind != "revisit"
                own = hashlib.sha256(block).hexdigest() if stored else said
                rows.append((field.get(b"warc-record-id", ""), head, kind, own, block if stored else None, len(block) if stored else None, own == said, file.as_py(), position))
                size += len(block) + len(head)
                if size > 16_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """WARC files (gzipped or not) -> PARSED, a row per record. A file that isn't WARC or is cut off raises."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).filter("length > 0").select("path", "content")
    return files.mapInArrow(_parse, PARSED)


def store(parsed: DataFrame, path: str) -> None:
    """Writes `payloads` (digest, payload, payload_bytes: each digest once) and `headers` (record_id, header, record_type, digest, file, position).

    Payloads whose bytes don't have the digest that their header states are refused: the job fails.
    """
    sound = F.when(F.col("verified"), F.col("digest")).otherwise(F.raise_error(F.concat(F.lit("payload digest differs in "), "record_id")))
    rows = parsed.withColumn("digest", sound)
    rows.select("record_id", "header", "record_type", "digest", "file", "position").write.parquet(f"{path}/headers")
    kept = rows.filter("payload IS NOT NULL").groupBy("digest").agg(F.first("payload").alias("payload"))
    kept.withColumn("payload_bytes", F.octet_length("payload").cast("long")).write.option("compression", "zstd").parquet(f"{path}/payloads")


def reconstruct(spark: SparkSession, path: str) -> DataFrame:
    """The original records: record_id, record_type, header, digest, payload, record (header and block with the closing line breaks, as archived)."""
    headers, payloads = spark.read.parquet(f"{path}/headers"), spark.read.parquet(f"{path}/payloads")
    block = F.when(F.col("record_type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    return headers.join(payloads, "digest", "left").withColumn("record", F.concat("header", block, F.lit(b"\r\n\r\n")))


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages through archives and back: page_id, payload_bytes, payload_digest, record_type, refers_to, all read from the archives.

    Length and digest are those of the stored bytes that the join finds, computed again once per stored payload.
    """
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("record_id"), F.col("url").alias("uri"), F.encode("html", "UTF-8").alias("payload"))
    at = fresh_dir(spark, "warc")
    largest = pages.agg(F.max(F.octet_length("payload"))).first()[0] or 0
    write_archives(plan_records(pages), f"{at}/archives", largest=largest)
    store(read_archives(spark, f"{at}/archives"), f"{at}/store")
    payloads = spark.read.parquet(f"{at}/store/payloads").select("digest", digest(F.col("payload")).alias("payload_digest"), F.octet_length("payload").cast("long").alias("payload_bytes"))
    headers = spark.read.parquet(f"{at}/store/headers").select("record_id", "record_type", "digest", F.regexp_extract(F.decode("header", "UTF-8"), "\r\nWARC-Refers-To: <urn:causeway:record:(-?\\d+)>\r\n", 1).alias("refers"))
    refers = F.when(F.col("record_type") == "revisit", F.col("refers").try_cast("long"))  # a URL may hold such a field, but no line break
    return headers.join(payloads, "digest", "left").select(F.regexp_extract("record_id", "record:(-?\\d+)>", 1).try_cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", refers.alias("refers_to"))
