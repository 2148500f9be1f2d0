"""WARC archives with revisit resolution.

Headers alone (key, payload digest, length, url) are grouped by digest to find the original of each payload, the row with the smallest
key, and joined back to find the revisits; the grouping is partially aggregated, and the join's skew is split by adaptive
execution. Few revisits are broadcast, and no payload moves; of many, a bitmap of fixed size is, and only payloads that may be revisits are
shuffled to meet their marks.

Records get fresh headers and are compressed one by one, each a gzip member of its own, so that readers can start at any of them. They go out
through Spark's text writer, so archives can lie in any store that Spark writes to: the writer ends a row with a zero byte, and so does a
gzip member of less than 16 MB (an empty one follows those that don't). A file starts with a warcinfo record and ends after ``volume``
bytes, or with the record that exceeds them.

Archives are read back record by record, by Content-Length, and the digest of every stored payload is computed again; revisits are
then joined with the responses they refer to. A revisit without its response is an error.

Defined results: a null payload is empty; a null key is written without an identifier and is always a response; rows that repeat
both key and payload of an original are responses like it; payloads under ``least_bytes`` are never revisits; control characters and
blanks in a url become %20; an empty table gives no archives and no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MOST_IDS, fresh_path, map_rows, materialise, maybe_among

VOLUME = 64 << 20
MARK_BYTES = 32 << 20
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(data: Column) -> Column:
    """SHA-1 in base 32: each five hexadecimal digits are four letters."""
    digits = F.sha1(data)
    letters = []
    for group in range(8):
        value = F.conv(F.substring(digits, 5 * group + 1, 5), 16, 10).cast("int")
        letters += [F.substr(F.lit(_BASE32), F.shiftright(value, shift).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for shift in (15, 10, 5, 0)]
    return F.concat(*letters)


def revisits(headers: DataFrame, least_bytes: int = 0) -> DataFrame:
    """From rows of (key, check, bytes, url): key, check, and key and url of the original of those that repeat another's payload."""
    large = headers.filter(F.col("bytes") >= least_bytes).select("key", "check", "url")
    first = F.min(F.when(F.col("key").isNotNull(), F.struct("key", "url"))).alias("first")
    groups = large.groupBy("check").agg(first, F.count("*").alias("n")).filter("n > 1")
    again = large.join(groups, "check").filter(F.col("key") != F.col("first.key"))
    return again.select("key", "check", F.col("first.key").alias("original"), F.col("first.url").alias("original_url")).distinct()


def _marked(rows: DataFrame, marks: DataFrame) -> DataFrame:
    """The rows with the original and its url where they are revisits; see the module's text for what moves."""
    marks = materialise(marks, "revisits")
    size = F.sum(F.octet_length("check") + F.octet_length(F.coalesce("original_url", F.lit(""))) + 24)
    n, size = marks.agg(F.count("*"), size).first()
    if n <= MOST_IDS and (size or 0) <= MARK_BYTES:
        return rows.join(F.broadcast(marks), ["key", "check"], "left")
    # rows that may be revisits, and the others; a mark is told by both of its parts
    named = rows.withColumn("token", F.concat_ws(":", F.col("key").cast("string"), F.hex("check")))
    found = maybe_among(named, F.col("token"), marks.select(F.concat_ws(":", F.col("key").cast("string"), F.hex("check")).alias("id")), flag="maybe")
    meet = found.filter("maybe").drop("maybe", "token").join(marks, ["key", "check"], "left")
    return meet.unionByName(found.filter(~F.col("maybe")).drop("maybe", "token").withColumns({c: F.lit(None).cast(marks.schema[c].dataType) for c in ("original", "original_url")}))


def _members(rows: DataFrame, volume: int) -> DataFrame:
    """(volume, value): records as gzip members without their last byte, which is zero, in volumes of bounded size."""
    info = b"software: lenticule\r\nformat: WARC File Format 1.1\r\n"
    empty = gzip.compress(b"", mtime=0)

    def member(record: bytes) -> bytes:
        packed = gzip.compress(record, 6, mtime=0)
        return (packed if packed[-1] == 0 else packed + empty)[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = -1, volume
        for batch in batches:
            numbers, values = [], []
            for value in batch.column(0):
                packed = member(value.as_py())
                if held >= volume:
                    number, held = number + 1, 0
                    first = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\nWARC-Date: {datetime.now(UTC):%Y-%m-%dT%H:%M:%SZ}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n"
                    numbers.append(number)
                    values.append(member(first.encode() + info + b"\r\n\r\n"))
                numbers.append(number)
                values.append(packed)
                held += len(packed) + 1
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(values, pa.binary())], names=["volume", "value"])

    return map_rows(rows, run, "volume int, value binary")


def write_archives(df: DataFrame, path: str, key: str = "page_id", payload: str = "html", url: str = "url", least_bytes: int = 0, volume: int = VOLUME) -> None:
    """One record for each row, as compressed WARC files under ``path``."""
    data = F.coalesce(F.col(payload).cast("string"), F.lit(""))
    rows = df.select(F.col(key).cast("string").alias("id"), F.col(key).alias("key"), F.col(url).cast("string").alias("url"), data.alias("payload"))
    rows = rows.withColumn("check", F.concat(F.unhex(F.sha1("payload")), F.unhex(F.sha2("payload", 256)))).withColumn("bytes", F.octet_length("payload"))
    marks = revisits(rows.select("key", "check", "bytes", "url"), least_bytes)
    marked = _marked(rows, marks).withColumn("digest", base32_sha1(F.col("payload")))
    again = F.col("original").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes"), F.lit("\r\n\r\n"))
    block = F.when(again, http).otherwise(F.concat(http, F.col("payload")))
    date = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    clean = lambda c: F.regexp_replace(c, r"[\x00-\x20\x7f]", "%20")

    def line(name: str, value: Column) -> Column:
        return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))).otherwise("")

    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(again, "revisit").otherwise("response")),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.col("id"), F.lit(">"))),
        line("WARC-Date", date),
        line("WARC-Target-URI", clean("url")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("original").cast("string"), F.lit(">"))),
        line("WARC-Refers-To-Target-URI", clean("original_url")),
        line("WARC-Refers-To-Date", F.when(again, date)),
        line("WARC-Profile", F.when(again, _REVISIT)),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.octet_length("block"),
        F.lit("\r\n\r\n"),
    )
    record = marked.withColumn("block", block).select(F.concat(head, F.col("block"), F.lit("\r\n\r\n")).cast("binary").alias("value"))
    _members(record, volume).select("volume", F.col("value").cast("string")).write.partitionBy("volume").option("lineSep", "\x00").text(path)


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of an archive, compressed or not."""
    stream = gzip.GzipFile(fileobj=io.BytesIO(data)) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)
    stream = io.BufferedReader(stream, 1 << 20)
    while first := stream.readline():
        if not first.strip():
            continue
        if not first.startswith(b"WARC/"):
            raise ValueError(f"a record starts with {first[:40]!r}")
        headers = {}
        while (text := stream.readline()) not in (b"\r\n", b"\n", b""):
            name, _, value = text.decode("utf-8").partition(":")
            headers[name.strip().lower()] = value.strip()
        length = int(headers["content-length"])
        block = stream.read(length)
        if len(block) != length:
            raise ValueError("a record is cut short")
        yield headers, block


def _page(identifier: str | None) -> str | None:
    return identifier.removeprefix("<urn:page:").removesuffix(">") if identifier else None


def read_archives(spark: SparkSession, path: str, key_type: str = "long") -> DataFrame:
    """One row for each record: key, url, record_type, refers_to, payload_bytes, payload_digest (of what is stored), payload."""
    names = ["key", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pack(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.string()] * 4 + [pa.int64(), pa.string(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                for head, block in records(content.as_buffer().to_pybytes()):
                    if head["warc-type"] == "warcinfo":
                        continue
                    payload = block.partition(b"\r\n\r\n")[2]
                    digest = head["warc-payload-digest"].removeprefix("sha1:")
                    if head["warc-type"] == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                        raise ValueError(f"the payload of {head.get('warc-record-id')} doesn't have its digest")
                    rows.append((_page(head.get("warc-record-id")), head.get("warc-target-uri"), head["warc-type"], _page(head.get("warc-refers-to")), len(payload), digest, payload))
                    held += len(payload)
                    if held > 8 << 20:
                        yield pack(rows)
                        rows, held = [], 0
                if rows:
                    yield pack(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(path).select("content")
    found = map_rows(files, run, "key string, url string, record_type string, refers_to string, payload_bytes long, payload_digest string, payload binary")
    return found.withColumn("key", F.col("key").cast(key_type)).withColumn("refers_to", F.col("refers_to").cast(key_type))


def resolved(found: DataFrame) -> DataFrame:
    """Records with the length and digest of the full payload: a revisit takes them from the response that it refers to."""
    slim = found.select("key", "record_type", "refers_to", "payload_bytes", "payload_digest")
    full = slim.filter("record_type = 'response'")
    once = full.groupBy(F.col("key").alias("refers_to"), "payload_digest").agg(F.max("payload_bytes").alias("full_bytes"))
    again = slim.filter("record_type = 'revisit'").drop("payload_bytes").join(once, ["refers_to", "payload_digest"], "left")
    lost = F.raise_error(F.concat(F.lit("a revisit refers to a response that is not there: "), F.col("refers_to").cast("string")))
    return full.unionByName(again.withColumn("payload_bytes", F.coalesce("full_bytes", lost.cast("long"))).drop("full_bytes"))


def archive_round_trip(df: DataFrame, key: str = "page_id", payload: str = "html", url: str = "url", least_bytes: int = 0) -> DataFrame:
    """Write archives to the shared folder, read them back and resolve the revisits."""
    spark = df.sparkSession
    path = fresh_path(spark, "warc")
    write_archives(df, path, key, payload, url, least_bytes)
    return resolved(read_archives(spark, path, df.schema[key].dataType.simpleString())).withColumnRenamed("key", key)
