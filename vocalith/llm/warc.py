"""WARC archives written and read by Spark's own file readers, and the chunked record table."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vocalith.llm.common import cut, shared_dir, small_enough, table

#: Bytes of payload that one record, and so one row, holds; longer payloads go on in continuation records.
CHUNK = 1 << 20
#: Tables of shared digests up to this many rows are broadcast.
BROADCAST_DIGESTS = 100_000
END = "\r\n\r\n"
SCHEMA = "page_id bigint, record_id string, chunk int, start long, data binary, last boolean, payload_bytes long, payload_digest string, record_type string, refers_to bigint, digest_ok boolean"


def base32_sha1(data: Column) -> Column:
    """SHA-1 of a binary column in upper-case base32: five hex digits are four of base 32."""
    hexed = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(hexed, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def records(pages: DataFrame, chunk: int = CHUNK, least: int = 0, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """The text of every WARC record, one row a record (column ``value``).

    Of the rows whose payloads of at least ``least`` bytes are equal, those with the largest page_id are responses and
    the others revisit it. Only digests and ids are grouped for that. Digests that several rows
    share are broadcast if few, else joined by shuffle, where a digest of many rows may be split. A row whose page_id is null revisits if any equal
    payload has an id, and is a response else; repeated rows of the largest id are responses all. Payloads longer than
    ``chunk`` bytes become a first record and continuation records with segment numbers, in order and in one file.
    """
    rows = pages.select(
        F.col(key).cast("long").alias("page_id"),
        F.regexp_replace(F.coalesce(F.col(url), F.lit("")), r"[\r\n]", "").alias("url"),
        F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8").alias("payload"),
    ).withColumn("digest", base32_sha1(F.col("payload")))
    top = rows.where(F.octet_length("payload") >= least).groupBy("digest").agg(F.max("page_id").alias("top"), F.count(F.lit(1)).alias("_n"))
    top = cut(top.where("_n > 1").select(F.col("digest").alias("_digest"), "top"), "warc-shared")
    side = F.broadcast(top) if small_enough(top, BROADCAST_DIGESTS) else top
    rows = rows.join(side, F.col("digest") == F.col("_digest"), "left").drop("_digest")
    rows = rows.withColumn("revisit", F.coalesce(~F.col("page_id").eqNullSafe(F.col("top")) & F.col("top").isNotNull(), F.lit(False)))
    size, ident = F.octet_length("payload"), lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    http = lambda n: F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), n.cast("string"), F.lit(END))
    rows = rows.withColumn("size", size).withColumn("http", http(size)).withColumn("url", F.when(F.col("url") == "", "urn:none").otherwise(F.col("url")))
    common = lambda kind, length: F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: " + kind + "\r\nWARC-Record-ID: "), ident(F.col("page_id")) if kind != "continuation" else F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("null")), F.lit(":"), (F.col("i") + 1).cast("string"), F.lit(">")),
        F.lit("\r\nWARC-Target-URI: "), F.col("url"), F.lit("\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nContent-Type: application/http; msgtype=response\r\nWARC-Payload-Digest: sha1:"), F.col("digest"), F.lit("\r\nContent-Length: "), length.cast("string"),
    )
    visit = F.concat(common("revisit", F.octet_length("http")), F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), ident(F.col("top")), F.lit(END), F.col("http"))
    # only a number of each chunk is listed; its bytes are cut out when its row is made
    p = rows.where(~F.col("revisit")).select("page_id", "url", "digest", "http", "size", "payload", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("size") / chunk) - 1, F.lit(0).cast("long")))).alias("i"))
    p = p.withColumns({"data": F.substring("payload", (F.col("i") * chunk + 1).cast("int"), F.lit(chunk)), "more": F.col("size") > (F.col("i") + 1) * chunk}).drop("payload")
    body = F.octet_length("data")
    number = F.when((F.col("i") > 0) | F.col("more"), F.concat(F.lit("\r\nWARC-Segment-Number: "), (F.col("i") + 1).cast("string"))).otherwise(F.lit(""))
    first = F.concat(common("response", F.octet_length("http") + body), number, F.lit(END), F.col("http"))
    later = F.concat(common("continuation", body), number, F.lit("\r\nWARC-Segment-Origin-ID: "), ident(F.col("page_id")), F.when(~F.col("more"), F.concat(F.lit("\r\nWARC-Segment-Total-Length: "), (F.octet_length("http") + F.col("size")).cast("string"))).otherwise(F.lit("")), F.lit(END))
    kept = p.select(F.concat(F.when(F.col("i") == 0, first).otherwise(later).cast("binary"), F.col("data")).cast("string").alias("value"))
    return kept.union(rows.where("revisit").select(visit.alias("value")))


def write(pages: DataFrame, folder: str, **options) -> None:
    """Archives under ``folder`` in any file system that Spark writes; a record's end is the writer's line separator."""
    records(pages, **options).write.option("lineSep", END).option("compression", "gzip").text(folder)


class _Reader:
    """Parses one archive from the pieces between blank lines, holding one piece and the open record's running digest."""

    def __init__(self):
        self.buffer, self.state, self.origin = b"", "head", None

    def upto(self, n: int, skip: int = 0) -> bytes:
        found, self.buffer = self.buffer[:n], self.buffer[n + skip :]
        return found

    def feed(self, piece: bytes) -> Iterator[tuple]:
        """A blank line stood behind every piece; which bytes are payload is decided by Content-Length alone."""
        end = END.encode()
        self.buffer += piece + end
        while True:
            if self.state == "head":
                if (n := self.buffer.find(end)) < 0:
                    return
                lines = self.upto(n, len(end)).decode("utf-8", "replace").split("\r\n")
                if not lines[0].startswith("WARC/"):
                    raise ValueError(f"not the head of a WARC record: {lines[0][:60]!r}")
                self.head = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
                if not {"content-length", "warc-type"} <= self.head.keys():
                    raise ValueError(f"the archive ends within a record, or its head lacks a field: {lines}")
                self.left, self.kind = int(self.head["content-length"]), self.head["warc-type"]
                self.state = "http" if self.kind in ("response", "revisit") else "body"
            if self.state == "http":
                n = self.buffer.find(end)
                if n < 0 and len(self.buffer) < self.left:
                    return
                n = self.left if n < 0 or n + len(end) > self.left else n
                skip = min(len(end), self.left - n)
                self.http, self.left, self.state = self.upto(n, skip), self.left - n - skip, "body"
            if self.state == "body":
                data = self.upto(min(len(self.buffer), self.left))
                self.left -= len(data)
                if self.kind in ("response", "continuation") and (data or not self.left):
                    yield from self.payload(data, not self.left)
                if self.left:
                    return
                if self.kind == "revisit":
                    size = int(re.search(rb"(?i)content-length:\s*(\d+)", self.http)[1])
                    digest, ident = self.head["warc-payload-digest"].removeprefix("sha1:"), self.head["warc-record-id"]
                    yield (self.page(ident), ident, 0, 0, b"", True, size, digest, "revisit", self.page(self.head["warc-refers-to"]), None)
                self.state = "tail"
            if len(self.buffer) < len(end):
                return
            if self.upto(len(end)) != end:
                raise ValueError("a record doesn't end where its Content-Length says")
            self.state = "head"

    def close(self) -> None:
        """At the archive's end: fails if it stops within a record, or before the last segment of one."""
        if self.state != "head" or self.buffer.strip() or self.origin is not None:
            raise ValueError(f"the archive ends within a record: {(self.origin or [self.buffer[:60]])[0]!r}")

    def page(self, ident: str) -> int | None:
        found = re.match(r"<urn:page:(-?\d+)", ident)
        return int(found[1]) if found else None

    def payload(self, data: bytes, ends: bool) -> Iterator[tuple]:
        head = self.head
        first = head["warc-type"] == "response"
        if first and self.origin is None:
            self.origin = (head["warc-record-id"], hashlib.sha1(), head["warc-payload-digest"].removeprefix("sha1:"))
            self.chunk = self.start = 0
        ident, sha, told = self.origin
        sha.update(data)
        last = ends and ("warc-segment-number" not in head or "warc-segment-total-length" in head)
        digest = base64.b32encode(sha.digest()).decode() if last else None
        yield (self.page(ident), ident, self.chunk, self.start, data, last, self.start + len(data), digest, "response", None, digest == told if last else None)
        self.chunk, self.start = self.chunk + 1, self.start + len(data)
        if last:
            self.origin = None


def read(spark: SparkSession, folder: str, data: bool = True) -> DataFrame:
    """The chunked record table: rows (record_id, chunk) with ``data`` (left empty if not wanted), where the chunk starts,
    the bytes so far, and on the last chunk the digest that was carried along. Compressed archives are read whole by one
    task, as a stream of pieces: no record is ever in memory at once. A digest that differs from the written one is told in ``digest_ok``;
    an archive that ends within a record fails the query.
    """
    lines = spark.read.option("lineSep", END).text(folder).select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"))
    schema = pa.schema([("page_id", pa.int64()), ("record_id", pa.string()), ("chunk", pa.int32()), ("start", pa.int64()), ("data", pa.binary()), ("last", pa.bool_()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("digest_ok", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, reader = None, None
        for b in batches:
            files = b.column(1)
            same = len(files) and files[0].as_py() == files[len(files) - 1].as_py()
            names = [files[0].as_py()] * len(files) if same else files.to_pylist()
            out: list[tuple] = []
            for piece, name in zip(b.column(0), names):
                if name != at:
                    if reader:
                        reader.close()
                    at, reader = name, _Reader()
                out += [r if data else (*r[:4], b"", *r[5:]) for r in reader.feed(piece.as_buffer().to_pybytes())]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
        if reader:
            reader.close()

    return lines.mapInArrow(run, SCHEMA)


def op3_warc_chunk_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/vocalith/warc-{uuid.uuid4().hex}"
    write(table(spark, sf_dir, "pages"), folder)
    return read(spark, folder, data=False).where("last").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "digest_ok")
