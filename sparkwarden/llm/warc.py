"""WARC revisit resolution.

Headers (id, payload digest, payload size) are shuffled by digest; of the records that share a payload, the one
with the largest id stays a response and all others become revisits that refer to it. What is known of revisits (id,
digest, the response's id) goes back to the pages: by broadcast where a count bounds it, else by a shuffle on the id,
which no group of equal payloads makes uneven. Deduplicated archives are written with fresh headers, and read back.

An archive is a folder of gzipped WARC/1.1 files: Spark's text writer puts one record in a row, and the two
line ends that close a record are its row separator, so that writing goes through Spark to any store. Files are bounded
by bytes: records of up to LARGE bytes share files of FILE_BYTES at most, and larger ones have files of their own,
sized by the largest. Reading goes by Content-Length, since payloads may hold any bytes that text may, and inflates a
file as a stream, a record at a time.

Defined cases: a null payload is empty; a null url is the empty string; a null id takes part as the id -1;
repeated rows of the id that stays are all responses; payloads of any size are written and read whole; an empty table
gives archives without records; extra input columns are not carried over.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lookup, scratch_path, small, table, written

#: Bytes of payload a file may hold, of a payload that shares a file, and of headers for a record at most, about.
FILE_BYTES, LARGE, HEAD_BYTES = 256 << 20, 1 << 20, 4096
#: Revisits that are broadcast: two numbers and a digest each.
REVISITS = 500_000
_END = "\r\n\r\n"
_FIELDS = "page_id bigint, url string, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint, payload binary"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: Column) -> Column:
    """SHA-1 in upper-case base 32 (RFC 4648): four runs of 40 bits in base 32, then the standard's digits."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _record_id(page: Column) -> Column:
    h = F.md5(F.concat(F.lit("record:"), page.cast("string")).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def resolved(pages: DataFrame, **options) -> DataFrame:
    """page_id, url, body, payload_digest, payload_bytes, record_type and refers_to of each row."""
    return _resolved(pages, **options)[0]


def _resolved(pages: DataFrame, page: str = "page_id", url: str = "url", payload: str = "html", least_bytes: int = 0) -> tuple[DataFrame, int]:
    """resolved(), and the bytes of the largest payload."""
    body = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    rows = pages.select(
        F.coalesce(F.col(page).cast("long"), F.lit(-1)).alias("page_id"), F.regexp_replace(F.coalesce(F.col(url).cast("string"), F.lit("")), r"[\r\n]", "").alias("url"),
        body.alias("body"), base32_sha1(body).alias("payload_digest"), F.octet_length(body).cast("long").alias("payload_bytes"),
    )
    heads = written(rows.select("page_id", "payload_digest", "payload_bytes"), "headers")
    total, most = heads.agg(F.count("*"), F.max("payload_bytes")).first()
    heads = heads.where(F.col("payload_bytes") >= least_bytes)
    groups = heads.groupBy("payload_digest").agg(F.max("page_id").alias("_kept"), F.count("*").alias("_n")).where("_n > 1")
    groups = written(groups, "groups")
    met = lookup(heads.select("page_id", F.col("payload_digest")), groups, "payload_digest", "_n", total)
    revisits = met.where(F.col("page_id") != F.col("_kept")).select(F.col("page_id").alias("_page"), F.col("payload_digest").alias("_digest"), "_kept").distinct()
    revisits = small(written(revisits, "revisits"), REVISITS)
    marked = rows.join(revisits, (F.col("page_id") == F.col("_page")) & (F.col("payload_digest") == F.col("_digest")), "left")
    out = marked.select(
        "page_id", "url", "body", "payload_digest", "payload_bytes", F.when(F.col("_kept").isNull(), "response").otherwise("revisit").alias("record_type"),
        F.col("_kept").alias("refers_to"),
    )
    return out, most or 0


def write_archives(records: DataFrame, path: str, date: str = "2000-01-01T00:00:00Z", most: int | None = None) -> None:
    """resolved() rows as WARC files below path. most: bytes of the largest payload, if known."""
    c = F.col
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), c("payload_bytes").cast("string"), F.lit(_END))
    refers = F.when(c("refers_to").isNotNull(), F.concat(F.lit("WARC-Profile: " + _PROFILE + "\r\nWARC-Refers-To: "), _record_id(c("refers_to")), F.lit("\r\nX-Refers-To-Page: "), c("refers_to").cast("string"), F.lit("\r\n"))).otherwise(F.lit(""))
    stored = F.when(c("record_type") == "response", c("body").cast("string")).otherwise(F.lit(""))
    size = F.octet_length(http) + F.when(c("record_type") == "response", c("payload_bytes")).otherwise(F.lit(0))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), c("record_type"), F.lit("\r\nWARC-Record-ID: "), _record_id(c("page_id")), F.lit(f"\r\nWARC-Date: {date}\r\nWARC-Target-URI: "), c("url"),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), c("payload_digest"), F.lit("\r\n"), refers, F.lit("X-Page: "), c("page_id").cast("string"),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), size.cast("string"), F.lit(_END),
    )
    rows = records.select(F.concat(head, http, stored).alias("value"), c("payload_bytes"))
    write = lambda df, most, name: df.select("value").write.option("lineSep", _END).option("maxRecordsPerFile", max(1, FILE_BYTES // (most + HEAD_BYTES))).option("compression", "gzip").text(f"{path}/{name}")
    write(rows.where(c("payload_bytes") <= LARGE), LARGE, "records")
    most = most if most is not None else records.agg(F.max("payload_bytes")).first()[0] or 0
    if most > LARGE:
        write(rows.where(c("payload_bytes") > LARGE), most, "large")


class _Inflated:
    """The bytes of a file, gzipped or not, that are read but not taken yet."""

    def __init__(self, data: bytes, step: int = 1 << 20):
        self.data, self.at, self.step, self.left = memoryview(data), 0, step, bytearray()
        self.inflate = zlib.decompressobj(31) if bytes(data[:2]) == b"\x1f\x8b" else None

    def more(self) -> bool:
        if self.at >= len(self.data):
            return False
        part = bytes(self.data[self.at : self.at + self.step])
        self.at += len(part)
        while part and self.inflate is not None:
            self.left += self.inflate.decompress(part)
            part = self.inflate.unused_data if self.inflate.eof else b""
            if self.inflate.eof:
                self.inflate = zlib.decompressobj(31)  # the next member
        self.left += part
        return True

    def until(self, mark: bytes) -> int:
        """Where the mark is, or -1 at the end of the file."""
        start = 0
        while (k := self.left.find(mark, start)) < 0:
            start = max(0, len(self.left) - len(mark) + 1)
            if not self.more():
                return -1
        return k

    def take(self, n: int) -> bytes:
        while len(self.left) < n and self.more():
            pass
        out = bytes(self.left[:n])
        del self.left[:n]
        return out


def parsed(data: bytes) -> Iterator[tuple[dict[str, str], dict[str, str], bytes]]:
    """Records of a WARC file, gzipped (in one or many members) or not: WARC headers, HTTP headers, payload."""
    rest, before = _Inflated(data), 0
    while rest.left or rest.more():
        if not rest.left:
            continue
        end = rest.until(b"\r\n\r\n")
        lines = rest.take(max(end, 0)).decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record after record {before}")
        head = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
        size = int(head["Content-Length"])
        block = rest.take(4 + size + 4)
        if len(block) < size + 8:
            raise ValueError(f"record {before} is cut off")
        cut = block.index(b"\r\n\r\n", 4)
        http = dict(x.split(": ", 1) for x in block[4:cut].decode("latin-1").split("\r\n")[1:] if ": " in x)
        yield head, http, block[cut + 4 : 4 + size]
        before += 1


#: Bytes of payload in a batch of records that are read.
_BATCH = 16 << 20


def _reader(with_payload: bool):
    names = [f.split()[0] for f in _FIELDS.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, kinds, strict=True)], names)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                rows, held = [], 0
                for h, http, p in parsed(content.as_py()):
                    kept = p if with_payload and h["WARC-Type"] == "response" else None
                    refers = int(h["X-Refers-To-Page"]) if "X-Refers-To-Page" in h else None
                    rows.append((int(h["X-Page"]), h["WARC-Target-URI"], h["WARC-Type"], int(http["Content-Length"]), h["WARC-Payload-Digest"].removeprefix("sha1:"), refers, kept))
                    held += len(kept or b"") + 200
                    if held > _BATCH:
                        yield batch(rows)
                        rows, held = [], 0
                yield batch(rows)

    return read


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Records of the WARC files below path; payload is null for revisits, or for all if not asked for."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(path)
    return files.select("content").mapInArrow(_reader(with_payload), _FIELDS)


def deduplicate_archives(pages: DataFrame, path: str | None = None, with_payload: bool = False) -> DataFrame:
    """Write deduplicated archives (to path, or the shared scratch folder) and return what they hold."""
    spark = pages.sparkSession
    path = path or scratch_path(spark, "warc")
    records, most = _resolved(pages)
    write_archives(records, path, most=most)
    return read_archives(spark, path, with_payload)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return deduplicate_archives(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_CHUNK = "('0x' || substr(h, {0}, 5))::BIGINT"
_DIGITS = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (({_CHUNK.format(1 + 5 * k)} >> {s}) & 31)::INT, 1)" for k in range(8) for s in (15, 10, 5, 0))
ORACLE = f"""
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
k AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS kept FROM p)
SELECT page_id, payload_bytes, {_DIGITS} AS payload_digest, CASE WHEN page_id = kept THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> kept THEN kept END AS refers_to
FROM k
"""
