"""WARC archives: captures written as request, response and metadata records, read back and joined into one row each.

Of captures with equal payloads of at least `smallest` bytes, the one with the smallest page_id is
written as a response and the others as revisits that refer to it. Request and metadata records
name their response in WARC-Concurrent-To; reading back, that header brings a capture's records
together again, in one aggregation by the identifier.

Archives are written by Spark's text writer (a record holds UTF-8 text only, and records end in
two line breaks), so they land in whatever file system the path names. Compressed ones are read as a
stream of pieces between double line breaks, which the records' lengths put together again: a
reading task holds a record and a batch, whatever the size of the file. (One gzip member holds a
file, as the writer makes it; members of a record each are read as well.) An uncompressed archive
could be split inside a record, so it is read whole.

Groups of equal payloads may be hot. Each is dealt over SALTS parts by a hash of the row: a part's
smallest row first, then the smallest of at most SALTS, and the rows meet it in their part. The way
back from revisits to their response does the same.

Defined results: a null html is an empty payload; a null url is empty, and line breaks in it are
percent-encoded; a null page_id comes after all others; rows that repeat page_id, url and html are
one capture, told once for each row, and rows that repeat only a page_id are captures of their own
(ties: the smaller url is the response); payloads of any length are written whole; an empty table
gives no rows; further columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from isoloom.runtime import ARROW_BYTES, ARROW_ROWS, prepare, scratch, written

#: Records of one archive file at most (three a capture).
FILE_RECORDS = 900
#: Parts of a group of equal payloads.
SALTS = 64
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # RFC 4122's namespace of URLs
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "record_id string, type string, concurrent_to string, refers_to string, target_uri string, content_type string, payload_digest string, payload_bytes long, measured_digest string, payload binary"


def record_id(page_id: int | None, url: str, sha: str, kind: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'{kind}/{page_id}/{sha}/{url}')}>"


def digest(payload: bytes) -> str:
    """Base32 of SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, id_: str, block: str, **headers: str) -> str:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {id_}", f"WARC-Date: {DATE}"]
    lines += [f"{k.replace('_', '-')}: {v}" for k, v in headers.items()]
    return "\r\n".join([*lines, f"Content-Length: {len(block.encode())}", "", block])


def capture(page_id: int | None, url: str, html: str, copies: int, first_id: int | None, first_url: str) -> list[str]:
    """A page's three records; `first` is the capture of its payload that is the response."""
    payload = html.encode()
    sha = digest(payload)
    ours = lambda kind: record_id(page_id, url, sha, kind)
    target = url.replace("\r", "%0D").replace("\n", "%0A")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    common = {"WARC_Target_URI": target, "WARC_Payload_Digest": f"sha1:{sha}", "Content_Type": "application/http;msgtype=response"}
    if (page_id, url) == (first_id, first_url):
        response = record("response", ours("response"), http + html, **common)
    else:
        response = record("revisit", ours("response"), http, WARC_Refers_To=record_id(first_id, first_url, sha, "response"), WARC_Profile=PROFILE, **common)
    beside = {"WARC_Concurrent_To": ours("response"), "WARC_Target_URI": target}
    host = target.split("//", 1)[-1].split("/", 1)[0]
    request = record("request", ours("request"), f"GET {target} HTTP/1.1\r\nHost: {host}\r\n\r\n", **beside, Content_Type="application/http;msgtype=request")
    fields = f"copies: {copies}\r\n" + (f"page_id: {page_id}\r\n" if page_id is not None else "")
    return [request, response, record("metadata", ours("metadata"), fields, **beside, Content_Type="application/warc-fields")]


def _salt(*columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(SALTS)).cast("int")


def write(pages: DataFrame, path: str, smallest: int = 0, compression: str = "gzip") -> None:
    """Write the captures of (page_id, url, html) as archives under `path`."""
    prepare(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("sha", F.unhex(F.sha1(F.col("html").cast("binary")))).withColumn("salt", _salt("page_id", "url"))
    key = F.struct(F.col("page_id").isNull().alias("last"), "page_id", "url")
    parts = rows.groupBy("sha", "salt").agg(F.min(key).alias("first"))
    first = parts.withColumn("first", F.min("first").over(Window.partitionBy("sha")))
    small = F.octet_length("html") < smallest
    # Pages are dealt out once: the union of equal rows and the join both keep that.
    both = rows.repartition("sha", "salt").groupBy("sha", "salt", "page_id", "url").agg(F.first("html").alias("html"), F.count("*").alias("copies")).join(first, ["sha", "salt"])
    named = both.select("page_id", "url", "html", "copies", F.when(small, F.col("page_id")).otherwise(F.col("first.page_id")).alias("first_id"), F.when(small, F.col("url")).otherwise(F.col("first.url")).alias("first_url"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*(batch.column(c) for c in ("page_id", "url", "html", "copies", "first_id", "first_url")), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(capture(*(x.as_py() for x in row)), pa.string())], names=["value"])

    records = named.mapInArrow(run, "value string")
    records.write.mode("overwrite").option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", FILE_RECORDS).option("compression", compression).text(path)


END = b"\r\n\r\n"


class Parser:
    """Puts records together from an archive's pieces between double line breaks, one piece after another."""

    def __init__(self):
        self.buffer = bytearray()
        self.headers: dict[str, str] | None = None

    def feed(self, piece: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
        """The records that end with this piece: headers (names in lower case) and block."""
        self.buffer += piece
        self.buffer += END
        while True:
            if self.headers is None:
                start = len(self.buffer) - len(self.buffer.lstrip(b"\r\n"))
                del self.buffer[:start]
                end = self.buffer.find(END)
                if end < 0:
                    return
                lines = self.buffer[:end].decode().split("\r\n")
                if not lines[0].startswith("WARC/"):
                    raise ValueError(f"no WARC record: {lines[0][:40]!r}")
                self.headers = {k.lower(): v.strip() for k, v in (x.split(":", 1) for x in lines[1:])}
                del self.buffer[: end + len(END)]
            want = int(self.headers["content-length"])
            if len(self.buffer) < want + len(END):
                return
            headers, self.headers = self.headers, None
            block = bytes(self.buffer[:want])
            del self.buffer[:want]
            yield headers, block

    def end(self) -> None:
        if self.headers is not None or self.buffer.strip(b"\r\n"):
            raise ValueError("a record ends early")


def parsed(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of a whole archive."""
    parser = Parser()
    for piece in (gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data).split(END):
        yield from parser.feed(piece)
    parser.end()


def read(spark: SparkSession, path: str, payloads: bool = True, compressed: bool = True) -> DataFrame:
    """The records of all archives under `path`, as RECORD; without `payloads` their bytes are measured and dropped."""
    prepare(spark)
    names = [x.split()[0] for x in RECORD.split(", ")]
    kinds = [pa.string()] * 7 + [pa.int64(), pa.string(), pa.binary()]

    def row(h: dict[str, str], block: bytes) -> tuple:
        kind = h["warc-type"]
        payload = block.split(END, 1)[-1] if "application/http" in h.get("content-type", "") else block
        own = kind != "revisit"
        return (h["warc-record-id"], kind, h.get("warc-concurrent-to"), h.get("warc-refers-to"), h.get("warc-target-uri"), h.get("content-type"), h.get("warc-payload-digest", "").removeprefix("sha1:") or None, len(payload) if own else None, digest(payload) if kind == "response" else None, payload if own and (payloads or kind == "metadata") else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser, rows, size = Parser(), [], 0
        made = lambda: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
        for batch in batches:
            for piece in batch.column("value"):
                for one in [piece.as_py()] if compressed else piece.as_py().split(END):
                    for found in parser.feed(one):
                        rows.append(row(*found))
                        size += len(rows[-1][-1] or b"")
                    if len(rows) >= ARROW_ROWS or size >= ARROW_BYTES:
                        yield made()
                        rows, size = [], 0
        parser.end()
        if rows:
            yield made()

    if compressed:
        pieces = spark.read.option("lineSep", END.decode()).text(path).select(F.col("value").cast("binary").alias("value"))
    else:
        pieces = spark.read.format("binaryFile").load(path).select(F.col("content").alias("value"))
    return pieces.mapInArrow(run, RECORD)


def assembled(records: DataFrame) -> DataFrame:
    """One row per capture: its response (or revisit), requests and metadata, nested, joined through their identifiers.

    A revisit's size is that of the response it refers to.
    """
    part = F.struct("record_id", "type", "refers_to", "target_uri", "payload_digest", "payload_bytes", "measured_digest", "payload")
    side = F.struct("record_id", "target_uri", "payload")
    captures = records.groupBy(F.coalesce("concurrent_to", "record_id").alias("capture_id")).agg(
        F.max(F.when(F.col("type").isin("response", "revisit"), part)).alias("response"),
        F.sort_array(F.collect_list(F.when(F.col("type") == "request", side))).alias("requests"),
        F.sort_array(F.collect_list(F.when(F.col("type") == "metadata", side))).alias("metadata"),
    )
    return captures.where("response IS NOT NULL")


def digests(pages: DataFrame) -> DataFrame:
    """Write every page, read the archives back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    spark = pages.sparkSession
    path = scratch(spark, "warc")
    write(pages, path)
    captures = assembled(read(spark, path, payloads=False))
    field = lambda name: F.expr(f"CAST(regexp_extract(CAST(metadata[0].payload AS string), '{name}: ([0-9-]+)', 1) AS string)")
    number = lambda name: F.when(field(name) != "", field(name).cast("long"))
    rows = captures.select("capture_id", number("page_id").alias("page_id"), number("copies").alias("copies"), F.col("response.type").alias("record_type"), F.col("response.refers_to").alias("target"), F.col("response.payload_bytes").alias("bytes"), F.col("response.measured_digest").alias("digest"))
    rows = written(rows, "captures")
    whole = rows.where("record_type = 'response'")
    again = rows.where("record_type = 'revisit'").select("page_id", "copies", "target", _salt("capture_id").alias("salt"))
    parts = again.select("target", "salt").distinct().join(whole.select(F.col("capture_id").alias("target"), "bytes", "digest", F.col("page_id").alias("refers_to")), "target")
    both = whole.select("page_id", "copies", "bytes", "digest", "record_type", F.lit(None).cast("long").alias("refers_to")).unionByName(again.join(parts, ["target", "salt"], "left").select("page_id", "copies", "bytes", "digest", F.lit("revisit").alias("record_type"), "refers_to"))
    each = both.withColumn("copies", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return each.select("page_id", F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to")
