"""WARC archives: a writer with revisit records and a splittable reader.

The writer sends each row to a record, one gzip member each. Rows whose payload another row has become revisit records
that name it. A task writes one file under a name of its own and reports it; only files that finished tasks report are
read, so a task that ran twice leaves no record twice.

The reader cuts files into byte ranges. A task looks for the gzip magic from its range's start, takes a candidate only
if it decodes to a WARC header, and owns the records that start inside its range, reading past its end for the last.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from digestlake.llm.common import file_system, partitions, prepared, scratch, text_of, written

MAGIC = b"\x1f\x8b\x08"
SPLIT_BYTES = 8 << 20
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
#: Fixed value: the WARC 1.1 profile of revisit records by payload digest.
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _plain(value: str) -> str:
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One record as a gzip member."""
    block = _HTTP if revisit else _HTTP + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}"]
    if page_id is not None:
        head.append(f"WARC-Record-ID: <urn:page:{page_id}>")
    if url is not None:
        head.append(f"WARC-Target-URI: {_plain(url)}")
    head.append("WARC-Date: 1970-01-01T00:00:00Z")
    head.append(f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}")
    if revisit:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    raw = "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def write_warc(pages: DataFrame, out_dir: str, least_bytes: int = 0) -> list[tuple[str, int, int]]:
    """Write a record per row of (page_id, url, html); return (path, bytes, records) of each file.

    Of rows with equal payloads of at least least_bytes bytes those with the largest page_id are responses and the
    others revisit them; smaller payloads are all responses. Null html is an empty payload, a null url has no header.
    Null page_ids count as smallest and have no record id; if only such rows share a payload, all are responses.
    """
    spark = prepared(pages)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), text_of("html").alias("html"))
    rows = rows.withColumn("sha", F.unhex(F.sha1(F.col("html").cast("binary"))))
    shared = rows.where(F.octet_length("html") >= least_bytes).groupBy("sha").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1 and refers_to is not null")
    shared = written(shared.drop("n"), "warc-shared")  # the join's inputs are then plain exchanges, which can be split
    revisit = F.col("refers_to").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("refers_to"))
    if least_bytes:
        shared = shared.withColumnRenamed("sha", "s")
        joined = rows.join(shared, (rows["sha"] == shared["s"]) & (F.octet_length("html") >= least_bytes), "left")
    else:
        joined = rows.join(shared, "sha", "left")
    marked = joined.select("page_id", "url", "html", "refers_to", revisit.alias("revisit"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = file_system(out_dir)
        path = f"{top}/{uuid.uuid4().hex}.warc.gz"
        out, size, n = None, 0, 0
        try:
            for b in batches:
                for page_id, url, html, refers_to, again in zip(*(b.column(k).to_pylist() for k in range(5))):
                    if out is None:
                        fs.create_dir(top, recursive=True)
                        out = fs.open_output_stream(path, compression=None)  # the name would make it gzip again
                    raw = record(page_id, url, html.encode("utf-8", "surrogatepass"), refers_to, again)
                    out.write(raw)
                    size, n = size + len(raw), n + 1
        finally:
            if out is not None:
                out.close()
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([path.rpartition("/")[2]]), pa.array([size]), pa.array([n])], ["file", "bytes", "records"])

    found = marked.mapInArrow(scan, "file string, bytes long, records long").collect()  # a row per task
    return [(f"{out_dir.rstrip('/')}/{r[0]}", r[1], r[2]) for r in found]


def _headers(raw: bytes) -> tuple[dict[str, str], int] | None:
    """The header fields and where the block starts, if raw begins with a whole WARC header."""
    if not raw.startswith(b"WARC/"):
        return None
    end = raw.find(b"\r\n\r\n")
    if end < 0:
        return None
    lines = raw[:end].decode("utf-8", "surrogateescape").split("\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    return (fields, end + 4) if fields.get("content-length", "").isdigit() and "warc-type" in fields else None


class _Window:
    """Bytes of a file from an offset on, read in steps."""

    def __init__(self, file, start: int, step: int):
        self.file, self.base, self.data, self.step, self.over = file, start, b"", step, False
        file.seek(start)

    def more(self) -> bool:
        got = b"" if self.over else self.file.read(self.step)
        self.over = not got
        self.data += got
        return bool(got)

    def drop(self, upto: int) -> None:
        if upto - self.base > 4 * self.step:
            self.data, self.base = self.data[upto - self.base :], upto

    def find(self, at: int, before: int) -> int | None:
        """The first offset of the magic from at on that is below before."""
        while True:
            k = self.data.find(MAGIC, max(0, at - self.base))
            if k >= 0:
                return self.base + k if self.base + k < before else None
            at = max(at, self.base + len(self.data) - 2)
            if at >= before or not self.more():
                return None

    def member(self, at: int) -> tuple[bytes, int] | None:
        """The decoded member at an offset and where it ends; None if it is no WARC record."""
        unpack, out, used, checked = zlib.decompressobj(31), [], at, False
        while not unpack.eof:
            if used - self.base >= len(self.data) and not self.more():
                return None
            some = self.data[used - self.base : used - self.base + (1 << 16)]
            try:
                out.append(unpack.decompress(some))
            except zlib.error:
                return None
            used += len(some)
            if not checked and (have := sum(map(len, out))) >= 5:
                if not b"".join(out).startswith(b"WARC/"):
                    return None
                checked = have > 0
        return b"".join(out), used - len(unpack.unused_data)


def records_in(file, start: int, end: int, step: int = 1 << 20) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, header fields, block) of the records that start in [start, end)."""
    window = _Window(file, start, step)
    at = window.find(start, end)
    while at is not None:
        got = window.member(at)
        head = _headers(got[0]) if got else None
        if head is None or head[1] + int(head[0]["content-length"]) > len(got[0]):
            at = window.find(at + 1, end)
            continue
        fields, block = head
        yield at, fields, got[0][block : block + int(fields["content-length"])]
        window.drop(got[1])
        at = window.find(got[1], end)


def _page(urn: str | None) -> int | None:
    tail = (urn or "").strip("<>").rpartition(":")[2]
    return int(tail) if tail.lstrip("-").isdigit() else None


def read_warc(spark: SparkSession, files: list[tuple[str, int]], split_bytes: int = SPLIT_BYTES, with_payload: bool = True) -> DataFrame:
    """A row per record of the files (path, bytes): path, offset, record_type, page_id, url, refers_to, digest, bytes, payload.

    digest is the header's; a response whose payload does not hash to it fails the read. bytes and payload are those of
    the payload behind the HTTP header, null for revisits; payload is null too unless with_payload. No files give no rows.
    """
    schema = "path string, offset long, record_type string, page_id long, url string, refers_to long, digest string, bytes long, payload binary"
    ranges = spark.createDataFrame([(p, n) for p, n in files], "path string, size long")
    ranges = ranges.select("path", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(split_bytes).cast("long"))).alias("start"))
    count = sum(-(-n // split_bytes) for _, n in files)
    prepared(ranges)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("record_type", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("refers_to", pa.int64()), ("digest", pa.string()), ("bytes", pa.int64()), ("payload", pa.binary())])
        for b in batches:
            for path, size, start in zip(*(b.column(k).to_pylist() for k in range(3))):
                fs, at = file_system(path)
                rows, held = [], 0
                with fs.open_input_file(at) as file:
                    for offset, fields, block in records_in(file, start, min(size, start + split_bytes)):
                        kind = fields["warc-type"]
                        digest = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
                        payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
                        if payload is not None and digest and base32_sha1(payload) != digest:
                            raise ValueError(f"the payload of the record at {offset} in {path} does not match its digest")
                        rows.append((path, offset, kind, _page(fields.get("warc-record-id")), fields.get("warc-target-uri"), _page(fields.get("warc-refers-to")), digest, None if payload is None else len(payload), payload if with_payload else None))
                        held += len(block)
                        if held > 16 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    return ranges.repartition(max(1, min(count, 4 * partitions(spark)))).mapInArrow(scan, schema)


def resolved(records: DataFrame) -> DataFrame:
    """records with bytes of revisits taken from the responses that they refer to."""
    found = records.where("record_type = 'response' and page_id is not null").groupBy("page_id").agg(F.max("bytes").alias("own_bytes")).withColumnRenamed("page_id", "own_id")
    out = records.join(found, (F.col("record_type") == "revisit") & (F.col("refers_to") == F.col("own_id")), "left")
    return out.withColumn("bytes", F.coalesce("bytes", "own_bytes")).drop("own_id", "own_bytes")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    files = write_warc(pages, scratch(spark, "warc"))
    records = written(read_warc(spark, [(p, n) for p, n, _ in files], with_payload=False).drop("payload", "path", "url"), "warc-records")
    return resolved(records).select("page_id", F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to")
