"""WARC archives compressed with a Zstandard dictionary.

An archive is a skippable frame that holds a dictionary trained on the archive's own first records, then
one Zstandard frame per record, so that each record can be read alone by its offset. Of pages with equal
payloads the one with the smallest id is a response; the others are revisits that refer to it.
Archives are rows of a table, one whole file of bounded size in each; export() puts them out as files.

Defined cases: null html counts as empty; a null url becomes urn:page:<id>; line breaks in a url are escaped. A null
page id is larger than any other, and revisits of a group without ids refer to none. Rows that repeat the smallest page id of a
payload are all responses; other rows are read by their columns alone, whatever else the table has. A long page is one record of an archive
of its own size. An empty table gives no archive. Where too few records exist for training, the dictionary frame holds an empty dictionary and frames stand alone.
"""

from __future__ import annotations

import base64
import hashlib
import os
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard as zstd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenant.llm.common import stored, table

#: Fixed values of the format: magic numbers of the dictionary's skippable frame and of ordinary frames.
SKIPPABLE, FRAME = 0x184D2A5D, 0xFD2FB528
DICTIONARY_BYTES = 32 << 10
#: The dictionary is trained on the first records of an archive, up to these bounds.
TRAIN_RECORDS, TRAIN_BYTES = 200, 1 << 20
ARCHIVE_BYTES = 8 << 20
LEVEL = 3
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _uri(url: str | None, page: int | None) -> str:
    return "".join(c if c > " " else f"%{ord(c):02X}" for c in url) if url else f"urn:page:{page}"


def record(page: int | None, url: str | None, payload: bytes, revisit: bool, refers_to: int | None, digest: str, date: str = DATE) -> bytes:
    """A response or revisit record; a revisit keeps the HTTP header, with the payload's length, but no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page is None else page}>", f"WARC-Date: {date}", f"WARC-Target-URI: {_uri(url, page)}", f"WARC-Payload-Digest: sha1:{digest}"]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", *([f"WARC-Refers-To: <urn:page:{refers_to}>"] if refers_to is not None else [])]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC header, HTTP header and payload of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    warc = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(warc["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a record doesn't end where its length says")
    http, _, payload = block.partition(b"\r\n\r\n")
    return warc, dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:]), payload


class Archive:
    """Gathers records, trains the dictionary on the first of them, and compresses each one by itself."""

    def __init__(self):
        self.waiting: list[bytes] = []
        self.held = self.n = 0
        self.out: list[bytes] = []
        self.size = 0
        self.compressor: zstd.ZstdCompressor | None = None

    def add(self, rec: bytes) -> None:
        self.n += 1
        if self.compressor is None:
            self.waiting.append(rec)
            self.held += len(rec)
            if len(self.waiting) >= TRAIN_RECORDS or self.held >= TRAIN_BYTES:
                self._open()
        else:
            self._put(self.compressor.compress(rec))

    def _put(self, data: bytes) -> None:
        self.out.append(data)
        self.size += len(data)

    def _open(self) -> None:
        try:
            d = zstd.train_dictionary(DICTIONARY_BYTES, self.waiting)
        except zstd.ZstdError:  # too few or too small records to learn from
            d = None
        content = d.as_bytes() if d else b""
        self._put(struct.pack("<II", SKIPPABLE, len(content)) + content)
        self.compressor = zstd.ZstdCompressor(level=LEVEL, dict_data=d, write_checksum=True) if d else zstd.ZstdCompressor(level=LEVEL, write_checksum=True)
        for rec in self.waiting:
            self._put(self.compressor.compress(rec))
        self.waiting = []

    def close(self) -> bytes:
        if self.compressor is None:
            self._open()
        return b"".join(self.out)


def frame_end(data: memoryview, at: int) -> int:
    """Where the Zstandard frame at a place ends, by its block headers."""
    d = data[at + 4]
    single, fcs = d >> 5 & 1, d >> 6
    pos = at + 5 + (1 - single) + (0, 1, 2, 4)[d & 3] + ((single, 2, 4, 8)[fcs])
    last = 0
    while not last:
        b = int.from_bytes(data[pos : pos + 3], "little")
        last, kind, size = b & 1, b >> 1 & 3, b >> 3
        pos += 3 + (1 if kind == 1 else size)
    return pos + 4 * (d >> 2 & 1)


def records(content: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(offset, compressed bytes, record) of each record of an archive."""
    view = memoryview(content)
    magic, size = struct.unpack_from("<II", content)
    if magic != SKIPPABLE:
        raise ValueError("the archive doesn't begin with a dictionary frame")
    at = 8 + size
    reader = zstd.ZstdDecompressor(dict_data=zstd.ZstdCompressionDict(content[8:at])) if size else zstd.ZstdDecompressor()
    while at < len(content):
        if struct.unpack_from("<I", content, at)[0] != FRAME:
            raise ValueError("no record frame")
        end = frame_end(view, at)
        yield at, end - at, reader.decompress(view[at:end])
        at = end


def with_revisits(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0) -> DataFrame:
    """page, url, payload, revisit, refers_to. Only payload digests that occur more than once are joined back."""
    rows = pages.select(F.col(page_id).cast("long").alias("page"), F.col(url).alias("url"), F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8").alias("payload")).withColumn("key", F.when(F.length("payload") >= min_bytes, F.sha1("payload")))
    many = rows.filter("key is not null").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("page").alias("first")).filter("n > 1").select("key", "first")
    # a stored table: the join below then shuffles both sides itself, and Spark can split a digest that many pages share
    return rows.join(stored(many, "warc-digests"), "key", "left").select("page", "url", "payload", (F.col("first").isNotNull() & ~F.col("page").eqNullSafe(F.col("first"))).alias("revisit"), F.when(~F.col("page").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))


def write_warc(rows: DataFrame) -> DataFrame:
    """archive, n_records, content: whole files of about ARCHIVE_BYTES at most, from the rows of with_revisits()."""

    def run(batches):
        part, number, archive = TaskContext.get().partitionId(), 0, Archive()

        def done():
            return pa.RecordBatch.from_pydict({"archive": [f"part-{part:06d}-{number:04d}.warc.zst"], "n_records": pa.array([archive.n], pa.int64()), "content": pa.array([archive.close()], pa.binary())})

        for batch in batches:
            for page, url, payload, revisit, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                archive.add(record(page, url, payload, revisit, refers_to, digest_of(payload)))
                if archive.size + archive.held >= ARCHIVE_BYTES:
                    yield done()
                    number, archive = number + 1, Archive()
        if archive.n:
            yield done()

    return rows.mapInArrow(run, "archive string, n_records long, content binary")


def read_warc(archives: DataFrame) -> DataFrame:
    """A row for each record; the payload of responses is checked against its digest."""
    schema = "archive string, offset long, size int, page long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
    names = [c.split()[0] for c in schema.split(", ")]
    types = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]

    def page_of(uri: str) -> int | None:
        n = uri.removeprefix("<urn:page:").removesuffix(">")
        return int(n) if n else None

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                out: list[tuple] = []
                for at, size, data in records(content.as_py()):
                    warc, http, payload = parse(data)
                    digest, revisit = warc["WARC-Payload-Digest"].removeprefix("sha1:"), warc["WARC-Type"] == "revisit"
                    if not revisit and digest_of(payload) != digest:
                        raise ValueError(f"{name}: the payload at {at} fails its digest")
                    out.append((name, at, size, page_of(warc["WARC-Record-ID"]), warc["WARC-Target-URI"], warc["WARC-Type"], page_of(warc["WARC-Refers-To"]) if "WARC-Refers-To" in warc else None, int(http["Content-Length"]), digest, None if revisit else payload))
                    if len(out) == 512:
                        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
                        out = []
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    return archives.select("archive", "content").mapInArrow(run, schema)


def export(archives: DataFrame, folder: str) -> None:
    """Write every archive as a file of a folder that all executors mount."""

    def put(rows):
        os.makedirs(folder, exist_ok=True)
        for r in rows:
            with open(f"{folder}/.{r['archive']}.{os.getpid()}", "wb") as f:
                f.write(r["content"])
            os.replace(f.name, f"{folder}/{r['archive']}")

    archives.select("archive", "content").foreachPartition(put)


def op7_warc(spark, sf_dir):
    """Contract query: every page is archived, and the archives are read back."""
    archives = stored(write_warc(with_revisits(table(spark, sf_dir, "pages"))), "warc")
    return read_warc(archives).select(F.col("page").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


_B32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_CHARS = " || ".join(f"substr('{_B32}', ((('0x' || substr(h, {5 * i + 1}, 5))::INTEGER >> {s}) & 31) + 1, 1)" for i in range(8) for s in (15, 10, 5, 0))
OP7_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
d AS (SELECT page_id, strlen(t) AS payload_bytes, sha1(t) AS h FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first_id FROM d)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, {_CHARS} AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM f
"""
