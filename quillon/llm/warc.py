"""WARC archives: records written from payload rows, read back as rows of chunks that carry running digests."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, stored

CHUNK = 1 << 20
#: Payloads under so many bytes are always written in full.
LEAST_REVISIT = 1000
#: Up to so many revisits (48 bytes each) are sent to every task; more are joined.
BROADCAST_ROWS = 250_000
MARK = b"WARC/1.1\r\n"
CHUNKS = "path string, ordinal long, record_id string, chunk_no long, is_last boolean, bytes_so_far long, sha1_so_far string, chunk binary, headers map<string,string>"


def local(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a shared folder's URI, on whichever machine this runs."""
    return pyarrow.fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", path) if ":" in path else f"file://{path}")


def header(kind: str, record: str, url: str, length: int, digest: bytes, whole: int, refers: str | None) -> bytes:
    own = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", f"<urn:quillon:{record}>"),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Target-URI", re.sub(r"[\r\n]", "", url)),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(digest).decode()),
        ("X-Payload-SHA1", digest.hex()),
        ("X-Payload-Length", str(whole)),
        ("Content-Type", "text/html"),
        ("Content-Length", str(length)),
    ]
    if refers is not None:
        own[5:5] = [("WARC-Refers-To", f"<urn:quillon:{refers}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    return MARK + "".join(f"{k}: {v}\r\n" for k, v in own).encode() + b"\r\n"


def gzip_member(pieces: Iterator[bytes], level: int) -> Iterator[bytes]:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    for p in pieces:
        if got := z.compress(p):
            yield got
    yield z.flush()


def record(head: bytes, payload: memoryview | bytes, chunk: int) -> Iterator[bytes]:
    yield head
    for a in range(0, len(payload), chunk):
        yield payload[a : a + chunk]
    yield b"\r\n\r\n"


def write(rows: DataFrame, folder: str, level: int = 3, chunk: int = CHUNK) -> DataFrame:
    """Writes rows (id, url, payload string, refers string or null) as gzipped archives; gives (path, records).

    A task writes one archive, a gzip member for each record, under a name of its own, so that a repeated task
    leaves at most a file that no row names. Nulls in url count as empty, in payload as no bytes.
    """

    def work(batches):
        fs, base = local(folder)
        fs.create_dir(base, recursive=True)
        name, n, out = f"{base}/{uuid.uuid4().hex}.warc.gz", 0, None
        for b in batches:
            for i, url, text, refers in zip(*(b.column(c).to_pylist() for c in ("id", "url", "payload", "refers"))):
                out = out or fs.open_output_stream(name, compression=None)
                payload = (text or "").encode()
                kind = "response" if refers is None else "revisit"
                body = payload if refers is None else b""
                head = header(kind, str(i), url or "", len(body), hashlib.sha1(payload).digest(), len(payload), refers)
                for piece in gzip_member(record(head, memoryview(body), chunk), level):
                    out.write(piece)
                n += 1
        if out:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n])], names=["path", "records"])

    return stored(rows.select(F.col("id").cast("string").alias("id"), "url", "payload", "refers").mapInArrow(work, "path string, records long"), "archives")


class Archive:
    """A stream of inflated bytes out of a file of gzip members, held a block at a time."""

    def __init__(self, file, block: int):
        self.file, self.block, self.held, self.inflate, self.raw = file, block, b"", None, b""

    def more(self) -> bool:
        while True:
            if not self.raw:
                self.raw = self.file.read(self.block)
                if not self.raw:
                    return False
            self.inflate = self.inflate or zlib.decompressobj(31)
            got = self.inflate.decompress(self.raw, self.block)
            self.raw = self.inflate.unconsumed_tail
            if self.inflate.eof:
                self.raw, self.inflate = self.inflate.unused_data, None
            if got:
                self.held += got
                return True

    def head(self) -> dict[str, str] | None:
        while b"\r\n\r\n" not in self.held:
            if not self.more():
                if self.held:
                    raise ValueError("an archive ends inside a record's header")
                return None
        own, _, self.held = self.held.partition(b"\r\n\r\n")
        lines = own.decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
        return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}

    def take(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.held and not self.more():
                raise ValueError("an archive ends inside a record's payload")
            got, self.held = self.held[:n], self.held[n:]
            n -= len(got)
            yield got


@dataclass
class Chunk:
    ordinal: int
    record_id: str
    number: int
    last: bool
    size: int
    sha1: str
    data: bytes
    headers: dict[str, str] | None


def chunks(file, chunk: int = CHUNK, payloads: bool = True) -> Iterator[Chunk]:
    """The records of an archive in chunks of about `chunk` bytes, each with the size and digest of all up to its end."""
    archive, ordinal = Archive(file, min(chunk, 1 << 16)), 0
    while (h := archive.head()) is not None:
        name, left = re.sub(r"^<|>$", "", h.get("warc-record-id", "")), int(h["content-length"])
        sha, size, number, held, waiting = hashlib.sha1(), 0, 0, [], 0
        for piece in archive.take(left):
            sha.update(piece)
            size += len(piece)
            held += [piece] * payloads
            waiting += len(piece)
            if waiting >= chunk and size < left:
                yield Chunk(ordinal, name, number, False, size, sha.hexdigest(), b"".join(held), h if number == 0 else None)
                held, number, waiting = [], number + 1, 0
        yield Chunk(ordinal, name, number, True, size, sha.hexdigest(), b"".join(held), h if number == 0 else None)
        if b"".join(archive.take(4)) != b"\r\n\r\n":
            raise ValueError("a record doesn't end with two line ends")
        ordinal += 1


def read(archives: DataFrame, folder: str, chunk: int = CHUNK, payloads: bool = True) -> DataFrame:
    """The chunk table (see CHUNKS) of the archives (path). A record's headers stand in its chunk 0; payloads=False
    leaves the chunks' bytes out but keeps their sizes and digests."""

    def work(batches):
        fs, _ = local(folder)
        kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.string(), pa.binary(), pa.map_(pa.string(), pa.string()))
        names = ["path", "ordinal", "record_id", "chunk_no", "is_last", "bytes_so_far", "sha1_so_far", "chunk", "headers"]

        def batch(path, own):
            cols = zip(*((path, c.ordinal, c.record_id, c.number, c.last, c.size, c.sha1, c.data, list(c.headers.items()) if c.headers else None) for c in own))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

        for b in batches:
            for path in b.column("path").to_pylist():
                with fs.open_input_stream(path, compression=None) as file:
                    own, size = [], 0
                    for c in chunks(file, chunk, payloads):
                        own.append(c)
                        size += len(c.data)
                        if size >= chunk or len(own) >= 4096:
                            yield batch(path, own)
                            own, size = [], 0
                    if own:
                        yield batch(path, own)

    spread = archives.select("path").repartition(max(1, archives.sparkSession.sparkContext.defaultParallelism * 4))
    return spread.mapInArrow(work, CHUNKS)


def with_digest(rows: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """rows (payload) with the payload's SHA-256, null where the payload has fewer bytes than a revisit needs."""
    b = F.col("payload").cast("binary")
    return rows.withColumn("digest", F.when(F.octet_length("payload") >= least, F.unhex(F.sha2(b, 256))))


def revisits(rows: DataFrame) -> DataFrame:
    """(id, digest, refers) of the rows (id, digest) whose payload also belongs to a larger id, one for each payload of
    an id. Counted before the shuffle, so a payload of many rows is one row of each task."""
    own = rows.where("digest is not null")
    first = own.groupBy("digest").agg(F.max("id").alias("refers"), F.min("id").alias("low")).where("low < refers").drop("low")
    return own.select("id", "digest").distinct().join(first, "digest").where("id < refers").select("id", "digest", "refers")


def op3_warc(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to for every row of pages, off its archives.

    Of equal payloads of at least 1000 bytes the largest page_id is written in full and the others refer to it;
    repeated rows of that page are full as well. A page_id may come with several payloads, each of which is judged
    by itself: there are as many records as rows. Null html is an empty payload; a row with a null page_id is a
    full record with a null page_id. Other columns are not read; an empty table gives no rows.
    """
    spark = pages.sparkSession
    rows = with_digest(pages.select(F.col("page_id").alias("id"), "url", F.col("html").alias("payload")))
    again = stored(revisits(rows), "revisits")
    n = again.count()
    again = F.broadcast(again) if n <= BROADCAST_ROWS else again
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    archives = write(rows.join(again, ["id", "digest"], "left").withColumn("refers", F.col("refers").cast("string")), folder)
    got = read(archives, folder, payloads=False)
    # a record's headers are in its first chunk, its size and digest in its last: for most that is the same row
    whole = got.where("is_last and chunk_no = 0").select("record_id", "headers", "bytes_so_far", "sha1_so_far")
    long = got.where("is_last <> (chunk_no = 0)").groupBy("path", "ordinal", "record_id")
    every = whole.unionByName(long.agg(F.first("headers", True).alias("headers"), F.max("bytes_so_far").alias("bytes_so_far"), F.max_by("sha1_so_far", "chunk_no").alias("sha1_so_far")).drop("path", "ordinal"))
    page = pages.schema["page_id"].dataType.simpleString()
    number = lambda c: F.expr(f"try_cast(nullif(regexp_extract(coalesce({c}, ''), 'urn:quillon:(-?[0-9]+)', 1), '') as {page})")
    full = F.col("headers")["warc-type"] == "response"
    return every.select(
        number("record_id").alias("page_id"),
        F.when(full, F.col("bytes_so_far")).otherwise(F.col("headers")["x-payload-length"].cast("long")).alias("payload_bytes"),
        F.when(full, F.col("sha1_so_far")).otherwise(F.col("headers")["x-payload-sha1"]).alias("payload_digest"),
        F.col("headers")["warc-type"].alias("record_type"),
        number("headers['warc-refers-to']").alias("refers_to"),
    )
