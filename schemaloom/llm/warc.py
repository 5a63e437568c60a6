"""WARC archives: a writer with one gzip member per record, and a sequential reader.

Each task writes archives of its own to the shared folder, under names that no other attempt uses; only those that a
finished task reports are read, so a lost executor leaves nothing but unread files. The reader takes an archive in
chunks, inflates one member after another, frames each record by its Content-Length and checks its digests. No
record has to fit in memory to be read, unless its payload is asked for.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from schemaloom.llm._common import attach, shared_dir, slices, table, written

#: Compressed bytes after which a task begins another archive, and those that the reader takes at a time.
ARCHIVE_BYTES, CHUNK = 256 << 20, 1 << 16
#: Bytes of archives planned for a reading task.
READ_BYTES = 128 << 20
#: Longest block of header lines that the reader accepts.
HEADER_BYTES = 1 << 20
#: WARC 1.1's names.
VERSION, PROFILE = b"WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class WarcError(ValueError):
    """An archive that is not as its own headers say."""


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _line(value: str) -> str:
    """A header's value without line breaks."""
    return value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A") if "\r" in value or "\n" in value else value


def record(kind: str, record_id: str, headers: dict[str, str], block: bytes) -> bytes:
    """One record as a gzip member."""
    lines = {"WARC-Type": kind, "WARC-Record-ID": f"<{record_id}>"} | headers | {"WARC-Block-Digest": f"sha1:{digest(block)}", "Content-Length": str(len(block))}
    head = VERSION + b"\r\n" + "".join(f"{k}: {_line(v)}\r\n" for k, v in lines.items()).encode() + b"\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head + block + b"\r\n\r\n") + packer.flush()


def page_record(record_id: str, url: str, payload: bytes, refers_to: str | None, date: str) -> bytes:
    """A response, or a revisit of ``refers_to``: the same HTTP headers without the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = {"WARC-Target-URI": url, "WARC-Date": date, "Content-Type": "application/http; msgtype=response", "WARC-Payload-Digest": f"sha1:{digest(payload)}"}
    if refers_to is None:
        return record("response", record_id, headers, http + payload)
    return record("revisit", record_id, headers | {"WARC-Refers-To": f"<{refers_to}>", "WARC-Profile": PROFILE}, http)


class _Members:
    """The inflated bytes of the current gzip member of a stream."""

    def __init__(self, stream: BinaryIO, chunk: int = CHUNK):
        self.stream, self.chunk, self.raw, self.ready, self.offset, self.taken = stream, chunk, b"", b"", 0, 0
        self.inflate = None

    def begin(self) -> bool:
        """Go to the next member; false at the end of the stream."""
        self.raw = self.raw or self.stream.read(self.chunk)
        self.offset = self.taken
        if not self.raw:
            return False
        self.inflate, self.ready = zlib.decompressobj(31), b""
        return True

    def more(self) -> bytes:
        """Some further bytes of the member, none at its end."""
        while not self.inflate.eof:
            given = self.inflate.unconsumed_tail or self.raw or self.stream.read(self.chunk)
            if not given:
                raise WarcError("the archive ends inside a record")
            if not self.inflate.unconsumed_tail:
                self.raw = b""
                self.taken += len(given)
            try:
                out = self.inflate.decompress(given, self.chunk)
            except zlib.error as e:
                raise WarcError(f"not a gzip member: {e}") from None
            if self.inflate.eof:
                self.raw = self.inflate.unused_data
                self.taken -= len(self.raw)
            if out:
                return out
        return b""

    def read(self, n: int) -> Iterator[bytes]:
        """Exactly n bytes, in pieces."""
        while n:
            self.ready = self.ready or self.more()
            if not self.ready:
                raise WarcError("a record is shorter than its Content-Length")
            piece, self.ready = self.ready[:n], self.ready[n:]
            n -= len(piece)
            yield piece

    def head(self) -> bytes:
        """Up to the blank line and over it."""
        while (at := self.ready.find(b"\r\n\r\n")) < 0:
            if len(self.ready) > HEADER_BYTES or not (more := self.more()):
                raise WarcError("a record has no end of headers")
            self.ready += more
        out, self.ready = self.ready[:at], self.ready[at + 4 :]
        return out

    def rest(self) -> bytes:
        out = self.ready
        while len(out) <= 4 and (more := self.more()):
            out += more
        return out


def _headers(block: bytes) -> tuple[str, dict[str, str]]:
    first, *lines = block.decode().split("\r\n")
    pairs = [x.partition(":") for x in lines]
    return first, {k.strip().lower(): v.strip() for k, _, v in pairs}


def read_records(stream: BinaryIO, payloads: bool = False) -> Iterator[dict]:
    """The records of an archive in order; a wrong frame or digest raises WarcError."""
    members = _Members(stream)
    while members.begin():
        first, head = _headers(members.head())
        if first.encode() != VERSION or not head.get("content-length", "").isdigit():
            raise WarcError(f"not a record: {first[:40]!r}")
        out = {"offset": members.offset, "type": head["warc-type"], "id": head["warc-record-id"].strip("<>"), "url": head.get("warc-target-uri"), "refers_to": head.get("warc-refers-to", "").strip("<>") or None, "payload": None}
        block, payload, size, http, kept = hashlib.sha1(), hashlib.sha1(), 0, b"", []
        inside = "application/http" not in head.get("content-type", "")
        for piece in members.read(int(head["content-length"])):
            block.update(piece)
            if not inside:
                http += piece
                if (at := http.find(b"\r\n\r\n")) < 0:
                    continue
                inside, http, piece = True, http[:at], http[at + 4 :]
            payload.update(piece)
            size += len(piece)
            if payloads:
                kept.append(piece)
        if members.rest() != b"\r\n\r\n":
            raise WarcError("a record is longer than its Content-Length")
        stated = head.get("warc-payload-digest", "").removeprefix("sha1:")
        found = base64.b32encode(payload.digest()).decode()
        if head.get("warc-block-digest") != f"sha1:{base64.b32encode(block.digest()).decode()}" or out["type"] == "response" and found != stated:
            raise WarcError(f"wrong digest in {out['id']}")
        if out["type"] == "revisit":
            size = int(_headers(http)[1]["content-length"])
        yield out | {"payload_bytes": size, "payload_digest": stated or found, "payload": b"".join(kept) if payloads and out["type"] == "response" else None}


def write_archives(pages: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """(archive, bytes, records, folder) of archives of ``pages`` (record_id, url strings, payload binary, refers_to string), written to a folder that all executors share.

    A folder without a scheme lies on the file system that Spark's own tables go to. Columns of other names are left out.
    An empty input writes no archive. Of very long payloads a task holds a few at a time.
    """
    spark = pages.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    uri = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toUri()
    folder = f"{uri.getScheme()}://{uri.getAuthority() or ''}{uri.getPath()}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        out = None
        for batch in slices(batches, 16):
            for row in batch.to_pylist():
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out, size, records = fs.open_output_stream(f"{root}/{name}", compression=None), 0, 0
                    size += out.write(record("warcinfo", f"urn:archive:{name}", {"WARC-Date": date, "WARC-Filename": name, "Content-Type": "application/warc-fields"}, b"format: WARC File Format 1.1\r\n"))
                size += out.write(page_record(row["record_id"], row["url"], row["payload"], row["refers_to"], date))
                records += 1
                if size >= archive_bytes:
                    out.close()
                    yield pa.RecordBatch.from_pylist([{"archive": name, "bytes": size, "records": records}])
                    out = None
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pylist([{"archive": name, "bytes": size, "records": records}])

    done = pages.select("record_id", "url", "payload", "refers_to").mapInArrow(run, "archive string, bytes long, records long")
    return written(done, "archives", narrow=False).withColumn("folder", F.lit(folder))


def read_archives(archives: DataFrame, payloads: bool = False) -> DataFrame:
    """One row for each record beside warcinfo: archive, offset, record_type, record_id, url, refers_to, payload_bytes, payload_digest, payload (null unless asked for)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fs, root = pyarrow.fs.FileSystem.from_uri(row["folder"])
                rows, held = [], 0
                with fs.open_input_stream(f"{root}/{row['archive']}", compression=None) as stream:
                    for x in read_records(stream, payloads):
                        if x["type"] == "warcinfo":
                            continue
                        rows.append((row["archive"], x["offset"], x["type"], x["id"], x["url"], x["refers_to"], x["payload_bytes"], x["payload_digest"], x["payload"]))
                        held += len(x["payload"] or b"")
                        if len(rows) == 1000 or held > 16 << 20:
                            yield batch_of(rows)
                            rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    names = ["archive", "offset", "record_type", "record_id", "url", "refers_to", "payload_bytes", "payload_digest", "payload"]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    total = archives.agg(F.count(F.lit(1)), F.sum("bytes")).first()
    tasks = max(1, min(total[0], max(4 * archives.sparkSession.sparkContext.defaultParallelism, (total[1] or 0) // READ_BYTES)))
    schema = "archive string, offset long, record_type string, record_id string, url string, refers_to string, payload_bytes long, payload_digest string, payload binary"
    return archives.select("folder", "archive").repartition(tasks).mapInArrow(run, schema)


def with_revisits(pages: DataFrame, least: int = 0, id_col: str = "page_id", payload_col: str = "html", url_col: str = "url") -> DataFrame:
    """(record_id, url, payload, refers_to): of equal payloads of ``least`` bytes or more the largest id is the response, the others revisit it.

    A null payload is empty. Rows that repeat the largest id too are responses. A null id never wins over another; its
    record's id is ``urn:page``, those of others begin with ``urn:page:``. Ids are of any type with an order. Other columns,
    whatever their names, are not looked at. Empty input gives an empty result. Long payloads move into the archives only, as
    long as the repeated digests are few enough to be broadcast; beyond that they are shuffled once, by digest.
    """
    payload = F.encode(F.coalesce(F.col(payload_col).cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).alias("page_id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"), payload.alias("payload"), F.sha2(payload, 256).alias("sha"))
    groups = rows.filter(F.octet_length("payload") >= least).groupBy("sha").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    both = attach(rows, written(groups, "payloads", narrow=True), ["sha"], "left", "n")
    name = lambda c: F.coalesce(F.concat(F.lit("urn:page:"), F.col(c).cast("string")), F.lit("urn:page"))
    revisit = F.col("n").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last"))
    return both.select(name("page_id").alias("record_id"), "url", "payload", F.when(revisit, name("last")).alias("refers_to"))


def wrong_revisits(records: DataFrame) -> DataFrame:
    """Those revisits among written ``records`` of ``read_archives`` that no response of the id they refer to matches in payload digest and size."""
    keys = ["refers_to", "payload_digest", "payload_bytes"]
    revisits, responses = records.filter("record_type = 'revisit'"), records.filter("record_type = 'response'")
    weights = written(responses.select(F.col("record_id").alias("refers_to"), *keys[1:]).distinct(), "responses", narrow=True)
    return attach(revisits, weights, keys, "left_anti")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = table(spark, sf_dir, "pages")
    kind = source.schema["page_id"].dataType
    records = read_archives(write_archives(with_revisits(source), shared_dir(spark, "warc")))
    page = lambda c: F.when(c.startswith("urn:page:"), F.substring(c, len("urn:page:") + 1, 1 << 30)).cast(kind)
    return records.select(page(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", page(F.col("refers_to")).alias("refers_to"))


_BASE32 = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'"
_QUAD = " || ".join(f"substr({_BASE32}, CAST(((CAST('0x' || substr(h, 5 * k + 1, 5) AS INTEGER) >> {s}) & 31) + 1 AS BIGINT), 1)" for s in (15, 10, 5, 0))

QUERIES = {"op4_warc": op4_warc}
ORACLE = {
    "op4_warc": f"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS body, octet_length(encode(coalesce(html, ''))) AS size, sha1(coalesce(html, '')) AS h FROM pages),
        g AS (SELECT *, max(page_id) OVER (PARTITION BY body) AS last FROM p)
        SELECT page_id, CAST(size AS BIGINT) AS payload_bytes, array_to_string(list_transform(range(0, 8), lambda k: {_QUAD}), '') AS payload_digest,
               CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id = last THEN NULL ELSE last END AS refers_to
        FROM g"""
}
