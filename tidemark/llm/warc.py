"""WARC archives: writing with revisit records, reading, and assembly of transactions.

write() deals the pages out by payload digest, chooses for each payload the record
that is the response (the others revisit it), and writes gzip-per-record WARC/1.1
files to the cluster's shared folder. Each capture is three records that point at
each other through WARC-Concurrent-To: request, response (or revisit) and
metadata; a revisit names its response by WARC-Refers-To. read() streams the archives
back and assemble() joins the records of a capture into one nested row, whatever files
they lie in and in whatever order; reading keeps no file in memory.

Null html is an empty payload. Of records with equal payloads (of at least
``least`` bytes) the one with the smallest page_id is the response, ties among
equal page_ids falling to one of the rows; a null page_id comes after all others
and is written as an absent identifier. Repeated rows are captures of their own.
An empty table makes no archive and no row.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: An archive is closed once it holds so many compressed bytes.
FILE_BYTES = 64 << 20
#: Tasks that read archives, at most.
READERS = 20_000
#: Bytes of an archive that a reader holds besides the record at hand.
READ_BYTES = 1 << 20
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Kinds of record that a capture is named after.
_MAIN = ["response", "revisit"]
_DATE = "2024-01-01T00:00:00Z"


def open_file(url: str, mode: str):
    """A stream on the shared store, through pyarrow's file systems (file, hdfs, s3, gs)."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(url if "://" in url else "file://" + url.removeprefix("file:"))
    if mode == "r":
        return system.open_input_stream(path)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    return system.open_output_stream(path)


def digest(payload: bytes) -> str:
    """The payload's SHA-1 in upper-case base32."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, ident: str, headers: list[tuple[str, str]], body: bytes) -> bytes:
    """One record as a gzip member."""
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{ident}>", f"WARC-Date: {_DATE}"]
    head += [f"{k}: {v}" for k, v in headers] + [f"Content-Length: {len(body)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n", 1, mtime=0)


def _urn(*parts: str) -> str:
    return "urn:uuid:" + str(uuid.uuid5(uuid.NAMESPACE_URL, "/".join(parts)))


def _clean(url: str | None) -> str:
    """A URL that cannot break a header line; its exact text goes to the metadata record."""
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url or "")


def capture(capture_id: str, page_id: int | None, url: str | None, payload: bytes, sha1: str, refers: tuple[str, int | None] | None) -> bytes:
    """The three records of one capture. refers: the capture and the page_id of the response that a revisit stands for."""
    target, ids = _clean(url), [_urn(capture_id, k) for k in ("response", "request", "metadata")]
    about = [("WARC-Target-URI", target)] if target else []
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    main = about + [("WARC-Concurrent-To", f"<{ids[1]}>"), ("WARC-Payload-Digest", f"sha1:{sha1}"), ("Content-Type", "application/http;msgtype=response")]
    if refers is None:
        first = record("response", ids[0], main, http + payload)
    else:
        main += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", f"<{_urn(refers[0], 'response')}>")]
        first = record("revisit", ids[0], main, http)
    ask = f"GET {target or '/'} HTTP/1.1\r\n\r\n".encode()
    second = record("request", ids[1], about + [("Content-Type", "application/http;msgtype=request")], ask)
    fields = [f"page-id: {page_id}"] if page_id is not None else []
    if url is not None:
        fields.append("url-utf8-hex: " + url.encode().hex())
    fields.append(f"payload-length: {len(payload)}")
    if refers is not None and refers[1] is not None:
        fields.append(f"refers-to-page-id: {refers[1]}")
    third = record("metadata", ids[2], [("WARC-Concurrent-To", f"<{ids[0]}>"), ("Content-Type", "application/warc-fields")], "\r\n".join(fields).encode())
    return second + first + third


def _with_roles(pages: DataFrame, least: int) -> DataFrame:
    """n, page_id, url, html of each row, and of a revisit the number and the page_id of the row it refers to.

    Payloads are compared by (SHA-1, length) in narrow rows. A digest that a third of
    all pages share is a hot key of join_counted(); the html itself is joined by row
    number, evenly.
    """
    rows = common.numbered(pages, page_id="long", url="string", html="string")
    binary = F.coalesce(F.encode("html", "UTF-8"), F.lit(b""))
    keys = rows.select("n", "page_id", F.sha1(binary).alias("sha1"), F.length(binary).cast("long").alias("size"))
    keys = common.stage(keys.where(F.col("size") >= least).select("n", "page_id", "sha1"), "payload-keys")
    firsts = keys.groupBy("sha1").agg(F.count("*").alias("times"), F.min(F.struct(F.col("page_id").isNull().alias("last"), "page_id", "n")).alias("first"))
    shared = common.stage(firsts.where("times > 1"), "payloads")
    found = common.join_counted(keys, shared, "sha1").where("n <> first.n")
    return rows.join(found.select("n", F.col("first.n").alias("first_n"), F.col("first.page_id").alias("first_page")), "n", "left")


def write(pages: DataFrame, folder: str, least: int = 0) -> DataFrame:
    """The archives that hold all pages, one row each: path, records, bytes. Evaluating it writes them.

    A task writes files of its own, under names no other attempt uses, and its rows
    name the files that count: what a lost executor left behind is never read. Record
    ids come from row numbers, so a revisit can name a response of any file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, path, size, count = None, "", 0, 0

        def done() -> pa.RecordBatch:
            stream.close()
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([count], pa.int64()), pa.array([size], pa.int64())], ["path", "records", "bytes"])

        for batch in batches:
            for row in batch.to_pylist():
                if stream is None:
                    path, size, count = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    stream = open_file(path, "w")
                payload = (row["html"] or "").encode()
                refers = None if row["first_n"] is None else (f"{folder}/{row['first_n']}", row["first_page"])
                data = capture(f"{folder}/{row['n']}", row["page_id"], row["url"], payload, digest(payload), refers)
                stream.write(data)
                size, count = size + len(data), count + 3
                if size >= FILE_BYTES:
                    yield done()
                    stream = None
        if stream is not None:
            yield done()

    return _with_roles(pages, least).mapInArrow(run, "path string, records long, bytes long")


def members(stream) -> Iterator[bytes]:
    """The gzip members of a stream, one after the other."""
    data, unzip, parts = b"", zlib.decompressobj(31), []
    while True:
        if not data:
            data = stream.read(READ_BYTES)
            if not data:
                if parts or unzip.unconsumed_tail:
                    raise ValueError("truncated gzip member")
                return
        parts.append(unzip.decompress(data))
        data = b""
        if unzip.eof:
            yield b"".join(parts)
            data, unzip, parts = unzip.unused_data, zlib.decompressobj(31), []


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and body of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers: dict[str, str] = {}
    for k, _, v in (x.partition(":") for x in lines[1:]):
        k = k.strip().lower()
        headers[k] = f"{headers[k]}, {v.strip()}" if k == "warc-concurrent-to" and k in headers else v.strip()
    return headers, rest[: int(headers["content-length"])]


_RECORD = "path string, id string, concurrent array<string>, kind string, page_id long, url string, payload_length long, payload_bytes long, payload_digest string, header_digest string, refers_to_id string, refers_to_page long, payload binary"


def read(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """Every record of the archives (rows with a path): its id, the ids it is concurrent to, its kind and fields."""
    names = [x.split()[0] for x in _RECORD.split(", ")]
    kinds = [pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def rows(path: str) -> Iterator[dict]:
        with open_file(path, "r") as stream:
            for raw in members(stream):
                head, body = parse(raw)
                kind = head["warc-type"]
                row = dict.fromkeys(names)
                row |= {"path": path, "kind": kind, "id": head["warc-record-id"], "concurrent": head["warc-concurrent-to"].split(", ") if "warc-concurrent-to" in head else []}
                if kind == "metadata":
                    fields = dict(x.split(": ", 1) for x in body.decode().split("\r\n"))
                    row["page_id"] = int(fields["page-id"]) if "page-id" in fields else None
                    row["url"] = bytes.fromhex(fields["url-utf8-hex"]).decode() if "url-utf8-hex" in fields else None
                    row["payload_length"] = int(fields["payload-length"])
                    row["refers_to_page"] = int(fields["refers-to-page-id"]) if "refers-to-page-id" in fields else None
                elif kind in _MAIN:
                    payload = body.partition(b"\r\n\r\n")[2]
                    row["header_digest"] = head["warc-payload-digest"].removeprefix("sha1:")
                    if kind == "response":
                        row |= {"payload_bytes": len(payload), "payload_digest": digest(payload), "payload": payload if payloads else None}
                    else:
                        row["refers_to_id"] = head["warc-refers-to"]
                yield row

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                held, size = [], 0
                for row in rows(path):
                    held.append(row)
                    size += len(row["payload"] or b"") + 300
                    if size > common.SLICE_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in held], k) for n, k in zip(names, kinds)], names)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in held], k) for n, k in zip(names, kinds)], names)

    return archives.select("path").mapInArrow(run, _RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture from its request, response or revisit, and metadata records, in whatever files they lie.

    A capture has the id of its response. Another record belongs to the response that
    names it as concurrent, else to the one it names itself, directly or through a
    request; a record without partners makes a row with nulls for what is missing.
    """
    main = F.col("kind").isin(*_MAIN)
    named = records.where(main).select(F.explode("concurrent").alias("id"), F.col("id").alias("capture"))
    naming = records.where(F.col("kind") == "request").select("id", F.get("concurrent", F.lit(0)).alias("capture")).where("capture is not null")
    links = named.select("*", F.lit(0).alias("rank")).unionByName(naming.select("*", F.lit(1).alias("rank")))
    links = links.groupBy("id").agg(F.min(F.struct("rank", "capture")).alias("x")).select("id", F.col("x.capture").alias("capture"))
    # a record that names none is looked up by its own id again: nulls would all meet in one task
    others = records.where(~main).withColumn("other", F.coalesce(F.get("concurrent", F.lit(0)), "id"))
    own = others.join(links, "id", "left").withColumnRenamed("capture", "by_id")
    both = own.join(links.withColumnRenamed("id", "other").withColumnRenamed("capture", "by_other"), "other", "left").drop("other")
    both = both.withColumn("capture", F.coalesce("by_id", "by_other", F.get("concurrent", F.lit(0)), "id")).drop("by_id", "by_other")
    whole = records.where(main).withColumn("capture", F.col("id")).unionByName(both)
    part = lambda kinds, *names: F.max(F.when(F.col("kind").isin(*kinds), F.struct(*names)))
    nested = whole.groupBy("capture").agg(
        part(["request"], F.lit(True).alias("present"), "path").alias("request"),
        part(_MAIN, "kind", "payload_bytes", "payload_digest", "header_digest", "refers_to_id", "payload").alias("response"),
        part(["metadata"], "page_id", "url", "payload_length", "refers_to_page").alias("metadata"),
    )
    # refers_to_id is the record that a revisit names, refers_to the page_id that its metadata gives for it
    return nested.withColumn("response", F.col("response").withField("refers_to", F.col("metadata.refers_to_page")))


def round_trip(spark: SparkSession, pages: DataFrame, least: int = 0, label: str = "warc") -> DataFrame:
    """Pages written to archives in the shared folder and read back: page_id, url, payload_bytes, payload_digest, record_type, refers_to.

    A revisit carries no payload; its length and digest are those its metadata and
    header give, and the tests follow WARC-Refers-To to the response to compare them.
    """
    folder = common.staged_path(spark, label)
    listed = common.stage(write(pages, folder + "/archives", least), label + "-list")
    # a number of partitions that isn't taken back: the rows are few and short, what they name isn't
    archives = listed.repartition(max(1, min(READERS, listed.count())))
    # read once: assembly goes over the records more than once
    whole = assemble(common.stage(read(archives, payloads=False).drop("payload"), label + "-records").withColumn("payload", F.lit(None).cast("binary")))
    return whole.select(
        F.col("metadata.page_id").alias("page_id"),
        F.coalesce("response.payload_bytes", "metadata.payload_length").alias("payload_bytes"),
        F.coalesce("response.payload_digest", "response.header_digest").alias("payload_digest"),
        F.col("response.kind").alias("record_type"),
        F.col("response.refers_to").alias("refers_to"),
        F.col("metadata.url").alias("url"),
    )
