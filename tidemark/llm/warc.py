"""WARC archives: writing, normalising monolithic gzip, and reading by a sidecar index.

Writing: each task streams its rows into archives that are one gzip stream each, the
form many crawlers leave, and returns a manifest of the records.  Normalising: each
archive is inflated once, as a stream; every record is rewritten as a gzip member of its
own, and a sidecar index says where each member starts.  Then a record can be read
without inflating what stands before it.  While rewriting, records whose payload
another record already has become revisits that carry headers only.

Files get names of their own at each attempt, and only names that a finished task
returned are read: a lost or repeated task leaves files that nothing refers to.  Paths
are URIs of any file system that pyarrow knows (local or shared folders, HDFS, S3, GCS).
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, checkpointed, shared_folder

#: Payload bytes after which a task begins its next archive.
ARCHIVE_BYTES = 24 << 20
REVISIT = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


def opened(uri: str, mode: str):
    from pyarrow.fs import FileSystem

    fs, path = FileSystem.from_uri(re.sub(r"^file:/(?=[^/])", "file:///", uri))
    if mode == "w":
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        return fs.open_output_stream(path, compression=None)
    return fs.open_input_file(path)


def digest(payload: bytes) -> str:
    """Bare upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page, row: int) -> str:
    return f"<urn:page:{'-' if page is None else quote(str(page), safe='')}:{row}>"


def page_of(rid: str) -> str | None:
    p = rid[len("<urn:page:") : -1].rpartition(":")[0]
    return None if p == "-" else unquote(p)


def record(headers: list[tuple[str, str]], http: list[tuple[str, str]], payload: bytes) -> bytes:
    block = b"HTTP/1.1 200 OK\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in http) + b"\r\n" + payload
    return b"WARC/1.0\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in [*headers, ("Content-Length", str(len(block)))]) + b"\r\n" + block + b"\r\n\r\n"


def response(page, row: int, url: str | None, payload: bytes, date: str) -> bytes:
    headers = [("WARC-Type", "response"), ("WARC-Record-ID", record_id(page, row)), ("WARC-Date", date)]
    if url is not None:
        headers.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    headers += [("WARC-Payload-Digest", f"sha1:{digest(payload)}"), ("Content-Type", "application/http; msgtype=response")]
    return record(headers, [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(payload)))], payload)


def fields(head: bytes) -> dict[str, str]:
    """The named fields below the first line, names in lower case; folded lines are joined."""
    out, last = {}, None
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and last:
            out[last] += " " + line.strip()
        elif ":" in line:
            last, _, v = line.partition(":")
            last = last.strip().lower()
            out[last] = v.strip()
    return out


def records(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """(fields, head, block) of each record of an uncompressed WARC stream."""
    have = bytearray()
    chunks = iter(chunks)

    def fill(n: int | None) -> bool:
        while n is None or len(have) < n:
            if (x := next(chunks, None)) is None:
                return False
            have.extend(x)
            if n is None:
                return True
        return True

    while True:
        while have[:2] == b"\r\n" or not have:
            if not have:
                if not fill(None):
                    return
            else:
                del have[:2]
        at = 0
        while (end := have.find(b"\r\n\r\n", at)) < 0:
            at = max(0, len(have) - 3)
            if not fill(None):
                if bytes(have).strip():
                    raise ValueError("a WARC record ends within its head")
                return
        head = bytes(have[: end + 2])
        f = fields(head)
        n = int(f["content-length"])
        if not fill(end + 4 + n):
            raise ValueError("a WARC record is shorter than its Content-Length")
        yield f, head, bytes(have[end + 4 : end + 4 + n])
        del have[: end + 4 + n]


def inflated(f, size: int = 1 << 20) -> Iterator[bytes]:
    """A gzip file as a stream, whether one member or many."""
    d = zlib.decompressobj(31)
    while data := f.read(size):
        while data:
            if x := d.decompress(data):
                yield x
            data = d.unused_data
            if d.eof:
                d = zlib.decompressobj(31)


def member(data: bytes, level: int) -> bytes:
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def rewrite(source: str, target: str, revisits: dict[str, tuple[str, str | None]], level: int = 1) -> int:
    """Rewrite each record of a gzip WARC as a member of its own; target + '.idx' gets a line of JSON for each.

    revisits: by record id, the id of the response that has the same payload and its URI.
    """
    offset, count = 0, 0
    with opened(source, "r") as f, opened(target, "w") as out, opened(f"{target}.idx", "w") as index:
        for got, head, block in records(inflated(f)):
            rid = got.get("warc-record-id", "")
            kind = got.get("warc-type", "")
            if rid in revisits:
                kind = "revisit"
                named = [("WARC-Type", kind), ("WARC-Record-ID", rid), ("WARC-Date", got["warc-date"]), *[("WARC-Target-URI", got[k]) for k in ("warc-target-uri",) if k in got], ("WARC-Payload-Digest", got["warc-payload-digest"]), ("WARC-Profile", REVISIT), ("WARC-Refers-To", revisits[rid][0]), ("Content-Type", got["content-type"])]
                block = block[: block.index(b"\r\n\r\n") + 4]
                data = b"WARC/1.0\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in named) + f"Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"
            else:
                data = head + b"\r\n" + block + b"\r\n\r\n"
            packed = member(data, level)
            out.write(packed)
            index.write(json.dumps({"id": rid, "type": kind, "offset": offset, "length": len(packed)}).encode() + b"\n")
            offset += len(packed)
            count += 1
    return count


def read_indexed(target: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of each record, each read at the place that the index names."""
    with opened(f"{target}.idx", "r") as f:
        index = [json.loads(x) for x in f.read().splitlines()]
    with opened(target, "r") as f:
        for x in index:
            f.seek(x["offset"])
            for got, _, block in records([zlib.decompress(f.read(x["length"]), 31)]):
                yield got, block


def write_pages(pages: DataFrame, folder: str, id: str = "page_id", url: str = "url", html: str = "html", date: str = "1970-01-01T00:00:00Z", level: int = 1) -> DataFrame:
    """Write a response record for each row; the manifest (archive, record, id, row, bytes, digest), checkpointed.

    Null html is an empty payload; a null url is left out; ids may be null or repeat.
    """
    rows = pages.select(F.monotonically_increasing_id().alias("row"), F.col(id).alias("id"), F.col(url).alias("url"), F.col(html).alias("html"))
    shape = T.StructType([T.StructField("archive", T.StringType()), T.StructField("record", T.StringType()), rows.schema["id"], *T._parse_datatype_string("row bigint, bytes bigint, digest string").fields])
    most = ARCHIVE_BYTES
    bounded_batches(pages.sparkSession)

    def write(batches):
        out, packer, held = None, None, 0
        for x in batches:
            made = []
            for row, page, link, text in zip(*(c.to_pylist() for c in x.columns), strict=True):
                payload = (text or "").encode()
                if out is None:
                    name, held = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0
                    out, packer = opened(name, "w"), zlib.compressobj(level, zlib.DEFLATED, 31)
                out.write(packer.compress(response(page, row, link, payload, date)))
                held += len(payload)
                made.append((name, record_id(page, row), row, len(payload), digest(payload)))
                if held >= most:
                    out.write(packer.flush())
                    out.close()
                    out = None
            a, r, k, n, d = (list(v) for v in zip(*made, strict=True)) if made else ([], [], [], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(r, pa.string()), x.column(1), pa.array(k, pa.int64()), pa.array(n, pa.int64()), pa.array(d, pa.string())], names=["archive", "record", "id", "row", "bytes", "digest"])
        if out is not None:
            out.write(packer.flush())
            out.close()

    return checkpointed(rows.mapInArrow(write, shape))


def normalise(manifest: DataFrame, folder: str, min_bytes: int = 0, level: int = 1) -> DataFrame:
    """Rewrite the archives of a manifest as members with indexes: (archive, records), checkpointed.

    Of the records with equal payloads of at least min_bytes, that with the smallest id
    (null last, then the first row) stays a response; the others become revisits of it.
    """
    first = F.min(F.struct(F.col("id").isNull().alias("no"), "id", "row", "record")).alias("r")
    tops = manifest.where(F.col("bytes") >= min_bytes).groupBy("digest", "bytes").agg(first, F.count("*").alias("copies")).where("copies > 1")
    tops = tops.select("digest", "bytes", F.col("r.record").alias("of"))
    found = manifest.join(tops, ["digest", "bytes"], "left").select("archive", "record", F.when(F.col("of") != F.col("record"), F.col("of")).alias("of"))
    found = found.repartition(max(1, manifest.select("archive").distinct().count()), "archive")  # a manifest is small, its archives are not: one task or so for each

    def run(key, t):
        t = t.filter(t.column("of").is_valid())
        target = f"{folder}/{uuid.uuid4().hex}.warc.gz"
        n = rewrite(key[0].as_py(), target, {r: (of, None) for r, of in zip(t.column("record").to_pylist(), t.column("of").to_pylist(), strict=True)}, level)
        return pa.table([pa.array([target]), pa.array([n], pa.int64())], names=["archive", "records"])

    return checkpointed(found.groupBy("archive").applyInArrow(run, "archive string, records bigint"))


def read_archives(archives: DataFrame, kind: T.DataType) -> DataFrame:
    """(id, url, record_type, payload_bytes, payload_digest, refers_to, payload) of every record.

    payload_bytes and payload_digest are those of the full payload, for revisits too,
    which carry none; kind is the type of id.  A response whose payload does not have
    the digest that its header gives raises an error.
    """

    def read(batches):
        for x in batches:
            for name in x.column(0).to_pylist():
                rows = []
                for got, block in read_indexed(name):
                    head, _, payload = block.partition(b"\r\n\r\n")
                    said = got["warc-payload-digest"].removeprefix("sha1:")
                    if (whole := got["warc-type"] == "response") and digest(payload) != said:
                        raise ValueError(f"{got['warc-record-id']} has another payload digest")
                    n = len(payload) if whole else int(fields(head)["content-length"])
                    rows.append((page_of(got["warc-record-id"]), got.get("warc-target-uri"), got["warc-type"], n, said, page_of(got["warc-refers-to"]) if "warc-refers-to" in got else None, payload if whole else None))
                    if len(rows) == 500:
                        yield batch(rows)
                        rows = []
                if rows:
                    yield batch(rows)

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary()), strict=True)], names=["id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"])

    out = archives.select("archive").repartition(max(1, archives.count())).mapInArrow(read, "id string, url string, record_type string, payload_bytes bigint, payload_digest string, refers_to string, payload binary")
    return out.withColumns({c: F.col(c).cast(kind) for c in ("id", "refers_to")})


def archive_pages(pages: DataFrame, min_bytes: int = 0, id: str = "page_id", url: str = "url", html: str = "html", folder: str | None = None) -> DataFrame:
    """Write pages, normalise the archives, and read them back; columns as of read_archives(), id under its name.

    One row for each row of pages, repeated rows too.  Null html is an empty payload, equal
    to other empty ones.  An empty table gives an empty result.  The archives stay in
    folder (a new one in the shared folder of the session, if None).
    """
    folder = folder or shared_folder(pages.sparkSession, "warc")
    manifest = write_pages(pages, f"{folder}/monolithic", id, url, html)
    archives = normalise(manifest, f"{folder}/members", min_bytes)
    return read_archives(archives, pages.schema[id].dataType).withColumnRenamed("id", id)
