"""WARC archives of pages, and a normaliser for monolithic gzip files.

``write_archives`` writes records as one gzip stream per file. ``normalise``
inflates each such file once, front to back, rewrites every record as a gzip
member of its own and writes a sidecar offset index (``.idx``: offset, length,
record id). ``read_records`` then reads members by offset, in any order and in
parallel. Files go to the shared folder through Arrow's file systems; a task
that is run again writes new names, and only files that its result names count.
Memory in a task is bounded by the largest record.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import scratch, stored

LEVEL = 6
ARCHIVE_BYTES = 64 << 20    # of records, before compression
CHUNK = 1 << 20
MIN_REVISIT = 0
DATE = "1970-01-01T00:00:00Z"
RANGE = 500
READ_BYTES = 8 << 20


def _file(uri: str):
    fs, path = pyarrow.fs.FileSystem.from_uri(uri)
    return fs, path


def _create(uri: str):
    fs, path = _file(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    return fs.open_output_stream(path, compression=None)


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url, payload: bytes, refers_to=None, revisit: bool = False) -> bytes:
    """One WARC 1.1 record; a revisit carries the HTTP head only."""
    http = ("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {len(payload)}\r\n\r\n").encode()
    block = http if revisit else http + payload
    clean = "" if url is None else "".join(
        c if 0x20 < ord(c) != 0x7F else "".join(f"%{b:02X}" for b in c.encode()) for c in url)
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}",
            f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", f"WARC-Date: {DATE}"]
    if clean:
        head.append(f"WARC-Target-URI: {clean}")
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    head.append(f"WARC-Payload-Digest: sha1:{digest_of(payload)}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"X-Refers-To-Page: {refers_to}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def headers(raw: bytes) -> tuple[dict[str, str], int]:
    """Header fields (lower-case names) of a record and where its block begins."""
    end = raw.index(b"\r\n\r\n")
    lines = raw[:end].decode("utf-8").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}, end + 4


def mark_revisits(pages: DataFrame, least: int = MIN_REVISIT) -> DataFrame:
    """pages(page_id, url, html) plus refers_to: the largest page_id with an equal
    payload of at least ``least`` bytes, null for that page itself and for
    payloads that occur once. Only ids and digests are grouped; a large group of
    copies is aggregated before the shuffle."""
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    pages = pages.select("page_id", "url", "html", F.sha2(body, 256).alias("h"),
                         F.octet_length(body).alias("n"))
    ids = pages.where((F.col("n") >= least) & F.col("page_id").isNotNull())
    top = (ids.groupBy("h", "n").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("lo"))
           .where("lo < refers_to").drop("lo"))
    again = (ids.select("page_id", "h", "n").join(top, ["h", "n"])
             .where("page_id < refers_to").select("page_id", "h", "refers_to").distinct())
    return pages.join(again, ["page_id", "h"], "left").select("page_id", "url", "html", "refers_to")


def write_archives(marked: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """(archive, records): monolithic gzip files of about ``archive_bytes`` of
    records each, written by the tasks that hold the rows."""
    def run(frames: Iterator[pd.DataFrame]):
        out, size, n, name, z = None, 0, 0, "", None
        for pdf in frames:
            for page_id, url, html, ref in zip(*(pdf[c].astype(object) for c in pdf.columns)):
                if out is None:
                    name = f"{folder}/raw/{uuid.uuid4().hex}.warc.gz"
                    out, size, n, z = _create(name), 0, 0, zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                refers = None if pd.isna(ref) else int(ref)
                raw = record(None if pd.isna(page_id) else int(page_id), url,
                             (html or "").encode(), refers, refers is not None)
                out.write(z.compress(raw))
                size, n = size + len(raw), n + 1
                if size >= archive_bytes:
                    out.write(z.flush())
                    out.close()
                    out = None
                    yield pd.DataFrame({"archive": [name], "records": [n]})
        if out is not None:
            out.write(z.flush())
            out.close()
            yield pd.DataFrame({"archive": [name], "records": [n]})

    return marked.mapInPandas(run, "archive string, records long")


def split_records(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Records of an inflated WARC stream, one at a time."""
    buf = bytearray()
    need = None
    for chunk in chunks:
        buf += chunk
        while True:
            if need is None:
                end = buf.find(b"\r\n\r\n")
                if end < 0:
                    break
                fields, begin = headers(bytes(buf[:end + 4]))
                need = begin + int(fields["content-length"]) + 4
            if len(buf) < need:
                break
            yield bytes(buf[:need])
            del buf[:need]
            need = None
    if buf:
        raise ValueError(f"archive ends inside a record ({len(buf)} bytes left)")


def _inflate(stream) -> Iterator[bytes]:
    """A gzip file front to back, whether one member or several, in pieces of at most
    ``CHUNK`` bytes however well it is compressed."""
    z = zlib.decompressobj(31)
    while data := stream.read(CHUNK):
        while data:
            if z.eof:
                z = zlib.decompressobj(31)
            piece = z.decompress(data, CHUNK)
            while piece:
                yield piece
                # a full piece may leave output behind that needs no more input
                piece = z.decompress(z.unconsumed_tail, CHUNK) if not z.eof else b""
            data = z.unused_data if z.eof else z.unconsumed_tail
    if not z.eof:
        raise ValueError("truncated gzip stream")


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """Rewrite each file of ``archives(archive)`` with a gzip member per record.
    Returns the offset index (path, number, offset, length, record_id), which
    each file's sidecar also holds. One file is one stream and so one task."""
    def run(frames: Iterator[pd.DataFrame]):
        for pdf in frames:
            for archive in pdf["archive"]:
                path = f"{folder}/members/{uuid.uuid4().hex}.warc.gz"
                fs, local = _file(archive)
                rows, at = [], 0
                with fs.open_input_stream(local, compression=None) as src, _create(path) as out, \
                        _create(path + ".idx") as idx:
                    for k, raw in enumerate(split_records(_inflate(src))):
                        z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                        member = z.compress(raw) + z.flush()
                        out.write(member)
                        rid = headers(raw)[0]["warc-record-id"].strip("<>")
                        idx.write(f"{at}\t{len(member)}\t{rid}\n".encode())
                        rows.append((path, k, at, len(member), rid))
                        at += len(member)
                        if len(rows) >= 10_000:
                            yield pd.DataFrame(rows, columns=names)
                            rows = []
                yield pd.DataFrame(rows, columns=names)

    names = ["path", "number", "offset", "length", "record_id"]
    return archives.select("archive").repartition(max(archives.count(), 1), "archive").mapInPandas(
        run, "path string, number long, offset long, length long, record_id string")


def read_records(index: DataFrame) -> DataFrame:
    """Records by offset: page_id, url, record_type, payload_bytes,
    payload_digest, refers_to, payload (null for a revisit). A payload whose
    digest is not the recorded one raises an error."""
    def run(frames: Iterator[pd.DataFrame]):
        path, file = None, None
        for pdf in frames:
            rows = []
            for p, off, length in zip(pdf["path"], pdf["offset"], pdf["length"]):
                if p != path:
                    if file is not None:
                        file.close()
                    fs, local = _file(p)
                    path, file = p, fs.open_input_file(local)
                raw = zlib.decompress(file.read_at(int(length), int(off)), 31)
                f, begin = headers(raw)
                cut = raw.index(b"\r\n\r\n", begin) + 4
                http = headers(raw[begin:cut])[0]
                digest = f["warc-payload-digest"].removeprefix("sha1:")
                payload = raw[cut:-4] if f["warc-type"] == "response" else None
                if payload is not None and digest_of(payload) != digest:
                    raise ValueError(f"{p} at {off}: payload does not match its digest")
                rows.append((int(f["x-page-id"]) if "x-page-id" in f else None,
                             f.get("warc-target-uri"), f["warc-type"], int(http["content-length"]),
                             digest, int(f["x-refers-to-page"]) if "x-refers-to-page" in f else None,
                             payload))
            yield pd.DataFrame(rows, columns=names).astype({"page_id": "Int64", "refers_to": "Int64"})

    names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"]
    # rows are small but the records behind them are not: a set number of tasks
    tasks = (index.agg(F.sum("length")).first()[0] or 0) // READ_BYTES + 1
    return (index.repartition(tasks, "path", F.floor(F.col("number") / RANGE))
            .sortWithinPartitions("path", "offset").select("path", "offset", "length").mapInPandas(
                run, "page_id long, url string, record_type string, payload_bytes long, "
                     "payload_digest string, refers_to long, payload binary"))


def archive_pages(pages: DataFrame, least: int = MIN_REVISIT,
                  archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write ``pages(page_id, url, html)`` to monolithic archives, normalise them
    and return the records read back (see ``read_records``).

    A null html is an empty payload; a null url leaves the field out. A null
    page_id is written as a response and read back as null. Rows that repeat a
    page_id are records of their own; all rows with a group's largest page_id
    are responses. Empty tables give an empty result; other columns are ignored.
    """
    folder = scratch(pages.sparkSession, "warc")
    raw = stored(write_archives(mark_revisits(pages, least), folder, archive_bytes), "archives")
    return read_records(stored(normalise(raw, folder), "offsets"))
