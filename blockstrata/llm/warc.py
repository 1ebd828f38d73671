"""WARC archives of pages, written index first.

A writing task streams records into archive files of its own in the shared folder, each record a gzip member,
and returns an index row per record: file, offset, length, URL and digest. The index is a table; archives are
read only through it: selected rows are sorted by file and offset, and neighbouring byte ranges are read as one.
Equal payloads are stored once: the record of the largest id is the response, the others revisit it.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockstrata.llm.store import new_path, settle

#: Bytes after which a task begins another archive; ranges nearer than GAP are read as one, up to SPAN bytes.
ARCHIVE, GAP, SPAN = 256 << 20, 64 << 10, 8 << 20
#: Repeated payloads that are broadcast at most, as digest and id: about 100 bytes each.
SENT = 500_000
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "page_id bigint, url string, record_type string, refers_to bigint, payload_digest string, file string, offset bigint, length bigint"


def _fs(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def page_of(rid: str) -> int | None:
    number = rid.removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def write_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, sha: str) -> bytes:
    """One WARC/1.1 record. A revisit keeps the HTTP headers, with the payload's length, and leaves the payload out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {quote(url or 'urn:none', safe=_URI)}", f"WARC-Payload-Digest: sha1:{sha}", "Content-Type: application/http; msgtype=response",
    ]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


_URI = ":/?#[]@!$&'()*+,;=%~"


def read_record(raw: bytes) -> tuple[dict[str, str], int, bytes | None]:
    """(named fields, payload length, payload or None for a revisit) of one record; checks its lengths and digest."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    named = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)
    size = int(named["Content-Length"])
    block, tail = rest[:size], rest[size:]
    if not version.startswith("WARC/") or len(block) != size or tail != b"\r\n\r\n":
        raise ValueError(f"not a whole WARC record: {named.get('WARC-Record-ID')}")
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(re.search(rb"(?i)\r\ncontent-length: *(\d+)", http)[1])
    if named["WARC-Type"] == "revisit":
        return named, length, None
    if len(payload) != length or digest(payload) != named["WARC-Payload-Digest"].removeprefix("sha1:"):
        raise ValueError(f"payload and its digest or length differ: {named['WARC-Record-ID']}")
    return named, length, payload


def write_archives(pages: DataFrame, *, min_revisit: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Archives in the shared folder; returns their index, settled.

    A task's files have names of their own, so those of a failed or repeated attempt are never in the index.
    """
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload")).withColumn("sha", F.sha1("payload"))
    large = rows.where(F.octet_length("payload") >= min_revisit)
    best = large.groupBy(F.col("sha").alias("best_sha")).agg(F.max("page_id").alias("best"), F.count("*").alias("copies"))
    # What is small is sent to the pages, which stay where they are; beyond that pages are shuffled by digest, where
    # adaptive execution splits a very common one.
    best = settle(best.where("copies > 1").drop("copies"), "repeated")
    if best.limit(SENT + 1).count() <= SENT:
        best = F.broadcast(best)
    told = rows.join(best, (F.col("sha") == F.col("best_sha")) & (F.octet_length("payload") >= min_revisit), "left")
    revisit = F.col("best_sha").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("best"))
    folder = new_path(pages.sparkSession, "warc")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _fs(folder)
        out, at, name = None, 0, ""
        for batch in batches:
            index = []
            for r in batch.to_pylist():
                if out is None or at > ARCHIVE:
                    if out is not None:
                        out.close()
                    store.create_dir(root, recursive=True)
                    name = f"part-{uuid.uuid4().hex}.warc.gz"
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                    at = out.write(_gzip(_info(name)))
                sha = digest(r["payload"])
                raw = _gzip(write_record(r["page_id"], r["url"], r["payload"], r["best"], r["revisit"], sha))
                out.write(raw)
                kind, to = ("revisit", r["best"]) if r["revisit"] else ("response", None)
                index.append((r["page_id"], r["url"], kind, to, sha, f"{folder}/{name}", at, len(raw)))
                at += len(raw)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*index, strict=True), _ARROW, strict=True)], _NAMES) if index else _EMPTY
        if out is not None:
            out.close()

    chosen = told.select("page_id", "url", "payload", "best", revisit.alias("revisit"))
    return settle(chosen.mapInArrow(write, INDEX), "warc-index")


_NAMES = [x.split()[0] for x in INDEX.split(", ")]
_ARROW = [pa.int64() if x.endswith("bigint") else pa.string() for x in INDEX.split(", ")]
_EMPTY = pa.RecordBatch.from_arrays([pa.array([], t) for t in _ARROW], _NAMES)


def _gzip(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _info(name: str) -> bytes:
    block = b"software: blockstrata\r\nformat: WARC File Format 1.1\r\n"
    head = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:warcinfo:{name}>", f"WARC-Date: {DATE}", "Content-Type: application/warc-fields", f"Content-Length: {len(block)}"]
    return "\r\n".join([*head, "", ""]).encode() + block + b"\r\n\r\n"


def spans(rows: Iterable[tuple[str, int, int]]) -> Iterator[tuple[str, int, int, list[int]]]:
    """(file, from, to, row numbers) of byte ranges; rows are sorted by file and offset."""
    now: tuple[str, int, int, list[int]] | None = None
    for k, (file, offset, length) in enumerate(rows):
        if now and now[0] == file and offset - now[2] <= GAP and offset + length - now[1] <= SPAN:
            now = (file, now[1], max(now[2], offset + length), [*now[3], k])
            continue
        if now:
            yield now
        now = (file, offset, offset + length, [k])
    if now:
        yield now


def read_archives(index: DataFrame) -> DataFrame:
    """The records that ``index`` selects, parsed and checked: page_id, payload_bytes, payload_digest, record_type,
    refers_to, url and payload (null for revisits)."""
    kind = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string, payload binary"
    names = [x.split()[0] for x in kind.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: tuple[str, object] = ("", None)
        for batch in batches:
            rows = batch.to_pylist()
            for file, lo, hi, own in spans((r["file"], r["offset"], r["length"]) for r in rows):
                if opened[0] != file:
                    if opened[1] is not None:
                        opened[1].close()
                    store, path = _fs(file)
                    opened = (file, store.open_input_file(path))
                opened[1].seek(lo)
                data, found = opened[1].read(hi - lo), []
                for k in own:
                    at = rows[k]["offset"] - lo
                    named, length, payload = read_record(zlib.decompress(data[at : at + rows[k]["length"]], 31))
                    to = named.get("WARC-Refers-To")
                    sha = named["WARC-Payload-Digest"].removeprefix("sha1:")
                    found.append((page_of(named["WARC-Record-ID"]), length, sha, named["WARC-Type"], page_of(to) if to else None, rows[k]["url"], payload))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True)], names)
        if opened[1] is not None:
            opened[1].close()

    chosen = index.select("file", "offset", "length", "url")
    return chosen.repartitionByRange("file", "offset").sortWithinPartitions("file", "offset").mapInArrow(read, kind)


def archive_pages(pages: DataFrame, **how) -> DataFrame:
    """Writes all pages and reads them back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A null html is an empty payload; a null URL is kept as urn:none. Equal payloads under a null id refer to
    the largest id; if all are null, or if rows repeat the largest id, those rows are all responses. An empty
    table gives an empty result and no archive; other columns play no part.
    """
    return read_archives(write_archives(pages, **how)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
