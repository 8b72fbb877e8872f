"""WARC archives: written as one gzip stream, normalised to a gzip member per record, indexed.

``write_archives`` lays pages out as WARC 1.1 records in files of one gzip stream each, as many
tools leave them. ``normalise`` inflates such a stream once from start to end, with any
number of members in it, deflates every record as a member of its own and writes a sidecar of
offsets; memory holds one record. ``read_archives`` finds records by the sidecar and reads each
one alone. Files go through pyarrow's file systems into the folder that the session names in
spark.checkpoint.dir, under names that depend on the partition only, and are put in place by a
rename: a task that runs again leaves the same files.

Of records with equal payloads of at least ``MIN_SHARED`` bytes the one with the smallest page_id
is a response and the others revisit it; smaller payloads are responses all. Equal payloads are
found by an aggregate over digests that Spark combines before it shuffles, so a payload held by a
third of all pages is no hot group.

Defined results: null html is an empty payload; a null url is written as an empty target; a page_id
that occurs several times with an equal payload is a response each time; rows with a null page_id
are responses and are never referred to; an empty table gives no archive and no row; extra columns
are left out.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterable, Iterator

import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import shared_dir, staged, text_of

MIN_SHARED = 100
ARCHIVE_BYTES = 256 << 20
READ_BYTES = 1 << 20
_END = b"\r\n\r\n"


# --------------------------------------------------------------------------- records


def record(headers: dict[str, str], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers.items()), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + _END + block + _END


def _one_line(text: str) -> str:
    return "".join(" " if c in "\r\n\t" else c for c in text)


def page_record(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response record with its HTTP head and payload, or a revisit without payload."""
    kind = "response" if refers_to is None else "revisit"
    headers = {
        "WARC-Type": kind,
        "WARC-Record-ID": f"<urn:page:{'' if page_id is None else page_id}>",
        "WARC-Target-URI": _one_line(url),
        "WARC-Date": "1970-01-01T00:00:00Z",
        "WARC-Payload-Digest": f"sha256:{digest}",
        "Content-Type": "application/http;msgtype=response",
    }
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html;charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if refers_to is not None:
        headers["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        headers["WARC-Refers-To"] = f"<urn:page:{refers_to}>"
        return record(headers, head)
    return record(headers, head + payload)


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers by lower-case name, and the block of one record."""
    head, _, rest = raw.partition(_END)
    first, *lines = head.decode("utf-8", "replace").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError(f"not a WARC record: {first[:40]!r}")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    size = int(headers["content-length"])
    if len(rest) < size:
        raise ValueError("the record's block is cut short")
    return headers, rest[:size]


# --------------------------------------------------------------------------- files


def _at(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def inflated(stream) -> Iterator[bytes]:
    """The content of a gzip file with one member or many, in pieces."""
    inflate = zlib.decompressobj(31)
    while data := stream.read(READ_BYTES):
        while data:
            if piece := inflate.decompress(data):
                yield piece
            if not inflate.eof:
                break
            data, inflate = inflate.unused_data, zlib.decompressobj(31)


def records(pieces: Iterable[bytes]) -> Iterator[bytes]:
    """Whole records from a stream of bytes."""
    held, need = bytearray(), 0
    for piece in pieces:
        held += piece
        while True:
            if not need:
                end = held.find(_END)
                if end < 0:
                    break
                size = next(x for x in bytes(held[:end]).split(b"\r\n") if x.lower().startswith(b"content-length:"))
                need = end + 4 + int(size.partition(b":")[2]) + 4
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need = 0
    if held.strip():
        raise ValueError("the archive ends inside a record")


def _member(data: bytes) -> bytes:
    deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
    return deflate.compress(data) + deflate.flush()


def normalise(source: str, target: str) -> int:
    """Rewrites source with a gzip member per record; target.idx has one JSON line a record: offset, length, id, type."""
    system, path = _at(target)
    attempt = f".{TaskContext.get().taskAttemptId()}" if TaskContext.get() else ".0"
    n = offset = 0
    src, src_path = _at(source)
    with src.open_input_stream(src_path, compression=None) as raw, system.open_output_stream(path + attempt, compression=None) as out:
        with system.open_output_stream(path + ".idx" + attempt, compression=None) as index:
            for rec in records(inflated(raw)):
                headers, _ = parse(rec)
                member = _member(rec)
                out.write(member)
                index.write(json.dumps([offset, len(member), headers.get("warc-record-id", ""), headers["warc-type"]]).encode() + b"\n")
                offset += len(member)
                n += 1
    system.move(path + ".idx" + attempt, path + ".idx")
    system.move(path + attempt, path)
    return n


# --------------------------------------------------------------------------- on DataFrames


def with_revisits(pages: DataFrame) -> DataFrame:
    """page_id, url, payload binary, payload_digest, refers_to."""
    payload = F.encode(text_of(pages, "html"), "UTF-8")
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), payload.alias("payload"), F.sha2(payload, 256).alias("payload_digest"))
    big = F.length("payload") >= MIN_SHARED
    firsts = rows.filter(big).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last"))
    firsts = firsts.filter(F.col("first") != F.col("last")).select("payload_digest", "first")
    later = rows.filter(big).select("page_id", "payload_digest").join(firsts, "payload_digest").filter(F.col("page_id") != F.col("first"))
    later = later.groupBy("page_id", "payload_digest").agg(F.min("first").alias("refers_to"))
    return rows.join(later, ["page_id", "payload_digest"], "left").select("page_id", "url", "payload", "payload_digest", "refers_to")


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes pages with revisits marked as monolithic archives; a row per file: path, n_records."""

    def write(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, part = TaskContext.get(), 0
        rows = (row for pdf in batches for row in pdf.itertuples(index=False))
        row = next(rows, None)
        while row is not None:
            system, base = _at(folder)
            system.create_dir(base, recursive=True)
            name = f"part-{task.partitionId():06d}-{part:04d}.mono.warc.gz"
            n = size = 0
            with system.open_output_stream(f"{base}/{name}.{task.taskAttemptId()}", compression=None) as out:
                deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
                while row is not None and size < ARCHIVE_BYTES:
                    known = None if pd.isna(row.refers_to) else int(row.refers_to)
                    rec = page_record(None if pd.isna(row.page_id) else int(row.page_id), row.url, row.payload, row.payload_digest, known)
                    out.write(deflate.compress(rec))
                    n, size = n + 1, size + len(rec)
                    row = next(rows, None)
                out.write(deflate.flush())
            system.move(f"{base}/{name}.{task.taskAttemptId()}", f"{base}/{name}")
            part += 1
            yield pd.DataFrame({"path": [f"{folder}/{name}"], "n_records": [n]})

    return pages.mapInPandas(write, "path string, n_records long")


def normalise_archives(files: DataFrame, drop_source: bool = True) -> DataFrame:
    """A row per normalised file: path, n_records."""

    def rewrite(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path in pdf["path"]:
                target = path.replace(".mono.warc.gz", ".warc.gz")
                system, at = _at(target)
                if system.get_file_info(at).type == fs.FileType.File:  # a lost executor's task had ended
                    with system.open_input_stream(at + ".idx", compression=None) as f:
                        n = f.read().count(b"\n")
                else:
                    n = normalise(path, target)
                if drop_source and _at(path)[0].get_file_info(_at(path)[1]).type == fs.FileType.File:
                    _at(path)[0].delete_file(_at(path)[1])
                yield pd.DataFrame({"path": [target], "n_records": [n]})

    return _spread(files).mapInPandas(rewrite, "path string, n_records long")


def _spread(files: DataFrame) -> DataFrame:
    """A task per file or so: the list of files is small, and what it names is not."""
    return files.repartition(max(1, files.count()), "path")


def read_archives(files: DataFrame) -> DataFrame:
    """A row per record, read by its offset: page_id, url, record_type, payload (null for revisits), payload_bytes, payload_digest, refers_to."""

    def number(uri: str) -> int | None:
        found = uri.strip("<>").rpartition(":")[2]
        return int(found) if found else None

    def read(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["page_id", "url", "record_type", "payload", "payload_bytes", "payload_digest", "refers_to"]
        for path in (p for pdf in batches for p in pdf["path"]):
            system, at = _at(path)
            out, held = [], 0
            with system.open_input_file(at) as f, system.open_input_stream(at + ".idx", compression=None) as index:
                for line in index.read().splitlines():
                    offset, length, _, kind = json.loads(line)
                    f.seek(offset)
                    headers, block = parse(zlib.decompress(f.read(length), 31))
                    head, _, payload = block.partition(_END)
                    size = int(next(x for x in head.split(b"\r\n") if x.startswith(b"Content-Length:"))[15:])
                    if kind == "response" and size != len(payload):
                        raise ValueError(f"{path} at {offset}: payload of {len(payload)} bytes, not {size}")
                    digest = hashlib.sha256(payload).hexdigest() if kind == "response" else headers["warc-payload-digest"].removeprefix("sha256:")
                    refers = number(headers["warc-refers-to"]) if kind == "revisit" else None
                    out.append((number(headers["warc-record-id"]), headers["warc-target-uri"], kind, payload if kind == "response" else None, size, digest, refers))
                    held += size
                    if held > READ_BYTES * 16:
                        yield pd.DataFrame(out, columns=columns).astype({"page_id": "Int64", "refers_to": "Int64"})
                        out, held = [], 0
            yield pd.DataFrame(out, columns=columns).astype({"page_id": "Int64", "refers_to": "Int64"})

    schema = "page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long"
    return _spread(files).mapInPandas(read, schema)


def archive(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes, normalises and indexes the archives of pages; a row per file: path, n_records."""
    folder = folder or shared_dir(pages.sparkSession, "warc")
    written = staged(write_archives(with_revisits(pages), folder), "warc-written")
    return staged(normalise_archives(written), "warc-files")
