"""WARC archives: writing, normalising whole-file gzip, and reading through an offset index.

Archives that were compressed as one gzip stream cannot be entered in the
middle. The normaliser inflates such a stream once, from front to back,
rewrites every record as a gzip member of its own and lists the members'
offsets in a sidecar, so that any record is one seek and one small inflate.

Archives are rows (archive, content, index) of a table in the shared folder,
of a bounded size each; that works on any store that Spark can write. Where
all machines mount a folder, :func:`write_files` puts each archive there as a
``.warc.gz`` file beside its sidecar, and :func:`read_files` reads records by
the sidecars' offsets.
"""

from __future__ import annotations

import base64
import hashlib
import json
import os
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.batches import pieces
from corpusloom.sources.scratch import Scratch

_GZIP = 16 + zlib.MAX_WBITS

#: What stands before the payload in a response's block, and alone in a revisit's.
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


@dataclass(frozen=True)
class WarcConfig:
    """``archive_bytes`` of payload close an archive; payloads of under ``least`` bytes are never revisits."""

    archive_bytes: int = 4 << 20
    least: int = 0
    level: int = 6
    date: str = "2024-01-01T00:00:00Z"


def payload_digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _header(text: str | None) -> str:
    """A header value: control characters, and what UTF-8 can't say, as percent codes."""
    return "".join(c if ord(c) > 31 and ord(c) != 127 and c != "%" else f"%{ord(c):02X}" for c in text or "")


def record(page_id: int, url: str | None, payload: bytes, refers_to: int | None, cfg: WarcConfig) -> bytes:
    """One response or, with ``refers_to``, one revisit record: an HTTP head and, but for a revisit, the payload."""
    block = HTTP_HEAD + payload if refers_to is None else HTTP_HEAD
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{page_id}>",
        f"WARC-Date: {cfg.date}",
        f"WARC-Target-URI: {_header(url)}",
        f"WARC-Payload-Digest: sha1:{payload_digest(payload)}",
        f"WARC-Payload-Length: {len(payload)}",
    ]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def split_records(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """The records of a plain WARC stream, whole; holds one record and one chunk at a time.

    Raises ValueError on what isn't a record, or ends within one.
    """
    buffer = bytearray()
    need = -1
    for chunk in chunks:
        buffer += chunk
        while True:
            if need < 0:
                end = buffer.find(b"\r\n\r\n")
                if end < 0:
                    break
                if not buffer.startswith(b"WARC/"):
                    raise ValueError("not a WARC record")
                head = bytes(buffer[:end]).lower().split(b"\r\n")
                size = next((int(h[15:]) for h in head if h.startswith(b"content-length:")), None)
                if size is None:
                    raise ValueError("a record without Content-Length")
                need = end + 4 + size + 4
            if len(buffer) < need:
                break
            yield bytes(buffer[:need])
            del buffer[:need]
            need = -1
    if buffer:
        raise ValueError("the archive ends within a record")


def inflate(data: bytes, piece: int = 1 << 18) -> Iterator[bytes]:
    """The plain bytes of a gzip file of one or many members, in pieces.

    Zero bytes that pad the file after a member are read over. A broken or
    unfinished stream raises ValueError.
    """
    at = 0
    while at < len(data):
        if at and not data[at]:
            at += 1
            continue
        z = zlib.decompressobj(_GZIP)
        while not z.eof and at < len(data):
            step = data[at : at + piece]
            at += len(step)
            try:
                out = z.decompress(step)
            except zlib.error as e:
                raise ValueError(f"a broken gzip stream: {e}") from e
            if out:
                yield out
            if z.eof:
                at -= len(z.unused_data)
        if not z.eof:
            raise ValueError("the gzip stream ends early")


def _member(data: bytes, level: int) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, _GZIP)
    return z.compress(data) + z.flush()


def normalise(data: bytes, level: int = 6) -> tuple[bytes, list[tuple[str, int, int]]]:
    """(the archive with a member for each record, its index of (record id, offset, length)); one pass over ``data``."""
    out, index = bytearray(), []
    for r in split_records(inflate(data)):
        m = _member(r, level)
        index.append((parse_record(r)[0]["warc-record-id"], len(out), len(m)))
        out += m
    return bytes(out), index


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """(headers by their lower-case name, the block)."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    headers = {k.lower(): v for k, v in fields.items()}
    return headers, rest[: int(headers["content-length"])]


def read_member(data: bytes, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    return parse_record(zlib.decompress(data[offset : offset + length], _GZIP))


def http_payload(headers: dict[str, str], block: bytes) -> bytes:
    """What follows the HTTP head in a block that has one, else the block."""
    return block.partition(b"\r\n\r\n")[2] if headers.get("content-type", "").startswith("application/http") else block


def write_archives(records: DataFrame, cfg: WarcConfig) -> DataFrame:
    """(archive, content) of (page_id, url, payload, refers_to): whole-file gzip streams of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close():
            data = b"".join([*parts, z.flush()])
            return pa.RecordBatch.from_arrays([pa.array([hashlib.sha1(data).hexdigest()]), pa.array([data])], ["archive", "content"])

        z, parts, size = zlib.compressobj(cfg.level, zlib.DEFLATED, _GZIP), [], 0
        for batch in pieces(batches, 2):
            for page, url, payload, to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                parts.append(z.compress(record(page, url, payload or b"", to, cfg)))
                size += len(payload or b"") + 512
                if size >= cfg.archive_bytes:
                    yield close()
                    z, parts, size = zlib.compressobj(cfg.level, zlib.DEFLATED, _GZIP), [], 0
        if size:
            yield close()

    return records.select("page_id", "url", F.col("payload").cast("binary"), "refers_to").mapInArrow(run, "archive string, content binary")


def normalise_archives(archives: DataFrame, cfg: WarcConfig) -> DataFrame:
    """(archive, content, index) with one member for each record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("record", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]))
        for batch in batches:
            for name, data in zip(batch.column(0), batch.column(1), strict=True):
                out, index = normalise(data.as_py(), cfg.level)
                rows = [{"record": r, "offset": o, "length": n} for r, o, n in index]
                yield pa.RecordBatch.from_arrays([pa.array([name.as_py()]), pa.array([out]), pa.array([rows], kind)], ["archive", "content", "index"])

    return archives.select("archive", "content").mapInArrow(run, "archive string, content binary, index array<struct<record:string,offset:bigint,length:bigint>>")


_RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, offset long, length long"


def _record_rows(found: Iterator[tuple[str, int, int, dict[str, str], bytes]]) -> pa.RecordBatch:
    """The rows of (archive, offset, length, headers, block); raises ValueError where a payload isn't what its digest says."""
    names = [c.split()[0] for c in _RECORD.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    out = []
    for archive, offset, length, h, block in found:
        kind, to = h["warc-type"], h.get("warc-refers-to")
        digest, payload = h["warc-payload-digest"].removeprefix("sha1:"), http_payload(h, block)
        if kind == "response" and payload_digest(payload) != digest:
            raise ValueError(f"digest of {h['warc-record-id']} differs")
        n = len(payload) if kind == "response" else int(h["warc-payload-length"])
        page = h["warc-record-id"][10:-1]
        out.append((int(page) if page != "None" else None, n, digest, kind, int(to[10:-1]) if to else None, archive, offset, length))
    columns = zip(*out, strict=True) if out else [[]] * 8
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)


def read_archives(archives: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, archive, offset, length) of each indexed record.

    The length and digest of a response are of its payload as read back; a
    revisit has none, so they are those its header states.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data, index in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield _record_rows((name, e["offset"], e["length"], *read_member(data, e["offset"], e["length"])) for e in index)

    return archives.select("archive", "content", "index").mapInArrow(run, _RECORD)


def _mounted(folder: str) -> str:
    path = folder.removeprefix("file://")
    if "://" in path or not os.path.isabs(path):
        raise ValueError(f"{folder} is no folder that machines can mount")
    return path


def write_files(archives: DataFrame, folder: str) -> DataFrame:
    """Write each of ``archives`` (archive, content, index) to ``folder``, which all machines mount: (archive, records, bytes).

    ``<archive>.warc.gz`` holds a member for each record and
    ``<archive>.warc.idx`` a JSON line for each: record, offset, length. Files
    are renamed into place, the sidecar last, so a task that runs again
    replaces them by equal ones.
    """
    path = _mounted(folder)

    def put(name: str, data: bytes) -> None:
        part = f"{path}/.{name}-{uuid.uuid4().hex}"
        with open(part, "wb") as f:
            f.write(data)
        os.replace(part, f"{path}/{name}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(path, exist_ok=True)
        for batch in batches:
            for name, data, index in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                put(f"{name}.warc.gz", data)
                lines = [json.dumps({"archive": name, "record": e["record"], "offset": e["offset"], "length": e["length"]}) for e in index]
                put(f"{name}.warc.idx", "".join(f"{x}\n" for x in lines).encode())
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(index)]), pa.array([len(data)])], ["archive", "records", "bytes"])

    done = archives.select("archive", "content", "index").mapInArrow(run, "archive string, records long, bytes long")
    return Scratch(archives.sparkSession, "warcfiles").save(done)


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """The records of the files that :func:`write_files` put in ``folder``, as :func:`read_archives` gives them.

    The sidecars are split among tasks; each record is one seek and one
    inflate of its member.
    """
    path = _mounted(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            def found():
                for name, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):  # noqa: B023
                    with open(f"{path}/{name}.warc.gz", "rb") as f:
                        f.seek(offset)
                        yield name, offset, length, *read_member(f.read(length), 0, length)

            yield _record_rows(found())

    index = spark.read.schema("archive string, record string, offset long, length long").option("pathGlobFilter", "*.warc.idx").json(f"file://{path}")
    return index.select("archive", "offset", "length").mapInArrow(run, _RECORD)


def normalise_files(spark: SparkSession, paths: str, cfg: WarcConfig = WarcConfig()) -> DataFrame:
    """(archive, content, index) of the ``.warc.gz`` files that ``paths`` names in any store; archive is the file's path.

    Each is inflated once, front to back, whether it is one stream or many.
    """
    files = spark.read.format("binaryFile").load(paths)
    return normalise_archives(files.select(F.col("path").alias("archive"), "content"), cfg)


def archive_pages(pages: DataFrame, cfg: WarcConfig = WarcConfig(), id_col: str = "page_id", payload_col: str = "html") -> tuple[DataFrame, Scratch]:
    """Write ``pages`` (page_id, url, html) as WARC archives and normalise them.

    Returns the table (archive, content, index) and the scratch that holds it.
    Of the rows with equal payloads of at least ``least`` bytes the one with
    the smallest id is a response and the others are revisits of it. A null
    payload is empty, a null url an empty one. Rows that repeat an id and
    payload are written as often, all as responses where the id is the
    smallest. Rows with a null id are responses. A payload is written whole,
    however long, and held by one worker meanwhile. Other columns are not
    read; an empty table gives no archives.
    """
    scratch = Scratch(pages.sparkSession, "warc")
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.encode(F.coalesce(F.col(payload_col).cast("string"), F.lit("")), "UTF-8").alias("payload"),
    ).withColumn("digest", F.sha2("payload", 256))
    first = (
        rows.where((F.octet_length("payload") >= cfg.least) & F.col("page_id").isNotNull())
        .groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.max("page_id").alias("last"))
        .where("first <> last")
        .select("digest", "first")
    )
    known = rows.join(first, "digest", "left").select(
        "page_id", "url", "payload", F.when(F.col("first") != F.col("page_id"), F.col("first")).alias("refers_to")
    )
    written = scratch.save(write_archives(known, cfg))
    done = scratch.save(normalise_archives(written, cfg))
    scratch.drop(written)
    return done, scratch
