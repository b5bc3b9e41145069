"""WARC archives: written from pages, read back through boundary chains.

Reading doesn't trust the record magic, which may also stand inside a payload.  A task lists every place where a record
could start, reads the candidate's header for its length and so links it to the offset of its successor.  Pointer
jumping from the file's start then doubles the reached part of the chain in each round; only reached candidates are
records.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, own_columns, rejoin, shared_dir, slices, text_bytes

MAGIC = b"WARC/1."
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_PACKED = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("n", pa.int64()), ("packed", pa.binary())])
_RECORD = pa.schema(
    [("record_id", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())]
)
_RECORD_SQL = "record_id string, page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _pack(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    press = zstandard.ZstdCompressor(level=7).compress
    for batch in slices(it):
        yield batches({f.name: batch.column(f.name) for f in _PACKED if f.name != "packed"} | {"packed": [press(p or b"") for p in text_bytes(batch.column("html"))]}, _PACKED)


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One record with its closing blank lines."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe=":/?#[]@!$&'()*+,;=%~-._"))
    if revisit:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {_urn(refers_to)}"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _lines(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records without their last byte, which the text writer adds."""
    unpack = zstandard.ZstdDecompressor().decompress
    for whole in it:
        for batch in (whole.slice(k, 256) for k in range(0, len(whole), 256)):
            cols = {name: batch.column(name).to_pylist() for name in ("page_id", "url", "digest", "packed", "refers_to", "revisit")}
            out = [record(i, u, unpack(z), base64.b32encode(bytes.fromhex(d)).decode(), r, v)[:-1] for i, u, d, z, r, v in zip(*cols.values(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()).cast(pa.string())], names=["value"])


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit_bytes: int = 0, records_per_file: int = 2000) -> None:
    """Write one record per row as gzip-compressed WARC files under ``path``.

    Of rows with equal payloads of at least ``min_revisit_bytes`` bytes, the one with the largest id becomes a response
    and the others revisit it; smaller payloads are all responses.  A null html is an empty payload, a null url writes
    no target.  Rows that share the largest id are all responses; a null id counts as smaller than any other.  An empty
    table writes no record.  A payload travels compressed, and a hot one is dealt over several tasks.
    """
    rows = own_columns(pages, page_id=id_col, url=url_col, html=html_col).select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    hashed = rows.select("page_id", "url", F.sha1(F.col("html").cast("binary")).alias("digest"), F.octet_length("html").cast("long").alias("n"), "html")
    # The digests are grouped by themselves, in the JVM, so that payloads are packed and shuffled once.
    last = hashed.groupBy("digest").agg(F.max("page_id").alias("last"))
    joined = rejoin(hashed.mapInArrow(_pack, "page_id long, url string, digest string, n long, packed binary"), last, "digest")
    revisit = (F.col("n") >= min_revisit_bytes) & F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last"))
    planned = joined.select("page_id", "url", "digest", "packed", F.when(revisit, F.col("last")).alias("refers_to"), revisit.alias("revisit"))
    planned.mapInArrow(_lines, "value string").write.option("maxRecordsPerFile", records_per_file).option("compression", "gzip").mode("errorifexists").text(path)


_LENGTH = re.compile(rb"\r\nContent-Length:[ \t]*(\d+)[ \t]*(?=\r\n|$)", re.I)
_FIELD = re.compile(rb"\r\n([!-9;-~]+):[ \t]*([^\r\n]*)")


def candidates(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, start of the block, successor) of every place with a magic; successor -1 if no record can stand there.

    A header may be of any length.  Its end and its length field are those of the place before where they still lie
    ahead, so that nothing is searched twice.
    """
    starts, blocks, nexts = [], [], []
    head, length = 0, None
    at = data.find(MAGIC)
    while at >= 0:
        new = 0 <= head < at or not starts
        if new:
            head = data.find(b"\r\n\r\n", at)
        if new or (length and length.start() < at):
            length = _LENGTH.search(data, at, head) if head >= 0 else None
        end = head + 4 + int(length[1]) if length else -1
        starts.append(at)
        blocks.append(head + 4)
        nexts.append(end + 4 if length and data[end : end + 4] == b"\r\n\r\n" else -1)
        at = data.find(MAGIC, at + 1)
    return np.array(starts, np.int64), np.array(blocks, np.int64), np.array(nexts, np.int64)


def reached(starts: np.ndarray, nexts: np.ndarray) -> np.ndarray:
    """Which candidates the chain from offset 0 passes; each round doubles the jumps."""
    n = len(starts)
    slot = np.minimum(np.searchsorted(starts, nexts), max(n - 1, 0))
    jump = np.where(n and starts[slot] == nexts, slot, n) if n else np.empty(0, np.int64)
    jump = np.append(jump, n)
    seen = np.zeros(n + 1, bool)
    if n and starts[0] == 0:
        seen[0] = True
    while True:
        now = np.unique(jump[np.flatnonzero(seen)])
        if seen[now].all():
            break
        seen[now] = True
        jump = jump[jump]
    out = seen[:n]
    return out & (nexts >= 0)


def _page_id(urn: bytes | None) -> int | None:
    m = re.search(rb"urn:page:(-?\d+)", urn or b"")
    return int(m[1]) if m else None


def parse(data: bytes) -> Iterator[tuple]:
    """The records of one archive."""
    starts, blocks, nexts = candidates(data)
    keep = reached(starts, nexts)
    for start, block, end in zip(starts[keep].tolist(), blocks[keep].tolist(), nexts[keep].tolist(), strict=True):
        fields = {k.lower(): v for k, v in _FIELD.findall(data, start, block - 2)}
        kind = fields.get(b"warc-type", b"").decode("latin-1")
        body = data[block : end - 4]
        split = body.find(b"\r\n\r\n") if fields.get(b"content-type", b"").startswith(b"application/http") else -4
        payload = body[split + 4 :] if split != -1 else body
        declared = _LENGTH.search(body, 0, split) if split >= 0 else None
        digest = fields.get(b"warc-payload-digest", b"").decode("latin-1").removeprefix("sha1:")
        size = int(declared[1]) if kind == "revisit" and declared else len(payload)
        target = fields.get(b"warc-target-uri")
        if kind != "revisit":
            digest = payload_digest(payload)
        yield fields.get(b"warc-record-id", b"").decode("latin-1"), _page_id(fields.get(b"warc-record-id")), target.decode("latin-1") if target is not None else None, kind, _page_id(fields.get(b"warc-refers-to")), digest, size, None if kind == "revisit" else payload


def _read(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        for content in batch.column(0):
            rows, size = [], 0
            data = content.as_py()
            for row in parse(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data):
                rows.append(row)
                size += row[6]
                if size > 1 << 22:
                    yield batches(dict(zip(_RECORD.names, zip(*rows, strict=True), strict=True)), _RECORD)
                    rows, size = [], 0
            if rows:
                yield batches(dict(zip(_RECORD.names, zip(*rows, strict=True), strict=True)), _RECORD)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """All records of the archives, plain or compressed as a whole, under ``path``.

    record_id, page_id (of ids written here), url, record_type, refers_to, payload_digest (recomputed where there is a
    payload), payload_bytes (of the full payload; for revisits from the kept response header) and payload.  What the
    chain from a file's start doesn't reach, such as records after a truncation, is not returned.  One archive is held
    by one task; ``write_archives`` bounds their size.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(_read, _RECORD_SQL)


def round_trip(pages: DataFrame, **columns: str) -> DataFrame:
    """Write ``pages`` to a new folder in the shared directory and read it back."""
    path = f"{shared_dir(pages.sparkSession).rstrip('/')}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path, **columns)
    return read_archives(pages.sparkSession, path)
