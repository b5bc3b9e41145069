"""SimHash near-duplicates through deletion-variant signatures.

Two 64-bit fingerprints that differ in at most ``radius`` bits are cut into so few segments that one segment differs
in at most one bit (4 bits, 3 segments).  Each segment is indexed once for every position of one wildcard bit: two
segments differ in at most one bit exactly when they agree in one of these variants.  Fingerprints are grouped by
equal variants and verified on all 64 bits; a group emits a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import batches, components, cut, own_columns, parts, reduce_links, rejoin, slices, text_bytes

SHINGLE, SEED, BITS = 4, 42, 64
_FP = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])
_BLOB = pa.schema([("bucket", pa.int64()), ("fps", pa.binary())])
_LINK = pa.schema([("a", pa.int64()), ("b", pa.int64())])
#: Hashes whose bits are counted at once.
_SLICE = 1 << 15
#: Groups above this size are first divided by exact parts of the remaining bits.
_WIDE = 512
#: Fingerprints of one mask that a task holds at most.
_BUCKET = 1 << 20


def fingerprint(text: bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """SimHash of a UTF-8 text: A-Z lowered, words between ASCII white space, majority vote over XXH64 of shingles."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    if len(words) > shingle:
        starts, ends = starts[: len(words) - shingle + 1], ends[shingle - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    ones = np.zeros(BITS, np.int64)
    for k in range(0, len(starts), _SLICE):
        cuts = map(slice, starts[k : k + _SLICE].tolist(), ends[k : k + _SLICE].tolist())
        hashes = np.array(list(map(xxh64_intdigest, map(joined.__getitem__, cuts), repeat(seed))), np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view(np.uint64)[0])


def _fingerprint_rows(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(rows):
        fps = np.array([fingerprint(t) for t in text_bytes(batch.column(1))], np.uint64).view(np.int64)
        yield batches({"doc_id": batch.column(0), "fp": fps}, _FP)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) of every document; a null or wordless text has fingerprint zero."""
    return own_columns(docs, doc_id=id_col, text=text_col).mapInArrow(_fingerprint_rows, "doc_id long, fp long")


def segments(radius: int, bits: int = BITS) -> list[tuple[int, int]]:
    """(low bit, width) of as few segments as make one of them differ in at most one bit."""
    n = radius // 2 + 1
    edges = [bits * i // n for i in range(n + 1)]
    return list(zip(edges, np.diff(edges).tolist(), strict=False))


def _masks(radius: int) -> list[int]:
    """One mask per segment and wildcard position; equal masked values are equal variants."""
    return [((1 << width) - 1 << low) & ~(1 << bit) for low, width in segments(radius) for bit in range(low, low + width)]


def _spread(values: np.ndarray, n: int) -> np.ndarray:
    mixed = values * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(32)) % np.uint64(n)).astype(np.int64)


def _variants(radius: int, per_mask: int):
    masks = [np.uint64(m) for m in _masks(radius)]

    def emit(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for k, mask in enumerate(masks):
                share = _spread(fps & mask, per_mask)
                order = np.argsort(share, kind="stable")
                edges = np.searchsorted(share[order], np.arange(per_mask + 1))
                full = [j for j in range(per_mask) if edges[j] < edges[j + 1]]
                if full:
                    yield batches({"bucket": [k * per_mask + j for j in full], "fps": [fps[order[edges[j] : edges[j + 1]]].tobytes() for j in full]}, _BLOB)

    return emit


def _near_pairs(fps: np.ndarray, group: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Verified pairs of one group, for fingerprints sorted by group: each is held against the k-th next one."""
    at = np.arange(len(fps) - 1)
    step = 1
    while True:
        at = at[at + step < len(fps)]
        at = at[group[at] == group[at + step]]
        if not len(at):
            return
        near = at[np.bitwise_count(fps[at] ^ fps[at + step]) <= radius]
        if len(near):
            yield fps[near], fps[near + step]
        step += 1


def group_links(fps: np.ndarray, mask: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links among fingerprints that agree under ``mask``.

    A wide group is divided again: outside the mask at most ``radius`` bits differ, so of ``radius`` + 1 parts of these
    bits one agrees exactly, and only fingerprints that agree there are compared.
    """
    a, b = np.empty(0, np.uint64), np.empty(0, np.uint64)

    def take(x: np.ndarray, y: np.ndarray) -> None:
        nonlocal a, b
        a, b = np.concatenate([a, x]), np.concatenate([b, y])
        if len(a) > 1 << 20:
            a, b = reduce_links(a, b)

    key = fps & np.uint64(mask)
    order = np.argsort(key, kind="stable")
    fps, key = fps[order], key[order]
    group = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])]) if len(fps) else np.empty(0, np.int64)
    wide = np.bincount(group)[group] > _WIDE if len(fps) else np.empty(0, bool)
    for pair in _near_pairs(fps[~wide], group[~wide], radius):
        take(*pair)
    if wide.any():
        rest = [bit for bit in range(BITS) if not mask >> bit & 1]
        for part in np.array_split(rest, radius + 1):
            sub = np.uint64(mask | sum(1 << int(bit) for bit in part))
            order = np.argsort(fps[wide] & sub, kind="stable")
            some = fps[wide][order]
            key = some & sub
            for pair in _near_pairs(some, np.concatenate([[0], np.cumsum(key[1:] != key[:-1])]), radius):
                take(*pair)
    return reduce_links(a, b)


def _links(radius: int, per_mask: int):
    masks = _masks(radius)

    def join(key: tuple, table: pa.Table) -> pa.Table:
        fps = np.frombuffer(b"".join(table.column("fps").to_pylist()), np.uint64)
        a, b = group_links(fps, masks[key[0].as_py() // per_mask], radius)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)}, schema=_LINK)

    return join


def links(distinct_fps: DataFrame, radius: int = 4) -> DataFrame:
    """(a, b) links that connect every two distinct fingerprints (column fp) at most ``radius`` bits apart.

    The masked fingerprints of each mask are dealt over so many buckets that one holds a bounded number.
    """
    per_mask = max(1, -(-2 * parts(distinct_fps.sparkSession) // len(_masks(radius))), -(-distinct_fps.count() // _BUCKET))
    blobs = distinct_fps.select("fp").mapInArrow(_variants(radius, per_mask), "bucket long, fps binary")
    return blobs.groupBy("bucket").applyInArrow(_links(radius, per_mask), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 4) -> DataFrame:
    """Every document with its fingerprint and group.

    Returns doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable over links of at most
    ``radius`` differing bits).  Null, empty and wordless texts have fingerprint zero and are linked like any other;
    equal fingerprints are one node, so a group of copies of any size costs one row from here on.  An empty table gives
    an empty result; repeated doc_ids keep their rows; other columns are ignored.
    """
    fps = cut(fingerprints(docs, id_col, text_col))
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("first_doc"))
    roots = components(links(nodes, radius)).withColumnRenamed("node", "fp")
    rooted = rejoin(nodes, roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = rooted.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    of = rejoin(rooted.select("fp", "root"), smallest, "root").select("fp", "component_id")
    return rejoin(fps, of, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
