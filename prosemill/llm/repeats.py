"""Repeated windows of bytes by sampled suffixes, and what both operators that remove repeats share.

For every window of L bytes of a document the question is whether an equal window starts in an earlier document.
Listing every window of a corpus would shuffle many times the input, so the search goes from few rows to many:

1. *Anchors.*  Every window holds an anchor: the smallest q-gram name in it.  A task names all q-grams of its documents
   and sends for every anchor one row: the name of its q-gram (the initial bucket), the name of the whole context of
   2L - q bytes around it, two short names of half contexts and its coordinate.
2. *Contexts.*  Equal contexts hold equal windows, so all but the first are settled at once.  Any window holds the left
   or the right half context of its anchor, so of the others only those that share a half with another one of their
   bucket stay open, to that side.
3. *Windows.*  The windows of open contexts are compared one by one; all but the first are settled.

Equal rows of a task are reduced to the first before they are sent, so a key sends at most one row per task however
many documents hold it.  What is settled are hits, each with the coordinate of an earlier equal; names only propose
them.  Hits that follow each other at one distance from their source make long spans; a span's units are compared with
those at its source, in the document itself, before anything is removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches, buckets, cut, free, give_back, slices, text_bytes
from .rolling import U64, bounds, byte_names, doubled, least, mix, word_names

#: Kinds of hits: settled runs of windows, contexts open to a side, settled windows.
SETTLED, LEFT, RIGHT, WINDOW = 0, 1, 2, 4
#: A hit's number: position, place of the anchor after it, windows in the run, kind.
_AT, _OFF, _N = 27, 15, 3
_FIELD = (1 << 12) - 1
#: Units named at once, and rows kept before they are sent; neither changes a result.
_PIECE, _FLUSH = 1 << 18, 1 << 19
_BLOB = pa.schema([("bucket", pa.int64()), ("blob", pa.binary()), ("id", pa.int64()), ("ord", pa.int64()), ("v", pa.int64()), ("sid", pa.int64()), ("sord", pa.int64()), ("spos", pa.int64())])
HIT = pa.schema(list(_BLOB)[2:])
HIT_SQL = "id long, ord long, v long, sid long, sord long, spos long"
HITS_SQL = "array<struct<v:bigint,sid:bigint,sord:bigint,spos:bigint>>"
LOWEST = -(1 << 63)
_SPAN = pa.struct([("id", pa.int64()), ("ord", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("at", pa.int64()), ("digest", pa.binary())])
_CLAIM = pa.schema([("sid", pa.int64()), ("sord", pa.int64()), ("claims", pa.list_(_SPAN))])
_CLAIM_SQL = "sid long, sord long, claims array<struct<id:long,ord:long,start:long,end:long,at:long,digest:binary>>"
_REFUTED = pa.schema([("id", pa.int64()), ("ord", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])
_REFUTED_SQL = "id long, ord long, start long, end long"
#: Claims that a task gathers before it sends them, one row for each source.
_GATHERED = 5_000


@dataclass(frozen=True)
class Rule:
    """unit: bytes or words.  window, gram: lengths in units.  within: an earlier start in the same document counts."""

    unit: str
    window: int
    gram: int
    within: bool

    def __post_init__(self) -> None:
        if not 0 < self.gram <= self.window <= _FIELD:
            raise ValueError(f"0 < gram <= window <= {_FIELD}")

    @property
    def context(self) -> int:
        return self.window - self.gram

    def units(self, text: bytes) -> Sequence:
        return text.split() if self.unit == "words" else text

    def digest(self, units: Sequence) -> bytes:
        return hashlib.blake2b(b" ".join(units) if self.unit == "words" else units, digest_size=16).digest()


def keyed(docs: DataFrame, id_col: str, text_col: str, carry: Sequence[str] = ()) -> DataFrame:
    """(id, ord, text, rest) with the columns to carry in the struct rest.

    A null id counts as the smallest.  Where ids repeat, ord is a hash of the text, so that rows of one id are told apart
    without a task that sees them all.
    """
    rest = F.struct(*[docs[f"`{c}`"].alias(c) for c in carry]) if carry else F.struct(F.lit(0).alias("none"))
    rows = docs.select(docs[f"`{id_col}`"].alias("id"), docs[f"`{text_col}`"].alias("text"), rest.alias("rest")).withColumn("id", F.coalesce(F.col("id").cast("long"), F.lit(LOWEST)))
    unique = rows.groupBy("id").count().where("count > 1").isEmpty()
    place = F.lit(0).cast("long") if unique else F.xxhash64(F.coalesce("text", F.lit("")))
    return rows.select("id", place.alias("ord"), "text", "rest")


def kind_of(v: Column) -> Column:
    return v.bitwiseAND(F.lit(7))


def number(pos: np.ndarray, n: np.ndarray, off: np.ndarray, kind: np.ndarray | int) -> np.ndarray:
    return (pos.astype(np.int64) << _AT) | (off.astype(np.int64) << _OFF) | (n.astype(np.int64) << _N) | kind


class Named:
    """Names over a piece of concatenated documents."""

    def __init__(self, texts: list[bytes | None], rule: Rule):
        if rule.unit == "bytes":
            lengths = np.array([len(t or b"") for t in texts], np.int64)
            first = byte_names(np.frombuffer(b"".join(t or b"" for t in texts), np.uint8))
        else:
            words = [(t or b"").split() for t in texts]
            lengths = np.array([len(w) for w in words], np.int64)
            sizes = np.fromiter((len(w) for ws in words for w in ws), np.int64, int(lengths.sum()))
            ends = np.cumsum(sizes)
            first = word_names(np.frombuffer(b"".join(w for ws in words for w in ws), np.uint8), ends - sizes, ends)
        self.doc, self.start, self.end = bounds(lengths)
        self.levels = {1: first}
        n = 1
        while 2 * n <= rule.window:
            self.levels[2 * n] = doubled(self.levels[n], n)
            n *= 2

    def ranges(self, s: np.ndarray, e: np.ndarray, least_length: int) -> np.ndarray:
        """Names of [s, e), all at least ``least_length`` and at most three times the largest doubled length below it."""
        n = max(k for k in self.levels if k <= least_length)
        names = self.levels[n]
        middle = np.minimum(s + n, e - n)
        return mix(mix(names[s], names[middle]), mix(names[e - n], (e - s).astype(U64)))

    def grams(self, q: int) -> np.ndarray:
        n = max(k for k in self.levels if k <= q)
        names = self.levels[n]
        if n == q or len(names) <= q - n:
            return names
        out = names.copy()
        out[: len(names) - (q - n)] = mix(names[: len(names) - (q - n)], names[q - n :])
        return out


def _planes(*arrays: np.ndarray) -> bytes:
    """Arrays of one length as byte planes, so that a compressor finds the high bytes side by side."""
    return b"".join(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes() for a in arrays)


def _unplane(blob: bytes, at: int, n: int, *kinds: type) -> tuple[list[np.ndarray], int]:
    out = []
    for kind in kinds:
        width = np.dtype(kind).itemsize
        plane = np.frombuffer(blob, np.uint8, n * width, at).reshape(width, n)
        out.append(np.ascontiguousarray(plane.T).view(kind).reshape(n))
        at += n * width
    return out, at


class _Rows:
    """Rows gathered in a task: named columns and the coordinate (index into the task's documents, position)."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.ids: list[np.ndarray] = []
        self.ords: list[np.ndarray] = []
        self.columns: list[list[np.ndarray]] = []
        self.docs = self.n = 0

    def add(self, ids: np.ndarray, ords: np.ndarray, doc: np.ndarray, *columns: np.ndarray) -> None:
        self.columns.append([(doc + self.docs).astype(np.uint32), *columns])
        self.ids.append(ids)
        self.ords.append(ords)
        self.docs += len(ids)
        self.n += len(doc)

    def take(self) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        got = np.concatenate(self.ids), np.concatenate(self.ords), [np.concatenate(c) for c in zip(*self.columns, strict=True)]
        self.clear()
        return got


def _rank(ids: np.ndarray, ords: np.ndarray) -> np.ndarray:
    """Equal numbers for equal (id, ord), in their order."""
    order = np.lexsort((ords, ids))
    i, o = ids[order], ords[order]
    new = np.concatenate([[False], (i[1:] != i[:-1]) | (o[1:] != o[:-1])])
    rank = np.empty(len(ids), np.int64)
    rank[order] = np.cumsum(new)
    return rank


def refine(buckets: np.ndarray, identifiers: np.ndarray, rank: np.ndarray, within: bool) -> np.ndarray:
    """Buckets after sorting each of them on identifiers: new numbers, -1 for rows that are alone or were (-1) before.

    Alone is a bucket without a second document, or without a second row where a document may repeat itself.
    """
    out = np.full(len(buckets), -1, np.int64)
    rows = np.flatnonzero(buckets >= 0)
    if not len(rows):
        return out
    rows = rows[np.lexsort((rank[rows], identifiers[rows], buckets[rows]))]
    b, i, r = buckets[rows], identifiers[rows], rank[rows]
    head = np.concatenate([[True], (b[1:] != b[:-1]) | (i[1:] != i[:-1])])
    group = np.cumsum(head) - 1
    tail = np.concatenate([head[1:], [True]])
    many = np.bincount(group) > 1 if within else r[head] < r[tail]
    out[rows] = np.where(many[group], group, -1)
    return out


def later(buckets: np.ndarray, rank: np.ndarray, pos: np.ndarray, within: bool) -> tuple[np.ndarray, np.ndarray]:
    """(rows that aren't first in their bucket, the first row of each row's bucket); rows in bucket -1 are first.

    Not first: of a later document, or also of a later position.
    """
    gone, first = np.zeros(len(buckets), bool), np.arange(len(buckets))
    rows = np.flatnonzero(buckets >= 0)
    if not len(rows):
        return gone, first
    rows = rows[np.lexsort((pos[rows], rank[rows], buckets[rows]))]
    b, r, p = buckets[rows], rank[rows], pos[rows]
    head = np.concatenate([[True], b[1:] != b[:-1]])
    group = np.cumsum(head) - 1
    after = r > r[head][group]
    if within:
        after |= p > p[head][group]
    gone[rows] = after
    first[rows] = rows[head][group]
    return gone, first


def _hits(ids: np.ndarray, ords: np.ndarray, pos: np.ndarray, v: np.ndarray, rows: np.ndarray, first: np.ndarray) -> dict:
    """Hits of the given rows with the coordinates of their first equals."""
    source = first[rows]
    return {"id": ids[rows], "ord": ords[rows], "v": v, "sid": ids[source], "sord": ords[source], "spos": pos[source].astype(np.int64)}


def _settled(ids: np.ndarray, ords: np.ndarray, pos: np.ndarray, n: np.ndarray, off: np.ndarray, gone: np.ndarray, first: np.ndarray, kind: int) -> dict:
    """Hits of the rows that aren't first."""
    rows = np.flatnonzero(gone)
    return _hits(ids, ords, pos, number(pos[rows], n[rows], off[rows], kind), rows, first)


def _send(buckets: np.ndarray, n_buckets: int, ids: np.ndarray, ords: np.ndarray, columns: list[np.ndarray], hits: dict) -> Iterator[pa.RecordBatch]:
    """One blob per bucket, and the hits settled here (dealt over the buckets with the blobs).

    columns: index of the document, further columns, position.  Rows come in the order of their coordinates, so index
    and position are sent as steps, which are small.
    """
    order = np.argsort(buckets, kind="stable")
    edges = np.searchsorted(buckets[order], np.arange(n_buckets + 1))
    out: dict[str, list] = {"bucket": [], "blob": []}
    size = 0

    def batch() -> pa.RecordBatch:
        empty = np.zeros(len(out["bucket"]), np.int64)
        return batches(out | {f.name: empty for f in HIT}, _BLOB)

    for b in range(n_buckets):
        rows = order[edges[b] : edges[b + 1]]
        if not len(rows):
            continue
        used, local = np.unique(columns[0][rows], return_inverse=True)
        head = np.array([len(rows), len(used)], np.int64).tobytes()
        steps = [np.diff(x.astype(np.uint32), prepend=np.uint32(0)) for x in (local, columns[-1][rows])]
        blob = head + _planes(ids[used], ords[used]) + _planes(*steps, *(c[rows] for c in columns[1:-1]))
        out["bucket"].append(b)
        out["blob"].append(blob)
        size += len(blob)
        if size > 1 << 22:
            yield batch()
            out, size = {"bucket": [], "blob": []}, 0
    if out["bucket"]:
        yield batch()
    n = len(hits["v"])
    if n:
        yield batches(hits | {"bucket": (np.arange(n) + int(buckets[0]) if len(buckets) else np.arange(n)) % n_buckets, "blob": [None] * n}, _BLOB)


def _received(table: pa.Table, *kinds: type) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    ids, ords, columns = [], [], []
    for blob in table.column("blob").to_pylist():
        if blob is None:
            continue
        n, n_docs = np.frombuffer(blob, np.int64, 2).tolist()
        (i, o), at = _unplane(blob, 16, n_docs, np.int64, np.int64)
        (local, pos, *rest), at = _unplane(blob, at, n, np.uint32, np.uint32, *kinds)
        local = np.cumsum(local, dtype=np.uint32)
        ids.append(i[local])
        ords.append(o[local])
        columns.append([*rest, np.cumsum(pos, dtype=np.uint32)])
    if not ids:
        return np.empty(0, np.int64), np.empty(0, np.int64), [np.empty(0, k) for k in (*kinds, np.uint32)]
    return np.concatenate(ids), np.concatenate(ords), [np.concatenate(c) for c in zip(*columns, strict=True)]


def _passed(table: pa.Table) -> pa.Table:
    return table.filter(pc.is_null(table.column("blob"))).select(HIT.names).cast(HIT)


def _pack(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    press = zstandard.ZstdCompressor(level=3).compress
    for batch in slices(it):
        texts = [None if t is None else press(t) for t in text_bytes(batch.column(2))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.binary()), batch.column(3)], names=["id", "ord", "text", "rest"])


def unpacked(column: pa.Array) -> Iterator[bytes]:
    """Texts that went through a shuffle compressed, one at a time."""
    open_ = zstandard.ZstdDecompressor().decompress
    for t in column:
        yield b"" if not t.is_valid else open_(t.as_py())


def _pieces(batch: pa.RecordBatch, packed: bool = False) -> Iterator[tuple]:
    """Runs of rows with about _PIECE bytes of text: ids, ords, texts (unpacked if need be), and the last column's rows."""
    ids, ords = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
    texts = unpacked(batch.column(2)) if packed else iter(text_bytes(batch.column(2)))
    at = 0
    while at < len(ids):
        own: list[bytes | None] = []
        size = 0
        while at + len(own) < len(ids) and (size < _PIECE or not own):
            own.append(next(texts))
            size += len(own[-1] or b"")
        to = at + len(own)
        yield ids[at:to], ords[at:to], own, batch.column(batch.num_columns - 1).slice(at, to - at)
        at = to


def _half(x: Named, s: np.ndarray, e: np.ndarray, known: np.ndarray, length: int) -> np.ndarray:
    """16 bits of the names of [s, e); 0 where that leaves the document, so that no window could use it."""
    out = np.zeros(len(s), np.uint16)
    out[known] = (x.ranges(s[known], e[known], length) >> U64(48) | U64(1)).astype(np.uint16)
    return out


def runs(x: Named, names: np.ndarray, rule: Rule) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, number of windows, anchor) of the runs of windows that have the same anchor."""
    windows = np.flatnonzero(np.arange(len(names)) + rule.window <= x.end)
    if not len(windows):
        return windows, windows, windows
    anchor = least(names, rule.context + 1)[windows]
    new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (windows[1:] != windows[:-1] + 1)]))
    return windows[new], np.diff(new, append=len(windows)), anchor[new]


def _anchor_map(rule: Rule, n_buckets: int) -> Callable:
    q, h = rule.gram, -(-rule.context // 2)

    def flush(rows: _Rows) -> Iterator[pa.RecordBatch]:
        ids, ords, (doc, low, whole, left, right, n, off, pos, high) = rows.take()
        rank = _rank(ids, ords)[doc]
        gone, first = later(refine(np.zeros(len(whole), np.int64), whole, rank, rule.within), rank, pos, rule.within)
        keep = ~gone
        columns = [x[keep] for x in (doc, low, whole, left, right, n, off, pos)]
        yield from _send((high[keep] % n_buckets).astype(np.int64), n_buckets, ids, ords, columns, _settled(ids[doc], ords[doc], pos, n, off, gone, first, SETTLED))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _Rows()
        for batch in slices(it):
            for ids, ords, texts, _ in _pieces(batch):
                x = Named(texts, rule)
                if not len(x.doc):
                    continue
                names = x.grams(q)
                at = runs(x, names, rule)[2]
                start, end = x.start[at], x.end[at]
                begin = np.maximum(at - rule.context, start)
                n = np.minimum(at, end - rule.window) - begin + 1
                whole = mix(x.ranges(begin, begin + n - 1 + rule.window, rule.window), (at - begin).astype(U64))
                left = _half(x, at - h, at + q, at - h >= start, q + h)
                right = _half(x, at, at + q + h, at + q + h <= end, q + h)
                name = names[at]
                rows.add(ids, ords, x.doc[at], name.astype(np.uint16), whole, left, right, n.astype(np.uint16), (at - begin).astype(np.uint16), (begin - start).astype(np.uint32), (name >> U64(32)).astype(np.uint32))
                if rows.n >= _FLUSH:
                    yield from flush(rows)
        if rows.n:
            yield from flush(rows)
        give_back()

    return run


def _anchor_reduce(rule: Rule) -> Callable:
    """Refine the buckets of equal q-grams: on the half contexts on either side, and on the whole contexts."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        ids, ords, (low, whole, left, right, n, off, pos) = _received(table, np.uint16, U64, np.uint16, np.uint16, np.uint16, np.uint16)
        rank = _rank(ids, ords)
        buckets = refine(np.zeros(len(low), np.int64), low, rank, rule.within)
        gone, first = later(refine(buckets, whole, rank, rule.within), rank, pos, rule.within)
        side = np.zeros(len(ids), np.int8)
        rest = np.where(gone, -1, buckets)
        for half, which in ((left, LEFT), (right, RIGHT)):
            side[refine(np.where(half > 0, rest, -1), half, rank, rule.within) >= 0] |= which
        use = np.flatnonzero(side)
        opened = _hits(ids, ords, pos, number(pos[use], n[use], off[use], side[use]), use, np.arange(len(ids)))
        return pa.concat_tables([_passed(table), *(pa.table(hits, schema=HIT) for hits in (_settled(ids, ords, pos, n, off, gone, first, SETTLED), opened))])

    return run


def _open_windows(x: Named, v: np.ndarray, doc: np.ndarray, rule: Rule) -> np.ndarray:
    """Starts of the windows that hold a shared half context of an open anchor."""
    h = -(-rule.context // 2)
    starts = np.zeros(int(doc.max(initial=-1)) + 1, np.int64)
    here = x.doc < len(starts)
    starts[x.doc[here]] = x.start[here]
    begin = starts[doc] + (v >> _AT)
    last = begin + (v >> _N & _FIELD) - 1
    at = begin + (v >> _OFF & _FIELD)
    mark = np.zeros(len(x.doc) + 1, np.int32)
    for side, lowest, highest in ((LEFT, begin, np.minimum(last, at - h)), (RIGHT, np.maximum(begin, at - (rule.context - h)), last)):
        use = (v & 7 < WINDOW) & (v & side > 0) & (lowest <= highest)
        np.add.at(mark, lowest[use], 1)
        np.add.at(mark, highest[use] + 1, -1)
    return np.flatnonzero(np.cumsum(mark[:-1]) > 0)


#: Bits sent of a bucket's identifier after each refinement, and after the last one.
_BITS, _LAST_BITS = 16, 48


def _kinds(rule: Rule) -> tuple[list[int], list[type]]:
    """Later offsets of the q-grams that cover a window, and the types of the identifiers sent for them."""
    steps = [*range(rule.gram, rule.context, rule.gram), rule.context]
    return steps, [*[np.uint16] * (len(steps) - 1), U64]


def _identifiers(names: np.ndarray, s: np.ndarray, rule: Rule) -> list[np.ndarray]:
    """For suffixes at s, the identifiers of the buckets in which they stand after each refinement.

    A refined bucket is named by its identifier before and that of the bucket at the later offset, so the last one depends on
    all of a window: windows that differ in a single q-gram, of which a corpus has many, are told apart by 48 bits.
    """
    steps, kinds = _kinds(rule)
    out, now = [], names[s]
    for k, kind in zip(steps, kinds, strict=True):
        now = mix(now, names[s + k])
        out.append((now >> U64(64 - (_LAST_BITS if kind is U64 else _BITS))).astype(kind))
    return out


def _window_map(rule: Rule, n_buckets: int) -> Callable:
    """Windows as suffixes: the bucket of the first q-gram, and the identifiers of its refinements at the later offsets."""

    def flush(rows: _Rows) -> Iterator[pa.RecordBatch]:
        ids, ords, (doc, high, *identifiers, pos) = rows.take()
        rank = _rank(ids, ords)[doc]
        buckets = refine(np.zeros(len(high), np.int64), high, rank, rule.within)
        for i in identifiers:
            buckets = refine(buckets, i, rank, rule.within)
        gone, first = later(buckets, rank, pos, rule.within)
        keep, one = ~gone, np.ones(len(pos), np.int64)
        yield from _send(high[keep].astype(np.int64) % n_buckets, n_buckets, ids, ords, [x[keep] for x in (doc, *identifiers, pos)], _settled(ids[doc], ords[doc], pos, one, one - 1, gone, first, WINDOW))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _Rows()
        for batch in slices(it):
            for ids, ords, texts, hits in _pieces(batch, packed=True):
                x = Named(texts, rule)
                v = hits.flatten().to_numpy(zero_copy_only=False)
                s = _open_windows(x, v, np.repeat(np.arange(len(ids)), np.diff(hits.offsets.to_numpy())), rule)
                names = x.grams(rule.gram)
                rows.add(ids, ords, x.doc[s], (names[s] >> U64(32)).astype(np.uint32), *_identifiers(names, s, rule), (s - x.start[s]).astype(np.uint32))
                if rows.n >= _FLUSH:
                    yield from flush(rows)
        if rows.n:
            yield from flush(rows)
        give_back()

    return run


def _window_reduce(rule: Rule) -> Callable:
    """Refine buckets of first q-grams on the identifiers at one later offset after the other."""
    kinds = _kinds(rule)[1]

    def run(key: tuple, table: pa.Table) -> pa.Table:
        ids, ords, (*identifiers, pos) = _received(table, *kinds)
        rank = _rank(ids, ords)
        buckets = np.zeros(len(pos), np.int64)
        for i in identifiers:
            buckets = refine(buckets, i, rank, rule.within)
        gone, first = later(buckets, rank, pos, rule.within)
        one = np.ones(len(pos), np.int64)
        return pa.concat_tables([_passed(table), pa.table(_settled(ids, ords, pos, one, one - 1, gone, first, WINDOW), schema=HIT)])

    return run


def with_rest(ddl: str, docs: DataFrame) -> T.StructType:
    """The schema of ``ddl`` and the struct of carried columns."""
    return T.StructType.fromDDL(ddl).add(docs.schema["rest"])


def with_hits(docs: DataFrame, rule: Rule) -> tuple[DataFrame, DataFrame]:
    """(documents with hits, packed documents).

    The first has id, ord, the packed text, rest, and the hits of contexts and windows as arrays hits and more, or null, of
    (v, sid, sord, spos) with the coordinate of an earlier equal.

    The hits of contexts are cut off first, so that the shuffle of the anchors is gone before texts are shuffled.  Every
    branch of the plan behind asks for the same columns of the shuffled documents and hits, so that each is shuffled once
    and used again; a column less in one of them would be another shuffle.
    """
    n = buckets(docs)
    blob = f"bucket long, blob binary, {HIT_SQL}"
    first = docs.select("id", "ord", "text").mapInArrow(_anchor_map(rule, n), blob).groupBy("bucket").applyInArrow(_anchor_reduce(rule), HIT_SQL)
    settled = cut(by_document(first, "hits"))
    free(docs.sparkSession)
    packed = pack(docs)
    held = packed.join(settled, ["id", "ord"], "left")
    values = F.transform("hits", lambda h: h["v"])
    is_open = F.coalesce(F.exists(values, lambda v: v.bitwiseAND(F.lit(7)).isin(LEFT, RIGHT, LEFT | RIGHT)), F.lit(False))
    # No filter here: it would be pushed below the join and keep its shuffles from being used again further down.
    opened = held.select("id", "ord", F.when(is_open, F.col("text")).alias("text"), "rest", F.when(is_open, values).alias("hits"))
    second = opened.mapInArrow(_window_map(rule, n), blob).groupBy("bucket").applyInArrow(_window_reduce(rule), HIT_SQL)
    return held.join(by_document(second, "more"), ["id", "ord"], "left"), packed


def by_document(hits: DataFrame, name: str) -> DataFrame:
    return hits.groupBy("id", "ord").agg(F.collect_list(F.struct("v", "sid", "sord", "spos")).alias(name))


def pack(docs: DataFrame) -> DataFrame:
    """Rows id, ord, text, rest with the texts compressed for a shuffle.

    Keys are declared never null: a join that had to filter nulls first would shuffle the texts a second time for itself.
    """
    return docs.mapInArrow(_pack, with_rest("id long not null, ord long not null, text binary", docs))


def spans(pos: np.ndarray, n: np.ndarray, sid: np.ndarray, sord: np.ndarray, spos: np.ndarray, window: int) -> list[np.ndarray]:
    """Hits of one document compacted to long spans: start, end, source id and ord, start at the source.

    Hits at one distance from one source that touch or overlap become one span.
    """
    return _spans_of_rows(np.zeros(len(pos), np.int64), pos, n, sid, sord, spos, window)[1:]


def _spans_of_rows(row: np.ndarray, pos: np.ndarray, n: np.ndarray, sid: np.ndarray, sord: np.ndarray, spos: np.ndarray, window: int) -> list[np.ndarray]:
    """``spans`` of many documents at once, with their rows first and in the order of these."""
    by, end = pos - spos, pos + n - 1 + window
    order = np.lexsort((pos, by, sord, sid, row))
    r, s, e, i, o, b = row[order], pos[order], end[order], sid[order], sord[order], by[order]
    if not len(s):
        return [r, s, e, i, o, s]
    apart = np.concatenate([[True], (r[1:] != r[:-1]) | (i[1:] != i[:-1]) | (o[1:] != o[:-1]) | (b[1:] != b[:-1])])
    wide = int(e.max()) + 1
    far = np.maximum.accumulate(e + (np.cumsum(apart) - 1) * wide) - (np.cumsum(apart) - 1) * wide
    new = apart | np.concatenate([[True], s[1:] > far[:-1]])
    heads = np.flatnonzero(new)
    return [r[heads], s[heads], far[np.append(heads[1:], len(s)) - 1], i[heads], o[heads], s[heads] - b[heads]]


def _flat(column: pa.Array) -> tuple[np.ndarray, dict[str, pa.Array]]:
    """Where each row's structs begin and end among those of all rows, and their fields; a null row has none."""
    edges = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False))]).astype(np.int64)
    own = column.flatten()
    return edges, {f.name: x for f, x in zip(own.type, own.flatten(), strict=True)}


def found(column: pa.Array, rule: Rule) -> tuple[np.ndarray, list[np.ndarray]]:
    """The spans of all rows, from structs of hits (v, sid, sord, spos) or of spans, and where each row's begin and end."""
    edges, own = _flat(column)
    fields = {name: x.to_numpy(zero_copy_only=False) for name, x in own.items()}
    if "v" not in fields:
        return edges, [fields[name] for name in ("start", "end", "sid", "sord", "at")]
    v = fields["v"]
    use = ((v & 7) == SETTLED) | ((v & 7) == WINDOW)
    row = np.repeat(np.arange(len(column)), np.diff(edges))[use]
    sid, sord, spos = (fields[name][use] for name in ("sid", "sord", "spos"))
    row, *out = _spans_of_rows(row, v[use] >> _AT, v[use] >> _N & _FIELD, sid, sord, spos, rule.window)
    return np.searchsorted(row, np.arange(len(column) + 1)), out


def _by_source(columns: list[np.ndarray], digests: list[bytes]) -> pa.RecordBatch:
    """A row for each source with the claims on it; columns: id, ord, start, end, at, sid, sord."""
    order = np.lexsort((columns[6], columns[5]))
    *own, sid, sord = (c[order] for c in columns)
    heads = np.flatnonzero(np.concatenate([[True], (sid[1:] != sid[:-1]) | (sord[1:] != sord[:-1])]))
    claims = pa.StructArray.from_arrays([*map(pa.array, own), pa.array(digests, pa.binary()).take(pa.array(order))], fields=list(_SPAN))
    lists = pa.ListArray.from_arrays(pa.array(np.append(heads, len(sid)), pa.int32()), claims)
    return batches({"sid": sid[heads], "sord": sord[heads], "claims": lists}, _CLAIM)


def _claims(rule: Rule) -> Callable:
    """Spans with a digest of their own units, gathered by the document whose units they should equal.

    Rows hold id, ord, the packed text, rest and the hits or spans.  A source's text then meets one row for each task, not one for
    each span.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered: list[list[np.ndarray]] = []
        digests: list[bytes] = []

        def flush() -> Iterator[pa.RecordBatch]:
            columns = [np.concatenate(c) for c in zip(*gathered, strict=True)]
            for k in range(0, len(digests), _GATHERED):
                yield _by_source([c[k : k + _GATHERED] for c in columns], digests[k : k + _GATHERED])
            gathered.clear()
            digests.clear()

        for batch in slices(it):
            edges, (start, end, sid, sord, at) = found(batch.column(4), rule)
            n = np.diff(edges)
            use = np.flatnonzero(n)
            ids, ords = (np.repeat(batch.column(c).to_numpy(zero_copy_only=False), n) for c in (0, 1))
            gathered.append([ids, ords, start, end, at, sid, sord])
            starts, ends = start.tolist(), end.tolist()
            for k, text in zip(use.tolist(), unpacked(batch.column(2).take(pa.array(use))), strict=True):
                units = rule.units(text)
                digests += [rule.digest(units[a:b]) for a, b in zip(starts[edges[k] : edges[k + 1]], ends[edges[k] : edges[k + 1]], strict=True)]
            if len(digests) >= _GATHERED:
                yield from flush()
        if digests:
            yield from flush()
        give_back()

    return run


def _refuted(rule: Rule) -> Callable:
    """Claims whose units differ from those at their source; rows hold sid, sord, claims and the source's packed text."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(it, 50):
            edges, own = _flat(batch.column(2))
            digest = own["digest"].to_pylist()
            start, end, at = (own[f].to_numpy(zero_copy_only=False).tolist() for f in ("start", "end", "at"))
            rows = []
            for a, b, text in zip(edges[:-1].tolist(), edges[1:].tolist(), unpacked(batch.column(3)), strict=True):
                units = rule.units(text)
                rows += [k for k in range(a, b) if rule.digest(units[at[k] : at[k] + end[k] - start[k]]) != digest[k]]
            if rows:
                yield batches({f: own[f].take(pa.array(rows)) for f in _REFUTED.names}, _REFUTED)
        give_back()

    return run


def verified(rows: DataFrame, packed: DataFrame, rule: Rule) -> DataFrame:
    """``rows`` (id, ord, packed text, rest, hits) with the column bad: the spans that aren't equal to their source.

    A refuted span is left alone: names of 64 bits and more agreed by accident.
    """
    claims = rows.mapInArrow(_claims(rule), _CLAIM_SQL)
    at_source = claims.join(packed, (F.col("sid") == F.col("id")) & (F.col("sord") == F.col("ord")))
    refuted = at_source.select("sid", "sord", "claims", "text", "rest").mapInArrow(_refuted(rule), _REFUTED_SQL)
    bad = refuted.groupBy("id", "ord").agg(F.collect_list(F.struct("start", "end")).alias("bad"))
    return rows.join(bad, ["id", "ord"], "left")


def removed(batch: pa.RecordBatch, k: int, n: int, rule: Rule, spans_found: tuple[np.ndarray, list[np.ndarray]] | None = None) -> np.ndarray | None:
    """Which of the n units of row k the verified spans cover; None where that is none.  Columns 4 and 5: hits, bad.

    spans_found are those ``found`` in column 4, so that they are looked for once for all rows.
    """
    edges, (start, end, *_) = spans_found or found(batch.column(4), rule)
    start, end = start[edges[k] : edges[k + 1]], end[edges[k] : edges[k + 1]]
    if batch.column(5)[k].is_valid:
        bad = {(b["start"], b["end"]) for b in batch.column(5)[k].as_py()}
        good = np.array([span not in bad for span in zip(start.tolist(), end.tolist(), strict=True)], bool)
        start, end = start[good], end[good]
    if not len(start):
        return None
    mark = np.zeros(n + 1, np.int32)
    np.add.at(mark, start, 1)
    np.add.at(mark, end, -1)
    return np.cumsum(mark[:-1]) > 0
