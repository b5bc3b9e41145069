"""Substring dedup of words by compaction of a De Bruijn graph.

Token k-mers (k = 20) are the graph's edges, runs of 19 tokens its nodes.  Every edge of every document is sent, once, to
the partition of its anchor (the smallest 10-gram name in it): edges that follow each other and have the same anchor
travel as one walk, 5 bytes for each edge and a coordinate for the walk.  Equal walks of a task are reduced to the first
before they are sent.  A partition groups its edges by name; an edge is repeated if it starts earlier elsewhere, and its
name in the graph is its first coordinate (document, position).  Repeated edges that follow each other in a walk and at
the source are compacted to one row there.

The rows of a document meet in a join and are compacted along its walk to long spans.  The nodes at which a walk enters
or leaves a source's path are the graph's branching nodes; ``compacted`` counts them by aggregation over all documents
and cuts every source into its nonbranching paths.  Every span is verified by a join with the document at its source
coordinate, whose words must equal its own, before any word is removed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batches, buckets, cut, free, give_back, slices
from .repeats import HIT, HIT_SQL, LOWEST, SETTLED, Named, Rule, _hits, _passed, _pieces, _planes, _rank, _unplane, by_document, found, keyed, later, number, pack, refine, removed, runs, unpacked, verified, with_rest
from .rolling import U64

WINDOW_WORDS, GRAM_WORDS = 20, 10
_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.int64())), ("kept", pa.string())])
_BLOB = pa.schema([("bucket", pa.int64()), ("blob", pa.binary()), *HIT])
_SPANS_SQL = "id long, ord long, spans array<struct<start:long,end:long,sid:long,sord:long,at:long>>"
_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("sid", pa.int64()), ("sord", pa.int64()), ("at", pa.int64())])
_SPANS = pa.schema([("id", pa.int64()), ("ord", pa.int64()), ("spans", pa.list_(_SPAN))])
#: Edges gathered before they are sent, and parts of a partition that are grouped one after the other.
_FLUSH, _SHARES = 1 << 21, 8


def _edge_map(rule: Rule, n_buckets: int) -> Callable:
    """Walks of edges by the bucket of their anchor, as blobs; and the hits of walks that a task has seen before."""

    def flush(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        docs = np.cumsum([0, *(len(r[0]) for r in rows)])
        ids, ords = (np.concatenate([r[k] for r in rows]) for k in (0, 1))
        doc = np.concatenate([r[2] + d for r, d in zip(rows, docs, strict=False)])
        pos, n, whole, anchor, edges = (np.concatenate([r[k] for r in rows]) for k in (3, 4, 5, 6, 7))
        rank = _rank(ids, ords)[doc]
        gone, first = later(refine(np.zeros(len(whole), np.int64), whole, rank, rule.within), rank, pos, rule.within)
        at = np.flatnonzero(gone)
        hits = _hits(ids[doc], ords[doc], pos, number(pos[at], n[at], np.zeros(len(at), np.int64), SETTLED), at, first)
        keep = np.flatnonzero(~gone)
        bucket = ((anchor[keep] >> U64(32)) % U64(n_buckets)).astype(np.int64)
        keep = keep[np.argsort(bucket, kind="stable")]
        limits = np.searchsorted(np.sort(bucket), np.arange(n_buckets + 1))
        begin = np.cumsum(n) - n
        for b in range(n_buckets):
            own = keep[limits[b] : limits[b + 1]]
            if not len(own):
                continue
            used, local = np.unique(doc[own], return_inverse=True)
            names = edges[np.repeat(begin[own] - np.cumsum(n[own]) + n[own], n[own]) + np.arange(n[own].sum())]
            head = np.array([len(own), len(used), len(names)], np.int64).tobytes()
            steps = [np.diff(x.astype(np.uint32), prepend=np.uint32(0)) for x in (local, pos[own])]
            blob = head + _planes(ids[used], ords[used]) + _planes(*steps, n[own].astype(np.uint16), anchor[own].astype(np.uint32)) + _planes((names >> U64(32)).astype(np.uint32), (names >> U64(24)).astype(np.uint8))
            empty = np.zeros(1, np.int64)
            yield batches({"bucket": [b], "blob": [blob]} | {f.name: empty for f in HIT}, _BLOB)
        if len(at):
            yield batches(hits | {"bucket": np.arange(len(at)) % n_buckets, "blob": [None] * len(at)}, _BLOB)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        for batch in slices(it):
            for ids, ords, texts, _ in _pieces(batch):
                x = Named(texts, rule)
                names = x.grams(rule.gram)
                begin, n, anchor = runs(x, names, rule)
                if not len(begin):
                    continue
                starts = np.repeat(begin, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                whole = x.ranges(begin, begin + n - 1 + rule.window, rule.window)
                rows.append((ids, ords, x.doc[begin], begin - x.start[begin], n, whole, names[anchor], x.ranges(starts, starts + rule.window, rule.window)))
                held += len(starts)
                if held >= _FLUSH:
                    yield from flush(rows)
                    rows, held = [], 0
        if rows:
            yield from flush(rows)
        give_back()

    return run


def _received(table: pa.Table) -> Iterator[tuple]:
    """ids, ords, positions, lengths and anchors of the walks of every blob, and the names of their edges."""
    for blob in table.column("blob"):
        if not blob.is_valid:
            continue
        data = memoryview(blob.as_buffer())
        n_walks, n_docs, n_edges = np.frombuffer(data, np.int64, 3).tolist()
        (ids, ords), at = _unplane(data, 24, n_docs, np.int64, np.int64)
        (local, pos, n, anchor), at = _unplane(data, at, n_walks, np.uint32, np.uint32, np.uint16, np.uint32)
        (high, low), at = _unplane(data, at, n_edges, np.uint32, np.uint8)
        local = np.cumsum(local, dtype=np.uint32)
        yield ids[local], ords[local], np.cumsum(pos, dtype=np.uint32).astype(np.int64), n.astype(np.int64), anchor, high.astype(U64) << U64(8) | low


def _grouped(walks: list[tuple], rule: Rule) -> dict:
    """Repeated edges of some anchors' walks, compacted to hits of runs that follow each other at their source too."""
    ids, ords, pos, n, anchor, names = (np.concatenate(c) for c in zip(*walks, strict=True))
    walk = np.repeat(np.arange(len(n)), n)
    offset = np.arange(len(walk)) - np.repeat(np.cumsum(n) - n, n)
    # Only edges whose name is met twice are looked at closer; 64 bits of it are enough for that.
    key = names ^ (anchor[walk].astype(U64) << U64(32))
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    some = np.sort(order[np.concatenate([same, [False]]) | np.concatenate([[False], same])])
    walk, offset, names = walk[some], offset[some], names[some]
    rank, at = _rank(ids, ords)[walk], pos[walk] + offset
    buckets = refine(refine(np.zeros(len(some), np.int64), anchor[walk], rank, rule.within), names, rank, rule.within)
    gone, first = later(buckets, rank, at, rule.within)
    edge = np.flatnonzero(gone)
    source = first[edge]
    ahead = (np.diff(walk[edge]) == 0) & (np.diff(at[edge]) == 1) & (np.diff(walk[source]) == 0) & (np.diff(at[source]) == 1)
    heads = np.flatnonzero(np.concatenate([[True], ~ahead])) if len(edge) else edge
    length = np.diff(heads, append=len(edge))
    return _hits(ids[walk], ords[walk], at, number(at[edge[heads]], length, np.zeros(len(heads), np.int64), SETTLED), edge[heads], first)


def _edge_reduce(rule: Rule) -> Callable:
    def run(key: tuple, table: pa.Table) -> pa.Table:
        out = [_passed(table)]
        for share in range(_SHARES):
            walks = []
            for ids, ords, pos, n, anchor, names in _received(table):
                own = anchor % _SHARES == share
                if own.any():
                    walks.append((ids[own], ords[own], pos[own], n[own], anchor[own], names[np.repeat(own, n)]))
            if walks:
                out.append(pa.table(_grouped(walks, rule), schema=HIT))
        return pa.concat_tables(out)

    return run


def _along(rule: Rule) -> Callable:
    """The spans of every document with hits."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(it):
            edges, columns = found(batch.column(2), rule)
            rows = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.StructArray.from_arrays([*map(pa.array, columns)], fields=list(_SPAN)))
            yield batches({"id": batch.column(0), "ord": batch.column(1), "spans": rows}, _SPANS)

    return run


def walks(docs: DataFrame, rule: Rule) -> DataFrame:
    """(id, ord, spans) of every document of ``docs`` (id, ord, text) that holds repeated edges."""
    edges = docs.select("id", "ord", "text").mapInArrow(_edge_map(rule, buckets(docs)), f"bucket long, blob binary, {HIT_SQL}")
    hits = edges.groupBy("bucket").applyInArrow(_edge_reduce(rule), HIT_SQL)
    return by_document(hits, "hits").mapInArrow(_along(rule), _SPANS_SQL)


def compacted(spans: DataFrame, window: int = WINDOW_WORDS) -> DataFrame:
    """(id, ord, start, n_words, n_walks): the nonbranching paths of the sources, from rows with spans.

    A span enters its source's path at one node and leaves it at another; between two such nodes that follow each other
    all documents go the same way.
    """
    one = spans.select(F.inline("spans"))
    last = F.col("at") + F.col("end") - F.col("start") - (window - 1)
    ends = one.select("sid", "sord", F.inline(F.array(F.struct(F.col("at").alias("node"), F.lit(1).alias("step")), F.struct(last.alias("node"), F.lit(-1).alias("step")))))
    nodes = ends.groupBy("sid", "sord", "node").agg(F.sum("step").alias("step"))
    along = Window.partitionBy("sid", "sord").orderBy("node")
    paths = nodes.select(F.col("sid").alias("id"), F.col("sord").alias("ord"), F.col("node").alias("start"), (F.lead("node").over(along) - F.col("node") + window - 1).alias("n_words"), F.sum("step").over(along).alias("n_walks"))
    return paths.where("n_walks > 0")


def repeated_paths(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW_WORDS, gram: int = GRAM_WORDS) -> DataFrame:
    """(doc_id, start, n_words, n_walks): where the corpus's repeated nonbranching paths stand for the first time in a task.

    n_walks counts the later documents' spans that go along the path.  The same nulls and repeats as in
    ``remove_repeated_words`` apply.
    """
    rule = Rule("words", window, gram, within=True)
    paths = compacted(walks(keyed(docs, id_col, text_col), rule), window)
    return paths.select(F.when(F.col("id") != F.lit(LOWEST), F.col("id")).alias("doc_id"), "start", "n_words", "n_walks")


def _cut_out(rule: Rule, untouched: bool) -> Callable:
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(it):
            n_words, n_removed, spans, kept = [], [], [], []
            own_spans = found(batch.column(4), rule)
            for k, text in enumerate(unpacked(batch.column(2))):
                words = text.split()
                gone = removed(batch, k, len(words), rule, own_spans)
                n_words.append(len(words))
                n_removed.append(0 if gone is None else int(gone.sum()))
                edges = [] if gone is None else np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))).tolist()
                spans.append(edges)
                stay = [0, *edges, len(words)]
                kept.append(text if untouched and gone is None else b" ".join([w for a, b in zip(stay[::2], stay[1::2], strict=True) for w in words[a:b]]))
            text = pa.array(kept, pa.binary()).cast(pa.string())
            own = batches({"doc_id": batch.column(0), "n_words": n_words, "n_removed": n_removed, "spans": spans, "kept": text}, _OUT)
            yield pa.RecordBatch.from_arrays([*own.columns, batch.column(3)], names=[*_OUT.names, "rest"])

    return run


def remove_repeated_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW_WORDS, gram: int = GRAM_WORDS, carry: Sequence[str] = (), untouched: bool = False) -> DataFrame:
    """Remove every word covered by a ``window``-word sequence that also starts earlier in the corpus.

    Earlier means in a document with a smaller id, or in the same document at a smaller position; sequences are judged
    on the input.  Returns doc_id, n_words, n_removed, spans (removed runs as start, end, start, end ... in words) and
    kept (the other words joined by one space; the text as it is where nothing is removed, if ``untouched``), and the
    columns named in ``carry`` under their names.  Words are runs of anything but ASCII white space.  A null text has no
    words; texts under ``window`` words lose nothing.  A null id counts as smaller than any other; rows that agree in
    id and text count as one document, so neither removes the other; rows that share only the id are ordered by a hash
    of their texts.  One document's names are held in the memory of one task; any number of documents may share a
    passage.
    """
    rule = Rule("words", window, gram, within=True)
    rows = keyed(docs, id_col, text_col, carry)
    spans = cut(walks(rows, rule))
    free(docs.sparkSession)
    packed = pack(rows)
    spanned = packed.join(spans, ["id", "ord"], "left").select("id", "ord", "text", "rest", "spans")
    out = verified(spanned, packed, rule).mapInArrow(_cut_out(rule, untouched), with_rest("doc_id long, n_words long, n_removed long, spans array<long>, kept string", packed))
    out = out.withColumn("doc_id", F.when(F.col("doc_id") != F.lit(LOWEST), F.col("doc_id")))
    return out.select(*_OUT.names, *([f"rest.`{c}`" for c in carry]))
