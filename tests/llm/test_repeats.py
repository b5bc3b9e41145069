import hashlib

import numpy as np
import pyarrow as pa
import pytest
import zstandard

from prosemill.llm import debruijn, repeats, suffixes


def brute(texts, window, words):
    """(id, units, removed, kept) by listing every window."""
    rows = sorted({(i, t or "") for i, t in texts})
    seen, out = set(), {}
    for i, t in rows:
        units = t.encode().split() if words else t.encode()
        gone, own = bytearray(len(units)), set()
        for s in range(len(units) - window + 1):
            key = tuple(units[s : s + window]) if words else units[s : s + window]
            if key in seen or (words and key in own):
                gone[s : s + window] = b"\1" * window
            own.add(key)
        seen |= own
        kept = [u for u, g in zip(units, gone, strict=True) if not g]
        out[i] = (len(units), sum(gone), b" ".join(kept) if words else bytes(kept))
    return out


@pytest.mark.parametrize(("window", "gram"), [(20, 10), (7, 3), (5, 5)])
def test_words(docs, texts, window, gram):
    got = debruijn.remove_repeated_words(docs, window=window, gram=gram).collect()
    want = brute(texts, window, True)
    assert len(got) == len(texts)
    for r in got:
        assert (r.n_words, r.n_removed, r.kept.encode()) == want[r.doc_id], r.doc_id
        assert sum(b - a for a, b in zip(r.spans[::2], r.spans[1::2], strict=True)) == r.n_removed


@pytest.mark.parametrize(("window", "gram"), [(50, 16), (12, 4)])
def test_bytes(docs, texts, window, gram):
    got = suffixes.remove_repeated_bytes(docs, window=window, gram=gram).collect()
    want = brute(texts, window, False)
    assert len(got) == len(texts)
    for r in got:
        assert (r.n_bytes, r.n_removed, bytes(r.kept)) == want[r.doc_id], r.doc_id


def test_carried_columns_and_untouched_text(docs):
    got = {r.doc_id: r for r in debruijn.remove_repeated_words(docs, carry=["lang", "source", "rest"], untouched=True).collect()}
    assert got[402].kept == " \n\t " and got[402].rest == "x" and got[405].lang == "de"


def test_rows_that_share_an_id(spark):
    a, b = " ".join(f"w{k}" for k in range(30)), " ".join(f"v{k}" for k in range(30))
    rows = [(5, a), (5, b), (5, a), (None, a), (9, b)]
    got = debruijn.remove_repeated_words(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 5
    assert sorted((r.doc_id or 0, r.n_removed) for r in got) == [(0, 0), (5, 0), (5, 30), (5, 30), (9, 30)]


def test_empty(nothing):
    assert debruijn.remove_repeated_words(nothing).count() == 0
    assert suffixes.remove_repeated_bytes(nothing).count() == 0


def test_result_does_not_depend_on_partitions(docs):
    one = {(r.doc_id, hashlib.md5(r.kept.encode()).hexdigest()) for r in debruijn.remove_repeated_words(docs.coalesce(1)).collect()}
    many = {(r.doc_id, hashlib.md5(r.kept.encode()).hexdigest()) for r in debruijn.remove_repeated_words(docs.repartition(9)).collect()}
    assert one == many


def hits_of(pos, n, sid, spos):
    arrays = [np.array(x, np.int64) for x in (pos, n, sid, [0] * len(pos), spos)]
    return [tuple(int(v) for v in row) for row in zip(*repeats.spans(*arrays, 4), strict=True)]


def test_hits_are_compacted_to_spans():
    assert sorted(hits_of([0, 1, 5, 9, 20], [1, 1, 1, 1, 1], [7, 7, 7, 7, 8], [10, 11, 15, 29, 3])) == [(0, 9, 7, 0, 10), (9, 13, 7, 0, 29), (20, 24, 8, 0, 3)]
    assert hits_of([1, 3, 2], [9, 1, 1], [7, 7, 7], [1, 3, 2]) == [(1, 13, 7, 0, 1)]
    assert hits_of([], [], [], []) == []


def test_refuted_spans_are_left_alone():
    press = zstandard.ZstdCompressor().compress
    rule = repeats.Rule("words", 4, 2, within=True)
    claim = {"ord": 0, "start": 0, "end": 4, "digest": rule.digest(b"b c d e".split())}
    claims = pa.array([[claim | {"id": 1, "at": 1}, claim | {"id": 2, "at": 2}]], repeats._CLAIM.field("claims").type)
    batch = pa.RecordBatch.from_arrays([pa.array([9]), pa.array([0]), claims, pa.array([press(b"a b c d e f")])], names=["sid", "sord", "claims", "text"])
    (out,) = repeats._refuted(rule)(iter([batch]))
    assert out.column("id").to_pylist() == [2]
    hit = {"sid": 9, "sord": 0}
    at = lambda pos: int(repeats.number(*np.array([[pos], [1], [0]]), repeats.WINDOW)[0])
    hits = pa.array([[hit | {"v": at(0), "spos": 2}, hit | {"v": at(8), "spos": 40}]])
    bad = pa.array([[{"start": 0, "end": 4}]])
    row = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([0]), pa.array([b""]), pa.array([0]), hits, bad], names=list("abcdef"))
    assert np.flatnonzero(repeats.removed(row, 0, 20, rule)).tolist() == [8, 9, 10, 11]


def test_refinement_drops_what_is_alone():
    ids = np.array([5, 5, 5, 6, 6, 7])
    rank = np.array([0, 1, 1, 2, 2, 3])
    first = repeats.refine(np.zeros(6, np.int64), ids, rank, False)
    assert first[:3].min() == first[:3].max() >= 0 and first[3:].tolist() == [-1, -1, -1]
    assert (repeats.refine(np.zeros(6, np.int64), ids, rank, True) >= 0).tolist() == [True] * 5 + [False]
    again = repeats.refine(first, np.array([1, 1, 2, 0, 0, 0]), rank, False)
    assert (again >= 0).tolist() == [True, True, False, False, False, False]
    gone, source = repeats.later(again, rank, np.array([9, 0, 0, 0, 0, 0]), False)
    assert gone.tolist() == [False, True, False, False, False, False] and source[1] == 0


def test_least_takes_the_first_of_equal_names():
    from prosemill.llm.rolling import least

    names = np.array([3, 1, 1, 2, 0, 0, 5], np.uint64)
    assert least(names, 3).tolist() == [1, 1, 4, 4, 4, 5, 6]


def test_paths_end_where_the_graph_branches(spark):
    """Two documents go along the whole source, one leaves it in the middle, one enters it late."""
    span = lambda start, end, at: {"start": start, "end": end, "sid": 1, "sord": 0, "at": at}
    rows = [(2, 0, [span(0, 60, 0)]), (3, 0, [span(5, 65, 0)]), (4, 0, [span(0, 30, 0)]), (5, 0, [span(7, 47, 20), span(90, 120, 70)])]
    spans = spark.createDataFrame(rows, debruijn._SPANS_SQL)
    got = sorted((r.start, r.n_words, r.n_walks) for r in debruijn.compacted(spans).collect())
    assert got == [(0, 30, 3), (11, 28, 2), (20, 40, 3), (70, 30, 1)]


def test_paths_of_documents(docs, texts):
    paths = debruijn.repeated_paths(docs).collect()
    words = {i: (t or "").split() for i, t in texts}
    counts = {}
    for own in words.values():
        for k in range(len(own) - 19):
            key = tuple(own[k : k + 20])
            counts[key] = counts.get(key, 0) + 1
    assert paths
    for r in paths:
        own = words[r.doc_id][r.start : r.start + r.n_words]
        assert len(own) == r.n_words >= 20
        assert all(counts[tuple(own[k : k + 20])] > 1 for k in range(len(own) - 19))
