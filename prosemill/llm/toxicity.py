"""Toxicity through noisy-channel deobfuscation.

A disguised word is a path through a lattice: a sign may stand for a letter or for nothing, a run of one letter for one
or two, and a gap in a row of single letters for nothing or for the end of a word.  A Viterbi search finds the likeliest
path under a trigram model of the corpus's characters.  A regularised logistic model over words and word beginnings then
scores the text together with what was restored.

The character model is counted over all documents; the classifier is fitted on at most ``max_rows`` labelled documents.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import _Memo
from .common import batches, own_columns, slices, text_bytes

#: What a sign may stand for.
SIGNS = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "*": "aeiou"}
#: Costs in nats of reading a sign as a letter, of dropping one, of halving a run of letters, and of ending a word in a gap.
AS_LETTER, DROPPED, SHORTENED, PARTED = 0.3, 6.0, 0.1, 1.0
#: Where a feature's likelihood ratio against chance counts: one in a thousand passes by chance (chi-square, one degree).
SIGNIFICANT = 10.83
#: How much worse it is to miss a toxic text than to suspect a clean one.
MISSED = 2.0
LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(chr(c) for c in range(0xDF, 0x100) if c != 0xF7)
CLASSES = len(LETTERS) + 2
_EDGE, _OTHER = 0, CLASSES - 1
_CLASS = {c: k + 1 for k, c in enumerate(LETTERS)}
_LOOKUP = np.zeros(0x250, np.int32)
for _c, _k in _CLASS.items():
    _LOOKUP[ord(_c)] = _k
_GAP = re.compile(r"[ .\-_*~/]{1,3}")
_SPREAD = re.compile(r"(?<!\S)(?:(?:[^\W_]{1,2}|[@$!|+])(?: {1,3}|[.\-_*~/]{1,2})){2,}[^\W_]{1,2}(?=[.,;:!?]*(?!\S))")
_RUN = re.compile(r"(.)\1\1")
_TAIL = re.compile(r"([#$%&*!.,?+])\1{2,}$")
_STRIP = ".,;:!?\"'()[]{}<>«»„“”…#%&"
#: Lengths of word beginnings that are features beside the whole word.
PREFIXES = range(3, 7)
HELD_OUT_OF = 5
_COUNTS = pa.schema([("gram", pa.int64()), ("n", pa.int64())])
_FEATURES = pa.schema([("feature", pa.string()), ("toxic", pa.int64()), ("n", pa.int64())])
_VECTORS = pa.schema([("hits", pa.list_(pa.int32())), ("toxic", pa.int32())])
_SCORED = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def _classes(text: str) -> np.ndarray:
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4")
    return np.where(codes < len(_LOOKUP), _LOOKUP[np.minimum(codes, len(_LOOKUP) - 1)], np.where(codes < 0x2000, _OTHER, _EDGE))


def _gram_counts(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(CLASSES**3, np.int64)
    for batch in slices(it):
        texts = [(t or b"").decode("utf-8", "replace") for t in text_bytes(batch.column(0))]
        at = 0
        while at < len(texts):
            to, size = at, 0
            while to < len(texts) and (size < 1 << 19 or to == at):
                size += len(texts[to])
                to += 1
            c = _classes("  " + "  ".join(texts[at:to]) + "  ").astype(np.int64)
            total += np.bincount((c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:], minlength=len(total))
            at = to
    seen = np.flatnonzero(total)
    yield batches({"gram": seen, "n": total[seen]}, _COUNTS)


def character_model(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Costs in nats of a character after the two before it, counted over every whole text of ``docs``.

    What reaches the driver is a table over a fixed alphabet, whatever the number of documents.
    """
    counts = own_columns(docs, text=text_col).mapInArrow(_gram_counts, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    table = np.zeros(CLASSES**3)
    for gram, n in counts.collect():
        table[gram] = n
    three = table.reshape(CLASSES, CLASSES, CLASSES)
    two, one = three.sum(0), three.sum((0, 1))
    unigram = (one + 1) / (one.sum() + CLASSES)
    bigram = (two + 20 * unigram) / (two.sum(1, keepdims=True) + 20)
    return -np.log((three + 20 * bigram) / (three.sum(2, keepdims=True) + 20)).astype(np.float32)


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """Per run of equal characters, the readings and their costs."""
    out = []
    for m in re.finditer(r"(.)\1*", token, re.S):
        c, n = m[1], len(m[0])
        if c in _CLASS or c.isalpha():
            out.append([(c * n, 0.0)] if n < 3 else [(c, SHORTENED), (c * 2, SHORTENED)])
        else:
            options = [("", DROPPED * n if c in SIGNS else 0.1)]
            options += [(x * k, AS_LETTER * n) for x in SIGNS.get(c, "") for k in {1, min(n, 2)}]
            out.append(options)
    return out


def restore(token: str, costs: np.ndarray) -> str:
    """The likeliest reading of a disguised token."""
    return likeliest(lattice(token), costs)


def likeliest(steps: list[list[tuple[str, float]]], costs: np.ndarray) -> str:
    """The path through a lattice that costs least, by Viterbi search over the last two characters."""
    states: dict[tuple[int, int], tuple[float, str]] = {(_EDGE, _EDGE): (0.0, "")}
    for options in steps:
        nxt: dict[tuple[int, int], tuple[float, str]] = {}
        for (a, b), (cost, text) in states.items():
            for reading, extra in options:
                p, q, c = a, b, cost + extra
                for ch in reading:
                    k = _EDGE if ch == " " else _CLASS.get(ch, _OTHER)
                    c += float(costs[p, q, k])
                    p, q = q, k
                old = nxt.get((p, q))
                if old is None or (c, text + reading) < old:
                    nxt[p, q] = (c, text + reading)
        states = nxt
    return min((cost + float(costs[a, b, _EDGE]), text) for (a, b), (cost, text) in states.items())[1]


def readings(token: str, costs: np.ndarray) -> list[str]:
    """A lower-case token without its outer punctuation, and its restored form if it may be disguised."""
    token = _TAIL.sub("", token)
    plain = token.strip(_STRIP)
    out = [plain] if plain else []
    core = token.strip(_STRIP.replace("!", "").replace("(", ""))
    if (not plain.isalpha() or core != plain or _RUN.search(core)) and any(c.isalpha() for c in core):
        for form in {core, plain}:
            if not form.isalpha() or _RUN.search(form):
                out.append(restore(form, costs))
                out += [part for part in re.split(r"[^\w]+", form) if part.isalpha()]
    return list(dict.fromkeys(out))


def spread_words(text: str, costs: np.ndarray) -> list[str]:
    """Words whose letters stand alone or in pairs, restored; a gap between them joins or parts, as is likelier."""
    out = []
    for m in _SPREAD.finditer(text):
        chunks, gaps = _GAP.split(m[0]), _GAP.findall(m[0])
        if sum(len(c) == 1 for c in chunks) < 3 or sum(c.isalpha() for c in m[0]) < 2:
            continue
        steps = lattice(chunks[0])
        for gap, chunk in zip(gaps, chunks[1:], strict=True):
            steps.append([("", 0.0), (" ", PARTED if len(gap) == 1 else 0.0)])
            steps += lattice(chunk)
        out += likeliest(steps, costs).split()
    return out


def features(readings_: Iterable[str]) -> Iterator[str]:
    for word in readings_:
        yield word + "$"
        for n in PREFIXES:
            if len(word) > n:
                yield word[:n]


def _feature_map(costs) -> Callable:
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Memo(lambda token: tuple(features(readings(token, costs.value))), 30_000)
        for batch in slices(it):
            seen: dict[str, list[int]] = {}
            for text, toxic in zip(text_bytes(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                low = (text or b"").decode("utf-8", "replace").lower()
                own = set(chain.from_iterable(map(memo.__getitem__, set(low.split())))) | set(features(spread_words(low, costs.value)))
                for f in own:
                    n = seen.setdefault(f, [0, 0])
                    n[0] += toxic
                    n[1] += 1
            yield batches({"feature": list(seen), "toxic": [x[0] for x in seen.values()], "n": [x[1] for x in seen.values()]}, _FEATURES)

    return run


class Scorer:
    """Weights over features and the character model; scores whole texts."""

    def __init__(self, costs: np.ndarray, lexicon: list[str], weights: np.ndarray | None = None):
        self.costs, self.number = costs, {f: k for k, f in enumerate(lexicon)}
        self.weights = np.zeros(len(lexicon) + 1) if weights is None else weights

    def start(self) -> None:
        """Once per task, after the scorer arrived there."""
        number = self.number
        self.memo = _Memo(lambda token: tuple({number[f] for f in features(readings(token, self.costs)) if f in number}))

    def stop(self) -> None:
        """Give the memo back; a worker keeps its scorer for later tasks."""
        del self.memo

    def hits(self, text: bytes | None) -> list[int]:
        low = (text or b"").decode("utf-8", "replace").lower()
        found = set(chain.from_iterable(map(self.memo.__getitem__, set(low.split()))))
        found |= {self.number[f] for f in features(spread_words(low, self.costs)) if f in self.number}
        return sorted(found)

    def score(self, text: bytes | None) -> float:
        z = float(self.weights[-1] + self.weights[self.hits(text)].sum())
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _fit(hits: list[list[int]], labels: np.ndarray, n: int, steps: int = 400, penalty: float = 1e-5) -> np.ndarray:
    """Logistic regression by Adam on presence vectors, held as (row, feature) pairs; the last weight is the bias."""
    row = np.repeat(np.arange(len(hits)), [len(own) for own in hits]) if hits else np.empty(0, np.int64)
    feature = np.fromiter((f for own in hits for f in own), np.int64, len(row))
    rate = np.clip(labels.mean(), 1e-3, 1 - 1e-3) if len(labels) else 0.5
    weight = np.where(labels > 0.5, MISSED, 1.0)
    w = np.zeros(n + 1)
    w[n] = np.log(rate / (1 - rate))
    m, v, g = np.zeros_like(w), np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1 if hits else 1):
        z = np.bincount(row, w[feature], len(hits)) + w[n]
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels) * weight / len(hits)
        g[:n] = np.bincount(feature, error[row], n) + penalty * w[:n]
        g[n] = error.sum()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w


def gain(toxic: Column, n: Column, all_toxic: int, all_n: int) -> Column:
    """Likelihood ratio of a feature that stands in n texts, toxic of them toxic, against one that doesn't care."""

    def term(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(F.lit(0.0))

    cells = []
    for with_feature, size in ((True, n), (False, all_n - n)):
        for is_toxic, total in ((True, all_toxic), (False, all_n - all_toxic)):
            own = toxic if is_toxic else n - toxic
            cells.append(term((own if with_feature else total - own).cast("double"), size * (total / all_n)))
    return 2 * sum(cells[1:], cells[0])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = 20_000) -> Scorer:
    """Fit on at most ``max_rows`` labelled documents whose crc32(id) mod 5 isn't 0, chosen by a hash of their ids.

    Features are all words and word beginnings whose share of toxic texts, higher or lower, is no chance (``SIGNIFICANT``),
    however many or rare they are.  Rows with a null id or label teach nothing; of several labels of an id the largest
    counts.  Without any toxic or clean row the score is a constant.
    """
    spark = docs.sparkSession
    costs = character_model(docs, text_col)
    shared = spark.sparkContext.broadcast(costs)
    picked = (
        own_columns(labels, doc_id=id_col, toxic=label_col)
        .where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % HELD_OUT_OF != 0))
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_rows)
    )
    rows = own_columns(docs, doc_id=id_col, text=text_col).join(F.broadcast(picked), "doc_id").select("text", "toxic")
    counted = rows.mapInArrow(_feature_map(shared), "feature string, toxic long, n long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("n").alias("n"))
    n, toxic = (int(x or 0) for x in rows.agg(F.count(F.lit(1)), F.sum("toxic")).first())
    scorer = Scorer(costs, [])
    if not 0 < toxic < n:
        scorer.weights = _fit([], np.array([toxic / n if n else 0.0]), 0)
        return scorer
    telling = counted.where(gain(F.col("toxic"), F.col("n"), toxic, n) >= SIGNIFICANT).select("feature").orderBy("feature")
    scorer = Scorer(costs, [r.feature for r in telling.collect()])

    def vectors(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer.start()
        for batch in slices(it):
            yield batches({"hits": [scorer.hits(t) for t in text_bytes(batch.column(0))], "toxic": batch.column(1)}, _VECTORS)

    fitted = rows.mapInArrow(vectors, "hits array<int>, toxic int").collect()
    scorer.weights = _fit([r.hits for r in fitted], np.array([r.toxic for r in fitted], np.float64), len(scorer.number))
    return scorer


def score(docs: DataFrame, scorer: Scorer, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every whole text.

    A null or empty text has the score of a text without any listed word.  Every row is scored by itself: repeated rows
    and ids and further columns don't matter; a null id counts as not held out; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(scorer)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        own.start()
        for batch in slices(it):
            yield batches({"doc_id": batch.column(0), "score": [own.score(t) for t in text_bytes(batch.column(1))]}, _SCORED)
        own.stop()

    out = own_columns(docs, doc_id=id_col, text=text_col).mapInArrow(run, "doc_id long, score double")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % HELD_OUT_OF == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
