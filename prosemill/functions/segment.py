"""Sentence splitting with all its phases, paragraph ranges and tokens with offsets, as Arrow passes."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vocabulary import ABBREVIATIONS, STATE_CODES

_SHORT = "|".join(map(re.escape, sorted({*ABBREVIATIONS, *STATE_CODES}, key=lambda a: (-len(a), a))))
# Spans that hold no sentence's end, in the order in which they are hidden.  The group named dot, or else
# the whole match, is what is hidden; abbreviations come back in lower case.
HIDDEN = [
    ("URL", re.compile(r'(?:https?://|ftp://|www\.)[^\s<>"{}|\\^`\[\]]+', re.I)),
    ("EMAIL", re.compile(r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}")),
    ("DOT", re.compile(r"(\d)(?P<dot>\.)(\d)")),
    ("abbr", re.compile(rf"\b(?:{_SHORT})\.", re.I)),
    ("DOT", re.compile(r"\b[A-Z](?P<dot>\.)(?=\s+[A-Z]\.)")),
    ("DOT", re.compile(r"\b[A-Z](?P<dot>\.)(?=\s+[A-Z][a-z])")),
    ("DOTS", re.compile(r"\.\.\.")),
    ("LIST", re.compile(r"(^|\n)\s*((?:\d+\.)+(?:\d+)?|[a-zA-Z]\.|\([a-zA-Z0-9]+\))\s*", re.M)),
]
# A bullet at a line's start, where a sentence ends, a paragraph's break, and what a token is.
_BULLET = re.compile(r"^[\*\-•‣◦\d+\.]\s")
_BOUNDARY = re.compile(r"(?<=[.!?])\s+(?=[A-Z0-9])")
_BREAK = re.compile(r"\n[ \t\r]*(?:\n[ \t\r]*)+")
_TOKEN = re.compile(r"\n\n|\w+(?:['’]\w+)*|[^\w\s]")
_KEY = re.compile("__(?:" + "|".join(dict.fromkeys(kind for kind, _ in HIDDEN)) + r")_\d+__")


def _alone(line: str) -> bool:
    """Whether a line of a block is a unit of its own: blank, a list's item, a shout, a label, or a title."""
    if not line or _BULLET.match(line) or line.endswith(":"):
        return True
    shout = line.isupper() and len(line.split()) <= 10
    title = line[0].isupper() and line[-1] not in ".!?"
    return shout or title


def _units(text: str) -> Iterator[str]:
    """Stretches of a text that no sentence crosses: single lines that stand alone, and what other lines of a block make."""
    for block in re.split(r"\n\s*\n", text):
        lines = [line.strip() for line in block.strip().split("\n")]
        if len(lines) == 1:
            yield lines[0]
            continue
        for alone, run in groupby(lines, _alone):
            yield from run if alone else [" ".join(run)]


def split(text: str) -> list[str]:
    """Sentences of a text, trimmed; a text without a split is one sentence, a blank one has none.

    A stand-in starts with an underscore, so no sentence starts at a hidden span; that is part of the measure.
    """
    if not text or not text.strip():
        return []
    kept: dict[str, str] = {}
    hidden = text
    for kind, pattern in HIDDEN:

        def hide(m: re.Match, kind: str = kind) -> str:
            part = "dot" if "dot" in m.re.groupindex else 0
            key = f"__{kind}_{len(kept)}__"
            kept[key] = m[part].lower() if kind == "abbr" else m[part]
            a, b = m.start(part) - m.start(), m.end(part) - m.start()
            return m[0][:a] + key + m[0][b:]

        hidden = pattern.sub(hide, hidden)

    def shown(part: str) -> str:
        """Hidden spans may hold others, always earlier ones."""
        return _KEY.sub(lambda m: shown(kept[m[0]]) if m[0] in kept else m[0], part)

    parts = (shown(p).strip() for unit in _units(hidden) for p in _BOUNDARY.split(unit.strip()))
    return [p for p in parts if p] or [text.strip()]


def paragraph_ranges(text: str) -> list[tuple[int, int]]:
    """Code point ranges of blocks between blank lines, without their outer white space."""
    out, at = [], 0
    for begin, end in [*((m.start(), m.end()) for m in _BREAK.finditer(text)), (len(text), len(text))]:
        chunk = text[at:begin]
        if chunk.strip():
            out.append((at + len(chunk) - len(chunk.lstrip()), begin - len(chunk) + len(chunk.rstrip())))
        at = end
    return out


def _mapped(docs: DataFrame, ddl: str, one, kind: pa.DataType) -> DataFrame:
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([one(t or "") for t in batch.column(1).to_pylist()], kind)], names=["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, f"doc_id long, x {ddl}")


def sentences(docs: DataFrame) -> DataFrame:
    """(doc_id, sentence, text) of every document (doc_id, text)."""
    return _mapped(docs, "array<string>", split, pa.list_(pa.string())).select("doc_id", F.posexplode("x").alias("sentence", "text"))


def paragraphs(docs: DataFrame) -> DataFrame:
    """(doc_id, start, end) of every paragraph."""
    pairs = lambda t: [{"start": a, "end": b} for a, b in paragraph_ranges(t)]
    return _mapped(docs, "array<struct<start:int,end:int>>", pairs, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))).select("doc_id", F.inline("x"))


def verdict_tokens(docs: DataFrame) -> DataFrame:
    """(doc_id, place, token): words with apostrophes, single signs, and paragraph breaks."""
    return _mapped(docs, "array<string>", _TOKEN.findall, pa.list_(pa.string())).select("doc_id", F.posexplode("x").alias("place", "token"))
