"""A line-based block parser for Markdown, and projection of its prose.

Blocks are headings, fences, quotes, list items, tables, rules and paragraphs, with code point ranges of the source.
What the parser doesn't know is a paragraph; code, tables and rules are not prose.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_HEADING = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?[ \t]*#*[ \t]*$")
_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})[ \t]*([^`]*)$")
_ITEM = re.compile(r"( {0,3})(?:[-*+]|(\d{1,9})[.)])[ \t]+(.*)$")
_RULE = re.compile(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
_SETEXT = re.compile(r" {0,3}(=+|-+)[ \t]*$")
_TABLE = re.compile(r"^\s*\|?\s*:?-+:?\s*(?:\|\s*:?-+:?\s*)+\|?\s*$")
_INLINE = [(re.compile(r"`+([^`]*)`+"), ""), (re.compile(r"!\[([^\]]*)\]\([^)]*\)"), r"\1"), (re.compile(r"\[([^\]]*)\]\([^)]*\)"), r"\1"), (re.compile(r"<[^>\s][^>]*>"), ""), (re.compile(r"(\*\*|__|\*|~~)(?=\S)(.+?)(?<=\S)\1"), r"\2")]
PROSE = ("paragraph", "heading", "list_item", "quote")
_TYPE = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("level", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("text", pa.string())]))
_SQL = "array<struct<position:int,kind:string,level:int,start:int,end:int,text:string>>"


def plain(text: str) -> str:
    """Inline marks removed, line breaks as spaces; code spans are left out, links keep their text."""
    for pattern, by in _INLINE:
        text = pattern.sub(by, text)
    return " ".join(text.split())


def blocks(source: str) -> list[dict]:
    """Blocks in order: position, kind, level, start, end, text."""
    out: list[dict] = []
    held: list[tuple[int, str, int]] = []
    held_kind = "paragraph"

    def put(kind: str, start: int, end: int, text: str, level: int | None = None) -> None:
        out.append({"position": len(out), "kind": kind, "level": level, "start": start, "end": end, "text": text})

    def flush() -> None:
        nonlocal held, held_kind
        if held:
            put(held_kind, held[0][0], held[-1][2], plain("\n".join(t for _, t, _ in held)))
        held, held_kind = [], "paragraph"

    at, fence = 0, None
    for line in source.splitlines(keepends=True):
        start, body = at, line.rstrip("\r\n")
        at += len(line)
        stop = start + len(body.rstrip())
        if fence:
            mark, begin, language = fence
            if body.strip().startswith(mark) and not body.strip().strip(mark[0]):
                put("code", begin, start + len(body), language)
                fence = None
            continue
        if m := _FENCE.match(body):
            flush()
            fence = (m[1], start, m[2].strip())
        elif not body.strip():
            flush()
        elif held and held_kind == "paragraph" and (m := _SETEXT.match(body)):
            text = plain(" ".join(t for _, t, _ in held))
            put("heading", held[0][0], start + len(body), text, 1 if m[1][0] == "=" else 2)
            held = []
        elif _RULE.match(body):
            flush()
            put("rule", start, start + len(body), "")
        elif m := _HEADING.match(body):
            flush()
            put("heading", start, start + len(body), plain(m[2] or ""), len(m[1]))
        elif m := _ITEM.match(body):
            flush()
            held_kind, held = "list_item", [(start, m[3], stop)]
        elif body.lstrip().startswith(">"):
            if held_kind != "quote":
                flush()
                held_kind = "quote"
            held.append((start, body.lstrip().lstrip("> "), stop))
        elif held and len(held) == 1 and "|" in held[0][1] and _TABLE.match(body):
            held_kind = "table"
            held.append((start, body, stop))
        elif not held and body.startswith(("    ", "\t")):
            put("code", start, start + len(body), "")
        else:
            held.append((start, body.strip(), stop))
    if fence:
        put("code", fence[1], len(source.rstrip("\r\n")), fence[2])
    flush()
    for b in out:
        if b["kind"] in ("table", "code", "rule"):
            b["text"] = "" if b["kind"] != "code" else b["text"]
    return out


def document_blocks(docs: DataFrame) -> DataFrame:
    """(doc_id, position, kind, level, start, end, text) of Markdown documents (doc_id, text)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([blocks(t or "") for t in batch.column(1).to_pylist()], _TYPE)], names=["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, f"doc_id long, x {_SQL}").select("doc_id", F.inline("x"))


def projection(found: DataFrame) -> DataFrame:
    """(doc_id, text): prose blocks joined by a blank line, the text that analysis reads."""
    prose = found.where(F.col("kind").isin(list(PROSE)) & (F.col("text") != ""))
    return prose.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "text"))), lambda x: x["text"]), "\n\n").alias("text"))


_SPANS = [("code", re.compile(r"(`+)(?!`)(.+?)(?<!`)\1(?!`)", re.S)), ("markup", re.compile(r"<(?:[A-Za-z/!?][^>]*)>")), ("link", re.compile(r"!?\[([^\]]*)\]\(([^)\s]*)[^)]*\)"))]
_SCOPES = {"paragraph": {"prose"}, "heading": {"prose", "heading"}, "list_item": {"prose", "list"}, "quote": {"quote"}, "code": {"code"}, "table": {"table"}, "rule": set()}


def inline(source: str, start: int, end: int) -> list[tuple[str, int, int, str]]:
    """Code spans, markup and links of a stretch of the source: kind, start, end, and a link's destination."""
    out: list[tuple[str, int, int, str]] = []
    for kind, pattern in _SPANS:
        for m in pattern.finditer(source, start, end):
            if not any(a < m.end() and m.start() < b for _, a, b, _ in out):
                out.append((kind, m.start(), m.end(), m[2] if kind == "link" else ""))
    return sorted(out, key=lambda x: x[1])


def scopes(source: str) -> list[tuple[int, int, frozenset]]:
    """Stretches of the source and the scopes that hold there; a link's text is prose too, its destination isn't."""
    out = []
    for b in blocks(source):
        own, at = _SCOPES[b["kind"]], b["start"]
        for kind, s, e, _ in inline(source, b["start"], b["end"]) if "prose" in own or "quote" in own else []:
            out.append((at, s, frozenset(own)))
            middle = source.index("](", s) if kind == "link" else s
            if kind == "link":
                out.append((s, middle, frozenset(own | {"link"})))
            out.append((middle, e, frozenset({"link" if kind == "link" else "code"})))
            at = e
        out.append((at, b["end"], frozenset(own)))
    return [x for x in out if x[0] < x[1]]


def regions(source: str) -> list[tuple[str, tuple, str, int]]:
    """What is never rewritten, in order: kind, what must stay the same of it, its text, its start.

    Code and markup keep every character but line endings; quotes and tables every word and mark, but not their layout;
    links their destination.
    """
    token = re.compile(r"\n\n|\w+(?:['’]\w+)*|[^\w\s]")
    out: list[tuple[str, tuple, str, int]] = []
    for b in blocks(source):
        raw = source[b["start"] : b["end"]].replace("\r\n", "\n").replace("\r", "\n")
        if b["kind"] == "code":
            out.append(("code", ("code", raw.strip("\n")), raw, b["start"]))
        elif b["kind"] == "quote":
            out.append(("quote", ("quote", *token.findall(re.sub(r"(?m)^[ \t]*(?:>[ \t]?)+", "", raw))), raw, b["start"]))
        elif b["kind"] == "table":
            out.append(("table", ("table", *token.findall(re.sub(r"-{3,}", "---", raw))), raw, b["start"]))
        elif b["kind"] != "rule":
            for kind, s, e, href in inline(source, b["start"], b["end"]):
                if kind == "link":
                    out.append(("link destination", ("link", href), href, s))
                else:
                    out.append((kind, (kind, source[s:e]), source[s:e], s))
    return out


def prose(source: str) -> tuple[str, list[tuple[int, int]]]:
    """The text that analysis reads (prose blocks joined by a blank line), and where each block starts in it and in the source."""
    text, starts, at = [], [], 0
    for b in blocks(source):
        if b["kind"] in ("paragraph", "heading", "list_item") and b["text"]:
            starts.append((at, b["start"]))
            text.append(b["text"])
            at += len(b["text"]) + 2
    return "\n\n".join(text), starts
