"""Documents from files, by suffix: text, Markdown, HTML, DOCX, and PDF where a reader is installed."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import markdown, segment

try:
    from pypdf import PdfReader
except ImportError:
    PdfReader = None

# Suffixes by format, and the HTML elements that are skipped or end a line.
FORMATS = {"text": ["txt", "text"], "markdown": ["md", "markdown"], "html": ["html", "htm"], "docx": ["docx"], "pdf": ["pdf"]}
REVIEWABLE = ["txt", "md", "markdown"]
_SKIP = {"script", "style", "noscript", "iframe", "svg", "head"}
_LINE = {"p", "br", "div", "li", "h1", "h2", "h3", "h4", "h5", "h6", "tr"}
_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_OUT = pa.schema([("path", pa.string()), ("format", pa.string()), ("text", pa.string()), ("error", pa.string())])


def supported(spark: SparkSession) -> DataFrame:
    """(suffix, format, reviewable): 9 rows."""
    rows = [(s, f, s in REVIEWABLE) for f, suffixes in FORMATS.items() for s in suffixes]
    return spark.createDataFrame(rows, "suffix string, format string, reviewable boolean")


def format_of(path: Column) -> Column:
    """The format of a path's suffix; an unknown suffix is read as text."""
    suffix = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    out = F.lit("text")
    for name, suffixes in FORMATS.items():
        out = F.when(suffix.isin(suffixes), name).otherwise(out)
    return out


def is_reviewable(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)).isin(REVIEWABLE)


_BLOCKS = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("level", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("text", pa.string())]))


def parse_source(docs: DataFrame) -> DataFrame:
    """(doc_id, position, kind, level, start, end, text) of documents (doc_id, format, text).

    Markdown has its blocks; any other text has paragraphs between blank lines, their lines joined by a space.
    """

    def one(kind: str | None, text: str) -> list[dict]:
        if kind == "markdown":
            return markdown.blocks(text)
        return [{"position": k, "kind": "paragraph", "level": None, "start": a, "end": b, "text": " ".join(text[a:b].split())} for k, (a, b) in enumerate(segment.paragraph_ranges(text))]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            found = [one(f, t or "") for f, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, _BLOCKS)], names=["doc_id", "x"])

    rows = docs.select(F.col("doc_id").cast("long"), "format", "text")
    return rows.mapInArrow(run, "doc_id long, x array<struct<position:int,kind:string,level:int,start:int,end:int,text:string>>").select("doc_id", F.inline("x"))


def decode(data: bytes) -> str:
    """UTF-8 with or without a mark, else Latin-1, which reads anything."""
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return data.decode("latin-1")


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.skipped = 0

    def handle_starttag(self, tag, attrs):
        self.skipped += tag in _SKIP

    def handle_endtag(self, tag):
        self.skipped = max(0, self.skipped - (tag in _SKIP))
        if tag in _LINE:
            self.out.append("\n")

    def handle_data(self, data):
        if not self.skipped:
            self.out.append(data)


def html_text(html: str) -> str:
    """Text of a page: a new line after blocks, never more than one blank line."""
    parser = _Text()
    parser.feed(html)
    parser.close()
    return re.sub(r"\n{3,}", "\n\n", "".join(parser.out)).strip()


def docx_text(data: bytes) -> str:
    """Non-empty paragraphs with a blank line between them."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    texts = ("".join(t.text or "" for t in p.iter(_WORD + "t")) for p in root.iter(_WORD + "p"))
    return "\n\n".join(t for t in texts if t.strip())


def pdf_text(data: bytes) -> str:
    if PdfReader is None:
        raise RuntimeError("no PDF reader is installed")
    return "\n\n".join(t for page in PdfReader(io.BytesIO(data)).pages if (t := page.extract_text() or "").strip())


_READ = {"html": lambda d: html_text(decode(d)), "docx": docx_text, "pdf": pdf_text}


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, format, text, error) of all files under a path; a file that can't be read has an error and no text."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            texts, errors = [], []
            for kind, data in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                try:
                    texts.append(_READ.get(kind, decode)(data))
                    errors.append(None)
                except Exception as e:  # a broken file is a row with its reason, not a failed job
                    texts.append(None)
                    errors.append(f"{type(e).__name__}: {e}"[:200])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(errors, pa.string())], schema=_OUT)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", format_of(F.col("path")).alias("format"), "content").mapInArrow(run, "path string, format string, text string, error string")


def pages_text(pages: DataFrame) -> DataFrame:
    """(page_id, text) of the pages table by the plain HTML reader."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([html_text(h or "") for h in batch.column(1).to_pylist()])], names=["page_id", "text"])

    return pages.select(F.col("page_id").cast("long"), "html").mapInArrow(run, "page_id long, text string")


def native_pages_text(pages: DataFrame) -> DataFrame:
    """The same for well-formed pages without leaving the JVM: patterns in place of a parser; references stay encoded."""
    skip = "(?is)" + "|".join(f"<{t}\\b[^>]*>.*?</{t}\\s*>" for t in sorted(_SKIP))
    text = F.regexp_replace(F.coalesce("html", F.lit("")), skip, "")
    text = F.regexp_replace(text, r"(?s)<!--.*?-->", "")
    text = F.regexp_replace(text, r"(?i)</(?:" + "|".join(sorted(_LINE)) + r")\s*>", "\n")
    text = F.regexp_replace(F.regexp_replace(text, r"<[^>]*>", ""), r"\n{3,}", "\n\n")
    return pages.select("page_id", F.trim(text, F.lit(" \t\n\r")).alias("text"))
