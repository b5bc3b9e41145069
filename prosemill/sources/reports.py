"""Sinks: report rows as JSON, canonical audit JSON, HTML and console text, and writing without overwriting."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREVIEW = 5000


def json_reports(scored: DataFrame, text: str = "text", barriers: DataFrame | None = None) -> DataFrame:
    """(doc_id, report): scores, the sample's status and warnings, barriers if given, and a preview of the text as JSON."""
    rows = scored.withColumn("__warnings", warnings())
    if barriers is not None:
        found = barriers.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("sentence", "type", "match", "severity"))).alias("__barriers"))
        rows = rows.join(found, "doc_id", "left")
    fields = [F.col(c) for c in scored.columns if c not in ("doc_id", text)]
    sample = F.struct(F.col("sample_status").alias("status"), F.col("__warnings").alias("warnings"))
    listed = [F.col("__barriers").alias("barriers")] if barriers is not None else []
    return rows.select("doc_id", F.to_json(F.struct(F.struct(*fields).alias("scores"), sample.alias("sample"), *listed, F.substring(text, 1, PREVIEW).alias("preview"))).alias("report"))


def warnings() -> Column:
    """What a reader of a scored document should know: grades that were limited, and a text too short to judge."""
    limited = F.transform(F.filter(F.split("clamped", ","), lambda g: g != ""), lambda g: F.concat(g, F.lit(" was limited to the range 0 to 25")))
    short = F.when(F.col("sample_status") == "insufficient_sample", F.array(F.lit("fewer than 100 words or 3 sentences: scores mean little"))).when(F.col("sample_status") == "limited_sample", F.array(F.lit("fewer than 300 words: scores are rough")))
    return F.concat(limited, F.coalesce(short, F.array().cast("array<string>")))


def contract(rows: DataFrame, key: str, schema: str) -> DataFrame:
    """(key, document, sha256): each row as canonical JSON that names its schema."""
    out = canonical_audit(rows.withColumn("schema", F.lit(schema)), key)
    return out.withColumnRenamed("audit", "document")


def canonical(value: object) -> str:
    """JSON with sorted keys, no spaces, no escapes beyond need, and a final newline."""
    return json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":")) + "\n"


def canonical_audit(rows: DataFrame, key: str) -> DataFrame:
    """(key, audit, sha256): each row as canonical JSON, the same on any platform, and its identity."""
    packed = rows.select(F.col(key).cast("long").alias("key"), F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("j"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([canonical(json.loads(j)) for j in batch.column(1).to_pylist()])], names=["key", "audit"])

    return packed.mapInArrow(run, "key long, audit string").select(F.col("key").alias(key), "audit", F.sha2("audit", 256).alias("sha256"))


def console(scored: DataFrame) -> DataFrame:
    """(doc_id, line): one line per document for a terminal."""
    line = F.format_string("%d  %s  grade %s  %d words  %d sentences", "doc_id", F.coalesce("band", F.lit("-")), F.coalesce(F.format_number("consensus", 1), F.lit("-")), "words", "sentences")
    return scored.select("doc_id", line.alias("line"))


def _escaped(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def html_reports(scored: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, html): a table of scores and an escaped preview."""
    cells = [F.concat(F.lit(f"<tr><th>{c}</th><td>"), F.coalesce(_escaped(F.col(c).cast("string")), F.lit("")), F.lit("</td></tr>")) for c in scored.columns if c not in ("doc_id", text)]
    return scored.select("doc_id", F.concat(F.lit("<table>"), *cells, F.lit("</table><pre>"), _escaped(F.coalesce(F.substring(text, 1, PREVIEW), F.lit(""))), F.lit("</pre>")).alias("html"))


def save(rows: DataFrame, path: str) -> None:
    """Write once; an existing path, such as the source, is never overwritten."""
    rows.write.mode("errorifexists").parquet(path)
