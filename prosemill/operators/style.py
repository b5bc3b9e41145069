"""Style metrics, the thirteen diagnostics, and their interpretation under profiles.

Metrics are SQL functions over arrays within a row.  Diagnostics are one Arrow pass over a document, see ``observe``.
Documents are rows (doc_id, text); blocks are rows (doc_id, position, kind, level, text).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import segment
from ..functions import text as T
from ..functions import vocabulary as V
from . import observe

SHORT, LONG = 8, 30
CONTRACTION = T.any_of(V.CONTRACTIONS)


def _among(items: list[str]) -> Callable[[Column], Column]:
    return lambda x: x.isin(items)


def _like(pattern: str) -> Callable[[Column], Column]:
    return lambda x: x.rlike("(?i)" + pattern)


def per_thousand(count: Column, words: Column) -> Column:
    return F.when(words > 0, count * 1000.0 / words).otherwise(F.lit(0.0))


def document_metrics(docs: DataFrame) -> DataFrame:
    """One row per document with its sentence, punctuation, lexical and question metrics, six decimals."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), T.style_words(text).alias("w"), T.simple_sentences(text).alias("s"))
    rows = rows.withColumn("lengths", F.transform("s", lambda s: F.size(T.style_words(s)))).withColumn("content", T.without(F.col("w"), V.STOP_WORDS))
    rows = rows.withColumn("sp", T.spread(F.col("lengths"))).withColumn("n", F.size("w").cast("long")).withColumn("ns", F.size("s").cast("long"))
    some = F.col("ns") > 0
    share = lambda keep: F.when(some, T.round6(F.size(F.filter("lengths", keep)) / F.col("ns").cast("double")))
    sp = lambda k: F.when(some, T.round6(F.col("sp")[k]))
    questions = F.size(F.filter("s", lambda s: F.endswith(s, F.lit("?")))).cast("long")
    out = [
        F.col("n").alias("word_count"),
        F.col("ns").alias("sentence_count"),
        sp("mean").alias("sentence_words_mean"),
        sp("median").alias("sentence_words_median"),
        F.col("sp")["low"].cast("long").alias("sentence_words_min"),
        F.col("sp")["high"].cast("long").alias("sentence_words_max"),
        sp("deviation").alias("sentence_words_stddev"),
        sp("variation").alias("sentence_words_variation"),
        share(lambda n: n <= SHORT).alias("short_sentence_rate"),
        share(lambda n: n >= LONG).alias("long_sentence_rate"),
        F.size("content").cast("long").alias("content_word_count"),
        F.size(F.array_distinct("content")).cast("long").alias("distinct_content_words"),
        F.when(F.size("content") > 0, T.round6(F.size(F.array_distinct("content")) / F.size("content").cast("double"))).otherwise(F.lit(0.0)).alias("content_word_diversity"),
        questions.alias("question_count"),
        F.when(some, T.round6(questions * 100.0 / F.col("ns"))).otherwise(F.lit(0.0)).alias("questions_per_100_sentences"),
    ]
    counted = {f"punctuation_{k}": T.occurrences(F.col("text"), c) for k, c in V.PUNCTUATION.items()}
    counted |= {f"pronoun_{k}": F.size(F.filter("w", _among(m))) for k, m in V.PRONOUNS.items()}
    counted["contraction"] = F.size(T.matches(F.col("text"), CONTRACTION))
    for name, n in counted.items():
        out += [n.cast("long").alias(name), T.round6(per_thousand(n, F.col("n"))).alias(f"{name}_per_1000")]
    for name, pattern in V.TEMPLATES.items():
        out.append(F.size(F.filter("s", _like(pattern))).cast("long").alias(f"template_{name.replace('-', '_')}"))
    return rows.select("doc_id", *out)


def block_metrics(blocks: DataFrame) -> DataFrame:
    """One row per document with paragraph and structure metrics; one aggregation over (doc_id, kind, words)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    b = blocks.select("doc_id", "kind", "level", F.size(T.style_words(text)).cast("long").alias("w"), F.size(T.simple_sentences(text)).cast("long").alias("s"))
    is_ = lambda kind: F.col("kind") == kind
    count = lambda cond: F.count_if(cond)
    g = b.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("block_count"),
        count(is_("paragraph")).alias("paragraph_count"),
        count(is_("heading")).alias("heading_count"),
        count(is_("list_item")).alias("list_item_count"),
        count(is_("code")).alias("code_block_count"),
        count(is_("table")).alias("table_count"),
        F.array_sort(F.collect_list(F.when(is_("paragraph"), F.col("w")))).alias("pw"),
        F.collect_list(F.when(is_("paragraph"), F.col("s"))).alias("ps"),
        F.sum("w").alias("words"),
        F.coalesce(F.sum(F.when(is_("list_item"), F.col("w"))), F.lit(0)).alias("list_words"),
        *[count(is_("heading") & (F.col("level") == k)).alias(f"heading_level_{k}") for k in range(1, 7)],
    )
    g = g.withColumn("pws", T.spread(F.col("pw"))).withColumn("pss", T.spread(F.col("ps")))
    some = F.col("paragraph_count") > 0
    words = F.col("words") > 0
    return g.select(
        "doc_id", "block_count", "paragraph_count", "heading_count", "list_item_count", "code_block_count", "table_count",
        *[F.when(some, T.round6(F.col(s)[k])).alias(f"paragraph_{n}_{v}") for s, n in (("pws", "words"), ("pss", "sentences")) for k, v in (("mean", "mean"), ("median", "median"), ("deviation", "stddev"), ("variation", "variation"))],
        F.when(words, T.round6(F.col("words") / F.greatest(F.col("heading_count"), F.lit(1)).cast("double"))).alias("words_per_heading"),
        F.when(words, T.round6(F.col("list_words") / F.col("words").cast("double"))).alias("list_word_share"),
        T.round6(F.col("list_item_count") / F.col("block_count").cast("double")).alias("list_block_share"),
        F.when(F.col("list_item_count") > 0, T.round6(F.col("list_words") / F.col("list_item_count").cast("double"))).alias("list_item_words_mean"),
        *[f"heading_level_{k}" for k in range(1, 7)],
    )


_FINDINGS = pa.list_(pa.struct([("diagnostic", pa.string()), ("value", pa.float64()), ("sample", pa.int64()), ("label", pa.string()), ("evidence", pa.list_(pa.struct([("place", pa.int32()), ("excerpt", pa.string())])))]))
_FINDINGS_SQL = "array<struct<diagnostic:string,value:double,sample:bigint,label:string,evidence:array<struct<place:int,excerpt:string>>>>"


def _observed(rows: DataFrame, column: str, one: Callable[[object], list[dict]]) -> DataFrame:
    """(doc_id, diagnostic, value, sample, label, evidence) of what ``one`` finds in a column; one pass, no shuffle."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([one(x) for x in batch.column(1).to_pylist()], _FINDINGS)], names=["doc_id", "f"])

    narrow = rows.select("doc_id", column)
    return narrow.mapInArrow(run, StructType([narrow.schema["doc_id"], *StructType.fromDDL(f"f {_FINDINGS_SQL}").fields])).select("doc_id", F.inline("f"))


def sentence_findings(docs: DataFrame, split: Callable[[str], list[str]] = observe.simple_split) -> DataFrame:
    """The diagnostics that need only text and sentences, with evidence; ``split`` may be the full splitter."""
    return _observed(docs, "text", lambda text: observe.of_sentences(text or "", split))


def sentence_diagnostics(docs: DataFrame) -> DataFrame:
    """``sentence_findings`` on simple sentences, without evidence."""
    return sentence_findings(docs).drop("evidence")


def block_findings(blocks: DataFrame) -> DataFrame:
    """The diagnostics that need paragraphs and other blocks, with evidence; a document's blocks meet in one row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = blocks.groupBy("doc_id").agg(F.collect_list(F.struct(F.col("position").cast("long").alias("position"), "kind", text.alias("text"))).alias("b"))
    return _observed(rows, "b", lambda b: observe.of_blocks([(x["position"], x["kind"], x["text"]) for x in b]))


def block_diagnostics(blocks: DataFrame) -> DataFrame:
    """``block_findings`` without evidence."""
    return block_findings(blocks).drop("evidence")


def available_samples(docs: DataFrame) -> DataFrame:
    """(doc_id, diagnostic, sample): how much there is for each diagnostic to measure, the silent ones too.

    Paragraphs are the blocks between blank lines.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rows = []
            for text in batch.column(1).to_pylist():
                text = text or ""
                blocks = [(k, "paragraph", text[a:b]) for k, (a, b) in enumerate(segment.paragraph_ranges(text))]
                rows.append([{"diagnostic": d, "sample": n} for d, n in observe.samples(text, blocks).items()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.struct([("diagnostic", pa.string()), ("sample", pa.int64())])))], names=["doc_id", "f"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, f array<struct<diagnostic:string,sample:bigint>>").select("doc_id", F.inline("f"))


def band_map(findings: DataFrame) -> DataFrame:
    """(doc_id, profile, diagnostic, band) for every diagnostic: not-assessed, none, notice or strong.

    ``findings`` is the result of ``interpret``; a diagnostic that found nothing is in band none.
    """
    names = findings.sparkSession.createDataFrame([(d,) for d in V.DIAGNOSTICS], "diagnostic string")
    every = findings.select("doc_id", "profile").distinct().join(F.broadcast(names))
    own = findings.select("doc_id", "profile", "diagnostic", F.when(F.col("severity") == "insufficient_sample", "not-assessed").otherwise(F.col("severity")).alias("band"))
    return every.join(own, ["doc_id", "profile", "diagnostic"], "left").withColumn("band", F.coalesce("band", F.lit("none")))


def structure(blocks: DataFrame) -> DataFrame:
    """(doc_id, position, kind, label, text) of blocks: line breaks as spaces, quotes and list items labelled."""
    label = F.when(F.col("kind") == "quote", "quote").when(F.col("kind") == "list_item", "item").otherwise("")
    return blocks.select("doc_id", "position", "kind", label.alias("label"), F.regexp_replace(F.coalesce("text", F.lit("")), r"[ \t]*\r?\n[ \t]*", " ").alias("text"))


def rules_table(spark: SparkSession) -> DataFrame:
    """(profile, diagnostic, least, notice, strong, inverted) for the baseline and every profile: 78 rows, fixed."""
    rows = []
    for profile in ["baseline", *V.PROFILES]:
        for name, (least, notice, strong, inverted) in V.DIAGNOSTICS.items():
            own = V.PROFILES.get(profile, {}).get(name, (None, None, None))
            rows.append((profile, name, own[0] or least, float(own[1] or notice), float(own[2] or strong), inverted))
    return spark.createDataFrame(rows, "profile string, diagnostic string, least long, notice double, strong double, inverted boolean")


def severity(value: Column, notice: Column, strong: Column, inverted: Column) -> Column:
    """none, notice or strong; an inverted diagnostic is worse the lower it is."""
    reached = lambda limit: F.when(inverted, value <= limit).otherwise(value >= limit)
    return F.when(reached(strong), "strong").when(reached(notice), "notice").otherwise("none")


def interpret(observations: DataFrame, rules: DataFrame) -> DataFrame:
    """Every observation under every profile of ``rules``, which is a small fixed table: measure once, read many."""
    joined = observations.join(F.broadcast(rules), "diagnostic")
    level = F.when(F.col("sample") < F.col("least"), "insufficient_sample").otherwise(severity(F.col("value"), F.col("notice"), F.col("strong"), F.col("inverted")))
    return joined.select("doc_id", "profile", "diagnostic", "value", "sample", level.alias("severity"))


def coverage(documents: DataFrame, findings: DataFrame, rules: DataFrame) -> DataFrame:
    """assessed, insufficient_sample or silent for every document, profile and diagnostic."""
    every = documents.select("doc_id").distinct().join(F.broadcast(rules.select("profile", "diagnostic")))
    known = findings.select("doc_id", "profile", "diagnostic", F.when(F.col("severity") == "insufficient_sample", "insufficient_sample").otherwise("assessed").alias("status"))
    return every.join(known, ["doc_id", "profile", "diagnostic"], "left").withColumn("status", F.coalesce("status", F.lit("silent")))


def targets_table(spark: SparkSession) -> DataFrame:
    rows = [(p, m, float(lo), float(hi)) for p, ms in V.TARGETS.items() for m, (lo, hi) in ms.items()]
    return spark.createDataFrame(rows, "profile string, metric string, low double, high double")


def against_targets(metrics: DataFrame, targets: DataFrame, names: list[str]) -> DataFrame:
    """within, above or below for every known metric that a profile has a range for."""
    long = metrics.select("doc_id", F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])).alias("m")).select("doc_id", "m.metric", "m.value").where("value is not null")
    place = F.when(F.col("value") < F.col("low"), "below").when(F.col("value") > F.col("high"), "above").otherwise("within")
    return long.join(F.broadcast(targets), "metric").select("doc_id", "profile", "metric", "value", place.alias("place"))
