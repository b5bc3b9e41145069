"""All registered queries of the engine's own operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import markdown, segment
from ..functions import text as T
from ..functions import vocabulary as V
from ..operators import barriers as B
from ..operators import edits as E
from ..operators import facts as X
from ..operators import lexicon as L
from ..operators import present as P
from ..operators import readability as R
from ..operators import rules as RU
from ..operators import style as S
from ..operators import verify as VF
from ..sources import readers, reports
from ..sources.tables import load as table
from ..streaming import documents
from . import edit_oracles, oracles, present_oracles, source_oracles, style_oracles, templates

Query = Callable[[SparkSession, str], DataFrame]


def readability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.readability(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def readability_by_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = R.readability(table(spark, sf_dir, "documents").select("lang", "text"))
    micro = F.floor(F.col("consensus") * 1e6 + 0.5)
    mean = T.round6(F.sum(micro).cast("double") / 1e6 / F.count("consensus"))
    return scored.groupBy("lang", "band").agg(F.count(F.lit(1)).alias("documents"), F.sum("words").alias("words"), F.sum("sentences").alias("sentences"), mean.alias("mean_grade"))


def word_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    styled = T.style_words(F.col("text"))
    return docs.select(
        "doc_id",
        F.size(T.words(F.col("text"))).cast("long").alias("n_words"),
        F.size(styled).cast("long").alias("n_style_words"),
        F.size(F.array_distinct(styled)).cast("long").alias("n_distinct"),
        F.size(T.simple_sentences(F.col("text"))).cast("long").alias("n_sentences"),
        T.sha256(F.col("text")).alias("text_sha256"),
        T.excerpt(F.col("text")).alias("excerpt"),
        T.line_number(F.col("text"), F.lit(100)).cast("long").alias("line_of_100"),
    )


def syllables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words are counted before their shapes are looked at, so each word is judged once."""
    found = table(spark, sf_dir, "documents").select(F.explode(T.words(F.col("text"))).alias("word"))
    return found.groupBy("word").agg(F.count(F.lit(1)).alias("n")).withColumn("syllables", T.syllables(F.col("word")).cast("long"))


def conversation_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as documents of blocks: a turn is a paragraph, every seventh a list item, every eleventh a heading."""
    heading = (F.col("turn") % 11 == 0) & (F.col("turn") > 0)
    kind = F.when(F.col("turn") % 7 == 6, "list_item").when(heading, "heading").otherwise("paragraph")
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("position"), kind.alias("kind"), F.when(heading, 1 + F.col("turn") % 3).alias("level"), "text")


def style_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.document_metrics(table(spark, sf_dir, "documents"))


def block_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.block_metrics(conversation_blocks(spark, sf_dir))


def sentence_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.sentence_diagnostics(table(spark, sf_dir, "documents"))


def block_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.block_diagnostics(conversation_blocks(spark, sf_dir))


def profile_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.interpret(sentence_diagnostics(spark, sf_dir), S.rules_table(spark))


def profile_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks, rules = conversation_blocks(spark, sf_dir), S.rules_table(spark)
    return S.coverage(blocks, S.interpret(S.block_diagnostics(blocks), rules), rules)


def profile_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.against_targets(style_metrics(spark, sf_dir), S.targets_table(spark), style_oracles.TARGET_METRICS)


def document_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.facts(table(spark, sf_dir, "documents"))


def fact_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.signature(X.facts(templates.template_docs(table(spark, sf_dir, "orders"))))


def fact_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.violations(templates.template_pairs(table(spark, sf_dir, "orders")))


def fact_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.check(templates.template_pairs(table(spark, sf_dir, "orders")))


def rule_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.matches(templates.template_docs(table(spark, sf_dir, "orders"))).groupBy("doc_id", "rule_id").agg(F.count(F.lit(1)).alias("n"))


def conflict_settlement(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.col("l_linenumber") * 6 + F.col("l_partkey") % 5
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), start.alias("start"), (start + 3 + F.col("l_suppkey") % 7).alias("end"), F.concat(F.lit("R"), (F.col("l_partkey") % 6).cast("string")).alias("rule_id"),
        (F.col("l_quantity").cast("long") % 3).alias("priority"), F.concat(F.lit("x"), (F.col("l_suppkey") % 2).cast("string")).alias("replacement"), F.col("l_linenumber").cast("long").alias("n"),
    )
    return E.settle(rows).select("doc_id", "n", "island", "decision")


def guarded_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.guarded(templates.template_docs(table(spark, sf_dir, "orders"))).drop("before")


def revised_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.col("l_linenumber") * 10
    edits = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), start.cast("int").alias("start"), (start + 2 + F.col("l_partkey") % 6).cast("int").alias("end"), F.repeat(F.lit("x"), (F.col("l_suppkey") % 9).cast("int")).alias("replacement"))
    return E.edit_lists(edits).select("doc_id", E.revised_offset(F.col("edits"), F.lit(35)).cast("long").alias("revised"))


def fix_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("doc_id")).agg(F.collect_list("o_orderpriority").alias("hits"))
    return hits.select("doc_id", E.fix_budget(F.col("hits"), F.lit("1-URGENT"), F.lit("5-LOW"), F.lit(0.4)).cast("long").alias("budget"))


def vetoed_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With two rules more, of which the firewall vetoes one and lets the other pass."""
    rules = [*E.AUTOMATIC, E.Rule("test.must", {"must": "should"}), E.Rule("test.weighs", {"weighs": "is"})]
    return E.guarded(templates.template_docs(table(spark, sf_dir, "orders")), rules).drop("before")


def article_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles that change with the sound, words under protection, and phrases that only report."""
    k = F.col("o_orderkey").cast("string")
    text = F.concat(F.lit("An utilised tool, number "), k, F.lit(". A commenced task is an expended sum.\n\nThe material prior to use is chronic, and informed consent comes first."))
    docs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), text.alias("text"))
    rules = [*E.AUTOMATIC, E.Rule("test.material", {"the material": "the stuff"}), E.Rule("test.informed", {"informed": "told"})]
    plans = E.plans(docs, rules)
    return plans.select("doc_id", "after", F.concat_ws(" | ", F.transform("proposals", lambda p: F.concat_ws(":", p["rule_id"], p["surface"], p["replacement"], p["decision"], p["reason"]))).alias("proposals"))


def rule_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return RU.listing(spark, [*E.AUTOMATIC, *E.PROTECTED, *P.STYLE_RULES])


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = templates.template_pairs(table(spark, sf_dir, "orders"))
    return VF.judged(pairs, carry=["edit"]).groupBy("edit", "verdict").agg(F.count(F.lit(1)).alias("n"))


def verdict_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markdown pairs, one kind of change each: capitals, moves, breaks, code, links, quotes, terms."""
    found = VF.verify(templates.case_pairs(table(spark, sf_dir, "orders")), as_markdown=True)
    codes = F.concat_ws(",", F.array_sort(F.array_distinct(F.transform(F.concat("refusals", "unresolved", "equivalences"), lambda e: e["code"]))))
    return found.select("pair_id", "verdict", codes.alias("codes"))


def barrier_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All seven detectors on template texts, with a glossary, terms of art and verbs of nouns."""
    sentences = B.sentence_rows(templates.barrier_docs(table(spark, sf_dir, "orders")))
    glossary = spark.createDataFrame(templates.GLOSSARY, "word string, plain string")
    verbs = spark.createDataFrame(templates.VERBS, "noun string, verb string")
    terms = spark.createDataFrame(list(V.PROTECTED_TERMS.items()), "word string, domain string")
    found = B.deduplicate(B.detect(sentences, glossary, terms, verbs))
    return found.select("doc_id", F.col("sentence").cast("long").alias("sentence"), "type", F.lower("match").alias("match"), "severity", B.confidence(F.col("type")).alias("confidence"), B.priority(F.col("type")).alias("priority"))


def available_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.available_samples(table(spark, sf_dir, "documents"))


def band_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.band_map(profile_findings(spark, sf_dir))


def evidence_of_openers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the repeated sentence openers of every document stand, the first ten of each."""
    found = S.sentence_findings(table(spark, sf_dir, "documents")).where("diagnostic = 'REPEATED_SENTENCE_OPENER'")
    return found.select("doc_id", "label", F.inline("evidence"))


def _unique_barriers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.deduplicate(B.detect(B.sentence_rows(table(spark, sf_dir, "documents"))))


def barriers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _unique_barriers(spark, sf_dir).select("doc_id", F.col("sentence").cast("long").alias("sentence"), "type", "match", "severity", "words")


def barrier_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.summary(table(spark, sf_dir, "documents"), _unique_barriers(spark, sf_dir))


def barriers_by_sentence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.by_sentence(_unique_barriers(spark, sf_dir)).withColumn("sentence", F.col("sentence").cast("long"))


def top_improvements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.top_improvements(_unique_barriers(spark, sf_dir)).withColumn("sentence", F.col("sentence").cast("long"))


def _every_barrier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the terms of art that are shipped; glossary and verbs are the caller's tables."""
    terms = spark.createDataFrame(list(V.PROTECTED_TERMS.items()), "word string, domain string")
    none = spark.createDataFrame([], "word string, plain string"), spark.createDataFrame([], "noun string, verb string")
    return B.deduplicate(B.detect(B.sentence_rows(table(spark, sf_dir, "documents")), none[0], terms, none[1]))


def every_barrier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _every_barrier(spark, sf_dir).select("doc_id", F.col("sentence").cast("long").alias("sentence"), "type", "match", "severity", "words")


def every_barrier_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.summary(table(spark, sf_dir, "documents"), _every_barrier(spark, sf_dir))


def every_barrier_by_sentence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.by_sentence(_every_barrier(spark, sf_dir)).withColumn("sentence", F.col("sentence").cast("long"))


def every_improvement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.top_improvements(_every_barrier(spark, sf_dir)).withColumn("sentence", F.col("sentence").cast("long"))


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.sentences(table(spark, sf_dir, "documents"))


def paragraph_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n\n").alias("text"))
    return segment.paragraphs(turns)


def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.pages_text(table(spark, sf_dir, "pages"))


def page_text_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.native_pages_text(table(spark, sf_dir, "pages"))


def supported_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.supported(spark)


def url_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", readers.format_of(F.col("url")).alias("format"), readers.is_reviewable(F.col("url")).alias("reviewable"))


def json_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.json_reports(R.readability(table(spark, sf_dir, "documents").select("doc_id", "text")))


def canonical_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.canonical_audit(fact_check(spark, sf_dir), "pair_id")


def protected_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of art by word: an exploded count joined with a small fixed table."""
    words = table(spark, sf_dir, "documents").select(F.explode(T.words(F.col("text"))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    terms = spark.createDataFrame(list(V.PROTECTED_TERMS.items()), "word string, domain string")
    return words.join(F.broadcast(terms), "word")


def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The streaming aggregation over the events table as a batch; sums of whole cents, so order doesn't matter."""
    rows = table(spark, sf_dir, "events").withColumn("value", F.floor(F.col("value") * 100 + 0.5).cast("long"))
    return documents.event_counts(rows)


def stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select(F.explode(T.words(F.col("text"))).alias("word")).distinct()
    return words.select("word", L.stem(F.col("word")).alias("stem"))


def change_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.changes(templates.template_docs(table(spark, sf_dir, "orders")))


def connected_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document of several sentences per customer, where one connective may stand out."""
    k = F.col("o_orderkey") % 4
    sentence = F.when(k == 0, "However, it came late.").when(k == 1, "Nevertheless, it was paid in full.").otherwise("Nevertheless, it was sent on time.")
    rows = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", sentence.alias("t")))).alias("s"))
    return rows.select("doc_id", F.array_join(F.transform("s", lambda x: x["t"]), " ").alias("text"))


def style_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = P.style_proposals(connected_docs(spark, sf_dir), "plain").withColumn("budget", F.col("budget").cast("long"))
    return rows.groupBy("doc_id", "budget").agg(F.count(F.lit(1)).alias("proposals"))


def approved_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = connected_docs(spark, sf_dir)
    proposals = P.style_proposals(docs, "plain")
    decided = P.decide(proposals, proposals.select("doc_id", "proposal_id", F.lit(True).alias("approve")))
    return P.apply_approved(docs, proposals, decided)


def style_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.style_guard(templates.template_docs(table(spark, sf_dir, "orders")), "natural")


def present(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.present(table(spark, sf_dir, "documents").select("doc_id", "text"), "government")


def review_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.review_bundle(table(spark, sf_dir, "documents").select("doc_id", "text"), "academic")


def protection_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of letters, apostrophes and hyphens of every text, counted."""
    return table(spark, sf_dir, "documents").select("doc_id", F.size(T.protection_words(F.coalesce("text", F.lit("")))).cast("long").alias("n_words"))


def diagnose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.diagnose(table(spark, sf_dir, "documents").select("doc_id", "text"), "plain")


def placed_barriers(spark: SparkSession, sf_dir: str) -> DataFrame:
    sentences = B.sentence_rows(table(spark, sf_dir, "documents"))
    found = B.place(B.deduplicate(B.detect(sentences)), sentences)
    return found.select("doc_id", F.col("sentence").cast("long").alias("sentence"), "type", "match", "status", "start", "end")


def source_barriers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every barrier stands in its document, and what stands there."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = B.place_in_source(B.deduplicate(B.detect(B.sentence_rows(docs))), docs).where("status = 'placed'")
    at = found.join(docs, "doc_id")
    shown = F.substring(F.col("text"), F.col("start").cast("int") + 1, (F.col("end") - F.col("start")).cast("int"))
    return at.select("doc_id", F.col("sentence").cast("long").alias("sentence"), "type", F.lower("match").alias("match"), F.lower(shown).alias("shown"))


def sealed_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sealed plans applied to documents of which some have changed since, and some plans have."""
    docs = templates.template_docs(table(spark, sf_dir, "orders"))
    kept = E.sealed(E.plans(docs))
    k = F.col("doc_id") % 4
    plans = kept.withColumn("policy_sha256", F.when(k == 1, "other").otherwise(F.col("policy_sha256"))).withColumn("edits", F.when(k == 3, F.transform("edits", lambda e: e.withField("replacement", F.lit("x")))).otherwise(F.col("edits")))
    now = docs.withColumn("text", F.when(k == 2, F.concat("text", F.lit(" More."))).otherwise(F.col("text")))
    return E.apply_sealed(now, plans).select("doc_id", "status", F.length("after").cast("long").alias("n_chars"))


def touched_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    start, begin = F.col("l_linenumber") * 6 + F.col("l_partkey") % 5, F.col("l_linenumber") * 8
    spans = lines.select(F.col("l_orderkey").alias("doc_id"), start.cast("long").alias("start"), (start + 3 + F.col("l_suppkey") % 7).cast("long").alias("end"))
    segments = lines.select(F.col("l_orderkey").alias("doc_id"), begin.cast("long").alias("from"), (begin + 5).cast("long").alias("to"))
    return E.touching(spans, segments)


def parsed_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same texts as Markdown and as plain text, by their blocks."""
    kind = F.when(F.col("doc_id") % 2 == 0, "markdown").otherwise("text")
    found = readers.parse_source(markdown_docs(spark, sf_dir).select("doc_id", kind.alias("format"), "text"))
    return found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("blocks"), F.count_if(F.col("kind") == "paragraph").alias("paragraphs"))


def readability_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = R.readability(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return scored.select("doc_id", F.concat_ws("; ", reports.warnings()).alias("warnings"))


def contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.contract(fact_check(spark, sf_dir), "pair_id", "prosemill.check.1")


def markdown_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Markdown document per order, with a block of every kind."""
    k, fence = F.col("o_orderkey").cast("string"), "```"
    text = F.concat(F.lit("# Order *"), k, F.lit("*\n\nIt is **"), F.col("o_orderstatus"), F.lit("** and [listed](http://x/y).\nSecond line.\n\n- first\n- second "), k, F.lit(f"\n\n> quoted\n> text\n\n{fence}sql\nselect 1\n{fence}\n\na | b\n--|--\n1 | 2\n\n---\n\nUnder\n===\n"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), text.alias("text"))


def markdown_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markdown.document_blocks(markdown_docs(spark, sf_dir)).select("doc_id", "position", "kind", "level", "text")


def markdown_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markdown.projection(markdown.document_blocks(markdown_docs(spark, sf_dir)))


def plain_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents looked up in a small glossary, directly and by stem, terms of art aside."""
    words = table(spark, sf_dir, "documents").select(F.explode(T.words(F.col("text"))).alias("word"))
    raw = spark.createDataFrame([("erth", "earth"), ("there", "here"), ("notice", "see"), ("ation", "act"), ("stone", "rock"), ("heat", "warm")], "word string, plain string")
    glossary = L.effective_glossary(raw, raw.where("word = 'stone'"), spark.createDataFrame([("heat", "warmth")], "word string, plain string"))
    terms = spark.createDataFrame(list(V.PROTECTED_TERMS.items()), "word string, domain string")
    return L.plain_words(words, glossary, terms)


def verdict_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = segment.verdict_tokens(templates.template_docs(table(spark, sf_dir, "orders")))
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("tokens"))


QUERIES: dict[str, Query] = {"readability": readability, "readability_by_band": readability_by_band, "word_measures": word_measures, "syllables": syllables}
QUERIES |= {f.__name__: f for f in (style_metrics, block_metrics, sentence_diagnostics, block_diagnostics, profile_findings, profile_coverage, profile_targets, document_facts, fact_signature, fact_violations, fact_check, rule_matches, conflict_settlement, guarded_edits, vetoed_edits, article_edits, rule_listing, revised_offsets, fix_budgets, verdicts, verdict_cases, barriers, barrier_cases, available_samples, band_map, evidence_of_openers, review_bundle, protection_words,  barrier_summary, barriers_by_sentence, top_improvements, every_barrier, every_barrier_summary, every_barrier_by_sentence, every_improvement, sentences, paragraph_ranges, page_text, page_text_native, supported_formats, url_formats, json_reports, canonical_audit, protected_words, event_windows, stems, change_rows, style_proposals, approved_edits, style_guard, present, diagnose, placed_barriers, source_barriers, sealed_plans, touched_segments, parsed_sources, readability_warnings, contracts, markdown_blocks, markdown_projection, plain_words, verdict_tokens)}


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return oracles.TABLE | style_oracles.TABLE | templates.TABLE | edit_oracles.TABLE | source_oracles.TABLE | present_oracles.TABLE
