"""Texts with known facts, built from orders by the same rule in Spark and in DuckDB.

Amounts come from whole cents, so both engines write the same digits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How a text is edited, by o_orderkey mod 7.
EDITS = ["none", "comparator", "amount", "currency", "negation", "modal", "wording"]


def template_docs(orders: DataFrame) -> DataFrame:
    """(doc_id, text) with one sentence per kind of fact."""
    cents = F.floor(F.col("o_totalprice") * 100 + 0.5).cast("long")
    k = F.col("o_orderkey")
    text = F.concat(
        F.lit("Order "), k.cast("string"), F.lit(" costs $"), F.expr("cast(floor(o_totalprice * 100 + 0.5) as bigint) div 100").cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"),
        F.lit(" and must be paid prior to "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(". The parcel weighs "), (k % 40 + 1).cast("string"), F.lit(" kg and the discount is "), (k % 9 + 1).cast("string"),
        F.lit("%. We do not utilise couriers after 5 days. It is important to note that refunds, due to the fact that prices move, are final and complete."),
    )
    return orders.select(k.alias("doc_id"), text.alias("text"))


def template_pairs(orders: DataFrame) -> DataFrame:
    """(pair_id, before, after, edit)."""
    t, k = F.col("text"), F.col("doc_id") % 7
    after = (
        F.when(k == 1, F.replace(t, F.lit("prior to"), F.lit("before")))
        .when(k == 2, F.replace(t, F.lit("costs $"), F.lit("costs $1")))
        .when(k == 3, F.replace(t, F.lit("costs $"), F.lit("costs £")))
        .when(k == 4, F.replace(t, F.lit("do not utilise"), F.lit("utilise")))
        .when(k == 5, F.replace(t, F.lit("must be paid"), F.lit("may be paid")))
        .when(k == 6, F.replace(t, F.lit("final and complete"), F.lit("quick and open")))
        .otherwise(t)
    )
    edit = F.element_at(F.array(*map(F.lit, EDITS)), (k + 1).cast("int"))
    return template_docs(orders).select(F.col("doc_id").alias("pair_id"), t.alias("before"), after.alias("after"), edit.alias("edit"))


#: Markdown pairs by o_orderkey mod 8: before, after, verdict, codes.  KEY stands for the order's key.
CASES = [
    ("We like Polish food, order KEY.", "We like polish food, order KEY.", "INCONCLUSIVE", "unexplained_change"),
    ("Before 5 May 2020, you must send order KEY.", "You must send order KEY before 5 May 2020.", "ACCEPTED", "permitted_move"),
    ("Before 5 May 2020, you should apply.", "You should apply before 5 May 2020.", "ACCEPTED", "permitted_move"),
    ("Pay $KEY now. Wait 3 days.", "Wait 3 days. Pay $KEY now.", "INCONCLUSIVE", "protected_item_moved"),
    ("Order KEY is here. It can stay.", "Order KEY is here.\n\nIt can stay.", "ACCEPTED", "formatting"),
    ("Run `send KEY` and read on.", "Run `post KEY` and read on.", "REFUSED", "protected_region_changed"),
    ("> He said order KEY\n> is here.\n\nThat was [it](/orders/KEY).", "> He said\n> order KEY is here.\n\nThat was [it](/orders/KEY).", "ACCEPTED", "formatting"),
    ("A chronic delay of order KEY.", "A lasting delay of order KEY.", "REFUSED", "protected_term_changed"),
]
GLOSSARY = [("prior to", "before"), ("in the event that", "if"), ("utilised", "used"), ("covenant", "promise")]
VERBS = [("decision", "decide"), ("payment", "pay")]
BARRIER_TEXT = "We made a decision on order KEY prior to lunch. The implementation of the covenant was utilised. In the event that it ends, they conducted a review at the end result. The payment went well."
#: What the seven detectors find in it: sentence, type, match, severity, confidence, priority.
BARRIERS = [
    (0, "hidden_verb", "made a decision", "info", "uncertain", "consider"), (0, "jargon", "prior to", "info", "medium", "high"),
    (1, "complex_word", "implementation", "warning", "medium", "consider"), (1, "jargon", "covenant", "info", "medium", "high"), (1, "passive_voice", "was utilised", "warning", "medium", "consider"), (1, "complex_word", "utilised", "info", "medium", "consider"),
    (2, "jargon", "in the event that", "warning", "medium", "high"), (2, "hidden_verb", "conducted a review", "info", "uncertain", "consider"), (2, "redundant_pair", "end result", "info", "medium", "info"),
    (2, "complex_word", "conducted", "info", "medium", "consider"), (3, "nominalization", "payment", "info", "medium", "consider"),
]


def _keyed(orders: DataFrame, text: str) -> Column:
    return F.replace(F.lit(text), F.lit("KEY"), F.col("o_orderkey").cast("string"))


def case_pairs(orders: DataFrame) -> DataFrame:
    """(pair_id, before, after) of ``CASES``."""
    pick = lambda side: F.element_at(F.array(*[_keyed(orders, case[side]) for case in CASES]), (F.col("o_orderkey") % len(CASES) + 1).cast("int"))
    return orders.select(F.col("o_orderkey").alias("pair_id"), pick(0).alias("before"), pick(1).alias("after"))


def barrier_docs(orders: DataFrame) -> DataFrame:
    return orders.select(F.col("o_orderkey").alias("doc_id"), _keyed(orders, BARRIER_TEXT).alias("text"))


CENTS = "CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT)"
AMOUNT = f"({CENTS} // 100) || '.' || lpad(CAST({CENTS} % 100 AS VARCHAR), 2, '0')"
DOCS_SQL = f"""
template_docs AS (
  SELECT o_orderkey AS doc_id, 'Order ' || o_orderkey || ' costs $' || {AMOUNT} || ' and must be paid prior to ' || strftime(o_orderdate, '%Y-%m-%d') || '. The parcel weighs ' || (o_orderkey % 40 + 1)
    || ' kg and the discount is ' || (o_orderkey % 9 + 1) || '%. We do not utilise couriers after 5 days. It is important to note that refunds, due to the fact that prices move, are final and complete.' AS text
  FROM orders
)"""
PAIRS_SQL = f"""
{DOCS_SQL}, template_pairs AS (
  SELECT doc_id AS pair_id, text AS before, CASE doc_id % 7 WHEN 1 THEN replace(text, 'prior to', 'before') WHEN 2 THEN replace(text, 'costs $', 'costs $1') WHEN 3 THEN replace(text, 'costs $', 'costs £')
    WHEN 4 THEN replace(text, 'do not utilise', 'utilise') WHEN 5 THEN replace(text, 'must be paid', 'may be paid') WHEN 6 THEN replace(text, 'final and complete', 'quick and open') ELSE text END AS after,
    ['{"', '".join(EDITS)}'][doc_id % 7 + 1] AS edit
  FROM template_docs
)"""
#: The facts that the template states, by construction.
FACTS_SQL = f"""
facts AS (
  SELECT o_orderkey AS doc_id, unnest([
    {{'kind': 'number', 'normalized': CAST(o_orderkey AS VARCHAR)}}, {{'kind': 'currency', 'normalized': 'USD ' || {AMOUNT}}}, {{'kind': 'modal', 'normalized': 'must'}}, {{'kind': 'comparator', 'normalized': 'before'}},
    {{'kind': 'date', 'normalized': strftime(o_orderdate, '%Y-%m-%d')}}, {{'kind': 'measurement', 'normalized': (o_orderkey % 40 + 1) || ' kg'}}, {{'kind': 'percentage', 'normalized': (o_orderkey % 9 + 1) || '%'}},
    {{'kind': 'negation', 'normalized': 'NEG'}}, {{'kind': 'comparator', 'normalized': 'after'}}, {{'kind': 'measurement', 'normalized': '5 days'}}], recursive := true)
  FROM orders
)"""
TABLE = {
    "fact_signature": f"WITH {FACTS_SQL} SELECT doc_id, kind, normalized, count(*) AS n FROM facts GROUP BY ALL",
    "fact_violations": f"""
SELECT o_orderkey AS pair_id, CASE o_orderkey % 7 WHEN 2 THEN 'currency' WHEN 3 THEN 'currency' WHEN 4 THEN 'negation' ELSE 'modal' END AS kind,
  CASE o_orderkey % 7 WHEN 2 THEN 'USD ' || {AMOUNT} WHEN 3 THEN 'USD ' || {AMOUNT} WHEN 4 THEN 'NEG' ELSE 'must' END AS lost,
  CASE o_orderkey % 7 WHEN 2 THEN 'USD 1' || {AMOUNT} WHEN 3 THEN 'GBP ' || {AMOUNT} WHEN 4 THEN '' ELSE 'may' END AS introduced,
  CASE o_orderkey % 7 WHEN 2 THEN '$' || {AMOUNT} WHEN 3 THEN '$' || {AMOUNT} WHEN 4 THEN 'not' ELSE 'must' END AS lost_surfaces,
  CASE o_orderkey % 7 WHEN 2 THEN '$1' || {AMOUNT} WHEN 3 THEN '£' || {AMOUNT} WHEN 4 THEN '' ELSE 'may' END AS introduced_surfaces,
  CASE o_orderkey % 7 WHEN 4 THEN 'removed' ELSE 'changed' END AS detail
FROM orders WHERE o_orderkey % 7 IN (2, 3, 4, 5)""",
    "fact_check": "SELECT o_orderkey AS pair_id, o_orderkey % 7 NOT IN (2, 3, 4, 5) AS passed, CASE o_orderkey % 7 WHEN 2 THEN 'currency' WHEN 3 THEN 'currency' WHEN 4 THEN 'negation' WHEN 5 THEN 'modal' ELSE '' END AS kinds FROM orders",
}
