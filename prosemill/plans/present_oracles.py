"""DuckDB SQL for the queries over stems, changes and review proposals."""

from __future__ import annotations

from ..functions import vocabulary as V
from ..operators import lexicon as L
from .oracles import WORDS, text_list
from .templates import DOCS_SQL


def _stem() -> str:
    cases = []
    for s in L.SUFFIXES:
        base = f"substr(w, 1, length(w) - {len(s)})"
        if s in L._DOUBLED:
            base = f"CASE WHEN substr({base}, -1, 1) = substr({base}, -2, 1) AND NOT contains('aeiouy', substr({base}, -1, 1)) THEN substr({base}, 1, length({base}) - 1) ELSE {base} END"
        if s in ("ies", "ied"):
            base += " || 'y'"
        cases.append(f"WHEN ends_with(w, '{s}') AND length(w) - {len(s)} >= 3 THEN {base}")
    return f"CASE WHEN length(w) <= 3 OR w IN {text_list(L.KEPT)} THEN w {' '.join(cases)} ELSE w END"


#: What the automatic rules find in a template text: surface, length of the edited span, replacement, rule.
_FOUND = [
    ("prior to", 8, "before", "clarity.prior-to"),
    ("utilise", 7, "use", "lexical.utilise"),
    ("It is important to note that ", 30, "R", "framing.it-is-important-to-note-that"),
    ("due to the fact that", 20, "because", "clarity.due-to-the-fact-that"),
]
_CHANGES = ", ".join(f"{{'surface': '{a}', 'len': {n}, 'replacement': '{b}', 'rule_id': '{r}'}}" for a, n, b, r in _FOUND)
#: A document of several sentences per customer, where one connective may stand out.
CONNECTED = """
connected AS (
  SELECT o_custkey AS doc_id, string_agg(CASE o_orderkey % 4 WHEN 0 THEN 'However, it came late.' WHEN 1 THEN 'Nevertheless, it was paid in full.' ELSE 'Nevertheless, it was sent on time.' END, ' ' ORDER BY o_orderkey) AS text,
    count(*) AS n, count(*) FILTER (WHERE o_orderkey % 4 <> 0) AS c FROM orders GROUP BY 1
)"""
TABLE = {
    "stems": f"SELECT w AS word, {_stem()} AS stem FROM (SELECT DISTINCT w FROM (SELECT unnest({WORDS}) AS w FROM documents))",
    "change_rows": f"""WITH {DOCS_SQL}, e AS (SELECT doc_id, text, unnest([{_CHANGES}], recursive := true) FROM template_docs), p AS (SELECT * REPLACE (substr(text, strpos(text, surface), len) AS surface), strpos(text, surface) - 1 AS s FROM e)
SELECT doc_id, CAST(s AS INTEGER) AS start, CAST(s + len AS INTEGER) AS "end", rule_id, surface, replacement, CAST(s + coalesce(sum(length(replacement) - len) OVER (PARTITION BY doc_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS revised_start FROM p""",
    "markdown_blocks": """SELECT o_orderkey AS doc_id, CAST(i - 1 AS INTEGER) AS position, kinds[i] AS kind, CAST(CASE WHEN i IN (1, 8 + 1) THEN 1 END AS INTEGER) AS level,
  ['Order ' || o_orderkey, 'It is ' || o_orderstatus || ' and listed. Second line.', 'first', 'second ' || o_orderkey, 'quoted text', 'sql', '', '', 'Under'][i] AS text
FROM orders, (SELECT unnest(range(1, 10)) AS i, ['heading', 'paragraph', 'list_item', 'list_item', 'quote', 'code', 'table', 'rule', 'heading'] AS kinds)""",
    "markdown_projection": "SELECT o_orderkey AS doc_id, array_to_string(['Order ' || o_orderkey, 'It is ' || o_orderstatus || ' and listed. Second line.', 'first', 'second ' || o_orderkey, 'quoted text', 'Under'], chr(10) || chr(10)) AS text FROM orders",
    "verdict_tokens": f"WITH {DOCS_SQL} SELECT doc_id, CAST(len(regexp_extract_all(text, '[A-Za-z0-9_]+|[^A-Za-z0-9_ ]')) AS BIGINT) AS tokens FROM template_docs",
    "plain_words": f"""WITH w AS (SELECT DISTINCT w FROM (SELECT unnest({WORDS}) AS w FROM documents)), s AS (SELECT w, {_stem()} AS stem FROM w), g(word, plain) AS (VALUES ('erth', 'earth'), ('there', 'here'), ('notice', 'see'), ('ation', 'act'), ('heat', 'warmth')), t(word, domain) AS (VALUES {", ".join(f"('{w}', '{d}')" for w, d in V.PROTECTED_TERMS.items())})
SELECT s.w AS word, CASE WHEN t.domain IS NULL THEN coalesce(a.plain, b.plain) END AS plain, t.domain FROM s LEFT JOIN t ON t.word = s.w LEFT JOIN g a ON a.word = s.w LEFT JOIN g b ON b.word = s.stem WHERE t.domain IS NOT NULL OR coalesce(a.plain, b.plain) IS NOT NULL""",
    # Turning k of c into another label that isn't counted yet leaves shares (c - k) / n, k / n and (n - c) / n.
    "style_proposals": f"""WITH {CONNECTED}, k AS (SELECT doc_id, n, c, unnest(range(1, c + 1)) AS k FROM connected WHERE n >= 6 AND c >= 2 AND c >= n - c AND c / CAST(n AS DOUBLE) >= 0.7::DOUBLE),
b AS (SELECT doc_id, c, min(k) AS budget FROM k WHERE greatest(c - k, k, n - c) / CAST(n AS DOUBLE) < 0.7::DOUBLE GROUP BY ALL)
SELECT doc_id, CAST(budget AS BIGINT) AS budget, CAST(least(budget, 25, c) AS BIGINT) AS proposals FROM b""",
}
