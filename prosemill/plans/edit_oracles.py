"""DuckDB SQL for rule matches, conflicts, edits, verdicts and barriers."""

from __future__ import annotations

import re

from ..functions import vocabulary as V
from ..operators import barriers as B
from ..operators.edits import AUTOMATIC, PROTECTED
from ..operators.present import STYLE_RULES
from .oracles import SENTENCES, WORDS, syllables, text_list
from .oracles import TABLE as READABILITY
from .style_oracles import q
from .templates import BARRIERS, CASES, DOCS_SQL, PAIRS_SQL


def _pattern(rule) -> str:
    return "(?i)(?:" + "|".join((r"\b" if s[0].isalnum() else "") + re.escape(s).replace("\\ ", " ") + (r"\b" if s[-1].isalnum() else "") for s in sorted(rule.literals, key=len, reverse=True)) + ")"


PROPOSALS = """
proposals AS (
  SELECT l_orderkey AS doc_id, l_linenumber * 6 + l_partkey % 5 AS s, l_linenumber * 6 + l_partkey % 5 + 3 + l_suppkey % 7 AS e, 'R' || (l_partkey % 6) AS rule_id, CAST(l_quantity AS BIGINT) % 3 AS priority, 'x' || (l_suppkey % 2) AS replacement, l_linenumber AS n FROM lineitem
)"""

SETTLED = f"""
WITH {PROPOSALS}, begun AS (
  SELECT *, CASE WHEN s < max(e) OVER (PARTITION BY doc_id ORDER BY s, e, rule_id, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS b FROM proposals
), grouped AS (
  SELECT *, CAST(sum(b) OVER (PARTITION BY doc_id ORDER BY s, e, rule_id, n ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM begun
), facts AS (
  SELECT doc_id, island, count(*) AS c, min(s) AS lo, max(e) AS hi, count(DISTINCT (s, e, replacement)) AS kinds, max(priority) AS top, max(e - s) AS wide FROM grouped GROUP BY ALL
), more AS (
  SELECT g.*, f.c, f.lo, f.hi, f.kinds, f.wide,
    count(*) FILTER (WHERE g.priority = f.top) OVER p AS tops, count(*) FILTER (WHERE g.e - g.s = f.wide) OVER p AS wides, g.priority = f.top AS is_top,
    row_number() OVER (PARTITION BY g.doc_id, g.island ORDER BY rule_id, s, e, replacement, n) AS first
  FROM grouped g JOIN facts f USING (doc_id, island) WINDOW p AS (PARTITION BY g.doc_id, g.island)
)
SELECT doc_id, CAST(n AS BIGINT) AS n, island, CASE WHEN c = 1 THEN 'accepted' WHEN kinds = 1 THEN CASE WHEN first = 1 THEN 'accepted' ELSE 'duplicate' END
  WHEN tops = 1 THEN CASE WHEN is_top THEN 'accepted' ELSE 'superseded-by-priority' END
  WHEN wides = 1 AND wide = hi - lo THEN CASE WHEN s = lo AND e = hi THEN 'accepted' ELSE 'superseded-by-longer' END ELSE 'conflict' END AS decision
FROM more
"""

_SENT = f"sents AS (SELECT doc_id, i - 1 AS sentence, t, {WORDS.replace('text', 't')} AS w FROM (SELECT doc_id, unnest(s) AS t, generate_subscripts(s, 1) AS i FROM (SELECT doc_id, {SENTENCES} AS s FROM documents)))"
_PAIRS = "[" + ", ".join(q(p) for p in V.REDUNDANT_PAIRS) + "]"
# DuckDB's \\b knows ASCII letters only, so the character before is matched instead; group 1 is the phrase.
_EDGE = "(?i)(?:^|[^\\p{L}\\p{N}_])("
_PASSIVE = ", ".join(f"list_transform(list_filter(list_zip(regexp_extract_all(t, {q(p)}, 1), regexp_extract_all(t, {q(p)}, 2)), lambda z: lower(z[2]) NOT IN {text_list(V.ADJECTIVES)}), lambda z: {{'type': 'passive_voice', 'match': z[1], 'severity': 'warning'}})" for p in (_EDGE + x.removeprefix("(?i)\\b") + ")" for x in B.PASSIVE))
_HARD = f"list_transform(list_filter(w, lambda x: (({syllables('x')}) >= 4 OR length(x) >= 9) AND (({syllables('x')}) >= 3 OR length(x) >= 7)), lambda x: {{'type': 'complex_word', 'match': x, 'severity': CASE WHEN ({syllables('x')}) >= 4 OR length(x) >= 10 THEN 'warning' ELSE 'info' END}})"
_FOUND = f"""
{_SENT}, every AS (
  SELECT doc_id, sentence, len(w) AS words, flatten([{_PASSIVE}, {_HARD},
    list_transform(list_filter({_PAIRS}, lambda p: contains(lower(t), p)), lambda p: {{'type': 'redundant_pair', 'match': p, 'severity': 'info'}}),
    CASE WHEN len(w) > 25 THEN [{{'type': 'long_sentence', 'match': substr(t, 1, 100) || CASE WHEN len(w) > 35 AND length(t) > 100 THEN '...' ELSE '' END, 'severity': CASE WHEN len(w) > 40 THEN 'critical' WHEN len(w) > 35 THEN 'warning' ELSE 'info' END}}] ELSE [] END]) AS f FROM sents
), found AS (
  SELECT doc_id, sentence, words, generate_subscripts(f, 1) - 1 AS place, unnest(f, recursive := true) FROM every
), uniq AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, sentence, lower(trim(match)) ORDER BY CASE severity WHEN 'critical' THEN 3 WHEN 'warning' THEN 2 ELSE 1 END DESC, place) AS r FROM found) WHERE r = 1
), ranked AS (
  SELECT *, CASE type WHEN 'long_sentence' THEN 3 WHEN 'jargon' THEN 3 WHEN 'redundant_pair' THEN 1 ELSE 2 END AS p FROM uniq
)"""
_ACTION = "CASE type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in B.ADVICE.items()) + " END"

TABLE = {
    "rule_matches": f"WITH {DOCS_SQL} SELECT * FROM (" + " UNION ALL ".join(f"SELECT doc_id, '{r.rule_id}' AS rule_id, CAST(len(regexp_extract_all(text, {q(_pattern(r))})) AS BIGINT) AS n FROM template_docs" for r in AUTOMATIC) + ") WHERE n > 0",
    "conflict_settlement": SETTLED,
    "guarded_edits": f"WITH {DOCS_SQL} SELECT doc_id, replace(replace(replace(replace(text, 'prior to', 'before'), 'utilise', 'use'), 'It is important to note that refunds', 'Refunds'), 'due to the fact that', 'because') AS after, CAST(4 AS BIGINT) AS n_edits, CAST(0 AS BIGINT) AS n_vetoed, 'applied' AS status, '' AS kinds FROM template_docs",
    "vetoed_edits": f"WITH {DOCS_SQL} SELECT doc_id, replace(replace(replace(replace(replace(text, 'prior to', 'before'), 'utilise', 'use'), 'It is important to note that refunds', 'Refunds'), 'due to the fact that', 'because'), 'weighs', 'is') AS after, CAST(5 AS BIGINT) AS n_edits, CAST(1 AS BIGINT) AS n_vetoed, 'applied' AS status, 'modal' AS kinds FROM template_docs",
    "article_edits": """SELECT o_orderkey AS doc_id, 'A used tool, number ' || o_orderkey || '. A started task is a spent sum.' || chr(10) || chr(10) || 'The material before use is chronic, and informed consent comes first.' AS after,
  'lexical.utilised:An utilised:A used:accepted: | lexical.commenced:commenced:started:accepted: | lemma.expend:an expended:a spent:accepted: | test.material:The material:The stuff:refused:inherited-protected: material (legal) | clarity.prior-to:prior to:before:accepted: | test.informed:informed:told:refused:declared-protected' AS proposals FROM orders""",
    "rule_listing": "SELECT * FROM (VALUES " + ", ".join(f"({q(r.rule_id)}, {q(r.mode)}, CAST({r.priority} AS INTEGER), {q(a)}, {q(b)})" for r in [*AUTOMATIC, *PROTECTED, *STYLE_RULES] for a, b in sorted(r.literals.items())) + ") t(rule_id, mode, priority, surface, replacement)",
    "verdict_cases": f"SELECT o_orderkey AS pair_id, {[c[2] for c in CASES]}[o_orderkey % {len(CASES)} + 1] AS verdict, {[c[3] for c in CASES]}[o_orderkey % {len(CASES)} + 1] AS codes FROM orders",
    "barrier_cases": "SELECT o_orderkey AS doc_id, CAST(sentence AS BIGINT) AS sentence, type, match, severity, confidence, priority FROM orders, (VALUES " + ", ".join(f"({b[0]}, " + ", ".join(map(q, b[1:])) + ")" for b in BARRIERS) + ") t(sentence, type, match, severity, confidence, priority)",
    "protection_words": "SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), '[\\p{L}''\\-]+')) AS BIGINT) AS n_words FROM documents",
    "sealed_plans": f"WITH {DOCS_SQL}, a AS (SELECT doc_id, text, replace(replace(replace(replace(text, 'prior to', 'before'), 'utilise', 'use'), 'It is important to note that refunds', 'Refunds'), 'due to the fact that', 'because') AS after FROM template_docs) SELECT doc_id, ['applied', 'stale_policy', 'stale_document', 'tampered'][doc_id % 4 + 1] AS status, CAST(CASE doc_id % 4 WHEN 0 THEN length(after) WHEN 2 THEN length(text) + 6 ELSE length(text) END AS BIGINT) AS n_chars FROM a",
    "touched_segments": "WITH s AS (SELECT l_orderkey AS doc_id, CAST(l_linenumber * 6 + l_partkey % 5 AS BIGINT) AS start, CAST(l_linenumber * 6 + l_partkey % 5 + 3 + l_suppkey % 7 AS BIGINT) AS \"end\" FROM lineitem), g AS (SELECT l_orderkey AS doc_id, CAST(l_linenumber * 8 AS BIGINT) AS \"from\", CAST(l_linenumber * 8 + 5 AS BIGINT) AS \"to\" FROM lineitem) SELECT * FROM s JOIN g USING (doc_id) WHERE start < \"to\" AND \"from\" < \"end\"",
    "parsed_sources": "SELECT o_orderkey AS doc_id, CAST(CASE WHEN o_orderkey % 2 = 0 THEN 9 ELSE 8 END AS BIGINT) AS blocks, CAST(CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 8 END AS BIGINT) AS paragraphs FROM orders",
    "readability_warnings": f"SELECT doc_id, array_to_string(list_concat(list_transform(list_filter(string_split(clamped, ','), lambda g: g <> ''), lambda g: g || ' was limited to the range 0 to 25'), CASE sample_status WHEN 'insufficient_sample' THEN ['fewer than 100 words or 3 sentences: scores mean little'] WHEN 'limited_sample' THEN ['fewer than 300 words: scores are rough'] ELSE [] END), '; ') AS warnings FROM ({READABILITY['readability']})",
    "revised_offsets": "WITH e AS (SELECT l_orderkey AS doc_id, l_linenumber * 10 AS s, l_linenumber * 10 + 2 + l_partkey % 6 AS e, l_suppkey % 9 AS len FROM lineitem) SELECT doc_id, CAST(CASE WHEN count(*) FILTER (WHERE s < 35 AND 35 < e) > 0 THEN max(s) FILTER (WHERE s < 35 AND 35 < e) ELSE 35 END + coalesce(sum(len - (e - s)) FILTER (WHERE e <= 35), 0) AS BIGINT) AS revised FROM e GROUP BY doc_id",
    "fix_budgets": "WITH h AS (SELECT o_custkey AS doc_id, count(*) AS n, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS t, count(*) FILTER (WHERE o_orderpriority = '5-LOW') AS r, greatest(count(*) FILTER (WHERE o_orderpriority = '2-HIGH'), count(*) FILTER (WHERE o_orderpriority = '3-MEDIUM'), count(*) FILTER (WHERE o_orderpriority = '4-NOT SPECIFIED')) AS o FROM orders GROUP BY 1), k AS (SELECT *, unnest(range(1, t + 1)) AS k FROM h) SELECT h.doc_id, CAST(coalesce(min(k.k) FILTER (WHERE greatest(k.t - k.k, k.r + k.k, k.o) / CAST(k.n AS DOUBLE) < 0.4::DOUBLE), 0) AS BIGINT) AS budget FROM h LEFT JOIN k USING (doc_id) GROUP BY h.doc_id",
    "verdicts": f"WITH {PAIRS_SQL} SELECT edit, CASE WHEN edit IN ('none', 'comparator') THEN 'ACCEPTED' WHEN edit = 'wording' THEN 'INCONCLUSIVE' ELSE 'REFUSED' END AS verdict, count(*) AS n FROM template_pairs GROUP BY ALL",
    "barriers": f"WITH {_FOUND} SELECT doc_id, sentence, type, match, severity, CAST(words AS BIGINT) AS words FROM uniq",
    "placed_barriers": f"WITH {_FOUND}, m AS (SELECT u.doc_id, u.sentence, u.type, u.match, lower(s.t) AS t, lower(u.match) AS x FROM uniq u JOIN sents s USING (doc_id, sentence)), c AS (SELECT *, (length(t) - length(replace(t, x, ''))) // length(x) AS k FROM m) SELECT doc_id, sentence, type, match, CASE WHEN k = 1 THEN 'placed' WHEN k > 1 THEN 'ambiguous' ELSE 'absent' END AS status, CAST(CASE WHEN k = 1 THEN strpos(t, x) - 1 END AS BIGINT) AS start, CAST(CASE WHEN k = 1 THEN strpos(t, x) - 1 + length(match) END AS BIGINT) AS \"end\" FROM c",
    # What is shown at a barrier's place in the source is the match itself.
    "source_barriers": f"WITH {_FOUND}, m AS (SELECT u.doc_id, u.sentence, u.type, lower(u.match) AS x, lower(s.t) AS t FROM uniq u JOIN sents s USING (doc_id, sentence)) SELECT doc_id, sentence, type, x AS match, x AS shown FROM m WHERE (length(t) - length(replace(t, x, ''))) // length(x) = 1",
    "barrier_summary": f"WITH {_FOUND} SELECT d.doc_id, count(u.type) AS total, count(*) FILTER (WHERE severity = 'critical') AS critical, count(*) FILTER (WHERE severity = 'warning') AS warnings, count(*) FILTER (WHERE severity = 'info') AS infos FROM documents d LEFT JOIN uniq u USING (doc_id) GROUP BY d.doc_id",
    "barriers_by_sentence": f"WITH {_FOUND} SELECT doc_id, sentence, count(*) AS issues, count(DISTINCT type) AS types, ['info', 'consider', 'high'][max(p)] AS priority FROM ranked GROUP BY ALL",
    "top_improvements": f"WITH {_FOUND}, t AS (SELECT doc_id, sentence, type, p, min(place) AS place FROM ranked GROUP BY ALL), s AS (SELECT *, max(p) OVER (PARTITION BY doc_id, sentence) AS sp FROM t), o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY sp DESC, sentence, p DESC, place) AS rank FROM s WHERE type IN {text_list(B.ADVICE)}) SELECT doc_id, rank, sentence, type, {_ACTION} AS action FROM o WHERE rank <= 7",
}
