"""DuckDB SQL for the style queries."""

from __future__ import annotations

import re

from ..functions import vocabulary as V
from .oracles import SENTENCES, STYLE_WORDS, r6, text_list


def any_of(phrases) -> str:
    return "(?i)\\b(?:" + "|".join(re.escape(p) for p in sorted(phrases, key=len, reverse=True)) + ")\\b"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def style_words(x: str) -> str:
    return STYLE_WORDS.replace("(text,", f"({x},")


def sentences(x: str) -> str:
    return SENTENCES.replace("replace(text,", f"replace({x},")


def spread(n: str, s: str, sq: str) -> tuple[str, str]:
    dev = f"CASE WHEN {n} >= 2 AND {s} > 0 THEN sqrt(CAST({n} * {sq} - {s} * {s} AS DOUBLE)) / {n} ELSE 0.0 END"
    return dev, f"CASE WHEN {n} >= 2 AND {s} > 0 THEN ({dev}) / (CAST({s} AS DOUBLE) / {n}) ELSE 0.0 END"


STOP = text_list(V.STOP_WORDS)
_dev, _var = spread("ns", "sl", "sq")
_counted = {f"punctuation_{k}": f"length(text) - length(replace(text, {q(c)}, ''))" for k, c in V.PUNCTUATION.items()}
_counted |= {f"pronoun_{k}": f"len(list_filter(w, lambda x: x IN {text_list(m)}))" for k, m in V.PRONOUNS.items()}
_counted["contraction"] = f"len(regexp_extract_all(text, {q(any_of(V.CONTRACTIONS))}))"

METRICS = f"""
WITH base AS (
  SELECT doc_id, text, {STYLE_WORDS} AS w, {SENTENCES} AS s FROM documents
), measured AS (
  SELECT *, len(w) AS n, len(s) AS ns, list_transform(s, lambda y: len({style_words('y')})) AS l, list_filter(w, lambda x: x NOT IN {STOP}) AS c FROM base
), sums AS (
  SELECT *, list_sum(l) AS sl, list_sum(list_transform(l, lambda x: x * x)) AS sq, list_sort(l) AS o FROM measured
)
SELECT doc_id, CAST(n AS BIGINT) AS word_count, CAST(ns AS BIGINT) AS sentence_count,
  CASE WHEN ns > 0 THEN {r6('CAST(sl AS DOUBLE) / ns')} END AS sentence_words_mean,
  CASE WHEN ns > 0 THEN {r6('CAST(o[(ns - 1) // 2 + 1] + o[ns // 2 + 1] AS DOUBLE) / 2')} END AS sentence_words_median,
  CAST(list_min(l) AS BIGINT) AS sentence_words_min, CAST(list_max(l) AS BIGINT) AS sentence_words_max,
  CASE WHEN ns > 0 THEN {r6(_dev)} END AS sentence_words_stddev, CASE WHEN ns > 0 THEN {r6(_var)} END AS sentence_words_variation,
  CASE WHEN ns > 0 THEN {r6('len(list_filter(l, lambda x: x <= 8)) / CAST(ns AS DOUBLE)')} END AS short_sentence_rate,
  CASE WHEN ns > 0 THEN {r6('len(list_filter(l, lambda x: x >= 30)) / CAST(ns AS DOUBLE)')} END AS long_sentence_rate,
  CAST(len(c) AS BIGINT) AS content_word_count, CAST(len(list_distinct(c)) AS BIGINT) AS distinct_content_words,
  CASE WHEN len(c) > 0 THEN {r6('len(list_distinct(c)) / CAST(len(c) AS DOUBLE)')} ELSE 0.0 END AS content_word_diversity,
  CAST(len(list_filter(s, lambda x: ends_with(x, '?'))) AS BIGINT) AS question_count,
  CASE WHEN ns > 0 THEN {r6("len(list_filter(s, lambda x: ends_with(x, '?'))) * 100.0::DOUBLE / ns")} ELSE 0.0 END AS questions_per_100_sentences,
  {", ".join(f"CAST({x} AS BIGINT) AS {k}, CASE WHEN n > 0 THEN {r6(f'({x}) * 1000.0::DOUBLE / n')} ELSE {r6('0.0::DOUBLE')} END AS {k}_per_1000" for k, x in _counted.items())},
  {", ".join(f"CAST(len(list_filter(s, lambda x: regexp_matches(x, {q('(?i)' + p)}))) AS BIGINT) AS template_{k.replace('-', '_')}" for k, p in V.TEMPLATES.items())}
FROM sums
"""

BLOCKS = """
blocks AS (
  SELECT conv_id AS doc_id, turn AS position, text, CASE WHEN turn % 7 = 6 THEN 'list_item' WHEN turn % 11 = 0 AND turn > 0 THEN 'heading' ELSE 'paragraph' END AS kind,
    CASE WHEN turn % 11 = 0 AND turn > 0 THEN 1 + turn % 3 END AS level FROM conversations
)"""

_pd, _pv = spread("paragraph_count", "pws", "pwq")
_sd, _sv = spread("paragraph_count", "pss", "psq")
BLOCK_METRICS = f"""
WITH {BLOCKS}, b AS (
  SELECT *, len({STYLE_WORDS}) AS w, len({SENTENCES}) AS s FROM blocks
), g AS (
  SELECT doc_id, count(*) AS block_count, count(*) FILTER (WHERE kind = 'paragraph') AS paragraph_count, count(*) FILTER (WHERE kind = 'heading') AS heading_count,
    count(*) FILTER (WHERE kind = 'list_item') AS list_item_count, count(*) FILTER (WHERE kind = 'code') AS code_block_count, count(*) FILTER (WHERE kind = 'table') AS table_count,
    CAST(sum(w) AS BIGINT) AS words, CAST(coalesce(sum(w) FILTER (WHERE kind = 'list_item'), 0) AS BIGINT) AS list_words,
    CAST(sum(w) FILTER (WHERE kind = 'paragraph') AS BIGINT) AS pws, CAST(sum(w * w) FILTER (WHERE kind = 'paragraph') AS BIGINT) AS pwq,
    CAST(sum(s) FILTER (WHERE kind = 'paragraph') AS BIGINT) AS pss, CAST(sum(s * s) FILTER (WHERE kind = 'paragraph') AS BIGINT) AS psq,
    median(w) FILTER (WHERE kind = 'paragraph') AS pwm, median(s) FILTER (WHERE kind = 'paragraph') AS psm,
    {", ".join(f"count(*) FILTER (WHERE kind = 'heading' AND level = {k}) AS heading_level_{k}" for k in range(1, 7))}
  FROM b GROUP BY doc_id
)
SELECT doc_id, block_count, paragraph_count, heading_count, list_item_count, code_block_count, table_count,
  {", ".join(f"CASE WHEN paragraph_count > 0 THEN {r6(x)} END AS {k}" for k, x in (("paragraph_words_mean", "CAST(pws AS DOUBLE) / paragraph_count"), ("paragraph_words_median", "CAST(pwm AS DOUBLE)"), ("paragraph_words_stddev", _pd), ("paragraph_words_variation", _pv), ("paragraph_sentences_mean", "CAST(pss AS DOUBLE) / paragraph_count"), ("paragraph_sentences_median", "CAST(psm AS DOUBLE)"), ("paragraph_sentences_stddev", _sd), ("paragraph_sentences_variation", _sv)))},
  CASE WHEN words > 0 THEN {r6('words / CAST(greatest(heading_count, 1) AS DOUBLE)')} END AS words_per_heading,
  CASE WHEN words > 0 THEN {r6('list_words / CAST(words AS DOUBLE)')} END AS list_word_share,
  {r6('list_item_count / CAST(block_count AS DOUBLE)')} AS list_block_share,
  CASE WHEN list_item_count > 0 THEN {r6('list_words / CAST(list_item_count AS DOUBLE)')} END AS list_item_words_mean,
  {", ".join(f"heading_level_{k}" for k in range(1, 7))}
FROM g
"""

_INITIAL = "(?i)^[^\\p{L}\\p{N}]*(" + "|".join(sorted(V.INITIAL_TRANSITIONS, key=len, reverse=True)) + ")(?:[^\\p{L}\\p{N}_''-]|$)"
_TRIAD = "(?i)[\\p{L}\\p{N}_''’-]+,[ \\t\\n\\r]+[\\p{L}\\p{N}_''’-]+,?[ \\t\\n\\r]+and[ \\t\\n\\r]+[\\p{L}\\p{N}_''’-]*[\\p{L}\\p{N}_]"


def top(rows: str, labels: str, out: str) -> str:
    """CTE text: the commonest label per document, ties to the first in order, at least two."""
    return f"""{out} AS (
  SELECT doc_id, n, c, label FROM (
    SELECT doc_id, n, label, c, row_number() OVER (PARTITION BY doc_id ORDER BY c DESC, label) AS r
    FROM (SELECT doc_id, n, label, count(*) AS c FROM (SELECT doc_id, len({labels}) AS n, unnest({labels}) AS label FROM {rows}) GROUP BY ALL HAVING count(*) >= 2)
  ) WHERE r = 1
)"""


def opener(rows: str, texts: str, out: str) -> str:
    return f"""{out}_w AS (
  SELECT doc_id, n, {style_words('t')} AS w FROM (SELECT doc_id, len({texts}) AS n, unnest({texts}) AS t FROM {rows})
), {out} AS (
  SELECT doc_id, n, c, opener AS label FROM (
    SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY c DESC, size DESC, opener) AS r FROM (
      SELECT doc_id, n, size, array_to_string(w[1:size], ' ') AS opener, count(*) AS c FROM {out}_w, (VALUES (1), (2), (3)) AS k(size) WHERE len(w) >= size GROUP BY ALL HAVING count(*) >= 2
    )
  ) WHERE r = 1
)"""


_su, _sv2 = spread("len(s)", "list_sum(l)", "list_sum(list_transform(l, lambda x: x * x))")
PHRASES = f"""
sent AS (
  SELECT doc_id, total, ns, i, {style_words('t')} AS w FROM (SELECT doc_id, len(w) AS total, len(s) AS ns, unnest(s) AS t, generate_subscripts(s, 1) AS i FROM base)
), grams AS (
  SELECT doc_id, total, ns, size, w[p:p + size - 1] AS g FROM (SELECT *, unnest(range(1, len(w) - size + 2)) AS p FROM sent, (VALUES (3), (4), (5)) AS k(size) WHERE len(w) >= size)
), counted AS (
  SELECT doc_id, total, ns, size, array_to_string(g, ' ') AS phrase, count(*) AS c FROM grams WHERE len(list_filter(g, lambda x: x NOT IN {STOP})) > 0 GROUP BY ALL HAVING count(*) >= 3
), kept AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY size DESC, c DESC, phrase) AS r FROM counted) WHERE r <= 50
), phrase AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY c DESC, size DESC, phrase DESC) AS k FROM kept) WHERE k = 1
)"""

SENTENCE_DIAGNOSTICS_CTE = f"""
base AS (
  SELECT doc_id, text, {STYLE_WORDS} AS w, {SENTENCES} AS s FROM documents
), lens AS (
  SELECT doc_id, s, list_transform(s, lambda y: len({style_words('y')})) AS l FROM base
), {opener('base', 's', 'op')}, hit AS (
  SELECT doc_id, s, list_concat(list_concat(list_transform(regexp_extract_all(text, {q(any_of(V.TRANSITIONS))}), lambda x: lower(x)), list_transform(regexp_extract_all(text, {q(any_of(V.TRANSITION_PHRASES))}), lambda x: lower(x))),
    list_filter(list_transform(s, lambda x: lower(regexp_extract(x, '{_INITIAL}', 1))), lambda x: x <> '')) AS h FROM base
), {top('hit', 'h', 'tr')}, flag AS (
  SELECT doc_id, list_filter(w, lambda x: x IN {text_list(V.FLAGGED_WORDS)}) AS f FROM base
), {top('flag', 'f', 'vo')}, rhet AS (
  SELECT doc_id, ns, label, c FROM (
    SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY c DESC, label) AS r FROM (
      {" UNION ALL ".join(f"SELECT doc_id, len(s) AS ns, '{k}' AS label, len(list_filter(s, lambda x: regexp_matches(x, {q('(?i)' + p)}))) AS c FROM base" for k, p in V.RHETORICAL.items())}
    ) WHERE c > 0
  ) WHERE r = 1
), {PHRASES}, observed AS (
  SELECT doc_id, 'SENTENCE_UNIFORMITY' AS diagnostic, {r6(_sv2)} AS value, CAST(len(s) AS BIGINT) AS sample, CAST(NULL AS VARCHAR) AS label FROM lens WHERE len(s) > 0
  UNION ALL SELECT doc_id, 'REPEATED_SENTENCE_OPENER', {r6('c / CAST(n AS DOUBLE)')}, CAST(n AS BIGINT), label FROM op
  UNION ALL SELECT doc_id, 'TRANSITION_DENSITY', {r6('len(h) / CAST(len(s) AS DOUBLE)')}, CAST(len(s) AS BIGINT), NULL FROM hit WHERE len(s) > 0 AND len(h) > 0
  UNION ALL SELECT doc_id, 'REPEATED_TRANSITION', {r6('c / CAST(n AS DOUBLE)')}, CAST(n AS BIGINT), label FROM tr
  UNION ALL SELECT doc_id, 'VOCABULARY_OVERUSE', {r6('c * 1000.0::DOUBLE / len(w)')}, CAST(len(w) AS BIGINT), label FROM vo JOIN base USING (doc_id) WHERE len(w) > 0
  UNION ALL SELECT doc_id, 'RHETORICAL_REPETITION', {r6('c * 10.0::DOUBLE / ns')}, CAST(ns AS BIGINT), label FROM rhet
  UNION ALL SELECT doc_id, 'TRIADIC_REPETITION', {r6("len(list_filter(s, lambda x: regexp_matches(x, '" + _TRIAD + "'))) * 10.0::DOUBLE / len(s)")}, CAST(len(s) AS BIGINT), NULL FROM base WHERE len(list_filter(s, lambda x: regexp_matches(x, '{_TRIAD}'))) >= 2
  UNION ALL SELECT doc_id, 'REPEATED_PHRASE', {r6('c * 100.0::DOUBLE / total')}, CAST(ns AS BIGINT), phrase FROM phrase
)"""

_bu, _bv = spread("len(p)", "list_sum(l)", "list_sum(list_transform(l, lambda x: x * x))")
BLOCK_DIAGNOSTICS_CTE = f"""
{BLOCKS}, para AS (
  SELECT doc_id, coalesce(list(text ORDER BY position) FILTER (WHERE kind = 'paragraph'), []) AS p, list(text ORDER BY position) AS a, count(*) FILTER (WHERE kind = 'list_item') AS items FROM blocks GROUP BY doc_id
), plen AS (
  SELECT *, list_transform(p, lambda y: len({style_words('y')})) AS l FROM para
), {opener('para', 'p', 'po')}, framing AS (
  SELECT doc_id, CASE WHEN len(p) > 0 THEN len(p) ELSE len(a) END AS n, list_sum(list_transform(a, lambda x: len(regexp_extract_all(x, {q(any_of(V.FRAMING_PHRASES))})))) AS c FROM para
), cw AS (
  SELECT doc_id, position, list_filter({STYLE_WORDS}, lambda x: x NOT IN {STOP}) AS c FROM blocks WHERE kind = 'paragraph'
), cn AS (
  SELECT doc_id, count(*) AS paragraphs, count(*) FILTER (WHERE len(c) >= 20) AS comparable FROM cw GROUP BY doc_id
), sets AS (
  SELECT doc_id, position, list_distinct(c) AS t FROM cw WHERE len(c) >= 20
), idx AS (
  SELECT doc_id, position, unnest(t) AS token FROM sets
), dfs AS (
  SELECT doc_id, token, df, sum(df * (df - 1) // 2) OVER (PARTITION BY doc_id ORDER BY df, token ROWS UNBOUNDED PRECEDING) AS spent
  FROM (SELECT doc_id, token, count(*) AS df FROM idx GROUP BY ALL) JOIN cn USING (doc_id) WHERE df <= greatest(2, comparable // 2)
), useful AS (
  SELECT idx.* FROM idx JOIN dfs USING (doc_id, token) WHERE spent <= 200000
), pairs AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY l, r) AS k FROM (
    SELECT x.doc_id, x.position AS l, y.position AS r FROM useful x JOIN useful y ON x.doc_id = y.doc_id AND x.token = y.token AND x.position < y.position GROUP BY ALL HAVING count(*) >= 5)) WHERE k <= 20000
), overlap AS (
  SELECT doc_id, score, l, r FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, l, r) AS k FROM (
    SELECT p.doc_id, l, r, len(list_intersect(a.t, b.t)) / CAST(len(list_distinct(list_concat(a.t, b.t))) AS DOUBLE) AS score
    FROM pairs p JOIN sets a ON a.doc_id = p.doc_id AND a.position = l JOIN sets b ON b.doc_id = p.doc_id AND b.position = r)) WHERE k = 1
), observed AS (
  SELECT doc_id, 'PARAGRAPH_UNIFORMITY' AS diagnostic, {r6(_bv)} AS value, CAST(len(p) AS BIGINT) AS sample, CAST(NULL AS VARCHAR) AS label FROM plen WHERE len(p) > 0
  UNION ALL SELECT doc_id, 'REPEATED_PARAGRAPH_OPENER', {r6('c / CAST(n AS DOUBLE)')}, CAST(n AS BIGINT), label FROM po
  UNION ALL SELECT doc_id, 'CANNED_FRAMING', {r6('c / CAST(n AS DOUBLE)')}, CAST(n AS BIGINT), NULL FROM framing WHERE c > 0
  UNION ALL SELECT doc_id, 'LIST_DOMINANCE', {r6('items / CAST(len(a) AS DOUBLE)')}, CAST(len(a) AS BIGINT), NULL FROM para WHERE items > 0
  UNION ALL SELECT doc_id, 'LEXICAL_OVERLAP', {r6('score')}, CAST(paragraphs AS BIGINT), l || '/' || r FROM overlap JOIN cn USING (doc_id)
)"""


def _rules() -> str:
    rows = []
    for profile in ["baseline", *V.PROFILES]:
        for name, (least, notice, strong, inverted) in V.DIAGNOSTICS.items():
            own = V.PROFILES.get(profile, {}).get(name, (None, None, None))
            rows.append(f"('{profile}', '{name}', {own[0] or least}, {float(own[1] or notice)}::DOUBLE, {float(own[2] or strong)}::DOUBLE, {str(inverted).lower()})")
    return "rules(profile, diagnostic, least, notice, strong, inverted) AS (VALUES " + ", ".join(rows) + ")"


_TARGETS = "targets(profile, metric, low, high) AS (VALUES " + ", ".join(f"('{p}', '{m}', {float(lo)}::DOUBLE, {float(hi)}::DOUBLE)" for p, ms in V.TARGETS.items() for m, (lo, hi) in ms.items()) + ")"
_SEVERITY = "CASE WHEN sample < least THEN 'insufficient_sample' WHEN CASE WHEN inverted THEN value <= strong ELSE value >= strong END THEN 'strong' WHEN CASE WHEN inverted THEN value <= notice ELSE value >= notice END THEN 'notice' ELSE 'none' END"
_FOUND = f"found AS (SELECT doc_id, profile, diagnostic, value, sample, {_SEVERITY} AS severity FROM observed JOIN rules USING (diagnostic))"
TARGET_METRICS = ["sentence_words_mean", "short_sentence_rate", "long_sentence_rate", "content_word_diversity", "contraction_per_1000", "punctuation_semicolon_per_1000"]

TABLE = {
    "style_metrics": METRICS,
    "block_metrics": BLOCK_METRICS,
    "sentence_diagnostics": f"WITH {SENTENCE_DIAGNOSTICS_CTE} SELECT * FROM observed",
    "block_diagnostics": f"WITH {BLOCK_DIAGNOSTICS_CTE} SELECT * FROM observed",
    "profile_findings": f"WITH {SENTENCE_DIAGNOSTICS_CTE}, {_rules()}, {_FOUND} SELECT * FROM found",
    "band_map": f"WITH {SENTENCE_DIAGNOSTICS_CTE}, {_rules()}, {_FOUND}, docs AS (SELECT DISTINCT doc_id, profile FROM found), names AS (SELECT DISTINCT diagnostic FROM rules) SELECT d.doc_id, d.profile, n.diagnostic, coalesce(CASE WHEN f.severity = 'insufficient_sample' THEN 'not-assessed' ELSE f.severity END, 'none') AS band FROM docs d CROSS JOIN names n LEFT JOIN found f ON f.doc_id = d.doc_id AND f.profile = d.profile AND f.diagnostic = n.diagnostic",
    "available_samples": f"""WITH {SENTENCE_DIAGNOSTICS_CTE}, counts AS (
  SELECT doc_id, CAST(len(b.s) AS BIGINT) AS ns, CAST(len(b.w) AS BIGINT) AS nw, CAST(len(h.h) AS BIGINT) AS nh,
    CAST(len(list_filter(string_split_regex(coalesce(b.text, ''), '\\n[ \\t\\r]*(?:\\n[ \\t\\r]*)+'), lambda x: NOT regexp_full_match(x, '\\s*'))) AS BIGINT) AS np
  FROM base b JOIN hit h USING (doc_id)
), names AS (SELECT unnest([{', '.join(map(q, V.DIAGNOSTICS))}]) AS diagnostic)
SELECT doc_id, diagnostic, coalesce(CASE WHEN diagnostic IN ('PARAGRAPH_UNIFORMITY', 'REPEATED_PARAGRAPH_OPENER', 'LEXICAL_OVERLAP', 'CANNED_FRAMING', 'LIST_DOMINANCE') THEN np
  WHEN diagnostic = 'VOCABULARY_OVERUSE' THEN nw WHEN diagnostic = 'REPEATED_TRANSITION' THEN nh ELSE ns END, 0) AS sample FROM counts CROSS JOIN names""",
    "evidence_of_openers": f"""WITH {SENTENCE_DIAGNOSTICS_CTE}, each AS (
  SELECT b.doc_id, o.label, CAST(i - 1 AS INTEGER) AS place, trim(regexp_replace(b.s[i], '\\s+', ' ', 'g')) AS flat, {style_words('b.s[i]')} AS w FROM (SELECT *, unnest(range(1, len(s) + 1)) AS i FROM base) b JOIN op o ON o.doc_id = b.doc_id
), shown AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY place) AS k FROM each WHERE array_to_string(w[1:len(string_split(label, ' '))], ' ') = label
)
SELECT doc_id, label, place, CASE WHEN length(flat) <= 72 THEN flat ELSE substr(flat, 1, 71) || '…' END AS excerpt FROM shown WHERE k <= 10""",
    "profile_coverage": f"WITH {BLOCK_DIAGNOSTICS_CTE}, {_rules()}, {_FOUND}, docs AS (SELECT DISTINCT doc_id FROM blocks) SELECT d.doc_id, r.profile, r.diagnostic, CASE WHEN f.severity IS NULL THEN 'silent' WHEN f.severity = 'insufficient_sample' THEN f.severity ELSE 'assessed' END AS status FROM docs d CROSS JOIN rules r LEFT JOIN found f ON f.doc_id = d.doc_id AND f.profile = r.profile AND f.diagnostic = r.diagnostic",
    "profile_targets": f"WITH metrics AS ({METRICS}), {_TARGETS}, long AS (" + " UNION ALL ".join(f"SELECT doc_id, '{m}' AS metric, CAST({m} AS DOUBLE) AS value FROM metrics" for m in TARGET_METRICS) + ") SELECT doc_id, profile, metric, value, CASE WHEN value < low THEN 'below' WHEN value > high THEN 'above' ELSE 'within' END AS place FROM long JOIN targets USING (metric) WHERE value IS NOT NULL",
}
