"""DuckDB SQL that computes the registered queries independently.

The helpers below only assemble SQL text.
"""

from __future__ import annotations


def r6(x: str) -> str:
    return f"floor(({x}) * 1e6 + 0.5) / 1e6"


def text_list(items) -> str:
    return "(" + ", ".join("'" + x.replace("'", "''") + "'" for x in items) + ")"


WORDS = "regexp_extract_all(lower(text), '[a-zA-Z]+')"
STYLE_WORDS = "list_transform(regexp_extract_all(text, '[A-Za-z]+(?:[''’\\-][A-Za-z]+)*'), lambda w: replace(lower(w), '’', ''''))"
SENTENCES = "list_filter(list_transform(string_split(regexp_replace(text, '([.!?])[ \\t\\n\\r]+([A-Z0-9])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda s: trim(s, ' ' || chr(9) || chr(10) || chr(13))), lambda s: s <> '')"


def syllables(w: str) -> str:
    """Syllables of a lower-case word."""
    at = lambda k: f"substr({w}, length({w}) - {k - 1}, 1)"
    vowel = lambda k: f"contains('aeiouy', {at(k)})"
    le = f"((ends_with({w}, 'le') AND length({w}) > 2 AND NOT {vowel(3)}) OR (ends_with({w}, 'les') AND length({w}) > 3 AND NOT {vowel(4)}))"
    silent = f"(ends_with({w}, 'e') AND length({w}) > 3 AND NOT {vowel(2)})"
    groups = f"(len(regexp_extract_all({w}, '[aeiouy]+')) - CAST({silent} AS INT) + CAST({le} AS INT))"
    past = f"(ends_with({w}, 'ed') AND length({w}) > 3 AND {at(3)} NOT IN ('d', 't'))"
    return f"CASE WHEN length({w}) = 0 THEN 0 WHEN length({w}) <= 2 THEN 1 ELSE greatest(1, CASE WHEN {past} THEN greatest(1, {groups} - 1) ELSE {groups} END) END"


COUNTS = f"""
counted AS (
  SELECT doc_id, lang, CAST(len(w) AS BIGINT) AS words, CAST(len(s) AS BIGINT) AS sentences,
    CAST(coalesce(list_sum(list_transform(w, lambda x: {syllables('x')})), 0) AS BIGINT) AS syllables,
    CAST(len(list_filter(w, lambda x: ({syllables('x')}) >= 3)) AS BIGINT) AS complex_words,
    CAST(len(list_filter(w, lambda x: length(x) >= 7)) AS BIGINT) AS long_words,
    CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS characters
  FROM (SELECT doc_id, lang, {WORDS} AS w, {SENTENCES} AS s FROM documents)
)"""

_D = lambda x: f"CAST({x} AS DOUBLE)"
SCORES = f"""
raw AS (
  SELECT *, CASE WHEN sentences <> 0 THEN {_D('words')} / sentences END AS wps, CASE WHEN words <> 0 THEN {_D('syllables')} / words END AS spw,
    CASE WHEN words <> 0 THEN {_D('characters')} / words END AS cpw, CASE WHEN words <> 0 THEN {_D('complex_words')} / words END AS xpw FROM counted
), formulas AS (
  SELECT *, 0.39::DOUBLE * wps + 11.8::DOUBLE * spw - 15.59::DOUBLE AS fk, 0.4::DOUBLE * (wps + 100.0::DOUBLE * xpw) AS gf,
    CASE WHEN words > 0 AND sentences > 0 THEN CASE WHEN complex_words > 0 THEN 1.0430::DOUBLE * sqrt(complex_words * 30.0::DOUBLE / sentences) + 3.1291::DOUBLE ELSE 3.1291::DOUBLE END END AS sm,
    4.71::DOUBLE * cpw + 0.5::DOUBLE * wps - 21.43::DOUBLE AS ar,
    CASE WHEN words >= 100 THEN 0.0588::DOUBLE * (characters * 100.0::DOUBLE / words) - 0.296::DOUBLE * (sentences * 100.0::DOUBLE / words) - 15.8::DOUBLE END AS cl,
    206.835::DOUBLE - 1.015::DOUBLE * wps - 84.6::DOUBLE * spw AS fe
  FROM raw
), clamps AS (
  SELECT *, {", ".join(f"CASE WHEN {x} IS NOT NULL THEN least(greatest({x}, 0.0::DOUBLE), 25.0::DOUBLE) END AS c_{x}" for x in ("fk", "gf", "sm", "ar", "cl"))},
    CASE WHEN fe IS NOT NULL THEN least(greatest(fe, 0.0::DOUBLE), 100.0::DOUBLE) END AS c_fe
  FROM formulas
), merged AS (
  SELECT *, list_filter([c_fk, c_gf, c_sm, c_ar, c_cl], lambda g: g IS NOT NULL) AS known FROM clamps
), scored AS (
  SELECT *, len(known) AS n_known, CASE WHEN len(known) > 0 THEN list_reduce(list_prepend(0.0::DOUBLE, known), lambda a, b: a + b) / len(known) END AS mean FROM merged
)"""
BAND = "CASE WHEN mean IS NULL THEN NULL WHEN mean <= 3 THEN 'Very Easy' WHEN mean <= 6 THEN 'Easy' WHEN mean <= 8 THEN 'Fairly Easy' WHEN mean <= 10 THEN 'Standard' WHEN mean <= 12 THEN 'Fairly Difficult' WHEN mean <= 16 THEN 'Difficult' ELSE 'Very Difficult' END"
_NAMES = {"fk": "flesch_kincaid", "gf": "gunning_fog", "sm": "smog", "ar": "ari", "cl": "coleman_liau"}

READABILITY = f"""
WITH {COUNTS}, {SCORES}
SELECT doc_id, words, sentences, syllables, complex_words, long_words, characters,
  {r6('wps')} AS words_per_sentence, {r6('spw')} AS syllables_per_word, {r6('c_fe')} AS flesch_ease,
  {", ".join(f"{r6('c_' + k)} AS {v}" for k, v in _NAMES.items())},
  {r6('mean')} AS consensus, {r6('list_max(known) - list_min(known)')} AS grade_spread, CAST(n_known AS BIGINT) AS grades, {BAND} AS band,
  CASE WHEN words < 100 OR sentences < 3 THEN 'insufficient_sample' WHEN words < 300 THEN 'limited_sample' ELSE 'sufficient' END AS sample_status,
  array_to_string(list_filter([{", ".join(f"CASE WHEN {k} > 25.0 OR {k} < 0.0 THEN '{v}' END" for k, v in _NAMES.items())}], lambda n: n IS NOT NULL), ',') AS clamped,
  CASE WHEN mean IS NULL THEN NULL WHEN mean <= 1 THEN 'very easy' WHEN mean <= 3 THEN 'easy' WHEN mean <= 6 THEN 'fairly easy' WHEN mean <= 8 THEN 'plain' WHEN mean <= 10 THEN 'fairly difficult' WHEN mean <= 12 THEN 'difficult' WHEN mean <= 16 THEN 'undergraduate' ELSE 'graduate' END AS grade_text,
  CASE WHEN c_fe IS NULL THEN NULL WHEN {r6('c_fe')} >= 90 THEN 'very easy' WHEN {r6('c_fe')} >= 80 THEN 'easy' WHEN {r6('c_fe')} >= 70 THEN 'fairly easy' WHEN {r6('c_fe')} >= 60 THEN 'standard' WHEN {r6('c_fe')} >= 50 THEN 'fairly difficult' WHEN {r6('c_fe')} >= 30 THEN 'difficult' WHEN {r6('c_fe')} >= 0 THEN 'very difficult' ELSE 'out of range' END AS ease_text
FROM scored
"""

BY_BAND = f"""
WITH {COUNTS}, {SCORES}
SELECT lang, {BAND} AS band, count(*) AS documents, CAST(sum(words) AS BIGINT) AS words, CAST(sum(sentences) AS BIGINT) AS sentences,
  {r6('CAST(sum(CAST(floor(mean * 1e6 + 0.5) AS BIGINT)) AS DOUBLE) / 1e6 / count(mean)')} AS mean_grade
FROM scored GROUP BY 1, 2
"""

WORD_MEASURES = f"""
SELECT doc_id, CAST(len({WORDS}) AS BIGINT) AS n_words, CAST(len({STYLE_WORDS}) AS BIGINT) AS n_style_words,
  CAST(len(list_distinct({STYLE_WORDS})) AS BIGINT) AS n_distinct, CAST(len({SENTENCES}) AS BIGINT) AS n_sentences,
  sha256(text) AS text_sha256,
  CASE WHEN length(trim(regexp_replace(text, '[\\s\\x0b]+', ' ', 'g'))) <= 72 THEN trim(regexp_replace(text, '[\\s\\x0b]+', ' ', 'g')) ELSE substr(trim(regexp_replace(text, '[\\s\\x0b]+', ' ', 'g')), 1, 71) || '…' END AS excerpt,
  CAST(length(substr(text, 1, 100)) - length(replace(substr(text, 1, 100), chr(10), '')) + 1 AS BIGINT) AS line_of_100
FROM documents
"""

SYLLABLES = f"""
SELECT w AS word, CAST(count(*) AS BIGINT) AS n, CAST(({syllables('w')}) AS BIGINT) AS syllables
FROM (SELECT unnest({WORDS}) AS w FROM documents) GROUP BY w
"""

TABLE = {"readability": READABILITY, "readability_by_band": BY_BAND, "word_measures": WORD_MEASURES, "syllables": SYLLABLES}
