"""Line-first quality rules, built from SQL functions only.

Every line is judged by itself: punctuation, navigation, boilerplate and repetition.  Failed lines are removed, and a
document that loses too large a share of its words is rejected, as is one that fails the base measures (too few words,
or too many of them in repeated 5-word windows).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import own_columns

SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
#: Phrases of a page's furniture, in English, German, French and Spanish; a short line that holds one is no prose.
BOILERPLATE = [
    "all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie policy", "use cookies", "accept cookies", "enable javascript", "lorem ipsum", "click here", "sign in", "log in", "subscribe to our", "is licensed under", "skip to content",
    "alle rechte vorbehalten", "nutzungsbedingungen", "datenschutzerklärung", "cookie-richtlinie", "verwendet cookies", "cookies akzeptieren", "javascript aktivieren", "hier klicken", "jetzt anmelden", "newsletter abonnieren", "lizenziert unter", "zum inhalt springen",
    "tous droits réservés", "conditions d'utilisation", "politique de confidentialité", "utilise des cookies", "accepter les cookies", "activer javascript", "cliquez ici", "se connecter", "abonnez-vous à notre", "sous licence", "aller au contenu",
    "todos los derechos reservados", "condiciones de uso", "política de privacidad", "utiliza cookies", "aceptar cookies", "activar javascript", "haga clic aquí", "iniciar sesión", "suscríbete a nuestro", "bajo licencia", "saltar al contenido",
]
WINDOW, MIN_WORDS, MAX_REPEAT_PCT, MAX_LOST_PCT = 5, 10, 20, 50
_LINE_RULES = dict(symbols_per_word=0.3, shouts_per_word=0.3, separators=3, boilerplate_words=30, unpunctuated_words=12, repeat_words=8, repeat_factor=3)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` computed once: a name bound inside a lambda isn't copied by the optimizer."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """Runs of anything but ASCII white space."""
    return F.filter(F.split(F.translate(text, SPACES[1:], " " * (len(SPACES) - 1)), " ", -1), lambda w: w != "")


def _count(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def repeat_words(words: Column, window: int = WINDOW) -> Column:
    """Number of words that lie in a window of ``window`` words found at least twice, the first one included.

    Windows are compared by XXH64 over the XXH64 of their words, within one text.
    """

    def spread(grams: Column) -> Column:
        placed = F.array_sort(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
        twice = let(placed, lambda p: F.filter(p, lambda x, k: (F.coalesce(F.get(p, k - 1)["g"] == x["g"], F.lit(False)) & (k > 0)) | F.coalesce(F.get(p, k + 1)["g"] == x["g"], F.lit(False))))
        starts = F.array_sort(F.transform(twice, lambda x: x["i"]))
        return let(starts, lambda s: F.aggregate(F.transform(s, lambda x, k: F.least(F.lit(window), F.coalesce(F.get(s, k + 1) - x, F.lit(window)))), F.lit(0), lambda a, b: a + b))

    def count(hashes: Column) -> Column:
        n = F.size(hashes) - window + 1
        grams = F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(window)]))
        return F.when(n < 2, F.lit(0)).otherwise(let(grams, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(spread(g))))

    return let(F.transform(words, lambda w: F.xxhash64(w)), count)


def line_fails(line: Column, words: Column, symbols_per_word: float, shouts_per_word: float, separators: int, boilerplate_words: int, unpunctuated_words: int, repeat_words: int, repeat_factor: int) -> Column:
    """Whether one line, given with its words, is furniture or noise."""
    n = F.size(words)
    noise = (_count(line, SYMBOLS) >= symbols_per_word * n) & (n > 0)
    shouting = (F.size(F.split(line, "!!", -1)) - 1 >= shouts_per_word * n) & (n > 2)
    marks = _count(line, "|»›")
    navigation = (marks >= separators) & (4 * marks >= n)
    low = F.lower(line)
    furniture = low.rlike("|".join(p.replace(".", r"\.") for p in BOILERPLATE)) & (n <= boilerplate_words)
    unpunctuated = (n >= unpunctuated_words) & ~line.rlike(r"[.,;:!?…。、]")
    repeated = (n >= repeat_words) & (repeat_factor * F.size(F.array_distinct(words)) <= n)
    return noise | shouting | navigation | furniture | unpunctuated | repeated


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_lost_pct: int = MAX_LOST_PCT, **rules: float) -> DataFrame:
    """Measure and clean every document.

    Returns doc_id, the base measures n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words, base_failed,
    n_kept_words and cleaned_text (what the line rules leave, lines joined by a newline) and kept.  A null or empty
    text has no words, so it fails the base measures.  Every row is judged by itself: repeated rows and ids, nulls in
    other columns and further columns don't matter, and an empty table gives an empty result.
    """
    limits = _LINE_RULES | rules
    rows = own_columns(docs, doc_id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    judged = F.transform(F.split("text", "\n", -1), lambda line: let(words_of(line), lambda w: F.struct(line.alias("line"), F.size(w).alias("n"), line_fails(line, w, **limits).alias("fails"))))
    lines = rows.withColumn("lines", judged).withColumn("repeats", repeat_words(words_of(F.col("text"))))
    total = lambda ls: F.aggregate(ls, F.lit(0), lambda a, x: a + x["n"])
    full = let(F.transform(F.filter("lines", lambda x: x["n"] > 0), lambda x: x["line"]), lambda x: F.size(x) - F.size(F.array_distinct(x)))
    measured = lines.select(
        "doc_id",
        total(F.col("lines")).cast("long").alias("n_words"),
        F.length(F.translate("text", SPACES, "")).cast("long").alias("word_chars"),
        _count(F.col("text"), SYMBOLS).cast("long").alias("n_symbols"),
        full.cast("long").alias("n_dup_lines"),
        F.col("repeats").cast("long").alias("n_repeat_words"),
        total(F.filter("lines", lambda x: ~x["fails"])).cast("long").alias("n_kept_words"),
        F.array_join(F.transform(F.filter("lines", lambda x: ~x["fails"]), lambda x: x["line"]), "\n").alias("cleaned_text"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PCT * F.col("n_words"))
    return measured.withColumn("base_failed", failed).withColumn("kept", ~failed & (100 * (F.col("n_words") - F.col("n_kept_words")) <= max_lost_pct * F.col("n_words")))


COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_kept_words"]

_PHRASES = "|".join(BOILERPLATE).replace("'", "''")
ORACLE = f"""
WITH lines AS (
  SELECT doc_id, coalesce(text, '') AS text, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents
), judged AS (
  SELECT doc_id, line, w, len(w) AS n,
    length(line) - length(regexp_replace(line, '[#*$%&|<>]', '', 'g')) AS sym,
    length(line) - length(regexp_replace(line, '[|»›]', '', 'g')) AS marks,
    len(string_split(line, '!!')) - 1 AS shouts
  FROM (SELECT doc_id, line, regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+') AS w FROM lines)
), line_sums AS (
  SELECT doc_id, sum(n) AS n_words,
    count(*) FILTER (WHERE n > 0) - count(DISTINCT line) FILTER (WHERE n > 0) AS n_dup_lines,
    sum(CASE WHEN (sym >= 0.3 * n AND n > 0) OR (shouts >= 0.3 * n AND n > 2) OR (marks >= 3 AND 4 * marks >= n)
      OR (regexp_matches(lower(line), '{_PHRASES}') AND n <= 30)
      OR (n >= 12 AND NOT regexp_matches(line, '[.,;:!?…。、]'))
      OR (n >= 8 AND 3 * len(list_distinct(w)) <= n) THEN 0 ELSE n END) AS n_kept_words
  FROM judged GROUP BY doc_id
), words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), grams AS (
  SELECT doc_id, unnest(range(1, greatest(len(w) - 3, 1))) AS i, w FROM words
), named AS (
  SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS g FROM grams
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM named) WHERE c > 1
), reps AS (
  SELECT doc_id, sum(least(5, coalesce(nxt - i, 5))) AS n_repeat_words
  FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM twice) GROUP BY doc_id
), base AS (
  SELECT d.doc_id, CAST(l.n_words AS BIGINT) AS n_words,
    CAST(length(regexp_replace(coalesce(d.text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(coalesce(d.text, '')) - length(regexp_replace(coalesce(d.text, ''), '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(l.n_dup_lines AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
    CAST(l.n_kept_words AS BIGINT) AS n_kept_words
  FROM documents d JOIN line_sums l USING (doc_id) LEFT JOIN reps r USING (doc_id)
), failed AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM base
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND 100 * (n_words - n_kept_words) <= 50 * n_words AS kept, n_kept_words
FROM failed
"""
