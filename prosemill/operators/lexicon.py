"""Looking words up: stems, plain words, terms of art and the reviewed overlay of a glossary.

Tables are DataFrames given by the caller; they are joined by key, and Spark broadcasts the small ones itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Suffixes in the order in which they are tried, and words that are never stemmed.
SUFFIXES = (
    "alization alisation izations isations ization isation fulness fulnesses abilities ability alities ality iveness nesses "
    "ational ations ments ment tions sions ation tion sion ances ences ance ence ables able ibles ible ings ingly edly ied ies "
    "ing ed ers ors er or est ly ify ise ize al s"
).split()
KEPT = (
    "is was has had does goes says said us yes this thus plus minus versus its his hers ours yours theirs always perhaps "
    "sometimes nowadays analysis basis crisis thesis emphasis series species news lens atlas canvas surplus process progress "
    "success access excess across address assess discuss express miss kiss boss loss toss cross class glass grass mass pass "
    "press dress stress less unless nevertheless nonetheless business witness fairness darkness happiness sadness enhance "
    "advance finance balance distance instance substance resistance assistance insurance performance maintenance significance "
    "experience science conscience audience convenience obedience several moral legal royal loyal rural size rise wise phase "
    "phrase cause because please release disease increase decrease purpose suppose oppose expose impose compose propose refuse "
    "confuse accuse excuse office notice practice service justice surface replace displace debate relate create estate update "
    "donate"
).split()
_DOUBLED, _RESTORED = ("ing", "ed", "er", "est"), ("ed", "ing")


def stem(word: Column, known: list[str] | None = None) -> Column:
    """A lower-case word without its first listed suffix that leaves three letters.

    A doubled consonant before -ing, -ed, -er and -est is halved, -ies and -ied give -y, and an e is put back after -ed
    and -ing where that gives a word of ``known``.
    """
    out = word
    for suffix in reversed(SUFFIXES):
        base = F.substring(word, F.lit(1), F.length(word) - len(suffix))
        if suffix in _DOUBLED:
            last, before = F.substring(base, -1, 1), F.substring(base, -2, 1)
            base = F.when((last == before) & (F.instr(F.lit("aeiouy"), last) == 0), F.substring(base, F.lit(1), F.length(base) - 1)).otherwise(base)
        if suffix in ("ies", "ied"):
            base = F.concat(base, F.lit("y"))
        if known and suffix in _RESTORED:
            base = F.when(F.concat(base, F.lit("e")).isin(known), F.concat(base, F.lit("e"))).otherwise(base)
        out = F.when(F.endswith(word, F.lit(suffix)) & (F.length(word) - len(suffix) >= 3), base).otherwise(out)
    return F.when((F.length(word) <= 3) | word.isin(KEPT), word).otherwise(out)


def effective_glossary(glossary: DataFrame, withdrawn: DataFrame, corrected: DataFrame) -> DataFrame:
    """(word, plain): entries that aren't withdrawn, corrections taking the place of what they correct."""
    kept = glossary.select("word", "plain").join(withdrawn.select("word"), "word", "left_anti")
    new = corrected.select("word", F.col("plain").alias("better"))
    return kept.join(new, "word", "left").select("word", F.coalesce("better", "plain").alias("plain"))


def plain_words(words: DataFrame, glossary: DataFrame, terms: DataFrame, known: list[str] | None = None) -> DataFrame:
    """(word, plain, domain): a term of art has a domain and no plain word; else the entry of the word, then of its stem."""
    each = words.select("word").distinct().withColumn("stem", stem(F.col("word"), known))
    direct = glossary.select("word", F.col("plain").alias("p1"))
    stemmed = glossary.select(F.col("word").alias("stem"), F.col("plain").alias("p2"))
    found = each.join(terms.select("word", "domain"), "word", "left").join(direct, "word", "left").join(stemmed, "stem", "left")
    return found.select("word", F.when(F.col("domain").isNull(), F.coalesce("p1", "p2")).alias("plain"), "domain").where("plain is not null or domain is not null")
