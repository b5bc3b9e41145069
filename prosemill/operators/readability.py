"""Readability formulas over whole documents, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

MAX_GRADE, MIN_WORDS, MIN_SENTENCES, LIMITED_WORDS = 25.0, 100, 3, 300
BANDS = [(3, "Very Easy"), (6, "Easy"), (8, "Fairly Easy"), (10, "Standard"), (12, "Fairly Difficult"), (16, "Difficult")]
GRADES = ["flesch_kincaid", "gunning_fog", "smog", "ari", "coleman_liau"]


def counts(docs: DataFrame, text: str = "text", sentences: Column | None = None) -> DataFrame:
    """Add word, sentence, syllable, complex, long and character counts.

    ``sentences`` is a column with the number of sentences; by default the simple split is counted.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    out = docs.withColumn("__w", F.transform(T.words(whole), lambda w: F.struct(F.length(w).alias("n"), T.syllables(w).alias("s"))))
    number = lambda keep: F.size(F.filter("__w", keep)).cast("long")
    return out.select(
        *docs.columns,
        F.size("__w").cast("long").alias("words"),
        (F.size(T.simple_sentences(whole)).cast("long") if sentences is None else sentences).alias("sentences"),
        T.total(F.transform("__w", lambda w: w["s"])).alias("syllables"),
        number(lambda w: w["s"] >= 3).alias("complex_words"),
        number(lambda w: w["n"] >= 7).alias("long_words"),
        T.total(F.transform("__w", lambda w: w["n"])).alias("characters"),
    )


def _clamp(x: Column, low: float, high: float) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def raw_grades() -> dict[str, Column]:
    """The grade formulas before clamping, null without words."""
    w, s = F.col("words"), F.col("sentences")
    wps, spw, cpw = T.ratio(w, s), T.ratio(F.col("syllables"), w), T.ratio(F.col("characters"), w)
    complex_ = F.col("complex_words")
    return {
        "flesch_kincaid": 0.39 * wps + 11.8 * spw - 15.59,
        "gunning_fog": 0.4 * (wps + 100.0 * T.ratio(complex_, w)),
        "smog": F.when((w > 0) & (s > 0), F.when(complex_ > 0, 1.0430 * F.sqrt(complex_ * 30.0 / s) + 3.1291).otherwise(F.lit(3.1291))),
        "ari": 4.71 * cpw + 0.5 * wps - 21.43,
        "coleman_liau": F.when(w >= MIN_WORDS, 0.0588 * (F.col("characters") * 100.0 / w) - 0.296 * (s * 100.0 / w) - 15.8),
    }


def band(grade: Column) -> Column:
    out = F.when(grade.isNull(), F.lit(None))
    for most, name in BANDS:
        out = out.when(grade <= most, F.lit(name))
    return out.otherwise("Very Difficult")


def sample_status(words: Column, sentences: Column) -> Column:
    return F.when((words < MIN_WORDS) | (sentences < MIN_SENTENCES), "insufficient_sample").when(words < LIMITED_WORDS, "limited_sample").otherwise("sufficient")


def describe_grade(grade: Column) -> Column:
    steps = [(1, "very easy"), (3, "easy"), (6, "fairly easy"), (8, "plain"), (10, "fairly difficult"), (12, "difficult"), (16, "undergraduate")]
    out = F.when(grade.isNull(), F.lit(None))
    for most, name in steps:
        out = out.when(grade <= most, name)
    return out.otherwise("graduate")


def describe_ease(score: Column) -> Column:
    steps = [(90, "very easy"), (80, "easy"), (70, "fairly easy"), (60, "standard"), (50, "fairly difficult"), (30, "difficult"), (0, "very difficult")]
    out = F.when(score.isNull(), F.lit(None))
    for least, name in steps:
        out = out.when(score >= least, name)
    return out.otherwise("out of range")


def scores(counted: DataFrame) -> DataFrame:
    """Add averages, formulas, consensus, band, sample status and warnings to counted documents.

    A document without words has null scores and a null band.
    """
    w, s = F.col("words"), F.col("sentences")
    raw = raw_grades()
    clamped = {name: _clamp(x, 0.0, MAX_GRADE) for name, x in raw.items()}
    out = counted.select(
        "*",
        T.round6(T.ratio(w, s)).alias("words_per_sentence"),
        T.round6(T.ratio(F.col("syllables"), w)).alias("syllables_per_word"),
        T.round6(_clamp(206.835 - 1.015 * T.ratio(w, s) - 84.6 * T.ratio(F.col("syllables"), w), 0.0, 100.0)).alias("flesch_ease"),
        *[x.alias(f"__{name}") for name, x in clamped.items()],
        F.filter(F.array(*[F.when((x > MAX_GRADE) | (x < 0.0), F.lit(name)) for name, x in raw.items()]), lambda n: n.isNotNull()).alias("clamped"),
    )
    known = F.filter(F.array(*[F.col(f"__{g}") for g in GRADES]), lambda g: g.isNotNull())
    out = out.withColumn("__known", known).withColumn("grades", F.size("__known").cast("long"))
    mean = F.when(F.col("grades") > 0, F.aggregate("__known", F.lit(0.0), lambda a, g: a + g) / F.col("grades"))
    out = out.withColumn("__mean", mean)
    return out.select(
        *counted.columns,
        "words_per_sentence",
        "syllables_per_word",
        "flesch_ease",
        *[T.round6(F.col(f"__{g}")).alias(g) for g in GRADES],
        T.round6(F.col("__mean")).alias("consensus"),
        T.round6(F.array_max("__known") - F.array_min("__known")).alias("grade_spread"),
        "grades",
        band(F.col("__mean")).alias("band"),
        sample_status(w, s).alias("sample_status"),
        F.array_join("clamped", ",").alias("clamped"),
        describe_grade(F.col("__mean")).alias("grade_text"),
        describe_ease(F.col("flesch_ease")).alias("ease_text"),
    )


def readability(docs: DataFrame, text: str = "text") -> DataFrame:
    return scores(counts(docs, text))
