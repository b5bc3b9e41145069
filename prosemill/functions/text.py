"""Column expressions over text: words, syllables, sentences, hashes, excerpts.

Everything here stays in the JVM.  A value that several parts of an expression need is bound by ``let``, because the
optimizer would copy it into every lambda that mentions it.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

VOWELS = "aeiouy"
_BREAK = "\x01"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)


def round6(x: Column) -> Column:
    """Six decimals, halves up; the same arithmetic on any engine."""
    return F.floor(x * 1e6 + 0.5).cast("double") / 1e6


def ratio(a: Column, b: Column) -> Column:
    """a / b as double, null where b is zero."""
    return F.when(b != 0, a.cast("double") / b)


def words(text: Column) -> Column:
    """Lower-case alphabetic runs, the unit of readability and barriers."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-zA-Z]+"), F.lit(0))


def style_words(text: Column) -> Column:
    """Words with inner apostrophes and hyphens, lower-cased, curly apostrophes straightened: the unit of style."""
    found = F.regexp_extract_all(text, F.lit("[A-Za-z]+(?:['’\\-][A-Za-z]+)*"), F.lit(0))
    return F.transform(found, lambda w: F.translate(F.lower(w), "’", "'"))


def protection_words(text: Column) -> Column:
    """Runs of letters, apostrophes and hyphens: what the register of protected words is asked about."""
    return F.regexp_extract_all(text, F.lit(r"[\p{L}'\-]+"), F.lit(0))


def without(items: Column, stop: Iterable[str]) -> Column:
    """Items outside a short list, repeats kept."""
    return F.filter(items, lambda w: ~w.isin(list(stop)))


def syllables(word: Column) -> Column:
    """Syllables of a lower-case word by the shape of its vowels; 0 if it is empty."""
    n = F.length(word)
    letter = lambda back: F.substring(word, -back, 1)
    vowel = lambda c: F.instr(F.lit(VOWELS), c) > 0
    ends = lambda s: F.endswith(word, F.lit(s))
    le = (ends("le") & (n > 2) & ~vowel(letter(3))) | (ends("les") & (n > 3) & ~vowel(letter(4)))
    silent = ends("e") & (n > 3) & ~vowel(letter(2))
    groups = F.regexp_count(word, F.lit("[aeiouy]+")) - silent.cast("int") + le.cast("int")
    past = ends("ed") & (n > 3) & ~letter(3).isin("d", "t")
    return F.when(n == 0, F.lit(0)).when(n <= 2, F.lit(1)).otherwise(F.greatest(F.lit(1), F.when(past, F.greatest(F.lit(1), groups - 1)).otherwise(groups)))


def simple_sentences(text: Column) -> Column:
    """Split after . ! or ? where white space and a capital or digit follow; blank parts are dropped.

    The last phase of sentence splitting alone; ``segment.sentences`` also knows abbreviations, addresses and lists.
    """
    marked = F.regexp_replace(text, r"([.!?])[ \t\n\r]+([A-Z0-9])", f"$1{_BREAK}$2")
    return F.filter(F.transform(F.split(marked, _BREAK, -1), lambda s: F.trim(s, F.lit(" \t\n\r"))), lambda s: s != "")


def paragraphs(text: Column) -> Column:
    """Blocks between blank lines, trimmed, empty ones dropped."""
    return F.filter(F.transform(F.split(text, r"\n[ \t\r\f]*\n\s*", -1), lambda p: F.trim(p, F.lit(" \t\n\r\f"))), lambda p: p != "")


def occurrences(text: Column, needle: str) -> Column:
    """Non-overlapping occurrences of a character."""
    return F.length(text) - F.length(F.translate(text, needle, ""))


def any_of(phrases: Iterable[str]) -> str:
    """A case-blind pattern for whole phrases, longest first."""
    return r"(?i)\b(?:" + "|".join(re.escape(p) for p in sorted(phrases, key=len, reverse=True)) + r")\b"


def matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def sha256(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def excerpt(text: Column, n: int = 72) -> Column:
    """White space collapsed, cut with an ellipsis to ``n`` characters."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) <= n, flat).otherwise(F.concat(F.substring(flat, 1, n - 1), F.lit("…")))


def line_number(text: Column, offset: Column) -> Column:
    """1-based line of a code point offset."""
    return occurrences(F.substring(text, F.lit(1), offset), "\n") + 1


def spread(lengths: Column) -> Column:
    """struct(n, mean, median, low, high, deviation, variation) of an array of counts; population deviation.

    Sums stay whole numbers until the last step.  Fewer than two values, or only zeros, have no dispersion.
    """

    def of(xs: Column) -> Column:
        n, s = F.size(xs), total(xs)
        squares = F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x.cast("long") * x)
        deviation = F.when((n >= 2) & (s > 0), F.sqrt((n * squares - s * s).cast("double")) / n).otherwise(F.lit(0.0))
        middle = let(F.array_sort(xs), lambda o: (F.get(o, F.floor((n - 1) / 2).cast("int")) + F.get(o, F.floor(n / 2).cast("int"))).cast("double") / 2)
        return F.struct(n.alias("n"), ratio(s, n).alias("mean"), middle.alias("median"), F.array_min(xs).alias("low"), F.array_max(xs).alias("high"), deviation.alias("deviation"), F.when((n >= 2) & (s > 0), deviation / (s.cast("double") / n)).otherwise(F.lit(0.0)).alias("variation"))

    return let(lengths, of)


def ngrams(items: Column, n: int) -> Column:
    """Runs of n items joined by a space."""
    return let(items, lambda xs: F.when(F.size(xs) >= n, F.transform(F.sequence(F.lit(1), F.size(xs) - (n - 1)), lambda i: F.array_join(F.slice(xs, i, n), " "))).otherwise(F.array().cast("array<string>")))
