import re

import pytest
from pyspark.sql import functions as F

from prosemill.functions import markdown, segment
from prosemill.functions import text as T


def one(spark, column, **values):
    names = list(values)
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} string" for n in names)).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("word", "n"),
    [("", 0), ("a", 1), ("of", 1), ("table", 2), ("tables", 3), ("little", 2), ("see", 1), ("free", 1), ("hope", 1), ("wanted", 2), ("needed", 2), ("jumped", 1), ("rhythm", 1), ("readability", 5), ("shh", 1)],
)
def test_syllables(spark, word, n):
    assert one(spark, T.syllables(F.col("w")), w=word) == n


def test_words(spark):
    text = "Don’t stop: well-known X2 naïve"
    assert one(spark, T.words(F.col("t")), t=text) == ["don", "t", "stop", "well", "known", "x", "na", "ve"]
    assert one(spark, T.style_words(F.col("t")), t=text) == ["don't", "stop", "well-known", "x", "na", "ve"]
    assert one(spark, T.without(T.style_words(F.col("t")), ["stop"]), t="Stop it stop")[0] == "it"


def test_simple_sentences(spark):
    assert one(spark, T.simple_sentences(F.col("t")), t="One. Two! three? Four\n. 5 is.  ") == ["One.", "Two! three?", "Four\n.", "5 is."]
    assert one(spark, T.simple_sentences(F.col("t")), t="") == []


def test_small_functions(spark):
    assert one(spark, T.excerpt(F.col("t"), 10), t="  a  bcd\nefghijkl") == "a bcd efg…"
    assert one(spark, T.line_number(F.col("t"), F.lit(4)), t="a\nb\nc") == 3
    assert one(spark, T.paragraphs(F.col("t")), t="a\nb\n\n \nc\n") == ["a\nb", "c"]
    assert one(spark, T.ngrams(T.words(F.col("t")), 2), t="a b c") == ["a b", "b c"]
    s = one(spark, T.spread(F.transform(T.words(F.col("t")), lambda w: F.length(w))), t="a bb ccc dddd")
    assert (s.mean, s.median, s.low, s.high, round(s.deviation, 6), round(s.variation, 6)) == (2.5, 2.5, 1, 4, 1.118034, 0.447214)


SENTENCES = [
    ("We met Mr. Smith. He left.", ["We met mr. Smith.", "He left."]),
    ("It costs 3.14 now. Pay it.", ["It costs 3.14 now.", "Pay it."]),
    ("See https://a.b/c. Then go.", ["See https://a.b/c. Then go."]),
    ("Well... Maybe. J. K. Rowling wrote.", ["Well... Maybe.", "J. K. Rowling wrote."]),
    ("Come in. Sit down.", ["Come in. Sit down."]),
    ("Title Line\nthis goes on\nand ends.", ["Title Line", "this goes on and ends."]),
    ("First block.\n\nSecond block. Third.", ["First block.", "Second block.", "Third."]),
    ("", []),
    ("   ", []),
    ("no end", ["no end"]),
]


@pytest.mark.parametrize(("text", "want"), SENTENCES)
def test_full_sentences(text, want):
    assert segment.split(text) == want


def test_full_sentences_of_a_table(spark):
    rows = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(SENTENCES)] + [(99, None)], "doc_id long, text string")
    got = sorted((r.doc_id, r.sentence, r.text) for r in segment.sentences(rows).collect())
    assert got == sorted((k, i, s) for k, (_, want) in enumerate(SENTENCES) for i, s in enumerate(want))


def test_paragraph_ranges():
    text = " a b \n \n\n c\nd \n"
    assert [text[i:j] for i, j in segment.paragraph_ranges(text)] == ["a b", "c\nd"]


def test_markdown_blocks():
    source = "# Head *one*\n\nText with [a link](http://x) and `code`.\nMore.\n\n- item one\n- item two\n\n> quoted\n> text\n\n```py\nx = 1\n```\n\na | b\n--|--\n1 | 2\n\nTitle\n===\n\n---\n"
    found = markdown.blocks(source)
    assert [(b["kind"], b["level"]) for b in found] == [("heading", 1), ("paragraph", None), ("list_item", None), ("list_item", None), ("quote", None), ("code", None), ("table", None), ("heading", 1), ("rule", None)]
    assert found[0]["text"] == "Head one" and found[1]["text"] == "Text with a link and . More." and found[4]["text"] == "quoted text"
    assert source[found[5]["start"] : found[5]["end"]] == "```py\nx = 1\n```"
    assert all(a["end"] <= b["start"] for a, b in zip(found, found[1:], strict=False))
    assert re.match(r"# Head", source[found[0]["start"] :])


def test_projection(spark):
    docs = spark.createDataFrame([(1, "# H\n\nText.\n\n```\ncode\n```\n\n- x"), (2, None)], "doc_id long, text string")
    assert [(r.doc_id, r.text) for r in markdown.projection(markdown.document_blocks(docs)).collect()] == [(1, "H\n\nText.\n\nx")]


def test_tidied():
    from prosemill.operators.edits import tidied

    assert tidied("a apple and an car. An hour, a unit? yes.") == "An apple and a car. An hour, a unit? Yes."


def test_places_of_sentences(spark):
    from prosemill.operators import barriers

    text = "It was written.  Then it was written again! İt was written."
    docs = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    got = {r.sentence: text[r["from"] : r.to] for r in barriers.sentence_places(docs).collect()}
    assert got == {0: "It was written.", 1: "Then it was written again! İt was written."}
    found = barriers.place_in_source(barriers.deduplicate(barriers.detect(barriers.sentence_rows(docs))), docs).collect()
    assert {(r.sentence, r.status, text[r.start : r.end] if r.start is not None else None) for r in found if r.type == "passive_voice"} == {(0, "placed", "was written"), (1, "ambiguous", None)}
