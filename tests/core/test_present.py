import json

from pyspark.sql import functions as F

from prosemill.operators import edits, lexicon, observe, present, readability, style
from prosemill.sources import reports

TEXT = " ".join(["Nevertheless, it was paid."] * 8 + ["However, it came late."] * 2)


def test_review_of_style_proposals(spark):
    docs = spark.createDataFrame([(1, TEXT), (2, "Nothing here to see."), (3, None)], "doc_id long, text string")
    proposals = present.style_proposals(docs, "plain")
    rows = sorted(proposals.collect(), key=lambda r: r.start)
    assert {r.doc_id for r in rows} == {1} and len(rows) == rows[0].budget == 2
    assert rows[-1].start == TEXT.rindex("Nevertheless") and all(r.proposal_id.startswith("SP-") and len(r.proposal_id) == 19 for r in rows)
    yes = spark.createDataFrame([(1, r.proposal_id, True) for r in rows], "doc_id long, proposal_id string, approve boolean")
    done = {r.doc_id: r for r in present.apply_approved(docs, proposals, present.decide(proposals, yes)).collect()}
    assert done[1].after.count("Even so, it was paid.") == 2 and done[1].status == "applied" and done[2].status == "unchanged"
    bad = yes.union(spark.createDataFrame([(1, "SP-unknown", True)], yes.schema))
    decided = present.decide(proposals, bad).collect()
    assert not any(r.approved for r in decided) and {r.error for r in decided} == {None, "unknown proposal"}


def test_present_and_diagnose(spark):
    docs = spark.createDataFrame([(1, "We utilise it prior to use. " + TEXT), (2, "")], "doc_id long, text string")
    got = {r.doc_id: r for r in present.present(docs, "natural").collect()}
    assert got[1].text.startswith("We use it before use.") and got[1].n_edits == 2 and got[1].status == "applied"
    assert {f.diagnostic for f in got[1].findings} >= {"REPEATED_TRANSITION", "TRANSITION_DENSITY"}
    assert set(got[1].identities) == {"engine", "facts", "rules", "profiles"} and got[2].status == "unchanged"
    assert "text" not in present.diagnose(docs, "natural").columns


def test_the_guard_withdraws_what_raises_a_band():
    """A rule that makes every sentence open alike is withdrawn; a later one is tried without it."""
    rules_ = [edits.Rule("a", {"Then": "So"}), edits.Rule("b", {"prior to": "before"})]
    text = " ".join(["Then one waits prior to it.", "So two wait.", "Then three rest.", "So four go now.", "Five stay here.", "Six leave.", "Seven come.", "Eight sing."])
    find = edits.Matcher(rules_)
    accepted = [p for p in edits.planned(text, find) if p.decision == "accepted"]
    measure = lambda t: [f for f in observe.of_sentences(t) if f["diagnostic"] == "REPEATED_SENTENCE_OPENER"]
    assert present.admitted(text, accepted, measure, observe.limits("baseline")) == (["b"], ["a"])
    assert present.admitted(text, [p for p in accepted if p.rule_id == "b"], measure, observe.limits("baseline")) == (["b"], [])


def test_budgets():
    assert present.budget(["a"] * 6 + ["b"] * 4, "a", "c", 0.6) == 1
    assert present.budget(["a"] * 6 + ["b"] * 4, "a", "b", 0.55) == 1
    assert present.budget(["a"], "a", "b", 0.5) == 0
    assert present.density_budget(5, 10, 5, 0.4) == 2 and present.density_budget(5, 10, 1, 0.4) == 0


def test_all_thirteen_diagnostics():
    paragraph = "Every team reviews plans, budgets and schedules for another quarter because several partners asked early for answers about delivery dates, prices and costs while auditors waited patiently outside for signed copies."
    others = ["They went home late.", "Nobody, it seems, had asked."]
    text = "\n\n".join("It is important to note the plan. " + p for p in [paragraph, *others, paragraph]) + " However, so it goes. However, not only this but also that. Not only here but also there. A robust, robust and robust plan."
    found = {f["diagnostic"]: f for f in present.document_findings(text, observe.simple_split)}
    md = {f["diagnostic"] for f in present.document_findings("- one\n- two\n\nText.", observe.simple_split, as_markdown=True)}
    assert set(found) | md == set(observe.V.DIAGNOSTICS)
    assert all(f["evidence"] for f in found.values()) and all(len(f["evidence"]) <= 10 for f in found.values())
    assert found["LEXICAL_OVERLAP"]["value"] > 0.4 and found["REPEATED_TRANSITION"]["label"] == "however"


def test_stems_and_glossary(spark):
    words = spark.createDataFrame([(w,) for w in ("running", "carries", "agreement", "cats", "business", "is", "demonstrated", "implementations")], "word string")
    got = {r.word: r.s for r in words.select("word", lexicon.stem(F.col("word"), ["demonstrate"]).alias("s")).collect()}
    assert got == {"running": "run", "carries": "carry", "agreement": "agree", "cats": "cat", "business": "business", "is": "is", "demonstrated": "demonstrate", "implementations": "implement"}
    table = lambda rows, ddl: spark.createDataFrame(rows, ddl)
    glossary = lexicon.effective_glossary(table([("cat", "pet"), ("run", "go"), ("old", "x")], "word string, plain string"), table([("old",)], "word string"), table([("run", "move")], "word string, plain string"))
    assert {r.word: r.plain for r in glossary.collect()} == {"cat": "pet", "run": "move"}
    found = lexicon.plain_words(words, glossary, table([("cats", "legal")], "word string, domain string")).collect()
    assert {(r.word, r.plain, r.domain) for r in found} == {("running", "move", None), ("cats", None, "legal")}


def test_reports(spark):
    scored = readability.readability(spark.createDataFrame([(1, "A <b> is here. So it goes on."), (2, "")], "doc_id long, text string"))
    got = {r.doc_id: json.loads(r.report) for r in reports.json_reports(scored).collect()}
    assert got[1]["preview"].startswith("A <b>") and got[1]["scores"]["words"] == 8
    assert "&lt;b&gt;" in {r.doc_id: r.html for r in reports.html_reports(scored).collect()}[1]
    assert {r.doc_id: r.line for r in reports.console(scored).collect()}[2].startswith("2  -")
    audit = reports.canonical_audit(scored.select("doc_id", "words", "band"), "doc_id").where("doc_id = 2").first().audit
    assert audit == '{"band":null,"doc_id":2,"words":0}\n'


def test_metrics_of_blank_documents(spark):
    docs = spark.createDataFrame([(1, None), (2, " ")], "doc_id long, text string")
    for r in style.document_metrics(docs).collect():
        assert r.word_count == r.sentence_count == 0 and r.sentence_words_mean is None and r.content_word_diversity == 0
    assert style.sentence_diagnostics(docs).count() == 0
