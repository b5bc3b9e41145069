import json

import pytest
from pyspark.sql import functions as F

from prosemill.functions import morphology
from prosemill.operators import barriers, edits, facts, rules, verify

FACTS = [
    ("Pay £1,000.50 by 2026-08-29.", [("currency", "GBP 1000.50"), ("date", "2026-08-29")]),
    ("See https://a.org/x?n=5, or mail a.b@c.org.", [("url", "https://a.org/x?n=5"), ("email", "a.b@c.org")]),
    ("Take 5mg or 5 mg, never 5 Mg.", [("measurement", "5 mg"), ("measurement", "5 mg"), ("negation", "NEG"), ("number", "5")]),
    ("It rose 3 per cent, then 3%.", [("percentage", "3%"), ("percentage", "3%")]),
    ("Version 1.2.3 and v2.0, but 1.2 is a number.", [("version", "1.2.3"), ("version", "v2.0"), ("number", "1.2")]),
    ("You must not, can't, and may.", [("modal", "must"), ("negation", "NEG"), ("negation", "NEG"), ("modal", "may")]),
    ("Prior to 4pm. Before 4 p.m.", [("comparator", "before"), ("time", "4pm"), ("comparator", "before"), ("time", "4 p.m")]),
    ("No later than 10 USD, +7 or -7", [("comparator", "no later than"), ("currency", "USD 10"), ("number", "7"), ("number", "-7")]),
    ("/etc/app/config.ini. C:\\x\\y", [("path", "/etc/app/config.ini"), ("path", "C:\\x\\y")]),
    ("CVE-2024-12345", [("cve", "cve-2024-12345")]),
    ("", []),
]


@pytest.mark.parametrize(("text", "want"), FACTS)
def test_extract(text, want):
    found = facts.extract(text)
    assert [(k, n) for _, _, k, _, n in found] == want
    assert all(text[a:b] == s for a, b, _, s, _ in found)


MUST_REFUSE = [("Pay $5.", "Pay £5."), ("Do not go.", "Do go."), ("You must go.", "You may go."), ("5 mg", "5 g"), ("before 3", "after 3"), ("a 3 b 3", "a 3 b")]
MUST_ALLOW = [("Pay prior to 3.", "Pay before 3."), ("It is not so.", "It is never so."), ("1,000 items", "1000 items"), ("5mg", "5 mg"), ("plain", "words")]


def test_firewall(spark):
    pairs = [(k, a, b) for k, (a, b) in enumerate(MUST_REFUSE + MUST_ALLOW)] + [(99, None, None)]
    got = {r.pair_id: r.passed for r in facts.check(spark.createDataFrame(pairs, "pair_id long, before string, after string")).collect()}
    assert got == {k: k >= len(MUST_REFUSE) for k, _, _ in pairs}
    v = {r.pair_id: r for r in facts.violations(spark.createDataFrame(pairs[:1], "pair_id long, before string, after string")).collect()}
    assert (v[0].kind, v[0].lost, v[0].introduced, v[0].detail) == ("currency", "USD 5", "GBP 5", "changed")


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("We utilise it prior to use.", [("lexical.utilise", "use"), ("clarity.prior-to", "before")]),
        ("UTILISE it. Utilised well. uTiLiSe", [("lexical.utilise", "USE"), ("lexical.utilised", "Used"), ("lexical.utilise", None)]),
        ("It is important to note that we go.", [("framing.it-is-important-to-note-that", "W")]),
        ("Also, it is important to note that we go.", [("framing.it-is-important-to-note-that", None)]),
        # "depicted" could become "showed" or "shown", so no rule says either.
    ("He alleviates, depicts and depicted.", [("lemma.alleviate", "reduces"), ("lemma.depict", "shows")]),
        ("nothing here", []),
    ],
)
def test_matches(text, want):
    got = edits.Matcher(edits.AUTOMATIC)(text)
    assert [(m[2], None if m[6] else m[5]) for m in got] == want


def proposals(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, start int, end int, rule_id string, priority int, replacement string")


def test_settle(spark):
    rows = [
        (1, 0, 5, "a", 1, "x"), (1, 5, 9, "b", 1, "y"),
        (2, 0, 5, "b", 1, "x"), (2, 0, 5, "a", 1, "x"),
        (3, 0, 5, "a", 1, "x"), (3, 3, 9, "b", 2, "y"),
        (4, 0, 9, "a", 1, "x"), (4, 2, 4, "b", 1, "y"), (4, 4, 6, "c", 1, "z"),
        (5, 0, 5, "a", 1, "x"), (5, 3, 9, "b", 1, "y"),
    ]
    got = {(r.doc_id, r.rule_id): r.decision for r in edits.settle(proposals(spark, rows)).collect()}
    assert got == {
        (1, "a"): "accepted", (1, "b"): "accepted", (2, "a"): "accepted", (2, "b"): "duplicate", (3, "a"): "superseded-by-priority", (3, "b"): "accepted",
        (4, "a"): "accepted", (4, "b"): "superseded-by-longer", (4, "c"): "superseded-by-longer", (5, "a"): "conflict", (5, "b"): "conflict",
    }


def test_apply(spark):
    docs = spark.createDataFrame([(1, "héllo world"), (2, "abc"), (3, None), (4, "abcdef")], "doc_id long, text string")
    accepted = proposals(spark, [(1, 0, 5, "r", 1, "Hi"), (1, 6, 11, "r", 1, "you"), (2, 1, 9, "r", 1, "x"), (4, 0, 3, "r", 1, "x"), (4, 2, 4, "r", 1, "y")])
    got = {r.doc_id: (r.after, r.status) for r in edits.apply_edits(docs, accepted).collect()}
    assert got == {1: ("Hi you", "applied"), 2: ("abc", "overlap"), 3: ("", "unchanged"), 4: ("abcdef", "overlap")}


def test_guarded_refuses_what_changes_a_fact(spark):
    rule = edits.Rule("bad", {"at least": "about"})
    docs = spark.createDataFrame([(1, "Wait at least an hour."), (2, "Wait due to the fact that it rains.")], "doc_id long, text string")
    got = {r.doc_id: (r.after, r.status, r.kinds) for r in edits.guarded(docs, [rule, *edits.AUTOMATIC]).collect()}
    assert got[1] == ("Wait at least an hour.", "refused", "comparator") and got[2][:2] == ("Wait because it rains.", "applied")


VERDICTS = [
    ("We utilise it.", "We use it.", "ACCEPTED"),
    ("Same text.", "Same text.", "ACCEPTED"),
    ("Pay $5 now.", "Pay $6 now.", "REFUSED"),
    ("Obtain informed consent first.", "Obtain consent first.", "REFUSED"),
    ("A good plan.", "A bad plan.", "INCONCLUSIVE"),
    ("Text.", " ", "INCONCLUSIVE"),
    (None, "x", "INCONCLUSIVE"),
]


def test_verify(spark):
    rows = spark.createDataFrame([(k, a, b) for k, (a, b, _) in enumerate(VERDICTS)], "pair_id long, before string, after string")
    got = {r.pair_id: r for r in verify.verify(rows).collect()}
    assert [got[k].verdict for k in range(len(VERDICTS))] == [v for _, _, v in VERDICTS]
    assert (got[4].unresolved[0].before, got[4].unresolved[0].after) == ("good", "bad") and [(e.code, e.kind) for e in got[0].equivalences] == [("safe_rule", "lexical.utilise")]
    assert got[2].refusals[0].before_lines == [1] and got[2].refusals[0].code == "protected_fact_changed"
    assert got[5].error == "empty_input" and len({r.receipt for r in got.values()}) == len(VERDICTS)


def test_barriers(spark):
    docs = spark.createDataFrame([(1, "The report was written by experts. This is the end result. I am interested."), (2, " ".join(["word"] * 41) + "."), (3, None)], "doc_id long, text string")
    found = barriers.deduplicate(barriers.detect(barriers.sentence_rows(docs)))
    got = {(r.doc_id, r.sentence, r.type, r.match, r.severity) for r in found.collect()}
    assert {(1, 0, "passive_voice", "was written", "warning"), (1, 1, "redundant_pair", "end result", "info")} <= got
    assert not any(x[3].endswith("interested") and x[2] == "passive_voice" for x in got)
    assert any(x[0] == 2 and x[2] == "long_sentence" and x[4] == "critical" for x in got)
    assert {r.doc_id: r.total for r in barriers.summary(docs, found).collect()}[3] == 0


def test_lookups(spark):
    rows = spark.createDataFrame([(1, 0, "We made a decision on the implementation of the covenant to utilise it.")], "doc_id long, sentence int, text string")
    verbs = spark.createDataFrame([("decision", "decide"), ("implementation", "implement")], "noun string, verb string")
    assert {r.match.lower() for r in barriers.nominalizations(rows, verbs).collect()} == {"decision", "implementation"}
    assert [(r.match, r.verb) for r in barriers.hidden_verbs(rows, verbs).collect()] == [("made a decision", "decide")]
    glossary = spark.createDataFrame([("utilise", "use"), ("covenant", "promise")], "word string, plain string")
    terms = spark.createDataFrame([("covenant", "legal")], "word string, domain string")
    assert {(r.match, r.plain, r.domain) for r in barriers.jargon(rows, glossary, terms).collect()} == {("utilise", "use", None), ("covenant", None, "legal")}


def test_budget(spark):
    hits = spark.createDataFrame([(["a"] * 6 + ["b"] * 4,), (["b"],), (["a"],)], "h array<string>")
    got = [r.x for r in hits.select(edits.fix_budget(F.col("h"), F.lit("a"), F.lit(""), F.lit(0.6)).alias("x")).collect()]
    assert got == [1, 0, 1]


def test_all_seven_detectors(spark):
    text = "We made a request prior to the start. In the event that it ends, the implementation of the covenant was utilised. They conducted a decision review at a nation."
    docs = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    glossary = spark.createDataFrame([("prior to", "before"), ("in the event that", "if"), ("utilise", "use"), ("covenant", "promise"), ("review", "look"), ("reviewed", "seen")], "word string, plain string")
    terms = spark.createDataFrame([("covenant", "legal")], "word string, domain string")
    verbs = spark.createDataFrame([("decision", "decide"), ("implementation", "implement"), ("nation", "x")], "noun string, verb string")
    found = barriers.deduplicate(barriers.detect(barriers.sentence_rows(docs), glossary, terms, verbs))
    got = {(r.sentence, r.type, r.match.lower(), r.severity) for r in found.collect()}
    assert {(0, "jargon", "prior to", "info"), (0, "hidden_verb", "made a request", "info"), (1, "jargon", "in the event that", "warning"), (2, "hidden_verb", "conducted a decision", "info"), (2, "jargon", "review", "info")} <= got
    # Found by two detectors, reported once: the more severe, then the first.
    assert {(1, "complex_word", "implementation", "warning"), (1, "jargon", "covenant", "info"), (1, "passive_voice", "was utilised", "warning"), (1, "complex_word", "utilised", "info")} <= got
    assert not any(t == "nominalization" and m in ("decision", "nation") for _, t, m, _ in got)
    total = barriers.summary(docs, found).where("doc_id = 1").first().total
    assert total == len(got) == sum(r.issues for r in barriers.by_sentence(found).collect())
    assert {"jargon"} <= {r.type for r in barriers.top_improvements(found).collect()}


def test_verify_capitals_terms_breaks(spark):
    words = [f"w{k}x" for k in range(4500)]
    cases = [
        ("We like Polish food.", "We like polish food.", "INCONCLUSIVE"),
        ("Polish it.", "polish it.", "INCONCLUSIVE"),
        ("It rains. We stay.", "It rains.\n\nWe stay.", "ACCEPTED"),
        ("It rains and we stay.", "It rains\n\nand we stay.", "INCONCLUSIVE"),
        ("A chronic illness is bad.", "A lasting illness is bad.", "REFUSED"),
        ("Utilise it.", "Use it.", "ACCEPTED"),
        (" ".join(["alpha", *words, "beta"]), " ".join(["gamma", *words, "delta"]), "INCONCLUSIVE"),
    ]
    rows = spark.createDataFrame([(k, a, b) for k, (a, b, _) in enumerate(cases)], "pair_id long, before string, after string")
    got = {r.pair_id: r for r in verify.verify(rows).collect()}
    assert [got[k].verdict for k in range(len(cases))] == [v for _, _, v in cases]
    assert (got[0].unresolved[0].before, got[0].unresolved[0].after) == ("Polish", "polish") and got[4].refusals[0].before == "chronic"
    assert [(r.before, r.after) for r in got[6].unresolved] == [("alpha", "gamma"), ("beta", "delta")]


def test_moves_and_regions(spark):
    cases = [
        ("Before 5 May 2020, you must apply.", "You must apply before 5 May 2020.", "ACCEPTED", "permitted_move"),
        ("Send it before 5pm and pay the fee.", "Before 5pm, send it and pay the fee.", "INCONCLUSIVE", "protected_item_moved"),
        ("It opens not before 5pm.", "Before 5pm it opens not.", "INCONCLUSIVE", "protected_item_moved"),
        ("Pay $5 now. Wait 3 days.", "Wait 3 days. Pay $5 now.", "INCONCLUSIVE", "protected_item_moved"),
        ("Run `a b` now.", "Run `a c` now.", "REFUSED", "protected_region_changed"),
        ("See [it](x).", "See [it](y).", "REFUSED", "protected_region_changed"),
        ("> one\n> two", "> one two", "ACCEPTED", "formatting"),
        ("a | b\n--|--\n1 | 2", "a | b\n--|--\n1 | 3", "REFUSED", "protected_fact_changed"),
        ("Text.\n\n```\nx", "Text!\n\n```\nx", "INCONCLUSIVE", "unlocatable_structure"),
        ("*Soft* words.", "Soft words.", "ACCEPTED", "formatting"),
    ]
    rows = spark.createDataFrame([(k, a, b) for k, (a, b, _, _) in enumerate(cases)], "pair_id long, before string, after string")
    got = {r.pair_id: r for r in verify.verify(rows, as_markdown=True).collect()}
    for k, (_, _, verdict, code) in enumerate(cases):
        assert (got[k].verdict, code in {e.code for e in [*got[k].refusals, *got[k].unresolved, *got[k].equivalences]}) == (verdict, True), cases[k]


def test_one_proposal_is_vetoed_not_its_document(spark):
    rules = [edits.Rule("bad", {"at least": "about"}), *edits.AUTOMATIC]
    docs = spark.createDataFrame([(1, "Wait at least an hour due to the fact that it rains.")], "doc_id long, text string")
    r = edits.guarded(docs, rules).first()
    assert (r.after, r.status, r.kinds, r.n_edits, r.n_vetoed) == ("Wait at least an hour because it rains.", "applied", "comparator", 1, 1)


@pytest.mark.parametrize(
    ("text", "after"),
    [
        ("An utilised tool.", "A used tool."),
        ("AN UTILISED TOOL.", "A USED TOOL."),
        ("an expended sum", "a spent sum"),
        ("We utilise\n\nit prior\n\nto use.", "We use\n\nit prior\n\nto use."),
        ("Ask for informed consent prior to it.", "Ask for informed consent before it."),
    ],
)
def test_planned(text, after):
    find = edits.Matcher([*edits.AUTOMATIC, *edits.PROTECTED])
    assert edits.spliced_text(text, [p for p in edits.planned(text, find) if p.decision == "accepted"]) == after


def test_refusals_have_reasons():
    rules = [edits.Rule("a", {"material": "stuff"}), edits.Rule("b", {"sufficient": "enough"}), edits.Rule("c", {"consent": "leave"})]
    find = edits.Matcher([*rules, *edits.PROTECTED])
    got = [(p.surface, p.decision, p.reason) for p in edits.planned("A sufficient reason. The material. Informed consent. Sufficient funds.", find)]
    assert got == [("sufficient", "refused", "article"), ("material", "refused", "inherited-protected: material (legal)"), ("consent", "refused", "declared-protected"), ("Sufficient", "accepted", "")]


def test_scopes_of_markdown():
    find = edits.Matcher([*edits.AUTOMATIC, *edits.PROTECTED])
    text = "# It is important to note that we utilise it\n\nWe utilise `utilise` and [utilise](http://x/utilise).\n\n> We utilise it.\n\n```\nutilise\n```\n"
    after = edits.spliced_text(text, [p for p in edits.planned(text, find, edits.Layout.of_markdown(text)) if p.decision == "accepted"])
    assert after == "# It is important to note that we use it\n\nWe use `utilise` and [use](http://x/utilise).\n\n> We utilise it.\n\n```\nutilise\n```\n"


def test_settled_agrees_with_settle(spark):
    import random

    r = random.Random(3)
    rows = []
    for doc in range(60):
        for k in range(r.randint(1, 6)):
            start = r.randint(0, 12)
            rows.append((doc, start, start + r.randint(1, 6), f"r{r.randint(0, 3)}{k}", r.randint(0, 2), r.choice("xy")))
    want = {(x.doc_id, x.rule_id, x.start): x.decision for x in edits.settle(proposals(spark, rows)).collect()}
    for doc in range(60):
        own = [edits.Proposal(s, e, i, p, "", t) for d, s, e, i, p, t in rows if d == doc]
        assert {(doc, p.rule_id, p.start): p.decision for p in edits.settled(own)} == {k: v for k, v in want.items() if k[0] == doc}


RULE = {
    "id": "PM.TEST.001", "version": 1, "name": "n", "mode": "safe-fix", "description": "d", "match": {"type": "lemma", "lemma": "utilise", "pos": "verb"}, "action": {"type": "replace", "lemma": "use"},
    "reason": {"short": "s"}, "provenance": {"source": "own", "licence": "own"}, "examples": {"positive": ["a"], "negative": ["b"]},
}


@pytest.mark.parametrize(
    "change",
    [
        {"id": "x"}, {"version": 0}, {"version": True}, {"mode": "other"}, {"extra": 1}, {"action": {"type": "none"}}, {"action": {"type": "replace", "replacement": "use"}}, {"priority": 1001}, {"scope": {"include": ["sky"]}},
        {"match": {"type": "regex", "pattern": "(a+)+"}}, {"match": {"type": "regex", "pattern": "(a)\\1"}}, {"match": {"type": "word", "text": "two words"}}, {"match": {"type": "word", "text": "one"}, "action": {"type": "delete"}},
        {"match": {"type": "phrase", "text": "x" * 121}}, {"mode": "style-fix", "match": {"type": "phrase", "text": "Thus,"}, "action": {"type": "replace", "replacement": "So,"}}, {"review": {"required": True}}, {"examples": {"positive": []}},
        {"match": {"type": "lemma", "lemma": "utilise", "pos": "verb", "classes": ["plural"]}}, {"case": {"policy": "exact"}}, {"name": "x" * 81}, {"reason": {}},
    ],
)
def test_rules_that_are_not_understood(change):
    with pytest.raises(rules.RuleError):
        rules.build_rule(RULE | change)


def test_ruleset(tmp_path):
    style = RULE | {"id": "PM.STYLE.001", "mode": "style-fix", "match": {"type": "phrase", "text": "Thus,", "case": "sensitive"}, "action": {"type": "replace", "replacement": "So,"}, "case": {"policy": "exact"}, "requires_diagnostic": {"id": "REPEATED_TRANSITION", "evidence_label": "thus"}, "review": {"required": True}}
    (tmp_path / "RULESET.json").write_text(json.dumps({"ruleset_version": "7"}))
    (tmp_path / "b.json").write_text(json.dumps([style, RULE]))
    found = rules.load_ruleset(str(tmp_path))
    assert [r["id"] for r in found["rules"]] == ["PM.STYLE.001", "PM.TEST.001"] and found["version"] == "7" and len(found["sha256"]) == 64
    assert rules.literals(found["rules"][1]) == {"utilise": "use", "utilises": "uses", "utilised": "used", "utilising": "using"}
    assert "utilised" in rules.explain(found["rules"][1]) and found["rules"][0]["trigger"] == ("REPEATED_TRANSITION", "thus")
    find = edits.Matcher([rules.executable(r) for r in found["rules"]])
    assert [p.replacement for p in edits.planned("Thus, we utilised it.", find)] == ["used"]
    (tmp_path / "c.json").write_text(json.dumps(RULE))
    with pytest.raises(rules.RuleError):
        rules.load_ruleset(str(tmp_path))


@pytest.mark.parametrize(
    ("lemma", "pos", "want"),
    [
        ("commit", "verb", "commit commits committed committed committing"), ("carry", "verb", "carry carries carried carried carrying"), ("agree", "verb", "agree agrees agreed agreed agreeing"),
        ("go", "verb", "go goes went gone going"), ("find out", "verb", "find out finds out found out found out finding out"), ("box", "noun", "box boxes"), ("leaf", "noun", "leaf leaves"), ("child", "noun", "child children"),
        ("staff", "noun", "staff staff"), ("city", "noun", "city cities"), ("from now on", "adverb", "from now on"), ("benefit", "verb", "benefit benefits benefited benefited benefiting"),
    ],
)
def test_forms(lemma, pos, want):
    assert " ".join(morphology.forms(lemma, pos).values()) == want


def test_forms_that_cannot_be():
    for lemma, pos in (("a1", "verb"), ("x", "thing"), ("two words", "noun"), ("", "verb")):
        with pytest.raises(ValueError):
            morphology.forms(lemma, pos)
    assert morphology.pairs("depict", "show") == {"depict": "show", "depicts": "shows", "depicting": "showing"}
