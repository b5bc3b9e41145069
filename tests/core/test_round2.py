"""Findings of round 2."""

import re

import pytest

from prosemill.operators import edits, facts, verify
from prosemill.plans import registry

duckdb = pytest.importorskip("duckdb")


@pytest.mark.parametrize("name", ["barriers", "barrier_summary", "barriers_by_sentence", "placed_barriers", "source_barriers", "top_improvements"])
def test_participles_before_other_letters(spark, tmp_path, name):
    """A participle's end before a letter beyond ASCII counts as in SQL; a phrase's start within a word doesn't."""
    texts = ["It will be stß, and has been tekeitä now. It was sent.", "Aßis sent, äis sent. The end is enenß ist.", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    got = registry.queries()[name](spark, str(tmp_path))
    cursor = con.execute(registry.oracle_sql()[name])
    names = sorted(d[0] for d in cursor.description)
    want = sorted(str([dict(zip([d[0] for d in cursor.description], row, strict=True))[c] for c in names]) for row in cursor.fetchall())
    assert sorted(str([r[c] for c in names]) for r in got.collect()) == want and want


class Counting:
    """A pattern that counts the characters it is given."""

    read = 0

    def __init__(self, pattern):
        self.pattern = pattern

    def finditer(self, text):
        Counting.read += len(text)
        return self.pattern.finditer(text)


@pytest.fixture
def read(monkeypatch):
    """How many characters the patterns of facts are given while something runs."""
    facts._kept.cache_clear()
    monkeypatch.setattr(facts, "_PATTERNS", [(kind, Counting(p)) for kind, p in facts._PATTERNS])

    def during(run):
        Counting.read = 0
        run()
        return Counting.read

    return during


def edited(n, name):
    return " ".join(f"In {name} {k} they must have utilised 5 tools prior to day {k}." for k in range(n))


@pytest.mark.parametrize("more", [[edits.Rule("test.must", {"must": "should"})], [], [], [], [edits.Rule("test.material", {"the material": "the stuff"}), edits.Rule("test.informed", {"informed": "told"})]], ids=["vetoed_edits", "change_rows", "sealed_plans", "guarded_edits", "article_edits"])
def test_planning_grows_with_the_text(read, more):
    """Not with the square of it: the firewall reads what is near an edit, however long its block is."""
    find = edits.Matcher([*edits.AUTOMATIC, *edits.PROTECTED, *more])
    few, many = (read(lambda n=n: edits.planned(edited(n, f"town{n}"), find)) for n in (20, 80))
    assert few and many < 6 * few


def test_pieces_hold_the_facts_of_the_whole():
    text = "Pay $5. Then 3 Jan. 2020 or 3 Jan. at 5 p.m. On /a/b. Is it v1.2.3? No more than 7! Don't (see c:\\x\\y). e@f.org. The end 5. USD 7. kg is /c/d"
    assert len(facts.cuts(text)) > 5
    assert facts.extract(text) == facts._claimed(text)


def test_rules_are_tried_on_letters_of_any_case():
    find = edits.Matcher([edits.Rule("a", {"risk": "chance"}), edits.Rule("b", {"Über": "over"}), edits.Rule("c", {}, pattern=r"\bx\d")])
    assert [m[2] for m in find("RISK. ri\u017f\u212a. ÜBER x1 r\u0131sk")] == ["a", "a", "b", "c", "a"]


def test_verifying_grows_with_the_text(read):
    """verdicts: both sides are planned and compared by pieces."""
    find, phrases = edits.Matcher([*edits.AUTOMATIC, *edits.PROTECTED]), re.compile("informed consent", re.I)

    def judged(n):
        before = edited(n, f"city{n}")
        verify.Comparison(*(verify.prepared(t, find, phrases, False) for t in (before, before + " It ends."))).run()

    few, many = (read(lambda n=n: judged(n)) for n in (20, 80))
    assert few and many < 6 * few


PIECES = "Order 7 costs $3 and is due prior to 2020-01-03. We utilise it. It is important to note that 3 kg weigh. The risk\n\nutilised is a commenced one. It is important to note that refunds end. We utilise it. "


def test_pieces_are_planned_as_the_whole():
    more = [edits.Rule("test.must", {"must": "should"}), edits.Rule("test.num", {"we": "5 kg"}), edits.Rule("test.end", {"ends": "(it"})]
    for rules in (more, more[:1], [edits.Rule("test.across", {"it. it": "x"})]):
        find = edits.Matcher([*edits.AUTOMATIC, *edits.PROTECTED, *rules])
        for text in (PIECES, "It ends 5. We kg. " + PIECES, "No more. Than 5 must be."):
            whole = edits._planned(text, find, edits.Layout.of_text)
            after = edits.spliced_text(text, [p for p in whole if p.decision == "accepted"])
            own = edits.parts(text, find)
            assert edits.planned(text, find) == whole and "".join(part.after for _, part in own) == after
            assert edits.lost_kinds(own) == sorted({kind for side in facts.changed(text, after) for kind, _ in side})


@pytest.mark.parametrize("query", ["guarded_edits", "article_edits", "change_rows"])
def test_a_piece_is_planned_once(spark, tmp_path, query, monkeypatch):
    """Sentences that documents share are planned once in a task; the task is run here, as a worker gets it."""
    from pyspark import cloudpickle

    tasks, of = [], type(spark.range(1))
    mapped = of.mapInArrow
    monkeypatch.setattr(of, "mapInArrow", lambda self, f, schema, *more: tasks.append(cloudpickle.loads(cloudpickle.dumps(f))) or mapped(self, f, schema, *more))
    import datetime

    import pyarrow as pa

    rows = [(k, k, "O", 10.0 + k, datetime.date(2020, 1, 1)) for k in range(3)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate date").write.parquet(str(tmp_path / "orders.parquet"))
    registry.queries()[query](spark, str(tmp_path))
    texts = [f"Order {k} is due prior to noon. We utilise it. We utilise it, due to the fact that it is. It ends." for k in range(50)]
    seen = []
    planned = edits._planned
    monkeypatch.setattr(edits, "_planned", lambda text, *more: seen.append(text) or planned(text, *more))
    batch = pa.RecordBatch.from_arrays([pa.array(range(50)), pa.array(texts)], names=["doc_id", "text"])
    (out,) = tasks[0](iter([batch]))
    assert len(out) == 50 and len(seen) == 53 and len(set(seen)) == 53


def test_the_firewall_reads_near_an_edit(read):
    """vetoed_edits: of a long sentence only what stands between plain words around an edit."""
    find = edits.Matcher([*edits.AUTOMATIC, *edits.PROTECTED])
    text = " ".join(f"item {k} costs $5.0{k} and is due prior to 2020-01-0{k % 7}" for k in range(100, 180))
    assert read(lambda: edits.planned(text, find)) < len(text)


def test_sealed_plans_are_made_once(spark):
    """sealed_plans: documents are planned and compared in one pass each, and no table is joined with itself."""
    docs = spark.createDataFrame([(1, "We utilise it."), (2, "Pay $5.")], "doc_id long, text string")
    out = edits.apply_sealed(docs, edits.sealed(edits.plans(docs)))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 2 and plan.count("Join") == 1
    assert sorted((r.doc_id, r.after, r.status) for r in out.collect()) == [(1, "We use it.", "applied"), (2, "Pay $5.", "unchanged")]


def test_equal_sentences_are_prepared_once(monkeypatch):
    """verdicts: a sentence of both texts is planned once, and two equal texts are not looked at."""
    import pyarrow as pa

    seen, tasks = [], []
    planned = edits._planned
    monkeypatch.setattr(edits, "_planned", lambda text, *more: seen.append(text) or planned(text, *more))

    class Pairs:
        def select(self, *columns):
            return self

        def mapInArrow(self, f, schema):
            tasks.append(f)

    monkeypatch.setattr(verify.F, "col", lambda name: type("C", (), {"cast": lambda self, kind: self})())
    verify.verify(Pairs())
    texts = [f"Order {k} is here. We utilise it. It ends." for k in range(9)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(9)), pa.array(texts), pa.array([t if k % 3 else t.replace("utilise", "use") for k, t in enumerate(texts)])], names=["pair_id", "before", "after"])
    (out,) = tasks[0](iter([batch]))
    assert out.column("verdict").to_pylist() == ["ACCEPTED"] * 9 and len(seen) == len(set(seen)) == 3 + 3


def planned_rows(texts, rules):
    """Rows by id of a batch of texts, planned as a task does it, and the same texts planned one by one."""
    import pyarrow as pa

    find = edits.Matcher([*edits.AUTOMATIC, *edits.PROTECTED, *rules])
    planner = edits._Planner(find, edits.Layout.of_text)
    got = {r["doc_id"]: r for b in planner(pa.array(range(len(texts))), pa.array(texts)) for r in b.to_pylist()}
    columns = [c.to_pylist() for c in edits._Planner(find, edits.Layout.of_text).one_by_one(texts)]
    return got, {k: dict(zip(("doc_id", "before", "after", "proposals", "broken"), (k, t, *row), strict=True)) for k, (t, *row) in enumerate(zip(texts, *columns, strict=True))}


ALIKE = [
    "An utilised tool, number {0}. A commenced task is {1} kg.\n\nThe material prior to use is chronic, and informed consent comes first.",
    "Ärger: order {0} must be paid prior to 2020-0{2}-1{2}. It is important to note that {1}% of refunds, due to the fact that ٣ prices move, are final.",
    "No edit for {0}.", "", "Risk {1} weighs {2} kg", "{0}{1} utilise 5 {2}",
]


@pytest.mark.parametrize("rules", [[], [edits.Rule("test.must", {"must": "should"}), edits.Rule("test.kg", {"kg": "lb"}), edits.Rule("test.material", {"the material": "the stuff"})], [edits.Rule("test.5", {"utilise 5": "use 6"})]], ids=["article_edits", "vetoed_edits", "digits"])
def test_texts_alike_are_planned_as_each(rules):
    texts = [ALIKE[k % 6].format(100 + k, k % 9 + 1, k % 7 + 1) for k in range(600)] + ["One more utilised tool."]
    got, want = planned_rows(texts, rules)
    assert got == want


def test_digits_that_matter_are_looked_at():
    """An edit after which the currency stands by the other number is kept where both numbers are equal only."""
    texts = [f"Pay {k % 9 + 1} USD {k * 5 % 9 + 1} now." for k in range(200)]
    got, want = planned_rows(texts, [edits.Rule("test.usd", {"USD": "USD or"}, exact=True)])
    assert got == want and len({r["proposals"][0]["decision"] for r in got.values()}) == 2


def planned_texts(spark, tmp_path, monkeypatch, query):
    """What a task of a query plans of a batch of 400 orders."""
    import datetime

    from pyspark import cloudpickle

    tasks, of = [], type(spark.range(1))
    mapped = of.mapInArrow
    monkeypatch.setattr(of, "mapInArrow", lambda self, f, schema, *more: tasks.append((self, cloudpickle.loads(cloudpickle.dumps(f)))) or mapped(self, f, schema, *more))
    rows = [(1000 + k, k, "O", 100.0 + k, datetime.date(2020, 1, 1 + k % 28)) for k in range(400)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate date").write.parquet(str(tmp_path / "orders.parquet"))
    registry.queries()[query](spark, str(tmp_path))
    seen = []
    planned = edits._planned
    monkeypatch.setattr(edits, "_planned", lambda text, *more: seen.append(text) or planned(text, *more))
    ((docs, task),) = tasks
    assert sum(len(b) for b in task(iter(docs.toArrow().combine_chunks().to_batches()))) == 400
    return seen


@pytest.mark.parametrize("query", ["article_edits", "guarded_edits"])
def test_texts_that_differ_in_digits_are_planned_once(spark, tmp_path, monkeypatch, query):
    assert 0 < len(planned_texts(spark, tmp_path, monkeypatch, query)) < 40


def test_guarded_edits_are_counted_where_they_are_planned(spark):
    """guarded_edits: no proposal leaves the task, and what is counted is what the plans hold."""
    rules = [*edits.AUTOMATIC, edits.Rule("test.must", {"must": "should"}), edits.Rule("test.usd", {"USD": "USD or"}, exact=True)]
    texts = ["They must utilise it.", "They must go. Pay 5 USD 6 now.", "Pay 5 USD 5 prior to noon.", "It ends.", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = edits.guarded(docs, rules)
    assert "proposals" not in out._jdf.queryExecution().optimizedPlan().treeString()
    want = {}
    for row in edits.plans(docs, rules).collect():
        vetoed = [p.reason for p in row.proposals if p.decision == "vetoed"]
        kinds = sorted({k for r in [*vetoed, row.broken] if r for k in r.split(",")})
        n = 0 if row.broken else sum(p.decision == "accepted" for p in row.proposals)
        want[row.doc_id] = (row.after, n, len(vetoed), "applied" if n else "refused" if kinds else "unchanged", ",".join(kinds))
    assert {r.doc_id: tuple(r)[2:] for r in out.collect()} == want and {w[3] for w in want.values()} == {"applied", "refused", "unchanged"}
