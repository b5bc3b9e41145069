"""Findings of round 3."""

import random

from prosemill.operators import edits, verify
from prosemill.plans import registry


def test_verdicts_join_nothing(spark, tmp_path):
    """verdicts: what a pair carries goes through the pass, so no second table of pairs is broadcast or shuffled."""
    spark.sql("select 1L o_orderkey, 2.5d o_totalprice, date'2020-01-02' o_orderdate").write.parquet(f"{tmp_path}/orders.parquet")
    found = registry.verdicts(spark, str(tmp_path))
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert [tuple(r) for r in found.collect()] == [("comparator", "ACCEPTED", 1)]


def test_alike_pairs_are_judged_as_each_by_itself():
    """verdicts: a pair is examined once for each likeness, and gets the verdict that it gets alone."""
    rng = random.Random(3)
    texts = ["Pay ${} prior to {} May 20{}{}.", "Pay £{} before {} May 20{}{}.", "It weighs {} kg, or {},{} g; {}%.", "Utilise v{}.{}.{} at {}:30.", "Code a{}b{}, not {}.{}.", "No {} of +{} in 1,{}.{}", "{}{} of {} are {} per cent."]
    judge = verify._Judge(edits.AUTOMATIC, False)
    pairs = []
    for _ in range(3000):
        some = [str(rng.choice([1, 2, 5, 10, 12, 20, 123, 1234])) for _ in range(4)]
        other = some if rng.random() < 0.5 else [str(rng.choice([1, 2, 10, 12, 123, 1234])) for _ in range(4)]
        a, b = rng.choice(texts), rng.choice(texts)
        pairs.append((a.format(*some), (a if rng.random() < 0.7 else b).format(*other)))
    for before, after in pairs:
        assert judge(before, after) == verify.examined(before, after, judge.find, judge.phrases)[0], (before, after)
    assert 0 < len(judge.kept) < len(set(pairs))
