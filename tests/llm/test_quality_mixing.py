import os
from collections import Counter, defaultdict
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from prosemill.llm import mixing, quality


def base_measures(text):
    t = text or ""
    words = [w for w in t.translate(str.maketrans("\t\n\x0b\x0c\r", " " * 5)).split(" ") if w]
    lines = [line for line in t.split("\n") if line.strip(" \t\x0b\x0c\r")]
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    repeated = {j for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(repeated)


def test_base_measures(docs, texts):
    want = {i: base_measures(t) for i, t in texts}
    got = quality.clean(docs).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want[r.doc_id]
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_line_rules(spark):
    prose = "This is a plain sentence with enough words to stand, and it ends well.\nSo is this one, which follows it in the text."
    rows = [
        (1, prose),
        (2, prose + "\nHome | News | Sport | Contact"),
        (3, "Buy### now%%% or&&& never$$$ see### such%%% things*** again### at&&& all%%% here***"),
        (4, prose + "\nAll rights reserved. Privacy policy."),
        (5, "STOP!! BUY!! NOW!! GO!! ON!! AND!! ON!! AS!! YOU!! MUST!! DO!!"),
    ]
    got = {r.doc_id: r for r in quality.clean(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i].kept for i in range(1, 6)] == [True, True, False, True, False]
    assert got[2].cleaned_text == got[4].cleaned_text == got[1].cleaned_text == prose


def test_quality_empty(nothing):
    assert quality.clean(nothing).count() == 0


def water_filling(sizes):
    """Targets by raising the level until all words are shared."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in sizes if s not in capped]
        level = (total - sum(3 * sizes[s] for s in capped)) / sum(weight[s] for s in free) if free else 0
        over = {s for s in free if weight[s] * level > 3 * sizes[s]}
        if not over:
            return {s: 3.0 * sizes[s] if s in capped else weight[s] * level for s in sizes}
        capped |= over


def test_mix(docs):
    rows = docs.select("doc_id", "source", "text").collect()
    sizes = defaultdict(int)
    for r in rows:
        sizes[r.source] += len((r.text or "").encode().split())
    want = water_filling(dict(sizes))
    plan = mixing.mix(docs, block_words=16, shards=16)
    got = plan.collect()
    assert len(got) == len(rows)
    taken, draws = defaultdict(int), defaultdict(set)
    for r in got:
        words = sum(p.words for p in r.pieces)
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6
        assert words <= 3 * r.size and all(0 <= p.start and p.start + p.words <= r.size for p in r.pieces)
        taken[r.source] += words
        for p in r.pieces:
            draws[r.source, p.draw].add(p.shard)
    for s in sizes:
        assert taken[s] == int(want[s] + 0.5)
    assert all(len(shards) == 1 for shards in draws.values())
    per_shard = Counter(next(iter(s)) for s in draws.values())
    assert max(per_shard.values()) - min(per_shard.get(k, 0) for k in range(16)) <= 2
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(7), block_words=16, shards=16).collect()))


def test_mixed_documents(docs):
    plan = {(r.doc_id, r.source, r.size): r.w for r in mixing.mix(docs).groupBy("doc_id", "source", "size").agg(F.sum(mixing.taken("pieces")).alias("w")).collect()}
    words = Counter()
    for r in mixing.mixed_documents(docs).collect():
        words[r.doc_id] += len((r.text or "").encode().split())
        assert r.id == 1 and r.pieces == 2 and r.rest == "x"
    for (doc_id, _, _), w in plan.items():
        assert words[doc_id] == w


def test_shards_are_dealt_and_shuffled(docs):
    plan = Counter()
    for r in mixing.mix(docs, shards=5, block_words=32).collect():
        for p in r.pieces:
            plan[p.shard] += p.words
    mixed = mixing.mixed_documents(docs, shards=5, block_words=32).select("doc_id", "text", F.spark_partition_id().alias("part")).collect()
    words = Counter()
    for r in mixed:
        words[r.part] += len((r.text or "").encode().split())
    assert set(plan) == set(range(5)) and max(plan.values()) < 1.5 * min(plan.values())
    sums = {sum(c) for k in range(1, 6) for c in combinations(plan.values(), k)}
    assert words.total() == plan.total() and all(n in sums for n in words.values())
    ids = [r.doc_id for r in mixed if r.part == mixed[0].part]
    assert ids != sorted(ids)


def test_blocks_are_permuted(spark):
    for n in (1, 2, 3, 7, 64, 1000, 4097):
        got = [r[0] for r in spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"))).collect()]
        assert sorted(got) == list(range(n))
        if n >= 64:
            near = sum(abs(a - b) < n // 16 for a, b in zip(got, got[1:], strict=False))
            assert 0.05 < near / n < 0.25


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_mix_against_sql(spark, sf):
    duckdb = pytest.importorskip("duckdb")
    path = f"/root/testdata/{sf}/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no tables here")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{path}')")
    want = con.execute(mixing.ORACLE).fetchall()
    plan = mixing.mix(spark.read.parquet(path)).select("doc_id", "size", "source_size", "target", mixing.taken("pieces"))
    assert sorted(map(tuple, plan.collect())) == sorted(want)


def test_hypergeometric_draws(spark):
    rows = spark.range(4000).select(mixing.hypergeometric(F.lit(50).cast("long"), F.lit(20).cast("long"), F.lit(15).cast("long"), mixing._uniform(F.lit(1), F.col("id"))).alias("k"))
    k = [r.k for r in rows.collect()]
    assert min(k) >= 0 and max(k) <= 15 and abs(sum(k) / len(k) - 6) < 0.1
    var = sum((x - 6) ** 2 for x in k) / len(k)
    assert abs(var - 15 * 0.4 * 0.6 * 35 / 49) < 0.25


def test_quotas_are_kept(spark):
    quotas = [7, 0, 1000, 13, 1]
    leaves = mixing.split_quotas(spark.createDataFrame([(quotas,)], "quotas array<long>"), 7).collect()
    assert sorted(r.shard for r in leaves) == list(range(7))
    assert [sum(r.quotas[k] for r in leaves) for k in range(5)] == quotas
    sizes = [sum(r.quotas) for r in leaves]
    assert max(sizes) - min(sizes) <= 3


def test_one_source_and_a_long_text(spark):
    rows = [(1, "w " * 50_000, "a"), (2, "x y", "a"), (3, None, "a")]
    got = {r.doc_id: (r.size, sum(p.words for p in r.pieces)) for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got == {1: (50_000, 50_000), 2: (2, 2), 3: (0, 0)}


def test_mix_empty(nothing):
    assert mixing.mix(nothing).count() == 0
    assert mixing.mixed_documents(nothing).count() == 0
