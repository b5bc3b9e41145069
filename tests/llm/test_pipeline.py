from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from prosemill.llm import registry, toxicity

from .test_repeats import brute
from .test_simhash import groups, plain_fingerprint


@pytest.fixture(scope="module")
def sf_dir(spark, docs, tmp_path_factory):
    where = tmp_path_factory.mktemp("sf")
    docs.write.parquet(f"{where}/documents.parquet")
    labels = [(i, 1, 0) for i in range(30)] + [(300 + i, 1, 0) for i in range(5)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    return str(where)


def test_stages_against_brute_force(spark, docs, sf_dir):
    rows = {(r.doc_id, r.text) for r in docs.collect()}
    one = cp.drop_toxic(spark, docs, sf_dir)
    assert one.columns == docs.columns and one.count() == docs.count()
    two = cp.drop_near_copies(spark, one, sf_dir)
    texts = {i: t for i, t in rows}
    want = groups({i: plain_fingerprint(t) for i, t in texts.items()}, 4)
    assert {r.doc_id for r in two.collect()} == {i for i in texts if want[i] == i} and two.columns == docs.columns
    three = cp.cut_repeats(spark, two, sf_dir)
    kept = brute([(r.doc_id, r.text) for r in two.collect()], 20, True)
    for r in three.collect():
        n, gone, text = kept[r.doc_id]
        assert r.text == (text.decode() if gone else texts[r.doc_id] or "")
        assert r.n_chars == len(r.text)
    assert three.columns == docs.columns
    four = cp.mix_sources(spark, three, sf_dir)
    assert four.columns == docs.columns
    five = cp.encode_tokens(spark, four, sf_dir)
    assert five.count() == four.count()
    assert sorted(Counter(r.decoded_sha256 for r in five.collect()).items()) == sorted(Counter(r.h for r in four.select(F.sha2(F.coalesce("text", F.lit("")), 256).alias("h")).collect()).items())


def test_run_agrees_with_its_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, sf_dir)
    digest = lambda df: sorted((r.doc_id or -1, r.ids_sha256) for r in df.select("doc_id", "ids_sha256").collect())
    assert digest(cp.run(spark, sf_dir)) == digest(docs)


def test_toxic_documents_go(spark, tmp_path):
    rows = [(i, ("the river moves on and people walk home " * 3) + ("you idiot" if i % 2 else "quietly") + f" {i}") for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert {r.doc_id for r in cp.drop_toxic(spark, docs, str(tmp_path)).collect()} == set(range(0, 80, 2))


def test_an_empty_table_passes_through(spark, nothing, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = nothing
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, str(tmp_path))
    assert docs.count() == 0


def test_registry():
    names = registry.queries()
    assert [n.split("_")[0] for n in sorted(names, key=lambda n: int(n.split("_")[0][2:]))] == [f"op{k}" for k in range(1, 11)]
    assert set(registry.oracle_sql()) <= set(names)
    assert toxicity.HELD_OUT_OF == 5
