"""A training-corpus pipeline: detoxify, drop near copies, cut repeated passages, mix sources, encode.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
Columns of a stage's input beyond those of documents are kept, nulls in any of them don't matter, and an empty input
gives an empty output.  A row is judged by its text; rows that share a doc_id share the fate of that id in stage 2.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prosemill.llm import bpe, debruijn, mixing, simhash, toxicity
from prosemill.llm.common import shared_dir, slices, text_bytes
from prosemill.sources.tables import load


def _with_lengths(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text scores under 0.5; the scorer learns from the labels of the input's documents."""
    scorer = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    shared = spark.sparkContext.broadcast(scorer)
    at = docs.columns.index("text")

    def keep(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        own.start()
        for batch in slices(it):
            clean = np.array([own.score(t) < 0.5 for t in text_bytes(batch.column(at))], bool)
            yield batch.filter(pa.array(clean))
        own.stop()

    return docs.mapInArrow(keep, docs.schema)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked fingerprints the document with the smallest doc_id."""
    groups = simhash.near_duplicates(docs)
    kept = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__kept")).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["__kept"]), "left_semi")


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the words of 20-word windows that start earlier; an untouched text stays as it is."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    out = debruijn.remove_repeated_words(docs, carry=others, untouched=True).withColumnRenamed("kept", "text")
    return _with_lengths(out.select(*docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per document and pass of the mix, with the words that the pass takes."""
    return _with_lengths(mixing.mixed_documents(docs))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text (little-endian unsigned 32-bit integers), and digests of them and of the decoded text."""
    import public_tokenizers

    out = bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return out.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("toxicity", drop_toxic), ("simhash_near_dedup", drop_near_copies), ("substring_dedup", cut_repeats), ("mixing", mix_sources), ("bpe", encode_tokens)]

#: SQL can't express learned scores and fingerprints' links, so the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and reread by the next."""
    docs = load(spark, sf_dir, "documents")
    where = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{where}/{name}")
        docs = spark.read.parquet(f"{where}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
