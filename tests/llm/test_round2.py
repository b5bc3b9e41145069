"""Findings of round 2."""

from pathlib import Path

from pyspark.sql import functions as F

from prosemill.llm import common


def test_freed_shuffles_leave_the_disk(spark):
    """op8_suffixes: the shuffle behind a cut is gone once it is freed, not only at some later collection."""
    dirs = [Path(d.getPath()) for d in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    held = lambda: {p.name for d in dirs for p in d.rglob("shuffle_*.data")}
    earlier = held()
    rows = spark.range(50_000).groupBy((F.col("id") % 5000).alias("k")).agg(F.collect_list("id").alias("ids"))
    done = common.cut(rows)
    del rows
    assert held() - earlier
    common.free(spark)
    assert not held() - earlier and done.count() == 5000
