"""Tables of a folder of Parquet files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Bytes per core up to which a table in too few files is dealt over all cores before work begins.
SMALL = 64 << 20


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table ``name``; a small one in fewer files than cores is dealt over the cores.

    A file with one row group is one task, however many cores are idle.  Large tables are split by the scan itself and
    never shuffled here; columns that aren't used are still not read.
    """
    rows = spark.read.parquet(f"{folder}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    size = int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    # Files are counted for a small table only, and where they are listed already.
    if size <= SMALL * cores and len(rows._jdf.inputFiles()) < cores:
        return rows.repartition(cores)
    return rows
