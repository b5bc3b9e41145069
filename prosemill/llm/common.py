"""What the corpus operators share: shared-folder cuts, bucketed blobs, connected components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or else the context's checkpoint folder.

    Where neither is set, a session on one machine (tests) gets a folder of its own; on a cluster that is an error.
    """
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if where is None and current is None:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="prosemill-")
    if current is None:
        sc.setCheckpointDir(where)
    return where or current


#: Rows for each file of a checkpoint whose rows are counted.
_CUT_ROWS = 200_000


def cut(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder, so that a lost executor costs no recomputation.

    A checkpoint writes a file for each partition; if about how many ``rows`` there are is known, partitions follow it.
    """
    shared_dir(df.sparkSession)
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // _CUT_ROWS)))
    return df.checkpoint(eager=True)


#: Collections after a cut and seconds after each: what holds a shuffle is let go by one, the shuffle itself by a later one.
_COLLECTIONS, _PAUSE = 3, 0.4


def free(spark: SparkSession) -> None:
    """After a cut: let the driver collect its garbage, so that the shuffles behind the cut leave the executors' disks now.

    Shuffles are dropped by a thread of the driver when they are seen to be garbage, hence the pauses.
    """
    for _ in range(_COLLECTIONS):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(_PAUSE)


def parts(spark: SparkSession) -> int:
    """Number of shuffle partitions the session was sized for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bytes of input for one bucket of names, and an estimate that says nothing.
_BUCKET_BYTES, _UNKNOWN = 16 << 20, 1 << 60


def buckets(df: DataFrame) -> int:
    """Into how many buckets names of ``df`` are dealt: as many as partitions, and so many that one stays small.

    Its size is what the plan knows of its files; nothing is read for it.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(parts(df.sparkSession), size // _BUCKET_BYTES if size < _UNKNOWN else 0)


def own_columns(df: DataFrame, **names: str) -> DataFrame:
    """Keep only the named columns under fixed names, so that further or clashing columns cannot matter."""
    return df.select(*[df[f"`{src}`"].alias(dst) for dst, src in names.items()])


def fresh_key(column: str) -> list[Column]:
    """Join keys that no earlier shuffle satisfies: both sides are dealt anew, so that AQE may split a hot key."""
    return [F.xxhash64(F.lit(7), F.col(column))]


def rejoin(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Equi-join on ``key`` that always shuffles both sides; ``right`` holds one row per key.

    A hot key on the left is then split by adaptive execution, which it cannot do when one side reuses the
    partitioning of an earlier aggregate.
    """
    lhs = left.withColumn("__k", F.xxhash64(F.lit(7), F.col(key)))
    rhs = right.withColumn("__k", F.xxhash64(F.lit(7), F.col(key)))
    return lhs.join(rhs, ["__k", key], how).drop("__k")


def reduce_links(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (node, smallest node of its tree) of the undirected links a-b."""
    if len(a) == 0:
        return a, b
    nodes, idx = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = idx[: len(a)], idx[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        for at in (x, y, label[x], label[y]):
            np.minimum.at(new, at, low)
        while True:
            jumped = new[new]
            if np.array_equal(jumped, new):
                break
            new = jumped
        if np.array_equal(new, label):
            break
        label = new
    child = label != np.arange(len(nodes))
    return nodes[child], nodes[label[child]]


def components(links: DataFrame) -> DataFrame:
    """Connected components by alternating large-star and small-star steps.

    ``links`` has two long columns a and b.  Returns (node, root) with the smallest node of the component as root,
    for every node that has a link.  Every step is two aggregations and two joins over the remaining links; a star's
    centre is pre-aggregated before its shuffle and its join is dealt anew, so a component of any size is spread.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        if large:
            sym = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        else:
            sym = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = sym.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        if large:
            moved = rejoin(sym.where("b > a"), low, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        else:
            moved = rejoin(sym, low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).union(low.select("a", F.col("low").alias("b")))
        return moved.where("a <> b")

    def signature(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())

    now = cut(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before, sig = None, signature(now)
    while sig[0] and sig != before:
        now = cut(star(star(now, True), False).distinct(), sig[0])
        before, sig = sig, signature(now)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def text_bytes(column: pa.Array) -> list[bytes | None]:
    """A text column as UTF-8 bytes without decoding."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def slices(it: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Short runs of the rows, so that Python holds few texts at a time.

    After the last one what the allocators still hold is given back, because a worker waits in memory for later tasks.
    """
    for batch in it:
        for k in range(0, len(batch), rows):
            yield batch.slice(k, rows)
        del batch
    give_back()


def give_back() -> None:
    """Return freed memory to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def batches(rows: dict[str, list | np.ndarray | pa.Array], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(rows[f.name], type=f.type) for f in schema], schema=schema)
