"""Exact near-duplicates of embeddings by a metric range join.

Unit vectors with cosine >= c lie within r = sqrt(2 - 2c) of each other.  Pivots partition them: every vector belongs
to its nearest pivot's cell.  By the triangle inequality a vector y can only have a partner in the cell of pivot p if
d(y, p) <= radius(p) + r, and only if y lies within r of the plane that divides p from y's own pivot; it is replicated
to exactly those cells.  Both tests leave room for rounding, which is large where a distance or the gap between two
pivots is small.  Each cell then joins independently, its own vectors against own and replicated ones.  Pivots grow in
number with the vectors.  A large cell is cut into parts of bounded size, own and replicated ones apart, and every pair of
parts with an own one among them is a task.  Vectors of each length have pivots and cells of their own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batches, components, cut, own_columns, parts, reduce_links, rejoin

_SLACK = 1e-9
#: Rounding of squared distances, and of distances, whose root magnifies it near 0.
_SQUARE = 1e-10
_NEAR = 1e-5
_BLOCK = 1024
_PLACED = pa.schema([("vec_id", pa.int64()), ("copies", pa.int64()), ("v", pa.list_(pa.float32())), ("cell", pa.int32()), ("d", pa.float64())])
_DEALT = pa.schema([("vec_id", pa.int64()), ("copies", pa.int64()), ("v", pa.list_(pa.float32())), ("cell", pa.int32()), ("left", pa.int32()), ("right", pa.int32()), ("part", pa.int32())])
_COUNTED = pa.schema([("cell", pa.int32()), ("own", pa.int64()), ("replicas", pa.int64())])
#: Pivots at most: their mutual distances are held by every task.
_MOST_PIVOTS = 2048
_FOUND = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("links", pa.int64())])


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2 - 2 * (x @ pivots.T)))


def _spread(x: np.ndarray) -> np.ndarray:
    """Of the unit vectors ``x``, those that no earlier one is (nearly) equal to."""
    kept: list[np.ndarray] = []
    for row in x:
        if all(((row - k) ** 2).sum() > _NEAR**2 for k in kept):
            kept.append(row)
    return np.array(kept)


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The rows of each length of the vectors in column 2."""
    lengths = pc.list_value_length(batch.column(2))
    for n in sorted(pc.unique(lengths).to_pylist()):
        yield n, batch.filter(pc.equal(lengths, n))


def _place(pivots: dict[int, tuple[int, np.ndarray]]) -> Callable:
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in it:
            for n, batch in _by_length(whole):
                first, own = pivots[n]
                d = _distances(_unit(_matrix(batch.column(2))), own)
                cell = d.argmin(1)
                yield batches({"vec_id": batch.column(0), "copies": batch.column(1), "v": batch.column(2), "cell": first + cell, "d": d[np.arange(len(d)), cell]}, _PLACED)

    return run


def _sent(batch: pa.RecordBatch, pivots: dict[int, tuple[int, np.ndarray]], between: dict[int, np.ndarray], radii: np.ndarray, r: float) -> Iterator[tuple]:
    """(rows of one length, their cells, replicated rows, the cells that get them)."""
    for n, own_rows in _by_length(batch):
        first, own = pivots[n]
        cells = slice(first, first + len(own))
        d = _distances(_unit(_matrix(own_rows.column(2))), own)
        cell = own_rows.column(3).to_numpy(zero_copy_only=False)
        near = d[np.arange(len(d)), cell - first]
        # Not divided by the gap of the pivots, so that rounding stays small where they are close.
        plane = d**2 - near[:, None] ** 2 <= 2 * (between[n][cell - first] + _NEAR) * (r + _NEAR) + _SQUARE
        send = plane & (d <= radii[cells] + r + _NEAR)
        send[np.arange(len(d)), cell - first] = False
        row, to = np.nonzero(send)
        yield own_rows, cell, row, to + first


def _count(pivots: dict[int, tuple[int, np.ndarray]], radii: np.ndarray, r: float) -> Callable:
    """Own and replicated rows of each cell, so that its parts can be sized before anything is sent."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        between = {n: _distances(own, own) for n, (_, own) in pivots.items()}
        own_rows, replicas = np.zeros(len(radii), np.int64), np.zeros(len(radii), np.int64)
        for whole in it:
            for k in range(0, len(whole), _BLOCK):
                for _, cell, _, to in _sent(whole.slice(k, _BLOCK), pivots, between, radii, r):
                    own_rows += np.bincount(cell, minlength=len(radii))
                    replicas += np.bincount(to, minlength=len(radii))
        some = np.flatnonzero(own_rows + replicas)
        yield batches({"cell": some, "own": own_rows[some], "replicas": replicas[some]}, _COUNTED)

    return run


def _deal(pivots: dict[int, tuple[int, np.ndarray]], radii: np.ndarray, own_parts: np.ndarray, all_parts: np.ndarray, r: float) -> Callable:
    """Rows to every pair of parts (left, right) of their cell that holds theirs; left is a part of own rows, right any.

    Parts are numbered own ones first.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        between = {n: _distances(own, own) for n, (_, own) in pivots.items()}
        for whole in it:
            for k in range(0, len(whole), _BLOCK):
                for rows, cell, row, to in _sent(whole.slice(k, _BLOCK), pivots, between, radii, r):
                    ids = rows.column(0).to_numpy(zero_copy_only=False)
                    mixed = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.int64)
                    which, where = np.concatenate([np.arange(len(ids)), row]), np.concatenate([cell, to])
                    part = np.concatenate([mixed % own_parts[cell], own_parts[to] + mixed[row] % np.maximum(all_parts[to] - own_parts[to], 1)])
                    times = np.where(part < own_parts[where], all_parts[where], own_parts[where])
                    again = np.repeat(np.arange(len(which)), times)
                    other = np.arange(len(again)) - np.repeat(np.cumsum(times) - times, times)
                    for j in range(0, len(again), 1 << 15):
                        some, beside = again[j : j + (1 << 15)], other[j : j + (1 << 15)]
                        got = rows.take(pa.array(which[some]))
                        yield batches(
                            {"vec_id": got.column(0), "copies": got.column(1), "v": got.column(2), "cell": where[some], "left": np.minimum(part[some], beside), "right": np.maximum(part[some], beside), "part": part[some]},
                            _DEALT,
                        )

    return run


def _join(cosine: float, own_parts: np.ndarray) -> Callable:
    def exact(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return (x * y).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum(1)))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        left, right = key[1].as_py(), key[2].as_py()
        part, ids, copies, v = table.column("part").to_numpy(), table.column("vec_id").to_numpy(), table.column("copies").to_numpy(), _matrix(table.column("v"))
        u = _unit(v)
        mine, other = np.flatnonzero(part == left), np.flatnonzero(part == right)
        # Two parts of own rows meet in one task for both; replicas are counted where they are own.
        both = bool(own_parts[key[0].as_py()] > right) and left != right
        links = np.zeros(len(ids), np.int64)
        a, b = np.empty(0, np.int64), np.empty(0, np.int64)
        for k in range(0, len(mine), _BLOCK):
            block = mine[k : k + _BLOCK]
            for j in range(0, len(other), 8 * _BLOCK):
                rest = other[j : j + 8 * _BLOCK]
                x, y = np.nonzero(u[block] @ u[rest].T >= cosine - _SLACK)
                x, y = block[x], rest[y]
                x, y = x[x != y], y[x != y]
                for z in range(0, len(x), 1 << 16):
                    xs, ys = x[z : z + (1 << 16)], y[z : z + (1 << 16)]
                    sure = exact(v[xs], v[ys]) >= cosine
                    np.add.at(links, xs[sure], copies[ys[sure]])
                    if both:
                        np.add.at(links, ys[sure], copies[xs[sure]])
                    a, b = reduce_links(np.concatenate([a, ids[xs[sure]]]), np.concatenate([b, ids[ys[sure]]]))
        linked = np.flatnonzero(links > 0)
        return pa.table(
            {"a": np.concatenate([ids[linked], a]), "b": np.concatenate([ids[linked], b]), "links": np.concatenate([links[linked], np.zeros(len(a), np.int64)])},
            schema=_FOUND,
        )

    return run


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.95, n_pivots: int = 24, rows_per_part: int = 10_000) -> DataFrame:
    """Every vector with its number of links and its group.

    Returns vec_id, n_links (other rows with cosine >= ``cosine`` in double precision), component_id (smallest vec_id
    reachable over links) and kept (whether that is the row's own).  Vectors that are null, empty, zero or hold null or
    non-finite components link with nothing; other vectors link within their length.  Equal vectors are one node with
    a number of copies; rows with a repeated id stay separate rows of that id.  An empty table gives an empty result.
    Of each length ``n_pivots`` vectors or one for every ``rows_per_part``, 2048 at most, chosen by a hash, are the pivots,
    and all that reaches the driver besides their cells' radii and counts; a part of a cell has about ``rows_per_part``
    rows, a task two parts.  The result depends on neither.
    """
    rows = own_columns(vectors, vec_id=id_col, v=vector_col).withColumn("v", F.col("v").cast("array<float>"))
    finite = F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False)))
    good = F.coalesce((F.size("v") > 0) & finite & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("good", good)
    # Equal vectors meet under their components, normalised so that both zeros agree; the cut fixes the nodes' numbers.
    good_rows = rows.where("good").select("vec_id", F.transform("v", lambda x: x + F.lit(0.0).cast("float")).alias("v"))
    nodes = cut(good_rows.groupBy("v").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("copies")).withColumn("node", F.monotonically_increasing_id()))
    by_hash = Window.partitionBy(F.size("v")).orderBy(F.xxhash64("v"), "first")
    k = max(n_pivots, min(_MOST_PIVOTS, -(-nodes.count() // rows_per_part)))
    chosen = nodes.withColumn("rank", F.row_number().over(by_hash)).where(F.col("rank") <= k).orderBy(F.size("v"), "rank").select("v").collect()
    if not chosen:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    pivots, cells = {}, 0
    for n in sorted({len(c.v) for c in chosen}):
        own = _spread(_unit(np.array([c.v for c in chosen if len(c.v) == n], np.float64)))
        pivots[n] = cells, own
        cells += len(own)
    r = float(np.sqrt(max(0.0, 2 - 2 * cosine)))
    placed = nodes.select(F.col("node").alias("vec_id"), "copies", "v").mapInArrow(_place(pivots), "vec_id long, copies long, v array<float>, cell int, d double")
    radii = np.full(cells, -np.inf)
    for cell in placed.groupBy("cell").agg(F.max("d").alias("d")).collect():
        radii[cell.cell] = cell.d
    own_rows, replicas = np.zeros(cells, np.int64), np.zeros(cells, np.int64)
    for c in placed.mapInArrow(_count(pivots, radii, r), "cell int, own long, replicas long").groupBy("cell").agg(F.sum("own").alias("own"), F.sum("replicas").alias("replicas")).collect():
        own_rows[c.cell], replicas[c.cell] = c.own, c.replicas
    own_parts = np.maximum(1, -(-own_rows // rows_per_part))
    all_parts = own_parts + -(-replicas // rows_per_part)
    dealt = placed.mapInArrow(_deal(pivots, radii, own_parts, all_parts, r), "vec_id long, copies long, v array<float>, cell int, left int, right int, part int")
    found = cut(dealt.groupBy("cell", "left", "right").applyInArrow(_join(cosine, own_parts), "a long, b long, links long"))
    degree = found.where("a = b").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("others"))
    rooted = rejoin(rejoin(nodes, degree, "node", "left"), components(found.where("a <> b").select("a", "b")), "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    of = rejoin(rooted, smallest, "root").select("v", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    linked = rejoin(good_rows, of, "v").select("vec_id", "n_links", "component_id")
    alone = rows.where("not good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
