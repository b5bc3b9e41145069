import numpy as np

from prosemill.llm import vectors


def test_against_all_pairs(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(120, 8)).astype(np.float32)
    x = np.concatenate([x, x[:10] + 0.02 * rng.normal(size=(10, 8)).astype(np.float32), x[:1], x[:1], 3 * x[1:2]])
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    rows += [(900, None, 0), (901, [0.0] * 8, 0), (902, [float("nan")] * 8, 0), (903, [], 0), (904, [1.0, 2.0], 0), (905, [float("inf")] + [0.0] * 7, 0), (906, [None] + [1.0] * 7, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    n = np.sqrt((x.astype(float) ** 2).sum(1))
    link = (x.astype(float) @ x.astype(float).T) / n[:, None] / n[None] >= 0.95
    root = list(range(len(x)))
    for a, b in zip(*np.nonzero(link), strict=True):
        ra, rb = sorted((root[a], root[b]))
        root = [ra if r == rb else r for r in root]
    for options in ({}, {"n_pivots": 3, "rows_per_part": 10}):
        got = {r.vec_id: r for r in vectors.near_duplicates(df, **options).collect()}
        assert len(got) == len(rows)
        for i in range(len(x)):
            assert (got[i].n_links, got[i].component_id, got[i].kept) == (int(link[i].sum()) - 1, root[i], root[i] == i)
        for i in range(900, 907):
            assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)


def test_clustered_vectors_of_64_dimensions(spark):
    """Clusters, ties, a repeated id and parts of cells; shuffled rows follow the vectors where they are clustered."""
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(40, 64))
    x = (np.repeat(centres, 12, 0) + 0.12 * rng.normal(size=(480, 64))).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(0, x[0].tolist()), (999, (2 * x[5]).tolist())]
    every = np.array([v for _, v in rows], np.float64)
    n = np.sqrt((every**2).sum(1))
    link = every @ every.T / n[:, None] / n[None] >= 0.95
    np.fill_diagonal(link, False)
    ids = np.array([i for i, _ in rows])
    label = ids.copy()
    while True:
        new = np.array([min(label[k], label[link[k]].min(initial=label[k])) for k in range(len(ids))])
        if (new == label).all():
            break
        label = new
    want = sorted(zip(ids.tolist(), link.sum(1).tolist(), label.tolist(), strict=True))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "'x' AS cell", "1 AS part")
    for options in ({}, {"n_pivots": 5, "rows_per_part": 25}, {"n_pivots": 1, "rows_per_part": 60}):
        got = sorted((r.vec_id, r.n_links, r.component_id) for r in vectors.near_duplicates(df, **options).collect())
        assert got == want
    assert sum(k for _, k, _ in want) > 1000


def test_empty(spark):
    assert vectors.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_scaled_copies_and_lengths(spark):
    """Parallel pivots lose no link, and vectors of every length are joined."""
    rng = np.random.default_rng(7)
    one = rng.normal(size=64).astype(np.float32)
    x = [*(one * rng.uniform(0.2, 5, size=(270, 1)).astype(np.float32)), *rng.normal(size=(30, 64)).astype(np.float32)]
    short = [[1.0, 2.0], [2.0, 4.0], [2.0, -1.0], [4.0, -2.0], [1.0, 2.0]]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(1000 + i, v) for i, v in enumerate(short)], "vec_id long, embedding array<float>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_duplicates(df).collect()}
    assert [got[i] for i in range(270)] == [(269, 0)] * 270
    assert [got[i] for i in range(270, 300)] == [(0, i) for i in range(270, 300)]
    assert [got[1000 + i] for i in range(5)] == [(2, 1000), (2, 1000), (1, 1002), (1, 1002), (2, 1000)]
