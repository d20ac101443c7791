import numpy as np

from pyspark.sql import functions as F

from memloom.llm import vectors as vx

DIM = 16


def data(n=1500, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, DIM))
    x[n // 2 : n // 2 + n // 4] = x[: n // 4] + 0.15 * rng.normal(size=(n // 4, DIM))
    return x.astype(np.float32)


def brute(x, k, least):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(u @ u.T, 6)
    np.fill_diagonal(s, -2)
    out = {}
    for i in range(len(x)):
        order = np.lexsort((np.arange(len(x)), -s[i]))[:k]
        out[f"e{i:05}"] = [f"e{j:05}" for j in order if s[i, j] >= least]
    return out


def frame(spark, x, extra=()):
    rows = [("vector", f"e{i:05}", v.tolist(), 1) for i, v in enumerate(x)] + list(extra)
    return spark.createDataFrame(rows, "space string, id string, v array<float>, rep int")


def test_recall(spark, monkeypatch):
    monkeypatch.setattr(vx, "LIST_TARGET", 64)
    x = data()
    true = brute(x, 5, 0.9)
    got = {}
    for r in vx.nearest_entities(frame(spark, x), DIM, 5, 0.9).collect():
        got.setdefault(r.id, []).append((r.rank, r.other))
    hits = sum(len(set(v) & {o for _, o in got.get(i, [])}) for i, v in true.items())
    assert hits >= 0.97 * sum(map(len, true.values()))
    assert all({o for _, o in v} <= set(true[i]) for i, v in got.items())  # nothing below the bound


def test_wide_search_recall(spark, monkeypatch):
    monkeypatch.setattr(vx, "LIST_TARGET", 64)
    x = data(800)
    true = brute(x, 5, -1)
    rows = vx.nearest_entities(frame(spark, x), DIM, 5, asking_ids=F.col("id").endswith("0"), probe=64, probe_ratio=3.0).collect()
    hits = sum(r.other in true[r.id] for r in rows)
    assert {r.id for r in rows} == {i for i in true if i.endswith("0")} and hits >= 0.9 * len(rows)


def test_copies_and_dirty_rows(spark):
    a, b = np.eye(DIM, dtype=np.float32)[0], (np.eye(DIM)[0] + 0.1 * np.eye(DIM)[1]).astype(np.float32)
    extra = [("vector", f"c{i}", a.tolist(), 1) for i in range(9)] + [("vector", "c3", a.tolist(), 1), ("vector", "d", b.tolist(), 1)]
    extra += [("vector", "n1", None, 1), ("vector", "n2", [], 1), ("vector", "n3", [0.0] * DIM, 1), ("vector", "n4", [float("nan")] * DIM, 1), ("vector", "n5", [1.0] * 3, 1),
              ("vector", "n6", [1.0] * (DIM - 1) + [None], 1), ("vector", None, a.tolist(), 1), ("vector", "n7", [float("inf")] * DIM, 1)]
    got = {}
    for r in vx.nearest_entities(frame(spark, data(0), extra), DIM, 5, 0.9).collect():
        got.setdefault(r.id, []).append((r.rank, r.other))
    assert set(got) == {*(f"c{i}" for i in range(9)), "d"}
    assert [o for _, o in sorted(got["c0"])] == ["c1", "c2", "c3", "c4", "c5"] and [o for _, o in sorted(got["c8"])] == ["c0", "c1", "c2", "c3", "c4"]
    assert [o for _, o in sorted(got["d"])] == ["c0", "c1", "c2", "c3", "c4"]


def test_empty_and_single(spark):
    assert vx.nearest_entities(frame(spark, data(0)), DIM, 5).count() == 0
    assert vx.nearest_entities(frame(spark, data(8)[:1]), DIM, 5).count() == 0


def test_graph_finds_nearest_centroids():
    x = data(3000, 5)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = vx.CentroidGraph(vx.fit_centroids(x, 400))
    ids, _ = g.nearest(x, 3)
    best = (x @ g.c.T).argmax(1)
    assert (ids[:, 0] == best).mean() > 0.97


def test_lists_of_lists(spark):
    """Few lists of the first level, so that each gets lists of its own: recall holds and no row is false."""
    x = data(6000, 3)
    true = brute(x, 5, 0.9)
    got = {}
    for r in vx.nearest_entities(frame(spark, x), DIM, 5, 0.9, most_lists=3, split_rows=500).collect():
        got.setdefault(r.id, set()).add(r.other)
    hits = sum(len(set(v) & got.get(i, set())) for i, v in true.items())
    assert hits >= 0.99 * sum(map(len, true.values())) and all(v <= set(true[i]) for i, v in got.items())


def test_clusters_are_balanced():
    rng = np.random.default_rng(4)
    x = np.concatenate([data(2000, 6), data(1, 7) + 0.05 * rng.normal(size=(4000, DIM)).astype(np.float32)])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    c = vx.fit_centroids(x, 60)
    size = np.bincount((x @ c.T).argmax(1), minlength=len(c))
    assert size.max() <= 3 * size.mean()


def test_cosines_in_double_precision(spark):
    x = data(300, 9)
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    for r in vx.nearest_entities(frame(spark, x), DIM, 3).collect():
        assert abs(r.s - u[int(r.id[1:])] @ u[int(r.other[1:])]) < 1e-12
