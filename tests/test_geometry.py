"""Nearest seeds, shortest paths and seeding of k-means on hard cases, against plain Python."""

import heapq

import numpy as np
import pytest

from vertexloom.operators import mixture, spatial


def table(spark, x, name):
    return spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], f"{name} long, x double, y double, z double").repartition(3)


def brute(p, q):
    d = np.round(np.sqrt(((p[:, None] - q[None]) ** 2).sum(axis=2)), 9)
    return {i: (int(row.argmin()), float(row.min())) for i, row in enumerate(d)}


def cases():
    rng = np.random.default_rng(8)
    ball = rng.normal(size=(300, 3))
    sphere = ball / np.linalg.norm(ball, axis=1, keepdims=True)
    yield "clustered seeds", rng.normal(size=(200, 3)) * 5, np.concatenate([rng.normal(size=(250, 3)) * 1e-3, rng.normal(size=(30, 3)) * 100])
    yield "far points", rng.normal(size=(100, 3)) * 1e4, ball
    yield "centre of a sphere", np.concatenate([np.zeros((5, 3)), sphere[:50] * 1.5]), sphere
    yield "equal seeds", np.array([[0.0, 0, 0], [1, 1, 1]]), np.concatenate([np.ones((200, 3)), np.zeros((200, 3))])
    yield "a grid with ties", np.argwhere(np.ones((6, 6, 1))) + 0.5, np.argwhere(np.ones((8, 8, 2))).astype(float)
    yield "one seed", ball[:20], ball[:1]


@pytest.mark.parametrize("case", list(cases()), ids=lambda c: c[0])
def test_nearest(spark, case):
    _, p, q = case
    p = p.astype(float)
    got = {r["vertex"]: (r["seed"], r["distance"]) for r in spatial.nearest(table(spark, p, "vertex"), table(spark, q, "seed"), size=8).collect()}
    want = brute(p, q)
    assert {v: x[0] for v, x in got.items()} == {v: x[0] for v, x in want.items()} and all(abs(got[v][1] - want[v][1]) < 1e-8 for v in want)


def test_cells_are_small(spark):
    rng = np.random.default_rng(2)
    q = np.concatenate([np.repeat([[1.0, 2, 3]], 500, axis=0), rng.normal(size=(300, 3)) * 1e-6, rng.normal(size=(100, 3))])
    own = spatial.cells(table(spark, q, "seed"), 16)
    assert own.count() == 401 and own.groupBy("cell").count().agg({"count": "max"}).first()[0] <= 16


def test_points_without_place(spark):
    p = spark.createDataFrame([(1, float("nan"), 0.0, 0.0), (2, None, 0.0, 0.0), (3, 0.0, 0.0, 1.0)], "vertex long, x double, y double, z double")
    q = table(spark, [(0.0, 0.0, 0.0)], "seed")
    assert {tuple(r) for r in spatial.nearest(p, q).collect()} == {(1, None, None), (2, None, None), (3, 0, 1.0)}
    assert {r["seed"] for r in spatial.nearest(p, q.where("false")).collect()} == {None}


def dijkstra(edges, valid, limit):
    near = {}
    for a, b, n in edges:
        near.setdefault(a, []).append((b, n))
    best, heap = {}, [(0.0, v, v) for v in valid]
    while heap:
        d, source, v = heapq.heappop(heap)
        if v in best:
            continue
        best[v] = source, d
        for u, n in near.get(v, ()):
            if round(d + n, 9) <= limit:
                heapq.heappush(heap, (round(d + n, 9), source, u))
    return best


@pytest.mark.parametrize(("width", "seed"), [(None, 1), (0.2, 2), (50.0, 3)])
def test_paths(spark, width, seed):
    rng = np.random.default_rng(seed)
    pairs = {tuple(sorted(p)) for p in rng.integers(0, 120, (300, 2)).tolist() if p[0] != p[1]}
    edges = [(a, b, n) for x, y in pairs for n in [float(rng.choice([0.5, 1.0, 1.5, 4.0]))] for a, b in ((x, y), (y, x))]
    valid = [3, 40, 41, 90]
    df = spark.createDataFrame(edges, "src long, dst long, length double")
    got = {r["vertex"]: (r["source"], r["distance"]) for r in spatial.filled(df, spark.createDataFrame([(v,) for v in valid], "vertex long"), 6.0, width).collect()}
    assert got == dijkstra(edges, valid, 6.0)


def test_a_long_chain_moves_only_its_front(spark, monkeypatch):
    """A chain of 40 vertices: each round improves one vertex on each side, whatever is known."""
    sizes, plain = [], spatial.written

    def seen(df, name):
        out = plain(df, name)
        if name == "front":
            sizes.append(out.count())
        return out

    monkeypatch.setattr(spatial, "written", seen)
    edges = spark.createDataFrame([(a, b, 1.0) for v in range(39) for a, b in ((v, v + 1), (v + 1, v))], "src long, dst long, length double")
    got = spatial.filled(edges, spark.createDataFrame([(20,)], "vertex long"), 12.0).collect()
    assert {r["vertex"]: r["distance"] for r in got} == {v: float(abs(v - 20)) for v in range(8, 33)} and max(sizes) <= 2


def test_seeding(spark):
    rng = np.random.default_rng(11)
    centres = np.linalg.qr(rng.normal(size=(12, 6)))[0].T
    x = np.concatenate([c + 0.05 * rng.normal(size=(n, 12)) for c, n in zip(centres, (400, 100, 30, 20, 10, 8), strict=True)])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(9999, [0.0] * 12)], "vertex long, x array<double>").repartition(4)
    cost = lambda c: float((2 - 2 * (x @ np.asarray(c).T).max(axis=1)).sum())
    found = [[r["x"] for r in mixture.seeded(rows, 6, seed=1).orderBy("network").collect()] for _ in range(2)]
    assert found[0] == found[1] and len(found[0]) == 6
    plain = [cost(mixture._spread(x, np.ones(len(x)), 6, np.random.default_rng(s), 0)) for s in range(20)]
    assert cost(found[0]) <= 1.2 * np.mean(plain) and cost(found[0]) <= 1.2 * cost(centres)
    with pytest.raises(ValueError, match="different"):
        mixture.seeded(rows.where("vertex < 3").selectExpr("vertex", "transform(sequence(1, 12), i -> if(i = 1, 1D, 0D)) as x"), 2)
    with pytest.raises(ValueError, match="no rows"):
        mixture.seeded(rows.where("vertex = 9999"), 2)
