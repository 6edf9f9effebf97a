"""Recordings as keys: profiles, cutoffs and checks of many recordings in one job, against NumPy on each of them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vertexloom.operators import blocks, mixture, recordings
from vertexloom.sources.scratch import written

KEYS = ["subject", "session"]


def table(spark, runs):
    """runs: {(subject, session): frames x vertices}."""
    rows = [(s, t, v, f, float(x[f, v])) for (s, t), x in runs.items() for f in range(x.shape[0]) for v in range(x.shape[1])]
    return spark.createDataFrame(rows, "subject string, session long, vertex long, frame long, value double").repartition(3)


def pearson(x, seeds):
    with np.errstate(invalid="ignore", divide="ignore"):
        c = x - x.mean(axis=0)
        z = np.where((n := np.linalg.norm(c, axis=0)) > 0, c / n, 0)
    z[:, ~np.isfinite(x).all(axis=0)] = 0
    return z.T @ z[:, seeds]


@pytest.fixture(scope="module")
def runs():
    rng = np.random.default_rng(6)
    out = {("a", 1): rng.normal(size=(20, 31)), ("a", 2): rng.normal(size=(25, 31)), ("b", 1): rng.integers(0, 3, (7, 31)).astype(float), ("c", 9): rng.normal(size=(12, 8)) * 1e-9}
    out["a", 2][:, 4] = 0
    out["b", 1][3, 30] = np.inf
    return out


@pytest.mark.parametrize("small", [False, True])
def test_profiles_and_cutoffs(spark, monkeypatch, runs, small):
    if small:  # many parts and slices
        monkeypatch.setattr(recordings, "PART_VERTICES", 8)
        monkeypatch.setattr(recordings, "SLICE_BYTES", 8 * 25 * 3)
    seeds = spark.createDataFrame([(v,) for v in (0, 3, 4, 7, 30)], "vertex long")
    rows = written(recordings.profiles(table(spark, runs), seeds, KEYS), "rows")
    got = {(r["subject"], r["session"], r["vertex"], r["seed"]): r["r"] for r in recordings.by_seed(rows, KEYS, "r", "r").collect()}
    bits = {tuple(r)[:4]: r["bit"] for r in recordings.by_seed(recordings.binary(rows, KEYS, digits=9), KEYS, "bits", "bit").select(*KEYS, "vertex", "seed", "bit").collect()}
    at = {(r["subject"], r["session"]): (r["rank"], r["cutoff"]) for r in recordings.cutoffs(rows, KEYS, digits=9).collect()}
    assert len(at) == 4
    for (s, t), x in runs.items():
        own = [v for v in (0, 3, 4, 7, 30) if v < x.shape[1]]
        want = np.round(pearson(x, own), 9)
        rank = int(np.floor(want.size * 0.1 + 0.5))
        cutoff = np.sort(want.ravel())[-rank]
        assert at[s, t] == (rank, cutoff)
        for v in range(x.shape[1]):
            for j, seed in enumerate(own):
                assert abs(got[s, t, v, seed] - want[v, j]) < 1e-8 and bits[s, t, v, seed] == (want[v, j] >= cutoff)
    assert len(got) == len(bits) == sum(x.shape[1] * sum(v < x.shape[1] for v in (0, 3, 4, 7, 30)) for x in runs.values())


def test_exact_ranks(spark):
    """Values of every size and sign, ties beyond the rank, and neighbours in their last bit."""
    rng = np.random.default_rng(7)
    values = {
        "ties": np.repeat([0.5, 0.25, -0.5], 400),
        "bits": np.array([0.3 + k * 2.0**-54 for k in range(100)]),
        "sizes": np.concatenate([10.0 ** rng.uniform(-300, 300, 200), -(10.0 ** rng.uniform(-300, 300, 50))]),
        "small": np.array([5e-324, 1e-310, 0.0, -0.0, 2e-308, 1.0]),
    }
    rows = [(k, v, 0, [0], [float(x)]) for k, a in values.items() for v, x in enumerate(a)]
    df = spark.createDataFrame(rows, "run string, vertex long, slice int, seeds array<long>, r array<double>").repartition(4)
    for share in (0.1, 0.5):
        got = {r["run"]: (r["rank"], r["cutoff"]) for r in recordings.cutoffs(df.where("run <> 'small' or r[0] > 0").where(f"run <> 'small' or {share} > 0.2"), ["run"], share).collect()}
        for k, a in values.items():
            a = a[a > 0] if k == "small" else a
            rank = int(np.floor(len(a) * share + 0.5))
            if rank:
                assert got[k] == (rank, np.sort(a)[-rank])
        assert ("small" in got) == (share > 0.2)


@pytest.mark.parametrize("odd", [[0.0, 0.0, -1.0] * 5, [0.5], [float("nan")] * 20])
def test_errors_name_the_recording(spark, odd):
    rows = [("good", 0, 0, [0] * 20, [0.5] * 20), ("bad", 1, 0, [0] * len(odd), odd)]
    df = spark.createDataFrame(rows, "run string, vertex long, slice int, seeds array<long>, r array<double>")
    with pytest.raises(Exception, match="no positive cutoff for run bad"):
        recordings.cutoffs(df, ["run"]).collect()
    assert recordings.cutoffs(df.where("run = 'good'"), ["run"]).first()["cutoff"] == 0.5
    assert recordings.cutoffs(df.where("false"), ["run"]).count() == 0


def test_problems(spark, runs):
    bad = {k: v.copy() for k, v in runs.items()}
    bad["d", 1] = runs["a", 1][:2]
    bad["a", 1][:, 3] = 7.0
    bad["a", 2][:, 20] = 5.0
    cortex = spark.range(31).selectExpr("id as vertex", "id <> 29 as cortex")
    seeds = spark.range(4).selectExpr("id as vertex")
    found = {tuple(r) for r in recordings.problems(table(spark, bad), KEYS, cortex, seeds).collect()}
    assert ("a", 1, "a seed that does not vary", 1) in found and ("a", 2, "a series of zeros", 1) in found and ("a", 2, "a series that does not vary", 1) in found
    assert ("b", 1, "values that are not finite", 1) in found and ("d", 1, "fewer frames than needed", 31) in found
    loose = {tuple(r)[:3] for r in recordings.problems(table(spark, bad), KEYS, cortex, seeds, allow_zero=True).collect()}
    assert ("a", 2, "a series of zeros") not in loose and not any(x[:2] == ("c", 9) for x in found)


def test_directions_beyond_a_slice(spark, monkeypatch):
    """All directions count, in the order of networks, however few of them travel at once."""
    rng = np.random.default_rng(9)
    x, y = rng.normal(size=(40, 6)), rng.normal(size=(7, 6))
    rows = spark.createDataFrame([(v, a.tolist()) for v, a in enumerate(x)], "vertex long, x array<double>")
    directions = spark.createDataFrame([(k + 3, a.tolist()) for k, a in enumerate(y)], "network long, x array<double>").repartition(3)
    for size in (32 << 20, 100, 50):
        monkeypatch.setattr(blocks, "SLICE_BYTES", size)
        got = {r["vertex"]: r["dots"] for r in mixture.dots(rows, directions).collect()}
        assert all(np.allclose(got[v], y @ x[v]) for v in range(40))
        best = {r["vertex"]: r["network"] for r in mixture.nearest(rows, directions).collect()}
        assert best == {v: int((y @ x[v]).argmax()) + 3 for v in range(40)}
        names, vectors = blocks.every_vector(directions, "network")
        assert names.tolist() == list(range(3, 10)) and np.allclose(vectors, y)
    empty = mixture.dots(rows, directions.where("false")).first()
    assert empty["dots"] == []


def test_weighted_sums_keep_networks_with_weight(spark):
    rows = spark.createDataFrame([(0, "p", None, [1.0, 2.0], [0.5, 0.0]), (1, "p", None, [3.0, 4.0], [0.25, 0.0]), (1, "q", 2, [3.0, 4.0], [0.0, 1.0])], "vertex long, subject string, session long, x array<double>, w array<double>")
    got = {(r["subject"], r["session"], r["network"]): r["x"] for r in blocks.weighted_sums(rows, ["subject", "session"], "w", [4, 9], "network").collect()}
    assert got == {("p", None, 4): [1.25, 2.0], ("q", 2, 9): [3.0, 4.0]}


def test_infinity_is_not_usable(spark):
    from vertexloom.operators import evaluation

    rows = spark.createDataFrame([(0, 0, 0, [1.0, float("inf")]), (1, 0, 0, [1.0, 2.0]), (2, 0, 0, [float("nan"), 1.0])], "vertex long, subject long, session long, x array<double>")
    cortex = spark.range(3).select(F.col("id").alias("vertex"), F.lit(True).alias("cortex"))
    assert {r["vertex"]: r["n_usable"] for r in evaluation.coverage(rows, cortex).collect()} == {0: 0, 1: 1, 2: 0}
