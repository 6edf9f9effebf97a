"""The engine's operators on cases that can be checked by hand, and every query against its SQL."""

import math
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from vertexloom.functions import bessel
from vertexloom.functions import vectors as V
from vertexloom.operators import evaluation, fit, mixture, runs, series, spatial
from vertexloom.plans import registry
from vertexloom.sources import scratch

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


def _key(v):
    return "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query(name, spark, duck):
    got = registry.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    cur = duck.execute(registry.ORACLES[name])
    names = [d[0] for d in cur.description]
    want = [dict(zip(names, r, strict=True)) for r in cur.fetchall()]
    assert sorted(names) == columns
    a = sorted(tuple(_key(r[c]) for c in columns) for r in got.collect())
    b = sorted(tuple(_key(r[c]) for c in columns) for r in want)
    assert a == b


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["vertex", "subject", "label"]


def test_normaliser():
    fixed = {(500, 63): -305.4976, (500, 1174): 3460.464, (650, 63): -447.5859, (2000, 9): -1968.6774, (2000, 1174): 2543.9598}
    for (k, d), v in fixed.items():
        assert abs(bessel.log_normaliser(k, d) - v) < 1e-3
    for r in (0.1, 0.5, 0.9):
        assert abs(bessel.bessel_ratio(100 / 2 - 1, bessel.inverse_ratio(r, 100)) - r) < 1e-8
    assert math.isnan(bessel.log_normaliser(-1.0, 63))


def test_normalisation(spark):
    one = lambda x, f: list(spark.createDataFrame([(x,)], "x array<double>").select(f(F.col("x"))).first()[0])
    assert one([1.0, 1.0, 0.0, 0.0], V.literal_normal) == [0.5, 0.5, -0.5, -0.5]
    assert one([0.0, 1.0, 2.0, 1.0], V.literal_normal) == [-1.0, 0.0, 1.0, 0.0]
    assert one([0.0, 0.0], V.unit) == [0.0, 0.0] and one([3.0, 4.0], V.unit) == [0.6, 0.8]
    assert one([1.0, float("nan")], V.standardised) == [0.0, 0.0]


def test_binary_profile(spark):
    x = [-2.0, -1.0, 0.0, 1.0, 2.0]
    columns = [x, [-v for v in x], x, x, [-v for v in x], [-v for v in x]]
    bold = spark.createDataFrame([(v, f, c[f]) for v, c in enumerate(columns) for f in range(5)], "vertex long, frame long, value double")
    r = series.correlations(bold, spark.createDataFrame([(0,), (3,)], "vertex long"))
    got = {(p["vertex"], p["seed"]): p["bit"] for p in series.binary_profile(r).collect()}
    assert [got[v, 0] for v in range(6)] == [1, 0, 1, 1, 0, 0]


def test_centroids(spark):
    rows = spark.createDataFrame([(2, [0.0, 1.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0, 0.0]), (1, [1.0, 0.0, 0.0, 0.0]), (0, [1.0, 1.0, 0.0, 1.0])], "label long, x array<double>")
    got = {r["network"]: r["x"] for r in mixture.label_centroids(rows).collect()}
    assert np.allclose(got[1], np.array([3, -1, -1, -1]) / 12**0.5) and np.allclose(got[2], np.array([-1, 3, -1, -1]) / 12**0.5)


def test_winner_take_all(spark):
    labels = spark.createDataFrame(list(enumerate([1, 1, 1, 2, 2, 2, 3, 3, 3, 0])), "vertex long, label long")
    r = [(0, v, 0.9 if v < 3 else 0.1) for v in range(10)] + [(1, v, float("nan")) for v in range(10)]
    got = {x["voxel"]: tuple(x)[1:] for x in spatial.winner_take_all(spark.createDataFrame(r, "voxel long, vertex long, r double"), labels, 3).collect()}
    assert got == {0: (1, 1.0), 1: (None, None)}


def test_boundary_fill(spark):
    pairs = [(0, 1), (1, 2), (2, 3), (0, 2)]
    edges = spark.createDataFrame([(a, b, 1.0) for x in pairs for a, b in (x, x[::-1])], "src long, dst long, length double")
    got = {r["vertex"]: (r["source"], r["distance"]) for r in spatial.filled(edges, spark.createDataFrame([(0,)], "vertex long"), 1.5).collect()}
    assert got == {0: (0, 0.0), 1: (0, 1.0), 2: (0, 1.0)}


def test_censoring(spark):
    bold = spark.createDataFrame([(0, f, float(f)) for f in range(5)], "vertex long, frame long, value double")
    mask = lambda m: spark.createDataFrame(list(enumerate(m)), "frame long, keep int")
    assert series.censor_mask(bold, mask([1, 1, 0, 1, 1])).count() == 4
    assert series.censor_mask(bold, mask([1, 1, 0, 1, 1, 1])).count() == 5
    for bad in ([1, 1, 0, 0, 0], [1, 1, 1, 2, 1], [1, 1, 1, 1, 1, 1, 1]):
        with pytest.raises(ValueError):
            series.censor_mask(bold, mask(bad))


def test_pairs_and_gaps(spark):
    files = spark.createDataFrame([(f"sub-1_ses-{s}_hemi-{h}_bold.gii",) for s, h in (("1", "L"), ("1", "R"), ("2", "L"))], "path string")
    e = runs.entities(files).select("path", *[F.try_element_at("entities", F.lit(k)).alias(k) for k in ("sub", "ses", "hemi", "run")])
    got = {r["ses"]: r["problem"] for r in runs.paired(e, ["sub", "ses"]).collect()}
    assert got == {"1": None, "2": "single"} and e.where("run is null").count() == 3


def test_tolerance(spark):
    v = lambda *x: spark.createDataFrame(list(enumerate(x)), "k long, value double")
    r = evaluation.tolerance(v(1.0, 2.0, float("nan")), v(1.0, 2.5, 1.0, 7.0), ["k"], 0.1, 0.1).first()
    assert (r["n"], r["n_missing"], r["n_violations"]) == (4, 1, 3)


def test_group_fit(spark):
    """Two clear networks, one missing session, one row without signal: labels follow the directions."""
    rng = np.random.default_rng(4)
    directions = np.linalg.qr(rng.standard_normal((12, 2)))[0].T
    rows = []
    for v in range(40):
        for s in (0, 1):
            for t in (0, 1):
                if (s, t) != (1, 1):
                    x = directions[v % 2] + 0.05 * rng.standard_normal(12)
                    rows.append((v, s, t, (0 * x if v == 39 else x / np.linalg.norm(x)).tolist()))
    df = spark.createDataFrame(rows, "vertex long, subject long, session long, x array<double>")
    start = spark.createDataFrame([(k + 1, d.tolist()) for k, d in enumerate(directions)], "network long, x array<double>")
    got = {(r["vertex"], r["subject"]): r["label"] for r in fit.group_labels(df, start, fit.Settings(outer=1, middle=1, inner=3)).collect()}
    assert all(got[v, s] == (0 if v == 39 else v % 2 + 1) for v in range(40) for s in (0, 1))


def test_no_cutoff_is_an_error(spark):
    flat = spark.createDataFrame([(v, f, 1.0) for v in range(4) for f in range(5)], "vertex long, frame long, value double")
    r = series.correlations(flat, spark.createDataFrame([(0,)], "vertex long"))
    for odd in (r, r.where("false")):
        with pytest.raises(Exception, match="no positive cutoff"):
            series.binary_profile(odd).collect()
    bold = flat.withColumn("value", F.when((F.col("vertex") == 1) & (F.col("frame") == 2), float("inf")).otherwise(F.col("value") + F.col("frame") * F.col("vertex")))
    got = {x["vertex"]: x["r"] for x in series.correlations(bold, spark.createDataFrame([(2,)], "vertex long")).collect()}
    assert got[0] == got[1] == 0.0 and abs(got[3] - 1) < 1e-12


def test_dimension_and_assets(spark):
    with pytest.raises(ValueError):
        bessel.log_normaliser(700.0, 1800)
    labels = spark.range(64).selectExpr("id as vertex", "id % 16 as label")
    assert evaluation.verified_labels(labels).count() == 64
    for odd in (labels.where("label <> 3"), labels.withColumn("label", F.col("label") + 1), labels.withColumn("label", F.nullif("label", F.lit(2)))):
        with pytest.raises(ValueError):
            evaluation.verified_labels(odd)


def test_errors_of_geometry(spark):
    side = spark.createDataFrame([(0, 1), (5, 2)], "vertex long, label long")
    assert {r["vertex"] for r in series.hemispheres(side, side, 6).collect()} == {0, 5, 6, 11}
    with pytest.raises(Exception, match="outside"):
        series.hemispheres(side, side, 5).collect()
    v = spark.range(4).selectExpr("id as vertex")
    edges = spark.createDataFrame([(0, 1, 1.0), (1, 0, 1.0)], "src long, dst long, length double")
    one = v.where("vertex = 0")
    with pytest.raises(Exception, match="further"):
        spatial.boundary_filled(v, edges, one, 1.5).collect()
    finer = spark.createDataFrame([(2, 0, 1.4), (3, 0, 1.6)], "vertex long, source long, distance double")
    got = {r["vertex"]: (r["source"], r["distance"]) for r in spatial.boundary_filled(v, edges, one, 1.5, zero=True, refined=finer).collect()}
    assert got == {0: (0, 0.0), 1: (0, 1.0), 2: (0, 1.4), 3: (-1, None)}
    mask, one_value = v.select(F.col("vertex").alias("voxel"), F.lit(True).alias("inside")), spark.createDataFrame([(0, 1.0)], "place long, value double")
    with pytest.raises(ValueError):
        spatial.scattered(mask, one_value, strict=True)
    assert {r["voxel"]: r["value"] for r in spatial.scattered(mask, one_value).collect()} == {0: 1.0, 1: 0.0, 2: 0.0, 3: 0.0}
    assert {r["vertex"] for r in series.hemispheres(side.where("vertex = 0"), side, 2, 6).collect()} == {0, 2, 7}


def test_nearest_far_away(spark):
    rng = np.random.default_rng(8)
    p, q = rng.normal(size=(80, 3)) * 50, np.concatenate([rng.normal(size=(30, 3)), [[500.0, 0, 0]]])
    rows = lambda x, name: spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], f"{name} long, x double, y double, z double")
    got = {r["vertex"]: r["seed"] for r in spatial.nearest(rows(p, "vertex"), rows(q, "seed")).collect()}
    assert got == {i: int(((q - v) ** 2).sum(axis=1).argmin()) for i, v in enumerate(p)}


def test_shared_folder(monkeypatch):
    class Conf:
        def get(self, key, default):
            return None

    class Session:
        conf = Conf()
        sparkContext = type("C", (), {"master": "spark://host:7077"})()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch.shared_folder(Session())


def test_saved_model(spark, tmp_path):
    """Subjects and sessions keep their ids; labels come back for those that are asked for."""
    rng = np.random.default_rng(3)
    directions = np.linalg.qr(rng.standard_normal((9, 2)))[0].T
    rows = [(v, s, t, x.tolist()) for v in range(12) for s, t in ((7, "x"), (9, "x"), (9, "y")) for x in [directions[v % 2] + 0.02 * rng.standard_normal(9)]]
    df = spark.createDataFrame(rows, "vertex long, subject long, session string, x array<double>")
    start = spark.createDataFrame([(k + 1, d.tolist()) for k, d in enumerate(directions)], "network long, x array<double>")
    m = fit.group_fit(df, start, fit.Settings(start=20.0, outer=1, middle=1, inner=2))
    fit.save(m, spark, f"{tmp_path}/m")
    t = fit.load(spark, f"{tmp_path}/m")
    assert {(r["subject"], r["session"]) for r in t["directions"].where("kind = 'session'").collect()} == {(7, "x"), (9, "x"), (9, "y")}
    assert {r["subject"] for r in t["posterior"].collect()} == {7, 9} and t["record"].count() == 1 and t["prior"].count() == 12
    got = {(r["vertex"], r["subject"]): r["label"] for r in fit.results(spark, f"{tmp_path}/m", [9]).collect()}
    assert got == {(v, 9): v % 2 + 1 for v in range(12)}
    with pytest.raises(ValueError, match="no subjects"):
        fit.results(spark, f"{tmp_path}/m", [8])
    m.posterior = None
    fit.save(m, spark, f"{tmp_path}/n")
    with pytest.raises(ValueError, match="posterior"):
        fit.load(spark, f"{tmp_path}/n")
    assert [fit.starting(d) for d in (1199, 1200, 1799)] == [500.0, 650.0, 650.0]
    with pytest.raises(ValueError):
        fit.starting(1800)
