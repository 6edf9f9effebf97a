"""The fits against plain NumPy."""

import numpy as np
import pytest
from tests import plain_fit

from vertexloom.operators import fit, individual


def frames(spark, x, mu):
    rows = [(v, s, t, x[v, s, t].tolist()) for v in range(x.shape[0]) for s in range(x.shape[1]) for t in range(x.shape[2]) if not np.isnan(x[v, s, t]).any()]
    data = spark.createDataFrame(rows, "vertex long, subject long, session long, x array<double>").repartition(3)
    return data, spark.createDataFrame([(k + 1, d.tolist()) for k, d in enumerate(mu)], "network long, x array<double>")


@pytest.mark.parametrize("kind", ["complete", "missing", "soft", "single"])
def test_group_fit_cases(spark, kind):
    x, mu = plain_fit.case(kind)
    want, got = plain_fit.group(x, mu), fit.group_fit(*frames(spark, x, mu))
    assert np.allclose(got.record, want["record"], rtol=5e-6, atol=0.1) and len(got.record) == len(want["record"])
    for a, b in ((got.mu, want["mu"]), (got.psi, want["psi"])):
        assert np.allclose(a, b, rtol=1e-4, atol=2e-5)
    for a, b in ((got.epsilon, want["epsilon"]), (got.sigma, want["sigma"]), (got.kappa, want["kappa"])):
        assert np.allclose(a, b, rtol=2e-4, atol=0.05)
    for (s, t), nu in want["nu"].items():
        assert got.there[s, t] and np.allclose(got.nu[s, t], nu, rtol=1e-4, atol=2e-5)
    assert got.there.sum() == len(want["nu"])
    state = sorted(got.state.collect(), key=lambda r: r["vertex"])
    assert np.allclose([r["theta"] for r in state], want["theta"], rtol=1e-4, atol=1e-4)
    assert np.allclose(np.array([r["lam"] for r in state]).reshape(want["lam"].shape), want["lam"], rtol=1e-4, atol=1e-4)


@pytest.mark.parametrize("slice_bytes", [64 << 20, 1])
def test_individual_fit(spark, monkeypatch, slice_bytes):
    """Three subjects, one of them with one session, on a chain that does not cross hemispheres, all at once and one after another."""
    monkeypatch.setattr(individual, "SLICE_BYTES", slice_bytes)
    x, mu = plain_fit.case("missing", n=60, d=21)
    rng = np.random.default_rng(5)
    theta = rng.dirichlet(np.ones(3), size=60)
    near = [[u for u in (v - 1, v + 1) if 0 <= u < 60 and (u < 30) == (v < 30)] for v in range(60)]
    rows, directions = frames(spark, x, mu)
    edges = spark.createDataFrame([(v, u) for v in range(60) for u in near[v]], "src long, dst long")
    prior = spark.createDataFrame([(v, theta[v].tolist()) for v in range(60)], "vertex long, theta array<double>")
    at = individual.Settings(start=50.0, prior=2.0, smooth=1.0, outer=3, inner=3, numerical=10, sweeps=4)
    got = individual.fit(rows, edges, individual.Priors(directions, prior, 40.0, 30.0), at)
    p = {(r["vertex"], r["subject"]): r["p"] for r in got.posterior.collect()}
    for s in range(3):
        own = x[:, s][:, ~np.isnan(x[:, s]).any(axis=(0, 2))]
        lam, kappa, costs = plain_fit.individual(own, mu, theta, near, 30.0, 40.0, 50.0, 2.0, 1.0, 3, 3, 10, 4)
        assert np.allclose([p[v, s] for v in range(60)], lam, atol=1e-6)
        assert np.isclose(got.kappa[s], kappa, rtol=1e-6) and np.allclose(got.costs[s], costs, rtol=1e-6)
