"""The group fit with one subject in the driver at a time equals the one with all; vertices that a subject lacks stay unassigned."""

import os

import numpy as np
from tests import plain_fit
from tests.test_fit import frames

from vertexloom.operators import fit
from vertexloom.sources import scratch


def test_slices(spark, monkeypatch):
    x, mu = plain_fit.case("missing", n=60, d=21)
    rows, directions = frames(spark, x, mu)
    rows = rows.where("not (subject = 1 and vertex = 7)")
    at = fit.Settings(start=50.0, outer=2, middle=2, inner=4)
    whole = fit.group_fit(rows, directions, at)
    assert len(whole.subject_vectors.slices) == 1
    monkeypatch.setattr(fit, "SLICE_BYTES", 1)
    parts = fit.group_fit(rows, directions, at)
    assert len(parts.subject_vectors.slices) == 3
    for name in ("mu", "psi", "nu", "epsilon", "sigma", "kappa", "record"):
        assert np.allclose(getattr(whole, name), getattr(parts, name), rtol=1e-9)
    state = lambda m: {r["vertex"]: (r["theta"], r["lam"]) for r in m.state.collect()}
    a, b = state(whole), state(parts)
    assert a.keys() == b.keys() and all(np.allclose(a[v][k], b[v][k], atol=1e-9) for v in a for k in (0, 1))
    assert a[7][1][3:6] == [0.0, 0.0, 0.0] and sum(a[6][1][3:6]) > 0.99
    assert fit.posterior(parts).where("subject = 1 and vertex = 7").count() == 0


def test_old_state_goes(spark):
    """However many iterations a fit takes, what it leaves in the shared folder is one state."""
    x, mu = plain_fit.case("complete", n=30, d=11)
    rows, directions = frames(spark, x, mu)
    folder = f"{scratch.shared_folder(spark)}/{spark.sparkContext.applicationId}"
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    fit.group_fit(rows, directions, fit.Settings(start=30.0, outer=2, middle=2, inner=5))
    left = [x for x in os.listdir(folder) if x not in before]
    assert sum(x.startswith("state") for x in left) == 1 and sum(x.startswith("prior") for x in left) == 1
