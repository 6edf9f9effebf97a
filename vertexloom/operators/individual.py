"""The individual fit: posteriors of each subject's vertices under the group's priors, smoothed over the mesh, by Spark jobs.

Subjects are independent of each other, and each has its own concentration and directions. They are fitted in slices, as many at a time as have
directions of a bounded size; within a slice all vertices are worked on at once. Rows are bucketed by vertex, so that only posteriors are moved when
they meet their rows. Smoothing sums the posteriors of neighbours by a join over the edges. A subject that has converged keeps
its state while others go on.

Literal rules that are kept: concentration and session directions start anew in every outer step; sweeps stop on the mean absolute change; the
prior's weight counts in the inner cost and not in the outer one; vertices that no network is nearer to at the start stay unassigned.
A session that a subject does not have has no rows and does not count; a vertex without a prior has the smallest one; one
without neighbours is not smoothed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vertexloom.functions.bessel import inverse_ratio, log_normaliser
from vertexloom.functions.vectors import total
from vertexloom.sources.scratch import bucketed, bucketed_away, discarded, kept_path, written

from .blocks import every_vector
from .fit import added, array, starting, unit_rows
from .mixture import softmax

#: Bytes of the session directions of the subjects that are fitted at a time.
SLICE_BYTES = 64 << 20
TINY = 2.2250738585072014e-308


@dataclass
class Priors:
    """directions: network, x; theta: vertex, theta (an array); concentrations of subjects about the group and of sessions about a subject."""

    directions: DataFrame
    theta: DataFrame
    epsilon: float | list[float] = 500.0
    sigma: float | list[float] = 500.0


@dataclass
class Settings:
    start: float | None = None
    prior: float = 100.0
    smooth: float = 50.0
    outer: int = 50
    inner: int = 101
    numerical: int = 50
    sweeps: int = 100
    epsilon: float = 1e-4


@dataclass
class Fitted:
    """posterior: vertex, subject, p; concentration of each subject; cost after each of its outer steps."""

    posterior: DataFrame
    kappa: dict[int, float] = field(default_factory=dict)
    costs: dict[int, list[float]] = field(default_factory=dict)


def log_prior(theta: str = "theta") -> Column:
    return F.transform(theta, lambda v: F.ln(F.greatest(v, F.lit(TINY))))


def sweep(scores: DataFrame, theta: DataFrame, potentials: DataFrame, prior: float, smooth: float) -> DataFrame:
    """(vertex, subject, p): one sweep from scores (vertex, subject, score), theta (vertex, theta), potentials (vertex, subject, v)."""
    j = scores.join(theta, "vertex").join(potentials, ["vertex", "subject"])
    score = F.zip_with(F.zip_with("score", log_prior(), lambda a, t: a + prior * t), "v", lambda a, v: a - 2 * smooth * v)
    return j.select("vertex", "subject", softmax(score).alias("p"))


def fit(rows: DataFrame, edges: DataFrame, priors: Priors, settings: Settings | None = None) -> Fitted:
    """Fit rows (vertex, subject, session, x) on a mesh of edges (src, dst)."""
    at, mu = settings or Settings(), every_vector(priors.directions, "network")[1]
    at = replace(at, start=starting(mu.shape[1] - 1) if at.start is None else at.start)
    cells = rows.select("subject", "session").distinct().collect()  # one for each recording
    sessions, known = sorted({r["session"] for r in cells}), {(r["subject"], r["session"]) for r in cells}
    size = max(1, SLICE_BYTES // (8 * mu.size * len(sessions)))
    subjects, found = sorted({r["subject"] for r in cells}), []
    for i in range(0, len(subjects), size):
        own = subjects[i : i + size]
        there = np.array([[(s, t) in known for t in sessions] for s in own])
        found.append(_Slice(rows, edges, priors, at, mu, own, sessions, there).run())
    if not found:
        return Fitted(rows.select("vertex", "subject", F.col("x").alias("p")))
    out = found[0]
    for more in found[1:]:
        out = Fitted(out.posterior.union(more.posterior), out.kappa | more.kappa, out.costs | more.costs)
    return out


class _Slice:
    def __init__(self, rows: DataFrame, edges: DataFrame, priors: Priors, at: Settings, mu: np.ndarray, subjects: list, sessions: list, there: np.ndarray) -> None:
        self.at, self.mu, self.subjects, self.there = at, mu, subjects, there
        self.n_s, self.n_t, (self.n_l, self.d) = len(subjects), len(sessions), mu.shape
        self.sigma, self.epsilon = (np.broadcast_to(np.asarray(v, float), self.n_l)[:, None] for v in (priors.sigma, priors.epsilon))
        place = lambda c, values: (F.array_position(F.array(*[F.lit(x) for x in values]), F.col(c)) - 1).cast("int")
        own = rows.select("vertex", place("subject", subjects).alias("s"), place("session", sessions).alias("t"), F.col("x").cast("array<double>").alias("x")).where("s >= 0")
        self.rows = bucketed(own.groupBy("vertex", "s").agg(F.sort_array(F.collect_list(F.struct("t", "x"))).alias("cells")), "individual", ["vertex", "s"])
        self.edges = written(edges.select("src", "dst").where("src <> dst").distinct(), "edges")
        self.degree = written(self.edges.groupBy(F.col("src").alias("vertex")).agg(F.count("*").alias("degree")), "degree")
        self.theta = written(priors.theta.select("vertex", log_prior().alias("log_theta")), "log_theta")
        self.nu, self.psi = np.tile(mu, (self.n_s, self.n_t, 1, 1)), np.tile(mu, (self.n_s, 1, 1))
        self.kappa = np.full(self.n_s, at.start)

    def likelihoods(self, some: np.ndarray) -> DataFrame:
        """(vertex, s, score): the log likelihood of each network, of the subjects in some."""
        n_t, d, nu, kappa = self.n_t, self.d, self.nu, self.kappa
        log_c = np.array([log_normaliser(float(k), d - 1) if on else 0.0 for k, on in zip(kappa, some, strict=True)])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                s, cells = batch.column(1).to_numpy(), batch.column(2)
                owner, out = np.repeat(np.arange(batch.num_rows), np.diff(cells.offsets.to_numpy())), np.zeros((batch.num_rows, nu.shape[2]))
                flat = cells.flatten()
                cell, x = s[owner] * n_t + flat.field("t").to_numpy(), array(flat.field("x"), d)
                for c in np.unique(cell):
                    own = np.flatnonzero(cell == c)
                    i = c // n_t
                    out[owner[own]] += log_c[i] + kappa[i] * (x[own] @ nu[i, c % n_t].T)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(out), pa.list_(pa.float64()))], names=["vertex", "s", "score"])

        return written(self._of(self.rows, some).mapInArrow(run, "vertex long, s int, score array<double>"), "score")

    def weighted(self, p: DataFrame, some: np.ndarray) -> np.ndarray:
        """Rows summed with the posterior as weight: subjects x sessions x networks x features."""
        n_t, d = self.n_t, self.d

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            for batch in batches:
                s, cells = batch.column(0).to_numpy(), batch.column(1)
                owner = np.repeat(np.arange(batch.num_rows), np.diff(cells.offsets.to_numpy()))
                flat, weight = cells.flatten(), array(batch.column(2), len(batch.column(2)[0]) if batch.num_rows else 1)
                cell, x = s[owner] * n_t + flat.field("t").to_numpy(), array(flat.field("x"), d)
                for c in np.unique(cell):
                    own = np.flatnonzero(cell == c)
                    sums[int(c)] = sums.get(int(c), 0) + weight[owner[own]].T @ x[own]
            part = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(sums), pa.int32()), pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["part", "cell", "sums"])

        made = self._of(self.rows, some).join(p.select("vertex", "s", "p").hint("merge"), ["vertex", "s"]).select("s", "cells", "p").mapInArrow(run, "part int, cell int, sums binary")
        out = np.zeros((self.n_s * n_t, self.n_l, d))
        for r in added(made).collect():  # one for each session of the slice's subjects
            out[r["cell"]] = np.frombuffer(r["sums"]).reshape(self.n_l, d)
        return out.reshape(self.n_s, n_t, self.n_l, d)

    def _of(self, df: DataFrame, some: np.ndarray) -> DataFrame:
        return df if some.all() else df.where(F.col("s").isin([int(i) for i in np.flatnonzero(some)]))

    def start(self) -> DataFrame:
        """(vertex, s, p, valid) from the group's directions: unassigned where all networks are equal."""
        every = np.ones(self.n_s, bool)
        valid = F.array_max("score") > F.array_min("score")
        p = F.when(valid, softmax(F.col("score"))).otherwise(F.transform("score", lambda v: F.lit(0.0)))
        return written(self.likelihoods(every).select("vertex", "s", p.alias("p"), valid.alias("valid")), "posterior")

    def swept(self, p: DataFrame, score: DataFrame, some: np.ndarray) -> tuple[DataFrame, dict[int, float]]:
        """One sweep of the subjects in some, and the mean absolute change of each."""
        n_l, at = self.n_l, self.at
        sums = F.array(*[F.sum(F.get("p", F.lit(i))) for i in range(n_l)])
        near = self._of(p, some).select(F.col("vertex").alias("dst"), "s", "p").join(self.edges, "dst").groupBy(F.col("src").alias("vertex"), "s").agg(sums.alias("near"))
        j = score.join(p, ["vertex", "s"]).join(near, ["vertex", "s"], "left").join(self.degree, "vertex", "left").join(self.theta, "vertex", "left")
        none = lambda v: F.array(*[F.lit(float(v))] * n_l)
        smooth = F.transform(F.coalesce("near", none(0)), lambda v: F.coalesce("degree", F.lit(0)) - v)
        value = F.zip_with(F.zip_with("score", F.coalesce("log_theta", none(math.log(TINY))), lambda a, t: a + at.prior * t), smooth, lambda a, v: a - 2 * at.smooth * v)
        new = F.when(F.col("valid"), softmax(value)).otherwise(none(0))
        moved = F.col("s").isin([int(i) for i in np.flatnonzero(some)])
        out = j.select("vertex", "s", F.when(moved, new).otherwise(F.col("p")).alias("p"), "valid", F.col("p").alias("_p"))
        out = written(out.select("vertex", "s", "p", "valid", total(F.zip_with("p", "_p", lambda a, b: F.abs(a - b))).alias("change")), "posterior")
        change = {r["s"]: r["c"] for r in out.where(moved).groupBy("s").agg((F.sum("change") / (F.count("*") * n_l)).alias("c")).collect()}
        return kept_path(out.drop("change"), out), change

    def costs(self, p: DataFrame, score: DataFrame) -> np.ndarray:
        """For each subject: likelihood, prior without weight, entropy."""
        tiny = F.array(*[F.lit(math.log(TINY))] * self.n_l)
        sums = lambda c, f: F.sum(total(F.zip_with("p", c, f)))
        j = p.join(score, ["vertex", "s"]).join(self.theta, "vertex", "left").withColumn("log_theta", F.coalesce("log_theta", tiny))
        rows = j.groupBy("s").agg(sums("score", lambda a, v: a * v).alias("like"), sums("log_theta", lambda a, v: a * v).alias("prior"), sums("p", lambda a, _: -a * F.ln(F.greatest(a, F.lit(TINY)))).alias("entropy")).collect()
        out = np.zeros((self.n_s, 3))
        for r in rows:
            out[r["s"]] = r["like"], r["prior"], r["entropy"]
        return out

    def m_step(self, w: np.ndarray, mass: float, s: int) -> None:
        """Concentration and session directions of one subject."""
        there = np.flatnonzero(self.there[s])
        for _ in range(self.at.numerical):
            if mass > 0:
                r = float((w[s, there] * self.nu[s, there]).sum()) / (mass * len(there))
                new = max(inverse_ratio(min(max(r, 1e-10), 1 - 1e-10), self.d - 1), self.at.start)
                self.kappa[s] = self.kappa[s] if math.isinf(new) else new
            nu = unit_rows(self.kappa[s] * w[s, there] + self.sigma * self.psi[s])
            done = (1 - (nu * self.nu[s, there]).sum(axis=2) < self.at.epsilon).all()
            self.nu[s, there] = nu
            if done:
                return

    def inner(self, p: DataFrame, active: np.ndarray) -> tuple[DataFrame, DataFrame]:
        running, cost, score = active.copy(), np.zeros(self.n_s), None
        for k in range(self.at.inner):
            w = self.weighted(p, running)
            mass = {r["s"]: r["m"] for r in p.groupBy("s").agg(F.sum(total(F.col("p"))).alias("m")).collect()}
            for s in np.flatnonzero(running):
                self.m_step(w, mass.get(int(s), 0.0), int(s))
            new, old = self.likelihoods(running), score
            if running.all():
                score = new
            else:  # subjects that have converged keep theirs
                rest = self.likelihoods(~running) if old is None else self._of(old, ~running)
                score = written(rest.union(new), "score")
                discarded(new)
            discarded(old)
            open_ = running.copy()
            for _ in range(self.at.sweeps):
                new, change = self.swept(p, score, open_)
                discarded(p)
                p = new
                open_ &= np.array([change.get(s, 0.0) > self.at.epsilon for s in range(self.n_s)])
                if not open_.any():
                    break
            like, prior, entropy = self.costs(p, score).T
            update = like + self.at.prior * prior + entropy
            with np.errstate(divide="ignore", invalid="ignore"):
                settled = (np.abs(cost) > 0) & (np.abs((update - cost) / cost) <= self.at.epsilon)
            running &= ~settled
            cost = np.where(running, update, cost)
            if not running.any():
                break
        return p, score

    def run(self) -> Fitted:
        at, p, active, cost, score = self.at, self.start(), np.ones(self.n_s, bool), np.zeros(self.n_s), None
        costs: dict[int, list[float]] = {s: [] for s in range(self.n_s)}
        for step in range(at.outer):
            self.kappa[active] = at.start
            self.nu[active] = self.mu
            discarded(score)
            p, score = self.inner(p, active)
            here = self.there[:, :, None, None]
            psi = unit_rows((self.sigma * self.nu * here).sum(axis=1) + self.epsilon * self.mu)
            self.psi[active] = psi[active]
            update = self.costs(p, score).sum(axis=1)
            for s in np.flatnonzero(active):
                costs[int(s)].append(float(update[s]))
            with np.errstate(divide="ignore", invalid="ignore"):
                active = active & ~((step > 0) & (np.abs(cost) > 0) & (np.abs((update - cost) / cost) <= 1e-4))
            cost = update
            if not active.any():
                break
        discarded(score)
        bucketed_away(self.rows)
        name = lambda values: dict(zip(self.subjects, values, strict=True))
        subject = F.get(F.array(*[F.lit(x) for x in self.subjects]), F.col("s"))
        return Fitted(p.select("vertex", subject.alias("subject"), "p"), name(self.kappa.tolist()), name(costs[s] for s in range(self.n_s)))
