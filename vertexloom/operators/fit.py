"""The whole group fit: nested expectation-maximisation of group, subject and session directions, by Spark jobs over vertices.

A row of Spark is a vertex of a subject, with the observations of all its sessions; rows lie in the order of subjects. An iteration is one pass
over all rows with the prior of each vertex: the E-step, with the sums that the M-step needs. Rows of one session of a subject are multiplied
with its directions at once; sums are kept by a task for each session of a subject and leave it once, to be added up by session. The prior, the
mean of posteriors over subjects, is a sum over vertices; it is broadcast while it is of a bounded size, and else joined.

Directions belong to subjects. They are worked on in slices of subjects with SLICE_BYTES of them: a pass takes the rows of one slice with its
directions, and only one slice of each kind is in the driver at a time; the others are tables in the shared folder. The M-step and the update of
subject directions need all subjects together, but only inner products: every direction that they try is a combination of the same two vectors, so
that a few numbers for each session, subject and network stand for them. The driver holds these (about 100 bytes for each network of a
session), the group's directions and the concentrations. State is written in each iteration, which also cuts lineage; the state before is deleted.

A session that a subject does not have has no rows. It has no direction, counts neither for the subject's concentration nor in the
prior's cost, and the session is left out of sigma for all subjects. A vertex without rows of a subject is unassigned there.

Literal rules that are kept: concentrations and session directions start anew in every middle step, subject directions in every outer
one; a direction that has converged once counts as converged; the signed change of sigma; the closed form of the inverse Bessel
ratio; the cost of the step before the group's update is recorded; on convergence the previous cost counts; the starting concentration follows the
number of features unless it is given. Arithmetic is double throughout.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vertexloom.functions.bessel import log_normaliser
from vertexloom.sources.scratch import discarded, kept_path, written

from .blocks import lists

#: Bytes of prior up to which it is broadcast; sums of one session of a subject that are added up in one call.
BROADCAST_BYTES, ADDED = 64 << 20, 64
#: Bytes of session directions of the subjects that are worked on at a time.
SLICE_BYTES = 64 << 20
TINY = 20 * float(np.log(np.finfo(float).eps))


@dataclass
class Settings:
    start: float | None = None
    epsilon: float = 1e-4
    convergence: float = 1e-5
    outer: int = 5
    middle: int = 50
    inner: int = 101
    numerical: int = 10_000


def starting(d: int) -> float:
    """The concentration from which a fit in d + 1 dimensions starts."""
    if d >= 1800:
        raise ValueError(f"{d} dimensions are too many: a start is known below 1800")
    return 500.0 if d < 1200 else 650.0


class Vectors:
    """An array for each slice of subjects (subjects of the slice first). The last one used is in memory, others are written."""

    def __init__(self, spark: SparkSession | None, slices: list[list[int]], first: Callable[[list[int]], np.ndarray]) -> None:
        self.spark, self.slices, self.first = spark, slices, first
        self.tables: dict[int, tuple[DataFrame, tuple]] = {}
        self.last: tuple[int, np.ndarray] | None = None

    def __getitem__(self, i: int) -> np.ndarray:
        if self.last is None or self.last[0] != i:
            if i in self.tables:
                table, shape = self.tables[i]
                rows = sorted(table.collect(), key=lambda r: r["s"])  # one slice
                self.last = i, np.array([np.frombuffer(r["x"]) for r in rows]).reshape(shape)
            else:
                self.last = i, self.first(self.slices[i])
        return self.last[1]

    def __setitem__(self, i: int, x: np.ndarray) -> None:
        if len(self.slices) > 1:
            old = self.tables.get(i, (None,))[0]
            self.tables[i] = written(self.spark.createDataFrame([(s, v.tobytes()) for s, v in zip(self.slices[i], x, strict=True)], "s int, x binary"), "vectors"), x.shape
            discarded(old)
        self.last = i, x

    def every(self) -> np.ndarray:
        """All slices in one array, for models of a size that the driver can hold."""
        return np.concatenate([self[i] for i in range(len(self.slices))])

    def discard(self) -> None:
        discarded(*[t for t, _ in self.tables.values()])
        self.tables, self.last = {}, None


@dataclass
class Model:
    """Directions (networks x features, by subject, by subject and session), concentrations, and costs of the outer steps.

    there: which subject has which session; nu is zero where it has not. posterior: vertex, s (the subject's place), lam;
    prior: vertex, theta.
    """

    mu: np.ndarray
    epsilon: np.ndarray
    sigma: np.ndarray
    kappa: float
    there: np.ndarray
    subjects: list
    sessions: list
    subject_vectors: Vectors
    session_vectors: Vectors
    record: list[float] = field(default_factory=list)
    posterior: DataFrame | None = None
    prior: DataFrame | None = None

    @property
    def psi(self) -> np.ndarray:
        return self.subject_vectors.every()

    @property
    def nu(self) -> np.ndarray:
        return self.session_vectors.every()

    @property
    def state(self) -> DataFrame:
        """vertex, theta, lam (subjects x networks, one after another; zeros where a subject has no row)."""
        n_l = len(self.mu)
        own = self.posterior.groupBy("vertex").agg(F.map_from_entries(F.collect_list(F.struct("s", "lam"))).alias("m"))
        none = F.array(*[F.lit(0.0)] * n_l)
        lam = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(len(self.subjects) - 1)), lambda s: F.coalesce(F.try_element_at("m", s), none)))
        return own.join(self.prior, "vertex").select("vertex", "theta", lam.alias("lam"))


def unit_rows(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=-1, keepdims=True)
    return x / np.where(n == 0, 1, n)


def _inverse(d: int, r):
    with np.errstate(divide="ignore", invalid="ignore"):
        return (d - 1) * r / (1 - r * r) + d * r / (d - 1)


def array(x: pa.Array, width: int) -> np.ndarray:
    return x.flatten().to_numpy().reshape(-1, width)


class _Data:
    """The rows, written once, and passes over them."""

    def __init__(self, rows: DataFrame, n_l: int) -> None:
        spark = self.spark = rows.sparkSession
        cells = rows.select("subject", "session").distinct().collect()  # one for each recording
        self.subjects, self.sessions = (sorted({r[c] for r in cells}) for c in ("subject", "session"))
        place = {c: {x: i for i, x in enumerate(v)} for c, v in (("subject", self.subjects), ("session", self.sessions))}
        self.there = np.zeros((len(self.subjects), len(self.sessions)), bool)
        for r in cells:
            self.there[place["subject"][r["subject"]], place["session"][r["session"]]] = True
        named = lambda c, out: F.broadcast(spark.createDataFrame(list(place[c].items()), T.StructType([T.StructField(c, rows.schema[c].dataType), T.StructField(out, T.IntegerType())])))
        own = rows.join(named("subject", "s"), "subject").join(named("session", "t"), "session").groupBy("s", "vertex")
        own = own.agg(F.sort_array(F.collect_list(F.struct("t", F.col("x").cast("array<double>").alias("x")))).alias("cells"))
        self.rows = written(own.select(F.col("vertex").cast("long").alias("vertex"), "s", "cells").repartitionByRange("s", "vertex").sortWithinPartitions("s", "vertex"), "blocks")
        self.features, self.vertices = self.rows.agg(F.max(F.size(F.col("cells")[0]["x"])), F.count_distinct("vertex")).first()
        size = max(1, SLICE_BYTES // (8 * len(self.sessions) * n_l * self.features))
        self.slices = [list(range(i, min(i + size, len(self.subjects)))) for i in range(0, len(self.subjects), size)]

    def _pass(self, theta: DataFrame | None, own: list[int], nu: np.ndarray, kappa: float, log_c: float) -> tuple[DataFrame, np.ndarray, np.ndarray]:
        """(posterior, weighted data, costs without the prior) of a slice's subjects. Without theta all networks are as likely."""
        n_s, n_t, d, n_l, low, first = len(own), len(self.sessions), self.features, nu.shape[2], own[0], theta is None
        directions = self.spark.sparkContext.broadcast(np.ascontiguousarray(nu.reshape(n_s * n_t, n_l, d)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            weighted: dict[int, np.ndarray] = {}
            costs, part = np.zeros(n_s), TaskContext.get().partitionId()
            for batch in batches:
                n, s, cells = batch.num_rows, batch.column(1).to_numpy() - low, batch.column(2)
                owner = np.repeat(np.arange(n), np.diff(cells.offsets.to_numpy()))
                flat = cells.flatten()
                cell, x = s[owner] * n_t + flat.field("t").to_numpy(), array(flat.field("x"), d)
                order = np.argsort(cell, kind="stable")
                runs = np.split(order, np.flatnonzero(np.diff(cell[order])) + 1) if len(order) else []
                score, like = np.zeros((n, n_l)), np.zeros((n, n_l))
                for rows in runs:  # the rows of one session of one subject
                    lv = kappa * (x[rows] @ directions.value[int(cell[rows[0]])].T)
                    like[owner[rows]] += lv + log_c
                    score[owner[rows]] += lv + (log_c if first else log_c * (lv != 0).all(axis=1, keepdims=True))
                zero = (score == score.max(axis=1, keepdims=True)).all(axis=1) if first else (score == 0).any(axis=1)
                if not first:
                    with np.errstate(divide="ignore"):
                        score = score + np.log(array(batch.column(3), n_l))
                top = score.max(axis=1, keepdims=True)
                e = np.exp(score - np.where(np.isfinite(top), top, 0))
                lam = e / np.where((total := e.sum(axis=1, keepdims=True)) == 0, 1, total)
                lam[zero] = 0
                np.add.at(costs, s, (lam * (like - _ln(lam))).sum(axis=1))
                for rows in runs:
                    sums = lam[owner[rows]].T @ x[rows]
                    c = int(cell[rows[0]])
                    weighted[c] = weighted[c] + sums if c in weighted else sums
                none = lambda kind: pa.nulls(n, kind)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists(lam), none(pa.int32()), none(pa.int32()), none(pa.binary())], names=_STATE)
            made = [*weighted.items(), (-1, costs)]
            none = lambda kind: pa.nulls(len(made), kind)
            yield pa.RecordBatch.from_arrays([none(pa.int64()), none(pa.int32()), none(pa.list_(pa.float64())), pa.array([part] * len(made), pa.int32()), pa.array([c for c, _ in made], pa.int32()), pa.array([v.tobytes() for _, v in made], pa.binary())], names=_STATE)

        rows = self.rows if len(self.slices) == 1 else self.rows.where(F.col("s").between(low, own[-1]))
        if theta is not None:
            rows = rows.join(F.broadcast(theta) if 8 * n_l * self.vertices <= BROADCAST_BYTES else theta.hint("merge"), "vertex").select("vertex", "s", "cells", "theta")
        out = written(rows.mapInArrow(run, "vertex long, s int, lam array<double>, part int, cell int, sums binary"), "state")
        total, costs = np.zeros((n_s * n_t, n_l, d)), np.zeros(n_s)
        for r in added(out.where("cell is not null").select("part", "cell", "sums")).collect():  # one row for each session of the slice's subjects
            if r["cell"] < 0:
                costs = np.frombuffer(r["sums"])
            else:
                total[r["cell"]] = np.frombuffer(r["sums"]).reshape(n_l, d)
        directions.unpersist()
        return kept_path(out.where("cell is null").select("vertex", "s", "lam"), out), total.reshape(n_s, n_t, n_l, d), costs

    def step(self, m: Model, weighted: Vectors, log_c: float, first: bool = False) -> tuple[np.ndarray, float]:
        """One pass over all rows: new posterior, prior and weighted data; (costs by subject, mass of the posterior)."""
        n_s, n_l = len(self.subjects), len(m.mu)
        old, parts, costs = (m.posterior, m.prior), [], np.zeros(n_s)
        for i, own in enumerate(self.slices):
            lam, sums, cost = self._pass(None if first else m.prior, own, m.session_vectors[i], m.kappa, log_c)
            weighted[i] = sums
            costs[own[0] : own[-1] + 1] = cost
            parts.append(lam)
        m.posterior = parts[0] if len(parts) == 1 else _joined(parts)
        entry = lambda i: F.get("lam", F.lit(i))
        one = lambda i: F.coalesce(F.sum(entry(i)) / n_s / F.nullif(F.count_if(entry(i) != 0), F.lit(0).cast("long")), F.lit(0.0)) if first else F.sum(entry(i)) / n_s
        m.prior = written(m.posterior.groupBy("vertex").agg(F.array(*[one(i) for i in range(n_l)]).alias("theta")), "prior")
        ln = lambda v: F.when(v > 0, F.ln(v)).otherwise(F.lit(TINY))
        under = F.aggregate(F.zip_with("lam", "theta", lambda a, t: a * ln(t)), F.lit(0.0), lambda a, v: a + v)
        mass = 0.0
        both = m.posterior.join(F.broadcast(m.prior) if 8 * n_l * self.vertices <= BROADCAST_BYTES else m.prior.hint("merge"), "vertex")
        for r in both.groupBy("s").agg(F.sum(under).alias("prior"), F.sum(F.aggregate("lam", F.lit(0.0), lambda a, v: a + v)).alias("mass")).orderBy("s").collect():  # two numbers a subject
            costs[r["s"]] += r["prior"]
            mass += r["mass"]
        if old[0] is not None:
            discarded(*getattr(old[0], "_parts", [old[0]]), old[1])
        return costs, mass


def _ln(v: np.ndarray) -> np.ndarray:
    return np.log(np.where(v > 0, v, 1)) + np.where(v > 0, 0, TINY)


def _joined(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for more in parts[1:]:
        out = out.union(more)
    out._parts = parts
    return out


_STATE = ["vertex", "s", "lam", "part", "cell", "sums"]


def added(sums: DataFrame) -> DataFrame:
    """(cell, sums) of what the tasks (part, cell, sums) have gathered, added up in two steps."""

    def add(table: pa.Table) -> pa.Table:
        order = np.argsort([crc32(v.as_py()) for v in table.column("sums")], kind="stable")  # whatever the order of arrival
        total = np.zeros(len(table.column("sums")[0].as_py()) // 8)
        for i in order:
            total += np.frombuffer(table.column("sums")[int(i)].as_py())
        return pa.table({"part": table.column("part")[:1], "cell": table.column("cell")[:1], "sums": pa.array([total.tobytes()], pa.binary())})

    step = lambda df, part: df.withColumn("part", part).groupBy("part", "cell").applyInArrow(add, "part int, cell int, sums binary")
    return step(step(sums, F.floor(F.col("part") / ADDED).cast("int")), F.lit(0)).drop("part")


def group_fit(rows: DataFrame, directions: DataFrame, settings: Settings | None = None) -> Model:
    """Fit rows (vertex, subject, session, x) from directions (network, x)."""
    at = settings or Settings()
    start = np.array([r["x"] for r in directions.orderBy("network").collect()])
    data = _Data(rows, len(start))
    n_l, d = len(start), data.features - 1
    at = replace(at, start=starting(d) if at.start is None else at.start)
    spark, n_t = data.spark, len(data.sessions)
    psi = Vectors(spark, data.slices, lambda own: np.tile(start, (len(own), 1, 1)))
    nu = Vectors(spark, data.slices, lambda own: np.tile(start, (len(own), n_t, 1, 1)))
    weighted = Vectors(spark, data.slices, lambda own: np.zeros((len(own), n_t, n_l, d + 1)))
    m = Model(start.copy(), np.full(n_l, at.start), np.full(n_l, at.start), at.start, data.there, data.subjects, data.sessions, psi, nu)
    _, mass = data.step(m, weighted, log_normaliser(at.start, d), first=True)
    before = 0.0
    for outer in range(at.outer):
        m.sigma = np.full(n_l, at.start)
        psi.discard()
        intra = 0.0
        for _ in range(at.middle):
            m.kappa = at.start
            nu.discard()
            em_cost, mass = _inner(m, data, weighted, mass, at, d)
            prior = _intra(m, at, d)
            cost = float(em_cost.sum()) + prior
            change = abs((cost - intra) / intra) if intra else np.inf
            intra = cost
            if change <= at.epsilon:
                break
        _inter(m, at, d)
        m.record.append(intra)
        if outer and before and abs((intra - before) / before) <= at.convergence:
            break
        before = intra
    weighted.discard()
    finite = lambda c: F.forall(c, lambda v: ~F.isnan(v) & (F.abs(v) != float("inf")))
    odd = m.posterior.where(~finite("lam")).limit(1).count() + m.prior.where(~finite("theta")).limit(1).count()
    sound = [np.isfinite(x).all() for x in (m.mu, m.epsilon, m.sigma, m.kappa)] + [np.isfinite(v[i]).all() for i in range(len(data.slices)) for v in (psi, nu)]
    if odd or not all(sound) or not (m.kappa > 0 and (m.sigma > 0).all() and (m.epsilon > 0).all()):
        raise ValueError("the fit ended with concentrations, directions or posteriors that are not finite and positive")
    return m


def _inner(m: Model, data: _Data, weighted: Vectors, mass: float, at: Settings, d: int) -> tuple[np.ndarray, float]:
    cost = np.zeros(len(data.subjects))
    for k in range(at.inner):
        if not mass or not np.isfinite(mass):
            raise ValueError("no vertex is assigned to a network")
        _m_step(m, weighted, mass, at, d)
        update, mass = data.step(m, weighted, log_normaliser(m.kappa, d))
        with np.errstate(divide="ignore", invalid="ignore"):
            done = ~(np.abs((update - cost) / cost) > at.epsilon)
        if done.all():
            return cost, mass
        if k == at.inner - 1:
            return update, mass
        cost = update
    return cost, mass


def _products(m: Model, of: Callable[[int], list[np.ndarray]]) -> list[np.ndarray]:
    """Inner products of each slice, of all subjects together."""
    parts = [of(i) for i in range(len(m.session_vectors.slices))]
    return [np.concatenate(x) for x in zip(*parts, strict=True)]


def _length(x: np.ndarray) -> np.ndarray:
    n = np.sqrt(np.maximum(x, 0))
    return np.where(n > 0, n, 1)


def _m_step(m: Model, weighted: Vectors, mass: float, at: Settings, d: int) -> None:
    """Concentration and session directions, which are unit vectors of kappa * weighted data + sigma * the subject's direction."""
    there, sigma = m.there, m.sigma[None, None]

    def own(i: int) -> list[np.ndarray]:
        w, psi, nu = weighted[i], m.subject_vectors[i][:, None], m.session_vectors[i]
        return [(a * b).sum(axis=3) for a, b in ((w, w), (w, psi), (w, nu))] + [np.broadcast_to((a * b).sum(axis=3), w.shape[:3]) for a, b in ((psi, psi), (psi, nu))]

    ww, wp, value, pp, pn = _products(m, own)
    flags, last = ~there, None
    for _ in range(at.numerical):
        numerator = (value.sum(axis=1) / np.maximum(1, there.sum(axis=1))[:, None]).sum()
        old, new = m.kappa, max(float(_inverse(d, numerator / mass)), at.start)
        k = m.kappa = old if np.isinf(new) else new
        n = _length(k * k * ww + 2 * k * sigma * wp + sigma * sigma * pp)
        same = (k * value + sigma * pn) / n if last is None else (k * last[0] * ww + (k + last[0]) * sigma * wp + sigma * sigma * pp) / (n * last[1])
        flags |= (1 - same < at.epsilon).all(axis=2)
        value, last = (k * ww + sigma * wp) / n * there[:, :, None], (k, n)
        if flags.all() and abs(old - k) / old < at.epsilon:
            break
    else:
        raise RuntimeError("the M-step did not converge")
    for i, s in enumerate(m.session_vectors.slices):
        m.session_vectors[i] = unit_rows(m.kappa * weighted[i] + m.sigma[None, None, :, None] * m.subject_vectors[i][:, None]) * there[s][:, :, None, None]


def _intra(m: Model, at: Settings, d: int) -> float:
    """Subject directions, unit vectors of sigma * the sum of their sessions' + epsilon * the group's, and sigma; returns the prior's cost."""
    mu, eps = m.mu, m.epsilon[None]

    def own(i: int) -> list[np.ndarray]:
        nu, psi = m.session_vectors[i], m.subject_vectors[i]
        n = nu.sum(axis=1)
        return [(n * n).sum(axis=2), (n * mu).sum(axis=2), (n * psi).sum(axis=2), (mu * psi).sum(axis=2), (n[:, None] * nu).sum(axis=3), (mu * nu).sum(axis=3)]

    nn, nm, np_, mp, nt, mt = _products(m, own)
    mm = (mu * mu).sum(axis=1)[None]
    flags, last = np.zeros(len(nn), bool), None
    for _ in range(at.numerical):
        s = m.sigma[None]
        n = _length(s * s * nn + 2 * s * eps * nm + eps * eps * mm)
        same = (s * np_ + eps * mp) / n if last is None else (s * last[0] * nn + (s + last[0]) * eps * nm + eps * eps * mm) / (n * last[1])
        flags |= (1 - same < at.epsilon).all(axis=1)
        cosine = (s[:, None] * nt + eps[:, None] * mt) / n[:, None]
        used, last = m.sigma, (s, n)
        m.sigma = _inverse(d, cosine.mean(axis=0)[m.there.all(axis=0)].mean(axis=0))
        if flags.all() and np.mean(np.abs(used - m.sigma) / used) < at.epsilon:
            break
    else:
        raise RuntimeError("the update of subject directions did not converge")
    for i in range(len(m.session_vectors.slices)):
        m.subject_vectors[i] = unit_rows(used[None, :, None] * m.session_vectors[i].sum(axis=1) + m.epsilon[None, :, None] * mu[None])
    log_c = lambda c: np.array([log_normaliser(float(x), d) for x in c])
    sessions = (m.sigma * cosine + log_c(m.sigma))[:, m.there.all(axis=0)]
    subjects = m.epsilon * (used[None] * nm + eps * mm) / last[1] + log_c(m.epsilon)
    return float(np.nansum(sessions) + np.nansum(subjects))


def _inter(m: Model, at: Settings, d: int) -> None:
    psi = m.subject_vectors
    slices = range(len(psi.slices))
    m.mu = unit_rows(np.sum([psi[i].sum(axis=0) for i in slices], axis=0))
    cosine = np.concatenate([(psi[i] * m.mu[None]).sum(axis=2) for i in slices]).mean(axis=0)
    new = np.maximum(_inverse(d, cosine), at.start)
    m.epsilon = np.where(np.isinf(new), m.epsilon, new)


def _subjects(m: Model) -> DataFrame:
    """(s, subject) of the model."""
    spark = m.posterior.sparkSession
    return F.broadcast(spark.createDataFrame(list(enumerate(m.subjects)), "s int, subject " + ("string" if m.subjects and isinstance(m.subjects[0], str) else "long")))


def posterior(m: Model) -> DataFrame:
    """(vertex, subject, p) under the subjects' own ids; a subject without a row at a vertex has none."""
    return m.posterior.join(_subjects(m), "s").select("vertex", "subject", F.col("lam").alias("p"))


def best_labels(rows: DataFrame) -> DataFrame:
    """(vertex, subject, label) of rows (vertex, subject, p): the network of the highest posterior by number from 1, 0 if unassigned."""
    best = F.array_position("p", F.array_max("p"))
    return rows.select("vertex", "subject", F.when(F.array_max("p") > 0, best).otherwise(F.lit(0).cast("long")).alias("label"))


def group_labels(rows: DataFrame, directions: DataFrame, settings: Settings | None = None) -> DataFrame:
    """(vertex, subject, label) of the fit, for all vertices and subjects; 0 where a subject has no row."""
    m = group_fit(rows, directions, settings)
    every = m.prior.select("vertex", F.explode(F.array(*[F.lit(x) for x in m.subjects])).alias("subject"))
    return every.join(best_labels(posterior(m)), ["vertex", "subject"], "left").select("vertex", "subject", F.coalesce("label", F.lit(0).cast("long")).alias("label"))


def save(m: Model, spark: SparkSession, path: str) -> None:
    """The model as tables below a new path: directions (by subject and session, under their own ids), concentrations, record,
    posterior (vertex, subject, p) and prior (vertex, theta). Directions are written slice by slice."""
    kinds = ["string" if v and isinstance(v[0], str) else "long" for v in (m.subjects, m.sessions)]
    schema = f"kind string, subject {kinds[0]}, session {kinds[1]}, network int, x array<double>"
    put = lambda rows: spark.createDataFrame(rows, schema).write.mode("append").parquet(f"{path}/directions")
    spark.createDataFrame([("group", None, None, k + 1, v) for k, v in enumerate(m.mu.tolist())], schema).write.parquet(f"{path}/directions")
    for i, own in enumerate(m.subject_vectors.slices):
        psi, nu = m.subject_vectors[i], m.session_vectors[i]
        rows = [("subject", m.subjects[s], None, k + 1, v) for j, s in enumerate(own) for k, v in enumerate(psi[j].tolist())]
        put(rows + [("session", m.subjects[s], m.sessions[t], k + 1, v) for j, s in enumerate(own) for t in np.flatnonzero(m.there[s]) for k, v in enumerate(nu[j, t].tolist())])
    values = [(k + 1, float(a), float(b), float(m.kappa)) for k, (a, b) in enumerate(zip(m.epsilon, m.sigma, strict=True))]
    spark.createDataFrame(values, "network int, epsilon double, sigma double, kappa double").write.parquet(f"{path}/concentrations")
    spark.createDataFrame(list(enumerate(map(float, m.record), 1)), "step int, cost double").write.parquet(f"{path}/record")
    if m.posterior is not None:
        posterior(m).write.parquet(f"{path}/posterior")
        m.prior.write.parquet(f"{path}/prior")


def load(spark: SparkSession, path: str, posterior: bool = True) -> dict[str, DataFrame]:
    """The tables of a saved model; without a posterior among them, asking for it is an error."""
    tables = {n: spark.read.parquet(f"{path}/{n}") for n in ("directions", "concentrations", "record")}
    if posterior:
        try:
            tables |= {n: spark.read.parquet(f"{path}/{n}") for n in ("posterior", "prior")}
        except AnalysisException as e:
            raise ValueError(f"{path} has no posterior: fit with state, or load with posterior=False") from e
    return tables


def results(spark: SparkSession, path: str, subjects: list | None = None) -> DataFrame:
    """(vertex, subject, label) of a saved model's subjects, of all or the named ones; one that the model does not know is an error."""
    tables = load(spark, path)
    if subjects is not None:
        known = {r[0] for r in tables["directions"].where("kind = 'subject'").select("subject").distinct().collect()}
        if lost := [x for x in subjects if x not in known]:
            raise ValueError(f"the model has no subjects {lost}")
        tables["posterior"] = tables["posterior"].where(F.col("subject").isin(subjects))
    return best_labels(tables["posterior"])
