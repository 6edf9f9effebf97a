"""The parts of the hierarchical mixture of directions: centroids, likelihoods, posteriors, updates, labels.

rows: (vertex, subject, session, x) with unit rows; a missing session has no row, a zero row is an observation without signal.
directions: (network, x), the model's few rows. What belongs to the networks of one row is an array in the order of network numbers, so
that likelihoods become posteriors and labels within the row.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vertexloom.functions.vectors import centred, dot, inverse_ratio, let, norm, total, unit
from vertexloom.sources.scratch import discarded, written

from . import blocks

_TINY = 20 * -36.04365338911715  # ln of the machine's epsilon to the power 20 stands for ln 0


def unit_sums(rows: DataFrame, *by: str, weight: str | None = None) -> DataFrame:
    """(by, x): the sum of the arrays of each group, scaled to length one."""
    return blocks.summed(rows, list(by), weight).select(*by, unit(F.col("x")).alias("x"))


def label_centroids(labelled: DataFrame) -> DataFrame:
    """(network, x) of rows (label, x): centred unit rows summed and scaled; label 0 and rows that sum to zero are left out."""
    usable = labelled.where(F.col("label") != 0).where(total(F.col("x")) != 0)
    return unit_sums(usable.select(F.col("label").alias("network"), unit(centred(F.col("x"))).alias("x")), "network")


def means(rows: DataFrame, *by: str) -> DataFrame:
    """(by, n, x): the mean of each of a few groups."""
    return blocks.summed(rows, list(by)).withColumn("x", F.transform("x", lambda v: v / F.col("n")))


def mean_centroids(labelled: DataFrame, networks: int) -> DataFrame:
    """(network, x) for networks 1 .. n: unit means of the raw rows; an empty network is zero."""
    found = means(labelled.where("label > 0").select(F.col("label").alias("network"), "x"), "network")
    size = labelled.agg(F.max(F.size("x")).alias("d"))  # one row
    every = labelled.sparkSession.range(1, networks + 1).select(F.col("id").alias("network")).join(F.broadcast(size))
    zero = F.transform(F.sequence(F.lit(1), F.col("d")), lambda _: F.lit(0.0))
    return every.join(found, "network", "left").select("network", F.coalesce(unit(F.col("x")), zero).alias("x"))


def networks_of(directions: DataFrame) -> list[int]:
    return sorted(r[0] for r in directions.select("network").collect())


def dots(rows: DataFrame, directions: DataFrame) -> DataFrame:
    """rows with dots instead of x: inner products with the networks' directions."""
    return blocks.dot_arrays(rows, directions, "network", "dots")[1]


def by_network(df: DataFrame, array: str, value: str, networks: list[int]) -> DataFrame:
    """df with a row for each network instead of an array."""
    each = F.posexplode(array).alias("_i", value)
    return df.select(*[c for c in df.columns if c != array], each).select(*[c for c in df.columns if c != array], F.get(F.array(*[F.lit(n).cast("long") for n in networks]), F.col("_i")).alias("network"), value)


def _sums(n: int, term) -> Column:
    return F.array(*[F.sum(term(F.lit(i))) for i in range(n)])


def likelihoods(dots: DataFrame, n: int, kappa: float, log_c: float = 0.0, always: bool = False) -> DataFrame:
    """(vertex, subject, score): kappa * dot summed over sessions for each of n networks, with log_c where no network's dot is zero, or always."""
    constant = F.lit(log_c) if always else F.when(F.forall("dots", lambda v: v != 0), F.lit(log_c)).otherwise(F.lit(0.0))
    return dots.groupBy("vertex", "subject").agg(_sums(n, lambda i: kappa * F.get("dots", i) + constant).alias("score"))


def softmax(x: Column) -> Column:
    """exp of an array over the sum, after subtraction of the maximum."""
    return let(x, lambda a: let(F.transform(a, lambda v: F.exp(v - F.array_max(a))), lambda e: let(total(e), lambda t: F.transform(e, lambda v: v / t))))


def posteriors(scores: DataFrame, theta: DataFrame | None = None) -> DataFrame:
    """(vertex, subject, p); all zero for a row in which any score is zero. theta (vertex, theta) is a prior."""
    log = lambda v: F.when(v > 0, F.ln(v)).otherwise(F.lit(float("-inf")))
    score = F.col("score") if theta is None else F.zip_with("score", "theta", lambda a, t: a + log(t))
    s = scores if theta is None else scores.join(theta, "vertex")
    zero = F.exists("score", lambda v: v == 0)
    return s.select("vertex", "subject", F.when(zero, F.transform("score", lambda v: F.lit(0.0))).otherwise(softmax(score)).alias("p"))


def labels(posterior: DataFrame, networks: list[int]) -> DataFrame:
    """(vertex, subject, label): the most likely network, the lowest of equal ones; 0 where the posterior is all zero."""
    best = F.element_at(F.array(*[F.lit(n).cast("long") for n in networks]), F.array_position("p", F.array_max("p")).cast("int"))
    return posterior.select("vertex", "subject", F.when(F.array_max("p") > 0, best).otherwise(F.lit(0).cast("long")).alias("label"))


def theta_mean(posterior: DataFrame, n: int, subjects: int) -> DataFrame:
    """(vertex, theta): the posterior's mean over subjects."""
    return posterior.groupBy("vertex").agg(_sums(n, lambda i: F.get("p", i) / subjects).alias("theta"))


def initial_theta(posterior: DataFrame, n: int, subjects: int) -> DataFrame:
    """The mean over subjects over the number of subjects that are not zero; zero if none is."""
    one = lambda i: F.coalesce(F.sum(F.get("p", i)) / subjects / F.nullif(F.count_if(F.get("p", i) != 0), F.lit(0).cast("long")), F.lit(0.0))
    return posterior.groupBy("vertex").agg(F.array(*[one(F.lit(i)) for i in range(n)]).alias("theta"))


def weighted_data(rows: DataFrame, posterior: DataFrame, networks: list[int]) -> DataFrame:
    """(subject, session, network, x): rows summed with the posterior as weight; a network without any weight has no row."""
    joined = rows.join(posterior, ["vertex", "subject"]).select("subject", "session", "x", "p")
    return blocks.weighted_sums(joined, ["subject", "session"], "p", networks, "network")


def kappa_update(dots: DataFrame, posterior: DataFrame, n: int, d: int, least: float) -> DataFrame:
    """(numerator, mass, rbar, kappa): one concentration for all networks, at least `least`.

    Inner products weighted by the posterior are summed over vertices, averaged over the sessions of a subject, and summed.
    """
    s = dots.join(posterior, ["vertex", "subject"]).groupBy("subject", "session").agg(_sums(n, lambda i: F.get("p", i) * F.get("dots", i)).alias("v"))
    numerator = s.groupBy("subject").agg(F.avg(total(F.col("v"))).alias("v")).agg(F.sum("v").alias("numerator"))
    r = numerator.join(posterior.agg(F.sum(total(F.col("p"))).alias("mass"))).withColumn("rbar", F.col("numerator") / F.col("mass"))
    return r.withColumn("kappa", F.greatest(inverse_ratio(F.col("rbar"), d), F.lit(least)))


def session_directions(weighted: DataFrame, directions: DataFrame, kappa: float, sigma: float) -> DataFrame:
    """(subject, session, network, x): kappa * weighted data + sigma * the subject's direction, of length one."""
    x = F.zip_with("x", "_d", lambda a, b: kappa * a + sigma * b)
    return weighted.join(directions.select("network", F.col("x").alias("_d")), "network").select("subject", "session", "network", unit(x).alias("x"))


def subject_directions(sessions: DataFrame, group: DataFrame, sigma: float, epsilon: float) -> DataFrame:
    """(subject, network, x): sigma * session directions + epsilon * the group's direction, of length one."""
    prior = sessions.select("subject", "network").distinct().join(group, "network").select("subject", "network", F.lit(epsilon), "x")
    return unit_sums(sessions.select("subject", "network", F.lit(sigma).alias("w"), "x").union(prior), "subject", "network", weight="w")


def group_directions(subjects: DataFrame) -> DataFrame:
    return unit_sums(subjects, "network")


def sigma_update(sessions: DataFrame, subjects: DataFrame, n_subjects: int, d: int) -> DataFrame:
    """(network, rbar, sigma): cosines averaged over subjects first, in sessions that all subjects have, then over sessions."""
    s = sessions.join(subjects.select("subject", "network", F.col("x").alias("_p")), ["subject", "network"]).select("subject", "session", "network", dot(F.col("x"), F.col("_p")).alias("c"))
    mean = s.groupBy("session", "network").agg(F.avg("c").alias("c"), F.count("*").alias("n")).where(F.col("n") == n_subjects)
    return mean.groupBy("network").agg(F.avg("c").alias("rbar")).withColumn("sigma", inverse_ratio(F.col("rbar"), d))


def em_cost(dots: DataFrame, posterior: DataFrame, theta: DataFrame, n: int, kappa: float, log_c: float) -> DataFrame:
    """(subject, cost): likelihood, prior and entropy under the posterior."""
    ln = lambda v: F.when(v > 0, F.ln(v)).otherwise(F.lit(_TINY))
    j = likelihoods(dots, n, kappa, log_c, always=True).join(posterior, ["vertex", "subject"]).join(theta, "vertex")
    terms = F.zip_with(F.zip_with("score", "theta", lambda s, t: s + ln(t)), "p", lambda v, p: p * (v - ln(p)))
    return j.groupBy("subject").agg(F.sum(total(terms)).alias("cost"))


def lloyd(rows: DataFrame, start: DataFrame, steps: int) -> DataFrame:
    """(vertex, network) after steps of spherical k-means from start (network, x); an empty network keeps no direction."""
    return nearest(rows, _moved(rows, start, steps - 1)).select("vertex", "network")


def _moved(rows: DataFrame, directions: DataFrame, steps: int) -> DataFrame:
    for _ in range(steps):
        directions = written(unit_sums(nearest(rows, directions, keep=True).select("network", "x"), "network"), "directions")
    return directions


def restarts(rows: DataFrame, starts: list[DataFrame], steps: int) -> DataFrame:
    """(vertex, network) of the start from which k-means ends with the largest sum of inner products, the first of equal ones."""
    found = [written(nearest(rows, _moved(rows, s, steps - 1)), "restart") for s in starts]
    sums = [r.agg(F.coalesce(F.sum("dot"), F.lit(0.0))).first()[0] for r in found]
    return found[max(range(len(sums)), key=lambda i: (round(sums[i], 9), -i))].select("vertex", "network")


def _uniform(seed: int, step: int, vertex: str = "vertex") -> Column:
    """A number from 0 to 1 for each vertex, the same in every run."""
    text = F.md5(F.concat(F.lit(f"{seed}:{step}:"), F.col(vertex).cast("string")).cast("binary"))
    return F.conv(F.substring(text, 1, 12), 16, 10).cast("double") / float(16**12)


def seeded(rows: DataFrame, k: int, seed: int = 0, rounds: int = 5, oversampling: float = 2.0, attempts: int = 8) -> DataFrame:
    """(network, x): k starting directions for rows (vertex, x) of length one, spread as k-means++ spreads them, by k-means||.

    From one vertex on, each of a few rounds takes every vertex with a chance in proportion to its squared distance from the
    nearest one taken before, oversampling * k of them to be expected. The vertices nearest to each are counted; of a few attempts of k-means++
    with these weights on what was taken, in the driver, the one of the least cost gives the directions. Chances come from hashes of vertices: reruns agree. Rows of zeros
    do not count; fewer than k different rows are an error.
    """
    rows = rows.where(F.exists("x", lambda v: v != 0)).select("vertex", "x")
    order = F.struct(_uniform(seed, 0), F.col("vertex"))
    first = rows.agg(F.min_by("x", order).alias("x")).first()["x"]
    if first is None:
        raise ValueError("no rows to start from")
    taken = [list(first)]
    spark = rows.sparkSession
    table = lambda: spark.createDataFrame(list(enumerate(taken)), "network long, x array<double>")  # noqa: E731  about rounds * oversampling * k rows
    for step in range(1, rounds + 1):
        away = written(nearest(rows, table()).select("vertex", F.greatest(F.lit(0.0), 2 - 2 * F.col("dot")).alias("d")), "away")
        cost = away.agg(F.sum("d")).first()[0]
        if not cost:
            break
        lucky = away.where(_uniform(seed, step) * cost < oversampling * k * F.col("d")).select("vertex")
        taken += [list(r["x"]) for r in rows.join(lucky, "vertex", "left_semi").orderBy("vertex").collect()]
        discarded(away)
    count = {r["network"]: r["n"] for r in nearest(rows, table()).groupBy("network").agg(F.count("*").alias("n")).collect()}
    x, weight = np.array(taken), np.array([count.get(i, 0) for i in range(len(taken))], float)
    x, weight, rng = x[weight > 0], weight[weight > 0], np.random.default_rng(seed)
    found = [_spread(x, weight, k, rng, polish=10) for _ in range(attempts)]
    centres = min(found, key=lambda c: float((weight * (2 - 2 * (x @ c.T).max(axis=1))).sum()))
    return spark.createDataFrame([(i + 1, c.tolist()) for i, c in enumerate(centres)], "network long, x array<double>")


def _spread(x: np.ndarray, weight: np.ndarray, k: int, rng: np.random.Generator, polish: int) -> np.ndarray:
    """k directions among weighted rows: k-means++, and a few steps of weighted k-means."""
    centres = [x[rng.choice(len(x), p=weight / weight.sum())]]
    away = 2 - 2 * x @ centres[0]
    for _ in range(k - 1):
        chance = weight * np.maximum(away, 0)
        if chance.sum() <= 1e-12 * weight.sum():
            raise ValueError(f"fewer than {k} different rows")
        centres.append(x[rng.choice(len(x), p=chance / chance.sum())])
        away = np.minimum(away, 2 - 2 * x @ centres[-1])
    out = np.array(centres)
    for _ in range(polish):
        own = (x @ out.T).argmax(axis=1)
        sums = np.array([(weight[own == i, None] * x[own == i]).sum(axis=0) for i in range(k)])
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        out = np.where(size > 0, sums / np.where(size > 0, size, 1), out)
    return out


def nearest(rows: DataFrame, directions: DataFrame, keep: bool = False) -> DataFrame:
    """(vertex, network): the network of the largest inner product (9 decimals), the lowest of equal ones; with keep also x."""
    names, out = blocks.dot_arrays(rows.select("vertex", "x"), directions, "network", "dots", keep)
    d = F.transform("dots", lambda v: F.round(v, 9))
    best = F.element_at(F.array(*[F.lit(int(n)).cast("long") for n in names]), F.array_position(d, F.array_max(d)).cast("int"))
    return out.select("vertex", best.alias("network"), "x" if keep else F.array_max(d).alias("dot"))


def homogeneity(labelled: DataFrame) -> DataFrame:
    """(homogeneity, n): mean cosine of members with their label's mean row; labels of fewer than two members or zero mean are skipped."""
    members = labelled.where("label > 0").select(F.col("label").cast("long").alias("label"), unit(F.col("x")).alias("u"), "x")
    # the mean cosine of a label's members is the product of the sum of their units with the mean's: two sums, no join of members
    both = members.select("label", F.concat("x", "u").alias("x"))
    s = blocks.summed(both, ["label"]).withColumn("_d", (F.size("x") / 2).cast("int")).select("n", F.expr("slice(x, 1, _d)").alias("m"), F.expr("slice(x, _d + 1, _d)").alias("u"))
    c = s.where((F.col("n") >= 2) & (norm(F.col("m")) > 0)).select("n", dot(F.col("u"), unit(F.col("m"))).alias("c"))
    return c.agg(F.coalesce(F.sum("c") / F.sum("n"), F.lit(0.0)).alias("homogeneity"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n"))
