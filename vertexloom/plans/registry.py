"""All registered queries of the engine on the driver's tables, each with the SQL that it is compared with."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vertexloom.functions import vectors as V
from vertexloom.operators import blocks, evaluation, fit, individual, mixture, recordings, runs, series, spatial, store
from vertexloom.sources import views
from vertexloom.sources.scratch import written

from . import sql

Query = Callable[[SparkSession, str], DataFrame]

#: Parameters that the queries and their SQL share.
SEEDS, NETWORKS, KAPPA, SIGMA, EPSILON, LOG_C, CLIP = 10, 9, 30.0, 20.0, 40.0, 3.5, 0.999999
DIMENSION = 63


def _r(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """df with the columns rounded; minus zero is zero."""
    return df.withColumns({c: F.round(c, digits) + 0.0 for c in columns})


def _long(df: DataFrame, *by: str) -> DataFrame:
    """(by, feature, x) of arrays x, rounded."""
    long = df.select(*by, F.posexplode("x").alias("f", "x")).select(*by, F.col("f").cast("long").alias("feature"), "x")
    return _r(long, "x")


def _grid(s: SparkSession, d: str) -> DataFrame:
    return series.grid(views.bold(s, d))


def _correlations(s: SparkSession, d: str) -> DataFrame:
    b = _grid(s, d)
    return series.correlations(b, b.select("vertex").distinct().where(F.col("vertex") < SEEDS))


def _rows(s: SparkSession, d: str) -> DataFrame:
    return views.tensor(s, d).withColumn("x", V.unit(V.centred(F.col("x"))))


def _directions(s: SparkSession, d: str) -> DataFrame:
    return mixture.label_centroids(views.vectors(s, d))


class _Model:
    """Parts of the mixture that a query uses more than once: each is made once."""

    def __init__(self, s: SparkSession, d: str) -> None:
        self.s, self.d = s, d
        self.rows = _rows(s, d).drop("label")

    @cached_property
    def directions(self) -> DataFrame:
        return written(_directions(self.s, self.d), "directions")

    @cached_property
    def networks(self) -> list[int]:
        return mixture.networks_of(self.directions)

    @property
    def n(self) -> int:
        return len(self.networks)

    def fresh_dots(self) -> DataFrame:
        return mixture.dots(self.rows, self.directions)

    @cached_property
    def dots(self) -> DataFrame:
        return written(self.fresh_dots(), "dots")

    def scores(self) -> DataFrame:
        return mixture.likelihoods(self.fresh_dots(), self.n, KAPPA, LOG_C)

    @cached_property
    def posterior(self) -> DataFrame:
        return written(mixture.posteriors(self.scores()), "posterior")

    @cached_property
    def theta(self) -> DataFrame:
        return mixture.theta_mean(self.posterior, self.n, 2)

    def weighted(self) -> DataFrame:
        return mixture.weighted_data(self.rows, self.posterior, self.networks)

    @cached_property
    def sessions(self) -> DataFrame:
        return written(mixture.session_directions(self.weighted(), self.directions, KAPPA, SIGMA), "sessions")

    def subjects(self) -> DataFrame:
        return mixture.subject_directions(self.sessions, self.directions, SIGMA, EPSILON)

    def each(self, df: DataFrame, array: str, value: str) -> DataFrame:
        """df with a row for each network, its value rounded."""
        return _r(mixture.by_network(df, array, value, self.networks), value)


def bold_grid(s: SparkSession, d: str) -> DataFrame:
    return _r(_grid(s, d), "value")


def bold_censor(s: SparkSession, d: str) -> DataFrame:
    b = _grid(s, d)
    return _r(series.censored(b, b.select("frame").distinct().withColumn("keep", F.col("frame") % 5 != 4)), "value")


def validate_constant(s: SparkSession, d: str) -> DataFrame:
    return series.constant(_grid(s, d))


def seed_timeseries(s: SparkSession, d: str) -> DataFrame:
    b = _grid(s, d)
    roi = b.select("vertex").distinct().select("vertex", (F.col("vertex") % 10).alias("roi"))
    return _r(series.seed_series(b, roi, 11), "value")


def pearson_profile(s: SparkSession, d: str) -> DataFrame:
    return _r(_correlations(s, d), "r")


def fisher_z_profile(s: SparkSession, d: str) -> DataFrame:
    return _r(series.fisher_z(_correlations(s, d).where("vertex <> seed"), CLIP).select("vertex", "seed", "z"), "z")


def cutoff_value(s: SparkSession, d: str) -> DataFrame:
    return _r(series.cutoff(_correlations(s, d), digits=9), "cutoff")


def binary_profile(s: SparkSession, d: str) -> DataFrame:
    return series.binary_profile(_correlations(s, d), digits=9)


def normalize_row_l2(s: SparkSession, d: str) -> DataFrame:
    return _long(views.vectors(s, d).withColumn("x", V.unit(F.col("x"))), "vec_id")


def normalize_centred_literal(s: SparkSession, d: str) -> DataFrame:
    return _long(views.vectors(s, d).withColumn("x", V.literal_normal(F.transform("x", lambda v: F.round(4 * v, 0)))), "vec_id")


def avg_profile(s: SparkSession, d: str) -> DataFrame:
    return _long(series.averages(views.tensor(s, d), "subject", "vertex"), "subject", "vertex")


def label_centroids(s: SparkSession, d: str) -> DataFrame:
    return _long(_directions(s, d), "network")


def label_centroids_mean(s: SparkSession, d: str) -> DataFrame:
    return _long(mixture.mean_centroids(views.vectors(s, d), 11), "network")


def valid_vertices(s: SparkSession, d: str) -> DataFrame:
    zero = F.when(F.col("label") == 0, F.transform("x", lambda v: F.lit(0.0))).otherwise(F.col("x"))
    return evaluation.valid_vertices(views.tensor(s, d).withColumn("x", zero))


def vmf_dot(s: SparkSession, d: str) -> DataFrame:
    m = _Model(s, d)
    return m.each(m.fresh_dots(), "dots", "dot")


def posterior_softmax(s: SparkSession, d: str) -> DataFrame:
    m = _Model(s, d)
    return m.each(mixture.posteriors(m.scores()), "p", "p")


def flagship_labels(s: SparkSession, d: str) -> DataFrame:
    """Labels of every vertex and subject: centroids of labelled profiles, likelihoods, posterior, argmax."""
    m = _Model(s, d)
    return mixture.labels(mixture.posteriors(m.scores()), m.networks)


def theta_mean(s: SparkSession, d: str) -> DataFrame:
    m = _Model(s, d)
    return m.each(m.theta, "theta", "theta")


def initial_theta(s: SparkSession, d: str) -> DataFrame:
    m = _Model(s, d)
    return m.each(mixture.initial_theta(mixture.posteriors(m.scores()), m.n, 2), "theta", "theta")


def weighted_data(s: SparkSession, d: str) -> DataFrame:
    return _long(_Model(s, d).weighted(), "subject", "session", "network")


def kappa_update(s: SparkSession, d: str) -> DataFrame:
    m = _Model(s, d)
    return _r(mixture.kappa_update(m.dots, written(mixture.posteriors(mixture.likelihoods(m.dots, m.n, KAPPA, LOG_C)), "posterior"), m.n, DIMENSION, 5.0), "numerator", "mass", "rbar", "kappa", digits=5)


def inverse_ratio(s: SparkSession, d: str) -> DataFrame:
    m = _Model(s, d)
    each = mixture.by_network(m.fresh_dots(), "dots", "dot", m.networks)
    dots = each.where("dot between -0.99 and 0.99").groupBy("network").agg(F.avg(F.abs("dot")).alias("rbar"))
    return _r(dots.select("network", "rbar", V.inverse_ratio(F.col("rbar"), DIMENSION).alias("kappa")), "rbar", "kappa")


def session_direction(s: SparkSession, d: str) -> DataFrame:
    return _long(_Model(s, d).sessions, "subject", "session", "network")


def subject_direction(s: SparkSession, d: str) -> DataFrame:
    return _long(_Model(s, d).subjects(), "subject", "network")


def group_direction(s: SparkSession, d: str) -> DataFrame:
    return _long(mixture.group_directions(_Model(s, d).subjects()), "network")


def sigma_update(s: SparkSession, d: str) -> DataFrame:
    m = _Model(s, d)
    sessions = m.sessions.where("not (subject = 1 and session = 1 and network <= 3)")
    return _r(mixture.sigma_update(sessions, m.subjects(), 2, DIMENSION), "rbar", "sigma", digits=4)


def em_cost(s: SparkSession, d: str) -> DataFrame:
    m = _Model(s, d)
    p = written(mixture.posteriors(mixture.likelihoods(m.dots, m.n, KAPPA, LOG_C)), "posterior")
    return _r(mixture.em_cost(m.dots, p, mixture.theta_mean(p, m.n, 2), m.n, KAPPA, LOG_C), "cost", digits=3)


def em_full_fit(s: SparkSession, d: str) -> DataFrame:
    """The group fit with few steps of each kind: labels of every vertex and subject."""
    return fit.group_labels(_rows(s, d).select("vertex", "subject", "session", "x"), _directions(s, d), fit.Settings(start=KAPPA * 10, outer=2, middle=2, inner=3))


def kmeans_lloyd(s: SparkSession, d: str) -> DataFrame:
    v = views.vectors(s, d).select(F.col("vec_id").alias("vertex"), V.unit(F.col("x")).alias("x"))
    start = v.where("vertex < 4").select(F.col("vertex").alias("network"), "x")
    return mixture.lloyd(v, start, 3)


def _edges(s: SparkSession, d: str) -> DataFrame:
    return views.ring(views.tensor(s, d))


def mrf_potential(s: SparkSession, d: str) -> DataFrame:
    m = _Model(s, d)
    return m.each(spatial.potentials(_edges(s, d), m.posterior, m.n), "v", "v")


def mrf_potential_general(s: SparkSession, d: str) -> DataFrame:
    m = _Model(s, d)
    return m.each(spatial.potentials(_edges(s, d), m.posterior, m.n, 0.25, 1.5, fast=False), "v", "v")


def mrf_potential_edges(s: SparkSession, d: str) -> DataFrame:
    """Costs of each edge of its own."""
    m = _Model(s, d)
    edges = _edges(s, d).selectExpr("src", "dst", "(src + dst) % 3 * 0.25 as same", "1.0 + (src + 2 * dst) % 5 * 0.5 as differ")
    return m.each(spatial.edge_potentials(edges, m.posterior, m.n), "v", "v")


def individual_estep(s: SparkSession, d: str) -> DataFrame:
    """One sweep of every subject: likelihood, group prior with weight 2 and smoothing with weight 3, as posterior."""
    m = _Model(s, d)
    scores = mixture.likelihoods(m.dots, m.n, KAPPA, LOG_C)
    p = written(mixture.posteriors(scores), "posterior")
    return m.each(individual.sweep(scores, mixture.theta_mean(p, m.n, 2), spatial.potentials(_edges(s, d), p, m.n), 2.0, 3.0), "p", "p")


def individual_fit(s: SparkSession, d: str) -> DataFrame:
    """The individual fit of every subject from the group's directions and prior, with few steps of each kind: labels."""
    m = _Model(s, d)
    priors = individual.Priors(m.directions, m.theta, KAPPA * 10, KAPPA * 10)
    found = individual.fit(m.rows.select("vertex", "subject", "session", "x"), _edges(s, d), priors, individual.Settings(start=KAPPA * 10, prior=2.0, smooth=3.0, outer=2, inner=2, numerical=3, sweeps=3))
    return mixture.labels(found.posterior, m.networks)


def winner_take_all(s: SparkSession, d: str) -> DataFrame:
    """Voxels are the rows of subject 1, the surface those of subject 0."""
    v = views.vectors(s, d).select("vec_id", "label", V.unit(F.col("x")).alias("x"))
    surface, voxels = v.where("vec_id % 2 = 0").withColumnRenamed("vec_id", "vertex"), v.where("vec_id % 2 = 1").select(F.col("vec_id").alias("voxel"), "x")
    near = blocks.most_similar(surface.where("label <> 0").select("vertex", "x"), "vertex", voxels, "voxel", 25)
    return _r(spatial.winner_take_all(near, surface.select("vertex", "label"), 25), "confidence")


def vol2surf_fc(s: SparkSession, d: str) -> DataFrame:
    """The mean over two runs of Fisher-Z correlations, odd and even frames being the runs."""
    b = _grid(s, d)
    seeds = b.select("vertex").distinct().where(F.col("vertex") < SEEDS)
    z = [series.fisher_z(series.correlations(b.where(F.col("frame") % 2 == k), seeds).where("vertex <> seed"), CLIP) for k in (0, 1)]
    return _r(z[0].union(z[1]).groupBy("vertex", "seed").agg((F.sum("z") / 2).alias("z")), "z")


def _recordings(s: SparkSession, d: str) -> DataFrame:
    """A recording for each kind of event."""
    return recordings.grid(views.recordings(s, d), ["recording"])


def _run_profiles(s: SparkSession, d: str) -> DataFrame:
    b = _recordings(s, d)
    return recordings.profiles(b, b.select("vertex").distinct().where(F.col("vertex") < SEEDS), ["recording"])


def run_profiles(s: SparkSession, d: str) -> DataFrame:
    """Correlations of every recording with its own seeds."""
    return _r(recordings.by_seed(_run_profiles(s, d), ["recording"], "r", "r"), "r")


def run_cutoffs(s: SparkSession, d: str) -> DataFrame:
    return _r(recordings.cutoffs(_run_profiles(s, d), ["recording"], digits=9), "cutoff", digits=9)


def run_binary_profiles(s: SparkSession, d: str) -> DataFrame:
    return recordings.by_seed(recordings.binary(_run_profiles(s, d), ["recording"], digits=9), ["recording"], "bits", "bit")


def run_problems(s: SparkSession, d: str) -> DataFrame:
    """All users in all recordings: those without an event in one do not vary there."""
    b = views.recordings(s, d)
    users = views.bold(s, d).select("vertex").distinct()
    last = b.groupBy("recording").agg(F.max("frame").alias("last")).agg(F.collect_list(F.struct("recording", "last")).alias("all"))  # one row
    every = users.join(F.broadcast(last)).select("vertex", F.inline("all")).select("recording", "vertex", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("frame"))
    every = every.join(b, ["recording", "vertex", "frame"], "left").select("recording", "vertex", "frame", F.coalesce("value", F.lit(0.0)).alias("value"))
    cortex = users.withColumn("cortex", F.col("vertex") % 11 != 0)
    return recordings.problems(every, ["recording"], cortex, users.where(F.col("vertex") < SEEDS))


def homogeneity(s: SparkSession, d: str) -> DataFrame:
    return _r(mixture.homogeneity(views.vectors(s, d)), "homogeneity")


def _two_labels(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    t = views.tensor(s, d)
    cell = F.struct("vertex", "session").alias("vertex")
    return tuple(t.where(f"subject = {k}").select(cell, "label") for k in (0, 1))


def dice_report(s: SparkSession, d: str) -> DataFrame:
    return _r(evaluation.dice(*_two_labels(s, d)), "dice")


def agreement_report(s: SparkSession, d: str) -> DataFrame:
    return _r(evaluation.agreement(*_two_labels(s, d)), "agreement", "union_agreement")


def tolerance_report(s: SparkSession, d: str) -> DataFrame:
    """Directions of subject 0 against those of subject 1."""
    v = views.vectors(s, d)
    a, b = (mixture.mean_centroids(v.where(f"vec_id % 2 = {k}"), 9).select("network", F.posexplode("x").alias("f", "value")) for k in (0, 1))
    return _r(evaluation.tolerance(a, b, ["network", "f"], 1e-3, 1e-2), "max_absolute", "max_relative")


def neighbours(s: SparkSession, d: str) -> DataFrame:
    """Triangles of customers, suppliers' cousins: each nation's key with the next two."""
    faces = views.table(s, d, "customer").select(F.col("c_custkey").alias("a"), (F.col("c_custkey") + 1).alias("b"), (F.col("c_custkey") + F.col("c_nationkey") + 2).alias("c"))
    return spatial.neighbours(faces).select("src", F.array_join("neighbours", ",").alias("neighbours"))


def _points(s: SparkSession, d: str) -> DataFrame:
    return views.vectors(s, d).select(F.col("vec_id").alias("vertex"), *[F.get("x", F.lit(i)).alias(c) for i, c in enumerate("xyz")])


def nearest_seed(s: SparkSession, d: str) -> DataFrame:
    p = _points(s, d)
    return _r(spatial.nearest(p, p.where("vertex % 25 = 0").withColumnRenamed("vertex", "seed")), "distance")


def boundary_fill(s: SparkSession, d: str) -> DataFrame:
    edges = _edges(s, d).withColumn("length", 1.0 + F.least("src", "dst") % 3 * 0.5)
    valid = views.template(s, d).where("label > 3").select("vertex")
    return _r(spatial.filled(edges, valid, 4.0), "distance")


def coverage_counts(s: SparkSession, d: str) -> DataFrame:
    t = views.tensor(s, d)
    zero = F.when(F.col("label") == 0, F.transform("x", lambda v: F.lit(0.0))).otherwise(F.col("x"))
    cortex = t.select("vertex").distinct().withColumn("cortex", F.col("vertex") % 11 != 0)
    return evaluation.coverage(t.withColumn("x", zero).where("vertex % 5 <> 2 or session = 0"), cortex)


def support_masks(s: SparkSession, d: str) -> DataFrame:
    zero = F.when(F.col("label") < 4, F.transform("x", lambda v: F.lit(0.0))).otherwise(F.col("x"))
    return evaluation.support(views.tensor(s, d).withColumn("x", zero))


def _files(s: SparkSession, d: str) -> DataFrame:
    o = views.table(s, d, "orders")
    path = F.format_string("in/sub-%02d/ses-%d/func/sub-%02d_ses-%d_task-rest_run-%d_hemi-%s_bold.func.gii", F.col("o_custkey") % 40, F.col("o_orderkey") % 12, F.col("o_custkey") % 40, F.col("o_orderkey") % 12, F.expr("o_orderkey div 12 % 7"), F.when(F.col("o_totalprice") > 150000, "L").otherwise("R"))
    return o.select(path.alias("path")).distinct()


def _runs(s: SparkSession, d: str) -> DataFrame:
    e = runs.entities(_files(s, d))
    return e.select("path", *[F.try_element_at("entities", F.lit(k)).alias(n) for k, n in (("sub", "subject"), ("ses", "session"), ("task", "task"), ("run", "run"), ("hemi", "hemi"))])


def entity_parse(s: SparkSession, d: str) -> DataFrame:
    return _runs(s, d)


def run_pairing(s: SparkSession, d: str) -> DataFrame:
    return runs.paired(_runs(s, d), ["subject", "session", "task", "run"])


def session_numbering(s: SparkSession, d: str) -> DataFrame:
    own = _runs(s, d).select("subject", "session", "task", "run", "hemi")
    return runs.numbered(own, "subject", ["session", "task", "run", "hemi"])


def profile_list_grid(s: SparkSession, d: str) -> DataFrame:
    own = runs.numbered(_runs(s, d).select("subject", "session", "task", "run", "hemi", "path"), "subject", ["session", "task", "run", "hemi"])
    return runs.gaps(own, "subject", "session_number", "path", 200)


def manifest_json(s: SparkSession, d: str) -> DataFrame:
    return runs.manifest(_runs(s, d), "subject", "session", "run", "hemi")


def requested_missing(s: SparkSession, d: str) -> DataFrame:
    asked = s.range(60).select(F.format_string("%02d", F.col("id")).alias("subject"))
    return runs.missing(asked, _runs(s, d), "subject")


def run_discovery(s: SparkSession, d: str) -> DataFrame:
    return runs.discovered(_files(s, d)).drop("acq", "dir")


def run_filters(s: SparkSession, d: str) -> DataFrame:
    return runs.chosen(runs.discovered(_files(s, d)), subject=["sub-03", "17", "21"], session=["1", "ses-10"]).drop("acq", "dir")


def censor_once(s: SparkSession, d: str) -> DataFrame:
    b = _grid(s, d)
    mask = b.select("frame").distinct().withColumn("keep", (F.col("frame") % 5 != 4).cast("int"))
    return _r(series.censor_mask(series.censor_mask(b, mask), mask), "value")


def nonfinite_to_zero(s: SparkSession, d: str) -> DataFrame:
    """Series whose value is above 400 somewhere are taken as not finite."""
    b = _grid(s, d)
    return _r(series.finite_series(b.withColumn("value", F.when(F.col("value") > 400, float("inf")).otherwise(F.col("value")))), "value")


def _cortex(s: SparkSession, d: str) -> DataFrame:
    return views.tensor(s, d).select("vertex").distinct().withColumn("cortex", F.col("vertex") % 11 != 0)


def cortex_mask(s: SparkSession, d: str) -> DataFrame:
    return _long(series.masked(views.tensor(s, d).select("vertex", "subject", "session", "x"), _cortex(s, d)), "vertex", "subject", "session")


def expanded_labels(s: SparkSession, d: str) -> DataFrame:
    """Labels of the cortex, listed by places, on all vertices."""
    place = F.when(F.col("cortex"), F.col("vertex") * 3)
    known = views.template(s, d).select((F.col("vertex") * 3).alias("place"), F.col("label").alias("value"))
    return series.expanded(known, _cortex(s, d).select("vertex", place.alias("place"))).withColumnRenamed("value", "label")


def hemisphere_concat(s: SparkSession, d: str) -> DataFrame:
    """Subject 0 stands for the left hemisphere, subject 1 for the right one."""
    t = views.tensor(s, d).select("vertex", "session", "subject", "label")
    size = t.agg(F.max("vertex") + 1).first()[0] or 0
    return series.hemispheres(t.where("subject = 0").drop("subject"), t.where("subject = 1").drop("subject"), size)


def _masks(s: SparkSession, d: str) -> DataFrame:
    """A mask for each subject and session: whether the row's label is above 2."""
    return views.tensor(s, d).select((F.col("subject") * 2 + F.col("session")).alias("mask"), "vertex", (F.col("label") > 2).alias("inside"))


def mask_partition(s: SparkSession, d: str) -> DataFrame:
    return evaluation.partition_problems(_masks(s, d))


def mask_intersection(s: SparkSession, d: str) -> DataFrame:
    return evaluation.common(_masks(s, d))


def scatter_into_mask(s: SparkSession, d: str) -> DataFrame:
    """Account balances, in the order of customers, into the voxels (suppliers' and customers' keys) that have one."""
    c = views.table(s, d, "customer")
    mask = c.select(F.col("c_custkey").alias("voxel"), (F.col("c_nationkey") < 20).alias("inside"))
    order = spatial.placed(c.where("c_nationkey < 20").select("c_custkey", "c_acctbal"), "c_custkey")
    return _r(spatial.scattered(mask, order.select("place", F.col("c_acctbal").alias("value"))), "value")


def face_majority(s: SparkSession, d: str) -> DataFrame:
    c = views.table(s, d, "customer")
    faces = c.select(F.col("c_custkey").alias("face"), F.col("c_custkey").alias("a"), (F.col("c_custkey") + 1).alias("b"), (F.col("c_custkey") + F.col("c_nationkey") + 2).alias("c"))
    return spatial.face_labels(faces, c.select(F.col("c_custkey").alias("vertex"), (F.col("c_nationkey") % 4).cast("long").alias("label")))


def boundary_fill_zero(s: SparkSession, d: str) -> DataFrame:
    """All vertices: filled along edges up to 1.5, others by a finer distance to the first valid vertex, the rest with source -1."""
    edges = _edges(s, d).withColumn("length", 1.0 + F.least("src", "dst") % 3 * 0.5)
    valid = written(views.template(s, d).where("label > 7").select("vertex"), "valid")
    first = F.broadcast(valid.agg(F.min("vertex").alias("source")))  # one row
    finer = views.tensor(s, d).select("vertex").distinct().join(first).select("vertex", "source", (F.abs(F.col("vertex") - F.col("source")) / 20.0).alias("distance"))
    return _r(spatial.boundary_filled(views.tensor(s, d).select("vertex").distinct(), edges, valid, 1.5, zero=True, refined=finer), "distance")


def kmeans_restarts(s: SparkSession, d: str) -> DataFrame:
    v = views.vectors(s, d).select(F.col("vec_id").alias("vertex"), V.unit(F.col("x")).alias("x"))
    starts = [v.where(f"vertex between {k} and {k + 3}").select((F.col("vertex") - k).alias("network"), "x") for k in (0, 8)]
    return mixture.restarts(v, starts, 2)


def _pages_as_files(s: SparkSession, d: str, table: str = "pages") -> DataFrame:
    """Web pages stand for files: the url is the name, the page the content."""
    p = views.table(s, d, table)
    return p.select(F.concat(F.col("page_id").cast("string"), F.lit(" "), F.coalesce("url", F.lit(""))).alias("name"), F.octet_length("html").cast("long").alias("size"), F.sha2(F.col("html").cast("binary"), 256).alias("sha256"), "page_id")


def content_differences(s: SparkSession, d: str) -> DataFrame:
    """Pages against a manifest in which some are missing, some changed and some unknown."""
    files = _pages_as_files(s, d)
    pinned = files.where("page_id % 17 <> 3").select("name", F.when(F.col("page_id") % 13 == 5, F.sha2(F.col("name").cast("binary"), 256)).otherwise(F.col("sha256")).alias("sha256"))
    return store.differences(files.where("page_id % 19 <> 4"), pinned)


def content_tree(s: SparkSession, d: str) -> DataFrame:
    return store.tree_digest(_pages_as_files(s, d))


def kmeans_seeded(s: SparkSession, d: str) -> DataFrame:
    """Networks after two steps of k-means from directions that k-means|| has spread."""
    v = views.vectors(s, d).select(F.col("vec_id").alias("vertex"), V.unit(F.col("x")).alias("x"))
    return mixture.lloyd(v, mixture.seeded(v, NETWORKS, seed=3), 2)


def relative_change(s: SparkSession, d: str) -> DataFrame:
    """Totals of the days stand for the costs of a fit's steps."""
    return _r(runs.record_changes(_grid(s, d).groupBy(F.col("frame").alias("step")).agg(F.round(F.sum("value"), 6).alias("cost"))), "cost", "change")


QUERIES: dict[str, Query] = {
    q.__name__: q
    for q in (
        bold_grid, bold_censor, validate_constant, seed_timeseries, pearson_profile, fisher_z_profile, cutoff_value, binary_profile,
        normalize_row_l2, normalize_centred_literal, avg_profile, label_centroids, label_centroids_mean, valid_vertices, vmf_dot,
        posterior_softmax, flagship_labels, theta_mean, initial_theta, weighted_data, kappa_update, inverse_ratio, session_direction,
        subject_direction, group_direction, sigma_update, em_cost, em_full_fit, kmeans_lloyd, mrf_potential, mrf_potential_general, mrf_potential_edges,
        individual_estep, individual_fit, winner_take_all, vol2surf_fc, homogeneity, dice_report, agreement_report, tolerance_report, neighbours,
        nearest_seed, boundary_fill, coverage_counts, support_masks, entity_parse, run_pairing, session_numbering, profile_list_grid,
        manifest_json, requested_missing, run_discovery, run_filters, censor_once, nonfinite_to_zero, cortex_mask, expanded_labels,
        hemisphere_concat, mask_partition, mask_intersection, scatter_into_mask, face_majority, boundary_fill_zero, kmeans_restarts,
        kmeans_seeded, content_differences, content_tree, relative_change, run_profiles, run_cutoffs, run_binary_profiles, run_problems,
    )
}

ORACLES: dict[str, str] = {name: text for name, text in sql.ORACLES.items() if name in QUERIES}
