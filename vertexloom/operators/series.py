"""Time series to profiles: grids, censoring, seeds, correlations, thresholds, averages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vertexloom.functions.vectors import clipped_atanh
from vertexloom.functions.vectors import standardised as zscore
from vertexloom.sources.scratch import written

from .blocks import products


def grid(bold: DataFrame, fill: float = 0.0) -> DataFrame:
    """bold with every frame of every vertex; cells without a row get `fill`. A vertex's frames are made in its own row."""
    last = F.broadcast(bold.agg(F.max("frame").alias("last")))
    frames = bold.select("vertex").distinct().join(last).select("vertex", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("frame"))
    return frames.join(bold, ["vertex", "frame"], "left").select("vertex", "frame", F.coalesce("value", F.lit(fill)).alias("value"))


def censored(bold: DataFrame, keep: DataFrame) -> DataFrame:
    """The frames that keep (frame, keep) marks."""
    return bold.join(keep.where("keep").select("frame"), "frame", "left_semi").select("vertex", "frame", "value")


def censor_mask(bold: DataFrame, mask: DataFrame, least: int = 3) -> DataFrame:
    """bold censored once: a mask of all frames is applied, one of as many frames as bold has left was applied before.

    mask: frame, keep (0 or 1). Anything else is an error, also fewer than `least` frames.
    """
    n = bold.agg(F.count_distinct("frame")).first()[0]
    total, kept, odd = mask.agg(F.count("*"), F.count_if(F.col("keep") == 1), F.count_if(F.col("keep").isNull() | ~F.col("keep").isin(0, 1))).first()
    if odd or kept < least:
        raise ValueError(f"a mask has zeros and ones only and keeps at least {least} frames")
    if total == n:
        return censored(bold, mask.withColumn("keep", F.col("keep") == 1))
    if kept == n:
        return bold
    raise ValueError(f"the mask has {total} frames and keeps {kept}, the series has {n}")


def constant(bold: DataFrame) -> DataFrame:
    """(vertex, is_constant, all_zero, finite) of every series."""
    v = F.col("value")
    return bold.groupBy("vertex").agg((F.max(v) == F.min(v)).alias("is_constant"), F.bool_and(v == 0).alias("all_zero"), F.bool_and(~F.isnan(v) & (F.abs(v) != float("inf"))).alias("finite"))


def seed_series(bold: DataFrame, roi: DataFrame, n_roi: int) -> DataFrame:
    """(roi, frame, value): the mean series of the vertices of each roi 0 .. n_roi - 1; a roi without vertices is zero."""
    means = bold.join(roi, "vertex").groupBy("roi", "frame").agg(F.avg("value").alias("value"))
    frames = bold.select("frame").distinct().withColumn("roi", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_roi - 1).cast("long"))))
    return frames.join(means, ["roi", "frame"], "left").select("roi", "frame", F.coalesce("value", F.lit(0.0)).alias("value"))


def standardised(bold: DataFrame) -> DataFrame:
    """(vertex, z): each series less its mean over its length, in the order of frames; zero if it does not vary or is not finite."""
    s = bold.groupBy("vertex").agg(F.transform(F.array_sort(F.collect_list(F.struct("frame", "value"))), lambda p: p["value"]).alias("s"))
    return s.select("vertex", zscore(F.col("s")).alias("z"))


def correlations(bold: DataFrame, seeds: DataFrame) -> DataFrame:
    """(vertex, seed, r): Pearson of every series with those of the seeds; zero where one does not vary or is not finite.

    Series are multiplied in blocks with the seeds', which travel to the tasks in slices of a bounded size.
    """
    z = written(standardised(bold), "series")
    s = z.join(seeds.select("vertex"), "vertex", "left_semi").select(F.col("vertex").alias("seed"), F.col("z").alias("x"))
    return products(z.withColumnRenamed("z", "x"), s, "seed", "r")


def fisher_z(r: DataFrame, most: float = 1 - 1e-15) -> DataFrame:
    return r.withColumn("z", clipped_atanh(F.col("r"), most))


def cutoff(r: DataFrame, share: float = 0.1, digits: int | None = None) -> DataFrame:
    """(rank, cutoff): the rank-th largest correlation, rank the share of all of them rounded half up; all hemispheres together.

    Equal values (to so many digits, if given) are counted before the running sum over distinct values, from the largest down, so that
    only value counts are ordered. A rank below one or a cutoff that is not positive is an error.
    """
    values = r.groupBy((F.col("r") if digits is None else F.round("r", digits)).alias("v")).agg(F.count("*").alias("n"))
    bins = written(values.withColumn("bin", F.floor(F.col("v") * 4096)), "values")
    # two passes: which bin of values has the rank, then the place inside it
    down = Window.orderBy(F.col("bin").desc())
    per_bin = bins.groupBy("bin").agg(F.sum("n").alias("n"))
    per_bin = per_bin.withColumn("upto", F.sum("n").over(down)).withColumn("all", F.sum("n").over(Window.partitionBy()))
    rank = F.floor(F.col("all") * share + 0.5).cast("long")
    hit = per_bin.withColumn("rank", rank).where("rank >= 1 and upto >= rank and upto - n < rank").select("bin", "rank", (F.col("upto") - F.col("n")).alias("before"))  # one row at most
    inside = bins.join(F.broadcast(hit), "bin").withColumn("upto", F.col("before") + F.sum("n").over(Window.partitionBy("bin").orderBy(F.col("v").desc())))
    found = inside.where("upto >= rank and upto - n < rank and v > 0").agg(F.max(F.struct("rank", "v")).alias("c"))
    c = F.when(F.col("c").isNull(), F.raise_error(F.lit("no positive cutoff: too few correlations, or none of the largest is positive"))).otherwise(F.col("c"))
    return found.select(c.alias("c")).select("c.rank", F.col("c.v").alias("cutoff"))


def binary_profile(r: DataFrame, share: float = 0.1, digits: int | None = None) -> DataFrame:
    """(vertex, seed, bit): 1 for correlations at or above the joint cutoff, ties kept. r is computed once."""
    r = written(r, "correlations")
    c = F.broadcast(cutoff(r, share, digits))  # one row
    value = F.col("r") if digits is None else F.round("r", digits)
    return r.join(c).select("vertex", "seed", (value >= F.col("cutoff")).cast("long").alias("bit"))


def averages(profiles: DataFrame, *by: str) -> DataFrame:
    """(by, x): the mean of x (an array) over rows with equal `by`, the few sessions of one vertex; absent sessions do not count."""
    rows = profiles.groupBy(*by).agg(F.collect_list("x").alias("all"))
    sums = F.aggregate(F.slice("all", F.lit(2), F.size("all")), F.col("all")[0], lambda a, x: F.zip_with(a, x, lambda v, w: v + w))
    return rows.select(*by, F.transform(sums, lambda v: v / F.size("all")).alias("x"))


def masked(profiles: DataFrame, cortex: DataFrame) -> DataFrame:
    """profiles (vertex, x) with zero rows for vertices that cortex (vertex, cortex) does not mark, or does not know."""
    keep = F.coalesce("cortex", F.lit(False))
    j = profiles.join(cortex.select("vertex", "cortex"), "vertex", "left")
    return j.withColumn("x", F.when(keep, F.col("x")).otherwise(F.transform("x", lambda v: v * 0))).select(profiles.columns)


def finite_series(bold: DataFrame) -> DataFrame:
    """bold (vertex, frame, value) in which a series with a value that is not finite is zero altogether."""
    odd = bold.where(F.isnan("value") | (F.abs("value") == float("inf"))).select("vertex").distinct()
    marked = bold.join(odd.withColumn("odd", F.lit(True)), "vertex", "left")
    return marked.select("vertex", "frame", F.when(F.col("odd"), F.lit(0.0)).otherwise(F.col("value")).alias("value"))


def hemispheres(left: DataFrame, right: DataFrame, size: int, right_size: int | None = None) -> DataFrame:
    """The rows of both hemispheres (vertex, ...): the right one's vertices follow the `size` of the left one. Vertices outside a
    hemisphere are an error; the right one has as many as the left one unless right_size says otherwise."""
    inside = lambda n: F.when(F.col("vertex").between(0, n - 1), F.col("vertex")).otherwise(F.raise_error(F.lit("a vertex is outside its hemisphere")))
    return left.withColumn("vertex", inside(size)).unionByName(right.withColumn("vertex", inside(size if right_size is None else right_size) + F.lit(size)))


def expanded(rows: DataFrame, vertices: DataFrame, fill: str = "0") -> DataFrame:
    """rows (place, value) of a reduced list, on all of vertices (vertex, place): those without place get `fill`."""
    value = F.coalesce("value", F.lit(fill).cast(rows.schema["value"].dataType))
    return vertices.select("vertex", "place").join(rows.select("place", "value"), "place", "left").select("vertex", value.alias("value"))
