"""Meshes and neighbours: edges of faces, smoothing potentials, nearest vertices, bounded paths, winner takes all."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vertexloom.functions.vectors import total
from vertexloom.sources.scratch import discarded, written

#: Seeds of a cell in the search for the nearest.
CELL_SEEDS = 64


def neighbours(faces: DataFrame) -> DataFrame:
    """(src, neighbours) of triangles (a, b, c): sorted sets."""
    pairs = F.array(*[F.struct(F.col(x).alias("src"), F.col(y).alias("dst")) for x in "abc" for y in "abc" if x != y])
    return faces.select(F.explode(pairs).alias("e")).groupBy("e.src").agg(F.sort_array(F.collect_set("e.dst")).alias("neighbours"))


def potentials(edges: DataFrame, posterior: DataFrame, n: int, same: float = 0.0, differ: float = 1.0, fast: bool = True) -> DataFrame:
    """(vertex, subject, v): cost of each of n networks at a vertex, by its neighbours' posterior (vertex, subject, p).

    fast: the number of neighbours less their posterior (for costs 0 and 1). Otherwise the general sum, which differs where a
    neighbour's posterior does not add up to one.
    """
    near = edges.join(posterior.withColumnRenamed("vertex", "dst"), "dst")
    own = F.array(*[F.sum(F.get("p", F.lit(i))) for i in range(n)])
    sums = near.groupBy("src", "subject").agg(own.alias("own"), F.sum(total(F.col("p"))).alias("mass"))
    if fast:
        degree = edges.groupBy("src").agg(F.count("*").alias("degree"))
        v = F.transform("own", lambda p: F.col("degree") - p)
        return sums.join(degree, "src").select(F.col("src").alias("vertex"), "subject", v.alias("v"))
    v = F.transform("own", lambda p: (same - differ) * p + differ * F.col("mass"))
    return sums.select(F.col("src").alias("vertex"), "subject", v.alias("v"))


def edge_potentials(edges: DataFrame, posterior: DataFrame, n: int) -> DataFrame:
    """(vertex, subject, v): as potentials(), with costs of each edge of its own: edges (src, dst, same, differ)."""
    near = edges.join(posterior.withColumnRenamed("vertex", "dst"), "dst")
    mass = total(F.col("p"))
    own = F.array(*[F.sum((F.col("same") - F.col("differ")) * F.get("p", F.lit(i)) + F.col("differ") * F.col("_mass")) for i in range(n)])
    return near.withColumn("_mass", mass).groupBy(F.col("src").alias("vertex"), "subject").agg(own.alias("v"))


def cells(seeds: DataFrame, size: int = CELL_SEEDS) -> DataFrame:
    """(seed, x, y, z, cell): seeds in cells of at most `size`; of seeds at one place the lowest stays.

    Cells are cut in two at a quantile of their widest side until they are small enough, so that they follow the seeds' density: a level of cuts
    is one pass, whatever their number.
    """
    own = written(seeds.groupBy("x", "y", "z").agg(F.min("seed").alias("seed")).select("seed", *"xyz", F.lit(0).cast("long").alias("cell")), "cells")
    while True:
        box = own.groupBy("cell").agg(F.count("*").alias("n"), *[(F.max(c) - F.min(c)).alias(f"w{c}") for c in "xyz"])
        large = box.where(F.col("n") > size)
        if large.isEmpty():
            return own
        widest = F.greatest(*[f"w{c}" for c in "xyz"])
        side = F.when(F.col("wx") == widest, 0).when(F.col("wy") == widest, 1).otherwise(2)
        value = F.get(F.array(*"xyz"), F.col("side"))
        at = own.join(large.select("cell", side.alias("side")), "cell").withColumn("v", value).groupBy("cell", "side").agg(F.percentile_approx("v", 0.5, 1000).alias("q"), F.max("v").alias("top"))
        # what lies on the cut goes left, unless nothing would be right of it
        right = F.when(F.col("q") < F.col("top"), value > F.col("q")).otherwise(value >= F.col("q"))
        cut = own.join(at, "cell", "left").select("seed", *"xyz", (2 * F.col("cell") + F.coalesce(right, F.lit(False)).cast("long")).alias("cell"))
        before, own = own, written(cut, "cells")
        discarded(before)


def nearest(points: DataFrame, seeds: DataFrame, size: int = CELL_SEEDS) -> DataFrame:
    """(vertex, seed, distance): the nearest of seeds (seed, x, y, z) to points (vertex, x, y, z) by 9 decimals, the lowest of equal ones.

    A point meets the seeds of the cell whose box is nearest, which bounds its distance, and then those of the other cells whose boxes are
    not beyond that bound. Boxes, one for `size` seeds, travel to the points. A point without three finite coordinates has no seed.
    """
    own = cells(seeds.select("seed", *"xyz"), size)
    box = own.groupBy("cell").agg(*[f(c).alias(f"{n}{c}") for n, f in (("a", F.min), ("b", F.max)) for c in "xyz"])
    rows = sorted(box.collect(), key=lambda r: r["cell"])  # one for each `size` seeds, about
    if not rows:
        return points.select("vertex", F.lit(None).cast("long").alias("seed"), F.lit(None).cast("double").alias("distance"))
    names = np.array([r["cell"] for r in rows])
    low, high = (np.array([[r[f"{n}{c}"] for c in "xyz"] for r in rows], float) for n in "ab")
    step = max(1, (1 << 21) // len(rows))

    def boxes(at: np.ndarray) -> np.ndarray:
        return np.sqrt((np.maximum(0, np.maximum(low[None] - at[:, None], at[:, None] - high[None])) ** 2).sum(axis=2))

    def columns(batch: pa.RecordBatch) -> np.ndarray:
        return np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i in (1, 2, 3)], axis=1)

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, step) for b in batches for i in range(0, b.num_rows, step)):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names[boxes(columns(batch)).argmin(axis=1)])], names=["vertex", *"xyz", "cell"])

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, step) for b in batches for i in range(0, b.num_rows, step)):
            near = boxes(columns(batch)) <= batch.column(4).to_numpy()[:, None] + 1e-9
            near &= batch.column(5).to_numpy()[:, None] != names[None]
            i, j = np.nonzero(near)
            rest = batch.take(pa.array(i))
            yield pa.RecordBatch.from_arrays([*rest.columns[:4], pa.array(names[j])], names=["vertex", *"xyz", "cell"])

    finite = F.lit(True)
    for c in "xyz":
        finite = finite & F.coalesce(~F.isnan(c) & (F.abs(c) != float("inf")), F.lit(False))
    kind = points.schema["vertex"].dataType.simpleString()
    asked = points.select("vertex", *[F.col(c).cast("double").alias(c) for c in "xyz"])
    within = own.groupBy("cell").agg(F.collect_list(F.struct("seed", *"xyz")).alias("seeds"))  # at most `size` of a cell
    away = lambda q: F.round(F.sqrt(sum(((F.col(c) - q[c]) ** 2 for c in "xyz"), F.lit(0.0))), 9)
    best = F.array_min(F.transform("seeds", lambda q: F.struct(away(q).alias("distance"), q["seed"].alias("seed"))))
    first = asked.where(finite).mapInArrow(home, f"vertex {kind}, x double, y double, z double, cell long")
    first = written(first.join(within, "cell").select("vertex", *"xyz", "cell", best.alias("b")), "nearest")
    more = first.select("vertex", *"xyz", "b.distance", "cell").mapInArrow(others, f"vertex {kind}, x double, y double, z double, cell long")
    more = more.join(within, "cell").select("vertex", best.alias("b"))
    found = first.select("vertex", "b").unionByName(more).groupBy("vertex").agg(F.min("b").alias("b")).select("vertex", "b.seed", "b.distance")
    return found.unionByName(asked.where(~finite).select("vertex"), allowMissingColumns=True)


def filled(edges: DataFrame, valid: DataFrame, limit: float, width: float | None = None) -> DataFrame:
    """(vertex, source, distance): for every vertex within `limit` along edges (src, dst, length), the nearest valid vertex.

    Delta stepping: vertices whose distance has got smaller wait in buckets of `width` (the mean edge's length unless given); the nearest bucket's go
    over their edges, until none waits. Only they and the vertices they reach are moved: what is known is a growing list of such
    improvements, from which those of the vertices at hand are looked up. Equal distances (9 decimals) go to the lowest source.
    """
    edges = written(edges.select("src", "dst", "length").where(F.col("length") <= limit), "edges")
    width = width or edges.agg(F.avg("length")).first()[0] or 1.0
    best = F.min(F.struct("distance", "source")).alias("b")
    open_ = written(valid.select("vertex", F.col("vertex").alias("source"), F.lit(0.0).alias("distance")).distinct(), "front")
    known, fronts = [open_], []
    while True:
        low = open_.agg(F.min("distance")).first()[0]
        if low is None:
            break
        bound = (math.floor(low / width) + 1) * width
        now, later = open_.where(F.col("distance") < bound), open_.where(F.col("distance") >= bound)
        reached = now.join(edges, now["vertex"] == edges["src"]).select(F.col("dst").alias("vertex"), "source", F.round(F.col("distance") + F.col("length"), 9).alias("distance"))
        reached = reached.where(F.col("distance") <= limit).groupBy("vertex").agg(best)
        before = _all(known).join(reached.select("vertex"), "vertex", "left_semi").groupBy("vertex").agg(best).select("vertex", F.col("b").alias("k"))
        better = reached.join(before, "vertex", "left").where(F.col("k").isNull() | (F.col("b") < F.col("k"))).select("vertex", "b.source", "b.distance")
        better = written(better, "front")
        known.append(better)
        front = written(later.unionByName(better).groupBy("vertex").agg(best).select("vertex", "b.source", "b.distance"), "front")
        discarded(*fronts)
        open_, fronts = front, [front]
        if len(known) > 16:  # one table again
            whole = written(_all(known).groupBy("vertex").agg(best).select("vertex", "b.source", "b.distance"), "known")
            discarded(*known)
            known = [whole]
    return _all(known).groupBy("vertex").agg(best).select("vertex", "b.source", "b.distance")


def _all(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for more in tables[1:]:
        out = out.unionByName(more)
    return out


def boundary_filled(vertices: DataFrame, edges: DataFrame, valid: DataFrame, limit: float, zero: bool = False, refined: DataFrame | None = None) -> DataFrame:
    """(vertex, source, distance) for all vertices: filled() ones, then those that a finer distance reaches.

    refined: (vertex, source, distance) of a better measure for vertices that edges leave out; it counts up to the limit. What is left is
    an error, or with zero gets source -1 and no distance.
    """
    found = filled(edges, valid, limit)
    if refined is not None:
        more = refined.where(F.col("distance") <= limit).join(valid.select(F.col("vertex").alias("source")), "source", "left_semi").join(found, "vertex", "left_anti")
        best = F.min(F.struct("distance", "source"))
        found = found.unionByName(more.groupBy("vertex").agg(best.alias("b")).select("vertex", "b.source", "b.distance"))
    out = vertices.select("vertex").join(found, "vertex", "left")
    source = F.coalesce("source", F.lit(-1).cast("long") if zero else F.raise_error(F.lit("a vertex is further from all valid ones than the limit")).cast("long"))
    return out.select("vertex", source.alias("source"), "distance")


def face_labels(faces: DataFrame, labels: DataFrame) -> DataFrame:
    """(face, label): the label that most corners of a triangle (face, a, b, c) have, the lowest of equal ones; a corner without label has 0."""
    corners = faces.select("face", F.explode(F.array("a", "b", "c")).alias("vertex")).join(labels, "vertex", "left")
    counts = corners.groupBy("face", F.coalesce("label", F.lit(0)).alias("label")).agg(F.count("*").alias("n"))
    return counts.groupBy("face").agg(F.min(F.struct((-F.col("n")).alias("n"), F.col("label")))["label"].alias("label"))


def placed(df: DataFrame, column: str) -> DataFrame:
    """df with place: how many rows have a smaller value of the column (of distinct values). Rows are numbered within sorted ranges, so
    that no task gets all of them."""
    runs = written(df.repartitionByRange(column).sortWithinPartitions(column).withColumn("_run", F.spark_partition_id()), "runs")
    sizes = runs.groupBy("_run").agg(F.count("*").alias("n")).select("_run", (F.sum("n").over(Window.orderBy("_run")) - F.col("n")).alias("_first"))  # a row for each range
    place = F.col("_first") + F.row_number().over(Window.partitionBy("_run").orderBy(column)) - 1
    return runs.join(sizes, "_run").withColumn("place", place).drop("_run", "_first")


def scattered(mask: DataFrame, values: DataFrame, strict: bool = False) -> DataFrame:
    """mask (voxel, inside) with the values (place, value) put into the voxels inside, in their order; others are zero.

    The shorter of both decides: values beyond the voxels are left out, voxels beyond the values are zero. With strict, numbers
    that differ are an error.
    """
    inside = written(placed(mask.where("inside").select("voxel"), "voxel"), "inside")
    if strict and (n := inside.count()) != (m := values.count()):
        raise ValueError(f"{m} values for {n} voxels inside the mask")
    found = inside.join(values, "place").select("voxel", "value")
    return mask.select("voxel").join(found, "voxel", "left").select("voxel", F.coalesce("value", F.lit(0.0)).alias("value"))


def winner_take_all(similarity: DataFrame, labels: DataFrame, top: int) -> DataFrame:
    """(voxel, label, confidence): the most frequent label among the `top` most similar vertices of similarity (voxel, vertex, r).

    Label 0 is left out; equal similarities go to the higher vertex, equal counts to the higher label; NaN comes last, and a
    voxel with nothing but NaN has neither.
    """
    r = similarity.join(labels.where("label <> 0"), "vertex")
    r = r.withColumn("r", F.when(F.isnan("r"), float("-inf")).otherwise(F.round("r", 9))).withColumn("some", F.max("r").over(Window.partitionBy("voxel")) > float("-inf"))
    place = F.row_number().over(Window.partitionBy("voxel").orderBy(F.col("r").desc(), F.col("vertex").desc()))
    counts = r.withColumn("place", place).where(F.col("place") <= top).groupBy("voxel", "label", "some").agg(F.count("*").alias("n"))
    order = Window.partitionBy("voxel").orderBy(F.col("n").desc(), F.col("label").desc())
    ranked = counts.withColumn("k", F.row_number().over(order)).withColumn("next", F.lead("n").over(order)).where("k = 1")
    confidence = F.when(F.col("next").isNull(), 1.0).otherwise(1 - F.col("next") / F.col("n"))
    return ranked.select("voxel", F.when(F.col("some"), F.col("label")).alias("label"), F.when(F.col("some"), confidence).alias("confidence"))
