"""The engine's tables, and a fixed view of the driver's tables as such.

profile(vertex, subject, session, x ARRAY<DOUBLE>)   one row for each observation; a missing session has no row
bold(vertex, frame, value)                           a time series, one row for each frame
edge(src, dst)                                       a mesh as neighbour pairs

Embeddings stand for profiles: subject vec_id % 2, session (vec_id div 2) % 2, vertex vec_id div 4, label 0 unassigned. Events stand
for time series: vertex user_id, frame the day, value the day's sum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, label, x) with x as doubles."""
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("x"))


def tensor(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    return v.select(F.expr("vec_id div 4").alias("vertex"), F.expr("vec_id % 2").alias("subject"), F.expr("(vec_id div 2) % 2").alias("session"), "label", "x")


def bold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days with events only; see operators.series.grid for the rest."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("vertex"), F.to_date("ts").alias("day"), "value")
    first = e.agg(F.min("day").alias("first"))
    return e.join(F.broadcast(first)).groupBy("vertex", F.date_diff("day", "first").cast("long").alias("frame")).agg(F.sum("value").alias("value"))


def recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(recording, vertex, frame, value): as bold(), a recording for each kind of event."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("recording"), F.col("user_id").alias("vertex"), F.to_date("ts").alias("day"), "value")
    first = e.agg(F.min("day").alias("first"))
    return e.join(F.broadcast(first)).groupBy("recording", "vertex", F.date_diff("day", "first").cast("long").alias("frame")).agg(F.sum("value").alias("value"))


def template(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vertex, label): labels of the first session of subject 0."""
    return tensor(spark, sf_dir).where("subject = 0 and session = 0").select("vertex", "label")


def ring(vertices: DataFrame) -> DataFrame:
    """(src, dst): each vertex beside the next; halves of the ids are apart, as hemispheres are."""
    n = vertices.agg(((F.max("vertex") + 1) / 2).cast("long").alias("half"))
    v = vertices.select("vertex").distinct()
    both = v.select(F.col("vertex").alias("src"), F.explode(F.array(F.col("vertex") - 1, F.col("vertex") + 1)).alias("dst"))
    known = both.join(v.select(F.col("vertex").alias("dst")), "dst", "left_semi")
    return known.join(F.broadcast(n)).where("(src < half) = (dst < half)").select("src", "dst")
