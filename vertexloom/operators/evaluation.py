"""Comparisons of labels and values, and coverage by sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dice(a: DataFrame, b: DataFrame) -> DataFrame:
    """(label, n_a, n_b, n_both, dice) of labels above 0; a label of neither side has no row."""
    j = a.withColumnRenamed("label", "la").join(b.withColumnRenamed("label", "lb"), "vertex", "full")
    each = F.array_distinct(F.filter(F.array("la", "lb"), lambda x: x > 0))
    c = j.select("la", "lb", F.explode(each).alias("label")).groupBy("label").agg(F.count_if(F.col("la") == F.col("label")).alias("n_a"), F.count_if(F.col("lb") == F.col("label")).alias("n_b"), F.count_if((F.col("la") == F.col("label")) & (F.col("lb") == F.col("label"))).alias("n_both"))
    return c.withColumn("dice", 2 * F.col("n_both") / (F.col("n_a") + F.col("n_b")))


def agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """(n, n_equal, agreement, union_agreement): equal labels among all vertices, and among those labelled on either side."""
    j = a.withColumnRenamed("label", "la").join(b.withColumnRenamed("label", "lb"), "vertex")
    some, same = (F.col("la") > 0) | (F.col("lb") > 0), F.col("la") == F.col("lb")
    r = j.agg(F.count("*").alias("n"), F.count_if(same).alias("n_equal"), F.count_if(some).alias("u"), F.count_if(some & same).alias("e"))
    return r.select("n", "n_equal", F.try_divide("n_equal", "n").alias("agreement"), F.try_divide("e", "u").alias("union_agreement"))


def tolerance(actual: DataFrame, golden: DataFrame, keys: list[str], atol: float, rtol: float) -> DataFrame:
    """(n, n_missing, n_violations, max_absolute, max_relative) of value over all keys of either side.

    A violation: the difference is above atol + rtol * |golden|, or not finite, or one side has no row.
    """
    j = actual.withColumnRenamed("value", "a").join(golden.withColumnRenamed("value", "b"), keys, "full")
    d, b = F.abs(F.col("a") - F.col("b")), F.abs("b")
    missing = F.col("a").isNull() | F.col("b").isNull()
    bad = missing | F.isnan(d) | (d > atol + rtol * b)
    return j.agg(F.count("*").alias("n"), F.count_if(missing).alias("n_missing"), F.count_if(F.coalesce(bad, F.lit(True))).alias("n_violations"), F.max(d).alias("max_absolute"), F.max(d / F.greatest(b, F.lit(atol))).alias("max_relative"))


def coverage(rows: DataFrame, cortex: DataFrame) -> DataFrame:
    """(vertex, n_usable, n_sessions, full): in how many of all sessions a vertex has a finite row that is not zero.

    rows: vertex, subject, session, x; cortex: vertex, cortex (boolean).
    """
    n = F.broadcast(rows.agg(F.count_distinct("subject", "session").alias("n_sessions")))
    usable = F.exists("x", lambda v: v != 0) & F.forall("x", lambda v: ~F.isnan(v) & (F.abs(v) != float("inf")))
    c = rows.groupBy("vertex").agg(F.count_if(usable).alias("n_usable"))
    out = cortex.join(c, "vertex", "left").join(n).withColumn("n_usable", F.coalesce("n_usable", F.lit(0).cast("long")))
    return out.select("vertex", "n_usable", "n_sessions", (F.col("cortex") & (F.col("n_usable") == F.col("n_sessions"))).alias("full"))


def support(rows: DataFrame) -> DataFrame:
    """(vertex, subject, any_session, every_session) by whether a session's row is not zero."""
    s = F.exists("x", lambda v: v != 0)
    return rows.groupBy("vertex", "subject").agg(F.bool_or(s).alias("any_session"), F.bool_and(s).alias("every_session"))


def valid_vertices(rows: DataFrame) -> DataFrame:
    """(vertex, valid): whether any row of the vertex has a value that is not zero."""
    return rows.groupBy("vertex").agg(F.bool_or(F.exists("x", lambda v: v != 0)).alias("valid"))


def partition_problems(masks: DataFrame) -> DataFrame:
    """(vertex, n): the vertices of masks (mask, vertex, inside) that are not in exactly one of them."""
    n = F.count_if("inside")
    return masks.groupBy("vertex").agg(n.alias("n")).where("n <> 1")


def common(masks: DataFrame) -> DataFrame:
    """(vertex) of the vertices that are inside every one of the masks (mask, vertex, inside)."""
    n = masks.select("mask").distinct().count()
    return masks.where("inside").groupBy("vertex").agg(F.count_distinct("mask").alias("n")).where(F.col("n") == n).select("vertex")


def verified_labels(labels: DataFrame, most: int = 15) -> DataFrame:
    """labels (vertex, label), which must be whole numbers, exactly those from 0 to `most`; anything else is an error."""
    found = sorted(r[0] for r in labels.select("label").distinct().limit(most + 3).collect() if r[0] is not None)
    if found != list(range(most + 1)) or labels.where("label is null").limit(1).count():
        raise ValueError(f"labels are not exactly 0 to {most}: {found}")
    return labels
