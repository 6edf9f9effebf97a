"""Many recordings at once: profiles, cutoffs and checks keyed by recording.

bold: (keys, vertex, frame, value), keys being the columns that name a recording (such as subject and session). A recording's series are
standardised in their rows; its seeds' series form blocks of a bounded size, which are shipped to that recording's blocks of vertices
(cogrouped by recording, part and slice of seeds), so that any number of recordings is one job. Profiles are rows (keys, vertex, slice, seeds,
r): the correlations of a vertex with the seeds of a slice, as arrays in the order of seeds.

The cutoff of each recording is the rank-th largest of its own correlations. It is selected exactly, for all recordings together, from
histograms of their values' order-preserving bits: each pass counts 16 more bits among the values that agree with the recording's cutoff so
far, with 65,536 counters for each recording and task at most, however many values are equal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vertexloom.functions.vectors import standardised as zscore
from vertexloom.sources.scratch import written

from .blocks import lists, matrix

#: Vertices of a recording that meet a slice of its seeds in one call, and bytes of such a slice.
PART_VERTICES, SLICE_BYTES = 1024, 16 << 20
#: Bits that a pass over the values decides.
STEP = 16


def grid(bold: DataFrame, keys: list[str], fill: float = 0.0) -> DataFrame:
    """bold with every frame of its recording for every vertex of it; cells without a row get `fill`."""
    last = bold.groupBy(*keys).agg(F.max("frame").alias("_last"))
    frames = bold.select(*keys, "vertex").distinct().join(last, keys).select(*keys, "vertex", F.explode(F.sequence(F.lit(0).cast("long"), "_last")).alias("frame"))
    return frames.join(bold, [*keys, "vertex", "frame"], "left").select(*keys, "vertex", "frame", F.coalesce("value", F.lit(fill)).alias("value"))


def gathered(bold: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, vertex, s): each series as an array in the order of frames."""
    own = F.array_sort(F.collect_list(F.struct("frame", "value")))
    return bold.groupBy(*keys, "vertex").agg(F.transform(own, lambda p: p["value"]).alias("s"))


def standardised(bold: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, vertex, z): series less their mean over their length; zero if they do not vary or are not finite."""
    return gathered(bold, keys).select(*keys, "vertex", zscore(F.col("s")).alias("z"))


def problems(bold: DataFrame, keys: list[str], cortex: DataFrame, seeds: DataFrame, allow_zero: bool = False, frames: int = 3) -> DataFrame:
    """(keys, problem, n) for recordings that must not be used: too few frames, series of different lengths, and among the cortex's
    vertices (vertex, cortex) values that are not finite, seeds that do not vary, others that do not vary (zero ones only without allow_zero).

    n: how many vertices have the problem. A recording may have several; a sound one has no row.
    """
    s = F.col("s")
    finite = F.forall(s, lambda v: ~F.isnan(v) & (F.abs(v) != float("inf")))
    flat = F.array_max(s) == F.array_min(s)
    rows = gathered(bold, keys).join(cortex.select("vertex", "cortex"), "vertex", "left").join(seeds.select("vertex", F.lit(True).alias("_seed")), "vertex", "left")
    inner = F.coalesce("cortex", F.lit(False))
    rows = rows.select(*keys, F.size(s).alias("n_frames"), (inner & ~finite).alias("odd"), (inner & finite & flat).alias("flat"), F.forall(s, lambda v: v == 0).alias("zero"), F.coalesce("_seed", F.lit(False)).alias("seed"))
    count = F.count_if
    g = rows.groupBy(*keys).agg(
        count(F.col("n_frames") < frames).alias("short"),
        F.when(F.min("n_frames") != F.max("n_frames"), F.count("*")).otherwise(0).alias("lengths"),
        count("odd").alias("odd"),
        count(F.col("flat") & F.col("seed")).alias("flat seed"),
        count(F.col("flat") & ~F.col("seed") & ~F.col("zero")).alias("flat"),
        (F.lit(0) if allow_zero else count(F.col("flat") & ~F.col("seed") & F.col("zero"))).alias("zero"),
    )
    names = {"short": "fewer frames than needed", "lengths": "series of different lengths", "odd": "values that are not finite", "flat seed": "a seed that does not vary", "flat": "a series that does not vary", "zero": "a series of zeros"}
    each = F.array(*[F.struct(F.lit(text).alias("problem"), F.col(c).cast("long").alias("n")) for c, text in names.items()])
    return g.select(*keys, F.explode(each).alias("e")).select(*keys, "e.problem", "e.n").where("n > 0")


def profiles(bold: DataFrame, seeds: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, vertex, slice, seeds, r): Pearson of every series with those of its recording's seeds (vertex), zero where one does not vary.

    Parts and slices follow the sizes of recordings: a call holds PART_VERTICES series and SLICE_BYTES of seeds, whatever their numbers.
    """
    z = written(standardised(bold, keys), "series")
    frames, vertices = z.agg(F.max(F.size("z"))).first()[0] or 1, z.groupBy(*keys).count().agg(F.max("count")).first()[0] or 1
    per_slice = max(1, SLICE_BYTES // (8 * frames))
    parts = -(-vertices // PART_VERTICES)
    own = z.join(seeds.select("vertex"), "vertex", "left_semi")
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("vertex")) - 1  # a row for each seed of a recording
    own = written(own.select(*keys, "vertex", "z", F.floor(place / per_slice).cast("int").alias("slice")), "seeds")
    slices = own.select(*keys, F.col("slice").alias("_slice")).distinct()
    left = own.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    right = z.withColumn("part", F.pmod(F.xxhash64("vertex"), F.lit(parts)).cast("int")).join(slices, keys).select(*keys, "vertex", "z", "part", F.col("_slice").alias("slice"))
    by = [*keys, "part", "slice"]
    schema = T.StructType([*[z.schema[k] for k in keys], T.StructField("vertex", z.schema["vertex"].dataType), T.StructField("slice", T.IntegerType()), T.StructField("seeds", T.ArrayType(T.LongType())), T.StructField("r", T.ArrayType(T.DoubleType()))])

    def multiply(s: pa.Table, v: pa.Table) -> pa.Table:
        s = s.combine_chunks().sort_by("vertex")
        v = v.combine_chunks()
        n = v.num_rows
        if not (n and s.num_rows):
            return schema_of.empty_table()
        r = matrix(v.column("z").combine_chunks()) @ matrix(s.column("z").combine_chunks()).T
        names = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * s.num_rows, pa.int32()), pa.array(np.tile(s.column("vertex").to_numpy(), n)))
        return pa.table([*[v.column(k) for k in keys], v.column("vertex"), v.column("slice"), names, lists(r)], schema=schema_of)

    from pyspark.sql.pandas.types import to_arrow_schema

    schema_of = to_arrow_schema(schema)
    columns = [*by, "vertex", "z"]
    return left.select(columns).groupBy(*by).cogroup(right.select(columns).groupBy(*by)).applyInArrow(multiply, schema)


def by_seed(rows: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """(keys, vertex, seed, out): a row for each seed instead of arrays."""
    each = F.inline(F.arrays_zip(F.col("seeds").alias("seed"), F.col(value).alias(out)))
    return rows.select(*keys, "vertex", each)


def _codes(r: np.ndarray) -> np.ndarray:
    """Unsigned integers in the order of doubles; minus zero is zero."""
    bits = (r + 0.0).view(np.int64)
    return np.where(bits < 0, ~bits, bits | np.int64(-(2**63))).view(np.uint64)


def _value(code: Column) -> Column:
    """The double of a code, given as a signed long."""
    low = F.conv(F.hex(F.when(code < 0, code.bitwiseXOR(F.lit(-(2**63)))).otherwise(F.bitwise_not(code))), 16, 16)
    return _double(F.lpad(low, 16, "0"))


def _double(text: Column) -> Column:
    """The double with these 64 bits, as 16 hexadecimal digits, by arithmetic on sign, exponent and mantissa; exact for normal numbers."""
    head = F.conv(F.substring(text, 1, 3), 16, 10).cast("int")
    mantissa = F.conv(F.substring(text, 4, 13), 16, 10).cast("long")
    exponent = head % 2048
    size = F.when(exponent == 0, mantissa * F.lit(2.0**-1074)).otherwise((F.lit(1.0) + mantissa / F.lit(2.0**52)) * F.pow(F.lit(2.0), exponent - 1023))
    return F.when(head >= 2048, -size).otherwise(size)


def cutoffs(rows: DataFrame, keys: list[str], share: float = 0.1, digits: int | None = None) -> DataFrame:
    """(keys, rank, cutoff): for each recording the rank-th largest of its correlations, rank their number times share, rounded half up.

    With digits, correlations are rounded to so many decimals first. A rank below one, a cutoff that is not positive, and values that
    are not numbers are errors that name the recording.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    fields = [rows.schema[k] for k in keys]
    types = [to_arrow_type(f.dataType) for f in fields]
    schema = T.StructType([*fields, T.StructField("bin", T.IntegerType()), T.StructField("n", T.LongType())])
    names = schema.names

    def counted(done: int):
        shift = np.uint64(64 - STEP - done)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[tuple, np.ndarray] = {}
            for batch in batches:
                if not batch.num_rows:
                    continue
                values = batch.column(len(keys))
                size = np.diff(values.offsets.to_numpy())
                r = values.flatten().to_numpy(zero_copy_only=False)
                r = np.round(r, digits) if digits is not None else r
                group = list(zip(*[c.to_pylist() for c in batch.columns[: len(keys)]], strict=True))
                edges = [0, *[i for i in range(1, len(group)) if group[i] != group[i - 1]], len(group)]
                at = np.concatenate([[0], np.cumsum(size)])
                for a, b in zip(edges, edges[1:], strict=False):
                    code = _codes(r[at[a] : at[b]])
                    if done:
                        prefix = np.array([batch.column(len(keys) + 1)[a].as_py()], np.int64).view(np.uint64)[0]
                        code = code[code >> np.uint64(64 - done) == prefix >> np.uint64(64 - done)]
                    n = np.bincount((code >> shift & np.uint64((1 << STEP) - 1)).astype(np.int64), minlength=1 << STEP)
                    sums[group[a]] = sums[group[a]] + n if group[a] in sums else n
            for key, n in sums.items():
                some = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([*[pa.array([v] * len(some), kind) for v, kind in zip(key, types, strict=True)], pa.array(some.astype(np.int32)), pa.array(n[some].astype(np.int64))], names=names)

        return run

    values = written(rows.select(*keys, "r"), "correlations")
    down = Window.partitionBy(*keys).orderBy(F.col("bin").desc())
    found: DataFrame | None = None
    for done in range(0, 64, STEP):
        asked = values if found is None else values.join(found.select(*keys, "code"), keys).select(*keys, "r", "code")
        bins = asked.mapInArrow(counted(done), schema).groupBy(*keys, "bin").agg(F.sum("n").alias("n"))
        bins = bins.withColumn("upto", F.sum("n").over(down))
        if found is None:
            total = F.sum("n").over(Window.partitionBy(*keys))
            rank = F.floor(total * share + 0.5).cast("long")
            bins = bins.withColumn("rank", rank).withColumn("left", F.greatest("rank", F.lit(1))).withColumn("code", F.lit(0).cast("long"))
        else:
            bins = bins.join(found, keys)
        hit = bins.where("upto >= left and upto - n < left")
        code = F.col("code").bitwiseOR(F.shiftleft(F.col("bin").cast("long"), 64 - STEP - done))
        found = written(hit.select(*keys, "rank", (F.col("left") - F.col("upto") + F.col("n")).alias("left"), code.alias("code")), "ranks")
    name = F.concat_ws(" ", *[F.concat(F.lit(f"{k} "), F.col(k).cast("string")) for k in keys])
    value = _value(F.col("code"))
    sound = (F.col("rank") >= 1) & (value > 0) & (value < float("inf"))
    checked = F.when(sound, value).otherwise(F.raise_error(F.concat(F.lit("no positive cutoff for "), name)).cast("double"))
    return found.select(*keys, "rank", checked.alias("cutoff"))


def binary(rows: DataFrame, keys: list[str], share: float = 0.1, digits: int | None = None) -> DataFrame:
    """(keys, vertex, slice, seeds, bits): 1 for correlations at or above the cutoff of their recording, ties kept."""
    rows = written(rows, "profiles")
    at = cutoffs(rows, keys, share, digits)
    value = lambda v: v if digits is None else F.round(v, digits)
    bits = F.transform("r", lambda v: (value(v) >= F.col("cutoff")).cast("long"))
    return rows.join(at, keys).select(*keys, "vertex", "slice", "seeds", bits.alias("bits"))
