"""Products of many rows with few vectors, and sums of rows over few keys, as matrix products on Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of vectors that travel to the tasks at once; more are taken in slices, one pass over the rows for each.
SLICE_BYTES = 32 << 20


def matrix(x: pa.Array) -> np.ndarray:
    """A row of doubles for each list; all lists have one length."""
    return x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1) if len(x) else np.zeros((0, 0))


def slices(vectors: DataFrame, name: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(names, a row for each) of vectors (name, x), in slices of a bounded size; each sorted by name."""
    n, d = vectors.agg(F.count("*"), F.coalesce(F.max(F.size("x")), F.lit(0))).first()
    parts = max(1, -(-8 * n * d // SLICE_BYTES))
    for i in range(parts):
        own = vectors if parts == 1 else vectors.where(F.pmod(F.xxhash64(name), F.lit(parts)) == i)
        rows = sorted(own.select(name, "x").collect())  # about SLICE_BYTES
        if rows:
            yield np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)


def lists(x: np.ndarray) -> pa.Array:
    """A list of doubles for each row."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], pa.int32()), pa.array(np.ascontiguousarray(x, float).ravel()))


def dot_arrays(rows: DataFrame, vectors: DataFrame, name: str, out: str, keep: bool = False) -> tuple[list, DataFrame]:
    """(names, rows with the array of the products of x with all vectors (name, x), in the order of names, instead of x, or beside it).

    Vectors beyond a slice's bytes take one more pass over a row for each slice; the parts are put together in the row.
    """
    kept = rows.select(*[c for c in rows.columns if c != "x"], F.col("x").cast("array<double>").alias("x"))
    names: list = []
    parts = []

    def on(df: DataFrame, y: np.ndarray, part: str) -> DataFrame:
        at = df.columns.index("x")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    yield pa.RecordBatch.from_arrays([*batch.columns, lists(matrix(batch.column(at)) @ y.T)], names=[*batch.schema.names, part])

        return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(part, T.ArrayType(T.DoubleType()))]))

    for own, y in slices(vectors, name):
        parts.append(f"_dots{len(parts)}")
        names += own.tolist()
        kept = on(kept, y, parts[-1])
    order = np.argsort(np.array(names), kind="stable") if names else []
    every = F.concat(*parts) if parts else F.expr("cast(array() as array<double>)")
    made = every if len(parts) < 2 else F.get(F.transform(F.array(every), lambda a: F.transform(F.array(*[F.lit(int(i)) for i in order]), lambda i: F.get(a, i))), F.lit(0))
    columns = [c for c in rows.columns if c != "x" or keep]
    return [names[i] for i in order], kept.select(*columns, made.alias(out))


def every_vector(vectors: DataFrame, name: str) -> tuple[np.ndarray, np.ndarray]:
    """(names, a row for each), all of them in the driver: for a model's directions, which its fit holds there."""
    parts = list(slices(vectors, name))
    if not parts:
        raise ValueError("no directions")
    names, rows = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(names, kind="stable")
    return names[order], rows[order]


def products(rows: DataFrame, vectors: DataFrame, name: str, out: str) -> DataFrame:
    """rows without x, once for each vector (name, x), with its name and the inner product."""
    kind = vectors.schema[name]
    columns = [c for c in rows.columns if c != "x"]
    schema = T.StructType([*[rows.schema[c] for c in columns], kind, T.StructField(out, T.DoubleType())])
    kept = rows.select(*columns, F.col("x").cast("array<double>").alias("x"))

    def on(names: np.ndarray, y: np.ndarray) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            step = max(1, (1 << 20) // max(1, len(names)))
            for batch in (b.slice(i, step) for b in batches for i in range(0, b.num_rows, step)):
                p = matrix(batch.column(len(columns))) @ y.T
                own = pa.array(np.repeat(np.arange(batch.num_rows), len(names)))
                yield pa.RecordBatch.from_arrays([*[c.take(own) for c in batch.columns[:-1]], pa.array(np.tile(names, batch.num_rows)), pa.array(p.ravel())], names=schema.names)

        return kept.mapInArrow(run, schema)

    made = [on(*s) for s in slices(vectors, name)]
    out_ = made[0] if made else rows.sparkSession.createDataFrame([], schema)
    for more in made[1:]:
        out_ = out_.union(more)
    return out_


def most_similar(rows: DataFrame, row: str, vectors: DataFrame, name: str, top: int) -> DataFrame:
    """(name, row, r): for each vector the `top` rows of the largest product (9 decimals, equal ones by the larger row, NaN last) out of each
    batch of rows, among which are the first of all."""
    kept = rows.select(F.col(row).cast("long").alias(row), F.col("x").cast("array<double>").alias("x"))
    schema = T.StructType([T.StructField(name, T.LongType()), T.StructField(row, T.LongType()), T.StructField("r", T.DoubleType())])

    def on(names: np.ndarray, y: np.ndarray) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, x = batch.column(0).to_numpy(), matrix(batch.column(1))
                for i in range(0, len(names) if len(ids) else 0, step := max(1, (1 << 21) // max(1, len(ids)))):
                    r = np.round(y[i : i + step] @ x.T, 9)
                    best = np.lexsort((np.broadcast_to(-ids, r.shape), np.where(np.isnan(r), np.inf, -r)), axis=1)[:, :top]
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names[i : i + step], best.shape[1])), pa.array(ids[best].ravel()), pa.array(np.take_along_axis(r, best, 1).ravel())], names=schema.names)

        return kept.mapInArrow(run, schema)

    made = [on(*s) for s in slices(vectors.select(F.col(name).cast("long").alias(name), "x"), name)]
    out = made[0] if made else rows.sparkSession.createDataFrame([], schema)
    for more in made[1:]:
        out = out.union(more)
    return out


def summed(rows: DataFrame, by: list[str], weight: str | None = None) -> DataFrame:
    """(by, n, x): rows (by, x) counted and their arrays added up, times a weight.

    For few groups: a task keeps one sum for each, which leaves it once.
    """
    kept = rows.select(*by, (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("w"), F.col("x").cast("array<double>").alias("x"))
    schema = T.StructType([*kept.schema.fields[:-2], T.StructField("n", T.LongType()), T.StructField("x", T.ArrayType(T.DoubleType()))])
    names = [*by, "n", "x"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, list] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = list(zip(*[c.to_pylist() for c in batch.columns[:-2]], strict=True)) if by else [()] * batch.num_rows
            group, unique = pd.factorize(np.fromiter(keys, object, len(keys)))
            w, x = batch.column(len(by)).to_numpy(), matrix(batch.column(len(by) + 1))
            for i, k in enumerate(unique):
                own = group == i
                one = sums.setdefault(k, [0, np.zeros(x.shape[1])])
                one[0], one[1] = one[0] + int(own.sum()), one[1] + w[own] @ x[own]
        if sums:
            columns = [pa.array([k[i] for k in sums], batch_type) for i, batch_type in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([v[0] for v in sums.values()], pa.int64()), pa.array([v[1] for v in sums.values()], pa.list_(pa.float64()))], names=names)

    from pyspark.sql.pandas.types import to_arrow_type

    types = [to_arrow_type(f.dataType) for f in kept.schema.fields[:-2]]

    return kept.mapInArrow(run, schema).groupBy(*by).applyInArrow(_adding(by), schema)


def _adding(by: list[str]):
    """Adds up the n and x of one group, whatever their order of arrival."""

    def add(table: pa.Table) -> pa.Table:
        x = matrix(table.column("x").combine_chunks())
        order = np.argsort([crc32(r.tobytes()) for r in x], kind="stable")
        return pa.table([*[table.column(c)[:1] for c in by], pa.array([sum(table.column("n").to_pylist())]), lists(x[order].sum(axis=0)[None])], names=[*by, "n", "x"])

    return add


def weighted_sums(rows: DataFrame, by: list[str], weights: str, names: list[int], name: str) -> DataFrame:
    """(by, name, x): for each of the names, rows (by, weights, x) added up, times its place in the array of weights; a name
    without any weight in a group has no row.

    For few groups: a batch is one matrix product for each of its groups, and a task's sums leave it once.
    """
    kept = rows.select(*by, F.col(weights).cast("array<double>").alias("_w"), F.col("x").cast("array<double>").alias("x"))
    schema = T.StructType([*kept.schema.fields[:-2], T.StructField(name, T.LongType()), T.StructField("n", T.LongType()), T.StructField("x", T.ArrayType(T.DoubleType()))])
    columns, numbers = [f.name for f in schema.fields], [int(n) for n in names]

    from pyspark.sql.pandas.types import to_arrow_type

    types = [to_arrow_type(f.dataType) for f in kept.schema.fields[:-2]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, list] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = np.zeros(batch.num_rows, np.int64)
            for c in batch.columns[:-2]:
                code = c.dictionary_encode()
                codes = codes * (len(code.dictionary) + 1) + pa.compute.fill_null(code.indices, len(code.dictionary)).to_numpy()
            w, x = matrix(batch.column(len(by))), matrix(batch.column(len(by) + 1))
            for code in np.unique(codes):
                own = np.flatnonzero(codes == code)
                key = tuple(c[int(own[0])].as_py() for c in batch.columns[:-2])
                one = sums.setdefault(key, [np.zeros(len(numbers), np.int64), np.zeros((len(numbers), x.shape[1]))])
                one[0] += (w[own] > 0).sum(axis=0)
                one[1] += w[own].T @ x[own]
        flat = [(k, numbers[i], int(n[i]), v[i]) for k, (n, v) in sums.items() for i in np.flatnonzero(n)]
        if flat:
            keys = [pa.array([f[0][i] for f in flat], kind) for i, kind in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*keys, pa.array([f[1] for f in flat], pa.int64()), pa.array([f[2] for f in flat], pa.int64()), lists(np.array([f[3] for f in flat]))], names=columns)

    group = [*by, name]
    return kept.mapInArrow(run, schema).groupBy(*group).applyInArrow(_adding(group), schema).drop("n")
