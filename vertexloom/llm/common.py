"""Helpers shared by the corpus operators: tables, the shared scratch folder, column clashes."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vertexloom.sources.scratch import shared_folder

from .words import slices

#: White space of the contracts: blank and \x09 to \x0D, as Java regular expressions.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts lineage, survives lost executors.

    The folder carries the application's id, so that an application's scratch tables can be removed together.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without columns of these names (case as in Spark's resolution)."""
    return df.drop(*names)


def packed(df: DataFrame, *needed: str) -> DataFrame:
    """The needed columns of df, and all others inside one, _rest, so that their names can't clash with what is added on the way."""
    others = [F.col(c) for c in df.columns if c not in needed] or [F.lit(0).alias("none")]
    return df.select(*needed, F.struct(*others).alias("_rest"))


def unpacked(columns: list[str], needed: tuple[str, ...], **changed: Column) -> list[Column]:
    """The columns that were packed, some of them changed."""
    return [changed[c].alias(c) if c in changed else F.col(c) if c in needed else F.col("_rest")[c].alias(c) for c in columns]


def append_columns(df: DataFrame, text: str, fields: list[T.StructField], fn: Callable[[pa.Array], list[pa.Array]]) -> DataFrame:
    """Add columns that fn makes from a batch of texts. A column of df with such a name is replaced."""
    df = without(df, *[f.name for f in fields])
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, at):
                made = fn(piece.column(at))
                yield pa.RecordBatch.from_arrays([*piece.columns, *made], names=[*piece.schema.names, *[f.name for f in fields]])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, *fields]))


#: Bits of a bitmap of hash values (4 MB).
BITS = 1 << 25


def bitmap(df: DataFrame, column: str, bits: int = BITS) -> np.ndarray:
    """Which values modulo bits (a power of two) a long column has, as bits: a filter of fixed size for the other side of a join,
    before its exchange."""
    value = F.pmod(column, F.lit(bits)) + 1
    maps = df.groupBy(F.bitmap_bucket_number(value).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(value)).alias("map"))
    out = np.zeros(bits // 8, np.uint8)
    for r in maps.collect():  # bits / 32768 rows at most, of 4 KB each; in one job, where an iterator takes one for each partition
        own = np.frombuffer(r["map"], np.uint8)
        at = (r["bucket"] - 1) * len(own)  # buckets, and values in them, are numbered from 1
        out[at : at + len(own)] = own
    return out


def has(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether the bit of each 64-bit value is set in a bitmap."""
    at = (values.view(np.uint64) & np.uint64(8 * len(bits) - 1)).astype(np.int64)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def crc_mod(column: str, mod: int):
    """crc32 of a column's text form, modulo mod; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % mod
