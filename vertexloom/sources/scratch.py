"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, a local session gets a folder of its own; on a cluster it is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as Parquet in the shared folder, under the application's id, read back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def kept_path(df: DataFrame, of: DataFrame) -> DataFrame:
    """df, derived from the written table `of`, which goes when df is discarded."""
    df._scratch = getattr(of, "_scratch", None)
    return df


def discarded(*tables: DataFrame | None) -> None:
    """Delete written tables that nothing reads any more, such as the state before the last one of an iteration."""
    for df in tables:
        path = getattr(df, "_scratch", None)
        if path:
            jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(conf).delete(target, True)


def bucketed_away(df: DataFrame) -> None:
    """Take a table of bucketed() out of the session's catalog, and its files away."""
    name = getattr(df, "_table", None)
    if name:
        df.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
        discarded(df)


def bucketed(df: DataFrame, name: str, keys: list[str], buckets: int | None = None) -> DataFrame:
    """df written in buckets by keys, as a table of the session over files in the shared folder: joins on the keys don't move it."""
    spark, table = df.sparkSession, f"{name}_{uuid.uuid4().hex}"
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{table}"
    df.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys).option("path", path).saveAsTable(table)
    out = spark.table(table)
    out._scratch, out._table = path, table
    return out
