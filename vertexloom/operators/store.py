"""Tables that are published whole or not at all: staged publication, a profile store that resumes, digests of inputs.

All files are reached through Hadoop's file system, wherever the paths lie.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names beside a target that hold what is not published yet, and the file that marks a table as whole.
STAGE, DONE = "_staging-", "_COMPLETE"


class Files:
    """The file system of a path."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.fs = self.path(path).getFileSystem(self.conf)

    def path(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def exists(self, path: str) -> bool:
        return self.fs.exists(self.path(path))

    def delete(self, path: str) -> None:
        self.fs.delete(self.path(path), True)

    def listed(self, path: str) -> list[tuple[str, float]]:
        """(path, time of change in seconds) of what lies in a folder."""
        return [(str(x.getPath()), x.getModificationTime() / 1000) for x in self.fs.listStatus(self.path(path))] if self.exists(path) else []

    def move(self, source: str, target: str) -> None:
        """Rename source to target, which must not exist."""
        if self.exists(target):
            raise FileExistsError(target)
        self.fs.mkdirs(self.path(target).getParent())
        if not self.fs.rename(self.path(source), self.path(target)) or not self.exists(target):
            raise OSError(f"{source} could not be renamed to {target}")

    def write(self, path: str, text: str) -> None:
        out = self.fs.create(self.path(path), True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def read(self, path: str) -> str:
        stream = self.fs.open(self.path(path))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()


def digest(df: DataFrame) -> tuple[int, str]:
    """(rows, digest) of a table, whatever the order of its rows: the sum of their hashes."""
    n, total = df.select(F.count("*"), F.coalesce(F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))).first()
    return n, str(total)


def stale(spark: SparkSession, path: str, age: float = 24 * 3600) -> list[str]:
    """Stages beside a target that nobody has changed for `age` seconds: what jobs that were lost have left."""
    parent, name = path.rstrip("/").rsplit("/", 1)
    limit = time.time() - age
    return sorted(p for p, changed in Files(spark, parent).listed(parent) if p.rsplit("/", 1)[1].startswith(f"{STAGE}{name}-") and changed <= limit)


@contextmanager
def staged(spark: SparkSession, path: str, age: float = 24 * 3600):
    """A folder beside path to write into; it becomes path by one rename when the block ends well, and goes when it does not.

    An existing path is refused before anything is written and again at the rename, so a failed attempt never blocks the next one. Stale
    stages of earlier attempts are removed first.
    """
    path = path.rstrip("/")
    parent, name = path.rsplit("/", 1)
    files = Files(spark, parent)
    if files.exists(path):
        raise FileExistsError(f"{path} exists already")
    for old in stale(spark, path, age):
        files.delete(old)
    stage = f"{parent}/{STAGE}{name}-{uuid.uuid4().hex}"
    try:
        yield stage
        files.move(stage, path)
    except BaseException:
        files.delete(stage)
        raise


def publish(df: DataFrame, path: str, age: float = 24 * 3600) -> DataFrame:
    """Write df to a new path, all of it or nothing, and return one row (path, n_rows, digest).

    The digest is taken of the input, of what was written, and of the input again: one that changed meanwhile is an error, and nothing
    is published.
    """
    spark = df.sparkSession
    with staged(spark, path, age) as stage:
        before = digest(df)
        df.write.parquet(stage)
        if before != digest(spark.read.schema(df.schema).parquet(stage)) or before != digest(df):
            raise ValueError(f"{path} was written from an input that changed")
    return spark.createDataFrame([(path, *before)], "path string, n_rows long, digest string")


def publish_all(tables: dict[str, DataFrame], path: str, manifest: dict | None = None, age: float = 24 * 3600) -> DataFrame:
    """Several tables and a manifest (manifest.json, with rows and digest of each table) as one folder, published by one rename."""
    spark = next(iter(tables.values())).sparkSession
    rows = []
    with staged(spark, path, age) as stage:
        for name, df in tables.items():
            df.write.parquet(f"{stage}/{name}")
            rows.append((name, *digest(spark.read.schema(df.schema).parquet(f"{stage}/{name}"))))
        Files(spark, path).write(f"{stage}/manifest.json", json.dumps({**(manifest or {}), "tables": {n: {"rows": k, "digest": d} for n, k, d in rows}}, indent=2, sort_keys=True))
    return spark.createDataFrame(rows, "name string, n_rows long, digest string")


class ProfileStore:
    """Profiles in a folder for each recording, each with a marker that says how many rows it has and what digest.

    A recording is written into a stage and renamed, then marked; on a rerun those that are marked are skipped, and what has no
    marker is written anew. Recordings are written in batches, each by one job over all of its recordings.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str]) -> None:
        self.spark, self.root, self.keys, self.files = spark, path.rstrip("/"), keys, Files(spark, path)

    def folder(self, key: tuple) -> str:
        return f"{self.root}/" + "/".join(f"{k}={v}" for k, v in zip(self.keys, key, strict=True))

    def complete(self, key: tuple) -> bool:
        return self.files.exists(f"{self.folder(key)}/{DONE}")

    def pending(self, recordings: list[tuple]) -> list[tuple]:
        """Those of the recordings that are not written yet, in order."""
        return sorted(r for r in set(recordings) if not self.complete(r))

    def write(self, recordings: list[tuple], make: Callable[[list[tuple]], DataFrame], batch: int = 16) -> int:
        """Write what is pending: make gives the rows (keys, ...) of some recordings. Returns how many recordings were written."""
        todo = self.pending(recordings)
        for i in range(0, len(todo), batch):
            own = todo[i : i + batch]
            stage = f"{self.root}/{STAGE}{uuid.uuid4().hex}"
            try:
                rows = make(own)
                rows.write.partitionBy(*self.keys).parquet(stage)
                found = self.spark.read.schema(rows.schema).parquet(stage)
                sizes = {tuple(str(r[k]) for k in self.keys): r["n"] for r in found.groupBy(*self.keys).count().withColumnRenamed("count", "n").collect()}  # one row a recording
                for key in own:
                    n = sizes.pop(tuple(map(str, key)), 0)
                    source = self.folder(key).replace(self.root, stage, 1)
                    if not n:
                        raise ValueError(f"no rows for {key}")
                    self.files.delete(self.folder(key))  # what an attempt has left that was lost before its marker
                    self.files.move(source, self.folder(key))
                    self.files.write(f"{self.folder(key)}/{DONE}", json.dumps({"rows": n}))
                if sizes:
                    raise ValueError(f"rows of recordings that were not asked for: {sorted(sizes)}")
            finally:
                self.files.delete(stage)
        return len(todo)

    def read(self, schema, recordings: list[tuple] | None = None) -> DataFrame:
        """The rows of recordings (all complete ones unless named); one that is not complete is an error."""
        named = self.recordings() if recordings is None else recordings
        if lost := [r for r in named if not self.complete(r)]:
            raise ValueError(f"not complete: {lost}")
        df = self.spark.read.schema(schema)
        return df.option("basePath", self.root).parquet(*[self.folder(r) for r in named]) if named else self.spark.createDataFrame([], schema)

    def recordings(self) -> list[tuple]:
        """All complete recordings, their keys as texts."""
        level = [(self.root, ())]
        for k in self.keys:
            level = [(p, (*key, p.rsplit("=", 1)[1])) for folder, key in level for p, _ in self.files.listed(folder) if p.rsplit("/", 1)[1].startswith(f"{k}=")]
        return sorted(key for p, key in level if self.files.exists(f"{p}/{DONE}"))


def contents(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(name, size, sha256) of every file below root whose name fits: name is its path from root on. Files are read by tasks, one
    at a time in whole, up to Spark's bound for binary files."""
    root = root.rstrip("/")
    read = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(root)
    bare_path = lambda c: F.regexp_replace(c, "^file:/+", "file:/")
    files = read.select(bare_path(F.col("path")).alias("path"), "length", F.sha2("content", 256).alias("sha256"))
    # a scan makes no task for an empty file; Spark's own index of the folder has it
    known = spark.createDataFrame([(x,) for x in read.inputFiles()], "path string").select(bare_path(F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B")))).alias("path"))
    none = known.join(files.select("path"), "path", "left_anti").select("path", F.lit(0).cast("long").alias("length"), F.sha2(F.lit("").cast("binary"), 256).alias("sha256"))
    files = files.unionByName(none)
    bare = root.split(":", 1)[-1].lstrip("/")
    at = F.locate(bare, F.col("path")) + len(bare) + 1
    return files.select(F.substring(F.col("path"), at, F.length("path")).alias("name"), F.col("length").alias("size"), "sha256")


def tree_digest(files: DataFrame) -> DataFrame:
    """(n_files, size, digest) of files (name, size, sha256), whatever their order: SHA-256 over the sorted names and digests.

    Names are folded by their first characters' hash into 4096 groups before the last step, which gets one digest for each.
    """
    line = F.concat_ws("\n", "name", F.col("size").cast("string"), "sha256")
    groups = files.select(F.substring(F.sha2(F.col("name").cast("binary"), 256), 1, 3).alias("g"), line.alias("line"), "size").groupBy("g")
    folded = groups.agg(F.sha2(F.array_join(F.array_sort(F.collect_list("line")), "\n\n").cast("binary"), 256).alias("d"), F.count("*").alias("n"), F.sum("size").alias("s"))
    every = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("g", "d"))), lambda x: F.concat(x["g"], F.lit(":"), x["d"])), "\n")
    return folded.agg(F.coalesce(F.sum("n"), F.lit(0).cast("long")).alias("n_files"), F.coalesce(F.sum("s"), F.lit(0).cast("long")).alias("size"), F.sha2(every.cast("binary"), 256).alias("digest"))


def differences(files: DataFrame, pinned: DataFrame) -> DataFrame:
    """(name, problem) where files (name, sha256) differ from pinned (name, sha256): missing, changed, unknown or repeated."""
    repeated = pinned.groupBy("name").agg(F.count_distinct("sha256").alias("n")).where("n > 1").select("name", F.lit("pinned twice").alias("problem"))
    one = pinned.groupBy("name").agg(F.min("sha256").alias("want"))
    j = files.select("name", "sha256").join(one, "name", "full")
    problem = F.when(F.col("sha256").isNull(), "missing").when(F.col("want").isNull(), "unknown").when(F.col("sha256") != F.col("want"), "changed")
    return j.select("name", problem.alias("problem")).where("problem is not null").unionByName(repeated)


def verified(spark: SparkSession, root: str, pinned: DataFrame, pattern: str = "*", unknown: bool = False) -> DataFrame:
    """The files below root, which must be those of a pinned manifest (name, sha256); any difference is an error that names it, except
    files that the manifest does not know where unknown is true."""
    files = contents(spark, root, pattern)
    bad = differences(files, pinned)
    bad = bad.where("problem <> 'unknown'") if unknown else bad
    if found := bad.orderBy("name").limit(10).collect():
        raise ValueError("inputs differ from their manifest: " + ", ".join(f"{r['name']} is {r['problem']}" for r in found))
    return files

