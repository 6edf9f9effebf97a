"""Recordings by their names: entities, discovery, pairs of hemispheres, numbers of sessions, lists with gaps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def entities(files: DataFrame) -> DataFrame:
    """files (path) with entities: the key-value parts of the name, as in sub-01_ses-2_task-rest_hemi-L_bold.func.gii."""
    name = F.element_at(F.split("path", "/"), -1)
    parts = F.filter(F.split(F.regexp_replace(name, r"\..*$", ""), "_"), lambda p: p.contains("-"))
    pairs = F.transform(parts, lambda p: F.struct(F.split(p, "-", 2)[0].alias("k"), F.split(p, "-", 2)[1].alias("v")))
    return files.withColumn("entities", F.map_from_entries(pairs))


def paired(runs: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each run with both hemispheres (keys, left, right); repeated or single files are errors in `problem`."""
    side = lambda h: F.sort_array(F.collect_list(F.when(F.col("hemi") == h, F.col("path"))))
    g = runs.groupBy(*keys).agg(side("L").alias("l"), side("R").alias("r"))
    problem = F.when((F.size("l") > 1) | (F.size("r") > 1), "repeated").when((F.size("l") == 0) | (F.size("r") == 0), "single")
    return g.select(*keys, F.get("l", F.lit(0)).alias("left"), F.get("r", F.lit(0)).alias("right"), problem.alias("problem"))


def numbered(runs: DataFrame, subject: str, order: list[str]) -> DataFrame:
    """runs with session_number: the place within the subject in the order of names as strings, absent ones first."""
    by = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in order]
    return runs.withColumn("session_number", F.row_number().over(Window.partitionBy(subject).orderBy(*by)).cast("long"))


def gaps(runs: DataFrame, subject: str, number: str, path: str, sessions: int) -> DataFrame:
    """(subject, number, path) for sessions 1 .. n of every subject, NONE where there is none."""
    every = runs.select(subject).distinct().withColumn(number, F.explode(F.sequence(F.lit(1).cast("long"), F.lit(sessions).cast("long"))))
    return every.join(runs.select(subject, number, path), [subject, number], "left").withColumn(path, F.coalesce(path, F.lit("NONE")))


def manifest(frame: DataFrame, *columns: str) -> DataFrame:
    """One JSON text for each row, of the columns in this order."""
    return frame.select(F.to_json(F.struct(*columns)).alias("manifest"))


def missing(asked: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """What was asked for and not found."""
    return asked.join(found, key, "left_anti").select(key).distinct()


def listed(spark: SparkSession, root: str, pattern: str = "*.func.gii") -> DataFrame:
    """(path) of all files below root whose name fits; their contents are not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(root).select("path")


def _bold(column: str) -> Column:
    """Which kind of recording a name is, by its ending; null for other files."""
    out = F
    for ending, kind in (("_bold.func.gii", "surface"), ("_bold.dtseries.nii", "grayordinates"), ("_bold.nii.gz", "volume"), ("_bold.nii", "volume")):
        out = out.when(F.col(column).endswith(ending), kind)
    return out


def _rooted(files: DataFrame) -> DataFrame:
    """files (path) with base, folder and name, of those in sub-*/func and sub-*/ses-*/func; of bases the derivatives of one pipeline go
    before its older place, and both before anything else."""
    place = F.regexp_extract("path", r"^(?:(.*)/)?(sub-[^/]+/(?:ses-[^/]+/)?func)/([^/]+)$", 0)
    part = lambda i: F.regexp_extract("path", r"^(?:(.*)/)?(sub-[^/]+/(?:ses-[^/]+/)?func)/([^/]+)$", i)
    inside = files.where(place != "").select("path", part(1).alias("base"), part(2).alias("folder"), part(3).alias("name"))
    order = F.when(F.col("base").rlike("(^|/)derivatives/fmriprep$"), 0).when(F.col("base").rlike("(^|/)fmriprep$"), 1).otherwise(2)
    inside = inside.withColumn("order", order)
    return inside.join(F.broadcast(inside.agg(F.min("order").alias("order"))), "order").drop("order")  # one row


def discovered(files: DataFrame, task: str | None = None, spaces: Sequence[tuple[str, str | None]] | None = None, pairs: bool = False) -> DataFrame:
    """Recordings (subject, session, task, run, acq, dir, hemi, path) among files (path); an absent entity is null.

    Only files in sub-*/func and sub-*/ses-*/func count, and only surfaces (_bold.func.gii); if there is a folder derivatives/fmriprep, or else
    fmriprep, only what lies in it. task and spaces (space, density) leave out others. Errors: an entity that is malformed or given twice, no subject
    or task, a name that disagrees with its folders, a hemisphere that is neither L nor R, two files of one hemisphere with equal entities, and
    variants of one recording (echo, reconstruction, description, space) that only other entities tell apart: nothing is guessed. Acquisitions
    and directions are recordings of their own. With pairs a recording with one hemisphere is an error too.
    """
    fail = lambda text, *more: F.raise_error(F.concat(F.lit(text), "path", *more)).cast("boolean")
    true = F.lit(True)
    named = _rooted(files).withColumn("kind", _bold("name")).where("kind is not null")
    tokens = F.split(F.regexp_replace("name", r"_bold\.(func\.gii|dtseries\.nii|nii\.gz|nii)$", ""), "_")
    good = F.forall(tokens, lambda t: t.rlike("^[A-Za-z0-9]+-[A-Za-z0-9]+$"))
    keys = F.transform(tokens, lambda t: F.get(F.split(t, "-"), F.lit(0)))
    once = F.size(F.array_distinct(keys)) == F.size(keys)
    named = named.where(F.when(good & once, true).otherwise(fail("an entity is malformed or given twice: ")))
    e = named.withColumn("entities", F.transform(tokens, lambda t: F.struct(F.get(F.split(t, "-"), F.lit(0)).alias("k"), F.get(F.split(t, "-"), F.lit(1)).alias("v"))))
    get = lambda k: F.get(F.filter("entities", lambda x: x["k"] == k), F.lit(0))["v"]
    e = e.where(F.when(get("sub").isNotNull() & get("task").isNotNull(), true).otherwise(fail("a name needs sub and task: ")))
    if task is not None:
        e = e.where(get("task") == task.removeprefix("task-"))
    folder = F.concat(F.lit("sub-"), get("sub"), F.coalesce(F.concat(F.lit("/ses-"), get("ses")), F.lit("")), F.lit("/func"))
    e = e.where(F.when(F.col("folder") == folder, true).otherwise(fail("a name disagrees with its folder: "))).where("kind = 'surface'")
    if spaces is not None:
        fits = F.lit(False)
        for space, density in spaces:
            fits = fits | (get("space").eqNullSafe(F.lit(space)) & get("den").eqNullSafe(F.lit(density)))
        e = e.where(fits)
    e = e.where(F.when(F.coalesce(get("hemi"), F.lit("")).isin("L", "R"), true).otherwise(fail("a hemisphere is neither L nor R: ")))
    names = {"subject": "sub", "session": "ses", "task": "task", "run": "run", "acq": "acq", "dir": "dir", "hemi": "hemi"}
    other = F.to_json(F.array_sort(F.filter("entities", lambda x: x["k"] != "hemi")))
    runs = e.select(*[get(k).alias(n) for n, k in names.items()], other.alias("all"), "path")
    physical = [n for n in names if n != "hemi"]
    g = runs.groupBy(*physical).agg(
        F.count_distinct("all").alias("variants"),
        F.min("path").alias("path"),
        F.max("path").alias("last"),
        *[F.count_if(F.col("hemi") == h).alias(h) for h in "LR"],
        F.sort_array(F.collect_list(F.struct("hemi", F.col("path").alias("file")))).alias("files"),
    )
    g = g.where(F.when((F.col("L") > 1) & (F.col("variants") == 1) | (F.col("R") > 1) & (F.col("variants") == 1), fail("two files for one recording: ", F.lit(" and "), "last")).otherwise(true))
    g = g.where(F.when(F.col("variants") > 1, fail("variants of one recording: ", F.lit(" and "), "last")).otherwise(true))
    if pairs:
        g = g.where(F.when((F.col("L") == 1) & (F.col("R") == 1), true).otherwise(fail("a recording has one hemisphere: ")))
    return g.select(*physical, F.inline("files")).select(*names, F.col("file").alias("path"))


#: Spaces and densities of one surface mesh, under both of its names.
MESH_41K = (("fsaverage6", None), ("fsaverage6", "41k"), ("fsaverage", "41k"))


def chosen(runs: DataFrame, required: bool = False, **wanted: Sequence[str]) -> DataFrame:
    """runs whose columns (subject=..., session=..., task=..., run=...) have one of the wanted values; entity prefixes may be given.

    Values are ASCII letters and digits, at least one; anything else is an error, and with required also one that no run has. Columns
    that are not named are not restricted.
    """
    prefix = {"subject": "sub-", "session": "ses-", "task": "task-", "run": "run-"}
    for column, values in wanted.items():
        bare = [v.removeprefix(prefix[column]) for v in ([values] if isinstance(values, str) else values)]
        if not bare or (bad := [v for v in bare if not (v.isascii() and v.isalnum())]):
            raise ValueError(f"{column} values are one or more, of ASCII letters and digits: {bad if bare else bare}")
        runs = runs.where(F.col(column).isin(bare))
        wanted[column] = bare
    for column, bare in wanted.items() if required else ():
        found = {r[0] for r in runs.select(column).distinct().collect()}  # at most as many as are wanted
        if lost := sorted(set(bare) - found):
            raise ValueError(f"no recording of {column} {', '.join(lost)}")
    return runs


def write_lists(runs: DataFrame, path: str, by: Sequence[str], order: str, line: str = "path") -> None:
    """A list of profiles for each value of `by` in a folder of its own below path, a line for each row in the order of a column, NONE
    for null; lists of one folder are one file, so that lines keep their order."""
    rows = runs.select(*by, order, F.coalesce(line, F.lit("NONE")).alias("value"))
    rows.repartition(*by).sortWithinPartitions(*by, order).select(*by, "value").write.partitionBy(*by).text(path)


def profile_list(spark: SparkSession, path: str) -> DataFrame:
    """(line) of a list of profiles, one path a line; blank lines are skipped and NONE is null. Lines of one file keep their order."""
    lines = spark.read.text(path).select(F.trim("value").alias("line"), F.monotonically_increasing_id().alias("place")).where("line <> ''")
    return lines.select(F.nullif("line", F.lit("NONE")).alias("line"), "place")


def record_changes(record: DataFrame) -> DataFrame:
    """record (step, cost) with change: the relative change against the step before, infinite where that cost is zero, null at the start."""
    before = F.lag("cost").over(Window.orderBy("step"))  # a row for each step of a fit
    return record.select("step", "cost", F.when(before == 0, F.lit(float("inf"))).otherwise(F.abs((F.col("cost") - before) / before)).alias("change"))
