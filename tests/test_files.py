"""Discovery of recordings, lists, publication, the store that resumes, and digests of inputs."""

import os
import time

import pytest
from pyspark.sql import functions as F

from vertexloom.operators import runs, store

GOOD = [
    "sub-1/func/sub-1_task-rest_hemi-L_bold.func.gii",
    "sub-1/func/sub-1_task-rest_hemi-R_bold.func.gii",
    "sub-1/func/sub-1_task-rest_acq-a_run-1_hemi-L_bold.func.gii",
    "sub-1/func/sub-1_task-rest_acq-b_run-1_hemi-L_bold.func.gii",
    "sub-2/ses-a/func/sub-2_ses-a_task-rest_dir-AP_hemi-L_bold.func.gii",
    "sub-2/ses-a/func/sub-2_ses-a_task-rest_dir-PA_hemi-L_bold.func.gii",
    "sub-2/ses-a/func/sub-2_ses-a_task-rest_bold.nii.gz",
    "sub-2/ses-a/func/sub-2_ses-a_task-rest_events.tsv",
    "sub-2/ses-a/func/sub-2_ses-a_task-other_hemi-L_bold.func.gii",
    "other/sub-3_hemi-L_bold.func.gii",
]


def files(spark, names, base="in/data"):
    return spark.createDataFrame([(f"{base}/{n}",) for n in names], "path string")


def test_recordings(spark, tmp_path):
    got = runs.discovered(files(spark, GOOD))
    key = lambda r: tuple(r[c] for c in ("subject", "session", "task", "run", "acq", "dir", "hemi"))
    assert {key(r) for r in got.collect()} == {
        ("1", None, "rest", None, None, None, "L"), ("1", None, "rest", None, None, None, "R"), ("1", None, "rest", "1", "a", None, "L"), ("1", None, "rest", "1", "b", None, "L"),
        ("2", "a", "rest", None, None, "AP", "L"), ("2", "a", "rest", None, None, "PA", "L"), ("2", "a", "other", None, None, None, "L"),
    }
    assert runs.discovered(files(spark, GOOD), task="task-rest").count() == 6
    assert runs.discovered(files(spark, GOOD), spaces=runs.MESH_41K).count() == 0
    mesh = [f"sub-1/func/sub-1_task-rest_{x}hemi-{h}_bold.func.gii" for x in ("space-fsaverage6_", "run-2_space-fsaverage_den-41k_", "run-3_space-fsaverage_den-10k_") for h in "LR"]
    assert runs.discovered(files(spark, mesh), spaces=runs.MESH_41K, pairs=True).count() == 4
    for n in GOOD[:2]:
        (tmp_path / n).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / n).write_text("x")
    assert runs.discovered(runs.listed(spark, str(tmp_path)), pairs=True).count() == 2


def test_roots(spark):
    """Derivatives of the pipeline go before its older place, both before raw data."""
    one = GOOD[:1]
    three = files(spark, one, "d").union(files(spark, one, "d/derivatives/fmriprep")).union(files(spark, one, "d/fmriprep"))
    assert [r["path"] for r in runs.discovered(three).collect()] == [f"d/derivatives/fmriprep/{one[0]}"]
    assert [r["path"] for r in runs.discovered(three.where("path not like '%derivatives%'")).collect()] == [f"d/fmriprep/{one[0]}"]


@pytest.mark.parametrize(
    ("name", "says"),
    [
        ("sub-2/ses-b/func/sub-2_ses-a_task-rest_hemi-L_bold.func.gii", "disagrees"),
        ("sub-2/func/sub-3_task-rest_hemi-L_bold.func.gii", "disagrees"),
        ("sub-2/ses-b/func/sub-2_task-rest_hemi-L_bold.func.gii", "disagrees"),
        ("sub-2/func/sub-2_hemi-L_bold.func.gii", "sub and task"),
        ("sub-2/func/sub-2_task-rest_task-rest_hemi-L_bold.func.gii", "malformed"),
        ("sub-2/func/sub-2_task-ré_hemi-L_bold.func.gii", "malformed"),
        ("sub-2/func/sub-2_task-rest_hemi_bold.func.gii", "malformed"),
        ("sub-2/func/sub-2_task-rest_hemi-B_bold.func.gii", "neither"),
        ("sub-2/func/sub-2_task-rest_bold.func.gii", "neither"),
        ("sub-1/func/sub-1_task-rest_desc-x_hemi-L_bold.func.gii", "variants"),
        ("sub-1/func/sub-1_hemi-L_task-rest_bold.func.gii", "two files"),
        ("sub-1/func/sub-1_task-rest_echo-2_hemi-R_bold.func.gii", "variants"),
    ],
)
def test_errors_of_names(spark, name, says):
    with pytest.raises(Exception, match=says):
        runs.discovered(files(spark, [*GOOD, name])).collect()


def test_single_hemisphere(spark):
    with pytest.raises(Exception, match="one hemisphere"):
        runs.discovered(files(spark, GOOD), pairs=True).collect()


def test_choice(spark):
    got = runs.discovered(files(spark, GOOD))
    assert runs.chosen(got, subject=["sub-1"]).count() == 4 and runs.chosen(got, session="ses-a", subject=["1", "2"]).count() == 3
    for bad in (["sub-1_x"], [], ["é"], [""]):
        with pytest.raises(ValueError):
            runs.chosen(got, subject=bad)
    with pytest.raises(ValueError, match="9"):
        runs.chosen(got, required=True, subject=["1", "9"])
    assert runs.chosen(got, required=True, run=["1"]).count() == 2


def test_lists(spark, tmp_path):
    (tmp_path / "list.txt").write_text("a/b\n\nNONE\n c \n")
    assert [r["line"] for r in runs.profile_list(spark, str(tmp_path / "list.txt")).orderBy("place").collect()] == ["a/b", None, "c"]
    df = spark.createDataFrame([("L", s, f"p{s}" if s != 3 else None) for s in range(1, 30)] + [("R", 1, "q")], "hemi string, subject long, path string").repartition(5)
    runs.write_lists(df, f"{tmp_path}/lists", ["hemi"], "subject")
    back = [r["line"] for r in runs.profile_list(spark, f"{tmp_path}/lists/hemi=L").orderBy("place").collect()]
    assert back == [f"p{s}" if s != 3 else None for s in range(1, 30)]


def test_publish(spark, tmp_path):
    df = spark.range(100).selectExpr("id", "cast(id as string) as t")
    assert store.publish(df, f"{tmp_path}/out").first()["n_rows"] == 100
    with pytest.raises(FileExistsError):
        store.publish(df, f"{tmp_path}/out")
    with pytest.raises(ValueError):
        store.publish(df.withColumn("t", F.udf(lambda i: str(time.time_ns()))("id")), f"{tmp_path}/other")
    # a job that fails half way leaves nothing and does not block the next one
    with pytest.raises(Exception, match="boom"):
        store.publish(df.withColumn("t", F.when(F.col("id") < 90, F.col("t")).otherwise(F.raise_error(F.lit("boom")))), f"{tmp_path}/third")
    assert os.listdir(tmp_path) == ["out"]
    # what a lost driver has left goes when it is old, not before
    (tmp_path / f"{store.STAGE}third-lost").mkdir()
    assert store.publish(df, f"{tmp_path}/third").count() == 1 and store.stale(spark, f"{tmp_path}/third") == []
    assert len(store.stale(spark, f"{tmp_path}/third", age=-60)) == 1
    store.publish_all({"a": df, "b": df.limit(5)}, f"{tmp_path}/many", {"by": "test"})
    assert sorted(os.listdir(f"{tmp_path}/many")) == [".manifest.json.crc", "a", "b", "manifest.json"] and spark.read.parquet(f"{tmp_path}/many/b").count() == 5
    with pytest.raises(FileExistsError), store.staged(spark, f"{tmp_path}/race") as stage:
        df.write.parquet(stage)
        df.write.parquet(f"{tmp_path}/race")  # another one was faster
    assert not [x for x in os.listdir(tmp_path) if x.startswith(f"{store.STAGE}race")]


def test_store_resumes(spark, tmp_path):
    asked, calls = [("a", 1), ("a", 2), ("b", 1), ("b", 2), ("c", 1)], []
    schema = "vertex long, x array<double>, subject string, session long"

    def make(own):
        calls.append(own)
        if len(calls) == 2:
            raise RuntimeError("lost")
        return spark.createDataFrame([(v, [float(s), v / 2], k, s) for k, s in own for v in range(4)], schema)

    at = store.ProfileStore(spark, f"{tmp_path}/profiles", ["subject", "session"])
    with pytest.raises(RuntimeError):
        at.write(asked, make, batch=2)
    assert at.recordings() == [("a", "1"), ("a", "2")]
    # killed between the rename and the marker: counts as not written
    os.remove(f"{tmp_path}/profiles/subject=a/session=2/{store.DONE}")
    assert at.pending(asked) == [("a", 2), ("b", 1), ("b", 2), ("c", 1)]
    assert at.write(asked, make, batch=2) == 4 and calls[2:] == [[("a", 2), ("b", 1)], [("b", 2), ("c", 1)]]
    assert at.write(asked, make) == 0 and len(calls) == 4
    rows = at.read(schema).collect()
    assert len(rows) == 20 and {(r["subject"], r["session"]) for r in rows} == set(asked) and all(r["x"] == [r["session"], r["vertex"] / 2] for r in rows)
    assert at.read(schema, [("b", 2)]).count() == 4 and not [x for x in os.listdir(f"{tmp_path}/profiles") if x.startswith(store.STAGE)]
    with pytest.raises(ValueError, match="not complete"):
        at.read(schema, [("z", 1)])
    with pytest.raises(ValueError, match="no rows"):
        at.write([("z", 1)], lambda own: spark.createDataFrame([(0, [1.0], "z", 2)], schema))


def test_digests(spark, tmp_path):
    for n, text in (("a.txt", "one"), ("deep/b.txt", "two"), ("deep/c.bin", "three")):
        (tmp_path / n).parent.mkdir(exist_ok=True)
        (tmp_path / n).write_text(text)
    found = store.contents(spark, str(tmp_path))
    assert {r["name"] for r in found.collect()} == {"a.txt", "deep/b.txt", "deep/c.bin"}
    pinned = spark.createDataFrame([(r["name"], r["sha256"]) for r in found.collect()], "name string, sha256 string")
    whole = store.tree_digest(found).first()
    assert whole["n_files"] == 3 and whole["size"] == 11 and store.tree_digest(found.repartition(7)).first() == whole
    assert store.verified(spark, str(tmp_path), pinned).count() == 3
    (tmp_path / "deep/b.txt").write_text("two!")
    with pytest.raises(ValueError, match="deep/b.txt is changed"):
        store.verified(spark, str(tmp_path), pinned)
    assert store.tree_digest(store.contents(spark, str(tmp_path))).first()["digest"] != whole["digest"]
    (tmp_path / "deep/b.txt").write_text("two")
    (tmp_path / "new").write_text("")
    with pytest.raises(ValueError, match="new is unknown"):
        store.verified(spark, str(tmp_path), pinned)
    assert store.verified(spark, str(tmp_path), pinned, unknown=True).count() == 4
    with pytest.raises(ValueError, match="d is missing"):
        store.verified(spark, str(tmp_path), pinned.union(spark.createDataFrame([("d", "0")], pinned.schema)), unknown=True)
    assert store.differences(found, pinned.union(pinned.limit(1).select("name", F.lit("0")))).where("problem = 'pinned twice'").count() == 1
