"""Each stage of the pipeline against plain Python on its own input."""

import zlib
from collections import Counter

from tests.llm import plain
from tests.llm.test_operators import brute_classes, brute_windows

import corpus_pipeline
from vertexloom.llm import mixing, token_store
from vertexloom.llm.common import written

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language", "near_duplicates", "benchmark", "mix", "tokens"]
    stage, docs = dict(corpus_pipeline.STAGES), spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    rows = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}

    first = written(stage["language"](spark, docs, SF), "first")
    assert first.columns == columns
    lost = set(rows(docs)) - set(rows(first))
    letters = lambda t: sum(c.isalpha() for c in t or "")
    assert all(letters(rows(docs)[i]) for i in rows(first)) and len(lost) <= 2

    second = written(stage["near_duplicates"](spark, first, SF), "second")
    classes = brute_classes(list(rows(first).items()), 5, 80)
    assert second.columns == columns and rows(second) == {i: t for i, t in rows(first).items() if classes[i][1] == i}

    third = written(stage["benchmark"](spark, second, SF), "third")
    split, windows = brute_windows([(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()])
    sizes = {len(w) for w in windows}

    def leaked(t):
        w = split(t)
        return any(tuple(w[a : a + k]) in windows for k in sizes for a in range(len(w) - k + 1))

    assert third.columns == columns and rows(third) == {i: t for i, t in rows(second).items() if not leaked(t)}

    fourth = written(stage["mix"](spark, third, SF), "fourth")
    taken = {r["doc_id"]: r["taken"] for r in mixing.report(third).collect()}
    out = Counter()
    for r in fourth.collect():
        out[r["doc_id"]] += len(plain.words(r["text"]))
    assert fourth.columns == columns and out == Counter({i: n for i, n in taken.items() if n})

    from tokenizers import Tokenizer

    t = Tokenizer.from_file(token_store.public_tokenizer())
    want = Counter()
    for r in fourth.collect():
        ids = [*t.encode(r["text"], add_special_tokens=False).ids, 1]
        want[r["doc_id"], len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))] += 1
    got = stage["tokens"](spark, fourth, SF).collect()
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]


def test_whole(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and out.count() > 0
    assert corpus_pipeline.ORACLE_SQL is None


def test_empty(spark, tmp_path):
    for t in ("documents", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").where("false").write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_on_awkward_rows(spark):
    """Nulls in every column, empty and very long texts, repeated rows and clashing columns, stage by stage."""
    awkward = plain.awkward(spark)
    nulls = spark.createDataFrame([(None,) * 5, (20, None, None, None, None)], plain.SCHEMA).selectExpr("*", "cast(null as string) as n_words", "3 as kept", "1 as _row")
    docs = written(awkward.unionByName(awkward.where("doc_id in (5, 8, 13)")).unionByName(nulls), "docs")
    stage = dict(corpus_pipeline.STAGES)
    kept = Counter()
    for name in ("language", "near_duplicates", "benchmark"):
        out = written(stage[name](spark, docs, SF), name)
        assert out.columns == docs.columns
        ids = Counter(r["doc_id"] for r in out.collect())
        if name == "language":  # documents without letters go, repeated rows stay
            assert not {1, 2, 3, 16, 20} & set(ids) and ids[5] == ids[8] == ids[13] == 2 and ids[6] == 1
        if name == "near_duplicates":  # one row of each group; a row without doc_id stays
            assert ids[5] == ids[13] == 1 and ids[6] == 1 and not {7, 8} & set(ids) and ids[None] == 1 and max(ids.values()) == 1
        kept[name], docs = sum(ids.values()), out
    mixed = written(stage["mix"](spark, docs, SF), "mixed")
    assert mixed.columns == docs.columns and mixed.count() > 0
    got = stage["tokens"](spark, mixed, SF)
    assert got.count() == mixed.count() and got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_columns_of_users_stay(spark):
    """Columns that are named like those that the operators add keep their types and values in every stage but the last."""
    names = ["score", "lang_pred", "rejected", "cross_entropy", "n_words", "items", "hit_words", "hit_spans", "slots", "_rest", "_row", "_id", "_size", "_text", "kept", "component_id"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("*", *[f"concat('{n}-', doc_id) as {n}" for n in names])
    docs, stage = written(docs, "docs"), dict(corpus_pipeline.STAGES)
    for name in ("language", "near_duplicates", "benchmark", "mix"):
        out = written(stage[name](spark, docs, SF), name)
        assert [(f.name, f.dataType) for f in out.schema] == [(f.name, f.dataType) for f in docs.schema]
        own = out.collect()
        assert own and all(r[n] == f"{n}-{r['doc_id']}" for r in own for n in names)
        docs = out
