"""Repeated passages against all windows of 50 words, in plain Python."""

import random
from collections import defaultdict

import pytest
from tests.llm import plain

from vertexloom.llm import suffix_dedup


def brute(texts, n=50):
    """{row number: [(begin, stop)]}: words inside windows of n words that also stand in another row, as maximal runs."""
    rows, out = [plain.words(t) for t in texts], {}
    where = defaultdict(set)
    for i, w in enumerate(rows):
        for a in range(len(w) - n + 1):
            where[tuple(w[a : a + n])].add(i)
    for i, w in enumerate(rows):
        spans = []
        for a in range(len(w) - n + 1):
            if len(where[tuple(w[a : a + n])]) > 1:
                if spans and a <= spans[-1][1]:
                    spans[-1][1] = a + n
                else:
                    spans.append([a, a + n])
        if spans:
            out[i] = [tuple(s) for s in spans]
    return out


def check(spark, texts, partitions):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(partitions)
    got = defaultdict(list)
    for r in suffix_dedup.report(docs).collect():
        got[r["doc_id"]].append((r["begin"], r["stop"]))
        assert r["n_words"] == r["stop"] - r["begin"]
    assert {k: sorted(v) for k, v in got.items()} == brute(texts)


def test_real(spark):
    check(spark, [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()], 3)


def test_awkward(spark):
    check(spark, [r[1] for r in plain.AWKWARD], 2)


@pytest.mark.parametrize("ranges", ["2", "40"])
def test_planted(spark, ranges):
    """Passages of lengths around 50 in random texts, one in very many of them, over few and many ranges."""
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(2000)}"
    passages = [[word() for _ in range(n)] for n in (49, 50, 51, 60, 90, 200)]
    texts = []
    for i in range(150):
        w = [word() for _ in range(rng.randrange(0, 150))]
        for p in rng.sample(passages, rng.randrange(3)) + [passages[3]] * (i % 2):
            at = rng.randrange(len(w) + 1)
            w[at:at] = p
        texts.append(" ".join(w))
    texts += [" ".join(f"x{i} same line again" for i in range(40)) * 3, "only " * 400, None]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        check(spark, texts, 4)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("others", [1, 400])
def test_straddling(spark, others):
    """A passage on both sides of its minimiser, among texts that share more of it on one side each."""
    rng = random.Random(9)
    word = lambda: f"w{rng.randrange(100000)}"
    shared, texts = [word() for _ in range(50)], []
    for _ in range(2):
        texts.append([word() for _ in range(60)] + shared + [word() for _ in range(60)])
    for i in range(others):
        part = shared[:46] if i % 2 else shared[4:]
        texts.append([word() for _ in range(rng.randrange(60))] + part + [word() for _ in range(rng.randrange(60))])
    rng.shuffle(texts)
    check(spark, [" ".join(t) for t in texts], 3)


def test_families(spark):
    """Edited copies of one text, so that each passage has other partners."""
    rng = random.Random(3)
    base, texts = [f"b{i}" for i in range(300)], []
    for i in range(120):
        t = list(base[rng.randrange(100) : 200 + rng.randrange(100)])
        for _ in range(rng.randrange(1, 8)):
            t[rng.randrange(len(t))] = f"e{rng.randrange(40)}"
        texts.append(" ".join(t))
    check(spark, texts, 4)


def test_clashing_columns(spark):
    text = " ".join(f"w{i}" for i in range(70))
    docs = spark.createDataFrame([(1, text, 5, "x"), (None, text, 6, "y"), (1, text, 7, "z"), (2, "w1", 8, None)], "doc_id long, text string, row int, begin string")
    got = sorted((r["doc_id"] or 0, r["begin"], r["stop"]) for r in suffix_dedup.report(docs).collect())
    assert got == [(0, 0, 70), (1, 0, 70), (1, 0, 70)]


def test_without_repeats(spark):
    """A passage stays in the first row; what is left of the others has no repeated passage and all of their other words."""
    rng = random.Random(11)
    word = lambda: f"é{rng.randrange(10**6)}"
    passages, texts = [[word() for _ in range(n)] for n in (55, 80)], []
    for i in range(12):
        w = [word() for _ in range(30)]
        w[10:10] = passages[i % 2] + ([word() for _ in range(5)] + passages[1] if i % 5 == 0 else [])
        texts.append(" ".join(w))
    texts += [texts[3], None, "short"]
    docs = spark.createDataFrame([(i, t, len(t or ""), "x") for i, t in enumerate(texts)], "doc_id long, text string, n_chars long, row string").coalesce(1)
    out = suffix_dedup.without_repeats(docs)
    got = {r["doc_id"]: r for r in out.collect()}
    assert out.columns == docs.columns and got[13]["text"] is None and got[14]["text"] == "short" and got[0]["text"] == texts[0]
    assert all(r["n_chars"] == len(r["text"] or "") and r["row"] == "x" for r in got.values()) and plain.words(got[12]["text"]) == []
    assert brute([got[i]["text"] for i in range(15)]) == {}
    shared = {w for p in passages for w in p}
    for i in range(12):
        assert [w for w in plain.words(got[i]["text"]) if w not in shared] == [w for w in plain.words(texts[i]) if w not in shared]
    assert sum(" ".join(p) in (got[i]["text"] or "") for i in range(15) for p in passages) == 2
