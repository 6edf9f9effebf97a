"""Spelling variants against all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest
from tests.llm import plain

from vertexloom.llm import spelling

SF = "/root/testdata/sf0.01"


def near(a, b):
    """Whether one code point is inserted, deleted or replaced."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else (a[i + 1 :] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1 :])


def pairs(words):
    """All near pairs, through words with one place left out."""
    by = {}
    for w in words:
        for i in range(len(w) + 1):
            by.setdefault(w[:i] + w[i + 1 :], set()).add(w)
    return {(a, b) for own in by.values() for a in own for b in own if near(a, b)}


def variants(counts):
    """{word: (form, root, n, n_near, form_n)}."""
    by = {}
    for a, b in pairs(counts):
        by.setdefault(a, []).append(b)
    best = {w: min(x, key=lambda v: (-counts[v], v)) for w, x in by.items()}
    form = {w: b for w, b in best.items() if counts[b] >= 5 * counts[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {w: (form.get(w), root(w), n, len(by.get(w, ())), counts.get(form.get(w))) for w, n in counts.items()}


def counted(rows):
    c = Counter()
    for doc_id, text in rows:
        for run in re.findall("[a-zÀ-ÿ]+", (text or "").translate(plain.LOWER)):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            c[run] += len(run) >= 6
    return {w: n for w, n in c.items() if n >= 5}


@pytest.mark.parametrize("kind", ["awkward", "real", "empty"])
def test_report(spark, kind):
    docs = plain.awkward(spark).withColumn("word", spelling.F.lit("n")) if kind == "awkward" else spark.read.parquet(f"{SF}/documents.parquet").where("true" if kind == "real" else "false")
    want = variants(counted([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]))
    got = {r["word"]: tuple(r)[1:] for r in spelling.report(docs).select("word", "form", "root", "n", "n_near", "form_n").collect()}
    assert got == want and (kind == "empty") == (not want)


def test_random_words(spark):
    """Many near words of few letters, some much longer than the tries' first part, doubled letters, and chains of forms."""
    r = random.Random(2)
    words = {"".join(r.choice("abc") for _ in range(r.randint(6, 9))) for _ in range(500)}
    long = "".join(r.choice("abcdefgh") for _ in range(400))
    words |= {long, long[:200] + "z" + long[201:], long[1:], long[:-1], long + "x", long[:33] + long[34:], "a" * 6, "a" * 7, "a" * 50, "a" * 51, "é" * 6 + "a", "é" * 6}
    counts = {w: r.choice([5, 6, 30, 200, 2000, 30_000]) for w in words}
    counts |= {"chainaa": 5, "chainab": 25, "chainbb": 125, "chaincbb": 625, "chaincb": 3125, "xchaincb": 15_625}
    df = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
    got = {(x["word"], x["near"]) for x in spelling.neighbours(df).collect()}
    assert got == pairs(counts)
    want = variants(counts)
    rows = {x["word"]: tuple(x)[1:] for x in spelling.grouped(df, spelling.neighbours(df)).select("word", "form", "root", "n", "n_near", "form_n").collect()}
    assert rows == want and want["chainaa"][1] == "xchaincb"
