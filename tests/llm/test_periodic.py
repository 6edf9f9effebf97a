"""Periodic runs against all periods of all texts."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from tests.llm import plain

from vertexloom.llm import periodic

SF = "/root/testdata/sf0.001"


def brute_runs(w):
    found, number = {}, np.unique(np.array(w, dtype=object).astype(str), return_inverse=True)[1] if w else np.zeros(0)
    for q in range(len(w) // 3, 0, -1):
        differ = np.concatenate([[-1], np.flatnonzero(number[q:] != number[:-q]), [len(w) - q]])
        for k in np.flatnonzero(np.diff(differ) - 1 + q >= max(24, 3 * q)):
            found[int(differ[k]) + 1, int(differ[k + 1] - differ[k]) - 1 + q] = q  # the smallest comes last
    return sorted((s, n, q) for (s, n), q in found.items())


def planted(doc_id, w):
    h, n = zlib.crc32(b"" if doc_id is None else str(doc_id).encode()), len(w)
    if h % 10 or not n:
        return w
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def collapsed(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def text(r):
    """Words of few kinds with stretches of repeats inside, also of repeats that repeat."""
    w = [r.choice("abcde"[: r.choice([1, 2, 3, 5])]) for _ in range(r.choice([0, 10, 60, 300]))]
    for _ in range(r.randint(0, 4)):
        u = [r.choice("abcd") for _ in range(r.randint(1, 20))]
        if r.random() < 0.5:
            u = u[: len(u) // 2 + 1] * r.randint(2, 9) + u[: r.randint(0, 2)]
        at = r.randint(0, len(w))
        w[at:at] = u * r.randint(1, 9) + u[: r.randint(0, len(u))]
    return w


@pytest.mark.parametrize("seed", range(6))
def test_random_texts(seed):
    r = random.Random(seed)
    for _ in range(10):
        texts, ids = [text(r) for _ in range(30)], [r.randint(0, 10**9) for _ in range(30)]
        found, rest = periodic._periodic(ids, pa.array([" ".join(w) for w in texts]))
        for i, w, f, c in zip(ids, texts, found.to_pylist(), rest.to_pylist(), strict=True):
            w = planted(i, w)
            want = brute_runs(w)
            assert [(x["start"], x["length"], x["period"]) for x in f] == want
            assert c == collapsed(w, want)


def test_fibonacci_words():
    """A text that is repetitive on every scale, its runs one in another."""
    a, b = ["x"], ["x", "y"]
    while len(b) < 700:
        a, b = b, b + a
    w = b[:120] + ["z"] + (b[:90] * 4)
    found, _ = periodic._periodic(None, pa.array([" ".join(w)]))
    assert [(x["start"], x["length"], x["period"]) for x in found.to_pylist()[0]] == brute_runs(w)


def test_wavelet_tree():
    rng = np.random.default_rng(1)
    for n in (1, 2, 33, 100):
        values = rng.permutation(n)
        tree = periodic.WaveletTree(values)
        low = rng.integers(0, n, 200)
        high = low + 1 + (rng.random(200) * (n - low)).astype(int).clip(max=n - low - 1)
        value = rng.integers(0, n + 3, 200)
        assert tree.below(low, high, value).tolist() == [int((values[a:b] < v).sum()) for a, b, v in zip(low, high, value, strict=True)]
        k = (rng.random(200) * (high - low)).astype(int)
        assert tree.smallest(low, high, k).tolist() == [int(np.sort(values[a:b])[i]) for a, b, i in zip(low, high, k, strict=True)]


@pytest.mark.parametrize("kind", ["awkward", "real", "empty"])
def test_report(spark, kind):
    docs = plain.awkward(spark).withColumnRenamed("kept", "runs") if kind == "awkward" else spark.read.parquet(f"{SF}/documents.parquet").where("true" if kind == "real" else "false")
    want, sha = Counter(), lambda t: hashlib.sha256(t.encode()).hexdigest()
    for r in docs.select("doc_id", "text").collect():
        w = planted(r["doc_id"], plain.words(r["text"]))
        runs = brute_runs(w)
        best = min(runs, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=None)
        four = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        want[r["doc_id"], len(runs), *four, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(collapsed(w, runs))] += 1
    assert Counter(map(tuple, periodic.report(docs).collect())) == want
    plain_ = periodic.periodic(docs)
    assert plain_.columns == [c for c in docs.columns if c != "runs"] + ["runs", "collapsed"]
    assert plain_.count() == docs.count()
