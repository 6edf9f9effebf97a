"""Language-model scoring (9): prediction by partial matching over bytes, with escape estimation and symbol exclusion.

The byte-context trie is a set of written tables, one for each context length: n-grams with counts, and contexts with the sum of
their counts, the number of their symbols and what these count for in the next shorter context. A symbol that a context has not
seen costs an escape (method C); the symbols of that context are then excluded from the shorter one. As the symbols of a context are
among those of each shorter one, what exclusion leaves follows from the contexts alone, so that each distinct n-gram of the texts is
priced once: those of the training texts from the longest context, all others by joins level by level. Below the empty context the
symbols that are left are equally likely. A text ends with a symbol of its own.

The trie holds the counts over all training texts, and none is left out. Prices of the most frequent n-grams are broadcast, so many
as MAX_NODES says; the other n-grams of a text are priced by a join with the table of prices. A word model with additive smoothing is
reported beside it: frequent words are priced from a broadcast table of bounded size, all others by the same join.

Defined results: a null or empty text has the end only; without training documents every symbol has 1 in 256; repeated rows
are scored alike; a row without doc_id counts as the empty id for its fold; columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import crc_mod, written
from .langid import bounded
from .words import SPACED, slices, text_bytes, words_of

#: Bytes of the longest context.
CONTEXT = 5
#: Most n-grams whose prices are broadcast, and most words whose counts are; the others are joined.
MAX_NODES, MAX_WORDS = 1_000_000, 300_000
START, END, SYMBOLS = 0xFE, 0xFF, 256
#: Bytes of text, and positions in it, that are worked on at a time.
SLICE_BYTES, _STEP = 1 << 20, 1 << 19
_WORD, _GRAM, _DOCUMENT = 0, 1, 2
LOG10 = np.log(10.0)


def _lowered(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


def _codes(texts: pa.Array, context: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(codes of context + 1 bytes, text of each) for bounded runs of the texts' bytes and ends."""
    data, at = text_bytes(texts)
    n = np.diff(at)
    owner = np.repeat(np.arange(len(n)), n)
    stride = context + 1
    x = np.full(len(data) + stride * len(n), START, np.uint8)
    x[np.arange(len(data)) + stride * owner + context] = _lowered(data)
    begin = at[:-1] + stride * np.arange(len(n))
    x[begin + context + n] = END
    ends = begin + context + n + 1
    for a in range(0, len(x) - context, _STEP):
        b = min(a + _STEP, len(x) - context)
        code = np.zeros(b - a, np.int64)
        for k in range(stride):
            code = (code << 8) | x[a + k : b + k]
        own = np.searchsorted(begin, np.arange(a, b), "right") - 1
        inside = np.arange(a, b) + stride <= ends[own]
        yield code[inside], own[inside]


class _Tally:
    """Counts of keys, merged when about as many new ones as known ones have come."""

    def __init__(self) -> None:
        self.keys, self.n, self.more, self.waiting = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

    def add(self, keys: np.ndarray) -> None:
        codes, unique = pd.factorize(keys)
        self.more.append((unique, np.bincount(codes, minlength=len(unique))))
        self.waiting += len(unique)
        if self.waiting > max(1 << 20, len(self.keys)):
            self.total()

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        keys, n = (np.concatenate(x) for x in zip((self.keys, self.n), *self.more, strict=True))
        codes, self.keys = pd.factorize(keys)
        self.n = np.bincount(codes, n, minlength=len(self.keys)).astype(np.int64)
        self.more, self.waiting = [], 0
        return self.keys, self.n


def counts(docs: DataFrame, context: int = CONTEXT) -> DataFrame:
    """(kind, key, n, asked) over all of docs (text, learned): word hashes and documents that are learned from, and n-grams of the
    longest context and a symbol; n counts learned documents, asked the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for learned in (True, False):
                own = batch.filter(pa.array(np.array(batch.column(1).to_pylist(), bool) == learned))
                if not own.num_rows:
                    continue
                words, grams = _Tally(), _Tally()
                for piece in slices(own, 0, SLICE_BYTES):
                    if learned:
                        words.add(words_of(piece.column(0), SPACED).hashes.view(np.int64))
                    for code, _ in _codes(piece.column(0), context):
                        grams.add(code)
                found = [(_GRAM, *grams.total())]
                if learned:
                    found += [(_DOCUMENT, np.zeros(1, np.int64), np.array([own.num_rows])), (_WORD, *words.total())]
                for kind, k, n in found:
                    none = np.zeros(len(k), np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int32)), pa.array(k), *map(pa.array, (n, none) if learned else (none, n))], names=["kind", "key", "n", "asked"])

    made = docs.select("text", F.coalesce("learned", F.lit(False)).alias("learned")).mapInArrow(run, "kind int, key long, n long, asked long")
    return made.groupBy("kind", "key").agg(F.sum("n").alias("n"), F.sum("asked").alias("asked"))


def _last(key: str, size: int) -> Column:
    """The last `size` bytes of an n-gram."""
    return F.col(key).bitwiseAND(F.lit((1 << 8 * size) - 1).cast("long"))


def levels_of(grams: DataFrame, context: int = CONTEXT) -> list[DataFrame]:
    """Written (key, n) for each context length from 0: counts of its n-grams from those of the longest."""
    levels = [grams]
    for k in range(context - 1, -1, -1):
        levels.append(written(levels[-1].groupBy(_last("key", k + 1).alias("key")).agg(F.sum("n").alias("n")), f"level{k}"))
    return levels[::-1]


def contexts_of(level: DataFrame, k: int) -> DataFrame:
    """(context, total, distinct, below) of a level. What a symbol counts for in the next shorter context is the sum over the (at most
    256) n-grams that differ from it in the first byte only."""
    lower = F.sum("n").over(Window.partitionBy(_last("key", k))) if k else F.lit(0).cast("long")
    rows = level.select(F.shiftright("key", 8).alias("context"), "n", lower.alias("lower"))
    return rows.groupBy("context").agg(F.sum("n").alias("total"), F.count("*").alias("distinct"), F.sum("lower").alias("below"))


def prices(grams: DataFrame, context: int = CONTEXT) -> DataFrame:
    """(key, n, logp) for every n-gram (key, n, asked): the natural logarithm of its last symbol's probability; n is n + asked.

    Tables whose size the alphabet bounds (256 ^ 2 rows) are broadcast; the others grow with the input and are merged.
    """
    levels = levels_of(grams.where("n > 0").select("key", "n"), context)
    zero = F.lit(0).cast("long")
    open_ = grams.select("key", (F.col("n") + F.col("asked")).alias("uses"), "n", F.lit(0.0).alias("logp"), zero.alias("gone_n"), zero.alias("gone_d"))
    done = []
    for k in range(context, -1, -1):
        if k < context:
            own = levels[k].withColumnRenamed("key", "gram")
            open_ = open_.withColumn("gram", _last("key", k + 1)).join(F.broadcast(own) if k < 2 else own.hint("merge"), "gram", "left").drop("gram")
        contexts = contexts_of(levels[k], k)
        found = open_.withColumn("context", F.shiftright(_last("key", k + 1), 8)).join(F.broadcast(contexts) if k < 3 else contexts.hint("merge"), "context", "left")
        total, distinct = F.greatest(F.col("total") - F.col("gone_n"), zero), F.col("distinct") - F.col("gone_d")
        space = F.greatest(total + distinct, F.lit(1))
        seen = F.coalesce("n", zero) > 0
        logp = F.col("logp") + F.when(seen, F.log(F.col("n") / space)).when(distinct > 0, F.log(distinct / space)).otherwise(0.0)
        found = written(found.select("key", "uses", seen.alias("seen"), logp.alias("logp"), F.coalesce("below", "gone_n").alias("gone_n"), F.coalesce("distinct", "gone_d").alias("gone_d")), f"priced{k}")
        done.append(found.where("seen").select("key", F.col("uses").alias("n"), "logp"))
        open_ = found.where("not seen").drop("seen")
    rest = F.col("logp") - F.log(F.greatest(F.lit(1), F.lit(SYMBOLS) - F.col("gone_d")))
    out = open_.select("key", F.col("uses").alias("n"), rest.alias("logp"))
    for x in done:
        out = out.unionByName(x)
    return out


@dataclass
class _Level:
    grams: np.ndarray
    n: np.ndarray
    contexts: np.ndarray
    total: np.ndarray
    distinct: np.ndarray
    below: np.ndarray  # what the symbols of a context count for in the next shorter one


class Trie:
    """The same prices from arrays on one machine, for tables that are small: what prices() is compared with."""

    def __init__(self, level: np.ndarray, key: np.ndarray, n: np.ndarray, context: int) -> None:
        self.context, self.levels = context, []
        for k in range(context + 1):
            g, c = key[level == k], n[level == k]
            order = np.argsort(g)
            g, c = g[order], c[order].astype(np.float64)
            contexts, at = np.unique(g >> 8, return_inverse=True)
            below = np.zeros(len(contexts))
            if k and len(g):
                lower = self.levels[-1]
                below = np.bincount(at, lower.n[np.searchsorted(lower.grams, g & ((1 << 8 * k) - 1))])
            sums = (np.bincount(at, c, len(contexts)), np.bincount(at, minlength=len(contexts)).astype(np.float64), below)
            self.levels.append(_Level(g, c, contexts, *sums))

    def price(self, codes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(codes))
        open_ = np.arange(len(codes))
        gone_n, gone_d = np.zeros(len(codes)), np.zeros(len(codes))  # excluded counts and symbols
        for k in range(self.context, -1, -1):
            level = self.levels[k]
            if not len(level.grams):
                continue
            g = codes[open_] & ((1 << 8 * (k + 1)) - 1)
            c = np.minimum(np.searchsorted(level.contexts, g >> 8), len(level.contexts) - 1)
            known = level.contexts[c] == g >> 8
            total, distinct = np.maximum(level.total[c] - gone_n[open_], 0), level.distinct[c] - gone_d[open_]
            at = np.minimum(np.searchsorted(level.grams, g), len(level.grams) - 1)
            seen = level.grams[at] == g
            space = np.maximum(total + distinct, 1)
            out[open_[seen]] += np.log(level.n[at[seen]] / space[seen])
            escape = known & ~seen & (distinct > 0)
            out[open_[escape]] += np.log(distinct[escape] / space[escape])
            now = open_[known]
            gone_n[now], gone_d[now] = level.below[c[known]], level.distinct[c[known]]
            open_ = open_[~seen]
            if not len(open_):
                return out
        out[open_] -= np.log(np.maximum(1, SYMBOLS - gone_d[open_]))
        return out


def scored(docs: DataFrame, learn: Column, context: int = CONTEXT, max_nodes: int = MAX_NODES, max_words: int = MAX_WORDS) -> DataFrame:
    """One row for each of docs (doc_id, text): learned, n_tokens, n_known, train_tokens, base_score and score (log10).

    learn marks the documents that are learned from.
    """
    every = written(counts(docs.select("text", learn.alias("learned")), context), "counts")
    words = every.where(F.col("kind") == _WORD).select("key", "n")
    priced = prices(every.where(F.col("kind") == _GRAM).select("key", "n", "asked"), context)
    n_words, n_distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    n_docs = every.where(F.col("kind") == _DOCUMENT).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    tokens, vocabulary = n_words + n_docs, n_distinct + bool(n_docs)
    frequent = bounded(words, max_words).toArrow().sort_by("key")  # max_words bounds it
    keys, n = frequent.column("key").to_numpy(), frequent.column("n").to_numpy()
    hot = bounded(priced, max_nodes).toArrow().sort_by("key")  # max_nodes bounds it
    grams, logp = hot.column("key").to_numpy(), hot.column("logp").to_numpy()
    price, end_price = np.log10(n + 0.1), float(np.log10(n_docs + 0.1))
    whole = float(np.log10(tokens + 0.1 * (vocabulary + 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in (x for every in batches for x in slices(every, 1, SLICE_BYTES)):
            size = batch.num_rows
            score, rest = np.zeros(size), []  # rest: (text, kind, key, n) of what is not broadcast
            for code, own in _codes(batch.column(1), context):
                at, unique = pd.factorize(code)
                found, value = _find(grams, logp, unique)
                score += np.bincount(own, value[at], minlength=size)
                left = ~found[at]
                pairs, times = np.unique(own[left] * len(unique) + at[left], return_counts=True)
                rest.append((pairs // max(1, len(unique)), np.full(len(pairs), _GRAM, np.int32), unique[pairs % max(1, len(unique))], times))
            w = words_of(batch.column(1), SPACED)
            h, own = w.hashes.view(np.int64), w.owner
            found, value = _find(keys, price, h)
            base, known = np.bincount(own, value, minlength=size), np.bincount(own[found], minlength=size)
            rest.append((own[~found], np.full((~found).sum(), _WORD, np.int32), h[~found], np.ones((~found).sum(), np.int64)))
            of, *values = (np.concatenate(x) for x in zip(*rest, strict=True))
            order = np.argsort(of, kind="stable")
            bounds = np.searchsorted(of[order], np.arange(size + 1)).astype(np.int32)
            rest = pa.ListArray.from_arrays(pa.array(bounds), pa.StructArray.from_arrays([pa.array(x[order]) for x in values], names=["kind", "key", "times"]))
            columns = [np.arange(row, row + size), w.counts + 1, known + (n_docs > 0), base + end_price - whole * (w.counts + 1), score / LOG10]
            row += size
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *map(pa.array, columns), rest], names=["doc_id", "learned", "row", "n_tokens", "known", "base", "score", "rest"])

    schema = "doc_id long, learned boolean, row long, n_tokens long, known long, base double, score double, rest array<struct<kind: int, key: long, times: long>>"
    first = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", learn.alias("learned")).mapInArrow(run, schema), "first")
    table = words.select(F.lit(_WORD).alias("kind"), "key", F.log10(F.col("n") + F.lit(0.1).cast("double")).alias("value")).unionByName(priced.select(F.lit(_GRAM).alias("kind"), "key", (F.col("logp") / LOG10).alias("value")))
    rare = first.select("row", F.inline("rest")).join(table.hint("merge"), ["kind", "key"], "left")
    word = F.col("kind") == _WORD
    rare = rare.groupBy("row").agg(F.sum(F.when(word, F.coalesce("value", F.log10(F.lit(0.1).cast("double"))))).alias("more"), F.count(F.when(word, F.col("value"))).alias("more_known"), F.sum(F.when(~word, F.col("value") * F.col("times"))).alias("more_score"))
    out = first.drop("rest").join(rare.hint("merge"), "row", "left")
    n_known, base = F.col("known") + F.coalesce("more_known", F.lit(0)), F.col("base") + F.coalesce("more", F.lit(0.0))
    score = F.col("score") + F.coalesce("more_score", F.lit(0.0))
    return out.select("doc_id", "learned", "n_tokens", n_known.alias("n_known"), F.lit(int(tokens)).cast("long").alias("train_tokens"), base.alias("base_score"), score.alias("score"))


def _find(keys: np.ndarray, values: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether each is among the sorted keys, its value or 0)."""
    if not len(keys):
        return np.zeros(len(asked), bool), np.zeros(len(asked))
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    found = keys[at] == asked
    return found, np.where(found, values[at], 0.0)


def report(docs: DataFrame, folds: int = 10, **more) -> DataFrame:
    """Scores of all documents, learned from those whose crc32(doc_id as text) is not divisible by folds."""
    held_out = crc_mod("doc_id", folds) == 0
    out = scored(docs.select("doc_id", "text"), ~held_out, **more)
    return out.select("doc_id", (~F.col("learned")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
