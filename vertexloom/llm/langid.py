"""Language identification (2): interpolated Kneser-Ney character models, one for each language, in sorted hash arrays.

Symbols are lower-cased letters; every run of other characters is one blank. Counts of the highest order come from all training
documents by one Spark aggregation; the lower orders of Kneser-Ney are counts of distinct left neighbours, which follow from them. A
text goes to the language of least cross-entropy per symbol. Texts whose cross-entropy is far above what held-back training documents
of that language have are rejected.

Models of up to MAX_GRAMS n-grams are broadcast whole. Larger ones are tables with every n-gram, discount and continuation count: the
distinct n-grams of the texts are priced by joins order by order, prices of the most frequent ones are broadcast and the others joined.

Defined results: a null text, or one without letters, is `und` with score 0 and rejected; without any labelled training text all
are; ties go to the language that sorts first; columns of the documents whose names equal an output's are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, crc_mod, packed, unpacked, written
from .words import mix, slices, text_bytes

ORDER = 4
#: Most n-grams of the highest order, of all languages together, that are collected and broadcast. None is lost above it.
MAX_GRAMS = 1_000_000
#: A text of at least MIN_LETTERS letters is rejected when its cross-entropy is above SLACK times this quantile of the calibration
#: texts of its language.
QUANTILE, SLACK, MIN_LETTERS = 0.999, 1.4, 20
_STEP = 1 << 20
_P = np.uint64(0xC2B2AE3D27D4EB4F)
BLANK = 32

FIELDS = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("cross_entropy", T.DoubleType()), T.StructField("rejected", T.BooleanType())]


@cache
def _symbols() -> np.ndarray:
    """The symbol of each code point."""
    return np.array([ord(chr(c).lower()[0]) if chr(c).isalpha() else BLANK for c in range(0x110000)], np.uint32)


def symbol_runs(texts: pa.Array, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, start of each text in them, letters of each text): each text after order - 1 blanks and before one."""
    data, at = text_bytes(texts)
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[at]
    s = _symbols()[np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)]
    if len(s) != chars[-1]:
        raise ValueError("a text is not UTF-8")
    letter = s != BLANK
    first = np.zeros(len(s), bool)
    first[chars[:-1][chars[:-1] < len(s)]] = True
    keep = letter.copy()
    keep[1:] |= letter[:-1] & ~first[1:]
    owner = np.repeat(np.arange(len(texts)), np.diff(chars))[keep]
    starts = np.searchsorted(owner, np.arange(len(texts) + 1)) + order * np.arange(len(texts) + 1)
    out = np.full(starts[-1], BLANK, np.uint32)
    out[np.arange(len(owner)) + order * owner + order - 1] = s[keep]
    return out, starts, np.bincount(owner[s[keep] != BLANK], minlength=len(texts))


def _hashes(symbols: np.ndarray, n: int) -> np.ndarray:
    """The hash of each n consecutive symbols."""
    h = np.zeros(max(0, len(symbols) - n + 1), np.uint64)
    for k in range(n):
        h = h * _P + (symbols[k : k + len(h)] + np.uint32(1))
    return mix(h)


def _pieces(symbols: np.ndarray, starts: np.ndarray, order: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first position, n-gram hashes, text that each is of or -1) for bounded runs of positions."""
    for a in range(0, max(0, len(symbols) - order + 1), _STEP):
        at = np.arange(a, min(a + _STEP, len(symbols) - order + 1))
        own = np.searchsorted(starts, at, "right") - 1
        yield a, _hashes(symbols[a : at[-1] + order], order), np.where(at + order <= starts[own + 1], own, -1)


def gram_counts(docs: DataFrame, label: Column, order: int = ORDER) -> DataFrame:
    """(lang, gram, n) over all of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, of = np.unique(np.array(batch.column(0).to_pylist(), object).astype(str), return_inverse=True) if batch.num_rows else ([], [])
            # what each slice has counted: keys, grams, languages, counts
            parts, row = [], 0
            for piece in slices(batch, 1):
                symbols, starts, _ = symbol_runs(piece.column(1), order)
                for a, h, own in _pieces(symbols, starts, order):
                    here = np.flatnonzero(own >= 0)
                    lang = of[row + own[here]]
                    codes, unique = pd.factorize(mix(h[here] + lang.astype(np.uint64) * _P))
                    seen = np.empty(len(unique), np.int64)
                    seen[codes[::-1]] = np.arange(len(codes))[::-1]
                    parts.append((unique, symbols[(a + here[seen])[:, None] + np.arange(order)], lang[seen], np.bincount(codes, minlength=len(unique))))
                row += piece.num_rows
            if parts:
                keys, grams, lang, n = (np.concatenate(x) for x in zip(*parts, strict=True))
                codes, unique = pd.factorize(keys)
                seen = np.empty(len(unique), np.int64)
                seen[codes[::-1]] = np.arange(len(codes))[::-1]
                text = np.ascontiguousarray(grams[seen]).view(f"<U{order}").ravel()
                yield pa.RecordBatch.from_arrays([pa.array(names[lang[seen]].tolist(), pa.string()), pa.array(text.tolist(), pa.string()), pa.array(np.bincount(codes, n).astype(np.int64))], names=["lang", "gram", "n"])

    return docs.select(label.cast("string").alias("lang"), "text").where("lang is not null").mapInArrow(run, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def bounded(counts: DataFrame, most: int) -> DataFrame:
    """The rows of the highest n, about `most` of them: n is cut at a power of 2^(1/8), and if the highest step alone has
    more rows, a part of these is chosen by a hash of the row."""
    level = F.floor(8 * F.log2("n"))
    rows = sorted(counts.groupBy(level.alias("level")).count().collect(), reverse=True)
    total, cut = 0, None
    for at, n in rows:
        total += n
        if total > most and cut is not None:
            break
        cut = at
    if cut is None:
        return counts
    kept = counts.where(level >= cut)
    return kept if rows[0][1] <= most else kept.where(F.pmod(F.xxhash64(*counts.columns), F.lit(rows[0][1])) < most)


@dataclass
class _Level:
    """Sorted hashes of the n-grams of one order with their log probabilities, and of contexts with log back-off weights."""

    grams: np.ndarray
    logp: np.ndarray
    contexts: np.ndarray
    backoff: np.ndarray


def _sorted(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    return keys[order], values[order].astype(np.float32)


def kneser_ney(grams: np.ndarray, n: np.ndarray, alphabet: int) -> list[_Level]:
    """Levels from order 1 to the highest. grams: a row of symbols for each, n: how often it occurs."""
    order, levels, below = grams.shape[1], [], None
    tables = [(grams, n.astype(np.float64))]
    for _ in range(order - 1):
        g = tables[-1][0][:, 1:]
        unique, codes = np.unique(g, axis=0, return_inverse=True)
        tables.append((unique, np.bincount(codes.ravel()).astype(np.float64)))  # distinct left neighbours
    for g, c in reversed(tables):
        k = g.shape[1]
        n1, n2 = (c == 1).sum(), (c == 2).sum()
        discount = float(np.clip(n1 / max(1, n1 + 2 * n2), 0.1, 0.9))
        ctx, codes = np.unique(g[:, :-1], axis=0, return_inverse=True) if k > 1 else (np.zeros((1, 0), g.dtype), np.zeros(len(g), np.int64))
        codes = codes.ravel()
        total = np.bincount(codes, c)
        weight = discount * np.bincount(codes) / total
        lower = np.full(len(g), 1 / alphabet) if below is None else np.exp(_lookup(levels, np.ascontiguousarray(g[:, 1:]), alphabet))
        p = (c - discount) / total[codes] + weight[codes] * lower
        levels.append(_Level(*_sorted(_row_hashes(g), np.log(p)), *_sorted(_row_hashes(ctx), np.log(weight))))
        below = g
    return levels


def _row_hashes(rows: np.ndarray) -> np.ndarray:
    h = np.zeros(len(rows), np.uint64)
    for k in range(rows.shape[1]):
        h = h * _P + (rows[:, k].astype(np.uint64) + np.uint64(1))
    return mix(h)


def _find(keys: np.ndarray, values: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return keys[at] == asked, values[at]


def _lookup(levels: list[_Level], rows: np.ndarray, alphabet: int) -> np.ndarray:
    """Log probabilities of the last symbol of each row after the others."""
    out, open_ = np.zeros(len(rows)), np.arange(len(rows))
    for k in range(rows.shape[1], 0, -1):
        level, r = levels[k - 1], rows[open_, rows.shape[1] - k :]
        found, logp = _find(level.grams, level.logp, _row_hashes(r))
        out[open_[found]] += logp[found]
        open_, r = open_[~found], r[~found]
        if not len(open_):
            return out
        known, weight = _find(level.contexts, level.backoff, _row_hashes(r[:, :-1]))
        out[open_[known]] += weight[known]
    out[open_] -= math.log(alphabet)
    return out


@dataclass
class LanguageModel:
    """Names, levels for each, and what calibration found."""

    names: list[str]
    levels: list[list[_Level]]
    alphabet: int
    order: int
    sharpness: float = 8.0
    limits: dict[str, float] = field(default_factory=dict)

    def entropies(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(nats a symbol of each text under each language, letters of each text)."""
        symbols, starts, letters = symbol_runs(texts, self.order)
        total = np.zeros((len(texts), len(self.names)))
        for a, h, own in _pieces(symbols, starts, self.order):
            here = np.flatnonzero(own >= 0)
            codes, unique = pd.factorize(h[here])
            seen = np.empty(len(unique), np.int64)
            seen[codes[::-1]] = here[::-1]
            rows = symbols[(a + seen)[:, None] + np.arange(self.order)]
            for i, levels in enumerate(self.levels):
                total[:, i] -= np.bincount(own[here], _lookup(levels, rows, self.alphabet)[codes], minlength=len(texts))
        return total / np.maximum(1, np.diff(starts) - self.order + 1)[:, None], letters

    def __call__(self, texts: pa.Array) -> list[pa.Array]:
        e, letters = self.entropies(texts)
        if not self.names:
            none = [None] * len(texts)
            return [pa.array(["und"] * len(texts)), pa.array([0.0] * len(texts)), pa.array(none, pa.float64()), pa.array([True] * len(texts))]
        best = e.argmin(axis=1)
        least = e[np.arange(len(e)), best]
        score = 1 / np.exp(-self.sharpness * (e - least[:, None])).sum(axis=1)
        bad = (letters == 0) | (letters >= MIN_LETTERS) & (least > np.array([self.limits.get(x, math.inf) for x in self.names])[best])
        named = np.where(letters > 0, np.array(self.names, object)[best], "und")
        return [pa.array(named.tolist(), pa.string()), pa.array(np.where(letters > 0, score, 0.0)), pa.array(least, mask=letters == 0), pa.array(bad)]


def _strings(grams: list[str], order: int) -> np.ndarray:
    """A row of symbols for each."""
    return np.ascontiguousarray(np.array(grams, f"<U{order}").view(np.uint32).reshape(-1, order)) if grams else np.zeros((0, order), np.uint32)


class JoinedModel:
    """The same models as tables: (lang, gram, logp) and (lang, context, backoff) for each order, of any size."""

    def __init__(self, counts: DataFrame, order: int, max_grams: int) -> None:
        self.order, self.max_grams, self.sharpness, self.limits = order, max_grams, 8.0, {}
        self.names = sorted(r[0] for r in counts.select("lang").distinct().collect())
        self.alphabet = counts.select(F.explode(F.split("gram", "")).alias("c")).where("c <> ''").distinct().count() + 1
        tables = [counts.select("lang", "gram", F.col("n").alias("c"))]
        for k in range(order - 1, 0, -1):
            tables.append(written(tables[-1].groupBy("lang", F.substring("gram", 2, k).alias("gram")).agg(F.count("*").alias("c")), f"order{k}"))  # distinct left neighbours
        self.levels: list[tuple[DataFrame, DataFrame]] = []
        for k, t in enumerate(reversed(tables), 1):
            ones = {r["lang"]: (r["n1"], r["n2"]) for r in t.groupBy("lang").agg(F.count_if(F.col("c") == 1).alias("n1"), F.count_if(F.col("c") == 2).alias("n2")).collect()}
            discounts = [(x, float(np.clip(n1 / max(1, n1 + 2 * n2), 0.1, 0.9))) for x, (n1, n2) in ones.items()]
            t = t.join(F.broadcast(counts.sparkSession.createDataFrame(discounts, "lang string, d double")), "lang").withColumn("context", F.substring("gram", 1, k - 1))
            contexts = t.groupBy("lang", "context").agg(F.sum("c").alias("total"), (F.first("d") * F.count("*") / F.sum("c")).alias("weight"))
            contexts = written(contexts, f"contexts{k}")
            t = t.join(F.broadcast(contexts) if k == 1 else contexts.hint("merge"), ["lang", "context"])
            if k == 1:
                t = t.withColumn("lower", F.lit(1 / self.alphabet))
            else:
                below = self.levels[-1][0].select("lang", F.col("gram").alias("suffix"), F.exp("logp").alias("lower"))
                t = t.withColumn("suffix", F.substring("gram", 2, k - 1)).join(below.hint("merge"), ["lang", "suffix"])
            logp = F.log((F.col("c") - F.col("d")) / F.col("total") + F.col("weight") * F.col("lower"))
            self.levels.append((written(t.select("lang", "gram", logp.alias("logp")), f"grams{k}"), contexts.select("lang", "context", F.log("weight").alias("backoff"))))

    def prices(self, asked: DataFrame) -> DataFrame:
        """(gram, n, e) for asked (gram, n): e the log probabilities under each language, in the order of names."""
        names = F.explode(F.array(*[F.lit(x) for x in self.names]))
        open_, done = asked.select("gram", "n", names.alias("lang")).withColumn("out", F.lit(0.0)), []
        for k in range(self.order, 0, -1):
            grams, contexts = self.levels[k - 1]
            last = F.substring("gram", self.order - k + 1, k)
            own = grams.select("lang", F.col("gram").alias("g"), "logp")
            open_ = open_.withColumn("g", last).withColumn("context", F.substring(last, 1, k - 1))
            found = open_.join(own.hint("merge"), ["lang", "g"], "left").join(F.broadcast(contexts) if k == 1 else contexts.hint("merge"), ["lang", "context"], "left")
            value = F.col("out") + F.coalesce("logp", "backoff", F.lit(0.0))
            found = written(found.select("gram", "n", "lang", value.alias("out"), F.col("logp").isNotNull().alias("found")), f"priced{k}")
            done.append(found.where("found").drop("found"))
            open_ = found.where("not found").drop("found")
        out = open_.withColumn("out", F.col("out") - math.log(self.alphabet))
        for x in done:
            out = out.unionByName(x)
        e = F.transform(F.array_sort(F.collect_list(F.struct("lang", "out"))), lambda x: x["out"])
        return written(out.groupBy("gram", "n").agg(e.alias("e")), "prices")

    def entropies(self, docs: DataFrame) -> DataFrame:
        """docs (with text) and _e (nats a symbol under each language) and _letters."""
        order, size = self.order, len(self.names)
        kept = written(docs.withColumn("_number", F.monotonically_increasing_id()), "numbered")
        asked = gram_counts(kept, F.lit(""), order).groupBy("gram").agg(F.sum("n").alias("n"))
        priced = self.prices(written(asked, "asked"))
        hot = bounded(priced.select("gram", "n", "e"), self.max_grams).toArrow()  # max_grams bounds it
        h = _row_hashes(_strings(hot["gram"].to_pylist(), order))
        by = np.argsort(h)
        h, value = h[by], np.array(hot["e"].to_pylist(), float).reshape(-1, size)[by]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for piece in (x for batch in batches for x in slices(batch, 1)):
                symbols, starts, letters = symbol_runs(piece.column(1), order)
                total, rest = np.zeros((piece.num_rows, size)), [[] for _ in range(piece.num_rows)]
                for a, g, own in _pieces(symbols, starts, order):
                    here = np.flatnonzero(own >= 0)
                    found, at = _find(h, np.arange(len(h)), g[here]) if len(h) else (np.zeros(len(here), bool), np.zeros(len(here), np.int64))
                    for i in range(size):
                        total[:, i] += np.bincount(own[here[found]], value[at[found], i], minlength=piece.num_rows)
                    left = here[~found]
                    text = np.ascontiguousarray(symbols[(a + left)[:, None] + np.arange(order)]).view(f"<U{order}").ravel()
                    for o, x in zip(own[left].tolist(), text.tolist(), strict=True):
                        rest[o].append(x)
                n = np.maximum(1, np.diff(starts) - order + 1)
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(total.tolist(), pa.list_(pa.float64())), pa.array(n), pa.array(letters), pa.array(rest, pa.list_(pa.string()))], names=["_number", "_sum", "_n", "_letters", "_rest"])

        first = written(kept.select("_number", "text").mapInArrow(run, "_number long, _sum array<double>, _n long, _letters long, _rest array<string>"), "first")
        more = first.select("_number", F.explode("_rest").alias("gram")).join(priced.select("gram", "e").hint("merge"), "gram").groupBy("_number").agg(F.array(*[F.sum(F.col("e")[i]) for i in range(size)]).alias("_more"))
        e = F.transform("_sum", lambda x, i: -(x + F.coalesce(F.get("_more", i), F.lit(0.0))) / F.col("_n"))
        out = first.join(more.hint("merge"), "_number", "left").select("_number", e.alias("_e"), "_letters")
        return kept.join(out.hint("merge"), "_number").drop("_number")

    def identified(self, docs: DataFrame) -> DataFrame:
        names = F.array(*[F.lit(x) for x in self.names])
        limits = F.array(*[F.lit(float(self.limits.get(x, math.inf))) for x in self.names])
        docs = docs.drop(*[f.name for f in FIELDS])
        out = self.entropies(packed(docs, "text")).withColumn("_least", F.array_min("_e"))
        best, some = F.array_position("_e", F.col("_least")).cast("int"), F.col("_letters") > 0
        score = 1 / F.aggregate("_e", F.lit(0.0), lambda a, x: a + F.exp(-self.sharpness * (x - F.col("_least"))))
        bad = ~some | (F.col("_letters") >= MIN_LETTERS) & (F.col("_least") > F.element_at(limits, best))
        made = [F.when(some, F.element_at(names, best)).otherwise("und").alias("lang_pred"), F.when(some, score).otherwise(0.0).alias("score"), F.when(some, F.col("_least")).alias("cross_entropy"), bad.alias("rejected")]
        return out.select(*unpacked(docs.columns, ("text",)), *made)


def fit(docs: DataFrame, label: str = "lang", order: int = ORDER, max_grams: int = MAX_GRAMS, held_back: Column | None = None) -> LanguageModel | JoinedModel:
    """Models of every label. held_back marks the documents that calibrate rejection and score; the others are counted."""
    held_back = crc_mod("doc_id", 5) == 1 if held_back is None else held_back
    counts = written(gram_counts(docs.where(~held_back), F.col(label), order), "grams")
    if counts.count() > max_grams:
        model = JoinedModel(counts, order, max_grams)
        labelled = docs.where(held_back).select(F.col(label).cast("string").alias("lang"), "text").where("lang is not null")
        return _calibrated(model, model.entropies(labelled).where("_letters > 0").select("lang", F.col("_e").alias("e")))
    rows = counts.toArrow()  # max_grams bounds it
    grams = _strings(rows["gram"].to_pylist(), order)
    n, of = rows["n"].to_numpy(), np.array(rows["lang"].to_pylist(), object)
    names = sorted(set(of))
    alphabet = len(np.unique(grams)) + 1
    model = LanguageModel(names, [kneser_ney(np.ascontiguousarray(grams[of == x]), n[of == x], alphabet) for x in names], alphabet, order)
    return _calibrated(model, _entropies(model, docs.where(held_back), label)) if names else model


def _entropies(model: LanguageModel, docs: DataFrame, label: str) -> DataFrame:
    """(lang, e) of labelled docs that have letters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in (x for batch in batches for x in slices(batch, 1)):
            e, letters = model.entropies(piece.column(1))
            rows = np.flatnonzero(letters > 0)
            yield pa.RecordBatch.from_arrays([piece.column(0).take(pa.array(rows)), pa.array(e[rows].tolist(), pa.list_(pa.float64()))], names=["lang", "e"])

    return docs.select(F.col(label).cast("string").alias("lang"), "text").where("lang is not null").mapInArrow(run, "lang string, e array<double>")


def _calibrated(model: LanguageModel | JoinedModel, scored: DataFrame) -> LanguageModel | JoinedModel:
    """model with the sharpness of best likelihood, and each language's highest cross-entropy, on labelled docs."""
    at = F.array_position(F.array(*[F.lit(x) for x in model.names]), F.col("lang")).cast("int")
    scored = scored.where(at > 0)
    own, least = F.element_at("e", at), F.array_min("e")

    def likelihood(b: int) -> Column:
        return F.avg(-b * (own - least) - F.log(F.aggregate("e", F.lit(0.0), lambda a, x: a + F.exp(-b * (x - least)))))

    sums = {b: likelihood(b) for b in (1, 2, 4, 8, 16, 32, 64)}
    rows = scored.groupBy("lang").agg(F.count("*").alias("n"), F.percentile_approx(own, QUANTILE, 10_000).alias("q"), *[x.alias(str(b)) for b, x in sums.items()]).collect()
    if rows:
        total = sum(r["n"] for r in rows)
        model.sharpness = float(max(sums, key=lambda b: sum(r[str(b)] * r["n"] for r in rows) / total))
        model.limits = {r["lang"]: SLACK * r["q"] for r in rows}
    return model


def identified(docs: DataFrame, model: LanguageModel | JoinedModel) -> DataFrame:
    """docs with lang_pred, score, cross_entropy and rejected."""
    return model.identified(docs) if isinstance(model, JoinedModel) else append_columns(docs, "text", FIELDS, model)


def report(docs: DataFrame, folds: int = 5, **more) -> DataFrame:
    """One row per document; learned from those whose crc32(doc_id as text) is not divisible by folds."""
    rest = crc_mod("doc_id", folds)
    model = fit(docs.select("doc_id", "text", "lang").where(rest != 0), held_back=rest == 1, **more)
    out = identified(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (rest == 0).alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")
