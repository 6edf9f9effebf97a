"""Benchmark decontamination (7): a broadcast hash set of normalised test n-grams, scanned over training token windows.

Words are runs of ASCII letters, digits and non-ASCII characters, with A-Z lower-cased. A window is n consecutive words of an
item; an item of fewer words, but not none, is one window. Every hash hit is verified against the window's own words.

Defined results: a null or wordless text has no words and no hits; a null or wordless item has no windows; equal items all count;
items without an id contaminate as others do: together they are one item, null, which n_items counts and items_sha256 leaves out (as in SQL);
repeated documents are judged alike; an empty benchmark leaves every document clean; a column of the documents whose name equals
an output's is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, packed, unpacked, written
from .words import ALPHANUMERIC, Words, grams, words_of

WINDOW = 10
#: Windows that are broadcast at a time; a larger benchmark is scanned in several blocks, which are then united.
MAX_WINDOWS = 250_000

_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
FIELDS = [T.StructField("n_words", T.LongType()), T.StructField("hit_words", T.ArrayType(T.LongType())), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("hit_spans", _SPANS)]


def _text(w: Words, first: int, n: int) -> bytes:
    return b" ".join(w.data[a:b].tobytes().lower() for a, b in zip(w.starts[first : first + n], w.ends[first : first + n], strict=True))


def benchmark_windows(benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """(hash, length, words, item_id): the distinct windows of every item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = words_of(batch.column(1), ALPHANUMERIC)
            ids, rows = batch.column(0).to_pylist(), []
            for k in sorted({min(n, int(c)) for c in w.counts if c}):
                first, h = grams(w, k)
                owner = w.owner[first]
                keep = (w.counts[owner] >= n) if k == n else w.counts[owner] == k
                rows += [(int(x), k, _text(w, int(i), k), ids[o]) for i, x, o in zip(first[keep], h[keep].view(np.int64), owner[keep], strict=True)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.binary(), pa.string()), strict=True)], names=["hash", "length", "words", "item_id"])

    return benchmark.select(F.col("item_id").cast("string"), "text").mapInArrow(run, "hash long, length int, words binary, item_id string").distinct()


class _Scan:
    """What a task needs to find one block of windows: these, as Arrow columns in the order of length and hash."""

    def __init__(self, windows: pa.Table) -> None:
        windows = windows.sort_by([("length", "ascending"), ("hash", "ascending")]).combine_chunks()
        self.words, self.items = (windows.column(c).combine_chunks() for c in ("words", "item_id"))
        length, hashes = (windows.column(c).to_numpy() for c in ("length", "hash"))
        self.of = []  # (length, its first window, its hashes)
        for k in np.unique(length).tolist():
            a, b = np.searchsorted(length, k), np.searchsorted(length, k, "right")
            self.of.append((k, int(a), hashes[a:b]))

    def __call__(self, texts: pa.Array) -> list[pa.Array]:
        w = words_of(texts, ALPHANUMERIC)
        hit, items = np.zeros(len(w.hashes), bool), [set() for _ in range(len(texts))]
        for k, start, known in self.of:
            first, h = grams(w, k)
            h = h.view(np.int64)
            low = np.searchsorted(known, h)
            found = np.flatnonzero(known[np.minimum(low, len(known) - 1)] == h)
            last = np.searchsorted(known, h[found], "right")
            owner = np.searchsorted(w.doc, first[found], "right") - 1
            for i, o, a, b in zip(first[found].tolist(), owner.tolist(), low[found].tolist(), last.tolist(), strict=True):
                text = _text(w, i, k)
                names = {self.items[j].as_py() for j in range(start + a, start + b) if self.words[j].as_py() == text}
                if names:
                    hit[i : i + k] = True
                    items[o].update(names)
        counts, bounds, spans = w.counts, w.doc, []
        words = [(np.flatnonzero(hit[a:b])).tolist() if items[i] else [] for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True))]
        for i, inside in enumerate(words):
            own: list[dict] = []
            for j in inside:
                a, b = (int(x) + int(bounds[i]) for x in (j, j))
                start, end = int(w.starts[a]), int(w.ends[b])
                if own and own[-1]["word"] == j - 1:
                    own[-1] |= {"end": end, "word": j}
                else:
                    own.append({"start": start, "end": end, "word": j})
            base = int(w.text_at[i])
            chars = lambda x, base=base: len(w.data[base:x].tobytes().decode("utf-8", "replace"))
            spans.append([{"start": chars(x["start"]), "end": chars(x["end"])} for x in own])
        arrow = [pa.array(counts, pa.int64()), pa.array(words, pa.list_(pa.int64())), pa.array([sorted(x, key=lambda i: (i is None, i or "")) for x in items], pa.list_(pa.string()))]
        return [*arrow, pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]


def annotate(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """docs with n_words, hit_words (positions), items (ids whose windows occur) and hit_spans (code points, end exclusive).

    At most max_windows windows are broadcast at a time. A larger benchmark is read in blocks of its windows' hashes, and each
    block's findings are added to the same documents.
    """
    windows = written(benchmark_windows(benchmark, n), "windows")
    blocks = -(-windows.count() // max_windows) or 1
    out = docs
    for block in range(blocks):
        # the number of rows is known to be about max_windows at most
        part = windows.where(F.pmod(F.xxhash64("hash"), F.lit(blocks)) == block) if blocks > 1 else windows
        scan = _Scan(part.toArrow())
        found = append_columns(out, "text", FIELDS, scan) if block == 0 else _united(out, scan)
        out = found
    return out


def _united(out: DataFrame, scan: _Scan) -> DataFrame:
    """out, already annotated by other blocks, with what scan finds besides."""
    kept = out.withColumnsRenamed({f.name: f"_before_{f.name}" for f in FIELDS})
    found = append_columns(kept, "text", FIELDS, scan)
    both = lambda name: F.array_sort(F.array_union(F.col(f"_before_{name}"), F.col(name)))
    return found.withColumns({x: both(x) for x in ("hit_words", "items", "hit_spans")}).drop(*[f"_before_{f.name}" for f in FIELDS])


def clean_documents(docs: DataFrame, benchmark: DataFrame, mode: str = "documents", **more) -> DataFrame:
    """docs without contamination: mode "documents" drops those with a hit, "spans" cuts the hit spans from the text.

    Other columns stay as they are, whatever their names.
    """
    found = annotate(packed(docs, "text"), benchmark, **more)
    if mode == "documents":
        return found.where(F.size("hit_words") == 0).select(*unpacked(docs.columns, ("text",)))
    spans = F.array_sort("hit_spans")
    cut = F.aggregate(spans, F.struct(F.lit("").alias("text"), F.lit(0).cast("long").alias("at")), lambda a, s: F.struct(F.concat(a["text"], F.col("text").substr(a["at"] + 1, F.greatest(s["start"] - a["at"], F.lit(0)))).alias("text"), F.greatest(s["end"], a["at"]).alias("at")))
    rest = F.concat(F.col("_cut.text"), F.expr("substring(text, cast(_cut.at as int) + 1)"))
    text = F.when(F.size("hit_words") == 0, F.col("text")).otherwise(rest)
    return found.withColumn("_cut", cut).select(*unpacked(docs.columns, ("text",), text=text))


def report(docs: DataFrame, benchmark: DataFrame, **more) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = annotate(docs.select("doc_id", "text"), benchmark, **more)
    n_hit = F.size("hit_words").cast("long")
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))

