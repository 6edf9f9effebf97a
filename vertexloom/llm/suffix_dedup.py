"""Passages that repeat across documents (4), by sparse suffix arrays.

A text is a sequence of words. Suffixes are kept only where a minimiser stands: of each window of WINDOW consecutive SEED-word grams, the
position with the smallest hash. Two texts that share WINDOW + SEED - 1 words share a minimiser in them, so that every passage of MIN_WORDS
words has one. Suffixes whose seed stands in one text only are dropped. The others are sorted by seed and by what follows, over ranges,
each with the REACH words before and after it. In that order the nearest suffixes of another text, on either side, are compared with
each one, and the match is extended to the right and to the left. The same is done in the order of what stands before. Matches of
at least MIN_WORDS words are spans; the spans of a document are united. A long passage has many minimisers, whose spans meet.

The nearest in the first order tells how far any match of a suffix reaches to the right, the nearest in the second how far one reaches
to the left. Where one of the matches found reaches both, no other text adds to it. Where none does, a text that is nearest in neither
order may share more on both sides together. For seeds with such a suffix the windows of MIN_WORDS words around their suffixes are
grouped by hash; those that stand in two texts are spans too.

A range that ends does not end the order: runs of one text at the edges of ranges are compared with the nearest other texts beyond them,
of which each range names two at either end.

Which seeds repeat is first counted for all suffixes. A bitmap of fixed size, by hash of the seed, keeps most others from being sorted;
it lets some through, which then match nothing. Words are compared by 32 bits of their hashes, windows by 64.

Defined results: null and short texts have no spans; a passage that repeats within one row only is none; copies of a text, also
rows that repeat a doc_id, are documents that share passages; a row without doc_id is reported as such; documents without spans have
no row in the report; columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BITS, bitmap, has, packed, unpacked, written
from .words import SPACED, Words, grams, mix, slices, words_of

MIN_WORDS = 50
SEED, WINDOW = 10, 32
#: Words before and after a suffix that travel with it, and bytes of a word's hash.
REACH, BYTES = 50, 4

_ROW = "seed long, row long, doc_id long, at int, n_left int, n_right int, left binary, right binary"
_OUT = "kind int, part int, row long, doc_id long, seed long, at int, n_left int, n_right int, left binary, right binary, most int, other int"
_MATCH, _FIRST, _LAST, _HEAD, _TAIL = range(5)


def minimisers(w: Words, seed: int = SEED, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of the grams that are the smallest of a window of their text; a shorter text is one window."""
    first, h = grams(w, seed)
    if not len(first):
        return first, h
    owner = np.searchsorted(w.doc, first, "right") - 1
    ends = np.searchsorted(owner, owner, "right")  # where each gram's text ends
    # smallest of the grams i .. i + size - 1, doubled until the window is full; a window ends with its text
    at, size = np.arange(len(h)), 1
    while size < window:
        step = min(size, window - size)
        other = np.minimum(np.arange(len(h)) + step, ends - 1)
        at = np.where(h[at[other]] < h[at], at[other], at)
        size += step
    begin = np.searchsorted(owner, owner)
    full = np.arange(len(h)) + window <= ends
    keep = np.unique(at[full | (np.arange(len(h)) == begin)])
    return first[keep], h[keep]


def _numbered(docs: DataFrame) -> DataFrame:
    """(row, text, doc_id): each row of docs with a number, its own _row if it has one."""
    row = F.col("_row") if "_row" in docs.columns else F.monotonically_increasing_id()
    return docs.select(row.alias("row"), "text", F.col("doc_id").cast("long").alias("doc_id"))


def _seeds(docs: DataFrame) -> DataFrame:
    """(seed, row): the minimisers of each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for every in batches for x in slices(every, 1)):
            w = words_of(batch.column(1), SPACED, lower=False)
            first, h = minimisers(w)
            owner = np.searchsorted(w.doc, first, "right") - 1
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), batch.column(0).take(pa.array(owner))], names=["seed", "row"])

    return _numbered(docs).select("row", "text").mapInArrow(run, "seed long, row long")


def repeated_bits(docs: DataFrame, bits: int = BITS) -> np.ndarray:
    """For each hash value of a seed: whether a seed of it stands in two rows of docs."""
    twice = _seeds(docs).groupBy("seed").agg(F.min("row").alias("a"), F.max("row").alias("b")).where("a < b")
    return bitmap(twice, "seed", bits)


def _suffixes(docs: DataFrame, bits: np.ndarray) -> DataFrame:
    """Every suffix at a minimiser that may repeat, with the hashes of the words around it, nearest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = np.arange(REACH)
        for batch in (x for every in batches for x in slices(every, 1, 1 << 20)):
            w = words_of(batch.column(1), SPACED, lower=False)
            first, h = minimisers(w)
            keep = has(bits, h)
            first, h = first[keep], h[keep]
            owner = np.searchsorted(w.doc, first, "right") - 1
            a, b = w.doc[owner], w.doc[owner + 1]
            n_left, n_right = np.minimum(first - a, REACH), np.minimum(b - first, REACH)
            small = (w.hashes >> np.uint64(8 * (8 - BYTES))).astype(">u4").view(np.uint8).reshape(-1, BYTES)

            def around(at: np.ndarray, inside: np.ndarray, small: np.ndarray = small) -> pa.Array:
                x = small[np.clip(at, 0, max(0, len(small) - 1))].copy() if len(at) else np.zeros((0, REACH, BYTES), np.uint8)
                x[~inside] = 0
                return pa.FixedSizeBinaryArray.from_buffers(pa.binary(REACH * BYTES), len(at), [None, pa.py_buffer(x.tobytes())]).cast(pa.binary())

            left = around(first[:, None] - 1 - steps, steps < n_left[:, None])
            right = around(first[:, None] + steps, steps < n_right[:, None])
            own = pa.array(owner)
            columns = [pa.array(h.view(np.int64)), batch.column(0).take(own), batch.column(2).take(own), *(pa.array(x.astype(np.int32)) for x in (first - a, n_left, n_right)), left, right]
            yield pa.RecordBatch.from_arrays(columns, names=["seed", "row", "doc_id", "at", "n_left", "n_right", "left", "right"])

    return _numbered(docs).mapInArrow(run, _ROW)


def _matrix(table: pa.Table, column: str) -> np.ndarray:
    x = table.column(column).combine_chunks()
    offsets = np.frombuffer(x.buffers()[1], np.int32)[x.offset : x.offset + len(x) + 1]
    return np.frombuffer(x.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].reshape(len(x), REACH, BYTES)


def _common(t: pa.Table, i: np.ndarray, u: pa.Table, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(which of i, words to the left, words to the right) that t[i] and u[j] have in common, where their seeds are equal."""
    at = np.flatnonzero(t.column("seed").to_numpy()[i] == u.column("seed").to_numpy()[j])
    i, j = i[at], j[at]

    def common(side: str) -> np.ndarray:
        differ = (_matrix(t, side)[i] != _matrix(u, side)[j]).any(axis=2)
        n = np.where(differ.any(axis=1), differ.argmax(axis=1), REACH)
        return np.minimum(n, np.minimum(t.column(f"n_{side}").to_numpy()[i], u.column(f"n_{side}").to_numpy()[j]))

    return at, common("left"), common("right")


class _Best:
    """For some rows of a table the longest match on one side, and the longest on the other side among those."""

    def __init__(self, table: pa.Table, rows: np.ndarray, side: str) -> None:
        self.table, self.rows, self.side = table, rows, side
        self.most, self.other = np.full(len(rows), -1), np.full(len(rows), -1)

    def add(self, which: np.ndarray, u: pa.Table, j: np.ndarray) -> None:
        at, left, right = _common(self.table, self.rows[which], u, j)
        k, (most, other) = which[at], (right, left) if self.side == "right" else (left, right)
        better = (most > self.most[k]) | (most == self.most[k]) & (other > self.other[k])
        self.most[k[better]], self.other[k[better]] = most[better], other[better]

    def out(self, part: int, least: int) -> pa.RecordBatch:
        """The rows that a match of `least` words is still possible for."""
        most_other = self.table.column("n_left" if self.side == "right" else "n_right").to_numpy()[self.rows]
        keep = (self.most >= 0) & (self.most + most_other >= least)
        return _row(_MATCH, part, self.table, self.rows[keep], self.most[keep], self.other[keep])


def _row(kind: int, part: int, t: pa.Table, i: np.ndarray, most: np.ndarray | None = None, other: np.ndarray | None = None) -> pa.RecordBatch:
    rows = t.take(pa.array(i, pa.int64())).combine_chunks()
    n = len(i)
    col = lambda c: rows.column(c).combine_chunks() if kind != _MATCH or c in ("row", "doc_id", "seed", "at") else pa.nulls(n, rows.column(c).type)
    ints = lambda x: pa.array(np.zeros(n, np.int32) if x is None else x.astype(np.int32))
    names = ["row", "doc_id", "seed", "at", "n_left", "n_right", "left", "right"]
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), pa.array(np.full(n, part, np.int32)), *map(col, names), ints(most), ints(other)], names=["kind", "part", *names, "most", "other"])


def _matches(rows: DataFrame, side: str, least: int) -> DataFrame:
    """(row, doc_id, seed, at, most, other): what each suffix has in common with its neighbours in the order of seed and side: the
    longest match on this side, and the longest on the other side among those."""
    other_side = "left" if side == "right" else "right"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, table, head, heads = TaskContext.get().partitionId(), None, True, 0
        for batch in _and_end(batches):
            if batch is not None:
                if not batch.num_rows:
                    continue
                new = pa.Table.from_batches([batch])
                table = new if table is None else pa.concat_tables([table, new]).combine_chunks()
            if table is None:
                return
            row = table.column("row").to_numpy()
            n = len(row)
            run_of = np.concatenate([[0], np.cumsum(row[1:] != row[:-1])])
            begins = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
            before = begins[run_of] - 1
            after = np.concatenate([begins[1:], [n]])[run_of]
            # before the end the last run is open, and the row before it is there for comparison only
            todo = np.arange(heads, n if batch is None else begins[-1])
            best = _Best(table, todo, side)
            for other, there in ((before, before >= 0), (after, after < n)):
                which = np.flatnonzero(there[todo])
                best.add(which, table, other[todo[which]])
            yield best.out(part, least)
            if head and (len(begins) > 1 or batch is None):
                first = begins[: 2]
                yield _row(_FIRST, part, table, first)
                yield _row(_HEAD, part, table, np.arange(begins[1] if len(begins) > 1 else n))
                head = False
            if batch is None:
                ends = np.concatenate([begins[1:], [n]]) - 1
                yield _row(_LAST, part, table, ends[::-1][:2])
                yield _row(_TAIL, part, table, np.arange(begins[-1], n))
            else:
                keep = max(0, int(begins[-1]) - 1)
                heads = int(begins[-1]) - keep
                table = table.slice(keep)

    order = ["seed", side, other_side, "row", "at"]
    sorted_ = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    out = written(sorted_.mapInArrow(run, _OUT), "matches")
    # four rows of each range at most
    edges = out.where(F.col("kind").isin(_FIRST, _LAST)).orderBy("part").toArrow()
    near = _neighbours(edges)

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = pa.Table.from_batches([batch])
            kind, part, row = (t.column(c).to_numpy() for c in ("kind", "part", "row"))
            for k, beyond in ((_HEAD, near[0]), (_TAIL, near[1])):
                j = np.array([next((e for e in beyond.get(p, ()) if edge_rows[e] != r), -1) for p, r in zip(part, row, strict=True)], np.int64)
                i = np.flatnonzero((kind == k) & (j >= 0))
                best = _Best(t, i, side)
                best.add(np.arange(len(i)), edges, j[i])
                yield best.out(0, least)

    edge_rows = edges.column("row").to_numpy()
    rest = out.where(F.col("kind").isin(_HEAD, _TAIL)).mapInArrow(close, _OUT)
    return out.where(F.col("kind") == _MATCH).union(rest).select("row", "doc_id", "seed", "at", "most", "other")


def _and_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _neighbours(edges: pa.Table) -> tuple[dict[int, list[int]], dict[int, list[int]]]:
    """For each range: the two nearest edge rows of different texts before it, and after it."""
    kind, part, row = (edges.column(c).to_numpy() for c in ("kind", "part", "row"))
    parts = sorted(set(part.tolist()))
    own = {p: {k: np.flatnonzero((part == p) & (kind == k)).tolist() for k in (_FIRST, _LAST)} for p in parts}

    def walk(parts: list[int], k: int) -> dict[int, list[int]]:
        out, near = {}, []
        for p in parts:
            out[p] = near
            mine = own[p][k]
            near = [*mine, *[e for e in near if row[e] not in {row[m] for m in mine}]][:2]
        return out

    return walk(parts, _LAST), walk(parts[::-1], _FIRST)


def _long_grams(h: np.ndarray, n: int) -> np.ndarray:
    """The hash of each n consecutive hashes, from those of 1, 2, 4, ... of them."""
    out, size, power = None, 0, h
    for k in range(n.bit_length()):
        if n >> k & 1:
            out = power if out is None else mix(out[: len(out) - (1 << k)] * np.uint64(0xD6E8FEB86659FD93) + power[size:])
            size += 1 << k
        power = mix(power[: -(1 << k)] * np.uint64(0xA0761D6478BD642F) + power[1 << k :])
    return out[: len(h) - n + 1]


def _windows(docs: DataFrame, bits: np.ndarray, least: int) -> DataFrame:
    """(hash, row, doc_id, begin): the windows of `least` words that hold a minimiser whose seed's bit is set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for every in batches for x in slices(every, 1)):
            w = words_of(batch.column(1), SPACED, lower=False)
            first, h = minimisers(w)
            first = first[has(bits, h)]
            owner = np.searchsorted(w.doc, first, "right") - 1
            low, high = np.maximum(w.doc[owner], first + SEED - least), np.minimum(first, w.doc[owner + 1] - least) + 1
            some = low < high
            edges = np.bincount(low[some], minlength=len(w.hashes) + 1) - np.bincount(high[some], minlength=len(w.hashes) + 1)
            begin = np.flatnonzero(np.cumsum(edges) > 0)
            hashes = _long_grams(w.hashes, least)[begin] if len(begin) else np.zeros(0, np.uint64)
            own = np.searchsorted(w.doc, begin, "right") - 1
            rows = pa.array(own)
            yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), batch.column(0).take(rows), batch.column(2).take(rows), pa.array((begin - w.doc[own]).astype(np.int32))], names=["hash", "row", "doc_id", "begin"])

    return _numbered(docs).mapInArrow(run, "hash long, row long, doc_id long, begin int")


def _every_span(docs: DataFrame, least: int) -> DataFrame:
    """(row, doc_id, begin, stop): spans that together are all that repeats."""
    rows = _suffixes(docs, repeated_bits(docs))
    pair = lambda a, b: F.col(a) * 64 + F.col(b)  # noqa: E731  both are REACH at most
    every = _matches(rows, "right", least).select("row", "doc_id", "seed", "at", F.col("most").alias("r"), F.col("other").alias("l"))
    every = every.unionByName(_matches(rows, "left", least).select("row", "doc_id", "seed", "at", F.col("most").alias("l"), F.col("other").alias("r")))
    best = every.groupBy("row", "at").agg(F.first("doc_id").alias("doc_id"), F.first("seed").alias("seed"), F.max(pair("r", "l")).alias("rl"), F.max(pair("l", "r")).alias("lr"))
    most_r, its_l, most_l, its_r = F.expr("rl div 64").cast("int"), F.expr("rl % 64"), F.expr("lr div 64").cast("int"), F.expr("lr % 64")
    best = best.where(most_r + most_l >= least).select("row", "doc_id", "seed", "at", most_r.alias("r"), its_l.alias("r_l"), most_l.alias("l"), its_r.alias("l_r"))
    best = written(best, "best")
    found = F.array(F.struct((F.col("at") - F.col("r_l")).alias("begin"), (F.col("at") + F.col("r")).alias("stop")), F.struct((F.col("at") - F.col("l")).alias("begin"), (F.col("at") + F.col("l_r")).alias("stop")))
    direct = best.select("row", "doc_id", F.explode(F.array_distinct(found)).alias("s")).select("row", "doc_id", "s.begin", "s.stop").where(F.col("stop") - F.col("begin") >= least)
    # suffixes whose longest matches to either side are with different texts
    open_ = bitmap(best.where((F.col("r_l") < F.col("l")) & (F.col("l_r") < F.col("r"))), "seed")
    if not open_.any():
        return direct
    windows = written(_windows(docs, open_, least), "windows")
    twice = windows.groupBy("hash").agg(F.min("row").alias("a"), F.max("row").alias("b")).where("a < b").select("hash")
    # written, so that the rows of a hot window can be split in the join
    more = windows.join(written(twice, "twice"), "hash", "left_semi")
    return direct.unionByName(more.select("row", "doc_id", "begin", (F.col("begin") + least).alias("stop")))


def united_spans(docs: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """(row, doc_id, begin, stop): a document's repeated passages as spans of words that are apart from each other."""
    return _united(_every_span(docs, least)).select("row", "doc_id", "begin", "stop")


def _united(spans: DataFrame) -> DataFrame:
    """Spans (row, doc_id, begin, stop) that meet, as one."""
    before = Window.partitionBy("row").orderBy("begin", "stop").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("new", (F.col("begin") > F.coalesce(F.max("stop").over(before), F.lit(-1))).cast("int"))
    island = F.sum("new").over(Window.partitionBy("row").orderBy("begin", "stop").rowsBetween(Window.unboundedPreceding, 0))
    return spans.withColumn("island", island).groupBy("row", "island").agg(F.first("doc_id").alias("doc_id"), F.min("begin").alias("begin"), F.max("stop").alias("stop")).drop("island")


def repeated_spans(docs: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """(row, doc_id, spans): for each document with repeated passages, its spans of words (begin, stop), in order and apart."""
    return united_spans(docs.select("doc_id", "text"), least).groupBy("row", "doc_id").agg(F.array_sort(F.collect_list(F.struct("begin", "stop"))).alias("spans"))


def report(docs: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """One row for each span: doc_id, begin, stop (word numbers, the end exclusive), n_words."""
    spans = united_spans(docs.select("doc_id", "text"), least)
    return spans.select("doc_id", F.col("begin").cast("long").alias("begin"), F.col("stop").cast("long").alias("stop"), (F.col("stop") - F.col("begin")).cast("long").alias("n_words"))


def without_repeats(docs: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """docs in which a passage that repeats stands in one row only, the first in the order of the table: it is cut from the texts of the others.

    Every window of `least` words inside a repeated span stays in the first row that has it. n_chars, if there, follows the text.
    """
    needed = ("doc_id", "text")
    rows = written(packed(docs, *needed).withColumn("_row", F.monotonically_increasing_id()), "rows")
    spans = united_spans(rows.select("doc_id", "text", "_row"), least).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("begin", "stop"))).alias("spans"))
    found = written(rows.join(spans.withColumnRenamed("row", "_row"), "_row").select("_row", "text", "spans"), "found")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for every in batches for x in slices(every, 1)):
            w = words_of(batch.column(1), SPACED, lower=False)
            begin = [np.arange(s["begin"], s["stop"] - least + 1) + w.doc[i] for i, own in enumerate(batch.column(2).to_pylist()) for s in own]
            begin = np.unique(np.concatenate(begin)) if begin else np.zeros(0, np.int64)
            own = np.searchsorted(w.doc, begin, "right") - 1
            hashes = _long_grams(w.hashes, least)[begin] if len(begin) else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), batch.column(0).take(pa.array(own)), pa.array((begin - w.doc[own]).astype(np.int32))], names=["hash", "row", "begin"])

    every = written(found.mapInArrow(windows, "hash long, row long, begin int"), "windows")
    first = written(every.groupBy("hash").agg(F.min("row").alias("first")), "first")
    later = every.join(first, "hash").where("row > first").select("row", F.lit(None).cast("long").alias("doc_id"), "begin", (F.col("begin") + least).alias("stop"))
    cut = _united(later).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("begin", "stop"))).alias("spans"))

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for every in batches for x in slices(every, 1)):
            w, out = words_of(batch.column(1), SPACED, lower=False), []
            for i, own in enumerate(batch.column(2).to_pylist()):
                parts, at = [], int(w.text_at[i])
                for s in own:
                    a, b = int(w.starts[w.doc[i] + s["begin"]]), int(w.ends[w.doc[i] + s["stop"] - 1])
                    parts, at = [*parts, w.data[at:a].tobytes()], b
                out.append(b"".join([*parts, w.data[at : int(w.text_at[i + 1])].tobytes()]).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["_row", "_text"])

    made = written(found.select("_row", "text").join(cut.withColumnRenamed("row", "_row"), "_row").select("_row", "text", "spans").mapInArrow(texts, "_row long, _text string"), "texts")
    text = F.coalesce("_text", "text")
    changed = {"text": text} | ({"n_chars": F.when(F.col("_text").isNotNull(), F.char_length(text).cast("long")).otherwise(F.col("_rest")["n_chars"])} if "n_chars" in docs.columns else {})
    return rows.join(made, "_row", "left").select(*unpacked(docs.columns, needed, **changed))
