"""Periodic run detection (12): internal pattern matching over the words of each text.

A slice of texts is one sequence of word numbers, each text ended by a number of its own. Prefix doubling ranks the stretches of
1, 2, 4, .. words that begin at each word, and so sorts the suffixes; the stretches equal to a block are an interval of that suffix array. A
wavelet tree over the array answers range successor and predecessor queries: the next place in an interval from a given word on.

Blocks of m = 8, 16, .. words at multiples of m are sought in the neighbouring windows. A run of period q and at least 3 q words (24 at
least) holds such a block with m <= q < 2 m in its first q + m words, and the block again q words on, so in a window of m starts; for
q < 8 the first occurrence after a block of 8 is q words on. Occurrences in a window of m starts are one arithmetic progression: up to two
are candidate periods as they are; three or more lie in a stretch with the progression's difference as period, as does the block, and the
distances of the beginnings and of the ends of the two stretches are the candidates. A candidate is extended to both sides by comparing ranks of
halving lengths, and kept if it is long enough. Of candidates with one stretch the smallest is the period: every run's own period is a candidate.

Defined results: a null or empty text has no words and no runs, its collapsed text is empty; rows that repeat a doc_id are judged each; an
empty table gives an empty one; other columns are carried along, one named like an added column is replaced. A null doc_id counts as
the empty text where the query derives its repeats.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import without
from .pieces import ragged
from .words import SPACED, slices, words_of

#: Fewest words of a run, fewest periods in it, words of the smallest block.
LEAST, TIMES, BLOCK = 24, 3, 8
RUNS = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))


class WaveletTree:
    """A permutation of 0 .. n - 1 by the bits of its values, highest first: the k-th smallest of an interval, and how many are below a value."""

    def __init__(self, values: np.ndarray) -> None:
        self.n, self.depth = len(values), max(1, int(len(values) - 1).bit_length())
        self.ones: list[np.ndarray] = []
        for bit in range(self.depth - 1, -1, -1):
            one = (values >> bit & 1).astype(bool)
            before = np.zeros(self.n + 1, np.int32)
            np.cumsum(one, out=before[1:])
            self.ones.append(before)
            values = np.concatenate([values[~one], values[one]])

    def below(self, low: np.ndarray, high: np.ndarray, value: np.ndarray) -> np.ndarray:
        """How many of the places low .. high - 1 hold less than value."""
        low, high, count = low.copy(), high.copy(), np.where(value >= self.n, high - low, 0)
        for level, before in enumerate(self.ones):
            bit = (value >> (self.depth - 1 - level) & 1).astype(bool)
            a, b, zeros = before[low], before[high], self.n - before[-1]
            count += np.where(bit & (value < self.n), (high - b) - (low - a), 0)
            low, high = np.where(bit, zeros + a, low - a), np.where(bit, zeros + b, high - b)
        return count

    def smallest(self, low: np.ndarray, high: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The k-th smallest, from 0, of the places low .. high - 1, of which there are more than k."""
        low, high, k, out = low.copy(), high.copy(), k.copy(), np.zeros(len(low), np.int64)
        for level, before in enumerate(self.ones):
            a, b, zeros = before[low], before[high], self.n - before[-1]
            none = (high - b) - (low - a)
            bit = k >= none
            k -= np.where(bit, none, 0)
            out |= bit.astype(np.int64) << (self.depth - 1 - level)
            low, high = np.where(bit, zeros + a, low - a), np.where(bit, zeros + b, high - b)
        return out


class Matcher:
    """Internal pattern matching in one sequence of numbers: equal stretches of a power of two words, and what lies in windows."""

    def __init__(self, values: np.ndarray, longest: int) -> None:
        """longest: no two equal stretches are longer than this."""
        n = self.n = len(values)
        order = np.argsort(values, kind="stable")
        rank = self._ranked(order, np.diff(values[order], prepend=-1) != 0)
        self.ranks, size = [rank.astype(np.int32)], 1
        while size < longest and self.distinct < n:
            # stretches that are alone stay where they are, the others are sorted by what follows them
            tied = np.flatnonzero(self.count[rank] > 1)
            second = np.zeros(len(tied), np.int64)
            far = tied + size < n
            second[far] = rank[tied[far] + size] + 1
            by = np.argsort(rank[tied] * np.int64(n + 1) + second)
            key = (rank[tied] * np.int64(n + 1) + second)[by]
            fresh = np.diff(key, prepend=-1) != 0
            place = np.sort(rank[tied] + self._within(rank[tied][by], by))
            order[place] = tied[by]
            start = np.ones(n, bool)
            start[place] = fresh
            rank = self._ranked(order, start)
            self.ranks.append(rank.astype(np.int32))
            size *= 2
        self.order, self.tree = order, None

    def _within(self, rank: np.ndarray, by: np.ndarray) -> np.ndarray:
        """The number of each sorted member within its rank, in the order before sorting."""
        first = np.maximum.accumulate(np.where(np.diff(rank, prepend=-1) != 0, np.arange(len(rank)), 0))
        out = np.empty(len(rank), np.int64)
        out[by] = np.arange(len(rank)) - first
        return out

    def _ranked(self, order: np.ndarray, start: np.ndarray) -> np.ndarray:
        """The place of the first of its equals for each stretch; counts how many there are."""
        begin = np.flatnonzero(start)
        self.distinct = len(begin)
        self.count = np.zeros(self.n, np.int64)
        self.count[begin] = np.diff(begin, append=self.n)
        rank = np.empty(self.n, np.int64)
        rank[order] = np.repeat(begin, np.diff(begin, append=self.n))
        return rank

    def equals(self, level: int, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The interval of the suffix array with the stretches of 2 ** level words that equal those at places."""
        rank = self.ranks[min(level, len(self.ranks) - 1)]
        ends = np.searchsorted(self.sorted_ranks(level), rank[places], "right")
        return rank[places], ends

    def sorted_ranks(self, level: int) -> np.ndarray:
        return self.ranks[min(level, len(self.ranks) - 1)][self.order]

    def successor(self, low: np.ndarray, high: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The least place from the given one on in an interval of the suffix array; the greatest integer where there is none."""
        self.tree = self.tree or WaveletTree(self.order)
        k = self.tree.below(low, high, place)
        out, some = np.full(len(low), np.iinfo(np.int64).max), k < high - low
        out[some] = self.tree.smallest(low[some], high[some], k[some])
        return out

    def predecessor(self, low: np.ndarray, high: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The greatest place before the given one in an interval of the suffix array, which must be there."""
        self.tree = self.tree or WaveletTree(self.order)
        return self.tree.smallest(low, high, self.tree.below(low, high, place) - 1)

    def stretch(self, place: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(begin, end) of the longest stretch around place and place + period that has the period."""
        right, left = place.copy(), place.copy()
        for level in range(len(self.ranks) - 1, -1, -1):
            rank, step = self.ranks[level], 1 << level
            fits = right + period + step <= self.n
            same = np.flatnonzero(fits)[rank[right[fits]] == rank[right[fits] + period[fits]]]
            right[same] += step
            fits = left - step >= 0
            same = np.flatnonzero(fits)[rank[left[fits] - step] == rank[left[fits] - step + period[fits]]]
            left[same] -= step
        return left, right + period


def runs_of(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, end, period) of all runs in a sequence of texts, by begin, then period; first: the first word of each text, and the end.

    The last word of each text must be in it once only, and in no other text.
    """
    none = np.zeros(0, np.int64)
    longest = int(np.diff(first).max(initial=0)) - 1
    if longest < LEAST:
        return none, none, none
    m = Matcher(values, longest)
    places: list[np.ndarray] = []
    periods: list[np.ndarray] = []

    def add(place: np.ndarray, period: np.ndarray) -> None:
        places.append(place)
        periods.append(period)

    for level in range(BLOCK.bit_length() - 1, len(m.ranks)):
        size = 1 << level
        if TIMES * size > longest and size > BLOCK:
            break
        block = np.arange(0, m.n, size)
        low, high = m.equals(level, block)
        block, low, high = (x[high - low > 1] for x in (block, low, high))
        if not len(block):
            continue  # longer blocks may begin elsewhere
        if size == BLOCK:
            near = m.successor(low, high, block + 1)
            ok = near < block + size
            add(block[ok], (near - block)[ok])
        one = m.successor(low, high, block + size)
        ok = one < block + 2 * size
        block, low, high, one = block[ok], low[ok], high[ok], one[ok]
        two = m.successor(low, high, one + 1)
        last = m.predecessor(low, high, block + 2 * size)
        add(block, one - block)
        add(block, last - block)
        many = np.flatnonzero((two < last) & (last < block + 2 * size))
        if len(many):
            block, one, step = block[many], one[many], (two - one)[many]
            begin, end = m.stretch(block, step)
            other, far = m.stretch(one, step)
            for distance in (other - begin, far - end):
                ok = distance > 0
                add(block[ok], distance[ok])
    if not places:
        return none, none, none
    place, period = np.concatenate(places), np.concatenate(periods)
    ok = place + period < m.n
    begin, end = m.stretch(place[ok], period[ok])
    period = period[ok]
    ok = end - begin >= np.maximum(LEAST, TIMES * period)
    begin, end, period = begin[ok], end[ok], period[ok]
    by = np.lexsort((period, end, begin))
    begin, end, period = begin[by], end[by], period[by]
    fresh = np.ones(len(begin), bool)
    fresh[1:] = (begin[1:] != begin[:-1]) | (end[1:] != end[:-1])
    begin, end, period = begin[fresh], end[fresh], period[fresh]
    by = np.lexsort((period, begin))
    return begin[by], end[by], period[by]


def repeated(ids: list[int | None], first: np.ndarray) -> np.ndarray:
    """The number of the word that stands at each word: one document in ten has a periodic end, by the crc32 of its id."""
    out = np.arange(first[-1])
    for k, i in enumerate(ids):
        h = zlib.crc32(b"" if i is None else str(i).encode())
        n = int(first[k + 1] - first[k])
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            at = int(first[k]) + a
            out[at : first[k + 1]] = at + np.arange(n - a) % p
    return out


def _periodic(ids: list[int | None] | None, texts: pa.Array) -> list[pa.Array]:
    w = words_of(texts, SPACED, lower=False)
    lengths = w.ends - w.starts
    use = repeated(ids, w.doc) if ids is not None else np.arange(len(lengths))
    # equal words get equal numbers, exactly
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    packed = w.data[ragged(w.starts, lengths)]
    number = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(packed)]).dictionary_encode().indices.to_numpy().astype(np.int64)
    n = w.counts
    texts_at = np.arange(len(n))
    # an end after each text
    values = np.empty(len(lengths) + len(n), np.int64)
    ends = w.doc[1:] + texts_at
    inside = np.ones(len(values), bool)
    inside[ends] = False
    values[ends], values[inside] = len(lengths) + texts_at, number[use]
    first = np.append(w.doc[:-1] + texts_at, len(values))
    begin, end, period = runs_of(values, first)
    owner = np.searchsorted(first, begin, "right") - 1
    # words that a run repeats
    depth = np.zeros(len(values) + 1, np.int64)
    np.add.at(depth, begin + period, 1)
    np.add.at(depth, end, -1)
    kept = (np.cumsum(depth[:-1]) == 0)[inside]
    some = np.flatnonzero(kept)
    size = lengths[use[some]] + 1  # with a blank after each word
    data = np.full(size.sum(), ord(" "), np.uint8)
    stops = np.cumsum(size)
    words = np.ones(len(data), bool)
    words[stops - 1] = False
    data[words] = w.data[ragged(w.starts[use[some]], size - 1)]
    of = w.owner[some]
    last = np.flatnonzero(np.diff(of, append=-1))
    cut = np.ones(len(data), bool)
    cut[stops[last] - 1] = False  # none after a text's last
    total = np.bincount(of, weights=size, minlength=len(n)).astype(np.int64)
    total[of[last]] -= 1
    collapsed = pa.LargeStringArray.from_buffers(len(n), pa.py_buffer(np.concatenate([[0], np.cumsum(total)])), pa.py_buffer(data[cut])).cast(pa.string())
    rows = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(n)))]).astype(np.int32)
    made = pa.StructArray.from_arrays([pa.array(begin - first[owner]), pa.array(end - begin), pa.array(period)], names=["start", "length", "period"])
    return [pa.ListArray.from_arrays(pa.array(rows), made), collapsed]


def periodic(docs: DataFrame, text: str = "text", plant: str | None = None) -> DataFrame:
    """docs with runs, an array of (start, length, period) by start, then period, and collapsed, the text's words without those that a
    run repeats, joined by blanks. plant names an id column by which periodic ends are put into texts first."""
    docs = without(docs, "runs", "collapsed")
    at, name = docs.columns.index(text), docs.columns.index(plant) if plant else None
    schema = T.StructType([*docs.schema.fields, T.StructField("runs", RUNS), T.StructField("collapsed", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, at):
                made = _periodic(piece.column(name).to_pylist() if plant else None, piece.column(at))
                yield pa.RecordBatch.from_arrays([*piece.columns, *made], names=[*piece.schema.names, "runs", "collapsed"])

    return docs.mapInArrow(run, schema)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, the run with most periods, digests of all runs and of the collapsed text; a tenth of the documents gets a periodic end."""
    found = periodic(docs.select("doc_id", "text"), plant="doc_id").drop("text")
    # exact: lengths times the other's period
    best = F.get(F.array_sort("runs", lambda a, b: F.when(b["length"] * a["period"] != a["length"] * b["period"], F.signum(b["length"] * a["period"] - a["length"] * b["period"]).cast("int")).when(a["start"] != b["start"], F.signum(a["start"] - b["start"]).cast("int")).otherwise(F.signum(a["period"] - b["period"]).cast("int"))), F.lit(0))
    lines = F.transform("runs", lambda r: F.format_string("%d,%d,%d\n", r["start"], r["length"], r["period"]))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    with_best = found.withColumn("best", best)
    return with_best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col("best")[c].alias(c) for c in ("start", "length", "period")],
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        sha(F.array_join(lines, "")).alias("runs_sha256"),
        sha(F.col("collapsed")).alias("collapsed_sha256"),
    )
