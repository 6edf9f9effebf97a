"""SentencePiece encoding and decoding (11): merge rounds on flat arrays of symbols.

A slice of texts is escaped (blanks become the mark U+2581, one mark goes before the text) and cut where no piece of the model reaches:
before a mark that follows another character. Distinct words are encoded once. All their symbols lie in one flat array. In a round
the least rank of a pair is found in each word, all of its leftmost occurrences are merged at once, and the array is compacted; only
ranks beside merged symbols are looked up anew; words without a pair leave. Occurrences are merged at once only where the merged piece
can't start a better merge before the next occurrence (no piece of the same or a better rank begins or ends with it); else only the leftmost is.
Words are cut once more where two neighbouring characters are in no piece; what is still longer than LONG symbols is merged with a
priority queue, by the same rule. Characters that are no piece become byte pieces.

The model file (BPE with byte fallback, no normalisation, no user-defined pieces; another model is an error) is read by each Python worker.

Defined results: a null or empty text has the begin and the end id only; rows that repeat a doc_id are encoded each; an empty table gives an
empty one; other columns are carried along, one named like an added column is replaced. Null ids decode to the empty text, ids outside
of the model are an error. Invalid bytes among byte pieces decode to U+FFFD each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache, cached_property
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, without
from .words import text_bytes

MARK = "▁"
#: Symbols of a word that is merged in rounds; a longer one goes through a queue.
LONG = 2048
NONE = np.iinfo(np.int32).max
#: Kinds of pieces in a model file.
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6


def public_model(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _varint(data: bytes, i: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        byte = data[i]
        out |= (byte & 127) << shift
        i, shift = i + 1, shift + 7
        if byte < 128:
            return out, i


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol buffer message."""
    i = 0
    while i < len(data):
        tag, i = _varint(data, i)
        if tag & 7 == 0:
            value, i = _varint(data, i)
        else:
            size, i = _varint(data, i) if tag & 7 == 2 else ({1: 8, 5: 4}[tag & 7], i)
            value, i = data[i : i + size], i + size
        yield tag >> 3, value


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Places starts[i], starts[i] + 1, .. of counts[i] each, one after another."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


class Model:
    """A model file's pieces, the pairs that make them, and what each id decodes to."""

    def __init__(self, path: str) -> None:
        pieces: list[tuple[str, float, int]] = []
        trainer: dict = {}
        normaliser: dict = {}
        with open(path, "rb") as f:
            for number, value in _fields(f.read()):
                if number == 1:
                    own = dict(_fields(value))
                    pieces.append((own[1].decode(), float(np.frombuffer(own.get(2, b"\0" * 4), "<f4")[0]), own.get(3, NORMAL)))
                elif number in (2, 3):
                    (trainer if number == 2 else normaliser).update(_fields(value))
        kinds = {kind for _, _, kind in pieces}
        if trainer.get(3, 1) != 2 or not trainer.get(35, 0) or trainer.get(24, 0) or kinds - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("the model must be BPE with byte fallback, marks before words and no user-defined or unused pieces")
        if normaliser.get(2) or normaliser.get(4, 1) or not normaliser.get(3, 1) or not normaliser.get(5, 1):
            raise ValueError("the model must not normalise texts, but for escaped blanks and a mark before the text")
        self.begin, self.end, self.size = trainer.get(41, 1), trainer.get(42, 2), len(pieces)
        normal = {p: i for i, (p, _, kind) in enumerate(pieces) if kind == NORMAL}
        if any(b == MARK and a != MARK for p in normal for a, b in zip(p, p[1:], strict=False)):
            raise ValueError("a piece of the model reaches over the beginning of a word")
        self._decoding(pieces, trainer)
        self._merging(pieces, normal)

    def _decoding(self, pieces: list[tuple[str, float, int]], trainer: dict) -> None:
        unknown = trainer.get(44, " ⁇ ".encode())
        out = [p.replace(MARK, " ").encode() if kind == NORMAL else bytes([int(p[3:-1], 16)]) if kind == BYTE else unknown if kind == UNKNOWN else b"" for p, _, kind in pieces]
        self.lengths = np.array([len(x) for x in out], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.data = np.frombuffer(b"".join(out), np.uint8)
        self.kinds = np.array([kind for _, _, kind in pieces], np.uint8)
        self.marked = np.array([kind == NORMAL and p[:1] == MARK for p, _, kind in pieces])
        self.byte_ids = np.zeros(256, np.int64)
        for i, (p, _, kind) in enumerate(pieces):
            if kind == BYTE:
                self.byte_ids[int(p[3:-1], 16)] = i

    def _merging(self, pieces: list[tuple[str, float, int]], normal: dict[str, int]) -> None:
        """Symbols are the ids of pieces, and size + code point for characters that are no piece."""
        symbol = {c: normal.get(c, self.size + ord(c)) for c in set("".join(normal))} | normal
        self.symbol_of = np.arange(0x110000, dtype=np.int64) + self.size
        for c, s in symbol.items():
            if len(c) == 1:
                self.symbol_of[ord(c)] = s
        self.width = self.size + 0x110000
        made = {(symbol[p[:k]], symbol[p[k:]]): i for p, i in normal.items() for k in range(1, len(p)) if p[:k] in symbol and p[k:] in symbol}
        scores = np.array([-pieces[i][1] for i in made.values()])
        order = np.unique(scores, return_inverse=True)[1]
        keys = np.array([a * self.width + b for a, b in made], np.int64)
        by = np.argsort(keys)
        self.keys, self.made, self.ranks = keys[by], np.array(list(made.values()), np.int64)[by], order[by].astype(np.int32)
        # pairs that can be in the table, by a hash of them: most of those that are asked for are not
        self.filter = np.zeros(1 << 20, bool)
        self.filter[self._bits(keys)] = True
        # ranks of which one piece may start a merge that is no worse
        rank = dict(zip(made.values(), order.tolist(), strict=True))
        self.alone = np.zeros(len(order) + 1, bool)
        for p, i in normal.items():
            for part in {x for k in range(1, len(p)) for x in (p[:k], p[k:])}:
                if i in rank and (j := normal.get(part)) in rank and rank[j] >= rank[i]:
                    self.alone[rank[j]] = True
        self.pairs = np.unique(np.array([ord(a) * 0x110000 + ord(b) for p in normal for a, b in zip(p, p[1:], strict=False)], np.int64))

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, merged piece) of pairs of symbols; NONE where they make no piece."""
        key = left * self.width + right
        likely = np.flatnonzero(self.filter[self._bits(key)])
        asked = key[likely]
        at = np.minimum(np.searchsorted(self.keys, asked), len(self.keys) - 1)
        found = self.keys[at] == asked
        rank, made = np.full(len(key), NONE, np.int32), np.zeros(len(key), np.int64)
        rank[likely[found]], made[likely[found]] = self.ranks[at[found]], self.made[at[found]]
        return rank, made

    @staticmethod
    def _bits(key: np.ndarray) -> np.ndarray:
        return (key * np.int64(0x9E3779B97F4A7C1)) >> 20 & 0xFFFFF

    @cached_property
    def pair(self) -> dict[int, tuple[int, int]]:
        return dict(zip(self.keys.tolist(), zip(self.ranks.tolist(), self.made.tolist(), strict=True), strict=True))

    def _queued(self, symbols: list[int]) -> list[int]:
        """One long word: pairs by rank, then place, until none is left."""
        n = len(symbols)
        before, after, version = list(range(-1, n - 1)), [*range(1, n), -1], [0] * n
        ranks, made = self.look_up(np.array(symbols[:-1]), np.array(symbols[1:]))
        heap = [(int(r), i, i + 1, 0, 0, int(m)) for i, (r, m) in enumerate(zip(ranks, made, strict=True)) if r != NONE]
        heapify(heap)
        while heap:
            _, i, j, vi, vj, piece = heappop(heap)
            if version[i] != vi or version[j] != vj or after[i] != j:
                continue
            symbols[i], after[i], version[i], version[j] = piece, after[j], vi + 1, -1
            if after[j] >= 0:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0:
                    found = self.pair.get(symbols[a] * self.width + symbols[b])
                    if found:
                        heappush(heap, (found[0], a, b, version[a], version[b], found[1]))
        return [s for s, v in zip(symbols, version, strict=True) if v >= 0]

    def merged(self, symbol: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbols, word of each) when no pair of neighbours in a word makes a piece; words ascend."""
        done: list[tuple[np.ndarray, np.ndarray]] = []
        first = np.flatnonzero(np.diff(word, prepend=-1))
        size = np.diff(first, append=len(word))
        for a, n in zip(first[size > LONG], size[size > LONG], strict=True):
            own = np.array(self._queued(symbol[a : a + n].tolist()), np.int64)
            done.append((own, np.full(len(own), word[a])))
        stay = np.repeat(size <= LONG, size)
        symbol, word = symbol[stay], word[stay]
        rank, piece = np.full(len(symbol), NONE, np.int32), np.zeros(len(symbol), np.int64)
        inner = np.flatnonzero(word[1:] == word[:-1])
        rank[inner], piece[inner] = self.look_up(symbol[inner], symbol[inner + 1])
        while len(symbol):
            first = np.flatnonzero(np.diff(word, prepend=-1))
            size, least = np.diff(first, append=len(word)), np.minimum.reduceat(rank, first)
            if (over := least == NONE).any():
                leave = np.repeat(over, size)
                done.append((symbol[leave], word[leave]))
                symbol, word, rank, piece = symbol[~leave], word[~leave], rank[~leave], piece[~leave]
                first, size, least = np.flatnonzero(np.diff(word, prepend=-1)), size[~over], least[~over]
                if not len(symbol):
                    break
            hit = np.flatnonzero(rank == np.repeat(least, size))
            # of occurrences that overlap every second, of ranks that go alone the first in a word
            chain = np.arange(len(hit)) - np.maximum.accumulate(np.where(np.diff(hit, prepend=-2) == 1, 0, np.arange(len(hit))))
            take = (chain % 2 == 0) & (~self.alone[rank[hit]] | (np.diff(word[hit], prepend=-1) != 0))
            hit = hit[take]
            symbol[hit] = piece[hit]
            keep = np.ones(len(symbol), bool)
            keep[hit + 1] = False
            place = np.cumsum(keep) - 1
            symbol, word, rank, piece = symbol[keep], word[keep], rank[keep], piece[keep]
            beside = np.zeros(len(symbol) + 1, bool)
            beside[place[hit]] = beside[place[hit] - 1] = True
            near = np.flatnonzero(beside[:-1])
            rank[near] = NONE
            near = near[near + 1 < len(symbol)]
            near = near[word[near] == word[near + 1]]
            rank[near], piece[near] = self.look_up(symbol[near], symbol[near + 1])
        if not done:
            return symbol, word
        symbol, word = np.concatenate([x for x, _ in done]), np.concatenate([x for _, x in done])
        by = np.argsort(word, kind="stable")
        return symbol[by], word[by]

    def word_ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, number of ids of each)."""
        data, at = text_bytes(words)
        code = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32).astype(np.int64)
        ends = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[at]
        begin = np.zeros(len(code), bool)
        begin[ends[:-1][np.diff(ends) > 0]] = True
        key = code[:-1] * 0x110000 + code[1:]
        begin[1:] |= self.pairs[np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)] != key
        symbol, part = self.merged(self.symbol_of[code], np.cumsum(begin) - 1)
        owner = np.repeat(np.arange(len(words)), np.diff(ends))[np.flatnonzero(begin)][part]
        odd = symbol >= self.size
        if odd.any():
            raw = [chr(c).encode() for c in (symbol[odd] - self.size).tolist()]
            sizes = np.ones(len(symbol), np.int64)
            sizes[odd] = [len(x) for x in raw]
            symbol, owner, odd = np.repeat(symbol, sizes), np.repeat(owner, sizes), np.repeat(odd, sizes)
            symbol[odd] = self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
        return symbol, np.bincount(owner, minlength=len(words))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts with begin and end ids, number of ids of each)."""
        texts = pc.replace_substring(pc.fill_null(texts, "").cast(pa.large_string()), " ", MARK)
        mark, none = pa.scalar(MARK, pa.large_string()), pa.scalar("", pa.large_string())
        texts = pc.if_else(pc.equal(pc.binary_length(texts), 0), none, pc.binary_join_element_wise(mark, texts, none))
        data, at = text_bytes(texts)
        full = at[:-1][np.diff(at) > 0]
        marks = np.flatnonzero((data[:-2] == 0xE2) & (data[1:-1] == 0x96) & (data[2:] == 0x81)) if len(data) > 2 else np.zeros(0, np.int64)
        is_mark = np.zeros(len(data) + 3, bool)
        is_mark[marks + 3] = True  # a mark ends before this place
        begins = np.zeros(len(data), bool)
        begins[marks[~is_mark[marks]]] = begins[full] = True
        start = np.flatnonzero(begins)
        words = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(np.append(start, len(data)).astype(np.int64)), pa.py_buffer(data.copy()))
        coded = words.dictionary_encode()
        ids, counts = self.word_ids(coded.dictionary)
        use = coded.indices.to_numpy()
        firsts = np.cumsum(counts) - counts
        flat = ids[ragged(firsts[use], counts[use])] if len(use) else ids
        total = np.concatenate([[0], np.cumsum(counts[use])])[np.searchsorted(start, at)]
        n = np.diff(total) + 2
        out = np.empty(n.sum(), np.int64)
        ends = np.cumsum(n)
        inside = np.ones(len(out), bool)
        inside[ends - n] = inside[ends - 1] = False
        out[ends - n], out[ends - 1], out[inside] = self.begin, self.end, flat
        return out, n

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """The text of each run of ids."""
        if len(ids) and (ids.min() < 0 or ids.max() >= self.size):
            raise ValueError("an id is outside of the model")
        ends = np.cumsum(counts)
        owner = np.repeat(np.arange(len(counts)), counts)
        shown = np.flatnonzero(self.kinds[ids] != CONTROL)
        first = shown[np.flatnonzero(np.diff(owner[shown], prepend=-1))]
        first = first[self.marked[ids[first]]]  # the mark before the text goes
        starts, lengths = self.starts[ids], self.lengths[ids]
        starts[first], lengths[first] = starts[first] + 1, lengths[first] - 1
        data = self.data[ragged(starts, lengths)].tobytes()
        at = np.concatenate([[0], np.cumsum(lengths)])
        out = []
        for a, b in zip((ends - counts).tolist(), ends.tolist(), strict=True):
            try:
                out.append(data[at[a] : at[b]].decode())
            except UnicodeDecodeError:
                out.append(self._mended(ids[a:b], data, at[a : b + 1]))
        return out

    def _mended(self, ids: np.ndarray, data: bytes, at: np.ndarray) -> str:
        """A text in which runs of byte pieces are not valid: each wrong byte becomes U+FFFD."""
        edges = np.flatnonzero(np.diff(self.kinds[ids] == BYTE, prepend=self.kinds[ids[0]] != BYTE)).tolist()
        return "".join(_valid(data[at[a] : at[b]]) for a, b in zip(edges, [*edges[1:], len(ids)], strict=True))


def _valid(raw: bytes) -> str:
    out, i = [], 0
    while i < len(raw):
        for n in (1, 2, 3, 4):
            try:
                out.append(raw[i : i + n].decode())
                i += n
                break
            except UnicodeDecodeError:
                pass
        else:
            out.append("�")
            i += 1
    return "".join(out)


@cache
def _model(path: str) -> Model:
    return Model(path)


def encoded(docs: DataFrame, model: str | None = None, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs with an array of ids of each whole text."""
    path = model or public_model()

    def run(texts: pa.Array) -> list[pa.Array]:
        flat, n = _model(path).encode(texts)
        return [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(flat.astype(np.int32)))]

    return append_columns(docs, text, [T.StructField(ids, T.ArrayType(T.IntegerType()))], run)


def decoded(df: DataFrame, model: str | None = None, ids: str = "ids", text: str = "decoded", digest: str | None = None) -> DataFrame:
    """df with the text of each array of ids; digest names a column for the SHA-256 of the ids as unsigned 32-bit integers, low bytes first."""
    path = model or public_model()
    df = without(df, *[c for c in (text, digest) if c])
    at = df.columns.index(ids)
    added = [T.StructField(c, T.StringType()) for c in (text, digest) if c]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                piece = batch.slice(i, 256)
                runs = pc.fill_null(pc.list_value_length(piece.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                flat = piece.column(at).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                made = [pa.array(_model(path).decode(flat, runs), pa.string())]
                if digest:
                    raw, ends = flat.astype("<u4"), np.cumsum(runs)
                    made.append(pa.array([hashlib.sha256(raw[a:b].tobytes()).hexdigest() for a, b in zip(ends - runs, ends, strict=True)], pa.string()))
                yield pa.RecordBatch.from_arrays([*piece.columns, *made], names=[*piece.schema.names, *[f.name for f in added]])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, *added]))


def report(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    ids = encoded(docs.select("doc_id", "text"), model).select("doc_id", "ids")
    both = decoded(ids, model, digest="ids_sha256")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids_sha256", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
