"""Token ids in grammar-compressed shards (10): Re-Pair per shard, with rules and expansion lengths for random access.

Documents are sorted by doc_id over ranges, encoded with a public tokenizer, ended with an end id and packed into shards of whole
documents. In each shard frequent pairs of neighbouring symbols are replaced by nonterminals, round after round; a round replaces
many pairs at once, none of which can overlap another. Pairs that hold the end id are never replaced, so that documents begin and end
at symbols. Shards are rows of Parquet files: the part and shard numbers, ids and lengths of the documents, the rules (two symbols
each), the expansion length of every nonterminal, and the rest of the sequence.

Defined results: a null or empty text has the end id only; documents without doc_id come first; rows that repeat a doc_id follow one
another by a hash of their texts; no documents make no shards; columns other than doc_id and text are not stored.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vertexloom.sources.scratch import shared_folder

from .words import slices, text_bytes

END_ID = 1
#: Ids of a shard before it is closed; a longer document is a shard of its own.
SHARD_TOKENS = 1 << 20
#: Most rules of a shard, of one round; fewest times that a replaced pair occurs; share of symbols that a round must save.
MAX_RULES, ROUND_RULES, MIN_COUNT, MIN_GAIN = 16_000, 4_000, 6, 0.004
#: Distinct pieces whose ids a Python worker remembers, and bytes of text that are encoded at a time.
CACHED_PIECES, SLICE_BYTES = 500_000, 4 << 20
#: Words that the short way is compared with the long on.
SAMPLE = ("the", "Hello,", "STRASSE.", "Stra\u00dfe", "\u00c9COLE!!", "na\u00efve...", "\u00fcberm\u00e4\u00dfig", "zzzqx", "l", "inger###", "x&&&.", "to%$", "(a)b", "12a3", "a.b@c-d.com", "2024-01-05", "***", "don't", "a|b", "\u00d7a\u00f7")


def _byte_signs() -> dict[int, str]:
    """Code points of two bytes as the signs that byte-level tokenizers write for them: printable bytes stay, others go up from 256."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    sign = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}
    return {c: "".join(sign[b] for b in chr(c).encode()) for c in range(0x80, 0x800)}


BYTE_SIGNS = _byte_signs()
#: Characters that can stand between words while these are encoded: the first that is a single id.
MARKS = "\u2022\u2026\u2192\u2605\u2665\u20ac\u2014"
#: Kinds of bytes: white space, letters, digits, signs, and others, whose words go to the tokenizer whole.
_BLANK, _LETTER, _DIGIT, _SIGN, _OTHER = range(5)


def _kinds() -> np.ndarray:
    out = np.full(256, _OTHER, np.uint8)
    out[[0x20, *range(0x09, 0x0E)]] = _BLANK
    out[[c for c in range(0x21, 0x7F)]] = _SIGN
    out[[ord("'"), ord("|")]] = _OTHER  # contractions and the names of special tokens
    out[ord("0") : ord("9") + 1] = _DIGIT
    out[ord("A") : ord("Z") + 1] = out[ord("a") : ord("z") + 1] = _LETTER
    return out


KINDS = _kinds()
#: Pieces that go straight to the tokenizer's model.
SHORT = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[!-&(-/:-@\\[-`{}~]+")


def pieces(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(pieces of all texts, first piece of each text and the number of all).

    A piece is a run of letters in lower case, a digit, or a run of signs. A word with any other character than ASCII's and Latin-1's letters
    is one piece as it stands.
    """
    data, at = text_bytes(texts)
    kind, low = KINDS[data], data.copy()
    low[(data >= ord("A")) & (data <= ord("Z"))] += 32
    lead = np.flatnonzero(data[:-1] == 0xC3)  # two bytes: letters from U+00C0 on, capitals 32 before the small ones
    second = data[lead + 1]
    letter = (second != 0x97) & (second != 0xB7)
    kind[lead[letter]] = kind[lead[letter] + 1] = _LETTER
    low[lead[letter & (second <= 0x9E)] + 1] += 32
    word, begin = kind != _BLANK, at[:-1][at[:-1] < len(data)]
    first = word.copy()
    first[1:] &= ~word[:-1]
    first[begin] = word[begin]
    words = np.flatnonzero(first)
    odd = np.flatnonzero(np.maximum.reduceat(kind, words) == _OTHER) if len(words) else words
    if len(odd):
        inside = spread(words[odd], np.append(words, len(data))[odd + 1] - words[odd])
        inside = inside[word[inside]]
        kind[inside], low[inside] = _OTHER, data[inside]
    start = kind == _DIGIT
    start[1:] |= kind[1:] != kind[:-1]
    start[begin] = True
    start[:1] = True
    start = np.flatnonzero(start & word)
    rank = np.zeros(len(data) + 1, np.int64)
    np.cumsum(word, out=rank[1:])
    bounds = np.append(rank[start], rank[-1])
    every = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(bounds), pa.py_buffer(low[word]))
    return every, np.searchsorted(start, at)


SHARD = "part int, shard int, start long, n_tokens long, doc_ids array<long>, doc_lengths array<long>, base int, rules binary, rule_lengths binary, sequence binary"


def public_tokenizer(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class _Encoder:
    """Ids of texts. The tokenizer drops white space and treats pieces alone, so that each distinct piece is encoded once."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = self.tokenizer.get_vocab_size()
        one = {m: self.tokenizer.encode(m, add_special_tokens=False).ids for m in MARKS}
        self.sign, self.mark = next((m, ids[0]) for m, ids in one.items() if len(ids) == 1)
        self.model = self.tokenizer.model
        self.short = True
        self.forget()
        long = [self.tokenizer.encode(w, add_special_tokens=False).ids for w in SAMPLE]
        self.short = np.array_equal(self(pa.array(SAMPLE))[0], np.concatenate(long))
        self.forget()

    def forget(self) -> None:
        self.known, self.pool, self.starts, self.uses = pa.array([], pa.large_string()), np.zeros(0, np.uint32), np.zeros(1, np.int64), np.zeros(0, np.int64)

    def trim(self) -> None:
        """Keep the half of the pieces that were used most."""
        keep = np.sort(np.argsort(self.uses, kind="stable")[len(self.uses) // 2 :])
        lengths = self.starts[keep + 1] - self.starts[keep]
        self.pool, self.known, self.uses = self.pool[spread(self.starts[keep], lengths)], self.known.take(pa.array(keep)), self.uses[keep]
        self.starts = np.concatenate([[0], np.cumsum(lengths)])

    def _learn(self, new: pa.Array) -> None:
        names = new.to_pylist()
        short = self.short and SHORT.fullmatch
        ids = [[t.id for t in self.model.tokenize(x if x.isascii() else x.translate(BYTE_SIGNS))] if short and short(x) else None for x in names]
        long = [i for i, x in enumerate(ids) if x is None]
        for i, x in zip(long, self._whole([names[i] for i in long]), strict=True):
            ids[i] = x
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        self.pool = np.concatenate([self.pool, np.fromiter(chain.from_iterable(ids), np.uint32, int(lengths.sum()))])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(lengths)])
        self.known, self.uses = pa.concat_arrays([self.known, new]), np.append(self.uses, np.zeros(len(new), np.int64))

    def _whole(self, words: list[str]) -> list[np.ndarray]:
        """Ids of words from the tokenizer. A mark that is one id stands after every word; words that hold the mark are encoded one by one."""
        plain = [w for w in words if self.sign not in w]
        runs = [f" {self.sign} ".join(plain[i : i + 64]) + f" {self.sign}" for i in range(0, len(plain), 64)]
        ids = np.fromiter(chain.from_iterable(e.ids for e in self.tokenizer.encode_batch_fast(runs, add_special_tokens=False)), np.uint32)
        ends = np.flatnonzero(ids == self.mark)
        if len(ends) != len(plain):
            raise ValueError("the tokenizer does not treat words alone")
        own = iter(np.split(ids, ends + 1)[:-1])
        return [np.array(self.tokenizer.encode(w, add_special_tokens=False).ids, np.uint32) if self.sign in w else next(own)[:-1] for w in words]

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each)."""
        if self.short:
            every, bounds = pieces(texts)
        else:
            words = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
            every, bounds = words.flatten().cast(pa.large_string()), words.offsets.to_numpy() - words.offsets[0].as_py()
        flat = pc.dictionary_encode(every)
        if len(self.known) > CACHED_PIECES:
            self.trim()
        at = pc.fill_null(pc.index_in(flat.dictionary, self.known), -1).to_numpy()
        new = at < 0
        if new.any():
            at = np.where(new, len(self.known) + np.cumsum(new) - 1, at)
            self._learn(flat.dictionary.filter(pa.array(new)))
        indices = flat.indices.to_numpy()
        self.uses[at] += np.bincount(indices, minlength=len(at))
        each = at[indices]
        lengths = self.starts[each + 1] - self.starts[each]
        ids = self.pool[spread(self.starts[each], lengths)]
        return ids, np.diff(np.concatenate([[0], np.cumsum(lengths)])[bounds])


@cache
def _encoder(path: str) -> _Encoder:
    return _Encoder(path)


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... lengths[0] of them, then those of starts[1], and so on."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))


def with_ends(ids: np.ndarray, lengths: np.ndarray, end: int) -> np.ndarray:
    """ids with the end id after each document."""
    out = np.full(len(ids) + len(lengths), end, np.uint32)
    out[np.arange(len(ids)) + np.repeat(np.arange(len(lengths)), lengths)] = ids
    return out


def _chosen(codes: np.ndarray, counts: np.ndarray, most: int) -> np.ndarray:
    """The most frequent pairs of which no symbol stands first in one and second in another: a symbol's most frequent pair says where
    it stands, and a pair of twice the same symbol is that symbol's only one."""
    order = np.lexsort((codes, -counts))[: 4 * most]
    a, b, rank = codes[order] >> 32, codes[order] & 0xFFFFFFFF, np.arange(len(order))
    symbols, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(order)], at[len(order) :]
    first, second = np.full(len(symbols), len(order)), np.full(len(symbols), len(order))
    first[a[::-1]], second[b[::-1]] = rank[::-1], rank[::-1]  # the smallest rank is written last
    good = np.where(a == b, (first[a] == rank) & (second[a] == rank), (first[a] < second[a]) & (second[b] < first[b]))
    return order[good][:most]


def repair(x: np.ndarray, base: int, end: int, max_rules: int = MAX_RULES, min_count: int = MIN_COUNT) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, rules): symbol base + i stands for the two symbols rules[i], each below base + i."""
    x, rules = x.astype(np.int64), [np.zeros((0, 2), np.int64)]
    n_rules = 0
    while len(x) > 1 and n_rules < max_rules:
        codes = (x[:-1] << 32) | x[1:]
        codes[(x[:-1] == end) | (x[1:] == end)] = -1
        s = np.sort(codes)
        edges = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        counts = np.diff(np.concatenate([edges, [len(s)]]))
        often = (counts >= min_count) & (s[edges] >= 0)
        pairs, counts = s[edges][often], counts[often]
        pairs = pairs[_chosen(pairs, counts, min(ROUND_RULES, max_rules - n_rules))]
        if not len(pairs):
            break
        rules.append(np.stack([pairs >> 32, pairs & 0xFFFFFFFF], axis=1))
        order = np.argsort(pairs)
        sorted_pairs = pairs[order]
        slot = lambda c: ((c.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)
        maybe = np.zeros(1 << 20, bool)
        maybe[slot(pairs)] = True
        at = np.flatnonzero(maybe[slot(codes)])
        found = np.minimum(np.searchsorted(sorted_pairs, codes[at]), len(pairs) - 1)
        hit = sorted_pairs[found] == codes[at]
        at, found = at[hit], found[hit]
        # only pairs of two equal symbols can follow one another: take every other one of a run
        run = np.concatenate([[True], np.diff(at) > 1])
        start = np.maximum.accumulate(np.where(run, at, -1))
        even = (at - start) % 2 == 0
        at, found = at[even], found[even]
        x[at] = base + n_rules + order[found]
        keep = np.ones(len(x), bool)
        keep[at + 1] = False
        gain = len(at) / len(x)
        x = x[keep]
        n_rules += len(pairs)
        if gain < MIN_GAIN:
            break
    return x, np.concatenate(rules)


def expansions(rules: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids of all rules' expansions, start of each, length of each)."""
    x, owner = rules.ravel(), np.repeat(np.arange(len(rules)), 2)
    while (deep := x >= base).any():
        n = 1 + deep
        at = np.cumsum(n) - n
        out = np.empty(int(n.sum()), np.int64)
        out[at[~deep]] = x[~deep]
        for k in range(2):
            out[at[deep] + k] = rules[x[deep] - base, k]
        x, owner = out, np.repeat(owner, n)
    lengths = np.bincount(owner, minlength=len(rules))
    return x, np.cumsum(lengths) - lengths, lengths


def _small(x: np.ndarray) -> bytes:
    """As unsigned 16 bits if they suffice, else 32; the first byte says which."""
    wide = len(x) and int(x.max()) > 0xFFFF
    return (b"\4" + x.astype("<u4").tobytes()) if wide else (b"\2" + x.astype("<u2").tobytes())


def _large(x: bytes) -> np.ndarray:
    return np.frombuffer(x, "<u4" if x[:1] == b"\4" else "<u2", offset=1).astype(np.int64)


def decoded(sequence: bytes, rules: bytes, base: int, first: int = 0, n: int | None = None) -> np.ndarray:
    """n ids of a shard from position first on: only symbols whose expansions reach into that range are expanded."""
    x, r = _large(sequence), _large(rules).reshape(-1, 2)
    flat, starts, sizes = expansions(r, base)
    lengths = np.ones(len(x), np.int64)
    rule = x >= base
    lengths[rule] = sizes[x[rule] - base]
    ends = np.cumsum(lengths)
    last = int(ends[-1]) if len(ends) else 0
    stop = last if n is None else min(first + n, last)
    a, b = np.searchsorted(ends, first, "right"), np.searchsorted(ends, stop, "left") + 1
    x, lengths, rule, skip = x[a:b], lengths[a:b], rule[a:b], first - (int(ends[a - 1]) if a else 0)
    pool = np.concatenate([flat, x[~rule]])
    at = np.empty(len(x), np.int64)
    at[rule] = starts[x[rule] - base]
    at[~rule] = len(flat) + np.arange(int((~rule).sum()))
    return pool[spread(at, lengths)][skip : skip + stop - first].astype(np.uint32)


def shards(docs: DataFrame, tokenizer: str, end: int = END_ID, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """The rows of the file format for docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = _encoder(tokenizer), TaskContext.get().partitionId()
        ids: list[np.ndarray] = []
        names: list = []
        lengths: list[int] = []
        done, shard, start = 0, 0, 0

        def close() -> pa.RecordBatch:
            nonlocal shard, start
            x = np.concatenate(ids)
            sequence, rules = repair(x, encode.vocabulary, end)
            row = [part, shard, start, len(x), list(names), list(lengths), encode.vocabulary, _small(rules.ravel()), _small(expansions(rules, encode.vocabulary)[2]), _small(sequence)]
            shard, start = shard + 1, start + len(x)
            ids.clear(), names.clear(), lengths.clear()
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names=["part", "shard", "start", "n_tokens", "doc_ids", "doc_lengths", "base", "rules", "rule_lengths", "sequence"])

        for batch in batches:
            for piece in slices(batch, 1, SLICE_BYTES):
                found, n = encode(piece.column(1))
                every, n = with_ends(found, n, end), n + 1
                at = np.cumsum(n) - n
                i = 0
                while i < len(n):
                    # documents up to the one that fills the shard
                    room = shard_tokens - done
                    j = min(len(n), max(int(np.searchsorted(at[i:] + n[i:] - at[i], room, "right")) + i, i + (done == 0)))
                    if j > i:
                        ids.append(every[at[i] : at[j - 1] + n[j - 1]])
                        names += piece.column(0)[i:j].to_pylist()
                        lengths += n[i:j].tolist()
                        done += len(ids[-1])
                    if j < len(n) or done >= shard_tokens:
                        yield close()
                        done = 0
                    i = j
        if names:
            yield close()

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("tie", F.xxhash64("text"))
    ordered = ordered.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    return ordered.select("doc_id", "text").mapInArrow(run, SHARD)


def write(docs: DataFrame, path: str | None = None, tokenizer: str | None = None, end: int = END_ID, **more) -> str:
    """Encode docs into files at path (by default in the shared folder); returns the path."""
    spark = docs.sparkSession
    path = path or f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/tokens-{uuid.uuid4().hex}"
    shards(docs, tokenizer or public_tokenizer(), end, **more).write.option("compression", "zstd").parquet(path)
    return path


def index(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files: all their ids are decoded.

    A part is what one task wrote; the rows that are broadcast are the parts' totals.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                part, start, names, lengths, base, rules, sequence = (batch.column(k)[i] for k in range(7))
                ids = decoded(sequence.as_py(), rules.as_py(), base.as_py()).astype("<u4")
                n = np.array(lengths.as_py(), np.int64)
                ends = np.cumsum(n)
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(ends - n, ends, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), part.as_py(), np.int32)), names.values, pa.array(start.as_py() + ends - n), pa.array(n), pa.array(crc, pa.int64())], names=["part", "doc_id", "at", "n_tokens", "ids_crc32"])

    files = spark.read.schema(SHARD).parquet(path)
    totals = files.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    rows = files.select("part", "start", "doc_ids", "doc_lengths", "base", "rules", "sequence").mapInArrow(run, "part int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return rows.join(F.broadcast(totals), "part").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, ids) of every document in the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                names, lengths, base, rules, sequence = (batch.column(k)[i] for k in range(5))
                ids = decoded(sequence.as_py(), rules.as_py(), base.as_py()).astype(np.int64)
                offsets = pa.array(np.concatenate([[0], np.cumsum(lengths.as_py())]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([names.values, pa.ListArray.from_arrays(offsets, pa.array(ids))], names=["doc_id", "ids"])

    return spark.read.schema(SHARD).parquet(path).select("doc_ids", "doc_lengths", "base", "rules", "sequence").mapInArrow(run, "doc_id long, ids array<long>")


def report(docs: DataFrame, **more) -> DataFrame:
    """Write docs and read the files back: doc_id, start, n_tokens, ids_crc32."""
    return index(docs.sparkSession, write(docs, **more))
