"""MinHash near-duplicates (6) with sequential Bayesian verification.

A document's set holds the hashes (64 bits) of its distinct word shingles. Equal sets are one class from the start, so that exact
copies cost nothing later. Signatures of one document for each distinct set are cut into bands; documents that agree in a band are
candidates. Long bands, which very similar documents share, go first; shorter ones follow when the classes of these are known. Only
buckets in which classes meet go on. In each of them members are compared with one leader, the member that shares the most bands with
others: in a group of copies of one text that is a text in their midst, the same one in most buckets, so that a group of n makes about
n pairs. At last, in the buckets of the shorter bands in which classes still meet, the members outside a bucket's largest class are
compared with all of it, blocks of signatures against blocks, so that no link between classes is lost. A pair is compared in the
first band that it shares. Pairs don't leave a block: documents that have a likely partner do, meet again with their full sets, and
only confirmed links go on. So a large group of copies that are nearly, but not quite, similar enough takes comparisons but no rows.

A candidate pair is pruned as soon as, after a batch of signature values, the posterior probability of a similarity at or above
the threshold (uniform prior, m of n values equal: a Beta distribution) falls below the chosen miss probability. Survivors are
verified exactly on their full sets.

Defined results: without words or text a set is empty and links with nothing; a text of fewer words than a shingle is one shingle;
rows that repeat a doc_id are one document for links and stay as rows; a row without doc_id has no class (component null, kept);
columns of the documents other than doc_id and text are not read here.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bitmap, has, written
from .words import SPACED, grams, mix, slices, words_of

SHINGLE, THRESHOLD = 5, 0.8
#: Chance that a pair at the threshold shares no band; that pruning drops one.
MISS = 1e-6
ROWS, BATCH = 5, 16
#: Values of a signature, of VALUE bytes each; rows of the longer bands that go first.
HASHES, VALUE, LONG_ROWS = 192, 4, (8,)
#: Bytes of a block of a bucket's members; bytes, or else pairs to compare, that one call of the last step gets at least.
BLOCK_BYTES, CALL_BYTES, CALL_PAIRS = 2 << 20, 8 << 20, 1 << 20
#: Shingles that one set is compared with at a time.
STEP = 1 << 17


def bands_for(threshold: float, miss: float = MISS, rows: int = ROWS) -> int:
    """Bands of so many rows that a pair at the threshold is missed with the given chance at most."""
    return math.ceil(math.log(miss) / math.log(1 - threshold**rows))


def least_matches(threshold: float, miss: float, n: int) -> int:
    """Fewest of n equal values at which the posterior chance of a similarity >= threshold is still at least miss.

    With a uniform prior that chance is P(Binomial(n + 1, threshold) <= m).
    """
    total = 0.0
    for m in range(n + 1):
        total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if total >= miss:
            return m
    return n


def _sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    w = words_of(texts, SPACED)
    first, h = grams(w, k)
    at = np.searchsorted(first, w.doc)
    for i, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)):
        if a < b:
            yield np.unique(h[a:b])
        else:
            own = w.hashes[w.doc[i] : w.doc[i + 1]]
            whole = np.array([len(own)][: len(own)], np.uint64)
            for x in own:
                whole = mix(whole * np.uint64(3) + x)
            yield whole


def signatures(docs: DataFrame, k: int, hashes: int) -> DataFrame:
    """(doc_id, n_shingles, a, b, signature): a and b identify the set, the signature has `hashes` minima (binary)."""
    rng = np.random.default_rng(11)
    multiply = (rng.integers(1, 1 << 32, hashes, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)[:, None]
    add = rng.integers(0, 1 << 32, hashes, dtype=np.uint64).astype(np.uint32)[:, None]

    def minima(s: np.ndarray) -> np.ndarray:
        low, out = (s >> np.uint64(16)).astype(np.uint32), np.full(hashes, 0xFFFFFFFF, np.uint32)
        for i in range(0, len(low), 8192):
            np.minimum(out, (multiply * low[i : i + 8192] + add).min(axis=1), out=out)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for every in batches for x in slices(every, 1)):
            n, ab, sig, last = [], [], [], {}
            for s in _sets(batch.column(1), k):
                n.append(len(s))
                key = (len(s), int(s.sum()) if len(s) else 0, int(np.bitwise_xor.reduce(mix(s ^ np.uint64(0x5851F42D4C957F2D)))) if len(s) else 0)
                ab.append(key[1:])
                if key not in last:
                    last[key] = minima(s) if len(s) else np.zeros(0, np.uint32)
                sig.append(last[key])
            if n:
                two = np.array(ab, np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(two[:, 0]), pa.array(two[:, 1]), pa.array([x.tobytes() for x in sig], pa.binary())], names=["doc_id", "n_shingles", "a", "b", "signature"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_shingles long, a long, b long, signature binary")


def _matrix(x: pa.Array) -> np.ndarray:
    """A row of values for each signature."""
    offsets = np.frombuffer(x.buffers()[1], np.int32)[x.offset : x.offset + len(x) + 1]
    return np.frombuffer(x.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]].view(np.uint32).reshape(len(x), -1)


def _asked(reps: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, signature) of the ids (id): a bitmap of fixed size keeps most others from being moved."""
    bits = bitmap(ids, "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(has(bits, batch.column(0).to_numpy(zero_copy_only=False))))

    return reps.select(F.col("doc_id").alias("id"), "signature").mapInArrow(run, "id long, signature binary")


def _likely(p: np.ndarray, q: np.ndarray, threshold: float, miss: float, batch_size: int) -> np.ndarray:
    """Which rows of the signatures p and q (one row, or as many) leave a similarity at the threshold possible, batch after batch."""
    alive, equal = np.arange(len(q)), np.zeros(len(q), np.int64)
    for a in range(0, q.shape[1], batch_size):
        b = min(a + batch_size, q.shape[1])
        equal = equal + ((p[:, a:b] if len(p) == 1 else p[alive, a:b]) == q[alive, a:b]).sum(axis=1)
        keep = equal >= least_matches(threshold, miss, b)
        alive, equal = alive[keep], equal[keep]
    return alive


def shingle_sets(docs: DataFrame, k: int, asked: np.ndarray) -> DataFrame:
    """(doc_id, shingles): the whole sorted set, as bytes, of the documents whose id's place in `asked` (a bitmap) is set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = (b.filter(pa.array(has(asked, b.column(0).to_numpy(zero_copy_only=False)))) for b in batches)
        for batch in (x for every in some for x in slices(every, 1)):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in _sets(batch.column(1), k)], pa.binary())], names=["doc_id", "shingles"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null").mapInArrow(run, "doc_id long, shingles binary")


def pruned(pairs: DataFrame, reps: DataFrame, threshold: float, miss: float = MISS, batch_size: int = BATCH) -> DataFrame:
    """The pairs (x, y) whose signatures leave a similarity at the threshold possible."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            p, q = _matrix(batch.column(2)), _matrix(batch.column(3))
            alive = _likely(p, q, threshold, miss, batch_size)
            yield batch.select([0, 1]).take(pa.array(alive))

    sigs = _asked(reps, pairs.select(F.col("x").alias("id")).union(pairs.select("y")))
    one = lambda c: sigs.select(F.col("id").alias(c), F.col("signature").alias(f"sig_{c}"))
    return pairs.join(one("x"), "x").join(one("y"), "y").select("x", "y", "sig_x", "sig_y").mapInArrow(run, "x long, y long")


def _sets_of(docs: DataFrame, k: int, ids: DataFrame) -> DataFrame:
    """(id, shingles) of the documents of these ids (id), written. Texts are not moved: a bitmap leaves the asked ones and few others."""
    asked = ids.distinct()
    sets = shingle_sets(docs.select("doc_id", "text"), k, bitmap(asked, "id")).withColumnRenamed("doc_id", "id")
    return written(sets.join(asked, "id", "left_semi").dropDuplicates(["id"]), "sets")


def verified(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (x, y) with 100 * intersection >= percent * union of their full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i, (p, q) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                s, t = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
                both = np.sort(np.concatenate([s, t]))
                common = int((both[1:] == both[:-1]).sum())
                if 100 * common >= percent * (len(s) + len(t) - common):
                    keep.append(i)
            yield batch.select([0, 1]).take(pa.array(keep, pa.int64()))

    sets = _sets_of(docs, k, pairs.select(F.col("x").alias("id")).union(pairs.select("y")))
    one = lambda c: sets.select(F.col("id").alias(c), F.col("shingles").alias(f"set_{c}"))
    return pairs.join(one("x"), "x").join(one("y"), "y").select("x", "y", "set_x", "set_y").mapInArrow(run, "x long, y long")


def components(links: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable over links (x, y), for every id that has a link.

    Smallest labels spread over links and are then replaced by their own labels, until none changes; each step is written.
    """
    edges = written(links.select("x", "y").union(links.select("y", "x")).distinct(), "edges")
    labels = written(edges.groupBy(F.col("x").alias("id")).agg(F.min("y").alias("m")).select("id", F.least("id", "m").alias("component")), "labels")
    while True:
        near = edges.join(labels, edges.y == labels.id).groupBy("x").agg(F.min("component").alias("m"))
        step = labels.join(near, labels.id == near.x).select("id", F.least("component", "m").alias("next"), F.col("component").alias("before"))
        step = written(step, "step")
        of = step.select(F.col("id").alias("next"), F.col("next").alias("component"))
        moved = written(step.join(of, "next").select("id", "component", (F.col("component") != F.col("before")).alias("moved")), "labels")
        labels = moved.select("id", "component")
        if not moved.where("moved").limit(1).count():
            return labels


def _buckets(reps: DataFrame, rows: int, bands: int) -> DataFrame:
    """(bucket, band, id): the bands of signatures that two documents share. Others are left out by a bitmap of fixed size before they are
    moved, but for a few that meet nobody."""

    def keys(bits: np.ndarray | None) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sig = _matrix(batch.column(1))
                n = len(sig)
                h = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (n, bands))
                for k in range(rows):
                    h = mix(h * np.uint64(0x9E3779B97F4A7C15) + sig[:, k : rows * bands : rows].astype(np.uint64))
                h, ids, band = h.ravel(), np.repeat(batch.column(0).to_numpy(), bands), np.tile(np.arange(bands, dtype=np.int32), n)
                keep = slice(None) if bits is None else np.flatnonzero(has(bits, h))
                yield pa.RecordBatch.from_arrays([pa.array(h[keep].view(np.int64)), pa.array(band[keep]), pa.array(ids[keep])], names=["bucket", "band", "id"])

        return reps.select("doc_id", "signature").mapInArrow(run, "bucket long, band int, id long")

    shared = keys(None).groupBy("bucket").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a < b")
    return keys(bitmap(shared, "bucket"))


def _meeting(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(bucket, band, id, component, n) of the rows (bucket, band, id) in buckets of n members in which classes meet."""
    rows = written(rows.join(labels, "id", "left").select("bucket", "band", "id", F.coalesce("component", "id").alias("component")), "classed")
    some = rows.groupBy("bucket").agg(F.min("component").alias("c0"), F.max("component").alias("c1"), F.count("*").alias("n"))
    # written, so that the rows of a hot bucket can be split in the join
    return rows.join(written(some.where("c0 < c1").select("bucket", "n"), "some"), "bucket")


def _led(met: DataFrame) -> DataFrame:
    """(bucket, band, id, component, leader, leader_component): each bucket's leader is the member whose buckets are largest in all."""
    own = met.groupBy("id").agg(F.first("component").alias("component"), F.sum("n").alias("near"), F.collect_list(F.struct("bucket", "band")).alias("buckets"))  # a few dozen buckets at most
    rows = written(own.select("id", "component", "near", F.inline("buckets")), "met")
    leaders = rows.groupBy("bucket").agg(F.max_by(F.struct("id", "component"), F.struct("near", F.xxhash64("id"))).alias("l"))
    leaders = written(leaders.select("bucket", F.col("l.id").alias("leader"), F.col("l.component").alias("leader_component")), "leaders")
    return rows.select("bucket", "band", "id", "component").join(leaders, "bucket")


def links(docs: DataFrame, reps: DataFrame, k: int, percent: int, levels: list[tuple[int, int]]) -> DataFrame:
    """(id, component) of every distinct set that has a link. reps: doc_id, signature of one document for each set."""
    labels = reps.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("component")).where("false")
    found = None

    def confirmed(new: DataFrame) -> None:
        nonlocal found, labels
        new = written(new, "links")
        if new.limit(1).count():
            found = new if found is None else found.union(new)
            labels = components(found)

    for rows, bands in levels:
        led = written(_led(_meeting(_buckets(reps, rows, bands), labels)), "led")
        pairs = led.where("component != leader_component").select(F.col("leader").alias("x"), F.col("id").alias("y")).distinct()
        confirmed(verified(written(pruned(written(pairs, "pairs"), reps, percent / 100), "survivors"), docs, k, percent))
    # leaders have been compared with all of their buckets
    rest = written(_meeting(led.where("id != leader").select("bucket", "band", "id"), labels), "rest")
    confirmed(_across(rest, docs, reps, k, percent, rows, bands))
    return labels


def _close(own: np.ndarray, others: list[np.ndarray], percent: int) -> np.ndarray:
    """Which of the other sets have 100 * intersection >= percent * union with this one, some of them at a time."""
    size = np.array([len(s) for s in others], np.int64)
    common, ends = np.zeros(len(others), np.int64), np.cumsum(size)
    i = 0
    while i < len(others):
        j = max(i + 1, int(np.searchsorted(ends, ends[i] - size[i] + STEP, "right")))
        every = np.concatenate(others[i:j])
        at = np.minimum(np.searchsorted(own, every), len(own) - 1)
        common[i:j] = np.add.reduceat(own[at] == every, np.cumsum(size[i:j]) - size[i:j])
        i = j
    return np.flatnonzero(100 * common >= percent * (len(own) + size - common))


def _across(met: DataFrame, docs: DataFrame, reps: DataFrame, k: int, percent: int, rows: int, bands: int) -> DataFrame:
    """The links (x, y) among members of a bucket that are of different classes, from the buckets (bucket, band, id, component)."""
    columns = met.select("bucket", "band", "id", "component")
    size = F.lit(VALUE * max(HASHES, rows * bands) + 64)
    likely = _compared(columns.withColumn("size", size), _asked(reps, columns.select("id")).withColumn("shingles", F.lit(None).cast("binary")), percent, rows, bands, "bucket long, id long")
    some = written(columns.join(written(likely.distinct(), "likely"), ["bucket", "id"], "left_semi"), "some")
    sets = _sets_of(docs, k, some.select("id"))
    sized = some.join(sets.select("id", (F.length("shingles") + size).alias("size")), "id")
    return _compared(sized, _asked(reps, some.select("id")).join(sets, "id"), percent, rows, bands, "x long, y long").distinct()


def _compared(members: DataFrame, content: DataFrame, percent: int, rows: int, bands: int, schema: str, miss: float = MISS) -> DataFrame:
    """What comparisons of members (bucket, band, id, component, size) across classes find: those (bucket, id) that have a likely
    partner, or, with full sets, links (x, y). content: id, signature, shingles; it is moved when it is known where to.

    A bucket's members are dealt to blocks, and those outside its largest class once more. Each block of the latter meets each block
    of all, and its members are compared with those of other classes. Where few members are outside, they are one block, so that all
    others are moved once.
    """
    links = schema.startswith("x")

    def run(group: pa.Table) -> pa.Table:
        c = {name: group.column(name).combine_chunks() for name in group.column_names}
        bucket, band, block, asks, ids, of = (c[name].to_numpy(zero_copy_only=False) for name in ("bucket", "band", "block", "asks", "id", "component"))
        sig, order = _matrix(c["signature"]), np.lexsort((block, bucket))
        edges = np.flatnonzero(np.concatenate([[True], (bucket[order][1:] != bucket[order][:-1]) | (block[order][1:] != block[order][:-1]), [True]]))
        sets = [np.frombuffer(x, np.uint64) for x in c["shingles"].to_pylist()] if links else []
        out, marked = [], np.zeros(len(ids), bool)
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            own = order[a:b]
            right = own[~asks[own]]
            for x in own[asks[own]]:
                y = right[of[right] != of[x]]
                y = y[_likely(sig[[x]], sig[y], percent / 100, miss, 3 * BATCH)]
                shared = (sig[y, : rows * bands] == sig[x, : rows * bands]).reshape(len(y), bands, rows).all(axis=2)
                y = y[shared.argmax(axis=1) == band[x]]
                if links:
                    y = y[_close(sets[x], [sets[i] for i in y], percent)]
                    if len(y):
                        out.append(np.sort(np.stack([ids[y], np.full(len(y), ids[x])], axis=1), axis=1))
                elif len(y):
                    marked[y] = marked[x] = True
            if not links:  # documents with a likely partner, not the pairs of them
                hit = np.unique(ids[own[marked[own]]])
                out.append(np.stack([np.full(len(hit), bucket[own[0]]), hit], axis=1))
                marked[own] = False
        pairs = np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 2), np.int64)
        return pa.table(dict(zip(("x", "y") if links else ("bucket", "id"), (pa.array(v, pa.int64()) for v in pairs.T), strict=True)))

    members = written(members, "members")
    sizes = members.groupBy("bucket", "component").agg(F.count("*").alias("c"), F.sum("size").alias("bytes"))
    most = F.max_by(F.struct("component", "c", "bytes"), F.struct("c", "component"))
    blocks = lambda c: F.greatest(F.lit(1), F.ceil(c / BLOCK_BYTES)).cast("int")
    buckets = sizes.groupBy("bucket").agg(most.alias("m"), F.sum("c").alias("c"), F.sum("bytes").alias("bytes"))
    buckets = buckets.select("bucket", F.col("m.component").alias("largest"), blocks(F.col("bytes") - F.col("m.bytes")).alias("p"), blocks(F.col("bytes")).alias("q"), ((F.col("c") - F.col("m.c")) * F.col("c")).alias("pairs"), (F.col("bytes") * blocks(F.col("bytes") - F.col("m.bytes")) + (F.col("bytes") - F.col("m.bytes")) * blocks(F.col("bytes"))).alias("moved"))
    buckets = written(buckets, "buckets")
    place = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    tile = lambda i, j, asks: F.struct((i * F.col("q") + j).alias("block"), F.lit(asks).alias("asks"))
    right = F.transform(F.sequence(F.lit(0), F.col("p") - 1), lambda i: tile(i, place("q"), False))
    left = F.transform(F.sequence(F.lit(0), F.col("q") - 1), lambda j: tile(place("p"), j, True))
    dealt = members.join(buckets, "bucket").select("bucket", "band", "id", "component", F.inline(F.when(F.col("component") == F.col("largest"), right).otherwise(F.concat(right, left))))
    pairs, moved = buckets.agg(F.coalesce(F.sum("pairs"), F.lit(0)), F.coalesce(F.sum("moved"), F.lit(0))).first()
    calls = 1 + max(pairs // CALL_PAIRS, moved // CALL_BYTES)
    # as many partitions as the comparisons need, however few bytes there are
    return dealt.withColumn("call", F.pmod(F.xxhash64("bucket", "block"), F.lit(calls))).join(content.hint("merge"), "id").repartition(min(calls, 1 << 12), "call").groupBy("call").applyInArrow(run, schema)


def classes(docs: DataFrame, k: int = SHINGLE, percent: int = round(100 * THRESHOLD), rows: int = ROWS, miss: float = MISS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row for each row of docs.

    component_id: the smallest doc_id reachable over links of 100 * intersection >= percent * union; kept: it is the row's own.
    """
    bands = bands_for(percent / 100, miss, rows)
    levels = [(r, HASHES // r) for r in LONG_ROWS] + [(rows, bands)]
    every = written(signatures(docs, k, max(HASHES, rows * bands)), "signatures")
    sets = every.where("n_shingles > 0 and doc_id is not null")
    # written, so that the rows of a hot set can be split in the join
    equal = written(sets.groupBy("n_shingles", "a", "b").agg(F.min("doc_id").alias("rep")), "equal")
    members = written(sets.select("doc_id", "n_shingles", "a", "b").join(equal, ["n_shingles", "a", "b"]).select("doc_id", "n_shingles", "rep"), "members")
    reps = sets.join(members.where("doc_id = rep").select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "signature").dropDuplicates(["doc_id"])
    labels = links(docs, written(reps, "reps"), k, percent, levels)
    linked = members.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    alone = every.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def one_of_each(docs: DataFrame, **more) -> DataFrame:
    """docs with one document of each class: the one with the smallest doc_id; of rows that repeat it, one. Rows without doc_id stay."""
    kept = classes(docs, **more).where("kept and doc_id is not null").select(F.col("doc_id").alias("_id")).distinct()
    one = docs.join(kept, docs["doc_id"].cast("long") == kept["_id"], "left_semi").dropDuplicates(["doc_id"])
    return one.union(docs.where("doc_id is null"))
