"""Mixing sources to target weights (1), with DataFrame functions only.

The words of a source, its documents in a pseudorandom order, are packed into blocks of a fixed number of words. Output shards have a
fixed number of slots. How many slots of a shard each source gets is a multinomial draw, conditioned on the totals that meet the
targets: all slots of all sources go through one keyed permutation, and a slot's place says its shard. The drawn counts deal out the
sources: shard after shard takes so many of the next blocks of a source as it has slots for it, in the order of a keyed permutation of
the source's blocks, a new one for each pass over it; blocks and documents are then joined by index. As the totals are given, the draw
says where words go; how often they are taken follows from the targets. Results name the shard and slot of all that is taken.

Permutations are swap-or-not networks: each round pairs x with (k - x) mod n and swaps by a hash bit of the larger one, so that any n
is permuted without search or state.

Defined results: a null or empty text has size 0 and is taken 0 times; null is a source of its own, the last one; a source without
words has target 0; repeated rows are documents of their own; without documents there are no rows. Equal rows are
interchangeable, so that reruns agree. Columns other than doc_id, source and text are ignored by the digest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, packed, unpacked, written

WEIGHTS = (5, 2, 1)
MAX_PASSES = 3
BLOCK_WORDS = 64
SHARD_SLOTS = 4096
#: Documents of one bucket, within which running sums are made, and fewest buckets.
BUCKET_DOCUMENTS, LEAST_BUCKETS = 20_000, 64
#: Slots that one row of a source stands for before they are dealt out, rows that are made from one, and slots that one task makes.
CHUNK_SLOTS, CHUNKS, TASK_SLOTS = 4096, 4096, 1 << 17
ROUNDS = 12


def permuted(x: Column, n: Column, *key: Column) -> Column:
    """x's image under a pseudorandom permutation of 0 .. n - 1 that the key picks."""

    def turn(x: Column, k: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(k, *key), n) - x, n)
        return F.when(F.xxhash64(k, F.greatest(x, partner), *key).bitwiseAND(F.lit(1).cast("long")) == 0, x).otherwise(partner)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), x, turn)


def sizes(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The columns, with size (words of the whole text), a hash of the text, and a number for each row."""
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")
    return docs.select(*columns, size.alias("_size"), F.xxhash64("text").alias("_hash"), F.monotonically_increasing_id().alias("_row"))


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, passes: int = MAX_PASSES, share: float = 1.0) -> DataFrame:
    """(source, sid, source_size, target) of every source.

    A target is least(passes * size, level * weight); the level is where targets add up to the share of all sizes. Sources
    that stop at their limit are the first in the order of limit / weight, so that running sums in this order find the level.
    """
    by = sized.groupBy("source").agg(F.sum("_size").alias("source_size"))
    every = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("sid") - 1, F.lit(len(weights))) + 1).cast("int"))
    by = by.withColumn("sid", F.row_number().over(every)).withColumn("w", w).withColumn("most", F.lit(float(passes)) * F.col("source_size"))
    order = Window.orderBy(F.col("most") / F.col("w"), "sid")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    left = F.lit(share) * F.sum("source_size").over(whole) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    level = left / (F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    # the level if this source and all after it are below their limits
    found = by.withColumn("at", level).withColumn("fits", F.col("at") * F.col("w") <= F.col("most"))
    final = F.min(F.when(F.col("fits"), F.struct((F.col("most") / F.col("w")).alias("r"), F.col("sid"), F.col("at")))).over(whole)["at"]
    return found.withColumn("final", final).select("source", F.col("sid").cast("long").alias("sid"), "source_size", F.when(F.col("final").isNull(), F.col("most")).otherwise(F.least("most", F.col("final") * F.col("w"))).alias("target"))


def slots(sources: DataFrame, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = 0) -> DataFrame:
    """(shard, slot, sid, block) for every slot of the mix. sources: sid, source_size, target."""
    n_blocks = F.ceil(F.col("source_size") / F.lit(block_words))
    s = sources.where("source_size > 0").select("sid", n_blocks.cast("long").alias("blocks"), F.round(F.col("target") * n_blocks / F.col("source_size")).cast("long").alias("n"))
    running = Window.orderBy("sid")
    s = s.withColumn("first", F.sum("n").over(running) - F.col("n")).withColumn("all", F.sum("n").over(running.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    # sources, then runs of chunks, then chunks, then slots: no array grows with the source, and tasks follow the number of slots
    total, zero = s.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], F.lit(0).cast("long")
    chunk, run = F.lit(CHUNK_SLOTS).cast("long"), CHUNK_SLOTS * CHUNKS
    runs = s.where("n > 0").select("*", F.explode(F.sequence(zero, F.expr(f"(n - 1) div {run}"))).alias("run")).repartition(1 + total // (run * 16), "sid", "run")
    last = F.least(F.expr(f"(n - 1) div {CHUNK_SLOTS}"), (F.col("run") + 1) * CHUNKS - 1)
    chunks = runs.select("*", F.explode(F.sequence(F.col("run") * CHUNKS, last)).alias("chunk")).repartition(1 + total // TASK_SLOTS, "sid", "chunk")
    each = chunks.select("*", F.explode(F.sequence(F.col("chunk") * chunk, F.least(F.col("n"), (F.col("chunk") + 1) * chunk) - 1)).alias("t"))
    place = permuted(F.col("first") + F.col("t"), F.col("all"), F.lit(seed))
    placed = each.select("sid", "blocks", place.alias("place"))
    placed = written(placed.select(F.expr(f"place div {shard_slots}").alias("shard"), F.expr(f"place % {shard_slots}").alias("slot"), "sid", "blocks"), "placed")
    counts = _before(shard_counts(placed), "shard", "n", CHUNKS)
    number = F.row_number().over(Window.partitionBy("shard", "sid").orderBy("slot"))
    dealt = placed.withColumn("number", number).join(counts.hint("merge"), ["shard", "sid"]).withColumn("t", F.col("before") + F.col("number") - 1)
    block = permuted(F.pmod(F.col("t"), F.col("blocks")), F.col("blocks"), F.lit(seed), F.col("sid"), F.expr("t div blocks"))
    return dealt.select("shard", "slot", "sid", block.alias("block"))


def _before(rows: DataFrame, order: str, n: str, width: int) -> DataFrame:
    """rows (sid, order, n) with before: the sum of n over smaller `order` of the sid. Sums of runs of `width` come first, so that no
    task gets all rows of a sid."""
    rows = rows.withColumn("_run", F.expr(f"{order} div {width}"))
    runs = rows.groupBy("sid", "_run").agg(F.sum(n).alias("_n"))
    runs = runs.select("sid", "_run", (F.sum("_n").over(Window.partitionBy("sid").orderBy("_run")) - F.col("_n")).alias("_first"))
    inside = F.sum(n).over(Window.partitionBy("sid", "_run").orderBy(order)) - F.col(n)
    return rows.join(runs.hint("merge"), ["sid", "_run"]).withColumn("before", F.col("_first") + inside).drop("_run", "_first")


def shard_counts(slots: DataFrame) -> DataFrame:
    """(shard, sid, n): the slots of each source in each output shard."""
    return slots.groupBy("shard", "sid").agg(F.count("*").alias("n"))


def pieces(sized: DataFrame, sources: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(_row, sid, block, at, n): the words at .. at + n - 1 of a row that lie in a block of its source.

    A row's place in its source is the sum of the sizes before it: of all earlier buckets, and of the earlier rows of its bucket.
    """
    buckets = max(LEAST_BUCKETS, sized.count() // BUCKET_DOCUMENTS + 1)
    numbers = sources.select(F.col("source").alias("_source"), "sid")
    rows = sized.where("_size > 0").join(numbers, F.col("source").eqNullSafe(F.col("_source"))).select("_row", "doc_id", "_size", "_hash", "sid")
    # rows that agree in id and text are interchangeable; without an id the text decides
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "_hash"), F.lit(buckets)))
    totals = _before(rows.groupBy("sid", "bucket").agg(F.sum("_size").alias("total")), "bucket", "total", CHUNKS).select("sid", "bucket", F.col("before").alias("offset"))
    inside = Window.partitionBy("sid", "bucket").orderBy("doc_id", "_size", "_hash", "_row").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("end", F.sum("_size").over(inside)).join(totals.hint("merge"), ["sid", "bucket"]).select("_row", "sid", "_size", (F.col("offset") + F.col("end") - F.col("_size")).alias("start"))
    spans = placed.select("*", F.explode(F.expr(f"sequence(start div {block_words}, (start + _size - 1) div {block_words})")).alias("block"))
    a = F.greatest("start", F.col("block") * block_words)
    b = F.least(F.col("start") + F.col("_size"), (F.col("block") + 1) * block_words)
    return spans.select("_row", "sid", "block", (a - F.col("start")).alias("at"), (b - a).alias("n"))


def _mixed(sized: DataFrame, block_words: int, shard_slots: int, seed: int, **more) -> tuple[DataFrame, DataFrame]:
    """(sources, pieces with the places, array of (shard, slot), that hold their block).

    Slots come from a few rows of sources, from which Spark would take them for a small table; the hints keep it from broadcasting
    what grows with the documents.
    """
    sources = written(targets(sized, **more), "sources")
    uses = slots(sources, block_words, shard_slots, seed).groupBy("sid", "block").agg(F.array_sort(F.collect_list(F.struct("shard", "slot"))).alias("places"))
    return sources, pieces(sized, sources, block_words).join(uses.hint("merge"), ["sid", "block"])


def _held(place: Column, n: Column) -> Column:
    return F.struct(place["shard"].alias("shard"), place["slot"].alias("slot"), n.alias("n"))


def report(docs: DataFrame, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = 0, **more) -> DataFrame:
    """One row for each document: doc_id, source, size, source_size, target, taken (words that the mix takes, with repeats) and
    slots, the sorted (shard, slot, n) that hold n of its words."""
    sized = written(sizes(docs, ["doc_id", "source"]), "sizes")
    sources, used = _mixed(sized, block_words, shard_slots, seed, **more)
    held = F.array_sort(F.flatten(F.collect_list(F.transform("places", lambda p: _held(p, F.col("n"))))))
    taken = used.groupBy("_row").agg(F.sum(F.col("n") * F.size("places")).alias("taken"), held.alias("slots"))
    s = sources.select(F.col("source").alias("_source"), "source_size", "target")
    out = sized.join(taken.hint("merge"), "_row", "left").join(s, F.col("source").eqNullSafe(F.col("_source")))
    none = F.expr("cast(array() as array<struct<shard:bigint,slot:bigint,n:bigint>>)")
    return out.select("doc_id", "source", F.col("_size").alias("size"), "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"), F.coalesce("slots", none).alias("slots"))


def mixed_documents(docs: DataFrame, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = 0, held: str | None = "slots", **more) -> DataFrame:
    """The mix as documents: for each time that words of a document are taken, a row of its columns with these words as text, and
    held, the (shard, slot, n) that hold the next n words of it. A column of docs of that name is replaced; with None none is added.

    A text that is taken whole stays as it is; of others the taken words are joined by blanks. n_chars, if there, follows the text.
    """
    docs, needed = docs.drop(held) if held else docs, ("doc_id", "source", "text")
    sized = written(sizes(packed(docs, *needed), [*needed, "_rest"]), "sized")
    _, used = _mixed(sized.select("doc_id", "source", "_size", "_hash", "_row"), block_words, shard_slots, seed, **more)
    ranges = used.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("at", "n", "places"))).alias("_ranges"), F.max(F.size("places")).cast("long").alias("_times"))
    rows = sized.join(ranges.hint("merge"), "_row").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_times"))))
    rows = rows.withColumn("_own", F.filter("_ranges", lambda r: F.size(r["places"]) >= F.col("_copy")))
    whole = F.aggregate("_own", F.lit(0).cast("long"), lambda a, r: a + r["n"]) == F.col("_size")
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    some = rows.withColumn("_words", F.when(~whole, words)).withColumn("_text", F.when(whole, F.col("text")).otherwise(F.array_join(F.flatten(F.transform("_own", lambda r: F.slice("_words", (r["at"] + 1).cast("int"), r["n"].cast("int")))), " ")))
    n_chars = {"n_chars": F.char_length("_text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {}
    holds = F.transform("_own", lambda r: _held(F.element_at(r["places"], F.col("_copy").cast("int")), r["n"]))
    return some.select(*unpacked(docs.columns, needed, text=F.col("_text"), **n_chars), *([holds.alias(held)] if held else []))
