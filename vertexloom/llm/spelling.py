"""Spelling variant grouping (13): words one edit apart, found by joining a frontier of states with the edges of a trie.

The trie is a table of edges (node, label, child), a node the hash of its prefix. It has nodes where words part: at every place of the first 32
characters, beyond that at places an eighth apart, so that a very long word has few nodes. There are two of it, of words and of words
backwards. Of two words one edit apart one has the other's first half as it is, or its last half; so each word enters the first
trie at the last node of its own path within its first half, and the second one at that within its last half, and no state stands at a root.

A state is (word, position, node, edits). A level joins all states with the edges of their nodes: a label takes as many characters of the word, one
less or one more, as the edits that it needs add up to one at most. States at the end of a word with one edit are neighbours; the frontier is
written in each level and the levels end when it is empty. A node has few edges however many words pass through it, so a hot
prefix makes many states but no product; Spark splits its states in the join. Pairs are compared as words at last, so that equal hashes can't matter.

A word's form is the near word of the largest count, if that is at least five times its own. Counts grow at least fivefold along
forms, so that chains are short and roots are found by doubling.

Defined results: a null or empty text has no words, a null doc_id counts as the empty text; rows that repeat a doc_id count each; of near
words with equal counts the smallest in code-point order is taken; an empty table, or one without frequent words, gives an empty one; columns other than
doc_id and text are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Letters of words, and the least length and count of a word.
LETTERS, LEAST_LENGTH, LEAST_COUNT = "[a-zÀ-ÿ]", 6, 5
#: One run in so many loses a letter.
LOSE = 199
#: A form has at least so many times the word's count.
FORM = 5
#: Ends a word; no letter.
END = "."
#: The place at which words enter the tries at the earliest.
FIRST = 3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def places(longest: int = 1 << 30) -> list[int]:
    """Places at which the tries can have nodes."""
    out = list(range(FIRST, 33))
    while out[-1] < longest:
        out.append(out[-1] * 9 // 8)
    return out


def vocabulary(docs: DataFrame, least: int = LEAST_COUNT, lose: int | None = LOSE) -> DataFrame:
    """(word, n): words of at least six letters and how often they occur, from least on. lose: one run in so many, by the crc32
    of its document's id and itself, loses a letter first."""
    low = F.translate("text", UPPER, LOWER)
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(low, F.lit(f"{LETTERS}{{{LEAST_LENGTH},}}"), F.lit(0))).alias("run"))
    word: Column = F.col("run")
    if lose:
        at = (F.col("h") % F.length("run")).cast("int")
        shorter = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
        word = F.when(F.col("h") % lose == 0, shorter).otherwise(F.col("run"))
        runs = runs.withColumn("h", F.crc32(F.encode(F.concat("id", F.lit(":"), "run"), "UTF-8")))
    counts = runs.select(word.alias("word")).where(F.length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count("*").alias("n"))
    return counts.where(F.col("n") >= least)


def tries(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, states): edges (node, label, child, near) of both tries, near the word that ends there; states (s, back, pos, node) of
    each word where it enters them. s is the word with its end, backwards where back is true."""
    s = words.select(F.explode(F.array(F.struct(F.col("word").alias("w"), F.lit(False).alias("back")), F.struct(F.reverse("word").alias("w"), F.lit(True).alias("back")))).alias("x"))
    s = s.select(F.concat("x.w", F.lit(END)).alias("s"), "x.back")
    at = F.filter(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in zip(places(), places()[1:], strict=False)]), lambda p: p["a"] < F.length("s"))
    node = F.xxhash64("back", F.substring(F.col("s"), F.lit(1), F.col("a")))
    on = s.select("s", "back", F.inline(at)).withColumn("node", node)
    # nodes where words part, and those at which words enter
    part = F.substring(F.col("s"), F.col("a") + 1, F.col("b") - F.col("a"))
    parting = on.select("node", "a", part.alias("part")).groupBy("node").agg(F.min("part").alias("x"), F.max("part").alias("y"), F.min("a").alias("a")).where(f"x <> y or a = {FIRST}").select("node")
    # places of one word: as many as places() gives for its length
    path = on.select("s", "back", "a", "node").join(parting, "node", "left_semi").groupBy("s", "back").agg(F.sort_array(F.collect_list(F.struct("a", "node"))).alias("path"))
    path = written(path, "spelling-paths")
    step = F.inline(F.transform(F.sequence(F.lit(0), F.size("path") - 1), lambda i: F.struct(F.get("path", i)["a"].alias("a"), F.get("path", i)["node"].alias("node"), F.get("path", i + 1)["a"].alias("b"), F.get("path", i + 1)["node"].alias("child"))))
    word = F.substring(F.col("s"), F.lit(1), F.length("s") - 1)
    edges = path.select("s", "back", step).select(
        "node",
        F.substring(F.col("s"), F.col("a") + 1, F.coalesce(F.col("b"), F.length("s")) - F.col("a")).alias("label"),
        "child",
        F.when(F.col("child").isNull(), F.when(F.col("back"), F.reverse(word)).otherwise(word)).alias("near"),
    )
    half = F.floor((F.length("s") - 1) / 2)
    enters = F.when(F.col("back"), F.length("s") - 1 - half).otherwise(half)
    entry = F.element_at(F.filter("path", lambda p: p["a"] <= enters), -1)
    states = path.select("s", "back", entry.alias("e")).select("s", "back", F.col("e.a").alias("pos"), F.col("e.node").alias("node"), F.lit(0).alias("edits"))
    return written(edges.distinct(), "spelling-edges"), states


def _advanced(states: DataFrame, edges: DataFrame) -> DataFrame:
    """The states after one more edge each: (s, back, pos, node, edits, near), near where a word has ended one edit away."""
    n = F.length("label")
    rest = lambda k: F.substring(F.col("s"), F.col("pos") + 1, n + k)
    cost = lambda k: F.levenshtein("label", rest(k), 1)  # noqa: E731  -1 beyond one
    fits = lambda k: F.col("pos") + n + k <= F.length("s")
    state = lambda k, edits: F.struct((F.col("pos") + n + k).alias("to"), edits.cast("int").alias("used"))
    exact = (F.col("edits") == 1) & (rest(0) == F.col("label"))
    open_ = (F.col("edits") == 0) & ((fits(-1) & (cost(-1) == 1)) | (fits(0) & (cost(0) >= 0)) | (fits(1) & (cost(1) == 1)))
    joined = states.alias("st").join(edges.alias("e"), (F.col("st.node") == F.col("e.node")) & (exact | open_))
    options = F.when(F.col("edits") == 1, F.array(state(0, F.lit(1)))).otherwise(
        F.filter(
            F.array(
                F.when(fits(-1) & (cost(-1) == 1), state(-1, F.lit(1))),
                F.when(fits(0) & (cost(0) >= 0), state(0, cost(0))),
                F.when(fits(1) & (cost(1) == 1), state(1, F.lit(1))),
            ),
            lambda x: x.isNotNull(),
        )
    )
    moved = joined.select("s", "back", F.col("child").alias("node"), "near", F.inline(options))
    ended = F.col("near").isNotNull()
    alive = F.when(ended, (F.col("to") == F.length("s")) & (F.col("used") == 1)).otherwise(F.col("to") < F.length("s"))
    return moved.where(alive).select("s", "back", F.col("to").alias("pos"), "node", F.col("used").alias("edits"), "near")


def neighbours(words: DataFrame) -> DataFrame:
    """(word, near): all pairs of words that differ by one inserted, deleted or replaced code point, in both directions."""
    edges, states = tries(words)
    found: DataFrame | None = None
    while True:
        level = written(_advanced(states, edges), "spelling-frontier")
        ends = level.where("near is not null").select("s", "back", "near")
        found = ends if found is None else found.unionByName(ends)
        states = level.where("near is null").drop("near")
        if states.isEmpty():
            break
    plain = F.substring(F.col("s"), F.lit(1), F.length("s") - 1)
    pairs = found.select(F.when(F.col("back"), F.reverse(plain)).otherwise(plain).alias("word"), "near")
    return pairs.where(F.levenshtein("word", "near", 1) == 1).distinct()


def grouped(words: DataFrame, pairs: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of all words."""
    best = pairs.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near").groupBy("word")
    best = best.agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("best"))
    rows = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(-F.col("best.less") >= FORM * F.col("n"), F.col("best")).alias("best"))
    rows = written(rows.select("word", "n", "n_near", F.col("best.near").alias("form"), (-F.col("best.less")).alias("form_n")), "spelling-forms")
    most = rows.agg(F.max("n")).first()[0] or 0
    roots = rows.where("form is not null").select("word", F.col("form").alias("root"))
    # a chain has at most as many steps as the largest count has fivefold growths
    steps = math.floor(math.log(max(most, 1), FORM)) + 1
    for _ in range(math.ceil(math.log2(max(steps, 1)))):
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        roots = written(roots.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "spelling-roots")
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def report(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of every frequent word."""
    words = written(vocabulary(docs.select("doc_id", "text")), "spelling-words")
    return grouped(words, neighbours(words))
