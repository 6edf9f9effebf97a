"""Quality rules (3): a learned decision list, with DataFrame functions only.

Statistics of each text are computed by built-in functions. From labelled documents, sequential covering learns rules for bad
documents: a rule grows by the threshold with the highest information gain on two thirds of the rows, is pruned on the other third, and
covers its rows before the next rule grows. The list becomes one conditional expression of Spark.

Every step of growing is one aggregation over the labelled rows: counts for each feature and bin. The driver only sees these counts.

Defined results: a null text has no words; a text of fewer than eight words has no windows; ties between conditions go to the feature
and threshold that come first; without labels, or with one class only, the list is empty and keeps every document that passes the base;
unlabelled documents and null labels teach nothing; repeated rows count each time.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, WORD, written

WINDOW = 8
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
#: Thresholds tried for each feature; rules of a list; conditions of a rule.
BINS, MAX_RULES, MAX_CONDITIONS = 24, 8, 3
#: A rule must be right on this share of the rows that it covers, and cover so many, on the pruning rows.
MIN_PRECISION, MIN_COVER = 0.95, 5

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def statistics(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns to keep and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_upper, n_distinct of each whole text."""
    df = docs.select(*keep, F.coalesce("text", F.lit("")).alias("_text"))
    df = df.withColumn("_words", F.array_remove(F.split("_text", SPACE + "+"), ""))
    df = df.withColumn("n_words", F.size("_words").cast("long"))
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(WORD))
    df = df.withColumns(
        {
            "word_chars": F.char_length(F.array_join("_words", "")).cast("long"),
            "n_symbols": F.regexp_count("_text", F.lit(f"[{SYMBOLS}]")).cast("long"),
            "n_upper": F.regexp_count("_text", F.lit(r"\p{Lu}")).cast("long"),
            "n_distinct": F.size(F.array_distinct("_words")).cast("long"),
            "_lines": lines,
            "_1": F.transform("_words", lambda w: F.xxhash64(w)),
        }
    )
    df = df.drop("_text", "_words").withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long")).drop("_lines")
    # hashes of 2, 4 and 8 consecutive words, each from two of half the length
    for k in (1, 2, 4):
        n = F.greatest(F.size(f"_{k}") - k, F.lit(0))
        df = df.withColumn(f"_{2 * k}", F.zip_with(F.slice(f"_{k}", F.lit(1), n), F.slice(f"_{k}", F.lit(k + 1), n), lambda a, b: F.xxhash64(a, b))).drop(f"_{k}")
    repeats = F.size(F.array_distinct("_8")) < F.size("_8")
    df = df.withColumn("_sorted", F.when(repeats, F.sort_array(F.transform("_8", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))).drop("_8")
    same = lambda x, i, d: F.coalesce(F.get("_sorted", i + d)["h"] == x["h"], F.lit(False))
    at = F.sort_array(F.transform(F.filter("_sorted", lambda x, i: same(x, i, F.lit(1)) | (same(x, i, F.lit(-1)))), lambda x: x["i"]))
    df = df.withColumn("_at", at).drop("_sorted")
    start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate("_at", start, lambda a, x: F.struct(x.alias("last"), (a["n"] + F.least(F.lit(WINDOW), x - a["last"])).alias("n")), lambda a: a["n"])
    return df.withColumn("n_repeat_words", covered).drop("_at")


def features() -> dict[str, Column]:
    """The learner's features, of the columns that statistics() makes."""
    ratio = lambda a, b: F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0).cast("long")), F.lit(0.0))
    return {
        "n_words": F.col("n_words").cast("double"),
        "mean_word": ratio("word_chars", "n_words"),
        "symbols": ratio("n_symbols", "word_chars"),
        "upper": ratio("n_upper", "word_chars"),
        "distinct": ratio("n_distinct", "n_words"),
        "dup_lines": F.col("n_dup_lines").cast("double"),
        "repeated": ratio("n_repeat_words", "n_words"),
    }


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


@dataclass
class DecisionList:
    """Ordered rules; each is a list of (feature, "<=" or ">", threshold), and the first that holds marks a document bad."""

    rules: list[list[tuple[str, str, float]]] = field(default_factory=list)

    def keeps(self) -> Column:
        of, out = features(), F
        for rule in self.rules:
            out = out.when(conjunction(rule, of), F.lit(False))
        return out.otherwise(F.lit(True)) if self.rules else F.lit(True)

    def __str__(self) -> str:
        return "\n".join(" and ".join(f"{f} {o} {t:.6g}" for f, o, t in r) + ": drop" for r in self.rules)


def conjunction(rule: list[tuple[str, str, float]], of: dict[str, Column]) -> Column:
    out = F.lit(True)
    for f, o, t in rule:
        out = out & (of[f] <= t if o == "<=" else of[f] > t)
    return out


def _gain(p0: float, n0: float, p1: float, n1: float) -> float:
    return p1 * (math.log2(p1 / (p1 + n1)) - math.log2(p0 / (p0 + n0))) if p1 and p0 else 0.0


def learn(labelled: DataFrame, label: str = "bad", bins: int = BINS) -> DecisionList:
    """The decision list for rows that have the columns of statistics(), doc_id and the label (1: bad, 0: good)."""
    of = features()
    names = sorted(of)
    rows = written(labelled.where(F.col(label).isin(0, 1)).select(*[of[f].alias(f) for f in names], F.col(label).cast("int").alias("bad"), (F.pmod(F.xxhash64("doc_id"), F.lit(3)) < 2).alias("grow")), "labelled")
    shares = [i / bins for i in range(1, bins)]
    cuts = rows.agg(*[F.percentile_approx(f, shares, 10_000).alias(f) for f in names]).first()
    edges = {f: sorted(set(cuts[f])) for f in names} if cuts[names[0]] else {}
    own = {f: F.col(f) for f in names}
    out = DecisionList()
    left = rows
    while edges and len(out.rules) < MAX_RULES:
        rule = _grown(left.where("grow"), edges, own)
        rule = _pruned(left.where("not grow"), rule, own)
        if not rule:
            break
        out.rules.append(rule)
        left = left.where(~conjunction(rule, own))
    return out


def _grown(rows: DataFrame, edges: dict[str, list[float]], own: dict[str, Column]) -> list[tuple[str, str, float]]:
    rule: list[tuple[str, str, float]] = []
    while len(rule) < MAX_CONDITIONS:
        # a value's bin is the number of edges below it
        each = F.array(*[F.struct(F.lit(f).alias("f"), F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges[f]]), _below(own[f]))).alias("b")) for f in edges])
        counts = rows.where(conjunction(rule, own)).select(F.explode(each).alias("x"), "bad").groupBy("x.f", "x.b").agg(F.sum("bad").alias("p"), F.sum(1 - F.col("bad")).alias("n")).collect()
        table = {f: [[0, 0] for _ in range(len(edges[f]) + 1)] for f in edges}
        for r in counts:
            table[r["f"]][r["b"]] = [r["p"], r["n"]]
        p0, n0 = (sum(x[k] for x in next(iter(table.values()))) for k in (0, 1))
        if not p0 or not n0:
            break
        best = (1e-9, None)
        for f in sorted(edges):
            p, n = 0, 0
            for e, (dp, dn) in zip(edges[f], table[f], strict=False):
                p, n = p + dp, n + dn
                for o, a, b in (("<=", p, n), (">", p0 - p, n0 - n)):
                    if (g := _gain(p0, n0, a, b)) > best[0]:
                        best = (g, (f, o, e))
        if best[1] is None:
            break
        rule.append(best[1])
    return rule


def _below(value: Column):
    return lambda e: e < value


def _pruned(rows: DataFrame, rule: list[tuple[str, str, float]], own: dict[str, Column]) -> list[tuple[str, str, float]]:
    """The beginning of the rule that does best on rows; empty if it is not right often enough."""
    if not rule:
        return rule
    tests = [conjunction(rule[: k + 1], own) for k in range(len(rule))]
    r = rows.agg(*[F.count_if(t & (F.col("bad") == b)).alias(f"{k}_{b}") for k, t in enumerate(tests) for b in (0, 1)]).first()
    scored = [((r[f"{k}_1"] - r[f"{k}_0"]) / max(1, r[f"{k}_1"] + r[f"{k}_0"]), -k, r[f"{k}_1"], r[f"{k}_0"]) for k in range(len(rule))]
    _, k, p, n = max(scored)
    return rule[: 1 - k] if p >= MIN_COVER and p >= MIN_PRECISION * (p + n) else []


def judged(docs: DataFrame, labels: DataFrame, *keep: str) -> DataFrame:
    """The columns to keep, the statistics, base_failed and kept. labels: doc_id, quality (1 good, 0 bad)."""
    stats = written(statistics(docs, *keep), "statistics")
    known = labels.select(F.col("doc_id").alias("_id"), (1 - F.col("quality")).alias("bad")).where("bad is not null")
    rules = learn(stats.join(known, F.col("doc_id") == F.col("_id")).drop("_id"))
    return stats.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & rules.keeps())


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return judged(docs, labels, "doc_id").select("doc_id", *BASE, "base_failed", "kept")
