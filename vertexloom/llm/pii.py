"""Personal data (8): base patterns, and spans found by weak supervision, with DataFrame functions only.

Four kinds have patterns of their own (email, ip, card, phone) and are always reported. Secrets have none: candidates are long runs of
letters, digits and signs, and whatever is assigned to a word of the gazetteer. Labelers vote on each candidate: patterns of known key formats, a gazetteer of words before it, its
context (an assignment, quotes) and its make-up. Expectation-maximisation over the patterns of votes estimates how reliable each labeler
is and how likely each candidate is a secret; with these likelihoods as labels a naive Bayes classifier over the features of spans is
trained, and it decides. Votes and features are counted by Spark; the driver sees one row for each pattern of votes (3 ^ labelers at
most) and for each value of a feature.

Positions come from splitting a text at the matches of a pattern: the lengths of gaps and matches add up. Patterns are written so that a
run of characters is read once, also where it is very long.

Defined results: a null text is empty; positions are code points, the end exclusive; matches that fail a check (a part of an ip above
255, digits of a card or phone, Luhn) are dropped and not retried; without candidates no model is fitted and nothing is added; a
candidate that overlaps a base span is none; repeated rows are judged alike; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import packed, unpacked, written

#: In the order in which spans are listed; the last kind is learned.
BASE_KINDS = ["email", "ip", "card", "phone"]
SECRET = "secret"

_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"
_CARD = r"[0-9](?:[\x20-]?[0-9])++"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: (pattern, what a text must match to be searched at all)
PATTERNS = {
    "email": (_EMAIL, r"@"),
    "ip": (_IP, r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"),
    "card": (_CARD, r"[0-9](?:[\x20-]?[0-9]){15}"),
    "phone": (_PHONE, r"\+[0-9]"),
}
#: A candidate: a run of at least 16 such characters with a digit in it.
_CANDIDATE = r"(?<![A-Za-z0-9_/+-])(?=[A-Za-z_/+-]*+[0-9])[A-Za-z0-9_/+-]{16,}+"
#: Matches whose places are added up one by one; more are taken in runs of so many.
_RUN = 64
GAZETTEER = ["token", "password", "passwd", "pwd", "secret", "key", "apikey", "api_key", "access_key", "credential", "auth", "bearer", "pin", "passcode"]
_NAMES = "(?i:" + "|".join(sorted(GAZETTEER)) + ")"
#: A shorter or wordlike candidate: what stands behind a word of the gazetteer and an equals sign, or a colon if it is quoted or has a digit.
_BEFORE, _VALUE = rf"(?<![A-Za-z_]){_NAMES}[\"']{{0,1}}[\x20\t]{{0,2}}", r"[^\s\"',;=:]{4,}+"
_ASSIGNED = rf"(?:(?<={_BEFORE}=[\x20\t]{{0,2}}[\"']{{0,1}})|(?<={_BEFORE}:[\x20\t]{{0,2}}[\"'])|(?<={_BEFORE}:[\x20\t]{{0,2}})(?=[^\s0-9]*+[0-9])){_VALUE}"
_ASSIGNMENT = rf"{_NAMES}[\"']?[\x20\t]{{0,2}}[=:]"
#: Code points before a candidate that labelers look at.
CONTEXT = 24
VOTERS = ["format", "gazetteer", "assignment", "quotes", "mixture"]
ROUNDS, SMOOTH, DECIDE = 50, 0.5, 0.5


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    one = lambda c: c.cast("int")
    values = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, one(c)).when(c > "4", 2 * one(c) - 9).otherwise(2 * one(c)))
    return F.aggregate(values, F.lit(0), lambda a, x: a + x) % 10 == 0


def passes(kind: str, x: Column) -> Column:
    """Whether a match of a base pattern is kept."""
    n = F.length(_digits(x))
    if kind == "ip":
        return F.forall(F.split(x, r"\."), lambda p: p.rlike("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return n.between(16, 19) & F.when(n.between(16, 19), luhn(_digits(x))).otherwise(False)
    return n.between(8, 15) if kind == "phone" else F.lit(True)


def matches(text: str, pattern: str, first: str) -> Column:
    """array<struct<start, end, x>>: leftmost matches of a pattern that do not overlap, in texts that match `first`."""
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    both = F.zip_with(F.slice(gaps, F.lit(1), F.size(hits)), hits, lambda g, h: F.struct(F.char_length(g).alias("g"), h.alias("h")))
    none = F.expr("cast(array() as array<struct<start:int,end:int,x:string>>)")
    numbers = F.expr("cast(array() as array<int>)")

    def step(a: Column, p: Column) -> Column:
        begin = a["at"] + p["g"]
        end = begin + F.char_length(p["h"])
        return F.struct(end.alias("at"), F.array_append(a["out"], F.struct(begin.alias("start"), end.alias("end"), p["h"].alias("x"))).alias("out"))

    def placed(p: Column, at: Column) -> Column:
        return F.aggregate(p, F.struct(at.alias("at"), none.alias("out")), step, lambda a: a["out"])

    def in_runs(all_: Column) -> Column:
        # an array of runs, their lengths in the text, where each begins: none of the arrays that grow by steps is long
        runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / _RUN).cast("int")), lambda i: F.slice(all_, i * _RUN + 1, F.lit(_RUN)))
        length = lambda r: F.aggregate(r, F.lit(0), lambda a, p: a + p["g"] + F.char_length(p["h"]))
        more = lambda a, n: F.struct((a["at"] + n).alias("at"), F.array_append(a["out"], a["at"]).alias("out"))
        begins = lambda r: F.aggregate(F.transform(r, length), F.struct(F.lit(0).alias("at"), numbers.alias("out")), more, lambda a: a["out"])
        return F.flatten(F.get(F.transform(F.array(runs), lambda r: F.zip_with(r, begins(r), placed)), F.lit(0)))

    found = F.get(F.transform(F.array(both), lambda m: F.when(F.size(m) <= _RUN, placed(m, F.lit(0))).otherwise(in_runs(m))), F.lit(0))
    return F.when(F.col(text).rlike(first), found).otherwise(none)


def base_spans(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with text never null and an array of spans (start, end, x) named after each base kind."""
    df = docs.withColumn("text", F.coalesce("text", F.lit("")))
    for kind in BASE_KINDS:
        df = df.withColumn(kind, _kept(kind))
    return df


def _kept(kind: str) -> Column:
    return F.filter(matches("text", *PATTERNS[kind]), lambda s: passes(kind, s["x"]))


def candidates(df: DataFrame) -> DataFrame:
    """df with `found`: array of (start, end, x, before, after) of the candidates that overlap no base span."""
    spans = F.flatten(F.array(*[F.transform(k, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))) for k in BASE_KINDS]))
    apart = lambda s, of: ~F.exists(of, lambda b: (b["start"] < s["end"]) & (b["end"] > s["start"]))
    df = df.withColumn("_base", spans).withColumn("_long", F.filter(matches("text", _CANDIDATE, _CANDIDATE), lambda s: apart(s, "_base")))
    assigned = F.filter(matches("text", _ASSIGNED, _ASSIGNMENT), lambda s: apart(s, "_base") & apart(s, "_long"))
    clear = F.array_sort(F.concat("_long", assigned))

    def context(s: Column) -> Column:
        a = F.greatest(s["start"] - CONTEXT, F.lit(0))
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), s["x"].alias("x"), F.substring("text", a + 1, s["start"] - a).alias("before"), F.substring("text", s["end"] + 1, F.lit(2)).alias("after"))

    return df.withColumn("_clear", clear).withColumn("found", F.transform("_clear", context)).drop("_base", "_long", "_clear")


def votes(x: Column, before: Column, after: Column) -> dict[str, Column]:
    """Each labeler's vote on a candidate: 1 a secret, -1 none, 0 no opinion."""
    words = F.filter(F.split(F.lower(before), "[^a-z_]+"), lambda w: w != "")
    last = F.element_at(F.concat(F.array(F.lit("")), words), -1)
    n, digits = F.length(x), F.length(_digits(x))
    return {
        "format": F.when(x.rlike(r"^(?:[0-9a-f]{18,}|[0-9A-F]{18,}|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{30,}|sk-[A-Za-z0-9]{20,})$"), 1).when(x.rlike(r"^[0-9.+/-]+$|^[A-Za-z.-]+[0-9]{1,4}$"), -1).otherwise(0),
        "gazetteer": F.when(last.isin(GAZETTEER), 1).otherwise(F.when(before.rlike("[A-Za-z]"), -1).otherwise(0)),
        "assignment": F.when(before.rlike(r"[=:]\s*[\"']?$"), 1).when(before.rlike(r"[\p{L},.]\s+$"), -1).otherwise(0),
        "quotes": F.when(before.rlike("[\"']$") & after.rlike("^[\"']"), 1).otherwise(0),
        "mixture": F.when((digits * 10 >= n * 2) & (digits * 10 <= n * 9), 1).when(digits * 10 < n, -1).otherwise(0),
    }


def span_features(x: Column, before: Column, after: Column) -> dict[str, Column]:
    """What the classifier sees of a candidate, as a few values each."""
    n = F.length(x)
    return {
        "length": F.least(F.floor(n / 8), F.lit(8)).cast("string"),
        "digits": F.floor(10 * F.length(_digits(x)) / n).cast("string"),
        "letters": F.when(x.rlike("[a-z]") & x.rlike("[A-Z]"), "both").when(x.rlike("[a-z]"), "low").when(x.rlike("[A-Z]"), "up").otherwise("none"),
        "signs": F.when(x.rlike("[/+.]"), "other").when(x.rlike("[_-]"), "joined").otherwise("none"),
        "left": F.when(F.length(before) == 0, "").otherwise(F.regexp_replace(F.regexp_replace(F.substring(before, -2, 2), r"\p{L}", "a"), "[0-9]", "9")),
        "right": F.regexp_replace(F.regexp_replace(F.substring(after, 1, 1), r"\p{L}", "a"), "[0-9]", "9"),
        "assigned": before.rlike("[=:]").cast("string"),
    }


class SpanModel:
    """What EM found (labeler -> vote -> probability under each class) and the classifier's log odds."""

    def __init__(self) -> None:
        self.prior = 0.5
        self.reliability: dict[str, dict[int, tuple[float, float]]] = {}
        self.odds: dict[str, dict[str, float]] = {}
        self.bias = -math.inf

    def posterior(self, pattern: list[int]) -> float:
        a, b = math.log(self.prior), math.log(1 - self.prior)
        for name, v in zip(VOTERS, pattern, strict=True):
            p, q = self.reliability[name].get(v, (0.5, 0.5))
            a, b = a + math.log(p), b + math.log(q)
        return 1 / (1 + math.exp(min(700.0, b - a)))

    def probability(self, x: Column, before: Column, after: Column) -> Column:
        """The classifier's probability that a candidate is a secret."""
        score = F.lit(self.bias if math.isfinite(self.bias) else -700.0)
        for name, value in span_features(x, before, after).items():
            own, table = F, self.odds.get(name, {})
            for v, w in sorted(table.items()):
                own = own.when(value == v, F.lit(w))
            score = score + (own.otherwise(F.lit(0.0)) if table else F.lit(0.0))
        return 1 / (1 + F.exp(-F.greatest(F.lit(-700.0), F.least(F.lit(700.0), score))))


def estimated(patterns: list[tuple[list[int], int]]) -> SpanModel:
    """EM over the patterns of votes with their counts, started from the majority of votes."""
    m = SpanModel()
    weight = [0.9 if sum(v) > 0 else 0.1 if sum(v) < 0 else 0.5 for v, _ in patterns]
    for _ in range(ROUNDS):
        total, yes = sum(c for _, c in patterns), sum(w * c for w, (_, c) in zip(weight, patterns, strict=True))
        m.prior = min(0.999, max(0.001, (yes + SMOOTH) / (total + 2 * SMOOTH)))
        for i, name in enumerate(VOTERS):
            of = {v: [SMOOTH, SMOOTH] for v in (-1, 0, 1)}
            for w, (v, c) in zip(weight, patterns, strict=True):
                of[v[i]][0] += w * c
                of[v[i]][1] += (1 - w) * c
            m.reliability[name] = {v: (a / (yes + 3 * SMOOTH), b / (total - yes + 3 * SMOOTH)) for v, (a, b) in of.items()}
        weight = [m.posterior(v) for v, _ in patterns]
    return m


def fit(found: DataFrame) -> SpanModel:
    """The model for candidates (x, before, after), all of which count."""
    x, before, after = F.col("x"), F.col("before"), F.col("after")
    v, f = votes(x, before, after), span_features(x, before, after)
    counted = written(found.select(*[c.alias(f"v_{k}") for k, c in v.items()], *[c.alias(f"f_{k}") for k, c in f.items()]), "votes")
    patterns = [([r[f"v_{k}"] for k in VOTERS], r["n"]) for r in counted.groupBy(*[f"v_{k}" for k in VOTERS]).agg(F.count("*").alias("n")).collect()]
    if not patterns:
        return SpanModel()
    model = estimated(sorted(patterns))
    w = F
    for p, _ in patterns:
        test = F.lit(True)
        for k, vote in zip(VOTERS, p, strict=True):
            test = test & (F.col(f"v_{k}") == vote)
        w = w.when(test, F.lit(model.posterior(p)))
    each = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"f_{k}").alias("v")) for k in f])
    sums = counted.withColumn("w", w.otherwise(F.lit(0.5))).select(F.explode(each).alias("f"), "w").groupBy("f.k", "f.v").agg(F.sum("w").alias("yes"), F.sum(1 - F.col("w")).alias("no")).collect()
    yes, no = (sum(r[c] for r in sums) / len(f) for c in ("yes", "no"))
    model.bias = math.log((yes + SMOOTH) / (no + SMOOTH))
    for r in sums:
        values = sum(s["k"] == r["k"] for s in sums)
        model.odds.setdefault(r["k"], {})[r["v"]] = math.log((r["yes"] + SMOOTH) / (yes + SMOOTH * values)) - math.log((r["no"] + SMOOTH) / (no + SMOOTH * values))
    return model


def spans(docs: DataFrame) -> DataFrame:
    """docs (doc_id) with arrays of spans (start, end) for every kind, the learned one last."""
    found = written(candidates(base_spans(docs.select("doc_id", "text"))).drop("text"), "spans")
    model = fit(found.select(F.explode("found").alias("c")).select("c.x", "c.before", "c.after"))
    learned = F.filter("found", lambda s: model.probability(s["x"], s["before"], s["after"]) >= DECIDE)
    bare = lambda c: F.transform(c, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    return found.select("doc_id", *[bare(F.col(k)).alias(k) for k in BASE_KINDS], bare(learned).alias(SECRET))


def listed(kinds: list[str]) -> Column:
    """kind:start:end of all spans, by kind and then start, joined by commas."""
    one = lambda k: F.transform(k, lambda s: F.concat(F.lit(f"{k}:"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string")))
    return F.array_join(F.flatten(F.array(*[one(k) for k in kinds])), ",")


def masked(docs: DataFrame, mark: str = "[{}]") -> DataFrame:
    """docs with every span of the text replaced by its kind; other columns stay."""
    numbered = written(packed(docs, "text").withColumn("_row", F.monotonically_increasing_id()), "numbered")
    found = spans(numbered.select(F.col("_row").alias("doc_id"), "text")).withColumnRenamed("doc_id", "_row")
    every = F.array_sort(F.flatten(F.array(*[_named(k, mark) for k in [*BASE_KINDS, SECRET]])))
    joined = numbered.join(found.select("_row", every.alias("_spans")), "_row")
    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("at"))
    step = lambda a, s: F.when(s["start"] < a["at"], a).otherwise(F.struct(F.concat(a["text"], F.substring("text", a["at"] + 1, s["start"] - a["at"]), s["mark"]).alias("text"), s["end"].alias("at")))
    text = F.aggregate("_spans", start, step, lambda a: F.concat(a["text"], F.substring("text", a["at"] + 1, F.char_length("text"))))
    return joined.select(*unpacked(docs.columns, ("text",), text=F.when(F.size("_spans") > 0, text).otherwise(F.col("text"))))


def _named(kind: str, mark: str) -> Column:
    return F.transform(kind, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(mark.format(kind)).alias("mark")))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, the number of spans of each base kind, base_sha256 and all spans."""
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in BASE_KINDS]
    return spans(docs).select("doc_id", *counts, F.sha2(listed(BASE_KINDS).cast("binary"), 256).alias("base_sha256"), listed([*BASE_KINDS, SECRET]).alias("spans"))
