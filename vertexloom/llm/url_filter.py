"""URL filters (5): host reputation by empirical Bayes, with DataFrame functions only.

Labelled page outcomes are counted for each host. The share of good pages is shrunk through beta-binomial priors: a host's prior has its
registered domain's posterior mean, a domain's prior that of its suffix, a suffix's prior the mean of all. How strong a prior is comes
from the data: from the overdispersion of the groups of a level around their priors (method of moments). A host is blocked when even
the upper bound of its posterior (mean and Z standard deviations) stays below MIN_GOOD.

Rules go first: a rule is a host and a path; it fits its host and all subdomains if the url's path starts with the rule's, and the longest
one wins.

Defined results: a null url, or one without ://, has an empty host and path and is judged like any host; hosts without outcomes have
their domain's or suffix's reputation; without any outcomes all is allowed; outcomes that are null or of unknown pages teach nothing;
repeated pages are judged alike and repeated outcomes count each time; a page without page_id has no outcomes and is judged by its host.
A port does not count for domain and suffix; the host of an IPv4 address is its own domain. Names of two labels that are public suffixes
are given by SUFFIXES.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]
MIN_GOOD, Z = 0.5, 1.645
#: Bounds of the overdispersion, so that a prior weighs between 1 and 999 pages.
LEAST_RHO, MOST_RHO = 0.001, 0.5
#: Public suffixes of two labels; any other suffix is one label.
SUFFIXES = ["ac.uk", "co.uk", "gov.uk", "me.uk", "net.uk", "org.uk", "com.au", "edu.au", "gov.au", "net.au", "org.au", "co.nz", "org.nz", "co.jp", "ne.jp", "or.jp", "ac.jp", "co.kr", "co.in", "co.za", "com.br", "com.mx", "com.ar", "com.cn", "com.tw", "com.hk", "com.sg", "com.tr"]
_PARTS = r"^(?s:.*?)://([^/?#]*)([^?#]*)"


def host(url: str = "url") -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), UPPER, LOWER)


def path(url: str = "url") -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def _name(of: str) -> Column:
    return F.rtrim(F.regexp_replace(of, ":[0-9]*$", ""), F.lit("."))


def _labels(of: str) -> Column:
    """Labels of a host's public suffix; 0 for an IPv4 address."""
    two = F.substring_index(_name(of), ".", -2).isin(SUFFIXES)
    return F.when(_name(of).rlike(r"^[0-9]+(\.[0-9]+){3}$"), 0).when(two, 2).otherwise(1)


def domain(of: str = "host") -> Column:
    """The registered domain: the public suffix and the label before it; the whole name if it has no more."""
    n = _labels(of)
    return F.when(n == 0, _name(of)).when(n == 2, F.substring_index(_name(of), ".", -3)).otherwise(F.substring_index(_name(of), ".", -2))


def suffix(of: str = "host") -> Column:
    n = _labels(of)
    return F.when(n == 0, F.lit("")).when(n == 2, F.substring_index(_name(of), ".", -2)).otherwise(F.substring_index(_name(of), ".", -1))


def rule_of(rules: list[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """(the longest rule that fits, its verdict), or nulls, for columns host and path."""
    name, verdict = F, F
    for rule, what in sorted(rules, key=lambda r: -len(r[0])):
        h, p = rule.split("/", 1)
        fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith("/" + p)
        name, verdict = name.when(fits, F.lit(rule)), verdict.when(fits, F.lit(what))
    return (name.otherwise(F.lit(None)), verdict.otherwise(F.lit(None))) if rules else (F.lit(None).cast("string"), F.lit(None).cast("string"))


def _level(groups: DataFrame, key: str) -> DataFrame:
    """groups (key, k good of n, prior mean m) with the posterior: a and b of a beta distribution, and its mean."""
    spread = F.col("m") * (1 - F.col("m"))
    s = groups.agg(F.sum(F.pow(F.col("k") - F.col("n") * F.col("m"), 2) - F.col("n") * spread).alias("over"), F.sum(F.col("n") * (F.col("n") - 1) * spread).alias("pairs")).first()
    rho = min(MOST_RHO, max(LEAST_RHO, (s["over"] or 0.0) / s["pairs"] if s["pairs"] else LEAST_RHO))
    strength = F.lit(1 / rho - 1)
    a, b = F.col("m") * strength + F.col("k"), (1 - F.col("m")) * strength + F.col("n") - F.col("k")
    return groups.select(key, *[c for c in groups.columns if c not in (key, "m")], a.alias("a"), b.alias("b"), (a / (a + b)).alias("mean"))


def reputation(pages: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(host, n, k, mean, upper) of every host of pages (page_id, host). outcomes: page_id, good (1 or 0)."""
    known = outcomes.where("good is not null").groupBy("page_id").agg(F.sum(F.col("good").cast("long")).alias("k"), F.count("*").alias("n"))
    # whatever the size of a host, its pages are counted before they meet
    counted = pages.join(known, "page_id", "left").groupBy("host").agg(F.coalesce(F.sum("k"), F.lit(0)).cast("double").alias("k"), F.coalesce(F.sum("n"), F.lit(0)).cast("double").alias("n"))
    hosts = written(counted.withColumn("domain", domain()).withColumn("suffix", suffix()), "hosts")
    total = hosts.agg(F.coalesce(F.sum("k"), F.lit(0.0)).alias("k"), F.coalesce(F.sum("n"), F.lit(0.0)).alias("n")).first()
    mean = (total["k"] + 1) / (total["n"] + 2)
    sums = lambda *by: hosts.groupBy(*by).agg(F.sum("k").alias("k"), F.sum("n").alias("n"))
    suffixes = _level(sums("suffix").withColumn("m", F.lit(mean)), "suffix")
    domains = _level(sums("domain", "suffix").join(suffixes.select("suffix", F.col("mean").alias("m")), "suffix"), "domain")
    own = _level(hosts.join(domains.select("domain", F.col("mean").alias("m")), "domain"), "host")
    a, b = F.col("a"), F.col("b")
    upper = F.col("mean") + Z * F.sqrt(a * b / (F.pow(a + b, 2) * (a + b + 1)))
    return own.select("host", "n", "k", "mean", upper.alias("upper"))


def judged(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """pages with host, path, rule, verdict and the posterior bound of the host's share of good pages."""
    own = ["host", "path", "rule", "verdict", "good_mean", "good_upper"]
    pages = pages.drop(*own).withColumn("host", host()).withColumn("path", path())
    known = written(reputation(pages.select("page_id", "host"), outcomes), "reputation")
    rule, verdict = rule_of(rules)
    out = pages.join(known.select("host", F.col("mean").alias("good_mean"), F.col("upper").alias("good_upper")), "host")
    learned = F.when(F.col("good_upper") < MIN_GOOD, F.lit("block")).otherwise(F.lit("allow"))
    return out.withColumn("rule", rule).withColumn("verdict", F.coalesce(verdict, learned))


def report(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict of every page. A label's doc_id is taken for the page's id; good: of quality and not toxic."""
    good = labels.select(F.col("doc_id").alias("page_id"), F.when((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0), 1).when(F.col("quality").isNotNull(), 0).alias("good"))
    return judged(pages.select("page_id", "url"), good).select("page_id", "host", "path", "rule", "verdict")
