"""The contracts in plain Python, one document at a time, and a small table of awkward documents."""

import hashlib
import math
import re
import zlib
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def crc(doc_id, mod):
    return zlib.crc32(str(doc_id).encode() if doc_id is not None else b"") % mod


def words(text):
    return WORD.findall(text or "")


def quality(text):
    w, text = words(text), text or ""
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    n = Counter(grams)
    hit = {j for i, g in enumerate(grams) if n[g] > 1 for j in range(i, i + 8)}
    base = len(w) < 20 or 100 * len(hit) > 30 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit), base


def luhn(d):
    return sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) for i, c in enumerate(reversed(d))) % 10 == 0


def base_spans(text):
    text, out = text or "", []
    digits = lambda x: re.sub("[^0-9]", "", x)
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda x: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda x: all(int(p) <= 255 for p in x.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda x: 16 <= len(digits(x)) <= 19 and luhn(digits(x))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda x: 8 <= len(digits(x)) <= 15),
    ]
    for kind, pattern, ok in kinds:
        out += [(kind, m.start(), m.end()) for m in re.finditer(pattern, text) if ok(m.group())]
    return out


def sha(parts):
    return hashlib.sha256(",".join(parts).encode()).hexdigest()


def word_scores(rows, folds=10):
    """{row number: (n_tokens, n_known, N, base_score)}."""
    tokens = [words((t or "").translate(LOWER)) + [None] for _, t in rows]
    c = Counter(x for (i, _), w in zip(rows, tokens) if crc(i, folds) for x in w)
    n, v = sum(c.values()), len(c)
    return [(len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)) for w in tokens]


def targets(sizes, weights=(5, 2, 1), passes=3):
    """{source: target} by sharing out again and again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        open_ = [s for s in names if s not in full]
        left = total - sum(passes * sizes[s] for s in full)
        t = {s: passes * sizes[s] if s in full else left * w[s] / sum(w[x] for x in open_) for s in names}
        over = {s for s in open_ if t[s] > passes * sizes[s]}
        if not over:
            return t
        full |= over


LONG = " ".join(f"w{i % 997}x{i % 31}" for i in range(30_000))
AWKWARD = [
    (1, None, "en", "a", 0),
    (2, "", "en", "a", 0),
    (3, "   \t\n ", None, None, 0),
    (4, "one", "en", "é", 3),
    (5, "one two", "en", "a", 7),
    (6, LONG, "en", "a", len(LONG)),
    (7, LONG, None, "a", None),
    (8, LONG + " more", "de", "b", 1),
    (9, "mail a.b@c.de, x@y, ip 1.2.3.4 and 999.1.1.1 1.2.3.4.5.6.7.8 card 4111 1111 1111 1111 or 4111 1111 1111 1112 phone +1 (555) 555-5555 +1", "en", "b", 9),
    (10, 'an émile token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" and password=a9ce335683f9772ddc so', "en", "b", 9),
    (10, "a repeated id " * 30, "en", "b", 9),
    (None, "no id " * 40, "fr", "c", 9),
    (12, "line one\nline one\n\nline two\nline one", "en", "c", 9),
    (13, "a b c d e f g h i j k a b c d e f g h i " * 2, "en", "c", 9),
    (14, "éclair ÀÉ 漢字 \u200b \x1c \x00 ok<|endoftext|>x don't İstanbul 12a3", "fr", "c", 9),
    (15, "a" * 60_000, "en", "c", 9),
    (16, "1" * 60_000, "en", "c", 9),
    (17, "Straße Mädchen über schön " * 12, "de", "c", 9),
    (18, "a@b.c_d@e.f %x@y.z.w- +12345678 +1 2", None, "c", 9),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def awkward(spark):
    """The documents, with an extra column whose name clashes with outputs."""
    from pyspark.sql import functions as F

    return spark.createDataFrame(AWKWARD, SCHEMA).withColumn("n_words", F.lit("x")).withColumn("kept", F.lit(3)).withColumn("_row", F.lit(1))


def symbols(text, order):
    """Lower-case letters; every run of others after a letter is a blank; order - 1 blanks before and one after."""
    out, before = [], False
    for c in text or "":
        letter = c.isalpha()
        if letter:
            out.append(c.lower()[0])
        elif before:
            out.append(" ")
        before = letter
    return " " * (order - 1) + "".join(out) + " "


class KneserNey:
    """Interpolated Kneser-Ney over characters, by its definition."""

    def __init__(self, texts, alphabet, order=4):
        self.alphabet, self.order = alphabet, order
        c = Counter(g for t in texts for g in self.grams(t))
        self.counts = {order: c}
        for k in range(order - 1, 0, -1):
            self.counts[k] = Counter(g[1:] for g in self.counts[k + 1])
        self.discount, self.total, self.kinds = {}, {}, {}
        for k, c in self.counts.items():
            n1, n2 = (sum(v == i for v in c.values()) for i in (1, 2))
            self.discount[k] = min(0.9, max(0.1, n1 / max(1, n1 + 2 * n2)))
            self.total[k], self.kinds[k] = Counter(), Counter(g[:-1] for g in c)
            for g, n in c.items():
                self.total[k][g[:-1]] += n

    def grams(self, text):
        s = symbols(text, self.order)
        return [s[i : i + self.order] for i in range(len(s) - self.order + 1)]

    def p(self, g):
        if not g:
            return 1 / self.alphabet
        k, rest = len(g), self.p(g[1:])
        if not self.total[k][g[:-1]]:
            return rest
        c, d, total = self.counts[k][g], self.discount[k], self.total[k][g[:-1]]
        return max(c - d, 0) / total + d * self.kinds[k][g[:-1]] / total * rest

    def entropy(self, text):
        g = self.grams(text)
        return -sum(math.log(self.p(x)) for x in g) / len(g)


def reputations(hosts, outcomes):
    """{host: upper bound of its share of good pages} from [(host, domain, suffix)] and {host: (good, all)}, with priors host from domain from suffix."""
    by = [{}, {}, {}]
    for h, d, s in hosts:
        k, n = outcomes.get(h, (0, 0))
        for level, key in enumerate((h, d, s)):
            a = by[level].get(key, (0, 0))
            by[level][key] = (a[0] + k, a[1] + n)
    all_k, all_n = (sum(v[i] for v in by[2].values()) for i in (0, 1))

    def level(groups, prior):
        over = sum((k - n * prior[g]) ** 2 - n * prior[g] * (1 - prior[g]) for g, (k, n) in groups.items())
        pairs = sum(n * (n - 1) * prior[g] * (1 - prior[g]) for g, (k, n) in groups.items())
        rho = min(0.5, max(0.001, over / pairs if pairs else 0.001))
        s = 1 / rho - 1
        return {g: (prior[g] * s + k, (1 - prior[g]) * s + n - k) for g, (k, n) in groups.items()}

    mean = lambda ab: ab[0] / (ab[0] + ab[1])
    suffixes = level(by[2], dict.fromkeys(by[2], (all_k + 1) / (all_n + 2)))
    domains = level(by[1], {d: mean(suffixes[s]) for _, d, s in hosts})
    own = level(by[0], {h: mean(domains[d]) for h, d, _ in hosts})
    return {h: a / (a + b) + 1.645 * math.sqrt(a * b / ((a + b) ** 2 * (a + b + 1))) for h, (a, b) in own.items()}


def ppm_scores(texts, learned, context=5):
    """The log10 probability of each text by prediction by partial matching: method C, symbol exclusion, over bytes with an end."""
    lines = [[0xFE] * context + [b + 32 if 65 <= b <= 90 else b for b in (t or "").encode()] + [0xFF] for t in texts]
    table = {}
    for line, on in zip(lines, learned, strict=True):
        for i in range(context, len(line) if on else 0):
            for k in range(context + 1):
                table.setdefault(tuple(line[i - k : i]), Counter())[line[i]] += 1

    def price(before, symbol):
        gone, p = set(), 0.0
        for k in range(context, -1, -1):
            own = {s: n for s, n in table.get(tuple(before[context - k :]), {}).items() if s not in gone}
            room = sum(own.values()) + len(own)
            if symbol in own:
                return p + math.log10(own[symbol] / room)
            p += math.log10(len(own) / room) if own else 0.0
            gone |= set(own)
        return p - math.log10(max(1, 256 - len(gone)))

    return [sum(price(line[i - context : i], line[i]) for i in range(context, len(line))) for line in lines]
