"""The registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, langid, mixing, near_dedup, periodic, pieces, pii, ppm, quality_rules, spelling, suffix_dedup, token_store, url_filter
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.report(table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.report(table(spark, sf_dir, "documents"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.report(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(table(spark, sf_dir, "documents"), k=3, percent=85)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.report(table(spark, sf_dir, "documents"))


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.report(table(spark, sf_dir, "documents"))


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.report(table(spark, sf_dir, "documents"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.report(table(spark, sf_dir, "documents"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.report(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_source_mixing": op1_source_mixing,
    "op2_language_id": op2_language_id,
    "op3_quality_rules": op3_quality_rules,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_url_filter": op5_url_filter,
    "op6_minhash_near_dedup": op6_minhash_near_dedup,
    "op7_decontamination": op7_decontamination,
    "op8_pii": op8_pii,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_token_store": op10_token_store,
    "op11_sentencepiece": op11_sentencepiece,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_spelling_variants": op13_spelling_variants,
}

#: crc32 in SQL: a table of the bytes' remainders, and the fold of a list of bytes over it.
_CRC = """t AS (SELECT i, i AS c, 0 AS k FROM range(256) AS r(i) UNION ALL SELECT i, xor(c >> 1, 3988292384 * (c & 1)), k + 1 FROM t WHERE k < 8),
tab AS (SELECT list(c ORDER BY i) AS tab FROM t WHERE k = 8)"""
_BYTES = "flatten(list_transform(string_split({0}, ''), lambda c: CASE WHEN ord(c) < 128 THEN [ord(c)::BIGINT] ELSE [(192 | (ord(c) >> 6))::BIGINT, (128 | (ord(c) & 63))::BIGINT] END))"
_FOLD = "xor(list_reduce(" + _BYTES + ", lambda c, b: xor(tab[1 + (xor(c, b) & 255)], c >> 8), 4294967295::BIGINT), 4294967295::BIGINT)"

ORACLES: dict[str, str] = {
    "op12_periodic_runs": rf"""
WITH RECURSIVE {_CRC},
d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, {_FOLD.format("coalesce(CAST(doc_id AS VARCHAR), '')")} AS h FROM documents, tab),
a AS (SELECT doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS planted, (h // 10) % greatest(len(w), 1) AS a, h // 10 AS g FROM d),
e AS (SELECT doc_id, n, CASE WHEN planted THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END]) ELSE w END AS w FROM a),
m AS (SELECT doc_id, n, unnest(range(n)) AS i, unnest(w) AS w FROM e),
-- equal words q apart, and stretches of them
p AS (SELECT x.doc_id, y.i - x.i AS q, x.i FROM m AS x JOIN m AS y ON x.doc_id = y.doc_id AND x.w = y.w AND y.i > x.i AND 3 * (y.i - x.i) <= x.n),
k AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM p),
s AS (SELECT doc_id, q, min(i) AS s, count(*) + q AS len FROM k GROUP BY doc_id, q, k HAVING count(*) + q >= greatest(24, 3 * q)),
r AS (SELECT doc_id, s, len, min(q) AS q FROM s GROUP BY doc_id, s, len),
b AS (SELECT doc_id, s, len, q, row_number() OVER (PARTITION BY doc_id ORDER BY len / q DESC, s, q) AS place FROM r),
f AS (SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS runs FROM r GROUP BY doc_id),
x AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + len)) AS i FROM r),
c AS (SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS c FROM m ANTI JOIN x USING (doc_id, i) GROUP BY doc_id)
SELECT e.doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(s AS BIGINT) AS start, CAST(len AS BIGINT) AS length, CAST(q AS BIGINT) AS period, CAST(1000 * len // q AS BIGINT) AS exponent_milli,
       sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(c, '')) AS collapsed_sha256
FROM e LEFT JOIN (SELECT * FROM b WHERE place = 1) AS b USING (doc_id) LEFT JOIN f USING (doc_id) LEFT JOIN c USING (doc_id)
""",
    "op13_spelling_variants": rf"""
WITH RECURSIVE {_CRC},
d AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]{{6,}}')) AS run FROM documents),
g AS (SELECT id, run, count(*) AS n FROM d GROUP BY id, run),
h AS (SELECT run, n, {_FOLD.format("id || ':' || run")} AS h FROM g, tab),
l AS (SELECT CASE WHEN h % 199 = 0 THEN run[1:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, n FROM h),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM l WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
o AS (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM v),
-- the word without one letter, and with one letter masked
k AS (SELECT word, word[1:i - 1] || word[i + 1:] AS less, word[1:i - 1] || '.' || word[i + 1:] AS mask FROM o),
p AS (SELECT x.word, y.word AS near FROM k AS x JOIN k AS y ON x.mask = y.mask AND x.word <> y.word
      UNION SELECT k.word, v.word FROM k JOIN v ON k.less = v.word UNION SELECT v.word, k.word FROM k JOIN v ON k.less = v.word),
q AS (SELECT p.word, p.near, y.n AS near_n, count(*) OVER (PARTITION BY p.word) AS n_near, row_number() OVER (PARTITION BY p.word ORDER BY y.n DESC, p.near) AS place FROM p JOIN v AS y ON y.word = p.near),
f AS (SELECT v.word, v.n, coalesce(q.n_near, 0) AS n_near, CASE WHEN q.near_n >= 5 * v.n THEN q.near END AS form, CASE WHEN q.near_n >= 5 * v.n THEN q.near_n END AS form_n FROM v LEFT JOIN q ON q.word = v.word AND q.place = 1),
r AS (SELECT word, word AS root, form FROM f UNION ALL SELECT r.word, f.word, f.form FROM r JOIN f ON f.word = r.form)
SELECT f.word, f.form, r.root, f.n, CAST(f.n_near AS BIGINT) AS n_near, CAST(f.form_n AS BIGINT) AS form_n FROM f JOIN r ON r.word = f.word AND r.form IS NULL
""",
    "op6_minhash_near_dedup": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] END AS g
      FROM w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
k AS (SELECT g, row_number() OVER (ORDER BY count(*), g) AS r FROM s GROUP BY g HAVING count(*) > 1),
-- sets of 85% similarity share one of their rarest 15% + 1 shingles; those of one document alone count as the very rarest
f AS (SELECT s.doc_id, k.r, n.n, row_number() OVER (PARTITION BY s.doc_id ORDER BY k.r NULLS FIRST) AS at FROM s JOIN n USING (doc_id) LEFT JOIN k USING (g)),
p AS (SELECT DISTINCT x.doc_id AS a, y.doc_id AS b FROM f AS x JOIN f AS y ON x.r = y.r AND x.doc_id < y.doc_id
      WHERE x.at <= x.n - ceil(0.85 * x.n) + 1 AND y.at <= y.n - ceil(0.85 * y.n) + 1 AND 100 * least(x.n, y.n) >= 85 * greatest(x.n, y.n)),
c AS (SELECT a, b, count(*) AS c FROM p JOIN s AS x ON x.doc_id = a JOIN s AS y ON y.doc_id = b AND y.g = x.g GROUP BY a, b),
e AS (SELECT a, b FROM c JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT doc_id AS id, doc_id AS m FROM n UNION SELECT u.a, r.m FROM r JOIN u ON u.b = r.id WHERE r.m < u.a),
m AS (SELECT id, min(m) AS m FROM r GROUP BY id)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(m.m, w.doc_id) AS component_id, coalesce(m.m, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.id = w.doc_id
""",
    "op7_decontamination": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS g
       FROM b, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS t(i) WHERE len(w) > 0),
dw AS (SELECT doc_id, i, k.n, array_to_string(w[i:i + k.n - 1], ' ') AS g
       FROM d, (SELECT DISTINCT n FROM bw) AS k, unnest(range(1, len(w) - k.n + 2)) AS t(i)),
hits AS (SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
words AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM hits, unnest(range(i, i + n)) AS t(j) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS x FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(x, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
""",
}
