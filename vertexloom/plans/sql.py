"""SQL of the queries, for DuckDB: each operator written again from its definition, over the same tables."""

from __future__ import annotations


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


# one row for each value of a vector
P = "p AS (SELECT vec_id, CAST(label AS BIGINT) AS label, unnest(range(64)) AS f, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)"
T = "t AS (SELECT vec_id // 4 AS vertex, vec_id % 2 AS subject, (vec_id // 2) % 2 AS session, vec_id, label, f, x FROM p)"
# time series
DAYS = "days AS (SELECT user_id AS vertex, CAST(CAST(ts AS DATE) - (SELECT min(CAST(ts AS DATE)) FROM events) AS BIGINT) AS frame, sum(value) AS value FROM events GROUP BY ALL)"
GRID = "grid AS (SELECT v.vertex, f.frame, coalesce(d.value, 0.0) AS value FROM (SELECT DISTINCT vertex FROM days) v CROSS JOIN (SELECT unnest(range((SELECT max(frame) + 1 FROM days))) AS frame) f LEFT JOIN days d ON d.vertex = v.vertex AND d.frame = f.frame)"
CORR = """c0 AS (SELECT vertex, frame, value - avg(value) OVER (PARTITION BY vertex) AS c FROM grid),
n0 AS (SELECT vertex, sqrt(sum(c * c)) AS n FROM c0 GROUP BY vertex),
z0 AS (SELECT vertex, frame, CASE WHEN n > 0 THEN c / n ELSE 0.0 END AS z FROM c0 JOIN n0 USING (vertex)),
corr AS (SELECT a.vertex, b.vertex AS seed, sum(a.z * b.z) AS r FROM z0 a JOIN z0 b ON a.frame = b.frame WHERE b.vertex < 10 GROUP BY ALL)"""
CUT = """cut AS (SELECT rank, v AS cutoff FROM (SELECT round(r, 9) AS v, row_number() OVER (ORDER BY round(r, 9) DESC) AS k, CAST(floor(count(*) OVER () * 0.1 + 0.5) AS BIGINT) AS rank FROM corr) WHERE k = rank AND v > 0)"""
# recordings, by kind of event
RUN_GRID = """rd AS (SELECT event_type AS recording, user_id AS vertex, CAST(CAST(ts AS DATE) - (SELECT min(CAST(ts AS DATE)) FROM events) AS BIGINT) AS frame, sum(value) AS value FROM events GROUP BY ALL),
rl AS (SELECT recording, max(frame) AS l FROM rd GROUP BY recording),
rf AS (SELECT recording, unnest(range(l + 1)) AS frame FROM rl)"""
RUNS = """rg AS (SELECT v.recording, v.vertex, f.frame, coalesce(d.value, 0.0) AS value FROM (SELECT DISTINCT recording, vertex FROM rd) v JOIN rf f USING (recording) LEFT JOIN rd d ON d.recording = v.recording AND d.vertex = v.vertex AND d.frame = f.frame),
rc AS (SELECT recording, vertex, frame, value - avg(value) OVER (PARTITION BY recording, vertex) AS c FROM rg),
rn AS (SELECT recording, vertex, sqrt(sum(c * c)) AS n FROM rc GROUP BY ALL),
rz AS (SELECT recording, vertex, frame, CASE WHEN n > 0 THEN c / n ELSE 0.0 END AS z FROM rc JOIN rn USING (recording, vertex)),
rr AS (SELECT a.recording, a.vertex, b.vertex AS seed, sum(a.z * b.z) AS r FROM rz a JOIN rz b ON a.recording = b.recording AND a.frame = b.frame WHERE b.vertex < 10 GROUP BY ALL)"""
RUN_CUT = """rk AS (SELECT recording, round(r, 9) AS v, row_number() OVER (PARTITION BY recording ORDER BY round(r, 9) DESC) AS k, CAST(floor(count(*) OVER (PARTITION BY recording) * 0.1 + 0.5) AS BIGINT) AS rank FROM rr),
rcut AS (SELECT recording, rank, v AS cutoff FROM rk WHERE k = rank)"""
# centred rows of length one, label directions
ROWS = """c1 AS (SELECT vec_id, vertex, subject, session, label, f, x - avg(x) OVER (PARTITION BY vec_id) AS c FROM t),
u1 AS (SELECT vec_id, vertex, subject, session, label, f, coalesce(c / nullif(sqrt(sum(c * c) OVER (PARTITION BY vec_id)), 0), 0) AS x FROM c1)"""
DIRS = """d0 AS (SELECT label AS network, f, sum(x) AS v FROM u1 WHERE label <> 0 GROUP BY ALL),
dirs AS (SELECT network, f, v / sqrt(sum(v * v) OVER (PARTITION BY network)) AS x FROM d0)"""
DOTS = "dots AS (SELECT vertex, subject, session, network, sum(u1.x * dirs.x) AS dot FROM u1 JOIN dirs USING (f) GROUP BY ALL)"
SCORE = "score AS (SELECT vertex, subject, network, sum(30.0 * dot + CASE WHEN nz THEN 3.5 ELSE 0.0 END) AS s FROM (SELECT *, bool_and(dot <> 0) OVER (PARTITION BY vertex, subject, session) AS nz FROM dots) GROUP BY ALL)"
POST = """e0 AS (SELECT *, exp(s - max(s) OVER (PARTITION BY vertex, subject)) AS e, bool_or(s = 0) OVER (PARTITION BY vertex, subject) AS z FROM score),
post AS (SELECT vertex, subject, network, CASE WHEN z THEN 0.0 ELSE e / sum(e) OVER (PARTITION BY vertex, subject) END AS p FROM e0)"""
MODEL = (P, T, ROWS, DIRS, DOTS, SCORE, POST)
THETA = "theta AS (SELECT vertex, network, sum(p) / 2 AS theta FROM post GROUP BY ALL)"
WEIGHTED = "w AS (SELECT subject, session, network, f, sum(p * x) AS v FROM u1 JOIN post USING (vertex, subject) WHERE p > 0 GROUP BY ALL)"
SESSIONS = """s0 AS (SELECT subject, session, network, f, 30.0 * v + 20.0 * x AS y FROM w JOIN dirs USING (network, f)),
sd AS (SELECT subject, session, network, f, coalesce(y / nullif(sqrt(sum(y * y) OVER (PARTITION BY subject, session, network)), 0), 0) AS x FROM s0)"""
SUBJECTS = """p0 AS (SELECT subject, network, f, sum(20.0 * sd.x) + 40.0 * any_value(dirs.x) AS y FROM sd JOIN dirs USING (network, f) GROUP BY ALL),
pd AS (SELECT subject, network, f, coalesce(y / nullif(sqrt(sum(y * y) OVER (PARTITION BY subject, network)), 0), 0) AS x FROM p0)"""
EDGES = """verts AS (SELECT DISTINCT vec_id // 4 AS vertex FROM embeddings), half AS (SELECT CAST(floor((max(vertex) + 1) / 2) AS BIGINT) AS h FROM verts),
edges AS (SELECT a.vertex AS src, b.vertex AS dst FROM verts a JOIN verts b ON abs(a.vertex - b.vertex) = 1, half WHERE (a.vertex < h) = (b.vertex < h))"""
FILES = """files AS (SELECT DISTINCT printf('in/sub-%02d/ses-%d/func/sub-%02d_ses-%d_task-rest_run-%d_hemi-%s_bold.func.gii', o_custkey % 40, o_orderkey % 12, o_custkey % 40, o_orderkey % 12, o_orderkey // 12 % 7, CASE WHEN o_totalprice > 150000 THEN 'L' ELSE 'R' END) AS path FROM orders),
runs AS (SELECT path, regexp_extract(path, '/sub-([^_/]*)_', 1) AS subject, regexp_extract(path, '_ses-([^_]*)_', 1) AS session, regexp_extract(path, '_task-([^_]*)_', 1) AS task, regexp_extract(path, '_run-([^_]*)_', 1) AS run, regexp_extract(path, '_hemi-([^_]*)_', 1) AS hemi FROM files)"""
BITS = "CAST(count(*) AS BIGINT)"
INVERSE = "62 * rbar / (1 - rbar * rbar) + 63 * rbar / 62"

ORACLES: dict[str, str] = {
    "bold_grid": _with(DAYS, GRID) + "SELECT vertex, frame, round(value, 6) + 0.0 AS value FROM grid",
    "bold_censor": _with(DAYS, GRID) + "SELECT vertex, frame, round(value, 6) + 0.0 AS value FROM grid WHERE frame % 5 <> 4",
    "validate_constant": _with(DAYS, GRID) + "SELECT vertex, max(value) = min(value) AS is_constant, bool_and(value = 0) AS all_zero, bool_and(isfinite(value)) AS finite FROM grid GROUP BY vertex",
    "seed_timeseries": _with(DAYS, GRID) + "SELECT r.roi, f.frame, round(coalesce(avg(g.value), 0.0), 6) + 0.0 AS value FROM (SELECT unnest(range(11)) AS roi) r CROSS JOIN (SELECT DISTINCT frame FROM grid) f LEFT JOIN grid g ON g.vertex % 10 = r.roi AND g.frame = f.frame GROUP BY ALL",
    "pearson_profile": _with(DAYS, GRID, CORR) + "SELECT vertex, seed, round(r, 6) + 0.0 AS r FROM corr",
    "fisher_z_profile": _with(DAYS, GRID, CORR) + "SELECT vertex, seed, round(atanh(greatest(-0.999999, least(0.999999, r))), 6) + 0.0 AS z FROM corr WHERE vertex <> seed",
    "cutoff_value": _with(DAYS, GRID, CORR, CUT) + "SELECT rank, round(cutoff, 6) + 0.0 AS cutoff FROM cut",
    "binary_profile": _with(DAYS, GRID, CORR, CUT) + "SELECT vertex, seed, CAST(round(r, 9) >= cutoff AS BIGINT) AS bit FROM corr, cut",
    "normalize_row_l2": _with(P) + "SELECT vec_id, f AS feature, round(coalesce(x / nullif(sqrt(sum(x * x) OVER (PARTITION BY vec_id)), 0), 0), 6) + 0.0 AS x FROM p",
    "normalize_centred_literal": _with(P) + """, q AS (SELECT vec_id, f, round(4 * x) - avg(round(4 * x)) OVER (PARTITION BY vec_id) AS c FROM p),
n AS (SELECT *, bool_and(c <> 0) OVER (PARTITION BY vec_id) AS scale, sqrt(sum(c * c) OVER (PARTITION BY vec_id)) AS n FROM q)
SELECT vec_id, f AS feature, round(CASE WHEN scale AND n > 0 THEN c / n ELSE c END, 6) + 0.0 AS x FROM n""",
    "avg_profile": _with(P, T) + "SELECT subject, vertex, f AS feature, round(avg(x), 6) + 0.0 AS x FROM t GROUP BY ALL",
    "label_centroids": _with(P, T, ROWS, DIRS) + "SELECT network, f AS feature, round(x, 6) + 0.0 AS x FROM dirs",
    "label_centroids_mean": _with(P) + """, m AS (SELECT label AS network, f, avg(x) AS v FROM p WHERE label > 0 GROUP BY ALL)
SELECT k.network, g.f AS feature, round(coalesce(v / sqrt(sum(v * v) OVER (PARTITION BY k.network)), 0.0), 6) + 0.0 AS x
FROM (SELECT unnest(range(1, 12)) AS network) k CROSS JOIN (SELECT unnest(range(64)) AS f) g LEFT JOIN m ON m.network = k.network AND m.f = g.f""",
    "valid_vertices": _with(P, T) + "SELECT vertex, bool_or(label <> 0 AND x <> 0) AS valid FROM t GROUP BY vertex",
    "vmf_dot": _with(P, T, ROWS, DIRS, DOTS) + "SELECT vertex, subject, session, network, round(dot, 6) + 0.0 AS dot FROM dots",
    "posterior_softmax": _with(*MODEL) + "SELECT vertex, subject, network, round(p, 6) + 0.0 AS p FROM post",
    "flagship_labels": _with(*MODEL) + "SELECT vertex, subject, CASE WHEN p > 0 THEN network ELSE 0 END AS label FROM (SELECT *, row_number() OVER (PARTITION BY vertex, subject ORDER BY p DESC, network) AS k FROM post) WHERE k = 1",
    "theta_mean": _with(*MODEL, THETA) + "SELECT vertex, network, round(theta, 6) + 0.0 AS theta FROM theta",
    "initial_theta": _with(*MODEL) + "SELECT vertex, network, round(coalesce(sum(p) / 2 / nullif(count(*) FILTER (p <> 0), 0), 0.0), 6) + 0.0 AS theta FROM post GROUP BY ALL",
    "weighted_data": _with(*MODEL, WEIGHTED) + "SELECT subject, session, network, f AS feature, round(v, 6) + 0.0 AS x FROM w",
    "kappa_update": _with(*MODEL) + f""", k AS (SELECT subject, session, network, sum(p * dot) AS v FROM dots JOIN post USING (vertex, subject, network) GROUP BY ALL),
a AS (SELECT subject, network, avg(v) AS v FROM k GROUP BY ALL),
r AS (SELECT (SELECT sum(v) FROM a) AS numerator, (SELECT sum(p) FROM post) AS mass),
b AS (SELECT *, numerator / mass AS rbar FROM r)
SELECT round(numerator, 5) + 0.0 AS numerator, round(mass, 5) + 0.0 AS mass, round(rbar, 5) + 0.0 AS rbar, round(greatest({INVERSE}, 5.0), 5) + 0.0 AS kappa FROM b""",
    "inverse_ratio": _with(P, T, ROWS, DIRS, DOTS) + f", b AS (SELECT network, avg(abs(dot)) AS rbar FROM dots WHERE dot BETWEEN -0.99 AND 0.99 GROUP BY network) SELECT network, round(rbar, 6) + 0.0 AS rbar, round({INVERSE}, 6) + 0.0 AS kappa FROM b",
    "session_direction": _with(*MODEL, WEIGHTED, SESSIONS) + "SELECT subject, session, network, f AS feature, round(x, 6) + 0.0 AS x FROM sd",
    "subject_direction": _with(*MODEL, WEIGHTED, SESSIONS, SUBJECTS) + "SELECT subject, network, f AS feature, round(x, 6) + 0.0 AS x FROM pd",
    "group_direction": _with(*MODEL, WEIGHTED, SESSIONS, SUBJECTS) + ", g AS (SELECT network, f, sum(x) AS y FROM pd GROUP BY ALL) SELECT network, f AS feature, round(y / sqrt(sum(y * y) OVER (PARTITION BY network)), 6) + 0.0 AS x FROM g",
    "sigma_update": _with(*MODEL, WEIGHTED, SESSIONS, SUBJECTS) + f""", c AS (SELECT subject, session, network, sum(sd.x * pd.x) AS c FROM sd JOIN pd USING (subject, network, f) WHERE NOT (subject = 1 AND session = 1 AND network <= 3) GROUP BY ALL),
m AS (SELECT session, network, avg(c) AS c FROM c GROUP BY ALL HAVING count(*) = 2), b AS (SELECT network, avg(c) AS rbar FROM m GROUP BY network)
SELECT network, round(rbar, 4) + 0.0 AS rbar, round({INVERSE}, 4) + 0.0 AS sigma FROM b""",
    "em_cost": _with(*MODEL, THETA) + """, s AS (SELECT vertex, subject, network, sum(30.0 * dot + 3.5) AS s FROM dots GROUP BY ALL)
SELECT subject, round(sum(p * (s + CASE WHEN theta > 0 THEN ln(theta) ELSE -720.873067782343 END - CASE WHEN p > 0 THEN ln(p) ELSE -720.873067782343 END)), 3) + 0.0 AS cost
FROM s JOIN post USING (vertex, subject, network) JOIN theta USING (vertex, network) GROUP BY subject""",
    "kmeans_lloyd": _with(P, "v AS (SELECT vec_id AS vertex, f, x / sqrt(sum(x * x) OVER (PARTITION BY vec_id)) AS x FROM p)", "k0 AS (SELECT vertex AS network, f, x FROM v WHERE vertex < 4)") + "".join(
        f""", a{i} AS (SELECT vertex, network FROM (SELECT vertex, network, row_number() OVER (PARTITION BY vertex ORDER BY round(sum(v.x * k.x), 9) DESC, network) AS r FROM v JOIN k{i} k USING (f) GROUP BY vertex, network) WHERE r = 1),
g{i} AS (SELECT network, f, sum(x) AS y FROM v JOIN a{i} USING (vertex) GROUP BY ALL),
k{i + 1} AS (SELECT network, f, y / sqrt(sum(y * y) OVER (PARTITION BY network)) AS x FROM g{i})"""
        for i in range(3)
    ) + " SELECT vertex, network FROM a2",
    "mrf_potential": _with(*MODEL, EDGES) + """, n AS (SELECT src, count(*) AS n FROM edges GROUP BY src)
SELECT src AS vertex, subject, network, round(any_value(n) - sum(p), 6) + 0.0 AS v FROM edges JOIN post ON post.vertex = dst JOIN n USING (src) GROUP BY src, subject, network""",
    "mrf_potential_general": _with(*MODEL, EDGES) + """, n AS (SELECT src, subject, sum(p) AS n FROM edges JOIN post ON post.vertex = dst GROUP BY src, subject)
SELECT src AS vertex, subject, network, round(-1.25 * sum(p) + 1.5 * any_value(n), 6) + 0.0 AS v FROM edges JOIN post ON post.vertex = dst JOIN n USING (src, subject) GROUP BY src, subject, network""",
    "mrf_potential_edges": _with(*MODEL, EDGES) + """, n AS (SELECT vertex, subject, sum(p) AS n FROM post GROUP BY ALL),
c AS (SELECT src, dst, (src + dst) % 3 * 0.25::DOUBLE AS a, 1.0::DOUBLE + (src + 2 * dst) % 5 * 0.5::DOUBLE AS b FROM edges)
SELECT src AS vertex, subject, network, round(sum((a - b) * p + b * n), 6) + 0.0 AS v FROM c JOIN post ON post.vertex = dst JOIN n USING (vertex, subject) GROUP BY src, subject, network""",
    "individual_estep": _with(*MODEL, THETA, EDGES) + """, n AS (SELECT src, count(*) AS n FROM edges GROUP BY src),
v AS (SELECT src AS vertex, subject, network, any_value(n) - sum(p) AS v FROM edges JOIN post ON post.vertex = dst JOIN n USING (src) GROUP BY src, subject, network),
j AS (SELECT vertex, subject, network, s + 2.0 * ln(greatest(theta, 2.2250738585072014e-308)) - 6.0 * v AS s FROM score JOIN theta USING (vertex, network) JOIN v USING (vertex, subject, network)),
e AS (SELECT *, exp(s - max(s) OVER (PARTITION BY vertex, subject)) AS e FROM j)
SELECT vertex, subject, network, round(e / sum(e) OVER (PARTITION BY vertex, subject), 6) + 0.0 AS p FROM e""",
    "winner_take_all": _with(P, "v AS (SELECT vec_id, label, f, x / sqrt(sum(x * x) OVER (PARTITION BY vec_id)) AS x FROM p)") + """, s AS (SELECT b.vec_id AS voxel, a.vec_id AS vertex, any_value(a.label) AS label, round(sum(a.x * b.x), 9) AS r FROM v a JOIN v b USING (f) WHERE a.vec_id % 2 = 0 AND b.vec_id % 2 = 1 GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY voxel ORDER BY r DESC, vertex DESC) AS k FROM s WHERE label <> 0),
c AS (SELECT voxel, label, count(*) AS n FROM k WHERE k <= 25 GROUP BY ALL),
o AS (SELECT voxel, label, n, lead(n) OVER w AS next, row_number() OVER w AS k FROM c WINDOW w AS (PARTITION BY voxel ORDER BY n DESC, label DESC))
SELECT voxel, label, round(CASE WHEN next IS NULL THEN 1.0 ELSE 1 - next / n END, 6) + 0.0 AS confidence FROM o WHERE k = 1""",
    "vol2surf_fc": _with(DAYS, GRID) + """, c AS (SELECT vertex, frame, frame % 2 AS run, value - avg(value) OVER (PARTITION BY vertex, frame % 2) AS c FROM grid),
n AS (SELECT vertex, run, sqrt(sum(c * c)) AS n FROM c GROUP BY ALL), z AS (SELECT vertex, run, frame, CASE WHEN n > 0 THEN c / n ELSE 0.0 END AS z FROM c JOIN n USING (vertex, run)),
r AS (SELECT a.vertex, b.vertex AS seed, a.run, sum(a.z * b.z) AS r FROM z a JOIN z b ON a.frame = b.frame WHERE b.vertex < 10 AND a.vertex <> b.vertex GROUP BY ALL)
SELECT vertex, seed, round(sum(atanh(greatest(-0.999999, least(0.999999, r)))) / 2, 6) + 0.0 AS z FROM r GROUP BY ALL""",
    "run_profiles": _with(RUN_GRID, RUNS) + "SELECT recording, vertex, seed, round(r, 6) + 0.0 AS r FROM rr",
    "run_cutoffs": _with(RUN_GRID, RUNS, RUN_CUT) + "SELECT recording, rank, round(cutoff, 9) + 0.0 AS cutoff FROM rcut",
    "run_binary_profiles": _with(RUN_GRID, RUNS, RUN_CUT) + "SELECT recording, vertex, seed, CAST(round(r, 9) >= cutoff AS BIGINT) AS bit FROM rr JOIN rcut USING (recording)",
    "run_problems": _with(RUN_GRID) + """, u AS (SELECT DISTINCT vertex FROM rd),
s AS (SELECT f.recording, u.vertex, max(coalesce(value, 0)) = min(coalesce(value, 0)) AS flat, bool_and(coalesce(value, 0) = 0) AS zero FROM rf f CROSS JOIN u LEFT JOIN rd ON rd.recording = f.recording AND rd.frame = f.frame AND rd.vertex = u.vertex GROUP BY ALL),
k AS (SELECT recording, CASE WHEN vertex < 10 THEN 'a seed that does not vary' WHEN zero THEN 'a series of zeros' ELSE 'a series that does not vary' END AS problem FROM s WHERE flat AND vertex % 11 <> 0)
SELECT recording, problem, count(*) AS n FROM k GROUP BY ALL""",
    "content_differences": """WITH f AS (SELECT page_id, page_id || ' ' || coalesce(url, '') AS name, sha256(html) AS sha256 FROM pages),
p AS (SELECT name, CASE WHEN page_id % 13 = 5 THEN sha256(name) ELSE sha256 END AS want FROM f WHERE page_id % 17 <> 3), g AS (SELECT name, sha256 FROM f WHERE page_id % 19 <> 4)
SELECT name, CASE WHEN sha256 IS NULL THEN 'missing' WHEN want IS NULL THEN 'unknown' ELSE 'changed' END AS problem FROM g FULL JOIN p USING (name) WHERE sha256 IS DISTINCT FROM want""",
    "content_tree": """WITH f AS (SELECT page_id || ' ' || coalesce(url, '') AS name, strlen(html) AS size, sha256(html) AS sha256 FROM pages),
g AS (SELECT substr(sha256(name), 1, 3) AS g, sha256(string_agg(name || chr(10) || size || chr(10) || sha256, chr(10) || chr(10) ORDER BY name || chr(10) || size || chr(10) || sha256)) AS d, count(*) AS n, sum(size) AS s FROM f GROUP BY ALL)
SELECT CAST(sum(n) AS BIGINT) AS n_files, CAST(sum(s) AS BIGINT) AS size, sha256(string_agg(g || ':' || d, chr(10) ORDER BY g)) AS digest FROM g""",
    "homogeneity": _with(P) + """, m AS (SELECT label, f, avg(x) AS y FROM p WHERE label > 0 GROUP BY ALL), u AS (SELECT label, f, y / nullif(sqrt(sum(y * y) OVER (PARTITION BY label)), 0) AS y FROM m),
big AS (SELECT label FROM embeddings WHERE label > 0 GROUP BY label HAVING count(*) >= 2),
c AS (SELECT vec_id, sum(x * y) / nullif(sqrt(sum(x * x)), 0) AS c FROM p JOIN u USING (label, f) SEMI JOIN big USING (label) WHERE y IS NOT NULL GROUP BY vec_id)
SELECT round(coalesce(avg(coalesce(c, 0)), 0), 6) + 0.0 AS homogeneity, count(*) AS n FROM c""",
    "dice_report": """WITH l AS (SELECT vec_id // 2 AS vertex, vec_id % 2 AS subject, CAST(label AS BIGINT) AS label FROM embeddings),
a AS (SELECT vertex, label FROM l WHERE subject = 0), b AS (SELECT vertex, label FROM l WHERE subject = 1), k AS (SELECT DISTINCT label FROM l WHERE label > 0),
c AS (SELECT k.label, (SELECT count(*) FROM a WHERE a.label = k.label) AS n_a, (SELECT count(*) FROM b WHERE b.label = k.label) AS n_b, (SELECT count(*) FROM a JOIN b USING (vertex) WHERE a.label = k.label AND b.label = k.label) AS n_both FROM k)
SELECT label, n_a, n_b, n_both, round(2 * n_both / (n_a + n_b), 6) + 0.0 AS dice FROM c""",
    "agreement_report": """WITH l AS (SELECT vec_id // 2 AS vertex, vec_id % 2 AS subject, label FROM embeddings), j AS (SELECT a.label AS la, b.label AS lb FROM l a JOIN l b ON a.vertex = b.vertex AND a.subject = 0 AND b.subject = 1)
SELECT count(*) AS n, count(*) FILTER (la = lb) AS n_equal, round(count(*) FILTER (la = lb) / count(*), 6) + 0.0 AS agreement,
round(count(*) FILTER (la = lb AND la > 0) / nullif(count(*) FILTER (la > 0 OR lb > 0), 0), 6) + 0.0 AS union_agreement FROM j""",
    "tolerance_report": _with(P) + """, m AS (SELECT vec_id % 2 AS subject, label AS network, f, avg(x) AS v FROM p WHERE label BETWEEN 1 AND 9 GROUP BY ALL),
u AS (SELECT *, v / sqrt(sum(v * v) OVER (PARTITION BY subject, network)) AS x FROM m), g AS (SELECT k.network, g.f FROM (SELECT unnest(range(1, 10)) AS network) k CROSS JOIN (SELECT unnest(range(64)) AS f) g),
j AS (SELECT coalesce(a.x, 0) AS a, coalesce(b.x, 0) AS b, abs(coalesce(a.x, 0) - coalesce(b.x, 0)) AS d FROM g LEFT JOIN u a ON a.network = g.network AND a.f = g.f AND a.subject = 0 LEFT JOIN u b ON b.network = g.network AND b.f = g.f AND b.subject = 1)
SELECT count(*) AS n, CAST(0 AS BIGINT) AS n_missing, count(*) FILTER (d > 1e-3 + 1e-2 * abs(b)) AS n_violations,
round(max(d), 6) + 0.0 AS max_absolute, round(max(d / greatest(abs(b), 1e-3)), 6) + 0.0 AS max_relative FROM j""",
    "neighbours": """WITH f AS (SELECT c_custkey AS a, c_custkey + 1 AS b, c_custkey + c_nationkey + 2 AS c FROM customer), e AS (SELECT unnest([a, a, b, b, c, c]) AS src, unnest([b, c, a, c, a, b]) AS dst FROM f)
SELECT src, string_agg(dst, ',' ORDER BY dst) AS neighbours FROM (SELECT DISTINCT src, dst FROM e) GROUP BY src""",
    "nearest_seed": """WITH v AS (SELECT vec_id AS vertex, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings),
d AS (SELECT a.vertex, b.vertex AS seed, round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2), 9) AS distance FROM v a, v b WHERE b.vertex % 25 = 0)
SELECT vertex, seed, round(distance, 6) + 0.0 AS distance FROM (SELECT *, row_number() OVER (PARTITION BY vertex ORDER BY distance, seed) AS k FROM d) WHERE k = 1""",
    "boundary_fill": """WITH RECURSIVE """ + EDGES + """, valid AS (SELECT vec_id // 4 AS vertex FROM embeddings WHERE vec_id % 2 = 0 AND (vec_id // 2) % 2 = 0 AND label > 3),
r AS (SELECT vertex, vertex AS source, 0.0::DOUBLE AS distance FROM valid UNION SELECT dst, source, distance + 1.0 + least(src, dst) % 3 * 0.5 FROM r JOIN edges ON src = vertex WHERE distance + 1.0 + least(src, dst) % 3 * 0.5 <= 4.0)
SELECT vertex, source, round(distance, 6) + 0.0 AS distance FROM (SELECT *, row_number() OVER (PARTITION BY vertex ORDER BY distance, source) AS k FROM r) WHERE k = 1""",
    "coverage_counts": _with(P, T) + """, r AS (SELECT vertex, subject, session, bool_or(x <> 0 AND label <> 0) AS usable FROM t WHERE vertex % 5 <> 2 OR session = 0 GROUP BY ALL),
n AS (SELECT count(*) AS n FROM (SELECT DISTINCT subject, session FROM r)), v AS (SELECT DISTINCT vertex FROM t)
SELECT v.vertex, count(*) FILTER (usable) AS n_usable, any_value(n.n) AS n_sessions, v.vertex % 11 <> 0 AND count(*) FILTER (usable) = any_value(n.n) AS full FROM v LEFT JOIN r USING (vertex), n GROUP BY v.vertex""",
    "support_masks": _with(P, T) + ", r AS (SELECT vertex, subject, session, bool_or(x <> 0 AND label >= 4) AS s FROM t GROUP BY ALL) SELECT vertex, subject, bool_or(s) AS any_session, bool_and(s) AS every_session FROM r GROUP BY ALL",
    "entity_parse": _with(FILES) + "SELECT path, subject, session, task, run, hemi FROM runs",
    "run_pairing": _with(FILES) + """SELECT subject, session, task, run, min(path) FILTER (hemi = 'L') AS "left", min(path) FILTER (hemi = 'R') AS "right",
CASE WHEN count(*) FILTER (hemi = 'L') > 1 OR count(*) FILTER (hemi = 'R') > 1 THEN 'repeated' WHEN count(DISTINCT hemi) < 2 THEN 'single' END AS problem FROM runs GROUP BY ALL""",
    "session_numbering": _with(FILES) + "SELECT subject, session, task, run, hemi, row_number() OVER (PARTITION BY subject ORDER BY session, task, run, hemi) AS session_number FROM runs",
    "profile_list_grid": _with(FILES) + """, h AS (SELECT subject, path, row_number() OVER (PARTITION BY subject ORDER BY session, task, run, hemi) AS k FROM runs)
SELECT s.subject, n.k AS session_number, coalesce(h.path, 'NONE') AS path FROM (SELECT DISTINCT subject FROM h) s CROSS JOIN (SELECT unnest(range(1, 201)) AS k) n LEFT JOIN h ON h.subject = s.subject AND h.k = n.k""",
    "manifest_json": _with(FILES) + """SELECT '{"subject":"' || subject || '","session":"' || session || '","run":"' || run || '","hemi":"' || hemi || '"}' AS manifest FROM runs""",
    "requested_missing": _with(FILES) + ", a AS (SELECT printf('%02d', unnest(range(60))) AS subject) SELECT subject FROM a WHERE subject NOT IN (SELECT subject FROM runs)",
    "run_discovery": _with(FILES) + "SELECT subject, session, task, run, hemi, path FROM runs",
    "run_filters": _with(FILES) + "SELECT subject, session, task, run, hemi, path FROM runs WHERE subject IN ('03', '17', '21') AND session IN ('1', '10')",
    "censor_once": _with(DAYS, GRID) + "SELECT vertex, frame, round(value, 6) + 0.0 AS value FROM grid WHERE frame % 5 <> 4",
    "nonfinite_to_zero": _with(DAYS, GRID) + "SELECT vertex, frame, CASE WHEN max(value) OVER (PARTITION BY vertex) > 400 THEN 0.0 ELSE round(value, 6) + 0.0 END AS value FROM grid",
    "cortex_mask": _with(P, T) + "SELECT vertex, subject, session, f AS feature, CASE WHEN vertex % 11 = 0 THEN 0.0 ELSE round(x, 6) + 0.0 END AS x FROM t",
    "expanded_labels": "SELECT v.vertex, CASE WHEN v.vertex % 11 = 0 THEN 0 ELSE coalesce(l.label, 0) END AS label FROM (SELECT DISTINCT vec_id // 4 AS vertex FROM embeddings) v LEFT JOIN (SELECT vec_id // 4 AS vertex, CAST(label AS BIGINT) AS label FROM embeddings WHERE vec_id % 2 = 0 AND (vec_id // 2) % 2 = 0) l USING (vertex)",
    "hemisphere_concat": "SELECT vec_id // 4 + (vec_id % 2) * (SELECT max(vec_id // 4) + 1 FROM embeddings) AS vertex, (vec_id // 2) % 2 AS session, CAST(label AS BIGINT) AS label FROM embeddings",
    "mask_partition": "SELECT vec_id // 4 AS vertex, count(*) FILTER (label > 2) AS n FROM embeddings GROUP BY ALL HAVING count(*) FILTER (label > 2) <> 1",
    "mask_intersection": "SELECT vec_id // 4 AS vertex FROM embeddings GROUP BY ALL HAVING count(DISTINCT vec_id % 4) FILTER (label > 2) = 4",
    "scatter_into_mask": "SELECT c_custkey AS voxel, CASE WHEN c_nationkey < 20 THEN round(c_acctbal, 6) + 0.0 ELSE 0.0 END AS value FROM customer",
    "face_majority": """WITH f AS (SELECT c_custkey AS face, unnest([c_custkey, c_custkey + 1, c_custkey + c_nationkey + 2]) AS vertex FROM customer),
n AS (SELECT face, coalesce(CAST(c_nationkey % 4 AS BIGINT), 0) AS label, count(*) AS n FROM f LEFT JOIN customer ON c_custkey = vertex GROUP BY ALL)
SELECT face, label FROM (SELECT *, row_number() OVER (PARTITION BY face ORDER BY n DESC, label) AS k FROM n) WHERE k = 1""",
    "boundary_fill_zero": """WITH RECURSIVE """ + EDGES + """, valid AS (SELECT vec_id // 4 AS vertex FROM embeddings WHERE vec_id % 2 = 0 AND (vec_id // 2) % 2 = 0 AND label > 7),
r AS (SELECT vertex, vertex AS source, 0.0::DOUBLE AS distance FROM valid UNION SELECT dst, source, distance + 1.0 + least(src, dst) % 3 * 0.5 FROM r JOIN edges ON src = vertex WHERE distance + 1.0 + least(src, dst) % 3 * 0.5 <= 1.5),
b AS (SELECT vertex, source, distance FROM (SELECT *, row_number() OVER (PARTITION BY vertex ORDER BY distance, source) AS k FROM r) WHERE k = 1),
g AS (SELECT v.vertex, m.s AS source, abs(v.vertex - m.s) / 20.0 AS distance FROM verts v, (SELECT min(vertex) AS s FROM valid) m)
SELECT v.vertex, coalesce(b.source, g.source, -1) AS source, round(coalesce(b.distance, CAST(g.distance AS DOUBLE)), 6) + 0.0 AS distance
FROM verts v LEFT JOIN b USING (vertex) LEFT JOIN g ON g.vertex = v.vertex AND g.distance <= 1.5""",
    "kmeans_restarts": _with(P, "v AS (SELECT vec_id AS vertex, f, x / sqrt(sum(x * x) OVER (PARTITION BY vec_id)) AS x FROM p)", "s AS (SELECT * FROM (VALUES (0), (8)) AS t(start))", "k0 AS (SELECT start, vertex - start AS network, f, x FROM v, s WHERE vertex BETWEEN start AND start + 3)") + "".join(
        f""", d{i} AS (SELECT start, vertex, network, round(sum(v.x * k.x), 9) AS dot FROM v JOIN k{i} k USING (f) GROUP BY ALL),
a{i} AS (SELECT start, vertex, network, dot FROM (SELECT *, row_number() OVER (PARTITION BY start, vertex ORDER BY dot DESC, network) AS r FROM d{i}) WHERE r = 1),
g{i} AS (SELECT start, network, f, sum(x) AS y FROM v JOIN a{i} USING (vertex) GROUP BY ALL),
k{i + 1} AS (SELECT start, network, f, y / sqrt(sum(y * y) OVER (PARTITION BY start, network)) AS x FROM g{i})"""
        for i in range(2)
    ) + ", q AS (SELECT start FROM a1 GROUP BY start ORDER BY round(sum(dot), 9) DESC, start LIMIT 1) SELECT vertex, network FROM a1 JOIN q USING (start)",
    "relative_change": _with(DAYS, GRID) + """, c AS (SELECT frame AS step, round(sum(value), 6) AS cost FROM grid GROUP BY frame), b AS (SELECT *, lag(cost) OVER (ORDER BY step) AS before FROM c)
SELECT step, round(cost, 6) + 0.0 AS cost, round(CASE WHEN before = 0 THEN 'inf'::DOUBLE ELSE abs((cost - before) / before) END, 6) + 0.0 AS change FROM b""",
}
