"""DuckDB SQL for the queries of this package, by plain methods: explicit pairs, windows, recursion."""

from __future__ import annotations

W = """
e AS (SELECT vec_id AS iso_id, label, [CAST(x AS DOUBLE) FOR x IN embedding] AS v FROM embeddings),
h AS (SELECT iso_id, label, v[1:32] AS va, v[33:64] AS vb FROM e),
w AS (SELECT iso_id, label, [(x - list_avg(va)) / list_stddev_pop(va) FOR x IN va] AS za, [(x - list_avg(vb)) / list_stddev_pop(vb) FOR x IN vb] AS zb FROM h),
prof AS (SELECT iso_id, 'A' AS region, za AS z FROM w UNION ALL SELECT iso_id, 'B', zb FROM w)"""

EVENTS = "ev AS (SELECT event_id AS print_id, user_id AS iso_id, event_type AS region, value > 100 AS bad FROM events)"
LATEST = f"{EVENTS}, latest AS (SELECT p1.iso_id, p1.region, p1.print_id FROM ev p1 LEFT JOIN ev p2 ON p1.iso_id = p2.iso_id AND p1.region = p2.region AND p2.bad IS FALSE AND p1.print_id < p2.print_id WHERE p1.bad IS FALSE AND p2.print_id IS NULL)"

PRINTS = "pr AS (SELECT vec_id AS print_id, vec_id // 16 AS iso_id, CASE WHEN vec_id % 13 <> 0 THEN vec_id % 11 = 0 END AS bad FROM embeddings)"
REPLICATES = f"""{W}, {PRINTS},
top AS (SELECT p1.print_id, p1.iso_id FROM pr p1 WHERE p1.bad IS FALSE AND (SELECT count(*) FROM pr p2 WHERE p2.iso_id = p1.iso_id AND p2.bad IS FALSE AND p2.print_id > p1.print_id) < 10),
rep AS (SELECT a.region, p1.iso_id, p1.print_id AS p1, p2.print_id AS p2, list_dot_product(a.z, b.z) / 32 AS pearson
  FROM top p1 JOIN top p2 ON p1.iso_id = p2.iso_id AND p1.print_id < p2.print_id JOIN prof a ON a.iso_id = p1.print_id JOIN prof b ON b.iso_id = p2.print_id AND a.region = b.region)"""


def near(threshold: float, name: str = "edges") -> str:
    ball = f"sqrt(2 * 32 * (1 - {threshold}))"
    return f"""{name} AS (SELECT a.iso_id AS a, b.iso_id AS b, list_dot_product(a.za, b.za) / 32 AS pa, list_dot_product(a.zb, b.zb) / 32 AS pb
  FROM w a JOIN w b ON a.iso_id < b.iso_id WHERE list_distance(a.za, b.za) <= {ball} AND list_distance(a.zb, b.zb) <= {ball})"""


def clusters(least: int, name: str = "db") -> str:
    """A recursive query over the core graph; needs edges."""
    return f"""both_{name} AS (SELECT a AS src, b AS dst FROM edges UNION SELECT b, a FROM edges),
cores_{name} AS (SELECT src FROM both_{name} GROUP BY src HAVING count(*) >= {least}),
reach_{name}(x, y) AS (SELECT src, src FROM cores_{name} UNION SELECT r.x, e.dst FROM reach_{name} r JOIN both_{name} e ON r.y = e.src JOIN cores_{name} c ON c.src = e.dst),
lab_{name} AS (SELECT x, min(y) AS cluster_id FROM reach_{name} GROUP BY x),
{name} AS (SELECT cluster_id, iso_id, iso_id IN (SELECT src FROM cores_{name}) AS is_core FROM (
  SELECT cluster_id, x AS iso_id FROM lab_{name} UNION SELECT cluster_id, dst FROM lab_{name} JOIN both_{name} ON src = x))"""


DB = f"WITH RECURSIVE {W}, {near(0.3)}, {clusters(3)}"
LABELLED = "lab AS (SELECT CAST(label AS BIGINT) AS cluster_id, vec_id AS iso_id FROM embeddings WHERE label IS NOT NULL)"
SEVENS = "sev AS (SELECT vec_id % 7 AS cluster_id, vec_id AS iso_id FROM embeddings WHERE vec_id % 5 <> 0 UNION ALL SELECT 7, vec_id FROM embeddings WHERE vec_id % 9 = 0)"
LAST = "m1 AS (SELECT iso_id, max(cluster_id) AS c FROM lab GROUP BY 1), m2 AS (SELECT iso_id, max(cluster_id) AS c FROM sev GROUP BY 1)"
PAIRS = """pairs AS (SELECT coalesce(x1.c = y1.c, false) AS s1, coalesce(x2.c = y2.c, false) AS s2 FROM embeddings x JOIN embeddings y ON x.vec_id < y.vec_id
  LEFT JOIN m1 x1 ON x1.iso_id = x.vec_id LEFT JOIN m1 y1 ON y1.iso_id = y.vec_id LEFT JOIN m2 x2 ON x2.iso_id = x.vec_id LEFT JOIN m2 y2 ON y2.iso_id = y.vec_id)"""
COUNTS = "count(*) FILTER (s1 AND s2) AS both_same, count(*) FILTER (s1 <> s2) AS one_of_each, count(*) FILTER (NOT s1 AND NOT s2) AS both_diff"


def intra(members: str, name: str = "intra") -> str:
    return f"""{name} AS (SELECT x.cluster_id, p.iso_id AS a, q.iso_id AS b, p.region, list_dot_product(p.z, q.z) / 32 AS pearson
  FROM {members} x JOIN {members} y ON x.cluster_id = y.cluster_id AND x.iso_id < y.iso_id JOIN prof p ON p.iso_id = x.iso_id JOIN prof q ON q.iso_id = y.iso_id AND p.region = q.region)"""


def ks(groups: str, keys: str, actual: str, expected: str, out: str) -> str:
    """Two-sample KS for every group: actual(keys, region, pearson) against expected(region, pearson)."""
    on = " AND ".join(f"a.{k} = g.{k}" for k in keys.split(", ")) if keys else "true"
    k = f"{keys}, " if keys else ""
    return f"""{out}_g AS (SELECT DISTINCT {k}region FROM {groups}),
{out}_v AS (SELECT {k}region, pearson, sum(a) AS a, sum(b) AS b FROM (
  SELECT {k}region, pearson, 1 AS a, 0 AS b FROM {actual} UNION ALL
  SELECT {', '.join('g.' + x for x in keys.split(', ')) + ', ' if keys else ''}g.region, x.pearson, 0, 1 FROM {out}_g g JOIN {expected} x ON x.region = g.region) GROUP BY ALL),
{out}_c AS (SELECT {k}region, sum(a) OVER o AS ca, sum(b) OVER o AS cb, sum(a) OVER p AS na, sum(b) OVER p AS nb FROM {out}_v
  WINDOW o AS (PARTITION BY {k}region ORDER BY pearson), p AS (PARTITION BY {k}region)),
{out}_d AS (SELECT {k}region, CAST(max(na) AS DOUBLE) AS n1, CAST(max(nb) AS DOUBLE) AS n2, max(abs(ca / na - cb / nb)) AS d FROM {out}_c GROUP BY ALL),
{out}_x AS (SELECT *, d / sqrt((n1 + n2) / (n1 * n2)) AS weighted, (sqrt(n1 * n2 / (n1 + n2)) + 0.12 + 0.11 / sqrt(n1 * n2 / (n1 + n2))) * d AS x FROM {out}_d),
{out} AS (SELECT {k}region, n1, n2, d, weighted, CASE WHEN x < 0.18 THEN 1.0 ELSE greatest(0.0, least(1.0, list_sum([(CASE WHEN i % 2 = 1 THEN 2.0 ELSE -2.0 END) * exp(-2.0 * i * i * x * x) FOR i IN range(1, 101)]))) END AS p FROM {out}_x)"""


def described(source: str) -> str:
    return f"""long AS (SELECT region, unnest(['d', 'weighted', 'p']) AS measure, unnest([d, weighted, p]) AS v FROM {source}),
mom AS (SELECT region, measure, count(v) AS n, min(v) AS lo, max(v) AS hi, avg(v) AS mean, var_samp(v) AS variance FROM long GROUP BY ALL),
cen AS (SELECT l.region, l.measure, avg(pow(v - mean, 2)) AS m2, avg(pow(v - mean, 3)) AS m3, avg(pow(v - mean, 4)) AS m4 FROM long l JOIN mom ON mom.region = l.region AND mom.measure = l.measure GROUP BY ALL)
SELECT mom.region, mom.measure, n, round(lo, 6) AS "min", round(hi, 6) AS "max", round(mean, 6) AS mean, round(variance, 6) AS variance,
  round(m3 / pow(m2, 1.5), 6) AS skewness, round(m4 / (m2 * m2) - 3, 6) AS kurtosis FROM mom JOIN cen ON mom.region = cen.region AND mom.measure = cen.measure"""


KS_OUT = "round(d, 6) AS d, round(weighted, 6) AS weighted, round(p, 6) AS p"
CLUSTER_KS = f"""WITH {REPLICATES}, {LABELLED}, big AS (SELECT cluster_id FROM lab GROUP BY 1 HAVING count(*) >= 8), {intra("lab")},
act AS (SELECT cluster_id, region, pearson FROM intra WHERE cluster_id IN (SELECT cluster_id FROM big)), {ks("act", "cluster_id", "act", "rep", "t")}"""
MERGED = """sz AS (SELECT cluster_id, count(*) AS s FROM lab GROUP BY 1),
cp AS (SELECT x.cluster_id AS c1, y.cluster_id AS c2 FROM sz x JOIN sz y ON x.cluster_id < y.cluster_id WHERE x.s + y.s >= 8),
act AS (SELECT c1, c2, region, pearson FROM cp JOIN intra ON intra.cluster_id = c1 UNION ALL SELECT c1, c2, region, pearson FROM cp JOIN intra ON intra.cluster_id = c2
  UNION ALL SELECT c1, c2, p.region, list_dot_product(p.z, q.z) / 32 FROM cp JOIN lab x ON x.cluster_id = c1 JOIN lab y ON y.cluster_id = c2 JOIN prof p ON p.iso_id = x.iso_id JOIN prof q ON q.iso_id = y.iso_id AND p.region = q.region)"""
PAIRED_KS = f"""WITH {REPLICATES}, {LABELLED}, {intra("lab")}, {MERGED},
{ks("act", "c1, c2", "act", "rep", "t")}"""


def beta(source: str, keys: str = "") -> str:
    """One-sample KS of source(keys, region, pearson), moved to [0, 1], against Beta(8, 8), whose distribution is a polynomial."""
    return f"""s AS (SELECT {keys}region, round((pearson + 1) / 2, 12) AS x, count(*) AS n FROM {source} GROUP BY ALL),
c AS (SELECT {keys}region, x, n, sum(n) OVER (PARTITION BY {keys}region ORDER BY x) AS le, sum(n) OVER (PARTITION BY {keys}region) AS total,
  list_sum([[6435.0, 5005.0, 3003.0, 1365.0, 455.0, 105.0, 15.0, 1.0][j - 7] * pow(x, j) * pow(1 - x, 15 - j) FOR j IN range(8, 16)]) AS f FROM s),
d AS (SELECT {keys}region, max(total) AS n, max(greatest(le / total - f, f - (le - n) / total)) AS d FROM c GROUP BY ALL),
x AS (SELECT *, (sqrt(n) + 0.12 + 0.11 / sqrt(n)) * d AS x FROM d)
SELECT {keys}region, CAST(n AS BIGINT) AS n, round(d, 6) AS d, round(CASE WHEN x < 0.18 THEN 1.0 ELSE greatest(0.0, least(1.0, list_sum([(CASE WHEN i % 2 = 1 THEN 2.0 ELSE -2.0 END) * exp(-2.0 * i * i * x * x) FOR i IN range(1, 101)]))) END, 6) AS p FROM x"""


LINES = """src AS (SELECT 'f' || label AS file, vec_id AS i FROM embeddings WHERE label IS NOT NULL),
lines AS (SELECT file, i * 2 + 10 AS n, CAST((i // 40) % 3 AS VARCHAR) AS id, 'I' || (i % 400) AS iso FROM src
  UNION ALL SELECT file, i * 2 + 11, 'Cluster Id', 'Isolate' FROM src WHERE i % 50 = 7 UNION ALL SELECT file, i * 2 + 11, 'Threshold: 0.99', '' FROM src WHERE i % 97 = 96),
known AS (SELECT 'I' || vec_id AS iso_id FROM embeddings WHERE vec_id % 11 <> 3),
cut AS (SELECT file, min(CASE WHEN id LIKE 'Threshold:%' THEN n END) AS stop FROM lines GROUP BY file),
body AS (SELECT l.file, n, id, iso FROM lines l JOIN cut ON cut.file = l.file WHERE (stop IS NULL OR n < stop) AND id <> 'Cluster Id' AND iso IN (SELECT iso_id FROM known)),
mark AS (SELECT *, CASE WHEN id = lag(id) OVER (PARTITION BY file ORDER BY n) THEN 0 ELSE 1 END AS fresh FROM body)"""

AUDIT = f"""{DB}, {LABELLED},
forms AS (SELECT 'dbscan' AS clustering, cluster_id, iso_id FROM db UNION ALL SELECT 'label', cluster_id, iso_id FROM lab),
names AS (SELECT DISTINCT clustering FROM forms),
core AS (SELECT f.* FROM forms f JOIN cores_db c ON c.src = f.iso_id),
ex AS (SELECT clustering, count(*) FILTER (n <> 1) AS v FROM (SELECT names.clustering, src, count(core.iso_id) AS n FROM names JOIN cores_db ON true LEFT JOIN core ON core.clustering = names.clustering AND core.iso_id = src GROUP BY ALL) GROUP BY 1),
go AS (SELECT clustering, cluster_id, dst AS iso_id FROM core JOIN both_db ON src = core.iso_id),
mx AS (SELECT names.clustering, count(go.iso_id) AS v FROM names LEFT JOIN (SELECT * FROM go WHERE (clustering, cluster_id, iso_id) NOT IN (SELECT (clustering, cluster_id, iso_id) FROM forms)) go ON go.clustering = names.clustering GROUP BY 1),
ms AS (SELECT names.clustering, count(f.iso_id) AS v FROM names LEFT JOIN (SELECT * FROM forms WHERE iso_id NOT IN (SELECT src FROM cores_db) AND (clustering, cluster_id, iso_id) NOT IN (SELECT (clustering, cluster_id, iso_id) FROM go)) f ON f.clustering = names.clustering GROUP BY 1),
cn AS (SELECT names.clustering, count(k.cluster_id) AS v FROM names LEFT JOIN (SELECT clustering, core.cluster_id FROM core JOIN lab_db ON x = iso_id GROUP BY ALL HAVING count(DISTINCT lab_db.cluster_id) > 1) k ON k.clustering = names.clustering GROUP BY 1)
SELECT clustering, 'existence' AS "check", v AS violations FROM ex UNION ALL SELECT clustering, 'maximality', v FROM mx UNION ALL SELECT clustering, 'membership', v FROM ms UNION ALL SELECT clustering, 'connectivity', v FROM cn"""

SETS = "list(iso_id ORDER BY iso_id)"
DIMS = f"WITH {W}, d AS (SELECT iso_id, region, CAST(unnest(range(32)) AS INTEGER) AS dim, unnest(z) AS v FROM prof)"
MAIN = "st AS (SELECT region, dim, stddev_pop(v) AS std FROM d GROUP BY ALL), mn AS (SELECT region, arg_max(dim, std) AS main FROM st GROUP BY 1)"
CORR = f"{MAIN}, co AS (SELECT d.region, d.dim, covar_samp(d.v, m.v) / (stddev_pop(d.v) * stddev_pop(m.v)) AS c FROM d JOIN mn ON mn.region = d.region JOIN d m ON m.iso_id = d.iso_id AND m.region = d.region AND m.dim = mn.main GROUP BY ALL)"

INTER = """inter AS (SELECT x.cluster_id AS c1, y.cluster_id AS c2, p.region, round(list_dot_product(p.z, q.z) / 32, 12) AS v
  FROM lab x JOIN lab y ON x.cluster_id < y.cluster_id JOIN prof p ON p.iso_id = x.iso_id JOIN prof q ON q.iso_id = y.iso_id AND p.region = q.region)"""


def _round(i: int) -> str:
    """Round i of the split planes: the 10 unused dimensions with the highest std * |correlation| with the main one of the unused."""
    used = " UNION ALL ".join(["SELECT NULL AS region, NULL AS dim WHERE false", *[f"SELECT region, dim FROM t{j}" for j in range(i)]])
    return f"""s{i} AS (SELECT st.* FROM st ANTI JOIN ({used}) u ON u.region = st.region AND u.dim = st.dim),
m{i} AS (SELECT region, arg_max(dim, std) AS main FROM s{i} GROUP BY 1),
c{i} AS (SELECT d.region, d.dim, s{i}.std, covar_samp(d.v, m.v) / (stddev_pop(d.v) * stddev_pop(m.v)) AS c FROM d JOIN m{i} k ON k.region = d.region
  JOIN d m ON m.iso_id = d.iso_id AND m.region = d.region AND m.dim = k.main JOIN s{i} ON s{i}.region = d.region AND s{i}.dim = d.dim GROUP BY ALL),
r{i} AS (SELECT *, CAST(row_number() OVER (PARTITION BY region ORDER BY std * abs(c) DESC, dim) AS INTEGER) AS rank FROM c{i}),
t{i} AS (SELECT r.region, {i} AS round, r.rank, r.dim, round(CASE WHEN r.rank = 1 THEN 1.0 ELSE r.c * f.std / r.std END, 6) AS coefficient
  FROM r{i} r JOIN r{i} f ON f.region = r.region AND f.rank = 1 WHERE r.rank <= 10)"""


TOPK = f"{DIMS}, st AS (SELECT region, dim, stddev_pop(v) AS std FROM d GROUP BY ALL), {', '.join(_round(i) for i in range(4))} " + " UNION ALL ".join(f"SELECT * FROM t{i}" for i in range(4))

SQL = {
    "latest_print": f"WITH {LATEST} SELECT iso_id, region, print_id FROM latest",
    "complete_isolates": f"WITH {LATEST} SELECT iso_id FROM latest GROUP BY 1 HAVING count(DISTINCT region) = (SELECT count(DISTINCT region) FROM ev)",
    "replicate_groups": f"WITH {EVENTS} SELECT iso_id, region, count(*) AS n FROM ev WHERE bad IS FALSE GROUP BY ALL HAVING count(*) > 1",
    "zscore_profiles": f"WITH {W} SELECT iso_id, region, CAST(unnest(range(32)) AS INTEGER) AS position, round(unnest(z), 6) AS z FROM prof",
    "profile_build": f"""WITH {W}, {PRINTS}, t AS (SELECT iso_id, max(print_id) AS p FROM pr WHERE bad IS FALSE GROUP BY 1),
r AS (SELECT t.iso_id, unnest(['A', 'B']) AS region, unnest([v[1:32], v[33:64]]) AS z FROM t JOIN e ON e.iso_id = t.p)
SELECT iso_id, region, CAST(len(z) AS INTEGER) AS n, round(list_sum(z), 6) AS total, round(z[32], 6) AS last FROM r""",
    "replicate_pairs": f"WITH {REPLICATES} SELECT region, iso_id, p1, p2, round(pearson, 6) AS pearson FROM rep",
    "replicate_counts": f"WITH {REPLICATES} SELECT region, count(*) AS n FROM rep GROUP BY 1",
    "neighbor_pairs": f"WITH {W}, {near(0.3)} SELECT a, b, round(pa, 6) AS pearson_a, round(pb, 6) AS pearson_b FROM edges",
    "neighbor_degree": f"WITH {W}, {near(0.3)}, g AS (SELECT w.iso_id, count(edges.a) AS degree FROM w LEFT JOIN edges ON w.iso_id = edges.a OR w.iso_id = edges.b GROUP BY 1) SELECT iso_id, degree, degree >= 3 AS is_core, round((SELECT avg(degree) FROM g), 6) AS avg_neighbours FROM g",
    "neighbor_distances": f"WITH {W}, {near(0.3)} SELECT a, b, round(list_distance(x.za, y.za), 6) AS distance, round(pa, 6) AS pearson FROM edges JOIN w x ON x.iso_id = a JOIN w y ON y.iso_id = b",
    "range_query": f"WITH {W}, {near(0.1)} SELECT a AS query_id, b AS iso_id FROM edges WHERE a % 10 = 0 UNION ALL SELECT b, a FROM edges WHERE b % 10 = 0",
    "neighbor_compare": f"""WITH {W}, {near(0.3)}, {near(0.28, "wider")}, s AS (SELECT a, b FROM edges UNION ALL SELECT b, a FROM edges), f AS (SELECT a, b FROM wider UNION ALL SELECT b, a FROM wider),
n AS (SELECT iso_id, (SELECT count(*) FROM s WHERE a = iso_id) AS c, (SELECT count(*) FROM f WHERE a = iso_id) AS r FROM w)
SELECT count(*) AS queries, count(*) FILTER (c = r) AS correct, count(*) FILTER (r > 0) AS non_empty, count(*) FILTER (c = r AND r > 0) AS non_empty_correct, CAST(sum(r - c) AS BIGINT) AS extra, CAST(0 AS BIGINT) AS missing FROM n""",
    "dbscan_membership": f"{DB} SELECT cluster_id, iso_id, is_core FROM db",
    "single_link": f"WITH RECURSIVE {W}, {near(0.3)}, {clusters(1)} SELECT cluster_id, iso_id FROM db",
    "noise": f"{DB} SELECT iso_id FROM w WHERE iso_id NOT IN (SELECT iso_id FROM db)",
    "cluster_overlaps": f"WITH {SEVENS} SELECT iso_id, count(DISTINCT cluster_id) AS n_clusters FROM sev GROUP BY 1 HAVING count(DISTINCT cluster_id) > 1",
    "cluster_stats": f"{DB}, s AS (SELECT cluster_id, count(*) AS n FROM db GROUP BY 1) SELECT count(*) AS n_clusters, min(n) AS min_size, max(n) AS max_size, round(avg(n), 6) AS mean_size, round(stddev_samp(n), 6) AS std_size, (SELECT count(*) FROM w WHERE iso_id NOT IN (SELECT iso_id FROM db)) AS noise FROM s",
    "cluster_size_hist": f"{DB}, s AS (SELECT cluster_id, count(*) AS n FROM db GROUP BY 1 HAVING count(*) > 1) SELECT count(*) FILTER (n < 4) AS below_4, count(*) FILTER (n >= 4 AND n < 8) AS from_4, count(*) FILTER (n >= 8 AND n < 16) AS from_8, count(*) FILTER (n >= 16 AND n < 32) AS from_16, count(*) FILTER (n >= 32 AND n < 64) AS from_32, count(*) FILTER (n >= 64 AND n < 128) AS from_64, count(*) FILTER (n >= 128) AS from_128 FROM s",
    "cluster_map": f"WITH {SEVENS} SELECT iso_id, max(cluster_id) AS cluster_id, count(*) - 1 AS extra FROM sev GROUP BY 1",
    "pair_counts": f"""WITH {LABELLED}, {SEVENS}, {LAST}, {PAIRS}, anyp AS (SELECT EXISTS (SELECT 1 FROM lab p JOIN lab q ON p.cluster_id = q.cluster_id WHERE p.iso_id = x.vec_id AND q.iso_id = y.vec_id) AS s1,
  EXISTS (SELECT 1 FROM sev p JOIN sev q ON p.cluster_id = q.cluster_id WHERE p.iso_id = x.vec_id AND q.iso_id = y.vec_id) AS s2 FROM embeddings x JOIN embeddings y ON x.vec_id < y.vec_id)
SELECT 'last' AS overlap, {COUNTS} FROM pairs UNION ALL SELECT 'any', {COUNTS} FROM anyp""",
    "similarity_indexes": f"WITH {LABELLED}, {SEVENS}, {LAST}, {PAIRS}, c AS (SELECT {COUNTS} FROM pairs), r AS (SELECT both_same / (both_same + one_of_each) AS jaccard, both_diff / (both_diff + one_of_each) AS another, (both_same + both_diff) / (both_same + one_of_each + both_diff) AS rand FROM c) SELECT round(jaccard, 6) AS jaccard, round(another, 6) AS another, round((jaccard + another) / 2, 6) AS average, round(rand, 6) AS rand FROM r",
    "pair_classes": f"""WITH {W}, p AS (SELECT list_dot_product(a.za, b.za) / 32 AS pa, list_dot_product(a.zb, b.zb) / 32 AS pb FROM w a JOIN w b ON a.iso_id < b.iso_id),
n AS (SELECT CASE WHEN pa >= 0.3 AND pb >= 0.3 THEN 'DS' WHEN pa <= 0.2 OR pb <= 0.2 THEN 'DD' ELSE 'squishy' END AS kind, count(*) AS n FROM p GROUP BY 1)
SELECT kind, coalesce(n, 0) AS n FROM (VALUES ('DS'), ('DD'), ('squishy')) k(kind) LEFT JOIN n USING (kind)""",
    "threshold_correctness": f"""WITH {W}, {LABELLED}, m1 AS (SELECT iso_id, max(cluster_id) AS c FROM lab GROUP BY 1),
p AS (SELECT list_dot_product(x.za, y.za) / 32 AS pa, list_dot_product(x.zb, y.zb) / 32 AS pb, coalesce(i.c = j.c, false) AS same FROM w x JOIN w y ON x.iso_id < y.iso_id LEFT JOIN m1 i ON i.iso_id = x.iso_id LEFT JOIN m1 j ON j.iso_id = y.iso_id),
k AS (SELECT same, CASE WHEN pa >= 0.3 AND pb >= 0.3 THEN 'DS' WHEN pa <= 0.2 OR pb <= 0.2 THEN 'DD' ELSE 'squishy' END AS kind FROM p),
c AS (SELECT count(*) FILTER (kind = 'DS') AS ds, count(*) FILTER (kind = 'DS' AND same) AS sds, count(*) FILTER (kind = 'DD') AS dd, count(*) FILTER (kind = 'DD' AND NOT same) AS ddd, count(*) FILTER (kind = 'squishy') AS sq, count(*) AS n FROM k)
SELECT round(sds / ds, 6) AS correct_ds, round(ddd / dd, 6) AS correct_dd, round((sds / ds + ddd / dd) / 2, 6) AS mean, round((sds + ddd) / (ds + dd), 6) AS tc_score, round(sq / n, 6) AS squishy_ratio FROM c""",
    "intra_pearsons": f"WITH {W}, {SEVENS}, {intra('sev')} SELECT cluster_id, a, b, region, round(pearson, 6) AS pearson FROM intra",
    "inter_slots": f"""WITH {REPLICATES}, {LABELLED}, {INTER}, r AS (SELECT region, round(pearson, 12) AS v FROM rep),
g AS (SELECT DISTINCT region, v FROM inter), k AS (SELECT g.region, g.v, count(*) FILTER (r.v < g.v) AS lt, count(*) FILTER (r.v <= g.v) AS le FROM g JOIN r ON r.region = g.region GROUP BY ALL)
SELECT c1, c2, inter.region, lt, le, count(*) AS n FROM inter JOIN k ON k.region = inter.region AND k.v = inter.v GROUP BY ALL""",
    "inter_pearsons": f"WITH {W}, {LABELLED}, {INTER} SELECT c1, c2, region, CAST(round(CAST(v AS DECIMAL(18, 12)), 6) AS DOUBLE) AS pearson, count(*) AS n FROM inter GROUP BY ALL",
    "beta_ks": f"WITH {W}, {LABELLED}, {intra('lab')}, {beta('intra')}",
    "beta_cluster_ks": f"WITH {W}, {SEVENS}, {intra('sev')}, act AS (SELECT * FROM intra WHERE cluster_id IN (SELECT cluster_id FROM sev GROUP BY 1 HAVING count(*) >= 8)), {beta('act', 'cluster_id, ')}",
    "beta_paired_ks": f"WITH {W}, {LABELLED}, {intra('lab')}, {MERGED}, {beta('act', 'c1, c2, ')}",
    "distribution_similarity": f"WITH {W}, {LABELLED}, {SEVENS}, {intra('lab', 'x1')}, {intra('sev', 'x2')}, {ks('x1', '', 'x1', 'x2', 't')} SELECT region, CAST(n1 AS BIGINT) AS n1, CAST(n2 AS BIGINT) AS n2, {KS_OUT} FROM t",
    "distribution_correctness": f"WITH {REPLICATES}, {LABELLED}, {intra('lab', 'x1')}, {ks('x1', '', 'x1', 'rep', 't')} SELECT region, CAST(n1 AS BIGINT) AS n1, CAST(n2 AS BIGINT) AS n2, {KS_OUT} FROM t",
    "cluster_ks": f"{CLUSTER_KS} SELECT cluster_id, region, CAST(n1 AS BIGINT) AS n, {KS_OUT} FROM t",
    "cluster_ks_describe": f"{CLUSTER_KS}, {described('t')}",
    "paired_ks_describe": f"{PAIRED_KS}, {described('t')}",
    "import_clusters": f"WITH {LINES} SELECT DISTINCT file, CAST(sum(fresh) OVER (PARTITION BY file ORDER BY n) - 1 AS BIGINT) AS cluster_ord, iso AS iso_id FROM mark",
    "id_list_diff": """WITH k AS (SELECT 'I' || vec_id AS iso_id FROM embeddings WHERE vec_id % 11 <> 3), l AS (SELECT DISTINCT 'I' || (vec_id + 5) AS iso_id FROM embeddings WHERE vec_id % 4 <> 1 AND label IS NOT NULL)
SELECT CASE WHEN l.iso_id IS NULL THEN 'missing' WHEN k.iso_id IS NULL THEN 'extra' ELSE 'shared' END AS status, coalesce(k.iso_id, l.iso_id) AS iso_id FROM k FULL JOIN l ON k.iso_id = l.iso_id""",
    "cluster_audit": AUDIT,
    "density_relations": f"{DB} SELECT a AS p, b AS q, EXISTS (SELECT 1 FROM db x JOIN db y ON x.cluster_id = y.cluster_id WHERE x.iso_id = a AND x.is_core AND y.iso_id = b) AS reachable, EXISTS (SELECT 1 FROM db x JOIN db y ON x.cluster_id = y.cluster_id WHERE x.iso_id = a AND y.iso_id = b) AS connected FROM edges",
    "clustering_equal": f"""WITH RECURSIVE {W}, {near(0.3)}, {clusters(1, "one")}, {clusters(3, "three")},
s AS (SELECT cluster_id, {SETS} AS m FROM one GROUP BY cluster_id), t AS (SELECT cluster_id, {SETS} AS m FROM three GROUP BY cluster_id)
SELECT 3 AS min_neighbors, 'first' AS side, cluster_id, unnest(m) AS iso_id FROM t WHERE m NOT IN (SELECT m FROM s)
UNION ALL SELECT 3, 'second', cluster_id, unnest(m) FROM s WHERE m NOT IN (SELECT m FROM t)""",
    "dim_profile": f"{DIMS} SELECT region, dim, count(*) AS n, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std FROM d GROUP BY ALL",
    "dim_correlation": f"{DIMS}, {CORR} SELECT region, dim, round(c, 6) AS correlation FROM co",
    "dim_topk": TOPK,
    "bounding_boxes": f"{DIMS}, {LABELLED} SELECT lab.cluster_id, region, dim, round(min(v), 6) AS low, round(max(v), 6) AS high FROM d JOIN lab ON lab.iso_id = d.iso_id GROUP BY ALL UNION ALL SELECT -1, region, dim, round(min(v), 6), round(max(v), 6) FROM d JOIN lab ON lab.iso_id = d.iso_id GROUP BY ALL",
    "median_split": f"WITH {W}, k AS (SELECT region, z[1] + 0.5 * z[2] - 0.25 * z[3] AS v FROM prof), r AS (SELECT region, v, row_number() OVER (PARTITION BY region ORDER BY v) - 1 AS i, count(*) OVER (PARTITION BY region) AS n FROM k) SELECT region, round(avg(v), 6) AS split FROM r WHERE i IN (n // 2, n // 2 + 1) GROUP BY 1",
    "exact_sample": "SELECT vec_id AS iso_id FROM embeddings ORDER BY md5(vec_id || ':1'), vec_id LIMIT 100",
    "region_parameters": f"WITH {W}, {LABELLED}, {intra('lab')}, p AS (SELECT a, region, avg(pearson) AS q FROM intra GROUP BY ALL) SELECT a, region, round(q, 6) AS pearson, round(sqrt(2 * 32 * (1 - q)), 6) AS distance FROM p",
}
