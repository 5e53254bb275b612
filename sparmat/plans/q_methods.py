"""Queries of trends, selection, permutations, peaks, communities, embeddings, joins in time and frames of experiments."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparmat.model import Matrix, orders_matrix
from sparmat.operators import aggregate as A
from sparmat.operators import communities as C
from sparmat.operators import embedding as E
from sparmat.operators import relational as L
from sparmat.operators import selection as V
from sparmat.operators import significance as S
from sparmat.operators.genome import insertions
from sparmat.operators.temporal import asof_join
from sparmat.plans.q_genome import _frags
from sparmat.plans.q_graph import _graph, _queries, _vectors
from sparmat.plans.q_ranks import _lr, _resource, _scores, _sets
from sparmat.session import scratch_table, table


def _r(df, *cols, n=6):
    return df.select(*[F.round(c, n).alias(c) if c in cols else F.col(c) for c in df.columns])


def asof_events(s, d):
    """Each event with the latest earlier purchase of its user."""
    e = table(s, d, "events")
    right = e.where("event_type = 'purchase'").select("user_id", (F.col("ts") + F.expr("INTERVAL 1 MICROSECOND")).alias("ts"), F.col("value").alias("last_value"))
    return asof_join(e.select("event_id", "user_id", "ts"), right, "user_id", "ts", ["last_value"]).select("event_id", "last_value")


def local_trend(s, d):
    """Parts: log of the total quantity against log of the price."""
    t = table(s, d, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(F.log(F.avg("l_extendedprice")).alias("x"), F.log1p(F.stddev_pop("l_extendedprice")).alias("y"))
    return _r(V.local_trend(t, 0.3, 20), "x", "y", "fit", n=5)


def hvg_standardized(s, d):
    return _r(V.standardized_variances(orders_matrix(s, d)), "mean", "var", "var_norm", n=5)


def hvg_standardized_top(s, d):
    v = V.standardized_variances(orders_matrix(s, d)).select("var_id", F.round("var_norm", 7).alias("var_norm"))
    return v.orderBy(F.col("var_norm").desc(), "var_id").limit(20).select("var_id")


def hvg_fano(s, d):
    return _r(V.fano_scores(orders_matrix(s, d)), "fano")


def entropy_residuals(s, d):
    return V.log_entropy_residuals(orders_matrix(s, d)).select("var_id", F.round("residual", 6).alias("residual"))


def _layers(s, d):
    """Suppliers x parts: quantities of finished (spliced) and open (unspliced) lines."""
    l = table(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("obs_id"), F.col("l_partkey").alias("var_id"), "l_linestatus").agg(F.sum("l_quantity").alias("value"))  # noqa: E741
    return {n: l.where(F.col("l_linestatus") == x).drop("l_linestatus") for n, x in (("spliced", "F"), ("unspliced", "O"))}


def splicing_filter(s, d):
    x = _layers(s, d)
    return V.shared_counts(x["spliced"], x["unspliced"], 60, 2)


def attach_layers(s, d):
    obs, var = table(s, d, "supplier").select(F.col("s_suppkey").alias("obs_id")), table(s, d, "part").select(F.col("p_partkey").alias("var_id"))
    return L.attach_layers(_layers(s, d), obs, var)


def gated_velocities(s, d):
    l = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount")  # noqa: E741
    return V.gate_velocities(l, "l_suppkey", "l_quantity", "l_extendedprice", "l_discount").select("l_orderkey", "l_linenumber", "gated", F.round(V.extrapolated(F.col("l_quantity"), F.col("gated"), 2.0), 6).alias("state"))


def invalid_counts(s, d):
    return V.invalid_counts(table(s, d, "obs").select("obs_id", F.col("pct_mito").alias("value"))).select("obs_id")


def motif_deviations(s, d):
    """Brands as motifs of the parts."""
    m = orders_matrix(s, d)
    return _r(V.deviations(m.entries, m.var.select(F.col("brand").alias("motif"), "var_id")), "deviation")


def gsea_permutations(s, d):
    m, sc = _scores(s, d)
    return _r(S.enrichment_permutations(sc, _sets(m), "grp", "score", 20), "es", "nes", "p", n=5)


def wald_tests(s, d):
    """Difference of the price of returned and other lines per part, in standard errors."""
    g = table(s, d, "lineitem").groupBy(F.col("l_partkey").alias("var_id")).agg(*[
        f(F.when((F.col("l_returnflag") == "R") == r, F.col("l_extendedprice"))).alias(f"{n}{i}") for i, r in ((1, True), (0, False)) for n, f in (("m", F.avg), ("v", F.var_samp), ("n", F.count))
    ])
    z, p = S.wald(F.col("m1") - F.col("m0"), F.sqrt(F.try_divide("v1", "n1") + F.try_divide("v0", "n0")))
    return _r(g.where("n1 > 1 AND n0 > 1").select("var_id", z.alias("z"), p.alias("p")), "z", "p", n=5)


def lr_permutation(s, d):
    m = orders_matrix(s, d)
    lines = table(s, d, "lineitem").select(F.col("l_orderkey").alias("obs_id"), F.col("l_partkey").alias("var_id"), F.col("l_quantity").alias("value"))
    return _r(S.label_permutation_p(Matrix(lines, m.obs, m.var), "status", _resource(m), 20), "lr_mean", "p")


def _bins(s, d):
    return insertions(_frags(s, d)).groupBy("chrom", F.floor(F.col("pos") / 2000).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def poisson_bins(s, d):
    return _r(S.poisson_bins(scratch_table(_bins(s, d), "bins"), table(s, d, "chrom_sizes"), 2000), "rate", "p", "q").select("chrom", "bin", "n", "rate", "p", "q")


def poisson_peaks(s, d):
    return S.poisson_peaks(scratch_table(_bins(s, d), "bins"), table(s, d, "chrom_sizes"), 2000, 0.2)


def communities(s, d):
    return C.communities(_graph(s, d))


def spectral_embedding(s, d):
    m = orders_matrix(s, d)
    return E.spectral_embedding(m.entries, m.obs, 4, 6).select("obs_id", F.transform("vec", lambda x: F.round(x, 4)).alias("vec"))


def doublet_scores(s, d):
    return _r(E.doublet_scores(_vectors(s, d), _queries(s, d), 10), "score", n=5)


def lr_consensus(s, d):
    x = scratch_table(_lr(s, d), "interactions")
    key = ["source", "target", "ligand", "receptor"]
    got = L.consensus_outer({"cpdb": x.where("round(cpdb, 9) > 0.06"), "sca": x.where("round(sca, 9) > 0.6")}, key)
    return _r(got, "cpdb", "sca")


def lr_filtered(s, d):
    x = _r(_lr(s, d).select("source", "target", "ligand", "receptor", "geomean"), "geomean")
    return L.filter_interactions(x, sources=["F"], targets=["O", "P"], criteria=[F.col("geomean") > 0.01])


def lr_group_cdf(s, d):
    m = orders_matrix(s, d)
    p = A.pseudobulk(m, "status")
    st = p.groupBy("status").agg(F.avg("mean_v").alias("mean"), F.stddev_pop("mean_v").alias("sd"), F.count(F.lit(1)).alias("n"))
    mean = p.select("status", "var_id", "mean_v")
    x = _resource(m).join(mean.select(F.col("status").alias("source"), F.col("var_id").alias("ligand"), F.col("mean_v").alias("l_mean")), "ligand")
    x = x.join(mean.select(F.col("status").alias("target"), F.col("var_id").alias("receptor"), F.col("mean_v").alias("r_mean")), "receptor")
    return _r(L.group_cdf(x.select("source", "target", "ligand", "receptor", "l_mean", "r_mean"), st, "status").drop("l_mean", "r_mean"), "ligand_cdf", "receptor_cdf", n=5)


def result_filter(s, d):
    from sparmat.plans.q_ranks import overrepresentation

    return L.filter_results(overrepresentation(s, d), {"p": 0.5}, ["p", "set"])


def spatial_roi(s, d):
    l = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"))  # noqa: E741
    t = L.transform_coordinates(l, x=lambda c: c * 2 + 1, y=lambda c: c / 1000)
    return _r(L.region_of_interest(t, "x", "y", (21.0, 61.0), (10.0, 40.0), "region", "core"), "y")


def resolved_variable(s, d):
    """Part 7 over all orders, found by its id."""
    m = orders_matrix(s, d)
    return L.resolve_variable("7", m.obs, m.var, m.entries)


def annotated_variables(s, d):
    g = table(s, d, "genes").select("uid", "gene", "chr")
    names = g.select(F.concat(F.lit("rna:x:"), "uid").alias("name")).unionByName(g.limit(0).select(F.col("gene").alias("name")))
    return L.annotate_variables(names, g, "name").select("name", "gene", "chr")


FUNCS = (
    asof_events, local_trend, hvg_standardized, hvg_standardized_top, hvg_fano, entropy_residuals, splicing_filter, attach_layers, gated_velocities, invalid_counts, motif_deviations, gsea_permutations,
    wald_tests, lr_permutation, poisson_bins, poisson_peaks, communities, spectral_embedding, doublet_scores, lr_consensus, lr_filtered, lr_group_cdf, result_filter, spatial_roi, resolved_variable, annotated_variables,
)
QUERIES = {f.__name__: f for f in FUNCS}

from sparmat.plans.q_genome import B  # noqa: E402
from sparmat.plans.q_matrix import M  # noqa: E402
from sparmat.plans.q_ranks import _ERFC, _LR, _T  # noqa: E402
from sparmat.plans.q_ranks import ORACLE as _RANKS  # noqa: E402


def _trend(points: str, span: float, g: int) -> str:
    """CTEs of a local quadratic regression over ``points`` (id, x, y): the result is ``tr`` (id, x, y, fit)."""
    return f""", tp AS (SELECT id, x, y, row_number() OVER (ORDER BY x, id) AS r, count(*) OVER () AS n FROM {points}),
tg AS (SELECT i AS g, n, 1 + CAST(floor(i * (n - 1) / (least({g}, n) - 1) + 0.5) AS BIGINT) AS c, least(n, greatest(4, CAST(floor({span} * n + 0.5) AS BIGINT))) AS q FROM (SELECT DISTINCT n FROM tp), range({g}) u(i) WHERE i < n),
tw AS (SELECT g, c, least(greatest(1, c - q // 2), n - q + 1) AS lo, least(greatest(1, c - q // 2), n - q + 1) + q - 1 AS hi FROM tg),
tv AS (SELECT g, lo, hi, b.x AS xc, greatest(b.x - a.x, d.x - b.x) * 1.000001 + 1e-12 AS h FROM tw JOIN tp a ON a.r = lo JOIN tp b ON b.r = c JOIN tp d ON d.r = hi),
te AS (SELECT g, xc, y, x - xc AS d, (1 - (abs(x - xc) / h) ** 3) ** 3 AS w FROM tv JOIN tp ON r BETWEEN lo AND hi),
ts AS (SELECT g, xc, sum(w) AS a, sum(w * d) AS b, sum(w * d ** 2) AS c, sum(w * d ** 3) AS e, sum(w * d ** 4) AS f, sum(w * y) AS t0, sum(w * d * y) AS t1, sum(w * d ** 2 * y) AS t2 FROM te GROUP BY 1, 2),
tf AS (SELECT g, xc, CASE WHEN abs(a * (c * f - e * e) - b * (b * f - c * e) + c * (b * e - c * c)) > 1e-10 * abs(a * c * f)
  THEN (t0 * (c * f - e * e) - b * (t1 * f - e * t2) + c * (t1 * e - c * t2)) / (a * (c * f - e * e) - b * (b * f - c * e) + c * (b * e - c * c)) ELSE t0 / a END AS fit FROM ts),
tk AS (SELECT xc AS x0, arg_max(fit, g) AS y0 FROM tf GROUP BY 1), tl AS (SELECT x0, y0, lead(x0) OVER w AS x1, lead(y0) OVER w AS y1 FROM tk WINDOW w AS (ORDER BY x0)),
tr AS (SELECT id, x, y, CASE WHEN x1 IS NULL THEN y0 ELSE y0 + (y1 - y0) / (x1 - x0) * (x - x0) END AS fit FROM (SELECT id, x, y FROM tp) p ASOF JOIN tl ON p.x >= tl.x0)"""


_HVG = M + ", mo AS (SELECT var_id, sum(v) / max(n) AS mean, (sum(v * v) - max(n) * (sum(v) / max(n)) ** 2) / (max(n) - 1) AS var, max(n) AS n FROM m, nobs GROUP BY 1), pt AS (SELECT var_id AS id, log10(mean) AS x, log10(var) AS y FROM mo WHERE var > 0 AND mean > 0)" + _trend("pt", 0.3, 50) + """,
rg AS (SELECT mo.*, sqrt(10 ** fit) AS sd FROM mo JOIN tr ON id = var_id), cl AS (SELECT var_id, sum(least(v, sd * sqrt(n) + mean)) AS c1, sum(least(v, sd * sqrt(n) + mean) ** 2) AS c2 FROM m JOIN rg USING (var_id) GROUP BY 1),
hv AS (SELECT mo.var_id, mo.mean, mo.var, coalesce((rg.n * rg.mean * rg.mean + c2 - 2 * c1 * rg.mean) / ((rg.n - 1) * sd * sd), 0) AS var_norm FROM mo LEFT JOIN rg USING (var_id) LEFT JOIN cl USING (var_id))
"""
_LAY = """WITH l AS (SELECT l_suppkey AS obs_id, l_partkey AS var_id, coalesce(sum(l_quantity) FILTER (l_linestatus = 'F'), 0) AS spliced, coalesce(sum(l_quantity) FILTER (l_linestatus = 'O'), 0) AS unspliced FROM lineitem GROUP BY 1, 2)
"""
_BINS = B + """, b AS (SELECT chrom, pos // 2000 AS bin, count(*) AS n FROM ins GROUP BY 1, 2), ge0 AS (SELECT (SELECT sum(n) FROM b) / (SELECT sum(ceil(len / 2000)) FROM chrom_sizes) AS g),
lo AS (SELECT a.chrom, a.bin, a.n, sum(k.n) / 11 AS local FROM b a JOIN b k ON a.chrom = k.chrom AND k.bin BETWEEN a.bin - 5 AND a.bin + 5 GROUP BY 1, 2, 3), ra AS (SELECT *, greatest(g, local) AS rate FROM lo, ge0),
pv AS (SELECT chrom, bin, n, rate, round(greatest(0, 1 - list_sum([exp(-rate + i * ln(rate) - lgamma(i + 1)) for i in range(n)])), 9) AS p FROM ra),
rq AS (SELECT *, count(*) OVER (ORDER BY p) AS r, count(*) OVER () AS t FROM pv), pq AS (SELECT chrom, bin, n, rate, p, least(1, min(p * t / r) OVER (ORDER BY p DESC)) AS q FROM rq)
"""
_GS = _T + """, n AS (SELECT grp, count(*) AS n FROM o GROUP BY 1), sc AS (SELECT grp, var_id, round(sum(v) / max(n.n) - 0.03, 9) AS score FROM m JOIN o USING (obs_id) JOIN n USING (grp) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY score DESC, var_id) AS rank, count(*) OVER (PARTITION BY grp) AS n FROM sc),
pm AS (SELECT grp, var_id, perm, row_number() OVER (PARTITION BY grp, perm ORDER BY md5(var_id || '/' || perm), var_id) AS place FROM sc, range(1, 21) t(perm)),
h AS (SELECT r.grp, 0 AS perm, "set", rank, score, n FROM r JOIN (SELECT DISTINCT "set", var_id FROM sg) USING (var_id)
  UNION ALL SELECT pm.grp, perm, "set", place, score, n FROM pm JOIN (SELECT DISTINCT "set", var_id FROM sg) s USING (var_id) JOIN r ON r.grp = pm.grp AND r.rank = place),
c AS (SELECT grp, perm, "set", sum(abs(score)) OVER w / sum(abs(score)) OVER p - (rank - row_number() OVER w) / (n - count(*) OVER p) AS up,
  (sum(abs(score)) OVER w - abs(score)) / sum(abs(score)) OVER p - (rank - row_number() OVER w) / (n - count(*) OVER p) AS down FROM h WINDOW w AS (PARTITION BY grp, perm, "set" ORDER BY rank), p AS (PARTITION BY grp, perm, "set")),
es AS (SELECT grp, perm, "set", CASE WHEN max(up) >= -min(down) THEN max(up) ELSE min(down) END AS es FROM c GROUP BY 1, 2, 3)
"""
ORACLE = {
    "asof_events": """WITH p AS (SELECT user_id, ts + INTERVAL 1 MICROSECOND AS ts, max(value) AS last_value FROM events WHERE event_type = 'purchase' GROUP BY 1, 2)
SELECT e.event_id, p.last_value FROM events e ASOF LEFT JOIN p ON e.user_id = p.user_id AND e.ts >= p.ts""",
    "local_trend": "WITH pt AS (SELECT l_partkey AS id, ln(avg(l_extendedprice)) AS x, ln(1 + stddev_pop(l_extendedprice)) AS y FROM lineitem GROUP BY 1)" + _trend("pt", 0.3, 20) + " SELECT id, round(x, 5) AS x, round(y, 5) AS y, round(fit, 5) AS fit FROM tr",
    "hvg_standardized": _HVG + "SELECT var_id, round(mean, 5) AS mean, round(var, 5) AS var, round(var_norm, 5) AS var_norm FROM hv",
    "hvg_standardized_top": _HVG + "SELECT var_id FROM hv ORDER BY round(var_norm, 7) DESC, var_id LIMIT 20",
    "hvg_fano": M + "SELECT var_id, round((sum(v * v) - max(n) * (sum(v) / max(n)) ** 2) / (max(n) - 1) / (sum(v) / max(n)), 6) AS fano FROM m, nobs GROUP BY 1",
    "entropy_residuals": M + ", pt AS (SELECT var_id AS id, ln(1 + sum(v) / max(n)) AS x, sum(ln(1 + v)) / max(n) AS y FROM m, nobs GROUP BY 1)" + _trend("pt", 0.3, 50) + " SELECT id AS var_id, round(fit - y, 6) AS residual FROM tr",
    "splicing_filter": _LAY + "SELECT var_id, sum(spliced + unspliced) AS shared, count(*) AS cells FROM l WHERE spliced > 0 AND unspliced > 0 GROUP BY 1 HAVING sum(spliced + unspliced) >= 60 AND count(*) >= 2",
    "attach_layers": _LAY + """, o AS (SELECT l_suppkey AS k FROM lineitem GROUP BY 1 HAVING bool_or(l_linestatus = 'F') AND bool_or(l_linestatus = 'O')), p AS (SELECT l_partkey AS k FROM lineitem GROUP BY 1 HAVING bool_or(l_linestatus = 'F') AND bool_or(l_linestatus = 'O'))
SELECT obs_id, var_id, spliced::DOUBLE AS spliced, unspliced::DOUBLE AS unspliced FROM l WHERE obs_id IN (SELECT k FROM o) AND var_id IN (SELECT k FROM p)""",
    "gated_velocities": """WITH t AS (SELECT *, l_quantity / greatest(max(l_quantity) OVER w, 1e-3) + l_extendedprice / greatest(max(l_extendedprice) OVER w, 1e-3) AS z FROM lineitem WINDOW w AS (PARTITION BY l_suppkey)),
q AS (SELECT *, CASE WHEN z >= 0.5 * quantile_cont(z, 0.98) OVER (PARTITION BY l_suppkey) THEN l_discount ELSE 0 END AS gated FROM t) SELECT l_orderkey, l_linenumber, gated, round(l_quantity + 2 * gated, 6) AS state FROM q""",
    "invalid_counts": "SELECT obs_id FROM obs WHERE pct_mito IS NULL OR isnan(pct_mito) OR pct_mito < 0 OR pct_mito <> floor(pct_mito)",
    "motif_deviations": M + """, d AS (SELECT obs_id, sum(v) AS d FROM m GROUP BY 1), s AS (SELECT brand, sum(v) / (SELECT sum(v) FROM m) AS s FROM m JOIN p USING (var_id) GROUP BY 1), h AS (SELECT obs_id, brand, sum(v) AS o FROM m JOIN p USING (var_id) GROUP BY 1, 2)
SELECT obs_id, brand AS motif, round((o - d * s) / (d * s), 6) AS deviation FROM h JOIN d USING (obs_id) JOIN s USING (brand)""",
    "gsea_permutations": _GS + """, n0 AS (SELECT a.grp, a."set", avg(abs(b.es)) AS m, avg(CASE WHEN round(abs(b.es), 9) >= round(abs(a.es), 9) THEN 1 ELSE 0 END) AS p FROM es a JOIN es b ON a.grp = b.grp AND a."set" = b."set" AND b.perm > 0 AND (a.es >= 0) = (b.es >= 0) WHERE a.perm = 0 GROUP BY 1, 2)
SELECT grp, "set", round(es, 5) AS es, round(es / m, 5) AS nes, round(p, 5) AS p FROM es LEFT JOIN n0 USING (grp, "set") WHERE perm = 0""",
    "wald_tests": """WITH g AS (SELECT l_partkey AS var_id, avg(l_extendedprice) FILTER (l_returnflag = 'R') AS m1, var_samp(l_extendedprice) FILTER (l_returnflag = 'R') AS v1, count(*) FILTER (l_returnflag = 'R') AS n1,
 avg(l_extendedprice) FILTER (l_returnflag <> 'R') AS m0, var_samp(l_extendedprice) FILTER (l_returnflag <> 'R') AS v0, count(*) FILTER (l_returnflag <> 'R') AS n0 FROM lineitem GROUP BY 1),
z AS (SELECT var_id, (m1 - m0) / nullif(sqrt(v1 / n1 + v0 / n0), 0) AS z FROM g WHERE n1 > 1 AND n0 > 1) SELECT var_id, round(z, 5) AS z, round(""" + _ERFC.format(x="(abs(z) / sqrt(2))") + ", 5) AS p FROM z",
    "lr_permutation": M + """, n AS (SELECT status, count(*) AS n FROM o GROUP BY 1), u AS (SELECT status, n, sum(n) OVER (ORDER BY status) - n AS a, sum(n) OVER (ORDER BY status) AS b FROM n),
h AS (SELECT obs_id, perm, row_number() OVER (PARTITION BY perm ORDER BY md5(obs_id || '/' || perm), obs_id) AS place FROM o, range(1, 21) t(perm)),
l AS (SELECT obs_id, perm, status FROM h JOIN u ON place > a AND place <= b UNION ALL SELECT obs_id, 0, status FROM o),
g AS (SELECT perm, status, var_id, sum(v) / max(n.n) AS mean FROM m JOIN l USING (obs_id) JOIN n USING (status) GROUP BY 1, 2, 3),
t AS (SELECT a.status AS source, b.status AS target, a.var_id AS ligand, b.var_id AS receptor, (a.mean + b.mean) / 2 AS lr FROM g a JOIN g b ON b.var_id = a.var_id + 11 AND a.perm = 0 AND b.perm = 0),
x AS (SELECT t.*, perm.perm, (coalesce(a.mean, 0) + coalesce(b.mean, 0)) / 2 AS v FROM t CROSS JOIN (SELECT range AS perm FROM range(1, 21)) perm LEFT JOIN g a ON a.perm = perm.perm AND a.status = t.source AND a.var_id = t.ligand LEFT JOIN g b ON b.perm = perm.perm AND b.status = t.target AND b.var_id = t.receptor)
SELECT source, target, ligand, receptor, round(max(lr), 6) AS lr_mean, round(avg(CASE WHEN round(v, 9) >= round(lr, 9) THEN 1 ELSE 0 END), 6) AS p FROM x GROUP BY 1, 2, 3, 4""",
    "poisson_bins": _BINS + "SELECT chrom, bin, n, round(rate, 6) AS rate, round(p, 6) AS p, round(q, 6) AS q FROM pq",
    "poisson_peaks": _BINS + """, s AS (SELECT chrom, bin, bin - row_number() OVER (PARTITION BY chrom ORDER BY bin) AS g FROM pq WHERE q <= 0.2) SELECT chrom, min(bin) * 2000 AS start, (max(bin) + 1) * 2000 AS "end" FROM s GROUP BY chrom, g""",
    "doublet_scores": """WITH q AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, row_number() OVER (ORDER BY md5(vec_id::VARCHAR), vec_id) AS r, count(*) OVER () AS n FROM embeddings),
e AS (SELECT id, v FROM q UNION ALL SELECT -a.r, [(x[1] + x[2]) / 2 for x in list_zip(a.v, b.v)] FROM q a JOIN q b ON b.r = CASE WHEN a.r = a.n THEN 1 ELSE a.r + 1 END),
k AS (SELECT a.id, b.id AS other FROM q a, e b WHERE a.id % 50 = 0 AND a.id <> b.id QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.v, b.v), b.id) <= 20),
s AS (SELECT id, count(*) FILTER (other < 0) AS simulated, (count(*) FILTER (other < 0) + 1) / 22 AS q FROM k GROUP BY 1) SELECT id, simulated, round(q * 0.1 / (1 - 0.1 - q * (1 - 0.2)), 5) AS score FROM s""",
    "lr_consensus": _LR + """, a AS (SELECT source, target, ligand, receptor, round(cpdb, 6) AS cpdb FROM lr WHERE round(cpdb, 9) > 0.06), b AS (SELECT source, target, ligand, receptor, round(sca, 6) AS sca FROM lr WHERE round(sca, 9) > 0.6)
SELECT * FROM a FULL JOIN b USING (source, target, ligand, receptor)""",
    "lr_filtered": _LR + "SELECT source, target, ligand, receptor, round(geomean, 6) AS geomean FROM lr WHERE source = 'F' AND target IN ('O', 'P') AND round(geomean, 6) > 0.01",
    "lr_group_cdf": M + """, n AS (SELECT status, count(*) AS n FROM o GROUP BY 1), g AS (SELECT status, var_id, sum(v) / max(n.n) AS mean FROM m JOIN o USING (obs_id) JOIN n USING (status) GROUP BY 1, 2), s AS (SELECT status, avg(mean) AS mu, stddev_pop(mean) AS sd, count(*) AS k FROM g GROUP BY 1),
x AS (SELECT a.status AS source, b.status AS target, a.var_id AS ligand, b.var_id AS receptor, (a.mean - u.mu) * sqrt(u.k) / u.sd AS zl, (b.mean - w.mu) * sqrt(w.k) / w.sd AS zr FROM g a JOIN g b ON b.var_id = a.var_id + 11 JOIN s u ON u.status = a.status JOIN s w ON w.status = b.status)
SELECT source, target, ligand, receptor, """ + ", ".join(f"round(0.5 * {_ERFC.format(x=f'(-z{c} / sqrt(2))')}, 5) AS {n}" for c, n in (("l", "ligand_cdf"), ("r", "receptor_cdf"))) + " FROM x JOIN p ON p.var_id = ligand",
    "result_filter": "SELECT * FROM (" + _RANKS["overrepresentation"] + ") WHERE p <= 0.5",
    "spatial_roi": "SELECT l_orderkey, l_linenumber, l_quantity * 2 + 1 AS x, round(l_extendedprice / 1000, 6) AS y, 'core' AS region FROM lineitem WHERE l_quantity * 2 + 1 BETWEEN 21 AND 61 AND l_extendedprice / 1000 BETWEEN 10 AND 40",
    "resolved_variable": M + "SELECT obs_id, coalesce(v, 0)::DOUBLE AS value FROM o LEFT JOIN (SELECT * FROM m WHERE var_id = 7) USING (obs_id)",
    "annotated_variables": "SELECT 'rna:x:' || uid AS name, gene, chr FROM genes",
}
