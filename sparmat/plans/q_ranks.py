"""Queries of ordered operators, enrichment, correlation and ligand-receptor scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from sparmat.functions.text import barcode_code
from sparmat.model import orders_matrix
from sparmat.operators import aggregate as A
from sparmat.operators import ligand_receptor as L
from sparmat.operators import ranks as K
from sparmat.session import table


def _r(df, *cols, n=6):
    return df.select(*[F.round(c, n).alias(c) if c in cols else F.col(c) for c in df.columns])


def _sets(m):
    return m.var.select(F.col("brand").alias("set"), "var_id", (1.0 + F.col("size") % 3).alias("weight"))


def rankings(s, d):
    return K.rankings(orders_matrix(s, d).entries)


def aucell(s, d):
    m = orders_matrix(s, d)
    return _r(K.recovery_auc(K.rankings(m.entries), _sets(m), 5), "auc")


def nes_zscore(s, d):
    m = orders_matrix(s, d)
    return _r(K.enrichment_scores(K.recovery_auc(K.rankings(m.entries), _sets(m), 5), m.obs.agg(F.count(F.lit(1)).alias("n")).scalar()), "nes")


def _scores(s, d):
    m = orders_matrix(s, d)
    return m, A.pseudobulk(m, "grp").select("grp", "var_id", F.round(F.col("mean_v") - 0.03, 9).alias("score"))


def gsea_running(s, d):
    m, sc = _scores(s, d)
    return _r(K.running_enrichment(sc, _sets(m), "grp", "score").select("grp", "set", "es", "at", F.size("leading_edge").alias("n_edge")), "es")


def gene_set_score(s, d):
    m = orders_matrix(s, d)
    return _r(K.gene_set_score(m, _sets(m).where("set = 'Brand#11'"), 25), "score")


def overrepresentation(s, d):
    m = orders_matrix(s, d)
    hits = m.entries.groupBy("var_id").agg(F.sum("value").alias("t")).where("t > 780")
    return _r(K.overrepresentation(hits, _sets(m), m.var.agg(F.count(F.lit(1)).alias("n")).scalar()), "p")


def chi2_enrichment(s, d):
    l = table(s, d, "lineitem")  # noqa: E741
    return _r(K.two_by_two(l, "l_suppkey", F.col("l_returnflag") == "R", F.col("l_quantity") > 25), "fold", "chi2", "p")


def bh_adjust(s, d):
    p = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", ((F.col("l_extendedprice").cast("bigint") % 1000) / 1000).alias("p"))
    return _r(K.benjamini_hochberg(p, "p", ["l_returnflag"]), "q")


def spearman_by_flag(s, d):
    return _r(K.spearman(table(s, d, "lineitem"), "l_returnflag", "l_quantity", "l_extendedprice"), "rho")


def pearson_masked(s, d):
    """Customers x part sizes: every pair of a size with one of the first seven."""
    m = orders_matrix(s, d)
    e = m.entries.join(m.obs.select("obs_id", "custkey"), "obs_id").join(m.var.select("var_id", "size"), "var_id")
    e = e.groupBy(F.col("custkey").alias("obs_id"), F.col("size").alias("var_id")).agg(F.sum("value").alias("value"))
    pairs = m.var.select(F.col("size").alias("a"), (F.col("size") % 7 + 1).alias("b")).where("a <> b").distinct()
    return _r(K.masked_pearson(e, pairs, 3), "rho")


def binned_trend(s, d):
    return _r(K.binned_trend(table(s, d, "events"), "event_type", F.unix_seconds(F.col("ts").cast("timestamp")).cast("double"), "value", 40), "value")


def moving_average(s, d):
    return _r(K.moving_average(table(s, d, "events"), "user_id", ["ts", "event_id"], "value", 3).select("event_id", "smoothed"), "smoothed")


def linear_fit(s, d):
    return _r(K.linear_fit(table(s, d, "lineitem"), "l_returnflag", F.col("l_quantity"), F.col("l_extendedprice")), "slope", "intercept", "r2", n=4)


def trimmed_mean(s, d):
    return _r(K.trimmed_mean(table(s, d, "orders"), "o_orderpriority", "o_totalprice", "o_orderkey", 0.125), "mean", "var", n=2)


def top_targets(s, d):
    m = orders_matrix(s, d)
    x = m.entries.join(m.obs.select("obs_id", "custkey"), "obs_id").groupBy("custkey", "var_id").agg(F.sum("value").alias("w"))
    return K.top_per_group(x, "custkey", [F.col("w").desc(), F.col("var_id")], 3).select("custkey", "var_id", "w", "rn")


def percentile_targets(s, d):
    m = orders_matrix(s, d)
    return K.above_percentile(m.entries, "obs_id", "value", 0.75)


def call_cells(s, d):
    c = table(s, d, "fragment").select(barcode_code(F.col("barcode")).alias("code")).where("code IS NOT NULL").groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    return K.call_cells(c, "code", "n", 1000).groupBy().agg(F.count(F.lit(1)).alias("cells"), F.min("n").alias("least"), F.sum("n").alias("fragments"))


def expression_entropy(s, d):
    return _r(K.expression_entropy(orders_matrix(s, d)), "mean_log", "log_mean")


def _resource(m):
    """Every part as a ligand of the part eleven further on."""
    return m.var.select(F.col("var_id").alias("ligand"), (F.col("var_id") + 11).alias("receptor"))


SCORES = ("cellchat", "cpdb", "connectome", "connectome_z", "geomean", "logfc", "natmi", "natmi_spec", "sca", "scseqcomm")


def _lr(s, d):
    m = orders_matrix(s, d)
    return L.score(m, "status", _resource(m), 0.0)


def lr_scores(s, d):
    return _r(_lr(s, d), *SCORES)


def _ranked(s, d):
    cols = ("cpdb", "natmi_spec", "logfc", "sca")
    x = _lr(s, d).select("source", "target", "ligand", "receptor", *[F.round(c, 9).alias(c) for c in cols])
    return K.relative_ranks(x, dict.fromkeys(cols, True)), [f"rank_{c}" for c in cols]


def lr_rank_mean(s, d):
    x, cols = _ranked(s, d)
    return _r(x.select("source", "target", "ligand", "receptor", (reduce(lambda a, b: a + b, [F.col(c) for c in cols]) / len(cols)).alias("mean_rank")), "mean_rank")


def lr_rank_rra(s, d):
    x, cols = _ranked(s, d)
    return _r(K.robust_rank_aggregate(x, cols).select("source", "target", "ligand", "receptor", "rho"), "rho")


def lr_pivot(s, d):
    return _lr(s, d).where("cpdb > 0.05").groupBy("source").pivot("target", ["F", "O", "P"]).count().fillna(0)


def lr_topn(s, d):
    x = _lr(s, d).groupBy("ligand", "receptor").agg(F.max(F.round("geomean", 9)).alias("best"))
    return x.orderBy(F.col("best").desc(), "ligand").limit(15)


def lr_complex_min(s, d):
    m = orders_matrix(s, d)
    st = A.pseudobulk(m, "status").select("status", "var_id", F.col("mean_v").alias("mean"), (F.col("n_detected") / F.col("n_obs")).alias("prop"))
    c = m.var.select(F.concat_ws("_", F.col("var_id").cast("string"), (F.col("var_id") + 1).cast("string")).alias("complex"))
    return _r(L.complex_minimum(L.explode_complexes(c, "complex"), ["complex"], "complex", st, "status"), "mean", "prop")


FUNCS = (
    rankings, aucell, nes_zscore, gsea_running, gene_set_score, overrepresentation, chi2_enrichment, bh_adjust, spearman_by_flag, pearson_masked, binned_trend, moving_average, linear_fit,
    trimmed_mean, top_targets, percentile_targets, call_cells, expression_entropy, lr_scores, lr_rank_mean, lr_rank_rra, lr_pivot, lr_topn, lr_complex_min,
)
QUERIES = {f.__name__: f for f in FUNCS}

from sparmat.plans.q_matrix import M  # noqa: E402

_T = M + """, sg AS (SELECT brand AS "set", var_id, 1.0 + size % 3 AS weight FROM p),
rk AS (SELECT *, row_number() OVER (PARTITION BY obs_id ORDER BY v DESC, var_id) - 1 AS rank FROM m),
sw AS (SELECT "set", sum(weight) AS w FROM sg GROUP BY 1),
au AS (SELECT obs_id, "set", sum(weight * (5 - rank)) / (5 * max(w)) AS auc FROM rk JOIN sg USING (var_id) JOIN sw USING ("set") WHERE rank < 5 GROUP BY 1, 2)
"""
_ERFC = (
    "(CASE WHEN {x} >= 0 THEN 1 ELSE -1 END * (1 / (1 + 0.5 * abs({x}))) * exp(-({x}) * ({x}) + (-1.26551223 + T * (1.00002368 + T * (0.37409196 + T * (0.09678418 + T * (-0.18628806 + T * (0.27886807 + T * (-1.13520398 + T * (1.48851587 + T * (-0.82215223 + T * 0.17087277))))))))))"
    " + CASE WHEN {x} >= 0 THEN 0 ELSE 2 END)"
).replace("T *", "(1 / (1 + 0.5 * abs({x}))) *")
_CHI = _ERFC.format(x="sqrt(greatest(chi2, 0) / 2)")
_CDF = lambda c: f"CASE WHEN {c}_mean = 0 THEN 0 ELSE 0.5 * {_ERFC.format(x=f'(-(({c}_mean - mu) * sqrt({c}_n) / nullif({c}_sd, 0)) / sqrt(2))')} END"
_LR = M + f""", n AS (SELECT status, count(*) AS n FROM o GROUP BY 1), tv AS (SELECT var_id, sum(v) AS ts, sum(v * v) AS tq FROM m GROUP BY 1),
l0 AS (SELECT status, var_id, list(v) AS l, count(*) AS d, sum(v) AS s, sum(v * v) AS q FROM m JOIN o USING (obs_id) GROUP BY 1, 2),
l1 AS (SELECT *, list_concat(l, list_resize([]::DOUBLE[], n - d, 0.0)) AS z FROM l0 JOIN n USING (status) JOIN tv USING (var_id), (SELECT n AS nn FROM nobs)),
st AS (SELECT status, var_id, s / n AS mean, d / n AS prop, sqrt(greatest(0, q / n - (s / n) * (s / n))) AS sd, n,
  (list_aggregate(z, 'quantile_cont', 0.25) + 2 * list_aggregate(z, 'quantile_cont', 0.5) + list_aggregate(z, 'quantile_cont', 0.75)) / 4 AS tri,
  CASE WHEN tq / nn - (ts / nn) * (ts / nn) > 0 THEN (s / n - ts / nn) / sqrt(tq / nn - (ts / nn) * (ts / nn)) ELSE 0 END AS zz, log2((s / n + 1) / ((ts - s) / (nn - n) + 1)) AS lfc FROM l1),
sm AS (SELECT var_id, sum(mean) AS s FROM st GROUP BY 1), g AS (SELECT (SELECT sum(v) FROM m) / ((SELECT n FROM nobs) * (SELECT n FROM nvar)) AS mu, (SELECT max(v) FROM m) AS top),
j AS (SELECT a.status AS source, b.status AS target, a.var_id AS ligand, b.var_id AS receptor, a.mean AS l_mean, b.mean AS r_mean, a.sd AS l_sd, b.sd AS r_sd, a.n AS l_n, b.n AS r_n,
  a.tri / top * b.tri / top AS tt, a.zz AS l_z, b.zz AS r_z, a.lfc AS l_lfc, b.lfc AS r_lfc, x.s AS l_sum, y.s AS r_sum, mu
  FROM p JOIN st a ON a.var_id = p.var_id JOIN st b ON b.var_id = p.var_id + 11 JOIN sm x ON x.var_id = a.var_id JOIN sm y ON y.var_id = b.var_id, g),
lr AS (SELECT source, target, ligand, receptor, tt / (0.5 + tt) AS cellchat, CASE WHEN l_mean = 0 OR r_mean = 0 THEN 0 ELSE (l_mean + r_mean) / 2 END AS cpdb, l_mean * r_mean AS connectome,
  (l_z + r_z) / 2 AS connectome_z, sqrt(l_mean * r_mean) AS geomean, (l_lfc + r_lfc) / 2 AS logfc, l_mean * r_mean AS natmi, (l_mean / l_sum) * (r_mean / r_sum) AS natmi_spec,
  sqrt(l_mean) * sqrt(r_mean) / (sqrt(l_mean) * sqrt(r_mean) + mu) AS sca, least({_CDF('l')}, {_CDF('r')}) AS scseqcomm FROM j)
"""
_RANK = _LR + ", r1 AS (SELECT source, target, ligand, receptor, " + ", ".join(
    f"rank() OVER (ORDER BY round({c}, 9) DESC) + (count(*) OVER (PARTITION BY round({c}, 9)) - 1) / 2 AS r{i}" for i, c in enumerate(("cpdb", "natmi_spec", "logfc", "sca"))
) + " FROM lr), rr AS (SELECT source, target, ligand, receptor, " + ", ".join(f"r{i} / max(r{i}) OVER () AS r{i}" for i in range(4)) + " FROM r1) "
ORACLE = {
    "rankings": _T + "SELECT obs_id, var_id, v AS value, rank FROM rk",
    "aucell": _T + 'SELECT obs_id, "set", round(auc, 6) AS auc FROM au',
    "nes_zscore": _T
    + """, z AS (SELECT "set", sum(auc) / max(n) AS mu, sqrt(sum(auc * auc) / max(n) - (sum(auc) / max(n)) * (sum(auc) / max(n))) AS sd FROM au, nobs GROUP BY 1)
SELECT obs_id, "set", round(CASE WHEN sd > 0 THEN (auc - mu) / sd ELSE 0 END, 6) AS nes FROM au JOIN z USING ("set")""",
    "gsea_running": _T
    + """, n AS (SELECT grp, count(*) AS n FROM o GROUP BY 1), sc AS (SELECT grp, var_id, round(sum(v) / max(n.n) - 0.03, 9) AS score FROM m JOIN o USING (obs_id) JOIN n USING (grp) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY score DESC, var_id) AS rank FROM sc),
f AS (SELECT r.*, s."set", x.var_id IS NOT NULL AS hit FROM r, (SELECT DISTINCT "set" FROM sg) s LEFT JOIN sg x ON x."set" = s."set" AND x.var_id = r.var_id),
c AS (SELECT *, sum(CASE WHEN hit THEN abs(score) ELSE 0 END) OVER w / sum(CASE WHEN hit THEN abs(score) ELSE 0 END) OVER (PARTITION BY grp, "set")
  - sum(CASE WHEN hit THEN 0 ELSE 1 END) OVER w / sum(CASE WHEN hit THEN 0 ELSE 1 END) OVER (PARTITION BY grp, "set") AS run FROM f WINDOW w AS (PARTITION BY grp, "set" ORDER BY rank)),
e AS (SELECT grp, "set", max(run) AS hi, min(run) AS lo, arg_max(rank, run) AS hr, arg_min(rank, run) AS lr FROM c GROUP BY 1, 2)
SELECT e.grp, e."set", round(CASE WHEN hi >= -lo THEN hi ELSE lo END, 6) AS es, CASE WHEN hi >= -lo THEN hr ELSE lr + 1 END AS at,
  CAST(count(*) FILTER (hit AND CASE WHEN hi >= -lo THEN rank <= hr ELSE rank > lr END) AS INTEGER) AS n_edge FROM e JOIN c ON c.grp = e.grp AND c."set" = e."set" GROUP BY ALL""",
    "gene_set_score": _T
    + """, t AS (SELECT var_id, coalesce(sum(v), 0) AS t FROM p LEFT JOIN m USING (var_id) GROUP BY 1), b AS (SELECT var_id, ntile(25) OVER (ORDER BY t, var_id) AS bin, var_id IN (SELECT var_id FROM sg WHERE "set" = 'Brand#11') AS s FROM t),
u AS (SELECT var_id, s FROM b WHERE bin IN (SELECT bin FROM b WHERE s)), k AS (SELECT count(*) FILTER (s) AS n1, count(*) FILTER (NOT s) AS n0 FROM u)
SELECT o.obs_id, round(coalesce(sum(v) FILTER (s), 0) / max(n1) - coalesce(sum(v) FILTER (NOT s), 0) / max(n0), 6) AS score FROM o LEFT JOIN (m JOIN u USING (var_id)) USING (obs_id), k GROUP BY 1""",
    "overrepresentation": _T
    + """, h AS (SELECT var_id FROM m GROUP BY 1 HAVING sum(v) > 780), k AS (SELECT "set", count(*) AS size, count(*) FILTER (var_id IN (SELECT var_id FROM h)) AS overlap, (SELECT count(*) FROM h) AS n FROM sg GROUP BY 1),
x AS (SELECT *, unnest(range(overlap, least(size, n) + 1)) AS i, (SELECT n FROM nvar) AS u FROM k)
SELECT "set", overlap, size, round(least(1, sum(CASE WHEN n - i <= u - size THEN exp(lgamma(size + 1) - lgamma(i + 1) - lgamma(size - i + 1) + lgamma(u - size + 1) - lgamma(n - i + 1) - lgamma(u - size - n + i + 1)
  - lgamma(u + 1) + lgamma(n + 1) + lgamma(u - n + 1)) ELSE 0 END)), 6) AS p FROM x GROUP BY ALL""",
    "chi2_enrichment": """WITH g AS (SELECT l_suppkey, count(*) FILTER (l_returnflag = 'R' AND l_quantity > 25)::DOUBLE AS a, count(*) FILTER (l_returnflag <> 'R' AND l_quantity > 25)::DOUBLE AS b,
 count(*) FILTER (l_returnflag = 'R' AND l_quantity <= 25)::DOUBLE AS c, count(*) FILTER (l_returnflag <> 'R' AND l_quantity <= 25)::DOUBLE AS d FROM lineitem GROUP BY 1),
h AS (SELECT *, CASE WHEN (a + b) * (c + d) * (a + c) * (b + d) > 0 THEN (a + b + c + d) * (a * d - b * c) ** 2 / ((a + b) * (c + d) * (a + c) * (b + d)) ELSE 0 END AS chi2 FROM g)
SELECT l_suppkey, round((a / (a + b)) / nullif(c / (c + d), 0), 6) AS fold, round(chi2, 6) AS chi2, round(CASE WHEN chi2 <= 0 THEN 1 ELSE """
    + _CHI
    + " END, 6) AS p FROM h",
    "bh_adjust": """WITH t AS (SELECT l_orderkey, l_linenumber, l_returnflag, (CAST(floor(l_extendedprice) AS BIGINT) % 1000) / 1000 AS p FROM lineitem),
r AS (SELECT *, count(*) OVER (PARTITION BY l_returnflag ORDER BY p) AS r, count(*) OVER (PARTITION BY l_returnflag) AS n FROM t)
SELECT l_returnflag, p, l_orderkey, l_linenumber, round(least(1, min(p * n / r) OVER (PARTITION BY l_returnflag ORDER BY p DESC)), 6) AS q FROM r""",
    "spearman_by_flag": """WITH r AS (SELECT l_returnflag, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2 AS x,
 rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_returnflag, l_extendedprice) - 1) / 2 AS y FROM lineitem) SELECT l_returnflag, round(corr(x, y), 6) AS rho FROM r GROUP BY 1""",
    "pearson_masked": """WITH m AS (SELECT o_custkey AS obs_id, p_size AS var_id, sum(l_quantity) AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
q AS (SELECT DISTINCT p_size AS a, p_size % 7 + 1 AS b FROM part WHERE p_size <> p_size % 7 + 1)
SELECT a, b, count(*) AS n, round(corr(x.v, y.v), 6) AS rho FROM q JOIN m x ON x.var_id = a JOIN m y ON y.var_id = b AND y.obs_id = x.obs_id GROUP BY 1, 2 HAVING count(*) >= 3""",
    "binned_trend": """WITH e AS (SELECT event_type, floor(epoch(ts)) AS x, value FROM events), b AS (SELECT event_type, min(x) AS lo, max(x) AS hi FROM e GROUP BY 1),
v AS (SELECT event_type, CAST(floor((x - lo) / (hi - lo) * 40) AS BIGINT) AS bin, avg(value) AS v FROM e JOIN b USING (event_type) GROUP BY 1, 2 HAVING floor((x - lo) / (hi - lo) * 40) < 40),
g AS (SELECT event_type, unnest(range(40)) AS bin FROM b)
SELECT event_type, bin, round(last_value(v IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY bin), 6) AS value FROM g LEFT JOIN v USING (event_type, bin)""".replace("GROUP BY 1, 2 HAVING floor((x - lo) / (hi - lo) * 40) < 40", "WHERE floor((x - lo) / (hi - lo) * 40) < 40 GROUP BY 1, 2"),
    "moving_average": "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), 6) AS smoothed FROM events",
    "linear_fit": "SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 4) AS r2 FROM lineitem GROUP BY 1",
    "trimmed_mean": """WITH r AS (SELECT o_orderpriority, o_totalprice, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey) AS r, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders)
SELECT o_orderpriority, round(avg(o_totalprice), 2) AS mean, round(var_pop(o_totalprice), 2) AS var FROM r WHERE r > floor(n * 0.125) AND r <= n - floor(n * 0.125) GROUP BY 1""",
    "top_targets": """WITH x AS (SELECT o_custkey AS custkey, l_partkey AS var_id, sum(l_quantity) AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)
SELECT *, row_number() OVER (PARTITION BY custkey ORDER BY w DESC, var_id) AS rn FROM x QUALIFY rn <= 3""",
    "percentile_targets": M + "SELECT obs_id, var_id, v AS value FROM m QUALIFY v > quantile_cont(v, 0.75) OVER (PARTITION BY obs_id)",
    "call_cells": """WITH c AS (SELECT regexp_extract(upper(barcode), '(^|[^ACGT])([ACGT]{16})([^ACGT]|$)', 2) AS b, count(*) AS n FROM fragment GROUP BY 1 HAVING b <> ''),
t AS (SELECT min(n) AS x FROM (SELECT n FROM c ORDER BY n DESC LIMIT 10)) SELECT count(*) AS cells, min(n) AS least, CAST(sum(n) AS BIGINT) AS fragments FROM c, t WHERE n * 10 >= x""",
    "expression_entropy": M + "SELECT var_id, round(sum(ln(1 + v)) / max(n), 6) AS mean_log, round(ln(1 + sum(v) / max(n)), 6) AS log_mean FROM m, nobs GROUP BY 1",
    "lr_scores": _LR + "SELECT source, target, ligand, receptor, " + ", ".join(f"round({c}, 6) AS {c}" for c in SCORES) + " FROM lr",
    "lr_rank_mean": _RANK + "SELECT source, target, ligand, receptor, round((r0 + r1 + r2 + r3) / 4, 6) AS mean_rank FROM rr",
    "lr_rank_rra": _RANK
    + """, so AS (SELECT source, target, ligand, receptor, list_sort([r0, r1, r2, r3]) AS r FROM rr)
SELECT source, target, ligand, receptor, round(least(1, 4 * least(1 - (1 - r[1]) ** 4, 6 * r[2] ** 2 * (1 - r[2]) ** 2 + 4 * r[2] ** 3 * (1 - r[2]) + r[2] ** 4, 4 * r[3] ** 3 * (1 - r[3]) + r[3] ** 4, r[4] ** 4)), 6) AS rho FROM so""",
    "lr_pivot": _LR + "SELECT source, " + ", ".join(f"count(*) FILTER (target = '{x}') AS {x}" for x in "FOP") + " FROM lr WHERE cpdb > 0.05 GROUP BY 1",
    "lr_topn": _LR + "SELECT ligand, receptor, max(round(geomean, 9)) AS best FROM lr GROUP BY 1, 2 ORDER BY best DESC, ligand LIMIT 15",
    "lr_complex_min": M
    + """, n AS (SELECT status, count(*) AS n FROM o GROUP BY 1), st AS (SELECT status, var_id, sum(v) / max(n.n) AS mean, count(*) / max(n.n) AS prop FROM m JOIN o USING (obs_id) JOIN n USING (status) GROUP BY 1, 2)
SELECT a.var_id || '_' || b.var_id AS complex, a.status, round(least(a.mean, b.mean), 6) AS mean, round(least(a.prop, b.prop), 6) AS prop FROM st a JOIN st b ON b.var_id = a.var_id + 1 AND a.status = b.status""",
}
