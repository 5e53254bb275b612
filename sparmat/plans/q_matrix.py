"""Queries over the orders matrix: aggregation, quality control, normalisation, selection, clones."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparmat.model import Matrix, orders_matrix
from sparmat.operators import aggregate as A
from sparmat.operators import normalize as N
from sparmat.session import table

R = F.round


def _r(df, *cols):
    return df.select(*[R(c, 6).alias(c) if c in cols else F.col(c) for c in df.columns])


def pseudobulk(s, d):
    return _r(A.pseudobulk(orders_matrix(s, d), "grp"), "sum_v", "mean_v", "var_v")


def pseudobulk_quantiles(s, d):
    return _r(A.pseudobulk(orders_matrix(s, d), "status", True).select("status", "var_id", "median_v", "trimean_v"), "median_v", "trimean_v")


def aggregate_var(s, d):
    return _r(A.aggregate_var(orders_matrix(s, d), "brand"), "sum_v", "mean_v")


def aggregate_block(s, d):
    return _r(A.aggregate_block(orders_matrix(s, d), "grp", "brand"), "sum_v", "mean_v")


def grouped_rates(s, d):
    return _r(A.grouped_rates(orders_matrix(s, d), "grp", F.col("size") * 100), "rpm", "rpkm")


def _customers(s, d):
    n = table(s, d, "nation").select("n_nationkey", F.col("n_name").alias("nation"))
    return table(s, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).drop("n_nationkey")


def summary_cube(s, d):
    o = table(s, d, "orders").join(table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return A.summary_cube(o, "o_orderpriority", "c_mktsegment", "o_orderstatus")


def crosstab_columns(s, d):
    return _r(A.crosstab(_customers(s, d), "nation", "c_mktsegment", "columns"), "share")


def crosstab_index(s, d):
    return _r(A.crosstab(_customers(s, d), "nation", "c_mktsegment", "index"), "share")


def crosstab_all(s, d):
    return _r(A.crosstab(_customers(s, d), "nation", "c_mktsegment", "all"), "share")


def attached_mode(s, d):
    return A.mode_by(_customers(s, d), "nation", "c_mktsegment")


def qc_metrics(s, d):
    return _r(A.qc_metrics(orders_matrix(s, d), F.col("type").startswith("PROMO")), "total", "marked", "pct_marked")


def outliers_mad(s, d):
    return A.flag_outliers(table(s, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice"), "o_orderpriority", "o_totalprice", "mad", 2.0).select("o_orderkey", "outlier")


def outliers_tukey(s, d):
    return A.flag_outliers(table(s, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice"), "o_orderpriority", "o_totalprice", "tukey", 0.5).select("o_orderkey", "outlier")


def normalize_total(s, d):
    return _r(N.normalize_total(orders_matrix(s, d)), "value")


def log1p_layer(s, d):
    m = orders_matrix(s, d)
    return _r(N.log1p(N.normalize_total(m, 1e4)), "value")


def clr(s, d):
    return _r(N.clr(orders_matrix(s, d)), "value")


def zscore(s, d):
    return _r(N.zscore(orders_matrix(s, d)), "value")


def normalize_row(s, d):
    return _r(N.normalize_rows(orders_matrix(s, d).entries, "obs_id"), "value")


def normalize_column(s, d):
    return _r(N.normalize_rows(orders_matrix(s, d).entries, "var_id"), "value")


def hvg_binned(s, d):
    return _r(N.dispersion_bins(orders_matrix(s, d)), "mean", "disp", "disp_norm")


def hvg_top_n(s, d):
    b = N.dispersion_bins(orders_matrix(s, d)).select("var_id", R("disp_norm", 6).alias("disp_norm"))
    return N.top_rows(b, [F.col("disp_norm").desc(), "var_id"], 20)


def stable_variables(s, d):
    return _r(N.stable_variables(orders_matrix(s, d), 25, 0.0), "signal")


def top_accessible(s, d):
    return N.top_accessible(orders_matrix(s, d).entries, 0.1, 0.05, 30)


def _bulk(s, d) -> Matrix:
    """Orders of a priority as one observation: an aggregated matrix."""
    m = orders_matrix(s, d)
    e = m.entries.join(m.obs.select("obs_id", "grp"), "obs_id").groupBy(F.col("grp").alias("obs_id"), "var_id").agg(F.sum("value").alias("value"))
    return Matrix(e, m.obs.select(F.col("grp").alias("obs_id")).distinct(), m.var)


def size_factors(s, d):
    return _r(A.size_factors(_bulk(s, d)), "size_factor")


def markers(s, d):
    return _r(A.welch_markers(orders_matrix(s, d), "grp"), "mean_in", "mean_out", "score", "lfc", "pct", "pct_reference")


def _clones(s, d):
    """Customers as clones over the priorities of their orders; orders still pending have no clone."""
    return table(s, d, "orders").select(F.when(F.col("o_orderstatus") != "P", F.col("o_custkey")).alias("clone"), F.col("o_orderpriority").alias("cluster"), F.col("o_orderstatus").alias("sample"), "o_orderkey")


def clone_size(s, d):
    return _r(A.clone_size(_clones(s, d), "clone", "sample", 20).select("o_orderkey", "clone_size", "expanded", "relative_size"), "relative_size")


def clone_matrix(s, d):
    return A.clone_matrix(_clones(s, d), "clone", "cluster")


def clone_expansion(s, d):
    return _r(A.expansion(clone_matrix(s, d), "clone", "cluster"), "expansion")


def clone_plasticity(s, d):
    return _r(A.plasticity(clone_matrix(s, d), "clone", "cluster"), "plasticity")


def clone_transition(s, d):
    return _r(A.entropy(clone_matrix(s, d), ["clone"], "n").select("clone", F.col("entropy").alias("transition")), "transition")


def clone_pairwise(s, d):
    return _r(A.pairwise_transition(clone_matrix(s, d), "clone", "cluster", "1-URGENT"), "transition")


def auroc(s, d):
    return _r(A.auroc(table(s, d, "lineitem").select("l_extendedprice", (F.col("l_returnflag") == "R").alias("y")), "l_extendedprice", "y"), "auroc", "average_precision")


FUNCS = (
    pseudobulk, pseudobulk_quantiles, aggregate_var, aggregate_block, grouped_rates, summary_cube, crosstab_columns, crosstab_index, crosstab_all, attached_mode, qc_metrics,
    outliers_mad, outliers_tukey, normalize_total, log1p_layer, clr, zscore, normalize_row, normalize_column, hvg_binned, hvg_top_n, stable_variables, top_accessible, size_factors,
    markers, clone_size, clone_matrix, clone_expansion, clone_plasticity, clone_transition, clone_pairwise, auroc,
)
QUERIES = {f.__name__: f for f in FUNCS}

M = """WITH m AS (SELECT l_orderkey AS obs_id, l_partkey AS var_id, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2),
o AS (SELECT o_orderkey AS obs_id, o_orderpriority AS grp, o_orderstatus AS status FROM orders),
p AS (SELECT p_partkey AS var_id, p_brand AS brand, p_type AS type, p_size AS size FROM part),
nobs AS (SELECT count(*) AS n FROM o), nvar AS (SELECT count(*) AS n FROM p)
"""
_C = """WITH c AS (SELECT CASE WHEN o_orderstatus <> 'P' THEN o_custkey END AS clone, o_orderpriority AS cluster, o_orderstatus AS sample, o_orderkey FROM orders),
k AS (SELECT clone, cluster, count(*) AS n FROM c WHERE clone IS NOT NULL GROUP BY 1, 2)
"""
_X = "WITH c AS (SELECT n_name AS nation, c_mktsegment FROM customer JOIN nation ON c_nationkey = n_nationkey) SELECT nation, c_mktsegment, count(*) AS n, round(count(*) / {}, 6) AS share FROM c GROUP BY 1, 2"
_CLASS = "CASE WHEN grouping({0}) = 1 THEN '.all' ELSE coalesce({0}, 'na') END AS {0}"
ORACLE = {
    "pseudobulk": M
    + """, n AS (SELECT grp, count(*) AS n FROM o GROUP BY 1)
SELECT grp, var_id, count(*) AS n_detected, max(n.n) AS n_obs, round(sum(v), 6) AS sum_v, round(sum(v) / max(n.n), 6) AS mean_v,
 round(sum(v * v) / max(n.n) - (sum(v) / max(n.n)) * (sum(v) / max(n.n)), 6) AS var_v FROM m JOIN o USING (obs_id) JOIN n USING (grp) GROUP BY 1, 2""",
    "pseudobulk_quantiles": M
    + """, n AS (SELECT status, count(*) AS n FROM o GROUP BY 1),
l AS (SELECT status, var_id, list(v) AS l FROM m JOIN o USING (obs_id) GROUP BY 1, 2),
z AS (SELECT status, var_id, list_concat(l, list_resize([]::DOUBLE[], n - len(l), 0.0)) AS l FROM l JOIN n USING (status))
SELECT status, var_id, round(list_aggregate(l, 'quantile_cont', 0.5), 6) AS median_v,
 round((list_aggregate(l, 'quantile_cont', 0.25) + 2 * list_aggregate(l, 'quantile_cont', 0.5) + list_aggregate(l, 'quantile_cont', 0.75)) / 4, 6) AS trimean_v FROM z""",
    "aggregate_var": M
    + ", n AS (SELECT brand, count(*) AS n FROM p GROUP BY 1) SELECT obs_id, brand, round(sum(v), 6) AS sum_v, round(sum(v) / max(n), 6) AS mean_v FROM m JOIN p USING (var_id) JOIN n USING (brand) GROUP BY 1, 2",
    "aggregate_block": M
    + """, a AS (SELECT grp, count(*) AS n FROM o GROUP BY 1), b AS (SELECT brand, count(*) AS k FROM p GROUP BY 1)
SELECT grp, brand, round(sum(v), 6) AS sum_v, round(sum(v) / max(n * k), 6) AS mean_v FROM m JOIN o USING (obs_id) JOIN p USING (var_id) JOIN a USING (grp) JOIN b USING (brand) GROUP BY 1, 2""",
    "grouped_rates": M
    + """, s AS (SELECT grp, var_id, sum(v) AS v FROM m JOIN o USING (obs_id) GROUP BY 1, 2), r AS (SELECT grp, var_id, v / sum(v) OVER (PARTITION BY grp) * 1e6 AS r FROM s)
SELECT grp, var_id, round(r, 6) AS rpm, round(r / (size * 100 / 1000), 6) AS rpkm FROM r JOIN p USING (var_id)""",
    "summary_cube": f"""SELECT {_CLASS.format('o_orderpriority')}, {_CLASS.format('c_mktsegment')}, {_CLASS.format('o_orderstatus')}, count(*) AS n
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY CUBE (o_orderpriority, c_mktsegment, o_orderstatus)""",
    "crosstab_columns": _X.format("sum(count(*)) OVER (PARTITION BY c_mktsegment)"),
    "crosstab_index": _X.format("sum(count(*)) OVER (PARTITION BY nation)"),
    "crosstab_all": _X.format("sum(count(*)) OVER ()"),
    "attached_mode": """WITH c AS (SELECT n_name AS nation, c_mktsegment, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2)
SELECT nation, c_mktsegment FROM c QUALIFY row_number() OVER (PARTITION BY nation ORDER BY n DESC, c_mktsegment) = 1""",
    "qc_metrics": M
    + """, e AS (SELECT obs_id, sum(v) AS t, count(*) FILTER (v > 0) AS d, sum(CASE WHEN type LIKE 'PROMO%' THEN v ELSE 0 END) AS k FROM m JOIN p USING (var_id) GROUP BY 1)
SELECT obs_id, round(coalesce(t, 0), 6) AS total, coalesce(d, 0) AS detected, round(coalesce(k, 0), 6) AS marked, round(CASE WHEN t > 0 THEN k / t ELSE 0 END, 6) AS pct_marked FROM o LEFT JOIN e USING (obs_id)""",
    "outliers_mad": """WITH a AS (SELECT *, median(o_totalprice) OVER (PARTITION BY o_orderpriority) AS med FROM orders), b AS (SELECT *, median(abs(o_totalprice - med)) OVER (PARTITION BY o_orderpriority) AS mad FROM a)
SELECT o_orderkey, o_totalprice < med - 2 * mad OR o_totalprice > med + 2 * mad AS outlier FROM b""",
    "outliers_tukey": """WITH q AS (SELECT o_orderpriority, quantile_cont(o_totalprice, 0.25) AS a, quantile_cont(o_totalprice, 0.75) AS b FROM orders GROUP BY 1)
SELECT o_orderkey, o_totalprice < a - 0.5 * (b - a) OR o_totalprice > b + 0.5 * (b - a) AS outlier FROM orders JOIN q USING (o_orderpriority)""",
    "normalize_total": M + ", t AS (SELECT obs_id, sum(v) AS t FROM m GROUP BY 1) SELECT obs_id, var_id, round(v * (SELECT avg(t) FROM t) / t, 6) AS value FROM m JOIN t USING (obs_id)",
    "log1p_layer": M + ", t AS (SELECT obs_id, sum(v) AS t FROM m GROUP BY 1) SELECT obs_id, var_id, round(ln(1 + v * 1e4 / t), 6) AS value FROM m JOIN t USING (obs_id)",
    "clr": M + ", t AS (SELECT obs_id, exp(sum(ln(1 + v)) / max(n)) AS g FROM m, nvar GROUP BY 1) SELECT obs_id, var_id, round(ln(1 + v / g), 6) AS value FROM m JOIN t USING (obs_id)",
    "zscore": M
    + """, t AS (SELECT var_id, sum(v) / max(n) AS mu, sqrt(sum(v * v) / max(n) - (sum(v) / max(n)) * (sum(v) / max(n))) AS sd FROM m, nobs GROUP BY 1)
SELECT obs_id, var_id, round(CASE WHEN sd > 0 THEN (v - mu) / sd ELSE 0 END, 6) AS value FROM m JOIN t USING (var_id)""",
    "normalize_row": M + "SELECT obs_id, var_id, round(v / (sum(v) OVER (PARTITION BY obs_id) + 1e-5), 6) AS value FROM m",
    "normalize_column": M + "SELECT obs_id, var_id, round(v / (sum(v) OVER (PARTITION BY var_id) + 1e-5), 6) AS value FROM m",
    "stable_variables": M
    + """, t AS (SELECT var_id, count(*) AS d, sum(ln(1 + v)) / max(n) AS mu, sum(ln(1 + v) * ln(1 + v)) / max(n) AS q FROM m, nobs GROUP BY 1)
SELECT var_id, round(round(mu / sqrt(q - mu * mu), 9), 6) AS signal FROM t ORDER BY round(mu / sqrt(q - mu * mu), 9) DESC, var_id LIMIT 25""",
    "top_accessible": M
    + """, t AS (SELECT var_id, sum(v) AS total FROM m GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY total, var_id) AS r, count(*) OVER () AS n FROM t)
SELECT var_id, total FROM r WHERE r > floor(0.1 * n) AND r <= n - floor(0.05 * n) ORDER BY total DESC, var_id LIMIT 30""",
    "size_factors": M
    + """, b AS (SELECT grp, var_id, ln(sum(v)) AS l FROM m JOIN o USING (obs_id) GROUP BY 1, 2), g AS (SELECT var_id, avg(l) AS g FROM b GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT grp) FROM o))
SELECT grp AS obs_id, round(exp(quantile_cont(l - g, 0.5)), 6) AS size_factor FROM b JOIN g USING (var_id) GROUP BY 1""",
    "markers": M
    + """, n AS (SELECT grp, count(*) AS n1 FROM o GROUP BY 1), s AS (SELECT grp, var_id, count(*) AS d, sum(v) AS s, sum(v * v) AS q FROM m JOIN o USING (obs_id) GROUP BY 1, 2),
t AS (SELECT var_id, sum(d) AS td, sum(s) AS ts, sum(q) AS tq FROM s GROUP BY 1),
x AS (SELECT *, nobs.n - n1 AS n2, s / n1 AS m1, (ts - s) / (nobs.n - n1) AS m2 FROM s JOIN t USING (var_id) JOIN n USING (grp), nobs),
y AS (SELECT *, sqrt(greatest(0, (q - n1 * m1 * m1) / (n1 - 1)) / n1 + greatest(0, (tq - q - n2 * m2 * m2) / (n2 - 1)) / n2) AS se FROM x)
SELECT grp, var_id, round(m1, 6) AS mean_in, round(m2, 6) AS mean_out, round(CASE WHEN se > 0 THEN (m1 - m2) / se ELSE 0 END, 6) AS score,
 round(log2((m1 + 1e-9) / (m2 + 1e-9)), 6) AS lfc, round(d / n1, 6) AS pct, round((td - d) / n2, 6) AS pct_reference FROM y""",
    "clone_size": _C
    + """, a AS (SELECT clone, count(*) AS s FROM c WHERE clone IS NOT NULL GROUP BY 1)
SELECT o_orderkey, coalesce(s, 0) AS clone_size, coalesce(s, 0) > 20 AS expanded, round(coalesce(coalesce(s, 0) / nullif(count(clone) OVER (PARTITION BY sample), 0), 0), 6) AS relative_size FROM c LEFT JOIN a USING (clone)""",
    "clone_matrix": _C + "SELECT * FROM k",
    "clone_expansion": _C
    + """, t AS (SELECT *, n / sum(n) OVER (PARTITION BY cluster) AS p FROM k)
SELECT cluster, round(CASE WHEN sum(n) < 5 OR count(*) < 2 THEN 0 ELSE 1 + sum(p * log2(p)) / log2(count(*)) END, 6) AS expansion FROM t GROUP BY 1""",
    "clone_plasticity": _C
    + """, s AS (SELECT clone, cluster AS other, n / sum(n) OVER (PARTITION BY clone) AS p FROM k),
e AS (SELECT k.cluster, other, sum(p) AS p FROM k JOIN s USING (clone) GROUP BY 1, 2), f AS (SELECT cluster, p / sum(p) OVER (PARTITION BY cluster) AS p FROM e)
SELECT cluster, round(CASE WHEN (SELECT sum(n) FROM k WHERE k.cluster = f.cluster) < 5 THEN 0 ELSE -sum(p * log2(p)) END, 6) AS plasticity FROM f GROUP BY 1""",
    "clone_transition": _C + ", t AS (SELECT clone, n / sum(n) OVER (PARTITION BY clone) AS p FROM k) SELECT clone, round(-sum(p * log2(p)), 6) AS transition FROM t GROUP BY 1",
    "clone_pairwise": _C
    + """, b AS (SELECT clone, n AS a FROM k WHERE cluster = '1-URGENT'), q AS (SELECT DISTINCT cluster FROM k WHERE cluster <> '1-URGENT'),
u AS (SELECT cluster, clone FROM q, (SELECT DISTINCT clone FROM k)), w AS (SELECT u.cluster, coalesce(a, 0) AS a, coalesce(k.n, 0) AS c FROM u LEFT JOIN b USING (clone) LEFT JOIN k ON k.cluster = u.cluster AND k.clone = u.clone)
SELECT cluster, round(sum(CASE WHEN a = 0 OR c = 0 THEN 0 ELSE -a * log2(a / (a + c)) - c * log2(c / (a + c)) END) / sum(a + c), 6) AS transition FROM w GROUP BY 1""",
    "auroc": """WITH d AS (SELECT l_extendedprice AS s, count(*) FILTER (l_returnflag = 'R') AS p, count(*) AS n FROM lineitem GROUP BY 1),
r AS (SELECT p, n, sum(n) OVER (ORDER BY s) - n + (n + 1) / 2 AS r, sum(p) OVER (ORDER BY s DESC) AS tp, sum(n) OVER (ORDER BY s DESC) AS al FROM d)
SELECT round((sum(r * p) - sum(p) * (sum(p) + 1) / 2) / (sum(p) * (sum(n) - sum(p))), 6) AS auroc, round(sum(p * tp / al) / sum(p), 6) AS average_precision FROM r""",
}
_HVG = M + """, s AS (SELECT var_id, sum(v) / max(n) AS mean, (sum(v * v) / max(n) - (sum(v) / max(n)) * (sum(v) / max(n))) / (sum(v) / max(n)) AS disp FROM m, nobs GROUP BY 1),
e AS (SELECT min(mean) AS lo, max(mean) AS hi FROM s), b AS (SELECT var_id, mean, disp, CAST(least(19, floor((mean - lo) / CASE WHEN hi > lo THEN hi - lo ELSE 1 END * 20)) AS INTEGER) AS bin FROM s, e),
z AS (SELECT *, count(*) OVER w AS k, avg(disp) OVER w AS mu, stddev_pop(disp) OVER w AS sd FROM b WINDOW w AS (PARTITION BY bin)),
h AS (SELECT var_id, round(mean, 6) AS mean, round(disp, 6) AS disp, bin, round(CASE WHEN k = 1 OR sd = 0 THEN 1 ELSE (disp - mu) / sd END, 6) AS disp_norm FROM z)
"""
ORACLE["hvg_binned"] = _HVG + "SELECT * FROM h"
ORACLE["hvg_top_n"] = _HVG + "SELECT var_id, disp_norm FROM h ORDER BY disp_norm DESC, var_id LIMIT 20"
