"""Queries of the smaller operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparmat.functions.text import barcode_code, barcode_text
from sparmat.model import orders_matrix
from sparmat.operators import aggregate as A
from sparmat.operators import extras as X
from sparmat.operators import genome as G
from sparmat.plans.q_genome import _frags, _genes
from sparmat.session import table


def _r(df, *cols, n=6):
    return df.select(*[F.round(c, n).alias(c) if c in cols else F.col(c) for c in df.columns])


def metacell_means(s, d):
    m = orders_matrix(s, d)
    return _r(X.metacell_means(m, m.obs.select("obs_id", F.col("custkey").alias("metacell"))), "value")


def _profile(s, d):
    """Parts laid along suppliers' nations as chromosomes: mean quantity per (priority, part) with a position."""
    m = orders_matrix(s, d)
    p = A.pseudobulk(m, "grp").select("grp", "var_id", F.col("mean_v").alias("value"))
    return p.join(m.var.select("var_id", "brand"), "var_id")


def cnv_smoothing(s, d):
    return _r(X.smooth_along_chromosomes(_profile(s, d), "grp", "brand", "var_id", "value", 5, 0.2).select("grp", "var_id", "smoothed"), "smoothed")


def cnv_reference_difference(s, d):
    p = _profile(s, d)
    ref = p.where(F.col("grp").isin("1-URGENT", "2-HIGH"))
    return _r(X.reference_difference(p.where("grp = '5-LOW'"), ref, "var_id", "value").select("var_id", "diff"), "diff")


def cnv_score(s, d):
    return _r(X.cluster_spread(_profile(s, d), "grp", "value"), "score", "iqr")


def footprint(s, d):
    return X.footprint(_frags(s, d), G.tss_sites(_genes(s, d)), "sample", 250)


def describe(s, d):
    return _r(X.describe(table(s, d, "orders"), ["o_orderpriority", "o_orderstatus"], "o_totalprice"), "mean", "sd", "min", "q1", "median", "q3", "max", n=4)


def sankey_flows(s, d):
    return X.flows(table(s, d, "orders"), "o_orderstatus", "o_orderpriority")


def clone_ids(s, d):
    c = table(s, d, "customer").select(F.col("c_custkey").alias("clone"), F.col("c_nationkey").alias("patient"))
    o = table(s, d, "orders").select(F.col("o_custkey").alias("clone"), "o_orderkey").join(c, "clone")
    return X.clone_ids(o, "patient", "clone", "o_orderkey")


def position_bits(s, d):
    b = table(s, d, "fragment").select(barcode_text(barcode_code(F.col("barcode"))).alias("seq")).where("seq IS NOT NULL")
    return _r(X.position_bits(b, "seq", 16), "share", "bits")


def layer_shares(s, d):
    l = table(s, d, "lineitem").select("l_shipdate", "l_suppkey", *[F.when(F.col("l_returnflag") == f, F.col("l_quantity")).otherwise(0.0).alias(n) for f, n in (("R", "spliced"), ("A", "unspliced"), ("N", "ambiguous"))])  # noqa: E741
    return _r(X.layer_shares(l, "l_suppkey", ["spliced", "unspliced", "ambiguous"]), "spliced", "unspliced", "ambiguous")


def top_mask(s, d):
    o = table(s, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return _r(X.top_mask(o, "o_orderpriority", "o_totalprice", 0.1).select("o_orderkey", "scaled", "top"), "scaled")


def scaled_mad(s, d):
    return _r(X.scaled_mad(table(s, d, "orders"), "o_orderpriority", "o_totalprice"), "mad", n=3)


def constant_variables(s, d):
    return X.constant_variables(orders_matrix(s, d))


def ambient_profile(s, d):
    return _r(X.ambient_profile(orders_matrix(s, d), 0, 100), "share", n=9)


def potency_bins(s, d):
    return X.quantile_bins(table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_discount"), "l_discount", [0.0, 0.02, 0.04, 0.06, 0.08, 0.11]).select("l_orderkey", "l_linenumber", "bin")


def rasterize(s, d):
    return X.rasterize(table(s, d, "lineitem"), F.col("l_quantity"), F.col("l_extendedprice") / 1000, 5.0)


def marker_filter(s, d):
    m = A.welch_markers(orders_matrix(s, d), "grp").select("grp", "var_id", F.round("pct", 9).alias("pct"), F.round("pct_reference", 9).alias("pct_reference"), F.round("lfc", 9).alias("lfc"))
    return X.marker_filter(m, 0.002, 0.0025, 0.1).select("grp", "var_id")


def column_correlations(s, d):
    return _r(X.correlation_with_self(table(s, d, "lineitem"), "l_returnflag", ["l_quantity", "l_extendedprice", "l_discount"]), "rho")


FUNCS = (
    metacell_means, cnv_smoothing, cnv_reference_difference, cnv_score, footprint, describe, sankey_flows, clone_ids, position_bits, layer_shares, top_mask, scaled_mad, constant_variables,
    ambient_profile, potency_bins, rasterize, marker_filter, column_correlations,
)
QUERIES = {f.__name__: f for f in FUNCS}

from sparmat.plans.q_genome import B  # noqa: E402
from sparmat.plans.q_matrix import ORACLE as _MATRIX  # noqa: E402
from sparmat.plans.q_matrix import M  # noqa: E402

_P = M + ", n AS (SELECT grp, count(*) AS n FROM o GROUP BY 1), pr AS (SELECT grp, var_id, brand, sum(v) / max(n.n) AS value FROM m JOIN o USING (obs_id) JOIN n USING (grp) JOIN p USING (var_id) GROUP BY 1, 2, 3)"
ORACLE = {
    "metacell_means": """WITH a AS (SELECT o_orderkey AS obs_id, o_custkey AS metacell FROM orders), n AS (SELECT metacell, count(*) AS n FROM a GROUP BY 1)
SELECT metacell, l_partkey AS var_id, round(sum(l_quantity) / max(n), 6) AS value FROM lineitem JOIN a ON obs_id = l_orderkey JOIN n USING (metacell) GROUP BY 1, 2""",
    "cnv_smoothing": _P + "SELECT grp, var_id, round(avg(greatest(-0.2, least(0.2, value))) OVER (PARTITION BY grp, brand ORDER BY var_id ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING), 6) AS smoothed FROM pr",
    "cnv_reference_difference": _P
    + """, r AS (SELECT var_id, min(value) AS lo, max(value) AS hi FROM pr WHERE grp IN ('1-URGENT', '2-HIGH') GROUP BY 1)
SELECT var_id, round(CASE WHEN value > hi THEN value - hi WHEN value < lo THEN value - lo ELSE 0 END, 6) AS diff FROM pr JOIN r USING (var_id) WHERE grp = '5-LOW'""",
    "cnv_score": _P + "SELECT grp, round(avg(abs(value)), 6) AS score, round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 6) AS iqr FROM pr GROUP BY 1",
    "footprint": B
    + """, h AS (SELECT sample, unnest(range(CASE WHEN rev THEN tss - pos ELSE pos - tss END - 3, CASE WHEN rev THEN tss - pos ELSE pos - tss END + 3)) AS "offset" FROM ins JOIN ts ON ins.chrom = ts.chr AND pos BETWEEN tss - 250 AND tss + 250)
SELECT sample, "offset", count(*) AS n FROM h WHERE abs("offset") <= 250 GROUP BY ALL""",
    "describe": """SELECT o_orderpriority, o_orderstatus, count(*) AS n, round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS sd, round(min(o_totalprice), 4) AS min,
 round(quantile_cont(o_totalprice, 0.25), 4) AS q1, round(median(o_totalprice), 4) AS median, round(quantile_cont(o_totalprice, 0.75), 4) AS q3, round(max(o_totalprice), 4) AS max FROM orders GROUP BY 1, 2""",
    "sankey_flows": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2",
    "clone_ids": """WITH f AS (SELECT c_nationkey AS patient, o_custkey AS clone, min(o_orderkey) AS k FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2) SELECT patient, clone, row_number() OVER (PARTITION BY patient ORDER BY k, clone) AS ordinal FROM f""",
    "position_bits": """WITH b AS (SELECT regexp_extract(upper(barcode), '(^|[^ACGT])([ACGT]{16})([^ACGT]|$)', 2) AS seq FROM fragment), l AS (SELECT p AS position, seq[p + 1] AS letter, count(*) AS c FROM b, range(16) t(p) WHERE seq <> '' GROUP BY ALL),
s AS (SELECT *, c / sum(c) OVER (PARTITION BY position) AS share FROM l)
SELECT position, letter, round(share, 6) AS share, round(share * (2 + sum(share * log2(share)) OVER (PARTITION BY position)), 6) AS bits FROM s""",
    "layer_shares": "SELECT l_suppkey, " + ", ".join(f"round(coalesce(sum(l_quantity) FILTER (l_returnflag = '{f}'), 0) / sum(l_quantity), 6) AS {n}" for f, n in (("R", "spliced"), ("A", "unspliced"), ("N", "ambiguous"))) + " FROM lineitem GROUP BY 1",
    "top_mask": """WITH q AS (SELECT *, min(o_totalprice) OVER w AS a, max(o_totalprice) OVER w AS b, quantile_cont(o_totalprice, 0.9) OVER w AS q FROM orders WINDOW w AS (PARTITION BY o_orderpriority))
SELECT o_orderkey, round(CASE WHEN b > a THEN (o_totalprice - a) / (b - a) ELSE 0 END, 6) AS scaled, o_totalprice >= q AS top FROM q""",
    "scaled_mad": "WITH a AS (SELECT *, median(o_totalprice) OVER (PARTITION BY o_orderpriority) AS m FROM orders) SELECT o_orderpriority, round(median(abs(o_totalprice - m)) / 0.6744897501960817, 3) AS mad FROM a GROUP BY 1",
    "constant_variables": """WITH m AS (SELECT l_orderkey, l_partkey, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2), s AS (SELECT l_partkey, min(v) AS a, max(v) AS b, count(*) AS k FROM m GROUP BY 1)
SELECT p_partkey AS var_id FROM part LEFT JOIN s ON l_partkey = p_partkey WHERE k IS NULL OR (a = b AND (k = (SELECT count(*) FROM orders) OR a = 0))""",
    "ambient_profile": M + ", t AS (SELECT obs_id FROM m GROUP BY 1 HAVING sum(v) > 0 AND sum(v) < 100) SELECT var_id, round(sum(v) / sum(sum(v)) OVER (), 9) AS share FROM m WHERE obs_id IN (SELECT obs_id FROM t) GROUP BY 1",
    "potency_bins": "SELECT l_orderkey, l_linenumber, least(4, " + " + ".join(f"CASE WHEN l_discount >= {e} THEN 1 ELSE 0 END" for e in (0.02, 0.04, 0.06, 0.08, 0.11)) + ") AS bin FROM lineitem",
    "rasterize": "SELECT CAST(floor(l_quantity / 5) AS BIGINT) AS px, CAST(floor(l_extendedprice / 1000 / 5) AS BIGINT) AS py, count(*) AS n FROM lineitem GROUP BY 1, 2",
    "marker_filter": "SELECT grp, var_id FROM (" + _MATRIX["markers"].replace(", 6) AS pct,", ", 9) AS pct,").replace(", 6) AS pct_reference", ", 9) AS pct_reference").replace(", 6) AS lfc", ", 9) AS lfc") + ") WHERE pct >= 0.002 AND pct_reference <= 0.0025 AND lfc >= 0.1",
    "column_correlations": " UNION ALL ".join(f"SELECT l_returnflag, '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS rho FROM lineitem GROUP BY 1" for a, b in (("l_quantity", "l_extendedprice"), ("l_quantity", "l_discount"), ("l_extendedprice", "l_discount"))),
}
