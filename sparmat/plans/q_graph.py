"""Queries over graphs, neighbours and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparmat.model import Matrix, orders_matrix
from sparmat.operators import aggregate as A
from sparmat.operators import graph as H
from sparmat.session import scratch_table, table


def _r(df, *cols, n=6):
    return df.select(*[F.round(c, n).alias(c) if c in cols else F.col(c) for c in df.columns])


def _weights(s):
    return s.createDataFrame([("R", 0.5), ("A", 0.25), ("N", 0.0)], "source string, weight double")


def _edges(s, d):
    """Customer -> supplier edges, the source is the return flag of the line: every customer is a node (even ids), every supplier another (odd ids)."""
    l, o = table(s, d, "lineitem"), table(s, d, "orders")  # noqa: E741
    e = l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select((2 * F.col("o_custkey")).alias("src"), (2 * F.col("l_suppkey") + 1).alias("dst"), F.col("l_returnflag").alias("source"))
    return H.weighted_edges(e, _weights(s))


def _graph(s, d):
    """The edges in both directions, so that ranks and values pass from either side."""
    g = _edges(s, d)
    return scratch_table(g.unionByName(g.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")), "graph")


def _node_values(s, d):
    """Logarithms of the balances of customers and suppliers."""
    v = lambda c: F.log1p(F.abs(c)).alias("value")
    c = table(s, d, "customer").select((2 * F.col("c_custkey")).alias("node"), v("c_acctbal"))
    return c.unionByName(table(s, d, "supplier").select((2 * F.col("s_suppkey") + 1).alias("node"), v("s_acctbal")))


def edges_weighted(s, d):
    return _r(_edges(s, d), "weight")


def hub_correction(s, d):
    return _r(H.hub_correction(scratch_table(_edges(s, d), "edges"), 0.5), "weight")


def pagerank(s, d):
    seeds = s.createDataFrame([(6, 1.0), (16, 3.0)], "node bigint, weight double")
    return _r(H.pagerank(_graph(s, d), seeds, 0.5, 3), "rank", n=9)


def graph_moments(s, d):
    return _r(H.smooth_over_graph(_graph(s, d), _node_values(s, d), 1), "value")


def graph_diffusion(s, d):
    return _r(H.smooth_over_graph(_graph(s, d), _node_values(s, d), 3), "value")


def neighbour_hops(s, d):
    """Along the direction of the edges: both ways, two steps join nearly all pairs of customers."""
    g = scratch_table(_edges(s, d), "edges")
    return H.hops(g, g.select(F.col("src").alias("node")).unionByName(g.select(F.col("dst").alias("node"))).distinct(), 2)


def label_propagation(s, d):
    g = _graph(s, d)
    return H.label_propagation(g, g.select(F.col("src").alias("node")).distinct(), 2)


def components(s, d):
    """Parts linked where an order holds two of them with quantities above 45."""
    l = table(s, d, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("p"))  # noqa: E741
    first = l.groupBy("o").agg(F.min("p").alias("src"))
    e = l.join(first, "o").select("src", F.col("p").alias("dst"))
    return H.connected_components(e, l.select(F.col("p").alias("node")).distinct())


def jaccard_parts(s, d):
    return _r(H.set_similarity(table(s, d, "lineitem"), "l_partkey", "l_orderkey", 2), "jaccard")


def cosine_parts(s, d):
    return _r(H.cosine_of_items(orders_matrix(s, d).entries, 2), "cosine")


def idf_l2(s, d):
    m = orders_matrix(s, d)
    return _r(H.idf_l2(m.entries, m.obs.agg(F.count(F.lit(1)).alias("n")).scalar()), "value")


def _vectors(s, d):
    return table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))


def _queries(s, d):
    return _vectors(s, d).where("id % 50 = 0")


def knn_exact(s, d):
    return _r(H.knn_exact(_queries(s, d), _vectors(s, d), 10), "dist", n=5)


def knn_connectivities(s, d):
    return _r(H.gaussian_connectivities(H.knn_exact(_queries(s, d), _vectors(s, d), 10)), "weight", n=5)


def knn_transitions(s, d):
    near = H.knn_exact(_queries(s, d), _vectors(s, d), 10).select("id", "other", (1 - F.col("dist") * F.col("dist") / 2).alias("cosine"))
    return _r(H.transition_probabilities(near, 4.0), "p", n=5)


def lof(s, d):
    return _r(H.local_outlier_factor(_queries(s, d), _vectors(s, d), 5), "lof", n=5)


def kernel_density(s, d):
    return _r(H.kernel_density(_queries(s, d), _vectors(s, d), 0.5), "density", n=5)


def pca(s, d):
    return H.principal_components(_vectors(s, d), 3).select("id", F.transform("pcs", lambda x: F.round(x, 5)).alias("pcs"))


def kmeans(s, d):
    return _r(H.kmeans(_vectors(s, d), 10, 8), "dist", n=5)


def nmf(s, d):
    data = _vectors(s, d).select("id", F.transform("vec", lambda x: F.greatest(x.cast("double"), F.lit(0.0))).alias("vec"))
    return H.nmf(data, 5, 10)[0].select("id", F.transform("usage", lambda x: F.round(x, 5)).alias("usage"))


def velocity_gamma(s, d):
    l = table(s, d, "lineitem").select("l_suppkey", "l_quantity", "l_extendedprice")  # noqa: E741
    return _r(H.slope_through_origin(l, "l_suppkey", "l_quantity", "l_extendedprice"), "gamma")


def velocity_gamma_extreme(s, d):
    l = table(s, d, "lineitem").select("l_suppkey", "l_quantity", "l_extendedprice")  # noqa: E741
    return _r(H.slope_through_origin(l, "l_suppkey", "l_quantity", "l_extendedprice", 0.9), "gamma")


def _bulk(s, d):
    """Nations as samples, brands as variables: pseudo-bulk counts."""
    m = orders_matrix(s, d)
    c = table(s, d, "customer").select(F.col("c_custkey").alias("custkey"), F.col("c_nationkey").alias("nation"))
    e = m.entries.join(m.obs.select("obs_id", "custkey"), "obs_id").join(c, "custkey").join(m.var.select("var_id", "brand"), "var_id")
    e = e.groupBy(F.col("nation").alias("obs_id"), F.col("brand").alias("var_id")).agg(F.sum("value").alias("value"))
    return Matrix(e, table(s, d, "nation").select(F.col("n_nationkey").alias("obs_id"), F.col("n_regionkey").alias("region")), m.var.select(F.col("brand").alias("var_id")).distinct())


def moment_dispersions(s, d):
    m = _bulk(s, d)
    return _r(H.moment_dispersions(m, A.size_factors(m)), "mean", "dispersion")


def negative_binomial_fit(s, d):
    m = _bulk(s, d)
    sf = scratch_table(A.size_factors(m), "size-factors")
    disp = H.moment_dispersions(m, sf).select("var_id", F.greatest("dispersion", F.lit(1e-8)).alias("dispersion"))
    c = m.entries.join(sf, "obs_id").join(m.obs, "obs_id").join(disp, "var_id")
    rows = c.select("var_id", F.col("value").alias("y"), "size_factor", (F.col("region") == 0).cast("double").alias("x"), "dispersion")
    return _r(H.negative_binomial_fit(rows), "intercept", "lfc", "lfc_se", n=5)


def simulated_doublets(s, d):
    m = orders_matrix(s, d)
    return H.simulate_doublets(m.entries, m.obs, 2)


FUNCS = (
    edges_weighted, hub_correction, pagerank, graph_moments, graph_diffusion, neighbour_hops, label_propagation, components, jaccard_parts, cosine_parts, idf_l2, knn_exact,
    knn_connectivities, knn_transitions, lof, kernel_density, pca, kmeans, nmf, velocity_gamma, velocity_gamma_extreme, moment_dispersions, negative_binomial_fit, simulated_doublets,
)
QUERIES = {f.__name__: f for f in FUNCS}

_PR = lambda i: f", r{i} AS (SELECT node, sum(rank) AS rank FROM (SELECT dst AS node, 0.5 * rank * weight AS rank FROM r{i - 1} JOIN p ON node = src UNION ALL SELECT node, 0.5 * rank FROM r0) GROUP BY 1)"
_DF = lambda i: f", d{i} AS (SELECT src AS node, sum(weight * value) AS value FROM gl JOIN {'nv' if i == 1 else f'd{i - 1}'} v ON dst = v.node GROUP BY 1)"
_LP = lambda i: f""", v{i} AS (SELECT src AS node, arg_min(label, (-w, label)) AS label FROM (SELECT src, label, sum(weight) AS w FROM b JOIN {'v' + str(i - 1)} v ON dst = v.node GROUP BY 1, 2) GROUP BY 1)"""
_E = """WITH RECURSIVE w AS (SELECT 2 * o_custkey AS src, 2 * l_suppkey + 1 AS dst, sum(CASE l_returnflag WHEN 'R' THEN 0.5 WHEN 'A' THEN 0.25 ELSE 0 END)::DOUBLE AS weight
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2 HAVING sum(CASE l_returnflag WHEN 'R' THEN 0.5 WHEN 'A' THEN 0.25 ELSE 0 END) > 0),
b AS (SELECT * FROM w UNION ALL SELECT dst, src, weight FROM w), p AS (SELECT src, dst, weight / sum(weight) OVER (PARTITION BY src) AS weight FROM b),
nv AS (SELECT 2 * c_custkey AS node, ln(1 + abs(c_acctbal)) AS value FROM customer UNION ALL SELECT 2 * s_suppkey + 1, ln(1 + abs(s_acctbal)) FROM supplier),
gl AS (SELECT src, dst, weight / sum(weight) OVER (PARTITION BY src) AS weight FROM (SELECT * FROM b UNION ALL SELECT node, node, 1.0 FROM nv))
"""
_K = """WITH q AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings), pr AS (SELECT a.id, b.id AS other, list_distance(a.v, b.v) AS dist FROM q a, q b WHERE a.id <> b.id AND a.id % 50 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, other) AS rank FROM pr QUALIFY rank <= 10)
"""
_ORD = "WITH m AS (SELECT l_orderkey AS obs_id, l_partkey AS var_id, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2)"
ORACLE = {
    "edges_weighted": _E + "SELECT src, dst, round(weight, 6) AS weight FROM w",
    "hub_correction": _E + "SELECT src, dst, round(weight / sqrt(count(*) OVER (PARTITION BY dst)), 6) AS weight FROM w",
    "pagerank": _E + ", r0 AS (SELECT * FROM (VALUES (6, 0.25::DOUBLE), (16, 0.75::DOUBLE)) t(node, rank))" + _PR(1) + _PR(2) + _PR(3) + "SELECT node, round(rank, 9) AS rank FROM r3",
    "graph_moments": _E + _DF(1) + "SELECT node, round(value, 6) AS value FROM d1",
    "graph_diffusion": _E + _DF(1) + _DF(2) + _DF(3) + "SELECT node, round(value, 6) AS value FROM d3",
    "neighbour_hops": _E + "SELECT src AS node, src AS reached FROM b UNION SELECT src, dst FROM w",
    "label_propagation": _E + ", v0 AS (SELECT DISTINCT src AS node, src AS label FROM b)" + _LP(1) + _LP(2) + "SELECT node, label FROM v2",
    "components": """WITH RECURSIVE l AS (SELECT l_orderkey AS o, l_partkey AS p FROM lineitem WHERE l_quantity > 45), f AS (SELECT o, min(p) AS m FROM l GROUP BY 1),
e AS (SELECT DISTINCT m AS a, p AS b FROM l JOIN f USING (o) WHERE m <> p), b AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(node, reached) AS (SELECT p, p FROM (SELECT DISTINCT p FROM l) UNION SELECT r.node, b.b FROM r JOIN b ON r.reached = b.a)
SELECT node, min(reached) AS component FROM r GROUP BY 1""",
    "jaccard_parts": """WITH e AS (SELECT DISTINCT l_partkey AS p, l_orderkey AS o FROM lineitem), n AS (SELECT p, count(*) AS n FROM e GROUP BY 1), s AS (SELECT x.p AS a, y.p AS b, count(*) AS shared FROM e x JOIN e y ON x.o = y.o AND x.p < y.p GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT a, b, shared, round(shared / (u.n + v.n - shared), 6) AS jaccard FROM s JOIN n u ON u.p = a JOIN n v ON v.p = b""",
    "cosine_parts": _ORD
    + """, n AS (SELECT var_id, sqrt(sum(v * v)) AS n FROM m GROUP BY 1)
SELECT x.var_id AS a, y.var_id AS b, round(sum(x.v * y.v) / max(u.n * w.n), 6) AS cosine FROM m x JOIN m y ON x.obs_id = y.obs_id AND x.var_id < y.var_id JOIN n u ON u.var_id = x.var_id JOIN n w ON w.var_id = y.var_id GROUP BY 1, 2 HAVING count(*) >= 2""",
    "idf_l2": _ORD
    + """, n AS (SELECT count(*) AS n FROM orders), w AS (SELECT obs_id, var_id, v * ln(n / least(count(*) OVER (PARTITION BY var_id), n - 1)) AS x FROM m, n)
SELECT obs_id, var_id, round(x / sqrt(sum(x * x) OVER (PARTITION BY obs_id)), 6) AS value FROM w""",
    "knn_exact": _K + "SELECT id, other, round(dist, 5) AS dist, rank FROM k",
    "knn_connectivities": _K + "SELECT id, other, round(exp(-dist * dist / (2 * max(dist) OVER (PARTITION BY id) * max(dist) OVER (PARTITION BY id))), 5) AS weight FROM k",
    "knn_transitions": _K + ", e AS (SELECT id, other, exp(4 * (1 - dist * dist / 2)) - 1 AS w FROM k WHERE dist * dist < 2) SELECT id, other, round(w / sum(w) OVER (PARTITION BY id), 5) AS p FROM e",
    "lof": """WITH q AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings), pr AS (SELECT a.id, b.id AS other, list_distance(a.v, b.v) AS dist FROM q a, q b WHERE a.id <> b.id),
k AS (SELECT * FROM pr QUALIFY row_number() OVER (PARTITION BY id ORDER BY dist, other) <= 5), kd AS (SELECT id, max(dist) AS kd FROM k GROUP BY 1),
l AS (SELECT k.id, count(*) / sum(greatest(dist, kd)) AS lrd FROM k JOIN kd ON kd.id = k.other GROUP BY 1)
SELECT k.id, round(avg(b.lrd) / max(a.lrd), 5) AS lof FROM k JOIN l a ON a.id = k.id JOIN l b ON b.id = k.other WHERE k.id % 50 = 0 GROUP BY 1""",
    "kernel_density": """WITH q AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings)
SELECT a.id, round(avg(exp(-(list_distance(a.v, b.v) ** 2) / 0.5)), 5) AS density FROM q a, q b WHERE a.id % 50 = 0 GROUP BY 1""",
    "velocity_gamma": "SELECT l_suppkey, round(sum(l_quantity * l_extendedprice) / sum(l_quantity * l_quantity), 6) AS gamma FROM lineitem GROUP BY 1",
    "velocity_gamma_extreme": """WITH q AS (SELECT *, quantile_cont(l_quantity + l_extendedprice, 0.9) OVER (PARTITION BY l_suppkey) AS q FROM lineitem)
SELECT l_suppkey, round(sum(l_quantity * l_extendedprice) / sum(l_quantity * l_quantity), 6) AS gamma FROM q WHERE l_quantity + l_extendedprice >= q GROUP BY 1""",
    "moment_dispersions": """WITH b AS (SELECT c_nationkey AS obs_id, p_brand AS var_id, sum(l_quantity) AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
g AS (SELECT var_id, avg(ln(v)) AS g FROM b GROUP BY 1 HAVING count(*) = (SELECT count(*) FROM nation)), f AS (SELECT obs_id, exp(quantile_cont(ln(v) - g, 0.5)) AS sf FROM b JOIN g USING (var_id) GROUP BY 1),
s AS (SELECT var_id, sum(v / sf) AS s, sum((v / sf) * (v / sf)) AS q, (SELECT count(*) FROM nation) AS n, (SELECT avg(1 / sf) FROM f) AS z FROM b JOIN f USING (obs_id) GROUP BY 1)
SELECT var_id, round(s / n, 6) AS mean, round(greatest(0, ((q - n * (s / n) * (s / n)) / (n - 1) - z * s / n) / ((s / n) * (s / n))), 6) AS dispersion FROM s""",
}
