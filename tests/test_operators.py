"""Edge cases of the reference operators: nulls, ties, empty tables, extra columns; brute force where SQL is given none."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparmat.functions import stats
from sparmat.model import Matrix
from sparmat.operators import aggregate as A
from sparmat.operators import graph as H
from sparmat.operators import ligand_receptor as L
from sparmat.operators import significance as S
from sparmat.operators import normalize as N
from sparmat.operators import ranks as K
from sparmat.operators import relational as V
from sparmat.session import current


def matrix(spark, rows, obs="abc", var="gh"):
    e = spark.createDataFrame(rows, "obs_id string, var_id string, value double")
    o = spark.createDataFrame([(x, "k", "x") for x in obs], "obs_id string, grp string, var_id string")
    return Matrix(e, o, spark.createDataFrame([(v, v) for v in var], "var_id string, brand string"))


def test_zero_rule(spark):
    m = matrix(spark, [("a", "g", 2.0), ("b", "g", 4.0)])
    r = A.pseudobulk(Matrix(m.entries, m.obs.drop("var_id"), m.var), "grp", True).collect()
    assert len(r) == 1 and (r[0].n_obs, r[0].mean_v, r[0].median_v) == (3, 2.0, 2.0) and abs(r[0].var_v - 8 / 3) < 1e-12
    empty = Matrix(m.entries.limit(0), m.obs.drop("var_id"), m.var)
    assert A.pseudobulk(empty, "grp").collect() == [] and N.normalize_total(empty).collect() == []
    assert {r.total for r in A.qc_metrics(empty, F.col("brand") == "g").collect()} == {0.0}


def test_distribution_functions(spark):
    xs = [-6.0, -1.3, -0.1, 0.0, 0.4, 2.7, 8.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for r in df.select("x", stats.erfc(F.col("x")).alias("e"), stats.normal_cdf(F.col("x")).alias("n")).collect():
        assert abs(r.e - math.erfc(r.x)) < 2e-7 and abs(r.n - 0.5 * math.erfc(-r.x / 2**0.5)) < 2e-7
    g = spark.createDataFrame([(x,) for x in (0.3, 1.0, 5.5, 170.0)], "x double").select("x", stats.ln_gamma(F.col("x")).alias("l")).collect()
    assert all(abs(r.l - math.lgamma(r.x)) < 1e-8 * max(1, abs(math.lgamma(r.x))) for r in g)
    p = spark.createDataFrame([(0.3,)], "p double").select(stats.binomial_tail(5, 2, F.col("p")).alias("b")).collect()[0].b
    assert abs(p - sum(math.comb(5, j) * 0.3**j * 0.7 ** (5 - j) for j in range(2, 6))) < 1e-12


def test_current_versions(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", None), (2, "z", None), (None, "n", 3), (3, "x", 5), (3, "x", 5)], "k int, v string, loaded_at int")
    got = sorted((r.k or 0, r.v) for r in current(df, ["k"]).collect())
    assert got == [(0, "n"), (1, "b"), (2, "z"), (3, "x")]


def test_relational_edges(spark):
    df = spark.createDataFrame([("a-b", "x"), ("a", None), (None, "y")], "k string, v string")
    got = V.fraction(df, "k", "p", "-", 1, "none").select("p").collect()
    assert [r.p for r in got] == ["b", "none", "none"]
    assert V.exclude(df, "v", ["x"]).count() == 2 and V.keep(df, "v", ["x"]).count() == 1
    assert [r.l for r in V.label_where(df, "l", [F.col("v") == "x"]).collect()] == ["true", "false", "false"]
    one = spark.createDataFrame([(0.5, 0.5), (0.0, 0.5), (2.0, 0.5), (None, 0.5)], "x double, y double")
    square = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)]
    assert [r.g for r in one.select(V.polygon_gate(one, "x", "y", square).alias("g")).collect()] == [True, False, False, False]
    meta = spark.createDataFrame([("a", "@asis", "@k"), ("b", "lit", "@asis")], "k string, v string, w string")
    t = spark.createDataFrame([("a", "old", "o2"), ("b", "old", "o2"), ("c", "old", "o2")], "k string, v string, w string")
    assert sorted(tuple(r) for r in V.attach_metadata(t, meta, "k").select("k", "v", "w").collect()) == [("a", "old", "a"), ("b", "lit", "o2"), ("c", "old", "o2")]


def test_subsamples_are_stable(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 3).alias("g"))
    a = {r.id for r in V.subsample_per_group(df, "g", "id", 7, 1).collect()}
    b = {r.id for r in V.subsample_per_group(df.repartition(7), "g", "id", 7, 1).collect()}
    assert a == b and len(a) == 21
    assert 150 < V.subsample_fraction(df, "id", 0.25, 5).count() < 350


def test_components(spark):
    rnd = random.Random(0)
    edges = [(rnd.randrange(80), rnd.randrange(80)) for _ in range(50)] + [(200 + i, 201 + i) for i in range(30)]
    nodes = sorted({x for e in edges for x in e} | {500})
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    got = H.connected_components(spark.createDataFrame(edges, "src int, dst int"), spark.createDataFrame([(n,) for n in nodes], "node int"))
    assert {r.node: r.component for r in got.collect()} == {n: root(n) for n in nodes}


def test_components_of_long_paths(spark):
    """A path of shuffled ids: labels handed on hop by hop need more rounds than there are."""
    ids = list(range(100))
    random.Random(1).shuffle(ids)
    edges = spark.createDataFrame([*zip(ids, ids[1:]), (7, 900)], "src int, dst int")
    nodes = spark.createDataFrame([(i,) for i in [*ids, 500]], "node int")
    got = H.connected_components(edges, nodes).collect()
    assert {(r.node, r.component) for r in got} == {(i, 0) for i in ids} | {(500, 500)} and len(got) == 101
    with pytest.raises(RuntimeError):
        H.connected_components(edges, nodes, 1)


def test_graph_queries_over_whole_keys(spark, tmp_path):
    """Customers 1 and 41 are different nodes, and no customer is a supplier's node."""
    from sparmat.plans import q_graph as Q

    put = lambda n, rows, schema: spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{n}.parquet"))
    put("orders", [(1, 1), (2, 41), (3, 3)], "o_orderkey bigint, o_custkey bigint")
    put("lineitem", [(1, 1, "R"), (2, 61, "A"), (3, 3, "R"), (3, 1, "A"), (3, 61, "N")], "l_orderkey bigint, l_suppkey bigint, l_returnflag string")
    put("customer", [(i, float(i)) for i in (1, 3, 41)], "c_custkey bigint, c_acctbal double")
    put("supplier", [(i, 10.0 * i) for i in (1, 3, 61)], "s_suppkey bigint, s_acctbal double")
    d = str(tmp_path)
    assert {tuple(r) for r in Q.edges_weighted(spark, d).collect()} == {(2, 3, 0.5), (82, 123, 0.25), (6, 7, 0.5), (6, 3, 0.25)}
    assert {tuple(r) for r in Q.neighbour_hops(spark, d).collect()} == {(i, i) for i in (2, 6, 82, 3, 7, 123)} | {(2, 3), (82, 123), (6, 7), (6, 3)}
    assert {r.node for r in Q.label_propagation(spark, d).collect()} == {2, 6, 82, 3, 7, 123}
    assert {r.node: r.value for r in Q.graph_moments(spark, d).collect()}[82] == round(0.8 * math.log1p(41) + 0.2 * math.log1p(610), 6)


def test_doublets_of_every_observation(spark):
    obs = spark.range(2500).select(F.col("id").alias("obs_id"))
    got = H.simulate_doublets(obs.select("obs_id", F.lit(0).alias("var_id"), F.lit(1.0).alias("value")), obs, 2).collect()
    assert len(got) == 5000 and {r.value for r in got} == {2.0}
    first = [tuple(r.doublet.split("#")[0].split("+")) + (r.doublet[-1],) for r in got]
    assert all(len({(x[i], x[2]) for x in first}) == 5000 for i in (0, 1)) and not any(a == b for a, b, _ in first)
    few = H.simulate_doublets(obs.select("obs_id", F.lit(0).alias("var_id"), F.lit(1.0).alias("value")), obs.where("obs_id < 2"), 2).collect()
    assert len(few) == 4 and {r.value for r in few} == {2.0}


def test_models(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(c, 0.1, size=(60, 4)) for c in (0, 3, 9)])
    data = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id bigint, vec array<double>").repartition(3)
    got = {r.id: r.cluster for r in H.kmeans(data, 3, 5).collect()}
    assert [len({got[i] for i in range(60 * k, 60 * k + 60)}) for k in range(3)] == [1, 1, 1] and len(set(got.values())) == 3
    pcs = np.array([r.pcs for r in H.principal_components(data, 2).orderBy("id").collect()])
    u, s, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
    assert np.allclose(np.abs(pcs), np.abs(u[:, :2] * s[:2]), atol=1e-6)
    w, h = rng.random((90, 2)), rng.random((2, 6))
    pos = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(w @ h)], "id bigint, vec array<double>")
    usage, spectra = H.nmf(pos, 2, 60, 60)
    back = np.array([r.usage for r in usage.orderBy("id").collect()]) @ spectra
    assert np.abs(back - w @ h).mean() < 0.02
    near = H.knn_exact(data, data, 3).collect()
    assert len(near) == 540 and all(r.id // 60 == r.other // 60 for r in near)
    assert H.knn_exact(data.limit(0), data, 3).collect() == []


def test_negative_binomial(spark):
    rng = np.random.default_rng(1)
    rows = [("v", float(y), 1.0, float(i % 2), 0.01) for i, y in enumerate(rng.poisson([100, 400] * 30))]
    r = H.negative_binomial_fit(spark.createDataFrame(rows, "var_id string, y double, size_factor double, x double, dispersion double")).collect()[0]
    assert abs(r.lfc - 2) < 0.1 and 0 < r.lfc_se < 0.1


def test_permutations(spark):
    rnd = random.Random(2)
    obs = [(i, "hi" if i < 40 else "lo") for i in range(80)]
    rows = [(i, v, (5.0 if g == "hi" else 0.5) + rnd.random()) for i, g in obs for v in (1, 2)]
    m = Matrix(spark.createDataFrame(rows, "obs_id int, var_id int, value double"), spark.createDataFrame(obs, "obs_id int, grp string"), spark.createDataFrame([(1,), (2,)], "var_id int"))
    p = {(r.source, r.target): r.p for r in S.label_permutation_p(m, "grp", spark.createDataFrame([(1, 2)], "ligand int, receptor int"), 25).collect()}
    assert p["hi", "hi"] == 0 and p["lo", "lo"] == 1


def test_bh_ties_and_nulls(spark):
    df = spark.createDataFrame([("a", 0.01), ("a", 0.02), ("a", 0.02), ("a", None), ("b", 0.5)], "g string, p double")
    got = sorted((r.g, r.p or -1, r.q) for r in K.benjamini_hochberg(df, "p", ["g"]).collect() if r.q is not None)
    assert [round(q, 6) for _, _, q in got] == [0.02, 0.02, 0.02, 0.5]
    assert K.benjamini_hochberg(df, "p", ["g"]).count() == 5


@pytest.mark.parametrize("n", [0, 1])
def test_small_inputs(spark, n):
    df = spark.createDataFrame([("g", 1.0, 2.0)], "k string, x double, y double").limit(n)
    assert K.spearman(df, "k", "x", "y").count() == n
    assert A.flag_outliers(df, "k", "x", "mad", 2.0).count() == n
    assert K.linear_fit(df, "k", F.col("x"), F.col("y")).count() == n


def test_catalogue(spark, sf):
    import __spark_entry__ as e

    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q) and e.entry(spark).count() > 0
