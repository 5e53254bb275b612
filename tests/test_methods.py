"""Trends, joins in time, permutations, communities, embeddings and frames on small fixtures."""

from __future__ import annotations

import math
import random
from hashlib import md5

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparmat.model import Matrix
from sparmat.operators import communities as C
from sparmat.operators import embedding as E
from sparmat.operators import relational as L
from sparmat.operators import selection as V
from sparmat.operators import significance as S
from sparmat.operators.temporal import asof_join
from sparmat.session import ranked, running_totals


def test_running_totals_and_places_per_key(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice(["hot"] * 8 + ["a", None]), i, rnd.randrange(5)) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, i int, v int").repartition(5)
    got = {r.i: r for r in ranked(running_totals(df, ["i"], ["v"], ["k"]), ["k"], [F.col("i").desc()], "place", size="n").collect()}
    for key in {r[0] for r in rows}:
        own, run = sorted(r for r in rows if r[0] == key), 0
        for j, (_, i, v) in enumerate(own if key else [r for r in rows if r[0] is None]):
            run += v
            assert got[i].run_v == run and got[i].n == len(own) and got[i].place == len(own) - j
    assert len(got) == 500
    assert ranked(df.limit(0), ["k"], ["i"], size="n").collect() == []


def test_asof_join_against_a_loop(spark):
    rnd = random.Random(2)
    t = lambda s: f"2024-01-{1 + s // 86400:02d} {s % 86400 // 3600:02d}:{s % 3600 // 60:02d}:{s % 60:02d}"
    left = [(i, rnd.choice("aab"), rnd.randrange(20 * 86400)) for i in range(200)] + [(900, None, 5), (901, "z", 5)]
    right = [(rnd.choice("aab"), rnd.randrange(20 * 86400), rnd.randrange(9)) for _ in range(60)]
    right += [right[0], (right[0][0], right[0][1], 99), (None, 3, 7)]
    dl = spark.createDataFrame([(i, k, t(s), 1) for i, k, s in left] + [(902, "a", None, 1)], "id int, k string, t string, v int").withColumn("t", F.to_timestamp("t"))
    dr = spark.createDataFrame([(k, t(s), v) for k, s, v in right], "k string, t string, v int").withColumn("t", F.to_timestamp("t"))
    got = {r.id: r.v_right for r in asof_join(dl, dr, "k", "t", ["v"]).collect()}
    assert len(got) == 203 and got[900] is None and got[901] is None and got[902] is None
    for i, k, s in left:
        best = max(((rs, v) for rk, rs, v in right if rk == k and rk is not None and rs <= s), default=None)
        assert got[i] == (best[1] if best else None)
    assert [r.v_right for r in asof_join(dl.limit(1), dr.limit(0), "k", "t", ["v"]).collect()] == [None]
    assert asof_join(dl.limit(0), dr, "k", "t", ["v"]).collect() == []


def test_local_trend_follows_a_curve(spark):
    x = np.linspace(0, 6, 400)
    y = np.sin(x)
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "id int, x double, y double")
    got = np.array([r.fit for r in V.local_trend(df, 0.15, 60).orderBy("id").collect()])
    assert np.abs(got - y).max() < 0.02
    one = V.local_trend(df.limit(1), 0.3).collect()
    assert one[0].fit == one[0].y
    same = V.local_trend(df.withColumn("x", F.lit(1.0)), 0.3).collect()
    assert all(abs(r.fit - same[0].fit) < 1e-12 for r in same)
    assert V.local_trend(df.limit(0)).collect() == []


def test_poisson_tail(spark):
    cases = [(1, 0.1), (3, 0.5), (10, 2.0), (5, 5.0), (40, 60.0), (300, 200.0), (1, 0.0), (1, 9.0)]
    df = spark.createDataFrame(cases, "c int, r double")
    got = [x.p for x in df.select(S.poisson_tail(F.col("c"), F.col("r")).alias("p")).collect()]
    for (c, r), p in zip(cases, got):
        term, low = math.exp(-r), 0.0
        for i in range(c):
            low += term
            term *= r / (i + 1)
        assert p == pytest.approx(1 - low, abs=1e-9)


def test_shuffles_are_bijections(spark):
    df = spark.range(50).withColumn("g", F.col("id") % 3)
    rows = S.shuffled_place(df, ["g"], "id", 4).collect()
    for g in range(3):
        for p in range(1, 5):
            own = [r.place for r in rows if (r.g, r.perm) == (g, p)]
            assert sorted(own) == list(range(1, len(own) + 1))
    assert len({tuple(r.id for r in sorted(rows, key=lambda r: r.place) if (r.g, r.perm) == (0, p)) for p in range(1, 5)}) == 4


def test_communities_of_a_planted_graph(spark):
    rnd = random.Random(5)
    edges = []
    for c in range(4):
        for i in range(12):
            for j in range(i):
                if rnd.random() < 0.7:
                    edges.append((c * 100 + i, c * 100 + j, 1.0))
    edges += [(0, 100, 1.0), (100, 200, 1.0), (200, 300, 1.0), (900, 901, 1.0)]
    g = spark.createDataFrame(edges + [(b, a, w) for a, b, w in edges], "src bigint, dst bigint, weight double")
    got = C.communities(g)
    found = {}
    for r in got.collect():
        found.setdefault(r.community, set()).add(r.node)
    assert {frozenset(s) for s in found.values()} == {frozenset(range(c * 100, c * 100 + 12)) for c in range(4)} | {frozenset({900, 901})}
    assert all(k == min(s) for k, s in found.items())
    assert C.modularity(g, got) > 0.6
    assert C.communities(g.limit(0)).collect() == []


def test_spectral_embedding_against_numpy(spark):
    rng = np.random.default_rng(3)
    x = (rng.random((60, 30)) < np.where(np.arange(60)[:, None] % 3 == np.arange(30)[None, :] % 3, 0.7, 0.08)).astype(float)
    rows = [(i, j, 1.0) for i in range(60) for j in range(30) if x[i, j]]
    obs = spark.createDataFrame([(i,) for i in range(61)], "obs_id int")
    got = {r.obs_id: r.vec for r in E.spectral_embedding(spark.createDataFrame(rows, "obs_id int, var_id int, value double"), obs, 3, 25).collect()}
    idf = np.log(61 / np.minimum(np.maximum(x.sum(0), 1), 60))
    w = x * idf
    w = w / np.linalg.norm(w, axis=1, keepdims=True)
    a = w @ w.T
    d = a.sum(1)
    e, u = np.linalg.eigh(a / np.sqrt(np.outer(d, d)))
    u = u[:, ::-1][:, :3]
    u = u * np.sign((u**3).sum(0)) * e[::-1][:3]
    assert set(got) == set(range(60)) and np.allclose(np.array([got[i] for i in range(60)]), u, atol=1e-3)
    assert E.spectral_embedding(spark.createDataFrame([], "obs_id int, var_id int, value double"), obs, 2).collect() == []


def test_doublets_lie_between_the_groups(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal((0, 0, 0), 0.1, (60, 3)), rng.normal((4, 0, 0), 0.1, (60, 3)), [[2.0, 0.0, 0.0]]])
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id bigint, vec array<double>")
    s = {r.id: r.score for r in E.doublet_scores(df, df.where("id % 10 = 0"), 5).collect()}
    assert set(s) == set(range(0, 121, 10)) and max(s, key=s.get) == 120


def test_frames(spark):
    key = ["source", "target"]
    a = spark.createDataFrame([("x", "y", 1.0), ("x", "y", 1.0), ("x", "z", 2.0)], "source string, target string, a double")
    b = spark.createDataFrame([("x", "z", 5.0), ("q", "z", None)], "source string, target string, b double")
    got = {(r.source, r.target): (r.a, r.b) for r in L.consensus_outer({"a": a, "b": b}, key).collect()}
    assert got == {("x", "y"): (1.0, None), ("x", "z"): (2.0, 5.0), ("q", "z"): (None, None)}
    e = lambda rows: spark.createDataFrame(rows, "obs_id int, var_id int, value double")
    obs, var = spark.createDataFrame([(1, 7.0), (2, 8.0)], "obs_id int, depth double"), spark.createDataFrame([(1, "g"), (2, "h")], "var_id int, gene string")
    layers = L.attach_layers({"s": e([(1, 1, 2.0), (2, 2, 3.0)]), "u": e([(1, 1, 4.0), (1, 2, 1.0), (9, 1, 1.0)])}, obs, var)
    assert sorted(tuple(r) for r in layers.collect()) == [(1, 1, 2.0, 4.0), (1, 2, 0.0, 1.0)]
    m = e([(1, 2, 5.0)])
    assert [r.value for r in L.resolve_variable("depth", obs, var, m).orderBy("obs_id").collect()] == [7.0, 8.0]
    assert [r.value for r in L.resolve_variable("h", obs, var, m).orderBy("obs_id").collect()] == [5.0, 0.0]
    with pytest.raises(KeyError):
        L.resolve_variable("none", obs, var, m)
    assert V.invalid_counts(e([(1, 1, 1.0), (1, 2, 0.5), (1, 3, -1.0), (1, 4, None), (1, 5, float("nan"))])).count() == 4
    assert L.select_slots(obs, ["depth", "no"]).columns == ["obs_id"]
    z = spark.range(1).select(*[c.alias(n) for n, c in zip("zp", S.wald(F.lit(1.96), F.lit(1.0)))]).first()
    assert z.p == pytest.approx(0.05, abs=1e-3)


def test_links_number_pairs_by_places(spark, monkeypatch):
    rnd = random.Random(6)
    a = [(rnd.choice("aaaaab") if i % 20 else None, None if i % 30 == 7 else rnd.randrange(25)) for i in range(60)] + [("only left", 1)]
    b = [(rnd.choice("aaaab"), None if i == 3 else rnd.randrange(12)) for i in range(20)] + [("only right", 1), (None, 2)]
    da, db = spark.createDataFrame(a, "k string, x int"), spark.createDataFrame(b, "k string, y int")
    rows = []
    monkeypatch.setattr(L, "running_totals", lambda df, *args, **kw: rows.append(df.count()) or running_totals(df, *args, **kw))
    got = L.link_keys(da, db, "k", "x", "y", "u", share=40).collect()
    last = lambda v: (v is None, v or 0)
    pairs = sorted(((k, x, y) for k, x in a for j, y in b if k == j and k is not None), key=lambda r: (r[0], last(r[1]), last(r[2])))
    assert [(r.k, r.x, r.y) for r in sorted(got, key=lambda r: int(r.unified[1:]))] == pairs
    assert sorted(int(r.unified[1:]) for r in got) == list(range(1, len(pairs) + 1))
    assert max(rows) <= len(a) < len(pairs)  # the rows of the tables are ordered, never the pairs
    assert L.link_keys(da, db.limit(0), "k", "x", "y", "u").collect() == []


def test_communities_do_not_depend_on_blocks(spark, monkeypatch):
    rnd = random.Random(7)
    pairs = {tuple(sorted(rnd.sample(range(70), 2))) for _ in range(420)}
    edges = [(a - 9, b - 9, 1.0 + (a * b) % 3) for a, b in pairs] + [(3, 3, 2.0), (200, 201, 1.0)]
    g = spark.createDataFrame(edges + [(b, a, w) for a, b, w in edges if a != b], "src bigint, dst bigint, weight double").repartition(3)
    written = []
    keep = C.scratch_table
    monkeypatch.setattr(C, "scratch_table", lambda df, label: written.append(label) or keep(df, label))
    whole = {tuple(r) for r in C.communities(g).collect()}
    assert len(whole) == 72 and written.count("moves") <= 5  # the passes of a small level are one task
    monkeypatch.setattr(C, "ALONE", 0)
    monkeypatch.setattr(C, "BLOCK", 50)
    assert {tuple(r) for r in C.communities(g).collect()} == whole
    assert written.count("moves") > 10
    nodes = np.array([0, 1, -5, 2**40, 12345, -(2**50)])
    even = [r.e for r in spark.createDataFrame([(int(x),) for x in nodes], "n bigint").select((F.pmod(F.xxhash64("n", F.lit(4)), F.lit(2)) == 0).alias("e")).collect()]
    assert C._free(nodes, 4).tolist() == even


def test_stars_join_what_the_edges_join():
    got = list(C._reduced(((np.array([a]), np.array([b])) for a, b in [(5, 9), (9, 7), (2, 3), (7, 4), (3, 2)]), most=2))
    a, b = (np.concatenate(x) for x in zip(*got))
    x, root = C._stars(a, b)
    assert dict(zip(x.tolist(), root.tolist())) == {5: 4, 7: 4, 9: 4, 3: 2}


def test_label_permutations_against_a_loop(spark, monkeypatch):
    rnd = random.Random(8)
    obs = [(i, rnd.choice(["a"] * 5 + ["b"] * 3 + ["c", None])) for i in range(90)]
    cells = [(rnd.randrange(95), rnd.randrange(12), float(rnd.randrange(4))) for _ in range(400)] + [(obs[0][0], 40, None)]
    e = spark.createDataFrame(cells, "obs_id long, var_id int, value double").repartition(3)
    pairs = spark.createDataFrame([(i, i + 1) for i in range(12)] + [(0, 1), (40, 2)], "ligand int, receptor int")
    ordered = []
    monkeypatch.setattr(S, "ranked", lambda df, *args, **kw: ordered.append(df.count()) or ranked(df, *args, **kw))
    monkeypatch.setattr(S, "_BITS", 2)
    m = Matrix(e, spark.createDataFrame(obs, "obs_id long, status string"), None)
    got = {tuple(r[:4]): (r.lr_mean, r.p) for r in S.label_permutation_p(m, "status", pairs, 6).collect()}
    assert 0 < max(ordered) < 6 * sum(g is not None for _, g in obs)  # only buckets that hold the last place of a group are ordered
    own = {i: g for i, g in obs if g}
    n = {g: list(own.values()).count(g) for g in "abc"}
    labels = [own]
    for p in range(1, 7):
        order = sorted(own, key=lambda i: (md5(f"{i}/{p}".encode()).hexdigest(), i))
        labels.append(dict(zip(order, [g for g in "abc" for _ in range(n[g])])))
    mean = lambda p, g, v: sum(x for i, w, x in cells if w == v and labels[p].get(i) == g and x is not None) / n[g]
    there = {(own[i], v) for i, v, x in cells if i in own}
    known = {(own[i], v) for i, v, x in cells if i in own and x is not None}
    want = {}
    for a in "abc":
        for b in "abc":
            for v, w in {(i, i + 1) for i in range(12)} | {(40, 2)}:
                if (a, v) in there and (b, w) in there:
                    lr = (mean(0, a, v) + mean(0, b, w)) / 2
                    share = sum(round((mean(p, a, v) + mean(p, b, w)) / 2, 9) >= round(lr, 9) for p in range(1, 7)) / 6
                    want[a, b, v, w] = (pytest.approx(lr), pytest.approx(share)) if (a, v) in known and (b, w) in known else (None, 0.0)
    assert got == want
    assert S.label_permutation_p(Matrix(e, m.obs.limit(0), None), "status", pairs, 6).collect() == []
