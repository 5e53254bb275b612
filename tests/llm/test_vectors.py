"""Clusters and neighbours against brute force."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparmat.llm import clusters, neighbours
from sparmat.llm.vectors import lists, matrix, unit, usable

DIM = 32


def planted(seed=0, sizes=(300, 150, 60, 20, 7), noise=150):
    rng = np.random.default_rng(seed)
    centres = np.linalg.qr(rng.normal(size=(DIM, DIM)))[0][: len(sizes)]
    x = [unit(c + rng.normal(scale=0.03, size=(n, DIM))) for c, n in zip(centres, sizes)]
    x.append(unit(rng.normal(size=(noise, DIM))))
    label = np.concatenate([np.full(n, i) for i, n in enumerate([*sizes, noise])])
    label[label == len(sizes)] = -1
    return np.concatenate(x), label


def frame(spark, x):
    return spark.createDataFrame([(int(i), [float(v) for v in r]) for i, r in enumerate(x)], "id bigint, vec array<float>").repartition(3)


def test_usable_vectors(spark):
    v = [1.0] * DIM
    bad = [None, [], v[:-1], [0.0] * DIM, [float("nan"), *v[1:]], [float("inf"), *v[1:]], [None, *v[1:]]]
    df = spark.createDataFrame([(x,) for x in [v, *bad]], "v array<float>")
    assert [r[0] for r in df.select(usable(F.col("v"), DIM)).collect()] == [True] + [False] * len(bad)


def test_unit_and_lists():
    x = np.array([[3e200, 4e200], [3e-300, 4e-300]])
    assert np.allclose(unit(x), [[0.6, 0.8]] * 2)
    assert matrix(lists(x[:0].reshape(0, 2)), 2).shape == (0, 2)


@pytest.mark.parametrize("local_rows", [100_000, 100])
def test_bisecting_finds_planted_clusters(spark, local_rows):
    x, label = planted()
    points = frame(spark, x)
    lim = clusters.Limits(local_rows=local_rows)
    fit = clusters.fit(points, DIM, lim)
    dirs = fit.dirs
    assert fit.settled and fit.rounds >= 2
    got = clusters.assign(points, dirs, DIM, ["id"], lim)
    found = {}
    for r in got.collect():
        found.setdefault(r.cluster, set()).add(r.id)
    want = {frozenset(np.nonzero(label == k)[0].tolist()) for k in range(5)}
    assert {frozenset(s) for s in found.values()} == want
    top = {r.first_id: r for r in clusters.typical(got, "id", 3).collect()}
    assert {r.size for r in top.values()} == {300, 150, 60, 20, 7}
    assert all(0 < r.mean_dist < r.max_dist <= 0.4 for r in top.values())
    m = x[label == 0].sum(axis=0)
    assert top[0].typical == np.nonzero(label == 0)[0][np.argsort(-(x[label == 0] @ m))[:3]].tolist()


def test_where_and_when_nodes_are_split_changes_nothing(spark):
    x, _ = planted(6, sizes=(400, 220, 120, 60, 30, 12, 8, 6), noise=300)
    points = frame(spark, x).persist()
    rows = []
    for local_rows, budget in ((10_000, 512), (60, 512), (60, 2)):
        lim = clusters.Limits(local_rows=local_rows, budget=budget)
        got = clusters.assign(points, clusters.fit(points, DIM, lim).dirs, DIM, ["id"], lim)
        rows.append(sorted((r.first_id, r["size"], round(r.mean_dist, 6), round(r.max_dist, 6), r.typical) for r in clusters.typical(got, "id", 4).collect()))
    assert rows[0] == rows[1] == rows[2] and [r[1] for r in rows[0]] == [400, 220, 120, 60, 30, 12, 8, 6]


def test_grouped_directions_are_exact():
    rng = np.random.default_rng(4)
    dirs = unit(rng.normal(size=(700, 6)))
    x = unit(rng.normal(size=(3000, 6)))
    lim = clusters.Limits()
    a, b = clusters.Directions(dirs, lim, flat=10_000).near(x), clusters.Directions(dirs, lim, flat=10).near(x)
    assert (a[0] == b[0]).all() and (a[0] >= 0).sum() > 500 and np.allclose(a[1][a[0] >= 0], b[1][a[0] >= 0])


def test_clusters_count_cells_placed_by_umap(spark, tmp_path):
    x, label = planted()
    at = {k: [10.0 * k, 0.0] for k in range(5)}
    rows = [(i + 10, [float(v) for v in r], at.get(int(k), [500.0 + i, 500.0]), 1) for i, (r, k) in enumerate(zip(x, label))]
    rows += [(3, None, [0.5, 0.0], 1), (9000, [0.0] * DIM, [0.0, 1.0], 1), (9001, None, [300.0, 300.0], 1)]
    spark.createDataFrame(rows, "obs_id bigint, spectral array<float>, umap array<float>, loaded_at int").write.parquet(str(tmp_path / "obsm.parquet"))
    from sparmat.llm import queries_algorithms as Q

    got = {r.first_obs_id: r for r in Q.p4_clusters(spark, str(tmp_path)).collect()}
    assert got[3].cells == 302 and sorted(r.cells for r in got.values()) == [7, 20, 60, 150, 302]
    assert not {3, 9000, 9001} & {i for r in got.values() for i in r.typical_obs_ids}
    found = [r.first_obs_id for r in Q.p4_found(spark, str(tmp_path)).collect()]
    assert {f: found.count(f) for f in found} == {f: r.cells for f, r in got.items()}


def test_copies_only_and_empty(spark):
    x = np.tile(unit(np.ones((1, DIM))), (40, 1))
    assert len(clusters.fit(frame(spark, x), DIM, clusters.Limits(local_rows=10)).dirs) == 1
    empty = frame(spark, x).limit(0)
    dirs = clusters.fit(empty, DIM).dirs
    assert len(dirs) == 0 and clusters.assign(empty, dirs, DIM, ["id"]).collect() == []


def brute(x, k):
    cos = x @ x.T
    np.fill_diagonal(cos, -9)
    return cos, np.argsort(-cos, axis=1, kind="stable")[:, :k]


def test_pairs_within_a_radius_are_complete(spark):
    x, _ = planted(1)
    rng = np.random.default_rng(2)
    near = unit(x[::5] + rng.normal(scale=0.001, size=x[::5].shape))
    copies = np.repeat(x[:1], 9, axis=0)  # a group of copies larger than k
    x = np.concatenate([x, near, copies]).astype(np.float32).astype(float)
    got = {(r.id, r.other) for r in neighbours.nearest_rows(frame(spark, x), DIM, 5, least_cos=0.9995).collect()}
    cos = x @ x.T
    n = len(x)
    for i in range(n):
        order = sorted((j for j in range(n) if j != i and cos[i, j] >= 0.9995), key=lambda j: (-round(cos[i, j], 6), j))[:5]
        mine = [j for a, j in got if a == i]
        assert len(mine) == len(order)
        assert np.allclose(sorted(cos[i, mine]), sorted(cos[i, order]), atol=1e-6)


def test_recall_of_the_search(spark):
    x, _ = planted(3, sizes=(900, 500, 200))
    _, best = brute(x, 5)
    got = neighbours.nearest_rows(frame(spark, x), DIM, 5, pick=F.col("id") % 5 == 0).collect()
    assert {r.id for r in got} == set(range(0, len(x), 5))
    hit = sum(r.other in best[r.id] for r in got)
    assert hit / len(got) >= 0.9 and len(got) == 5 * len({r.id for r in got})


def test_crowded_leaves_are_divided(spark, monkeypatch):
    x, _ = planted(5, sizes=(700, 400, 200), noise=300)
    rng = np.random.default_rng(7)
    x = np.concatenate([x, unit(x[::4] + rng.normal(scale=0.001, size=x[::4].shape))]).astype(np.float32).astype(float)
    points = frame(spark, x).persist()
    plain = {(r.id, r.other): round(r.cos, 6) for r in neighbours.nearest_rows(points, DIM, 5, least_cos=0.9995).collect()}
    fit, whole = neighbours.fit_tree, neighbours.index
    monkeypatch.setattr(neighbours, "fit_tree", lambda p, dim: fit(p, dim, leaf_rows=600))
    monkeypatch.setattr(neighbours, "index", lambda p, t, dim: whole(p, t, dim, leaf_rows=40, crowd_rows=80, sub_sample=200))
    assert plain == {(r.id, r.other): round(r.cos, 6) for r in neighbours.nearest_rows(points, DIM, 5, least_cos=0.9995).collect()}
    _, best = brute(x, 5)
    got = neighbours.nearest_rows(points, DIM, 5, pick=F.col("id") % 5 == 0).collect()
    assert len(got) == 5 * -(-len(x) // 5) and sum(r.other in best[r.id] for r in got) / len(got) >= 0.9
    v = neighbours.recall_of(points, DIM, 5, pick=F.col("id") % 5 == 0)
    assert v.recall >= 0.95 and v.held_out >= 0.85 and v.sub_leaves >= 1


def test_neighbours_of_nothing(spark):
    one = frame(spark, unit(np.ones((1, DIM))))
    assert neighbours.nearest_rows(one.limit(0), DIM, 5, least_cos=0.9).collect() == []
    assert neighbours.nearest_rows(one, DIM, 5).collect() == []
