"""Running totals, streaming and the smaller operators."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from sparmat.operators import aggregate as A
from sparmat.operators import extras as X
from sparmat.operators import relational as V
from sparmat.session import running_totals, scratch_table, shared_dir
from sparmat.streaming import counts as C


def test_running_totals(spark):
    rows = [(i, i * 7 % 1000, 1) for i in range(1000)]
    df = spark.createDataFrame(rows, "id int, v int, one int").repartition(7)
    got = {r.id: r for r in running_totals(df, ["v", "id"], ["one", "v"]).collect()}
    total = 0
    for n, (i, v, _) in enumerate(sorted(rows, key=lambda r: (r[1], r[0])), 1):
        total += v
        assert (got[i].run_one, got[i].run_v) == (n, total)
    down = {r.id: r.run_one for r in running_totals(df, [F.col("v").desc(), "id"], ["one"]).collect()}
    assert down[max(rows, key=lambda r: r[1])[0]] == 1
    assert running_totals(df.limit(0), ["v"], ["one"]).collect() == []


def test_auroc_against_pairs(spark):
    rnd = random.Random(1)
    rows = [(rnd.randrange(12) / 4, rnd.random() < 0.4) for _ in range(150)]
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    want = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))
    r = A.auroc(spark.createDataFrame([*rows, (None, True)], "s double, y boolean"), "s", "y").collect()[0]
    assert abs(r.auroc - want) < 1e-12


def test_shared_folder(spark):
    d = shared_dir(spark)
    assert spark.sparkContext.getCheckpointDir() and shared_dir(spark) == d
    assert scratch_table(spark.range(5), "t").count() == 5


def test_links(spark):
    a = spark.createDataFrame([("k", 1), ("k", 2), ("j", 3), (None, 4)], "k string, a int")
    b = spark.createDataFrame([("k", 9), ("j", 8), (None, 7)], "k string, b int")
    got = sorted((r.k, r.a, r.b, r.unified) for r in V.link_keys(a, b, "k", "a", "b", "u").collect())
    assert got == [("j", 3, 8, "u1"), ("k", 1, 9, "u2"), ("k", 2, 9, "u3")]


def test_streams(spark, tmp_path):
    rows = [("2024-01-01 00:00:00", "a", 1.0), ("2024-01-01 00:10:00", "a", 2.0), ("2024-01-01 03:00:00", "a", 4.0)]
    df = spark.createDataFrame(rows, "t string, k string, v double").select(F.to_timestamp("t").alias("t"), "k", "v")
    for i in range(3):
        df.limit(i + 1).subtract(df.limit(i)).write.mode("append").parquet(str(tmp_path / "in"))
    s = lambda: spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {(r.start.hour, r.n, r.total) for r in C.run_to_end(C.window_counts(s(), "t", "k", "v", "1 hour", "10 days"), "complete").collect()}
    assert got == {(0, 2, 3.0), (3, 1, 4.0)}
    assert sorted(r.n for r in C.run_to_end(C.session_counts(s(), "t", "k", "30 minutes", "10 days"), "complete").collect()) == [1, 2]
    assert C.run_to_end(C.first_versions(s(), "k", "t", "10 days"), "append").count() == 1


def test_late_rows_behind_the_watermark(spark, tmp_path):
    for t, v in (("00:00:00", 1.0), ("00:20:00", 2.0), ("05:00:00", 4.0), ("05:10:00", 0.5), ("00:30:00", 8.0), ("04:30:00", 16.0)):
        spark.createDataFrame([(f"2024-01-01 {t}", "a", v)], "t string, k string, v double").select(F.to_timestamp("t").alias("t"), "k", "v").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("t timestamp, k string, v double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = C.run_to_end(C.window_counts(s, "t", "k", "v", "1 hour", "1 hour"), "update", ["start", "k"])
    # two batches change the first window; the row of 00:30 comes when its window is closed, the one of 04:30 in time
    assert {(r.start.hour, r.n, r.total) for r in got.collect()} == {(0, 2, 3.0), (5, 2, 4.5), (4, 1, 16.0)}


def test_quantile_bins_and_masks(spark):
    df = spark.createDataFrame([("g", x) for x in (0.0, 0.1, 0.5, 0.9, 1.0)] + [("h", 3.0)], "g string, v double")
    assert [r.bin for r in X.quantile_bins(df.where("g = 'g'"), "v", [0.0, 0.2, 0.6, 1.0]).orderBy("v").collect()] == [0, 0, 1, 2, 2]
    m = {(r.g, r.v): r for r in X.top_mask(df, "g", "v", 0.25).collect()}
    assert m["h", 3.0].scaled == 0.0 and m["h", 3.0].top and m["g", 1.0].top and not m["g", 0.5].top


def test_constant_variables_over_all_entries(spark):
    from sparmat.model import Matrix
    from sparmat.plans import q_extras as Q

    e = spark.createDataFrame([(1, 3, 1.0), (2, 3, 2.0), (1, 4, 5.0), (2, 4, 5.0), (1, 6, 5.0), (1, 7, 0.0)], "obs_id int, var_id int, value double")
    m = Matrix(e, spark.createDataFrame([(1,), (2,)], "obs_id int"), spark.createDataFrame([(v,) for v in (3, 4, 6, 7, 9)], "var_id int"))
    orders, Q.orders_matrix = Q.orders_matrix, lambda s, d: m
    try:
        assert sorted(r.var_id for r in Q.constant_variables(spark, "").collect()) == [4, 7, 9]
    finally:
        Q.orders_matrix = orders
