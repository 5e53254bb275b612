"""Value-frequency compression against plain per-key computation."""

from __future__ import annotations

import math
import random
from collections import Counter

from pyspark.sql import functions as F

from sparmat.functions.text import barcode_code, barcode_text, chrom_label
from sparmat.operators.skew import compress_values, heavy_keys, interpolated_percentiles, key_percentiles, key_totals


def data(spark):
    rnd = random.Random(3)
    rows = [("hot", rnd.randrange(40), 1) for _ in range(900)] + [("hot", None, 1)] * 5
    rows += [(rnd.choice(["a", "b", None]), rnd.choice([1, 2, 3, None]), 1) for _ in range(60)]
    rows += [("nulls", None, 1)] * 3
    return rows, spark.createDataFrame(rows, "k string, v bigint, freq int")


def test_totals_and_percentiles(spark):
    rows, df = data(spark)
    w = compress_values(df.drop("freq"), ["k"], "v")
    got = {r.k: r for r in key_totals(w, ["k"], "v").collect()}
    pct = {(r.k, r.fraction): r.percentile for r in key_percentiles(w, ["k"], "v", [0.1, 0.5, 1.0]).collect()}
    for k in {r[0] for r in rows}:
        vals = [r[1] for r in rows if r[0] == k]
        real = sorted(v for v in vals if v is not None)
        assert got[k].n_rows == len(vals)
        assert got[k].n_distinct == len(set(real))
        if real:
            assert got[k].total == sum(real)
            c = Counter(real)
            assert got[k].mode == min(v for v in c if c[v] == max(c.values()))
            for q in (0.1, 0.5, 1.0):
                assert pct[k, q] == real[max(1, math.ceil(round(q * len(real), 9))) - 1]
        else:
            assert got[k].total is None and got[k].mode is None and (k, 0.5) not in pct
    assert key_percentiles(w.limit(0), ["k"], "v", [0.5]).collect() == []


def test_heavy_keys(spark):
    _, df = data(spark)
    t = key_totals(compress_values(df, ["k"], "v"), ["k"], "v")
    assert {r.k for r in heavy_keys(t, ["n_rows", "total"], 0.5).collect()} == {"hot"}
    assert heavy_keys(t.limit(0), ["n_rows"], 0.5).collect() == []


def test_spellings(spark):
    names = ["chr7", "CHR07", " chr_7\t", "7", "xm2_chr7", "chr 7", "chrUn", "*", "", None, "chrx", "chr10"]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "c string").select(chrom_label(F.col("c"))).collect()]
    assert got == ["7"] * 6 + [None] * 4 + ["X", "10"]


def test_barcodes(spark):

    b = "ACGTACGTACGTACGT"
    vals = [b, b.lower() + "-1", f"s:{b}", f" {b}", b + "A", "NNNN", "", None, "T" * 16]
    df = spark.createDataFrame([(v,) for v in vals], "c string").select(barcode_text(barcode_code(F.col("c"))).alias("b"))
    assert [r.b for r in df.collect()] == [b] * 4 + [None] * 4 + ["T" * 16]


def test_interpolated_percentiles_of_hot_keys(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    rows = [(k, float(v)) for k, n in (("hot", 900), ("a", 7), (None, 4), ("one", 1)) for v in rng.integers(0, 40, n)] + [("none", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(6)
    got = {r.k: r.q for r in interpolated_percentiles(df, ["k"], "v", [0.0, 0.25, 0.333, 0.5, 1.0]).collect()}
    assert set(got) == {"hot", "a", None, "one"}
    for k, q in got.items():
        assert np.allclose(q, np.quantile([v for x, v in rows if x == k], [0.0, 0.25, 0.333, 0.5, 1.0]))
    assert interpolated_percentiles(df.limit(0), ["k"], "v", [0.5]).collect() == []
