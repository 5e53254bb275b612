"""Relative-rank sketches against exact percentiles."""

from __future__ import annotations

import math

import numpy as np
import pytest

from sparmat.llm.quantiles import RankSketch, exact_percentiles, merge_sketches, sketch, sketch_percentiles


def exact(v, q):
    return np.sort(v)[max(1, math.ceil(round(q * len(v), 9))) - 1]


@pytest.mark.parametrize("high", [True, False])
def test_relative_error_and_merge(high):
    rng = np.random.default_rng(5)
    v = rng.lognormal(8, 2, 200_000)
    parts = np.array_split(v, 37)
    whole = RankSketch(high)
    for p in parts:
        s = RankSketch(high)
        s.update(p)
        assert s.n == len(p)
        whole.merge(s)
    assert whole.n == len(v) and sum(len(x) << h for h, x in enumerate(whole.levels)) == len(v)
    assert sum(map(len, whole.levels)) < 12_000
    order = np.sort(v)
    for q in (0.0005, 0.01, 0.1, 0.5, 0.9, 0.99, 0.9995):
        if (q > 0.5) == high:
            rank = np.searchsorted(order, whole.percentile(q)) + 1
            tail = (1 - q if high else q) * len(v)
            assert abs(rank - q * len(v)) <= 0.05 * tail + 1


def test_few_values_are_exact():
    s = RankSketch(True)
    s.update(np.array([5.0, 1.0, 3.0]))
    assert [s.percentile(q) for q in (0.1, 0.5, 1.0)] == [1.0, 3.0, 5.0]


def rows(rng, n):
    keys = rng.choice(["hot", "a", "b", "c"], n, p=[0.7, 0.2, 0.09, 0.01])
    return [(None if i % 97 == 0 else str(k), int(i % 5), None if i % 31 == 0 else float(round(x)), "x") for i, (k, x) in enumerate(zip(keys, rng.lognormal(6, 1, n)))]


def test_groups_over_days(spark):
    data = rows(np.random.default_rng(1), 6000)
    df = spark.createDataFrame(data, "sample string, day int, v double, high string").repartition(5)
    days = sketch(df, ["sample", "day"], "v")
    merged = merge_sketches(days, ["sample"])
    br = sketch_percentiles(merged, ["sample"], [0.1, 0.5, 0.9, 0.99])
    approx = {(r["sample"], r.fraction): r for r in br.collect()}
    got = {(r["sample"], r.fraction): r for r in exact_percentiles(df, ["sample"], "v", br).collect()}
    for k in {r[0] for r in data}:
        v = np.array([r[2] for r in data if r[0] == k and r[2] is not None])
        for q in (0.1, 0.5, 0.9, 0.99):
            assert got[k, q].percentile == exact(v, q) and got[k, q].n == len(v)
            rank = np.searchsorted(np.sort(v), approx[k, q].percentile, side="right")
            low = np.searchsorted(np.sort(v), approx[k, q].percentile) + 1
            assert low - 0.1 * len(v) <= q * len(v) <= rank + 0.1 * len(v)


def test_bracket_of_other_rows_is_an_error(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(100)], "k string, v double")
    good = spark.createDataFrame([("a", 0.5, 40.0, 60.0)], "k string, fraction double, low double, high_value double")
    assert exact_percentiles(df, ["k"], "v", good).collect()[0].percentile == 49.0
    with pytest.raises(Exception, match="bracket without its percentile"):
        exact_percentiles(df, ["k"], "v", good.selectExpr("k", "fraction", "90D AS low", "95D AS high_value")).collect()


@pytest.mark.parametrize("high", [True, False])
def test_brackets_hold_the_percentile_and_leave_most_rows_out(high):
    rng = np.random.default_rng(2)
    for v in (rng.lognormal(8, 2, 60_000), rng.integers(0, 50, 30_000).astype(float), np.sort(rng.normal(size=20_000)), np.ones(9000)):
        whole = RankSketch(high, 128)
        for p in np.array_split(v, 7):
            s = RankSketch(high, 128)
            s.update(p)
            whole.merge(s)
        order = np.sort(v)
        for q in (0.001, 0.1, 0.5, 0.9, 0.999):
            rank = max(1, math.ceil(round(q * len(v), 9)))
            lo, hi = whole.bracket(rank)
            assert lo <= order[rank - 1] <= hi
            if len(np.unique(v)) == len(v):
                assert ((v >= lo) & (v <= hi)).mean() < 0.15


def test_empty(spark):
    df = spark.createDataFrame([], "k string, v double")
    assert sketch(df, ["k"], "v").collect() == []
    nulls = spark.createDataFrame([("a", None), ("b", float("nan"))], "k string, v double")
    assert sketch(nulls, ["k"], "v").collect() == []
