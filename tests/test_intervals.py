"""Periods and gaps against a brute-force version."""

from __future__ import annotations

import random

import pytest

from sparmat.operators.intervals import merge_intervals, period_summary

SCHEMA = "k string, g int, start bigint, end bigint, kind string, left_pos string"


def brute(rows):
    out = set()
    by = {}
    for k, g, s, e, *_ in rows:
        if s is not None and e is not None and s < e:
            by.setdefault((k, g), []).append((s, e))
    for key, iv in by.items():
        merged = []
        for s, e in sorted(iv):
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        out |= {(*key, "period", a, b) for a, b in merged}
        out |= {(*key, "gap", x[1], y[0]) for x, y in zip(merged, merged[1:])}
    return out


@pytest.mark.parametrize("width", [1, 7, 64, 1 << 20])
def test_random_intervals(spark, width):
    rnd = random.Random(width)
    rows = []
    for _ in range(400):
        s = rnd.randrange(-300, 3000)
        e = s + rnd.choice([0, 1, 3, 20, 400, -5])
        rows.append((rnd.choice(["a", "b", None]), rnd.choice([1, None]), s, e, "x", "y"))
    rows += [("a", 1, None, 5, None, None), ("a", 1, 5, None, None, None), *rows[:50], ("solo", 9, 0, 5000, "x", "y")]
    got = merge_intervals(spark.createDataFrame(rows, SCHEMA), ["k", "g"], bucket_width=width)
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(set(found))
    assert set(found) == brute(rows)


def test_touching_and_empty(spark):
    df = spark.createDataFrame([("a", 1, 0, 5, "", ""), ("a", 1, 5, 9, "", ""), ("a", 1, 10, 11, "", "")], SCHEMA)
    got = {tuple(r) for r in merge_intervals(df, ["k", "g"], bucket_width=5).collect()}
    assert got == {("a", 1, "period", 0, 9), ("a", 1, "period", 10, 11), ("a", 1, "gap", 9, 10)}
    assert merge_intervals(df.limit(0), ["k", "g"]).collect() == []
    row = period_summary(merge_intervals(df, ["k", "g"]), ["k", "g"]).collect()[0]
    assert (row.n_periods, row.covered, row.gap_total, row.longest_gap) == (2, 10, 1, 1)
