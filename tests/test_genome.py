"""Literal cases and brute force for the genome operators."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from sparmat.operators import genome as G


def test_index(spark):
    sizes = spark.createDataFrame([("1", 13), ("2", 71), ("3", 100)], "chrom string, len bigint")
    for step, want in {1: {0: ("1", 0, 1), 12: ("1", 12, 13), 13: ("2", 0, 1), 100: ("3", 16, 17)}, 2: {0: ("1", 0, 2), 6: ("1", 12, 13), 7: ("2", 0, 2), 11: ("2", 8, 10)}, 3: {2: ("1", 6, 9), 4: ("1", 12, 13), 5: ("2", 0, 3), 29: ("3", 0, 3), 62: ("3", 99, 100)}}.items():
        ix = G.genome_index(sizes, step)
        got = G.from_index(spark.createDataFrame([(k,) for k in [*want, 10_000]], "bin bigint"), ix, "bin", step).collect()
        assert {r.bin: (r.chrom, r.start, r.end) for r in got} == want
    pos = spark.createDataFrame([("1" if i < 13 else "2", i if i < 13 else i - 13, i) for i in range(16)] + [("1", 13, 99)], "chrom string, pos bigint, i int")
    got = {r.i: r.bin for r in G.to_index(pos, G.genome_index(sizes, 2), "chrom", "pos", 2).collect()}
    assert [got[i] for i in range(16)] == [0, 0, 1, 1, 2, 2, 3, 3, 4, 4, 5, 5, 6, 7, 7, 8] and 99 not in got


FRAGS = [(0, 10), (3, 13), (5, 41), (8, 18), (15, 25), (22, 24), (23, 33), (29, 40)]


def test_coverage(spark):
    f = spark.createDataFrame([("chr1", a, b) for a, b in FRAGS], "chrom string, start bigint, end bigint")
    sizes = spark.createDataFrame([("chr1", 50)], "chrom string, len bigint")
    want = {
        3: [(0, 3, 1), (3, 6, 3), (6, 12, 4), (12, 18, 3), (18, 21, 2), (21, 24, 4), (24, 33, 3), (33, 42, 2)],
        5: [(0, 5, 2), (5, 10, 4), (10, 20, 3), (20, 25, 4), (25, 35, 3), (35, 40, 2), (40, 45, 1)],
    }
    for width, segs in want.items():
        assert sorted((r.start, r.end, r.value) for r in G.coverage(f, "chrom", width, sizes).collect()) == segs
    track = G.coverage(f, "chrom", 3, sizes)
    total = sum((b - a) * v for a, b, v in want[3])
    assert {round(r.value * total / 1e6, 6) for r in G.scale_track(track, [], "bpm").collect()} == {1.0, 2.0, 3.0, 4.0}


def test_smoothing_is_a_moving_average(spark):
    for half, segs in ((2, [(0, 5, 1.0), (5, 8, 2.0)]), (200, [(0, 100, 1.0), (200, 300, 2.0), (500, 600, 3.0), (1000, 1100, 5.0), (1400, 1800, 10.0), (5444, 5844, 100.0)])):
        dense = {p: v for a, b, v in segs for p in range(a, b)}
        t = spark.createDataFrame([("c", *s) for s in segs], "chrom string, start bigint, end bigint, value double")
        got = {p: r.value + r.slope * (p - r.pos) for r in G.smooth(t, "chrom", half).collect() for p in range(r.pos, r.until)}
        for p in range(-half - 3, 6400, 7 if half > 2 else 1):
            want = sum(dense.get(q, 0) for q in range(p - half, p + half + 1)) / (2 * half + 1)
            assert abs(got.get(p, 0.0) - want) < 1e-6


def test_merge_peaks(spark):
    rows = [("chr1", 9977, 189, 290.442), ("chr1", 9977, 425, 295.33), ("chr1", 9977, 425, 295.0), ("chr1", 9977, 625, 295.0), ("chr1", 9977, 925, 290.0)]
    rows += [("chr2", 9977, 625, 295.0), ("chr2", 9977, 325, 290.0), ("chr2", 9977, 525, 290.0), ("chr2", 9977, 725, 290.0), ("chr3", 0, 100, 290.0)]
    got = G.merge_peaks(spark.createDataFrame(rows, "chrom string, start bigint, peak bigint, p_value double"), 200)
    assert {tuple(r) for r in got.collect()} == {("chr1", 10202, 10603, 295.33, 200), ("chr1", 10702, 11103, 290.0, 200), ("chr2", 10402, 10803, 295.0, 200), ("chr3", 0, 301, 290.0, 100)}


def test_overlap_join(spark):
    rnd = random.Random(0)
    make = lambda n, m: [(i, rnd.choice("xy"), s := rnd.randrange(3000), s + rnd.choice([0, 1, 30, 900])) for i in range(n)] + [(n, None, 1, 5), (n + 1, "x", None, 5)]
    a, b = make(200, 1), make(150, 2)
    got = G.overlap_join(
        spark.createDataFrame(a, "i int, c string, s bigint, e bigint"), spark.createDataFrame(b, "j int, d string, t bigint, u bigint"), "c", "s", "e", "d", "t", "u", width=256
    )
    pairs = [(r.i, r.j) for r in got.collect()]
    want = {(i, j) for i, c, s, e in a for j, d, t, u in b if c and c == d and None not in (s, e, t, u) and s < e and t < u and s < u and t < e}
    assert len(pairs) == len(set(pairs)) and set(pairs) == want


def test_strands_and_ratio(spark):
    f = spark.createDataFrame([(1, "c", 10, 20, "+"), (2, "c", 10, 20, "-"), (3, "c", 10, 20, None)], "frag_id int, chrom string, start bigint, end bigint, strand string")
    assert sorted((r.frag_id, r.pos) for r in G.insertions(f).collect()) == [(1, 10), (2, 19), (3, 10), (3, 19)]
    got = {r.frag_id: (r.start, r.end) for r in G.shift(f, 4, -5).collect()}
    assert got == {1: (14, 24), 2: (14, 24), 3: (14, 15)}
    v = spark.createDataFrame([(3, 4), (3, 0), (0, 0), (0, 4)], "a int, b int").select(G.ratio(F.col("a"), F.col("b")).alias("r"))
    assert [r.r for r in v.collect()] == [0.75, 1.0, 0.0, 0.0]


def test_gc_of_nothing(spark):
    df = spark.createDataFrame([("",), ("NNN",), ("GCNA",), (None,)], "s string").select(G.gc_content(F.col("s")).alias("g"))
    assert [r.g for r in df.collect()][:2] == [0.5, 0.5] and abs(df.collect()[2].g - 2 / 3) < 1e-12


def test_sets_overlapped(spark):
    rows = [("a1", "a", "c", 0, 10), ("a2", "a", "c", 5, 30), ("b1", "b", "c", 9, 12), ("b2", "b", "c", 50, 60), ("d1", "d", "c", 29, 51), ("d2", "d", "e", 0, 10)]
    got = G.sets_overlapped(spark.createDataFrame(rows, "pid string, call_set string, chr string, start int, end int"), "pid", "call_set")
    assert {r.pid: (r.sets, r.every) for r in got.collect()} == {"a1": (1, False), "a2": (2, True), "b1": (1, False), "b2": (1, False), "d1": (2, True), "d2": (0, False)}
