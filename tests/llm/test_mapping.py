"""Typed values against a plain comparison with every entry."""

from __future__ import annotations

import random

from sparmat.llm.mapping import Dictionary, GeneMatcher, clean, deletions, distance, map_to_genes, nearest_by_join

GENES = [
    ("u1", "XGRG00000000011", "Livyhulad", None, 5),
    ("u2", "XGRG00000000222", "Kroripejart7", "Dopobogex|Bigitekek", 9),
    ("u3", "XGRG00000003333", "Kroripejart1", None, 1),
    ("u4", "XGRG55555555555", "Sodutejyd7", None, 0),
]


def test_distance_is_damerau_levenshtein():
    def plain(a, b):
        d = [[max(i, j) if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
        return d[-1][-1]

    rnd = random.Random(1)
    for _ in range(3000):
        a, b = ("".join(rnd.choice("abc") for _ in range(rnd.randrange(7))) for _ in "xy")
        got = distance(a, b, 2)
        assert (got[0] if got else None) == (plain(a, b) if plain(a, b) <= 2 else None)


def test_dictionary_finds_all_within_the_limit():
    rnd = random.Random(2)
    words = sorted({"".join(rnd.choice("abcd") for _ in range(rnd.randrange(4, 9))) for _ in range(120)})
    d = Dictionary.build([(w, w, 0) for w in words], 2)
    for _ in range(300):
        s = "".join(rnd.choice("abcd") for _ in range(rnd.randrange(3, 10)))
        best = min(((distance(s, w, 2)[1], 0, w) for w in words if distance(s, w, 2)), default=None)
        assert d.nearest(s) == ((0.0, 0, s) if s in words else best)


def test_writing_styles():
    m = GeneMatcher(GENES)
    same = {
        ("LIVYHULAD", None): "u1",
        ("Livyhulаd", "na"): "u1",  # a letter of another script
        ("Ｌｉｖｙｈｕｌａｄ", ""): "u1",
        ("Livy​hulad", "-"): "u1",
        ("gene Livyhulad", "."): "u1",
        ("xm2_Kroripejart7", "xm2_XGRG00000000222"): "u2",
        ("Kroripejart 1", None): "u3",
        ("Kroripejart_1", None): "u3",
        ("Krori-pejart7", None): "u2",
        ("Kroripejart7;XGRG00000000222", None): "u2",
        ("XGRG00000003333", "Kroripejart1"): "u3",
        (None, "XGRG00000003333.12"): "u3",
        (None, "xgrg-00000003333"): "u3",
        (None, "XGRG00000003338"): "u3",  # one digit
        (None, "XGRG55555555551"): "u4",
        (None, "XGRG00000030333"): "u3",  # two neighbours exchanged
        ("Kroripejart7", "XGRG00000003333"): "u3",  # the id decides
        ("Kroripejart7", "XGRG99999999999"): "u2",  # an unknown id does not
        ("bigitekek", None): "u2",
        ("Bigtiekke", None): "u2",
        ("Kroripejart2", None): "none",
        ("Kroripejart", None): "none",
        ("Livyhu", None): "none",
        ("novel transcript", "na"): "none",
        ("14", None): "none",
        (None, None): "none",
        ("", ""): "none",
        ("x" * 5000, None): "none",
    }
    assert {k: m.match(*k) for k in same} == same
    assert clean("\t ÉÀ ") == "ea" and deletions("ab", 2) == {"ab", "a", "b", ""}


def test_rows(spark):
    genes = spark.createDataFrame([(*g[:4], "x") for g in GENES], "uid string, id string, gene string, alias string, chrom string")
    rows = [(1, "Livyhulad", "XGRG00000000011", 0), (2, "livyhulad", "XGRG00000000011", 0), (3, None, None, 0), (4, "Sodutejyd7", None, 0), (4, "Sodutejyd7", None, 0)]
    df = spark.createDataFrame(rows, "r bigint, gene_name string, gene_id string, uid int")
    got = sorted((r.r, r.uid) for r in map_to_genes(df, genes, ["r"]).collect())
    assert got == [(2, "u1"), (3, "none"), (4, "u4"), (4, "u4")]
    assert sorted(map(str, map_to_genes(df, genes, ["r"]).collect())) == sorted(map(str, map_to_genes(df, genes, ["r"], most_entries=1).collect()))
    assert map_to_genes(df.limit(0), genes, ["r"]).collect() == []
    assert {r.uid for r in map_to_genes(df, genes.limit(0), ["r"]).collect()} == {"none"}


def test_join_for_long_lists(spark):
    rnd = random.Random(4)
    words = sorted({"".join(rnd.choice("abcde") for _ in range(7)) for _ in range(80)})
    typed = [w[:3] + rnd.choice("abcde") + w[4:] for w in words[:30]] + ["zzzzzzz", None, words[0].upper()]
    d = Dictionary.build([(w, w, 0) for w in words], 2)
    got = nearest_by_join(spark.createDataFrame([(t,) for t in typed], "t string"), "t", spark.createDataFrame([(w, w) for w in words], "s string, e string"), "s", "e")
    for r in got.collect():
        want = d.nearest(clean(r.value))
        assert (r.entry is None) == (want is None)
        if want:
            assert (r.weighted, r.entry) == (want[0], want[2])


def test_names_cut_into_many_parts():
    m = GeneMatcher(GENES)
    for typed, uid in (("L-i-v-y-h-u-l-a-d", "u1"), ("k r o r i p e j a r t 7", "u2"), ("Kro-rip-ej-art_1", "u3"), ("see S.o.d.u.t.e.j.y.d 7 (old)", "u4"), ("K-r-o-r-i-p-e-j-a-r-t-5", "none"), ("1 2 " * 500, "none")):
        assert m.match(typed, None) == uid, typed


def test_broadcast_and_join_give_the_same_rows(spark, sf):
    rows, genes = spark.read.parquet(f"{sf}/transcript.parquet"), spark.read.parquet(f"{sf}/genes.parquet")
    extra = [(900001, "k r o w", "XGRG 1"), (900002, "a" * 3000, None), (900003, None, "")]
    rows = rows.select("tx_row_id", "gene_name", "gene_id").unionByName(spark.createDataFrame(extra, "tx_row_id bigint, gene_name string, gene_id string"))
    one, two = (map_to_genes(rows, genes, ["tx_row_id"], most_entries=n) for n in (20_000, 100))
    assert one.columns == two.columns and sorted(map(str, one.collect())) == sorted(map(str, two.collect()))
