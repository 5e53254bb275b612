"""Leaked passages, mixes and text quality on small fixtures."""

from __future__ import annotations

import random

import numpy as np
import pytest

from sparmat.llm import leakage, mixing, quality


def words(t):
    return [w for m in leakage.WORD.findall(t) for w in leakage.fold(m)]


def test_automaton_against_brute_force():
    rnd = random.Random(0)
    for case in range(60):
        items = [(i, " ".join(rnd.choice("abc") for _ in range(rnd.randrange(0, 14)))) for i in range(5)]
        text = " ".join(rnd.choice("abcd" if case % 2 else "abc") for _ in range(60))
        least = rnd.randrange(2, 5)
        found, spans, n = leakage.Automaton(items, least).scan(text)
        w, want, cover = text.split(), set(), set()
        for i, t in items:
            p = t.split()
            for k in range(len(p) - least + 1):
                for j in range(len(w) - least + 1):
                    if w[j : j + least] == p[k : k + least]:
                        want.add(i)
                        cover |= set(range(j, j + least))
        assert set(found) == want and n == 60
        assert {j for j in range(60) if any(s <= 2 * j < e for s, e in spans)} == cover


def test_words():
    assert words("L’ÉQUIPE,\xa0naï­ve ﬁn Straße zero​width x_y") == ["l", "equipe", "naive", "fin", "strasse", "zerowidth", "x", "y"]
    assert words("été") == ["ete"]


def test_find_leaks(spark):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen"
    docs = [
        (1, "Intro. ONE, two – three four five six seven eight nine tén eleven\ntwelve! Outro."),
        (2, "one two three four five six seven eight nine ten eleven"),
        (3, None),
        (4, ""),
        (5, "x " * 50_000 + item),
        (5, "x " * 50_000 + item),
    ]
    df = spark.createDataFrame([(*d, 7) for d in docs], "doc_id bigint, text string, leaks int")
    items = spark.createDataFrame([(9, item), (10, "too short"), (11, None), (12, item)], "item_id int, text string")
    whole = leakage.find_leaks(df, items, ["doc_id"]).collect()
    assert {(r.doc_id, i.item, i.words) for r in whole for i in r.leaks} == {(1, 9, 12), (1, 12, 12), (5, 9, 13), (5, 12, 13)} and len(whole) == 3
    assert sorted(map(str, whole)) == sorted(map(str, leakage.find_leaks(df, items, ["doc_id"], most_words=10).collect()))
    one = next(r for r in leakage.find_leaks(df, items, ["doc_id"]).collect() if r.doc_id == 1)
    assert (one.n_words, one.covered_words, one.kept_text) == (14, 12, "Intro. ! Outro.")
    assert leakage.find_leaks(df.limit(0), items, ["doc_id"]).collect() == []
    assert leakage.find_leaks(df, items.limit(0), ["doc_id"]).collect() == []


def test_longest_passage_of_every_item():
    rnd = random.Random(3)
    for _ in range(150):
        letters = "ab" if rnd.random() < 0.5 else "abcdef"
        items = [(i, " ".join(rnd.choice(letters) for _ in range(rnd.randrange(0, 22)))) for i in range(4)]
        t = [rnd.choice(letters + "z") for _ in range(40)]
        want = {}
        for i, x in items:
            p = x.split()
            n = max((k for k in range(len(p) + 1) for s in range(len(p) - k + 1) if any(t[j : j + k] == p[s : s + k] for j in range(len(t) - k + 1))), default=0)
            if n >= 3:
                want[i] = n
        assert leakage.Automaton(items, 3).scan(" ".join(t))[0] == want


def test_groups_of_items_change_nothing(spark):
    rnd = random.Random(8)
    w = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(rnd.choice(w[:9]) for _ in range(30))) for i in range(12)]
    docs = []
    for k in range(60):
        a, b = rnd.choice(items)[1].split(), rnd.choice(items)[1].split()
        docs.append((k % 50, f"{' '.join(a[:14])}, {rnd.choice(w)} {' '.join(b[9:28])} end {rnd.choice(w)}", k))
    docs.append(docs[0])
    df = spark.createDataFrame(docs, "doc_id int, text string, spans int")
    it = spark.createDataFrame(items, "item_id bigint, text string")
    one, more = (leakage.find_leaks(df, it, ["doc_id"], most_words=n).collect() for n in (10**6, 60))
    assert sorted(map(str, one)) == sorted(map(str, more)) and len(one) == 61


def test_flight_keeps_the_balance():
    rnd = random.Random(5)
    for case in range(200):
        n = rnd.randrange(1, 60)
        p = [rnd.choice([0.3, 0.5, rnd.random()]) for _ in range(n)]
        t = [rnd.choice([1, 7, rnd.randrange(1, 900)]) for _ in range(n)]
        q = mixing.flight(p, t, rnd)
        left = [x for x in q if 0 < x < 1]
        assert len(left) <= 2 and all(0 <= x <= 1 for x in q)
        assert abs(sum(p) - sum(q)) < 1e-5 and abs(sum(a * b for a, b in zip(p, t)) - sum(a * b for a, b in zip(q, t))) < 1e-2
        assert set(mixing.land(left, t[: len(left)], rnd)) <= {0.0, 1.0}


@pytest.mark.parametrize("block_rows", [40, 5000])
def test_mix(spark, block_rows):
    rnd = random.Random(1)
    rows = [(i, "Big Source" if i < 1500 else "small", rnd.randrange(1, 200)) for i in range(1600)] + [(9000, "other", 500), (9001, None, 5), (9002, "small", 0)]
    sized = spark.createDataFrame(rows, "doc_id bigint, source string, tokens bigint")
    sized = sized.withColumn("key", mixing.source_key(sized.source)).drop("source")
    targets = spark.createDataFrame([("big_source", 0.7, 1), ("small", 0.1, 2), ("gone", 0.2, 3)], "source string, target_share double, max_repeat int")
    planned = mixing.plan(sized, targets)
    p = {r.source: r for r in planned.collect()}
    assert [p[s].short for s in ("big_source", "small", "gone")] == [False, 2 * p["small"].available < p["small"].wanted, True]
    drawn = mixing.sample(sized, planned, block_rows=block_rows)
    got = drawn.collect()
    assert sorted(r.doc_id for r in got) == list(range(1600))
    assert all(0 <= r.repeats <= p[r.source].max_repeat for r in got)
    used = sum(r.repeats * r.tokens for r in got if r.source == "big_source")
    assert abs(used - p["big_source"].wanted) <= 400
    rep = {r.source: r for r in mixing.report(drawn, planned).collect()}
    assert {k: r.short for k, r in rep.items()} == {k: r.short for k, r in p.items()}
    assert rep["gone"].tokens_drawn == 0 and abs(sum(r.actual_share for r in rep.values()) - 1) < 1e-9
    assert mixing.sample(sized.limit(0), mixing.plan(sized.limit(0), targets)).collect() == []


def test_token_counts(spark):
    enc = mixing.encoder(mixing.TOKENIZER)
    long = "word " * 90_000
    df = spark.createDataFrame([(1, "A short text."), (2, None), (3, ""), (4, "<|endoftext|>"), (5, long)], "doc_id bigint, text string")
    got = {r.doc_id: r.tokens for r in mixing.count_tokens(df, ["doc_id"]).collect()}
    assert (got[1], got[2], got[3], got[4]) == (len(enc.encode_ordinary("A short text.")), 0, 0, len(enc.encode_ordinary("<|endoftext|>")))
    assert got[5] == len(enc.encode_ordinary(long))


def test_pieces_of_a_text_have_its_tokens():
    enc = mixing.encoder(mixing.TOKENIZER)
    rnd = random.Random(3)
    parts = ["a", "b", "'s", "'ll", " ", "  ", "\n", "\t", "\xa0", "é", "1", "23", "!!", "—", "word", "_", "\r\n", "字"]
    for _ in range(500):
        t = "".join(rnd.choice(parts) * rnd.choice([1, 1, 2, 30]) for _ in range(rnd.randint(1, 60)))
        assert {mixing.token_count(enc, t, n) for n in (4, 9, 20, 10**6)} == {len(enc.encode_ordinary(t))}
    assert mixing.token_count(enc, " " * 2_000_000 + "a") == 2_000_000


PROSE = "The house is old and the people in it know that there is more to the story than this. They have seen it all."


def test_structure(spark):
    clean = spark.createDataFrame([("en", PROSE), ("en", None)], "lang string, text string")
    common = spark.createDataFrame([("en", w) for w in "the is and in it that there more to than this they have all".split()] + [("en", None)], "lang string, word string")
    prof = quality.learn_profiles(clean, common)
    cases = {
        1: (PROSE.upper(), True),
        2: ("\n".join(f"- item {i}" for i in range(20)), False),
        3: ("a;b;c\n" + "\n".join(f"{i};{i * 7};word" for i in range(30)), False),
        4: ("9f 3e aa 01 de ff 00 1c " * 20, False),
        5: (PROSE + "\n- one\n- two", True),
        6: (PROSE[:60] + "\n" + "\n".join(f"| x{i} | {i} | word |" for i in range(40)), False),
        7: ("\n".join(PROSE[i : i + 30] for i in range(0, len(PROSE), 30)), True),
    }
    df = spark.createDataFrame([(k, t, 1) for k, (t, _) in cases.items()] + [(8, None, 1), (9, " \n\t", 1)], "doc_id bigint, text string, profile int")
    got = {r.doc_id: r for r in quality.structure(df, prof, ["doc_id"]).collect()}
    assert {k: got[k].prose_share >= 0.5 for k in cases} == {k: v for k, (_, v) in cases.items()}
    assert got[8].profile == got[9].profile == "blank"
    assert quality.structure(df.limit(0), prof, ["doc_id"]).collect() == []


def test_divergence():
    a, b = np.array([1.0, 0.0]), np.array([0.0, 1.0])
    assert quality.divergence(a, a) == 0 and abs(quality.divergence(a, b) - 1) < 1e-12


def test_profiles_are_learned_from_structure():
    common = {"en": set("the is and in it that there more to than this they have all of".split())}
    lists = ["\n".join(f"{chr(97 + i)}) word{i} thing" for i in range(6))] * 3
    tables = ["\n".join(f"{i};{i * 3};x{i}" for i in range(6))] * 3
    assert {quality.structural_label(t, common) for t in lists} == {"list"}
    assert {quality.structural_label(t, common) for t in tables} == {"table"}
    assert quality.structural_label(PROSE, common) == "prose_en" and quality.structural_label("3f 9a ff 00 1c 2d 77", common) == "junk"
    assert quality.structural_label("", common) is None and quality.structural_label("word word", common) is None
    p = quality.fit_profiles([PROSE] + lists + tables + ["", "3f 9a ff 00 1c 2d 77"], common)
    assert {r[0] for r in quality.profile_rows(p)} == {"prose_en", "list", "table", "junk"}
    assert [r[1] for r in p.read([lists[0], tables[0], PROSE, None, " \n"])] == ["list", "table", "prose_en", "blank", "blank"]
    assert p.read([PROSE + "\n" + "x;1;2\n" * 400])[0][0] < 0.25  # mixed
    assert p.read([(PROSE + " ") * 3000])[0][0] == 1.0  # one long line
    assert quality.fit_profiles([], {}).read(["some text"])[0][1] == "rest"


def test_profiles_are_those_of_all_texts(spark):
    rnd = random.Random(4)
    known = "the is and in it that there more to than this they have all of".split()
    prose = [" ".join(rnd.choice(known) if k % 3 < rnd.choice([1, 2]) else f"b{'o' * rnd.randrange(1, 9)}" for k in range(24)) + f" {i}." for i in range(6000)]
    lists = ["\n".join(f"- {'x' * (1 + i % 7)}{i} thing{j}" for i in range(6 + j)) for j in range(9)]
    lists += ["\n".join(f"{i}) {'word' * (1 + i % 3)} {i * i}" for i in range(400))]  # more than 4,000 characters
    tables = ["\n".join(f"{i};{i * 3};{'y' * (i % 5)}{i}" for i in range(n)) for n in range(5, 900, 50)]
    texts = prose + lists + tables + ["3f 9a ff 00 1c 2d 77", "=" * 5000, "\t" * 60, "short one", ""]
    common = spark.createDataFrame([("en", w) for w in known], "lang string, word string")
    rows = [(t,) for t in texts + prose[:50] * 4 + lists[-1:] * 30 + [None]]
    got = quality.learn_profiles(spark.createDataFrame(rows, "text string").repartition(3), common)
    rnd.shuffle(rows)
    assert quality.profile_rows(quality.learn_profiles(spark.createDataFrame(rows, "text string").repartition(7), common)) == quality.profile_rows(got)
    assert quality.profile_rows(quality.fit_profiles(texts, got.common)) == quality.profile_rows(got)
    f = np.array([got.features(w, ws) for t in prose for w, ws in quality.windows(t)], dtype=float)
    want = [(f[:, 1] / f[:, 0]).mean(), *(f[:, 2:] / f[:, 2:].sum(axis=1, keepdims=True)).mean(axis=0)]
    assert set(got.names) == {"prose_en", "list", "table", "junk"}
    assert np.allclose(quality.profile_rows(got)[got.names.index("prose_en")][1:], want, rtol=0, atol=1e-9)
    only = [r[0] for r in rows if r[0] in lists[-1:]]
    assert quality.learn_profiles(spark.createDataFrame([(t,) for t in only], "text string"), common).names[0] == "list"


def test_profiles_without_texts(spark):
    common = spark.createDataFrame([("en", "the")], "lang string, word string")
    for rows in ([], [(None,), ("",)], [(" " * 60,)]):
        p = quality.learn_profiles(spark.createDataFrame(rows, "text string"), common)
        assert p.names == ["rest"] and np.allclose(p.chars, 1 / 6)
    assert quality.learn_profiles(spark.createDataFrame([("word " * 9,)], "text string"), common.limit(0)).names == ["junk", "rest"]


def test_basic_stats(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("The cat, the été.\nno end\n\n",), (None,), ("",), ("  \n",)], "text string")
    rows = df.select(*[c.alias(n) for n, c in quality.basic_stats(F.col("text"), ["the"]).items()]).collect()
    assert rows[0].word_count == 6 and rows[0].common_word_share == 2 / 6 and rows[0].punct_line_share == 0.5
    assert rows[0].mean_word_length == (3 + 3 + 3 + 3 + 2 + 3) / 6 and rows[0].symbol_ratio == 2 / 26
    assert [tuple(r) for r in rows[1:3]] == [(0, None, None, None, None)] * 2
    assert rows[3].word_count == 0 and rows[3].punct_line_share is None
