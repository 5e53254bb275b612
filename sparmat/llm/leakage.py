"""Held-out texts inside training texts, by a generalised suffix automaton over normalised words.

The automaton of all test items is broadcast; every document is streamed through it word by word,
tracking the length of the longest match that ends at each word. Where that length reaches the minimum,
the items that hold the passage are read from the automaton, and the covered words are joined to spans.
The automaton is linear in the words of the items and kept in flat arrays; item sets beyond ``most_words`` words
are split into groups with an automaton each, and the passages found by the groups are joined per document
before anything is derived from them, so the split changes nothing in the result.
"""

from __future__ import annotations

import re
import unicodedata
from array import array
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A word with the combining and invisible characters that may stand inside it.
WORD = re.compile("(?:[^\\W_]|[­̀-ͯ​-‏⁠-⁤﻿᠎])+")
_ALNUM = re.compile(r"[^\W_]+")


def fold(word: str) -> tuple[str, ...]:
    """A raw word without accents, case and invisible characters; compatible forms may fall apart into several."""
    if word.isascii():
        return (word.lower(),)
    s = unicodedata.normalize("NFKD", unicodedata.normalize("NFKD", word).casefold())
    s = "".join(c for c in s if unicodedata.category(c) not in ("Mn", "Cf"))
    return tuple(_ALNUM.findall(s))


class Automaton:
    """Suffix automaton of several word sequences. State 0 is the root.

    Most states have one transition: it stands in two flat arrays, further ones in a dict per branching state. The items
    of a state are those of its subtree in the suffix-link tree, a range of the tree's depth-first order.
    """

    def __init__(self, items: list[tuple[int, str]], least: int):
        self.least = least
        self.words: dict[str, int] = {}
        self.code, self.to = array("i", [-1]), array("i", [0])
        self.more: dict[int, dict[int, int]] = {}
        self.link, self.length = array("i", [-1]), array("i", [0])
        self.memo: dict[str, tuple[int, ...]] = {}
        self.at_item: dict[int, tuple[tuple[int, int], ...]] = {}
        ends, owner = array("i"), array("q")
        for item, text in items:
            last = 0
            for raw in WORD.findall(text or ""):
                for w in fold(raw):
                    last = self._extend(last, self.words.setdefault(w, len(self.words)))
                    ends.append(last)
                    owner.append(item)
        self._order(np.array(ends, dtype=np.int64), np.array(owner, dtype=np.int64))

    def _order(self, ends: np.ndarray, owner: np.ndarray) -> None:
        """Depth-first ranges of the link tree and the items in that order."""
        n = len(self.link)
        link = np.array(self.link, dtype=np.int64)
        size = np.ones(n, dtype=np.int64)
        by_length = np.argsort(np.array(self.length), kind="stable")
        parent, total = link.tolist(), size.tolist()
        for v in by_length[:0:-1].tolist():
            total[parent[v]] += total[v]
        first, free = [0] * n, [1] * n
        for v in by_length[1:].tolist():  # parents are shorter, so they come first
            p = parent[v]
            first[v] = first[p] + free[p]
            free[p] += total[v]
        place = np.array(first, dtype=np.int64)[ends] if len(ends) else ends
        order = np.argsort(place, kind="stable")
        self.place, self.owner = place[order], owner[order]
        self.first, self.size = array("i", first), array("i", total)

    def _next(self, v: int, c: int) -> int:
        """State after word ``c``, or -1."""
        if self.code[v] == c:
            return self.to[v]
        m = self.more.get(v)
        return m.get(c, -1) if m else -1

    def _set(self, v: int, c: int, u: int) -> None:
        if self.code[v] in (c, -1):
            self.code[v], self.to[v] = c, u
        else:
            self.more.setdefault(v, {})[c] = u

    def _state(self, length: int) -> int:
        self.code.append(-1)
        self.to.append(0)
        self.link.append(0)
        self.length.append(length)
        return len(self.link) - 1

    def _extend(self, last: int, c: int) -> int:
        q = self._next(last, c)
        if q >= 0:  # the prefix is known from an earlier item
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, q, c)
        cur = self._state(self.length[last] + 1)
        p = last
        while p >= 0 and self._next(p, c) < 0:
            self._set(p, c, cur)
            p = self.link[p]
        if p >= 0:
            q = self._next(p, c)
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._clone(p, q, c)
        return cur

    def _clone(self, p: int, q: int, c: int) -> int:
        new = self._state(self.length[p] + 1)
        self.code[new], self.to[new] = self.code[q], self.to[q]
        if q in self.more:
            self.more[new] = dict(self.more[q])
        self.link[new] = self.link[q]
        self.link[q] = new
        while p >= 0 and self._next(p, c) == q:
            self._set(p, c, new)
            p = self.link[p]
        return new

    def items_of(self, v: int) -> tuple[tuple[int, int], ...]:
        """(item, longest suffix of a match in this state that the item holds, up to the match's length), of ``least`` words or more."""
        got = self.at_item.get(v)
        if got is None:
            best: dict[int, int] = {}
            u = v
            while self.length[u] >= self.least:
                a, b = np.searchsorted(self.place, (self.first[u], self.first[u] + self.size[u]))
                for item in np.unique(self.owner[a:b]).tolist():
                    best.setdefault(item, self.length[u])
                u = self.link[u]
            got = self.at_item[v] = tuple(sorted(best.items()))
        return got

    def scan(self, text: str) -> tuple[dict[int, int], list[tuple[int, int]], int]:
        """({item: its longest passage of ``least`` words or more}, spans as character offsets, words of the text)."""
        state = match = words = 0
        found: dict[int, int] = {}
        spans: list[list[int]] = []
        starts: list[int] = []
        code, to, more, link, length, memo = self.code, self.to, self.more, self.link, self.length, self.memo
        root = more.get(0, {})
        for m in WORD.finditer(text):
            raw = m.group()
            codes = memo.get(raw)
            if codes is None:
                codes = memo[raw] = tuple(self.words.get(w, -1) for w in fold(raw))
                if len(memo) > 500_000:
                    memo.clear()
            for c in codes:
                words += 1
                starts.append(m.start())
                if c < 0:  # a word of no item
                    state = match = 0
                    continue
                while True:
                    if code[state] == c:
                        state, match = to[state], match + 1
                        break
                    u = (more[state] if state in more else {}).get(c) if state else root.get(c)
                    if u is not None:
                        state, match = u, match + 1
                        break
                    if not state:
                        match = 0
                        break
                    state = link[state]
                    match = length[state]
                if match >= self.least:
                    for item, most in self.items_of(state):
                        n = most if most < match else match
                        if found.get(item, 0) < n:
                            found[item] = n
                    first = starts[words - match]
                    while spans and spans[-1][1] >= first:
                        first = min(first, spans.pop()[0])
                    spans.append([first, m.end()])
        return found, [tuple(s) for s in spans], words


def join_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans that overlap or touch become one; in order."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and out[-1][1] >= s:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def cut(text: str, spans: list[tuple[int, int]]) -> tuple[int, str]:
    """(words within the spans, the text without them)."""
    pieces, at, covered = [], 0, 0
    for s, e in spans:
        pieces.append(text[at:s])
        covered += sum(len(fold(m.group())) for m in WORD.finditer(text, s, e))
        at = e
    return covered, "".join([*pieces, text[at:]])


LEAK = "leaks array<struct<item:bigint,words:int>>, n_words int, covered_words int, kept_text string"
_FOUND = "leaks array<struct<item:bigint,words:int>>, n_words int, spans array<struct<s:int,e:int>>, _text string"
_LEAKS = pa.list_(pa.struct([("item", pa.int64()), ("words", pa.int32())]))
_SPANS = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))


def find_leaks(
    docs: DataFrame, items: DataFrame, keep: list[str], text: str = "text", least: int = 12, item: str = "item_id", item_text: str = "text", most_words: int = 300_000
) -> DataFrame:
    """(keep, leaks, n_words, covered_words, kept_text): one row per document that holds a passage of an item.

    ``leaks``: each item of which at least ``least`` successive words stand in the document, in order, and
    the longest such run of the item. ``kept_text``: the text without the covered spans. Words are runs of letters and
    digits; case, accents, punctuation, spacing and invisible characters do not count. Null and empty
    texts hold nothing; items shorter than ``least`` words cannot leak; items with one text are all reported; documents of
    any length are streamed whole; repeated documents have a row each. With one group of items nothing is shuffled;
    with several only the documents concerned are. An automaton takes about 150 bytes a word: ``most_words`` bounds the broadcast.
    """
    fields = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    size = items.agg(F.sum(F.size(F.split(item_text, r"\s+")))).first()[0] or 0
    groups = max(1, -(-int(size) // most_words))
    kept = ", ".join(f"`{c}` {fields[c]}" for c in keep)
    kept = kept + ", " if kept else ""

    def group(g: int) -> DataFrame:
        part = items.where(F.pmod(F.xxhash64(item), F.lit(groups)) == g).select(F.col(item).cast("bigint"), item_text).orderBy(item)
        machine = docs.sparkSession.sparkContext.broadcast(Automaton([(r[0], r[1]) for r in part.toLocalIterator()], least))

        def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            a = machine.value
            for b in batches:
                rows, leaks, n, spans = [], [], [], []
                for i, t in enumerate(b.column("_text").to_pylist()):
                    found, at, words = a.scan(t) if t else ({}, [], 0)
                    if found:
                        rows.append(i)
                        leaks.append([{"item": k, "words": found[k]} for k in sorted(found)])
                        n.append(words)
                        spans.append([{"s": s, "e": e} for s, e in at])
                cols = [b.column(c).take(pa.array(rows, pa.int64())) for c in [*keep, "_text"]]
                cols[-1:-1] = [pa.array(leaks, _LEAKS), pa.array(n, pa.int32()), pa.array(spans, _SPANS)]
                yield pa.RecordBatch.from_arrays(cols, names=[*keep, "leaks", "n_words", "spans", "_text"])

        return docs.select(*keep, F.col(text).alias("_text")).mapInArrow(look, kept + _FOUND)

    found = group(0)
    if groups > 1:  # a document's findings in all groups become one row; repeated documents are counted in each group
        each = [group(g).withColumn("_g", F.lit(g)) for g in range(groups)]
        rows = reduce(DataFrame.unionByName, each).withColumn("_h", F.sha2("_text", 256))
        per = rows.groupBy(*keep, "_h", "_g").agg(F.count(F.lit(1)).alias("_n"), *[F.first(c).alias(c) for c in ("leaks", "n_words", "spans", "_text")])
        whole = per.groupBy(*keep, "_h").agg(
            F.array_sort(F.flatten(F.collect_list("leaks"))).alias("leaks"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.first("_text").alias("_text"), F.max("_n").alias("_n")
        )
        found = whole.withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int")))).select(*keep, "leaks", "n_words", "spans", "_text")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [cut(t, join_spans([(x["s"], x["e"]) for x in at])) for t, at in zip(b.column("_text").to_pylist(), b.column("spans").to_pylist())]
            cols = [b.column(c) for c in [*keep, "leaks", "n_words"]] + [pa.array([g[0] for g in got], pa.int32()), pa.array([g[1] for g in got], pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=[*keep, "leaks", "n_words", "covered_words", "kept_text"])

    return found.mapInArrow(finish, kept + LEAK)
