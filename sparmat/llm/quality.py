"""Text quality statistics and the structural profile nearest to each text.

Basic counts are column expressions. For the profile a text is read in windows of whole lines (at least
``WINDOW_WORDS`` words or ``WINDOW_CHARS`` characters; longer lines are cut at blanks); the share of function
words and the shares of character classes of a window are compared by Jensen-Shannon divergence with learned
profiles: of prose, one per language, and of lists, tables and junk. The share of a text's characters in
windows nearest to prose tells prose from everything else, also where both are mixed.

The profiles are means over all texts of the corpus that carry an unmistakable structure (``structural_label``).
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparmat.session import scratch_table

WINDOW_WORDS, WINDOW_CHARS, LINE_CHARS = 12, 160, 640
#: Labels that are not prose, and learned profiles for each: layouts of one kind differ.
LABELS, LAYOUTS = ("junk", "list", "table"), 4
#: The fit adds up shares as whole multiples of 1 / SCALE, so that sums do not depend on the order of rows.
SCALE = 2**36

#: A word; one or two letters elided before another word (l'eau) are none.
TOKEN = re.compile(r"[^\W_]++(?!['’][^\W\d_])|[^\W_]{3,}")
#: The number or letter of a list item is not a word.
_ORDINAL = re.compile(r"\s*\(?(?:[0-9]{1,3}|[A-Za-z])[.)]\s")
CLASSES = ("letters", "digits", "blanks", "sentence_marks", "inner_marks", "other")
WIDTH = 1 + len(CLASSES)  # share of function words, shares of the classes
_SENTENCE, _INNER, _BLANK = set(".!?…"), set(",'’\"“”«»„()–-"), {" ", "\xa0"}


class _ClassTable(dict):
    """Code point -> digit of its class in ``CLASSES``; line ends are left out."""

    def __missing__(self, point: int) -> str:
        c = chr(point)
        kind = unicodedata.category(c)
        if c == "\n":
            out = ""
        elif kind[0] == "L":
            out = "0"
        elif kind == "Nd":
            out = "1"
        else:
            out = "2" if c in _BLANK else "3" if c in _SENTENCE else "4" if c in _INNER else "5"
        self[point] = out
        return out


_TABLE = _ClassTable()


def class_counts(s: str) -> list[int]:
    t = s.translate(_TABLE)
    return [t.count(d) for d in "012345"]


def windows(text: str) -> Iterator[tuple[str, list[str]]]:
    """(window, its words in lower case) of a text, in order; blank lines belong to none, a short rest to the window before."""
    held: tuple[list[str], list[str]] | None = None
    buf, words, size = [], [], 0
    for line in text.splitlines():
        at = 0
        while at < len(line):
            end = len(line)
            if end - at > LINE_CHARS:
                cut = line.rfind(" ", at + 1, at + LINE_CHARS)
                end = cut if cut > at else at + LINE_CHARS
            part = line[at:end]
            at = end
            if part.strip():
                buf.append(part)
                m = _ORDINAL.match(part)
                words += TOKEN.findall(part[m.end() :].lower() if m else part.lower())
                size += len(part)
                if len(words) >= WINDOW_WORDS or size >= WINDOW_CHARS:
                    if held:
                        yield "\n".join(held[0]), held[1]
                    held, buf, words, size = (buf, words), [], [], 0
    if held:
        yield "\n".join(held[0] + buf), held[1] + words
    elif buf:
        yield "\n".join(buf), words


_MARK = re.compile(r"\s*(?:[•·*▪‣○–—+-]|\(?[0-9]{1,3}[.)]|\(?[A-Za-z][.)])\s+\S")
_CELLS = re.compile(r"[|;,\t]")
_CLOSED = re.compile(r"[.!?…][\"'”’»)\]]*\s*$")


def structural_label(text: str, common: dict[str, set[str]]) -> str | None:
    """'prose_<lang>', 'list', 'table' or 'junk' of a text whose layout leaves no doubt, else None.

    Prose: twenty words or more, at least a quarter of them function words of a language, no more than half of that
    share in any other. List: four fifths of three or more lines begin with a mark and have at most six words without
    a closing mark. Table: three or more lines with the same two or more separators. Junk: five words or more or
    forty characters, none of them a function word, and neither list nor table.
    """
    lines = [x for x in text.splitlines() if x.strip()]
    words = [w for x in lines for w in TOKEN.findall(_ORDINAL.sub("", x, count=1).lower())]
    hits = sorted(((sum(w in c for w in words), lang) for lang, c in common.items()), reverse=True)
    if words and hits and len(words) >= 20 and hits[0][0] * 4 >= len(words) and (len(hits) == 1 or hits[1][0] * 2 <= hits[0][0]):
        return f"prose_{hits[0][1]}"
    few = not hits or hits[0][0] * 20 <= len(words)
    if few and len(lines) >= 3:
        if sum(bool(_MARK.match(x)) and len(TOKEN.findall(x)) <= 6 and not _CLOSED.search(x) for x in lines) * 5 >= len(lines) * 4:
            return "list"
        for mark in ("|", ";", "\t", ","):
            n = Counter(x.count(mark) for x in lines).most_common(1)[0]
            if n[0] >= 2 and n[1] * 5 >= len(lines) * 4:
                return "table"
    if (not hits or hits[0][0] == 0) and (len(words) >= 5 or len(text) >= 40):
        return "junk"
    return None


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon divergence in bits over the last axis."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        a = np.where(p > 0, p * np.log2(p / m), 0.0)
        b = np.where(q > 0, q * np.log2(q / m), 0.0)
    return (a.sum(axis=-1) + b.sum(axis=-1)) / 2


@dataclass
class Profiles:
    """names of the profiles, the share of function words and the shares of the character classes of each.

    The function words of a prose profile are those of its language, of another profile those of the language that
    has most. 'rest' stands in where lists, tables or junk had no example to learn from: no function word, and the
    character classes of all texts, so that function words decide.
    """

    common: dict[str, set[str]]
    names: list[str]
    words: np.ndarray
    chars: np.ndarray

    def __post_init__(self):
        self.langs = sorted(self.common)
        self._of: dict[str, list[int]] = {}
        for i, lang in enumerate(self.langs):
            for w in self.common[lang]:
                self._of.setdefault(w, []).append(i)

    def features(self, window: str, words: list[str]) -> list[int]:
        """[words, function words per language, characters per class]."""
        out = [0] * len(self.langs)
        of = self._of
        for w in words:
            if w in of:
                for i in of[w]:
                    out[i] += 1
        return [len(words), *out, *class_counts(window)]

    def shares(self, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(shares of function words per language, shares of character classes) of rows of features."""
        k = len(self.langs)
        chars = f[:, 1 + k :]
        return f[:, 1 : 1 + k] / np.maximum(1, f[:, :1]), chars / np.maximum(1, chars.sum(axis=1, keepdims=True))

    def distances(self, f: np.ndarray) -> np.ndarray:
        """Divergence of each row of features from each profile: of the function words plus of the character classes."""
        share, chars = self.shares(f)
        most = share.max(axis=1) if share.shape[1] else np.zeros(len(f))
        own = np.stack([share[:, self.langs.index(n[6:])] if n.startswith("prose_") else most for n in self.names], axis=1)
        pair = lambda x: np.stack([x, 1 - x], axis=-1)
        return divergence(pair(own), pair(self.words)[None, :, :]) + divergence(chars[:, None, :], self.chars[None, :, :])

    def read(self, texts: list[str | None]) -> list[tuple[float, str, float]]:
        """Per text: (share of characters in prose windows, profile with most characters, its mean divergence)."""
        rows, owner, size = [], [], []
        out: list = [(0.0, "blank", 0.0)] * len(texts)
        sums: dict[int, tuple[Counter, Counter]] = {}

        def settle() -> None:
            if not rows:
                return
            d = self.distances(np.array(rows, dtype=np.float64))
            best = d.argmin(axis=1)
            for i, b, x, n in zip(owner, best.tolist(), d[np.arange(len(d)), best].tolist(), size):
                chars, div = sums.setdefault(i, (Counter(), Counter()))
                name = self.names[b]
                chars[name] += n
                div[name] += x * n
            rows.clear(), owner.clear(), size.clear()

        for i, t in enumerate(texts):
            for window, words in windows(t or ""):
                rows.append(self.features(window, words))
                owner.append(i)
                size.append(len(window) - window.count("\n"))
            if len(rows) > 20_000:
                settle()
        settle()
        for i, (chars, div) in sums.items():
            top = max(sorted(chars), key=lambda k: chars[k])
            out[i] = (sum(n for k, n in chars.items() if k.startswith("prose_")) / sum(chars.values()), top, div[top] / chars[top])
        return out


def evidence(text: str, base: Profiles) -> tuple[str | None, int, list[int], list[tuple[int, ...]]]:
    """What a text adds to the fit: (its structural label, windows, sums of their shares, their different shares unless prose).

    Shares are whole multiples of 1 / ``SCALE``: of the function words (of the label's language, else of the one with most), of the character classes.
    """
    label = structural_label(text, base.common)
    k = len(base.langs)
    own = base.langs.index(label[6:]) if label and label.startswith("prose_") else None
    n, sums, rows = 0, [0] * WIDTH, set()
    for window, words in windows(text):
        f = base.features(window, words)
        cls = f[1 + k :]
        size = max(1, sum(cls))
        pairs = [(max(f[1 : 1 + k], default=0) if own is None else f[1 + own], max(1, f[0])), *((c, size) for c in cls)]
        row = tuple([(2 * SCALE * part + whole) // (2 * whole) for part, whole in pairs])
        n += 1
        sums = [x + y for x, y in zip(sums, row)]
        if label in LABELS:
            rows.add(row)
    return label if n else None, n, sums, sorted(rows)


def _near(x: np.ndarray, m: np.ndarray) -> Iterator[tuple]:
    """Per centre nearest to some row of ``x``: (number, rows, sums, least distance, its smallest row, largest distance, its smallest row)."""
    d = (((x / SCALE)[:, None, :] - m[None, :, :]) ** 2).sum(axis=2)
    near = d.argmin(axis=1)
    for j in np.unique(near).tolist():
        y, e = x[near == j], d[near == j, j]
        ends = [(float(v), min(y[e == v].tolist())) for v in (e.min(), e.max())]
        yield j, len(y), y.sum(axis=0).tolist(), *ends[0], *ends[1]


def _centres(fold: Callable[[dict[str, np.ndarray]], dict[str, dict[int, tuple]]], k: int = LAYOUTS, steps: int = 10) -> dict[str, np.ndarray]:
    """Means of at most ``k`` groups of different rows per label: farthest-first seeds from the row nearest to the mean, then Lloyd's steps.

    ``fold`` goes over all rows once: centres per label -> label -> centre -> the values of ``_near``. Labels without rows are left out.
    """
    mean = lambda got: np.array([s / (got[0] * SCALE) for s in got[1]])
    row = lambda r: np.array(r) / SCALE
    at = {label: mean(got[0])[None, :] for label, got in fold({x: np.zeros((1, WIDTH)) for x in LABELS}).items()}
    if not at:
        return at
    at = {label: row(got[0][3])[None, :] for label, got in fold(at).items()}
    for _ in range(k - 1):
        far = {label: min((-g[4], g[5]) for g in got.values()) for label, got in fold(at).items()}
        if all(-d <= 1e-6 for d, _ in far.values()):
            break
        at = {label: np.vstack([m, row(far[label][1])]) if -far[label][0] > 1e-6 else m for label, m in at.items()}
    for _ in range(steps):
        got = fold(at)
        moved = {label: np.stack([mean(got[label][j]) if j in got[label] else c for j, c in enumerate(m)]) for label, m in at.items()}
        if all((moved[label] == m).all() for label, m in at.items()):
            break
        at = moved
    return at


def _assemble(common: dict[str, set[str]], totals: dict[str | None, tuple[int, list[int]]], centres: dict[str, np.ndarray]) -> Profiles:
    """Profiles from (windows, sums of their shares) per label, None among them, and the centres of the labels that are not prose."""
    names, rows = [], []
    for label in sorted(x for x in totals if x):
        n, sums = totals[label]
        for c in [np.array([s / (n * SCALE) for s in sums])] if label.startswith("prose_") else centres[label]:
            names.append(label)
            rows.append(c)
    if not all(x in totals for x in LABELS):
        n = sum(got[0] for got in totals.values())
        every = [sum(got[1][i] for got in totals.values()) for i in range(1, WIDTH)]
        names.append("rest")
        rows.append(np.array([0.0, *([s / (n * SCALE) for s in every] if n else [1 / len(CLASSES)] * len(CLASSES))]))
    x = np.stack(rows)
    return Profiles(common, names, x[:, 0], x[:, 1:])


def _bare(common: dict[str, set[str]]) -> Profiles:
    return Profiles(common, [], np.zeros(0), np.zeros((0, len(CLASSES))))


def fit_profiles(texts: list[str], common: dict[str, set[str]]) -> Profiles:
    """Profiles from texts at hand: those with a structural label, window by window; the others only count for 'rest'."""
    base = _bare(common)
    totals: dict[str | None, tuple[int, list[int]]] = {}
    held: dict[str, set] = {}
    for t in texts:
        label, n, sums, rows = evidence(t, base)
        m, old = totals.get(label, (0, [0] * WIDTH))
        totals[label] = (m + n, [a + b for a, b in zip(old, sums)])
        if rows:
            held.setdefault(label, set()).update(rows)
    x = {label: np.array(sorted(rows)) for label, rows in held.items()}
    return _assemble(common, totals, _centres(lambda at: {k: {j: tuple(g) for j, *g in _near(x[k], m)} for k, m in at.items() if k in x}))


def learn_profiles(docs: DataFrame, common: DataFrame, text: str = "text") -> Profiles:
    """Profiles from all texts of the corpus, read whole, and function words (lang, word).

    Different texts count once (by a 128-bit hash), so neither a text that is repeated often nor the order of rows matters; sums are
    whole numbers, so neither do partitions: the profiles are those of ``fit_profiles`` over the different texts. A text is read once;
    what it adds is written to the shared folder. The driver gets sums per label and per centre. Function words are a list as long as
    the languages are many.
    """
    words: dict[str, set[str]] = {}
    for r in common.where("word IS NOT NULL AND lang IS NOT NULL").select("lang", "word").distinct().collect():
        words.setdefault(r.lang.lower(), set()).add(r.word.lower())
    held = docs.sparkSession.sparkContext.broadcast(_bare(words))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.binary(), pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.list_(pa.int64())))
        for b in batches:
            got = [(hashlib.blake2b(t.encode(), digest_size=16).digest(), *evidence(t, held.value)) for t in b.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([g[i] for g in got], k) for i, k in enumerate(kinds)], names=["key", "label", "n", "sums", "rows"])

    texts = docs.select(F.col(text).alias("t")).where(F.length("t") > 0)
    seen = scratch_table(texts.mapInArrow(look, "key binary, label string, n bigint, sums array<bigint>, rows array<array<bigint>>"), "text-shares")
    add = [F.sum(F.col("sums")[i].cast("decimal(20,0)")).alias(f"s{i}") for i in range(WIDTH)]
    per = seen.select("key", "label", "n", "sums").distinct().groupBy("label").agg(F.sum("n").alias("n"), *add).collect()
    x = scratch_table(seen.select("label", F.explode("rows").alias("x")).distinct(), "layout-shares")
    return _assemble(words, {r.label: (r.n, [int(v) for v in r[2:]]) for r in per}, _centres(lambda at: _fold(x, at)))


def _fold(rows: DataFrame, at: dict[str, np.ndarray]) -> dict[str, dict[int, tuple]]:
    """``_near`` over all rows (label, x) of a table: one job, a row per batch and centre, one a centre to the driver."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.float64(), pa.list_(pa.int64()), pa.float64(), pa.list_(pa.int64()))
        for b in batches:
            labels = b.column("label").to_numpy(zero_copy_only=False)
            x = b.column("x").flatten().to_numpy().reshape(-1, WIDTH)
            got = [(k, *g) for k, m in at.items() if (labels == k).any() for g in _near(x[labels == k], m)]
            yield pa.RecordBatch.from_arrays([pa.array([g[i] for g in got], kind) for i, kind in enumerate(kinds)], names=names)

    names = ["label", "centre", "n", "sums", "least", "near", "largest", "far"]
    parts = rows.mapInArrow(look, "label string, centre int, n bigint, sums array<bigint>, least double, near array<bigint>, largest double, far array<bigint>")
    add = [F.sum(F.col("sums")[i].cast("decimal(20,0)")).alias(f"s{i}") for i in range(WIDTH)]
    ends = [F.min(F.struct("least", "near")).alias("near"), F.min(F.struct(-F.col("largest"), "far")).alias("far")]
    out: dict[str, dict[int, tuple]] = {}
    for r in parts.groupBy("label", "centre").agg(F.sum("n").alias("n"), *ends, *add).collect():
        out.setdefault(r.label, {})[r.centre] = (r.n, [int(r[f"s{i}"]) for i in range(WIDTH)], *r.near, -r.far[0], r.far[1])
    return out


def profile_rows(profiles: Profiles) -> list[tuple]:
    """The learned table: (profile, function_words, letters, digits, blanks, sentence_marks, inner_marks, other)."""
    return [(n, float(w), *map(float, c)) for n, w, c in zip(profiles.names, profiles.words, profiles.chars)]


def structure(docs: DataFrame, profiles: Profiles, keep: list[str], text: str = "text") -> DataFrame:
    """(keep, prose_share, profile, divergence): one row per document; null and blank texts have profile 'blank' and share 0.

    Texts of any length are read whole; nothing is shuffled; other columns are ignored.
    """
    fields = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    held = docs.sparkSession.sparkContext.broadcast(profiles)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = held.value.read(b.column("_text").to_pylist())
            cols = [pa.array([g[i] for g in got], k) for i, k in enumerate((pa.float64(), pa.string(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], *cols], names=[*keep, "prose_share", "profile", "divergence"])

    schema = ", ".join([f"`{c}` {fields[c]}" for c in keep] + ["prose_share double, profile string, divergence double"])
    return docs.select(*keep, F.col(text).alias("_text")).mapInArrow(look, schema)


def basic_stats(text: Column, common: list[str]) -> dict[str, Column]:
    """Column expressions: word_count, mean_word_length, symbol_ratio, punct_line_share, common_word_share.

    Words are runs of letters and digits. Symbols are characters that are neither letters, digits nor white space. Lines
    are the non-blank lines; the closing mark is one of . ! ? … possibly followed by a quote or bracket.
    Null, empty and blank texts have counts of 0 and null ratios.
    """
    t = F.coalesce(text, F.lit(""))
    words = F.regexp_extract_all(F.lower(t), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
    n = F.size(words)
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.regexp_replace(x, r"[\s ]+", "")) > 0)
    ends = F.filter(lines, lambda x: x.rlike(r"[.!?…][\"'”’»)\]]*\s*$"))
    known = F.array(*[F.lit(w) for w in sorted(set(common))])
    return {
        "word_count": n,
        "mean_word_length": F.when(n > 0, F.aggregate(words, F.lit(0), lambda a, w: a + F.length(w)) / n),
        "symbol_ratio": F.when(F.length(t) > 0, F.length(F.regexp_replace(t, r"[\p{L}\p{N}\s ]", "")) / F.length(t)),
        "punct_line_share": F.when(F.size(lines) > 0, F.size(ends) / F.size(lines)),
        "common_word_share": F.when(n > 0, F.size(F.filter(words, lambda w: F.array_contains(known, w))) / n),
    }
