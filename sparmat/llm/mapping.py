"""Mapping freely entered values to a reference list.

A symmetric-delete dictionary holds every reference spelling under all strings that arise from it by
dropping at most d letters. A typed value is looked up with its own dropped-letter strings, which finds
every entry within d edits without comparing against the list; the few candidates are verified by the
Damerau-Levenshtein distance, ranked by a weighted distance and then by how often the entry is used,
and values that stand for no entry are reported.

A broadcast dictionary holds at most ``MOST_ENTRIES`` entries (each about 70 strings of a dozen letters a
spelling); the strings of a longer list are joined instead (``map_by_join``, ``nearest_by_join``).
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparmat.session import scratch_table

MOST_ENTRIES = 20_000

# Letters of other scripts that look like Latin ones (fixed values).
LOOKALIKES = str.maketrans("авекмнорстухіјѕԁԛԝһαβεικνορτυχ", "abekmhopctyxijsdqwhabeiknoptux")
#: What stands for no value (fixed values).
EMPTY = {"", "na", "nan", "none", "null", "unknown", "n"}


def clean(s: str | None) -> str:
    """Compatible forms, lookalike letters, invisible characters, accents and case removed."""
    if not s:
        return ""
    if not s.isascii():
        s = unicodedata.normalize("NFKC", s).casefold().translate(LOOKALIKES)
        s = "".join(c for c in unicodedata.normalize("NFKD", s) if unicodedata.category(c) not in ("Cf", "Mn", "Cc") or c in "\t\n")
    return s.casefold().strip()


def deletions(s: str, d: int) -> set[str]:
    """``s`` and all strings with at most ``d`` of its letters dropped."""
    out = {s}
    for k in range(1, min(d, len(s)) + 1):
        for drop in combinations(range(len(s)), k):
            gone = set(drop)
            out.add("".join(c for i, c in enumerate(s) if i not in gone))
    return out


_LIKE = {frozenset(p) for p in ("0o", "1l", "1i", "5s", "8b", "2z", "6g", "9g")}
_VOWELS = set("aeiouy")


def _swap_cost(a: str, b: str) -> float:
    if frozenset((a, b)) in _LIKE:
        return 0.3
    return 0.8 if a in _VOWELS and b in _VOWELS else 1.0


def distance(a: str, b: str, limit: int) -> tuple[int, float] | None:
    """(edits, weighted edits) of the Damerau-Levenshtein distance with neighbouring exchanges, or None beyond ``limit``."""
    if abs(len(a) - len(b)) > limit:
        return None
    if a == b:
        return 0, 0.0
    two: list = []
    one = [(j, float(j)) for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        row = [(i, float(i))]
        for j, y in enumerate(b, 1):
            if x == y:
                best = one[j - 1]
            else:
                p = one[j - 1]
                best = min((one[j][0] + 1, one[j][1] + 1.0), (row[j - 1][0] + 1, row[j - 1][1] + 1.0), (p[0] + 1, p[1] + _swap_cost(x, y)))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, (two[j - 2][0] + 1, two[j - 2][1] + 0.7))
            row.append(best)
        if min(r[0] for r in row) > limit:
            return None
        two, one = one, row
    return one[-1] if one[-1][0] <= limit else None


@dataclass
class Dictionary:
    """variants: dropped-letter string -> spellings; owners: spelling -> entries by falling use."""

    variants: dict[str, list[str]]
    owners: dict[str, list[tuple[int, str]]]
    edits: int

    @classmethod
    def build(cls, spellings: Iterable[tuple[str, str, int]], edits: int) -> Dictionary:
        """``spellings``: (spelling, entry, uses)."""
        owners: dict[str, list[tuple[int, str]]] = {}
        for s, entry, uses in spellings:
            owners.setdefault(s, []).append((-uses, entry))
        variants: dict[str, list[str]] = {}
        for s in owners:
            owners[s].sort()
            for v in deletions(s, edits):
                variants.setdefault(v, []).append(s)
        return cls(variants, owners, edits)

    def nearest(self, s: str) -> tuple[float, int, str] | None:
        """(weighted distance, -uses, entry) of the best entry within the limit."""
        if s in self.owners:
            uses, entry = self.owners[s][0]
            return 0.0, uses, entry
        best, seen = None, set()
        for v in deletions(s, self.edits):
            for t in self.variants.get(v, ()):
                if t not in seen:
                    seen.add(t)
                    d = distance(s, t, self.edits)
                    if d is not None:
                        uses, entry = self.owners[t][0]
                        best = min(best, (d[1], uses, entry)) if best else (d[1], uses, entry)
        return best



def stem_and_number(s: str) -> tuple[str, str]:
    """A name's letters and its closing number ('' if there is none)."""
    stem = s.rstrip("0123456789")
    return stem, s[len(stem) :].lstrip("0")


@dataclass(frozen=True)
class Bounds:
    """What the whole list says about its spellings: letters that ids begin with, lengths of names without their closing
    numbers, most digits of such a number. They decide what is read from a typed value, so every part of a list shares them."""

    heads: tuple[str, ...]
    shortest: int
    longest: int
    most_digits: int

    @classmethod
    def of(cls, spellings: Iterable[tuple[str, str, str, int]]) -> Bounds:
        heads, short, long, digits = set(), None, 0, 0
        for key, s, _, _ in spellings:
            if key == "id":
                heads.add(re.match(r"[a-z]*", s)[0])
            else:
                short, long, digits = min(len(s), len(s) if short is None else short), max(long, len(s)), max(digits, len(key) - 1)
        return cls(tuple(sorted(heads)), 1 if short is None else short, long or 1, digits)

    def join(self, other: Bounds) -> Bounds:
        return Bounds(tuple(sorted({*self.heads, *other.heads})), min(self.shortest, other.shortest), max(self.longest, other.longest), max(self.most_digits, other.most_digits))


def spellings(uid: str, ident: str | None, gene: str | None, alias: str | None, uses: int) -> Iterator[tuple[str, str, str, int]]:
    """(key, spelling, uid, uses) of an entry: its id under 'id', names without closing number under 'n<number>'."""
    if clean(ident):
        yield "id", clean(ident), uid, uses
    for rank, name in enumerate([gene, *(alias or "").split("|")]):
        plain = re.sub(r"[\W_]", "", clean(name))
        if plain:
            stem, number = stem_and_number(plain)
            yield "n" + number, stem, uid, uses if not rank else 0


#: Edits allowed in an id and in a name.
EDITS = {"id": 1, "n": 2}


class Reader:
    """What a typed value may stand for: (key, spelling) as in ``spellings``."""

    def __init__(self, bounds: Bounds):
        self.bounds = bounds
        heads = "|".join(sorted(map(re.escape, bounds.heads), key=len, reverse=True))
        self.id_pattern = re.compile(r"(?<![a-z0-9])(%s)[^a-z0-9]*([0-9]+)(?:\.[0-9]+)?(?![a-z0-9])" % heads if bounds.heads else r"(?!)()()")

    def ids(self, text: str) -> Iterator[tuple[str, str]]:
        for m in self.id_pattern.finditer(text.replace("_", " ")):
            yield "id", m[1] + m[2]

    def names(self, text: str) -> Iterator[tuple[str, str]]:
        b = self.bounds
        parts = re.findall(r"[^\W_]+", self.id_pattern.sub(" ; ", text.replace("_", " ")))
        for i in range(len(parts)):  # a value may stand alone, among additions, or be cut by separators
            value = ""
            for part in parts[i:]:
                value += part
                stem, number = stem_and_number(value)
                if len(stem) > b.longest + 2 or (len(value) > b.longest + 2 and len(number) > b.most_digits):
                    break  # further parts only make it longer
                if value not in EMPTY and b.shortest - 2 <= len(stem) <= b.longest + 2:
                    yield "n" + number, stem

    def tiers(self, name: str | None, ident: str | None) -> Iterator[Iterator[tuple[str, str]]]:
        """In the order that decides: ids of the id field, ids of the name field, names of the name field, names of the id field."""
        a, b = clean(name), clean(ident)
        yield from (self.ids(b), self.ids(a), self.names(a), self.names(b))


class GeneMatcher:
    """Entry of a typed (name, id) pair: an id that stands for an entry decides, else the name."""

    def __init__(self, genes: list[tuple[str, str, str, str | None, int]]):
        """``genes``: (uid, id, gene, alias, uses)."""
        rows = [x for g in genes for x in spellings(*g)]
        self.reader = Reader(Bounds.of(rows))
        held: dict[str, list] = {}
        for key, s, uid, n in rows:
            held.setdefault(key, []).append((s, uid, n))
        # names with different closing numbers never stand for each other: one dictionary per number
        self.by_key = {key: Dictionary.build(r, EDITS[key if key == "id" else "n"]) for key, r in held.items()}
        self.memo: dict = {}

    def best(self, name: str | None, ident: str | None) -> tuple[int, float, int, str] | None:
        """(tier, weighted distance, -uses, uid) of the entry, or None."""
        key = (name, ident)
        if key in self.memo:
            return self.memo[key]
        found = None
        for tier, values in enumerate(self.reader.tiers(name, ident)):
            hit = min((h for k, s in values if k in self.by_key and (h := self.by_key[k].nearest(s))), default=None)
            if hit:
                found = (tier, *hit)
                break
        if len(self.memo) >= 200_000:
            self.memo.clear()
        self.memo[key] = found
        return found

    def match(self, name: str | None, ident: str | None) -> str:
        """uid, or 'none'."""
        found = self.best(name, ident)
        return found[3] if found else "none"


def map_to_genes(rows: DataFrame, genes: DataFrame, keep: list[str], name: str = "gene_name", ident: str = "gene_id", most_entries: int = MOST_ENTRIES) -> DataFrame:
    """(keep, name, ident, uid): the entry of every row that is not literally one; 'none' if it stands for no entry.

    Null, empty and sentinel fields are missing values; very long fields are looked up part by part; columns of
    ``rows`` that are not asked for are ignored. Use counts are the literal rows of ``rows``. A list (uid, id, gene, alias)
    of at most ``most_entries`` entries is broadcast as a dictionary and the rows are not shuffled (their literal pairs are
    counted by a pre-aggregated group-by), so a value that a third of all rows share costs no imbalance and is looked
    up once a task. A longer list is joined by its dropped-letter strings (``map_by_join``), with the same result.
    """
    literal = genes.select(F.col("gene").alias("_g"), F.col("id").alias("_i")).distinct()
    free = rows.select(*keep, name, ident).join(literal, (F.col(name) == F.col("_g")) & (F.col(ident) == F.col("_i")), "left_anti")
    uses = rows.groupBy(F.col(name).alias("gene"), F.col(ident).alias("id")).agg(F.count(F.lit(1)).alias("uses"))
    listed = genes.select("uid", "id", "gene", "alias").join(uses, ["gene", "id"], "left").select("uid", "id", "gene", "alias", F.coalesce("uses", F.lit(0)).alias("uses"))
    if genes.count() > most_entries:
        return map_by_join(free, listed, name, ident)
    fields = {f.name: f.dataType.simpleString() for f in free.schema.fields}
    matcher = rows.sparkSession.sparkContext.broadcast(GeneMatcher([tuple(r) for r in listed.orderBy("uid").collect()]))
    own = tuple(free.columns)

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = matcher.value
        for b in batches:
            got = [m.match(n, i) for n, i in zip(b.column(name).to_pylist(), b.column(ident).to_pylist())]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in own], pa.array(got, pa.string())], names=[*own, "uid"])

    return free.mapInArrow(look_up, ", ".join([f"`{c}` {fields[c]}" for c in own] + ["uid string"]))


def map_by_join(free: DataFrame, listed: DataFrame, name: str, ident: str) -> DataFrame:
    """(columns of ``free``, uid): as ``map_to_genes`` for lists of any length.

    The different typed pairs and the entries (uid, id, gene, alias, uses) send their dropped-letter strings, equal
    strings of one key join, the candidates are verified by the distance and the best is joined back to the rows. Only
    the bounds of the spellings come to the driver: one row a partition of the list, folded on the executors.
    """
    text, big = pa.string(), pa.int64()

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [x for row in zip(*[b.column(c).to_pylist() for c in ("uid", "id", "gene", "alias", "uses")]) for x in spellings(*row)]
            cols = list(zip(*out)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (text, text, text, big))], names=["key", "spelling", "uid", "uses"])

    entries = scratch_table(listed.select("uid", "id", "gene", "alias", "uses").mapInArrow(spell, "key string, spelling string, uid string, uses bigint"), "spellings")
    names = F.when(F.col("key") != "id", F.length("spelling"))
    b = entries.agg(
        F.collect_set(F.when(F.col("key") == "id", F.regexp_extract("spelling", "^[a-z]*", 0))).alias("heads"), F.min(names).alias("a"), F.max(names).alias("z"), F.max(F.when(F.col("key") != "id", F.length("key") - 1)).alias("d")
    ).first()
    reader = Reader(Bounds(tuple(sorted(b.heads)), 1 if b.a is None else b.a, b.z or 1, b.d or 0))

    def vary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for n, i in zip(b.column("n").to_pylist(), b.column("i").to_pylist()):
                for tier, values in enumerate(reader.tiers(n, i)):
                    for key, s in set(values):
                        out += [(n, i, tier, key, s, v) for v in deletions(s, EDITS[key if key == "id" else "n"])]
                if len(out) > 20_000:
                    yield pack(out)
                    out = []
            yield pack(out)

    def pack(out: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*out)) or [()] * 6
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (text, text, pa.int32(), text, text, text))], names=["n", "i", "tier", "key", "value", "variant"])

    def drop_letters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [sorted(deletions(s, EDITS[k if k == "id" else "n"])) for k, s in zip(b.column("key").to_pylist(), b.column("spelling").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("spelling"), b.column("best"), pa.array(got, pa.list_(text))], names=["key", "spelling", "best", "variants"])

    best = F.min(F.struct((-F.col("uses")).alias("use"), "uid")).alias("best")
    kind = "best struct<use:bigint,uid:string>"
    known = entries.groupBy("key", "spelling").agg(best).mapInArrow(drop_letters, f"key string, spelling string, {kind}, variants array<string>")
    known = known.select("key", "spelling", "best", F.explode("variants").alias("variant"))
    typed = free.select(F.col(name).alias("n"), F.col(ident).alias("i")).distinct()
    pairs = typed.mapInArrow(vary, "n string, i string, tier int, key string, value string, variant string").join(known, ["key", "variant"])
    pairs = pairs.select("n", "i", "tier", "key", "value", "spelling", "best").distinct()

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [distance(v, s, EDITS[k if k == "id" else "n"]) for k, v, s in zip(*[b.column(c).to_pylist() for c in ("key", "value", "spelling")])]
            cols = [b.column("n"), b.column("i"), b.column("tier"), pa.array([g[1] if g else None for g in got], pa.float64()), b.column("best")]
            yield pa.RecordBatch.from_arrays(cols, names=["n", "i", "tier", "dist", "best"]).filter(pa.array([g is not None for g in got]))

    hits = pairs.mapInArrow(verify, f"n string, i string, tier int, dist double, {kind}")
    top = hits.groupBy("n", "i").agg(F.min(F.struct("tier", "dist", "best")).alias("top")).select("n", "i", F.col("top.best.uid").alias("_uid"))
    on = F.col(name).eqNullSafe(F.col("n")) & F.col(ident).eqNullSafe(F.col("i"))
    return free.join(top, on, "left").select(*free.columns, F.coalesce("_uid", F.lit("none")).alias("uid"))


def nearest_by_join(values: DataFrame, value: str, entries: DataFrame, spelling: str, entry: str, edits: int = 2) -> DataFrame:
    """(value, entry, edits, weighted): the best entry of each distinct cleaned value, by a join; entry is null for misses.

    For lists too long to broadcast: both sides send their dropped-letter strings, equal strings join,
    and the candidates are verified as in ``Dictionary.nearest``. Ties go to the smaller entry. Null
    values are left out.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = b.column("v").to_pylist()
            plain = [re.sub(r"[\W_]", "", clean(x)) for x in raw]
            var = [sorted(deletions(p, edits)) for p in plain]
            yield pa.RecordBatch.from_arrays([b.column("v"), pa.array(plain, pa.string()), pa.array(var, pa.list_(pa.string()))], names=["v", "p", "d"])

    kind = "v string, p string, d array<string>"
    left = values.select(F.col(value).alias("v")).where("v IS NOT NULL").distinct().mapInArrow(spread, kind)
    right = entries.select(F.col(spelling).alias("v")).where("v IS NOT NULL").distinct().mapInArrow(spread, kind)
    pairs = left.select(F.col("v").alias("value"), F.col("p").alias("a"), F.explode("d").alias("d")).join(
        right.select(F.col("v").alias("spelling"), F.col("p").alias("b"), F.explode("d").alias("d")), "d"
    )

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            got = [distance(x, y, edits) for x, y in zip(t.column("a").to_pylist(), t.column("b").to_pylist())]
            keep = pa.array([g is not None for g in got])
            cols = [t.column("value"), t.column("spelling"), pa.array([g[0] if g else None for g in got], pa.int32()), pa.array([g[1] if g else None for g in got], pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, names=["value", "spelling", "edits", "weighted"]).filter(keep)

    close = pairs.select("value", "spelling", "a", "b").distinct().mapInArrow(verify, "value string, spelling string, edits int, weighted double")
    named = close.join(entries.select(F.col(spelling).alias("spelling"), F.col(entry).alias("entry")), "spelling")
    best = Window.partitionBy("value").orderBy("weighted", "entry")
    top = named.withColumn("rn", F.row_number().over(best)).where("rn = 1").select("value", "entry", "edits", "weighted")
    return left.select(F.col("v").alias("value")).join(top, "value", "left")
