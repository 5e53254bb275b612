"""Percentiles of very large columns with relative-rank compactors.

A sketch is a stack of compactors; level h holds values of weight 2**h. A full buffer is sorted and its
values *far from the protected tail* are halved into the next level, a longer stretch the more trailing
ones the compactor's counter has; the half of the buffer next to the protected tail is never compacted.
So the error of a rank is proportional to its distance from the protected end: percentiles near that
end have a multiplicative error, and with few values they are exact. Two sketches of opposite tails are
kept per group. Sketches of partitions or days merge by joining their levels and compacting again.
Halving a sorted stretch of level h moves no rank by more than 2**h: the sketch adds these up (``error``), so a bracket
of proven width around any percentile is known, and an exact search needs to look at the values inside it only.
(Cormode, Karnin, Liberty, Thaler, Vesely: Relative Error Streaming Quantiles, 2021.)
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparmat.session import running_totals, scratch_table


class RankSketch:
    """Mergeable sketch of numbers. ``high``: protect the upper tail, else the lower. ``k``: section size, even."""

    def __init__(self, high: bool, k: int = 32):
        self.high, self.k, self.n, self.error = high, k, 0, 0
        self.levels: list[np.ndarray] = [np.empty(0)]
        self.states: list[int] = [0]

    def _capacity(self) -> int:
        return 2 * self.k * max(2, math.ceil(math.log2(max(2.0, self.n / self.k))))

    def update(self, values: np.ndarray) -> None:
        values = np.sort(np.asarray(values, dtype=np.float64))
        pos = 0
        while pos < len(values):
            room = max(1, self._capacity() - len(self.levels[0]))
            part = values[pos : pos + room]
            pos += len(part)
            self.n += len(part)
            self.levels[0] = np.concatenate([self.levels[0], part])
            self._shrink()

    def merge(self, other: RankSketch) -> None:
        self.n += other.n
        self.error += other.error
        while len(self.levels) < len(other.levels):
            self.levels.append(np.empty(0))
            self.states.append(0)
        for h, (lev, st) in enumerate(zip(other.levels, other.states)):
            self.levels[h] = np.concatenate([self.levels[h], lev])
            self.states[h] |= st
        self._shrink()

    def _shrink(self) -> None:
        h = 0
        while h < len(self.levels):
            buf, cap = self.levels[h], self._capacity()
            if len(buf) >= cap:
                buf = np.sort(buf)
                state = self.states[h]
                ones = (~state & (state + 1)).bit_length() - 1
                size = min(cap // 2, (ones + 1) * self.k) + (len(buf) - cap)
                size -= size % 2  # pairs only: the total weight is kept
                cut, keep = (buf[:size], buf[size:]) if self.high else (buf[len(buf) - size :], buf[: len(buf) - size])
                # the coin is a hash of the counter and the level: the same for a repeated task
                coin = ((state * 2654435761 + h * 40503 + self.n) >> 7) & 1
                if h + 1 == len(self.levels):
                    self.levels.append(np.empty(0))
                    self.states.append(0)
                self.levels[h], self.states[h] = keep, state + 1
                self.error += 1 << h
                self.levels[h + 1] = np.concatenate([self.levels[h + 1], cut[coin::2]])
            h += 1

    def _ranked(self) -> tuple[np.ndarray, np.ndarray]:
        v = np.concatenate(self.levels)
        w = np.concatenate([np.full(len(x), 1 << h, dtype=np.int64) for h, x in enumerate(self.levels)])
        o = np.argsort(v, kind="stable")
        return v[o], np.cumsum(w[o])

    def value_at(self, rank: float) -> float:
        """Value whose estimated rank is the first to reach ``rank`` (1-based)."""
        v, c = self._ranked()
        return float(v[min(len(v) - 1, int(np.searchsorted(c, rank)))])

    def bracket(self, rank: int) -> tuple[float, float]:
        """Values between which the value of rank ``rank`` lies whatever the coins were.

        The rows up to a value number within ``error`` of their estimate: fewer than ``rank`` rows lie below the last value
        whose place is before rank - error, at least ``rank`` up to the first at rank + error; beyond the held values
        the bracket is open.
        """
        v, c = self._ranked()
        lo = int(np.searchsorted(c, rank - self.error)) - 1
        hi = int(np.searchsorted(c, rank + self.error))
        return float(v[lo]) if lo >= 0 else -math.inf, float(v[hi]) if hi < len(v) else math.inf

    def percentile(self, q: float) -> float:
        return self.value_at(max(1, math.ceil(round(q * self.n, 9))))

    def to_row(self) -> dict:
        return {
            "n": self.n,
            "error": self.error,
            "items": np.concatenate(self.levels),
            "sizes": np.array([len(x) for x in self.levels], dtype=np.int64),
            "states": np.array(self.states, dtype=np.int64),
        }

    @classmethod
    def from_row(cls, n, error, items, sizes, states, high: bool, k: int) -> RankSketch:
        s = cls(high, k)
        s.n, s.error = int(n), int(error)
        s.levels = [np.asarray(x, dtype=np.float64) for x in np.split(np.asarray(items, dtype=np.float64), np.cumsum(np.asarray(sizes))[:-1])]
        s.states = [int(x) for x in states]
        return s


SKETCH = "high boolean, n bigint, error bigint, items array<double>, sizes array<bigint>, states array<bigint>"


class _Group:
    """Values of one key: raw while they are few, else a sketch for either tail."""

    def __init__(self, k: int):
        self.k, self.raw, self.count, self.pair = k, [], 0, None

    def add_values(self, values: np.ndarray) -> None:
        self.raw.append(values)
        self.count += len(values)
        if self.count > 64 * self.k:  # large enough to pay for sorting
            self._fold()

    def _fold(self) -> None:
        if self.pair is None:
            self.pair = {True: RankSketch(True, self.k), False: RankSketch(False, self.k)}
        if self.raw:
            values = np.concatenate(self.raw)
            for s in self.pair.values():
                s.update(values)
        self.raw, self.count = [], 0

    def add_sketch(self, high: bool, s: RankSketch) -> None:
        self._fold()
        self.pair[high].merge(s)

    def rows(self) -> list[tuple]:
        """(high, n, error, items, sizes, states); few values are one exact row with a null ``high``."""
        if self.pair is None and self.count <= 2 * self.k:
            return [(None, self.count, 0, np.concatenate(self.raw), [self.count], [0])]
        self._fold()
        return [(h, *s.to_row().values()) for h, s in self.pair.items()]


def _batches(rows: list[tuple], names: Sequence[str], types: Sequence[pa.DataType]) -> pa.RecordBatch:
    cols = [pa.array([r[i] for r in rows], type=t) for i, t in enumerate(types)]
    at = len(types)
    cols += [pa.array([r[at + i] for r in rows], type=t) for i, t in enumerate((pa.bool_(), pa.int64(), pa.int64()))]
    for i, t in ((3, pa.float64()), (4, pa.int64()), (5, pa.int64())):
        cols.append(pa.array([r[at + i] for r in rows], type=pa.list_(t)))
    return pa.RecordBatch.from_arrays(cols, names=[*names, "high", "n", "error", "items", "sizes", "states"])


def _lists(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    col = batch.column(name)
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    off = col.offsets.to_numpy()
    return off - off[0] if len(off) else off, col.flatten().to_numpy(zero_copy_only=False)


def sketch(df: DataFrame, keys: Sequence[str], value: str, k: int = 32) -> DataFrame:
    """Sketches per key: (keys, high, n, error, items, sizes, states), two rows a key, or one exact row with a null
    ``high`` for a key of few values.

    Null and NaN values are left out; a key without values has no row; a null key is a key of its own.
    Each partition folds its rows to at most one small sketch per key and tail before anything is
    shuffled, so a key that holds most rows sends as little as any other.
    """
    src = df.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)], F.col(value).cast("double").alias("_v"))
    src = src.where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    names = [f"_k{i}" for i in range(len(keys))]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1]] + [SKETCH])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict = {}
        types: list = []
        for b in batches:
            types = [b.schema.field(n).type for n in names]
            if not len(b):
                continue
            part = pa.Table.from_batches([b]).group_by(names).aggregate([("_v", "list")]).combine_chunks()
            off, vals = _lists(part, "_v_list")
            for i, key in enumerate(zip(*[part.column(n).to_pylist() for n in names])):
                kept.setdefault(key, _Group(k)).add_values(vals[off[i] : off[i + 1]])
        if kept:
            yield _batches([(*key, *row) for key, g in kept.items() for row in g.rows()], names, types)

    return merge_sketches(src.mapInArrow(partial, schema), names, k).select(
        *[F.col(n).alias(c) for n, c in zip(names, keys)], "high", "n", "error", "items", "sizes", "states"
    )


def merge_sketches(sketches: DataFrame, keys: Sequence[str], k: int = 32) -> DataFrame:
    """Merge sketch rows (of partitions, days, ...) to one pair per key.

    Rows are hash-partitioned and sorted by key and merged as a stream, one key at a time. What a key
    shuffles is bounded by the number of its sketches, never by the rows behind them.
    """
    fields = {f.name: f.dataType.simpleString() for f in sketches.schema.fields}
    schema = ", ".join([f"`{c}` {fields[c]}" for c in keys] + [SKETCH])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, group, out, types = None, None, [], []
        for b in batches:
            types = [b.schema.field(c).type for c in keys]
            if not len(b):
                continue
            (io, items), (so, sizes), (to, states) = (_lists(b, c) for c in ("items", "sizes", "states"))
            high, n, error = (b.column(c).to_pylist() for c in ("high", "n", "error"))
            for i, key in enumerate(zip(*[b.column(c).to_pylist() for c in keys])):
                if group is None or key != last:
                    if group is not None:
                        out += [(*last, *row) for row in group.rows()]
                    last, group = key, _Group(k)
                part = items[io[i] : io[i + 1]]
                if high[i] is None:
                    group.add_values(part)
                else:
                    group.add_sketch(high[i], RankSketch.from_row(n[i], error[i], part, sizes[so[i] : so[i + 1]], states[to[i] : to[i + 1]], high[i], k))
            if len(out) > 2000:
                yield _batches(out, keys, types)
                out = []
        if group is not None:
            out += [(*last, *row) for row in group.rows()]
        if out:
            yield _batches(out, keys, types)

    rows = sketches.select(*keys, "high", "n", "error", "items", "sizes", "states")
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(merge, schema)


def sketch_percentiles(sketches: DataFrame, keys: Sequence[str], fractions: Sequence[float], k: int = 32) -> DataFrame:
    """(keys, n, fraction, percentile, low, high_value, error) from sketches.

    Fractions up to one half are read from the sketch that protects the lower tail, others from the upper. ``error``: no
    estimated rank is further off. The percentile lies between ``low`` and ``high_value``, the values at ranks moved by that.
    """
    fields = {f.name: f.dataType.simpleString() for f in sketches.schema.fields}
    schema = ", ".join([f"`{c}` {fields[c]}" for c in keys] + ["n bigint, fraction double, percentile double, low double, high_value double, error bigint"])

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                d = dict(zip(pdf.columns, r))
                few = d["high"] is None or d["high"] != d["high"]  # an exact row serves both tails
                s = RankSketch.from_row(d["n"], d["error"], d["items"], d["sizes"], d["states"], bool(d["high"]), k)
                for q in fractions:
                    if few or (q > 0.5) == s.high:
                        rank = max(1, math.ceil(round(q * s.n, 9)))
                        low, high = s.bracket(rank)
                        rows.append({c: d[c] for c in keys} | {"n": s.n, "fraction": q, "percentile": s.value_at(rank), "low": low, "high_value": high, "error": s.error})
            if rows:
                yield pd.DataFrame(rows)

    return sketches.mapInPandas(read, schema)


def exact_percentiles(df: DataFrame, keys: Sequence[str], value: str, brackets: DataFrame) -> DataFrame:
    """Exact percentiles (keys, fraction, n, percentile) from the brackets of ``sketch_percentiles`` of the same rows.

    One pass counts the rows of each bracket and those below it and keeps the values inside, compressed to distinct
    values; these alone are ranked, by running totals over range partitions, so no key is ranked within one task.
    Null and NaN values are left out, as in the sketches. A bracket that does not hold the wanted rank belongs to other rows:
    an error. ``brackets`` has one row a key and fraction; Spark broadcasts it if its size allows.
    """
    b = brackets.select(*[F.col(c).alias(f"_b{i}") for i, c in enumerate(keys)], "fraction", "low", "high_value")
    on = [F.col(c).eqNullSafe(F.col(f"_b{i}")) for i, c in enumerate(keys)]
    v = F.col(value)
    rows = df.where(v.isNotNull() & ~F.isnan(v.cast("double"))).select(*keys, v.alias("_v"))
    x = rows.join(b, on).select(F.struct(*[F.col(c).alias(c) for c in keys], F.col("fraction").alias("fraction")).alias("_k"), "_v", "low", "high_value")
    # a value inside is a group of its own; all below are one group, all above another
    zone = F.when(F.col("_v") < F.col("low"), -1).when(F.col("_v") <= F.col("high_value"), 0).otherwise(1)
    kept = x.withColumn("_z", zone).groupBy("_k", "_z", F.when(F.col("_z") == 0, F.col("_v")).alias("_v")).agg(F.count(F.lit(1)).alias("_f"))
    kept = scratch_table(kept, "brackets")
    tot = kept.groupBy("_k").agg(F.sum("_f").alias("_all"), F.sum(F.when(F.col("_z") < 0, F.col("_f")).otherwise(0)).alias("_below"), F.sum(F.when(F.col("_z") == 0, F.col("_f")).otherwise(0)).alias("_in"))
    tot = tot.withColumn("_rank", F.greatest(F.lit(1), F.ceil(F.round(F.col("_k.fraction") * F.col("_all"), 9))) - F.col("_below"))
    missed = F.raise_error(F.lit("exact_percentiles: a bracket without its percentile; brackets must come from sketches of the same rows"))
    tot = tot.withColumn("_rank", F.when((F.col("_rank") >= 1) & (F.col("_rank") <= F.col("_in")), F.col("_rank")).otherwise(missed.cast("bigint")))
    run = running_totals(kept.where("_z = 0"), ["_k", "_v"], ["_f"])
    start = run.groupBy("_k").agg(F.min(F.col("run__f") - F.col("_f")).alias("_start"))
    at = run.join(start.join(tot, "_k"), "_k").withColumn("_c", F.col("run__f") - F.col("_start"))
    return at.where((F.col("_rank") <= F.col("_c")) & (F.col("_rank") > F.col("_c") - F.col("_f"))).select(
        *[F.col("_k")[c].alias(c) for c in keys], F.col("_k.fraction").alias("fraction"), F.col("_all").alias("n"), F.col("_v").alias("percentile")
    )
