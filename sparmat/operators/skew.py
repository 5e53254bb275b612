"""Per-key results when a few keys hold most rows: value-frequency compression.

Rows are grouped by key *and value* first (partial aggregation folds a hot key to its distinct values
before any shuffle and spreads them over tasks); exact counts, sums, distinct counts, modes and
percentiles per key then come from the weighted values.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparmat.session import running_totals, scratch_table


def compress_values(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, value, freq): one row per key and distinct value. Null keys and null values are kept as such."""
    return df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("freq"))


def key_totals(weighted: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Rows, sum, distinct values and mode per key from ``compress_values``.

    Null values count as rows, not in the sum, the distinct count or the mode; a key with null values
    only has a null sum and mode. Ties of the mode go to the smallest value.
    """
    v, f = F.col(value), F.col("freq")
    return weighted.groupBy(*keys).agg(
        F.sum(f).alias("n_rows"),
        F.sum(v * f).alias("total"),
        F.count(v).alias("n_distinct"),
        F.max_by(v, F.when(v.isNotNull(), F.struct(f, -v))).alias("mode"),
    )


def key_percentiles(weighted: DataFrame, keys: Sequence[str], value: str, fractions: Sequence[float]) -> DataFrame:
    """Exact percentiles per key from ``compress_values``: (keys, fraction, percentile).

    A percentile is the smallest value that at least this share of the key's rows do not exceed. Null
    values are ignored; a key without values has no row; null keys are keys of their own.

    The weighted values are ranked by running totals over range partitions: a key with very many distinct values is
    spread over as many of them as it needs.
    """
    at = _located(weighted, keys, value, fractions, lambda q, n: F.greatest(F.lit(1), F.ceil(F.round(q * n, 9))))
    return at.select(*keys, F.col("_q").alias("fraction"), F.col(value).alias("percentile"))


def interpolated_percentiles(df: DataFrame, keys: Sequence[str], value: str, fractions: Sequence[float]) -> DataFrame:
    """(keys, q): percentiles per key with linear interpolation between neighbouring values, as an array in the order of ``fractions``.

    The same numbers as ``percentile``, without a buffer of all values of a key. Null values are ignored; a key without values has no row.
    """
    w = compress_values(df.where(F.col(value).isNotNull()), keys, value)
    place = lambda q, n: F.round(q * (n - 1), 9)
    low = _located(w, keys, value, fractions, lambda q, n: F.floor(place(q, n)) + 1, lambda q, n: F.ceil(place(q, n)) + 1)
    part = place(F.col("_q"), F.col("_n")) - F.floor(place(F.col("_q"), F.col("_n")))
    v = low.groupBy(*keys, "_q").agg(F.min(value).alias("_a"), F.max(value).alias("_b"), F.first(part).alias("_w")).withColumn("_v", F.col("_a") + F.col("_w") * (F.col("_b") - F.col("_a")))
    by_fraction = F.map_from_entries(F.collect_list(F.struct("_q", "_v")))  # one entry a fraction
    return v.groupBy(*keys).agg(by_fraction.alias("_m")).select(*keys, F.array(*[F.col("_m")[F.lit(float(q))] for q in fractions]).alias("q"))


def _located(weighted: DataFrame, keys: Sequence[str], value: str, fractions: Sequence[float], *ranks: Callable[[Column, Column], Column]) -> DataFrame:
    """(keys, _q, _n, value): the values at the given ranks of each fraction q among the n rows of a key."""
    w = scratch_table(weighted.where(F.col(value).isNotNull()).select(*keys, value, "freq"), "weighted")  # small against the rows, read three times
    run = running_totals(w, [value], ["freq"], keys)
    n = w.groupBy(*keys).agg(F.sum("freq").alias("_n")).select(*[F.col(k).alias(f"_b{i}") for i, k in enumerate(keys)], "_n")
    run = run.join(n, [F.col(k).eqNullSafe(F.col(f"_b{i}")) for i, k in enumerate(keys)] or F.lit(True)).drop(*[f"_b{i}" for i in range(len(keys))])
    inside = lambda q: reduce(lambda a, b: a | b, [(f(q, F.col("_n")) > F.col("run_freq") - F.col("freq")) & (f(q, F.col("_n")) <= F.col("run_freq")) for f in ranks])
    hit = F.array_compact(F.array(*[F.when(inside(F.lit(float(q))), F.lit(float(q))) for q in fractions]))
    return run.withColumn("_q", F.explode(hit)).select(*keys, "_q", "_n", value)


def heavy_keys(totals: DataFrame, measures: Sequence[str], share: float) -> DataFrame:
    """Keys that hold at least ``share`` of the whole in any of ``measures`` (columns of ``totals``).

    The wholes are scalar subqueries over the same aggregate, so the per-key table is shuffled once.
    """
    cond = F.lit(False)
    for m in measures:
        whole = totals.agg(F.sum(m).alias("whole")).scalar()
        cond = cond | (F.col(m) >= F.lit(Decimal(str(share))) * whole)
    return totals.where(cond)
