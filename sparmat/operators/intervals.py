"""Continuous periods and gaps of overlapping intervals, without one task per entity.

Method: sort by start per entity, compare each start with the running maximum of the previous ends,
label the islands cumulatively, aggregate them to periods and derive the gaps. The sort is done per
(entity, bucket of start); what reaches over a bucket's end is stitched on a second level that holds at
most two rows per bucket, so the largest group in a task is bounded by the bucket's width and by the
number of buckets of an entity, never by the rows of an entity.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BEFORE = (Window.unboundedPreceding, -1)


def _islands(df: DataFrame, part: Sequence[str]) -> DataFrame:
    """The plain method within ``part``: rows (_k, [_b], _s, _e) to islands; ``_prev`` is the running maximum before."""
    w = Window.partitionBy(*part).orderBy("_s", "_e")
    label = Window.partitionBy(*part).orderBy("_s", "_e").rowsBetween(Window.unboundedPreceding, 0)
    return (
        df.withColumn("_prev", F.max("_e").over(w.rowsBetween(*BEFORE)))
        .withColumn("_new", F.when(F.col("_prev").isNull() | (F.col("_s") > F.col("_prev")), 1).otherwise(0))
        .withColumn("_isl", F.sum("_new").over(label))
        .groupBy(*part, "_isl")
        .agg(
            F.min("_s").alias("_s"),
            F.max("_e").alias("_e"),
            F.max(F.when(F.col("_new") == 1, F.col("_prev"))).alias("_prev"),
            F.max(F.when(F.col("_new") == 1, F.col("_pmin"))).alias("_pmin"),
        )
    )


def merge_intervals(
    df: DataFrame,
    keys: Sequence[str],
    start: str | Column = "start",
    end: str | Column = "end",
    bucket_width: int = 1 << 16,
) -> DataFrame:
    """Periods and gaps of half-open integer intervals per entity.

    Returns ``keys``, ``kind`` ('period' or 'gap'), ``left_pos``, ``right_pos``. Touching intervals are
    one period. Rows with a null start or end, or with start >= end, cover nothing and are ignored; null
    keys are entities of their own; repeated rows change nothing; an empty table gives an empty result;
    other columns of ``df`` are ignored whatever their names. ``bucket_width`` is in units of the
    positions (bases, or e.g. microseconds per hour for times).
    """
    s = F.col(start) if isinstance(start, str) else start
    e = F.col(end) if isinstance(end, str) else end
    rows = (
        df.select(F.struct(*[F.col(k).alias(k) for k in keys]).alias("_k"), s.cast("bigint").alias("_s"), e.cast("bigint").alias("_e"))
        .where("_s < _e")
        # pre-aggregation: at most bucket_width rows remain per bucket, however often a start repeats
        .groupBy("_k", F.floor(F.col("_s") / F.lit(bucket_width)).alias("_b"), "_s")
        .agg(F.max("_e").alias("_e"))
        .withColumn("_pmin", F.lit(None).cast("bigint"))
    )
    local = _islands(rows, ["_k", "_b"]).select("_k", "_b", "_s", "_e", "_prev")
    carried = local.groupBy("_k", "_b").agg(F.max("_e").alias("_top"))
    carried = carried.select(
        "_k", "_b", F.max("_top").over(Window.partitionBy("_k").orderBy("_b").rowsBetween(*BEFORE)).alias("_carry")
    )
    seg = (
        local.join(carried, ["_k", "_b"])
        .where(F.col("_carry").isNull() | (F.col("_e") > F.col("_carry")))  # else covered by an earlier bucket
        .withColumn("_joins", F.coalesce(F.col("_s") <= F.col("_carry"), F.lit(False)))
        .withColumn("_reaches", F.col("_e") >= (F.col("_b") + 1) * bucket_width)
        .withColumn("_gap", F.when(~F.col("_joins"), F.greatest("_carry", "_prev")))
    )
    inner = seg.where(~F.col("_joins") & ~F.col("_reaches")).select("_k", "_s", "_e", F.col("_gap").alias("_pmin"))
    edge = seg.where(F.col("_joins") | F.col("_reaches")).select("_k", "_s", "_e", F.col("_gap").alias("_pmin"))
    stitched = _islands(edge, ["_k"]).select("_k", "_s", "_e", "_pmin")
    return (
        inner.unionByName(stitched)
        .select(
            "_k",
            F.inline(
                F.array_compact(
                    F.array(
                        F.struct(F.lit("period").alias("kind"), F.col("_s").alias("left_pos"), F.col("_e").alias("right_pos")),
                        F.when(
                            F.col("_pmin").isNotNull(),
                            F.struct(F.lit("gap").alias("kind"), F.col("_pmin").alias("left_pos"), F.col("_s").alias("right_pos")),
                        ),
                    )
                )
            ),
        )
        .select(*[F.col("_k")[k].alias(k) for k in keys], "kind", "left_pos", "right_pos")
    )


def period_summary(merged: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Covered length, number of periods, gap length and longest gap per entity, from ``merge_intervals``.

    An entity with one period has gap length 0 and a null longest gap.
    """
    length = F.col("right_pos") - F.col("left_pos")
    period, gap = F.col("kind") == "period", F.col("kind") == "gap"
    return merged.groupBy(*keys).agg(
        F.count(F.when(period, 1)).alias("n_periods"),
        F.sum(F.when(period, length).otherwise(0)).alias("covered"),
        F.sum(F.when(gap, length).otherwise(0)).alias("gap_total"),
        F.max(F.when(gap, length)).alias("longest_gap"),
    )
