"""Joins in time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def asof_join(left: DataFrame, right: DataFrame, by: str, time: str, columns: Sequence[str], bucket_seconds: int = 86_400) -> DataFrame:
    """(columns of ``left``, ``columns``): each left row with the latest right row of its key at or before its time.

    Rows are ordered within (key, bucket of time); what an earlier bucket leaves behind is carried on over one row a bucket,
    so a key that holds most rows is spread over its buckets. Of right rows of one key and time the largest by ``columns``
    counts; a left row without an earlier right row has nulls; null keys meet none, rows without a time are kept with nulls.
    """
    new = F.max(F.struct(*[F.col(c).alias(c) for c in columns])).alias("_r")
    r = right.where(F.col(by).isNotNull() & F.col(time).isNotNull()).groupBy(F.col(by).alias("_k"), F.col(time).alias("_t")).agg(new)
    side = left.select(F.col(by).alias("_k"), F.col(time).alias("_t"), F.struct(*[F.col(c).alias(c) for c in left.columns]).alias("_l"))
    u = side.withColumn("_s", F.lit(1)).unionByName(r.withColumn("_s", F.lit(0)), allowMissingColumns=True)
    u = u.withColumn("_b", F.floor(F.unix_micros(F.col("_t").cast("timestamp")) / (bucket_seconds * 1_000_000)))
    upto = Window.partitionBy("_k", "_b").orderBy("_t", "_s").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = u.withColumn("_in", F.last("_r", ignorenulls=True).over(upto)).where("_s = 1")
    last = u.where("_b IS NOT NULL").groupBy("_k", "_b").agg(F.max_by("_r", F.when(F.col("_s") == 0, F.col("_t"))).alias("_top"))
    before = Window.partitionBy("_k").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carry = last.select(F.col("_k").alias("_k2"), F.col("_b").alias("_b2"), F.last("_top", ignorenulls=True).over(before).alias("_carry"))
    got = rows.join(carry, (F.col("_k") == F.col("_k2")) & (F.col("_b") == F.col("_b2")), "left")
    hit = F.when(F.col("_t").isNotNull() & F.col("_k").isNotNull(), F.coalesce("_in", "_carry"))
    return got.select("_l.*", hit.alias("_hit")).select(*left.columns, *[F.col("_hit")[c].alias(c if c not in left.columns else f"{c}_right") for c in columns])
