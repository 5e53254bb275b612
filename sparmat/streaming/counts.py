"""Structured Streaming forms: incremental tile counts, event-time windows, sessions, current versions."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparmat.operators.genome import insertions
from sparmat.session import scratch_dir


def tile_counts(frags: DataFrame, by: str, width: int) -> DataFrame:
    """Insertions per (by, chrom, tile); state is one counter a tile. Works on streams and on tables."""
    return insertions(frags).groupBy(by, "chrom", F.floor(F.col("pos") / width).alias("tile")).agg(F.count(F.lit(1)).alias("n"))


def window_counts(events: DataFrame, time: str, key: str, value: str, length: str, late: str) -> DataFrame:
    """Tumbling event-time windows: rows and sum per key; rows later than the watermark are left out."""
    w = events.withWatermark(time, late).groupBy(F.window(time, length), key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return w.select(F.col("window.start").alias("start"), key, "n", "total")


def session_counts(events: DataFrame, time: str, key: str, gap: str, late: str) -> DataFrame:
    """Sessions per key: rows whose gaps are shorter than ``gap``."""
    s = events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return s.select(F.col("w.start").alias("start"), key, "n")


def first_versions(rows: DataFrame, key: str, time: str, late: str) -> DataFrame:
    """Each key once, the first that arrives; repeats within the watermark are dropped and their state forgotten after it."""
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def run_to_end(stream: DataFrame, mode: str, keys: Sequence[str] = ()) -> DataFrame:
    """Run an available-now stream to its end into the shared folder and read the result.

    'append' adds final rows; 'update' adds the rows that a batch changed, of which the last of each of ``keys`` counts (the state of
    windows behind the watermark is dropped); 'complete' rewrites the result with each batch, for what has no update mode.
    Progress is checkpointed, so a restarted driver goes on where it stopped; a repeated batch replaces its own rows.
    """
    spark = stream.sparkSession
    base = f"{scratch_dir(spark)}/stream-{uuid.uuid4().hex}"
    w = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/progress").trigger(availableNow=True)
    if mode == "append":
        q = w.format("parquet").option("path", f"{base}/rows").start()
    elif mode == "update":
        q = w.foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(f"{base}/rows/batch={i}")).start()
        q.awaitTermination()
        rows = spark.read.option("basePath", f"{base}/rows").parquet(f"{base}/rows/*")
        last = rows.groupBy(*keys).agg(F.max("batch").alias("batch"))
        named = last.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("batch").alias("_b"))
        on = [F.col("batch") == F.col("_b"), *[F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]]
        return rows.join(named, on).select(*stream.columns)
    else:
        q = w.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{base}/rows")).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/rows")
