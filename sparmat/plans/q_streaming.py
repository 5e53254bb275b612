"""Streaming queries, run to the end of the available data."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparmat.functions.text import chrom_label
from sparmat.session import table
from sparmat.streaming import counts as C


def _stream(s, d, name):
    return s.readStream.schema(table(s, d, name).schema).parquet(f"{d}/{name}.parquet*")


def stream_tiles(s, d):
    names = table(s, d, "chrom_sizes").select(F.col("chrom").alias("_c"), chrom_label(F.col("chrom")).alias("_l"))
    f = _stream(s, d, "fragment").where("0 <= start AND start < end").withColumn("_l", chrom_label(F.col("chrom"))).join(names, "_l")
    return C.run_to_end(C.tile_counts(f.select("sample", F.col("_c").alias("chrom"), "start", "end", "strand"), "sample", 5000), "update", ["sample", "chrom", "tile"])


def _events(s, d):
    return _stream(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def stream_windows(s, d):
    got = C.run_to_end(C.window_counts(_events(s, d), "ts", "event_type", "value", "6 hours", "1 day"), "update", ["start", "event_type"])
    return got.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 6).alias("total"))


def stream_sessions(s, d):
    got = C.run_to_end(C.session_counts(_events(s, d), "ts", "user_id", "30 minutes", "1 day"), "complete")
    return got.select(F.col("start").cast("timestamp_ntz").alias("start"), "user_id", "n")


def stream_first_versions(s, d):
    """Each fragment once, the first that arrives."""
    f = _stream(s, d, "fragment").withColumn("loaded_at", F.col("loaded_at").cast("timestamp")).select("frag_id", "loaded_at")
    return C.run_to_end(C.first_versions(f, "frag_id", "loaded_at", "30 days").select("frag_id"), "append")


QUERIES = {f.__name__: f for f in (stream_tiles, stream_windows, stream_sessions, stream_first_versions)}

from sparmat.plans.q_genome import B  # noqa: E402

ORACLE = {
    "stream_first_versions": "SELECT DISTINCT frag_id FROM fragment",
    "stream_tiles": B + "SELECT sample, chrom, pos // 5000 AS tile, count(*) AS n FROM ins GROUP BY ALL",
    "stream_windows": "SELECT time_bucket(INTERVAL 6 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2",
    "stream_sessions": """WITH l AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM l) SELECT min(ts) AS start, user_id, count(*) AS n FROM g GROUP BY user_id, g""",
}
