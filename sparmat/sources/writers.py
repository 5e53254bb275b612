"""Writers: experiments, fragments, tracks, gene sets, matrices. All write from the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparmat.session import ranked, scratch_table


def write_table(df: DataFrame, path: str, partition_by: tuple[str, ...] = ("modality", "sample")) -> None:
    """Parquet partitioned by those of the columns that exist; reads of one sample prune the others."""
    cols = [c for c in partition_by if c in df.columns]
    (df.write.partitionBy(*cols) if cols else df.write).mode("overwrite").parquet(path)


def write_metadata(df: DataFrame, path: str) -> None:
    df.fillna(".").coalesce(1).write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)  # a few rows


def export_fragments(frags: DataFrame, path: str, group: str, min_size: int = 0, max_size: int = 1 << 40, compression: str = "gzip") -> None:
    """One folder of tab-separated files per group, filtered by size; text codecs are those of the Hadoop build (zstd needs its native library); the missing count is 1, the missing strand '.'."""
    size = F.col("end") - F.col("start")
    d = frags.where(size.between(min_size, max_size)).select(group, "chrom", "start", "end", F.coalesce("barcode", F.lit(".")).alias("barcode"), F.coalesce("count", F.lit(1)).alias("count"), F.coalesce("strand", F.lit(".")).alias("strand"))
    d.write.partitionBy(group).mode("overwrite").option("sep", "\t").option("compression", compression).csv(path)


def export_bedgraph(track: DataFrame, path: str, group: str | None = None, compression: str = "gzip") -> None:
    """bedGraph files sorted by position within each file (range-partitioned by chromosome and start)."""
    keys = ([group] if group else []) + ["chrom", "start"]
    w = track.repartitionByRange(*keys).sortWithinPartitions(*keys).write
    (w.partitionBy(group) if group else w).mode("overwrite").option("sep", "\t").option("compression", compression).csv(path)


def write_gmt(members: DataFrame, path: str) -> None:
    """(set, description, gene) to GMT lines; a set's members form one line, as the format asks."""
    g = members.groupBy("set").agg(F.first("description").alias("d"), F.array_sort(F.collect_set("gene")).alias("g"))
    g.select(F.concat_ws("\t", "set", F.coalesce("d", F.lit("na")), F.array_join("g", "\t")).alias("value")).write.mode("overwrite").text(path)


def write_mtx(entries: DataFrame, obs: DataFrame, var: DataFrame, path: str) -> None:
    """10x-like folder: matrix.mtx, barcodes.tsv and features.tsv as folders of text parts, rows numbered by name.

    Names are numbered by range partitions; the files are written in the same order. Entries of names that ``obs`` or
    ``var`` lack are left out, and zeros.
    """
    o = ranked(obs.select("obs_id").distinct(), [], ["obs_id"], "j")
    v = ranked(var.select("var_id").distinct(), [], ["var_id"], "i")
    t = scratch_table(entries.where("value <> 0").join(o, "obs_id").join(v, "var_id").select("i", "j", "value"), "mtx")
    body = t.orderBy("j", "i").select(F.concat_ws(" ", F.col("i").cast("string"), F.col("j").cast("string"), F.col("value").cast("string")).alias("value"))
    spark = entries.sparkSession
    head = spark.createDataFrame([("%%MatrixMarket matrix coordinate real general",), (f"{v.count()} {o.count()} {t.count()}",)], "value string").coalesce(1)
    head.unionByName(body).write.mode("overwrite").text(f"{path}/matrix.mtx")
    o.orderBy("j").select(F.col("obs_id").cast("string")).write.mode("overwrite").text(f"{path}/barcodes.tsv")
    v.orderBy("i").select(F.col("var_id").cast("string")).write.mode("overwrite").text(f"{path}/features.tsv")


def load_table(spark: SparkSession, path: str, **equal) -> DataFrame:
    """A written table, restricted to partitions or values, e.g. ``sample='s1'`` or ``sample=['s1', 's2']``."""
    d = spark.read.parquet(path)
    for c, v in equal.items():
        d = d.where(F.col(c).isin(*v) if isinstance(v, (list, tuple, set)) else F.col(c) == v)
    return d
