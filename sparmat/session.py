"""Session helpers: test session, shared scratch folder, table access, current versions."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def local_session(cores: int = 8, shuffle_partitions: int | None = None, app: str = "sparmat") -> SparkSession:
    """A local session for tests and the benchmark."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``).

    A local master may go without one (tests on one machine): a temporary folder is set then. Elsewhere its absence is an error,
    since a folder of one machine would lose what the executors of the others write.
    """
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        conf = tempfile.mkdtemp(prefix="sparmat-")
        spark.conf.set("spark.checkpoint.dir", conf)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(conf)
    return conf


def scratch_dir(spark: SparkSession) -> str:
    """This application's folder below the shared one. It is removed when the driver's JVM ends, or by ``drop_scratch``."""
    path = f"{shared_dir(spark).rstrip('/')}/sparmat-{spark.sparkContext.applicationId}"
    if path not in _OWNED:
        _OWNED.add(path)
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(where)
        fs.deleteOnExit(where)
    return path


_OWNED: set[str] = set()


def drop_scratch(spark: SparkSession) -> None:
    """Remove what this application has written to its scratch folder; results that still read from it must be stored before."""
    path = scratch_dir(spark)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    _OWNED.discard(path)


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder; survives the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_table(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and read it back (columnar, survives executor loss)."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def current(df: DataFrame, keys: Sequence[str], version: str = "loaded_at") -> DataFrame:
    """Current row per key: the row with the latest ``version``.

    Null versions are the oldest. Rows that tie on the version are ordered by a hash of all their
    columns, so the choice does not depend on the order of arrival; a null key is a key of its own.
    """
    w = Window.partitionBy(*keys).orderBy(F.col(version).desc_nulls_last(), F.xxhash64(*[F.col(c) for c in df.columns]))
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def running_totals(df: DataFrame, order: Sequence, values: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Adds ``run_<value>``: running sums over a total order of the whole table, without one task for all rows.

    Rows are range-partitioned by the order and written with their partition's number (so that both uses below see
    the same partitions), summed up within a partition, and raised by the totals of the earlier ones (one row a partition).
    Rows that tie in ``order`` get their sums in an arbitrary order: make it a total one. With ``keys`` the sums start anew
    with every key (a null key is one of its own); a key that holds most rows is spread over many partitions all the same.
    """
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    by = [F.col(k) for k in keys]
    parts = scratch_table(df.repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    upto = Window.partitionBy("_part", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = parts.groupBy("_part", *by).agg(*[F.sum(v).alias(f"_t_{v}") for v in values])
    on = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    sums = sums.select(F.col("_part").alias("_p"), *on, *[F.coalesce(F.sum(f"_t_{v}").over(before), F.lit(0)).alias(f"_o_{v}") for v in values])
    same = [F.col("_part") == F.col("_p"), *[F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]]
    out = parts.withColumns({f"run_{v}": F.sum(v).over(upto) for v in values}).join(sums, same)
    return out.withColumns({f"run_{v}": F.col(f"run_{v}") + F.col(f"_o_{v}") for v in values}).drop("_part", "_p", *[f"_k{i}" for i in range(len(keys))], *[f"_o_{v}" for v in values])


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence, into: str = "rank", size: str | None = None) -> DataFrame:
    """Adds the place (from 1) of each row of a key in a total order, and with ``size`` the rows of the key; no key is ordered in one task."""
    out = running_totals(df.withColumn("_one", F.lit(1)), order, ["_one"], keys).withColumnRenamed("run__one", into).drop("_one")
    if size is None:
        return out
    if not keys:
        return out.withColumn(size, df.agg(F.count(F.lit(1)).alias("n")).scalar())
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(size))
    n = n.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], size)
    return out.join(n, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]).drop(*[f"_k{i}" for i in range(len(keys))])
