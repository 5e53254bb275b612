"""Normalisation, element-wise maths and variable selection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparmat.model import Matrix
from sparmat.session import running_totals


def normalize_total(m: Matrix, target: float | None = None) -> DataFrame:
    """value x target / total of the observation; ``target`` defaults to the mean total of observations with entries; 0 for an observation of total 0."""
    t = m.entries.groupBy("obs_id").agg(F.sum("value").alias("t"))
    goal = F.lit(target) if target is not None else t.agg(F.avg("t").alias("x")).scalar()
    return m.entries.join(t, "obs_id").select("obs_id", "var_id", F.coalesce(F.try_divide(F.col("value") * goal, "t"), F.lit(0.0)).alias("value"))


def log1p(entries: DataFrame) -> DataFrame:
    return entries.withColumn("value", F.log1p("value"))


def clr(m: Matrix) -> DataFrame:
    """log1p(value / exp(mean(log1p(value)))) per observation, zeros in the mean."""
    n = m.var.agg(F.count(F.lit(1)).alias("n")).scalar()
    g = m.entries.groupBy("obs_id").agg((F.sum(F.log1p("value"))).alias("s"))
    return m.entries.join(g, "obs_id").select("obs_id", "var_id", F.log1p(F.col("value") / F.exp(F.try_divide("s", n))).alias("value"))


def zscore_params(m: Matrix) -> DataFrame:
    """(var_id, mean, sd): population moments over all observations; a z-score is (value - mean) / sd, also of zeros."""
    n = m.obs.agg(F.count(F.lit(1)).alias("n")).scalar()
    s = m.entries.groupBy("var_id").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"))
    mean = F.col("s") / n
    return s.select("var_id", mean.alias("mean"), F.sqrt(F.greatest(F.lit(0.0), F.col("q") / n - mean * mean)).alias("sd"))


def zscore(m: Matrix) -> DataFrame:
    """z-scores of the entries; what the absent ones have is ``-mean / sd`` of ``zscore_params`` and is not materialised."""
    p = zscore_params(m)
    return m.entries.join(p, "var_id").select("obs_id", "var_id", F.when(F.col("sd") > 0, (F.col("value") - F.col("mean")) / F.col("sd")).otherwise(0.0).alias("value"))


def normalize_rows(entries: DataFrame, by: str) -> DataFrame:
    """value / (sum over ``by`` + 1e-5)."""
    t = entries.groupBy(by).agg(F.sum("value").alias("t"))
    return entries.join(t, by).select("obs_id", "var_id", (F.col("value") / (F.col("t") + 1e-5)).alias("value"))


def dispersion_bins(m: Matrix, bins: int = 20) -> DataFrame:
    """Variable selection by binned dispersion: mean, dispersion (var / mean), bin of equal width in the mean, and the
    dispersion's z-score in its bin (population sd; a bin of one variable has z 1). A variable of mean 0 has dispersion 0."""
    n = m.obs.agg(F.count(F.lit(1)).alias("n")).scalar()
    s = m.entries.groupBy("var_id").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"))
    mean = F.col("s") / n
    s = s.select("var_id", mean.alias("mean"), F.coalesce(F.try_divide(F.col("q") / n - mean * mean, mean), F.lit(0.0)).alias("disp"))
    edge = s.agg(F.min("mean").alias("lo"), F.max("mean").alias("hi"))
    lo, hi = edge.select("lo").scalar(), edge.select("hi").scalar()
    s = s.withColumn("bin", F.least(F.lit(bins - 1), F.floor((F.col("mean") - lo) / F.when(hi > lo, hi - lo).otherwise(1.0) * bins)).cast("int"))
    b = s.groupBy("bin").agg(F.avg("disp").alias("m"), F.stddev_pop("disp").alias("sd"), F.count(F.lit(1)).alias("k"))
    return s.join(b, "bin").select("var_id", "mean", "disp", "bin", F.when((F.col("k") == 1) | (F.col("sd") == 0), 1.0).otherwise((F.col("disp") - F.col("m")) / F.col("sd")).alias("disp_norm"))


def top_rows(df: DataFrame, order, n: int) -> DataFrame:
    """The n first rows of a total order: a distributed top-k (each partition keeps n)."""
    return df.orderBy(*order).limit(n)


def stable_variables(m: Matrix, n: int, detection: float) -> DataFrame:
    """The n variables of the highest mean / sd of log1p values among those detected in more than ``detection`` of the observations.
    A constant variable has no signal and is left out."""
    total = m.obs.agg(F.count(F.lit(1)).alias("n")).scalar()
    l = F.log1p("value")  # noqa: E741
    s = m.entries.groupBy("var_id").agg(F.count(F.lit(1)).alias("d"), F.sum(l).alias("s"), F.sum(l * l).alias("q"))
    mean = F.col("s") / total
    sd = F.sqrt(F.greatest(F.lit(0.0), F.col("q") / total - mean * mean))
    s = s.where(F.col("d") > detection * total).select("var_id", F.round(F.try_divide(mean, sd), 9).alias("signal")).where("signal IS NOT NULL")
    return top_rows(s, [F.col("signal").desc(), "var_id"], n)


def top_accessible(entries: DataFrame, lower: float, upper: float, n: int) -> DataFrame:
    """Variables by total: the lower and upper share by rank are cut, the n largest of the rest are kept."""
    t = entries.groupBy("var_id").agg(F.sum("value").alias("total")).where("total > 0")
    k = running_totals(t.withColumn("one", F.lit(1)), ["total", "var_id"], ["one"]).withColumnRenamed("run_one", "r")
    size = t.agg(F.count(F.lit(1)).alias("x")).scalar()
    kept = k.where((F.col("r") > F.floor(lower * size)) & (F.col("r") <= size - F.floor(upper * size)))
    return top_rows(kept.select("var_id", "total"), [F.col("total").desc(), "var_id"], n)
