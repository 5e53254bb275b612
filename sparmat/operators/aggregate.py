"""Zero-aware aggregation, summaries and quality control of long matrices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparmat.model import Matrix
from sparmat.operators.skew import interpolated_percentiles
from sparmat.session import running_totals, scratch_table


def pseudobulk(m: Matrix, by: str, quantiles: bool = False) -> DataFrame:
    """Per (group of observations, variable): detections, N, sum, mean, variance (population), zeros included.

    N comes from the obs table; groups are joined to entries by the observation. Variables without an
    entry in a group have no row (their statistics are 0). With ``quantiles`` the median is added: the
    N - nnz implicit zeros take part as one weighted value, so nothing is densified.
    """
    n = m.obs.groupBy(by).agg(F.count(F.lit(1)).alias("n_obs"))
    e = m.entries.join(m.obs.select("obs_id", by), "obs_id")
    s = e.groupBy(by, "var_id").agg(F.count(F.lit(1)).alias("n_detected"), F.sum("value").alias("sum_v"), F.sum(F.col("value") * F.col("value")).alias("sq"))
    mean = F.col("sum_v") / F.col("n_obs")
    out = s.join(n, by)
    cols = [by, "var_id", "n_detected", "n_obs", "sum_v", mean.alias("mean_v"), (F.col("sq") / F.col("n_obs") - mean * mean).alias("var_v")]
    if not quantiles:
        return out.select(*cols)
    weighted = e.groupBy(by, "var_id", "value").agg(F.count(F.lit(1)).alias("f"))
    zeros = out.select(by, "var_id", F.lit(0.0).alias("value"), (F.col("n_obs") - F.col("n_detected")).alias("f")).where("f > 0")
    q = weighted.unionByName(zeros).groupBy(by, "var_id").agg(F.percentile("value", [0.25, 0.5, 0.75], F.col("f")).alias("q"))
    return out.select(*cols).join(q, [by, "var_id"]).withColumns(
        {"median_v": F.col("q")[1], "trimean_v": (F.col("q")[0] + 2 * F.col("q")[1] + F.col("q")[2]) / 4}
    ).drop("q")


def aggregate_var(m: Matrix, by: str) -> DataFrame:
    """Per (observation, group of variables): sum and mean over all variables of the group."""
    n = m.var.groupBy(by).agg(F.count(F.lit(1)).alias("n_var"))
    s = m.entries.join(m.var.select("var_id", by), "var_id").groupBy("obs_id", by).agg(F.sum("value").alias("sum_v"))
    return s.join(n, by).select("obs_id", by, "sum_v", (F.col("sum_v") / F.col("n_var")).alias("mean_v"))


def aggregate_block(m: Matrix, obs_by: str, var_by: str) -> DataFrame:
    """Per block (observation group x variable group): sum and mean over all n_obs x n_var cells."""
    no = m.obs.groupBy(obs_by).agg(F.count(F.lit(1)).alias("n_obs"))
    nv = m.var.groupBy(var_by).agg(F.count(F.lit(1)).alias("n_var"))
    s = (
        m.entries.join(m.obs.select("obs_id", obs_by), "obs_id").join(m.var.select("var_id", var_by), "var_id").groupBy(obs_by, var_by).agg(F.sum("value").alias("sum_v"))
    )
    return s.join(no, obs_by).join(nv, var_by).select(obs_by, var_by, "sum_v", (F.col("sum_v") / (F.col("n_obs") * F.col("n_var"))).alias("mean_v"))


def grouped_rates(m: Matrix, by: str, length: Column) -> DataFrame:
    """Per (group, variable): reads per million and per kilobase and million (``length`` in bases, from var); null for a total or a length of 0."""
    s = m.entries.join(m.obs.select("obs_id", by), "obs_id").groupBy(by, "var_id").agg(F.sum("value").alias("v"))
    total = s.groupBy(by).agg(F.sum("v").alias("t"))
    rpm = F.try_divide("v", "t") * 1e6
    return s.join(total, by).join(m.var.select("var_id", length.alias("len")), "var_id").select(by, "var_id", rpm.alias("rpm"), F.try_divide(rpm, F.col("len") / 1000).alias("rpkm"))


def summary_cube(df: DataFrame, on: str, across: str, split: str) -> DataFrame:
    """Counts of on x across x split with all margins; an absent axis is the category '.all'."""
    name = lambda c: F.when(F.grouping(c) == 1, ".all").otherwise(F.coalesce(F.col(c).cast("string"), F.lit("na"))).alias(c)
    return df.cube(on, across, split).agg(F.count(F.lit(1)).alias("n"), *[F.grouping(c).alias(f"_{c}") for c in (on, across, split)]).select(
        *[F.when(F.col(f"_{c}") == 1, ".all").otherwise(F.coalesce(F.col(c).cast("string"), F.lit("na"))).alias(c) for c in (on, across, split)], "n"
    )


def crosstab(df: DataFrame, major: str, minor: str, normalize: str) -> DataFrame:
    """Share of each (major, minor) pair of rows: of its minor ('columns'), its major ('index') or all rows ('all')."""
    n = df.groupBy(major, minor).agg(F.count(F.lit(1)).alias("n"))
    if normalize == "all":
        return n.select(major, minor, "n", (F.col("n") / df.agg(F.count(F.lit(1)).alias("x")).scalar()).alias("share"))
    key = minor if normalize == "columns" else major
    return n.join(df.groupBy(key).agg(F.count(F.lit(1)).alias("t")), key).select(major, minor, "n", (F.col("n") / F.col("t")).alias("share"))


def mode_by(df: DataFrame, key: str, value: str) -> DataFrame:
    """Most frequent non-null value per key, ties to the smallest."""
    c = df.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))
    best = c.groupBy(key).agg(F.max("n").alias("n"))
    return c.join(best, [key, "n"]).groupBy(key).agg(F.min(value).alias(value))


def qc_metrics(m: Matrix, marked: Column) -> DataFrame:
    """Per observation: total, detected variables, total of the ``marked`` variables and its share (0 without entries)."""
    e = m.entries.join(m.var.select("var_id", marked.alias("_m")), "var_id").groupBy("obs_id").agg(
        F.sum("value").alias("total"), F.count(F.when(F.col("value") > 0, 1)).alias("detected"), F.sum(F.when(F.col("_m"), F.col("value")).otherwise(0.0)).alias("marked")
    )
    out = m.obs.select("obs_id").join(e, "obs_id", "left").fillna(0, ["total", "detected", "marked"])
    return out.withColumn("pct_marked", F.when(F.col("total") > 0, F.col("marked") / F.col("total")).otherwise(0.0))


def outlier_bounds(df: DataFrame, by: str, value: str, method: str, n: float) -> DataFrame:
    """(by, low, high): median -/+ n MAD ('mad'), or Q1 - n IQR and Q3 + n IQR ('tukey'), quantiles interpolated linearly."""
    q = interpolated_percentiles(df, [by], value, [0.25, 0.5, 0.75])
    if method == "tukey":
        iqr = F.col("q")[2] - F.col("q")[0]
        return q.select(by, (F.col("q")[0] - n * iqr).alias("low"), (F.col("q")[2] + n * iqr).alias("high"))
    med = q.select(by, F.col("q")[1].alias("med"))
    med = scratch_table(med, "medians")  # one row a group
    off = df.join(med, by).select(by, F.abs(F.col(value) - F.col("med")).alias("_off"))
    mad = interpolated_percentiles(off, [by], "_off", [0.5]).select(by, F.col("q")[0].alias("mad")).join(med, by)
    return mad.select(by, (F.col("med") - n * F.col("mad")).alias("low"), (F.col("med") + n * F.col("mad")).alias("high"))


def flag_outliers(df: DataFrame, by: str, value: str, method: str, n: float) -> DataFrame:
    return df.join(outlier_bounds(df, by, value, method, n), by).withColumn("outlier", (F.col(value) < F.col("low")) | (F.col(value) > F.col("high"))).drop("low", "high")


def entropy(df: DataFrame, by: Sequence[str], count: str) -> DataFrame:
    """Shannon entropy in bits of ``count`` within ``by``, and the number of categories and the total."""
    t = df.groupBy(*by).agg(F.sum(count).alias("total"), F.count(F.lit(1)).alias("k"), F.sum(F.when(F.col(count) > 0, F.col(count) * F.log2(count)).otherwise(0.0)).alias("s"))
    return t.select(*by, "total", "k", F.coalesce(F.log2("total") - F.try_divide("s", "total"), F.lit(0.0)).alias("entropy"))


def clone_matrix(df: DataFrame, clone: str, cluster: str) -> DataFrame:
    return df.where(F.col(clone).isNotNull()).groupBy(clone, cluster).agg(F.count(F.lit(1)).alias("n"))


def expansion(counts: DataFrame, clone: str, cluster: str, least: int = 5) -> DataFrame:
    """1 - H / log2(k) of the clone sizes of a cluster; 0 for fewer than ``least`` cells or one clone."""
    e = entropy(counts, [cluster], "n")
    return e.select(cluster, F.when((F.col("total") < least) | (F.col("k") < 2), 0.0).otherwise(1 - F.col("entropy") / F.log2("k")).alias("expansion"))


def plasticity(counts: DataFrame, clone: str, cluster: str, least: int = 5) -> DataFrame:
    """Entropy over clusters of the mean row-normalised profile of the clones present in a cluster; 0 for fewer than ``least`` cells."""
    total = counts.groupBy(clone).agg(F.sum("n").alias("t"))
    share = counts.join(total, clone).select(clone, F.col(cluster).alias("other"), (F.col("n") / F.col("t")).alias("p"))
    per = counts.select(clone, cluster).join(share, clone).groupBy(cluster, "other").agg(F.sum("p").alias("p"))
    cells = counts.groupBy(cluster).agg(F.sum("n").alias("_n"))
    return entropy(per, [cluster], "p").join(cells, cluster).select(cluster, F.when(F.col("_n") < least, 0.0).otherwise(F.col("entropy")).alias("plasticity"))


def pairwise_transition(counts: DataFrame, clone: str, cluster: str, base: str) -> DataFrame:
    """Size-weighted mean binary entropy between ``base`` and every other cluster over the clones of either; 0 if one side is empty."""
    b = counts.where(F.col(cluster) == base).select(clone, F.col("n").alias("a"))
    names = counts.where(F.col(cluster) != base).select(cluster).distinct()
    both = counts.where(F.col(cluster) != base).join(b, clone, "left").select(cluster, clone, F.coalesce("a", F.lit(0)).alias("a"), F.col("n").alias("c"))
    h = F.when((F.col("a") == 0) | (F.col("c") == 0), 0.0).otherwise(
        -(F.col("a") / (F.col("a") + F.col("c"))) * F.log2(F.col("a") / (F.col("a") + F.col("c"))) - (F.col("c") / (F.col("a") + F.col("c"))) * F.log2(F.col("c") / (F.col("a") + F.col("c")))
    )
    got = both.groupBy(cluster).agg(F.sum(h * (F.col("a") + F.col("c"))).alias("hw"), F.sum("c").alias("c"), F.sum("a").alias("shared"))
    whole = b.agg(F.coalesce(F.sum("a"), F.lit(0)).alias("t")).scalar()
    return names.join(got, cluster).select(cluster, F.when(whole == 0, 0.0).otherwise(F.try_divide("hw", F.col("c") + whole)).alias("transition"))


def clone_size(df: DataFrame, clone: str, sample: str, expanded: int) -> DataFrame:
    """Adds clone_size, expanded (> ``expanded``) and size relative to the sample's cells with a clone; 0 without a clone."""
    n = df.where(F.col(clone).isNotNull()).groupBy(clone).agg(F.count(F.lit(1)).alias("clone_size"))
    valid = df.groupBy(sample).agg(F.count(clone).alias("_v"))
    out = df.join(n, clone, "left").join(valid, sample).fillna(0, ["clone_size"])
    return out.withColumns({"expanded": F.col("clone_size") > expanded, "relative_size": F.when(F.col("_v") > 0, F.col("clone_size") / F.col("_v")).otherwise(0.0)}).drop("_v")


def welch_markers(m: Matrix, by: str) -> DataFrame:
    """Per (group, variable): mean, mean of the rest, Welch's t, log2 fold change of means + 1e-9, detection in and out.

    A group of one observation has variance 0; without a rest (a single group) its mean and detection are null, and so is the fold change, and t is 0.
    """
    g = m.obs.groupBy(by).agg(F.count(F.lit(1)).alias("n1"))
    whole = m.obs.agg(F.count(F.lit(1)).alias("x")).scalar()
    e = m.entries.join(m.obs.select("obs_id", by), "obs_id")
    s = e.groupBy(by, "var_id").agg(F.count(F.lit(1)).alias("d"), F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"))
    tot = s.groupBy("var_id").agg(F.sum("d").alias("td"), F.sum("s").alias("ts"), F.sum("q").alias("tq"))
    x = s.join(tot, "var_id").join(g, by).withColumn("n2", whole - F.col("n1"))
    x = x.withColumns({"m1": F.col("s") / F.col("n1"), "m2": F.try_divide(F.col("ts") - F.col("s"), "n2")})
    x = x.withColumns(
        {
            "v1": F.coalesce(F.try_divide(F.col("q") - F.col("n1") * F.col("m1") * F.col("m1"), F.col("n1") - 1), F.lit(0.0)),
            "v2": F.coalesce(F.try_divide(F.col("tq") - F.col("q") - F.col("n2") * F.col("m2") * F.col("m2"), F.when(F.col("n2") > 1, F.col("n2") - 1)), F.lit(0.0)),
        }
    )
    se = F.sqrt(F.greatest(F.lit(0.0), F.col("v1")) / F.col("n1") + F.try_divide(F.greatest(F.lit(0.0), F.col("v2")), "n2"))
    return x.select(
        by, "var_id", F.col("m1").alias("mean_in"), F.col("m2").alias("mean_out"), F.when(se > 0, (F.col("m1") - F.col("m2")) / se).otherwise(0.0).alias("score"),
        F.log2((F.col("m1") + 1e-9) / (F.col("m2") + 1e-9)).alias("lfc"), (F.col("d") / F.col("n1")).alias("pct"), F.try_divide(F.col("td") - F.col("d"), "n2").alias("pct_reference"),
    )


def auroc(df: DataFrame, score: str, label: str) -> DataFrame:
    """Area under the ROC curve (rank-sum form, average ranks for ties) and average precision (ties by whole groups).

    Scores are compressed to distinct values with their counts first; ranks are then running sums over these.
    Null without a positive (both) or without a negative (the area).
    """
    pos = F.when(F.col(label), 1).otherwise(0)
    d = df.where(F.col(score).isNotNull()).groupBy(score).agg(F.sum(pos).alias("p"), F.count(F.lit(1)).alias("n"))
    r = running_totals(d, [score], ["p", "n"])  # sums from below; from above they are the rest
    all_p, all_n = d.agg(F.sum("p").alias("x")).scalar(), d.agg(F.sum("n").alias("x")).scalar()
    r = r.select(
        "p", "n", (F.col("run_n") - F.col("n") + (F.col("n") + 1) / 2).alias("rank"), (all_p - F.col("run_p") + F.col("p")).alias("tp"), (all_n - F.col("run_n") + F.col("n")).alias("all")
    )
    s = r.agg(F.sum("p").alias("P"), F.sum("n").alias("N"), F.sum(F.col("rank") * F.col("p")).alias("R"), F.sum(F.col("p") * F.col("tp") / F.col("all")).alias("ap"))
    area = F.try_divide(F.col("R") - F.col("P") * (F.col("P") + 1) / 2, F.col("P") * (F.col("N") - F.col("P")))
    return s.select(area.alias("auroc"), F.try_divide("ap", "P").alias("average_precision"))


def size_factors(m: Matrix) -> DataFrame:
    """Median-of-ratios size factors over the variables detected in every observation (of an aggregated matrix).

    A variable's log geometric mean over the observations is used where it has no zero; an observation's
    factor is exp(median(log value - log mean)).
    """
    n = m.obs.agg(F.count(F.lit(1)).alias("n")).scalar()
    logs = m.entries.where("value > 0").withColumn("l", F.log("value"))
    gm = logs.groupBy("var_id").agg(F.avg("l").alias("g"), F.count(F.lit(1)).alias("k")).where(F.col("k") == n)
    return logs.join(gm, "var_id").groupBy("obs_id").agg(F.exp(F.percentile(F.col("l") - F.col("g"), 0.5)).alias("size_factor"))
