"""Ligand-receptor scores between groups of observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparmat.functions.stats import normal_cdf
from sparmat.model import Matrix
from sparmat.operators.aggregate import pseudobulk
from sparmat.session import scratch_table


def group_stats(m: Matrix, by: str) -> DataFrame:
    """(by, var_id, mean, prop, sd, trimean, z, lfc, n): statistics of a group, zeros counted.

    z: mean of the group's z-scores over all observations; lfc: log2((mean + 1) / (mean of the rest + 1)), null for a single group.
    """
    p = pseudobulk(m, by, quantiles=True)
    n = m.obs.agg(F.count(F.lit(1)).alias("n")).scalar()
    t = m.entries.groupBy("var_id").agg(F.sum("value").alias("_s"), F.sum(F.col("value") * F.col("value")).alias("_q"))
    d = p.join(t, "var_id").withColumn("_n", n)
    all_mean = F.col("_s") / F.col("_n")
    all_sd = F.sqrt(F.greatest(F.lit(0.0), F.col("_q") / F.col("_n") - all_mean * all_mean))
    rest = F.try_divide(F.col("_s") - F.col("sum_v"), F.col("_n") - F.col("n_obs"))
    return d.select(
        by, "var_id", F.col("mean_v").alias("mean"), (F.col("n_detected") / F.col("n_obs")).alias("prop"), F.sqrt(F.greatest(F.lit(0.0), F.col("var_v"))).alias("sd"), F.col("trimean_v").alias("trimean"),
        F.when(all_sd > 0, (F.col("mean_v") - all_mean) / all_sd).otherwise(0.0).alias("z"), F.log2((F.col("mean_v") + 1) / (rest + 1)).alias("lfc"), F.col("n_obs").alias("n"),
    )


def pair_stats(stats: DataFrame, resource: DataFrame, by: str, least_prop: float) -> DataFrame:
    """One row per (source, target, ligand, receptor) whose sides are both detected in at least ``least_prop`` of their group.

    ``resource``: (ligand, receptor). Groups meet through the resource's equality joins.
    """
    side = lambda role, name: stats.where(F.col("prop") >= least_prop).select(
        F.col("var_id").alias(role), F.col(by).alias(name), *[F.col(c).alias(f"{role[0]}_{c}") for c in ("mean", "prop", "sd", "trimean", "z", "lfc", "n")]
    )
    sums = stats.groupBy("var_id").agg(F.sum("mean").alias("s"))
    out = resource.distinct().join(side("ligand", "source"), "ligand").join(side("receptor", "target"), "receptor")
    return out.join(sums.select(F.col("var_id").alias("ligand"), F.col("s").alias("l_sum")), "ligand").join(sums.select(F.col("var_id").alias("receptor"), F.col("s").alias("r_sum")), "receptor")


def scorers(mu: Column, top: Column) -> dict[str, Column]:
    """Scores by name; ``mu``: mean of all cells of the matrix, ``top``: its largest value. Register others by adding to the dict."""
    l, r = F.col("l_mean"), F.col("r_mean")  # noqa: E741
    both = F.coalesce(F.try_divide("l_trimean", top) * F.try_divide("r_trimean", top), F.lit(0.0))
    root = F.sqrt(l) * F.sqrt(r)
    cdf = lambda c: F.when(F.col(f"{c}_mean") == 0, 0.0).otherwise(normal_cdf((F.col(f"{c}_mean") - mu) * F.sqrt(F.col(f"{c}_n")) / F.when(F.col(f"{c}_sd") > 0, F.col(f"{c}_sd"))))
    return {
        "cellchat": both / (0.5 + both),
        "cpdb": F.when((l == 0) | (r == 0), 0.0).otherwise((l + r) / 2),
        "connectome": l * r,
        "connectome_z": (F.col("l_z") + F.col("r_z")) / 2,
        "geomean": F.sqrt(l * r),
        "logfc": (F.col("l_lfc") + F.col("r_lfc")) / 2,
        "natmi": l * r,
        "natmi_spec": F.coalesce(F.try_divide(l, F.col("l_sum")) * F.try_divide(r, F.col("r_sum")), F.lit(0.0)),
        "sca": F.coalesce(F.try_divide(root, root + mu), F.lit(0.0)),
        "scseqcomm": F.least(cdf("l"), cdf("r")),
    }


def score(m: Matrix, by: str, resource: DataFrame, least_prop: float) -> DataFrame:
    """All scores per (source, target, ligand, receptor). The entries are written once: six branches read them."""
    m = Matrix(scratch_table(m.entries, "entries"), m.obs, m.var)
    mu = F.try_divide(m.entries.agg(F.sum("value").alias("s")).scalar(), m.obs.agg(F.count(F.lit(1)).alias("n")).scalar() * m.var.agg(F.count(F.lit(1)).alias("n")).scalar())
    top = m.entries.agg(F.max("value").alias("t")).scalar()
    p = pair_stats(group_stats(m, by), resource, by, least_prop).withColumns({"_mu": mu, "_top": top})
    return p.select("source", "target", "ligand", "receptor", *[c.alias(n) for n, c in scorers(F.col("_mu"), F.col("_top")).items()])


def explode_complexes(resource: DataFrame, column: str) -> DataFrame:
    """Complexes 'A_B' to one row per subunit (``<column>_unit``)."""
    return resource.withColumn(f"{column}_unit", F.explode(F.split(F.col(column).cast("string"), "_")))


def complex_minimum(units: DataFrame, keys: list[str], complex_col: str, unit_stats: DataFrame, by: str) -> DataFrame:
    """Per (complex, group): the smallest mean and proportion over its subunits; none where a subunit is missing."""
    u = units.select(complex_col, f"{complex_col}_unit").distinct()
    size = u.groupBy(complex_col).agg(F.count(F.lit(1)).alias("_k"))
    s = u.join(unit_stats.select(F.col("var_id").cast("string").alias(f"{complex_col}_unit"), by, "mean", "prop"), f"{complex_col}_unit")
    g = s.groupBy(complex_col, by).agg(F.min("mean").alias("mean"), F.min("prop").alias("prop"), F.count(F.lit(1)).alias("_c"))
    return g.join(size, complex_col).where("_c = _k").drop("_c", "_k")
