"""Smaller operators: copy-number smoothing, footprints, descriptive frames, clones' ids, masks, trends."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparmat.functions.stats import correlation
from sparmat.model import Matrix
from sparmat.operators.genome import insertions, overlap_join
from sparmat.operators.skew import interpolated_percentiles
from sparmat.session import ranked


def metacell_means(m: Matrix, assignment: DataFrame) -> DataFrame:
    """(metacell, var_id, value): mean over the cells (obs_id, metacell) of a metacell, zeros counted."""
    n = assignment.groupBy("metacell").agg(F.count(F.lit(1)).alias("n"))
    s = m.entries.join(assignment, "obs_id").groupBy("metacell", "var_id").agg(F.sum("value").alias("s"))
    return s.join(n, "metacell").select("metacell", "var_id", (F.col("s") / F.col("n")).alias("value"))


def smooth_along_chromosomes(values: DataFrame, by: str, chrom: str, pos: str, value: str, half: int, cap: float) -> DataFrame:
    """Copy-number profile: capped values averaged over half variables before and after in the order of the chromosome.

    The window runs per (by, chromosome) over variables, whose number is that of the genes of a chromosome.
    """
    w = Window.partitionBy(by, chrom).orderBy(pos).rowsBetween(-half, half)
    return values.withColumn("smoothed", F.avg(F.greatest(F.lit(-cap), F.least(F.lit(cap), F.col(value)))).over(w))


def reference_difference(values: DataFrame, reference: DataFrame, key: str, value: str) -> DataFrame:
    """Difference to the range of the reference groups' means: 0 inside it, else the distance to the nearer bound."""
    r = reference.groupBy(key).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    d = F.when(F.col(value) > F.col("_hi"), F.col(value) - F.col("_hi")).when(F.col(value) < F.col("_lo"), F.col(value) - F.col("_lo")).otherwise(0.0)
    return values.join(r, key).withColumn("diff", d).drop("_lo", "_hi")


def footprint(frags: DataFrame, sites: DataFrame, group: str, reach: int, smear: tuple[int, int] = (3, 2)) -> DataFrame:
    """(group, offset, n): cut sites around motif sites (t_chrom, tss, reverse), flipped on the reverse strand, each
    smeared over ``smear`` bases before and after."""
    ins = insertions(frags).select(group, "chrom", "pos", (F.col("pos") + 1).alias("pos_end"))
    win = sites.select("t_chrom", "tss", "reverse", (F.col("tss") - reach).alias("w0"), (F.col("tss") + reach + 1).alias("w1"))
    hit = overlap_join(ins, win, "chrom", "pos", "pos_end", "t_chrom", "w0", "w1")
    off = F.when(F.col("reverse"), F.col("tss") - F.col("pos")).otherwise(F.col("pos") - F.col("tss"))
    n = hit.groupBy(group, off.alias("o")).agg(F.count(F.lit(1)).alias("c"))
    spread = n.select(group, F.explode(F.sequence(F.col("o") - smear[0], F.col("o") + smear[1])).alias("offset"), "c")
    return spread.where(F.abs("offset") <= reach).groupBy(group, "offset").agg(F.sum("c").alias("n"))


def describe(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Frame behind box and violin plots: n, mean, sd, minimum, quartiles, maximum."""
    d = df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.min(value).alias("min"), F.max(value).alias("max"))
    q = interpolated_percentiles(df, by, value, [0.25, 0.5, 0.75]).select(*[F.col(c).alias(f"_b{i}") for i, c in enumerate(by)], "q")
    d = d.join(q, [F.col(c).eqNullSafe(F.col(f"_b{i}")) for i, c in enumerate(by)], "left")
    return d.select(*by, "n", "mean", "sd", "min", *[F.col("q")[i].alias(c) for i, c in enumerate(("q1", "median", "q3"))], "max")


def flows(df: DataFrame, left: str, right: str) -> DataFrame:
    return df.groupBy(left, right).agg(F.count(F.lit(1)).alias("n"))


def clone_ids(df: DataFrame, patient: str, clone: str, order: str) -> DataFrame:
    """(patient, clone, ordinal): clones numbered per patient by their first row in ``order``."""
    first = df.where(F.col(clone).isNotNull()).groupBy(patient, clone).agg(F.min(order).alias("_f"))
    return ranked(first, [patient], ["_f", clone], "ordinal").drop("_f")


def position_bits(df: DataFrame, seq: str, length: int, alphabet: str = "ACGT") -> DataFrame:
    """(position, letter, share, bits): letter shares and information content per position of sequences."""
    import math

    d = df.select(F.posexplode(F.split(F.substring(F.col(seq), 1, length), "")).alias("position", "letter")).where(F.col("letter").isin(*alphabet))
    n = d.groupBy("position", "letter").agg(F.count(F.lit(1)).alias("c"))
    t = n.groupBy("position").agg(F.sum("c").alias("t"))
    x = n.join(t, "position").withColumn("share", F.col("c") / F.col("t"))
    h = x.groupBy("position").agg((math.log2(len(alphabet)) + F.sum(F.col("share") * F.log2("share"))).alias("info"))
    return x.join(h, "position").select("position", "letter", "share", (F.col("share") * F.col("info")).alias("bits"))


def layer_shares(df: DataFrame, by: str, layers: Sequence[str]) -> DataFrame:
    """Share of each layer (e.g. spliced, unspliced) in a group's total; null for a total of 0."""
    g = df.groupBy(by).agg(*[F.sum(c).alias(c) for c in layers])
    total = sum((F.col(c) for c in layers[1:]), F.col(layers[0]))
    return g.select(by, *[F.try_divide(c, total).alias(c) for c in layers])


def top_mask(df: DataFrame, by: str, value: str, share: float) -> DataFrame:
    """Adds ``scaled`` (min-max within the group, 0 for a constant group) and ``top``: at or above the group's 1 - share quantile."""
    g = interpolated_percentiles(df, [by], value, [0.0, 1.0, 1 - share]).select(by, *[F.col("q")[i].alias(c) for i, c in enumerate(("_a", "_b", "_q"))])
    j = df.join(g, by)
    return j.withColumns({"scaled": F.when(F.col("_b") > F.col("_a"), (F.col(value) - F.col("_a")) / (F.col("_b") - F.col("_a"))).otherwise(0.0), "top": F.col(value) >= F.col("_q")}).drop("_a", "_b", "_q")


def scaled_mad(df: DataFrame, by: str, value: str) -> DataFrame:
    """Median absolute deviation over the normal's third quartile 0.6744897501960817."""
    med = interpolated_percentiles(df, [by], value, [0.5]).select(by, F.col("q")[0].alias("_m"))
    off = df.join(med, by).select(by, F.abs(F.col(value) - F.col("_m")).alias("_off"))
    return interpolated_percentiles(off, [by], "_off", [0.5]).select(by, (F.col("q")[0] / 0.6744897501960817).alias("mad"))


def constant_variables(m: Matrix) -> DataFrame:
    """Variables with one value over all observations; implicit zeros are a value."""
    n = m.obs.agg(F.count(F.lit(1)).alias("n")).scalar()
    s = m.entries.groupBy("var_id").agg(F.min("value").alias("a"), F.max("value").alias("b"), F.count(F.lit(1)).alias("k")).withColumn("n", n)
    none = m.var.select("var_id").join(s, "var_id", "left")
    return none.where(F.col("k").isNull() | ((F.col("a") == F.col("b")) & ((F.col("k") == F.col("n")) | (F.col("a") == 0)))).select("var_id")


def ambient_profile(m: Matrix, low: float, high: float) -> DataFrame:
    """(var_id, share): each variable's share of the counts of observations whose total lies strictly between the bounds."""
    t = m.entries.groupBy("obs_id").agg(F.sum("value").alias("t")).where((F.col("t") > low) & (F.col("t") < high))
    s = m.entries.join(t, "obs_id", "left_semi").groupBy("var_id").agg(F.sum("value").alias("s"))
    return s.select("var_id", F.try_divide("s", s.agg(F.sum("s").alias("x")).scalar()).alias("share"))


def quantile_bins(df: DataFrame, value: str, edges: Sequence[float]) -> DataFrame:
    """Adds ``bin``: 0-based class of a score between fixed edges (potency classes)."""
    return df.withColumn("bin", F.least(F.lit(len(edges) - 2), F.greatest(F.lit(0), sum((F.when(F.col(value) >= e, 1).otherwise(0) for e in edges[1:]), F.lit(0)))))


def rasterize(df: DataFrame, x: Column, y: Column, dx: float) -> DataFrame:
    """(px, py, n): points per pixel of side dx."""
    return df.groupBy(F.floor(x / dx).alias("px"), F.floor(y / dx).alias("py")).agg(F.count(F.lit(1)).alias("n"))


def marker_filter(df: DataFrame, min_pct: float, max_pct_reference: float, min_lfc: float) -> DataFrame:
    return df.where((F.col("pct") >= min_pct) & (F.col("pct_reference") <= max_pct_reference) & (F.col("lfc") >= min_lfc))


def cluster_spread(values: DataFrame, by: str, value: str) -> DataFrame:
    """Mean absolute profile value and the interquartile range per cluster."""
    q = interpolated_percentiles(values, [by], value, [0.25, 0.75]).select(by, (F.col("q")[1] - F.col("q")[0]).alias("iqr"))
    return values.groupBy(by).agg(F.avg(F.abs(value)).alias("score")).join(q, by)


def correlation_with_self(df: DataFrame, by: str, columns: Sequence[str]) -> DataFrame:
    """(by, a, b, rho): Pearson correlation of each pair of columns per group."""
    out = df.groupBy(by).agg(*[correlation(a, b).alias(f"{a}|{b}") for i, a in enumerate(columns) for b in columns[i + 1 :]])
    names = [c for c in out.columns if c != by]
    return out.unpivot([by], names, "pair", "rho").select(by, F.split("pair", r"\|")[0].alias("a"), F.split("pair", r"\|")[1].alias("b"), "rho")
