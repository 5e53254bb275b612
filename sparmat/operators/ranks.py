"""Ordered operators: rankings, recovery and enrichment, trends, correlation, rank aggregation, multiple testing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparmat.functions.stats import binomial_tail, chi2_tail, correlation, ln_choose
from sparmat.model import Matrix
from sparmat.session import ranked, running_totals, scratch_table

UP_TO = (Window.unboundedPreceding, Window.currentRow)


def rankings(entries: DataFrame) -> DataFrame:
    """Rank (from 0, falling value, ties by variable) of each entry within its observation; absent entries rank behind."""
    w = Window.partitionBy("obs_id").orderBy(F.col("value").desc(), "var_id")
    return entries.withColumn("rank", F.row_number().over(w) - 1)


def recovery_auc(ranked: DataFrame, signature: DataFrame, cutoff: int) -> DataFrame:
    """(obs_id, set, auc): area under the weighted recovery curve up to ``cutoff`` ranks, over its maximum.

    ``signature``: (set, var_id, weight). A member at rank r < cutoff adds weight x (cutoff - r).
    """
    top = signature.groupBy("set").agg(F.sum("weight").alias("w"))
    hit = ranked.where(F.col("rank") < cutoff).join(signature, "var_id").groupBy("obs_id", "set").agg(F.sum(F.col("weight") * (cutoff - F.col("rank"))).alias("a"))
    return hit.join(top, "set").select("obs_id", "set", F.coalesce(F.try_divide("a", cutoff * F.col("w")), F.lit(0.0)).alias("auc"))


def enrichment_scores(auc: DataFrame, n_obs: Column) -> DataFrame:
    """Normalised enrichment: z-score of the AUC over all ``n_obs`` observations (those without a row have 0)."""
    s = auc.groupBy("set").agg(F.sum("auc").alias("s"), F.sum(F.col("auc") * F.col("auc")).alias("q"))
    mean = F.col("s") / n_obs
    sd = F.sqrt(F.greatest(F.lit(0.0), F.col("q") / n_obs - mean * mean))
    return auc.join(s, "set").select("obs_id", "set", F.when(sd > 0, (F.col("auc") - mean) / sd).otherwise(0.0).alias("nes"))


def _hit_sums(h: DataFrame, keys: Sequence[str], score: str) -> DataFrame:
    """Running sums after (``up``) and before (``down``) each hit: rows (keys, set, var_id, rank, score, n) of the members of the sets.

    Only hits matter: the misses before one are its rank less the hits so far. Windows run per key and set over its members.
    """
    part = Window.partitionBy(*keys, "set")
    w = part.orderBy("rank")
    h = h.withColumns({"_c": F.sum(F.abs(score)).over(w.rowsBetween(*UP_TO)), "_i": F.row_number().over(w), "_k": F.count(F.lit(1)).over(part), "_t": F.sum(F.abs(score)).over(part)})
    miss = F.coalesce(F.try_divide(F.col("rank") - F.col("_i"), F.col("n") - F.col("_k")), F.lit(0.0))
    share = lambda c: F.coalesce(F.try_divide(c, "_t"), F.lit(0.0))
    return h.select(*keys, "set", "var_id", "rank", (share(F.col("_c")) - miss).alias("up"), (share(F.col("_c") - F.abs(score)) - miss).alias("down"))


def _extremes(e: DataFrame, keys: Sequence[str]) -> DataFrame:
    x = e.groupBy(*keys, "set").agg(F.max(F.struct("up", -F.col("rank"))).alias("hi"), F.min(F.struct("down", "rank")).alias("lo"))
    pos = F.col("hi.up") >= -F.col("lo.down")
    return x.select(*keys, "set", F.when(pos, F.col("hi.up")).otherwise(F.col("lo.down")).alias("es"), F.when(pos, -F.col("hi.col2")).otherwise(F.col("lo.rank")).alias("at"), pos.alias("pos"))


def es_of_hits(h: DataFrame, keys: Sequence[str], score: str) -> DataFrame:
    """(keys, set, es, at, pos): enrichment scores from the ranked members of the sets."""
    return _extremes(_hit_sums(h, keys, score), keys)


def running_enrichment(scored: DataFrame, signature: DataFrame, by: str, score: str) -> DataFrame:
    """Running-sum enrichment per (by, set): es, rank of the extreme, and the leading edge as a sorted array.

    Variables are ordered by falling score (ties by variable). A hit adds |score| / its total, a miss takes away
    1 / (N - hits); a set of all variables has no misses, one whose scores are all 0 no hits.
    """
    r = ranked(scored.select(by, "var_id", score), [by], [F.col(score).desc(), "var_id"], "rank", size="n")
    e = scratch_table(_hit_sums(r.join(signature.select("set", "var_id").distinct(), "var_id"), [by], score), "hits")
    x = _extremes(e, [by])
    edge = e.join(x, [by, "set"]).where(F.when(F.col("pos"), F.col("rank") <= F.col("at")).otherwise(F.col("rank") >= F.col("at")))
    return edge.groupBy(by, "set").agg(F.first("es").alias("es"), F.first("at").alias("at"), F.array_sort(F.collect_list("var_id")).alias("leading_edge"))


def gene_set_score(m: Matrix, members: DataFrame, bins: int) -> DataFrame:
    """(obs_id, score): mean of the set minus mean of its control, all other variables of the set's expression bins.

    Bins are ``ntile`` of the variables' totals; zeros count in both means.
    """
    t = m.var.select("var_id").join(m.entries.groupBy("var_id").agg(F.sum("value").alias("t")), "var_id", "left").fillna(0.0, ["t"])
    place = ranked(t, [], ["t", "var_id"], "_r", size="_n")
    # ntile: the first n mod bins bins have one more
    small, more = F.floor(F.col("_n") / bins), F.col("_n") % bins
    early = more * (small + 1)
    b = place.withColumn("bin", F.when(F.col("_r") <= early, F.floor((F.col("_r") - 1) / (small + 1)) + 1).otherwise(more + F.floor((F.col("_r") - 1 - early) / F.greatest(small, F.lit(1))) + 1).cast("int")).drop("_r", "_n")
    inset = b.join(members.select("var_id").distinct().withColumn("is_set", F.lit(True)), "var_id", "left").fillna(False, ["is_set"])
    used = inset.where("is_set").select("bin").distinct()
    side = inset.join(used, "bin", "left_semi").select("var_id", "is_set")
    n1, n0 = side.where("is_set").agg(F.count(F.lit(1)).alias("n")).scalar(), side.where("NOT is_set").agg(F.count(F.lit(1)).alias("n")).scalar()
    s = m.entries.join(side, "var_id").groupBy("obs_id").agg(F.sum(F.when(F.col("is_set"), F.col("value")).otherwise(0.0)).alias("a"), F.sum(F.when(~F.col("is_set"), F.col("value")).otherwise(0.0)).alias("c"))
    return m.obs.select("obs_id").join(s, "obs_id", "left").select("obs_id", (F.coalesce(F.try_divide("a", n1), F.lit(0.0)) - F.coalesce(F.try_divide("c", n0), F.lit(0.0))).alias("score"))


def overrepresentation(hits: DataFrame, signature: DataFrame, universe: Column) -> DataFrame:
    """(set, overlap, size, p): hypergeometric tail of the overlap of ``hits`` (var_id) with each set in a universe of n variables."""
    k = hits.select("var_id").distinct()
    drawn = k.agg(F.count(F.lit(1)).alias("n")).scalar()
    size = signature.groupBy("set").agg(F.count_distinct("var_id").alias("size"))
    o = signature.select("set", "var_id").distinct().join(k, "var_id", "left_semi").groupBy("set").agg(F.count(F.lit(1)).alias("overlap"))
    t = size.join(o, "set", "left").fillna(0, ["overlap"]).withColumns({"n": drawn, "u": universe})
    i = F.explode(F.sequence(F.col("overlap"), F.least("size", "n")))
    x = t.where(F.col("overlap") <= F.least("size", "n")).withColumn("i", i)
    d = lambda c: F.col(c).cast("double")
    p = F.exp(ln_choose(d("size"), d("i")) + ln_choose(d("u") - d("size"), d("n") - d("i")) - ln_choose(d("u"), d("n")))
    ok = (F.col("n") - F.col("i")) <= (F.col("u") - F.col("size"))
    return x.groupBy("set", "overlap", "size").agg(F.least(F.lit(1.0), F.sum(F.when(ok, p).otherwise(0.0))).alias("p"))


def two_by_two(df: DataFrame, by: str, hit: Column, foreground: Column) -> DataFrame:
    """(by, fold, chi2, p): hit ratio in foreground over background and Pearson's chi-square with one degree of freedom."""
    g = df.groupBy(by).agg(*[F.count(F.when(c, 1)).cast("double").alias(n) for n, c in (("a", hit & foreground), ("b", ~hit & foreground), ("c", hit & ~foreground), ("d", ~hit & ~foreground))])
    n = F.col("a") + F.col("b") + F.col("c") + F.col("d")
    den = (F.col("a") + F.col("b")) * (F.col("c") + F.col("d")) * (F.col("a") + F.col("c")) * (F.col("b") + F.col("d"))
    chi = F.when(den > 0, n * F.pow(F.col("a") * F.col("d") - F.col("b") * F.col("c"), 2) / den).otherwise(0.0)
    fold = F.try_divide(F.try_divide("a", F.col("a") + F.col("b")), F.try_divide(F.col("c"), F.col("c") + F.col("d")))
    return g.select(by, fold.alias("fold"), chi.alias("chi2"), chi2_tail(chi).alias("p"))


def benjamini_hochberg(df: DataFrame, p: str, by: Sequence[str]) -> DataFrame:
    """Adds ``q``: min over larger p of p n / rank, at most 1. Equal p are compressed first; null p stay null and do not count.

    Ranks are running totals and the minimum is taken within range partitions, then over those above (one row a partition):
    a group that holds most rows is spread like any other.
    """
    d = df.where(F.col(p).isNotNull()).groupBy(*by, p).agg(F.count(F.lit(1)).alias("_k"))
    n = d.groupBy(*by).agg(F.sum("_k").alias("_n")).select(*[F.col(k).alias(f"_b{i}") for i, k in enumerate(by)], "_n")
    r = running_totals(d, [p], ["_k"], by)
    r = r.join(n, [F.col(k).eqNullSafe(F.col(f"_b{i}")) for i, k in enumerate(by)] or F.lit(True))
    r = r.select(*by, p, (F.col(p) * F.col("_n") / F.col("run__k")).alias("_v"))
    q = running_least(r, by, F.col(p).desc(), "_v").select(*[F.col(k).alias(f"_b{i}") for i, k in enumerate(by)], F.col(p).alias("_p"), F.least(F.lit(1.0), "_least").alias("q"))
    return df.join(q, [*[F.col(k).eqNullSafe(F.col(f"_b{i}")) for i, k in enumerate(by)], F.col(p) == F.col("_p")], "left").drop("_p", *[f"_b{i}" for i in range(len(by))])


def running_least(df: DataFrame, by: Sequence[str], order: Column, value: str) -> DataFrame:
    """Adds ``_least``: the smallest value so far within ``by`` in an order, over range partitions."""
    parts = scratch_table(df.repartitionByRange(*[F.col(k) for k in by], order).withColumn("_part", F.spark_partition_id()), "ranges")
    upto = Window.partitionBy("_part", *by).orderBy(order).rowsBetween(*UP_TO)
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    low = parts.groupBy("_part", *by).agg(F.min(value).alias("_m"))
    low = low.select(F.col("_part").alias("_q"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(by)], F.min("_m").over(before).alias("_before"))
    on = [F.col("_part") == F.col("_q"), *[F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(by)]]
    out = parts.withColumn("_here", F.min(value).over(upto)).join(low, on)
    return out.withColumn("_least", F.least("_here", "_before")).drop("_part", "_q", "_here", "_before", *[f"_k{i}" for i in range(len(by))])


def rank_table(df: DataFrame, by: str, value: str, into: str) -> DataFrame:
    """(_b, _v, into): average rank with ties of every distinct value within ``by``; written, so its size is known to the joins that use it."""
    d = scratch_table(df.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count(F.lit(1)).alias("_k")), "values")
    r = running_totals(d, [value], ["_k"], [by])
    return scratch_table(r.select(F.col(by).alias("_b"), F.col(value).alias("_v"), (F.col("run__k") - (F.col("_k") - 1) / 2).alias(into)), "ranks")


def average_ranks(df: DataFrame, by: str, value: str, into: str) -> DataFrame:
    """Average ranks with ties within ``by``, over compressed values; rows with a null value are left out."""
    r = rank_table(df, by, value, into)
    return df.join(r, F.col(by).eqNullSafe(F.col("_b")) & (F.col(value) == F.col("_v"))).drop("_b", "_v")


def spearman(df: DataFrame, by: str, x: str, y: str) -> DataFrame:
    """(by, rho) over the rows in which both values stand."""
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(by, x, y)
    tables = {c: rank_table(d.select(by, c), by, c, into) for c, into in ((x, "_x"), (y, "_y"))}
    for c in (x, y):
        r = tables[c]
        d = d.join(r, F.col(by).eqNullSafe(F.col("_b")) & (F.col(c) == F.col("_v"))).drop("_b", "_v")
    return d.groupBy(by).agg(correlation("_x", "_y").alias("rho"))


def masked_pearson(entries: DataFrame, pairs: DataFrame, least: int) -> DataFrame:
    """(a, b, n, rho) of variable pairs over the observations in which both are non-zero; at least ``least`` of them."""
    e = entries.where("value <> 0")
    x = pairs.join(e.select(F.col("var_id").alias("a"), "obs_id", F.col("value").alias("_x")), "a")
    j = x.join(e.select(F.col("var_id").alias("b"), "obs_id", F.col("value").alias("_y")), ["b", "obs_id"])
    return j.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), correlation("_x", "_y").alias("rho")).where(F.col("n") >= least)


def robust_rank_aggregate(ranks: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Adds ``rho``: the smallest Beta(i, k - i + 1) distribution function of the sorted relative ranks, times k, at most 1."""
    k = len(columns)
    s = F.array_sort(F.array(*[F.col(c) for c in columns]))
    return ranks.withColumn("rho", F.least(F.lit(1.0), k * F.least(*[binomial_tail(k, i + 1, s[i]) for i in range(k)])))


def relative_ranks(df: DataFrame, columns: dict[str, bool]) -> DataFrame:
    """Average-tie ranks over the column's largest rank (True: falling, False: rising); equal values are compressed first."""
    df = scratch_table(df, "scores")  # read once a column
    out = df
    for c, falling in columns.items():
        d = df.groupBy(c).agg(F.count(F.lit(1)).alias("_k"))
        order = F.col(c).desc_nulls_last() if falling else F.col(c).asc_nulls_last()
        r = running_totals(d, [order], ["_k"]).select(F.col(c).alias("_v"), (F.col("run__k") - (F.col("_k") - 1) / 2).alias("_r"))
        r = scratch_table(r, "ranks")
        out = out.join(r, F.col(c).eqNullSafe(F.col("_v"))).withColumn(f"rank_{c}", F.col("_r") / r.agg(F.max("_r").alias("m")).scalar()).drop("_v", "_r")
    return out


def top_per_group(df: DataFrame, by: str, order: Sequence[Column], n: int) -> DataFrame:
    """The n first rows per group; the limit is applied before and after the shuffle."""
    w = Window.partitionBy(by).orderBy(*order)
    return df.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)


def above_percentile(df: DataFrame, by: str, value: str, q: float) -> DataFrame:
    t = df.groupBy(by).agg(F.percentile(value, q).alias("_t"))
    return df.join(t, by).where(F.col(value) > F.col("_t")).drop("_t")


def binned_trend(df: DataFrame, by: str, x: Column, y: str, bins: int) -> DataFrame:
    """(by, bin, value): mean of y in equal-width bins of x per group; an empty bin carries the previous value on; the last edge is excluded."""
    d = df.select(by, x.alias("_x"), F.col(y).alias("_y")).where("_x IS NOT NULL")
    e = d.groupBy(by).agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    b = F.floor((F.col("_x") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins)
    got = d.join(e, by).where("_hi > _lo").withColumn("bin", b).where(F.col("bin") < bins).groupBy(by, "bin").agg(F.avg("_y").alias("v"))
    grid = e.where("_hi > _lo").select(by, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(bins - 1).cast("bigint"))).alias("bin"))
    w = Window.partitionBy(by).orderBy("bin").rowsBetween(*UP_TO)
    return grid.join(got, [by, "bin"], "left").select(by, "bin", F.last("v", ignorenulls=True).over(w).alias("value"))


def moving_average(df: DataFrame, by: str, order: Sequence[str], value: str, half: int) -> DataFrame:
    """Mean over half rows before and after, truncated at the borders."""
    return df.withColumn("smoothed", F.avg(value).over(Window.partitionBy(by).orderBy(*order).rowsBetween(-half, half)))


def linear_fit(df: DataFrame, by: str, x: Column, y: Column) -> DataFrame:
    return df.groupBy(by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))


def trimmed_mean(df: DataFrame, by: str, value: str, ident: str, trim: float) -> DataFrame:
    """Mean and population variance without floor(n trim) values at each end."""
    d = ranked(df.where(F.col(value).isNotNull()).select(by, value, ident), [by], [value, ident], "_r", size="_n")
    cut = F.floor(F.col("_n") * trim)
    d = d.where((F.col("_r") > cut) & (F.col("_r") <= F.col("_n") - cut))
    return d.groupBy(by).agg(F.avg(value).alias("mean"), F.var_pop(value).alias("var"))


def call_cells(counts: DataFrame, key: str, n: str, expected: int) -> DataFrame:
    """Keys with at least a tenth of the count at rank expected / 100 (the 99th percentile of the expected cells)."""
    top = counts.orderBy(F.col(n).desc()).limit(max(1, expected // 100))  # a distributed top-k of a fixed size
    return counts.where(F.col(n) * 10 >= top.agg(F.min(n).alias("b")).scalar()).select(key, n)


def expression_entropy(m: Matrix) -> DataFrame:
    """(var_id, mean_log, log_mean): mean of log1p over all observations and log of the mean + 1."""
    n = m.obs.agg(F.count(F.lit(1)).alias("n")).scalar()
    return m.entries.groupBy("var_id").agg(F.try_divide(F.sum(F.log1p("value")), n).alias("mean_log"), F.log1p(F.try_divide(F.sum("value"), n)).alias("log_mean"))
