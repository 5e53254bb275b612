"""Trends by local regression and the selection of variables that rests on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparmat.model import Matrix
from sparmat.session import ranked, scratch_table


def local_trend(points: DataFrame, span: float = 0.3, vertices: int = 50) -> DataFrame:
    """(id, x, y, fit): local quadratic regression of y on x with tricube weights (points: id, x, y without nulls).

    The regression is solved at ``vertices`` points of equal distance in rank, each over the ``span`` of all points nearest in
    rank, and is linear between them. Each point meets the vertices it has weight in, and a vertex is a sum: no task sees all points
    and no pairs arise. The driver holds the vertices only. Where a vertex has too few different x for a quadratic its value is the weighted mean.
    """
    p = scratch_table(ranked(points.select("id", "x", "y"), [], ["x", "id"], "r", size="n"), "trend")
    n = p.count()
    if not n:
        return p.select("id", "x", "y", F.lit(None).cast("double").alias("fit"))
    g = max(2, min(vertices, n))
    q = min(n, max(4, int(span * n + 0.5)))
    places = []
    for i in range(g):
        c = 1 + int(i * (n - 1) / (g - 1) + 0.5)
        lo = min(max(1, c - q // 2), n - q + 1)
        places.append((i, c, lo, lo + q - 1))
    wanted = sorted({r for v in places for r in v[1:]})
    x_at = {r.r: r.x for r in p.where(F.col("r").isin(*wanted)).select("r", "x").collect()}  # three a vertex
    v = [F.struct(F.lit(i).alias("g"), F.lit(x_at[c]).alias("c"), F.lit(max(x_at[c] - x_at[lo], x_at[hi] - x_at[c]) * 1.000001 + 1e-12).alias("h"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for i, c, lo, hi in places]
    e = p.withColumn("v", F.explode(F.filter(F.array(*v), lambda s: (s["lo"] <= F.col("r")) & (F.col("r") <= s["hi"]))))
    e = e.select(F.col("v.g").alias("g"), "y", (F.col("x") - F.col("v.c")).alias("d"), F.col("v.h").alias("h"))
    e = e.withColumn("w", F.pow(1 - F.pow(F.abs("d") / F.col("h"), F.lit(3)), F.lit(3)))
    s = lambda k, y=False: F.sum(F.col("w") * F.pow("d", F.lit(k)) * (F.col("y") if y else 1))
    m = e.groupBy("g").agg(*[s(k).alias(f"s{k}") for k in range(5)], *[s(k, True).alias(f"t{k}") for k in range(3)])
    a, b, c, d, f = (F.col(f"s{k}") for k in range(5))
    t0, t1, t2 = (F.col(f"t{k}") for k in range(3))
    det = a * (c * f - d * d) - b * (b * f - c * d) + c * (b * d - c * c)
    top = t0 * (c * f - d * d) - b * (t1 * f - d * t2) + c * (t1 * d - c * t2)
    # the determinant relative to the scale of its terms
    at = m.select("g", F.when(F.abs(det) > 1e-10 * F.abs(a * c * f), F.try_divide(top, det)).otherwise(F.try_divide(t0, a)).alias("fit"))
    fit = {r.g: r.fit for r in at.collect()}  # one row a vertex
    knots: list[tuple[float, float]] = []
    for i, cc, _, _ in places:
        if knots and knots[-1][0] == x_at[cc]:
            knots[-1] = (x_at[cc], fit[i])
        else:
            knots.append((x_at[cc], fit[i]))
    parts = [
        F.struct(F.lit(x0).alias("x0"), F.lit(y0).alias("y0"), F.lit((y1 - y0) / (x1 - x0)).alias("slope")) for (x0, y0), (x1, y1) in zip(knots, knots[1:])
    ] or [F.struct(F.lit(knots[0][0]).alias("x0"), F.lit(knots[0][1]).alias("y0"), F.lit(0.0).alias("slope"))]
    piece = F.element_at(F.filter(F.array(*parts), lambda s: (s["x0"] <= F.col("x")) | (s["x0"] == F.lit(knots[0][0]))), -1)
    return p.withColumn("_p", piece).select("id", "x", "y", (F.col("_p.y0") + F.col("_p.slope") * (F.col("x") - F.col("_p.x0"))).alias("fit"))


def variable_moments(m: Matrix) -> DataFrame:
    """(var_id, mean, var, n): moments over all observations, variance with n - 1, zeros counted."""
    n = m.obs.agg(F.count(F.lit(1)).alias("n")).scalar()
    s = m.entries.groupBy("var_id").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q")).withColumn("n", n)
    mean = F.try_divide("s", "n")
    return s.select("var_id", mean.alias("mean"), F.coalesce(F.try_divide(F.col("q") - F.col("n") * mean * mean, F.col("n") - 1), F.lit(0.0)).alias("var"), "n")


def standardized_variances(m: Matrix, span: float = 0.3) -> DataFrame:
    """(var_id, mean, var, var_norm): variance of standardised values clipped at sqrt(n), the deviation taken from the trend
    of log10 variance on log10 mean. Variables without variance have 0."""
    mom = scratch_table(variable_moments(m), "moments")
    used = mom.where("var > 0 AND mean > 0")
    trend = local_trend(used.select(F.col("var_id").alias("id"), F.log10("mean").alias("x"), F.log10("var").alias("y")), span)
    reg = used.join(trend.select(F.col("id").alias("var_id"), F.sqrt(F.pow(F.lit(10.0), "fit")).alias("sd")), "var_id")
    clip = F.least(F.col("value"), F.col("sd") * F.sqrt("n") + F.col("mean"))
    c = m.entries.join(reg.select("var_id", "sd", "mean", "n"), "var_id").groupBy("var_id").agg(F.sum(clip).alias("c1"), F.sum(clip * clip).alias("c2"))
    v = (F.col("n") * F.col("mean") * F.col("mean") + F.col("c2") - 2 * F.col("c1") * F.col("mean")) / ((F.col("n") - 1) * F.col("sd") * F.col("sd"))
    got = reg.join(c, "var_id").select("var_id", v.alias("var_norm"))
    return mom.join(got, "var_id", "left").select("var_id", "mean", "var", F.coalesce("var_norm", F.lit(0.0)).alias("var_norm"))


def fano_scores(m: Matrix) -> DataFrame:
    """(var_id, fano): variance over mean; null for a mean of 0."""
    return variable_moments(m).select("var_id", F.try_divide("var", "mean").alias("fano"))


def log_entropy_residuals(m: Matrix, span: float = 0.3) -> DataFrame:
    """(var_id, x, y, residual): mean of logs against log of means, and the trend minus the value (large: heterogeneous)."""
    n = m.obs.agg(F.count(F.lit(1)).alias("n")).scalar()
    e = m.entries.groupBy("var_id").agg(F.try_divide(F.sum(F.log1p("value")), n).alias("y"), F.log1p(F.try_divide(F.sum("value"), n)).alias("x"))
    return local_trend(e.select(F.col("var_id").alias("id"), "x", "y"), span).select(F.col("id").alias("var_id"), "x", "y", (F.col("fit") - F.col("y")).alias("residual"))


def shared_counts(spliced: DataFrame, unspliced: DataFrame, min_counts: float, min_cells: int) -> DataFrame:
    """(var_id, shared, cells): variables whose counts in observations that have both layers reach both bounds (obs_id, var_id, value)."""
    both = spliced.where("value > 0").join(unspliced.where("value > 0").select("obs_id", "var_id", F.col("value").alias("_u")), ["obs_id", "var_id"])
    return both.groupBy("var_id").agg(F.sum(F.col("value") + F.col("_u")).alias("shared"), F.count(F.lit(1)).alias("cells")).where((F.col("shared") >= min_counts) & (F.col("cells") >= min_cells))


def gate_velocities(df: DataFrame, by: str, x: str, y: str, velocity: str, share: float = 0.5) -> DataFrame:
    """Adds ``gated``: the velocity where x / max x + y / max y reaches ``share`` of its 98th percentile in the group, else 0."""
    top = df.groupBy(by).agg(F.greatest(F.max(x), F.lit(1e-3)).alias("_x"), F.greatest(F.max(y), F.lit(1e-3)).alias("_y"))
    d = df.join(top, by).withColumn("_z", F.col(x) / F.col("_x") + F.col(y) / F.col("_y"))
    q = d.groupBy(by).agg(F.percentile("_z", 0.98).alias("_q"))
    return d.join(q, by).withColumn("gated", F.when(F.col("_z") >= share * F.col("_q"), F.col(velocity)).otherwise(0.0)).drop("_x", "_y", "_z", "_q")


def extrapolated(state: Column, velocity: Column, dt: float = 1.0) -> Column:
    """State after a step of length ``dt``; null where it is not finite."""
    v = state + dt * velocity
    return F.when(F.isnan(v) | (F.abs(v) == F.lit(float("inf"))), None).otherwise(v)


def invalid_counts(entries: DataFrame) -> DataFrame:
    """Entries that are no counts: null, NaN, negative or with a fraction."""
    v = F.col("value")
    return entries.where(v.isNull() | F.isnan(v) | (v < 0) | (v != F.floor(v)))


def deviations(entries: DataFrame, matches: DataFrame) -> DataFrame:
    """(obs_id, motif, deviation): (observed - expected) / expected counts of the peaks (var_id) that a motif matches (motif, var_id).

    Expected: the observation's depth times the share of all counts in those peaks. Only pairs with an observed count have a
    row: every other pair of an observation and a matched motif has -1.
    """
    whole = entries.agg(F.sum("value").alias("s")).scalar()
    depth = entries.groupBy("obs_id").agg(F.sum("value").alias("depth"))
    hit = entries.join(matches.distinct(), "var_id")
    share = hit.groupBy("motif").agg(F.try_divide(F.sum("value"), whole).alias("share"))
    seen = hit.groupBy("obs_id", "motif").agg(F.sum("value").alias("observed"))
    x = seen.join(depth, "obs_id").join(share, "motif").withColumn("expected", F.col("depth") * F.col("share"))
    return x.select("obs_id", "motif", F.coalesce(F.try_divide(F.col("observed") - F.col("expected"), "expected"), F.lit(0.0)).alias("deviation"))
