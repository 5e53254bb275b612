"""Queries of the llm problems 2 (mapping), 4 (clusters), 5 (percentiles) and 6 (similar vectors)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparmat.llm import clusters, neighbours
from sparmat.llm.mapping import map_to_genes
from sparmat.llm.quantiles import exact_percentiles, merge_sketches, sketch, sketch_percentiles
from sparmat.llm.vectors import usable
from sparmat.session import current, scratch_table, table

FRACTIONS = (0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99)


def _sample_key(c: str):
    return F.lower(F.regexp_replace(F.col(c), r"(?U)^\s+|\s+$", ""))


def _current_obs(spark: SparkSession, d: str) -> DataFrame:
    """Current obs rows with n_umi >= 0 and a sample of metadata, written once to the shared folder.

    metadata is a fixed table of 27 rows; its distinct samples are broadcast on that bound.
    """
    known = table(spark, d, "metadata").select(_sample_key("sample").alias("sample")).where("sample IS NOT NULL").distinct()
    rows = table(spark, d, "obs").select("obs_id", _sample_key("sample").alias("sample"), F.to_date("run_at").alias("day"), "n_umi", "loaded_at")
    rows = current(rows, ["obs_id"]).where("n_umi >= 0").join(F.broadcast(known), "sample", "left_semi")
    return scratch_table(rows.select("obs_id", "sample", "day", "n_umi"), "obs-current")


#: Section size of the sketches behind an exact search: their brackets hold a few percent of the rows.
FINE = 128


def _day_sketches(obs: DataFrame, k: int = 32) -> DataFrame:
    return sketch(obs, ["sample", "day"], "n_umi", k)


def _exact(obs: DataFrame, fractions: tuple[float, ...]) -> DataFrame:
    brackets = scratch_table(sketch_percentiles(merge_sketches(_day_sketches(obs, FINE), ["sample"], FINE), ["sample"], fractions, FINE), "percentile-brackets")
    # one row per sample of metadata (fixed, 27 rows) and fraction: a proven bound for the broadcast
    return exact_percentiles(obs.select("sample", "n_umi"), ["sample"], "n_umi", F.broadcast(brackets))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    obs = _current_obs(spark, d)
    exact = _exact(obs, (0.1, 0.9))
    limits = exact.groupBy("sample").agg(
        F.max(F.when(F.col("fraction") == 0.1, F.col("percentile"))).alias("p10"), F.max(F.when(F.col("fraction") == 0.9, F.col("percentile"))).alias("p90")
    )
    return obs.join(F.broadcast(limits), "sample").where("n_umi > 6 * p90 OR 6 * n_umi < p10").select("obs_id")


def p5_sample_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Approximate percentiles per sample, merged from the sketches of its run days; no rank is off by more than ``rank_error``."""
    merged = merge_sketches(_day_sketches(_current_obs(spark, d)), ["sample"])
    return sketch_percentiles(merged, ["sample"], FRACTIONS).select("sample", "n", "fraction", "percentile", F.col("error").alias("rank_error"))


def p5_sample_percentiles_exact(spark: SparkSession, d: str) -> DataFrame:
    return _exact(_current_obs(spark, d), FRACTIONS).select("sample", "n", "fraction", F.col("percentile").cast("bigint").alias("percentile"))


DIM = 32
UMAP_REACH = 2.5


def _clustered(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(cells with a usable vector and their cluster, cells placed by umap only)."""
    cells = scratch_table(
        current(table(spark, d, "obsm"), ["obs_id"]).select(
            "obs_id", "spectral", F.when(usable_umap("umap"), F.col("umap").cast("array<double>")).alias("umap"), usable(F.col("spectral"), DIM).alias("ok")
        ),
        "obsm-current",
    )
    points = clusters.prepare(cells.where("ok"), DIM, "spectral", ["obs_id", "umap"])
    dirs = clusters.fit(points, DIM).dirs
    members = clusters.assign(points, dirs, DIM, ["obs_id", "umap"])
    # one row per cluster; the driver already holds a direction for each
    means = members.groupBy("cluster").agg(F.avg(F.col("umap")[0]).alias("mx"), F.avg(F.col("umap")[1]).alias("my")).where("mx IS NOT NULL")
    rest = cells.where("NOT ok AND umap IS NOT NULL").select("obs_id", "umap")
    gap = F.sqrt(F.pow(F.col("umap")[0] - F.col("mx"), 2) + F.pow(F.col("umap")[1] - F.col("my"), 2))
    # a grid of cells as wide as the reach turns the search into an equality join
    side = lambda c, name: F.floor(c / UMAP_REACH).alias(name)
    around = F.explode(F.expr("transform(sequence(0, 8), i -> struct(i div 3 - 1 AS dx, i % 3 - 1 AS dy))"))
    means = means.select("*", side(F.col("mx"), "gx"), side(F.col("my"), "gy"), around.alias("o"))
    means = means.select("cluster", "mx", "my", (F.col("gx") + F.col("o.dx")).alias("gx"), (F.col("gy") + F.col("o.dy")).alias("gy"))
    near = rest.select("*", side(F.col("umap")[0], "gx"), side(F.col("umap")[1], "gy")).join(means, ["gx", "gy"]).where(gap < UMAP_REACH)
    return members, near.groupBy("obs_id").agg(F.min_by("cluster", gap).alias("cluster"))


def usable_umap(c: str):
    return (F.size(c) == 2) & F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    members, by_umap = _clustered(spark, d)
    rows = scratch_table(members.select("obs_id", "cluster").unionByName(by_umap), "clustered")
    first = rows.groupBy("cluster").agg(F.min("obs_id").alias("first_obs_id"))
    return rows.join(first, "cluster").select("obs_id", "first_obs_id")


def p4_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Size and smallest id count the cells placed by umap too; typical cells are those with a vector."""
    members, by_umap = _clustered(spark, d)
    t = clusters.typical(members, "obs_id", 5, by_umap)
    spread = [F.round(c, 6).alias(c) for c in ("mean_dist", "max_dist")]
    return t.select(F.col("first_id").alias("first_obs_id"), F.col("size").alias("cells"), *spread, F.col("typical").alias("typical_obs_ids"))


def _cells(spark: SparkSession, d: str) -> DataFrame:
    """Current obsm rows with 32 finite numbers, not all zero, scaled to length 1: (id, vec)."""
    rows = current(table(spark, d, "obsm").select("obs_id", "spectral", "loaded_at"), ["obs_id"]).where(usable(F.col("spectral"), DIM))
    return clusters.prepare(rows.select(F.col("obs_id").alias("id"), "spectral"), DIM, "spectral", ["id"])


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    near = neighbours.nearest_rows(_cells(spark, d), DIM, 5, least_cos=0.9995)
    return near.select(F.least("id", "other").alias("obs_a"), F.greatest("id", "other").alias("obs_b")).distinct()


def p6_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Queries: the cells whose obs_id is divisible by 50, against all cells."""
    near = neighbours.nearest_rows(_cells(spark, d), DIM, 5, pick=F.col("id") % 50 == 0)
    return near.select(F.col("id").alias("obs_id"), F.col("other").alias("neighbour"), "rank", F.round("cos", 6).alias("cosine"))


def p6_recall(spark: SparkSession, d: str) -> DataFrame:
    """Leaves that p6_neighbours visits, the recall of its calibration queries and of as many held-out ones, against all cells."""
    v = neighbours.recall_of(_cells(spark, d), DIM, 5, pick=F.col("id") % 50 == 0)
    return spark.createDataFrame([(v.leaves, v.sub_leaves, v.recall, v.held_out)], "leaves bigint, sub_leaves bigint, calibration_recall double, held_out_recall double")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return map_to_genes(table(spark, d, "transcript"), table(spark, d, "genes"), ["tx_row_id"]).select("tx_row_id", "uid")


def p2_misses(spark: SparkSession, d: str) -> DataFrame:
    """Typed values that stand for no entry, with the rows that hold them."""
    rows = map_to_genes(table(spark, d, "transcript"), table(spark, d, "genes"), ["tx_row_id"]).where("uid = 'none'")
    return rows.groupBy("gene_name", "gene_id").agg(F.count(F.lit(1)).alias("n_rows"))


QUERIES = {f.__name__: f for f in (p2_found, p2_misses, p4_found, p4_clusters, p5_found, p5_sample_percentiles, p5_sample_percentiles_exact, p6_found, p6_neighbours, p6_recall)}

_P5 = r"""
WITH k AS (SELECT DISTINCT lower(regexp_replace(sample, '^\s+|\s+$', '', 'g')) AS sample FROM metadata WHERE sample IS NOT NULL),
c AS (SELECT obs_id, lower(regexp_replace(sample, '^\s+|\s+$', '', 'g')) AS sample, n_umi FROM obs
      QUALIFY row_number() OVER (PARTITION BY obs_id ORDER BY loaded_at DESC) = 1),
o AS (SELECT * FROM c WHERE n_umi >= 0 AND sample IN (SELECT sample FROM k))
"""
ORACLE = {
    "p6_found": """WITH c AS (SELECT obs_id, spectral::DOUBLE[] AS v FROM obsm QUALIFY row_number() OVER (PARTITION BY obs_id ORDER BY loaded_at DESC) = 1),
u AS (SELECT * FROM c WHERE len(v) = 32 AND len([x for x in v if x IS NULL OR NOT isfinite(x)]) = 0 AND len([x for x in v if x <> 0]) > 0),
p AS (SELECT a.obs_id AS a, b.obs_id AS b, list_cosine_similarity(a.v, b.v) AS c FROM u a, u b WHERE a.obs_id <> b.obs_id), t AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY a ORDER BY c DESC, b) <= 5)
SELECT DISTINCT least(a, b) AS obs_a, greatest(a, b) AS obs_b FROM t WHERE c >= 0.9995""",
    "p5_found": _P5
    + """, l AS (SELECT sample, quantile_disc(n_umi, 0.1) AS p10, quantile_disc(n_umi, 0.9) AS p90 FROM o GROUP BY 1)
SELECT obs_id FROM o JOIN l USING (sample) WHERE n_umi > 6 * p90 OR 6 * n_umi < p10""",
    "p5_sample_percentiles_exact": _P5
    + ", q AS (SELECT sample, count(*) AS n, "
    + f"quantile_disc(n_umi, {list(FRACTIONS)}) AS v, {list(FRACTIONS)}::DOUBLE[] AS f FROM o GROUP BY 1) "
    + "SELECT sample, n, unnest(f) AS fraction, unnest(v) AS percentile FROM q",
}
