"""Every operator that divides, on one observation, one group, constant and empty data: a result, never an error."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sparmat.model import Matrix
from sparmat.operators import aggregate as A
from sparmat.operators import extras as X
from sparmat.operators import genome as G
from sparmat.operators import graph as H
from sparmat.operators import ligand_receptor as L
from sparmat.operators import normalize as N
from sparmat.operators import ranks as K

CASES = {
    "one observation": ([(1, 1, 2.0), (1, 2, 0.0)], [(1, "a")], [1, 2]),
    "one group, constant": ([(i, v, 3.0) for i in (1, 2, 3) for v in (1, 2)], [(1, "a"), (2, "a"), (3, "a")], [1, 2]),
    "a group of one, a zero total": ([(1, 1, 2.0), (2, 1, 0.0), (3, 1, 0.0), (3, 2, 5.0)], [(1, "a"), (2, "b"), (3, "b"), (4, None)], [1, 2, 3]),
    "no entries": ([], [(1, "a"), (2, "b")], [1, 2]),
    "nothing": ([], [], []),
}
OPERATORS = {
    "welch_markers": lambda m: A.welch_markers(m, "grp"),
    "pseudobulk": lambda m: A.pseudobulk(m, "grp", True),
    "grouped_rates": lambda m: A.grouped_rates(m, "grp", F.lit(0)),
    "aggregate_var": lambda m: A.aggregate_var(m, "kind"),
    "qc_metrics": lambda m: A.qc_metrics(m, F.lit(True)),
    "size_factors": lambda m: A.size_factors(m),
    "auroc": lambda m: A.auroc(m.entries.withColumn("y", F.lit(True)), "value", "y"),
    "expansion": lambda m: A.expansion(A.clone_matrix(m.obs, "obs_id", "grp"), "obs_id", "grp"),
    "plasticity": lambda m: A.plasticity(A.clone_matrix(m.obs, "obs_id", "grp"), "obs_id", "grp"),
    "pairwise_transition": lambda m: A.pairwise_transition(A.clone_matrix(m.obs, "obs_id", "grp"), "obs_id", "grp", "a"),
    "normalize_total": N.normalize_total,
    "clr": N.clr,
    "zscore": N.zscore,
    "dispersion_bins": N.dispersion_bins,
    "stable_variables": lambda m: N.stable_variables(m, 3, 0.0),
    "moment_dispersions": lambda m: H.moment_dispersions(m, m.obs.select("obs_id", F.lit(1.0).alias("size_factor"))),
    "idf_l2": lambda m: H.idf_l2(m.entries, m.obs.agg(F.count(F.lit(1)).alias("n")).scalar()),
    "cosine_of_items": lambda m: H.cosine_of_items(m.entries, 1),
    "slope": lambda m: H.slope_through_origin(m.entries.withColumn("x", F.lit(0.0)), "obs_id", "x", "value", 0.9),
    "row_normalized": lambda m: H.row_normalized(m.entries.select(F.col("obs_id").alias("src"), F.col("var_id").alias("dst"), F.lit(0.0).alias("weight"))),
    "lr_score": lambda m: L.score(m, "grp", m.var.select(F.col("var_id").alias("ligand"), F.col("var_id").alias("receptor")), 0.0),
    "layer_shares": lambda m: X.layer_shares(m.entries.withColumn("b", F.lit(0.0)), "obs_id", ["value", "b"]),
    "ambient_profile": lambda m: X.ambient_profile(m, -1, 100),
    "describe": lambda m: X.describe(m.entries, ["obs_id"], "value"),
    "top_mask": lambda m: X.top_mask(m.entries, "obs_id", "value", 0.1),
    "running_enrichment": lambda m: K.running_enrichment(m.entries.withColumn("g", F.lit(1)), m.var.select(F.lit("s").alias("set"), "var_id"), "g", "value"),
    "recovery_auc": lambda m: K.recovery_auc(K.rankings(m.entries), m.var.select(F.lit("s").alias("set"), "var_id", F.lit(0.0).alias("weight")), 2),
    "gene_set_score": lambda m: K.gene_set_score(m, m.var.select("var_id"), 2),
    "two_by_two": lambda m: K.two_by_two(m.obs, "grp", F.lit(True), F.lit(False)),
    "binned_trend": lambda m: K.binned_trend(m.entries, "obs_id", F.col("value"), "value", 3),
    "expression_entropy": K.expression_entropy,
    "trimmed_mean": lambda m: K.trimmed_mean(m.entries, "obs_id", "value", "var_id", 0.25),
    "bh": lambda m: K.benjamini_hochberg(m.entries, "value", ["obs_id"]),
    "spearman": lambda m: K.spearman(m.entries.withColumn("z", F.lit(1.0)), "obs_id", "value", "z"),
    "scale_track": lambda m: G.scale_track(m.entries.select(F.lit("c").alias("chrom"), F.lit(0).alias("start"), F.lit(0).alias("end"), (F.col("value") * 0).alias("value")), [], "bpm"),
    "scale_track_cpm": lambda m: G.scale_track(m.entries.select(F.lit("c").alias("chrom"), F.lit(0).alias("start"), F.lit(0).alias("end"), (F.col("value") * 0).alias("value")), ["chrom"], "cpm"),
}


@pytest.fixture(scope="module", params=list(CASES))
def matrix(request, spark):
    entries, obs, var = CASES[request.param]
    return Matrix(
        spark.createDataFrame(entries, "obs_id bigint, var_id bigint, value double"),
        spark.createDataFrame(obs, "obs_id bigint, grp string"),
        spark.createDataFrame([(v, "k") for v in var], "var_id bigint, kind string"),
    )


@pytest.mark.parametrize("name", list(OPERATORS))
def test_no_division_by_zero(matrix, name):
    rows = OPERATORS[name](matrix).collect()
    for r in rows:
        assert all(x is None or not isinstance(x, float) or x == x for x in r)
