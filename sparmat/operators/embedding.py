"""Embeddings of sparse matrices and scores that rest on them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparmat.operators.graph import idf_l2, knn_exact
from sparmat.session import ranked, scratch_table


def spectral_embedding(entries: DataFrame, obs: DataFrame, k: int, steps: int = 12) -> DataFrame:
    """(obs_id, vec): the k leading eigenvectors of the normalised similarity D^-1/2 X X' D^-1/2, scaled by their eigenvalues.

    X: idf-weighted rows of unit length. The similarity is never formed: a step of the block power iteration is a product with X' and
    one with X, two joins and aggregations of k sums; the driver orthogonalises by a k x k matrix. Start vectors are hashes of the
    observation. The signs are such that the sum of cubes is positive. Observations without weighted entries have no row.
    """
    x = idf_l2(entries, obs.agg(F.count(F.lit(1)).alias("n")).scalar()).where("value <> 0")
    x = scratch_table(x, "idf")
    col = x.groupBy("var_id").agg(F.sum("value").alias("c"))
    deg = scratch_table(x.join(col, "var_id").groupBy("obs_id").agg(F.sum(F.col("value") * F.col("c")).alias("d")).where("d > 0"), "degrees")
    w = scratch_table(x.join(deg, "obs_id").select("obs_id", "var_id", (F.col("value") / F.sqrt("d")).alias("w")), "normalised")
    q = [f"q{i}" for i in range(k)]
    v = deg.select("obs_id", *[(F.pmod(F.xxhash64("obs_id", F.lit(i)), F.lit(1_000_003)) / 1_000_003.0 - (0.0 if i == 0 else 0.5)).alias(c) for i, c in enumerate(q)])
    gram = lambda d: np.array([d.agg(*[F.sum(F.col(a) * F.col(b)) for a in q for b in q]).first()], dtype=float).reshape(k, k)

    def rotate(d: DataFrame, m: np.ndarray) -> DataFrame:
        return d.select("obs_id", *[sum((F.col(a) * float(m[i, j]) for i, a in enumerate(q)), F.lit(0.0)).alias(c) for j, c in enumerate(q)])

    def orthonormal(d: DataFrame) -> DataFrame:
        e, u = np.linalg.eigh(gram(d))
        return rotate(d, u @ np.diag(1 / np.sqrt(np.maximum(e, 1e-300))))

    def times(d: DataFrame) -> DataFrame:
        s = w.join(d, "obs_id").groupBy("var_id").agg(*[F.sum(F.col("w") * F.col(c)).alias(c) for c in q])
        return scratch_table(w.join(s, "var_id").groupBy("obs_id").agg(*[F.sum(F.col("w") * F.col(c)).alias(c) for c in q]), "power")

    if deg.isEmpty():
        return obs.select("obs_id", F.array().cast("array<double>").alias("vec")).limit(0)
    v = orthonormal(scratch_table(v, "power"))
    for _ in range(steps):
        y = times(v)
        v = orthonormal(y)
    v = scratch_table(v, "power")
    both = v.join(times(v).select("obs_id", *[F.col(c).alias(f"a{c}") for c in q]), "obs_id")
    small = np.array([both.agg(*[F.sum(F.col(a) * F.col(f"a{b}")) for a in q for b in q]).first()], dtype=float).reshape(k, k)
    e, u = np.linalg.eigh((small + small.T) / 2)
    out = rotate(v, u[:, ::-1])
    signs = out.agg(*[F.sum(F.col(c) * F.col(c) * F.col(c)) for c in q]).first()
    scale = [float(lam) * (1.0 if s >= 0 else -1.0) for lam, s in zip(e[::-1], signs)]
    return out.select("obs_id", F.array(*[F.col(c) * s for c, s in zip(q, scale)]).alias("vec"))


def doublet_scores(data: DataFrame, queries: DataFrame, k: int, rate: float = 0.1) -> DataFrame:
    """(id, simulated, score): likelihood of being a doublet from the share of simulated doublets among the nearest neighbours.

    ``data`` (id, vec). As many doublets are simulated as there are rows: the mean of a row and the next one in the order of an MD5 of
    the id. Of a query's 2 k nearest among rows and doublets, itself left out, the share q = (simulated + 1) / (2 k + 2) gives
    q rate / (1 - rate - q (1 - 2 rate)). Queries are a stated set, held against all rows in blocks.
    """
    n = data.count()
    place = ranked(data.select("id", "vec").withColumn("_h", F.md5(F.col("id").cast("string"))), [], ["_h", "id"], "r")
    place = scratch_table(place.select("id", "vec", "r"), "places")
    after = place.select((F.when(F.col("r") == 1, n).otherwise(F.col("r") - 1)).alias("r"), F.col("vec").alias("_v"))
    mean = F.zip_with(F.col("vec"), F.col("_v"), lambda a, b: (a.cast("double") + b.cast("double")) / 2)
    sim = place.join(after, "r").select((-F.col("r")).alias("id"), mean.alias("vec"))
    top = place.agg(F.min("id")).first()[0]
    if top is not None and top < 0:
        raise ValueError("doublet_scores: ids must not be negative, negative ones name the simulated doublets")
    every = scratch_table(place.select(F.col("id").cast("bigint").alias("id"), F.transform("vec", lambda x: x.cast("double")).alias("vec")).unionByName(sim), "with-doublets")
    near = knn_exact(queries.select(F.col("id").cast("bigint").alias("id"), F.transform("vec", lambda x: x.cast("double")).alias("vec")), every, 2 * k)
    s = near.groupBy("id").agg(F.count(F.when(F.col("other") < 0, 1)).alias("simulated"))
    q = (F.col("simulated") + 1) / (2 * k + 2)
    return s.select("id", "simulated", (q * rate / (1 - rate - q * (1 - 2 * rate))).alias("score"))
