"""Graphs, neighbours, similarity and small models."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparmat.session import materialize, scratch_table


# --- edges -----------------------------------------------------------------------------------------
def weighted_edges(edges: DataFrame, source_weights: DataFrame) -> DataFrame:
    """(src, dst, weight): edges (src, dst, source) summed by the weights (source, weight) of their sources; sources without one count 0."""
    return edges.join(source_weights, "source").groupBy("src", "dst").agg(F.sum("weight").alias("weight")).where("weight > 0")


def hub_correction(edges: DataFrame, h: float) -> DataFrame:
    """weight / indegree ** h."""
    deg = edges.groupBy("dst").agg(F.count(F.lit(1)).alias("_d"))
    return edges.join(deg, "dst").select("src", "dst", (F.col("weight") / F.pow(F.col("_d"), F.lit(h))).alias("weight"))


def row_normalized(edges: DataFrame) -> DataFrame:
    t = edges.groupBy("src").agg(F.sum("weight").alias("_t"))
    return edges.join(t, "src").select("src", "dst", F.coalesce(F.try_divide("weight", "_t"), F.lit(0.0)).alias("weight"))


def pagerank(edges: DataFrame, seeds: DataFrame, damping: float, steps: int, every: int = 4) -> DataFrame:
    """(node, rank) after ``steps`` of (1 - d) e + d P^T r from the normalised ``seeds`` (node, weight).

    Each step is a join and an aggregation; the lineage is cut by a checkpoint every few steps. Rank of
    nodes without out-edges is not passed on.
    """
    p = row_normalized(edges)
    e = seeds.select("node", F.try_divide("weight", seeds.agg(F.sum("weight").alias("s")).scalar()).alias("rank"))
    r = e
    for i in range(steps):
        flow = r.join(p, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node")).agg((damping * F.sum(F.col("rank") * F.col("weight"))).alias("rank"))
        r = flow.unionByName(e.select("node", ((1 - damping) * F.col("rank")).alias("rank"))).groupBy("node").agg(F.sum("rank").alias("rank"))
        if (i + 1) % every == 0 and i + 1 < steps:
            r = materialize(r)
    return r


def smooth_over_graph(edges: DataFrame, values: DataFrame, steps: int = 1, self_weight: float = 1.0) -> DataFrame:
    """(node, value): row-normalised edges with ``self_weight`` on the diagonal, applied ``steps`` times (moments, diffusion)."""
    loops = values.select(F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(self_weight).alias("weight"))
    p = row_normalized(edges.select("src", "dst", F.col("weight").cast("double").alias("weight")).unionByName(loops))
    v = values
    for _ in range(steps):
        v = p.join(v, F.col("dst") == F.col("node")).groupBy(F.col("src").alias("node")).agg(F.sum(F.col("weight") * F.col("value")).alias("value"))
    return v


def hops(edges: DataFrame, nodes: DataFrame, r: int) -> DataFrame:
    """(node, reached): nodes reached within ``r`` steps, themselves included."""
    out = nodes.select("node", F.col("node").alias("reached"))
    for _ in range(r):
        step = out.join(edges.select("src", "dst"), F.col("reached") == F.col("src")).select("node", F.col("dst").alias("reached"))
        out = out.unionByName(step).distinct()
    return out


def label_propagation(edges: DataFrame, nodes: DataFrame, steps: int) -> DataFrame:
    """(node, label): each step takes the label of the largest summed weight among the neighbours (ties to the smallest); an approximation of communities."""
    lab = nodes.select("node", F.col("node").alias("label"))
    for _ in range(steps):
        votes = edges.join(lab, F.col("dst") == F.col("node")).groupBy("src", "label").agg(F.sum("weight").alias("w"))
        best = votes.groupBy(F.col("src").alias("node")).agg(F.max_by("label", F.struct("w", -F.col("label"))).alias("new"))
        lab = lab.join(best, "node", "left").select("node", F.coalesce("new", "label").alias("label"))
    return lab


def connected_components(edges: DataFrame, nodes: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(node, component): smallest node reachable; each round contracts the graph and is written to the shared folder.

    Every node hooks to its smallest neighbour, the trees that arise are flattened by pointer jumping, and the edges
    between their roots are the next round's graph. Each node of a round meets at least one other, so a round at least
    halves them: the rounds, and the jumps within one, grow with the logarithm of the nodes. It ends when no edge is left;
    an error is raised if that takes more than ``most_rounds``. The driver only sees counts. Edges to nodes that are not in
    ``nodes`` do not count.
    """
    known = scratch_table(nodes.select("node").distinct(), "nodes")
    e = edges.select("src", "dst").where("src <> dst")
    for end in ("src", "dst"):
        e = e.join(known.select(F.col("node").alias(end)), end, "left_semi")
    e = scratch_table(e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct(), "edges")
    roots = known.select("node", F.col("node").alias("root"))
    rounds = 0
    while e.limit(1).count():
        if rounds == most_rounds:
            raise RuntimeError(f"connected_components: not converged after {most_rounds} rounds")
        rounds += 1
        near = scratch_table(e.groupBy("src").agg(F.min("dst").alias("up")), "hooks")
        # a chain of smallest neighbours ends in two nodes that name each other: the smaller is the root
        back = near.select(F.col("src").alias("up"), F.col("up").alias("back"))
        own = (F.col("back") == F.col("src")) & (F.col("src") < F.col("up"))
        up = scratch_table(near.join(back, "up").select("src", F.when(own, F.col("src")).otherwise(F.col("up")).alias("up")), "hooks")
        moved = 1
        while moved:
            top = up.select(F.col("src").alias("up"), F.col("up").alias("top"))
            jumped = scratch_table(up.join(top, "up").select("src", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved")), "hooks")
            moved = jumped.where("moved").limit(1).count()
            up = jumped.select("src", "up")
        roots = scratch_table(roots.join(up.withColumnRenamed("src", "root"), "root", "left").select("node", F.coalesce("up", "root").alias("root")), "roots")
        for end in ("src", "dst"):
            e = e.join(up.select(F.col("src").alias(end), F.col("up").alias(f"_{end}")), end).drop(end)
        e = scratch_table(e.where("_src <> _dst").select(F.col("_src").alias("src"), F.col("_dst").alias("dst")).distinct(), "edges")
    least = roots.groupBy("root").agg(F.min("node").alias("component"))
    return nodes.select("node").join(roots.join(least, "root").select("node", "component"), "node", "left")


# --- similarity --------------------------------------------------------------------------------------
def set_similarity(entries: DataFrame, item: str, feature: str, least_shared: int) -> DataFrame:
    """(a, b, shared, jaccard) of items that share features, a < b. Meant for features that few items share
    (their number is a feature of the data model, e.g. the lines of an order): pairs arise within a feature."""
    e = entries.select(item, feature).distinct()
    n = e.groupBy(item).agg(F.count(F.lit(1)).alias("n"))
    x = e.select(F.col(item).alias("a"), feature).join(e.select(F.col(item).alias("b"), feature), feature).where("a < b")
    s = x.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared")).where(F.col("shared") >= least_shared)
    s = s.join(n.select(F.col(item).alias("a"), F.col("n").alias("na")), "a").join(n.select(F.col(item).alias("b"), F.col("n").alias("nb")), "b")
    return s.select("a", "b", "shared", (F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))).alias("jaccard"))


def cosine_of_items(entries: DataFrame, least_shared: int) -> DataFrame:
    """(a, b, cosine) of variables over the observations they share (obs_id, var_id, value), a < b."""
    norm = entries.groupBy("var_id").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("n"))
    x = entries.select("obs_id", F.col("var_id").alias("a"), F.col("value").alias("x")).join(entries.select("obs_id", F.col("var_id").alias("b"), F.col("value").alias("y")), "obs_id").where("a < b")
    s = x.groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("d"), F.count(F.lit(1)).alias("k")).where(F.col("k") >= least_shared)
    s = s.join(norm.select(F.col("var_id").alias("a"), F.col("n").alias("na")), "a").join(norm.select(F.col("var_id").alias("b"), F.col("n").alias("nb")), "b")
    return s.select("a", "b", F.coalesce(F.try_divide("d", F.col("na") * F.col("nb")), F.lit(0.0)).alias("cosine"))


def idf_l2(entries: DataFrame, n_obs: Column) -> DataFrame:
    """value x ln(n / df) (df of n counts as n - 1), rows scaled to unit norm."""
    df = entries.groupBy("var_id").agg(F.count(F.lit(1)).alias("df"))
    w = entries.join(df, "var_id").withColumn("value", F.col("value") * F.coalesce(F.log(F.try_divide(n_obs, F.least(F.col("df"), n_obs - 1))), F.lit(0.0)))
    t = w.groupBy("obs_id").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("t"))
    return w.join(t, "obs_id").select("obs_id", "var_id", F.when(F.col("t") > 0, F.col("value") / F.col("t")).otherwise(0.0).alias("value"))


def _rows(col: pa.ChunkedArray | pa.Array) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), -1)


def _against_all(queries: DataFrame, data: DataFrame, fold: Callable[[pa.Table, pa.Table], pa.Table], schema: str, block_rows: int = 20_000) -> DataFrame:
    """A stated query set against all rows, in blocks: both sides (id, vec) are cut by a hash of the id, every block of
    queries meets every block of rows in a task of its own. Memory of a task is bounded by the two blocks."""
    nq, nd = (max(1, -(-x.count() // block_rows)) for x in (queries, data))
    grid = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = queries.select(F.col("id").alias("id"), F.col("vec").alias("vec")).withColumns({"bq": F.pmod(F.xxhash64("id"), F.lit(nq)).cast("int"), "bd": grid(nd)})
    d = data.select(F.col("id").alias("id"), F.col("vec").alias("vec")).withColumn("bd", F.pmod(F.xxhash64("id"), F.lit(nd)).cast("int")).withColumn("bq", grid(nq))
    return q.groupBy("bq", "bd").cogroup(d.groupBy("bq", "bd")).applyInArrow(fold, schema)


def knn_exact(queries: DataFrame, data: DataFrame, k: int) -> DataFrame:
    """(id, other, dist, rank): the k nearest other rows of each query by Euclidean distance, ties by id."""

    def fold(q: pa.Table, d: pa.Table) -> pa.Table:
        if not q.num_rows or not d.num_rows:
            return pa.table({"id": pa.array([], pa.int64()), "other": pa.array([], pa.int64()), "dist": pa.array([], pa.float64())})
        x, y, qi, di = _rows(q.column("vec")), _rows(d.column("vec")), q.column("id").to_numpy(), d.column("id").to_numpy()
        o = np.argsort(di, kind="stable")
        y, di = y[o], di[o]
        out: list[tuple] = []
        for i in range(0, len(x), 256):
            p = x[i : i + 256]
            g = np.maximum(0.0, (p * p).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * p @ y.T)
            g[qi[i : i + 256, None] == di[None, :]] = np.inf
            top = np.argsort(g, axis=1, kind="stable")[:, : k + 8]
            exact = np.sqrt(((p[:, None, :] - y[top]) ** 2).sum(2))  # without cancellation for the few that matter
            exact[np.isinf(np.take_along_axis(g, top, 1))] = np.inf
            for r in range(len(p)):
                order = np.lexsort((di[top[r]], exact[r]))[:k]
                out += [(qi[i + r], di[top[r][j]], exact[r][j]) for j in order if np.isfinite(exact[r][j])]
        a = list(zip(*out)) if out else [[], [], []]
        return pa.table({"id": pa.array(a[0], pa.int64()), "other": pa.array(a[1], pa.int64()), "dist": pa.array(a[2], pa.float64())})

    got = _against_all(queries, data, fold, "id bigint, other bigint, dist double")
    w = Window.partitionBy("id").orderBy("dist", "other")  # k rows a block
    return got.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def gaussian_connectivities(knn: DataFrame) -> DataFrame:
    """(id, other, weight): exp(-d^2 / (2 sigma^2)) with sigma the distance to the farthest listed neighbour."""
    s = knn.groupBy("id").agg(F.max("dist").alias("s"))
    return knn.join(s, "id").select("id", "other", F.when(F.col("s") > 0, F.exp(-F.col("dist") * F.col("dist") / (2 * F.col("s") * F.col("s")))).otherwise(1.0).alias("weight"))


def transition_probabilities(edges: DataFrame, scale: float) -> DataFrame:
    """(id, other, p): expm1(scale x cosine) of positive cosines, normalised per row."""
    e = edges.where("cosine > 0").withColumn("w", F.expm1(scale * F.col("cosine")))
    t = e.groupBy("id").agg(F.sum("w").alias("t"))
    return e.join(t, "id").select("id", "other", F.try_divide("w", "t").alias("p"))


def local_outlier_factor(queries: DataFrame, data: DataFrame, k: int) -> DataFrame:
    """(id, lof) of the queries among all rows, by definition; 1 where all neighbours are copies. Neighbour lists are searched only for the rows that
    the definition reaches: the queries, their neighbours, and the neighbours of these."""
    near = scratch_table(knn_exact(queries, data, k), "knn-0")
    second = data.join(near.select(F.col("other").alias("id")).distinct(), "id", "left_semi")
    near1 = scratch_table(knn_exact(second, data, k), "knn-1")
    third = data.join(near1.select(F.col("other").alias("id")).distinct(), "id", "left_semi")
    lists = scratch_table(near.unionByName(near1).unionByName(knn_exact(third, data, k)).distinct(), "knn-all")
    kd = lists.groupBy("id").agg(F.max("dist").alias("kd"))
    reach = lists.join(kd.select(F.col("id").alias("other"), "kd"), "other").withColumn("r", F.greatest("dist", "kd"))
    lrd = reach.groupBy("id").agg(F.try_divide(F.count(F.lit(1)), F.sum("r")).alias("lrd"))
    x = near.join(lrd.select(F.col("id").alias("other"), F.col("lrd").alias("lo")), "other").join(lrd, "id")
    return x.groupBy("id").agg(F.coalesce(F.try_divide(F.avg("lo"), F.first("lrd")), F.lit(1.0)).alias("lof"))


def kernel_density(queries: DataFrame, data: DataFrame, bandwidth: float) -> DataFrame:
    """(id, density): mean of exp(-d^2 / (2 h^2)) over all rows, the query itself included."""

    def fold(q: pa.Table, d: pa.Table) -> pa.Table:
        if not q.num_rows:
            return pa.table({"id": pa.array([], pa.int64()), "s": pa.array([], pa.float64()), "n": pa.array([], pa.int64())})
        x = _rows(q.column("vec"))
        s = np.zeros(len(x))
        if d.num_rows:
            y = _rows(d.column("vec"))
            for i in range(0, len(y), 2048):
                p = y[i : i + 2048]
                s += np.exp(-np.maximum(0, (x * x).sum(1)[:, None] + (p * p).sum(1)[None, :] - 2 * x @ p.T) / (2 * bandwidth**2)).sum(1)
        return pa.table({"id": q.column("id"), "s": pa.array(s), "n": pa.array(np.full(len(x), d.num_rows), pa.int64())})

    return _against_all(queries, data, fold, "id bigint, s double, n bigint").groupBy("id").agg((F.sum("s") / F.sum("n")).alias("density"))


# --- models ------------------------------------------------------------------------------------------
def principal_components(data: DataFrame, k: int) -> DataFrame:
    """(id, pcs): scores on the k first components of the centred vectors (id, vec).

    One pass folds each partition to its count, sums and products (dim x dim numbers); the small eigenproblem is
    solved on the driver and the projection is a second pass. Signs: the largest entry of a component is positive.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, c = 0, None, None
        for b in batches:
            if len(b):
                x = _rows(b.column("vec"))
                n, s, c = n + len(x), x.sum(0) if s is None else s + x.sum(0), x.T @ x if c is None else c + x.T @ x
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([s.tolist()]), pa.array([c.ravel().tolist()])], names=["n", "s", "c"])

    parts = data.select("vec").mapInArrow(fold, "n bigint, s array<double>, c array<double>").toPandas()  # one row a partition
    n, s = parts["n"].sum(), np.sum(np.stack(parts["s"]), axis=0)
    mean = s / n
    cov = np.sum(np.stack(parts["c"]), axis=0).reshape(len(s), -1) / n - np.outer(mean, mean)
    v = np.linalg.eigh(cov)[1][:, ::-1][:, :k]
    v = v * np.sign(v[np.abs(v).argmax(0), range(v.shape[1])])

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(((_rows(b.column("vec")) - mean) @ v).tolist(), pa.list_(pa.float64()))], names=["id", "pcs"])

    return data.select("id", "vec").mapInArrow(project, "id bigint, pcs array<double>")


def kmeans(data: DataFrame, k: int, steps: int) -> DataFrame:
    """(id, cluster, dist): Lloyd's iterations from farthest-first seeds among max(200, 4 k) rows drawn by a hash of the id.

    A pass folds each partition to k sums; the driver holds k centres. Empty clusters keep their centre.
    """
    seedable = _rows(data.orderBy(F.xxhash64("id"), "id").limit(max(200, 4 * k)).select("vec").toArrow().column("vec"))
    centres = [seedable[0]]
    while len(centres) < k:
        centres.append(seedable[np.min([((seedable - c) ** 2).sum(1) for c in centres], axis=0).argmax()])
    c = np.stack(centres)
    near = lambda x, c: ((x * x).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2 * x @ c.T)
    for _ in range(steps):

        def fold(batches: Iterator[pa.RecordBatch], c=c) -> Iterator[pa.RecordBatch]:
            n, s = np.zeros(k), np.zeros_like(c)
            for b in batches:
                if len(b):
                    x = _rows(b.column("vec"))
                    a = near(x, c).argmin(1)
                    n += np.bincount(a, minlength=k)
                    np.add.at(s, a, x)
            yield pa.RecordBatch.from_arrays([pa.array([n.tolist()]), pa.array([s.ravel().tolist()])], names=["n", "s"])

        parts = data.select("vec").mapInArrow(fold, "n array<double>, s array<double>").toPandas()
        n, s = np.sum(np.stack(parts["n"]), 0), np.sum(np.stack(parts["s"]), 0).reshape(c.shape)
        c = np.where(n[:, None] > 0, s / np.maximum(n, 1)[:, None], c)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                g = near(_rows(b.column("vec")), c)
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(g.argmin(1)), pa.array(np.sqrt(np.maximum(0, g.min(1))))], names=["id", "cluster", "dist"])

    return data.select("id", "vec").mapInArrow(label, "id bigint, cluster bigint, dist double")


def nmf(data: DataFrame, k: int, steps: int, inner: int = 20) -> tuple[DataFrame, np.ndarray]:
    """((id, usage), spectra): non-negative factors of non-negative vectors (id, vec) by multiplicative updates, started from the
    means of 50 k rows drawn by a hash of the id.

    The driver holds the k x dim spectra; usages are solved within the pass from the spectra, so no state of the rows is kept.
    """
    first = _rows(data.orderBy(F.xxhash64("id"), "id").limit(50 * k).select("vec").toArrow().column("vec"))
    h = np.stack([first[i::k].mean(0) for i in range(k)]) + 1e-6

    def usage(x: np.ndarray, h: np.ndarray) -> np.ndarray:
        w, hh, xh = np.full((len(x), len(h)), 1.0), h @ h.T, x @ h.T
        for _ in range(inner):
            w *= xh / np.maximum(w @ hh, 1e-12)
        return w

    for _ in range(steps):

        def fold(batches: Iterator[pa.RecordBatch], h=h) -> Iterator[pa.RecordBatch]:
            a, b = np.zeros((k, k)), np.zeros_like(h)
            for batch in batches:
                if len(batch):
                    x = _rows(batch.column("vec"))
                    w = usage(x, h)
                    a, b = a + w.T @ w, b + w.T @ x
            yield pa.RecordBatch.from_arrays([pa.array([a.ravel().tolist()]), pa.array([b.ravel().tolist()])], names=["a", "b"])

        p = data.select("vec").mapInArrow(fold, "a array<double>, b array<double>").toPandas()
        a, b = np.sum(np.stack(p["a"]), 0).reshape(k, k), np.sum(np.stack(p["b"]), 0).reshape(h.shape)
        h = h * b / np.maximum(a @ h, 1e-12)

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(usage(_rows(b.column("vec")), h).tolist(), pa.list_(pa.float64()))], names=["id", "usage"])

    return data.select("id", "vec").mapInArrow(out, "id bigint, usage array<double>"), h


def slope_through_origin(df: DataFrame, by: str, x: str, y: str, top_share: float | None = None) -> DataFrame:
    """gamma = sum(x y) / sum(x x) per group (null where all x are 0); with ``top_share`` only rows at or above that quantile of x + y."""
    d = df
    if top_share is not None:
        q = df.groupBy(by).agg(F.percentile(F.col(x) + F.col(y), top_share).alias("_q"))
        d = df.join(q, by).where(F.col(x) + F.col(y) >= F.col("_q"))
    return d.groupBy(by).agg(F.try_divide(F.sum(F.col(x) * F.col(y)), F.sum(F.col(x) * F.col(x))).alias("gamma"))


def moment_dispersions(m, factors: DataFrame) -> DataFrame:
    """(var_id, mean, dispersion): max(0, (s^2 - mean(1 / sf) mean) / mean^2) of size-factor normalised values, s^2 with n - 1, zeros counted.

    With one observation, or for a mean of 0, the dispersion is 0."""
    n = m.obs.agg(F.count(F.lit(1)).alias("n")).scalar()
    factors = factors.where("size_factor > 0")
    z = factors.agg(F.avg(1 / F.col("size_factor")).alias("z")).scalar()
    e = m.entries.join(factors, "obs_id").withColumn("x", F.col("value") / F.col("size_factor"))
    s = e.groupBy("var_id").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q")).withColumns({"n": n, "z": z})
    mean = F.col("s") / F.col("n")
    var = F.try_divide(F.col("q") - F.col("n") * mean * mean, F.col("n") - 1)
    return s.select("var_id", mean.alias("mean"), F.greatest(F.lit(0.0), F.try_divide(var - F.col("z") * mean, mean * mean)).alias("dispersion"))


def negative_binomial_fit(counts: DataFrame, steps: int = 30) -> DataFrame:
    """(var_id, intercept, lfc, lfc_se): log-linear fit with one two-level factor per variable by reweighted least squares.

    ``counts``: (var_id, y, size_factor, x, dispersion), one row per sample of a design; a group is a design,
    never raw observations. lfc is in log2.
    """

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        y, off, a = pdf["y"].to_numpy(float), np.log(pdf["size_factor"].to_numpy(float)), float(pdf["dispersion"].iloc[0])
        d = np.column_stack([np.ones(len(pdf)), pdf["x"].to_numpy(float)])
        beta = np.array([np.log(max(1e-8, (y / np.exp(off)).mean())), 0.0])
        for _ in range(steps):
            mu = np.exp(np.clip(d @ beta + off, -30, 30))
            w = mu / (1 + a * mu)
            z = d @ beta + (y - mu) / np.maximum(mu, 1e-12)
            g = d.T @ (w[:, None] * d) + 1e-6 * np.eye(2)
            new = np.linalg.solve(g, d.T @ (w * z))
            done, beta = np.abs(new - beta).max() < 1e-9, new
            if done:
                break
        se = np.sqrt(np.diag(np.linalg.inv(g)))
        return pd.DataFrame({"var_id": pdf["var_id"].iloc[:1], "intercept": [beta[0]], "lfc": [beta[1] / np.log(2)], "lfc_se": [se[1] / np.log(2)]})

    kind = {f.name: f.dataType.simpleString() for f in counts.schema.fields}["var_id"]
    return counts.groupBy("var_id").applyInPandas(fit, f"var_id {kind}, intercept double, lfc double, lfc_se double")


def simulate_doublets(entries: DataFrame, obs: DataFrame, ratio: int, seed: int = 3) -> DataFrame:
    """(doublet, var_id, value): sums of two observations paired by hashes of (observation, copy); ``ratio`` per observation.

    The partner is the next observation in the order of a hash within a bucket of about 1,000, after the last the first, so no
    global sort is needed. A doublet's name is its two observations and the copy: two copies may pair them alike.
    """
    o = obs.select("obs_id", F.explode(F.sequence(F.lit(1), F.lit(ratio))).alias("copy"))
    o = o.withColumn("_h", F.xxhash64("obs_id", "copy", F.lit(seed)))
    buckets = F.greatest(F.lit(1), F.floor(obs.agg(F.count(F.lit(1)).alias("n")).scalar() / 1000))
    w = Window.partitionBy("copy", "_b").orderBy("_h", "obs_id")
    p = o.withColumn("_b", F.pmod(F.col("_h"), buckets)).withColumn("partner", F.coalesce(F.lead("obs_id").over(w), F.first("obs_id").over(w))).where("partner <> obs_id")
    name = F.concat(F.concat_ws("+", F.col("obs_id").cast("string"), F.col("partner").cast("string")), F.lit("#"), F.col("copy").cast("string"))
    p = p.select(name.alias("doublet"), F.array("obs_id", "partner").alias("_m"))
    m = p.select("doublet", F.explode("_m").alias("obs_id"))
    return m.join(entries, "obs_id").groupBy("doublet", "var_id").agg(F.sum("value").alias("value"))


