"""Most similar vectors through a hierarchical k-means tree.

The tree is fitted by recursive two-means on a bounded, documented sample; every row is then indexed in
its leaf, and a leaf that holds many more rows than planned gets a subtree fitted on its own rows, so bins stay small
however large the table. A split is the plane between the two means; the distance of a query from a plane bounds
its distance to everything behind it. Queries visit bins best first through a priority queue ordered by
the largest such bound on the way. A search for the k nearest widens the number of visits until the recall of a
calibration set (held against all rows) reaches its target, and reports the recall of a second, held-out set; a search
for all rows within a radius visits every bin whose bound is within it, which finds all of them.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparmat.llm.vectors import matrix
from sparmat.session import scratch_table


@dataclass
class Tree:
    """normals/offsets per inner node; kids: >= 0 inner node, < 0 leaf -(kid + 1). leaves: number of bins."""

    normals: np.ndarray
    offsets: np.ndarray
    kids: np.ndarray
    leaves: int

    @classmethod
    def fit(cls, x: np.ndarray, leaf_rows: int) -> Tree:
        normals, offsets, kids, leaves = [], [], [], 0
        stack = [(np.arange(len(x)), -1, 0)]
        while stack:
            idx, parent, slot = stack.pop()
            node = cls._split(x[idx]) if len(idx) > leaf_rows else None
            if node is None:
                code, leaves = -(leaves + 1), leaves + 1
            else:
                normal, cut, left = node
                code = len(normals)
                normals.append(normal)
                offsets.append(cut)
                kids.append([0, 0])
                stack += [(idx[left], code, 0), (idx[~left], code, 1)]
            if parent >= 0:
                kids[parent][slot] = code
        dim = x.shape[1]
        return cls(np.array(normals).reshape(-1, dim), np.array(offsets), np.array(kids, dtype=np.int64).reshape(-1, 2), max(1, leaves))

    @staticmethod
    def _split(x: np.ndarray):
        """Two-means from the main axis: (normal, offset, rows on the first side); None for copies of one vector."""
        d = x - x.mean(axis=0)
        w, v = np.linalg.eigh(d.T @ d)
        if w[-1] <= 1e-9 * len(x):
            return None
        side = d @ v[:, -1] > 0
        for _ in range(8):
            if side.all() or not side.any():
                return None
            a, b = d[side].mean(axis=0), d[~side].mean(axis=0)
            again = d @ (a - b) > (a @ a - b @ b) / 2
            if (again == side).all():
                break
            side = again
        if side.all() or not side.any():
            return None
        a, b = x[side].mean(axis=0), x[~side].mean(axis=0)
        length = np.linalg.norm(a - b)
        if length < 1e-9:
            return None
        normal = (a - b) / length
        cut = float(normal @ (a + b) / 2)
        left = x @ normal > cut
        return None if left.all() or not left.any() else (normal, cut, left)

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), dtype=np.int64)
        stack = [(0, np.arange(len(x)))] if len(self.normals) else []
        while stack:
            node, idx = stack.pop()
            left = x[idx] @ self.normals[node] > self.offsets[node]
            for kid, part in zip(self.kids[node].tolist(), (idx[left], idx[~left])):
                if kid < 0:
                    out[part] = -kid - 1
                elif len(part):
                    stack.append((kid, part))
        return out

    def visits(self, x: np.ndarray, most: int, reach: float) -> Iterator[list[int]]:
        """Bins of each row of ``x`` best first: at most ``most``, none whose bound is beyond ``reach``."""
        if not len(self.normals):
            yield from ([0] for _ in range(len(x)))
            return
        kids = self.kids.tolist()
        for i in range(0, len(x), 2048):
            for margins in (x[i : i + 2048] @ self.normals.T - self.offsets).tolist():
                heap, out = [(0.0, 0)], []
                while heap and len(out) < most:
                    bound, node = heapq.heappop(heap)
                    while node >= 0:
                        m = margins[node]
                        near, far = kids[node] if m > 0 else kids[node][::-1]
                        other = max(bound, abs(m))
                        if other <= reach:
                            heapq.heappush(heap, (other, far))
                        node = near
                    out.append(-node - 1)
                yield out

    def row(self) -> tuple[list, list, list, int]:
        return self.normals.ravel().tolist(), self.offsets.tolist(), self.kids.ravel().tolist(), self.leaves

    @classmethod
    def of_row(cls, normals: list, offsets: list, kids: list, leaves: int) -> Tree:
        n = np.array(normals, dtype=np.float64).reshape(len(offsets), -1)
        return cls(n, np.array(offsets, dtype=np.float64), np.array(kids, dtype=np.int64).reshape(-1, 2), leaves)


def _share(rows: Column | float, wanted: float) -> Column:
    """Condition that keeps about ``wanted`` of ``rows`` rows: a hash of the vector decides, the same on a repeated run."""
    return F.pmod(F.xxhash64("vec"), F.lit(1_000_003)) < F.ceil(F.lit(1_000_003.0) * F.least(F.lit(1.0), F.lit(float(wanted)) / rows))


def fit_tree(points: DataFrame, dim: int, sample_rows: int = 50_000, leaf_rows: int = 3000) -> Tree:
    """First-level tree, fitted on a sample of at most about ``sample_rows`` rows (rows of the smallest hash of the vector).

    Bins hold about ``leaf_rows`` rows of the whole table, but no fewer than 16 of the sample: at most about sample_rows / 16 bins,
    so the broadcast tree is bounded; ``subtrees`` divide what is still crowded.
    """
    total = points.count()
    sample = points.where(_share(F.lit(float(max(1, total))), sample_rows)).select("vec").limit(2 * sample_rows).toArrow()
    x = matrix(sample.column("vec"), dim) if sample.num_rows else np.zeros((0, dim))
    share = min(1.0, sample_rows / max(1, total))
    return Tree.fit(x, int(max(16.0 if share < 1 else 1.0, leaf_rows * share)))


@dataclass
class Index:
    """rows: (id, vec, leaf, sub, blocks, block); sizes: (leaf, sub, blocks), one row a bin; tree: broadcast first level; subs: (leaf, n, normals, offsets, kids, leaves) of the
    crowded leaves, or None; chunk: rows or queries that meet a subtree in one task."""

    rows: DataFrame
    tree: object
    subs: DataFrame | None
    dim: int
    chunk: int = 20_000
    sizes: DataFrame | None = None


_SUB = "leaf bigint, n bigint, normals array<double>, offsets array<double>, kids array<bigint>, leaves bigint"


def _subtrees(rows: DataFrame, dim: int, leaf_rows: int, crowd_rows: int, sample_rows: int) -> DataFrame | None:
    """A tree for every leaf of more than ``crowd_rows`` rows, fitted on at most about ``sample_rows`` rows of the leaf."""
    crowded = scratch_table(rows.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > crowd_rows), "crowded")
    if crowded.isEmpty():
        return None

    def fit(t: pa.Table) -> pa.Table:
        n = t.column("n")[0].as_py()
        x = matrix(t.column("vec"), dim)
        tree = Tree.fit(x[np.lexsort(x.T)], int(max(16.0 if n > sample_rows else 1.0, leaf_rows * min(1.0, sample_rows / n))))
        normals, offsets, kids, leaves = tree.row()
        f, b = pa.list_(pa.float64()), pa.list_(pa.int64())
        return pa.table({"leaf": t.column("leaf")[:1], "n": [n], "normals": pa.array([normals], f), "offsets": pa.array([offsets], f), "kids": pa.array([kids], b), "leaves": [leaves]})

    sample = rows.join(crowded, "leaf").where(_share(F.col("n").cast("double"), sample_rows)).select("leaf", "n", "vec")
    return scratch_table(sample.groupBy("leaf").applyInArrow(fit, _SUB), "subtrees")


def _through_subtrees(ix: Index, rows: DataFrame, most: int | None, reach: float) -> DataFrame:
    """(id, vec, leaf, sub, place): rows (id, vec, leaf) in their bin (``most`` None), or sent to at most ``most`` bins, best first.

    Rows of a crowded leaf meet its subtree in chunks, by a hash of the id, so no task holds a leaf.
    """
    if ix.subs is None:
        return rows.select("id", "vec", "leaf", F.lit(0).cast("bigint").alias("sub"), F.lit(1).cast("bigint").alias("place"))
    dim = ix.dim
    chunks = F.ceil(F.col("n") / ix.chunk) * (1 if most is None else 8)
    size = ix.subs.select("leaf", chunks.alias("chunks"))
    plain = rows.join(size, "leaf", "left_anti").select("id", "vec", "leaf", F.lit(0).cast("bigint").alias("sub"), F.lit(1).cast("bigint").alias("place"))
    cut = rows.join(size, "leaf").withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks"))).select("leaf", "chunk", "id", "vec")
    trees = ix.subs.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), chunks - 1)))

    def route(q: pa.Table, t: pa.Table) -> pa.Table:
        if not q.num_rows:
            return pa.table({"id": pa.array([], pa.int64()), "vec": pa.array([], pa.list_(pa.float32())), "leaf": pa.array([], pa.int64()), "sub": pa.array([], pa.int64()), "place": pa.array([], pa.int64())})
        tree = Tree.of_row(*[t.column(c)[0].as_py() for c in ("normals", "offsets", "kids", "leaves")])
        x = matrix(q.column("vec"), dim)
        bins = [[b] for b in tree.leaf_of(x).tolist()] if most is None else list(tree.visits(x, most, reach))
        row = np.repeat(np.arange(len(x)), [len(b) for b in bins])
        place = np.concatenate([np.arange(1, len(b) + 1) for b in bins])
        got = q.take(pa.array(row))
        return pa.table({"id": got.column("id"), "vec": got.column("vec"), "leaf": got.column("leaf"), "sub": np.concatenate(bins).astype(np.int64), "place": place})

    inside = cut.groupBy("leaf", "chunk").cogroup(trees.groupBy("leaf", "chunk")).applyInArrow(route, "id bigint, vec array<float>, leaf bigint, sub bigint, place bigint")
    return plain.unionByName(inside)


def index(points: DataFrame, tree: Tree, dim: int, leaf_rows: int = 3000, crowd_rows: int = 6000, sub_sample: int = 20_000) -> Index:
    """Every row of ``points`` (id, vec) in its bin, written to the shared folder.

    Leaves of more than ``crowd_rows`` rows are divided by a subtree. A bin that stays larger (near copies of one vector) is
    cut into blocks of that size by a hash of the id; a query then visits all blocks of the bin, in separate tasks.
    """
    held = points.sparkSession.sparkContext.broadcast(tree)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                leaf = held.value.leaf_of(matrix(b.column("vec"), dim))
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("vec"), pa.array(leaf)], names=["id", "vec", "leaf"])

    rows = scratch_table(points.select("id", "vec").mapInArrow(label, "id bigint, vec array<float>, leaf bigint"), "leaves")
    ix = Index(rows, held, _subtrees(rows, dim, leaf_rows, crowd_rows, sub_sample), dim)
    routed = _through_subtrees(ix, rows, None, 0.0).drop("place")
    if ix.subs is not None:
        routed = scratch_table(routed, "bins")
    # written: its size is known then, and Spark broadcasts it only below its threshold
    ix.sizes = scratch_table(routed.groupBy("leaf", "sub").agg(F.ceil(F.count(F.lit(1)) / crowd_rows).alias("blocks")), "bin-sizes")
    ix.rows = routed.join(ix.sizes, ["leaf", "sub"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    return ix


def _sent(ix: Index, queries: DataFrame, most: int, sub_most: int, reach: float, tag: bool = False) -> DataFrame:
    """(id, vec, leaf, sub): the bins each query visits; with ``tag`` also their places in either order (at, place)."""
    dim, held = ix.dim, ix.tree

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                bins = list(held.value.visits(matrix(b.column("vec"), dim), most, reach))
                row = np.repeat(np.arange(len(b)), [len(v) for v in bins])
                sent = pa.RecordBatch.from_arrays([b.column("id"), b.column("vec")], names=["id", "vec"]).take(pa.array(row))
                at = np.concatenate([np.arange(1, len(v) + 1) for v in bins])
                yield pa.RecordBatch.from_arrays([*sent.columns, pa.array(np.concatenate(bins).astype(np.int64)), pa.array(at)], names=["id", "vec", "leaf", "at"])

    first = queries.select("id", "vec").mapInArrow(send, "id bigint, vec array<float>, leaf bigint, at bigint")
    if not tag:
        return _through_subtrees(ix, first, sub_most, reach).drop("place")
    first = scratch_table(first, "calibration")
    return _through_subtrees(ix, first, sub_most, reach).join(first.select("id", "leaf", "at"), ["id", "leaf"]).select("id", "leaf", "sub", "at", "place")


def _top(cos: np.ndarray, k: int) -> np.ndarray:
    return np.argpartition(-cos, k - 1, axis=1)[:, :k] if cos.shape[1] > k else np.tile(np.arange(cos.shape[1]), (len(cos), 1))


def search(ix: Index, queries: DataFrame, k: int, most: int, sub_most: int, least_cos: float | None = None, skip_self: bool = True) -> DataFrame:
    """(id, other, cos): for every query (id, vec) its k most similar other rows among the visited bins.

    With ``least_cos`` only pairs at least that similar are looked for and every bin within the
    corresponding distance is visited. Equal cosines are ordered by id. A query is sent to each block of
    a visited bin; its candidates (at most k a block) are merged by a second aggregation.
    """
    dim = ix.dim
    reach = float(np.sqrt(max(0.0, 2 - 2 * least_cos))) + 1e-5 if least_cos is not None else float("inf")
    floor = least_cos if least_cos is not None else -2.0
    parts = F.ceil(F.col("blocks") / 8)  # the queries of a crowded bin are cut into parts too
    zero = F.lit(0).cast("bigint")
    sent = (
        _sent(ix, queries, most, sub_most, reach)
        .join(ix.sizes, ["leaf", "sub"])
        .withColumn("block", F.explode(F.sequence(zero, F.col("blocks") - 1)))
        .select("leaf", "sub", "block", F.pmod(F.xxhash64("id"), parts).alias("part"), "id", "vec")
    )
    rows = ix.rows.withColumn("part", F.explode(F.sequence(zero, parts - 1))).select("leaf", "sub", "block", "part", "id", "vec")

    def compare(q: pa.Table, r: pa.Table) -> pa.Table:
        ids, others, coss = [], [], []
        if q.num_rows and r.num_rows:
            x, y = matrix(q.column("vec"), dim), matrix(r.column("vec"), dim)
            qi, ri = q.column("id").to_numpy(), r.column("id").to_numpy()
            order = np.argsort(ri, kind="stable")
            y, ri = y[order], ri[order]
            step = max(1, 4_000_000 // max(1, len(y)))
            for i in range(0, len(x), step):
                cos = x[i : i + step] @ y.T
                if skip_self:
                    cos[qi[i : i + step, None] == ri[None, :]] = -3.0
                if least_cos is not None:
                    a, b = np.nonzero(cos >= floor - 1e-9)
                    c = cos[a, b]
                    if len(a):  # k best of each query: few rows pass the threshold
                        o = np.lexsort((ri[b], -c, a))
                        a, b, c = a[o], b[o], c[o]
                        rank = np.arange(len(a)) - np.searchsorted(a, a)
                        a, b, c = a[rank < k], b[rank < k], c[rank < k]
                else:
                    t = _top(cos, k)
                    a, b = np.repeat(np.arange(len(cos)), t.shape[1]), t.ravel()
                    c = cos[a, b]
                    a, b, c = a[c > -3], b[c > -3], c[c > -3]
                ids.append(qi[i : i + step][a])
                others.append(ri[b])
                coss.append(c)
        cat = lambda v, t: pa.array(np.concatenate(v) if v else [], type=t)
        return pa.table({"id": cat(ids, pa.int64()), "other": cat(others, pa.int64()), "cos": cat(coss, pa.float64())})

    bin_of = ("leaf", "sub", "block", "part")
    pairs = sent.groupBy(*bin_of).cogroup(rows.groupBy(*bin_of)).applyInArrow(compare, "id bigint, other bigint, cos double")
    w = Window.partitionBy("id").orderBy(F.col("cos").desc(), "other")  # at most k rows per visited block
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def exact_nearest(points: DataFrame, sample: DataFrame, dim: int, k: int) -> DataFrame:
    """Brute force for a bounded calibration sample: (id, other, cos) against all rows, k best per partition merged."""
    got = sample.select("id", "vec").toArrow()
    held = points.sparkSession.sparkContext.broadcast((matrix(got.column("vec"), dim), got.column("id").to_numpy()))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, qi = held.value
        for b in batches:
            if not len(b) or not len(qi):
                continue
            y, ri = matrix(b.column("vec"), dim), b.column("id").to_numpy()
            cos = x @ y.T
            cos[qi[:, None] == ri[None, :]] = -3.0
            t = _top(cos, k)
            a, o = np.repeat(np.arange(len(cos)), t.shape[1]), t.ravel()
            yield pa.RecordBatch.from_arrays([pa.array(qi[a]), pa.array(ri[o]), pa.array(cos[a, o])], names=["id", "other", "cos"])

    rows = points.select("id", "vec").mapInArrow(scan, "id bigint, other bigint, cos double").where("cos > -3")
    w = Window.partitionBy("id").orderBy(F.col("cos").desc(), "other")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


@dataclass(frozen=True)
class Visits:
    """leaves and sub_leaves a query visits; recall of the calibration set and of the held-out set (null without one)."""

    leaves: int
    sub_leaves: int
    recall: float
    held_out: float | None


def calibrate(ix: Index, queries: DataFrame, k: int, recall: float = 0.98, sample_rows: int = 200) -> Visits:
    """Fewest visits whose recall on ``sample_rows`` queries reaches ``recall``; the recall on as many others is measured too.

    The truth comes from a scan of all rows; for each true neighbour the place of its bin in the
    query's visiting order, in the tree and in the leaf's subtree, says how many visits would have found it.
    """
    sample = queries.orderBy(F.xxhash64("id"), "id").limit(2 * sample_rows).select("id", "vec")
    got = scratch_table(sample, "calibration")
    ids = [r.id for r in got.select("id", F.xxhash64("id").alias("h")).orderBy("h", "id").collect()]  # 2 x sample_rows
    if not ids:
        return Visits(1, 1, 1.0, None)
    truth = exact_nearest(ix.rows, got, ix.dim, k).join(ix.rows.select(F.col("id").alias("other"), "leaf", "sub"), "other").select("id", "other", "leaf", "sub")
    places = _sent(ix, got, 1 << 40, 1 << 40, float("inf"), tag=True)
    rows = truth.join(places, ["id", "leaf", "sub"]).select("id", "at", "place").collect()  # 2 x sample_rows x k
    if not rows:
        return Visits(1, 1, 1.0, None)
    fit = set(ids[: max(1, len(ids) // 2)]) if len(ids) > 1 else set(ids)
    at, place = (np.array([getattr(r, c) for r in rows if r.id in fit]) for c in ("at", "place"))
    if not len(at):
        at, place = (np.array([getattr(r, c) for r in rows]) for c in ("at", "place"))
    each = recall if ix.subs is None else 1 - (1 - recall) / 2
    need = lambda v: int(np.sort(v)[max(0, int(np.ceil(each * len(v))) - 1)])
    a, b = need(at), need(place)
    rest = [r for r in rows if r.id not in fit]
    return Visits(a, b, float(((at <= a) & (place <= b)).mean()), float(np.mean([r.at <= a and r.place <= b for r in rest])) if rest else None)


@dataclass(frozen=True)
class _Prepared:
    ix: Index
    asked: DataFrame
    copies: DataFrame


def _prepare(points: DataFrame, dim: int, k: int, pick: Column | None) -> _Prepared:
    """Index of the different vectors, the queries among them and the copies that take over their lists."""
    same = Window.partitionBy("vec").orderBy("id")  # filtered to a few ranks: limited before the shuffle
    kept = scratch_table(points.select("id", "vec").withColumn("rn", F.row_number().over(same)).where(F.col("rn") <= k + 1), "distinct-vectors")
    ix = index(kept, fit_tree(kept.where("rn = 1"), dim), dim)
    copied = points.groupBy("vec").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")).where("n > 1").select("vec", "rep")
    copies = points.select("id", "vec").join(copied, "vec").where("id <> rep").select("id", "rep")
    asked = kept.where("rn = 1").select("id", "vec")
    if pick is not None:
        of_copies = copies.where(pick).select(F.col("rep").alias("id"))
        asked = asked.where(pick).unionByName(asked.join(of_copies, "id", "left_semi").where(~pick))
        copies = copies.where(pick)
    return _Prepared(ix, asked, copies)


def recall_of(points: DataFrame, dim: int, k: int, pick: Column | None = None, recall: float = 0.98) -> Visits:
    """Visits that ``nearest_rows`` makes, with the recall of its calibration and of a held-out set."""
    p = _prepare(points, dim, k, pick)
    return calibrate(p.ix, p.asked, k, recall)


def nearest_rows(points: DataFrame, dim: int, k: int, least_cos: float | None = None, pick: Column | None = None, recall: float = 0.98) -> DataFrame:
    """(id, other, cos, rank): the k most similar other rows of every row of ``points`` (id, vec: unit vectors).

    ``pick``: only rows for which it holds are asked about; all rows are searched. ``least_cos``: only pairs
    at least that similar, all of them found. Equal cosines are ordered by id; a row without a partner has
    no rows. Exact copies are searched once: the index holds the k + 1 smallest ids of a vector, which is
    all that any list of k can name, and the lists are handed to the other copies by a join that AQE may
    split, so a group of copies with a third of all rows costs no more than any other vector.
    """
    p = _prepare(points, dim, k, pick)
    visits = Visits(1 << 40, 1 << 40, 1.0, None) if least_cos is not None else calibrate(p.ix, p.asked, k, recall)
    lists_of = search(p.ix, p.asked, k + 1, visits.leaves, visits.sub_leaves, least_cos, skip_self=False)
    owners = lists_of.select("id", "other", "cos", "rank")
    if pick is not None:
        owners = owners.where(pick)
    spread = p.copies.join(lists_of.select(F.col("id").alias("rep"), "other", "cos", "rank"), "rep").select("id", "other", "cos", "rank")
    w = Window.partitionBy("id").orderBy("rank")  # k + 1 rows a group
    out = owners.unionByName(spread).where("id <> other").withColumn("rank", F.row_number().over(w))
    return out.where(F.col("rank") <= k)
