"""Similarity clusters by bisecting k-means over the whole table.

Nodes that are not compact are split in two by two-means, those of the largest dispersion first, at most ``budget``
of them in a pass over the data. A pass routes every row through the tree of the nodes split so far, folds
each partition to one row of sums per node and adds these up on the executors; the driver sees a count and a sum per
open node, and the products only of the nodes that are split next. Nodes of at most ``local_rows`` rows are finished
by the same rule within one task. The compact leaves are joined where the plane of a split went through a cluster, and
every row is then held against the resulting directions until the membership no longer changes. Rows in no cluster
are split again, until a round finds nothing new.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparmat.llm.vectors import lists, matrix, unit
from sparmat.session import scratch_table


@dataclass(frozen=True)
class Limits:
    """radius: of a cluster around the direction of its mean; apart: least distance of two means; min_size: least
    cells; outliers: share of a node's rows beyond the radius at which it still counts as compact (they are looked at
    again in the next round); lloyd: moves of the two centres of a split; local_rows: rows up to which a node is
    finished within a task; budget: nodes split in one pass. The last two decide where and when, not what is found."""

    radius: float = 0.4
    apart: float = 0.8
    min_size: int = 5
    outliers: float = 0.02
    lloyd: int = 1
    local_rows: int = 8_000
    budget: int = 512

    @property
    def least_cos(self) -> float:
        return 1 - self.radius * self.radius / 2


@dataclass(frozen=True)
class Fit:
    """dirs: direction of each cluster; rounds: passes of splitting; settled: the membership reached a fixed point (else it
    came back to an earlier state, at which it was stopped)."""

    dirs: np.ndarray
    rounds: int
    settled: bool


def _far(x: np.ndarray, total: np.ndarray, lim: Limits) -> int:
    """Rows beyond the radius around the direction of ``total``."""
    n = np.linalg.norm(total)
    return len(x) if n == 0 else int((x @ (total / n) < lim.least_cos).sum())


def start_centres(n: int, s: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Two centres at one standard deviation on either side of the mean along the main axis; None for copies of one vector."""
    m = s / n
    w, v = np.linalg.eigh(c / n - np.outer(m, m))
    if w[-1] <= 1e-12:
        return None
    step = np.sqrt(w[-1]) * v[:, -1]
    return m + step, m - step


def first_side(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """True where a row is nearer to ``a``."""
    return x @ (a - b) > (a @ a - b @ b) / 2


def scattered(x: np.ndarray, lim: Limits, block: int = 2048) -> np.ndarray:
    """True where no other row lies within twice the radius: members of one cluster do, so such a row is in none."""
    out = np.zeros(len(x), dtype=bool)
    y = x.astype(np.float32)
    least = np.float32(1 - 2 * lim.radius * lim.radius - 1e-4)
    for i in range(0, len(x), block):
        out[i : i + block] = (y[i : i + block] @ y.T > least).sum(axis=1) < 2
    return out


def split_locally(x: np.ndarray, lim: Limits) -> list[tuple[int, np.ndarray]]:
    """Compact leaves (size, sum of vectors) of the rows of ``x``; scattered rows are left out."""
    leaves, stack = [], [np.arange(len(x))]
    while stack:
        idx = stack.pop()
        part = x[idx]
        total = part.sum(axis=0)
        if len(idx) < 2:
            continue
        if _far(part, total, lim) <= lim.outliers * len(idx):
            leaves.append((len(idx), total))
            continue
        alone = scattered(part, lim)
        if alone.any():
            stack.append(idx[~alone])
            continue
        centres = start_centres(len(idx), total, part.T @ part)
        if centres is None:  # copies
            leaves.append((len(idx), total))
            continue
        side = first_side(part, *centres)
        for _ in range(lim.lloyd):
            again = first_side(part, part[side].mean(axis=0), part[~side].mean(axis=0)) if side.any() and not side.all() else side
            if again.all() or not again.any():
                break
            side = again
        if side.all() or not side.any():
            leaves.append((len(idx), total))
            continue
        stack += [idx[side], idx[~side]]
    return leaves


@dataclass
class _Tree:
    """Inner nodes hold two centres; open and closed nodes none."""

    centres: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)
    children: dict[int, tuple[int, int]] = field(default_factory=dict)
    closed: set[int] = field(default_factory=set)

    def route(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), dtype=np.int64)
        stack = [(0, np.arange(len(x)))]
        while stack:
            node, idx = stack.pop()
            if node in self.children and len(idx):
                left = first_side(x[idx], *self.centres[node])
                stack += [(self.children[node][0], idx[left]), (self.children[node][1], idx[~left])]
            else:
                at[idx] = node
        return at


class Directions:
    """Nearest of many directions within a radius, exactly: beyond ``flat`` of them they are grouped around pivots, and a
    row is only held against the groups that can hold a direction within the radius of it."""

    def __init__(self, dirs: np.ndarray, lim: Limits, flat: int = 256):
        self.dirs, self.lim = dirs, lim
        self.groups: list[tuple[np.ndarray, np.ndarray, float]] = []
        if len(dirs) > flat:
            pivots = [0]
            far = np.linalg.norm(dirs - dirs[0], axis=1)
            owner = np.zeros(len(dirs), dtype=np.int64)
            while len(pivots) < int(np.sqrt(len(dirs))):
                pivots.append(int(far.argmax()))
                d = np.linalg.norm(dirs - dirs[pivots[-1]], axis=1)
                owner[d < far] = len(pivots) - 1
                far = np.minimum(far, d)
            for g, p in enumerate(pivots):
                own = np.nonzero(owner == g)[0]
                if len(own):
                    self.groups.append((dirs[p], own, float(far[own].max())))

    def near(self, x: np.ndarray, block: int = 4096) -> tuple[np.ndarray, np.ndarray]:
        """(index, cosine) of the nearest direction within the radius; index -1 where there is none. Ties to the smaller index."""
        best, cos = np.full(len(x), -1, dtype=np.int64), np.full(len(x), -2.0)
        if not len(self.dirs):
            return best, cos
        for i in range(0, len(x), block):
            p = x[i : i + block]
            rows = np.arange(len(p))
            for pivot, own, reach in self.groups or [(None, np.arange(len(self.dirs)), 0.0)]:
                if pivot is not None:
                    rows = np.nonzero(np.sqrt(np.maximum(0, 2 - 2 * (p @ pivot))) <= self.lim.radius + reach + 1e-6)[0]
                if len(rows):
                    s = p[rows] @ self.dirs[own].T
                    k = s.argmax(axis=1)
                    c, at = s[np.arange(len(s)), k], own[k]
                    won = (c > cos[i + rows]) | ((c == cos[i + rows]) & (at < best[i + rows]))
                    best[i + rows[won]], cos[i + rows[won]] = at[won], c[won]
        out = cos < self.lim.least_cos
        best[out] = -1
        return best, cos


_STATS = "node bigint, n bigint, far bigint, s array<double>, c array<double>"


def _node_stats(points: DataFrame, tree: _Tree, lim: Limits, dim: int, centres: dict[int, np.ndarray], wanted: set[int]) -> dict[int, tuple]:
    """One pass: count, rows beyond the radius of the node's last mean and sum per open node, and the products of the ``wanted``."""
    held = points.sparkSession.sparkContext.broadcast((tree, centres, wanted))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, centres, wanted = held.value
        acc: dict[int, list] = {}
        for b in batches:
            if not len(b):
                continue
            x = matrix(b.column("vec"), dim)
            at = tree.route(x)
            order = np.argsort(at, kind="stable")
            nodes, first = np.unique(at[order], return_index=True)
            for node, idx in zip(nodes.tolist(), np.split(order, first[1:])):
                if node in tree.closed:
                    continue
                p = x[idx]
                a = acc.setdefault(node, [0, 0, np.zeros(dim), np.zeros((dim, dim)) if node in wanted else None])
                a[0] += len(p)
                a[1] += _far(p, centres[node], lim) if node in centres else len(p)
                a[2] += p.sum(axis=0)
                if a[3] is not None:
                    a[3] += p.T @ p
        if acc:
            n, far, s, c = zip(*acc.values())
            c = pa.array([None if m is None else m.ravel() for m in c], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(list(acc)), pa.array(n), pa.array(far), lists(np.stack(s), np.float64), c], names=["node", "n", "far", "s", "c"])

    def add(t: pa.Table) -> pa.Table:
        c = t.column("c")
        whole = pa.array([None], c.type) if c.null_count else lists(matrix(c, dim * dim).sum(axis=0, keepdims=True), np.float64)
        return pa.table(
            {
                "node": t.column("node")[:1],
                "n": [sum(t.column("n").to_pylist())],
                "far": [sum(t.column("far").to_pylist())],
                "s": lists(matrix(t.column("s"), dim).sum(axis=0, keepdims=True), np.float64),
                "c": whole,
            }
        )

    rows = points.select("vec").mapInArrow(fold, _STATS).groupBy("node").applyInArrow(add, _STATS).collect()  # one row per open node
    held.destroy()
    return {r.node: (r.n, r.far, np.array(r.s), None if r.c is None else np.array(r.c).reshape(dim, dim)) for r in rows}


def _leaves(points: DataFrame, lim: Limits, dim: int) -> list[tuple[int, np.ndarray]]:
    """Compact leaves (size, sum) of all rows."""
    tree, leaves = _Tree(), []
    last: dict[int, np.ndarray] = {}  # sum of a node in the last pass
    openn, moves, ids = {0: np.inf}, {}, 1  # node -> dispersion, as far as known; parent -> moves of its centres so far
    local: set[int] = set()
    while openn:
        parent = {c: p for p in moves for c in tree.children[p]}
        still = sorted((n for n in openn if n not in parent or moves[parent[n]] == lim.lloyd), key=lambda n: -openn[n])
        stats = _node_stats(points, tree, lim, dim, last, set(still[: lim.budget]))
        for p in list(moves):
            a, b = tree.children[p]
            if moves[p] == lim.lloyd or a not in stats or b not in stats:
                del moves[p]  # the children are as they are
                continue
            tree.centres[p] = (stats[a][2] / stats[a][0], stats[b][2] / stats[b][0])
            moves[p] += 1
        moving = {c for p in moves for c in tree.children[p]}
        for node in list(openn):
            if node not in stats:
                del openn[node]
            else:
                n, _, s, _ = stats[node]
                openn[node], last[node] = n - float(s @ s) / n, s
        for node in sorted((n for n in openn if n not in moving), key=lambda n: -openn[n]):  # the largest dispersion first
            n, far, s, c = stats[node]
            if n <= lim.local_rows:
                local.add(node)
            elif far <= lim.outliers * n:
                leaves.append((n, s))
            else:
                if c is None or (far == n and np.linalg.norm(s) / n > lim.least_cos - 0.05):
                    continue  # beyond the budget of this pass, or dense and its distances were not looked at yet
                centres = start_centres(n, s, c)
                if centres is None:
                    leaves.append((n, s))
                else:
                    tree.centres[node], tree.children[node] = centres, (ids, ids + 1)
                    moves[node] = 0
                    openn |= {ids: openn[node] / 2, ids + 1: openn[node] / 2}
                    ids += 2
                    del openn[node]
                    continue
            tree.closed.add(node)
            del openn[node]
    if local:
        held = points.sparkSession.sparkContext.broadcast((tree, np.array(sorted(local))))

        def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tree, keep = held.value
            for b in batches:
                if len(b):
                    at = tree.route(matrix(b.column("vec"), dim))
                    ok = pa.array(np.isin(at, keep))
                    yield pa.RecordBatch.from_arrays([pa.array(at), b.column("vec")], names=["node", "vec"]).filter(ok)

        def finish(t: pa.Table) -> pa.Table:
            x = matrix(t.column("vec"), dim)
            found = split_locally(x[np.lexsort(x.T)], lim)
            return pa.table({"n": pa.array([n for n, _ in found], pa.int64()), "s": lists(np.array([s for _, s in found]).reshape(-1, dim), np.float64)})

        rows = points.select("vec").mapInArrow(label, "node bigint, vec array<float>").groupBy("node").applyInArrow(finish, "n bigint, s array<double>").collect()
        leaves += [(r.n, np.array(r.s)) for r in rows]  # one row per compact leaf
    return leaves


def _join(leaves: list[tuple[int, np.ndarray]], within: float) -> list[np.ndarray]:
    """Directions of leaves that stand for one cluster each: parts of a cluster lie nearer to each other than clusters do."""
    if not leaves:
        return []
    dim = len(leaves[0][1])
    dirs, sums, k = np.zeros((len(leaves), dim)), np.zeros((len(leaves), dim)), 0
    for _, s in sorted(leaves, key=lambda x: (-x[0], *np.round(x[1], 6))):
        u = s / np.linalg.norm(s)
        if k:
            cos = dirs[:k] @ u
            j = int(cos.argmax())
            if cos[j] > 1 - within * within / 2:
                sums[j] += s
                dirs[j] = sums[j] / np.linalg.norm(sums[j])
                continue
        dirs[k], sums[k], k = u, s, k + 1
    return list(dirs[:k])


def _member_sums(points: DataFrame, dirs: np.ndarray, lim: Limits, dim: int) -> dict[int, tuple[int, np.ndarray]]:
    held = points.sparkSession.sparkContext.broadcast(Directions(dirs, lim))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = held.value
        n, s = np.zeros(len(d.dirs), dtype=np.int64), np.zeros((len(d.dirs), dim))
        for b in batches:
            if len(b):
                x = matrix(b.column("vec"), dim)
                best, _ = d.near(x)
                ok = best >= 0
                n += np.bincount(best[ok], minlength=len(n))
                np.add.at(s, best[ok], x[ok])
        yield pa.RecordBatch.from_arrays([pa.array(np.nonzero(n)[0]), pa.array(n[n > 0]), lists(s[n > 0].reshape(-1, dim), np.float64)], names=["node", "n", "s"])

    def add(t: pa.Table) -> pa.Table:
        return pa.table({"node": t.column("node")[:1], "n": [sum(t.column("n").to_pylist())], "s": lists(matrix(t.column("s"), dim).sum(axis=0, keepdims=True), np.float64)})

    kind = "node bigint, n bigint, s array<double>"
    rows = points.select("vec").mapInArrow(fold, kind).groupBy("node").applyInArrow(add, kind).collect()  # one row per cluster
    held.destroy()
    return {r.node: (r.n, np.array(r.s)) for r in rows}


def _settle(points: DataFrame, dirs: list[np.ndarray], lim: Limits, dim: int) -> tuple[list[np.ndarray], bool]:
    """Directions moved to the means of their members until these stay the same; False if an earlier state came back first."""
    seen: set = set()
    while dirs:
        got = _member_sums(points, np.stack(dirs), lim, dim)
        state = tuple(sorted((n, *np.round(s, 4)) for n, s in got.values()))
        dirs = _join([(n, s) for n, s in got.values() if n >= lim.min_size], lim.apart)
        if state in seen:
            return dirs, state == before
        seen.add(state)
        before = state
    return dirs, True


def fit(points: DataFrame, dim: int, lim: Limits = Limits()) -> Fit:
    """Clusters of ``points`` (column ``vec``: unit vectors, array<float>).

    The result depends on the rows only, not on their order. What the driver holds is one row per open node and per
    compact leaf, the products of at most ``budget`` nodes, and one direction per cluster; never rows of the table.
    """
    known, rounds, settled = np.zeros((0, dim)), 0, True
    rest = points
    while True:
        rounds += 1
        dirs = _join([(1 << 60, d * float(1 << 60)) for d in known] + _leaves(rest, lim, dim), lim.apart * 0.75)  # known ones stay where they are
        dirs, settled = _settle(points, dirs, lim, dim)
        if len(dirs) <= len(known):
            return Fit(np.stack(dirs) if dirs else known, rounds, settled)
        known = np.stack(dirs)
        rest = scratch_table(_without(points, known, lim, dim), "in-no-cluster")


def _without(points: DataFrame, dirs: np.ndarray, lim: Limits, dim: int) -> DataFrame:
    """(vec): rows within the radius of no direction."""
    held = points.sparkSession.sparkContext.broadcast(Directions(dirs, lim))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                yield pa.RecordBatch.from_arrays([b.column("vec")], names=["vec"]).filter(pa.array(held.value.near(matrix(b.column("vec"), dim))[0] < 0))

    return points.select("vec").mapInArrow(look, "vec array<float>")


def assign(points: DataFrame, dirs: np.ndarray, dim: int, keep: list[str], lim: Limits = Limits()) -> DataFrame:
    """(keep, cluster, dist): rows within the radius of a cluster's direction and their distance from it."""
    fields = {f.name: f.dataType.simpleString() for f in points.schema.fields}
    held = points.sparkSession.sparkContext.broadcast(Directions(dirs, lim))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                best, cos = held.value.near(matrix(b.column("vec"), dim))
                cols = [b.column(c) for c in keep] + [pa.array(best), pa.array(np.sqrt(np.maximum(0, 2 - 2 * cos)))]
                yield pa.RecordBatch.from_arrays(cols, names=[*keep, "cluster", "dist"]).filter(pa.array(best >= 0))

    schema = ", ".join([f"`{c}` {fields[c]}" for c in keep] + ["cluster bigint, dist double"])
    return points.select(*keep, "vec").mapInArrow(label, schema)


def prepare(df: DataFrame, dim: int, vec: str, keep: list[str]) -> DataFrame:
    """Usable vectors as unit vectors in a table of the shared folder: (keep, vec). ``df`` must hold usable rows only."""
    fields = {f.name: f.dataType.simpleString() for f in df.schema.fields}

    def scale(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], lists(unit(matrix(b.column(vec), dim)))], names=[*keep, "vec"])

    schema = ", ".join([f"`{c}` {fields[c]}" for c in keep] + ["vec array<float>"])
    return scratch_table(df.select(*keep, vec).mapInArrow(scale, schema), "unit-vectors")


def typical(assigned: DataFrame, ident: str, k: int, placed: DataFrame | None = None) -> DataFrame:
    """(cluster, size, first_id, mean_dist, max_dist, typical): the k members nearest to the direction, nearest first, ties
    by id; mean and largest distance of the members from the direction tell how compact the cluster is.

    ``placed`` (ident, cluster) are further members without a distance: they count for size and first_id, and are never typical.
    Each partition keeps its k best per cluster before the shuffle; the sizes are a plain aggregate.
    """

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for b in batches:
            t = pa.Table.from_batches([b]) if kept is None else pa.concat_tables([kept, pa.Table.from_batches([b])])
            pdf = t.to_pandas().sort_values(["cluster", "dist", ident], kind="stable").groupby("cluster").head(k)
            kept = pa.Table.from_pandas(pdf, schema=b.schema, preserve_index=False)
        if kept is not None:
            yield from kept.to_batches()

    rows = assigned.select(F.col(ident), "cluster", "dist")
    top = rows.mapInArrow(best, rows.schema)
    members = F.slice(F.array_sort(F.collect_list(F.struct("dist", ident))), 1, k)  # at most k rows a partition and cluster
    every = assigned.select(ident, "cluster")
    every = every if placed is None else every.unionByName(placed.select(ident, "cluster"))
    sizes = every.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), F.min(ident).alias("first_id"))
    spread = assigned.groupBy("cluster").agg(F.avg("dist").alias("mean_dist"), F.max("dist").alias("max_dist"))
    return sizes.join(spread, "cluster").join(top.groupBy("cluster").agg(F.transform(members, lambda m: m[ident]).alias("typical")), "cluster")
