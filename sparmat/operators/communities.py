"""Communities of weighted graphs by modularity, with well-connected parts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparmat.operators.graph import connected_components
from sparmat.session import ranked, scratch_table

#: Edges that a task works on at once; a level of at most ALONE neighbour entries makes its passes within one task, by the same rule.
BLOCK, ALONE = 1_000_000, 2_000_000


def modularity(edges: DataFrame, labels: DataFrame, resolution: float = 1.0) -> float:
    """Modularity of labels (node, community) of a graph whose edges (src, dst, weight) stand in both directions."""
    e = edges.join(labels.select(F.col("node").alias("src"), F.col("community").alias("a")), "src").join(labels.select(F.col("node").alias("dst"), F.col("community").alias("b")), "dst")
    inside = e.agg(F.sum("weight").alias("t"), F.sum(F.when(F.col("a") == F.col("b"), F.col("weight")).otherwise(0.0)).alias("i")).first()
    if not inside.t:
        return 0.0
    sq = e.groupBy("a").agg(F.sum("weight").alias("k")).agg(F.sum(F.col("k") * F.col("k")).alias("s")).first().s
    return inside.i / inside.t - resolution * sq / inside.t**2


def _columns(files: list[str], *names: str) -> list[np.ndarray]:
    """Columns of a scratch table with an ``idx`` from 0, in its order; read by a task itself, straight from the shared folder."""
    fs, _ = FileSystem.from_uri(files[0])
    t = pa.concat_tables([pq.read_table(FileSystem.from_uri(f)[1], columns=["idx", *names], filesystem=fs) for f in files])
    at = t.column("idx").to_numpy()
    out = []
    for n in names:
        v = t.column(n).to_numpy()
        out.append(np.empty_like(v))
        out[-1][at] = v
    return out


def _free(node: np.ndarray, i: int) -> np.ndarray:
    """Whether Spark's xxhash64(node, i), node a bigint, is even."""
    p1, p2, p3, p4, p5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    rot = lambda x, n: (x << np.uint64(n)) | (x >> np.uint64(64 - n))

    def mixed(h):
        h = (h ^ (h >> np.uint64(33))) * p2
        h = (h ^ (h >> np.uint64(29))) * p3
        return h ^ (h >> np.uint64(32))

    x = np.ascontiguousarray(node, dtype=np.int64).view(np.uint64)
    with np.errstate(over="ignore"):
        h = mixed(rot((np.uint64(42) + p5 + np.uint64(8)) ^ (rot(x * p2, 31) * p1), 27) * p1 + p4)
        h = mixed(rot((h + p5 + np.uint64(4)) ^ (np.uint64(i) * p1), 23) * p2 + p3)
    return h & np.uint64(1) == 0


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """(idx, node, loop, neighbours per row, neighbours, weights) of rows of an adjacency, about ``BLOCK`` neighbours at once."""
    held, n = [], 0

    def joined():
        t = pa.Table.from_batches(held)
        near, w = t.column("near").combine_chunks(), t.column("w").combine_chunks()
        flat = lambda x: (x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x).flatten().to_numpy(zero_copy_only=False)
        lens = near.value_lengths().to_numpy(zero_copy_only=False)
        return *(t.column(c).to_numpy() for c in ("idx", "node", "loop")), lens, flat(near), flat(w)

    for b in batches:
        held.append(b)
        n += len(b.column("near").flatten())
        if n >= BLOCK:
            yield joined()
            held, n = [], 0
    if held:
        yield joined()


def _summed(key: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, int)
    return key[first], np.add.reduceat(w[order], first) if len(key) else w


def _moves(block: tuple, comm: np.ndarray, k: np.ndarray, tot: np.ndarray, whole: float, resolution: float, i: int) -> tuple[np.ndarray, ...]:
    """(w0, community, wants) of the rows: the weight to the own community, the one of pass ``i``, and whether another one gains more."""
    idx, node, _, lens, near, w = block
    n, rows = len(k), np.arange(len(idx))
    own, ki = comm[idx], k[idx]
    key, w = _summed(np.r_[np.repeat(rows, lens) * n + comm[near], rows * n + own], np.r_[w, np.zeros(len(idx))])
    r, c = np.divmod(key, n)
    mine = c == own[r]
    gain = np.round(w - resolution * ki[r] * (tot[c] - np.where(mine, ki[r], 0.0)) / whole, 9)
    start = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
    g = np.maximum.reduceat(gain, start)
    to = c[np.minimum.reduceat(np.where(gain == g[r], np.arange(len(r)), len(r)), start)]  # ties to the smallest
    wants = g > gain[mine]
    return w[mine], np.where(wants & _free(node, i), to, own), wants


def _batches(schema: pa.Schema, *columns) -> Iterator[pa.RecordBatch]:
    t = pa.table([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
    return iter(t.to_batches(max_chunksize=200_000))


_MOVED = pa.schema([("idx", pa.int64()), ("own", pa.int64()), ("k", pa.float64()), ("w0", pa.float64()), ("community", pa.int64()), ("wants", pa.bool_())])


def _pass(nodes: list[str], state: list[str] | None, whole: float, resolution: float, i: int) -> Callable:
    def run(batches):
        k = comm = None
        for block in _blocks(batches):
            if k is None:
                (k,) = _columns(nodes, "k")
                comm = _columns(state, "community")[0] if state else np.arange(len(k))
                tot = np.bincount(comm, k, len(k))
            w0, to, wants = _moves(block, comm, k, tot, whole, resolution, i)
            yield from _batches(_MOVED, block[0], comm[block[0]], k[block[0]], w0, to, wants)

    return run


class _Course:
    """The labels of the largest modularity so far, and when to stop."""

    def __init__(self):
        self.top, self.best, self.idle = -2.0, None, 0

    def over(self, q: float, labels, wants: bool) -> bool:
        self.idle = 0 if q > self.top + 1e-9 else self.idle + 1
        if q > self.top:
            self.top, self.best = q, labels
        return self.idle >= 3 or not wants


def _alone(nodes: list[str], whole: float, loops: float, resolution: float, passes: int) -> Callable:
    def run(batches):
        blocks = list(_blocks(batches))
        if not blocks:
            return
        (k,) = _columns(nodes, "k")
        comm, course = np.arange(len(k)), _Course()
        for i in range(passes + 1):
            tot, nxt, w, wants = np.bincount(comm, k, len(k)), comm.copy(), 0.0, False
            for b in blocks:
                w0, nxt[b[0]], m = _moves(b, comm, k, tot, whole, resolution, i)
                w, wants = w + w0.sum(), wants or bool(m.any())
            if course.over((w + loops) / whole - resolution * (tot * tot).sum() / whole**2, comm, wants):
                break
            comm = nxt
        yield from _batches(pa.schema([("idx", pa.int64()), ("own", pa.int64())]), np.arange(len(k)), course.best)

    return run


def _move(adjacency: DataFrame, nodes: DataFrame, entries: int, resolution: float, passes: int) -> DataFrame:
    """(idx, own) after local moves: in a pass, half of the nodes (by a hash) may go to the neighbouring community of the largest gain.

    A pass is one written table, which also tells the modularity of the labels it started from.
    """
    whole, loops = nodes.agg(F.sum("k"), F.sum("loop")).first()
    files = nodes.inputFiles()
    if entries <= ALONE:
        return scratch_table(adjacency.coalesce(1).mapInArrow(_alone(files, whole, loops, resolution, passes), "idx long, own long"), "moves")
    course, state = _Course(), None
    for i in range(passes + 1):
        t = scratch_table(adjacency.mapInArrow(_pass(files, state, whole, resolution, i), "idx long, own long, k double, w0 double, community long, wants boolean"), "moves")
        s = t.groupBy("own").agg(F.sum("k").alias("k"), F.sum("w0").alias("w"), F.max("wants").alias("wants")).agg(F.sum("w").alias("w"), F.sum(F.col("k") * F.col("k")).alias("kk"), F.max("wants").alias("wants")).first()
        if course.over((s.w + loops) / whole - resolution * s.kk / whole**2, t, s.wants):
            break
        state = t.inputFiles()
    return course.best.select("idx", "own")


def _level(edges: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """(adjacency, nodes, entries): the neighbours of each node, itself left out, in a row of arrays; nodes (idx, node, k, loop) numbered in their order."""
    e = edges.where("src IS NOT NULL AND dst IS NOT NULL").repartition("src").groupBy("src", "dst").agg(F.sum("weight").alias("weight")).where("weight > 0")
    e = scratch_table(e.select(F.col("src").cast("long"), F.col("dst").cast("long"), F.col("weight").cast("double").alias("weight")), "level")
    own = F.sum(F.when(F.col("src") == F.col("dst"), F.col("weight")).otherwise(0.0)).alias("loop")
    nodes = ranked(e.groupBy(F.col("src").alias("node")).agg(F.sum("weight").alias("k"), own, F.count(F.lit(1)).alias("n")), [], ["node"], "idx")
    nodes = scratch_table(nodes.select((F.col("idx") - 1).cast("long").alias("idx"), "node", "k", "loop", "n"), "strength")
    count = nodes.agg(F.sum("n")).first()[0] or 0
    files = nodes.inputFiles()

    def numbered(batches):
        ids = None
        for b in batches:
            if ids is None:
                (ids,) = _columns(files, "node")
            node, loop = b.column("node").to_numpy(), b.column("loop").to_numpy()
            offsets, dst, w = b.column("dst").value_lengths().to_numpy(), b.column("dst").flatten().to_numpy(), b.column("w").flatten().to_numpy()
            at = np.minimum(np.searchsorted(ids, dst), len(ids) - 1)
            row = np.repeat(np.arange(len(node)), offsets)
            keep = (ids[at] == dst) & (dst != node[row])
            ends = np.r_[0, np.cumsum(np.bincount(row[keep], minlength=len(node)))].astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for x in (at[keep].astype(np.int64), w[keep])]
            yield pa.RecordBatch.from_arrays([pa.array(np.searchsorted(ids, node).astype(np.int64)), pa.array(node), pa.array(loop), *lists], ["idx", "node", "loop", "near", "w"])

    rows = e.repartition("src").groupBy(F.col("src").alias("node")).agg(F.collect_list("dst").alias("dst"), F.collect_list("weight").alias("w"), own).select("node", "loop", "dst", "w")
    return scratch_table(rows.mapInArrow(numbered, "idx long, node long, loop double, near array<long>, w array<double>"), "adjacency"), nodes, count


def _joined(adjacency: DataFrame, nodes: DataFrame, moved: DataFrame) -> DataFrame:
    """The edges of the next level: those between the communities (named by a node), summed."""
    files, state = nodes.inputFiles(), moved.inputFiles()

    def run(batches):
        ids = None
        for idx, _, loop, lens, near, w in _blocks(batches):
            if ids is None:
                (ids,), (comm,) = _columns(files, "node"), _columns(state, "own")
            key, w = _summed(np.r_[np.repeat(comm[idx], lens) * len(ids) + comm[near], comm[idx] * (len(ids) + 1)], np.r_[w, loop])
            a, b = np.divmod(key, len(ids))
            yield from _batches(pa.schema([("src", pa.int64()), ("dst", pa.int64()), ("weight", pa.float64())]), ids[a], ids[b], w)

    return adjacency.mapInArrow(run, "src long, dst long, weight double")


def _stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) of the nodes of edges (a, b) that are not the smallest of their component."""
    ids, at = np.unique(np.r_[a, b], return_inverse=True)
    a, b, lab = at[: len(a)], at[len(a) :], np.arange(len(ids))
    while True:
        la, lb = lab[a], lab[b]
        m = la != lb
        if not m.any():
            break
        a, b = a[m], b[m]
        np.minimum.at(lab, np.maximum(la, lb)[m], np.minimum(la, lb)[m])
        while (lab[lab] != lab).any():
            lab = lab[lab]
    out = lab != np.arange(len(ids))
    return ids[out], ids[lab[out]]


def _reduced(pairs: Iterator[tuple[np.ndarray, np.ndarray]], most: int = 2 * BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Stars that join what the pairs join, from one pass in bounded memory."""
    held, n = [], 0
    for p in pairs:
        held.append(p)
        n += len(p[0])
        if n >= most:
            held = [_stars(*(np.concatenate(x) for x in zip(*held)))]
            n = len(held[0][0])
            if n >= most // 2:
                yield held[0]
                held, n = [], 0
    if n:
        yield _stars(*(np.concatenate(x) for x in zip(*held)))


def _inner(adjacency: DataFrame, labels: DataFrame) -> DataFrame:
    """(src, dst): edges that join the same nodes as all those within communities (labels: idx, node, community), few more than the nodes."""
    files = labels.inputFiles()
    schema = pa.schema([("community", pa.int64()), ("src", pa.int64()), ("dst", pa.int64())])

    def within(batches):
        lab = _columns(files, "community")[0]
        ids = _columns(files, "node")[0]

        def pairs():
            for idx, _, _, lens, near, _ in _blocks(batches):
                a = np.repeat(idx, lens)
                keep = (lab[a] == lab[near]) & (a < near)
                yield a[keep], near[keep]

        for a, b in _reduced(pairs()):
            yield from _batches(schema, lab[a], ids[a], ids[b])

    def again(batches):
        for a, b in _reduced((x.column("src").to_numpy(), x.column("dst").to_numpy()) for x in batches):
            yield from _batches(pa.schema(list(schema)[1:]), a, b)

    return adjacency.mapInArrow(within, "community long, src long, dst long").repartition("community").select("community", "src", "dst").mapInArrow(again, "src long, dst long")


def communities(edges: DataFrame, resolution: float = 1.0, passes: int = 12, levels: int = 10) -> DataFrame:
    """(node, community) of a weighted graph whose edges (src, dst, weight) stand in both directions; nodes are whole numbers.

    Local moves raise the modularity; the communities are the nodes of the next level, until a level joins nothing. At the end a
    community that is not connected is replaced by its connected parts. Moves are made by half of the nodes at a time, so two nodes do not
    keep changing places. All state is tables; the driver sees a few numbers a pass. A community is named by its smallest node.
    The edges of a level are shuffled once, to rows of neighbours. In a pass a task reads such rows and, from the shared folder, the labels
    and strengths of all nodes (16 bytes a node), so that only the labels are written anew.
    """
    kind = edges.schema["src"].dataType
    first, nodes, entries = _level(edges)
    adjacency = first
    lab = nodes.select("idx", "node", F.col("node").alias("community"))
    size = nodes.count()
    for _ in range(levels if size else 0):
        moved = scratch_table(_move(adjacency, nodes, entries, resolution, passes), "moved")
        name = nodes.select("idx", F.col("node").alias("community"))
        to = moved.join(name, "idx").select("community", F.col("own").alias("idx")).join(name.withColumnRenamed("community", "to"), "idx").select("community", "to")
        lab = scratch_table(lab.join(to, "community").select("idx", "node", F.col("to").alias("community")), "labels")
        now = lab.select("community").distinct().count()
        if now == size:
            break
        size = now
        adjacency, nodes, entries = _level(_joined(adjacency, nodes, moved))
    inner = _inner(first, scratch_table(lab, "labels"))
    found = connected_components(inner, lab.select("node")).select(F.col("node").cast(kind).alias("node"), F.col("component").cast(kind).alias("community"))
    return found
