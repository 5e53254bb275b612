"""Significance: permutations, Wald tests, Poisson peaks."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparmat.functions.stats import erfc
from sparmat.operators.intervals import merge_intervals
from sparmat.operators.ranks import benjamini_hochberg, es_of_hits
from sparmat.session import ranked, scratch_table


def wald(lfc: Column, se: Column) -> tuple[Column, Column]:
    """(statistic, two-sided p) of an estimate and its standard error; null for an error of 0."""
    z = F.try_divide(lfc, se)
    return z, erfc(F.abs(z) / F.sqrt(F.lit(2.0)))


def shuffled_place(df: DataFrame, keys: list[str], ident: str, n_perms: int, into: str = "place") -> DataFrame:
    """Rows of ``df`` once a permutation (``perm`` from 1), with their place in a random order of their key: a bijection.

    The order is that of an MD5 of (id, permutation), the same for every run; no key is ordered within one task.
    """
    d = df.withColumn("perm", F.explode(F.sequence(F.lit(1), F.lit(n_perms))))
    d = d.withColumn("_h", F.md5(F.concat_ws("/", F.col(ident).cast("string"), F.col("perm").cast("string"))))
    return ranked(d, [*keys, "perm"], ["_h", ident], into).drop("_h")


def enrichment_permutations(scored: DataFrame, signature: DataFrame, by: str, score: str, n_perms: int) -> DataFrame:
    """(by, set, es, nes, p): enrichment scores, normalised by the mean score of equal sign over ``n_perms`` permutations of the
    variables of a group, and the share of these that are at least as extreme. Without one of equal sign both are null."""
    r = scratch_table(ranked(scored.where(F.col(score).isNotNull()).select(by, "var_id", score), [by], [F.col(score).desc(), "var_id"], "rank", size="n"), "ranking")
    member = signature.select("set", "var_id").distinct()
    real = es_of_hits(r.join(member, "var_id"), [by], score)
    moved = shuffled_place(r.select(by, "var_id"), [by], "var_id", n_perms).join(member, "var_id")
    moved = moved.join(r.select(by, F.col("rank").alias("place"), F.col(score), "n"), [by, "place"]).withColumnRenamed("place", "rank")
    null = es_of_hits(moved, [by, "perm"], score).select(by, "set", F.col("es").alias("e0"))
    x = real.select(by, "set", "es").join(null, [by, "set"]).where((F.col("e0") >= 0) == (F.col("es") >= 0))
    s = x.groupBy(by, "set").agg(F.avg(F.abs("e0")).alias("m"), F.avg((F.round(F.abs("e0"), 9) >= F.round(F.abs("es"), 9)).cast("double")).alias("p"))
    return real.select(by, "set", "es").join(s, [by, "set"], "left").select(by, "set", "es", F.try_divide("es", "m").alias("nes"), "p")


_BITS = 12  # of an MD5, that name its bucket; 16 at most


def _hashed(groups: list, n_perms: int) -> Callable:
    tails = [f"/{p}".encode() for p in range(1, n_perms + 1)]

    def run(batches):
        number = {g: i for i, g in enumerate(groups)}
        for b in batches:
            ids = [x.encode() for x in b.column("id").to_pylist()]
            hashes = [b"".join([md5(x + t).digest()[:2] for t in tails]) for x in ids]
            own = [number[g] for g in b.column("grp").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("obs_id"), pa.array(own, pa.int32()), pa.array(hashes, pa.binary())], ["obs_id", "own", "hash"])

    return run


def _bucket(column, n_perms: int, bits: int) -> np.ndarray:
    return (np.frombuffer(b"".join(column.to_pylist()), ">u2").reshape(-1, n_perms) >> (16 - bits)).astype(np.int64)


def _shuffled_groups(hashed: DataFrame, kind: str, counts: list[int], n_perms: int) -> Callable:
    """A function for ``mapInArrow`` that gives (obs_id, labels): the numbers of the own group and of those in the permutations, packed to bits.

    A permutation orders the observations by (MD5 of id and permutation, id) and deals the places to the groups in turn. Most buckets of
    hashes fall to one group whole; only those that hold the last place of a group are ordered, and the rows on these places are the cuts.
    """
    perms, bits, buckets = np.arange(n_perms), _BITS, 1 << _BITS

    def histogram(batches):
        n = np.zeros(n_perms * buckets, np.int64)
        for x in batches:
            n += np.bincount((_bucket(x.column("hash"), n_perms, bits) + perms * buckets).ravel(), minlength=len(n))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(n))), pa.array(n)], ["cell", "n"])

    size = np.zeros(n_perms * buckets, np.int64)
    for r in hashed.mapInArrow(histogram, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():  # a row a bucket and permutation
        size[r.cell] = r.n
    size = size.reshape(n_perms, buckets)
    start, last = np.cumsum(size, axis=1) - size, np.cumsum(counts)
    low = np.searchsorted(last, start + 1)
    whole = np.where((size == 0) | (low == np.searchsorted(last, start + size)), low, -1)

    def opened(batches):
        for x in batches:
            r, p = np.nonzero(whole[perms, cells := _bucket(x.column("hash"), n_perms, bits)] < 0)
            yield pa.RecordBatch.from_arrays([pa.array(p + 1), pa.array(cells[r, p]), x.column("obs_id").take(pa.array(r)), x.column("id").take(pa.array(r))], ["perm", "bucket", "obs_id", "id"])

    wanted = [(p + 1, int(b), int(e - start[p, b])) for p, b in np.argwhere(whole < 0).tolist() for e in last if start[p, b] < e < start[p, b] + size[p, b]]
    cuts: dict[tuple[int, int], list] = {}
    if wanted:
        x = hashed.select("obs_id", F.col("obs_id").cast("string").alias("id"), "hash").mapInArrow(opened, f"perm long, bucket long, obs_id {kind}, id string")
        x = ranked(x.select("perm", "bucket", "obs_id", F.md5(F.concat_ws("/", "id", F.col("perm").cast("string"))).alias("h")), ["perm", "bucket"], ["h", "obs_id"], "place")
        at = hashed.sparkSession.createDataFrame(wanted, "perm long, bucket long, place long")
        for r in x.join(at, ["perm", "bucket", "place"]).collect():  # a row a group and permutation
            cuts.setdefault((r.perm - 1, r.bucket), []).append((r.h, r.obs_id))
    cuts = {k: sorted(v) for k, v in cuts.items()}
    width = max(1, (len(counts) - 1).bit_length())

    def run(batches):
        for x in batches:
            cells = _bucket(x.column("hash"), n_perms, bits)
            labels = np.c_[x.column("own").to_numpy(), whole[perms, cells]]
            rows = np.nonzero(labels < 0)
            for r, p in zip(*(v.tolist() for v in rows)):
                p, ident = p - 1, x.column("obs_id")[r].as_py()
                h = md5(f"{x.column('id')[r].as_py()}/{p + 1}".encode()).hexdigest()
                labels[r, p + 1] = low[p, cells[r, p]] + bisect_left(cuts[p, cells[r, p]], (h, ident))
            packed = np.packbits(((labels[:, :, None] >> np.arange(width)) & 1).astype(np.uint8).reshape(len(labels), -1), axis=1)
            yield pa.RecordBatch.from_arrays([x.column("obs_id"), pa.array([v.tobytes() for v in packed], pa.binary())], ["obs_id", "labels"])

    return run


def _label_sums(n_groups: int, n_perms: int) -> Callable:
    """(var_id, sums, rows, values) of rows (var_id, value, labels) whose variables lie in one partition each: sums per (permutation, group),
    rows and values that are not null per own group."""
    width, k = max(1, (n_groups - 1).bit_length()), (n_perms + 1) * n_groups

    def summed(held):
        t = pa.Table.from_batches(held)
        value = t.column("value").to_numpy()
        there = t.column("value").is_valid().to_numpy()
        value = np.where(there, value, 0.0)
        coded = t.column("var_id").combine_chunks().dictionary_encode()
        coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
        at, n = coded.indices.to_numpy().astype(np.int64), len(coded.dictionary)
        raw = np.frombuffer(b"".join(t.column("labels").to_pylist()), np.uint8).reshape(len(value), -1)
        bits = np.unpackbits(raw, axis=1, count=(n_perms + 1) * width).reshape(len(value), n_perms + 1, width)
        out = np.empty((n, k + 2 * n_groups))
        for p in range(n_perms + 1):
            key = at * n_groups + sum(bits[:, p, j].astype(np.int64) << j for j in range(width))
            out[:, p * n_groups : (p + 1) * n_groups] = np.bincount(key, value, n * n_groups).reshape(n, -1)
            if p == 0:
                for j, w in enumerate((np.ones(len(value)), there)):
                    out[:, k + j * n_groups : k + (j + 1) * n_groups] = np.bincount(key, w, n * n_groups).reshape(n, -1)
        return coded.dictionary, out

    def merged(a, b):
        if a is None:
            return b
        ids = pa.concat_arrays([a[0], b[0]]).dictionary_encode()
        out = np.zeros((len(ids.dictionary), a[1].shape[1]))
        at = ids.indices.to_numpy()
        out[at[: len(a[1])]] = a[1]
        out[at[len(a[1]) :]] += b[1]
        return ids.dictionary, out

    def run(batches):
        total, held, n = None, [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= 200_000:
                total, held, n = merged(total, summed(held)), [], 0
        if n:
            total = merged(total, summed(held))
        for i in range(0, len(total[1]) if total else 0, 10_000):
            rows = [r.tobytes() for r in total[1][i : i + 10_000]]
            yield pa.RecordBatch.from_arrays([total[0].slice(i, len(rows)), pa.array(rows, pa.binary())], ["var_id", "sums"])

    return run


def _pair_p(counts: list[int], n_perms: int) -> Callable:
    """(source, target, ligand, receptor, lr_mean, p), groups by number, of rows (ligand, receptor, l, r) with the sums of both."""
    g = len(counts)
    k = (n_perms + 1) * g

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            sides = []
            for c in "lr":
                x = np.frombuffer(b"".join(b.column(c).to_pylist())).reshape(b.num_rows, -1)
                m = x[:, :k].reshape(len(x), n_perms + 1, g) / np.array(counts)
                true = np.where(x[:, k + g :] > 0, m[:, 0], np.nan)
                sides.append((m[:, 1:], true, x[:, k : k + g] > 0, x[:, k + g :] > 0))
            (ml, tl, sl, vl), (mr, tr, sr, vr) = sides
            for s in range(g):
                for t in range(g):
                    at = np.flatnonzero(sl[:, s] & sr[:, t])
                    lr, v = (tl[at, s] + tr[at, t]) / 2, np.round((ml[at, :, s] + mr[at, :, t]) / 2, 9)
                    p = ((v >= np.round(lr, 9)[:, None]) | np.isnan(v)).mean(axis=1)
                    known = vl[at, s] & vr[at, t]
                    rows = pa.array(at)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(len(at), s)), pa.array(np.full(len(at), t)), b.column("ligand").take(rows), b.column("receptor").take(rows), pa.array(lr, mask=~known), pa.array(np.where(known, p, 0.0))
                    ], ["source", "target", "ligand", "receptor", "lr_mean", "p"])

    return run


def label_permutation_p(m, by: str, resource: DataFrame, n_perms: int) -> DataFrame:
    """(source, target, ligand, receptor, lr_mean, p): share of ``n_perms`` shuffles of the groups' labels among the observations with
    (L + R) / 2 at least as large. A shuffle keeps the sizes of the groups; a mean without entries is 0. Entries of the same observation and
    variable add up. An observation carries its labels of all shuffles, so entries are shuffled once to it and once to their variable."""
    obs = m.obs.where(F.col(by).isNotNull() & F.col("obs_id").isNotNull())
    groups = obs.groupBy(by).agg(F.count(F.lit(1)).alias("n")).orderBy(by).collect()  # one row a group
    names, counts = [r[0] for r in groups], [r.n for r in groups]
    kinds = {c: t.schema[c].dataType.simpleString() for c, t in (("obs_id", m.obs), ("var_id", m.entries), ("ligand", resource), ("receptor", resource))}
    hashed = obs.select("obs_id", F.col("obs_id").cast("string").alias("id"), F.col(by).alias("grp"))
    hashed = scratch_table(hashed.mapInArrow(_hashed(names, n_perms), f"obs_id {kinds['obs_id']}, own int, hash binary"), "hashed")
    labels = _shuffled_groups(hashed, kinds["obs_id"], counts, n_perms)
    lab = hashed.select("obs_id", F.col("obs_id").cast("string").alias("id"), "own", "hash").mapInArrow(labels, f"obs_id {kinds['obs_id']}, labels binary")
    e = m.entries.select("obs_id", "var_id", F.col("value").cast("double").alias("value")).where(F.col("var_id").isNotNull())
    e = e.join(lab, "obs_id").select("var_id", "value", "labels").repartition("var_id")
    sums = scratch_table(e.mapInArrow(_label_sums(len(names), n_perms), f"var_id {kinds['var_id']}, sums binary"), "permuted-sums")
    pairs = resource.select("ligand", "receptor").distinct()
    for c, to in (("ligand", "l"), ("receptor", "r")):
        pairs = pairs.join(sums.select(F.col("var_id").alias(c), F.col("sums").alias(to)), c)
    pairs = pairs.select("ligand", "receptor", "l", "r").mapInArrow(_pair_p(counts, n_perms), f"source long, target long, ligand {kinds['ligand']}, receptor {kinds['receptor']}, lr_mean double, p double")
    if not names:
        return pairs.select(*[F.lit(None).cast(m.obs.schema[by].dataType).alias(c) for c in ("source", "target")], "ligand", "receptor", "lr_mean", "p")
    name = F.array(*[F.lit(g).cast(m.obs.schema[by].dataType) for g in names])
    return pairs.select(*[F.element_at(name, (F.col(c) + 1).cast("int")).alias(c) for c in ("source", "target")], "ligand", "receptor", "lr_mean", "p")


def poisson_tail(count: Column, rate: Column, terms: int = 200) -> Column:
    """P(X >= count) of a Poisson variable, for count above 0: the leading term times its ratio series, whose terms fall when count > rate;
    otherwise one minus the sum of the smaller counts."""
    lead = F.aggregate(F.sequence(F.lit(1), count.cast("int")), -rate, lambda a, i: a + F.log(rate) - F.log(i.cast("double")))
    start = F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s"))
    up = F.aggregate(F.sequence(F.lit(1), F.lit(terms)), start, lambda a, j: F.struct((a["t"] * rate / (count + j)).alias("t"), (a["s"] + a["t"] * rate / (count + j)).alias("s")))["s"]
    low = F.struct(F.exp(-rate).alias("t"), F.exp(-rate).alias("s"))
    down = F.when(count > 1, F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), count.cast("int") - 1)), low, lambda a, i: F.struct((a["t"] * rate / i).alias("t"), (a["s"] + a["t"] * rate / i).alias("s")))["s"]).otherwise(F.exp(-rate))
    return F.when(rate <= 0, 0.0).when(count > rate, F.least(F.lit(1.0), F.exp(lead) * up)).otherwise(F.greatest(F.lit(0.0), 1 - down))


def poisson_bins(counts: DataFrame, sizes: DataFrame, width: int, reach: int = 5) -> DataFrame:
    """(chrom, bin, n, rate, p, q): bins (chrom, bin, n > 0) against a Poisson rate, the larger of the genome's mean and the mean of the bins
    within ``reach``; ``sizes`` (chrom, len). q: Benjamini-Hochberg over the bins with counts."""
    bins = sizes.agg(F.sum(F.ceil(F.col("len") / width)).alias("b")).scalar()
    genome = F.try_divide(counts.agg(F.sum("n").alias("s")).scalar(), bins)
    near = counts.select("chrom", F.explode(F.sequence(F.col("bin") - reach, F.col("bin") + reach)).alias("bin"), "n").groupBy("chrom", "bin").agg((F.sum("n") / (2 * reach + 1)).alias("local"))
    x = counts.join(near, ["chrom", "bin"]).withColumn("rate", F.greatest(genome, F.col("local")))
    x = scratch_table(x.select("chrom", "bin", "n", "rate", F.round(poisson_tail(F.col("n"), F.col("rate")), 9).alias("p")), "poisson")
    return benjamini_hochberg(x, "p", [])


def poisson_peaks(counts: DataFrame, sizes: DataFrame, width: int, most_q: float = 0.05, reach: int = 5) -> DataFrame:
    """(chrom, start, end): runs of neighbouring bins with q at most ``most_q``."""
    b = poisson_bins(counts, sizes, width, reach).where(F.col("q") <= most_q).select("chrom", (F.col("bin") * width).alias("start"), ((F.col("bin") + 1) * width).alias("end"))
    return merge_intervals(b, ["chrom"]).where("kind = 'period'").select("chrom", F.col("left_pos").alias("start"), F.col("right_pos").alias("end"))
