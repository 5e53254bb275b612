"""Genomic intervals: bins, overlap joins, counting, enrichment, coverage and peaks.

Positions are 0-based and half-open. Work is keyed by (chromosome, bucket of the position), never by the
chromosome alone, so a chromosome that holds most rows is spread over its buckets.
"""

from __future__ import annotations

import bisect
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparmat.operators.intervals import merge_intervals
from sparmat.operators.relational import natural_key
from sparmat.session import scratch_table

UP_TO = (Window.unboundedPreceding, Window.currentRow)


# --- genome index -----------------------------------------------------------------------------------
def genome_index(chrom_sizes: DataFrame, step: int = 1) -> DataFrame:
    """(chrom, len, base_off, bin_off): offsets of each chromosome in natural order; one row a chromosome."""
    w = Window.orderBy(*natural_key(F.col("chrom"))).rowsBetween(*UP_TO)
    bins = F.ceil(F.col("len") / step)
    return chrom_sizes.select("chrom", "len", (F.sum("len").over(w) - F.col("len")).alias("base_off"), (F.sum(bins).over(w) - bins).alias("bin_off"))


def to_index(df: DataFrame, index: DataFrame, chrom: str, pos: str, step: int = 1) -> DataFrame:
    """Adds ``bin``: the linear bin of a position; positions outside their chromosome are left out."""
    return df.join(index, chrom).where((F.col(pos) >= 0) & (F.col(pos) < F.col("len"))).withColumn("bin", F.col("bin_off") + F.floor(F.col(pos) / step)).drop("len", "base_off", "bin_off")


def from_index(df: DataFrame, index: DataFrame, bin_col: str, step: int = 1) -> DataFrame:
    """(bin, chrom, start, end) of linear bins; a bin beyond the genome has no row.

    Chromosomes are few and fixed: each row looks its offset up in an array built from the index.
    """
    arr = index.agg(F.array_sort(F.collect_list(F.struct("bin_off", "chrom", "len"))).alias("a")).scalar()  # one entry a chromosome
    d = df.withColumn("_a", arr)
    d = d.withColumn("_c", F.element_at(F.filter("_a", lambda x: x["bin_off"] <= F.col(bin_col)), -1))
    start = (F.col(bin_col) - F.col("_c.bin_off")) * step
    return d.select(bin_col, F.col("_c.chrom").alias("chrom"), start.alias("start"), F.least(start + step, F.col("_c.len")).alias("end")).where("start < end")


# --- fragments ----------------------------------------------------------------------------------------
def shift(frags: DataFrame, left: int, right: int) -> DataFrame:
    """Cut-site correction: start by ``left``; end by ``right``, or by ``left`` too for stranded rows."""
    return frags.withColumns({"start": F.col("start") + left, "end": F.col("end") + F.when(F.col("strand").isin("+", "-"), left).otherwise(right)})


def insertions(frags: DataFrame) -> DataFrame:
    """Cut sites ``pos``: both ends of an unstranded fragment, the 5' end of a stranded one."""
    both = F.array(F.col("start"), F.col("end") - 1)
    pos = F.when(F.col("strand") == "+", F.array("start")).when(F.col("strand") == "-", F.array(F.col("end") - 1)).otherwise(both)
    return frags.withColumn("pos", F.explode(pos))


def tile_counts(frags: DataFrame, by: str, width: int, strategy: str, ident: str = "frag_id", min_size: int | None = None, max_size: int | None = None, exclude: Sequence[str] = ()) -> DataFrame:
    """(by, chrom, tile, n) by strategy: 'insertion' (each cut site), 'fragment' (each tile overlapped once) or
    'paired-insertion' (distinct tiles of the two ends). Stranded rows always count by insertion."""
    size = F.col("end") - F.col("start")
    f = frags.where(~F.col("chrom").isin(*exclude)) if exclude else frags
    f = f.where(size >= min_size) if min_size is not None else f
    f = f.where(size <= max_size) if max_size is not None else f
    a, b = F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width)
    tiles = {"insertion": F.array(a, b), "fragment": F.sequence(a, b), "paired-insertion": F.array_distinct(F.array(a, b))}[strategy]
    tiles = F.when(F.col("strand") == "+", F.array(a)).when(F.col("strand") == "-", F.array(b)).otherwise(tiles)
    return f.select(by, "chrom", F.explode(tiles).alias("tile")).groupBy(by, "chrom", "tile").agg(F.count(F.lit(1)).alias("n"))


def overlap_join(a: DataFrame, b: DataFrame, a_chrom: str, a_start: str, a_end: str, b_chrom: str, b_start: str, b_end: str, width: int = 1 << 14) -> DataFrame:
    """All pairs of overlapping intervals (a.start < b.end and b.start < a.end on one chromosome).

    Both sides are spread over the buckets they touch and joined by (chromosome, bucket); a pair is emitted only in
    the bucket of its first shared base, so no pair comes twice and no distinct is needed. Rows with
    null or empty intervals join nothing. Column names of the two sides must differ.
    """
    cover = lambda s, e: F.explode(F.sequence(F.floor(F.col(s) / width), F.floor((F.col(e) - 1) / width)))
    x = a.where(F.col(a_start) < F.col(a_end)).withColumn("_ba", cover(a_start, a_end))
    y = b.where(F.col(b_start) < F.col(b_end)).withColumn("_bb", cover(b_start, b_end))
    on = (F.col(a_chrom) == F.col(b_chrom)) & (F.col("_ba") == F.col("_bb")) & (F.col(a_start) < F.col(b_end)) & (F.col(b_start) < F.col(a_end))
    return x.join(y, on & (F.col("_ba") == F.floor(F.greatest(a_start, b_start) / width))).drop("_ba", "_bb")


def region_counts(frags: DataFrame, regions: DataFrame, by: str, region: str, strategy: str, ident: str = "frag_id") -> DataFrame:
    """(by, region, n): fragments, insertions or paired insertions per region (regions: region, r_chrom, r_start, r_end)."""
    if strategy == "fragment":
        return overlap_join(frags, regions, "chrom", "start", "end", "r_chrom", "r_start", "r_end").groupBy(by, region).agg(F.count(F.lit(1)).alias("n"))
    ins = insertions(frags).select(by, ident, "chrom", "pos", (F.col("pos") + 1).alias("pos_end"))
    hits = overlap_join(ins, regions, "chrom", "pos", "pos_end", "r_chrom", "r_start", "r_end")
    n = F.count(F.lit(1)) if strategy == "insertion" else F.count_distinct(ident)
    return hits.groupBy(by, region).agg(n.alias("n"))


def frip(frags: DataFrame, regions: DataFrame, by: str, ident: str = "frag_id") -> DataFrame:
    """(by, n, in_regions, frip): share of fragments that overlap a region, each counted once. Regions are merged first."""
    merged = merge_intervals(regions, ["r_chrom"], "r_start", "r_end").where("kind = 'period'").select("r_chrom", F.col("left_pos").alias("r_start"), F.col("right_pos").alias("r_end"))
    hit = overlap_join(frags.select(by, ident, "chrom", "start", "end"), merged, "chrom", "start", "end", "r_chrom", "r_start", "r_end")
    inside = hit.groupBy(by).agg(F.count_distinct(ident).alias("in_regions"))
    n = frags.groupBy(by).agg(F.count_distinct(ident).alias("n"))
    return n.join(inside, by, "left").fillna(0, ["in_regions"]).withColumn("frip", F.col("in_regions") / F.col("n"))


def fragment_qc(frags: DataFrame, by: str, mito: Sequence[str]) -> DataFrame:
    """Fragments outside the mitochondrion, duplicate share 1 - rows / sum(count), mitochondrial share of all rows."""
    m = F.col("chrom").isin(*mito)
    g = frags.groupBy(by).agg(F.count(F.when(~m, 1)).alias("n_fragments"), F.sum(F.when(~m, F.coalesce("count", F.lit(1)))).alias("c"), F.count(F.when(m, 1)).alias("k"), F.count(F.lit(1)).alias("n"))
    return g.select(by, "n_fragments", F.when(F.col("c") > 0, 1 - F.col("n_fragments") / F.col("c")).otherwise(0.0).alias("pct_dup"), (F.col("k") / F.col("n")).alias("pct_mito"))


def size_histogram(frags: DataFrame, most: int) -> DataFrame:
    """(size, n): index 0 holds the sizes beyond ``most``."""
    size = F.col("end") - F.col("start")
    return frags.groupBy(F.when(size <= most, size).otherwise(0).alias("size")).agg(F.count(F.lit(1)).alias("n"))


def chrom_summary(frags: DataFrame, by: str, chroms: Sequence[str]) -> DataFrame:
    """Fragments per (by, chromosome) as columns, 0 where there are none."""
    return frags.groupBy(by).pivot("chrom", list(chroms)).count().fillna(0)


def tss_sites(genes: DataFrame) -> DataFrame:
    """Distinct (t_chrom, tss, reverse): the start, or for '-' the end - 1; only '-' counts as reverse."""
    rev = F.coalesce(F.col("strand") == "-", F.lit(False))
    return genes.select(F.col("chr").alias("t_chrom"), F.when(rev, F.col("end") - 1).otherwise(F.col("start")).alias("tss"), rev.alias("reverse")).distinct()


def tss_profile(frags: DataFrame, sites: DataFrame, by: str, reach: int = 2000) -> DataFrame:
    """(by, offset, n): insertions by their distance from each site within ``reach``, in the site's direction."""
    win = sites.select("t_chrom", "tss", "reverse", (F.col("tss") - reach).alias("w0"), (F.col("tss") + reach + 1).alias("w1"))
    ins = insertions(frags).select(by, "chrom", "pos", (F.col("pos") + 1).alias("pos_end"))
    hit = overlap_join(ins, win, "chrom", "pos", "pos_end", "t_chrom", "w0", "w1")
    off = F.when(F.col("reverse"), F.col("tss") - F.col("pos")).otherwise(F.col("pos") - F.col("tss"))
    return hit.groupBy(by, off.alias("offset")).agg(F.count(F.lit(1)).alias("n"))


def tss_enrichment(frags: DataFrame, sites: DataFrame, by: str, reach: int = 2000) -> DataFrame:
    """Mean of the 11 central offsets over the mean of the 200 outermost plus 0.1."""
    p = tss_profile(frags, sites, by, reach)
    mid = F.sum(F.when(F.abs("offset") <= 5, F.col("n")).otherwise(0)) / 11
    flank = F.sum(F.when((F.col("offset") < -reach + 100) | (F.col("offset") > reach - 100), F.col("n")).otherwise(0)) / 200
    return p.groupBy(by).agg((mid / (flank + 0.1)).alias("tsse"))


def nearest_feature(points: DataFrame, sites: DataFrame, ident: str, chrom: str, pos: str, reach: int) -> DataFrame:
    """(ident, tss, distance): the nearest site within ``reach``, ties to the smaller site; signed distance pos - site."""
    win = sites.select("t_chrom", "tss", (F.col("tss") - reach).alias("w0"), (F.col("tss") + reach + 1).alias("w1"))
    p = points.select(ident, chrom, F.col(pos).alias("_p"), (F.col(pos) + 1).alias("_p1"))
    hit = overlap_join(p, win, chrom, "_p", "_p1", "t_chrom", "w0", "w1", width=max(1 << 14, reach))
    best = hit.groupBy(ident).agg(F.min(F.struct(F.abs(F.col("_p") - F.col("tss")).alias("d"), F.col("tss"), (F.col("_p") - F.col("tss")).alias("s"))).alias("b"))
    return best.select(ident, F.col("b.tss").alias("tss"), F.col("b.s").alias("distance"))


def priority_overlay(peaks: DataFrame, labelled: DataFrame, ident: str, default: str) -> DataFrame:
    """(ident, label): of the labelled regions (r_chrom, r_start, r_end, label, priority) that overlap, the highest priority."""
    hit = overlap_join(peaks, labelled, "chr", "start", "end", "r_chrom", "r_start", "r_end")
    best = hit.groupBy(ident).agg(F.max(F.struct("priority", "label")).alias("b"))
    return peaks.select(ident).join(best, ident, "left").select(ident, F.coalesce("b.label", F.lit(default)).alias("label"))


def union_length(df: DataFrame, keys: Sequence[str], start: str = "start", end: str = "end") -> DataFrame:
    m = merge_intervals(df, keys, start, end).where("kind = 'period'")
    return m.groupBy(*keys).agg(F.sum(F.col("right_pos") - F.col("left_pos")).alias("total"))


def reproducible(peaks: DataFrame, replicates: Sequence[DataFrame], blacklist: DataFrame | None, ident: str) -> DataFrame:
    """Peaks (ident, chr, start, end) that overlap a peak of every replicate and nothing of the blacklist."""
    as_regions = lambda d: d.select(F.col("chr").alias("r_chrom"), F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    out = peaks
    for r in replicates:
        out = out.join(overlap_join(out, as_regions(r), "chr", "start", "end", "r_chrom", "r_start", "r_end").select(ident).distinct(), ident, "left_semi")
    if blacklist is not None:
        out = out.join(overlap_join(out, as_regions(blacklist), "chr", "start", "end", "r_chrom", "r_start", "r_end").select(ident).distinct(), ident, "left_anti")
    return out


def sets_overlapped(peaks: DataFrame, ident: str, by: str) -> DataFrame:
    """(ident, sets, every): for each peak the number of other sets (``by``) with a peak overlapping it, and whether that is all of them.

    One overlap join of all peaks with themselves; ``peaks``: ident, by, chr, start, end, ``by`` not null.
    """
    other = peaks.select(F.col(by).alias("_by"), F.col("chr").alias("r_chrom"), F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    n = overlap_join(peaks, other, "chr", "start", "end", "r_chrom", "r_start", "r_end").where(F.col(by) != F.col("_by")).groupBy(ident).agg(F.countDistinct("_by").alias("sets"))
    out = peaks.select(ident).join(n, ident, "left").select(ident, F.coalesce("sets", F.lit(0)).alias("sets"))
    rest = peaks.agg((F.countDistinct(by) - 1).alias("n")).scalar()
    return out.withColumn("every", F.col("sets") == rest)


# --- tracks -------------------------------------------------------------------------------------------
def running_sums(df: DataFrame, key: str, pos: str, values: Sequence[str], block: int = 1 << 20) -> DataFrame:
    """Running sums of ``values`` by position, and the next position ``_next``, per key.

    Positions are summed per (key, block of positions); the totals of the earlier blocks (one row a block)
    are added, so no task orders a whole key.
    """
    d = scratch_table(df.groupBy(key, pos).agg(*[F.sum(v).alias(v) for v in values]).withColumn("_b", F.floor(F.col(pos) / block)), "events")  # read twice
    w = Window.partitionBy(key, "_b").orderBy(pos)
    local = d.withColumns({v: F.sum(v).over(w.rowsBetween(*UP_TO)) for v in values} | {"_next": F.lead(pos).over(w)})
    per = d.groupBy(key, "_b").agg(F.min(pos).alias("_first"), *[F.sum(v).alias(f"_t_{v}") for v in values])
    wb = Window.partitionBy(key).orderBy("_b")
    per = per.select(key, "_b", F.lead("_first").over(wb).alias("_then"), *[(F.sum(f"_t_{v}").over(wb.rowsBetween(*UP_TO)) - F.col(f"_t_{v}")).alias(f"_p_{v}") for v in values])
    out = local.join(per, [key, "_b"])
    return out.select(key, pos, *[(F.col(v) + F.col(f"_p_{v}")).alias(v) for v in values], F.coalesce("_next", "_then").alias("_next"))


def coverage(frags: DataFrame, key: str, width: int, sizes: DataFrame | None = None, start: str = "start", end: str = "end") -> DataFrame:
    """bedGraph (key, start, end, value): depth of intervals snapped to bins, neighbours of equal depth merged.

    Depth changes at the events that remain after opposite ones cancelled, so merged runs need no second
    pass. With ``sizes`` (key, len) the last segments are clipped.
    """
    ev = frags.select(
        key, F.explode(F.array(F.struct((F.floor(F.col(start) / width) * width).alias("pos"), F.lit(1).alias("d")), F.struct((F.ceil(F.col(end) / width) * width).alias("pos"), F.lit(-1).alias("d")))).alias("e")
    )
    ev = ev.groupBy(key, F.col("e.pos").alias("pos")).agg(F.sum("e.d").alias("d")).where("d <> 0")
    seg = running_sums(ev, key, "pos", ["d"]).where("d <> 0").select(key, F.col("pos").alias("start"), F.col("_next").alias("end"), F.col("d").alias("value"))
    if sizes is not None:
        seg = seg.join(sizes, key).withColumn("end", F.least("end", "len")).where("start < end").drop("len")
    return seg


def scale_track(track: DataFrame, by: Sequence[str], how: str) -> DataFrame:
    """'bpm': value / (sum of length x value / 1e6); 'cpm': value / (sum of values of the segments / 1e6) per ``by``; null for a sum of 0."""
    w = F.sum((F.col("end") - F.col("start")) * F.col("value")) if how == "bpm" else F.sum("value")
    t = track.groupBy(*by).agg(w.alias("_t")) if by else track.agg(w.alias("_t"))
    if not by:
        return track.withColumn("value", F.try_divide(F.col("value") * 1e6, t.scalar()))
    return track.join(t, list(by)).withColumn("value", F.try_divide(F.col("value") * 1e6, F.col("_t"))).drop("_t")


def smooth(track: DataFrame, key: str, half: int) -> DataFrame:
    """Box filter of width 2 half + 1 as a piecewise linear track (key, pos, value, slope, until).

    At x in [pos, until) the smoothed value is value + slope (x - pos); the divisor is 2 half + 1 also at
    the borders. A segment changes the slope at four positions, so nothing is expanded to bases.
    """
    v = F.col("value").cast("double")
    at = lambda p, s: F.struct(p.alias("pos"), (s * v).alias("e"))
    ev = track.select(
        key,
        F.explode(F.array(at(F.col("start") - half, 1), at(F.col("end") - half, -1), at(F.col("start") + half + 1, -1), at(F.col("end") + half + 1, 1))).alias("x"),
    ).select(key, F.col("x.pos").alias("pos"), F.col("x.e").alias("e"), (F.col("x.e") * F.col("x.pos")).alias("ep"))
    r = running_sums(ev, key, "pos", ["e", "ep"])
    n = 2 * half + 1
    return r.where("_next IS NOT NULL").select(key, "pos", (((F.col("pos") + 1) * F.col("e") - F.col("ep")) / n).alias("value"), (F.col("e") / n).alias("slope"), F.col("_next").alias("until"))


def threshold_peaks(track: DataFrame, key: str, cutoff: float, min_length: int, max_gap: int) -> DataFrame:
    """Runs of value >= cutoff, joined over gaps of at most ``max_gap``, of at least ``min_length``."""
    hi = track.where(F.col("value") >= cutoff).select(key, "start", (F.col("end") + max_gap).alias("end"))
    m = merge_intervals(hi, [key]).where("kind = 'period'")
    return m.select(key, F.col("left_pos").alias("start"), (F.col("right_pos") - max_gap).alias("end")).where(F.col("end") - F.col("start") >= min_length)


def merge_peaks(peaks: DataFrame, half: int, sizes: DataFrame | None = None) -> DataFrame:
    """Fixed-width peaks around the summits, kept greedily by the highest p (a -log10 value), none overlapping a kept one.

    ``peaks``: chrom, start, peak (summit offset), p_value. Equal p goes to the smaller position. Overlapping windows form islands (found
    without one task per chromosome); the greedy choice runs within an island. Distinct windows only are
    sent, so an island holds at most as many rows as it has positions.
    """
    s = F.col("start") + F.col("peak")
    w = peaks.select("chrom", F.greatest(F.lit(0), s - half).alias("start"), (s + half + 1).alias("end"), s.alias("summit"), "p_value")
    if sizes is not None:
        w = w.join(sizes, "chrom").withColumn("end", F.least("end", "len")).drop("len")
    w = w.where("start < end AND p_value IS NOT NULL").groupBy("chrom", "start", "end", "summit").agg(F.max("p_value").alias("p_value"))
    isl = merge_intervals(w, ["chrom"]).where("kind = 'period'").select(F.col("chrom").alias("i_chrom"), F.col("left_pos").alias("i_start"), F.col("right_pos").alias("i_end"))
    placed = overlap_join(w, isl, "chrom", "start", "end", "i_chrom", "i_start", "i_end")

    def greedy(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["p_value", "start"], ascending=[False, True], kind="stable")
        kept: list[int] = []
        spans: list[tuple[int, int]] = []  # disjoint, sorted
        for i, (a, b) in enumerate(zip(pdf["start"].tolist(), pdf["end"].tolist())):
            k = bisect.bisect(spans, (a, b))
            if (k == 0 or spans[k - 1][1] <= a) and (k == len(spans) or b <= spans[k][0]):
                kept.append(i)
                spans.insert(k, (a, b))
        return pdf.iloc[kept][["chrom", "start", "end", "p_value", "summit"]]

    fields = {f.name: f.dataType.simpleString() for f in placed.schema.fields}
    schema = ", ".join(f"`{c}` {fields[c]}" for c in ("chrom", "start", "end", "p_value", "summit"))
    got = placed.groupBy("i_chrom", "i_start").applyInPandas(greedy, schema)
    return got.select("chrom", "start", "end", "p_value", (F.col("summit") - F.col("start")).alias("peak"))


# --- reads, contacts, sequences -----------------------------------------------------------------------
def ratio(numer: Column, denom: Column) -> Column:
    return F.when(numer == 0, 0.0).when(denom == 0, 1.0).otherwise(numer / denom)


def coarsen_contacts(contacts: DataFrame, width: int) -> DataFrame:
    """(barcode, chrom1, bin1, chrom2, bin2, n) of contacts (barcode, chrom1, start1, chrom2, start2, count)."""
    return contacts.groupBy("barcode", "chrom1", F.floor(F.col("start1") / width).alias("bin1"), "chrom2", F.floor(F.col("start2") / width).alias("bin2")).agg(F.sum(F.coalesce("count", F.lit(1))).alias("n"))


def unique_reads(reads: DataFrame, fingerprint: Sequence[str], quality: str, ident: str) -> DataFrame:
    """One read per fingerprint, the best by quality then id, with the number of copies."""
    return reads.groupBy(*fingerprint).agg(F.max(F.struct(F.col(quality), (-F.col(ident)).alias("_i"))).alias("_b"), F.count(F.lit(1)).alias("copies")).select(
        *fingerprint, (-F.col("_b._i")).alias(ident), F.col(f"_b.{quality}").alias(quality), "copies"
    )


def flag_counts(reads: DataFrame, flag: str, names: dict[str, int]) -> DataFrame:
    """Rows whose flag has each named bit."""
    return reads.agg(F.count(F.lit(1)).alias("total"), *[F.count(F.when(F.col(flag).bitwiseAND(bit) != 0, 1)).alias(n) for n, bit in names.items()])


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGTacgt", "TGCAtgca"))


def gc_content(seq: Column) -> Column:
    """(C + G) / (length - N), 0.5 when nothing is left."""
    n = F.length(seq) - F.length(F.regexp_replace(seq, "[CGcg]", ""))
    known = F.length(F.regexp_replace(seq, "[Nn]", ""))
    return F.when(known > 0, n / known).otherwise(0.5)


def motif_scan(df: DataFrame, ident: str, seq: str, pwm: Sequence[Sequence[float]], threshold: float) -> DataFrame:
    """(ident, pos, strand, score): log-odds hits (background 1/4 each) of both strands at or above ``threshold``.

    Every window of a sequence is scored with array expressions on the JVM; letters other than ACGT score
    as the worst base. A sequence shorter than the motif has no hits.
    """
    import math

    rows = [[math.log2(max(p, 1e-4) / 0.25) for p in r] for r in pwm]
    table = lambda m: F.create_map(*[x for i, r in enumerate(m) for b, v in zip("ACGT", r) for x in (F.lit(f"{i}{b}"), F.lit(v))])
    n = len(rows)
    s = F.upper(seq)
    back = [list(reversed(r)) for r in reversed(rows)]  # reverse complement of the matrix
    pos = F.when(F.length(s) >= n, F.sequence(F.lit(0), F.length(s) - n)).otherwise(F.array().cast("array<int>"))

    def one(m: list, strand: str) -> DataFrame:
        look, worst = table(m), [min(r) for r in m]

        def score(p: Column) -> Column:
            return sum((F.coalesce(look[F.concat(F.lit(str(i)), F.substring(s, p + i + 1, F.lit(1)))], F.lit(worst[i])) for i in range(n)), F.lit(0.0))

        hits = F.transform(pos, lambda p: F.struct(p.alias("pos"), score(p).alias("score")))
        d = df.select(ident, F.explode(F.filter(hits, lambda h: h["score"] >= threshold)).alias("h"))
        return d.select(ident, F.col("h.pos").alias("pos"), F.lit(strand).alias("strand"), F.col("h.score").alias("score"))

    return one(rows, "+").unionByName(one(back, "-"))
