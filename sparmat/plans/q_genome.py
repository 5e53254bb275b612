"""Queries over genomic intervals: counting, enrichment, coverage, peaks, sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparmat.functions.text import barcode_code, barcode_text, chrom_label
from sparmat.operators import genome as G
from sparmat.plans.core_problems import _placed_peaks
from sparmat.session import scratch_table, table


def _frags(s, d):
    names = table(s, d, "chrom_sizes").select(F.col("chrom").alias("_c"), chrom_label(F.col("chrom")).alias("_l"))
    f = table(s, d, "fragment").select("frag_id", "sample", chrom_label(F.col("chrom")).alias("_l"), "start", "end", "strand", "count")
    return f.where("0 <= start AND start < end").join(names, "_l").select("frag_id", "sample", F.col("_c").alias("chrom"), "start", "end", "strand", "count")


def _genes(s, d):
    return table(s, d, "genes").where("start < end").select("uid", "chr", "start", "end", "strand")


def _regions(df, *extra):
    return df.select(*extra, F.col("chr").alias("r_chrom"), F.col("start").alias("r_start"), F.col("end").alias("r_end"))


def genome_offset(s, d):
    ix = G.genome_index(table(s, d, "chrom_sizes"), 500)
    return G.to_index(_frags(s, d).select("frag_id", "chrom", "start"), ix, "chrom", "start", 500).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


def genome_locus(s, d):
    return G.from_index(genome_offset(s, d), G.genome_index(table(s, d, "chrom_sizes"), 500), "bin", 500)


def tile_insertion(s, d):
    return G.tile_counts(_frags(s, d), "sample", 5000, "insertion", exclude=["chrM"])


def tile_fragment(s, d):
    return G.tile_counts(_frags(s, d), "sample", 100, "fragment", min_size=50, max_size=300)


def tile_paired(s, d):
    return G.tile_counts(_frags(s, d), "sample", 100, "paired-insertion")


def peak_matrix(s, d):
    return G.region_counts(_frags(s, d), _regions(_genes(s, d), "uid"), "sample", "uid", "fragment")


def peak_matrix_insertion(s, d):
    return G.region_counts(_frags(s, d), _regions(_genes(s, d), "uid"), "sample", "uid", "insertion")


def peak_matrix_paired(s, d):
    return G.region_counts(_frags(s, d), _regions(_genes(s, d), "uid"), "sample", "uid", "paired")


def gene_activity(s, d):
    """Fragments over the gene body with 2000 bases before its start (in its direction), per gene the maximum over windows."""
    g = _genes(s, d)
    up = g.select("uid", "chr", F.when(F.col("strand") == "-", F.col("start")).otherwise(F.greatest(F.lit(0), F.col("start") - 2000)).alias("start"), F.when(F.col("strand") == "-", F.col("end") + 2000).otherwise(F.col("end")).alias("end"))
    return G.region_counts(_frags(s, d), _regions(up, "uid"), "sample", "uid", "fragment").groupBy("sample", "uid").agg(F.max("n").alias("activity"))


def frip(s, d):
    return G.frip(_frags(s, d), _regions(_placed_peaks(s, d)), "sample").select("sample", "n", "in_regions", F.round("frip", 9).alias("frip"))


def fragment_qc(s, d):
    return G.fragment_qc(_frags(s, d), "sample", ["chrM"]).select("sample", "n_fragments", F.round("pct_dup", 9).alias("pct_dup"), F.round("pct_mito", 9).alias("pct_mito"))


def size_histogram(s, d):
    return G.size_histogram(_frags(s, d), 200)


def chrom_summary(s, d):
    return G.chrom_summary(_frags(s, d), "sample", ["chr1", "chr2", "chrX", "chrM"])


def tss_profile(s, d):
    return G.tss_profile(_frags(s, d), G.tss_sites(_genes(s, d)), "sample")


def tss_enrichment(s, d):
    return G.tss_enrichment(_frags(s, d), G.tss_sites(_genes(s, d)), "sample").select("sample", F.round("tsse", 9).alias("tsse"))


def _peaks(s, d):
    """Peaks with an id: one row per call set, chromosome, start and end."""
    return _placed_peaks(s, d).distinct().select(F.concat_ws(":", "call_set", "chr", F.col("start").cast("string"), F.col("end").cast("string")).alias("pid"), "call_set", "chr", "start", "end")


def nearest_tss(s, d):
    return G.nearest_feature(_peaks(s, d), G.tss_sites(_genes(s, d)), "pid", "chr", "start", 100_000)


def priority_overlay(s, d):
    g = _genes(s, d)
    body = _regions(g).select("*", F.lit("genebody").alias("label"), F.lit(1).alias("priority"))
    t = G.tss_sites(g)
    prom = t.select(F.col("t_chrom").alias("r_chrom"), (F.col("tss") - 1000).alias("r_start"), (F.col("tss") + 1000).alias("r_end"), F.lit("promoter").alias("label"), F.lit(2).alias("priority"))
    return G.priority_overlay(_peaks(s, d), body.unionByName(prom), "pid", "intergenic")


def union_length(s, d):
    return G.union_length(_placed_peaks(s, d), ["chr"])


def reproducible_peaks(s, d):
    """Peaks that meet a gene of either strand (two replicates) and none of unknown strand (the blacklist)."""
    g = _genes(s, d)
    of = lambda c: g.where(c).select("chr", "start", "end")
    return G.reproducible(_peaks(s, d), [of("strand = '+'"), of("strand = '-'")], of("strand IS NULL"), "pid").select("pid")


def peaks_in_sets(s, d):
    """The peaks of all call sets, each against every other call set as a replicate."""
    return G.sets_overlapped(scratch_table(_peaks(s, d).where("call_set IS NOT NULL"), "peaks"), "pid", "call_set")


def coverage(s, d):
    return G.coverage(_frags(s, d), "chrom", 1000, table(s, d, "chrom_sizes"))


def coverage_bpm(s, d):
    return G.scale_track(coverage(s, d), [], "bpm").select("chrom", "start", "end", F.round("value", 9).alias("value"))


def coverage_cpm(s, d):
    return G.scale_track(coverage(s, d), ["chrom"], "cpm").select("chrom", "start", "end", F.round("value", 9).alias("value"))


def coverage_smooth(s, d):
    return G.smooth(coverage(s, d), "chrom", 700).select("chrom", "pos", F.round("value", 6).alias("value"), F.round("slope", 9).alias("slope"), "until")


def threshold_peaks(s, d):
    return G.threshold_peaks(coverage(s, d), "chrom", 2, 1000, 3000)


def merge_peaks(s, d):
    p = _placed(s, d)
    return G.merge_peaks(p, 200, table(s, d, "chrom_sizes"))


def _placed(s, d):
    names = table(s, d, "chrom_sizes").select("chrom", chrom_label(F.col("chrom")).alias("_l"))
    p = table(s, d, "peaks").where("0 <= start AND start < end AND summit IS NOT NULL").withColumn("_l", chrom_label(F.col("chr")))
    return p.join(names, "_l").select("chrom", "start", F.col("summit").alias("peak"), F.col("p").alias("p_value"))


def base_ratio(s, d):
    f = _frags(s, d).groupBy("chrom").agg(F.count(F.when(F.col("strand") == "+", 1)).alias("numer"), F.count("strand").alias("denom"))
    return f.select("chrom", F.round(G.ratio(F.col("numer"), F.col("denom")), 9).alias("ratio"))


def contacts(s, d):
    c = _frags(s, d).select(F.col("sample").alias("barcode"), F.col("chrom").alias("chrom1"), F.col("start").alias("start1"), F.col("chrom").alias("chrom2"), F.col("end").alias("start2"), "count")
    return G.coarsen_contacts(c, 1_000_000)


def unique_reads(s, d):
    return G.unique_reads(_frags(s, d).fillna(1, ["count"]), ["sample", "chrom", "start", "end"], "count", "frag_id")


def flag_counts(s, d):
    return G.flag_counts(table(s, d, "lineitem"), "l_linenumber", {"paired": 1, "proper": 2, "unmapped": 4})


def sequence_ops(s, d):
    b = table(s, d, "fragment").select(barcode_text(barcode_code(F.col("barcode"))).alias("seq")).where("seq IS NOT NULL").distinct()
    return b.select("seq", G.reverse_complement(F.col("seq")).alias("revcomp"), F.round(G.gc_content(F.col("seq")), 6).alias("gc"))


_PWM = [(0.7, 0.1, 0.1, 0.1), (0.1, 0.1, 0.7, 0.1), (0.1, 0.7, 0.1, 0.1), (0.1, 0.1, 0.1, 0.7)]


def motif_scan(s, d):
    b = table(s, d, "fragment").select(barcode_text(barcode_code(F.col("barcode"))).alias("seq")).where("seq IS NOT NULL").distinct()
    return G.motif_scan(b, "seq", F.col("seq"), _PWM, 3.0).select("seq", "pos", "strand", F.round("score", 6).alias("score"))


def region_gene_links(s, d):
    """Regions linked to genes within 50 kb: 0 if the start site lies inside, else the smallest distance to an edge."""
    t = _genes(s, d).select("uid", F.col("chr").alias("t_chrom"), F.when(F.col("strand") == "-", F.col("end") - 1).otherwise(F.col("start")).alias("tss"))
    win = t.select("uid", "t_chrom", "tss", (F.col("tss") - 50_000).alias("w0"), (F.col("tss") + 50_001).alias("w1"))
    hit = G.overlap_join(_peaks(s, d), win, "chr", "start", "end", "t_chrom", "w0", "w1", width=1 << 17)
    dist = F.when(F.col("tss").between(F.col("start"), F.col("end") - 1), 0).otherwise(F.least(F.abs(F.col("start") - F.col("tss")), F.abs(F.col("end") - 1 - F.col("tss"))))
    return hit.groupBy("pid", "uid").agg(F.min(dist).alias("distance"))


FUNCS = (
    genome_offset, genome_locus, tile_insertion, tile_fragment, tile_paired, peak_matrix, peak_matrix_insertion, peak_matrix_paired, gene_activity, frip, fragment_qc, size_histogram,
    chrom_summary, tss_profile, tss_enrichment, nearest_tss, priority_overlay, union_length, reproducible_peaks, peaks_in_sets, coverage, coverage_bpm, coverage_cpm, coverage_smooth, threshold_peaks,
    merge_peaks, base_ratio, contacts, unique_reads, flag_counts, sequence_ops, motif_scan, region_gene_links,
)
QUERIES = {f.__name__: f for f in FUNCS}

_RX = r"'^\s*(?:[a-z][a-z0-9]*[\s_.:-]+)?(?:chr(?:om(?:osome)?)?)?[\s_.:-]*0*([0-9]+|[a-z])\s*$', 1, 'i'"
B = f"""WITH cs AS (SELECT chrom, len, upper(regexp_extract(chrom, '^chr(.*)$', 1)) AS l, sum(len) OVER w - len AS base_off, sum(ceil(len / 500)) OVER w - ceil(len / 500) AS bin_off
  FROM chrom_sizes WINDOW w AS (ORDER BY coalesce(TRY_CAST(regexp_extract(chrom, '[0-9]+') AS INT), 999), chrom)),
fr AS (SELECT frag_id, sample, cs.chrom, start AS s, "end" AS e, strand, count AS c FROM fragment f JOIN cs ON cs.l = upper(regexp_extract(f.chrom, {_RX})) WHERE 0 <= start AND start < "end"),
ins AS (SELECT *, s AS pos FROM fr WHERE strand IS NULL OR strand <> '-' UNION ALL SELECT *, e - 1 FROM fr WHERE strand IS NULL OR strand <> '+'),
ge AS (SELECT uid, chr, start AS s, "end" AS e, strand, CASE WHEN strand = '-' THEN "end" - 1 ELSE start END AS tss, coalesce(strand = '-', false) AS rev FROM genes WHERE start < "end"),
pp AS (SELECT call_set, cs.chrom AS chr, start AS s, "end" AS e, summit, p FROM peaks k JOIN cs ON cs.l = upper(regexp_extract(k.chr, {_RX})) WHERE 0 <= start AND start < "end"),
pk AS (SELECT DISTINCT call_set || ':' || chr || ':' || s || ':' || e AS pid, call_set, chr, s, e FROM pp),
ts AS (SELECT DISTINCT chr, tss, rev FROM ge)
"""
_TILES = B + """, st AS (SELECT *, s // {0} AS a, (e - 1) // {0} AS b FROM fr WHERE {1}),
u AS ({2}) SELECT sample, chrom, tile, count(*) AS n FROM u GROUP BY ALL"""
_STR = "SELECT sample, chrom, a AS tile FROM st WHERE strand = '+' UNION ALL SELECT sample, chrom, b FROM st WHERE strand = '-' UNION ALL "
_COV = B + """, ev AS (SELECT chrom, s // 1000 * 1000 AS pos, 1 AS d FROM fr UNION ALL SELECT chrom, (e + 999) // 1000 * 1000, -1 FROM fr),
ea AS (SELECT chrom, pos, sum(d) AS d FROM ev GROUP BY ALL HAVING sum(d) <> 0),
rs AS (SELECT chrom, pos AS s, lead(pos) OVER w AS e, sum(d) OVER w AS v FROM ea WINDOW w AS (PARTITION BY chrom ORDER BY pos)),
cv AS (SELECT chrom, s AS "start", CAST(least(e, len) AS BIGINT) AS "end", CAST(v AS BIGINT) AS value FROM rs JOIN cs USING (chrom) WHERE v <> 0 AND s < least(e, len))
"""
_PROFILE = ", pr AS (SELECT sample, CASE WHEN rev THEN tss - pos ELSE pos - tss END AS off, count(*) AS n FROM ins JOIN ts ON ins.chrom = ts.chr AND pos BETWEEN tss - 2000 AND tss + 2000 GROUP BY ALL)"
ORACLE = {
    "genome_offset": B + 'SELECT CAST(bin_off + s // 500 AS BIGINT) AS bin, count(*) AS n FROM fr JOIN cs USING (chrom) WHERE s < len GROUP BY 1',
    "genome_locus": B + 'SELECT DISTINCT CAST(bin_off + s // 500 AS BIGINT) AS bin, chrom, s // 500 * 500 AS start, least(s // 500 * 500 + 500, len) AS "end" FROM fr JOIN cs USING (chrom) WHERE s < len',
    "tile_insertion": _TILES.format(5000, "chrom <> 'chrM'", _STR + "SELECT sample, chrom, unnest([a, b]) FROM st WHERE strand IS NULL"),
    "tile_fragment": _TILES.format(100, "e - s BETWEEN 50 AND 300", _STR + "SELECT sample, chrom, unnest(range(a, b + 1)) FROM st WHERE strand IS NULL"),
    "tile_paired": _TILES.format(100, "true", _STR + "SELECT sample, chrom, unnest(list_distinct([a, b])) FROM st WHERE strand IS NULL"),
    "peak_matrix": B + "SELECT sample, uid, count(*) AS n FROM fr JOIN ge ON fr.chrom = ge.chr AND fr.s < ge.e AND ge.s < fr.e GROUP BY ALL",
    "peak_matrix_insertion": B + "SELECT sample, uid, count(*) AS n FROM ins JOIN ge ON ins.chrom = ge.chr AND pos >= ge.s AND pos < ge.e GROUP BY ALL",
    "peak_matrix_paired": B + "SELECT sample, uid, count(DISTINCT frag_id) AS n FROM ins JOIN ge ON ins.chrom = ge.chr AND pos >= ge.s AND pos < ge.e GROUP BY ALL",
    "gene_activity": B
    + """, up AS (SELECT uid, chr, CASE WHEN rev THEN s ELSE greatest(0, s - 2000) END AS s, CASE WHEN rev THEN e + 2000 ELSE e END AS e FROM ge)
SELECT sample, uid, count(*) AS activity FROM fr JOIN up ON fr.chrom = up.chr AND fr.s < up.e AND up.s < fr.e GROUP BY ALL""",
    "frip": B
    + """, h AS (SELECT DISTINCT sample, frag_id FROM fr JOIN (SELECT DISTINCT chr, s, e FROM pk) k ON fr.chrom = k.chr AND fr.s < k.e AND k.s < fr.e), a AS (SELECT sample, count(DISTINCT frag_id) AS n FROM fr GROUP BY 1), b AS (SELECT sample, count(*) AS k FROM h GROUP BY 1)
SELECT sample, n, coalesce(k, 0) AS in_regions, round(coalesce(k, 0) / n, 9) AS frip FROM a LEFT JOIN b USING (sample)""",
    "fragment_qc": B
    + """SELECT sample, count(*) FILTER (chrom <> 'chrM') AS n_fragments, round(coalesce(1 - count(*) FILTER (chrom <> 'chrM') / sum(coalesce(c, 1)) FILTER (chrom <> 'chrM'), 0), 9) AS pct_dup,
 round(count(*) FILTER (chrom = 'chrM') / count(*), 9) AS pct_mito FROM fr GROUP BY 1""",
    "size_histogram": B + "SELECT CASE WHEN e - s <= 200 THEN e - s ELSE 0 END AS size, count(*) AS n FROM fr GROUP BY 1",
    "chrom_summary": B + "SELECT sample, " + ", ".join(f"count(*) FILTER (chrom = '{c}') AS {c}" for c in ("chr1", "chr2", "chrX", "chrM")) + " FROM fr GROUP BY 1",
    "tss_profile": B + _PROFILE + "SELECT sample, off AS offset, n FROM pr".replace("offset", '"offset"'),
    "tss_enrichment": B
    + _PROFILE
    + """SELECT sample, round((sum(CASE WHEN abs(off) <= 5 THEN n ELSE 0 END) / 11) / (sum(CASE WHEN off < -1900 OR off > 1900 THEN n ELSE 0 END) / 200 + 0.1), 9) AS tsse FROM pr GROUP BY 1""",
    "nearest_tss": B
    + """SELECT pid, tss, pk.s - tss AS distance FROM pk JOIN (SELECT DISTINCT chr, tss FROM ts) t ON pk.chr = t.chr AND abs(pk.s - tss) <= 100000
QUALIFY row_number() OVER (PARTITION BY pid ORDER BY abs(pk.s - tss), tss) = 1""",
    "priority_overlay": B
    + """, r AS (SELECT chr, s, e, 'genebody' AS label, 1 AS pr FROM ge UNION ALL SELECT chr, tss - 1000, tss + 1000, 'promoter', 2 FROM ts),
h AS (SELECT pid, max(pr) AS pr FROM pk JOIN r ON pk.chr = r.chr AND pk.s < r.e AND r.s < pk.e GROUP BY 1)
SELECT pid, CASE pr WHEN 2 THEN 'promoter' WHEN 1 THEN 'genebody' ELSE 'intergenic' END AS label FROM pk LEFT JOIN h USING (pid)""",
    "union_length": B
    + """, m AS (SELECT chr, s, e, max(e) OVER (PARTITION BY chr ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM pp)
SELECT chr, CAST(sum(greatest(0, e - greatest(s, coalesce(p, s)))) AS BIGINT) AS total FROM m GROUP BY 1""",
    "reproducible_peaks": B
    + """, h AS (SELECT pid, g.strand FROM pk a JOIN (SELECT chr, s, e, coalesce(strand, '?') AS strand FROM ge) g ON a.chr = g.chr AND a.s < g.e AND g.s < a.e)
SELECT pid FROM h GROUP BY 1 HAVING bool_or(strand = '+') AND bool_or(strand = '-') AND NOT bool_or(strand = '?')""",
    "peaks_in_sets": B
    + """, n AS (SELECT a.pid, count(DISTINCT b.call_set) AS n FROM pk a JOIN pk b ON a.call_set <> b.call_set AND a.chr = b.chr AND a.s < b.e AND b.s < a.e GROUP BY 1)
SELECT pid, coalesce(n, 0) AS sets, coalesce(n, 0) = (SELECT count(DISTINCT call_set) - 1 FROM pk) AS every FROM pk LEFT JOIN n USING (pid) WHERE call_set IS NOT NULL""",
    "coverage": _COV + "SELECT * FROM cv",
    "coverage_bpm": _COV + 'SELECT chrom, start, "end", round(value / ((SELECT sum(("end" - start) * value) FROM cv) / 1e6), 9) AS value FROM cv',
    "coverage_cpm": _COV + 'SELECT chrom, start, "end", round(value / (sum(value) OVER (PARTITION BY chrom) / 1e6), 9) AS value FROM cv',
    "coverage_smooth": _COV
    + """, x AS (SELECT chrom, start - 700 AS pos, value AS e FROM cv UNION ALL SELECT chrom, "end" - 700, -value FROM cv UNION ALL SELECT chrom, start + 701, -value FROM cv UNION ALL SELECT chrom, "end" + 701, value FROM cv),
y AS (SELECT chrom, pos, sum(e) AS e FROM x GROUP BY ALL), z AS (SELECT chrom, pos, sum(e) OVER w AS c, sum(e * pos) OVER w AS cp, lead(pos) OVER w AS until FROM y WINDOW w AS (PARTITION BY chrom ORDER BY pos))
SELECT chrom, pos, round(((pos + 1) * c - cp) / 1401, 6) AS value, round(c / 1401, 9) AS slope, until FROM z WHERE until IS NOT NULL""",
    "threshold_peaks": _COV
    + """, h AS (SELECT chrom, start AS s, "end" AS e FROM cv WHERE value >= 2), i AS (SELECT *, CASE WHEN s - lag(e) OVER (PARTITION BY chrom ORDER BY s) <= 3000 THEN 0 ELSE 1 END AS n FROM h),
j AS (SELECT *, sum(n) OVER (PARTITION BY chrom ORDER BY s) AS g FROM i) SELECT chrom, min(s) AS start, max(e) AS "end" FROM j GROUP BY chrom, g HAVING max(e) - min(s) >= 1000""",
    "base_ratio": B + "SELECT chrom, round(CASE WHEN count(*) FILTER (strand = '+') = 0 THEN 0 WHEN count(strand) = 0 THEN 1 ELSE count(*) FILTER (strand = '+') / count(strand) END, 9) AS ratio FROM fr GROUP BY 1",
    "contacts": B + "SELECT sample AS barcode, chrom AS chrom1, s // 1000000 AS bin1, chrom AS chrom2, e // 1000000 AS bin2, CAST(sum(coalesce(c, 1)) AS BIGINT) AS n FROM fr GROUP BY ALL",
    "unique_reads": B
    + """SELECT sample, chrom, s AS start, e AS "end", frag_id, coalesce(c, 1) AS count, count(*) OVER (PARTITION BY sample, chrom, s, e) AS copies FROM fr
QUALIFY row_number() OVER (PARTITION BY sample, chrom, s, e ORDER BY coalesce(c, 1) DESC, frag_id) = 1""",
    "flag_counts": "SELECT count(*) AS total, count(*) FILTER (l_linenumber & 1 <> 0) AS paired, count(*) FILTER (l_linenumber & 2 <> 0) AS proper, count(*) FILTER (l_linenumber & 4 <> 0) AS unmapped FROM lineitem",
    "sequence_ops": """WITH b AS (SELECT DISTINCT regexp_extract(upper(barcode), '(^|[^ACGT])([ACGT]{16})([^ACGT]|$)', 2) AS seq FROM fragment)
SELECT seq, reverse(translate(seq, 'ACGT', 'TGCA')) AS revcomp, round(length(regexp_replace(seq, '[AT]', '', 'g')) / length(seq), 6) AS gc FROM b WHERE seq <> ''""",
    "region_gene_links": B
    + """SELECT pid, uid, min(CASE WHEN tss BETWEEN pk.s AND pk.e - 1 THEN 0 ELSE least(abs(pk.s - tss), abs(pk.e - 1 - tss)) END) AS distance
FROM pk JOIN ge ON pk.chr = ge.chr AND pk.s < tss + 50001 AND tss - 50000 < pk.e GROUP BY ALL""",
}
ORACLE["motif_scan"] = (
    """WITH b AS (SELECT DISTINCT regexp_extract(upper(barcode), '(^|[^ACGT])([ACGT]{16})([^ACGT]|$)', 2) AS seq FROM fragment),
w AS (SELECT seq, p AS pos, substr(seq, p + 1, 4) AS k FROM b, range(13) t(p) WHERE seq <> ''),
x AS (SELECT seq, pos, '+' AS strand, k FROM w UNION ALL SELECT seq, pos, '-', reverse(translate(k, 'ACGT', 'TGCA')) FROM w),
y AS (SELECT seq, pos, strand, """
    + " + ".join(f"CASE WHEN k[{i + 1}] = '{b}' THEN log2(0.7 / 0.25) ELSE log2(0.1 / 0.25) END" for i, b in enumerate("AGCT"))
    + " AS score FROM x) SELECT seq, pos, strand, round(score, 6) AS score FROM y WHERE score >= 3.0"
)
