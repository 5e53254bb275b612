"""Queries of the general problems 1 (intervals) and 3 (hot keys)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparmat.functions.text import barcode_code, barcode_text, chrom_label
from sparmat.operators.intervals import merge_intervals, period_summary
from sparmat.operators.skew import compress_values, heavy_keys, key_percentiles, key_totals
from sparmat.session import table


def _placed_peaks(spark: SparkSession, d: str) -> DataFrame:
    """Peaks with chr as in chrom_sizes. The 12 names join by value; Spark broadcasts them by their known size."""
    names = table(spark, d, "chrom_sizes").select(F.col("chrom"), chrom_label(F.col("chrom")).alias("_l"))
    peaks = table(spark, d, "peaks").select("call_set", chrom_label(F.col("chr")).alias("_l"), "start", "end")
    return peaks.where("0 <= start AND start < end").join(names, "_l").select("call_set", F.col("chrom").alias("chr"), "start", "end")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return merge_intervals(_placed_peaks(spark, d), ["call_set", "chr"])


def p1_coverage(spark: SparkSession, d: str) -> DataFrame:
    return period_summary(p1_found(spark, d), ["call_set", "chr"])


def _fragments(spark: SparkSession, d: str) -> DataFrame:
    """One row (code, value) per fragment: the latest row of a frag_id; a null count is 1.

    max over a struct: latest loaded_at, then the largest barcode and count, so ties are decided by content.
    """
    rows = table(spark, d, "fragment").select(
        "frag_id", F.struct("loaded_at", barcode_code(F.col("barcode")).alias("code"), F.coalesce("count", F.lit(1)).alias("value")).alias("r")
    )
    return rows.groupBy("frag_id").agg(F.max("r").alias("r")).select("r.code", "r.value").where("code IS NOT NULL")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    totals = key_totals(compress_values(_fragments(spark, d), ["code"], "value"), ["code"], "value")
    return heavy_keys(totals.select("code", "n_rows", "total"), ["n_rows", "total"], 0.01).select(barcode_text(F.col("code")).alias("barcode"))


def p3_barcode_totals(spark: SparkSession, d: str) -> DataFrame:
    totals = key_totals(compress_values(_fragments(spark, d), ["code"], "value"), ["code"], "value")
    return totals.select(
        barcode_text(F.col("code")).alias("barcode"),
        F.col("n_rows").alias("fragments"),
        F.col("total").alias("sum_count"),
        F.col("n_distinct").alias("distinct_counts"),
        F.col("mode").alias("mode_count"),
    )


def p3_barcode_percentiles(spark: SparkSession, d: str) -> DataFrame:
    weighted = compress_values(_fragments(spark, d), ["code"], "value")
    return key_percentiles(weighted, ["code"], "value", [0.5, 0.9]).select(
        barcode_text(F.col("code")).alias("barcode"), "fraction", F.col("percentile").alias("count_percentile")
    )


QUERIES = {f.__name__: f for f in (p1_found, p1_coverage, p3_found, p3_barcode_totals, p3_barcode_percentiles)}

_P1 = r"""
WITH p AS (
  SELECT call_set, upper(regexp_extract(chr, '^\s*(?:[a-z][a-z0-9]*[\s_.:-]+)?(?:chr(?:om(?:osome)?)?)?[\s_.:-]*0*([0-9]+|[a-z])\s*$', 1, 'i')) AS l,
         start AS s, "end" AS e FROM peaks WHERE 0 <= start AND start < "end"),
k AS (SELECT DISTINCT call_set, chrom AS chr, s, e FROM p JOIN chrom_sizes c ON p.l = upper(regexp_extract(c.chrom, '^chr(.*)$', 1))),
m AS (SELECT *, max(e) OVER (PARTITION BY call_set, chr ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM k),
i AS (SELECT *, sum(CASE WHEN prev IS NULL OR s > prev THEN 1 ELSE 0 END)
        OVER (PARTITION BY call_set, chr ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS isl FROM m),
r AS (SELECT call_set, chr, isl, min(s) AS left_pos, max(e) AS right_pos FROM i GROUP BY ALL),
g AS (SELECT call_set, chr, lag(right_pos) OVER (PARTITION BY call_set, chr ORDER BY left_pos) AS left_pos, left_pos AS right_pos FROM r),
f AS (SELECT call_set, chr, 'period' AS kind, left_pos, right_pos FROM r
      UNION ALL SELECT call_set, chr, 'gap', left_pos, right_pos FROM g WHERE left_pos IS NOT NULL)
"""
_P3 = r"""
WITH c AS (SELECT frag_id, upper(barcode) AS u, coalesce(count, 1) AS v FROM fragment
           QUALIFY row_number() OVER (PARTITION BY frag_id ORDER BY loaded_at DESC, upper(barcode) DESC, count DESC) = 1),
b AS (SELECT regexp_extract(u, '(^|[^ACGT])([ACGT]{16})([^ACGT]|$)', 2) AS barcode, v FROM c),
f AS (SELECT * FROM b WHERE barcode <> ''),
t AS (SELECT barcode, count(*) AS n, sum(v) AS s FROM f GROUP BY 1)
"""
ORACLE = {
    "p1_found": _P1 + "SELECT * FROM f",
    "p1_coverage": _P1
    + """SELECT call_set, chr, count(*) FILTER (kind = 'period') AS n_periods,
  CAST(coalesce(sum(right_pos - left_pos) FILTER (kind = 'period'), 0) AS BIGINT) AS covered,
  CAST(coalesce(sum(right_pos - left_pos) FILTER (kind = 'gap'), 0) AS BIGINT) AS gap_total,
  max(right_pos - left_pos) FILTER (kind = 'gap') AS longest_gap FROM f GROUP BY 1, 2""",
    "p3_found": _P3 + "SELECT barcode FROM t WHERE n * 100 >= (SELECT sum(n) FROM t) OR s * 100 >= (SELECT sum(s) FROM t)",
    "p3_barcode_totals": _P3
    + """, w AS (SELECT barcode, v, count(*) AS k FROM f GROUP BY 1, 2)
SELECT barcode, CAST(sum(k) AS BIGINT) AS fragments, CAST(sum(k * v) AS BIGINT) AS sum_count, count(v) AS distinct_counts,
  first(v ORDER BY k DESC, v) AS mode_count FROM w GROUP BY 1""",
    "p3_barcode_percentiles": _P3
    + """SELECT barcode, q AS fraction, quantile_disc(v, q) AS count_percentile FROM f, (VALUES (0.5::DOUBLE), (0.9::DOUBLE)) x(q) GROUP BY 1, 2""".replace(
        "quantile_disc(v, q)", "CASE WHEN q = 0.5 THEN quantile_disc(v, 0.5) ELSE quantile_disc(v, 0.9) END"
    ),
}
