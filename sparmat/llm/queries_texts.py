"""Queries of the llm problems 7 (leakage), 8 (mixing) and 9 (text quality)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparmat.llm import leakage, mixing, quality
from sparmat.session import scratch_table, table


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"), ["doc_id"])


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).select("doc_id", F.explode("leaks").alias("l")).select("doc_id", F.col("l.item").alias("item_id"))


def p7_cleaned(spark: SparkSession, d: str) -> DataFrame:
    """Documents concerned without the leaked spans; ``drop`` where half of the words or more leaked."""
    return _leaks(spark, d).select(
        "doc_id", "n_words", "covered_words", (F.col("covered_words") * 2 >= F.col("n_words")).alias("drop"), F.col("kept_text").alias("text")
    )


def p7_items(spark: SparkSession, d: str) -> DataFrame:
    """Leaked items with the number of documents and the longest passage."""
    rows = _leaks(spark, d).select("doc_id", F.explode("leaks").alias("l"))
    return rows.groupBy(F.col("l.item").alias("item_id")).agg(F.count(F.lit(1)).alias("n_docs"), F.max("l.words").alias("longest"))


def _sized(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", mixing.source_key(F.col("source")).alias("key"), "text")
    known = table(spark, d, "mix_targets").select(mixing.source_key(F.col("source")).alias("key"))
    return mixing.count_tokens(docs.join(F.broadcast(known), "key", "left_semi"), ["doc_id", "key"])  # mix_targets: fixed, 13 rows


def _mixed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    sized = scratch_table(_sized(spark, d), "token-counts")
    planned = scratch_table(mixing.plan(sized, table(spark, d, "mix_targets")), "mix-plan")
    return scratch_table(mixing.sample(sized, planned), "mix-drawn"), planned


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Sources that fall short in the mix that was drawn."""
    return mixing.report(*_mixed(spark, d)).where("short").select("source")


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)[0]


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return mixing.report(*_mixed(spark, d))


def _profiles(spark: SparkSession, d: str) -> quality.Profiles:
    return quality.learn_profiles(table(spark, d, "documents"), table(spark, d, "common_words"))


def _structure(spark: SparkSession, d: str) -> DataFrame:
    return quality.structure(table(spark, d, "documents"), _profiles(spark, d), ["doc_id"])


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """At most a quarter or at least three quarters of a text are sentences: the middle between them decides."""
    return _structure(spark, d).where("profile <> 'blank' AND prose_share < 0.5").select("doc_id")


def p9_profiles(spark: SparkSession, d: str) -> DataFrame:
    return _structure(spark, d).select("doc_id", F.round("prose_share", 6).alias("prose_share"), "profile", F.round("divergence", 6).alias("divergence"))


def p9_learned_profiles(spark: SparkSession, d: str) -> DataFrame:
    """The profiles the documents are compared with: share of function words and of the character classes."""
    kind = "profile string, " + ", ".join(f"{c} double" for c in ("function_words", *quality.CLASSES))
    return spark.createDataFrame(quality.profile_rows(_profiles(spark, d)), kind)


def p9_text_stats(spark: SparkSession, d: str) -> DataFrame:
    words = [r.word for r in table(spark, d, "common_words").select("word").collect()]  # fixed table of 139 rows
    cols = quality.basic_stats(F.col("text"), words)
    return table(spark, d, "documents").select("doc_id", *[(F.round(c, 6) if n != "word_count" else c).alias(n) for n, c in cols.items()])


QUERIES = {f.__name__: f for f in (p7_found, p7_cleaned, p7_items, p8_found, p8_mix, p8_report, p9_found, p9_profiles, p9_learned_profiles, p9_text_stats)}

ORACLE = {
    "p9_text_stats": r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
w AS (SELECT doc_id, x, regexp_extract_all(lower(x), '[\p{L}\p{N}]+') AS w,
        [l for l in string_split(x, chr(10)) if length(regexp_replace(l, '[\s\x{00a0}]+', '', 'g')) > 0] AS l FROM t),
k AS (SELECT list(DISTINCT word) AS k FROM common_words)
SELECT doc_id, CAST(len(w) AS INTEGER) AS word_count,
  round(CASE WHEN len(w) > 0 THEN list_sum([length(y) for y in w]) / len(w) END, 6) AS mean_word_length,
  round(CASE WHEN length(x) > 0 THEN length(regexp_replace(x, '[\p{L}\p{N}\s\x{00a0}]', '', 'g')) / length(x) END, 6) AS symbol_ratio,
  round(CASE WHEN len(l) > 0 THEN len([y for y in l if regexp_matches(y, '[.!?…]["''”’»)\]]*\s*$')]) / len(l) END, 6) AS punct_line_share,
  round(CASE WHEN len(w) > 0 THEN len([y for y in w if list_contains(k, y)]) / len(w) END, 6) AS common_word_share
FROM w, k""",
}
