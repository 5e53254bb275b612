"""Readers and writers over files they exchange: every query writes driver tables in a format and reads them back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sparmat.experiment import Experiment
from sparmat.functions.text import chrom_label
from sparmat.model import orders_matrix
from sparmat.plans.q_genome import coverage
from sparmat.session import scratch_dir, table
from sparmat.sources import readers as R
from sparmat.sources import writers as W


def _at(s, name):
    return f"{scratch_dir(s)}/files-{uuid.uuid4().hex}/{name}"


def _text(df, *cols):
    """Tab-separated lines; a null is '.'."""
    return df.select(F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string") if isinstance(c, str) else c, F.lit(".")) for c in cols]).alias("value"))


def source_mtx(s, d):
    m, at = orders_matrix(s, d), _at(s, "matrix")
    W.write_mtx(m.entries, m.obs, m.var, at)
    return R.read(s, at, "rna")[0]


def source_mtx_axes(s, d):
    """Names of either axis in the order of the files."""
    m, at = orders_matrix(s, d), _at(s, "matrix")
    W.write_mtx(m.entries, m.obs, m.var, at)
    _, obs, var = R.read(s, at, "rna")
    return obs.select(F.lit("obs").alias("axis"), F.col("obs_id").alias("name")).unionByName(var.select(F.lit("var").alias("axis"), F.col("var_id").alias("name")))


def source_table(s, d):
    m, at = orders_matrix(s, d), _at(s, "dense.csv")
    e = m.entries.join(m.obs.select("obs_id", "status"), "obs_id").join(m.var.select("var_id", "brand"), "var_id")
    e.groupBy("brand").pivot("status", ["F", "O", "P"]).agg(F.sum("value")).fillna(0.0).write.option("header", True).csv(at)
    return R.read(s, at, "rna")


def source_gene_ids(s, d):
    e = table(s, d, "transcript").select(F.col("tx_row_id").alias("obs_id"), F.col("gene_name").alias("var_id"), F.lit(1.0).alias("value")).where("var_id IS NOT NULL")
    return R.resolve_genes(e, table(s, d, "genes").select("uid", "id", "gene"))


def _fragment_file(s, d):
    at = _at(s, "fragments.tsv")
    f = table(s, d, "fragment").where("chrom IS NOT NULL AND NOT chrom LIKE '#%'")
    _text(f, "chrom", "start", "end", "barcode", "count", "strand").write.text(at)
    return R.read(s, at, "atac")


def source_fragments(s, d):
    return _fragment_file(s, d)


def source_import_fragments(s, d):
    return R.import_fragments(_fragment_file(s, d), 3)


def export_fragments(s, d):
    """Fragments written per strand and read again, one folder a group."""
    at = _at(s, "export")
    f = table(s, d, "fragment").where("strand IS NOT NULL AND barcode IS NOT NULL AND chrom IS NOT NULL AND NOT chrom LIKE '#%'").withColumn("grp", F.when(F.col("strand") == "+", "plus").otherwise("minus"))
    W.export_fragments(f, at, "grp", 10, 100_000)
    parts = [R.read_fragments(s, f"{at}/grp={g}").withColumn("grp", F.lit(g)) for g in ("plus", "minus")]
    return parts[0].unionByName(parts[1]).groupBy("grp", "strand").agg(F.count(F.lit(1)).alias("n"), F.sum("count").alias("total"), F.sum(F.col("end") - F.col("start")).alias("bases"))


def source_contacts(s, d):
    at = _at(s, "contacts.tsv")
    _text(table(s, d, "fragment").where("barcode IS NOT NULL AND chrom IS NOT NULL AND NOT barcode LIKE '#%'"), "barcode", "chrom", "start", "chrom", "end", F.coalesce("count", F.lit(1)).cast("string")).write.text(at)
    return R.read_contacts(s, at)


def source_peaks(s, d):
    at = _at(s, "peaks.narrowPeak")
    p = table(s, d, "peaks").select(chrom_label(F.col("chr")).alias("chrom"), "start", "end", "peak", "score", "strand", "fc", "p", "q", "summit").where("chrom IS NOT NULL")
    p.write.option("sep", "\t").csv(at)
    return R.read(s, at, "atac-bulk").drop("name")


def source_bedgraph(s, d):
    at = _at(s, "track.bedgraph")
    W.export_bedgraph(coverage(s, d), at)
    return R.read_bedgraph(s, at)


def source_transcripts(s, d):
    at = _at(s, "genes.gtf")
    t = table(s, d, "transcript")
    plain = lambda c: F.regexp_replace(F.trim(c), r'["\s]+', "_")
    attr = lambda key, c: F.when(F.col(c).isNotNull() & (F.trim(c) != ""), F.concat(F.lit(f'{key} "'), plain(c), F.lit('";')))
    kind = F.when(F.col("is_coding"), 'transcript_type "protein_coding";').when(~F.col("is_coding"), 'transcript_type "lncRNA";')
    a = F.concat_ws(" ", attr("gene_id", "gene_id"), attr("gene_name", "gene_name"), attr("transcript_id", "transcript_id"), attr("transcript_name", "transcript_name"), kind)
    _text(t, F.coalesce("chrom", F.lit("chr?")), F.lit("x"), F.lit("transcript"), "left", "right", F.lit("."), F.coalesce("strand", F.lit("+")), F.lit("."), a).write.text(at)
    return R.read(s, at, "annotation").select("gene_id", "transcript_id", "is_coding", "left", "right", "strand")


def source_gmt(s, d):
    at = _at(s, "sets.gmt")
    W.write_gmt(table(s, d, "part").select(F.col("p_brand").alias("set"), F.lit("brand").alias("description"), F.col("p_partkey").cast("string").alias("gene")), at)
    return R.read(s, at, "set")


def source_gene_lists(s, d):
    """A plain and a weighted list."""
    grp, rnk = _at(s, "list.grp"), _at(s, "list.rnk")
    p = table(s, d, "part")
    p.select(F.col("p_partkey").cast("string").alias("value")).write.text(grp)
    _text(p, "p_partkey", "p_retailprice").write.text(rnk)
    return R.read_grp(s, grp, "plain").unionByName(R.read_rnk(s, rnk, "weighted"))


_MEME = "MEME version 4\n\nMOTIF M1 first\nletter-probability matrix: alength= 4 w= 3\n0.1 0.2 0.3 0.4\n1 0 0 0\n0.25 0.25 0.25 0.25\n\nMOTIF M2\nletter-probability matrix: alength= 4 w= 1\n0.5 0.5 0 0\n"


def source_motifs(s, d):
    at = _at(s, "motifs.meme")
    s.createDataFrame([(_MEME,)], "value string").coalesce(1).write.text(at)
    return R.read(s, at, "motif").select("motif", "width", F.aggregate(F.flatten("pwm"), F.lit(0.0), lambda a, x: a + x).alias("total"))


def source_contigs(s, d):
    """Order lines as contigs: line 1 is the alpha chain, line 2 the beta chain; returned lines are not productive."""
    at = _at(s, "contigs.csv")
    l = table(s, d, "lineitem").where("l_linenumber <= 2")  # noqa: E741
    t = lambda c: F.col(c).cast("string")
    l.select(
        t("l_orderkey").alias("barcode"), F.when(F.col("l_linenumber") == 1, "TRA").otherwise("TRB").alias("chain"), F.lit("true").alias("is_cell"), F.lit("True").alias("high_confidence"),
        F.when(F.col("l_returnflag") == "R", "false").otherwise("true").alias("productive"), F.lit("true").alias("full_length"), F.concat(F.lit("V"), t("l_suppkey")).alias("v_gene"), F.lit("None").alias("d_gene"),
        F.concat(F.lit("J"), t("l_partkey")).alias("j_gene"), F.lit("ACGT").alias("cdr3_nt"), F.col("l_quantity").cast("bigint").alias("umis"),
    ).write.option("header", True).csv(at)
    return R.read(s, at, "rna.tcr")


def source_metadata(s, d):
    at = _at(s, "metadata.tsv")
    W.write_metadata(table(s, d, "metadata").select(*R.METADATA_COLUMNS), at)
    return R.read_metadata(s, at)


def source_partitions(s, d):
    at = _at(s, "orders")
    W.write_table(table(s, d, "orders").select("o_orderkey", "o_custkey", F.col("o_orderstatus").alias("sample")), at)
    return W.load_table(s, at, sample=["F", "P"]).select("o_orderkey", "o_custkey", "sample")


def source_experiment(s, d):
    """An experiment saved, loaded for one sample, and summed."""
    m, at = orders_matrix(s, d), _at(s, "experiment")
    x = Experiment(table(s, d, "metadata"), {"rna": {"obs": m.obs.withColumnRenamed("status", "sample"), "var": m.var, "entries": m.entries}})
    x.save(at)
    got = Experiment.load(s, at, ["rna"], sample="F").matrix("rna")
    return got.entries.join(got.obs.select("obs_id", "grp"), "obs_id").groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


FUNCS = (
    source_mtx, source_mtx_axes, source_table, source_gene_ids, source_fragments, source_import_fragments, export_fragments, source_contacts, source_peaks, source_bedgraph, source_transcripts,
    source_gmt, source_gene_lists, source_motifs, source_contigs, source_metadata, source_partitions, source_experiment,
)
QUERIES = {f.__name__: f for f in FUNCS}

from sparmat.plans.q_genome import _RX  # noqa: E402
from sparmat.plans.q_genome import ORACLE as _GENOME  # noqa: E402

_WORDS = "('', '.', 'na', 'NA', 'nan', 'NaN', 'None')"
_NULL = lambda c: f"CASE WHEN {c} NOT IN {_WORDS} THEN {c} END"
_FR = f"""WITH fr AS (SELECT chrom, start, "end", {_NULL('barcode')} AS barcode, coalesce(count, 1) AS count, {_NULL('strand')} AS strand FROM fragment WHERE chrom IS NOT NULL AND NOT chrom LIKE '#%') """
_PLAIN = lambda c: f"""regexp_replace(trim({c}), '["\\s]+', '_', 'g')"""
_TCR = "SELECT l_orderkey AS k, l_quantity::BIGINT AS u, '(vdj(V' || l_suppkey || ',na,J' || l_partkey || '), nt(ACGT))' AS x FROM lineitem WHERE l_returnflag <> 'R' AND l_linenumber = "
ORACLE = {
    "source_peaks": f"""SELECT upper(regexp_extract(chr, {_RX})) AS chrom, start, "end", score, strand, fc AS signal_value, p AS p_value, q AS q_value, summit AS peak FROM peaks WHERE upper(regexp_extract(chr, {_RX})) <> ''""",
    "source_mtx": "SELECT CAST(l_orderkey AS VARCHAR) AS obs_id, CAST(l_partkey AS VARCHAR) AS var_id, sum(l_quantity)::DOUBLE AS value FROM lineitem GROUP BY 1, 2 HAVING sum(l_quantity) <> 0",
    "source_mtx_axes": "SELECT 'obs' AS axis, CAST(o_orderkey AS VARCHAR) AS name FROM orders UNION ALL SELECT 'var', CAST(p_partkey AS VARCHAR) FROM part",
    "source_table": "SELECT o_orderstatus AS obs_id, p_brand AS var_id, sum(l_quantity)::DOUBLE AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2",
    "source_gene_ids": r"""WITH n AS (SELECT DISTINCT gene_name AS v FROM transcript WHERE gene_name IS NOT NULL), s AS (SELECT gene, min(uid) AS uid FROM genes GROUP BY 1),
m AS (SELECT v, coalesce(g.uid, s.uid) AS uid FROM n LEFT JOIN genes g ON regexp_replace(v, '\.\d+$', '') = g.id LEFT JOIN s ON s.gene = v WHERE coalesce(g.uid, s.uid) IS NOT NULL),
k AS (SELECT uid, min(v) AS v FROM m GROUP BY 1) SELECT tx_row_id AS obs_id, uid AS var_id, 1.0::DOUBLE AS value FROM transcript JOIN k ON gene_name = v""",
    "source_fragments": _FR + "SELECT * FROM fr",
    "source_import_fragments": _FR + "SELECT * FROM fr WHERE barcode IS NOT NULL QUALIFY count(*) OVER (PARTITION BY barcode) >= 3",
    "export_fragments": """SELECT CASE strand WHEN '+' THEN 'plus' ELSE 'minus' END AS grp, strand, count(*) AS n, CAST(sum(coalesce(count, 1)) AS BIGINT) AS total, CAST(sum("end" - start) AS BIGINT) AS bases FROM fragment
WHERE strand IS NOT NULL AND barcode IS NOT NULL AND chrom IS NOT NULL AND NOT chrom LIKE '#%' AND "end" - start BETWEEN 10 AND 100000 GROUP BY 1, 2""",
    "source_contacts": """SELECT barcode, chrom AS chrom1, start AS start1, chrom AS chrom2, "end" AS start2, coalesce(count, 1) AS count FROM fragment WHERE barcode IS NOT NULL AND chrom IS NOT NULL AND NOT barcode LIKE '#%'""",
    "source_bedgraph": _GENOME["coverage"].replace("SELECT * FROM cv", 'SELECT chrom, "start", "end", value::DOUBLE AS value FROM cv'),
    "source_transcripts": f"""SELECT CASE WHEN {_PLAIN('gene_id')} NOT IN {_WORDS} THEN {_PLAIN('gene_id')} END AS gene_id, CASE WHEN {_PLAIN('transcript_id')} NOT IN {_WORDS} THEN {_PLAIN('transcript_id')} END AS transcript_id,
 is_coding, "left", "right", coalesce(strand, '+') AS strand FROM transcript""",
    "source_gmt": "SELECT p_brand AS \"set\", 'brand' AS description, CAST(p_partkey AS VARCHAR) AS gene FROM part",
    "source_gene_lists": "SELECT 'plain' AS \"set\", CAST(p_partkey AS VARCHAR) AS gene, 1.0::DOUBLE AS weight FROM part UNION ALL SELECT 'weighted', CAST(p_partkey AS VARCHAR), p_retailprice FROM part",
    "source_motifs": "SELECT * FROM (VALUES ('M1', 3, 3.0::DOUBLE), ('M2', 1, 1.0::DOUBLE)) t(motif, width, total)",
    "source_contigs": f"WITH a AS ({_TCR}1), b AS ({_TCR}2) SELECT CAST(a.k AS VARCHAR) AS barcode, 'tcr(tra' || a.x || ', trb' || b.x || ')' AS clone, a.u AS tra_umi, b.u AS trb_umi FROM a JOIN b USING (k)",
    "source_metadata": "SELECT " + ", ".join(f'CASE WHEN "{c}" NOT IN {_WORDS} THEN "{c}" END AS "{c}"' for c in R.METADATA_COLUMNS) + " FROM metadata",
    "source_partitions": "SELECT o_orderkey, o_custkey, o_orderstatus AS sample FROM orders WHERE o_orderstatus IN ('F', 'P')",
    "source_experiment": """WITH m AS (SELECT l_orderkey, l_partkey, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2)
SELECT o_orderpriority AS grp, count(*) AS n, sum(v)::DOUBLE AS total FROM m JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' GROUP BY 1""",
}
