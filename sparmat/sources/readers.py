"""Readers: matrices, fragments, annotation, gene sets, motifs, metadata. Every reader returns lazy DataFrames.

``read`` picks a reader by modality and file suffix. Files that need a native library (HDF5, BAM) are
read only where that library can be imported.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

METADATA_COLUMNS = ("location", "sample", "batch", "group", "modality", "taxa")
#: Words that stand for a missing value in text tables (fixed values).
MISSING = ("", ".", "na", "NA", "nan", "NaN", "None")


def missing_to_null(c: Column) -> Column:
    return F.when(~c.isin(*MISSING), c)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(_l, _file, _block): the lines of text files and the file and split they stand in."""
    return spark.read.text(path).select(F.col("value").alias("_l"), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"))


def with_line_number(lines: DataFrame, into: str = "line") -> DataFrame:
    """Adds the line's number from 0 in the order of the files (by path) and of their lines; ``lines`` come from ``_lines``, maybe filtered.

    Spark deals out splits by size, so the order of its partitions says nothing; but a split is read by one task from
    its first line to its last: numbers within a split plus the counts of the earlier splits (one row a split).
    """
    d = lines.withColumn("_m", F.monotonically_increasing_id())
    counts = d.groupBy("_file", "_block").agg(F.count(F.lit(1)).alias("_n"), F.min("_m").alias("_m0"))
    before = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    off = counts.select("_file", "_block", "_m0", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    return d.join(off, ["_file", "_block"]).withColumn(into, F.col("_o") + F.col("_m") - F.col("_m0")).drop("_file", "_block", "_m", "_m0", "_o")


# --- matrices ------------------------------------------------------------------------------------------
def read_mtx(spark: SparkSession, folder: str, prefix: str = "", suffix: str = "") -> tuple[DataFrame, DataFrame, DataFrame]:
    """10x folder: (entries, obs, var). Features may have one to three columns (id, name, type)."""
    at = lambda n: f"{folder}/{prefix}{n}{suffix}"
    body = with_line_number(_lines(spark, at("matrix.mtx")).where(~F.col("_l").startswith("%")))
    t = body.where("line > 0").select(F.split(F.trim("_l"), r"\s+").alias("t"))  # line 0 holds the sizes
    t = t.select((F.col("t")[0].cast("bigint") - 1).alias("v"), (F.col("t")[1].cast("bigint") - 1).alias("o"), F.col("t")[2].cast("double").alias("value"))
    obs = with_line_number(_lines(spark, at("barcodes.tsv"))).select(F.col("line").alias("o"), F.split("_l", "\t")[0].alias("barcode"))
    f = with_line_number(_lines(spark, at("features.tsv"))).withColumn("f", F.split("_l", "\t"))
    var = f.select(F.col("line").alias("v"), F.col("f")[0].alias("var_id"), F.coalesce(F.get("f", F.lit(1)), F.col("f")[0]).alias("name"), F.coalesce(F.get("f", F.lit(2)), F.lit("Gene Expression")).alias("type"))
    entries = t.join(obs, "o").join(var, "v").select(F.col("barcode").alias("obs_id"), "var_id", "value")
    return entries, obs.select(F.col("barcode").alias("obs_id")), var.drop("v")


def split_by_type(entries: DataFrame, var: DataFrame, feature_type: str) -> DataFrame:
    """Entries of the features of one type (gene expression or antibody capture)."""
    return entries.join(var.where(F.col("type") == feature_type), "var_id", "left_semi")


def read_table(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """Dense text, genes in rows and cells in columns, to entries without zeros."""
    wide = spark.read.option("header", True).option("sep", sep).csv(path)
    first = wide.columns[0]
    return wide.unpivot([first], wide.columns[1:], "obs_id", "value").select("obs_id", F.col(first).alias("var_id"), F.col("value").cast("double").alias("value")).where("value <> 0")


def resolve_genes(entries: DataFrame, genes: DataFrame) -> DataFrame:
    """Feature names to uids: by id first, then by symbol; features that are not found are dropped, those that meet in one uid keep the
    first name by order."""
    names = entries.select("var_id").distinct()
    bare = F.regexp_replace("var_id", r"\.\d+$", "")
    by_id = genes.select(F.col("id").alias("_k"), F.col("uid").alias("_u1"))
    by_name = genes.groupBy(F.col("gene").alias("_g")).agg(F.min("uid").alias("_u2"))
    m = names.join(by_id, bare == F.col("_k"), "left").join(by_name, F.col("var_id") == F.col("_g"), "left").select("var_id", F.coalesce("_u1", "_u2").alias("uid")).where("uid IS NOT NULL")
    kept = m.groupBy("uid").agg(F.min("var_id").alias("var_id"))
    return entries.join(kept, "var_id").select("obs_id", F.col("uid").alias("var_id"), "value")


# --- intervals -----------------------------------------------------------------------------------------
def read_fragments(spark: SparkSession, path: str) -> DataFrame:
    """chrom, start, end, barcode ('.' null) [, count ('.' 1) [, strand ('.' null)]]; '#' starts a comment."""
    t = _lines(spark, path).where(~F.col("_l").startswith("#") & (F.trim("_l") != "")).select(F.split("_l", "\t").alias("t"))
    g = lambda i: F.get("t", F.lit(i))
    return t.select(
        g(0).alias("chrom"), g(1).cast("bigint").alias("start"), g(2).cast("bigint").alias("end"), missing_to_null(g(3)).alias("barcode"),
        F.coalesce(missing_to_null(g(4)).cast("bigint"), F.lit(1)).alias("count"), missing_to_null(g(5)).alias("strand"),
    )


def import_fragments(frags: DataFrame, least: int, whitelist: DataFrame | None = None) -> DataFrame:
    """Fragments of barcodes on the whitelist with at least ``least`` fragments."""
    f = frags.where("barcode IS NOT NULL")
    f = f.join(whitelist, "barcode", "left_semi") if whitelist is not None else f
    return f.join(f.groupBy("barcode").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least), "barcode", "left_semi")


def read_contacts(spark: SparkSession, path: str) -> DataFrame:
    """barcode, chrom1, start1, chrom2, start2 [, count]."""
    t = _lines(spark, path).where(~F.col("_l").startswith("#")).select(F.split("_l", "\t").alias("t"))
    g = lambda i: F.get("t", F.lit(i))
    return t.select(g(0).alias("barcode"), g(1).alias("chrom1"), g(2).cast("bigint").alias("start1"), g(3).alias("chrom2"), g(4).cast("bigint").alias("start2"), F.coalesce(g(5).cast("bigint"), F.lit(1)).alias("count"))


def read_peaks(spark: SparkSession, path: str) -> DataFrame:
    """narrowPeak."""
    schema = "chrom string, start bigint, end bigint, name string, score int, strand string, signal_value double, p_value double, q_value double, peak bigint"
    return spark.read.option("sep", "\t").option("comment", "#").schema(schema).csv(path)


def read_bedgraph(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("sep", "\t").option("comment", "#").schema("chrom string, start bigint, end bigint, value double").csv(path)


def _attribute(c: Column, key: str) -> Column:
    """``key "v";`` (GTF) or ``key=v;`` (GFF); a quoted value may hold a semicolon."""
    v = F.regexp_extract(c, rf'(?:^|;)\s*{key}(?:\s+"([^"]*)"|=([^;]*)|\s+([^;"]+))', 0)
    return missing_to_null(F.trim(F.regexp_replace(F.regexp_replace(v, rf"^;?\s*{key}\s*=?\s*", ""), '^"|"$', "")))


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """Transcript records of GTF or GFF3: transcript_name, transcript_id, gene_name, gene_id, is_coding, chrom, left, right, strand (1-based, inclusive)."""
    t = spark.read.option("sep", "\t").option("comment", "#").option("quote", "").schema("chrom string, src string, type string, left bigint, right bigint, score string, strand string, phase string, a string").csv(path)
    a = F.col("a")
    kind = F.coalesce(_attribute(a, "transcript_type"), _attribute(a, "transcript_biotype"))
    return t.where("type = 'transcript'").select(
        _attribute(a, "transcript_name").alias("transcript_name"), _attribute(a, "transcript_id").alias("transcript_id"), _attribute(a, "gene_name").alias("gene_name"),
        _attribute(a, "gene_id").alias("gene_id"), (kind == "protein_coding").alias("is_coding"), "chrom", "left", "right", "strand",
    )


# --- sets, motifs, clones, metadata ----------------------------------------------------------------
def read_gmt(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """(set, description, gene): one row a member."""
    t = _lines(spark, path).where(F.trim("_l") != "").select(F.split("_l", sep).alias("t"))
    return t.select(F.col("t")[0].alias("set"), F.col("t")[1].alias("description"), F.explode(F.slice("t", 3, F.greatest(F.size("t") - 2, F.lit(1)))).alias("gene")).where("gene <> ''")


def read_grp(spark: SparkSession, path: str, name: str) -> DataFrame:
    return _lines(spark, path).where(~F.col("_l").startswith("#") & (F.trim("_l") != "")).select(F.lit(name).alias("set"), F.trim("_l").alias("gene"), F.lit(1.0).alias("weight"))


def read_rnk(spark: SparkSession, path: str, name: str, sep: str = "\t") -> DataFrame:
    t = _lines(spark, path).where(~F.col("_l").startswith("#") & (F.trim("_l") != "")).select(F.split("_l", sep).alias("t"))
    return t.select(F.lit(name).alias("set"), F.col("t")[0].alias("gene"), F.col("t")[1].cast("double").alias("weight"))


def read_motifs(spark: SparkSession, path: str) -> DataFrame:
    """MEME text: (motif, width, pwm array<array<double>>)."""
    text = spark.read.text(path, wholetext=True).select(F.explode(F.slice(F.split("value", r"(?m)^MOTIF\s+"), 2, 1_000_000)).alias("b"))  # a motif file is small
    rows = F.regexp_extract_all("b", F.lit(r"(?m)^\s*([0-9.eE+-]+(?:[ \t]+[0-9.eE+-]+){3})\s*$"), F.lit(1))
    pwm = F.transform(rows, lambda r: F.transform(F.split(F.trim(r), r"[ \t]+"), lambda x: x.cast("double")))
    return text.select(F.regexp_extract("b", r"^(\S+)", 1).alias("motif"), F.size(pwm).alias("width"), pwm.alias("pwm"))


def read_contigs(spark: SparkSession, path: str, sep: str = ",", productive: bool = True, full_length: bool = True) -> DataFrame:
    """(barcode, clone, tra_umi, trb_umi): kept contigs, alpha joined with beta chains per barcode."""
    t = spark.read.option("header", True).option("sep", sep).csv(path)
    yes = lambda c: F.lower(F.col(c)) == "true"
    t = t.where(yes("is_cell") & yes("high_confidence"))
    t = t.where(yes("productive")) if productive else t
    t = t.where(yes("full_length")) if full_length else t
    nz = lambda c: F.coalesce(missing_to_null(F.col(c)), F.lit("na"))
    chain = lambda name, n: t.where(F.col("chain") == n).select(
        "barcode", F.concat(F.lit(f"{name}(vdj("), F.concat_ws(",", nz("v_gene"), nz("d_gene"), nz("j_gene")), F.lit("), nt("), nz("cdr3_nt"), F.lit("))")).alias(name), F.col("umis").cast("bigint").alias(f"{name}_umi")
    )
    return chain("tra", "TRA").join(chain("trb", "TRB"), "barcode").select("barcode", F.concat(F.lit("tcr("), "tra", F.lit(", "), "trb", F.lit(")")).alias("clone"), "tra_umi", "trb_umi")


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Sample table (tab-separated, '#' comments): the six columns must be there, others are kept; missing words become null."""
    t = spark.read.option("header", True).option("sep", "\t").option("comment", "#").csv(path)
    lost = [c for c in METADATA_COLUMNS if c not in t.columns]
    if lost:
        raise ValueError(f"metadata lacks {lost}")
    return t.select(*[missing_to_null(F.col(c)).alias(c) for c in t.columns])


def read_h5(spark: SparkSession, path: str, slices: int = 256) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Compressed sparse matrix in HDF5 (group 'matrix'); needs h5py and a path that all executors see.

    The columns are cut into ``slices`` ranges; each task reads its part of ``indptr``, ``indices`` and ``data``. The
    driver only reads the numbers of cells and features.
    """
    try:
        import h5py
    except ImportError as e:
        raise RuntimeError("reading HDF5 needs h5py, which is not installed; convert to an MTX folder or Parquet") from e
    import numpy as np
    import pyarrow as pa

    with h5py.File(path) as f:
        n_cells, n_features = len(f["matrix/barcodes"]), len(f["matrix/features/id"])

    def part(batches):
        for b in batches:
            for k in b.column("id").to_pylist():
                lo, hi = n_cells * k // slices, n_cells * (k + 1) // slices
                if lo == hi:
                    continue
                with h5py.File(path) as f:
                    g = f["matrix"]
                    ptr = g["indptr"][lo : hi + 1]
                    cells, ids = g["barcodes"][lo:hi].astype(str), g["features/id"][:].astype(str)
                    ix, val = g["indices"][ptr[0] : ptr[-1]], g["data"][ptr[0] : ptr[-1]]
                col = np.repeat(np.arange(hi - lo), np.diff(ptr))
                yield pa.RecordBatch.from_arrays([pa.array(cells[col]), pa.array(ids[ix]), pa.array(val.astype(float))], names=["obs_id", "var_id", "value"])

    def names(at: str, n: int, into: str) -> DataFrame:
        def read(batches):
            for b in batches:
                for k in b.column("id").to_pylist():
                    with h5py.File(path) as f:
                        yield pa.RecordBatch.from_arrays([pa.array(f[at][n * k // slices : n * (k + 1) // slices].astype(str), pa.string())], names=[into])

        return spark.range(slices).mapInArrow(read, f"{into} string")

    entries = spark.range(slices).mapInArrow(part, "obs_id string, var_id string, value double")
    return entries, names("matrix/barcodes", n_cells, "obs_id"), names("matrix/features/id", n_features, "var_id")


REGISTRY: dict[tuple[str, str], Callable] = {
    ("rna", "mtx"): read_mtx,
    ("rna", "csv"): lambda s, p: read_table(s, p, ","),
    ("rna", "tsv"): lambda s, p: read_table(s, p, "\t"),
    ("rna", "txt"): lambda s, p: read_table(s, p, "\t"),
    ("rna", "h5"): read_h5,
    ("rna", "parquet"): lambda s, p: s.read.parquet(p),
    ("cite", "mtx"): read_mtx,
    ("rna.tcr", "csv"): read_contigs,
    ("rna-bulk", "tsv"): lambda s, p: read_table(s, p, "\t"),
    ("atac", "tsv"): read_fragments,
    ("atac", "bed"): read_fragments,
    ("atac-bulk", "narrowPeak"): read_peaks,
    ("annotation", "gtf"): read_transcripts,
    ("annotation", "gff3"): read_transcripts,
    ("set", "gmt"): read_gmt,
    ("motif", "meme"): read_motifs,
}


def read(spark: SparkSession, path: str, modality: str, **kwargs):
    """Reader by modality and suffix ('.gz' and '.zst' do not count; a folder without suffix is an MTX folder)."""
    name = path.rstrip("/").rsplit("/", 1)[-1]
    for z in (".gz", ".zst"):
        name = name.removesuffix(z)
    suffix = name.rsplit(".", 1)[-1] if "." in name else "mtx"
    if (modality, suffix) not in REGISTRY:
        raise ValueError(f"no reader for modality {modality!r} and suffix {suffix!r}")
    return REGISTRY[modality, suffix](spark, path, **kwargs)
