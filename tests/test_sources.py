"""Round trips of readers and writers on literal files."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sparmat.experiment import Experiment
from sparmat.sources import readers as R
from sparmat.sources import writers as W


def put(tmp_path, name, text):
    p = tmp_path / name
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_text(text)
    return str(p)


def test_mtx_folder(spark, tmp_path):
    put(tmp_path, "m/matrix.mtx", "%%MatrixMarket matrix coordinate integer general\n%x\n3 2 3\n1 1 5\n3 2 3\n2 1 1\n")
    put(tmp_path, "m/barcodes.tsv", "AAA-1\nCCC-1\n")
    put(tmp_path, "m/features.tsv", "g1\tName1\tGene Expression\ng2\ng3\tAb\tAntibody Capture\n")
    entries, obs, var = R.read(spark, str(tmp_path / "m"), "rna")
    assert {tuple(r) for r in entries.collect()} == {("AAA-1", "g1", 5.0), ("CCC-1", "g3", 3.0), ("AAA-1", "g2", 1.0)}
    assert {r.obs_id for r in obs.collect()} == {"AAA-1", "CCC-1"}
    assert {(r.var_id, r.name, r.type) for r in var.collect()} == {("g1", "Name1", "Gene Expression"), ("g2", "g2", "Gene Expression"), ("g3", "Ab", "Antibody Capture")}
    assert [r.var_id for r in R.split_by_type(entries, var, "Antibody Capture").collect()] == ["g3"]
    W.write_mtx(entries, obs, var, str(tmp_path / "out"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "out/matrix.mtx")).collect()]
    assert "3 2 3" in lines and {x for x in lines if x[0] != "%"} == {"3 2 3", "1 1 5.0", "2 1 1.0", "3 2 3.0"}


def test_line_numbers(spark, tmp_path):
    sizes = (3, 50, 10, 700)
    for i, n in enumerate(sizes):
        put(tmp_path, f"t/{i}.txt", "".join(f"{i} {j}\n" for j in range(n)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    start = [sum(sizes[:i]) for i in range(len(sizes))]
    try:
        for split in ("200b", "2kb", old):
            spark.conf.set("spark.sql.files.maxPartitionBytes", split)
            got = R.with_line_number(R._lines(spark, str(tmp_path / "t"))).collect()
            assert len(got) == sum(sizes) and all(r.line == start[int(r._l.split()[0])] + int(r._l.split()[1]) for r in got)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_mtx_round_trip_over_many_splits(spark, tmp_path):
    rows = [(f"c{i % 37:03d}", f"g{(i * 7) % 101:03d}", float(i % 9)) for i in range(900)]
    entries = spark.createDataFrame(rows, "obs_id string, var_id string, value double").dropDuplicates(["obs_id", "var_id"]).persist()
    obs, var = entries.select("obs_id").distinct(), entries.select("var_id").distinct()
    W.write_mtx(entries, obs, var, str(tmp_path / "m"))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for split in ("300b", old):
            spark.conf.set("spark.sql.files.maxPartitionBytes", split)
            e, o, v = R.read_mtx(spark, str(tmp_path / "m"))
            assert {tuple(r) for r in e.collect()} == {tuple(r) for r in entries.where("value <> 0").collect()}
            assert (o.count(), v.count()) == (obs.count(), var.count())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_shared_folder(spark, monkeypatch):
    from sparmat import session

    class Far:
        master = "spark://far:7077"

        def getConf(self):
            return {}

    class Session:
        sparkContext, conf = Far(), {}

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(Session())
    t = session.scratch_table(spark.range(3), "x")
    assert t.count() == 3
    session.drop_scratch(spark)
    with pytest.raises(Exception):
        t.count()


def test_dense_table_and_genes(spark, tmp_path):
    p = put(tmp_path, "x.csv", "gene,c1,c2\nENS1.3,1,0\nAbc,0,2\nzzz,4,4\nENS1,7,0\n")
    genes = spark.createDataFrame([("u1", "ENS1", "Qq"), ("u2", "ENS2", "Abc")], "uid string, id string, gene string")
    got = R.resolve_genes(R.read(spark, p, "rna"), genes)
    assert {tuple(r) for r in got.collect()} == {("c1", "u1", 7.0), ("c2", "u2", 2.0)}


def test_fragments(spark, tmp_path):
    p = put(tmp_path, "f.tsv", "# comment\nchr1\t5\t9\tAA\nchr1\t5\t9\t.\t.\t.\nchr2\t1\t4\tAA\t3\t+\n\nchr2\t1\t4\tBB\t3\t-\n")
    f = R.read(spark, p, "atac")
    assert [tuple(r) for r in f.collect()] == [("chr1", 5, 9, "AA", 1, None), ("chr1", 5, 9, None, 1, None), ("chr2", 1, 4, "AA", 3, "+"), ("chr2", 1, 4, "BB", 3, "-")]
    kept = R.import_fragments(f, 2)
    assert {r.barcode for r in kept.collect()} == {"AA"}
    assert R.import_fragments(f, 1, spark.createDataFrame([("BB",)], "barcode string")).count() == 1
    W.export_fragments(f.withColumn("g", F.coalesce("barcode", F.lit("none"))), str(tmp_path / "o"), "g", 0, 3)
    back = spark.read.option("sep", "\t").csv(str(tmp_path / "o/g=AA"))
    assert back.count() == 1
    c = R.read_contacts(spark, put(tmp_path, "c.tsv", "A\tchr1\t5\tchr2\t9\nA\tchr1\t5\tchr2\t9\t4\n"))
    assert [r["count"] for r in c.collect()] == [1, 4]


GTF = 'chr1\tH\tgene\t11869\t14409\t.\t+\t.\tgene_id "ENSG00000223972.5"; gene_name "DDX11L1";\nchr1\tH\ttranscript\t11869\t14409\t.\t+\t.\tgene_id "ENSG00000223972.5"; transcript_id "ENST00000456328.2"; transcript_type "processed_transcript"; note "note1;note2"; gene_name "DDX11L1"; transcript_name "DDX11L1-202";\n'
GFF = "##gff-version 3\nchr1\tH\ttranscript\t11869\t14409\t.\t+\t.\tID=t;gene_id=ENSG00000223972.5;transcript_id=ENST00000456328.2;transcript_type=processed_transcript;gene_name=DDX11L1;transcript_name=DDX11L1-202\nchr1\tH\texon\t1\t2\t.\t+\t.\tID=e\n"


def test_transcripts(spark, tmp_path):
    want = ("DDX11L1-202", "ENST00000456328.2", "DDX11L1", "ENSG00000223972.5", False, "chr1", 11869, 14409, "+")
    for name, text in (("a.gtf", GTF), ("a.gff3", GFF)):
        assert [tuple(r) for r in R.read(spark, put(tmp_path, name, text), "annotation").collect()] == [want]


def test_sets_and_motifs(spark, tmp_path):
    g = R.read(spark, put(tmp_path, "a.gmt", "s1\td\tA\tB\ns2\t\tC\n"), "set")
    assert {(r.set, r.gene) for r in g.collect()} == {("s1", "A"), ("s1", "B"), ("s2", "C")}
    W.write_gmt(g, str(tmp_path / "g"))
    assert {(r.set, r.gene) for r in R.read_gmt(spark, str(tmp_path / "g")).collect()} == {("s1", "A"), ("s1", "B"), ("s2", "C")}
    assert [r.gene for r in R.read_grp(spark, put(tmp_path, "a.grp", "#x\nA\nB\n"), "n").collect()] == ["A", "B"]
    assert [r.weight for r in R.read_rnk(spark, put(tmp_path, "a.rnk", "A\t2.5\nB\t-1\n"), "n").collect()] == [2.5, -1.0]
    meme = "MEME version 4\n\nMOTIF M1 x\nletter-probability matrix: alength= 4 w= 2\n 0.1 0.2 0.3 0.4\n 1 0 0 0\n\nMOTIF M2\nletter-probability matrix: alength= 4 w= 1\n0.25 0.25 0.25 0.25\n"
    m = {r.motif: r for r in R.read(spark, put(tmp_path, "a.meme", meme), "motif").collect()}
    assert m["M1"].pwm == [[0.1, 0.2, 0.3, 0.4], [1.0, 0.0, 0.0, 0.0]] and m["M2"].width == 1


def test_contigs_and_metadata(spark, tmp_path):
    head = "barcode,is_cell,high_confidence,full_length,productive,chain,v_gene,d_gene,j_gene,reads,umis,cdr3_nt,cdr3\n"
    rows = "b1,True,True,True,True,TRA,V1,,J1,9,3,ACG,T\nb1,True,True,True,True,TRB,V2,D2,J2,9,4,GGG,G\nb2,True,True,True,False,TRA,V1,,J1,9,3,ACG,T\n"
    got = R.read(spark, put(tmp_path, "t.csv", head + rows), "rna.tcr").collect()
    assert [tuple(r) for r in got] == [("b1", "tcr(tra(vdj(V1,na,J1), nt(ACG)), trb(vdj(V2,D2,J2), nt(GGG)))", 3, 4)]
    p = put(tmp_path, "m.tsv", "#c\nlocation\tsample\tbatch\tgroup\tmodality\ttaxa\textra\nx\ts1\t.\tg\trna\thsa\t1\n")
    m = R.read_metadata(spark, p)
    assert m.collect()[0].batch is None and "extra" in m.columns
    W.write_metadata(m, str(tmp_path / "meta"))
    assert R.read_metadata(spark, str(tmp_path / "meta")).collect() == m.collect()
    with pytest.raises(ValueError):
        R.read_metadata(spark, put(tmp_path, "bad.tsv", "a\tb\n1\t2\n"))
    with pytest.raises(ValueError):
        R.read(spark, "x.bam", "atac")


def test_experiment(spark, tmp_path):
    meta = spark.createDataFrame([("x", "s1"), ("y", "s2")], "location string, sample string")
    obs = spark.createDataFrame([("a", "s1", "t"), ("b", "s1", None), ("c", "s2", "u")], "obs_id string, sample string, kind string")
    var = spark.createDataFrame([("g", True), ("h", False)], "var_id string, mito boolean")
    entries = spark.createDataFrame([("a", "g", 2.0), ("a", "h", 2.0), ("c", "g", 1.0)], "obs_id string, var_id string, value double")
    e = Experiment(meta, {"rna": {"obs": obs, "var": var, "entries": entries}})
    e.save(str(tmp_path / "e"))
    back = Experiment.load(spark, str(tmp_path / "e"), ["rna"], sample="s1")
    assert {r.obs_id for r in back.tables["rna"]["entries"].collect()} == {"a"} and back.tables["rna"]["obs"].count() == 2
    q = {r.obs_id: r for r in e.qc("rna", F.col("mito")).tables["rna"]["obs"].collect()}
    assert (q["a"].total, q["a"].pct_marked, q["b"].total) == (4.0, 0.5, 0.0)
    assert {r.obs_id for r in e.exclude("rna", "kind", ["t"]).tables["rna"]["obs"].collect()} == {"b", "c"}
    assert e.keep("rna", "kind", ["t"]).tables["rna"]["entries"].count() == 2
    n = e.normalize("rna", 10.0, log=False)
    assert {round(r.value, 6) for r in n.tables["rna"]["entries"].collect()} == {5.0, 10.0}
    j = e.joint(e, "rna", "x", "y")
    assert {r.origin for r in j.tables["rna"]["obs"].collect()} == {"x", "y"} and j.tables["rna"]["var"].count() == 2
    two = e.with_table("atac", "obs", obs.select("obs_id", F.lit(1).alias("k"))).pull("rna", "atac", "k")
    assert "atac:k" in two.tables["rna"]["obs"].columns
    assert e.annotate("rna", "kind", "label", {"L": ["t"]}).filter("rna", "sel", [F.col("label") == "L"]).tables["rna"]["obs"].where("sel = 'true'").count() == 1
    assert e.pseudobulk("rna", "sample").count() == 3 and e.summarize("rna", "sample", "kind", "obs_id").count() > 0
    assert e.subsample("rna", "sample", 1).tables["rna"]["obs"].count() == 2
