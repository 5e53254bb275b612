"""Queries of the relational verbs: metadata, annotations, filters, merges, sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparmat.model import orders_matrix
from sparmat.operators import relational as V
from sparmat.session import table


def meta_columns(s, d):
    p = table(s, d, "part").select("p_partkey", "p_brand", "p_type", "p_name")
    p = V.define_column(p, "origin", "x")
    p = V.paste(p, ["p_brand", "p_type"], "pasted", "/")
    p = V.fraction(p, "p_type", "piece", " ", 1, "none")
    p = V.set_if(p, "p_type", "kind", "starts", "PROMO", "promo")
    p = V.set_if(p, "p_type", "kind", "ends", "STEEL", "steel")
    p = V.set_if(p, "p_brand", "kind", "contains", "3", "three")
    return p.select("p_partkey", "origin", "pasted", "piece", "kind")


def metadata_find(s, d):
    return V.find(table(s, d, "metadata"), modality="rna", sample="kt02")


def metadata_upsert(s, d):
    c = table(s, d, "customer").select("c_custkey", "c_mktsegment")
    new = c.where("c_custkey % 10 = 0").select((F.col("c_custkey") + 5).alias("c_custkey"), F.lit("NEW").alias("c_mktsegment"))
    return V.upsert(c, new, ["c_custkey"])


def attach_metadata(s, d):
    c = table(s, d, "customer").select("c_custkey", "c_name", F.col("c_nationkey").alias("k"), F.col("c_mktsegment").alias("segment"))
    meta = table(s, d, "nation").select(
        F.col("n_nationkey").alias("k"), F.when(F.col("n_nationkey") % 3 == 0, "@asis").when(F.col("n_nationkey") % 3 == 1, "@c_name").otherwise(F.col("n_name")).alias("segment")
    )
    return V.attach_metadata(c, meta, "k").select("c_custkey", "segment")


def annotate_map(s, d):
    c = table(s, d, "customer").select("c_custkey", "c_mktsegment")
    return V.annotate(c, "c_mktsegment", "label", {"goods": ["AUTOMOBILE", "MACHINERY", "FURNITURE"], "home": ["HOUSEHOLD"]}).select("c_custkey", "label")


def annotate_merge(s, d):
    return V.annotate_merge(table(s, d, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", ["AUTOMOBILE", "MACHINERY"], "INDUSTRY")


def annotate_paste(s, d):
    return V.paste(table(s, d, "customer"), ["c_nationkey", "c_mktsegment"], "label", ":").select("c_custkey", "label")


def annotate_broadcast(s, d):
    c = table(s, d, "customer").select("c_custkey", "c_mktsegment")
    sub = table(s, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderpriority").alias("top"))
    return V.annotate_broadcast(c, sub, "c_custkey", "top", "c_mktsegment")


def keep_labels(s, d):
    return V.keep(table(s, d, "customer"), "c_mktsegment", ["BUILDING", "HOUSEHOLD"]).select("c_custkey", "c_mktsegment")


def exclude_labels(s, d):
    return V.exclude(table(s, d, "metadata"), "taxa", ["xho"]).select("location", "sample", "modality", "taxa")


def box_filter(s, d):
    return V.box(table(s, d, "embeddings"), "embedding", (-0.1, 0.1), (0.0, 0.3)).select("vec_id")


def predicate_label(s, d):
    l = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")  # noqa: E741
    return V.label_where(l, "selected", [F.col("l_quantity") > 25, F.col("l_discount") < 0.05]).select("l_orderkey", "l_linenumber", "selected")


def sum_range_filter(s, d):
    m = orders_matrix(s, d)
    return V.sum_range(m.entries, m.obs, "obs_id", -1, 40).select("obs_id", "grp")


def nonempty_variables(s, d):
    m = orders_matrix(s, d)
    return V.nonempty_variables(m.entries, m.var, 300.0).select("var_id")


def expression_mask(s, d):
    m = orders_matrix(s, d)
    one = m.entries.where("var_id = 7").select("obs_id", "value")
    return m.obs.select("obs_id").join(one, "obs_id", "left").select("obs_id", (F.coalesce("value", F.lit(0.0)) >= 10).alias("mask"))


_POLYGON = [(0.0, 1000.0), (50.0, 1000.0), (50.0, 30000.0), (25.0, 12000.0), (0.0, 30000.0)]


def polygon_gate(s, d):
    l = table(s, d, "lineitem")  # noqa: E741
    return l.select("l_orderkey", "l_linenumber", V.polygon_gate(l, "l_quantity", "l_extendedprice", _POLYGON).alias("inside"))


def _halves(s, d):
    l = table(s, d, "lineitem")  # noqa: E741
    e = lambda f: l.where(F.col("l_returnflag") == f).groupBy(F.col("l_orderkey").alias("obs_id"), F.col("l_partkey").alias("var_id")).agg(F.sum("l_quantity").alias("value"))
    return {"r": e("R"), "a": e("A")}


def merge_outer(s, d):
    return V.merge_samples(_halves(s, d), "outer")


def merge_inner(s, d):
    return V.merge_samples(_halves(s, d), "inner")


def merge_var_columns(s, d):
    l = table(s, d, "lineitem")  # noqa: E741
    sides = [
        l.where(F.col("l_returnflag") == f).groupBy("l_partkey").agg(F.sum("l_quantity").alias("q"), F.max(F.col("l_discount") > 0.09).alias("flag"), F.min("l_linestatus").alias("st"))
        for f in ("R", "A", "N")
    ]
    return V.merge_columns(sides, "l_partkey", {"q": "mean"}, {"flag": "or"}, {"st": "unique"}).select("l_partkey", F.round("q", 6).alias("q"), "flag", "st")


def joint_union(s, d):
    c = table(s, d, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"))
    return V.joint(c, table(s, d, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance")), "customer", "supplier")


def link_barcodes(s, d):
    a = table(s, d, "customer").select("c_custkey", F.col("c_nationkey").alias("k"))
    b = table(s, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("k"))
    return V.link_keys(a, b, "k", "c_custkey", "s_suppkey", "u")


def attach_best(s, d):
    c = table(s, d, "customer").select("c_custkey")
    o = table(s, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_totalprice")
    return V.attach_best(c, o, "c_custkey", [F.col("o_totalprice").desc(), F.col("o_orderkey")], ["o_orderkey", "o_totalprice"])


def chain_inner_join(s, d):
    l = table(s, d, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag")  # noqa: E741
    a = l.where("l_returnflag = 'R'").select("l_orderkey", F.col("l_partkey").alias("alpha"))
    b = l.where("l_returnflag = 'A'").select("l_orderkey", F.col("l_partkey").alias("beta"))
    return a.join(b, "l_orderkey").select("l_orderkey", F.concat_ws("_", F.col("alpha").cast("string"), F.col("beta").cast("string")).alias("clone"))


def current_versions(s, d):
    from sparmat.session import current

    return current(table(s, d, "obs"), ["obs_id"]).select("obs_id", "n_umi", "loaded_at")


def translate_ids(s, d):
    g = table(s, d, "genes").select("gene", "uid")
    return V.translate(table(s, d, "transcript").select("tx_row_id", "gene_name"), "gene_name", g, "gene", "uid", True).select("tx_row_id", "translated")


def _ortho(s, d):
    g = table(s, d, "genes")
    return g.where("alias IS NOT NULL").select(F.concat_ws("; ", "gene", "id").alias("a"), F.regexp_replace("alias", r"\|", "; ").alias("b"))


def ortholog_pairs(s, d):
    return V.ortholog_pairs(_ortho(s, d), "a", "b")


def ortholog_one_to_one(s, d):
    n = table(s, d, "nation").select(F.concat_ws("; ", F.col("n_name"), (F.col("n_nationkey") % 7).cast("string")).alias("a"), F.concat_ws("; ", (F.col("n_nationkey") % 9).cast("string"), F.col("n_name")).alias("b"))
    return V.ortholog_pairs(n, "a", "b", one_to_one=True)


def translate_complexes(s, d):
    c = table(s, d, "supplier").select(F.col("s_suppkey"), F.concat_ws("_", (F.col("s_suppkey") % 6).cast("string"), (F.col("s_nationkey") % 5).cast("string")).alias("complex"))
    m = table(s, d, "nation").where("n_nationkey % 6 <> 4").select((F.col("n_nationkey") % 6).cast("string").alias("k"), F.concat(F.lit("t"), (F.col("n_nationkey") % 8).cast("string")).alias("t"))
    return V.translate_complexes(c, "complex", m, "k", "t")


def _signature(s, d, flag):
    return table(s, d, "lineitem").where(F.col("l_returnflag") == flag).where("l_quantity > 47").groupBy(F.col("l_partkey").alias("gene")).agg(F.max("l_discount").alias("weight"))


def signature_union(s, d):
    return V.signature_union(_signature(s, d, "R"), _signature(s, d, "A"))


def signature_intersection(s, d):
    return V.signature_intersection(_signature(s, d, "R"), _signature(s, d, "A"))


def signature_difference(s, d):
    return V.signature_difference(_signature(s, d, "R"), _signature(s, d, "A"))


def signature_jaccard(s, d):
    return V.signature_jaccard(_signature(s, d, "R"), _signature(s, d, "A")).select(F.round("jaccard", 9).alias("jaccard"))


def signature_head(s, d):
    return _signature(s, d, "R").orderBy(F.col("weight").desc(), "gene").limit(10)


def id_sets(s, d):
    c, o = table(s, d, "customer").select(F.col("c_custkey").alias("id")), table(s, d, "orders").select(F.col("o_custkey").alias("id"))
    return c.intersect(o).withColumn("op", F.lit("both")).unionByName(c.exceptAll(o.distinct()).withColumn("op", F.lit("only")))


def subset(s, d):
    c = table(s, d, "customer")
    return c.where(F.col("c_mktsegment").isin("BUILDING") & F.col("c_nationkey").isin(1, 2, 3)).select("c_custkey")


def subsample_groups(s, d):
    return V.subsample_per_group(table(s, d, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", "c_custkey", 5, 11)


def subsample_fraction(s, d):
    return V.subsample_fraction(table(s, d, "customer").select("c_custkey"), "c_custkey", 0.25, 11)


def natural_sort(s, d):
    return table(s, d, "chrom_sizes").orderBy(*V.natural_key(F.col("chrom"))).select("chrom", "len")


def long_form(s, d):
    m = orders_matrix(s, d)
    return V.long_form(m.entries, m.obs.select("obs_id", "grp"), m.var.select("var_id", "brand"))


FUNCS = (
    meta_columns, metadata_find, metadata_upsert, attach_metadata, annotate_map, annotate_merge, annotate_paste, annotate_broadcast, keep_labels, exclude_labels, box_filter, predicate_label,
    sum_range_filter, nonempty_variables, expression_mask, polygon_gate, merge_outer, merge_inner, merge_var_columns, joint_union, link_barcodes, attach_best, chain_inner_join,
    current_versions, translate_ids, ortholog_pairs, ortholog_one_to_one, translate_complexes, signature_union, signature_intersection, signature_difference, signature_jaccard,
    signature_head, id_sets, subset, subsample_groups, subsample_fraction, natural_sort, long_form,
)
QUERIES = {f.__name__: f for f in FUNCS}

_H = """WITH u AS (SELECT l_orderkey AS obs_id, l_partkey AS var_id, sum(l_quantity) AS value, CASE l_returnflag WHEN 'R' THEN 'r' ELSE 'a' END AS sample
FROM lineitem WHERE l_returnflag IN ('R', 'A') GROUP BY ALL) """
_S = """WITH r AS (SELECT l_partkey AS gene, max(l_discount) AS weight FROM lineitem WHERE l_quantity > 47 AND l_returnflag = 'R' GROUP BY 1),
a AS (SELECT l_partkey AS gene, max(l_discount) AS weight FROM lineitem WHERE l_quantity > 47 AND l_returnflag = 'A' GROUP BY 1) """
_EDGES = list(zip(_POLYGON, [*_POLYGON[1:], _POLYGON[0]]))
_CROSS = " + ".join(
    f"CAST(({y1} > l_extendedprice) <> ({y2} > l_extendedprice) AND l_quantity < ({x2} - {x1}) * (l_extendedprice - {y1}) / ({y2} - {y1}) + {x1} AS INT)" for (x1, y1), (x2, y2) in _EDGES if y1 != y2
)
_ON = " OR ".join(
    f"((l_quantity - {x1}) * ({y2} - {y1}) - (l_extendedprice - {y1}) * ({x2} - {x1}) = 0 AND l_quantity BETWEEN {min(x1, x2)} AND {max(x1, x2)} AND l_extendedprice BETWEEN {min(y1, y2)} AND {max(y1, y2)})"
    for (x1, y1), (x2, y2) in _EDGES
)
ORACLE = {
    "subsample_groups": "SELECT c_custkey, c_mktsegment FROM customer QUALIFY row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5(c_custkey || '/11'), c_custkey) <= 5",
    "subsample_fraction": "SELECT c_custkey FROM customer WHERE CAST('0x' || substr(md5(c_custkey || '/11'), 1, 8) AS BIGINT) < 1073741824",
    "meta_columns": """SELECT p_partkey, 'x' AS origin, p_brand || '/' || p_type AS pasted, coalesce(nullif(split_part(p_type, ' ', 2), ''), 'none') AS piece,
 CASE WHEN p_brand LIKE '%3%' THEN 'three' WHEN p_type LIKE '%STEEL' THEN 'steel' WHEN p_type LIKE 'PROMO%' THEN 'promo' END AS kind FROM part""",
    "metadata_find": "SELECT * FROM metadata WHERE modality = 'rna' AND sample = 'kt02'",
    "metadata_upsert": """WITH n AS (SELECT c_custkey + 5 AS c_custkey, 'NEW' AS c_mktsegment FROM customer WHERE c_custkey % 10 = 0)
SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM n) UNION ALL SELECT * FROM n""",
    "attach_metadata": "SELECT c_custkey, CASE n_nationkey % 3 WHEN 0 THEN c_mktsegment WHEN 1 THEN c_name ELSE n_name END AS segment FROM customer JOIN nation ON c_nationkey = n_nationkey",
    "annotate_map": "SELECT c_custkey, CASE WHEN c_mktsegment IN ('AUTOMOBILE', 'MACHINERY', 'FURNITURE') THEN 'goods' WHEN c_mktsegment = 'HOUSEHOLD' THEN 'home' ELSE c_mktsegment END AS label FROM customer",
    "annotate_merge": "SELECT c_custkey, CASE WHEN c_mktsegment IN ('AUTOMOBILE', 'MACHINERY') THEN 'INDUSTRY' ELSE c_mktsegment END AS c_mktsegment FROM customer",
    "annotate_paste": "SELECT c_custkey, c_nationkey || ':' || c_mktsegment AS label FROM customer",
    "annotate_broadcast": "SELECT c_custkey, coalesce((SELECT max(o_orderpriority) FROM orders WHERE o_custkey = c_custkey), c_mktsegment) AS c_mktsegment FROM customer",
    "keep_labels": "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'HOUSEHOLD')",
    "exclude_labels": "SELECT location, sample, modality, taxa FROM metadata WHERE taxa IS NULL OR taxa <> 'xho'",
    "box_filter": "SELECT vec_id FROM embeddings WHERE embedding[1]::DOUBLE BETWEEN -0.1 AND 0.1 AND embedding[2]::DOUBLE BETWEEN 0.0 AND 0.3",
    "predicate_label": "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 25 AND l_discount < 0.05 THEN 'true' ELSE 'false' END AS selected FROM lineitem",
    "sum_range_filter": "SELECT o_orderkey AS obs_id, o_orderpriority AS grp FROM orders LEFT JOIN (SELECT l_orderkey, sum(l_quantity) AS t FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey WHERE coalesce(t, 0) > -1 AND coalesce(t, 0) < 40",
    "nonempty_variables": "SELECT p_partkey AS var_id FROM part WHERE (SELECT sum(l_quantity) FROM lineitem WHERE l_partkey = p_partkey) > 300",
    "expression_mask": "SELECT o_orderkey AS obs_id, coalesce(v, 0) >= 10 AS mask FROM orders LEFT JOIN (SELECT l_orderkey, sum(l_quantity) AS v FROM lineitem WHERE l_partkey = 7 GROUP BY 1) ON l_orderkey = o_orderkey",
    "polygon_gate": f"SELECT l_orderkey, l_linenumber, ({_CROSS}) % 2 = 1 AND NOT ({_ON}) AS inside FROM lineitem",
    "merge_outer": _H + "SELECT * FROM u",
    "merge_inner": _H + "SELECT * FROM u WHERE var_id IN (SELECT var_id FROM u GROUP BY 1 HAVING count(DISTINCT sample) = 2)",
    "merge_var_columns": """WITH x AS (SELECT l_partkey, l_returnflag, sum(l_quantity) AS q, max(l_discount > 0.09) AS flag, min(l_linestatus) AS st FROM lineitem WHERE l_returnflag IN ('R', 'A', 'N') GROUP BY 1, 2)
SELECT l_partkey, round(avg(q), 6) AS q, bool_or(flag) AS flag, string_agg(DISTINCT st, ';' ORDER BY st) AS st FROM x GROUP BY 1""",
    "joint_union": "SELECT c_nationkey AS nation, c_acctbal AS balance, 'customer' AS origin FROM customer UNION ALL SELECT s_nationkey, s_acctbal, 'supplier' FROM supplier",
    "link_barcodes": "SELECT c_nationkey AS k, c_custkey, s_suppkey, 'u' || row_number() OVER (ORDER BY c_nationkey, c_custkey, s_suppkey) AS unified FROM customer JOIN supplier ON c_nationkey = s_nationkey",
    "attach_best": """SELECT c_custkey, o_orderkey, o_totalprice FROM customer LEFT JOIN (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1) ON o_custkey = c_custkey""",
    "chain_inner_join": "SELECT a.l_orderkey, a.l_partkey || '_' || b.l_partkey AS clone FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey WHERE a.l_returnflag = 'R' AND b.l_returnflag = 'A'",
    "current_versions": "SELECT obs_id, n_umi, loaded_at FROM obs QUALIFY row_number() OVER (PARTITION BY obs_id ORDER BY loaded_at DESC) = 1",
    "translate_ids": "SELECT tx_row_id, uid AS translated FROM transcript LEFT JOIN genes ON gene_name = gene",
    "ortholog_pairs": """WITH x AS (SELECT [gene, id] AS a, string_split(alias, '|') AS b FROM genes WHERE alias IS NOT NULL), y AS (SELECT a, b, unnest(range(1, least(len(a), len(b)) + 1)) AS i FROM x)
SELECT DISTINCT a[i] AS a, b[i] AS b FROM y""",
    "ortholog_one_to_one": """WITH x AS (SELECT DISTINCT a, b FROM (SELECT n_name AS a, CAST(n_nationkey % 9 AS VARCHAR) AS b FROM nation UNION ALL SELECT CAST(n_nationkey % 7 AS VARCHAR), n_name FROM nation)),
y AS (SELECT * FROM x QUALIFY count(*) OVER (PARTITION BY a) = 1) SELECT * FROM y QUALIFY count(*) OVER (PARTITION BY b) = 1""",
    "translate_complexes": """WITH c AS (SELECT s_suppkey, CAST(s_suppkey % 6 AS VARCHAR) AS a, CAST(s_nationkey % 5 AS VARCHAR) AS b FROM supplier),
m AS (SELECT DISTINCT CAST(n_nationkey % 6 AS VARCHAR) AS k, 't' || n_nationkey % 8 AS t FROM nation WHERE n_nationkey % 6 <> 4)
SELECT s_suppkey, a || '_' || b AS complex, x.t || '_' || y.t AS translated FROM c JOIN m x ON x.k = a JOIN m y ON y.k = b""",
    "signature_union": _S + "SELECT gene, max(weight) AS weight FROM (SELECT * FROM r UNION ALL SELECT * FROM a) GROUP BY 1",
    "signature_intersection": _S + "SELECT gene, greatest(r.weight, a.weight) AS weight FROM r JOIN a USING (gene)",
    "signature_difference": _S + "SELECT * FROM r WHERE gene NOT IN (SELECT gene FROM a)",
    "signature_jaccard": _S + "SELECT round((SELECT count(*) FROM r JOIN a USING (gene)) / (SELECT count(DISTINCT gene) FROM (SELECT gene FROM r UNION ALL SELECT gene FROM a)), 9) AS jaccard",
    "signature_head": _S + "SELECT * FROM r ORDER BY weight DESC, gene LIMIT 10",
    "id_sets": "SELECT id, 'both' AS op FROM (SELECT c_custkey AS id FROM customer INTERSECT SELECT o_custkey FROM orders) UNION ALL SELECT id, 'only' FROM (SELECT c_custkey AS id FROM customer EXCEPT SELECT o_custkey FROM orders)",
    "subset": "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey IN (1, 2, 3)",
    "natural_sort": "SELECT chrom, len FROM chrom_sizes",
    "long_form": "SELECT l_orderkey AS obs_id, l_partkey AS var_id, sum(l_quantity) AS value, o_orderpriority AS grp, p_brand AS brand FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY ALL",
}
