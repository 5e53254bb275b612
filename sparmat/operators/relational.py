"""Metadata columns, annotations, filters, joins, merges and set operations."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparmat.session import running_totals, scratch_table


# --- metadata columns -------------------------------------------------------------------------------
def define_column(df: DataFrame, name: str, default) -> DataFrame:
    return df.withColumn(name, F.lit(default))


def paste(df: DataFrame, keys: Sequence[str], into: str, sep: str) -> DataFrame:
    """Columns joined by ``sep``; a null makes the result null."""
    parts: list[Column] = []
    for k in keys:
        parts += [F.lit(sep), F.col(k).cast("string")]
    return df.withColumn(into, F.concat(*parts[1:]))


def fraction(df: DataFrame, key: str, into: str, sep: str, part: int, fallback: str | None) -> DataFrame:
    """The ``part``-th (from 0) piece of a split; ``fallback`` where there are fewer pieces."""
    return df.withColumn(into, F.coalesce(F.get(F.split(key, F.lit("\\Q" + sep + "\\E")), part), F.lit(fallback)))


def set_if(df: DataFrame, key: str, into: str, test: str, pattern: str, value: str) -> DataFrame:
    """``value`` where ``key`` starts, ends or contains ``pattern`` (test: 'starts', 'ends', 'contains'), else unchanged."""
    c = F.col(key)
    hit = {"starts": c.startswith(pattern), "ends": c.endswith(pattern), "contains": c.contains(pattern)}[test]
    old = F.col(into) if into in df.columns else F.lit(None).cast("string")
    return df.withColumn(into, F.when(hit, value).otherwise(old))


def find(df: DataFrame, **equal) -> DataFrame:
    return reduce(lambda d, kv: d.where(F.col(kv[0]) == kv[1]), equal.items(), df)


def upsert(df: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``rows`` replace those of the same keys and are added where there are none."""
    return df.join(rows.select(*keys), list(keys), "left_anti").unionByName(rows, allowMissingColumns=True)


def attach_metadata(df: DataFrame, meta: DataFrame, by: str) -> DataFrame:
    """Columns of ``meta`` per key; a cell '@asis' keeps the old value, '@col' copies another column, others are literal."""
    m = meta.select(F.col(by), *[F.col(c).alias(f"_m_{c}") for c in meta.columns if c != by])
    j = df.join(m, by, "left")
    for c in meta.columns:
        if c == by:
            continue
        cell = F.col(f"_m_{c}")
        old = F.col(c) if c in df.columns else F.lit(None).cast("string")
        copies = [F.when(cell == f"@{o}", F.col(o).cast("string")) for o in df.columns]
        literal = F.when(~cell.startswith("@"), cell)
        j = j.withColumn(c, F.when(cell.isNull() | (cell == "@asis"), old.cast("string")).otherwise(F.coalesce(*copies, literal)))
    return j.drop(*[f"_m_{c}" for c in meta.columns])


# --- annotations ----------------------------------------------------------------------------------
def annotate(df: DataFrame, cluster: str, into: str, labels: Mapping[str, Sequence]) -> DataFrame:
    """{label: clusters} to a label column; clusters not named keep their own name."""
    pairs = [(F.lit(c).cast("string"), F.lit(k)) for k, cs in labels.items() for c in cs]
    m = F.create_map(*[x for p in pairs for x in p])
    return df.withColumn(into, F.coalesce(m[F.col(cluster).cast("string")], F.col(cluster).cast("string")))


def annotate_merge(df: DataFrame, column: str, merge: Sequence[str], into: str) -> DataFrame:
    return df.withColumn(column, F.when(F.col(column).isin(*merge), into).otherwise(F.col(column)))


def annotate_broadcast(df: DataFrame, source: DataFrame, ident: str, column: str, to: str) -> DataFrame:
    """Values of another subset by id; a non-null value overrides. Ids of ``source`` must be unique."""
    s = source.select(ident, F.col(column).alias("_new"))
    old = F.col(to) if to in df.columns else F.lit(None)
    return df.join(s, ident, "left").withColumn(to, F.coalesce("_new", old)).drop("_new")


def polygon_gate(df: DataFrame, x: str, y: str, polygon: Sequence[tuple[float, float]], scale: Callable[[Column], Column] = lambda c: c, drop_zero: bool = False) -> Column:
    """True strictly inside the polygon (ray casting over the edges as one expression); a null coordinate is outside."""
    px, py = scale(F.col(x)), scale(F.col(y))
    inside = F.lit(False)
    edge = F.lit(False)
    for (x1, y1), (x2, y2) in zip(polygon, [*polygon[1:], polygon[0]]):
        if y1 != y2:
            at = (x2 - x1) * (py - y1) / (y2 - y1) + x1
            inside = inside != (((F.lit(y1) > py) != (F.lit(y2) > py)) & (px < at))
        cross = (px - x1) * (y2 - y1) - (py - y1) * (x2 - x1)
        edge = edge | ((cross == 0) & px.between(min(x1, x2), max(x1, x2)) & py.between(min(y1, y2), max(y1, y2)))
    ok = inside & ~edge
    if drop_zero:
        ok = ok & (F.col(x) != 0) & (F.col(y) != 0)
    return F.coalesce(ok, F.lit(False))


# --- filters ----------------------------------------------------------------------------------------
def keep(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    return df.where(F.col(column).isin(*values))


def exclude(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    """Rows whose label is none of ``values``; nulls are kept."""
    return df.where(F.col(column).isNull() | ~F.col(column).isin(*values))


def box(df: DataFrame, vec: str, xlim: tuple[float, float], ylim: tuple[float, float]) -> DataFrame:
    return df.where(F.col(vec)[0].between(*xlim) & F.col(vec)[1].between(*ylim))


def label_where(df: DataFrame, into: str, criteria: Sequence[Column]) -> DataFrame:
    """'true' where all criteria hold, else 'false' (also where one is null)."""
    return df.withColumn(into, F.when(reduce(lambda a, b: a & b, criteria), "true").otherwise("false"))


def sum_range(entries: DataFrame, side: DataFrame, key: str, low: float, high: float) -> DataFrame:
    """Rows of ``side`` whose total lies in the open interval; a row without entries has total 0."""
    t = entries.groupBy(key).agg(F.sum("value").alias("_t"))
    return side.join(t, key, "left").where((F.coalesce("_t", F.lit(0.0)) > low) & (F.coalesce("_t", F.lit(0.0)) < high)).drop("_t")


def nonempty_variables(entries: DataFrame, var: DataFrame, least: float = 0.01) -> DataFrame:
    t = entries.groupBy("var_id").agg(F.sum("value").alias("_t")).where(F.col("_t") > least)
    return var.join(t, "var_id", "left_semi")


# --- joins and merges -----------------------------------------------------------------------------
def best_per_key(df: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """One row per key, the first of a total order (a partial limit runs before the shuffle)."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def attach_best(df: DataFrame, extra: DataFrame, key: str, order: Sequence[Column], columns: Sequence[str]) -> DataFrame:
    """Left join with the best row per key; the new value overrides the old where it is not null. Row count is preserved."""
    e = best_per_key(extra, key, order).select(key, *[F.col(c).alias(f"_n_{c}") for c in columns])
    out = df.join(e, key, "left")
    for c in columns:
        out = out.withColumn(c, F.coalesce(f"_n_{c}", c) if c in df.columns else F.col(f"_n_{c}"))
    return out.drop(*[f"_n_{c}" for c in columns])


def link_keys(a: DataFrame, b: DataFrame, key: str, left: str, right: str, prefix: str, share: int = 1_000_000) -> DataFrame:
    """Rows of two tables that share a key get one unified id, numbered in the order of (key, left, right), nulls last.

    The pairs are neither sorted nor shuffled: a pair's number follows from the places of its two rows within the key and from the pairs of
    the keys before. A key of more than ``share`` pairs is dealt to several tasks, whatever its part of the rows.
    """
    sides = []
    for df, c, n in ((a, left, "l"), (b, right, "r")):
        rows = df.where(F.col(key).isNotNull()).groupBy(key, c).agg(F.count(F.lit(1)).alias(f"_{n}"))
        sides.append(scratch_table(running_totals(rows, [F.col(c).asc_nulls_last()], [f"_{n}"], [key]), "places"))
    x, y = sides
    size = x.groupBy(key).agg(F.sum("_l").alias("_nl")).join(y.groupBy(key).agg(F.sum("_r").alias("_nr")), key).withColumn("_pairs", F.col("_nl") * F.col("_nr"))
    size = scratch_table(running_totals(size, [key], ["_pairs"]).select(key, "_nr", (F.col("run__pairs") - F.col("_pairs")).alias("_first"), F.ceil(F.col("_pairs") / share).alias("_shares"), "_pairs"), "pairs")
    tasks = math.ceil((size.agg(F.sum("_pairs")).first()[0] or 1) / (8 * share))
    # repeated rows: the _l rows of a left id alternate within each right id, so that they are numbered (right, left row, right row)
    each = lambda n: F.explode(F.sequence(F.lit(0), (F.col(n) - 1).cast("int")))
    x = x.join(size, key).select(key, left, "_l", each("_l").alias("_i"), (F.col("_first") + (F.col("run__l") - F.col("_l")) * F.col("_nr") + 1).alias("_at"), F.col("run__l"), "_shares")
    x = x.select(key, left, "_l", "_i", "_at", F.pmod(F.col("run__l") - F.col("_i"), "_shares").alias("_share"))
    y = y.join(size, key).select(key, right, "_r", each("_r").alias("_j"), (F.col("run__r") - F.col("_r")).alias("_before"), "_shares")
    y = y.select(key, right, "_r", "_j", "_before", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_shares") - 1)).alias("_share"))
    both = x.repartition(tasks, key, "_share").join(y.repartition(tasks, key, "_share"), [key, "_share"])
    n = F.col("_at") + F.col("_l") * F.col("_before") + F.col("_i") * F.col("_r") + F.col("_j")
    return both.select(key, left, right, F.concat(F.lit(prefix), n.cast("string")).alias("unified"))


def merge_samples(samples: Mapping[str, DataFrame], join: str) -> DataFrame:
    """Stack entries (obs_id, var_id, value) of several samples; 'inner' keeps variables present in all samples."""
    out = reduce(DataFrame.unionByName, [d.withColumn("sample", F.lit(k)) for k, d in samples.items()])
    if join == "outer":
        return out
    shared = out.select("var_id", "sample").distinct().groupBy("var_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == len(samples))
    return out.join(shared, "var_id", "left_semi")


def merge_columns(tables: Sequence[DataFrame], key: str, numeric: Mapping[str, str], booleans: Mapping[str, str], strings: Mapping[str, str]) -> DataFrame:
    """Side columns of several samples per key: numbers by mean, var, sd, max, min or median; flags by and / or; strings by
    'concat' or 'unique' (sorted, joined by ';')."""
    u = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
    num = {"mean": F.avg, "var": F.var_samp, "sd": F.stddev_samp, "max": F.max, "min": F.min, "median": F.median}
    aggs = [num[how](c).alias(c) for c, how in numeric.items()] + [{"and": F.bool_and, "or": F.bool_or}[how](c).alias(c) for c, how in booleans.items()]
    for c, how in strings.items():
        got = F.collect_set(c) if how == "unique" else F.collect_list(c)  # one value a sample: as many as there are tables
        aggs.append(F.array_join(F.array_sort(got), ";").alias(c))
    return u.groupBy(key).agg(*aggs)


def joint(a: DataFrame, b: DataFrame, name_a: str, name_b: str, keep_columns: Sequence[str] | None = None) -> DataFrame:
    """Union of two experiments with an ``origin`` label: shared columns (or ``keep_columns``), all rows."""
    cols = list(keep_columns or [c for c in a.columns if c in b.columns])
    return a.select(*cols, F.lit(name_a).alias("origin")).unionByName(b.select(*cols, F.lit(name_b).alias("origin")))


# --- identifiers --------------------------------------------------------------------------------------
def translate(df: DataFrame, column: str, mapping: DataFrame, source: str, target: str, keep_nones: bool) -> DataFrame:
    """Ids of ``column`` through a mapping (first target of a source by order); misses are null or dropped."""
    m = mapping.groupBy(F.col(source).alias("_s")).agg(F.min(target).alias("_t"))
    return df.join(m, F.col(column) == F.col("_s"), "left" if keep_nones else "inner").drop("_s").withColumnRenamed("_t", "translated")


def ortholog_pairs(df: DataFrame, a: str, b: str, sep: str = "; ", one_to_one: bool = False) -> DataFrame:
    """Position-wise pairs of two list columns, distinct; with ``one_to_one`` keys that occur again on either side are dropped."""
    quote = F.lit("\\Q" + sep + "\\E")
    pairs = df.select(F.explode(F.arrays_zip(F.split(a, quote).alias("x"), F.split(b, quote).alias("y"))).alias("p"))
    pairs = pairs.select(F.col("p.x").alias(a), F.col("p.y").alias(b)).where(F.col(a).isNotNull() & F.col(b).isNotNull()).distinct()
    if one_to_one:
        for side in (a, b):
            once = pairs.groupBy(side).agg(F.count(F.lit(1)).alias("_n")).where("_n = 1")
            pairs = pairs.join(once, side, "left_semi").select(a, b)
    return pairs


def translate_complexes(df: DataFrame, column: str, mapping: DataFrame, source: str, target: str) -> DataFrame:
    """Complexes 'A_B': all combinations of the subunits' targets ('translated'); none where a subunit has no target.

    A complex has a few subunits and a subunit a few orthologs; the product stays within a row.
    """
    distinct = df.select(column).distinct()
    units = distinct.select(column, F.posexplode(F.split(column, "_")).alias("_i", "_u"))
    per = units.join(mapping.select(F.col(source).alias("_u"), F.col(target).alias("_t")), "_u", "left").groupBy(column, "_i").agg(F.array_sort(F.collect_set("_t")).alias("_ts"))
    lists = per.groupBy(column).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_ts"))), lambda s: s["_ts"]).alias("_l"))
    start = F.array(F.array().cast("array<string>"))
    product = F.aggregate("_l", start, lambda acc, ts: F.flatten(F.transform(acc, lambda p: F.transform(ts, lambda t: F.concat(p, F.array(t))))))
    out = lists.select(column, F.explode(product).alias("_p")).select(column, F.array_join("_p", "_").alias("translated"))
    return df.join(out, column)


# --- sets --------------------------------------------------------------------------------------------
def signature_union(a: DataFrame, b: DataFrame) -> DataFrame:
    """(gene, weight): both sides, shared genes by the larger weight."""
    return a.unionByName(b).groupBy("gene").agg(F.max("weight").alias("weight"))


def signature_intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    j = a.join(b.select("gene", F.col("weight").alias("_w")), "gene")
    return j.select("gene", F.greatest("weight", "_w").alias("weight"))


def signature_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b, "gene", "left_anti")


def signature_jaccard(a: DataFrame, b: DataFrame) -> DataFrame:
    u = a.select("gene", F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(b.select("gene", F.lit(0).alias("a"), F.lit(1).alias("b")))
    g = u.groupBy("gene").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    return g.agg(F.when(F.count(F.lit(1)) > 0, F.sum(F.col("a") * F.col("b")) / F.count(F.lit(1))).otherwise(0.0).alias("jaccard"))


def subsample_per_group(df: DataFrame, by: str, ident: str, n: int, seed: int) -> DataFrame:
    """n rows per group without replacement, chosen by an MD5 of the id: the same for every run, partitioning and engine."""
    w = Window.partitionBy(by).orderBy(_draw(ident, seed), ident)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def subsample_fraction(df: DataFrame, ident: str, share: float, seed: int) -> DataFrame:
    """Each row with probability ``share``, decided by an MD5 of the id (its first eight hexadecimal digits as a fraction)."""
    return df.where(F.conv(F.substring(_draw(ident, seed), 1, 8), 16, 10).cast("bigint") < F.lit(int(share * (1 << 32))))


def _draw(ident: str, seed: int) -> Column:
    return F.md5(F.concat_ws("/", F.col(ident).cast("string"), F.lit(str(seed))))


def natural_key(c: Column) -> list[Column]:
    """Sort keys that order 'chr2' before 'chr10'."""
    return [F.regexp_extract(c, r"^(\D*)", 1), F.try_to_number(F.regexp_extract(c, r"^\D*(\d+)", 1), F.lit("999999999999")), c]


def long_form(entries: DataFrame, obs: DataFrame, var: DataFrame) -> DataFrame:
    return entries.join(obs, "obs_id").join(var, "var_id")


# --- experiments' frames ------------------------------------------------------------------------------
def consensus_outer(frames: Mapping[str, DataFrame], keys: Sequence[str]) -> DataFrame:
    """Results of several methods (keys and a column of the method's name) joined in full; repeated rows count once, missing results are null."""
    parts = [df.select(*keys, name).dropDuplicates([*keys, name]) for name, df in frames.items()]
    return reduce(lambda a, b: a.join(b, list(keys), "full_outer"), parts)


def filter_results(df: DataFrame, most: Mapping[str, float], order: Sequence[str] = ()) -> DataFrame:
    """Rows whose columns are at most the given bounds (e.g. fdr, p), in order."""
    kept = reduce(lambda d, kv: d.where(F.col(kv[0]) <= kv[1]), most.items(), df)
    return kept.orderBy(*order) if order else kept


def filter_interactions(df: DataFrame, sources: Sequence = (), targets: Sequence = (), ligands: Sequence = (), receptors: Sequence = (), criteria: Sequence[Column] = ()) -> DataFrame:
    """Interactions (source, target, ligand, receptor, ...) of the named sides that meet all criteria; an empty list does not restrict."""
    for c, values in (("source", sources), ("target", targets), ("ligand", ligands), ("receptor", receptors)):
        df = df.where(F.col(c).isin(*values)) if values else df
    return reduce(lambda d, c: d.where(c), criteria, df)


def group_cdf(interactions: DataFrame, stats: DataFrame, group: str) -> DataFrame:
    """Adds ligand_cdf and receptor_cdf: normal distribution functions of the sides' means with the moments of their group.

    ``interactions``: source, target, l_mean, r_mean; ``stats``: (group, mean, sd, n), joined once for either side. Null for a group without stats or spread.
    """
    from sparmat.functions.stats import normal_cdf

    out = interactions
    for side, at in (("l", "source"), ("r", "target")):
        s = stats.select(F.col(group).alias(at), *[F.col(c).alias(f"_{side}_{c}") for c in ("mean", "sd", "n")])
        z = F.try_divide((F.col(f"{side}_mean") - F.col(f"_{side}_mean")) * F.sqrt(f"_{side}_n"), F.when(F.col(f"_{side}_sd") > 0, F.col(f"_{side}_sd")))
        out = out.join(s, at, "left").withColumn({"l": "ligand_cdf", "r": "receptor_cdf"}[side], normal_cdf(z)).drop(*[f"_{side}_{c}" for c in ("mean", "sd", "n")])
    return out


def region_of_interest(df: DataFrame, x: str, y: str, x_range: tuple[float, float], y_range: tuple[float, float], into: str, name: str) -> DataFrame:
    """Rows inside a rectangle (bounds included), labelled as a region of their own."""
    return df.where(F.col(x).between(*x_range) & F.col(y).between(*y_range)).withColumn(into, F.lit(name))


def transform_coordinates(df: DataFrame, **functions: Callable[[Column], Column]) -> DataFrame:
    """Coordinate columns replaced by functions of themselves."""
    return df.withColumns({c: f(F.col(c)) for c, f in functions.items()})


def attach_layers(layers: Mapping[str, DataFrame], obs: DataFrame, var: DataFrame) -> DataFrame:
    """(obs_id, var_id, and a column per layer): entries of the layers over the observations and variables that all of them share; 0 where a layer has none."""
    shared_o = reduce(lambda a, b: a.join(b, "obs_id", "left_semi"), [d.select("obs_id").distinct() for d in layers.values()], obs.select("obs_id"))
    shared_v = reduce(lambda a, b: a.join(b, "var_id", "left_semi"), [d.select("var_id").distinct() for d in layers.values()], var.select("var_id"))
    long = reduce(DataFrame.unionByName, [d.select("obs_id", "var_id", *[(F.col("value") if n == name else F.lit(0.0)).alias(n) for n in layers]) for name, d in layers.items()])
    return long.join(shared_o, "obs_id", "left_semi").join(shared_v, "var_id", "left_semi").groupBy("obs_id", "var_id").agg(*[F.sum(n).alias(n) for n in layers])


def resolve_variable(name: str, obs: DataFrame, var: DataFrame, entries: DataFrame) -> DataFrame:
    """(obs_id, value) of a name, looked for as a column of obs, then as var_id, as ``gene`` and as ``id`` of var; absent entries are 0.

    Of several variables of one name the smallest var_id is taken; a name that is found nowhere is an error.
    """
    if name in obs.columns:
        return obs.select("obs_id", F.col(name).alias("value"))
    for c in ("var_id", "gene", "id"):
        if c in var.columns:
            hit = var.where(F.col(c).cast("string") == name).agg(F.min("var_id")).first()[0]
            if hit is not None:
                return obs.select("obs_id").join(entries.where(F.col("var_id") == hit).select("obs_id", "value"), "obs_id", "left").fillna(0.0, ["value"])
    raise KeyError(name)


def annotate_variables(df: DataFrame, genes: DataFrame, by: str) -> DataFrame:
    """Gene columns for names of the form 'modality:taxa:uid' (or a bare uid); names without an entry get nulls."""
    parts = F.split(by, ":")
    return df.withColumn("uid", F.element_at(parts, -1)).join(genes, "uid", "left")


def select_slots(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Without the named columns; names that do not exist are no error."""
    return df.drop(*names)
