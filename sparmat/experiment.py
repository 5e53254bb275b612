"""An experiment: the sample table and, per modality, obs, var, entries and embeddings, with the operators as methods.

Two scopes: a method acts on all samples of a modality unless ``samples`` names some; per-sample results are
grouped by the sample column, never looped over. Every method returns a new experiment.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparmat.model import Matrix
from sparmat.operators import aggregate, normalize, relational
from sparmat.sources import writers

SLOTS = ("obs", "var", "entries", "embedding")


@dataclass(frozen=True)
class Experiment:
    metadata: DataFrame
    tables: dict[str, dict[str, DataFrame]] = field(default_factory=dict)  # modality -> slot -> table

    def matrix(self, modality: str) -> Matrix:
        t = self.tables[modality]
        return Matrix(t["entries"], t["obs"], t["var"])

    def with_table(self, modality: str, slot: str, df: DataFrame) -> Experiment:
        return replace(self, tables=self.tables | {modality: self.tables.get(modality, {}) | {slot: df}})

    def map_obs(self, modality: str, f: Callable[[DataFrame], DataFrame]) -> Experiment:
        return self.with_table(modality, "obs", f(self.tables[modality]["obs"]))

    def restrict(self, modality: str, obs: DataFrame) -> Experiment:
        """Keep these observations in every table of the modality."""
        out = self.with_table(modality, "obs", obs)
        for slot in ("entries", "embedding"):
            if slot in self.tables[modality]:
                out = out.with_table(modality, slot, self.tables[modality][slot].join(obs.select("obs_id"), "obs_id", "left_semi"))
        return out

    def keep(self, modality: str, column: str, values: Sequence) -> Experiment:
        return self.restrict(modality, relational.keep(self.tables[modality]["obs"], column, values))

    def exclude(self, modality: str, column: str, values: Sequence) -> Experiment:
        return self.restrict(modality, relational.exclude(self.tables[modality]["obs"], column, values))

    def filter(self, modality: str, into: str, criteria: Sequence[Column]) -> Experiment:
        return self.map_obs(modality, lambda o: relational.label_where(o, into, criteria))

    def annotate(self, modality: str, cluster: str, into: str, labels: dict) -> Experiment:
        return self.map_obs(modality, lambda o: relational.annotate(o, cluster, into, labels))

    def pull(self, modality: str, other: str, column: str) -> Experiment:
        """Column of another modality's observations as ``other:column``."""
        src = self.tables[other]["obs"].select("obs_id", F.col(column).alias(f"{other}:{column}"))
        return self.map_obs(modality, lambda o: o.join(src, "obs_id", "left"))

    def subsample(self, modality: str, by: str, n: int, seed: int = 0) -> Experiment:
        return self.restrict(modality, relational.subsample_per_group(self.tables[modality]["obs"], by, "obs_id", n, seed))

    def qc(self, modality: str, marked: Column) -> Experiment:
        m = aggregate.qc_metrics(self.matrix(modality), marked)
        return self.map_obs(modality, lambda o: o.join(m, "obs_id"))

    def normalize(self, modality: str, target: float | None = None, log: bool = True) -> Experiment:
        e = normalize.normalize_total(self.matrix(modality), target)
        return self.with_table(modality, "entries", normalize.log1p(e) if log else e)

    def pseudobulk(self, modality: str, by: str) -> DataFrame:
        return aggregate.pseudobulk(self.matrix(modality), by)

    def summarize(self, modality: str, on: str, across: str, split: str) -> DataFrame:
        return aggregate.summary_cube(self.tables[modality]["obs"], on, across, split)

    def joint(self, other: Experiment, modality: str, name: str, other_name: str) -> Experiment:
        """Union with another experiment: shared obs columns, all features, an ``origin`` label."""
        a, b = self.tables[modality], other.tables[modality]
        out = self.with_table(modality, "obs", relational.joint(a["obs"], b["obs"], name, other_name))
        out = out.with_table(modality, "entries", a["entries"].unionByName(b["entries"]))
        shared = [c for c in a["var"].columns if c in b["var"].columns]
        return out.with_table(modality, "var", a["var"].select(*shared).unionByName(b["var"].select(*shared)).dropDuplicates(["var_id"]))

    def save(self, path: str, subset: str = "integrated") -> None:
        writers.write_table(self.metadata, f"{path}/metadata", ())
        for modality, slots in self.tables.items():
            for slot, df in slots.items():
                writers.write_table(df, f"{path}/{subset}/{modality}/{slot}", ("sample",))

    @classmethod
    def load(cls, spark: SparkSession, path: str, modalities: Sequence[str], subset: str = "integrated", **equal) -> Experiment:
        """A saved experiment; ``equal`` restricts obs (e.g. ``sample='s1'``) and all that hangs on it."""
        out = cls(spark.read.parquet(f"{path}/metadata"))
        for m in modalities:
            for slot in SLOTS:
                try:
                    out = out.with_table(m, slot, spark.read.parquet(f"{path}/{subset}/{m}/{slot}"))
                except Exception as e:
                    if "PATH_NOT_FOUND" not in str(e):
                        raise
            if equal:
                out = out.restrict(m, writers.load_table(spark, f"{path}/{subset}/{m}/obs", **equal))
        return out
