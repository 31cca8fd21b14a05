"""The data model: sparse measurements with metadata on both axes, embeddings and alternative experiments."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.relational import written


@dataclass(frozen=True)
class Bundle:
    """A feature x cell matrix with annotations. Every part is a lazy DataFrame.

    ``features``: ``feature_id``, ``feature_ord`` and any metadata; ``cells``: ``cell_id``, ``cell_ord`` and
    any metadata; ``assays``: name to (``feature_id``, ``cell_id``, ``value``), stored non-zero values only, an
    absent row is 0; ``reduced``: name to (``cell_id``, ``coords``); ``attrs``: attributes of an embedding by its
    name; ``alts``: further features of the same cells; ``levels``: level order of factor columns.
    """

    features: DataFrame
    cells: DataFrame
    assays: Mapping[str, DataFrame] = field(default_factory=dict)
    reduced: Mapping[str, DataFrame] = field(default_factory=dict)
    attrs: Mapping[str, Mapping[str, Any]] = field(default_factory=dict)
    alts: Mapping[str, Bundle] = field(default_factory=dict)
    levels: Mapping[str, list] = field(default_factory=dict)

    def assay(self, name: str) -> DataFrame | None:
        """The assay of that name, or None. ``exprs`` stands for ``logcounts`` if there is none of its own."""
        if name == "exprs" and name not in self.assays:
            name = "logcounts"
        return self.assays.get(name)

    def need(self, name: str) -> DataFrame:
        """The assay of that name; an error if there is none."""
        a = self.assay(name)
        if a is None:
            raise KeyError(f"no assay named {name!r}; there are {sorted(self.assays)}")
        return a

    def with_assay(self, name: str, values: DataFrame) -> Bundle:
        """The bundle with an assay added or replaced; zeros and nulls are not stored."""
        stored = values.select("feature_id", "cell_id", F.col("value").cast("double").alias("value")).where("value <> 0")
        return replace(self, assays={**self.assays, "logcounts" if name == "exprs" else name: stored})

    def with_reduced(self, name: str, coords: DataFrame, attrs: Mapping[str, Any] | None = None) -> Bundle:
        """The bundle with an embedding stored under a name; one of that name is replaced."""
        return replace(self, reduced={**self.reduced, name: coords.select("cell_id", "coords")}, attrs={**self.attrs, name: dict(attrs or {})})

    def with_cells(self, columns: DataFrame) -> Bundle:
        """Columns keyed by ``cell_id`` added to the cell metadata; columns of the same name are replaced."""
        new = [c for c in columns.columns if c != "cell_id"]
        return replace(self, cells=self.cells.drop(*new).join(columns, "cell_id", "left"))

    def with_features(self, columns: DataFrame) -> Bundle:
        """Columns keyed by ``feature_id`` added to the feature metadata."""
        new = [c for c in columns.columns if c != "feature_id"]
        return replace(self, features=self.features.drop(*new).join(columns, "feature_id", "left"))

    def experiment(self, altexp: str | None) -> Bundle:
        """The bundle itself or an alternative experiment over its cells."""
        if altexp is None:
            return self
        if altexp not in self.alts:
            raise KeyError(f"no alternative experiment named {altexp!r}")
        return self.alts[altexp]

    def realised(self, *names: str) -> Bundle:
        """The bundle with assays (all by default) computed once and written to the shared folder.

        For work that goes over an assay several times: what an assay is derived from is then read
        once, and the passes scan a narrow table. Runs a job.
        """
        done = {n: written(a, "assay") if not names or n in names else a for n, a in self.assays.items()}
        return replace(self, assays=done)

    # named accessors
    def counts(self) -> DataFrame | None:
        return self.assay("counts")

    def exprs(self) -> DataFrame | None:
        return self.assay("exprs")

    def norm_exprs(self) -> DataFrame | None:
        return self.assay("norm_exprs")

    def stand_exprs(self) -> DataFrame | None:
        return self.assay("stand_exprs")

    def fpkm(self) -> DataFrame | None:
        return self.assay("fpkm")

    def set_exprs(self, values: DataFrame) -> Bundle:
        return self.with_assay("exprs", values)

    def set_norm_exprs(self, values: DataFrame) -> Bundle:
        return self.with_assay("norm_exprs", values)

    def set_stand_exprs(self, values: DataFrame) -> Bundle:
        return self.with_assay("stand_exprs", values)

    def set_fpkm(self, values: DataFrame) -> Bundle:
        return self.with_assay("fpkm", values)

    def bootstraps(self) -> dict[str, DataFrame]:
        """All assays whose name starts with ``bootstrap``."""
        return {k: v for k, v in self.assays.items() if k.startswith("bootstrap")}

    def set_bootstraps(self, cube: DataFrame) -> Bundle:
        """Bootstrap assays replaced by a cube (feature_id, cell_id, values ARRAY), one assay per replicate.

        The number of replicates is the length of the longest array; shorter arrays mean 0.
        """
        k = cube.agg(F.max(F.size("values"))).first()[0] or 0
        kept = {n: a for n, a in self.assays.items() if not n.startswith("bootstrap")}
        long = cube.select("feature_id", "cell_id", F.posexplode("values").alias("_r", "value"))
        new = {f"bootstrap{r + 1}": long.where((F.col("_r") == r) & (F.col("value") != 0)).select("feature_id", "cell_id", "value") for r in range(k)}
        return replace(self, assays={**kept, **new})


def dense(assay: DataFrame, features: DataFrame, cells: DataFrame, keep: list[str] = ()) -> DataFrame:
    """Every pair of the selected features and cells with its value, zeros included.

    ``features``: (``feature_id``, ``ord``), a selection whose size the caller chose; it is checked (at most
    5,000), collected and exploded over the cells, so no join of all with all is planned.
    """
    rows = features.select("feature_id", "ord").limit(5_001).collect()
    if len(rows) > 5_000:
        raise ValueError("a dense matrix takes 5,000 selected features at most")
    out = cells.select("cell_id", *keep)
    if not rows:
        return out.limit(0).select("cell_id", *keep, F.lit(0).alias("ord"), F.lit(None).cast(features.schema["feature_id"].dataType).alias("feature_id"), F.lit(0.0).alias("value"))
    kind = features.schema["feature_id"].dataType
    items = F.array(*[F.struct(F.lit(int(r["ord"])).alias("ord"), F.lit(r["feature_id"]).cast(kind).alias("feature_id")) for r in sorted(rows, key=lambda r: r["ord"])])
    grid = out.withColumn("_f", F.explode(items)).select("cell_id", *keep, "_f.ord", "_f.feature_id")
    some = assay.where(F.col("feature_id").isin([r["feature_id"] for r in rows]))
    return grid.join(some, ["cell_id", "feature_id"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))


def number_of(df: DataFrame):
    """The number of rows as a scalar subquery, planned with the query that uses it."""
    return df.agg(F.count(F.lit(1))).scalar()
