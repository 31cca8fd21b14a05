"""Variance of features or components explained by single variables of the cell metadata."""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..bundle import Bundle


def variance_explained(assay: DataFrame, features: DataFrame, cells: DataFrame, variables: Sequence[str]) -> DataFrame:
    """(feature_id, variable, pct): 100 * R2 of a linear model on one variable with intercept.

    Cells without the variable leave its model only; a numeric variable is a slope, any other a factor. A
    variable with fewer than two values gives null for all features (with a warning when it is plainly
    constant is left to the caller), a feature without variance gives null.

    All numeric variables share one pass, all factors another: sums over the stored rows are
    combined on the map side and the sums over cells complete the zeros.
    """
    numeric = [v for v in variables if isinstance(cells.schema[v].dataType, T.NumericType)]
    factors = [v for v in variables if v not in numeric]
    out = []
    a = assay.select("feature_id", "cell_id", "value")
    if numeric:
        z = cells.select("cell_id", F.explode(F.array(*[F.struct(F.lit(v).alias("variable"), F.col(v).cast("double").alias("z")) for v in numeric])).alias("s"))
        z = z.select("cell_id", "s.variable", "s.z").where("z IS NOT NULL AND NOT isnan(z)")
        mid = z.groupBy("variable").agg(F.avg("z").alias("_m"))
        z = z.join(F.broadcast(mid), "variable").select("cell_id", "variable", (F.col("z") - F.col("_m")).alias("z"))  # one row per variable
        n = z.groupBy("variable").agg(F.count(F.lit(1)).alias("n"), F.sum("z").alias("sz"), F.sum(F.col("z") * F.col("z")).alias("szz"))
        s = a.join(z, "cell_id").groupBy("feature_id", "variable").agg(
            F.sum("value").alias("sx"), F.sum(F.col("value") * F.col("value")).alias("sxx"), F.sum(F.col("value") * F.col("z")).alias("sxz")
        )
        j = s.join(F.broadcast(n), "variable")
        cov = F.col("sxz") - F.col("sx") * F.col("sz") / F.col("n")
        vz, vx = F.col("szz") - F.col("sz") * F.col("sz") / F.col("n"), F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n")
        r2 = F.try_divide(cov * cov, F.when((vz > 1e-12) & (vx > 1e-9 * F.col("sxx")), vz * vx))
        out.append(j.select("feature_id", "variable", (r2 * 100).alias("pct")))
    if factors:
        z = cells.select("cell_id", F.explode(F.array(*[F.struct(F.lit(v).alias("variable"), F.col(v).cast("string").alias("level")) for v in factors])).alias("s"))
        z = z.select("cell_id", "s.variable", "s.level").where("level IS NOT NULL")
        size = z.groupBy("variable", "level").agg(F.count(F.lit(1)).alias("ng"))
        all_ = size.groupBy("variable").agg(F.sum("ng").alias("n"), F.count(F.lit(1)).alias("k"))
        s = a.join(z, "cell_id").groupBy("feature_id", "variable", "level").agg(F.sum("value").alias("sg"), F.sum(F.col("value") * F.col("value")).alias("qg"))
        # levels without a stored row have sum 0 and add nothing to the sum of sg^2 / ng
        t = s.join(size, ["variable", "level"]).groupBy("feature_id", "variable").agg(F.sum("sg").alias("sx"), F.sum("qg").alias("sxx"), F.sum(F.col("sg") * F.col("sg") / F.col("ng")).alias("between"))
        j = t.join(F.broadcast(all_), "variable")
        mean2 = F.col("sx") * F.col("sx") / F.col("n")
        tss = F.col("sxx") - mean2
        r2 = F.try_divide(F.col("between") - mean2, F.when((F.col("k") > 1) & (tss > 1e-9 * F.col("sxx")), tss))
        out.append(j.select("feature_id", "variable", (r2 * 100).alias("pct")))
    names = F.explode(F.array(*[F.lit(v) for v in variables]))
    grid = features.select("feature_id", names.alias("variable"))
    both = out[0] if len(out) == 1 else out[0].unionByName(out[1])
    return grid.join(both, ["feature_id", "variable"], "left")


def get_variance_explained(bundle: Bundle, variables: Sequence[str] | None = None, features=None, assay_type: str = "logcounts") -> DataFrame:
    """:func:`variance_explained` for a bundle; all metadata columns but ids by default."""
    variables = list(variables or [c for c in bundle.cells.columns if c not in ("cell_id", "cell_ord")])
    same = bundle.cells.agg(*[F.coalesce(F.min(v) == F.max(v), F.lit(True)).alias(v) for v in variables]).first()
    for v in variables:
        if same[v]:
            warnings.warn(f"ignoring {v!r} with fewer than 2 unique levels", stacklevel=2)
    f = bundle.features
    if features is not None:
        from .retrieve import select_features

        f = select_features(bundle, features)
    return variance_explained(bundle.need(assay_type).join(f.select("feature_id"), "feature_id", "left_semi"), f, bundle.cells, variables)


def get_explanatory_pcs(bundle: Bundle, dimred: str = "PCA", n_dimred: int = 10, variables: Sequence[str] | None = None) -> DataFrame:
    """(component, variable, pct): variance of each component explained by each variable; ``n_dimred`` clips."""
    variables = list(variables or [c for c in bundle.cells.columns if c not in ("cell_id", "cell_ord")])
    long = bundle.reduced[dimred].select("cell_id", F.posexplode(F.slice("coords", 1, n_dimred)).alias("i", "value"))
    long = long.select((F.col("i") + 1).alias("feature_id"), "cell_id", "value")
    return variance_explained(long, long.select("feature_id").distinct(), bundle.cells, variables).withColumnRenamed("feature_id", "component")


def top_variables(explained: DataFrame, n: float | None = 10, how: str = "median", least: float = 0.0) -> DataFrame:
    """(variable, score): variables by their median (or max) percentage, those of at least ``least``, the first ``n``.

    Variables without any percentage are left out; ``n`` None or infinite keeps all, 0 none; ties by name.
    """
    score = F.percentile("pct", F.lit(0.5)) if how == "median" else F.max("pct")
    t = explained.groupBy("variable").agg(score.alias("score")).where(F.col("score") >= least).orderBy(F.col("score").desc(), "variable")
    return t if n is None or n == float("inf") else t.limit(int(n))


def explanatory_variables(bundle: Bundle, n: float | None = 10, min_marginal_r2: float = 0.0, variables=None, assay_type: str = "logcounts") -> DataFrame:
    """(Expl_Var, Pct_Var_Explained) of every feature for the top variables."""
    e = get_variance_explained(bundle, variables, assay_type=assay_type)
    top = top_variables(e, n, "median", min_marginal_r2)
    return e.join(top, "variable").select(F.col("variable").alias("Expl_Var"), F.col("pct").alias("Pct_Var_Explained"), "feature_id")


def explanatory_pcs(bundle: Bundle, n: float | None = 10, npcs: int = 50, dimred: str = "PCA", variables=None) -> DataFrame:
    """(PC, Expl_Var, Pct_Var_Explained) for the variables of the largest maximum."""
    e = get_explanatory_pcs(bundle, dimred, npcs, variables)
    return e.join(top_variables(e, n, "max", -1.0), "variable").select(F.col("component").alias("PC"), F.col("variable").alias("Expl_Var"), F.col("pct").alias("Pct_Var_Explained"))
