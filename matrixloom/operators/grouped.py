"""Group means and detection rates, block correction, scaling, binning and contingency."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..bundle import Bundle
from .retrieve import renamed, select_cells, select_features

#: Combinations of group and block at most; they are held on the driver.
MOST_COMBINATIONS = 10_000


def group_summaries(bundle: Bundle, features, group: str | None = None, block: str | None = None, detection_limit: float = 0, assay_type: str = "logcounts", cells=None) -> DataFrame:
    """Per feature and group (and block): ``mean`` and proportion ``detected`` over the group's cells, zeros included.

    Without ``group`` all cells are one group ``all``. Cells of a null group or block take no part. Every
    selected feature has a row for every combination that has cells.
    """
    c = select_cells(bundle, cells)
    g = F.col(group) if group else F.lit("all")
    keys = ["group", *(["block"] if block else [])]
    c = c.select("cell_id", g.alias("group"), *([F.col(block).alias("block")] if block else [])).dropna(subset=keys)
    size = c.groupBy(*keys).agg(F.count(F.lit(1)).alias("ncells"))
    f = select_features(bundle, features)
    s = bundle.need(assay_type).join(f.select("feature_id"), "feature_id", "left_semi").join(c, "cell_id")
    s = s.groupBy("feature_id", *keys).agg(F.sum("value").alias("_s"), F.count_if(F.col("value") > detection_limit).alias("_d"))
    combos = size.limit(MOST_COMBINATIONS + 1).collect()
    if len(combos) > MOST_COMBINATIONS:
        raise ValueError(f"more than {MOST_COMBINATIONS} combinations of {keys}")
    if not combos:
        return s.select("feature_id", F.lit(0).alias("ord"), *keys, F.col("_s").alias("mean"), F.col("_s").alias("detected"), F.lit(0).cast("long").alias("ncells")).limit(0)
    every = F.array(*[F.struct(*[F.lit(r[k]).alias(k) for k in [*keys, "ncells"]]) for r in combos])
    grid = f.withColumn("_c", F.explode(every)).select("feature_id", "ord", *[F.col(f"_c.{k}").alias(k) for k in [*keys, "ncells"]])
    out = grid.join(s, ["feature_id", *keys], "left")
    n = F.col("ncells")
    return out.select("feature_id", "ord", *keys, (F.coalesce("_s", F.lit(0.0)) / n).alias("mean"), (F.coalesce("_d", F.lit(0)) / n).alias("detected"), "ncells")


def correct_blocks(summary: DataFrame, value: str, transform: str | None = None) -> DataFrame:
    """Group values with the additive effect of the block regressed out: (feature_id, ord, group, value).

    Per feature ``value = group + block`` is fitted by least squares over the combinations that have cells, all
    weighted alike, and the group's value at the average block effect is returned. The combinations
    are the same for every feature, so the fit is one small matrix worked out once and applied as a
    weighted sum. ``transform='logit'`` fits proportions on the logit scale, kept 0.5 / ncells from 0 and 1.
    """
    combos = [(r[0], r[1]) for r in summary.select("group", "block").distinct().limit(MOST_COMBINATIONS + 1).collect()]
    if len(combos) > MOST_COMBINATIONS:
        raise ValueError("too many combinations of group and block")
    groups, blocks = sorted({g for g, _ in combos}), sorted({b for _, b in combos})
    x = np.zeros((len(combos), len(groups) + len(blocks)))
    for i, (g, b) in enumerate(combos):
        x[i, groups.index(g)] = x[i, len(groups) + blocks.index(b)] = 1
    to = np.hstack([np.eye(len(groups)), np.full((len(groups), len(blocks)), 1 / max(len(blocks), 1))])
    weights = to @ np.linalg.pinv(x)
    rows = [(combos[i][0], combos[i][1], groups[k], float(weights[k, i])) for i in range(len(combos)) for k in range(len(groups)) if abs(weights[k, i]) > 1e-12]
    spark = summary.sparkSession
    kinds = {c: summary.schema[c].dataType.simpleString() for c in ("group", "block")}
    w = spark.createDataFrame(rows, f"group {kinds['group']}, block {kinds['block']}, _to {kinds['group']}, _w double")
    v = F.col(value)
    if transform == "logit":
        edge = F.lit(0.5) / F.col("ncells")
        p = F.greatest(edge, F.least(1 - edge, v))
        v = F.ln(p / (1 - p))
    out = summary.withColumn("_v", v).join(w, ["group", "block"]).groupBy("feature_id", "ord", "_to").agg(F.sum(F.col("_v") * F.col("_w")).alias("_v"))
    v = 1 / (1 + F.exp(-F.col("_v"))) if transform == "logit" else F.col("_v")
    return out.select("feature_id", "ord", F.col("_to").alias("group"), v.alias(value))


def scale_rows(long: DataFrame, value: str = "value", center: bool = False, scale: bool = False, zlim: tuple[float, float] | None = None) -> DataFrame:
    """Values per feature centred on their mean and scaled to sqrt(sum of squares / (m - 1)) over the m shown columns.

    Scaling a row without spread gives null. ``zlim`` saturates; without it nothing is cut.
    """
    w = Window.partitionBy("feature_id")
    if center:
        long = long.withColumn(value, F.col(value) - F.avg(value).over(w))
    if scale:
        root = F.sqrt(F.sum(F.col(value) * F.col(value)).over(w) / F.greatest(F.count(F.lit(1)).over(w) - 1, F.lit(1)))
        long = long.withColumn(value, F.try_divide(F.col(value), F.when(root > 1e-12, root)))
    if zlim:
        long = long.withColumn(value, clamp(F.col(value), *zlim))
    return long


def clamp(c, low: float | None, high: float | None):
    """A column saturated to [low, high]; null and NaN stay what they are."""
    out = c
    if low is not None:
        out = F.greatest(F.lit(float(low)), out)
    if high is not None:
        out = F.least(F.lit(float(high)), out)
    return F.when(c.isNull() | F.isnan(c), c).otherwise(out)


def colour_scale(long: DataFrame, value: str = "value", center: bool = False, colours: int = 100) -> DataFrame:
    """One row ``low``, ``high`` and ``breaks`` (colours + 1 of them): the range, symmetric about 0 if centred."""
    r = long.agg(F.min(value).alias("_a"), F.max(value).alias("_b"))
    top = F.greatest(F.abs("_a"), F.abs("_b"))
    lo, hi = (-top, top) if center else (F.col("_a"), F.col("_b"))
    r = r.select(lo.alias("low"), hi.alias("high"))
    return r.withColumn("breaks", F.transform(F.sequence(F.lit(0), F.lit(colours)), lambda i: F.col("low") + (F.col("high") - F.col("low")) * i / colours))


def dots(bundle: Bundle, features, group: str | None = None, block: str | None = None, detection_limit: float = 0, center: bool = False, scale: bool = False, zlim=None, max_detected: float | None = None, assay_type: str = "logcounts", swap_rownames: str | None = None) -> DataFrame:
    """(Feature, Group, NumDetected, Average) as drawn by a dot plot: proportion detected and group mean."""
    s = group_summaries(bundle, select_features(bundle, features, swap_rownames), group, block, detection_limit, assay_type)
    if block:
        a = correct_blocks(s, "mean")
        d = correct_blocks(s, "detected", "logit")
        s = a.join(d.drop("ord"), ["feature_id", "group"])
    s = scale_rows(s, "mean", center, scale, zlim)
    d = F.least(F.col("detected"), F.lit(float(max_detected))) if max_detected is not None else F.col("detected")
    out = s.select(F.col("feature_id").alias("Feature"), F.col("group").alias("Group"), d.alias("NumDetected"), F.col("mean").alias("Average"))
    return renamed(out, bundle, swap_rownames)


def grouped_heatmap(bundle: Bundle, features, group: str, block: str | None = None, cells=None, center: bool = False, scale: bool = False, zlim=None, assay_type: str = "logcounts", swap_rownames: str | None = None) -> DataFrame:
    """(Feature, Group, value): group means as a heat map's cells."""
    s = group_summaries(bundle, select_features(bundle, features, swap_rownames), group, block, 0, assay_type, cells)
    if block:
        s = correct_blocks(s, "mean")
    s = scale_rows(s, "mean", center, scale, zlim)
    return renamed(s.select(F.col("feature_id").alias("Feature"), F.col("group").alias("Group"), F.col("mean").alias("value")), bundle, swap_rownames)


def wide(long: DataFrame, rows: str, columns: str, value: str, order: list) -> DataFrame:
    """A long frame as one row per ``rows`` with a column for each of ``order``."""
    return long.groupBy(rows).pivot(columns, order).agg(F.first(value))


def contingency(df: DataFrame, x: str, y: str, x_levels: list, y_levels: list) -> DataFrame:
    """(X, Y, n, share, half_width, half_height) of every pair of levels, empty pairs too; share of the largest.

    Rows of an unlisted or null level are left out. Rectangles have half sides 0.49 * sqrt(share), or 0.49 *
    share on the long side and 0.4 on the other if one axis has a single level.
    """
    spark = df.sparkSession
    kx, ky = (df.schema[c].dataType.simpleString() for c in (x, y))
    grid = spark.createDataFrame([(a, b) for a in x_levels for b in y_levels], f"X {kx}, Y {ky}")
    n = df.groupBy(F.col(x).alias("X"), F.col(y).alias("Y")).agg(F.count(F.lit(1)).alias("n"))
    out = grid.join(n, ["X", "Y"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    top = out.agg(F.max("n")).scalar()
    share = F.try_divide(F.col("n").cast("double"), top.cast("double"))
    if len(x_levels) > 1 and len(y_levels) > 1:
        w = h = F.sqrt("share") * 0.49
    elif len(y_levels) == 1:
        w, h = F.col("share") * 0.49, F.lit(0.4)
    else:
        w, h = F.lit(0.4), F.col("share") * 0.49
    return out.withColumn("share", share).withColumn("half_width", w).withColumn("half_height", h)


def bin2d(df: DataFrame, x: str, y: str, bins: int = 30, value: str | None = None, how="sum") -> DataFrame:
    """(xbin, ybin, n[, value]) of points in ``bins`` x ``bins`` equal cells of their range, the top edges within.

    ``how``: the aggregate of ``value`` in a cell, the name of a built-in or a function from column to aggregate. Points with a null or NaN place
    are left out; if all places are equal there is one bin.
    """
    d = df.where(f"`{x}` IS NOT NULL AND `{y}` IS NOT NULL AND NOT isnan(cast(`{x}` AS double)) AND NOT isnan(cast(`{y}` AS double))")
    r = d.agg(F.struct(F.min(x).cast("double").alias("a"), F.max(x).cast("double").alias("b"), F.min(y).cast("double").alias("c"), F.max(y).cast("double").alias("d")).alias("r")).scalar()

    def at(c, lo, hi):
        return F.least(F.lit(bins - 1), F.coalesce(F.floor(F.try_divide((F.col(c) - lo) * bins, hi - lo)), F.lit(0))).cast("int")

    d = d.withColumn("_r", r)
    d = d.withColumn("xbin", at(x, F.col("_r.a"), F.col("_r.b"))).withColumn("ybin", at(y, F.col("_r.c"), F.col("_r.d")))
    aggs = [F.count(F.lit(1)).alias("n")]
    if value:
        aggs.append((how(F.col(value)) if callable(how) else getattr(F, how)(value)).alias("value"))
    return d.groupBy("xbin", "ybin").agg(*aggs)


def density(df: DataFrame, value: str, group: str | None, low: float, high: float, points: int = 128, width: float | None = None) -> DataFrame:
    """(group, x, density): a Gaussian kernel density on a grid of ``points``; a null or NaN value counts for nothing.

    Values are first counted in a fine grid of 4 * ``points`` cells, so the curve costs bins times points and
    not rows times points. ``width`` defaults to Silverman's rule per group.
    """
    g = F.col(group) if group else F.lit("all")
    fine = 4 * points
    step = (high - low) / fine
    d = df.select(g.alias("group"), F.col(value).cast("double").alias("v")).where("v IS NOT NULL AND NOT isnan(v)")
    s = d.groupBy("group").agg(F.count(F.lit(1)).alias("_n"), F.stddev_samp("v").alias("_sd"))
    h = F.lit(float(width)) if width else F.greatest(F.lit(step), F.coalesce("_sd", F.lit(0.0)) * 1.06 * F.pow(F.col("_n").cast("double"), F.lit(-0.2)))
    b = d.groupBy("group", F.round((F.col("v") - low) / step).alias("_b")).agg(F.count(F.lit(1)).alias("_k"))
    grid = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.lit(low) + i * (high - low) / (points - 1))
    j = b.join(s.select("group", "_n", h.alias("_h")), "group").withColumn("x", F.explode(grid))
    z = (F.col("x") - low - F.col("_b") * step) / F.col("_h")
    k = F.col("_k") * F.exp(-z * z / 2) / (F.col("_n") * F.col("_h") * float(np.sqrt(2 * np.pi)))
    return j.groupBy("group", "x").agg(F.sum(k).alias("density"))


def spread_by_level(df: DataFrame, x: str = "X", y: str = "Y") -> DataFrame:
    """(X, n, q25, median, q75) of a numeric column per level: the bars inside violins. Nulls and NaN are left out."""
    d = df.where(f"`{x}` IS NOT NULL AND `{y}` IS NOT NULL AND NOT isnan(cast(`{y}` AS double))")
    q = F.percentile(y, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = d.groupBy(F.col(x).alias("X")).agg(F.count(F.lit(1)).alias("n"), q.alias("_q"))
    return out.select("X", "n", *[F.get("_q", F.lit(i)).alias(name) for i, name in enumerate(("q25", "median", "q75"))])


def cluster_order(x: np.ndarray) -> list[int]:
    """The order of the rows of a small matrix along a complete-linkage tree, as heat maps sort them; at least 2 rows.

    For the selected rows of a heat map, at most 2,000: all pairs are held on the driver.
    """
    n = len(x)
    if not 2 <= n <= 2_000:
        raise ValueError("clustering takes 2 to 2,000 rows")
    x = np.asarray(x, float)
    d = np.sqrt(np.maximum((x**2).sum(1)[:, None] + (x**2).sum(1) - 2 * x @ x.T, 0))
    np.fill_diagonal(d, np.inf)
    parts: dict[int, list[int]] = {i: [i] for i in range(n)}
    for _ in range(n - 1):
        i, j = sorted(np.unravel_index(np.argmin(d), d.shape))
        parts[i] += parts.pop(j)
        far = np.maximum(d[i], d[j])
        d[i], d[:, i] = far, far
        d[j], d[:, j], d[i, i] = np.inf, np.inf, np.inf
    return next(iter(parts.values()))
