"""Detection, totals, normalisation, quality control and sums over groups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..bundle import Bundle, number_of
from ..functions.quantiles import quantiles
from ..functions.relational import written
from .retrieve import select_cells, select_features, subset


def nexprs(bundle: Bundle, by: str = "cell", detection_limit: float = 0, features=None, cells=None, assay_type: str = "counts") -> DataFrame:
    """Detected features per cell, or detected cells per feature: (id, n). Strictly above the limit.

    Ids without a stored row come out with 0; below a limit of 0 absent values are detected too.
    """
    key, other = ("cell_id", "feature_id") if by == "cell" else ("feature_id", "cell_id")
    a = subset(bundle, bundle.need(assay_type), features, cells)
    hit = a.groupBy(key).agg(F.count_if(F.col("value") > detection_limit).alias("_hit"), F.count(F.lit(1)).alias("_rows"))
    f = select_features(bundle, features).select("feature_id").distinct()
    c = select_cells(bundle, cells).select("cell_id")
    ids, others = (c, f) if by == "cell" else (f, c)
    n = F.coalesce("_hit", F.lit(0))
    if detection_limit < 0:
        n = n + number_of(others) - F.coalesce("_rows", F.lit(0))
    return ids.join(hit, key, "left").select(key, n.cast("long").alias("n"))


def totals(assay: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """(key, total) for every id, 0 where nothing is stored."""
    t = assay.groupBy(key).agg(F.sum("value").alias("total"))
    return ids.select(key).join(t, key, "left").withColumn("total", F.coalesce("total", F.lit(0.0)))


def feature_variance(assay: DataFrame, features: DataFrame, n_cells) -> DataFrame:
    """(feature_id, mean, variance) with n - 1 below, absent values counting as 0.

    Sums of squares about a first mean, so that large values do not cancel.
    """
    m = assay.groupBy("feature_id").agg(F.count(F.lit(1)).alias("_nz"), F.sum("value").alias("_s"), F.var_pop("value").alias("_v"), F.avg("value").alias("_m"))
    n = n_cells if isinstance(n_cells, Column) else F.lit(n_cells)
    mean = F.coalesce(F.col("_s"), F.lit(0.0)) / n
    ss = F.coalesce(F.col("_nz") * (F.col("_v") + (F.col("_m") - mean) * (F.col("_m") - mean)) + (n - F.col("_nz")) * mean * mean, F.lit(0.0))
    return features.select("feature_id", "feature_ord").join(m, "feature_id", "left").select("feature_id", "feature_ord", mean.alias("mean"), F.when(n > 1, ss / (n - 1)).alias("variance"))


def top_features(scores: DataFrame, score: str, n: float | None) -> DataFrame:
    """The ``n`` features of the largest score as (feature_id, ord, score), ties by ``feature_ord``. None means all."""
    if n is not None and n == float("inf"):
        n = None
    ranked = scores.where(F.col(score).isNotNull()).orderBy(F.col(score).desc(), "feature_ord")
    if n is not None:
        ranked = ranked.limit(int(n))
    w = Window.orderBy(F.col(score).desc(), "feature_ord")
    return ranked.withColumn("ord", F.row_number().over(w)).select("feature_id", "ord", score)


# normalisation


def library_size_factors(bundle: Bundle, assay_type: str = "counts", geometric: bool = False) -> DataFrame:
    """(cell_id, size_factor): library size over the mean (or geometric mean) library size."""
    t = totals(bundle.need(assay_type), bundle.cells, "cell_id")
    mean = F.exp(F.avg(F.when(F.col("total") > 0, F.ln("total")))) if geometric else F.avg("total")
    middle = t.agg(mean.alias("m")).scalar()
    return t.select("cell_id", F.try_divide(F.col("total"), middle).alias("size_factor"))


def median_size_factors(bundle: Bundle, assay_type: str = "counts") -> DataFrame:
    """(cell_id, size_factor): median ratio of a cell's values to the feature averages, over 1 on average.

    Features without counts take no part; absent values count as ratio 0 through their frequency.
    """
    a = bundle.need(assay_type)
    avg = a.groupBy("feature_id").agg((F.sum("value") / number_of(bundle.cells)).alias("_avg")).where("_avg > 0")
    ratio = a.join(avg, "feature_id").select("cell_id", (F.col("value") / F.col("_avg")).alias("r"), F.lit(1).cast("long").alias("w"))
    stored = ratio.groupBy("cell_id").agg(F.count(F.lit(1)).alias("_k"))
    zero = bundle.cells.select("cell_id").join(stored, "cell_id", "left")
    zero = zero.select("cell_id", F.lit(0.0).alias("r"), (number_of(avg) - F.coalesce("_k", F.lit(0))).cast("long").alias("w"))
    med = ratio.unionByName(zero).groupBy("cell_id").agg(F.percentile("r", F.lit(0.5), F.col("w")).alias("med"))
    mean = med.agg(F.avg("med")).scalar()
    return med.select("cell_id", F.try_divide(F.col("med"), mean).alias("size_factor"))


def compute_library_factors(bundle: Bundle, assay_type: str = "counts") -> Bundle:
    """Library size factors stored in the cell metadata."""
    return bundle.with_cells(library_size_factors(bundle, assay_type))


def compute_median_factors(bundle: Bundle, assay_type: str = "counts") -> Bundle:
    """Median size factors stored in the cell metadata."""
    return bundle.with_cells(median_size_factors(bundle, assay_type))


def normalize_counts(bundle: Bundle, size_factors: DataFrame | None = None, log: bool = True, pseudo_count: float = 1.0, center: bool = False, assay_type: str = "counts") -> DataFrame:
    """Values over their cell's size factor, as log2(x + pseudo count) with ``log``.

    A factor that is null, zero or negative raises when the query runs. Zeros stay absent (with a
    pseudo count other than 1 the value of an absent row is log2 of it). With ``center`` factors are
    first scaled to mean 1.
    """
    sf = size_factors if size_factors is not None else _stored_factors(bundle, assay_type)
    s = F.col("size_factor")
    if center:
        s = s / sf.agg(F.avg("size_factor")).scalar()
    s = F.when(s > 0, s).otherwise(F.raise_error(F.lit("size factors should be positive")).cast("double"))
    ok = bundle.cells.select("cell_id").join(sf.select("cell_id", "size_factor"), "cell_id", "left").select("cell_id", s.alias("_sf"))
    v = F.col("value") / F.col("_sf")
    return bundle.need(assay_type).join(ok, "cell_id").select("feature_id", "cell_id", (F.log2(v + pseudo_count) if log else v).alias("value"))


def _stored_factors(bundle: Bundle, assay_type: str) -> DataFrame:
    if "size_factor" in bundle.cells.columns:
        return bundle.cells.select("cell_id", "size_factor")
    return library_size_factors(bundle, assay_type)


def log_norm_counts(bundle: Bundle, assay_type: str = "counts", size_factors: DataFrame | None = None) -> Bundle:
    """The bundle with assay ``logcounts``."""
    return bundle.with_assay("logcounts", normalize_counts(bundle, size_factors, assay_type=assay_type))


def calculate_cpm(bundle: Bundle, assay_type: str = "counts") -> DataFrame:
    """Values per million of their cell's total. Totals are summed on the map side and joined; no cell's rows are sorted."""
    a = bundle.need(assay_type)
    t = a.groupBy("cell_id").agg(F.sum("value").alias("_t"))
    return a.join(t, "cell_id").select("feature_id", "cell_id", F.try_divide(F.col("value") * 1e6, F.col("_t")).alias("value"))


def calculate_fpkm(bundle: Bundle, lengths: DataFrame, assay_type: str = "counts") -> DataFrame:
    """Values per million per thousand of feature length; ``lengths``: (feature_id, length). Without a length: null."""
    return calculate_cpm(bundle, assay_type).join(lengths, "feature_id", "left").select("feature_id", "cell_id", F.try_divide(F.col("value") * 1000, F.col("length")).alias("value"))


def calculate_tpm(bundle: Bundle, lengths: DataFrame, assay_type: str = "counts") -> DataFrame:
    """Length-scaled values, brought to a million per cell."""
    a = bundle.need(assay_type).join(lengths, "feature_id", "left")
    a = a.select("feature_id", "cell_id", F.try_divide(F.col("value"), F.col("length")).alias("r"))
    t = a.groupBy("cell_id").agg(F.sum("r").alias("_t"))
    return a.join(t, "cell_id").select("feature_id", "cell_id", F.try_divide(F.col("r") * 1e6, F.col("_t")).alias("value"))


def calculate_average(bundle: Bundle, size_factors: DataFrame | None = None, assay_type: str = "counts") -> DataFrame:
    """(feature_id, average): mean over all cells of the value over the centred size factor."""
    v = normalize_counts(bundle, size_factors, log=False, center=True, assay_type=assay_type)
    s = v.groupBy("feature_id").agg(F.sum("value").alias("_s"))
    n = number_of(bundle.cells)
    return bundle.features.select("feature_id").join(s, "feature_id", "left").select("feature_id", (F.coalesce("_s", F.lit(0.0)) / n).alias("average"))


# quality control


def top_cumprop(bundle: Bundle, positions: Sequence[int], assay_type: str = "counts") -> DataFrame:
    """(cell_id, position, pct): share of a cell's total in its ``position`` largest values, 0 to 100.

    Positions beyond the stored values repeat the last share, positions are sorted; cells without counts have null.
    """
    pos = sorted({int(p) for p in positions})
    a = bundle.need(assay_type)
    per = a.groupBy("cell_id").agg(F.sum("value").alias("_t"), F.sort_array(F.collect_list("value"), asc=False).alias("_v"))
    shares = F.transform(F.array(*[F.lit(p) for p in pos]), lambda p: F.struct(p.alias("position"), F.try_divide(F.aggregate(F.slice("_v", 1, p), F.lit(0.0), lambda s, x: s + x) * 100, F.col("_t")).alias("pct")))
    got = bundle.cells.select("cell_id").join(per, "cell_id", "left")
    empty = F.transform(F.array(*[F.lit(p) for p in pos]), lambda p: F.struct(p.alias("position"), F.lit(None).cast("double").alias("pct")))
    return got.select("cell_id", F.explode(F.when(F.col("_t").isNull(), empty).otherwise(shares)).alias("s")).select("cell_id", "s.position", "s.pct")


def cumulative_shares(bundle: Bundle, n: int, assay_type: str = "counts") -> DataFrame:
    """(cell_id, position, pct) for positions 1 to ``n``: one running sum over each cell's sorted values."""
    a = bundle.need(assay_type)
    per = a.groupBy("cell_id").agg(F.sum("value").alias("_t"), F.slice(F.sort_array(F.collect_list("value"), asc=False), 1, n).alias("_v"))
    w = Window.partitionBy("cell_id").orderBy("position")
    long = per.select("cell_id", "_t", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("position"), "_v").select("cell_id", "_t", "position", F.coalesce(F.get("_v", F.col("position") - 1), F.lit(0.0)).alias("x"))
    return long.select("cell_id", "position", F.try_divide(F.sum("x").over(w.rowsBetween(Window.unboundedPreceding, 0)) * 100, F.col("_t")).alias("pct"))


def per_cell_qc(bundle: Bundle, subsets: Mapping[str, object] | None = None, top: Sequence[int] = (), detection_limit: float = 0, assay_type: str = "counts", use_altexps: Sequence[str] = ()) -> DataFrame:
    """Per cell: ``sum``, ``detected``, ``percent_top_k``, ``subsets_S_sum/detected/percent``, ``altexps_A_...`` and ``total``.

    One pass over the assay: subset membership is a set of flags on the features.
    """
    a = bundle.need(assay_type)
    aggs = [F.sum("value").alias("sum"), F.count_if(F.col("value") > detection_limit).alias("detected")]
    for name, which in (subsets or {}).items():
        flag = select_features(bundle, which).select("feature_id").distinct().withColumn(f"_in_{name}", F.lit(True))
        a = a.join(flag, "feature_id", "left")
        inside = F.col(f"_in_{name}").isNotNull()
        aggs += [F.sum(F.when(inside, F.col("value")).otherwise(0.0)).alias(f"subsets_{name}_sum"), F.count_if(inside & (F.col("value") > detection_limit)).alias(f"subsets_{name}_detected")]
    if top:
        aggs.append(F.slice(F.sort_array(F.collect_list("value"), asc=False), 1, max(top)).alias("_v"))
    got = a.groupBy("cell_id").agg(*aggs)
    out = bundle.cells.select("cell_id").join(got, "cell_id", "left")
    numbers = ["sum", "detected", *[f"subsets_{s}_{k}" for s in (subsets or {}) for k in ("sum", "detected")]]
    out = out.fillna(0, numbers)
    for k in top:
        out = out.withColumn(f"percent_top_{k}", F.try_divide(F.aggregate(F.slice("_v", 1, k), F.lit(0.0), lambda s, x: s + x) * 100, F.col("sum")))
    for name in subsets or {}:
        out = out.withColumn(f"subsets_{name}_percent", F.try_divide(F.col(f"subsets_{name}_sum") * 100, F.col("sum")))
    total = F.col("sum")
    for name in use_altexps:
        alt = per_cell_qc(bundle.alts[name], detection_limit=detection_limit, assay_type=assay_type)
        out = out.join(alt.select("cell_id", F.col("sum").alias(f"altexps_{name}_sum"), F.col("detected").alias(f"altexps_{name}_detected")), "cell_id", "left")
        total = total + F.coalesce(F.col(f"altexps_{name}_sum"), F.lit(0.0))
    out = out.withColumn("total", total)
    for name in use_altexps:
        out = out.withColumn(f"altexps_{name}_percent", F.try_divide(F.col(f"altexps_{name}_sum") * 100, F.col("total")))
    return out.drop("_v")


def per_feature_qc(bundle: Bundle, detection_limit: float = 0, assay_type: str = "counts") -> DataFrame:
    """Per feature: ``mean`` over all cells and the percentage of cells it is ``detected`` in."""
    s = bundle.need(assay_type).groupBy("feature_id").agg(F.sum("value").alias("_s"), F.count_if(F.col("value") > detection_limit).alias("_d"))
    n = number_of(bundle.cells)
    return bundle.features.select("feature_id").join(s, "feature_id", "left").select(
        "feature_id", F.try_divide(F.coalesce("_s", F.lit(0.0)), n).alias("mean"), F.try_divide(F.coalesce("_d", F.lit(0)) * 100.0, n).alias("detected")
    )


def add_per_cell_qc(bundle: Bundle, **kw) -> Bundle:
    """The bundle with :func:`per_cell_qc` in its cell metadata."""
    return bundle.with_cells(per_cell_qc(bundle, **kw))


def add_per_feature_qc(bundle: Bundle, **kw) -> Bundle:
    """The bundle with :func:`per_feature_qc` in its feature metadata."""
    return bundle.with_features(per_feature_qc(bundle, **kw))


def is_outlier(df: DataFrame, metric: str, key: str = "cell_id", nmads: float = 3, type: str = "both", log: bool = False, batch: str | None = None) -> DataFrame:
    """(key, lower, higher, outlier): values more than ``nmads`` scaled MADs from the median, per batch.

    Medians and MADs are exact and never gathered in one task, taken over the non-null values of each batch (a null batch is a batch of
    its own); bounds come back on the original scale. A null value is no outlier. The scale 1.4826 makes
    the MAD estimate a standard deviation.
    """
    if type not in ("both", "lower", "higher"):
        raise ValueError("type is both, lower or higher")
    v = F.log2(metric) if log else F.col(metric).cast("double")
    d = df.select(key, v.alias("_v"), (F.col(batch) if batch else F.lit(1)).alias("_b"))
    fine = F.col("value").isNotNull() & ~F.isnan("value")
    freq = lambda x: x.where(fine).groupBy("_b", "value").agg(F.count(F.lit(1)).alias("n"))
    med = quantiles(freq(d.select("_b", F.col("_v").alias("value"))), ["_b"], {"_med": 0.5}).select("_b", "_med")
    same = F.col("d._b").eqNullSafe(F.col("m._b"))
    off = d.alias("d").join(med.alias("m"), same).select("d._b", F.abs(F.col("_v") - F.col("_med")).alias("value"))
    mad = quantiles(freq(off), ["_b"], {"_mad": 0.5}).select(F.col("_b").alias("_c"), (F.col("_mad") * 1.4826).alias("_mad"))
    mad = med.join(mad, F.col("_b").eqNullSafe(F.col("_c")), "left").select("_b", "_med", "_mad")
    lo, hi = F.col("_med") - F.lit(float(nmads)) * F.col("_mad"), F.col("_med") + F.lit(float(nmads)) * F.col("_mad")
    lo = F.lit(float("-inf")) if type == "higher" else lo
    hi = F.lit(float("inf")) if type == "lower" else hi
    back = (lambda c: F.pow(F.lit(2.0), c)) if log else (lambda c: c)
    j = d.alias("d").join(mad.alias("m"), same, "left")
    out = F.coalesce((F.col("_v") < lo) | (F.col("_v") > hi), F.lit(False))
    return j.select(key, back(lo).alias("lower"), back(hi).alias("higher"), out.alias("outlier"))


def quick_per_cell_qc(qc: DataFrame, percent_columns: Sequence[str] = (), nmads: float = 3, batch: str | None = None) -> DataFrame:
    """Per cell the flags ``low_lib_size``, ``low_n_features``, ``high_<percent>`` and their disjunction ``discard``."""
    qc = written(qc, "qc")  # gone over for every metric
    out = qc.select("cell_id")
    flags = []
    for name, metric, type_, log in [("low_lib_size", "sum", "lower", True), ("low_n_features", "detected", "lower", True), *[(f"high_{c}", c, "higher", False) for c in percent_columns]]:
        f = is_outlier(qc, metric, nmads=nmads, type=type_, log=log, batch=batch)
        out = out.join(f.select("cell_id", F.col("outlier").alias(name)), "cell_id")
        flags.append(F.col(name))
    any_ = flags[0]
    for f in flags[1:]:
        any_ = any_ | f
    return out.withColumn("discard", any_)


# sums over groups


def sum_across_cells(bundle: Bundle, groups: Sequence[str], assay_type: str = "counts", average: bool = False, detection_limit: float | None = None) -> DataFrame:
    """Per feature and combination of ``groups`` (cell metadata): ``value`` and the number of cells ``ncells``.

    Stored combinations only, an absent one is 0. Cells with a null group take no part. With
    ``detection_limit`` detected cells are counted instead of summing.
    """
    g = list(groups)
    c = bundle.cells.select("cell_id", *g).dropna(subset=g)
    n = c.groupBy(*g).agg(F.count(F.lit(1)).alias("ncells"))
    v = F.sum("value") if detection_limit is None else F.count_if(F.col("value") > detection_limit)
    s = bundle.need(assay_type).join(c, "cell_id").groupBy("feature_id", *g).agg(v.alias("value"))
    out = s.join(n, g)
    return out.withColumn("value", F.col("value") / F.col("ncells")) if average else out


def num_detected_across_cells(bundle: Bundle, groups: Sequence[str], detection_limit: float = 0, assay_type: str = "counts", average: bool = False) -> DataFrame:
    """Per feature and group of cells, how many cells detect it."""
    return sum_across_cells(bundle, groups, assay_type, average, detection_limit)


def sum_across_features(bundle: Bundle, sets: DataFrame, assay_type: str = "counts", average: bool = False, detection_limit: float | None = None) -> DataFrame:
    """Per set and cell the sum of the set's features; ``sets``: (set_id, feature_id), sets may overlap."""
    m = sets.select("set_id", "feature_id").where("set_id IS NOT NULL").distinct()
    v = F.sum("value") if detection_limit is None else F.count_if(F.col("value") > detection_limit)
    out = bundle.need(assay_type).join(m, "feature_id").groupBy("set_id", "cell_id").agg(v.alias("value"))
    if average:
        k = m.groupBy("set_id").agg(F.count(F.lit(1)).alias("_k"))
        out = out.join(k, "set_id").select("set_id", "cell_id", (F.col("value") / F.col("_k")).alias("value"))
    return out


def num_detected_across_features(bundle: Bundle, sets: DataFrame, detection_limit: float = 0, assay_type: str = "counts") -> DataFrame:
    """Per set and cell, how many of the set's features are detected."""
    return sum_across_features(bundle, sets, assay_type, detection_limit=detection_limit)


def aggregate_across_cells(bundle: Bundle, groups: Sequence[str], assay_type: str = "counts") -> Bundle:
    """A bundle whose cells are the groups: summed counts, mean embeddings, metadata that a group agrees on."""
    g = list(groups)
    c = bundle.cells.dropna(subset=g)
    gid = F.concat_ws("|", *[F.col(x).cast("string") for x in g])
    rest = [x for x in c.columns if x not in {*g, "cell_id", "cell_ord"}]
    same = [F.when(F.count_distinct(F.col(x)) == 1, F.min(x)).alias(x) for x in rest]
    cells = c.groupBy(*g).agg(F.count(F.lit(1)).alias("ncells"), F.min("cell_ord").alias("cell_ord"), *same).withColumn("cell_id", gid)
    key = c.select("cell_id", gid.alias("_g"))
    a = bundle.need(assay_type).join(key, "cell_id").groupBy("feature_id", F.col("_g").alias("cell_id")).agg(F.sum("value").alias("value"))
    reduced = {}
    for name, r in bundle.reduced.items():
        per = r.join(key, "cell_id").select("_g", F.posexplode("coords").alias("i", "x")).groupBy("_g", "i").agg(F.avg("x").alias("x"))
        reduced[name] = per.groupBy(F.col("_g").alias("cell_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("coords"))
    return Bundle(bundle.features, cells, {assay_type: a}, reduced, levels=bundle.levels)


def aggregate_across_features(bundle: Bundle, group: str, assay_type: str = "counts") -> Bundle:
    """A bundle whose features are the values of a feature metadata column, counts summed."""
    f = bundle.features.where(F.col(group).isNotNull())
    a = bundle.need(assay_type).join(f.select("feature_id", F.col(group).alias("_g")), "feature_id").groupBy(F.col("_g").alias("feature_id"), "cell_id").agg(F.sum("value").alias("value"))
    new = f.groupBy(F.col(group).alias("feature_id")).agg(F.min("feature_ord").alias("feature_ord"), F.count(F.lit(1)).alias("nfeatures"))
    return Bundle(new, bundle.cells, {assay_type: a}, bundle.reduced, bundle.attrs, levels=bundle.levels)


def uniquify_feature_names(features: DataFrame, names: str) -> DataFrame:
    """(feature_id, unique_name): the name if it is there and unique, name_id if it is not unique, else the id."""
    w = Window.partitionBy(names)
    n = F.count(F.lit(1)).over(w)
    i = F.col("feature_id").cast("string")
    return features.select("feature_id", F.when(F.col(names).isNull(), i).when(n > 1, F.concat(F.col(names), F.lit("_"), i)).otherwise(F.col(names)).alias("unique_name"))
