"""The data frames behind the diagnostic plots; drawing itself is out of scope."""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..bundle import Bundle, dense, number_of
from ..functions.quantiles import quantiles
from ..functions.relational import ranked, written
from .counts import cumulative_shares, top_features, totals
from .grouped import bin2d, contingency, density, scale_rows
from .retrieve import attach, expression_long, factor_levels, renamed, retrieve_cell_info, retrieve_feature_info, select_cells, select_features

SHAPE_LEVELS = 10


def _visuals(df: DataFrame, key: str, retrieve, colour_by=None, shape_by=None, size_by=None, order_by=None, other_fields: Sequence = ()) -> DataFrame:
    for name, by in (("colour_by", colour_by), ("shape_by", shape_by), ("size_by", size_by), ("order_by", order_by)):
        if by is not None:
            _, values = retrieve(by)
            if name == "shape_by":
                factor_levels(values, "value", SHAPE_LEVELS, "levels for shapes")
            df = attach(df, key, name, values)
    for by in other_fields:
        label, values = retrieve(by)
        df = attach(df, key, label, values)
    return df


def col_data(bundle: Bundle, y, x=None, assay_type: str = "logcounts", swap_rownames: str | None = None, **visuals) -> DataFrame:
    """Per cell ``Y``, ``X`` (from the cell metadata only) and the attributes asked for by keyword.

    With ``swap_rownames`` features are looked up by that column of their metadata.
    """
    _, yv = retrieve_cell_info(bundle, y, ("colData",))
    df = yv.withColumnRenamed("value", "Y")
    if x is not None:
        df = df.join(retrieve_cell_info(bundle, x, ("colData",))[1].withColumnRenamed("value", "X"), "cell_id")
    return _visuals(df, "cell_id", lambda by: retrieve_cell_info(bundle, by, assay_type=assay_type, swap_rownames=swap_rownames), **visuals)


def row_data(bundle: Bundle, y, x=None, assay_type: str = "logcounts", **visuals) -> DataFrame:
    """Per feature ``Y``, ``X`` (from the feature metadata only) and the attributes asked for."""
    df = retrieve_feature_info(bundle, y, ("rowData",))[1].withColumnRenamed("value", "Y")
    if x is not None:
        df = df.join(retrieve_feature_info(bundle, x, ("rowData",))[1].withColumnRenamed("value", "X"), "feature_id")
    return _visuals(df, "feature_id", lambda by: retrieve_feature_info(bundle, by, assay_type=assay_type), **visuals)


def expression(bundle: Bundle, features, x=None, log2_values: bool = False, assay_type: str = "logcounts", swap_rownames: str | None = None, **visuals) -> DataFrame:
    """(cell_id, Feature, Y[, X, ...]): one row per selected feature and cell.

    With ``swap_rownames`` features are selected, looked up and named by that column of their metadata.
    """
    lookup = lambda by: retrieve_cell_info(bundle, by, assay_type=assay_type, swap_rownames=swap_rownames)
    df = expression_long(bundle, select_features(bundle, features, swap_rownames), assay_type, log2_values).withColumnRenamed("value", "Y").drop("ord")
    df = renamed(df, bundle, swap_rownames)
    if x is not None:
        df = df.join(lookup(x)[1].withColumnRenamed("value", "X"), "cell_id", "left")
    return _visuals(df, "cell_id", lookup, **visuals)


def plot_kind(df: DataFrame) -> str:
    """``violin`` with one numeric axis (``violin_flipped`` if it is X), ``scatter`` with two, ``rectangles`` with none."""
    num = [c in df.columns and isinstance(df.schema[c].dataType, T.NumericType) for c in ("X", "Y")]
    if all(num):
        return "scatter"
    return "violin" if num[1] else "violin_flipped" if num[0] else "rectangles"


def central(df: DataFrame, bins: int | None = None, summary="sum", seed: int = 1) -> tuple[str, DataFrame]:
    """The plot kind and its layer: bins' counts or summaries, or the points.

    Points of a contingency plot come with the ``half_width`` and ``half_height`` of their rectangle, joined by ``X`` and ``Y``, and with
    seeded jitters ``jitter_x`` and ``jitter_y`` within these. Binning needs a numeric colour.
    """
    kind = plot_kind(df)
    if bins:
        if "colour_by" in df.columns and not isinstance(df.schema["colour_by"].dataType, T.NumericType):
            raise ValueError("binning needs a numeric colour")
        return "bins", bin2d(df, "X", "Y", bins, "colour_by" if "colour_by" in df.columns else None, summary)
    if kind != "rectangles":
        return kind, df
    boxes = contingency(df, "X", "Y", factor_levels(df, "X"), factor_levels(df, "Y")).select("X", "Y", "half_width", "half_height")
    points = df.join(F.broadcast(boxes), ["X", "Y"], "left")  # as many as pairs of levels, at most 10,000 each
    key = "cell_id" if "cell_id" in df.columns else "feature_id"
    return kind, points.withColumns({f"jitter_{a}": jitter(F.col(f"half_{side}"), seed + i, key) for i, (a, side) in enumerate((("x", "width"), ("y", "height")))})


def jitter(half: Column, seed: int, *keys: str) -> Column:
    """A number between -half and half that depends on the seed and the keys only."""
    u = F.pmod(F.xxhash64(F.lit(seed), *[F.col(k) for k in keys]), F.lit(1 << 30)) / float(1 << 29) - 1
    return half * u


def highest_exprs(bundle: Bundle, n: int = 50, drop_features=None, as_percentage: bool = True, assay_type: str = "counts", colour_by=None, feature_names: str | None = None) -> DataFrame:
    """(Cell, Tag, value, rank, score) of the ``n`` features of largest total, every cell.

    ``value``: percentage of the cell's total (which still holds dropped features), or the value itself;
    ``score``: percentage of the grand total, or the feature's total. Ties by ``feature_ord``. ``feature_names``: a column of
    the feature metadata that ``Tag`` is taken from.
    """
    a = bundle.need(assay_type)
    t = totals(a, bundle.features, "feature_id").join(bundle.features.select("feature_id", "feature_ord"), "feature_id")
    grand = a.agg(F.sum("value")).scalar()
    if drop_features is not None:
        t = t.join(select_features(bundle, drop_features).select("feature_id"), "feature_id", "left_anti")
    top = top_features(t, "total", n)
    d = dense(a, top, bundle.cells)
    d = d.join(F.broadcast(top.select("feature_id", F.col("total").alias("_total"))), "feature_id")  # n rows
    v, score = F.col("value"), F.col("_total")
    if as_percentage:
        d = d.join(totals(a, bundle.cells, "cell_id"), "cell_id")
        v, score = F.try_divide(F.col("value") * 100, F.col("total")), F.try_divide(F.col("_total") * 100, grand)
    out = d.select(F.col("cell_id").alias("Cell"), F.col("feature_id").alias("Tag"), v.alias("value"), F.col("ord").alias("rank"), score.alias("score"))
    if colour_by is not None:
        values = retrieve_cell_info(bundle, colour_by)[1].withColumnRenamed("cell_id", "Cell")
        out = attach(out, "Cell", "colour_by", values)
    return renamed(out, bundle, feature_names, "Tag")


def library_shares(bundle: Bundle, nfeatures: int = 500, block1: str | None = None, block2: str | None = None, colour_by=None, assay_type: str = "counts") -> DataFrame:
    """(Cell, Feature, Proportion_Library, block1, block2, colour_by): cumulative shares by rank, 0 to 100."""
    d = cumulative_shares(bundle, nfeatures, assay_type)
    for name, by in (("block1", block1), ("block2", block2), ("colour_by", colour_by)):
        if by is not None:
            d = attach(d, "cell_id", name, retrieve_cell_info(bundle, by)[1])
    return d.withColumnRenamed("cell_id", "Cell").withColumnRenamed("position", "Feature").withColumnRenamed("pct", "Proportion_Library")


def _deviations(bundle: Bundle, assay_type: str, logged: bool) -> tuple[DataFrame, DataFrame]:
    """Stored values, and feature medians with zeros counted."""
    a = bundle.need(assay_type).select("feature_id", "cell_id", (F.col("value") if logged else F.log2(F.col("value") + 1)).alias("value"))
    k = a.groupBy("feature_id").agg(F.count(F.lit(1)).alias("_k"))
    zero = bundle.features.select("feature_id").join(k, "feature_id", "left").select("feature_id", F.lit(0.0).alias("value"), (number_of(bundle.cells) - F.coalesce("_k", F.lit(0))).cast("long").alias("w"))
    stored = a.groupBy("feature_id", "value").agg(F.count(F.lit(1)).alias("n"))
    med = quantiles(stored.unionByName(zero.where("w > 0").withColumnRenamed("w", "n")), ["feature_id"], {"med": 0.5})
    return a, med.select("feature_id", "med")


def rle(bundle: Bundle, assay_type: str = "logcounts", logged: bool = True, style: str = "minimal", features=None, ordering=None, colour_by=None) -> DataFrame:
    """Relative log expression: values less their feature's median over all cells.

    ``minimal``: per cell ``q0, q25, q50, q75, q100`` and whiskers ``lower``, ``upper`` within 1.5 IQR; ``full``: one row
    per cell and feature (of ``features``). Zeros are not written out for features with median 0: each
    cell has one row of deviation 0 with their number as frequency; only features with another median
    are completed. ``ordering``, cell ids in the order wanted, keeps these cells and adds their ``place`` (from 1).
    """
    if ordering is not None:
        kind = bundle.cells.schema["cell_id"].dataType.simpleString()
        places = bundle.cells.sparkSession.createDataFrame([(c, i + 1) for i, c in enumerate(ordering)], f"Cell {kind}, place int")
        return rle(bundle, assay_type, logged, style, features, None, colour_by).join(places, "Cell")
    a, med = _deviations(bundle, assay_type, logged)
    med = written(med, "medians")  # one row per feature, used four times
    some = med.where("med <> 0")
    if style == "full":
        f = select_features(bundle, features)
        d = dense(a, f, bundle.cells).join(med, "feature_id")
        return d.select(F.col("cell_id").alias("Cell"), F.col("feature_id").alias("Feature"), (F.col("value") - F.col("med")).alias("Deviation"))
    stored = a.join(med, "feature_id").select("cell_id", "feature_id", (F.col("value") - F.col("med")).alias("dev"), (F.col("med") != 0).alias("_some"))
    per = stored.groupBy("cell_id").agg(F.count_if(~F.col("_some")).alias("_k"), F.collect_set(F.when(F.col("_some"), F.col("feature_id"))).alias("_have"))
    # features with a median other than 0 are stored in over half of all cells, so their list is short next to the data
    ids = some.agg(F.array_agg("feature_id")).scalar()
    cells = bundle.cells.select("cell_id").join(per, "cell_id", "left").withColumn("_have", F.coalesce("_have", F.array().cast(per.schema["_have"].dataType)))
    gap = cells.withColumn("_all", ids).select("cell_id", F.explode(F.array_except("_all", "_have")).alias("feature_id")).join(some, "feature_id")
    gap = gap.select("cell_id", (-F.col("med")).alias("dev"), F.lit(1).cast("long").alias("w"))
    none = cells.select("cell_id", F.lit(0.0).alias("dev"), (number_of(med.where("med = 0")) - F.coalesce("_k", F.lit(0))).cast("long").alias("w"))
    d = stored.select("cell_id", "dev", F.lit(1).cast("long").alias("w")).unionByName(gap).unionByName(none.where("w > 0"))
    q = d.groupBy("cell_id").agg(F.percentile("dev", F.array(*[F.lit(p) for p in (0.0, 0.25, 0.5, 0.75, 1.0)]), F.col("w")).alias("q"))
    names = ["q0", "q25", "q50", "q75", "q100"]
    q = q.select(F.col("cell_id").alias("Cell"), *[F.get("q", F.lit(i)).alias(n) for i, n in enumerate(names)])
    iqr = F.col("q75") - F.col("q25")
    out = q.withColumn("lower", F.greatest(F.col("q0"), F.col("q25") - iqr * 1.5)).withColumn("upper", F.least(F.col("q100"), F.col("q75") + iqr * 1.5))
    if colour_by is not None:
        out = attach(out, "Cell", "colour_by", retrieve_cell_info(bundle, colour_by)[1].withColumnRenamed("cell_id", "Cell"))
    return out


def heatmap(bundle: Bundle, features, cells: Column | None = None, center: bool = False, scale: bool = False, zlim=None, order_columns_by: Sequence[str] = (), assay_type: str = "logcounts", swap_rownames: str | None = None) -> DataFrame:
    """(Feature, Cell, value, row, column): the scaled cells of a heat map, columns ordered by metadata, then ``cell_ord``."""
    c = select_cells(bundle, cells)
    keys = list(dict.fromkeys([*order_columns_by, "cell_ord"]))
    d = dense(bundle.need(assay_type), select_features(bundle, features, swap_rownames), c)
    d = scale_rows(d, "value", center, scale, zlim)
    place = ranked(c.select("cell_id", *keys), keys, "column").select("cell_id", F.col("column").cast("int").alias("column"))
    out = d.join(place, "cell_id").select(F.col("feature_id").alias("Feature"), F.col("cell_id").alias("Cell"), "value", F.col("ord").alias("row"), "column")
    return renamed(out, bundle, swap_rownames)


def heatmap_annotations(bundle: Bundle, features, cells: Column | None = None, colour_columns_by: Sequence = (), colour_rows_by: Sequence = (), assay_type: str = "logcounts", swap_rownames: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The annotation frames beside a heat map: (cell_id, names...) of its columns and (feature_id, names...) of its rows.

    A name used for both warns, as one legend would stand for two things.
    """
    columns = select_cells(bundle, cells).select("cell_id")
    rows = select_features(bundle, features, swap_rownames).select("feature_id")
    used: list[set] = []
    for axis in (0, 1):
        names = set()
        for by in (colour_columns_by, colour_rows_by)[axis]:
            if axis == 0:
                name, values = retrieve_cell_info(bundle, by, assay_type=assay_type, swap_rownames=swap_rownames)
                columns = attach(columns, "cell_id", name, values)
            else:
                name, values = retrieve_feature_info(bundle, by, assay_type=assay_type)
                rows = attach(rows, "feature_id", name, values)
            names.add(name)
        used.append(names)
    if clash := used[0] & used[1]:
        warnings.warn(f"rows and columns are both annotated by {sorted(clash)}", stacklevel=2)
    return columns, rows


def plate_position(cells: DataFrame, well: str | Column, **columns: Column) -> DataFrame:
    """(cell_id, X, Y, y_order, ...): well column number, row letter and its place from Z to A.

    A well must be one capital letter and digits; a malformed one raises when the query runs, a null one gives nulls.
    """
    w = F.col(well) if isinstance(well, str) else well
    ok = F.when(w.isNull() | w.rlike("^[A-Z][0-9]+$"), w).otherwise(F.raise_error(F.concat(F.lit("malformed plate position: "), w)).cast("string"))
    d = cells.select("cell_id", ok.alias("_w"), *[c.alias(n) for n, c in columns.items()])
    y = F.substring("_w", 1, 1)
    return d.select("cell_id", F.regexp_extract("_w", "([0-9]+)$", 1).cast("int").alias("X"), y.alias("Y"), (F.lit(ord("Z")) - F.ascii(y)).alias("y_order"), *columns)


def reduced_dim(bundle: Bundle, dimred: str, ncomponents: int = 2, text_by: str | None = None, percent_var: Sequence[float] | None = None, assay_type: str = "logcounts", swap_rownames: str | None = None, **visuals) -> tuple[DataFrame, DataFrame | None, list[str]]:
    """Points (``X``, ``Y``, ...), label places (median per level) and axis labels with rounded percentages.

    More components than stored are an error; with more than two the first two are the axes.
    """
    r = bundle.reduced[dimred]
    first = r.select(F.size("coords")).first()
    have = first[0] if first else 0
    if ncomponents > have:
        raise ValueError(f"{dimred} has {have} dimensions, not {ncomponents}")
    d = r.select("cell_id", F.get("coords", F.lit(0)).alias("X"), F.get("coords", F.lit(1)).alias("Y"))
    d = _visuals(d, "cell_id", lambda by: retrieve_cell_info(bundle, by, assay_type=assay_type, swap_rownames=swap_rownames), **visuals)
    labels = None
    if text_by is not None:
        t = d.join(retrieve_cell_info(bundle, text_by)[1].withColumnRenamed("value", "label"), "cell_id")
        labels = t.where("label IS NOT NULL").groupBy("label").agg(F.median("X").alias("X"), F.median("Y").alias("Y"))
    pct = percent_var if percent_var is not None else (bundle.attrs.get(dimred) or {}).get("percentVar")
    axes = [f"{dimred} {i + 1}" + (f" ({round(pct[i])}%)" if pct is not None else "") for i in range(ncomponents)]
    return d, labels, axes


def reduced_pairs(reduced: DataFrame, ncomponents: int) -> DataFrame:
    """(cell_id, xvar, yvar, x, y) of all ordered pairs of different dimensions."""
    pairs = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(ncomponents) for j in range(ncomponents) if i != j])
    d = reduced.select("cell_id", "coords", F.explode(pairs).alias("p"))
    return d.select("cell_id", (F.col("p.i") + 1).alias("xvar"), (F.col("p.j") + 1).alias("yvar"), F.get("coords", F.col("p.i")).alias("x"), F.get("coords", F.col("p.j")).alias("y"))


def paired_densities(reduced: DataFrame, ncomponents: int, points: int = 128) -> DataFrame:
    """(dim, x, density): the curves on the diagonal of paired plots, each on the range of its dimension."""
    long = reduced.select("cell_id", F.posexplode(F.slice("coords", 1, ncomponents)).alias("i", "x"))
    out = None
    for i, low, high in long.groupBy("i").agg(F.min("x"), F.max("x")).orderBy("i").collect():
        one = density(long.where(F.col("i") == i), "x", None, float(low), float(high), points).select(F.lit(i + 1).alias("dim"), "x", "density")
        out = one if out is None else out.unionByName(one)
    return out


def _named(name: str):
    def plot(bundle: Bundle, ncomponents: int = 2, **kw):
        return reduced_dim(bundle, name, ncomponents, **kw)

    plot.__doc__ = f"The frame behind a plot of the embedding {name!r}."
    return plot


pca_frame, tsne_frame, umap_frame, mds_frame, nmf_frame, diffusion_map_frame = map(_named, ("PCA", "TSNE", "UMAP", "MDS", "NMF", "DiffusionMap"))
