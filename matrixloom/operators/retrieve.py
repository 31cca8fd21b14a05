"""Selectors and keyword lookup of per-cell and per-feature values."""

from __future__ import annotations

import warnings
from collections.abc import Mapping, Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..bundle import Bundle, dense


def select_features(bundle: Bundle, which, alias: str | None = None) -> DataFrame:
    """A checked selector as (feature_id, ord), in the order given.

    Names must exist, numbers must be whole, above 0 and at most the number of features, booleans must
    be as many as there are features; None selects all, a boolean Column those it holds for. ``alias``
    names a metadata column to take names from; the first match wins.
    """
    f = bundle.features
    ids = f.schema["feature_id"].dataType
    if alias is not None:
        f = swap_names(f, alias)
    if which is None:
        return f.select("feature_id", F.col("feature_ord").alias("ord"))
    if isinstance(which, Column):
        return f.where(F.coalesce(which, F.lit(False))).select("feature_id", F.col("feature_ord").alias("ord"))
    if isinstance(which, DataFrame):
        return which.select("feature_id", "ord")
    which = list(which)
    spark = f.sparkSession
    rank = F.row_number().over(Window.orderBy("feature_ord"))
    if which and all(isinstance(x, bool) for x in which):
        n = f.count()
        if len(which) != n:
            raise ValueError(f"a boolean selector needs {n} values, not {len(which)}")
        which = [i + 1 for i, x in enumerate(which) if x]
        return _by_rank(spark, f, which, rank)
    if which and all(isinstance(x, int) for x in which) and (not _numeric(ids) or alias is not None):
        n = f.count()
        if any(x < 1 or x > n for x in which):
            raise ValueError(f"feature numbers must lie between 1 and {n}")
        return _by_rank(spark, f, which, rank)
    if any(isinstance(x, float) and x != int(x) for x in which):
        raise ValueError("feature numbers must be whole")
    name = "_name" if alias is not None else "feature_id"
    kind = f.schema[name].dataType
    wanted = spark.createDataFrame([(x, i + 1) for i, x in enumerate(which)], f"_w {kind.simpleString()}, ord int")
    found = wanted.join(f.groupBy(F.col(name).alias("_w")).agg(F.min_by("feature_id", "feature_ord").alias("feature_id")), "_w", "left")
    missing = [r[0] for r in found.where("feature_id IS NULL").select("_w").limit(5).collect()]
    if missing:
        raise KeyError(f"no features named {missing}")
    return found.select("feature_id", "ord")


def _numeric(t) -> bool:
    return t.simpleString() in ("int", "bigint", "smallint", "tinyint")


def _by_rank(spark, f: DataFrame, which: list[int], rank: Column) -> DataFrame:
    order = spark.createDataFrame([(x, i + 1) for i, x in enumerate(which)], "_r int, ord int")
    return f.select("feature_id", rank.alias("_r")).join(F.broadcast(order), "_r").select("feature_id", "ord")


def swap_names(features: DataFrame, column: str) -> DataFrame:
    """Features with ``_name`` from a metadata column."""
    if column not in features.columns:
        raise KeyError(f"Cannot find column {column!r} in the feature metadata")
    return features.withColumn("_name", F.col(column))


def renamed(df: DataFrame, bundle: Bundle, column: str | None, name: str = "Feature") -> DataFrame:
    """Features of a frame named by a column of their metadata instead of their id."""
    if column is None:
        return df
    names = swap_names(bundle.features, column).select(F.col("feature_id").alias(name), "_name")
    return df.join(names, name).drop(name).withColumnRenamed("_name", name)


def subset(bundle: Bundle, assay: DataFrame, features=None, cells: Column | Sequence | None = None) -> DataFrame:
    """The stored rows of the selected features and cells."""
    if features is not None:
        assay = assay.join(select_features(bundle, features).select("feature_id").distinct(), "feature_id", "left_semi")
    if cells is not None:
        assay = assay.join(select_cells(bundle, cells).select("cell_id"), "cell_id", "left_semi")
    return assay


def select_cells(bundle: Bundle, which: Column | Sequence | None) -> DataFrame:
    """The selected rows of the cell metadata: all, those a Column holds for, or those of given ids."""
    c = bundle.cells
    if which is None:
        return c
    if isinstance(which, Column):
        return c.where(F.coalesce(which, F.lit(False)))
    return c.where(F.col("cell_id").isin(list(which)))


def retrieve_cell_info(
    bundle: Bundle, by, search: Sequence[str] = ("colData", "assays", "altExps"), assay_type: str = "logcounts", swap_rownames: str | None = None
) -> tuple[str | None, DataFrame | None]:
    """The values of a keyword for every cell: (name, DataFrame of cell_id, value).

    None gives (None, None); a Column or a (cell_id, value) DataFrame is taken as it is, under the name ``""``
    or its column's name; a string is looked up in the places of ``search`` in their order, and the first that
    has it wins: a metadata column, a feature of the assay, a feature of an alternative experiment.
    """
    if by is None:
        return None, None
    if isinstance(by, Column):
        return "", bundle.cells.select("cell_id", by.alias("value"))
    if isinstance(by, DataFrame):
        name = next(c for c in by.columns if c != "cell_id")
        return name, by.select("cell_id", F.col(name).alias("value"))
    for place in search:
        if place == "colData" and by in bundle.cells.columns:
            return str(by), bundle.cells.select("cell_id", F.col(by).alias("value"))
        sources = [bundle] if place == "assays" else list(bundle.alts.values()) if place == "altExps" else []
        for b in sources:
            name = swap_rownames if place == "assays" else None
            f = swap_names(b.features, name) if name else b.features.withColumn("_name", F.col("feature_id"))
            hit = f.where(F.col("_name").cast("string") == str(by)).orderBy("feature_ord").select("feature_id").limit(1).collect()
            a = b.assay(assay_type)
            if hit and a is not None:
                values = a.where(F.col("feature_id") == F.lit(hit[0][0])).select("cell_id", "value")
                full = bundle.cells.select("cell_id").join(values, "cell_id", "left")
                return str(by), full.withColumn("value", F.coalesce("value", F.lit(0.0)))
    raise KeyError(f"cannot find {by!r}")


def retrieve_feature_info(bundle: Bundle, by, search: Sequence[str] = ("rowData", "assays"), assay_type: str = "logcounts") -> tuple[str | None, DataFrame | None]:
    """The values of a keyword for every feature: (name, DataFrame of feature_id, value); assays are searched by cell."""
    if by is None:
        return None, None
    if isinstance(by, Column):
        return "", bundle.features.select("feature_id", by.alias("value"))
    if isinstance(by, DataFrame):
        name = next(c for c in by.columns if c != "feature_id")
        return name, by.select("feature_id", F.col(name).alias("value"))
    for place in search:
        if place == "rowData" and by in bundle.features.columns:
            return str(by), bundle.features.select("feature_id", F.col(by).alias("value"))
        a = bundle.assay(assay_type)
        if place == "assays" and a is not None and bundle.cells.where(F.col("cell_id").cast("string") == str(by)).limit(1).count():
            values = a.where(F.col("cell_id").cast("string") == str(by)).select("feature_id", "value")
            full = bundle.features.select("feature_id").join(values, "feature_id", "left")
            return str(by), full.withColumn("value", F.coalesce("value", F.lit(0.0)))
    raise KeyError(f"cannot find {by!r}")


def factor_levels(df: DataFrame, column: str, most: int | None = None, what: str = "levels") -> list:
    """The distinct non-null values of a column, sorted; an error beyond ``most`` of them."""
    limit = (most or 10_000) + 1
    rows = [r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().limit(limit).collect()]
    if len(rows) >= limit:
        raise ValueError(f"too many {what} in {column!r}: more than {limit - 1}")
    return sorted(rows)


def attach(df: DataFrame, key: str, name: str, values: DataFrame) -> DataFrame:
    """A column attached by key; a name already taken gives a warning and is not added."""
    if name in df.columns:
        warnings.warn(f"not adding {name!r}: the frame has such a column", stacklevel=2)
        return df
    return df.join(values.select(key, F.col("value").alias(name)), key, "left")


def annotate_features(features: DataFrame, annotation: DataFrame, ids: str, id_column: str, order: str) -> DataFrame:
    """Features with the columns of a reference table; of several matches the first by ``order`` counts.

    One row per feature comes out; features without a match have nulls.
    """
    w = Window.partitionBy(id_column).orderBy(order)
    first = annotation.withColumn("_i", F.row_number().over(w)).where("_i = 1").drop("_i", order)
    clash = [c for c in first.columns if c in features.columns and c != id_column]
    if clash:
        warnings.warn(f"replacing the columns {clash}", stacklevel=2)
    first = first.withColumnRenamed(id_column, "_id")
    return features.drop(*clash).join(first, F.col(ids) == F.col("_id"), "left").drop("_id")


def append_annotation(bundle: Bundle, annotation: DataFrame, ids: str, id_column: str, order: str) -> Bundle:
    """The bundle with :func:`annotate_features` in its feature metadata."""
    return replace(bundle, features=annotate_features(bundle.features, annotation, ids, id_column, order))


def names_in_use(*mappings: Mapping[str, str]) -> list[str]:
    """The column names that plot mappings (aesthetic to name) refer to, each once."""
    return list(dict.fromkeys(str(n) for m in mappings for n in m.values()))


def cells_for_mapping(bundle: Bundle, mapping: Mapping[str, str], assay_type: str = "logcounts", use_altexps: Sequence[str] = ()) -> DataFrame:
    """:func:`per_cell_frame` cut to what a mapping uses: only its metadata, embeddings and features are read."""
    names = names_in_use(mapping)
    dims = [d for d in bundle.reduced if any(n.startswith(f"{d}.") for n in names)]
    stored = {*bundle.cells.columns, *[n for n in names for d in dims if n.startswith(f"{d}.")]}
    out = per_cell_frame(bundle, [n for n in names if n not in stored], assay_type, dims, use_altexps)
    return out.select("cell_id", *[F.col(f"`{n}`") for n in names if n != "cell_id"])


def per_cell_frame(bundle: Bundle, features=(), assay_type: str = "logcounts", use_dimred: Sequence[str] | None = None, use_altexps: Sequence[str] = (), prefix_altexps: bool = False) -> DataFrame:
    """One wide row per cell: metadata, embedding columns ``NAME.i`` and the requested features.

    Features are looked up in the main experiment, then in ``use_altexps``; names taken by metadata are
    not added again.
    """
    out = bundle.cells
    for name in bundle.reduced if use_dimred is None else use_dimred:
        r = bundle.reduced[name]
        first = r.select(F.size("coords")).first()
        d = first[0] if first else 0
        out = out.join(r.select("cell_id", *[F.get("coords", F.lit(i)).alias(f"{name}.{i + 1}") for i in range(d)]), "cell_id", "left")
    left = list(features)
    for prefix, b in [("", bundle), *[(f"{a}." if prefix_altexps else "", bundle.alts[a]) for a in use_altexps]]:
        names = [r[0] for r in b.features.where(F.col("feature_id").cast("string").isin([str(x) for x in left])).select("feature_id").collect()]
        a = b.assay(assay_type)
        new = [n for n in names if f"{prefix}{n}" not in out.columns]
        if new and a is not None:
            sums = [F.coalesce(F.sum(F.when(F.col("feature_id") == F.lit(n), F.col("value"))), F.lit(0.0)).alias(f"{prefix}{n}") for n in new]
            wide = a.where(F.col("feature_id").isin(new)).groupBy("cell_id").agg(*sums)
            out = out.join(wide, "cell_id", "left").fillna(0.0, [f"{prefix}{n}" for n in new])
        left = [x for x in left if str(x) not in {str(n) for n in names}]
    if left:
        raise KeyError(f"cannot find {left}")
    return out


def per_feature_frame(bundle: Bundle, cells: Sequence = (), assay_type: str = "logcounts") -> DataFrame:
    """One wide row per feature: metadata and the values of the requested cells."""
    out = bundle.features
    known = {r[0] for r in bundle.cells.where(F.col("cell_id").isin(list(cells))).select("cell_id").collect()}
    if missing := [c for c in cells if c not in known]:
        raise KeyError(f"cannot find {missing}")
    new = [c for c in cells if str(c) not in out.columns]
    if new:
        sums = [F.coalesce(F.sum(F.when(F.col("cell_id") == F.lit(c), F.col("value"))), F.lit(0.0)).alias(str(c)) for c in new]
        wide = bundle.need(assay_type).where(F.col("cell_id").isin(new)).groupBy("feature_id").agg(*sums)
        out = out.join(wide, "feature_id", "left").fillna(0.0, [str(c) for c in new])
    return out


def dimensions(reduced: DataFrame, n_dimred: int | Sequence[int] | None = None) -> DataFrame:
    """An embedding cut to its first ``n_dimred`` dimensions, or to those listed (from 1)."""
    if n_dimred is None:
        return reduced
    if isinstance(n_dimred, int):
        return reduced.withColumn("coords", F.slice("coords", 1, n_dimred))
    return reduced.withColumn("coords", F.array(*[F.get("coords", F.lit(i - 1)) for i in n_dimred]))


def expression_long(bundle: Bundle, features, assay_type: str = "logcounts", log2_values: bool = False, cells: Column | None = None) -> DataFrame:
    """(cell_id, Feature, value) of the selected features for every cell, zeros included."""
    if assay_type == "exprs" and bundle.assay("exprs") is None:
        assay_type = "logcounts"
    d = dense(bundle.need(assay_type), select_features(bundle, features), select_cells(bundle, cells))
    v = F.log2(F.col("value") + 1) if log2_values else F.col("value")
    return d.select("cell_id", F.col("feature_id").alias("Feature"), "ord", v.alias("value"))
