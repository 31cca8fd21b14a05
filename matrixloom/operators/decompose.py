"""Principal components, metadata components with outliers, classical scaling, non-negative factors."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..bundle import Bundle, number_of
from ..functions.relational import written
from .counts import feature_variance, is_outlier, top_features
from .retrieve import dimensions, select_features

#: Columns of a matrix that is decomposed at most: its Gram matrix is held on the driver.
MOST_COLUMNS = 5_000
#: Rows up to which a general distance matrix is formed on the driver.
MOST_DISTANCE_ROWS = 5_000


class Matrix:
    """Cells as rows of equally long arrays, with the names and variances of the columns."""

    def __init__(self, rows: DataFrame, names: list, variances: np.ndarray | None = None):
        if len(names) > MOST_COLUMNS:
            raise ValueError(f"more than {MOST_COLUMNS} columns")
        self.rows, self.names, self.variances = rows, names, variances


def matrix_from(bundle: Bundle, assay_type: str = "logcounts", ntop: float | None = 500, features=None, scale: bool = False, dimred: str | None = None, n_dimred=None, altexp: str | None = None) -> Matrix:
    """The matrix an embedding works on: an embedding as it is, or the most variable (or given) features.

    Ties of variance go to the smaller ``feature_ord``. ``scale`` drops features of variance below 1e-8 after the
    choice and divides the others by their standard deviation. Absent values are 0.
    """
    if dimred is not None:
        r = dimensions(bundle.reduced[dimred], n_dimred)
        first = r.select(F.size("coords")).first()
        return Matrix(r, [f"{dimred}.{i + 1}" for i in range(first[0] if first else 0)])
    b = bundle.experiment(altexp)
    a = b.need(assay_type)
    var = feature_variance(a, b.features, number_of(bundle.cells))
    if features is not None:
        f = select_features(b, features).join(var.select("feature_id", "variance"), "feature_id")
    else:
        f = top_features(var, "variance", ntop)
    chosen = f.orderBy("ord").limit(MOST_COLUMNS + 1).collect()
    if scale:
        chosen = [r for r in chosen if r["variance"] is not None and r["variance"] >= 1e-8]
    names = [r["feature_id"] for r in chosen]
    sd = [math.sqrt(r["variance"]) if scale else 1.0 for r in chosen]
    v = np.array([1.0 if scale else (r["variance"] or 0.0) for r in chosen])
    if not names:
        return Matrix(bundle.cells.select("cell_id", F.array().cast("array<double>").alias("coords")), [], v)
    spark = a.sparkSession
    kind = b.features.schema["feature_id"].dataType.simpleString()
    index = spark.createDataFrame([(n, i, s) for i, (n, s) in enumerate(zip(names, sd, strict=True))], f"feature_id {kind}, _i int, _sd double")
    stored = a.join(F.broadcast(index), "feature_id")  # MOST_COLUMNS rows at most
    m = stored.groupBy("cell_id").agg(F.map_from_entries(F.collect_list(F.struct("_i", (F.col("value") / F.col("_sd")).alias("v")))).alias("_m"))
    full = F.transform(F.sequence(F.lit(0), F.lit(len(names) - 1)), lambda i: F.coalesce(F.element_at("_m", i), F.lit(0.0)))
    zero = F.array_repeat(F.lit(0.0), len(names))
    rows = bundle.cells.select("cell_id").join(m, "cell_id", "left").select("cell_id", F.when(F.col("_m").isNull(), zero).otherwise(full).alias("coords"))
    return Matrix(rows, names, v)


def _stack(col: pd.Series, d: int) -> np.ndarray:
    return np.stack(col.to_numpy()).astype(float) if len(col) else np.zeros((0, d))


def gram(rows: DataFrame, d: int) -> tuple[int, np.ndarray, np.ndarray]:
    """(rows, column sums, X'X) of an array column: one d x d matrix per partition, added up by rows of it."""

    def part(it):
        n, s, g = 0, np.zeros(d), np.zeros((d, d))
        for pdf in it:
            x = _stack(pdf["coords"], d)
            n, s, g = n + len(x), s + x.sum(0), g + x.T @ x
        yield pd.DataFrame({"i": np.arange(-1, d), "n": n, "v": [s, *g]})

    def add(key, pdf):
        return pd.DataFrame({"i": [key[0]], "n": [pdf["n"].sum()], "v": [np.sum(list(pdf["v"]), 0)]})

    schema = "i int, n long, v array<double>"
    got = rows.select("coords").mapInPandas(part, schema).groupBy("i").applyInPandas(add, schema).toPandas().sort_values("i")
    if not len(got):
        return 0, np.zeros(d), np.zeros((d, d))
    v = list(got["v"])
    return int(got["n"].iloc[0]), np.asarray(v[0]), np.vstack(v[1:]) if d else np.zeros((0, 0))


def project(rows: DataFrame, centre: np.ndarray, loadings: np.ndarray) -> DataFrame:
    """(cell_id, coords) of centred rows times a loading matrix."""
    kind = rows.schema["cell_id"].dataType.simpleString()

    def run(it):
        for pdf in it:
            x = _stack(pdf["coords"], len(centre))
            yield pd.DataFrame({"cell_id": pdf["cell_id"], "coords": list((x - centre) @ loadings)})

    return rows.select("cell_id", "coords").mapInPandas(run, f"cell_id {kind}, coords array<double>")


def pca(m: Matrix, ncomponents: int = 50) -> tuple[DataFrame, dict]:
    """(cell_id, coords) of centred principal components, with ``varExplained``, ``percentVar`` and ``rotation``.

    The covariance matrix of at most 5,000 columns comes from one pass and is decomposed on the driver.
    Signs are fixed: the loading of largest size is positive. ``percentVar`` is of the variance of all columns.
    """
    d = len(m.names)
    n, s, g = gram(m.rows, d)
    k = min(ncomponents, d, max(n, 0))
    if k == 0 or n < 2:
        return m.rows.select("cell_id", F.array().cast("array<double>").alias("coords")), {"varExplained": [], "percentVar": [], "rotation": {}}
    mean = s / n
    cov = (g - n * np.outer(mean, mean)) / (n - 1)
    val, vec = np.linalg.eigh(cov)
    order = np.argsort(val)[::-1][:k]
    val, vec = np.maximum(val[order], 0), vec[:, order]
    vec = vec * np.where(vec[np.abs(vec).argmax(0), np.arange(k)] < 0, -1.0, 1.0)
    total = float(np.trace(cov)) if m.variances is None else float(m.variances.sum())
    attrs = {"varExplained": val.tolist(), "percentVar": (100 * val / total).tolist() if total > 0 else [0.0] * k, "rotation": {name: vec[i].tolist() for i, name in enumerate(m.names)}}
    return project(m.rows, mean, vec), attrs


def calculate_pca(bundle: Bundle, ncomponents: int = 50, **kw) -> tuple[DataFrame, dict]:
    return pca(matrix_from(bundle, **kw), ncomponents)


def run_pca(bundle: Bundle, ncomponents: int = 50, name: str = "PCA", **kw) -> Bundle:
    """The bundle with components stored under ``name``."""
    return bundle.with_reduced(name, *calculate_pca(bundle, ncomponents, **kw))


def run_coldata_pca(bundle: Bundle, variables: Sequence[str], ncomponents: int = 2, scale: bool = True, outliers: bool = False, name: str = "PCA_coldata", nmads: float = 3) -> Bundle:
    """Components of numeric cell metadata; ``percentVar`` is a fraction here. ``outliers`` flags cells in the metadata.

    Rows with a null variable take no part. ``scale`` drops variables of variance below 1e-8. A cell is an outlier if
    the adjusted outlyingness of its component scores lies more than ``nmads`` MADs above the median.
    """
    c = bundle.cells.select("cell_id", *[F.col(v).cast("double").alias(v) for v in variables]).dropna()
    stats = c.agg(*[F.var_samp(v).alias(v) for v in variables]).first()
    kept = [v for v in variables if not scale or (stats[v] or 0) >= 1e-8]
    sd = {v: math.sqrt(stats[v]) if scale else 1.0 for v in kept}
    rows = c.select("cell_id", F.array(*[F.col(v) / sd[v] for v in kept]).alias("coords"))
    m = Matrix(rows, kept, np.array([1.0 if scale else float(stats[v] or 0) for v in kept]))
    coords, attrs = pca(m, ncomponents)
    attrs["percentVar"] = [p / 100 for p in attrs["percentVar"]]
    out = bundle.with_reduced(name, coords, attrs)
    if outliers:
        o = written(adjusted_outlyingness(coords, min(ncomponents, len(kept))), "outlyingness")
        flag = is_outlier(o, "outlyingness", nmads=nmads, type="higher").select("cell_id", "outlier")
        out = out.with_cells(flag.join(o, "cell_id"))
    return out


def medcouple(x: np.ndarray) -> float:
    """Robust skewness: the median of h(a, b) = (a + b) / (a - b) over values a above and b below the median, taken from it.

    As h grows with both, the pairs above a threshold are counted by binary search, and the median is found by
    halving: n log n a step, no pair is formed. Pairs of two values at the median count as 0.
    """
    x = np.sort(x) - np.median(x)
    up, down = x[x >= 0], x[x <= 0]
    pairs = len(up) * len(down)
    a = up[up > 0]
    zeros = (len(up) - len(a)) * int((down == 0).sum())
    flat = (len(up) - len(a)) * int((down < 0).sum())  # a value at the median against one below: -1

    def below(t: float) -> int:
        """Pairs with h < t."""
        n = flat * (t > -1) + zeros * (t > 0)
        if t >= 1:
            return n + len(a) * int((down < 0).sum()) + (len(a) * int((down == 0).sum()) if t > 1 else 0)
        return n + int(np.searchsorted(down, -a * (1 - t) / (1 + t), "left").sum()) if t > -1 else n

    def at(rank: int) -> float:
        lo, hi = -1.0, 1.0 + 1e-15
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if below(mid) <= rank else (lo, mid)
        return lo

    return (at((pairs - 1) // 2) + at(pairs // 2)) / 2


#: Rows that medians, quartiles and skewness of the outlyingness are taken from at most.
MOST_OUTLYING = 5_000


def adjusted_outlyingness(rows: DataFrame, d: int, directions: int | None = None, most: int = MOST_OUTLYING, seed: int = 1) -> DataFrame:
    """(cell_id, outlyingness): the largest skewness-adjusted distance from the median over random directions.

    Directions join two rows; medians, quartiles and medcouples of the projections are those of all rows, or beyond
    ``most`` of them of as many chosen by a hash of their id (ranks then err by about 0.7 % of the rows, one standard error), and every row
    is measured against them in one pass. One column has one direction.
    """
    n = rows.count()
    some = rows if n <= most else rows.where(F.shiftrightunsigned(F.xxhash64("cell_id", F.lit(seed)), 32) < int(most / n * 2**32))
    some = some.toPandas().sort_values("cell_id")
    x = _stack(some["coords"], d)
    rng = np.random.default_rng(seed)
    dirs, med, up, down = [], [], [], []
    for _ in range((directions or (1 if d == 1 else 250 * d)) if len(x) > 1 else 0):
        if d == 1:
            v = np.ones(1)
        else:
            i, j = rng.choice(len(x), 2, replace=False)
            v = x[i] - x[j]
        if not (norm := float(np.linalg.norm(v))):
            continue
        p = x @ (v / norm)
        q1, q2, q3 = np.quantile(p, [0.25, 0.5, 0.75])
        mc, iqr = medcouple(p), q3 - q1
        lo = q1 - 1.5 * math.exp(-4 * mc if mc >= 0 else -3 * mc) * iqr
        hi = q3 + 1.5 * math.exp(3 * mc if mc >= 0 else 4 * mc) * iqr
        if hi > q2 > lo:
            dirs.append(v / norm)
            med.append(q2)
            up.append(hi - q2)
            down.append(q2 - lo)
    a, med, up, down = np.array(dirs).reshape(-1, d), np.array(med), np.array(up), np.array(down)
    kind = rows.schema["cell_id"].dataType.simpleString()

    def run(it):
        for pdf in it:
            z = _stack(pdf["coords"], d) @ a.T - med
            o = np.where(z >= 0, z / up, -z / down).max(1) if len(a) else np.zeros(len(pdf))
            yield pd.DataFrame({"cell_id": pdf["cell_id"], "outlyingness": o})

    return rows.select("cell_id", "coords").mapInPandas(run, f"cell_id {kind}, outlyingness double")


def mds(m: Matrix, ncomponents: int = 2, distance=None, keep_dist: bool = False) -> tuple[DataFrame, dict]:
    """Classical scaling: (cell_id, coords) and ``eig``, ``GOF``, optionally ``dist``.

    Euclidean distances are scaled through the principal components, whose scores are the same up to sign,
    at any number of rows. Another distance (a function of a matrix giving a matrix, or ``manhattan``,
    ``maximum``) needs all pairs and is refused beyond 5,000 rows.
    """
    if not isinstance(keep_dist, bool):
        raise TypeError("keep_dist is True or False")
    if distance in (None, "euclidean") and not keep_dist:
        coords, attrs = pca(m, len(m.names))
        n = m.rows.count()
        eig = [v * (n - 1) for v in attrs["varExplained"]]
        k = min(ncomponents, len(eig))
        g = sum(eig[:k]) / sum(eig) if sum(eig) > 0 else float("nan")
        return dimensions(coords, k), {"eig": eig, "GOF": [g, g]}
    pdf = m.rows.orderBy("cell_id").limit(MOST_DISTANCE_ROWS + 1).toPandas()
    if len(pdf) > MOST_DISTANCE_ROWS:
        raise ValueError(f"a general distance takes {MOST_DISTANCE_ROWS} rows at most")
    x = _stack(pdf["coords"], len(m.names))
    if distance in (None, "euclidean"):
        d = np.sqrt(np.maximum((x**2).sum(1)[:, None] + (x**2).sum(1) - 2 * x @ x.T, 0))
    elif distance in ("manhattan", "maximum"):
        fold = np.sum if distance == "manhattan" else np.max
        d = np.stack([fold(np.abs(x - r), 1) for r in x])
    else:
        d = np.asarray(distance(x), float)
    np.fill_diagonal(d, 0)
    sq = d**2
    b = -(sq - sq.mean(0) - sq.mean(1)[:, None] + sq.mean()) / 2
    val, vec = np.linalg.eigh(b)
    val, vec = val[::-1], vec[:, ::-1]
    k = min(ncomponents, int((val > 1e-9).sum()))
    y = vec[:, :k] * np.sqrt(val[:k])
    y = y * np.where(y[np.abs(y).argmax(0), np.arange(k)] < 0, -1.0, 1.0)
    attrs = {"eig": val.tolist(), "GOF": [val[:k].sum() / np.abs(val).sum(), val[:k].sum() / np.maximum(val, 0).sum()]}
    if keep_dist:
        attrs["dist"] = d
    kind = m.rows.schema["cell_id"].dataType.simpleString()
    return m.rows.sparkSession.createDataFrame(list(zip(pdf["cell_id"].tolist(), y.tolist(), strict=True)), f"cell_id {kind}, coords array<double>"), attrs


def calculate_mds(bundle: Bundle, ncomponents: int = 2, distance=None, keep_dist: bool = False, **kw) -> tuple[DataFrame, dict]:
    return mds(matrix_from(bundle, **kw), ncomponents, distance, keep_dist)


def run_mds(bundle: Bundle, ncomponents: int = 2, name: str = "MDS", **kw) -> Bundle:
    return bundle.with_reduced(name, *calculate_mds(bundle, ncomponents, **kw))


def _weights(x: np.ndarray, h: np.ndarray, rounds: int) -> np.ndarray:
    """Non-negative weights of rows over a fixed basis, by multiplicative steps from a constant start."""
    hh, xh = h @ h.T, x @ h.T
    w = np.full((len(x), len(h)), 1.0)
    for _ in range(rounds):
        w *= xh / np.maximum(w @ hh, 1e-12)
    return w


def nmf(m: Matrix, ncomponents: int = 2, seed: int = 1, rounds: int = 20, inner: int = 30) -> tuple[DataFrame, dict]:
    """Non-negative factors: (cell_id, coords) and attribute ``basis`` (feature to its loadings).

    Only the basis (components x at most 5,000 features) is kept between rounds; every round solves the
    weights of each row from it and sends back sums of the size of the basis.
    """
    d = len(m.names)
    rng = np.random.default_rng(seed)
    h = rng.uniform(0.1, 1.0, (ncomponents, d))
    rows = m.rows.select("cell_id", "coords").persist()
    try:
        for _ in range(rounds):

            def part(it, h=h):
                g, c = np.zeros((ncomponents, ncomponents)), np.zeros((ncomponents, d))
                for pdf in it:
                    x = _stack(pdf["coords"], d)
                    w = _weights(x, h, inner)
                    g, c = g + w.T @ w, c + w.T @ x
                yield pd.DataFrame({"i": np.arange(ncomponents), "g": list(g), "c": list(c)})

            def add(key, pdf):
                return pd.DataFrame({"i": [key[0]], "g": [np.sum(list(pdf["g"]), 0)], "c": [np.sum(list(pdf["c"]), 0)]})

            schema = "i int, g array<double>, c array<double>"
            got = rows.mapInPandas(part, schema).groupBy("i").applyInPandas(add, schema).toPandas().sort_values("i")
            if not len(got):
                break
            g, c = np.vstack(list(got["g"])), np.vstack(list(got["c"]))
            for _ in range(inner):
                h = h * c / np.maximum(g @ h, 1e-12)
            scale = np.maximum(h.sum(1, keepdims=True), 1e-12)
            h = h / scale
    finally:
        rows.unpersist()
    kind = m.rows.schema["cell_id"].dataType.simpleString()

    def run(it):
        for pdf in it:
            yield pd.DataFrame({"cell_id": pdf["cell_id"], "coords": list(_weights(_stack(pdf["coords"], d), h, 3 * inner))})

    coords = m.rows.select("cell_id", "coords").mapInPandas(run, f"cell_id {kind}, coords array<double>")
    return coords, {"basis": {n: h[:, i].tolist() for i, n in enumerate(m.names)}}


def calculate_nmf(bundle: Bundle, ncomponents: int = 2, seed: int = 1, **kw) -> tuple[DataFrame, dict]:
    return nmf(matrix_from(bundle, **kw), ncomponents, seed)


def run_nmf(bundle: Bundle, ncomponents: int = 2, name: str = "NMF", **kw) -> Bundle:
    return bundle.with_reduced(name, *calculate_nmf(bundle, ncomponents, **kw))


def _gone(old: str, new: str):
    def raise_(*_, **__):
        raise NotImplementedError(f"{old} is defunct; {new}")

    return raise_


calculate_diffusion_map = _gone("calculate_diffusion_map", "use a dedicated package")
run_diffusion_map = _gone("run_diffusion_map", "use a dedicated package")
calculate_qc_metrics = _gone("calculate_qc_metrics", "use per_cell_qc and per_feature_qc")
normalize = _gone("normalize", "use log_norm_counts")
centre_size_factors = _gone("centre_size_factors", "use normalize_counts with center")
multiplot = _gone("multiplot", "drawing is out of scope")
