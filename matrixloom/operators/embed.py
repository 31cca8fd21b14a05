"""Nearest neighbours, projection onto an embedding, and neighbour-graph layouts."""

from __future__ import annotations

import math
import warnings
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..bundle import Bundle
from ..functions.relational import written
from ..functions.vectors import centroids, met, owners
from .decompose import Matrix, _stack, matrix_from, pca
from .retrieve import dimensions

#: Rows of a block of the exact neighbour search; rows that a layout is worked out for on the driver.
BLOCK_ROWS, MOST_LAYOUT = 8_000, 3_000
#: Rows that the partition of the neighbour search is fitted on at most, and its parts at most.
SAMPLE_ROWS, MOST_PARTS = 40_000, 4_096


def find_knn(rows: DataFrame, k: int, metric: str = "euclidean") -> DataFrame:
    """(cell_id, neighbour, distance, rank): the k nearest other rows of every row. Exact."""
    return _knn(rows, rows, k, metric, True)


def query_knn(queries: DataFrame, base: DataFrame, k: int, metric: str = "euclidean") -> DataFrame:
    """(cell_id, neighbour, distance, rank): the k nearest rows of ``base`` for every query. Exact."""
    return _knn(queries, base, k, metric, False)


def _unit(coords: str, metric: str):
    """Vectors of length 1 for the cosine metric, whose order is that of Euclidean distance between these."""
    if metric != "cosine":
        return F.col(coords)
    norm = F.sqrt(F.aggregate(coords, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(norm > 0, F.transform(coords, lambda x: x / norm)).otherwise(F.col(coords))


def _knn(queries: DataFrame, base: DataFrame, k: int, metric: str, same: bool) -> DataFrame:
    """Up to BLOCK_ROWS base rows are one block that queries meet in blocks of their own. Beyond, base rows lie in the parts of a
    Voronoi partition fitted on a bounded sample: a query is first answered in its own part, and then asks only those other parts
    that may hold a row nearer than its k-th so far. Exact; parts are cut into blocks of bounded size.

    Ties go to the smaller id. Rows with a null vector take no part; k of 0 gives nothing. Sums of absolute differences are never below the
    Euclidean distance, so the bound holds for that metric too.
    """
    kind = queries.schema["cell_id"].dataType.simpleString()
    q, b = (d.where("coords IS NOT NULL").select("cell_id", _unit("coords", metric).alias("coords")) for d in (queries, base))
    n = b.count()
    schema = f"cell_id {kind}, neighbour {kind}, distance double"

    def find(pdf: pd.DataFrame) -> pd.DataFrame:
        a, c = pdf[pdf["asks"]], pdf[~pdf["asks"]].sort_values("cell_id")
        if not len(a) or not len(c) or k < 1:
            return pd.DataFrame({"cell_id": a["cell_id"].iloc[:0], "neighbour": a["cell_id"].iloc[:0], "distance": pd.Series(dtype=float)})
        x, y = _stack(a["coords"], 0), _stack(c["coords"], 0)
        ids = c["cell_id"].to_numpy()
        out = []
        m = min(len(y), k + int(same) + 8)
        sq = (y**2).sum(1)
        for i in range(0, len(x), 512):
            p = x[i : i + 512]
            if metric == "manhattan":
                d = np.stack([np.abs(y - r).sum(1) for r in p])
            else:
                d = np.maximum((p**2).sum(1)[:, None] + sq - 2 * p @ y.T, 0)
            top = np.sort(np.argpartition(d, m - 1, 1)[:, :m], 1)
            far = np.abs(y[top] - p[:, None]).sum(2) if metric == "manhattan" else np.sqrt(((y[top] - p[:, None]) ** 2).sum(2))
            if same:
                far = np.where(ids[top] == a["cell_id"].to_numpy()[i : i + 512][:, None], np.inf, far)
            order = np.argsort(far, 1, kind="stable")[:, :k]
            rows = np.arange(len(p))[:, None]
            out.append((np.repeat(np.arange(i, i + len(p)), order.shape[1]), top[rows, order].ravel(), far[rows, order].ravel()))
        r, j, d = (np.concatenate(z) for z in zip(*out, strict=True))
        ok = np.isfinite(d)
        return pd.DataFrame({"cell_id": a["cell_id"].to_numpy()[r[ok]], "neighbour": ids[j[ok]], "distance": d[ok]})

    h = F.xxhash64("cell_id")
    w = Window.partitionBy("cell_id").orderBy("distance", "neighbour")
    best = lambda d: d.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

    def met_in(asks: DataFrame, have: DataFrame) -> DataFrame:
        """``asks`` and ``have`` (cell_id, coords, part) met part by part, in blocks."""
        size = lambda d, name: d.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias(name))
        plan = written(size(have, "nb").join(size(asks, "nq"), "part"), "blocks")
        each = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
        own = lambda c: F.pmod(h, F.col(c)).cast("int")
        one = have.join(plan, "part").select("part", own("nb").alias("bb"), each("nq").alias("qb"), F.lit(False).alias("asks"), "cell_id", "coords")
        two = asks.join(plan, "part").select("part", each("nb").alias("bb"), own("nq").alias("qb"), F.lit(True).alias("asks"), "cell_id", "coords")
        return one.unionByName(two).groupBy("part", "bb", "qb").applyInPandas(find, schema)

    if n <= BLOCK_ROWS:
        return best(met_in(q.withColumn("part", F.lit(0)), b.withColumn("part", F.lit(0))))
    some = b.where(F.shiftrightunsigned(F.xxhash64("cell_id", F.lit(3)), 32) < int(min(1.0, SAMPLE_ROWS / n) * 2**32)).toPandas()
    c = centroids(_stack(some["coords"], 0), max(2, min(MOST_PARTS, n // (BLOCK_ROWS // 4))))

    def place(it):
        for pdf in it:
            yield pdf.assign(part=owners(_stack(pdf["coords"], c.shape[1]), c).astype(np.int32))

    def further(it):
        for pdf in it:
            x = _stack(pdf["coords"], c.shape[1])
            yield pdf.drop(columns="kth").assign(parts=met(x, c, pdf["part"].to_numpy(), np.nan_to_num(pdf["kth"].to_numpy(float), nan=1e150)))

    fields = f"cell_id {kind}, coords array<double>, part int"
    have, asks = written(b.mapInPandas(place, fields), "parts"), written(q.mapInPandas(place, fields), "asks")
    first = written(met_in(asks, have), "first")
    kth = best(first).groupBy("cell_id").agg(F.when(F.count(F.lit(1)) >= k, F.max("distance")).alias("kth"))
    more = asks.join(kth, "cell_id", "left").mapInPandas(further, f"{fields}, parts array<int>")
    more = written(more, "further").select("cell_id", "coords", F.explode("parts").alias("part"))
    return best(first.unionByName(met_in(more, have)))


def tricube_average(near: DataFrame, values: DataFrame, k: int, ndist: float = 3.0) -> DataFrame:
    """(cell_id, coords): per query the tricube-weighted mean of its neighbours' vectors.

    The bandwidth is ``ndist`` times the distance of neighbour ceil(k / 2), at least 1e-8; weights are
    (1 - min(d / bandwidth, 1)^3)^3, normalised per query; if all weights vanish the plain mean is taken.
    """
    w = Window.partitionBy("cell_id")
    band = F.greatest(F.max(F.when(F.col("rank") == math.ceil(k / 2), F.col("distance"))).over(w) * ndist, F.lit(1e-8))
    d = near.withColumn("_b", band)
    t = 1 - F.pow(F.least(F.col("distance") / F.col("_b"), F.lit(1.0)), 3)
    d = d.withColumn("_w", t * t * t)
    d = d.withColumn("_w", F.when(F.sum("_w").over(w) > 0, F.col("_w")).otherwise(F.lit(1.0)))
    j = d.join(values.select(F.col("cell_id").alias("neighbour"), "coords"), "neighbour").select("cell_id", "_w", F.posexplode("coords").alias("i", "x"))
    s = j.groupBy("cell_id", "i").agg((F.sum(F.col("_w") * F.col("x")) / F.sum("_w")).alias("x"))
    return s.groupBy("cell_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda z: z["x"]).alias("coords"))


def project_reduced_dim(new: DataFrame, old: DataFrame, old_embedding: DataFrame, k: int = 5) -> DataFrame:
    """New cells placed in an old embedding: the tricube average over their k nearest old cells.

    ``new``, ``old``: (cell_id, coords) in the space of the search; ``old_embedding``: (cell_id, coords) to average.
    """
    return tricube_average(query_knn(new, old, k), old_embedding, k)


def run_project_reduced_dim(bundle: Bundle, old: Bundle, dimred_embed: str = "TSNE", dimred_knn: str = "PCA", name: str | None = None, k: int = 5) -> Bundle:
    return bundle.with_reduced(name or dimred_embed, project_reduced_dim(bundle.reduced[dimred_knn], old.reduced[dimred_knn], old.reduced[dimred_embed], k))


def _landmarks(rows: DataFrame, seed: int) -> tuple[pd.DataFrame, bool]:
    """All rows, or a sample of at most MOST_LAYOUT by a hash of their id; the second value tells if some are left."""
    n = rows.count()
    if n <= MOST_LAYOUT:
        return rows.select("cell_id", "coords").toPandas().sort_values("cell_id").reset_index(drop=True), False
    warnings.warn(f"laying out {MOST_LAYOUT} of {n} rows; the others are placed by their neighbours among them", stacklevel=3)
    some = rows.select("cell_id", "coords").orderBy(F.xxhash64("cell_id", F.lit(seed))).limit(MOST_LAYOUT)
    return some.toPandas().sort_values("cell_id").reset_index(drop=True), True


def _placed(rows: DataFrame, some: pd.DataFrame, y: np.ndarray, left: bool, k: int) -> DataFrame:
    spark = rows.sparkSession
    kind = rows.schema["cell_id"].dataType.simpleString()
    ids = some["cell_id"].tolist()
    done = spark.createDataFrame(list(zip(ids, y.astype(float).tolist(), strict=True)), f"cell_id {kind}, coords array<double>")
    if not left:
        return done
    base = spark.createDataFrame(list(zip(ids, [[float(v) for v in r] for r in some["coords"]], strict=True)), f"cell_id {kind}, coords array<double>")
    rest = rows.join(F.broadcast(done.select("cell_id")), "cell_id", "left_anti")  # MOST_LAYOUT ids
    return done.unionByName(project_reduced_dim(rest, base, done, k))


def _distances(x: np.ndarray, metric: str = "euclidean") -> np.ndarray:
    if metric == "manhattan":
        return np.stack([np.abs(x - r).sum(1) for r in x])
    if metric == "cosine":
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    return np.sqrt(np.maximum((x**2).sum(1)[:, None] + (x**2).sum(1) - 2 * x @ x.T, 0))


def _edge_distances(some: pd.DataFrame, near: DataFrame) -> np.ndarray:
    """The distances of a given neighbour table (cell_id, neighbour, distance) as a matrix, infinite where it has none."""
    at = {c: i for i, c in enumerate(some["cell_id"])}
    d = np.full((len(at), len(at)), np.inf)
    np.fill_diagonal(d, 0)
    rows = near.select("cell_id", "neighbour", "distance")
    ids = near.sparkSession.createDataFrame([(c,) for c in at], f"_c {near.schema['cell_id'].dataType.simpleString()}")
    for c in ("cell_id", "neighbour"):  # rows of the layout only, MOST_LAYOUT of them
        rows = rows.join(F.broadcast(ids.withColumnRenamed("_c", c)), c, "left_semi")
    for a, b, v in rows.select("cell_id", "neighbour", "distance").collect():
        d[at[a], at[b]] = v
    return d


def _dense_aware(d: np.ndarray, share: float, weight: float, k: int) -> np.ndarray:
    """Distances stretched by a power of the local radius, so that dense regions stay dense; ``share`` is the part of full strength that is applied."""
    if len(d) < 4:
        return d
    r = np.log(np.maximum(np.sort(d, 1)[:, 1 : min(len(d), k + 1)].mean(1), 1e-12))
    d = d * np.exp(weight * share / 0.3 * (r - r.mean()))[:, None]
    return (d + d.T) / 2


def tsne_layout(d: np.ndarray, perplexity: float, ncomponents: int = 2, rounds: int = 400, seed: int = 1) -> np.ndarray:
    """t-distributed stochastic neighbour embedding of a distance matrix, by gradient descent with momentum."""
    n = len(d)
    if n < 3:
        return np.arange(n, dtype=float)[:, None] * np.ones((1, ncomponents))
    sq = np.minimum(d, 1e100) ** 2
    np.fill_diagonal(sq, np.inf)
    goal, lo, hi = math.log(max(perplexity, 1.01)), np.zeros(n), np.full(n, np.inf)
    there = sq < 1e199  # pairs that have a distance
    beta = 1 / np.maximum(np.where(there, sq, 0).sum(1) / np.maximum(there.sum(1), 1), 1e-12)
    small = sq.min(1, keepdims=True)
    for _ in range(50):  # the precision of each row that gives its perplexity
        p = np.exp(-(sq - small) * beta[:, None])
        s = p.sum(1)
        h = np.log(s) + beta * (p * np.where(np.isinf(sq), 0, sq - small)).sum(1) / s
        over = h > goal
        lo, hi = np.where(over, beta, lo), np.where(over, hi, beta)
        beta = np.where(np.isinf(hi), beta * 2, (lo + hi) / 2)
    p = p / s[:, None]
    p = np.maximum((p + p.T) / (2 * n), 1e-12)
    rng = np.random.default_rng(seed)
    y, step, gain = rng.normal(0, 1e-4, (n, ncomponents)), np.zeros((n, ncomponents)), np.ones((n, ncomponents))
    for r in range(rounds):
        q = 1 / (1 + np.maximum((y**2).sum(1)[:, None] + (y**2).sum(1) - 2 * y @ y.T, 0))
        np.fill_diagonal(q, 0)
        w = (p * (12 if r < 100 else 1) - q / max(q.sum(), 1e-12)) * q
        grad = 4 * (w.sum(1)[:, None] * y - w @ y)
        gain = np.maximum(np.where(np.sign(grad) == np.sign(step), gain * 0.8, gain + 0.2), 0.01)
        step = (0.5 if r < 100 else 0.8) * step - max(n / 48, 50) * gain * grad
        y = y + step
        y -= y.mean(0)
    return y


def calculate_tsne(bundle: Bundle, ncomponents: int = 2, perplexity: float | None = None, normalize: bool = True, use_densvis: bool = False, dens_frac: float = 0.3, dens_lambda: float = 0.1, pca_dims: int | None = 50, theta: float = 0.5, use_fitsne: bool = False, external_neighbors: bool | DataFrame = False, seed: int = 1, **kw) -> tuple[DataFrame, dict]:
    """(cell_id, coords) of a t-SNE. Perplexity defaults to min(50, n / 5).

    ``external_neighbors``: True limits affinities to the 3 * perplexity nearest rows found by :func:`find_knn`; a table (cell_id,
    neighbour, distance) takes its edges instead. ``theta`` and ``use_fitsne`` choose between approximations elsewhere; gradients are exact here.

    Up to 3,000 rows are laid out exactly; of more rows a sample is, and the others are placed by the
    tricube average of their neighbours in it. ``use_densvis`` scales local distances by a share of the
    log local radius, so that dense regions stay dense.
    """
    m = matrix_from(bundle, **kw)
    if pca_dims and len(m.names) > pca_dims:
        m = Matrix(pca(m, pca_dims)[0], [str(i) for i in range(pca_dims)])
    some, left = _landmarks(m.rows, seed)
    x = _stack(some["coords"], len(m.names))
    if normalize and len(x):
        x = x - x.mean(0)
        x = x / max(np.abs(x).max(), 1e-300)
    perplexity = perplexity or min(50, max(len(x) // 5, 1))
    if external_neighbors is not False:
        base = m.rows.sparkSession.createDataFrame(list(zip(some["cell_id"].tolist(), x.tolist(), strict=True)), m.rows.select("cell_id", "coords").schema) if len(x) else m.rows
        d = _edge_distances(some, find_knn(base, int(3 * perplexity)) if external_neighbors is True else external_neighbors)
    else:
        d = _distances(x)
    if use_densvis:
        d = _dense_aware(d, dens_frac, dens_lambda, int(3 * perplexity))
    return _placed(m.rows, some, tsne_layout(d, perplexity, ncomponents, seed=seed), left, 5), {"perplexity": perplexity}


def run_tsne(bundle: Bundle, name: str = "TSNE", **kw) -> Bundle:
    return bundle.with_reduced(name, *calculate_tsne(bundle, **kw))


def fuzzy_edges(d: np.ndarray, k: int, symmetric: bool = True) -> np.ndarray:
    """Membership strengths of the k-nearest graph (k counts the row itself), made symmetric as a + b - ab."""
    n = len(d)
    k = min(k, n)
    near = np.argsort(d, 1, kind="stable")[:, :k]
    far = np.take_along_axis(d, near, 1)
    w = np.zeros((n, n))
    for i in range(n):
        far[i] = np.where(np.isfinite(far[i]), far[i], 1e150)  # no edge
        r = far[i][far[i] > 0]
        rho = r.min() if len(r) else 0.0
        lo, hi, s = 0.0, np.inf, 1.0
        for _ in range(40):
            total = np.exp(-np.maximum(far[i][1:] - rho, 0) / s).sum()
            if total > math.log2(max(k, 2)):
                hi, s = s, (lo + s) / 2
            else:
                lo, s = s, s * 2 if np.isinf(hi) else (s + hi) / 2
        w[i, near[i]] = np.exp(-np.maximum(far[i] - rho, 0) / max(s, 1e-12))
    np.fill_diagonal(w, 0)
    return w + w.T - w * w.T if symmetric else w


def intersected(strengths: Sequence[np.ndarray]) -> np.ndarray:
    """The intersection of the graphs of several modalities: the geometric mean of strengths, so an edge must be there in all."""
    w = strengths[0]
    for e in strengths[1:]:
        w = w * e
    return w ** (1 / len(strengths))


def umap_layout(w: np.ndarray, ncomponents: int = 2, rounds: int = 200, seed: int = 1) -> np.ndarray:
    """A layout of a fuzzy graph: spectral start, then attraction along edges and repulsion of random pairs."""
    n = len(w)
    rng = np.random.default_rng(seed)
    if n < 3:
        return rng.uniform(-1, 1, (n, ncomponents))
    s = 1 / np.sqrt(np.maximum(w.sum(1), 1e-12))
    _, vec = np.linalg.eigh(np.eye(n) - s[:, None] * w * s[None])
    y = vec[:, 1 : ncomponents + 1]
    y = 10 * y / max(np.abs(y).max(), 1e-12) + rng.normal(0, 1e-3, (n, y.shape[1]))
    if y.shape[1] < ncomponents:
        y = np.hstack([y, rng.normal(0, 1e-2, (n, ncomponents - y.shape[1]))])
    # The curve 1 / (1 + a x^(2b)) for a minimum distance of 0.01
    a, b = 1.896, 0.8006
    i, j = np.nonzero(np.triu(w) > w.max() / 500)
    for r in range(rounds):
        rate = 1 - r / rounds
        use = rng.random(len(i)) < w[i, j]
        p, q = i[use], j[use]
        diff = y[p] - y[q]
        d2 = np.maximum((diff**2).sum(1), 1e-12)
        pull = np.clip((-2 * a * b * d2 ** (b - 1) / (1 + a * d2**b))[:, None] * diff, -4, 4) * rate
        np.add.at(y, p, pull)
        np.add.at(y, q, -pull)
        for _ in range(5):
            o = rng.integers(0, n, len(p))
            diff = y[p] - y[o]
            d2 = (diff**2).sum(1)
            push = np.clip((2 * b / ((0.001 + d2) * (1 + a * np.maximum(d2, 1e-12) ** b)))[:, None] * diff, -4, 4) * rate
            np.add.at(y, p, np.where((p != o)[:, None], push, 0))
    return y


def calculate_umap(bundle: Bundle, ncomponents: int = 2, n_neighbors: int = 15, pca_dims: int | None = 50, use_densvis: bool = False, dens_frac: float = 0.3, dens_lambda: float = 2.0, external_neighbors: bool | DataFrame = False, seed: int = 1, **kw) -> tuple[DataFrame, dict]:
    """(cell_id, coords) of a UMAP. ``n_neighbors`` counts the row itself; ``pca_dims=None`` skips the components.

    ``external_neighbors``: a table (cell_id, neighbour, distance) whose edges are taken; True searches as without it. ``use_densvis``
    keeps dense regions dense.
    """
    m = matrix_from(bundle, **kw)
    if pca_dims and len(m.names) > pca_dims:
        m = Matrix(pca(m, pca_dims)[0], [str(i) for i in range(pca_dims)])
    some, left = _landmarks(m.rows, seed)
    d = _edge_distances(some, external_neighbors) if isinstance(external_neighbors, DataFrame) else _distances(_stack(some["coords"], len(m.names)))
    if use_densvis:
        d = _dense_aware(d, dens_frac, dens_lambda / 20, n_neighbors)
    w = fuzzy_edges(d, n_neighbors)
    return _placed(m.rows, some, umap_layout(w, ncomponents, seed=seed), left, 5), {"n_neighbors": n_neighbors}


def run_umap(bundle: Bundle, name: str = "UMAP", **kw) -> Bundle:
    return bundle.with_reduced(name, *calculate_umap(bundle, **kw))


def bind_blocks(blocks: Sequence[DataFrame]) -> tuple[DataFrame, list[int]]:
    """The vectors of several modalities bound by cell, in order, and their lengths; cells must be in all. No lengths without rows."""
    joined = blocks[0].select("cell_id", F.col("coords").alias("_0"))
    for i, b in enumerate(blocks[1:], 1):
        joined = joined.join(b.select("cell_id", F.col("coords").alias(f"_{i}")), "cell_id")
    first = joined.select(*[F.size(f"_{i}") for i in range(len(blocks))]).first()
    return joined.select("cell_id", F.concat(*[F.col(f"_{i}") for i in range(len(blocks))]).alias("coords")), list(first or [])


def calculate_multi_umap(blocks: Sequence[DataFrame], metrics: Sequence[str] | str = "euclidean", ncomponents: int = 2, n_neighbors: int = 15, seed: int = 1) -> tuple[DataFrame, dict]:
    """A UMAP of several modalities: (cell_id, coords) blocks, each with its own metric.

    The strength of an edge is the geometric mean over the modalities, so an edge must be there in all.
    """
    metrics = [metrics] * len(blocks) if isinstance(metrics, str) else list(metrics)
    rows, first = bind_blocks(blocks)
    if not first:
        return rows, {}
    some, left = _landmarks(rows.select("cell_id", "coords"), seed)
    x = _stack(some["coords"], sum(first))
    ends = np.cumsum([0, *first])
    w = intersected([fuzzy_edges(_distances(x[:, i:j], metric), n_neighbors) for i, j, metric in zip(ends[:-1], ends[1:], metrics, strict=True)])
    return _placed(rows.select("cell_id", "coords"), some, umap_layout(w, ncomponents, seed=seed), left, 5), {"blocks": list(first)}


def run_multi_umap(bundle: Bundle, assay_type: Sequence[str] = (), dimred: Sequence[str] = (), altexp: Sequence[str] = (), altexp_assay_type: str = "logcounts", metric="euclidean", name: str = "MultiUMAP", **kw) -> Bundle:
    """Blocks in the order assays, embeddings, alternative experiments."""
    blocks = [matrix_from(bundle, a).rows for a in assay_type] + [dimensions(bundle.reduced[d]) for d in dimred]
    blocks += [matrix_from(bundle, altexp_assay_type, altexp=a).rows for a in altexp]
    return bundle.with_reduced(name, *calculate_multi_umap(blocks, metric, **kw))
