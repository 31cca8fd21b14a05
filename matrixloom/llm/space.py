"""NumPy pieces shared by the vector operators: Arrow conversion, centroids, distances, local components."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vectors that centroids, codebooks and landmarks are fitted on at most, whatever the size of the table;
#: for many centroids as many rows for each as the second figure says.
SAMPLE_ROWS, ROWS_EACH = 40_000, 16


def matrix(col: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    """A list column of equally long vectors as a matrix."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
        if isinstance(col, pa.ChunkedArray):
            col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.list_(pa.float64()))
    return np.ascontiguousarray(col.flatten().to_numpy(zero_copy_only=False), dtype=float).reshape(-1, dims)


def lists(x: np.ndarray) -> pa.Array:
    """The rows of a matrix as a list column."""
    n, d = x.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * d, d), pa.int32()), pa.array(np.ascontiguousarray(x, float).ravel()))


def ragged(rows: np.ndarray, values: np.ndarray, n: int) -> pa.Array:
    """The values of each of n rows as a list column of ints; ``rows`` is sorted."""
    off = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=n))])
    return pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(values, pa.int32()))


def packed(x: np.ndarray) -> pa.Array:
    """The rows of a matrix as a binary column: one value a row to the engine, whatever the dimension."""
    n, width = len(x), x.shape[1] * x.itemsize
    off = np.arange(0, (n + 1) * width, width, dtype=np.int32) if width else np.zeros(n + 1, np.int32)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(x))])


def unpacked(col: pa.ChunkedArray | pa.Array, dims: int, kind: type = np.float64) -> np.ndarray:
    """The matrix behind a column of :func:`packed` rows, none of them null."""
    parts = col.chunks if isinstance(col, pa.ChunkedArray) else [col]
    out = [np.zeros((0, dims), kind)]
    for a in parts:
        if len(a):
            off = np.frombuffer(a.buffers()[1], np.int32)[a.offset : a.offset + len(a) + 1]
            out.append(np.frombuffer(a.buffers()[2], np.uint8)[off[0] : off[-1]].view(kind).reshape(-1, dims))
    return np.concatenate(out)


def pack(df: DataFrame, *keep: str) -> DataFrame:
    """(cell_id, vec, dims, ``keep``) of the rows with an id and a vector free of null, NaN and infinite coordinates; -0.0 becomes 0.0."""

    def run(t: pa.Table) -> pa.Table:
        col = t["coords"].combine_chunks()
        col = pa.concat_arrays(col.chunks) if isinstance(col, pa.ChunkedArray) else col
        n = np.nan_to_num(col.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
        x = np.asarray(col.flatten().to_numpy(zero_copy_only=False), float) + 0.0
        bad = np.concatenate([[0], np.cumsum(~np.isfinite(x))])
        end = np.cumsum(n)
        ok = (n > 0) & (bad[end] == bad[end - n])
        x = np.ascontiguousarray(x[np.repeat(ok, n)])
        off = np.concatenate([[0], np.cumsum(n[ok] * 8)]).astype(np.int32)
        vec = pa.Array.from_buffers(pa.binary(), int(ok.sum()), [None, pa.py_buffer(off), pa.py_buffer(x)])
        rows = pa.array(np.nonzero(ok)[0])
        return pa.table([t["cell_id"].take(rows), vec, pa.array(n[ok], pa.int32()), *[t[k].take(rows) for k in keep]], names=["cell_id", "vec", "dims", *keep])

    kinds = "".join(f", {k} {df.schema[k].dataType.simpleString()}" for k in keep)
    out = df.select("cell_id", F.col("coords").cast("array<double>").alias("coords"), *keep).where("cell_id IS NOT NULL AND size(coords) > 0")
    return out.mapInArrow(lambda it: batches(run, it), f"cell_id string, vec binary, dims int{kinds}")


def usual_length(df: DataFrame) -> int | None:
    """The most frequent ``dims`` of packed rows, the smaller of two; None without rows."""
    r = df.groupBy("dims").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "dims").first()
    return r[0] if r else None


def packed_sample(df: DataFrame, n_rows: int, dims: int, most: int = SAMPLE_ROWS) -> np.ndarray:
    """About ``most`` packed vectors chosen by a hash of their id, or all if there are fewer."""
    share = min(1.0, most / max(n_rows, 1))
    some = df if share == 1 else df.where(F.shiftrightunsigned(F.xxhash64("cell_id", F.lit(11)), 32) < int(share * 2**32))
    return unpacked(some.select("cell_id", "vec").toArrow().sort_by("cell_id")["vec"], dims)


def sample(df: DataFrame, n_rows: int, most: int = SAMPLE_ROWS) -> np.ndarray:
    """About ``most`` vectors chosen by a hash of their id, or all if there are fewer."""
    share = min(1.0, most / max(n_rows, 1))
    some = df if share == 1 else df.where(F.shiftrightunsigned(F.xxhash64("cell_id", F.lit(11)), 32) < int(share * 2**32))
    t = some.select("cell_id", "coords").toArrow().sort_by("cell_id")
    if not t.num_rows:
        return np.zeros((0, 0))
    return matrix(t["coords"], len(t["coords"][0]))


def sq_distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x to all of c."""
    d = (x**2).sum(1)[:, None] + (c**2).sum(1)[None] - 2.0 * (x @ c.T)
    return np.maximum(d, 0.0, out=d)


def nearest(x: np.ndarray, c: np.ndarray, block: int = 8192) -> np.ndarray:
    """The index of the nearest row of c for every row of x."""
    half = (c**2).sum(1) / 2
    return np.concatenate([np.argmin(half[None] - x[i : i + block] @ c.T, 1) for i in range(0, len(x), block)]) if len(x) else np.zeros(0, int)


def _apart(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k start rows, each drawn in proportion to the squared distance from those before it."""
    c = [x[rng.integers(len(x))]]
    far = ((x - c[0]) ** 2).sum(1)
    while len(c) < k and far.max() > 0:
        c.append(x[min(int(np.searchsorted(np.cumsum(far), rng.random() * far.sum())), len(x) - 1)])
        far = np.minimum(far, ((x - c[-1]) ** 2).sum(1))
    return np.array(c)


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 7, spread: bool = False) -> np.ndarray:
    """Centroids by Lloyd's rounds from random rows, or (``spread``) from rows far apart; empty ones are dropped.

    Beyond 1,024 centroids rows are first divided among about sqrt(k) coarse ones, and each of these into its
    share of the k, so that the cost grows with sqrt(k).
    """
    rng = np.random.default_rng(seed)
    if k > 1_024 and len(x) > k:
        coarse = kmeans(x, math.ceil(math.sqrt(k)), rounds, seed, spread)
        a = nearest(x, coarse)
        parts = [x[a == j] for j in range(len(coarse))]
        return np.vstack([kmeans(p, max(1, round(k * len(p) / len(x))), rounds, seed) for p in parts if len(p)])
    c = _apart(x, k, rng) if spread else x[rng.choice(len(x), min(k, len(x)), replace=False)].astype(float)
    for _ in range(rounds):
        a = nearest(x, c)
        n = np.bincount(a, minlength=len(c))
        sums = np.stack([np.bincount(a, x[:, j], minlength=len(c)) for j in range(x.shape[1])], 1)
        c = (sums / np.maximum(n, 1)[:, None])[n > 0]
    return c


def reach(x: np.ndarray, c: np.ndarray, radius: float | np.ndarray, least: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The cells of a Voronoi partition that a ball around each row meets.

    Returns the own cell of each row, and (row, cell) pairs sorted by row. A vector within ``radius``
    of x lies in cell j only if the bisector between x's own centroid and c_j is at most ``radius``
    from x, so no such vector is ever missed. The ``least`` nearest cells are always among them. ``radius`` may
    differ from row to row.
    """
    own, rows, cells = [], [], []
    block = int(np.clip(8_000_000 // max(len(c), 1), 16, 4_096))  # 64 MB of distances at a time
    for i in range(0, len(x), block):
        d = sq_distances(x[i : i + block], c)
        a = d.argmin(1)
        some, at = np.unique(a, return_inverse=True)
        gaps = np.sqrt(sq_distances(c[some], c))
        r = radius[i : i + block, None] if isinstance(radius, np.ndarray) else radius
        near = d - d[np.arange(len(d)), a][:, None] <= 2 * r * gaps[at] + 1e-6
        if least > 1:
            top = np.argpartition(d, min(least, d.shape[1]) - 1, 1)[:, :least]
            near[np.arange(len(d))[:, None], top] = True
        r, j = np.nonzero(near)
        own.append(a)
        rows.append(r + i)
        cells.append(j)
    if not own:
        z = np.zeros(0, int)
        return z, z, z
    return np.concatenate(own), np.concatenate(rows), np.concatenate(cells)


def local_components(x: np.ndarray, radius: float, block: int = 512) -> np.ndarray:
    """The component of every row when rows at most ``radius`` apart are joined: index of its first row.

    Breadth first; rows already reached are never compared again, so a dense lump is done after a
    few of its rows and the cost is that of telling separate components apart.
    """
    n = len(x)
    label = np.full(n, -1)
    x = x - x.mean(0) if n else x
    limit = radius * radius
    todo = np.arange(n)
    while len(todo):
        start = todo[0]
        label[start] = start
        todo = todo[1:]
        frontier = [start]
        while frontier and len(todo):
            take, frontier = frontier[:block], frontier[block:]
            hit = np.zeros(len(todo), bool)
            for i in range(0, len(todo), 8192):
                d = sq_distances(x[take], x[todo[i : i + 8192]])
                close = d <= limit
                edge = np.abs(d - limit) < 1e-6  # too near the limit for the expanded form
                for p, q in zip(*np.nonzero(edge), strict=True):
                    close[p, q] = ((x[take[p]] - x[todo[i + q]]) ** 2).sum() <= limit + 1e-9
                hit[i : i + 8192] = close.any(0)
            new = todo[hit]
            label[new] = start
            todo = todo[~hit]
            frontier += list(new)
    return label


def usable(df: DataFrame) -> DataFrame:
    """(cell_id, coords) of the rows with an id and a vector free of null, NaN and infinite coordinates."""
    bad = F.exists("coords", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return df.select("cell_id", "coords").where(F.col("cell_id").isNotNull() & F.coalesce((F.size("coords") > 0) & ~bad, F.lit(False)))


def same_length(df: DataFrame) -> DataFrame:
    """The rows whose vector has the most frequent length."""
    d = df.agg(F.mode(F.size("coords"))).first()[0]
    return df if d is None else df.where(F.size("coords") == d)


def batches(fn, it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``fn`` from table to table over the batches of a partition; empty ones are skipped."""
    for b in it:
        if b.num_rows:
            yield from fn(pa.Table.from_batches([b])).to_batches()
