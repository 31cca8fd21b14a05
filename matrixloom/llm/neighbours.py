"""Problem 3: the nearest vectors of every vector, by an inverted file with product-quantised residuals."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.relational import written
from .space import ROWS_EACH, SAMPLE_ROWS, batches, kmeans, nearest, pack, packed, packed_sample, ragged, reach, unpacked, usual_length

#: Vectors aimed at in a list and held by one task of it, queries of a list in one task, lists at most.
LIST_ROWS, CHUNK_ROWS, QUERY_ROWS, MOST_LISTS = 2_000, 16_000, 40_000, 16_384
#: Codewords of a subspace, dimensions of one, subspaces after which sums are broken off; rows of a part of a list within a task; queries whose tables are held at a time.
CODEWORDS, SUBSPACE, EARLY, PART_ROWS, TABLE_QUERIES = 64, 2, 5, 160, 4_096
#: Groups of copies up to which their keys (16 bytes each) are sent to all executors; more are joined by shuffle.
MOST_SENT = 500_000
#: Copies of a vector that meet its neighbours in one task.
COPY_ROWS = 100_000


class Index:
    """Coarse centroids and one codebook of residuals per subspace. Fitted on a bounded sample."""

    def __init__(self, x: np.ndarray, n_lists: int):
        self.centroids = kmeans(x, n_lists, spread=True)
        r = x - self.centroids[nearest(x, self.centroids)]
        self.cuts = [slice(i, min(i + SUBSPACE, x.shape[1])) for i in range(0, x.shape[1], SUBSPACE)]
        self.books = [kmeans(r[:, s], CODEWORDS, 6) for s in self.cuts]

    def encode(self, x: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of vectors of the lists ``own``, and how far each is from what its code stands for."""
        r = x - self.centroids[own]
        codes = np.stack([nearest(r[:, s], b) for s, b in zip(self.cuts, self.books, strict=True)], 1).astype(np.uint8)
        rebuilt = np.concatenate([b[codes[:, m]] for m, b in enumerate(self.books)], 1)
        return codes, np.sqrt(((r - rebuilt) ** 2).sum(1))

    def tables(self, q: np.ndarray, at: int) -> list[np.ndarray]:
        """Asymmetric distance tables (codeword x query) of the queries against list ``at``."""
        r = q - self.centroids[at]
        out = []
        for s, b in zip(self.cuts, self.books, strict=True):
            t = b @ (-2.0 * r[:, s].T)
            t += (b**2).sum(1)[:, None]
            t += (r[:, s] ** 2).sum(1)[None]
            out.append(t.astype(np.float32))
        return out

    def within(self, q: np.ndarray, x: np.ndarray, codes: np.ndarray, err: np.ndarray, at: int, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, row) of all pairs whose table distance, less the row's own coding error, is within the query's radius.

        The list is divided once more into parts, and a query looks into those that its ball meets. Sums of
        table rows are broken off after a few subspaces for the pairs that are too far by then.
        """
        small = kmeans(x[:: max(1, len(x) // 4_000)], max(1, len(x) // PART_ROWS), 4)
        of, radius = nearest(x, small), np.minimum(radius, 1e150)
        order = np.argsort(of, kind="stable")
        ends = np.searchsorted(of[order], np.arange(len(small) + 1))
        rows_, cols_ = [], []
        for i in range(0, len(q), TABLE_QUERIES):
            qb, rb = q[i : i + TABLE_QUERIES], radius[i : i + TABLE_QUERIES]
            t = self.tables(qb, at)
            _, who, part = reach(qb, small, rb)
            by = np.argsort(part, kind="stable")
            who, starts = who[by], np.searchsorted(part[by], np.arange(len(small) + 1))
            for j in range(len(small)):
                mine, own = who[starts[j] : starts[j + 1]], order[ends[j] : ends[j + 1]]
                if not len(mine) or not len(own):
                    continue
                c, e = codes[own], err[own]
                for k in range(0, len(mine), 1_024):
                    some = mine[k : k + 1_024]
                    r = rb[some]
                    far = e[:, None] + (r[:1] if r[0] == r[-1] and (r == r[0]).all() else r)[None]
                    bound = np.minimum(far * far * (1 + 1e-4) + 1e-3, 3e38).astype(np.float32)
                    adc = np.take(np.take(t[0], some, 1), c[:, 0], 0)
                    for m in range(1, min(EARLY, len(t))):
                        adc += np.take(np.take(t[m], some, 1), c[:, m], 0)
                    row, col = np.divmod(np.flatnonzero(adc <= bound), len(some))
                    if len(row) and len(t) > EARLY:
                        rest = adc[row, col]
                        for m in range(EARLY, len(t)):
                            rest += t[m][c[row, m], some[col]]
                        ok = rest <= (bound[row, col] if bound.shape[1] > 1 else bound[row, 0])
                        row, col = row[ok], col[ok]
                    rows_.append(own[row])
                    cols_.append(some[col] + i)
        z = np.zeros(0, np.int64)
        return np.concatenate([z, *cols_]), np.concatenate([z, *rows_])

    def closest(self, q: np.ndarray, codes: np.ndarray, at: int, rerank: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, row) of the ``rerank`` rows of least table distance to each query."""
        n, rows_, cols_ = min(rerank, len(codes)), [], []
        for i in range(0, len(q), 256):
            t = self.tables(q[i : i + 256], at)
            adc = np.take(t[0], codes[:, 0], 0)
            for m in range(1, len(t)):
                adc += np.take(t[m], codes[:, m], 0)
            rows_.append(np.argpartition(adc, n - 1, 0)[:n].ravel())
            cols_.append(np.tile(np.arange(adc.shape[1]), n) + i)
        return np.concatenate(cols_), np.concatenate(rows_)

    def search(self, q: np.ndarray, x: np.ndarray, codes: np.ndarray, err: np.ndarray, at: int, same: np.ndarray, k: int, radius: np.ndarray | None, rerank: int) -> tuple:
        """(query, row, distance) of the best ``k`` rows of list ``at`` for each query.

        ``same``: the row of x that is the query itself, or -1. With radii every row that may be within the
        query's, as its table distance less its own coding error tells, is compared exactly;
        without them the ``rerank`` rows of least table distance are.
        """
        col, row = self.within(q, x, codes, err, at, radius) if radius is not None else self.closest(q, codes, at, rerank)
        keep = same[col] != row
        row, col = row[keep], col[keep]
        d = np.concatenate([np.zeros(0), *(np.sqrt(((x[row[i : i + 65_536]] - q[col[i : i + 65_536]]) ** 2).sum(1)) for i in range(0, len(row), 65_536))])
        if radius is not None:
            near = d <= radius[col]
            row, col, d = row[near], col[near], d[near]
        order = np.lexsort((row, d, col))
        row, col, d = row[order], col[order], d[order]
        first = np.r_[0, np.nonzero(np.diff(col))[0] + 1] if len(col) else np.zeros(0, int)
        rank = np.arange(len(col)) - np.repeat(first, np.diff(np.r_[first, len(col)]))
        top = rank < k
        return col[top], row[top], d[top]


_FOUND = "a string, b string, distance double"


class Lists:
    """An inverted file: every vector with its list, its code and the code's error, encoded once."""

    def __init__(self, base: DataFrame, dims: int, radius: float | None, probes: int, keep: bool):
        """``base``: rows of cell_id, vec and asks. Rows that ask get the lists to look into. With ``keep`` the file is written, to be searched again.

        How many rows and queries a list has is estimated on the sample, only to decide into how many blocks it is cut.
        """
        n = base.count()
        n_lists = max(1, min(MOST_LISTS, math.ceil(n / LIST_ROWS)))
        x = packed_sample(base, n, dims, max(SAMPLE_ROWS, ROWS_EACH * n_lists))
        self.dims, self.radius, self.keep = dims, radius, keep
        self.ix = ix = Index(x, n_lists)
        own, _, cells = reach(x, ix.centroids, radius or 0.0, probes)
        count, each = len(ix.centroids), n / max(len(x), 1)
        held, asked = (np.bincount(z, minlength=count) * each for z in (own, cells))
        self.chunks, self.parts = (np.maximum(1, np.ceil(z / most)).astype(np.int64) for z, most in ((held, CHUNK_ROWS), (asked, QUERY_ROWS)))

        def place(t: pa.Table) -> pa.Table:
            v = unpacked(t["vec"], dims)
            asks = np.asarray(t["asks"].to_numpy(zero_copy_only=False), bool)
            own, rows, cells = reach(v, ix.centroids, radius or 0.0, probes)
            keep = asks[rows] & (cells != own[rows])
            codes, err = ix.encode(v, own)
            return pa.table([t["cell_id"], t["vec"], t["asks"], pa.array(own, pa.int32()), packed(codes), pa.array(err), ragged(rows[keep], cells[keep], len(v))], names=["cell_id", "vec", "asks", "own", "code", "err", "probes"])

        self.place, self.base = place, base.select("cell_id", "vec", "asks")
        if keep:
            schema = "cell_id string, vec binary, asks boolean, own int, code binary, err double, probes array<int>"
            self.base = written(self.base.mapInArrow(lambda it: batches(place, it), schema), "lists")

    def search(self, k: int, rerank: int, asks: DataFrame | None = None) -> DataFrame:
        """(a, b, distance) of the rows that ask, or of ``asks``: cell_id, vec, probes, radius.

        Every row of a list is sent to its block with its code (and again only where a list has more queries than a task takes);
        a query goes to the blocks of the other lists it probes, and to the other blocks of its own.
        """
        ix, dims, place, placed, chunks, parts = self.ix, self.dims, self.place, self.keep, self.chunks, self.parts
        own, radius = asks is None, self.radius
        exact = radius is not None or not own
        mix = np.random.default_rng(5).integers(1, 1 << 62, dims, np.uint64) * np.uint64(2) + np.uint64(1)

        def blocks(v: np.ndarray) -> np.ndarray:
            """A hash of each vector, which tells its block in any list."""
            with np.errstate(over="ignore"):
                h = (v.view(np.uint64) * mix).sum(1, dtype=np.uint64)
                h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            return (h >> np.uint64(20)).astype(np.int64)

        def spread(row: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Each row ``times`` times, with the number of the repeat."""
            r = np.repeat(row, times)
            return r, np.arange(len(r)) - np.repeat(np.cumsum(times) - times, times)

        def sent(t: pa.Table, rows: np.ndarray, list_: np.ndarray, chunk: np.ndarray, part: np.ndarray, base: bool, asks: np.ndarray, r: np.ndarray | None) -> pa.Table:
            take, n = pa.array(rows), len(rows)
            code, err = (t["code"].take(take), t["err"].take(take)) if base else (pa.nulls(n, pa.binary()), pa.nulls(n, pa.float64()))
            cols = [pa.array(z.astype(np.int32)) for z in (list_, chunk, part)]
            far = pa.nulls(n, pa.float64()) if r is None else pa.array(r)
            return pa.table([*cols, pa.array(np.full(n, base)), pa.array(asks), t["cell_id"].take(take), t["vec"].take(take), code, err, far], names=["list", "chunk", "part", "base", "asks", "cell_id", "vec", "code", "err", "radius"])

        def asking(t: pa.Table, h: np.ndarray, r: np.ndarray | None) -> pa.Table:
            probes = t["probes"].combine_chunks()
            to = np.asarray(probes.flatten().to_numpy(zero_copy_only=False), np.int64)
            row = np.repeat(np.arange(len(h)), np.asarray(probes.value_lengths().to_numpy(zero_copy_only=False), np.int64))
            i, chunk = spread(np.arange(len(row)), chunks[to])
            row, to = row[i], to[i]
            return sent(t, row, to, chunk, (h[row] // 1_009) % parts[to], False, np.ones(len(row), bool), None if r is None else r[row])

        def emit(t: pa.Table) -> pa.Table:
            t = t if placed else place(t)
            h, at = blocks(unpacked(t["vec"], dims)), t["own"].to_numpy().astype(np.int64)
            wants = np.asarray(t["asks"].to_numpy(zero_copy_only=False), bool) if own else np.zeros(len(h), bool)
            row, part = spread(np.arange(len(h)), parts[at])
            mine = (h[row] // 1_009) % parts[at[row]] == part
            r = np.full(len(h), radius) if radius is not None else None
            out = [sent(t, row, at[row], h[row] % chunks[at[row]], part, True, wants[row] & mine, None if r is None else r[row])]
            if own:
                out.append(asking(t, h, r))
                row, chunk = spread(np.nonzero(wants)[0], chunks[at[wants]])
                row, chunk = (z[chunk != h[row] % chunks[at[row]]] for z in (row, chunk))
                out.append(sent(t, row, at[row], chunk, (h[row] // 1_009) % parts[at[row]], False, np.ones(len(row), bool), None if r is None else r[row]))
            return pa.concat_tables(out)

        schema = "list int, chunk int, part int, base boolean, asks boolean, cell_id string, vec binary, code binary, err double, radius double"
        rows = self.base.mapInArrow(lambda it: batches(emit, it), schema)
        if not own:
            others = asks.mapInArrow(lambda it: batches(lambda t: asking(t, blocks(unpacked(t["vec"], dims)), t["radius"].to_numpy()), it), schema)
            rows = rows.unionByName(others)

        def find(t: pa.Table) -> pa.Table:
            base, asks = (t[c].to_numpy(zero_copy_only=False).astype(bool) for c in ("base", "asks"))
            if not base.any() or not asks.any():
                return pa.table([pa.array([], pa.string()), pa.array([], pa.string()), pa.array([], pa.float64())], names=["a", "b", "distance"])
            t = t.sort_by("cell_id")  # so that ties go to the smaller id
            base, asks = (t[c].to_numpy(zero_copy_only=False).astype(bool) for c in ("base", "asks"))
            v = unpacked(t["vec"], dims)
            at = np.nonzero(base)[0]
            xs, qs = t["cell_id"].take(pa.array(at)), np.nonzero(asks)[0]
            codes = unpacked(t["code"].take(pa.array(at)), len(ix.books), np.uint8)
            err = t["err"].take(pa.array(at)).to_numpy()
            if own:  # a query in the block of its own row is that row
                at_base = np.full(len(v), -1)
                at_base[at] = np.arange(len(at))
                same = at_base[qs]
            else:
                same = pc.fill_null(pc.index_in(t["cell_id"].take(pa.array(qs)), value_set=xs), -1).to_numpy()
            r = t["radius"].take(pa.array(qs)).to_numpy() if exact else None
            a, b, d = ix.search(v[qs], v[at], codes, err, t["list"][0].as_py(), same, k, r, rerank)
            return pa.table([t["cell_id"].take(pa.array(qs[a])), xs.take(pa.array(b)), pa.array(d, pa.float64())], names=["a", "b", "distance"])

        return rows.groupBy("list", "chunk", "part").applyInArrow(find, _FOUND)


def _best(found: DataFrame, k: int, by: str, to: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(by).orderBy("distance", to))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _searched(base: DataFrame, dims: int, k: int, radius: float | None, probes: int, exact: bool, rerank: int) -> DataFrame:
    """(a, b, distance) candidates between distinct vectors; ``base``: at least one row of cell_id, vec, asks."""
    again = exact and radius is None
    lists = Lists(base, dims, radius, probes, again)
    found = written(lists.search(k, rerank), "found")
    if not again:
        return found
    # the k-th distance so far bounds what is left: every list that may hold something nearer is looked into
    kth = _best(found, k, "a", "b").groupBy("a").agg(F.when(F.count(F.lit(1)) == k, F.max("distance")).otherwise(F.lit(float("inf"))).alias("radius"))
    left = lists.base.where("asks").select("cell_id", "vec").join(kth.withColumnRenamed("a", "cell_id"), "cell_id", "left").withColumn("radius", F.coalesce("radius", F.lit(float("inf"))))
    centroids = lists.ix.centroids

    def more(t: pa.Table) -> pa.Table:
        v, r = unpacked(t["vec"], dims), t["radius"].to_numpy() * (1 + 1e-12)
        _, rows, cells = reach(v, centroids, np.minimum(r, 1e150))
        return pa.table([t["cell_id"], t["vec"], ragged(rows, cells, len(v)), pa.array(r)], names=["cell_id", "vec", "probes", "radius"])

    bounded = written(left.mapInArrow(lambda it: batches(more, it), "cell_id string, vec binary, probes array<int>, radius double"), "bounded")
    return lists.search(k, rerank, bounded)


def nearest_vectors(
    vectors: DataFrame, k: int = 5, max_distance: float | None = None, probes: int = 8, query: str | None = None, rerank: int = 256, exact: bool = False
) -> DataFrame:
    """The k nearest other rows of every row: (cell_id, neighbour, distance, rank).

    ``vectors``: ``cell_id``, ``coords`` of one length. ``query`` (SQL over ``cell_id``) restricts who
    asks, never who is found. With ``max_distance`` neighbours beyond it are left out and the result
    is exact: lists are probed by a bound that misses nothing within it, and coding errors are allowed
    for. Without it the ``probes`` nearest lists are searched, with a small loss of recall; with ``exact`` all
    lists are then searched that may hold a vector nearer than the k-th found, so that nothing is missed however many lists there are.
    Ties go to the smaller id. Rows with a null id, or a vector that is null, holds null, NaN or infinity or has another
    length than most, take no part; repeated rows are one; an empty table gives an empty result; other
    columns are ignored.

    Rows with the same vector (told by a hash of 128 bits) are one entry of the index, so that groups of copies of any size cost
    nothing; a copy's nearest are the other copies with the smallest ids, then the neighbours of the
    entry. Lists and their queries are split into blocks of bounded size by sizes estimated beforehand.
    """
    asks: Column = F.coalesce(F.expr(query), F.lit(False)) if query else F.lit(True)
    v = pack(vectors.select("cell_id", "coords").withColumn("asks", asks), "asks")
    v = written(v.withColumn("_h", F.xxhash64("vec")).withColumn("_g", F.xxhash64(F.lit(7), "vec")), "vectors")
    dims = usual_length(v)
    if dims is None:
        return v.sparkSession.createDataFrame([], "cell_id string, neighbour string, distance double, rank int")
    v = v.where(F.col("dims") == dims)
    hot = written(v.groupBy("_h", "_g").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"), "copied")
    some = hot.count()
    if not some:
        found = _searched(v, dims, k, max_distance, probes, exact, rerank)
        return _best(found.select(F.col("a").alias("cell_id"), F.col("b").alias("neighbour"), "distance"), k, "cell_id", "neighbour")
    sent = (lambda df: F.broadcast(df)) if some <= MOST_SENT else (lambda df: df)
    keys = ["_h", "_g"]
    copies = written(v.select(*keys, "cell_id", "asks").join(sent(hot.select(*keys)), keys), "copies")
    groups = copies.groupBy(*keys).agg(F.min("cell_id").alias("rep"), F.count(F.lit(1)).alias("rows"), F.count_distinct("cell_id").alias("n"), F.max("asks").alias("some"))
    groups = written(groups, "groups")
    # of each entry only the k + 1 smallest ids can be among anybody's k nearest; blocks of copies meet their entry's neighbours apart
    parts = F.greatest(F.ceil(F.col("n") / COPY_ROWS), F.lit(1)).cast("int")
    spread = groups.select(*keys, "rep", parts.alias("parts"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    salts, again = groups.agg(F.max(parts), F.max(F.col("rows") > F.col("n"))).first()
    salted = spread.withColumn("salt", F.explode(F.expr(f"filter(sequence(0, {salts - 1}), s -> s % parts = part)")))
    salt = F.pmod(F.xxhash64("cell_id"), F.lit(salts)).cast("int")
    members = written(copies.withColumn("salt", salt).join(salted, [*keys, "salt"]).select("rep", "part", "cell_id", "asks").distinct(), "members")
    near = _best(members.select("rep", "cell_id", F.lit(0.0).alias("distance")), k + 1, "rep", "cell_id").select("rep", "cell_id")
    entries = v.join(sent(groups.select(*keys, "rep", "some")), keys, "left").where("rep IS NULL OR rep = cell_id")
    entries = entries.select("cell_id", "vec", F.coalesce("some", "asks").alias("asks"))
    found = _searched(entries.dropDuplicates(["cell_id"]) if again else entries, dims, k + 1, max_distance, probes, exact, rerank)
    own = groups.select(F.col("rep").alias("a"), F.col("rep").alias("b"), F.lit(0.0).alias("distance"))
    both = found.unionByName(own).join(near.withColumnRenamed("rep", "b"), "b", "left").select("a", F.coalesce("cell_id", "b").alias("neighbour"), "distance")
    both = written(_best(both, k + 1, "a", "neighbour").drop("rank"), "entries")
    reps = spread.select(F.col("rep").alias("a"), "part")
    plain = both.join(groups.select(F.col("rep").alias("a")), "a", "left_anti").withColumnRenamed("a", "cell_id")
    copied = both.join(reps, "a").join(members.where("asks").withColumnRenamed("rep", "a"), ["a", "part"]).select("cell_id", "neighbour", "distance")
    return _best(plain.select("cell_id", "neighbour", "distance").unionByName(copied.where("cell_id <> neighbour")), k, "cell_id", "neighbour")


def mutual_pairs(near: DataFrame) -> DataFrame:
    """Pairs of which each is among the other's nearest: (cell_id_a, cell_id_b, distance), smaller id first."""
    a = near.where("cell_id < neighbour").select(F.col("cell_id").alias("cell_id_a"), F.col("neighbour").alias("cell_id_b"), "distance")
    b = near.where("cell_id > neighbour").select(F.col("neighbour").alias("cell_id_a"), F.col("cell_id").alias("cell_id_b"))
    return a.join(b, ["cell_id_a", "cell_id_b"])
