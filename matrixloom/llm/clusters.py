"""Problem 5: groups of vectors chained by distance, told by size, typical members and factor levels.

MinHash decides the overlap of sets, so every vector gets a set: tokens stand for places in space (lumps around
landmarks, and single rows), and a vector has the tokens it is linked to for certain. Two vectors that share a token
are in one group, whatever their distance. Bands of MinHash values give candidate pairs of sets, exact Jaccard
verifies them, connected components form groups, and exact distances then check what tokens cannot tell.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.relational import written
from .space import ROWS_EACH, SAMPLE_ROWS, batches, kmeans, local_components, matrix, pack, packed_sample, ragged, reach, sample, sq_distances, unpacked, usual_length

#: Landmarks (and as many single rows) and witnesses of one at most; rows of a task; rows aimed at in a cell of the thin rest; its cells at most.
MOST_LANDMARKS, WITNESSES, CHUNK_ROWS, CELL_ROWS, MOST_CELLS = 2_048, 24, 8_000, 1_500, 16_384
#: MinHash values of a token set; each is a band of its own, as any shared token is enough.
BANDS = 16


class Landmarks:
    """Centres of dense lumps found in a bounded sample, with sample rows of each as witnesses.

    All rows within half the radius of a centre are within the radius of each other, so they are one
    node without comparing any two of them.
    """

    def __init__(self, x: np.ndarray, radius: float, least: int = 4):
        self.radius = radius
        left, centres = np.ones(len(x), bool), []
        half = radius / 2
        while left.any() and len(centres) < MOST_LANDMARKS:
            rest = x[left]
            c = rest[0]
            for _ in range(4):  # move to the mean of what is near
                near = ((rest - c) ** 2).sum(1) <= half**2
                if not near.any():
                    break
                c = rest[near].mean(0)
            cover = ((rest - c) ** 2).sum(1) <= half**2
            if cover.sum() >= least:
                centres.append(c)
            cover[0] = True
            left[np.nonzero(left)[0][cover]] = False
        self.centres = np.array(centres).reshape(-1, x.shape[1])
        self.half = half * (1 - 1e-12)
        self.witness = []
        if len(self.centres):
            own, d = self.own(x)
            for j in range(len(self.centres)):
                w = x[(own == j)]
                self.witness.append(w[np.linspace(0, len(w) - 1, min(len(w), WITNESSES)).astype(int)] if len(w) else w)
        # lumps of which two witnesses are near enough are one from the start
        root = list(range(len(self.centres)))
        if root:
            for a, b in zip(*np.nonzero(np.tril(sq_distances(self.centres, self.centres) <= (2 * radius) ** 2, -1)), strict=True):
                wa, wb = self.witness[a], self.witness[b]
                if root[a] != root[b] and len(wa) and len(wb) and sq_distances(wa, wb).min() <= radius**2 - 1e-6:
                    old, new = max(root[a], root[b]), min(root[a], root[b])
                    root = [new if r == old else r for r in root]
        self.root = np.array(root, int)
        # single rows of the sample outside all lumps, none within the radius of another
        thin = x[self.own(x)[0] < 0] if root else x
        pivots = np.zeros((0, x.shape[1]))
        while len(thin) and len(pivots) < MOST_LANDMARKS:
            pivots = np.vstack([pivots, thin[:1]])
            thin = thin[sq_distances(thin[:1], thin)[0] > radius**2]
        self.pivots = pivots

    def own(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lump of each row, or -1, and the squared distances to all centres."""
        d = sq_distances(x, self.centres)
        a = d.argmin(1)
        exact = ((x - self.centres[a]) ** 2).sum(1)
        return np.where(exact <= self.half**2, a, -1), d

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Own lump of each row; sorted (row, token) pairs that are linked for certain; (row, lump) pairs left in doubt.

        Tokens are the lumps (those known to be one go by their smallest number) and, for rows of no lump, the single
        rows of the sample, numbered on.
        """
        own, linked, doubt = np.full(len(x), -1), [np.zeros((0, 2), int)], [np.zeros((0, 2), int)]
        if len(self.centres):
            own, d = self.own(x)
            inside = np.nonzero(own >= 0)[0]
            linked.append(np.stack([inside, self.root[own[inside]]], 1))
            # a lump lies within half the radius of its centre
            near = d <= (1.5 * self.radius) ** 2 + 1e-6
            near[inside] &= self.root[own[inside]][:, None] != self.root[None]
            for j in np.nonzero(near.any(0))[0]:
                rows, w = np.nonzero(near[:, j])[0], self.witness[j]
                hit = (sq_distances(x[rows], w) <= self.radius**2 - 1e-6).any(1) if len(w) else np.zeros(len(rows), bool)
                linked.append(np.stack([rows[hit], np.full(hit.sum(), self.root[j])], 1))
                doubt.append(np.stack([rows[~hit], np.full((~hit).sum(), j)], 1))
        outside = np.nonzero(own < 0)[0]
        if len(outside) and len(self.pivots):
            r, j = np.nonzero(sq_distances(x[outside], self.pivots) <= self.radius**2 - 1e-6)
            linked.append(np.stack([outside[r], j + len(self.centres)], 1))
        linked, doubt = np.unique(np.concatenate(linked), axis=0), np.concatenate(doubt)
        if len(doubt):
            n = len(self.centres) + len(self.pivots)
            doubt = doubt[~np.isin(doubt[:, 0] * n + self.root[doubt[:, 1]], linked[:, 0] * n + linked[:, 1])]
            doubt = doubt[np.lexsort((doubt[:, 1], doubt[:, 0]))]
        return own, linked, doubt


def _contracted(e: DataFrame) -> DataFrame:
    """Edges (u, v), v the smaller, after a large-star and a small-star step. Minima are combined on the map side."""
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    big = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    big = big.where("u <> v").distinct()
    low = big.groupBy("u").agg(F.min("v").alias("m"))
    small = big.join(low, "u")
    return small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """Connected components of (u, v) string edges: (id, root), root the smallest id of the component.

    Every round is written to the shared folder, and the rounds end when the edges are stars: every edge leads to a smallest
    id and every other id has one edge.
    """
    e = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while True:
        roots = e.groupBy("u").agg(F.count(F.lit(1)).alias("n"))
        tied = e.join(roots.select(F.col("u").alias("v")), "v", "left_semi").select(F.lit(1).alias("x"))
        if tied.unionByName(roots.where("n > 1").select(F.lit(1).alias("x"))).isEmpty():
            break
        e = written(_contracted(e), "edges")
    return e.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())


def token_groups(sets: DataFrame) -> dict[int, int]:
    """The group of every token, told by its smallest token, when sets that share a token are joined.

    ``sets``: ``tokens`` (distinct sorted arrays of ints, none empty). Every set has a MinHash value in each of ``BANDS`` bands; the sets
    of a bucket are paired with its smallest one only, pairs are verified by their exact Jaccard similarity (any overlap joins),
    and components come from star contraction. A token that is still in several groups, because all bands missed a pair,
    joins them in a further round, so the result is exact. The tokens, and so what is returned, number 4,096 at most.
    """
    s = written(sets.select(F.array_join("tokens", ",").alias("id"), "tokens").distinct(), "sets")
    one = lambda band: F.array_min(F.transform("tokens", lambda t: F.xxhash64(t, F.lit(band))))
    bands = s.select("id", "tokens", F.posexplode(F.array(*[one(b) for b in range(BANDS)])).alias("band", "value"))
    least = bands.groupBy("band", "value").agg(F.min("id").alias("rep"))
    pairs = bands.join(least, ["band", "value"]).where("id <> rep").select("id", "tokens", "rep").distinct()
    pairs = pairs.join(s.select(F.col("id").alias("rep"), F.col("tokens").alias("_t")), "rep")
    jaccard = F.size(F.array_intersect("tokens", "_t")) / F.size(F.array_union("tokens", "_t"))
    edges = pairs.where(jaccard > 0).select(F.col("id").alias("u"), F.col("rep").alias("v"))
    while True:
        roots = components(edges)
        per = s.join(roots, "id", "left").select(F.explode("tokens").alias("token"), F.coalesce("root", "id").alias("root"))
        per = written(per.groupBy("token").agg(F.min("root").alias("root"), F.max("root").alias("other")), "tokens")
        missed = per.where("root <> other").select(F.col("root").alias("u"), F.col("other").alias("v"))
        if missed.isEmpty():
            break
        edges = written(edges.unionByName(missed), "pairs")
    low = per.groupBy("root").agg(F.min("token").alias("low"))
    return dict(map(tuple, per.join(low, "root").select("token", "low").collect()))


def _union(pairs: list[tuple[int, int]], group: dict[int, int]) -> dict[int, int]:
    """Groups of tokens after joining further pairs of groups."""
    up = {g: g for g in group.values()}

    def top(g: int) -> int:
        while up[g] != g:
            up[g] = g = up[up[g]]
        return g

    for a, b in pairs:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {t: top(g) for t, g in group.items()}


def chained_groups(vectors: DataFrame, radius: float) -> DataFrame:
    """The group of every row: (cell_id, node, label).

    Rows at most ``radius`` apart, or joined by a chain of such rows, share a ``label``; a row without
    any near row has its own. ``node`` is the lump a row lies in (``#n``) or ``=`` and its own id.
    Exact for any data. Rows with a null id, or a vector that is null, holds null, NaN or infinity or has
    another length than most, take no part; a repeated row comes out as often as it comes in; an empty
    table gives an empty result; other columns are ignored.

    1. Every row gets its tokens: lumps around at most 2,048 landmarks of a sample, no two of whose rows are
       ever compared, and single rows of the sample. Rows sharing a token are in one group (:func:`token_groups`).
    2. Rows near a lump of another group but near no witness of it are compared with its rows, in blocks.
    3. The rows of no lump go to cells of a Voronoi partition together with all such rows within the radius of
       the cell, unless all of these are in one group already. What is near each other there is joined;
       the rows of the cell's largest group are split into blocks, as they need no comparison with each other.
    4. Groups and rows that cells connect are joined by star contraction.
    """
    spark = vectors.sparkSession
    v = written(pack(vectors), "vectors")
    dims = usual_length(v)
    if dims is None:
        return spark.createDataFrame([], "cell_id string, node string, label string")
    v = v.where(F.col("dims") == dims)
    marks = Landmarks(packed_sample(v, v.count(), dims), radius)

    def place(t: pa.Table) -> pa.Table:
        m = unpacked(t["vec"], dims)
        own, linked, doubt = marks.place(m)
        lists = [ragged(z[:, 0], z[:, 1], len(m)) for z in (linked, doubt)]
        return pa.table([t["cell_id"], t["vec"], pa.array(own, pa.int32()), *lists], names=["cell_id", "vec", "lump", "tokens", "doubt"])

    placed = v.select("cell_id", "vec").mapInArrow(lambda it: batches(place, it), "cell_id string, vec binary, lump int, tokens array<int>, doubt array<int>")
    placed = written(placed, "placed")
    group = token_groups(placed.where("size(tokens) > 0").select("tokens"))
    n_tokens = len(marks.centres) + len(marks.pivots)
    of_lump = {j: group.get(int(r), int(r)) for j, r in enumerate(marks.root)}

    def label(token: Column, known: dict[int, int]) -> Column:
        return F.get(F.array(*[F.lit(known.get(t, t)) for t in range(n_tokens)] or [F.lit(None).cast("int")]), token)

    # 2. doubts about lumps of other groups, lump by lump
    first = F.get("tokens", F.lit(0))
    asked = placed.select(F.explode("doubt").alias("to"), "cell_id", "vec", label(first, group).alias("group"))
    asked = asked.where(F.coalesce(F.col("group") != label(F.col("to"), of_lump), F.lit(True)))
    sizes = {r[0]: r[1] for r in placed.where("lump >= 0").groupBy("lump").count().collect()}
    n_asked = {r[0]: r[1] for r in asked.groupBy("to").count().collect()}
    hits = spark.createDataFrame([], "cell_id string, group int, to int")
    if n_asked:
        plan = [(j, max(1, math.ceil(sizes.get(j, 0) / CHUNK_ROWS)), max(1, math.ceil(n / CHUNK_ROWS))) for j, n in sorted(n_asked.items())]
        plan = F.broadcast(spark.createDataFrame(plan, "to int, chunks int, parts int"))
        h = F.xxhash64("cell_id")
        have = placed.where("lump >= 0").select(F.col("lump").alias("to"), "cell_id", "vec").join(plan, "to")
        have = have.select("to", F.pmod(h, "chunks").cast("int").alias("chunk"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(False).alias("asks"), "cell_id", "vec", F.lit(None).cast("int").alias("group"))
        want = asked.join(plan, "to").select("to", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.pmod(h, "parts").cast("int").alias("part"), F.lit(True).alias("asks"), "cell_id", "vec", "group")

        def test(t: pa.Table) -> pa.Table:
            asks = t["asks"].to_numpy(zero_copy_only=False).astype(bool)
            m = unpacked(t["vec"], dims)
            mid = m.mean(0)
            a, b = m[asks] - mid, m[~asks] - mid
            hit = np.zeros(len(a), bool)
            for i in range(0, len(a), 512):
                for j in range(0, len(b), 8192):
                    d = sq_distances(a[i : i + 512], b[j : j + 8192])
                    close = d <= radius**2
                    for p, q in zip(*np.nonzero(np.abs(d - radius**2) < 1e-6), strict=True):
                        close[p, q] = ((m[asks][i + p] - m[~asks][j + q]) ** 2).sum() <= radius**2 + 1e-9
                    hit[i : i + 512] |= close.any(1)
            keep = pa.array(np.nonzero(asks)[0][hit])
            return pa.table([t[c].take(keep) for c in ("cell_id", "group", "to")], names=["cell_id", "group", "to"])

        more = have.unionByName(want).groupBy("to", "chunk", "part").applyInArrow(test, "cell_id string, group int, to int")
        hits = written(more.withColumn("to", label(F.col("to"), of_lump)).distinct(), "hits")
        # a row of no group joins the groups it is near, a row of one joins that group with them: at most one pair for any two groups
        low = hits.groupBy("cell_id").agg(F.least(F.min("group"), F.min("to")).alias("low"))
        both = hits.select("cell_id", F.col("to").alias("g")).unionByName(hits.where("group IS NOT NULL").select("cell_id", F.col("group").alias("g")))
        group = _union([tuple(r) for r in both.join(low, "cell_id").where("g <> low").select("low", "g").distinct().collect()], {**of_lump, **group})
    known = {**of_lump, **group}

    # 3. the rows of no lump
    near = hits.where("group IS NULL").groupBy("cell_id").agg(F.min("to").alias("_near"))
    thin = placed.where("lump < 0").join(near, "cell_id", "left").select("cell_id", "vec", F.coalesce(label(first, known), label(F.col("_near"), known)).alias("group"))
    thin = written(thin, "thin")
    dense = placed.where("lump >= 0").select("cell_id", F.concat(F.lit("#"), F.col("lump").cast("string")).alias("node"), label(first, known).alias("group"))
    n_thin = thin.count()
    named = lambda known: F.concat(F.lit("#"), label(F.col("group"), known).cast("string"))
    if not n_thin:
        return dense.select("cell_id", "node", named(known).alias("label"))
    n_cells = max(1, min(MOST_CELLS, n_thin // CELL_ROWS))
    y = packed_sample(thin, n_thin, dims, max(SAMPLE_ROWS, ROWS_EACH * n_cells))
    cells = kmeans(y, n_cells) if len(y) else np.zeros((1, dims))

    def spread(t: pa.Table) -> pa.Table:
        m = unpacked(t["vec"], dims)
        _, rows, at = reach(m, cells, radius)
        return pa.table([t["cell_id"], t["vec"], t["group"], ragged(rows, at, len(m))], names=["cell_id", "vec", "group", "cells"])

    def local(t: pa.Table) -> pa.Table:
        t = t.sort_by("cell_id")
        lab = local_components(unpacked(t["vec"], dims), radius)
        return pa.table([t["node"], t["node"].take(pa.array(lab))], names=["u", "v"])

    there = written(thin.mapInArrow(lambda it: batches(spread, it), "cell_id string, vec binary, group int, cells array<int>"), "cells")
    node = F.coalesce(F.concat(F.lit("#"), F.col("group").cast("string")), F.concat(F.lit("="), "cell_id"))
    reached = there.select(F.explode("cells").alias("cell"), "cell_id", "group")
    per = reached.groupBy("cell", "group").agg(F.count(F.lit(1)).alias("n"))
    biggest = F.max(F.when(F.col("group").isNotNull(), F.struct("n", "group"))).alias("z")
    plan = per.groupBy("cell").agg(F.sum("n").alias("all"), biggest).select("cell", F.col("z.group").alias("main"), F.coalesce("z.n", F.lit(0)).alias("n"), "all")
    plan = F.broadcast(plan.where("all > n").select("cell", "main", F.greatest(F.ceil(F.col("n") / CHUNK_ROWS), F.lit(1)).cast("int").alias("chunks")))  # MOST_CELLS rows
    rows = there.select(F.explode("cells").alias("cell"), "cell_id", "vec", "group", node.alias("node")).join(plan, "cell")
    chunk = F.when(F.col("group").eqNullSafe(F.col("main")) & F.col("main").isNotNull(), F.array(F.pmod(F.xxhash64("cell_id"), "chunks").cast("int"))).otherwise(F.sequence(F.lit(0), F.col("chunks") - 1))
    stars = rows.select("cell", F.explode(chunk).alias("chunk"), "cell_id", "vec", "node").groupBy("cell", "chunk").applyInArrow(local, "u string, v string")
    joined = written(components(stars), "roots")

    # 4. the groups of tokens that cells connect, at most 4,096, and the rows of no group
    tied = joined.where(F.col("id").startswith("#")).select(F.substring("id", 2, 9).cast("int").alias("g"), "root")
    low = tied.groupBy("root").agg(F.min("g").alias("low"))
    final = _union([tuple(r) for r in tied.join(low, "root").where("g <> low").select("low", "g").collect()], known)
    lone = thin.where("group IS NULL").withColumn("id", node).join(joined, "id", "left").withColumn("root", F.coalesce("root", "id")).join(low, "root", "left")
    lone = lone.select("cell_id", F.col("id").alias("node"), F.coalesce(F.concat(F.lit("#"), label(F.col("low"), final).cast("string")), "root").alias("label"))
    tokened = thin.where("group IS NOT NULL").select("cell_id", F.concat(F.lit("="), "cell_id").alias("node"), named(final).alias("label"))
    return dense.select("cell_id", "node", named(final).alias("label")).unionByName(tokened).unionByName(lone)


def group_members(groups: DataFrame, least: int = 10) -> DataFrame:
    """Members of groups of ``least`` rows or more: (cluster_key, cell_id, node), keyed by the smallest id.

    Groups that contain tokens number 4,096 at most; their keys are joined by broadcast. The others hold
    no row of the sample nor any near one, and so no large share of the rows; they are joined by label.
    """
    g = written(groups, "groups")
    stats = written(g.groupBy("label").agg(F.min("cell_id").alias("cluster_key"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least), "sizes")
    lumped = F.col("label").startswith("#")
    big = g.where(lumped).join(F.broadcast(stats.where(lumped)), "label")
    rest = g.where(~lumped).join(stats.where(~lumped), "label")
    return big.unionByName(rest).select("cluster_key", "cell_id", "node")


def degrees(rows: DataFrame, near: float) -> DataFrame:
    """(cell_id, degree): how many rows of the same group lie within ``near`` of each row, itself included.

    Exact: a row is compared with the rows of every Voronoi cell that its ball meets, in blocks.
    """
    n = rows.count()
    x = sample(rows, n)
    dims = x.shape[1] if len(x) else 1
    cells = kmeans(x, max(1, min(MOST_CELLS, n // CHUNK_ROWS))) if len(x) else np.zeros((1, dims))

    def spread(t: pa.Table) -> pa.Table:
        m = matrix(t["coords"], dims)
        own, at, to = reach(m, cells, near)
        return pa.table([t["cluster_key"], t["cell_id"], t["coords"], pa.array(own, pa.int32()), ragged(at, to, len(m))], names=["cluster_key", "cell_id", "coords", "own", "cells"])

    out = "cluster_key string, cell_id string, coords array<double>, own int, cells array<int>"
    placed = written(rows.select("cluster_key", "cell_id", "coords").mapInArrow(lambda it: batches(spread, it), out), "reached")
    asked = placed.select("cluster_key", F.explode("cells").alias("cell"), "cell_id", "coords")
    owned = placed.select("cluster_key", F.col("own").alias("cell"), "cell_id", "coords")
    keys = ["cluster_key", "cell"]
    blocks = lambda df, name: df.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / CHUNK_ROWS).cast("int").alias(name))
    plan = written(blocks(owned, "chunks").join(blocks(asked, "parts"), keys), "blocks")
    h = F.xxhash64("cell_id")
    have = owned.join(plan, keys).select(*keys, F.pmod(h, "chunks").alias("chunk"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(False).alias("asks"), "cell_id", "coords")
    want = asked.join(plan, keys).select(*keys, F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.pmod(h, "parts").alias("part"), F.lit(True).alias("asks"), "cell_id", "coords")

    def count(t: pa.Table) -> pa.Table:
        asks = t["asks"].to_numpy(zero_copy_only=False).astype(bool)
        m = matrix(t["coords"], dims)
        m = m - m.mean(0)
        a, b = m[asks], m[~asks]
        k = np.zeros(len(a), np.int64)
        for i in range(0, len(a), 512):
            k[i : i + 512] = (sq_distances(a[i : i + 512], b) <= near**2 + 1e-9).sum(1)
        return pa.table([t["cell_id"].take(pa.array(np.nonzero(asks)[0])), pa.array(k)], names=["cell_id", "k"])

    counted = have.unionByName(want).groupBy(*keys, "chunk", "part").applyInArrow(count, "cell_id string, k long")
    return counted.groupBy("cell_id").agg(F.sum("k").alias("degree"))


#: New medoids of a loose part in a round, and rows of highest degree among which they are chosen. More rounds follow as needed.
NEW_MEDOIDS, AMONG = 8, 256


def _spread(dims: int) -> Column:
    """The root mean square distance of vectors from their mean."""
    return F.sqrt(sum((F.var_pop(F.get("coords", F.lit(i))) for i in range(dims)), F.lit(0.0)))


def split(rows: DataFrame, loose: float, dims: int) -> DataFrame:
    """(cluster_key, path, cell_id) of the rows of loose groups, in parts whose root mean square distance from the mean is ``loose`` at most.

    The first medoid of a group is the row of highest degree. In each round every part that is still
    too loose gets further medoids: its rows of highest degree among those further than ``loose`` from
    its medoid, and from each other. All its rows then go to the nearest. As a part without rows so far
    from its medoid is not loose, each loose part is split further, until there is none.
    """
    keys = ["cluster_key", "path"]
    rank = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.col("degree").desc(), "cell_id"))
    far = lambda x, y: F.aggregate(F.zip_with(x, y, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, z: s + z)
    rows = written(rows.select("cluster_key", "cell_id", "coords").join(degrees(rows, loose), "cell_id"), "degrees")
    first = rows.withColumn("_i", rank("cluster_key")).where("_i = 1").select("cluster_key", F.col("coords").alias("medoid"))
    now = rows.join(first, "cluster_key").withColumn("path", F.lit("0")).withColumn("d", far("coords", "medoid"))
    done = []

    def choose(t: pa.Table) -> pa.Table:
        t = t.sort_by([("degree", "descending"), ("cell_id", "ascending")])
        m = matrix(t["coords"], len(t["coords"][0]))
        taken: list[int] = []
        for i in range(len(m)):
            if len(taken) < NEW_MEDOIDS and (not taken or ((m[taken] - m[i]) ** 2).sum(1).min() > loose**2):
                taken.append(i)
        new = pa.array([m[taken].tolist()], pa.list_(pa.list_(pa.float64())))
        return pa.table([t["cluster_key"][:1], t["path"][:1], new], names=["cluster_key", "path", "new"])

    while True:
        now = written(now.select(*keys, "cell_id", "coords", "degree", "medoid", "d"), "split")
        per = now.groupBy(*keys).agg(_spread(dims).alias("s"))
        # a part with all rows near its medoid is within the limit, whatever the rounding
        wide = now.groupBy(*keys).agg(F.max("d").alias("m")).where(F.col("m") > loose**2)
        wide = written(per.where(F.col("s") > loose).join(wide, keys).select(*keys), "wide")
        done.append(now.join(wide, keys, "left_anti").select(*keys, "cell_id"))
        if wide.isEmpty():
            break
        now = now.join(wide, keys)
        top = now.where(F.col("d") > loose**2).withColumn("_i", rank(*keys)).where(F.col("_i") <= AMONG).select(*keys, "cell_id", "degree", "coords")
        new = top.groupBy(*keys).applyInArrow(choose, "cluster_key string, path string, new array<array<double>>")
        new = written(new, "medoids")
        at = F.array_min(F.transform("all", lambda y, i: F.struct(far("coords", y).alias("d"), i.alias("i"))))
        now = now.join(new, keys).withColumn("all", F.concat(F.array("medoid"), "new")).withColumn("_b", at)
        now = now.select("cluster_key", F.concat_ws(".", "path", F.col("_b.i").cast("string")).alias("path"), "cell_id", "coords", "degree", F.get("all", F.col("_b.i")).alias("medoid"), F.col("_b.d").alias("d"))
    out = done[0]
    for df in done[1:]:
        out = out.unionByName(df)
    return out


def describe_groups(members: DataFrame, vectors: DataFrame, levels: DataFrame, loose: float, typical: int = 3) -> tuple[DataFrame, DataFrame]:
    """Groups by size, most typical members and levels: (parts, level counts).

    ``parts``: (cluster_key, part, size, spread, medoids). A group whose rows lie further than ``loose``
    from its mean (root mean square) is split around the medoids of highest degree until every part is
    within ``loose`` (:func:`split`); its parts are numbered from 1. Other groups are part 0.
    Medoids are the ``typical`` rows nearest to the mean of their part. ``level counts``: (cluster_key,
    level, n) with null for unknown levels.
    """
    m = written(members.join(vectors.select("cell_id", "coords"), "cell_id").select("cluster_key", "cell_id", "coords"), "members")
    dims = (m.select(F.size("coords")).first() or (0,))[0]
    wide = written(m.groupBy("cluster_key").agg(_spread(dims).alias("spread")).where(F.col("spread") > loose).select("cluster_key"), "loose")
    paths = written(split(m.join(wide, "cluster_key"), loose, dims), "paths")
    numbers = paths.select("cluster_key", "path").distinct()
    numbers = numbers.withColumn("part", F.row_number().over(Window.partitionBy("cluster_key").orderBy("path")))
    own = paths.join(numbers, ["cluster_key", "path"]).select("cell_id", "part")
    m = written(m.join(own, "cell_id", "left").select("cluster_key", F.coalesce("part", F.lit(0)).alias("part"), "cell_id", "coords"), "parts")
    centre = F.array(*[F.avg(F.get("coords", F.lit(i))) for i in range(dims)]).cast("array<double>")
    parts = m.groupBy("cluster_key", "part").agg(F.count(F.lit(1)).alias("size"), _spread(dims).alias("spread"), centre.alias("centre"))
    far = F.aggregate(F.zip_with("coords", "centre", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, z: s + z)
    near = m.join(parts.select("cluster_key", "part", "centre"), ["cluster_key", "part"]).select("cluster_key", "part", "cell_id", far.alias("d"))
    top = near.withColumn("_i", F.row_number().over(Window.partitionBy("cluster_key", "part").orderBy("d", "cell_id"))).where(F.col("_i") <= typical)
    top = top.groupBy("cluster_key", "part").agg(F.array_sort(F.collect_list(F.struct("_i", "cell_id"))).alias("t"))
    parts = parts.join(top, ["cluster_key", "part"]).select("cluster_key", "part", "size", "spread", F.transform("t", lambda s: s["cell_id"]).alias("medoids"))
    counts = members.join(levels, "cell_id", "left").groupBy("cluster_key", "level").agg(F.count(F.lit(1)).alias("n"))
    return parts, counts
