"""Problem 2: a varied subset by tournament-pivoted rank-revealing QR in deflated rounds."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.relational import written
from .space import batches, kmeans, matrix, nearest, ragged, reach, sample

#: Rows of a block at the leaves of the tournament; nominees looked for at a time when isolation is checked; cells of space then at most.
BLOCK_ROWS, NODE_ROWS, MOST_CELLS = 2_048, 8_192, 16_384


def pivots(x: np.ndarray, cat: np.ndarray, radius: float, least: int) -> np.ndarray:
    """Row numbers in the order in which pivoted QR in deflated rounds picks them.

    The feature row of a record is its centred vector in units of its overall spread, and an indicator of
    its category. A round picks the row of largest residual and takes its direction out of all rows,
    until the rest depends linearly on what is picked. Each pick deflates the table: records of its
    category within the radius are stood for and leave. Rounds repeat on what is left until every
    record is stood for, so that a record nothing else stands for is always picked. If that gives
    fewer than ``least``, rounds go on among those not picked with half the radius each time.
    """
    n = len(x)
    if not n:
        return np.zeros(0, int)
    mid = x - x.mean(0)
    kinds, code = np.unique(cat, return_inverse=True)
    feats = np.hstack([mid / max(float(np.sqrt((mid**2).sum(1).mean())), 1e-12), np.eye(len(kinds))[code]])
    picked: list[int] = []
    free = np.ones(n, bool)  # not picked
    while True:
        alive = free.copy()
        if radius >= 0 and picked and len(picked) < least:
            for p in picked:  # those stood for at the smaller radius
                alive &= ~((code == code[p]) & (((x - x[p]) ** 2).sum(1) <= radius**2))
        while alive.any():
            rows = np.nonzero(alive)[0]
            work = feats[rows].copy()
            res = (work**2).sum(1)
            limit, there = 1e-8 * float(res.max()), np.ones(len(rows), bool)
            for _ in range(feats.shape[1]):
                i = int(np.argmax(np.where(there, res, -1.0)))
                if not there[i] or res[i] <= limit:
                    break
                p = rows[i]
                picked.append(int(p))
                free[p] = False
                same = (code[rows] == code[p]) & (((x[rows] - x[p]) ** 2).sum(1) <= radius**2)
                same[i] = True
                there &= ~same
                alive[rows[same]] = False
                q = work[i] / math.sqrt(res[i])
                work -= np.outer(work @ q, q)
                res = (work**2).sum(1)
        if len(picked) >= min(least, n):
            return np.array(picked)
        radius = radius / 2 if radius > 1e-6 else -1.0
        if radius < 0:  # only copies are left
            return np.array(picked + list(np.nonzero(free)[0][: least - len(picked)]))


def _others_within(x: np.ndarray, cat: np.ndarray, ids: np.ndarray, to: np.ndarray, to_cat: np.ndarray, to_ids: np.ndarray, radius: float) -> np.ndarray:
    """For every row of ``to``: is there another row of its category within the radius?"""
    hit = np.zeros(len(to), bool)
    for c in np.unique(to_cat):
        a, b = np.nonzero(to_cat == c)[0], np.nonzero(cat == c)[0]
        for i in range(0, len(a), 256):
            p = a[i : i + 256]
            for j in range(0, len(b), 4096):
                q = b[j : j + 4096]
                d = np.zeros((len(p), len(q)))
                for k in range(x.shape[1]):
                    d += (to[p, k][:, None] - x[q, k][None]) ** 2
                hit[p] |= ((np.sqrt(d) <= radius) & (to_ids[p][:, None] != ids[q][None])).any(1)
    return hit


_ROW = "request_id long, block int, node int, k int, radius double, cell_id string, category string, coords array<double>, lone boolean, place int"


def _nominate(leaf: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("cell_id", kind="stable").reset_index(drop=True)
        x, cat = np.stack(pdf["coords"].to_numpy()).astype(float), pdf["category"].to_numpy().astype(str)
        radius = float(pdf["radius"].iloc[0])
        order = pivots(x, cat, radius, int(pdf["k"].iloc[0]))
        out = pdf.iloc[order].assign(place=np.arange(len(order), dtype=np.int32))
        if leaf:
            ids = pdf["cell_id"].to_numpy()
            out["lone"] = ~_others_within(x, cat, ids, x[order], cat[order], ids[order], radius)
        return out

    return run


def _seen(_, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    cols = ["request_id", "cell_id"]
    if not len(left) or not len(right):
        return pd.DataFrame({"request_id": pd.Series(dtype="int64"), "cell_id": pd.Series(dtype=object)})
    x, to = (np.stack(d["coords"].to_numpy()).astype(float) for d in (right, left))
    hit = _others_within(
        x, right["category"].to_numpy().astype(str), right["cell_id"].to_numpy(), to, left["category"].to_numpy().astype(str), left["cell_id"].to_numpy(), float(left["radius"].iloc[0])
    )
    return left.loc[hit, cols]


def _seen_elsewhere(lone: DataFrame, records: DataFrame) -> DataFrame:
    """(request_id, cell_id) of the nominees that have another record of their category within their radius.

    Records lie in the cells of a Voronoi partition fitted on a bounded sample; a nominee is looked for only in the
    cells its ball meets, which is few of them, however many blocks the request has. Records of a cell are cut into blocks.
    """
    n = records.count()
    x = sample(records, n)
    dims = x.shape[1] if len(x) else 1
    cells = kmeans(x, max(1, min(MOST_CELLS, math.ceil(n / BLOCK_ROWS)))) if len(x) else np.zeros((1, dims))

    def place(t: pa.Table) -> pa.Table:
        return t.append_column("cell", pa.array(nearest(matrix(t["coords"], dims), cells), pa.int32()))

    def spread(t: pa.Table) -> pa.Table:
        m = matrix(t["coords"], dims)
        _, rows, at = reach(m, cells, t["radius"].to_numpy())
        return t.append_column("cells", ragged(rows, at, len(m)))

    fields = "request_id long, cell_id string, category string, coords array<double>"
    have = written(records.mapInArrow(lambda it: batches(place, it), f"{fields}, cell int"), "placed")
    want = lone.mapInArrow(lambda it: batches(spread, it), f"{fields}, radius double, cells array<int>").withColumn("cell", F.explode("cells")).drop("cells")
    keys = ["request_id", "category", "cell"]
    plan = have.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("blocks"))
    nominees = want.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / NODE_ROWS).cast("int").alias("parts"))
    plan = written(plan.join(nominees, keys), "blocks")  # cells that are asked
    each = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    own = lambda c: F.pmod(F.xxhash64("cell_id"), c).cast("int")
    columns = [*keys, "cell_id", "coords"]
    have = have.join(plan, keys).select(*columns, own("blocks").alias("block"), each("parts").alias("part"))
    again = plan.select(*keys, F.col("blocks").alias("_b"), F.col("parts").alias("_p"))
    want = want.join(again, keys).select(*columns, "radius", each("_b").alias("block"), own("_p").alias("part"))
    by = [*keys, "block", "part"]
    return want.groupBy(*by).cogroup(have.groupBy(*by)).applyInPandas(_seen, "request_id long, cell_id string").distinct()


def nominees(records: DataFrame, requests: DataFrame) -> DataFrame:
    """The records that together stand for every record of a request, in the order of the final pivoting.

    ``records``: ``cell_id`` (unique), ``batch``, ``category``, ``coords``; ``requests``: ``request_id``,
    ``batch``, ``subset_size``, ``radius``. Returns ``request_id``, ``cell_id``, ``k``, ``node`` (of the last
    level), ``place`` (from 0) and ``lone``: no other record of the batch and category is within the
    radius. Records with a null in any of their fields take no part; a null radius counts as 0, a null
    or negative size as 0; a request of a batch without records gives nothing, repeated requests
    count once; other columns are ignored.

    Blocks of about 2,048 records nominate; the nominees of two blocks at a time are pivoted anew, up a
    tree to a single root, whatever the number of nominees. Whether a nominee is alone is told by its own
    block first and, only where a request has several blocks, by the cells of space within its reach after the tournament.
    """
    r = requests.select(
        "request_id", "batch", F.greatest(F.coalesce("subset_size", F.lit(0)), F.lit(0)).cast("int").alias("k"), F.greatest(F.coalesce("radius", F.lit(0.0)), F.lit(0.0)).alias("radius")
    ).dropDuplicates(["request_id"])
    full = records.select("cell_id", "batch", "category", "coords").where("cell_id IS NOT NULL AND category IS NOT NULL AND coords IS NOT NULL")
    rows = written(full.join(r, "batch").select("request_id", "k", "radius", "cell_id", "category", "coords"), "records")
    n = rows.groupBy("request_id").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("blocks"))
    most = n.agg(F.max("blocks")).first()[0] or 0
    rows = rows.join(n, "request_id").withColumn("block", F.pmod(F.xxhash64("cell_id"), "blocks").cast("int"))
    cols = [c.split()[0] for c in _ROW.split(", ")]
    leaf = rows.select("*", F.col("block").alias("node"), F.lit(None).cast("boolean").alias("lone"), F.lit(0).alias("place"))
    got = leaf.select(*cols).groupBy("request_id", "block").applyInPandas(_nominate(True), _ROW)
    if most > 1:
        got = written(got, "nominees")
        # so many halvings that a single root is left
        ups = n.select("request_id", F.ceil(F.log2("blocks")).cast("int").alias("ups"), "blocks")
        tree = got.join(ups.where("blocks > 1"), "request_id")
        for level in range(1, math.ceil(math.log2(most)) + 1):
            node = F.shiftright("block", level)
            up = tree.where(F.col("ups") >= level)
            done = tree.where(F.col("ups") < level)
            up = up.withColumn("node", node).select(*cols, "ups", "blocks").groupBy("request_id", "node").applyInPandas(_nominate(False), _ROW + ", ups int, blocks int")
            tree = written(done.select(*cols, "ups", "blocks").unionByName(up), f"level{level}")
        lone = tree.where("lone").select("request_id", "cell_id", "category", "coords", "radius")
        seen = _seen_elsewhere(lone, written(rows.where("blocks > 1").select("request_id", "cell_id", "category", "coords"), "others"))
        tree = tree.join(seen.withColumn("_seen", F.lit(True)), ["request_id", "cell_id"], "left")
        tree = tree.withColumn("lone", F.col("lone") & F.col("_seen").isNull()).select(*cols)
        one = got.join(ups.where("blocks = 1").select("request_id"), "request_id").select(*cols)
        got = one.unionByName(tree)
    return got.select("request_id", "cell_id", "k", "node", "place", "lone")


def varied_subset(chosen: DataFrame) -> DataFrame:
    """The first k nominees of each request in the order of the root's pivoting: (request_id, cell_id, position, lone).

    A record that nothing else stands for is a nominee for certain, but takes its place by what it adds, so that outliers
    do not displace whole regions where a request has fewer places than outliers.
    """
    w = Window.partitionBy("request_id").orderBy("place", "node", "cell_id")
    return chosen.withColumn("position", F.row_number().over(w)).where("position <= k").select("request_id", "cell_id", "position", "lone")
