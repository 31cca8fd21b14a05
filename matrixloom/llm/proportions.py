"""Problem 1: samples that match target proportions of categories."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.relational import written
from .flow import Flow
from .select import by_group, positions, random_key


def allocate(share: np.ndarray, size: int, floors: np.ndarray, available: np.ndarray) -> np.ndarray:
    """Whole quotas by largest remainder that respect floors and what is available.

    The strata together get ``round(size * sum(share))`` places, each at least its floor where it has
    as many. What a stratum cannot take goes to the others in proportion to their shares, until
    nothing moves. Ties of remainders go to the earlier stratum.
    """
    share = np.maximum(np.nan_to_num(share), 0.0)
    low = np.minimum(np.maximum(floors, 0), available)
    total = min(max(int(np.floor(size * share.sum() + 0.5)), int(low.sum())), int(available.sum()))
    quota, open_ = low.astype(np.int64).copy(), np.ones(len(share), bool)
    while True:
        # strata bound to a floor or a cap leave the division; the rest is divided anew
        rest = total - int(quota[~open_].sum())
        w = np.where(open_, share, 0.0)
        if rest <= 0 or not open_.any() or w.sum() <= 0:
            break
        ideal = rest * w / w.sum()
        over, under = open_ & (ideal >= available), open_ & (ideal <= low) & (low > 0)
        if over.any():
            quota[over], open_ = available[over], open_ & ~over
            continue
        if under.any():
            quota[under], open_ = low[under], open_ & ~under
            continue
        base = np.where(open_, np.floor(ideal), quota).astype(np.int64)
        left = total - int(base.sum())
        order = np.lexsort((np.arange(len(share)), -np.where(open_, ideal - base, -1.0)))
        base[[i for i in order if open_[i] and base[i] < available[i]][:left]] += 1
        quota = base
        break
    # places still free, as only strata without a share have room: in order, as far as they go
    return np.minimum(quota, available)


def share_out(quota: list[int], floors: list[int], counts: list[int], fits: list[list[bool]]) -> list[list[int]]:
    """Cells each stratum takes of each category (strata x categories), no cell twice; a maximum flow.

    Floors are served before the rest of the quotas; what a stratum has got it never loses again.
    """
    n, m = len(quota), len(counts)
    f = Flow(2 + n + m)
    ends = [f.edge(2 + i, 1, min(floors[i], quota[i])) for i in range(n)]
    for c in range(m):
        f.edge(0, 2 + n + c, counts[c])
    uses = {(i, c): f.edge(2 + n + c, 2 + i, counts[c]) for i in range(n) for c in range(m) if fits[i][c]}
    f.run(0, 1)
    for i, e in enumerate(ends):
        f.cap[e] += quota[i] - min(floors[i], quota[i])
    f.run(0, 1)
    return [[f.cap[uses[i, c] ^ 1] if (i, c) in uses else 0 for c in range(m)] for i in range(n)]


_PLAN = (
    "request_id long, stratum_no int, batch string, treatment string, mutation_status string, target_share double, sample_size int, min_cells int, "
    "available long, wanted long, quota long, category string, n_rows long, cuts array<long>, strata array<int>"
)


def _solve(rows: list[dict]) -> list[dict]:
    strata = sorted((r for r in rows if r["category"] is None), key=lambda r: (r["stratum_no"] is None, r["stratum_no"]))
    cats = sorted((r for r in rows if r["category"] is not None), key=lambda r: r["category"])
    counts = [r["n_rows"] for r in cats]
    fields = ("treatment", "mutation_status")
    fits = [[r["batch"] == c["batch"] and all(r[f] is None or r[f] == c[f] for f in fields) for c in cats] for r in strata]
    have = [sum(n for n, ok in zip(counts, f, strict=True) if ok) for f in fits]
    share = np.nan_to_num(np.array([r["target_share"] or 0.0 for r in strata], float))
    floors = np.array([max(r["min_cells"] or 0, 0) for r in strata], np.int64)
    size = max((r["sample_size"] or 0 for r in strata), default=0)
    caps = np.array(have, np.int64)
    while True:  # a stratum that others leave too few cells is held to what it got, and the rest is divided anew
        quota = allocate(share, int(size), floors, caps)
        got = share_out(quota.tolist(), np.minimum(floors, caps).tolist(), counts, fits)
        filled = np.array([sum(g) for g in got], np.int64)
        if (filled >= quota).all():
            break
        caps = np.where(filled < quota, filled, caps)
    out = []
    for i, r in enumerate(strata):
        wanted = max(int(np.floor(share[i] * (r["sample_size"] or 0) + 0.5)), r["min_cells"] or 0)
        out.append({**r, "available": have[i], "wanted": wanted, "quota": int(quota[i])})
    for c, r in enumerate(cats):
        takers = [i for i in range(len(strata)) if got[i][c]]
        if takers:
            cuts = np.cumsum([got[i][c] for i in takers]).tolist()
            out.append({"request_id": r["request_id"], "category": r["category"], "n_rows": r["n_rows"], "cuts": cuts, "strata": [strata[i]["stratum_no"] for i in takers]})
    return out


def _cells(cells: DataFrame) -> DataFrame:
    """The columns in use and the category of a cell; a null id is no cell, and a repeated row one."""
    c = cells.select("cell_id", "batch", "treatment", "mutation_status").where("cell_id IS NOT NULL AND batch IS NOT NULL").dropDuplicates(["cell_id"])
    return c.withColumn("category", F.to_json(F.struct("batch", "treatment", "mutation_status")))


def sampling_plan(cells: DataFrame, targets: DataFrame) -> DataFrame:
    """What each stratum of each request wants, has and gets, and from which categories.

    ``cells``: distinct ``cell_id`` with ``batch``, ``treatment``, ``mutation_status`` (levels, null if unknown);
    ``targets`` as in ``sample_targets``. Rows with a null ``category`` are those of the strata: the target columns with
    ``available``, ``wanted`` (the larger of share times size, rounded half up, and the minimum) and ``quota``. The others
    tell, for a combination of levels, how many of its cells (``cuts``, cumulative) go to which ``strata``.

    A null level in a stratum admits every cell, one of unknown level too. A cell that fits several strata is
    given to one: quotas by largest remainder are held against a maximum flow from categories to strata, and what
    a stratum cannot get that way goes to the others, so every quota is delivered in full. Null shares, sizes and
    minima count as 0. Without cells every stratum is reported with 0 available; without targets
    the result is empty. Repeated rows of a stratum are one. Cells are counted per category on the
    map side, so only category counts are shuffled. Other columns are ignored.
    """
    strata = targets.select(
        F.col("request_id").cast("long").alias("request_id"), F.col("stratum_no").cast("int").alias("stratum_no"), "batch", "treatment", "mutation_status", "target_share", "sample_size", "min_cells"
    ).dropDuplicates(["request_id", "stratum_no"])
    counts = _cells(cells).groupBy("batch", "treatment", "mutation_status", "category").agg(F.count(F.lit(1)).alias("n_rows"))
    asked = strata.select("request_id", "batch").distinct().join(counts, "batch")
    return by_group(strata.unionByName(asked, allowMissingColumns=True), "request_id", _solve, _PLAN)


def stratum_report(plan: DataFrame) -> DataFrame:
    """The strata of a :func:`sampling_plan` with ``shortfall`` (wanted but not there) and ``unfilled`` (wanted but not given), at least 0.

    ``unfilled`` is larger where other strata of the request take cells that would fit, or the size asked for is used up.
    """
    r = plan.where("category IS NULL").drop("category", "n_rows", "cuts", "strata")
    none = F.lit(0).cast("long")
    return r.withColumn("shortfall", F.greatest(F.col("wanted") - F.col("available"), none)).withColumn("unfilled", F.greatest(F.col("wanted") - F.col("quota"), none))


def stratified_sample(cells: DataFrame, plan: DataFrame, seed: int = 1) -> DataFrame:
    """The cells drawn for every stratum of a :func:`sampling_plan`: (request_id, stratum_no, cell_id).

    Of every category the cells with the smallest random keys are taken, first those of its first stratum, then
    those of the next, so a request never holds a cell twice and every stratum holds exactly its quota.
    """
    groups = written(plan.where("category IS NOT NULL").select("request_id", "category", "n_rows", "cuts", "strata"), "takes")
    placed = positions(
        _cells(cells).select("cell_id", "category", F.lit(1).cast("long").alias("_one")), groups, "category", ["request_id", "category"], random_key(seed, "request_id", "cell_id"), "cell_id", "_one"
    )
    at = F.size(F.filter("cuts", lambda c: c <= F.col("_mid")))
    return placed.select("request_id", F.get("strata", at).alias("stratum_no"), "cell_id", at.alias("_at"), F.size("cuts").alias("_n")).where("_at < _n").drop("_at", "_n")
