import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from matrixloom.llm import clusters, mixing, neighbours, percentiles, proportions, select, space, subset


def vectors(spark, x, ids=None, extra=False):
    ids = ids if ids is not None else [f"c{i:05d}" for i in range(len(x))]
    rows = [(i, None if v is None else [None if u is None else float(u) for u in v], "z", 1) for i, v in zip(ids, x, strict=True)]
    d = spark.createDataFrame(rows, "cell_id string, coords array<double>, neighbour string, list int")
    return d if extra else d.select("cell_id", "coords")


DIRTY = [None, [], [1.0] * 3, [float("nan")] * 20, [None] * 20, [float("inf")] + [0.0] * 19]


# take_smallest and problem 1


def test_positions_are_exact_at_the_cuts(spark):
    old = select.SLICE_ROWS, select.SALT_ROWS
    select.SLICE_ROWS, select.SALT_ROWS = 10, 100
    try:
        rng = random.Random(1)
        rows = [("hot" if i % 3 else f"g{i % 7}", i, rng.randint(1, 5)) for i in range(900)]
        d = spark.createDataFrame(rows, "g string, id long, w long")
        full = d.withColumn("key", select.random_key(5, "id")).toPandas()
        for unit in (True, False):
            full["v"] = 1 if unit else full.w
            cuts = {g: sorted({int(p.v.sum()) // 5, int(p.v.sum()) // 2, int(p.v.sum())}) for g, p in full.groupby("g")}
            groups = spark.createDataFrame([("x", g, int((full.g == g).sum()), c) for g, c in cuts.items()], "r string, g string, n_rows long, cuts array<long>")
            dd = d.withColumn("w", F.lit(1).cast("long")) if unit else d
            got = select.positions(dd, groups, "g", ["r", "g"], select.random_key(5, "id"), "id", "w").toPandas().set_index("id")
            assert len(got) == 900
            for g, p in full.groupby("g"):
                cum = 0
                for r in p.sort_values(["key", "id"]).itertuples():
                    mid = cum + r.v / 2
                    assert sum(c <= mid for c in cuts[g]) == sum(c <= got._mid[r.id] for c in cuts[g])
                    cum += r.v
    finally:
        select.SLICE_ROWS, select.SALT_ROWS = old


def test_allocation():
    a = lambda *x: proportions.allocate(np.array(x[0], float), x[1], np.array(x[2]), np.array(x[3])).tolist()
    assert a([0.5, 0.3, 0.2], 10, [0, 0, 0], [99, 99, 99]) == [5, 3, 2]
    assert a([1 / 3, 1 / 3, 1 / 3], 10, [0, 0, 0], [99, 99, 99]) == [4, 3, 3]  # ties of remainders: the first
    assert a([0.9, 0.1], 10, [0, 3], [99, 99]) == [7, 3]  # a floor
    assert a([0.9, 0.1], 10, [0, 0], [4, 99]) == [4, 6]  # a cap: the rest takes over
    assert a([0.9, 0.1], 10, [0, 5], [99, 2]) == [8, 2]  # a floor that is not there
    assert a([0.5, 0.2], 10, [0, 0], [99, 99]) == [5, 2]  # shares below 1
    assert a([], 10, [], []) == [] and a([0.0], 5, [2], [9]) == [2]


def p1_tables(spark):
    cells = [(f"c{i}", f"B{i % 3}", ["t1", "t2", None][i % 3 - (i % 5 == 0)], ["pos", "neg"][i % 2] if i % 7 else None) for i in range(300)]
    cells += cells[:5] + [(None, "B0", "t1", "pos"), ("x", None, "t1", "pos")]
    c = spark.createDataFrame([(*r, 1, 2) for r in cells], "cell_id string, batch string, treatment string, mutation_status string, request_id int, quota int")
    t = [(1, 1, "B0", "t1", None, 0.5, 20, 0), (1, 2, "B0", "t2", None, 0.5, 20, 0), (2, 1, "B1", None, None, 0.9, 500, 3), (3, 1, "none", "t1", "pos", 0.5, 10, 2),
         (4, 1, "B2", None, "pos", None, None, None), (5, 1, "B0", "t1", None, 0.6, 10, 0), (5, 2, "B0", "t1", "pos", 0.4, 10, 0), (5, 2, "B0", "t1", "pos", 0.4, 10, 0)]
    s = spark.createDataFrame([(*r, 9) for r in t], "request_id long, stratum_no int, batch string, treatment string, mutation_status string, target_share double, sample_size int, min_cells int, available int")
    return c, s, {r[0]: r for r in cells if r[0]}, t


def test_proportions(spark):
    c, s, cells, targets = p1_tables(spark)
    report = {(r["request_id"], r["stratum_no"]): r for r in proportions.stratum_report(proportions.sampling_plan(c, s)).collect()}
    assert len(report) == 7
    for q, n, b, t, m, share, size, least in targets:
        have = sum(1 for x in cells.values() if x[1] == b and (t is None or x[2] == t) and (m is None or x[3] == m))
        want = max(math.floor((share or 0) * (size or 0) + 0.5), least or 0)
        r = report[q, n]
        assert (r["available"], r["wanted"], r["shortfall"]) == (have, want, max(want - have, 0)) and r["quota"] <= have
    rep = proportions.sampling_plan(c, s)
    got = proportions.stratified_sample(c, rep, 3).collect()
    assert len({(r[0], r[2]) for r in got}) == len(got)
    for r in got:
        x, t = cells[r["cell_id"]], next(t for t in targets if t[:2] == (r["request_id"], r["stratum_no"]))
        assert x[1] == t[2] and t[3] in (None, x[2]) and t[4] in (None, x[3])
    assert sum(r[0] == 1 for r in got) == 20 and sum(r[0] == 2 for r in got) == 100
    assert sorted(map(tuple, got)) == sorted(map(tuple, proportions.stratified_sample(c.repartition(7), rep, 3).collect()))
    for (q, n), r in report.items():
        assert r["quota"] == sum(x[:2] == (q, n) for x in got)
    assert proportions.stratum_report(proportions.sampling_plan(c.limit(0), s)).where("available = 0").count() == 7
    assert proportions.sampling_plan(c, s.limit(0)).count() == 0


def test_overlapping_strata_get_what_they_are_told(spark):
    kind = "cell_id string, batch string, treatment string, mutation_status string"
    c = spark.createDataFrame([(f"c{i}", "B", "t1", "m1") for i in range(100)], kind)
    t = spark.createDataFrame([(1, 1, "B", "t1", "m1", 0.2, 50, 0), (1, 2, "B", None, None, 0.8, 50, 0)], "request_id long, stratum_no int, batch string, treatment string, mutation_status string, target_share double, sample_size int, min_cells int")
    plan = proportions.sampling_plan(c, t)
    got = proportions.stratified_sample(c, plan).groupBy("stratum_no").count().collect()
    assert dict(map(tuple, got)) == {1: 10, 2: 40}
    # 10 cells for two strata that want 10 and 8 of the same: one is held to what is left, and the report tells
    rep = {r["stratum_no"]: r for r in proportions.stratum_report(proportions.sampling_plan(c.limit(10), t.withColumn("sample_size", F.lit(10)).withColumn("min_cells", F.lit(8)))).collect()}
    assert sum(r["quota"] for r in rep.values()) == 10 and sum(r["unfilled"] for r in rep.values()) == 6 and not any(r["shortfall"] for r in rep.values())
    assert proportions.share_out([3, 2], [0, 2], [3], [[True], [True]]) == [[1], [2]]  # floors first


# problem 2


def isolated(x, cat, radius):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    d[cat[:, None] != cat[None]] = np.inf
    np.fill_diagonal(d, np.inf)
    return set(np.nonzero(~(d <= radius).any(1))[0])


@pytest.mark.parametrize("block,node", [(2_048, 8_192), (16, 8_192), (16, 20)])
def test_subset(spark, block, node):
    rng = np.random.default_rng(4)
    x = np.vstack([rng.normal(m * 6, 0.5, (60, 5)) for m in range(3)] + [rng.uniform(-60, 60, (9, 5)), np.zeros((3, 5))])
    cat = np.array(["G1", "S"])[rng.integers(0, 2, len(x))]
    rows = [(f"c{i}", "A", str(cat[i]), x[i].tolist(), "clash", 1) for i in range(len(x))]
    rows += [rows[0], ("n1", "A", None, x[0].tolist(), "", 1), ("n2", None, "S", x[0].tolist(), "", 1), ("n3", "A", "S", None, "", 1), (None, "A", "S", x[0].tolist(), "", 1)]
    rec = spark.createDataFrame(rows, "cell_id string, batch string, category string, coords array<double>, node string, k int")
    req = spark.createDataFrame([(1, "A", 25, 2.0), (1, "A", 25, 2.0), (2, "none", 5, 2.0), (3, "A", 500, None), (4, "A", None, 2.0)], "request_id long, batch string, subset_size int, radius double")
    old, subset.BLOCK_ROWS, subset.NODE_ROWS = (subset.BLOCK_ROWS, subset.NODE_ROWS), block, node
    try:
        n = subset.nominees(rec, req)
        lone = {r["cell_id"] for r in n.where("request_id = 1 AND lone").collect()}
        assert lone == {f"c{i}" for i in isolated(x, cat, 2.0)} and len(lone) >= 6
        s = subset.varied_subset(n).collect()
        one = [r for r in s if r["request_id"] == 1]
        assert len(one) == 25 and len(lone & {r["cell_id"] for r in one}) >= 6 and sorted(r["position"] for r in one) == list(range(1, 26))
        if node > 200:  # with a single root every lump is in the subset; several roots rank apart
            assert {len({i for i in range(60 * m, 60 * m + 60)} & {int(r["cell_id"][1:]) for r in one}) > 0 for m in range(3)} == {True}
        assert len({r["cell_id"] for r in s if r["request_id"] == 3}) == len(x) and not any(r["request_id"] in (2, 4) for r in s)
        assert subset.nominees(rec.limit(0), req).count() == subset.nominees(rec, req.limit(0)).count() == 0
    finally:
        subset.BLOCK_ROWS, subset.NODE_ROWS = old


def test_subset_of_sixty_blocks(spark):
    rng = np.random.default_rng(8)
    x = np.vstack([rng.normal(m * 9, 1.0, (230, 3)) for m in range(4)] + [rng.uniform(-200, 200, (40, 3))])
    cat = np.array(["G1", "S"])[rng.integers(0, 2, len(x))]
    rec = spark.createDataFrame([(f"c{i}", "A", str(cat[i]), x[i].tolist()) for i in range(len(x))], "cell_id string, batch string, category string, coords array<double>")
    req = spark.createDataFrame([(1, "A", 12, 1.5)], "request_id long, batch string, subset_size int, radius double")
    old, subset.BLOCK_ROWS, subset.NODE_ROWS = (subset.BLOCK_ROWS, subset.NODE_ROWS), 16, 64
    try:
        n = subset.nominees(rec, req)
        got = n.collect()
        chosen = {r["cell_id"] for r in subset.varied_subset(n).collect()}
    finally:
        subset.BLOCK_ROWS, subset.NODE_ROWS = old
    assert {int(r["cell_id"][1:]) for r in got if r["lone"]} == isolated(x, cat, 1.5)
    assert len(chosen) == 12 and {cat[int(c[1:])] for c in chosen} == {"G1", "S"}


def test_subset_has_a_single_root(spark):
    rng = np.random.default_rng(5)
    x = rng.uniform(-6, 6, (240, 2))
    rec = spark.createDataFrame([(f"c{i}", "A", "S", x[i].tolist()) for i in range(len(x))], "cell_id string, batch string, category string, coords array<double>")
    req = spark.createDataFrame([(1, "A", 5, 2.0)], "request_id long, batch string, subset_size int, radius double")
    old, subset.BLOCK_ROWS, subset.NODE_ROWS = (subset.BLOCK_ROWS, subset.NODE_ROWS), 40, 20
    try:
        n = subset.nominees(rec, req).collect()
    finally:
        subset.BLOCK_ROWS, subset.NODE_ROWS = old
    c = x[[int(r["cell_id"][1:]) for r in n]]
    d = np.sqrt(((c[:, None] - c[None]) ** 2).sum(-1)) + 99 * np.eye(len(c))
    assert d.min() > 2.0 and sorted(r["place"] for r in n) == list(range(len(n)))
    assert len(n) > 5 and (np.sqrt(((x[:, None] - c[None]) ** 2).sum(-1)).min(1) <= 4.0).all()


# problem 3


def brute_knn(x, ids, k, most=None):
    out = {}
    for i in range(len(x)):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        near = sorted((float(d[j]), ids[j]) for j in range(len(x)) if ids[j] != ids[i] and (most is None or d[j] <= most))
        out[ids[i]] = near[:k]
    return out


def test_neighbours_within_a_distance_are_exact(spark):
    rng = np.random.default_rng(2)
    x = np.vstack([rng.normal(c, 1.0, (150, 20)) for c in (0, 0.5, 9)])
    x = np.vstack([x, x[:40] + rng.normal(0, 0.15, (40, 20)), np.repeat(x[5:6], 30, 0), x[7:9]])
    ids = [f"c{i:04d}" for i in rng.permutation(len(x))]
    df = vectors(spark, [*x, *DIRTY, x[0]], [*ids, "d1", "d2", "d3", "d4", "d5", "d6", ids[0]], extra=True)
    old = neighbours.LIST_ROWS, neighbours.CHUNK_ROWS, neighbours.QUERY_ROWS
    neighbours.LIST_ROWS, neighbours.CHUNK_ROWS, neighbours.QUERY_ROWS = 60, 30, 70
    try:
        near = neighbours.nearest_vectors(df, 5, 1.0, 1)
        got = {}
        for r in near.collect():
            got.setdefault(r["cell_id"], []).append((r["rank"], r["neighbour"], r["distance"]))
        want = brute_knn(x, ids, 5, 1.0)
        for i, w in want.items():
            g = sorted(got.get(i, []))
            assert [b for _, b in w] == [b for _, b, _ in g], i
            assert np.allclose([d for d, _ in w], [d for _, _, d in g])
        pairs = {(r[0], r[1]) for r in neighbours.mutual_pairs(near).collect()}
        near5 = {i: {b for _, b in w} for i, w in want.items()}
        assert pairs == {(a, b) for a in near5 for b in near5[a] if a < b and a in near5[b]} and len(pairs) > 40
        assert neighbours.nearest_vectors(df.limit(0), 5).count() == 0
    finally:
        neighbours.LIST_ROWS, neighbours.CHUNK_ROWS, neighbours.QUERY_ROWS = old


def test_recall_without_a_distance(spark):
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(rng.uniform(-20, 20, 20), 1.0, (500, 20)) for _ in range(6)])
    ids = [f"c{i:05d}" for i in range(len(x))]
    old, neighbours.LIST_ROWS = neighbours.LIST_ROWS, 150
    try:
        got = neighbours.nearest_vectors(vectors(spark, x), 5, probes=8, query="cast(substring(cell_id, 2) AS int) % 50 = 0").collect()
    finally:
        neighbours.LIST_ROWS = old
    assert {r["cell_id"] for r in got} == {i for i in ids if int(i[1:]) % 50 == 0}
    hit = 0
    for i in range(0, len(x), 50):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        d[i] = np.inf
        hit += len({ids[j] for j in np.argsort(d)[:5]} & {r["neighbour"] for r in got if r["cell_id"] == ids[i]})
    assert hit / (5 * len(range(0, len(x), 50))) >= 0.9


def test_reach_misses_nothing():
    rng = np.random.default_rng(0)
    x, c = rng.normal(0, 1, (2_000, 8)), rng.normal(0, 1, (40, 8))
    own, rows, cells = space.reach(x, c, 0.7)
    have = set(zip(rows.tolist(), cells.tolist(), strict=True))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    for i, j in zip(*np.nonzero(d <= 0.7), strict=True):
        assert (i, own[j]) in have


# problem 4


def test_percentiles(spark):
    rng = random.Random(4)
    rows = [("hot", round(rng.gauss(0, 3), 1), d) for d in range(4) for _ in range(400)] + [("b", float(i), 1) for i in range(5)] + [("one", -0.0, 1), ("one", 0.0, 2), (None, 7.0, 1)]
    bad = [("b", None, 1), ("b", float("nan"), 1), ("b", float("inf"), 2), ("b", float("-inf"), 2), ("gone", None, 1)]
    df = spark.createDataFrame([(*r, 1, "v") for r in rows + bad], "g string, x double, day int, n int, value string")
    probs = {"q05": 0.05, "q50": 0.5, "q99": 0.99, "q0": 0.0, "q1": 1.0}
    by_day = [percentiles.frequencies(df.where(F.col("day") == d), ["g"], "x") for d in range(4)]
    for freq in (percentiles.frequencies(df, ["g"], "x"), percentiles.merge_frequencies(*by_day)):
        got = {r["g"]: r for r in percentiles.percentiles(freq, ["g"], probs).collect()}
        assert set(got) == {"hot", "b", "one", None}
        for g in got:
            v = [x for a, x, _ in rows if a == g]
            assert got[g]["n_values"] == len(v)
            for name, p in probs.items():
                assert got[g][name] == pytest.approx(np.quantile(v, p), abs=1e-9)
    assert {r["g"] for r in percentiles.percentiles(by_day[1], ["g"], probs, least=20).collect()} == {"hot"}
    assert percentiles.percentiles(percentiles.frequencies(df.limit(0), ["g"], "x"), ["g"], probs).count() == 0
    rough = percentiles.percentiles(percentiles.frequencies(df, ["g"], "x", step=0.5), ["g"], probs).where("g = 'hot'").first()
    v = [x for a, x, _ in rows if a == "hot"]
    assert all(abs(rough[n] - np.quantile(v, p)) <= 0.25 + 1e-9 for n, p in probs.items())


# problem 5


def chained(x, radius):
    lab = space.local_components(x, radius)
    naive = list(range(len(x)))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)) <= radius
    todo = set(naive)
    comp = {}
    while todo:
        s = todo.pop()
        stack, seen = [s], {s}
        while stack:
            for j in np.nonzero(d[stack.pop()])[0]:
                if j not in seen:
                    seen.add(j)
                    stack.append(j)
        todo -= seen
        for j in seen:
            comp[j] = min(seen)
    assert len({(lab[i], comp[i]) for i in comp}) == len(set(comp.values())) == len(set(lab))
    return comp


@pytest.mark.parametrize("seed", range(4))
def test_groups_are_exact(spark, seed):
    rng = np.random.default_rng(seed)
    balls = [rng.normal(rng.uniform(-40, 40, 4), 1.5, (rng.integers(20, 80), 4)) for _ in range(8)]
    # pairs of lumps at about the radius from each other, chains, and thin dust
    base = rng.normal(0, 1.0, (50, 4))
    near = base + np.array([15.0 + rng.uniform(-4, 4), 0, 0, 0])
    chain = np.cumsum(rng.normal(0, 1, (60, 4)) * 4, 0) + 60
    dust = rng.uniform(-120, 120, (150, 4))
    x = np.vstack([*balls, base + 100, near + 100, chain, dust, np.repeat(dust[:1], 5, 0)])
    ids = [f"c{i:04d}" for i in rng.permutation(len(x))]
    old = clusters.WITNESSES, clusters.CHUNK_ROWS, clusters.CELL_ROWS
    clusters.WITNESSES, clusters.CHUNK_ROWS, clusters.CELL_ROWS = 2, 20, 25
    try:
        df = vectors(spark, [*x, None, [1.0]], [*ids, "n1", "n2"], extra=True)
        g = clusters.chained_groups(df, 10.0)
        got = {(r["cluster_key"], r["cell_id"]) for r in clusters.group_members(g, 5).collect()}
    finally:
        clusters.WITNESSES, clusters.CHUNK_ROWS, clusters.CELL_ROWS = old
    comp, members = chained(x, 10.0), {}
    for i, c in comp.items():
        members.setdefault(c, []).append(ids[i])
    assert got == {(min(m), i) for m in members.values() if len(m) >= 5 for i in m}


def test_groups_of_nothing_and_of_copies(spark):
    assert clusters.chained_groups(vectors(spark, []), 1.0).count() == 0
    g = clusters.chained_groups(vectors(spark, [[1.0, 2.0]] * 30), 1.0)
    assert clusters.group_members(g, 10).select("cluster_key").distinct().collect()[0][0] == "c00000"


def test_components(spark):
    rng = random.Random(5)
    edges = [(f"v{a}", f"v{b}") for a, b in ((rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200))] + [(f"p{i:03d}", f"p{i + 1:03d}") for i in range(100)] + [("s", "s")]
    got = dict(map(tuple, clusters.components(spark.createDataFrame(edges, "u string, v string")).collect()))
    adj = {}
    for a, b in edges:
        if a != b:
            adj.setdefault(a, set()).add(b)
            adj.setdefault(b, set()).add(a)
    for v in adj:
        seen, todo = {v}, [v]
        while todo:
            for w in adj[todo.pop()] - seen:
                seen.add(w)
                todo.append(w)
        assert got[v] == min(seen)


def test_groups_are_described(spark):
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(0, 0.5, (40, 3)), rng.normal(2, 0.5, (40, 3)), rng.normal(50, 0.2, (20, 3))])
    df = vectors(spark, x)
    m = clusters.group_members(clusters.chained_groups(df, 3.0), 5)
    levels = df.select("cell_id", F.when(F.col("cell_id") < "c00010", None).otherwise("S").alias("level"))
    parts, counts = clusters.describe_groups(m, df, levels, 1.5)
    p = parts.collect()
    assert sum(r["size"] for r in p) == 100 and len({r["cluster_key"] for r in p}) == 2 and len(p) >= 3
    assert all(len(r["medoids"]) == min(3, r["size"]) for r in p)
    assert {(r["level"], r["n"]) for r in counts.where("cluster_key = 'c00000'").collect()} == {(None, 10), ("S", 70)}


def test_loose_groups_are_split_until_tight(spark):
    rng = np.random.default_rng(2)
    # 14 lumps of a chain, each below a tenth of the group, and thin rows between them
    x = np.vstack([rng.normal(0, 0.2, (12, 3)) + [2.4 * i, 0, 0] for i in range(14)] + [[[2.4 * i + 1.2, 1.0, 0]] for i in range(13)])
    df = vectors(spark, x)
    groups = clusters.group_members(clusters.chained_groups(df, 3.0), 5)
    parts, _ = clusters.describe_groups(groups, df, df.select("cell_id", F.lit("S").alias("level")), 1.5)
    p = parts.collect()
    assert {r["cluster_key"] for r in p} == {"c00000"} and sum(r["size"] for r in p) == len(x)
    assert len(p) >= 7 and max(r["spread"] for r in p) <= 1.5
    want = (((x[:, None] - x[None]) ** 2).sum(-1) <= 1.5**2).sum(1)
    rows = df.withColumn("cluster_key", F.lit("k"))
    old, clusters.CHUNK_ROWS = clusters.CHUNK_ROWS, 20
    try:
        got = {r["cell_id"]: r["degree"] for r in clusters.degrees(rows, 1.5).collect()}
    finally:
        clusters.CHUNK_ROWS = old
    assert [got[r["cell_id"]] for r in df.orderBy("cell_id").collect()] == want.tolist()


# problem 7


def test_flow_prefers_first_uses():
    got = mixing.route([(("a",), 10), (("a", "b"), 10), (("b",), 5)], {"a": 20, "b": 5}, {"a": 3, "b": 3})
    assert got == {(0, "a"): 10, (1, "a"): 10, (2, "b"): 5}
    got = mixing.route([(("a", "b"), 10)], {"a": 15, "b": 15}, {"a": 2, "b": 2})
    assert sum(got.values()) == 20
    assert mixing.route([], {"a": 5}, {"a": 1}) == {}


def test_mix(spark):
    rng = random.Random(7)
    docs = [(i, rng.choice([["a"], ["b"], ["a", "b"], ["c"], [], None]), rng.randint(0, 50)) for i in range(400)] + [(900, ["a"], None), (901, ["z"], 10)]
    d = spark.createDataFrame([(*r, 5, "q") for r in docs], "doc_id long, sources array<string>, size long, routed int, pattern string")
    t = spark.createDataFrame([(1, "a", 0.5, 2, 1.0), (1, "b", 0.3, 1, 1.0), (1, "c", 0.2, 9, 1.0), (2, "c", 0.9, 1, 2.0), (2, "none", 0.1, 3, 2.0), (3, "a", None, None, None)], "mix_id int, source string, target_share double, max_repeats int, total_ratio double")
    plan = mixing.mix_plan(d, t)
    rep = {(r["mix_id"], r["source"]): r for r in mixing.mix_report(plan).collect()}
    size = lambda s: sum(z or 0 for _, m, z in docs if m and s in m)
    assert rep[2, "c"]["short"] and rep[2, "none"]["available"] == 0 and rep[2, "c"]["wanted"] == pytest.approx(0.9 * 2 * size("c"))
    assert not rep[3, "a"]["short"] and not rep[1, "c"]["short"]
    got = mixing.mix_documents(d, plan).collect()
    for (m, s), r in rep.items():
        mine = [g for g in got if (g["mix_id"], g["source"]) == (m, s)]
        assert abs(sum(g["size"] * g["uses"] for g in mine) - r["routed"]) <= 3 * 25
        assert all(g["uses"] <= {"a": 2, "b": 1, "c": 9}[s] for g in mine)
    assert mixing.mix_report(mixing.mix_plan(d.limit(0), t)).count() == 6 and mixing.mix_plan(d, t.limit(0)).count() == 0


def test_a_document_of_two_sources_is_used_once(spark):
    d = spark.createDataFrame([(i, ["a", "b", "other"] if i % 2 else ["b", "a"], 10) for i in range(200)], "doc_id long, sources array<string>, size long")
    t = spark.createDataFrame([(1, s, 0.25, 1, 1.0) for s in "ab"], "mix_id int, source string, target_share double, max_repeats int, total_ratio double")
    got = mixing.mix_documents(d, mixing.mix_plan(d, t)).collect()
    assert len({g["doc_id"] for g in got}) == len(got) == 200 and all(g["uses"] == 1 for g in got)
    assert sum(g["source"] == "a" for g in got) == 100
    more = mixing.mix_documents(d, mixing.mix_plan(d, t.withColumn("max_repeats", F.lit(3)).withColumn("total_ratio", F.lit(2.5)))).collect()
    uses = {}
    for g in more:
        uses[g["doc_id"]] = uses.get(g["doc_id"], 0) + g["uses"]
    assert set(uses.values()) == {2, 3} and sum(uses.values()) == 500


def test_exact_neighbours_without_a_distance(spark):
    rng = np.random.default_rng(6)
    x = np.vstack([rng.normal(rng.uniform(-5, 5, 12), 1.0, (120, 12)) for _ in range(5)])
    x = np.vstack([x, np.repeat(x[3:4], 9, 0)])
    ids = [f"c{i:05d}" for i in range(len(x))]
    old = neighbours.LIST_ROWS, neighbours.CHUNK_ROWS, neighbours.QUERY_ROWS
    neighbours.LIST_ROWS, neighbours.CHUNK_ROWS, neighbours.QUERY_ROWS = 40, 25, 30
    try:
        got = neighbours.nearest_vectors(vectors(spark, x), 4, probes=1, rerank=8, query="cast(substring(cell_id, 2) AS int) % 7 = 3", exact=True).collect()
    finally:
        neighbours.LIST_ROWS, neighbours.CHUNK_ROWS, neighbours.QUERY_ROWS = old
    want = {i: w for i, w in brute_knn(x, ids, 4).items() if int(i[1:]) % 7 == 3}
    assert {r["cell_id"] for r in got} == set(want)
    for i, w in want.items():
        mine = sorted((r["rank"], r["neighbour"]) for r in got if r["cell_id"] == i)
        assert [b for _, b in mine] == [b for _, b in w], i
