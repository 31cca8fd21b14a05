import math
import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from matrixloom.bundle import Bundle, dense
from matrixloom.functions.palettes import colours_for, palette
from matrixloom.operators import counts as C
from matrixloom.operators import decompose as D
from matrixloom.operators import embed as E
from matrixloom.operators import explained as X
from matrixloom.operators import frames as V
from matrixloom.operators import grouped as G
from matrixloom.operators import retrieve as R
from matrixloom.sources import io as S


@pytest.fixture(scope="module")
def toy(spark):
    """Six features, five cells; one feature and one cell without counts, ties, nulls in the metadata."""
    m = np.array([[5, 0, 3, 0, 0], [0, 2, 3, 0, 0], [1, 1, 1, 0, 0], [0, 0, 0, 0, 0], [7, 0, 0, 2, 0], [2, 2, 0, 2, 0]], float)
    f = [(f"g{i}", i + 1, "AB"[i % 2], ["a", "b", "b", None, "e", "f"][i], float(i)) for i in range(6)]
    c = [(f"c{j}", j + 1, ["x", "y", "x", "y", None][j], [1.0, 2.0, None, 4.0, 5.0][j], 1.0, "k") for j in range(5)]
    features = spark.createDataFrame(f, "feature_id string, feature_ord int, kind string, symbol string, length double")
    cells = spark.createDataFrame(c, "cell_id string, cell_ord int, grp string, z double, one double, same string")
    a = [(f"g{i}", f"c{j}", float(m[i, j])) for i in range(6) for j in range(5) if m[i, j]]
    b = Bundle(features, cells).with_assay("counts", spark.createDataFrame(a, "feature_id string, cell_id string, value double"))
    return b, m


def as_dict(df, key, value):
    return {r[key]: r[value] for r in df.collect()}


def test_detection(toy):
    b, m = toy
    assert as_dict(C.nexprs(b), "cell_id", "n") == {f"c{j}": int((m[:, j] > 0).sum()) for j in range(5)}
    assert as_dict(C.nexprs(b, "feature", 1), "feature_id", "n") == {f"g{i}": int((m[i] > 1).sum()) for i in range(6)}
    assert as_dict(C.nexprs(b, detection_limit=-1), "cell_id", "n") == {f"c{j}": 6 for j in range(5)}
    assert set(as_dict(C.nexprs(b, features=[]), "cell_id", "n").values()) == {0}
    assert C.nexprs(b, cells=[]).count() == 0


def test_selectors(toy):
    b, _ = toy
    pick = lambda w, **k: [r[0] for r in R.select_features(b, w, **k).orderBy("ord").collect()]
    assert pick(["g4", "g1"]) == pick([5, 2]) == ["g4", "g1"]
    assert pick([False, True, False, False, True, False]) == pick(F.col("feature_id").isin("g1", "g4")) == ["g1", "g4"]
    assert pick(["b"], alias="symbol") == ["g1"]  # the first match
    assert len(pick(None)) == 6
    for bad, err in ((["no"], KeyError), ([0], ValueError), ([7], ValueError), ([1.5], ValueError), ([True], ValueError)):
        with pytest.raises(err):
            pick(bad)
    with pytest.raises(KeyError):
        pick(["a"], alias="none")


def test_lookup_order(toy, spark):
    b, m = toy
    clash = b.with_cells(b.cells.select("cell_id", F.lit(9.0).alias("g0")))
    assert R.retrieve_cell_info(b, None) == (None, None)
    assert set(as_dict(R.retrieve_cell_info(clash, "g0", assay_type="counts")[1], "cell_id", "value").values()) == {9.0}
    got = as_dict(R.retrieve_cell_info(clash, "g0", ("assays", "colData"), "counts")[1], "cell_id", "value")
    assert got == {f"c{j}": m[0, j] for j in range(5)}
    assert R.retrieve_cell_info(b, F.col("z") * 2)[0] == ""
    assert R.retrieve_cell_info(b, b.cells.select("cell_id", F.col("z").alias("mine")))[0] == "mine"
    alt = Bundle(b.features.withColumn("feature_id", F.concat("feature_id", F.lit("-R"))), b.cells, {"counts": b.need("counts").withColumn("feature_id", F.concat("feature_id", F.lit("-R")))})
    two = Bundle(b.features, b.cells, b.assays, alts={"other": alt})
    assert as_dict(R.retrieve_cell_info(two, "g4-R", assay_type="counts")[1], "cell_id", "value")["c0"] == 7
    with pytest.raises(KeyError, match="cannot find"):
        R.retrieve_cell_info(b, "nothing")
    assert as_dict(R.retrieve_feature_info(b, "c1", assay_type="counts")[1], "feature_id", "value") == {f"g{i}": m[i, 1] for i in range(6)}
    assert as_dict(R.retrieve_feature_info(b, "kind")[1], "feature_id", "value")["g1"] == "B"
    with pytest.raises(ValueError):
        R.factor_levels(b.cells, "cell_id", 3)
    with pytest.warns(UserWarning):
        R.attach(b.cells, "cell_id", "z", b.cells.select("cell_id", F.lit(1).alias("value")))


def test_accessors(toy, spark):
    b, _ = toy
    assert b.norm_exprs() is None and b.fpkm() is None and b.counts() is not None
    log = C.log_norm_counts(b, size_factors=b.cells.select("cell_id", F.lit(1.0).alias("size_factor")))
    assert log.exprs() is log.assays["logcounts"]
    assert log.set_fpkm(b.counts()).fpkm().count() == b.counts().count()
    cube = spark.createDataFrame([("g0", "c0", [1.0, 0.0, 2.0]), ("g1", "c1", [3.0])], "feature_id string, cell_id string, values array<double>")
    boot = b.set_bootstraps(cube)
    assert list(boot.bootstraps()) == ["bootstrap1", "bootstrap2", "bootstrap3"] and boot.bootstraps()["bootstrap2"].count() == 0
    assert list(boot.set_bootstraps(cube.where("feature_id = 'g1'")).bootstraps()) == ["bootstrap1"]
    with pytest.raises(KeyError):
        b.need("none")


def test_normalisation(toy):
    b, m = toy
    lib = m.sum(0)
    sf = as_dict(C.library_size_factors(b), "cell_id", "size_factor")
    assert np.allclose([sf[f"c{j}"] for j in range(5)], lib / lib.mean())
    with pytest.raises(Exception, match="positive"):
        C.normalize_counts(b, C.library_size_factors(b).withColumn("size_factor", -F.col("size_factor"))).collect()
    with pytest.raises(Exception, match="positive"):
        C.normalize_counts(b, C.library_size_factors(b).where("cell_id <> 'c0'")).collect()
    cpm = {(r[0], r[1]): r[2] for r in C.calculate_cpm(b).collect()}
    assert cpm["g0", "c0"] == pytest.approx(5e6 / 15)
    lengths = b.features.select("feature_id", (F.col("length") + 1).alias("length"))
    tpm = C.calculate_tpm(b, lengths).groupBy("cell_id").agg(F.sum("value").alias("s")).collect()
    assert all(r["s"] == pytest.approx(1e6) for r in tpm)
    avg = m.mean(1)
    ratio = np.median(m[avg > 0] / avg[avg > 0, None], 0)
    med = as_dict(C.median_size_factors(b), "cell_id", "size_factor")
    assert np.allclose([med[f"c{j}"] for j in range(5)], ratio / ratio.mean())
    some = Bundle(b.features, b.cells.where("cell_id <> 'c4'"), b.assays)
    a = as_dict(C.calculate_average(some), "feature_id", "average")
    s = lib[:4] / lib[:4].mean()
    assert np.allclose([a[f"g{i}"] for i in range(6)], (m[:, :4] / s).mean(1))


def test_quality_control(toy):
    b, m = toy
    q = {r["cell_id"]: r for r in C.per_cell_qc(b, {"A": F.col("kind") == "A"}, top=[1, 50]).collect()}
    for j in range(4):
        r = q[f"c{j}"]
        assert (r["sum"], r["detected"]) == (m[:, j].sum(), (m[:, j] > 0).sum())
        assert r["subsets_A_percent"] == pytest.approx(100 * m[::2, j].sum() / m[:, j].sum())
        assert r["percent_top_1"] == pytest.approx(100 * m[:, j].max() / m[:, j].sum()) and r["percent_top_50"] == pytest.approx(100)
    assert (q["c4"]["sum"], q["c4"]["detected"], q["c4"]["percent_top_1"]) == (0, 0, None)
    f = {r["feature_id"]: r for r in C.per_feature_qc(b).collect()}
    assert all(f[f"g{i}"]["mean"] == pytest.approx(m[i].mean()) and f[f"g{i}"]["detected"] == pytest.approx(100 * (m[i] > 0).mean()) for i in range(6))
    cum = {(r[0], r[1]): r[2] for r in C.top_cumprop(b, [3, 1, 2, 9]).collect()}
    for j in range(4):
        s = np.cumsum(np.sort(m[:, j])[::-1]) / m[:, j].sum() * 100
        assert [cum[f"c{j}", p] for p in (1, 2, 3, 9)] == pytest.approx([s[0], s[1], s[2], s[5]])
    assert cum["c4", 1] is None
    assert {(r[0], r[1]): r[2] for r in C.cumulative_shares(b, 9).collect()}["c0", 9] == pytest.approx(100)


def test_outliers(spark):
    v = [1.0, 2.0, 3.0, 4.0, 100.0, None]
    d = spark.createDataFrame([(i, x, "a") for i, x in enumerate(v)] + [(9, 50.0, None)], "cell_id int, x double, batch string")
    got = as_dict(C.is_outlier(d, "x", batch="batch"), "cell_id", "outlier")
    assert got == {0: False, 1: False, 2: False, 3: False, 4: True, 5: False, 9: False}
    assert as_dict(C.is_outlier(d, "x", type="lower", batch="batch"), "cell_id", "outlier")[4] is False
    with pytest.raises(ValueError):
        C.is_outlier(d, "x", type="none")
    qc = spark.createDataFrame([(i, 1000.0 + i, 50 + i % 3, 1.0) for i in range(20)] + [(99, 1.0, 50, 90.0)], "cell_id int, sum double, detected int, pct double")
    q = {r["cell_id"]: r for r in C.quick_per_cell_qc(qc, ["pct"]).collect()}
    assert q[99]["low_lib_size"] and q[99]["high_pct"] and q[99]["discard"] and not q[3]["discard"]


def test_sums_over_groups(toy, spark):
    b, m = toy
    s = {(r["feature_id"], r["grp"]): (r["value"], r["ncells"]) for r in C.sum_across_cells(b, ["grp"]).collect()}
    assert s["g0", "x"] == (8, 2) and ("g3", "x") not in s and all(g for _, g in s)
    sets = spark.createDataFrame([("p", "g0"), ("p", "g1"), ("q", "g1"), ("q", "g1"), (None, "g0")], "set_id string, feature_id string")
    t = {(r[0], r[1]): r[2] for r in C.sum_across_features(b, sets).collect()}
    assert t["p", "c2"] == 6 and t["q", "c2"] == 3
    assert {(r[0], r[1]): r[2] for r in C.num_detected_across_features(b, sets).collect()}["p", "c2"] == 2
    g = C.aggregate_across_cells(b.with_reduced("E", b.cells.select("cell_id", F.array("one", "one").alias("coords"))), ["grp"])
    assert {r["cell_id"]: r["same"] for r in g.cells.collect()} == {"x": "k", "y": "k"} and as_dict(g.reduced["E"], "cell_id", "coords")["x"] == [1.0, 1.0]
    assert {r["feature_id"] for r in C.aggregate_across_features(b, "kind").features.collect()} == {"A", "B"}
    u = as_dict(C.uniquify_feature_names(b.features, "symbol"), "feature_id", "unique_name")
    assert u == {"g0": "a", "g1": "b_g1", "g2": "b_g2", "g3": "g3", "g4": "e", "g5": "f"}


def test_variance_and_ranks(toy):
    b, m = toy
    v = C.feature_variance(b.need("counts"), b.features, 5)
    assert np.allclose([x for _, x in sorted(as_dict(v, "feature_id", "variance").items())], m.var(1, ddof=1))
    flat = v.withColumn("variance", F.lit(1.0))
    assert [r[0] for r in C.top_features(flat, "variance", 2).orderBy("ord").collect()] == ["g0", "g1"]
    assert C.top_features(v, "variance", 0).count() == 0 and C.top_features(v, "variance", math.inf).count() == 6


def test_explained_variance(toy):
    b, m = toy
    with warnings.catch_warnings(record=True) as w:
        warnings.simplefilter("always")
        e = X.get_variance_explained(b, ["grp", "z", "one", "same"], assay_type="counts")
        got = {(r[0], r[1]): r[2] for r in e.collect()}
    assert len([x for x in w if "fewer than 2" in str(x.message)]) == 2
    z, keep = np.array([1, 2, 4, 5.0]), [0, 1, 3, 4]
    for i in (0, 1, 2, 4, 5):
        assert got[f"g{i}", "z"] == pytest.approx(100 * np.corrcoef(z, m[i, keep])[0, 1] ** 2)
        y, g = m[i, :4], np.array([0, 1, 0, 1])
        if y.var() > 0:
            rss = sum(((y[g == k] - y[g == k].mean()) ** 2).sum() for k in (0, 1))
            assert got[f"g{i}", "grp"] == pytest.approx(100 * (1 - rss / ((y - y.mean()) ** 2).sum()))
    assert got["g3", "z"] is None and got["g0", "one"] is None and got["g0", "same"] is None
    top = [r[0] for r in X.top_variables(e).collect()]
    assert set(top) == {"z", "grp"} and X.top_variables(e, 0).count() == 0 and X.top_variables(e, 1).count() == 1
    assert X.top_variables(e, least=1e9).count() == 0


def test_groups_and_scaling(toy):
    b, m = toy
    s = {(r["feature_id"], r["group"]): r for r in G.group_summaries(b, None, "grp", assay_type="counts").collect()}
    assert len(s) == 12 and s["g3", "x"]["mean"] == 0 and s["g4", "y"]["mean"] == 1 and s["g4", "y"]["detected"] == 0.5
    assert {r["group"] for r in G.group_summaries(b, ["g1"], None, assay_type="counts").collect()} == {"all"}
    d = dense(b.need("counts"), R.select_features(b, ["g0", "g3"]), b.cells)
    z = {(r["feature_id"], r["cell_id"]): r["value"] for r in G.scale_rows(d, center=True, scale=True, zlim=(-1, 1)).collect()}
    x = (m[0] - m[0].mean()) / m[0].std(ddof=1)
    assert [z["g0", f"c{j}"] for j in range(5)] == pytest.approx(np.clip(x, -1, 1)) and z["g3", "c0"] is None
    assert G.colour_scale(d, colours=4).first()["breaks"] == pytest.approx([0, 1.25, 2.5, 3.75, 5])
    dots = G.dots(b, ["g0"], "grp", max_detected=0.4, assay_type="counts").collect()
    assert {r["NumDetected"] for r in dots} == {0.4, 0.0}


def test_block_correction_against_least_squares(spark):
    rng = np.random.default_rng(0)
    combos = [("a", 1), ("a", 2), ("b", 1), ("b", 3), ("c", 2), ("c", 3)]
    y = rng.normal(size=len(combos))
    d = spark.createDataFrame([("f", 1, g, k, float(v), 10) for (g, k), v in zip(combos, y, strict=True)], "feature_id string, ord int, group string, block int, mean double, ncells long")
    x = np.array([[g == q for q in "abc"] + [k == q for q in (1, 2, 3)] for g, k in combos], float)
    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    got = as_dict(G.correct_blocks(d, "mean"), "group", "mean")
    assert [got[g] for g in "abc"] == pytest.approx(beta[:3] + beta[3:].mean())


def test_relative_log_expression(toy):
    b, m = toy
    dev = m - np.median(m, 1, keepdims=True)
    got = {r["Cell"]: r for r in V.rle(b, "counts").collect()}
    for j in range(5):
        q = np.quantile(dev[:, j], [0, 0.25, 0.5, 0.75, 1])
        assert [got[f"c{j}"][k] for k in ("q0", "q25", "q50", "q75", "q100")] == pytest.approx(q)
        assert got[f"c{j}"]["upper"] == pytest.approx(min(q[4], q[3] + 1.5 * (q[3] - q[1])))
    full = {(r[0], r[1]): r[2] for r in V.rle(b, "counts", style="full").collect()}
    assert full["c4", "g2"] == dev[2, 4] and len(full) == 30


def test_frames(toy):
    b, m = toy
    h = V.highest_exprs(b, 2, drop_features=["g4"], assay_type="counts").collect()
    assert {r["Tag"] for r in h} == {"g0", "g5"} and len(h) == 10
    assert next(r for r in h if r["Cell"] == "c0" and r["Tag"] == "g0")["value"] == pytest.approx(100 * 5 / 15)
    assert next(r for r in h if r["Cell"] == "c4")["value"] is None
    assert V.plot_kind(V.col_data(b, "z", "grp")) == "violin" and V.plot_kind(V.col_data(b, "z", "one")) == "scatter"
    kind, layer = V.central(V.col_data(b, "same", "grp"))
    assert kind == "rectangles" and layer.count() == 5  # the points, with the widths of their rectangle
    assert all(abs(r["jitter_x"]) <= r["half_width"] and abs(r["jitter_y"]) <= r["half_height"] for r in layer.where("half_width IS NOT NULL").collect())
    with pytest.raises(ValueError):
        V.central(V.col_data(b, "z", "one", colour_by="grp"), bins=3)
    assert V.central(V.col_data(b, "z", "one", colour_by="z"), bins=3)[1].agg(F.sum("n")).first()[0] == 4
    x = V.expression(b, ["g0", "g4"], log2_values=True, assay_type="counts", colour_by="grp")
    assert x.count() == 10 and x.where("cell_id = 'c0' AND Feature = 'g4'").first()["Y"] == 3
    o = V.heatmap(b, ["g0"], order_columns_by=["grp"], assay_type="counts").orderBy("column").collect()
    assert [r["Cell"] for r in o] == ["c4", "c0", "c2", "c1", "c3"]
    w = V.plate_position(b.cells, F.when(F.col("cell_ord") > 1, F.concat(F.lit("C"), F.col("cell_ord"))))
    assert as_dict(w, "cell_id", "X") == {"c0": None, "c1": 2, "c2": 3, "c3": 4, "c4": 5}
    with pytest.raises(Exception, match="malformed"):
        V.plate_position(b.cells, F.lit("AA1")).collect()
    assert R.per_cell_frame(b, ["g0"], "counts").where("cell_id = 'c4'").first()["g0"] == 0
    with pytest.raises(KeyError):
        R.per_feature_frame(b, ["nobody"], "counts")
    k = G.density(b.cells, "z", None, 0.0, 6.0, 200, width=0.5).agg(F.sum("density")).first()[0] * 6 / 199
    assert k == pytest.approx(1, abs=0.1)


def test_palettes():
    assert palette("colourblind10") == palette("colorblind10") and len(palette("tableau20")) == 20
    assert len(set(colours_for(list(range(12))).values())) == 12 and colours_for([], True) == colours_for(list(range(30))) == "viridis"


@pytest.fixture(scope="module")
def mock(spark):
    b = S.mock_bundle(spark, 60, 80)
    return C.log_norm_counts(b)


def matrix(b, assay):
    p = dense(b.need(assay), R.select_features(b, None), b.cells).toPandas().pivot(index="cell_id", columns="feature_id", values="value")
    return p


def test_components(mock):
    p = matrix(mock, "logcounts")
    x = p.to_numpy() - p.to_numpy().mean(0)
    u, s, _ = np.linalg.svd(x, full_matrices=False)
    b = D.run_pca(mock, 5)
    a = b.attrs["PCA"]
    assert a["varExplained"] == pytest.approx(s[:5] ** 2 / 59)
    y = np.array([r[1] for r in b.reduced["PCA"].orderBy("cell_id").collect()])
    assert np.allclose(np.abs(y), np.abs((u * s)[:, :5]), atol=1e-6)
    assert sum(D.calculate_pca(mock, 80, ntop=None)[1]["percentVar"]) == pytest.approx(100)
    assert len(D.calculate_pca(mock, 50, ntop=7)[1]["varExplained"]) == 7
    s1 = D.calculate_pca(mock, 3, scale=True)[1]
    sd = x.std(0, ddof=1)
    z = x[:, sd**2 >= 1e-8] / sd[sd**2 >= 1e-8]
    assert s1["varExplained"] == pytest.approx(np.linalg.svd(z, compute_uv=False)[:3] ** 2 / 59)
    m, attrs = D.calculate_mds(mock, 2)
    ym = np.array([r[1] for r in m.orderBy("cell_id").collect()])
    assert np.allclose(np.abs(ym), np.abs(y[:, :2]), atol=1e-6) and attrs["eig"][0] == pytest.approx(s[0] ** 2)
    full, more = D.calculate_mds(mock, 2, keep_dist=True)
    assert np.allclose(np.abs([r[1] for r in full.orderBy("cell_id").collect()]), np.abs(ym), atol=1e-5) and more["dist"].shape == (60, 60)
    assert D.calculate_mds(mock, 2, distance="manhattan")[0].count() == 60
    with pytest.raises(TypeError):
        D.calculate_mds(mock, keep_dist="yes")
    e = X.get_explanatory_pcs(b, n_dimred=3, variables=["Treatment"]).collect()
    assert len(e) == 3 and all(0 <= r["pct"] <= 100 for r in e)
    again = D.calculate_pca(b, 2, dimred="PCA", n_dimred=3)[1]
    assert again["varExplained"] == pytest.approx(a["varExplained"][:2])
    with pytest.raises(ValueError):
        V.reduced_dim(b, "PCA", 9)
    assert V.reduced_dim(b, "PCA", 2, text_by="Cell_Cycle")[2][0].startswith("PCA 1 (")
    assert V.reduced_pairs(b.reduced["PCA"], 3).count() == 60 * 6


def test_metadata_components(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(80, 3))
    x[0] = 40
    c = spark.createDataFrame([(f"c{i}", i, *map(float, r), 1.0) for i, r in enumerate(x)], "cell_id string, cell_ord int, a double, b double, d double, flat double")
    b = D.run_coldata_pca(Bundle(c.limit(0), c), ["a", "b", "d", "flat"], outliers=True)
    assert len(b.attrs["PCA_coldata"]["percentVar"]) == 2 and max(b.attrs["PCA_coldata"]["percentVar"]) <= 1
    assert as_dict(b.cells, "cell_id", "outlier")["c0"]


def test_factors(mock):
    y, attrs = D.calculate_nmf(mock, 3, assay_type="counts", ntop=30)
    w = np.array([r[1] for r in y.orderBy("cell_id").collect()])
    names = list(attrs["basis"])
    h = np.array([attrs["basis"][n] for n in names])
    x = matrix(mock, "counts")[names].to_numpy()
    assert (w >= 0).all() and (h >= 0).all()
    assert np.linalg.norm(x - w @ h.T) < 0.75 * np.linalg.norm(x - x.mean(0))


def test_layouts_keep_groups_apart(spark):
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(0, 0.3, (40, 6)), rng.normal(8, 0.3, (40, 6))])
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "cell_id int, coords array<double>")
    c = v.select("cell_id", F.col("cell_id").alias("cell_ord"))
    b = Bundle(c, c, reduced={"V": v})
    for y in (E.calculate_tsne(b, dimred="V")[0], E.calculate_umap(b, dimred="V")[0], E.calculate_multi_umap([v, v], ["euclidean", "manhattan"])[0], E.calculate_tsne(b, dimred="V", use_densvis=True)[0]):
        p = np.array([r[1] for r in y.orderBy("cell_id").collect()])
        a, d = p[:40], p[40:]
        assert np.linalg.norm(a.mean(0) - d.mean(0)) > 2 * max(a.std(), d.std()) and np.isfinite(p).all()
    old, E.MOST_LAYOUT = E.MOST_LAYOUT, 30
    try:
        with pytest.warns(UserWarning):
            assert E.calculate_tsne(b, dimred="V")[0].count() == 80
    finally:
        E.MOST_LAYOUT = old


def test_neighbours_and_projection(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(70, 3))
    x[5] = x[6]
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)] + [(999, None)], "cell_id int, coords array<double>")
    old, E.BLOCK_ROWS = E.BLOCK_ROWS, 20
    try:
        got = {(r["cell_id"], r["rank"]): (r["neighbour"], r["distance"]) for r in E.find_knn(v, 4).collect()}
    finally:
        E.BLOCK_ROWS = old
    for i in range(70):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        d[i] = np.inf
        assert [got[i, k + 1][0] for k in range(4)] == list(np.argsort(d, kind="stable")[:4])
    assert E.find_knn(v, 0).count() == 0
    old_cells, new = v.where("cell_id < 60"), v.where("cell_id >= 60 AND cell_id < 70")
    p = E.project_reduced_dim(new, old_cells, R.dimensions(old_cells, 2), 5).collect()
    assert len(p) == 10
    lo, hi = x[:60, :2].min(0), x[:60, :2].max(0)
    assert all((np.array(r[1]) >= lo - 1e-9).all() and (np.array(r[1]) <= hi + 1e-9).all() for r in p)
    near = spark.createDataFrame([(1, 10, 1.0, 1), (1, 11, 1.0, 2), (1, 12, 1.0, 3)], "cell_id int, neighbour int, distance double, rank int")
    val = spark.createDataFrame([(10, [3.0]), (11, [6.0]), (12, [9.0])], "cell_id int, coords array<double>")
    assert E.tricube_average(near, val, 3).first()["coords"] == pytest.approx([6.0])
    zero = near.withColumn("distance", F.lit(0.0))
    assert E.tricube_average(zero, val, 3).first()["coords"] == pytest.approx([6.0])
    assert [r[1] for r in R.dimensions(v.where("cell_id = 0"), [3, 1]).collect()] == [[x[0, 2], x[0, 0]]]


def test_sources(spark, tmp_path, toy, mock):
    b, m = toy
    (tmp_path / "m.tsv").write_text("id\ta\tb\ng1\t0\t2\ng2\t1.5\t0\n")
    got = {tuple(r) for r in S.read_sparse_counts(spark, str(tmp_path / "m.tsv")).collect()}
    assert got == {("g1", "b", 2.0), ("g2", "a", 1.5)}
    rich = D.run_pca(b, 2, assay_type="counts")
    S.write_bundle(rich, str(tmp_path / "b"))
    back = S.read_bundle(spark, str(tmp_path / "b"))
    assert back.need("counts").count() == b.need("counts").count() and back.attrs["PCA"]["percentVar"] == rich.attrs["PCA"]["percentVar"]
    assert mock.need("counts").exceptAll(S.mock_bundle(spark, 60, 80).need("counts")).count() == 0
    with pytest.warns(UserWarning):
        old = S.from_legacy(b.features, b.cells, {"exprs": b.need("counts"), "logcounts": b.need("counts")}, b.cells.select("cell_id", F.array(F.lit(1.0)).alias("coords")))
    assert "logcounts" in old.assays and "redDim" in old.reduced
    two = S.merge_bundles(b, Bundle(b.features, b.cells.withColumn("cell_id", F.concat("cell_id", F.lit("'"))), {"counts": b.need("counts").withColumn("cell_id", F.concat("cell_id", F.lit("'")))}))
    assert two.cells.count() == 10 and two.cells.agg(F.max("cell_ord")).first()[0] == 10
    with pytest.raises(NotImplementedError):
        D.run_diffusion_map()


def test_annotation(toy, spark):
    b, _ = toy
    anno = spark.createDataFrame([("a", 2, "late"), ("a", 1, "early"), ("b", 1, "bb")], "sym string, o int, name string")
    out = as_dict(R.annotate_features(b.features, anno, "symbol", "sym", "o"), "feature_id", "name")
    assert out == {"g0": "early", "g1": "bb", "g2": "bb", "g3": None, "g4": None, "g5": None}


def test_empty_bundles(toy):
    b, _ = toy
    none = Bundle(b.features, b.cells.limit(0), {"counts": b.need("counts").limit(0)})
    assert C.nexprs(none).count() == 0 and set(as_dict(C.nexprs(none, "feature"), "feature_id", "n").values()) == {0}
    assert C.per_cell_qc(none).count() == 0 and V.rle(none, "counts").count() == 0
    assert G.group_summaries(none, None, "grp", assay_type="counts").count() == 0
    bare = Bundle(b.features.limit(0), b.cells, {"counts": b.need("counts").limit(0)})
    assert set(as_dict(C.nexprs(bare), "cell_id", "n").values()) == {0} and C.library_size_factors(bare).count() == 5
    assert X.get_variance_explained(bare, ["z"], assay_type="counts").count() == 0


def test_streams(spark, tmp_path, toy):
    from matrixloom.streaming import aggregates

    b, m = toy
    timed = b.need("counts").withColumn("at", F.timestamp_seconds(F.lit(1_700_000_000)))
    timed.write.parquet(str(tmp_path / "s"))
    stream = spark.readStream.schema(timed.schema).parquet(str(tmp_path / "s"))
    for name, df, mode in (("n", aggregates.detected(stream), "complete"), ("t", aggregates.running_totals(stream, "feature_id"), "complete"), ("w", aggregates.windowed_totals(stream, "at", "1 minute", "1 minute"), "complete")):
        q = df.writeStream.outputMode(mode).format("memory").queryName(f"out_{name}").start()
        q.processAllAvailable()
        q.stop()
    assert as_dict(spark.table("out_n"), "cell_id", "n") == {f"c{j}": int((m[:, j] > 0).sum()) for j in range(4)}
    assert as_dict(spark.table("out_t"), "feature_id", "total")["g0"] == 8
    assert as_dict(spark.table("out_w"), "cell_id", "total")["c0"] == 15


def test_nmf_query_takes_the_default_features(spark, monkeypatch):
    from matrixloom.plans import catalog

    asked = {}
    monkeypatch.setattr(catalog.D, "calculate_nmf", lambda b, **kw: asked.update(kw) or (spark.createDataFrame([("c", [1.0, 2.0])], "cell_id string, coords array<double>"), {}))
    catalog.QUERIES["nmf"](spark, "/root/testdata/sf0.001")
    assert "ntop" not in asked


def test_annotations_names_and_places(toy):
    b, _ = toy
    with pytest.warns(UserWarning, match="both annotated"):
        V.heatmap_annotations(b, None, colour_columns_by=["grp"], colour_rows_by=[b.features.select("feature_id", F.col("kind").alias("grp"))])
    assert {r[0] for r in V.expression(b, ["g0"], assay_type="counts").select("Feature").distinct().collect()} == {"g0"}
    swapped = V.expression(b, [r["symbol"] for r in b.features.where("feature_id = 'g0'").collect()], assay_type="counts", swap_rownames="symbol")
    assert {r[0] for r in swapped.select("Feature").distinct().collect()} == {r["symbol"] for r in b.features.where("feature_id = 'g0'").collect()}
    with pytest.raises(KeyError, match="Cannot find column"):
        V.heatmap(b, None, assay_type="counts", swap_rownames="nothing")
    order = ["c2", "c0"]
    placed = V.rle(b, "counts", ordering=order).orderBy("place").collect()
    assert [r["Cell"] for r in placed] == order
    assert V.paired_densities(b.reduced[next(iter(b.reduced))], 2, 16).count() == 32 if b.reduced else True


@pytest.mark.parametrize("metric", ["euclidean", "cosine", "manhattan"])
def test_neighbours_by_parts_are_exact(spark, metric):
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(rng.uniform(-9, 9, 6), 1.0, (60, 6)) for _ in range(5)] + [np.zeros((4, 6))])
    rows = spark.createDataFrame([(int(i), v.tolist()) for i, v in enumerate(x)] + [(999, None)], "cell_id long, coords array<double>")
    old, E.BLOCK_ROWS = E.BLOCK_ROWS, 40
    try:
        got = E.find_knn(rows, 4, metric).collect()
        asked = E.query_knn(rows.where("cell_id % 9 = 0"), rows.where("cell_id % 9 <> 0"), 3, metric).collect()
    finally:
        E.BLOCK_ROWS = old
    z = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300) if metric == "cosine" else x
    d = np.abs(z[:, None] - z[None]).sum(-1) if metric == "manhattan" else np.sqrt(((z[:, None] - z[None]) ** 2).sum(-1))
    for i in range(len(x)):
        far = sorted((round(float(d[i, j]), 9), j) for j in range(len(x)) if j != i)[:4]
        mine = sorted((r["rank"], round(r["distance"], 9)) for r in got if r["cell_id"] == i)
        assert [v for v, _ in far] == [v for _, v in mine]
        if i % 9 == 0:
            far = sorted(round(float(d[i, j]), 9) for j in range(len(x)) if j % 9)[:3]
            assert far == sorted(round(r["distance"], 9) for r in asked if r["cell_id"] == i)
