import numpy as np
import pytest

from matrixloom import api
from matrixloom.operators import grouped as G
from matrixloom.sources import io as S


def test_names_and_spellings(spark):
    b = S.mock_bundle(spark, 20, 30)
    a = api.nexprs(b, **{"assay.type": "counts", "subset_row": ["Gene_0001"]})
    assert a.count() == 20 and set(api.__all__) <= set(vars(api))
    b = api.logNormCounts(b)
    b = api.runPCA(b, ncomponents=2, exprs_values="logcounts")
    assert "colour_by" in api.plotPCA(b, color_by="Treatment")[0].columns
    for gone in ("normalize", "multiplot", "calculateQCMetrics"):
        with pytest.raises(NotImplementedError):
            getattr(api, gone)(b)


def test_realised(spark):
    b = S.mock_bundle(spark, 10, 10)
    assert b.realised().need("counts").exceptAll(b.need("counts")).count() == 0


def test_written_tables_can_be_dropped(spark):
    from matrixloom.functions.relational import drop_written, written

    kept = written(spark.range(5).toDF("value"))
    assert kept.count() == 5 and kept.inputFiles()
    assert drop_written(spark) and not drop_written(spark)


def test_places_without_a_single_sort(spark):
    from matrixloom.functions.relational import ranked

    d = spark.range(1_000).selectExpr("id % 7 AS k", "id AS v", "id % 3 AS extra").repartition(5)
    got = [(r["place"], r["k"], r["v"]) for r in ranked(d, ["k", "v"], "place").collect()]
    assert sorted(got) == [(i + 1, k, v) for i, (k, v) in enumerate(sorted((i % 7, i) for i in range(1_000)))]
    assert ranked(d.limit(0), ["k"], "place").count() == 0


def test_row_order():
    x = np.array([[0.0], [10], [0.1], [10.2], [5]])
    order = G.cluster_order(x)
    assert sorted(order) == list(range(5)) and abs(order.index(0) - order.index(2)) == 1 and abs(order.index(1) - order.index(3)) == 1
    with pytest.raises(ValueError):
        G.cluster_order(x[:1])


def test_spread(spark):
    d = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", None), (None, 2.0), ("b", float("nan")), ("b", 7.0)], "X string, Y double")
    assert {r["X"]: (r["n"], r["median"]) for r in G.spread_by_level(d).collect()} == {"a": (2, 2.0), "b": (1, 7.0)}
