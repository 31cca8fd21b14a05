"""Further queries: accessors, sources, plot layers, normalisation forms and decompositions, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import api as A
from ..bundle import Bundle
from ..functions.palettes import colours_for
from ..functions.relational import shared_dir, table, written
from ..operators import counts as C
from ..operators import decompose as D
from ..operators import embed as E
from ..operators import explained as X
from ..operators import frames as V
from ..operators import grouped as G
from ..operators import retrieve as R
from ..sources import io as S
from .catalog import _VEC, BASKET, BRAND, LIB, LOG, N, _basket, _logged, _once, _positive, query, r6

# accessors


@query(f"""WITH {BASKET}, k AS (SELECT unnest(['exprs', 'fpkm', 'norm_exprs', 'stand_exprs']) AS name, unnest([1, 2, 3, 4]) AS f)
SELECT name, cell_id, sum(value) * any_value(f)::DOUBLE AS total FROM basket CROSS JOIN k GROUP BY 1, 2""")
def assay_accessors(spark, d):
    """Each assay set by its setter and got by its getter."""
    b = _once(_basket(spark, d))
    times = lambda f: b.counts().withColumn("value", F.col("value") * f)
    b = b.set_exprs(times(1)).set_fpkm(times(2)).set_norm_exprs(times(3)).set_stand_exprs(times(4))
    got = {"exprs": b.exprs(), "fpkm": b.fpkm(), "norm_exprs": b.norm_exprs(), "stand_exprs": b.stand_exprs()}
    out = None
    for name, a in got.items():
        one = a.groupBy("cell_id").agg(F.sum("value").alias("total")).select(F.lit(name).alias("name"), "cell_id", "total")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"""WITH {BASKET} SELECT 'bootstrap1' AS name, feature_id, cell_id, value::DOUBLE AS value FROM basket
UNION ALL SELECT 'bootstrap2', feature_id, cell_id, value - 20 FROM basket WHERE value <> 20""")
def bootstraps(spark, d):
    """A cube of two replicates written over three older ones and read back."""
    b = _basket(spark, d)
    cube = b.counts().select("feature_id", "cell_id", F.array("value", F.col("value") - 20).alias("values"))
    old = cube.withColumn("values", F.concat("values", F.array(F.lit(1.0))))
    out = None
    for name, a in b.set_bootstraps(old).set_bootstraps(cube).bootstraps().items():
        one = a.select(F.lit(name).alias("name"), "feature_id", "cell_id", F.col("value").cast("double").alias("value"))
        out = one if out is None else out.unionByName(one)
    return out


@query("""SELECT p_partkey AS feature_id, p_name, p_size, (SELECT min(s_suppkey) FROM supplier WHERE s_nationkey = p_size % 25) AS first_supplier FROM part""")
def append_annotation(spark, d):
    b = _basket(spark, d)
    b = b.with_features(b.features.select("feature_id", (F.col("p_size") % 25).alias("nation")))
    anno = table(spark, d, "supplier").select(F.col("s_nationkey").alias("nation_id"), F.col("s_suppkey").alias("first_supplier"), F.col("s_suppkey").alias("o"))
    return A.getBMFeatureAnnos(b, anno, "nation", "nation_id", "o").features.select("feature_id", "p_name", "p_size", "first_supplier")


@query("SELECT vec_id AS cell_id, embedding[1]::DOUBLE AS first, embedding[64]::DOUBLE AS last FROM embeddings")
def embedding_sink(spark, d):
    """An embedding stored under a name twice: the later one holds."""
    b = S.embedding_bundle(spark, d)
    b = b.with_reduced("X", R.dimensions(b.reduced["VEC"], 2)).with_reduced("X", b.reduced["VEC"])
    return b.reduced["X"].select("cell_id", F.get("coords", F.lit(0)).alias("first"), F.get("coords", F.lit(63)).alias("last"))


@query("SELECT name, true AS raised FROM (SELECT unnest(['calculateDiffusionMap', 'calculateQCMetrics', 'centreSizeFactors', 'multiplot', 'normalize', 'runDiffusionMap']) AS name)")
def defunct_names(spark, d):
    rows = []
    for name in ("calculateDiffusionMap", "runDiffusionMap", "calculateQCMetrics", "normalize", "centreSizeFactors", "multiplot"):
        try:
            getattr(A, name)(None)
            rows.append((name, False))
        except NotImplementedError:
            rows.append((name, True))
    return spark.createDataFrame(rows, "name string, raised boolean")


# sources


@query(f"""WITH {BASKET}, f AS (SELECT p_partkey AS feature_id, count(cell_id) AS stored, coalesce(sum(value), 0)::DOUBLE AS total FROM part LEFT JOIN basket ON feature_id = p_partkey GROUP BY 1)
SELECT feature_id, stored, total, 64::INT AS dims FROM f""")
def legacy_bundle(spark, d):
    """A bundle made of an old object: its ``exprs`` are ``logcounts`` now, its embedding ``redDim``."""
    b = _basket(spark, d)
    new = A.toBundle(b.features, b.cells, {"exprs": b.counts()}, S.embedding_bundle(spark, d).reduced["VEC"])
    s = new.need("logcounts").groupBy("feature_id").agg(F.count(F.lit(1)).alias("stored"), F.sum("value").alias("total"))
    out = new.features.select("feature_id").join(s, "feature_id", "left").fillna(0)
    dims = new.reduced["redDim"].agg(F.max(F.size("coords"))).scalar()
    return out.select("feature_id", "stored", F.col("total").cast("double").alias("total"), dims.alias("dims"))


@query(f"""WITH {BRAND} SELECT feature_id, 'N' || c_nationkey AS cell_id, sum(value)::DOUBLE AS value FROM brand JOIN customer ON c_custkey = cell_id GROUP BY 1, 2""")
def sparse_counts_file(spark, d):
    """A dense delimited matrix of brands by nations, written and read as stored rows."""
    b = _basket(spark, d)
    long = b.alts["brand"].counts().join(b.cells.select("cell_id", "c_nationkey"), "cell_id")
    wide = long.groupBy("feature_id").pivot("c_nationkey", list(range(25))).agg(F.sum("value")).fillna(0)
    wide = wide.select("feature_id", *[F.col(str(i)).alias(f"N{i}") for i in range(25)])
    path = f"{shared_dir(spark)}/matrixloom/{spark.sparkContext.applicationId}/dense-{uuid.uuid4().hex}"
    wide.write.csv(path, sep="\t", header=True)
    return S.read_sparse_counts(spark, path)


@query("SELECT 200::BIGINT AS ncells, 2000::BIGINT AS nfeatures, true AS whole, 2::BIGINT AS mutation, 4::BIGINT AS cycle, 2::BIGINT AS treatment")
def mock_bundle(spark, d):
    b = A.mockBundle(spark)
    whole = b.counts().agg(F.bool_and((F.col("value") > 0) & (F.col("value") == F.floor("value")))).scalar()
    levels = [F.count_distinct(c).alias(n) for c, n in (("Mutation_Status", "mutation"), ("Cell_Cycle", "cycle"), ("Treatment", "treatment"))]
    n = b.features.agg(F.count(F.lit(1))).scalar()
    return b.cells.agg(F.count(F.lit(1)).alias("ncells"), n.alias("nfeatures"), whole.alias("whole"), *levels)


@query(f"""WITH {BASKET} SELECT c_custkey AS cell_id, c_mktsegment, coalesce(sum(value), 0)::DOUBLE AS total FROM customer LEFT JOIN basket ON cell_id = c_custkey GROUP BY ALL""")
def stored_and_merged(spark, d):
    """Two halves of a bundle, each stored and read again, merged to the whole."""
    b = _once(_basket(spark, d))
    halves = []
    for odd in (0, 1):
        half = Bundle(b.features, b.cells.where(F.col("cell_id") % 2 == odd), {"counts": b.counts().where(F.col("cell_id") % 2 == odd)})
        path = f"{shared_dir(spark)}/matrixloom/{spark.sparkContext.applicationId}/bundle-{uuid.uuid4().hex}"
        S.write_bundle(half, path)
        halves.append(S.read_bundle(spark, path))
    m = S.merge_bundles(*halves)
    return C.totals(m.counts(), m.cells, "cell_id").join(m.cells.select("cell_id", "c_mktsegment"), "cell_id")


# normalisation and quality control through their operators


@query(f"WITH {LIB} SELECT feature_id, b.cell_id, round(value / (total / (SELECT avg(total) FROM lib WHERE total > 0)), 6) AS value FROM basket b JOIN lib ON lib.cell_id = b.cell_id")
def normalize_counts(spark, d):
    b = _positive(_once(_basket(spark, d)))[0]
    return r6(C.normalize_counts(b, C.library_size_factors(b), log=False, center=True), "value")


@query(f"WITH {LIB}, g AS (SELECT exp(avg(ln(total))) FILTER (total > 0) AS g FROM lib) SELECT c_custkey AS cell_id, c_mktsegment, round(total / (SELECT avg(total) FROM lib), 6) AS size_factor FROM customer JOIN lib ON cell_id = c_custkey")
def compute_library_factors(spark, d):
    return r6(C.compute_library_factors(_once(_basket(spark, d))).cells.select("cell_id", "c_mktsegment", "size_factor"), "size_factor")


@query(f"""WITH {BRAND}, av AS (SELECT feature_id, sum(value) / {N} AS a FROM brand GROUP BY 1),
m AS (SELECT c_custkey AS cell_id, any_value(c_mktsegment) AS c_mktsegment, quantile_cont(coalesce(value, 0) / a, 0.5) AS med FROM customer CROSS JOIN av
      LEFT JOIN brand ON brand.cell_id = c_custkey AND brand.feature_id = av.feature_id GROUP BY 1)
SELECT cell_id, c_mktsegment, round(med / (SELECT avg(med) FROM m), 6) AS size_factor FROM m""")
def compute_median_factors(spark, d):
    return r6(C.compute_median_factors(_once(_basket(spark, d).alts["brand"])).cells.select("cell_id", "c_mktsegment", "size_factor"), "size_factor")


@query(f"""WITH {BASKET} SELECT c_custkey AS cell_id, c_acctbal, coalesce(sum(value), 0)::DOUBLE AS sum, count(feature_id) AS detected FROM customer LEFT JOIN basket ON cell_id = c_custkey GROUP BY ALL""")
def add_per_cell_qc(spark, d):
    return C.add_per_cell_qc(_basket(spark, d)).cells.select("cell_id", "c_acctbal", "sum", "detected")


@query(f"""WITH {BASKET} SELECT p_partkey AS feature_id, p_size, round(coalesce(sum(value), 0) / {N}, 6) AS mean, round(count(cell_id) * 100.0 / {N}, 6) AS detected FROM part LEFT JOIN basket ON feature_id = p_partkey GROUP BY ALL""")
def add_per_feature_qc(spark, d):
    return r6(C.add_per_feature_qc(_basket(spark, d)).features.select("feature_id", "p_size", "mean", "detected"), "mean", "detected")


@query(f"WITH {BASKET} SELECT p_partkey AS feature_id, count(cell_id) FILTER (value > 10) AS n FROM part LEFT JOIN (SELECT basket.* FROM basket JOIN customer ON c_custkey = cell_id WHERE c_acctbal > 0) ON feature_id = p_partkey GROUP BY 1")
def nexprs_some_cells(spark, d):
    return C.nexprs(_basket(spark, d), by="feature", detection_limit=10, cells=F.col("c_acctbal") > 0)


@query(f"""WITH {BASKET} SELECT c_mktsegment AS cell_id, feature_id, sum(value)::DOUBLE AS value FROM basket JOIN customer ON c_custkey = cell_id GROUP BY 1, 2""")
def aggregate_across_cells_counts(spark, d):
    return C.aggregate_across_cells(_basket(spark, d), ["c_mktsegment"]).counts().select("cell_id", "feature_id", "value")


# groups


@query(f"""WITH {LOG}, s AS (SELECT feature_id, sum(value) AS s, count(*) FILTER (value > 0) AS k FROM lognorm GROUP BY 1)
SELECT p_partkey AS "Feature", 'all' AS "Group", round(coalesce(k, 0) / {N}::DOUBLE, 6) AS "NumDetected", round(coalesce(s, 0) / {N}, 6) AS "Average" FROM part LEFT JOIN s ON feature_id = p_partkey""")
def dots_one_group(spark, d):
    return r6(G.dots(_logged(_once(_basket(spark, d))), None), "NumDetected", "Average")


@query(f"""WITH {BRAND}, c AS (SELECT c_mktsegment AS grp, c_nationkey % 2 AS blk, count(*) AS n FROM customer GROUP BY 1, 2),
s AS (SELECT feature_id, c_mktsegment AS grp, c_nationkey % 2 AS blk, sum(value) AS s, count(*) FILTER (value > 0) AS k FROM brand JOIN customer ON c_custkey = cell_id GROUP BY 1, 2, 3),
f AS (SELECT DISTINCT p_brand AS feature_id FROM part),
g AS (SELECT f.feature_id, c.grp, coalesce(s, 0) / n AS m, greatest(0.5 / n, least(1 - 0.5 / n, coalesce(k, 0) / n::DOUBLE)) AS p FROM f CROSS JOIN c LEFT JOIN s ON s.feature_id = f.feature_id AND s.grp = c.grp AND s.blk = c.blk)
SELECT feature_id AS "Feature", grp AS "Group", round(1 / (1 + exp(-avg(ln(p / (1 - p))))), 6) AS "NumDetected", round(avg(m), 6) AS "Average" FROM g GROUP BY 1, 2""")
def dots_blocked(spark, d):
    """Every combination of group and block has cells, so the additive fit is a plain mean, of logits for the proportions."""
    b = _once(_basket(spark, d).alts["brand"])
    b = Bundle(b.features, b.cells.withColumn("blk", F.col("c_nationkey") % 2), b.assays)
    return r6(G.dots(b, None, "c_mktsegment", block="blk", assay_type="counts"), "NumDetected", "Average")


@query(f"""WITH {BRAND}, v AS (SELECT coalesce(value, 0)::DOUBLE AS v FROM customer CROSS JOIN (SELECT DISTINCT p_brand AS b FROM part) LEFT JOIN brand ON brand.cell_id = c_custkey AND feature_id = b),
r AS (SELECT min(v) AS lo, max(v) AS hi FROM v) SELECT i::INT AS i, round(lo + (hi - lo) * i / 100, 6) AS "break" FROM r CROSS JOIN range(101) t(i)""")
def colour_breaks(spark, d):
    h = V.heatmap(_basket(spark, d).alts["brand"], None, assay_type="counts")
    return r6(G.colour_scale(h).select(F.posexplode("breaks").alias("i", "break")), "break")


@query("""WITH p AS (SELECT p_brand AS grp, p_retailprice::DOUBLE AS v FROM part), s AS (SELECT grp, count(*) AS n, greatest(5.0, coalesce(stddev_samp(v), 0) * 1.06 * pow(count(*), -0.2)) AS h FROM p GROUP BY 1),
b AS (SELECT grp, round((v - 0) / 5.0) AS b, count(*) AS k FROM p GROUP BY 1, 2), g AS (SELECT 2560.0 * i / 127 AS x FROM range(128) t(i))
SELECT b.grp AS "group", round(x, 6) AS x, round(sum(k * exp(-0.5 * pow((x - b * 5.0) / h, 2)) / (n * h * sqrt(2 * pi()))), 9) AS density FROM b JOIN s ON s.grp = b.grp CROSS JOIN g GROUP BY 1, 2""")
def density_curves(spark, d):
    """Kernel densities of prices by brand on a fixed range; the fine grid has steps of 5."""
    out = G.density(_basket(spark, d).features, "p_retailprice", "p_brand", 0.0, 2560.0)
    return out.select("group", F.round("x", 6).alias("x"), F.round("density", 9).alias("density"))


@query("""SELECT p_type AS "X", count(*) AS n, round(quantile_cont(p_retailprice, 0.25), 6) AS q25, round(quantile_cont(p_retailprice, 0.5), 6) AS median, round(quantile_cont(p_retailprice, 0.75), 6) AS q75 FROM part GROUP BY 1""")
def violin_bars(spark, d):
    f = V.row_data(_basket(spark, d), "p_retailprice", "p_type")
    return r6(G.spread_by_level(f), "q25", "median", "q75")


@query("""WITH c AS (SELECT c_mktsegment AS "X", c_nationkey % 4 AS k, count(*) AS n FROM customer GROUP BY 1, 2)
SELECT c_custkey AS cell_id, c_mktsegment AS "X", 'k' || (c_nationkey % 4) AS "Y", round(0.49 * sqrt(n / (SELECT max(n) FROM c)::DOUBLE), 6) AS half_width, round(0.49 * sqrt(n / (SELECT max(n) FROM c)::DOUBLE), 6) AS half_height, true AS inside
FROM customer JOIN c ON c_mktsegment = "X" AND c_nationkey % 4 = k""")
def rectangles_with_points(spark, d):
    """Two factors: points with the widths of their rectangle, jittered within it."""
    b = _basket(spark, d)
    b = b.with_cells(b.cells.select("cell_id", F.concat(F.lit("k"), (F.col("c_nationkey") % 4).cast("string")).alias("k")))
    kind, p = V.central(V.col_data(b, "k", "c_mktsegment"))
    assert kind == "rectangles"
    inside = (F.abs("jitter_x") <= F.col("half_width")) & (F.abs("jitter_y") <= F.col("half_height"))
    return r6(p.select("cell_id", "X", "Y", "half_width", "half_height", inside.alias("inside")), "half_width", "half_height")


@query("""WITH q AS (SELECT min(p_size) AS a, max(p_size) AS b, min(p_retailprice) AS c, max(p_retailprice) AS d FROM part)
SELECT least(9, floor((p_size - a) * 10 / (b - a)::DOUBLE))::INT AS xbin, least(9, floor((p_retailprice - c) * 10 / (d - c)))::INT AS ybin, count(*) AS n, round(max(p_retailprice) - min(p_retailprice), 6) AS value FROM part, q GROUP BY 1, 2""")
def bins_by_a_function(spark, d):
    f = V.row_data(_basket(spark, d), "p_retailprice", "p_size", colour_by="p_retailprice")
    kind, bins = V.central(f, 10, lambda c: F.max(c) - F.min(c))
    assert kind == "bins"
    return r6(bins, "value")


# lookup and frames


@query(f"""WITH {BASKET}, t AS (SELECT p_name, p_partkey FROM part QUALIFY row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) <= 5)
SELECT c_custkey AS cell_id, p_name AS "Feature", coalesce(value, 0)::DOUBLE AS "Y", c_mktsegment AS "X", coalesce((SELECT value FROM basket b WHERE b.cell_id = c_custkey AND b.feature_id = (SELECT min(p_partkey) FROM part WHERE p_name = (SELECT p_name FROM t ORDER BY p_partkey LIMIT 1))), 0)::DOUBLE AS colour_by
FROM customer CROSS JOIN (SELECT p_name, min(part.p_partkey) AS k FROM part SEMI JOIN t USING (p_name) GROUP BY 1) n LEFT JOIN basket b ON b.cell_id = c_custkey AND b.feature_id = k""")
def expression_by_name(spark, d):
    """The five dearest parts, selected, looked up and named by ``p_name``; of parts of one name the first counts."""
    b = _basket(spark, d)
    top = [(r[0], r[1]) for r in b.features.orderBy(F.col("p_retailprice").desc(), "feature_id").select("p_name", "feature_id").limit(5).collect()]
    names = list(dict.fromkeys(n for n, _ in top))
    first = min(top, key=lambda t: t[1])[0]
    out = A.plotExpression(b, names, x="c_mktsegment", swap_rownames="p_name", exprs_values="counts", color_by=first)
    return out.select("cell_id", "Feature", F.col("Y").cast("double").alias("Y"), "X", F.col("colour_by").cast("double").alias("colour_by"))


@query(f"""WITH {BASKET}, t AS (SELECT feature_id, sum(value) AS s FROM basket GROUP BY 1 QUALIFY row_number() OVER (ORDER BY s DESC, feature_id) <= 20)
SELECT p_name AS "Tag", row_number() OVER (ORDER BY s DESC, feature_id)::INT AS rank, s::DOUBLE AS score FROM t JOIN part ON p_partkey = feature_id""")
def highest_exprs_by_name(spark, d):
    h = V.highest_exprs(_once(_basket(spark, d)), 20, as_percentage=False, feature_names="p_name")
    return h.select("Tag", "rank", "score").distinct()


@query(f"""WITH {BRAND}, full_ AS (SELECT c_custkey AS cell_id, f.feature_id, log2(coalesce(value, 0) + 1) AS v FROM customer CROSS JOIN (SELECT DISTINCT p_brand AS feature_id FROM part) f
  LEFT JOIN brand b ON b.cell_id = c_custkey AND b.feature_id = f.feature_id),
med AS (SELECT feature_id, quantile_cont(v, 0.5) AS med FROM full_ GROUP BY 1),
q AS (SELECT cell_id, quantile_cont(v - med, 0.5) AS q50 FROM full_ JOIN med USING (feature_id) GROUP BY 1)
SELECT cell_id AS "Cell", round(q50, 6) + 0.0 AS q50, row_number() OVER (ORDER BY c_acctbal, cell_id)::INT AS place FROM q JOIN customer ON c_custkey = cell_id""")
def rle_ordered(spark, d):
    b = _once(_basket(spark, d).alts["brand"])
    order = [r[0] for r in b.cells.orderBy("c_acctbal", "cell_id").select("cell_id").collect()]
    return r6(V.rle(b, "counts", logged=False, ordering=order).select("Cell", "q50", "place"), "q50")


@query("""SELECT c_custkey AS cell_id, c_mktsegment, c_acctbal FROM customer""")
def heatmap_column_annotation(spark, d):
    return V.heatmap_annotations(_basket(spark, d), None, colour_columns_by=["c_mktsegment", "c_acctbal"], colour_rows_by=["p_type"])[0]


@query("""SELECT p_partkey AS feature_id, p_type, p_size FROM part WHERE p_size > 10""")
def heatmap_row_annotation(spark, d):
    return V.heatmap_annotations(_basket(spark, d), F.col("p_size") > 10, colour_columns_by=["c_mktsegment"], colour_rows_by=["p_type", "p_size"])[1]


@query(f"""WITH {BRAND} SELECT c_custkey AS cell_id, c_mktsegment, coalesce(value, 0)::DOUBLE AS "Brand#11" FROM customer LEFT JOIN brand ON brand.cell_id = c_custkey AND feature_id = 'Brand#11'""")
def cells_for_mapping(spark, d):
    """Only what the mapping names is fetched."""
    return R.cells_for_mapping(_basket(spark, d), {"x": "c_mktsegment", "y": "Brand#11", "colour": "c_mktsegment"}, "counts", use_altexps=["brand"])


@query("SELECT c_mktsegment AS level, ['#729ECE', '#FF9E4A', '#67BF5C', '#ED665D', '#AD8BC9', '#A8786E', '#ED97CA', '#A2A2A2', '#CDCC5D', '#6DCCDA'][row_number() OVER (ORDER BY c_mktsegment)] AS colour FROM (SELECT DISTINCT c_mktsegment FROM customer)")
def palette_of_levels(spark, d):
    levels = R.factor_levels(_basket(spark, d).cells, "c_mktsegment")
    return spark.createDataFrame(list(colours_for(levels).items()), "level string, colour string")


@query("""WITH k AS (SELECT unnest(['DiffusionMap', 'MDS', 'NMF', 'PCA', 'TSNE', 'UMAP']) AS name, unnest([1, 2, 3, 4, 5, 6]) AS i)
SELECT name, vec_id AS cell_id, embedding[i]::DOUBLE AS "X", embedding[i + 1]::DOUBLE AS "Y", label AS colour_by FROM embeddings CROSS JOIN k""")
def named_embedding_frames(spark, d):
    b = S.embedding_bundle(spark, d)
    names = {"DiffusionMap": A.plotDiffusionMap, "MDS": A.plotMDS, "NMF": A.plotNMF, "PCA": A.plotPCA, "TSNE": A.plotTSNE, "UMAP": A.plotUMAP}
    out = None
    for i, (name, plot) in enumerate(names.items(), 1):
        one = plot(b.with_reduced(name, R.dimensions(b.reduced["VEC"], [i, i + 1])), color_by="label")[0].withColumn("name", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


@query("""WITH e AS (SELECT unnest([1, 2, 3])::INT AS dim, unnest(embedding[1:3])::DOUBLE AS v FROM embeddings),
s AS (SELECT dim, count(*) AS n, min(v) AS lo, max(v) AS hi, greatest((max(v) - min(v)) / 512, stddev_samp(v) * 1.06 * pow(count(*), -0.2)) AS h FROM e GROUP BY 1),
b AS (SELECT e.dim, round((v - lo) / ((hi - lo) / 512)) AS b, count(*) AS k FROM e JOIN s ON s.dim = e.dim GROUP BY 1, 2), g AS (SELECT i FROM range(128) t(i))
SELECT b.dim, round(lo + i * (hi - lo) / 127, 5) + 0.0 AS x, round(sum(k * exp(-0.5 * pow((i * (hi - lo) / 127 - b * (hi - lo) / 512) / h, 2)) / (n * h * sqrt(2 * pi()))), 5) AS density FROM b JOIN s ON s.dim = b.dim CROSS JOIN g GROUP BY b.dim, i, lo, hi""")
def paired_densities(spark, d):
    p = V.paired_densities(S.embedding_bundle(spark, d).reduced["VEC"], 3)
    return p.select("dim", (F.round("x", 5) + F.lit(0.0)).alias("x"), F.round("density", 5).alias("density"))


# explained variance


@query("""WITH e AS (SELECT label, unnest(range(1, 11))::INT AS pc, unnest(embedding[1:10])::DOUBLE AS x FROM embeddings)
SELECT pc AS "PC", 'label' AS "Expl_Var", round(100 * corr(x, label) ** 2, 5) AS "Pct_Var_Explained" FROM e GROUP BY 1""")
def explanatory_pcs_stored(spark, d):
    """The first ten components of a stored embedding."""
    out = X.explanatory_pcs(S.embedding_bundle(spark, d), npcs=10, dimred="VEC", variables=["label"])
    return out.select("PC", "Expl_Var", F.round("Pct_Var_Explained", 5).alias("Pct_Var_Explained"))


@query("""WITH e AS (SELECT label % 2 AS z, unnest(range(1, 65))::INT AS pc, unnest(embedding)::DOUBLE AS x FROM embeddings), f AS (SELECT *, CASE WHEN z = 1 THEN 'odd' ELSE 'even' END AS g FROM e),
r AS (SELECT pc, corr(x, z) ** 2 * 100 AS a FROM e GROUP BY 1) SELECT variable, round(max(a), 5) AS score FROM r CROSS JOIN (SELECT unnest(['parity', 'z']) AS variable) GROUP BY 1""")
def top_by_maximum(spark, d):
    """A factor of two levels explains what its indicator does."""
    b = S.embedding_bundle(spark, d)
    b = b.with_cells(b.cells.select("cell_id", (F.col("label") % 2).alias("z"), F.when(F.col("label") % 2 == 1, "odd").otherwise("even").alias("parity")))
    e = X.get_explanatory_pcs(b, "VEC", 64, ["z", "parity"])
    return X.top_variables(e, how="max").withColumn("score", F.round("score", 5))


@query(f"""WITH {BRAND}, v AS (SELECT c_custkey AS cell_id, c_acctbal AS z FROM customer WHERE c_acctbal > 1000),
x AS (SELECT f.feature_id, z, coalesce(value, 0) AS x FROM v CROSS JOIN (SELECT DISTINCT p_brand AS feature_id FROM part) f LEFT JOIN brand b ON b.cell_id = v.cell_id AND b.feature_id = f.feature_id)
SELECT feature_id, 'z' AS "Expl_Var", round(100 * corr(x, z) ** 2, 5) AS "Pct_Var_Explained" FROM x GROUP BY 1""")
def explanatory_variables_frame(spark, d):
    """A covariate with nulls: these cells leave its model only."""
    b = _once(_basket(spark, d).alts["brand"])
    b = b.with_cells(b.cells.select("cell_id", F.when(F.col("c_acctbal") > 1000, F.col("c_acctbal")).alias("z")))
    return X.explanatory_variables(b, variables=["z"], assay_type="counts").withColumn("Pct_Var_Explained", F.round("Pct_Var_Explained", 5))


# decomposition


_GRID = f"""{BRAND}, f AS (SELECT DISTINCT p_brand AS feature_id FROM part), g AS (SELECT c_custkey AS cell_id, f.feature_id, coalesce(value, 0)::DOUBLE AS x FROM customer CROSS JOIN f LEFT JOIN brand b ON b.cell_id = c_custkey AND b.feature_id = f.feature_id)"""


def _next_distance(coords: DataFrame) -> DataFrame:
    """(cell_id, distance): how far each cell is from the one with the next id."""
    after = coords.select((F.col("cell_id") - 1).alias("cell_id"), F.col("coords").alias("_n"))
    far = F.sqrt(F.aggregate(F.zip_with("coords", "_n", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, z: s + z))
    return coords.join(after, "cell_id").select("cell_id", F.round(far, 4).alias("distance"))


@query(f"""WITH {_GRID} SELECT a.cell_id, round(sqrt(sum((a.x - b.x) ** 2)), 4) AS distance FROM g a JOIN g b ON b.cell_id = a.cell_id + 1 AND b.feature_id = a.feature_id GROUP BY 1""")
def pca_distances(spark, d):
    """All components of an alternative experiment: a rotation, so distances between cells stay."""
    return _next_distance(D.calculate_pca(_once(_basket(spark, d)), 25, assay_type="counts", altexp="brand")[0])


@query(f"""WITH {_GRID}, s AS (SELECT feature_id, var_samp(x) AS v FROM g GROUP BY 1 HAVING var_samp(x) >= 1e-8)
SELECT a.cell_id, round(sqrt(sum((a.x - b.x) ** 2 / v)), 4) AS distance FROM g a JOIN g b ON b.cell_id = a.cell_id + 1 AND b.feature_id = a.feature_id JOIN s ON s.feature_id = a.feature_id GROUP BY 1""")
def pca_scaled_distances(spark, d):
    """The same with unit variances; features without any leave."""
    return _next_distance(D.calculate_pca(_once(_basket(spark, d)), 25, assay_type="counts", altexp="brand", scale=True)[0])


@query(f"""WITH {_VEC} SELECT a.cell_id, round(array_distance(a.v, b.v), 4) AS distance FROM e a JOIN e b ON b.cell_id = a.cell_id + 1""")
def mds_distances(spark, d):
    """Classical scaling to as many dimensions as there are gives the distances back."""
    return _next_distance(D.calculate_mds(S.embedding_bundle(spark, d), 64, dimred="VEC")[0])


@query(f"""WITH {_VEC} SELECT a.cell_id, round(sum(list_sum(list_transform(list_zip(a.v::DOUBLE[], b.v::DOUBLE[]), lambda p: abs(p[1] - p[2])))), 3) AS total FROM e a CROSS JOIN e b GROUP BY 1""")
def mds_manhattan(spark, d):
    """The distances that a general scaling starts from, summed for each cell."""
    coords, attrs = D.calculate_mds(S.embedding_bundle(spark, d), 2, distance="manhattan", keep_dist=True, dimred="VEC")
    ids = sorted(r[0] for r in coords.select("cell_id").collect())
    return spark.createDataFrame([(i, round(float(x), 3)) for i, x in zip(ids, attrs["dist"].sum(1), strict=True)], "cell_id long, total double")


@query("SELECT count(*) AS cells, true AS positive, true AS better FROM customer")
def nmf_bound(spark, d):
    """Factors are not negative, and two of them leave less than the mean of each brand does."""
    b = _once(_basket(spark, d))
    coords, attrs = D.calculate_nmf(b, 2, assay_type="counts", altexp="brand")
    m = D.matrix_from(b, "counts", altexp="brand")
    basis = F.array(*[F.array(*[F.lit(float(x)) for x in attrs["basis"][n]]) for n in m.names])
    rows = m.rows.join(coords.withColumnRenamed("coords", "w"), "cell_id")
    rest = F.zip_with("coords", basis, lambda x, h: x - F.aggregate(F.zip_with("w", h, lambda a, c: a * c), F.lit(0.0), lambda s, z: s + z))
    ss = F.aggregate(rest, F.lit(0.0), lambda s, z: s + z * z)
    total = sum((F.var_pop(F.get("coords", F.lit(i))) for i in range(len(m.names))), F.lit(0.0)) * F.count(F.lit(1))
    return rows.agg(F.count(F.lit(1)).alias("cells"), F.bool_and(F.array_min("w") >= 0).alias("positive"), (F.sum(ss) < total).alias("better"))


@query("""WITH r AS (SELECT avg(c_acctbal) AS m, stddev_samp(c_acctbal) AS s FROM customer), x AS (SELECT c_custkey AS cell_id, (c_acctbal - m) / s AS x FROM customer, r),
q AS (SELECT quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS q2, quantile_cont(x, 0.75) AS q3 FROM x),
z AS (SELECT x - q2 AS z FROM x, q), u AS (SELECT z AS a FROM z WHERE z >= 0), l AS (SELECT z AS b FROM z WHERE z <= 0),
h AS (SELECT CASE WHEN a - b > 0 THEN (a + b) / (a - b) ELSE 0 END AS h FROM u CROSS JOIN l), mc AS (SELECT quantile_cont(h, 0.5) AS mc FROM h),
f AS (SELECT q2, q1 - 1.5 * exp(CASE WHEN mc >= 0 THEN -4 * mc ELSE -3 * mc END) * (q3 - q1) AS lo, q3 + 1.5 * exp(CASE WHEN mc >= 0 THEN 3 * mc ELSE 4 * mc END) * (q3 - q1) AS hi FROM q, mc),
o AS (SELECT cell_id, CASE WHEN x >= q2 THEN (x - q2) / (hi - q2) ELSE (q2 - x) / (q2 - lo) END AS o FROM x, f),
m AS (SELECT quantile_cont(o, 0.5) AS med FROM o), d AS (SELECT med, 1.4826 * quantile_cont(abs(o - med), 0.5) AS mad FROM o, m GROUP BY med)
SELECT cell_id, round(o, 5) + 0.0 AS outlyingness, o > med + mad AS outlier FROM o, d""")
def coldata_outliers(spark, d):
    """Adjusted outlyingness of one variable, where its single direction leaves no chance; flagged beyond one MAD."""
    b = D.run_coldata_pca(_basket(spark, d), ["c_acctbal"], outliers=True, nmads=1)
    return b.cells.select("cell_id", (F.round("outlyingness", 5) + F.lit(0.0)).alias("outlyingness"), "outlier")


@query(f"""WITH {_VEC}, m AS (SELECT *, row_number() OVER () AS r FROM e) SELECT cell_id, round(list_sum(list_transform(v::DOUBLE[], lambda x: x * x)), 5) AS size, 64 AS dims FROM m""")
def bound_modalities(spark, d):
    """The blocks of several modalities bound by cell, in their order."""
    v = S.embedding_bundle(spark, d).reduced["VEC"]
    rows, sizes = E.bind_blocks([R.dimensions(v, 32), R.dimensions(v, list(range(33, 65)))])
    assert sizes == [32, 32]
    return rows.select("cell_id", F.round(F.aggregate("coords", F.lit(0.0), lambda s, x: s + x * x), 5).alias("size"), F.size("coords").alias("dims"))


# neighbours and layouts


@query("SELECT count(*) AS cells, true AS symmetric, true AS bounded, true AS calibrated, true AS within FROM embeddings")
def fuzzy_graph(spark, d):
    """Membership strengths of two modalities: symmetric, between 0 and 1, each row's own sum log2(k), and their intersection within both."""
    import numpy as np

    rows, _ = E.bind_blocks([S.embedding_bundle(spark, d).reduced["VEC"]])
    x = np.stack([r[0] for r in rows.orderBy("cell_id").select("coords").collect()])
    a, b = (E.fuzzy_edges(E._distances(x[:, s], m), 15) for s, m in ((slice(0, 32), "euclidean"), (slice(32, 64), "cosine")))
    both = E.intersected([a, b])
    one = E.fuzzy_edges(E._distances(x[:, :32]), 15, symmetric=False)
    ok = [np.allclose(a, a.T) and np.allclose(both, both.T), bool(((a >= 0) & (a <= 1 + 1e-12)).all()), bool(np.allclose(one.sum(1), np.log2(15), atol=1e-3)), bool((both <= np.sqrt(np.minimum(a, b)) + 1e-9).all() and ((both > 0) <= ((a > 0) & (b > 0))).all())]
    return spark.createDataFrame([(len(x), *map(bool, ok))], "cells long, symmetric boolean, bounded boolean, calibrated boolean, within boolean")


@query("SELECT unnest(['multi_umap', 'tsne', 'tsne_external', 'umap', 'umap_dense']) AS layout, (SELECT count(*) FROM embeddings) AS cells, 2 AS components, true AS finite, true AS kept")
def layouts_keep_neighbours(spark, d):
    """Of the 15 nearest cells in a layout, at least twice as many as by chance are among the 15 nearest vectors."""
    b = S.embedding_bundle(spark, d)
    v = b.reduced["VEC"]
    near = written(E.find_knn(v, 60), "near")
    made = {
        "tsne": E.calculate_tsne(b, dimred="VEC")[0], "tsne_external": E.calculate_tsne(b, dimred="VEC", perplexity=20, external_neighbors=near)[0],
        "umap": E.calculate_umap(b, dimred="VEC")[0], "umap_dense": E.calculate_umap(b, dimred="VEC", use_densvis=True, external_neighbors=near)[0],
        "multi_umap": E.calculate_multi_umap([R.dimensions(v, 32), R.dimensions(v, list(range(33, 65)))], ["euclidean", "cosine"])[0],
    }
    true = near.where("rank <= 15").select("cell_id", "neighbour")
    n = v.agg(F.count(F.lit(1))).scalar()
    out = None
    for name, y in made.items():
        y = written(y, "layout")
        hit = E.find_knn(y, 15).select("cell_id", "neighbour").join(true, ["cell_id", "neighbour"]).agg(F.count(F.lit(1))).scalar()
        fine = F.bool_and(~F.exists("coords", lambda c: F.isnan(c) | (F.abs(c) == float("inf"))))
        one = y.agg(F.lit(name).alias("layout"), F.count(F.lit(1)).alias("cells"), F.max(F.size("coords")).alias("components"), fine.alias("finite"), (hit >= 2 * 15 * 15).alias("kept"))
        out = one if out is None else out.unionByName(one)
    return out


@query(f"""WITH {BASKET}, f AS (SELECT p_brand AS name, min(p_partkey) AS k FROM part GROUP BY 1)
SELECT name AS "Feature", c_mktsegment AS "Group", round(coalesce(sum(value), 0) / count(DISTINCT c_custkey), 6) AS value FROM f CROSS JOIN customer LEFT JOIN basket b ON b.cell_id = c_custkey AND b.feature_id = k GROUP BY 1, 2""")
def grouped_heatmap_by_name(spark, d):
    """Features selected and named by a metadata column; the first part of each brand stands for its name."""
    b = _once(_basket(spark, d))
    names = R.factor_levels(b.features, "p_brand")
    return r6(G.grouped_heatmap(b, names, "c_mktsegment", assay_type="counts", swap_rownames="p_brand"), "value")


@query("""WITH e AS (SELECT label, unnest(range(1, 65)) AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings), r AS (SELECT dim, corr(x, label) ** 2 * var_samp(x) AS v FROM e GROUP BY 1)
SELECT 'label' AS variable, 64::BIGINT AS components, round(sum(v), 5) AS explained FROM r""")
def explained_by_all_components(spark, d):
    """The variance a covariate explains over all components is what it explains over the dimensions they rotate."""
    b = D.run_pca(S.embedding_bundle(spark, d), 64, dimred="VEC")
    var = F.array(*[F.lit(float(v)) for v in b.attrs["PCA"]["varExplained"]])
    e = X.get_explanatory_pcs(b, "PCA", 64, ["label"]).withColumn("v", F.col("pct") / 100 * F.get(var, F.col("component") - 1))
    return e.groupBy("variable").agg(F.count(F.lit(1)).alias("components"), F.round(F.sum("v"), 5).alias("explained"))


@query("SELECT unnest(range(1, 11))::INT AS component, 0.0 AS mean, true AS falling, true AS uncorrelated")
def pca_components(spark, d):
    """Scores of the most variable log-counts: centred, of falling variance and uncorrelated."""
    coords = written(D.calculate_pca(_logged(_once(_basket(spark, d))), 10)[0], "scores")
    at = lambda i: F.get("coords", F.lit(i))
    s = coords.agg(*[F.avg(at(i)).alias(f"m{i}") for i in range(10)], *[F.covar_samp(at(i), at(j)).alias(f"c{i}_{j}") for i in range(10) for j in range(i, 10)]).first()
    rows = []
    for i in range(10):
        own = s[f"c{i}_{i}"]
        loose = all(abs(s[f"c{min(i, j)}_{max(i, j)}"]) <= 1e-6 * max(own, s[f"c{j}_{j}"]) for j in range(10) if j != i)
        rows.append((i + 1, round(s[f"m{i}"], 6) + 0.0, i == 0 or own <= s[f"c{i - 1}_{i - 1}"] * (1 + 1e-9), loose))
    return spark.createDataFrame(rows, "component int, mean double, falling boolean, uncorrelated boolean")
