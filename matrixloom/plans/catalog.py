"""All queries of the core and their SQL, over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..bundle import Bundle
from ..functions.relational import table
from ..operators import counts as C
from ..operators import decompose as D
from ..operators import embed as E
from ..operators import explained as X
from ..operators import frames as V
from ..operators import grouped as G
from ..operators import retrieve as R
from ..sources import io as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL if there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def r6(df: DataFrame, *names: str) -> DataFrame:
    """Doubles rounded to 6 digits, negative zero made 0."""
    return df.withColumns({n: F.round(n, 6) + F.lit(0.0) for n in names})


BASKET = """basket AS (
  SELECT l_partkey AS feature_id, o_custkey AS cell_id, sum(l_quantity) AS value
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)"""
LIB = BASKET + ", lib AS (SELECT c_custkey AS cell_id, coalesce(sum(value), 0) AS total FROM customer LEFT JOIN basket ON cell_id = c_custkey GROUP BY 1)"
LOG = LIB + """, lognorm AS (
  SELECT feature_id, b.cell_id, log2(value / (lib.total / (SELECT avg(total) FROM lib)) + 1) AS value
  FROM basket b JOIN lib ON lib.cell_id = b.cell_id)"""
BRAND = BASKET + """, brand AS (
  SELECT p_brand AS feature_id, cell_id, sum(value) AS value FROM basket JOIN part ON p_partkey = feature_id GROUP BY 1, 2)"""
N = "(SELECT count(*) FROM customer)"
_VAR = f"""s_ AS (SELECT feature_id, sum(value) AS s, sum(value * value) AS q FROM basket GROUP BY 1),
few AS (SELECT feature_id, row_number() OVER (ORDER BY round((q - s * s / {N}) / ({N} - 1), 9) DESC, feature_id)::INT AS ord FROM s_ QUALIFY ord <= 12)"""


def _few(b: Bundle, n: int = 12) -> DataFrame:
    """The most variable features of all, (feature_id, ord): what a heat map is commonly drawn for."""
    v = C.feature_variance(b.need("counts"), b.features, b.cells.count()).withColumn("variance", F.round("variance", 9))
    return C.top_features(v, "variance", n).select("feature_id", "ord")


def _basket(spark: SparkSession, d: str) -> Bundle:
    return S.basket(spark, d)


def _once(b: Bundle) -> Bundle:
    """For queries of several passes: the join behind the assay is done once."""
    return b.realised("counts")


def _positive(b: Bundle) -> tuple[Bundle, DataFrame]:
    """The bundle without cells of no counts, which cannot be normalised, and the size factors among all cells."""
    sf = C.library_size_factors(b)
    return Bundle(b.features, b.cells.join(sf.where("size_factor > 0"), "cell_id", "left_semi"), b.assays), sf


def _logged(b: Bundle) -> Bundle:
    """With log-normalised values."""
    some, sf = _positive(b)
    return b.with_assay("logcounts", C.log_norm_counts(some, size_factors=sf).need("logcounts"))


# detection


@query(f"WITH {BASKET} SELECT c_custkey AS cell_id, count(feature_id) FILTER (value > 0) AS n FROM customer LEFT JOIN basket ON cell_id = c_custkey GROUP BY 1")
def nexprs_per_cell(spark, d):
    return C.nexprs(_basket(spark, d))


@query(f"WITH {BASKET} SELECT p_partkey AS feature_id, count(cell_id) FILTER (value > 0) AS n FROM part LEFT JOIN basket ON feature_id = p_partkey GROUP BY 1")
def nexprs_per_feature(spark, d):
    return C.nexprs(_basket(spark, d), by="feature")


@query(f"WITH {BASKET} SELECT c_custkey AS cell_id, count(feature_id) FILTER (value > 25 AND p_size <= 20) AS n FROM customer LEFT JOIN basket ON cell_id = c_custkey LEFT JOIN part ON p_partkey = feature_id GROUP BY 1")
def nexprs_limit(spark, d):
    return C.nexprs(_basket(spark, d), detection_limit=25, features=F.col("p_size") <= 20)


# normalisation


@query(f"WITH {LIB} SELECT cell_id, round(total / (SELECT avg(total) FROM lib), 6) AS size_factor FROM lib")
def library_size_factors(spark, d):
    return r6(C.library_size_factors(_once(_basket(spark, d))), "size_factor")


@query(f"WITH {LIB} SELECT cell_id, round(total / (SELECT exp(avg(ln(total))) FROM lib WHERE total > 0), 6) AS size_factor FROM lib")
def library_size_factors_geometric(spark, d):
    return r6(C.library_size_factors(_once(_basket(spark, d)), geometric=True), "size_factor")


@query(f"""WITH {BRAND}, av AS (SELECT feature_id, sum(value) / {N} AS a FROM brand GROUP BY 1),
m AS (SELECT c_custkey AS cell_id, quantile_cont(coalesce(value, 0) / a, 0.5) AS med FROM customer CROSS JOIN av
      LEFT JOIN brand ON brand.cell_id = c_custkey AND brand.feature_id = av.feature_id GROUP BY 1)
SELECT cell_id, round(med / (SELECT avg(med) FROM m), 6) AS size_factor FROM m""")
def median_size_factors(spark, d):
    return r6(C.median_size_factors(_once(_basket(spark, d).alts["brand"])), "size_factor")


@query(f"WITH {LIB} SELECT feature_id, b.cell_id, round(value * 1e6 / total, 6) AS value FROM basket b JOIN lib ON lib.cell_id = b.cell_id")
def cpm(spark, d):
    return r6(C.calculate_cpm(_basket(spark, d)), "value")


@query(f"WITH {LIB} SELECT feature_id, b.cell_id, round(value * 1e9 / total / (p_size * 100), 5) AS value FROM basket b JOIN lib ON lib.cell_id = b.cell_id JOIN part ON p_partkey = feature_id")
def fpkm(spark, d):
    b = _basket(spark, d)
    lengths = b.features.select("feature_id", (F.col("p_size") * 100.0).alias("length"))
    return C.calculate_fpkm(b, lengths).withColumn("value", F.round("value", 5))


@query(f"""WITH {BASKET}, r AS (SELECT feature_id, cell_id, value / p_size AS r FROM basket JOIN part ON p_partkey = feature_id)
SELECT feature_id, cell_id, round(r * 1e6 / sum(r) OVER (PARTITION BY cell_id), 5) AS value FROM r""")
def tpm(spark, d):
    b = _basket(spark, d)
    lengths = b.features.select("feature_id", F.col("p_size").cast("double").alias("length"))
    return C.calculate_tpm(b, lengths).withColumn("value", F.round("value", 5))


@query(f"WITH {LOG} SELECT feature_id, cell_id, round(value, 6) AS value FROM lognorm")
def log_norm_counts(spark, d):
    return r6(_logged(_once(_basket(spark, d))).need("logcounts"), "value")


@query(f"""WITH {LIB}, p AS (SELECT * FROM lib WHERE total > 0), s AS (SELECT feature_id, sum(value / (total / (SELECT avg(total) FROM p))) AS s FROM basket JOIN p USING (cell_id) GROUP BY 1)
SELECT p_partkey AS feature_id, round(coalesce(s, 0) / (SELECT count(*) FROM p), 6) AS average FROM part LEFT JOIN s ON feature_id = p_partkey""")
def calculate_average(spark, d):
    b = _positive(_once(_basket(spark, d)))[0]
    return r6(C.calculate_average(b, C.library_size_factors(b)), "average")


# quality control


@query(f"""WITH {BASKET} SELECT c_custkey AS cell_id, coalesce(sum(value), 0)::DOUBLE AS sum, count(feature_id) AS detected, coalesce(sum(value), 0)::DOUBLE AS total
FROM customer LEFT JOIN basket ON cell_id = c_custkey GROUP BY 1""")
def per_cell_qc(spark, d):
    return C.per_cell_qc(_basket(spark, d))


@query(f"""WITH {BASKET} SELECT p_partkey AS feature_id, round(coalesce(sum(value), 0) / {N}, 6) AS mean, round(count(cell_id) * 100.0 / {N}, 6) AS detected
FROM part LEFT JOIN basket ON feature_id = p_partkey GROUP BY 1""")
def per_feature_qc(spark, d):
    return r6(C.per_feature_qc(_basket(spark, d)), "mean", "detected")


@query(f"""WITH {BRAND}, t AS (SELECT c_custkey AS cell_id, coalesce(sum(value), 0) AS sum, count(feature_id) AS detected,
  coalesce(sum(value) FILTER (p_size <= 10), 0) AS ss, count(feature_id) FILTER (p_size <= 10) AS sd
  FROM customer LEFT JOIN basket ON cell_id = c_custkey LEFT JOIN part ON p_partkey = feature_id GROUP BY 1),
a AS (SELECT cell_id, sum(value) AS s, count(*) AS k FROM brand GROUP BY 1),
r AS (SELECT cell_id, value, row_number() OVER (PARTITION BY cell_id ORDER BY value DESC) AS i FROM basket),
p AS (SELECT cell_id, sum(value) FILTER (i <= 5) AS p5 FROM r GROUP BY 1)
SELECT t.cell_id, sum::DOUBLE AS sum, detected, ss::DOUBLE AS subsets_small_sum, sd AS subsets_small_detected, CASE WHEN sum > 0 THEN round(p5 * 100 / sum, 6) END AS percent_top_5,
  CASE WHEN sum > 0 THEN round(ss * 100 / sum, 6) END AS subsets_small_percent, coalesce(s, 0)::DOUBLE AS altexps_brand_sum, coalesce(k, 0) AS altexps_brand_detected,
  (sum + coalesce(s, 0))::DOUBLE AS total, CASE WHEN sum > 0 THEN round(s * 100 / (sum + s), 6) END AS altexps_brand_percent
FROM t LEFT JOIN a ON a.cell_id = t.cell_id LEFT JOIN p ON p.cell_id = t.cell_id""")
def subset_percent(spark, d):
    q = C.per_cell_qc(_basket(spark, d), {"small": F.col("p_size") <= 10}, top=[5], use_altexps=["brand"])
    return r6(q, "percent_top_5", "subsets_small_percent", "altexps_brand_percent")


_MAD = """{0}, v AS (SELECT c_custkey AS cell_id, {1} AS b, {2} AS v FROM customer LEFT JOIN (SELECT cell_id, sum(value) AS s FROM basket GROUP BY 1) t ON t.cell_id = c_custkey),
m AS (SELECT b, quantile_cont(v, 0.5) AS med FROM v GROUP BY 1),
o AS (SELECT v.b, any_value(med) AS med, 1.4826 * quantile_cont(abs(v - med), 0.5) AS mad FROM v JOIN m ON v.b = m.b GROUP BY 1)"""


@query("WITH " + _MAD.format(BASKET, "1", "CASE WHEN s > 0 THEN log2(s) END") + """ SELECT cell_id, round(pow(2, med - 3 * mad), 6) AS lower, round(pow(2, med + 3 * mad), 6) AS higher,
coalesce(v < med - 3 * mad OR v > med + 3 * mad, false) AS outlier FROM v JOIN o ON v.b = o.b""")
def outlier_cells(spark, d):
    return r6(C.is_outlier(C.per_cell_qc(_once(_basket(spark, d))), "sum", log=True), "lower", "higher")


@query("WITH " + _MAD.format(BASKET, "c_mktsegment", "c_acctbal") + " SELECT cell_id, round(med + 1 * mad, 6) AS higher, coalesce(v > med + 1 * mad, false) AS outlier FROM v JOIN o ON v.b = o.b")
def outlier_cells_by_batch(spark, d):
    o = C.is_outlier(_basket(spark, d).cells, "c_acctbal", nmads=1, type="higher", batch="c_mktsegment")
    # without a lower bound there is nothing to compare but the higher one
    return r6(o.drop("lower"), "higher")


@query("WITH " + BASKET + """, q AS (SELECT c_custkey AS cell_id, coalesce(sum(value), 0) AS s, count(feature_id) AS k FROM customer LEFT JOIN basket ON cell_id = c_custkey GROUP BY 1),
l AS (SELECT cell_id, CASE WHEN s > 0 THEN log2(s) END AS a, CASE WHEN k > 0 THEN log2(k) END AS b FROM q),
m AS (SELECT quantile_cont(a, 0.5) AS ma, quantile_cont(b, 0.5) AS mb FROM l),
o AS (SELECT 1.4826 * quantile_cont(abs(a - ma), 0.5) AS da, 1.4826 * quantile_cont(abs(b - mb), 0.5) AS db FROM l, m)
SELECT cell_id, coalesce(a < ma - 2 * da, false) AS low_lib_size, coalesce(b < mb - 2 * db, false) AS low_n_features,
coalesce(a < ma - 2 * da, false) OR coalesce(b < mb - 2 * db, false) AS discard FROM l, m, o""")
def quick_qc(spark, d):
    return C.quick_per_cell_qc(C.per_cell_qc(_once(_basket(spark, d))), nmads=2)


@query(f"""WITH {BASKET}, r AS (SELECT cell_id, value, row_number() OVER (PARTITION BY cell_id ORDER BY value DESC) AS i FROM basket),
p AS (SELECT unnest([1, 5, 20, 100])::INT AS position)
SELECT c_custkey AS cell_id, position, round(sum(value) FILTER (i <= position) * 100 / sum(value), 6) AS pct FROM customer CROSS JOIN p LEFT JOIN r ON cell_id = c_custkey GROUP BY 1, 2""")
def top_cumprop(spark, d):
    return r6(C.top_cumprop(_basket(spark, d), [5, 1, 20, 100]), "pct")


@query(f"""WITH {LIB}, r AS (SELECT cell_id, value, row_number() OVER (PARTITION BY cell_id ORDER BY value DESC) AS i FROM basket),
p AS (SELECT unnest(range(1, 51))::INT AS "Feature")
SELECT lib.cell_id AS "Cell", "Feature", round(sum(value) * 100 / any_value(total), 6) AS "Proportion_Library", any_value(c_mktsegment) AS block1
FROM lib JOIN customer ON c_custkey = lib.cell_id CROSS JOIN p JOIN r ON r.cell_id = lib.cell_id AND i <= "Feature" GROUP BY 1, 2""")
def library_shares(spark, d):
    return r6(V.library_shares(_basket(spark, d), 50, block1="c_mktsegment"), "Proportion_Library")


# ranks


@query(f"""WITH {BASKET}, t AS (SELECT feature_id, sum(value) AS s FROM basket GROUP BY 1), top AS (SELECT feature_id, s, row_number() OVER (ORDER BY s DESC, feature_id)::INT AS rank FROM t QUALIFY rank <= 50)
SELECT feature_id AS "Tag", rank, round(s * 100 / (SELECT sum(s) FROM t), 6) AS score FROM top""")
def highest_exprs(spark, d):
    return r6(V.highest_exprs(_once(_basket(spark, d))).select("Tag", "rank", "score").distinct(), "score")


@query(f"""WITH {LIB}, t AS (SELECT feature_id, sum(value) AS s FROM basket WHERE feature_id NOT IN (1, 2, 3) GROUP BY 1), top AS (SELECT feature_id, s, row_number() OVER (ORDER BY s DESC, feature_id)::INT AS rank FROM t QUALIFY rank <= 10)
SELECT lib.cell_id AS "Cell", top.feature_id AS "Tag", rank, CASE WHEN total > 0 THEN round(coalesce(value, 0) * 100 / total, 6) END AS value FROM lib CROSS JOIN top LEFT JOIN basket b ON b.cell_id = lib.cell_id AND b.feature_id = top.feature_id""")
def highest_exprs_cells(spark, d):
    return r6(V.highest_exprs(_once(_basket(spark, d)), 10, drop_features=[1, 2, 3]).select("Cell", "Tag", "rank", "value"), "value")


@query(f"""WITH {BASKET}, s AS (SELECT feature_id, sum(value) AS s, sum(value * value) AS q FROM basket GROUP BY 1),
v AS (SELECT p_partkey AS feature_id, (coalesce(q, 0) - coalesce(s, 0) * coalesce(s, 0) / {N}) / ({N} - 1) AS variance FROM part LEFT JOIN s ON feature_id = p_partkey)
SELECT feature_id, row_number() OVER (ORDER BY round(variance, 9) DESC, feature_id)::INT AS ord, round(variance, 6) AS variance FROM v QUALIFY ord <= 500""")
def feature_variance_topk(spark, d):
    b = _basket(spark, d)
    v = C.feature_variance(b.need("counts"), b.features, b.cells.count()).withColumn("variance", F.round("variance", 9))
    return r6(C.top_features(v, "variance", 500), "variance")


# relative log expression


_RLE = BRAND + f""", full_ AS (SELECT c_custkey AS cell_id, f.feature_id, log2(coalesce(value, 0) + 1) AS v FROM customer CROSS JOIN (SELECT DISTINCT p_brand AS feature_id FROM part) f
  LEFT JOIN brand b ON b.cell_id = c_custkey AND b.feature_id = f.feature_id),
med AS (SELECT feature_id, quantile_cont(v, 0.5) AS med FROM full_ GROUP BY 1),
dev AS (SELECT cell_id, full_.feature_id, v - med AS dev FROM full_ JOIN med ON med.feature_id = full_.feature_id)"""


@query(f"""WITH {_RLE}, q AS (SELECT cell_id, min(dev) AS q0, quantile_cont(dev, 0.25) AS q25, quantile_cont(dev, 0.5) AS q50, quantile_cont(dev, 0.75) AS q75, max(dev) AS q100 FROM dev GROUP BY 1)
SELECT cell_id AS "Cell", round(q0, 6) + 0.0 AS q0, round(q25, 6) + 0.0 AS q25, round(q50, 6) + 0.0 AS q50, round(q75, 6) + 0.0 AS q75, round(q100, 6) + 0.0 AS q100,
round(greatest(q0, q25 - 1.5 * (q75 - q25)), 6) + 0.0 AS lower, round(least(q100, q75 + 1.5 * (q75 - q25)), 6) + 0.0 AS upper FROM q""")
def rle_minimal(spark, d):
    return r6(V.rle(_once(_basket(spark, d).alts["brand"]), "counts", logged=False), "q0", "q25", "q50", "q75", "q100", "lower", "upper")


@query(f"""WITH {_RLE} SELECT cell_id AS "Cell", feature_id AS "Feature", round(dev, 6) + 0.0 AS "Deviation" FROM dev""")
def rle_full(spark, d):
    return r6(V.rle(_once(_basket(spark, d).alts["brand"]), "counts", logged=False, style="full"), "Deviation")


# groups


_GROUP = LOG + f""", g AS (SELECT c_mktsegment AS grp, count(*) AS n FROM customer GROUP BY 1),
s AS (SELECT feature_id, c_mktsegment AS grp, sum(value) AS s, count(*) FILTER (value > 0) AS k FROM lognorm JOIN customer ON c_custkey = cell_id GROUP BY 1, 2),
d AS (SELECT p_partkey AS feature_id, g.grp, coalesce(s, 0) / n AS mean, coalesce(k, 0) / n::DOUBLE AS det FROM part CROSS JOIN g LEFT JOIN s ON s.feature_id = p_partkey AND s.grp = g.grp)"""


@query(f"""WITH {_GROUP} SELECT feature_id AS "Feature", grp AS "Group", round(det, 6) AS "NumDetected", round(mean, 6) AS "Average" FROM d""")
def dots(spark, d):
    return r6(G.dots(_logged(_once(_basket(spark, d))), None, "c_mktsegment"), "NumDetected", "Average")


@query(f"""WITH {_GROUP}, c AS (SELECT *, mean - avg(mean) OVER w AS cm FROM d WINDOW w AS (PARTITION BY feature_id)),
z AS (SELECT *, sqrt(sum(cm * cm) OVER (PARTITION BY feature_id) / (count(*) OVER (PARTITION BY feature_id) - 1)) AS root FROM c)
SELECT feature_id AS "Feature", grp AS "Group", round(least(det, 0.05), 6) AS "NumDetected",
CASE WHEN root > 1e-12 THEN round(greatest(-1.5, least(1.5, cm / root)), 5) + 0.0 END AS "Average" FROM z""")
def dots_centered_scaled(spark, d):
    x = G.dots(_logged(_once(_basket(spark, d))), None, "c_mktsegment", center=True, scale=True, zlim=(-1.5, 1.5), max_detected=0.05)
    return r6(x, "NumDetected").withColumn("Average", F.round("Average", 5) + F.lit(0.0))


@query(f"""WITH {_GROUP} SELECT feature_id AS "Feature", grp AS "Group", round(mean - avg(mean) OVER (PARTITION BY feature_id), 6) + 0.0 AS value FROM d""")
def grouped_heatmap(spark, d):
    return r6(G.grouped_heatmap(_logged(_once(_basket(spark, d))), None, "c_mktsegment", center=True), "value")


@query(f"""WITH {BRAND}, c AS (SELECT c_mktsegment AS grp, c_nationkey % 2 AS blk, count(*) AS n FROM customer GROUP BY 1, 2),
s AS (SELECT feature_id, c_mktsegment AS grp, c_nationkey % 2 AS blk, sum(value) AS s FROM brand JOIN customer ON c_custkey = cell_id GROUP BY 1, 2, 3),
f AS (SELECT DISTINCT p_brand AS feature_id FROM part)
SELECT f.feature_id AS "Feature", c.grp AS "Group", round(avg(coalesce(s, 0) / n), 6) AS value FROM f CROSS JOIN c LEFT JOIN s ON s.feature_id = f.feature_id AND s.grp = c.grp AND s.blk = c.blk GROUP BY 1, 2""")
def grouped_heatmap_blocked(spark, d):
    b = _once(_basket(spark, d).alts["brand"])
    cells = b.cells.withColumn("blk", F.col("c_nationkey") % 2)
    return r6(G.grouped_heatmap(Bundle(b.features, cells, b.assays), None, "c_mktsegment", block="blk", assay_type="counts"), "value")


@query(f"""WITH {BASKET}, {_VAR}, d AS (SELECT p.feature_id, c_custkey AS cell_id, coalesce(value, 0) AS v FROM customer CROSS JOIN few p
  LEFT JOIN basket b ON b.cell_id = c_custkey AND b.feature_id = p.feature_id),
c AS (SELECT *, v - avg(v) OVER (PARTITION BY feature_id) AS cv FROM d),
z AS (SELECT *, sqrt(sum(cv * cv) OVER (PARTITION BY feature_id) / (count(*) OVER (PARTITION BY feature_id) - 1)) AS root FROM c),
o AS (SELECT c_custkey AS cell_id, row_number() OVER (ORDER BY c_mktsegment, c_nationkey, c_custkey)::INT AS "column" FROM customer)
SELECT feature_id AS "Feature", o.cell_id AS "Cell", CASE WHEN root > 1e-12 THEN round(greatest(-2, least(2, cv / root)), 5) + 0.0 END AS value, ord AS row, "column" FROM z JOIN o ON o.cell_id = z.cell_id JOIN few USING (feature_id)""")
def heatmap_scaled(spark, d):
    b = _once(_basket(spark, d))
    h = V.heatmap(b, _few(b), center=True, scale=True, zlim=(-2, 2), order_columns_by=["c_mktsegment", "c_nationkey"], assay_type="counts")
    return h.withColumn("value", F.round("value", 5) + F.lit(0.0))


@query(f"""WITH {BASKET}, {_VAR}, d AS (SELECT coalesce(value, 0) AS v, p.feature_id AS p_partkey FROM customer CROSS JOIN few p LEFT JOIN basket b ON b.cell_id = c_custkey AND b.feature_id = p.feature_id),
c AS (SELECT v - avg(v) OVER (PARTITION BY p_partkey) AS v FROM d)
SELECT round(-max(abs(v)), 6) AS low, round(max(abs(v)), 6) AS high FROM c""")
def heatmap_limits(spark, d):
    b = _once(_basket(spark, d))
    h = V.heatmap(b, _few(b), center=True, assay_type="counts")
    return r6(G.colour_scale(h, center=True).select("low", "high"), "low", "high")


@query(f"WITH {BASKET} SELECT feature_id, c_mktsegment, c_nationkey, sum(value) AS value, any_value(n) AS ncells FROM basket JOIN customer ON c_custkey = cell_id JOIN (SELECT c_mktsegment AS m, c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1, 2) ON m = c_mktsegment AND k = c_nationkey GROUP BY 1, 2, 3")
def sum_across_cells(spark, d):
    return C.sum_across_cells(_basket(spark, d), ["c_mktsegment", "c_nationkey"])


@query(f"WITH {BASKET} SELECT p_type AS set_id, cell_id, sum(value) AS value FROM basket JOIN part ON p_partkey = feature_id GROUP BY 1, 2 UNION ALL SELECT 'large', cell_id, sum(value) FROM basket JOIN part ON p_partkey = feature_id WHERE p_size > 30 GROUP BY 2")
def sum_across_features(spark, d):
    b = _basket(spark, d)
    sets = b.features.select(F.col("p_type").alias("set_id"), "feature_id").unionByName(b.features.where("p_size > 30").select(F.lit("large").alias("set_id"), "feature_id"))
    return C.sum_across_features(b, sets)


@query(f"WITH {BASKET} SELECT feature_id, c_mktsegment, round(count(*) FILTER (value > 30) / any_value(n)::DOUBLE, 6) AS value, any_value(n) AS ncells FROM basket JOIN customer ON c_custkey = cell_id JOIN (SELECT c_mktsegment AS m, count(*) AS n FROM customer GROUP BY 1) ON m = c_mktsegment GROUP BY 1, 2")
def num_detected_across_cells(spark, d):
    return r6(C.num_detected_across_cells(_basket(spark, d), ["c_mktsegment"], 30, average=True), "value")


@query(f"WITH {BASKET} SELECT p_brand AS set_id, cell_id, count(*) FILTER (value > 30) AS value FROM basket JOIN part ON p_partkey = feature_id GROUP BY 1, 2")
def num_detected_across_features(spark, d):
    b = _basket(spark, d)
    return C.num_detected_across_features(b, b.features.select(F.col("p_brand").alias("set_id"), "feature_id"), 30)


@query("""SELECT label::VARCHAR AS cell_id, dim, round(avg(x), 6) + 0.0 AS x, count(*) AS ncells FROM (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(1, 65))::INT AS dim FROM embeddings) GROUP BY 1, 2""")
def aggregate_across_cells(spark, d):
    b = C.aggregate_across_cells(S.embedding_bundle(spark, d), ["label"], "logcounts")
    r = b.reduced["VEC"].select("cell_id", F.posexplode("coords").alias("i", "x")).join(b.cells.select("cell_id", "ncells"), "cell_id")
    return r6(r.select("cell_id", (F.col("i") + 1).alias("dim"), "x", "ncells"), "x")


@query(f"WITH {BASKET} SELECT p_brand AS feature_id, cell_id, sum(value) AS value FROM basket JOIN part ON p_partkey = feature_id GROUP BY 1, 2")
def aggregate_across_features(spark, d):
    return C.aggregate_across_features(_basket(spark, d), "p_brand").need("counts")


@query("SELECT p_partkey AS feature_id, CASE WHEN p_name IS NULL THEN p_partkey::VARCHAR WHEN count(*) OVER (PARTITION BY p_name) > 1 THEN p_name || '_' || p_partkey ELSE p_name END AS unique_name FROM part")
def uniquify_names(spark, d):
    return C.uniquify_feature_names(_basket(spark, d).features, "p_name")


# explained variance


_X = BASKET + f", n AS (SELECT {N}::DOUBLE AS n), t AS (SELECT feature_id, sum(value) AS sx, sum(value * value) AS sxx FROM basket GROUP BY 1)"


@query(f"""WITH {_X}, g AS (SELECT c_mktsegment AS level, count(*) AS ng FROM customer GROUP BY 1),
s AS (SELECT feature_id, c_mktsegment AS level, sum(value) AS sg FROM basket JOIN customer ON c_custkey = cell_id GROUP BY 1, 2),
b AS (SELECT feature_id, sum(sg * sg / ng) AS between_ FROM s JOIN g ON g.level = s.level GROUP BY 1)
SELECT p_partkey AS feature_id, 'c_mktsegment' AS variable, CASE WHEN sxx - sx * sx / n > 0 THEN round(100 * (between_ - sx * sx / n) / (sxx - sx * sx / n), 5) END AS pct
FROM part LEFT JOIN t ON t.feature_id = p_partkey LEFT JOIN b ON b.feature_id = p_partkey CROSS JOIN n""")
def variance_explained_factor(spark, d):
    b = _once(_basket(spark, d))
    return X.variance_explained(b.need("counts"), b.features, b.cells, ["c_mktsegment"]).withColumn("pct", F.round("pct", 5))


@query(f"""WITH {_X}, z AS (SELECT avg(c_acctbal) AS mz, sum((c_acctbal - (SELECT avg(c_acctbal) FROM customer)) ** 2) AS szz FROM customer),
s AS (SELECT feature_id, sum(value * (c_acctbal - mz)) AS sxz FROM basket JOIN customer ON c_custkey = cell_id CROSS JOIN z GROUP BY 1)
SELECT p_partkey AS feature_id, 'c_acctbal' AS variable, CASE WHEN sxx - sx * sx / n > 0 THEN round(100 * sxz * sxz / (szz * (sxx - sx * sx / n)), 5) END AS pct
FROM part LEFT JOIN t ON t.feature_id = p_partkey LEFT JOIN s ON s.feature_id = p_partkey CROSS JOIN n CROSS JOIN z""")
def variance_explained_numeric(spark, d):
    b = _once(_basket(spark, d))
    return X.variance_explained(b.need("counts"), b.features, b.cells, ["c_acctbal"]).withColumn("pct", F.round("pct", 5))


@query(f"""WITH {_X}, z AS (SELECT avg(c_acctbal) AS mz, sum((c_acctbal - (SELECT avg(c_acctbal) FROM customer)) ** 2) AS szz FROM customer),
s AS (SELECT feature_id, sum(value * (c_acctbal - mz)) AS sxz FROM basket JOIN customer ON c_custkey = cell_id CROSS JOIN z GROUP BY 1),
g AS (SELECT c_mktsegment AS level, count(*) AS ng FROM customer GROUP BY 1),
u AS (SELECT feature_id, c_mktsegment AS level, sum(value) AS sg FROM basket JOIN customer ON c_custkey = cell_id GROUP BY 1, 2),
b AS (SELECT feature_id, sum(sg * sg / ng) AS between_ FROM u JOIN g ON g.level = u.level GROUP BY 1),
e AS (SELECT 'c_acctbal' AS variable, 100 * sxz * sxz / (szz * (sxx - sx * sx / n)) AS pct FROM t JOIN s ON s.feature_id = t.feature_id CROSS JOIN n CROSS JOIN z WHERE sxx - sx * sx / n > 0
 UNION ALL SELECT 'c_mktsegment', 100 * (between_ - sx * sx / n) / (sxx - sx * sx / n) FROM t JOIN b ON b.feature_id = t.feature_id CROSS JOIN n WHERE sxx - sx * sx / n > 0)
SELECT variable, round(quantile_cont(pct, 0.5), 5) AS score FROM e GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def explanatory_variables_top(spark, d):
    b = _once(_basket(spark, d))
    e = X.variance_explained(b.need("counts"), b.features, b.cells, ["c_acctbal", "c_mktsegment"])
    return X.top_variables(e).withColumn("score", F.round("score", 5))


# frames and lookup


@query(f"""WITH {BASKET}, {_VAR} SELECT c_custkey AS cell_id, p.feature_id AS "Feature", round(log2(coalesce(value, 0) + 1), 6) AS "Y", c_mktsegment AS "X", c_acctbal AS colour_by FROM customer CROSS JOIN few p
LEFT JOIN basket b ON b.cell_id = c_custkey AND b.feature_id = p.feature_id""")
def expression_long(spark, d):
    b = _once(_basket(spark, d))
    return r6(V.expression(b, _few(b), x="c_mktsegment", log2_values=True, assay_type="counts", colour_by="c_acctbal"), "Y")


@query(f"""WITH {BRAND} SELECT c_custkey AS cell_id, c_custkey::INT AS cell_ord, c_mktsegment, c_nationkey, c_acctbal,
coalesce(sum(value) FILTER (feature_id = '1'), 0)::DOUBLE AS "1", coalesce(sum(value) FILTER (feature_id = '2'), 0)::DOUBLE AS "2", coalesce(sum(value) FILTER (feature_id = 'Brand#11'), 0)::DOUBLE AS "Brand#11"
FROM customer LEFT JOIN (SELECT feature_id::VARCHAR AS feature_id, cell_id, value FROM basket UNION ALL SELECT feature_id, cell_id, value FROM brand) b ON b.cell_id = c_custkey GROUP BY ALL""")
def per_cell_df(spark, d):
    return R.per_cell_frame(_basket(spark, d), [1, 2, "Brand#11"], "counts", use_altexps=["brand"])


@query(f"""WITH {BASKET} SELECT p_partkey AS feature_id, p_partkey::INT AS feature_ord, p_name, p_brand, p_type, p_size, p_retailprice,
coalesce(sum(value) FILTER (cell_id = 1), 0)::DOUBLE AS "1", coalesce(sum(value) FILTER (cell_id = 2), 0)::DOUBLE AS "2" FROM part LEFT JOIN basket ON basket.feature_id = p_partkey GROUP BY ALL""")
def per_feature_df(spark, d):
    return R.per_feature_frame(_basket(spark, d), [1, 2], "counts")


@query("""SELECT c_custkey AS cell_id, c_acctbal AS "Y", c_mktsegment AS "X", c_nationkey AS order_by FROM customer""")
def col_data_frame(spark, d):
    return V.col_data(_basket(spark, d), "c_acctbal", "c_mktsegment", order_by="c_nationkey")


@query("""SELECT p_partkey AS feature_id, p_retailprice AS "Y", p_size AS "X", p_type AS colour_by FROM part""")
def row_data_frame(spark, d):
    return V.row_data(_basket(spark, d), "p_retailprice", "p_size", colour_by="p_type")


_LEVELS = "(SELECT DISTINCT c_mktsegment AS \"X\" FROM customer) a CROSS JOIN (SELECT DISTINCT c_nationkey % 4 AS \"Y\" FROM customer) b"


@query(f"""WITH c AS (SELECT "X", "Y", (SELECT count(*) FROM customer WHERE c_mktsegment = "X" AND c_nationkey % 4 = "Y") AS n FROM {_LEVELS})
SELECT "X", "Y", n, round(n / max(n) OVER ()::DOUBLE, 6) AS share, round(0.49 * sqrt(n / max(n) OVER ()::DOUBLE), 6) AS half_width, round(0.49 * sqrt(n / max(n) OVER ()::DOUBLE), 6) AS half_height FROM c""")
def contingency(spark, d):
    c = _basket(spark, d).cells.withColumn("k", F.col("c_nationkey") % 4)
    return r6(G.contingency(c, "c_mktsegment", "k", R.factor_levels(c, "c_mktsegment"), R.factor_levels(c, "k")), "share", "half_width", "half_height")


_BIN = """WITH q AS (SELECT min(p_size) AS a, max(p_size) AS b, min(p_retailprice) AS c, max(p_retailprice) AS d FROM part)
SELECT least(29, floor((p_size - a) * 30 / (b - a)::DOUBLE))::INT AS xbin, least(29, floor((p_retailprice - c) * 30 / (d - c)))::INT AS ybin, count(*) AS n{} FROM part, q GROUP BY 1, 2"""


@query(_BIN.format(""))
def bin2d_count(spark, d):
    return G.bin2d(_basket(spark, d).features, "p_size", "p_retailprice")


@query(_BIN.format(", round(sum(p_retailprice), 4) AS value"))
def bin2d_summary(spark, d):
    return G.bin2d(_basket(spark, d).features, "p_size", "p_retailprice", value="p_retailprice").withColumn("value", F.round("value", 4))


@query(f"""WITH {BRAND} SELECT c_custkey AS cell_id, coalesce(value, 0)::DOUBLE AS value FROM customer LEFT JOIN (SELECT * FROM brand WHERE feature_id = 'Brand#11') b ON b.cell_id = c_custkey""")
def retrieve_first_match(spark, d):
    return R.retrieve_cell_info(_basket(spark, d), "Brand#11", assay_type="counts")[1]


@query("""SELECT c_custkey AS cell_id, (c_custkey % 12 + 1)::INT AS "X", chr((65 + c_custkey % 8)::INT) AS "Y", (25 - c_custkey % 8)::INT AS y_order FROM customer""")
def plate_position(spark, d):
    c = _basket(spark, d).cells
    well = F.concat(F.char((F.lit(65) + F.col("cell_id") % 8)), (F.col("cell_id") % 12 + 1).cast("string"))
    return V.plate_position(c, well)


# embeddings


_VEC = "e AS (SELECT vec_id AS cell_id, label, embedding::DOUBLE[64] AS v FROM embeddings)"


@query(f"""WITH {_VEC} SELECT a.cell_id, row_number() OVER (PARTITION BY a.cell_id ORDER BY round(array_distance(a.v, b.v), 9), b.cell_id)::INT AS rank, b.cell_id AS neighbour, round(array_distance(a.v, b.v), 6) AS distance
FROM e a JOIN e b ON a.cell_id <> b.cell_id QUALIFY rank <= 5""")
def knn_self(spark, d):
    return r6(E.find_knn(S.embedding_bundle(spark, d).reduced["VEC"], 5).select("cell_id", "rank", "neighbour", "distance"), "distance")


@query(f"""WITH {_VEC} SELECT a.cell_id, row_number() OVER (PARTITION BY a.cell_id ORDER BY round(array_distance(a.v, b.v), 9), b.cell_id)::INT AS rank, b.cell_id AS neighbour, round(array_distance(a.v, b.v), 6) AS distance
FROM e a JOIN e b ON a.label >= 5 AND b.label < 5 QUALIFY rank <= 5""")
def knn_query(spark, d):
    b = S.embedding_bundle(spark, d)
    v = b.reduced["VEC"].join(b.cells, "cell_id")
    return r6(E.query_knn(v.where("label >= 5"), v.where("label < 5"), 5).select("cell_id", "rank", "neighbour", "distance"), "distance")


@query(f"""WITH {_VEC}, k AS (SELECT a.cell_id, b.v, array_distance(a.v, b.v) AS d, row_number() OVER (PARTITION BY a.cell_id ORDER BY round(array_distance(a.v, b.v), 9), b.cell_id) AS rank
  FROM e a JOIN e b ON a.label >= 5 AND b.label < 5 QUALIFY rank <= 5),
w AS (SELECT *, (1 - least(d / greatest(3 * max(d) FILTER (rank = 3) OVER (PARTITION BY cell_id), 1e-8), 1) ** 3) ** 3 AS w FROM k),
x AS (SELECT cell_id, w, unnest(v[1:3]) AS x, unnest([1, 2, 3])::INT AS dim FROM w)
SELECT cell_id, dim, round(sum(w * x) / sum(w), 6) + 0.0 AS x FROM x GROUP BY 1, 2""")
def tricube_projection(spark, d):
    b = S.embedding_bundle(spark, d)
    v = b.reduced["VEC"].join(b.cells, "cell_id")
    old = v.where("label < 5")
    p = E.project_reduced_dim(v.where("label >= 5"), old, R.dimensions(old.select("cell_id", "coords"), 3), 5)
    return r6(p.select("cell_id", F.posexplode("coords").alias("i", "x")).select("cell_id", (F.col("i") + 1).alias("dim"), "x"), "x")


@query("""SELECT label, round(quantile_cont(embedding[1]::DOUBLE, 0.5), 6) + 0.0 AS "X", round(quantile_cont(embedding[2]::DOUBLE, 0.5), 6) + 0.0 AS "Y" FROM embeddings GROUP BY 1""")
def text_label_medians(spark, d):
    return r6(V.reduced_dim(S.embedding_bundle(spark, d), "VEC", text_by="label")[1], "X", "Y")


@query("""WITH p AS (SELECT unnest([1, 1, 2, 2, 3, 3])::INT AS xvar, unnest([2, 3, 1, 3, 1, 2])::INT AS yvar)
SELECT vec_id AS cell_id, xvar, yvar, round(embedding[xvar]::DOUBLE, 6) + 0.0 AS x, round(embedding[yvar]::DOUBLE, 6) + 0.0 AS y FROM embeddings CROSS JOIN p""")
def reduced_pairs(spark, d):
    return r6(V.reduced_pairs(S.embedding_bundle(spark, d).reduced["VEC"], 3), "x", "y")


@query("""SELECT round(sum(v), 4) AS total FROM (SELECT var_samp(x) AS v FROM (SELECT unnest(embedding)::DOUBLE AS x, unnest(range(1, 65)) AS dim FROM embeddings) GROUP BY dim)""")
def pca_variance(spark, d):
    _, attrs = D.calculate_pca(S.embedding_bundle(spark, d), 64, dimred="VEC")
    return spark.createDataFrame([(round(sum(attrs["varExplained"]), 4),)], "total double")


@query("""WITH r AS (SELECT abs(corr(c_acctbal, c_nationkey)) AS r FROM customer)
SELECT 1::BIGINT AS component, round((1 + r) / 2, 6) AS share FROM r UNION ALL SELECT 2, round((1 - r) / 2, 6) FROM r""")
def coldata_pca(spark, d):
    """Of two scaled columns the components take (1 + r) / 2 and (1 - r) / 2 of the variance."""
    b = D.run_coldata_pca(_basket(spark, d), ["c_acctbal", "c_nationkey"], outliers=True)
    pct = b.attrs["PCA_coldata"]["percentVar"]
    return spark.createDataFrame([(i + 1, round(x, 6)) for i, x in enumerate(pct)], "component long, share double")


def _rows(coords: DataFrame) -> DataFrame:
    return coords.select("cell_id", *[F.get("coords", F.lit(i)).alias(f"d{i + 1}") for i in range(2)])


@query()
def pca_scores(spark, d):
    return _rows(D.calculate_pca(_logged(_once(_basket(spark, d))), 10)[0])


@query()
def explanatory_pcs(spark, d):
    b = D.run_pca(S.embedding_bundle(spark, d), 10, dimred="VEC")
    return X.explanatory_pcs(b, variables=["label"])


@query()
def mds(spark, d):
    return _rows(D.calculate_mds(S.embedding_bundle(spark, d), dimred="VEC")[0])


@query()
def nmf(spark, d):
    return _rows(D.calculate_nmf(_basket(spark, d), assay_type="counts")[0])


@query()
def tsne(spark, d):
    return _rows(E.calculate_tsne(S.embedding_bundle(spark, d), dimred="VEC")[0])


@query()
def umap(spark, d):
    return _rows(E.calculate_umap(S.embedding_bundle(spark, d), dimred="VEC")[0])


@query()
def multi_umap(spark, d):
    v = S.embedding_bundle(spark, d).reduced["VEC"]
    return _rows(E.calculate_multi_umap([R.dimensions(v, 32), R.dimensions(v, list(range(33, 65)))], ["euclidean", "cosine"])[0])


@query("""SELECT feature_id, feature_ord, p_name, (SELECT min(s_suppkey) FROM supplier WHERE s_nationkey = p_size % 25) AS first_supplier
FROM (SELECT p_partkey AS feature_id, p_partkey::INT AS feature_ord, p_name, p_size FROM part)""")
def annotate_features(spark, d):
    f = _basket(spark, d).features.withColumn("nation", F.col("p_size") % 25)
    anno = table(spark, d, "supplier").select(F.col("s_nationkey").alias("nation_id"), F.col("s_suppkey").alias("first_supplier"), F.col("s_suppkey").alias("o"))
    out = R.annotate_features(f, anno, "nation", "nation_id", "o")
    return out.select("feature_id", "feature_ord", "p_name", "first_supplier")


@query("""WITH e AS (SELECT event_type AS feature_id, user_id AS cell_id, value FROM events) SELECT cell_id, count(*) FILTER (value > 0) AS n FROM e GROUP BY 1""")
def nexprs_stream_form(spark, d):
    """The streaming aggregate applied to the stored events."""
    from ..streaming.aggregates import detected

    e = table(spark, d, "events").select(F.col("event_type").alias("feature_id"), F.col("user_id").alias("cell_id"), "value")
    return detected(e)


from . import wider  # noqa: E402, F401  registers further queries
