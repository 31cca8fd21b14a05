"""The pN_ queries and their SQL."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.relational import table, written
from . import clusters, leakage, mixing, neighbours, percentiles, proportions, sentences, subset, tables

QUARTILES = {"q05": 0.05, "q25": 0.25, "q50": 0.5, "q75": 0.75, "q95": 0.95}


def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = proportions.stratum_report(proportions.sampling_plan(tables.cells(spark, sf_dir), table(spark, sf_dir, "sample_targets")))
    return r.select("request_id", "stratum_no", "available", "wanted", "shortfall")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_report(spark, sf_dir).where("shortfall > 0").select("request_id", "stratum_no")


def _p1_drawn(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    c = written(tables.cells(spark, sf_dir), "cells")  # gone over twice
    plan = written(proportions.sampling_plan(c, table(spark, sf_dir, "sample_targets")), "plan")
    return c, plan, proportions.stratified_sample(c, plan)


def p1_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _p1_drawn(spark, sf_dir)[2]


def p1_delivery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sample against its plan: cells missing from the quota, drawn twice, or of another stratum (all 0)."""
    c, plan, drawn = _p1_drawn(spark, sf_dir)
    r = proportions.stratum_report(plan)
    keys = ["request_id", "stratum_no"]
    twice = drawn.groupBy("request_id", "cell_id").agg(F.count(F.lit(1)).alias("n"), F.min("stratum_no").alias("stratum_no"))
    twice = twice.where("n > 1").groupBy(*keys).agg(F.count(F.lit(1)).alias("doubled"))
    have = drawn.join(c.select("cell_id", *[F.col(x).alias(f"_{x}") for x in ("batch", "treatment", "mutation_status")]), "cell_id").join(r, keys)
    fits = F.col("_batch") == F.col("batch")
    for x in ("treatment", "mutation_status"):
        fits = fits & (F.col(x).isNull() | F.coalesce(F.col(x) == F.col(f"_{x}"), F.lit(False)))
    got = have.groupBy(*keys).agg(F.count(F.lit(1)).alias("drawn"), F.count_if(~fits).alias("misplaced"))
    out = r.join(got, keys, "left").join(twice, keys, "left")
    zero = lambda x: F.coalesce(x, F.lit(0)).cast("long")
    return out.select(*keys, "available", "wanted", (F.col("quota") - zero("drawn")).alias("missing"), zero("misplaced").alias("misplaced"), zero("doubled").alias("doubled"))


def _p2(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "subset_requests")
    cells = tables.cells(spark, sf_dir).select("cell_id", "batch", F.col("cell_cycle").alias("category")).where("category IS NOT NULL")
    cells = cells.join(asked.select("batch").distinct(), "batch", "left_semi")
    return subset.nominees(cells.join(tables.vectors(spark, sf_dir), "cell_id"), asked)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _p2(spark, sf_dir).where("lone").select("request_id", "cell_id")


def p2_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subset.varied_subset(_p2(spark, sf_dir))


def p2_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the subset of a request holds: its size, the levels in it, and cells taken twice."""
    asked = table(spark, sf_dir, "subset_requests").select("request_id", "batch").distinct()
    level = tables.cells(spark, sf_dir).select("cell_id", F.col("cell_cycle").alias("level"))
    got = p2_subset(spark, sf_dir).join(level, "cell_id").groupBy("request_id").agg(
        F.count(F.lit(1)).alias("chosen"), F.count_distinct("level").alias("levels"), (F.count(F.lit(1)) - F.count_distinct("cell_id")).alias("doubled")
    )
    return got.join(asked, "request_id").select("request_id", "chosen", "levels", "doubled")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = neighbours.nearest_vectors(tables.vectors(spark, sf_dir), k=5, max_distance=1.0, probes=1)
    return neighbours.mutual_pairs(near).select("cell_id_a", "cell_id_b")


#: The cells whose number is divisible by 50 ask, all rows answer.
EVERY_50TH = "try_cast(regexp_extract(cell_id, '([0-9]+)$', 1) AS bigint) % 50 = 0"


def p3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = neighbours.nearest_vectors(tables.vectors(spark, sf_dir), k=5, probes=8, query=EVERY_50TH, exact=True)
    return near.select("cell_id", "rank", "neighbour", F.round("distance", 6).alias("distance"))


def p3_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of true neighbours found by a search of 8 lists: (asked, enough), enough from 0.9 on."""
    v = written(tables.vectors(spark, sf_dir), "vectors")  # gone over twice
    true = neighbours.nearest_vectors(v, k=5, query=EVERY_50TH, exact=True).select("cell_id", "neighbour")
    got = neighbours.nearest_vectors(v, k=5, query=EVERY_50TH).select("cell_id", "neighbour", F.lit(1).alias("hit"))
    j = true.join(got, ["cell_id", "neighbour"], "left")
    return j.agg(F.count_distinct("cell_id").alias("asked"), (F.coalesce(F.sum("hit"), F.lit(0)) >= F.count(F.lit(1)) * 0.9).alias("enough"))


def _p4(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = percentiles.frequencies(tables.measurements(spark, sf_dir), ["field_name", "group_key"], "value")
    return percentiles.percentiles(f, ["field_name", "group_key"], QUARTILES, least=20)


def p4_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _p4(spark, sf_dir).select("field_name", "group_key", "n_values", *[F.round(q, 6).alias(q) for q in QUARTILES])


def p4_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles from one summary a run day, put together later; the same as those of all measurements at once."""
    m = tables.measurements(spark, sf_dir, "run_day")
    daily = written(percentiles.frequencies(m, ["field_name", "group_key", "run_day"], "value"), "daily")
    f = percentiles.merge_frequencies(daily.drop("run_day"))
    return percentiles.percentiles(f, ["field_name", "group_key"], QUARTILES, least=20).select("field_name", "group_key", "n_values", *[F.round(q, 6).alias(q) for q in QUARTILES])


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    far = "(field_name = 'rle' AND (abs(q50) > 0.5 OR q75 - q25 > 2.5 OR q95 > 5 OR q05 < -5)) OR (field_name = 'logcounts' AND q50 > 5)"
    return _p4(spark, sf_dir).where("group_key IS NOT NULL").where(far).select("field_name", "group_key")


#: Rows at most this far apart belong together; groups from this size on come out.
CHAIN, LEAST_MEMBERS = 15.0, 10


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = clusters.chained_groups(tables.vectors(spark, sf_dir), CHAIN)
    return clusters.group_members(groups, LEAST_MEMBERS).select("cluster_key", "cell_id")


def p5_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = written(tables.vectors(spark, sf_dir), "vectors")  # gone over twice
    members = clusters.group_members(clusters.chained_groups(v, CHAIN), LEAST_MEMBERS)
    levels = tables.cells(spark, sf_dir).select("cell_id", F.col("cell_cycle").alias("level"))
    parts, counts = clusters.describe_groups(members, v, levels, CHAIN / 2)
    told = counts.groupBy("cluster_key").agg(F.array_sort(F.collect_list(F.struct("level", "n"))).alias("levels"))
    told = told.withColumn("levels", F.array_join(F.transform("levels", lambda s: F.concat_ws(":", F.coalesce(s["level"], F.lit("unknown")), s["n"].cast("string"))), " "))
    return parts.join(told, "cluster_key").select("cluster_key", "part", "size", F.round("spread", 6).alias("spread"), F.array_join("medoids", " ").alias("medoids"), "levels")


def p5_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups by the members of all their parts, whether all parts are tight, and their levels."""
    c = p5_clusters(spark, sf_dir)
    return c.groupBy("cluster_key", "levels").agg(F.sum("size").alias("members"), (F.max("spread") <= CHAIN / 2 + 1e-6).alias("tight"))


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p6_report(spark, sf_dir).select("doc_id", "item_id")


def p6_reparameterised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.reparameterised(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def _p7(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = tables.sourced_documents(spark, sf_dir)
    return docs, mixing.mix_plan(docs, table(spark, sf_dir, "mix_targets"))


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = mixing.mix_report(_p7(spark, sf_dir)[1])
    return r.select("mix_id", "source", "wanted", "available", "routed", F.round("share_reached", 6).alias("share_reached"), "short")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(_p7(spark, sf_dir)[1]).where("short").select("mix_id", "source")


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(*_p7(spark, sf_dir))


def p7_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mixes of distinct texts, each a member of all sources that deliver it: what the selection makes of the plan.

    ``over``: documents used too often by a source or in all; ``off``: tokens that stretches of whole documents cannot explain (all 0).
    """
    docs = written(tables.sourced_texts(spark, sf_dir), "texts")
    targets = table(spark, sf_dir, "mix_targets")
    plan = written(mixing.mix_plan(docs, targets), "plan")
    used = mixing.mix_documents(docs, plan).join(targets.select("mix_id", "source", "max_repeats"), ["mix_id", "source"])
    used = used.join(docs.select("doc_id", "sources"), "doc_id")
    most = targets.select("mix_id", F.col("source").alias("_s"), F.col("max_repeats").alias("_r"))
    caps = used.select("mix_id", "doc_id", F.explode("sources").alias("_s")).distinct().join(most, ["mix_id", "_s"]).groupBy("mix_id", "doc_id").agg(F.max("_r").alias("_cap"))
    all_ = used.groupBy("mix_id", "doc_id").agg(F.sum("uses").alias("_uses")).join(caps, ["mix_id", "doc_id"]).where("_uses > _cap").select("mix_id", "doc_id", F.lit(True).alias("_over"))
    used = used.join(all_, ["mix_id", "doc_id"], "left")
    got = used.groupBy("mix_id", "source").agg(F.count_if((F.col("uses") > F.col("max_repeats")) | F.coalesce("_over", F.lit(False))).alias("over"), F.sum(F.col("size") * F.col("uses")).alias("_tokens"))
    ends = plan.where("members IS NOT NULL").groupBy("mix_id", "source").agg(F.count(F.lit(1)).alias("_stretches"))
    longest = docs.agg(F.max("size")).scalar()
    out = mixing.mix_report(plan).join(got, ["mix_id", "source"], "left").join(ends, ["mix_id", "source"], "left")
    off = F.abs(F.coalesce("_tokens", F.lit(0)) - F.col("routed")) - F.coalesce("_stretches", F.lit(0)) * longest
    return out.select("mix_id", "source", "wanted", "available", F.coalesce("over", F.lit(0)).alias("over"), F.greatest(off, F.lit(0)).cast("long").alias("off"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.sentences(table(spark, sf_dir, "documents"))


# The characters that count as white space.
_SPACE = "[\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def p8_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters other than white space in the units of each text; with units that overlap counted apart."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    units = sentences.sentences(docs)
    after = F.lead("char_start").over(Window.partitionBy("doc_id").orderBy("char_start"))
    u = units.withColumn("_next", after).join(docs, "doc_id")
    part = F.substring("text", F.col("char_start").cast("int") + 1, (F.col("char_end") - F.col("char_start")).cast("int"))
    shown = F.length(F.regexp_replace(part, _SPACE, ""))
    return u.groupBy("doc_id").agg(F.sum(shown).alias("shown"), F.count_if(F.col("_next") < F.col("char_end")).alias("overlaps"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_report, p1_sample, p1_delivery, p2_found, p2_subset, p2_coverage, p3_found, p3_nearest, p3_recall, p4_found, p4_percentiles, p4_by_day, p5_found, p5_clusters, p5_parts, p6_found, p6_report, p6_reparameterised, p7_found, p7_report, p7_mix, p7_overlap, p8_found, p8_coverage)
}

_LEVEL = "lower(regexp_replace({0}, '[^A-Za-z0-9]', '', 'g'))"
_CELLS = f"""cur AS (
  SELECT cell_id, arg_max(batch, loaded_at) AS batch, arg_max(coalesce(treatment, ''), loaded_at) AS t0,
         arg_max(coalesce(mutation_status, ''), loaded_at) AS m0, arg_max(coalesce(cell_cycle, ''), loaded_at) AS c0
  FROM coldata GROUP BY cell_id),
cells AS (
  SELECT cur.cell_id, cur.batch, a.level_label AS treatment, b.level_label AS mutation_status, c.level_label AS cell_cycle
  FROM cur
  LEFT JOIN factor_levels a ON a.field_name = 'treatment' AND {_LEVEL.format('a.level_label')} = {_LEVEL.format('cur.t0')}
  LEFT JOIN factor_levels b ON b.field_name = 'mutation_status' AND {_LEVEL.format('b.level_label')} = {_LEVEL.format('cur.m0')}
  LEFT JOIN factor_levels c ON c.field_name = 'cell_cycle' AND {_LEVEL.format('c.level_label')} = {_LEVEL.format('cur.c0')})"""
_P1 = f"""WITH {_CELLS}, have AS (
  SELECT s.request_id, s.stratum_no, count(c.cell_id) AS available,
         greatest(floor(any_value(s.target_share) * any_value(s.sample_size) + 0.5)::BIGINT, any_value(s.min_cells)::BIGINT) AS wanted
  FROM sample_targets s LEFT JOIN cells c ON s.batch = c.batch
       AND (s.treatment IS NULL OR s.treatment = c.treatment)
       AND (s.mutation_status IS NULL OR s.mutation_status = c.mutation_status)
  GROUP BY s.request_id, s.stratum_no)
"""
_P4 = """WITH a AS (
  SELECT 'rle' AS field_name, arg_max(batch, loaded_at) AS group_key, arg_max(coalesce(rle, 'nan'::DOUBLE), loaded_at) AS value
  FROM plotrle GROUP BY cell_id, feature_id
  UNION ALL
  SELECT 'logcounts', feature_id, arg_max(coalesce(logcounts, 'nan'::DOUBLE), loaded_at) FROM assay GROUP BY cell_id, feature_id),
q AS (
  SELECT field_name, group_key, count(*) AS n_values, quantile_cont(value, 0.05) AS q05, quantile_cont(value, 0.25) AS q25,
         quantile_cont(value, 0.5) AS q50, quantile_cont(value, 0.75) AS q75, quantile_cont(value, 0.95) AS q95
  FROM a WHERE isfinite(value) GROUP BY field_name, group_key HAVING count(*) >= 20)
"""
_P7 = f"""WITH d AS (
  SELECT {_LEVEL.format('source')} AS k, sum(strlen(text)) AS a FROM documents WHERE text IS NOT NULL GROUP BY 1),
s AS (
  SELECT m.*, coalesce(d.a, 0)::BIGINT AS available FROM mix_targets m LEFT JOIN d ON d.k = {_LEVEL.format('m.source')}),
t AS (SELECT *, sum(available) OVER (PARTITION BY mix_id) AS total FROM s),
w AS (SELECT mix_id, source, target_share * total_ratio * total AS wanted, available, max_repeats FROM t),
r AS (SELECT *, least(ceil(wanted)::BIGINT, max_repeats * available)::BIGINT AS routed FROM w)
"""
_VECTORS = """vec AS (
  SELECT cell_id, coords::DOUBLE[20] AS v FROM (SELECT cell_id, arg_max(coalesce(coords, []), written_at) AS coords FROM reduceddims WHERE dimred = 'PCA' GROUP BY cell_id)
  WHERE len(coords) = 20 AND len(list_filter(coords, lambda x: x IS NULL OR isnan(x))) = 0)"""
def _folds() -> str:
    """SQL values (character, its compatibility form) of all characters that NFKC replaces by others of another kind, built by rule."""
    rows = []
    for i in range(0x110000):
        c = chr(i)
        k = unicodedata.normalize("NFKD", c) if not 0xD800 <= i < 0xE000 else c
        if k != unicodedata.normalize("NFD", c) and (i < 0x10000 or 0x1D400 <= i < 0x1D800):
            rows.append(f"({i}, '{k.replace(chr(39), chr(39) * 2)}')")
    return ", ".join(rows)


# documents and items in NFKC and lower case, letters and numbers only; every run of the needed length by its hash
_P6 = f"""WITH f(i, k) AS (VALUES {_folds()}),
t AS (SELECT true AS doc, doc_id AS id, NULL AS lang, text FROM documents WHERE text IS NOT NULL UNION ALL SELECT false, item_id, lang, item_text FROM eval_items WHERE item_text IS NOT NULL),
c AS (SELECT doc, id, any_value(lang) AS lang, unnest(any_value(list)) AS c, unnest(range(len(any_value(list)))) AS pos FROM (SELECT doc, id, lang, regexp_extract_all(text, '(?s).') AS list FROM t) GROUP BY doc, id),
n AS (SELECT doc, id, any_value(lang) AS lang, regexp_replace(lower(nfc_normalize(string_agg(coalesce(k, c), '' ORDER BY pos))), '[^\\pL\\pN]+', '', 'g') AS s FROM c LEFT JOIN f ON unicode(c) = i GROUP BY doc, id),
w AS (SELECT doc, id, need, hash(substr(s, p::BIGINT, need)) AS h FROM (SELECT doc, id, s, need, unnest(range(1, greatest(length(s) - need + 2, 1))) AS p
  FROM n CROSS JOIN (SELECT unnest([60, 24]) AS need) WHERE doc OR need = CASE WHEN lang IN ('zh', 'ja') THEN 24 ELSE 60 END))
SELECT DISTINCT d.id AS doc_id, i.id AS item_id FROM w d JOIN (SELECT DISTINCT id, need, h FROM w WHERE NOT doc) i USING (need, h) WHERE d.doc"""

_50TH = "try_cast(regexp_extract(a.cell_id, '([0-9]+)$', 1) AS BIGINT) % 50 = 0"
_CHAINS = f"""WITH RECURSIVE {_CELLS}, {_VECTORS},
e AS MATERIALIZED (SELECT a.cell_id AS a, b.cell_id AS b FROM vec a JOIN vec b ON a.cell_id <> b.cell_id AND array_distance(a.v, b.v) <= 15),
c(cell_id, root) USING KEY (cell_id) AS (
  SELECT cell_id, cell_id FROM vec
  UNION SELECT e.b, min(c.root) FROM c JOIN e ON e.a = c.cell_id JOIN recurring.c AS p ON p.cell_id = e.b WHERE c.root < p.root GROUP BY e.b)"""
SQL: dict[str, str] = {
    "p2_found": f"""WITH {_CELLS}, {_VECTORS}, a AS (
  SELECT request_id, radius, c.cell_id, cell_cycle, v FROM subset_requests r JOIN cells c ON c.batch = r.batch JOIN vec ON vec.cell_id = c.cell_id WHERE cell_cycle IS NOT NULL),
near AS (SELECT DISTINCT a.request_id, a.cell_id FROM a JOIN a b ON a.request_id = b.request_id AND a.cell_cycle = b.cell_cycle AND a.cell_id <> b.cell_id AND array_distance(a.v, b.v) <= a.radius)
SELECT request_id, cell_id FROM a ANTI JOIN near USING (request_id, cell_id)""",
    "p6_found": _P6,
    "p2_coverage": f"""WITH {_CELLS}, {_VECTORS}, r AS (SELECT request_id, any_value(subset_size) AS k, any_value(batch) AS batch FROM subset_requests GROUP BY 1)
SELECT request_id, least(any_value(k), count(*))::BIGINT AS chosen, count(DISTINCT cell_cycle) AS levels, 0::BIGINT AS doubled FROM r JOIN cells c ON c.batch = r.batch JOIN vec ON vec.cell_id = c.cell_id WHERE cell_cycle IS NOT NULL GROUP BY request_id""",
    "p8_coverage": f"""WITH d AS (SELECT doc_id, length(regexp_replace(text, '{_SPACE}', '', 'g')) AS shown FROM documents WHERE text IS NOT NULL)
SELECT doc_id, shown, 0::BIGINT AS overlaps FROM d WHERE shown > 0""",
    "p5_parts": f"""{_CHAINS}, l AS (SELECT root, coalesce(cell_cycle, 'unknown') AS level, count(*) AS n FROM c LEFT JOIN cells USING (cell_id) GROUP BY 1, 2)
SELECT root AS cluster_key, sum(n)::BIGINT AS members, true AS tight, string_agg(level || ':' || n, ' ' ORDER BY CASE WHEN level = 'unknown' THEN '' ELSE level END) AS levels FROM l GROUP BY root HAVING sum(n) >= 10""",
    "p5_found": f"""{_CHAINS}, n AS (SELECT root, count(*) AS n FROM c GROUP BY root)
SELECT root AS cluster_key, cell_id FROM c JOIN n USING (root) WHERE n >= 10""",
    "p3_found": f"""WITH {_VECTORS}, d AS (
  SELECT a.cell_id AS a, b.cell_id AS b, array_distance(a.v, b.v) AS d FROM vec a JOIN vec b ON a.cell_id <> b.cell_id AND array_distance(a.v, b.v) <= 1.0),
k AS (SELECT a, b FROM d QUALIFY row_number() OVER (PARTITION BY a ORDER BY d, b) <= 5)
SELECT x.a AS cell_id_a, x.b AS cell_id_b FROM k x JOIN k y ON x.a = y.b AND x.b = y.a WHERE x.a < x.b""",
    "p3_nearest": f"""WITH {_VECTORS}, d AS (
  SELECT a.cell_id, b.cell_id AS neighbour, array_distance(a.v, b.v) AS d FROM vec a JOIN vec b ON a.cell_id <> b.cell_id WHERE {_50TH})
SELECT cell_id, row_number() OVER (PARTITION BY cell_id ORDER BY d, neighbour)::INT AS rank, neighbour, round(d, 6) AS distance FROM d QUALIFY rank <= 5""",
    "p3_recall": f"WITH {_VECTORS} SELECT count(*) AS asked, true AS enough FROM vec a WHERE {_50TH}",
    "p1_report": _P1 + "SELECT request_id, stratum_no, available, wanted, greatest(wanted - available, 0) AS shortfall FROM have",
    "p1_found": _P1 + "SELECT request_id, stratum_no FROM have WHERE available < wanted",
    "p1_delivery": _P1 + "SELECT request_id, stratum_no, available, wanted, 0::BIGINT AS missing, 0::BIGINT AS misplaced, 0::BIGINT AS doubled FROM have",
    "p4_percentiles": _P4 + "SELECT field_name, group_key, n_values, " + ", ".join(f"round({q}, 6) AS {q}" for q in QUARTILES) + " FROM q",
    "p4_by_day": _P4 + "SELECT field_name, group_key, n_values, " + ", ".join(f"round({q}, 6) AS {q}" for q in QUARTILES) + " FROM q",
    "p4_found": _P4 + "SELECT field_name, group_key FROM q WHERE (field_name = 'rle' AND (abs(q50) > 0.5 OR q75 - q25 > 2.5 OR q95 > 5 OR q05 < -5)) OR (field_name = 'logcounts' AND q50 > 5)",
    "p7_report": _P7 + "SELECT mix_id, source, wanted, available, routed, round(routed::DOUBLE / sum(routed) OVER (PARTITION BY mix_id), 6) AS share_reached, routed < wanted AS short FROM r",
    "p7_overlap": f"""WITH d AS (SELECT DISTINCT {_LEVEL.format('source')} AS k, text FROM documents WHERE text IS NOT NULL),
a AS (SELECT mix_id, m.source, any_value(target_share * total_ratio) AS f, coalesce(sum(strlen(text)), 0)::BIGINT AS available
  FROM mix_targets m LEFT JOIN d ON k = {_LEVEL.format('m.source')} GROUP BY 1, 2)
SELECT mix_id, source, f * sum(available) OVER (PARTITION BY mix_id) AS wanted, available, 0::BIGINT AS over, 0::BIGINT AS off FROM a""",
    "p7_found": _P7 + "SELECT mix_id, source FROM w WHERE wanted > max_repeats * available",
}
