"""The reading rules of the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.relational import latest, level_of, plain, small_map, table


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The current row of every cell: cell_id, batch and the levels of its three factors."""
    raw = latest(table(spark, sf_dir, "coldata"), ["cell_id"], "loaded_at", ["batch", "treatment", "mutation_status", "cell_cycle"])
    levels = table(spark, sf_dir, "factor_levels").withColumn("_k", plain(F.col("level_label")))
    maps = {f: small_map(levels.where(F.col("field_name") == f), "_k", "level_label") for f in ("treatment", "mutation_status", "cell_cycle")}
    return raw.select("cell_id", "batch", *[level_of(F.col(f), m).alias(f) for f, m in maps.items()])


def vectors(spark: SparkSession, sf_dir: str, dims: int = 20) -> DataFrame:
    """The current usable PCA vector of every cell: cell_id, coords."""
    pca = table(spark, sf_dir, "reduceddims").where("dimred = 'PCA'")
    v = latest(pca, ["cell_id"], "written_at", ["coords"])
    good = (F.size("coords") == dims) & ~F.exists("coords", lambda x: x.isNull() | F.isnan(x))
    return v.where(F.coalesce(good, F.lit(False)))


def measurements(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """Current measurements of both tables: field_name, group_key, value and ``more`` of their columns."""
    rle = latest(table(spark, sf_dir, "plotrle"), ["cell_id", "feature_id"], "loaded_at", ["batch", "rle", *more])
    log = latest(table(spark, sf_dir, "assay"), ["cell_id", "feature_id"], "loaded_at", ["logcounts", *more])
    a = rle.select(F.lit("rle").alias("field_name"), F.col("batch").alias("group_key"), F.col("rle").alias("value"), *more)
    b = log.select(F.lit("logcounts").alias("field_name"), F.col("feature_id").alias("group_key"), F.col("logcounts").alias("value"), *more)
    return a.unionByName(b)


def sourced_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their size in UTF-8 bytes and the mix sources their label stands for."""
    targets = table(spark, sf_dir, "mix_targets").select("source").distinct().withColumn("_k", plain(F.col("source")))
    names = small_map(targets, "_k", "source")
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    src = level_of(F.col("source"), names)
    return d.select("doc_id", F.octet_length("text").cast("long").alias("size"), F.when(src.isNotNull(), F.array(src)).otherwise(F.array().cast("array<string>")).alias("sources"))


def sourced_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct texts under the smallest id of their documents, with the mix sources of all of these."""
    d = sourced_documents(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").where("text IS NOT NULL")
    one = d.groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.first("size").alias("size"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("sources")))).alias("sources"))
    return one.select("doc_id", "size", "sources")
