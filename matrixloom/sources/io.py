"""Readers and writers: dense delimited files, stored bundles, legacy objects, mock data and the driver's tables."""

from __future__ import annotations

import json
import warnings

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..bundle import Bundle
from ..functions.relational import table


def read_sparse_counts(spark: SparkSession, path: str, sep: str = "\t", header: bool = True) -> DataFrame:
    """A dense delimited matrix (first column feature ids, one column per cell) as stored non-zero rows.

    Columns are unpivoted in the JVM; with a header the cells are named by it, else ``V1``, ``V2``, ...
    """
    raw = spark.read.csv(path, sep=sep, header=header)
    names = raw.columns
    cells = names[1:] if header else [f"V{i}" for i in range(1, len(names))]
    items = F.array(*[F.struct(F.lit(c).alias("cell_id"), F.expr(f"try_cast(`{n}` AS double)").alias("value")) for n, c in zip(names[1:], cells, strict=True)])
    long = raw.select(F.col(f"`{names[0]}`").alias("feature_id"), F.explode(items).alias("s"))
    return long.select("feature_id", "s.cell_id", "s.value").where("value <> 0")


def write_bundle(bundle: Bundle, path: str, mode: str = "errorifexists") -> None:
    """A bundle as parquet tables below ``path``; assays and embeddings are partitioned by their name."""
    spark = bundle.cells.sparkSession
    bundle.features.write.mode(mode).parquet(f"{path}/features")
    bundle.cells.write.mode(mode).parquet(f"{path}/cells")
    for kind, parts in (("assay", bundle.assays), ("reduced", bundle.reduced)):
        for name, df in parts.items():
            df.write.mode(mode).parquet(f"{path}/{kind}/name={name}")
    for name, alt in bundle.alts.items():
        write_bundle(alt, f"{path}/alt/{name}", mode)
    meta = {"assays": list(bundle.assays), "reduced": list(bundle.reduced), "alts": list(bundle.alts), "attrs": {k: dict(v) for k, v in bundle.attrs.items()}, "levels": dict(bundle.levels)}
    spark.createDataFrame([(json.dumps(meta, default=str),)], "meta string").coalesce(1).write.mode(mode).text(f"{path}/meta")


def read_bundle(spark: SparkSession, path: str) -> Bundle:
    """A bundle written by :func:`write_bundle`; nothing is read until it is used."""
    meta = json.loads("".join(r[0] for r in spark.read.text(f"{path}/meta").collect()))
    return Bundle(
        spark.read.parquet(f"{path}/features"),
        spark.read.parquet(f"{path}/cells"),
        {n: spark.read.parquet(f"{path}/assay/name={n}") for n in meta["assays"]},
        {n: spark.read.parquet(f"{path}/reduced/name={n}") for n in meta["reduced"]},
        meta["attrs"],
        {n: read_bundle(spark, f"{path}/alt/{n}") for n in meta["alts"]},
        meta["levels"],
    )


def from_legacy(features: DataFrame, cells: DataFrame, assays: dict[str, DataFrame], reduced: DataFrame | None = None) -> Bundle:
    """A bundle from an object of the superseded class: assay ``exprs`` becomes ``logcounts``, a non-empty embedding ``redDim``."""
    assays = dict(assays)
    if "exprs" in assays:
        if "logcounts" in assays:
            warnings.warn("renaming 'exprs' to 'logcounts', which was there already", stacklevel=2)
        assays["logcounts"] = assays.pop("exprs")
    out = Bundle(features, cells)
    for name, a in assays.items():
        out = out.with_assay(name, a)
    if reduced is not None and reduced.limit(1).count():
        out = out.with_reduced("redDim", reduced)
    return out


def merge_bundles(a: Bundle, b: Bundle) -> Bundle:
    """Two bundles over the same features as one: cells of both, metadata columns and assays they share."""
    cols = [c for c in a.cells.columns if c in b.cells.columns]
    shift = a.cells.agg(F.coalesce(F.max("cell_ord"), F.lit(0))).scalar()
    cells = a.cells.select(*cols).unionByName(b.cells.withColumn("cell_ord", F.col("cell_ord") + shift).select(*cols))
    assays = {n: a.assays[n].unionByName(b.assays[n]) for n in a.assays if n in b.assays}
    return Bundle(a.features, cells, assays, {n: r.unionByName(b.reduced[n]) for n, r in a.reduced.items() if n in b.reduced}, levels=a.levels)


def mock_bundle(spark: SparkSession, ncells: int = 200, nfeatures: int = 2_000, seed: int = 1) -> Bundle:
    """A synthetic bundle, the same for the same seed on any cluster: counts, three factors and an embedding."""

    def u(*cols):
        return F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(1 << 30)) / float(1 << 30)

    def pick(salt: str, *options):
        return F.array(*[F.lit(o) for o in options])[F.floor(u(F.lit(salt), F.col("cell_ord")) * len(options)).cast("int")]

    f = spark.range(1, nfeatures + 1).select(F.format_string("Gene_%04d", "id").alias("feature_id"), F.col("id").cast("int").alias("feature_ord"))
    c = spark.range(1, ncells + 1).select(F.format_string("Cell_%03d", "id").alias("cell_id"), F.col("id").cast("int").alias("cell_ord"))
    c = c.select("*", pick("m", "positive", "negative").alias("Mutation_Status"), pick("c", "G0", "G1", "G2M", "S").alias("Cell_Cycle"), pick("t", "treat1", "treat2").alias("Treatment"))
    grid = spark.range(nfeatures * ncells).select((F.col("id") % nfeatures + 1).cast("int").alias("feature_ord"), F.floor(F.col("id") / nfeatures + 1).cast("int").alias("cell_ord"))
    mean = F.pow(F.lit(2.0), u(F.lit("g"), F.col("feature_ord")) * 8 - 4) * (u(F.lit("s"), F.col("cell_ord")) + 0.5)
    value = F.floor(-F.ln(1 - u(F.lit("x"), F.col("feature_ord"), F.col("cell_ord"))) * mean)
    a = grid.select(F.format_string("Gene_%04d", "feature_ord").alias("feature_id"), F.format_string("Cell_%03d", "cell_ord").alias("cell_id"), value.cast("double").alias("value"))
    levels = {"Mutation_Status": ["positive", "negative"], "Cell_Cycle": ["G0", "G1", "S", "G2M"], "Treatment": ["treat1", "treat2"]}
    return Bundle(f, c, levels=levels).with_assay("counts", a)


def _embedding(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("cell_id"), F.transform("embedding", lambda x: x.cast("double")).alias("coords"), "label")


def basket(spark: SparkSession, sf_dir: str) -> Bundle:
    """Parts x customers, the quantities bought; brands as an alternative experiment."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    a = li.join(o, "l_orderkey").groupBy(F.col("l_partkey").alias("feature_id"), F.col("o_custkey").alias("cell_id")).agg(F.sum("l_quantity").alias("value"))
    p = table(spark, sf_dir, "part")
    f = p.select(F.col("p_partkey").alias("feature_id"), F.col("p_partkey").cast("int").alias("feature_ord"), "p_name", "p_brand", "p_type", "p_size", "p_retailprice")
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cell_id"), F.col("c_custkey").cast("int").alias("cell_ord"), "c_mktsegment", "c_nationkey", "c_acctbal")
    brands = p.select(F.col("p_brand").alias("feature_id")).distinct()
    brands = brands.select("feature_id", F.row_number().over(Window.orderBy("feature_id")).alias("feature_ord"))
    b = a.join(p.select(F.col("p_partkey").alias("feature_id"), "p_brand"), "feature_id").groupBy(F.col("p_brand").alias("feature_id"), "cell_id").agg(F.sum("value").alias("value"))
    brand = Bundle(brands, c, {"counts": b})
    return Bundle(f, c, {"counts": a}, alts={"brand": brand})


def embedding_bundle(spark: SparkSession, sf_dir: str) -> Bundle:
    """The driver's vectors: 64 dimensions as features, vectors as cells with their label."""
    e = _embedding(spark, sf_dir)
    a = e.select("cell_id", F.posexplode("coords").alias("_i", "value")).select((F.col("_i") + 1).alias("feature_id"), "cell_id", "value")
    f = spark.range(1, 65).select(F.col("id").cast("int").alias("feature_id"), F.col("id").cast("int").alias("feature_ord"))
    c = e.select("cell_id", F.col("cell_id").cast("int").alias("cell_ord"), "label")
    return Bundle(f, c, {"logcounts": a.where("value <> 0")}, {"VEC": e.select("cell_id", "coords")})
