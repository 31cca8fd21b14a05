"""Small relational building blocks: latest version of a row, labels, bounded maps, shared checkpoints."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# A timestamp before all others, so that a version without a time is the oldest one.
_EPOCH = "0001-01-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` below ``sf_dir`` (a file or a folder of files)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def latest(df: DataFrame, keys: list[str], time: str, values: list[str]) -> DataFrame:
    """One row per key: that with the largest ``time``.

    Rows that tie on the time are ordered by their values, so the result never depends on the
    order of the input. A null time counts as the oldest. Rows in which a key is null are dropped.

    The rows are exchanged once by the key and aggregated behind the exchange: a table of
    deliveries holds few repeats, so that combining before the exchange would sort for nothing.
    """
    t = F.coalesce(F.col(time), F.lit(_EPOCH).cast("timestamp"))
    best = F.max(F.struct(t.alias("_t"), *[F.col(v).alias(v) for v in values])).alias("_best")
    kept = df.where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys)).select(*keys, time, *values)
    return (
        kept.repartition(*keys)
        .groupBy(*keys)
        .agg(best)
        .select(*keys, *[F.col("_best")[v].alias(v) for v in values])
    )


def plain(c: Column) -> Column:
    """The ASCII letters and digits of a label in lower case; null stays null."""
    return F.lower(F.regexp_replace(c, "[^A-Za-z0-9]", ""))


def small_map(df: DataFrame, key: str, value: str, most: int = 10_000) -> dict:
    """A two-column lookup table as a dict, for tables with a fixed bound on their rows.

    Raises if there are more than ``most`` rows, so that nothing that grows is ever collected.
    Of rows with the same key the one with the smallest value counts.
    """
    rows = df.select(key, value).where(F.col(key).isNotNull()).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"lookup table has more than {most} rows; join it instead")
    out: dict = {}
    for k, v in rows:
        if k not in out or (v is not None and v < out[k]):
            out[k] = v
    return out


def level_of(c: Column, levels: dict[str, str]) -> Column:
    """The level a dirty label stands for, or null. ``levels``: plain form to level."""
    if not levels:
        return F.lit(None).cast("string")
    pairs = [F.lit(x) for kv in sorted(levels.items()) for x in kv]
    return F.element_at(F.create_map(*pairs), plain(c))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as named in ``spark.checkpoint.dir``.

    Only in local mode, where driver and executors are one process, a temporary folder is set up
    if the setting is missing.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    import tempfile

    named = "file://" + tempfile.mkdtemp(prefix="matrixloom-")
    spark.conf.set("spark.checkpoint.dir", named)
    return named


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/matrixloom/{spark.sparkContext.applicationId}"


def drop_written(spark: SparkSession) -> bool:
    """Deletes all tables this application wrote with :func:`written`; results not yet computed from them are lost."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(_own_dir(spark))
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str = "step") -> DataFrame:
    """``df`` written to the shared folder and read again.

    Cuts the lineage and survives the loss of executors; a columnar table is a fraction of the size
    of an RDD checkpoint and lets the next step prune columns.
    """
    spark = df.sparkSession
    path = f"{_own_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ranked(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Every row with its place (from 1) in the order of some columns, without sorting all rows in one task.

    Rows are sorted by range; each partition counts its own and starts where those before it end. Rows
    equal in all columns of ``order`` are placed in no particular order among themselves. Runs a job.
    """
    part = written(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()), "ranks")
    n = part.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    n = n.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    inner = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return part.join(n, "_p").withColumn(name, (inner + F.col("_off")).cast("long")).drop("_p", "_off")
