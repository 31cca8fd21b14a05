"""Exact percentiles of groups of any size, from frequencies sorted by range."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .relational import written


def quantiles(freq: DataFrame, by: Sequence[str], probs: Mapping[str, float], least: int = 1) -> DataFrame:
    """(``by``, n_values, one column per probability) of (``by``, value, n), linearly interpolated; groups with ``least`` values or more.

    The frequency table is sorted by range over (group, value), so a group that holds a third of it
    spreads over as many partitions as its rows need. Each partition sums up its own frequencies, the
    partition totals (one row per partition and group) give the offsets, and per target rank the first
    value whose cumulative frequency exceeds it is picked: only target rows are ever aggregated. Groups without values do not come out.
    """
    g = [F.col(c) for c in by]
    # written, as both uses below must see the same partition numbers whatever executor is lost
    part = written(freq.repartitionByRange(*g, F.col("value")).withColumn("_p", F.spark_partition_id()), "ranges")
    inner = Window.partitionBy("_p", *by).orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    run = part.withColumn("_run", F.sum("n").over(inner))
    tot = part.groupBy("_p", *by).agg(F.sum("n").alias("_t"))
    whole = Window.partitionBy(*by)
    tot = tot.withColumn("_off", F.sum("_t").over(whole.orderBy("_p")) - F.col("_t")).withColumn("n_values", F.sum("_t").over(whole))
    cond = F.col("r._p") == F.col("o._p")
    for c in by:
        cond = cond & F.col(f"r.{c}").eqNullSafe(F.col(f"o.{c}"))
    j = run.alias("r").join(tot.where(F.col("n_values") >= least).alias("o"), cond)
    upto = F.col("r._run") + F.col("o._off")
    rows = j.select(*[F.col(f"r.{c}").alias(c) for c in by], F.col("r.value").alias("value"), (upto - F.col("r.n")).alias("_from"), upto.alias("_upto"), "o.n_values")

    def at(rank):
        return F.max(F.when((F.col("_from") <= rank) & (rank < F.col("_upto")), F.col("value")))

    aggs, wanted = [F.max("n_values").alias("n_values")], F.lit(False)
    for name, p in probs.items():
        h = F.lit(float(p)) * (F.col("n_values") - 1)
        for tag, rank in (("lo", F.floor(h)), ("hi", F.ceil(h))):
            aggs.append(at(rank).alias(f"_{tag}_{name}"))
            wanted = wanted | ((F.col("_from") <= rank) & (rank < F.col("_upto")))
    picked = rows.where(wanted).groupBy(*by).agg(*aggs)
    out = []
    for name, p in probs.items():
        h = F.lit(float(p)) * (F.col("n_values") - 1)
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        out.append((lo + (hi - lo) * (h - F.floor(h))).alias(name))
    return picked.select(*by, "n_values", *out)
