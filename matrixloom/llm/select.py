"""Places of rows in the random order of their group, without ranking whole groups; groups of a partition in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows aimed at in one slice of a group's key range, and the most slices of a group.
SLICE_ROWS, MOST_SLICES = 20_000, 65_536
#: Rows of the largest group that meet the table of groups under one salt.
SALT_ROWS = 200_000


def random_key(seed: int, *cols: str) -> Column:
    """A 62-bit key that depends on the seed and the columns only, not on the partitioning."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *[F.col(c) for c in cols]), 2)


def positions(rows: DataFrame, groups: DataFrame, on: str, by: Sequence[str], key: Column, tie: str, weight: str) -> DataFrame:
    """``rows`` with the columns of their group and ``_mid``: the middle of the row's weight in the order of the keys.

    ``groups`` (a written table, as it is read twice) has ``by``, ``on`` (what rows find their groups by, as
    they may belong to several), ``n_rows`` and ``cuts``, an ascending array of places. ``key`` is evaluated on
    rows joined with their group. ``_mid`` lies on the same side of every cut as the exact middle does; rows with
    a null in ``on`` and groups without rows give nothing.

    The key range of a group is cut into slices of about ``SLICE_ROWS`` rows. Slice totals are pre-aggregated
    on the map side and summed up over the few slices; rows of a slice without a cut share its middle and only
    slices with a cut in them are ranked, so a group may hold any share of all rows. The salts that spread
    the rows of a group over tasks follow the size of the largest group.
    """
    most = groups.agg(F.max("n_rows")).first()[0] or 0
    salts = max(1, -(-most // SALT_ROWS))
    slices = F.greatest(F.lit(1), F.least(F.lit(MOST_SLICES), F.ceil(F.col("n_rows") / SLICE_ROWS))).cast("long")
    g = groups.withColumn("_n", slices).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    r = rows.withColumn("_salt", F.pmod(F.xxhash64(F.col(tie)), F.lit(salts)).cast("int")).join(g, [on, "_salt"]).drop("_salt")
    r = r.withColumn("_key", key).withColumn("_slice", F.floor(F.col("_key") / F.lit(float(1 << 62)) * F.col("_n")))
    totals = r.groupBy(*by, "_slice").agg(F.sum(weight).alias("_w"), F.first("cuts").alias("_cuts"))
    run = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("_before", F.coalesce(F.sum("_w").over(run), F.lit(0)))
    within = F.exists("_cuts", lambda c: (c > F.col("_before")) & (c < F.col("_before") + F.col("_w")))
    r = r.join(totals.select(*by, "_slice", "_before", "_w", within.alias("_cut")), [*by, "_slice"])
    whole = r.where(~F.col("_cut")).withColumn("_mid", F.col("_before") + F.col("_w") / 2)
    upto = F.sum(weight).over(Window.partitionBy(*by, "_slice").orderBy("_key", tie).rowsBetween(Window.unboundedPreceding, 0))
    edge = r.where("_cut").withColumn("_mid", F.col("_before") + upto - F.col(weight) / 2)
    return whole.unionByName(edge).drop("_key", "_slice", "_n", "_before", "_w", "_cut")


def by_group(df: DataFrame, key: str, solve: Callable[[list[dict]], list[dict]], schema: str) -> DataFrame:
    """``solve`` on the rows of each value of ``key``, for groups that are small whatever the data.

    Groups are spread over as many tasks as the session has cores or shuffle partitions.
    """
    spark = df.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    types = spark.createDataFrame([], schema).schema
    names = types.names

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(types)
        held: list[dict] = []
        done: list[dict] = []
        for batch in it:
            for row in batch.to_pylist():
                if held and held[0][key] != row[key]:
                    done += solve(held)
                    held = []
                held.append(row)
            if len(done) > 10_000:
                yield pa.RecordBatch.from_pylist(done, arrow)
                done = []
        if held:
            done += solve(held)
        if done:
            yield pa.RecordBatch.from_pylist([{n: d.get(n) for n in names} for d in done], arrow)

    return df.repartition(tasks, key).sortWithinPartitions(key).mapInArrow(run, schema)
