"""Problem 4: exact or bounded-error percentiles from mergeable frequency tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.quantiles import quantiles


def frequencies(df: DataFrame, by: list[str], value: str, step: float | None = None) -> DataFrame:
    """A mergeable summary: how often each group has each value (columns ``by``, ``value``, ``n``).

    Null, NaN and infinite values are left out; a null in ``by`` is a group of its own. With ``step``
    the values are first rounded to its multiples, which moves every percentile by ``step / 2`` at
    most and bounds the table by range / step rows a group; without it percentiles are exact. -0.0
    counts as 0.0.
    """
    v = F.col(value)
    fine = df.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))
    v = (F.round(v / F.lit(step)) * F.lit(step) if step else v) + F.lit(0.0)
    return fine.select(*by, v.alias("value")).groupBy(*by, "value").agg(F.count(F.lit(1)).alias("n"))


def merge_frequencies(*parts: DataFrame) -> DataFrame:
    """Summaries of separate days or partitions as one; merging is associative and loses nothing."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy([c for c in out.columns if c != "n"]).agg(F.sum("n").alias("n"))


def percentiles(freq: DataFrame, by: list[str], probs: dict[str, float], least: int = 1) -> DataFrame:
    """Percentiles of every group with ``least`` values or more, linearly interpolated.

    ``freq`` as from :func:`frequencies`; ``probs``: result column to probability. Returns ``by``,
    ``n_values`` and one column per probability. Groups without values do not come out. Cumulative frequencies are
    sums within range-sorted partitions plus the partitions' offsets (:mod:`..functions.quantiles`), whatever a group's share.
    """
    return quantiles(freq, by, probs, least)
