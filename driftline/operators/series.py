"""Group statistics and annual time-series operators.

Designed for a handful of (region, season) groups over very many rows: every
statistic is a groupBy aggregate (partial aggregation on each task, a few
rows shuffled), computed once into a small table, and attached back where
rows need it. No window ever runs over the row-level table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.functions.numeric import infinity, nan_to_null, row_sum


def positive_min(value: str, empty: str = "inf") -> Column:
    """Aggregate: the smallest value above zero.

    A group without any positive value gets +Infinity (``empty='inf'``, what
    R's ``min`` of an empty vector gives) or NULL (``empty='null'``).
    """
    m = F.min(F.when(F.col(value) > 0, nan_to_null(value)))
    if empty == "inf":
        return F.coalesce(m, infinity())
    if empty != "null":
        raise ValueError(f"empty must be 'inf' or 'null', not {empty!r}")
    return m


def plain_min(value: str) -> Column:
    """Aggregate: the smallest value (rows are already filtered by the caller)."""
    return F.min(nan_to_null(value))


def group_row_sum(df: DataFrame, keys: Sequence[str], cols: Sequence[str], name: str) -> DataFrame:
    """Per group, the sum over all rows and all ``cols`` (missing skipped, empty = 0)."""
    return df.groupBy(*keys).agg(F.sum(row_sum(cols)).alias(name))


def annual_mean(df: DataFrame, keys: Sequence[str], value: str, name: str,
                weight: str | None = None) -> DataFrame:
    """One row per group with the mean of ``value`` (missing and NaN skipped).

    ``weight`` adds the number of rows in the group, including rows whose
    value is missing: that is how many rows carry the mean when it is written
    onto every row of the group.
    """
    aggs = [F.avg(nan_to_null(value)).alias(name)]
    if weight:
        aggs.append(F.count(F.lit(1)).alias(weight))
    return df.groupBy(*keys).agg(*aggs)


def weighted_annual_mean(df: DataFrame, keys: Sequence[str], value: str, name: str,
                         rows: str, weight: str) -> DataFrame:
    """:func:`annual_mean` over a table where each entry stands for ``rows`` identical rows."""
    x = nan_to_null(value)
    w = F.col(rows)
    return df.groupBy(*keys).agg(
        F.try_divide(F.sum(x * w), F.sum(F.when(x.isNotNull(), w))).alias(name),
        F.sum(w).alias(weight))


def running_mean(df: DataFrame, part: Sequence[str], order: str, value: str, name: str,
                 k: int = 5, complete: bool = False) -> DataFrame:
    """Trailing mean over the current row and the ``k - 1`` rows before it.

    Rows, not calendar years, make the frame (a gap year does not shorten it).
    ``complete=False``: partial windows at the start, missing values skipped.
    ``complete=True``: NULL unless the frame holds ``k`` rows, all present.
    """
    w = Window.partitionBy(*part).orderBy(F.col(order).asc_nulls_last()).rowsBetween(1 - k, 0)
    x = nan_to_null(value)
    mean = F.avg(x).over(w)
    if complete:
        mean = F.when((F.count(F.lit(1)).over(w) == k) & (F.count(x).over(w) == k), mean)
    return df.withColumn(name, mean)


def with_weighted_sd(annual: DataFrame, part: Sequence[str], value: str, weight: str,
                     name: str) -> DataFrame:
    """Sample SD (n - 1) of a per-year value repeated on ``weight`` rows per year.

    Equals ``stddev_samp`` over the row-level table that carries the yearly
    value on each row, computed from the small annual table alone (centred
    two-pass form) and written onto its rows. Years with a missing value drop
    out; one row gives NULL.
    """
    w, x = Window.partitionBy(*part), nan_to_null(value)
    k = F.when(x.isNotNull(), F.col(weight))
    n = F.sum(k).over(w)
    tmp = annual.withColumns({"_n": n, "_m": F.try_divide(F.sum(k * x).over(w), n)})
    squares = F.sum(k * F.pow(x - F.col("_m"), F.lit(2.0))).over(w)
    sd = F.when(F.col("_n") > 1, F.sqrt(F.try_divide(squares, F.col("_n") - 1)))
    return tmp.withColumn(name, sd).drop("_n", "_m")


def year_sd(annual: DataFrame, part: Sequence[str], value: str, name: str) -> DataFrame:
    """Sample SD of the per-year values, each year counted once. One row per group."""
    return annual.groupBy(*part).agg(F.stddev_samp(nan_to_null(value)).alias(name))


def with_year_sd(annual: DataFrame, part: Sequence[str], value: str, name: str) -> DataFrame:
    """:func:`year_sd` written onto every annual row."""
    return annual.withColumn(name, F.stddev_samp(nan_to_null(value)).over(Window.partitionBy(*part)))


def descending_report(sd: DataFrame, region: str, season: str) -> DataFrame:
    """SD report rows, region names descending, then season (a total order)."""
    return sd.orderBy(F.col(region).desc_nulls_last(), F.col(season).asc_nulls_last())
