"""Row filters against an aggregate of the whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def scalar_max(df: DataFrame, col: str, skip_missing: bool = False) -> Column:
    """The maximum of a column as an uncorrelated scalar subquery.

    One missing value makes it missing, as an R maximum is, unless ``skip_missing``.
    The subquery is a partial aggregate over this one column: one row per task.
    """
    top = F.max(col)
    if not skip_missing:
        top = F.when(F.count_if(F.col(col).isNull()) == 0, top)
    return df.agg(top.alias("top")).scalar()


def up_to_max(df: DataFrame, col: str, lo, skip_missing: bool = False) -> DataFrame:
    """``between(col, lo, max(col))``: with a missing value in the column no row passes,
    unless ``skip_missing``."""
    return df.filter(F.col(col).between(lo, scalar_max(df, col, skip_missing)))
