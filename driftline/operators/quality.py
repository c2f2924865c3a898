"""Data-quality summaries: missing counts, blank counts, repeated keys."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType


def is_missing(df: DataFrame, col: str) -> Column:
    """NULL, or NaN in a floating-point column."""
    x = F.col(col)
    floating = isinstance(df.schema[col].dataType, (DoubleType, FloatType))
    return x.isNull() | F.isnan(x) if floating else x.isNull()


def null_profile(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row: number of missing values per column, named after the column."""
    return df.agg(*[F.count_if(is_missing(df, c)).alias(c) for c in cols])


def is_blank(col: str | Column) -> Column:
    """Blank text: the empty string, or NULL (an unquoted blank read from CSV)."""
    x = F.col(col) if isinstance(col, str) else col
    return x.isNull() | (x == "")


def blank_counts(df: DataFrame, tests: Mapping[str, Column]) -> DataFrame:
    """One row of counts, one per named predicate."""
    return df.agg(*[F.count_if(pred).alias(name) for name, pred in tests.items()])


def repeated_keys(df: DataFrame, keys: Sequence[str], name: str = "n",
                  at_least: int = 2) -> DataFrame:
    """Key combinations occurring ``at_least`` times, with their count."""
    return (df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
              .filter(F.col(name) >= at_least))
