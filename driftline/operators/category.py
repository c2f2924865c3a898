"""Ordered categories: a text column that carries its levels, and operators in level order.

The levels travel in the column's metadata, through projections, filters, joins
and Parquet files, so that later steps need no rank column and no list.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.functions.classify import factor_rank

LEVELS = "levels"


def as_category(df: DataFrame, col: str, levels: Sequence[str], name: str | None = None) -> DataFrame:
    """``df`` with ``col`` (or a new column ``name``) as an ordered category: values outside
    ``levels`` become missing."""
    if len(set(levels)) != len(levels):
        raise ValueError("levels repeat")
    name = name or col
    value = F.when(F.col(col).isin(*levels), F.col(col)).alias(name, metadata={LEVELS: list(levels)})
    kept = [F.col(c) for c in df.columns if c != name]
    if name not in df.columns:
        return df.select(*kept, value)
    at = df.columns.index(name)
    return df.select(*kept[:at], value, *kept[at:])


def levels(df: DataFrame, col: str) -> list[str]:
    """The levels of a category column."""
    found = df.schema[col].metadata.get(LEVELS)
    if found is None:
        raise TypeError(f"{col} is no category")
    return list(found)


def level_rank(df: DataFrame, col: str) -> Column:
    """1-based level number, missing for a missing value."""
    return factor_rank(col, levels(df, col))


def sort_by(df: DataFrame, *cols: str) -> DataFrame:
    """Ascending sort, missing last; categories by level, other columns by value."""
    order = [level_rank(df, c) if LEVELS in df.schema[c].metadata else F.col(c) for c in cols]
    return df.orderBy(*[x.asc_nulls_last() for x in order])


def count_levels(df: DataFrame, col: str, *aggregates: Column, keep_empty: bool = True) -> DataFrame:
    """One row per level in use and one for missing values (with ``keep_empty`` one per level of
    the category): (col, level, n, aggregates...); ``level`` is the level's number."""
    ranked = df.groupBy(level_rank(df, col).alias("level")).agg(F.count(F.lit(1)).alias("n"), *aggregates)
    names = levels(df, col)
    known = df.sparkSession.range(1, len(names) + 1, 1, 1).select(F.col("id").cast("int").alias("number"))
    out = known.join(ranked, F.col("number") == F.col("level"), "full") if keep_empty else ranked.withColumn("number", F.col("level"))
    label = F.get(F.array(*[F.lit(x) for x in names]), F.col("number") - 1)
    rest = [c for c in ranked.columns if c not in ("level", "n")]
    return out.select(label.alias(col, metadata={LEVELS: names}), F.col("number").alias("level"),
                      F.coalesce("n", F.lit(0)).cast("long").alias("n"), *rest)
