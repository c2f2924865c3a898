"""Consecutive row numbers under a global order, without a single-task window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.plans.materialize import broadcast_bounded, materialize

_LOCAL_BITS = 33  # monotonically_increasing_id = partition id << 33 | position


def number_rows(df: DataFrame, order: Sequence[Column], name: str = "row_id") -> DataFrame:
    """Add 1..n following ``order`` (which should be total for a unique numbering).

    A range-partitioned sort spreads the rows; each task tags its rows with
    (partition, position); the per-partition counts (one row per partition)
    give offsets. ``row_number()`` over an unpartitioned window would instead
    pull every row into one task.
    """
    tagged = materialize(df.orderBy(*order).withColumn("_mid", F.monotonically_increasing_id()))
    part = F.shiftright("_mid", _LOCAL_BITS)
    local = F.col("_mid").bitwiseAND((1 << _LOCAL_BITS) - 1)
    counts = tagged.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(
        "_part",
        F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).alias("_offset"))
    # one row per partition of the range-partitioned sort (at most the shuffle partitions)
    n_parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    numbered = (tagged.withColumn("_part", part)
                      .join(broadcast_bounded(offsets, n_parts), "_part")
                      .withColumn(name, F.col("_offset") + local + 1))
    return numbered.select(name, *df.columns)
