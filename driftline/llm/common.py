"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.session import delete_scratch, scratch_path

_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write a table once under the shared checkpoint folder and read it back.

    Cuts the lineage: a lost executor re-reads files instead of recomputing.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    out = df.sparkSession.read.parquet(path)
    out.scratch = path
    return out


def forget(*tables: DataFrame | None) -> None:
    """Delete stored tables that no later plan reads; other frames are left alone."""
    for table in tables:
        path = getattr(table, "scratch", None)
        if path:
            delete_scratch(table.sparkSession, path)
            table.scratch = None


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Let Spark drop the shuffle files of each finished action inside the block.

    For loops and multi-pass jobs whose passes end in a stored table: the live
    shuffle data is that of one pass, not of all passes together.
    """
    before = spark.conf.get(_FREE, None)
    spark.conf.set(_FREE, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_FREE)
        else:
            spark.conf.set(_FREE, before)


def task_count(spark: SparkSession) -> int:
    """Tasks for a stage whose work is in the rows' contents, not in their bytes: a repartition
    by this number is not coalesced by size."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    A lambda that captures a column expression evaluates it anew for every
    element; bound as the single element of an array it is a variable.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def empty_if_null(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))
