"""Connected components of an edge table, as joins and partial aggregates.

Alternating large-star and small-star steps: every node links its larger
(then its smaller) neighbours to the smallest one it sees, until each
component is a star around its smallest node. The number of rounds grows with
the logarithm of the component size. Each round is stored in the shared
checkpoint folder, so a lost executor costs at most that round. Nothing is
collected: a hub with very many links is one partial minimum and a join that
AQE can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import forget, freed_shuffles, stored


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
        e.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    least = least.select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    return (both.join(least, F.col("u") == F.col("w")).filter("v > u")
                .select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct())


def _small_star(e: DataFrame) -> DataFrame:
    least = e.groupBy("hi").agg(F.min("lo").alias("m"))
    rest = (e.join(least.withColumnRenamed("hi", "w"), F.col("hi") == F.col("w"))
             .filter("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")))
    return rest.unionByName(least.select("hi", F.col("m").alias("lo"))).distinct()


def _mark(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("hi", "lo"))).first())


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node that has a link to another node and is not the
    root itself; ``root`` is the smallest node of the component."""
    with freed_shuffles(edges.sparkSession):
        e = stored(edges.filter(F.col(a) != F.col(b))
                        .select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct(), "edges")
        mark = _mark(e)
        while mark[0]:
            last, e = e, stored(_small_star(_large_star(e)), "edges")
            forget(last)
            new = _mark(e)
            if new == mark:
                break
            mark = new
    out = e.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    out.scratch = e.scratch
    return out
