"""Proportional stratified interleaving into shards (DataFrame functions only).

Rows are shuffled by a seeded hash inside their source, get the fractional rank
``(rank - 0.5) / rows of the source``, and are sorted by it over all sources.
Any contiguous run of that order holds the sources in their overall
proportions, so cutting it into equal runs gives shards that all match the
mixture, with row counts at most one apart (law ``rows``).

Both ranks come from a range-partitioned sort with per-partition offsets
(`number_rows`): a source with a third of all rows is spread over the sort's
tasks, never numbered in one window. Only ids, sizes, checksums and hashes are
shuffled, no text.

Defined results: a null source is a stratum of its own; a null text has size 8
(no bytes plus the per-row 8) and checksum 0; texts of any length are one row
(only size and checksum travel); repeated rows each get a slot;
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import empty_if_null
from driftline.operators.ordering import number_rows

ROW_OVERHEAD = 8


def interleave(docs: DataFrame, shards: int, seed: int = 42, id_col: str = "doc_id",
               text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, size, text_crc32, source, fraction, shard, slot), one row per input row."""
    if shards < 1:
        raise ValueError("shards must be positive")
    text = empty_if_null(F.col(text_col))
    base = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"),
        (F.octet_length(text) + ROW_OVERHEAD).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)).alias("draw"))
    tie = [F.col("draw"), F.col("doc_id"), F.col("text_crc32"), F.col("size")]
    inside = number_rows(base, [F.col("source"), *tie], "n")
    strata = inside.groupBy("source").agg(F.min("n").alias("first_n"), F.count(F.lit(1)).alias("rows"))
    total = strata.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    if total == 0:
        return base.select("doc_id", "size", "text_crc32", "source", F.lit(0.0).alias("fraction"),
                           F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    strata = strata.select(F.col("source").alias("s"), "first_n", "rows")
    ranked = (inside.join(strata, F.col("source").eqNullSafe(F.col("s")))
                    .select("doc_id", "source", "size", "text_crc32", "draw",
                            ((F.col("n") - F.col("first_n") + 0.5) / F.col("rows")).alias("fraction")))
    placed = number_rows(ranked, [F.col("fraction"), F.col("source"), *tie], "place")
    place = F.col("place") - 1
    shard = F.expr(f"((place - 1) * {shards}) div {total}")
    return (placed.withColumn("shard", shard.cast("int"))
                  .select("doc_id", "size", "text_crc32", "source", "fraction", "shard",
                          (place - F.expr(f"(shard * {total}L + {shards - 1}) div {shards}")).alias("slot")))
