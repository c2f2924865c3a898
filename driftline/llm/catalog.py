"""Registered queries of this subpackage: every operator over its whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm.interleave import interleave
from driftline.llm.licenses import scan
from driftline.llm.line_chunks import dedup_lines
from driftline.llm.mbs_packing import pack
from driftline.llm.personal_data import find_personal_data
from driftline.llm.perspectives import rotate
from driftline.llm.repeats import Repeats
from driftline.llm.rule_ensemble import train
from driftline.llm.simhash_ball import simhash_groups
from driftline.llm.spelling import count_words, spelling_variants, word_runs
from driftline.llm.turn_repair import Repair, damage
from driftline.llm.uniform_threshold import top_k
from driftline.llm.winnow import contamination


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """Rows that no label is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes of 200-byte strings that also start elsewhere."""
    out = Repeats(_read(spark, sf_dir, "documents"), length=200).removed()
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans",
                      F.sha2(F.col("kept"), 256).alias("kept_sha256"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into shards 0 to 23 that match the source mixture."""
    out = interleave(_read(spark, sf_dir, "documents"), shards=24)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"), "source", "fraction")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What content-defined line dedup leaves of every document."""
    out = dedup_lines(_read(spark, sf_dir, "documents"))
    return out.select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_removed", "n_chunks",
                      F.sha2(F.col("text"), 256).alias("kept_sha256"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learned from the rows that are not held out."""
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    model = train(docs, labels.filter(~held_out(F.col("doc_id"))), "quality")
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), model.score(F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in every document."""
    out = contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"),
                      (F.col("n_hit") > 0).alias("contaminated"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprint and near-duplicate component of every document."""
    out = simhash_groups(_read(spark, sf_dir, "documents"), k=4, radius=4)
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation from the perspective of each participant."""
    out = rotate(_read(spark, sf_dir, "conversations"))
    spans = F.transform("mask", lambda m: F.concat_ws("-", m["start"].cast("string"), m["stop"].cast("string")))
    return out.withColumn("mask", F.array_join(spans, ","))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    return pack(_read(spark, sf_dir, "documents"), vocabulary="byte_bpe_50k.json", capacity=2048)


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best candidates of every query vector."""
    return top_k(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence of every document; its path is made of source, language and id."""
    docs = _read(spark, sf_dir, "documents")
    path = F.concat_ws("/", "source", "lang", F.expr("cast(doc_id div 100 as string)"),
                       F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    out = scan(docs.select("doc_id", path.alias("path"), "text"))
    return out.withColumnRenamed("id", "doc_id")


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: base spans, and those the labelers' votes add."""
    out = find_personal_data(_read(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_email", "n_ip", "n_card", "n_phone",
                      F.sha2(F.col("base"), 256).alias("base_sha256"), "spans")


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cheapest repair of every conversation after damage drawn from its ids."""
    turns = _read(spark, sf_dir, "conversations")
    report = Repair(damage(turns)).report()
    every = turns.select("conv_id").distinct().join(report, F.col("conv_id").eqNullSafe(F.col("conv")), "left")
    counts = [F.coalesce(c, F.when(F.col("audit").isNull(), F.lit(0).cast("long"))).alias(c)
              for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"),
                        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms and roots of the words of all documents, one run in 31 short of a letter."""
    runs = word_runs(_read(spark, sf_dir, "documents"))
    draw = F.crc32(F.concat(F.coalesce("id", F.lit("")), F.lit(":"), F.col("run")))
    at = (draw % F.length("run")).cast("int")
    shorter = F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.length("run")))
    words = count_words(runs, F.when(draw % 31 == 0, shorter).otherwise(F.col("run")))
    return spelling_variants(words)


QUERIES = {
    "op1_suffix_array_dedup": op1_suffix_array_dedup,
    "op2_sharding": op2_sharding,
    "op3_line_dedup": op3_line_dedup,
    "op4_quality": op4_quality,
    "op5_decontamination": op5_decontamination,
    "op6_simhash": op6_simhash,
    "op7_chat_formatting": op7_chat_formatting,
    "op8_packing": op8_packing,
    "op9_top_k": op9_top_k,
    "op10_licenses": op10_licenses,
    "op11_personal_data": op11_personal_data,
    "op12_turn_repair": op12_turn_repair,
    "op13_spelling_variants": op13_spelling_variants,
}
