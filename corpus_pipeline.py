"""The corpus pipeline: documents to packed training sequences.

Five stages, each one of the operators of ``driftline.llm``; the result of each
is written as Parquet under the shared checkpoint folder and reread as the next
one's documents. All stages but the last return the columns of their input.

Defined results of every stage: null, empty and very long texts are documents
like any other (a null text is scored as an empty one, has no lines, fingerprint
zero and no words, and is packed as an empty one); of near duplicates the row
with the smallest id stays, a null id last, then the smallest text hash; rows
that repeat a whole row are documents of their own, of which the near-duplicate
stage keeps one; null ids take part; extra columns pass through unchanged,
whatever their names; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm.catalog import held_out
from driftline.llm.common import forget, stored
from driftline.llm.line_chunks import dedup_lines
from driftline.llm.mbs_packing import pack
from driftline.llm.rule_ensemble import train
from driftline.llm.simhash_ball import keep_one
from driftline.llm.winnow import drop_contaminated


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = train(docs, labels.filter(~held_out(F.col("doc_id"))), "quality")
    return docs.filter(model.score(F.col("text")) >= 0.5)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without multi-line chunks that occurred before; ``n_chars`` follows the text."""
    out = dedup_lines(docs)
    new = {"text": F.col("left"), "n_chars": F.coalesce(F.length("left").cast("long"), F.col("row.n_chars"))
           if "n_chars" in docs.columns else None}
    out = out.withColumnRenamed("text", "left")
    return out.select(*[new[c].alias(c) if new.get(c) is not None else F.col("row").getField(c).alias(c)
                        for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return keep_one(docs, k=4, radius=4)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all token pieces in sequences of 2048."""
    return pack(docs, vocabulary="byte_bpe_50k.json", capacity=2048)


STAGES = [
    ("quality", quality),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: fingerprints, tokens and a trained model are beyond SQL; tested against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        last, docs = docs, stored(stage(spark, docs, sf_dir), name)
        forget(last)  # a table of an earlier stage; the input itself stays
    return docs
