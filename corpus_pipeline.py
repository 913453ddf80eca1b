"""A training-corpus pipeline over `documents`: STAGES in order, each on all that the one before kept.

Every stage takes (spark, docs, sf_dir); all but the last return the columns of documents, the last one
token ids. What a stage returns is written as Parquet and read again as the next one's docs.

Documents with a null text pass as empty ones. Deduplication and decontamination decide on rows by their
text, so that null and repeated ids are no matter. SQL can't express the learned stages, so ORACLE_SQL is None.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provenir.llm import byte_bpe, decontaminate, near_copies, quality, secrets
from provenir.llm.common import read_table, shared_dir, sized
from provenir.llm.queries import training_labels

ORACLE_SQL = None
#: Documents scored below this go.
LEAST_QUALITY = 0.3


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep what the classifier takes for label 1. Rows labelled outside the held-out fold train it."""
    model = quality.fit(docs, training_labels(spark, sf_dir, "quality", 5, 0))
    return quality.score_texts(docs, model, keep=docs.columns, out="__score").where(F.col("__score") >= LEAST_QUALITY).drop("__score")


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each component of near copies: the smallest id's (null ids come last), the smallest text hash of equal ids; rows with both alike are copies."""
    found = near_copies.near_copies(docs).withColumn("__id", id_hash(F.col("doc_id")))
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("h").alias("__h"), F.col("__id").alias("__id"))
    keep = found.groupBy("root").agg(F.min(order).alias("k")).select("k.__h", "k.__id")
    rows = docs.withColumns({"__h": F.xxhash64(F.coalesce("text", F.lit(""))), "__id": id_hash(F.col("doc_id"))})
    return rows.dropDuplicates(["__h", "__id"]).join(keep, ["__h", "__id"], "left_semi").select(docs.columns)


def id_hash(column: Column) -> Column:
    return F.xxhash64(column.isNull(), column)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop rows whose text holds a window of a benchmark item."""
    rows = docs.withColumn("__h", F.xxhash64(F.coalesce("text", F.lit(""))))
    found = decontaminate.document_hits(rows, read_table(spark, sf_dir, "benchmark"), doc_id="__h").where("n_hit > 0").select(F.col("h").alias("__h")).distinct()
    return rows.join(sized(found), "__h", "left_anti").select(docs.columns)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put a mask in the place of every secret; n_chars follows the text."""
    found = secrets.scan_secrets(docs, secrets.fit(docs), out="__secrets").withColumn("text", secrets.redacted(F.col("text"), F.col("__secrets")))
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return found.select(docs.columns)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document (little-endian 32-bit integers), with digests of the ids and of what they decode to."""
    return byte_bpe.encode_texts(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", dedup_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secrets_stage),
    ("tokens", tokens_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what is between them lies in the shared folder."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = shared_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
