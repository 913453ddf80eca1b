"""The registered queries of this subpackage: thin digests over the operators, on whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, chat, decontaminate, html_extract, media, quality, secrets, simhash, token_files, toxicity
from .common import fold, read_table


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    return html_extract.extract_pages(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def base_columns() -> list:
    """Of column secrets: counts by kind of pattern, and the digest of their spans."""
    base = F.filter("secrets", lambda x: x["kind"] != "random")
    count = lambda kind: F.size(F.filter("secrets", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return [count("assign"), count("access"), count("hex"), F.sha2(secrets.joined_spans(base), 256).alias("base_sha256")]


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.scan_secrets(docs, secrets.fit(docs)).select("doc_id", "secrets")
    likely = F.size(F.filter("secrets", lambda x: x["evidence"] >= secrets.EVIDENCE)).cast("long").alias("n_likely")
    return found.select("doc_id", *base_columns(), secrets.joined_spans(F.col("secrets")).alias("spans"), likely)


def secret_base_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can express of op2."""
    return op2_secret_scans(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    control = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", control), (-7, 1, "assistant", control)], "conv_id long, turn long, role string, text string")
    made = chat.format_chats(chat.records_of_rows(rows.union(extra), "conv_id", "turn", "role", "text", layouts=chat.KEPT_ROLES))
    back = made.select("conv_id", "formatted", chat.read_back(F.col("formatted")).alias("back"), chat.masked_text(F.col("formatted"), F.col("loss")).alias("masked"))
    lines = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("back").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"), F.length("masked").cast("long").alias("loss_chars"), F.sha2("masked", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("bytes"))
    stored = docs.select("doc_id", F.octet_length("bytes").cast("long").alias("n_bytes"), media.store_wave(media.padded(F.col("bytes"))).alias("media"), F.lit(media.UNKNOWN).alias("declared"))
    found = media.sniff(stored, "media", "declared", ["doc_id", "n_bytes"])
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "media_type", "corrected")


def media_byte_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can express of op4: lengths, and the digest of the payload as read back."""
    return op4_media_columns(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "media_bytes")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return byte_bpe.encode_texts(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), ids=False).drop("exact")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.phrase_matches(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def training_labels(spark: SparkSession, sf_dir: str, label: str, parts: int, held: int) -> DataFrame:
    """doc_id and label of the rows outside the held-out fold."""
    return read_table(spark, sf_dir, "labels").select("doc_id", label).where(~fold(F.col("doc_id"), parts, held))


def scored(df: DataFrame, parts: int, held: int) -> DataFrame:
    return df.select("doc_id", fold(F.col("doc_id"), parts, held).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return scored(quality.score_texts(docs, quality.fit(docs, training_labels(spark, sf_dir, "quality", 5, 0))), 5, 0)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    files = token_files.write_token_files(docs, public_tokenizers.path("word_bpe_49k.json"), token_files.token_folder(spark), end_id=2)
    return token_files.read_token_files(files)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    detector = toxicity.fit(docs, training_labels(spark, sf_dir, "toxic", 4, 2))
    return scored(toxicity.score_texts(docs, detector), 4, 2)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (op1_html_extraction, op2_secret_scans, op3_chat_formatting, op4_media_columns, op5_byte_bpe, op6_decontamination, op7_quality_classifier, op8_simhash, op9_token_files, op10_toxicity, pipeline, secret_base_columns, media_byte_columns)
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    from .oracles import ORACLES

    return ORACLES
