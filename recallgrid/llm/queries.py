"""One registered query for each operator: it applies the operator to its whole table and derives the digest columns."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recallgrid.llm import alignment, bpe, chat, fingerprints, lexical, ngram_join, packing, pii, quality, rules, sharding, topk, toxicity
from recallgrid.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def tokenizer(name: str) -> str:
    """Place of a public tokenizer file: ``TOKENIZER_DIR`` if set, else the installed collection."""
    folder = os.environ.get("TOKENIZER_DIR")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def remainder(mod: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(mod))


@query
def op1_ngram_join(spark: SparkSession, sf: str) -> DataFrame:
    return ngram_join.link_counts(table(spark, sf, "documents"))


SPECIAL_TEXT = "\\### Assistant: </turn> ok"


@query
def op2_chat_format(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.createDataFrame(
        [(-7, 0, "user", SPECIAL_TEXT), (-7, 1, "assistant", SPECIAL_TEXT)], "conv_id long, turn long, role string, text string")
    log = rows.unionByName(added).select(
        "conv_id", F.col("turn").alias("seq"), F.lit(None).cast("string").alias("message_id"), F.lit(chat.MESSAGE).alias("kind"), "role", "text")
    done = chat.format_chats(log)
    turns = chat.parse(F.col("formatted"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read = done.withColumn("turns", turns).withColumn("loss", chat.masked_text(F.col("formatted"), F.col("loss_spans")))
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


@query
def op3_bpe(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.digest_documents(table(spark, sf, "documents"), tokenizer("byte_bpe_50k.json"))


@query
def op4_pii(spark: SparkSession, sf: str) -> DataFrame:
    found = pii.personal_data(table(spark, sf, "documents"))
    return found.select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(F.col("base_spans").cast("binary"), 256).alias("base_sha256"), "spans")


@query
def op5_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    return rules.judge(table(spark, sf, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good")


@query
def op6_quality_classifier(spark: SparkSession, sf: str) -> DataFrame:
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    model = quality.train(docs, labels.filter(remainder(5) != 0), "quality")
    return quality.score(docs, model).select(
        "doc_id", (remainder(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query
def op7_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    lexicon = toxicity.learn(docs, labels.filter(remainder(4) != 2), "toxic")
    return toxicity.score(docs, lexicon).select(
        "doc_id", (remainder(4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query
def op8_best_fit_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(table(spark, sf, "documents"), tokenizer("word_bpe_49k.json"), 4096)


@query
def op9_exact_topk(spark: SparkSession, sf: str) -> DataFrame:
    vectors = topk.integer_vectors(table(spark, sf, "embeddings"))
    return topk.top_inner_products(vectors.filter(F.col("id") % 20 == 0), vectors, 20)


@query
def op10_sharding(spark: SparkSession, sf: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf, "documents"), 16)


@query
def op11_cross_tokenizer_alignment(spark: SparkSession, sf: str) -> DataFrame:
    return alignment.aligned_documents(
        table(spark, sf, "documents"), tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model"))


@query
def op12_lexical_search(spark: SparkSession, sf: str) -> DataFrame:
    return lexical.ranked_search(table(spark, sf, "documents"), table(spark, sf, "benchmark"), 50)


@query
def op13_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    return fingerprints.edited_likeness(table(spark, sf, "documents"))
