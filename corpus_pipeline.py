"""From raw documents to packed sequences: a chain of operators of ``recallgrid.llm``, each stage written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recallgrid.llm import ngram_join, packing, pii, quality, rules
from recallgrid.llm.common import bounded, table, write_out
from recallgrid.llm.queries import remainder, tokenizer


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the weighed votes reject go, empty texts and null texts among them.

    Each row is judged by its own text; null doc_ids and repeated rows make no difference. No rows give no rows; other columns stay.
    """
    return rules.keep_good(docs)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.3 go. The model learns from labelled documents as first read, good and bad.

    Each row is scored by its own text (null: empty); null doc_ids and repeated rows make no difference. No rows give no rows; other
    columns stay.
    """
    labels = table(spark, sf_dir, "labels").filter(remainder(5) != 0)
    model = quality.train(table(spark, sf_dir, "documents"), labels, "quality")
    return quality.keep_scored(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that with the smallest doc_id.

    Every row is a document of its own: rows that repeat a doc_id with other texts are judged by their texts, and so are rows without an
    id, which come last in their group. Among equal ids the first row read stays. Documents without words are duplicates of
    nothing and all stay. No rows give no rows; other columns stay as they are.
    """
    row = "_row"
    while row in docs.columns:
        row += "_"
    # Written: a row keeps its number, however often it is read.
    rows = write_out(docs.withColumn(row, F.monotonically_increasing_id()), "pipeline-rows")
    found = write_out(ngram_join.near_duplicates(rows.select(F.col(row).alias("doc_id"), "text")).select(
        F.col("doc_id").alias("member"), F.col("component_id").alias("group")), "pipeline-groups")
    shared = write_out(found.filter("member <> group").select("group").distinct(), "pipeline-shared")
    few = bounded(shared, ngram_join.MOST_IDS)
    members = found.join(shared if few is None else few, "group").join(
        rows.select(F.col(row).alias("member"), F.col("doc_id").alias("id")), "member")
    kept = members.groupBy("group").agg(F.min_by("member", F.struct(F.col("id").isNull(), "id", "member")).alias("member"))
    gone = write_out(members.join(kept, ["group", "member"], "left_anti").select(F.col("member").alias(row)), "pipeline-copies")
    few = bounded(gone, ngram_join.MOST_IDS)
    return rows.join(gone if few is None else few, row, "left_anti").drop(row)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is masked; null texts stay null. Every row stays, with its other columns. No rows give no rows."""
    return pii.mask(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in as few sequences of 4096 tokens as best fit finds; the columns of ``packing.pack``.

    Null and empty texts are a closing id each. Null doc_ids and repeated rows are packed like others. No rows give no rows; other
    columns are ignored.
    """
    return packing.pack(docs, tokenizer("word_bpe_49k.json"), 4096)


STAGES = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("best_fit_packing", best_fit_packing),
]

#: The classifier, the weighed votes and the tokenizer cannot be told in SQL; the tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = write_out(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
