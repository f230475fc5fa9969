"""Stored tables: the record index, the booking log, golden sets and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from recallgrid.functions.vectors import check_dimension
from recallgrid.operators.ingest import touched
from recallgrid.schema import GOLDEN_QUERY
from recallgrid.sources.booking_log import append_log, compact_log, create_log, read_bookings  # noqa: F401

# Filter columns of the index; rows are clustered by them so that Parquet statistics skip row groups.
CLUSTER = ("origin", "dest", "carrier", "day", "flight", "sched_dep_time")


def create_index(spark: SparkSession, path: str, schema: T.StructType, partitions: Sequence[str] = ("year", "month")) -> None:
    """An empty index with its schema, unless there is one already."""
    spark.createDataFrame([], schema).write.mode("ignore").partitionBy(*partitions).parquet(path)


def append_index(
    rows: DataFrame, path: str, dim: int | None, vec: str = "embedding", partitions: Sequence[str] = ("year", "month"),
    cluster: Sequence[str] = CLUSTER,
) -> None:
    """Append rows whose ids are not stored yet. A vector of another length fails the write (``dim`` None: there are no vectors).

    The rebalance hint lets AQE split large and merge small output partitions, so a month holding most rows does not end
    in one file and one task.
    """
    checked = rows if dim is None else rows.withColumn(vec, check_dimension(F.col(vec), dim))
    laid_out = checked.hint("rebalance", *partitions) if partitions else checked
    inside = [c for c in cluster if c in rows.columns]
    laid_out = laid_out.sortWithinPartitions(*partitions, *inside)
    laid_out.write.mode("append").partitionBy(*partitions).parquet(path)


def read_index(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    return spark.read.schema(schema).parquet(path) if schema else spark.read.parquet(path)


def stored_ids(
    spark: SparkSession, path: str, schema: T.StructType, key: str = "flight_id", batch: DataFrame | None = None,
    partitions: Sequence[str] = (),
) -> DataFrame:
    """Ids and the named partition columns only; the scan reads no vector and no payload.

    With ``batch``, only those partitions are read that it has rows for.
    """
    index = read_index(spark, path, schema)
    if batch is not None:
        index = index.filter(touched(batch, partitions))
    return index.select(*partitions, key)


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """A golden set: JSON arrays, one a file, or JSON lines as ``write_golden`` makes them."""
    read = spark.read.schema(GOLDEN_QUERY).json(path, multiLine=not path.rstrip("/").endswith(".jsonl"))
    return read.select(*GOLDEN_QUERY.names)


def write_golden(entries: DataFrame, path: str, mode: str = "error") -> None:
    entries.write.mode(mode).json(path)


def write_golden_arrays(entries: DataFrame, path: str, per_file: int = 1000, mode: str = "error") -> None:
    """A golden set as JSON arrays: one where it has at most ``per_file`` entries, else one a file, of about so many entries."""
    parts = max(1, -(-entries.count() // per_file))
    entry = F.struct(*[c for c in GOLDEN_QUERY.names if c in entries.columns])
    part = F.pmod(F.xxhash64("query", "notes") if "notes" in entries.columns else F.xxhash64("query"), F.lit(parts))
    arrays = entries.groupBy(part.alias("part")).agg(F.to_json(F.collect_list(entry)).alias("value"))
    arrays.write.mode(mode).partitionBy("part").text(path)


def expected_ids(golden: DataFrame, key: str = "query", id_col: str = "flight_id") -> DataFrame:
    """Golden entries in long form, one row per expected id."""
    return golden.select(key, F.explode("expected_flight_ids").alias(id_col))


def report(models: DataFrame, **parameters: float | int | str) -> DataFrame:
    """One JSON text with the run parameters and the model rows, best first (one row per model, so a small list)."""
    rows = models.agg(F.array_sort(
        F.collect_list(F.struct(*models.columns)),
        lambda a, b: F.when(a["composite"] > b["composite"], -1).when(a["composite"] < b["composite"], 1).otherwise(0),
    ).alias("models"))
    return rows.select(F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in parameters.items()], "models")).alias("value"))


def write_report(report_row: DataFrame, path: str) -> None:
    report_row.write.text(path)
