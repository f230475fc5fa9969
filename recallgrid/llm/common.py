"""Shared pieces: the word pattern, row-wise Arrow passes, ranks within groups, and written intermediates."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from recallgrid.session import write_out  # noqa: F401

#: Words are maximal runs of anything but ASCII blanks.
WORD = re.compile(r"[^\x20\x09-\x0D]+")

#: Rows that one Arrow batch may hold, and rows handed on at once.
BATCH_BYTES = "4MB"


def arrow_pass(df: DataFrame, columns: list[str], schema: str, rows: Callable[..., Iterator[tuple]]) -> DataFrame:
    """Run ``rows(*lists)`` over each Arrow batch of ``columns``; it yields result tuples in the order of ``schema``.

    Batches are bounded in bytes, so long texts do not add up in a worker. No shuffle.
    """
    spark = df.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    types = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        for batch in batches:
            out = list(rows(*(c.to_pylist() for c in batch.columns)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), types)], schema=types)

    return df.select(*columns).mapInArrow(run, schema)


def rank_within(df: DataFrame, key: str, order: list[Column], spread: list[str], per_bucket: int = 512) -> DataFrame:
    """Add ``rank``: 0-based and gapless within each ``key``. Few keys, any number of rows in each.

    Rows of a key are dealt into hash buckets of about ``per_bucket`` rows, numbered inside their bucket, and shifted by the
    sizes of the buckets before it, so that no key is ordered in one task. The number of keys must be bounded (the counts are
    broadcast). ``df`` is read more than once; pass a written table.
    """
    counts = df.groupBy(F.col(key).alias("_k")).agg(F.ceil(F.count("*") / per_bucket).cast("int").alias("_n"))
    dealt = df.join(F.broadcast(counts), F.col(key).eqNullSafe(F.col("_k")), "left").drop("_k")
    dealt = dealt.withColumn("_b", F.pmod(F.xxhash64(*spread), F.col("_n"))).drop("_n")
    sizes = dealt.groupBy(key, "_b").count()
    before = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col(key).alias("_k"), F.col("_b").alias("_c"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_s"))
    inside = F.row_number().over(Window.partitionBy(key, "_b").orderBy(*order)) - 1
    numbered = dealt.withColumn("_r", inside)
    joined = numbered.join(starts, numbered[key].eqNullSafe(starts["_k"]) & (numbered["_b"] == starts["_c"]))
    return joined.withColumn("rank", (F.col("_r") + F.col("_s")).cast("long")).drop("_r", "_s", "_b", "_k", "_c")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def bounded(df: DataFrame, limit: int) -> DataFrame | None:
    """``df`` marked for broadcast if it has at most ``limit`` rows, else None. Pass a written table."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else None

