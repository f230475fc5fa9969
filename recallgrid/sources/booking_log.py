"""The booking log as files: full row versions in hash buckets, a bucketed index of idempotency keys, and compacted generations.

A generation holds a snapshot and all versions appended since, dealt into buckets by booking id, and the pairs (idempotency key,
booking id), dealt by key. A batch reads only the buckets that its ids or keys fall into, and orders the versions of its own bookings
only. Compaction writes the current state as the next generation with as many buckets as its size asks for, so that a bucket stays of one
size however long the log grows. One writer at a time, as for any table without transactions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from recallgrid.operators.bookings import current
from recallgrid.operators.ingest import touched
from recallgrid.schema import BOOKING
from recallgrid.session import write_out

#: Bookings of a bucket after compaction.
BUCKET_ROWS = 200_000
#: Buckets of a new log.
FIRST_BUCKETS = 16

_GENERATION = "generation int, buckets int"
_BUCKET = T.StructField("bucket", T.IntegerType())
_STORED = T.StructType([*BOOKING.fields, _BUCKET])
_KEYS = T.StructType([T.StructField("idempotency_key", T.StringType()), T.StructField("booking_id", T.StringType()), _BUCKET])


def _bucket(column: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(buckets)).cast("int")


def _folder(path: str, generation: int, name: str) -> str:
    return f"{path.rstrip('/')}/generation-{generation}/{name}"


def _latest(spark: SparkSession, path: str) -> tuple[int, int]:
    """The newest complete generation (one row each, so a small table) and its number of buckets."""
    return tuple(spark.read.schema(_GENERATION).parquet(f"{path.rstrip('/')}/generations").agg(
        F.max(F.struct("generation", "buckets"))).first()[0])


def _open(spark: SparkSession, path: str, generation: int, buckets: int) -> None:
    """Empty tables of a generation, then its entry, so that it is only seen complete."""
    for name, schema in (("bookings", _STORED), ("keys", _KEYS)):
        spark.createDataFrame([], schema).write.mode("ignore").partitionBy("bucket").parquet(_folder(path, generation, name))
    _enter(spark, path, generation, buckets)


def _enter(spark: SparkSession, path: str, generation: int, buckets: int) -> None:
    spark.createDataFrame([(generation, buckets)], _GENERATION).coalesce(1).write.mode("append").parquet(f"{path.rstrip('/')}/generations")


def create_log(spark: SparkSession, path: str, buckets: int = FIRST_BUCKETS) -> None:
    """An empty log, unless there is one already."""
    spark.createDataFrame([], _GENERATION).write.mode("ignore").parquet(f"{path.rstrip('/')}/generations")
    if spark.read.schema(_GENERATION).parquet(f"{path.rstrip('/')}/generations").isEmpty():
        _open(spark, path, 0, buckets)


def _write(rows: DataFrame, folder: str, by: str, buckets: int) -> None:
    rows.withColumn("bucket", _bucket(by, buckets)).hint("rebalance", "bucket").sortWithinPartitions("bucket", by).write.mode(
        "append").partitionBy("bucket").parquet(folder)


def _append(rows: DataFrame, path: str, generation: int, buckets: int) -> None:
    rows = rows.select(*BOOKING.names)
    _write(rows, _folder(path, generation, "bookings"), "booking_id", buckets)
    # After the rows: a key never names a booking that is not there.
    keys = rows.filter(F.col("idempotency_key").isNotNull()).select("idempotency_key", "booking_id").distinct()
    _write(keys, _folder(path, generation, "keys"), "idempotency_key", buckets)


def append_log(rows: DataFrame, path: str) -> None:
    """Append full row versions. ``rows`` is read twice and may depend on the log, so it is written out first."""
    _append(write_out(rows.select(*BOOKING.names), "appended"), path, *_latest(rows.sparkSession, path))


def _versions(spark: SparkSession, path: str, generation: int) -> DataFrame:
    return spark.read.schema(_STORED).parquet(_folder(path, generation, "bookings"))


def read_bookings(spark: SparkSession, path: str, batch: DataFrame | None = None, key: str = "booking_id") -> DataFrame:
    """Current state of every booking in the log, or of those only that ``batch`` names by ``key``.

    ``key`` is ``booking_id`` or ``idempotency_key``. With a batch, both the key index and the bookings are read by bucket, and versions are
    cut to the batch's bookings before any are ordered. Null keys name nothing.
    """
    generation, buckets = _latest(spark, path)
    versions = _versions(spark, path, generation)
    if batch is None:
        return current(versions.drop("bucket"))
    asked = write_out(batch.filter(F.col(key).isNotNull()).select(key).distinct().withColumn("bucket", _bucket(key, buckets)), "asked")
    if key == "idempotency_key":
        index = spark.read.schema(_KEYS).parquet(_folder(path, generation, "keys"))
        known = index.filter(touched(asked, ["bucket"])).drop("bucket").join(asked, key, "left_semi")
        asked = write_out(known.select("booking_id").distinct().withColumn("bucket", _bucket("booking_id", buckets)), "asked")
    mine = versions.filter(touched(asked, ["bucket"])).drop("bucket").join(asked, "booking_id", "left_semi")
    return current(mine)


def compact_log(spark: SparkSession, path: str, bucket_rows: int = BUCKET_ROWS) -> int:
    """Write the current state as a new generation, with a bucket for every ``bucket_rows`` bookings; its number.

    Readers of the older generation keep their files. A compaction that fails leaves no entry and is written again into a later one.
    """
    generation, _ = _latest(spark, path)
    now = write_out(read_bookings(spark, path), "compacted")
    buckets = max(1, -(-now.count() // bucket_rows))
    for name, schema in (("bookings", _STORED), ("keys", _KEYS)):
        spark.createDataFrame([], schema).write.mode("overwrite").partitionBy("bucket").parquet(_folder(path, generation + 1, name))
    _append(now, path, generation + 1, buckets)
    _enter(spark, path, generation + 1, buckets)
    return generation + 1
