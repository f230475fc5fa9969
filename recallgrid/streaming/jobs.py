"""Structured Streaming forms: incremental ingest, booking requests, idle sessions, session state."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from recallgrid.operators import bookings
from recallgrid.operators.dialogs import micros
from recallgrid.operators.ingest import unseen
from recallgrid.schema import SESSION_TTL_SECONDS
from recallgrid.session import passing_tables, remove, write_out
from recallgrid.sources import tables


def drain(writer, checkpoint: str) -> None:
    """Run a stream over all input there is, then stop."""
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()


def ingest_stream(
    rows: DataFrame, index: str, schema: T.StructType, prepare: Callable[[DataFrame], DataFrame], dim: int | None,
    position: Sequence[str], key: str = "flight_id", partitions: Sequence[str] = ("year", "month"),
):
    """Append unseen records to the index, batch by batch.

    ``rows`` carry their id; ``prepare`` (render, embed) sees new rows only. A batch reads the ids of those index partitions only
    that it has rows for, so its cost does not grow with the index. A batch that runs again after a failure finds its rows
    stored and adds nothing twice.
    """
    tables.create_index(rows.sparkSession, index, schema, partitions)

    def add(batch: DataFrame, _: int) -> None:
        with passing_tables(batch.sparkSession):
            # Written: a batch is computed whole, ids too, each time it is read.
            batch = write_out(batch, "batch")
            known = tables.stored_ids(batch.sparkSession, index, schema, key, batch, partitions)
            fresh = prepare(unseen(batch, known, key, position, partitions)).select(*schema.names)
            tables.append_index(fresh, index, dim, partitions=partitions)

    return rows.writeStream.foreachBatch(add)


def booking_stream(requests: DataFrame, log: str, watermark: str | None = None, compact_every: int | None = None):
    """Exactly one booking per key from a stream of create requests (one writer per log).

    A batch reads the bookings of its own keys only. With ``compact_every``, the log is compacted after every so many batches.
    With ``watermark``, repeats within that delay are dropped before the batch (requests without a key never are);
    older repeats find the stored booking.
    """
    tables.create_log(requests.sparkSession, log)
    if watermark:
        dedup = requests.withColumn("_key", F.coalesce(
            F.concat(F.lit("k|"), F.col("idempotency_key")), F.concat(F.lit("r|"), F.col("request_id").cast("string"))))
        timed = dedup.withColumn("_event", F.col("requested_at").cast("timestamp")).withWatermark("_event", watermark)
        requests = timed.dropDuplicatesWithinWatermark(["_key"]).drop("_key", "_event")

    def book(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        with passing_tables(spark):
            _, appended = bookings.create(batch, tables.read_bookings(spark, log, batch, "idempotency_key"))
            tables.append_log(appended, log)
            if compact_every and (number + 1) % compact_every == 0:
                tables.compact_log(spark, log)

    return requests.writeStream.foreachBatch(book)


def idle_session_stream(events: DataFrame, user: str, ts: str, delay: str, ttl_seconds: int = SESSION_TTL_SECONDS) -> DataFrame:
    """Closed sessions of an event stream; ``ts`` must be a TIMESTAMP.

    Sessions of one task's rows are merged before the shuffle, so a hot user sends few rows on.
    """
    events.sparkSession.conf.set("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")
    window = F.session_window(ts, f"{ttl_seconds} seconds")
    return events.withWatermark(ts, delay).groupBy(user, window.alias("w")).agg(F.count("*").alias("n_events")).select(
        user, F.col("w.start").alias("session_start"),
        (F.col("w.end") - F.make_interval(secs=F.lit(ttl_seconds))).alias("session_end"), "n_events")


def session_history_stream(
    messages: DataFrame, session: str, ts: str, history: str, state: str, ttl_seconds: int = SESSION_TTL_SECONDS,
    lateness_seconds: int = SESSION_TTL_SECONDS,
):
    """Append messages to the history table, each to be marked with ``started``, the first instant of its session's life.

    A life ends when more than ``ttl_seconds`` pass without a message. Messages may come in any order: one that is at most
    ``lateness_seconds`` older than the newest message of the batches before is on time, and may begin a life earlier, or join two lives. What
    is older is stored with ``late`` set and marks nothing, as is a message without session or time. Whatever the order of
    messages on time, their marks in the end are those of one batch over all of them.

    Messages are stored once, with their time slot; all those of a session and slot (as wide as ``ttl_seconds``) are of one life, so marks are
    kept by session and slot, beside the messages, and a batch writes those only that are new or changed. ``read_history`` puts both
    together. The state, one folder a batch, holds the slots of the batch and those that a message on time can still reach; the
    folder before the last is removed. A session with most of the messages is thus a few rows wherever it is ordered. A batch
    that runs again overwrites its own output.
    """
    width, delay = ttl_seconds * 1_000_000, lateness_seconds * 1_000_000
    longs = ("_slot", "_from", "_to", "started", "_told")
    saved = T.StructType([messages.schema[session], *[T.StructField(c, T.LongType()) for c in longs]])

    def label(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = spark.read.schema(saved).parquet(f"{state}/{number - 1}") if number else spark.createDataFrame([], saved)
        newest = before.agg(F.max("_to")).first()[0]
        mark = F.lit(None if newest is None else newest - delay).cast("long")
        at = micros(F.col(ts))
        late = F.coalesce(at < mark, F.lit(False))
        stored = f"{history}/messages/batch={number}"
        batch.withColumns({
            "_slot": F.when(F.col(session).isNotNull() & ~late, F.floor(at / width)), "late": late,
        }).write.mode("overwrite").parquet(stored)
        came = spark.read.parquet(stored).filter(F.col("_slot").isNotNull()).groupBy(session, "_slot").agg(
            F.min(at).alias("_from"), F.max(at).alias("_to"))
        # No message on time is older than ``mark``: what began before it keeps its mark, and its life is open if it ended a ttl before or later.
        open_slots = before.filter(F.col("_to") >= mark - width).select(
            session, "_slot", "_from", "_to", F.col("started").alias("_told"), F.when(F.col("_from") < mark, F.col("started")).alias("_fixed"))
        slots = came.unionByName(open_slots, allowMissingColumns=True).groupBy(session, "_slot").agg(
            F.min("_from").alias("_from"), F.max("_to").alias("_to"), F.max("_told").alias("_told"), F.max("_fixed").alias("_fixed"))
        w = Window.partitionBy(session).orderBy("_slot")
        last = F.lag("_to").over(w)
        begins = F.coalesce("_fixed", F.when(last.isNull() | (F.col("_from") - last > width), F.col("_from")))
        lives = slots.withColumn("_b", begins).withColumn(
            "started", F.last("_b", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        lives.select(*saved.names).write.mode("overwrite").parquet(f"{state}/{number}")
        told = spark.read.schema(saved).parquet(f"{state}/{number}").filter(~F.col("started").eqNullSafe(F.col("_told")))
        told.select(session, "_slot", "started").write.mode("overwrite").parquet(f"{history}/marks/batch={number}")
        remove(spark, f"{state}/{number - 2}")

    return messages.writeStream.foreachBatch(label)


def read_history(spark: SparkSession, history: str, session: str) -> DataFrame:
    """All messages of a history table with ``started`` (null where there is no mark) and ``late``.

    Messages without a slot take no part in the join with the marks, whose key is session and slot.
    """
    told = spark.read.parquet(f"{history}/messages").drop("batch")
    marks = spark.read.parquet(f"{history}/marks").groupBy(session, "_slot").agg(F.max_by("started", "batch").alias("started"))
    marked = told.filter(F.col("_slot").isNotNull()).join(marks, [session, "_slot"], "left")
    return marked.unionByName(told.filter(F.col("_slot").isNull()), allowMissingColumns=True).drop("_slot")
