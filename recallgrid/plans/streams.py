"""Streams drained over the events table, their sinks read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from recallgrid.operators.hooks import hash_embedding
from recallgrid.operators.ingest import flight_document, with_id
from recallgrid.plans.keyed import BOOKING_SQL, requests_of
from recallgrid.plans.registry import FLIGHT_ID_SQL, FLIGHTS_SQL, flights, query, stream, table
from recallgrid.session import shared_path
from recallgrid.sources import tables
from recallgrid.streaming import jobs


@query("stream_ingest", f"""
WITH {FLIGHTS_SQL}, ids AS (SELECT *, {FLIGHT_ID_SQL} AS flight_id FROM flights)
SELECT DISTINCT flight_id, year, month, carrier, origin, dest, CAST(64 AS INT) AS dim FROM ids""")
def stream_ingest(spark, d):
    def prepare(rows):
        return flight_document(rows).withColumn("embedding", hash_embedding()(F.col("doc"))).drop("event_id")

    rows = with_id(flights(stream(spark, d, "events")))
    path, schema = shared_path(spark, "index"), prepare(rows).schema
    writer = jobs.ingest_stream(rows, path, schema, prepare, 64, ["event_id"])
    jobs.drain(writer, shared_path(spark, "progress"))
    return tables.read_index(spark, path, schema).select(
        "flight_id", "year", "month", "carrier", "origin", "dest", F.size("embedding").alias("dim"))


@query("stream_ingest_batches", f"""
WITH {FLIGHTS_SQL}, ids AS (SELECT *, {FLIGHT_ID_SQL} AS flight_id FROM flights)
SELECT year, month, count(DISTINCT flight_id) AS n, count(DISTINCT flight_id) AS n_ids FROM ids GROUP BY year, month""")
def stream_ingest_batches(spark, d):
    """Ingest in several micro-batches, then all of it again with its progress lost: every id is stored once.

    Each batch reads the ids of its own partitions only.
    """
    def prepare(rows):
        return rows.drop("event_id")

    parts, path = shared_path(spark, "parts"), shared_path(spark, "index")
    # Small row groups, so that a batch, one file, is read by many tasks.
    flights(table(spark, d, "events")).repartition(3, F.col("day") % 7).write.option("parquet.block.size", 4 << 20).parquet(parts)
    for _ in range(2):
        rows = with_id(spark.readStream.schema(spark.read.parquet(parts).schema).option("maxFilesPerTrigger", 1).parquet(parts))
        schema = prepare(rows).schema
        writer = jobs.ingest_stream(rows, path, schema, prepare, None, ["event_id"])
        jobs.drain(writer, shared_path(spark, "progress"))
    return tables.read_index(spark, path, schema).groupBy("year", "month").agg(
        F.count("*").alias("n"), F.count_distinct("flight_id").alias("n_ids"))


@query("stream_bookings", f"""
WITH {BOOKING_SQL}
SELECT coalesce(idempotency_key, 'none') AS idempotency_key, CASE WHEN idempotency_key IS NULL THEN count(*) ELSE 1 END AS n
FROM asked GROUP BY idempotency_key""")
def stream_bookings(spark, d):
    """Bookings per key after the stream: one, or all of them without a key."""
    rows = requests_of(stream(spark, d, "events")).select(
        "request_id", "flight_id", "passenger_name", "idempotency_key", "requested_at", "flight_snapshot_json")
    path = shared_path(spark, "log")
    jobs.drain(jobs.booking_stream(rows, path), shared_path(spark, "progress"))
    return tables.read_bookings(spark, path).groupBy(
        F.coalesce("idempotency_key", F.lit("none")).alias("idempotency_key")).agg(F.count("*").alias("n"))


@query("stream_sessions", """
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 3600 SECOND THEN 0 ELSE 1 END AS fresh
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
n AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS no FROM g),
s AS (SELECT user_id, min(ts) AS session_start, max(ts) AS session_end, count(*) AS n_events FROM n GROUP BY user_id, no)
SELECT * FROM s WHERE date_trunc('millisecond', session_end + INTERVAL 3600 SECOND)
  < (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 2 HOUR FROM events)""")
def stream_sessions(spark, d):
    """Sessions closed at the last watermark; append mode rightly holds back those still open."""
    e = stream(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    sink = shared_path(spark, "sessions")
    closed = jobs.idle_session_stream(e, "user_id", "ts", "2 hours")
    jobs.drain(closed.writeStream.format("parquet").option("path", sink).outputMode("append"), shared_path(spark, "progress"))
    return spark.read.schema(closed.schema).parquet(sink).withColumns({
        c: F.col(c).cast("timestamp_ntz") for c in ("session_start", "session_end")})


_HISTORY_SQL = """
WITH g AS (SELECT user_id, event_id, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 3600 SECOND THEN 0 ELSE 1 END AS fresh
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
n AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS no FROM g)
SELECT event_id, user_id, epoch_us(min(ts) OVER (PARTITION BY user_id, no)) AS started FROM n"""


def _history(spark, rows, **options):
    history = shared_path(spark, "history")
    writer = jobs.session_history_stream(rows, "user_id", "ts", history, shared_path(spark, "state"), **options)
    jobs.drain(writer, shared_path(spark, "progress"))
    return jobs.read_history(spark, history, "user_id").select("event_id", "user_id", "started")


@query("stream_history", _HISTORY_SQL)
def stream_history(spark, d):
    """Every message marked with the start of its session."""
    return _history(spark, stream(spark, d, "events").select("event_id", "user_id", "ts"))


@query("stream_history_late", _HISTORY_SQL)
def stream_history_late(spark, d):
    """The same marks where the messages come in several batches and in no order of time, all of them on time."""
    parts, e = shared_path(spark, "parts"), table(spark, d, "events").select("event_id", "user_id", "ts")
    e.repartition(3, F.col("event_id") % 7).write.parquet(parts)
    rows = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(parts)
    return _history(spark, rows, lateness_seconds=100 * 366 * 86_400)
