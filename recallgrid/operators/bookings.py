"""Keyed, idempotent bookings as an append-only change log.

Every write appends full row versions; ``current`` gives the latest state. A batch must be the only writer of
its log while it runs (one ``foreachBatch`` sink, or one job at a time), as with any table without transactions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from recallgrid.functions.ids import uuid5
from recallgrid.functions.text import iso_timestamp
from recallgrid.operators.ranking import last_per_key, salted_join
from recallgrid.schema import NAMESPACE_URL, SNAPSHOT
from recallgrid.session import write_out

COLUMNS = ("booking_id", "flight_id", "passenger_name", "status", "idempotency_key", "flight_snapshot_json",
           "created_at", "updated_at")


def current(log: DataFrame) -> DataFrame:
    """Latest version of each booking. Cancelled wins over confirmed within one instant."""
    versions = log.withColumn("_done", F.col("status") == "CANCELLED")
    return last_per_key(versions, ["booking_id"], "updated_at", "_done").drop("_done")


def snapshot_json(record: DataFrame, fields: list[str]) -> Column:
    """JSON text of the fields the record has (nulls kept, as present keys)."""
    present = [c for c in fields if c in record.columns]
    return F.to_json(F.struct(*present), {"ignoreNullFields": "false"})


def new_booking_id(request_id: Column) -> Column:
    """Id of a booking made by a request: repeatable, so a retried task cannot book twice."""
    return uuid5(NAMESPACE_URL, F.concat(F.lit("booking|"), request_id.cast("string")))


def create(requests: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Idempotent batch create.

    ``requests``: request_id, flight_id, passenger_name, flight_snapshot_json, idempotency_key (null: always a new
    booking), requested_at. ``stored``: current bookings. A key that was ever used, also by a booking cancelled since,
    answers with that booking; otherwise the earliest request of the key makes it.

    ``stored`` need only hold the bookings of the batch's keys.

    Returns the answers, one per request with the caller's own snapshot, and the rows to append to the log.
    """
    # Written: keys and texts of the requests are worked out once, not for each filter and join below.
    requests = write_out(requests, "requests")
    keyed = requests.filter(F.col("idempotency_key").isNotNull())
    unkeyed = requests.filter(F.col("idempotency_key").isNull())

    # One row per key before any join: a hot key is combined map-side.
    earliest = keyed.groupBy("idempotency_key").agg(
        F.min(F.struct("requested_at", "request_id", "flight_id", "passenger_name", "flight_snapshot_json")).alias("w")
    ).select("idempotency_key", "w.*")
    known = stored.filter(F.col("idempotency_key").isNotNull()).select(
        "idempotency_key", F.col("booking_id").alias("_id"), F.col("status").alias("_status"),
        F.col("flight_id").alias("_flight"), F.col("passenger_name").alias("_name"),
        F.col("created_at").alias("_made"), F.col("updated_at").alias("_changed"),
    )
    winners = earliest.join(known, "idempotency_key", "left")
    fresh = winners.filter(F.col("_id").isNull())
    rows = fresh.select("request_id", "requested_at", "flight_id", "passenger_name", "flight_snapshot_json",
                        "idempotency_key").unionByName(unkeyed.select(
                            "request_id", "requested_at", "flight_id", "passenger_name", "flight_snapshot_json",
                            "idempotency_key"))
    appended = rows.select(
        new_booking_id(F.col("request_id")).alias("booking_id"),
        "flight_id", "passenger_name", F.lit("CONFIRMED").alias("status"), "idempotency_key",
        F.coalesce("flight_snapshot_json", F.lit("{}")).alias("flight_snapshot_json"),
        F.col("requested_at").alias("created_at"), F.col("requested_at").alias("updated_at"),
    )

    resolved = winners.select(
        "idempotency_key",
        F.coalesce("_id", new_booking_id(F.col("request_id"))).alias("booking_id"),
        F.coalesce("_status", F.lit("CONFIRMED")).alias("status"),
        F.coalesce("_flight", F.col("flight_id")).alias("flight_id"),
        F.coalesce("_name", F.col("passenger_name")).alias("passenger_name"),
        F.coalesce("_made", F.col("requested_at")).alias("created_at"),
        F.coalesce("_changed", F.col("requested_at")).alias("updated_at"),
    )
    mine = keyed.select("request_id", "idempotency_key", "flight_snapshot_json")
    answers = mine.join(resolved, "idempotency_key").select(
        "request_id", "booking_id", "status", "flight_id", "passenger_name", "flight_snapshot_json", "created_at", "updated_at",
        (F.col("booking_id") == new_booking_id(F.col("request_id"))).alias("created"),
    ).unionByName(unkeyed.select(
        "request_id", new_booking_id(F.col("request_id")).alias("booking_id"), F.lit("CONFIRMED").alias("status"),
        "flight_id", "passenger_name", "flight_snapshot_json", F.col("requested_at").alias("created_at"),
        F.col("requested_at").alias("updated_at"), F.lit(True).alias("created"),
    ))
    return answers, appended


def create_checked(requests: DataFrame, catalogue: DataFrame, stored: DataFrame, key: str = "flight_id"):
    """Create only for ids in the catalogue; returns answers (errors included) and rows to append. A hot id is spread over tasks."""
    asked = catalogue.select(key).join(requests.select(key).distinct(), key, "left_semi").distinct()
    marked = salted_join(requests, asked.select(F.col(key).alias("_asked"), F.lit(True).alias("_known")), key, "_asked")
    answers, appended = create(marked.filter("_known").drop("_known"), stored)
    errors = marked.filter(F.col("_known").isNull()).select("request_id", F.lit("FLIGHT_NOT_FOUND").alias("error"))
    return answers.unionByName(errors, allowMissingColumns=True), appended


def cancel(requests: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Batch cancel by id, in any state; unknown ids answer with ``BOOKING_NOT_FOUND``. ``stored`` need only hold the asked bookings.

    ``requests``: request_id, booking_id, requested_at. The appended version of a booking carries its last request
    time; every request for it is answered.
    """
    asked = requests.groupBy("booking_id").agg(F.max("requested_at").alias("_at"))
    changed = stored.join(asked, "booking_id").withColumn("status", F.lit("CANCELLED")).withColumn(
        "updated_at", F.greatest("updated_at", "_at")).select(*COLUMNS)
    answers = requests.join(changed.select("booking_id", "status", "updated_at"), "booking_id", "left")
    answers = answers.select(
        "request_id", "booking_id", "status", "updated_at",
        F.when(F.col("status").isNull(), "BOOKING_NOT_FOUND").alias("error"),
    )
    return answers, changed


def answer(rows: DataFrame) -> DataFrame:
    """Bookings as the service words them: times in ISO format, and the snapshot as a struct ``flight_snapshot``.

    A snapshot that is no JSON object has null fields.
    """
    return rows.withColumns({c: iso_timestamp(F.col(c)) for c in ("created_at", "updated_at")}).withColumn(
        "flight_snapshot", F.from_json("flight_snapshot_json", SNAPSHOT)).drop("flight_snapshot_json")


def get(requests: DataFrame, stored: DataFrame) -> DataFrame:
    """Batch lookup: the booking with its snapshot as a struct, or ``BOOKING_NOT_FOUND``."""
    rows = stored.withColumn("flight_snapshot", F.from_json("flight_snapshot_json", SNAPSHOT))
    return requests.join(rows.drop("flight_snapshot_json"), "booking_id", "left").withColumn(
        "error", F.when(F.col("status").isNull(), "BOOKING_NOT_FOUND"))


def duplicate_keys(stored: DataFrame) -> DataFrame:
    """Keys held by more than one booking (there should be none); null keys are exempt."""
    return stored.filter(F.col("idempotency_key").isNotNull()).groupBy("idempotency_key").agg(
        F.count("*").alias("n")).filter(F.col("n") > 1)
