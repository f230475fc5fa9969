"""Routing a table of tool requests (tool name, raw argument text) to results and error codes."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from recallgrid.functions import jsons
from recallgrid.functions.ids import booking_key
from recallgrid.functions.text import iso_timestamp
from recallgrid.operators import bookings as booked, search
from recallgrid.operators.ranking import salted_join
from recallgrid.schema import HIT_FIELDS, MAX_TOOL_RESULTS, PAYLOAD, SNAPSHOT_FIELDS
from recallgrid.session import write_out

# ---- fixed values: tool name -> type of its result ----
RESULT_TYPES = {
    "search_flights": "search_results",
    "get_flight_details": "flight_details",
    "create_booking": "booking_confirmation",
    "cancel_booking": "cancel_result",
    "get_booking": "booking",
}


def limit_for(limit: Column, cap: int = MAX_TOOL_RESULTS) -> Column:
    return F.least(F.coalesce(limit, F.lit(10)), F.lit(cap))


def _optional_text(args: Column, name: str) -> Column:
    return ~jsons.has_field(args, name) | jsons.string_field(args, name).isNotNull()


def _optional_range(args: Column, name: str, low: int, high: int) -> Column:
    value = jsons.int_field(args, name)
    return ~jsons.has_field(args, name) | F.coalesce(value.between(low, high), F.lit(False))


def valid_search(args: Column) -> Column:
    """A query text, texts or nothing as filters, months 1-12, and a limit of 1-50 (null is no limit at all)."""
    given = F.try_variant_get(args, "$.limit", "variant")
    ok = jsons.string_field(args, "query").isNotNull()
    for name in ("origin", "dest", "carrier", "time_of_day"):
        ok = ok & _optional_text(args, name)
    for name in ("month_min", "month_max"):
        ok = ok & _optional_range(args, name, 1, 12)
    return ok & (given.isNull() | F.coalesce(jsons.int_field(args, "limit").between(1, 50), F.lit(False)))


def valid_texts(args: Column, *names: str) -> Column:
    out = F.lit(True)
    for name in names:
        out = out & jsons.string_field(args, name).isNotNull()
    return out


def parse_requests(requests: DataFrame, tool: str = "tool", raw: str = "args_text") -> DataFrame:
    """Adds ``args`` (variant) and ``problem``: an error code decided before any table is looked at, or null.

    Nothing usable in a non-empty text is malformed; an unknown tool is reported as such whatever its arguments;
    arguments that are not an object cannot be passed to a tool; the rest is checked field by field.
    """
    parsed = requests.withColumn("args", jsons.recover(F.col(raw)))
    args, name = F.col("args"), F.col(tool)
    checks = (
        F.when(name == "search_flights", valid_search(args))
        .when(name == "create_booking", valid_texts(args, "flight_id", "passenger_name"))
        .when(name.isin("cancel_booking", "get_booking"), valid_texts(args, "booking_id"))
        .otherwise(F.lit(True))
    )
    problem = (
        F.when((F.coalesce(F.col(raw), F.lit("")) != "") & jsons.is_empty(args), "MALFORMED_ARGS")
        .when(~F.coalesce(name.isin(*RESULT_TYPES), F.lit(False)), "UNKNOWN_TOOL")
        .when(~jsons.is_object(args), "TOOL_ERROR")
        .when(~checks, "INVALID_ARGS")
    )
    return parsed.withColumn("problem", problem)


def _looked_up(asked: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """``asked`` with what ``known`` (one row for each ``_of``) has for its key; no other row of ``known`` moves on."""
    met = known.join(asked.select(F.col(key).alias("_of")).distinct(), "_of", "left_semi")
    return salted_join(asked, met, key, "_of", 8)


def route(
    requests: DataFrame, flights: DataFrame, bookings: DataFrame, request_id: str = "request_id",
    tool: str = "tool", raw: str = "args_text", flight_key: str = "flight_id",
) -> DataFrame:
    """``(request_id, tool, type, error, target)`` for every request, lookups included.

    ``target`` is the search text, the flight id or the booking id a request is about; for a booking to be made it is the
    idempotency key. Only requests that name an id take part in its lookup, and a hot id is spread over tasks.
    """
    parsed = parse_requests(requests, tool, raw)
    args, name = F.col("args"), F.col(tool)
    flight = F.coalesce(F.try_variant_get(args, "$.flight_id", "string"), F.lit(""))
    wants_flight = name.isin("get_flight_details", "create_booking") & F.col("problem").isNull()
    wants_booking = name.isin("cancel_booking", "get_booking") & F.col("problem").isNull()
    empty = (name == "get_flight_details") & (
        ~jsons.has_field(args, "flight_id") | jsons.is_empty(F.try_variant_get(args, "$.flight_id", "variant")))
    # Written: the arguments are parsed once, however many look-ups follow.
    keyed = write_out(parsed.select(
        request_id, tool, "problem", F.when(wants_flight, flight).alias("_flight"),
        F.when(wants_booking, jsons.string_field(args, "booking_id")).alias("_booking"), empty.alias("_empty"),
        jsons.string_field(args, "query").alias("_query"), jsons.string_field(args, "passenger_name").alias("_name")), "calls")
    known_flights = flights.select(F.col(flight_key).cast("string").alias("_of"), F.lit(True).alias("_has_flight"))
    known_bookings = bookings.select(F.col("booking_id").alias("_of"), F.lit(True).alias("_has_booking"))
    found = (_looked_up(keyed.filter(F.col("_flight").isNotNull()), known_flights, "_flight")
             .unionByName(_looked_up(keyed.filter(F.col("_booking").isNotNull()), known_bookings, "_booking"), allowMissingColumns=True)
             .unionByName(keyed.filter(F.col("_flight").isNull() & F.col("_booking").isNull()), allowMissingColumns=True))
    error = (
        F.when(F.col("problem").isNotNull(), F.col("problem"))
        .when(F.col("_empty"), "MISSING_FLIGHT_ID")
        .when(F.col("_flight").isNotNull() & F.col("_has_flight").isNull(), "FLIGHT_NOT_FOUND")
        .when(F.col("_booking").isNotNull() & F.col("_has_booking").isNull(), "BOOKING_NOT_FOUND")
    )
    kind = F.lit("error")
    for known, result in RESULT_TYPES.items():
        kind = F.when(name == known, result).otherwise(kind)
    # Only a missing flight turns a booking into an error; look-up misses keep the type of their tool.
    kind = F.when(F.col("problem").isNotNull() | ((name == "create_booking") & error.isNotNull()), "error").otherwise(kind)
    target = (
        F.when(F.col("problem").isNotNull(), None)
        .when(name == "search_flights", F.col("_query"))
        .when(name == "create_booking", booking_key(F.col("_flight"), F.col("_name")))
        .otherwise(F.coalesce("_flight", "_booking"))
    )
    return found.select(request_id, tool, kind.alias("type"), error.alias("error"), target.alias("target"))


#: What a request for a booking of an unknown flight is told.
UNKNOWN_FLIGHT = "That flight_id does not exist. Please search again and pick a flight_id from the results."

_KEEP_NULLS = {"ignoreNullFields": "false"}
_ANSWER = ("request_id", "tool", "type", "error", "data")
#: What a search depends on.
_ASK = ("query", "origin", "dest", "carrier", "time_of_day", "month_min", "month_max", "limit")


def _failed(rows: DataFrame, kind: Column, *fields: Column) -> DataFrame:
    """Answers of requests whose ``error`` is set; ``data`` is an object of the error and the given fields that are not null."""
    told = rows.withColumn("type", kind).withColumn("data", F.to_json(F.struct("error", *fields)))
    return told.select(*_ANSWER)


def _told(rows: DataFrame, kind: str, data: Column) -> DataFrame:
    return rows.withColumn("type", F.lit(kind)).withColumn("error", F.lit(None).cast("string")).withColumn(
        "data", F.to_json(F.struct(data), _KEEP_NULLS)).select(*_ANSWER)


def answer_requests(
    requests: DataFrame, records: DataFrame, stored: DataFrame, *, embed: Callable[[Column], Column], request_id: str = "request_id",
    tool: str = "tool", raw: str = "args_text", at: str = "requested_at", flight_key: str = "flight_id", doc: str = "doc", **options: Any,
) -> tuple[DataFrame, DataFrame]:
    """Carry out a batch of tool requests: answers ``(request_id, tool, type, error, data)`` and the rows to append to the booking log.

    ``data`` is the answer as JSON text: hits and whether the filters were dropped, a flight, a booking, a cancellation, or an error.
    ``records`` are the index (flight key, payload, vector), ``stored`` the current bookings that the batch may touch. A batch is one
    step: cancellations and look-ups see the bookings from before it. ``options`` go to ``search.search_pipeline``.

    Requests are split by tool, so each join sees only the requests that need it; flights are looked up once for all tools, by their
    distinct ids. Searches that ask the same (text, filters, limit) are one search; a search without a request id finds nothing.
    """
    parsed = parse_requests(requests, tool, raw)
    args = F.col("args")
    texts = {c: jsons.string_field(args, c) for c in (
        "query", "origin", "dest", "carrier", "time_of_day", "passenger_name", "booking_id")}
    whole = {c: jsons.int_field(args, c) for c in ("month_min", "month_max")}
    given = write_out(parsed.select(
        F.col(request_id).alias("request_id"), F.col(tool).alias("tool"), F.col(at).alias("requested_at"), "problem",
        *[v.alias(c) for c, v in (texts | whole).items()], limit_for(jsons.int_field(args, "limit")).alias("limit"),
        F.coalesce(F.try_variant_get(args, "$.flight_id", "string"), F.lit("")).alias("flight_id"),
        (~jsons.has_field(args, "flight_id") | jsons.is_empty(F.try_variant_get(args, "$.flight_id", "variant"))).alias("no_flight")), "calls")
    good = given.filter(F.col("problem").isNull())
    of = lambda name: good.filter(F.col("tool") == name)

    unknown = F.col("problem") == "UNKNOWN_TOOL"
    parts = [_failed(
        given.filter(F.col("problem").isNotNull()).withColumn("error", F.col("problem")), F.lit("error"),
        F.when(~unknown, F.col("tool")).alias("tool"), F.when(unknown, F.col("tool")).alias("tool_name"))]

    searches = of("search_flights").select("request_id", "tool", F.struct(*_ASK).alias("_ask"))
    # Written: the numbers of the asks stay what they are.
    asked = write_out(searches.select("_ask").distinct().select(F.monotonically_increasing_id().alias("query_id"), "_ask.*"), "asks")
    hits = search.search_pipeline(records, asked, embed=embed, id_col=flight_key, doc=doc, **options)
    item = F.struct("rank", F.struct(F.col(flight_key).alias("flight_id"), "score", *HIT_FIELDS).alias("hit"))
    found = hits.groupBy("query_id").agg(F.sort_array(F.collect_list(item)).alias("hits"), F.max("filters_dropped").alias("dropped"))
    # Without hits, the filters were dropped too.
    has = search.has_filter([t for t in search.FLIGHT_TERMS if t.field in asked.columns])
    hit = f"array<struct<flight_id:string,score:double,{','.join(f'{c}:{records.schema[c].dataType.simpleString()}' for c in HIT_FIELDS)}>>"
    told = lambda results, dropped: F.to_json(F.struct(results.alias("results"), dropped.alias("filters_dropped")), _KEEP_NULLS)
    none = F.array().cast(hit)
    data = told(F.coalesce(F.col("hits.hit").cast(hit), none), F.coalesce("dropped", has))
    by_ask = asked.join(found, "query_id", "left").select(F.struct(*_ASK).alias("_of"), data.alias("data"), told(none, has).alias("_nothing"))
    answered = salted_join(searches, by_ask, "_ask", "_of", 8, "inner")
    parts.append(answered.select(
        "request_id", "tool", F.lit("search_results").alias("type"), F.lit(None).cast("string").alias("error"),
        F.when(F.col("request_id").isNull(), F.col("_nothing")).otherwise(F.col("data")).alias("data")))

    details, creates = of("get_flight_details"), of("create_booking")
    wanted = details.filter(~F.col("no_flight")).select("flight_id").unionByName(creates.select("flight_id")).distinct()
    payload = [c for c in PAYLOAD if c in records.columns]
    named = records.withColumn("flight_id", F.col(flight_key).cast("string"))
    flights = write_out(named.join(wanted, "flight_id", "left_semi").select(
        F.col("flight_id").alias("_of"), F.struct("flight_id", *payload).alias("flight"),
        booked.snapshot_json(named, list(SNAPSHOT_FIELDS)).alias("flight_snapshot_json")), "flights")
    missing = details.filter("no_flight").withColumn("error", F.lit("MISSING_FLIGHT_ID"))
    parts.append(_failed(missing, F.lit("flight_details")))
    seen = salted_join(details.filter(~F.col("no_flight")), flights.select("_of", "flight"), "flight_id", "_of", 8)
    not_found = F.lit("FLIGHT_NOT_FOUND")
    parts.append(_told(seen.filter(F.col("flight").isNotNull()), "flight_details", F.col("flight")))
    parts.append(_failed(seen.filter(F.col("flight").isNull()).withColumn("error", not_found), F.lit("flight_details"), F.col("flight_id")))

    checked = salted_join(creates, flights.select("_of", "flight_snapshot_json"), "flight_id", "_of", 8).withColumn(
        "idempotency_key", booking_key(F.col("flight_id"), F.col("passenger_name")))
    made, appended = booked.create(checked.filter(F.col("flight_snapshot_json").isNotNull()), stored)
    shown = ("booking_id", "flight_id", "passenger_name", "status", "created_at", "updated_at", "flight_snapshot")
    parts.append(_told(
        booked.answer(made).withColumn("tool", F.lit("create_booking")), "booking_confirmation", F.struct(*shown).alias("booking")))
    parts.append(_failed(
        checked.filter(F.col("flight_snapshot_json").isNull()).withColumn("error", not_found), F.lit("error"), F.col("flight_id"),
        F.lit(UNKNOWN_FLIGHT).alias("message")))

    gone, cancelled = booked.cancel(of("cancel_booking").select("request_id", "booking_id", "requested_at"), stored)
    gone = gone.withColumn("tool", F.lit("cancel_booking")).withColumn("updated_at", iso_timestamp(F.col("updated_at")))
    parts.append(_told(gone.filter(F.col("error").isNull()), "cancel_result", F.struct("booking_id", "status", "updated_at").alias("result")))
    parts.append(_failed(gone.filter(F.col("error").isNotNull()), F.lit("cancel_result"), F.col("booking_id")))

    asks = of("get_booking").select("request_id", "tool", "booking_id")
    kept = salted_join(asks, booked.answer(stored).select(F.col("booking_id").alias("_of"), F.struct(*shown).alias("booking")), "booking_id", "_of", 8)
    parts.append(_told(kept.filter(F.col("booking").isNotNull()), "booking", F.col("booking")))
    parts.append(_failed(
        kept.filter(F.col("booking").isNull()).withColumn("error", F.lit("BOOKING_NOT_FOUND")), F.lit("booking"), F.col("booking_id")))

    answers = parts[0]
    for part in parts[1:]:
        answers = answers.unionByName(part)
    return answers, appended.unionByName(cancelled)
