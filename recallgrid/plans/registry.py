"""Query registry and shared inputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from recallgrid.schema import CARRIERS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

ORIGINS = ("EWR", "JFK", "LGA")
DESTS = ("ATL", "ord", "LAX", "MIA", "ZZZ", "bos")


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The same table as a stream. Written as a pattern, the path may be one file or a folder of many."""
    return spark.readStream.schema(table(spark, folder, name).schema).parquet(f"{folder}/{name}.parque[t]")


def raw_flights(e: DataFrame) -> DataFrame:
    """The events table in the shape of the flights CSV: all text, with the defects such files have."""
    pick = lambda values, i: "element_at(array(" + ", ".join(f"'{v}'" for v in values) + f"), CAST({i} + 1 AS INT))"
    carrier = pick(CARRIERS, "user_id % 16")
    parts = e.selectExpr(
        "event_id", "user_id", "event_type", "value", "ts", "CAST(substring_index(substring(props, 7), '}', 1) AS INT) AS k",
        "hour(ts) AS hh", "minute(ts) AS mi")
    return parts.selectExpr(
        "event_id", "CAST(year(ts) AS STRING) AS year", "CAST(month(ts) AS STRING) AS month", "CAST(day(ts) AS STRING) AS day",
        f"CASE WHEN event_type = 'click' THEN lower({carrier}) ELSE {carrier} END AS carrier",
        "CASE WHEN event_type = 'view' THEN concat(user_id, '.0') ELSE CAST(user_id AS STRING) END AS flight",
        f"{pick(ORIGINS, 'user_id % 3')} AS origin",
        f"CASE WHEN user_id % 11 = 0 THEN 'NA' ELSE {pick(DESTS, 'user_id % 6')} END AS dest",
        "CAST(hh * 100 + (mi div 30) * 30 AS STRING) AS sched_dep_time",
        "CAST((hh + 2) % 24 * 100 + mi AS STRING) AS sched_arr_time",
        "CASE WHEN event_type = 'error' AND value > 20 THEN 'NA' ELSE CAST(hh * 100 + mi AS STRING) END AS dep_time",
        "CAST((hh + 2) % 24 * 100 + mi AS STRING) AS arr_time",
        "CASE WHEN event_type = 'signup' AND value > 30 THEN concat(k, '.5') WHEN k = 7 THEN 'abc' WHEN k = 8 THEN '1e3' "
        "WHEN k = 9 THEN '3000000000' WHEN k = 11 THEN concat(k * 10 + 100, '.') ELSE CAST(k * 10 + 100 AS STRING) END AS distance",
        "CAST(k AS STRING) AS air_time",
        "CASE WHEN k = 13 THEN '' ELSE concat('N', user_id) END AS tailnum")


def _sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


RAW_FLIGHTS_SQL = f"""
raw0 AS (
  SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k, hour(ts) AS hh, minute(ts) AS mi FROM events),
raw AS (
  SELECT event_id, CAST(year(ts) AS VARCHAR) AS year, CAST(month(ts) AS VARCHAR) AS month, CAST(day(ts) AS VARCHAR) AS day,
    CASE WHEN event_type = 'click' THEN lower({_sql_list(CARRIERS)}[user_id % 16 + 1])
         ELSE {_sql_list(CARRIERS)}[user_id % 16 + 1] END AS carrier,
    CASE WHEN event_type = 'view' THEN user_id || '.0' ELSE user_id || '' END AS flight,
    {_sql_list(ORIGINS)}[user_id % 3 + 1] AS origin,
    CASE WHEN user_id % 11 = 0 THEN 'NA' ELSE {_sql_list(DESTS)}[user_id % 6 + 1] END AS dest,
    CAST(hh * 100 + (mi // 30) * 30 AS VARCHAR) AS sched_dep_time,
    CAST((hh + 2) % 24 * 100 + mi AS VARCHAR) AS sched_arr_time,
    CASE WHEN event_type = 'error' AND value > 20 THEN 'NA' ELSE CAST(hh * 100 + mi AS VARCHAR) END AS dep_time,
    CAST((hh + 2) % 24 * 100 + mi AS VARCHAR) AS arr_time,
    CASE WHEN event_type = 'signup' AND value > 30 THEN k || '.5' WHEN k = 7 THEN 'abc' WHEN k = 8 THEN '1e3'
         WHEN k = 9 THEN '3000000000' WHEN k = 11 THEN (k * 10 + 100) || '.' ELSE CAST(k * 10 + 100 AS VARCHAR) END AS distance,
    CAST(k AS VARCHAR) AS air_time,
    CASE WHEN k = 13 THEN '' ELSE 'N' || user_id END AS tailnum
  FROM raw0)"""

# A whole number in some spelling, and one that fits 32 bits.
WHOLE_DISTANCE_SQL = "regexp_full_match(distance, '[0-9]+(\\.|e[0-9])?')"
GOOD_DISTANCE_SQL = f"{WHOLE_DISTANCE_SQL} AND TRY_CAST(distance AS DOUBLE) < 2147483648"

# Valid rows: null tokens applied, whole numbers as integers, codes in upper case, nothing optional missing.
FLIGHTS_SQL = RAW_FLIGHTS_SQL + f""",
nulled AS (
  SELECT * REPLACE (nullif(dest, 'NA') AS dest, nullif(dep_time, 'NA') AS dep_time, nullif(tailnum, '') AS tailnum) FROM raw),
flights AS (
  SELECT event_id, CAST(year AS INT) AS year, CAST(month AS INT) AS month, CAST(day AS INT) AS day,
    upper(carrier) AS carrier, CAST(CAST(flight AS DOUBLE) AS INT) AS flight, upper(origin) AS origin,
    upper(coalesce(dest, 'NAN')) AS dest, CAST(sched_dep_time AS INT) AS sched_dep_time,
    CAST(sched_arr_time AS INT) AS sched_arr_time, CAST(dep_time AS INT) AS dep_time, CAST(arr_time AS INT) AS arr_time,
    CAST(CAST(distance AS DOUBLE) AS INT) AS distance, CAST(air_time AS INT) AS air_time, tailnum
  FROM nulled WHERE dep_time IS NOT NULL AND tailnum IS NOT NULL AND {GOOD_DISTANCE_SQL})"""

UUID5_MACRO = """concat(substr({h}, 1, 8), '-', substr({h}, 9, 4), '-5', substr({h}, 14, 3), '-',
  translate(substr({h}, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab'), substr({h}, 18, 3), '-', substr({h}, 21, 12))"""


def uuid5_sql(namespace: str, key: str) -> str:
    return UUID5_MACRO.format(h=f"sha1(unhex('{namespace}') || encode({key}))")


FLIGHT_ID_SQL = uuid5_sql(
    "6ba7b8119dad11d180b400c04fd430c8",
    "concat_ws('|', year, month, day, carrier, flight, origin, dest, sched_dep_time)")


def flights(e: DataFrame) -> DataFrame:
    """Accepted flights with their input position ``event_id``."""
    from recallgrid.operators.validate import accepted
    from recallgrid.sources.records import null_tokens

    return accepted(null_tokens(raw_flights(e)), keep=["event_id"])
