"""Sources, validation, ids, incremental ingest, document text."""

from __future__ import annotations

import csv
import hashlib
import io
import zipfile
from datetime import datetime

import pandas as pd
from pyspark.sql import functions as F

from recallgrid.functions.ids import record_id
from recallgrid.operators import ingest, ranking, validate
from recallgrid.operators.hooks import hash_embedding
from recallgrid.plans.registry import (
    FLIGHT_ID_SQL, FLIGHTS_SQL, GOOD_DISTANCE_SQL, WHOLE_DISTANCE_SQL, flights, query, raw_flights, table, uuid5_sql,
)
from recallgrid.schema import NAMESPACE_URL, PAYLOAD
from recallgrid.session import shared_path
from recallgrid.sources import records, tables

_SPLIT = datetime(2024, 1, 16)
_NUMBERS = ("flight", "sched_dep_time", "distance", "air_time")


def _events(spark, d):
    return table(spark, d, "events")


def _flight_rows(spark, d):
    """Valid flights with ids, and the ids of the first half of the month as what is stored already."""
    e = _events(spark, d)
    early = e.filter(F.col("ts") < F.lit(_SPLIT).cast("timestamp_ntz"))
    return ingest.with_id(flights(e)), ingest.with_id(flights(early)).select("year", "month", "flight_id").distinct()


@query("validate_accept", f"WITH {FLIGHTS_SQL} SELECT * FROM flights")
def validate_accept(spark, d):
    return flights(_events(spark, d))


@query("validate_reject", f"""
WITH {FLIGHTS_SQL},
why AS (SELECT event_id, concat_ws('; ',
    CASE WHEN dep_time IS NULL THEN 'dep_time: null' END,
    CASE WHEN NOT {WHOLE_DISTANCE_SQL} THEN 'distance: not an integer' WHEN NOT ({GOOD_DISTANCE_SQL}) THEN 'distance: out of range' END,
    CASE WHEN tailnum IS NULL THEN 'tailnum: null' END) AS problems FROM nulled)
SELECT * FROM why WHERE problems <> ''""")
def validate_reject(spark, d):
    bad = validate.rejected(records.null_tokens(raw_flights(_events(spark, d))))
    return bad.select("event_id", F.array_join("problems", "; ").alias("problems"))


@query("validate_keep_nulls", f"""
WITH {FLIGHTS_SQL}
SELECT event_id, CAST(dep_time AS INT) AS dep_time, CAST(CAST(distance AS DOUBLE) AS INT) AS distance, tailnum
FROM nulled WHERE {GOOD_DISTANCE_SQL}""")
def validate_keep_nulls(spark, d):
    raw = records.null_tokens(raw_flights(_events(spark, d)))
    return validate.accepted(raw, null_policy="keep", keep=["event_id"]).select("event_id", "dep_time", "distance", "tailnum")


@query("row_cap", f"""
WITH {FLIGHTS_SQL}, head AS (SELECT event_id FROM events ORDER BY event_id LIMIT 700)
SELECT f.* FROM head JOIN flights f USING (event_id)""")
def row_cap(spark, d):
    head = ranking.head_rows(records.null_tokens(raw_flights(_events(spark, d))), 700, "event_id")
    return validate.accepted(head, keep=["event_id"])


@query("csv_source", f"""
WITH {FLIGHTS_SQL}
SELECT event_id, carrier, dest, dep_time, distance, tailnum FROM nulled""")
def csv_source(spark, d):
    path = shared_path(spark, "csv")
    raw_flights(_events(spark, d)).write.option("header", True).csv(path)
    return records.read_csv(spark, path).select(
        F.col("event_id").cast("long").alias("event_id"), "carrier", "dest", "dep_time", "distance", "tailnum")


@query("zip_source", f"""
WITH {FLIGHTS_SQL} SELECT CAST(event_id AS VARCHAR) AS event_id, carrier, dest, dep_time, tailnum FROM nulled""")
def zip_source(spark, d):
    """Each task packs its rows into archives of a bounded number of rows; all of them are then read in parallel."""
    names = ["event_id", "carrier", "dest", "dep_time", "tailnum"]

    def pack(frames):
        for pdf in frames:
            text = io.StringIO()
            pdf.to_csv(text, index=False, quoting=csv.QUOTE_MINIMAL)
            held = io.BytesIO()
            with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
                z.writestr("readme.txt", "rows")
                z.writestr("rows.CSV", text.getvalue())
            yield pd.DataFrame({"content": [held.getvalue()]})

    archives = raw_flights(_events(spark, d)).select(*names).mapInPandas(pack, "content binary")
    folder = shared_path(spark, "zip")
    _write_files(archives, folder)
    return records.read_records(spark, f"{folder}/*.zip", names).select(*names)


def _write_files(archives, folder):
    """Put each binary value into a file of its own, from the tasks, on the shared folder."""
    from pyarrow import fs

    def save(frames):
        store, root = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        store.create_dir(root)
        for pdf in frames:
            names = []
            for content in pdf["content"]:
                # Named by content: a task that runs again writes the same files again.
                name = f"{root}/{hashlib.sha1(content).hexdigest()}.zip"
                with store.open_output_stream(name) as f:
                    f.write(bytes(content))
                names.append(name)
            yield pd.DataFrame({"name": names})

    archives.mapInPandas(save, "name string").agg(F.count("*")).first()


@query("stable_id", f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, {uuid5_sql(NAMESPACE_URL,
    "concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, coalesce(nullif(l_returnflag, 'N'), 'None'))")} AS id
FROM lineitem""")
def stable_id(spark, d):
    li = table(spark, d, "lineitem")
    flag = F.nullif("l_returnflag", F.lit("N"))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
                     record_id("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", flag).alias("id"))


@query("flight_id", f"WITH {FLIGHTS_SQL} SELECT event_id, {FLIGHT_ID_SQL} AS flight_id FROM flights")
def flight_id(spark, d):
    return ingest.with_id(flights(_events(spark, d))).select("event_id", "flight_id")


_LINE_ORDER = ("l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax")


@query("dedup_last_wins", f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_shipdate, l_extendedprice FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber
  ORDER BY {', '.join(c + ' DESC' for c in _LINE_ORDER)}) = 1""")
def dedup_last_wins(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *_LINE_ORDER)
    return ranking.last_per_key(li, ["l_orderkey", "l_linenumber"], *_LINE_ORDER).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", "l_extendedprice")


_STORED_SQL = f"""
WITH {FLIGHTS_SQL}, ids AS (SELECT *, {FLIGHT_ID_SQL} AS flight_id FROM flights),
stored AS (SELECT DISTINCT flight_id FROM ids JOIN events USING (event_id) WHERE ts < TIMESTAMP '2024-01-16')"""


@query("incremental_ingest", _STORED_SQL + """
SELECT event_id, flight_id, year, month, day, origin, dest, carrier, flight, tailnum FROM ids
WHERE flight_id NOT IN (SELECT flight_id FROM stored)
QUALIFY row_number() OVER (PARTITION BY flight_id ORDER BY event_id DESC) = 1""")
def incremental_ingest(spark, d):
    rows, stored = _flight_rows(spark, d)
    return ingest.unseen(rows, stored, "flight_id", ["event_id"], ["year", "month"]).select(
        "event_id", "flight_id", "year", "month", "day", "origin", "dest", "carrier", "flight", "tailnum")


@query("already_stored", _STORED_SQL + """
SELECT count(*) AS n FROM ids WHERE flight_id IN (SELECT flight_id FROM stored)""")
def already_stored(spark, d):
    rows, stored = _flight_rows(spark, d)
    return ingest.already_stored(rows, stored).agg(F.count("*").alias("n"))


@query("ingest_report", _STORED_SQL + """,
marked AS (SELECT r.event_id, i.flight_id, s.flight_id IS NOT NULL AS known
  FROM raw r LEFT JOIN ids i USING (event_id) LEFT JOIN stored s ON s.flight_id = i.flight_id)
SELECT count(*) AS total, count(*) FILTER (WHERE flight_id IS NULL) AS invalid,
  count(*) FILTER (WHERE flight_id IS NOT NULL AND known) AS existing,
  count(DISTINCT flight_id) FILTER (WHERE NOT known) AS upserted FROM marked""")
def ingest_report(spark, d):
    _, stored = _flight_rows(spark, d)
    raw = records.null_tokens(raw_flights(_events(spark, d)))
    return ingest.ingest_report(ingest.with_id(validate.typed(raw)), stored, "flight_id", F.col("valid"))


_AIR = "(VALUES {}) t(code, name)"


def _dim_sql(codes):
    return _AIR.format(", ".join("('" + c + "', '" + n.replace("'", "''") + "')" for c, n in codes.items()))


def flight_docs_sql():
    from recallgrid.schema import AIRPORTS, CARRIERS

    return f"""
c AS (SELECT * FROM {_dim_sql(CARRIERS)}), a AS (SELECT * FROM {_dim_sql(AIRPORTS)}),
docs AS (
SELECT event_id, concat(f.carrier, ' ', coalesce(c.name, f.carrier), ' flight ', flight, ' ', f.origin, ' ',
  coalesce(o.name, f.origin), ' to ', f.dest, ' ', coalesce(z.name, f.dest), ' ', year, '-', month, '-', day,
  ' sched ', sched_dep_time, '->', sched_arr_time, ' actual ', dep_time, '->', arr_time,
  ' dist ', distance, ' air ', air_time) AS doc
FROM flights f LEFT JOIN c ON c.code = f.carrier LEFT JOIN a o ON o.code = f.origin LEFT JOIN a z ON z.code = f.dest)"""


@query("flight_document", f"WITH {FLIGHTS_SQL}, {flight_docs_sql()} SELECT * FROM docs")
def flight_document(spark, d):
    return ingest.flight_document(flights(_events(spark, d))).select("event_id", "doc")


@query("doc_render", """
SELECT l_orderkey, l_linenumber, l_shipdate, concat('part ', l_partkey, ' ', p_name, ' by ', coalesce(s_name, ''), ' of ',
  coalesce(n_name, 'None'), ' qty ', CAST(l_quantity AS BIGINT), ' flag ', coalesce(nullif(l_returnflag, 'N'), 'None')) AS doc
FROM lineitem LEFT JOIN part ON p_partkey = l_partkey LEFT JOIN supplier ON s_suppkey = l_suppkey
LEFT JOIN nation ON n_nationkey = s_nationkey""")
def doc_render(spark, d):
    li = table(spark, d, "lineitem")
    part = table(spark, d, "part").select("p_partkey", "p_name")
    nation = table(spark, d, "nation").select("n_nationkey", "n_name")
    supplier = table(spark, d, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"), "left").select(
        "s_suppkey", "s_name", "n_name")
    full = li.join(part, li.l_partkey == part.p_partkey, "left").join(
        supplier, li.l_suppkey == supplier.s_suppkey, "left")
    doc = ingest.render([
        "part ", F.col("l_partkey"), " ", F.col("p_name"), " by ", F.coalesce("s_name", F.lit("")), " of ", F.col("n_name"),
        " qty ", F.col("l_quantity").cast("long"), " flag ", F.nullif("l_returnflag", F.lit("N"))])
    return full.select("l_orderkey", "l_linenumber", "l_shipdate", doc.alias("doc"))


@query("index_append", _STORED_SQL + """,
fresh AS (SELECT * FROM ids WHERE flight_id NOT IN (SELECT flight_id FROM stored)
  QUALIFY row_number() OVER (PARTITION BY flight_id ORDER BY event_id DESC) = 1)
SELECT year, month, count(*) AS n, CAST(count(DISTINCT flight_id) AS BIGINT) AS n_ids, CAST(64 AS BIGINT) AS dim,
  CAST(sum(distance) AS BIGINT) AS distance FROM fresh GROUP BY year, month""")
def index_append(spark, d):
    """Write the index, append to it twice (the second run finds all ids stored), and read it back.

    The second run reads the ids of the partitions only that its rows fall into.
    """
    rows, stored = _flight_rows(spark, d)
    valid = flights(_events(spark, d))
    path = shared_path(spark, "index")
    fresh = ingest.index_rows(valid, stored, hash_embedding(), ["event_id"], partitions=["year", "month"])
    tables.create_index(spark, path, fresh.schema)
    tables.append_index(fresh, path, 64)
    seen = tables.stored_ids(spark, path, fresh.schema, batch=valid, partitions=["year", "month"]).unionByName(stored)
    again = ingest.index_rows(valid, seen, hash_embedding(), ["event_id"], partitions=["year", "month"])
    tables.append_index(again, path, 64)
    index = tables.read_index(spark, path, fresh.schema)
    return index.groupBy("year", "month").agg(
        F.count("*").alias("n"), F.count_distinct("flight_id").alias("n_ids"),
        F.max(F.size("embedding")).cast("long").alias("dim"), F.sum("distance").alias("distance"))


@query("payload_projection", f"WITH {FLIGHTS_SQL} SELECT event_id, {', '.join(PAYLOAD)} FROM flights")
def payload_projection(spark, d):
    return validate.payload(flights(_events(spark, d)).withColumn("extra", F.lit(1)), ["event_id"])
