"""Bookings made from events, and routing of tool requests."""

from __future__ import annotations

from pyspark.sql import functions as F

from recallgrid.functions.ids import booking_key
from recallgrid.operators import bookings as bk, requests as rq
from recallgrid.operators.hooks import hash_embedding
from recallgrid.operators.ingest import flight_document
from recallgrid.plans.registry import FLIGHTS_SQL, flights, query, table, uuid5_sql
from recallgrid.schema import BOOKING, NAMESPACE_DNS, NAMESPACE_URL
from recallgrid.session import shared_path, write_out
from recallgrid.sources import tables

_KEY_SQL = uuid5_sql(NAMESPACE_DNS, "concat(user_id, '|pat ', CAST(json_extract_string(props, '$.k') AS INT) % 5)")
_ID_SQL = lambda e: uuid5_sql(NAMESPACE_URL, f"concat('booking|', {e})")

# Some requests have no key (always a new booking), many share the empty key, the rest are keyed by user and name.
BOOKING_SQL = f"""
ev AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events),
asked AS (SELECT event_id AS request_id, event_type, user_id, k, value, ts, CAST(user_id AS VARCHAR) AS flight_id,
    CASE k % 3 WHEN 0 THEN '  Pat ' || (k % 5) WHEN 1 THEN 'PAT ' || (k % 5) ELSE 'pat ' || (k % 5) || ' ' END AS passenger_name,
    CASE WHEN k % 10 = 0 THEN NULL WHEN k % 17 = 0 THEN '' ELSE {_KEY_SQL} END AS idempotency_key,
    printf('{{"carrier":"DL","flight":%d}}', k) AS snap FROM ev),
stored AS (SELECT {_ID_SQL('request_id')} AS booking_id, flight_id, passenger_name,
    CASE WHEN value > 50 THEN 'CANCELLED' ELSE 'CONFIRMED' END AS status, idempotency_key, snap, ts
  FROM asked WHERE event_type = 'signup'
  QUALIFY idempotency_key IS NULL OR row_number() OVER (PARTITION BY idempotency_key ORDER BY ts, request_id) = 1),
req AS (SELECT * FROM asked WHERE event_type IN ('purchase', 'click')),
won AS (SELECT idempotency_key, arg_min(request_id, (ts, request_id)) AS winner FROM req
  WHERE idempotency_key IS NOT NULL GROUP BY idempotency_key),
answers AS (SELECT r.request_id, coalesce(s.booking_id, {_ID_SQL('coalesce(w.winner, r.request_id)')}) AS booking_id,
    coalesce(s.status, 'CONFIRMED') AS status, coalesce(s.flight_id, x.flight_id, r.flight_id) AS flight_id,
    coalesce(s.passenger_name, x.passenger_name, r.passenger_name) AS passenger_name, r.snap AS flight_snapshot_json,
    coalesce(s.ts, x.ts, r.ts) AS created_at, coalesce(s.ts, x.ts, r.ts) AS updated_at,
    s.booking_id IS NULL AND coalesce(w.winner, r.request_id) = r.request_id AS created
  FROM req r LEFT JOIN won w USING (idempotency_key) LEFT JOIN req x ON x.request_id = w.winner
  LEFT JOIN stored s ON s.idempotency_key = r.idempotency_key)"""


def requests_of(e):
    """Create requests out of events, a table or a stream."""
    k, user = F.get_json_object("props", "$.k").cast("int"), F.col("user_id").cast("string")
    e = e.withColumn("k", k).withColumn("flight_id", user).withColumn("_n", (F.col("k") % 5).cast("string"))
    name = F.when(F.col("k") % 3 == 0, F.concat(F.lit("  Pat "), "_n")).when(
        F.col("k") % 3 == 1, F.concat(F.lit("PAT "), "_n")).otherwise(F.concat(F.lit("pat "), "_n", F.lit(" ")))
    e = e.withColumn("passenger_name", name)
    key = F.when(F.col("k") % 10 == 0, None).when(F.col("k") % 17 == 0, "").otherwise(
        booking_key(F.col("flight_id"), F.col("passenger_name")))
    return e.select(
        F.col("event_id").alias("request_id"), "event_type", "user_id", "k", "value", "flight_id", "passenger_name",
        key.alias("idempotency_key"), F.col("ts").alias("requested_at"),
        F.format_string('{"carrier":"DL","flight":%d}', "k").alias("flight_snapshot_json"))


def asked(spark, d):
    return requests_of(table(spark, d, "events"))


def stored(spark, d):
    """Bookings there are before the requests come: one per key, some cancelled."""
    rows = asked(spark, d).filter(F.col("event_type") == "signup")
    _, made = bk.create(rows, spark.createDataFrame([], BOOKING))
    cancelled = rows.filter(F.col("value") > 50).select(
        bk.new_booking_id(F.col("request_id")).alias("booking_id"), F.lit(True).alias("_c"))
    return made.join(cancelled, "booking_id", "left").withColumn(
        "status", F.when(F.col("_c"), "CANCELLED").otherwise("CONFIRMED")).drop("_c")


def creates(spark, d):
    return asked(spark, d).filter(F.col("event_type").isin("purchase", "click"))


@query("booking_create", f"WITH {BOOKING_SQL} SELECT * FROM answers")
def booking_create(spark, d):
    return bk.create(creates(spark, d), stored(spark, d))[0]


@query("booking_rows", f"""
WITH {BOOKING_SQL} SELECT a.booking_id, a.flight_id, a.passenger_name, r.idempotency_key, a.flight_snapshot_json, r.ts AS created_at
FROM answers a JOIN req r USING (request_id) WHERE created""")
def booking_rows(spark, d):
    """Rows a batch of requests adds to the log."""
    return bk.create(creates(spark, d), stored(spark, d))[1].select(
        "booking_id", "flight_id", "passenger_name", "idempotency_key", "flight_snapshot_json", "created_at")


@query("booking_create_checked", f"""
WITH {BOOKING_SQL},
good AS (SELECT r.* FROM req r JOIN orders o ON CAST(o.o_orderkey AS VARCHAR) = r.flight_id AND o.o_orderstatus <> 'P'),
w AS (SELECT idempotency_key, arg_min(request_id, (ts, request_id)) AS winner FROM good
  WHERE idempotency_key IS NOT NULL GROUP BY idempotency_key)
SELECT g.request_id, coalesce(s.booking_id, {_ID_SQL('coalesce(w.winner, g.request_id)')}) AS booking_id,
  CAST(NULL AS VARCHAR) AS error FROM good g LEFT JOIN w USING (idempotency_key) LEFT JOIN stored s ON s.idempotency_key = g.idempotency_key
UNION ALL SELECT request_id, NULL, 'FLIGHT_NOT_FOUND' FROM req WHERE request_id NOT IN (SELECT request_id FROM good)""")
def booking_create_checked(spark, d):
    """Only orders that are not pending can be booked."""
    catalogue = table(spark, d, "orders").filter(F.col("o_orderstatus") != "P").select(
        F.col("o_orderkey").cast("string").alias("flight_id"))
    answers, _ = bk.create_checked(creates(spark, d), catalogue, stored(spark, d))
    return answers.select("request_id", "booking_id", "error")


def _by_booking(spark, d, kind):
    """Requests about the booking of the event before, which often does not exist."""
    return asked(spark, d).filter(F.col("event_type") == kind).select(
        "request_id", bk.new_booking_id(F.col("request_id") - 1).alias("booking_id"), "requested_at")


@query("booking_cancel", f"""
WITH {BOOKING_SQL}
SELECT a.request_id, b.booking_id, CASE WHEN s.booking_id IS NOT NULL THEN 'CANCELLED' END AS status,
  CASE WHEN s.booking_id IS NOT NULL THEN greatest(s.ts, a.ts) END AS updated_at,
  CASE WHEN s.booking_id IS NULL THEN 'BOOKING_NOT_FOUND' END AS error
FROM asked a JOIN (SELECT request_id, {_ID_SQL('request_id - 1')} AS booking_id FROM asked) b USING (request_id)
LEFT JOIN stored s USING (booking_id) WHERE a.event_type = 'error'""")
def booking_cancel(spark, d):
    return bk.cancel(_by_booking(spark, d, "error"), stored(spark, d))[0]


@query("booking_current", f"""
WITH {BOOKING_SQL}, gone AS (SELECT {_ID_SQL('request_id - 1')} AS booking_id, ts FROM asked WHERE event_type = 'error')
SELECT s.booking_id, CASE WHEN g.booking_id IS NOT NULL THEN 'CANCELLED' ELSE s.status END AS status,
  greatest(s.ts, g.ts) AS updated_at FROM stored s LEFT JOIN gone g USING (booking_id)""")
def booking_current(spark, d):
    """Latest state after cancels were appended to the written log."""
    path = shared_path(spark, "log")
    tables.create_log(spark, path)
    tables.append_log(stored(spark, d), path)
    asked_for = _by_booking(spark, d, "error")
    tables.append_log(bk.cancel(asked_for, tables.read_bookings(spark, path, asked_for))[1], path)
    return tables.read_bookings(spark, path).select("booking_id", "status", "updated_at")


@query("booking_log_batches", f"""
WITH {BOOKING_SQL},
won3 AS (SELECT idempotency_key, arg_min(request_id, (request_id % 3, ts, request_id)) AS winner FROM asked
  WHERE idempotency_key IS NOT NULL GROUP BY idempotency_key UNION ALL
  SELECT NULL, request_id FROM asked WHERE idempotency_key IS NULL)
SELECT coalesce(idempotency_key, 'none') AS idempotency_key, count(*) AS n,
  count(*) FILTER (WHERE winner + 1 IN (SELECT request_id FROM asked WHERE event_type = 'error')) AS n_cancelled
FROM won3 GROUP BY idempotency_key""")
def booking_log_batches(spark, d):
    """Three batches of creates and one of cancels on one log, compacted in between; each reads its own bookings only."""
    path = shared_path(spark, "log")
    tables.create_log(spark, path)
    for number in range(3):
        batch = write_out(asked(spark, d).filter(F.col("request_id") % 3 == number), "batch")  # read for its keys, then booked
        tables.append_log(bk.create(batch, tables.read_bookings(spark, path, batch, "idempotency_key"))[1], path)
        if number == 1:
            tables.compact_log(spark, path)
    cancels = write_out(_by_booking(spark, d, "error"), "cancels")
    tables.append_log(bk.cancel(cancels, tables.read_bookings(spark, path, cancels))[1], path)
    return tables.read_bookings(spark, path).groupBy(F.coalesce("idempotency_key", F.lit("none")).alias("idempotency_key")).agg(
        F.count("*").alias("n"), F.count(F.when(F.col("status") == "CANCELLED", 1)).alias("n_cancelled"))


@query("booking_answers", f"""
WITH {BOOKING_SQL}
SELECT request_id, booking_id, flight_id, passenger_name, status, strftime(created_at, '%Y-%m-%dT%H:%M:%S') ||
    CASE WHEN epoch_us(created_at) % 1000000 = 0 THEN '' ELSE strftime(created_at, '.%f') END || '+00:00' AS created_at,
  CAST(json_extract_string(flight_snapshot_json, '$.flight') AS INT) AS flight,
  json_extract_string(flight_snapshot_json, '$.carrier') AS carrier, created FROM answers""")
def booking_answers(spark, d):
    """Create answers as the service words them: ISO times, the caller's snapshot as a struct."""
    return bk.answer(bk.create(creates(spark, d), stored(spark, d))[0]).select(
        "request_id", "booking_id", "flight_id", "passenger_name", "status", "created_at",
        F.col("flight_snapshot.flight").alias("flight"), F.col("flight_snapshot.carrier").alias("carrier"), "created")


@query("booking_get", f"""
WITH {BOOKING_SQL}
SELECT a.request_id, b.booking_id, s.passenger_name, s.status, CAST(json_extract_string(s.snap, '$.flight') AS INT) AS flight,
  json_extract_string(s.snap, '$.carrier') AS carrier, CASE WHEN s.booking_id IS NULL THEN 'BOOKING_NOT_FOUND' END AS error
FROM asked a JOIN (SELECT request_id, {_ID_SQL('request_id - 1')} AS booking_id FROM asked) b USING (request_id)
LEFT JOIN stored s USING (booking_id) WHERE a.event_type = 'view'""")
def booking_get(spark, d):
    return bk.get(_by_booking(spark, d, "view"), stored(spark, d)).select(
        "request_id", "booking_id", "passenger_name", "status", F.col("flight_snapshot.flight").alias("flight"),
        F.col("flight_snapshot.carrier").alias("carrier"), "error")


@query("booking_key_audit", f"""
WITH {BOOKING_SQL} SELECT idempotency_key, count(*) AS n FROM asked WHERE idempotency_key IS NOT NULL
GROUP BY idempotency_key HAVING count(*) > 1""")
def booking_key_audit(spark, d):
    """Keys used by more than one request (audited as if every request had been stored)."""
    return bk.duplicate_keys(asked(spark, d))


# ---- routing ----

_TOOLS = {"view": "search_flights", "click": "get_flight_details", "purchase": "create_booking",
          "error": "cancel_booking", "signup": "list_flights"}

_ROUTE_SQL = f"""
{BOOKING_SQL},
calls AS (SELECT request_id, k, user_id, {'CASE event_type ' + ' '.join(f"WHEN '{e}' THEN '{t}'" for e, t in _TOOLS.items()) + ' END'} AS tool,
  CASE WHEN k = 3 THEN '[1, 2]' WHEN k = 4 THEN '' WHEN k = 5 THEN 'nothing to parse' WHEN k = 6 THEN '{{}}' ELSE
    CASE WHEN k % 2 = 0 THEN 'call: ' ELSE '' END || CASE event_type
      WHEN 'view' THEN printf('{{"query": "to %d", "limit": %d, "month_min": "%d", "origin": null}}', k, k, k % 14)
      WHEN 'click' THEN CASE WHEN k % 9 = 0 THEN '{{"flight_id": 0}}' ELSE printf('{{"flight_id": %d}}', user_id * 100) END
      WHEN 'purchase' THEN CASE WHEN k % 9 = 0 THEN '{{"flight_id": 7, "passenger_name": "x"}}'
        ELSE printf('{{"flight_id": "%d", "passenger_name": " Pat %d"}}', user_id * 100, k) END
      ELSE '{{"booking_id": "' || {_ID_SQL('request_id - 1')} || '"}}' END || CASE WHEN k % 2 = 0 THEN ' done' ELSE '' END END AS args_text
  FROM asked),
p AS (SELECT *, CASE WHEN json_valid(args_text) THEN args_text WHEN json_valid(regexp_extract(args_text, '(?s)\\{{.*\\}}'))
    THEN regexp_extract(args_text, '(?s)\\{{.*\\}}') ELSE '{{}}' END AS j FROM calls),
f AS (SELECT *, json_type(j) AS jt, json_extract_string(j, '$.query') AS q, json_type(j, '$.query') AS qt,
    TRY_CAST(json_extract_string(j, '$.limit') AS INT) AS lim, TRY_CAST(json_extract_string(j, '$.month_min') AS INT) AS mm,
    json_extract_string(j, '$.flight_id') AS fid, json_type(j, '$.flight_id') AS ft,
    json_extract_string(j, '$.passenger_name') AS pn, json_extract_string(j, '$.booking_id') AS bid FROM p),
g AS (SELECT *, CASE WHEN args_text <> '' AND j IN ('{{}}', '[]') THEN 'MALFORMED_ARGS'
    WHEN tool = 'list_flights' THEN 'UNKNOWN_TOOL' WHEN jt <> 'OBJECT' THEN 'TOOL_ERROR'
    WHEN tool = 'search_flights' AND NOT coalesce(qt = 'VARCHAR' AND lim BETWEEN 1 AND 50 AND mm BETWEEN 1 AND 12, false) THEN 'INVALID_ARGS'
    WHEN tool = 'create_booking' AND NOT coalesce(ft = 'VARCHAR' AND pn IS NOT NULL, false) THEN 'INVALID_ARGS'
    WHEN tool = 'cancel_booking' AND bid IS NULL THEN 'INVALID_ARGS' END AS problem FROM f),
h AS (SELECT g.*, CASE WHEN problem IS NOT NULL THEN problem
    WHEN tool = 'get_flight_details' AND (fid IS NULL OR fid = '0') THEN 'MISSING_FLIGHT_ID'
    WHEN tool IN ('get_flight_details', 'create_booking') AND o.o_orderkey IS NULL THEN 'FLIGHT_NOT_FOUND'
    WHEN tool = 'cancel_booking' AND s.booking_id IS NULL THEN 'BOOKING_NOT_FOUND' END AS error
  FROM g LEFT JOIN orders o ON CAST(o.o_orderkey AS VARCHAR) = g.fid LEFT JOIN stored s ON s.booking_id = g.bid)"""


def _calls(spark, d):
    a = asked(spark, d)
    kind, k, user = F.col("event_type"), F.col("k"), F.col("user_id")
    tool = F.lit(None).cast("string")
    for event, name in _TOOLS.items():
        tool = F.when(kind == event, name).otherwise(tool)
    flight = (user * 100).cast("string")
    body = (
        F.when(kind == "view", F.format_string(
            '{"query": "to %d", "limit": %d, "month_min": "%d", "origin": null}', k, k, k % 14))
        .when(kind == "click", F.when(k % 9 == 0, '{"flight_id": 0}').otherwise(
            F.concat(F.lit('{"flight_id": '), flight, F.lit("}"))))
        .when(kind == "purchase", F.when(k % 9 == 0, '{"flight_id": 7, "passenger_name": "x"}').otherwise(
            F.format_string('{"flight_id": "%s", "passenger_name": " Pat %d"}', flight, k)))
        .otherwise(F.concat(F.lit('{"booking_id": "'), bk.new_booking_id(F.col("request_id") - 1), F.lit('"}'))))
    even = k % 2 == 0
    wrapped = F.concat(F.when(even, "call: ").otherwise(""), body, F.when(even, " done").otherwise(""))
    raw = F.when(k == 3, "[1, 2]").when(k == 4, "").when(k == 5, "nothing to parse").when(k == 6, "{}").otherwise(wrapped)
    return a.select("request_id", tool.alias("tool"), raw.alias("args_text"), "requested_at")


@query("request_router", f"""
WITH {_ROUTE_SQL}
SELECT request_id, tool, CASE WHEN problem IS NOT NULL OR (tool = 'create_booking' AND error IS NOT NULL) THEN 'error'
    WHEN tool = 'search_flights' THEN 'search_results' WHEN tool = 'get_flight_details' THEN 'flight_details'
    WHEN tool = 'create_booking' THEN 'booking_confirmation' ELSE 'cancel_result' END AS type, error,
  CASE WHEN problem IS NOT NULL THEN NULL WHEN tool = 'search_flights' THEN q
    WHEN tool = 'create_booking' THEN {uuid5_sql(NAMESPACE_DNS, "concat(fid, '|', lower(trim(pn)))")}
    WHEN tool = 'get_flight_details' THEN coalesce(fid, '') ELSE bid END AS target FROM h""")
def request_router(spark, d):
    known = table(spark, d, "orders").select(F.col("o_orderkey").alias("flight_id"))
    return rq.route(_calls(spark, d), known, stored(spark, d))


def _answers_sql():
    from recallgrid.plans.loading import flight_docs_sql
    from recallgrid.plans.retrieval import HASH_SQL

    key = uuid5_sql(NAMESPACE_DNS, "concat(fid, '|', lower(trim(pn)))")
    return f"""
WITH {FLIGHTS_SQL}, {flight_docs_sql()}, {_ROUTE_SQL},
asks AS (SELECT DISTINCT q AS query, mm, lim, concat_ws('|', q, mm, lim) AS ask FROM g WHERE problem IS NULL AND tool = 'search_flights'),
qt AS (SELECT DISTINCT query FROM asks),
qe AS ({HASH_SQL.format(id='query', text='query', t='qt')}),
de AS ({HASH_SQL.format(id='event_id', text='doc', t='docs')}),
scored AS (SELECT asks.*, CAST(fl.event_id AS VARCHAR) AS flight_id, fl.month, round(list_cosine_similarity(de.vec, qe.vec), 6) AS score
  FROM asks JOIN qe ON qe.id = asks.query CROSS JOIN flights fl JOIN de ON de.id = fl.event_id),
pp AS (SELECT * FROM scored WHERE score >= 0.3 AND NOT isnan(score)),
met AS (SELECT *, false AS dropped FROM pp WHERE month >= mm),
both_ AS (SELECT * FROM met UNION ALL SELECT *, true FROM pp WHERE ask NOT IN (SELECT ask FROM met)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY ask ORDER BY score DESC, flight_id) AS rn FROM both_),
hits AS (SELECT ask, count(*) AS n, arg_min(flight_id, rn) AS first_hit, bool_or(dropped) AS dropped FROM ranked
  WHERE rn <= least(lim, 20) GROUP BY ask),
cr AS (SELECT g.request_id, {key} AS idempotency_key, g.pn, o.ts, fl.carrier FROM g JOIN asked o USING (request_id)
  JOIN flights fl ON CAST(fl.event_id AS VARCHAR) = g.fid WHERE g.problem IS NULL AND g.tool = 'create_booking'),
cw AS (SELECT idempotency_key, arg_min(request_id, (ts, request_id)) AS winner, arg_min(pn, (ts, request_id)) AS pn FROM cr GROUP BY idempotency_key),
made AS (SELECT cr.request_id, cr.carrier, coalesce(s.booking_id, {_ID_SQL('cw.winner')}) AS booking_id,
    coalesce(s.passenger_name, cw.pn) AS passenger_name, coalesce(s.status, 'CONFIRMED') AS status
  FROM cr JOIN cw USING (idempotency_key) LEFT JOIN stored s USING (idempotency_key)),
e AS (SELECT g.*, d.carrier AS d_carrier, m.booking_id AS m_id, m.passenger_name AS m_name, m.status AS m_status, m.carrier AS m_carrier,
    s.booking_id AS s_id, CASE WHEN problem IS NOT NULL THEN problem
      WHEN tool = 'get_flight_details' AND (fid IS NULL OR fid = '0') THEN 'MISSING_FLIGHT_ID'
      WHEN tool = 'get_flight_details' AND d.event_id IS NULL THEN 'FLIGHT_NOT_FOUND'
      WHEN tool = 'create_booking' AND m.request_id IS NULL THEN 'FLIGHT_NOT_FOUND'
      WHEN tool = 'cancel_booking' AND s.booking_id IS NULL THEN 'BOOKING_NOT_FOUND' END AS error
  FROM g LEFT JOIN flights d ON CAST(d.event_id AS VARCHAR) = g.fid AND g.tool = 'get_flight_details'
  LEFT JOIN made m ON m.request_id = g.request_id LEFT JOIN stored s ON s.booking_id = g.bid AND g.tool = 'cancel_booking')
SELECT request_id, tool, CASE WHEN problem IS NOT NULL OR (tool = 'create_booking' AND error IS NOT NULL) THEN 'error'
    WHEN tool = 'search_flights' THEN 'search_results' WHEN tool = 'get_flight_details' THEN 'flight_details'
    WHEN tool = 'create_booking' THEN 'booking_confirmation' ELSE 'cancel_result' END AS type, error,
  CASE WHEN problem IS NULL AND tool = 'search_flights' THEN coalesce(h2.n, 0) END AS n_results, h2.first_hit,
  CASE WHEN problem IS NULL AND tool = 'search_flights' THEN coalesce(h2.dropped, true) END AS filters_dropped,
  CASE WHEN problem IS NULL THEN coalesce(m_id, s_id, CASE WHEN error = 'BOOKING_NOT_FOUND' THEN bid END) END AS booking_id,
  m_name AS passenger_name, CASE WHEN problem IS NULL AND s_id IS NOT NULL THEN 'CANCELLED' ELSE m_status END AS status,
  CASE WHEN error IS NULL THEN coalesce(d_carrier, m_carrier) END AS carrier
FROM e LEFT JOIN hits h2 ON problem IS NULL AND tool = 'search_flights' AND h2.ask = concat_ws('|', q, mm, lim)"""


@query("request_answers", _answers_sql())
def request_answers(spark, d):
    """Every request carried out; what its answer says, read back out of the JSON."""
    index = flight_document(flights(table(spark, d, "events"))).withColumn("flight_id", F.col("event_id").cast("string"))
    index = index.withColumn("embedding", hash_embedding()(F.col("doc")))
    answers, _ = rq.answer_requests(_calls(spark, d), index, stored(spark, d), embed=hash_embedding())
    get = lambda *paths: F.coalesce(*[F.get_json_object("data", p) for p in paths])
    return answers.select(
        "request_id", "tool", "type", "error", F.json_array_length(get("$.results")).cast("long").alias("n_results"),
        get("$.results[0].flight_id").alias("first_hit"), get("$.filters_dropped").cast("boolean").alias("filters_dropped"),
        get("$.booking.booking_id", "$.result.booking_id", "$.booking_id").alias("booking_id"),
        get("$.booking.passenger_name").alias("passenger_name"), get("$.booking.status", "$.result.status").alias("status"),
        get("$.flight.carrier", "$.booking.flight_snapshot.carrier").alias("carrier"))


@query("request_problems", f"""
WITH {_ROUTE_SQL} SELECT coalesce(problem, 'OK') AS problem, tool, count(*) AS n FROM g GROUP BY ALL""")
def request_problems(spark, d):
    parsed = rq.parse_requests(_calls(spark, d))
    return parsed.groupBy(F.coalesce("problem", F.lit("OK")).alias("problem"), "tool").agg(F.count("*").alias("n"))


@query("request_limit", """
SELECT event_id, least(CASE WHEN event_type = 'view' THEN 10 ELSE CAST(json_extract_string(props, '$.k') AS INT) END, 20) AS lim
FROM events""")
def request_limit(spark, d):
    k = F.when(F.col("event_type") != "view", F.get_json_object("props", "$.k").cast("int"))
    return table(spark, d, "events").select("event_id", rq.limit_for(k).alias("lim"))
