import re
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from recallgrid.operators import bookings as bk, requests as rq
from recallgrid.schema import BOOKING, HIT_FIELDS
from recallgrid.sources import tables

T0 = datetime(2024, 1, 1)
SNAP = '{"carrier":"DL","origin":"ATL","dest":"JFK","flight":100}'


def ask(spark, *rows):
    """(request_id, name, key) rows, one minute apart."""
    data = [(i, "f1", name, SNAP, key, T0 + timedelta(minutes=n)) for n, (i, name, key) in enumerate(rows)]
    return spark.createDataFrame(data, "request_id long, flight_id string, passenger_name string, flight_snapshot_json string, "
                                       "idempotency_key string, requested_at timestamp_ntz")


def empty(spark):
    return spark.createDataFrame([], BOOKING)


def test_first_request_of_a_key_wins(spark):
    answers, rows = bk.create(ask(spark, (1, "A", "k"), (2, "B", "k"), (3, "C", "other")), empty(spark))
    got = {r.request_id: r for r in answers.collect()}
    assert got[1].booking_id == got[2].booking_id != got[3].booking_id
    assert (got[2].passenger_name, got[2].created, got[1].created) == ("A", False, True)
    assert rows.count() == 2 and rows.schema.names == BOOKING.names


def test_null_key_always_books_and_empty_key_is_a_key(spark):
    answers, rows = bk.create(ask(spark, (1, "A", None), (2, "A", None), (3, "B", ""), (4, "C", "")), empty(spark))
    ids = {r.request_id: r.booking_id for r in answers.collect()}
    assert ids[1] != ids[2] and ids[3] == ids[4] and rows.count() == 3


def test_used_key_returns_the_cancelled_booking(spark, tmp_path):
    log = str(tmp_path / "log")
    tables.create_log(spark, log)
    tables.append_log(bk.create(ask(spark, (1, "A", "k")), tables.read_bookings(spark, log))[1], log)
    booked = tables.read_bookings(spark, log).first().booking_id
    req = spark.createDataFrame([(9, booked, T0 + timedelta(hours=1)), (10, booked, T0 + timedelta(hours=2)),
                                 (11, "nope", T0)], "request_id long, booking_id string, requested_at timestamp_ntz")
    answers, rows = bk.cancel(req, tables.read_bookings(spark, log))
    assert {r.request_id: (r.status, r.error) for r in answers.collect()} == {
        9: ("CANCELLED", None), 10: ("CANCELLED", None), 11: (None, "BOOKING_NOT_FOUND")}
    tables.append_log(rows, log)
    now = tables.read_bookings(spark, log).collect()
    assert [(r.status, r.updated_at) for r in now] == [("CANCELLED", T0 + timedelta(hours=2))]

    answers, rows = bk.create(ask(spark, (2, "Z", "k")), tables.read_bookings(spark, log))
    again = answers.first()
    assert (again.booking_id, again.status, again.passenger_name, again.created) == (booked, "CANCELLED", "A", False)
    assert rows.count() == 0
    found = bk.get(spark.createDataFrame([(booked,), ("x",)], "booking_id string"), tables.read_bookings(spark, log))
    got = {r.booking_id: r for r in found.collect()}
    assert got[booked].flight_snapshot.origin == "ATL" and got["x"].error == "BOOKING_NOT_FOUND"


def test_same_batch_twice_adds_nothing(spark, tmp_path):
    log = str(tmp_path / "log")
    tables.create_log(spark, log)
    batch = ask(spark, (1, "A", "k"), (2, "B", "k"), (3, "C", "m"))
    for _ in range(2):
        tables.append_log(bk.create(batch, tables.read_bookings(spark, log))[1], log)
    assert tables.read_bookings(spark, log).count() == 2
    assert bk.duplicate_keys(tables.read_bookings(spark, log)).count() == 0


def test_log_reads_only_the_buckets_of_a_batch(spark, tmp_path):
    log = str(tmp_path / "log")
    tables.create_log(spark, log, 8)
    for start in (0, 100, 200):
        batch = ask(spark, *[(start + i, "A", f"k{start + i}" if i % 4 else None) for i in range(100)])
        tables.append_log(bk.create(batch, tables.read_bookings(spark, log, batch, "idempotency_key"))[1], log)
    one = ask(spark, (900, "Z", "k101"), (901, "Z", None))
    mine = tables.read_bookings(spark, log, one, "idempotency_key")
    assert [r.idempotency_key for r in mine.collect()] == ["k101"]
    plan = mine._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", plan)
    answers, rows = bk.create(one, mine)
    assert {r.request_id: r.created for r in answers.collect()} == {900: False, 901: True} and rows.count() == 1
    assert tables.read_bookings(spark, log).count() == 300


def test_compaction_keeps_the_state_and_bounds_the_buckets(spark, tmp_path):
    log = str(tmp_path / "log")
    tables.create_log(spark, log, 2)
    tables.append_log(bk.create(ask(spark, *[(i, "A", f"k{i}") for i in range(50)]), tables.read_bookings(spark, log))[1], log)
    some = spark.createDataFrame([(f"k{i}",) for i in range(5)], "idempotency_key string")
    ids = tables.read_bookings(spark, log, some, "idempotency_key").select("booking_id")
    gone = ids.select(F.lit(99).alias("request_id"), "booking_id", F.lit(T0 + timedelta(days=1)).cast("timestamp_ntz").alias("requested_at"))
    tables.append_log(bk.cancel(gone, tables.read_bookings(spark, log, gone))[1], log)
    before = sorted(map(tuple, tables.read_bookings(spark, log).collect()))
    files = lambda: len(tables.read_bookings(spark, log).inputFiles())
    assert tables.compact_log(spark, log, bucket_rows=10) == 1
    assert sorted(map(tuple, tables.read_bookings(spark, log).collect())) == before
    assert len([r for r in before if r[3] == "CANCELLED"]) == 5 and files() >= 5
    again, rows = bk.create(ask(spark, (77, "B", "k3")), tables.read_bookings(spark, log, some, "idempotency_key"))
    assert rows.count() == 0 and again.first().status == "CANCELLED"
    tables.create_log(spark, log)  # there is one already
    assert tables.read_bookings(spark, log).count() == 50
    none = tables.read_bookings(spark, log, some.limit(0), "idempotency_key")
    assert none.count() == 0


def test_answers_in_full(spark):
    answers, _ = bk.create(ask(spark, (1, "A", "k"), (2, "B", "k")), empty(spark))
    got = {r.request_id: r for r in bk.answer(answers).collect()}
    assert got[2].created_at == got[2].updated_at == "2024-01-01T00:00:00+00:00"
    assert (got[2].flight_snapshot.origin, got[2].flight_snapshot.flight, got[2].flight_snapshot.day) == ("ATL", 100, None)


def test_checked_create(spark):
    have = spark.createDataFrame([("f1",)], "flight_id string")
    req = ask(spark, (1, "A", "k"), (2, "B", "m")).withColumn("flight_id", F.when(F.col("request_id") == 1, "f1").otherwise("f2"))
    answers, rows = bk.create_checked(req, have, empty(spark))
    assert {r.request_id: r.error for r in answers.collect()} == {1: None, 2: "FLIGHT_NOT_FOUND"} and rows.count() == 1


def test_snapshot_keeps_present_keys(spark):
    df = spark.createDataFrame([("DL", None)], "carrier string, origin string")
    assert df.select(bk.snapshot_json(df, ["flight_id", "carrier", "origin"])).first()[0] == '{"carrier":"DL","origin":null}'


def test_hot_key_is_one_row_before_the_join(spark):
    req = spark.range(20_000).select(
        F.col("id").alias("request_id"), F.lit("f1").alias("flight_id"), F.lit("n").alias("passenger_name"),
        F.lit(SNAP).alias("flight_snapshot_json"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias(
            "idempotency_key"), F.lit(T0).cast("timestamp_ntz").alias("requested_at"))
    answers, rows = bk.create(req, empty(spark))
    assert rows.count() == 20_000 - 6667 + 1
    assert answers.filter("not created").count() == 6666


def test_router(spark):
    calls = [
        (1, "search_flights", '{"query": "x"}', "search_results", None, "x"),
        (2, "search_flights", '{"query": "x", "limit": 51}', "error", "INVALID_ARGS", None),
        (3, "search_flights", '{"query": 5}', "error", "INVALID_ARGS", None),
        (4, "search_flights", '{"query": "x", "month_min": 0}', "error", "INVALID_ARGS", None),
        (5, "search_flights", '{"query": "x", "limit": null}', "error", "INVALID_ARGS", None),
        (6, "search_flights", '{"query": "x", "origin": null, "limit": "7"}', "search_results", None, "x"),
        (7, "get_flight_details", "", "flight_details", "MISSING_FLIGHT_ID", ""),
        (8, "get_flight_details", '{"flight_id": "f1"}', "flight_details", None, "f1"),
        (9, "get_flight_details", '{"flight_id": "zz"}', "flight_details", "FLIGHT_NOT_FOUND", "zz"),
        (10, "create_booking", '{"flight_id": "f1", "passenger_name": " Al "}', "booking_confirmation", None, None),
        (11, "create_booking", '{"flight_id": "zz", "passenger_name": "A"}', "error", "FLIGHT_NOT_FOUND", None),
        (12, "create_booking", '{"flight_id": "f1"}', "error", "INVALID_ARGS", None),
        (13, "cancel_booking", '{"booking_id": "b1"}', "cancel_result", None, "b1"),
        (14, "cancel_booking", '{"booking_id": "b2"}', "cancel_result", "BOOKING_NOT_FOUND", "b2"),
        (15, "get_booking", 'call {"booking_id": "b1"} now', "booking", None, "b1"),
        (16, "fly", '{"a": 1}', "error", "UNKNOWN_TOOL", None),
        (17, "fly", "[1, 2]", "error", "UNKNOWN_TOOL", None),
        (18, "get_booking", "[1, 2]", "error", "TOOL_ERROR", None),
        (19, "get_booking", "no json", "error", "MALFORMED_ARGS", None),
        (20, "get_booking", "{}", "error", "MALFORMED_ARGS", None),
        (21, "get_booking", "null", "error", "MALFORMED_ARGS", None),
        (22, "get_booking", None, "error", "INVALID_ARGS", None),
    ]
    df = spark.createDataFrame([c[:3] for c in calls], "request_id int, tool string, args_text string")
    flights = spark.createDataFrame([("f1",)], "flight_id string")
    booked = spark.createDataFrame([("b1",)], "booking_id string")
    got = {r.request_id: (r.type, r.error, r.target) for r in rq.route(df, flights, booked).collect()}
    for i, _, _, kind, error, target in calls:
        assert got[i][:2] == (kind, error), i
        if i not in (10, 11):
            assert got[i][2] == target, i
    assert len(got[10][2]) == 36


def test_answers_of_every_tool(spark):
    """One request for each way a tool can answer; the data is what the service would return."""
    import json

    flight = dict(year=2013, month=6, day=15, origin="ATL", dest="JFK", carrier="DL", flight=100, sched_dep_time=800, sched_arr_time=1030,
                  dep_time=None, arr_time=1045, distance=760, air_time=115, tailnum="N1")
    kinds = {k: "string" if isinstance(v, str) else "int" for k, v in flight.items()}
    schema = ", ".join(["flight_id string", *(f"{k} {t}" for k, t in kinds.items()), "doc string", "embedding array<double>"])
    records = spark.createDataFrame([("f1", *flight.values(), "a", [1.0, 0.0]), ("f2", *{**flight, "origin": "LGA"}.values(), "b", [0.8, 0.6])], schema)
    _, old = bk.create(ask(spark, (90, "Old", "k")), empty(spark))
    old_id = old.first().booking_id
    calls = [
        (1, "search_flights", '{"query": "x", "origin": "LGA"}'), (2, "search_flights", '{"query": "x", "origin": "ZZZ", "limit": 1}'),
        (3, "search_flights", '{"query": "none"}'), (4, "get_flight_details", '{"flight_id": "f2"}'), (5, "get_flight_details", '{"flight_id": "zz"}'),
        (6, "get_flight_details", ""), (7, "create_booking", '{"flight_id": "f1", "passenger_name": "Al"}'),
        (8, "create_booking", '{"flight_id": "f1", "passenger_name": " AL "}'), (9, "create_booking", '{"flight_id": "zz", "passenger_name": "A"}'),
        (10, "cancel_booking", json.dumps({"booking_id": old_id})), (11, "cancel_booking", '{"booking_id": "no"}'),
        (12, "get_booking", json.dumps({"booking_id": old_id})), (13, "get_booking", '{"booking_id": "no"}'), (14, "fly", '{"a": 1}'),
        (15, "get_booking", "no json")]
    df = spark.createDataFrame([(*c, T0 + timedelta(minutes=c[0])) for c in calls], "request_id int, tool string, args_text string, requested_at timestamp_ntz")
    embed = lambda q: F.when(q == "none", F.array(F.lit(-1.0), F.lit(0.0))).otherwise(F.array(F.lit(1.0), F.lit(0.0)))
    answers, appended = rq.answer_requests(df, records, old, embed=embed)
    got = {r.request_id: (r.type, r.error, json.loads(r.data)) for r in answers.collect()}
    assert len(got) == 15
    assert [h["flight_id"] for h in got[1][2]["results"]] == ["f2"] and got[1][2]["filters_dropped"] is False
    assert [h["flight_id"] for h in got[2][2]["results"]] == ["f1"] and got[2][2]["filters_dropped"] is True
    assert set(got[1][2]["results"][0]) == {"flight_id", "score", *HIT_FIELDS} and got[1][2]["results"][0]["dep_time"] is None
    assert got[3] == ("search_results", None, {"results": [], "filters_dropped": False})
    assert got[4] == ("flight_details", None, {"flight": {"flight_id": "f2", **flight, "origin": "LGA"}})
    assert got[5] == ("flight_details", "FLIGHT_NOT_FOUND", {"error": "FLIGHT_NOT_FOUND", "flight_id": "zz"})
    assert got[6] == ("flight_details", "MISSING_FLIGHT_ID", {"error": "MISSING_FLIGHT_ID"})
    first, second = got[7][2]["booking"], got[8][2]["booking"]
    assert first == second and got[7][0] == "booking_confirmation" and first["passenger_name"] == "Al" and first["status"] == "CONFIRMED"
    assert first["flight_snapshot"]["origin"] == "ATL" and first["flight_snapshot"]["dep_time"] is None
    assert got[9] == ("error", "FLIGHT_NOT_FOUND", {"error": "FLIGHT_NOT_FOUND", "flight_id": "zz", "message": rq.UNKNOWN_FLIGHT})
    assert got[10][2]["result"] == {"booking_id": old_id, "status": "CANCELLED", "updated_at": "2024-01-01T00:10:00+00:00"}
    assert got[11] == ("cancel_result", "BOOKING_NOT_FOUND", {"error": "BOOKING_NOT_FOUND", "booking_id": "no"})
    assert got[12][2]["booking"]["status"] == "CONFIRMED" and got[12][2]["booking"]["flight_snapshot"]["carrier"] == "DL"
    assert got[13] == ("booking", "BOOKING_NOT_FOUND", {"error": "BOOKING_NOT_FOUND", "booking_id": "no"})
    assert got[14] == ("error", "UNKNOWN_TOOL", {"error": "UNKNOWN_TOOL", "tool_name": "fly"})
    assert got[15] == ("error", "MALFORMED_ARGS", {"error": "MALFORMED_ARGS", "tool": "get_booking"})
    assert sorted(r.status for r in appended.collect()) == ["CANCELLED", "CONFIRMED"]


def test_hot_keys_are_spread(spark):
    from recallgrid.operators.ranking import salted_join

    left = spark.range(6000).select("id", F.when(F.col("id") % 3 != 1, "hot").when(F.col("id") % 9 == 1, None).otherwise(F.col("id").cast("string")).alias("k"))
    right = spark.createDataFrame([("hot", 1), (None, 2), ("4", 3), ("other", 4)], "rk string, v int")
    keep = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = salted_join(left, right, "k", "rk", 8)
        got = {r.id: r.v for r in joined.collect()}
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", keep)
    assert got == {i: 1 if i % 3 != 1 else 2 if i % 9 == 1 else 3 if i == 4 else None for i in range(6000)}
    assert salted_join(left, right, "k", "rk", how="inner").count() == 4000 + 667 + 1
    assert max(sizes) <= 6000


def test_requests_are_worked_out_once(spark):
    """No filter or join of the answers computes a key, a text or a hash of the requests again."""
    req = spark.range(20).select(
        F.col("id").alias("request_id"), F.lit("f1").alias("flight_id"), F.reverse(F.col("id").cast("string")).alias("passenger_name"),
        F.lit(SNAP).alias("flight_snapshot_json"), F.when(F.col("id") > 2, F.soundex(F.col("id").cast("string"))).alias("idempotency_key"),
        F.lit(T0).cast("timestamp_ntz").alias("requested_at"))
    for df in bk.create(req, empty(spark)):
        text = df._jdf.queryExecution().optimizedPlan().toString()
        assert "reverse(" not in text and "soundex(" not in text


def test_equal_searches_are_one(spark, monkeypatch):
    given = []

    def pipeline(records, asked, **options):
        given.append(asked.count())
        return searched(records, asked, **options)

    searched = rq.search.search_pipeline
    monkeypatch.setattr(rq.search, "search_pipeline", pipeline)
    payload = ("f1", "DL", 7, "JFK", "LAX", 2024, 1, 1, 600, 700, 601, 701, 100, 60, "N1", [1.0, 0.0], "doc")
    records = spark.createDataFrame([payload], (
        "flight_id string, carrier string, flight int, origin string, dest string, year int, month int, day int, sched_dep_time int, "
        "sched_arr_time int, dep_time int, arr_time int, distance int, air_time int, tailnum string, embedding array<double>, doc string"))
    calls = spark.range(60).select(
        F.col("id").alias("request_id"), F.lit("search_flights").alias("tool"),
        F.concat(F.lit('{"query": "x", "limit": '), (F.col("id") % 2 + 1).cast("string"), F.lit("}")).alias("args_text"),
        F.lit(T0).cast("timestamp_ntz").alias("requested_at"))
    answers, _ = rq.answer_requests(calls, records, empty(spark), embed=lambda text: F.array(F.lit(1.0), F.lit(0.0)))
    rows = answers.collect()
    assert given == [2] and sorted(r.request_id for r in rows) == list(range(60))
    assert {(r.type, r.data.count('"flight_id":"f1"')) for r in rows} == {("search_results", 1)}
