import uuid

import pytest
from pyspark.sql import functions as F

from recallgrid.functions import jsons, text, vectors
from recallgrid.functions.ids import booking_key, record_id
from recallgrid.operators.hooks import HookError, embed_batch, embedder, hash_embedding

GOLDEN_IDS = {
    (3, 18, 1700): "faec0441-e01d-5c06-8b44-d13c8d4b83e0",
    (11, 11, 1730): "ac074b78-c6fe-5637-9dac-b124b87e4ba2",
    (3, 11, 1700): "1df7ef3d-a496-5f64-8abf-40012418ca2f",
    (4, 2, 1700): "cc1bbf61-77aa-5e16-802f-d6d9ee7ea53e",
    (7, 5, 1700): "0592ff52-1bea-5b9b-a72b-534481eb83cc",
    (4, 7, 1700): "f6b202a3-9e9e-5ada-a8ac-967c91724592",
}


def one(spark, *cols, **values):
    schema = ", ".join(f"{k} {'int' if isinstance(v, int) else 'double' if isinstance(v, float) else 'string'}"
                       for k, v in values.items()) or "x int"
    row = tuple(values.values()) or (1,)
    return tuple(spark.createDataFrame([row], schema).select(*cols).first())


def test_record_ids(spark):
    rows = [(2013, m, d, "DL", 1499, "LGA", "ATL", s) for m, d, s in GOLDEN_IDS] + [(2023, 6, 15, "DL", 100, "ATL", "JFK", None)]
    df = spark.createDataFrame(rows, "year int, month int, day int, carrier string, flight int, origin string, dest string, sched_dep_time int")
    got = [r[0] for r in df.select(record_id()).collect()]
    assert got[:-1] == list(GOLDEN_IDS.values())
    assert got[-1] == str(uuid.uuid5(uuid.NAMESPACE_URL, "2023|6|15|DL|100|ATL|JFK|None"))


def test_booking_key_ignores_case_and_space(spark):
    names = ["Alice Smith", "  ALICE SMITH  ", "\t alice smith\n", "Bob"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r[0] for r in df.select(booking_key(F.lit("flight-abc"), F.col("n"))).collect()]
    assert got[:3] == ["979a8cb3-b4d4-5445-9fec-4344fd000332"] * 3 and got[3] != got[0]


def test_formats(spark):
    got = one(
        spark, text.clock(F.lit(1430)), text.clock(F.lit(5)), text.clock(F.lit(None)), text.clock(F.lit(None), "    "),
        text.miles(F.lit(12345)), text.miles(F.lit(None).cast("int")), text.short_id(F.lit("0123456789")),
        text.ymd(F.lit(2013), F.lit(1), F.lit(None).cast("int")), text.percent(F.lit(0.125)), text.percent(F.lit(0.874)),
        text.iso_timestamp(F.lit("2024-01-02 03:04:05").cast("timestamp_ntz")), text.text_or_none(F.lit(None)))
    assert got == ("14:30", "00:05", "—", "    ", "12,345 mi", "—", "01234567…", "2013-01-00", "12%", "87%",
                   "2024-01-02T03:04:05+00:00", "None")


def test_time_bands(spark):
    df = spark.createDataFrame([(x,) for x in (0, 559, 560, 600, 1159, 1759, 1800, 2200, 2359, 2400, None)], "x int")
    assert [r[0] for r in df.select(text.time_band(F.col("x"))).collect()] == [
        "early_morning", "early_morning", None, "morning", "morning", "afternoon", "evening", "late_night", "late_night",
        None, None]


@pytest.mark.parametrize("raw, want", [
    ("  \n", "q"), (None, "q"), ("intro\n  DL Delta flight 7 LGA -> ATL  \nend", "DL Delta flight 7 LGA -> ATL"),
    ("a -> b\nlast line ", "last line"), ("x\r\ny", "y"), ("one\x0btwo", "two"),
])
def test_pick_line(spark, raw, want):
    df = spark.createDataFrame([(raw,)], "raw string")
    assert df.select(text.pick_line(F.col("raw"), F.lit("q"))).first()[0] == want


def test_record_shape(spark):
    canonical = "DL Delta Air Lines flight 1047 LGA LaGuardia to ATL Atlanta 2013-1-1"
    got = one(spark, text.record_status(F.lit("LGA -> ATL 1047"), F.lit("q")), text.record_status(F.lit(canonical), F.lit("q")),
              text.record_status(F.lit(canonical), F.lit("q"), True), text.record_status(F.lit("q"), F.lit("q")),
              text.with_route(F.lit("m"), F.lit("JFK"), F.lit("")), text.with_route(F.lit("m"), F.lit(None), F.lit(None)))
    assert got == ("PASS", "WEAK", "PASS", "FALLBACK", "m (from JFK)", "m")


@pytest.mark.parametrize("raw, want", [
    ('{"flight_id": "abc-123"}', '{"flight_id":"abc-123"}'), ("not json at all", "{}"),
    ('sure: {"query": "x", "origin": "JFK"} ok', '{"origin":"JFK","query":"x"}'),
    ('```json\n{"a":\n 1}\n```', '{"a":1}'), ("", "{}"), (None, "{}"), ("[1, 2]", "[1,2]"),
    ('{"a": 1} and {"b": 2}', "{}"), ('x {"a": {"b": 1}} y', '{"a":{"b":1}}'), ('{"a": 1}, {"b": 2}', "{}"), ("null", "null"),
])
def test_json_recovery(spark, raw, want):
    df = spark.createDataFrame([(raw,)], "raw string")
    assert df.select(F.to_json(jsons.recover(F.col("raw")))).first()[0] == want


def test_json_object_only(spark):
    df = spark.createDataFrame([('{"a": 1}',), ("[1]",), ("",), (None,), ("oops",)], "s string")
    assert [r[0] for r in df.select(F.to_json(jsons.parse_object(F.col("s")))).collect()] == ['{"a":1}', "{}", "{}", "{}", "{}"]


def test_cosine_of_zero_vector_is_null(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    got = [r[0] for r in df.select(vectors.cosine(F.col("a"), F.col("b"))).collect()]
    assert got[0] == pytest.approx(2 ** -0.5) and got[1] is None


def test_check_dimension(spark):
    df = spark.createDataFrame([([1.0, 2.0],)], "v array<double>")
    assert df.select(vectors.check_dimension(F.col("v"), 2)).first()[0] == [1.0, 2.0]
    with pytest.raises(Exception, match="expected 3 dimensions, got 2"):
        df.select(vectors.check_dimension(F.col("v"), 3)).collect()


def test_hash_embedding_counts_words(spark):
    df = spark.createDataFrame([(1, "Red red, RED"), (2, ""), (3, None), (4, "red")], "i int, t string")
    got = {r[0]: r[1] for r in df.select("i", hash_embedding(8)(F.col("t"))).collect()}
    assert sum(abs(x) for x in got[1]) == 3 and got[2] == got[3] == [0.0] * 8
    assert [3 * x for x in got[4]] == got[1]


def test_embedder_falls_back_to_single_texts():
    def short(texts):
        return [[float(len(t))] for t in texts] if len(texts) == 1 else [[0.0]]

    assert embed_batch(short, ["a", "bcd"]) == [[1.0], [3.0]]
    with pytest.raises(HookError):
        embed_batch(lambda texts: None, ["a"])


def test_embedder_column(spark):
    df = spark.createDataFrame([("a",), ("bcd",)], "t string")
    got = df.select(embedder(lambda: lambda ts: [[len(t), 1] for t in ts])(F.col("t")).alias("v")).collect()
    assert [r.v for r in got] == [[1.0, 1.0], [3.0, 1.0]]


def test_an_id_in_a_condition_hashes_once(spark):
    """Spark shares nothing inside a condition, so the expression may mention its name only once."""
    df = spark.range(50).select("id", F.when(F.col("id") > 1, record_id(F.col("id"))).alias("u"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("sha1(") == 1
    assert {r.id: r.u for r in df.collect()} == {i: str(uuid.uuid5(uuid.NAMESPACE_URL, str(i))) if i > 1 else None for i in range(50)}
