"""Formatting, text and JSON functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from recallgrid.functions import jsons, text
from recallgrid.functions.ids import booking_key
from recallgrid.functions.vectors import cosine, norm
from recallgrid.operators.bookings import snapshot_json
from recallgrid.plans.registry import FLIGHTS_SQL, flights, query, table, uuid5_sql
from recallgrid.schema import NAMESPACE_DNS, SNAPSHOT_FIELDS, TIME_BANDS

_BAND_SQL = "CASE " + " ".join(f"WHEN x BETWEEN {lo} AND {hi} THEN '{n}'" for n, (lo, hi) in TIME_BANDS.items()) + " END"


@query("clock_band", f"""
SELECT event_id, x, printf('%02d:%02d', x // 100, x % 100) AS clock, {_BAND_SQL} AS band
FROM (SELECT event_id, CASE WHEN value < 1 THEN 2400 ELSE hour(ts) * 100 + minute(ts) END AS x FROM events)""")
def clock_band(spark, d):
    e = table(spark, d, "events").select(
        "event_id", F.when(F.col("value") < 1, 2400).otherwise(F.hour("ts") * 100 + F.minute("ts")).cast("long").alias("x"))
    return e.select("event_id", "x", text.clock(F.col("x")).alias("clock"), text.time_band(F.col("x")).alias("band"))


@query("text_format", """
SELECT o_orderkey, format('{:,}', CAST(floor(o_totalprice) AS BIGINT)) || ' mi' AS distance,
  substr(o_orderpriority || '-abcdefgh', 1, 8) || '…' AS short,
  printf('%d-%02d-%02d', year(o_orderdate), month(o_orderdate), day(o_orderdate)) AS ymd,
  CAST(CAST(round_even(o_orderkey % 201 / 200.0 * 100, 0) AS BIGINT) AS VARCHAR) || '%' AS share,
  substr(o_orderpriority, 1, 5) AS cut5,
  CASE WHEN o_orderstatus = 'F' THEN o_orderpriority
       WHEN o_orderstatus = 'O' THEN o_orderpriority || ' (from JFK to ' || o_custkey || ')'
       ELSE o_orderpriority || ' (to ' || o_custkey || ')' END AS routed
FROM orders""")
def text_format(spark, d):
    o = table(spark, d, "orders")
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    origin = F.when(status == "O", "JFK").otherwise(F.when(status == "F", ""))
    dest = F.when(status == "F", None).otherwise(F.col("o_custkey").cast("string"))
    return o.select(
        "o_orderkey", text.miles(F.floor("o_totalprice")).alias("distance"),
        text.short_id(F.concat(priority, F.lit("-abcdefgh"))).alias("short"),
        text.ymd(F.year("o_orderdate"), F.month("o_orderdate"), F.dayofmonth("o_orderdate")).alias("ymd"),
        text.percent(F.col("o_orderkey") % 201 / 200.0).alias("share"), text.cut(priority, 5).alias("cut5"),
        text.with_route(priority, origin, dest).alias("routed"))


@query("iso_timestamp", """
SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS iso FROM events""")
def iso_timestamp(spark, d):
    return table(spark, d, "events").select("event_id", text.iso_timestamp(F.col("ts")).alias("iso"))


_ARGS_SQL = """CASE event_type WHEN 'view' THEN props WHEN 'click' THEN 'I will call it with ' || props || ' now'
  WHEN 'error' THEN 'no arguments' WHEN 'signup' THEN '[1, 2]' ELSE props || ' and ' || props END"""


def _messy(spark, d):
    kind, props = F.col("event_type"), F.col("props")
    raw = F.when(kind == "view", props).when(
        kind == "click", F.concat(F.lit("I will call it with "), props, F.lit(" now"))).when(
        kind == "error", "no arguments").when(kind == "signup", "[1, 2]").otherwise(
        F.concat(props, F.lit(" and "), props))
    return table(spark, d, "events").select("event_id", raw.alias("raw"))


@query("json_recover", f"""
SELECT event_id, CASE WHEN json_valid(raw) THEN json_type(raw::JSON) ELSE 'OBJECT' END AS kind,
  CASE WHEN json_valid(raw) THEN CAST(json_extract_string(raw, '$.k') AS INT)
       WHEN json_valid(inner_text) THEN CAST(json_extract_string(inner_text, '$.k') AS INT) END AS k
FROM (SELECT event_id, raw, regexp_extract(raw, '(?s)\\{{.*\\}}') AS inner_text
  FROM (SELECT event_id, {_ARGS_SQL} AS raw FROM events))""")
def json_recover(spark, d):
    v = _messy(spark, d).withColumn("v", jsons.recover(F.col("raw")))
    return v.select("event_id", jsons.kind(F.col("v")).alias("kind"), jsons.int_field(F.col("v"), "k").alias("k"))


@query("json_object", f"""
SELECT event_id, CASE WHEN json_valid(raw) AND json_type(raw::JSON) = 'OBJECT'
  THEN CAST(json_extract_string(raw, '$.k') AS INT) END AS k FROM (SELECT event_id, {_ARGS_SQL} AS raw FROM events)""")
def json_object(spark, d):
    v = _messy(spark, d).withColumn("v", jsons.parse_object(F.col("raw")))
    return v.select("event_id", jsons.int_field(F.col("v"), "k").alias("k"))


@query("booking_key", f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, {uuid5_sql(NAMESPACE_DNS,
    "concat(l_orderkey, '|', lower(trim(n_name)))")} AS key
FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey""")
def booking_key_query(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    s = table(spark, d, "supplier").join(
        table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name")
    padded = F.concat(F.lit(" \t"), F.upper("n_name"), F.lit("\n "))
    return li.join(s, li.l_suppkey == s.s_suppkey).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
        booking_key(F.col("l_orderkey").cast("string"), padded).alias("key"))


_GENERATED_SQL = """CASE WHEN doc_id % 3 = 0 THEN text || chr(10) || '  DL Delta flight ' || doc_id || ' LGA -> ATL  ' || chr(10) || 'end'
  WHEN doc_id % 3 = 1 THEN text ELSE '' END"""


def _generated(spark, d):
    kind, t = F.col("doc_id") % 3, F.col("text")
    line = F.concat(F.lit("\n  DL Delta flight "), F.col("doc_id").cast("string"), F.lit(" LGA -> ATL  \nend"))
    raw = F.when(kind == 0, F.concat(t, line)).when(kind == 1, t).otherwise("")
    return table(spark, d, "documents").select(
        "doc_id", raw.alias("raw"), F.concat(F.lit("query "), F.col("doc_id").cast("string")).alias("query"))


@query("pick_line", f"""
WITH g AS (SELECT doc_id, list_transform(string_split(trim({_GENERATED_SQL}, chr(10) || ' '), chr(10)), lambda s: trim(s)) AS lines
  FROM documents)
SELECT doc_id, coalesce(list_filter(lines, lambda s: contains(s, '->') AND length(s) > 20)[1], nullif(lines[-1], ''),
  'query ' || doc_id) AS line FROM g""")
def pick_line(spark, d):
    return _generated(spark, d).select("doc_id", text.pick_line(F.col("raw"), F.col("query")).alias("line"))


@query("record_shape", f"""
WITH {FLIGHTS_SQL},
docs AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN concat(carrier, ' flight ', flight, ' ', origin, ' -> ', dest, ' dist ', distance)
   WHEN event_id % 3 = 1 THEN concat(carrier, ' flight ', distance, ' ', origin, ' town to ', dest, ' town') ELSE 'ask' END AS doc
  FROM flights),
m AS (SELECT *, regexp_matches(doc, '(?:\\([A-Z]{{3}}\\)|[A-Z]{{3}})\\s*-+>?\\s*.{{0,20}}(?:\\([A-Z]{{3}}\\)|[A-Z]{{3}})') AS strict,
    regexp_matches(doc, '(?:\\([A-Z]{{3}}\\)|[A-Z]{{3}})\\b.{{0,40}}? to (?:\\([A-Z]{{3}}\\)|[A-Z]{{3}})') AS loose,
    regexp_matches(doc, '[0-9]{{3,5}}') AS num FROM docs)
SELECT event_id, CASE WHEN doc = 'ask' THEN 'FALLBACK' WHEN strict AND num THEN 'PASS' ELSE 'WEAK' END AS status,
  CASE WHEN doc = 'ask' THEN 'FALLBACK' WHEN (strict OR loose) AND num THEN 'PASS' ELSE 'WEAK' END AS spelled_status FROM m""")
def record_shape(spark, d):
    docs = _record_docs(spark, d)
    return docs.select(
        "event_id", text.record_status(F.col("doc"), F.lit("ask")).alias("status"),
        text.record_status(F.col("doc"), F.lit("ask"), spelled_out=True).alias("spelled_status"))


def _record_docs(spark, d):
    kind = F.col("event_id") % 3
    s = lambda *parts: F.concat(*[F.col(p[1:]).cast("string") if p[0] == "$" else F.lit(p) for p in parts])
    doc = F.when(kind == 0, s("$carrier", " flight ", "$flight", " ", "$origin", " -> ", "$dest", " dist ", "$distance")).when(
        kind == 1, s("$carrier", " flight ", "$distance", " ", "$origin", " town to ", "$dest", " town")).otherwise("ask")
    return flights(table(spark, d, "events")).select("event_id", doc.alias("doc"), F.lit("ask").alias("query"))


@query("fallback_rate", f"""
WITH {FLIGHTS_SQL},
docs AS (SELECT CASE WHEN event_id % 3 = 0 THEN concat(carrier, ' flight ', flight, ' ', origin, ' -> ', dest, ' dist ', distance)
   WHEN event_id % 3 = 1 THEN concat(carrier, ' flight ', distance, ' ', origin, ' town to ', dest, ' town') ELSE 'ask' END AS doc
  FROM flights)
SELECT count(*) AS n, round(avg(CASE WHEN doc = 'ask' THEN 1.0 ELSE 0.0 END), 6) AS fallback_rate,
  count(*) FILTER (WHERE doc <> 'ask' AND regexp_matches(doc, '[0-9]{{3,5}}')
    AND regexp_matches(doc, '[A-Z]{{3}}\\s*-+>?\\s*.{{0,20}}[A-Z]{{3}}')) AS n_pass FROM docs""")
def fallback_rate(spark, d):
    from recallgrid.operators.evaluation import fallback_rate as rate

    out = rate(_record_docs(spark, d), "doc", "query", text.record_status(F.col("doc"), F.col("query")))
    return out.withColumn("fallback_rate", F.round("fallback_rate", 6))


@query("prompt_fill", """
SELECT item_id, replace('Find {query} in one line', '{query}', text) AS prompt FROM benchmark""")
def prompt_fill(spark, d):
    return table(spark, d, "benchmark").select(
        "item_id", text.fill_prompt(F.col("text"), "Find {query} in one line").alias("prompt"))


@query("cosine_pairs", """
SELECT e.vec_id, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(f.embedding AS DOUBLE[])), 6) AS score,
  round(sqrt(list_inner_product(CAST(e.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[]))), 6) AS norm
FROM embeddings e JOIN embeddings f ON f.vec_id = e.vec_id + 1""")
def cosine_pairs(spark, d):
    """Similarity of each vector to the next one."""
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(nxt, "vec_id").select(
        "vec_id", F.round(cosine(F.col("embedding"), F.col("other")), 6).alias("score"),
        F.round(norm(F.col("embedding")), 6).alias("norm"))


@query("snapshot_fields", f"""
WITH {FLIGHTS_SQL} SELECT event_id, carrier, flight, dest, distance, CAST(13 AS INT) AS n_fields FROM flights""")
def snapshot_fields(spark, d):
    """Snapshot as stored JSON, read back field by field (the id is not among the columns, so 13 of 14 keys)."""
    f = flights(table(spark, d, "events"))
    j = f.select("event_id", snapshot_json(f, list(SNAPSHOT_FIELDS)).alias("j"))
    v = j.select("event_id", F.parse_json("j").alias("v"), F.size(F.json_object_keys("j")).alias("n_fields"))
    get = lambda name, t: F.variant_get("v", f"$.{name}", t).alias(name)
    return v.select("event_id", get("carrier", "string"), get("flight", "int"), get("dest", "string"),
                    get("distance", "int"), "n_fields")
