import zipfile

import pytest
from pyspark.sql import functions as F

from recallgrid.operators import ingest, ranking, validate
from recallgrid.operators.hooks import hash_embedding
from recallgrid.schema import FLIGHT_ROW, GOLDEN_QUERY, PAYLOAD, seed_queries
from recallgrid.sources import records, tables

FULL = dict(year="2023", month="6", day="15", carrier="dl", flight="100", origin="atl", dest="jfk", sched_dep_time="800",
            sched_arr_time="1030", dep_time="810", arr_time="1045", distance="760", air_time="115", tailnum="N123DL")


def raw(spark, *changes):
    rows = [{**FULL, **c} for c in changes]
    return spark.createDataFrame([tuple(r[c] for c in FULL) for r in rows], ", ".join(f"{c} string" for c in FULL))


def test_valid_row(spark):
    row = validate.accepted(raw(spark, {})).first()
    assert (row.carrier, row.origin, row.dest, row.year, row.dep_time, row.tailnum) == ("DL", "ATL", "JFK", 2023, 810, "N123DL")
    assert set(row.asDict()) == set(FLIGHT_ROW.names)


@pytest.mark.parametrize("change, ok, ok_keep", [
    ({"dep_time": None}, False, True), ({"tailnum": None}, False, True), ({"carrier": None}, True, True),
    ({"year": None}, False, False), ({"flight": "12.0"}, True, True), ({"flight": "1.5"}, False, False),
    ({"distance": "abc"}, False, False), ({"flight": "99999999999"}, False, False), ({"month": " 7 "}, True, True),
])
def test_null_and_integer_rules(spark, change, ok, ok_keep):
    df = raw(spark, change)
    assert validate.accepted(df).count() == ok and validate.rejected(df).count() == (not ok)
    assert validate.accepted(df, null_policy="keep").count() == ok_keep
    assert validate.rejected(df, null_policy="keep").count() == (not ok_keep)


def test_null_code_becomes_nan(spark):
    assert validate.accepted(raw(spark, {"carrier": None})).first().carrier == "NAN"


def test_missing_columns(spark):
    optional = validate.accepted(raw(spark, {}).drop("dep_time", "tailnum")).first()
    assert optional.dep_time is None and optional.tailnum is None
    gone = raw(spark, {}).drop("carrier")
    assert validate.accepted(gone).count() == 0
    assert validate.rejected(gone).first().problems == ["carrier: missing"]


def test_reject_reasons(spark):
    row = validate.rejected(raw(spark, {"dep_time": None, "distance": "x"})).first()
    assert row.problems == ["dep_time: null", "distance: not an integer"]


def test_document(spark):
    df = validate.accepted(raw(spark, {}, {"carrier": "ZZ"}))
    docs = [r.doc for r in ingest.flight_document(df).collect()]
    assert docs[0] == ("DL Delta Air Lines flight 100 ATL Atlanta to JFK New York JFK 2023-6-15 sched 800->1030 "
                       "actual 810->1045 dist 760 air 115")
    assert docs[1].startswith("ZZ ZZ flight 100")


def test_empty_document(spark):
    df = spark.range(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in FLIGHT_ROW])
    assert ingest.flight_document(df).first().doc == (
        "  flight None   to   None-None-None sched None->None actual None->None dist None air None")


def test_dedup_and_rerun(spark, tmp_path):
    rows = validate.accepted(raw(spark, {}, {"dep_time": "811"}, {"flight": "7"}, {"flight": "8"}).withColumn(
        "pos", F.monotonically_increasing_id()), keep=["pos"])
    with_id = ingest.with_id(rows)
    stored = with_id.filter("flight = 8").select("flight_id")
    fresh = ingest.unseen(with_id, stored, position=["pos"])
    assert sorted((r.flight, r.dep_time) for r in fresh.collect()) == [(7, 810), (100, 811)]
    report = ingest.ingest_report(with_id.withColumn("ok", F.lit(True)), stored, "flight_id", F.col("ok")).first()
    assert tuple(report) == (4, 0, 1, 2)

    path = str(tmp_path / "index")
    ready = ingest.index_rows(rows, stored, hash_embedding(16), ["pos"])
    tables.create_index(spark, path, ready.schema)
    tables.append_index(ready, path, 16)
    again = ingest.index_rows(rows, tables.stored_ids(spark, path, ready.schema).unionByName(stored), hash_embedding(16), ["pos"])
    tables.append_index(again, path, 16)
    assert tables.read_index(spark, path, ready.schema).count() == 2
    with pytest.raises(Exception, match="expected 8 dimensions"):
        tables.append_index(ready, path, 8)


def test_head_rows(spark):
    df = spark.range(10)
    assert [r.id for r in ranking.head_rows(df, 3, "id").collect()] == [0, 1, 2]
    assert ranking.head_rows(df, 0, "id").count() == ranking.head_rows(df, None, "id").count() == 10


def test_csv_null_tokens_and_position(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text('carrier,origin,note\nDL,NA,"x, ""y"""\n#N/A,JFK,nan\nnull,N/A,ok\n')
    rows = records.read_csv(spark, str(p), position="pos").orderBy("pos").collect()
    assert [(r.carrier, r.origin, r.note) for r in rows] == [("DL", None, 'x, "y"'), (None, "JFK", None), (None, None, "ok")]


def test_zip_reads_first_csv(spark, tmp_path):
    for name in ("one", "two"):
        with zipfile.ZipFile(tmp_path / f"{name}.zip", "w") as z:
            z.writestr("notes.txt", "no")
            z.writestr("Rows.CSV", f"year,carrier,extra\n2013,{name},1\nNA,DL,2\n")
            z.writestr("later.csv", "year,carrier\n1,ZZ\n")
    rows = records.read_records(spark, str(tmp_path / "*.zip"), ["year", "carrier", "tailnum"]).collect()
    assert sorted((r.year or "", r.carrier, r.tailnum) for r in rows) == [
        ("", "DL", None), ("", "DL", None), ("2013", "one", None), ("2013", "two", None)]
    with zipfile.ZipFile(tmp_path / "bad.zip", "w") as z:
        z.writestr("a.txt", "x")
    with pytest.raises(Exception, match="no CSV in archive"):
        records.read_zip(spark, str(tmp_path / "bad.zip")).collect()


def test_archives_are_opened_where_they_lie(spark, tmp_path, monkeypatch):
    for name, n in (("one", 30_000), ("two words", 5)):
        with zipfile.ZipFile(tmp_path / f"{name}.zip", "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("rows.csv", "year,carrier\n" + "".join(f"{i},DL\n" for i in range(n)))
    df = records.read_zip(spark, str(tmp_path / "*.zip"), ["year"], chunk=1000)
    assert "content" not in df._jdf.queryExecution().optimizedPlan().toString().split("ReadSchema")[0].split("Relation")[0]
    got = df.groupBy("archive").agg(F.count("*").alias("n"), F.count_distinct("row_no").alias("m"), F.max("row_no").alias("last")).collect()
    assert sorted((r.n, r.m, r.last) for r in got) == [(5, 5, 4), (30_000, 30_000, 29_999)]
    monkeypatch.setattr(records, "_openable", lambda path: None)  # storage that only Spark can open
    held = records.read_zip(spark, str(tmp_path / "*.zip"), ["year"])
    assert held.count() == 30_005 and "content" in held._jdf.queryExecution().optimizedPlan().toString()


def test_golden_files(spark, tmp_path):
    seeds = seed_queries(spark)
    assert seeds.count() == 10 and seeds.schema == GOLDEN_QUERY
    path = str(tmp_path / "golden.jsonl")
    tables.write_golden(seeds, path)
    back = tables.read_golden(spark, path)
    assert {r.query: r.filters.dest for r in back.collect()}["Delta flight from LaGuardia to Atlanta"] == "ATL"
    many = str(tmp_path / "arrays")
    tables.write_golden_arrays(seeds, many, per_file=4)
    files = list((tmp_path / "arrays").glob("part=*/*.txt"))
    assert 2 <= len(files) <= 3 and all(f.read_text().startswith("[") and f.read_text().endswith("]\n") for f in files)
    assert sorted(map(str, tables.read_golden(spark, many).collect())) == sorted(map(str, seeds.collect()))
    tables.write_golden_arrays(seeds.limit(0), str(tmp_path / "none"))
    assert tables.read_golden(spark, str(tmp_path / "none")).count() == 0
    array = tmp_path / "set.json"
    array.write_text('[{"query": "a", "filters": {"origin": "JFK"}, "expected_flight_ids": ["x", "y"]},\n {"query": "b"}]')
    assert tables.expected_ids(tables.read_golden(spark, str(array))).count() == 2


def test_payload_columns(spark):
    df = validate.accepted(raw(spark, {})).withColumn("extra", F.lit(1))
    assert validate.payload(df).columns == list(PAYLOAD)


def test_every_spelling_of_a_whole_number(spark):
    rule = [validate.Rule("n", "integer")]
    df = spark.createDataFrame([(x,) for x in ("12", "12.0", "12.", "1e3", "1.5e1", " +7 ", "-0.0", "1.5", "1e-1", "abc", "3000000000", "2147483648.0")], "n string")
    assert [r.n for r in validate.accepted(df, rule).collect()] == [12, 12, 12, 1000, 15, 7, 0]
    assert [r.problems[0] for r in validate.rejected(df, rule).collect()] == ["n: not an integer"] * 3 + ["n: out of range"] * 2


def test_quoted_line_breaks_stay_in_their_field(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,note\n1,"two\nlines"\n2,plain\n')
    assert [tuple(r) for r in records.read_records(spark, str(tmp_path / "a.csv")).collect()] == [("1", "two\nlines"), ("2", "plain")]
