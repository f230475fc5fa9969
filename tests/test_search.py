import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from recallgrid.operators import hooks, search
from recallgrid.operators.filters import FLIGHT_TERMS, Term, common_bounds, filter_column, matches
from recallgrid.operators.hooks import pair_scorer

random.seed(5)
RECORDS = [
    (f"r{i:03d}", [random.choice([-1.0, 0.0, 1.0, 2.0]) for _ in range(4)], random.choice(["JFK", "LGA", None]),
     random.choice(["DL", "UA"]), random.randint(1, 12), random.choice([0, 559, 560, 700, 2400, None]))
    for i in range(300)
] + [("zero", [0.0] * 4, "JFK", "DL", 1, 700), ("none", None, "JFK", "DL", 1, 700), ("short", [1.0], "JFK", "DL", 1, 700)]
REQUESTS = [
    (1, [1.0, 0.0, 0.5, 1.0], None, "", None, None, None, 5, 0.3),
    (2, [0.0, 1.0, -1.0, 2.0], "jfk", None, None, None, None, 7, -1.0),
    (3, [2.0, 1.0, 1.0, 0.0], "LGA", "dl", 3, 9, None, 4, None),
    (4, [1.0, 1.0, 1.0, 1.0], None, None, None, None, "morning", 3, 0.0),
    (5, [1.0, 1.0, 0.0, 1.0], None, None, 8, 2, None, 3, 0.0),       # empty month range
    (6, [1.0, 0.0, 0.0, 1.0], None, None, None, None, "whenever", 2, 0.9),
    (7, [0.0, 0.0, 0.0, 0.0], None, None, None, None, None, 2, 0.0),  # no direction
    (8, [1.0, 2.0, 0.0, 1.0], "XXX", None, None, None, None, 1000, 0.5),
]
TERMS = [Term("keyword", "origin", "origin"), Term("keyword", "carrier", "carrier"), Term("at_least", "month_min", "month"),
         Term("at_most", "month_max", "month"), Term("band", "time_of_day", "sched")]


@pytest.fixture(scope="module")
def tables(spark):
    records = spark.createDataFrame(RECORDS, "id string, embedding array<double>, origin string, carrier string, month int, sched int")
    requests = spark.createDataFrame(REQUESTS, "query_id int, embedding array<double>, origin string, carrier string, "
                                     "month_min int, month_max int, time_of_day string, k int, floor double")
    return records.repartition(3), requests


def brute(filtered=True):
    out = {}
    for qid, qv, origin, carrier, lo, hi, band, k, floor in REQUESTS:
        q = np.array(qv)
        hits = []
        for rid, rv, ro, rc, rm, rs in RECORDS:
            if rv is None or len(rv) != 4 or not any(rv) or not q.any():
                continue
            if filtered:
                if origin and ro != origin.upper() or carrier and rc != carrier.upper():
                    continue
                if lo is not None and rm < lo or hi is not None and rm > hi:
                    continue
                if band == "morning" and not (rs is not None and 600 <= rs <= 1159):
                    continue
            s = round(float(np.array(rv) @ q / np.linalg.norm(rv) / np.linalg.norm(q)), 6)
            if floor is None or s >= floor:
                hits.append((-s, rid))
        out[qid] = [(r, i, -s) for r, (s, i) in enumerate(sorted(hits)[:k], 1)]
    return {q: h for q, h in out.items() if h}


def as_dict(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r["rank"], r.id, r.score))
    return out


@pytest.mark.parametrize("cells", [search.BLOCK_CELLS, 20, 4], ids=["one block", "some blocks", "many blocks"])
def test_search_equals_brute_force(tables, cells):
    got = search.vector_search(*tables, k="k", threshold="floor", terms=TERMS, id_col="id", block_cells=cells)
    assert as_dict(got) == brute()


@pytest.mark.parametrize("held", [1, 700, 10_000])
def test_score_slices_change_nothing(held, monkeypatch):
    rng = np.random.default_rng(1)
    unit, asked, members = rng.normal(size=(300, 4)), rng.normal(size=(9, 4)), np.array([0, 2, 3, 7, 8])
    monkeypatch.setattr(search, "_SCORES", held)
    got = dict(search._scores(unit, asked, members))
    assert sorted(got) == members.tolist()
    assert all(np.array_equal(got[r], np.round(unit @ asked[r], 6)) for r in members)


def test_wrong_dimension_fails(tables, spark):
    records, requests = tables
    three = spark.createDataFrame([(1, [1.0, 0.0, 2.0])], "query_id int, embedding array<double>")
    with pytest.raises(Exception, match="requests have 3 dimensions, records 4"):
        search.vector_search(records.coalesce(1), three, id_col="id").collect()
    with pytest.raises(ValueError, match="different dimensions"):
        search.vector_search(records, requests.select("query_id", "embedding").unionByName(three), id_col="id")


def test_null_limit_is_the_default(tables):
    records, requests = tables
    asked = requests.filter("query_id = 1").withColumn("k", F.lit(None).cast("int"))
    assert search.vector_search(records, asked, k="k", threshold=None, id_col="id").count() == search.DEFAULT_LIMIT


def test_pipeline_is_its_stages(spark, tables):
    records, _ = tables
    rows = [(1, "a", "JFK", 3), (2, "b", "XXX", None), (3, "a", None, 50)]
    asked = spark.createDataFrame(rows, "query_id int, query string, origin string, limit int")
    calls = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def model(q):
        calls.add(1)
        return q + q

    vector = lambda q: F.when(q == "aa", F.array(*map(F.lit, (1.0, 0.0, 0.5, 1.0)))).otherwise(F.array(*map(F.lit, (0.0, 1.0, -1.0, 2.0))))
    told = records.withColumn("doc", F.concat("origin", F.lit(" "), "carrier"))
    options = dict(embed=vector, generate=model, terms=TERMS[:2], threshold=0.3, fields=["origin", "month"], id_col="id")
    plain = search.search_pipeline(told, asked, **options)
    assert calls.value == 2  # once for each text
    got = as_dict(plain)
    by_hand = asked.withColumn("embedding", vector(F.concat("query", "query"))).withColumn("carrier", F.lit(None).cast("string"))
    want = as_dict(search.search_with_fallback(told, by_hand, terms=TERMS[:2], k="limit", threshold=0.3, id_col="id"))
    assert got == want and [len(got[q]) for q in (1, 2, 3)] == [3, 10, 50]
    assert {r.query_id for r in plain.filter("filters_dropped").collect()} == {2}
    assert plain.columns == ["query_id", "rank", "id", "score", "filters_dropped", "origin", "month"]
    ranked = search.search_pipeline(told, asked, scorer=lambda q, d: F.length(d).cast("double"), **options).collect()
    assert sorted((r.query_id, r["rank"]) for r in ranked) == [(q, r) for q, n in ((1, 3), (2, 5), (3, 5)) for r in range(1, n + 1)]
    text = plain._jdf.queryExecution().executedPlan().toString()
    assert text.split("Initial Plan")[-1].count("MapInArrow") == 1


def test_fallback(tables):
    records, requests = tables
    got = search.search_with_fallback(records, requests, terms=TERMS, k="k", threshold="floor", id_col="id")
    want, plain = brute(), brute(filtered=False)
    for q in (5, 8):
        want[q] = plain[q]
    assert as_dict(got) == want
    flags = {r.query_id: r.filters_dropped for r in got.collect()}
    assert [q for q, dropped in flags.items() if dropped] and {q for q, dropped in flags.items() if dropped} == {5, 8}
    answers = {r.query_id: (r.n_results, r.filters_dropped) for r in search.search_responses(requests, got, TERMS).collect()}
    assert answers[7] == (0, False) and answers[5][1] and len(answers) == 8


def test_no_requests(tables, spark):
    records, requests = tables
    assert search.vector_search(records, requests.limit(0), id_col="id").count() == 0


def test_literal_filters(spark):
    assert filter_column({}) is None and filter_column({"origin": "", "time_of_day": "whenever"}) is None
    rows = spark.createDataFrame(
        [(1, "JFK", 2013, 6, 600), (2, "JFK", 2013, 12, 1159), (3, "JFK", 2013, 5, 700), (4, "JFK", 2013, 7, 1160),
         (5, "LGA", 2013, 7, 700), (6, None, 2013, 7, 700), (7, "JFK", 2013, 7, None), (8, "JFK", 2014, 7, 700)],
        "id int, origin string, year int, month int, sched_dep_time int")
    wanted = {"origin": "jfk", "month_min": 6, "time_of_day": "morning", "year": 2013, "carrier": ""}
    assert sorted(r.id for r in rows.filter(filter_column(wanted)).collect()) == [1, 2]
    assert len([t for t in FLIGHT_TERMS if t.kind == "integer"]) == 4


def test_common_bounds():
    terms = [Term("integer", "label", "label"), Term("at_least", "lo", "m")]
    text = str(common_bounds([{"label": 1, "lo": 4}, {"label": 3, "lo": 2}], terms))
    assert "in(label, 1, 3)" in text.replace("IN", "in") and ">=(m, 2)" in text
    assert common_bounds([{"label": None, "lo": 4}, {"label": 3, "lo": None}], terms) is None


def test_filter_reaches_the_scan(tables, tmp_path, spark):
    records, requests = tables
    records.write.parquet(str(tmp_path / "r"))
    only = requests.filter("query_id in (2, 3, 8)").drop("carrier").withColumn("carrier", F.lit(None).cast("string"))
    plan = search.vector_search(spark.read.parquet(str(tmp_path / "r")), only, terms=TERMS, id_col="id")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(origin, [JFK,LGA,XXX])" in text
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_matches(spark):
    df = spark.createDataFrame([("jfk", "JFK"), ("", None), (None, "X"), ("LGA", None)], "want string, have string")
    got = [r[0] for r in df.select(matches({"o": F.col("want")}, {"o": F.col("have")})).collect()]
    assert got == [True, True, True, False]


def test_rerank_is_stable_and_uses_hooks(spark):
    rows = [(1, 1, "a", "red cat"), (1, 2, "b", "red dog"), (1, 3, "c", "blue"), (2, 1, "d", "none")]
    df = spark.createDataFrame(rows, "query_id int, rank int, id string, doc string").withColumn("query", F.lit("red"))
    got = search.rerank(df, lambda q, d: d.contains(q).cast("double"), 2)
    assert sorted((r.query_id, r.rerank, r.id) for r in got.collect()) == [(1, 1, "a"), (1, 2, "b"), (2, 1, "d")]
    by_length = pair_scorer(lambda: lambda qs, ds: [float(-len(d)) for d in ds])
    assert search.rerank(df, by_length, 1).filter("query_id = 1").first().id == "c"


def test_lookup_by_id(spark):
    ask = spark.createDataFrame([("a",), ("",), (None,), ("x",)], "flight_id string")
    have = spark.createDataFrame([("a", 1)], "flight_id string, n int")
    got = {r.flight_id: (r.n, r.error) for r in search.by_id(ask, have).collect()}
    assert got == {"a": (1, None), "": (None, "MISSING_FLIGHT_ID"), None: (None, "MISSING_FLIGHT_ID"), "x": (None, "FLIGHT_NOT_FOUND")}


def test_generate_once_calls_model_per_distinct_text(spark):
    calls = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def make(q):
        calls.add(1)
        return None if q == "bad" else q.upper()

    df = spark.createDataFrame([(i, q) for i, q in enumerate(["a", "b", "a", "a", "bad"])], "i int, query string")
    got = sorted(tuple(r) for r in search.generate_once(df, make).select("i", "generated").collect())
    assert got == [(0, "A"), (1, "B"), (2, "A"), (3, "A"), (4, "bad")] and calls.value == 3


def test_approximate_search_finds_only_exact_scores(tables):
    records, requests = tables
    good = records.filter(F.size("embedding") == 4)
    exact = as_dict(search.vector_search(good, requests, k=1000, threshold=None, id_col="id"))
    near = as_dict(search.approximate_search(good, requests, bits=3, dim=4, k=1000, threshold=None, id_col="id"))
    for q, hits in near.items():
        assert {h[1:] for h in hits} <= {h[1:] for h in exact[q]} and len(hits) > len(exact[q]) // 4


def test_generate_once_keeps_null_queries(spark):
    df = spark.createDataFrame([(1, None), (2, "a"), (3, None)], "i int, query string")
    got = sorted(tuple(r) for r in search.generate_once(df, lambda q: F.upper(q)).select("i", "generated").collect())
    assert got == [(1, None), (2, "A"), (3, None)]


@pytest.mark.parametrize("kind", ["int64", "string"])
def test_ties_do_not_leave_the_task(kind, monkeypatch):
    """Of records with one score, a batch hands on the k with the smallest ids; kept texts go out in bounded parts."""
    order = np.random.default_rng(0).permutation(1000)
    ids = pa.array([None if i == 5 else f"r{i:04d}" if kind == "string" else int(i) for i in order])
    batch = pa.RecordBatch.from_arrays(
        [ids, pa.array(["x" * 100] * 1000), pa.array([[1.0, 0.0]] * 1000)], names=["id", "doc", "embedding"])
    req = search._Requests([1, 2], np.array([[1.0, 0.0], [0.6, 0.8]]), np.array([3, 2]), np.array([-np.inf, 0.5]), [((), np.array([0, 1]))], None)
    monkeypatch.setattr(search, "_OUT_BYTES", 300)
    parts = list(search._score_batches(iter([batch]), req, [], "embedding", ["id", "doc"], True))
    rows = [(int(q), i) for which, _, taken in parts for q, i in zip(which, taken.column("id").to_pylist())]
    name = (lambda i: f"r{i:04d}") if kind == "string" else int
    assert sorted(rows, key=repr) == sorted([(0, None), (0, name(0)), (0, name(1)), (1, None), (1, name(0))], key=repr)
    assert max(taken.num_rows for _, _, taken in parts) <= 3


def test_texts_are_embedded_in_bounded_slices(spark):
    texts = pa.array(["a" * 6, None, "", "b" * 6, "c" * 50, "d"])
    runs = [s.to_pylist() for s in hooks.slices(texts, 10)]
    assert [t for run in runs for t in run] == texts.to_pylist()
    assert all(sum(len(t or "") for t in run[1:]) < 10 for run in runs) and len(runs) >= 3
    assert [len(s) for s in hooks.slices(pa.array([], "string"), 10)] == [0]
    # Across slices, the vectors are those of each text alone.
    words = ["one two", None, "three " * 400_000, "", "two " * 300_000, "one"]
    df = spark.createDataFrame(list(enumerate(words)), "id int, t string").coalesce(1)
    got = {r.id: list(r.e) for r in df.select("id", hooks.hash_embedding(8)("t").alias("e")).collect()}
    assert got[0] != got[1] == got[3] == [0.0] * 8 and sum(map(abs, got[2])) == 400_000 and sum(map(abs, got[4])) == 300_000
    assert [a + b / 300_000 for a, b in zip(got[5], got[4])] == got[0]
