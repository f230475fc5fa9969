import math
import random
import time

import pytest
from pyspark.sql import functions as F

from recallgrid.operators import evaluation as ev
from recallgrid.operators import percentiles
from recallgrid.operators.percentiles import exact_percentiles, stage_summary
from recallgrid.session import write_out

random.seed(11)
HITS = {q: sorted(random.sample(range(60), random.choice([0, 1, 6, 10])), key=lambda i: (q * 7 + i * 13) % 61) for q in range(12)}
SCORES = {q: sorted((round(random.uniform(0, 1), 3) for _ in h), reverse=True) for q, h in HITS.items()}
EXPECTED = {q: random.sample(range(60), random.choice([1, 5, 20])) for q in range(12)}


@pytest.fixture(scope="module")
def tables(spark):
    hits = spark.createDataFrame([(q, r, i, SCORES[q][r - 1]) for q, h in HITS.items() for r, i in enumerate(h, 1)],
                                 "query_id int, rank int, id int, score double")
    expected = spark.createDataFrame([(q, i) for q, e in EXPECTED.items() for i in e + e[:1]], "query_id int, id int")
    return hits, expected


def metrics(q, floor=-1.0):
    got = [i for i, s in zip(HITS[q], SCORES[q]) if s >= floor]
    want = set(EXPECTED[q])
    found = [i for i in got if i in want]
    rank = next((r for r, i in enumerate(got, 1) if i in want), None)
    return (len(got), len(found), len(found) / len(want), len(found) / len(got) if got else 0.0, 1 / rank if rank else 0.0)


def test_metrics_by_ids(tables):
    hits, expected = tables
    rows = ev.query_metrics(ev.expected_counts(expected, "id"), ev.mark_expected(hits, expected, "id"), ev.recall_by_ids()).collect()
    assert len(rows) == 12
    for r in rows:
        assert (r.n_returned, r.n_relevant, r.recall_at_k, r.precision_at_k, r.mrr) == pytest.approx(metrics(r.query_id))
        assert r.hit == (r.n_relevant > 0)


def test_skipped_queries_have_null_metrics(spark, tables):
    hits, _ = tables
    queries = spark.createDataFrame([(q, q == 3) for q in range(12)], "query_id int, skipped boolean")
    m = ev.query_metrics(queries, hits.withColumn("relevant", F.lit(True)), ev.recall_by_filter(5))
    rows = {r.query_id: r for r in m.collect()}
    assert rows[3].hit is None and rows[3].mrr is None and rows[3].recall_at_k is None
    assert all(r.recall_at_k == min(len(HITS[q]) / 5, 1) for q, r in rows.items() if q != 3)
    s = ev.suite_summary(m).first()
    assert (s.n_scored, s.n_total) == (11, 12) and s.hit_rate == pytest.approx(sum(bool(HITS[q]) for q in range(12) if q != 3) / 11)


def test_threshold_sweep_equals_rerunning(tables):
    hits, expected = tables
    grid = ev.threshold_grid()
    assert grid[0] == 0.1 and grid[-1] == 0.7 and len(grid) == 13 and grid[3] == 0.25
    sweep = ev.threshold_sweep(ev.expected_counts(expected, "id"), ev.mark_expected(hits, expected, "id"), grid)
    rows = {r.threshold: r for r in sweep.collect()}
    assert sorted(rows) == grid
    for t, r in rows.items():
        each = [metrics(q, t) for q in range(12)]
        mean = [sum(c) / 12 for c in zip(*each)]
        assert (r.mean_returned, r.mean_recall, r.mean_precision, r.mean_mrr) == pytest.approx((mean[0], mean[2], mean[3], mean[4]))
    best = ev.best_threshold(sweep).first()
    f1 = {t: 2 * r.mean_recall * r.mean_precision / (r.mean_recall + r.mean_precision) for t, r in rows.items()
          if r.mean_recall + r.mean_precision}
    assert best.threshold == min(t for t in f1 if f1[t] == pytest.approx(max(f1.values())))


def test_gate_and_lift(spark):
    s = spark.createDataFrame([(3, 0.7, 0.4, 5000.0), (3, 0.69, 0.9, 1.0), (3, 0.9, 0.9, 5001.0), (0, None, None, 0.0)],
                              "n_scored int, hit_rate double, mean_mrr double, p95_ms double")
    assert [r.passed for r in ev.gate(s).collect()] == [True, False, False, False]
    for a, b, verdict in [(0.5, 0.6, "hurting"), (0.505, 0.5, "marginal"), (0.6, 0.5, "improving")]:
        m = spark.createDataFrame([("a", a, False), ("b", b, False), ("a", 0.0, True)], "v string, mrr double, skipped boolean")
        assert ev.lift(m, "v", "a", "b").first().verdict == verdict


def test_composite(spark):
    m = spark.createDataFrame([("x", 0.5, 100.0), ("y", 0.4, 0.0)], "model string, mean_mrr double, mean_rerank_ms double")
    got = [(r.model, round(r.composite, 6)) for r in ev.composite_ranking(m).collect()]
    assert got == [("y", 0.52), ("x", 0.4)]
    still = ev.composite_ranking(m.withColumn("mean_rerank_ms", F.lit(0.0))).first()
    assert still.composite == pytest.approx(0.6)


@pytest.mark.parametrize("rows", [20, 100, 4096])
def test_percentiles(spark, rows):
    groups = {"a": [10.0, 20.0, 35.0, 50.0], "b": [3.0], "c": [random.choice([1.0, 1e6, random.random()]) for _ in range(501)],
              "d": [5.0] * 40}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs] + [("a", None)], "g string, v double")
    probs = [0.0, 0.05, 0.5, 0.95, 1.0]
    got = {(r.g, r.prob): r.value for r in exact_percentiles(df, ["g"], "v", probs, rows).collect()}
    for g, vs in groups.items():
        vs = sorted(vs)
        for p in probs:
            at = p * (len(vs) - 1)
            lo, hi = int(at), min(int(at) + 1, len(vs) - 1)
            assert got[g, p] == pytest.approx(vs[lo] + (vs[hi] - vs[lo]) * (at - lo)), (g, p)


def test_percentile_slices_do_not_depend_on_the_spread_of_values(spark, monkeypatch):
    """Values over 300 orders of magnitude: no slice gets more than twice its share."""
    seen = {}

    def watch(df, name="stage"):
        out = write_out(df, name)
        seen[name] = out
        return out

    monkeypatch.setattr(percentiles, "write_out", watch)
    values = [math.exp(i / 8) for i in range(2000)] + [1e300]
    df = spark.createDataFrame([(None if v > 1e100 else "a", v) for v in values], "g string, v double")
    got = {(r.g, r.prob): r.value for r in exact_percentiles(df, ["g"], "v", [0.0, 0.5, 1.0], 100).collect()}
    apart = {g: sorted(v for v in values if (v > 1e100) == (g is None)) for g in ("a", None)}
    for g, vs in apart.items():
        mid = (len(vs) - 1) / 2
        assert got[g, 0.0] == vs[0] and got[g, 1.0] == vs[-1]
        assert got[g, 0.5] == pytest.approx((vs[math.floor(mid)] + vs[math.ceil(mid)]) / 2)
    sizes = [r["count"] for r in seen["ranges"].groupBy("_slice").count().collect()]
    assert len(sizes) >= 15 and max(sizes) <= 200


def test_percentile_examples(spark):
    df = spark.createDataFrame([("s", v) for v in (10.0, 20.0, 35.0, 50.0)] + [("t", None)], "stage string, v double")
    rows = {r.stage: r for r in stage_summary(df, ["stage"], "v").collect()}
    assert (rows["s"].p50, rows["s"].p95) == pytest.approx((27.5, 47.75)) and (rows["t"].p50, rows["t"].mean) == (0.0, 0.0)


def test_rank_select_and_merge(spark, tables):
    hits, _ = tables
    q = next(q for q, h in HITS.items() if len(h) == 10)
    answers = spark.createDataFrame([(q, "1 x 3 99 0 -1 10")], "query_id int, raw string")
    assert sorted(r.id for r in ev.select_ranks(answers, hits, "id").collect()) == sorted(HITS[q][i] for i in (0, 2, 9))
    old = spark.createDataFrame([("a", "n")], "query string, notes string")
    new = spark.createDataFrame([("a",), ("b",)], "query string")
    assert sorted((r.query, r.notes) for r in ev.merge_golden(old, new).collect()) == [("a", "n"), ("b", None)]
    assert ev.merge_golden(old, new, append=False).count() == 2


def test_models(spark):
    sets = spark.createDataFrame(
        [(1, "red", [(1, "p", 0.9, "blue sky"), (2, "q", 0.8, "red sky")]), (2, "x", None)],
        "query_id int, query string, candidates array<struct<rank:int,id:string,score:double,doc:string>>")
    models = {"first": lambda: lambda q, ds: [0.0] * len(ds), "match": lambda: lambda q, ds: [float(q in d) for d in ds]}
    ranked = ev.rerank_models(sets, models, "string", 1)
    assert {(r.model, r.query_id): r.id for r in ranked.collect()} == {
        ("first", 1): "p", ("first", 2): None, ("match", 1): "q", ("match", 2): None}
    expected = spark.createDataFrame([(1, "q"), (2, "z")], "query_id int, id string")
    got = {r.model: (r.n_scored, r.hit_rate, r.mean_mrr) for r in ev.model_summary(sets, ranked, expected).collect()}
    assert got == {"first": (2, 0.0, 0.0), "match": (2, 0.5, 0.5)}
    slow = {"slow": lambda: time.sleep(0.2) or (lambda q, ds: [0.0] * len(ds))}
    told = ev.model_summary(sets, ev.rerank_models(sets, slow, "string", 1), expected).first()
    assert told.load_ms >= 200 and told.p95_rerank_ms < 200
