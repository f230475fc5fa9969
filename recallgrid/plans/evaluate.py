"""Retrieval evaluation over label centroids (ids known) and benchmark passages (filters known)."""

from __future__ import annotations

from pyspark.sql import functions as F

from recallgrid.operators import evaluation as ev, filters
from recallgrid.operators.percentiles import exact_percentiles, stage_summary
from recallgrid.operators.search import candidate_sets, vector_search
from recallgrid.plans.registry import query, table
from recallgrid.plans.retrieval import CENTROID_SQL, TEXT_SQL, label_centroids, label_hits, passage_hits, passages
from recallgrid.schema import SEED_QUERIES, seed_queries
from recallgrid.session import shared_path, write_out
from recallgrid.sources import tables

# Expected answers of a label: its vectors whose first coordinate is positive.
_MARKED_SQL = CENTROID_SQL + """,
expected AS (SELECT label AS query_id, vec_id FROM embeddings WHERE embedding[1] > 0),
n_exp AS (SELECT query_id, count(*) AS n_expected FROM expected GROUP BY query_id),
hits AS (SELECT r.*, e.vec_id IS NOT NULL AS relevant FROM ranked r LEFT JOIN expected e USING (query_id, vec_id))"""

_PER_QUERY_SQL = _MARKED_SQL + """,
m AS (SELECT query_id, n_expected, count(h.vec_id) AS n_returned, count(*) FILTER (WHERE h.relevant) AS n_relevant,
    coalesce(1.0 / min(h.rank) FILTER (WHERE h.relevant), 0.0) AS mrr
  FROM n_exp LEFT JOIN (SELECT * FROM hits WHERE rank <= 10) h USING (query_id) GROUP BY query_id, n_expected)"""


def _expected(spark, d):
    e = table(spark, d, "embeddings")
    return e.filter(F.element_at("embedding", 1) > 0).select(F.col("label").alias("query_id"), "vec_id")


def _label_queries(expected):
    return ev.expected_counts(expected, "vec_id")


def _label_metrics(spark, d, k=10):
    expected = _expected(spark, d)
    marked = ev.mark_expected(label_hits(spark, d, k), expected, "vec_id")
    return ev.query_metrics(_label_queries(expected), marked, ev.recall_by_ids())


def _rounded(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


@query("eval_metrics_ids", f"""
WITH {_PER_QUERY_SQL}
SELECT query_id, n_expected, n_returned, n_relevant, n_relevant > 0 AS hit, round(n_relevant / n_expected, 6) AS recall_at_k,
  round(n_relevant / n_returned, 6) AS precision_at_k, round(mrr, 6) AS mrr, false AS skipped FROM m""")
def eval_metrics_ids(spark, d):
    return _rounded(_label_metrics(spark, d), "recall_at_k", "precision_at_k", "mrr")


_FILTER_SQL = f"""
{TEXT_SQL},
h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank,
    upper(lang) = upper(want_lang) AS relevant FROM kept QUALIFY rank <= 10),
q AS (SELECT item_id AS query_id, item_id % 4 = 2 AS skipped FROM benchmark),
m AS (SELECT query_id, skipped, count(h.doc_id) AS n_returned,
    count(*) FILTER (WHERE NOT skipped AND h.relevant) AS n_relevant,
    coalesce(1.0 / min(h.rank) FILTER (WHERE h.relevant), 0.0) AS mrr
  FROM q LEFT JOIN h USING (query_id) GROUP BY query_id, skipped),
e AS (SELECT query_id, skipped, n_returned, n_relevant,
  CASE WHEN NOT skipped THEN n_relevant > 0 END AS hit,
  CASE WHEN NOT skipped THEN least(n_relevant / 10.0, 1.0) END AS recall_at_k,
  CASE WHEN NOT skipped THEN coalesce(n_relevant / nullif(n_returned, 0), 0) END AS precision_at_k,
  CASE WHEN NOT skipped THEN mrr END AS mrr FROM m)"""


def _passage_metrics(spark, d):
    asked = passages(spark, d).select("query_id", "want_lang")
    wanted = asked.withColumn("skipped", ~filters.scoreable(F.lit(0), F.col("want_lang")))
    hits = passage_hits(spark, d, 10).join(wanted, "query_id")
    match = filters.matches({"lang": F.col("want_lang")}, {"lang": F.col("lang_code")})
    marked = hits.withColumn("relevant", match & ~F.col("skipped"))
    return ev.query_metrics(wanted.select("query_id", "skipped"), marked, ev.recall_by_filter(10))


@query("eval_metrics_filter", f"""
WITH {_FILTER_SQL} SELECT query_id, skipped, n_returned, n_relevant, hit, round(recall_at_k, 6) AS recall_at_k,
  round(precision_at_k, 6) AS precision_at_k, round(mrr, 6) AS mrr FROM e""")
def eval_metrics_filter(spark, d):
    return _rounded(_passage_metrics(spark, d), "recall_at_k", "precision_at_k", "mrr")


_MEANS = ("hit_rate", "mean_recall", "mean_precision", "mean_mrr", "mean_returned")


@query("eval_summary", f"""
WITH {_FILTER_SQL} SELECT count(*) FILTER (WHERE NOT skipped) AS n_scored, count(*) AS n_total,
  round(avg(CAST(hit AS INT)), 6) AS hit_rate, round(avg(recall_at_k), 6) AS mean_recall,
  round(avg(precision_at_k), 6) AS mean_precision, round(avg(mrr), 6) AS mean_mrr,
  round(avg(n_returned) FILTER (WHERE NOT skipped), 6) AS mean_returned FROM e""")
def eval_summary(spark, d):
    return _rounded(ev.suite_summary(_passage_metrics(spark, d)), *_MEANS)


@query("metric_gate", f"""
WITH {_PER_QUERY_SQL},
s AS (SELECT count(*) AS n_scored, avg(CASE WHEN n_relevant > 0 THEN 1.0 ELSE 0.0 END) AS hit_rate, avg(mrr) AS mean_mrr FROM m),
l AS (SELECT quantile_cont(value, 0.95) AS p95_ms FROM events)
SELECT n_scored, round(hit_rate, 6) AS hit_rate, round(mean_mrr, 6) AS mean_mrr, round(p95_ms, 6) AS p95_ms,
  hit_rate >= 0.7 AND mean_mrr >= 0.4 AND p95_ms <= 40 AS passed FROM s, l""")
def metric_gate(spark, d):
    """Label search against the default gates, with the events table as its latency log."""
    p95 = exact_percentiles(table(spark, d, "events"), [], "value", [0.95]).select(F.col("value")).scalar()
    summary = ev.suite_summary(_label_metrics(spark, d)).withColumn("p95_ms", p95)
    return _rounded(ev.gate(summary, max_p95_ms=40.0).select("n_scored", "hit_rate", "mean_mrr", "p95_ms", "passed"),
                    "hit_rate", "mean_mrr", "p95_ms")


@query("ab_lift", f"""
WITH {_MARKED_SQL},
firsts AS (SELECT label AS query_id, arg_min(embedding, vec_id) AS qv FROM embeddings GROUP BY label),
fs AS (SELECT query_id, vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(qv AS DOUBLE[])), 6) AS score
  FROM firsts, embeddings),
fr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM fs QUALIFY rank <= 10),
t AS (SELECT query_id, coalesce(1.0 / min(rank) FILTER (WHERE relevant AND rank <= 10), 0.0) AS mrr FROM hits GROUP BY query_id),
c AS (SELECT fr.query_id, coalesce(1.0 / min(rank) FILTER (WHERE e.vec_id IS NOT NULL), 0.0) AS mrr
  FROM fr LEFT JOIN expected e USING (query_id, vec_id) GROUP BY fr.query_id),
b AS (SELECT (SELECT avg(mrr) FROM t) AS mt, (SELECT avg(mrr) FROM c) AS mc)
SELECT round(mt, 6) AS mrr_treated, round(mc, 6) AS mrr_control, round(mt - mc, 6) AS lift,
  CASE WHEN mt - mc < 0 THEN 'hurting' WHEN mt - mc < 0.01 THEN 'marginal' ELSE 'improving' END AS verdict FROM b""")
def ab_lift(spark, d):
    """Centroid of a label as the query, against its first vector."""
    e = table(spark, d, "embeddings")
    single = e.groupBy(F.col("label").alias("query_id")).agg(F.min_by("embedding", "vec_id").alias("embedding"))
    expected = _expected(spark, d)
    queries = _label_queries(expected)
    plain = vector_search(e, single, k=10, threshold=None, id_col="vec_id")
    control = ev.query_metrics(queries, ev.mark_expected(plain, expected, "vec_id"), ev.recall_by_ids())
    both = _label_metrics(spark, d).withColumn("variant", F.lit("centroid")).unionByName(
        control.withColumn("variant", F.lit("single")))
    return _rounded(ev.lift(both, "variant", "centroid", "single"), "mrr_treated", "mrr_control", "lift")


_SWEEP_SQL = _MARKED_SQL + """,
grid AS (SELECT round(0.1 + i * 0.05, 4) AS threshold FROM range(13) t(i)),
cut AS (SELECT g.threshold, n.query_id, n.n_expected, count(h.vec_id) AS n_returned,
    count(*) FILTER (WHERE h.relevant) AS n_relevant, coalesce(1.0 / min(h.rank) FILTER (WHERE h.relevant), 0.0) AS mrr
  FROM grid g CROSS JOIN n_exp n LEFT JOIN (SELECT * FROM hits WHERE rank <= 10) h
    ON h.query_id = n.query_id AND h.score >= g.threshold GROUP BY g.threshold, n.query_id, n.n_expected),
sweep AS (SELECT threshold, count(*) AS n_scored, avg(CASE WHEN n_relevant > 0 THEN 1.0 ELSE 0.0 END) AS hit_rate,
    avg(n_relevant / n_expected) AS mean_recall, avg(coalesce(n_relevant / nullif(n_returned, 0), 0)) AS mean_precision,
    avg(mrr) AS mean_mrr, avg(n_returned) AS mean_returned FROM cut GROUP BY threshold)"""


def _sweep(spark, d):
    expected = _expected(spark, d)
    grid = ev.threshold_grid()
    marked = ev.mark_expected(label_hits(spark, d, 10, min(grid)), expected, "vec_id")
    return ev.threshold_sweep(_label_queries(expected), marked, grid)


@query("threshold_sweep", f"""
WITH {_SWEEP_SQL} SELECT CAST(threshold AS DOUBLE) AS threshold, n_scored, round(hit_rate, 6) AS hit_rate,
  round(mean_recall, 6) AS mean_recall, round(mean_precision, 6) AS mean_precision, round(mean_mrr, 6) AS mean_mrr,
  round(mean_returned, 6) AS mean_returned FROM sweep""")
def threshold_sweep(spark, d):
    return _rounded(_sweep(spark, d), *_MEANS)


@query("best_threshold", f"""
WITH {_SWEEP_SQL},
f AS (SELECT *, round(coalesce(2 * mean_recall * mean_precision / nullif(mean_recall + mean_precision, 0), 0), 12) AS f1 FROM sweep)
SELECT CAST(threshold AS DOUBLE) AS threshold, round(f1, 6) AS f1, round(hit_rate, 6) AS hit_rate, round(mean_mrr, 6) AS mean_mrr
FROM f ORDER BY f.f1 DESC, f.threshold LIMIT 1""")
def best_threshold(spark, d):
    best = ev.best_threshold(_sweep(spark, d)).select("threshold", "f1", "hit_rate", "mean_mrr")
    return _rounded(best, "f1", "hit_rate", "mean_mrr")


@query("latency_percentiles", """
SELECT event_type AS stage, count(value) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50,
  round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY event_type""")
def latency_percentiles(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("stage"), "value")
    return _rounded(stage_summary(e, ["stage"], "value"), "mean", "p50", "p95")


@query("price_percentiles", """
SELECT l_returnflag, l_linestatus, CAST(unnest([0.0, 0.25, 0.5, 0.99, 1.0]) AS DOUBLE) AS prob,
  round(unnest(quantile_cont(l_extendedprice, [0.0, 0.25, 0.5, 0.99, 1.0])), 6) AS value
FROM lineitem GROUP BY l_returnflag, l_linestatus""")
def price_percentiles(spark, d):
    li = table(spark, d, "lineitem")
    probs = [0.0, 0.25, 0.5, 0.99, 1.0]
    return _rounded(exact_percentiles(li, ["l_returnflag", "l_linestatus"], "l_extendedprice", probs), "value")


@query("outlier_percentiles", """
WITH v AS (SELECT event_type, exp(value / 2) AS v FROM events UNION ALL SELECT 'view', 1e300)
SELECT event_type, CAST(unnest([0.0, 0.05, 0.5, 0.95, 1.0]) AS DOUBLE) AS prob,
  round(ln(unnest(quantile_cont(v, [0.0, 0.05, 0.5, 0.95, 1.0]))), 6) AS log_value
FROM v GROUP BY event_type""")
def outlier_percentiles(spark, d):
    """Values spread over many orders of magnitude, one far beyond the rest; in logarithms, to compare them."""
    e = table(spark, d, "events").select("event_type", F.exp(F.col("value") / 2).alias("v"))
    far = spark.range(1).select(F.lit("view").alias("event_type"), F.lit(1e300).alias("v"))
    at = exact_percentiles(e.unionByName(far), ["event_type"], "v", [0.0, 0.05, 0.5, 0.95, 1.0])
    return at.select("event_type", "prob", F.round(F.log("value"), 6).alias("log_value"))


@query("stage_totals", """
SELECT event_id, round(value + value * 2 + hour(ts), 6) AS total_ms FROM events""")
def stage_totals(spark, d):
    v = F.col("value")
    stages = F.create_map(F.lit("hyde_ms"), v, F.lit("search_ms"), v * 2, F.lit("rerank_ms"), F.hour("ts").cast("double"))
    return table(spark, d, "events").select("event_id", F.round(ev.stage_total(stages), 6).alias("total_ms"))


_MODELS_SQL = """
m AS (SELECT event_type AS model, avg(1.0 / (1 + CAST(json_extract_string(props, '$.k') AS INT))) AS mean_mrr,
    avg(value) AS mean_rerank_ms FROM events GROUP BY event_type),
c AS (SELECT *, 0.8 * mean_mrr + (1 - 0.8) * (1 - mean_rerank_ms / (SELECT max(mean_rerank_ms) FROM m)) AS composite FROM m)"""


def _models(spark, d):
    """Event types as models: value is the time, 1 / (1 + k) the reciprocal rank."""
    e = table(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    return e.groupBy(F.col("event_type").alias("model")).agg(
        F.avg(1.0 / (1 + k)).alias("mean_mrr"), F.avg("value").alias("mean_rerank_ms"))


@query("composite_rank", f"""
WITH {_MODELS_SQL} SELECT model, round(mean_mrr, 6) AS mean_mrr, round(mean_rerank_ms, 6) AS mean_rerank_ms,
  round(composite, 6) AS composite FROM c""")
def composite_rank(spark, d):
    return _rounded(ev.composite_ranking(_models(spark, d)), "mean_mrr", "mean_rerank_ms", "composite")


@query("report_json", f"""
WITH {_MODELS_SQL}, b AS (SELECT model FROM c ORDER BY composite DESC LIMIT 1)
SELECT CAST(5 AS INT) AS k, CAST(count(*) AS BIGINT) AS n_models, (SELECT model FROM b) AS best FROM c""")
def report_json(spark, d):
    """The report as written to a file and read back."""
    path = shared_path(spark, "report")
    tables.write_report(tables.report(ev.composite_ranking(_models(spark, d)), k=5, fetch_k=20, quality_weight=0.8), path)
    r = spark.read.text(path).select(F.parse_json("value").alias("v"))
    models = F.variant_get("v", "$.models", "array<variant>")
    return r.select(
        F.variant_get("v", "$.k", "int").alias("k"), F.size(models).cast("long").alias("n_models"),
        F.variant_get("v", "$.models[0].model", "string").alias("best"))


_WORDS_SQL = "[w for w in list_distinct(regexp_split_to_array({0}, '\\s+')) if w <> '']"


@query("model_compare", f"""
WITH {TEXT_SQL},
h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM kept QUALIFY rank <= 20),
t AS (SELECT h.query_id, h.doc_id, h.rank, h.query, d.text AS doc FROM h JOIN documents d USING (doc_id)),
s AS (SELECT *, 'overlap' AS model, len(list_intersect({_WORDS_SQL.format('query')}, {_WORDS_SQL.format('doc')})) AS points FROM t
  UNION ALL SELECT *, 'length', -abs(length(query) - length(doc)) FROM t),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, model ORDER BY points DESC, rank) AS place FROM s),
m AS (SELECT query_id, model, coalesce(max(1.0 / place) FILTER (WHERE rank <= 3 AND place <= 5), 0.0) AS mrr FROM r GROUP BY ALL)
SELECT model, count(*) AS n_scored, avg(CAST(mrr > 0 AS DOUBLE)) AS hit_rate, avg(CAST(mrr AS DOUBLE)) AS mean_mrr FROM m GROUP BY model""")
def model_compare(spark, d):
    """Two pair scorers over the same candidate sets. Their times differ from run to run and are left out here."""

    def overlap():
        return lambda q, docs: [len(set(q.split()) & set(x.split())) for x in docs]

    def length():
        return lambda q, docs: [-abs(len(q) - len(x)) for x in docs]

    hits = write_out(passage_hits(spark, d, 20, "doc"), "hits")
    asked = passages(spark, d).select("query_id", "query")
    sets = asked.join(candidate_sets(hits, "doc_id", "doc"), "query_id", "left")
    reranked = write_out(ev.rerank_models(sets, {"overlap": overlap, "length": length}, "long", 5), "reranked")
    expected = hits.filter(F.col("rank") <= 3).select("query_id", F.col("doc_id").alias("id"))
    summary = ev.model_summary(expected.select("query_id").distinct(), reranked, expected)
    return ev.composite_ranking(summary).select("model", "n_scored", "hit_rate", "mean_mrr")


@query("golden_merge", """
SELECT text AS query, 'old' AS notes FROM benchmark WHERE item_id % 3 <> 0
UNION ALL SELECT text, 'new' FROM benchmark WHERE text NOT IN (SELECT text FROM benchmark WHERE item_id % 3 <> 0)""")
def golden_merge(spark, d):
    b = table(spark, d, "benchmark")
    old = b.filter(F.col("item_id") % 3 != 0).select(F.col("text").alias("query"), F.lit("old").alias("notes"))
    new = b.select(F.col("text").alias("query"), F.lit("new").alias("notes"))
    return ev.merge_golden(old, new)


@query("golden_replace", "SELECT text AS query, 'new' AS notes FROM benchmark WHERE item_id % 2 = 0")
def golden_replace(spark, d):
    """Replace mode: entries annotated before are given up, also those of the same queries."""
    b = table(spark, d, "benchmark")
    old = b.select(F.col("text").alias("query"), F.lit("old").alias("notes"))
    new = b.filter(F.col("item_id") % 2 == 0).select(F.col("text").alias("query"), F.lit("new").alias("notes"))
    return ev.merge_golden(old, new, append=False)


@query("golden_source", f"""
WITH {TEXT_SQL},
h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM kept QUALIFY rank <= 3)
SELECT query, CAST(doc_id AS VARCHAR) AS flight_id FROM h""")
def golden_source(spark, d):
    """Golden entries with their three best documents as expected ids, written as JSON and read back."""
    hits = passage_hits(spark, d, 3).groupBy("query_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))), lambda h: h["doc_id"].cast("string"))
        .alias("expected_flight_ids"))
    entries = passages(spark, d).join(hits, "query_id").select("query", F.struct(
        F.lit(None).cast("string").alias("carrier"), F.col("want_lang").alias("origin"),
        F.lit(None).cast("string").alias("dest")).alias("filters"), "expected_flight_ids")
    path = shared_path(spark, "golden") + ".jsonl"
    tables.write_golden(entries, path)
    return tables.expected_ids(tables.read_golden(spark, path))


_SEEDS_SQL = ", ".join(f"('{q}', '{c}', '{o}', '{x}')" for q, c, o, x in SEED_QUERIES)


@query("golden_seeds", f"""
WITH seeds(query, carrier, origin, dest) AS (VALUES {_SEEDS_SQL}),
told AS (SELECT text AS query, NULL AS carrier, 'JFK' AS origin, NULL AS dest, item_id % 5 AS n_expected, 'told' AS notes FROM benchmark
  UNION ALL SELECT query, carrier, origin, dest, 1, 'told' FROM seeds WHERE carrier IN ('UA', 'DL'))
SELECT * REPLACE (CAST(n_expected AS INT) AS n_expected) FROM told
UNION ALL SELECT *, 0, NULL FROM seeds WHERE query NOT IN (SELECT query FROM told)""")
def golden_seeds(spark, d):
    """A golden set kept as JSON arrays, read back, and completed by the seed questions it does not have yet."""
    seeds = seed_queries(spark)
    passage = table(spark, d, "benchmark").select(
        F.col("text").alias("query"),
        F.struct(F.lit(None).cast("string").alias("carrier"), F.lit("JFK").alias("origin"), F.lit(None).cast("string").alias("dest"))
        .alias("filters"), F.array_repeat(F.lit("id"), (F.col("item_id") % 5).cast("int")).alias("expected_flight_ids"))
    some = seeds.filter(F.col("filters.carrier").isin("UA", "DL")).withColumn("expected_flight_ids", F.array(F.lit("id"))).drop("notes")
    path = shared_path(spark, "golden")
    tables.write_golden_arrays(passage.unionByName(some).withColumn("notes", F.lit("told")), path)
    return ev.merge_golden(tables.read_golden(spark, path), seeds).select(
        "query", "filters.*", F.size("expected_flight_ids").alias("n_expected"), "notes")


@query("rank_select", f"""
WITH {CENTROID_SQL},
t AS (SELECT query_id, unnest(string_split('1 x 3 99 ' || (query_id + 1), ' ')) AS tok FROM cent)
SELECT DISTINCT t.query_id, r.rank, r.vec_id FROM t JOIN ranked r ON r.query_id = t.query_id AND r.rank = TRY_CAST(tok AS INT)
WHERE r.rank <= 10""")
def rank_select(spark, d):
    hits = label_hits(spark, d)
    answers = label_centroids(spark, d).select(
        "query_id", F.concat(F.lit("1 x 3 99 "), (F.col("query_id") + 1).cast("string")).alias("raw"))
    return ev.select_ranks(answers, hits, "vec_id").select("query_id", "rank", "vec_id").distinct()


@query("expected_overlap", f"""
WITH {_MARKED_SQL} SELECT query_id, vec_id, rank FROM hits WHERE relevant AND rank <= 50""")
def expected_overlap(spark, d):
    """Returned ids that were expected."""
    marked = ev.mark_expected(label_hits(spark, d, 50), _expected(spark, d), "vec_id")
    return marked.filter("relevant").select("query_id", "vec_id", "rank")
