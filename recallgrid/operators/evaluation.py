"""Retrieval metrics, suite summaries, gates, threshold sweeps and model rankings."""

from __future__ import annotations

from collections.abc import Sequence
from math import floor

from pyspark.sql import Column, DataFrame, functions as F

from recallgrid.operators.percentiles import stage_summary
from recallgrid.operators.ranking import top_k
from recallgrid.session import write_out


def reciprocal_rank(rank: Column, relevant: Column) -> Column:
    """Aggregate: one over the first relevant rank, 0 without one."""
    return F.coalesce(1.0 / F.min(F.when(relevant, rank)), F.lit(0.0))


def mark_expected(hits: DataFrame, expected: DataFrame, id_col: str, qid: str = "query_id") -> DataFrame:
    """Adds ``relevant``: is the hit one of the expected ids of its query? ``expected`` is long: (query, id).

    The hits (at most k a query) first pull their own rows out of the expected table, which may be huge.
    """
    pairs = hits.select(qid, id_col)
    wanted = expected.select(qid, id_col).join(pairs, [qid, id_col], "left_semi").distinct()
    return hits.join(wanted.withColumn("relevant", F.lit(True)), [qid, id_col], "left").withColumn(
        "relevant", F.coalesce("relevant", F.lit(False)))


def expected_counts(expected: DataFrame, id_col: str, qid: str = "query_id") -> DataFrame:
    """Distinct expected ids per query, duplicates removed map-side first."""
    return expected.select(qid, id_col).distinct().groupBy(qid).agg(F.count("*").alias("n_expected"))


def query_metrics(
    queries: DataFrame, marked: DataFrame, recall: Column, qid: str = "query_id",
) -> DataFrame:
    """One row per query: n_returned, n_relevant, hit, recall_at_k, precision_at_k, mrr.

    ``recall`` is an expression over ``n_relevant`` and the columns of ``queries``. Queries without hits stay, with zeros.
    Queries with ``skipped`` set (nothing to score them by) stay with null metrics.
    """
    per_query = marked.groupBy(qid).agg(
        F.count("*").alias("n_returned"), F.count_if("relevant").alias("n_relevant"),
        reciprocal_rank(F.col("rank"), F.col("relevant")).alias("mrr"))
    if "skipped" not in queries.columns:
        queries = queries.withColumn("skipped", F.lit(False))
    joined = queries.join(per_query, qid, "left").fillna(0, ["n_returned", "n_relevant", "mrr"])
    score = lambda c: F.when(~F.col("skipped"), c)
    return joined.select(
        *queries.columns, "n_returned", "n_relevant",
        score(F.col("n_relevant") > 0).alias("hit"),
        score(recall).alias("recall_at_k"),
        score(F.coalesce(F.col("n_relevant") / F.nullif(F.col("n_returned"), F.lit(0)), F.lit(0.0))).alias("precision_at_k"),
        score(F.col("mrr")).alias("mrr"))


def recall_by_ids() -> Column:
    """Share of the expected ids that came back."""
    return F.coalesce(F.col("n_relevant") / F.nullif(F.col("n_expected"), F.lit(0)), F.lit(0.0))


def recall_by_filter(k: int) -> Column:
    """Matching results over k, at most 1 (any record meeting the filter is as good as another)."""
    return F.least(F.col("n_relevant") / F.lit(k), F.lit(1.0))


def suite_summary(metrics: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Scored and total counts, and the means over the scored queries (null when there are none)."""
    scored = ~F.col("skipped")
    mean = lambda c: F.avg(F.when(scored, c))
    return metrics.groupBy(*by).agg(
        F.count_if(scored).alias("n_scored"), F.count("*").alias("n_total"),
        mean(F.col("hit").cast("double")).alias("hit_rate"), mean(F.col("recall_at_k")).alias("mean_recall"),
        mean(F.col("precision_at_k")).alias("mean_precision"), mean(F.col("mrr")).alias("mean_mrr"),
        mean(F.col("n_returned").cast("double")).alias("mean_returned"))


def gate(summary: DataFrame, min_hit_rate: float = 0.7, min_mrr: float = 0.4, max_p95_ms: float = 5000.0) -> DataFrame:
    """Adds ``passed``; a suite without scored queries fails."""
    ok = (F.col("hit_rate") >= min_hit_rate) & (F.col("mean_mrr") >= min_mrr)
    if "p95_ms" in summary.columns:
        ok = ok & (F.col("p95_ms") <= max_p95_ms)
    return summary.withColumn("passed", F.coalesce(ok & (F.col("n_scored") > 0), F.lit(False)))


def lift(metrics: DataFrame, variant: str, treated: str, control: str) -> DataFrame:
    """MRR of two variants side by side, their difference and a verdict."""
    scored = metrics.filter(~F.col("skipped"))
    means = scored.agg(
        F.avg(F.when(F.col(variant) == treated, F.col("mrr"))).alias("mrr_treated"),
        F.avg(F.when(F.col(variant) == control, F.col("mrr"))).alias("mrr_control"))
    with_lift = means.withColumn("lift", F.col("mrr_treated") - F.col("mrr_control"))
    return with_lift.withColumn("verdict", F.when(F.col("lift") < 0, "hurting").when(
        F.col("lift") < 0.01, "marginal").when(F.col("lift").isNotNull(), "improving"))


def threshold_grid(low: float = 0.1, high: float = 0.7, step: float = 0.05) -> list[float]:
    """Thresholds from ``low`` up to and including ``high``, rounded to four digits."""
    return [round(low + i * step, 4) for i in range(floor((high - low + 1e-9) / step) + 1)]


def threshold_sweep(
    queries: DataFrame, marked: DataFrame, thresholds: Sequence[float], qid: str = "query_id",
) -> DataFrame:
    """Mean metrics at every threshold from one search at the lowest one.

    Cutting a ranked list at a score leaves a prefix of it, so per query the scores (at most k) are gathered once and
    every threshold reads off its prefix; nothing is searched again and no pair table is built.
    ``queries`` has ``n_expected``.
    """
    # Bounded by k entries a query.
    lists = marked.groupBy(qid).agg(F.collect_list(F.struct("rank", "score", "relevant")).alias("hits"))
    per_query = queries.join(lists, qid, "left").select(
        qid, "n_expected", "hits", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold"))
    over = F.filter("hits", lambda h: h["score"] >= F.col("threshold"))
    found = F.filter("over", lambda h: h["relevant"])
    sized = per_query.withColumn("over", over).withColumn("found", found).select(
        "threshold", "n_expected",
        F.coalesce(F.size("over"), F.lit(0)).alias("n_returned"),
        F.when(F.size("found") > 0, F.size("found")).otherwise(0).alias("n_relevant"),
        F.coalesce(1.0 / F.array_min(F.transform("found", lambda h: h["rank"])), F.lit(0.0)).alias("mrr"))
    returned = F.greatest("n_returned", F.lit(0))
    return sized.groupBy("threshold").agg(
        F.count("*").alias("n_scored"),
        F.avg((F.col("n_relevant") > 0).cast("double")).alias("hit_rate"),
        F.avg(recall_by_ids()).alias("mean_recall"),
        F.avg(F.coalesce(F.col("n_relevant") / F.nullif(returned, F.lit(0)), F.lit(0.0))).alias("mean_precision"),
        F.avg("mrr").alias("mean_mrr"),
        F.avg(returned.cast("double")).alias("mean_returned"))


def f1(recall: Column, precision: Column) -> Column:
    return F.coalesce(2 * recall * precision / F.nullif(recall + precision, F.lit(0.0)), F.lit(0.0))


def best_threshold(sweep: DataFrame, digits: int = 12) -> DataFrame:
    """The sweep row with the best F1 of recall and precision, the lowest threshold among equals."""
    scored = sweep.withColumn("f1", F.round(f1(F.col("mean_recall"), F.col("mean_precision")), digits))
    return scored.orderBy(F.col("f1").desc(), "threshold").limit(1)


def composite_ranking(models: DataFrame, quality_weight: float = 0.8, latency: str = "mean_rerank_ms") -> DataFrame:
    """Adds ``composite``: weighted MRR plus weighted speed relative to the slowest model; best first."""
    slowest = models.agg(F.max(latency).alias("_max")).select("_max").scalar()
    share = F.coalesce(F.col(latency) / F.nullif(slowest, F.lit(0.0)), F.lit(0.0))
    score = quality_weight * F.col("mean_mrr") + (1 - quality_weight) * (1 - share)
    return models.withColumn("composite", score).orderBy(F.col("composite").desc(), "model")


def select_ranks(answers: DataFrame, hits: DataFrame, id_col: str, raw: str = "raw", qid: str = "query_id") -> DataFrame:
    """Ids chosen by typed 1-based positions; words that are not numbers and numbers out of range are ignored."""
    tokens = answers.select(qid, F.posexplode(F.split(raw, r"\s+")).alias("position", "_token"))
    chosen = tokens.select(
        qid, "position", F.when(F.col("_token").rlike(r"^[+-]?\d+$"), F.col("_token").try_cast("int")).alias("rank"))
    return chosen.filter(F.col("rank").isNotNull()).join(hits.select(qid, "rank", id_col), [qid, "rank"])


def merge_golden(existing: DataFrame, new: DataFrame, key: str = "query", append: bool = True) -> DataFrame:
    """Existing entries plus the new ones for queries not annotated yet; without ``append`` only the new ones."""
    if not append:
        return new
    return existing.unionByName(new.join(existing.select(key), key, "left_anti"), allowMissingColumns=True)


def rerank_models(
    sets: DataFrame, models: dict, id_type: str, k: int, qid: str = "query_id", query: str = "query",
) -> DataFrame:
    """Rerank the same candidate sets with several models and time each call.

    ``models`` maps a name to a ``load`` function returning ``score(query, [doc]) -> [float]``. Each row holds one query
    and its bounded candidate set, and is repeated once per model. Output: query, model, rank, id, elapsed_ms, load_ms (the time that the
    task took to load the model); a query without candidates gives one row of nulls with 0 ms.
    """
    import time

    import pandas as pd

    schema = f"{qid} {sets.schema[qid].dataType.simpleString()}, model string, rank int, id {id_type}, elapsed_ms double, load_ms double"

    def run(frames):
        loaded: dict = {}
        load_ms: dict = {}
        for pdf in frames:
            out = []
            for key, text, cands, name in zip(pdf[qid], pdf[query], pdf["candidates"], pdf["model"]):
                if cands is None or not len(cands):
                    out.append((key, name, None, None, 0.0, load_ms.get(name)))
                    continue
                if name not in loaded:
                    began = time.perf_counter()
                    loaded[name] = models[name]()
                    load_ms[name] = (time.perf_counter() - began) * 1000
                score = loaded[name]
                began = time.perf_counter()
                got = score(text, [c["doc"] for c in cands])
                spent = (time.perf_counter() - began) * 1000
                order = sorted(range(len(cands)), key=lambda i: -got[i])[:k]
                out += [(key, name, r, cands[i]["id"], spent, load_ms[name]) for r, i in enumerate(order, 1)]
            frame = pd.DataFrame(out, columns=[qid, "model", "rank", "id", "elapsed_ms", "load_ms"])
            frame["rank"] = frame["rank"].astype("Int32")
            yield frame

    names = F.explode(F.array(*[F.lit(m) for m in models]))
    return sets.select(qid, query, "candidates", names.alias("model")).mapInPandas(run, schema)


def model_summary(
    queries: DataFrame, reranked: DataFrame, expected: DataFrame, id_col: str = "id", qid: str = "query_id",
) -> DataFrame:
    """Per model: n_scored, hit_rate, mean_mrr, mean/p50/p95 rerank time over the annotated queries, and load_ms, the longest load.

    ``queries`` lists the annotated queries; one without candidates counts as a miss taking 0 ms.
    """
    relevant = mark_expected(reranked, expected.select(qid, F.col(expected.columns[1]).alias(id_col)), id_col, qid)
    per_query = write_out(
        relevant.groupBy(qid, "model").agg(
            reciprocal_rank(F.col("rank"), F.col("relevant")).alias("mrr"), F.max("elapsed_ms").alias("ms"),
        ).join(queries.select(qid), qid, "left_semi"), "rerank")
    times = stage_summary(per_query, ["model"], "ms").select(
        "model", F.col("mean").alias("mean_rerank_ms"), F.col("p50").alias("p50_rerank_ms"),
        F.col("p95").alias("p95_rerank_ms"))
    quality = per_query.groupBy("model").agg(
        F.count("*").alias("n_scored"), F.avg((F.col("mrr") > 0).cast("double")).alias("hit_rate"),
        F.avg("mrr").alias("mean_mrr"))
    loads = reranked.groupBy("model").agg(F.max("load_ms").alias("load_ms"))
    return quality.join(times, "model").join(loads, "model")


def stage_total(latency: Column) -> Column:
    """Sum of all stages of a latency map."""
    return F.aggregate(F.map_values(latency), F.lit(0.0), lambda a, b: a + b)


def fallback_rate(rows: DataFrame, doc: str, query: str, status: Column) -> DataFrame:
    """Share of queries whose generated text is the query itself, and number of texts that pass the record check."""
    return rows.agg(
        F.count("*").alias("n"), F.avg((F.col(doc) == F.col(query)).cast("double")).alias("fallback_rate"),
        F.count_if(status == "PASS").alias("n_pass"))
