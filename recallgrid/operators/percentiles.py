"""Exact percentiles with linear interpolation, without gathering a group in one place."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from recallgrid.session import write_out

#: Distinct values that are put in order in one task.
SLICE_ROWS = 500_000


def exact_percentiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """``(*keys, prob, value)`` for every group, equal to interpolating in its sorted values.

    Equal values are counted together first. The counts are dealt by range of (group, value) into slices of about ``slice_rows``
    distinct values, however the values are spread; running totals over a group's slices tell which slice holds each wanted
    rank, and only the values of those slices are ordered. Nulls do not count; null keys are a group.
    """
    if not keys:
        return exact_percentiles(df.withColumn("_all", F.lit(0)), ["_all"], value, probs, slice_rows).drop("_all")
    counted = write_out(
        df.filter(F.col(value).isNotNull()).groupBy(F.struct(*keys).alias("_g"), F.col(value).cast("double").alias("_v")).agg(
            F.count("*").alias("_n")), "counts")
    slices = max(1, -(-counted.count() // slice_rows))
    ranged = write_out(counted.repartitionByRange(slices, "_g", "_v").withColumn("_slice", F.spark_partition_id()), "ranges")

    # One row for each slice and group in it: no more than slices and groups together.
    by_slice = Window.partitionBy("_g").orderBy("_slice")
    totals = ranged.groupBy("_g", "_slice").agg(F.sum("_n").alias("_n")).withColumn(
        "_through", F.sum("_n").over(by_slice)).withColumn(
        "_before", F.col("_through") - F.col("_n")).withColumn("_total", F.sum("_n").over(Window.partitionBy("_g")))
    wanted = write_out(totals.withColumn("prob", F.explode(F.array(*[F.lit(float(p)) for p in probs]))).withColumn(
        "_pos", F.col("prob") * (F.col("_total") - 1)).withColumn(
        "_at", F.explode(F.array_distinct(F.array(F.floor("_pos"), F.ceil("_pos"))))).filter(
        (F.col("_at") >= F.col("_before")) & (F.col("_at") < F.col("_through"))).select(
        "_g", "_slice", "_before", "prob", "_pos", "_at"), "ranks")

    marks = wanted.select("_g", "_slice", "_before").distinct()
    in_slice = Window.partitionBy("_g", "_slice").orderBy("_v")
    ordered = ranged.join(marks, ["_g", "_slice"]).withColumn(
        "_end", F.col("_before") + F.sum("_n").over(in_slice)).withColumn("_begin", F.col("_end") - F.col("_n"))
    picked = ordered.drop("_before").join(wanted.drop("_before"), ["_g", "_slice"]).filter(
        (F.col("_at") >= F.col("_begin")) & (F.col("_at") < F.col("_end")))
    ends = picked.groupBy("_g", "prob").agg(
        F.first("_pos").alias("_pos"), F.min("_v").alias("_a"), F.max("_v").alias("_b"))
    share = F.col("_pos") - F.floor("_pos")
    return ends.select("_g.*", "prob", (F.col("_a") + (F.col("_b") - F.col("_a")) * share).alias("value"))


def stage_summary(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Mean, p50 and p95 per group."""
    at = exact_percentiles(df, keys, value, [0.5, 0.95])
    wide = at.groupBy(*keys).agg(
        F.max(F.when(F.col("prob") == 0.5, F.col("value"))).alias("p50"),
        F.max(F.when(F.col("prob") == 0.95, F.col("value"))).alias("p95"))
    means = df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"))
    return means.join(wide, list(keys), "left").fillna(0.0, ["mean", "p50", "p95"])
