"""Vector expressions and the word-overlap score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

WORD_BREAK = r"[^\p{L}\p{N}]+"


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x
    )


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two array columns; null when either has no length (never NaN, which would sort first)."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def check_dimension(vec: Column, dim: int) -> Column:
    """The vector itself, or a failed job when its length is not ``dim``."""
    return F.when(F.size(vec) == dim, vec).otherwise(
        F.raise_error(F.concat(F.lit(f"expected {dim} dimensions, got "), F.size(vec).cast("string")))
    )


def words(text: Column) -> Column:
    """Lower-case words of a text (empty pieces removed)."""
    return F.array_remove(F.split(F.lower(text), WORD_BREAK), "")


def word_overlap(a: Column, b: Column) -> Column:
    """Share of distinct words two texts have in common (0 when both are empty)."""
    wa, wb = words(a), words(b)
    return F.coalesce(
        F.size(F.array_intersect(wa, wb)) / F.nullif(F.size(F.array_union(wa, wb)), F.lit(0)), F.lit(0.0)
    )


def centroids(df: DataFrame, keys: list[str], vec: str, out: str = "embedding") -> DataFrame:
    """Element-wise mean vector per group, combined map-side without unnesting the vectors."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    mean = Summarizer.mean(F.col("_v"))
    return (
        df.select(*keys, array_to_vector(F.col(vec).cast("array<double>")).alias("_v"))
        .groupBy(*keys)
        .agg(mean.alias("_m"))
        .select(*keys, vector_to_array("_m").alias(out))
    )
