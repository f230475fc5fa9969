"""Top-k, latest-row and running-total building blocks that stay spread out when one key is hot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def top_k(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    k: int,
    rank: str = "rank",
    spread: Column | None = None,
    salts: int = 64,
) -> DataFrame:
    """The first ``k`` rows of every key, numbered from 1 in ``rank``.

    ``row_number() <= k`` lets Spark cut each map task down to k rows per key before the shuffle
    (WindowGroupLimit, for k up to 1000). With ``spread``, rows first compete inside ``salts`` slices of
    their key, so that the last window sees at most ``salts * k`` rows of any key.
    """
    if spread is not None:
        sliced = df.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)))
        w = Window.partitionBy(*keys, "_salt").orderBy(*order)
        df = sliced.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).drop("_salt", "_r")
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def last_per_key(df: DataFrame, keys: Sequence[str], *position: str) -> DataFrame:
    """One row per key: the one with the greatest position (upsert semantics, last wins)."""
    return top_k(df, keys, [F.col(p).desc() for p in position], 1, "_rank").drop("_rank")


def first_per_key(df: DataFrame, keys: Sequence[str], *position: str) -> DataFrame:
    """One row per key: the one with the least position (first wins)."""
    return top_k(df, keys, [F.col(p).asc() for p in position], 1, "_rank").drop("_rank")


def head_rows(df: DataFrame, limit: int | None, *position: str) -> DataFrame:
    """Row cap by input position; 0 or None keeps everything."""
    return df.orderBy(*position).limit(limit) if limit else df


def salted_join(left: DataFrame, right: DataFrame, key: str, right_key: str, salts: int = 16, how: str = "left") -> DataFrame:
    """Join to a table of one row a key, the rows of a hot key spread over ``salts`` tasks; nulls equal nulls. Drops ``right_key``.

    Keys are compared by a hash and then as they are, so that a long text is no join key. Each row of ``right`` is sent ``salts``
    times: cut it to the keys asked for first.
    """
    spread = [c for c, t in left.dtypes if not t.startswith(("map", "variant")) and "variant" not in t]
    salted = left.withColumn("_hash", F.xxhash64(key)).withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    copies = right.withColumn("_rhash", F.xxhash64(right_key)).withColumn("_rsalt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    on = (F.col("_hash") == F.col("_rhash")) & (F.col("_salt") == F.col("_rsalt")) & F.col(key).eqNullSafe(F.col(right_key))
    return salted.join(copies, on, how).drop("_hash", "_salt", "_rhash", "_rsalt", right_key)
