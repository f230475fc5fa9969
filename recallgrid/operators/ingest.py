"""Incremental ingest: ids, last-wins dedup, skip stored rows, render, embed, append."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from recallgrid.functions.ids import record_id
from recallgrid.functions.text import text_or_none
from recallgrid.operators.ranking import last_per_key
from recallgrid.schema import AIRPORTS, CARRIERS, ID_PARTS, code_table

#: Partitions of a batch that are named in a condition, one by one.
MOST_PARTITIONS = 4096


def with_id(df: DataFrame, parts: Sequence[str] = ID_PARTS, out: str = "flight_id") -> DataFrame:
    return df.withColumn(out, record_id(*parts))


def unseen(
    new: DataFrame, stored: DataFrame, key: str = "flight_id", position: Sequence[str] = (), partitions: Sequence[str] = (),
) -> DataFrame:
    """Rows to add: the last row per id of the new data whose id is not stored yet.

    Dedup and anti join share one hash partitioning by id; only the stored ids shuffle besides. ``partitions`` are columns that the
    id decides, by which the stored table is laid out: they join the key, so that a batch only meets its own partitions.
    """
    on = [*partitions, key]
    rows = last_per_key(new, on, *position) if position else new
    return rows.join(stored.select(*on), on, "left_anti")


def touched(batch: DataFrame, partitions: Sequence[str], most: int = MOST_PARTITIONS) -> Column:
    """A condition on the partition columns that holds in every partition the batch has rows for, to prune a scan.

    Up to ``most`` partitions it names them; beyond, it is the range of the first column. False for an empty batch.
    """
    first, *rest = partitions
    rows = batch.select(*partitions).distinct().limit(most + 1).collect()
    if len(rows) > most:
        low, high = batch.agg(F.min(first), F.max(first)).first()
        return F.coalesce(F.col(first).between(low, high), F.lit(True)) if batch.filter(
            F.col(first).isNull()).isEmpty() else F.lit(True)
    by_rest: dict[tuple, list] = {}
    for r in rows:
        by_rest.setdefault(tuple(r[c] for c in rest), []).append(r[first])
    same = lambda c, values: (
        F.col(c).isin([v for v in values if v is not None]) | (F.col(c).isNull() if None in values else F.lit(False)))
    out = F.lit(False)
    for values, firsts in by_rest.items():
        one = same(first, firsts)
        for c, v in zip(rest, values):
            one = one & same(c, [v])
        out = out | one
    return out


def already_stored(new: DataFrame, stored: DataFrame, key: str = "flight_id") -> DataFrame:
    return new.join(stored.select(key), key, "left_semi")


def ingest_report(rows: DataFrame, stored: DataFrame, key: str, valid: Column) -> DataFrame:
    """One row of counts: total, invalid, existing (valid input rows already stored), upserted (new ids).

    Rows are counted per id before the join, so a hot id or a mass of invalid rows is one row by then.
    """
    per_id = rows.groupBy(F.when(valid, F.col(key)).alias(key)).agg(F.count("*").alias("n"))
    known = stored.select(key).distinct().withColumn("_stored", F.lit(True))
    joined = per_id.join(known, key, "left")
    is_valid, is_stored = F.col(key).isNotNull(), F.coalesce("_stored", F.lit(False))
    count = lambda cond, what: F.coalesce(F.sum(F.when(cond, what)), F.lit(0)).cast("long")
    return joined.agg(
        count(F.lit(True), F.col("n")).alias("total"),
        count(~is_valid, F.col("n")).alias("invalid"),
        count(is_valid & is_stored, F.col("n")).alias("existing"),
        count(is_valid & ~is_stored, F.lit(1)).alias("upserted"),
    )


def with_names(
    df: DataFrame, dimension: DataFrame, code: str, name: str, columns: Mapping[str, str]
) -> DataFrame:
    """Look codes up in a dimension, the code itself standing in for an unknown one.

    ``columns`` maps each code column of ``df`` to the name column to add. Spark broadcasts the dimension when
    its measured size allows, and joins by shuffle otherwise.
    """
    for source, out in columns.items():
        dim = dimension.select(F.col(code).alias("_code"), F.col(name).alias("_name"))
        df = (
            df.join(dim, F.col(source) == F.col("_code"), "left")
            .withColumn(out, F.coalesce("_name", F.col(source)))
            .drop("_code", "_name")
        )
    return df


def render(pieces: Sequence[str | Column]) -> Column:
    """Concatenate literal texts and column values; a null value shows as ``None``."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else text_or_none(p) for p in pieces])


def flight_document(df: DataFrame, out: str = "doc") -> DataFrame:
    """The canonical one-line text of a flight, with names looked up for its codes."""
    spark = df.sparkSession
    carriers, airports = code_table(spark, CARRIERS, "code", "name"), code_table(spark, AIRPORTS, "code", "name")
    named = with_names(df, F.broadcast(carriers), "code", "name", {"carrier": "_carrier"})
    named = with_names(named, F.broadcast(airports), "code", "name", {"origin": "_origin", "dest": "_dest"})
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    num = F.col
    doc = render([
        text("carrier"), " ", text("_carrier"), " flight ", num("flight"), " ",
        text("origin"), " ", text("_origin"), " to ", text("dest"), " ", text("_dest"), " ",
        num("year"), "-", num("month"), "-", num("day"),
        " sched ", num("sched_dep_time"), "->", num("sched_arr_time"),
        " actual ", num("dep_time"), "->", num("arr_time"),
        " dist ", num("distance"), " air ", num("air_time"),
    ])
    return named.withColumn(out, doc).drop("_carrier", "_origin", "_dest")


def index_rows(
    records: DataFrame,
    stored_ids: DataFrame,
    embed: Callable[[Column], Column],
    position: Sequence[str],
    key: str = "flight_id",
    partitions: Sequence[str] = (),
) -> DataFrame:
    """Rows ready to append to the index: payload, text and vector of the records not stored yet.

    The anti join comes first, so only new rows are rendered and embedded.
    """
    fresh = flight_document(unseen(with_id(records, out=key), stored_ids, key, position, partitions))
    return fresh.withColumn("embedding", embed(F.col("doc"))).drop(*position)
