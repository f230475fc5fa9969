"""Document fingerprints: bottom-k sketches of word shingles, in DataFrame functions only.

A sketch is the sorted list of the ``k`` smallest 64-bit hashes of a text's distinct shingles. A sketch of fewer than ``k`` hashes
is the whole set. The sketch of two parts is the ``k`` smallest of both sketches, so parts may be sketched apart and merged in any
order; two sketches tell resemblance and containment, one tells the number of distinct shingles.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recallgrid.llm.common import bounded, write_out

WORDS = 5
#: Hashes in a sketch: likeness is off by 0.044 at most in the mean square, and exact for texts of up to 128 shingles in all.
K = 128
#: Distinct rows that are put in order in one task.
ORDERED_ROWS = 1_000_000
#: Tasks whose first rows may be broadcast.
MOST_TASKS = 1 << 20


def _bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body or its lambdas read it."""
    return F.transform(F.array(value), body)[0]


def shingle_hashes(text: Column, words: int = WORDS) -> Column:
    """array<long>: hashes of all runs of ``words`` words, lower-cased, repeats included.

    Words are separated by ASCII blanks. Fewer words than that are one shingle; without words, or of a null text, there is none.
    """
    found = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def runs(w: Column) -> Column:
        n = F.size(w)
        return (
            F.when(n >= words, F.transform(
                F.sequence(F.lit(0), n - words), lambda i: F.xxhash64(*(F.get(w, i + j) for j in range(words)))))
            .when(n > 0, F.array(F.xxhash64(w)))
            .otherwise(F.array().cast("array<bigint>")))

    # Each word is hashed once, then the hashes of the words in a run.
    return _bind(F.transform(found, lambda w: F.xxhash64(w)), runs)


def _least(hashes: Column, k: int) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def sketch(text: Column, k: int = K, words: int = WORDS) -> Column:
    """array<long>, sorted: the ``k`` smallest distinct shingle hashes of a text."""
    return _least(shingle_hashes(text, words), k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of two parts together, from their sketches. Shingles across the cut belong to neither part."""
    return _least(F.concat(a, b), k)


def merge_groups(parts: DataFrame, key: str, column: str = "sketch", k: int = K) -> DataFrame:
    """``key``, ``sketch``: one sketch for each group of sketches; null keys are a group, empty groups of sketches give an empty one.

    Hashes are made distinct and cut to ``k`` before they move, so the shuffle carries at most ``k`` a group and task.
    """
    hashes = parts.select(F.col(key).alias("g"), F.explode_outer(column).alias("h")).distinct()
    least = Window.partitionBy("g").orderBy(F.col("h").asc_nulls_last())
    cut = hashes.withColumn("r", F.row_number().over(least)).filter(F.col("r") <= k)
    return cut.groupBy("g").agg(F.sort_array(F.collect_list("h")).alias("sketch")).select(F.col("g").alias(key), "sketch")


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity, 0 to 1: the share of both among the ``k`` smallest hashes of either. Two empty ones are alike."""
    return _bind(F.struct(a.alias("a"), b.alias("b")), lambda s: _bind(_least(F.concat(s["a"], s["b"]), k), lambda u: F.when(
        F.size(u) == 0, F.lit(1.0)).otherwise(
            F.size(F.array_intersect(F.array_intersect(u, s["a"]), s["b"])) / F.size(u))))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles (double): exact below ``k``, else from how far up the ``k``-th smallest hash lies."""
    place = (F.element_at(a, -1).cast("double") + F.lit(2.0 ** 63)) / F.lit(2.0 ** 64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / place)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b holds, 0 to 1. An empty ``a`` is contained in anything."""
    both = resemblance(a, b, k)
    size_a, size_b = distinct_shingles(a, k), distinct_shingles(b, k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), both / (1 + both) * (size_a + size_b) / size_a))


def to_text(a: Column) -> Column:
    """A sketch as a string: 16 hex digits a hash."""
    return F.array_join(F.transform(a, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), "")


def from_text(text: Column) -> Column:
    """The sketch that ``to_text`` wrote."""
    return F.transform(
        F.filter(F.split(F.regexp_replace(text, "(.{16})", "$1,"), ","), lambda x: x != ""),
        lambda x: F.conv(x, 16, -10).cast("bigint"))


def fingerprints(docs: DataFrame, k: int = K) -> DataFrame:
    """doc_id, fingerprint, n_shingles (estimated) of every document: one pass, no shuffle.

    Null texts are empty, with an empty fingerprint. Null doc_ids and repeated rows are kept; no rows give no rows; other columns
    are ignored.
    """
    found = docs.select("doc_id", sketch(F.col("text"), k).alias("s"))
    return found.select("doc_id", to_text(F.col("s")).alias("fingerprint"), distinct_shingles(F.col("s"), k).alias("n_shingles"))


def successors(rows: DataFrame) -> DataFrame:
    """Each distinct row's next one by descending doc_id: doc_id, key, n_chars, copies, next_key.

    ``rows``: doc_id, key, n_chars, narrow; equal keys are copies of one row. Ties of doc_id go by key, null doc_ids come last, and
    after the last row comes the first. Rows are dealt into ranges; only each range's first row meets the range before it.
    """
    apart = write_out(rows.groupBy("key").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_chars").alias("n_chars"), F.count("*").alias("copies")), "print-keys")
    order = [F.col("doc_id").desc_nulls_last(), F.col("key")]
    ranges = max(1, -(-apart.count() // ORDERED_ROWS))
    dealt = write_out(apart.repartitionByRange(ranges, *order).withColumn("range", F.spark_partition_id()), "print-ranges")
    inside = Window.partitionBy("range").orderBy(*order)
    led = write_out(dealt.withColumn("next_key", F.lead("key").over(inside)).withColumn(
        "r", F.row_number().over(inside)), "print-order")
    # One row for each range.
    along = Window.orderBy("range")
    first = F.first("key").over(along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    after = write_out(led.filter("r = 1").select("range", F.coalesce(F.lead("key").over(along), first).alias("after")), "print-after")
    few = bounded(after, MOST_TASKS)
    return led.join(after if few is None else few, "range").select(
        "doc_id", "key", "n_chars", "copies", F.coalesce("next_key", "after").alias("next_key"))


def edited_likeness(docs: DataFrame, k: int = K) -> DataFrame:
    """Fingerprints of every document and of its edited text, and how alike they and the next document's are.

    The edited text: the last floor(n_chars / 2) code points replaced by the first as many (or all) of the next document's, by
    descending doc_id (after the last: the first). Null texts are empty. Null doc_ids come last, ties go by a hash of the text, and
    each of several equal rows is followed by the next of them. A single row follows itself. No rows give no rows; other columns are
    ignored.

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_shingles.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select("doc_id", text.alias("text")).select(
        "doc_id", "text", F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit("|"), F.col("text")).cast("binary")).alias("key"))
    next_of = write_out(successors(base.select("doc_id", "key", F.length("text").alias("n_chars"))), "print-next").withColumn(
        "half", F.floor(F.col("n_chars") / 2).cast("int"))
    texts = base.groupBy("key").agg(F.first("text").alias("text"))
    about = ["key", "doc_id", "n_chars", "half"]
    # The next document sends its beginning and its sketch to the one before.
    ahead = texts.join(next_of.drop("copies").withColumnsRenamed({"key": "to", "next_key": "key"}), "key").select(
        F.col("to").alias("key"), "doc_id", "n_chars", "half", F.substr("text", F.lit(1), "half").alias("tail"),
        sketch(F.col("text"), k).alias("next"), F.lit(1).cast("long").alias("times"))
    again = next_of.filter("copies > 1").select(
        *about, F.lit(None).cast("string").alias("tail"), F.lit(None).cast("array<bigint>").alias("next"), (F.col("copies") - 1).alias("times"))
    begun = F.substr("text", F.lit(1), F.col("n_chars") - F.col("half"))
    edited = F.concat(begun, F.coalesce("tail", F.substr("text", F.lit(1), "half")))
    both = ahead.unionByName(again).join(texts, "key").select("doc_id", "n_chars", "times", "next", "text", edited.alias("edited"))
    told = both.select(
        "doc_id", "n_chars", "times", "next", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        sketch(F.col("text"), k).alias("own"), sketch(F.col("edited"), k).alias("changed"))
    return told.select(
        "doc_id", F.col("n_chars").cast("long").alias("n_chars"), "edited_sha256", to_text(F.col("own")).alias("fingerprint"),
        to_text(F.col("changed")).alias("edited_fingerprint"), resemblance(F.col("own"), F.col("changed"), k).alias("near_edited"),
        F.when(F.col("next").isNull(), F.lit(1.0)).otherwise(resemblance(F.col("own"), F.col("next"), k)).alias("near_next"),
        distinct_shingles(F.col("own"), k).alias("n_shingles"), F.explode(F.sequence(F.lit(1).cast("long"), "times")).alias("_t")).drop("_t")
