"""Exact top-k inner products by no-random-access aggregation.

Each dimension of a block of candidates is a list sorted by value. A query reads a list from its top where its own component is
positive, from its bottom where it is negative. Lists are read on in steps that double. A component that was read counts as it is;
one not yet read is at most as good as the last one read in its list, and at least as good as the list's far end. That bounds every score
from above and below. The k-th best lower bound, or the k-th best score of earlier blocks, is what a candidate must still be able to
reach; candidates that cannot are out. A query stops reading when no more than k candidates are left or its lists end; what is left gets its
final scores.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recallgrid.llm.common import write_out


def _number_type(most: float, dim: int):
    """A type in which all inner products of such integers are exact."""
    bound = most * most * max(dim, 1)
    return np.float32 if bound < 2 ** 24 else np.float64 if bound < 2 ** 53 else object


def _best(scores, ids, k):
    """Positions of the k best: higher score first, then smaller id."""
    return np.lexsort((ids, -scores))[:k]


def nra_block(queries, query_ids, best_scores, best_ids, block, ids, k, first=1 / 32, most=1 / 2):
    """Merge one block of candidates into every query's running best k (none yet: empty arrays); the share of list entries read.

    ``block``: candidates x dim, all integers; ``best_scores``/``best_ids``: one growing list for each query. Lists are read to the share
    ``first``, twice that, and so on, up to ``most``, for the queries that have not stopped; the final scores of candidates still open
    then are resolved from their vectors.
    """
    n = len(block)
    if not n or not len(queries):
        return 0.0
    up, down = np.maximum(queries, 0), np.minimum(queries, 0)
    lists = np.sort(block, axis=0)
    open_pairs = np.asarray(query_ids)[:, None] != np.asarray(ids)[None, :]
    least = np.array([s[k - 1] if len(s) >= k else -np.inf for s in best_scores], object if block.dtype == object else float)
    read_by = np.zeros(len(queries), np.int64)
    going = np.arange(len(queries))
    depth = max(1, int(n * first))
    while len(going) and depth <= max(1, int(n * most)):
        top, bottom = lists[n - depth], lists[depth - 1]
        high, low = block >= top, block <= bottom  # components read from the top, and from the bottom
        read_by[going] = depth
        upper = up[going] @ np.where(high, block, top).T + down[going] @ np.where(low, block, bottom).T
        lower = up[going] @ np.where(high, block, lists[0]).T + down[going] @ np.where(low, block, lists[-1]).T
        lower = np.where(open_pairs[going], lower, -np.inf)
        if n >= k:
            least[going] = np.maximum(least[going], np.partition(lower, n - k, axis=1)[:, n - k])
        open_pairs[going] &= upper >= least[going, None]
        going = going[open_pairs[going].sum(axis=1) > k]
        depth *= 2
    left = np.flatnonzero(open_pairs.any(axis=0))
    exact = queries @ block[left].T
    for q in range(len(queries)):
        own = np.flatnonzero(open_pairs[q, left] & (exact[q] >= least[q]))
        if not len(own):
            continue
        scores, found = exact[q, own], ids[left[own]]
        if len(scores) > 4 * k:
            keep = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
            scores, found = scores[keep], found[keep]
        s, i = np.concatenate([best_scores[q], scores]), np.concatenate([best_ids[q], found])
        order = _best(s, i, k)
        best_scores[q], best_ids[q] = s[order], i[order]
    return float(read_by.mean()) / n


def top_inner_products(queries: DataFrame, candidates: DataFrame, k: int = 20, query_block: int = 4096) -> DataFrame:
    """The ``k`` highest integer inner products of each query (columns id, v: array<long>) over all candidates but itself.

    Queries are dealt by hash into blocks of about half of ``query_block``, the only thing sent to tasks; candidates are scanned once for
    each block and never shuffled. The rows of each of several blocks are written out before the next is taken, so that neither
    the driver nor a task ever holds more than one block. A task hands on at most k rows for each query, and these are cut again before the last shuffle.
    Vectors must be of one length: others, null vectors and null components must be dropped before. Fewer than k candidates
    give fewer rows; ties go to the smaller id; a repeated candidate row counts once for each row.

    Columns: query_id, rank (from 1), vec_id, score.
    """
    spark = candidates.sparkSession
    parts = None
    numbered = queries.select(F.col("id").alias("query_id"), "v")
    total = numbered.count()
    blocks = max(1, -(-total // (query_block // 2)))
    for number in range(blocks):
        block = numbered.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == number).collect() if total else []
        found = candidates.select("id", "v").mapInArrow(_scan(block, k), "query_id long, vec_id long, score long")
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        found = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        if blocks > 1:
            found = write_out(found, "top-block")
        parts = found if parts is None else parts.unionByName(found)
    return parts


def _scan(rows, k):
    ids = [r.query_id for r in rows]
    matrix = [r.v for r in rows]

    def run(batches):
        best_s = [np.empty(0) for _ in ids]
        best_i = [np.empty(0, np.int64) for _ in ids]
        dim = len(matrix[0]) if matrix else 0
        exact_q = np.array(matrix, dtype=object).reshape(len(ids), dim)
        most_q = max((abs(x) for row in matrix for x in row), default=0)
        for batch in batches:
            if not ids or not batch.num_rows:
                continue
            column = batch.column(1)
            lengths = np.diff(np.asarray(column.offsets))
            if (lengths != dim).any():
                raise ValueError(f"all vectors must have {dim} components")
            flat = np.asarray(column.flatten()).reshape(-1, dim)
            kind = _number_type(max(most_q, int(np.abs(flat).max(initial=0))), dim)
            nra_block(exact_q.astype(kind), ids, best_s, best_i, flat.astype(kind), np.asarray(batch.column(0)), k)
        rows_out = [(q, int(i), int(s)) for q, ss, ii in zip(ids, best_s, best_i) for s, i in zip(ss, ii)]
        if rows_out:
            q, i, s = zip(*rows_out)
            yield pa.RecordBatch.from_arrays(
                [pa.array(q, pa.int64()), pa.array(i, pa.int64()), pa.array(s, pa.int64())], ["query_id", "vec_id", "score"])

    return run


def integer_vectors(df: DataFrame, id_column: str = "vec_id", vector: str = "embedding", scale: int = 64) -> DataFrame:
    """id, v: floor(scale * x) of every component; rows with a null or non-finite component, or no vector, are left out."""
    fit = F.col(vector).isNotNull() & F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return df.filter(fit).select(
        F.col(id_column).alias("id"), F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"))

