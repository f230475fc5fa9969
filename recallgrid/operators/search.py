"""Filtered top-k cosine search of a table of requests against a table of records.

Requests are taken in blocks of bounded size. For each block the records are scanned once, under the conditions that all its requests
share; each record batch is scored against all vectors of the block with one matrix product inside ``mapInArrow``, and a
task hands on only rows that can still enter the top k of some request. No pair table is ever built and records never move.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from recallgrid.functions import vectors
from recallgrid.operators.filters import FLIGHT_TERMS, Term, batch_mask, common_bounds, has_filter
from recallgrid.operators.ranking import salted_join, top_k
from recallgrid.schema import HIT_FIELDS, RERANK_FETCH, RERANK_RETURN, SCORE_THRESHOLD
from recallgrid.session import write_out

# 4096 requests of 1024 dimensions; 32 MB as float64. Larger request tables are taken in several blocks.
BLOCK_CELLS = 4_194_304
_BLOCK_REQUESTS = 4096
SCORE_DIGITS = 6
# Scores that a task holds at once; 16 MB.
_SCORES = 2_097_152
# Bytes of kept columns that a task hands on at once.
_OUT_BYTES = 8_388_608
#: Hits of a request that names no limit.
DEFAULT_LIMIT = 10


class _Requests(NamedTuple):
    """Request vectors as a unit matrix, grouped by filter so that each filter is evaluated once a batch."""

    ids: list
    unit: np.ndarray
    k: np.ndarray
    floor: np.ndarray
    groups: list[tuple[tuple, np.ndarray]]
    reach: np.ndarray | None  # bits of the cells that each request reads


def _requests(rows: list, qid: str, terms: Sequence[Term], reach: str | None = None) -> _Requests:
    sizes = {len(r["_vec"]) for r in rows}
    if len(sizes) > 1:
        raise ValueError(f"requests of different dimensions: {sorted(sizes)}")
    m = np.array([np.asarray(r["_vec"], dtype="float64") for r in rows])
    length = np.linalg.norm(m, axis=1)
    usable = length > 0
    groups: dict[tuple, list[int]] = {}
    for i, r in enumerate(rows):
        if usable[i]:
            groups.setdefault(tuple(t.wanted(r[t.field]) for t in terms), []).append(i)
    return _Requests(
        [r[qid].asDict() if isinstance(r[qid], Row) else r[qid] for r in rows], m / np.where(usable, length, 1.0)[:, None], np.array([r["_k"] for r in rows]),
        np.array([-np.inf if r["_floor"] is None else r["_floor"] for r in rows], dtype="float64"),
        [(want, np.array(members)) for want, members in groups.items()],
        None if reach is None else np.array([np.frombuffer(r[reach], dtype="uint8") for r in rows]))


def _unit_rows(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Record vectors scaled to length one, and which of them have the right size and a length at all."""
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    good = sizes == dim
    flat = column.filter(pa.array(good)).flatten().to_numpy(zero_copy_only=False).astype("float64", copy=False)
    m = np.zeros((len(column), dim))
    m[good] = flat.reshape(-1, dim)
    length = np.sqrt(np.einsum("ij,ij->i", m, m))
    usable = good & (length > 0)  # also false for NaN
    m /= np.where(usable, length, 1.0)[:, None]
    return m, usable


def _scores(unit: np.ndarray, asked: np.ndarray, members: np.ndarray, worst: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """The scores of a batch for each request (with ``worst``, each that any can matter to), from one product for as many requests as keep it within ``_SCORES`` numbers."""
    width = max(1, _SCORES // len(unit))
    for at in range(0, len(members), width):
        part = members[at : at + width]
        scores = np.round(unit @ asked[part].T, SCORE_DIGITS)
        for j in range(len(part)) if worst is None else np.flatnonzero((scores >= worst[part]).any(axis=0)):
            yield part[j], scores[:, j]


def _meeting(rows: np.ndarray, members: np.ndarray, cell: np.ndarray | None, reach: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and the requests to score them for: all, or cell by cell those that read the cell."""
    if cell is None:
        yield rows, members
        return
    for c in np.unique(cell[rows]):
        if 0 <= c < 8 * reach.shape[1]:
            those = members[(reach[members, c >> 3] >> (c & 7)) & 1 == 1]
            if len(those):
                yield rows[cell[rows] == c], those


def _cell_numbers(reach: np.ndarray) -> list[int]:
    """The cells that any of the requests reads."""
    return np.flatnonzero(np.unpackbits(np.bitwise_or.reduce(reach, axis=0), bitorder="little")).tolist()


def _id_places(ids: pa.Array) -> np.ndarray:
    """The place of each id in ascending order, nulls first as in Spark."""
    order = pc.array_sort_indices(ids, null_placement="at_start").to_numpy()
    places = np.empty(len(order), dtype="int64")
    places[order] = np.arange(len(order))
    return places


def _score_batches(
    batches: Iterator[pa.RecordBatch], req: _Requests, terms: Sequence[Term], vec: str, keep: Sequence[str], by_id: bool = False,
    cell: str | None = None,
) -> Iterator[tuple[np.ndarray, np.ndarray, pa.RecordBatch]]:
    """(request positions, scores, kept columns) of rows that may be in the top k, batch by batch.

    A record without a vector, or with one of another length, matches nothing; a task in which no vector has the requests' length fails.
    With ``by_id``, equal scores are cut by the id, the first of ``keep``, so that a batch has at most k rows for a request.
    """
    other, fits = 0, False
    worst = req.floor.copy()  # lowest score that can still matter, per request
    best: dict[int, np.ndarray] = {}
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = batch.column(vec).value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        fits = fits or bool((sizes == req.unit.shape[1]).any())
        other = max(other, int(sizes.max()))
        unit, usable = _unit_rows(batch.column(vec), req.unit.shape[1])
        cells = None if cell is None else pc.fill_null(batch.column(cell), -1).to_numpy(zero_copy_only=False)
        rows_out, req_out, score_out = [], [], []
        places = None
        for wants, members in req.groups:
            mask = batch_mask(batch, terms, wants)
            rows = np.flatnonzero(usable if mask is None else usable & mask)
            if not len(rows):
                continue
            for near, those in _meeting(rows, members, cells, req.reach):
                for r, s in _scores(unit[near], req.unit, those, worst):
                    hit = np.flatnonzero(s >= worst[r])
                    k = int(req.k[r])
                    if len(hit) > k:  # without ``by_id`` all ties of the k-th score stay in; ids decide later
                        kth = np.partition(s[hit], len(hit) - k)[len(hit) - k]
                        hit = hit[s[hit] >= kth]
                        if by_id and len(hit) > k:
                            places = _id_places(batch.column(keep[0])) if places is None else places
                            hit = hit[np.lexsort((places[near[hit]], -s[hit]))[:k]]
                    top = np.concatenate([best.get(r, np.empty(0)), s[hit]])
                    if len(top) >= k:
                        top = np.partition(top, len(top) - k)[len(top) - k :]
                        worst[r] = max(worst[r], top.min())
                    best[r] = top
                    rows_out.append(near[hit])
                    req_out.append(np.full(len(hit), r))
                    score_out.append(s[hit])
        if rows_out:
            rows, which, score = (np.concatenate(x) for x in (rows_out, req_out, score_out))
            kept = batch.select(list(keep))
            step = max(1, _OUT_BYTES * batch.num_rows // max(1, kept.nbytes))
            for at in range(0, len(rows), step):
                yield which[at : at + step], score[at : at + step], kept.take(pa.array(rows[at : at + step]))
    if other and not fits:
        raise ValueError(f"requests have {req.unit.shape[1]} dimensions, records {other}")


def _out_schema(requests: DataFrame, records: DataFrame, qid: str, keep: Sequence[str]) -> T.StructType:
    return T.StructType(
        [T.StructField(qid, requests.schema[qid].dataType), T.StructField("_k", T.IntegerType()), T.StructField("score", T.DoubleType())]
        + [T.StructField(c, records.schema[c].dataType) for c in keep]
    )


def _to_batch(req: _Requests, part: tuple, schema: pa.Schema) -> pa.RecordBatch:
    which, score, taken = part
    ids = pa.array([req.ids[i] for i in which], type=schema.field(0).type)
    return pa.RecordBatch.from_arrays([ids, pa.array(req.k[which], pa.int32()), pa.array(score), *taken.columns], schema=schema)


def vector_search(
    records: DataFrame,
    requests: DataFrame,
    *,
    k: int | str = 10,
    threshold: float | str | None = SCORE_THRESHOLD,
    terms: Sequence[Term] = (),
    id_col: str = "flight_id",
    vec_col: str = "embedding",
    qid: str = "query_id",
    qvec: str = "embedding",
    keep: Sequence[str] = (),
    block_cells: int = BLOCK_CELLS,
    within: tuple[str, str] | None = None,
) -> DataFrame:
    """``(qid, rank, id, score, *keep)``: the best ``k`` records of every request.

    ``k`` and ``threshold`` (inclusive) are constants or names of request columns; a null ``k`` means ``DEFAULT_LIMIT``. Scores are cosines
    rounded to six digits, ties going to the smaller id, so that results do not depend on how the data is split. Requests
    and records without direction (zero vectors, or none) match nothing. ``within`` names a request column of bits (bytes, lowest bit
    first) and a record column of cell numbers: a request is then scored against the records only in cells whose bit is set.

    The vectors of a block of requests, at most ``block_cells`` numbers, are all that is sent to the tasks. The hits of each of
    several blocks (at most k a request) are written out before the next block is taken.
    """
    named = requests.select(
        F.col(qid).alias(qid),
        F.col(qvec).alias("_vec"),
        (F.coalesce(k, F.lit(DEFAULT_LIMIT)) if isinstance(k, str) else F.lit(k)).cast("int").alias("_k"),
        (F.col(threshold) if isinstance(threshold, str) else F.lit(threshold)).cast("double").alias("_floor"),
        *[F.col(f) for f in dict.fromkeys([*[t.field for t in terms], *(within or ())[:1]])],
    ).filter(F.size("_vec") > 0)
    carried = [id_col, *[c for c in keep if c != id_col]]
    reach, cell = within or (None, None)
    needed = list(dict.fromkeys([*carried, vec_col, *[t.column for t in terms], *([cell] if cell else [])]))
    by_id = isinstance(records.schema[id_col].dataType, T.IntegralType) or records.schema[id_col].dataType == T.StringType()
    schema = _out_schema(requests, records, qid, carried)

    def scan(rows: list):
        """The hits of a block of requests, and what was sent to the tasks for it."""
        bounds = common_bounds([r.asDict() for r in rows], terms)
        source = records if bounds is None else records.filter(bounds)
        asked = _requests(rows, qid, terms, reach)
        source = (source.filter(F.col(cell).isin(_cell_numbers(asked.reach))) if cell else source).select(*needed)
        # A plain tuple: broadcast values are unpickled without this package at hand.
        shared = records.sparkSession.sparkContext.broadcast(tuple(asked))
        arrow = to_arrow_schema(schema)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            req = _Requests(*shared.value)
            for part in _score_batches(batches, req, terms, vec_col, carried, by_id, cell):
                yield _to_batch(req, part, arrow)

        # The largest k is known here, so the per-request cut is exact for every k.
        ranked = _rank(source.mapInArrow(run, schema), qid, id_col, max(r["_k"] for r in rows))
        return ranked.filter(F.col("rank") <= F.col("_k")).select(*_with_rank(schema, qid).names), shared

    few = _first_block(named, block_cells)
    if few is not None:
        return scan(few)[0] if few else records.sparkSession.createDataFrame([], _with_rank(schema, qid))
    found = None
    for rows in _blocks(write_out(named, "requests"), qid, block_cells):
        hits, shared = scan(rows)
        hits = write_out(hits, "hits")
        shared.destroy()
        found = hits if found is None else found.unionByName(hits)
    return found


def _with_rank(schema: T.StructType, qid: str) -> T.StructType:
    return T.StructType([schema[qid], T.StructField("rank", T.IntegerType()), *[f for f in schema if f.name not in (qid, "_k")]])


def _rank(found: DataFrame, qid: str, id_col: str, k: int) -> DataFrame:
    return top_k(found, [qid], [F.col("score").desc(), F.col(id_col).asc()], k)


def _first_block(named: DataFrame, cells: int) -> list | None:
    """All request rows if one block holds them, else None. Never fetches more than a block and one row."""
    rows = named.limit(_BLOCK_REQUESTS + 1).collect()
    if len(rows) > _BLOCK_REQUESTS or len(rows) * max((len(r["_vec"]) for r in rows), default=0) > cells:
        return None
    return rows


def _blocks(named: DataFrame, qid: str, cells: int) -> Iterator[list]:
    """The request rows, dealt by a hash of their id into blocks of about half the bound. ``named`` is written."""
    total, dim = named.agg(F.count("*"), F.max(F.size("_vec"))).first()
    blocks = max(-(-2 * total // _BLOCK_REQUESTS), -(-2 * total * dim // cells))
    for number in range(blocks):
        rows = named.filter(F.pmod(F.xxhash64(qid), F.lit(blocks)) == number).collect()
        if rows:
            yield rows


def search_with_fallback(
    records: DataFrame, requests: DataFrame, *, terms: Sequence[Term], qid: str = "query_id", **options: Any
) -> DataFrame:
    """Filtered search; requests whose filter leaves nothing are answered without it. Adds ``filters_dropped``.

    One scan: a request with a filter goes through it twice, as it is and without its filter, and the second answer (at most k
    rows) is dropped where the first has any. Where requests have filters, nothing can be pushed into that scan.
    """
    fields = list(dict.fromkeys(t.field for t in terms))
    asked = requests.withColumn("_dropped", F.explode(F.when(
        has_filter(terms), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))))
    asked = asked.withColumn("_ask", F.struct(qid, F.col("_dropped").alias("filters_dropped"))).withColumns(
        {f: F.when(~F.col("_dropped"), F.col(f)) for f in fields})
    hits = vector_search(records, asked, terms=terms, qid="_ask", **options)
    first = F.min("filters_dropped").over(Window.partitionBy(qid))
    kept = hits.select("_ask.*", *hits.columns[1:]).withColumn("_first", first).filter(F.col("filters_dropped") == F.col("_first"))
    return kept.select(qid, *hits.columns[1:], "filters_dropped")


def search_pipeline(
    records: DataFrame, requests: DataFrame, *, embed: Callable[[Column], Column], terms: Sequence[Term] = FLIGHT_TERMS,
    generate: Callable[[Column], Column] | None = None, scorer: Callable[[Column, Column], Column] | None = None,
    limit: str = "limit", threshold: float | str | None = SCORE_THRESHOLD, fetch: int = RERANK_FETCH, most: int = RERANK_RETURN,
    doc: str = "doc", fields: Sequence[str] = HIT_FIELDS, id_col: str = "flight_id", qid: str = "query_id", query: str = "query",
    **options: Any,
) -> DataFrame:
    """The whole way from query texts to hits: ``(qid, rank, id, score, filters_dropped, *fields)``.

    A text is generated for each distinct query (``generate``, else the query itself stands), embedded, and searched for under the
    request's filters, or without them if they leave nothing. With a ``scorer``, ``fetch`` hits are fetched whatever the limit,
    ordered by their pair score, and ``most`` or the limit, if that is smaller, are returned; else the limit counts. A null limit
    means ``DEFAULT_LIMIT``, and a filter field that the requests lack is not set. The text of a record comes along with its hit out of the one scan, so no table is joined to the hits.
    """
    missing = {t.field: F.lit(None).cast("string" if t.kind in ("keyword", "band") else "int") for t in terms if t.field not in requests.columns}
    asked = requests.withColumns(missing).withColumn("_limit", F.coalesce(limit, F.lit(DEFAULT_LIMIT)))
    asked = asked.withColumn("generated", F.col(query)) if generate is None else generate_once(asked, generate, query)
    # Written: the model answers once, however often the requests are read.
    asked = write_out(asked.withColumn("embedding", embed(F.col("generated"))), "asked")
    keep = [*fields, *([doc] if scorer and doc not in fields else [])]
    hits = search_with_fallback(
        records, asked, terms=terms, qid=qid, k=fetch_size("_limit", scorer is not None, fetch), threshold=threshold, id_col=id_col,
        keep=keep, **options)
    if scorer is not None:
        # At most ``fetch`` rows a request.
        told = hits.join(asked.select(qid, query, "_limit"), qid)
        best = rerank(told, scorer, most, query, doc, qid).filter(F.col("rerank") <= F.col("_limit"))
        hits = best.withColumn("rank", F.col("rerank"))
    return hits.select(qid, "rank", id_col, "score", "filters_dropped", *fields)


def search_responses(requests: DataFrame, hits: DataFrame, filters: Sequence[Term], qid: str = "query_id") -> DataFrame:
    """One row per request: number of results and whether its filter was given up, also when nothing was found."""
    counts = hits.groupBy(qid).agg(F.count("*").alias("n"), F.max("filters_dropped").alias("dropped"))
    return requests.withColumn("_filtered", has_filter(filters)).join(counts, qid, "left").select(
        qid,
        F.coalesce("n", F.lit(0)).cast("long").alias("n_results"),
        F.coalesce("dropped", F.col("_filtered")).alias("filters_dropped"),
    )


def rerank(
    candidates: DataFrame,
    scorer: Callable[[Column, Column], Column],
    top_n: int,
    query: str = "query",
    doc: str = "doc",
    qid: str = "query_id",
    digits: int | None = 9,
) -> DataFrame:
    """Second ranking stage: order the candidates of a request by a pair score, ties keeping their first rank.

    Returns the candidates with ``rerank`` added; ``score`` stays the retrieval score. Candidates per request are
    bounded by the fetch size of the first stage.
    """
    pair = scorer(F.col(query), F.col(doc))
    scored = candidates.withColumn("pair_score", F.round(pair, digits) if digits is not None else pair)
    return top_k(scored, [qid], [F.col("pair_score").desc(), F.col("rank").asc()], top_n, "rerank")


def fetch_size(limit: int | str, reranking: bool, fetch: int = RERANK_FETCH) -> int | str:
    """Candidates to fetch: with reranking a fixed number whatever the limit."""
    return fetch if reranking else limit


def candidate_sets(hits: DataFrame, id_col: str, doc: str, qid: str = "query_id") -> DataFrame:
    """One row per request with its candidates in rank order (at most the fetch size). Hits carry their texts (``keep=[doc]``)."""
    item = F.struct("rank", F.col(id_col).alias("id"), "score", F.col(doc).alias("doc"))
    return hits.groupBy(qid).agg(F.array_sort(F.collect_list(item)).alias("candidates"))


def by_id(requests: DataFrame, records: DataFrame, key: str = "flight_id") -> DataFrame:
    """Point lookups: every request row, record columns null and ``error`` set where the id is empty or unknown.

    Empty ids take no part in the join, so that they are no hot key of it.
    """
    empty = F.coalesce(F.col(key), F.lit("")) == ""
    found = requests.filter(~empty).join(records.withColumn("_found", F.lit(True)), key, "left")
    told = found.withColumn("error", F.when(F.col("_found").isNull(), "FLIGHT_NOT_FOUND")).drop("_found")
    return told.unionByName(requests.filter(empty).withColumn("error", F.lit("MISSING_FLIGHT_ID")), allowMissingColumns=True)


def generate_once(
    requests: DataFrame, make: Callable[[Column], Column], query: str = "query", memo: DataFrame | None = None,
    now: Column | None = None, ttl_seconds: int = 3600,
) -> DataFrame:
    """Adds ``generated``: ``make(query)`` evaluated once per distinct text (null or empty falls back to the text).

    ``memo`` holds ``(query, generated, ts)`` of earlier runs; entries at most ``ttl_seconds`` old are reused. Texts meet by their hash, and
    the requests of a hot text are spread over tasks.
    """
    texts = requests.select(query).distinct()
    if memo is None:
        made = texts.withColumn("generated", make(F.col(query)))
    else:
        fresh = memo.filter(F.timestamp_diff("SECOND", F.col("ts"), now) <= ttl_seconds)
        known = top_k(fresh, [query], [F.col("ts").desc()], 1).select(query, "generated")
        missing = texts.join(known.withColumnRenamed(query, "_known"), F.col(query).eqNullSafe(F.col("_known")), "left_anti").withColumn("generated", make(F.col(query)))
        made = known.join(texts, query, "left_semi").unionByName(missing)
    made = made.withColumn("generated", F.coalesce(F.nullif("generated", F.lit("")), F.col(query)))
    made = made.withColumnRenamed(query, "_asked")
    return salted_join(requests, made, query, "_asked", how="inner").select(*requests.columns, "generated")


def sample_centroids(samples: DataFrame, embed: Callable[[Column], Column], text: str, qid: str = "query_id") -> DataFrame:
    """Mean vector of several generated texts per request."""
    return vectors.centroids(samples.withColumn("_e", embed(F.col(text))), [qid], "_e")


# ---- approximate search: sign cells -----------------------------------------------------------------------

def sign_cell(vec: Column, bits: int, dim: int) -> Column:
    """Cell number of a vector: the signs of ``bits`` sparse projections (each the sum of three coordinates)."""
    cell = F.lit(0)
    for b in range(bits):
        at = [(b * 7 + 3) % dim, (b * 13 + 5) % dim, (b * 29 + 11) % dim]
        total = sum((F.try_element_at(vec, F.lit(i + 1)).cast("double") for i in at), F.lit(0.0))
        cell = cell + F.when(total >= 0, 1 << b).otherwise(0)
    return cell.cast("int")


def approximate_search(
    records: DataFrame, requests: DataFrame, *, bits: int = 4, dim: int = 64, qid: str = "query_id",
    cell: str = "cell", **options: Any,
) -> DataFrame:
    """Search only the cells at most one sign away from the request's own, then rank exactly.

    ``records`` may already have its ``cell`` (written partitioned by it, the scan then prunes); a hot cell costs
    nothing extra because records are scored where they lie and never grouped by cell.
    """
    if cell not in records.columns:
        records = records.withColumn(cell, sign_cell(F.col(options.get("vec_col", "embedding")), bits, dim))
    own = sign_cell(F.col(options.get("qvec", "embedding")), bits, dim)
    near = F.array(own, *[own.bitwiseXOR(F.lit(1 << b)) for b in range(bits)])
    probes = requests.withColumn("_probe", F.explode(near))
    return vector_search(records, probes, terms=[Term("integer", "_probe", cell)], qid=qid, **options)
