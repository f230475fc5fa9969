"""Approximate search on a cell layout: records stored by the nearest of many centres, a request reads its nearest cells only.

Centres come from k-means over a bounded sample of unit vectors; every record is stored, those without direction in a cell of their
own that no request reads. How many cells a request has to read for a wanted recall depends on the vectors, so it is measured:
``enough_probes`` takes the hits of one exact search and looks up how near their cells are to the requests.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from recallgrid.operators.filters import Term
from recallgrid.operators.search import BLOCK_CELLS, vector_search
from recallgrid.session import write_out

#: Records of a cell.
CELL_ROWS = 100_000
#: Most cells; beyond CELL_ROWS times as many records, the cells grow.
MOST_CELLS = 4096
#: Sampled records a cell, for the centres only.
SAMPLE_PER_CELL = 256
#: Requests that ``enough_probes`` looks at.
MEASURED_REQUESTS = 1000
#: Cell of records without direction, or of another dimension.
NO_CELL = -1
#: Requests that one scan serves.
_SCAN_REQUESTS = 4096


def fit_centres(
    records: DataFrame, dim: int, vec: str = "embedding", cell_rows: int = CELL_ROWS, most_cells: int = MOST_CELLS, seed: int = 0,
) -> np.ndarray:
    """Centres, one a row, for cells of about ``cell_rows`` records: spherical k-means over at most about 256 records a cell.

    The number of cells is further bounded so that the centres stay within the bound of a block of requests.
    """
    usable = records.filter(_length(F.col(vec), dim) > 0).select(F.col(vec).cast("array<double>").alias("_v"))
    rows = usable.count()
    cells = int(max(1, min(-(-rows // cell_rows), most_cells, BLOCK_CELLS // dim)))
    share = min(1.0, cells * SAMPLE_PER_CELL / max(rows, 1))
    length = _length(F.col("_v"), dim)
    unit = usable.sample(share, seed=seed).select(F.transform("_v", lambda x: x / length).alias("_v"))
    # Written: the sample is read once a round.
    points = write_out(unit, "sample").select(array_to_vector("_v").alias("features"))
    if points.isEmpty():
        return np.zeros((1, dim))
    model = KMeans(k=cells, maxIter=10, seed=seed, initMode="random").fit(points)
    centres = np.array(model.clusterCenters())
    return centres / np.maximum(np.linalg.norm(centres, axis=1), 1e-12)[:, None]


def _length(vec: Column, dim: int) -> Column:
    """Length of a vector of ``dim`` finite numbers, else null."""
    squares = F.aggregate(vec, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    good = (F.size(vec) == dim) & ~F.isnan(squares) & (squares < float("inf"))
    return F.when(good, F.sqrt(squares))


def nearest_cells(spark: SparkSession, centres: np.ndarray, most: int) -> Callable[[Column], Column]:
    """The ``most`` nearest cells of a vector, nearest first; empty for a vector without direction or of another dimension."""
    shared = spark.sparkContext.broadcast(centres)
    most = min(most, len(centres))

    @F.pandas_udf("array<int>")
    def nearest(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for vecs in parts:
            yield pd.Series([c if g else c[:0] for c, g in _nearest(vecs, shared.value, most)], index=vecs.index)

    return nearest


def _nearest(vecs: pd.Series, at: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, bool]]:
    """The nearest centres of each vector and whether it has a direction, from products of at most ``BLOCK_CELLS`` numbers or so."""
    step = max(1, BLOCK_CELLS // len(at))
    for start in range(0, len(vecs), step):
        part = vecs.iloc[start : start + step]
        good = np.array([v is not None and len(v) == at.shape[1] for v in part], dtype=bool)
        m = np.zeros((len(part), at.shape[1]))
        if good.any():
            m[good] = np.stack([np.asarray(v, dtype="float64") for v in part[good]])
        length = np.linalg.norm(m, axis=1)
        good &= np.isfinite(length) & (length > 0)
        cells = np.argsort(-(np.where(good[:, None], m, 0.0) @ at.T), axis=1, kind="stable")[:, :most].astype("int32")
        yield from zip(cells, good)


def _reach(spark: SparkSession, centres: np.ndarray, most: int) -> Callable[[Column], Column]:
    """The nearest cell of a vector and the bits of its ``most`` nearest, for ``vector_search(within=)``; nulls without direction."""
    shared = spark.sparkContext.broadcast(centres)
    most = min(most, len(centres))

    @F.pandas_udf("first int, bits binary")
    def reach(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for vecs in parts:
            rows = []
            for cells, good in _nearest(vecs, shared.value, most):
                bits = np.zeros(len(shared.value), dtype="uint8")
                bits[cells] = 1
                rows.append((int(cells[0]), np.packbits(bits, bitorder="little").tobytes()) if good else (None, None))
            yield pd.DataFrame(rows, columns=["first", "bits"]).astype({"first": "Int32"})

    return reach


def write_cells(
    records: DataFrame, path: str, dim: int, vec: str = "embedding", centres: np.ndarray | None = None, mode: str = "error", **fit: Any,
) -> None:
    """Store records by cell, with the centres beside them. ``mode="append"`` adds records to a stored index by its own centres.

    The rebalance hint splits a cell with most of the records over files.
    """
    spark = records.sparkSession
    if mode == "append":
        centres = read_centres(spark, path)
    else:
        centres = fit_centres(records, dim, vec, **fit) if centres is None else centres
        spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>").coalesce(1).write.mode(
            mode).parquet(f"{path}/centres")
    own = F.try_element_at(nearest_cells(spark, centres, 1)(F.col(vec)), F.lit(1))
    placed = records.withColumn("cell", F.coalesce(own, F.lit(NO_CELL)))
    placed.hint("rebalance", "cell").sortWithinPartitions("cell").write.mode(mode).partitionBy("cell").parquet(f"{path}/records")


def read_centres(spark: SparkSession, path: str) -> np.ndarray:
    """The centres by cell number; ``fit_centres`` bounds their size."""
    rows = spark.read.schema("cell int, centre array<double>").parquet(f"{path}/centres").orderBy("cell").collect()
    return np.array([r["centre"] for r in rows])


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """The stored records with their ``cell``."""
    return spark.read.parquet(f"{path}/records")


def _groups(counts: Sequence[tuple[int, int]], most: int) -> Iterator[list[int]]:
    """Cells in order, as many together as ``most`` requests allow; a cell with more is alone."""
    taken: list[int] = []
    total = 0
    for cell, n in counts:
        if taken and total + n > most:
            yield taken
            taken, total = [], 0
        taken.append(cell)
        total += n
    if taken:
        yield taken


def cell_search(
    spark: SparkSession, path: str, requests: DataFrame, probes: int, *, k: int | str = 10, terms: Sequence[Term] = (),
    id_col: str = "flight_id", qid: str = "query_id", qvec: str = "embedding", scan_probes: int = _SCAN_REQUESTS, **options: Any,
) -> DataFrame:
    """The best ``k`` records of every request among its ``probes`` nearest cells; columns and ties as in ``vector_search``.

    Requests are taken in groups of about ``scan_probes`` by their nearest cell. One scan serves a group: it reads only the folders of the
    cells that some request of it probes, and scores the records of a cell for the requests that probe it. So there are as
    many scans as blocks of requests, however many cells each probes. Hits of each of several groups (at most k a request) are written out.
    """
    centres = read_centres(spark, path)
    records = read_cells(spark, path)
    near = requests.withColumn("_near", _reach(spark, centres, probes)(F.col(qvec)))
    dealt = write_out(near.select("*", F.col("_near.first").alias("_first"), F.col("_near.bits").alias("_bits")).drop("_near").filter(
        F.col("_first").isNotNull()), "probes")
    counts = dealt.groupBy("_first").agg(F.count("*").alias("n")).orderBy("_first").collect()  # a row a cell
    found = None
    groups = list(_groups([(r["_first"], r["n"]) for r in counts], scan_probes)) or [[NO_CELL]]
    for cells in groups:
        hits = vector_search(
            records, dealt.filter(F.col("_first").isin(*cells)), k=k, terms=terms, id_col=id_col, qid=qid, qvec=qvec,
            within=("_bits", "cell"), **options)
        if len(groups) == 1:
            return hits
        hits = write_out(hits, "hits")
        found = hits if found is None else found.unionByName(hits)
    return found


def enough_probes(
    spark: SparkSession, path: str, requests: DataFrame, target: float = 0.9, *, k: int = 10, id_col: str = "flight_id",
    qid: str = "query_id", qvec: str = "embedding", most: int = MEASURED_REQUESTS, **options: Any,
) -> int:
    """The least number of probes with which the mean recall of ``k`` reaches ``target`` on at most ``most`` of the requests.

    One exact search over the whole index; the requests measured are those with the least hashes of their id.
    """
    centres = read_centres(spark, path)
    some = write_out(requests.select(qid, F.col(qvec).alias("embedding")).orderBy(F.xxhash64(qid), qid).limit(most), "measured")
    exact = vector_search(read_cells(spark, path), some, k=k, threshold=None, id_col=id_col, qid=qid, keep=["cell"], **options)
    order = some.select(qid, F.posexplode(nearest_cells(spark, centres, len(centres))(F.col("embedding"))).alias("_at", "cell"))
    per_request = exact.join(order, [qid, "cell"]).groupBy(qid, "_at").agg(F.count("*").alias("n"))
    share = per_request.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(qid)))
    gained = share.groupBy("_at").agg(F.sum("share").alias("gain")).orderBy("_at").collect()  # at most a row a cell
    if not gained:
        return 1
    reached = np.cumsum([r["gain"] for r in gained]) / sum(r["gain"] for r in gained)
    return int(gained[int(np.searchsorted(reached, target - 1e-9))]["_at"]) + 1
