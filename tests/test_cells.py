import glob
import re
import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from recallgrid.operators import cells, search
from recallgrid.operators.filters import Term

DIM = 8


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """Vectors in 12 clusters, one of them with a third of the rows; some rows without direction."""
    rng = np.random.default_rng(3)
    at = rng.normal(size=(12, DIM))
    which = np.where(rng.random(1500) < 0.33, 0, rng.integers(0, 12, 1500))
    rows = [(i, (at[c] + 0.3 * rng.normal(size=DIM)).tolist(), int(i % 3)) for i, c in enumerate(which)]
    rows += [(2000, None, 0), (2001, [0.0] * DIM, 0), (2002, [1.0], 0), (2003, [float("nan")] * DIM, 0)]
    records = spark.createDataFrame(rows, "id int, embedding array<double>, third int")
    path = str(tmp_path_factory.mktemp("cells") / "index")
    cells.write_cells(records, path, DIM, cell_rows=100)
    asked = spark.createDataFrame(
        [(i, (at[i % 12] + 0.3 * rng.normal(size=DIM)).tolist(), i % 4 + 1, i % 3) for i in range(60)]
        + [(60, [0.0] * DIM, 3, 0), (61, None, 3, 0)], "query_id int, embedding array<double>, k int, want int")
    return records, path, asked


def hits(df):
    return sorted((r.query_id, r["rank"], r.id, r.score) for r in df.collect())


def test_every_record_is_stored_in_its_nearest_cell(spark, stored):
    records, path, _ = stored
    got = {r.id: r.cell for r in cells.read_cells(spark, path).select("id", "cell").collect()}
    centres = cells.read_centres(spark, path)
    assert len(centres) == 15 and len(got) == 1504
    for r in records.collect():
        if r.id >= 2000:
            assert got[r.id] == cells.NO_CELL
        else:
            score = centres @ np.array(r.embedding)
            assert score[got[r.id]] >= score.max() - 1e-12


def test_all_cells_are_the_exact_search(spark, stored):
    records, path, asked = stored
    for options in (dict(k=10), dict(k="k"), dict(k=5, terms=[Term("integer", "want", "third")])):
        exact = hits(search.vector_search(records, asked, threshold=None, id_col="id", **options))
        for scan in (4096, 50, 7):  # one scan, some, a scan for nearly every cell
            got = cells.cell_search(spark, path, asked, 15, threshold=None, id_col="id", scan_probes=scan, **options)
            assert hits(got) == exact


def test_measured_probes_reach_the_recall(spark, stored):
    _, path, asked = stored
    exact = {(r.query_id, r.id) for r in search.vector_search(
        cells.read_cells(spark, path), asked, k=10, threshold=None, id_col="id").collect()}
    probes = cells.enough_probes(spark, path, asked, 0.9, id_col="id")
    recalls = []
    for p in (probes - 1, probes):
        got = {(r.query_id, r.id) for r in cells.cell_search(spark, path, asked, p, threshold=None, id_col="id").collect()} if p else set()
        recalls.append(len(got & exact) / len(exact))
    assert recalls[0] < 0.9 <= recalls[1] and probes < 8


def test_only_the_cells_asked_are_read(spark, stored, tmp_path):
    _, path, asked = stored
    got = cells.cell_search(spark, path, asked.filter("query_id = 3"), 2, threshold=None, id_col="id")
    plan = got._jdf.queryExecution().executedPlan().toString()
    named = re.search(r"PartitionFilters: \[(.*?)\], PushedFilters", plan).group(1)
    asked_cells = {int(c) for c in re.findall(r"-?\b\d+\b", re.sub(r"#\d+", "", named))}
    assert 1 <= len(asked_cells) <= 2, named
    # Nothing else is opened: the files of all other cells may be broken (Spark takes the schema from one of cell -1).
    broken = str(tmp_path / "broken")
    shutil.copytree(path, broken)
    for folder in glob.glob(f"{broken}/records/cell=*"):
        if int(folder.split("cell=")[1]) not in {*asked_cells, cells.NO_CELL}:
            for file in glob.glob(f"{folder}/*.parquet"):
                open(file, "wb").write(b"broken")
    again = cells.cell_search(spark, broken, asked.filter("query_id = 3"), 2, threshold=None, id_col="id")
    assert hits(again) == hits(got)


def test_empty_index_and_append(spark, stored, tmp_path):
    records, _, asked = stored
    path = str(tmp_path / "index")
    cells.write_cells(records.limit(0), path, DIM)
    assert len(cells.read_centres(spark, path)) == 1
    cells.write_cells(records, path, DIM, mode="append")
    got = cells.cell_search(spark, path, asked, 1, threshold=None, id_col="id")
    assert hits(got) == hits(search.vector_search(records, asked, k=10, threshold=None, id_col="id"))
    none = asked.filter(F.col("query_id") >= 60)
    assert cells.cell_search(spark, path, none, 1, threshold=None, id_col="id").count() == 0
    assert cells.enough_probes(spark, path, none, id_col="id") == 1


def test_probes_make_no_scans(spark, stored, monkeypatch):
    """A scan serves as many requests as it may, however many cells each of them reads."""
    _, path, asked = stored
    scans = []

    def counted(*args, **options):
        scans.append(1)
        return search.vector_search(*args, **options)

    monkeypatch.setattr(cells, "vector_search", counted)
    got = cells.cell_search(spark, path, asked, 15, threshold=None, id_col="id", scan_probes=100)
    assert got.select("query_id").distinct().count() == 60 and len(scans) == 1
