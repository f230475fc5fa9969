"""Session settings, and the shared folder used for written intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_local_root: str | None = None
#: Folders that ``write_out`` made inside the ``passing_tables`` of this thread, None outside.
_passing: ContextVar[list[str] | None] = ContextVar("passing", default=None)


def build_session(app: str = "recallgrid", master: str | None = None, **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        # No call-site capture for every Column call; it doubles the time to build wide expressions.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        # Generated methods beyond 8000 bytes are never compiled by HotSpot; split expressions instead.
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir``.

    Only a local master, where all executors live in this process, may fall back to a temporary folder.
    """
    global _local_root
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    if _local_root is None:
        _local_root = tempfile.mkdtemp(prefix="recallgrid-")
    return _local_root


def shared_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no earlier run has used."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def write_out(df: DataFrame, name: str = "stage") -> DataFrame:
    """Cut lineage: write ``df`` as Parquet into the shared folder, once, and read it back.

    Survives executor loss (the files are in shared storage), unlike a cached or locally checkpointed table.
    """
    path = shared_path(df.sparkSession, name)
    passing = _passing.get()
    if passing is not None:
        passing.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared storage, if it is there."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def passing_tables(spark: SparkSession) -> Iterator[None]:
    """Remove, on leaving, the tables that ``write_out`` wrote inside; for work that is over by then, such as a batch of a stream.

    Tables of other threads stay, and so do those written outside. A table returned from inside can no longer be read.
    """
    made: list[str] = []
    outer = _passing.set(made)
    try:
        yield
    finally:
        _passing.reset(outer)
        for path in made:
            remove(spark, path)
