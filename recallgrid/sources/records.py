"""Record files: CSV with null tokens, zip archives holding a CSV, and the choice between them."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from recallgrid.schema import NA_TOKENS, PAYLOAD


def null_tokens(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Null for every text that stands for a missing value."""
    names = columns if columns is not None else [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    tokens = ", ".join(f"'{t}'" for t in NA_TOKENS)
    return df.withColumns({c: F.expr(f"CASE WHEN `{c}` NOT IN ({tokens}) THEN `{c}` END") for c in names})


def read_csv(spark: SparkSession, path: str, multi_line: bool = True, position: str | None = None) -> DataFrame:
    """CSV with a header, every column as text, null tokens applied.

    Quoted line breaks are part of their field; for files known to have none, ``multi_line=False`` reads a large file in splits.
    ``position`` adds an order by file, block and line. It is the same on every retry: the row number only counts
    within the rows a task reads, which depend on the file layout alone.
    """
    df = spark.read.csv(path, header=True, multiLine=multi_line, escape='"')
    names = df.columns
    if position:
        df = df.select("*", F.struct(
            F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("line")).alias(position))
    return null_tokens(df, names)


def _openable(path: str) -> tuple[fs.FileSystem, str] | None:
    """Where executors can open a path and seek in it by themselves, or None if they do not know its scheme."""
    scheme, _, rest = path.partition(":")
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    try:
        return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
    except (pa.ArrowException, OSError, ValueError):
        return None


def _csv_rows(held, name: str, columns: Sequence[str], chunk: int) -> Iterator[pd.DataFrame]:
    """Rows of the first CSV entry of an open archive, in chunks. The entry is unpacked as it is read."""
    with zipfile.ZipFile(held) as z:
        entries = [n for n in z.namelist() if n.lower().endswith(".csv")]
        if not entries:
            raise ValueError(f"no CSV in archive {name}")
        with z.open(entries[0]) as f:
            done = 0
            for part in pd.read_csv(f, dtype=str, keep_default_na=False, chunksize=chunk):
                part = part.reindex(columns=list(columns)).astype(object)
                part = part.where(part.notna(), None)
                part["archive"], part["row_no"] = name, range(done, done + len(part))
                done += len(part)
                yield part


def read_zip(spark: SparkSession, path: str, columns: Sequence[str] = PAYLOAD, chunk: int = 20_000) -> DataFrame:
    """Rows of the first ``.csv`` entry of each archive, as text; archives are read in parallel.

    ``path`` may be an archive, a folder or a glob. An archive without a CSV fails the job. Only paths go to the tasks, which open the
    archives where they lie and unpack them piece by piece, so that an archive may have any size. Storage that tasks
    cannot open by themselves is read through Spark, an archive as one value of at most 2 GB.
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns] + [
        T.StructField("archive", T.StringType()), T.StructField("row_no", T.LongType())])
    files = spark.read.format("binaryFile").load(path)
    some = files.select("path").limit(1).collect()
    direct = bool(some) and _openable(some[0][0]) is not None

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name in frame["path"]:
                store, place = _openable(name)
                with store.open_input_file(place) as held:
                    yield from _csv_rows(held, name, columns, chunk)

    def held_rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"]):
                yield from _csv_rows(io.BytesIO(content), name, columns, chunk)

    found = files.select("path").mapInPandas(rows, schema) if direct else files.select("path", "content").mapInPandas(held_rows, schema)
    return null_tokens(found, list(columns))


def read_records(spark: SparkSession, path: str, columns: Sequence[str] = PAYLOAD, multi_line: bool = True) -> DataFrame:
    return read_zip(spark, path, columns) if path.lower().endswith(".zip") else read_csv(spark, path, multi_line)
