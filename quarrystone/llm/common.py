"""What the training-data operators share: the shared folder and keyed views of a documents table."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words in every word-based contract.
SPACE = r"\x20\x09-\x0D"

_made: list[str] = []


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir).

    Only where that setting is missing and all runs on this machine, as in tests, a folder of it stands in."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "quarrystone-shared")
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: its lineage is cut and survives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clean_shared(spark: SparkSession) -> None:
    """Delete every table that this process stored; call it when the results have been consumed."""
    conf = spark._jsc.hadoopConfiguration()
    while _made:
        p = spark._jvm.org.apache.hadoop.fs.Path(_made.pop())
        p.getFileSystem(conf).delete(p, True)


def file_system(path: str):
    """The pyarrow file system of a path and the path inside it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if ":" in path.split("/", 1)[0] else (fs.LocalFileSystem(), path)


def whole_text(column: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def id_text(docs: DataFrame) -> DataFrame:
    """doc_id long and text string (null: empty), whatever else the table holds."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))


def _give_back() -> None:
    """Freed memory goes back to the system, so that workers that wait hold little."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def in_slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in small batches, so that Python holds few long texts at once."""
    _give_back()
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
    _give_back()


def by_chars(batches: Iterator[pa.RecordBatch], column: int = 1, size: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose column (of strings) holds at most about size bytes, or of one row."""
    _give_back()
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < b.num_rows:
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right")))
            yield b.slice(at, stop - at)
            at = stop
    _give_back()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
