"""Shared helpers of the training-data operators.

Inputs may hold nulls, empty or very long texts, repeated rows and extra columns: every operator
selects the columns it needs by name first, so extra columns (whatever their names) never clash.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts_of(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text (null: empty) and the named further columns."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
        *more,
    )


def id_remainder(doc_id: str | Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo; a null id counts as empty text."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(col.cast("string"), F.lit(""))) % modulus


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_folder(spark: SparkSession) -> str:
    """A new path below the cluster's shared checkpoint folder.  Without one a cluster is an error; a local session, which has one machine, gets a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = jdir.get() if jdir.isDefined() else None
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"file://{tempfile.gettempdir()}/checkpoints"
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def stored(df: DataFrame, partition_by: str | None = None) -> DataFrame:
    """Write df once as a table in the shared folder and read it back: it cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = shared_folder(spark)
    writer = df.write.partitionBy(partition_by) if partition_by else df.write
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def lower_ascii(text: str) -> bytes:
    """UTF-8 bytes with A-Z lower-cased (bytes.lower touches ASCII letters only)."""
    return text.encode("utf-8", "replace").lower()


#: What operators keep in a worker between tasks, by operator: one operator's at a time.
_KEPT: dict[str, object] = {}


def kept(owner: str, make: Callable[[], object]) -> object:
    """The owner's object of this worker process, made at first use."""
    release(owner)
    if owner not in _KEPT:
        _KEPT[owner] = make()
    return _KEPT[owner]


def release(owner: str = "") -> None:
    """Drop what other operators keep and give the memory back: workers live on from stage to stage."""
    others = [k for k in _KEPT if k != owner]
    for k in others:
        del _KEPT[k]
    if others:
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL("libc.so.6").malloc_trim(0)


def small_slices(batches: Iterator[pa.RecordBatch], max_chars: int = 4_000_000, owner: str = "") -> Iterator[pa.RecordBatch]:
    """Cut batches with a text column so that a slice holds about max_chars at most (one row at least)."""
    release(owner)
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            base = sizes[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(sizes, base + max_chars, side="right")))
            yield batch.slice(start, end - start)
            start = end


def batch_of(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)
