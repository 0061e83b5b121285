"""What several operators share: the tables, the shared folder, Arrow batches of texts."""

from __future__ import annotations

import ctypes
import gc
import sys
import types
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of anything but the space and the five ASCII white-space controls.
WORD = r"[^\x20\x09-\x0D]+"
HOLDER = "_tickloom_kept"
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A folder that the driver and all executors reach: spark.checkpoint.dir; where it is unset
    (tests), one beside the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    base = base or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "-checkpoints"
    return f"{base.rstrip('/')}/llm/{spark.sparkContext.applicationId}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df, stored as Parquet in the shared folder: cuts the lineage, is read by several branches,
    and survives executors. Shuffle files of the write are removed when it is over.

    The folder belongs to the application and may be deleted when that has ended.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(FREE_SHUFFLES, "false")
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(FREE_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


def kept(name: str, make: Callable[[], Any]) -> Any:
    """make(), once in a Python worker: what later tasks of the same stage find there again."""
    context = TaskContext.get()
    stage = context.stageId() if context else None
    holder = sys.modules.get(HOLDER)
    if holder is None or holder.stage != stage:
        forget()
        holder = sys.modules[HOLDER] = types.ModuleType(HOLDER)
        holder.stage = stage
    if not hasattr(holder, name):
        setattr(holder, name, make())
    return getattr(holder, name)


def forget() -> None:
    """Frees what another stage left in this worker by kept(), and gives free memory back to the
    system: a worker outlives its stage, and memories of stages must not add up."""
    if sys.modules.pop(HOLDER, None) is None:
        return
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)     # glibc's
    if trim is not None:
        trim(0)


def local(spark: SparkSession, rows: list[tuple], schema: pa.Schema) -> DataFrame:
    """A small table of the driver's, whose size the planner knows."""
    columns = list(zip(*rows)) or [()] * len(schema)
    return spark.createDataFrame(pa.Table.from_arrays(
        [pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema))


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def pieces(batch: pa.RecordBatch, column: str, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges of a batch whose texts have about `limit` bytes together, one row at least."""
    offsets = text_offsets(batch, column)
    start, rows = 0, batch.num_rows
    while start < rows:
        end = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        end = min(max(end, start + 1), rows)
        yield start, end
        start = end


def text_offsets(batch: pa.RecordBatch, column: str) -> np.ndarray:
    """Byte offsets of each value of a string or binary column without nulls."""
    array = batch.column(column)
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    kind = np.int64 if wide else np.int32
    buffer = array.buffers()[1]
    if buffer is None or not len(array):
        return np.zeros(len(array) + 1, np.int64)
    found = np.frombuffer(buffer, kind, len(array) + 1 + array.offset)[array.offset:]
    return found.astype(np.int64)


def text_bytes(batch: pa.RecordBatch, column: str, start: int, end: int) -> np.ndarray:
    """The joined bytes of rows start..end-1, not copied."""
    offsets = text_offsets(batch, column)
    low, high = int(offsets[start]), int(offsets[end])
    data = batch.column(column).buffers()[2]
    if data is None or high == low:
        return np.zeros(0, np.uint8)
    return np.frombuffer(data, np.uint8, high - low, low)
