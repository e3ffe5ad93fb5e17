"""Reading tables, keeping intermediate tables in the shared folder, and small shared columns."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.session import checkpoint_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def kept(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared checkpoint folder and read back: a short lineage that survives executors."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else; null becomes the empty text."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower()))


def text_key(text: Column) -> Column:
    """Tells apart rows that share an id but not the text."""
    return F.xxhash64(F.coalesce(text, F.lit("")), text.isNull())


def id_crc(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def _cuts(texts: pa.Array, limit: int) -> Iterator[tuple[int, int]]:
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(texts):
        before = sizes[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(sizes, before + limit, side="right")))
        yield start, end
        start = end


def chunks(batch: pa.RecordBatch, column: str, limit: int = 6 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` with about ``limit`` bytes of ``column``, one row at least, so that memory does not follow row sizes."""
    for start, end in _cuts(batch[column], limit):
        yield batch.slice(start, end - start)


def by_chunk(run, texts: pa.Array, limit: int = 6 << 20) -> np.ndarray:
    """What ``run`` gives for slices of ``texts``, end to end."""
    return np.concatenate([run(texts.slice(a, b - a)) for a, b in _cuts(texts, limit)] or [np.empty(0)])


_resident: dict[Any, Any] = {}


def resident(key: Any, build: Callable[[], Any] = lambda: None) -> Any:
    """``build()``, kept in this worker process for later tasks until one asks for something else.

    Spark uses a worker for task after task, of one operator and of the next; so the tables of one do not stay beside
    those of another. A task without tables calls ``resident(None)``.
    """
    if key not in _resident:
        if _resident:
            _resident.clear()
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc keeps freed memory otherwise
            if trim:
                trim(0)
        _resident[key] = build()
    return _resident[key]
