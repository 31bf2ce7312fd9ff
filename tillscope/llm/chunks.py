"""Corpus-wide counts by way of one dictionary per chunk of text.

A task cuts its rows into chunks of bounded size and writes one row per chunk: the
chunk's distinct keys with their counts, and its content in terms of positions in
that dictionary. Only dictionaries are exploded, summed and joined with the totals,
so a frequent key moves once per chunk and not once per occurrence.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillscope.session import scratch_path


def chunk_id(n: int) -> int:
    """An id of the ``n``-th chunk of this task; the same in every attempt."""
    return (TaskContext.get().partitionId() << 33) | n


def written(chunks: DataFrame, label: str) -> DataFrame:
    """The chunks as a table in the shared folder, computed once."""
    path = scratch_path(chunks.sparkSession, label)
    chunks.write.parquet(path)
    return chunks.sparkSession.read.schema(chunks.schema).parquet(path)


def entries(chunks: DataFrame, *columns: str) -> DataFrame:
    """``(chunk, at, *columns)``: one row per dictionary entry and its position."""
    return chunks.select(
        "chunk", F.posexplode(F.arrays_zip(*columns)).alias("at", "_e")
    ).select("chunk", "at", *[F.col(f"_e.{c}").alias(c) for c in columns])


def squeezed(values: np.ndarray) -> bytes:
    """An array of integers, compressed."""
    return pa.compress(np.ascontiguousarray(values).tobytes(), codec="zstd", asbytes=True)


def unsqueezed(data: bytes, n: int, kind: str) -> np.ndarray:
    """The ``n`` values that ``squeezed`` packed."""
    size = n * np.dtype(kind).itemsize
    return np.frombuffer(pa.decompress(data, size, codec="zstd", asbytes=True), kind)
