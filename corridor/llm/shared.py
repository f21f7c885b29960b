"""Helpers shared by the training-data operators: shared folder, written tables, bounded batches."""

from __future__ import annotations

import os
import sys
import types
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from corridor.session import shared_dir

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

#: Text handled at once inside a task; the working set of a task is a small multiple of it.
SLICE_BYTES = 8 << 20


def workspace(spark: SparkSession, what: str) -> str:
    """A fresh folder name under the cluster's shared folder; Python workers learn where the package lies."""
    env = spark.sparkContext.environment
    if REPO not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (REPO, env.get("PYTHONPATH", "")) if x)
    return f"{shared_dir(spark)}/llm-{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, folder: str, codec: str = "zstd") -> DataFrame:
    """The rows as a table in the shared folder: cuts lineage, survives lost executors."""
    df.write.option("compression", codec).parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the column holds at most ``limit`` bytes (or one row) at a time."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        at, ends = 0, np.cumsum(sizes)
        while at < len(sizes):
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
            part = batch.slice(at, to - at)
            # a compact copy, so that offsets of the slice start at zero
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([c]) for c in part.columns], schema=part.schema)
            at = to


def grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Runs of rows with one value of ``key`` from batches sorted by it; one run is held at a time."""
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        values = batch.column(key).to_numpy()
        if held and held[0].column(key)[0].as_py() != values[0]:
            yield pa.concat_tables(held)
            held = []
        cuts = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(values)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            held.append(table.slice(a, b - a))
            if b < len(values):
                yield pa.concat_tables(held)
                held = []
    if held:
        yield pa.concat_tables(held)


def kept_in_worker(key: Any, make: Callable[[], Any]) -> Any:
    """A value made once per Python worker process (tokenizers, bounded caches)."""
    store = sys.modules.setdefault("_corridor_llm_worker", types.ModuleType("_corridor_llm_worker")).__dict__
    if key not in store:
        store[key] = make()
    return store[key]


def texts_of(batch: pa.RecordBatch, column: str = "text") -> pa.Array:
    """The text column with nulls as empty texts."""
    return pc.fill_null(batch.column(column), "")


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices starts[i], starts[i]+1, ... of each range, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def summed(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values over [offsets[i], offsets[i+1]), empty ranges giving zero."""
    total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])
    return total[offsets[1:]] - total[offsets[:-1]]
