"""Reading, storing and mapping tables for the operators of this subpackage."""

from __future__ import annotations

import gc
import os
import zlib
from collections.abc import Callable, Hashable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vinculo.llm.bytewords import slices
from vinculo.operators.scale import materialize

#: Largest number of 64-bit ids that is sent to every executor (a table of 16 MB); beyond it, ids are joined by a shuffle.
MOST_SENT_IDS = 1 << 20


_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def importable(spark: SparkSession) -> None:
    """Let Python workers that see this folder import the package from it (other clusters get it by ``--py-files``), in small batches."""
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if _ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [_ROOT, *paths]))
    # Rows here are whole texts: the default of 10,000 a batch is tens of megabytes on each side of every task.
    if spark.conf.get(_BATCH_ROWS) == "10000":
        spark.conf.set(_BATCH_ROWS, "1000")


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow`` with functions of this package."""
    importable(df.sparkSession)
    return df.mapInArrow(run, schema)


_in_worker: dict[Hashable, Any] = {}


def held_in_worker(key: Hashable, make: Callable[[], Any]) -> Any:
    """An object that a Python worker keeps for its later tasks; it keeps the last one only, so stages don't add up."""
    if key not in _in_worker:
        _in_worker.clear()
        gc.collect()
        _in_worker[key] = make()
    return _in_worker[key]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_slices(
    df: DataFrame,
    make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]],
    schema: str,
    text: str = "text",
    most: int = 1 << 22,
) -> DataFrame:
    """``mapInArrow`` over slices of at most ``most`` bytes of ``text``.

    ``make`` is called once per task and returns the function for a slice, so
    what it loads (a vocabulary, say) is loaded once per task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = make()
        for batch in batches:
            for part in slices(batch, text, most):
                if (out := one(part)) is not None and out.num_rows:
                    yield out
        pa.default_memory_pool().release_unused()

    return map_batches(df, run, schema)


def only_ids(df: DataFrame, ids: DataFrame, name: str = "doc_id") -> DataFrame:
    """Rows of ``df`` whose id is in the stored table ``ids``, which is sent to all executors when its counted size is small."""
    ids = ids.select(name).distinct()
    if ids.count() <= MOST_SENT_IDS:
        ids = F.broadcast(ids)
    return df.join(ids, name, "left_semi")


def held_out(doc_id: str = "doc_id") -> Column:
    """The fold that no model learns from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def crc_fold(doc_id: int | None) -> bool:
    """``held_out`` of one id."""
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 4 == 2


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def int64s(values: pa.Array) -> np.ndarray:
    """A bigint column without nulls."""
    return values.cast(pa.int64()).to_numpy(zero_copy_only=False)


__all__ = ["MOST_SENT_IDS", "column", "crc_fold", "held_in_worker", "held_out", "importable", "int64s", "map_batches", "map_slices", "materialize", "only_ids", "table"]
