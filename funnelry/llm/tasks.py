"""Helpers for Arrow tasks: state that outlives a task, and stored intermediate tables."""

from __future__ import annotations

import sys
import types
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def worker_state() -> dict:
    """A dict of this Python worker process, for caches that may outlive a task."""
    name = "_funnelry_worker_state"
    if name not in sys.modules:
        module = types.ModuleType(name)
        module.state = {}
        sys.modules[name] = module
    return sys.modules[name].state


def small_batches(spark: SparkSession, rows: int = 2000, size: str = "8m") -> None:
    """Bounds what one Arrow batch to a task holds, unless the session says otherwise already."""
    for key, default, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", str(rows)),
                                ("spark.sql.execution.arrow.maxBytesPerBatch", None, size)):
        now = spark.conf.get(key)
        if default is None or now == default:
            spark.conf.set(key, value)


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names. Only a local master may leave it unset."""
    from ..session import ensure_checkpoint_dir

    return ensure_checkpoint_dir(spark)


def stored(frame: DataFrame, name: str) -> DataFrame:
    """``frame`` as a written table in the shared folder: cuts the lineage, and later
    readers start from its files when an executor is lost."""
    spark = frame.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def column(name: str) -> Column:
    """The column of that name, dots, blanks and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def record_batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)
