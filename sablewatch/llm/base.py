"""What the operators share: reading tables, per-worker memory, batch plumbing."""

from __future__ import annotations

import sys
import types

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from sablewatch.session import prepare

#: Rows of one Arrow batch sent to Python. Texts may be long, so batches stay short.
BATCH_ROWS = 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def per_worker(name: str, key, build):
    """The value ``build`` makes for ``key``, kept until this Python worker needs another name or key.

    Functions travel to workers by value, so a module-level cache would be new in each task. A worker
    serves one operator after the other for as long as its executor lives, so it holds the last one's value only.
    """
    holder = sys.modules.setdefault("_sablewatch_worker", types.ModuleType("_sablewatch_worker"))
    store = holder.__dict__.setdefault("store", {})
    if store.get(name, (None,))[0] != key:
        store.clear()
        store[name] = (key, build())
    return store[name][1]


def slices(batches, rows: int = 128):
    """Record batches cut to at most ``rows`` rows, which bounds what one step holds."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """Texts of a batch; a null text counts as empty."""
    return [t or "" for t in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def with_column(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    """The batch with the named column replaced; its type is kept."""
    at = batch.schema.get_field_index(name)
    field = batch.schema.field(at)
    return batch.set_column(at, field, values.cast(field.type))
