"""Event streams in the message envelope."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..schemas import ENVELOPE

# --- fixed values: records per trigger and offsets of the broker source ----------------
RECORDS_PER_TRIGGER = 500
STARTING_OFFSETS = "latest"
# --------------------------------------------------------------------------------------


def broker_stream(
    spark: SparkSession, servers: str, topic: str, records_per_trigger: int = RECORDS_PER_TRIGGER,
    starting_offsets: str = STARTING_OFFSETS,
) -> DataFrame:
    """Subscribe to a topic. Needs the Kafka package on the cluster's class path.

    ``records_per_trigger`` is the rate limit: raise it with the cluster; the default is
    far below what one executor handles.
    """
    return (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", starting_offsets)
        .option("maxOffsetsPerTrigger", records_per_trigger)
        .load()
    )


def file_stream(
    spark: SparkSession, path: str, files_per_trigger: int | None = None, schema: T.StructType = ENVELOPE,
    fmt: str = "parquet",
) -> DataFrame:
    """The same envelope from files that arrive in a folder, rate-limited by files."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.format(fmt).load(path)
