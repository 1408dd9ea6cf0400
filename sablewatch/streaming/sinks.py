"""Streaming sinks: lake zones and alert messages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.records import alert_messages

# --- fixed values: trigger intervals and zones -----------------------------------------
LAKE_TRIGGER, ALERT_TRIGGER = "30 seconds", "10 seconds"
ZONES = ("raw", "enriched", "curated")
# --------------------------------------------------------------------------------------


def _start(writer, interval: str, drain: bool) -> StreamingQuery:
    """Run by processing time, or process what is there and stop."""
    return writer.trigger(availableNow=True).start() if drain else writer.trigger(processingTime=interval).start()


def zone_path(root: str, zone: str, table: str) -> str:
    if zone not in ZONES:
        raise ValueError(f"zone must be one of {ZONES}")
    return f"{root.rstrip('/')}/{zone}/{table}"


def append_to_zone(
    stream: DataFrame, root: str, zone: str, table: str, checkpoint: str, time: str | None = None,
    fmt: str = "parquet", interval: str = LAKE_TRIGGER, drain: bool = False,
) -> StreamingQuery:
    """Append a stream to a lake zone, partitioned by event date when ``time`` is given.

    ``fmt`` may be ``delta`` where that package is installed. One checkpoint per query;
    a restarted query continues from it.
    """
    if time is not None:
        stream = stream.withColumn("date", F.to_date(time))
    writer = stream.writeStream.format(fmt).outputMode("append").option("checkpointLocation", checkpoint)
    if time is not None:
        writer = writer.partitionBy("date")
    return _start(writer.option("path", zone_path(root, zone, table)), interval, drain)


def send_alerts(
    alerts: DataFrame, checkpoint: str, servers: str | None = None, topic: str | None = None,
    path: str | None = None, interval: str = ALERT_TRIGGER, drain: bool = False,
) -> StreamingQuery:
    """Alerts as (key, JSON value) to a broker topic, or to JSON files at ``path``."""
    writer = alert_messages(alerts).writeStream.outputMode("append").option("checkpointLocation", checkpoint)
    if path is not None:
        writer = writer.format("json").option("path", path)
    else:
        writer = writer.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic)
    return _start(writer, interval, drain)


def by_batch(
    stream: DataFrame, write: Callable[[DataFrame, int, str], None], path: str, checkpoint: str,
    interval: str = LAKE_TRIGGER, drain: bool = False,
) -> StreamingQuery:
    """Call ``write(rows, batch, folder)`` for each trigger, each with a folder of its own below ``path``.

    A trigger that failed is repeated with the same rows and number, so a writer that overwrites its
    folder delivers each row once.
    """
    folder = f"{path.rstrip('/')}/batch={{}}".format
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda rows, batch: write(rows, batch, folder(batch)))
    return _start(writer, interval, drain)


def written(spark: SparkSession, path: str, schema: str, fmt: str = "parquet") -> DataFrame:
    """All rows a ``by_batch`` query wrote, with their batch."""
    return spark.read.schema(f"{schema}, batch long").format(fmt).load(path)


def progress(query: StreamingQuery) -> DataFrame:
    """The query's recent triggers that had input: ``(batch, rows)``. Spark keeps the last hundred."""
    rows = [(p["batchId"], p["numInputRows"]) for p in query.recentProgress if p["numInputRows"]]
    return SparkSession.active().createDataFrame(rows, "batch long, rows long")
