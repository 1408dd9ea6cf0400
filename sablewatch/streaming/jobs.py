"""Complete streaming jobs, made of the operators batch uses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import analytics, enrich
from ..operators.detect import stream_detections
from ..operators.records import alert_messages, alert_rows
from ..sources import parse_flat_events
from ..sources.topics import quarantine_flat
from .sinks import ALERT_TRIGGER, by_batch, zone_path

# --- fixed values: lateness and window -------------------------------------------------
LATENESS, WINDOW = "10 minutes", "5 minutes"
# --------------------------------------------------------------------------------------


def detections(messages: DataFrame, strict: bool = False) -> DataFrame:
    """Messages to alerts: parse, detect, project."""
    return alert_rows(stream_detections(parse_flat_events(messages), strict))


def detect_with_dead_letters(
    messages: DataFrame, root: str, checkpoint: str, strict: bool = False, interval: str = ALERT_TRIGGER, drain: bool = False
) -> StreamingQuery:
    """One query, two tables: alerts of the usable messages to the curated zone as JSON messages, and the
    others with their reason and place to ``raw/dead_letters``.

    Both are written under the trigger's number, so a repeated trigger delivers nothing twice and loses nothing.
    """
    dead = f"{zone_path(root, 'raw', 'dead_letters')}/batch={{}}".format

    def write(rows: DataFrame, batch: int, path: str) -> None:
        rows = rows.persist()
        try:
            good, bad = quarantine_flat(rows)
            alert_messages(detections(good, strict)).write.mode("overwrite").json(path)
            bad.select("topic", "partition", "offset", F.col("value").cast("string").alias("value"), "timestamp", "reject_reason").write.mode("overwrite").parquet(dead(batch))
        finally:
            rows.unpersist()

    return by_batch(messages, write, zone_path(root, "curated", "alert_messages"), checkpoint, interval, drain)


#: Schemas of the two tables, for ``sinks.written``.
SENT_ALERTS = "key string, value string"
DEAD_LETTERS = "topic string, partition int, offset long, value string, timestamp timestamp, reject_reason string"


def window_counts(events: DataFrame, lateness: str = LATENESS, window: str = WINDOW) -> DataFrame:
    """Five-minute aggregates with a watermark; distinct counts are approximate."""
    return analytics.windowed(events.withWatermark("event_timestamp", lateness), exact=False, window=window)


def window_distinct(events: DataFrame, column: str, lateness: str = LATENESS, window: str = WINDOW) -> DataFrame:
    """Exact distinct count per window, source and severity on a stream.

    Two chained aggregates: one state row per distinct value, then a count of those rows.
    A hot window is spread over tasks by value in the first, and small in the second.
    """
    dims = ["source_system", "severity"]
    values = (
        events.withWatermark("event_timestamp", lateness)
        .groupBy(F.window("event_timestamp", window), *dims, column)
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return (
        values.groupBy(F.window(F.window_time("window"), window), *dims)
        .agg(F.sum("n").alias("event_count"), F.count(column).alias("distinct_values"))
        .select(F.col("window.start").alias("window_start"), *dims, "event_count", "distinct_values")
    )


def without_replays(messages: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Drop messages delivered again, by their position in the topic."""
    return messages.withWatermark("timestamp", lateness).dropDuplicatesWithinWatermark(
        ["topic", "partition", "offset"]
    )


def enriched(events: DataFrame, assets: DataFrame, users: DataFrame, ranges: DataFrame) -> DataFrame:
    """Stream-static left joins plus the built-in threat rules; keeps every event."""
    events = enrich.with_intel(enrich.with_user(enrich.with_asset(events, assets), users))
    return enrich.with_geo_by_block(events, ranges)
