"""From message envelopes to parsed records.

The input is the broker envelope ``(key, value, topic, partition, offset, timestamp)``,
from a broker, a file stream or a table; batch and stream use the same code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import evaluated_once, millis_between, parse_iso, severity_rank, stable_id
from ..schemas import STREAM_EVENT

CORRUPT = "_corrupt"


def json_record(value: Column, fields: list[str]) -> Column:
    """Parse to strings only; text that is not JSON fills ``_corrupt`` and raises nothing."""
    schema = T.StructType([T.StructField(f, T.StringType()) for f in [*fields, CORRUPT]])
    return F.from_json(
        value.cast("string"), schema,
        {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT},
    )


def not_one_object(text: Column) -> Column:
    """Whether a message is blank, or goes on behind its object.

    The parser stops at the end of the first value. A message that starts and ends with a brace
    and has no object right behind another is one object; where it may have, it is read as the
    content of a list, which must have one element.
    """
    braced = text.rlike(r"(?s)^\s*\{.*\}\s*$")
    listed = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    single = listed.isNotNull() & F.try_variant_get(listed, "$[1]", "string").isNull()
    return ~(braced & (~text.rlike(r"\}\s*,?\s*\{") | single))


def parse_topics(messages: DataFrame, topics: dict[str, list[str]]) -> DataFrame:
    """Struct column ``parsed`` with one field per topic, in a single pass over the messages.

    ``topics`` maps a topic to the raw field names it carries. A message is parsed once,
    with the fields of its own topic; the other fields stay NULL.
    """
    structs = [
        F.when(F.col("topic") == topic, json_record(F.col("value"), fields)).alias(topic)
        for topic, fields in topics.items()
    ]
    return evaluated_once(messages, F.struct(*structs), "parsed")


def parse_flat_events(
    messages: DataFrame, as_of: Column | None = None, risk_score: Column | None = None
) -> DataFrame:
    """Flat stream messages to typed events with latency, severity rank and risk score.

    ``as_of`` is the processing time; a stream leaves it out and takes the trigger's
    clock. ``risk_score`` is the constant 0.5 until a model column is supplied.
    """
    event = F.from_json(F.col("value").cast("string"), STREAM_EVENT)
    processed = F.current_timestamp() if as_of is None else as_of
    # Without an id of its own an event is named by its place, so ids of alerts stay apart.
    placed = {"topic", "partition", "offset"} <= set(messages.columns)
    place = stable_id(F.col("topic"), F.col("partition"), F.col("offset")) if placed else F.lit(None).cast("string")
    return (
        evaluated_once(messages.select("value", F.col("timestamp").alias("kafka_timestamp"), place.alias("_place")), event, "event")
        .select("event.*", "kafka_timestamp", "_place")
        .withColumn("event_id", F.coalesce("event_id", "_place")).drop("_place")
        .withColumn("event_timestamp", parse_iso(F.col("timestamp")))
        .withColumn("processing_time", processed)
        .withColumn("latency_ms", millis_between(F.col("processing_time"), F.col("event_timestamp")))
        .withColumn("severity_normalized", severity_rank(F.col("severity")))
        .withColumn("risk_score", F.lit(0.5) if risk_score is None else risk_score)
    )


def quarantine(normalised: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split normalised rows into (good events, rejected messages with a reason)."""
    good = normalised.filter(F.col("reject_reason").isNull()).drop("reject_reason")
    bad = normalised.filter(F.col("reject_reason").isNotNull()).select(
        "topic", "partition", "offset", F.col("raw_data").alias("value"), "reject_reason"
    )
    return good, bad


def quarantine_flat(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split flat stream messages into (usable ones, rejected ones with a reason)."""
    text = F.col("value").cast("string")
    reason = F.when(F.col("value").isNull(), "empty message").when(
        not_one_object(text) | F.from_json(text, "map<string,string>", {"mode": "PERMISSIVE"}).isNull(), "not JSON"
    )
    judged = evaluated_once(messages, reason, "reject_reason")
    return judged.filter("reject_reason is null").drop("reject_reason"), judged.filter("reject_reason is not null")
