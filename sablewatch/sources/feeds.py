"""Threat-intelligence snapshot and its event form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import stable_id


def latest_indicators(feed: DataFrame, time: str = "seen_at", tie: str = "seq") -> DataFrame:
    """Newest record per (type, value), with first and last sighting.

    An aggregate, not a ranking window: partial aggregation shrinks a hot indicator to
    one row per task before the shuffle.
    """
    others = [c for c in feed.columns if c not in ("type", "value", time, tie)]
    newest = F.max_by(F.struct(*others), F.struct(time, tie))
    return (
        feed.groupBy("type", "value")
        .agg(
            newest.alias("newest"), F.min(time).alias("first_seen"), F.max(time).alias("last_seen"),
            F.count(F.lit(1)).alias("sightings"),
        )
        .select("type", "value", "newest.*", "first_seen", "last_seen", "sightings")
    )


def intel_events(feed: DataFrame, time: str = "seen_at") -> DataFrame:
    """Feed records as canonical events: custom, medium, raw record kept."""
    raw = F.to_json(F.struct("*"))
    return feed.select(
        stable_id(F.lit("threat_intel"), raw).alias("event_id"),
        F.col(time).alias("timestamp"),
        F.lit("custom").alias("event_type"), F.lit("medium").alias("severity"),
        F.lit("threat_intel").alias("source_system"), F.lit("threat_intel").alias("source_category"),
        raw.alias("raw_data"),
    )
