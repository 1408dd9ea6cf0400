"""Projections around events, alerts and incidents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lookup, picked, rows_of, stable_id

# --- fixed value: task priority by severity -----------------------------------------
PRIORITY_BY_SEVERITY = {"critical": 1, "high": 2, "medium": 3, "low": 4}
# ------------------------------------------------------------------------------------


def priority_of(severity: Column) -> Column:
    return lookup(severity, PRIORITY_BY_SEVERITY, 3)


def event_entities(events: DataFrame, id_col: str = "event_id") -> DataFrame:
    """One row per entity an event names: (event, type, value)."""

    def entity(kind: str, col: str) -> Column:
        return F.when(
            F.col(col).isNotNull() & (F.col(col) != ""),
            F.struct(F.lit(kind).alias("entity_type"), F.col(col).alias("entity_value")),
        )

    found = picked(
        [
            entity("asset", "hostname"), entity("user", "user_name"), entity("ip", "source_ip"),
            entity("ip", "destination_ip"), entity("domain", "domain"), entity("hash", "process_hash"),
        ]
    )
    return rows_of(events, [id_col], found)


def alert_rows(events: DataFrame, alert_time: Column | None = None) -> DataFrame:
    """Alert projection of detected events, with an id that replays reproduce."""
    return events.select(
        stable_id(F.lit("alert"), F.col("event_id")).alias("alert_id"),
        "event_id",
        F.concat(
            F.lit("Suspicious activity: "), F.coalesce("process_name", F.lit("Unknown process"))
        ).alias("title"),
        "severity", "source_system", "hostname", "user", "risk_score", "event_timestamp",
        (F.current_timestamp() if alert_time is None else alert_time).alias("alert_timestamp"),
    )


def alert_messages(alerts: DataFrame) -> DataFrame:
    """Key / JSON value pairs for a broker or file sink."""
    return alerts.select(F.col("alert_id").alias("key"), F.to_json(F.struct("*")).alias("value"))


def submitted_alerts(submissions: DataFrame) -> DataFrame:
    """Submitted alerts with workflow status and the orchestrator task they start."""
    return submissions.select(
        "alert_id", "title", "description", "severity", "source_system", "detection_rule",
        F.lit("triaging").alias("status"), F.lit("orchestrator").alias("assigned_agent"),
        F.lit("route_alert").alias("task_type"), priority_of(F.col("severity")).alias("task_priority"),
        stable_id(F.lit("task"), F.col("alert_id"), F.lit("orchestrator")).alias("task_id"),
    )


def manual_incidents(members: DataFrame) -> DataFrame:
    """One open incident of type manual per id, with its number of alerts.

    The membership rows themselves are the incident's alert list; they stay rows, since
    one incident may hold a large part of all alerts.
    """
    return members.groupBy("incident_id").agg(
        F.lit("manual").alias("incident_type"), F.lit("open").alias("status"),
        F.count_distinct("alert_id").alias("alert_count"), F.min("alert_id").alias("first_alert"),
        F.max("alert_id").alias("last_alert"),
    )
