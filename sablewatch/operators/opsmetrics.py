"""Operational counters for dashboards and scraping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import AGENTS


def _within_day(time: str, as_of: Column) -> Column:
    return (F.col(time) > F.timestamp_add("HOUR", F.lit(-24), as_of)) & (F.col(time) <= as_of)


def health(events: DataFrame, alerts: DataFrame, incidents: DataFrame, as_of: Column) -> DataFrame:
    """Events and alerts of the last 24 hours and open incidents, as (metric, value)."""
    parts = [
        events.filter(_within_day("event_timestamp", as_of)).agg(F.count(F.lit(1)).alias("value")).select(F.lit("events_processed_24h").alias("metric"), "value"),
        alerts.filter(_within_day("created_at", as_of)).agg(F.count(F.lit(1)).alias("value")).select(F.lit("alerts_processed_24h").alias("metric"), "value"),
        incidents.filter(F.col("status") != "closed").agg(F.count(F.lit(1)).alias("value")).select(F.lit("incidents_open").alias("metric"), "value"),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def agent_stats(tasks: DataFrame) -> DataFrame:
    """Completed and pending tasks, mean run time and last activity per agent."""
    done = F.col("status") == "completed"
    return tasks.groupBy("agent_type").agg(
        F.count_if(done).alias("tasks_completed"), F.count_if(F.col("status") == "pending").alias("tasks_pending"),
        F.coalesce(F.avg(F.when(done, F.col("execution_ms"))), F.lit(0.0)).alias("average_execution_ms"),
        F.max(F.when(done, F.col("assigned_at"))).alias("last_active"),
    )


def counters(alerts: DataFrame, incidents: DataFrame, tasks: DataFrame) -> DataFrame:
    """Scrape rows (metric, label, value); every known agent has one, idle ones with 0."""
    total = alerts.agg(F.count(F.lit(1)).alias("value")).select(
        F.lit("soc_alerts_total").alias("metric"), F.lit("").alias("label"), "value"
    )
    still_open = incidents.filter(F.col("status") != "closed").agg(F.count(F.lit(1)).alias("value")).select(
        F.lit("soc_incidents_open").alias("metric"), F.lit("").alias("label"), "value"
    )
    by_agent = tasks.agg(
        F.array(
            *[
                F.struct(F.lit(a).alias("label"), F.count_if(F.col("agent_type") == a).alias("value"))
                for a in AGENTS
            ]
        ).alias("a")
    ).select(F.explode("a").alias("a")).select(F.lit("soc_agent_tasks_total").alias("metric"), "a.label", "a.value")
    return total.unionByName(still_open).unionByName(by_agent)
