"""Windows, baselines, anomalies, cooldown and counters."""

from pyspark.sql import functions as F

from ..fixtures.text import AS_OF
from ..fixtures.views import view
from ..functions import severity_rank
from ..operators import analytics, opsmetrics
from .registry import query

_T = "strftime({0}, '%Y-%m-%d %H:%M:%S.%f')".format


def _as_of():
    return F.lit(AS_OF).cast("timestamp")


def scored_events(spark, sf):
    return (
        view(spark, sf, "sec_events").withColumnRenamed("user_name", "user")
        .withColumn("severity_normalized", severity_rank(F.col("severity"))).withColumn("risk_score", F.lit(0.5))
    )


WINDOW_SQL = f"""SELECT {_T("time_bucket(INTERVAL 5 MINUTE, event_timestamp)")} AS window_start,
  {_T("time_bucket(INTERVAL 5 MINUTE, event_timestamp) + INTERVAL 5 MINUTE")} AS window_end, source_system, severity, count(*) AS event_count,
  count(DISTINCT hostname) AS unique_hosts, count(DISTINCT user_name) AS unique_users, cast(0.5 AS double) AS avg_risk_score,
  cast(max(CASE WHEN lower(severity) = 'critical' THEN 4 WHEN lower(severity) = 'high' THEN 3 WHEN lower(severity) = 'medium' THEN 2 ELSE 1 END) AS bigint) AS max_severity
  FROM sec_events GROUP BY time_bucket(INTERVAL 5 MINUTE, event_timestamp), source_system, severity"""


@query("agg_window_5m", WINDOW_SQL)
def agg_window_5m(spark, sf):
    return analytics.windowed(scored_events(spark, sf))


@query(
    "agg_recent",
    f"""SELECT CASE WHEN grouping(severity) = 0 THEN 'severity' WHEN grouping(source_system) = 0 THEN 'source_system' WHEN grouping(event_type) = 0 THEN 'event_type' ELSE 'total' END AS dimension,
      coalesce(CASE WHEN grouping(severity) = 0 THEN severity END, source_system, event_type) AS value, count(*) AS event_count, count(DISTINCT hostname) AS unique_hosts
      FROM sec_events WHERE event_timestamp >= TIMESTAMP '{AS_OF}' - INTERVAL 1440 MINUTE AND event_timestamp <= TIMESTAMP '{AS_OF}'
      GROUP BY GROUPING SETS ((), (severity), (source_system), (event_type))""",
)
def agg_recent(spark, sf):
    return analytics.recent(view(spark, sf, "sec_events"), _as_of(), minutes=1440)


@query(
    "agg_sev_source_rollup",
    """SELECT source_system, severity, cast(grouping_id(source_system, severity) AS bigint) AS level, count(*) AS event_count, count(DISTINCT hostname) AS unique_hosts
      FROM sec_events GROUP BY ROLLUP (source_system, severity)""",
)
def agg_sev_source_rollup(spark, sf):
    return analytics.severity_rollup(view(spark, sf, "sec_events"))


@query(
    "metric_baseline",
    """SELECT metric, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0), 6) AS std, count(*) AS "count", min(value) AS "min", max(value) AS "max"
      FROM metrics GROUP BY metric""",
)
def metric_baseline(spark, sf):
    return analytics.baselines(view(spark, sf, "metrics")).withColumn("mean", F.round("mean", 6)).withColumn("std", F.round("std", 6))


def _anomaly_sql(frame, order):
    return f"""WITH w AS (SELECT metric, seq, value, count(*) OVER f AS n, avg(value) OVER f AS mean,
       CASE WHEN count(*) OVER f = 1 THEN 0 ELSE stddev_samp(value) OVER f END AS std FROM metrics WINDOW f AS (PARTITION BY metric ORDER BY {order} {frame})),
      z AS (SELECT *, CASE WHEN n > 0 AND std > 0 THEN abs(value - mean) / std END AS zs FROM w)
      SELECT metric, seq, n, round(mean * n, 2) AS prior_sum, round(std, 4) AS std, round(zs, 4) AS z_score,
       CASE WHEN n = 0 THEN false WHEN std = 0 THEN value <> mean ELSE zs > 2.1 END AS is_anomaly,
       CASE WHEN n = 0 THEN 'no_baseline' WHEN std = 0 THEN 'zero_variance' WHEN zs > 2.1 THEN 'z_score_' || printf('%.2f', zs) ELSE 'within_baseline' END AS reason FROM z"""


def _rounded(df):
    # The mean is shown as a sum: of two-decimal values it is free of rounding ties.
    total = F.round(F.col("mean") * F.col("n"), 2).alias("prior_sum")
    rounded = [F.round(c, 4).alias(c) for c in ("std", "z_score")]
    return df.select("metric", "seq", "n", total, *rounded, "is_anomaly", "reason")


@query("anomaly_zscore", _anomaly_sql("ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING", "observed_at, seq"))
def anomaly_zscore(spark, sf):
    return _rounded(analytics.anomalies(view(spark, sf, "metrics")))


@query("anomaly_24h", _anomaly_sql("RANGE BETWEEN 86400 PRECEDING AND 1 PRECEDING", "epoch_us(observed_at) // 1000000"))
def anomaly_24h(spark, sf):
    return _rounded(analytics.anomalies_in_window(view(spark, sf, "metrics")))


COOLDOWN_SQL = f"""WITH RECURSIVE a AS (SELECT severity || ':' || title AS key, created_at AS t0, min(alert_id) AS id FROM alerts GROUP BY ALL),
  nxt AS (SELECT a.key, a.t0, a.id, min(b.t0) AS next_at FROM a LEFT JOIN a b ON b.key = a.key AND b.t0 >= a.t0 + INTERVAL 15 MINUTE GROUP BY ALL),
  firsts AS (SELECT key, min(t0) AS t0 FROM a GROUP BY key),
  chain AS (SELECT n.key, n.t0, n.id, n.next_at FROM nxt n JOIN firsts f ON f.key = n.key AND f.t0 = n.t0
    UNION ALL SELECT n.key, n.t0, n.id, n.next_at FROM chain c JOIN nxt n ON n.key = c.key AND n.t0 = c.next_at)
  SELECT key, id, {_T('t0')} AS sent_at FROM chain"""


@query("alert_cooldown", COOLDOWN_SQL)
def alert_cooldown(spark, sf):
    key = F.concat_ws(":", "severity", "title")
    return analytics.cooldown(view(spark, sf, "alerts"), key, "created_at", "alert_id")


@query(
    "health_24h",
    f"""SELECT 'events_processed_24h' AS metric, count(*) AS value FROM sec_events WHERE event_timestamp > TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR AND event_timestamp <= TIMESTAMP '{AS_OF}'
      UNION ALL SELECT 'alerts_processed_24h', count(*) FROM alerts WHERE created_at > TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR AND created_at <= TIMESTAMP '{AS_OF}'
      UNION ALL SELECT 'incidents_open', count(*) FROM incidents WHERE status <> 'closed'""",
)
def health_24h(spark, sf):
    return opsmetrics.health(view(spark, sf, "sec_events"), view(spark, sf, "alerts"), view(spark, sf, "incidents"), _as_of())


@query(
    "agent_stats",
    f"""SELECT agent_type, count(*) FILTER (status = 'completed') AS tasks_completed, count(*) FILTER (status = 'pending') AS tasks_pending,
      coalesce(avg(execution_ms) FILTER (status = 'completed'), 0) AS average_execution_ms, {_T("max(assigned_at) FILTER (status = 'completed')")} AS last_active
      FROM tasks GROUP BY agent_type""",
)
def agent_stats(spark, sf):
    return opsmetrics.agent_stats(view(spark, sf, "tasks"))


@query(
    "metrics_counters",
    """SELECT 'soc_alerts_total' AS metric, '' AS label, count(*) AS value FROM alerts
      UNION ALL SELECT 'soc_incidents_open', '', count(*) FROM incidents WHERE status <> 'closed'
      UNION ALL SELECT 'soc_agent_tasks_total', a.agent, count(t.task_id) FROM (VALUES ('orchestrator'), ('triage'), ('malware'), ('network'), ('identity'), ('threat_intel'), ('response')) a(agent)
       LEFT JOIN tasks t ON t.agent_type = a.agent GROUP BY a.agent""",
)
def metrics_counters(spark, sf):
    return opsmetrics.counters(view(spark, sf, "alerts"), view(spark, sf, "incidents"), view(spark, sf, "tasks"))
