"""Streaming jobs run over the events table until it is drained; the written result is returned."""

from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from ..fixtures.views import view
from ..functions import severity_rank
from ..session import shared_dir
from ..sources import parse_flat_events
from ..streaming import jobs, sinks, sources, stateful
from .analytics import COOLDOWN_SQL, WINDOW_SQL, _anomaly_sql, _rounded
from .enrichment import _ASSET_KEY, _GEO_JOIN
from .registry import query

_T = "strftime({0}, '%Y-%m-%d %H:%M:%S.%f')".format


def _drained(spark, stream, name):
    """Write a stream to the shared folder with its own checkpoint; read the table back."""
    root = shared_dir(spark, name)
    schema = stream.schema
    sinks.append_to_zone(stream, root, "curated", name, f"{root}/checkpoint", drain=True).awaitTermination()
    return spark.read.schema(schema).parquet(sinks.zone_path(root, "curated", name))


def _events(spark, sf):
    return (
        view(spark, sf, "sec_events", streamed=True).withColumnRenamed("user_name", "user")
        .withColumn("severity_normalized", severity_rank(F.col("severity"))).withColumn("risk_score", F.lit(0.5))
    )


@query(
    "src_event_stream",
    f"""SELECT topic, cast(partition AS bigint) AS partition, "offset", {_T("date_trunc('second', event_timestamp)")} AS event_timestamp FROM
      (SELECT 'soc.events.raw' AS topic, event_id % 4 AS partition, event_id AS "offset", event_timestamp FROM sec_events) x""",
)
def src_event_stream(spark, sf):
    messages = view(spark, sf, "stream_in", streamed=True)
    event_time = F.get_json_object("value", "$.timestamp").cast("timestamp").alias("event_timestamp")
    return _drained(spark, messages.select("topic", "partition", "offset", event_time), "event_stream")


@query(
    "sink_zone_append",
    """SELECT strftime(event_timestamp, '%Y-%m-%d') AS date, severity, count(*) AS events FROM sec_events GROUP BY ALL""",
)
def sink_zone_append(spark, sf):
    root = shared_dir(spark, "zone")
    events = parse_flat_events(view(spark, sf, "stream_in", streamed=True)).drop("processing_time", "latency_ms")
    sinks.append_to_zone(
        events, root, "enriched", "events", f"{root}/checkpoint", time="event_timestamp", drain=True
    ).awaitTermination()
    written = spark.read.parquet(sinks.zone_path(root, "enriched", "events"))
    return written.groupBy(F.date_format("date", "yyyy-MM-dd").alias("date"), "severity").agg(F.count(F.lit(1)).alias("events"))


# A window is emitted once the watermark, ten minutes behind the latest event, passes its end.
# The watermark has millisecond precision.
_CLOSED = "HAVING time_bucket(INTERVAL 5 MINUTE, event_timestamp) + INTERVAL 5 MINUTE <= (SELECT date_trunc('millisecond', max(event_timestamp)) - INTERVAL 10 MINUTE FROM sec_events)"


@query(
    "st_tumbling",
    f"SELECT window_start, window_end, source_system, severity, event_count, avg_risk_score, max_severity FROM ({WINDOW_SQL} {_CLOSED}) w",
)
def st_tumbling(spark, sf):
    return _drained(spark, jobs.window_counts(_events(spark, sf)), "windows").drop("unique_hosts", "unique_users")


@query(
    "st_watermark",
    f"""SELECT count(*) AS closed_windows, cast(sum(event_count) AS bigint) AS events_in_closed_windows, max(window_end) AS last_closed
      FROM ({WINDOW_SQL} {_CLOSED}) w""",
)
def st_watermark(spark, sf):
    return _drained(spark, jobs.window_counts(_events(spark, sf)), "watermark").agg(
        F.count(F.lit(1)).alias("closed_windows"), F.sum("event_count").alias("events_in_closed_windows"),
        F.max("window_end").alias("last_closed"),
    )


@query(
    "st_window_distinct",
    f"SELECT window_start, source_system, severity, event_count, unique_hosts AS distinct_values FROM ({WINDOW_SQL} {_CLOSED}) w",
)
def st_window_distinct(spark, sf):
    return _drained(spark, jobs.window_distinct(_events(spark, sf), "hostname"), "distinct")


_JUDGED = "metric string, observed_at timestamp, seq long, value double, n long, mean double, std double, z_score double, is_anomaly boolean, reason string"


@query("st_alert_cooldown", COOLDOWN_SQL)
def st_alert_cooldown(spark, sf):
    alerts = view(spark, sf, "alerts", streamed=True)
    key = F.concat_ws(":", "severity", "title")
    root = shared_dir(spark, "cooldown")
    stateful.alert_cooldown(alerts, key, "created_at", "alert_id", root, "sent", f"{root}/checkpoint", drain=True).awaitTermination()
    return stateful.result(spark, root, "sent", "key string, id string, sent_at timestamp").drop("batch")


@query("st_metric_baseline", _anomaly_sql("ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING", "observed_at, seq"))
def st_metric_baseline(spark, sf):
    root = shared_dir(spark, "baseline")
    metrics = view(spark, sf, "metrics", streamed=True)
    stateful.metric_anomalies(metrics, root, "judged", f"{root}/checkpoint", drain=True).awaitTermination()
    return _rounded(stateful.result(spark, root, "judged", _JUDGED))


@query(
    "st_enrich",
    f"""SELECT e.event_id, a.criticality AS asset_criticality, u.username IS NOT NULL AS user_known, s.country AS source_country, d.country AS destination_country
      FROM (SELECT *, {_ASSET_KEY} AS lk FROM sec_events) e
      LEFT JOIN assets a ON a.asset_key = e.lk LEFT JOIN users u ON u.username = e.user_name {_GEO_JOIN}""",
)
def st_enrich(spark, sf):
    events = view(spark, sf, "sec_events", streamed=True)
    out = jobs.enriched(events, view(spark, sf, "assets"), view(spark, sf, "users"), view(spark, sf, "geo_ranges"))
    countries = [F.col(f"{side}_ip_geo.country").alias(f"{side}_country") for side in ("source", "destination")]
    return _drained(spark, out.select("event_id", "asset_criticality", "user_known", *countries), "enrich")


@query("st_dedup_replay", """SELECT topic, "offset", 1 AS deliveries FROM messages_in""".replace("1 AS", "cast(1 AS bigint) AS"))
def st_dedup_replay(spark, sf):
    # The same messages delivered twice, as after a consumer restart.
    once, again = (view(spark, sf, "messages_in", streamed=True).drop("event_id", "value") for _ in range(2))
    kept = _drained(spark, jobs.without_replays(once.unionByName(again)), "replay")
    return kept.groupBy("topic", "offset").agg(F.count(F.lit(1)).alias("deliveries"))


_BROKEN = "(event_id % 37 = 0 OR event_id % 41 = 0 OR event_id % 43 = 0 OR event_id % 47 = 0 OR event_id % 53 = 0)"


def _detected(spark, sf):
    root = shared_dir(spark, "alerts")
    jobs.detect_with_dead_letters(view(spark, sf, "stream_mixed_in", streamed=True), root, f"{root}/checkpoint", drain=True).awaitTermination()
    return root


@query(
    "st_detect_to_sink",
    f"""SELECT sha256('alert:' || event_id) AS key, 'Suspicious activity: ' || coalesce(process_name, 'Unknown process') AS title, severity
      FROM sec_events WHERE NOT {_BROKEN} AND (lower(severity) IN ('high', 'critical') OR event_id % 9 IN (0, 1, 7))""",
)
def st_detect_to_sink(spark, sf):
    """Alerts of a stream with broken messages in it, as sent."""
    sent = sinks.written(spark, sinks.zone_path(_detected(spark, sf), "curated", "alert_messages"), jobs.SENT_ALERTS, "json")
    return sent.select("key", *[F.get_json_object("value", f"$.{f}").alias(f) for f in ("title", "severity")])


@query(
    "st_dead_letter",
    f"""SELECT 'soc.events.raw' AS topic, event_id % 4 AS partition, event_id AS "offset",
       CASE WHEN event_id % 37 <> 0 AND event_id % 41 = 0 THEN 'empty message' ELSE 'not JSON' END AS reject_reason FROM sec_events WHERE {_BROKEN}""",
)
def st_dead_letter(spark, sf):
    """The messages of the same stream that could not be used, each with its place and reason."""
    dead = sinks.written(spark, sinks.zone_path(_detected(spark, sf), "raw", "dead_letters"), jobs.DEAD_LETTERS)
    return dead.select("topic", "partition", "offset", "reject_reason")


def _in_files(spark, sf, root):
    """The messages as four files in the order of their partitions, as if they had come one after the other."""
    messages = view(spark, sf, "stream_in").drop("event_id")
    for part in range(4):
        messages.where(F.col("partition") == part).coalesce(1).write.mode("append").parquet(f"{root}/in")
    return sources.file_stream(spark, f"{root}/in", files_per_trigger=1, schema=messages.schema)


class _Stopped(Exception):
    """The failure the checkpoint query provokes."""


@query(
    "st_checkpoint",
    """SELECT event_id % 4 AS partition, event_id AS "offset", cast(1 AS bigint) AS deliveries, event_id % 4 AS batch FROM sec_events""",
)
def st_checkpoint(spark, sf):
    """Messages of a query that fails after writing its second trigger, before that is committed, and is started again.

    The repeated trigger replaces what it wrote: each message is there once, in the trigger of its file.
    """
    root = shared_dir(spark, "restart")
    stream = _in_files(spark, sf, root).select("partition", "offset")
    path, tries = f"{root}/out", []

    def write(rows, batch, folder):
        rows.write.mode("overwrite").parquet(folder)
        tries.append(batch)
        if tries == [0, 1]:
            raise _Stopped("stopped between writing and committing")

    for attempt in range(2):
        try:
            sinks.by_batch(stream, write, path, f"{root}/checkpoint", drain=True).awaitTermination()
        except StreamingQueryException:
            if attempt or tries != [0, 1]:
                raise
    if tries != [0, 1, 1, 2, 3]:
        raise RuntimeError(f"triggers ran as {tries}")
    delivered = sinks.written(spark, path, "partition int, offset long")
    return delivered.groupBy("partition", "offset").agg(F.count(F.lit(1)).alias("deliveries"), F.max("batch").alias("batch"))


@query("st_rate_limit", """SELECT event_id % 4 AS batch, count(*) AS rows FROM sec_events GROUP BY ALL""")
def st_rate_limit(spark, sf):
    """Rows of each trigger when the source gives one file a trigger."""
    root = shared_dir(spark, "rate")
    running = sinks.append_to_zone(_in_files(spark, sf, root), root, "raw", "messages", f"{root}/checkpoint", drain=True)
    running.awaitTermination()
    return sinks.progress(running)


@query(
    "st_triggers",
    """SELECT t AS "trigger", count(*) AS batches, cast(sum(n) AS bigint) AS rows FROM (VALUES ('available now'), ('1 second')) v(t),
      (SELECT event_id % 4 AS part, count(*) AS n FROM sec_events GROUP BY ALL) x GROUP BY t""",
)
def st_triggers(spark, sf):
    """Triggers and rows of the same query drained at once, and by processing time until nothing is left."""
    root = shared_dir(spark, "triggers")
    stream, found = _in_files(spark, sf, root), []
    for name, drain in (("available now", True), ("1 second", False)):
        place = f"{root}/{name.replace(' ', '-')}"
        running = sinks.append_to_zone(stream, place, "raw", "messages", f"{place}/checkpoint", interval="1 second", drain=drain)
        try:
            running.processAllAvailable() if not drain else running.awaitTermination()
            found.append(sinks.progress(running).withColumn("trigger", F.lit(name)))
        finally:
            running.stop()
    return found[0].unionByName(found[1]).groupBy("trigger").agg(F.count(F.lit(1)).alias("batches"), F.sum("rows").alias("rows"))
