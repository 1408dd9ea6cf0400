"""Streams over many files: lateness, restarts, rate limit, state across batches."""

import datetime as dt
import json

from pyspark.sql import functions as F

from sablewatch.operators import analytics
from sablewatch.schemas import ENVELOPE
from sablewatch.session import shared_dir
from sablewatch.streaming import jobs, sinks, sources, stateful

from test_properties import BASE, cooldown_rows, sent_by_brute_force


def write_batches(spark, folder, frames):
    for df in frames:
        df.coalesce(1).write.mode("append").parquet(folder)


def drain(spark, stream, root, name="out"):
    sinks.append_to_zone(stream, root, "curated", name, f"{root}/cp-{name}", drain=True).awaitTermination()
    return spark.read.parquet(sinks.zone_path(root, "curated", name))


def messages(spark, minutes, offset=0):
    rows = []
    for i, minute in enumerate(minutes):
        at = BASE + dt.timedelta(minutes=minute)
        body = {"event_id": str(offset + i), "timestamp": at.isoformat() + "Z", "severity": "high", "source_system": "s", "hostname": f"h{i % 2}", "user": "u"}
        rows.append(("k", json.dumps(body), "t", 0, offset + i, at))
    return spark.createDataFrame(rows, ENVELOPE)


def windows(spark, folder):
    from sablewatch.sources import parse_flat_events

    return jobs.window_counts(parse_flat_events(sources.file_stream(spark, folder, files_per_trigger=1)))


def test_late_rows_are_dropped_and_open_windows_wait(spark):
    root = shared_dir(spark, "late")
    folder = f"{root}/in"
    for offset, minutes in ((0, [0, 1, 6]), (10, [40]), (20, [41]), (30, [2]), (40, [80])):
        write_batches(spark, folder, [messages(spark, minutes, offset)])
    rows = drain(spark, windows(spark, folder), root).orderBy("window_start").collect()
    # Minute 2 arrives after the watermark reached 30; minute 80 is still open.
    assert [((r.window_start - BASE).seconds // 60, r.event_count) for r in rows] == [(0, 2), (5, 1), (40, 2)]
    assert rows[0].unique_hosts == 2


def test_restart_continues_from_the_checkpoint(spark):
    root = shared_dir(spark, "restart")
    folder = f"{root}/in"
    write_batches(spark, folder, [messages(spark, [1, 2])])
    assert drain(spark, jobs.detections(sources.file_stream(spark, folder)), root).count() == 2
    write_batches(spark, folder, [messages(spark, [3], offset=5)])
    out = drain(spark, jobs.detections(sources.file_stream(spark, folder)), root)
    assert out.count() == 3 and out.select("alert_id").distinct().count() == 3


def test_rate_limit_makes_one_batch_per_file(spark):
    root = shared_dir(spark, "rate")
    folder = f"{root}/in"
    write_batches(spark, folder, [messages(spark, [i], offset=i) for i in range(3)])
    query = sinks.append_to_zone(sources.file_stream(spark, folder, files_per_trigger=1), root, "raw", "m", f"{root}/cp", drain=True)
    query.awaitTermination()
    assert [p["numInputRows"] for p in query.recentProgress if p["numInputRows"]] == [1, 1, 1]


def test_default_triggers(spark):
    root = shared_dir(spark, "trigger")
    folder = f"{root}/in"
    write_batches(spark, folder, [messages(spark, [1])])
    query = sinks.append_to_zone(sources.file_stream(spark, folder), root, "raw", "m", f"{root}/cp")
    try:
        assert sinks.LAKE_TRIGGER == "30 seconds" and sinks.ALERT_TRIGGER == "10 seconds"
        query.processAllAvailable()
        assert query.isActive and spark.read.parquet(sinks.zone_path(root, "raw", "m")).count() == 1
    finally:
        query.stop()


def test_stream_cooldown_over_batches(spark):
    root = shared_dir(spark, "cooldown")
    rows = sorted(cooldown_rows(600), key=lambda r: r[1])
    schema = "key string, at timestamp, id string"
    step = len(rows) // 4 + 1
    for i in range(0, len(rows), step):
        write_batches(spark, f"{root}/in", [spark.createDataFrame(rows[i : i + step], schema)])
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    stateful.alert_cooldown(stream, F.col("key"), "at", "id", root, "sent", f"{root}/cp", drain=True).awaitTermination()
    out = stateful.result(spark, root, "sent", "key string, id string, sent_at timestamp")
    # Keys that can suppress nothing more are gone from the last state.
    kept = spark.read.parquet(f"{root}/state/sent/batch=3").count()
    assert out.select("batch").distinct().count() == 4 and 0 < kept < 10
    assert {(r["key"], r["id"]) for r in out.collect()} == sent_by_brute_force(rows)


def test_stream_baseline_equals_batch(spark):
    root = shared_dir(spark, "baseline")
    schema = "metric string, observed_at timestamp, seq long, value double"
    rows = [("m" if i % 4 else "flat", BASE + dt.timedelta(minutes=i), i, 7.0 if i % 4 == 0 else float((i * 37) % 101)) for i in range(120)]
    for i in range(0, 120, 40):
        write_batches(spark, f"{root}/in", [spark.createDataFrame(rows[i : i + 40], schema)])
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    stateful.metric_anomalies(stream, root, "judged", f"{root}/cp", drain=True).awaitTermination()
    out = stateful.result(spark, root, "judged", "metric string, seq long, n long, mean double, std double, is_anomaly boolean, reason string")
    assert out.select("batch").distinct().count() == 3
    got = {r.seq: r for r in out.collect()}
    for r in analytics.anomalies(spark.createDataFrame(rows, schema)).collect():
        other = got[r.seq]
        assert (r.n, r.is_anomaly, r.reason) == (other.n, other.is_anomaly, other.reason)
        assert (r.std is None) == (other.std is None) and (r.std is None or abs(r.std - other.std) < 1e-9)
