"""Inputs outside the fixtures: unusable messages, missing values, duplicate keys, zero vectors."""

import datetime as dt
import re

from pyspark.sql import functions as F

from sablewatch.operators import analytics, cases, enrich, records, workflow
from sablewatch.sources import products, topics

ENVELOPE = "key string, value string, topic string, partition int, offset long, timestamp timestamp"
T0 = dt.datetime(2024, 1, 1)


def envelope(spark, topic, values):
    return spark.createDataFrame([(None, v, topic, 0, i, T0) for i, v in enumerate(values)], ENVELOPE)


def test_unusable_messages_are_rejected(spark):
    values = [
        "", "   ", '{"a":1} trailing', '{"a":1} {"b":2}', '{"a":"} {", "b":[{}, {}]}', "{}", '{"LocalPort": 80.0}', '{"LocalPort": 80.5}',
        ' {"LocalPort": "443"} \n', None,
    ]
    got = {r.offset: (r.reject_reason, r.source_port) for r in products.normalise(envelope(spark, products.EDR_TOPIC, values)).collect()}
    assert [got[i][0] for i in range(4)] == ["not JSON"] * 4
    assert got[4] == got[5] == (None, None)
    assert got[6] == (None, 80) and got[8] == (None, 443)
    assert got[7][0] == "port is not a number" and got[9][0] == "empty message"


def test_flat_messages_are_split_and_ids_stay_apart(spark):
    messages = envelope(spark, "flat", ['{"severity": "high"}', '{"severity": "high"}', "no json", "", None, '{"event_id": "e"}'])
    good, bad = topics.quarantine_flat(messages)
    assert {r.offset: r.reject_reason for r in bad.collect()} == {2: "not JSON", 3: "not JSON", 4: "empty message"}
    alerts = records.alert_rows(
        topics.parse_flat_events(good, F.lit(T0)).withColumn("process_name", F.lit("p")), F.lit(T0)
    )
    ids = [(r.event_id, r.alert_id) for r in alerts.collect()]
    assert len({a for _, a in ids}) == 3 and "e" in {e for e, _ in ids}


def test_missing_values_enter_no_baseline(spark):
    values = [10.0, 11.0, None, float("nan"), 10.0]
    rows = [("m", T0 + dt.timedelta(seconds=20 * i), i, v) for i, v in enumerate(values)]
    metrics = spark.createDataFrame(rows, "metric string, observed_at timestamp, seq long, value double")
    for judged in (analytics.anomalies(metrics), analytics.anomalies_in_window(metrics)):
        got = {r.seq: r for r in judged.collect()}
        assert (got[4].n, got[4].mean) == (2, 10.5)
        for i in (2, 3):
            assert got[i].value is None and got[i].is_anomaly is False and got[i].reason == "no_value"


def test_one_hot_metric_is_cut_into_minutes(spark):
    rows = spark.range(20_000).select(
        F.lit("hot").alias("metric"), F.timestamp_seconds(1_700_000_000 + F.col("id")).alias("observed_at"), F.col("id").alias("seq"),
        (F.col("id") % 7).cast("double").alias("value"),
    )
    out = analytics.anomalies(rows).collect()
    assert len(out) == 20_000 and max(r.n for r in out) == 19_999
    assert rows.groupBy(F.window("observed_at", "1 minute")).count().agg(F.max("count")).first()[0] == 60


def test_dimensions_neither_multiply_nor_miss(spark):
    events = spark.createDataFrame([("host-a", None, "ann"), ("HOST-B", None, None)], "hostname string, source_ip string, user_name string")
    assets = spark.createDataFrame(
        [("HOST-A", "high", "x", "d", "l"), ("host-a", "low", "y", "d", "l"), ("host-b", "low", "z", "d", "l")],
        "asset_key string, criticality string, owner string, department string, location string",
    )
    users = spark.createDataFrame([("ann", "IT", False, 1, True), ("ann", "HR", True, 2, True)], "username string, department string, privileged boolean, risk_score int, mfa_enabled boolean")
    out = enrich.with_user(enrich.with_asset(events, assets), users)
    assert {(r.hostname, r.asset_criticality, r.user_department) for r in out.collect()} == {("host-a", "low", "IT"), ("HOST-B", "low", None)}
    assert enrich.unenriched(events, assets).count() == 0


def test_indicators_of_several_lengths(spark):
    feed = spark.createDataFrame(
        [("ip", "1", "prefix", 0.1), ("ip", "185.22", "prefix", 0.5), ("ip", "185.220.101", "prefix", 0.9), ("ip", "7.7.7.7", "exact", 0.3), ("domain", ".xyz", "suffix", 0.4)],
        "type string, pattern string, match string, confidence double",
    )
    values = spark.createDataFrame([("ip", "185.220.101.5"), ("ip", "185.221.0.1"), ("ip", "10.0.0.1"), ("ip", "7.7.7.7"), ("ip", "7.7.7.70"), ("domain", "A.XYZ"), ("domain", None)], "type string, value string")
    got = {r.value: r.hit.pattern for r in enrich.match_indicators(values, feed).collect()}
    assert got == {"185.220.101.5": "185.220.101", "185.221.0.1": "185.22", "10.0.0.1": "1", "7.7.7.7": "7.7.7.7", "A.XYZ": ".xyz"}


def test_zero_vectors_do_not_hide_cases(spark):
    corpus = spark.createDataFrame([(1, [0.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 0.0]), (4, [0.0, 1.0])], "case_id long, embedding array<double>")
    asked = spark.createDataFrame([(9, [1.0, 0.1])], "query_id long, embedding array<double>")
    got = [(r.case_id, round(r.distance, 3)) for r in cases.nearest_cases(corpus, asked, k=3, metric="cosine").orderBy("rank").collect()]
    assert got == [(3, 0.005), (4, 0.9), (1, 1.0)]


def _alert_pairs(spark):
    ids = ["a" * 64, "b" * 64, None]
    pairs = spark.createDataFrame([(ids[i % 3], i // 3) for i in range(30)] + [(ids[0], 0), (ids[1], 99), ("none", 99)], "alert_id string, event_id long")
    events = spark.createDataFrame([(i, T0 + dt.timedelta(hours=i) if i else None) for i in range(9)], "event_id long, event_timestamp timestamp")
    span = (T0 + dt.timedelta(hours=1), T0 + dt.timedelta(hours=8))
    return pairs, events, {(ids[0], 10, *span), (ids[1], 9, *span), (None, 9, *span)}


def test_spans_of_alerts_whose_numbers_agree(spark, monkeypatch):
    pairs, events, expected = _alert_pairs(spark)
    assert {tuple(r) for r in workflow.event_span(pairs, events).collect()} == expected
    monkeypatch.setattr(workflow, "_number", lambda c: F.length(c).cast("long"))
    got = [tuple(r) for r in workflow.event_span(pairs, events).collect()]
    assert len(got) == 3 and set(got) == expected


def test_alert_ids_do_not_travel_with_events(spark, capsys):
    pairs, events, _ = _alert_pairs(spark)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        workflow.event_span(pairs, events).explain("formatted")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    sent = re.findall(r"Exchange\nInput \[\d+\]: \[(.*)\]\nArguments: hashpartitioning\(event_id", capsys.readouterr().out)
    assert any("number" in x for x in sent) and not any("alert_id" in x for x in sent if "number" in x)


def test_events_without_a_key_meet_no_single_task(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    coalesced = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        users = spark.createDataFrame([("u", "d", True, 1.0, True)], "username string, department string, privileged boolean, risk_score double, mfa_enabled boolean")
        events = spark.createDataFrame([(i, "u" if i % 10 == 0 else None) for i in range(200)], "event_id long, user_name string")
        out = enrich.with_user(events, users)
        rows = out.withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesced)
    assert len(rows) == 200 and {r.event_id for r in rows if r.user_known} == set(range(0, 200, 10))
    assert len({r.task for r in rows if r.user_name is None}) == 4
