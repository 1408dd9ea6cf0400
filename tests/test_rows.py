"""Hand-written rows: functions, normalisation, contracts, detection, triage."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from sablewatch import functions as fn
from sablewatch.operators import commands, detect, enrich, quality, triage, workflow
from sablewatch.operators.quality import Rule
from sablewatch.sources import default_registry, normalise, quarantine
from sablewatch.sources.products import EDR_TOPIC, GENERIC_TOPIC, NDR_TOPIC, SIEM_TOPIC

ENVELOPE = "key string, value string, topic string, partition int, offset long, timestamp timestamp"
AT = dt.datetime(2024, 1, 5, 12, 0, 0)


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def column(spark, values, kind, make):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.select("i", make(F.col("v")).alias("x")).orderBy("i").select("x").collect()]


def test_numeric_severity_boundaries(spark):
    got = column(spark, [1, 3, 4, 5, 6, 7, 8, 9, None], "int", fn.numeric_severity)
    assert got == ["low", "low", "medium", "medium", "high", "high", "critical", "critical", None]


def test_severity_rank_any_case(spark):
    assert column(spark, ["Critical", "HIGH", "medium", "low", None, "x"], "string", fn.severity_rank) == [4, 3, 2, 1, 1, 1]


def test_private_ranges(spark):
    ips = ["172.15.0.1", "172.16.0.1", "172.31.255.255", "172.32.0.0", "10.1.2.3", "192.168.0.1", "8.8.8.8", "::1", "1.2.3.256", None]
    got = column(spark, ips, "string", lambda c: fn.is_private_number(fn.ipv4_number(c)))
    assert got == [False, True, True, False, True, True, False, False, False, False]
    assert column(spark, ["1.2.3.4", "1.2.3", "1.2.3.256"], "string", fn.ipv4_number) == [16909060, None, None]


def test_times(spark):
    got = column(spark, ["2024-01-05T12:00:00Z", "2024-01-05T14:00:00+02:00", "2024-01-05 12:00:00", "nope", "", "2024-13-01"], "string", fn.parse_iso)
    assert got == [AT, AT, AT, None, None, None]
    assert column(spark, ["1704456000", "1704456000.5", "x", "NaN"], "string", fn.parse_epoch)[:2] == [AT, AT.replace(microsecond=500000)]


def test_first_non_empty(spark):
    df = spark.createDataFrame([("", "b"), (None, "b"), ("a", "b"), ("", None)], "x string, y string")
    assert [r[0] for r in df.select(fn.first_non_empty(F.col("x"), F.col("y"))).collect()] == ["b", "b", "a", None]


def message(topic, body, offset=0):
    return ("k", body if isinstance(body, str) else json.dumps(body), topic, 0, offset, AT)


def events(spark, *messages):
    return normalise(spark.createDataFrame(list(messages), ENVELOPE))


def test_edr_fallbacks(spark):
    row = one(events(spark, message(EDR_TOPIC, {"Severity": 7, "FileName": "", "ImageFileName": "x.exe", "LocalPort": "80"})))
    assert (row.event_type, row.severity, row.process_name, row.timestamp, row.source_port) == ("custom", "medium", "x.exe", AT, 80)


def test_siem_epoch_and_empty(spark):
    row = one(events(spark, message(SIEM_TOPIC, {"_time": 1704456000, "urgency": None, "src_ip": "", "src": "h", "sourcetype": "pan:traffic"})))
    assert (row.timestamp, row.severity, row.source_ip, row.event_type) == (AT, "medium", "h", "network")


def test_ndr_dotted_keys_and_notice(spark):
    row = one(events(spark, message(NDR_TOPIC, {"id.orig_h": "1.2.3.4", "notice": "Scan", "_path": "files"})))
    assert (row.source_ip, row.severity, row.event_type) == ("1.2.3.4", "medium", "file")
    quiet = one(events(spark, message(NDR_TOPIC, {"notice": "", "conn_state": "SF"})))
    assert (quiet.severity, quiet.event_type) == ("low", "network")


def test_bad_messages_are_kept_apart(spark):
    good, bad = quarantine(
        events(
            spark, message(EDR_TOPIC, "{oops", 1), message(GENERIC_TOPIC, {"severity": "extreme"}, 2),
            message("elsewhere", {}, 3), message(EDR_TOPIC, {"LocalPort": "80.5"}, 4), message(GENERIC_TOPIC, {}, 5),
        )
    )
    assert [r.reject_reason for r in bad.orderBy("offset").collect()] == [
        "not JSON", "severity outside the enumeration", "unknown topic", "port is not a number",
    ]
    assert one(good).source_category == "unknown"


def test_ids_survive_a_replay(spark):
    first, again = (one(events(spark, message(EDR_TOPIC, {"a": 1}, 9))).event_id for _ in range(2))
    assert first == again


def test_custom_source(spark):
    registry = default_registry()
    registry.register("mine", lambda df: df.select(F.lit("1").alias("event_id"), F.lit("mine").alias("source_system")))
    flow = registry.event_flow({"mine": spark.range(1), GENERIC_TOPIC: spark.createDataFrame([message(GENERIC_TOPIC, {})], ENVELOPE)})
    assert sorted(r.source_system for r in flow.collect()) == ["generic", "mine"]


# --- contracts ---------------------------------------------------------------------------


def check(spark, record, rule, kind="string"):
    schema = ", ".join(f"{k} {kind}" for k in record)
    df = spark.createDataFrame([tuple(record.values())], schema)
    return one(df.select(quality.passed(df, rule, F.lit("2024-01-05 12:05:00").cast("timestamp")).alias("ok"))).ok


@pytest.mark.parametrize(
    "record, rule, expected",
    [
        ({"event_id": "12345"}, Rule("not_null", "event_id"), True),
        ({"other": "value"}, Rule("not_null", "event_id"), False),
        ({"severity": "high"}, Rule("in_set", "severity", options={"values": ["low", "high"]}), True),
        ({"severity": "extreme"}, Rule("in_set", "severity", options={"values": ["low", "high"]}), False),
        ({"severity": None}, Rule("in_set", "severity", options={"values": ["low"]}), False),
        ({"score": "0.75"}, Rule("range", "score", options={"min": 0, "max": 1}), True),
        ({"score": "1.5"}, Rule("range", "score", options={"min": 0, "max": 1}), False),
        ({"score": "1"}, Rule("range", "score", options={"min": 0, "max": 1}), True),
        ({"score": "NaN"}, Rule("range", "score", options={"min": 0, "max": 1}), True),
        ({"score": "high"}, Rule("range", "score", options={"min": 0}), False),
        ({"score": None}, Rule("range", "score", options={}), False),
        ({"t": "2024-01-05T12:00:00Z"}, Rule("freshness", "t", options={"max_age_seconds": 300}), True),
        ({"t": "2024-01-05T11:59:59Z"}, Rule("freshness", "t", options={"max_age_seconds": 300}), False),
        ({"t": "2024-01-05T13:00:00+01:00"}, Rule("freshness", "t", options={"max_age_seconds": 300}), True),
        ({"t": "2030-01-01T00:00:00Z"}, Rule("freshness", "t", options={"max_age_seconds": 1}), True),
        ({"t": "soon"}, Rule("freshness", "t", options={"max_age_seconds": 300}), False),
        ({"h": None}, Rule("regex", "h", options={"pattern": "^a$"}), True),
        ({"h": "b"}, Rule("regex", "h", options={"pattern": "^a$"}), False),
    ],
)
def test_rules(spark, record, rule, expected):
    assert check(spark, record, rule) is expected


def test_two_rules_and_empty_batch(spark):
    rules = [Rule("not_null", "event_id"), Rule("in_set", "severity", options={"values": ["high"]})]
    rows = spark.createDataFrame([("123", "high"), (None, "extreme")], "event_id string, severity string")
    now = F.current_timestamp()
    got = one(quality.batch_summary(rows, rules, now))
    assert (got.total_records, got.passed, got.failed, got.pass_rate) == (2, 1, 1, 0.5)
    assert {f.rule_name: f.failures for f in got.failures_by_rule} == {"not_null_event_id": 1, "in_set_severity": 1}
    empty = one(quality.batch_summary(rows.limit(0), rules, now))
    assert (empty.total_records, empty.pass_rate) == (0, 0.0)


def test_worst_severity_by_rank_and_equal_names(spark):
    rules = [Rule("not_null", "a", "critical"), Rule("not_null", "b", "warning"), Rule("range", "c", "error", options={"min": 0}), Rule("range", "c", "error", options={"max": 9})]
    rows = spark.createDataFrame([(None, None, "5")], "a string, b string, c string")
    got = one(quality.worst_severity(quality.validate(rows, rules, F.current_timestamp())))
    assert (got.worst_severity, got.failed_count) == ("critical", 2)
    assert list(quality.result_columns(rows, rules, F.current_timestamp()))[2:] == ["range_c#2", "range_c#3"]


def test_contract_files(tmp_path):
    from sablewatch.catalog.contracts import CONTRACT_DIR

    loaded, failed = quality.load_contracts(CONTRACT_DIR)
    contract = loaded["edr_endpoint_events"]
    assert not failed and contract.availability == 0.995 and contract.latency_p99_seconds == 60
    assert contract.alert_channel == "#soc-data-quality" and contract.rules[0].severity == "critical"
    (tmp_path / "bad.yaml").write_text("contract: {name: x}")
    (tmp_path / "good.yaml").write_text("contract: {name: y, producer: p}")
    loaded, failed = quality.load_contracts(tmp_path)
    assert list(loaded) == ["y"] and list(failed) == ["bad.yaml"]


def test_custom_rule_kind(spark):
    quality.register_rule("starts", lambda v, r, t: v.startswith(r.options["with"]))
    assert check(spark, {"x": "abc"}, Rule("starts", "x", options={"with": "ab"}))


# --- detection, commands, triage --------------------------------------------------------------


def test_rule_order_and_ports(spark):
    schema = "event_id int, event_type string, severity string, source_system string, process_name string, process_hash string, command_line string, destination_ip string, destination_port int"
    rows = [
        (1, "process", "low", "s", "PowerShell.exe", None, "x -ENC y", None, None),
        (2, "process", "High", "s", "mimikatz.exe", None, None, None, 4444),
        (3, "process", None, "s", "my-PsExec", "", None, None, None),
        (4, "network", "low", "s", None, None, None, None, 31337),
        (5, "network", "low", "s", "powershell", None, None, None, 443),
        (6, "process", "low", "s", "powershell", None, "hidden " + "z" * 300, None, None),
    ]
    df = spark.createDataFrame(rows, schema)
    got = {r.event_id: r for r in detect.first_match(df).collect()}
    assert {k: v.rule for k, v in got.items()} == {1: "powershell", 2: "high_severity", 3: "malicious_tool", 4: "outbound_port", 6: "powershell"}
    assert got[3].description == "Process hash: Unknown" and got[4].description == "Destination: None:31337"
    assert len(got[6].description) == len("Command: ") + 200 and got[2].alert_severity == "high"
    assert detect.all_matches(df).filter("event_id = 2").count() == 3


def test_strict_detection(spark):
    df = spark.createDataFrame([("low", "cmd.exe"), ("HIGH", None), (None, None)], "severity string, process_name string")
    assert detect.stream_detections(df).count() == 2 and detect.stream_detections(df, strict=True).count() == 1


def test_patterns_and_verdict_without_text(spark):
    df = spark.createDataFrame([(None, None, None, None), ("-enccommand; IEX", None, None, None), ("x", "high", None, True)], "command_line string, risk_level string, exfiltration_risk boolean, lateral_risk boolean")
    rows = commands.verdicts(commands.scan_patterns(df)).collect()
    assert rows[0].pattern_confidence is None and not rows[0].is_malicious and rows[0].reasoning == "No malicious indicators found"
    assert rows[1].match_count == 2 and rows[1].confidence == 0.6 and rows[1].needs_sandbox
    assert rows[2].pattern_confidence == 0.3 and rows[2].confidence == 0.8


def test_base64_padding_and_odd_units(spark):
    import base64

    good = base64.b64encode("Write-Output hello world".encode("utf-16-le")).decode()
    df = spark.createDataFrame([(f"a {good} b {good}",), ("A" * 41,), ("short",), (None,)], "command_line string")
    assert [r.decoded_content for r in commands.decode_base64(df).collect()] == ["Write-Output hello world\n---\nWrite-Output hello world"]


def test_triage_edges(spark):
    df = spark.createDataFrame([("a", "low", "Splunk", 0.85, ["x"]), ("b", "critical", "sentinel", 0.1, None), ("c", "odd", None, None, ["IOC", "hash"])], "alert_id string, severity string, source_system string, fp double, enrichment_needed array<string>")
    out = {r.alert_id: r for r in triage.decisions(triage.rule_scores(df).withColumn("false_positive_probability", F.col("fp"))).collect()}
    assert out["a"].triage_score == 0.3 and out["a"].status_recommendation == "false_positive"
    assert out["b"].triage_score == 1.0 and out["b"].follow_up_tasks[0].task_type == "escalation_decision"
    assert out["c"].triage_score == 0.5 and [t.agent_type for t in out["c"].follow_up_tasks] == ["threat_intel", "malware"]


def test_escalation_missing_confidence(spark):
    df = spark.createDataFrame([("a", "low", None, ["T1490"]), ("b", "low", 0.95, None)], "alert_id string, severity string, confidence double, techniques array<string>")
    out = {r.alert_id: r for r in triage.escalations(df).collect()}
    assert out["a"].reasoning == "Low agent confidence: 0.50; High-risk MITRE techniques detected"
    assert not out["b"].escalate and out["b"].reasoning == "No escalation needed"


def test_priority_queue_and_lookup(spark):
    df = spark.createDataFrame([("t1", "a", 3, AT, "pending"), ("t2", "a", 1, AT + dt.timedelta(1), "pending")], "task_id string, agent_type string, priority int, assigned_at timestamp, status string")
    assert one(workflow.next_tasks(df)).task_id == "t1" and one(workflow.next_tasks(df, by_priority=True)).task_id == "t2"
    assert one(workflow.by_id(df, "task_id", "t2")).priority == 1


def test_expired_write_hides_older_one(spark):
    rows = [("k", 1, "old", AT, 99999), ("k", 2, "new", AT + dt.timedelta(seconds=10), 5)]
    df = spark.createDataFrame(rows, "k string, seq int, value string, written_at timestamp, ttl_seconds long")
    assert workflow.live_values(df, ["k"], F.lit("2024-01-05 12:01:00").cast("timestamp")).count() == 0


def test_same_address_twice_gives_one_indicator(spark):
    df = spark.createDataFrame([("185.220.1.1", "185.220.1.1", "evil.xyz", None, "DEADBEEF00")], "source_ip string, destination_ip string, domain string, process_hash string, file_hash string")
    row = one(enrich.with_intel(df))
    assert [i.value for i in row.iocs] == ["185.220.1.1", "evil.xyz", "DEADBEEF00"] and row.threat_actors[0].id == "unknown_apt"
    assert row.reputation == {"185.220.1.1": -80, "evil.xyz": -60}


def test_indicator_table_any_prefix_length(spark):
    feed = spark.createDataFrame([("ip", "1", "prefix", 0.1), ("ip", "1.2.3.", "prefix", 0.5), ("ip", "9.9.9.9", "exact", 0.9), ("domain", "k", "suffix", 0.2)], "type string, pattern string, match string, confidence double")
    values = spark.createDataFrame([("ip", "1.2.3.4"), ("ip", "12.0.0.1"), ("ip", "9.9.9.9"), ("ip", "9.9.9.90"), ("domain", "x.TK")], "type string, value string")
    got = {r.value: r.hit.confidence for r in enrich.match_indicators(values, feed).collect()}
    assert got == {"1.2.3.4": 0.5, "12.0.0.1": 0.1, "9.9.9.9": 0.9, "x.TK": 0.2}


def test_narrowest_range_wins(spark):
    ranges = spark.createDataFrame([(0, 2**32 - 1, "world"), (134744064, 134744319, "dns")], "start_ip long, end_ip long, country string")
    ips = spark.createDataFrame([("8.8.8.8",), ("9.0.0.1",), ("10.0.0.1",)], "ip string")
    assert {r.ip: r.geo.country for r in enrich.locate(ips, ranges).collect()} == {"8.8.8.8": "dns", "9.0.0.1": "world"}
