"""The joined-up batch flow, the driver contract and the registered names."""

import datetime as dt
import hashlib
import json
import os
import time

from pyspark.sql import functions as F

import __spark_entry__ as entry
from sablewatch.catalog import ORACLES, QUERIES
from sablewatch.fixtures.views import view
from sablewatch.operators import enrich, quality, triage, workflow
from sablewatch.plans import flow
from sablewatch.schemas import ENVELOPE
from sablewatch.session import shared_dir
from sablewatch.sources.products import GENERIC_TOPIC


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert rows and sum(r.alerts for r in rows) > 0


def test_every_query_has_check_sql():
    # Those of optional modules may have none: SQL cannot express all of them.
    assert set(ORACLES) == set(QUERIES) and len(QUERIES) > 90
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_batch_flow_writes_the_zones(spark, sf):
    out = flow.run_batch(
        view(spark, sf, "messages_in"), shared_dir(spark, "lake"), view(spark, sf, "assets"), view(spark, sf, "users"),
        view(spark, sf, "geo_ranges"),
    )
    counts = {name: df.count() for name, df in out.items()}
    assert counts["canonical"] == 1000
    assert counts["enriched"] + counts["rejected"] == counts["canonical"]
    first = out["alerts"].filter("is_first")
    assert 0 < counts["alerts"] <= counts["enriched"] and counts["tasks"] >= 2 * first.count()
    assert "date" in out["enriched"].columns and "date" in out["alerts"].columns
    severe = first.filter("severity in ('critical', 'high')").count()
    assert severe <= counts["escalations"] <= first.count() <= counts["alerts"]
    assert 0 < counts["sent"] <= first.count()
    assert out["sent"].join(first, "alert_id", "left_anti").count() == 0


def envelope(spark, bodies):
    at = dt.datetime(2024, 1, 5)
    rows = [(str(i), json.dumps(b), GENERIC_TOPIC, 0, i, at) for i, b in enumerate(bodies)]
    return spark.createDataFrame(rows, ENVELOPE)


def test_batches_replace_only_themselves_and_contracts_halt(spark, sf):
    root, dims = shared_dir(spark, "lake"), [view(spark, sf, n) for n in ("assets", "users", "geo_ranges")]
    def body(second, severity="critical"):
        return {"timestamp": f"2024-01-0{1 + second // 60}T10:00:{second % 60:02d}Z", "event_type": "process", "severity": severity}

    def table(name, zone="curated"):
        return flow.zone_table(spark, root, zone, name)

    flow.run_batch(envelope(spark, [body(s) for s in (1, 2, 61)]), root, *dims, batch="a")
    flow.run_batch(envelope(spark, [body(s) for s in (3,)]), root, *dims, batch="b")
    assert table("events", "enriched").groupBy("batch").count().orderBy("batch").collect() == [("a", 3), ("b", 1)]
    # A corrected batch has fewer days: nothing of its first run stays.
    flow.run_batch(envelope(spark, [body(s) for s in (1,)]), root, *dims, batch="a")
    assert table("events", "enriched").groupBy("batch").count().orderBy("batch").collect() == [("a", 1), ("b", 1)]
    rule = quality.Rule("not_null", "hostname", "critical")
    strict = quality.Contract("strict", "1", "p", rules=(rule,), halt_pipeline=True)
    out = flow.run_batch(envelope(spark, [body(9)]), root, *dims, batch="c", contract=strict)
    assert set(out) == {"canonical", "rejected", "violations"} and out["violations"].first().worst_severity == "critical"
    # Without the halt, only the row with the critical failure stays back.
    lenient = quality.Contract("lenient", "1", "p", rules=(rule,))
    assert flow.run_batch(envelope(spark, [body(9)]), root, *dims, batch="d", contract=lenient)["enriched"].count() == 0


def test_lookup_reads_few_rows(spark):
    rows = spark.range(200_000).select(F.sha2(F.col("id").cast("string"), 256).alias("alert_id"), "id")
    stored = workflow.write_for_lookup(rows, "alert_id", shared_dir(spark, "lookup"), group_bytes=1 << 20)
    wanted = hashlib.sha256(b"77777").hexdigest()
    found = workflow.by_id(stored, "alert_id", wanted)
    plan = found._jdf.queryExecution().executedPlan()
    assert f"EqualTo(alert_id,{wanted[:40]}" in plan.toString()
    assert [r.id for r in found.collect()] == [77777]
    leaves, read = plan.collectLeaves(), 0
    for i in range(leaves.size()):
        read += leaves.apply(i).metrics().apply("numOutputRows").value()
    assert 0 < read < 20_000
    # An id inside every range that no group holds: the filters rule all groups out.
    assert workflow.by_id(stored, "alert_id", hashlib.sha256(b"no such id").hexdigest()).count() == 0


def test_routing_summary_has_ten_lines(spark):
    at = dt.datetime(2024, 1, 1, 0, 0, 5)
    events = spark.createDataFrame([(i, "dns", "zeek", "High" if i else None, at) for i in range(30)], "event_id long, event_type string, source_system string, severity string, event_timestamp timestamp")
    links = spark.createDataFrame([("a", i) for i in range(30)] + [("b", 0), ("b", 99), ("c", 99)], "alert_id string, event_id long")
    alerts = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "alert_id string")
    got = {r.alert_id: r.summary for r in workflow.routing_summaries(alerts, links, events).collect()}
    assert got["a"].split("\n")[1:] == ["- dns: zeek (high) at 2024-01-01 00:00:05.000000"] * 9
    assert got["b"] == "- dns: zeek (medium) at 2024-01-01 00:00:05.000000" and got["c"] == got["d"] == "No related events"


def test_tasks_follow_the_techniques_tactics(spark):
    alerts = spark.createDataFrame(
        [("a", "high", ["Execution"]), ("b", "low", []), ("c", "low", None)], "alert_id string, severity string, tactics array<string>",
    )
    agents = {i: {r.agent_type for r in triage.routed_tasks(alerts).collect() if r.alert_id == i} for i in "abc"}
    assert agents["b"] == agents["c"] == {"triage", "threat_intel"} and agents["a"] > agents["b"]


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    names = (files.apply(i).getName() for i in range(files.size()))
    return {n for n in names if n.startswith("shuffle_")}


def test_a_batch_leaves_its_zones_only(spark, sf):
    """Neither shuffle files nor intermediate tables stay, whether or not the driver collects its garbage."""
    base, root = spark.conf.get("spark.checkpoint.dir"), shared_dir(spark, "lake")
    folders, files = set(os.listdir(base)), shuffle_files(spark)
    rows = view(spark, sf, "messages_in").where("event_id < 300")
    out = flow.run_batch(rows, root, view(spark, sf, "assets"), view(spark, sf, "users"), view(spark, sf, "geo_ranges"))
    assert set(os.listdir(base)) - folders == {os.path.basename(root)}
    for _ in range(50):
        # What the gate and the cooldown look up goes by itself; its files hold a row or two.
        if len(left := shuffle_files(spark) - files) <= 16:
            break
        time.sleep(0.2)
    assert len(left) <= 16
    assert out["alerts"].count() > 0
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) in (None, "false")


def test_lookups_cut_to_a_batch_give_the_same_rows(spark, monkeypatch):
    def event(i, host, user, source, destination):
        return (i, host, user, source, destination, None, None, None)

    events = spark.createDataFrame(
        [event(0, "Web-1", "amy", "8.8.8.8", "10.0.0.1"), event(1, None, None, "10.0.0.9", "not an address"), event(2, "", "svc_x", "", None),
         event(3, None, "bob", None, "8.8.9.1"), event(4, "none", "AMY", "9.1.1.1", "8.9.0.0"), event(5, None, None, None, None)],
        "event_id long, hostname string, user_name string, source_ip string, destination_ip string, domain string, process_hash string, file_hash string",
    )
    assets = spark.createDataFrame(
        [("web-1", "low", "a", "d", "x"), ("WEB-1", "high", "b", "d", "x"), ("10.0.0.9", "low", None, None, None), (None, "low", "c", "d", "x"), ("db", "low", "c", "d", "x")],
        "asset_key string, criticality string, owner string, department string, location string",
    )
    users = spark.createDataFrame(
        [("amy", "IT", True, 1.0, None), ("amy", "IT", True, 2.0, None), (None, "X", True, 3.0, True), ("zoe", "X", True, 3.0, True)],
        "username string, department string, privileged boolean, risk_score double, mfa_enabled boolean",
    )
    wide, narrow = (8 << 24, (8 << 24) + (1 << 24) - 1), ((8 << 24) + (8 << 16), (8 << 24) + (8 << 16) + 4095)
    ranges = spark.createDataFrame([(*wide, "A", "AS1"), (*narrow, "B", "AS2"), (*narrow, "B", "AS2"), (1, 5, "C", "AS3"), (None, 5, "D", "AS4")], "start_ip long, end_ip long, country string, asn string")

    def rows(steps):
        return sorted(map(str, steps.apply(events).collect()))

    want = rows(enrich.default_enrichment(assets, users, ranges))
    few = enrich.default_enrichment(assets, users, ranges, events)
    assert few.in_place and rows(few) == want
    assert few.apply(events).select(F.count_if("asset_found"), F.count_if("user_known"), F.count("source_ip_geo"), F.count("destination_ip_geo")).first() == (2, 1, 1, 2)
    # No event is dealt out: whatever moves belongs to the lookups, which go to all workers.
    assert "SortMergeJoin" not in few.apply(events)._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(enrich, "LOOKUP_BYTES", -1)
    many = enrich.default_enrichment(assets, users, ranges, events)
    assert not many.in_place and rows(many) == want
    none = events.where("event_id < 0")
    assert enrich.default_enrichment(assets, users, ranges, none).apply(none).count() == 0
