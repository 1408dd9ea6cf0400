"""From raw messages to routed alerts, through the three lake zones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stable_id
from ..operators import analytics, detect, enrich, quality, similarity, triage
from ..schemas import SEVERITIES
from ..session import materialised, scratch
from ..sources import normalise, quarantine
from ..streaming.sinks import zone_path


def detectable(canonical: DataFrame) -> DataFrame:
    """Canonical events under the names enrichment and detection read."""
    return canonical.withColumnsRenamed(
        {"timestamp": "event_timestamp", "process_command_line": "command_line"}
    )


def triaged_alerts(events: DataFrame, *keep: str) -> DataFrame:
    """Rule hits with alert id, triage score and priority."""
    hits = detect.first_match(events, keep=keep).withColumnRenamed("alert_severity", "severity")
    return triage.rule_scores(hits.withColumn("alert_id", stable_id(F.lit("alert"), F.col("event_id"), F.col("rule"))))


def write_zone(
    df: DataFrame, root: str, zone: str, name: str, time: str | None = None, batch: str = "0", placed: bool = False
) -> DataFrame:
    """Write a batch's part of one zone table, by date, and return that part as read back.

    A batch owns the folder of its name in each table and replaces it, so running a batch again changes
    nothing but that. Later stages read the written table, so parsing and joins run once and a lost
    executor costs no recomputation beyond its own stage. The date keeps scans prunable; rows are
    placed by it so a day becomes few large files. ``placed`` rows come task by task from a table of the
    same dates and are not moved again.
    """
    path = f"{zone_path(root, zone, name)}/batch={batch}"
    writer = df.write
    if time is not None:
        df = df.withColumn("date", F.to_date(time))
        # REBALANCE sizes the output by date and splits a date that holds most rows.
        writer = (df if placed else df.hint("rebalance", "date")).write.partitionBy("date")
    writer.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def zone_table(spark: SparkSession, root: str, zone: str, name: str) -> DataFrame:
    """A whole zone table: the parts of all batches."""
    return spark.read.parquet(zone_path(root, zone, name))


#: What a canonical event must meet to go on; a critical failure keeps it back.
FLOW_RULES = (
    quality.Rule("not_null", "event_id", "critical"), quality.Rule("not_null", "timestamp", "critical"),
    quality.Rule("not_null", "event_type", "critical"), quality.Rule("in_set", "severity", "error", options={"values": SEVERITIES}),
    quality.Rule("not_null", "hostname", "warning"),
)


def contract_gate(good: DataFrame, root: str, batch: str, rules=FLOW_RULES, contract: quality.Contract | None = None, as_of=None):
    """Events that may go on, what the others and the merely doubtful failed, and the gate's verdict.

    ``contract`` adds its rules and may halt the batch; without one only the rows with a critical failure stay back.
    """
    rules = (*rules, *(contract.rules if contract else ()))
    validated = write_zone(quality.validate(good, rules, F.current_timestamp() if as_of is None else as_of), root, "raw", "validated", "timestamp", batch, placed=True)
    violations = write_zone(
        quality.worst_severity(validated).select("event_id", "timestamp", "worst_severity", "failed_count", "failed_rules"),
        root, "raw", "violations", "timestamp", batch, placed=True,
    )
    critical = F.exists("results", lambda r: ~r["passed"] & (r["severity"] == "critical"))
    verdict = quality.gate(validated, contract, halt_on_critical=False) if contract else None
    proceed = verdict is None or verdict.first()["proceed"]
    return validated.where(~critical).drop("results"), violations, proceed


def deduplicated(alerts: DataFrame) -> DataFrame:
    """Alerts with the cluster they belong to and whether they are its first (least id)."""
    compared = alerts.select(
        "alert_id", F.col("rule").alias("detection_rule"), *[c for c in similarity.FIELDS.values() if c != "detection_rule"], "title"
    )
    # Written first, so that its shuffles have gone when the wide alerts are dealt out.
    clusters = materialised(similarity.related_counts(compared).select("alert_id", "cluster", "duplicates"), "alert-clusters")
    return alerts.join(clusters, "alert_id").withColumn("is_first", F.col("cluster") == F.col("alert_id"))


_ALERT_COLUMNS = ("event_timestamp", "techniques", "process_hash", "source_ip", "destination_ip", "hostname")


def run_batch(
    messages: DataFrame, root: str, assets: DataFrame, users: DataFrame, ranges: DataFrame, batch: str = "0",
    contract: quality.Contract | None = None, as_of=None,
) -> dict[str, DataFrame]:
    """One batch through raw, enriched and curated zones; returns the batch's part of each table.

    Broken messages go to ``rejected``, events that fail the gate stay in ``violations``; duplicates of an alert
    stay in ``alerts`` but only the first of a cluster makes tasks and escalations, and ``sent`` holds
    those no equal alert was sent shortly before. A batch its contract halts ends after the gate. Running a batch
    again replaces its parts; with the same messages (and ``as_of``) nothing changes. Shuffles go with the step
    that made them and intermediate tables at the end, so the disk holds the zones and one step's work.
    """
    with scratch(messages.sparkSession):
        return _run_batch(messages, root, assets, users, ranges, batch, contract, as_of)


def _run_batch(messages, root, assets, users, ranges, batch, contract, as_of) -> dict[str, DataFrame]:
    canonical = write_zone(normalise(messages), root, "raw", "events", "timestamp", batch)
    good, bad = quarantine(canonical)
    rejected = write_zone(bad, root, "raw", "rejected", batch=batch)
    passing, violations, proceed = contract_gate(good.drop("date"), root, batch, contract=contract, as_of=as_of)
    out = {"canonical": canonical, "rejected": rejected, "violations": violations}
    if not proceed:
        return out
    events = detectable(passing.drop("date"))
    steps = enrich.default_enrichment(assets, users, ranges, events)
    enriched = write_zone(steps.apply(events), root, "enriched", "events", "event_timestamp", batch, placed=steps.in_place)
    found = triaged_alerts(enriched, *_ALERT_COLUMNS)
    alerts = write_zone(deduplicated(found), root, "curated", "alerts", "event_timestamp", batch)
    first = alerts.where("is_first").withColumn("tactics", F.col("techniques.tactic_name"))
    tasks = write_zone(triage.routed_tasks(first), root, "curated", "tasks", batch=batch)
    judged = triage.escalations(first.withColumn("techniques", F.col("techniques.technique_id")))
    escalated = write_zone(judged.filter("escalate"), root, "curated", "escalations", batch=batch)
    sent = analytics.cooldown(first, F.concat_ws(":", "severity", "title"), "event_timestamp", "alert_id")
    sent = write_zone(sent.withColumnRenamed("id", "alert_id"), root, "curated", "sent", "sent_at", batch)
    return out | {"enriched": enriched, "alerts": alerts, "tasks": tasks, "escalations": escalated, "sent": sent}


def overview(messages: DataFrame, assets: DataFrame, users: DataFrame) -> DataFrame:
    """Alerts by source, rule and severity from raw messages, in one plan."""
    good, _ = quarantine(normalise(messages))
    events = enrich.with_intel(enrich.with_user(enrich.with_asset(detectable(good), assets), users))
    return (
        triaged_alerts(events, "iocs", "asset_criticality")
        .groupBy("source_system", "rule", "severity")
        .agg(
            F.count(F.lit(1)).alias("alerts"), F.count_if(F.size("iocs") > 0).alias("with_indicator"),
            F.count_if(F.col("asset_criticality").isin("high", "critical")).alias("on_critical_asset"),
            F.round(F.avg("triage_score"), 6).alias("avg_triage_score"),
        )
    )


def alert_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..fixtures.views import view

    return overview(view(spark, sf_dir, "messages_in"), view(spark, sf_dir, "assets"), view(spark, sf_dir, "users"))
