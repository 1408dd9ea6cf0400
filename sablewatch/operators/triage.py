"""Alert triage: scores, false-positive evidence, decisions, routing, escalation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import case_of, lookup, non_empty, picked, stable_id
from .detect import contains_any
from .records import priority_of

# --- fixed values of triage and routing ----------------------------------------------
SEVERITY_SCORES = {"critical": 0.95, "high": 0.8, "medium": 0.5, "low": 0.2}
TRUSTED_SOURCES = ("crowdstrike", "sentinel", "splunk")
BENIGN_PROCESSES = (
    "windows defender", "mbam", "carbon black", "crowdstrike", "splunk", "tanium", "qualys", "nessus",
)
FALSE_POSITIVE_THRESHOLD = 0.85
ESCALATE_THRESHOLD = 0.90
AUTO_CONTAIN_THRESHOLD = 0.90
TASK_TYPES = {
    "triage": "assess_alert",
    "malware": "analyze_artifact",
    "network": "analyze_traffic",
    "identity": "analyze_authentication",
    "threat_intel": "enrich_iocs",
    "response": "recommend_actions",
}
TACTIC_ROUTES = {
    "malware": ("execution", "persistence"),
    "network": ("lateral", "discovery"),
    "identity": ("credential", "privilege"),
}
CATEGORY_ROUTES = {
    "malware": ("triage", "malware", "threat_intel"),
    "network": ("triage", "network", "threat_intel"),
    "authentication": ("triage", "identity"),
    "authorization": ("triage", "identity"),
    "process": ("triage", "malware"),
    "lateral_movement": ("triage", "network", "identity", "threat_intel"),
    "data_exfiltration": ("triage", "network", "threat_intel", "response"),
    "ransomware": ("triage", "malware", "response", "threat_intel"),
}
HIGH_RISK_TECHNIQUES = ("T1486", "T1490", "T1561")
# --------------------------------------------------------------------------------------


def rule_scores(alerts: DataFrame) -> DataFrame:
    """Triage score and priority from severity and source reputation."""
    base = lookup(F.col("severity"), SEVERITY_SCORES, 0.5)
    trusted = F.coalesce(F.lower("source_system").isin(*TRUSTED_SOURCES), F.lit(False))
    return (
        alerts.withColumn(
            "triage_score", F.round(F.when(trusted, F.least(base + 0.1, F.lit(1.0))).otherwise(base), 4)
        )
        .withColumn("recommended_priority", priority_of(F.col("severity")))
        .withColumn("false_positive_probability", F.lit(0.3))
        .withColumn("triage_confidence", F.lit(0.6))
    )


def false_positive_rates(history: DataFrame) -> DataFrame:
    """Share of past alerts flagged as false positives, per detection rule."""
    return history.groupBy("detection_rule").agg(
        F.count(F.lit(1)).alias("alerts"),
        F.avg(F.col("was_false_positive").cast("double")).alias("fp_rate"),
    )


def benign_indicators(alert_events: DataFrame, events: DataFrame) -> DataFrame:
    """Security-tool processes among an alert's events: (alert, indicator, events).

    Counted per process rather than listed per event, so an alert with very many events
    yields few rows. The tool filter runs before the join.
    """
    tools = events.filter(contains_any(F.lower("process_name"), BENIGN_PROCESSES)).select(
        "event_id", F.concat(F.lit("Security tool process: "), F.col("process_name")).alias("indicator")
    )
    return (
        alert_events.join(tools, "event_id")
        .groupBy("alert_id", "indicator")
        .agg(F.count(F.lit(1)).alias("events"))
    )


def false_positive_scores(
    alerts: DataFrame, rates: DataFrame, benign: DataFrame, assets: DataFrame, users: DataFrame
) -> DataFrame:
    """Evidence-based false-positive score per alert.

    ``assets`` has ``(asset_key, criticality)``, ``users`` has ``(username, risk_score)``.
    """
    per_alert = benign.groupBy("alert_id").agg(F.sum("events").alias("benign_events"))
    joined = (
        alerts.join(rates.select("detection_rule", "fp_rate"), "detection_rule", "left")
        .join(per_alert, "alert_id", "left")
        .join(
            assets.select(F.col("asset_key").alias("hostname"), F.col("criticality").alias("asset_criticality")),
            "hostname", "left",
        )
        .join(
            users.select(F.col("username").alias("user_name"), F.col("risk_score").alias("user_risk")),
            "user_name", "left",
        )
    )
    noisy = F.coalesce(F.col("fp_rate") > 0.7, F.lit(False))
    tools = F.coalesce("benign_events", F.lit(0))
    # An unknown user counts as risk 0, an unknown asset is not of low criticality.
    low_risk = F.coalesce(F.col("asset_criticality") == "low", F.lit(False)) & (
        F.coalesce("user_risk", F.lit(0.0)) < 10
    )
    score = F.round(
        F.least(F.when(noisy, 0.3).otherwise(0.0) + tools * 0.2 + F.when(low_risk, 0.1).otherwise(0.0), F.lit(1.0)),
        4,
    )
    likely = score >= FALSE_POSITIVE_THRESHOLD
    return joined.select(
        "alert_id",
        score.alias("false_positive_score"),
        likely.alias("is_likely_false_positive"),
        (noisy.cast("int") + tools + low_risk.cast("int")).alias("indicator_count"),
        F.when(noisy, F.concat(F.lit("High historical FP rate: "), F.round(F.col("fp_rate") * 100).cast("int").cast("string"), F.lit("%"))).alias("history_indicator"),
        F.when(likely, F.array(F.lit("Suppress alert"), F.lit("Add to allowlist")))
        .otherwise(F.array(F.lit("Continue investigation"))).alias("recommended_actions"),
    )


def _task(agent: str, kind: str, priority: Column) -> Column:
    return F.struct(
        F.lit(agent).alias("agent_type"), F.lit(kind).alias("task_type"), priority.cast("int").alias("priority")
    )


def decisions(
    assessed: DataFrame, auto_close: float | None = None, min_confidence: float | None = None
) -> DataFrame:
    """Status, actions and follow-up tasks of assessed alerts.

    Reads ``false_positive_probability``, ``triage_score``, ``recommended_priority`` and the
    string array ``enrichment_needed``. ``auto_close`` resolves alerts whose probability
    reaches it; ``min_confidence`` adds a review action below it (reads
    ``triage_confidence``). Both are off by default.
    """
    fp = F.coalesce("false_positive_probability", F.lit(0.0))
    score = F.coalesce("triage_score", F.lit(0.5))
    priority = F.coalesce("recommended_priority", F.lit(3))
    is_fp = fp >= FALSE_POSITIVE_THRESHOLD
    escalate = ~is_fp & (score >= ESCALATE_THRESHOLD)
    status = F.when(is_fp, "false_positive").otherwise("investigating")
    if auto_close is not None:
        status = F.when(fp >= auto_close, "resolved").otherwise(status)
    actions = [
        F.when(is_fp, F.lit("Mark as likely false positive")),
        F.when(is_fp, F.lit("Update detection rule tuning")),
        F.when(escalate, F.lit("Auto-escalate to incident")),
    ]
    if min_confidence is not None:
        actions.append(F.when(F.col("triage_confidence") < min_confidence, F.lit("Review by analyst")))

    def enrichment(text: Column) -> Column:
        low = F.lower(text)
        return (
            F.when(low.contains("threat") | low.contains("ioc"), _task("threat_intel", "enrich_iocs", priority))
            .when(low.contains("malware") | low.contains("hash"), _task("malware", "analyze_artifact", priority))
        )

    wanted = F.coalesce("enrichment_needed", F.array().cast("array<string>"))
    tasks = F.concat(
        picked([F.when(escalate, _task("orchestrator", "escalation_decision", F.lit(1)))]),
        F.filter(F.transform(wanted, enrichment), lambda t: t.isNotNull()),
    )
    return (
        assessed.withColumn("status_recommendation", status)
        .withColumn("recommended_actions", picked(actions))
        .withColumn("follow_up_tasks", tasks)
    )


def route_set(tactics: Column) -> Column:
    """Sorted set of agents for an array of tactic names."""
    low = F.lower(F.array_join(tactics, "\n"))
    agents = [F.lit("triage"), F.lit("threat_intel")]
    agents += [F.when(contains_any(low, words), F.lit(agent)) for agent, words in TACTIC_ROUTES.items()]
    return F.sort_array(F.array_distinct(picked(agents)))


def routed_tasks(alerts: DataFrame) -> DataFrame:
    """One task per alert and agent; reads the string array ``tactics``."""
    tactics = F.coalesce("tactics", F.array().cast("array<string>"))
    return (
        alerts.select("alert_id", "severity", F.explode_outer(route_set(tactics)).alias("agent_type"))
        .withColumn("task_type", lookup(F.col("agent_type"), TASK_TYPES, "analyze"))
        .withColumn("priority", priority_of(F.col("severity")))
        .withColumn("task_id", stable_id(F.lit("task"), F.col("alert_id"), F.col("agent_type")))
    )


def category_routes(events: DataFrame, category: str = "event_type") -> DataFrame:
    """One row per event and agent of its category; unknown categories go to nobody."""
    routes = case_of(
        (F.col(category) == name, F.array(*[F.lit(a) for a in agents]))
        for name, agents in CATEGORY_ROUTES.items()
    )
    exploded = events.select("event_id", category, F.posexplode_outer(routes).alias("step", "agent_type"))
    return exploded.filter(F.col("agent_type").isNotNull())


def escalations(alerts: DataFrame, threshold: float = AUTO_CONTAIN_THRESHOLD) -> DataFrame:
    """Whether a human must look, and why; reads ``confidence`` and array ``techniques``."""
    confidence = F.coalesce("confidence", F.lit(0.5))
    severe = F.coalesce(F.col("severity").isin("critical", "high"), F.lit(False))
    risky = F.coalesce(
        F.arrays_overlap("techniques", F.array(*[F.lit(t) for t in HIGH_RISK_TECHNIQUES])), F.lit(False)
    )
    unsure = confidence < threshold
    reasons = picked(
        [
            F.when(severe, F.concat(F.lit("High severity: "), F.col("severity"))),
            F.when(unsure, F.format_string("Low agent confidence: %.2f", confidence)),
            F.when(risky, F.lit("High-risk MITRE techniques detected")),
        ]
    )
    escalate = severe | unsure | risky
    return alerts.select(
        "alert_id",
        escalate.alias("escalate"),
        F.coalesce(non_empty(F.array_join(reasons, "; ")), F.lit("No escalation needed")).alias("reasoning"),
        confidence.alias("agent_confidence"),
        F.when(escalate, F.array(F.lit("Escalate to SOC analyst"), F.lit("Page on-call if after hours")))
        .otherwise(F.array(F.lit("Continue automated analysis"))).alias("recommended_actions"),
    )
