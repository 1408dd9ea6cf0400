"""Canonical record shapes, enumerations and the fixed values of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values: enumerations -------------------------------------------------
SEVERITIES = ("low", "medium", "high", "critical")
EVENT_TYPES = (
    "authentication", "authorization", "network", "process", "file", "registry",
    "dns", "http", "malware", "vulnerability", "compliance", "custom",
)
ALERT_STATUSES = (
    "new", "triaging", "investigating", "escalated", "resolved", "false_positive", "suppressed",
)
INCIDENT_STATUSES = ("open", "investigating", "containing", "eradicating", "recovering", "closed")
VALIDATION_SEVERITIES = ("info", "warning", "error", "critical")
AGENTS = ("orchestrator", "triage", "malware", "network", "identity", "threat_intel", "response")
# --------------------------------------------------------------------------------


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


S, I, L, D, B, TS = (
    T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType(),
    T.TimestampType(),
)

MITRE = _struct(
    tactic_id=S, tactic_name=S, technique_id=S, technique_name=S,
    subtechnique_id=S, subtechnique_name=S,
)
THREAT_ACTOR = _struct(
    id=S, name=S, aliases=T.ArrayType(S), motivation=S, sophistication=S, confidence=D,
)
IOC = _struct(
    type=S, value=S, confidence=D, source=S, first_seen=TS, last_seen=TS,
    tags=T.ArrayType(S), context=T.MapType(S, S),
)
ASSET = _struct(
    id=S, hostname=S, ip_addresses=T.ArrayType(S), mac_addresses=T.ArrayType(S), os=S,
    os_version=S, asset_type=S, criticality=S, owner=S, department=S, location=S,
    tags=T.ArrayType(S), last_seen=TS,
)
USER = _struct(
    id=S, username=S, email=S, display_name=S, department=S, title=S, manager=S,
    privileged=B, service_account=B, risk_score=D,
)

# Canonical event. Nested context is kept flat until enrichment fills it in, so the
# parquet scan of one zone can prune each field on its own.
CANONICAL_EVENT = _struct(
    event_id=S, correlation_id=S, timestamp=TS, ingestion_time=TS, event_type=S, severity=S,
    confidence=D, source_system=S, source_category=S, hostname=S, user_name=S,
    source_ip=S, destination_ip=S, source_port=I, destination_port=I,
    process_name=S, process_path=S, process_hash=S, process_command_line=S,
    parent_process_name=S, parent_process_hash=S,
    file_name=S, file_path=S, file_hash=S, protocol=S, domain=S, url=S,
    tags=T.ArrayType(S), raw_data=S,
)

# Flat stream event: thirteen nullable strings.
STREAM_EVENT = T.StructType(
    [
        T.StructField(name, S, True)
        for name in (
            "event_id", "timestamp", "event_type", "severity", "source_system", "source_ip",
            "destination_ip", "hostname", "user", "process_name", "process_hash",
            "command_line", "raw_data",
        )
    ]
)

ALERT = _struct(
    alert_id=S, title=S, description=S, severity=S, confidence=D, source_system=S,
    detection_rule=S, status=S, assigned_to=S, events=T.ArrayType(S), incident_id=S,
    mitre_attack=T.ArrayType(MITRE), affected_assets=T.ArrayType(S),
    affected_users=T.ArrayType(S), iocs=T.ArrayType(IOC), triage_score=D,
    recommended_actions=T.ArrayType(S), created_at=TS, updated_at=TS,
    first_event_time=TS, last_event_time=TS, tags=T.ArrayType(S),
)
INCIDENT = _struct(
    incident_id=S, title=S, description=S, severity=S, incident_type=S, status=S, priority=I,
    lead_analyst=S, team=T.ArrayType(S), alerts=T.ArrayType(S), events=T.ArrayType(S),
    affected_assets=T.ArrayType(S), affected_users=T.ArrayType(S), created_at=TS,
    updated_at=TS, detected_at=TS, contained_at=TS, resolved_at=TS, tags=T.ArrayType(S),
)
AGENT_TASK = _struct(
    task_id=S, agent_type=S, task_type=S, priority=I, payload=S, alert_id=S, incident_id=S,
    parent_task_id=S, status=S, assigned_at=TS, started_at=TS, completed_at=TS, result=S,
    confidence=D, error=S, retry_count=I, max_retries=I, timeout_seconds=I,
)
AGENT_MESSAGE = _struct(
    message_id=S, from_agent=S, to_agent=S, message_type=S, content=S, correlation_id=S,
    in_reply_to=S, timestamp=TS, priority=I, ttl_seconds=I,
)
VALIDATION_RESULT = _struct(rule_name=S, passed=B, severity=S, message=S)

# Message envelope shared by the broker source and its file twin.
ENVELOPE = _struct(key=S, value=S, topic=S, partition=I, offset=L, timestamp=TS)
