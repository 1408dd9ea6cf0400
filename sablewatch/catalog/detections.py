"""Detection rules and command-line analysis."""

import hashlib

from pyspark.sql import functions as F

from ..fixtures.text import AS_OF
from ..fixtures.views import view
from ..operators import commands, detect, triage, workflow
from ..session import shared_dir
from .registry import query

_SEVERE = "coalesce(lower(severity) IN ('high', 'critical'), false)"
_PROC = "coalesce(regexp_matches(process_name, '(?i)(powershell|cmd|wscript|cscript|mshta|certutil|bitsadmin)'), false)"


@query("det_high_severity", f"SELECT event_id, severity FROM sec_events WHERE {_SEVERE}")
def det_high_severity(spark, sf):
    return view(spark, sf, "sec_events").filter(detect.high_severity(F.col("severity"))).select("event_id", "severity")


@query("det_suspicious_process", f"SELECT event_id, process_name FROM sec_events WHERE {_PROC}")
def det_suspicious_process(spark, sf):
    events = view(spark, sf, "sec_events")
    return events.filter(detect.suspicious_process(F.col("process_name"))).select("event_id", "process_name")


@query("det_stream_alerts", f"SELECT event_id, severity, process_name, {_SEVERE} AS in_strict_set FROM sec_events WHERE {_SEVERE} OR {_PROC}")
def det_stream_alerts(spark, sf):
    found = detect.stream_detections(view(spark, sf, "sec_events"))
    strict = F.coalesce(detect.high_severity(F.col("severity")), F.lit(False))
    return found.select("event_id", "severity", "process_name", strict.alias("in_strict_set"))


_R2 = """(contains(lower(process_name), 'powershell') AND (contains(lower(command_line), '-enc') OR contains(lower(command_line), 'bypass')
 OR contains(lower(command_line), 'hidden') OR contains(lower(command_line), 'downloadstring') OR contains(lower(command_line), 'invoke-expression')
 OR contains(lower(command_line), 'iex') OR contains(lower(command_line), 'frombase64') OR contains(lower(command_line), 'webclient')))"""
_R3 = "regexp_matches(lower(process_name), 'mimikatz|rubeus|sharphound|bloodhound|cobalt|beacon|psexec|wmic')"
_R4 = "destination_port IN (4444, 5555, 6666, 8080, 8443, 9001, 31337)"
_RULES = f"""SELECT 1 AS ord, event_id, source_system, 'high_severity' AS rule, 'High severity ' || event_type || ' event' AS title,
  'Detected from ' || source_system AS description, lower(severity) AS alert_severity, cast(0.8 AS double) AS confidence FROM sec_events WHERE {_SEVERE}
 UNION ALL SELECT 2, event_id, source_system, 'powershell', 'Suspicious PowerShell Activity', 'Command: ' || substr(command_line, 1, 200), 'high', 0.85
  FROM sec_events WHERE {_R2}
 UNION ALL SELECT 3, event_id, source_system, 'malicious_tool', 'Known Malicious Tool Detected: ' || process_name,
  'Process hash: ' || coalesce(nullif(process_hash, ''), 'Unknown'), 'critical', 0.95 FROM sec_events WHERE {_R3}
 UNION ALL SELECT 4, event_id, source_system, 'outbound_port', 'Suspicious Outbound Connection on Port ' || destination_port,
  'Destination: ' || coalesce(destination_ip, 'None') || ':' || destination_port, 'medium', 0.7 FROM sec_events WHERE {_R4}"""


@query(
    "det_rules_first_match",
    f"""WITH hits AS ({_RULES}) SELECT event_id, source_system, rule, title, description, alert_severity, confidence FROM hits
      QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY ord) = 1""",
)
def det_rules_first_match(spark, sf):
    return detect.first_match(view(spark, sf, "sec_events"))


@query(
    "det_rules_all_matches",
    f"WITH hits AS ({_RULES}) SELECT event_id, source_system, rule, title, description, alert_severity, confidence FROM hits",
)
def det_rules_all_matches(spark, sf):
    return detect.all_matches(view(spark, sf, "sec_events"))


def _hits_sql():
    rows = []
    for i, (name, pattern) in enumerate(commands.COMMAND_PATTERNS.items()):
        technique = commands.TECHNIQUES.get(name)
        rows.append(
            f"""SELECT event_id, {i} AS ord, '{name}' AS pattern, '{name.replace('_', ' ').title()}' AS description,
              {f"'{technique[2]}'" if technique else 'NULL'} AS technique_id
              FROM sec_events WHERE regexp_matches(command_line, '{pattern}', 'i')"""
        )
    return " UNION ALL ".join(rows)


_SCAN = f"""hits AS ({_hits_sql()}),
 per_event AS (SELECT event_id, count(*) AS n, string_agg(pattern, ',' ORDER BY ord) AS patterns, string_agg(description, ',' ORDER BY ord) AS descriptions,
   string_agg(technique_id, ',' ORDER BY ord) AS techniques FROM hits GROUP BY event_id),
 scan AS (SELECT e.event_id, e.k, e.command_line, coalesce(n, 0) AS match_count, coalesce(patterns, '') AS patterns, coalesce(descriptions, '') AS descriptions,
   coalesce(techniques, '') AS techniques, CASE WHEN command_line IS NOT NULL THEN round(least(0.3 + 0.15 * coalesce(n, 0), 0.95), 4) END AS pattern_confidence
   FROM sec_events e LEFT JOIN per_event p ON p.event_id = e.event_id)"""


@query(
    "scan_cmd_patterns",
    f"""WITH {_SCAN} SELECT event_id, match_count, cast(pattern_confidence AS double) AS pattern_confidence, patterns, descriptions, techniques FROM scan""",
)
def scan_cmd_patterns(spark, sf):
    out = commands.scan_patterns(view(spark, sf, "sec_events"))
    return out.select(
        "event_id", "match_count", "pattern_confidence", F.col("matches.pattern").alias("patterns"),
        F.col("matches.description").alias("descriptions"), "techniques",
    )


# Behaviour columns stand in for what an analyst or a model would deliver.
_BEHAVIOUR_SQL = """CASE k % 5 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' WHEN 3 THEN 'critical' END AS risk_level,
 CASE WHEN k % 7 = 0 THEN true WHEN k % 7 = 1 THEN NULL ELSE false END AS exfiltration_risk, k % 11 = 0 AS lateral_risk"""


def _judged(spark, sf):
    risk = F.when(F.col("k") % 5 == 0, "low").when(F.col("k") % 5 == 1, "medium").when(F.col("k") % 5 == 2, "high").when(
        F.col("k") % 5 == 3, "critical"
    )
    exfil = F.when(F.col("k") % 7 == 0, True).when(F.col("k") % 7 != 1, False)
    events = view(spark, sf, "sec_events").select("event_id", "k", "command_line")
    events = events.withColumn("risk_level", risk).withColumn("exfiltration_risk", exfil).withColumn("lateral_risk", F.col("k") % 11 == 0)
    return commands.verdicts(commands.scan_patterns(events))


_VERDICT = f"""{_SCAN}, b AS (SELECT scan.*, {_BEHAVIOUR_SQL} FROM scan),
 flags AS (SELECT *, match_count >= 2 AS f1, coalesce(risk_level IN ('high', 'critical'), false) AS f2,
   coalesce(exfiltration_risk, false) OR lateral_risk AS f3 FROM b),
 v AS (SELECT event_id, match_count, f1 OR f2 OR f3 AS is_malicious,
   cast(greatest(CASE WHEN f1 THEN pattern_confidence ELSE 0 END, CASE WHEN f2 THEN 0.8 ELSE 0 END, CASE WHEN f3 THEN 0.75 ELSE 0 END) AS double) AS confidence,
   CASE WHEN f1 OR f2 OR f3 THEN concat_ws('; ', CASE WHEN f1 THEN match_count || ' suspicious patterns detected' END,
     CASE WHEN f2 THEN 'High-risk behaviors: ' || risk_level END, CASE WHEN f3 THEN 'Data exfiltration or lateral movement indicators' END)
     ELSE 'No malicious indicators found' END AS reasoning FROM flags),
 w AS (SELECT *, (is_malicious AND confidence < 0.9) OR (match_count >= 1 AND NOT is_malicious) AS needs_sandbox FROM v)"""


@query(
    "cmd_verdict",
    f"""WITH {_VERDICT} SELECT event_id, is_malicious, confidence, reasoning, needs_sandbox,
      CASE WHEN is_malicious THEN 'Quarantine file,Block hash,Hunt for lateral movement' ELSE 'Continue monitoring' END AS recommended_actions FROM w""",
)
def cmd_verdict(spark, sf):
    return _judged(spark, sf).select(
        "event_id", "is_malicious", "confidence", "reasoning", "needs_sandbox", "recommended_actions"
    )


@query(
    "malware_followups",
    f"""WITH {_VERDICT} SELECT event_id, 'response' AS agent_type, 'recommend_actions' AS task_type, cast(1 AS bigint) AS priority FROM w
      WHERE is_malicious AND confidence >= 0.8
      UNION ALL SELECT event_id, 'malware', 'sandbox_analysis', 2 FROM w WHERE needs_sandbox""",
)
def malware_followups(spark, sf):
    return commands.followups(_judged(spark, sf), "event_id")


@query(
    "hash_iocs",
    """SELECT event_id, 'hash' AS type, coalesce(nullif(file_hash, ''), process_hash) AS value,
      CASE length(coalesce(nullif(file_hash, ''), process_hash)) WHEN 32 THEN 'md5' WHEN 40 THEN 'sha1' WHEN 64 THEN 'sha256' WHEN 128 THEN 'sha512' ELSE 'unknown' END AS hash_type,
      cast(0.7 AS double) AS confidence, 'malware_agent' AS source FROM sec_events""",
)
def hash_iocs(spark, sf):
    return commands.hash_indicators(view(spark, sf, "sec_events"), "event_id")


@query(
    "decode_base64_cmd",
    # The only encoded text among the command lines is known.
    """SELECT event_id, 'Write-Output hello from the fixture' AS decoded_content FROM sec_events WHERE event_id % 12 = 0""",
)
def decode_base64_cmd(spark, sf):
    return commands.decode_base64(view(spark, sf, "sec_events")).select("event_id", "decoded_content")


@query(
    "pred_benign_process",
    """SELECT x.alert_id, 'Security tool process: ' || process_name AS indicator, count(*) AS events
      FROM alert_event_ids x JOIN sec_events e ON e.event_id = x.event_id
      WHERE regexp_matches(lower(process_name), 'windows defender|mbam|carbon black|crowdstrike|splunk|tanium|qualys|nessus') GROUP BY x.alert_id, process_name""",
)
def pred_benign_process(spark, sf):
    return triage.benign_indicators(view(spark, sf, "alert_event_ids"), view(spark, sf, "sec_events"))


@query(
    "alert_by_id",
    "SELECT alert_id, title, severity, status FROM alerts WHERE alert_id = sha256('alert:9')",
)
def alert_by_id(spark, sf):
    """One alert out of the table kept for lookups."""
    alerts = view(spark, sf, "alerts").select("alert_id", "title", "severity", "status")
    stored = workflow.write_for_lookup(alerts, "alert_id", shared_dir(spark, "alerts-by-id"))
    return workflow.by_id(stored, "alert_id", hashlib.sha256(b"alert:9").hexdigest())


@query("filter_alerts", "SELECT alert_id, status, severity FROM alerts WHERE status = 'investigating' AND severity = 'high'")
def filter_alerts(spark, sf):
    found = workflow.filtered(view(spark, sf, "alerts"), status="investigating", severity="high")
    return found.select("alert_id", "status", "severity")


@query(
    "filter_incidents",
    "SELECT status, count(*) AS n FROM incidents WHERE rank >= 3 GROUP BY status",
)
def filter_incidents(spark, sf):
    incidents = view(spark, sf, "incidents").withColumn("severity", F.when(F.col("rank") >= 3, "severe"))
    return workflow.filtered(incidents, severity="severe").groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query(
    "message_ttl_filter",
    f"""SELECT message_id, to_agent FROM agent_messages WHERE (to_agent IS NULL OR to_agent = 'malware')
      AND sent_at <= TIMESTAMP '{AS_OF}' AND sent_at + to_seconds(ttl_seconds) > TIMESTAMP '{AS_OF}'""",
)
def message_ttl_filter(spark, sf):
    inbox = workflow.live_messages(view(spark, sf, "agent_messages"), "malware", F.lit(AS_OF).cast("timestamp"))
    return inbox.select("message_id", "to_agent")
