"""Sources, normalisation and projections."""

from pyspark.sql import functions as F

from ..fixtures.text import AS_OF
from ..fixtures.views import view
from ..functions import numeric_severity, severity_rank
from ..operators import records
from ..plans import flow
from ..session import materialised, shared_dir, shuffles_dropped
from ..sources import default_registry, latest_indicators, normalise, parse_flat_events, parse_topics, quarantine
from ..sources.products import EDR_TOPIC, GENERIC_TOPIC, NDR_TOPIC, PRODUCTS, SIEM_TOPIC
from ..sources.topics import CORRUPT
from .registry import query

_T = "strftime({0}, '%Y-%m-%d %H:%M:%S.%f')".format
_J = "json_extract_string(value, '$.\"{0}\"')".format
_NE = "nullif({0}, '')".format


def _iso(expr):
    return f"try_cast({expr} AS timestamp)"


_VALID = "(SELECT * FROM messages_in WHERE json_valid(value))"

_EDR_TYPE = f"""CASE {_J('event_simpleName')}
 WHEN 'ProcessRollup2' THEN 'process' WHEN 'SyntheticProcessRollup2' THEN 'process' WHEN 'ProcessBlocked' THEN 'process'
 WHEN 'NetworkConnectIP4' THEN 'network' WHEN 'NetworkConnectIP6' THEN 'network' WHEN 'DnsRequest' THEN 'dns'
 WHEN 'FileWritten' THEN 'file' WHEN 'NewExecutableWritten' THEN 'file' WHEN 'PeFileWritten' THEN 'file'
 WHEN 'AsepValueUpdate' THEN 'registry' WHEN 'UserLogon' THEN 'authentication' WHEN 'UserLogoff' THEN 'authentication'
 ELSE 'custom' END"""
_EDR_SEV = f"""CASE lower({_J('Severity')}) WHEN 'informational' THEN 'low' WHEN 'low' THEN 'low'
 WHEN 'high' THEN 'high' WHEN 'critical' THEN 'critical' ELSE 'medium' END"""
_EDR_TS = f"""coalesce({_iso(f"coalesce({_NE(_J('timestamp'))}, {_J('ProcessStartTime')})")}, timestamp)"""
_SIEM_TYPE = f"""CASE {_J('sourcetype')} WHEN 'WinEventLog:Security' THEN 'authentication' WHEN 'WinEventLog:System' THEN 'process'
 WHEN 'linux:audit' THEN 'authentication' WHEN 'pan:traffic' THEN 'network' WHEN 'cisco:asa' THEN 'network'
 WHEN 'aws:cloudtrail' THEN 'authorization' ELSE 'custom' END"""
_SIEM_SEV = f"""CASE lower({_J('urgency')}) WHEN 'low' THEN 'low' WHEN 'high' THEN 'high' WHEN 'critical' THEN 'critical' ELSE 'medium' END"""
_SIEM_T = f"coalesce({_NE(_J('_time'))}, {_J('timestamp')})"
_SIEM_TS = f"coalesce(make_timestamp(cast(try_cast({_SIEM_T} AS double) * 1000000 AS bigint)), {_iso(_SIEM_T)}, timestamp)"
_NDR_TYPE = f"""CASE coalesce({_J('_path')}, 'conn') WHEN 'dns' THEN 'dns' WHEN 'http' THEN 'http' WHEN 'files' THEN 'file'
 WHEN 'notice' THEN 'custom' ELSE 'network' END"""
_NDR_SEV = f"""CASE WHEN coalesce({_J('notice')}, '') NOT IN ('', 'false', '0') OR {_J('conn_state')} IN ('S0', 'REJ', 'RSTO', 'RSTOS0')
 THEN 'medium' ELSE 'low' END"""
_NDR_TS = f"coalesce(make_timestamp(cast(round(try_cast({_J('ts')} AS double) * 1000000) AS bigint)), timestamp)"
_ID = "sha256(topic || ':' || partition || ':' || \"offset\")"


def _norm(spark, sf, topic, *columns):
    product = {topic: PRODUCTS[topic]}
    messages = view(spark, sf, "messages_in").filter(F.col("topic") == topic)
    good, _ = quarantine(normalise(messages, product))
    return good.select(*columns)


@query(
    "src_topic_json",
    f"""SELECT topic, key, json_valid(value) AS is_json,
      CASE WHEN json_valid(value) THEN CASE topic WHEN '{EDR_TOPIC}' THEN json_extract_string(value, '$.event_simpleName')
       WHEN '{SIEM_TOPIC}' THEN json_extract_string(value, '$.sourcetype') ELSE json_extract_string(value, '$._path') END END AS kind
      FROM messages_in""",
)
def src_topic_json(spark, sf):
    kinds = {EDR_TOPIC: "event_simpleName", SIEM_TOPIC: "sourcetype", NDR_TOPIC: "_path"}
    parsed = parse_topics(view(spark, sf, "messages_in"), {t: [f] for t, f in kinds.items()})
    corrupt = F.coalesce(*[F.col("parsed").getField(t).getField(CORRUPT) for t in kinds])
    kind = F.coalesce(*[F.col("parsed").getField(t).getField(f) for t, f in kinds.items()])
    return parsed.select("topic", "key", corrupt.isNull().alias("is_json"), kind.alias("kind"))


@query(
    "src_union_all_sources",
    f"""SELECT {_ID} AS event_id, {_T(f"CASE topic WHEN '{EDR_TOPIC}' THEN {_EDR_TS} WHEN '{SIEM_TOPIC}' THEN {_SIEM_TS} ELSE {_NDR_TS} END")} AS timestamp,
      CASE topic WHEN '{EDR_TOPIC}' THEN {_EDR_TYPE} WHEN '{SIEM_TOPIC}' THEN {_SIEM_TYPE} ELSE {_NDR_TYPE} END AS event_type,
      CASE topic WHEN '{EDR_TOPIC}' THEN {_EDR_SEV} WHEN '{SIEM_TOPIC}' THEN {_SIEM_SEV} ELSE {_NDR_SEV} END AS severity,
      CASE topic WHEN '{EDR_TOPIC}' THEN 'crowdstrike' WHEN '{SIEM_TOPIC}' THEN 'splunk' ELSE 'zeek' END AS source_system
      FROM {_VALID} v
      UNION ALL
      SELECT {_ID}, {_T(f"coalesce({_iso(_J('timestamp'))}, timestamp)")}, coalesce({_J('event_type')}, 'custom'),
       coalesce({_J('severity')}, 'medium'), 'generic' FROM generic_in
      WHERE json_valid(value) AND coalesce({_J('event_type')}, 'custom') <> 'telemetry' AND coalesce({_J('severity')}, '') <> 'High'
       AND coalesce({_J('timestamp')}, '') <> '2024-13-45'
      UNION ALL
      SELECT NULL, {_T('seen_at')}, 'custom', 'medium', 'threat_intel' FROM intel_feed""",
)
def src_union_all_sources(spark, sf):
    flow = default_registry().event_flow(
        {
            "products": view(spark, sf, "messages_in"),
            GENERIC_TOPIC: view(spark, sf, "generic_in").drop("event_id"),
            "threat_intel": view(spark, sf, "intel_feed"),
        }
    )
    # The id of a feed record hashes its JSON text, which is engine-specific.
    known = F.when(F.col("source_system") != "threat_intel", F.col("event_id"))
    return flow.select(known.alias("event_id"), "timestamp", "event_type", "severity", "source_system")


@query(
    "src_ioc_snapshot",
    f"""SELECT type, value, arg_max(confidence, (seen_at, seq)) AS confidence, arg_max(source, (seen_at, seq)) AS source,
      {_T('min(seen_at)')} AS first_seen, {_T('max(seen_at)')} AS last_seen, count(*) AS sightings
      FROM intel_feed GROUP BY type, value""",
)
def src_ioc_snapshot(spark, sf):
    return latest_indicators(view(spark, sf, "intel_feed"))


@query(
    "norm_edr",
    f"""SELECT {_ID} AS event_id, {_T(_EDR_TS)} AS timestamp, {_EDR_TYPE} AS event_type, {_EDR_SEV} AS severity,
      'edr' AS source_category, coalesce({_NE(_J('FileName'))}, {_J('ImageFileName')}) AS process_name, {_J('FilePath')} AS process_path,
      {_J('SHA256HashData')} AS process_hash, {_J('CommandLine')} AS process_command_line,
      {_J('ParentBaseFileName')} AS parent_process_name, {_J('ParentProcessSHA256')} AS parent_process_hash,
      {_J('LocalAddressIP4')} AS source_ip, {_J('RemoteAddressIP4')} AS destination_ip,
      cast({_J('LocalPort')} AS bigint) AS source_port, cast({_J('RemotePort')} AS bigint) AS destination_port,
      {_J('DomainName')} AS domain, {_J('TargetFileName')} AS file_name, {_J('TargetFilePath')} AS file_path,
      {_J('TargetFileSHA256')} AS file_hash FROM {_VALID} v WHERE topic = '{EDR_TOPIC}'""",
)
def norm_edr(spark, sf):
    return _norm(
        spark, sf, EDR_TOPIC, "event_id", "timestamp", "event_type", "severity", "source_category", "process_name",
        "process_path", "process_hash", "process_command_line", "parent_process_name", "parent_process_hash",
        "source_ip", "destination_ip", "source_port", "destination_port", "domain", "file_name", "file_path", "file_hash",
    )


@query(
    "norm_siem",
    f"""SELECT {_ID} AS event_id, {_T(_SIEM_TS)} AS timestamp, {_SIEM_TYPE} AS event_type, {_SIEM_SEV} AS severity,
      coalesce({_NE(_J('src_ip'))}, {_J('src')}) AS source_ip, coalesce({_NE(_J('dest_ip'))}, {_J('dest')}) AS destination_ip,
      cast({_J('src_port')} AS bigint) AS source_port, cast({_J('dest_port')} AS bigint) AS destination_port,
      coalesce({_NE(_J('protocol'))}, {_J('transport')}) AS protocol FROM {_VALID} v WHERE topic = '{SIEM_TOPIC}'""",
)
def norm_siem(spark, sf):
    return _norm(
        spark, sf, SIEM_TOPIC, "event_id", "timestamp", "event_type", "severity", "source_ip", "destination_ip",
        "source_port", "destination_port", "protocol",
    )


@query(
    "norm_ndr",
    f"""SELECT {_ID} AS event_id, {_T(_NDR_TS)} AS timestamp, {_NDR_TYPE} AS event_type, {_NDR_SEV} AS severity,
      {_J('id.orig_h')} AS source_ip, {_J('id.resp_h')} AS destination_ip, cast({_J('id.orig_p')} AS bigint) AS source_port,
      cast({_J('id.resp_p')} AS bigint) AS destination_port, {_J('proto')} AS protocol, {_J('query')} AS domain, {_J('uri')} AS url
      FROM {_VALID} v WHERE topic = '{NDR_TOPIC}'""",
)
def norm_ndr(spark, sf):
    return _norm(
        spark, sf, NDR_TOPIC, "event_id", "timestamp", "event_type", "severity", "source_ip", "destination_ip",
        "source_port", "destination_port", "protocol", "domain", "url",
    )


@query(
    "norm_generic",
    f"""SELECT {_ID} AS event_id, {_T(f"coalesce({_iso(_J('timestamp'))}, timestamp)")} AS timestamp, coalesce({_J('event_type')}, 'custom') AS event_type,
       coalesce({_J('severity')}, 'medium') AS severity, coalesce({_J('category')}, 'unknown') AS source_category FROM generic_in
      WHERE json_valid(value) AND coalesce({_J('event_type')}, 'custom') IN ('authentication', 'authorization', 'network', 'process', 'file',
       'registry', 'dns', 'http', 'malware', 'vulnerability', 'compliance', 'custom')
       AND coalesce({_J('severity')}, 'medium') IN ('low', 'medium', 'high', 'critical')
       AND ({_J('timestamp')} IS NULL OR {_iso(_J('timestamp'))} IS NOT NULL)""",
)
def norm_generic(spark, sf):
    messages = view(spark, sf, "generic_in").drop("event_id")
    good, _ = quarantine(normalise(messages, {GENERIC_TOPIC: PRODUCTS[GENERIC_TOPIC]}))
    return good.select("event_id", "timestamp", "event_type", "severity", "source_category")


@query(
    "quarantine_bad_records",
    f"""SELECT topic, cast(partition AS bigint) AS partition, "offset", CASE WHEN NOT json_valid(value) THEN value END AS value, CASE WHEN NOT json_valid(value) THEN 'not JSON'
       WHEN {_J('event_type')} = 'telemetry' THEN 'event_type outside the enumeration'
       WHEN {_J('severity')} = 'High' THEN 'severity outside the enumeration' ELSE 'timestamp does not parse' END AS reject_reason
      FROM (SELECT * FROM messages_in UNION ALL SELECT * FROM generic_in) m WHERE NOT json_valid(value)
       OR (topic = '{GENERIC_TOPIC}' AND ({_J('event_type')} = 'telemetry' OR {_J('severity')} = 'High' OR {_J('timestamp')} = '2024-13-45'))
    """.replace(f"WHEN {_J('event_type')}", f"WHEN topic = '{GENERIC_TOPIC}' AND {_J('event_type')}"),
)
def quarantine_bad_records(spark, sf):
    messages = view(spark, sf, "messages_in").unionByName(view(spark, sf, "generic_in")).drop("event_id")
    _, bad = quarantine(normalise(messages))
    # Two engines write the same JSON object differently; compare the text of broken ones.
    return bad.withColumn("value", F.when(F.col("reject_reason") == "not JSON", F.col("value")))


@query(
    "sev_from_numeric",
    """SELECT event_id, cast(1 + k % 10 AS bigint) AS score, CASE WHEN 1 + k % 10 <= 3 THEN 'low' WHEN 1 + k % 10 <= 5 THEN 'medium'
      WHEN 1 + k % 10 <= 7 THEN 'high' ELSE 'critical' END AS severity FROM events_k""",
)
def sev_from_numeric(spark, sf):
    events = view(spark, sf, "events_k").withColumn("score", 1 + F.col("k") % 10)
    return events.select("event_id", "score", numeric_severity(F.col("score")).alias("severity"))


_FLAT = """SELECT cast(event_id AS varchar) AS event_id, event_type, severity, source_system, source_ip, destination_ip, hostname,
  user_name AS "user", process_name, process_hash, command_line, 'k=' || k AS raw_data"""


@query(
    "parse_event_json",
    f"""{_FLAT}, strftime(event_timestamp, '%Y-%m-%dT%H:%M:%SZ') AS timestamp,
      {_T("event_timestamp + INTERVAL 2 SECOND")} AS kafka_timestamp, {_T("date_trunc('second', event_timestamp)")} AS event_timestamp
      FROM sec_events""",
)
def parse_event_json(spark, sf):
    return parse_flat_events(view(spark, sf, "stream_in")).drop(
        "processing_time", "latency_ms", "severity_normalized", "risk_score"
    )


@query(
    "sev_rank",
    """SELECT cast(event_id AS varchar) AS event_id, severity, cast(CASE WHEN lower(severity) = 'critical' THEN 4 WHEN lower(severity) = 'high' THEN 3
      WHEN lower(severity) = 'medium' THEN 2 ELSE 1 END AS bigint) AS severity_normalized, cast(0.5 AS double) AS risk_score FROM sec_events""",
)
def sev_rank(spark, sf):
    events = parse_flat_events(view(spark, sf, "stream_in"))
    return events.select("event_id", "severity", "severity_normalized", "risk_score")


@query(
    "event_latency_ms",
    f"""SELECT cast(event_id AS varchar) AS event_id,
      epoch_ms(TIMESTAMP '{AS_OF}') - epoch_ms(date_trunc('second', event_timestamp)) AS latency_ms FROM sec_events""",
)
def event_latency_ms(spark, sf):
    events = parse_flat_events(view(spark, sf, "stream_in"), as_of=F.lit(AS_OF).cast("timestamp"))
    return events.select("event_id", "latency_ms")


@query(
    "entity_extract",
    """SELECT event_id, 'asset' AS entity_type, hostname AS entity_value FROM sec_events WHERE hostname IS NOT NULL
      UNION ALL SELECT event_id, 'user', user_name FROM sec_events WHERE user_name IS NOT NULL
      UNION ALL SELECT event_id, 'ip', source_ip FROM sec_events WHERE source_ip IS NOT NULL
      UNION ALL SELECT event_id, 'ip', destination_ip FROM sec_events WHERE destination_ip IS NOT NULL
      UNION ALL SELECT event_id, 'domain', domain FROM sec_events WHERE domain IS NOT NULL
      UNION ALL SELECT event_id, 'hash', process_hash FROM sec_events""",
)
def entity_extract(spark, sf):
    return records.event_entities(view(spark, sf, "sec_events"))


_ALERTED = "lower(severity) IN ('high', 'critical') OR event_id % 9 IN (0, 1, 7)"


@query(
    "alert_project",
    f"""SELECT sha256('alert:' || event_id) AS alert_id, cast(event_id AS varchar) AS event_id,
      'Suspicious activity: ' || coalesce(process_name, 'Unknown process') AS title, severity, source_system, hostname, user_name AS "user",
      cast(0.5 AS double) AS risk_score, {_T("date_trunc('second', event_timestamp)")} AS event_timestamp FROM sec_events""",
)
def alert_project(spark, sf):
    return records.alert_rows(parse_flat_events(view(spark, sf, "stream_in"))).drop("alert_timestamp")


@query(
    "sink_alert_json",
    f"""SELECT sha256('alert:' || event_id) AS key, 'Suspicious activity: ' || coalesce(process_name, 'Unknown process') AS title,
      severity, hostname FROM sec_events WHERE {_ALERTED}""",
)
def sink_alert_json(spark, sf):
    from ..operators.detect import stream_detections

    events = stream_detections(parse_flat_events(view(spark, sf, "stream_in")))
    out = records.alert_messages(records.alert_rows(events))
    back = [F.get_json_object("value", f"$.{f}").alias(f) for f in ("title", "severity", "hostname")]
    return out.select("key", *back)


@query(
    "alert_from_submission",
    """SELECT alert_id, title, severity, 'triaging' AS status, cast(CASE severity WHEN 'critical' THEN 1 WHEN 'high' THEN 2
      WHEN 'medium' THEN 3 WHEN 'low' THEN 4 ELSE 3 END AS bigint) AS task_priority,
      sha256('task:' || alert_id || ':orchestrator') AS task_id FROM alerts""",
)
def alert_from_submission(spark, sf):
    out = records.submitted_alerts(view(spark, sf, "alerts"))
    return out.select("alert_id", "title", "severity", "status", "task_priority", "task_id")


@query(
    "incident_from_alerts",
    """SELECT incident_id, 'manual' AS incident_type, 'open' AS status, count(DISTINCT alert_id) AS alert_count,
      min(alert_id) AS first_alert, max(alert_id) AS last_alert FROM incident_alerts GROUP BY incident_id""",
)
def incident_from_alerts(spark, sf):
    return records.manual_incidents(view(spark, sf, "incident_alerts"))


@query(
    "flow_batch",
    f"""WITH m AS (SELECT count(*) AS n, count(*) FILTER (NOT json_valid(value)) AS bad FROM messages_in)
      SELECT name, CASE name WHEN 'canonical' THEN n WHEN 'rejected' THEN bad WHEN 'enriched' THEN n - bad END AS rows, cast(0 AS bigint) AS repeated, cast(0 AS bigint) AS changed
      FROM m, (VALUES ('canonical'), ('rejected'), ('violations'), ('enriched'), ('alerts'), ('tasks'), ('escalations'), ('sent')) t(name)""",
)
def flow_batch(spark, sf):
    """The whole flow, run twice as one batch: its tables, ids that came up twice, and tables the second run changed."""
    root, seen = shared_dir(spark, "flow"), []
    for _ in range(2):
        tables = flow.run_batch(
            view(spark, sf, "messages_in").drop("event_id"), root, view(spark, sf, "assets"), view(spark, sf, "users"), view(spark, sf, "geo_ranges"),
            batch="2024-01", as_of=F.lit(AS_OF).cast("timestamp"),
        )
        total = None
        for name, df in tables.items():
            ids = {"rejected": ["topic", "partition", "offset"], "tasks": ["task_id"], "alerts": ["alert_id"], "escalations": ["alert_id"], "sent": ["alert_id"]}.get(name, ["event_id"])
            kept = [c for c in df.columns if c not in ("processing_time", "ingested_at")]
            one = df.select(F.xxhash64(F.to_json(F.struct(*kept))).alias("h"), F.xxhash64(*ids).alias("id")).agg(
                F.lit(name).alias("name"), F.count(F.lit(1)).alias("rows"), F.count_distinct("id").alias("ids"), F.sum(F.col("h").cast("decimal(38,0)")).alias("content"),
            )
            total = one if total is None else total.unionByName(one)
        with shuffles_dropped(spark):
            seen.append(materialised(total, "flow-content"))
    before = seen[0].select("name", F.col("rows").alias("was"), F.col("content").alias("had"))
    same = (F.col("rows") == F.col("was")) & F.col("content").eqNullSafe(F.col("had"))
    counted = F.when(F.col("name").isin("canonical", "rejected", "enriched"), F.col("rows"))
    return seen[1].join(before, "name").select("name", counted.alias("rows"), (F.col("rows") - F.col("ids")).alias("repeated"), (~same).cast("bigint").alias("changed"))
