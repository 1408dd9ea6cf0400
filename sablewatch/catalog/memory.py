"""Graph context, past cases, queues and states."""

from pyspark.sql import functions as F

from ..fixtures.text import AS_OF
from ..fixtures.views import table, view
from ..operators import cases, casetext, graph, records, workflow
from .registry import query

_T = "strftime({0}, '%Y-%m-%d %H:%M:%S.%f')".format


def _props(col="props"):
    return F.array_join(F.transform(F.map_entries(col), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("null")))), ";")


_CASE_ID = "severity || '/' || detection_rule || '/' || coalesce(process_name, 'none')"


@query(
    "sink_case_corpus",
    f"""WITH c AS (SELECT {_CASE_ID} AS case_id, title || ' ' || description AS content, alert_id, created_at AS stored_at, status FROM alerts),
      stored AS (SELECT case_id, arg_min(content, stored_at) AS content, arg_min(alert_id, stored_at) AS alert_id FROM c WHERE status = 'resolved' GROUP BY case_id),
      new AS (SELECT case_id, arg_min(content, stored_at) AS content, arg_min(alert_id, stored_at) AS alert_id FROM c WHERE case_id NOT IN (SELECT case_id FROM stored) GROUP BY case_id)
      SELECT * FROM stored UNION ALL SELECT * FROM new""",
)
def sink_case_corpus(spark, sf):
    rows = view(spark, sf, "alerts").select(
        F.concat_ws("/", "severity", "detection_rule", F.coalesce("process_name", F.lit("none"))).alias("case_id"),
        cases.case_text(F.col("title"), F.col("description")).alias("content"), "alert_id",
        F.col("created_at").alias("stored_at"), "status",
    )
    corpus = cases.append_cases(None, rows.filter(F.col("status") == "resolved").drop("status"))
    return cases.append_cases(corpus, rows.drop("status")).select("case_id", "content", "alert_id")


@query(
    "sink_graph_upsert_nodes",
    """WITH p AS (SELECT node_type, node_id, prop, arg_max(val, (written_at, seq)) AS val FROM node_writes GROUP BY ALL)
      SELECT node_type, node_id, string_agg(prop || '=' || val, ';' ORDER BY prop) AS props FROM p GROUP BY ALL""",
)
def sink_graph_upsert_nodes(spark, sf):
    return graph.upsert_nodes(view(spark, sf, "node_writes")).withColumn("props", _props())


@query(
    "sink_graph_upsert_edges",
    """WITH p AS (SELECT src_type, src_id, rel, dst_type, dst_id, prop, arg_max_null(val, (written_at, seq)) AS val FROM edge_writes GROUP BY ALL)
      SELECT src_type, src_id, rel, dst_type, dst_id, prop || '=' || coalesce(val, 'null') AS props FROM p
      WHERE (src_type, src_id) IN (SELECT (node_type, node_id) FROM node_writes) AND (dst_type, dst_id) IN (SELECT (node_type, node_id) FROM node_writes)""",
)
def sink_graph_upsert_edges(spark, sf):
    nodes = graph.upsert_nodes(view(spark, sf, "node_writes"))
    return graph.upsert_edges(view(spark, sf, "edge_writes"), nodes).withColumn("props", _props())


def _graph(spark, sf):
    return view(spark, sf, "graph_nodes"), view(spark, sf, "graph_edges")


@query(
    "ctx_asset",
    """WITH f AS (SELECT DISTINCT src_id AS node_id, 'vulnerability' AS attribute, dst_id AS value FROM graph_edges WHERE rel = 'HAS_VULNERABILITY'
        UNION SELECT DISTINCT dst_id, 'recent_user', src_id FROM graph_edges WHERE rel = 'ACCESSED')
      SELECT n.node_id, n.criticality, d.dst_id AS department, f.attribute, f.value FROM graph_nodes n
      LEFT JOIN graph_edges d ON d.rel = 'BELONGS_TO' AND d.src_id = n.node_id LEFT JOIN f ON f.node_id = n.node_id WHERE n.node_type = 'Asset'""",
)
def ctx_asset(spark, sf):
    return graph.asset_context(*_graph(spark, sf))


@query(
    "ctx_user",
    """WITH a AS (SELECT src_id, count(DISTINCT dst_id) AS n FROM graph_edges WHERE rel = 'ACCESSED' GROUP BY src_id)
      SELECT n.node_id, coalesce(n.risk_score, 0) AS risk_score, coalesce(n.privileged, false) AS privileged, coalesce(a.n, 0) AS asset_count,
       CASE WHEN g.dst_id IS NOT NULL THEN 'group' END AS attribute, g.dst_id AS value FROM graph_nodes n LEFT JOIN a ON a.src_id = n.node_id
      LEFT JOIN graph_edges g ON g.rel = 'MEMBER_OF' AND g.src_id = n.node_id WHERE n.node_type = 'User'""",
)
def ctx_user(spark, sf):
    return graph.user_context(*_graph(spark, sf))


@query(
    "ctx_ip",
    """SELECT n.node_id, n.reputation, CASE g.rel WHEN 'ASSOCIATED_WITH' THEN 'threat_actor' WHEN 'RESOLVES_TO' THEN 'domain' END AS attribute, g.dst_id AS value
      FROM graph_nodes n LEFT JOIN graph_edges g ON g.src_type = 'IP' AND g.src_id = n.node_id WHERE n.node_type = 'IP'""",
)
def ctx_ip(spark, sf):
    return graph.ip_context(*_graph(spark, sf))


@query(
    "ctx_for_events",
    """WITH ent AS (SELECT event_id, 'asset' AS entity_type, hostname AS entity_value FROM sec_events UNION ALL SELECT event_id, 'user', user_name FROM sec_events
       UNION ALL SELECT event_id, 'ip', source_ip FROM sec_events UNION ALL SELECT event_id, 'ip', destination_ip FROM sec_events
       UNION ALL SELECT event_id, 'domain', domain FROM sec_events UNION ALL SELECT event_id, 'hash', process_hash FROM sec_events),
      c AS (SELECT n.node_id, lower(n.node_type) AS entity_type, n.criticality, n.risk_score, n.reputation, min(CASE WHEN rel = 'BELONGS_TO' THEN dst_id END) AS department,
        count(DISTINCT CASE WHEN rel = 'HAS_VULNERABILITY' THEN dst_id END) AS vulnerabilities, count(DISTINCT CASE WHEN rel = 'MEMBER_OF' THEN dst_id END) AS groups,
        count(DISTINCT CASE WHEN rel = 'RESOLVES_TO' THEN dst_id END) AS domains
        FROM graph_nodes n LEFT JOIN graph_edges e ON e.src_type = n.node_type AND e.src_id = n.node_id GROUP BY ALL)
      SELECT ent.event_id, ent.entity_type, ent.entity_value, c.criticality, c.department, c.risk_score, c.reputation,
       nullif(c.vulnerabilities, 0) AS vulnerabilities, nullif(c.groups, 0) AS groups, nullif(c.domains, 0) AS domains
      FROM ent LEFT JOIN c ON c.entity_type = ent.entity_type AND c.node_id = ent.entity_value WHERE ent.entity_value IS NOT NULL""",
)
def ctx_for_events(spark, sf):
    entities = records.event_entities(view(spark, sf, "sec_events"))
    out = graph.context_for(entities, graph.entity_summary(*_graph(spark, sf)))
    counts = [F.nullif(F.col(c), F.lit(0)).alias(c) for c in ("vulnerabilities", "groups", "domains")]
    return out.select("event_id", "entity_type", "entity_value", "criticality", "department", "risk_score", "reputation", *counts)


@query(
    "similar_cases",
    """WITH x AS (SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings),
      m AS (SELECT label, pos, avg(cast(v AS double)) AS v FROM x GROUP BY label, pos),
      c AS (SELECT label, list(v ORDER BY pos) AS centre FROM m GROUP BY label),
      d AS (SELECT cast(c.label AS bigint) AS query_id, e.vec_id AS case_id, list_distance(cast(e.embedding AS double[]), c.centre) AS distance FROM embeddings e, c),
      r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, case_id) AS rank FROM d)
      SELECT query_id, case_id, round(distance, 6) AS distance, rank FROM r WHERE rank <= 5""",
)
def similar_cases(spark, sf):
    stored = table(spark, sf, "embeddings")
    corpus = stored.select(F.col("vec_id").alias("case_id"), "embedding")
    found = cases.nearest_cases(corpus, cases.label_centroids(stored), k=5)
    return found.withColumn("distance", F.round("distance", 6))


@query(
    "similar_cases_cosine",
    """WITH x AS (SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings),
      m AS (SELECT label, pos, avg(cast(v AS double)) AS v FROM x GROUP BY label, pos),
      c AS (SELECT label, list(v ORDER BY pos) AS centre FROM m GROUP BY label),
      d AS (SELECT cast(c.label AS bigint) AS query_id, e.vec_id AS case_id, cast(e.label AS bigint) AS case_label,
              1 - list_cosine_similarity(cast(e.embedding AS double[]), c.centre) AS distance FROM embeddings e, c WHERE e.label <> 0),
      r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, case_id) AS rank FROM d)
      SELECT query_id, case_id, case_label, round(distance, 6) AS distance, rank FROM r WHERE rank <= 3""",
)
def similar_cases_cosine(spark, sf):
    """The three cases nearest by direction, filtered by a property, with their stored properties."""
    stored = table(spark, sf, "embeddings")
    corpus = stored.select(F.col("vec_id").alias("case_id"), "embedding", "label")
    found = cases.nearest_cases(corpus, cases.label_centroids(stored), k=3, metric="cosine", where=F.col("label") != 0)
    return cases.with_case(found, corpus.select("case_id", F.col("label").alias("case_label"))).withColumn("distance", F.round("distance", 6))


_ALERT_WORDS = "concat_ws(' ', title, description, hostname, command_line)"


@query(
    "top3_cases_per_alert",
    f"""WITH t AS (SELECT alert_id, status, {_ALERT_WORDS} AS text FROM alerts),
      cases AS (SELECT alert_id, text FROM t WHERE status IN ('resolved', 'false_positive')),
      total AS (SELECT count(*) AS n FROM cases),
      texts AS (SELECT DISTINCT text FROM t),
      words AS (SELECT text, word, 1 + ln(count(*)) AS tf FROM (SELECT text, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS word FROM texts) GROUP BY text, word),
      df AS (SELECT word, count(*) AS df FROM cases JOIN words USING (text) GROUP BY word),
      w AS (SELECT text, word, tf * (ln((1 + n) / (1 + coalesce(df, 0))) + 1) AS w FROM words LEFT JOIN df USING (word), total),
      u AS (SELECT text, word, w / sqrt(sum(w * w) OVER (PARTITION BY text)) AS w FROM w),
      pairs AS (SELECT a.text AS asked, b.text AS found, round(sum(a.w * b.w), 9) AS score FROM u a JOIN u b USING (word)
        WHERE a.text IN (SELECT text FROM t WHERE status IN ('new', 'triaging')) AND b.text IN (SELECT text FROM cases) GROUP BY ALL),
      r AS (SELECT t.alert_id, c.alert_id AS case_id, score, row_number() OVER (PARTITION BY t.alert_id ORDER BY score DESC, c.alert_id) AS rank
        FROM t JOIN pairs p ON p.asked = t.text JOIN cases c ON c.text = p.found WHERE t.status IN ('new', 'triaging') AND score > 0)
      SELECT alert_id, rank, case_id, round(score, 6) AS score FROM r WHERE rank <= 3""",
)
def top3_cases_per_alert(spark, sf):
    """For each open alert the three closed ones most alike in text."""
    alerts = view(spark, sf, "alerts").select("alert_id", "status", F.expr(_ALERT_WORDS).alias("text"))
    closed = alerts.where("status in ('resolved', 'false_positive')").select(F.col("alert_id").alias("case_id"), "text")
    asked = alerts.where("status in ('new', 'triaging')").select(F.col("alert_id").alias("query_id"), "text")
    found = casetext.top_cases_by_text(closed, asked, k=3)
    return found.select(F.col("query_id").alias("alert_id"), "rank", "case_id", F.round("score", 6).alias("score"))


@query(
    "procedures_for_task",
    """WITH p(task_type, procedure, step_no, step) AS (VALUES
       ('assess_alert', 'Standard Alert Triage', 1, 'Validate alert source and severity'), ('assess_alert', 'Standard Alert Triage', 2, 'Check for false positive indicators'),
       ('assess_alert', 'Standard Alert Triage', 3, 'Enrich with threat intelligence'), ('assess_alert', 'Standard Alert Triage', 4, 'Determine if escalation needed'),
       ('analyze_artifact', 'Malware Analysis Procedure', 1, 'Calculate file hashes'), ('analyze_artifact', 'Malware Analysis Procedure', 2, 'Check against known malware databases'),
       ('analyze_artifact', 'Malware Analysis Procedure', 3, 'Perform static analysis'), ('analyze_artifact', 'Malware Analysis Procedure', 4, 'Execute in sandbox if needed'),
       ('analyze_artifact', 'Malware Analysis Procedure', 5, 'Extract IOCs'),
       ('recommend_actions', 'Incident Response Procedure', 1, 'Assess scope and impact'), ('recommend_actions', 'Incident Response Procedure', 2, 'Determine containment actions'),
       ('recommend_actions', 'Incident Response Procedure', 3, 'Identify affected assets'), ('recommend_actions', 'Incident Response Procedure', 4, 'Recommend eradication steps'),
       ('recommend_actions', 'Incident Response Procedure', 5, 'Plan recovery actions'))
      SELECT task_id, t.task_type, 'proc_' || replace(lower(procedure), ' ', '_') AS procedure_id, procedure, cast(step_no AS bigint) AS step_no, step
      FROM tasks t JOIN p ON p.task_type = t.task_type""",
)
def procedures_for_task(spark, sf):
    return workflow.procedure_steps(view(spark, sf, "tasks"))


@query(
    "alert_events",
    f"""SELECT x.alert_id, count(*) AS events, {_T('min(event_timestamp)')} AS first_event_time, {_T('max(event_timestamp)')} AS last_event_time
      FROM alert_event_ids x JOIN sec_events e ON e.event_id = x.event_id GROUP BY x.alert_id""",
)
def alert_events(spark, sf):
    return workflow.event_span(view(spark, sf, "alert_event_ids"), view(spark, sf, "sec_events"))


@query(
    "incident_rollup",
    """WITH j AS (SELECT m.incident_id, a.* FROM incident_alerts m JOIN alerts a ON a.alert_id = m.alert_id)
      SELECT incident_id, 'incident' AS kind, cast(NULL AS varchar) AS value, count(*) AS alerts, count(*) FILTER (severity = 'critical') AS critical_alerts FROM j GROUP BY incident_id
      UNION ALL SELECT incident_id, 'asset', hostname, count(*), count(*) FILTER (severity = 'critical') FROM j WHERE hostname IS NOT NULL GROUP BY incident_id, hostname
      UNION ALL SELECT incident_id, 'user', user_name, count(*), count(*) FILTER (severity = 'critical') FROM j WHERE user_name IS NOT NULL GROUP BY incident_id, user_name""",
)
def incident_rollup(spark, sf):
    return workflow.incident_rollup(view(spark, sf, "incident_alerts"), view(spark, sf, "alerts"))


@query(
    "next_task_per_agent",
    f"""SELECT agent_type, arg_min(task_id, (assigned_at, task_id)) AS task_id, arg_min(task_type, (assigned_at, task_id)) AS task_type,
      {_T('min(assigned_at)')} AS assigned_at, count(*) AS waiting FROM tasks WHERE status = 'pending' GROUP BY agent_type""",
)
def next_task_per_agent(spark, sf):
    return workflow.next_tasks(view(spark, sf, "tasks")).select("agent_type", "task_id", "task_type", "assigned_at", "waiting")


@query(
    "latest_live_value",
    f"""WITH l AS (SELECT session_id, item, arg_max(value, (written_at, seq)) AS value, max(written_at) AS written_at, arg_max(ttl_seconds, (written_at, seq)) AS ttl
       FROM kv_writes WHERE written_at <= TIMESTAMP '{AS_OF}' GROUP BY session_id, item)
      SELECT session_id, item, value, {_T('written_at')} AS written_at FROM l WHERE written_at + to_seconds(ttl) > TIMESTAMP '{AS_OF}'""",
)
def latest_live_value(spark, sf):
    live = workflow.live_values(view(spark, sf, "kv_writes"), ["session_id", "item"], F.lit(AS_OF).cast("timestamp"))
    return live.select("session_id", "item", "value", "written_at")


@query(
    "events_per_alert_head",
    """WITH h AS (SELECT *, row_number() OVER (PARTITION BY alert_id ORDER BY event_id) AS line_no FROM alert_event_ids)
      SELECT h.alert_id, line_no, '- Type: ' || event_type || ', Source: ' || coalesce(source_ip, 'N/A') || ' -> ' || coalesce(destination_ip, 'N/A')
       || ', Process: ' || coalesce(process_name, 'N/A') || ', User: ' || coalesce(user_name, 'N/A') AS line
      FROM h JOIN sec_events e ON e.event_id = h.event_id WHERE line_no <= 5""",
)
def events_per_alert_head(spark, sf):
    return workflow.event_heads(view(spark, sf, "alert_event_ids"), view(spark, sf, "sec_events"))


@query(
    "routing_summary",
    f"""WITH h AS (SELECT i.alert_id, e.*, row_number() OVER (PARTITION BY i.alert_id ORDER BY i.event_id) AS line_no
        FROM alert_event_ids i JOIN sec_events e ON e.event_id = i.event_id),
      s AS (SELECT alert_id, string_agg('- ' || event_type || ': ' || source_system || ' (' || lower(coalesce(severity, 'medium')) || ') at ' || {_T('event_timestamp')}, chr(10) ORDER BY line_no) AS lines
        FROM h WHERE line_no <= 10 GROUP BY alert_id)
      SELECT a.alert_id, coalesce(s.lines, 'No related events') AS summary FROM alerts a LEFT JOIN s ON s.alert_id = a.alert_id""",
)
def routing_summary(spark, sf):
    return workflow.routing_summaries(view(spark, sf, "alerts"), view(spark, sf, "alert_event_ids"), view(spark, sf, "sec_events"))


@query(
    "alert_status_current",
    f"""WITH t AS (SELECT *, lag(status) OVER (PARTITION BY alert_id ORDER BY changed_at, step) AS from_status,
       last_value(status) OVER (PARTITION BY alert_id ORDER BY changed_at, step ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS current FROM status_updates)
      SELECT alert_id, step, {_T('changed_at')} AS changed_at, from_status, status AS to_status, current AS current_status FROM t""",
)
def alert_status_current(spark, sf):
    updates = view(spark, sf, "status_updates")
    current = workflow.current_status(updates).select("alert_id", F.col("status").alias("current_status"))
    return workflow.status_transitions(updates).join(current, "alert_id")
