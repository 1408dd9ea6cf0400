"""Triage, deduplication, routing and escalation."""

from pyspark.sql import functions as F

from ..fixtures.views import view
from ..operators import similarity, triage, workflow
from .registry import query

_SCORE = """round(CASE WHEN lower(source_system) IN ('crowdstrike', 'sentinel', 'splunk') THEN least(b + 0.1, 1.0) ELSE b END, 4)"""
_SCORED = f"""scored AS (SELECT *, cast({_SCORE} AS double) AS triage_score FROM (SELECT *, CASE severity WHEN 'critical' THEN 0.95
  WHEN 'high' THEN 0.8 WHEN 'low' THEN 0.2 ELSE 0.5 END AS b, CASE severity WHEN 'critical' THEN 1 WHEN 'high' THEN 2 WHEN 'low' THEN 4 ELSE 3 END AS prio
  FROM alerts) x)"""


@query(
    "triage_score_rules",
    f"""WITH {_SCORED} SELECT alert_id, triage_score, cast(prio AS bigint) AS recommended_priority, cast(0.3 AS double) AS false_positive_probability,
      cast(0.6 AS double) AS triage_confidence FROM scored""",
)
def triage_score_rules(spark, sf):
    out = triage.rule_scores(view(spark, sf, "alerts"))
    return out.select("alert_id", "triage_score", "recommended_priority", "false_positive_probability", "triage_confidence")


@query(
    "fp_rate_by_rule",
    """SELECT detection_rule, count(*) AS alerts, round(avg(CASE WHEN was_false_positive THEN 1.0 ELSE 0.0 END), 9) AS fp_rate
      FROM alerts GROUP BY detection_rule""",
)
def fp_rate_by_rule(spark, sf):
    return triage.false_positive_rates(view(spark, sf, "alerts")).withColumn("fp_rate", F.round("fp_rate", 9))


@query(
    "fp_score",
    """WITH rates AS (SELECT detection_rule, avg(CASE WHEN was_false_positive THEN 1.0 ELSE 0.0 END) AS fp FROM alerts GROUP BY 1),
      benign AS (SELECT x.alert_id, count(*) AS n FROM alert_event_ids x JOIN sec_events e ON e.event_id = x.event_id
        WHERE regexp_matches(lower(process_name), 'windows defender|mbam|carbon black|crowdstrike|splunk|tanium|qualys|nessus') GROUP BY x.alert_id),
      j AS (SELECT l.alert_id, r.fp > 0.7 AS noisy, r.fp, coalesce(b.n, 0) AS n,
        coalesce(a.criticality = 'low', false) AND coalesce(u.risk_score, 0) < 10 AS low_risk
        FROM alerts l JOIN rates r ON r.detection_rule = l.detection_rule LEFT JOIN benign b ON b.alert_id = l.alert_id
        LEFT JOIN assets a ON a.asset_key = l.hostname LEFT JOIN users u ON u.username = l.user_name),
      s AS (SELECT *, cast(round(least(CASE WHEN noisy THEN 0.3 ELSE 0 END + 0.2 * n + CASE WHEN low_risk THEN 0.1 ELSE 0 END, 1.0), 4) AS double) AS score FROM j)
      SELECT alert_id, score AS false_positive_score, score >= 0.85 AS is_likely_false_positive,
       cast(noisy AS bigint) + n + cast(low_risk AS bigint) AS indicator_count,
       CASE WHEN noisy THEN 'High historical FP rate: ' || cast(round(fp * 100) AS bigint) || '%' END AS history_indicator,
       CASE WHEN score >= 0.85 THEN 'Suppress alert,Add to allowlist' ELSE 'Continue investigation' END AS recommended_actions FROM s""",
)
def fp_score(spark, sf):
    alerts, events = view(spark, sf, "alerts"), view(spark, sf, "sec_events")
    return triage.false_positive_scores(
        alerts, triage.false_positive_rates(alerts),
        triage.benign_indicators(view(spark, sf, "alert_event_ids"), events),
        view(spark, sf, "assets"), view(spark, sf, "users"),
    )


# The probability and the wish list stand in for an analyst's or a model's assessment.
_ASSESSED = f"""{_SCORED}, assessed AS (SELECT *, (k % 21) / 20.0 AS fp,
  CASE k % 6 WHEN 0 THEN ['Threat actor lookup', 'malware sample'] WHEN 1 THEN ['file HASH check'] WHEN 2 THEN ['IOC sweep'] WHEN 3 THEN ['whois'] END AS wants FROM scored)"""


def _assessed(spark, sf):
    def texts(*values):
        return F.array(*[F.lit(v) for v in values])

    m = F.col("k") % 6
    wants = F.when(m == 0, texts("Threat actor lookup", "malware sample")).when(m == 1, texts("file HASH check")).when(
        m == 2, texts("IOC sweep")
    ).when(m == 3, texts("whois"))
    return (
        triage.rule_scores(view(spark, sf, "alerts"))
        .withColumn("false_positive_probability", (F.col("k") % 21) / 20)
        .withColumn("enrichment_needed", wants)
    )


@query(
    "triage_decision",
    f"""WITH {_ASSESSED} SELECT alert_id, CASE WHEN fp >= 0.85 THEN 'false_positive' ELSE 'investigating' END AS status_recommendation,
      CASE WHEN fp >= 0.85 THEN 'Mark as likely false positive,Update detection rule tuning' WHEN triage_score >= 0.9 THEN 'Auto-escalate to incident' ELSE '' END AS recommended_actions,
      concat_ws(',', CASE WHEN fp < 0.85 AND triage_score >= 0.9 THEN 'orchestrator:escalation_decision:1' END,
       CASE k % 6 WHEN 0 THEN 'threat_intel:enrich_iocs:' || prio || ',malware:analyze_artifact:' || prio WHEN 1 THEN 'malware:analyze_artifact:' || prio
        WHEN 2 THEN 'threat_intel:enrich_iocs:' || prio END) AS follow_up_tasks FROM assessed""",
)
def triage_decision(spark, sf):
    out = triage.decisions(_assessed(spark, sf))
    tasks = F.transform("follow_up_tasks", lambda t: F.concat_ws(":", t["agent_type"], t["task_type"], t["priority"].cast("string")))
    return out.select("alert_id", "status_recommendation", "recommended_actions", tasks.alias("follow_up_tasks"))


@query(
    "alert_pair_similarity",
    """WITH f AS (SELECT alert_id, nullif(process_hash, '') AS h, nullif(detection_rule, '') AS r, nullif(source_ip, '') AS s, nullif(destination_ip, '') AS d,
        nullif(hostname, '') AS o, list_sort(list_distinct(list_filter(string_split_regex(lower(title), '\\s+'), lambda x: x <> ''))) AS t FROM alerts),
      p AS (SELECT h, r, s, d, o, t, count(*) AS n, min(alert_id) AS alert_id FROM f GROUP BY ALL),
      m AS (SELECT 'hrsd' AS combo, [h, r, s, d] AS key, * FROM p WHERE h || r || s || d IS NOT NULL
       UNION ALL SELECT 'hrso', [h, r, s, o], * FROM p WHERE h || r || s || o IS NOT NULL
       UNION ALL SELECT 'hrdo', [h, r, d, o], * FROM p WHERE h || r || d || o IS NOT NULL
       UNION ALL SELECT 'hsdo', [h, s, d, o], * FROM p WHERE h || s || d || o IS NOT NULL
       UNION ALL SELECT 'hro', [h, r, o, cast(t AS varchar)], * FROM p WHERE h || r || o IS NOT NULL
       UNION ALL SELECT 'hsd', [h, s, d, cast(t AS varchar)], * FROM p WHERE h || s || d IS NOT NULL
       UNION ALL SELECT 'rsdo', [r, s, d, o, cast(t AS varchar)], * FROM p WHERE r || s || d || o IS NOT NULL
       UNION ALL SELECT 'hrs', [h, r, s, cast(t AS varchar)], * FROM p WHERE h || r || s IS NOT NULL
       UNION ALL SELECT 'hrd', [h, r, d, cast(t AS varchar)], * FROM p WHERE h || r || d IS NOT NULL),
      g AS (SELECT combo, key, min(alert_id) AS anchor_id, sum(n) AS group_size FROM m GROUP BY combo, key)
      SELECT g.combo, g.anchor_id, m.alert_id, m.n AS equal_alerts, cast(group_size AS bigint) AS group_size,
       round((CASE WHEN m.h = a.h THEN 30 ELSE 0 END + CASE WHEN m.r = a.r THEN 20 ELSE 0 END + CASE WHEN m.s = a.s THEN 15 ELSE 0 END
        + CASE WHEN m.d = a.d THEN 15 ELSE 0 END + CASE WHEN m.o = a.o THEN 10 ELSE 0 END
        + cast(len(list_intersect(m.t, a.t)) AS double) * 10 / len(list_distinct(m.t || a.t))) / 100, 6) AS similarity
      FROM m JOIN g ON g.combo = m.combo AND g.key = m.key JOIN p a ON a.alert_id = g.anchor_id WHERE m.alert_id <> g.anchor_id""",
)
def alert_pair_similarity(spark, sf):
    return similarity.anchored_scores(view(spark, sf, "alerts"))


@query(
    "alert_dedup",
    # Brute force over all pairs that share the hash, or all four other fields.
    """WITH f AS (SELECT alert_id, process_hash AS h, detection_rule AS r, source_ip AS s, destination_ip AS d, hostname AS o,
        list_sort(list_distinct(string_split_regex(lower(title), '\\s+'))) AS t FROM alerts),
      p AS (SELECT h, r, s, d, o, t, count(*) AS n, min(alert_id) AS first_id FROM f GROUP BY ALL),
      q AS (SELECT *, row_number() OVER (ORDER BY first_id) AS pid FROM p),
      titles AS (SELECT DISTINCT t FROM q),
      jac AS (SELECT a.t AS t1, b.t AS t2, cast(len(list_intersect(a.t, b.t)) AS double) / len(list_distinct(a.t || b.t)) AS j FROM titles a, titles b),
      pairs AS (SELECT a.pid, b.pid AS other, a.t AS t1, b.t AS t2, b.n, b.first_id AS ofirst, 30 + CASE WHEN a.r = b.r THEN 20 ELSE 0 END + CASE WHEN a.s = b.s THEN 15 ELSE 0 END
         + CASE WHEN a.d = b.d THEN 15 ELSE 0 END + CASE WHEN a.o = b.o THEN 10 ELSE 0 END AS base FROM q a JOIN q b ON a.h = b.h
        UNION ALL SELECT a.pid, b.pid, a.t, b.t, b.n, b.first_id, 60 FROM q a JOIN q b ON a.r = b.r AND a.s = b.s AND a.d = b.d AND a.o = b.o AND a.h IS DISTINCT FROM b.h),
      scored AS (SELECT pid, other, n, ofirst, base + 10 * j AS score FROM pairs JOIN jac ON jac.t1 = pairs.t1 AND jac.t2 = pairs.t2 WHERE base >= 60),
      counted AS (SELECT pid, sum(CASE WHEN score >= 92 THEN n ELSE 0 END) - max(CASE WHEN other = pid AND score >= 92 THEN 1 ELSE 0 END) AS duplicates,
        sum(CASE WHEN score >= 69.999999 AND score < 92 THEN n ELSE 0 END) - max(CASE WHEN other = pid AND score >= 69.999999 AND score < 92 THEN 1 ELSE 0 END) AS related,
        min(CASE WHEN score >= 92 THEN ofirst END) AS dup_first
        FROM scored GROUP BY pid)
      SELECT f.alert_id, CASE WHEN dup_first < f.alert_id THEN dup_first ELSE f.alert_id END AS cluster,
       cast(coalesce(duplicates, 0) AS bigint) AS duplicates, cast(coalesce(related, 0) AS bigint) AS related, (SELECT count(*) - 1 FROM alerts) AS total_compared,
       CASE WHEN coalesce(duplicates, 0) > 0 THEN 'process_hash,detection_rule,source_ip,destination_ip,hostname' END AS matching_features
      FROM f JOIN q ON q.h IS NOT DISTINCT FROM f.h AND q.r IS NOT DISTINCT FROM f.r AND q.s IS NOT DISTINCT FROM f.s AND q.d IS NOT DISTINCT FROM f.d
        AND q.o IS NOT DISTINCT FROM f.o AND q.t = f.t LEFT JOIN counted c ON c.pid = q.pid""",
)
def alert_dedup(spark, sf):
    return similarity.related_counts(view(spark, sf, "alerts"))


@query(
    "alert_matches",
    # All pairs of the newest hour's alerts with every other alert.
    """WITH f AS (SELECT alert_id, created_at, nullif(process_hash, '') AS h, nullif(detection_rule, '') AS r, nullif(source_ip, '') AS s, nullif(destination_ip, '') AS d,
        nullif(hostname, '') AS o, list_sort(list_distinct(list_filter(string_split_regex(lower(title), '\\s+'), lambda x: x <> ''))) AS t FROM alerts),
      q AS (SELECT * FROM f WHERE created_at >= (SELECT max(created_at) FROM alerts) - INTERVAL 1 HOUR),
      scored AS (SELECT q.alert_id AS query_id, f.alert_id,
        round((CASE WHEN q.h = f.h THEN 30 ELSE 0 END + CASE WHEN q.r = f.r THEN 20 ELSE 0 END + CASE WHEN q.s = f.s THEN 15 ELSE 0 END
         + CASE WHEN q.d = f.d THEN 15 ELSE 0 END + CASE WHEN q.o = f.o THEN 10 ELSE 0 END
         + CASE WHEN len(q.t) + len(f.t) > 0 THEN cast(len(list_intersect(q.t, f.t)) AS double) * 10 / len(list_distinct(q.t || f.t)) ELSE 0 END) / 100, 6) AS similarity,
        concat_ws(',', CASE WHEN q.h = f.h THEN 'process_hash' END, CASE WHEN q.r = f.r THEN 'detection_rule' END, CASE WHEN q.s = f.s THEN 'source_ip' END,
         CASE WHEN q.d = f.d THEN 'destination_ip' END, CASE WHEN q.o = f.o THEN 'hostname' END) AS matching
        FROM q JOIN f ON q.alert_id <> f.alert_id)
      SELECT query_id, alert_id, similarity, CASE WHEN similarity >= 0.92 THEN 'duplicate' ELSE 'related' END AS kind,
       CASE WHEN similarity >= 0.92 THEN matching END AS matching_features FROM scored WHERE similarity >= 0.7""",
)
def alert_matches(spark, sf):
    alerts = view(spark, sf, "alerts")
    new = alerts.filter(F.col("created_at") >= alerts.agg(F.max("created_at")).scalar() - F.expr("INTERVAL 1 HOUR"))
    return similarity.similar_to(new, alerts)


_ROUTES = """SELECT alert_id, severity, unnest(list_filter(['triage', 'threat_intel', CASE WHEN tactic_name IN ('Execution', 'Persistence') THEN 'malware' END,
  CASE WHEN tactic_name IN ('Lateral Movement', 'Discovery') THEN 'network' END, CASE WHEN tactic_name = 'Credential Access' THEN 'identity' END], lambda x: x IS NOT NULL)) AS agent_type FROM alerts"""


@query(
    "route_alerts",
    f"""WITH r AS ({_ROUTES}) SELECT alert_id, agent_type, CASE agent_type WHEN 'triage' THEN 'assess_alert' WHEN 'malware' THEN 'analyze_artifact'
      WHEN 'network' THEN 'analyze_traffic' WHEN 'identity' THEN 'analyze_authentication' ELSE 'enrich_iocs' END AS task_type,
      cast(CASE severity WHEN 'critical' THEN 1 WHEN 'high' THEN 2 WHEN 'low' THEN 4 ELSE 3 END AS bigint) AS priority,
      sha256('task:' || alert_id || ':' || agent_type) AS task_id FROM r""",
)
def route_alerts(spark, sf):
    alerts = view(spark, sf, "alerts").withColumn("tactics", F.array_compact(F.array("tactic_name")))
    return triage.routed_tasks(alerts).select("alert_id", "agent_type", "task_type", "priority", "task_id")


@query(
    "route_by_category",
    """SELECT event_id, event_type, cast(g.pos AS bigint) AS step, g.agent AS agent_type FROM sec_events JOIN (VALUES ('process', 0, 'triage'), ('process', 1, 'malware'),
      ('authentication', 0, 'triage'), ('authentication', 1, 'identity')) g(category, pos, agent) ON g.category = event_type""",
)
def route_by_category(spark, sf):
    return triage.category_routes(view(spark, sf, "sec_events"))


@query(
    "escalation",
    """WITH f AS (SELECT alert_id, severity, severity IN ('critical', 'high') AS severe, confidence, confidence < 0.9 AS unsure, coalesce(technique_id = 'T1486', false) AS risky FROM alerts)
      SELECT alert_id, severe OR unsure OR risky AS escalate, confidence AS agent_confidence,
      CASE WHEN severe OR unsure OR risky THEN concat_ws('; ', CASE WHEN severe THEN 'High severity: ' || severity END,
       CASE WHEN unsure THEN 'Low agent confidence: ' || printf('%.2f', confidence) END, CASE WHEN risky THEN 'High-risk MITRE techniques detected' END)
       ELSE 'No escalation needed' END AS reasoning,
      CASE WHEN severe OR unsure OR risky THEN 'Escalate to SOC analyst,Page on-call if after hours' ELSE 'Continue automated analysis' END AS recommended_actions FROM f""",
)
def escalation(spark, sf):
    alerts = view(spark, sf, "alerts").withColumn("techniques", F.array_compact(F.array("technique_id")))
    return triage.escalations(alerts)


@query(
    "batch_head",
    """SELECT alert_id, severity, cast(CASE severity WHEN 'critical' THEN 1 WHEN 'high' THEN 2 WHEN 'low' THEN 4 ELSE 3 END AS bigint) AS priority,
      (SELECT count(*) FROM alerts) AS total_alerts FROM alerts ORDER BY priority, alert_id LIMIT 50""",
)
def batch_head(spark, sf):
    from ..operators.records import priority_of

    alerts = view(spark, sf, "alerts").select("alert_id", "severity", priority_of(F.col("severity")).alias("priority"))
    return workflow.batch_head(alerts)


@query(
    "page_alerts",
    """SELECT alert_id, severity, status, (SELECT count(*) FROM alerts WHERE severity = 'critical') AS total
      FROM alerts WHERE severity = 'critical' ORDER BY created_at DESC, alert_id LIMIT 50 OFFSET 50""",
)
def page_alerts(spark, sf):
    critical = workflow.filtered(view(spark, sf, "alerts"), severity="critical")
    return workflow.page(critical, limit=50, offset=50).select("alert_id", "severity", "status", "total")
