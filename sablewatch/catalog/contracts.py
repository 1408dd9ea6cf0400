"""Data-contract checks on contract records."""

from pathlib import Path

from pyspark.sql import functions as F

from ..fixtures.views import view
from ..operators import quality
from ..operators.quality import Rule
from .registry import query

CONTRACT_DIR = Path(__file__).resolve().parents[2] / "contracts"


def _contract():
    contracts, failed = quality.load_contracts(CONTRACT_DIR)
    if failed:
        raise ValueError(f"contracts did not load: {failed}")
    return contracts["edr_endpoint_events"]


def _records(spark, sf):
    return view(spark, sf, "contract_records")


# Records are judged as of their own arrival plus 220 s, so some are stale.


def _as_of():
    return F.timestamp_add("SECOND", F.lit(220), F.col("received_at"))


_AS_OF_SQL = "(received_at + INTERVAL 220 SECOND)"


def _flags(spark, sf, rules):
    rows = _records(spark, sf)
    checks = quality.result_columns(rows, rules, _as_of())
    return rows.select("row_id", *[ok.alias(name) for name, ok in checks.items()])


@query(
    "dq_not_null",
    """SELECT row_id, event_id IS NOT NULL AS not_null_event_id, "timestamp" IS NOT NULL AS not_null_timestamp,
      hostname IS NOT NULL AS not_null_hostname, false AS not_null_absent_field FROM contract_records""",
)
def dq_not_null(spark, sf):
    return _flags(spark, sf, [Rule("not_null", f) for f in ("event_id", "timestamp", "hostname", "absent_field")])


@query(
    "dq_in_set",
    """SELECT row_id, coalesce(severity IN ('low', 'medium', 'high', 'critical'), false) AS in_set_severity,
      event_type <> 'Heartbeat' AS in_set_event_type FROM contract_records""",
)
def dq_in_set(spark, sf):
    return _flags(spark, sf, [r for r in _contract().rules if r.kind == "in_set"])


@query(
    "dq_range",
    """SELECT row_id, coalesce(isnan(try_cast(confidence AS double)) OR try_cast(confidence AS double) BETWEEN 0 AND 1, false) AS range_confidence,
      risk_score BETWEEN 10 AND 90 AS range_risk_score, coalesce(try_cast(destination_port AS double) <= 1024, false) AS range_destination_port
      FROM contract_records""",
)
def dq_range(spark, sf):
    rules = [
        Rule("range", "confidence", options={"min": 0, "max": 1}),
        Rule("range", "risk_score", options={"min": 10, "max": 90}),
        Rule("range", "destination_port", options={"max": 1024}),
    ]
    return _flags(spark, sf, rules)


_FRESH = f"""coalesce(epoch_us({_AS_OF_SQL}) - epoch_us(try_cast("timestamp" AS timestamp)) <= 300000000, false)"""


@query("dq_freshness", f"SELECT row_id, {_FRESH} AS freshness_timestamp FROM contract_records")
def dq_freshness(spark, sf):
    return _flags(spark, sf, [r for r in _contract().rules if r.kind == "freshness"])


_CHECKS = [
    ("not_null_event_id", "critical", "event_id IS NOT NULL"),
    ("not_null_timestamp", "critical", '"timestamp" IS NOT NULL'),
    ("not_null_hostname", "error", "hostname IS NOT NULL"),
    ("not_null_event_type", "error", "event_type IS NOT NULL"),
    ("in_set_severity", "error", "coalesce(severity IN ('low', 'medium', 'high', 'critical'), false)"),
    ("in_set_event_type", "warning", "event_type <> 'Heartbeat'"),
    ("hash_format_valid", "warning", "coalesce(regexp_full_match(process_hash, '[a-fA-F0-9]{64}'), true)"),
    ("freshness_timestamp", "warning", _FRESH),
]
_LONG = "results AS (" + " UNION ALL ".join(
    f"SELECT row_id, {i} AS ord, '{name}' AS rule_name, '{severity}' AS severity, {ok} AS passed FROM contract_records"
    for i, (name, severity, ok) in enumerate(_CHECKS)
) + ")"


@query("dq_contract_rows", f"WITH {_LONG} SELECT row_id, rule_name, severity, passed FROM results")
def dq_contract_rows(spark, sf):
    checked = quality.validate(_records(spark, sf), _contract().rules, _as_of())
    return checked.select("row_id", F.explode("results").alias("r")).select(
        "row_id", "r.rule_name", "r.severity", "r.passed"
    )


@query(
    "dq_custom_regex",
    """SELECT row_id, coalesce(regexp_full_match(process_hash, '[a-fA-F0-9]{64}'), true) AS hash_format_valid FROM contract_records""",
)
def dq_custom_regex(spark, sf):
    return _flags(spark, sf, [r for r in _contract().rules if r.kind == "regex"])


@query(
    "dq_schema_types",
    """SELECT row_id, coalesce(regexp_full_match(event_id, '[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}'), false) AS type_event_id,
      try_cast("timestamp" AS timestamp) IS NOT NULL AS type_timestamp, hostname IS NOT NULL AS type_hostname, event_type IS NOT NULL AS type_event_type,
      coalesce(severity IN ('low', 'medium', 'high', 'critical'), false) AS type_severity, process_name IS NULL OR true AS type_process_name,
      coalesce(length(process_hash) = 64, true) AS type_process_hash, true AS type_user, source_ip <> '999.1.1.1' AS type_source_ip,
      true AS type_destination_ip, coalesce(destination_port <> '80.5', true) AS type_destination_port,
      coalesce(length(file_hash) = 64, true) AS type_file_hash FROM contract_records""",
)
def dq_schema_types(spark, sf):
    rows = _records(spark, sf)
    return _flags(spark, sf, [r for r in _contract().type_rules if r.field in rows.columns])


@query(
    "dq_model_bounds",
    """SELECT row_id, coalesce(isnan(try_cast(confidence AS double)) OR try_cast(confidence AS double) BETWEEN 0 AND 1, false) AS range_confidence,
      risk_score BETWEEN 0 AND 100 AS range_risk_score, priority BETWEEN 1 AND 5 AS range_priority FROM contract_records""",
)
def dq_model_bounds(spark, sf):
    return _flags(spark, sf, list(quality.MODEL_BOUNDS))


@query(
    "dq_batch_summary",
    f"""WITH {_LONG}, per_row AS (SELECT row_id, bool_and(passed) AS ok FROM results GROUP BY row_id),
      t AS (SELECT count(*) AS total_records, count(*) FILTER (ok) AS passed, count(*) FILTER (NOT ok) AS failed FROM per_row)
      SELECT total_records, t.passed, failed, t.passed / total_records AS pass_rate, rule_name, count(*) FILTER (NOT r.passed) AS failures
      FROM t, results r GROUP BY ALL""",
)
def dq_batch_summary(spark, sf):
    summary = quality.batch_summary(_records(spark, sf), _contract().rules, _as_of())
    return summary.select(
        "total_records", "passed", "failed", "pass_rate", F.explode("failures_by_rule").alias("f")
    ).select("total_records", "passed", "failed", "pass_rate", "f.rule_name", "f.failures")


@query(
    "dq_worst_severity",
    f"""WITH {_LONG} SELECT row_id, CASE max(CASE severity WHEN 'warning' THEN 1 WHEN 'error' THEN 2 ELSE 3 END)
      WHEN 1 THEN 'warning' WHEN 2 THEN 'error' ELSE 'critical' END AS worst_severity, count(*) AS failed_count,
      string_agg(rule_name, ',' ORDER BY ord) AS failed_rules FROM results WHERE NOT passed GROUP BY row_id""",
)
def dq_worst_severity(spark, sf):
    checked = quality.validate(_records(spark, sf), _contract().rules, _as_of())
    return quality.worst_severity(checked).select("row_id", "worst_severity", "failed_count", "failed_rules")


@query(
    "dq_sla",
    """WITH l AS (SELECT strftime(event_timestamp, '%Y-%m-%d') AS day, hour(event_timestamp) AS h,
       cast(floor((epoch_ms(received_at) - epoch_ms(event_timestamp)) / 1000) AS bigint) AS s FROM contract_records)
      SELECT day, count(*) AS records, quantile_cont(s, 0.95) AS latency_p95, quantile_cont(s, 0.99) AS latency_p99, max(s) AS latency_max,
       count(DISTINCT h) / 24 AS availability, quantile_cont(s, 0.95) <= 30 AS p95_met, quantile_cont(s, 0.99) <= 60 AS p99_met,
       max(s) <= 300 AS delay_met, count(DISTINCT h) / 24 >= 0.995 AS availability_met FROM l GROUP BY day""",
)
def dq_sla(spark, sf):
    return quality.sla(_records(spark, sf), _contract(), "event_timestamp", "received_at")


_NULLABLE = ("event_id", "timestamp", "hostname", "event_type", "severity", "process_hash", "user", "destination_ip")


@query(
    "dq_null_rate",
    "WITH critical AS (SELECT bool_or(event_id IS NULL OR \"timestamp\" IS NULL) AS any_critical FROM contract_records), rates AS ("
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", avg(CASE WHEN "{c}" IS NULL THEN 1.0 ELSE 0.0 END) AS null_rate FROM contract_records"""
        for c in _NULLABLE
    )
    + ") SELECT \"column\", null_rate, null_rate > 0.05 AS exceeds, NOT any_critical AS proceed FROM rates, critical",
)
def dq_null_rate(spark, sf):
    rows = _records(spark, sf)
    contract = _contract()
    verdict = quality.gate(quality.validate(rows, contract.rules, _as_of()), contract)
    return quality.null_rates(rows, _NULLABLE).withColumn("proceed", verdict.select("proceed").scalar())


@query(
    "violation_counter",
    f"""WITH {_LONG} SELECT 'edr_endpoint_events' AS contract, rule_name AS rule, severity, count(*) AS violations FROM results
      WHERE NOT passed GROUP BY rule_name, severity""",
)
def violation_counter(spark, sf):
    contract = _contract()
    checked = quality.validate(_records(spark, sf), contract.rules, _as_of())
    return quality.violation_counts(checked, contract.name)
