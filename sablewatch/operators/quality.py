"""Data contracts: rule specifications become boolean columns.

All rules of a contract are evaluated in one projection; a summary is one aggregate.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

import yaml
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import all_of, evaluated_once, in_rank_order, ipv4_number, parse_iso, validation_rank

# --- fixed values: formats of ids and hashes -------------------------------------------
UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
SHA256 = r"^[a-fA-F0-9]{64}$"
# --------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Rule:
    kind: str
    field: str
    severity: str = "error"
    name: str = ""
    options: Mapping[str, Any] = field(default_factory=dict)

    @property
    def label(self) -> str:
        return self.name or f"{self.kind}_{self.field}"


Check = Callable[[Column, Rule, Column], Column]


def _not_null(value: Column, rule: Rule, as_of: Column) -> Column:
    return value.isNotNull()


def _in_set(value: Column, rule: Rule, as_of: Column) -> Column:
    return value.isin(*rule.options["values"])


def _range(value: Column, rule: Rule, as_of: Column) -> Column:
    number = value.try_cast("double")
    low, high = rule.options.get("min"), rule.options.get("max")
    inside = F.lit(True)
    if low is not None:
        inside = inside & (number >= F.lit(float(low)))
    if high is not None:
        inside = inside & (number <= F.lit(float(high)))
    # Not-a-number compares false with both bounds, so it is never outside.
    return number.isNotNull() & (F.isnan(number) | inside)


def _freshness(value: Column, rule: Rule, as_of: Column) -> Column:
    seen = parse_iso(value.cast("string"))
    age = (F.unix_micros(as_of) - F.unix_micros(seen)) / 1_000_000
    return age <= F.lit(float(rule.options["max_age_seconds"]))


def _regex(value: Column, rule: Rule, as_of: Column) -> Column:
    match = value.rlike(rule.options["pattern"])
    return value.isNull() | match if rule.options.get("apply_when_present", True) else match


def _type(value: Column, rule: Rule, as_of: Column) -> Column:
    declared = rule.options["type"]
    text = value.cast("string")
    ok = {
        "string": lambda: text.isNotNull(),
        "uuid": lambda: text.rlike(UUID),
        "sha256": lambda: text.rlike(SHA256),
        "iso8601": lambda: parse_iso(text).isNotNull(),
        "ipv4": lambda: ipv4_number(text).isNotNull(),
        "integer": lambda: text.try_cast("long").isNotNull(),
        "enum": lambda: text.isin(*rule.options.get("values", ())),
    }[declared]()
    return ok if rule.options.get("required") else value.isNull() | ok


# Rule kinds by name; a user adds kinds here.
RULE_KINDS: dict[str, Check] = {
    "not_null": _not_null, "in_set": _in_set, "range": _range, "freshness": _freshness,
    "regex": _regex, "type": _type,
}


def register_rule(kind: str, check: Check) -> None:
    RULE_KINDS[kind] = check


@dataclass(frozen=True)
class Contract:
    name: str
    version: str = "1.0.0"
    producer: str = ""
    consumers: tuple[str, ...] = ()
    rules: tuple[Rule, ...] = ()
    type_rules: tuple[Rule, ...] = ()
    availability: float = 0.995
    latency_p95_seconds: int = 30
    latency_p99_seconds: int = 60
    max_batch_delay_seconds: int = 300
    alert_channel: str | None = None
    escalate_after_minutes: int = 15
    halt_pipeline: bool = False


def _percent(value: Any) -> float:
    if isinstance(value, str):
        return float(value.rstrip("%")) / 100 if value.endswith("%") else float(value)
    return float(value)


def contract_from_mapping(data: Mapping[str, Any]) -> Contract:
    body = data.get("contract", data)
    declared = body.get("schema", {})
    quality = body.get("quality_rules", {})
    sla = body.get("sla", {})
    violation = body.get("on_violation", {})

    def rule(spec: Mapping[str, Any], **extra: Any) -> Rule:
        plain = {k: v for k, v in spec.items() if k not in ("field", "rule", "severity", "name", "description")}
        return Rule(spec["rule"], spec["field"], spec.get("severity", "error"), spec.get("name", ""), {**plain, **extra})

    rules = [rule(s) for part in ("completeness", "validity", "custom_rules") for s in quality.get(part, [])]
    fresh = quality.get("freshness")
    if fresh:
        rules.append(
            Rule(
                "freshness", fresh.get("field", "timestamp"), fresh.get("severity", "warning"),
                options={"max_age_seconds": fresh.get("max_delay_seconds", 300)},
            )
        )
    types = [
        Rule("type", name, "error", options={**spec, "required": required})
        for part, required in (("required_fields", True), ("optional_fields", False))
        for name, spec in declared.get(part, {}).items()
    ]
    channel = violation.get("alert_channel") or next(
        (a.get("destination") for a in violation.get("actions", []) if a.get("type") == "alert"), None
    )
    return Contract(
        name=body["name"], version=str(body.get("version", "1.0.0")), producer=body["producer"],
        consumers=tuple(body.get("consumers", ())), rules=tuple(rules), type_rules=tuple(types),
        availability=_percent(sla.get("availability", 0.995)),
        latency_p95_seconds=sla.get("latency_p95_seconds", 30),
        latency_p99_seconds=sla.get("latency_p99_seconds", 60),
        max_batch_delay_seconds=sla.get("max_batch_delay_seconds", 300),
        alert_channel=channel,
        escalate_after_minutes=violation.get(
            "escalate_after_minutes", violation.get("escalation", {}).get("after_minutes", 15)
        ),
        halt_pipeline=violation.get("halt_pipeline", False),
    )


def load_contracts(directory: str | Path) -> tuple[dict[str, Contract], dict[str, str]]:
    """Contracts by name, and the reason for every file that does not load."""
    loaded, failed = {}, {}
    for path in sorted(Path(directory).glob("*.yaml")):
        try:
            contract = contract_from_mapping(yaml.safe_load(path.read_text()))
            loaded[contract.name] = contract
        except Exception as err:  # a broken file must not hide the others
            failed[path.name] = f"{type(err).__name__}: {err}"
    return loaded, failed


# --- evaluation -------------------------------------------------------------------------


def passed(rows: DataFrame, rule: Rule, as_of: Column) -> Column:
    """Whether the rule holds; never NULL. A missing column counts as NULL."""
    value = F.col(rule.field) if rule.field in rows.columns else F.lit(None).cast("string")
    return F.coalesce(RULE_KINDS[rule.kind](value, rule, as_of), F.lit(False))


def result_columns(rows: DataFrame, rules, as_of: Column) -> dict[str, Column]:
    """``rule id -> passed``; equal labels get their position appended to the id."""
    labels = [r.label for r in rules]
    ids = [f"{x}#{i}" if labels.count(x) > 1 else x for i, x in enumerate(labels)]
    return {rule_id: passed(rows, rule, as_of) for rule_id, rule in zip(ids, rules)}


def validate(rows: DataFrame, rules, as_of: Column) -> DataFrame:
    """Add ``results``: one struct per rule, all evaluated in one projection."""
    results = [
        F.struct(
            F.lit(rule_id).alias("rule_name"), ok.alias("passed"), F.lit(rule.severity).alias("severity"),
            F.when(ok, f"Field '{rule.field}' meets {rule.kind}")
            .otherwise(f"Field '{rule.field}' violates {rule.kind}").alias("message"),
        )
        for (rule_id, ok), rule in zip(result_columns(rows, rules, as_of).items(), rules)
    ]
    return evaluated_once(rows, F.array(*results), "results")


def failures(validated: DataFrame) -> DataFrame:
    return validated.withColumn("failed", F.filter("results", lambda r: ~r["passed"]))


def worst_severity(validated: DataFrame) -> DataFrame:
    """Alert per failing row: highest failed severity, number and names of failed rules."""
    ranks = F.transform("failed", lambda r: validation_rank(r["severity"]))
    return (
        failures(validated)
        .filter(F.size("failed") > 0)
        .withColumn("worst_severity", in_rank_order(F.array_max(ranks)))
        .withColumn("failed_count", F.size("failed"))
        .withColumn("failed_rules", F.transform("failed", lambda r: r["rule_name"]))
    )


def batch_summary(rows: DataFrame, rules, as_of: Column) -> DataFrame:
    """Totals and failures per rule in a single global aggregate (map-side combined)."""
    checks = result_columns(rows, rules, as_of)
    flags = rows.select(*[c.alias(f"r{i}") for i, c in enumerate(checks.values())])
    every = all_of(F.col(f"r{i}") for i in range(len(checks)))
    per_rule = F.array(
        *[
            F.struct(F.lit(name).alias("rule_name"), F.count_if(~F.col(f"r{i}")).alias("failures"))
            for i, name in enumerate(checks)
        ]
    )
    return (
        flags.agg(
            F.count(F.lit(1)).alias("total_records"), F.count_if(every).alias("passed"),
            per_rule.alias("failures_by_rule"),
        )
        .withColumn("failed", F.col("total_records") - F.col("passed"))
        .withColumn("pass_rate", F.coalesce(F.try_divide("passed", "total_records"), F.lit(0.0)))
    )


def violation_counts(validated: DataFrame, contract: str) -> DataFrame:
    """Counter per (contract, rule, severity)."""
    return (
        failures(validated).select(F.explode("failed").alias("f"))
        .groupBy(F.lit(contract).alias("contract"), F.col("f.rule_name").alias("rule"), F.col("f.severity").alias("severity"))
        .agg(F.count(F.lit(1)).alias("violations"))
    )


def null_rates(rows: DataFrame, columns, limit: float = 0.05) -> DataFrame:
    """NULL share per column against the limit, one scan for all columns."""
    rates = F.array(
        *[
            F.struct(F.lit(c).alias("column"), F.avg(F.col(c).isNull().cast("double")).alias("null_rate"))
            for c in columns
        ]
    )
    return (
        rows.agg(rates.alias("r")).select(F.explode("r").alias("r")).select("r.*")
        .withColumn("exceeds", F.col("null_rate") > limit)
    )


def gate(validated: DataFrame, contract: Contract, halt_on_critical: bool = True) -> DataFrame:
    """One row: may the batch go on? It halts on a critical failure or by contract."""
    critical = F.exists("failed", lambda r: r["severity"] == "critical")
    halted = F.lit(halt_on_critical) & (F.col("critical_rows") > 0)
    if contract.halt_pipeline:
        halted = halted | (F.col("failed_rows") > 0)
    return (
        failures(validated)
        .agg(F.count_if(critical).alias("critical_rows"), F.count_if(F.size("failed") > 0).alias("failed_rows"))
        .withColumn("proceed", ~halted)
    )


def sla(rows: DataFrame, contract: Contract, event_time: str, received: str) -> DataFrame:
    """Per day: latency percentiles and hourly availability against the contract.

    Latencies are counted per distinct second first, so the exact percentile keeps one
    counter per second value instead of every row of the day.
    """
    day = F.date_format(event_time, "yyyy-MM-dd").alias("day")
    seconds = F.floor((F.unix_millis(received) - F.unix_millis(event_time)) / 1000).cast("long").alias("latency_s")
    hour = F.hour(event_time).alias("hour")
    counted = rows.select(day, hour, seconds).groupBy("day", "hour", "latency_s").agg(F.count(F.lit(1)).alias("n"))
    return (
        counted.groupBy("day")
        .agg(
            F.sum("n").alias("records"),
            F.percentile("latency_s", F.lit(0.95), F.col("n")).alias("latency_p95"),
            F.percentile("latency_s", F.lit(0.99), F.col("n")).alias("latency_p99"),
            F.max("latency_s").alias("latency_max"),
            (F.count_distinct("hour") / 24).alias("availability"),
        )
        .withColumn("p95_met", F.col("latency_p95") <= contract.latency_p95_seconds)
        .withColumn("p99_met", F.col("latency_p99") <= contract.latency_p99_seconds)
        .withColumn("delay_met", F.col("latency_max") <= contract.max_batch_delay_seconds)
        .withColumn("availability_met", F.col("availability") >= contract.availability)
    )


# --- fixed values: bounds of the canonical model ------------------------------------------
MODEL_BOUNDS = (
    Rule("range", "confidence", options={"min": 0, "max": 1}),
    Rule("range", "risk_score", options={"min": 0, "max": 100}),
    Rule("range", "priority", options={"min": 1, "max": 5}),
)
