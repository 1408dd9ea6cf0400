"""Detection rules over canonical events."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import picked, rows_of, severity_rank

# --- fixed values of the detection rules ---------------------------------------------
SUSPICIOUS_PROCESS = "(?i)(powershell|cmd|wscript|cscript|mshta|certutil|bitsadmin)"
POWERSHELL_INDICATORS = (
    "-enc", "-encoded", "bypass", "hidden", "downloadstring", "invoke-expression", "iex",
    "frombase64", "webclient",
)
MALICIOUS_TOOLS = (
    "mimikatz", "rubeus", "sharphound", "bloodhound", "cobalt", "beacon", "psexec", "wmic",
)
SUSPICIOUS_PORTS = (4444, 5555, 6666, 8080, 8443, 9001, 31337)
# --------------------------------------------------------------------------------------


def contains_any(text: Column, words: Sequence[str]) -> Column:
    hit = F.lit(False)
    for word in words:
        hit = hit | text.contains(word)
    return hit


def high_severity(severity: Column) -> Column:
    return severity_rank(severity) >= 3


def suspicious_process(process: Column) -> Column:
    return F.coalesce(process.rlike(SUSPICIOUS_PROCESS), F.lit(False))


def stream_detections(events: DataFrame, strict: bool = False) -> DataFrame:
    """Events worth an alert: high severity or a suspicious process.

    ``strict`` keeps only the high-severity ones, which is the set that remains when the
    severity filter is applied first.
    """
    severe = high_severity(F.col("severity"))
    return events.filter(severe if strict else severe | suspicious_process(F.col("process_name")))


@dataclass(frozen=True)
class DetectionRule:
    """A rule of the ordered list; every part is a column expression over the event."""

    name: str
    when: Column
    title: Column
    description: Column
    severity: Column
    confidence: float

    def hit(self) -> Column:
        return F.when(
            self.when,
            F.struct(
                F.lit(self.name).alias("rule"), self.title.alias("title"),
                self.description.alias("description"), self.severity.alias("alert_severity"),
                F.lit(self.confidence).alias("confidence"),
            ),
        )


def default_rules() -> list[DetectionRule]:
    process, command = F.lower("process_name"), F.col("command_line")
    port = F.col("destination_port")
    return [
        DetectionRule(
            "high_severity", high_severity(F.col("severity")),
            F.concat(F.lit("High severity "), F.col("event_type"), F.lit(" event")),
            F.concat(F.lit("Detected from "), F.col("source_system")),
            F.lower("severity"), 0.8,
        ),
        DetectionRule(
            "powershell",
            process.contains("powershell") & contains_any(F.lower(command), POWERSHELL_INDICATORS),
            F.lit("Suspicious PowerShell Activity"),
            F.concat(F.lit("Command: "), F.substring(command, 1, 200)),
            F.lit("high"), 0.85,
        ),
        DetectionRule(
            "malicious_tool", contains_any(process, MALICIOUS_TOOLS),
            F.concat(F.lit("Known Malicious Tool Detected: "), F.col("process_name")),
            F.concat(
                F.lit("Process hash: "), F.coalesce(F.nullif("process_hash", F.lit("")), F.lit("Unknown"))
            ),
            F.lit("critical"), 0.95,
        ),
        DetectionRule(
            "outbound_port", port.isin(*SUSPICIOUS_PORTS),
            F.concat(F.lit("Suspicious Outbound Connection on Port "), port.cast("string")),
            # An absent destination prints as the text None.
            F.concat(
                F.lit("Destination: "), F.coalesce("destination_ip", F.lit("None")), F.lit(":"),
                port.cast("string"),
            ),
            F.lit("medium"), 0.7,
        ),
    ]


def _candidates(events: DataFrame, rules: Sequence[DetectionRule]) -> DataFrame:
    """Events some rule hits. Most hit none, so titles and texts are built after this."""
    hit = F.lit(False)
    for rule in rules:
        hit = hit | F.coalesce(rule.when, F.lit(False))
    return events.filter(hit)


def first_match(
    events: DataFrame, rules: Sequence[DetectionRule] | None = None, keep: Sequence[str] = ()
) -> DataFrame:
    """At most one alert per event: the first rule that hits. ``keep`` carries event columns along."""
    rules = rules or default_rules()
    hit = F.coalesce(*[r.hit() for r in rules])
    return _candidates(events, rules).select("event_id", "source_system", *keep, hit.alias("hit")).select(
        "event_id", "source_system", *keep, "hit.*"
    )


def all_matches(events: DataFrame, rules: Sequence[DetectionRule] | None = None) -> DataFrame:
    """One alert per event and rule that hits."""
    rules = rules or default_rules()
    hits = picked([r.hit() for r in rules])
    return rows_of(_candidates(events, rules), ["event_id", "source_system"], hits)
