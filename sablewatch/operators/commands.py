"""Command-line analysis: pattern scan, verdict, follow-up tasks, decoding, hash indicators."""

from __future__ import annotations

import base64
import binascii
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import case_of, first_non_empty, non_empty, picked, rows_of

# --- fixed values: named command-line patterns and technique mapping ------------------
COMMAND_PATTERNS = {
    "powershell_encoded": r"-[Ee]nc(oded)?[Cc]ommand",
    "powershell_bypass": r"-[Ee]xecution[Pp]olicy\s+[Bb]ypass",
    "powershell_hidden": r"-[Ww]indow[Ss]tyle\s+[Hh]idden",
    "base64_blob": r"[A-Za-z0-9+/]{50,}={0,2}",
    "invoke_expression": r"[Ii]nvoke-[Ee]xpression|[Ii][Ee][Xx]",
    "download_cradle": r"(Net\.WebClient|Invoke-WebRequest|wget|curl).*http",
    "reflection_load": r"\[System\.Reflection\.Assembly\]::Load",
    "wmi_process": r"Win32_Process.*Create",
    "reg_run_key": r"(HKLM|HKCU).*\\Run",
    "scheduled_task": r"schtasks.*\/create",
    "service_create": r"sc\s+(create|config)",
    "mimikatz_pattern": r"(sekurlsa|kerberos|lsadump)::",
    "cobalt_strike": r"(beacon|sleeptime|jitter|spawnto)",
}
TECHNIQUES = {
    "powershell_encoded": ("TA0002", "Execution", "T1059.001", "PowerShell"),
    "download_cradle": ("TA0011", "Command and Control", "T1105", "Ingress Tool Transfer"),
    "reflection_load": ("TA0005", "Defense Evasion", "T1620", "Reflective Code Loading"),
    "reg_run_key": ("TA0003", "Persistence", "T1547.001", "Registry Run Keys"),
    "scheduled_task": ("TA0003", "Persistence", "T1053.005", "Scheduled Task"),
    "mimikatz_pattern": ("TA0006", "Credential Access", "T1003", "OS Credential Dumping"),
}
BASE64_RUN = r"[A-Za-z0-9+/]{40,}={0,2}"
HASH_TYPES = {32: "md5", 40: "sha1", 64: "sha256", 128: "sha512"}
MALICIOUS_ACTIONS = ("Quarantine file", "Block hash", "Hunt for lateral movement")
# --------------------------------------------------------------------------------------


def _pattern_hit(name: str, pattern: str, text: Column) -> Column:
    tactic_id, tactic, technique_id, technique = TECHNIQUES.get(name, (None,) * 4)
    return F.when(
        # (?iu) folds case over Unicode; '.' must stop at \n only, hence the d flag.
        text.rlike(f"(?iud){pattern}"),
        F.struct(
            F.lit(name).alias("pattern"),
            F.lit(name.replace("_", " ").title()).alias("description"),
            F.lit(tactic_id).cast("string").alias("tactic_id"),
            F.lit(tactic).cast("string").alias("tactic_name"),
            F.lit(technique_id).cast("string").alias("technique_id"),
            F.lit(technique).cast("string").alias("technique_name"),
        ),
    )


def scan_patterns(rows: DataFrame, text: str = "command_line") -> DataFrame:
    """Add ``matches``, ``match_count``, ``pattern_confidence`` and ``techniques``.

    A row without text has no analysis: its count is 0 and its confidence NULL.
    """
    hits = picked([_pattern_hit(n, p, F.col(text)) for n, p in COMMAND_PATTERNS.items()])
    count = F.size("matches")
    present = non_empty(F.col(text)).isNotNull()
    return (
        rows.withColumn("matches", hits)
        .withColumn("match_count", count)
        .withColumn(
            "pattern_confidence",
            F.when(present, F.round(F.least(F.lit(0.3) + count * 0.15, F.lit(0.95)), 4)),
        )
        .withColumn(
            "techniques",
            F.filter(
                F.transform("matches", lambda m: m["technique_id"]), lambda t: t.isNotNull()
            ),
        )
    )


def verdicts(scanned: DataFrame) -> DataFrame:
    """Verdict from the pattern scan and the behaviour columns.

    Reads ``match_count``, ``pattern_confidence``, ``risk_level``, ``exfiltration_risk`` and
    ``lateral_risk``; the last three come from whoever analysed the behaviour and may be NULL.
    """
    by_pattern = F.col("match_count") >= 2
    risky = F.coalesce(F.col("risk_level").isin("high", "critical"), F.lit(False))
    spreads = F.coalesce("exfiltration_risk", F.lit(False)) | F.coalesce("lateral_risk", F.lit(False))
    malicious = by_pattern | risky | spreads
    confidence = F.greatest(
        F.when(by_pattern, F.col("pattern_confidence")).otherwise(0.0),
        F.when(risky, 0.8).otherwise(0.0),
        F.when(spreads, 0.75).otherwise(0.0),
    )
    reasons = F.concat_ws(
        "; ",
        F.when(by_pattern, F.concat(F.col("match_count").cast("string"), F.lit(" suspicious patterns detected"))),
        F.when(risky, F.concat(F.lit("High-risk behaviors: "), F.col("risk_level"))),
        F.when(spreads, "Data exfiltration or lateral movement indicators"),
    )
    return (
        scanned.withColumn("is_malicious", malicious)
        .withColumn("confidence", confidence)
        .withColumn("reasoning", F.coalesce(non_empty(reasons), F.lit("No malicious indicators found")))
        .withColumn(
            "needs_sandbox",
            (F.col("is_malicious") & (F.col("confidence") < 0.9))
            | ((F.col("match_count") >= 1) & ~F.col("is_malicious")),
        )
        .withColumn(
            "recommended_actions",
            F.when(F.col("is_malicious"), F.array(*[F.lit(a) for a in MALICIOUS_ACTIONS])).otherwise(
                F.array(F.lit("Continue monitoring"))
            ),
        )
    )


def followups(judged: DataFrame, id_col: str) -> DataFrame:
    """Tasks a verdict asks for: response and / or sandbox."""

    def task(agent: str, kind: str, priority: int) -> Column:
        return F.struct(
            F.lit(agent).alias("agent_type"), F.lit(kind).alias("task_type"), F.lit(priority).alias("priority")
        )

    tasks = picked(
        [
            F.when(
                F.col("is_malicious") & (F.col("confidence") >= 0.8), task("response", "recommend_actions", 1)
            ),
            F.when(F.col("needs_sandbox"), task("malware", "sandbox_analysis", 2)),
        ]
    )
    return rows_of(judged, [id_col], tasks)


def hash_type(value: Column) -> Column:
    return case_of(((F.length(value) == n, name) for n, name in HASH_TYPES.items()), "unknown")


def hash_indicators(
    rows: DataFrame, id_col: str, artifact_hash: str = "file_hash", process_hash: str = "process_hash"
) -> DataFrame:
    """The artifact's hash, else the process hash, as an indicator."""
    value = first_non_empty(F.col(artifact_hash), F.col(process_hash))
    return (
        rows.select(id_col, value.alias("value"))
        .filter(non_empty(F.col("value")).isNotNull())
        .select(
            id_col, F.lit("hash").alias("type"), "value", hash_type(F.col("value")).alias("hash_type"),
            F.lit(0.7).alias("confidence"), F.lit("malware_agent").alias("source"),
        )
    )


def _decode_run(run: str) -> str | None:
    try:
        text = base64.b64decode(run).decode("utf-16-le", errors="ignore")
    except binascii.Error:
        return None
    return text if len(text) > 10 else None


@F.pandas_udf(T.StringType())
def _decoded(commands: pd.Series) -> pd.Series:
    # Neither JVM decoder can skip broken UTF-16 units, hence Arrow and Python here.
    def one(command: str) -> str | None:
        parts = [d for d in map(_decode_run, re.findall(BASE64_RUN, command)) if d]
        return "\n---\n".join(parts) or None

    return commands.map(one)


def decode_base64(rows: DataFrame, text: str = "command_line") -> DataFrame:
    """Rows whose text holds a base64 run that decodes, with ``decoded_content``.

    The regular expression filters in the JVM first, so Python sees only candidates.
    """
    return (
        rows.filter(F.col(text).rlike(BASE64_RUN))
        # Not deterministic to the optimizer: the filter below must not run it a second time.
        .withColumn("decoded_content", _decoded.asNondeterministic()(F.col(text)))
        .filter(F.col("decoded_content").isNotNull())
    )
