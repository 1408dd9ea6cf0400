"""Per-product mapping of raw JSON fields to the canonical event.

Each product is a function from its parsed struct to ``{canonical column: expression}``.
:func:`normalise` applies all of them in one projection, choosing by topic.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import case_of, first_non_empty, lookup, non_empty, parse_epoch, parse_iso, parse_time, stable_id
from ..schemas import CANONICAL_EVENT, EVENT_TYPES, SEVERITIES
from .topics import CORRUPT, not_one_object, parse_topics

# --- fixed values: topics, vocabularies and raw field names of the products ---------
EDR_TOPIC = "soc.events.edr.crowdstrike"
SIEM_TOPIC = "soc.events.siem.splunk"
NDR_TOPIC = "soc.events.network.zeek"
GENERIC_TOPIC = "soc.events.raw"

EDR_EVENT_TYPES = {
    "ProcessRollup2": "process",
    "SyntheticProcessRollup2": "process",
    "ProcessBlocked": "process",
    "NetworkConnectIP4": "network",
    "NetworkConnectIP6": "network",
    "DnsRequest": "dns",
    "FileWritten": "file",
    "NewExecutableWritten": "file",
    "PeFileWritten": "file",
    "AsepValueUpdate": "registry",
    "UserLogon": "authentication",
    "UserLogoff": "authentication",
}
EDR_SEVERITIES = {
    "informational": "low", "low": "low", "medium": "medium", "high": "high", "critical": "critical",
}
SIEM_EVENT_TYPES = {
    "WinEventLog:Security": "authentication",
    "WinEventLog:System": "process",
    "linux:audit": "authentication",
    "pan:traffic": "network",
    "cisco:asa": "network",
    "aws:cloudtrail": "authorization",
}
SIEM_SEVERITIES = {"low": "low", "medium": "medium", "high": "high", "critical": "critical"}
NDR_EVENT_TYPES = {
    "conn": "network", "dns": "dns", "http": "http", "ssl": "network", "files": "file",
    "notice": "custom",
}
NDR_FAILED_STATES = ("S0", "REJ", "RSTO", "RSTOS0")

EDR_FIELDS = [
    "event_simpleName", "Severity", "timestamp", "ProcessStartTime", "FileName", "ImageFileName",
    "FilePath", "SHA256HashData", "CommandLine", "ParentBaseFileName", "ParentProcessSHA256",
    "LocalAddressIP4", "RemoteAddressIP4", "LocalPort", "RemotePort", "DomainName",
    "TargetFileName", "TargetFilePath", "TargetFileSHA256",
]
SIEM_FIELDS = [
    "sourcetype", "urgency", "_time", "timestamp", "src_ip", "src", "dest_ip", "dest",
    "src_port", "dest_port", "protocol", "transport",
]
NDR_FIELDS = [
    "_path", "ts", "notice", "conn_state", "id.orig_h", "id.resp_h", "id.orig_p", "id.resp_p",
    "proto", "query", "uri",
]
GENERIC_FIELDS = ["timestamp", "event_type", "severity", "category"]
# ------------------------------------------------------------------------------------

Raw = Callable[[str], Column]


def _port(raw: Column) -> Column:
    """Whole numbers only; 80.0 is one."""
    number = raw.try_cast("double")
    return F.coalesce(raw.try_cast("int"), F.when(number == F.floor(number), number.try_cast("int")))


def _bad_port(*raws: Column) -> Column:
    return F.coalesce(*[F.when(r.isNotNull() & _port(r).isNull(), F.lit("port is not a number")) for r in raws])


def edr_columns(raw: Raw, ingested: Column) -> dict[str, Column]:
    when_seen = non_empty(F.coalesce(non_empty(raw("timestamp")), raw("ProcessStartTime")))
    return {
        "timestamp": F.coalesce(parse_iso(when_seen), ingested),
        "event_type": lookup(raw("event_simpleName"), EDR_EVENT_TYPES, "custom"),
        "severity": lookup(F.lower(raw("Severity")), EDR_SEVERITIES, "medium"),
        "source_system": F.lit("crowdstrike"),
        "source_category": F.lit("edr"),
        "process_name": first_non_empty(raw("FileName"), raw("ImageFileName")),
        "process_path": raw("FilePath"),
        "process_hash": raw("SHA256HashData"),
        "process_command_line": raw("CommandLine"),
        "parent_process_name": raw("ParentBaseFileName"),
        "parent_process_hash": raw("ParentProcessSHA256"),
        "source_ip": raw("LocalAddressIP4"),
        "destination_ip": raw("RemoteAddressIP4"),
        "source_port": _port(raw("LocalPort")),
        "destination_port": _port(raw("RemotePort")),
        "domain": raw("DomainName"),
        "file_name": raw("TargetFileName"),
        "file_path": raw("TargetFilePath"),
        "file_hash": raw("TargetFileSHA256"),
        "reject_reason": _bad_port(raw("LocalPort"), raw("RemotePort")),
    }


def siem_columns(raw: Raw, ingested: Column) -> dict[str, Column]:
    return {
        "timestamp": F.coalesce(parse_time(first_non_empty(raw("_time"), raw("timestamp"))), ingested),
        "event_type": lookup(raw("sourcetype"), SIEM_EVENT_TYPES, "custom"),
        "severity": lookup(F.lower(raw("urgency")), SIEM_SEVERITIES, "medium"),
        "source_system": F.lit("splunk"),
        "source_category": F.lit("siem"),
        "source_ip": first_non_empty(raw("src_ip"), raw("src")),
        "destination_ip": first_non_empty(raw("dest_ip"), raw("dest")),
        "source_port": _port(raw("src_port")),
        "destination_port": _port(raw("dest_port")),
        "protocol": first_non_empty(raw("protocol"), raw("transport")),
        "reject_reason": _bad_port(raw("src_port"), raw("dest_port")),
    }


def ndr_columns(raw: Raw, ingested: Column) -> dict[str, Column]:
    noticed = ~F.coalesce(raw("notice"), F.lit("")).isin("", "false", "0", "0.0", "[]", "{}")
    failed = F.coalesce(raw("conn_state").isin(*NDR_FAILED_STATES), F.lit(False))
    return {
        "timestamp": F.coalesce(parse_epoch(raw("ts")), ingested),
        "event_type": lookup(F.coalesce(raw("_path"), F.lit("conn")), NDR_EVENT_TYPES, "network"),
        "severity": F.when(noticed | failed, "medium").otherwise("low"),
        "source_system": F.lit("zeek"),
        "source_category": F.lit("network"),
        "source_ip": raw("id.orig_h"),
        "destination_ip": raw("id.resp_h"),
        "source_port": _port(raw("id.orig_p")),
        "destination_port": _port(raw("id.resp_p")),
        "protocol": raw("proto"),
        "domain": raw("query"),
        "url": raw("uri"),
        "reject_reason": _bad_port(raw("id.orig_p"), raw("id.resp_p")),
    }


def generic_columns(source_name: str) -> Callable[[Raw, Column], dict[str, Column]]:
    """Mapper for a product without its own vocabulary; values outside an enum reject."""

    def columns(raw: Raw, ingested: Column) -> dict[str, Column]:
        event_type = F.coalesce(raw("event_type"), F.lit("custom"))
        severity = F.coalesce(raw("severity"), F.lit("medium"))
        seen = parse_iso(raw("timestamp"))
        return {
            "timestamp": F.when(raw("timestamp").isNull(), ingested).otherwise(seen),
            "event_type": event_type,
            "severity": severity,
            "source_system": F.lit(source_name),
            "source_category": F.coalesce(raw("category"), F.lit("unknown")),
            "reject_reason": F.when(~event_type.isin(*EVENT_TYPES), "event_type outside the enumeration")
            .when(~severity.isin(*SEVERITIES), "severity outside the enumeration")
            .when(raw("timestamp").isNotNull() & seen.isNull(), "timestamp does not parse"),
        }

    return columns


PRODUCTS: dict[str, tuple[list[str], Callable[[Raw, Column], dict[str, Column]]]] = {
    EDR_TOPIC: (EDR_FIELDS, edr_columns),
    SIEM_TOPIC: (SIEM_FIELDS, siem_columns),
    NDR_TOPIC: (NDR_FIELDS, ndr_columns),
    GENERIC_TOPIC: (GENERIC_FIELDS, generic_columns("generic")),
}


def normalise(messages: DataFrame, products: Mapping[str, tuple] = PRODUCTS) -> DataFrame:
    """Canonical events plus ``topic``, ``partition``, ``offset`` and ``reject_reason``.

    One scan and two projections whatever the number of products; no shuffle. The id is
    derived from the message position, so a replay produces the same rows.
    """
    parsed = parse_topics(messages, {t: fields for t, (fields, _) in products.items()})
    ingested = F.col("timestamp")
    branches = {}
    for topic, (_, mapper) in products.items():
        struct = F.col("parsed").getField(topic)
        branches[topic] = (struct, mapper(lambda f, s=struct: s.getField(f), ingested))

    def by_topic(name: str, kind) -> Column:
        return case_of(
            (F.col("topic") == topic, columns[name].cast(kind))
            for topic, (_, columns) in branches.items()
            if name in columns
        ).cast(kind)

    corrupt = F.coalesce(*[struct.getField(CORRUPT) for struct, _ in branches.values()])
    reject = (
        F.when(F.col("value").isNull(), F.lit("empty message"))
        .when(corrupt.isNotNull(), F.lit("not JSON"))
        .when(~F.col("topic").isin(*products), F.lit("unknown topic"))
        .when(not_one_object(F.col("value").cast("string")), F.lit("not JSON"))
        .otherwise(by_topic("reject_reason", "string"))
    )
    fixed = {
        "event_id": stable_id(F.col("topic"), F.col("partition"), F.col("offset")),
        "ingestion_time": ingested,
        "confidence": F.lit(0.5),
        "raw_data": F.col("value").cast("string"),
        "tags": F.array().cast("array<string>"),
    }
    out = [
        fixed.get(field.name, None) if field.name in fixed else by_topic(field.name, field.dataType)
        for field in CANONICAL_EVENT.fields
    ]
    return parsed.select(
        *[col.alias(field.name) for col, field in zip(out, CANONICAL_EVENT.fields)],
        "topic", "partition", "offset", reject.alias("reject_reason"),
    )
