from .feeds import intel_events, latest_indicators
from .products import edr_columns, generic_columns, ndr_columns, normalise, siem_columns
from .registry import SourceRegistry, default_registry
from .topics import parse_flat_events, parse_topics, quarantine

__all__ = [
    "SourceRegistry", "default_registry", "edr_columns", "generic_columns", "intel_events",
    "latest_indicators", "ndr_columns", "normalise", "parse_flat_events", "parse_topics",
    "quarantine", "siem_columns",
]
