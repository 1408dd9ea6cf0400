from .columns import (
    all_of, bucket_of, case_of, evaluated_once, first_non_empty, in_rank_order, ipv4_number,
    is_private_number, is_service_account, lookup, millis_between, non_empty, numeric_severity,
    parse_epoch, parse_iso, parse_time, picked, rows_of, severity_rank, stable_id, title_tokens,
    validation_rank,
)

__all__ = [
    "all_of", "bucket_of", "case_of", "evaluated_once", "first_non_empty", "in_rank_order",
    "ipv4_number", "is_private_number", "is_service_account", "lookup", "millis_between",
    "non_empty", "numeric_severity", "parse_epoch", "parse_iso", "parse_time", "picked",
    "rows_of", "severity_rank", "stable_id", "title_tokens", "validation_rank",
]
