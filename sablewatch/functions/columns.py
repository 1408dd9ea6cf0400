"""Column expressions shared by the operators. Nothing here leaves the JVM."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import VALIDATION_SEVERITIES


def non_empty(col: Column) -> Column:
    """NULL for the empty string, the value otherwise."""
    return F.nullif(col, F.lit(""))


def first_non_empty(*cols: Column) -> Column:
    """First value that is neither NULL nor empty; the last one counts as it is."""
    return F.coalesce(*[non_empty(c) for c in cols[:-1]], cols[-1])


def all_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def case_of(branches: Iterable[tuple[Column, object]], default: object | None = None) -> Column:
    """CASE over (condition, value) pairs."""
    chain = F
    for condition, value in branches:
        chain = chain.when(condition, value)
    return chain.otherwise(F.lit(default)) if chain is not F else F.lit(default)


def lookup(col: Column, table: Mapping[str, object], default: object | None = None) -> Column:
    """Small constant table as one CASE expression, so it stays in generated code."""
    return case_of(((col == F.lit(key), F.lit(value)) for key, value in table.items()), default)


def picked(candidates: Iterable[Column]) -> Column:
    """Array of the non-NULL candidates in the given order."""
    return F.array_compact(F.array(*candidates))


# --- identity -------------------------------------------------------------------


def stable_id(*parts: Column) -> Column:
    """Deterministic id: the same input yields the same id on every replay."""
    return F.sha2(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def bucket_of(ts: Column, seconds: int) -> Column:
    """Number of the time slice that holds ``ts``."""
    return F.floor(F.unix_micros(ts) / F.lit(seconds * 1_000_000)).cast("long")


# --- severity -------------------------------------------------------------------


def severity_rank(col: Column) -> Column:
    """critical 4, high 3, medium 2; anything else and NULL 1. Case does not matter."""
    s = F.lower(col)
    return (
        F.when(s == "critical", F.lit(4)).when(s == "high", F.lit(3))
        .when(s == "medium", F.lit(2)).otherwise(F.lit(1))
    )


def numeric_severity(col: Column) -> Column:
    """Vendor 1-10 scale to the enumeration; NULL stays NULL."""
    return (
        F.when(col <= 3, "low").when(col <= 5, "medium").when(col <= 7, "high")
        .when(col.isNotNull(), "critical")
    )


def validation_rank(col: Column) -> Column:
    return lookup(col, {name: rank for rank, name in enumerate(VALIDATION_SEVERITIES)})


def in_rank_order(rank: Column) -> Column:
    """Inverse of :func:`validation_rank`."""
    return F.when(
        rank.isNotNull(), F.element_at(F.array(*[F.lit(s) for s in VALIDATION_SEVERITIES]), rank.cast("int") + 1)
    )


# --- time -----------------------------------------------------------------------


def parse_iso(col: Column) -> Column:
    """ISO-8601 text to timestamp; NULL where it does not parse (plain casts raise)."""
    text = F.trim(col)
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(text))


def parse_epoch(col: Column) -> Column:
    """Epoch seconds, with fraction, given as text or number."""
    seconds = col.try_cast("double")
    # 253402300800 is year 10000: larger values are not seconds.
    return F.when(
        (F.abs(seconds) < 253402300800.0) & ~F.isnan(seconds),
        F.timestamp_micros(F.round(seconds * 1_000_000).cast("long")),
    )


def parse_time(col: Column) -> Column:
    """Epoch seconds or ISO text."""
    return F.coalesce(parse_epoch(col), parse_iso(col))


def millis_between(later: Column, earlier: Column) -> Column:
    return F.unix_millis(later) - F.unix_millis(earlier)


# --- addresses and names --------------------------------------------------------

_OCTET = r"(25[0-5]|2[0-4]\d|[01]?\d?\d)"
IPV4 = rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$"


def ipv4_number(ip: Column) -> Column:
    """Dotted quad as a number; NULL for anything else, IPv6 included."""
    return F.when(
        ip.rlike(IPV4),
        F.aggregate(F.split(ip, r"\."), F.lit(0).cast("long"), lambda n, part: n * 256 + part.cast("long")),
    )


def is_private_number(n: Column) -> Column:
    """RFC 1918 ranges; false for NULL."""
    return F.coalesce(
        n.between(167772160, 184549375)        # 10.0.0.0/8
        | n.between(2886729728, 2887778303)    # 172.16.0.0/12
        | n.between(3232235520, 3232301055),   # 192.168.0.0/16
        F.lit(False),
    )


def evaluated_once(df: DataFrame, expression: Column, name: str) -> DataFrame:
    """Add a column that later filters and projections read and never re-evaluate.

    A filter on a derived column is pushed below the projection that derives it, with its
    definition substituted: a JSON document would be parsed once per use. Rows of a
    generator are a boundary the optimizer does not push through.
    """
    return df.select("*", F.explode(F.array(expression)).alias(name))


def rows_of(df: DataFrame, keep: list[str], array: Column, name: str = "item") -> DataFrame:
    """One row per element of a computed array, spread into columns.

    A plain explode makes the optimizer add a "not empty" filter below, which evaluates
    the array a second time; the outer form with a test on its output does not.
    """
    exploded = df.select(*keep, F.explode_outer(array).alias(name))
    return exploded.filter(F.col(name).isNotNull()).select(*keep, f"{name}.*")


def is_service_account(username: Column) -> Column:
    return username.startswith("svc_") | username.startswith("service")


def title_tokens(title: Column) -> Column:
    """Sorted set of lower-case, white-space separated tokens."""
    return F.array_sort(
        F.array_distinct(F.filter(F.split(F.lower(F.coalesce(title, F.lit(""))), r"\s+"), lambda t: t != ""))
    )
