"""Enrichment joins."""

from pyspark.sql import functions as F

from ..fixtures.views import view
from ..operators import enrich
from .registry import query

_ASSET_KEY = "coalesce(lower(nullif(hostname, '')), nullif(source_ip, ''))"
_ASSET_JOIN = "FROM (SELECT *, coalesce(lower(nullif(hostname, '')), nullif(source_ip, '')) AS lk FROM sec_events) e LEFT JOIN assets a ON a.asset_key = e.lk"


@query(
    "enrich_asset",
    f"""SELECT e.event_id, criticality AS asset_criticality, owner AS asset_owner, department AS asset_department, location AS asset_location,
      asset_key IS NOT NULL AS asset_found {_ASSET_JOIN}""",
)
def enrich_asset(spark, sf):
    out = enrich.with_asset(view(spark, sf, "sec_events"), view(spark, sf, "assets"))
    return out.select("event_id", "asset_criticality", "asset_owner", "asset_department", "asset_location", "asset_found")


_SVC = "(starts_with(e.user_name, 'svc_') OR starts_with(e.user_name, 'service'))"


@query(
    "enrich_user",
    f"""SELECT e.event_id, coalesce(u.department, CASE WHEN {_SVC} THEN 'IT' WHEN e.user_name IS NOT NULL THEN 'Unknown' END) AS user_department,
      coalesce(cast(coalesce(u.privileged, CASE WHEN e.user_name IS NOT NULL THEN {_SVC} END) AS varchar), 'none') AS user_privileged,
      coalesce(u.risk_score, CASE WHEN {_SVC} THEN 30.0 WHEN e.user_name IS NOT NULL THEN 10.0 END) AS user_risk_score,
      coalesce(cast(coalesce(u.mfa_enabled, CASE WHEN e.user_name IS NOT NULL THEN NOT {_SVC} END) AS varchar), 'none') AS user_mfa_enabled,
      CASE WHEN {_SVC} THEN 'service_account' WHEN e.user_name IS NOT NULL THEN 'employee' END AS user_type, u.username IS NOT NULL AS user_known
      FROM sec_events e LEFT JOIN users u ON u.username = e.user_name""",
)
def enrich_user(spark, sf):
    out = enrich.with_user(view(spark, sf, "sec_events"), view(spark, sf, "users"))
    text = [F.coalesce(F.col(c).cast("string"), F.lit("none")).alias(c) for c in ("user_privileged", "user_mfa_enabled")]
    return out.select("event_id", "user_department", *text, "user_risk_score", "user_type", "user_known")


def _feed_hits(spark, sf, kind, names):
    feed = enrich.built_in_feed(spark)
    out = enrich.with_feed(view(spark, sf, "sec_events"), feed, {kind: names})
    return out, [F.col(f"{n}_hit") for n in names]


def _bad_ip(col):
    return f"coalesce(starts_with({col}, '185.220.') OR starts_with({col}, '45.155.') OR starts_with({col}, '91.219.'), false)"


@query(
    "enrich_ioc_ip",
    f"""SELECT event_id, CASE WHEN {_bad_ip('source_ip')} THEN 0.85 END AS source_confidence, CASE WHEN {_bad_ip('destination_ip')} THEN 0.85 END AS destination_confidence,
      cast(CASE WHEN {_bad_ip('source_ip')} THEN -80 ELSE 0 END AS bigint) AS source_reputation,
      cast(CASE WHEN {_bad_ip('destination_ip')} THEN -80 ELSE 0 END AS bigint) AS destination_reputation,
      CASE WHEN {_bad_ip('source_ip')} OR {_bad_ip('destination_ip')} THEN 'Unknown APT' END AS actor FROM sec_events""".replace("0.85 END", "cast(0.85 AS double) END"),
)
def enrich_ioc_ip(spark, sf):
    out, (src, dst) = _feed_hits(spark, sf, "ip", ["source_ip", "destination_ip"])
    return out.select(
        "event_id", src["confidence"].alias("source_confidence"), dst["confidence"].alias("destination_confidence"),
        F.coalesce(src["reputation"], F.lit(0)).alias("source_reputation"),
        F.coalesce(dst["reputation"], F.lit(0)).alias("destination_reputation"),
        F.coalesce(src["actor"], dst["actor"]).alias("actor"),
    )


_BAD_DOMAIN = "coalesce(regexp_matches(lower(domain), '\\.(xyz|top|tk|ml)$|malware|phish|hack|crack'), false)"


@query(
    "enrich_ioc_domain",
    f"""SELECT event_id, domain, CASE WHEN {_BAD_DOMAIN} THEN cast(0.75 AS double) END AS confidence,
      cast(CASE WHEN {_BAD_DOMAIN} THEN -60 WHEN domain IS NOT NULL THEN 0 END AS bigint) AS reputation FROM sec_events""",
)
def enrich_ioc_domain(spark, sf):
    out, (hit,) = _feed_hits(spark, sf, "domain", ["domain"])
    ioc = enrich.domain_ioc(F.col("domain"))
    bad = hit.isNotNull() | ioc.isNotNull()
    return out.select(
        "event_id", "domain", F.coalesce(hit["confidence"], ioc["confidence"]).alias("confidence"),
        F.when(bad, enrich.DOMAIN_REPUTATION).when(F.col("domain").isNotNull(), 0).alias("reputation"),
    )


def _bad_hash(col):
    return f"coalesce(regexp_matches(lower({col}), '^(a1b2c3|deadbeef|cafebabe)'), false)"


@query(
    "enrich_ioc_hash",
    f"""SELECT event_id, CASE WHEN {_bad_hash('process_hash')} THEN cast(0.95 AS double) END AS process_confidence,
      CASE WHEN {_bad_hash('file_hash')} THEN cast(0.95 AS double) END AS file_confidence,
      CASE WHEN {_bad_hash('process_hash')} OR {_bad_hash('file_hash')} THEN 'T1059' END AS technique FROM sec_events""",
)
def enrich_ioc_hash(spark, sf):
    out, (process, file) = _feed_hits(spark, sf, "hash", ["process_hash", "file_hash"])
    return out.select(
        "event_id", process["confidence"].alias("process_confidence"), file["confidence"].alias("file_confidence"),
        F.coalesce(process["technique"], file["technique"]).alias("technique"),
    )


def _public(col):
    return f"NOT ({col} LIKE '10.%' OR {col} LIKE '192.168.%' OR regexp_matches({col}, '^172\\.(1[6-9]|2[0-9]|3[01])\\.'))"


def _number(col):
    parts = [f"cast(split_part({col}, '.', {i}) AS bigint)" for i in range(1, 5)]
    return f"((({parts[0]} * 256 + {parts[1]}) * 256 + {parts[2]}) * 256 + {parts[3]})"


_GEO_JOIN = f"""LEFT JOIN geo_ranges s ON {_public('e.source_ip')} AND {_number('e.source_ip')} BETWEEN s.start_ip AND s.end_ip
 LEFT JOIN geo_ranges d ON {_public('e.destination_ip')} AND {_number('e.destination_ip')} BETWEEN d.start_ip AND d.end_ip"""


@query(
    "enrich_geo",
    f"""SELECT e.event_id, s.country AS source_country, s.asn AS source_asn, d.country AS destination_country, d.asn AS destination_asn
      FROM sec_events e {_GEO_JOIN}""",
)
def enrich_geo(spark, sf):
    out = enrich.with_geo_by_block(view(spark, sf, "sec_events"), view(spark, sf, "geo_ranges"))
    return out.select(
        "event_id", F.col("source_ip_geo.country").alias("source_country"), F.col("source_ip_geo.asn").alias("source_asn"),
        F.col("destination_ip_geo.country").alias("destination_country"), F.col("destination_ip_geo.asn").alias("destination_asn"),
    )


_NARROWEST = " UNION ALL ".join(
    f"""SELECT e.event_id, '{side}' AS side, g.country, g.asn, g.end_ip - g.start_ip AS width, g.start_ip
      FROM sec_events e JOIN geo_overlaps g ON {_public(f'e.{side}_ip')} AND {_number(f'e.{side}_ip')} BETWEEN g.start_ip AND g.end_ip"""
    for side in ("source", "destination")
)


@query(
    "enrich_geo_overlaps",
    f"""SELECT event_id, side, country, asn FROM
      (SELECT *, row_number() OVER (PARTITION BY event_id, side ORDER BY width, start_ip, country, asn) AS place FROM ({_NARROWEST}) x) y WHERE place = 1""",
)
def enrich_geo_overlaps(spark, sf):
    """Where ranges overlap the narrowest holds an address."""
    out = enrich.with_geo_by_block(view(spark, sf, "sec_events"), view(spark, sf, "geo_overlaps"))
    sides = F.array(*[F.struct(F.lit(side).alias("side"), F.col(f"{side}_ip_geo").alias("geo")) for side in ("source", "destination")])
    return out.select("event_id", F.explode(sides).alias("s")).where("s.geo is not null").select("event_id", "s.side", "s.geo.country", "s.geo.asn")


_ENRICHED = f"""SELECT e.event_id, a.criticality AS asset_criticality,
  coalesce(u.department, CASE WHEN {_SVC} THEN 'IT' WHEN e.user_name IS NOT NULL THEN 'Unknown' END) AS user_department,
  concat_ws(',', CASE WHEN {_bad_ip('e.source_ip')} THEN 'ip:' || e.source_ip END, CASE WHEN {_bad_ip('e.destination_ip')} THEN 'ip:' || e.destination_ip END,
   CASE WHEN {_BAD_DOMAIN} THEN 'domain:' || e.domain END, CASE WHEN {_bad_hash('e.process_hash')} THEN 'hash:' || e.process_hash END,
   CASE WHEN {_bad_hash('e.file_hash')} THEN 'hash:' || e.file_hash END) AS iocs,
  CASE WHEN {_bad_hash('e.process_hash')} OR {_bad_hash('e.file_hash')} THEN 'T1059' ELSE '' END AS techniques,
  CASE WHEN {_bad_ip('e.source_ip')} OR {_bad_ip('e.destination_ip')} THEN 'unknown_apt' ELSE '' END AS actors,
  concat_ws(',', e.source_ip || '=' || CASE WHEN {_bad_ip('e.source_ip')} THEN -80 ELSE 0 END,
   e.destination_ip || '=' || CASE WHEN {_bad_ip('e.destination_ip')} THEN -80 ELSE 0 END,
   e.domain || '=' || CASE WHEN {_BAD_DOMAIN} THEN -60 ELSE 0 END) AS reputation,
  s.country AS source_country, d.country AS destination_country
  FROM (SELECT *, {_ASSET_KEY} AS lk FROM sec_events) e LEFT JOIN assets a ON a.asset_key = e.lk
  LEFT JOIN users u ON u.username = e.user_name {_GEO_JOIN}"""


def _enriched(spark, sf):
    registry = enrich.default_enrichment(
        view(spark, sf, "assets"), view(spark, sf, "users"), view(spark, sf, "geo_ranges")
    )
    return registry.apply(view(spark, sf, "sec_events"))


@query("enrich_all", _ENRICHED)
def enrich_all(spark, sf):
    entries = F.transform(F.map_entries("reputation"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return _enriched(spark, sf).select(
        "event_id", "asset_criticality", "user_department",
        F.transform("iocs", lambda i: F.concat(i["type"], F.lit(":"), i["value"])).alias("iocs"),
        F.transform("techniques", lambda t: t["technique_id"]).alias("techniques"),
        F.transform("threat_actors", lambda a: a["id"]).alias("actors"), entries.alias("reputation"),
        F.col("source_ip_geo.country").alias("source_country"), F.col("destination_ip_geo.country").alias("destination_country"),
    )


@query(
    "enrich_batch",
    f"""WITH x AS ({_ENRICHED}) SELECT asset_criticality, count(*) AS events, count(DISTINCT event_id) AS distinct_events,
      count(*) FILTER (iocs <> '') AS with_ioc FROM x GROUP BY asset_criticality""",
)
def enrich_batch(spark, sf):
    return _enriched(spark, sf).groupBy("asset_criticality").agg(
        F.count(F.lit(1)).alias("events"), F.count_distinct("event_id").alias("distinct_events"),
        F.count_if(F.size("iocs") > 0).alias("with_ioc"),
    )


@query("unenriched_events", f"SELECT e.event_id, e.hostname, e.source_ip {_ASSET_JOIN} WHERE asset_key IS NULL")
def unenriched_events(spark, sf):
    out = enrich.unenriched(view(spark, sf, "sec_events"), view(spark, sf, "assets"))
    return out.select("event_id", "hostname", "source_ip")
