"""Event enrichment: asset, user, threat intelligence, geolocation.

Every lookup is a left join on a unique key, so the event count never changes. Where a batch is
known, a dimension is cut to the keys the batch asks for, and goes to every worker if what is left is
measured to be small; else its statistics decide, and AQE splits a hot key when the join shuffles.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import evaluated_once, ipv4_number, is_private_number, is_service_account, non_empty, picked, rows_of
from ..session import materialised
from .detect import contains_any

# --- fixed values of the built-in threat rules ---------------------------------------
BAD_IP_PREFIXES = ("185.220.", "45.155.", "91.219.")
BAD_TLDS = (".xyz", ".top", ".tk", ".ml")
BAD_DOMAIN_WORDS = ("malware", "phish", "hack", "crack")
BAD_HASH_PREFIXES = ("a1b2c3", "deadbeef", "cafebabe")
IP_CONFIDENCE, DOMAIN_CONFIDENCE, HASH_CONFIDENCE = 0.85, 0.75, 0.95
IP_REPUTATION, DOMAIN_REPUTATION = -80, -60
IP_TAGS = ("malicious", "tor_exit", "c2")
DOMAIN_TAGS = ("suspicious", "recently_registered")
HASH_TAGS = ("malware", "trojan")
IP_ACTOR = "Unknown APT"
HASH_TECHNIQUE = ("Execution", "T1059", "Command and Scripting Interpreter")
# --------------------------------------------------------------------------------------


# --- asset and user -------------------------------------------------------------------


def asset_key() -> Column:
    """Lower-case host name, else source address."""
    return F.coalesce(F.lower(non_empty(F.col("hostname"))), non_empty(F.col("source_ip")))


def _one_per_key(dimension: DataFrame, key: Column, columns: tuple[str, ...]) -> DataFrame:
    """``_key`` and struct ``_row``: one row per key, of several the greatest in column order, so
    that a lookup never multiplies events."""
    return dimension.groupBy(key.alias("_key")).agg(F.max(F.struct(*columns)).alias("_row"))


def _looked_up(events: DataFrame, key: Column, dimension: DataFrame) -> DataFrame:
    """``events`` with the columns of ``dimension``, whose ``_key`` is unique; without a match they are null.

    Rows join on the key and its hash, those without a key on a hash of what they hold: they match nothing, and so
    lie in many tasks instead of one. As the dimension is dealt anew by both, AQE can split the rows of a hot key.
    """
    plain = [c for c, kind in events.dtypes if not kind.startswith(("map", "array", "struct", "variant"))]
    spread = F.when(key.isNull(), F.xxhash64(*[F.col(f"`{c}`") for c in plain])).otherwise(F.xxhash64(key))
    keyed = events.withColumns({"_key": key, "_spread": spread})
    return keyed.join(dimension.withColumn("_spread", F.xxhash64("_key")), ["_key", "_spread"], "left").drop("_key", "_spread")


def with_asset(events: DataFrame, assets: DataFrame) -> DataFrame:
    dim = _one_per_key(assets, F.lower("asset_key"), ("criticality", "owner", "department", "location")).select(
        "_key", *[F.col(f"_row.{c}").alias(f"asset_{c}") for c in ("criticality", "owner", "department", "location")],
        F.lit(True).alias("asset_found"),
    )
    return _looked_up(events, asset_key(), dim).withColumn("asset_found", F.coalesce("asset_found", F.lit(False)))


def with_user(events: DataFrame, users: DataFrame) -> DataFrame:
    """Directory attributes; a name the directory lacks gets the default for its kind."""
    dim = _one_per_key(users, F.col("username"), ("department", "privileged", "risk_score", "mfa_enabled")).select(
        "_key", *[F.col(f"_row.{c}").alias(f"_{c}") for c in ("department", "privileged", "risk_score", "mfa_enabled")],
        F.lit(True).alias("_known"),
    )
    name = F.col("user_name")
    service = is_service_account(name)

    def filled(column: str, for_service: object, otherwise: object) -> Column:
        default = F.when(service, F.lit(for_service)).when(name.isNotNull(), F.lit(otherwise))
        return F.coalesce(F.col(f"_{column}"), default)

    joined = _looked_up(events, name, dim)
    return joined.select(
        *events.columns,
        filled("department", "IT", "Unknown").alias("user_department"),
        filled("privileged", True, False).alias("user_privileged"),
        filled("risk_score", 30.0, 10.0).alias("user_risk_score"),
        filled("mfa_enabled", False, True).alias("user_mfa_enabled"),
        F.when(service, "service_account").when(name.isNotNull(), "employee").alias("user_type"),
        F.coalesce("_known", F.lit(False)).alias("user_known"),
    )


# --- threat intelligence: built-in rules, map-only --------------------------------------


def _ioc(kind: str, value: Column, confidence: float, source: str, tags: tuple[str, ...]) -> Column:
    return F.struct(
        F.lit(kind).alias("type"), value.alias("value"), F.lit(confidence).alias("confidence"),
        F.lit(source).alias("source"), F.array(*[F.lit(t) for t in tags]).alias("tags"),
    )


def bad_ip(ip: Column) -> Column:
    hit = F.lit(False)
    for prefix in BAD_IP_PREFIXES:
        hit = hit | ip.startswith(prefix)
    return F.coalesce(hit, F.lit(False))


def bad_domain(domain: Column) -> Column:
    low = F.lower(domain)
    hit = contains_any(low, BAD_DOMAIN_WORDS)
    for tld in BAD_TLDS:
        hit = hit | low.endswith(tld)
    return F.coalesce(hit, F.lit(False))


def bad_hash(value: Column) -> Column:
    low = F.lower(value)
    hit = F.lit(False)
    for prefix in BAD_HASH_PREFIXES:
        hit = hit | low.startswith(prefix)
    return F.coalesce(hit, F.lit(False))


def ip_ioc(ip: Column) -> Column:
    return F.when(bad_ip(ip), _ioc("ip", ip, IP_CONFIDENCE, "threat_intel", IP_TAGS))


def domain_ioc(domain: Column) -> Column:
    return F.when(bad_domain(domain), _ioc("domain", domain, DOMAIN_CONFIDENCE, "threat_intel", DOMAIN_TAGS))


def hash_ioc(value: Column) -> Column:
    return F.when(bad_hash(value), _ioc("hash", value, HASH_CONFIDENCE, "virustotal", HASH_TAGS))


def _last_wins(entries: Column) -> Column:
    """Map from entries; of two with one key the later stays."""
    kept = F.filter(
        entries,
        lambda e, i: ~F.exists(F.slice(entries, i + F.lit(2), F.size(entries)), lambda later: later["key"] == e["key"]),
    )
    return F.map_from_entries(kept)


def with_intel(events: DataFrame) -> DataFrame:
    """Built-in threat rules over both addresses, the domain and both hashes.

    Adds ``iocs`` (distinct by type and value), ``techniques``, ``threat_actors`` and
    ``reputation``. Constant rules are column expressions: no join, no shuffle.
    """
    src, dst, domain = F.col("source_ip"), F.col("destination_ip"), F.col("domain")
    hashes = [F.col("process_hash"), F.col("file_hash")]
    iocs = F.array_distinct(picked([ip_ioc(src), ip_ioc(dst), domain_ioc(domain), *map(hash_ioc, hashes)]))
    tactic, technique, name = HASH_TECHNIQUE
    any_hash = bad_hash(hashes[0]) | bad_hash(hashes[1])
    techniques = picked(
        [
            F.when(
                any_hash,
                F.struct(
                    F.lit("").alias("tactic_id"), F.lit(tactic).alias("tactic_name"),
                    F.lit(technique).alias("technique_id"), F.lit(name).alias("technique_name"),
                ),
            )
        ]
    )
    actors = picked([F.when(bad_ip(src) | bad_ip(dst), actor(F.lit(IP_ACTOR)))])

    def score(value: Column, bad: Column, points: int) -> Column:
        return F.when(
            non_empty(value).isNotNull(),
            F.struct(value.alias("key"), F.when(bad, points).otherwise(0).alias("value")),
        )

    scores = picked(
        [score(src, bad_ip(src), IP_REPUTATION), score(dst, bad_ip(dst), IP_REPUTATION),
         score(domain, bad_domain(domain), DOMAIN_REPUTATION)]
    )
    return events.select(
        "*", iocs.alias("iocs"), techniques.alias("techniques"), actors.alias("threat_actors"),
        _last_wins(scores).alias("reputation"),
    )


def actor(name: Column) -> Column:
    return F.struct(
        F.replace(F.lower(name), F.lit(" "), F.lit("_")).alias("id"), name.alias("name"),
        F.lit(0.5).alias("confidence"),
    )


# --- threat intelligence: indicator table -----------------------------------------------

def match_indicators(values: DataFrame, feed: DataFrame) -> DataFrame:
    """Best indicator per distinct (type, value); values without one are absent.

    ``feed`` has ``type``, ``pattern``, ``match`` (exact, prefix or suffix), ``confidence``
    and any payload. A prefix matches when the value's first characters, as many as the
    pattern has, are the pattern; so values are probed once for each pattern length that
    occurs for their type, by equality alone. A suffix is a prefix of the reversed text. Only
    distinct values take part, so the cost follows the number of different indicators.
    """
    text = F.lower("value")
    distinct = values.filter(non_empty(F.col("value")).isNotNull()).select("type", "value").distinct()

    pattern = F.lower("pattern")
    rules = feed.withColumn("_oriented", F.when(F.col("match") == "suffix", F.reverse(pattern)).otherwise(pattern)).withColumn(
        "_length", F.when(F.col("match") != "exact", F.length("_oriented"))
    )
    # One row per type: a pattern is at most as long as a value, so the arrays stay short.
    lengths = rules.groupBy("type").agg(F.collect_set(F.struct("match", F.col("_length").alias("length"))).alias("kinds"))

    def subject(kind) -> Column:
        turned = F.when(kind["match"] == "suffix", F.reverse(text)).otherwise(text)
        return F.when(kind["length"].isNull(), turned).otherwise(F.substring(turned, F.lit(1), kind["length"]))

    tried = F.transform("kinds", lambda k: F.struct(k["match"].alias("match"), k["length"].alias("_length"), subject(k).alias("_oriented")))
    probes = rows_of(distinct.join(lengths, "type"), ["type", "value"], tried)
    payload = [c for c in feed.columns if c not in ("type", "match")]
    same_length = rules.withColumn("_length", F.coalesce("_length", F.lit(-1)))
    hits = probes.withColumn("_length", F.coalesce("_length", F.lit(-1))).join(same_length, ["type", "match", "_length", "_oriented"])
    best = F.max_by(F.struct(*payload), F.struct("confidence", F.length("pattern"), "pattern"))
    return hits.groupBy("type", "value").agg(best.alias("hit"))


def with_feed(events: DataFrame, feed: DataFrame, columns: dict[str, list[str]]) -> DataFrame:
    """Left-join the best indicator of each column as ``<column>_hit``.

    ``columns`` maps an indicator type to the event columns that carry it.
    """
    pairs = [
        F.struct(F.lit(kind).alias("type"), F.col(name).alias("value"))
        for kind, names in columns.items() for name in names
    ]
    values = events.select(F.explode(F.array(*pairs)).alias("v")).select("v.*")
    verdicts = match_indicators(values, feed)
    for kind, names in columns.items():
        of_kind = verdicts.filter(F.col("type") == kind)
        for name in names:
            events = events.join(
                of_kind.select(F.col("value").alias(name), F.col("hit").alias(f"{name}_hit")), name, "left"
            )
    return events


def built_in_feed(spark) -> DataFrame:
    """The built-in rules as an indicator table (the domain words have no table form)."""
    rows = [("ip", p, "prefix", IP_CONFIDENCE, IP_REPUTATION, IP_ACTOR, None) for p in BAD_IP_PREFIXES]
    rows += [("domain", p, "suffix", DOMAIN_CONFIDENCE, DOMAIN_REPUTATION, None, None) for p in BAD_TLDS]
    rows += [("hash", p, "prefix", HASH_CONFIDENCE, None, None, HASH_TECHNIQUE[1]) for p in BAD_HASH_PREFIXES]
    return spark.createDataFrame(
        rows,
        "type string, pattern string, match string, confidence double, reputation int, actor string, technique string",
    )


# --- geolocation ------------------------------------------------------------------------


#: IPv4 addresses of a block, in which ranges are cut and looked up.
BLOCK_BITS = 16


def _sweep(batches):
    """Ranges of each block in the order of their starts to disjoint intervals, the narrowest on top."""
    def intervals(rows):
        block, heap, at, last = None, [], 0, None

        def upto(limit):
            """Intervals from ``at`` to before ``limit``; adjoining ones of one range are joined."""
            nonlocal at, last
            while heap and at < limit:
                if heap[0][3] < at:
                    heapq.heappop(heap)
                    continue
                _, _, order, end, geo = heap[0]
                end = min(end, limit - 1)
                if last is not None and last[4] == order and last[2] + 1 == at:
                    last = (*last[:2], end, *last[3:])
                else:
                    if last is not None:
                        yield last[:4]
                    last = (block, at, end, geo, order)
                at = end + 1
            at = max(at, limit)

        for number, row in enumerate(rows):
            if row["block"] != block:
                yield from upto(1 << 32)
                if last is not None:
                    yield last[:4]
                block, at, last = row["block"], row["lo"], None
                heap.clear()
            yield from upto(row["lo"])
            heapq.heappush(heap, (row["width"], row["start"], (row["tie"], number), row["hi"], row["geo"]))
        yield from upto(1 << 32)
        if last is not None:
            yield last[:4]

    def packed(rows, kind):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), kind))], names=["block", "lo", "hi", "geo"])

    kinds, held = [], []

    def rows():
        for batch in batches:
            kinds[:1] = [batch.schema.field("geo").type]
            yield from batch.to_pylist()

    for interval in intervals(rows()):
        held.append(interval)
        if len(held) >= 5000:
            yield packed(held, kinds[0])
            held.clear()
    if held:
        yield packed(held, kinds[0])


def disjoint_ranges(ranges: DataFrame) -> DataFrame:
    """Ranges ``(start_ip, end_ip, ...)`` as disjoint intervals ``(block, lo, hi, geo)``, cut at blocks of 65,536 addresses.

    Where ranges overlap the narrowest wins, of equally wide ones that with the smaller start, of equal ones the
    least payload. Of ranges that agree inside a block only the winner is kept before the shuffle, so a block
    never holds more than its different cuts. Ranges without a bound, or ending before they start, hold no address.
    """
    payload = [c for c in ranges.columns if c not in ("start_ip", "end_ip")]
    size, top = 1 << BLOCK_BITS, (1 << 32) - 1
    clean = ranges.where("start_ip <= end_ip").where((F.col("end_ip") >= 0) & (F.col("start_ip") <= top)).select(
        F.greatest("start_ip", F.lit(0)).cast("long").alias("first"), F.least("end_ip", F.lit(top)).cast("long").alias("final"),
        (F.col("end_ip") - F.col("start_ip")).cast("long").alias("width"), F.col("start_ip").cast("long").alias("start"), F.struct(*payload).alias("geo"),
    )
    cut = clean.withColumn("block", F.explode(F.sequence(F.shiftright("first", BLOCK_BITS), F.shiftright("final", BLOCK_BITS)))).select(
        "block", F.greatest("first", F.col("block") * size).alias("lo"), F.least("final", F.col("block") * size + size - 1).alias("hi"),
        F.struct("width", "start", F.to_json("geo").alias("tie"), "geo").alias("own"),
    )
    best = cut.groupBy("block", "lo", "hi").agg(F.min_by("own", F.struct("own.width", "own.start", "own.tie")).alias("own")).select("block", "lo", "hi", "own.*")
    out = T.StructType([*[T.StructField(c, T.LongType()) for c in ("block", "lo", "hi")], T.StructField("geo", best.schema["geo"].dataType)])
    return best.repartition("block").sortWithinPartitions("block", "lo", "width").mapInArrow(_sweep, out)


def locate(ips: DataFrame, ranges: DataFrame) -> DataFrame:
    """Narrowest range that holds each distinct public address of column ``ip``: an equi-join on
    the upper 16 bits finds the one interval that holds it."""
    public = (
        evaluated_once(ips.select("ip").distinct(), ipv4_number(F.col("ip")), "n")
        .filter(F.col("n").isNotNull() & ~is_private_number(F.col("n")))
        .withColumn("block", F.shiftright("n", BLOCK_BITS).cast("long"))
    )
    return public.join(disjoint_ranges(ranges), "block").filter(F.col("n").between(F.col("lo"), F.col("hi"))).select("ip", "geo")


def with_geo(events: DataFrame, ranges: DataFrame) -> DataFrame:
    ips = events.select(F.explode(F.array("source_ip", "destination_ip")).alias("ip"))
    located = locate(ips, ranges)
    for name in ("source_ip", "destination_ip"):
        events = events.join(
            located.select(F.col("ip").alias(name), F.col("geo").alias(f"{name}_geo")), name, "left"
        )
    return events


def with_geo_by_block(events: DataFrame, ranges: DataFrame) -> DataFrame:
    """Same result as :func:`with_geo` by one lookup per address; fits a stream, and a batch of
    which the events are already enriched, as it reads them once."""
    return _located(events, materialised(disjoint_ranges(ranges), "geo-intervals"))


def _block(number: Column) -> Column:
    """The block a public address is looked up in."""
    return F.when(~is_private_number(number), F.shiftright(number, BLOCK_BITS).cast("long"))


def _located(events: DataFrame, cuts: DataFrame) -> DataFrame:
    """A block's disjoint intervals are one row, a unique key, so the left join keeps every event. They
    are as many as the block's addresses at most, however many ranges overlap there.
    """
    blocks = cuts.groupBy(F.col("block").alias("_key")).agg(F.collect_list(F.struct("lo", "hi", "geo")).alias("intervals"))
    for name in ("source_ip", "destination_ip"):
        columns = events.columns
        number = ipv4_number(F.col(name))
        keyed = evaluated_once(events, number, "n").withColumn("block", _block(F.col("n")))
        holding = F.filter("intervals", lambda r: F.col("n").between(r["lo"], r["hi"]))
        events = _looked_up(keyed, F.col("block"), blocks).select(*columns, F.get(holding, F.lit(0))["geo"].alias(f"{name}_geo"))
    return events


# --- all together -----------------------------------------------------------------------


class EnrichmentRegistry:
    """Ordered ``name -> (events -> events)`` steps; a user adds steps by name."""

    def __init__(self) -> None:
        self.steps: dict[str, Callable[[DataFrame], DataFrame]] = {}
        #: Whether events stay in the tasks they come in, so that rows placed by date remain so.
        self.in_place = False

    def register(self, name: str, step: Callable[[DataFrame], DataFrame]) -> None:
        self.steps[name] = step

    def apply(self, events: DataFrame) -> DataFrame:
        for step in self.steps.values():
            events = step(events)
        return events


#: A lookup's rows for one batch go to every worker if their texts take at most so many bytes.
LOOKUP_BYTES = 16 << 20


def _asked(events: DataFrame) -> DataFrame:
    """kind, key: the distinct keys (host, user, address) events are looked up by; nulls match nothing and are left out."""
    kinds = (("host", asset_key()), ("user", F.col("user_name")), ("ip", F.col("source_ip")), ("ip", F.col("destination_ip")))
    pairs = F.array(*[F.struct(F.lit(kind).alias("kind"), key.alias("key")) for kind, key in kinds])
    return events.select(F.explode(pairs).alias("p")).select("p.*").where("key is not null").distinct()


def _cut(dimension: DataFrame, name: str) -> tuple[DataFrame, bool]:
    """The rows a batch asks for, written once, and whether they are few enough for every worker."""
    kept = materialised(dimension, name)
    size = kept.agg(F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(*kept.columns)))), F.lit(0))).first()[0]
    return (F.broadcast(kept), True) if size <= LOOKUP_BYTES else (kept, False)


def default_enrichment(assets: DataFrame, users: DataFrame, ranges: DataFrame, events: DataFrame | None = None) -> EnrichmentRegistry:
    """The built-in steps. With the ``events`` of a batch, lookups hold only what those ask for: a batch
    names few of all assets, so its wide rows mostly need not be dealt out anew for each lookup."""
    registry, geo = EnrichmentRegistry(), lambda e: with_geo_by_block(e, ranges)
    if events is not None:
        asked = materialised(_asked(events), "lookup-keys")
        hosts, names = (asked.where(F.col("kind") == kind).select("key") for kind in ("host", "user"))
        addresses = evaluated_once(asked.where("kind = 'ip'").select("key"), ipv4_number(F.col("key")), "n")
        blocks = addresses.select(_block(F.col("n")).alias("block")).where("block is not null").distinct()
        (assets, few_assets), (users, few_users), (cuts, few_cuts) = (
            _cut(assets.join(hosts, F.lower("asset_key") == F.col("key"), "left_semi"), "asked-assets"),
            _cut(users.join(names, F.col("username") == F.col("key"), "left_semi"), "asked-users"),
            _cut(disjoint_ranges(ranges).join(blocks, "block", "left_semi"), "geo-intervals"),
        )
        registry.in_place = few_assets and few_users and few_cuts
        geo = lambda e: _located(e, cuts)
    registry.register("asset_inventory", lambda e: with_asset(e, assets))
    registry.register("user_directory", lambda e: with_user(e, users))
    registry.register("threat_intel", with_intel)
    registry.register("geoip", geo)
    return registry


def unenriched(events: DataFrame, assets: DataFrame) -> DataFrame:
    """Events whose asset lookup had no key or no hit (left anti join)."""
    keyed = events.withColumn("_key", asset_key())
    return keyed.join(assets.select(F.lower("asset_key").alias("_key")), "_key", "left_anti").drop("_key")


def enriched_only(events: DataFrame, assets: DataFrame) -> DataFrame:
    """The other side of :func:`unenriched` (left semi join)."""
    keyed = events.withColumn("_key", asset_key())
    return keyed.join(assets.select(F.lower("asset_key").alias("_key")), "_key", "left_semi").drop("_key")
