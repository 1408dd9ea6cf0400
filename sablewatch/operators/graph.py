"""Entity graph as node and edge tables: upserts and context lookups.

Context comes out as rows (one per fact) or as counts, never as one list per entity: an
address or host that touches a third of all events has too many neighbours for one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NODE = ["node_type", "node_id"]
EDGE = ["src_type", "src_id", "rel", "dst_type", "dst_id"]


def _latest_props(writes: DataFrame, keys: list[str]) -> DataFrame:
    """Last written value per key and property, then the properties as one map per key."""
    last = writes.groupBy(*keys, "prop").agg(F.max_by("val", F.struct("written_at", "seq")).alias("val"))
    entries = F.sort_array(F.collect_list(F.struct("prop", "val")))
    return last.groupBy(*keys).agg(F.map_from_entries(entries).alias("props"))


def upsert_nodes(writes: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Nodes after merging writes ``(node_type, node_id, prop, val, written_at, seq)``.

    Every property keeps its last write; properties not written stay. ``stored`` holds
    earlier writes in the same shape. The map has one entry per property name.
    """
    rows = writes if stored is None else stored.unionByName(writes)
    return _latest_props(rows, NODE)


def upsert_edges(writes: DataFrame, nodes: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Edges after merging writes; an edge needs both its end nodes.

    Writes collapse to one row per edge before the two semi joins, so a busy edge costs
    one row in them.
    """
    rows = writes if stored is None else stored.unionByName(writes)
    ids = nodes.select(*NODE)
    merged = _latest_props(rows, EDGE)
    for end in ("src", "dst"):
        side = ids.select(F.col("node_type").alias(f"{end}_type"), F.col("node_id").alias(f"{end}_id"))
        merged = merged.join(side, [f"{end}_type", f"{end}_id"], "left_semi")
    return merged


def _out(edges: DataFrame, rel: str, name: str) -> DataFrame:
    """Distinct targets per source of a relation, as facts."""
    return (
        edges.filter(F.col("rel") == rel).select(F.col("src_id").alias("node_id"), F.col("dst_id").alias("value"))
        .distinct().withColumn("attribute", F.lit(name))
    )


def _in(edges: DataFrame, rel: str, name: str) -> DataFrame:
    return (
        edges.filter(F.col("rel") == rel).select(F.col("dst_id").alias("node_id"), F.col("src_id").alias("value"))
        .distinct().withColumn("attribute", F.lit(name))
    )


def _with_facts(nodes: DataFrame, *facts: DataFrame) -> DataFrame:
    rows = facts[0]
    for more in facts[1:]:
        rows = rows.unionByName(more)
    return nodes.join(rows, "node_id", "left")


def asset_context(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per asset: criticality and department, with a row per vulnerability and recent user."""
    department = (
        edges.filter(F.col("rel") == "BELONGS_TO").groupBy(F.col("src_id").alias("node_id"))
        .agg(F.min("dst_id").alias("department"))
    )
    assets = nodes.filter(F.col("node_type") == "Asset").select("node_id", "criticality")
    return _with_facts(
        assets.join(department, "node_id", "left"),
        _out(edges, "HAS_VULNERABILITY", "vulnerability"), _in(edges, "ACCESSED", "recent_user"),
    ).select("node_id", "criticality", "department", "attribute", "value")


def user_context(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per user: risk, privilege and number of assets accessed, with a row per group."""
    users = nodes.filter(F.col("node_type") == "User").select(
        "node_id", F.coalesce("risk_score", F.lit(0.0)).alias("risk_score"),
        F.coalesce("privileged", F.lit(False)).alias("privileged"),
    )
    touched = _out(edges, "ACCESSED", "asset").groupBy("node_id").agg(F.count(F.lit(1)).alias("asset_count"))
    counted = users.join(touched, "node_id", "left").withColumn("asset_count", F.coalesce("asset_count", F.lit(0)))
    return _with_facts(counted, _out(edges, "MEMBER_OF", "group")).select(
        "node_id", "risk_score", "privileged", "asset_count", "attribute", "value"
    )


def ip_context(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per address: reputation, with a row per threat actor and domain."""
    ips = nodes.filter(F.col("node_type") == "IP").select("node_id", "reputation")
    return _with_facts(
        ips, _out(edges, "ASSOCIATED_WITH", "threat_actor"), _out(edges, "RESOLVES_TO", "domain")
    ).select("node_id", "reputation", "attribute", "value")


_ENTITY_OF_NODE = {"Asset": "asset", "User": "user", "IP": "ip"}


def entity_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row per asset, user and address with its attributes and neighbour counts."""
    ends = edges.select(
        F.explode(
            F.array(
                F.struct(F.col("src_type").alias("node_type"), F.col("src_id").alias("node_id"), F.col("rel"), F.col("dst_id").alias("other")),
                F.struct(F.col("dst_type").alias("node_type"), F.col("dst_id").alias("node_id"), F.col("rel"), F.col("src_id").alias("other")),
            )
        ).alias("e")
    ).select("e.*").distinct()

    def neighbours(node_type: str, rel: str):
        return F.count_if((F.col("node_type") == node_type) & (F.col("rel") == rel))

    counts = ends.groupBy("node_type", "node_id").agg(
        neighbours("Asset", "HAS_VULNERABILITY").alias("vulnerabilities"), neighbours("Asset", "ACCESSED").alias("users"),
        neighbours("User", "MEMBER_OF").alias("groups"), neighbours("User", "ACCESSED").alias("assets"),
        neighbours("IP", "ASSOCIATED_WITH").alias("threat_actors"), neighbours("IP", "RESOLVES_TO").alias("domains"),
        F.min(F.when((F.col("node_type") == "Asset") & (F.col("rel") == "BELONGS_TO"), F.col("other"))).alias("department"),
    )
    from ..functions import lookup

    return (
        nodes.filter(F.col("node_type").isin(*_ENTITY_OF_NODE))
        .join(counts, ["node_type", "node_id"], "left")
        .withColumn("entity_type", lookup(F.col("node_type"), _ENTITY_OF_NODE))
        .withColumnRenamed("node_id", "entity_value")
        .drop("node_type")
    )


def context_for(entities: DataFrame, summary: DataFrame) -> DataFrame:
    """Entities of events with their context; domains and hashes have none."""
    return entities.join(summary, ["entity_type", "entity_value"], "left")
