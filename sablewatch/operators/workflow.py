"""Case workflow: queues, latest states, lists and rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import bucket_of, case_of

# --- fixed values: built-in procedures by task type -----------------------------------
PROCEDURES = {
    "assess_alert": ("Standard Alert Triage", (
        "Validate alert source and severity",
        "Check for false positive indicators",
        "Enrich with threat intelligence",
        "Determine if escalation needed",
    )),
    "analyze_artifact": ("Malware Analysis Procedure", (
        "Calculate file hashes",
        "Check against known malware databases",
        "Perform static analysis",
        "Execute in sandbox if needed",
        "Extract IOCs",
    )),
    "recommend_actions": ("Incident Response Procedure", (
        "Assess scope and impact",
        "Determine containment actions",
        "Identify affected assets",
        "Recommend eradication steps",
        "Plan recovery actions",
    )),
}
NO_EVENTS = "No related events"
# --------------------------------------------------------------------------------------


def filtered(rows: DataFrame, **equal: str | None) -> DataFrame:
    """Rows matching every given filter; a filter that is None does not apply."""
    for name, value in equal.items():
        if value is not None:
            rows = rows.filter(F.col(name) == value)
    return rows


def by_id(rows: DataFrame, id_col: str, value: str) -> DataFrame:
    """Lookup by id; the equality reaches the parquet scan."""
    return rows.filter(F.col(id_col) == value)


def write_for_lookup(rows: DataFrame, id_col: str, path: str, group_bytes: int | None = None) -> DataFrame:
    """Write rows so that :func:`by_id` reads little: files hold ranges of ids, row groups are sorted by
    id and carry a Bloom filter of it. Statistics rule out files and groups whose range does not hold an id,
    the filters those that merely could. Returns the table as read back.
    """
    writer = rows.repartitionByRange(id_col).sortWithinPartitions(id_col).write.option(f"parquet.bloom.filter.enabled#{id_col}", "true")
    if group_bytes is not None:
        writer = writer.option("parquet.block.size", group_bytes)
    writer.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def page(rows: DataFrame, limit: int = 50, offset: int = 0, newest: str = "created_at", tie: str = "alert_id") -> DataFrame:
    """One page, newest first, with the total of the filtered rows in each row."""
    total = rows.agg(F.count(F.lit(1))).scalar()
    ordered = rows.orderBy(F.col(newest).desc(), F.col(tie))
    return (ordered.offset(offset) if offset else ordered).limit(limit).withColumn("total", total)


def batch_head(alerts: DataFrame, size: int = 50) -> DataFrame:
    """The first alerts to triage, most urgent first, with the number waiting."""
    total = alerts.agg(F.count(F.lit(1))).scalar()
    return alerts.orderBy("priority", "alert_id").limit(size).withColumn("total_alerts", total)


def live_messages(messages: DataFrame, agent: str, as_of: Column) -> DataFrame:
    """Messages an agent still has to see: to it or to all, and not expired."""
    mine = F.col("to_agent").isNull() | (F.col("to_agent") == agent)
    live = (F.col("sent_at") <= as_of) & (
        F.unix_micros("sent_at") + F.col("ttl_seconds") * 1_000_000 > F.unix_micros(as_of)
    )
    return messages.filter(mine & live)


def next_tasks(tasks: DataFrame, by_priority: bool = False) -> DataFrame:
    """Next pending task per agent, first in first out.

    There are few agents and many tasks, so this is a combining aggregate and not a
    ranking window: each map task sends one row per agent.
    """
    order = ["priority", "assigned_at", "task_id"] if by_priority else ["assigned_at", "task_id"]
    payload = [c for c in tasks.columns if c != "agent_type"]
    return (
        tasks.filter(F.col("status") == "pending")
        .groupBy("agent_type")
        .agg(
            F.min_by(F.struct(*payload), F.struct(*order)).alias("t"), F.count(F.lit(1)).alias("waiting")
        )
        .select("agent_type", "t.*", "waiting")
    )


def live_values(writes: DataFrame, keys: list[str], as_of: Column) -> DataFrame:
    """Newest value per key, unless its time to live has lapsed.

    A later write replaces an earlier one even when the later one has already expired.
    """
    last = F.max_by(F.struct("value", "written_at", "ttl_seconds"), F.struct("written_at", "seq"))
    return (
        writes.filter(F.col("written_at") <= as_of)
        .groupBy(*keys)
        .agg(last.alias("w"))
        .select(*keys, "w.*")
        .filter(F.unix_micros("written_at") + F.col("ttl_seconds") * 1_000_000 > F.unix_micros(as_of))
    )


def current_status(updates: DataFrame) -> DataFrame:
    """Last written status per alert, and how many updates there were."""
    return updates.groupBy("alert_id").agg(
        F.max_by("status", F.struct("changed_at", "step")).alias("status"),
        F.max("changed_at").alias("changed_at"),
        F.count(F.lit(1)).alias("updates"),
    )


def status_transitions(updates: DataFrame, slice_seconds: int = 86_400) -> DataFrame:
    """Every status change with the status before it.

    ``lag`` runs inside (alert, time slice); the last status of the preceding non-empty
    slice is carried in from the much smaller per-slice table. No task holds all updates
    of one alert.
    """
    sliced = updates.withColumn("slice", bucket_of(F.col("changed_at"), slice_seconds))
    order = F.struct("changed_at", "step")
    ends = sliced.groupBy("alert_id", "slice").agg(F.max_by("status", order).alias("last_status"))
    carried = ends.select(
        "alert_id", "slice", F.lag("last_status").over(W.partitionBy("alert_id").orderBy("slice")).alias("carried")
    )
    inside = F.lag("status").over(W.partitionBy("alert_id", "slice").orderBy("changed_at", "step"))
    return (
        sliced.withColumn("inside", inside)
        .join(carried, ["alert_id", "slice"])
        .select(
            "alert_id", "step", "changed_at", F.coalesce("inside", "carried").alias("from_status"),
            F.col("status").alias("to_status"),
        )
    )


def event_heads(alert_events: DataFrame, events: DataFrame, size: int = 5) -> DataFrame:
    """The first events of each alert as formatted lines.

    ``row_number() <= size`` is pushed below the shuffle as a per-partition group limit.
    """
    first = W.partitionBy("alert_id").orderBy("event_id")
    heads = alert_events.withColumn("line_no", F.row_number().over(first)).filter(F.col("line_no") <= size)

    def text(name: str) -> Column:
        return F.coalesce(F.nullif(F.col(name), F.lit("")), F.lit("N/A"))

    line = F.concat(
        F.lit("- Type: "), F.col("event_type"), F.lit(", Source: "), text("source_ip"), F.lit(" -> "),
        text("destination_ip"), F.lit(", Process: "), text("process_name"), F.lit(", User: "), text("user_name"),
    )
    return heads.join(events, "event_id").select("alert_id", "line_no", line.alias("line"))


def routing_summaries(alerts: DataFrame, alert_events: DataFrame, events: DataFrame, size: int = 10) -> DataFrame:
    """Per alert the text of its first events a router is shown, one line each, or that there are none.

    At most ``size`` lines per alert meet in one row, whatever the number of its events; events
    that are not stored take no line.
    """
    stored = alert_events.join(events.select("event_id", "event_type", "source_system", "severity", "event_timestamp"), "event_id")
    first = W.partitionBy("alert_id").orderBy("event_id")
    line = F.concat(
        F.lit("- "), F.col("event_type"), F.lit(": "), F.col("source_system"), F.lit(" ("), F.lower(F.coalesce("severity", F.lit("medium"))),
        F.lit(") at "), F.date_format("event_timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS"),
    )
    heads = stored.withColumn("line_no", F.row_number().over(first)).filter(F.col("line_no") <= size)
    lines = heads.groupBy("alert_id").agg(F.sort_array(F.collect_list(F.struct("line_no", line.alias("line")))).alias("lines"))
    text = F.array_join(F.transform("lines", lambda x: x["line"]), "\n")
    return alerts.select("alert_id").join(lines, "alert_id", "left").select("alert_id", F.coalesce(text, F.lit(NO_EVENTS)).alias("summary"))


#: The number pairs of an alert travel under: 64 bits of its id.
_number = F.xxhash64


def _spans(pairs: DataFrame, times: DataFrame, key: str) -> DataFrame:
    return (
        pairs.select(key, "event_id").join(times, "event_id")
        .groupBy(key)
        .agg(
            F.count(F.lit(1)).alias("events"), F.min("event_timestamp").alias("first_event_time"),
            F.max("event_timestamp").alias("last_event_time"),
        )
    )


def event_span(alert_events: DataFrame, events: DataFrame) -> DataFrame:
    """First and last event time and number of stored events per alert.

    Pairs travel under a number hashed from the alert's id, which is put back once per alert. Alerts
    whose numbers agree are counted by their ids.
    """
    times = events.select("event_id", "event_timestamp")
    numbered = alert_events.select("alert_id", "event_id", F.when(F.col("alert_id").isNotNull(), _number("alert_id")).alias("number"))
    names = numbered.select("number", "alert_id").distinct().groupBy("number").agg(F.count(F.lit(1)).alias("ids"), F.min("alert_id").alias("alert_id"))
    # A null id has no number and stays null.
    own = _spans(numbered, times, "number").join(names, "number", "left").where("ids is null or ids = 1")
    # Equal numbers are chance: n alerts have about n * n / 2**65 such pairs.
    shared = F.broadcast(names.where("ids > 1").select("number"))
    rest = _spans(numbered.join(shared, "number", "left_semi"), times, "alert_id")
    return own.select(rest.columns).unionByName(rest)


def incident_rollup(members: DataFrame, alerts: DataFrame) -> DataFrame:
    """Per incident a row with its alert counts, and a row per affected asset and user.

    One grouping-sets pass; nothing is gathered into lists.
    """
    joined = members.select("incident_id", "alert_id").join(
        alerts.select("alert_id", "hostname", "user_name", "severity"), "alert_id"
    )
    incident, host, user = F.col("incident_id"), F.col("hostname"), F.col("user_name")
    kind = F.when(F.grouping("hostname") == 0, "asset").when(F.grouping("user_name") == 0, "user").otherwise("incident")
    return (
        joined.groupingSets([[incident], [incident, host], [incident, user]], incident, host, user)
        .agg(
            kind.alias("kind"), F.coalesce("hostname", "user_name").alias("value"), F.count(F.lit(1)).alias("alerts"),
            F.count_if(F.col("severity") == "critical").alias("critical_alerts"),
        )
        .filter((F.col("kind") == "incident") | F.col("value").isNotNull())
        .select("incident_id", "kind", "value", "alerts", "critical_alerts")
    )


def procedure_steps(tasks: DataFrame) -> DataFrame:
    """Steps of the built-in procedure of each task; task types without one yield none."""
    procedure = case_of(
        (
            F.col("task_type") == task_type,
            F.struct(F.lit(name).alias("name"), F.array(*[F.lit(s) for s in steps]).alias("steps")),
        )
        for task_type, (name, steps) in PROCEDURES.items()
    )
    return (
        tasks.select("task_id", "task_type", procedure.alias("p"))
        .select(
            "task_id", "task_type", F.col("p.name").alias("procedure"),
            F.posexplode_outer("p.steps").alias("pos", "step"),
        )
        .filter(F.col("step").isNotNull())
        .select(
            "task_id", "task_type", procedure_id(F.col("procedure")).alias("procedure_id"), "procedure",
            (F.col("pos") + 1).alias("step_no"), "step",
        )
    )


def procedure_id(name: Column) -> Column:
    return F.concat(F.lit("proc_"), F.replace(F.lower(name), F.lit(" "), F.lit("_")))
