"""Stateful stream operators: cooldown and running baseline per key.

State is a table: each trigger reads the version the one before it wrote and writes its own. A
trigger's rows go through the operators batch uses, which split a hot key over tasks, so no worker
ever holds a key's rows, not even while a stream catches up.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators import analytics
from ..operators.analytics import COOLDOWN_MINUTES, SENSITIVITY, Z_THRESHOLD
from .sinks import by_batch, written, zone_path

#: (rows of a trigger, state before) -> (rows to write, (the written rows) -> state after)
Step = Callable[[DataFrame, DataFrame], tuple[DataFrame, Callable[[DataFrame], DataFrame]]]


def run_stateful(
    stream: DataFrame, step: Step, state: T.StructType, root: str, name: str, checkpoint: str, drain: bool = False, **more
) -> StreamingQuery:
    """Write what ``step`` makes of each trigger to the curated zone, with its state beside it.

    Both are written under the trigger's number, so a trigger that is repeated after a failure replaces
    what it wrote. The folder belongs to this checkpoint: a fresh checkpoint needs a fresh one.
    """
    spark = stream.sparkSession
    version = f"{root.rstrip('/')}/state/{name}/batch={{}}".format

    def trigger(rows: DataFrame, batch: int, path: str) -> None:
        before = spark.read.schema(state).parquet(version(batch - 1)) if batch else spark.createDataFrame([], state)
        out, after = step(rows, before)
        out.write.mode("overwrite").parquet(path)
        # The state follows from what was just written, not from a second run over the trigger's rows.
        after(spark.read.schema(out.schema).parquet(path)).write.mode("overwrite").parquet(version(batch))

    return by_batch(stream, trigger, zone_path(root, "curated", name), checkpoint, drain=drain, **more)


COOLDOWN_STATE = T.StructType([T.StructField("key", T.StringType()), T.StructField("last_sent", T.LongType())])


def alert_cooldown(
    alerts: DataFrame, key: Column, time: str, tie: str, root: str, name: str, checkpoint: str,
    minutes: int = COOLDOWN_MINUTES, lateness_minutes: int = 10, drain: bool = False,
) -> StreamingQuery:
    """Alerts to send ``(key, id, sent_at)``: none with the same key within the cooldown after a sent one.

    State is one instant per key; it goes once an alert has come that is later by more than cooldown and
    lateness. An alert older than its key's last sent one counts as within the cooldown.
    """
    gap, late = minutes * 60_000_000, lateness_minutes * 60_000_000

    def step(rows: DataFrame, before: DataFrame):
        keyed = rows.select(key.alias("key"), F.col(time).alias("at"), F.col(tie).alias("id"))
        open_ = keyed.join(before, "key", "left").where(F.col("last_sent").isNull() | (F.unix_micros("at") >= F.col("last_sent") + gap))
        sent = analytics.cooldown(open_, F.col("key"), "at", "id", minutes)
        newest = keyed.agg(F.max(F.unix_micros("at"))).first()[0]

        def after(sent: DataFrame) -> DataFrame:
            both = before.unionByName(sent.select("key", F.unix_micros("sent_at").alias("last_sent")))
            latest = both.groupBy("key").agg(F.max("last_sent").alias("last_sent"))
            return latest if newest is None else latest.where(F.col("last_sent") + gap + late >= newest)

        return sent, after

    return run_stateful(alerts, step, COOLDOWN_STATE, root, name, checkpoint, drain)


BASELINE_STATE = T.StructType([
    T.StructField("metric", T.StringType()), T.StructField("n", T.LongType()),
    *[T.StructField(c, T.DoubleType()) for c in ("mean", "m2", "low", "high")],
])


def metric_anomalies(
    metrics: DataFrame, root: str, name: str, checkpoint: str, z: float = Z_THRESHOLD, sensitivity: float = SENSITIVITY, drain: bool = False
) -> StreamingQuery:
    """Each value against the running baseline of its metric; state is five numbers a metric.

    Triggers count in the order they come, the values of one trigger in the order of time.
    """

    def step(rows: DataFrame, before: DataFrame):
        out = analytics.anomalies(rows.select("metric", "observed_at", "seq", "value"), z, sensitivity, prior=before)
        return out, lambda out: analytics.moments_after(out, before)

    return run_stateful(metrics, step, BASELINE_STATE, root, name, checkpoint, drain)


def result(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame:
    """What a stateful query has written so far."""
    return written(spark, zone_path(root, "curated", name), schema)
