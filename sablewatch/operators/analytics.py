"""Windowed aggregates, running baselines, anomaly flags and alert cooldown."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import bucket_of
from ..session import materialised

# --- fixed values: defaults of anomaly detection and alerting -------------------------
Z_THRESHOLD, SENSITIVITY, WINDOW_HOURS, COOLDOWN_MINUTES = 3.0, 0.8, 24, 15
# --------------------------------------------------------------------------------------

HOUR, MINUTE = 3600, 60


def windowed(events: DataFrame, exact: bool = True, window: str = "5 minutes") -> DataFrame:
    """Tumbling aggregates by source and severity.

    Works on a stream with ``exact=False``, where distinct counts are approximate: a stream
    cannot hold an exact distinct aggregate.
    """
    distinct = F.count_distinct if exact else F.approx_count_distinct
    return (
        events.groupBy(F.window("event_timestamp", window), "source_system", "severity")
        .agg(
            F.count(F.lit(1)).alias("event_count"),
            distinct("hostname").alias("unique_hosts"),
            distinct("user").alias("unique_users"),
            F.avg("risk_score").alias("avg_risk_score"),
            F.max("severity_normalized").alias("max_severity"),
        )
        .select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "*")
        .drop("window")
    )


def recent(events: DataFrame, as_of: Column, minutes: int = 5) -> DataFrame:
    """Counts over the last minutes: total and by severity, source and type, in one pass."""
    since = F.timestamp_add("MINUTE", F.lit(-minutes), as_of)
    dims = ("severity", "source_system", "event_type")
    picked = events.filter((F.col("event_timestamp") >= since) & (F.col("event_timestamp") <= as_of))
    sets = [[], *[[F.col(d)] for d in dims]]
    dimension = F.lit("total")
    value = F.lit(None).cast("string")
    for d in dims:
        dimension = F.when(F.grouping(d) == 0, d).otherwise(dimension)
        value = F.when(F.grouping(d) == 0, F.col(d)).otherwise(value)
    return (
        picked.groupingSets(sets, *dims)
        .agg(
            dimension.alias("dimension"), value.alias("value"), F.count(F.lit(1)).alias("event_count"),
            F.count_distinct("hostname").alias("unique_hosts"),
        )
        .select("dimension", "value", "event_count", "unique_hosts")
    )


def severity_rollup(events: DataFrame) -> DataFrame:
    """Counts by source and severity with subtotals and the grand total."""
    return events.rollup("source_system", "severity").agg(
        F.grouping_id().alias("level"), F.count(F.lit(1)).alias("event_count"),
        F.count_distinct("hostname").alias("unique_hosts"),
    )


def baselines(metrics: DataFrame) -> DataFrame:
    """Mean, sample deviation (0 for one value), count and range per metric."""
    return metrics.groupBy("metric").agg(
        F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"),
        F.count("value").alias("count"), F.min("value").alias("min"), F.max("value").alias("max"),
    )


def threshold(z: float = Z_THRESHOLD, sensitivity: float = SENSITIVITY) -> float:
    return z * (1 - sensitivity) + z * 0.5


def _slices(metrics: DataFrame, seconds: int) -> DataFrame:
    """Per (metric, slice): count, moments around the metric's centre, range.

    The centre is the metric's overall mean. Sums of squares around it do not cancel the
    way raw ones do when the mean is large against the spread.
    """
    per_slice = metrics.groupBy("metric", bucket_of(F.col("observed_at"), seconds).alias("slice")).agg(
        F.count("value").alias("n"), F.avg("value").alias("avg"), F.var_pop("value").alias("var"),
        F.min("value").alias("low"), F.max("value").alias("high"),
    )
    whole = W.partitionBy("metric")
    centre = F.sum(F.col("n") * F.col("avg")).over(whole) / F.sum("n").over(whole)
    off = F.col("avg") - F.col("centre")
    return (
        per_slice.withColumn("centre", centre)
        .withColumn("s1", F.col("n") * off)
        .withColumn("s2", F.col("n") * (F.col("var") + off * off))
    )


def _numbers_only(metrics: DataFrame) -> DataFrame:
    """NaN is no value, like NULL: it gets no verdict and enters no baseline."""
    return metrics.withColumn("value", F.when(~F.isnan("value"), F.col("value")))


def _judged(rows: DataFrame, z: float, sensitivity: float) -> DataFrame:
    """Flag and reason from prior ``n``, ``mean`` and ``std``."""
    limit = threshold(z, sensitivity)
    score = F.when(F.col("std") > 0, F.abs(F.col("value") - F.col("mean")) / F.col("std"))
    none = F.coalesce(F.col("n"), F.lit(0)) == 0
    missing = F.col("value").isNull()
    return (
        rows.withColumn("z_score", F.when(~none, score))
        .withColumn(
            "is_anomaly",
            F.when(none | missing, False).when(F.col("std") == 0, F.col("value") != F.col("mean")).otherwise(F.col("z_score") > limit),
        )
        .withColumn(
            "reason",
            F.when(missing, "no_value").when(none, "no_baseline").when(F.col("std") == 0, "zero_variance")
            .when(F.col("is_anomaly"), F.format_string("z_score_%.2f", "z_score")).otherwise("within_baseline"),
        )
    )


def _deviation(n: Column, s1: Column, s2: Column) -> Column:
    return F.sqrt(F.greatest((s2 - s1 * s1 / n) / (n - 1), F.lit(0.0)))


def moments_after(judged: DataFrame, prior: DataFrame) -> DataFrame:
    """Per metric ``(metric, n, mean, m2, low, high)`` of all values judged so far: those of ``prior``
    and the ones just judged."""
    new = judged.groupBy("metric").agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), (F.var_pop("value") * F.count("value")).alias("m2"),
        F.min("value").alias("low"), F.max("value").alias("high"),
    ).where("n > 0")
    n = F.sum("n")
    mean = F.sum(F.col("n") * (F.col("mean") - F.col("first"))) / n + F.max("first")
    both = prior.unionByName(new).withColumn("first", F.min("mean").over(W.partitionBy("metric")))
    merged = both.groupBy("metric").agg(
        n.alias("n"), mean.alias("mean"),
        (F.sum("m2") + F.sum(F.col("n") * (F.col("mean") - F.col("first")) ** 2) - F.sum(F.col("n") * (F.col("mean") - F.col("first"))) ** 2 / n).alias("m2"),
        F.min("low").alias("low"), F.max("high").alias("high"),
    )
    return merged.withColumn("m2", F.greatest("m2", F.lit(0.0)))


def anomalies(
    metrics: DataFrame, z: float = Z_THRESHOLD, sensitivity: float = SENSITIVITY, slice_seconds: int = MINUTE, prior: DataFrame | None = None
) -> DataFrame:
    """Each value against the baseline of all earlier values of its metric.

    Two levels: sums of whole earlier slices come from a small per-slice table, and the
    running window covers one (metric, slice) only. A metric with a third of all rows is
    thereby spread over as many tasks as it has slices. ``prior`` gives moments
    (``moments_after``) of values that came before all of these.
    """
    metrics = _numbers_only(metrics)
    small = _slices(metrics, slice_seconds)
    before = W.partitionBy("metric").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    before_all = small.select(
        "metric", "slice", "centre",
        *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"p_{c}") for c in ("n", "s1", "s2")],
        F.min("low").over(before).alias("p_low"), F.max("high").over(before).alias("p_high"),
    )
    if prior is not None:
        # Moments around the mean they had, moved to the centre used here (their own where no value has one).
        earlier = prior.select("metric", *[F.col(c).alias(f"e_{c}") for c in ("n", "mean", "m2", "low", "high")])
        centre = F.coalesce("centre", "e_mean")
        away, n = F.coalesce(F.col("e_mean") - centre, F.lit(0.0)), F.coalesce("e_n", F.lit(0))
        before_all = before_all.join(earlier, "metric", "left").select(
            "metric", "slice", centre.alias("centre"), (F.col("p_n") + n).alias("p_n"), (F.col("p_s1") + n * away).alias("p_s1"),
            (F.col("p_s2") + F.coalesce("e_m2", F.lit(0.0)) + n * away * away).alias("p_s2"),
            F.least("p_low", "e_low").alias("p_low"), F.greatest("p_high", "e_high").alias("p_high"),
        )
    off = F.col("value") - F.col("centre")
    inside = W.partitionBy("metric", "slice").orderBy("observed_at", "seq").rowsBetween(W.unboundedPreceding, -1)

    def running(total: Column, prior_name: str) -> Column:
        return F.col(prior_name) + F.coalesce(F.sum(total).over(inside), F.lit(0))

    rows = (
        metrics.withColumn("slice", bucket_of(F.col("observed_at"), slice_seconds))
        .join(before_all, ["metric", "slice"])
        .select(
            "metric", "observed_at", "seq", "value", "centre",
            running(F.when(F.col("value").isNotNull(), 1), "p_n").alias("n"), running(off, "p_s1").alias("s1"),
            running(off * off, "p_s2").alias("s2"),
            F.least(F.col("p_low"), F.min("value").over(inside)).alias("low"),
            F.greatest(F.col("p_high"), F.max("value").over(inside)).alias("high"),
        )
        .withColumn("mean", F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(F.col("centre") + F.col("s1") / F.nullif("n", F.lit(0))))
        .withColumn(
            "std",
            F.when(F.col("low") == F.col("high"), 0.0).when(F.col("n") > 1, _deviation(F.col("n"), F.col("s1"), F.col("s2"))),
        )
    )
    return _judged(rows, z, sensitivity).select(
        "metric", "observed_at", "seq", "value", "n", "mean", "std", "z_score", "is_anomaly", "reason"
    )


def _cells(metrics: DataFrame) -> DataFrame:
    """Per (metric, second): count, moments around the metric's mean, range.

    However many rows a metric has, it has at most one cell a second.
    """
    centres = metrics.groupBy("metric").agg(F.avg("value").alias("centre"))
    off = F.col("value") - F.col("centre")
    return (
        metrics.join(centres, "metric")
        .groupBy("metric", "centre", F.unix_seconds("observed_at").alias("sec"))
        .agg(
            F.count("value").alias("n"), F.coalesce(F.sum(off), F.lit(0.0)).alias("s1"), F.coalesce(F.sum(off * off), F.lit(0.0)).alias("s2"),
            F.min("value").alias("low"), F.max("value").alias("high"),
        )
        .withColumn("hour", F.floor(F.col("sec") / HOUR).cast("long"))
    )


_PARTS = {"n": F.sum, "s1": F.sum, "s2": F.sum, "low": F.min, "high": F.max}


def _edge_entries(cells: DataFrame, hours: int) -> DataFrame:
    """Each cell in its own hour, and as a question in the hour in which its frame begins.

    An (metric, hour) group thus holds at most two rows for each of its seconds.
    """
    nothing = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("s1"), F.lit(0.0).alias("s2"), *[F.lit(None).cast("double").alias(c) for c in ("low", "high")])
    places = F.array(
        F.struct(F.col("hour").alias("at"), F.lit(True).alias("own"), F.struct(*_PARTS).alias("part")),
        F.struct((F.col("hour") - hours).alias("at"), F.lit(False).alias("own"), nothing.alias("part")),
    )
    return cells.select("metric", "sec", F.explode(places).alias("e")).select("metric", "sec", "e.at", "e.own", "e.part.*", F.pmod("sec", F.lit(HOUR)).alias("offset"))


def _frames(cells: DataFrame, hours: int) -> DataFrame:
    """Sums per (metric, second) over the ``hours`` before it.

    A frame is the end of its first hour, whole hours, and the beginning of its last hour.
    Nothing is subtracted, so nothing cancels.
    """
    within = W.partitionBy("metric", "at")
    before = within.orderBy("offset").rangeBetween(W.unboundedPreceding, -1)
    rest = within.orderBy(F.desc("offset")).rangeBetween(W.unboundedPreceding, W.currentRow)
    edges = _edge_entries(cells, hours).select(
        "metric", "sec", *[F.when(F.col("own"), agg(c).over(before)).otherwise(agg(c).over(rest)).alias(c) for c, agg in _PARTS.items()]
    )
    parts = edges
    if hours > 1:
        whole = W.partitionBy("metric").orderBy("hour").rangeBetween(1 - hours, -1)
        hourly = cells.groupBy("metric", "hour").agg(*[agg(c).alias(c) for c, agg in _PARTS.items()])
        between = hourly.select("metric", "hour", *[agg(c).over(whole).alias(c) for c, agg in _PARTS.items()])
        parts = edges.unionByName(cells.select("metric", "sec", "hour").join(between, ["metric", "hour"]).drop("hour"))
    return parts.groupBy("metric", "sec").agg(*[agg(c).alias(c) for c, agg in _PARTS.items()])


def anomalies_in_window(
    metrics: DataFrame, hours: int = WINDOW_HOURS, z: float = Z_THRESHOLD, sensitivity: float = SENSITIVITY
) -> DataFrame:
    """Each value against the values of its metric in the preceding hours (of earlier seconds).

    All rows of a second share one frame, so frames are made from per-second cells and joined back. No task gets more
    than an hour of one metric's seconds, or the hours of one metric, whatever share of the rows it has.
    """
    metrics = _numbers_only(metrics)
    cells = _cells(metrics)
    frames = _frames(cells, hours).join(cells.select("metric", "sec", "centre"), ["metric", "sec"])
    same = F.col("low") == F.col("high")
    rows = (
        metrics.withColumn("sec", F.unix_seconds("observed_at")).join(frames, ["metric", "sec"])
        .withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
        .withColumn("mean", F.when(same, F.col("low")).otherwise(F.col("centre") + F.col("s1") / F.nullif("n", F.lit(0))))
        .withColumn("std", F.when(same, 0.0).when(F.col("n") > 1, _deviation(F.col("n"), F.col("s1"), F.col("s2"))))
    )
    return _judged(rows, z, sensitivity).select(
        "metric", "observed_at", "seq", "value", "n", "mean", "std", "z_score", "is_anomaly", "reason"
    )


# --- cooldown ---------------------------------------------------------------------------
#
# An alert is sent unless one with the same key was sent less than the cooldown before: a
# greedy chain, in which each decision depends on the one before. What a stretch of time does
# depends on the past only through the time of the last sent alert, and it does so as a step
# function: "if the chain is ready by this time, the stretch's last sent alert is that one".
# An alert by itself is such a function of one step. Functions of neighbouring stretches compose
# to one function, so a tree of stretches, each FAN_OUT times as long as the ones below, is
# composed upwards; downwards each stretch learns when the chain is ready at its start; and the
# lowest stretches are replayed from there. A hot key is in as many tasks as it has stretches.


FAN_OUT = 64
_NEVER = np.iinfo(np.int64).min  # ready since ever; also the time of the row that carries a start


def _runs(batches: Iterator[pd.DataFrame], by: list[str], columns: list[str]) -> Iterator[tuple]:
    """(identity, columns) of the runs of equal ``by`` inside each batch; a group longer than a
    batch comes as several runs, so no group is ever held as a whole."""
    for pdf in batches:
        ids = [pdf[c].to_numpy() for c in by]
        arrays = [pdf[c].to_numpy() for c in columns]
        changed = np.zeros(max(len(pdf) - 1, 0), bool)
        for a in ids:
            changed |= a[1:] != a[:-1]
        cuts = [0, *(np.flatnonzero(changed) + 1), len(pdf)]
        for lo, hi in zip(cuts, cuts[1:]):
            if hi > lo:
                yield tuple(a[lo] for a in ids), [a[lo:hi] for a in arrays]


def _framed(rows: Iterator[tuple], names: list[str], size: int = 20_000) -> Iterator[pd.DataFrame]:
    rows = iter(rows)
    while some := list(islice(rows, size)):
        yield pd.DataFrame(some, columns=names)


class _Steps:
    """The step function of a stretch, composed while its parts' steps pass by in time order."""

    def __init__(self, start: int, gap: int) -> None:
        self.zone, self.gap, self.open = start + gap, gap, True
        # If ready by upto (and not by the upto before), the last one sent is last.
        self.upto = self.last = np.zeros(0, np.int64)

    def see(self, upto: np.ndarray, last: np.ndarray) -> None:
        while len(self.last):
            hit = np.searchsorted(upto, self.last + self.gap, side="left")
            on = hit < len(upto)
            if not on.any():
                break
            self.last = np.where(on, last[np.minimum(hit, len(upto) - 1)], self.last)
        if self.open:
            # A chain is ready at most one cooldown after the start: later steps but the next one are never first.
            first = int(np.searchsorted(upto, self.zone, side="left")) + 1
            self.open = first > len(upto)
            new = last[:first]
            while True:
                hit = np.searchsorted(upto, new + self.gap, side="left")
                on = hit < len(upto)
                if not on.any():
                    break
                new = np.where(on, last[np.minimum(hit, len(upto) - 1)], new)
            self.upto, self.last = np.append(self.upto, upto[:first]), np.append(self.last, new)
        keep = np.append(self.last[1:] != self.last[:-1], True)
        self.upto, self.last = self.upto[keep], self.last[keep]


def _compose(gap: int, width: int):
    def run(batches):
        def functions():
            current = own = None
            for identity, (upto, last) in _runs(batches, ["key", "stretch"], ["upto", "last"]):
                if identity != current:
                    if own is not None:
                        yield from ((*current, int(u), int(s)) for u, s in zip(own.upto, own.last))
                    current, own = identity, _Steps(int(identity[1]) * width, gap)
                own.see(upto, last)
            if own is not None:
                yield from ((*current, int(u), int(s)) for u, s in zip(own.upto, own.last))

        return _framed(functions(), ["key", "stretch", "upto", "last"])

    return run


def _descend(gap: int):
    """From each stretch's start (its first row) to the starts of its parts."""

    def run(batches):
        def starts():
            current, part, ready = None, None, _NEVER
            for identity, (parts, upto, last) in _runs(batches, ["key", "stretch"], ["part", "upto", "last"]):
                for p, u, s in zip(parts, upto, last):
                    if u == _NEVER:
                        current, part, ready = identity, None, int(s)
                        continue
                    if p != part:
                        part, done = p, False
                        yield identity[0], int(p), ready
                    if not done and ready <= u:
                        # Of a part only the step that applies counts.
                        ready, done = int(s) + gap, True

        return _framed(starts(), ["key", "stretch", "ready"])

    return run


def _replay(gap: int):
    def run(batches):
        def sent():
            ready = _NEVER
            for (key, _), (times, ids, starts) in _runs(batches, ["key", "stretch"], ["t", "id", "ready"]):
                i = 0
                if times[0] == _NEVER:
                    ready, i = int(starts[0]), 1
                while (i := i + int(np.searchsorted(times[i:], ready, side="left"))) < len(times):
                    yield key, int(times[i]), ids[i]
                    ready = int(times[i]) + gap

        return _framed(sent(), ["key", "t", "id"])

    return run


def cooldown(
    alerts: DataFrame, key: Column, time: str, tie: str, minutes: int = COOLDOWN_MINUTES, fan_out: int = FAN_OUT
) -> DataFrame:
    """Alerts that are sent: ``(key, id, sent_at)``, id being the text value of column ``tie``.

    Alerts without key or time are never sent. Workers hold, of one key, at most the steps of one
    cooldown; composing merges steps as soon as their chains meet.
    """
    gap = minutes * 60_000_000
    # Of several alerts with one key at one instant only the first can be sent.
    firsts = materialised(
        alerts.select(key.alias("key"), F.unix_micros(time).alias("t"), F.col(tie).cast("string").alias("id"))
        .where("key is not null and t is not null").groupBy("key", "t").agg(F.min("id").alias("id")),
        "cooldown-firsts",
    )

    def stretch(at: str, width: int) -> Column:
        return F.floor(F.col(at) / F.lit(width)).cast("long")

    low, high = firsts.agg(F.min("t"), F.max("t")).first()
    widths = [gap * fan_out]
    while low is not None and low // widths[-1] != high // widths[-1]:
        widths.append(widths[-1] * fan_out)
    steps, levels = firsts.select("key", F.col("t").alias("upto"), F.col("t").alias("last")), []
    for width in widths:
        steps = materialised(
            steps.withColumn("stretch", stretch("upto", width)).repartition("key", "stretch").sortWithinPartitions("key", "stretch", "upto")
            .mapInPandas(_compose(gap, width), "key string, stretch long, upto long, last long"),
            "cooldown-steps",
        )
        levels.append(steps)
    starts = levels[-1].select("key", "stretch").distinct().withColumn("ready", F.lit(_NEVER))
    for below, width, part_width in zip(levels[-2::-1], widths[:0:-1], widths[-2::-1]):
        parts = below.select("key", stretch("upto", width).alias("stretch"), F.col("stretch").alias("part"), "upto", "last")
        lead = starts.select("key", "stretch", F.lit(_NEVER).alias("part"), F.lit(_NEVER).alias("upto"), F.col("ready").alias("last"))
        starts = (
            parts.unionByName(lead).repartition("key", "stretch").sortWithinPartitions("key", "stretch", "upto")
            .mapInPandas(_descend(gap), "key string, stretch long, ready long")
        )
    rows = firsts.select("key", stretch("t", widths[0]).alias("stretch"), "t", "id", F.lit(0).cast("long").alias("ready")).unionByName(
        starts.select("key", "stretch", F.lit(_NEVER).alias("t"), F.lit(None).cast("string").alias("id"), "ready")
    )
    sent = (
        rows.repartition("key", "stretch").sortWithinPartitions("key", "stretch", "t")
        .mapInPandas(_replay(gap), "key string, t long, id string")
    )
    return sent.select("key", "id", F.timestamp_micros("t").alias("sent_at"))
