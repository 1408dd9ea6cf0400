"""Registration of a query together with its check SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixtures import duck
from ..session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)``; ``sql`` may use any fixture view by name."""

    def register(fn):
        @wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return presentable(fn(prepare(spark), sf_dir))

        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = duck.with_views(sql)
        return fn

    return register


def presentable(df: DataFrame) -> DataFrame:
    """Comparable output: text times, joined arrays, 64-bit numbers."""
    out = []
    for field in df.schema.fields:
        col = F.col(f"`{field.name}`")
        kind = field.dataType.simpleString()
        if kind in ("timestamp", "timestamp_ntz"):
            col = F.date_format(col, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        elif kind == "array<string>":
            col = F.array_join(col, ",")
        elif kind in ("int", "smallint", "tinyint"):
            col = col.cast("long")
        elif kind == "float":
            col = col.cast("double")
        out.append(col.alias(field.name))
    return df.select(*out)
