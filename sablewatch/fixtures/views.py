"""The views as Spark DataFrames."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from .text import SPARK, VIEWS, render

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def needed(sql: str, names) -> list[str]:
    """Names used by ``sql``, dependencies first."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name in names:
            if name not in order and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text, re.IGNORECASE):
                visit(names[name])
                order.append(name)

    visit(sql)
    return order


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str, streamed: bool = False) -> DataFrame:
    """One view as a lazy DataFrame; Catalyst prunes what the query does not use.

    ``streamed`` reads the events table as a file stream.
    """
    sql = VIEWS[name]
    ctes = [f"{dep} AS ({VIEWS[dep]})" for dep in needed(sql, VIEWS)]
    text = f"WITH {', '.join(ctes)} {sql}" if ctes else sql
    text = render(text, SPARK)
    if streamed:
        path = f"{sf_dir}/events.parquet"
        # As a pattern the path may be one file or a folder of many.
        stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{sf_dir}/events.parque[t]")
        stream.createOrReplaceTempView("_streamed_events")
        text = re.sub(r"\bFROM events\b(?! AS \()", "FROM _streamed_events AS events", text)
    for name_ in TABLES:
        text = re.sub(
            rf"\b(FROM|JOIN) {name_}\b(?! AS \()", rf"\1 parquet.`{sf_dir}/{name_}.parquet` AS {name_}", text
        )
    return spark.sql(text)
