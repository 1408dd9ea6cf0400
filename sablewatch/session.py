"""Session settings and the shared working folder."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

import sablewatch

# Functions that run in Python workers travel with the plan, so executors need no copy
# of this package.
cloudpickle.register_pickle_by_value(sablewatch)

# Runtime SQL settings every operator relies on; all can be set on a live session.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # An enrichment dimension has one row per key while the fact side may hold a
    # third of all rows on one key: let AQE split such a partition even when that
    # costs an extra exchange further down.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else built."""
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def local_session(app: str = "sablewatch", cores: str = "*", **conf: str) -> SparkSession:
    """Session for tests and the benchmark; a cluster job brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
    )
    for key, value in {**RUNTIME_CONF, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh path below the checkpoint folder the cluster names.

    ``spark.checkpoint.dir`` is read from the session. Only a local master, where no
    such folder is configured, falls back to a temporary one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    ) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        base = tempfile.mkdtemp(prefix="sablewatch-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
    if threading.get_ident() in _SCRATCH:
        _SCRATCH[threading.get_ident()].append(path)
    return path


#: By thread, the folders made inside an open :func:`scratch`.
_SCRATCH: dict[int, list[str]] = {}
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What is run inside leaves no shuffle files: they go with the query that made them.

    Otherwise they stay until the driver happens to collect its garbage, so a job of many steps holds
    the shuffles of all of them at once.
    """
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Like :func:`shuffles_dropped`; folders of :func:`shared_dir` go at the end, too, so what is
    returned must not read them."""
    thread = threading.get_ident()
    outer, _SCRATCH[thread] = _SCRATCH.get(thread), []
    try:
        with shuffles_dropped(spark):
            yield
    finally:
        made = _SCRATCH.pop(thread)
        if outer is not None:
            _SCRATCH[thread] = outer
        for path in made:
            delete(spark, path)


def materialised(df: DataFrame, purpose: str) -> DataFrame:
    """Write an intermediate table to the shared folder and read it back.

    For a result several branches of one plan need: it is computed once, and a lost
    executor costs no recomputation of what came before.
    """
    path = shared_dir(df.sparkSession, purpose)
    schema = df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)
