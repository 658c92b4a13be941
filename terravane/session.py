"""Session builder and the settings every plan in this library relies on."""

from __future__ import annotations

import tempfile
from collections.abc import Callable
from typing import Any

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def build(app: str = "terravane", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the library's defaults; keyword settings use _ for the dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in (DEFAULTS | {k.replace("_", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for checkpoints: the one that spark.checkpoint.dir names.

    Where that is unset, a session in one process (master local, as in tests) gets a folder of its own; on a cluster it is
    an error, as executors share no local folder."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named:
            if not sc.master.split("[")[0] == "local":
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            named = tempfile.mkdtemp(prefix="terravane-checkpoint-")
        sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """df, written once to the shared checkpoint folder and read from there afterwards."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread_table(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    """A table for work that is heavy per row: one that is read in fewer than half as many partitions as there are cores
    (a single small file) is spread over the cores by its key; any other is read as it lies, without an exchange."""
    df = table(spark, sf_dir, name)
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() * 2 <= cores else df


def share(spark: SparkSession, value: Any) -> Callable[[], Any]:
    """A function that gives the value in any task: broadcast once, with the code of its classes, unpacked once a task.

    Only for values of a bounded size, which the caller states."""
    sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    kept: list = []

    def get() -> Any:
        if not kept:
            kept.append(cloudpickle.loads(sent.value))
        return kept[0]

    return get
