"""Table access for the llm operators; storage and components are the library's own."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from ..operators.graph import CONTROL, connected_components
from ..plans import storage
from ..plans.storage import bounded, discard, fresh, new_path, parts, shared_dir
from ..plans.workers import equip

__all__ = ["BATCH", "CONTROL", "bounded", "connected_components", "discard", "fresh", "new_path", "parts", "shared_dir", "staged", "store", "table", "tuned"]

#: Rows and bytes of text that an Arrow batch holds; what a Python worker holds at once follows from them.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "4m"}
#: Bytes that Spark may broadcast by its own estimate. It takes the size of compressed files or
#: blocks for it, and ids or copies of a text are many times that where the driver unpacks them.
BROADCAST = 256 << 10


def tuned(spark: SparkSession) -> SparkSession:
    """The session with BATCH set and at most BROADCAST: plans read these settings when they run, so they stay."""
    for key, value in BATCH.items():
        spark.conf.set(key, value)
    known = spark._jsparkSession.sessionState().conf()
    if known.autoBroadcastJoinThreshold() > BROADCAST:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", BROADCAST)
    if spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold", None):  # where it is set it overrules the other
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
    return spark


def store(df: DataFrame, name: str, scanned: bool = False, files: int | None = None) -> DataFrame:
    tuned(df.sparkSession)
    return storage.store(df, name, scanned, files)


def staged(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A pipeline stage that finds batches and workers as queries do, by whomever it is called."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        equip(spark)
        return stage(tuned(spark), docs, sf_dir)

    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tuned(spark).read.parquet(f"{sf_dir}/{name}.parquet")
