"""What the Python workers of every query are started with."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parents[2])
#: Python workers live long and are many: memory that a task needed goes back to the system when it ends.
WORKERS = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_ARENA_MAX": "2", "MALLOC_MMAP_THRESHOLD_": "8388608", "MALLOC_TRIM_THRESHOLD_": "67108864"}


def equip(spark: SparkSession) -> None:
    """Puts this package on the import path of the Python workers, wherever the driver was
    started, and WORKERS in their environment. Functions take both along when they are made."""
    environment = spark.sparkContext.environment
    known = environment.get("PYTHONPATH", "")
    if ROOT not in known.split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, known) if x)
    for key, value in WORKERS.items():
        environment.setdefault(key, value)
