"""Tables in the folder that driver and executors share, and names that clash with none."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
#: Shuffle partitions per file of a stored table.
FILES = 8


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share.

    Only where a local session has none (tests) one is set here; on a cluster a folder
    of one machine would lose tables, so an unset folder is an error there."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = _OWN.get(spark.sparkContext.applicationId) or "file://" + tempfile.mkdtemp(prefix="wordloom-")
        _OWN[spark.sparkContext.applicationId] = path
    return path.rstrip("/")


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _path(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def new_path(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder; what is written there goes when the session ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    place, files = _path(spark, path)
    files.deleteOnExit(place)
    return path


def store(df: DataFrame, name: str, scanned: bool = False, files: int | None = None) -> DataFrame:
    """Writes df as a table in the shared folder and rereads it: lineage ends
    there, so a lost executor costs the tasks in flight and nothing earlier.

    What comes out of a shuffle (not scanned) is far less than the texts that
    shuffle partitions are sized for: FILES of them go to a file, which keeps the
    number of small files down. Pairs of ids (files) are dealt to still fewer
    files after all tasks have worked on them. `discard` removes the table early."""
    spark = df.sparkSession
    if files:
        df = df.repartition(max(1, parts(spark) // files))
    elif not scanned:
        df = df.coalesce(max(1, parts(spark) // FILES))
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Removes stored tables that nothing reads any more."""
    for df in tables:
        place, files = _path(df.sparkSession, df.stored_at)
        files.delete(place, True)


def bounded(df: DataFrame, rows: int) -> bool:
    """Whether df has at most `rows` rows, reading no more than that."""
    return df.limit(rows + 1).count() <= rows


def fresh(taken: Iterable[str], name: str) -> str:
    """A column name that is none of those taken (names differ by more than case)."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name += "_"
    return name
