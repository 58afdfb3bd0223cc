"""Importing this module registers every query of the engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import alignment, corpus, intake, measures, more, reads, state, text
from .catalog import Query
from .workers import equip

MODULES = (reads, state, corpus, text, alignment, intake, more, measures)


def shipped(query: Query) -> Query:
    """The query, with workers that can import this package (see workers)."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        equip(spark)
        return query(spark, sf_dir)

    run.__doc__, run.__name__ = query.__doc__, getattr(query, "__name__", "run")
    return run
