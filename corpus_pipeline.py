"""From raw documents to packed sequences: STAGES in order, each stored and reread.

Each function takes (spark, docs, sf_dir), works on all that its predecessor kept
and returns what it keeps, with the columns of documents; the last returns the
pieces and the sequences that they are packed into.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wordloom.llm import decontam, lines, minhash, packing, quality
from wordloom.llm.base import store, table

STAGES = [
    ("quality_rules", quality.quality_filter),
    ("line_dedup", lines.dedup_stage),
    ("near_dedup", minhash.near_dedup),
    ("decontamination", decontam.decontaminate),
    ("packing", packing.pack_stage),
]

#: Expectation-maximisation, min-hash and subset sums have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), f"pipeline-{name}", scanned=True)
    return STAGES[-1][1](spark, docs, sf_dir)
