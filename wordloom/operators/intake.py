"""Readers applied to the driver's tables: raw pages, and verse tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.catalog import query
from ..plans.domain import run_sql
from ..sources import readers


@query("s1_scan", "select o_orderkey, o_totalprice from orders where o_orderstatus = 'F'")
def s1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_orderstatus = 'F'").select("o_orderkey", "o_totalprice")


@query("s3_find_by", "select c_custkey, c_name from customer where c_mktsegment = 'BUILDING' order by c_custkey")
def s3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/customer.parquet").where(F.col("c_mktsegment") == "BUILDING").select("c_custkey", "c_name").orderBy("c_custkey")


@query("s9_html_text")
def s9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The visible text pieces of raw pages, with each page's number as the verse id."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    marked = pages.select(F.concat(F.lit('<div data-verse-id="'), F.col("page_id").cast("string"), F.lit('">'), "html", F.lit("</div>")).alias("html"))
    return readers.html_verses(marked, skip=("x", "f", "note", "nav", "ad"))


@query("f8_verse_words")
def f8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.verse_words(run_sql(spark, sf_dir, "select id, text from segment"))
