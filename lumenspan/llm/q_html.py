"""op10: the main text of the pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumenspan.llm import html_text

NAME = "op10_html_text"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return html_text.extract(pages)


SQL = None  # parsing pages is beyond SQL; tests compare with a second, regular-expression form
