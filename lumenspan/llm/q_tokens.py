"""op3: token totals of the documents for every context limit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumenspan.llm import token_counts

NAME = "op3_token_counts"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.with_sums(token_counts.histogram(spark.read.parquet(f"{sf_dir}/documents.parquet")))


SQL = None  # needs a tokenizer; tests compare with encoding whole texts one by one
