"""op2: find personal data in the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenspan.llm import pii

NAME = "op2_pii_spans"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = pii.with_spans(docs)
    kinds = F.col("base_")["k"]
    counts = [(F.size("base_") - F.size(F.array_remove(kinds, n))).cast("long").alias(f"n_{k}") for n, k in enumerate(pii.KINDS)]
    four, secrets = F.filter("spans_", lambda x: x["k"] < len(pii.KINDS)), F.filter("spans_", lambda x: x["k"] == len(pii.KINDS))
    return found.select(
        "doc_id", *counts, F.sha2(pii.written(F.col("base_")), 256).alias("base_sha256"), pii.written(four).alias("spans"),
        F.size(secrets).cast("long").alias("n_secret"), pii.written(secrets).alias("secrets"), F.size("spans_").cast("long").alias("n_spans"),
    )


SQL = None  # the boosted trees are no SQL; tests hold the base spans against a brute-force search
