"""op4: pack the documents into sequences of 4096 ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumenspan.llm import packing

NAME = "op4_best_fit_packing"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_ids=False)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


SQL = None  # needs a tokenizer; tests compare with encoding whole texts and check the packing itself
