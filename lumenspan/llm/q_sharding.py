"""op9: cut the documents into eight contiguous shards of near equal bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenspan.llm import sharding

NAME = "op9_shard_bytes"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: DuckDB has no checksum of this kind, so it is computed byte by byte from the usual polynomial.
SQL = """
WITH RECURSIVE bits(i, n, v) AS (
  SELECT i, 0, i::BIGINT FROM range(256) t(i)
  UNION ALL
  SELECT i, n + 1, CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END FROM bits WHERE n < 8
), crc_table AS (
  SELECT list(v ORDER BY i) AS t FROM bits WHERE n = 8
), texts AS (
  SELECT doc_id, hex(encode(COALESCE(text, ''))) AS h, CAST(strlen(COALESCE(text, '')) + 1 AS BIGINT) AS size FROM documents
), sized AS (
  SELECT doc_id, size, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, size), lambda i: CAST('0x' || substr(h, (2 * i - 1)::BIGINT, 2) AS BIGINT))),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295::BIGINT) AS text_crc32
  FROM texts CROSS JOIN crc_table
), placed AS (
  SELECT *, SUM(size) OVER (ORDER BY doc_id, size, text_crc32 ROWS UNBOUNDED PRECEDING) - size AS before, SUM(size) OVER () AS total FROM sized
), cut AS (
  SELECT *, CAST(LEAST(7, (8 * (2 * before + size)) // (2 * total)) AS INTEGER) AS shard FROM placed
)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, CAST(ROW_NUMBER() OVER (PARTITION BY shard ORDER BY doc_id, size, text_crc32) - 1 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM cut
"""
