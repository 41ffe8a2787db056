"""op6: pages to ZIP-packaged archives and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumenspan.llm import warc

NAME = "op6_warc_roundtrip"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    back = warc.read_archives(manifest, with_payload=False)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: Base-32 of the SHA-1: forty bits, ten hexadecimal digits, make eight letters.
SQL = """
WITH sized AS (
  SELECT page_id, CAST(strlen(COALESCE(html, '')) AS BIGINT) AS payload_bytes, sha1(COALESCE(html, '')) AS h FROM pages
), firsts AS (
  SELECT *, MIN(page_id) OVER (PARTITION BY h) AS first_id FROM sized
)
SELECT page_id, payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST((CAST('0x' || substr(h, CAST((i // 8) * 10 + 1 AS BIGINT), 10) AS BIGINT) >> CAST(35 - 5 * (i % 8) AS BIGINT)) & 31 AS BIGINT) + 1, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM firsts
"""
