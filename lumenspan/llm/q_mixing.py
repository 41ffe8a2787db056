"""op1: mix the documents by source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenspan.llm import mixing

NAME = "op1_mix_sources"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    planned = mixing.planned_copies(mixing.doc_sizes(docs))
    return planned.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


SQL = f"""
WITH sizes AS (
  SELECT doc_id, source, CAST(COALESCE(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents
), sources AS (
  SELECT source, CAST(SUM(size) AS BIGINT) AS source_size FROM sizes GROUP BY source
), weighted AS (
  SELECT *, CAST(list_extract([5, 2, 1], ((ROW_NUMBER() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT) AS BIGINT) AS weight FROM sources
), steps AS (
  SELECT *, COALESCE(SUM(source_size) OVER w, 0) AS s_before, COALESCE(SUM(weight) OVER w, 0) AS w_before, SUM(source_size) OVER () AS total, SUM(weight) OVER () AS weights
  FROM weighted WINDOW w AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), levels AS (
  SELECT CAST(total - 3 * s_before AS DOUBLE) / CAST(weights - w_before AS DOUBLE) AS level, s_before FROM steps
  WHERE CAST(total - 3 * s_before AS DOUBLE) / CAST(weights - w_before AS DOUBLE) * weight <= 3 * source_size
), chosen AS (
  SELECT arg_min(level, s_before) AS level FROM levels
), targets AS (
  SELECT source, source_size, LEAST(weight * level, CAST(3 * source_size AS DOUBLE)) AS target FROM weighted CROSS JOIN chosen
), rates AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM targets
), drawn AS (
  SELECT s.doc_id, s.size, r.*, k.seed,
    CASE WHEN CAST('0x' || substr(md5(k.seed || ':' || COALESCE(CAST(s.doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE < r.rate - floor(r.rate) THEN 1 ELSE 0 END AS extra
  FROM sizes s JOIN rates r ON s.source IS NOT DISTINCT FROM r.source CROSS JOIN (SELECT UNNEST(range({mixing.SEEDS})) AS seed) k
), seeds AS (
  SELECT source, seed, ABS(floor(rate) * source_size + SUM(extra * size) - target) AS miss FROM drawn GROUP BY source, seed, rate, source_size, target
), best AS (
  SELECT source, seed FROM seeds QUALIFY ROW_NUMBER() OVER (PARTITION BY source ORDER BY miss, seed) = 1
)
SELECT d.doc_id, d.size, d.source_size, d.target, CAST((floor(d.rate) + d.extra) * d.size AS BIGINT) AS taken
FROM drawn d JOIN best b ON d.source IS NOT DISTINCT FROM b.source AND d.seed = b.seed
"""
