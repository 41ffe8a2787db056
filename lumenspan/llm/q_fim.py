"""op12: every document as a fill-in-the-middle text over code points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenspan.llm import fim

NAME = "op12_fill_in_middle"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), unit="code_point")
    rebuilt = fim.restored(F.col("output"), F.col("form"))
    return made.select(
        "doc_id",
        F.col("n_units").alias("n"),
        "form",
        F.length("prefix").cast("long").alias("prefix_chars"),
        F.length("middle").cast("long").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(rebuilt, 256).alias("restored_sha256"),
    )


SQL = """
WITH drawn AS (
  SELECT doc_id, COALESCE(text, '') AS text, CAST(length(COALESCE(text, '')) AS BIGINT) AS n, sha256('1:' || COALESCE(CAST(doc_id AS VARCHAR), '')) AS digest FROM documents
), numbers AS (
  SELECT doc_id, text, n, CAST('0x' || substr(digest, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(digest, 9, 8) AS BIGINT) AS h2,
    CAST('0x' || substr(digest, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(digest, 25, 8) AS BIGINT) AS h4 FROM drawn
), cut AS (
  SELECT doc_id, text, n, LEAST(h1 % (n + 1), h2 % (n + 1)) AS a, GREATEST(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM numbers
), parts AS (
  SELECT *, substring(text, 1, a) AS prefix, substring(text, a + 1, b - a) AS middle, substring(text, b + 1, n - b) AS suffix FROM cut
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE text END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts
"""
