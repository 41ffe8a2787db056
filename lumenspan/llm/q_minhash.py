"""op7: groups of near-duplicate documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumenspan.llm import minhash

NAME = "op7_minhash_dedup"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: Exact: every shingle against every other of its hash, and components by a recursive search.
SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM words
), classes AS (
  SELECT md5(array_to_string(list_sort(s), chr(10))) AS k, MIN(doc_id) AS class_id, ANY_VALUE(s) AS s FROM sets WHERE len(s) > 0 GROUP BY k
), spread AS (
  SELECT class_id, len(s) AS n, UNNEST(s) AS g FROM classes
), links AS (
  SELECT a.class_id AS a, b.class_id AS b FROM spread a JOIN spread b ON a.g = b.g AND a.class_id <> b.class_id
  GROUP BY a.class_id, b.class_id, a.n, b.n HAVING 100 * COUNT(*) >= 75 * (a.n + b.n - COUNT(*))
), reach AS (
  SELECT class_id AS id, class_id AS other FROM classes
  UNION
  SELECT r.id, l.b FROM reach r JOIN links l ON r.other = l.a
), components AS (
  SELECT id AS class_id, MIN(other) AS component FROM reach GROUP BY id
)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, COALESCE(component, s.doc_id) AS component_id, COALESCE(component, s.doc_id) = s.doc_id AS kept
FROM sets s LEFT JOIN classes c ON len(s.s) > 0 AND md5(array_to_string(list_sort(s.s), chr(10))) = c.k LEFT JOIN components USING (class_id)
"""
