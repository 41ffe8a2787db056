"""op13: the prefix trie of all conversations, rebuilt to share beginnings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumenspan.llm import trie

NAME = "op13_prefix_trie"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = trie.materialize(trie.turns(spark.read.parquet(f"{sf_dir}/conversations.parquet")), "trie-placed")
    nodes = trie.prefix_trie(*trie.restarted(placed))
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


#: Every node against every other that lies on its smallest member's path. The checksum is computed bit by bit.
SQL = r"""
WITH RECURSIVE bits(i, n, v) AS (
  SELECT i, 0, i::BIGINT FROM range(256) t(i)
  UNION ALL
  SELECT i, n + 1, CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END FROM bits WHERE n < 8
), crc_table AS (
  SELECT list(v ORDER BY i) AS t FROM bits WHERE n = 8
), placed AS (
  SELECT conv_id, COALESCE(role, '') AS role, COALESCE(text, '') AS text,
    ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, COALESCE(role, ''), COALESCE(text, '')) AS nth
  FROM conversations WHERE conv_id IS NOT NULL
), ids AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base, CAST(conv_id AS VARCHAR) AS d FROM placed GROUP BY conv_id
), convs AS (
  SELECT conv_id, base, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(d) + 1), lambda i: CAST(ascii(substr(d, i, 1)) AS BIGINT))),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295::BIGINT) % 4 AS h
  FROM ids CROSS JOIN crc_table
), rebuilt AS (
  SELECT c.conv_id, 0 AS own, p.nth, role, text FROM convs c JOIN placed p ON p.conv_id = c.base AND p.nth <= h
  UNION ALL
  SELECT c.conv_id, 1 AS own, p.nth, role, text FROM convs c JOIN placed p ON p.conv_id = c.conv_id AND p.nth > h
), turns AS (
  SELECT conv_id, role, text, ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY own, nth) AS depth FROM rebuilt
), steps AS (
  SELECT conv_id, depth, text, list(md5(length(role) || ':' || role || text)) OVER (PARTITION BY conv_id ORDER BY depth) AS path FROM turns
  UNION ALL
  SELECT conv_id, 0, '', [] FROM convs
), nodes AS (
  SELECT depth, path, MIN(conv_id) AS conv_id, COUNT(*) AS n_convs, ANY_VALUE(text) AS text FROM steps GROUP BY depth, path
), children AS (
  SELECT depth - 1 AS depth, path[1:depth - 1] AS path, COUNT(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL
), rated AS (
  SELECT n.*, COALESCE(c.n, 0) AS n_children, (n_convs - 1) * len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS saved FROM nodes n LEFT JOIN children c USING (depth, path)
), below AS (
  SELECT a.depth, a.path, SUM(CASE WHEN b.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, SUM(b.saved) AS saved_tokens
  FROM rated a JOIN rated b ON b.depth >= a.depth AND b.path[1:a.depth] = a.path GROUP BY a.depth, a.path
), ends AS (
  SELECT depth, path, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS members
  FROM (SELECT conv_id, MAX(depth) AS depth, arg_max(path, depth) AS path FROM steps GROUP BY conv_id) GROUP BY depth, path
)
SELECT r.conv_id, CAST(r.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, r.n_convs, r.n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens,
  sha256(COALESCE(members, '')) AS ends_sha256
FROM rated r JOIN below b ON r.depth = b.depth AND r.path = b.path LEFT JOIN ends e ON r.depth = e.depth AND r.path = e.path
LEFT JOIN nodes p ON p.depth = r.depth - 1 AND p.path = r.path[1:r.depth - 1]
"""
