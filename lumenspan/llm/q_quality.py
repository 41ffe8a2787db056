"""op8: judge the documents by rules whose cutoffs are certified on labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumenspan.llm import quality
from lumenspan.llm.common import materialize

NAME = "op8_quality_rules"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text")
    measured = materialize(quality.with_measures(docs).drop("text"), "quality-measures")
    judged = quality.judge(measured, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _sql() -> str:
    over = {
        "symbol_ratio": "n_symbols / NULLIF(word_chars, 0)",
        "dup_line_ratio": "n_dup_lines / NULLIF(n_lines, 0)",
        "repeat_ratio": "n_repeat_words / NULLIF(n_words, 0)",
        "upper_ratio": "n_upper / NULLIF(word_chars, 0)",
        "word_length": "word_chars / NULLIF(n_words, 0)",
    }
    rules, grids = list(quality.RULES), list(quality.RULES.values())
    n, steps = len(rules), sum(map(len, grids))
    sizes = f"[{', '.join(str(len(g)) for g in grids)}]"
    exceeded = ", ".join(" + ".join(f"CASE WHEN COALESCE({over[r]}, 0)::DOUBLE > {c}::DOUBLE THEN 1 ELSE 0 END" for c in quality.RULES[r]) for r in rules)
    level = f"{quality.DELTA}::DOUBLE / (SELECT n FROM strata)"
    # The order of the rules, one after another by the bad documents that they catch of those left.
    orders = ", ".join(
        f"""order{i + 1} AS (
  SELECT o.lang, list_append(o.rules, r) AS rules, o.mask + (1 << r) AS mask
  FROM order{i} o CROSS JOIN range({n}) x(r) LEFT JOIN bad b ON b.lang IS NOT DISTINCT FROM o.lang AND (b.hits >> r) & 1 = 1 AND b.hits & o.mask = 0
  WHERE (o.mask >> r) & 1 = 0 GROUP BY o.lang, o.rules, o.mask, r
  QUALIFY ROW_NUMBER() OVER (PARTITION BY o.lang ORDER BY COUNT(b.hits) DESC, r) = 1
)"""
        for i in range(n)
    )
    space = r"chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""
WITH texts AS (SELECT doc_id, lang, COALESCE(text, '') AS text FROM documents),
words AS (
  SELECT doc_id, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w, list_filter(string_split(text, chr(10)), lambda x: trim(x, {space}) <> '') AS l, text, lang FROM texts
), spread AS (
  SELECT doc_id, UNNEST(range(len(w))) AS i, UNNEST(w) AS word FROM words
), windows AS (
  SELECT doc_id, i, list(word) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS g FROM spread
), repeats AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, COUNT(*) OVER (PARTITION BY doc_id, g) AS c FROM windows WHERE len(g) = 5) WHERE c > 1
), covered AS (
  SELECT doc_id, COUNT(DISTINCT i + k) AS n_repeat_words FROM repeats CROSS JOIN range(5) t(k) GROUP BY doc_id
), judged AS (
  SELECT doc_id, lang, CAST(len(w) AS BIGINT) AS n_words, CAST(length(translate(text, {space}, '')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS n_upper,
    len(l) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(COALESCE(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
    len(w) < 10 OR 100 * COALESCE(n_repeat_words, 0) > 20 * len(w) AS base_failed
  FROM words LEFT JOIN covered USING (doc_id)
), levels AS (
  SELECT doc_id, lang, base_failed, [{exceeded}] AS e FROM judged
), labelled AS (
  SELECT ROW_NUMBER() OVER () AS nth_row, lang, good, e FROM levels
  JOIN (SELECT doc_id, MAX(quality) = 1 AS good FROM labels WHERE quality IS NOT NULL GROUP BY doc_id) USING (doc_id) WHERE NOT base_failed
), strata AS (
  SELECT COUNT(*) AS n FROM (SELECT DISTINCT lang FROM labelled WHERE good)
), enough AS (
  SELECT lang, COUNT(*) AS n FROM labelled WHERE good GROUP BY lang
  HAVING COUNT(*) >= ceil(ln({quality.MAIN}::DOUBLE * {level}) / ln(1 - {quality.ALPHA}::DOUBLE))
), bad AS (
  SELECT lang, list_sum(list_transform(range({n}), lambda r: CASE WHEN e[r + 1] > 0 THEN 1 << r ELSE 0 END))::BIGINT AS hits FROM labelled WHERE NOT good
), order0 AS (
  SELECT lang, []::BIGINT[] AS rules, 0::BIGINT AS mask FROM enough
), {orders}, chains AS (
  SELECT lang, nth, list_prepend(rules[nth + 1], list_filter(rules, lambda r: r <> rules[nth + 1])) AS rules FROM order{n} CROSS JOIN range({n}) x(nth)
), places AS (
  SELECT lang, nth, i, rules[i + 1] AS rule, {sizes}[rules[i + 1] + 1] AS size,
    COALESCE(SUM({sizes}[rules[i + 1] + 1]) OVER (PARTITION BY lang, nth ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS base
  FROM chains CROSS JOIN range({n}) x(i)
), hits AS (
  SELECT p.lang, p.nth, l.good, MIN(p.base + p.size - l.e[p.rule + 1] + 1) AS step
  FROM places p JOIN labelled l ON p.lang IS NOT DISTINCT FROM l.lang AND l.e[p.rule + 1] > 0 GROUP BY p.lang, p.nth, l.nth_row, l.good
), points AS (
  SELECT c.lang, c.nth, s.step, t.n, COUNT(h.step) FILTER (h.good) AS k, COUNT(h.step) FILTER (NOT h.good) AS caught
  FROM chains c JOIN enough t ON c.lang IS NOT DISTINCT FROM t.lang CROSS JOIN range(1, {steps + 1}) s(step)
  LEFT JOIN hits h ON h.lang IS NOT DISTINCT FROM c.lang AND h.nth = c.nth AND h.step <= s.step GROUP BY c.lang, c.nth, s.step, t.n
), tails AS (
  SELECT *, CASE WHEN k > {quality.ALPHA}::DOUBLE * n THEN 1 ELSE list_sum(list_transform(range(k + 1), lambda i: exp(lgamma(n + 1) - CASE WHEN i = 0 THEN 0 ELSE lgamma(i + 1) END
    - CASE WHEN i = n THEN 0 ELSE lgamma(n - i + 1) END + i * ln({quality.ALPHA}::DOUBLE) + (n - i) * ln(1 - {quality.ALPHA}::DOUBLE)))) END AS p
  FROM points
), walked AS (
  SELECT *, MAX(p) OVER (PARTITION BY lang, nth ORDER BY step) AS worst FROM tails
), chosen AS (
  SELECT lang, nth, step FROM walked
  WHERE worst <= CASE WHEN nth = 0 THEN {quality.MAIN}::DOUBLE ELSE (1 - {quality.MAIN}::DOUBLE) / {n - 1} END * {level} AND caught > {quality.PRICE} * k
  QUALIFY ROW_NUMBER() OVER (PARTITION BY lang ORDER BY caught - {quality.PRICE} * k DESC, nth, step) = 1
), fired AS (
  SELECT DISTINCT l.doc_id FROM chosen c JOIN places p ON p.lang IS NOT DISTINCT FROM c.lang AND p.nth = c.nth
  JOIN levels l ON l.lang IS NOT DISTINCT FROM c.lang AND l.e[p.rule + 1] > 0 AND p.base + p.size - l.e[p.rule + 1] + 1 <= c.step
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND doc_id NOT IN (FROM fired) AS kept FROM judged
"""


SQL = _sql()
