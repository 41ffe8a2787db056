"""The queries of the corpus operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lumenspan.llm import q_ann, q_fim, q_html, q_minhash, q_mixing, q_ngram, q_packing, q_pii, q_quality, q_sharding, q_tokens, q_trie, q_warc

Query = Callable[[SparkSession, str], DataFrame]

MODULES = (q_ann, q_fim, q_html, q_minhash, q_mixing, q_ngram, q_packing, q_pii, q_quality, q_sharding, q_tokens, q_trie, q_warc)


def queries() -> dict[str, Query]:
    return {m.NAME: m.query for m in MODULES}


def oracle_sql() -> dict[str, str]:
    return {m.NAME: m.SQL for m in MODULES if m.SQL}
