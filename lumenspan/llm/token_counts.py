"""Token counts for every context limit from an exact length histogram.

Documents are encoded whole, and only their lengths are kept: each task counts its own
lengths, the counts are added up by length, and sums over the lengths in order answer
for any limit how many documents fit, how many tokens remain after truncation and how
many are lost, and for any share the length below which that share of documents lies.

Defined results: a null text counts as empty and has length 0; repeated rows count
each; a limit between two lengths is answered exactly, for the totals are linear there;
an empty table gives an empty histogram.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenspan.llm.common import materialize, with_prefix
from lumenspan.llm.packing import slices, vocabulary_path, word_tokenizer


def _lengths(path: str | None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tokenizer, counts = word_tokenizer(path or vocabulary_path()), Counter()
    for batch in batches:
        for texts in slices(batch.column(0)):
            counts.update(len(x) // 4 for x in tokenizer.encode(texts))
    yield pa.RecordBatch.from_pydict({"length": pa.array(counts.keys(), pa.int64()), "n": pa.array(counts.values(), pa.int64())})


def histogram(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Rows (length, n_docs), one for each encoded length."""
    partial_counts = docs.select("text").mapInArrow(partial(_lengths, path), "length long, n long")
    return partial_counts.groupBy("length").agg(F.sum("n").alias("n_docs"))


def with_sums(lengths: DataFrame) -> DataFrame:
    """The histogram with its running sums, each length also taken as a context limit.

    n_longer: documents that the limit cuts; tokens_kept: tokens left after truncation
    to it; tokens_lost: those cut off; share: part of the documents up to this length.
    """
    weighed = materialize(lengths.withColumn("tokens", F.col("length") * F.col("n_docs")), "token-lengths")
    docs_total, tokens_total = weighed.agg(F.sum("n_docs"), F.sum("tokens")).first()
    by_docs = with_prefix(weighed, ["length"], "n_docs", "token-docs").withColumnRenamed("before", "docs_before").drop("position")
    both = with_prefix(by_docs, ["length"], "tokens", "token-sums")
    up_to, tokens_up_to = F.col("docs_before") + F.col("n_docs"), F.col("before") + F.col("tokens")
    n_longer = F.lit(docs_total or 0) - up_to
    kept = tokens_up_to + F.col("length") * n_longer
    return both.select(
        "length", "n_docs", n_longer.alias("n_longer"), kept.alias("tokens_kept"),
        (F.lit(tokens_total or 0) - kept).alias("tokens_lost"), (up_to / F.lit(docs_total or 1)).alias("share"),
    )


def totals_at(sums: DataFrame, limits: list[int]) -> DataFrame:
    """Rows (limit, n_longer, tokens_kept, tokens_lost) for any context limits from a table of with_sums.

    Between two lengths every document that is longer adds one token for each step of
    the limit, so the next length up answers for the limits under it.
    """
    asked = sums.sparkSession.createDataFrame([(int(x),) for x in limits], "limit long")
    nearest = asked.join(sums, F.col("length") >= F.col("limit")).groupBy("limit").agg(F.min(F.struct("length", "n_docs", "n_longer", "tokens_kept", "tokens_lost")).alias("x"))
    total = F.lit(sums.agg(F.max("tokens_kept")).first()[0] or 0)
    cut = F.when(F.col("x.length") > F.col("limit"), F.col("x.n_longer") + F.col("x.n_docs")).otherwise(F.col("x.n_longer"))
    kept = F.col("x.tokens_kept") - (F.col("x.length") - F.col("limit")) * cut
    found = nearest.select("limit", cut.alias("n_longer"), kept.alias("tokens_kept"))
    joined = asked.join(found, "limit", "left")
    return joined.select("limit", F.coalesce("n_longer", F.lit(0)).alias("n_longer"), F.coalesce("tokens_kept", total).alias("tokens_kept")).withColumn("tokens_lost", total - F.col("tokens_kept"))


def quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """Rows (share, length): the smallest length that at least this share of documents doesn't exceed."""
    asked = sums.sparkSession.createDataFrame([(float(x),) for x in shares], "asked double")
    return asked.join(sums, F.col("share") >= F.col("asked")).groupBy("asked").agg(F.min("length").alias("length")).withColumnRenamed("asked", "share")
