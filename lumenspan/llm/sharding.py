"""Contiguous shards of near equal bytes.

Documents are put in one global order (doc_id, null first, then size and checksum);
prefix sums of their sizes come from the totals of range partitions, and the line of
bytes is cut at equal targets. A document belongs to the shard in which its middle
byte falls.

Defined results: a null text counts as empty; an empty text has size 1; repeated rows
and ids keep separate slots; an empty table gives no rows; a document longer than a
target leaves neighbouring shards short or empty, for documents are never split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenspan.llm.common import materialize, with_prefix

SHARDS = 8


def assign_shards(sized: DataFrame, order: list[str], size: str = "size", shards: int = SHARDS) -> DataFrame:
    """Add ``shard`` and ``slot`` (place in the shard, from 0) to rows with a ``size`` of at least 1."""
    placed = with_prefix(sized, order, size, "shard-ranges")
    total = sized.agg(F.sum(size)).first()[0] or 1
    cut = placed.withColumn("shard", F.least(F.lit(shards - 1), F.expr(f"({shards} * (2 * before + {size})) div {2 * total}")).cast("int"))
    cut = materialize(cut, "shard-cut")
    first = F.broadcast(cut.groupBy("shard").agg(F.min("position").alias("first_")))  # one row a shard
    return cut.join(first, "shard").withColumn("slot", F.col("position") - F.col("first_")).drop("first_", "before", "position")


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Rows (doc_id, size, text_crc32, shard, slot)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    sized = docs.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    )
    return assign_shards(sized, ["doc_id", "size", "text_crc32"], shards=shards)


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """Write the documents as one folder a shard under ``path``, each in slot order within its files."""
    text = F.coalesce(F.col("text"), F.lit(""))
    sized = docs.withColumn("shard_size_", (F.octet_length(text) + 1).cast("long")).withColumn("shard_crc_", F.crc32(text.cast("binary")))
    placed = assign_shards(sized, ["doc_id", "shard_size_", "shard_crc_"], "shard_size_", shards)
    placed.drop("shard_size_", "shard_crc_").repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
