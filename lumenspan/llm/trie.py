"""The prefix trie of conversations by preorder-interval encoding.

A node is a distinct sequence of first turns; a conversation lies under every node that
starts it. No turn sequence is ever gathered:

1. Running sums over (conversation, position) add up a hash of each turn with its
   position; depth and sum name the node that a conversation has reached.
2. Nodes are put in a lexicographic order that is a preorder. Among the children of a
   node one with the most conversations is heavy and comes last. A node's key lists the
   other steps only, as (2 * depth + 1, turn), and ends with (2 * its own depth, none);
   at most log2(conversations) such steps lie on a path, so keys stay short however
   deep a conversation is.
3. The place of a node in that order is its preorder number. Its subtree ends at the
   largest number of the conversation ends below it.
4. Leaves and savings of a subtree are differences of prefix sums over the order, at the
   subtree's end and before its start.

Large conversations span many ranges of the sums, and hot nodes meet partial aggregates
and joins on written tables that Spark can split. The digest of the conversations that
end at a node is computed over rows in order, in bounded memory; it is one pass over the
ids by its nature.

Defined results: turns are ordered by turn (null first), then role and text, so ties are
broken alike in every run; null roles and texts count as empty; rows without a
conversation id take no part; repeated rows are turns of their own; other columns are
dropped; without conversations there are no nodes, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenspan.llm.common import materialize, word_count
from lumenspan.operators.scans import running_sums

#: A node's sum of turn hashes is below 2**80 a turn, so that sums over 10**13 turns fit 38 digits.
_HASH = "decimal(28,0)"


def turns(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, nth, code, words): the turns in order from 1, each with a 128-bit code of role and text."""
    filled = conversations.where("conv_id IS NOT NULL").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    placed = running_sums(filled, ["conv_id"], ["turn", "role", "text"], [], "trie-turns")
    code = F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")))
    return placed.select("conv_id", "nth", code.alias("code"), word_count(F.col("text")).alias("words"))


def restarted(placed: DataFrame, every: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv_id) and their turns, rebuilt to share beginnings.

    Conversation c starts with the first h turns of conversation c - c % every, as far as it
    has them, and goes on with its own after its first h; h is crc32(decimal c) % most.
    """
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).alias("h")
    convs = placed.groupBy("conv_id").agg(F.count("*").alias("n")).select("conv_id", "n", h, (F.col("conv_id") - F.col("conv_id") % every).alias("base"))
    convs = materialize(convs, "trie-conversations")
    known = convs.where("conv_id = base").select("base", F.col("n").alias("base_n"))
    convs = convs.join(known, "base", "left").select("conv_id", "h", "base", F.least("h", F.coalesce("base_n", F.lit(0))).alias("taken"))
    heads = placed.where((F.col("nth") < most) & (F.col("conv_id") % every == 0)).select(F.col("conv_id").alias("base"), "nth", "code", "words")
    first = convs.join(heads, "base").where("nth <= h").select("conv_id", "nth", "code", "words")
    own = placed.join(convs, "conv_id").where("nth > h").select("conv_id", (F.col("nth") - F.col("h") + F.col("taken")).alias("nth"), "code", "words")
    return convs.select("conv_id"), materialize(first.unionByName(own), "trie-rebuilt")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (depth, sum, conv_id) sorted by node and id: one digest of the comma-joined ids for each node."""
    current, digest = None, None
    for batch in batches:
        done = []
        for depth, path, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (depth, path) == current:
                digest.update(b",")
            else:
                if current is not None:
                    done.append((*current, digest.hexdigest()))
                current, digest = (depth, path), hashlib.sha256()
            digest.update(str(conv).encode())
        yield _digest_rows(done)
    if current is not None:
        yield _digest_rows([(*current, digest.hexdigest())])


def _digest_rows(rows: list[tuple]) -> pa.RecordBatch:
    depth, path, digest = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(depth, pa.int64()), pa.array(path, pa.decimal128(38, 0)), pa.array(digest, pa.string())], names=["depth", "path", "ends_sha256"])


def prefix_trie(convs: DataFrame, placed: DataFrame) -> DataFrame:
    """One row a node of the trie of ``placed`` (conv_id, nth, code, words) under the conversations ``convs``.

    Gives conv_id (smallest member; with depth it names the node), depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens (of its subtree), ends_sha256, and the
    interval of preorder numbers first to last.
    """
    # Two hashes give 80 bits; the position is part of both, so the sum names a sequence.
    value = (F.xxhash64("nth", "code").bitwiseAND((1 << 62) - 1).cast(_HASH) * F.lit(1 << 18).cast("decimal(7,0)") + F.pmod(F.hash("code", "nth"), F.lit(1 << 18))).cast(_HASH)
    steps = running_sums(placed.withColumn("value", value), ["conv_id"], ["nth"], ["value"], "trie-paths")
    steps = steps.select("conv_id", F.col("nth").alias("depth"), F.col("value_upto").cast("decimal(38,0)").alias("path"), (F.col("value_upto") - F.col("value")).cast("decimal(38,0)").alias("parent_path"), "code", "words")
    nothing = F.lit(0).cast("decimal(38,0)")
    roots = convs.select("conv_id", F.lit(0).cast("long").alias("depth"), nothing.alias("path"), F.lit(None).cast("decimal(38,0)").alias("parent_path"), F.lit(None).cast("binary").alias("code"), F.lit(0).cast("long").alias("words"))
    steps = materialize(steps.unionByName(roots), "trie-steps")

    nodes = steps.groupBy("depth", "path").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.first("parent_path").alias("parent_path"), F.first("code").alias("code"), F.first("words").alias("words"))
    nodes = materialize(nodes, "trie-nodes")
    inner = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent_path").alias("path")).agg(F.count("*").alias("n_children"), F.max_by("path", F.struct("n_convs", "path")).alias("heavy"))
    inner = materialize(inner, "trie-inner")

    # The steps that leave a heavy path, a few for each conversation.
    parents = inner.select((F.col("depth") + 1).alias("depth"), F.col("path").alias("parent_path"), "heavy")
    light = nodes.join(parents, ["depth", "parent_path"]).where("path <> heavy").select("depth", "path")
    turn = F.struct((2 * F.col("depth") - 1).alias("at"), "code")
    kept = steps.join(materialize(light, "trie-light"), ["depth", "path"]).groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("light"))
    keyed = nodes.join(materialize(kept, "trie-keys"), "conv_id", "left").join(inner, ["depth", "path"], "left")
    end = F.struct((2 * F.col("depth")).alias("at"), F.lit(None).cast("binary").alias("code"))
    above = F.filter(F.coalesce("light", F.array().cast("array<struct<at:bigint,code:binary>>")), lambda x: x["at"] < 2 * F.col("depth"))
    keyed = keyed.select("depth", "path", "parent_path", "conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), F.concat(above, F.array(end)).alias("key"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    keyed = keyed.withColumn("leaf", F.when(F.col("n_children") == 0, 1).otherwise(0))
    ordered = materialize(running_sums(keyed, [], ["key"], ["leaf", "saved"], "trie-order").drop("key"), "trie-order")

    # A subtree ends with the last conversation end below it.
    last_steps = steps.groupBy("conv_id").agg(F.max(F.struct("depth", "path")).alias("end")).select("conv_id", "end.*")
    last_steps = materialize(last_steps, "trie-ends")
    numbers = last_steps.join(ordered.select("depth", "path", "nth"), ["depth", "path"]).select("conv_id", F.col("nth").alias("end_nth"))
    spans = steps.join(materialize(numbers, "trie-numbers"), "conv_id").groupBy("depth", "path").agg(F.max("end_nth").alias("last"))
    at_end = ordered.select(F.col("nth").alias("last"), F.col("leaf_upto").alias("leaf_end"), F.col("saved_upto").alias("saved_end"))
    full = ordered.join(materialize(spans, "trie-spans"), ["depth", "path"]).join(at_end, "last")

    sorted_ends = last_steps.select("depth", "path", "conv_id").repartition("depth", "path").sortWithinPartitions("depth", "path", "conv_id")
    digests = sorted_ends.mapInArrow(_digests, "depth long, path decimal(38,0), ends_sha256 string")
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("path").alias("parent_path"), F.col("conv_id").alias("parent_conv_id"))
    full = full.join(digests, ["depth", "path"], "left").join(above, ["depth", "parent_path"], "left")
    return full.select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        "n_children",
        (F.col("leaf_end") - F.col("leaf_upto") + F.col("leaf")).alias("n_leaves"),
        (F.col("saved_end") - F.col("saved_upto") + F.col("saved")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
        F.col("nth").alias("first"),
        "last",
    )
