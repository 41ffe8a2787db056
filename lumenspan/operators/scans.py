"""Running values in the order of a key, for keys that are too large for one task.

A window partitioned by a key alone puts the key into one task. Here rows are range
partitioned by key and order, so a key may span many ranges. Each range is reduced to one
summary a key, for the keys at its edges only (no others go on elsewhere); the summaries
of the ranges ahead are combined, at most two rows a range, and joined back.

Sums and last known values combine that way directly. Linear recurrences
``x = a * x_before + b`` combine as maps: blocks of rows are composed, the blocks of
blocks in turn, so that all work is in joins and short arrays.

Rows that tie in the order are told apart by their place in the input. A null key is a
key of its own; an empty table gives an empty one.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenspan.sources.shared import written

#: Rows of a range: so many at least where the session has partitions for them, and so many at most.
FEW_ROWS, MOST_ROWS = 1_000, 1_000_000
#: Rows whose maps are composed in one array.
BLOCK = 64


def ranged(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, parts: int | None = None) -> DataFrame:
    """The rows in ranges of (keys, order), written once, with ``part_`` and the tie breaker ``tie_``."""
    if parts is None:
        n_rows = df.count()
        width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        parts = max(math.ceil(n_rows / MOST_ROWS), min(width, math.ceil(n_rows / FEW_ROWS)), 1)
    sort = [*keys, *order, "tie_"]
    tied = df.withColumn("tie_", F.monotonically_increasing_id())
    return written(tied.repartitionByRange(parts, *sort).sortWithinPartitions(*sort).withColumn("part_", F.spark_partition_id()), name)


def _same(keys: Sequence[str], prefix: str) -> Column:
    return reduce(lambda x, y: x & y, (F.col(k).eqNullSafe(F.col(prefix + k)) for k in ("part_", *keys)))


def _pieces(rows: DataFrame, keys: Sequence[str], *aggregates: Column) -> DataFrame:
    """One summary for each range and key at the range's edge."""
    if not keys:
        return rows.groupBy("part_").agg(*aggregates)
    key = F.struct(*keys)
    edges = rows.groupBy("part_").agg(F.array_distinct(F.array(F.min(key), F.max(key))).alias("edge_")).select("part_", F.explode("edge_").alias("edge_"))
    edges = edges.select(F.col("part_").alias("edge_part_"), *(F.col("edge_")[k].alias(f"edge_{k}") for k in keys))
    return rows.join(edges, _same(keys, "edge_"), "left_semi").groupBy("part_", *keys).agg(*aggregates)


def _joined(rows: DataFrame, keys: Sequence[str], carried: DataFrame) -> DataFrame:
    named = carried.withColumnsRenamed({k: f"carry_{k}" for k in ("part_", *keys)})
    return rows.join(named, _same(keys, "carry_"), "left").drop(*(f"carry_{k}" for k in ("part_", *keys)))


def running_sums(df: DataFrame, keys: Sequence[str], order: Sequence[str], sums: Sequence[str], name: str, parts: int | None = None) -> DataFrame:
    """Add ``nth`` (place of the row in its key, from 1) and ``<column>_upto`` (sum up to and with the row) for each of ``sums``.

    Without keys the whole table is one sequence.
    """
    rows = ranged(df, keys, order, name, parts)
    pieces = _pieces(rows, keys, F.count("*").alias("n_"), *(F.sum(s).alias(f"sum_{s}_") for s in sums))
    ahead = Window.partitionBy(*keys).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    carried = pieces.select("part_", *keys, *(F.sum(c).over(ahead).alias(f"ahead_{c}") for c in ("n_", *(f"sum_{s}_" for s in sums))))
    within = Window.partitionBy("part_", *keys).orderBy(*order, "tie_").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    full = _joined(rows, keys, carried).withColumn("nth", F.row_number().over(within) + F.coalesce("ahead_n_", F.lit(0)))
    for s in sums:
        own = F.sum(s).over(within)
        full = full.withColumn(f"{s}_upto", F.when(own.isNotNull() | F.col(f"ahead_sum_{s}_").isNotNull(), F.coalesce(own, F.lit(0)) + F.coalesce(f"ahead_sum_{s}_", F.lit(0))))
    return full.drop("part_", "tie_", "ahead_n_", *(f"ahead_sum_{s}_" for s in sums))


def known_around(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str, parts: int | None = None) -> DataFrame:
    """Add ``before`` and ``after``: the last known ``value`` up to and with the row, and the first one from the row on.

    ``value`` may be a struct; null values are unknown.
    """
    rows = ranged(df, keys, order, name, parts)
    placed = F.when(F.col(value).isNotNull(), F.struct(*order, "tie_", F.col(value).alias("v")))
    pieces = _pieces(rows, keys, F.max(placed)["v"].alias("last_"), F.min(placed)["v"].alias("first_"))
    whole = Window.partitionBy(*keys).orderBy("part_")
    carried = pieces.select(
        "part_",
        *keys,
        F.last("last_", ignorenulls=True).over(whole.rowsBetween(Window.unboundedPreceding, -1)).alias("ahead_"),
        F.last("first_", ignorenulls=True).over(Window.partitionBy(*keys).orderBy(F.desc("part_")).rowsBetween(Window.unboundedPreceding, -1)).alias("behind_"),
    )
    forth = Window.partitionBy("part_", *keys).orderBy(*order, "tie_").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    back = Window.partitionBy("part_", *keys).orderBy(*(F.desc(c) for c in (*order, "tie_"))).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    full = _joined(rows, keys, carried)
    full = full.withColumn("before", F.coalesce(F.last(value, ignorenulls=True).over(forth), "ahead_")).withColumn("after", F.coalesce(F.last(value, ignorenulls=True).over(back), "behind_"))
    return full.drop("part_", "tie_", "ahead_", "behind_")


def _composed(maps: Column) -> Column:
    """One map (a, b) for maps applied one after the other."""
    return F.aggregate(maps, F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b")), lambda x, m: F.struct((m["a"] * x["a"]).alias("a"), (m["a"] * x["b"] + m["b"]).alias("b")))


def _scanned(rows: DataFrame, keys: Sequence[str], longest: int, name: str) -> DataFrame:
    """Add ``map_``, the maps (a_, b_) of a key composed from its first row up to and with the row at ``nth``."""
    inside = rows.withColumn("block_", F.floor((F.col("nth") - 1) / BLOCK).cast("long"))
    within = Window.partitionBy(*keys, "block_").orderBy("nth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = inside.withColumn("map_", _composed(F.collect_list(F.struct(F.col("a_").alias("a"), F.col("b_").alias("b"))).over(within)))
    if longest <= BLOCK:
        return inside.drop("block_")
    blocks = inside.groupBy(*keys, "block_").agg(F.max_by("map_", "nth").alias("whole_"))
    blocks = written(blocks.select(*keys, (F.col("block_") + 1).alias("nth"), F.col("whole_.a").alias("a_"), F.col("whole_.b").alias("b_")), name)
    ahead = _scanned(blocks, keys, math.ceil(longest / BLOCK), name)
    ahead = ahead.select(*(F.col(k).alias(f"carry_{k}") for k in keys), F.col("nth").alias("carry_block_"), F.col("map_").alias("ahead_"))
    on = reduce(lambda x, y: x & y, (F.col(k).eqNullSafe(F.col(f"carry_{k}")) for k in (*keys, "block_")))
    both = F.when(F.col("ahead_").isNull(), F.col("map_")).otherwise(_composed(F.array("ahead_", "map_")))
    full = inside.join(ahead, on, "left").withColumn("map_", both)
    return full.drop("block_", "ahead_", "carry_block_", *(f"carry_{k}" for k in keys))


def recurrence(df: DataFrame, keys: Sequence[str], order: Sequence[str], a: Column, b: Column, result: str, name: str, parts: int | None = None) -> DataFrame:
    """Add ``result``: x = a * x_before + b in the order of each key, starting from 0, and ``nth``.

    ``a`` and ``b`` may use ``nth``, the place of the row in its key. They must not be null.
    """
    numbered = running_sums(df, keys, order, [], name, parts)
    numbered = written(numbered.withColumn("a_", a.cast("double")).withColumn("b_", b.cast("double")), name)
    longest = numbered.agg(F.max("nth")).first()[0] or 0
    return _scanned(numbered, keys, longest, name).withColumn(result, F.col("map_.b")).drop("map_", "a_", "b_")


def exponential_mean(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, alpha: float, result: str, name: str, parts: int | None = None) -> DataFrame:
    """Add ``result``: the first value, then alpha * value + (1 - alpha) * the mean before."""
    first = F.col("nth") == 1
    return recurrence(df, keys, order, F.when(first, 0.0).otherwise(1 - alpha), F.when(first, F.col(value)).otherwise(alpha * F.col(value)), result, name, parts).drop("nth")
