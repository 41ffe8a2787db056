"""What several corpus operators share: durable tables, global prefix sums, word patterns."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenspan.sources.shared import fresh_path, written

__all__ = ["GAP", "SPACES", "WORD", "fresh_path", "materialize", "shuffle_partitions", "with_prefix", "word_count"]

#: White space between words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
#: Rows of a range of a global order: so many at least where there are enough partitions, and so many at most.
FEW_ROWS, MOST_ROWS = 1_000, 1_000_000


#: Write a table in the shared folder and read it back.
materialize = written


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def with_prefix(df: DataFrame, order: list[str], size: str, name: str, parts: int | None = None) -> DataFrame:
    """Add ``before`` (sum of ``size`` over the rows ahead) and ``position`` (rows ahead) in a global order.

    The rows are range-partitioned and written once; the sums of the partitions, one
    row each, are accumulated and joined back, so no task sees more than one range.
    Rows that tie in ``order`` are told apart by their place in the input, so a
    heavily repeated key is spread over several ranges. The number of ranges follows the
    rows: few for small tables, and more than the session's partitions for very large ones.
    """
    if parts is None:
        n_rows = df.count()
        parts = max(math.ceil(n_rows / MOST_ROWS), min(shuffle_partitions(df.sparkSession), math.ceil(n_rows / FEW_ROWS)), 1)
    keyed = df.withColumn("tie_", F.monotonically_increasing_id())
    keys = [*order, "tie_"]
    ranged = keyed.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("part_", F.spark_partition_id())
    rows = materialize(ranged, name)
    totals = rows.groupBy("part_").agg(F.sum(size).alias("bytes_"), F.count("*").alias("rows_"))
    ahead = Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        "part_",
        F.coalesce(F.sum("bytes_").over(ahead), F.lit(0)).alias("bytes_ahead_"),
        F.coalesce(F.sum("rows_").over(ahead), F.lit(0)).alias("rows_ahead_"),
    )
    within = Window.partitionBy("part_").orderBy(*keys).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        rows.withColumn("sum_", F.sum(size).over(within))
        .withColumn("nth_", F.row_number().over(within))
        .join(starts, "part_")
        .withColumn("before", F.col("bytes_ahead_") + F.col("sum_") - F.col(size))
        .withColumn("position", F.col("rows_ahead_") + F.col("nth_") - 1)
        .drop("part_", "tie_", "sum_", "nth_", "bytes_ahead_", "rows_ahead_")
    )
