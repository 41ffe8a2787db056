"""Joins, islands and folds along time: the shared core of alignment, smoothing and ranking."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType
from pyspark.sql.window import Window

from lumenspan.operators.scans import known_around


def overlap_seconds(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0))


def overlap_ratio(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Overlap of two intervals divided by their hull."""
    hull = F.greatest(a1, b1) - F.least(a0, b0)
    return F.when(hull > 0, overlap_seconds(a0, a1, b0, b1) / hull).otherwise(0.0)


def overlap_of_shorter(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    shorter = F.least(a1 - a0, b1 - b0)
    return F.when(shorter > 0, overlap_seconds(a0, a1, b0, b1) / shorter).otherwise(0.0)


def intersection(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """The common interval as a struct, or null."""
    start, end = F.greatest(a0, b0), F.least(a1, b1)
    return F.when(start < end, F.struct(start.alias("start_time"), end.alias("end_time")))


def band_join(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, to: str, width: float, strict: bool = False) -> DataFrame:
    """Pairs of rows with equal keys and times no more than ``width`` apart (less, if strict).

    Times are cut into buckets of that width and a left row is looked up in its own
    bucket and both neighbours, so the join is an equi-join on keys and bucket. A hot
    key is spread over its buckets.
    """
    bucket = lambda c: F.floor(F.col(c) / width).cast("long")
    spread = left.withColumn("bucket_", F.explode(F.array(*[bucket(at) + k for k in (-1, 0, 1)])))
    joined = spread.join(right.withColumn("bucket_", bucket(to)), [*keys, "bucket_"])
    apart = F.abs(F.col(at) - F.col(to))
    return joined.where(apart < width if strict else apart <= width).drop("bucket_")


def nearest(left: DataFrame, right: DataFrame, keys: Sequence[str], row: Sequence[str], at: str, to: str, tie: str, width: float, payload: Sequence[str], strict: bool = False) -> DataFrame:
    """Per left row (named by ``row``) the right row nearest in time within ``width``; ties go to the lowest ``tie``."""
    pairs = band_join(left, right, keys, at, to, width, strict)
    best = F.min(F.struct(F.abs(F.col(at) - F.col(to)).alias("apart"), F.col(tie), *[F.col(p) for p in payload if p != tie]))
    found = pairs.groupBy(*row).agg(best.alias("best_"))
    return found.select(*row, *[F.col(f"best_.{p}").alias(p) for p in payload])


def neighbours(grid: DataFrame, observed: DataFrame, keys: Sequence[str], at: str, payload: Sequence[str]) -> DataFrame:
    """Grid rows with ``prior`` (last observation up to the time) and ``later`` (first one after it) as structs."""
    seen = F.struct(F.col(at).alias("t"), *payload)
    extra = [c for c in grid.columns if c not in (*keys, at)]
    points = grid.select(*keys, at, *extra, F.lit(1).alias("grid_"), F.lit(None).cast(observed.select(seen.alias("s")).schema["s"].dataType).alias("seen_"))
    blank = [F.lit(None).cast(grid.schema[c].dataType).alias(c) for c in extra]
    both = points.unionByName(observed.select(*keys, at, *blank, F.lit(0).alias("grid_"), seen.alias("seen_")))
    # Ranges of key and time, so that a large key is many tasks.
    found = known_around(both, list(keys), [at, "grid_", "seen_"], "seen_", "neighbours")
    return found.where("grid_ = 1").withColumnsRenamed({"before": "prior", "after": "later"}).drop("grid_", "seen_")


def islands(df: DataFrame, keys: Sequence[str], start: str, end: str, tie: str, gap: float = 0.0) -> DataFrame:
    """``df`` with ``island``: intervals whose start lies within ``gap`` of the furthest end so far share a number."""
    order = Window.partitionBy(*keys).orderBy(start, tie)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(reach.isNull() | (F.col(start) > reach + gap), 1).otherwise(0)
    return df.withColumn("opens_", opens).withColumn("island", F.sum("opens_").over(order)).drop("opens_")


Step = Callable[[dict | None, dict], tuple[dict, list[dict]]]


def fold_by(df: DataFrame, keys: Sequence[str], order: Sequence[str], step: Step, schema: StructType | str, finish: Callable[[dict], list[dict]] | None = None) -> DataFrame:
    """Ordered folds that no window frame expresses, one for each key.

    ``step(state, row)`` gives the next state and the rows to emit; the state is None at
    the first row of a key, and ``finish(state)`` emits what is left at its end. Rows
    come sorted by Spark and are read in batches, so a key of any size needs only its
    state in memory.
    """
    dealt = df.repartition(*keys).sortWithinPartitions(*keys, *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, current = None, None
        for batch in batches:
            out: list[dict] = []
            for row in batch.to_pylist():
                key = tuple(row[k] for k in keys)
                if key != current:
                    if finish and state is not None:
                        out += finish(state)
                    state, current = None, key
                state, emitted = step(state, row)
                out += emitted
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)
        if finish and state is not None and (rest := finish(state)):
            yield pa.RecordBatch.from_pylist(rest, schema=arrow)

    if isinstance(schema, str):
        schema = StructType.fromDDL(schema)
    arrow = to_arrow_schema(schema)
    return dealt.mapInArrow(run, schema)


def opened(df: DataFrame, keys: Sequence[str], at: str, tie: str, width: float, strict: bool = False) -> DataFrame:
    """``df`` with ``opened`` and ``opens``: windows that open with a row and close when one comes ``width`` or more after it (more, if strict).

    Where a window opens depends on the one before, so the rows of a key are read in
    order of time, in batches; from one opening to the next the times are searched, and
    only the last opening is carried between batches.
    """
    dealt = df.repartition(*keys).sortWithinPartitions(*keys, at, tie)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, start = None, 0.0
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
            times = batch.column(batch.schema.get_field_index(at)).to_numpy()
            n = len(times)
            changed = np.zeros(n, dtype=bool)
            for c in columns:
                changed[1:] |= c[1:] != c[:-1]
            found, opens = np.empty(n), np.zeros(n, dtype=bool)
            for lo, hi in zip([0, *np.flatnonzero(changed)], [*np.flatnonzero(changed), n], strict=True):
                if lo == hi:
                    continue
                key = tuple(c[lo] for c in columns)
                i = lo
                if key != current:
                    current, start, opens[lo] = key, times[lo], True
                while i < hi:
                    end = i + int(np.searchsorted(times[i:hi] - start, width, side="right" if strict else "left"))
                    found[i:end] = start
                    if end < hi:
                        start, opens[end] = times[end], True
                    i = end
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found), pa.array(opens)], names=[*batch.schema.names, "opened", "opens"])

    schema = StructType([*df.schema.fields, StructField("opened", DoubleType()), StructField("opens", BooleanType())])
    return dealt.mapInArrow(run, schema)
