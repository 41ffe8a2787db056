"""Clusters of candidate intervals by Ward linkage, cut at a distance.

The distance of two candidates is the mean of 1 - overlap ratio and 1 - cosine of their
features. If all distances between two groups are above the cut, no cluster of one merges
with a cluster of the other below it: by the update of Lance and Williams a merged cluster
stays at least as far. So the candidates are first split into the components of pairs
within the cut, which are found by a join on length and start, and each component is
linked by itself, many to a task.

Within a component chains of nearest neighbours are followed. Distances are computed from
the candidates when they are needed, a row at a time, and distances of clusters follow
from the mean squared distances between and within them; so a component needs memory in
proportion to its candidates.

Defined results: candidates without length have no overlap and stay alone; null features count as 0, and without any feature but 0 the cosine
part is 0.5; the number of a cluster is its smallest id.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenspan.operators.graph import components
from lumenspan.sources.shared import written

CUT = 0.3


def distance(start: Column, end: Column, unit: list[Column], other_start: Column, other_end: Column, other_unit: list[Column]) -> Column:
    hull = F.greatest(end, other_end) - F.least(start, other_start)
    shared = F.greatest(F.lit(0.0), F.least(end, other_end) - F.greatest(start, other_start))
    overlap = F.when(hull > 0, shared / hull).otherwise(0.0)
    return (1 - overlap + _apart(unit, other_unit)) / 2


def _apart(unit: list[Column], other: list[Column]) -> Column:
    """1 - cosine of unit vectors; 0.5 if one has no direction."""
    dot = sum((a * b for a, b in zip(unit, other, strict=True)), F.lit(0.0))
    return F.when(dot.isNull(), 0.5).otherwise(1 - dot)


def near_pairs(rows: DataFrame, n_features: int, cut: float) -> DataFrame:
    """Pairs (a, b) of ids within the cut.

    They overlap by at least ``1 - 2 * cut`` of their hull, if their features are alike, so
    neither is much longer than the other, and they start within the longer one's length:
    the longer one is met in buckets of that length.
    """
    least = 1 - 2 * cut
    steps = int(np.floor(np.log2(1 / least))) + 1 if least > 0 else None
    if steps is None:
        raise ValueError("a cut from 0.5 up would link intervals that don't overlap")
    size = F.floor(F.log2(F.col("end_time") - F.col("start_time"))).cast("int")
    sized = rows.where("end_time > start_time").withColumn("size_", size)
    width = F.pow(F.lit(2.0), F.col("size_") + 1)
    longer = sized.withColumn("bucket_", F.floor(F.col("start_time") / width).cast("long"))
    renamed = longer.select("stream_id", "size_", "bucket_", F.col("id").alias("b"), F.col("start_time").alias("s2"), F.col("end_time").alias("e2"), *(F.col(f"u{i}").alias(f"v{i}") for i in range(n_features)))
    shorter = sized.withColumn("size_", F.explode(F.transform(F.sequence(F.lit(0), F.lit(steps)), lambda k: F.col("size_") + k)))
    shorter = shorter.withColumn("bucket_", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda k: F.floor(F.col("start_time") / width).cast("long") + k)))
    met = shorter.withColumnRenamed("id", "a").join(renamed, ["stream_id", "size_", "bucket_"]).where("a <> b")
    units = ([F.col(f"u{i}") for i in range(n_features)], [F.col(f"v{i}") for i in range(n_features)])
    apart = distance(F.col("start_time"), F.col("end_time"), units[0], F.col("s2"), F.col("e2"), units[1])
    return met.where(apart <= cut + 1e-12).select("a", "b")


def _row(i: np.ndarray, start: np.ndarray, end: np.ndarray, unit: np.ndarray) -> np.ndarray:
    """Squared distances from some candidates to all."""
    hull = np.maximum(end[i, None], end) - np.minimum(start[i, None], start)
    shared = np.maximum(0.0, np.minimum(end[i, None], end) - np.maximum(start[i, None], start))
    overlap = np.divide(shared, hull, out=np.zeros_like(hull), where=hull > 0)
    dot = unit[i] @ unit.T
    return ((1 - overlap + np.where(np.isnan(dot), 0.5, 1 - dot)) / 2) ** 2


def linked(start: np.ndarray, end: np.ndarray, unit: np.ndarray, cut: float = CUT) -> np.ndarray:
    """The cluster (its first member's place) of each candidate."""
    n = len(start)
    label = np.arange(n)
    members = {i: np.array([i]) for i in range(n)}
    within = np.zeros(n)  # sum of squared distances of the pairs of a cluster
    active = set(range(n))
    chain: list[int] = []

    def distances(c: int) -> tuple[np.ndarray, np.ndarray]:
        """From a cluster to all others, by label: squared distances, and sums of those of their members."""
        mine = members[c]
        cross = np.zeros(n)
        for at in range(0, len(mine), 64):
            cross += _row(mine[at : at + 64], start, end, unit).sum(axis=0)
        by = np.bincount(label, weights=cross, minlength=n)
        size = np.bincount(label, minlength=n)
        size_ = np.maximum(size, 1)
        m = len(mine)
        found = 2 * m * size_ / (m + size_) * (by / (m * size_) - within[c] / m**2 - within / size_**2)
        found[(size == 0) | ~alive] = np.inf
        found[c] = np.inf
        return found, by

    alive = np.ones(n, dtype=bool)
    while active:
        if not chain:
            chain.append(min(active))
        c = chain[-1]
        found, cross = distances(c)
        nearest = int(found.argmin())
        if len(chain) > 1 and found[chain[-2]] <= found[nearest]:
            nearest = chain[-2]
        if not np.isfinite(found[nearest]) or found[nearest] > (cut + 1e-12) ** 2:
            # Nothing ever comes nearer to this one, so it is done.
            active.discard(c)
            alive[c] = False
            chain.pop()
        elif len(chain) > 1 and nearest == chain[-2]:
            a, b = min(c, nearest), max(c, nearest)
            within[a] += within[b] + cross[nearest]
            members[a] = np.concatenate((members[a], members.pop(b)))
            label[members[a]] = a
            active.discard(b)
            alive[b] = False
            chain = chain[:-2]
        else:
            chain.append(nearest)
    return label


def _link_group(n_features: int, cut: float, table: pa.Table) -> pa.Table:
    table = table.sort_by("id")
    ids = table.column("id").to_numpy()
    unit = np.stack([table.column(f"u{i}").to_numpy(zero_copy_only=False).astype(float) for i in range(n_features)], axis=1) if n_features else np.full((len(ids), 1), np.nan)
    label = linked(table.column("start_time").to_numpy(), table.column("end_time").to_numpy(), unit, cut)
    return pa.table({"stream_id": table.column("stream_id"), "id": table.column("id"), "cluster": ids[label]})


def ward_clusters(candidates: DataFrame, features: list[str], cut: float = CUT) -> DataFrame:
    """Rows (stream_id, id, cluster): the clusters of each stream that merge within the cut."""
    norm = F.sqrt(sum((F.pow(F.coalesce(f, F.lit(0.0)), F.lit(2)) for f in features), F.lit(0.0)))
    units = [F.try_divide(F.coalesce(f, F.lit(0.0)), norm).alias(f"u{i}") for i, f in enumerate(features)]
    rows = written(candidates.select("stream_id", "id", "start_time", "end_time", *units), "ward-rows")
    labels = components(near_pairs(rows, len(features), cut))
    met = rows.join(labels, "id")
    found = met.groupBy("component").applyInArrow(lambda t: _link_group(len(features), cut, t), "stream_id long, id long, cluster long")
    return rows.join(written(found, "ward-found").select("id", "cluster"), "id", "left").select("stream_id", "id", F.coalesce("cluster", "id").alias("cluster"))
