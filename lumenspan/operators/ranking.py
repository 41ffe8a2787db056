"""Merging, clustering, ranking and selection of candidate intervals within streams."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenspan.operators.graph import components
from lumenspan.operators.temporal import band_join, fold_by, islands, opened, overlap_ratio
from lumenspan.sources.shared import written

IDEAL, LEAST_SCORE = 40.0, 0.3
#: Seconds between the middles of two candidates from which they count as wholly apart.
GAP = 30.0


def length() -> Column:
    return F.col("end_time") - F.col("start_time")


def merged_islands(candidates: DataFrame, gap: float = 0.0) -> DataFrame:
    """Overlapping or close intervals as one: hull, best score, count."""
    found = islands(candidates, ["stream_id"], "start_time", "end_time", "id", gap)
    return found.groupBy("stream_id", "island").agg(F.min("start_time").alias("start_time"), F.max("end_time").alias("end_time"), F.max("score").alias("score"), F.count("*").alias("n"))


def merged_in_order(candidates: DataFrame, gap: float = 10.0) -> DataFrame:
    """Neighbours merged where the gap to the end of the last merged interval is small.

    The end becomes that of the later interval even if it lies before the earlier one's,
    so a merged interval ends where the row before does, and a step back decides.
    """
    order = Window.partitionBy("stream_id").orderBy("start_time", "id")
    before = F.lag("end_time").over(order)
    opens = F.when(before.isNull() | (F.col("start_time") - before > gap), 1).otherwise(0)
    numbered = candidates.withColumn("opens_", opens).withColumn("island_", F.sum("opens_").over(order))
    place = F.struct("start_time", "id")
    return numbered.groupBy("stream_id", "island_").agg(F.min_by("id", place).alias("id"), F.min("start_time").alias("start_time"), F.max_by("end_time", place).alias("end_time"), F.max("score").alias("score"), F.count("*").alias("n")).drop("island_")


def merged_by_category(candidates: DataFrame, window: float = 5.0, least: float = 0.0) -> DataFrame:
    """Close neighbours of one category merged, confidence becoming the running mean of two.

    Nothing merges past a pause of more than ``window``, so each stretch between such pauses is walked by itself.
    """

    def step(state, row):
        if state is not None and row["category"] == state["category"] and row["start_time"] - state["end_time"] <= window:
            return {**state, "end_time": max(state["end_time"], row["end_time"]), "confidence": (state["confidence"] + row["confidence"]) / 2, "n": state["n"] + 1}, []
        return {**row, "n": 1}, [] if state is None else [state]

    kept = islands(candidates.select("stream_id", "id", "category", "start_time", "end_time", "confidence"), ["stream_id"], "start_time", "end_time", "id", window)
    schema = "stream_id long, id long, category string, start_time double, end_time double, confidence double, n long"
    return fold_by(kept, ["stream_id", "island"], ["start_time", "id"], step, schema, lambda s: [s]).where(F.col("confidence") >= least)


def temporal_clusters(candidates: DataFrame, least: float = 0.5) -> DataFrame:
    """``cluster``: a candidate joins the open cluster if it overlaps enough with (start of its last member, its furthest end).

    One that starts after every end so far joins nothing, so each island of overlapping
    candidates is walked by itself; its clusters are numbered behind those of the islands ahead.
    """

    def step(state, row):
        if state is None:
            return {"cluster": 0, "start": row["start_time"], "end": row["end_time"]}, [{**row, "cluster": 0}]
        inner = max(0.0, min(state["end"], row["end_time"]) - max(state["start"], row["start_time"]))
        hull = max(state["end"], row["end_time"]) - min(state["start"], row["start_time"])
        joins = hull > 0 and inner / hull >= least
        number = state["cluster"] + (not joins)
        end = max(state["end"], row["end_time"]) if joins else row["end_time"]
        return {"cluster": number, "start": row["start_time"], "end": end}, [{**row, "cluster": number}]

    kept = islands(candidates.select("stream_id", "id", "start_time", "end_time", "score", "confidence"), ["stream_id"], "start_time", "end_time", "id")
    schema = "stream_id long, island long, id long, start_time double, end_time double, score double, confidence double, cluster long"
    found = fold_by(kept, ["stream_id", "island"], ["start_time", "id"], step, schema)
    counts = found.groupBy("stream_id", "island").agg((F.max("cluster") + 1).alias("n_"))
    ahead = F.coalesce(F.sum("n_").over(Window.partitionBy("stream_id").orderBy("island").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = found.join(counts.withColumn("ahead_", ahead).drop("n_"), ["stream_id", "island"])
    return numbered.select("stream_id", "id", "start_time", "end_time", "score", "confidence", (F.col("cluster") + F.col("ahead_")).alias("cluster"))


def feature_clusters(candidates: DataFrame, features: list[str], least: float = 0.8, keys: tuple[str, ...] = ("stream_id",)) -> DataFrame:
    """``cluster``: a candidate joins the first leader whose direction is near enough, else it leads a new cluster.

    Candidates come by start; only the leaders' unit vectors are remembered, and as no
    two leaders are near each other, few features have few leaders.
    """

    def step(state, row):
        leaders = state if state is not None else []
        own = [row[f] or 0.0 for f in features]
        norm = math.sqrt(sum(x * x for x in own))
        unit = [x / norm if norm else 0.0 for x in own]
        for i, other in enumerate(leaders):
            if sum(a * b for a, b in zip(unit, other, strict=True)) >= least:
                return leaders, [{**{k: row[k] for k in keys}, "id": row["id"], "cluster": i}]
        return [*leaders, unit], [{**{k: row[k] for k in keys}, "id": row["id"], "cluster": len(leaders)}]

    kept = candidates.select(*keys, "id", "start_time", *features)
    kinds = ", ".join(f"{k} {kept.schema[k].dataType.simpleString()}" for k in keys)
    return fold_by(kept, list(keys), ["start_time", "id"], step, f"{kinds}, id long, cluster long")


def density_clusters(candidates: DataFrame, features: list[str], eps: float = 0.3) -> DataFrame:
    """``cluster``: candidates linked by steps of at most ``eps`` in standardised features; lone ones are clusters of their own.

    With two points to a dense place, density clusters are the components of these links,
    numbered by their smallest id. The first feature cuts the candidates into bands, so
    only neighbours meet.
    """
    stats = candidates.groupBy("stream_id").agg(*[F.avg(f).alias(f"m_{f}") for f in features], *[F.stddev_pop(f).alias(f"d_{f}") for f in features])
    z = [F.coalesce(F.try_divide(F.col(f) - F.col(f"m_{f}"), F.col(f"d_{f}")), F.lit(0.0)).alias(f"z{i}") for i, f in enumerate(features)]
    rows = written(candidates.join(stats, "stream_id").select("stream_id", "id", *z), "density-rows")
    other = rows.select("stream_id", F.col("id").alias("b"), *[F.col(f"z{i}").alias(f"y{i}") for i in range(len(features))])
    near = band_join(rows.withColumnRenamed("id", "a"), other, ["stream_id"], "z0", "y0", eps).where("a < b")
    apart = sum(((F.col(f"z{i}") - F.col(f"y{i}")) * (F.col(f"z{i}") - F.col(f"y{i}")) for i in range(len(features))), F.lit(0.0))
    labels = components(near.where(F.sqrt(apart) <= eps).select("a", "b"))
    return rows.select("stream_id", "id").join(labels, "id", "left").select("stream_id", "id", F.coalesce("component", "id").alias("cluster"))


def hybrid_clusters(candidates: DataFrame, features: list[str], most: int = 3) -> DataFrame:
    """Clusters by time; those with more than ``most`` members are divided by features and numbered behind the others by part."""
    timed = temporal_clusters(candidates).select("stream_id", "id", "cluster").withColumn("n", F.count("*").over(Window.partitionBy("stream_id", "cluster")))
    large = candidates.join(timed.where(F.col("n") > most).select("id", F.col("cluster").alias("time_cluster")), "id")
    parts = feature_clusters(large, features, keys=("stream_id", "time_cluster")).select("id", F.col("cluster").alias("part"))
    return timed.join(parts, "id", "left").select("stream_id", "id", "cluster", F.coalesce("part", F.lit(0)).alias("part"))


def clustered(candidates: DataFrame, method: str = "temporal", features: list[str] | None = None) -> DataFrame:
    """Rows (stream_id, id, cluster) by the named method."""
    features = features or ["score", "confidence"]
    if method == "feature":
        return feature_clusters(candidates, features)
    if method == "density":
        return density_clusters(candidates, ["start_time", "end_time", *features])
    if method == "hybrid":
        numbered = hybrid_clusters(candidates, features)
        return numbered.withColumn("cluster", F.dense_rank().over(Window.partitionBy("stream_id").orderBy("cluster", "part")).cast("long") - 1).drop("part")
    return temporal_clusters(candidates).select("stream_id", "id", "cluster")


def best_of_clusters(clustered: DataFrame) -> DataFrame:
    """Of each cluster the row with the highest product of score and confidence."""
    best = F.max_by(F.struct("id", "start_time", "end_time", "score", "confidence"), F.struct(F.col("score") * F.col("confidence"), -F.col("id")))
    return clustered.groupBy("stream_id", "cluster").agg(best.alias("x"), F.count("*").alias("n")).select("stream_id", "cluster", "x.*", "n")


def filter_candidates(candidates: DataFrame, score: float = LEAST_SCORE, shortest: float = 10.0, longest: float = 120.0) -> DataFrame:
    return candidates.where((F.col("score") >= score) & length().between(0.5 * shortest, 2 * longest))


def ranked(candidates: DataFrame, method: str = "score") -> DataFrame:
    """``rank_score`` and ``nth`` within the stream: by score and confidence, or by several criteria."""
    if method == "score":
        value = F.col("score") * F.col("confidence")
    else:
        value = 0.4 * F.col("score") + 0.3 * F.col("confidence") + 0.1 * F.greatest(F.lit(0.0), 1 - F.abs(length() - IDEAL) / IDEAL) + 0.05
    scored = candidates.withColumn("rank_score", F.round(value, 9))
    return scored.withColumn("nth", F.row_number().over(Window.partitionBy("stream_id").orderBy(F.desc("rank_score"), "id")))


def first_n(rows: DataFrame, n: int) -> DataFrame:
    return rows.where(F.col("nth") <= n)


def above_threshold(rows: DataFrame, most: int, fewest: int, score: float = LEAST_SCORE) -> DataFrame:
    """Up to ``most`` rows from ``score`` on, filled up to ``fewest`` with the best of the others."""
    order = Window.partitionBy("stream_id").orderBy(F.desc("passes"), "nth")
    placed = rows.withColumn("passes", F.col("score") >= score).withColumn("place", F.row_number().over(order))
    return placed.where((F.col("passes") & (F.col("place") <= most)) | (F.col("place") <= fewest))


def spread_in_time(candidates: DataFrame, gap: float = 30.0) -> DataFrame:
    """In order of time, candidates that start at least ``gap`` after the start of the last one kept."""
    kept = candidates.select("stream_id", "id", "start_time", "end_time", "score", "confidence")
    return opened(kept, ["stream_id"], "start_time", "id", gap).where("opens").drop("opened", "opens")


def chosen_in_turn(rows: DataFrame, most: int = 10, weight: float = 0.2, least: float | None = None) -> DataFrame:
    """Rows (stream_id, id, place, value) chosen one after another, each by its score and its mean distance to those before.

    Every round takes the best row of each stream by an aggregate and adds its distance
    to the others; rounds are written tables, so no stream is held in one task. With
    ``least`` a stream ends where the best value of a round doesn't exceed it. A weight of
    1 leaves the score out; the first one is then the best by ``nth``. Without features
    half of a distance is 0.5, the other half the gap of the middles up to thirty seconds.

    rows: (stream_id, id, score, middle, nth), nth being the place by rank.
    """
    apart = lambda a, b: (F.least(F.lit(1.0), F.abs(a - b) / GAP) + 0.5) / 2
    state, picked = rows.withColumn("apart_", F.lit(0.0)), None
    for place in range(1, most + 1):
        distance = F.lit(1.0) if place == 1 else F.col("apart_") / (place - 1)
        value = F.round((1 - weight) * F.col("score") + weight * distance, 9)
        best = state.groupBy("stream_id").agg(F.max_by(F.struct("id", "middle", value.alias("value")), F.struct(value, -F.col("nth"))).alias("x"))
        if least is not None and place > 1:
            best = best.where(F.col("x.value") > least)
        best = written(best.select("stream_id", F.col("x.id").alias("best_id_"), F.col("x.middle").alias("best_middle_"), F.col("x.value").alias("value_")), "chosen")
        some = best.select("stream_id", F.col("best_id_").alias("id"), F.lit(place).alias("place"), F.col("value_").alias("value"))
        picked = some if picked is None else picked.unionByName(some)
        if place < most:
            left = state.join(best, "stream_id").where("id <> best_id_")
            state = written(left.withColumn("apart_", F.col("apart_") + apart(F.col("middle"), F.col("best_middle_"))).select(*state.columns), "candidates")
    return picked


def _slim(ranked_rows: DataFrame) -> DataFrame:
    return ranked_rows.select("stream_id", "id", (F.col("score") * F.col("confidence")).alias("score"), ((F.col("start_time") + F.col("end_time")) / 2).alias("middle"), "nth")


def diverse(candidates: DataFrame, most: int = 10, weight: float = 0.2) -> DataFrame:
    """Greedy choice by score and distance to what is chosen, best first (``place`` from 1)."""
    return chosen_in_turn(_slim(ranked(candidates)), most, weight).select("stream_id", "id", "place")


def diverse_set(ranked_rows: DataFrame, most: int = 10, fewest: int = 1, least: float = 0.1) -> DataFrame:
    """The best row, then always the one furthest from those chosen, while it is far enough; filled up by rank to ``fewest``."""
    chosen = chosen_in_turn(_slim(ranked_rows), most, 1.0, least).select("stream_id", "id", "place")
    return filled(ranked_rows, chosen, fewest, F.col("nth"))


def filled(ranked_rows: DataFrame, chosen: DataFrame, upto: int, *order: Column) -> DataFrame:
    """``chosen`` and, where a stream has fewer than ``upto``, the first others by ``order``; ``place`` goes on."""
    have = chosen.groupBy("stream_id").agg(F.max("place").alias("have_"))
    others = ranked_rows.join(chosen.select("stream_id", "id"), ["stream_id", "id"], "left_anti").join(have, "stream_id")
    added = others.withColumn("place", F.col("have_") + F.row_number().over(Window.partitionBy("stream_id").orderBy(*order)))
    return chosen.unionByName(added.where(F.col("place") <= upto).select("stream_id", "id", "place"))


def quality_balanced(ranked_rows: DataFrame, most: int = 10) -> DataFrame:
    """The diverse set, filled up by score times confidence."""
    chosen = diverse_set(ranked_rows, most)
    return filled(ranked_rows, chosen, most, F.round(F.col("score") * F.col("confidence"), 9).desc(), F.col("id"))


def rank_candidates(candidates: DataFrame, method: str = "score") -> DataFrame:
    """Candidates with ``nth`` by the named method; the plain ones rank by score or by several criteria."""
    if method == "diversity":
        chosen = diverse(candidates).withColumnRenamed("place", "nth")
        return candidates.join(chosen, ["stream_id", "id"])
    return ranked(candidates, "criteria" if method in ("criteria", "preference") else "score")


def select_highlights(ranked_rows: DataFrame, strategy: str = "top", most: int = 10, fewest: int = 1) -> DataFrame:
    """Rows (stream_id, id) by the named strategy."""
    if strategy == "threshold":
        found = above_threshold(ranked_rows, most, fewest)
    elif strategy == "diverse":
        found = diverse_set(ranked_rows, most, fewest)
    elif strategy == "spread":
        found = spread_in_time(ranked_rows)
    elif strategy == "balanced":
        found = quality_balanced(ranked_rows, most)
    else:
        found = first_n(ranked_rows, most)
    return found.select("stream_id", "id")


def criteria_scores(candidates: DataFrame, features: list[str]) -> DataFrame:
    """``rank_score`` of score, confidence, length and mean distance in features to the others of the stream.

    The mean cosine with the others follows from the sum of the unit vectors, so no row
    meets another.
    """
    norm = F.sqrt(sum((F.col(f) * F.col(f) for f in features), F.lit(0.0)))
    unit = {f: F.coalesce(F.try_divide(F.col(f), norm), F.lit(0.0)) for f in features}
    rows = candidates.withColumns({f"u_{f}": u for f, u in unit.items()})
    sums = rows.groupBy("stream_id").agg(F.count("*").alias("n_"), *[F.sum(f"u_{f}").alias(f"s_{f}") for f in features])
    joined = rows.join(sums, "stream_id")
    others = sum((F.col(f"u_{f}") * (F.col(f"s_{f}") - F.col(f"u_{f}")) for f in features), F.lit(0.0))
    distance = F.when(F.col("n_") > 1, 1 - others / (F.col("n_") - 1)).otherwise(0.5)
    fit = F.greatest(F.lit(0.0), 1 - F.abs(length() - 45.0) / 45.0)
    score = 0.4 * F.col("score") + 0.3 * F.col("confidence") + 0.2 * fit + 0.1 * distance
    return joined.withColumn("rank_score", score).drop("n_", *[f"{p}_{f}" for p in "us" for f in features])


def selection_metrics(selected: DataFrame, originals: DataFrame) -> DataFrame:
    """Per stream: mean and spread of the scores, span of the middles against all candidates', gaps and overlaps of the pairs, confidences in three bins.

    ``selected`` is a top-k selection, so its pairs are few.
    """
    middle = (F.col("start_time") + F.col("end_time")) / 2
    left, right = selected.alias("a"), selected.alias("b")
    a0, a1, b0, b1 = (F.col(x) for x in ("a.start_time", "a.end_time", "b.start_time", "b.end_time"))
    pairs = left.join(right, (F.col("a.stream_id") == F.col("b.stream_id")) & (F.col("a.id") < F.col("b.id")))
    gap = F.least(F.lit(1.0), F.abs((a0 + a1) / 2 - (b0 + b1) / 2) / GAP)
    between = pairs.groupBy(F.col("a.stream_id").alias("stream_id")).agg(F.avg(gap).alias("diversity"), F.avg(overlap_ratio(a0, a1, b0, b1)).alias("overlap"))
    span = F.max(middle) - F.min(middle)
    whole = originals.groupBy("stream_id").agg(F.count("*").alias("candidates"), F.when(F.count("*") > 1, span).otherwise(1.0).alias("span_"))
    sure = F.col("confidence")
    own = selected.groupBy("stream_id").agg(
        F.count("*").alias("n"), F.avg("score").alias("mean_score"), F.var_pop("score").alias("var_score"), F.when(F.count("*") > 1, span).otherwise(0.0).alias("own_span_"),
        F.count_if(sure < 0.5).alias("low"), F.count_if((sure >= 0.5) & (sure < 0.8)).alias("medium"), F.count_if(sure >= 0.8).alias("high"),
    )
    joined = own.join(whole, "stream_id").join(between, "stream_id", "left").fillna(1.0, ["diversity"]).fillna(0.0, ["overlap"])
    covered = joined.withColumn("coverage", F.least(F.lit(1.0), F.col("own_span_") / F.greatest(F.lit(1.0), F.col("span_")))).drop("own_span_", "span_")
    quality = (F.col("mean_score") + 1 - F.least(F.lit(1.0), F.col("var_score")) + F.col("coverage") + F.col("diversity") + 1 - F.col("overlap")) / 5
    return covered.withColumn("quality", quality)
