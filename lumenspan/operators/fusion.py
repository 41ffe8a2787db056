"""Alignment of several modalities in time, their weighted fusion, and clean-up of the candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenspan.operators.series import moving_average, time_correlation
from lumenspan.operators.temporal import band_join, islands, neighbours

MODALITIES = ("video", "audio", "chat")
CORE = ("video", "audio")
#: Fixed default weights; video and audio are normalised, chat is a bonus.
WEIGHTS = {"video": 0.4, "audio": 0.3, "chat": 0.3}
HALF = 15.0


# ---- alignment -------------------------------------------------------------------------


def grid_of(detections: DataFrame) -> DataFrame:
    """The distinct times of a stream, once for each modality."""
    times = detections.select("stream_id", F.col("t").alias("moment")).distinct()
    return times.withColumn("modality", F.explode(F.array(*[F.lit(m) for m in MODALITIES])))


def align_strict(detections: DataFrame, width: float = 0.1) -> DataFrame:
    """Per time and modality the earliest-listed observation less than ``width`` away."""
    pairs = band_join(grid_of(detections), detections, ["stream_id", "modality"], "moment", "t", width, strict=True)
    first = pairs.groupBy("stream_id", "moment", "modality").agg(F.min(F.struct("seq", "score", "confidence")).alias("x"))
    return first.select("stream_id", "moment", "modality", "x.seq", "x.score", "x.confidence")


def aligned_wide(detections: DataFrame, width: float = 5.0) -> DataFrame:
    """Per time of a stream the nearest observation of each modality within ``width``, as structs (seq, score, confidence); the earlier-listed wins ties.

    The nearest one is the last up to the time or the first after it, in the bucket of
    ``width`` seconds or at the edge of the next ones; no pairs are made.
    """
    best = lambda m: F.min(F.when(F.col("modality") == m, F.struct("seq", "score", "confidence"))).alias(m)
    moments = detections.where("stream_id IS NOT NULL AND t IS NOT NULL").groupBy("stream_id", F.col("t").alias("moment")).agg(*[best(m) for m in MODALITIES])
    placed = moments.withColumn("bucket_", F.floor(F.col("moment") / width).cast("long"))
    seen = {m: F.when(F.col(m).isNotNull(), F.struct("moment", m)) for m in MODALITIES}
    ends = placed.groupBy("stream_id", "bucket_").agg(*[f(x).alias(f"{n}_{m}_") for m, x in seen.items() for n, f in (("last", F.max), ("first", F.min))])
    beside = lambda side, k: ends.select("stream_id", (F.col("bucket_") + k).alias("bucket_"), *[F.col(f"{side}_{m}_") for m in MODALITIES])
    full = placed.join(beside("last", 1), ["stream_id", "bucket_"], "left").join(beside("first", -1), ["stream_id", "bucket_"], "left")
    order = Window.partitionBy("stream_id", "bucket_").orderBy("moment")
    before, after = order.rowsBetween(Window.unboundedPreceding, Window.currentRow), Window.partitionBy("stream_id", "bucket_").orderBy(F.desc("moment")).rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def nearest_of(m: str) -> Column:
        sides = (F.coalesce(F.last(seen[m], ignorenulls=True).over(before), f"last_{m}_"), F.coalesce(F.last(seen[m], ignorenulls=True).over(after), f"first_{m}_"))
        away = [F.abs(F.col("moment") - x["moment"]) for x in sides]
        # Null where there is none, so that the least of both skips it.
        return F.least(*[F.when(d <= width, F.struct(d.alias("apart"), x[m]["seq"].alias("seq"), x[m]["score"].alias("score"), x[m]["confidence"].alias("confidence"))) for d, x in zip(away, sides, strict=True)])

    found = full.select("stream_id", "moment", *[nearest_of(m).alias(m) for m in MODALITIES])
    return found.select("stream_id", "moment", *[F.when(F.col(m).isNotNull(), F.col(m).dropFields("apart")).alias(m) for m in MODALITIES])


def align_window(detections: DataFrame, width: float = 5.0) -> DataFrame:
    """Per time and modality the nearest observation within ``width``; the earlier-listed wins ties."""
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("modality"), F.col(m).alias("x")) for m in MODALITIES])).alias("y")
    found = aligned_wide(detections, width).select("stream_id", "moment", each).where("y.x IS NOT NULL")
    return found.select("stream_id", "moment", "y.modality", "y.x.seq", "y.x.score", "y.x.confidence")


def interpolated(detections: DataFrame, most: float = 10.0) -> DataFrame:
    """Per time and modality a score blended from the observations before and after.

    Confidence is damped to 0.8; where the two are more than ``most`` apart there is no
    row; where only one side exists, both numbers are halved.
    """
    found = neighbours(grid_of(detections).withColumnRenamed("moment", "t"), detections, ["stream_id", "modality"], "t", ["score", "confidence"])
    a, b, t = F.col("prior"), F.col("later"), F.col("t")
    part = (t - a["t"]) / (b["t"] - a["t"])
    blend = lambda n, k: (a[n] + (b[n] - a[n]) * part) * k
    both = a.isNotNull() & b.isNotNull()
    one = F.coalesce(a, b)
    rows = found.where(F.coalesce(a["t"], b["t"]).isNotNull()).where(~both | (b["t"] - a["t"] <= most))
    return rows.select(
        "stream_id", F.col("t").alias("moment"), "modality",
        F.when(both, blend("score", 1.0)).otherwise(one["score"] * 0.5).alias("score"),
        F.when(both, blend("confidence", 0.8)).otherwise(one["confidence"] * 0.5).alias("confidence"),
    )


def align_interpolated(detections: DataFrame, width: float = 5.0) -> DataFrame:
    """Nearest within ``width``, and blended scores where a modality has none."""
    exact = align_window(detections, width).select("stream_id", "moment", "modality", "score", "confidence", F.lit(False).alias("blended"))
    filled = interpolated(detections).join(exact, ["stream_id", "moment", "modality"], "left_anti").withColumn("blended", F.lit(True))
    return exact.unionByName(filled)


# ---- fusion ----------------------------------------------------------------------------


def pivoted(aligned: DataFrame) -> DataFrame:
    """One row for each stream and time, with score and confidence columns of each modality."""
    pick = lambda m, c: F.max(F.when(F.col("modality") == m, F.col(c))).alias(f"{m}_{c}")
    return aligned.groupBy("stream_id", "moment").agg(*[pick(m, c) for m in MODALITIES for c in ("score", "confidence")])


def pivoted_window(detections: DataFrame, width: float = 5.0) -> DataFrame:
    """``pivoted(align_window(detections, width))`` without a shuffle of its own."""
    return aligned_wide(detections, width).select("stream_id", "moment", *[F.col(f"{m}.{c}").alias(f"{m}_{c}") for m in MODALITIES for c in ("score", "confidence")])


def _present(m: str, least: float) -> Column:
    return F.col(f"{m}_score").isNotNull() & (F.col(f"{m}_confidence") >= least)


def _sum(columns: list[Column]) -> Column:
    return sum(columns[1:], columns[0])


def penalised(score: Column, modalities: tuple[str, ...] = CORE) -> Column:
    """Less for each missing modality, and for a mean confidence under one half."""
    missing = _sum([F.col(f"{m}_score").isNull().cast("int") for m in modalities])
    there = _sum([F.coalesce(F.col(f"{m}_confidence"), F.lit(0.0)) for m in MODALITIES])
    mean = F.try_divide(there, _sum([F.col(f"{m}_score").isNotNull().cast("int") for m in MODALITIES]))
    doubt = F.when(mean < 0.5, 1 - 0.5 * (0.5 - mean)).otherwise(1.0)
    return score * (1 - 0.2 * missing) * doubt


def agreement(least: float = 0.1) -> Column:
    """One less the mean deviation of the core scores from their mean."""
    n = _sum([_present(m, least).cast("int") for m in CORE])
    mean = F.try_divide(_sum([F.when(_present(m, least), F.col(f"{m}_score")).otherwise(0.0) for m in CORE]), n)
    off = _sum([F.when(_present(m, least), F.abs(F.col(f"{m}_score") - mean)).otherwise(0.0) for m in CORE])
    return 1 - F.try_divide(off, n)


def fuse(wide: DataFrame, weights: dict[str, float] | None = None, by_confidence: bool = False, least: float = 0.1) -> DataFrame:
    """Weighted mean of the core modalities plus a chat bonus, as candidates of 30 seconds.

    With ``by_confidence`` the weights, the bonus included, are multiplied by confidence.
    """
    weights = weights or WEIGHTS
    core = sum(weights[m] for m in CORE)
    factor = lambda m: F.lit(weights[m] / core) * (F.col(f"{m}_confidence") if by_confidence else F.lit(1.0))
    total = _sum([F.when(_present(m, least), factor(m)).otherwise(0.0) for m in CORE])
    mean = F.try_divide(_sum([F.when(_present(m, least), factor(m) * F.col(f"{m}_score")).otherwise(0.0) for m in CORE]), total)
    bonus = F.col("chat_score") * weights["chat"] * (F.col("chat_confidence") if by_confidence else F.lit(1.0))
    raw = F.when(total > 0, F.least(F.lit(1.0), mean + F.when(_present("chat", least), bonus).otherwise(0.0)))
    scored = wide.withColumn("score", penalised(raw)).withColumn("confidence", agreement(least)).where("score IS NOT NULL")
    return scored.withColumn("start_time", F.greatest(F.col("moment") - HALF, F.lit(0.0))).withColumn("end_time", F.col("moment") + HALF)


def filter_fused(fused: DataFrame, score: float = 0.2, confidence: float = 0.3, both_core: bool = False) -> DataFrame:
    kept = fused.where((F.col("score") >= score) & (F.col("confidence") >= confidence))
    return kept.where(F.col("video_score").isNotNull() & F.col("audio_score").isNotNull()) if both_core else kept


def correlations(wide: DataFrame) -> DataFrame:
    """Pearson correlation of each pair of modalities by stream, 0 where undefined or under three times."""
    pairs = [(a, b) for i, a in enumerate(MODALITIES) for b in MODALITIES[i + 1 :]]
    made = []
    for a, b in pairs:
        both = F.col(f"{a}_score").isNotNull() & F.col(f"{b}_score").isNotNull()
        x, y = F.when(both, F.col(f"{a}_score")), F.when(both, F.col(f"{b}_score"))
        made.append(F.when(F.count(x) >= 3, F.coalesce(F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)), F.lit(0.0))).otherwise(0.0).alias(f"{a}_{b}"))
    return wide.groupBy("stream_id").agg(*made)


PAIRS = tuple((a, b) for i, a in enumerate(MODALITIES) for b in MODALITIES[i + 1 :])
#: Video and audio normalised over both, chat as it is.
NORMALIZED = {m: WEIGHTS[m] / sum(WEIGHTS[c] for c in CORE) if m in CORE else WEIGHTS[m] for m in MODALITIES}


def combined_correlations(wide: DataFrame, width: float = 30.0) -> DataFrame:
    """Per stream and pair the mean of the scores' correlation and of the first one's with time; 0 under three times or where undefined."""
    some = [F.struct(F.lit(f"{a}_{b}").alias("pair"), F.col(f"{a}_score").alias("v"), F.col(f"{b}_score").alias("w")) for a, b in PAIRS]
    rows = wide.select("stream_id", F.col("moment").alias("t"), F.explode(F.array(*some)).alias("x")).select("stream_id", "x.pair", "t", "x.v", "x.w").where("v IS NOT NULL AND w IS NOT NULL")
    pearson = F.try_divide(F.covar_pop("v", "w"), F.stddev_pop("v") * F.stddev_pop("w"))
    between = rows.groupBy("stream_id", "pair").agg(F.when(F.count("*") >= 3, pearson).alias("r"))
    joined = between.join(time_correlation(rows, width, ("stream_id", "pair")), ["stream_id", "pair"], "left")
    value = F.coalesce((F.col("r") + F.coalesce("correlation", F.lit(0.0))) / 2, F.lit(0.0))
    per = joined.groupBy("stream_id").agg(*[F.max(F.when(F.col("pair") == f"{a}_{b}", value)).alias(f"{a}_{b}") for a, b in PAIRS])
    return per.fillna(0.0, [f"{a}_{b}" for a, b in PAIRS])


def _with(m: str) -> list[Column]:
    return [F.col(f"{a}_{b}") for a, b in PAIRS if m in (a, b)]


def adapted_weights(corr: DataFrame, rate: float = 0.1, threshold: float = 0.3) -> DataFrame:
    """Weights moved by the mean of the correlations above the threshold less one half, within 0 and 1, normalised over all three.

    A modality without such a correlation keeps its weight before the normalisation.
    """
    moved = {}
    for m in MODALITIES:
        n = _sum([(c > threshold).cast("int") for c in _with(m)])
        mean = F.try_divide(_sum([F.when(c > threshold, c).otherwise(0.0) for c in _with(m)]), n)
        moved[m] = F.when(n > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), NORMALIZED[m] + rate * (mean - 0.5)))).otherwise(NORMALIZED[m])
    total = _sum(list(moved.values()))
    return corr.select("stream_id", *[(moved[m] / total).alias(f"w_{m}") for m in MODALITIES])


def _consistency(least: float = 0.1) -> Column:
    """One less the mean deviation of the confidences that count."""
    n = _sum([_present(m, least).cast("int") for m in MODALITIES])
    mean = F.try_divide(_sum([F.when(_present(m, least), F.col(f"{m}_confidence")).otherwise(0.0) for m in MODALITIES]), n)
    return 1 - F.try_divide(_sum([F.when(_present(m, least), F.abs(F.col(f"{m}_confidence") - mean)).otherwise(0.0) for m in MODALITIES]), n)


def _candidates(scored: DataFrame) -> DataFrame:
    return scored.where("score IS NOT NULL").withColumn("score", F.least(F.lit(1.0), "score")).withColumn("start_time", F.col("moment") - HALF).withColumn("end_time", F.col("moment") + HALF)


def fuse_adaptive(wide: DataFrame, weights: DataFrame, least: float = 0.1) -> DataFrame:
    """Fusion with the adapted weights of the stream: the mean of the core, a bonus for chat."""
    joined = wide.join(weights, "stream_id")
    pick = lambda m, c: F.when(_present(m, least), c).otherwise(0.0)
    total = _sum([pick(m, F.col(f"w_{m}")) for m in CORE])
    mean = _sum([pick(m, F.col(f"w_{m}") * F.col(f"{m}_score")) for m in CORE]) / total
    raw = F.when(total > 0, F.when(_present("chat", least), F.least(F.lit(1.0), mean + F.col("chat_score") * F.col("w_chat"))).otherwise(mean))
    return _candidates(joined.withColumn("score", penalised(raw)).withColumn("confidence", _consistency(least)))


def fuse_by_correlation(wide: DataFrame, corr: DataFrame, least: float = 0.1) -> DataFrame:
    """Fusion with weights raised by the mean positive correlation with the other modalities present."""
    joined = wide.join(corr, "stream_id")
    there = lambda m: F.col(f"{m}_score").isNotNull()
    factor = {}
    for m in MODALITIES:
        others = [(o, F.col("_".join(p))) for p in PAIRS if m in p for o in p if o != m]
        n = _sum([there(o).cast("int") for o, _ in others])
        positive = _sum([F.when(there(o), F.greatest(F.lit(0.0), c)).otherwise(0.0) for o, c in others])
        factor[m] = NORMALIZED[m] * (1 + F.coalesce(F.try_divide(positive, n), F.lit(0.0)))
    pick = lambda m, c: F.when(_present(m, least), c).otherwise(0.0)
    total = _sum([pick(m, factor[m]) for m in MODALITIES])
    raw = F.when(total > 0, _sum([pick(m, factor[m] * F.col(f"{m}_score")) for m in MODALITIES]) / total)
    return _candidates(joined.withColumn("score", penalised(raw, MODALITIES)).withColumn("confidence", _consistency(least)))


def fused(wide: DataFrame, method: str = "weighted") -> DataFrame:
    """Candidates by the named method of fusion."""
    if method in ("adaptive", "learned"):
        return fuse_adaptive(wide, adapted_weights(combined_correlations(wide)))
    if method == "correlation":
        return fuse_by_correlation(wide, combined_correlations(wide))
    return fuse(wide, by_confidence=method == "confidence")


def multimodal(wide: DataFrame, score: float = 0.6, confidence: float = 0.5) -> DataFrame:
    """Weighted mean of the modalities present, mean confidence, and whether both reach the limits."""
    there = lambda m: F.col(f"{m}_score").isNotNull()
    total = _sum([F.when(there(m), WEIGHTS[m]).otherwise(0.0) for m in MODALITIES])
    mean = _sum([F.when(there(m), WEIGHTS[m] * F.col(f"{m}_score")).otherwise(0.0) for m in MODALITIES]) / total
    n = _sum([there(m).cast("int") for m in MODALITIES])
    sure = _sum([F.coalesce(F.col(f"{m}_confidence"), F.lit(0.0)) for m in MODALITIES]) / n
    found = wide.withColumn("score", mean).withColumn("confidence", sure)
    return found.withColumn("is_highlight", (F.col("score") >= score) & (F.col("confidence") >= confidence))


# ---- segments of several detectors -------------------------------------------------------


def fused_segments(results: DataFrame) -> DataFrame:
    """Overlapping results of all modalities as one: hull, weighted confidences added up, the last result of each modality.

    results: (stream_id, modality, seq, start_time, end_time, confidence); the names of the
    last results are ``video``, ``audio`` and ``chat``, null without one.
    """
    table = F.create_map(*[F.lit(x) for m in MODALITIES for x in (m, WEIGHTS[m])])
    weighed = results.withColumn("weighted", F.col("confidence") * F.element_at(table, F.col("modality")))
    found = islands(weighed, ["stream_id"], "start_time", "end_time", "seq")
    last = lambda m: F.max_by("seq", F.when(F.col("modality") == m, F.struct("start_time", "seq"))).alias(m)
    return found.groupBy("stream_id", "island").agg(
        F.min("start_time").alias("start_time"), F.max("end_time").alias("end_time"), F.sum("weighted").alias("weighted"), F.count("*").alias("n"), *[last(m) for m in MODALITIES]
    )


# Fixed titles.
TITLES = {
    "gameplay": "Epic Gameplay Moment", "reaction": "Streamer Reaction", "funny": "Hilarious Moment", "emotional": "Emotional Scene", "climactic": "Climactic Moment", "custom": "Stream Highlight",
}


def highlight_type(video: Column, audio: Column, chat: Column) -> Column:
    """The type by what video, audio and chat show, in this order."""
    return F.when(video.isin("gameplay", "reaction"), video).when(audio.isin("funny", "emotional"), audio).when(chat == "excitement", "climactic").otherwise("custom")


def highlight_title(kind: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in TITLES.items() for x in pair]), kind)


def merged_pair(a: Column, b: Column) -> Column:
    """Two highlights (structs) as one: the first one's identity, the later end, the best confidence, means where both are known."""
    mean = lambda c: F.when(a[c].isNotNull() & b[c].isNotNull(), (a[c] + b[c]) / 2).otherwise(F.coalesce(a[c], b[c]))
    return F.struct(
        a["id"].alias("id"), a["start_time"].alias("start_time"), b["end_time"].alias("end_time"), F.greatest(a["confidence_score"], b["confidence_score"]).alias("confidence_score"),
        a["highlight_type"].alias("highlight_type"), a["title"].alias("title"), F.slice(F.array_sort(F.array_union(a["tags"], b["tags"])), 1, 10).alias("tags"),
        F.btrim(F.concat_ws(" ", a["description"], b["description"])).alias("description"), mean("sentiment_score").alias("sentiment_score"), mean("viewer_engagement").alias("viewer_engagement"),
    )


# ---- clean-up --------------------------------------------------------------------------


def refine_by_context(candidates: DataFrame, width: float = 60.0, blend: float = 0.15) -> DataFrame:
    """Scores drawn towards the distance-weighted mean of other candidates within ``width``, and how far these agree."""
    mid = (F.col("start_time") + F.col("end_time")) / 2
    own = candidates.withColumn("mid", mid)
    other = own.select("stream_id", F.col("id").alias("other_id"), F.col("mid").alias("other_mid"), F.col("score").alias("other_score"))
    pairs = band_join(own, other, ["stream_id"], "mid", "other_mid", width).where("id <> other_id")
    # Divided, not multiplied by a rounded weight: where all scores are equal, so are the digits of SQL's mean.
    away = 1 + F.abs(F.col("mid") - F.col("other_mid")) / 10
    context = pairs.groupBy("id").agg((F.sum(F.col("other_score") / away) / F.sum(1 / away)).alias("context"), F.var_pop("other_score").alias("spread"), F.count("*").alias("n_near"))
    joined = own.join(context, "id", "left")
    return joined.withColumn("refined", F.coalesce((1 - blend) * F.col("score") + blend * F.col("context"), "score")).withColumn("agreement", 1 - F.least(F.lit(1.0), F.coalesce("spread", F.lit(0.0)))).withColumn("n_near", F.coalesce("n_near", F.lit(0)))


def final_filter(candidates: DataFrame, least: float = 0.1) -> DataFrame:
    """Per stream, scores from ``least`` on; of more than three, those within two deviations; all, if none would stay."""
    kept = candidates.where(F.col("score") >= least)
    all_ = Window.partitionBy("stream_id")
    z = F.abs(F.col("score") - F.avg("score").over(all_)) / F.greatest(F.lit(0.1), F.stddev_pop("score").over(all_))
    judged = kept.withColumn("n_", F.count("*").over(all_)).withColumn("fits_", (F.col("n_") <= 3) | (z <= 2))
    return judged.withColumn("any_", F.max("fits_").over(all_)).where("fits_ OR NOT any_").drop("n_", "fits_", "any_")


def bounded(candidates: DataFrame, before: Column, after: Column, most: float = 5.0, shortest: float = 10.0, longest: float = 120.0) -> DataFrame:
    """Boundaries moved by at most ``most`` seconds and the length kept within limits around the middle."""
    limit = lambda c: F.greatest(F.lit(-most), F.least(F.lit(most), c))
    start, end = F.greatest(F.lit(0.0), F.col("start_time") + limit(before)), F.col("end_time") + limit(after)
    moved = candidates.withColumn("new_start", start).withColumn("new_end", end)
    length, middle = F.col("new_end") - F.col("new_start"), (F.col("new_end") + F.col("new_start")) / 2
    fixed = F.greatest(F.lit(shortest), F.least(F.lit(longest), length))
    off = (length < shortest) | (length > longest)
    return moved.withColumn("half_", F.when(off, fixed / 2)).withColumn("middle_", middle).withColumn("new_start", F.when(F.col("half_").isNotNull(), F.greatest(F.lit(0.0), F.col("middle_") - F.col("half_"))).otherwise(F.col("new_start"))).withColumn("new_end", F.coalesce(F.col("middle_") + F.col("half_"), "new_end")).drop("half_", "middle_")


def duration_score(length: Column) -> Column:
    """1 from 20 to 96 seconds, the ratio outside, at least 0.1."""
    return F.greatest(F.lit(0.1), F.when(length < 20, length / 20).when(length > 96, 96 / length).otherwise(1.0))


# ---- the chain of clean-up ---------------------------------------------------------------


def smoothed_candidates(candidates: DataFrame, width: float = 10.0, strength: float = 0.3) -> DataFrame:
    """Score and confidence smoothed along the middles within 0 and 1; streams of fewer than three stay as they are.

    ``old_score`` and ``old_confidence`` keep the originals.
    """
    rows = candidates.withColumnsRenamed({"score": "old_score", "confidence": "old_confidence"}).withColumn("t", (F.col("start_time") + F.col("end_time")) / 2)
    few = F.count("*").over(Window.partitionBy("stream_id")) < 3
    clip = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    for name in ("score", "confidence"):
        found = moving_average(rows.withColumns({"series": F.col("stream_id"), "v": F.col(f"old_{name}")}), width, strength)
        rows = found.withColumn(name, F.when(few, F.col(f"old_{name}")).otherwise(clip(F.col("smooth")))).drop("series", "v", "smooth")
    return rows.drop("t")


def boosted_confidence(confidence: Column, scores: Column, factor: float = 1.1) -> Column:
    """More where the modalities' scores (an array) agree; a little more for a single one."""
    n = F.size(scores)
    # Mean and squares in one pass, as var_pop does; the gain without the noise of 1.1 - 1.
    start = F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("squares"))
    moved = lambda a, x: a["mean"] + (x - a["mean"]) / (a["n"] + 1)
    seen = F.aggregate(scores, start, lambda a, x: F.struct((a["n"] + 1).alias("n"), moved(a, x).alias("mean"), (a["squares"] + (x - a["mean"]) * (x - moved(a, x))).alias("squares")))
    spread = seen["squares"] / n
    return F.least(F.lit(1.0), confidence * F.when(n > 1, 1 + (1 - F.least(F.lit(1.0), spread)) * round(factor - 1, 12)).otherwise(1.05))


def adaptive_scores(candidates: DataFrame, scores: Column, most: float = 0.2) -> DataFrame:
    """``new_score`` and ``new_confidence``: the boosted and the contextual ones mixed by how high the score is."""
    near = refine_by_context(candidates.withColumn("boosted_", boosted_confidence(F.col("confidence"), scores)))
    contextual = F.col("confidence") * F.when(F.col("n_near") == 0, 1.0).when(F.col("n_near") == 1, 1.1).otherwise(1 + 0.1 * F.col("agreement"))
    high = F.col("score") > 0.7
    score = F.when(high, 0.8 * F.col("score") + 0.2 * F.col("refined")).otherwise(0.5 * F.col("score") + 0.5 * F.col("refined"))
    sure = F.when(high, 0.7 * F.col("boosted_") + 0.3 * contextual).otherwise(0.3 * F.col("boosted_") + 0.7 * contextual)
    clip = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    return near.withColumn("new_score", clip(F.least(F.col("score") + most, score))).withColumn("new_confidence", clip(sure)).drop("boosted_")


def scene_moves(stability: Column) -> tuple[Column, Column]:
    """How start and end move by the stability of the scene: outwards if unstable, else inwards."""
    out = F.when(stability < 0.5, 2.0).otherwise(-0.5)
    return -out, out


def audio_moves(spikes: Column) -> tuple[Column, Column]:
    """How start and end move by the number of spikes in volume: outwards if many, inwards if none."""
    out = F.when(spikes > 3, 1.5).when(spikes == 0, -0.5).otherwise(0.0)
    return -out, out


def content_moves(stability: Column, spikes: Column) -> tuple[Column, Column]:
    """The mean of both."""
    (a, b), (c, d) = scene_moves(stability), audio_moves(spikes)
    return (a + c) / 2, (b + d) / 2


def post_processed(candidates: DataFrame, scores: Column, stability: Column, spikes: Column) -> DataFrame:
    """Smoothed, moved at the borders, scored anew and filtered; the originals in ``old_`` columns."""
    smooth = smoothed_candidates(candidates)
    moved = bounded(smooth, *content_moves(stability, spikes))
    moved = moved.withColumnsRenamed({"start_time": "old_start", "end_time": "old_end"}).withColumnsRenamed({"new_start": "start_time", "new_end": "end_time"})
    scored = adaptive_scores(moved, scores).drop("score", "confidence").withColumnsRenamed({"new_score": "score", "new_confidence": "confidence"})
    return final_filter(scored)


def processing_metrics(processed: DataFrame) -> DataFrame:
    """Per stream: candidates, those improved, mean gains and moved borders."""
    gain = lambda c: F.greatest(F.lit(0.0), F.col(c) - F.col(f"old_{c}"))
    moved = (F.abs(F.col("start_time") - F.col("old_start")) > 0.1) | (F.abs(F.col("end_time") - F.col("old_end")) > 0.1)
    return processed.groupBy("stream_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("score") > F.col("old_score")).alias("improved"), F.avg(gain("score")).alias("score_gain"), F.avg(gain("confidence")).alias("confidence_gain"), F.count_if(moved).alias("moved")
    )


def segment_highlights(segments: DataFrame, video: Column, audio: Column, chat: Column, shortest: float = 5.0, longest: float = 120.0, least: float = 0.7) -> DataFrame:
    """Segments long and sure enough as highlights, with type, title and description; confidence stops at 1."""
    kept = segments.where((F.col("end_time") - F.col("start_time") >= shortest) & (F.col("weighted") >= least))
    told = F.concat_ws(" ", *[F.concat(F.lit(f"{m} "), F.col(m)) for m in MODALITIES])
    named = kept.withColumn("highlight_type", highlight_type(video, audio, chat))
    return named.select(
        "stream_id", "start_time", F.least("end_time", F.col("start_time") + longest).alias("end_time"), F.least(F.col("weighted"), F.lit(1.0)).alias("confidence"), "highlight_type",
        highlight_title(F.col("highlight_type")).alias("title"), F.when(told == "", "Automatically detected highlight").otherwise(told).alias("description"),
    )


def merged_neighbours(highlights: DataFrame) -> DataFrame:
    """Each highlight merged with the next one of its stream."""
    order = Window.partitionBy("stream_id").orderBy("start_time", "id")
    row = F.struct(*[c for c in highlights.columns if c != "stream_id"])
    pairs = highlights.select(row.alias("a"), F.lead(row).over(order).alias("b")).where("b IS NOT NULL")
    return pairs.select(merged_pair(F.col("a"), F.col("b")).alias("x")).select("x.*")


def aligned(detections: DataFrame, method: str = "window") -> DataFrame:
    """Observations aligned on the times of their stream by the named method."""
    if method == "strict":
        return align_strict(detections)
    return align_interpolated(detections) if method == "interpolated" else align_window(detections)


def enhanced_features(candidates: DataFrame, features: Column) -> DataFrame:
    """Candidates with the score of their length, their weight, and mean, spread and most of their features (an array)."""
    n = F.size(features)
    mean = F.aggregate(features, F.lit(0.0), lambda a, x: a + x) / n
    spread = F.sqrt(F.aggregate(features, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / n)
    return candidates.select(
        "*", duration_score(F.col("end_time") - F.col("start_time")).alias("duration_score"), (F.col("score") * F.col("confidence")).alias("weighted"),
        mean.alias("feature_mean"), spread.alias("feature_std"), F.array_max(features).alias("feature_max"),
    )
