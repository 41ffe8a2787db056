"""State changes, statistics and choices on the rows of accounts, batches, streams and frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenspan.functions.scalar import may_follow
from lumenspan.operators.temporal import band_join

# ---- detection results -------------------------------------------------------------------


def filtered_results(rows: DataFrame, score: str, confidence: str, least_score: float, least_confidence: float) -> DataFrame:
    """Results that reach both limits and their product, by that product (``nth`` within the stream)."""
    weight = F.col(score) * F.col(confidence)
    kept = rows.where((F.col(score) >= least_score) & (F.col(confidence) >= least_confidence) & (weight >= least_score * least_confidence))
    placed = kept.withColumn("weight", F.round(weight, 9))
    return placed.withColumn("nth", F.row_number().over(Window.partitionBy("stream_id").orderBy(F.desc("weight"), "id")))


def valid_segments(rows: DataFrame, data: str) -> DataFrame:
    return rows.where(F.col(data).isNotNull() & (F.col("end_time") - F.col("start_time") > 0))


def kept_segments(rows: DataFrame, confidence: str, shortest: float = 5.0, longest: float = 120.0, least: float = 0.7) -> DataFrame:
    """Segments long enough and sure enough, cut at the longest length."""
    kept = rows.where((F.col("end_time") - F.col("start_time") >= shortest) & (F.col(confidence) >= least))
    return kept.withColumn("end_time", F.least("end_time", F.col("start_time") + longest))


def duration_score(length: Column, shortest: float = 20.0, longest: float = 96.0) -> Column:
    return F.when(length.between(shortest, longest), 1.0).when(length < shortest, length / shortest).otherwise(F.greatest(F.lit(0.1), longest / length))


def first_scores(detections: DataFrame, modalities: tuple[str, ...] = ("video", "audio", "chat")) -> DataFrame:
    """Per stream the score of the first result of each modality, 0 without one."""
    first = lambda m: F.coalesce(F.min_by("score", F.when(F.col("modality") == m, F.col("seq"))), F.lit(0.0)).alias(m)
    return detections.groupBy("stream_id").agg(*[first(m) for m in modalities])


# ---- frames ------------------------------------------------------------------------------


def sampled(frames: DataFrame, every: float) -> DataFrame:
    """The first frame of each span of ``every`` seconds."""
    return frames.groupBy("stream_id", F.floor(F.col("t") / every).alias("span")).agg(F.min_by("frame_id", F.struct("t", "frame_id")).alias("frame_id"))


def _others(frames: DataFrame, chosen: DataFrame, within: float) -> DataFrame:
    """Pairs of a chosen frame and a frame of another stream less than ``within`` apart."""
    left = chosen.select("frame_id", F.col("stream_id").alias("own_stream"), "t")
    right = frames.select(F.col("frame_id").alias("other_frame"), F.col("stream_id").alias("other_stream"), F.col("t").alias("other_t"))
    return band_join(left, right, [], "t", "other_t", within, strict=True).where("own_stream <> other_stream")


def sync_points(frames: DataFrame, within: float) -> DataFrame:
    """For each keyframe and other stream the nearest frame less than ``within`` away."""
    pairs = _others(frames, frames.where("is_keyframe"), within)
    nearest = F.min_by("other_frame", F.struct(F.abs(F.col("t") - F.col("other_t")), "other_frame"))
    return pairs.groupBy("frame_id", "other_stream").agg(nearest.alias("other_frame"))


def streams_near(rows: DataFrame, at: str, within: float, strict: bool = True) -> DataFrame:
    """``rows`` with ``n_near``: other streams that have a row less than ``within`` away (or as far, unless strict).

    Rows are not paired. A stream with a row in the same bucket of ``within`` seconds is
    near; of the others only the last time in the bucket before and the first one in the
    bucket behind matter, so each bucket holds one entry a stream.
    """
    placed = rows.withColumn("bucket_", F.floor(F.col(at) / within).cast("long"))
    seen = placed.groupBy("bucket_", "stream_id").agg(F.min(at).alias("first_"), F.max(at).alias("last_"))
    side = lambda k, last, first: F.struct((F.col("bucket_") + k).alias("bucket_"), F.lit(k == 0).alias("here_"), last.alias("last_"), first.alias("first_"))
    none = F.lit(None).cast("double")
    spread = seen.select("stream_id", F.explode(F.array(side(0, none, none), side(1, F.col("last_"), none), side(-1, none, F.col("first_")))).alias("x")).select("stream_id", "x.*")
    met = spread.groupBy("bucket_", "stream_id").agg(F.max("here_").alias("here_"), F.max("last_").alias("last_"), F.min("first_").alias("first_"))
    around = met.groupBy("bucket_").agg(F.count_if("here_").alias("n_here_"), F.collect_list(F.when(~F.col("here_"), F.struct("last_", "first_"))).alias("beside_"))
    t = F.col(at)
    close = lambda gap: F.coalesce(gap < within if strict else gap <= within, F.lit(False))
    beside = F.size(F.filter("beside_", lambda x: close(t - x["last_"]) | close(x["first_"] - t)))
    return placed.join(around, "bucket_").withColumn("n_near", F.col("n_here_") - 1 + beside).drop("bucket_", "n_here_", "beside_")


def sync_confidence(frames: DataFrame, within: float) -> DataFrame:
    """Half for a keyframe, half by the share of other streams with a frame less than ``within`` away."""
    streams = frames.agg(F.countDistinct("stream_id")).scalar()
    share = F.coalesce(F.try_divide(F.col("n_near"), streams - 1), F.lit(0.0))
    return streams_near(frames, "t", within).withColumn("confidence", F.when(F.col("is_keyframe"), 0.5).otherwise(0.0) + 0.5 * share)


# ---- statistics --------------------------------------------------------------------------


def metric_stats(rows: DataFrame, key: str, value: str, order: Column) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.min(value).alias("least"), F.max(value).alias("most"), F.avg(value).alias("mean"), F.max_by(value, order).alias("latest"))


def progress(events: DataFrame, key: str) -> DataFrame:
    """Per key events, errors, retries, percentage done and the seconds left at the speed so far; null before the first is done."""
    percent = 100 * F.count_if(F.col("status") == "processed") / F.count("*")
    elapsed = F.timestamp_diff("MICROSECOND", F.min("received_at"), F.max("received_at")) / F.lit(1e6)
    found = events.groupBy(key).agg(F.count("*").alias("n"), F.count_if(F.col("status") == "failed").alias("errors"), F.count_if(F.col("retry_count") > 0).alias("retries"), percent.alias("percent"), elapsed.alias("elapsed"))
    return found.withColumn("seconds_left", F.col("elapsed") * (F.try_divide(F.lit(100.0), F.col("percent")) - 1)).drop("elapsed")


def score_bins(rows: DataFrame, score: str) -> DataFrame:
    bounds = ((None, 0.5, "under_50"), (0.5, 0.7, "from_50"), (0.7, 0.8, "from_70"), (0.8, 0.9, "from_80"), (0.9, None, "from_90"))
    v = F.col(score)
    return rows.agg(*[F.count_if((F.lit(True) if a is None else v >= a) & (F.lit(True) if b is None else v < b)).alias(n) for a, b, n in bounds])


def agent_metrics(rows: DataFrame, created: Column) -> DataFrame:
    n = F.count("*")
    mean = lambda c: F.coalesce(F.avg(F.when(created, F.col(c))), F.lit(0.0))
    return rows.groupBy("stream_id").agg(
        n.alias("evaluated"), F.count_if(created).alias("created"), (F.count_if(created) / F.greatest(F.lit(1), n)).alias("success_rate"),
        mean("confidence_score").alias("avg_confidence"), mean("viewer_engagement").alias("avg_score"),
    )


def model_scores(rows: DataFrame) -> DataFrame:
    """Accuracy, weighted precision, recall and F1, area under the curve and log loss of rows (y, p).

    The area comes from counts by distinct value of p and running sums over them, so
    ties count half and no row is compared with another.
    """
    y, hit = F.col("y") == 1, F.col("p") > 0.5
    n, pos = F.count("*"), F.count_if(y)
    likely = F.greatest(F.lit(1e-15), F.when(y, F.col("p")).otherwise(1 - F.col("p")))
    c = rows.agg(n.alias("n"), pos.alias("pos"), F.count_if(y & hit).alias("tp"), F.count_if(~y & hit).alias("fp"), F.count_if(~y & ~hit).alias("tn"), F.count_if(y & ~hit).alias("fn"), (-F.avg(F.log(likely))).alias("log_loss"))
    by_value = rows.groupBy("p").agg(F.count_if(y).alias("ones"), F.count_if(~y).alias("zeros"))
    # Values are dealt to ranges by their order; the zeros below come from the ranges before and the own range.
    ranged = by_value.repartitionByRange("p").withColumn("part_", F.spark_partition_id())
    before = ranged.groupBy("part_").agg(F.sum("zeros").alias("z")).withColumn("ahead_", F.coalesce(F.sum("z").over(Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("z")
    own = F.coalesce(F.sum("zeros").over(Window.partitionBy("part_").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    wins = ranged.withColumn("own_", own).join(F.broadcast(before), "part_").agg(F.sum(F.col("ones") * (F.col("own_") + F.col("ahead_") + F.col("zeros") / 2)).alias("wins"))
    x = F.col
    neg = x("n") - x("pos")
    zero = lambda v: F.coalesce(v, F.lit(0.0))
    return c.join(wins, F.lit(True)).select(
        ((x("tp") + x("tn")) / x("n")).alias("accuracy"),
        ((x("pos") * zero(F.try_divide("tp", x("tp") + x("fp"))) + neg * zero(F.try_divide("tn", x("tn") + x("fn")))) / x("n")).alias("precision"),
        ((x("pos") * zero(F.try_divide("tp", "pos")) + neg * zero(F.try_divide("tn", neg))) / x("n")).alias("recall"),
        ((x("pos") * zero(F.try_divide(2 * x("tp"), 2 * x("tp") + x("fp") + x("fn"))) + neg * zero(F.try_divide(2 * x("tn"), 2 * x("tn") + x("fp") + x("fn")))) / x("n")).alias("f1"),
        F.try_divide("wins", x("pos") * neg).alias("auc"), "log_loss",
    )


def feature_importance(rows: DataFrame, features: list[str], target: str) -> DataFrame:
    """Absolute correlation of each feature with the target; 0 where it is undefined."""
    return rows.agg(*[F.coalesce(F.abs(F.corr(f, target)), F.lit(0.0)).alias(f) for f in features])


# ---- choice of quality -------------------------------------------------------------------


def _most(order: str) -> Column:
    return F.max_by("id", F.struct(F.col(order), -F.col("id")))


def best_quality(qualities: DataFrame, most: int | None = None) -> DataFrame:
    """Per manifest the highest bandwidth within the limit, else the lowest of all; ties go to the lowest id."""
    fits = F.lit(True) if most is None else F.col("bandwidth") <= most
    within = F.max_by("id", F.when(fits, F.struct("bandwidth", -F.col("id"))))
    return qualities.groupBy("manifest_id").agg(F.coalesce(within, F.min_by("id", F.struct("bandwidth", "id"))).alias("id"))


def quality_by_height(qualities: DataFrame, height: int) -> DataFrame:
    return qualities.groupBy("manifest_id").agg(F.min_by("id", F.struct(F.abs(F.col("height") - height), "id")).alias("id"))


def optimal_quality(qualities: DataFrame, height: int | None = None, most: int | None = None, prefer: str = "best") -> DataFrame:
    """Within the bandwidth the nearest height asked for or named ("720p"), else the best or worst."""
    fitting = qualities if most is None else qualities.where(F.col("bandwidth") <= most)
    if height is None and prefer[:-1].isdigit() and prefer.endswith("p"):
        height = int(prefer[:-1])
    if height is not None:
        return quality_by_height(fitting, height)
    pick = F.min_by("id", F.struct("bandwidth", "id")) if prefer == "worst" else _most("bandwidth")
    return fitting.groupBy("manifest_id").agg(pick.alias("id"))


# ---- accounts, batches and usage -----------------------------------------------------------


def batch_progress(batches: DataFrame) -> DataFrame:
    done = F.col("successful_items") + F.col("failed_items")
    zero = lambda v: F.coalesce(v, F.lit(0.0))
    return batches.withColumn("progress", zero(F.try_divide(100 * done, F.col("total_items")))).withColumn("success_rate", zero(F.try_divide(F.col("successful_items"), done)))


def batch_states(items: DataFrame) -> DataFrame:
    """Per batch counts and the status that follows from them."""
    ok, failed = F.count_if(F.col("status") == "completed"), F.count_if(F.col("status") == "failed")
    found = items.groupBy(F.col("batch_id").alias("id")).agg(F.count("*").alias("total"), ok.alias("ok"), failed.alias("failed"))
    open_ = F.col("ok") + F.col("failed") < F.col("total")
    return found.withColumn("status", F.when(open_, "processing").when(F.col("failed") == 0, "completed").when(F.col("ok") == 0, "failed").otherwise("partially_failed"))


def is_subscribed(now: Column) -> Column:
    return F.col("is_active") & F.coalesce(F.col("subscription_ends_at") > now, F.lit(True))


def renewed(organizations: DataFrame, now: Column, days: int) -> DataFrame:
    ends = F.timestamp_add("DAY", F.lit(days), F.coalesce("subscription_ends_at", now))
    return organizations.withColumn("subscription_ends_at", ends).withColumn("is_active", F.lit(True))


def expired(organizations: DataFrame, now: Column) -> DataFrame:
    """Organizations whose subscription has ended, as inactive ones."""
    return organizations.where(F.col("subscription_ends_at") <= now).withColumn("is_active", F.lit(False))


def updated_status(streams: DataFrame, wanted: Column) -> DataFrame:
    """Streams with the wanted status where it may follow theirs (``changed``)."""
    allowed = may_follow(F.col("status"), wanted)
    return streams.withColumn("changed", allowed).withColumn("status", F.when(allowed, wanted).otherwise(F.col("status")))


def with_quantity(usage: DataFrame, quantity: Column) -> DataFrame:
    return usage.withColumn("quantity", quantity).withColumn("total_cost", F.col("quantity") * F.col("rate"))


def not_billable(usage: DataFrame) -> DataFrame:
    return usage.withColumn("billable", F.lit(False)).withColumn("total_cost", F.lit(0.0))


def finished_usage(usage: DataFrame, streams: DataFrame) -> DataFrame:
    """Stream usage, open records completed with the minutes of their stream."""
    lengths = streams.select(F.col("id").alias("resource_id"), (F.col("duration") / 60).alias("minutes_"))
    joined = usage.where("usage_type = 'stream_processing'").join(lengths, "resource_id")
    still_open = F.col("period_end").isNull()
    done = joined.withColumn("total_cost", F.when(still_open, F.col("minutes_") * F.col("rate")).otherwise(F.col("total_cost")))
    return done.withColumn("quantity", F.when(still_open, F.col("minutes_")).otherwise(F.col("quantity"))).drop("minutes_")


def recent_events(events: DataFrame, last: int, condition: Column | None = None) -> DataFrame:
    """The last events of each stream, and of these the ones of the condition."""
    nth = F.row_number().over(Window.partitionBy("stream_id").orderBy(F.desc("received_at"), F.desc("event_id")))
    found = events.withColumn("nth", nth).where(F.col("nth") <= last)
    return found if condition is None else found.where(condition)
