"""Lookups, filters, joins, aggregations and pages over the domain tables.

Functions take and return lazy DataFrames; predicates are plain columns, so Catalyst
pushes them into the scans. ``as_of`` stands for the current time wherever one is
needed. Limits and pages are features here and always come with a total order.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Fixed names.
STREAM_STATUSES = ("pending", "processing", "completed", "failed", "cancelled")
BATCH_STATUSES = ("pending", "processing", "completed", "partially_failed", "failed", "cancelled")
WEBHOOK_STATUSES = ("active", "inactive", "failed")
PLANS = ("starter", "professional", "enterprise", "custom")


# ---- building blocks ------------------------------------------------------------------


def all_of(*conditions: Column | None) -> Column:
    """Conjunction of the given conditions; None stands for no condition."""
    return reduce(lambda a, b: a & b, [c for c in conditions if c is not None], F.lit(True))


def when_given(value, condition) -> Column | None:
    """``condition(value)`` unless the value is None; zero and empty values count as given."""
    return None if value is None else condition(value)


def page(df: DataFrame, order: Sequence[Column], limit: int, offset: int = 0) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def page_meta(total: Column, limit: int, offset: int) -> list[Column]:
    """total, pages, has_next and has_prev of a page."""
    return [
        total.alias("total"),
        F.ceil(total / limit).cast("long").alias("pages"),
        (total > offset + limit).alias("has_next"),
        F.lit(offset > 0).alias("has_prev"),
    ]


def listed(df: DataFrame, column: str, values: Iterable[str], measures: Sequence[Column]) -> DataFrame:
    """``groupBy(column).agg(measures)`` with a row for every listed value, zero where it has none."""
    values = list(values)
    dim = df.sparkSession.createDataFrame([(v,) for v in values], f"{column} string")
    sums = df.where(F.col(column).isin(values)).groupBy(column).agg(*measures)
    names = [c for c in sums.columns if c != column]
    return dim.join(sums, column, "left").select(column, *[F.coalesce(n, F.lit(0)).alias(n) for n in names])


# ---- scans and DML ---------------------------------------------------------------------


def get(df: DataFrame, key, column: str = "id") -> DataFrame:
    return df.where(F.col(column) == F.lit(key))


def get_many(df: DataFrame, keys: Sequence, column: str = "id") -> DataFrame:
    """Rows of the listed keys; none for an empty list."""
    return df.where(F.col(column).isin(list(keys))) if keys else df.limit(0)


def exists(df: DataFrame, condition: Column) -> DataFrame:
    """One row with ``found``."""
    return df.where(condition).limit(1).agg((F.count("*") > 0).alias("found"))


def upsert(current: DataFrame, changes: DataFrame, key: str = "id", version: str = "updated_at") -> DataFrame:
    """The newest row of each key over both tables; changes win ties."""
    both = current.withColumn("new_", F.lit(0)).unionByName(changes.withColumn("new_", F.lit(1)))
    newest = Window.partitionBy(key).orderBy(F.desc(version), F.desc("new_"))
    return both.withColumn("nth_", F.row_number().over(newest)).where("nth_ = 1").drop("nth_", "new_")


def delete_keys(current: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    return current.join(keys.select(key), key, "left_anti")


def retained(df: DataFrame, expired: Column) -> DataFrame:
    """What stays after a clean-up; rows for which the rule is unknown stay."""
    return df.where(~F.coalesce(expired, F.lit(False)))


def clean_up_counts(df: DataFrame, expired: Column) -> DataFrame:
    """Rows that a clean-up removes and keeps."""
    gone = F.coalesce(expired, F.lit(False))
    return df.agg(F.count_if(gone).alias("removed"), F.count_if(~gone).alias("kept"))


def patch(current: DataFrame, updates: DataFrame, key: str = "id") -> DataFrame:
    """Overwrite columns with those of the update rows; a null update keeps the old value."""
    fields = [c for c in updates.columns if c != key]
    renamed = updates.select(key, *[F.col(c).alias(f"new_{c}") for c in fields])
    changed = [F.coalesce(f"new_{c}", c).alias(c) if c in fields else F.col(c) for c in current.columns]
    return current.join(renamed, key, "left").select(*changed)


def set_status(df: DataFrame, ids: Sequence[int], status: str) -> DataFrame:
    """Set the status of the listed rows and say whether it changed."""
    hit = F.col("id").isin(list(ids)) & (F.col("status") != status)
    return df.withColumn("changed", hit).withColumn("status", F.when(hit, status).otherwise(F.col("status")))


def retry_failed(items: DataFrame) -> DataFrame:
    """Failed batch items become pending again."""
    return items.withColumn("status", F.when(F.col("status") == "failed", "pending").otherwise(F.col("status")))


# ---- filters ---------------------------------------------------------------------------


def in_period(start=None, end=None, begins: str = "period_start", ends: str = "period_end") -> Column:
    """Records within a period; a record that is still open passes the end."""
    return all_of(when_given(start, lambda v: F.col(begins) >= F.lit(v)), when_given(end, lambda v: (F.col(ends) <= F.lit(v)) | F.col(ends).isNull()))


def has_tags(tags: Sequence[str], match_all: bool = False, column: str = "tags") -> Column:
    wanted = F.array(*[F.lit(t) for t in tags])
    return F.size(F.array_except(wanted, F.col(column))) == 0 if match_all else F.arrays_overlap(F.col(column), wanted)


def search_order(query: str, name: str) -> Column:
    """Case-insensitive hit of a literal string."""
    return F.contains(F.lower(name), F.lit(query.lower()))


def search_highlights(highlights: DataFrame, query: str, limit: int) -> DataFrame:
    """Hits in title or description; hits in the title first, then by confidence."""
    hit = F.coalesce(search_order(query, "title"), F.lit(False))
    found = highlights.where(hit | search_order(query, "description"))
    return page(found.withColumn("title_hit", hit), [F.desc("title_hit"), F.desc("confidence_score"), F.col("id")], limit)


def success_rate(done: str, total: str) -> Column:
    return F.try_divide(F.col(done), F.col(total))


# ---- joins -----------------------------------------------------------------------------


def highlights_of_user(highlights: DataFrame, streams: DataFrame, user_id: int) -> DataFrame:
    own = streams.where(F.col("user_id") == user_id).select(F.col("id").alias("stream_id"))
    return highlights.join(own, "stream_id")


def members_of(organizations: DataFrame, memberships: DataFrame, condition: Column) -> DataFrame:
    """User ids (``user_id``) that own or belong to the organizations of the condition."""
    chosen = organizations.where(condition).select(F.col("id").alias("organization_id"), "owner_id")
    joined = memberships.join(chosen.select("organization_id"), "organization_id", "left_semi").select("user_id")
    return joined.union(chosen.select(F.col("owner_id").alias("user_id"))).where("user_id IS NOT NULL").distinct()


def with_highlights(streams: DataFrame, highlights: DataFrame) -> DataFrame:
    """One row for each stream and highlight, best first (``nth``); a stream without any has one row of nulls.

    Kept flat, so that no list of highlights grows in one row.
    """
    order = Window.partitionBy("stream_id").orderBy(F.desc("confidence_score"), "id")
    placed = highlights.select(F.col("stream_id").alias("of_stream_"), F.col("id").alias("highlight_id"), "confidence_score", F.row_number().over(order).alias("nth"))
    return streams.join(placed, streams["id"] == placed["of_stream_"], "left").drop("of_stream_")


# ---- aggregations ----------------------------------------------------------------------


def highlight_statistics(highlights: DataFrame, high: float = 0.8) -> DataFrame:
    """Count, mean confidence and share of high confidence by type, with a row for all (type null)."""
    return highlights.rollup("highlight_type").agg(
        F.count("*").alias("n"),
        F.round(F.avg("confidence_score"), 8).alias("avg_confidence"),
        F.count_if(F.col("confidence_score") >= high).alias("n_high"),
        F.round(100 * F.count_if(F.col("confidence_score") >= high) / F.count("*"), 6).alias("high_percent"),
    )


def top_tags(highlights: DataFrame, limit: int = 10) -> DataFrame:
    counts = highlights.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))
    return page(counts, [F.desc("n"), F.col("tag")], limit)


def stream_stats(streams: DataFrame) -> DataFrame:
    """Per user: a count for each status, mean seconds to completion and total minutes."""
    took = F.timestamp_diff("MICROSECOND", F.col("started_at"), F.col("completed_at")) / 1e6
    return streams.groupBy("user_id").agg(
        *[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in STREAM_STATUSES],
        F.round(F.avg(took), 3).alias("avg_seconds"),
        F.round(F.sum("duration") / 60, 8).alias("minutes"),
    )


def usage_totals() -> list[Column]:
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return [F.count("*").alias("n"), F.round(zero(F.sum("quantity")), 4).alias("quantity"), F.round(zero(F.sum("total_cost")), 4).alias("cost"), F.round(zero(F.avg("quantity")), 8).alias("avg_quantity")]


def usage_analytics(usage: DataFrame) -> DataFrame:
    """By type, with a row for all: count, quantity, cost, and those of billable records."""
    billable = F.col("billable")
    return usage.rollup("usage_type").agg(
        F.count("*").alias("n"), F.round(F.sum("quantity"), 4).alias("quantity"), F.round(F.sum("total_cost"), 4).alias("cost"),
        F.count_if(billable).alias("billable_n"), F.round(F.sum(F.when(billable, F.col("total_cost")).otherwise(0.0)), 4).alias("billable_cost"),
        F.count_if(~billable).alias("unbillable_n"),
    )


def top_consumers(usage: DataFrame, usage_type: str, limit: int = 10) -> DataFrame:
    sums = usage.where(F.col("usage_type") == usage_type).groupBy("user_id").agg(F.round(F.sum("quantity"), 4).alias("quantity"), F.count("*").alias("n"))
    return page(sums, [F.desc("quantity"), F.col("user_id")], limit)


def billing_summary(usage: DataFrame) -> DataFrame:
    """Billable usage by user and type, with the unit of the earliest record."""
    first = F.min_by("unit", F.struct("period_start", "id"))
    return usage.where("billable").groupBy("user_id", "usage_type").agg(F.round(F.sum("quantity"), 4).alias("quantity"), F.round(F.sum("total_cost"), 4).alias("cost"), F.count("*").alias("n"), first.alias("unit"))


def batch_stats(batches: DataFrame) -> DataFrame:
    """Per status: count, mean of the success ratios, ratio of the sums, mean size and mean hours to completion."""
    hours = F.timestamp_diff("MICROSECOND", F.col("created_at"), F.col("completed_at")) / 3.6e9
    return batches.groupBy("status").agg(
        F.count("*").alias("n"), F.round(F.avg(success_rate("successful_items", "total_items")), 6).alias("mean_ratio"),
        F.round(F.try_divide(F.sum("successful_items"), F.sum("total_items")), 6).alias("ratio_of_sums"),
        F.round(F.avg("total_items"), 6).alias("avg_size"), F.round(F.avg(hours), 4).alias("avg_hours"),
    )


def failed_items(batches: DataFrame, items: DataFrame, limit: int) -> DataFrame:
    """Failed items of the ``limit`` newest batches, at most ``limit`` of them."""
    newest = page(batches, [F.desc("created_at"), F.col("id")], limit).select(F.col("id").alias("batch_id"), "created_at")
    failed = items.where(F.col("status") == "failed").join(newest, "batch_id").groupBy("batch_id", "created_at", "item_id", "line").agg(F.count("*").alias("times"))
    return page(failed, [F.desc("created_at"), F.col("batch_id"), F.col("line"), F.col("item_id")], limit)


def queue_stats(batches: DataFrame, as_of: str) -> DataFrame:
    """Waiting and running batches, the oldest waiting one and the mean wait in hours."""
    waiting = F.col("status") == "pending"
    wait = F.timestamp_diff("MICROSECOND", F.col("created_at"), F.lit(as_of).cast("timestamp_ntz")) / 3.6e9
    return batches.agg(
        F.count_if(waiting).alias("n_pending"), F.count_if(F.col("status") == "processing").alias("n_processing"),
        F.min(F.when(waiting, F.col("created_at"))).alias("oldest"), F.round(F.avg(F.when(waiting, wait)), 3).alias("avg_wait_hours"),
    )


def webhook_rates(webhooks: DataFrame) -> DataFrame:
    failed = F.col("total_deliveries") - F.col("successful_deliveries")
    return webhooks.withColumn("failed_deliveries", failed).withColumn("success_rate", F.coalesce(success_rate("successful_deliveries", "total_deliveries"), F.lit(0.0)))


def webhook_health(webhooks: DataFrame) -> DataFrame:
    """Health from 0 to 100, its level and the advice that goes with it."""
    rate = F.coalesce(success_rate("successful_deliveries", "total_deliveries"), F.lit(1.0))
    loss = F.least(10 * F.col("consecutive_failures"), F.lit(50)) + F.when(rate < 0.95, F.floor((1 - rate) * 30)).otherwise(0) + F.when(F.col("status") != "active", 20).otherwise(0)
    score = F.greatest(100 - loss, F.lit(0)).cast("long")
    level = F.when(F.col("health") >= 90, "healthy").when(F.col("health") >= 70, "degraded").when(F.col("health") >= 50, "unhealthy").otherwise("critical")
    advice = F.array_compact(
        F.array(
            F.when(F.col("consecutive_failures") >= 5, "check the endpoint"),
            F.when(rate < 0.9, "review the error log"),
            F.when(F.col("status") != "active", "activate the webhook"),
        )
    )
    return webhooks.withColumn("health", score).withColumn("level", level).withColumn("advice", F.array_join(advice, "; "))


# ---- top-k -----------------------------------------------------------------------------


def trending(highlights: DataFrame, as_of: str, since: str, limit: int = 10) -> DataFrame:
    """The highlights since a time with the highest mix of confidence, engagement and freshness."""
    age = F.timestamp_diff("MICROSECOND", F.col("created_at"), F.lit(as_of).cast("timestamp_ntz")) / 1e6
    score = 0.4 * F.col("confidence_score") + 0.3 * F.coalesce("viewer_engagement", F.lit(0.0)) + 0.3 * F.exp(-age / 86400)
    recent = highlights.where(F.col("created_at") >= F.lit(since).cast("timestamp_ntz")).withColumn("trend", F.round(score, 6))
    return page(recent, [F.desc("trend"), F.col("id")], limit)


def importance(highlights: DataFrame) -> DataFrame:
    length = F.col("end_time") - F.col("start_time")
    bonus = F.when(length.between(10, 60), 0.1).when(length <= 90, 0.05).otherwise(0.0)
    score = 0.4 * F.col("confidence_score") + 0.3 * F.coalesce("viewer_engagement", F.lit(0.0)) + 0.2 * F.abs(F.coalesce("sentiment_score", F.lit(0.0))) + bonus
    return highlights.withColumn("importance", F.round(F.least(score, F.lit(1.0)), 6))


def top_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows of every key; Spark cuts each partition to them before the shuffle."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("nth", nth).where(F.col("nth") <= n)
