"""Usage, quotas, invoices and their trends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Fixed limits and rates of the plans.
LIMIT_NAMES = ("calls_per_minute", "max_minutes", "max_streams", "max_webhooks", "max_keys", "max_members")
LIMITS = {
    "starter": (60, 1000, 1, 2, 2, 3),
    "professional": (300, 10_000, 5, 10, 10, 10),
    "enterprise": (1000, 100_000, 20, 50, 50, 100),
    "custom": (2000, 1_000_000, 100, 100, 100, 1000),
}
RATE_NAMES = ("stream_processing", "batch_processing", "api_call", "webhook_delivery", "storage", "bandwidth")
RATES = {
    "starter": (0.10, 0.08, 0.0001, 0.001, 0.10, 0.15),
    "professional": (0.08, 0.06, 0.00008, 0.0008, 0.08, 0.12),
    "enterprise": (0.05, 0.04, 0.00005, 0.0005, 0.05, 0.08),
    "custom": (0.03, 0.025, 0.00003, 0.0003, 0.03, 0.05),
}


def plans(spark: SparkSession) -> DataFrame:
    """One row a plan with its limits."""
    rows = [(p, *LIMITS[p]) for p in LIMITS]
    return spark.createDataFrame(rows, "plan_type string, " + ", ".join(f"{n} int" for n in LIMIT_NAMES))


def rates(spark: SparkSession) -> DataFrame:
    """One row for each plan and type of usage."""
    rows = [(p, kind, rate) for p, by_kind in RATES.items() for kind, rate in zip(RATE_NAMES, by_kind, strict=True)]
    return spark.createDataFrame(rows, "plan_type string, usage_type string, plan_rate double")


def organization_of(organizations: DataFrame, memberships: DataFrame) -> DataFrame:
    """Per user the organization owned, else the first one joined."""
    owned = organizations.where("owner_id IS NOT NULL").groupBy(F.col("owner_id").alias("user_id")).agg(F.min("id").alias("owned"))
    joined = memberships.groupBy("user_id").agg(F.min("organization_id").alias("joined"))
    return joined.join(owned, "user_id", "full").select("user_id", F.coalesce("owned", "joined").alias("organization_id"))


def plan_of(organizations: DataFrame, memberships: DataFrame) -> DataFrame:
    """Rows (user_id, home_id, plan_type)."""
    home = organization_of(organizations, memberships).withColumnRenamed("organization_id", "home_id")
    return home.join(organizations.select(F.col("id").alias("home_id"), "plan_type"), "home_id")


def priced(usage: DataFrame, plan: DataFrame) -> DataFrame:
    """Usage with the cost at the rate of its user's plan for its type; not billable usage costs nothing."""
    known = usage.join(plan, "user_id").join(rates(usage.sparkSession), ["plan_type", "usage_type"])
    return known.withColumn("plan_cost", F.when(F.col("billable"), F.col("quantity") * F.col("plan_rate")).otherwise(0.0))


def batch_usage(batches: DataFrame, minutes: Column) -> DataFrame:
    """What a batch uses: the minutes of its successful items, taken as an equal share each."""
    billable = F.when(F.col("total_items") > 0, F.col("successful_items") * (minutes / F.col("total_items"))).otherwise(0.0)
    return batches.select("id", "user_id", F.lit("batch_processing").alias("usage_type"), billable.alias("quantity"), F.lit(True).alias("billable"))


def quota_use(organizations: DataFrame, memberships: DataFrame, usage: DataFrame) -> DataFrame:
    """Per organization members and minutes against the plan, and whether either is over."""
    members = memberships.groupBy(F.col("organization_id").alias("id")).agg(F.countDistinct("user_id").alias("members"))
    minutes = usage.where("usage_type = 'stream_processing'").groupBy(F.col("organization_id").alias("id")).agg(F.sum("quantity").alias("minutes"))
    joined = organizations.join(plans(organizations.sparkSession), "plan_type").join(members, "id", "left").join(minutes, "id", "left")
    filled = joined.withColumn("members", F.coalesce("members", F.lit(0))).withColumn("minutes", F.coalesce("minutes", F.lit(0.0)))
    over = (F.col("members") > F.col("max_members")) | (F.col("minutes") > F.col("max_minutes"))
    return filled.select("id", "plan_type", "members", "minutes", F.round(100 * F.col("members") / F.col("max_members"), 6).alias("member_percent"), over.alias("is_over"))


def active_streams(streams: DataFrame, plan: DataFrame) -> DataFrame:
    """Per user with a plan the streams under way, and whether one more may start."""
    counts = streams.where("status IN ('pending', 'processing')").groupBy("user_id").agg(F.count("*").alias("active"))
    joined = plan.join(plans(plan.sparkSession), "plan_type").join(counts, "user_id", "left")
    active = F.coalesce("active", F.lit(0))
    return joined.select("user_id", "plan_type", active.alias("active"), "max_streams", (active < F.col("max_streams")).alias("may_start"))


def member_activity(memberships: DataFrame, streams: DataFrame) -> DataFrame:
    """Per organization and member the number of streams and the last one's time."""
    own = streams.groupBy("user_id").agg(F.count("*").alias("n_streams"), F.max("created_at").alias("last_active"))
    return memberships.join(own, "user_id", "left").select("organization_id", "user_id", F.coalesce("n_streams", F.lit(0)).alias("n_streams"), "last_active")


def stream_cost(usage: DataFrame, highlights: DataFrame) -> DataFrame:
    """Per stream its use and cost, its highlights and the cost of each."""
    used = usage.where("resource_type = 'stream'").groupBy(F.col("resource_id").alias("stream_id")).agg(F.sum("quantity").alias("quantity"), F.sum("total_cost").alias("cost"))
    found = highlights.groupBy("stream_id").agg(F.count("*").alias("n_highlights"))
    return used.join(found, "stream_id", "left").withColumn("n_highlights", F.coalesce("n_highlights", F.lit(0))).withColumn("per_highlight", F.try_divide("cost", "n_highlights"))


def trends(usage: DataFrame, granularity: str = "day") -> DataFrame:
    """Quantity of each main type and total cost by day, week or month."""
    kind = F.col("usage_type")
    total = lambda name: F.round(F.sum(F.when(kind == name, F.col("quantity")).otherwise(0.0)), 4).alias(name)
    return usage.groupBy(F.date_trunc(granularity, F.col("period_start")).cast("timestamp_ntz").alias("period")).agg(total("stream_processing"), total("api_call"), total("webhook_delivery"), F.round(F.sum("total_cost"), 4).alias("cost"))


def invoice(usage: DataFrame) -> DataFrame:
    """Billable lines by organization and type, with the subtotal of the organization."""
    lines = usage.where("billable").groupBy("organization_id", "usage_type").agg(F.count("*").alias("n"), F.round(F.sum("quantity"), 4).alias("quantity"), F.round(F.sum("total_cost"), 4).alias("cost"))
    return lines.withColumn("subtotal", F.round(F.sum("cost").over(Window.partitionBy("organization_id")), 4))


def top_resources(usage: DataFrame, limit: int = 10) -> DataFrame:
    key = F.concat_ws(":", "resource_type", "resource_id")
    return usage.groupBy(key.alias("resource")).agg(F.round(F.sum("total_cost"), 4).alias("cost"), F.count("*").alias("n")).orderBy(F.desc("cost"), "resource").limit(limit)


def monthly_estimate(usage: DataFrame, since: Column, month: Column, days: int) -> DataFrame:
    """Per user thirty days at the mean of the last ``days``, the month so far, and how much the first is above it."""
    recent = F.sum(F.when(F.col("period_start") >= since, F.col("total_cost")).otherwise(0.0)) / days * 30
    actual = F.sum(F.when(F.col("period_start") >= month, F.col("total_cost")).otherwise(0.0))
    found = usage.groupBy("user_id").agg(recent.alias("estimate"), actual.alias("actual"))
    return found.withColumn("overrun", F.greatest(F.lit(0.0), F.col("estimate") - F.col("actual")))


def calls_in_last_minute(usage: DataFrame, seconds: int = 60) -> DataFrame:
    """Per call of a user the calls of the minute up to it, itself included."""
    at = F.timestamp_diff("SECOND", F.lit("2024-01-01").cast("timestamp_ntz"), F.col("period_start"))
    frame = Window.partitionBy("user_id").orderBy("at").rangeBetween(-seconds, 0)
    return usage.where("usage_type = 'api_call'").withColumn("at", at).withColumn("calls", F.count("*").over(frame))


def month_to_date(usage: DataFrame) -> DataFrame:
    """Running quantity of a user within the month."""
    order = Window.partitionBy("user_id", "month").orderBy("period_start", "id").rowsBetween(Window.unboundedPreceding, 0)
    return usage.withColumn("month", F.date_trunc("month", F.col("period_start")).cast("date")).withColumn("to_date", F.sum("quantity").over(order))


def performance(tasks: DataFrame, key: str, value: str) -> DataFrame:
    """Count, range, mean and exact percentiles by key, with a row for all."""
    p = lambda q: F.round(F.percentile(value, q), 6)
    return tasks.rollup(key).agg(F.count("*").alias("n"), F.min(value).alias("least"), F.max(value).alias("most"), F.round(F.avg(value), 8).alias("mean"), p(0.5).alias("p50"), p(0.95).alias("p95"), p(0.99).alias("p99"))


def cumulative_buckets(rows: DataFrame, value: str, bounds: list[float]) -> DataFrame:
    """Rows at or under each bound."""
    return rows.agg(*[F.count_if(F.col(value) <= b).alias(f"le_{i}") for i, b in enumerate(bounds)], F.count(value).alias("le_inf"))


def calls_within(usage: DataFrame, per_minute: int, per_hour: int) -> DataFrame:
    """Calls that keep to the limits of the last minute and the last hour, the call itself included."""
    at = F.timestamp_diff("SECOND", F.lit("2024-01-01").cast("timestamp_ntz"), F.col("period_start"))
    calls = usage.where("usage_type = 'api_call'").withColumn("at", at)
    span = lambda seconds: F.count("*").over(Window.partitionBy("user_id").orderBy("at").rangeBetween(1 - seconds, 0))
    counted = calls.withColumn("in_minute", span(60)).withColumn("in_hour", span(3600))
    return counted.withColumn("allowed", (F.col("in_minute") <= per_minute) & (F.col("in_hour") <= per_hour))


def error_rates(tasks: DataFrame, key: str, failed: Column) -> DataFrame:
    """Count, failures and their percentage by key, with a row for all."""
    n, bad = F.count("*"), F.count_if(failed)
    return tasks.rollup(key).agg(n.alias("n"), bad.alias("n_failed"), F.round(100 * bad / n, 6).alias("percent"))


def throughput(tasks: DataFrame, now: Column, done: Column) -> DataFrame:
    """Tasks done in the last hour and what that makes a day."""
    n = F.count_if(done & (F.col("ts") > F.timestamp_add("HOUR", F.lit(-1), now)) & (F.col("ts") <= now))
    return tasks.agg(n.alias("last_hour"), (24 * n).alias("per_day"))
