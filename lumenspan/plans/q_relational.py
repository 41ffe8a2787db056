"""Queries of the relational operators with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenspan.operators import relational as R
from lumenspan.plans.prelude import with_tables
from lumenspan.sources import tables as T

QUERIES, SQL = {}, {}


def query(name: str, sql: str):
    """Register a query under ``name`` together with its SQL."""

    def add(f):
        QUERIES[name], SQL[name] = f, with_tables(sql)
        return f

    return add


H = "id, stream_id, confidence_score, highlight_type"
NTZ = lambda s: F.lit(s).cast("timestamp_ntz")


def _h(df):
    return df.select(*H.split(", "))


# ---- scans -----------------------------------------------------------------------------


@query("a01_get_by_id", f"SELECT {H} FROM highlights WHERE id = 77")
def _(s, d):
    return _h(R.get(T.highlights(s, d), 77))


@query("a02_get_many", f"SELECT {H} FROM highlights WHERE id IN (3, 5, 8, 999999)")
def _(s, d):
    return _h(R.get_many(T.highlights(s, d), [3, 5, 8, 999999]))


@query("a03_exists", "SELECT COUNT(*) > 0 AS found FROM (SELECT 1 FROM users WHERE id = 5)")
def _(s, d):
    return R.exists(T.users(s, d), F.col("id") == 5)


@query("a04_count", "SELECT COUNT(*) AS n FROM streams")
def _(s, d):
    return T.streams(s, d).agg(F.count("*").alias("n"))


@query("a18_segments_from", "SELECT frame_id, t FROM frames WHERE stream_id = 3 AND frame_id >= 100 ORDER BY frame_id LIMIT 20")
def _(s, d):
    return R.page(T.frames(s, d).where("stream_id = 3 AND frame_id >= 100").select("frame_id", "t"), [F.col("frame_id")], 20)


@query("a26_frames_in_range", "SELECT frame_id, t, is_keyframe FROM frames WHERE stream_id = 4 AND t BETWEEN 100 AND 900 ORDER BY t, frame_id LIMIT 50")
def _(s, d):
    return R.page(T.frames(s, d).where("stream_id = 4").where(F.col("t").between(100, 900)).select("frame_id", "t", "is_keyframe"), [F.col("t"), F.col("frame_id")], 50)


@query("a27_keyframes_in_range", "SELECT frame_id, t FROM frames WHERE is_keyframe AND t BETWEEN 0 AND 2000")
def _(s, d):
    return T.frames(s, d).where(F.col("is_keyframe") & F.col("t").between(0, 2000)).select("frame_id", "t")


@query("a28_latest_frames", "SELECT frame_id, stream_id, t FROM frames QUALIFY ROW_NUMBER() OVER (PARTITION BY stream_id ORDER BY t DESC, frame_id DESC) <= 10")
def _(s, d):
    return R.top_per(T.frames(s, d), ["stream_id"], [F.desc("t"), F.desc("frame_id")], 10).select("frame_id", "stream_id", "t")


@query("a30_seen_before", "SELECT event_id, platform FROM webhook_events WHERE EXISTS (SELECT 1 FROM (SELECT event_id, platform FROM webhook_events WHERE retry_count = 0) x WHERE x.event_id = webhook_events.event_id AND x.platform = webhook_events.platform)")
def _(s, d):
    events = T.webhook_events(s, d)
    return events.join(events.where("retry_count = 0").select("event_id", "platform"), ["event_id", "platform"], "left_semi").select("event_id", "platform")


# ---- DML as new snapshots ---------------------------------------------------------------


@query("a31_upsert", "SELECT id, status, CASE WHEN id % 10 = 0 THEN TIMESTAMP '2030-01-01' ELSE created_at END AS updated_at FROM (SELECT id, created_at, CASE WHEN id % 10 = 0 THEN 'cancelled' ELSE status END AS status FROM streams)")
def _(s, d):
    rows = T.streams(s, d).select("id", "status", F.col("created_at").alias("updated_at"))
    changes = rows.where("id % 10 = 0").select("id", F.lit("cancelled").alias("status"), NTZ("2030-01-01").alias("updated_at"))
    return R.upsert(rows, changes)


@query("a32_delete", "SELECT id, platform FROM streams WHERE id % 7 <> 0")
def _(s, d):
    rows = T.streams(s, d).select("id", "platform")
    return R.delete_keys(rows, rows.where("id % 7 = 0"))


@query("a35_usage_cleanup", "SELECT COUNT(*) FILTER (period_start < TIMESTAMP '2024-01-15' AND NOT billable) AS removed, COUNT(*) FILTER (NOT (period_start < TIMESTAMP '2024-01-15' AND NOT billable)) AS kept FROM usage_records")
def _(s, d):
    return R.clean_up_counts(T.usage_records(s, d), (F.col("period_start") < NTZ("2024-01-15")) & ~F.col("billable"))


@query("a36_stream_cleanup", "SELECT id, status FROM streams WHERE NOT (created_at < TIMESTAMP '1998-01-01' AND status IN ('completed', 'failed', 'cancelled'))")
def _(s, d):
    old = (F.col("created_at") < NTZ("1998-01-01")) & F.col("status").isin("completed", "failed", "cancelled")
    return R.retained(T.streams(s, d), old).select("id", "status")


@query("a37_batch_cleanup", "SELECT id, status FROM batches WHERE NOT (created_at < TIMESTAMP '1998-01-01' AND status IN ('completed', 'partially_failed', 'failed', 'cancelled'))")
def _(s, d):
    old = (F.col("created_at") < NTZ("1998-01-01")) & F.col("status").isin("completed", "partially_failed", "failed", "cancelled")
    return R.retained(T.batches(s, d), old).select("id", "status")


@query("a38_event_cleanup", "SELECT event_id, status FROM webhook_events WHERE NOT (received_at < TIMESTAMP '2024-01-10' AND status IN ('processed', 'duplicate'))")
def _(s, d):
    return R.retained(T.webhook_events(s, d), (F.col("received_at") < NTZ("2024-01-10")) & F.col("status").isin("processed", "duplicate")).select("event_id", "status")


@query("a39_expired_keys", "SELECT COUNT(*) FILTER (COALESCE(expires_at < TIMESTAMP '2024-02-01', FALSE)) AS removed, COUNT(*) FILTER (NOT COALESCE(expires_at < TIMESTAMP '2024-02-01', FALSE)) AS kept FROM api_keys")
def _(s, d):
    return R.clean_up_counts(T.api_keys(s, d), F.col("expires_at") < NTZ("2024-02-01"))


@query("a40_inactive_organizations", "SELECT COUNT(*) AS n FROM organizations WHERE NOT is_active AND subscription_ends_at < TIMESTAMP '1999-01-01'")
def _(s, d):
    return T.organizations(s, d).where(~F.col("is_active") & (F.col("subscription_ends_at") < NTZ("1999-01-01"))).agg(F.count("*").alias("n"))


@query("a41_deactivate_failed", "SELECT id, CASE WHEN consecutive_failures >= 10 AND status <> 'failed' THEN 'failed' ELSE status END AS status FROM webhooks")
def _(s, d):
    over = (F.col("consecutive_failures") >= 10) & (F.col("status") != "failed")
    return T.webhooks(s, d).select("id", F.when(over, "failed").otherwise(F.col("status")).alias("status"))


@query("a42_bulk_status", "SELECT id, CASE WHEN id IN (1, 2, 3, 4) THEN 'inactive' ELSE status END AS status, id IN (1, 2, 3, 4) AND status <> 'inactive' AS changed FROM webhooks")
def _(s, d):
    return R.set_status(T.webhooks(s, d), [1, 2, 3, 4], "inactive").select("id", "status", "changed")


@query("a43_reset_failures", "SELECT id, CASE WHEN id = 9 THEN 0 ELSE consecutive_failures END AS consecutive_failures, CASE WHEN id = 9 THEN 'active' ELSE status END AS status FROM webhooks")
def _(s, d):
    hit = F.col("id") == 9
    return T.webhooks(s, d).select("id", F.when(hit, 0).otherwise(F.col("consecutive_failures")).alias("consecutive_failures"), F.when(hit, "active").otherwise(F.col("status")).alias("status"))


@query("a44_revoke_keys", "SELECT id, is_active AND user_id <> 12 AS is_active FROM api_keys")
def _(s, d):
    return T.api_keys(s, d).select("id", (F.col("is_active") & (F.col("user_id") != 12)).alias("is_active"))


@query("a45_patch_subscriptions", "SELECT id, CASE WHEN id % 3 = 0 THEN 'enterprise' ELSE plan_type END AS plan_type, subscription_ends_at FROM organizations")
def _(s, d):
    rows = T.organizations(s, d).select("id", "plan_type", "subscription_ends_at")
    updates = rows.where("id % 3 = 0").select("id", F.lit("enterprise").alias("plan_type"), F.lit(None).cast("timestamp_ntz").alias("subscription_ends_at"))
    return R.patch(rows, updates)


@query("a46_retry_items", "SELECT batch_id, COUNT(*) FILTER (status IN ('failed', 'pending')) AS n_pending, COUNT(*) FILTER (status = 'completed') AS n_completed FROM batch_items GROUP BY batch_id")
def _(s, d):
    items = R.retry_failed(T.batch_items(s, d))
    return items.groupBy("batch_id").agg(F.count_if(F.col("status") == "pending").alias("n_pending"), F.count_if(F.col("status") == "completed").alias("n_completed"))


# ---- filters ----------------------------------------------------------------------------


@query("b01_by_stream", f"SELECT {H} FROM highlights WHERE stream_id = 12 AND confidence_score >= 0.6 AND highlight_type IN ('view', 'click')")
def _(s, d):
    wanted = R.all_of(F.col("stream_id") == 12, R.when_given(0.6, lambda v: F.col("confidence_score") >= v), R.when_given(["view", "click"], lambda v: F.col("highlight_type").isin(v)))
    return _h(T.highlights(s, d).where(wanted))


@query("b02_confidence_range", f"SELECT {', '.join('h.' + x for x in H.split(', '))} FROM highlights h JOIN streams s ON h.stream_id = s.id WHERE confidence_score BETWEEN 0.7 AND 0.9 AND s.user_id = (SELECT MIN(user_id) FROM streams WHERE id < 100)")
def _(s, d):
    streams = T.streams(s, d)
    user = streams.where("id < 100").agg(F.min("user_id").alias("user_id"))
    return _h(T.highlights(s, d).where(F.col("confidence_score").between(0.7, 0.9)).join(streams.join(user, "user_id", "left_semi").select(F.col("id").alias("stream_id")), "stream_id"))


@query("b03_by_type", f"SELECT {H} FROM highlights WHERE highlight_type = 'purchase' ORDER BY confidence_score DESC, id LIMIT 100")
def _(s, d):
    return _h(R.page(T.highlights(s, d).where("highlight_type = 'purchase'"), [F.desc("confidence_score"), F.col("id")], 100))


@query("b04_tags_any", f"SELECT {H} FROM highlights WHERE list_has_any(tags, ['error', 'k2'])")
def _(s, d):
    return _h(T.highlights(s, d).where(R.has_tags(["error", "k2"])))


@query("b04_tags_all", f"SELECT {H} FROM highlights WHERE list_has_all(tags, ['error', 'k2'])")
def _(s, d):
    return _h(T.highlights(s, d).where(R.has_tags(["error", "k2"], match_all=True)))


@query("b05_search", f"SELECT {H}, COALESCE(contains(lower(title), 'r'), FALSE) AS title_hit FROM highlights WHERE contains(lower(title), 'r') OR contains(lower(description), 'r') ORDER BY title_hit DESC, confidence_score DESC, id LIMIT 100")
def _(s, d):
    return R.search_highlights(T.highlights(s, d), "R", 100).select(*H.split(", "), "title_hit")


@query("b06_matches", "SELECT id, confidence_score >= 0.8 AND highlight_type = 'view' AND list_has_any(tags, ['k1', 'k3']) AS matches FROM highlights")
def _(s, d):
    return T.highlights(s, d).select("id", R.all_of(F.col("confidence_score") >= 0.8, F.col("highlight_type") == "view", R.has_tags(["k1", "k3"])).alias("matches"))


@query("b07_streams_of_user", "SELECT id, status, created_at FROM streams WHERE user_id = 31 AND status = 'completed' ORDER BY created_at DESC, id LIMIT 5 OFFSET 1")
def _(s, d):
    return R.page(T.streams(s, d).where("user_id = 31 AND status = 'completed'"), [F.desc("created_at"), F.col("id")], 5, 1).select("id", "status", "created_at")


@query("b08_active_streams", "SELECT id, status FROM streams WHERE status IN ('pending', 'processing')")
def _(s, d):
    return T.streams(s, d).where(F.col("status").isin("pending", "processing")).select("id", "status")


@query("b09_by_platform", "SELECT id, platform FROM streams WHERE platform = 'youtube' ORDER BY created_at DESC, id LIMIT 100 OFFSET 100")
def _(s, d):
    return R.page(T.streams(s, d).where("platform = 'youtube'"), [F.desc("created_at"), F.col("id")], 100, 100).select("id", "platform")


@query("b10_streams_between", "SELECT id, created_at FROM streams WHERE created_at BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1997-06-30'")
def _(s, d):
    return T.streams(s, d).where(F.col("created_at").between(NTZ("1997-01-01"), NTZ("1997-06-30"))).select("id", "created_at")


@query("b11_usage_of_user", "SELECT id, quantity FROM usage_records WHERE user_id = 0 AND usage_type = 'api_call' AND period_start >= TIMESTAMP '2024-01-05' AND (period_end <= TIMESTAMP '2024-01-20' OR period_end IS NULL)")
def _(s, d):
    return T.usage_records(s, d).where((F.col("user_id") == 0) & (F.col("usage_type") == "api_call") & R.in_period(NTZ("2024-01-05"), NTZ("2024-01-20"))).select("id", "quantity")


@query("b12_usage_of_organization", "SELECT id, quantity FROM usage_records WHERE organization_id = 7 AND period_start >= TIMESTAMP '2024-01-05'")
def _(s, d):
    return T.usage_records(s, d).where((F.col("organization_id") == 7) & R.in_period(NTZ("2024-01-05"))).select("id", "quantity")


@query("b13_usage_of_resource", "SELECT id, total_cost FROM usage_records WHERE resource_id = 5 AND resource_type = 'batch'")
def _(s, d):
    return T.usage_records(s, d).where("resource_id = 5 AND resource_type = 'batch'").select("id", "total_cost")


@query("b14_billable", "SELECT id, total_cost FROM usage_records WHERE billable AND user_id < 10 AND period_start >= TIMESTAMP '2024-01-02' AND (period_end <= TIMESTAMP '2024-01-12' OR period_end IS NULL)")
def _(s, d):
    return T.usage_records(s, d).where(F.col("billable") & (F.col("user_id") < 10) & R.in_period(NTZ("2024-01-02"), NTZ("2024-01-12"))).select("id", "total_cost")


@query("b15_usage_by_key", "SELECT id, quantity FROM usage_records WHERE api_key_id = 13 AND period_start >= TIMESTAMP '2024-01-03'")
def _(s, d):
    return T.usage_records(s, d).where((F.col("api_key_id") == 13) & R.in_period(NTZ("2024-01-03"))).select("id", "quantity")


@query("b16_incomplete", "SELECT id, user_id FROM usage_records WHERE period_end IS NULL AND period_start < TIMESTAMP '2024-01-20'")
def _(s, d):
    return T.usage_records(s, d).where(F.col("period_end").isNull() & (F.col("period_start") < NTZ("2024-01-20"))).select("id", "user_id")


@query("b17_webhooks_of_user", "SELECT id, status, url FROM webhooks WHERE user_id = 4 AND status = 'active'")
def _(s, d):
    return T.webhooks(s, d).where("user_id = 4 AND status = 'active'").select("id", "status", "url")


@query("b18_webhooks_for_event", "SELECT id, status FROM webhooks WHERE list_contains(events, 'O') AND status = 'active'")
def _(s, d):
    return T.webhooks(s, d).where(F.array_contains("events", "O") & (F.col("status") == "active")).select("id", "status")


@query("b20_active_for_event", "SELECT id FROM webhooks WHERE list_contains(events, 'F') AND status = 'active' AND user_id = 7")
def _(s, d):
    return T.webhooks(s, d).where(F.array_contains("events", "F") & (F.col("status") == "active") & (F.col("user_id") == 7)).select("id")


@query("b21_failing_webhooks", "SELECT id, consecutive_failures FROM webhooks WHERE consecutive_failures >= 5")
def _(s, d):
    return T.webhooks(s, d).where("consecutive_failures >= 5").select("id", "consecutive_failures")


@query("b22_by_success_rate", "SELECT id, ROUND(successful_deliveries / total_deliveries, 6) AS rate FROM webhooks WHERE total_deliveries >= 10 AND successful_deliveries / total_deliveries >= 0.35")
def _(s, d):
    rate = R.success_rate("successful_deliveries", "total_deliveries")
    return T.webhooks(s, d).where((F.col("total_deliveries") >= 10) & (rate >= 0.35)).select("id", F.round(rate, 6).alias("rate"))


@query("b23_webhooks_of_organization", "SELECT w.id, w.status FROM webhooks w WHERE w.user_id IN (SELECT user_id FROM memberships WHERE organization_id = 3 UNION SELECT owner_id FROM organizations WHERE id = 3)")
def _(s, d):
    return T.webhooks(s, d).join(R.members_of(T.organizations(s, d), T.memberships(s, d), F.col("id") == 3), "user_id", "left_semi").select("id", "status")


@query("b24_by_external_id", "SELECT event_id, platform, status FROM webhook_events WHERE event_id = 42 AND platform = 'twitch'")
def _(s, d):
    return T.webhook_events(s, d).where("event_id = 42 AND platform = 'twitch'").select("event_id", "platform", "status")


@query("b25_recent_events", "SELECT event_id, platform, received_at FROM webhook_events WHERE status = 'failed' AND platform = 'youtube' ORDER BY received_at DESC, event_id LIMIT 100")
def _(s, d):
    wanted = R.all_of(R.when_given("failed", lambda v: F.col("status") == v), R.when_given(None, lambda v: F.col("event_type") == v), R.when_given("youtube", lambda v: F.col("platform") == v))
    return R.page(T.webhook_events(s, d).where(wanted), [F.desc("received_at"), F.col("event_id")], 100).select("event_id", "platform", "received_at")


@query("b26_to_retry", "SELECT event_id, retry_count FROM webhook_events WHERE status = 'failed' AND retry_count < 3 ORDER BY received_at, event_id LIMIT 100")
def _(s, d):
    return R.page(T.webhook_events(s, d).where("status = 'failed' AND retry_count < 3"), [F.col("received_at"), F.col("event_id")], 100).select("event_id", "retry_count")


@query("b27_events_of_stream", "SELECT event_id, received_at FROM webhook_events WHERE stream_id = 17")
def _(s, d):
    return T.webhook_events(s, d).where("stream_id = 17").select("event_id", "received_at")


@query("b28_batches_of_user", "SELECT id, status FROM batches WHERE user_id = 55 AND status = 'pending' ORDER BY created_at DESC, id LIMIT 10")
def _(s, d):
    return R.page(T.batches(s, d).where("user_id = 55 AND status = 'pending'"), [F.desc("created_at"), F.col("id")], 10).select("id", "status")


@query("b29_active_batches", "SELECT id, created_at FROM batches WHERE status IN ('pending', 'processing')")
def _(s, d):
    return T.batches(s, d).where(F.col("status").isin("pending", "processing")).select("id", "created_at")


@query("b31_batches_by_rate", "SELECT id, ROUND(successful_items / total_items, 6) AS rate FROM batches WHERE total_items > 0 AND successful_items / total_items >= 0.8")
def _(s, d):
    rate = R.success_rate("successful_items", "total_items")
    return T.batches(s, d).where(rate >= 0.8).select("id", F.round(rate, 6).alias("rate"))


@query("b33_organization_by_name", "SELECT id, name, owner_id FROM organizations WHERE name = (SELECT MIN(name) FROM organizations)")
def _(s, d):
    organizations = T.organizations(s, d)
    return organizations.join(organizations.agg(F.min("name").alias("name")), "name", "left_semi").select("id", "name", "owner_id")


@query("b34_search_organizations", "SELECT id, name, lower(name) = 'a' AS exact FROM organizations WHERE contains(lower(name), 'a') ORDER BY exact DESC, name, id LIMIT 50")
def _(s, d):
    found = T.organizations(s, d).where(R.search_order("a", "name")).withColumn("exact", F.lower("name") == "a")
    return R.page(found, [F.desc("exact"), F.col("name"), F.col("id")], 50).select("id", "name", "exact")


@query("b35_by_plan", "SELECT id, owner_id FROM organizations WHERE plan_type = 'enterprise'")
def _(s, d):
    return T.organizations(s, d).where("plan_type = 'enterprise'").select("id", "owner_id")


@query("b36_active_organizations", "SELECT id FROM organizations WHERE is_active AND (subscription_ends_at IS NULL OR subscription_ends_at > TIMESTAMP '1998-06-01')")
def _(s, d):
    return T.organizations(s, d).where(F.col("is_active") & (F.col("subscription_ends_at").isNull() | (F.col("subscription_ends_at") > NTZ("1998-06-01")))).select("id")


@query("b37_expiring_soon", "SELECT id, subscription_ends_at FROM organizations WHERE is_active AND subscription_ends_at > TIMESTAMP '1998-06-01' AND subscription_ends_at <= TIMESTAMP '1998-10-01'")
def _(s, d):
    end = F.col("subscription_ends_at")
    return T.organizations(s, d).where(F.col("is_active") & (end > NTZ("1998-06-01")) & (end <= NTZ("1998-10-01"))).select("id", "subscription_ends_at")


@query("b38_by_usage", "SELECT o.id, ROUND(SUM(u.quantity), 4) AS quantity FROM organizations o JOIN usage_records u ON u.organization_id = o.id WHERE o.is_active GROUP BY o.id HAVING SUM(u.quantity) >= 1000")
def _(s, d):
    sums = T.usage_records(s, d).groupBy(F.col("organization_id").alias("id")).agg(F.sum("quantity").alias("quantity")).where("quantity >= 1000")
    return T.organizations(s, d).where("is_active").join(sums, "id").select("id", F.round("quantity", 4).alias("quantity"))


@query("b39_user_by_email", "SELECT id, email FROM users WHERE email = (SELECT MIN(email) FROM users)")
def _(s, d):
    users = T.users(s, d)
    return users.join(users.agg(F.min("email").alias("email")), "email", "left_semi").select("id", "email")


@query("b41_by_company", "SELECT id, company_name FROM users WHERE company_name ILIKE '%0001%'")
def _(s, d):
    return T.users(s, d).where(F.col("company_name").ilike("%0001%")).select("id", "company_name")


@query("b42_by_key_hash", "SELECT id FROM api_keys WHERE key_hash = (SELECT MIN(key_hash) FROM api_keys)")
def _(s, d):
    keys = T.api_keys(s, d)
    return keys.join(keys.agg(F.min("key_hash").alias("key_hash")), "key_hash", "left_semi").select("id")


@query("b43_keys_of_user", "SELECT id, is_active FROM api_keys WHERE user_id = 20 AND is_active")
def _(s, d):
    return T.api_keys(s, d).where("user_id = 20 AND is_active").select("id", "is_active")


@query("b44_active_keys", "SELECT id FROM api_keys WHERE is_active AND (expires_at IS NULL OR expires_at > TIMESTAMP '2024-02-01')")
def _(s, d):
    return T.api_keys(s, d).where(F.col("is_active") & (F.col("expires_at").isNull() | (F.col("expires_at") > NTZ("2024-02-01")))).select("id")


@query("b45_keys_expiring", "SELECT id, expires_at FROM api_keys WHERE is_active AND expires_at > TIMESTAMP '2024-01-10' AND expires_at <= TIMESTAMP '2024-01-17'")
def _(s, d):
    return T.api_keys(s, d).where(F.col("is_active") & (F.col("expires_at") > NTZ("2024-01-10")) & (F.col("expires_at") <= NTZ("2024-01-17"))).select("id", "expires_at")


@query("b46_by_scope", "SELECT id FROM api_keys WHERE list_contains(scopes, 'webhooks:read') AND is_active")
def _(s, d):
    return T.api_keys(s, d).where(F.array_contains("scopes", "webhooks:read") & F.col("is_active")).select("id")


@query("b55_listing", f"SELECT {H}, (SELECT COUNT(*) FROM highlights WHERE highlight_type = 'view' AND confidence_score >= 0.7) AS total FROM highlights WHERE highlight_type = 'view' AND confidence_score >= 0.7 ORDER BY confidence_score DESC, id LIMIT 20 OFFSET 40")
def _(s, d):
    found = T.highlights(s, d).where("highlight_type = 'view' AND confidence_score >= 0.7")
    return _h(R.page(found, [F.desc("confidence_score"), F.col("id")], 20, 40)).withColumn("total", found.agg(F.count("*")).scalar())


# ---- joins ------------------------------------------------------------------------------


@query("j01_highlights_of_user", "SELECT h.id, h.created_at FROM highlights h JOIN streams s ON h.stream_id = s.id WHERE s.user_id IN (SELECT user_id FROM streams WHERE id = 3) ORDER BY h.created_at DESC, h.id LIMIT 100")
def _(s, d):
    streams = T.streams(s, d)
    own = streams.join(streams.where("id = 3").select("user_id"), "user_id", "left_semi").select(F.col("id").alias("stream_id"))
    return R.page(T.highlights(s, d).join(own, "stream_id"), [F.desc("created_at"), F.col("id")], 100).select("id", "created_at")


@query("j02_organizations_of_member", "SELECT o.id, o.name FROM organizations o JOIN memberships m ON m.organization_id = o.id WHERE m.user_id = 44")
def _(s, d):
    mine = T.memberships(s, d).where("user_id = 44").select(F.col("organization_id").alias("id"))
    return T.organizations(s, d).join(mine, "id").select("id", "name")


@query("j03_streams_of_organization", "SELECT id, user_id, status FROM streams WHERE user_id IN (SELECT user_id FROM memberships WHERE organization_id = 5 UNION SELECT owner_id FROM organizations WHERE id = 5)")
def _(s, d):
    return T.streams(s, d).join(R.members_of(T.organizations(s, d), T.memberships(s, d), F.col("id") == 5), "user_id", "left_semi").select("id", "user_id", "status")


@query("j04_users_of_organization", "SELECT id, email FROM users WHERE id IN (SELECT user_id FROM memberships WHERE organization_id = 8 UNION SELECT owner_id FROM organizations WHERE id = 8)")
def _(s, d):
    chosen = R.members_of(T.organizations(s, d), T.memberships(s, d), F.col("id") == 8).withColumnRenamed("user_id", "id")
    return T.users(s, d).join(chosen, "id", "left_semi").select("id", "email")


@query("j05_with_highlights", "SELECT s.id, h.id AS highlight_id, CASE WHEN h.id IS NOT NULL THEN CAST(ROW_NUMBER() OVER (PARTITION BY h.stream_id ORDER BY h.confidence_score DESC, h.id) AS INTEGER) END AS nth FROM streams s LEFT JOIN highlights h ON h.stream_id = s.id")
def _(s, d):
    return R.with_highlights(T.streams(s, d), T.highlights(s, d)).select("id", "highlight_id", "nth")


@query("j05c_with_items", "SELECT b.id, b.status, i.line, i.item_id, i.status AS item_status FROM batches b LEFT JOIN batch_items i ON i.batch_id = b.id WHERE b.status IN ('processing', 'partially_failed')")
def _(s, d):
    items = T.batch_items(s, d).select(F.col("batch_id").alias("id"), "line", "item_id", F.col("status").alias("item_status"))
    return T.batches(s, d).where("status IN ('processing', 'partially_failed')").select("id", "status").join(items, "id", "left")


@query("j05d_organizations_with_owner", "SELECT o.id, o.name, u.email, COALESCE(n, 0) AS n_records, ROUND(COALESCE(cost, 0), 4) AS cost FROM organizations o LEFT JOIN users u ON u.id = o.owner_id LEFT JOIN (SELECT organization_id, COUNT(*) AS n, SUM(total_cost) AS cost FROM usage_records GROUP BY 1) r ON r.organization_id = o.id")
def _(s, d):
    used = T.usage_records(s, d).groupBy(F.col("organization_id").alias("id")).agg(F.count("*").alias("n"), F.sum("total_cost").alias("cost"))
    owners = T.users(s, d).select(F.col("id").alias("owner_id"), "email")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return T.organizations(s, d).join(owners, "owner_id", "left").join(used, "id", "left").select("id", "name", "email", zero("n").alias("n_records"), F.round(zero("cost"), 4).alias("cost"))


@query("j05b_users_with_keys", "SELECT u.id, COUNT(k.id) AS n_keys FROM users u LEFT JOIN api_keys k ON k.user_id = u.id GROUP BY u.id")
def _(s, d):
    counts = T.api_keys(s, d).groupBy(F.col("user_id").alias("id")).agg(F.count("*").alias("n_keys"))
    return T.users(s, d).select("id").join(counts, "id", "left").select("id", F.coalesce("n_keys", F.lit(0)).alias("n_keys"))


# ---- aggregations -----------------------------------------------------------------------


@query("d01_highlight_statistics", "SELECT highlight_type, COUNT(*) AS n, ROUND(AVG(confidence_score), 8) AS avg_confidence, COUNT(*) FILTER (confidence_score >= 0.8) AS n_high, ROUND(100 * COUNT(*) FILTER (confidence_score >= 0.8) / COUNT(*), 6) AS high_percent FROM highlights h JOIN streams s ON s.id = h.stream_id GROUP BY ROLLUP (highlight_type)")
def _(s, d):
    return R.highlight_statistics(T.highlights(s, d).join(T.streams(s, d).select(F.col("id").alias("stream_id")), "stream_id"))


@query("d01_top_tags", "SELECT tag, COUNT(*) AS n FROM (SELECT UNNEST(tags) AS tag FROM highlights) GROUP BY tag ORDER BY n DESC, tag LIMIT 10")
def _(s, d):
    return R.top_tags(T.highlights(s, d))


_STATUS = ", ".join(f"('{x}')" for x in R.STREAM_STATUSES)


@query("d02_count_by_status", f"SELECT v.status, COUNT(s.id) AS n FROM (VALUES {_STATUS}) v(status) LEFT JOIN streams s ON s.status = v.status GROUP BY v.status")
def _(s, d):
    return R.listed(T.streams(s, d), "status", R.STREAM_STATUSES, [F.count("*").alias("n")])


@query("d03_stream_stats", "SELECT user_id, " + ", ".join(f"COUNT(*) FILTER (status = '{x}') AS n_{x}" for x in R.STREAM_STATUSES) + ", ROUND(AVG(date_diff('microsecond', started_at, completed_at) / 1e6::DOUBLE), 3) AS avg_seconds, ROUND(SUM(duration) / 60, 8) AS minutes FROM streams GROUP BY user_id")
def _(s, d):
    return R.stream_stats(T.streams(s, d))


_TOTALS = "COUNT(*) AS n, ROUND(COALESCE(SUM(quantity), 0), 4) AS quantity, ROUND(COALESCE(SUM(total_cost), 0), 4) AS cost, ROUND(COALESCE(AVG(quantity), 0), 8) AS avg_quantity"


@query("d04_usage_totals", f"SELECT user_id, usage_type, {_TOTALS} FROM usage_records WHERE period_start >= TIMESTAMP '2024-01-05' AND (period_end <= TIMESTAMP '2024-01-25' OR period_end IS NULL) GROUP BY user_id, usage_type")
def _(s, d):
    return T.usage_records(s, d).where(R.in_period(NTZ("2024-01-05"), NTZ("2024-01-25"))).groupBy("user_id", "usage_type").agg(*R.usage_totals())


_TYPES = ", ".join(f"('{x}')" for x in T.USAGE_TYPES)


@query("d05_usage_by_type", f"SELECT v.usage_type, COUNT(u.id) AS n, ROUND(COALESCE(SUM(quantity), 0), 4) AS quantity FROM (VALUES {_TYPES}) v(usage_type) LEFT JOIN (SELECT * FROM usage_records WHERE user_id = 3) u ON u.usage_type = v.usage_type GROUP BY v.usage_type")
def _(s, d):
    return R.listed(T.usage_records(s, d).where("user_id = 3"), "usage_type", T.USAGE_TYPES, [F.count("*").alias("n"), F.round(F.sum("quantity"), 4).alias("quantity")])


@query("d06_usage_analytics", "SELECT usage_type, COUNT(*) AS n, ROUND(SUM(quantity), 4) AS quantity, ROUND(SUM(total_cost), 4) AS cost, COUNT(*) FILTER (billable) AS billable_n, ROUND(SUM(CASE WHEN billable THEN total_cost ELSE 0 END), 4) AS billable_cost, COUNT(*) FILTER (NOT billable) AS unbillable_n FROM usage_records WHERE period_start >= TIMESTAMP '2024-01-01' GROUP BY ROLLUP (usage_type)")
def _(s, d):
    return R.usage_analytics(T.usage_records(s, d).where(R.in_period(NTZ("2024-01-01"))))


@query("d07_top_consumers", "SELECT user_id, ROUND(SUM(quantity), 4) AS quantity, COUNT(*) AS n FROM usage_records WHERE usage_type = 'api_call' GROUP BY user_id ORDER BY quantity DESC, user_id LIMIT 10")
def _(s, d):
    return R.top_consumers(T.usage_records(s, d), "api_call")


@query("d08_billing_summary", "SELECT user_id, usage_type, ROUND(SUM(quantity), 4) AS quantity, ROUND(SUM(total_cost), 4) AS cost, COUNT(*) AS n, arg_min(unit, {'a': period_start, 'b': id}) AS unit FROM usage_records WHERE billable GROUP BY user_id, usage_type")
def _(s, d):
    return R.billing_summary(T.usage_records(s, d))


@query("d10_batch_stats", "SELECT status, COUNT(*) AS n, ROUND(AVG(successful_items / NULLIF(total_items, 0)), 6) AS mean_ratio, ROUND(SUM(successful_items) / NULLIF(SUM(total_items), 0), 6) AS ratio_of_sums, ROUND(AVG(total_items), 6) AS avg_size, ROUND(AVG(date_diff('microsecond', created_at, completed_at) / 3.6e9::DOUBLE), 4) AS avg_hours FROM batches GROUP BY status")
def _(s, d):
    return R.batch_stats(T.batches(s, d))


@query("d11_failed_items", "SELECT batch_id, created_at, item_id, line, COUNT(*) AS times FROM (SELECT id, created_at FROM batches ORDER BY created_at DESC, id LIMIT 100) b JOIN batch_items i ON i.batch_id = b.id WHERE i.status = 'failed' GROUP BY ALL ORDER BY created_at DESC, batch_id, line, item_id LIMIT 100")
def _(s, d):
    return R.failed_items(T.batches(s, d), T.batch_items(s, d), 100)


@query("d12_queue_stats", "SELECT COUNT(*) FILTER (status = 'pending') AS n_pending, COUNT(*) FILTER (status = 'processing') AS n_processing, MIN(created_at) FILTER (status = 'pending') AS oldest, ROUND(AVG(date_diff('microsecond', created_at, TIMESTAMP '2002-01-01') / 3.6e9::DOUBLE) FILTER (status = 'pending'), 3) AS avg_wait_hours FROM batches")
def _(s, d):
    return R.queue_stats(T.batches(s, d), "2002-01-01")


@query("d13_user_batches", "SELECT user_id, COUNT(*) AS n, COUNT(*) FILTER (status = 'completed') AS n_completed, ROUND(SUM(successful_items) / NULLIF(SUM(total_items), 0), 6) AS success_rate, ROUND(AVG(total_items), 6) AS avg_size FROM batches GROUP BY user_id")
def _(s, d):
    return T.batches(s, d).groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "completed").alias("n_completed"), F.round(F.try_divide(F.sum("successful_items"), F.sum("total_items")), 6).alias("success_rate"), F.round(F.avg("total_items"), 6).alias("avg_size"))


_HOOKS = ", ".join(f"('{x}')" for x in R.WEBHOOK_STATUSES)


@query("d14_webhooks_by_status", f"SELECT v.status, COUNT(w.id) AS n FROM (VALUES {_HOOKS}) v(status) LEFT JOIN webhooks w ON w.status = v.status AND w.user_id < 5 GROUP BY v.status")
def _(s, d):
    return R.listed(T.webhooks(s, d).where("user_id < 5"), "status", R.WEBHOOK_STATUSES, [F.count("*").alias("n")])


@query("d15_delivery_stats", "SELECT id, total_deliveries - successful_deliveries AS failed_deliveries, ROUND(COALESCE(successful_deliveries / NULLIF(total_deliveries, 0), 0), 6) AS success_rate FROM webhooks")
def _(s, d):
    return R.webhook_rates(T.webhooks(s, d)).select("id", "failed_deliveries", F.round("success_rate", 6).alias("success_rate"))


@query("d16_webhook_events", "SELECT event, COUNT(*) AS n, ROUND(AVG(successful_deliveries / NULLIF(total_deliveries, 0)), 6) AS mean_rate, SUM(total_deliveries)::BIGINT AS deliveries FROM (SELECT UNNEST(events) AS event, * FROM webhooks) GROUP BY event")
def _(s, d):
    return T.webhooks(s, d).select("*", F.explode("events").alias("event")).groupBy("event").agg(F.count("*").alias("n"), F.round(F.avg(R.success_rate("successful_deliveries", "total_deliveries")), 6).alias("mean_rate"), F.sum("total_deliveries").alias("deliveries"))


_PLANS = ", ".join(f"('{x}')" for x in R.PLANS)


@query("d17_by_plan", f"SELECT v.plan_type, COUNT(o.id) AS n FROM (VALUES {_PLANS}) v(plan_type) LEFT JOIN organizations o ON o.plan_type = v.plan_type GROUP BY v.plan_type")
def _(s, d):
    return R.listed(T.organizations(s, d), "plan_type", R.PLANS, [F.count("*").alias("n")])


@query("d19_key_usage", "SELECT api_key_id, usage_type, COUNT(*) AS n, ROUND(SUM(quantity), 4) AS quantity FROM usage_records WHERE period_start >= TIMESTAMP '2024-01-10' GROUP BY api_key_id, usage_type")
def _(s, d):
    return T.usage_records(s, d).where(R.in_period(NTZ("2024-01-10"))).groupBy("api_key_id", "usage_type").agg(F.count("*").alias("n"), F.round(F.sum("quantity"), 4).alias("quantity"))


@query("d19b_keys_per_user", "SELECT user_id, COUNT(*) FILTER (is_active) AS n FROM api_keys GROUP BY user_id")
def _(s, d):
    return T.api_keys(s, d).groupBy("user_id").agg(F.count_if("is_active").alias("n"))


@query("d44_webhook_health", """SELECT id, health, CASE WHEN health >= 90 THEN 'healthy' WHEN health >= 70 THEN 'degraded' WHEN health >= 50 THEN 'unhealthy' ELSE 'critical' END AS level,
  array_to_string(list_filter([CASE WHEN consecutive_failures >= 5 THEN 'check the endpoint' END, CASE WHEN rate < 0.9 THEN 'review the error log' END, CASE WHEN status <> 'active' THEN 'activate the webhook' END], lambda x: x IS NOT NULL), '; ') AS advice
  FROM (SELECT *, CAST(GREATEST(100 - LEAST(10 * consecutive_failures, 50) - CASE WHEN rate < 0.95 THEN floor((1 - rate) * 30) ELSE 0 END - CASE WHEN status <> 'active' THEN 20 ELSE 0 END, 0) AS BIGINT) AS health
        FROM (SELECT *, COALESCE(successful_deliveries / NULLIF(total_deliveries, 0), 1) AS rate FROM webhooks))""")
def _(s, d):
    return R.webhook_health(T.webhooks(s, d)).select("id", "health", "level", "advice")


# ---- top-k ------------------------------------------------------------------------------


@query("l01_trending", "SELECT id, stream_id, ROUND(0.4::DOUBLE * confidence_score + 0.3::DOUBLE * COALESCE(viewer_engagement, 0) + 0.3::DOUBLE * exp(-(date_diff('microsecond', created_at, TIMESTAMP '2024-01-31') / 1e6::DOUBLE) / 86400), 6) AS trend FROM highlights WHERE created_at >= TIMESTAMP '2024-01-20' ORDER BY trend DESC, id LIMIT 10")
def trending(s, d):
    return R.trending(T.highlights(s, d), "2024-01-31", "2024-01-20").select("id", "stream_id", "trend")


@query("l02_page_of_stream", "SELECT id, start_time, (SELECT COUNT(*) FROM highlights WHERE stream_id = 6) AS total, CAST(ceil((SELECT COUNT(*) FROM highlights WHERE stream_id = 6) / 10) AS BIGINT) AS pages, (SELECT COUNT(*) FROM highlights WHERE stream_id = 6) > 30 AS has_next, TRUE AS has_prev FROM highlights WHERE stream_id = 6 ORDER BY start_time, id LIMIT 10 OFFSET 20")
def _(s, d):
    rows = T.highlights(s, d).where("stream_id = 6")
    paged = R.page(rows.select("id", "start_time"), [F.col("start_time"), F.col("id")], 10, 20)
    return paged.withColumn("n", rows.agg(F.count("*")).scalar()).select("id", "start_time", *R.page_meta(F.col("n"), 10, 20))


@query("l03_next_batch", "SELECT id, created_at FROM batches WHERE status = 'pending' ORDER BY created_at, id LIMIT 1")
def _(s, d):
    return R.page(T.batches(s, d).where("status = 'pending'"), [F.col("created_at"), F.col("id")], 1).select("id", "created_at")


@query("l05_by_importance", """SELECT stream_id, id, importance, nth FROM (SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY stream_id ORDER BY importance DESC, id) AS INTEGER) AS nth FROM (
  SELECT *, ROUND(LEAST(0.4::DOUBLE * confidence_score + 0.3::DOUBLE * COALESCE(viewer_engagement, 0) + 0.2::DOUBLE * abs(COALESCE(sentiment_score, 0)) + CASE WHEN end_time - start_time BETWEEN 10 AND 60 THEN 0.1::DOUBLE WHEN end_time - start_time <= 90 THEN 0.05::DOUBLE ELSE 0 END, 1), 6) AS importance FROM highlights)) WHERE nth <= 3""")
def _(s, d):
    return R.top_per(R.importance(T.highlights(s, d)), ["stream_id"], [F.desc("importance"), F.col("id")], 3).select("stream_id", "id", "importance", "nth")
