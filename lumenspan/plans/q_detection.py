"""Queries of scalar functions, billing and reports with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenspan.functions import scalar as C
from lumenspan.operators import billing as B
from lumenspan.operators.relational import in_period
from lumenspan.plans.prelude import with_tables
from lumenspan.sources import tables as T

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None):
    """Register a query under ``name`` together with its SQL."""

    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = with_tables(sql)
        return f

    return add


def rounded(df, *names, digits=6):
    return df.withColumns({n: F.round(n, digits) for n in names})


def NTZ(s):
    return F.lit(s).cast("timestamp_ntz")


# ---- scalars -----------------------------------------------------------------------------


@query("h01_normalize", "SELECT event_id, ROUND(GREATEST(0, LEAST(1, (value - 50) / 150)), 9) AS linear, ROUND(1 / (1 + exp(-value / 100)), 6) AS sigmoid, ROUND((tanh(value / 100) + 1) / 2, 6) AS tanh FROM events")
def _(s, d):
    v = F.col("value")
    return T.read(s, d, "events").select("event_id", F.round(C.normalize(v, 50, 200), 9).alias("linear"), F.round(C.normalize(v / 100, method="sigmoid"), 6).alias("sigmoid"), F.round(C.normalize(v / 100, method="tanh"), 6).alias("tanh"))


@query("h02_weighted_score", "SELECT id, ROUND((0.5 * confidence_score + 0.3 * viewer_engagement + CASE WHEN highlight_type <> 'error' THEN 0.2 * sentiment_score ELSE 0 END) / (0.8 + CASE WHEN highlight_type <> 'error' THEN 0.2 ELSE 0 END), 10) AS score FROM highlights")
def _(s, d):
    scores = {"confidence": F.col("confidence_score"), "engagement": F.col("viewer_engagement"), "sentiment": F.when(F.col("highlight_type") != "error", F.col("sentiment_score"))}
    return T.highlights(s, d).select("id", F.round(C.weighted(scores, {"confidence": 0.5, "engagement": 0.3, "sentiment": 0.2}), 10).alias("score"))


_DOT = "list_sum(list_transform(range(1, 65), lambda i: {a}[i] * {b}[i]))"
_SIM = f"""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings), p AS (SELECT a.vec_id, a.x AS x, b.x AS y FROM v a JOIN v b ON b.vec_id = a.vec_id + 1)
  SELECT vec_id, ROUND({_DOT.format(a='x', b='y')} / (sqrt({_DOT.format(a='x', b='x')}) * sqrt({_DOT.format(a='y', b='y')})), 6) AS cosine, ROUND(GREATEST(0, 1 - sqrt(list_sum(list_transform(range(1, 65), lambda i: (x[i] - y[i]) * (x[i] - y[i])))) / sqrt(64)), 6) AS euclidean,
  ROUND(list_sum(list_transform(range(1, 65), lambda i: (x[i] > 0 AND y[i] > 0)::INT)) / list_sum(list_transform(range(1, 65), lambda i: (x[i] > 0 OR y[i] > 0)::INT)), 6) AS jaccard FROM p"""


@query("h03_similarity", _SIM)
def _(s, d):
    v = T.read(s, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    pairs = v.join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y")), "vec_id")
    x, y = F.col("x"), F.col("y")
    return rounded(pairs.select("vec_id", C.cosine(x, y).alias("cosine"), C.euclidean(x, y).alias("euclidean"), C.jaccard_positive(x, y).alias("jaccard")), "cosine", "euclidean", "jaccard")


@query("h05_levels", """SELECT id, CASE WHEN confidence_score >= 0.9 THEN 'very_high' WHEN confidence_score >= 0.7 THEN 'high' WHEN confidence_score >= 0.5 THEN 'medium' ELSE 'low' END AS confidence,
  CASE WHEN viewer_engagement >= 0.8 THEN 'viral' WHEN viewer_engagement >= 0.6 THEN 'high' WHEN viewer_engagement >= 0.4 THEN 'medium' WHEN viewer_engagement >= 0.2 THEN 'low' ELSE 'minimal' END AS engagement,
  CASE WHEN sentiment_score > 0.5 THEN 'positive' WHEN sentiment_score < -0.5 THEN 'negative' ELSE 'neutral' END AS sentiment FROM highlights""")
def _(s, d):
    return T.highlights(s, d).select("id", C.confidence_level(F.col("confidence_score")).alias("confidence"), C.engagement_level(F.col("viewer_engagement")).alias("engagement"), C.sentiment_label(F.col("sentiment_score")).alias("sentiment"))


@query("h50_names", """SELECT id, trim(regexp_replace(lower(company_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug, split_part(email, '@', -1) AS domain, regexp_replace(company_name, '[^A-Za-z0-9._-]+', '_', 'g') AS file_name FROM users""")
def _(s, d):
    return T.users(s, d).select("id", C.slug(F.col("company_name")).alias("slug"), C.email_domain(F.col("email")).alias("domain"), C.file_name(F.col("company_name")).alias("file_name"))


@query("h50_duration", "SELECT id, CASE WHEN v >= 3600 THEN (v // 3600) || 'h ' || ((v % 3600) // 60) || 'm ' || (v % 60) || 's' WHEN v >= 60 THEN (v // 60) || 'm ' || (v % 60) || 's' ELSE v || 's' END AS length FROM (SELECT id, CAST(floor(duration) AS BIGINT) AS v FROM streams)")
def _(s, d):
    return T.streams(s, d).select("id", C.duration_text(F.col("duration")).alias("length"))


@query("h57_hosts", "SELECT page_id, lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)', 1)) AS host, 'custom' AS platform FROM pages")
def _(s, d):
    return T.read(s, d, "pages").select("page_id", C.url_host(F.col("url")).alias("host"), C.url_platform(F.col("url")).alias("platform"))


@query("h69_retry_delay", "SELECT event_id, LEAST(60 * pow(2, retry_count), 3600)::DOUBLE AS delay FROM webhook_events")
def _(s, d):
    return T.webhook_events(s, d).select("event_id", C.retry_delay(F.col("retry_count")).alias("delay"))


# ---- billing -----------------------------------------------------------------------------

_PLAN = "plans(plan_type, " + ", ".join(B.LIMIT_NAMES) + ") AS (VALUES " + ", ".join(f"('{p}', {', '.join(map(str, v))})" for p, v in B.LIMITS.items()) + ")"
_RATES = "rates(plan_type, usage_type, plan_rate) AS (VALUES " + ", ".join(f"('{p}', '{k}', {r:f}::DOUBLE)" for p, v in B.RATES.items() for k, r in zip(B.RATE_NAMES, v, strict=True)) + ")"
_HOME = "home AS (SELECT COALESCE(o.user_id, m.user_id) AS user_id, COALESCE(owned, joined) AS home_id FROM (SELECT owner_id AS user_id, MIN(id) AS owned FROM organizations WHERE owner_id IS NOT NULL GROUP BY 1) o FULL JOIN (SELECT user_id, MIN(organization_id) AS joined FROM memberships GROUP BY 1) m ON o.user_id = m.user_id)"
_OWN = f"{_HOME}, own AS (SELECT h.user_id, h.home_id, o.plan_type FROM home h JOIN organizations o ON o.id = h.home_id)"


def _plan(s, d):
    return B.plan_of(T.organizations(s, d), T.memberships(s, d))


@query("j17_home_organization", f"WITH {_HOME} SELECT user_id, home_id AS organization_id FROM home")
def _(s, d):
    return B.organization_of(T.organizations(s, d), T.memberships(s, d))


@query("j18_priced_usage", f"WITH {_RATES}, {_OWN} SELECT u.id, o.plan_type, ROUND(CASE WHEN billable THEN quantity * plan_rate ELSE 0 END, 8) AS plan_cost FROM usage_records u JOIN own o USING (user_id) JOIN rates r ON r.plan_type = o.plan_type AND r.usage_type = u.usage_type")
def _(s, d):
    return rounded(B.priced(T.usage_records(s, d), _plan(s, d)).select("id", "plan_type", "plan_cost"), "plan_cost", digits=8)


@query("j19_priced_batches", f"""WITH {_RATES}, {_OWN} SELECT b.id, o.plan_type, ROUND(CASE WHEN total_items > 0 THEN successful_items * (total_items * 1.5 / total_items) ELSE 0 END, 6) AS minutes, ROUND(CASE WHEN total_items > 0 THEN successful_items * (total_items * 1.5 / total_items) ELSE 0 END * plan_rate, 8) AS plan_cost
  FROM batches b JOIN own o USING (user_id) JOIN rates r ON r.plan_type = o.plan_type AND r.usage_type = 'batch_processing'""")
def _(s, d):
    found = B.priced(B.batch_usage(T.batches(s, d), F.col("total_items") * 1.5), _plan(s, d))
    return found.select("id", "plan_type", F.round("quantity", 6).alias("minutes"), F.round("plan_cost", 8).alias("plan_cost"))


@query("j20_priced_calls", f"WITH {_RATES}, {_OWN} SELECT e.event_id AS id, e.k < 90 AS billable, ROUND(CASE WHEN e.k < 90 THEN plan_rate ELSE 0 END, 8) AS plan_cost FROM ev e JOIN own o USING (user_id) JOIN rates r ON r.plan_type = o.plan_type AND r.usage_type = 'api_call' WHERE e.event_type = 'click'")
def _(s, d):
    status = F.when(F.col("k") < 90, 200).otherwise(500)
    calls = T.numbered_events(s, d).where("event_type = 'click'").select(F.col("event_id").alias("id"), "user_id", F.lit("api_call").alias("usage_type"), F.lit(1.0).alias("quantity"), status.between(200, 299).alias("billable"))
    return rounded(B.priced(calls, _plan(s, d)).select("id", "billable", "plan_cost"), "plan_cost", digits=8)


@query("j21_priced_deliveries", f"WITH {_RATES}, {_OWN} SELECT e.event_id AS id, e.status = 'processed' AS billable, ROUND(CASE WHEN e.status = 'processed' THEN plan_rate ELSE 0 END, 8) AS plan_cost FROM webhook_events e JOIN own o ON o.user_id = e.stream_id JOIN rates r ON r.plan_type = o.plan_type AND r.usage_type = 'webhook_delivery'")
def _(s, d):
    sent = T.webhook_events(s, d).select(F.col("event_id").alias("id"), F.col("stream_id").alias("user_id"), F.lit("webhook_delivery").alias("usage_type"), F.lit(1.0).alias("quantity"), (F.col("status") == "processed").alias("billable"))
    return rounded(B.priced(sent, _plan(s, d)).select("id", "billable", "plan_cost"), "plan_cost", digits=8)


@query("j16_quotas", f"""WITH {_PLAN} SELECT o.id, o.plan_type, COALESCE(members, 0) AS members, ROUND(COALESCE(minutes, 0), 4) AS minutes, ROUND(100 * COALESCE(members, 0) / max_members, 6) AS member_percent, COALESCE(members, 0) > max_members OR COALESCE(minutes, 0) > max_minutes AS is_over
  FROM organizations o JOIN plans p ON p.plan_type = o.plan_type LEFT JOIN (SELECT organization_id, COUNT(DISTINCT user_id) AS members FROM memberships GROUP BY 1) m ON m.organization_id = o.id LEFT JOIN (SELECT organization_id, SUM(quantity) AS minutes FROM usage_records WHERE usage_type = 'stream_processing' GROUP BY 1) u ON u.organization_id = o.id""")
def _(s, d):
    return rounded(B.quota_use(T.organizations(s, d), T.memberships(s, d), T.usage_records(s, d)), "minutes", digits=4)


@query("h67_plan_limits", f"WITH {_PLAN} SELECT o.id, {', '.join(f'p.{n}' for n in B.LIMIT_NAMES)} FROM organizations o JOIN plans p USING (plan_type)")
def _(s, d):
    return T.organizations(s, d).join(B.plans(s), "plan_type").select("id", *B.LIMIT_NAMES)


@query("s36_concurrent_streams", f"WITH {_PLAN}, {_OWN} SELECT o.user_id, o.plan_type, COALESCE(n, 0) AS active, max_streams, COALESCE(n, 0) < max_streams AS may_start FROM own o JOIN plans p USING (plan_type) LEFT JOIN (SELECT user_id, COUNT(*) AS n FROM streams WHERE status IN ('pending', 'processing') GROUP BY 1) a ON a.user_id = o.user_id")
def _(s, d):
    return B.active_streams(T.streams(s, d), _plan(s, d))


@query("d18_organization_analytics", f"""WITH {_PLAN} SELECT o.id, o.plan_type, COALESCE(m.n, 0) AS members, ROUND(100 * COALESCE(m.n, 0) / max_members, 6) AS member_percent, COALESCE(k.n, 0) AS n_records
  FROM organizations o JOIN plans USING (plan_type) LEFT JOIN (SELECT organization_id, COUNT(DISTINCT user_id) AS n FROM memberships GROUP BY 1) m ON m.organization_id = o.id LEFT JOIN (SELECT organization_id, COUNT(*) AS n FROM usage_records GROUP BY 1) k ON k.organization_id = o.id""")
def _(s, d):
    quotas = B.quota_use(T.organizations(s, d), T.memberships(s, d), T.usage_records(s, d))
    records = T.usage_records(s, d).groupBy(F.col("organization_id").alias("id")).agg(F.count("*").alias("n_records"))
    return quotas.join(records, "id", "left").select("id", "plan_type", "members", "member_percent", F.coalesce("n_records", F.lit(0)).alias("n_records"))


@query("d41_member_activity", "SELECT organization_id, m.user_id, COALESCE(n, 0) AS n_streams, last_active FROM memberships m LEFT JOIN (SELECT user_id, COUNT(*) AS n, MAX(created_at) AS last_active FROM streams GROUP BY 1) s USING (user_id)")
def _(s, d):
    return B.member_activity(T.memberships(s, d), T.streams(s, d))


@query("d40_stream_cost", "SELECT stream_id, ROUND(q, 4) AS quantity, ROUND(c, 4) AS cost, COALESCE(n, 0) AS n_highlights, ROUND(c / NULLIF(COALESCE(n, 0), 0), 6) AS per_highlight FROM (SELECT resource_id AS stream_id, SUM(quantity) AS q, SUM(total_cost) AS c FROM usage_records WHERE resource_type = 'stream' GROUP BY 1) u LEFT JOIN (SELECT stream_id, COUNT(*) AS n FROM highlights GROUP BY 1) h USING (stream_id)")
def _(s, d):
    return rounded(rounded(B.stream_cost(T.usage_records(s, d), T.highlights(s, d)), "quantity", "cost", digits=4), "per_highlight")


for _g in ("day", "week", "month"):

    @query(f"d28_trends_{_g}", f"SELECT CAST(date_trunc('{_g}', period_start) AS TIMESTAMP) AS period, " + ", ".join(f"ROUND(SUM(CASE WHEN usage_type = '{k}' THEN quantity ELSE 0 END), 4) AS {k}" for k in ("stream_processing", "api_call", "webhook_delivery")) + ", ROUND(SUM(total_cost), 4) AS cost FROM usage_records GROUP BY 1")
    def _(s, d, g=_g):
        return B.trends(T.usage_records(s, d), g)


@query("d29_invoice", "WITH lines AS (SELECT organization_id, usage_type, COUNT(*) AS n, ROUND(SUM(quantity), 4) AS quantity, ROUND(SUM(total_cost), 4) AS cost FROM usage_records WHERE billable GROUP BY 1, 2) SELECT *, ROUND(SUM(cost) OVER (PARTITION BY organization_id), 4) AS subtotal FROM lines")
def _(s, d):
    return B.invoice(T.usage_records(s, d))


@query("d27_top_resources", "SELECT resource_type || ':' || resource_id AS resource, ROUND(SUM(total_cost), 4) AS cost, COUNT(*) AS n FROM usage_records WHERE period_start >= TIMESTAMP '2024-01-05' GROUP BY 1 ORDER BY cost DESC, resource LIMIT 10")
def _(s, d):
    return B.top_resources(T.usage_records(s, d).where(in_period(NTZ("2024-01-05"))))


@query("d30_estimate", """SELECT user_id, ROUND(e, 4) AS estimate, ROUND(a, 4) AS actual, ROUND(GREATEST(0, e - a), 4) AS overrun
  FROM (SELECT user_id, COALESCE(SUM(total_cost) FILTER (period_start >= TIMESTAMP '2024-01-20'), 0) / 7 * 30 AS e, COALESCE(SUM(total_cost) FILTER (period_start >= TIMESTAMP '2024-01-15'), 0) AS a FROM usage_records GROUP BY 1)""")
def _(s, d):
    return rounded(B.monthly_estimate(T.usage_records(s, d), NTZ("2024-01-20"), NTZ("2024-01-15"), 7), "estimate", "actual", "overrun", digits=4)


@query("d34_throughput", "SELECT n AS last_hour, 24 * n AS per_day FROM (SELECT COUNT(*) AS n FROM events WHERE event_type <> 'error' AND ts > TIMESTAMP '2024-01-15 11:00:00' AND ts <= TIMESTAMP '2024-01-15 12:00:00')")
def _(s, d):
    return B.throughput(T.read(s, d, "events"), NTZ("2024-01-15 12:00:00"), F.col("event_type") != "error")


@query("d35_error_rates", "SELECT platform, COUNT(*) AS n, COUNT(*) FILTER (status = 'failed') AS n_failed, ROUND(100 * COUNT(*) FILTER (status = 'failed') / COUNT(*), 6) AS percent FROM webhook_events WHERE received_at > TIMESTAMP '2024-01-14' AND received_at <= TIMESTAMP '2024-01-15' GROUP BY ROLLUP (platform)")
def _(s, d):
    day = T.webhook_events(s, d).where((F.col("received_at") > NTZ("2024-01-14")) & (F.col("received_at") <= NTZ("2024-01-15")))
    return B.error_rates(day, "platform", F.col("status") == "failed")


@query("s35_rate_limits", """SELECT id, in_minute, in_hour, in_minute <= 2 AND in_hour <= 4 AS allowed FROM (SELECT id, COUNT(*) OVER (PARTITION BY user_id ORDER BY at_s RANGE BETWEEN 59 PRECEDING AND CURRENT ROW) AS in_minute, COUNT(*) OVER (PARTITION BY user_id ORDER BY at_s RANGE BETWEEN 3599 PRECEDING AND CURRENT ROW) AS in_hour
  FROM (SELECT *, date_diff('microsecond', TIMESTAMP '2024-01-01', period_start) // 1000000 AS at_s FROM usage_records WHERE usage_type = 'api_call'))""")
def _(s, d):
    return B.calls_within(T.usage_records(s, d), 2, 4).select("id", "in_minute", "in_hour", "allowed")


@query("d32_performance", "SELECT event_type, COUNT(*) AS n, MIN(value) AS least, MAX(value) AS most, ROUND(AVG(value), 8) AS mean, ROUND(quantile_cont(value, 0.5), 6) AS p50, ROUND(quantile_cont(value, 0.95), 6) AS p95, ROUND(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY ROLLUP (event_type)")
def _(s, d):
    return B.performance(T.read(s, d, "events").select("event_type", "value"), "event_type", "value")


_BOUNDS = [1.0, 5.0, 10.0, 50.0, 100.0, 250.0]


@query("d36_buckets", "SELECT " + ", ".join(f"COUNT(*) FILTER (value <= {b}) AS le_{i}" for i, b in enumerate(_BOUNDS)) + ", COUNT(value) AS le_inf FROM events")
def _(s, d):
    return B.cumulative_buckets(T.read(s, d, "events"), "value", _BOUNDS)


@query("d31_hourly_daily", "SELECT hour, day, COUNT(*) AS n, ROUND(SUM(value), 4) AS total FROM (SELECT date_trunc('hour', ts)::TIMESTAMP AS hour, date_trunc('day', ts)::TIMESTAMP AS day, value FROM events) GROUP BY GROUPING SETS ((hour), (day))")
def _(s, d):
    events = T.read(s, d, "events").select(F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz").alias("hour"), F.date_trunc("day", F.col("ts")).cast("timestamp_ntz").alias("day"), "value")
    return events.groupingSets([[F.col("hour")], [F.col("day")]], F.col("hour"), F.col("day")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("s33_calls_per_minute", "SELECT id, COUNT(*) OVER (PARTITION BY user_id ORDER BY at_s RANGE BETWEEN 60 PRECEDING AND CURRENT ROW) AS calls FROM (SELECT *, date_diff('microsecond', TIMESTAMP '2024-01-01', period_start) // 1000000 AS at_s FROM usage_records WHERE usage_type = 'api_call')")
def _(s, d):
    return B.calls_in_last_minute(T.usage_records(s, d)).select("id", "calls")


@query("s34_month_to_date", "SELECT id, ROUND(SUM(quantity) OVER (PARTITION BY user_id, date_trunc('month', period_start) ORDER BY period_start, id ROWS UNBOUNDED PRECEDING), 4) AS to_date FROM usage_records")
def _(s, d):
    return B.month_to_date(T.usage_records(s, d)).select("id", F.round("to_date", 4).alias("to_date"))
