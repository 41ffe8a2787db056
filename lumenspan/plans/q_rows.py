"""Queries of lookups, value functions and state changes on single rows, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenspan.functions import scalar as C
from lumenspan.operators import relational as R
from lumenspan.operators import states as Z
from lumenspan.operators import temporal as M
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


# ---- lookups -----------------------------------------------------------------------------


@query("b19_webhooks_by_url", "SELECT id, user_id FROM webhooks WHERE url = (SELECT 'https://hooks.example.com/' || MIN(s_name) FROM supplier)")
def _(s, d):
    wanted = T.read(s, d, "supplier").agg(F.concat(F.lit("https://hooks.example.com/"), F.min("s_name")).alias("url"))
    return T.webhooks(s, d).join(wanted, "url", "left_semi").select("id", "user_id")


@query("b30_batches_between", "SELECT id, created_at FROM batches WHERE created_at BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-03-31'")
def _(s, d):
    return T.batches(s, d).where(F.col("created_at").between(NTZ("1996-01-01"), NTZ("1996-03-31"))).select("id", "created_at")


@query("b32_organizations_of_owner", "SELECT id, name FROM organizations WHERE owner_id = (SELECT MIN(owner_id) FROM organizations)")
def _(s, d):
    rows = T.organizations(s, d)
    return rows.join(rows.agg(F.min("owner_id").alias("owner_id")), "owner_id", "left_semi").select("id", "name")


@query("b40_email_exists", "SELECT COUNT(*) > 0 AS found FROM users WHERE email = (SELECT MIN(email) FROM users)")
def _(s, d):
    rows = T.users(s, d).select("email")
    return rows.join(rows.agg(F.min("email").alias("email")), "email", "left_semi").agg((F.count("*") > 0).alias("found"))


@query("b47_filtered_results", "SELECT id, ROUND(confidence_score * viewer_engagement, 9) AS weight, CAST(ROW_NUMBER() OVER (PARTITION BY stream_id ORDER BY ROUND(confidence_score * viewer_engagement, 9) DESC, id) AS INTEGER) AS nth FROM highlights WHERE viewer_engagement >= 0.2 AND confidence_score >= 0.6 AND viewer_engagement * confidence_score >= 0.2 * 0.6")
def _(s, d):
    return Z.filtered_results(T.highlights(s, d), "viewer_engagement", "confidence_score", 0.2, 0.6).select("id", "weight", "nth")


@query("b48_valid_segments", "SELECT id FROM highlights WHERE description IS NOT NULL AND end_time - start_time > 0")
def _(s, d):
    return Z.valid_segments(T.highlights(s, d), "description").select("id")


@query("b53_kept_segments", "SELECT id, ROUND(LEAST(end_time, start_time + 120), 9) AS end_time FROM highlights WHERE end_time - start_time >= 5 AND confidence_score >= 0.7")
def _(s, d):
    return rounded(Z.kept_segments(T.highlights(s, d), "confidence_score").select("id", "end_time"), "end_time", digits=9)


_KIND = "CASE highlight_type WHEN 'view' THEN 'skill_play' WHEN 'click' THEN 'clutch_moment' WHEN 'purchase' THEN 'rare_event' ELSE 'other' END"


def _kind(c):
    return F.when(c == "view", "skill_play").when(c == "click", "clutch_moment").when(c == "purchase", "rare_event").otherwise("other")


@query("b54_meets_threshold", f"SELECT id, confidence_score >= CASE {_KIND} WHEN 'skill_play' THEN 0.65 WHEN 'clutch_moment' THEN 0.75 WHEN 'rare_event' THEN 0.8 ELSE 0.5 END AS usual, confidence_score >= CASE {_KIND} WHEN 'skill_play' THEN 0.7 WHEN 'clutch_moment' THEN 0.8 WHEN 'rare_event' THEN 0.85 ELSE 0.65 END AS strict FROM highlights")
def _(s, d):
    kind, score = _kind(F.col("highlight_type")), F.col("confidence_score")
    return T.highlights(s, d).select("id", C.meets_threshold(score, kind).alias("usual"), C.meets_threshold(score, kind, "strict").alias("strict"))


@query("a08_object_places", "SELECT id, CASE id % 3 WHEN 0 THEN 'clips' WHEN 1 THEN 'media' ELSE 'store' END AS bucket, 'org' || user_id || '/' || id || '.mp4' AS key FROM streams")
def _(s, d):
    key = F.concat(F.lit("org"), F.col("user_id"), F.lit("/"), F.col("id"), F.lit(".mp4"))
    url = F.when(F.col("id") % 3 == 0, F.concat(F.lit("s3://clips/"), key)).when(F.col("id") % 3 == 1, F.concat(F.lit("https://media.s3.eu-west-1.example.com/"), key)).otherwise(F.concat(F.lit("https://objects.example.com/store/"), key))
    return T.streams(s, d).select("id", C.bucket_and_key(url).alias("x")).select("id", "x.bucket", "x.key")


@query("a09_object_keys", "SELECT id, user_id || '/highlights/' || strftime(created_at, '%Y/%m/%d') || '/' || id || '/my_clip.mp4' AS key FROM streams")
def _(s, d):
    text = lambda c: F.col(c).cast("string")
    return T.streams(s, d).select("id", C.object_key(text("user_id"), F.lit("highlights"), F.col("created_at"), text("id"), F.lit("upload/my clip.mp4")).alias("key"))


@query("a16_platforms", "SELECT id, CASE id % 4 WHEN 0 THEN 'twitch' WHEN 1 THEN 'youtube' WHEN 2 THEN 'rtmp' ELSE 'custom' END AS platform FROM stream_urls")
def _(s, d):
    return T.stream_urls(s, d).select("id", C.url_platform(F.col("url")).alias("platform"))


@query("a22_sampled_frames", "SELECT stream_id, arg_min(frame_id, {'t': t, 'i': frame_id}) AS frame_id FROM frames WHERE quality >= 0.3 GROUP BY stream_id, floor(t / 60)")
def _(s, d):
    return Z.sampled(T.frames(s, d).where("quality >= 0.3"), 60.0).select("stream_id", "frame_id")


@query("a29_segment_frames", "SELECT frame_id FROM frames WHERE stream_id = 4 AND t >= 300 AND t < 600")
def _(s, d):
    return T.frames(s, d).where("stream_id = 4 AND t >= 300 AND t < 600").select("frame_id")


@query("j12_frame_at", "SELECT arg_min(f.frame_id, {'d': abs(f.t - p.moment), 'i': f.frame_id}) AS frame_id, f.stream_id FROM frames f JOIN (SELECT stream_id, MIN(t) AS moment FROM detections WHERE score >= 0.9 GROUP BY stream_id) p ON p.stream_id = f.stream_id AND abs(f.t - p.moment) <= 5 GROUP BY f.stream_id")
def _(s, d):
    points = T.detections(s, d).where("score >= 0.9").groupBy("stream_id").agg(F.min("t").alias("moment"))
    return M.nearest(points, T.frames(s, d).select("stream_id", "frame_id", "t"), ["stream_id"], ["stream_id"], "moment", "t", "frame_id", 5.0, ["frame_id"])


@query("j13_sync_points", """SELECT k.frame_id, f.stream_id AS other_stream, arg_min(f.frame_id, {'d': abs(f.t - k.t), 'i': f.frame_id}) AS other_frame FROM frames k JOIN frames f ON f.stream_id <> k.stream_id AND abs(f.t - k.t) < 0.1 WHERE k.is_keyframe GROUP BY k.frame_id, f.stream_id""")
def _(s, d):
    return Z.sync_points(T.frames(s, d), 0.1).select("frame_id", "other_stream", "other_frame")


@query("s30_sync_confidence", """WITH near AS (SELECT k.frame_id, COUNT(DISTINCT f.stream_id) AS n FROM frames k JOIN frames f ON f.stream_id <> k.stream_id AND abs(f.t - k.t) < 0.1 GROUP BY k.frame_id), total AS (SELECT COUNT(DISTINCT stream_id) AS n FROM frames)
  SELECT f.frame_id, ROUND(CASE WHEN is_keyframe THEN 0.5 ELSE 0 END + 0.5 * COALESCE(near.n, 0) / (total.n - 1), 6) AS confidence FROM frames f CROSS JOIN total LEFT JOIN near USING (frame_id)""")
def _(s, d):
    return rounded(Z.sync_confidence(T.frames(s, d), 0.1).select("frame_id", "confidence"), "confidence")


# ---- counts and statistics ---------------------------------------------------------------


@query("d09_batches_by_status", "SELECT u.status, COUNT(b.id) AS n FROM (VALUES ('pending'), ('processing'), ('completed'), ('partially_failed'), ('failed'), ('cancelled')) u(status) LEFT JOIN batches b USING (status) GROUP BY u.status")
def _(s, d):
    return R.listed(T.batches(s, d), "status", R.BATCH_STATUSES, [F.count("*").alias("n")])


@query("d19c_users", "SELECT COUNT(*) AS n FROM users")
def _(s, d):
    return T.users(s, d).agg(F.count("*").alias("n"))


@query("d23_confidences", """WITH x AS (SELECT id, confidence_score AS a, viewer_engagement AS b, (sentiment_score + 1) / 2 AS c FROM highlights), m AS (SELECT *, (a + b + c) / 3 AS mean, a + b + c AS total FROM x)
  SELECT id, ROUND(1 - (abs(a - mean) + abs(b - mean) + abs(c - mean)) / 3, 6) AS consistency, ROUND(1 - LEAST(1, ((a - mean) ** 2 + (b - mean) ** 2 + (c - mean) ** 2) / 3), 6) AS variance, ROUND(((a > 0.5)::INT + (b > 0.5)::INT + (c > 0.5)::INT) / 3, 6) AS majority,
    ROUND(1 + (a / total * ln(a / total + 1e-10) + b / total * ln(b / total + 1e-10) + c / total * ln(c / total + 1e-10)) / ln(3), 6) AS entropy FROM m""")
def _(s, d):
    scores = F.array(F.col("confidence_score"), F.col("viewer_engagement"), (F.col("sentiment_score") + 1) / 2)
    return T.highlights(s, d).select("id", *[F.round(C.confidence_of(scores, m), 6).alias(m) for m in ("consistency", "variance", "majority", "entropy")])


@query("d38_metric_stats", "SELECT event_type, COUNT(*) AS n, ROUND(SUM(value), 4) AS total, MIN(value) AS least, MAX(value) AS most, ROUND(AVG(value), 6) AS mean, arg_max(value, {'t': ts, 'i': event_id}) AS latest FROM events GROUP BY event_type")
def _(s, d):
    return Z.metric_stats(T.read(s, d, "events"), "event_type", "value", F.struct("ts", "event_id")).withColumns({"total": F.round("total", 4), "mean": F.round("mean", 6)})


@query("d39_progress", """SELECT stream_id, COUNT(*) AS n, COUNT(*) FILTER (status = 'failed') AS errors, COUNT(*) FILTER (retry_count > 0) AS retries, ROUND(100 * COUNT(*) FILTER (status = 'processed') / COUNT(*), 6) AS percent,
  ROUND(date_diff('microsecond', MIN(received_at), MAX(received_at)) / 1e6::DOUBLE * (100 / NULLIF(100 * COUNT(*) FILTER (status = 'processed') / COUNT(*), 0) - 1), 3) AS seconds_left FROM webhook_events GROUP BY stream_id""")
def _(s, d):
    found = Z.progress(T.webhook_events(s, d), "stream_id")
    return found.withColumns({"percent": F.round("percent", 6), "seconds_left": F.round("seconds_left", 3)})


@query("d42_score_bins", "SELECT COUNT(*) FILTER (confidence_score < 0.5) AS under_50, COUNT(*) FILTER (confidence_score >= 0.5 AND confidence_score < 0.7) AS from_50, COUNT(*) FILTER (confidence_score >= 0.7 AND confidence_score < 0.8) AS from_70, COUNT(*) FILTER (confidence_score >= 0.8 AND confidence_score < 0.9) AS from_80, COUNT(*) FILTER (confidence_score >= 0.9) AS from_90 FROM highlights")
def _(s, d):
    return Z.score_bins(T.highlights(s, d), "confidence_score")


@query("d43_agent_metrics", "SELECT stream_id, COUNT(*) AS evaluated, COUNT(*) FILTER (viewer_engagement >= 0.5) AS created, ROUND(COUNT(*) FILTER (viewer_engagement >= 0.5) / GREATEST(1, COUNT(*)), 6) AS success_rate, ROUND(COALESCE(AVG(confidence_score) FILTER (viewer_engagement >= 0.5), 0), 6) AS avg_confidence, ROUND(COALESCE(AVG(viewer_engagement) FILTER (viewer_engagement >= 0.5), 0), 6) AS avg_score FROM highlights GROUP BY stream_id")
def _(s, d):
    return rounded(Z.agent_metrics(T.highlights(s, d), F.col("viewer_engagement") >= 0.5), "success_rate", "avg_confidence", "avg_score")


_TRUTH = "truth AS (SELECT CASE WHEN k >= 50 THEN 1 ELSE 0 END AS y, value / (value + 50) AS p, event_id FROM ev)"


@query("d46_model_scores", f"""WITH {_TRUTH}, c AS (SELECT COUNT(*) AS n, COUNT(*) FILTER (y = 1) AS pos, COUNT(*) FILTER (y = 1 AND p > 0.5) AS tp, COUNT(*) FILTER (y = 0 AND p > 0.5) AS fp, COUNT(*) FILTER (y = 0 AND p <= 0.5) AS tn, COUNT(*) FILTER (y = 1 AND p <= 0.5) AS fn,
    -AVG(CASE WHEN y = 1 THEN ln(GREATEST(1e-15, p)) ELSE ln(GREATEST(1e-15, 1 - p)) END) AS log_loss FROM truth), ranks AS (SELECT y, AVG(i) OVER (PARTITION BY p) AS r FROM (SELECT *, ROW_NUMBER() OVER (ORDER BY p) AS i FROM truth)), auc AS (SELECT SUM(r) FILTER (y = 1) AS s FROM ranks)
  SELECT ROUND((tp + tn) / n, 6) AS accuracy, ROUND((pos * tp / NULLIF(tp + fp, 0) + (n - pos) * tn / NULLIF(tn + fn, 0)) / n, 6) AS precision, ROUND((pos * tp / pos + (n - pos) * tn / (n - pos)) / n, 6) AS recall,
    ROUND((pos * 2 * tp / (2 * tp + fp + fn) + (n - pos) * 2 * tn / (2 * tn + fp + fn)) / n, 6) AS f1, ROUND((s - pos * (pos + 1) / 2) / (pos * (n - pos)), 6) AS auc, ROUND(log_loss, 6) AS log_loss FROM c CROSS JOIN auc""")
def _(s, d):
    rows = T.numbered_events(s, d).select((F.col("k") >= 50).cast("int").alias("y"), (F.col("value") / (F.col("value") + 50)).alias("p"))
    return rounded(Z.model_scores(rows), "accuracy", "precision", "recall", "f1", "auc", "log_loss")


@query("d47_feature_importance", "SELECT ROUND(abs(corr(l_quantity, y)), 6) AS l_quantity, ROUND(abs(corr(l_discount, y)), 6) AS l_discount, ROUND(abs(corr(l_tax, y)), 6) AS l_tax FROM (SELECT l_quantity, l_discount, l_tax, l_extendedprice AS y FROM lineitem)")
def _(s, d):
    found = Z.feature_importance(T.read(s, d, "lineitem"), ["l_quantity", "l_discount", "l_tax"], "l_extendedprice")
    return rounded(found, "l_quantity", "l_discount", "l_tax")


# ---- choice of quality and pages -----------------------------------------------------------


@query("l20_best_quality", "SELECT manifest_id, COALESCE(arg_max(id, {'b': bandwidth, 'i': -id}) FILTER (bandwidth <= 1200000), arg_min(id, {'b': bandwidth, 'i': id})) AS id FROM qualities GROUP BY manifest_id")
def _(s, d):
    return Z.best_quality(T.qualities(s, d), 1_200_000)


@query("l21_quality_by_height", "SELECT manifest_id, arg_min(id, {'d': abs(height - 700), 'i': id}) AS id FROM qualities GROUP BY manifest_id")
def _(s, d):
    return Z.quality_by_height(T.qualities(s, d), 700)


@query("l22_optimal_quality", "SELECT manifest_id, arg_min(id, {'d': abs(height - 720), 'i': id}) AS by_name, arg_max(id, {'b': bandwidth, 'i': -id}) AS best, arg_min(id, {'b': bandwidth, 'i': id}) AS worst FROM qualities WHERE bandwidth <= 1500000 GROUP BY manifest_id")
def _(s, d):
    pick = lambda prefer: Z.optimal_quality(T.qualities(s, d), most=1_500_000, prefer=prefer)
    named = pick("720p").withColumnRenamed("id", "by_name")
    return named.join(pick("best").withColumnRenamed("id", "best"), "manifest_id").join(pick("worst").withColumnRenamed("id", "worst"), "manifest_id")


@query("l23_page_meta", "SELECT stream_id, COUNT(*) AS total, CAST(ceil(COUNT(*) / 20) AS BIGINT) AS pages, COUNT(*) > 40 AS has_next, TRUE AS has_prev FROM highlights GROUP BY stream_id")
def _(s, d):
    return T.highlights(s, d).groupBy("stream_id").agg(F.count("*").alias("n")).select("stream_id", *R.page_meta(F.col("n"), 20, 20))


# ---- intervals -------------------------------------------------------------------------------

_PAIRS = "pairs AS (SELECT id, start_time AS a0, end_time AS a1, LEAD(start_time) OVER w AS b0, LEAD(end_time) OVER w AS b1 FROM highlights WINDOW w AS (PARTITION BY stream_id ORDER BY start_time, id))"


def _pairs(s, d):
    order = Window.partitionBy("stream_id").orderBy("start_time", "id")
    rows = T.highlights(s, d).select("id", F.col("start_time").alias("a0"), F.col("end_time").alias("a1"), F.lead("start_time").over(order).alias("b0"), F.lead("end_time").over(order).alias("b1"))
    return rows.where("b0 IS NOT NULL")


_ENDS = ("a0", "a1", "b0", "b1")


@query("u05_intersection", f"WITH {_PAIRS} SELECT id, ROUND(GREATEST(a0, b0), 9) AS start_time, ROUND(LEAST(a1, b1), 9) AS end_time FROM pairs WHERE b0 IS NOT NULL AND GREATEST(a0, b0) < LEAST(a1, b1)")
def _(s, d):
    found = _pairs(s, d).withColumn("x", M.intersection(*[F.col(c) for c in _ENDS])).where("x IS NOT NULL")
    return rounded(found.select("id", "x.start_time", "x.end_time"), "start_time", "end_time", digits=9)


@query("u06_overlap_seconds", f"WITH {_PAIRS} SELECT id, ROUND(GREATEST(0, LEAST(a1, b1) - GREATEST(a0, b0)), 9) AS seconds, GREATEST(0, LEAST(a1, b1) - GREATEST(a0, b0)) > 5 AS overlaps FROM pairs WHERE b0 IS NOT NULL")
def _(s, d):
    seconds = M.overlap_seconds(*[F.col(c) for c in _ENDS])
    return _pairs(s, d).select("id", F.round(seconds, 9).alias("seconds"), (seconds > 5).alias("overlaps"))


@query("u07_overlap_of_shorter", f"WITH {_PAIRS} SELECT id, ROUND(GREATEST(0, LEAST(a1, b1) - GREATEST(a0, b0)) / LEAST(a1 - a0, b1 - b0), 6) AS share, GREATEST(0, LEAST(a1, b1) - GREATEST(a0, b0)) / LEAST(a1 - a0, b1 - b0) >= 0.5 AS overlaps FROM pairs WHERE b0 IS NOT NULL")
def _(s, d):
    share = M.overlap_of_shorter(*[F.col(c) for c in _ENDS])
    return _pairs(s, d).select("id", F.round(share, 6).alias("share"), (share >= 0.5).alias("overlaps"))


@query("h04_overlap_ratio", f"WITH {_PAIRS} SELECT id, ROUND(GREATEST(0, LEAST(a1, b1) - GREATEST(a0, b0)) / (GREATEST(a1, b1) - LEAST(a0, b0)), 6) AS ratio FROM pairs WHERE b0 IS NOT NULL")
def _(s, d):
    return _pairs(s, d).select("id", F.round(M.overlap_ratio(*[F.col(c) for c in _ENDS]), 6).alias("ratio"))


# ---- values --------------------------------------------------------------------------------


@query("h06_significant", "SELECT id, viewer_engagement * confidence_score >= 0.3 AS significant FROM highlights")
def _(s, d):
    return T.highlights(s, d).select("id", (F.col("viewer_engagement") * F.col("confidence_score") >= 0.3).alias("significant"))


@query("h07_modality_scores", "SELECT stream_id, COALESCE(arg_min(score, seq) FILTER (modality = 'video'), 0) AS video, COALESCE(arg_min(score, seq) FILTER (modality = 'audio'), 0) AS audio, COALESCE(arg_min(score, seq) FILTER (modality = 'chat'), 0) AS chat FROM detections GROUP BY stream_id")
def _(s, d):
    return Z.first_scores(T.detections(s, d))


@query("h46_quality_levels", "SELECT id, " + ", ".join(f"CASE WHEN confidence_score >= {t['legendary']} THEN 'legendary' WHEN confidence_score >= {t['exceptional']} THEN 'exceptional' WHEN confidence_score >= {t['good']} THEN 'good' WHEN confidence_score >= {t['viable']} THEN 'viable' ELSE 'below_threshold' END AS {n}_level" for n, t in C.THRESHOLDS.items()) + " FROM highlights")
def _(s, d):
    return T.highlights(s, d).select("id", *[C.quality_level(F.col("confidence_score"), n).alias(f"{n}_level") for n in C.THRESHOLDS])


_DIMS = {"skill_execution": "confidence_score", "game_impact": "viewer_engagement", "rarity": "(sentiment_score + 1) / 2", "momentum_shift": "(end_time - start_time) / 100"}


@query("h47_dimension_scores", "SELECT id, " + ", ".join("ROUND(" + " + ".join(f"{w[C.DIMENSIONS.index(k)]}::DOUBLE * ({e})" for k, e in _DIMS.items()) + f", 9) AS {n}_score" for n, w in C.DIMENSION_WEIGHTS.items()) + " FROM highlights")
def _(s, d):
    dims = {k: F.expr(e) for k, e in _DIMS.items()}
    return T.highlights(s, d).select("id", *[F.round(C.dimension_score(dims, n), 9).alias(f"{n}_score") for n in C.DIMENSION_WEIGHTS])


@query("g32_highlight_scores", """SELECT id, ROUND(GREATEST(0, LEAST(1, LEAST(1, LEAST(1, 0.2::DOUBLE * confidence_score + 0.2::DOUBLE * viewer_engagement + 0.15::DOUBLE * ((sentiment_score + 1) / 2)) + 0.1 * CASE highlight_type WHEN 'purchase' THEN 1 WHEN 'signup' THEN 0.6 WHEN 'click' THEN 0.3 ELSE 0 END)
  + CASE WHEN highlight_type = 'error' THEN -0.1 ELSE 0.05 END)), 6) AS score FROM highlights""")
def _(s, d):
    dims = {"skill_execution": F.col("confidence_score"), "game_impact": F.col("viewer_engagement"), "rarity": (F.col("sentiment_score") + 1) / 2}
    kind = F.col("highlight_type")
    found = C.agent_score(dims, C.keyword_priority(kind, ["Purchase"], ["signup"], ["click"]), F.when(kind == "error", -0.1).otherwise(0.05))
    return T.highlights(s, d).select("id", F.round(found, 6).alias("score"))


@query("h48_keyword_priorities", "SELECT id, CASE highlight_type WHEN 'purchase' THEN 1.0::DOUBLE WHEN 'signup' THEN 0.6 WHEN 'click' THEN 0.3 ELSE 0 END AS priority, ROUND(LEAST(1, confidence_score + CASE WHEN highlight_type = 'error' THEN -0.2 ELSE 0.1 END), 6) AS modified FROM highlights")
def _(s, d):
    kind = F.col("highlight_type")
    modified = F.least(F.lit(1.0), F.col("confidence_score") + F.when(kind == "error", -0.2).otherwise(0.1))
    return T.highlights(s, d).select("id", C.keyword_priority(kind, ["PURCHASE"], ["signup"], ["click"]).alias("priority"), F.round(modified, 6).alias("modified"))


@query("h51_instants", "SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS seconds, CAST(floor(epoch(ts)) AS BIGINT) - 1704067200 AS since, CAST(floor(epoch(ts)) AS BIGINT) + 90 AS later FROM events")
def _(s, d):
    written = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    at = C.instant(written)
    return T.read(s, d, "events").select("event_id", at.alias("seconds"), C.duration_since(at, F.lit(1704067200)).alias("since"), (at + 90).alias("later"))


@query("h54_initials", "SELECT id, upper(list_aggregate(list_transform(list_filter(string_split(replace(company_name, '#', ' '), ' '), lambda w: w <> ''), lambda w: w[1]), 'string_agg', '')) AS initials FROM users")
def _(s, d):
    return T.users(s, d).select("id", C.initials(F.replace("company_name", F.lit("#"), F.lit(" "))).alias("initials"))


@query("h58_stream_addresses", """SELECT id, CASE WHEN id % 4 = 0 THEN 'user_' || user_id END AS twitch, CASE WHEN id % 4 = 1 THEN lpad(id::VARCHAR, 11, 'x') END AS youtube, CASE WHEN id % 4 = 0 THEN 'https://www.twitch.tv/user_' || user_id ELSE url END AS canonical, TRUE AS is_live FROM stream_urls""")
def _(s, d):
    url = F.col("url")
    return T.stream_urls(s, d).select("id", C.twitch_name(url).alias("twitch"), C.youtube_id(url).alias("youtube"), C.canonical_url(url).alias("canonical"), C.is_stream(url).alias("is_live"))


@query("h62_qualities", "SELECT id, CASE WHEN height >= 2160 THEN '4K' WHEN height >= 240 THEN height || 'p' ELSE height || 'p' END AS name, CAST(floor((bandwidth + floor(bandwidth * 0.2)) * 1.5) AS BIGINT) AS needed FROM qualities")
def _(s, d):
    return T.qualities(s, d).select("id", C.quality_name(F.col("height")).alias("name"), C.bandwidth_needed(F.col("bandwidth"), 15.0).alias("needed"))


@query("h64_batch_progress", "SELECT id, ROUND(CASE WHEN total_items = 0 THEN 0 ELSE 100 * (successful_items + failed_items) / total_items END, 6) AS progress, ROUND(COALESCE(successful_items / NULLIF(successful_items + failed_items, 0), 0), 6) AS success_rate FROM batches")
def _(s, d):
    return rounded(Z.batch_progress(T.batches(s, d)).select("id", "progress", "success_rate"), "progress", "success_rate")


@query("h68_subscriptions", "SELECT id, is_active AND COALESCE(subscription_ends_at > TIMESTAMP '1998-06-01', TRUE) AS active FROM organizations")
def _(s, d):
    return T.organizations(s, d).select("id", Z.is_subscribed(NTZ("1998-06-01")).alias("active"))


@query("h72_duration_scores", "SELECT id, ROUND(CASE WHEN end_time - start_time BETWEEN 20 AND 96 THEN 1 WHEN end_time - start_time < 20 THEN (end_time - start_time) / 20 ELSE GREATEST(0.1, 96 / (end_time - start_time)) END, 6) AS score FROM highlights")
def _(s, d):
    return T.highlights(s, d).select("id", F.round(Z.duration_score(F.col("end_time") - F.col("start_time")), 6).alias("score"))


@query("h73_permissions", "SELECT id, CASE WHEN list_contains(scopes, 'admin') THEN 'read,write,delete,streams,batches,webhooks,analytics,admin' ELSE 'read' || CASE WHEN id % 2 = 0 THEN ',write' ELSE '' END || ',streams' || CASE WHEN id % 3 = 0 THEN ',webhooks' ELSE '' END END AS permissions FROM api_keys")
def _(s, d):
    return T.api_keys(s, d).select("id", F.array_join(C.permissions(F.col("scopes")), ",").alias("permissions"))


# ---- state changes -----------------------------------------------------------------------------


@query("s41_transitions", "SELECT event_id, CASE status WHEN 'received' THEN next IN ('processing', 'failed', 'cancelled') ELSE status = 'processing' AND next IN ('completed', 'failed', 'cancelled') END AS allowed FROM (SELECT event_id, status, ['processing', 'completed', 'failed'][event_id % 3 + 1] AS next FROM webhook_events)")
def _(s, d):
    before = F.when(F.col("status") == "received", "pending").otherwise(F.col("status"))
    after = T.pick(F.col("event_id") % 3, "processing", "completed", "failed")
    return T.webhook_events(s, d).select("event_id", C.may_follow(before, after).alias("allowed"))


@query("k40_status_updates", "SELECT id, CASE WHEN status = 'pending' THEN 'processing' WHEN status = 'processing' THEN 'completed' ELSE status END AS status, status <> 'completed' AS changed FROM streams")
def _(s, d):
    wanted = F.when(F.col("status") == "pending", "processing").otherwise("completed")
    return Z.updated_status(T.streams(s, d), wanted).select("id", "status", "changed")


@query("k41_finished_usage", "SELECT u.id, ROUND(CASE WHEN period_end IS NULL THEN s.duration / 60 ELSE quantity END, 6) AS quantity, ROUND(CASE WHEN period_end IS NULL THEN s.duration / 60 * rate ELSE total_cost END, 6) AS cost FROM usage_records u JOIN streams s ON s.id = u.resource_id WHERE usage_type = 'stream_processing'")
def _(s, d):
    return rounded(Z.finished_usage(T.usage_records(s, d), T.streams(s, d)).select("id", "quantity", F.col("total_cost").alias("cost")), "quantity", "cost")


@query("k42_active_streams_of_user", "SELECT id FROM streams WHERE user_id = 7 AND status IN ('pending', 'processing')")
def _(s, d):
    return T.streams(s, d).where((F.col("user_id") == 7) & F.col("status").isin("pending", "processing")).select("id")


@query("k43_renewed", "SELECT id, COALESCE(subscription_ends_at, TIMESTAMP '1998-06-01') + to_days(30) AS ends_at, TRUE AS is_active FROM organizations WHERE plan_type <> 'custom'")
def _(s, d):
    return Z.renewed(T.organizations(s, d).where("plan_type <> 'custom'"), NTZ("1998-06-01"), 30).select("id", F.col("subscription_ends_at").alias("ends_at"), "is_active")


@query("k44_expired", "SELECT id, is_active AND COALESCE(subscription_ends_at > TIMESTAMP '1998-06-01', TRUE) AS is_active FROM organizations WHERE subscription_ends_at <= TIMESTAMP '1998-06-01'")
def _(s, d):
    return Z.expired(T.organizations(s, d), NTZ("1998-06-01")).select("id", "is_active")


@query("k46_retry_schedule", "SELECT event_id, LEAST(60 * pow(2, retry_count - 2), 3600)::DOUBLE AS delay FROM webhook_events WHERE status = 'failed'")
def _(s, d):
    return T.webhook_events(s, d).where("status = 'failed'").select("event_id", C.retry_delay(F.col("retry_count") - 2).alias("delay"))


@query("k49_latest_events", "SELECT event_id, stream_id FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY stream_id ORDER BY received_at DESC, event_id DESC) AS nth FROM webhook_events) WHERE nth <= 20 AND event_type = 'view'")
def _(s, d):
    return Z.recent_events(T.webhook_events(s, d), 20, F.col("event_type") == "view").select("event_id", "stream_id")


@query("k51_queue_status", "SELECT title AS priority, COUNT(*) AS waiting, MIN(created_at) AS oldest FROM streams WHERE status = 'pending' GROUP BY title")
def _(s, d):
    return T.streams(s, d).where("status = 'pending'").groupBy(F.col("title").alias("priority")).agg(F.count("*").alias("waiting"), F.min("created_at").alias("oldest"))


@query("k52_resource_limits", "SELECT title AS priority, COUNT(*) AS active, COUNT(*) < CASE WHEN title = '1-URGENT' THEN 400 ELSE 100 END AS may_start FROM streams WHERE status = 'processing' GROUP BY title")
def _(s, d):
    most = F.when(F.col("title") == "1-URGENT", 400).otherwise(100)
    counts = T.streams(s, d).where("status = 'processing'").groupBy("title").agg(F.count("*").alias("active"))
    return counts.select(F.col("title").alias("priority"), "active", (F.col("active") < most).alias("may_start"))


@query("k53_batch_states", """SELECT batch_id AS id, COUNT(*) AS total, COUNT(*) FILTER (s = 'completed') AS ok, COUNT(*) FILTER (s = 'failed') AS failed, CASE WHEN COUNT(*) FILTER (s IN ('completed', 'failed')) < COUNT(*) THEN 'processing' WHEN COUNT(*) FILTER (s = 'failed') = 0 THEN 'completed' WHEN COUNT(*) FILTER (s = 'completed') = 0 THEN 'failed' ELSE 'partially_failed' END AS status
  FROM (SELECT batch_id, CASE WHEN line = 1 THEN 'completed' ELSE status END AS s FROM batch_items) GROUP BY batch_id""")
def _(s, d):
    items = T.batch_items(s, d).withColumn("status", F.when(F.col("line") == 1, "completed").otherwise(F.col("status")))
    return Z.batch_states(items)


@query("k54_quantities", "SELECT id, ROUND(quantity * 2, 6) AS quantity, ROUND(quantity * 2 * rate, 6) AS cost FROM usage_records WHERE period_end IS NULL")
def _(s, d):
    found = Z.with_quantity(T.usage_records(s, d).where("period_end IS NULL"), F.col("quantity") * 2)
    return rounded(found.select("id", "quantity", F.col("total_cost").alias("cost")), "quantity", "cost")


@query("k55_not_billable", "SELECT id, FALSE AS billable, 0::DOUBLE AS total_cost FROM usage_records WHERE usage_type = 'storage'")
def _(s, d):
    return Z.not_billable(T.usage_records(s, d).where("usage_type = 'storage'")).select("id", "billable", "total_cost")


@query("k56_batch_status", "SELECT b.id, ROUND(100 * (successful_items + failed_items) / NULLIF(total_items, 0), 6) AS percent, COUNT(i.line) AS shown FROM batches b LEFT JOIN batch_items i ON i.batch_id = b.id AND i.line <= 100 GROUP BY b.id, successful_items, failed_items, total_items")
def _(s, d):
    shown = T.batch_items(s, d).where("line <= 100").groupBy(F.col("batch_id").alias("id")).agg(F.count("*").alias("shown"))
    percent = F.try_divide(100 * (F.col("successful_items") + F.col("failed_items")), F.col("total_items"))
    return T.batches(s, d).join(shown, "id", "left").select("id", F.round(percent, 6).alias("percent"), F.coalesce("shown", F.lit(0)).alias("shown"))


@query("k58_organization_totals", "SELECT organization_id, COUNT(*) AS n, ROUND(SUM(quantity), 4) AS quantity, ROUND(SUM(total_cost) FILTER (billable), 4) AS cost FROM usage_records GROUP BY organization_id")
def _(s, d):
    return T.usage_records(s, d).groupBy("organization_id").agg(F.count("*").alias("n"), F.round(F.sum("quantity"), 4).alias("quantity"), F.round(F.sum(F.when(F.col("billable"), F.col("total_cost"))), 4).alias("cost"))


@query("k59_event_pages", "SELECT stream_id, COUNT(*) AS shown, ROUND(100 * COUNT(*) FILTER (status = 'processed') / COUNT(*), 6) AS percent FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY stream_id ORDER BY received_at DESC, event_id DESC) AS nth FROM webhook_events) WHERE nth <= 50 GROUP BY stream_id")
def _(s, d):
    shown = Z.recent_events(T.webhook_events(s, d), 50)
    return shown.groupBy("stream_id").agg(F.count("*").alias("shown"), F.round(100 * F.count_if(F.col("status") == "processed") / F.count("*"), 6).alias("percent"))


@query("k60_members", "SELECT u.id, u.email FROM users u JOIN memberships m ON m.user_id = u.id WHERE m.organization_id = 3")
def _(s, d):
    chosen = T.memberships(s, d).where("organization_id = 3").select(F.col("user_id").alias("id"))
    return T.users(s, d).join(chosen, "id", "left_semi").select("id", "email")


@query("k64_enabled", "SELECT event_id, concat_ws(',', CASE WHEN k % 2 = 0 THEN 'video' END, CASE WHEN k % 3 = 0 THEN 'audio' END, CASE WHEN k % 5 = 0 THEN 'chat' END) AS analyzers FROM ev")
def _(s, d):
    k = F.col("k")
    return T.numbered_events(s, d).select("event_id", F.array_join(C.enabled({"video": k % 2 == 0, "audio": k % 3 == 0, "chat": k % 5 == 0}), ",").alias("analyzers"))
