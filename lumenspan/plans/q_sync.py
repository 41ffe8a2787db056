"""Queries of segments, time lines, impacts, milestones and pluggable detectors, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenspan.functions import scalar as C
from lumenspan.operators import detection as D
from lumenspan.operators import series as S
from lumenspan.operators import states as Z
from lumenspan.operators import sync as Y
from lumenspan.plans.prelude import with_tables
from lumenspan.plans.q_chat import LEXICON, RESET, WINDOWS, _list
from lumenspan.plans.q_temporal import SER, candidates, rounded, series
from lumenspan.sources import tables as T
from lumenspan.functions import text as X

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None):
    """Register a query under ``name`` together with its SQL."""

    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = with_tables(sql)
        return f

    return add


# ---- time stamps -------------------------------------------------------------------------

_FORM = "CASE stream_id % 4 WHEN 0 THEN 'epoch_seconds' WHEN 1 THEN 'epoch_millis' WHEN 2 THEN 'relative_seconds' ELSE 'rtmp_timestamp' END"


@query("s27_normalized_times", "SELECT frame_id, ROUND(CASE stream_id % 4 WHEN 0 THEN t WHEN 1 THEN t * 0.001::DOUBLE WHEN 2 THEN t + 1000 ELSE t * 0.001::DOUBLE + 1000 END, 9) AS seconds FROM frames")
def _(s, d):
    form = T.pick(F.col("stream_id") % 4, *Y.SCALES)
    return rounded(T.frames(s, d).select("frame_id", Y.epoch_seconds(F.col("t"), form, F.lit(1000.0)).alias("seconds")), "seconds", digits=9)


@query("s29_converted_times", "SELECT frame_id, ROUND(t * 2 + 5 + 0.001::DOUBLE * stream_id * (t / 10), 9) AS seconds FROM frames")
def _(s, d):
    found = Y.converted(F.col("t"), F.lit(2.0), F.lit(5.0), 0.001 * F.col("stream_id"), F.col("t") / 10)
    return rounded(T.frames(s, d).select("frame_id", found.alias("seconds")), "seconds", digits=9)


@query("s31_drift_corrected", f"""WITH {SER}, recent AS (SELECT series, t, t * (1 + 0.001 * series) AS ot FROM ser QUALIFY ROW_NUMBER() OVER (PARTITION BY series ORDER BY t DESC, id DESC) <= 100), dr AS (SELECT series, CASE WHEN COUNT(*) >= 10 THEN regr_slope(ot - t, t) ELSE 0 END AS drift FROM recent GROUP BY series)
  SELECT id, ROUND(t * (1 + 0.001 * series) - drift * t, 4) AS corrected FROM ser JOIN dr USING (series)""")
def _(s, d):
    pairs = series(s, d).withColumn("ref", F.col("t")).withColumn("t", F.col("t") * (1 + 0.001 * F.col("series")))
    found = pairs.join(S.drift(pairs), "series")
    return found.select("id", F.round(Y.corrected(F.col("t"), F.col("drift"), F.col("ref")), 4).alias("corrected"))


@query("k20_synchronized_frames", """WITH near AS (SELECT k.frame_id, COUNT(DISTINCT f.stream_id) AS n FROM frames k JOIN frames f ON f.stream_id <> k.stream_id AND abs(f.t - k.t) < 0.1 GROUP BY k.frame_id), total AS (SELECT COUNT(DISTINCT stream_id) AS n FROM frames),
  c AS (SELECT f.stream_id, f.frame_id, f.is_keyframe, CASE WHEN is_keyframe THEN 0.5 ELSE 0 END + 0.5 * COALESCE(near.n, 0) / (total.n - 1) AS c FROM frames f CROSS JOIN total LEFT JOIN near USING (frame_id))
  SELECT stream_id, COUNT(*) AS n, COUNT(*) FILTER (is_keyframe) AS keyframes, ROUND(AVG(c), 6) AS confidence FROM c GROUP BY stream_id""")
def _(s, d):
    found = Z.sync_confidence(T.frames(s, d), 0.1)
    return found.groupBy("stream_id").agg(F.count("*").alias("n"), F.count_if("is_keyframe").alias("keyframes"), F.round(F.avg("confidence"), 6).alias("confidence"))


@query("s23_video_times", "SELECT c.event_id, ROUND(t + CASE WHEN event_id % 5 = 0 THEN 0 WHEN stream_id % 3 = 0 THEN -2 WHEN stream_id % 3 = 1 THEN -1.5 ELSE 0 END, 9) AS video_t FROM chat_messages c")
def _(s, d):
    platform = T.pick(F.col("stream_id") % 3, "twitch", "youtube", "custom")
    found = Y.video_time(F.col("t"), platform, F.col("event_id") % 5 != 0)
    return rounded(T.chat_messages(s, d).select("event_id", found.alias("video_t")), "video_t", digits=9)


@query("s23_merged_close", """WITH h AS (SELECT *, MAX(end_time) OVER (PARTITION BY stream_id ORDER BY start_time, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM highlights), n AS (SELECT *, SUM(CASE WHEN m IS NULL OR start_time > m + 2 THEN 1 ELSE 0 END) OVER (PARTITION BY stream_id ORDER BY start_time, id) AS island FROM h)
  SELECT stream_id, ROUND(MIN(start_time), 9) AS start_time, ROUND(MAX(end_time), 9) AS end_time, MAX(confidence_score) AS confidence, CAST(SUM(id % 7) AS BIGINT) AS messages FROM n GROUP BY stream_id, island""")
def _(s, d):
    rows = T.highlights(s, d).select("id", "stream_id", "start_time", "end_time", F.col("confidence_score").alias("confidence"), (F.col("id") % 7).alias("messages"))
    return rounded(Y.merged_close(rows), "start_time", "end_time", digits=9)


@query("s24_correlated", "SELECT a.id, COUNT(DISTINCT b.stream_id) AS streams FROM highlights a JOIN highlights b ON a.stream_id <> b.stream_id AND abs(a.start_time - b.start_time) <= 1 GROUP BY a.id")
def _(s, d):
    return Y.correlated(T.highlights(s, d), 1.0)


# ---- segments ------------------------------------------------------------------------------


_SEG = "seg AS (SELECT *, CAST(floor(t / 30) AS BIGINT) AS segment, ROW_NUMBER() OVER (PARTITION BY stream_id, floor(t / 30) ORDER BY t, frame_id) - 1 AS place FROM frames), segs AS (SELECT stream_id, segment, COUNT(*) AS n, COUNT(*) FILTER (is_keyframe) AS keyframes, MIN(place) FILTER (is_keyframe) AS first_keyframe, COALESCE(AVG(quality) FILTER (quality > 0), 1) AS quality, SUM(size_bytes)::BIGINT AS bytes, MIN(t) AS start_time, MAX(t) AS end_time FROM seg GROUP BY ALL)"


@query("s07_segments", f"WITH {_SEG} SELECT stream_id, segment, n, keyframes, CAST(first_keyframe AS INTEGER) AS first_keyframe, ROUND(quality, 9) AS quality, bytes, ROUND(start_time, 9) AS start_time, ROUND(end_time, 9) AS end_time FROM segs")
def _(s, d):
    return rounded(Y.segments(T.frames(s, d), 30.0), "quality", "start_time", "end_time", digits=9)


@query("s10_running_means", f"""WITH RECURSIVE {_SEG}, o AS MATERIALIZED (SELECT *, ROW_NUMBER() OVER (PARTITION BY stream_id ORDER BY segment) AS i FROM segs), w AS (SELECT stream_id, segment, i, 0.1::DOUBLE * (end_time - start_time) AS a, 0.1::DOUBLE * n AS b FROM o WHERE i = 1
  UNION ALL SELECT o.stream_id, o.segment, o.i, 0.1::DOUBLE * (o.end_time - o.start_time) + 0.9::DOUBLE * w.a, 0.1::DOUBLE * o.n + 0.9::DOUBLE * w.b FROM w JOIN o ON o.stream_id = w.stream_id AND o.i = w.i + 1) SELECT stream_id, segment, ROUND(a, 6) AS avg_length, ROUND(b, 6) AS avg_frames FROM w""")
def _(s, d):
    return rounded(Y.running_means(Y.segments(T.frames(s, d), 30.0)), "avg_length", "avg_frames")


@query("s11_frame_windows", "SELECT stream_id, k * 40.0::DOUBLE AS start_time, COUNT(*) AS n, COUNT(*) FILTER (is_keyframe) AS keyframes, ROUND(AVG(quality), 9) AS quality FROM (SELECT *, UNNEST(range(GREATEST(0, CAST(floor((t - 100) / 40) AS BIGINT) + 1), CAST(floor(t / 40) AS BIGINT) + 1)) AS k FROM frames) GROUP BY stream_id, k")
def _(s, d):
    return rounded(Y.frame_windows(T.frames(s, d), 100.0, 40.0), "quality", digits=9)


@query("s14_kept_segments", f"WITH {_SEG} SELECT stream_id, segment FROM segs WHERE end_time >= 4000 - 300")
def _(s, d):
    return Y.segments(T.frames(s, d), 30.0).where(F.col("end_time") >= 4000 - 300).select("stream_id", "segment")


@query("s16_video_windows", """WITH RECURSIVE f AS MATERIALIZED (SELECT stream_id, t, quality, frame_id, ROW_NUMBER() OVER (PARTITION BY stream_id ORDER BY t, frame_id) AS nth FROM frames), w AS (SELECT stream_id, nth, t, quality, t AS opened FROM f WHERE nth = 1 UNION ALL SELECT f.stream_id, f.nth, f.t, f.quality, CASE WHEN f.t - w.opened >= 30 THEN f.t ELSE w.opened END FROM w JOIN f ON f.stream_id = w.stream_id AND f.nth = w.nth + 1)
  SELECT stream_id, ROUND(opened, 9) AS start_time, ROUND(MAX(t), 9) AS end_time, COUNT(*) AS n, ROUND(AVG(quality), 9) AS quality FROM w GROUP BY stream_id, opened""")
def _(s, d):
    found = Y.window_groups(T.frames(s, d).select("stream_id", "t", "frame_id", "quality"), "t", "frame_id", 30.0, [F.count("*").alias("n"), F.avg("quality").alias("quality")])
    return rounded(found, "start_time", "end_time", "quality", digits=9)


@query("s17_strict_windows", f"WITH RECURSIVE {RESET.replace('>= 1800', '> 1800')} SELECT stream_id, ROUND(opened, 3) AS start_time, ROUND(MAX(t), 3) AS end_time, COUNT(*) AS n FROM walk GROUP BY stream_id, opened")
def _(s, d):
    found = Y.window_groups(T.chat_messages(s, d).select("stream_id", "t", "event_id"), "t", "event_id", 1800.0, [F.count("*").alias("n")], strict=True)
    return rounded(found, "start_time", "end_time", digits=3)


@query("k12_thinned_frames", "SELECT frame_id FROM (SELECT frame_id, COUNT(*) OVER (PARTITION BY stream_id) AS n, ROW_NUMBER() OVER (PARTITION BY stream_id ORDER BY t, frame_id) - 1 AS i FROM frames) WHERE n <= 30 OR i % GREATEST(n // 30, 1) = 0")
def _(s, d):
    return Y.thinned(T.frames(s, d), 30).select("frame_id")


@query("k25_buffer_stats", "SELECT stream_id, COUNT(*) AS n, COUNT(*) FILTER (is_keyframe) AS keyframes, SUM(size_bytes)::BIGINT AS bytes, ROUND(MIN(t), 9) AS oldest, ROUND(MAX(t), 9) AS newest FROM frames GROUP BY stream_id")
def _(s, d):
    found = T.frames(s, d).groupBy("stream_id").agg(F.count("*").alias("n"), F.count_if("is_keyframe").alias("keyframes"), F.sum("size_bytes").alias("bytes"), F.min("t").alias("oldest"), F.max("t").alias("newest"))
    return rounded(found, "oldest", "newest", digits=9)


# ---- impacts, emotes, milestones, memory -------------------------------------------------------


@query("s21_impacts", """WITH e AS (SELECT user_id % 10 AS stream_id, CASE WHEN event_type = 'purchase' THEN LEAST(1, value / 100) ELSE 0.8::DOUBLE * LEAST(1, value * 5 / 1000) END AS impact, date_diff('microsecond', TIMESTAMP '2024-01-01', ts) / 1e6::DOUBLE AS et FROM events WHERE event_type IN ('purchase', 'click'))
  SELECT c.event_id, ROUND(LEAST(1, SUM(impact * (1 - (c.t - et) / 1200))), 6) AS impact FROM chat_messages c JOIN e ON e.stream_id = c.stream_id AND et <= c.t AND c.t - et < 1200 GROUP BY c.event_id""")
def _(s, d):
    kind = F.when(F.col("event_type") == "purchase", "raid").otherwise("cheer")
    amount = F.when(F.col("event_type") == "purchase", F.col("value")).otherwise(F.col("value") * 5)
    events = T.read(s, d, "events").where("event_type IN ('purchase', 'click')").select((F.col("user_id") % 10).alias("stream_id"), T.seconds("ts").alias("t"), kind.alias("kind"), amount.alias("amount"))
    return rounded(Y.impact_at(T.chat_messages(s, d).select("stream_id", "event_id", "t"), events, 1200.0), "impact")


@query("s22_learned_emotes", f"""WITH {LEXICON}, l AS (SELECT emote, COUNT(*) AS n, AVG(score) AS v FROM (SELECT score, UNNEST(list_filter({_list(X.EMOTES)}, lambda k: contains(message, k))) AS emote FROM lex) GROUP BY emote HAVING COUNT(*) >= 3)
  SELECT emote, n, ROUND(v, 6) AS value, CASE WHEN v >= 0.6 THEN 'very_positive' WHEN v >= 0.2 THEN 'positive' WHEN v >= -0.2 THEN 'neutral' WHEN v >= -0.6 THEN 'negative' ELSE 'very_negative' END AS category FROM l""")
def _(s, d):
    return rounded(Y.learned_emotes(T.chat_messages(s, d)), "value")


@query("s38_milestones", f"""WITH p AS (SELECT event_id, stream_id, received_at, 100 * COUNT(*) FILTER (status <> 'received') OVER (PARTITION BY stream_id ORDER BY received_at, event_id ROWS UNBOUNDED PRECEDING) / COUNT(*) OVER (PARTITION BY stream_id) AS percent FROM webhook_events), m AS (SELECT *, UNNEST([{', '.join(map(str, Y.MILESTONES))}]) AS milestone FROM p)
  SELECT stream_id, milestone, arg_min(event_id, {{'a': received_at, 'b': event_id}}) AS event_id FROM m WHERE percent >= milestone GROUP BY stream_id, milestone""")
def _(s, d):
    from pyspark.sql.window import Window

    so_far = Window.partitionBy("stream_id").orderBy("received_at", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    percent = 100 * F.count_if(F.col("status") != "received").over(so_far) / F.count("*").over(Window.partitionBy("stream_id"))
    updates = T.webhook_events(s, d).withColumn("percent", percent)
    return Y.milestones_reached(updates, "stream_id", ["received_at", "event_id"], "percent").select("stream_id", "milestone", "event_id")


@query("s32_recent_memory", "SELECT frame_id FROM (SELECT frame_id, t, MAX(t) OVER (PARTITION BY stream_id) AS last FROM frames) WHERE t >= last - 300")
def _(s, d):
    return Y.recent_memory(T.frames(s, d)).select("frame_id")


@query("s40_active_jobs", "SELECT stream_id FROM webhook_events GROUP BY stream_id HAVING arg_max(status, {'a': received_at, 'b': event_id}) = 'processing'")
def _(s, d):
    last = F.max_by("status", F.struct("received_at", "event_id"))
    return T.webhook_events(s, d).groupBy("stream_id").agg(last.alias("status")).where("status = 'processing'").select("stream_id")


@query("s43_trending_moments", f"WITH RECURSIVE {WINDOWS} SELECT stream_id, ROUND(opened, 3) AS start_time, ROUND(ratio, 4) AS ratio FROM excited WHERE ratio >= 2")
def _(s, d):
    found = D.with_excitement(D.with_baselines(D.window_measures(T.chat_messages(s, d), 1800.0))).where(F.col("ratio") >= 2)
    return found.select("stream_id", F.round("start_time", 3).alias("start_time"), F.round("ratio", 4).alias("ratio"))


@query("k16_adapted_messages", "SELECT 'msg_' || event_id || '_' || user_id AS id, user_id AS user, username AS display_name, message AS text, CAST(floor(epoch(ts)) AS BIGINT) AS at FROM chat_messages")
def _(s, d):
    at = F.floor(F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("ts")) / 1_000_000).cast("long")
    return T.chat_messages(s, d).select(F.concat(F.lit("msg_"), F.col("event_id"), F.lit("_"), F.col("user_id")).alias("id"), F.col("user_id").alias("user"), F.col("username").alias("display_name"), F.col("message").alias("text"), at.alias("at"))


@query("k17_parsed_events", "SELECT event_id, CAST(props->>'k' AS INTEGER) AS k FROM events WHERE props->>'k' IS NOT NULL")
def _(s, d):
    return Y.parsed_events(T.read(s, d, "events").select("event_id", "props"), "props", "k int").where("k IS NOT NULL").select("event_id", "k")


@query("k37_agent_candidates", "SELECT id, ROUND(score, 9) AS score FROM (SELECT id, highlight_type, LEAST(1, 0.35::DOUBLE * confidence_score + 0.2::DOUBLE * viewer_engagement + 0.5) AS score FROM highlights) WHERE ROUND(score, 9) >= CASE highlight_type WHEN 'click' THEN 0.9 ELSE 0.5 END")
def _(s, d):
    dims = {"skill_execution": F.col("confidence_score"), "game_impact": F.col("viewer_engagement")}
    kind = F.when(F.col("highlight_type") == "click", "perfect_execution").otherwise("general")
    scored = T.highlights(s, d).select("id", F.round(C.agent_score(dims, F.lit(0.0), F.lit(0.5), "skill"), 9).alias("score"), kind.alias("kind"))
    return scored.where(C.meets_threshold(F.col("score"), F.col("kind"))).select("id", "score")


@query("k39_prompt_context", "SELECT stream_id, string_agg(description, ' | ' ORDER BY start_time, id) AS context FROM (SELECT * FROM highlights QUALIFY ROW_NUMBER() OVER (PARTITION BY stream_id ORDER BY start_time DESC, id DESC) <= 3) GROUP BY stream_id")
def _(s, d):
    return Y.last_descriptions(T.highlights(s, d).select("id", "stream_id", "start_time", "description"))


# ---- pluggable detectors -------------------------------------------------------------------------

DETECTORS = Y.Detectors()


@DETECTORS.register("engaging")
def _engaging(rows):
    return rows.select(F.col("id").alias("segment"), "score", "confidence")


@DETECTORS.register("lasting")
def _lasting(rows):
    return rows.select(F.col("id").alias("segment"), F.least(F.lit(1.0), (F.col("end_time") - F.col("start_time")) / 100).alias("score"), F.lit(0.8).alias("confidence"))


@query("x03_detectors", """SELECT id AS segment, 'engaging' AS detector, ROUND(viewer_engagement, 6) AS score, confidence_score AS confidence FROM highlights WHERE viewer_engagement >= 0.3 AND confidence_score >= 0.6 AND viewer_engagement * confidence_score >= 0.18
  UNION ALL SELECT id, 'lasting', ROUND(LEAST(1, (end_time - start_time) / 100), 6), 0.8 FROM highlights WHERE ROUND(LEAST(1, (end_time - start_time) / 100), 6) >= 0.3""")
def _(s, d):
    found = DETECTORS.detect(candidates(s, d)).withColumn("score", F.round("score", 6)).withColumnsRenamed({"segment": "id", "detector": "stream_id"})
    return Z.filtered_results(found, "score", "confidence", 0.3, 0.6).select(F.col("id").alias("segment"), F.col("stream_id").alias("detector"), "score", "confidence")


@query("x07_measured_segments", "SELECT id, ROUND(end_time - start_time, 6) AS length FROM highlights WHERE id % 11 <> 0")
def _(s, d):
    def measure(row):
        if row["id"] % 11 == 0:
            raise ValueError("unreadable")
        return {"id": row["id"], "length": row["end_time"] - row["start_time"]}

    return rounded(Y.each_segment(T.highlights(s, d).select("id", "start_time", "end_time"), measure, "id long, length double"), "length")
