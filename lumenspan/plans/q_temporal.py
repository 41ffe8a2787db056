"""Queries of alignment, fusion, series and ranking with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenspan.operators import fusion as U
from lumenspan.operators import ranking as K
from lumenspan.operators import series as S
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


def candidates(s, d):
    """Highlights as candidates."""
    return T.highlights(s, d).select("id", "stream_id", "start_time", "end_time", F.col("viewer_engagement").alias("score"), F.col("confidence_score").alias("confidence"), F.col("highlight_type").alias("category"))


CAND = "cand AS (SELECT id, stream_id, start_time, end_time, viewer_engagement AS score, confidence_score AS confidence, highlight_type AS category FROM highlights)"


def series(s, d):
    """Scores of detections as one series for each stream."""
    return T.detections(s, d).select(F.col("stream_id").alias("series"), F.col("seq").alias("id"), "t", F.col("score").alias("v"))


SER = "ser AS (SELECT stream_id AS series, seq AS id, t, score AS v FROM detections)"

# ---- alignment ---------------------------------------------------------------------------

GRID = "grid AS (SELECT DISTINCT stream_id, t AS moment FROM detections), full_grid AS (SELECT stream_id, moment, m.modality FROM grid CROSS JOIN (VALUES ('video'), ('audio'), ('chat')) m(modality))"
WINDOWED = """aligned AS (
  SELECT g.stream_id, g.moment, g.modality, x.seq, x.score, x.confidence FROM full_grid g JOIN detections x ON x.stream_id = g.stream_id AND x.modality = g.modality AND abs(g.moment - x.t) <= 5
  QUALIFY ROW_NUMBER() OVER (PARTITION BY g.stream_id, g.moment, g.modality ORDER BY abs(g.moment - x.t), x.seq) = 1)"""


@query("j06_align_strict", f"WITH {GRID} SELECT g.stream_id, ROUND(g.moment, 6) AS moment, g.modality, MIN(x.seq) AS seq FROM full_grid g JOIN detections x ON x.stream_id = g.stream_id AND x.modality = g.modality AND abs(g.moment - x.t) < 0.1 GROUP BY g.stream_id, g.moment, g.modality")
def _(s, d):
    return rounded(U.align_strict(T.detections(s, d)).select("stream_id", "moment", "modality", "seq"), "moment")


@query("j07_align_window", f"WITH {GRID}, {WINDOWED} SELECT stream_id, ROUND(moment, 6) AS moment, modality, seq, score FROM aligned")
def _(s, d):
    return rounded(U.align_window(T.detections(s, d)).select("stream_id", "moment", "modality", "seq", "score"), "moment")


NEIGHBOURS = """points AS (
  SELECT stream_id, modality, moment AS t, 1 AS g, NULL::DOUBLE AS ot, NULL::DOUBLE AS score, NULL::DOUBLE AS confidence FROM full_grid
  UNION ALL SELECT stream_id, modality, t, 0, t, score, confidence FROM detections
), near AS (
  SELECT *, CASE WHEN ot IS NOT NULL THEN {'t': ot, 's': score, 'c': confidence} END AS o FROM points
), sides AS (
  SELECT stream_id, modality, t, g, last_value(o IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS a, first_value(o IGNORE NULLS) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS b FROM near WINDOW w AS (PARTITION BY stream_id, modality ORDER BY t, g)
), blended AS (
  SELECT stream_id, t AS moment, modality, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN a.s + (b.s - a.s) * ((t - a.t) / (b.t - a.t)) ELSE COALESCE(a.s, b.s) * 0.5::DOUBLE END AS score,
    CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN (a.c + (b.c - a.c) * ((t - a.t) / (b.t - a.t))) * 0.8::DOUBLE ELSE COALESCE(a.c, b.c) * 0.5::DOUBLE END AS confidence
  FROM sides WHERE g = 1 AND (a IS NOT NULL OR b IS NOT NULL) AND (a IS NULL OR b IS NULL OR b.t - a.t <= 10))"""


@query("j08_interpolate", f"WITH {GRID}, {NEIGHBOURS} SELECT stream_id, ROUND(moment, 6) AS moment, modality, ROUND(score, 6) AS score, ROUND(confidence, 6) AS confidence FROM blended")
def _(s, d):
    return rounded(U.interpolated(T.detections(s, d)), "moment", "score", "confidence")


ALIGNED = f"{GRID}, {WINDOWED}, {NEIGHBOURS}, both_ AS (SELECT stream_id, moment, modality, score, confidence, FALSE AS blended FROM aligned UNION ALL SELECT b.*, TRUE FROM blended b ANTI JOIN aligned a USING (stream_id, moment, modality))"


@query("j09_align_interpolated", f"WITH {ALIGNED} SELECT stream_id, ROUND(moment, 6) AS moment, modality, ROUND(score, 6) AS score, blended FROM both_")
def _(s, d):
    return rounded(U.align_interpolated(T.detections(s, d)).select("stream_id", "moment", "modality", "score", "blended"), "moment", "score")


@query("j11_nearest_frame", """SELECT p.moment, f.stream_id, arg_min(f.frame_id, {'d': abs(f.t - p.moment), 'i': f.frame_id}) AS frame_id FROM (SELECT DISTINCT stream_id, floor(t / 50) * 50 AS moment FROM detections) p JOIN frames f ON f.stream_id = p.stream_id AND abs(f.t - p.moment) <= 10 GROUP BY p.moment, f.stream_id""")
def _(s, d):
    frames = T.frames(s, d).select("stream_id", "frame_id", "t")
    points = T.detections(s, d).select("stream_id", (F.floor(F.col("t") / 50) * 50).cast("double").alias("moment")).distinct()
    return M.nearest(points, frames, ["stream_id"], ["moment", "stream_id"], "moment", "t", "frame_id", 10.0, ["frame_id"])


# ---- fusion ------------------------------------------------------------------------------

_V = lambda m, least="0.1": f"({m}_score IS NOT NULL AND {m}_confidence >= {least})"
WIDE = "wide AS (SELECT stream_id, moment, " + ", ".join(f"MAX({c}) FILTER (modality = '{m}') AS {m}_{c}" for m in U.MODALITIES for c in ("score", "confidence")) + " FROM aligned GROUP BY stream_id, moment)"


def fused_sql(by_confidence: bool) -> str:
    wv, wa = ("(0.4::DOUBLE / 0.7)", "(0.3::DOUBLE / 0.7)")
    fv, fa, bonus = (f"{wv} * video_confidence", f"{wa} * audio_confidence", "chat_score * 0.3 * chat_confidence") if by_confidence else (wv, wa, "chat_score * 0.3")
    n = f"({_V('video')}::INT + {_V('audio')}::INT)"
    pick = lambda m, e: f"(CASE WHEN {_V(m)} THEN {e} ELSE 0 END)"
    present = "((video_score IS NOT NULL)::INT + (audio_score IS NOT NULL)::INT + (chat_score IS NOT NULL)::INT)"
    return f"""fused AS (SELECT *, raw * (1 - 0.2::DOUBLE * ((video_score IS NULL)::INT + (audio_score IS NULL)::INT)) * CASE WHEN mean_c < 0.5 THEN 1 - 0.5::DOUBLE * (0.5 - mean_c) ELSE 1 END AS score,
      1 - ({pick('video', 'abs(video_score - mean_s)')} + {pick('audio', 'abs(audio_score - mean_s)')}) / NULLIF(n, 0) AS confidence, GREATEST(moment - 15, 0) AS start_time, moment + 15 AS end_time
      FROM (SELECT *, {n} AS n, ({pick('video', 'video_score')} + {pick('audio', 'audio_score')}) / NULLIF({n}, 0) AS mean_s,
        (COALESCE(video_confidence, 0) + COALESCE(audio_confidence, 0) + COALESCE(chat_confidence, 0)) / NULLIF({present}, 0) AS mean_c,
        CASE WHEN ({pick('video', fv)} + {pick('audio', fa)}) > 0 THEN LEAST(1, ({pick('video', fv + ' * video_score')} + {pick('audio', fa + ' * audio_score')}) / NULLIF({pick('video', fv)} + {pick('audio', fa)}, 0) + {pick('chat', bonus)}) END AS raw FROM wide) WHERE raw IS NOT NULL)"""


FUSED_OUT = "SELECT stream_id, ROUND(moment, 6) AS moment, ROUND(score, 6) AS score, ROUND(confidence, 6) AS confidence, ROUND(start_time, 6) AS start_time, ROUND(end_time, 6) AS end_time FROM fused"


def _fused(s, d, by_confidence=False):
    return U.fuse(U.pivoted(U.align_window(T.detections(s, d))), by_confidence=by_confidence)


def _out(df):
    return rounded(df.select("stream_id", "moment", "score", "confidence", "start_time", "end_time"), "moment", "score", "confidence", "start_time", "end_time")


@query("g07_weighted_fusion", f"WITH {GRID}, {WINDOWED}, {WIDE}, {fused_sql(False)} {FUSED_OUT}")
def _(s, d):
    return _out(_fused(s, d))


@query("g08_confidence_fusion", f"WITH {GRID}, {WINDOWED}, {WIDE}, {fused_sql(True)} {FUSED_OUT}")
def _(s, d):
    return _out(_fused(s, d, True))


@query("b50_fused_filter", f"WITH {GRID}, {WINDOWED}, {WIDE}, {fused_sql(False)} {FUSED_OUT} WHERE fused.score >= 0.2 AND fused.confidence >= 0.3 AND video_score IS NOT NULL AND audio_score IS NOT NULL")
def _(s, d):
    return _out(U.filter_fused(_fused(s, d), both_core=True))


_CORR = ", ".join(f"CASE WHEN COUNT(*) FILTER ({a}_score IS NOT NULL AND {b}_score IS NOT NULL) >= 3 THEN COALESCE(CASE WHEN NOT isnan(corr({a}_score, {b}_score)) THEN corr({a}_score, {b}_score) END, 0) ELSE 0 END AS {a}_{b}" for a, b in (("video", "audio"), ("video", "chat"), ("audio", "chat")))
CORR = f"cor AS (SELECT stream_id, {_CORR} FROM wide GROUP BY stream_id)"


@query("w20_modality_correlations", f"WITH {GRID}, {WINDOWED}, {WIDE}, {CORR} SELECT stream_id, ROUND(video_audio, 6) AS video_audio, ROUND(video_chat, 6) AS video_chat, ROUND(audio_chat, 6) AS audio_chat FROM cor")
def _(s, d):
    return rounded(U.correlations(U.pivoted(U.align_window(T.detections(s, d)))), "video_audio", "video_chat", "audio_chat")


@query("j14_context", f"""WITH {CAND}, mids AS (SELECT *, (start_time + end_time) / 2 AS mid FROM cand), ctx AS (
  SELECT a.id, SUM(b.score / (1 + abs(a.mid - b.mid) / 10)) / SUM(1 / (1 + abs(a.mid - b.mid) / 10)) AS context, var_pop(b.score) AS spread, COUNT(*) AS n_near FROM mids a JOIN mids b ON a.stream_id = b.stream_id AND abs(a.mid - b.mid) <= 60 AND a.id <> b.id GROUP BY a.id)
  SELECT m.id, ROUND(COALESCE(0.85 * score + 0.15 * context, score), 12) AS refined, ROUND(1 - LEAST(1, COALESCE(spread, 0)), 12) AS agreement, COALESCE(n_near, 0) AS n_near FROM mids m LEFT JOIN ctx USING (id)""")
def _(s, d):
    return rounded(U.refine_by_context(candidates(s, d)).select("id", "refined", "agreement", "n_near"), "refined", "agreement", digits=12)


@query("b52_final_filter", f"""WITH {CAND}, z AS (SELECT *, COUNT(*) OVER w AS n, abs(score - AVG(score) OVER w) / GREATEST(0.1, stddev_pop(score) OVER w) AS z FROM cand WHERE score >= 0.1 WINDOW w AS (PARTITION BY stream_id))
  SELECT id, stream_id FROM z QUALIFY (n <= 3 OR z <= 2) OR NOT bool_or(n <= 3 OR z <= 2) OVER (PARTITION BY stream_id)""")
def _(s, d):
    return U.final_filter(candidates(s, d)).select("id", "stream_id")


@query("g17_boundaries", f"""WITH {CAND}, moved AS (SELECT id, GREATEST(0, start_time + GREATEST(-5, LEAST(5, -10 * score))) AS a, end_time + GREATEST(-5, LEAST(5, 20 * (confidence - 0.5))) AS b FROM cand)
  SELECT id, ROUND(CASE WHEN b - a < 10 OR b - a > 120 THEN GREATEST(0, (a + b) / 2 - GREATEST(10, LEAST(120, b - a)) / 2) ELSE a END, 9) AS new_start, ROUND(CASE WHEN b - a < 10 OR b - a > 120 THEN (a + b) / 2 + GREATEST(10, LEAST(120, b - a)) / 2 ELSE b END, 9) AS new_end FROM moved""")
def _(s, d):
    return rounded(U.bounded(candidates(s, d), -10 * F.col("score"), 20 * (F.col("confidence") - 0.5)).select("id", "new_start", "new_end"), "new_start", "new_end", digits=9)


# ---- series ------------------------------------------------------------------------------


@query("w01_moving_average", f"WITH {SER} SELECT id, ROUND(AVG(v) OVER (PARTITION BY series ORDER BY t RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING), 6) AS smooth FROM ser")
def _(s, d):
    return rounded(S.moving_average(series(s, d)).select("id", "smooth"), "smooth")


@query("w02_blended_average", f"WITH {SER} SELECT id, ROUND(0.7 * v + 0.3 * AVG(v) OVER (PARTITION BY series ORDER BY t RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING), 10) AS smooth FROM ser")
def _(s, d):
    return rounded(S.moving_average(series(s, d), strength=0.3).select("id", "smooth"), "smooth", digits=10)


@query("w03_exponential", f"""WITH RECURSIVE {SER}, numbered AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY series ORDER BY t, id) AS n FROM ser), ema AS (
  SELECT series, id, n, v AS smooth FROM numbered WHERE n = 1 UNION ALL SELECT x.series, x.id, x.n, 0.3::DOUBLE * x.v + 0.7::DOUBLE * e.smooth FROM ema e JOIN numbered x ON x.series = e.series AND x.n = e.n + 1) SELECT id, ROUND(smooth, 6) AS smooth FROM ema""")
def _(s, d):
    return rounded(S.exponential(series(s, d), 0.3).select("id", "smooth"), "smooth")


@query("w05_gaussian", f"""WITH {SER} SELECT a.id, ROUND(0.7 * a.v + 0.3 * SUM(b.v * exp(-pow(a.t - b.t, 2) / (2 * (10 / 3.0::DOUBLE) * (10 / 3.0::DOUBLE)))) / SUM(exp(-pow(a.t - b.t, 2) / (2 * (10 / 3.0::DOUBLE) * (10 / 3.0::DOUBLE)))), 6) AS smooth
  FROM ser a JOIN ser b ON a.series = b.series AND abs(a.t - b.t) <= 4 * (10 / 3.0::DOUBLE) GROUP BY a.id, a.v""")
def _(s, d):
    return rounded(S.gaussian(series(s, d)).select("id", "smooth"), "smooth")


@query("w06_median", f"WITH {SER} SELECT id, ROUND(0.7 * v + 0.3 * quantile_cont(v, 0.5) OVER (PARTITION BY series ORDER BY t, id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS smooth FROM ser")
def _(s, d):
    return rounded(S.moving_median(series(s, d)).select("id", "smooth"), "smooth")


@query("w08_time_correlation", f"""WITH {SER}, local AS (SELECT series, COUNT(*) OVER w AS n, abs(corr(t, v) OVER w) AS c FROM ser WINDOW w AS (PARTITION BY series ORDER BY t RANGE BETWEEN CURRENT ROW AND 30 FOLLOWING))
  SELECT series, ROUND(AVG(CASE WHEN c IS NULL OR isnan(c) THEN 0 ELSE c END), 5) AS correlation FROM local WHERE n >= 3 GROUP BY series""")
def _(s, d):
    return rounded(S.time_correlation(series(s, d)), "correlation", digits=5)


@query("w10_spacing_outliers", f"""WITH {SER}, stepped AS (SELECT *, t - LAG(t) OVER (PARTITION BY series ORDER BY t, id) AS step FROM ser)
  SELECT id, COALESCE(COUNT(*) OVER w >= 10 AND abs(step - AVG(step) OVER w) / NULLIF(stddev_pop(step) OVER w, 0) > 3, FALSE) AS outlier FROM stepped WINDOW w AS (PARTITION BY series)""")
def _(s, d):
    return S.spacing_outliers(series(s, d)).select("id", "outlier")


@query("w11_drift", f"""WITH {SER}, recent AS (SELECT series, t, t * (1 + 0.001 * series) AS ot FROM ser QUALIFY ROW_NUMBER() OVER (PARTITION BY series ORDER BY t DESC, id DESC) <= 100)
  SELECT series, ROUND(CASE WHEN COUNT(*) >= 10 THEN regr_slope(ot - t, t) ELSE 0 END, 6) AS drift FROM recent GROUP BY series""")
def _(s, d):
    pairs = series(s, d).withColumn("ref", F.col("t")).withColumn("t", F.col("t") * (1 + 0.001 * F.col("series")))
    return rounded(S.drift(pairs), "drift")


@query("w09_local_peaks", f"WITH {SER} SELECT id, v FROM (SELECT *, LAG(v) OVER w AS p, LEAD(v) OVER w AS n FROM ser WINDOW w AS (PARTITION BY series ORDER BY t, id)) WHERE v > p AND v >= n AND v >= 0.5")
def _(s, d):
    return S.local_peaks(series(s, d)).select("id", "v")


@query("s08_complexity", f"""WITH {SER} SELECT id, ROUND(LEAST(1, 0.4 * LEAST(1, 10 * var_pop(v) OVER w) + 0.4 * AVG((v > 0.5)::INT) OVER w + 0.2 * LEAST(1, 5 * var_pop(v) OVER w)), 6) AS complexity FROM ser WINDOW w AS (PARTITION BY series ORDER BY t, id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)""")
def _(s, d):
    return rounded(S.complexity(series(s, d)).select("id", "complexity"), "complexity")


# ---- merging, ranking, selection -----------------------------------------------------------


@query("u01_islands", f"""WITH {CAND}, reach AS (SELECT *, MAX(end_time) OVER (PARTITION BY stream_id ORDER BY start_time, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM cand), numbered AS (
  SELECT *, SUM(CASE WHEN m IS NULL OR start_time > m THEN 1 ELSE 0 END) OVER (PARTITION BY stream_id ORDER BY start_time, id) AS island FROM reach)
  SELECT stream_id, CAST(island AS BIGINT) AS island, ROUND(MIN(start_time), 6) AS start_time, ROUND(MAX(end_time), 6) AS end_time, MAX(score) AS score, COUNT(*) AS n FROM numbered GROUP BY stream_id, island""")
def _(s, d):
    return rounded(K.merged_islands(candidates(s, d)), "start_time", "end_time")


_NUM = "numbered AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY stream_id ORDER BY start_time, id) AS nth FROM cand)"


@query("u02_merge_in_order", f"""WITH RECURSIVE {CAND}, {_NUM}, walk AS (
  SELECT stream_id, nth, id AS first_id, start_time, end_time, score, 1::BIGINT AS n FROM numbered WHERE nth = 1
  UNION ALL SELECT x.stream_id, x.nth, CASE WHEN x.start_time - w.end_time <= 10 THEN w.first_id ELSE x.id END, CASE WHEN x.start_time - w.end_time <= 10 THEN w.start_time ELSE x.start_time END, x.end_time,
    CASE WHEN x.start_time - w.end_time <= 10 THEN GREATEST(w.score, x.score) ELSE x.score END, CASE WHEN x.start_time - w.end_time <= 10 THEN w.n + 1 ELSE 1 END FROM walk w JOIN numbered x ON x.stream_id = w.stream_id AND x.nth = w.nth + 1)
  SELECT stream_id, first_id AS id, ROUND(start_time, 6) AS start_time, ROUND(arg_max(end_time, nth), 6) AS end_time, MAX(score) AS score, MAX(n) AS n FROM walk GROUP BY stream_id, first_id, start_time""")
def _(s, d):
    return rounded(K.merged_in_order(candidates(s, d)), "start_time", "end_time")


@query("u04_merge_by_category", f"""WITH RECURSIVE {CAND}, {_NUM}, walk AS (
  SELECT stream_id, nth, id AS first_id, category, start_time, end_time, confidence, 1::BIGINT AS n FROM numbered WHERE nth = 1
  UNION ALL SELECT x.stream_id, x.nth, CASE WHEN j THEN w.first_id ELSE x.id END, x.category, CASE WHEN j THEN w.start_time ELSE x.start_time END, CASE WHEN j THEN GREATEST(w.end_time, x.end_time) ELSE x.end_time END,
    CASE WHEN j THEN (w.confidence + x.confidence) / 2 ELSE x.confidence END, CASE WHEN j THEN w.n + 1 ELSE 1 END
  FROM walk w JOIN numbered x ON x.stream_id = w.stream_id AND x.nth = w.nth + 1 CROSS JOIN LATERAL (SELECT x.category = w.category AND x.start_time - w.end_time <= 5 AS j) z)
  SELECT stream_id, first_id AS id, ROUND(arg_max(end_time, nth), 9) AS end_time, ROUND(arg_max(confidence, nth), 9) AS confidence, MAX(n) AS n FROM walk GROUP BY stream_id, first_id""")
def _(s, d):
    return rounded(K.merged_by_category(candidates(s, d)).select("stream_id", "id", "end_time", "confidence", "n"), "end_time", "confidence", digits=9)


CLUSTERS = f"""{_NUM}, walk AS (
  SELECT stream_id, nth, id, score, confidence, start_time AS a, end_time AS b, 0::BIGINT AS cluster FROM numbered WHERE nth = 1
  UNION ALL SELECT x.stream_id, x.nth, x.id, x.score, x.confidence, x.start_time, CASE WHEN j THEN GREATEST(w.b, x.end_time) ELSE x.end_time END, CASE WHEN j THEN w.cluster ELSE w.cluster + 1 END
  FROM walk w JOIN numbered x ON x.stream_id = w.stream_id AND x.nth = w.nth + 1 CROSS JOIN LATERAL (SELECT GREATEST(0, LEAST(w.b, x.end_time) - GREATEST(w.a, x.start_time)) / (GREATEST(w.b, x.end_time) - LEAST(w.a, x.start_time)) >= 0.5 AS j) z)"""


@query("g01_temporal_clusters", f"WITH RECURSIVE {CAND}, {CLUSTERS} SELECT stream_id, id, cluster FROM walk")
def _(s, d):
    return K.temporal_clusters(candidates(s, d)).select("stream_id", "id", "cluster")


@query("l18_cluster_best", f"WITH RECURSIVE {CAND}, {CLUSTERS} SELECT stream_id, cluster, arg_max(id, {{'a': score * confidence, 'b': -id}}) AS id, COUNT(*) AS n FROM walk GROUP BY stream_id, cluster")
def _(s, d):
    return K.best_of_clusters(K.temporal_clusters(candidates(s, d))).select("stream_id", "cluster", "id", "n")


@query("b51_rank_filter", f"WITH {CAND} SELECT id FROM cand WHERE score >= 0.3 AND end_time - start_time BETWEEN 5 AND 240")
def _(s, d):
    return K.filter_candidates(candidates(s, d)).select("id")


_RANK = "CAST(ROW_NUMBER() OVER (PARTITION BY stream_id ORDER BY rank_score DESC, id) AS INTEGER) AS nth"


@query("l07_by_score", f"WITH {CAND}, r AS (SELECT *, ROUND(score * confidence, 9) AS rank_score FROM cand) SELECT id, {_RANK} FROM r")
def _(s, d):
    return K.ranked(candidates(s, d)).select("id", "nth")


_MULTI = "ROUND(0.4::DOUBLE * score + 0.3::DOUBLE * confidence + 0.1::DOUBLE * GREATEST(0, 1 - abs(end_time - start_time - 40) / 40) + 0.05::DOUBLE, 9) AS rank_score"


@query("l08_multi_criteria", f"WITH {CAND}, r AS (SELECT *, {_MULTI} FROM cand) SELECT id, ROUND(rank_score, 6) AS rank_score, {_RANK} FROM r")
def _(s, d):
    return rounded(K.ranked(candidates(s, d), "criteria").select("id", "rank_score", "nth"), "rank_score")


@query("l11_first_n", f"WITH {CAND}, r AS (SELECT *, ROUND(score * confidence, 9) AS rank_score FROM cand) SELECT id, stream_id FROM r QUALIFY ROW_NUMBER() OVER (PARTITION BY stream_id ORDER BY rank_score DESC, id) <= 10")
def _(s, d):
    return K.first_n(K.ranked(candidates(s, d)), 10).select("id", "stream_id")


@query("l12_threshold", f"""WITH {CAND}, r AS (SELECT *, ROUND(score * confidence, 9) AS rank_score FROM cand), n AS (SELECT *, score >= 0.9 AS p, ROW_NUMBER() OVER (PARTITION BY stream_id ORDER BY rank_score DESC, id) AS nth FROM r), q AS (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY stream_id ORDER BY p DESC, nth) AS place FROM n) SELECT id, stream_id FROM q WHERE p AND place <= 10 OR place <= 3""")
def _(s, d):
    return K.above_threshold(K.ranked(candidates(s, d)), 10, 3, 0.9).select("id", "stream_id")


@query("l14_spread_in_time", f"""WITH RECURSIVE {CAND}, {_NUM}, walk AS (
  SELECT stream_id, nth, id, start_time AS kept_at, TRUE AS kept FROM numbered WHERE nth = 1
  UNION ALL SELECT x.stream_id, x.nth, x.id, CASE WHEN x.start_time - w.kept_at >= 30 THEN x.start_time ELSE w.kept_at END, x.start_time - w.kept_at >= 30 FROM walk w JOIN numbered x ON x.stream_id = w.stream_id AND x.nth = w.nth + 1) SELECT stream_id, id FROM walk WHERE kept""")
def _(s, d):
    return K.spread_in_time(candidates(s, d)).select("stream_id", "id")


@query("l19_rank_and_select", f"WITH RECURSIVE {CAND.replace('FROM highlights', 'FROM highlights WHERE viewer_engagement >= 0.3 AND end_time - start_time BETWEEN 5 AND 240')}, {CLUSTERS}, best AS (SELECT stream_id, cluster, arg_max({{'id': id, 's': score, 'c': confidence}}, {{'a': score * confidence, 'b': -id}}) AS x FROM walk GROUP BY stream_id, cluster) SELECT stream_id, x.id AS id, CAST(ROW_NUMBER() OVER (PARTITION BY stream_id ORDER BY ROUND(x.s * x.c, 9) DESC, x.id) AS INTEGER) AS nth FROM best QUALIFY nth <= 10")
def _(s, d):
    best = K.best_of_clusters(K.temporal_clusters(K.filter_candidates(candidates(s, d))))
    return K.first_n(K.ranked(best), 10).select("stream_id", "id", "nth")
