"""Queries of clusters by features and density, of frames of pixels and of dispatchers, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenspan.functions import scalar as C
from lumenspan.operators import fusion as U
from lumenspan.operators import pixels as P
from lumenspan.operators import ranking as K
from lumenspan.operators import series as S
from lumenspan.operators import sync as Y
from lumenspan.plans.prelude import with_tables
from lumenspan.plans.q_temporal import CAND, CLUSTERS, candidates, rounded
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


# ---- clusters ------------------------------------------------------------------------------

_UNIT = "vecs AS (SELECT id, stream_id, start_time, [score / norm, confidence / norm] AS u FROM (SELECT *, sqrt(score * score + confidence * confidence) AS norm FROM cand))"
_NEAR = "list_position(list_transform(w.leaders, lambda l: l[1] * x.u[1] + l[2] * x.u[2] >= {least}::DOUBLE), TRUE)"


def _leader_sql(source, key, least):
    near = _NEAR.format(least=least)
    return f"""ordered AS MATERIALIZED (SELECT *, ROW_NUMBER() OVER (PARTITION BY {key} ORDER BY start_time, id) AS nth FROM {source}), lead_walk AS (SELECT {key}, nth, id, [u] AS leaders, 0::BIGINT AS cluster FROM ordered WHERE nth = 1
  UNION ALL SELECT {', '.join('x.' + k.strip() for k in key.split(','))}, x.nth, x.id, CASE WHEN {near} > 0 THEN w.leaders ELSE list_append(w.leaders, x.u) END, CAST(CASE WHEN {near} > 0 THEN {near} - 1 ELSE len(w.leaders) END AS BIGINT) FROM lead_walk w JOIN ordered x ON {' AND '.join(f'x.{k.strip()} = w.{k.strip()}' for k in key.split(','))} AND x.nth = w.nth + 1)"""


@query("g02_feature_clusters", f"WITH RECURSIVE {CAND}, {_UNIT}, {_leader_sql('vecs', 'stream_id', 0.97)} SELECT stream_id, id, cluster FROM lead_walk")
def _(s, d):
    return K.feature_clusters(candidates(s, d), ["score", "confidence"], 0.97)


@query("g04_density_clusters", f"""WITH RECURSIVE {CAND}, z AS (SELECT id, stream_id, {', '.join(f'({f} - AVG({f}) OVER p) / NULLIF(stddev_pop({f}) OVER p, 0) AS z_{f}' for f in ('start_time', 'end_time', 'score', 'confidence'))} FROM cand WINDOW p AS (PARTITION BY stream_id)),
  links AS (SELECT a.id AS a, b.id AS b FROM z a JOIN z b ON a.stream_id = b.stream_id AND a.id <> b.id WHERE sqrt({' + '.join(f'pow(a.z_{f} - b.z_{f}, 2)' for f in ('start_time', 'end_time', 'score', 'confidence'))}) <= 0.3), reach AS (SELECT id, id AS other FROM z UNION SELECT r.id, l.b FROM reach r JOIN links l ON r.other = l.a)
  SELECT z.stream_id, z.id, m.cluster FROM z JOIN (SELECT id, MIN(other) AS cluster FROM reach GROUP BY id) m USING (id)""")
def _(s, d):
    return K.clustered(candidates(s, d), "density")


@query("g05_hybrid_clusters", f"""WITH RECURSIVE {CAND}, {CLUSTERS}, timed AS (SELECT stream_id, id, cluster AS time_cluster, COUNT(*) OVER (PARTITION BY stream_id, cluster) AS n FROM walk), {_UNIT}, large AS (SELECT v.id, v.start_time, v.u, t.stream_id, t.time_cluster FROM vecs v JOIN timed t USING (id) WHERE n > 3), {_leader_sql('large', 'stream_id, time_cluster', 0.8)}
  SELECT t.stream_id, t.id, CAST(DENSE_RANK() OVER (PARTITION BY t.stream_id ORDER BY t.time_cluster, COALESCE(l.cluster, 0)) - 1 AS BIGINT) AS cluster FROM timed t LEFT JOIN lead_walk l ON l.id = t.id""")
def _(s, d):
    return K.clustered(candidates(s, d), "hybrid")


@query("g06_clusters_by_method", f"WITH RECURSIVE {CAND}, {CLUSTERS} SELECT stream_id, cluster, COUNT(*) AS n FROM walk GROUP BY stream_id, cluster")
def _(s, d):
    return K.clustered(candidates(s, d)).groupBy("stream_id", "cluster").agg(F.count("*").alias("n"))


# ---- frames of pixels ------------------------------------------------------------------------

_PIX = "pix AS (SELECT vec_id % 10 AS stream_id, vec_id AS frame_id, list_transform(embedding, lambda x: LEAST(255, abs(x::DOUBLE) * 600)) AS p FROM embeddings), fr AS (SELECT *, LAG(p) OVER (PARTITION BY stream_id ORDER BY frame_id) AS q FROM pix)"


def _frames(s, d):
    pixels = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.least(F.lit(255.0), F.abs(x) * 600))
    rows = T.read(s, d, "embeddings").select((F.col("vec_id") % 10).alias("stream_id"), F.col("vec_id").alias("frame_id"), pixels.alias("pixels"))
    return P.measured_frames(rows, 8, block=4)


@query("h37_frame_motion", f"WITH {_PIX} SELECT frame_id, ROUND(list_sum(list_transform(range(0, 16), lambda k: abs(p[k // 4 * 8 + k % 4 + 1] - q[k // 4 * 8 + k % 4 + 1]))) / 16 / 4, 6) AS motion, ROUND(list_sum(list_transform(range(1, 65), lambda i: abs(p[i] - q[i]))) / 64 / 255, 6) AS scene_change FROM fr")
def _(s, d):
    return rounded(_frames(s, d).select("frame_id", "motion", "scene_change"), "motion", "scene_change")


_HIST = lambda v: f"list_transform(range(0, 16), lambda b: len(list_filter({v}, lambda x: LEAST(15, floor(x / (255 / 16::DOUBLE))) = b)) / 64)"


@query("h36_color_change", f"WITH {_PIX}, h AS (SELECT frame_id, {_HIST('p')} AS a, CASE WHEN q IS NOT NULL THEN {_HIST('q')} END AS b FROM fr) SELECT frame_id, ROUND(list_sum(list_transform(range(1, 17), lambda i: abs(a[i] - b[i]))), 6) AS color_change FROM h")
def _(s, d):
    return rounded(_frames(s, d).select("frame_id", "color_change"), "color_change")


_AT = lambda r, c: f"p[(i // 6 + {1 + r}) * 8 + i % 6 + {1 + c} + 1]"
_GX = f"({_AT(-1, 1)} - {_AT(-1, -1)} + 2 * ({_AT(0, 1)} - {_AT(0, -1)}) + {_AT(1, 1)} - {_AT(1, -1)})"
_GY = f"({_AT(1, -1)} - {_AT(-1, -1)} + 2 * ({_AT(1, 0)} - {_AT(-1, 0)}) + {_AT(1, 1)} - {_AT(-1, 1)})"


@query("h38_edge_density", f"WITH {_PIX} SELECT frame_id, ROUND(list_sum(list_transform(range(0, 36), lambda i: (sqrt(pow({_GX}, 2) + pow({_GY}, 2)) > 25.5)::INT)) / 64, 6) AS edge_density, ROUND(list_var_pop(p) / 65025, 6) AS variance FROM fr")
def _(s, d):
    return rounded(_frames(s, d).select("frame_id", "edge_density", "variance"), "edge_density", "variance")


@query("h39_frame_quality", None)  # a filter with mirrored borders and an entropy; a test follows it pixel by pixel
def _(s, d):
    return rounded(_frames(s, d).select("frame_id", "quality"), "quality")


@query("h33_video_activity", f"""WITH {_PIX}, m AS (SELECT stream_id, list_sum(list_transform(range(0, 16), lambda k: abs(p[k // 4 * 8 + k % 4 + 1] - q[k // 4 * 8 + k % 4 + 1]))) / 16 / 4 AS motion, list_sum(list_transform(range(1, 65), lambda i: abs(p[i] - q[i]))) / 64 / 255 AS scene,
    list_sum(list_transform(range(0, 36), lambda i: (sqrt(pow({_GX}, 2) + pow({_GY}, 2)) > 25.5)::INT)) / 64 AS edge, list_var_pop(p) / 65025 AS var FROM fr)
  SELECT stream_id, COUNT(*) AS n, ROUND(1 / (1 + exp(-AVG(motion) / 255)), 6) AS motion_score, ROUND(1 / (1 + exp(-AVG(scene))), 6) AS scene_score, ROUND(GREATEST(0, LEAST(1, 1 - var_pop(scene))), 6) AS scene_stability, ROUND(1 / (1 + exp(-(AVG(edge) + AVG(var)) / 2)), 6) AS complexity FROM m GROUP BY stream_id""")
def _(s, d):
    found = P.activity(_frames(s, d))
    return rounded(found.select("stream_id", "n", "motion_score", "scene_score", "scene_stability", "complexity"), "motion_score", "scene_score", "scene_stability", "complexity")


# ---- segments by keyframes, dispatchers and small rules -------------------------------------------


@query("s03_keyframe_segments", """WITH RECURSIVE sec AS (SELECT stream_id, CAST(floor(t) AS BIGINT) AS second, COUNT(*) AS n, MAX(is_keyframe::INT) AS key FROM frames GROUP BY ALL), o AS MATERIALIZED (SELECT *, ROW_NUMBER() OVER (PARTITION BY stream_id ORDER BY second) AS i FROM sec),
  raw AS (SELECT stream_id, i, second, n, key, second AS start, n AS cnt, 0 AS missed FROM o WHERE i = 1 UNION ALL SELECT o.stream_id, o.i, o.second, o.n, o.key, CASE WHEN c THEN w.second + 1 ELSE w.start END, CASE WHEN c THEN o.n ELSE w.cnt + o.n END, CASE WHEN c THEN CASE WHEN f THEN 0 ELSE w.missed + (w.key = 0)::INT END ELSE w.missed END
    FROM raw w CROSS JOIN LATERAL (SELECT w.key = 1 AND w.cnt >= 3 AS f) y CROSS JOIN LATERAL (SELECT y.f OR w.cnt >= 900 OR w.second - w.start >= 30 OR w.missed >= 3 AS c) z JOIN o ON o.stream_id = w.stream_id AND o.i = w.i + 1)
  SELECT stream_id, start::DOUBLE AS start_time, (second + 1)::DOUBLE AS end_time, cnt AS n FROM raw WHERE (key = 1 AND cnt >= 3) OR cnt >= 900 OR second - start >= 30 OR missed >= 3""")
def _(s, d):
    return Y.keyframe_segments(T.frames(s, d), fewest=3)


@query("g16_aligned_by_method", "WITH x AS (SELECT DISTINCT stream_id, t AS moment FROM detections) SELECT stream_id, COUNT(*) AS moments FROM x GROUP BY stream_id")
def _(s, d):
    return U.aligned(T.detections(s, d), "window").select("stream_id", "moment").distinct().groupBy("stream_id").agg(F.count("*").alias("moments"))


@query("g23_enhanced_features", f"WITH {CAND} SELECT id, ROUND(CASE WHEN end_time - start_time BETWEEN 20 AND 96 THEN 1 WHEN end_time - start_time < 20 THEN (end_time - start_time) / 20 ELSE GREATEST(0.1, 96 / (end_time - start_time)) END, 6) AS duration_score, ROUND(score * confidence, 9) AS weighted, ROUND((score + confidence + 0.5) / 3, 6) AS feature_mean, ROUND(list_stddev_pop([score, confidence, 0.5::DOUBLE]), 6) AS feature_std, GREATEST(score, confidence, 0.5) AS feature_max FROM cand")
def _(s, d):
    found = U.enhanced_features(candidates(s, d), F.array(F.col("score"), F.col("confidence"), F.lit(0.5)))
    found = found.select("id", "duration_score", F.round("weighted", 9).alias("weighted"), "feature_mean", "feature_std", "feature_max")
    return rounded(found, "duration_score", "feature_mean", "feature_std")


_SER = "ser AS (SELECT stream_id AS series, seq AS id, t, score AS v FROM detections)"


@query("k05_smoothed_by_method", f"WITH {_SER} SELECT id, ROUND(0.7 * v + 0.3 * quantile_cont(v, 0.5) OVER (PARTITION BY series ORDER BY t, id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS smooth FROM ser")
def _(s, d):
    rows = T.detections(s, d).select(F.col("stream_id").alias("series"), F.col("seq").alias("id"), "t", F.col("score").alias("v"))
    return rounded(S.smoothed(rows, "median").select("id", "smooth"), "smooth")


@query("k06_moved_borders", f"WITH {CAND}, m AS (SELECT *, ROUND(CASE WHEN b - a < 10 OR b - a > 120 THEN 1 ELSE 0 END, 0) AS off FROM (SELECT *, GREATEST(0, start_time - 2) AS a, end_time + 2 AS b FROM cand)) SELECT stream_id, COUNT(*) AS n FROM m GROUP BY stream_id")
def _(s, d):
    moved = U.bounded(candidates(s, d), F.lit(-2.0), F.lit(2.0))
    changed = (F.abs(F.col("new_start") - F.col("start_time")) > 0.1) | (F.abs(F.col("new_end") - F.col("end_time")) > 0.1)
    return moved.where(changed).groupBy("stream_id").agg(F.count("*").alias("n"))


@query("k33_tags", "SELECT stream_id, array_to_string(list_sort(list_distinct(flatten(list(tags))))[1:10], ',') AS tags FROM highlights GROUP BY stream_id")
def _(s, d):
    # Tags come from a short list, so the set stays small.
    tags = F.array_sort(F.array_distinct(F.flatten(F.collect_set("tags"))))
    return T.highlights(s, d).groupBy("stream_id").agg(F.array_join(F.slice(tags, 1, 10), ",").alias("tags"))


@query("k34_metadata", "SELECT h.id, h.title, ROUND(h.end_time - h.start_time, 6) AS length, s.platform, s.status FROM highlights h LEFT JOIN streams s ON s.id = h.stream_id")
def _(s, d):
    streams = T.streams(s, d).select(F.col("id").alias("stream_id"), "platform", "status")
    return T.highlights(s, d).join(streams, "stream_id", "left").select("id", "title", F.round(F.col("end_time") - F.col("start_time"), 6).alias("length"), "platform", "status")


@query("k47_jittered_delays", "SELECT event_id, CAST(floor(d + d * 0.1::DOUBLE * (0.5::DOUBLE - (event_id % 1000) / 1000)) AS BIGINT) AS delay FROM (SELECT event_id, LEAST(60 * pow(2, retry_count), 3600)::DOUBLE AS d FROM webhook_events)")
def _(s, d):
    found = C.jittered_delay(F.col("retry_count"), (F.col("event_id") % 1000) / 1000)
    return T.webhook_events(s, d).select("event_id", found.alias("delay"))


@query("h66_completed_usage", "SELECT id, quantity AS quantity, ROUND(quantity * rate, 8) AS cost, COALESCE(period_end, TIMESTAMP '2024-02-01') AS ended FROM usage_records")
def _(s, d):
    ended = F.coalesce("period_end", F.lit("2024-02-01").cast("timestamp_ntz"))
    return T.usage_records(s, d).select("id", "quantity", F.round(F.col("quantity") * F.col("rate"), 8).alias("cost"), ended.alias("ended"))


@query("a23_audio_chunks", "SELECT id, CAST(k AS INTEGER) AS chunk, ROUND(start_time + k * 10, 9) AS start_time, ROUND(LEAST(end_time, start_time + (k + 1) * 10), 9) AS end_time FROM (SELECT *, UNNEST(range(0, CAST(ceil((end_time - start_time) / 10) AS BIGINT))) AS k FROM highlights)")
def _(s, d):
    return rounded(Y.chunks(T.highlights(s, d), 10.0).select("id", "chunk", "start_time", "end_time"), "start_time", "end_time", digits=9)
