"""Queries of segments by strategy, in batch and live form, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenspan.operators import sync as Y
from lumenspan.plans.prelude import with_tables
from lumenspan.plans.q_temporal import rounded
from lumenspan.sources import tables as T
from lumenspan.sources.shared import fresh_path
from lumenspan.streaming import segments as G

QUERIES, SQL = {}, {}
RULES = G.Rules(fewest=3)
DELAY = 10


def query(name: str, sql: str | None):
    """Register a query under ``name`` together with its SQL."""

    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = with_tables(sql)
        return f

    return add


def measured(frames):
    """Frames with motion, scene change and loudness."""
    return frames.withColumn("motion", F.col("quality")).withColumn("scene", F.col("size_bytes") / 100000).withColumn("audio", F.col("frame_id") % 10 / 10)


#: Complexity follows the last hundred frames of a run; only the cuts depend on the cut before, so slots are walked one by one.
_ADAPTIVE = """mf AS (SELECT stream_id, frame_id, t, is_keyframe, quality, quality AS motion, size_bytes / 100000.0::DOUBLE AS scene, frame_id % 10 / 10.0::DOUBLE AS audio FROM frames),
  gaps AS (SELECT *, CASE WHEN t - LAG(t) OVER (PARTITION BY stream_id ORDER BY t, frame_id) > 60 THEN 1 ELSE 0 END AS opens FROM mf),
  placed AS (SELECT *, SUM(opens) OVER (PARTITION BY stream_id ORDER BY t, frame_id) AS run, CAST(floor(t / 0.5) AS BIGINT) AS slot FROM gaps),
  rated AS (SELECT *, round(LEAST(0.4::DOUBLE * LEAST(var_pop(motion) OVER h * 10, 1) + 0.4::DOUBLE * avg(CASE WHEN scene > 0.5 THEN 1 ELSE 0 END) OVER h + 0.2::DOUBLE * LEAST(var_pop(audio) OVER h * 5, 1), 1), 9) AS complexity,
    (ROW_NUMBER() OVER o >= 3) AND (max(scene) OVER (o ROWS 2 PRECEDING) > 0.8 OR (ROW_NUMBER() OVER o >= 5 AND max(motion) OVER (o ROWS 4 PRECEDING) < 0.3)) AS boundary
    FROM placed WINDOW o AS (PARTITION BY stream_id, run ORDER BY t, frame_id), h AS (PARTITION BY stream_id, run ORDER BY t, frame_id ROWS 99 PRECEDING)),
  slots AS (SELECT stream_id, run, slot, COUNT(*) AS n, COUNT(*) FILTER (is_keyframe) AS keys, COALESCE(SUM(quality) FILTER (quality > 0), 0) AS qs, COUNT(*) FILTER (quality > 0) AS qn, arg_max(complexity, {'a': t, 'b': frame_id}) AS complexity, arg_max(boundary, {'a': t, 'b': frame_id}) AS boundary FROM rated GROUP BY ALL),
  nth AS MATERIALIZED (SELECT *, slot * 0.5::DOUBLE AS pos, CASE WHEN complexity > 0.5 THEN 5 ELSE 5 + 25 * (1 - complexity / 0.5::DOUBLE) END AS target, ROW_NUMBER() OVER (PARTITION BY stream_id, run ORDER BY slot) AS i, COUNT(*) OVER (PARTITION BY stream_id, run) AS last FROM slots),
  walk AS (SELECT stream_id, run, i, last, pos, pos AS start, n AS cn, keys AS ck, qs AS cqs, qn AS cqn, complexity, (boundary OR n >= 900 OR 0 >= target) AND n >= 3 AS cut FROM nth WHERE i = 1
    UNION ALL SELECT x.stream_id, x.run, x.i, x.last, x.pos, y.start, y.n, y.k, y.qs, y.qn, x.complexity, (x.pos - y.start >= x.target OR x.boundary OR y.n >= 900) AND y.n >= 3
    FROM walk w JOIN nth x ON x.stream_id = w.stream_id AND x.run = w.run AND x.i = w.i + 1
    CROSS JOIN LATERAL (SELECT CASE WHEN w.cut THEN w.pos ELSE w.start END AS start, x.n + CASE WHEN w.cut THEN 0 ELSE w.cn END AS n, x.keys + CASE WHEN w.cut THEN 0 ELSE w.ck END AS k, x.qs + CASE WHEN w.cut THEN 0 ELSE w.cqs END AS qs, x.qn + CASE WHEN w.cut THEN 0 ELSE w.cqn END AS qn) y),
  adaptive AS (SELECT stream_id, start AS start_time, CASE WHEN cut THEN pos ELSE pos + 0.5::DOUBLE END AS end_time, CAST(cn AS BIGINT) AS n, CAST(ck AS BIGINT) AS keyframes, CASE WHEN cqn > 0 THEN cqs / cqn ELSE 1 END AS quality, CASE WHEN cut THEN complexity ELSE 0.5 END AS complexity FROM walk WHERE cut OR i = last)"""
_SHOWN = "start_time, end_time, n, keyframes, ROUND(quality, 6) AS quality"


@query("s04_adaptive_segments", f"WITH RECURSIVE {_ADAPTIVE} SELECT stream_id, {_SHOWN}, ROUND(complexity, 6) AS complexity FROM adaptive")
def _(s, d):
    return rounded(G.adaptive(measured(T.frames(s, d)), RULES), "quality", "complexity")


@query("s05_scene_segments", f"WITH RECURSIVE {_ADAPTIVE} SELECT stream_id, 'scene_based' AS strategy, {_SHOWN} FROM adaptive")
def _(s, d):
    found = by_strategy(measured(T.frames(s, d)), "scene_based")
    return rounded(found.select("stream_id", "strategy", "start_time", "end_time", "n", "keyframes", "quality"), "quality")


def by_strategy(frames, strategy: str):
    """The batch form of a named strategy, as rows (stream_id, strategy, start_time, end_time, n, keyframes, quality)."""
    if strategy in ("adaptive", "scene_based"):
        found = G.adaptive(frames, RULES)
    elif strategy in ("fixed_duration", "event_driven"):
        found = Y.segments(frames, 10.0)
        found = found.withColumn("start_time", F.col("segment") * 10.0).withColumn("end_time", F.col("segment") * 10.0 + 10)
    elif strategy == "sliding_window":
        found = Y.frame_windows(frames, 10.0, 8.0).withColumn("end_time", F.col("start_time") + 10)
    else:
        raise ValueError(f"no batch form: {strategy}")
    return found.select("stream_id", F.lit(strategy).alias("strategy"), "start_time", "end_time", "n", "keyframes", "quality")


_FIXED = "SELECT stream_id, floor(t / 10) * 10 AS start_time, floor(t / 10) * 10 + 10 AS end_time, COUNT(*) AS n, COUNT(*) FILTER (is_keyframe) AS keyframes, COALESCE(AVG(quality) FILTER (quality > 0), 1) AS quality FROM frames GROUP BY ALL"
_SLIDING = "SELECT stream_id, k * 8.0::DOUBLE AS start_time, k * 8.0::DOUBLE + 10 AS end_time, COUNT(*) AS n, COUNT(*) FILTER (is_keyframe) AS keyframes, AVG(quality) AS quality FROM (SELECT *, UNNEST(range(GREATEST(0, CAST(floor((t - 10) / 8) AS BIGINT) + 1), CAST(floor(t / 8) AS BIGINT) + 1)) AS k FROM frames) GROUP BY stream_id, k"


@query("k18_segments_by_strategy", f"""WITH RECURSIVE {_ADAPTIVE}, fixed AS ({_FIXED}), sliding AS ({_SLIDING}), found AS (SELECT 'fixed_duration' AS strategy, * FROM fixed UNION ALL SELECT 'event_driven', * FROM fixed UNION ALL SELECT 'sliding_window', * FROM sliding
  UNION ALL SELECT 'adaptive', stream_id, start_time, end_time, n, keyframes, quality FROM adaptive UNION ALL SELECT 'scene_based', stream_id, start_time, end_time, n, keyframes, quality FROM adaptive)
  SELECT stream_id, strategy, {_SHOWN} FROM found WHERE quality >= 0.3""")
def _(s, d):
    frames = measured(T.frames(s, d))
    found = None
    for strategy in ("fixed_duration", "event_driven", "sliding_window", "adaptive", "scene_based"):
        some = by_strategy(frames, strategy)
        found = some if found is None else found.unionByName(some)
    return rounded(G.good_segments(found), "quality")


def _live(s, d, strategy: str, **options):
    """What a stream over the files of events has given when they are drained, read back from the shared folder."""
    frames = measured(T.as_frames(T.live_events(s, d)))
    out = fresh_path(s, f"live-{strategy}")
    G.drained(G.live(frames, G.machine(strategy, **options), f"{DELAY} seconds"), out, fresh_path(s, f"live-{strategy}-checkpoint"))
    return s.read.schema(G.SEGMENT).parquet(out)


#: Frames of slots that end after the last watermark are still held back.
_PASSED = f"(SELECT floor(MAX(t) * 1000) / 1000 - {DELAY} FROM frames)"


@query("k18_live_segments", f"WITH RECURSIVE {_ADAPTIVE}, shut AS (SELECT w.*, seen FROM walk w JOIN (SELECT stream_id, run, MAX(t) AS seen FROM placed GROUP BY ALL) USING (stream_id, run) WHERE cut OR i = last)"
  f" SELECT stream_id, start AS start_time, CASE WHEN cut THEN pos ELSE pos + 0.5::DOUBLE END AS end_time, CAST(cn AS BIGINT) AS n, CAST(ck AS BIGINT) AS keyframes, ROUND(CASE WHEN cqn > 0 THEN cqs / cqn ELSE 1 END, 6) AS quality, ROUND(CASE WHEN cut THEN complexity ELSE 0.5 END, 6) AS complexity FROM shut WHERE CASE WHEN cut THEN pos + 0.5::DOUBLE <= {_PASSED} ELSE seen + 60 < {_PASSED} END")
def _(s, d):
    found = _live(s, d, "adaptive", rules=RULES)
    return rounded(found.drop("avg_length", "avg_frames"), "quality", "complexity")


@query("s03_live_keyframe_segments", f"""WITH RECURSIVE sec AS (SELECT stream_id, CAST(floor(t) AS BIGINT) AS second, COUNT(*) AS n, MAX(is_keyframe::INT) AS key FROM frames GROUP BY ALL), o AS MATERIALIZED (SELECT *, ROW_NUMBER() OVER (PARTITION BY stream_id ORDER BY second) AS i FROM sec),
  raw AS (SELECT stream_id, i, second, n, key, second AS start, n AS cnt, 0 AS missed FROM o WHERE i = 1 UNION ALL SELECT o.stream_id, o.i, o.second, o.n, o.key, CASE WHEN c THEN w.second + 1 ELSE w.start END, CASE WHEN c THEN o.n ELSE w.cnt + o.n END, CASE WHEN c THEN CASE WHEN f THEN 0 ELSE w.missed + (w.key = 0)::INT END ELSE w.missed END
    FROM raw w CROSS JOIN LATERAL (SELECT w.key = 1 AND w.cnt >= 3 AS f) y CROSS JOIN LATERAL (SELECT y.f OR w.cnt >= 900 OR w.second - w.start >= 30 OR w.missed >= 3 AS c) z JOIN o ON o.stream_id = w.stream_id AND o.i = w.i + 1)
  SELECT stream_id, start::DOUBLE AS start_time, (second + 1)::DOUBLE AS end_time, cnt AS n FROM raw WHERE ((key = 1 AND cnt >= 3) OR cnt >= 900 OR second - start >= 30 OR missed >= 3) AND second + 1 <= {_PASSED}""")
def _(s, d):
    return _live(s, d, "keyframe_based", fewest=3).select("stream_id", "start_time", "end_time", "n")
