"""Queries of fusion by correlation, segments, ranking in turn and the chain of clean-up, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenspan.operators import detection as D
from lumenspan.operators import fusion as U
from lumenspan.operators import ranking as K
from lumenspan.operators import series as S
from lumenspan.plans.prelude import with_tables
from lumenspan.plans.q_temporal import CAND, GRID, SER, WIDE, WINDOWED, candidates, rounded, series
from lumenspan.sources import tables as T
from lumenspan.sources.shared import written

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None):
    """Register a query under ``name`` together with its SQL."""

    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = with_tables(sql)
        return f

    return add


def settled(name):
    """Nine digits; the nudge sends exact halves the same way in both engines, and the product is rounded as SQL does it."""
    return F.round((F.col(name) + 1e-12) * 1e9) / 1e9


def _wide(s, d):
    # Written, as the correlations and the fusion that uses them both read it.
    return written(U.pivoted_window(T.detections(s, d)), "aligned")


# ---- correlations and adapted weights -----------------------------------------------------

_PAIRS = [f"{a}_{b}" for a, b in U.PAIRS]
_LONG = " UNION ALL ".join(f"SELECT stream_id, '{a}_{b}' AS pair, moment AS t, {a}_score AS v, {b}_score AS w FROM wide WHERE {a}_score IS NOT NULL AND {b}_score IS NOT NULL" for a, b in U.PAIRS)
COMBINED = f"""longs AS ({_LONG}), local AS (SELECT stream_id, pair, COUNT(*) OVER x AS n, abs(corr(t, v) OVER x) AS c FROM longs WINDOW x AS (PARTITION BY stream_id, pair ORDER BY t RANGE BETWEEN CURRENT ROW AND 30 FOLLOWING)),
  timed AS (SELECT stream_id, pair, AVG(CASE WHEN c IS NULL OR isnan(c) THEN 0 ELSE c END) AS c FROM local WHERE n >= 3 GROUP BY ALL), linear AS (SELECT stream_id, pair, CASE WHEN COUNT(*) >= 3 AND NOT isnan(corr(v, w)) THEN corr(v, w) END AS r FROM longs GROUP BY ALL),
  combined AS (SELECT stream_id, pair, COALESCE((r + COALESCE(c, 0)) / 2, 0) AS x FROM linear LEFT JOIN timed USING (stream_id, pair)),
  cor AS (SELECT stream_id, {', '.join(f"COALESCE(MAX(x) FILTER (pair = '{p}'), 0) AS {p}" for p in _PAIRS)} FROM combined GROUP BY stream_id)"""
ALIGNED = f"{GRID}, {WINDOWED}, {WIDE}, {COMBINED}"


@query("w19_combined_correlations", f"WITH {ALIGNED} SELECT stream_id, {', '.join(f'ROUND({p}, 6) AS {p}' for p in _PAIRS)} FROM cor")
def _(s, d):
    return rounded(U.combined_correlations(_wide(s, d)), *_PAIRS)


def _moved(m):
    own = [p for p in _PAIRS if m in p.split("_")]
    n = " + ".join(f"({p} > 0.3)::INT" for p in own)
    mean = f"({' + '.join(f'CASE WHEN {p} > 0.3 THEN {p} ELSE 0 END' for p in own)}) / NULLIF({n}, 0)"
    base = {"video": "(0.4::DOUBLE / 0.7)", "audio": "(0.3::DOUBLE / 0.7)", "chat": "0.3::DOUBLE"}[m]
    return f"CASE WHEN {n} > 0 THEN GREATEST(0, LEAST(1, {base} + 0.1::DOUBLE * ({mean} - 0.5::DOUBLE))) ELSE {base} END"


_TOTAL = "(" + " + ".join(_moved(m) for m in U.MODALITIES) + ")"
ADAPTED = f"adapted AS (SELECT stream_id, {', '.join(f'({_moved(m)}) / {_TOTAL} AS w_{m}' for m in U.MODALITIES)} FROM cor)"


@query("g12_adapted_weights", f"WITH {ALIGNED}, {ADAPTED} SELECT stream_id, ROUND(w_video, 6) AS w_video, ROUND(w_audio, 6) AS w_audio, ROUND(w_chat, 6) AS w_chat FROM adapted")
def _(s, d):
    return rounded(U.adapted_weights(U.combined_correlations(_wide(s, d))), "w_video", "w_audio", "w_chat")


_V = lambda m: f"({m}_score IS NOT NULL AND {m}_confidence >= 0.1)"
_PICK = lambda m, e: f"(CASE WHEN {_V(m)} THEN {e} ELSE 0 END)"
_N = "(" + " + ".join(f"{_V(m)}::INT" for m in U.MODALITIES) + ")"
_MEANC = f"(({' + '.join(_PICK(m, f'{m}_confidence') for m in U.MODALITIES)}) / NULLIF({_N}, 0))"
_SURE = f"1 - ({' + '.join(_PICK(m, f'abs({m}_confidence - {_MEANC})') for m in U.MODALITIES)}) / NULLIF({_N}, 0)"
_THERE = "(" + " + ".join(f"({m}_score IS NOT NULL)::INT" for m in U.MODALITIES) + ")"
_DOUBT = f"CASE WHEN ({' + '.join(f'COALESCE({m}_confidence, 0)' for m in U.MODALITIES)}) / {_THERE} < 0.5 THEN 1 - 0.5::DOUBLE * (0.5 - ({' + '.join(f'COALESCE({m}_confidence, 0)' for m in U.MODALITIES)}) / {_THERE}) ELSE 1 END"
_MISSING = lambda ms: "(1 - 0.2::DOUBLE * (" + " + ".join(f"({m}_score IS NULL)::INT" for m in ms) + "))"
_OUT = "SELECT stream_id, ROUND(moment, 6) AS moment, ROUND(LEAST(1, score), 6) AS score, ROUND(confidence, 6) AS confidence FROM fused WHERE score IS NOT NULL"


def _out(df):
    return rounded(df.select("stream_id", "moment", "score", "confidence"), "moment", "score", "confidence")


@query("g09_adaptive_fusion", f"""WITH {ALIGNED}, {ADAPTED}, raw AS (SELECT w.*, CASE WHEN {_PICK('video', 'w_video')} + {_PICK('audio', 'w_audio')} > 0 THEN ({_PICK('video', 'w_video * video_score')} + {_PICK('audio', 'w_audio * audio_score')}) / NULLIF({_PICK('video', 'w_video')} + {_PICK('audio', 'w_audio')}, 0) END AS mean, w_chat FROM wide w JOIN adapted USING (stream_id)),
  fused AS (SELECT stream_id, moment, CASE WHEN {_V('chat')} THEN LEAST(1, mean + chat_score * w_chat) ELSE mean END * {_MISSING(U.CORE)} * {_DOUBT} AS score, {_SURE} AS confidence FROM raw WHERE mean IS NOT NULL) {_OUT}""")
def _(s, d):
    return _out(U.fused(_wide(s, d), "adaptive"))


def _factor(m):
    base = {"video": "(0.4::DOUBLE / 0.7)", "audio": "(0.3::DOUBLE / 0.7)", "chat": "0.3::DOUBLE"}[m]
    others = [(o, p) for p in _PAIRS if m in p.split("_") for o in p.split("_") if o != m]
    n = " + ".join(f"({o}_score IS NOT NULL)::INT" for o, _ in others)
    return f"{base} * (1 + COALESCE(({' + '.join(f'CASE WHEN {o}_score IS NOT NULL THEN GREATEST(0, {p}) ELSE 0 END' for o, p in others)}) / NULLIF({n}, 0), 0))"


_WSUM = " + ".join(_PICK(m, _factor(m)) for m in U.MODALITIES)


@query("g10_correlation_fusion", f"""WITH {ALIGNED}, fused AS (SELECT stream_id, moment, CASE WHEN {_WSUM} > 0 THEN ({' + '.join(_PICK(m, f'{_factor(m)} * {m}_score') for m in U.MODALITIES)}) / NULLIF({_WSUM}, 0) END * {_MISSING(U.MODALITIES)} * {_DOUBT} AS score, {_SURE} AS confidence FROM wide JOIN cor USING (stream_id)) {_OUT}""")
def _(s, d):
    return _out(U.fused(_wide(s, d), "correlation"))


QUERIES["g11_learned_fusion"] = lambda s, d: _out(U.fused(_wide(s, d), "learned"))
SQL["g11_learned_fusion"] = SQL["g09_adaptive_fusion"]


@query("g31_multimodal", f"""WITH {GRID}, {WINDOWED}, {WIDE}, m AS (SELECT stream_id, moment, ({' + '.join(f'COALESCE({w} * {m}_score, 0)' for m, w in U.WEIGHTS.items())}) / ({' + '.join(f'CASE WHEN {m}_score IS NOT NULL THEN {w} ELSE 0 END' for m, w in U.WEIGHTS.items())}) AS score,
  ({' + '.join(f'COALESCE({m}_confidence, 0)' for m in U.MODALITIES)}) / {_THERE} AS confidence FROM wide) SELECT stream_id, ROUND(moment, 6) AS moment, ROUND(score, 6) AS score, ROUND(confidence, 6) AS confidence, ROUND(score, 9) >= 0.6 AND ROUND(confidence, 9) >= 0.5 AS is_highlight FROM m""")
def _(s, d):
    found = U.multimodal(_wide(s, d))
    sure = (F.round("score", 9) >= 0.6) & (F.round("confidence", 9) >= 0.5)
    return rounded(found.select("stream_id", "moment", "score", "confidence", sure.alias("is_highlight")), "moment", "score", "confidence")


# ---- segments of several detectors -----------------------------------------------------------


def _results(s, d):
    return T.detections(s, d).select("stream_id", "modality", "seq", F.col("t").alias("start_time"), (F.col("t") + 8).alias("end_time"), "confidence")


SEGMENTS = """res AS (SELECT stream_id, modality, seq, t AS start_time, t + 8 AS end_time, confidence, confidence * CASE modality WHEN 'video' THEN 0.4::DOUBLE ELSE 0.3::DOUBLE END AS weighted FROM detections),
  reach AS (SELECT *, MAX(end_time) OVER (PARTITION BY stream_id ORDER BY start_time, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM res), numbered AS (SELECT *, SUM(CASE WHEN m IS NULL OR start_time > m THEN 1 ELSE 0 END) OVER (PARTITION BY stream_id ORDER BY start_time, seq) AS island FROM reach),
  segs AS (SELECT stream_id, island, MIN(start_time) AS start_time, MAX(end_time) AS end_time, SUM(weighted) AS weighted, COUNT(*) AS n, arg_max(seq, {'a': start_time, 'b': seq}) FILTER (modality = 'video') AS video, arg_max(seq, {'a': start_time, 'b': seq}) FILTER (modality = 'audio') AS audio, arg_max(seq, {'a': start_time, 'b': seq}) FILTER (modality = 'chat') AS chat FROM numbered GROUP BY stream_id, island)"""


@query("u01_fused_segments", f"WITH {SEGMENTS} SELECT stream_id, ROUND(start_time, 9) AS start_time, ROUND(end_time, 9) AS end_time, ROUND(weighted, 6) AS weighted, n, video, audio, chat FROM segs")
def _(s, d):
    return rounded(rounded(U.fused_segments(_results(s, d)).drop("island"), "start_time", "end_time", digits=9), "weighted")


_TYPED = f"""{SEGMENTS}, typed AS (SELECT stream_id, start_time, LEAST(end_time, start_time + 120) AS end_time, LEAST(weighted, 1) AS confidence, CASE WHEN video % 3 = 0 THEN 'gameplay' WHEN video % 3 = 1 THEN 'reaction' WHEN audio % 5 = 0 THEN 'funny' WHEN audio % 5 = 1 THEN 'emotional' WHEN chat % 2 = 0 THEN 'climactic' ELSE 'custom' END AS highlight_type,
  COALESCE(NULLIF(concat_ws(' ', 'video ' || video, 'audio ' || audio, 'chat ' || chat), ''), 'Automatically detected highlight') AS description FROM segs WHERE end_time - start_time >= 5 AND weighted >= 0.7)"""


@query("k30_segment_highlights", f"WITH {_TYPED} SELECT stream_id, ROUND(start_time, 9) AS start_time, ROUND(end_time, 9) AS end_time, ROUND(confidence, 6) AS confidence, highlight_type, CASE highlight_type {' '.join(f"WHEN '{k}' THEN '{t}'" for k, t in U.TITLES.items())} END AS title, description FROM typed")
def _(s, d):
    kept = U.segment_highlights(
        U.fused_segments(_results(s, d)),
        F.when(F.col("video") % 3 == 0, "gameplay").when(F.col("video") % 3 == 1, "reaction"),
        F.when(F.col("audio") % 5 == 0, "funny").when(F.col("audio") % 5 == 1, "emotional"),
        F.when(F.col("chat") % 2 == 0, "excitement"),
    )
    return rounded(kept.select("stream_id", "start_time", "end_time", "confidence", "highlight_type", "title", "description").withColumns({c: F.round(c, 9) for c in ("start_time", "end_time")}), "confidence")


@query("u03_merged_pairs", """WITH h AS (SELECT *, LEAD(id) OVER w AS id2, LEAD(end_time) OVER w AS e2, LEAD(confidence_score) OVER w AS c2, LEAD(tags) OVER w AS t2, LEAD(description) OVER w AS d2, LEAD(sentiment_score) OVER w AS s2, LEAD(viewer_engagement) OVER w AS v2 FROM highlights WINDOW w AS (PARTITION BY stream_id ORDER BY start_time, id))
  SELECT id, ROUND(start_time, 9) AS start_time, ROUND(e2, 9) AS end_time, GREATEST(confidence_score, c2) AS confidence_score, array_to_string(list_sort(list_distinct(list_concat(tags, t2)))[1:10], ',') AS tags, trim(description || ' ' || d2) AS description, ROUND((sentiment_score + s2) / 2, 6) + 0::DOUBLE AS sentiment_score, ROUND((viewer_engagement + v2) / 2, 6) AS viewer_engagement FROM h WHERE id2 IS NOT NULL""")
def _(s, d):
    found = U.merged_neighbours(T.highlights(s, d)).withColumn("tags", F.array_join("tags", ","))
    found = found.select("id", F.round("start_time", 9).alias("start_time"), F.round("end_time", 9).alias("end_time"), "confidence_score", "tags", "description", "sentiment_score", "viewer_engagement")
    # Adding nothing makes a negative zero a plain one.
    return rounded(found, "sentiment_score", "viewer_engagement").withColumn("sentiment_score", F.col("sentiment_score") + F.lit(0.0))


# ---- detectors over feature columns --------------------------------------------------------


def _features(s, d):
    return T.read(s, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") / 50).alias("a"), (F.col("l_discount") * 10).alias("b"), (F.col("l_tax") * 12).alias("c"), F.least(F.col("l_extendedprice") / 100_000, F.lit(1.0)).alias("e"))


_FEAT = "f AS (SELECT l_orderkey, l_linenumber, l_quantity / 50 AS a, l_discount * 10 AS b, l_tax * 12 AS c, LEAST(l_extendedprice / 100000, 1.0::DOUBLE) AS e FROM lineitem)"


def _detector_sql(weights):
    total, names = sum(weights.values()), list(weights)
    score = " + ".join(f"{w / total}::DOUBLE * {n}" for n, w in weights.items())
    mean = f"(({' + '.join(names)}) / {len(names)})"
    return f"WITH {_FEAT}, g AS (SELECT l_orderkey, l_linenumber, LEAST(1, {score}) AS score, 1 - ({' + '.join(f'abs({n} - {mean})' for n in names)}) / {len(names)} AS confidence FROM f) SELECT l_orderkey, l_linenumber, ROUND(score, 11) AS score, ROUND(confidence, 11) AS confidence FROM g WHERE ROUND(score, 9) >= 0.5 AND ROUND(confidence, 9) >= 0.7"


def _detector(s, d, weights):
    found = D.detected(_features(s, d), weights, None, 0.0, 0.0).where((F.round("score", 9) >= 0.5) & (F.round("confidence", 9) >= 0.7))
    return rounded(found.select("l_orderkey", "l_linenumber", "score", "confidence"), "score", "confidence", digits=11)


_AUDIO = dict(zip("abce", D.AUDIO_WEIGHTS.values(), strict=True))
_VIDEO = dict(zip("abc", D.VIDEO_WEIGHTS.values(), strict=True))


@query("g28_audio_detector", _detector_sql(_AUDIO))
def _(s, d):
    return _detector(s, d, _AUDIO)


@query("g29_video_detector", _detector_sql(_VIDEO))
def _(s, d):
    return _detector(s, d, _VIDEO)


@query("h22_content_scores", f"""WITH {_FEAT} SELECT l_orderkey, l_linenumber, ROUND(LEAST(1, CASE WHEN a > 0.5 THEN 0.3 ELSE 0 END + 0.3 * b + 0.2 * c + CASE WHEN e > 0.5 THEN 0.2 ELSE 0 END), 6) AS video, ROUND(LEAST(1, 0.2 * a + 0.3 * b + CASE WHEN c > 0.5 THEN 0.2 ELSE 0 END + CASE WHEN e > 0.5 THEN 0.3 ELSE 0 END), 6) AS audio,
  ROUND(LEAST(1, 0.2 * (a * 2 - 1) + 0.3 * b + CASE WHEN l_linenumber * 20 > 50 THEN 0.3 ELSE 0 END + LEAST(l_linenumber * 20 / 100, 0.2)), 6) AS chat FROM f""")
def _(s, d):
    a, b, c, e, n = F.col("a"), F.col("b"), F.col("c"), F.col("e"), F.col("l_linenumber") * 20
    found = _features(s, d).select("l_orderkey", "l_linenumber", D.video_content(a > 0.5, b, c, e > 0.5).alias("video"), D.audio_content(a, b, c > 0.5, e > 0.5).alias("audio"), D.chat_content_score(a * 2 - 1, b, n).alias("chat"))
    return rounded(found, "video", "audio", "chat")


@query("g30_enhanced_chat", f"WITH {_FEAT} SELECT l_orderkey, l_linenumber, ROUND((0.5 * a + 0.3 * b + 0.2 * c) * e, 9) AS score FROM f")
def _(s, d):
    return _features(s, d).select("l_orderkey", "l_linenumber", F.round(D.enhanced_score(F.col("a"), F.col("b"), F.col("c"), F.col("e")), 9).alias("score"))


# ---- ranking and selection in turn -----------------------------------------------------------

RANKED = f"{CAND}, r AS (SELECT *, score * confidence AS sc, (start_time + end_time) / 2 AS mid, ROW_NUMBER() OVER (PARTITION BY stream_id ORDER BY ROUND(score * confidence, 9) DESC, id) AS nth FROM cand)"
_DIST = "list_avg(list_transform(w.mids, lambda m: (LEAST(1, abs(m - r.mid) / 30) + 0.5::DOUBLE) / 2))"


@query("l09_diverse_choice", f"""WITH RECURSIVE {RANKED}, walk AS (SELECT stream_id, 1 AS place, id, [mid] AS mids, [id] AS ids FROM r WHERE nth = 1
  UNION ALL SELECT r.stream_id, w.place + 1, r.id, list_append(w.mids, r.mid), list_append(w.ids, r.id) FROM walk w JOIN r ON r.stream_id = w.stream_id WHERE w.place < 10 AND NOT list_contains(w.ids, r.id)
    QUALIFY ROW_NUMBER() OVER (PARTITION BY r.stream_id ORDER BY ROUND(0.8::DOUBLE * r.sc + 0.2::DOUBLE * {_DIST}, 9) DESC, r.nth) = 1)
  SELECT stream_id, id, place FROM walk""")
def _(s, d):
    return K.rank_candidates(candidates(s, d), "diversity").select("stream_id", "id", F.col("nth").alias("place"))


_SET = f"""setwalk AS (SELECT stream_id, 1 AS place, id, [mid] AS mids, [id] AS ids FROM r WHERE nth = 1
  UNION ALL SELECT r.stream_id, w.place + 1, r.id, list_append(w.mids, r.mid), list_append(w.ids, r.id) FROM setwalk w JOIN r ON r.stream_id = w.stream_id WHERE w.place < 10 AND NOT list_contains(w.ids, r.id)
    QUALIFY ROW_NUMBER() OVER (PARTITION BY r.stream_id ORDER BY ROUND({_DIST}, 9) DESC, r.nth) = 1 AND ROUND({_DIST}, 9) > 0.1)"""


@query("l13_diverse_set", f"WITH RECURSIVE {RANKED}, {_SET} SELECT stream_id, id FROM setwalk")
def _(s, d):
    return K.select_highlights(K.rank_candidates(candidates(s, d)), "diverse")


@query("l15_quality_balanced", f"""WITH RECURSIVE {RANKED}, {_SET}, have AS (SELECT stream_id, MAX(place) AS n FROM setwalk GROUP BY 1), extra AS (SELECT r.stream_id, r.id FROM r JOIN have h USING (stream_id) WHERE r.id NOT IN (SELECT id FROM setwalk) QUALIFY h.n + ROW_NUMBER() OVER (PARTITION BY r.stream_id ORDER BY r.nth) <= 10)
  SELECT stream_id, id FROM setwalk UNION ALL SELECT stream_id, id FROM extra""")
def _(s, d):
    return K.select_highlights(K.rank_candidates(candidates(s, d)), "balanced")


_RANKS = {"l16_distribution_ranking": ("distribution", "ROUND(score * confidence, 9)"), "l17_preference_ranking": ("preference", "ROUND(0.4::DOUBLE * score + 0.3::DOUBLE * confidence + 0.1::DOUBLE * GREATEST(0, 1 - abs(end_time - start_time - 40) / 40) + 0.05::DOUBLE, 9)")}
for _name, (_method, _expr) in _RANKS.items():

    @query(_name, f"WITH {CAND} SELECT id, CAST(ROW_NUMBER() OVER (PARTITION BY stream_id ORDER BY {_expr} DESC, id) AS INTEGER) AS nth FROM cand")
    def _(s, d, method=_method):
        return K.rank_candidates(candidates(s, d), method).select("id", "nth")


@query("l04_criteria_ranking", f"""WITH {CAND}, v AS (SELECT *, (end_time - start_time) / 100 AS len, sqrt(score * score + confidence * confidence + pow((end_time - start_time) / 100, 2)) AS norm FROM cand),
  u AS (SELECT *, score / norm AS u1, confidence / norm AS u2, len / norm AS u3 FROM v), p AS (SELECT a.id, AVG(1 - (a.u1 * b.u1 + a.u2 * b.u2 + a.u3 * b.u3)) AS dist FROM u a JOIN u b ON a.stream_id = b.stream_id AND a.id <> b.id GROUP BY a.id)
  SELECT id, ROUND(0.4::DOUBLE * score + 0.3::DOUBLE * confidence + 0.2::DOUBLE * GREATEST(0, 1 - abs(end_time - start_time - 45) / 45) + 0.1::DOUBLE * COALESCE(dist, 0.5), 6) AS rank_score FROM u LEFT JOIN p USING (id)""")
def _(s, d):
    rows = candidates(s, d).withColumn("len", (F.col("end_time") - F.col("start_time")) / 100)
    return rounded(K.criteria_scores(rows, ["score", "confidence", "len"]).select("id", "rank_score"), "rank_score")


@query("d20_selection_metrics", f"""WITH {RANKED}, sel AS (SELECT * FROM r WHERE nth <= 10), own AS (SELECT stream_id, COUNT(*) AS n, AVG(score) AS m, var_pop(score) AS v, CASE WHEN COUNT(*) > 1 THEN MAX(mid) - MIN(mid) ELSE 0 END AS span, COUNT(*) FILTER (confidence < 0.5) AS low, COUNT(*) FILTER (confidence >= 0.5 AND confidence < 0.8) AS medium, COUNT(*) FILTER (confidence >= 0.8) AS high FROM sel GROUP BY stream_id),
  whole AS (SELECT stream_id, COUNT(*) AS candidates, CASE WHEN COUNT(*) > 1 THEN MAX(mid) - MIN(mid) ELSE 1 END AS span FROM r GROUP BY stream_id),
  pairs AS (SELECT a.stream_id, AVG(LEAST(1, abs(a.mid - b.mid) / 30)) AS d, AVG(GREATEST(0, LEAST(a.end_time, b.end_time) - GREATEST(a.start_time, b.start_time)) / (GREATEST(a.end_time, b.end_time) - LEAST(a.start_time, b.start_time))) AS o FROM sel a JOIN sel b ON a.stream_id = b.stream_id AND a.id < b.id GROUP BY a.stream_id),
  x AS (SELECT *, LEAST(1, own.span / GREATEST(1, whole.span)) AS coverage, COALESCE(d, 1) AS dd, COALESCE(o, 0) AS oo FROM own JOIN whole USING (stream_id) LEFT JOIN pairs USING (stream_id))
  SELECT stream_id, n, candidates, ROUND(m, 6) AS mean_score, ROUND(coverage, 6) AS coverage, ROUND(dd, 6) AS diversity, ROUND(oo, 6) AS overlap, low, medium, high, ROUND((m + 1 - LEAST(1, v) + coverage + dd + 1 - oo) / 5, 6) AS quality FROM x""")
def _(s, d):
    rows = candidates(s, d)
    found = K.selection_metrics(K.first_n(K.ranked(rows), 10), rows)
    return rounded(found.select("stream_id", "n", "candidates", "mean_score", "coverage", "diversity", "overlap", "low", "medium", "high", "quality"), "mean_score", "coverage", "diversity", "overlap", "quality")


# ---- clean-up ----------------------------------------------------------------------------------


def _golay_sql():
    m = S._smoothing_matrix(11)
    rows = "[" + ", ".join("[" + ", ".join(f"{float(w)!r}::DOUBLE" for w in r) + "]" for r in m) + "]"
    dot = lambda row, values: f"list_sum(list_transform(range(1, 12), lambda k: {row}[k] * {values}[k]))"
    return f"""WITH {SER}, n AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY series ORDER BY t, id) AS i, COUNT(*) OVER (PARTITION BY series) AS n FROM ser), l AS (SELECT series, list(v ORDER BY i) AS vs FROM n GROUP BY series)
  SELECT id, ROUND(0.7::DOUBLE * v + 0.3::DOUBLE * CASE WHEN n < 11 THEN v WHEN i <= 5 THEN {dot(f'{rows}[i]', 'vs[1:11]')} WHEN i > n - 5 THEN {dot(f'{rows}[i - n + 11]', 'vs[n - 10:n]')} ELSE {dot(f'{rows}[6]', 'vs[i - 5:i + 5]')} END, 6) AS smooth FROM n JOIN l USING (series)"""


@query("w04_savitzky_golay", _golay_sql())
def _(s, d):
    return rounded(S.savitzky_golay(series(s, d)).select("id", "smooth"), "smooth")


SMOOTH = f"""{CAND}, mids AS (SELECT *, (start_time + end_time) / 2 AS t, COUNT(*) OVER (PARTITION BY stream_id) AS n FROM cand),
  smooth AS (SELECT id, stream_id, start_time, end_time, score AS old_score, confidence AS old_confidence, CASE WHEN n < 3 THEN score ELSE GREATEST(0, LEAST(1, 0.7::DOUBLE * score + 0.3::DOUBLE * AVG(score) OVER w)) END AS score, CASE WHEN n < 3 THEN confidence ELSE GREATEST(0, LEAST(1, 0.7::DOUBLE * confidence + 0.3::DOUBLE * AVG(confidence) OVER w)) END AS confidence
    FROM mids WINDOW w AS (PARTITION BY stream_id ORDER BY t RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING))"""


@query("w07_smoothed_candidates", f"WITH {SMOOTH} SELECT id, ROUND(score, 9) AS score, ROUND(confidence, 9) AS confidence FROM smooth")
def _(s, d):
    return rounded(U.smoothed_candidates(candidates(s, d)).select("id", "score", "confidence"), "score", "confidence", digits=9)


# Stand-ins for the modalities' scores, the scene's stability and the spikes in volume of a candidate.
_STAB, _SPIKES = "((id % 10) / 10)", "(id % 6)"
_SC = "[score, confidence, 0.5::DOUBLE]"


def _stability():
    return (F.col("id") % 10) / 10


def _spikes():
    return F.col("id") % 6


def _scores():
    return F.array(F.col("score"), F.col("confidence"), F.lit(0.5))


@query("g18_border_moves", f"WITH {CAND} SELECT id, " + ", ".join(f"ROUND(start_time - ({e}), 9) AS {n}_start, ROUND(end_time + ({e}), 9) AS {n}_end" for n, e in {"scene": f"CASE WHEN {_STAB} < 0.5 THEN 2 ELSE -0.5 END", "audio": f"CASE WHEN {_SPIKES} > 3 THEN 1.5 WHEN {_SPIKES} = 0 THEN -0.5 ELSE 0 END", "content": f"(CASE WHEN {_STAB} < 0.5 THEN 2 ELSE -0.5 END + CASE WHEN {_SPIKES} > 3 THEN 1.5 WHEN {_SPIKES} = 0 THEN -0.5 ELSE 0 END) / 2"}.items()) + " FROM cand")
def _(s, d):
    moves = {"scene": U.scene_moves(_stability()), "audio": U.audio_moves(_spikes()), "content": U.content_moves(_stability(), _spikes())}
    columns = [F.round(F.col(f"{side}_time") + by, 9).alias(f"{n}_{side}") for n, pair in moves.items() for side, by in zip(("start", "end"), pair, strict=True)]
    return candidates(s, d).select("id", *columns)


_BOOST = "LEAST(1, confidence * (1 + (1 - LEAST(1, list_var_pop({a}))) * 0.1::DOUBLE))".format(a=_SC)


@query("g21_boosted_confidence", f"WITH {CAND} SELECT id, ROUND({_BOOST}, 6) AS confidence FROM cand")
def _(s, d):
    return candidates(s, d).select("id", F.round(U.boosted_confidence(F.col("confidence"), _scores()), 6).alias("confidence"))


def _adaptive_sql(source):
    return f"""ctx_rows AS (SELECT *, (start_time + end_time) / 2 AS mid, {_BOOST} AS boosted FROM {source}), ctx AS (SELECT a.id, SUM(b.score / (1 + abs(a.mid - b.mid) / 10)) / SUM(1 / (1 + abs(a.mid - b.mid) / 10)) AS context, var_pop(b.score) AS spread, COUNT(*) AS k FROM ctx_rows a JOIN ctx_rows b ON a.stream_id = b.stream_id AND abs(a.mid - b.mid) <= 60 AND a.id <> b.id GROUP BY a.id),
  both_ AS (SELECT r.*, COALESCE(0.85::DOUBLE * score + 0.15::DOUBLE * context, score) AS refined, confidence * CASE WHEN k IS NULL THEN 1 WHEN k = 1 THEN 1.1::DOUBLE ELSE 1 + 0.1::DOUBLE * (1 - LEAST(1, spread)) END AS contextual FROM ctx_rows r LEFT JOIN ctx USING (id)),
  adapted AS (SELECT *, GREATEST(0, LEAST(1, LEAST(score + 0.2, CASE WHEN score > 0.7 THEN 0.8::DOUBLE * score + 0.2::DOUBLE * refined ELSE 0.5 * score + 0.5 * refined END))) AS new_score, GREATEST(0, LEAST(1, CASE WHEN score > 0.7 THEN 0.7::DOUBLE * boosted + 0.3::DOUBLE * contextual ELSE 0.3::DOUBLE * boosted + 0.7::DOUBLE * contextual END)) AS new_confidence FROM both_)"""


@query("g22_adaptive_scores", f"WITH {CAND}, {_adaptive_sql('cand')} SELECT id, ROUND(new_score + 1e-12, 9) AS score, ROUND(new_confidence + 1e-12, 9) AS confidence FROM adapted")
def _(s, d):
    found = U.adaptive_scores(candidates(s, d), _scores())
    return found.select("id", settled("new_score").alias("score"), settled("new_confidence").alias("confidence"))


_MOVE = f"((CASE WHEN {_STAB} < 0.5 THEN 2 ELSE -0.5 END + CASE WHEN {_SPIKES} > 3 THEN 1.5 WHEN {_SPIKES} = 0 THEN -0.5 ELSE 0 END) / 2)"
CHAIN = f"""{SMOOTH}, moved AS (SELECT *, GREATEST(0, start_time - {_MOVE}) AS a, end_time + {_MOVE} AS b FROM smooth),
  placed AS (SELECT id, stream_id, start_time AS old_start, end_time AS old_end, old_score, old_confidence, score, confidence, CASE WHEN b - a < 10 OR b - a > 120 THEN GREATEST(0, (a + b) / 2 - GREATEST(10, LEAST(120, b - a)) / 2) ELSE a END AS start_time, CASE WHEN b - a < 10 OR b - a > 120 THEN (a + b) / 2 + GREATEST(10, LEAST(120, b - a)) / 2 ELSE b END AS end_time FROM moved),
  {_adaptive_sql('placed')}, z AS (SELECT *, COUNT(*) OVER w AS n, abs(new_score - AVG(new_score) OVER w) / GREATEST(0.1, stddev_pop(new_score) OVER w) AS z FROM adapted WHERE new_score >= 0.1 WINDOW w AS (PARTITION BY stream_id)),
  done AS (SELECT * FROM z QUALIFY (n <= 3 OR z <= 2) OR NOT bool_or(n <= 3 OR z <= 2) OVER (PARTITION BY stream_id))"""


@query("g24_post_processed", f"WITH {CHAIN} SELECT id, ROUND(start_time, 9) AS start_time, ROUND(end_time, 9) AS end_time, ROUND(new_score + 1e-12, 9) AS score, ROUND(new_confidence + 1e-12, 9) AS confidence FROM done")
def _(s, d):
    found = U.post_processed(candidates(s, d), _scores(), _stability(), _spikes())
    return found.select("id", F.round("start_time", 9).alias("start_time"), F.round("end_time", 9).alias("end_time"), settled("score").alias("score"), settled("confidence").alias("confidence"))


@query("k09_processing_metrics", f"WITH {CHAIN} SELECT stream_id, COUNT(*) AS n, COUNT(*) FILTER (new_score > old_score) AS improved, ROUND(AVG(GREATEST(0, new_score - old_score)), 6) AS score_gain, ROUND(AVG(GREATEST(0, new_confidence - old_confidence)), 6) AS confidence_gain, COUNT(*) FILTER (abs(start_time - old_start) > 0.1 OR abs(end_time - old_end) > 0.1) AS moved FROM done GROUP BY stream_id")
def _(s, d):
    found = U.processing_metrics(U.post_processed(candidates(s, d), _scores(), _stability(), _spikes()))
    return rounded(found, "score_gain", "confidence_gain")
