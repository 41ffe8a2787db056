"""Queries of speech and sound scores, sets of results, topics, intake and dispatch, with their SQL."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from lumenspan.functions import scalar as C
from lumenspan.functions import text as X
from lumenspan.operators import content as N
from lumenspan.operators import fusion as U
from lumenspan.operators import ranking as K
from lumenspan.operators import series as S
from lumenspan.plans.prelude import with_tables
from lumenspan.plans.q_chat import TOK
from lumenspan.plans.q_temporal import CAND, CLUSTERS, GRID, NEIGHBOURS, SER, WINDOWED, candidates, rounded, series
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


# ---- speech and sound --------------------------------------------------------------------

_QUOTE = lambda w: w.replace("'", "''")
#: Words end where letters and digits of any script do; marks around a copy of the text with doubled gaps tell them apart.
_EDGED = r"(' ' || regexp_replace(lower(message), '([^\p{L}\p{N}_])', ' \1 ', 'g') || ' ')"
_FOUND = " + ".join(f"len(regexp_extract_all({_EDGED}, '[^\\p{{L}}\\p{{N}}_]{_QUOTE(re.sub(chr(32) + '|' + chr(39), lambda m: ' ' + m[0] + ' ', w))}[^\\p{{L}}\\p{{N}}_]'))" for w in N.SPOKEN)


@query("h29_speech_keywords", f"SELECT event_id, CAST({_FOUND} AS INTEGER) AS n, ROUND(1 / (1 + exp(-(10 * ({_FOUND}) / GREATEST(1, len({TOK}))))), 6) AS score FROM chat_messages")
def _(s, d):
    text = F.col("message")
    sent, texts = T.chat_parts(s, d)
    found = texts.select("message_id", N.spoken_words(text).alias("n"), F.size(X.tokens(text)).alias("w"))
    scored = found.select("message_id", F.col("n").cast("int").alias("n"), F.round(N.keyword_score(F.col("n"), F.col("w")), 6).alias("score"))
    return sent.select("event_id", "message_id").join(scored, "message_id").select("event_id", "n", "score")


@query("h30_speech_speed", "SELECT stream_id, id, ROUND(CASE WHEN w / GREATEST(0.1, len / 60) / 160 > 0.6 THEN 1 / (1 + exp(-(w / GREATEST(0.1, len / 60) / 160 - 0.6))) ELSE 0 END, 6) AS score FROM (SELECT stream_id, id, end_time - start_time AS len, id % 300 AS w FROM highlights)")
def _(s, d):
    rows = T.highlights(s, d)
    return rows.select("stream_id", "id", F.round(N.speech_score(F.col("id") % 300, F.col("end_time") - F.col("start_time")), 6).alias("score"))


_RMS = "list_transform(range(0, 48, 8), lambda i: sqrt(list_sum(list_transform(range(1, 17), lambda j: x[i + j] * x[i + j])) / 16))"
_EN = f"en AS (SELECT vec_id, x, {_RMS} AS e FROM (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings))"


def _energy(s, d):
    samples = F.col("embedding").cast("array<double>")
    return T.read(s, d, "embeddings").select("vec_id", samples.alias("x"), N.rms_energy(samples, 16, 8).alias("e"))


@query("h26_rms_energy", f"WITH {_EN} SELECT vec_id, CAST(len(e) AS INTEGER) AS frames, ROUND(e[1], 6) AS first, ROUND(list_max(e), 6) AS most FROM en")
def _(s, d):
    return _energy(s, d).select("vec_id", F.size("e").alias("frames"), F.round(F.get("e", F.lit(0)), 6).alias("first"), F.round(F.array_max("e"), 6).alias("most"))


@query("h27_crossing_rate", f"WITH {_EN} SELECT vec_id, ROUND(list_sum(list_transform(range(1, 64), lambda i: ((x[i] >= 0) <> (x[i + 1] >= 0))::INT)) / 64, 6) AS rate FROM en")
def _(s, d):
    return _energy(s, d).select("vec_id", F.round(N.crossing_rate(F.col("x")), 6).alias("rate"))


@query("h28_volume_spikes", f"""WITH {_EN}, m AS (SELECT vec_id, e, list_avg(e) AS mu, list_stddev_pop(e) AS sd FROM en), h AS (SELECT *, list_filter(e, lambda v: v > mu + 1.2 * sd) AS high FROM m)
  SELECT vec_id, CAST(len(high) AS INTEGER) AS spikes, ROUND(CASE WHEN len(high) > 0 THEN list_avg(high) / (mu + 1e-10) ELSE 1 END, 6) AS intensity, ROUND(GREATEST(0, 1 - LEAST(1, sd / (mu + 1e-10))), 6) AS consistency, ROUND(1 / (1 + exp(-LEAST(1, len(high) / len(e) * CASE WHEN len(high) > 0 THEN list_avg(high) / (mu + 1e-10) ELSE 1 END))), 6) AS score FROM h""")
def _(s, d):
    found = _energy(s, d).select("vec_id", N.volume_spikes(F.col("e"), 1.2).alias("x")).select("vec_id", "x.*")
    return rounded(found, "intensity", "consistency", "score")


# ---- sets of results ---------------------------------------------------------------------


@query("d21_quality_scores", f"WITH {CAND} SELECT stream_id, COUNT(*) AS n, ROUND(0.4 * AVG(score) + 0.3 * AVG(confidence) + 0.2 * CASE WHEN COUNT(*) > 1 THEN 1 / (1 + var_pop(score)) ELSE 1 END + 0.05, 6) AS quality FROM cand GROUP BY stream_id")
def _(s, d):
    return rounded(N.quality_scores(candidates(s, d), "stream_id"), "quality")


def _bins(f):
    return f"SELECT LEAST(9, floor(({f} - lo) / ((hi - lo) / 10))) AS b, COUNT(*) AS n FROM cand CROSS JOIN (SELECT MIN({f}) AS lo, MAX({f}) AS hi FROM cand) GROUP BY 1"


@query("d22_diversity", f"""WITH {CAND}, e1 AS (SELECT -SUM(p * ln(p + 1e-10)) AS e FROM (SELECT n / SUM(n) OVER () AS p FROM ({_bins('score')}))), e2 AS (SELECT -SUM(p * ln(p + 1e-10)) AS e FROM (SELECT n / SUM(n) OVER () AS p FROM ({_bins('confidence')})))
  SELECT 'entropy' AS method, ROUND((e1.e + e2.e) / 2 / ln(10), 6) AS diversity FROM e1 CROSS JOIN e2 UNION ALL SELECT 'determinant', ROUND(GREATEST(0, LEAST(1, var_samp(score) * var_samp(confidence) - pow(covar_samp(score, confidence), 2))), 6) FROM cand""")
def _(s, d):
    rows = candidates(s, d)
    both = N.entropy_diversity(rows, ["score", "confidence"]).withColumn("method", F.lit("entropy"))
    both = both.unionByName(N.determinant_diversity(rows, "score", "confidence").withColumn("method", F.lit("determinant")))
    return rounded(both, "diversity")


@query("d37_timers", "SELECT event_type, COUNT(*) AS n, ROUND(SUM(value), 4) AS total, MIN(value) AS least, MAX(value) AS most, ROUND(AVG(value), 6) AS mean FROM events WHERE event_type <> 'error' GROUP BY event_type")
def _(s, d):
    rows = T.read(s, d, "events").where("event_type <> 'error'")
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.min("value").alias("least"), F.max("value").alias("most"), F.round(F.avg("value"), 6).alias("mean"))


@query("d48_cluster_similarity", f"""WITH RECURSIVE {CAND}, {CLUSTERS}, c AS (SELECT w.stream_id, w.cluster, w.id, k.start_time, k.end_time FROM walk w JOIN cand k USING (id)), p AS (SELECT a.stream_id, a.cluster, AVG((GREATEST(0, LEAST(a.end_time, b.end_time) - GREATEST(a.start_time, b.start_time)) / (GREATEST(a.end_time, b.end_time) - LEAST(a.start_time, b.start_time)) + 0.5) / 2) AS sim FROM c a JOIN c b ON a.stream_id = b.stream_id AND a.cluster = b.cluster AND a.id < b.id GROUP BY ALL)
  SELECT stream_id, cluster, COUNT(*) AS n, ROUND(COALESCE(MAX(sim), 1), 6) AS similarity FROM c LEFT JOIN p USING (stream_id, cluster) GROUP BY stream_id, cluster""")
def _(s, d):
    return rounded(N.cluster_similarity(K.temporal_clusters(candidates(s, d))), "similarity")


@query("u08_merged_clusters", f"""WITH RECURSIVE {CAND}, {CLUSTERS} SELECT w.stream_id, MIN(w.cluster) AS cluster, COUNT(*) AS n, ROUND(MIN(k.start_time), 9) AS start_time, ROUND(MAX(k.end_time), 9) AS end_time FROM walk w JOIN cand k USING (id) GROUP BY w.stream_id, w.cluster // 2""")
def _(s, d):
    found = N.merged_clusters(K.temporal_clusters(candidates(s, d)), F.floor(F.col("cluster") / 2))
    return rounded(found, "start_time", "end_time", digits=9)


_CATS = "['action', 'emotional', 'informative', 'humorous', 'dramatic', 'other'][id % 6 + 1]"


@query("g25_category_results", f"""WITH {CAND}, x AS (SELECT id, confidence, score * CASE {_CATS} WHEN 'action' THEN 1.2::DOUBLE WHEN 'emotional' THEN 1.1 WHEN 'informative' THEN 1 WHEN 'humorous' THEN 1.1 WHEN 'dramatic' THEN 1.2 ELSE 0.9 END AS plain, (id % 10) / 10 AS q FROM cand), y AS (SELECT *, ROUND(CASE WHEN q > 0.7 THEN LEAST(1, plain + (q - 0.7) * 0.2) ELSE plain END, 9) AS adjusted FROM x)
  SELECT id, adjusted FROM y WHERE adjusted >= 0.5 AND confidence >= 0.6""")
def _(s, d):
    rows = candidates(s, d).withColumn("category", T.pick(F.col("id") % 6, "action", "Emotional", "informative", "humorous", "dramatic", "other"))
    return N.category_results(rows, (F.col("id") % 10) / 10).select("id", "adjusted")


@query("k02_modality_quality", f"WITH {GRID}, {WINDOWED}, {NEIGHBOURS}, both_ AS (SELECT stream_id, moment, modality, score, confidence, FALSE AS blended FROM aligned UNION ALL SELECT b.*, TRUE FROM blended b ANTI JOIN aligned a USING (stream_id, moment, modality)) SELECT stream_id, ROUND(moment, 6) AS moment, modality, ROUND((score + confidence + CASE WHEN blended THEN 0.5 ELSE 1 END + CASE WHEN blended THEN 0.8 ELSE 1 END) / 4, 6) AS quality FROM both_")
def _(s, d):
    rows = U.align_interpolated(T.detections(s, d))
    quality = N.modality_quality(F.col("score"), F.col("confidence"), ~F.col("blended"), F.col("blended"))
    return rounded(rows.select("stream_id", "moment", "modality", quality.alias("quality")), "moment", "quality")


# ---- boundaries and times ------------------------------------------------------------------


@query("s09_boundaries", f"""WITH {SER} SELECT id, COUNT(*) OVER w3 >= 3 AND (MAX(v) OVER w3 > 0.8 OR (COUNT(*) OVER w5 >= 5 AND MAX(v) OVER w5 < 0.3)) AS boundary FROM ser WINDOW w3 AS (PARTITION BY series ORDER BY t, id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), w5 AS (PARTITION BY series ORDER BY t, id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""")
def _(s, d):
    return S.boundaries(series(s, d)).select("id", "boundary")


@query("w12_interpolated_places", f"""WITH {SER}, n AS (SELECT series, t, ROW_NUMBER() OVER (PARTITION BY series ORDER BY t, id) - 1 AS i, LEAD(t) OVER (PARTITION BY series ORDER BY t, id) AS t2 FROM ser)
  SELECT series, ROUND(i + (1000 - t) / (t2 - t), 6) AS place FROM n WHERE t <= 1000 AND t2 > 1000""")
def _(s, d):
    return rounded(S.place_at(series(s, d), 1000.0), "place")


# ---- highlights as they come -----------------------------------------------------------------


@query("h31_similar_candidates", """SELECT id, ROUND(0.6 * GREATEST(0, 1 - abs(start_time - s2) / 120) + 0.4 * (highlight_type = t2)::INT, 6) AS similarity FROM (SELECT id, start_time, highlight_type, LEAD(start_time) OVER w AS s2, LEAD(highlight_type) OVER w AS t2 FROM highlights WINDOW w AS (PARTITION BY stream_id ORDER BY start_time, id)) WHERE s2 IS NOT NULL""")
def _(s, d):
    from pyspark.sql.window import Window

    order = Window.partitionBy("stream_id").orderBy("start_time", "id")
    pairs = T.highlights(s, d).select("id", "start_time", "title", F.lead("start_time").over(order).alias("s2"), F.lead("title").over(order).alias("t2")).where("s2 IS NOT NULL")
    return pairs.select("id", F.round(N.similarity(F.col("start_time"), F.col("s2"), F.col("title"), F.col("t2")), 6).alias("similarity"))


@query("w17_created_in_turn", None)  # what is made depends on all made before; a test follows it row by row
def _(s, d):
    rows = T.highlights(s, d).select("id", "stream_id", "start_time", "end_time", F.col("viewer_engagement").alias("score"), F.col("title").alias("description"))
    return N.created_in_turn(rows)


@query("g26_topics", None)  # clusters of a fitted model
def _(s, d):
    texts = T.chat_parts(s, d)[1].select(F.col("message_id").alias("id"), "message", F.col("n_messages").alias("weight"))
    return N.topics(texts).select("topic", "n", F.array_join("keywords", ",").alias("keywords"))


# ---- intake and dispatch -----------------------------------------------------------------------


@query("a34_bulk_usage", "SELECT id, CAST((ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY id) - 1) // 1000 AS INTEGER) AS batch FROM usage_records")
def _(s, d):
    from pyspark.sql.window import Window

    place = F.row_number().over(Window.partitionBy("user_id").orderBy("id")) - 1
    return T.usage_records(s, d).select("id", F.floor(place / 1000).cast("int").alias("batch"))


@query("a51_recorded_metrics", "SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, COUNT(*) AS n, COUNT(*) FILTER (event_type = 'error') AS failed, ROUND(SUM(value), 4) AS total FROM events GROUP BY 1, 2")
def _(s, d):
    rows = T.read(s, d, "events")
    return rows.groupBy("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("failed"), F.round(F.sum("value"), 4).alias("total"))


@query("k15_processing_modes", "SELECT id, CASE WHEN id % 7 = 0 THEN 'live' WHEN contains(url, 'youtube.com') THEN 'url' ELSE 'file' END AS mode FROM stream_urls")
def _(s, d):
    return T.stream_urls(s, d).select("id", C.processing_mode(F.col("id") % 7 == 0, F.col("url")).alias("mode"))


@query("k57_completed_batches", "SELECT id, CASE WHEN failed_items = 0 THEN 'completed' ELSE 'completed_with_errors' END AS status, ROUND(date_diff('microsecond', created_at, completed_at) / 6e7::DOUBLE, 4) AS minutes FROM batches WHERE completed_at IS NOT NULL")
def _(s, d):
    minutes = F.timestamp_diff("MICROSECOND", F.col("created_at"), F.col("completed_at")) / F.lit(6e7)
    status = F.when(F.col("failed_items") == 0, "completed").otherwise("completed_with_errors")
    return T.batches(s, d).where("completed_at IS NOT NULL").select("id", status.alias("status"), F.round(minutes, 4).alias("minutes"))


for _method in ("score", "criteria"):
    for _strategy, _keep in (("top", "nth <= 10"), ("threshold", "p AND place <= 10 OR place <= 1")):
        _rank = "ROUND(score * confidence, 9)" if _method == "score" else "ROUND(0.4::DOUBLE * score + 0.3::DOUBLE * confidence + 0.1::DOUBLE * GREATEST(0, 1 - abs(end_time - start_time - 40) / 40) + 0.05::DOUBLE, 9)"

        @query(f"k04_select_{_strategy}_by_{_method}", f"WITH {CAND}, r AS (SELECT *, score >= 0.3 AS p, ROW_NUMBER() OVER (PARTITION BY stream_id ORDER BY {_rank} DESC, id) AS nth FROM cand), q AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY stream_id ORDER BY p DESC, nth) AS place FROM r) SELECT stream_id, id FROM q WHERE {_keep}")
        def _(s, d, method=_method, strategy=_strategy):
            return K.select_highlights(K.rank_candidates(candidates(s, d), method), strategy)
