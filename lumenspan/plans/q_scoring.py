"""Queries of fitted models, valence rules, and what comes in, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenspan.functions import text as X
from lumenspan.operators import intake as I
from lumenspan.operators import models as M
from lumenspan.operators import valence as V
from lumenspan.plans.prelude import with_tables
from lumenspan.plans.q_chat import LEXICON, TOK
from lumenspan.plans.q_content import _FOUND
from lumenspan.plans.q_temporal import _NUM, CAND, candidates, rounded
from lumenspan.sources import tables as T
from lumenspan.sources.shared import fresh_path

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None):
    """Register a query under ``name`` together with its SQL."""

    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = with_tables(sql)
        return f

    return add


# ---- fitted models -------------------------------------------------------------------------


def measured_documents(s, d):
    """Documents with plain measures of their text, and their label where they have one."""
    text = F.coalesce("text", F.lit(""))
    words = F.regexp_count(text, F.lit(V.WORD))
    rows = T.read(s, d, "documents").select("doc_id", F.length(text).cast("double").alias("chars"), words.cast("double").alias("words"), F.coalesce(F.try_divide(F.length(text), words), F.lit(0.0)).alias("word_length"), F.coalesce(F.try_divide(F.length(F.regexp_replace(text, r"[^#*$%&|<>]", "")), F.length(text)), F.lit(0.0)).alias("symbols"))
    return rows.join(T.read(s, d, "labels").select("doc_id", "quality"), "doc_id", "left")


VERSIONS = {"1.0": ["chars", "words"], "2.0": ["chars", "words", "word_length", "symbols"]}


@query("x04_model_scores", None)  # probabilities of fitted models; a test applies the coefficients by hand
def _(s, d):
    rows = measured_documents(s, d)
    store = M.ModelStore(s, fresh_path(s, "models"))
    found = None
    for version, features in VERSIONS.items():
        store.save("quality", version, M.fitted(rows, features, "quality"))
        some = M.scored(store.load("quality", version), rows).select("doc_id", F.lit(version).alias("version"), "prediction", F.round(F.get("probability", 1), 6).alias("probability"))
        found = some if found is None else found.unionByName(some)
    return found


# ---- valence rules -------------------------------------------------------------------------


def _in(words):
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


_BARE = r"list_filter(list_transform(regexp_extract_all(COALESCE(text, ''), '[^\x20\x09-\x0D]+'), lambda w: regexp_replace(w, '^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$', '', 'g')), lambda w: w <> '')"
_CAPITAL = r"(regexp_matches({w}, '^[^\p{{Ll}}]*\p{{Lu}}[^\p{{Ll}}]*$') AND length({w}) > 1)"
_PUSH = " + ".join(f"CASE WHEN l{k} IN {_in(V.STRONGER)} THEN {V.INTENSITY * f}::DOUBLE WHEN l{k} IN {_in(V.WEAKER)} THEN {-V.INTENSITY * f}::DOUBLE ELSE 0 END" for k, f in enumerate(V.FADING, 1))
_VALENCE = f"""known AS (SELECT doc_id, quality, list_distinct(list_transform({_BARE}, lambda w: lower(w))) AS ws FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL), total AS (SELECT COUNT(*) FILTER (quality = 1) AS g, COUNT(*) FILTER (quality = 0) AS b FROM known),
  lexicon AS (SELECT * FROM (SELECT word, ROUND(GREATEST(-4.0::DOUBLE, LEAST(4.0::DOUBLE, 2 * ln(((good + 1)::DOUBLE / (g + 2)) / ((bad + 1)::DOUBLE / (b + 2))))), 3) AS valence FROM (SELECT word, COUNT(*) FILTER (quality = 1) AS good, COUNT(*) FILTER (quality = 0) AS bad FROM (SELECT quality, UNNEST(ws) AS word FROM known) GROUP BY word) CROSS JOIN total WHERE good + bad >= 5) WHERE abs(valence) >= 0.5),
  words AS (SELECT id, COALESCE(text, '') AS message, {_BARE} AS w FROM msgs), told AS (SELECT *, len(w) AS n, list_transform(w, lambda x: lower(x)) AS lw, len(list_filter(w, lambda x: {_CAPITAL.format(w='x')})) AS capitals, length(regexp_replace(message, '[^!]', '', 'g')) AS shouts, length(regexp_replace(message, '[^?]', '', 'g')) AS asked FROM words),
  marked AS (SELECT *, COALESCE(list_position(lw, 'but'), 0) AS but, LEAST(shouts, 4) * {V.SHOUT}::DOUBLE + CASE WHEN asked > 3 THEN {V.ASK_MOST}::DOUBLE WHEN asked > 1 THEN asked * {V.ASK}::DOUBLE ELSE 0 END AS marks FROM told),
  each AS (SELECT id, n, capitals, but, i, w[i] AS written, lw[i] AS word, CASE WHEN i > 1 THEN lw[i - 1] END AS l1, CASE WHEN i > 2 THEN lw[i - 2] END AS l2, CASE WHEN i > 3 THEN lw[i - 3] END AS l3 FROM (SELECT *, UNNEST(range(1, n + 1)) AS i FROM marked)),
  rated AS (SELECT id, (valence + CASE WHEN {_CAPITAL.format(w='written')} AND capitals < n THEN sign(valence) * {V.CAPITALS}::DOUBLE ELSE 0 END + sign(valence) * ({_PUSH})) * CASE WHEN l1 IN {_in(V.NEGATIONS)} OR l2 IN {_in(V.NEGATIONS)} OR l3 IN {_in(V.NEGATIONS)} THEN {V.NEGATION}::DOUBLE ELSE 1 END * CASE WHEN but = 0 THEN 1 WHEN i < but THEN 0.5::DOUBLE WHEN i > but THEN 1.5::DOUBLE ELSE 1 END AS v FROM each JOIN lexicon USING (word)),
  sums AS (SELECT id, SUM(v) AS s, SUM(CASE WHEN v > 0 THEN v + 1 ELSE 0 END) AS p, SUM(CASE WHEN v < 0 THEN 1 - v ELSE 0 END) AS q, COUNT(*) AS hits FROM rated GROUP BY id),
  joined AS (SELECT id, message, n, marks, COALESCE(s, 0) AS s, COALESCE(p, 0) AS p, COALESCE(q, 0) AS q, COALESCE(hits, 0) AS hits FROM marked LEFT JOIN sums USING (id)),
  parts AS (SELECT id, message, s + sign(s) * marks AS total, p + CASE WHEN p > q THEN marks ELSE 0 END AS p, q + CASE WHEN q > p THEN marks ELSE 0 END AS q, n - hits AS rest FROM joined),
  scored AS (SELECT id, message, COALESCE(p / NULLIF(p + q + rest, 0), 0) AS positive, COALESCE(q / NULLIF(p + q + rest, 0), 0) AS negative, COALESCE(rest / NULLIF(p + q + rest, 0), 1) AS neutral, total / sqrt(total * total + {V.NORM}::DOUBLE) AS compound FROM parts)"""


@query("h14_valence", f"""WITH msgs AS (SELECT conv_id * 1000000 + turn AS id, text FROM conversations), {_VALENCE}, said AS (SELECT id AS event_id, message FROM scored), {LEXICON.replace('chat_messages', 'said')}, mixed AS (SELECT s.id, (positive + GREATEST(0, score)) / 2 AS positive, (negative + GREATEST(0, -score)) / 2 AS negative, neutral, (compound + score) / 2 AS compound FROM scored s JOIN lex l ON l.event_id = s.id)
  SELECT id, ROUND(positive, 6) + 0 AS positive, ROUND(negative, 6) + 0 AS negative, ROUND(neutral, 6) + 0 AS neutral, ROUND(compound, 6) + 0 AS compound, CASE WHEN compound >= 0.05 THEN 'positive' WHEN compound <= -0.05 THEN 'negative' ELSE 'neutral' END AS label, ROUND(CASE WHEN compound >= 0.05 OR compound <= -0.05 THEN abs(compound) ELSE 1 - abs(compound) END, 6) + 0 AS confidence FROM mixed""")
def _(s, d):
    turns = T.read(s, d, "conversations").select((F.col("conv_id") * 1_000_000 + F.col("turn")).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    lexicon = V.learned_lexicon(T.read(s, d, "documents"), T.read(s, d, "labels"))
    scores = V.valence_scores(turns, "id", "text", lexicon)
    second = turns.select("id", X.lexicon_sentiment(F.col("text"))["score"].alias("polarity"))
    found = V.blended(scores.join(second, "id"), F.col("polarity")).drop("polarity")
    return rounded(found, "positive", "negative", "neutral", "compound", "confidence")


# ---- what comes in -------------------------------------------------------------------------

_TURNS = "said AS (SELECT conv_id, turn, COALESCE(text, '') AS message, turn * 20.0::DOUBLE AS start_time, turn * 20.0::DOUBLE + CASE WHEN turn % 2 = 0 THEN 15 ELSE 10 END AS end_time FROM conversations)"


@query("k10_transcript_highlights", f"""WITH {_TURNS}, x AS (SELECT *, {_FOUND} AS found, len({TOK}) AS words FROM said), y AS (SELECT *, words / GREATEST(0.1, (end_time - start_time) / 60) / 160 AS speed FROM x)
  SELECT conv_id, turn, start_time, end_time, ROUND(0.25::DOUBLE / (1 + exp(-(10 * found / GREATEST(1, words)))) + 0.15::DOUBLE * CASE WHEN speed > 0.6 THEN 1 / (1 + exp(-(speed - 0.6))) ELSE 0 END, 6) AS score FROM y""")
def _(s, d):
    start = F.col("turn") * 20.0
    rows = T.read(s, d, "conversations").select("conv_id", "turn", "text", start.alias("start_time"), F.when(F.col("turn") % 2 == 0, start + 15).alias("end_time"))
    found = I.from_transcripts(rows, F.size(X.tokens(F.coalesce("text", F.lit("")))))
    return rounded(found.select("conv_id", "turn", "start_time", "end_time", "score"), "score")


_CATEGORY = "['action', 'Emotional', 'informative', 'other'][id // 5 % 4 + 1]"


@query("k13_unified_highlights", f"""WITH RECURSIVE plain AS (SELECT id, stream_id, start_time, end_time, viewer_engagement AS score, confidence_score AS confidence, {_CATEGORY} AS category FROM highlights),
  cand AS (SELECT * FROM plain WHERE score * CASE lower(category) WHEN 'action' THEN 1.2::DOUBLE WHEN 'emotional' THEN 1.1 WHEN 'informative' THEN 1 ELSE 0.9 END >= 0.5 AND confidence >= 0.6), {_NUM}, walk AS (
  SELECT stream_id, nth, id AS first_id, category, start_time, end_time, confidence, 1::BIGINT AS n FROM numbered WHERE nth = 1
  UNION ALL SELECT x.stream_id, x.nth, CASE WHEN j THEN w.first_id ELSE x.id END, x.category, CASE WHEN j THEN w.start_time ELSE x.start_time END, CASE WHEN j THEN GREATEST(w.end_time, x.end_time) ELSE x.end_time END,
    CASE WHEN j THEN (w.confidence + x.confidence) / 2 ELSE x.confidence END, CASE WHEN j THEN w.n + 1 ELSE 1 END
  FROM walk w JOIN numbered x ON x.stream_id = w.stream_id AND x.nth = w.nth + 1 CROSS JOIN LATERAL (SELECT x.category = w.category AND x.start_time - w.end_time <= 10 AS j) z)
  SELECT stream_id, first_id AS id, ROUND(arg_max(end_time, nth), 9) AS end_time, ROUND(arg_max(confidence, nth), 9) AS confidence, MAX(n) AS n FROM walk GROUP BY stream_id, first_id""")
def _(s, d):
    rows = candidates(s, d).withColumn("category", T.pick(F.floor(F.col("id") / 5) % 4, "action", "Emotional", "informative", "other"))
    return rounded(I.unified(rows).select("stream_id", "id", "end_time", "confidence", "n"), "end_time", "confidence", digits=9)


@query("k19_registered_streams", """WITH r AS (SELECT id AS request_id, id % 1000 AS stream_id, platform AS format, ['epoch_seconds', 'relative_seconds', 'rtmp_timestamp'][id % 3 + 1] AS time_form, duration AS base, created_at AS sent, id % 97 = 0 AS is_reference FROM streams),
  top AS (SELECT COALESCE(arg_max(stream_id, {'a': sent, 'b': request_id}) FILTER (is_reference), arg_min(stream_id, {'a': sent, 'b': request_id})) AS reference FROM r)
  SELECT stream_id, arg_max(format, {'a': sent, 'b': request_id}) AS format, arg_max(time_form, {'a': sent, 'b': request_id}) AS time_form, arg_max(base, {'a': sent, 'b': request_id}) AS base, MIN(sent) AS registered_at, stream_id = ANY_VALUE(reference) AS is_reference FROM r CROSS JOIN top GROUP BY stream_id""")
def _(s, d):
    key = F.col("id")
    rows = T.streams(s, d).select(key.alias("request_id"), (key % 1000).alias("stream_id"), F.col("platform").alias("format"), T.pick(key % 3, "epoch_seconds", "relative_seconds", "rtmp_timestamp").alias("time_form"), F.col("duration").alias("base"), F.col("created_at").alias("at"), (key % 97 == 0).alias("is_reference"))
    return I.registered(rows)


@query("k35_video_frames", "SELECT frame_id, ROUND(LEAST(1, CASE WHEN quality > 0.8 THEN 0.3::DOUBLE ELSE 0 END + 0.3::DOUBLE * (quality * 0.9::DOUBLE) + 0.1::DOUBLE + CASE WHEN quality > 0.7 THEN 0.2::DOUBLE ELSE 0 END), 6) AS score, ROUND(LEAST(quality + 0.1, 1), 6) AS confidence FROM frames WHERE quality >= 0.3")
def _(s, d):
    return rounded(I.video_frames(T.frames(s, d)).select("frame_id", "score", "confidence"), "score", "confidence")


@query("g15_normalized_weights", "WITH w AS (SELECT modality, AVG(confidence) AS weight FROM detections GROUP BY modality) SELECT modality, ROUND(weight / SUM(weight) OVER (), 6) AS weight FROM w")
def _(s, d):
    weights = T.detections(s, d).groupBy("modality").agg(F.avg("confidence").alias("weight"))
    return rounded(weights.crossJoin(F.broadcast(weights.agg(F.sum("weight").alias("total")))).select("modality", F.try_divide("weight", "total").alias("weight")), "weight")


@query("a33_bulk_created", "SELECT id, stream_id FROM highlights UNION ALL SELECT id + 1000000000, stream_id FROM highlights WHERE id % 10 = 0")
def _(s, d):
    rows = T.highlights(s, d).select("id", "stream_id")
    path = fresh_path(s, "highlights")
    rows.write.parquet(path)
    # Half of what is sent is new; the rest, and what is sent twice, is held already.
    new = rows.where("id % 10 = 0").withColumn("id", F.col("id") + 1_000_000_000)
    return I.appended(rows.where("id % 10 = 1").unionByName(new).unionByName(new), path, "id")
