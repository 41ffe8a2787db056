"""Queries of chat: measures of messages, windows of excitement, reports, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenspan.functions import text as X
from lumenspan.operators import detection as D
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


# ---- SQL of the measures -----------------------------------------------------------------


def _quoted(word):
    return "'" + word.replace("'", "''") + "'"


def _list(words):
    return "[" + ", ".join(map(_quoted, words)) + "]"


def _weighed(text, weights):
    return " + ".join(f"CASE WHEN contains({text}, {_quoted(k)}) THEN {w}::DOUBLE ELSE 0::DOUBLE END" for k, w in weights.items())


def _hits(text, weights):
    return " + ".join(f"contains({text}, {_quoted(k)})::INT" for k in weights)


TOK = "list_filter(regexp_split_to_array(lower(message), '\\s+'), lambda w: w <> '')"
_GOOD = f"len(list_intersect(list_distinct({TOK}), {_list(X.POSITIVE)}))"
_BAD = f"len(list_intersect(list_distinct({TOK}), {_list(X.NEGATIVE)}))"
_EMOJI = "(length(regexp_replace(message, '[\\x00-\\x7F]', '', 'g')) + " + " + ".join(f"(length(message) - length(replace(message, '{e}', ''))) // {len(e)}" for e in X.EMOTICONS) + ")"
_CAPS = "CASE WHEN length(message) > 10 THEN length(regexp_replace(message, '[^\\p{Lu}]', '', 'g')) / length(message) ELSE 0 END"
_MARKS = "COALESCE(length(regexp_replace(message, '[^!?]', '', 'g')) / NULLIF(length(message), 0), 0)"
_TOX = " + ".join(f"len(regexp_extract_all(lower(message), '{p}'))" for p in X.TOXIC)
_WORDS = "list_filter(regexp_split_to_array(message, '\\s+'), lambda w: w <> '')"
_SPAM = f"""((upper(message) = message AND lower(message) <> message AND length(message) > 5)::INT + (length(regexp_replace(message, '[^!?.,;:]', '', 'g')) > length(message) * 0.3)::INT
  + list_bool_or(list_transform(string_split(message, ''), lambda c: contains(message, repeat(c, 5))))::INT + (length(trim(message)) < 3)::INT + ({' OR '.join(f"regexp_matches(lower(message), '{p}')" for p in X.SPAM)})::INT
  + ({_EMOJI} > length(message) * 0.5)::INT + (len({_WORDS}) > 3 AND len(list_distinct({_WORDS})) = 1)::INT) / 7"""
_CLEAN = "regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(message, 'https?://\\S+', '', 'g'), '[@#][A-Za-z0-9_]+', '', 'g'), '\\s+', ' ', 'g')), '[^A-Za-z0-9_\\s.,!?-]', '', 'g')"
SCORED = f"""scored AS MATERIALIZED (SELECT *, COALESCE(({_GOOD} - {_BAD}) / NULLIF({_GOOD} + {_BAD}, 0), 0) AS sentiment, {_EMOJI} AS n_emoji, len(list_filter({_list(X.EXCITED)}, lambda k: contains(lower(message), k))) AS n_excited,
  {_SPAM} AS spam, {_CAPS} AS caps, CAST(LEAST(1, 0.2 * ({_TOX}) + CASE WHEN {_CAPS} > 0.7 THEN 0.1 ELSE 0 END + CASE WHEN {_MARKS} > 0.2 THEN 0.1 ELSE 0 END) AS DOUBLE) AS toxicity,
  length(message) >= 3 AND NOT regexp_matches(lower(username), '{'|'.join(X.BOTS)}') AND {_SPAM} <= 0.5 AS useful FROM chat_messages)"""
LEXICON = f"""lex AS MATERIALIZED (SELECT *, GREATEST(-1, LEAST(1, total)) AS score, LEAST(1, abs(GREATEST(-1, LEAST(1, total))) + 0.5::DOUBLE * hype) AS magnitude, CASE WHEN hits > 0 THEN LEAST(1, 0.2 * hits) ELSE 0.3 END AS confidence FROM (
  SELECT *, ({_weighed('lower(message)', X.POSITIVE_WEIGHTS)}) + ({_weighed('lower(message)', X.NEGATIVE_WEIGHTS)}) + ({_weighed('message', X.EMOTE_WEIGHTS)}) AS total, {_weighed('lower(message)', X.HYPE_WEIGHTS)} AS hype,
    {_hits('lower(message)', X.POSITIVE_WEIGHTS)} + {_hits('lower(message)', X.NEGATIVE_WEIGHTS)} + {_hits('lower(message)', X.HYPE_WEIGHTS)} + {_hits('message', X.EMOTE_WEIGHTS)} AS hits FROM chat_messages)),
named AS (SELECT *, CASE WHEN hype > 0.5 AND score > 0 THEN 'hype' WHEN score >= 0.6 THEN 'very_positive' WHEN score >= 0.2 THEN 'positive' WHEN score >= -0.2 THEN 'neutral' WHEN score >= -0.6 THEN 'negative' ELSE 'very_negative' END AS category FROM lex)"""

# ---- messages ----------------------------------------------------------------------------


@query("h08_word_sentiment", f"WITH {SCORED} SELECT event_id, ROUND(sentiment, 6) AS sentiment FROM scored")
def _(s, d):
    return T.chat_messages(s, d).select("event_id", F.round(X.word_sentiment(F.col("message")), 6).alias("sentiment"))


@query("h09_excited_words", f"SELECT event_id, array_to_string(list_filter({_list(X.EXCITED)}, lambda k: contains(lower(message), k)), ',') AS words FROM chat_messages")
def _(s, d):
    return T.chat_messages(s, d).select("event_id", F.array_join(X.excited_words(F.col("message")), ",").alias("words"))


@query("h10_emoji", f"SELECT event_id, CAST({_EMOJI} AS INTEGER) AS n FROM chat_messages")
def _(s, d):
    return T.chat_messages(s, d).select("event_id", X.emoji_count(F.col("message")).alias("n"))


@query("h11_spam_score", f"WITH {SCORED} SELECT event_id, ROUND(spam, 6) AS spam FROM scored")
def _(s, d):
    return T.chat_messages(s, d).select("event_id", F.round(X.spam_score(F.col("message")), 6).alias("spam"))


@query("h12_bots", f"SELECT event_id, {' OR '.join(f"contains(lower(username), '{b}')" for b in X.BOTS)} AS is_bot FROM chat_messages")
def _(s, d):
    return T.chat_messages(s, d).select("event_id", X.is_bot(F.col("username")).alias("is_bot"))


@query("h13_lexicon_sentiment", f"WITH {LEXICON} SELECT event_id, ROUND(score, 6) AS score, ROUND(magnitude, 6) AS magnitude, ROUND(CAST(confidence AS DOUBLE), 6) AS confidence, category FROM named")
def _(s, d):
    x = F.col("x")
    found = T.chat_messages(s, d).select("event_id", X.lexicon_sentiment(F.col("message")).alias("x"))
    return found.select("event_id", F.round(x["score"], 6).alias("score"), F.round(x["magnitude"], 6).alias("magnitude"), F.round(X.sentiment_confidence(x["hits"]), 6).alias("confidence"), X.sentiment_category(x["score"], x["hype"]).alias("category"))


_EMO = f"emo AS (SELECT event_id, {', '.join('COALESCE((' + ' + '.join(f'len(list_filter(w, lambda x: x = {_quoted(k)})) * {v}::DOUBLE' for k, v in words.items()) + f') / NULLIF(len(w), 0), 0) AS {name}' for name, words in X.EMOTIONS.items())} FROM (SELECT event_id, list_filter(regexp_extract_all(lower({_CLEAN}), '[a-z]+'), lambda x: NOT list_contains({_list(X.STOP)}, x)) AS w FROM chat_messages))"
_MOST = f"GREATEST({', '.join(X.EMOTIONS)})"


@query("h15_emotions", f"WITH {_EMO} SELECT event_id, {', '.join(f'ROUND({e}, 6) AS {e}' for e in X.EMOTIONS)}, CASE WHEN {_MOST} = 0 THEN 'neutral' {' '.join(f"WHEN {e} = {_MOST} THEN '{e}'" for e in X.EMOTIONS)} END AS primary_emotion FROM emo")
def _(s, d):
    sent, texts = T.chat_parts(s, d)
    words = texts.select("message_id", X.emotion_words(F.col("message")).alias("words"))
    found = words.select("message_id", X.emotions_of(F.col("words")).alias("x"))
    told = found.select("message_id", *[F.round(F.col("x")[e], 6).alias(e) for e in X.EMOTIONS], X.primary_emotion(F.col("x")).alias("primary_emotion"))
    return sent.select("event_id", "message_id").join(told, "message_id").drop("message_id")


@query("h16_keywords", f"""WITH words AS (SELECT stream_id, UNNEST(list_filter({TOK}, lambda w: regexp_full_match(w, '[a-z]{{3,}}') AND NOT list_contains({_list(X.STOP)}, w))) AS word FROM chat_messages)
  SELECT stream_id, word, COUNT(*) AS n, CAST(ROW_NUMBER() OVER (PARTITION BY stream_id ORDER BY COUNT(*) DESC, word) AS INTEGER) AS nth FROM words GROUP BY stream_id, word QUALIFY nth <= 10""")
def _(s, d):
    return D.top_keywords(T.chat_messages(s, d))


@query("h17_toxicity", f"WITH {SCORED} SELECT event_id, ROUND(toxicity, 6) AS toxicity FROM scored")
def _(s, d):
    return T.chat_messages(s, d).select("event_id", F.round(X.toxicity(F.col("message")), 6).alias("toxicity"))


@query("h18_cleaned", f"SELECT event_id, {_CLEAN} AS text FROM chat_messages")
def _(s, d):
    return T.chat_messages(s, d).select("event_id", X.cleaned(F.col("message")).alias("text"))


@query("h20_message_analysis", f"WITH {SCORED}, {LEXICON}, {_EMO} SELECT event_id, ROUND(n.score, 6) AS score, n.category, CASE WHEN {_MOST} = 0 THEN 'neutral' {' '.join(f"WHEN {e} = {_MOST} THEN '{e}'" for e in X.EMOTIONS)} END AS emotion, CAST(len({TOK.replace('message', 's.message')}) AS INTEGER) AS n_words, ROUND(s.toxicity, 6) AS toxicity FROM scored s JOIN named n USING (event_id) JOIN emo USING (event_id)")
def _(s, d):
    text, x = F.col("message"), F.col("x")
    sent, texts = T.chat_parts(s, d)
    found = texts.withColumn("x", X.lexicon_sentiment(text)).withColumn("e", X.emotions(text))
    told = found.select("message_id", F.round(x["score"], 6).alias("score"), X.sentiment_category(x["score"], x["hype"]).alias("category"), X.primary_emotion(F.col("e")).alias("emotion"), F.size(X.tokens(text)).alias("n_words"), F.round(X.toxicity(text), 6).alias("toxicity"))
    return sent.select("event_id", "message_id").join(told, "message_id").drop("message_id")


@query("h21_emotes", f"SELECT event_id, array_to_string(list_filter({_list(X.EMOTES)}, lambda k: contains(message, k)), ',') AS emotes FROM chat_messages")
def _(s, d):
    return T.chat_messages(s, d).select("event_id", F.array_join(X.emotes(F.col("message")), ",").alias("emotes"))


@query("b49_useful_messages", f"WITH {SCORED} SELECT event_id, stream_id FROM scored WHERE useful")
def _(s, d):
    return T.chat_messages(s, d).where(D.is_useful()).select("event_id", "stream_id")


@query("j15_spam", f"""WITH {SCORED} SELECT event_id, (COUNT(*) OVER w > 3 AND len(list_distinct(list(message) OVER w)) * 2 < COUNT(*) OVER w) OR caps > 0.8 OR regexp_matches(lower(message), 'https?://') AS is_spam
  FROM scored WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 59999999 MICROSECONDS PRECEDING AND INTERVAL 59999999 MICROSECONDS FOLLOWING)""")
def _(s, d):
    return D.spam_flags(T.chat_messages(s, d)).select("event_id", "is_spam")


# ---- fixed windows -----------------------------------------------------------------------

_HOUR = 'CAST(floor(t / 3600) AS BIGINT) AS "window"'


@query("d24_engagement", f"""WITH {SCORED}, {LEXICON}, w AS (SELECT stream_id, "window", COUNT(*) AS n, COUNT(DISTINCT user_id) AS users, COUNT(*) / GREATEST((MAX(t) - MIN(t)) / 60, 1) AS rate, AVG(length(message)) AS len, AVG((score >= 0.05)::INT) AS good, AVG((score <= -0.05)::INT) AS bad, AVG((toxicity > 0.5)::INT) AS toxic
    FROM (SELECT *, {_HOUR} FROM (SELECT l.*, s.toxicity FROM lex l JOIN scored s USING (event_id))) GROUP BY ALL)
  SELECT stream_id, "window", n, users, ROUND(rate, 6) AS rate, ROUND(len, 6) AS avg_length, ROUND(good, 6) AS positive, ROUND(bad, 6) AS negative, ROUND(toxic, 6) AS toxic,
    ROUND(GREATEST(0, LEAST(1, 0.3 * LEAST(1, rate / 10) + 0.3 * LEAST(1, users / 50) + 0.2 * LEAST(1, len / 20) + 0.2 * (good - 0.5 * bad))), 6) AS engagement FROM w""")
def _(s, d):
    return rounded(D.engagement(T.chat_messages(s, d)), "rate", "avg_length", "positive", "negative", "toxic", "engagement")


_CATEGORIES = ("very_positive", "positive", "neutral", "negative", "very_negative", "hype")


@query("d25_window_reports", f"""WITH {LEXICON}, w AS (SELECT stream_id, {_HOUR}, COUNT(*) AS n, COUNT(DISTINCT user_id) AS users, AVG(score) AS sentiment, AVG(len(list_filter({_list(X.EMOTES)}, lambda k: contains(message, k)))) AS emote_density, {', '.join(f"COUNT(*) FILTER (category = '{c}') AS {c}" for c in _CATEGORIES)} FROM named GROUP BY ALL)
  SELECT stream_id, "window", n, users, ROUND(sentiment, 6) + 0 AS sentiment, ROUND(emote_density, 6) + 0 AS emote_density, {', '.join(_CATEGORIES)},
    ROUND(LEAST(1, 0.4 * LEAST(1, n / 3600 / 50) + 0.3 * LEAST(1, (sentiment + 1) / 2 + 0.3 * hype / n) + 0.3 * LEAST(1, emote_density * 2)), 6) + 0 AS score FROM w""")
def _(s, d):
    return rounded(D.window_reports(T.chat_messages(s, d)), "sentiment", "emote_density", "score")


@query("d25_top_emotes", f"SELECT stream_id, emote, COUNT(*) AS n, CAST(ROW_NUMBER() OVER (PARTITION BY stream_id ORDER BY COUNT(*) DESC, emote) AS INTEGER) AS nth FROM (SELECT stream_id, UNNEST(list_filter({_list(X.EMOTES)}, lambda k: contains(message, k))) AS emote FROM chat_messages) GROUP BY stream_id, emote QUALIFY nth <= 5")
def _(s, d):
    return D.top_emotes(T.chat_messages(s, d))


_FOUND = f"list_concat(list_filter({_list([*X.POSITIVE_WEIGHTS, *X.NEGATIVE_WEIGHTS, *X.HYPE_WEIGHTS])}, lambda k: contains(lower(message), k)), list_transform(list_filter({_list(X.EMOTE_WEIGHTS)}, lambda k: contains(message, k)), lambda k: 'emote:' || k))"


@query("d26_aggregate_sentiment", f"""WITH {LEXICON}, words AS (SELECT stream_id, list_sort(list_distinct(flatten(list({_FOUND}))))[1:10] AS words FROM chat_messages GROUP BY stream_id), agg AS (SELECT stream_id, AVG(score) AS score, AVG(magnitude) AS magnitude, AVG(CAST(confidence AS DOUBLE)) AS confidence, var_pop(score) AS variance FROM lex GROUP BY stream_id)
  SELECT stream_id, ROUND(score, 6) AS score, ROUND(magnitude, 6) AS magnitude, ROUND(confidence, 6) AS confidence, ROUND(variance, 6) AS variance, array_to_string(words, ',') AS words,
    CASE WHEN score >= 0.6 THEN 'very_positive' WHEN score >= 0.2 THEN 'positive' WHEN score >= -0.2 THEN 'neutral' WHEN score >= -0.6 THEN 'negative' ELSE 'very_negative' END AS category FROM agg JOIN words USING (stream_id)""")
def _(s, d):
    return rounded(D.aggregate_sentiment(T.chat_messages(s, d)).withColumn("words", F.array_join("words", ",")), "score", "magnitude", "confidence", "variance")


@query("s20_velocities", """WITH per AS (SELECT stream_id, CAST(floor(t / 3600) AS BIGINT) AS w, COUNT(*) / 3600 AS rate FROM chat_messages GROUP BY ALL), a AS (SELECT *, COALESCE(rate - LAG(rate) OVER o, 0) AS acc, COALESCE(rate / AVG(rate) OVER (PARTITION BY stream_id ORDER BY w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS ratio FROM per WINDOW o AS (PARTITION BY stream_id ORDER BY w)),
  b AS (SELECT *, COALESCE(acc - LAG(acc) OVER (PARTITION BY stream_id ORDER BY w), 0) + 0 AS jerk FROM a)
  SELECT stream_id, w AS "window", ROUND(rate, 8) + 0 AS rate, ROUND(acc, 8) + 0 AS acceleration, ROUND(jerk, 8) + 0 AS jerk, ROUND(LEAST(1, GREATEST(0, (ratio - 1) / 4)), 6) + 0 AS intensity,
    ROUND(LEAST(1, CASE WHEN ratio >= 2 AND LEAST(1, GREATEST(0, (ratio - 1) / 4)) >= 0.3 THEN 0.7 + 0.3 * LEAST(1, GREATEST(0, (ratio - 1) / 4)) ELSE LEAST(rate / 20, 0.5) END + CASE WHEN acc > 0 THEN LEAST(acc / 10, 0.2) ELSE 0 END), 6) + 0 AS score FROM b""")
def _(s, d):
    found = D.velocities(T.chat_messages(s, d)).withColumn("score", D.velocity_score(F.col("rate"), F.col("acceleration"), F.col("spike"), F.col("intensity")))
    return rounded(rounded(found.drop("spike"), "rate", "acceleration", "jerk", digits=8), "intensity", "score")


_CATW = "CASE category " + " ".join(f"WHEN '{c}' THEN {w}::DOUBLE" for c, w in D.CATEGORY_WEIGHTS.items()) + " ELSE 0.5::DOUBLE END"


@query("s18_mood_scores", f"WITH {LEXICON} SELECT event_id, ROUND(LEAST(1, (0.5 * {_CATW} + 0.3 * magnitude + 0.2 * confidence) * CASE WHEN score > 0 THEN 1 + 0.2 * score ELSE 1 END), 6) AS mood FROM named")
def _(s, d):
    x = F.col("x")
    found = T.chat_messages(s, d).select("event_id", X.lexicon_sentiment(F.col("message")).alias("x"))
    return found.select("event_id", F.round(D.mood_score(X.sentiment_category(x["score"], x["hype"]), x["magnitude"], X.sentiment_confidence(x["hits"]), x["score"]), 6).alias("mood"))


_DENSE = " OR ".join(f"contains(message, {_quoted(e)})" for e in X.DENSE_EMOTES)


@query("d45_chat_content", f"""WITH {LEXICON}, w AS (SELECT stream_id, {_HOUR}, COUNT(*) AS n, AVG(score) AS sentiment, AVG((hype > 0.5)::INT) AS share, AVG(({_DENSE})::INT) AS density FROM lex GROUP BY ALL)
  SELECT stream_id, "window", n, ROUND(sentiment, 6) + 0 AS sentiment, ROUND(share, 6) AS highlight_share, ROUND(density, 6) AS emote_density, ROUND(LEAST(0.2 * sentiment + 0.3 * share + CASE WHEN n > 50 THEN 0.3 ELSE 0 END + LEAST(n / 100, 0.2), 1), 6) + 0 AS score, ROUND(LEAST(0.7 + n / 100, 0.95), 6) AS confidence FROM w""")
def _(s, d):
    return rounded(D.chat_content(T.chat_messages(s, d)), "sentiment", "highlight_share", "emote_density", "score", "confidence")


_FEATURE_WORDS = ", ".join(map(_quoted, D.FEATURE_WORDS))


@query("h42_text_features", f"""SELECT stream_id, COUNT(*) AS n, ROUND(AVG(length(message)), 6) AS avg_chars, ROUND(AVG(len({TOK})), 6) AS avg_words, ROUND(AVG({' + '.join(f"(length(message) - length(replace(lower(message), {_quoted(k)}, ''))) // {len(k)}" for k in D.FEATURE_WORDS)}), 6) AS excitement,
  ROUND(SUM(length(regexp_replace(message, '[^\\p{{Lu}}]', '', 'g'))) / SUM(length(message)), 6) AS capitals, ROUND(AVG(length(regexp_replace(message, '[\\x00-\\x7F]', '', 'g'))), 6) AS emojis FROM chat_messages GROUP BY stream_id""")
def _(s, d):
    return rounded(D.text_features(T.chat_messages(s, d)), "avg_chars", "avg_words", "excitement", "capitals", "emojis")


# ---- windows that reset ------------------------------------------------------------------

RESET = """msg AS MATERIALIZED (SELECT stream_id, t, event_id, ROW_NUMBER() OVER (PARTITION BY stream_id ORDER BY t, event_id) AS nth FROM chat_messages),
  walk AS (SELECT stream_id, nth, t, t AS opened FROM msg WHERE nth = 1 UNION ALL SELECT m.stream_id, m.nth, m.t, CASE WHEN m.t - w.opened >= 1800 THEN m.t ELSE w.opened END FROM walk w JOIN msg m ON m.stream_id = w.stream_id AND m.nth = w.nth + 1)"""


@query("s15_reset_windows", f"WITH RECURSIVE {RESET} SELECT stream_id, ROUND(opened, 3) AS start_time, ROUND(MAX(t), 3) AS end_time, COUNT(*) AS n FROM walk GROUP BY stream_id, opened")
def _(s, d):
    return rounded(D.reset_windows(T.chat_messages(s, d), 1800.0), "start_time", "end_time", digits=3)


_SIG = lambda x: f"1 / (1 + exp(-({x})))"
WINDOWS = f"""{RESET}, {SCORED}, placed AS (SELECT c.*, w.opened FROM walk w JOIN msg m USING (stream_id, nth) JOIN scored c ON c.event_id = m.event_id),
  balance AS (SELECT stream_id, opened, COUNT(*) AS users, CASE WHEN COUNT(*) > 1 THEN 1 - (2 * SUM(i * n) / (COUNT(*) * SUM(n)) - (COUNT(*) + 1) / COUNT(*)) ELSE 0 END AS balance
    FROM (SELECT stream_id, opened, user_id, COUNT(*) AS n, ROW_NUMBER() OVER (PARTITION BY stream_id, opened ORDER BY COUNT(*), user_id) AS i FROM placed WHERE useful GROUP BY stream_id, opened, user_id) GROUP BY ALL),
  useful_windows AS (SELECT stream_id, opened, MAX(t) AS end_time, COUNT(DISTINCT user_id) AS users_all, COUNT(*) FILTER (useful) AS n, AVG(sentiment) FILTER (useful) AS mean_s, var_pop(sentiment) FILTER (useful) AS var_s, AVG((sentiment > 0.6)::INT) FILTER (useful) AS good,
    AVG(n_excited) FILTER (useful) AS words, AVG(n_emoji) FILTER (useful) AS emojis FROM placed GROUP BY ALL),
  ordered AS MATERIALIZED (SELECT u.*, b.users, b.balance, GREATEST(0.1::DOUBLE, u.end_time - opened) AS len, ROW_NUMBER() OVER (PARTITION BY stream_id ORDER BY opened) AS nth FROM useful_windows u JOIN balance b USING (stream_id, opened)),
  base AS (SELECT stream_id, nth, 1::DOUBLE AS rate0, 10::DOUBLE AS users0, 0.1::DOUBLE * (n / len) + 0.9::DOUBLE AS rate1, 0.1::DOUBLE * users + 9::DOUBLE AS users1 FROM ordered WHERE nth = 1
    UNION ALL SELECT o.stream_id, o.nth, b.rate1, b.users1, 0.1::DOUBLE * (o.n / o.len) + 0.9::DOUBLE * b.rate1, 0.1::DOUBLE * o.users + 0.9::DOUBLE * b.users1 FROM base b JOIN ordered o ON o.stream_id = b.stream_id AND o.nth = b.nth + 1),
  excited AS (SELECT *, CASE WHEN ratio >= 2 THEN {_SIG('(ratio - 1) / 2')} ELSE 0 END AS frequency, {_SIG('mean_s * good * 2')} AS sentiment, ({_SIG('users_ratio - 1')} + balance + users / n) / 3 AS engagement,
    LEAST(1, ({_SIG('words * 5')} + 1.5 * {_SIG('emojis * 2')}) / 2) AS keyword_emoji FROM (SELECT o.*, n / len AS rate, (n / len) / GREATEST(0.1, rate0) AS ratio, (users / len) / GREATEST(1, users0 / 60) AS users_ratio FROM ordered o JOIN base USING (stream_id, nth)))"""


def _measured(s, d):
    """Messages with what windows need, measured once on each different text."""
    sent, texts = T.chat_parts(s, d)
    return sent.join(D.measured_texts(texts, "message_id"), "message_id")


def _windows(s, d):
    return D.with_excitement(D.with_baselines(D.window_measures(_measured(s, d), 1800.0)))


@query("w13_frequency_spikes", f"WITH RECURSIVE {WINDOWS} SELECT stream_id, ROUND(opened, 3) AS start_time, n, ROUND(rate, 6) AS rate, ROUND(ratio, 4) AS ratio, ROUND(frequency, 6) AS frequency FROM excited")
def _(s, d):
    found = _windows(s, d).select("stream_id", F.round("start_time", 3).alias("start_time"), "n", "rate", F.round("ratio", 4).alias("ratio"), "frequency")
    return rounded(found, "rate", "frequency")


@query("w14_engagement", f"WITH RECURSIVE {WINDOWS} SELECT stream_id, ROUND(opened, 3) AS start_time, users, ROUND(balance, 6) AS balance, ROUND(users_ratio, 4) AS users_ratio, ROUND(engagement, 6) AS engagement FROM excited")
def _(s, d):
    found = _windows(s, d).select("stream_id", F.round("start_time", 3).alias("start_time"), "users", "balance", F.round("users_ratio", 4).alias("users_ratio"), "engagement")
    return rounded(found, "balance", "engagement")


@query("w15_window_sentiment", f"WITH RECURSIVE {WINDOWS} SELECT stream_id, ROUND(opened, 3) AS start_time, ROUND(mean_s, 6) AS mean_sentiment, ROUND(good, 6) AS good_share, ROUND(var_s, 6) AS variance, ROUND(sentiment, 6) AS sentiment FROM excited")
def _(s, d):
    found = _windows(s, d).select("stream_id", F.round("start_time", 3).alias("start_time"), "mean_sentiment", "good_share", F.col("sentiment_variance").alias("variance"), "sentiment")
    return rounded(found, "mean_sentiment", "good_share", "variance", "sentiment")


@query("w16_words_and_emojis", f"WITH RECURSIVE {WINDOWS} SELECT stream_id, ROUND(opened, 3) AS start_time, ROUND(words, 6) AS word_density, ROUND(emojis, 6) AS emoji_density, ROUND(keyword_emoji, 6) AS keyword_emoji FROM excited")
def _(s, d):
    found = _windows(s, d).select("stream_id", F.round("start_time", 3).alias("start_time"), "word_density", "emoji_density", "keyword_emoji")
    return rounded(found, "word_density", "emoji_density", "keyword_emoji")


_PARTS = tuple(D.CHAT_WEIGHTS)
_MEAN = f"(({' + '.join(_PARTS)}) / 4)"


@query("g27_chat_detector", f"""WITH RECURSIVE {WINDOWS}, found AS (SELECT stream_id, opened, LEAST(1, ({' + '.join(f'{w} * {p}' for p, w in D.CHAT_WEIGHTS.items())}) * (1 + 0.1 * LEAST(1, users_all / 100))) AS score, 1 - ({' + '.join(f'abs({p} - {_MEAN})' for p in _PARTS)}) / 4 AS confidence FROM excited)
  SELECT stream_id, ROUND(opened, 3) AS start_time, ROUND(score, 6) AS score, ROUND(confidence, 6) AS confidence FROM found WHERE score >= 0.1 AND confidence >= 0.1""")
def _(s, d):
    found = D.chat_highlights(_measured(s, d), 1800.0)
    return rounded(found.select("stream_id", F.round("start_time", 3).alias("start_time"), "score", "confidence"), "score", "confidence")
