"""Windows of chat and their excitement; engagement and spam of messages."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenspan.functions import text as X
from lumenspan.functions.scalar import normalize
from lumenspan.operators.scans import running_sums
from lumenspan.operators.temporal import fold_by, islands, opened

# Fixed weights and limits of the chat detector.
CHAT_WEIGHTS = {"frequency": 0.3, "sentiment": 0.25, "engagement": 0.25, "keyword_emoji": 0.2}
SHORTEST, MOST_SPAM, GOOD_FROM, SPIKE, EMOJI_BOOST, COMMUNITY = 3, 0.5, 0.6, 2.0, 1.5, 0.1
BASE_RATE, BASE_USERS, ALPHA = 1.0, 10.0, 0.1


def sigmoid(x: Column) -> Column:
    return normalize(x, method="sigmoid")


def is_useful() -> Column:
    """Long enough, not by a bot, and with little spam."""
    return (F.length("message") >= SHORTEST) & ~X.is_bot(F.col("username")) & (X.spam_score(F.col("message")) <= MOST_SPAM)


def engagement(messages: DataFrame, seconds: int = 3600) -> DataFrame:
    """Per stream and window: messages, users, messages a minute, mean length, shares of good, bad and toxic ones, and a mix."""
    text = F.col("message")
    slim = messages.select(
        "stream_id", "user_id", "t", F.floor(F.col("t") / seconds).cast("long").alias("window"), F.length(text).alias("length"),
        X.lexicon_sentiment(text)["score"].alias("score"), (X.toxicity(text) > 0.5).cast("double").alias("toxic"),
    )
    n, users = F.count("*"), F.countDistinct("user_id")
    rate = n / F.greatest((F.max("t") - F.min("t")) / 60, F.lit(1.0))
    good, bad = F.avg((F.col("score") >= 0.05).cast("double")), F.avg((F.col("score") <= -0.05).cast("double"))
    found = slim.groupBy("stream_id", "window").agg(
        n.alias("n"), users.alias("users"), rate.alias("rate"), F.avg("length").alias("avg_length"), good.alias("positive"), bad.alias("negative"), F.avg("toxic").alias("toxic")
    )
    return found.withColumn("engagement", engagement_score(F.col("rate"), F.col("users"), F.col("avg_length"), F.col("positive"), F.col("negative")))


def engagement_score(rate: Column, users: Column, length: Column, positive: Column, negative: Column) -> Column:
    one = F.lit(1.0)
    mix = 0.3 * F.least(rate / 10, one) + 0.3 * F.least(users / 50, one) + 0.2 * F.least(length / 20, one) + 0.2 * (positive - 0.5 * negative)
    return F.greatest(F.lit(0.0), F.least(mix, one))


def spam_flags(messages: DataFrame, seconds: float = 60.0) -> DataFrame:
    """Users who repeat themselves in less than a minute, shout, or post links; times are told apart to a microsecond.

    Each message opens a span around its time, and so does each run of a user's equal
    messages; running sums over the ends of spans tell, at any time, how many messages and
    how many different ones are near. No set is built, and a user's rows may lie in many ranges.
    """
    width = seconds - 5e-7
    rows = messages.select("event_id", "user_id", "t", F.xxhash64("message").alias("text_"), (F.col("t") - width).alias("from_"), (F.col("t") + width).alias("upto_"))
    end = lambda at, side, near, different: F.struct(F.col(at).alias("at"), F.lit(side).alias("side"), F.lit(near).alias("near"), F.lit(different).alias("different"), (F.col("event_id") if side == 1 else F.lit(None).cast("long")).alias("event_id"))
    each = rows.select("user_id", F.explode(F.array(end("from_", 0, 1, 0), end("t", 1, 0, 0), end("upto_", 2, -1, 0))).alias("x"))
    runs = islands(rows, ["user_id", "text_"], "from_", "upto_", "event_id").groupBy("user_id", "text_", "island").agg(F.min("from_").alias("from_"), F.max("upto_").alias("upto_"))
    runs = runs.withColumn("event_id", F.lit(None).cast("long"))
    equal = runs.select("user_id", F.explode(F.array(end("from_", 0, 0, 1), end("upto_", 2, 0, -1))).alias("x"))
    summed = running_sums(each.unionByName(equal).select("user_id", "x.*"), ["user_id"], ["at", "side"], ["near", "different"], "spam")
    counts = summed.where("side = 1").select("event_id", F.col("near_upto").alias("n_near"), F.col("different_upto").alias("n_distinct"))
    repeats = (F.col("n_near") > 3) & (F.col("n_distinct") * 2 < F.col("n_near"))
    return messages.join(counts, "event_id").withColumn("is_spam", repeats | (X.capitals_share(F.col("message")) > 0.8) | F.lower("message").rlike(r"https?://"))


def windowed(messages: DataFrame, seconds: float = 30.0) -> DataFrame:
    """Messages with the start of their window (``opened``)."""
    return opened(messages, ["stream_id"], "t", "event_id", seconds).drop("opens")


def reset_windows(messages: DataFrame, seconds: float = 30.0) -> DataFrame:
    """Windows that open with a message and close when one comes ``seconds`` or more after it."""
    found = windowed(messages.select("stream_id", "t", "event_id"), seconds)
    return found.groupBy("stream_id", F.col("opened").alias("start_time")).agg(F.max("t").alias("end_time"), F.count("*").alias("n"))


def measured_texts(texts: DataFrame, *kept: str) -> DataFrame:
    """The columns ``kept`` and what windows need of each ``message``: whether it is long enough with little spam (``fit``), sentiment, excited words, emojis."""
    text = F.col("message")
    fit = (F.length(text) >= SHORTEST) & (X.spam_score(text) <= MOST_SPAM)
    return texts.select(*kept, fit.alias("fit"), X.word_sentiment(text).alias("sentiment"), F.size(X.excited_words(text)).alias("n_excited"), X.emoji_count(text).alias("n_emoji"))


def window_measures(messages: DataFrame, seconds: float = 30.0) -> DataFrame:
    """Per window what the excitement scores need: counts, users, balance of users, sentiment, words and emojis of the useful messages.

    Messages may come with the columns of ``measured_texts`` instead of their text.
    """
    known = messages if "fit" in messages.columns else measured_texts(messages, *messages.columns)
    slim = known.select("stream_id", "t", "event_id", "user_id", (F.col("fit") & ~X.is_bot(F.col("username"))).alias("useful"), "sentiment", "n_excited", "n_emoji")
    of_window = ["stream_id", "opened"]
    useful = F.col("useful")
    per_user = windowed(slim, seconds).groupBy(*of_window, "user_id").agg(
        F.max("t").alias("end_time"), F.count("*").alias("n_all"), F.count_if(useful).alias("n"), F.sum(F.when(useful, F.col("sentiment"))).alias("s1"),
        F.sum(F.when(useful, F.col("sentiment") * F.col("sentiment"))).alias("s2"), F.count_if(useful & (F.col("sentiment") > GOOD_FROM)).alias("good"),
        F.sum(F.when(useful, F.col("n_excited"))).alias("words"), F.sum(F.when(useful, F.col("n_emoji"))).alias("emojis"),
    )
    # Place among the users with useful messages, by their number.
    place = F.row_number().over(Window.partitionBy(*of_window).orderBy((F.col("n") > 0).desc(), "n", "user_id"))
    placed = per_user.withColumn("i", F.when(F.col("n") > 0, place))
    users, n = F.count_if(F.col("n") > 0), F.sum("n")
    gini = 2 * F.sum(F.col("i") * F.col("n")) / (users * n) - (users + 1) / users
    zero = lambda c: F.coalesce(c, F.lit(0))
    found = placed.groupBy("stream_id", F.col("opened").alias("start_time")).agg(
        F.max("end_time").alias("end_time"), F.sum("n_all").alias("n_all"), F.count("*").alias("users_all"), n.alias("n"), users.alias("users"),
        F.when(users > 1, 1 - gini).otherwise(0.0).alias("balance"), zero(F.sum("s1") / n).alias("mean_sentiment"), zero(F.sum("s2") / n).alias("mean_square"),
        zero(F.sum("good") / n).alias("good_share"), zero(F.sum("words") / n).alias("word_density"), zero(F.sum("emojis") / n).alias("emoji_density"),
    )
    return found.withColumn("length", F.greatest(F.lit(0.1), F.col("end_time") - F.col("start_time")))


def with_baselines(windows: DataFrame) -> DataFrame:
    """Windows with useful messages, with the rates that the ones before lead to expect: running means carried in order of time."""

    def step(state, row):
        rate, users = (BASE_RATE, BASE_USERS) if state is None else state
        here = row["n"] / row["length"]
        after = (ALPHA * here + (1 - ALPHA) * rate, ALPHA * row["users"] + (1 - ALPHA) * users)
        return after, [{**row, "base_rate": rate, "base_users": users}]

    schema = windows.schema.add("base_rate", "double").add("base_users", "double")
    return fold_by(windows.where("n > 0"), ["stream_id"], ["start_time"], step, schema)


def with_excitement(windows: DataFrame) -> DataFrame:
    """``frequency``, ``sentiment``, ``engagement`` and ``keyword_emoji`` of windows with baselines."""
    rate = F.col("n") / F.col("length")
    ratio = rate / F.greatest(F.lit(0.1), F.col("base_rate"))
    users_ratio = (F.col("users") / F.col("length")) / F.greatest(F.lit(1.0), F.col("base_users") / 60)
    engaged = (sigmoid(users_ratio - 1) + F.col("balance") + F.least(F.lit(1.0), F.col("users") / F.col("n"))) / 3
    words = (sigmoid(F.col("word_density") * 5) + EMOJI_BOOST * sigmoid(F.col("emoji_density") * 2)) / 2
    return windows.select(
        "*", rate.alias("rate"), ratio.alias("ratio"),
        F.when(ratio >= SPIKE, sigmoid((ratio - 1) / SPIKE)).otherwise(0.0).alias("frequency"),
        sigmoid(F.col("mean_sentiment") * F.col("good_share") * 2).alias("sentiment"),
        users_ratio.alias("users_ratio"), engaged.alias("engagement"), F.least(F.lit(1.0), words).alias("keyword_emoji"),
        (F.col("mean_square") - F.col("mean_sentiment") * F.col("mean_sentiment")).alias("sentiment_variance"),
    )


def weighed(scores: dict[str, float]) -> Column:
    """Weighted mean of score columns."""
    total = sum(scores.values())
    return sum((F.col(k) * (w / total) for k, w in scores.items()), F.lit(0.0))


def detected(rows: DataFrame, weights: dict[str, float], factor: Column | None = None, least_score: float = 0.1, least_confidence: float = 0.1) -> DataFrame:
    """Rows whose weighted score and agreement of the parts reach the limits, with ``score`` and ``confidence``."""
    score = weighed(weights) * (F.lit(1.0) if factor is None else factor)
    found = rows.withColumn("score", F.least(F.lit(1.0), score)).withColumn("confidence", combined_confidence([F.col(k) for k in weights]))
    return found.where((F.col("score") >= least_score) & (F.col("confidence") >= least_confidence))


def chat_highlights(messages: DataFrame, seconds: float = 30.0, **limits) -> DataFrame:
    """Windows of chat that stand out."""
    windows = with_excitement(with_baselines(window_measures(messages, seconds)))
    return detected(windows, CHAT_WEIGHTS, 1 + COMMUNITY * F.least(F.lit(1.0), F.col("users_all") / 100), **limits)


def top_keywords(messages: DataFrame, limit: int = 10) -> DataFrame:
    """The most frequent keywords of each stream."""
    words = messages.select("stream_id", F.explode(X.keywords(F.col("message"))).alias("word")).groupBy("stream_id", "word").agg(F.count("*").alias("n"))
    nth = F.row_number().over(Window.partitionBy("stream_id").orderBy(F.desc("n"), "word"))
    return words.withColumn("nth", nth).where(F.col("nth") <= limit)


def window_reports(messages: DataFrame, seconds: int = 3600) -> DataFrame:
    """Per stream and fixed window: mean sentiment, its categories, emotes a message, users and a highlight score."""
    found = X.lexicon_sentiment(F.col("message"))
    slim = messages.select("stream_id", "user_id", F.floor(F.col("t") / seconds).cast("long").alias("window"), found.alias("x"), F.size(X.emotes(F.col("message"))).alias("n_emotes"))
    slim = slim.withColumn("category", X.sentiment_category(F.col("x.score"), F.col("x.hype")))
    names = ("very_positive", "positive", "neutral", "negative", "very_negative", "hype")
    per = slim.groupBy("stream_id", "window").agg(
        F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.avg("x.score").alias("sentiment"), F.avg("n_emotes").alias("emote_density"),
        *[F.count_if(F.col("category") == c).alias(c) for c in names],
    )
    return per.withColumn("score", highlight_score(F.col("n") / seconds, F.col("sentiment"), F.col("emote_density"), F.col("hype") / F.col("n")))


def highlight_score(velocity: Column, sentiment: Column, emote_density: Column, hype_share: Column) -> Column:
    one = F.lit(1.0)
    mood = F.least((sentiment + 1) / 2 + 0.3 * hype_share, one)
    return F.least(0.4 * F.least(velocity / 50, one) + 0.3 * mood + 0.3 * F.least(emote_density * 2, one), one)


def top_emotes(messages: DataFrame, limit: int = 5) -> DataFrame:
    """The emotes found in most messages of a stream; the first in the alphabet of equals."""
    found = messages.select("stream_id", F.explode(X.emotes(F.col("message"))).alias("emote")).groupBy("stream_id", "emote").agg(F.count("*").alias("n"))
    nth = F.row_number().over(Window.partitionBy("stream_id").orderBy(F.desc("n"), "emote"))
    return found.withColumn("nth", nth).where(F.col("nth") <= limit)


def aggregate_sentiment(messages: DataFrame) -> DataFrame:
    """Per stream the mean score, magnitude and confidence, its category, its variance and ten of the words found."""
    text = F.col("message")
    slim = messages.select("stream_id", X.lexicon_sentiment(text).alias("x"), X.found_words(text).alias("words"))
    # The words of all messages are among a fixed list, so the set stays small.
    per = slim.groupBy("stream_id").agg(
        F.avg("x.score").alias("score"), F.avg("x.magnitude").alias("magnitude"), F.avg(X.sentiment_confidence(F.col("x.hits"))).alias("confidence"),
        F.var_pop("x.score").alias("variance"), F.array_distinct(F.flatten(F.collect_set("words"))).alias("all_words"),
    )
    return per.withColumn("words", F.slice(F.array_sort("all_words"), 1, 10)).withColumn("category", X.sentiment_category(F.col("score"))).drop("all_words")


def combined_confidence(scores: list[Column]) -> Column:
    """One less the mean deviation from the mean."""
    mean = sum(scores[1:], scores[0]) / len(scores)
    return 1 - F.least(F.lit(1.0), sum((F.abs(s - mean) for s in scores), F.lit(0.0)) / len(scores))


# ---- rules of the sliding analysis ------------------------------------------------------

# Fixed weights of the categories.
CATEGORY_WEIGHTS = {
    "hype": 1.0, "excitement": 0.9, "very_positive": 0.7, "positive": 0.5, "neutral": 0.2, "negative": 0.1, "very_negative": 0.0, "disappointment": 0.1, "surprise": 0.6,
}


def mood_score(category: Column, intensity: Column, confidence: Column, momentum: Column) -> Column:
    weight = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in CATEGORY_WEIGHTS.items() for x in pair]), category), F.lit(0.5))
    base = 0.5 * weight + 0.3 * intensity + 0.2 * confidence
    return F.least(F.lit(1.0), F.when(momentum > 0, base * (1 + 0.2 * momentum)).otherwise(base))


def velocity_score(rate: Column, acceleration: Column, spike: Column, intensity: Column, least: float = 0.3) -> Column:
    base = F.when(spike & (intensity >= least), 0.7 + 0.3 * intensity).otherwise(F.least(rate / 20, F.lit(0.5)))
    return F.least(F.lit(1.0), base + F.when(acceleration > 0, F.least(acceleration / 10, F.lit(0.2))).otherwise(0.0))


def velocities(messages: DataFrame, seconds: int = 3600, spike: float = 2.0) -> DataFrame:
    """Per stream and fixed window with messages: rate, its first, second and third differences, and spikes against the mean so far."""
    per = messages.groupBy("stream_id", F.floor(F.col("t") / seconds).cast("long").alias("window")).agg((F.count("*") / seconds).alias("rate"))
    order = Window.partitionBy("stream_id").orderBy("window")
    step = lambda c: F.coalesce(F.col(c) - F.lag(c).over(order), F.lit(0.0))
    moved = per.withColumn("acceleration", step("rate"))
    moved = moved.withColumn("jerk", step("acceleration"))
    before = F.avg("rate").over(order.rowsBetween(Window.unboundedPreceding, -1))
    ratio = F.coalesce(F.col("rate") / before, F.lit(1.0))
    return moved.withColumn("spike", ratio >= spike).withColumn("intensity", F.least(F.lit(1.0), F.greatest(F.lit(0.0), (ratio - 1) / (2 * spike))))


# Fixed list of the text features.
FEATURE_WORDS = (
    "wow", "amazing", "incredible", "awesome", "epic", "insane", "omg", "poggers", "hype", "clutch", "sick", "fire", "lit", "!!", "!!!", "???",
    "\U0001f4af", "\U0001f525", "\U0001f631", "\U0001f92f", "\U0001f44f",
)


def text_features(messages: DataFrame) -> DataFrame:
    """Per stream: messages, mean characters and words, listed words and emojis a message, share of capitals."""
    text = F.col("message")
    low = F.lower(text)
    found = sum((((F.length(low) - F.length(F.replace(low, F.lit(k), F.lit("")))) / len(k)).cast("int") for k in FEATURE_WORDS), F.lit(0))
    return messages.groupBy("stream_id").agg(
        F.count("*").alias("n"), F.avg(F.length(text)).alias("avg_chars"), F.avg(F.size(X.tokens(text))).alias("avg_words"), F.avg(found).alias("excitement"),
        (F.sum(F.regexp_count(text, F.lit(r"\p{Lu}"))) / F.sum(F.length(text))).alias("capitals"), F.avg(F.regexp_count(text, F.lit(r"[^\x00-\x7F]"))).alias("emojis"),
    )


def chat_content(messages: DataFrame, seconds: int = 3600) -> DataFrame:
    """Per stream and fixed window: messages, mean sentiment, share of excited ones and of those with an emote, score and confidence."""
    x = X.lexicon_sentiment(F.col("message"))
    slim = messages.select("stream_id", F.floor(F.col("t") / seconds).cast("long").alias("window"), x["score"].alias("s"), (x["hype"] > 0.5).cast("double").alias("h"), X.has_dense_emote(F.col("message")).cast("double").alias("e"))
    per = slim.groupBy("stream_id", "window").agg(F.count("*").alias("n"), F.avg("s").alias("sentiment"), F.avg("h").alias("highlight_share"), F.avg("e").alias("emote_density"))
    n = F.col("n")
    score = 0.2 * F.col("sentiment") + 0.3 * F.col("highlight_share") + F.when(n > 50, 0.3).otherwise(0.0) + F.least(n / 100, F.lit(0.2))
    return per.withColumn("score", F.least(score, F.lit(1.0))).withColumn("confidence", F.least(0.7 + n / 100, F.lit(0.95)))


# Fixed weights of the detectors over audio and video.
AUDIO_WEIGHTS = {"volume": 0.35, "keyword": 0.25, "spectral": 0.25, "speech": 0.15}
VIDEO_WEIGHTS = {"motion": 0.4, "scene_change": 0.3, "complexity": 0.3}


def video_content(scene_change: Column, motion: Column, complexity: Column, objects: Column) -> Column:
    return F.least(F.lit(1.0), F.when(scene_change, 0.3).otherwise(0.0) + 0.3 * motion + 0.2 * complexity + F.when(objects, 0.2).otherwise(0.0))


def audio_content(peak: Column, energy: Column, speech: Column, cheers: Column) -> Column:
    return F.least(F.lit(1.0), 0.2 * peak + 0.3 * energy + F.when(speech, 0.2).otherwise(0.0) + F.when(cheers, 0.3).otherwise(0.0))


def chat_content_score(sentiment: Column, highlight_share: Column, messages: Column) -> Column:
    return F.least(F.lit(1.0), 0.2 * sentiment + 0.3 * highlight_share + F.when(messages > 50, 0.3).otherwise(0.0) + F.least(messages / 100, F.lit(0.2)))


def enhanced_score(mood: Column, velocity: Column, impact: Column, confidence: Column, velocity_weight: float = 0.3, impact_weight: float = 0.2) -> Column:
    return (mood * (1 - velocity_weight - impact_weight) + velocity * velocity_weight + impact * impact_weight) * confidence
