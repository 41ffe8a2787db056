"""Chat messages share texts; what is measured on the text alone is measured once on each."""

import pytest
from pyspark.sql import functions as F

from lumenspan.operators import detection as D
from lumenspan.plans import registry
from lumenspan.sources import tables as T

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def crowded(spark, tmp_path_factory):
    """A folder with few texts and many events."""
    folder = str(tmp_path_factory.mktemp("crowded"))
    spark.range(3000).select(
        F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id") * 40 + 1704067200).cast("timestamp_ntz").alias("ts"), (F.col("id") % 60).alias("user_id"),
        F.lit("view").alias("event_type"), F.lit(1.0).alias("value"), F.format_string('{"k": %d}', F.col("id") % 37).alias("props"),
    ).write.parquet(f"{folder}/events.parquet")
    for name, few in (("documents", "doc_id < 5"), ("conversations", "conv_id < 2")):
        spark.read.parquet(f"{SF}/{name}.parquet").where(few).write.parquet(f"{folder}/{name}.parquet")
    return folder


@pytest.mark.parametrize("many_events", [True, False])
def test_parts_are_the_messages(spark, crowded, many_events):
    folder = crowded if many_events else SF
    sent, texts = T.chat_parts(spark, folder)
    whole = T.chat_messages(spark, folder)
    joined = sent.join(texts, "message_id").select(whole.columns)
    assert sorted(map(str, joined.collect())) == sorted(map(str, whole.collect()))
    assert texts.agg(F.sum("n_messages")).first()[0] == whole.count()
    if many_events:
        assert texts.count() < whole.count() / 5


def uses(df, function):
    return df._jdf.queryExecution().optimizedPlan().toString().count(function)


def test_spoken_words_are_one_pattern_on_each_text(spark, crowded):
    """fifty patterns were run over every message."""
    assert uses(registry.queries()["h29_speech_keywords"](spark, crowded), "regexp_count") <= 2


def test_words_of_emotions_are_split_once(spark, crowded):
    """the words of a message were cleaned and split anew for each use of each emotion."""
    assert uses(registry.queries()["h15_emotions"](spark, crowded), "regexp_extract_all") == 1


def test_analysis_splits_words_a_few_times(spark, crowded):
    """as for the emotions alone; Spark still repeats the split in the plan eight times."""
    assert uses(registry.queries()["h20_message_analysis"](spark, crowded), "regexp_extract_all") <= 8


def measured(spark, folder):
    sent, texts = T.chat_parts(spark, folder)
    assert "message" not in sent.columns
    return sent.join(D.measured_texts(texts, "message_id"), "message_id")


def test_windows_from_texts_measured_once(spark, crowded):
    """sentiment and spam were measured on every message."""
    names = ["stream_id", "start_time", "n", "users_all", "mean_sentiment", "good_share", "word_density", "emoji_density"]
    ours = D.window_measures(measured(spark, crowded), 1800.0).select(names)
    theirs = D.window_measures(T.chat_messages(spark, crowded), 1800.0).select(names)
    plain = lambda df: sorted(tuple(round(x, 9) for x in r) for r in df.collect())
    assert plain(ours) == plain(theirs)


def test_highlights_from_texts_measured_once(spark, crowded):
    """the chat detector measured every message."""
    plain = lambda df: sorted((r["stream_id"], r["start_time"], round(r["score"], 9), round(r["confidence"], 9)) for r in df.collect())
    ours, theirs = D.chat_highlights(measured(spark, crowded), 1800.0), D.chat_highlights(T.chat_messages(spark, crowded), 1800.0)
    assert plain(ours) == plain(theirs) != []


def test_topics_of_weighted_texts(spark):
    """every message was split, counted and fitted; equal ones now come once, with their number."""
    from lumenspan.operators import content as N

    texts = [("goal match striker", 3), ("striker goal referee", 2), ("pizza oven cheese", 4), ("cheese oven flour", 2)]
    once = spark.createDataFrame([(i, m, n) for i, (m, n) in enumerate(texts)], "id long, message string, weight long")
    plain = lambda df: sorted((r["n"], tuple(sorted(r["keywords"]))) for r in df.collect())
    each = spark.createDataFrame([(i, m) for i, m in enumerate(m for m, n in texts for _ in range(n))], "id long, message string")
    found = plain(N.topics(once, clusters=2))
    assert [n for n, _ in found] == [5, 6]
    assert [n for n, _ in plain(N.topics(each, clusters=2))] == [5, 6]
    # "referee", in one text twice over, is in two texts.
    assert "referee" in {w for _, words in found for w in words}
