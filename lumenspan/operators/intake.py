"""What comes in: transcripts, a model's highlights, registered streams, frames, and rows appended to a written table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenspan.operators import content as N
from lumenspan.operators.detection import AUDIO_WEIGHTS, video_content
from lumenspan.operators.ranking import merged_by_category


def from_transcripts(transcripts: DataFrame, words: Column, longest: float = 10.0) -> DataFrame:
    """Transcript rows (text, start_time, end_time or null) scored by their text alone, as there are no samples.

    The end is ten seconds after the start where it is not given. Null texts count as empty.
    """
    text = F.coalesce("text", F.lit(""))
    placed = transcripts.withColumn("start_time", F.coalesce("start_time", F.lit(0.0)))
    placed = placed.withColumn("end_time", F.coalesce("end_time", F.col("start_time") + longest))
    placed = placed.withColumn("keyword", N.keyword_score(N.spoken_words(text), words)).withColumn("speech", N.speech_score(words, F.col("end_time") - F.col("start_time")))
    return placed.withColumn("score", AUDIO_WEIGHTS["keyword"] * F.col("keyword") + AUDIO_WEIGHTS["speech"] * F.col("speech"))


def unified(highlights: DataFrame, least_score: float = 0.5, least_confidence: float = 0.6, window: float = 10.0) -> DataFrame:
    """A model's highlights weighed by category, kept if good and sure enough, and merged where close and of one category."""
    weights = F.create_map(*[F.lit(x) for pair in N.CATEGORY_WEIGHTS.items() for x in pair])
    weight = F.coalesce(F.try_element_at(weights, F.lower("category")), F.lit(N.CATEGORY_WEIGHTS["general"]))
    kept = highlights.withColumn("score", F.col("score") * weight).where((F.col("score") >= least_score) & (F.col("confidence") >= least_confidence))
    return merged_by_category(kept, window)


def registered(requests: DataFrame) -> DataFrame:
    """One row a stream: format, form of its time stamps, base, and whether it is the reference.

    A later request (by ``at``) replaces an earlier one of the stream. The reference is the
    last stream that asked to be it, or the first one registered if none did.
    """
    last = requests.groupBy("stream_id").agg(F.max_by(F.struct("format", "time_form", "base"), F.struct("at", "request_id")).alias("x"), F.min("at").alias("registered_at"))
    asked = requests.agg(F.max(F.when(F.col("is_reference"), F.struct("at", "request_id", "stream_id"))).alias("asked"), F.min(F.struct("at", "request_id", "stream_id")).alias("first"))
    reference = asked.select(F.coalesce(F.col("asked.stream_id"), F.col("first.stream_id")).alias("reference"))
    return last.crossJoin(F.broadcast(reference)).select("stream_id", "x.*", "registered_at", (F.col("stream_id") == F.col("reference")).alias("is_reference"))


def video_frames(frames: DataFrame, least: float = 0.3) -> DataFrame:
    """Frames of enough quality with features derived from it, their score and confidence."""
    q = F.col("quality")
    rated = frames.where(q >= least).withColumn("scene_change", q > 0.8).withColumn("motion", q * 0.9).withColumn("has_objects", q > 0.7)
    return rated.withColumn("score", video_content(F.col("scene_change"), F.col("motion"), F.lit(0.5), F.col("has_objects"))).withColumn("confidence", F.least(q + 0.1, F.lit(1.0)))


def appended(rows: DataFrame, path: str, key: str) -> DataFrame:
    """Append to the Parquet table at ``path`` the rows whose key it does not hold, each key once, and read it back."""
    spark = rows.sparkSession
    held = spark.read.schema(rows.schema).parquet(path)
    new = rows.where(F.col(key).isNotNull()).dropDuplicates([key]).join(held.select(key), key, "left_anti").select(rows.columns)
    new.write.mode("append").parquet(path)
    return spark.read.schema(rows.schema).parquet(path)
