"""Windows, intake and retention: each form works on batch and streaming DataFrames alike.

Event time is the timestamp column ``ts``; the test tables hold it without a zone, and
``event_time`` reads it as UTC so that watermarks accept it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def event_time(df: DataFrame, column: str = "ts") -> DataFrame:
    return df.withColumn(column, F.convert_timezone(F.lit("UTC"), F.current_timezone(), F.col(column)).cast("timestamp"))


def watermarked(df: DataFrame, delay: str = "10 minutes", column: str = "ts") -> DataFrame:
    """Late rows are waited for this long; no effect on batch tables."""
    return df.withWatermark(column, delay)


def _counts(grouped, value: str) -> DataFrame:
    return grouped.agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.max(value).alias("most"))


def tumbling(df: DataFrame, size: str = "10 seconds", keys: tuple[str, ...] = (), value: str = "value", start: str = "0 seconds") -> DataFrame:
    return _counts(df.groupBy(F.window("ts", size, startTime=start).alias("window"), *keys), value)


def hopping(df: DataFrame, size: str = "10 seconds", slide: str = "8 seconds", keys: tuple[str, ...] = (), value: str = "value") -> DataFrame:
    return _counts(df.groupBy(F.window("ts", size, slide).alias("window"), *keys), value)


def sessions(df: DataFrame, gap: str = "30 minutes", keys: tuple[str, ...] = ("user_id",), value: str = "value") -> DataFrame:
    return _counts(df.groupBy(F.session_window("ts", gap).alias("window"), *keys), value)


def busy(windows: DataFrame, fewest: int = 5) -> DataFrame:
    return windows.where(F.col("n") >= fewest)


def once(df: DataFrame, keys: tuple[str, ...] = ("event_id", "platform"), streaming_delay: str | None = None) -> DataFrame:
    """Each event of a platform once, as webhooks may be delivered again."""
    if streaming_delay and df.isStreaming:
        return df.withWatermark("ts", streaming_delay).dropDuplicatesWithinWatermark(list(keys))
    return df.dropDuplicates(list(keys))


def retained(frames: DataFrame, now: Column, seconds: float = 300.0, more_for_keyframes: float = 60.0, fewest: int = 100) -> DataFrame:
    """Frames that a buffer keeps: the oldest go while they are older than ``seconds`` (keyframes longer), the first that stays ends it, and ``fewest`` remain."""
    age = now - F.col("t")
    old = age > F.when(F.col("is_keyframe"), seconds + more_for_keyframes).otherwise(seconds)
    # The place from which a stream is kept: its first frame that isn't old, or its last ones. Of each
    # stream only so many rows of a task are sorted, and the places are joined back.
    place = F.struct("t", "frame_id")
    last = Window.partitionBy("stream_id").orderBy(F.desc("t"), F.desc("frame_id"))
    final = frames.select("stream_id", "t", "frame_id").withColumn("nth_", F.row_number().over(last)).where(F.col("nth_") <= fewest)
    fresh = frames.where(~old).select("stream_id", "t", "frame_id")
    from_ = final.drop("nth_").unionByName(fresh).groupBy("stream_id").agg(F.min(place).alias("from_"))
    return frames.join(from_, "stream_id").where(place >= F.col("from_")).select(frames.columns)


def latest(df: DataFrame, key: str, order: str, payload: list[str]) -> DataFrame:
    """The last state of each key."""
    return df.groupBy(key).agg(F.max_by(F.struct(*payload), F.struct(order, *payload)).alias("x")).select(key, "x.*")
