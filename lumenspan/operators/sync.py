"""Segments of frames, time lines of several sources, impacts, milestones and memories."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenspan.functions import text as X
from lumenspan.operators.scans import recurrence
from lumenspan.operators.states import streams_near
from lumenspan.operators.temporal import band_join, fold_by, islands, opened

# Fixed values of time stamps, offsets and milestones.
SCALES = {"epoch_seconds": 1.0, "epoch_millis": 0.001, "relative_seconds": 1.0, "rtmp_timestamp": 0.001}
BASED = ("relative_seconds", "rtmp_timestamp")
CHAT_OFFSETS = {"twitch": -2.0, "youtube": -1.5}
MILESTONES = (5, 15, 30, 45, 60, 75, 85, 95, 100)


# ---- time stamps -------------------------------------------------------------------------


def converted(t: Column, scale: Column, offset: Column, drift: Column | float = 0.0, elapsed: Column | float = 0.0) -> Column:
    return t * scale + offset + drift * elapsed


def epoch_seconds(t: Column, form: Column, base: Column) -> Column:
    """A time stamp of a named form in seconds since 1970; unknown forms stay as they are."""
    scale = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in SCALES.items() for x in pair]), form), F.lit(1.0))
    return converted(t, scale, F.when(form.isin(*BASED), base).otherwise(0.0))


def corrected(t: Column, drift: Column, elapsed: Column) -> Column:
    return t - drift * elapsed


def video_time(t: Column, platform: Column, live: Column) -> Column:
    """The time in the video of a chat message: live chats run ahead by a fixed offset of their platform."""
    offset = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in CHAT_OFFSETS.items() for x in pair]), platform), F.lit(0.0))
    return t + F.when(live, offset).otherwise(0.0)


def merged_close(highlights: DataFrame, gap: float = 2.0) -> DataFrame:
    """Highlights no more than ``gap`` apart as one: hull, best confidence, messages added up."""
    found = islands(highlights, ["stream_id"], "start_time", "end_time", "id", gap)
    return found.groupBy("stream_id", "island").agg(F.min("start_time").alias("start_time"), F.max("end_time").alias("end_time"), F.max("confidence").alias("confidence"), F.sum("messages").alias("messages")).drop("island")


def correlated(highlights: DataFrame, within: float) -> DataFrame:
    """Highlights with the number of other streams that have one starting within ``within`` seconds."""
    found = streams_near(highlights.select("id", "stream_id", "start_time"), "start_time", within, strict=False)
    return found.where("n_near > 0").select("id", F.col("n_near").alias("streams"))


# ---- segments of frames ------------------------------------------------------------------


def segments(frames: DataFrame, seconds: float) -> DataFrame:
    """Fixed segments: frames, keyframes and their first place, mean quality of the frames that have one, bytes."""
    order = Window.partitionBy("stream_id", "segment").orderBy("t", "frame_id")
    placed = frames.withColumn("segment", F.floor(F.col("t") / seconds).cast("long")).withColumn("place", F.row_number().over(order) - 1)
    quality = F.coalesce(F.avg(F.when(F.col("quality") > 0, F.col("quality"))), F.lit(1.0))
    return placed.groupBy("stream_id", "segment").agg(
        F.count("*").alias("n"), F.count_if("is_keyframe").alias("keyframes"), F.min(F.when(F.col("is_keyframe"), F.col("place"))).alias("first_keyframe"),
        quality.alias("quality"), F.sum("size_bytes").alias("bytes"), F.min("t").alias("start_time"), F.max("t").alias("end_time"),
    )


def keyframe_segments(frames: DataFrame, fewest: int = 30, most: int = 900, longest: float = 30.0, without: int = 3) -> DataFrame:
    """Segments cut at a second that has a keyframe once there are enough frames, or after too many frames, seconds or cuts without one.

    Seconds with frames are taken in order; a cut closes the segment with that second.
    """
    seconds = frames.groupBy("stream_id", F.floor("t").cast("long").alias("second")).agg(F.count("*").alias("n"), F.max(F.col("is_keyframe").cast("int")).alias("key"))

    def step(state, row):
        start, count, missed = (row["second"], 0, 0) if state is None else state
        count += row["n"]
        found = bool(row["key"]) and count >= fewest
        cut = found or count >= most or row["second"] - start >= longest or missed >= without
        if not cut:
            return (start, count, missed), []
        missed = 0 if found else missed + (not row["key"])
        return (row["second"] + 1, 0, missed), [{"stream_id": row["stream_id"], "start_time": float(start), "end_time": float(row["second"] + 1), "n": count}]

    return fold_by(seconds, ["stream_id"], ["second"], step, "stream_id long, start_time double, end_time double, n long")


def running_means(found: DataFrame, alpha: float = 0.1) -> DataFrame:
    """Per stream the running means of length and frames after each segment, from 0 on."""
    rows = found.select("stream_id", "segment", "n", "start_time", "end_time")
    kept = lambda value: (F.lit(1 - alpha), alpha * value)
    rows = recurrence(rows, ["stream_id"], ["segment"], *kept(F.col("end_time") - F.col("start_time")), "avg_length", "mean-length").drop("nth")
    rows = recurrence(rows, ["stream_id"], ["segment"], *kept(F.col("n")), "avg_frames", "mean-frames")
    return rows.select("stream_id", "segment", "avg_length", "avg_frames")


def frame_windows(frames: DataFrame, size: float, slide: float) -> DataFrame:
    """Hopping windows of frames by the seconds of a stream."""
    last = F.floor(F.col("t") / slide).cast("long")
    first = (F.floor((F.col("t") - size) / slide) + 1).cast("long")
    spread = frames.withColumn("window", F.explode(F.sequence(F.greatest(first, F.lit(0).cast("long")), last)))
    return spread.groupBy("stream_id", (F.col("window") * slide).alias("start_time")).agg(F.count("*").alias("n"), F.count_if("is_keyframe").alias("keyframes"), F.avg("quality").alias("quality"))


def thinned(frames: DataFrame, most: int = 300) -> DataFrame:
    """Every k-th frame of a stream, k being its frames by ``most``, rounded down, where it has more."""
    n = F.count("*").over(Window.partitionBy("stream_id"))
    place = F.row_number().over(Window.partitionBy("stream_id").orderBy("t", "frame_id")) - 1
    return frames.withColumn("n_", n).withColumn("place_", place).where((F.col("n_") <= most) | (F.col("place_") % F.greatest(F.floor(F.col("n_") / most), F.lit(1)) == 0)).drop("n_", "place_")


def window_groups(rows: DataFrame, at: str, tie: str, seconds: float, measures: list[Column], strict: bool = False) -> DataFrame:
    """Windows that open with a row and close ``seconds`` after it, with measures."""
    found = opened(rows, ["stream_id"], at, tie, seconds, strict)
    return found.groupBy("stream_id", F.col("opened").alias("start_time")).agg(F.max(at).alias("end_time"), *measures)


# ---- impacts, emotes, milestones, memory -----------------------------------------------------


def impacts(events: DataFrame) -> DataFrame:
    """Raids and cheers with their impact: full from a hundred viewers on, up to 0.8 by a thousand bits."""
    score = F.when(F.col("kind") == "raid", F.least(F.lit(1.0), F.col("amount") / 100)).otherwise(0.8 * F.least(F.lit(1.0), F.col("amount") / 1000))
    return events.withColumn("impact", score)


def impact_at(rows: DataFrame, events: DataFrame, seconds: float = 120.0) -> DataFrame:
    """Per row the impacts of the ``seconds`` before it, each falling off evenly, at most 1 together."""
    past = impacts(events).select("stream_id", F.col("t").alias("event_t"), "impact")
    pairs = band_join(rows, past, ["stream_id"], "t", "event_t", seconds, strict=True).where("event_t <= t")
    total = F.sum(F.col("impact") * (1 - (F.col("t") - F.col("event_t")) / seconds))
    return pairs.groupBy("event_id").agg(F.least(F.lit(1.0), total).alias("impact"))


def learned_emotes(messages: DataFrame, fewest: int = 3) -> DataFrame:
    """Emotes with the mean sentiment of the messages that hold them, if there are enough."""
    text = F.col("message")
    held = messages.select(F.explode(X.emotes(text)).alias("emote"), X.lexicon_sentiment(text)["score"].alias("score"))
    found = held.groupBy("emote").agg(F.count("*").alias("n"), F.avg("score").alias("value")).where(F.col("n") >= fewest)
    return found.withColumn("category", X.sentiment_category(F.col("value")))


def milestones_reached(updates: DataFrame, key: str, order: list[str], percent: str) -> DataFrame:
    """Each milestone once, with the update that first reached it."""
    seen = Window.partitionBy(key).orderBy(*order)
    before = F.coalesce(F.max(percent).over(seen.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1.0))
    new = F.filter(F.array(*[F.lit(m) for m in MILESTONES]), lambda m: (m > F.col("before_")) & (m <= F.col(percent)))
    return updates.withColumn("before_", before).withColumn("milestone", F.explode(new)).drop("before_")


def recent_memory(rows: DataFrame, seconds: float = 300.0) -> DataFrame:
    """The rows of a stream within ``seconds`` of its last one."""
    last = F.max("t").over(Window.partitionBy("stream_id"))
    return rows.withColumn("last_", last).where(F.col("t") >= F.col("last_") - seconds).drop("last_")


def last_descriptions(rows: DataFrame, n: int = 3) -> DataFrame:
    """Per stream the last ``n`` descriptions in order of time, joined."""
    nth = F.row_number().over(Window.partitionBy("stream_id").orderBy(F.desc("start_time"), F.desc("id")))
    last = rows.withColumn("nth", nth).where(F.col("nth") <= n)
    pairs = F.array_sort(F.collect_list(F.struct(-F.col("nth"), "description")))
    return last.groupBy("stream_id").agg(F.array_join(F.transform(pairs, lambda x: x["description"]), " | ").alias("context"))


def parsed_events(rows: DataFrame, column: str, schema: str) -> DataFrame:
    """Rows with the fields of a JSON column; rows that don't parse are left out."""
    return rows.withColumn("event_", F.from_json(column, schema)).where(F.col("event_").isNotNull()).select("*", "event_.*").drop("event_")


# ---- pluggable detectors -------------------------------------------------------------------

Detector = Callable[[DataFrame], DataFrame]


class Detectors:
    """Detectors by name: functions from segments to rows (segment, score, confidence)."""

    def __init__(self) -> None:
        self.known: dict[str, Detector] = {}

    def register(self, name: str) -> Callable[[Detector], Detector]:
        def add(f: Detector) -> Detector:
            self.known[name] = f
            return f

        return add

    def detect(self, found_in: DataFrame, names: list[str] | None = None) -> DataFrame:
        """The results of all named detectors, with the detector's name."""
        out = None
        for name in names or sorted(self.known):
            some = self.known[name](found_in).select("segment", "score", "confidence", F.lit(name).alias("detector"))
            out = some if out is None else out.unionByName(some)
        return out


def each_segment(rows: DataFrame, measure: Callable[[pd.Series], dict], schema: str) -> DataFrame:
    """``measure`` applied to each row in Arrow batches; rows on which it fails are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                try:
                    out.append(measure(row))
                except Exception:  # noqa: BLE001 - a failing segment must not stop the others
                    continue
            if out:
                yield pd.DataFrame(out)

    return rows.mapInPandas(run, schema)


def chunks(segments_: DataFrame, seconds: float) -> DataFrame:
    """Segments cut into chunks of equal length, the last one shorter."""
    n = F.ceil((F.col("end_time") - F.col("start_time")) / seconds).cast("int")
    spread = segments_.where(n > 0).withColumn("chunk", F.explode(F.sequence(F.lit(0), n - 1)))
    end = F.least("end_time", F.col("start_time") + (F.col("chunk") + 1) * seconds)
    return spread.withColumn("end_time", end).withColumn("start_time", F.col("start_time") + F.col("chunk") * seconds)
