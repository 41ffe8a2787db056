"""Segments of a stream's frames: batch forms over whole tables and live forms with keyed state.

Frames are rows (stream_id, frame_id, t, is_keyframe, quality) with t in seconds; adaptive
segments also read motion, scene and audio. A stream that shows no frame for ``idle``
seconds has ended, and what is open becomes its last segment; a later frame starts anew.

The live forms keep, for each stream, the frames above the watermark and one small state.
A timer of event time fires when a slot of frames is complete; frames are then taken in
order, so the result does not depend on the order of arrival, and a restart goes on from
the checkpoint. Rows behind the watermark are dropped, as everywhere in Spark.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType
from pyspark.sql.window import Window

#: Digits to which complexities are rounded, so that all forms compare the same numbers.
DIGITS = 9


@dataclass(frozen=True)
class Rules:
    """How adaptive segments are cut; seconds, frames, and the complexity above which they are shortest."""

    slot: float = 0.5
    fewest: int = 30
    most: int = 900
    shortest: float = 5.0
    longest: float = 30.0
    target: float = 0.5
    history: int = 100
    idle: float = 60.0


# ---- batch ---------------------------------------------------------------------------------


def runs(frames: DataFrame, idle: float) -> DataFrame:
    """``frames`` with ``run``: the stretch of the stream, between pauses of more than ``idle`` seconds, that they lie in.

    A pause can only lie between buckets of ``idle`` seconds, so runs are found on one row
    a bucket, and the frames of a long stream are spread over its runs.
    """
    placed = frames.withColumn("bucket_", F.floor(F.col("t") / idle).cast("long"))
    buckets = placed.groupBy("stream_id", "bucket_").agg(F.min("t").alias("first_"), F.max("t").alias("last_"))
    order = Window.partitionBy("stream_id").orderBy("bucket_")
    opens = F.coalesce(F.col("first_") - F.lag("last_").over(order) > idle, F.lit(True))
    buckets = buckets.withColumn("opens_", opens).withColumn("run", F.count_if("opens_").over(order))
    return placed.join(buckets.select("stream_id", "bucket_", "run"), ["stream_id", "bucket_"]).drop("bucket_")


def measured_slots(frames: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """One row a slot that has frames: their number, and complexity and boundary as of its last frame."""
    keys = ["stream_id", "run"]
    order = Window.partitionBy(*keys).orderBy("t", "frame_id")
    held, five, three = (order.rowsBetween(1 - n, 0) for n in (rules.history, 5, 3))
    spread = lambda c, scale: F.least(F.var_pop(c).over(held) * scale, F.lit(1.0))
    changes = F.avg((F.col("scene") > 0.5).cast("double")).over(held)
    complexity = F.round(F.least(0.4 * spread("motion", 10) + 0.4 * changes + 0.2 * spread("audio", 5), F.lit(1.0)), DIGITS)
    seen = F.row_number().over(order)
    lull = (seen >= 5) & (F.max("motion").over(five) < 0.3)
    boundary = (seen >= 3) & ((F.max("scene").over(three) > 0.8) | lull)
    rated = runs(frames, rules.idle).withColumn("slot", F.floor(F.col("t") / rules.slot).cast("long")).withColumn("complexity", complexity).withColumn("boundary", boundary)
    last = F.struct("t", "frame_id", "complexity", "boundary")
    good = F.col("quality") > 0
    found = rated.groupBy(*keys, "slot").agg(F.count("*").alias("n"), F.count_if("is_keyframe").alias("keyframes"), F.sum(F.when(good, F.col("quality"))).alias("quality_sum"), F.count_if(good).alias("quality_n"), F.max(last).alias("last"))
    return found.select(*keys, "slot", "n", "keyframes", "quality_sum", "quality_n", "last.complexity", "last.boundary")


def target_length(complexity, rules: Rules):
    """Seconds after which a segment of this complexity is cut."""
    share = 1 - complexity / rules.target
    return np.where(complexity > rules.target, rules.shortest, rules.shortest + (rules.longest - rules.shortest) * share)


def _opened(rules: Rules, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slots sorted by stream, run and time get ``opened`` (start of their segment) and ``closes`` (they end it).

    From one opening to the next the cut is searched in stretches that grow, so only the
    open segment's start and frames are carried.
    """
    current, start, held = None, 0.0, 0
    for batch in batches:
        stream, run, slot, n, complexity, boundary = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("stream_id", "run", "slot", "n", "complexity", "boundary"))
        at = slot * rules.slot
        target = target_length(complexity, rules)
        size = len(at)
        opened, closes = np.empty(size), np.zeros(size, dtype=bool)
        changes = np.flatnonzero((stream[1:] != stream[:-1]) | (run[1:] != run[:-1])) + 1
        for lo, hi in zip([0, *changes], [*changes, size], strict=True):
            if lo == hi:
                continue
            if (stream[lo], run[lo]) != current:
                current, start, held = (stream[lo], run[lo]), at[lo], 0
            i = lo
            while i < hi:
                step, cut = 64, None
                j = i
                while j < hi and cut is None:
                    end = min(j + step, hi)
                    frames = held + np.cumsum(n[j:end])
                    due = ((at[j:end] - start >= target[j:end]) | boundary[j:end] | (frames >= rules.most)) & (frames >= rules.fewest)
                    if due.any():
                        cut = j + int(due.argmax())
                    else:
                        held = int(frames[-1])
                        j, step = end, step * 2
                stop = hi if cut is None else cut + 1
                opened[i:stop] = start
                if cut is not None:
                    closes[cut], start, held = True, at[cut], 0
                i = stop
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(opened), pa.array(closes)], names=[*batch.schema.names, "opened", "closes"])


def adaptive(frames: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Segments whose length follows the complexity of the last frames: rows (stream_id, start_time, end_time, n, keyframes, quality, complexity)."""
    slots = measured_slots(frames, rules)
    dealt = slots.repartition("stream_id", "run").sortWithinPartitions("stream_id", "run", "slot")
    schema = StructType([*slots.schema.fields, StructField("opened", DoubleType()), StructField("closes", BooleanType())])
    found = dealt.mapInArrow(lambda batches: _opened(rules, batches), schema)
    # Two segments may open at one time if a run's first slot is cut at once; the cut slot tells them apart.
    cut = F.col("closes") & (F.col("slot") * rules.slot == F.col("opened"))
    grouped = found.groupBy("stream_id", "run", F.col("opened").alias("start_time"), cut.alias("at_once")).agg(
        F.max("closes").alias("closed"),
        F.max(F.struct("slot", "complexity")).alias("last"),
        F.sum("n").alias("n"),
        F.sum("keyframes").alias("keyframes"),
        F.sum("quality_sum").alias("quality_sum"),
        F.sum("quality_n").alias("quality_n"),
    )
    end = F.col("last.slot") * rules.slot + F.when(F.col("closed"), 0.0).otherwise(rules.slot)
    quality = F.when(F.col("quality_n") > 0, F.col("quality_sum") / F.col("quality_n")).otherwise(1.0)
    return grouped.select("stream_id", "start_time", end.alias("end_time"), "n", "keyframes", quality.alias("quality"), F.when(F.col("closed"), F.col("last.complexity")).otherwise(0.5).alias("complexity"))


# ---- live ----------------------------------------------------------------------------------

SEGMENT = "stream_id long, start_time double, end_time double, n long, keyframes long, quality double, complexity double, avg_length double, avg_frames double"


class Machine:
    """Takes the frames of one stream in order, slot by slot, and gives the segments that are complete.

    ``slot`` is the length of a slot in seconds and ``idle`` the pause after which an open
    segment ends (None: never). The state is a dictionary of plain values.
    """

    slot: float
    idle: float | None = None

    def take(self, state: dict, slot: int, frames: pd.DataFrame) -> list[dict]:
        raise NotImplementedError

    def close(self, state: dict) -> list[dict]:
        """The segment still open when the stream ends; the state is emptied."""
        return []


def _add(state: dict, frames: pd.DataFrame) -> None:
    good = frames["quality"][frames["quality"] > 0]
    state["n"] = state.get("n", 0) + len(frames)
    state["keyframes"] = state.get("keyframes", 0) + int(frames["is_keyframe"].sum())
    state["quality_sum"] = state.get("quality_sum", 0.0) + float(good.sum())
    state["quality_n"] = state.get("quality_n", 0) + len(good)


def _emit(state: dict, start: float, end: float, complexity: float, alpha: float = 0.1) -> dict:
    """The segment of a state's sums, and the running means of length and frames after it."""
    n, quality_n, quality_sum = state.pop("n"), state.pop("quality_n"), state.pop("quality_sum")
    quality = quality_sum / quality_n if quality_n else 1.0
    means = state.get("means", [0.0, 0.0])
    state["means"] = [alpha * (end - start) + (1 - alpha) * means[0], alpha * n + (1 - alpha) * means[1]]
    return {"start_time": start, "end_time": end, "n": n, "keyframes": state.pop("keyframes"), "quality": quality, "complexity": complexity, "avg_length": state["means"][0], "avg_frames": state["means"][1]}


class Adaptive(Machine):
    """The live form of ``adaptive``."""

    def __init__(self, rules: Rules = Rules()):
        self.rules, self.slot, self.idle = rules, rules.slot, rules.idle

    def take(self, state, slot, frames):
        rules, at = self.rules, slot * self.slot
        state.setdefault("start", at)
        _add(state, frames)
        ring = {c: (state.get(c, []) + frames[c].tolist())[-rules.history :] for c in ("motion", "scene", "audio")}
        state.update(ring, slot=slot)
        motion, scene, audio = (np.array(ring[c]) for c in ("motion", "scene", "audio"))
        value = 0.4 * min(motion.var() * 10, 1.0) + 0.4 * (scene > 0.5).mean() + 0.2 * min(audio.var() * 5, 1.0)
        complexity = round(min(float(value), 1.0), DIGITS)
        boundary = len(scene) >= 3 and (bool((scene[-3:] > 0.8).any()) or (len(motion) >= 5 and bool((motion[-5:] < 0.3).all())))
        due = at - state["start"] >= float(target_length(complexity, rules)) or boundary or state["n"] >= rules.most
        if not due or state["n"] < rules.fewest:
            return []
        found = _emit(state, state["start"], at, complexity)
        state["start"] = at
        return [found]

    def close(self, state):
        found = [_emit(state, state["start"], (state["slot"] + 1) * self.slot, 0.5)] if state.get("n") else []
        means = state.get("means")
        state.clear()
        if means:
            state["means"] = means
        return found


class Fixed(Machine):
    """Segments of equal length, from the first frame in one to the last."""

    def __init__(self, seconds: float = 10.0):
        self.slot, self.idle = seconds, None

    def take(self, state, slot, frames):
        _add(state, frames)
        return [_emit(state, float(frames["t"].iloc[0]), float(frames["t"].iloc[-1]), 0.5)]


class Keyframe(Machine):
    """Segments cut at a second with a keyframe once there are enough frames, or after too many frames, seconds or cuts without one."""

    def __init__(self, fewest: int = 30, most: int = 900, longest: float = 30.0, without: int = 3):
        self.slot, self.idle = 1.0, None
        self.fewest, self.most, self.longest, self.without = fewest, most, longest, without

    def take(self, state, slot, frames):
        start, missed = state.setdefault("start", slot), state.get("missed", 0)
        _add(state, frames)
        key = bool(frames["is_keyframe"].any())
        found = key and state["n"] >= self.fewest
        if not (found or state["n"] >= self.most or slot - start >= self.longest or missed >= self.without):
            return []
        state.update(start=slot + 1, missed=0 if found else missed + (not key))
        return [_emit(state, float(start), float(slot + 1), 0.5)]


class ResetWindows(Machine):
    """Windows that open with a row and close with the first one ``seconds`` after it; they end with their last row."""

    def __init__(self, seconds: float = 30.0):
        self.slot, self.idle, self.seconds = 1.0, seconds, seconds

    def take(self, state, slot, frames):
        out = []
        for i, t in enumerate(frames["t"].tolist()):
            if "start" in state and t - state["start"] >= self.seconds:
                out += self.close(state)
            state.setdefault("start", t)
            state["end"] = t
            _add(state, frames.iloc[i : i + 1])
        return out

    def close(self, state):
        return [_emit(state, state.pop("start"), state.pop("end"), 0.5)] if state.get("n") else []


def machine(strategy: str, **options) -> Machine:
    """The machine of a named strategy. Scenes are cut as adaptive segments are, events as fixed ones."""
    known = {"fixed_duration": Fixed, "event_driven": Fixed, "keyframe_based": Keyframe, "adaptive": Adaptive, "scene_based": Adaptive, "reset_windows": ResetWindows}
    if strategy not in known:
        raise ValueError(f"unknown strategy: {strategy}")
    return known[strategy](**options)


_FRAME = ("t", "frame_id", "is_keyframe", "quality", "motion", "scene", "audio")
_PENDING = "t double, frame_id long, is_keyframe boolean, quality double, motion double, scene double, audio double"


class _Live(StatefulProcessor):
    """Holds back the frames of slots that the watermark has not passed."""

    def __init__(self, machine_: Machine):
        self.machine = machine_

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", _PENDING)
        self.open = handle.getValueState("open", "state string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for frame in rows:
            if not len(frame):
                continue
            self.pending.appendList(list(frame[list(_FRAME)].itertuples(index=False, name=None)))
            slot = int(np.floor(frame["t"].min() / self.machine.slot))
            first = slot if first is None else min(first, slot)
        if first is not None:
            self._wake_after(first)
        return iter(())

    def _wake_after(self, slot: int) -> None:
        """One timer, at the end of the first slot held back: a call takes all that are complete then and sets the next."""
        self.handle.registerTimer(math.ceil((slot + 1) * self.machine.slot * 1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        upto = timerValues.getCurrentWatermarkInMs() / 1000
        held = self.open.get() if self.open.exists() else None
        state = json.loads(held[0]) if held else {}
        out: list[dict] = []
        pending = pd.DataFrame(list(self.pending.get()) if self.pending.exists() else [], columns=list(_FRAME))
        if len(pending):
            pending["slot"] = np.floor(pending["t"].astype("float64") / self.machine.slot).astype("int64")
            complete = (pending["slot"] + 1) * self.machine.slot <= upto
            ready = pending[complete].sort_values(["t", "frame_id"])
            rest = pending[~complete][list(_FRAME)]
            if len(rest):
                self.pending.put(list(rest.itertuples(index=False, name=None)))
                self._wake_after(int(pending.loc[~complete, "slot"].min()))
            else:
                self.pending.clear()
            for slot, frames in ready.groupby("slot", sort=True):
                out += self._taken(state, int(slot), frames)
        idle = self.machine.idle
        if idle is not None and "seen" in state:
            if upto > state["seen"] + idle:
                out += self.machine.close(state)
                state.pop("seen", None)
            else:
                self.handle.registerTimer(math.floor((state["seen"] + idle) * 1000) + 1)
        if state:
            self.open.update((json.dumps(state),))
        elif held:
            self.open.clear()
        if out:
            yield pd.DataFrame(out).assign(stream_id=key[0])[[c.split()[0] for c in SEGMENT.split(", ")]]

    def _taken(self, state: dict, slot: int, frames: pd.DataFrame) -> list[dict]:
        """The slot's frames, split where the stream has paused within it."""
        out: list[dict] = []
        idle = self.machine.idle
        if idle is not None and "seen" in state and frames["t"].iloc[0] - state["seen"] > idle:
            out += self.machine.close(state)
        out += self.machine.take(state, slot, frames)
        state["seen"] = float(frames["t"].iloc[-1])
        return out

    def close(self) -> None:
        pass


def live(frames: DataFrame, machine_: Machine, delay: str = "10 seconds") -> DataFrame:
    """Segments of a streaming DataFrame of frames as soon as the watermark, ``delay`` behind the latest frame, has passed them.

    Needs the RocksDB state store (``with_state_store``). Rows as in ``SEGMENT``; running
    means over the segments of a stream come with each. Without motion, scene or audio
    frames count as 0.5, 0 and 0.5.
    """
    defaults = {"is_keyframe": F.lit(False), "quality": F.lit(1.0), "motion": F.lit(0.5), "scene": F.lit(0.0), "audio": F.lit(0.5)}
    filled = frames.select("stream_id", "t", "frame_id", *((F.coalesce(F.col(c), v) if c in frames.columns else v).alias(c) for c, v in defaults.items()), F.timestamp_micros(F.round(F.col("t") * 1_000_000).cast("long")).alias("at"))
    return filled.withWatermark("at", delay).groupBy("stream_id").transformWithStateInPandas(_Live(machine_), SEGMENT, "append", "eventTime")


STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def drained(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Run a streaming DataFrame over what its source holds now, into Parquet at ``path``; a second call goes on from the checkpoint."""
    spark = stream.sparkSession
    before = {k: spark.conf.get(k, None) for k in STATE_STORE}
    try:
        for k, v in STATE_STORE.items():
            spark.conf.set(k, v)
        stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def good_segments(found: DataFrame, least: float = 0.3) -> DataFrame:
    """Segments of enough quality."""
    return found.where(F.col("quality") >= least)
