"""Measures of small grey frames held as arrays of pixels, row by row, from 0 to 255.

Each frame is compared with the one before it in its stream, which a window puts beside
it; the arithmetic is NumPy on Arrow batches, one frame at a time in memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BINS, BLOCK, EDGE, CUT = 16, 8, 0.1, 0.7
MEASURES = ("motion", "scene_change", "color_change", "correlation", "edge_density", "variance", "quality")


def histogram(grey: np.ndarray, bins: int = BINS) -> np.ndarray:
    counts, _ = np.histogram(grey, bins=bins, range=(0, 255))
    return counts / max(1, counts.sum())


def block_motion(grey: np.ndarray, before: np.ndarray, block: int = BLOCK) -> float:
    """Mean over blocks of the mean difference; blocks that end at the border count as still."""
    apart = np.abs(grey - before)
    rows, columns = grey.shape[0] // block, grey.shape[1] // block
    found = np.zeros((rows, columns))
    for i in range(0, grey.shape[0] - block, block):
        for j in range(0, grey.shape[1] - block, block):
            found[i // block, j // block] = apart[i : i + block, j : j + block].mean()
    return float(found.mean()) if found.size else 0.0


def edges(grey: np.ndarray) -> np.ndarray:
    """Strength of the gradient (three by three); 0 along the border."""
    out = np.zeros(grey.shape)
    if min(grey.shape) > 2:
        left, right = grey[:, :-2], grey[:, 2:]
        across = (right - left)[:-2] + 2 * (right - left)[1:-1] + (right - left)[2:]
        above, below = grey[:-2], grey[2:]
        down = (below - above)[:, :-2] + 2 * (below - above)[:, 1:-1] + (below - above)[:, 2:]
        out[1:-1, 1:-1] = np.sqrt(across**2 + down**2)
    return out


def frame_quality(grey: np.ndarray) -> float:
    """Sharpness, middle brightness, contrast and information of a frame."""
    wide = np.pad(grey, 1, mode="reflect")
    laplace = wide[:-2, 1:-1] + wide[2:, 1:-1] + wide[1:-1, :-2] + wide[1:-1, 2:] - 4 * grey
    share = np.bincount(np.clip(grey, 0, 255).astype(np.int64).ravel(), minlength=256) / grey.size
    entropy = -(share * np.log2(share + 1e-10)).sum()
    parts = (min(laplace.var() / 1000, 1.0), 1 - abs(grey.mean() / 255 - 0.5) * 2, min(grey.std() / 255 * 2, 1.0), min(entropy / 8, 1.0))
    return float(np.dot((0.4, 0.2, 0.2, 0.2), parts))


def _measured(width: int, block: int, edge: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = batch.num_columns - 2
        out: dict[str, list] = {k: [] for k in MEASURES}
        for i in range(batch.num_rows):
            grey, before = (None if not batch.column(n + k)[i].is_valid else np.array(batch.column(n + k)[i].values, dtype=np.float64).reshape(-1, width) for k in (0, 1))
            same = before is not None and before.shape == grey.shape
            own = histogram(grey)
            last = histogram(before) if before is not None else None
            out["motion"].append(block_motion(grey, before, block) if same else None)
            out["scene_change"].append(float(np.abs(grey - before).mean() / 255) if same else None)
            out["color_change"].append(float(np.abs(own - last).sum()) if last is not None else None)
            flat = last is None or own.std() == 0 or last.std() == 0
            out["correlation"].append(None if flat else float(np.corrcoef(own, last)[0, 1]))
            out["edge_density"].append(float((edges(grey) > edge * 255).mean()))
            out["variance"].append(float(grey.var() / 255**2))
            out["quality"].append(frame_quality(grey))
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(n)), *(pa.array(out[k], pa.float64()) for k in MEASURES)], names=[*batch.schema.names[:n], *MEASURES])


def measured_frames(frames: DataFrame, width: int, block: int = BLOCK, edge: float = EDGE) -> DataFrame:
    """Rows (stream_id, frame_id, MEASURES) from rows (stream_id, frame_id, pixels); measures against a frame before are null for the first."""
    before = F.lag("pixels").over(Window.partitionBy("stream_id").orderBy("frame_id"))
    rows = frames.select("stream_id", "frame_id", "pixels").withColumn("before", before)
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("stream_id", "frame_id")}
    schema = ", ".join([*(f"{c} {t}" for c, t in kinds.items()), *(f"{m} double" for m in MEASURES)])
    return rows.mapInArrow(partial(_measured, width, block, edge), schema)


def activity(measured: DataFrame) -> DataFrame:
    """Per stream scores of motion, scene changes and complexity, with how even they are, and cuts against the frame before."""
    sigmoid = lambda x: 1 / (1 + F.exp(-x))
    even = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.coalesce(F.var_pop(c), F.lit(0.0))))
    zero = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    return measured.groupBy("stream_id").agg(
        F.count("*").alias("n"), sigmoid(zero("motion") / 255).alias("motion_score"), even("motion").alias("motion_consistency"),
        sigmoid(zero("scene_change")).alias("scene_score"), even("scene_change").alias("scene_stability"), zero("color_change").alias("color_change"),
        sigmoid((zero("edge_density") + zero("variance")) / 2).alias("complexity"), F.count_if(F.col("correlation") < CUT).alias("cuts"),
    )


# ---- one vector for the colour frames of a segment -------------------------------------------

#: Intensity mean, deviation and range, motion, then the shares of the bins of each channel.
CHANNELS = 3


def _summed(bins: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of a frame's pixels (the last column but one) and of their differences from the frame before (the last)."""
    names = ["count_", "sum_", "squares_", "low_", "high_", "moved_", "compared_", "bins_"]
    for batch in batches:
        n = batch.num_columns - 2
        out: list[tuple] = []
        for i in range(batch.num_rows):
            frame, before = (np.asarray(batch.column(n + k)[i].values, dtype=np.float64) if batch.column(n + k)[i].is_valid else None for k in (0, 1))
            if frame is None or not len(frame):
                out.append((0, 0.0, 0.0, None, None, 0.0, 0, [0] * (CHANNELS * bins)))
                continue
            same = before is not None and len(before) == len(frame)
            counts = np.concatenate([np.histogram(frame[c::CHANNELS], bins=bins, range=(0, 255))[0] for c in range(CHANNELS)])
            out.append((len(frame), frame.sum(), (frame**2).sum(), frame.min(), frame.max(), np.abs(frame - before).sum() if same else 0.0, len(frame) if same else 0, counts))
        kinds = [pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.float64(), pa.float64(), pa.int64(), pa.list_(pa.int64())]
        columns = [pa.array([row[k] for row in out], kind) for k, kind in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:n], *columns], names=[*batch.schema.names[:n], *names])


def video_features(frames: DataFrame, keys: list[str], order: list[str], bins: int = BINS) -> DataFrame:
    """``keys`` (of a segment) with ``features``: 4 + 3 * ``bins`` numbers of its frames.

    ``pixels`` holds red, green and blue in turn, pixel by pixel. Frames are summed one by
    one, so a segment of any length is a partial aggregation; motion compares a frame with
    the one before it in the segment where both have the same size, and is 0 without any.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    kept = frames.select(*keys, "pixels", F.lag("pixels").over(window).alias("before_"))
    schema = ", ".join(f"{k} {kept.schema[k].dataType.simpleString()}" for k in keys)
    sums = kept.mapInArrow(partial(_summed, bins), f"{schema}, count_ long, sum_ double, squares_ double, low_ double, high_ double, moved_ double, compared_ long, bins_ array<long>")
    per = sums.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in ("count_", "sum_", "squares_", "moved_", "compared_")), F.min("low_").alias("low_"), F.max("high_").alias("high_"), *(F.sum(F.col("bins_")[i]).alias(f"bin{i}_") for i in range(CHANNELS * bins)))
    mean = F.col("sum_") / F.col("count_")
    total = [sum((F.col(f"bin{c * bins + b}_") for b in range(bins)), F.lit(0)) for c in range(CHANNELS)]
    shares = [F.coalesce(F.try_divide(F.col(f"bin{c * bins + b}_"), total[c]), F.lit(0.0)) for c in range(CHANNELS) for b in range(bins)]
    basic = [mean, F.sqrt(F.greatest(F.col("squares_") / F.col("count_") - mean * mean, F.lit(0.0))), F.col("high_") - F.col("low_"), F.coalesce(F.try_divide("moved_", "compared_"), F.lit(0.0))]
    return per.where("count_ > 0").select(*keys, F.array(*basic, *shares).alias("features"))
