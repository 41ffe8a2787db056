"""Spectra of sound held as arrays of samples: framed features, excitement, and one vector for a clip.

Fourier transforms are NumPy's on Arrow batches, one clip at a time in memory; what follows
from them are column expressions. Null and empty clips have no features.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROLL_OFF = 0.85
FRAMED = ("centroid", "rolloff", "bandwidth", "crossings")
CLIP = ("mean", "deviation", "peak", "samples", "spectral_mean", "spectral_deviation", "spectral_sum", "rolloff_share")


def _rolloff(magnitude: np.ndarray) -> np.ndarray:
    """The first place, in each row, up to which the share of the magnitudes lies."""
    upto = np.cumsum(magnitude, axis=-1)
    return (upto >= ROLL_OFF * upto[..., -1:]).argmax(axis=-1)


def framed_features(samples: np.ndarray, rate: float, frame: int = 2048, hop: int = 512) -> np.ndarray:
    """Rows of centroid, rolloff, bandwidth (in hertz) and rate of zero crossings, one for each frame that starts before the last full one."""
    starts = np.arange(0, len(samples) - frame, hop)
    if not len(starts):
        return np.zeros((0, 4))
    frames = np.lib.stride_tricks.sliding_window_view(samples, frame)[starts]
    magnitude = np.abs(np.fft.rfft(frames, axis=1))[:, : frame // 2]
    hertz = np.arange(frame // 2) * rate / frame
    total = magnitude.sum(axis=1)
    full = np.where(total > 0, total, 1.0)
    centroid = (magnitude * hertz).sum(axis=1) / full
    bandwidth = np.sqrt((magnitude * (hertz - centroid[:, None]) ** 2).sum(axis=1) / full)
    crossings = np.abs(np.diff(np.sign(frames), axis=1)).sum(axis=1) / (2 * frame)
    return np.stack((centroid, hertz[_rolloff(magnitude)], bandwidth, crossings), axis=1)


def clip_features(samples: np.ndarray) -> np.ndarray:
    """Mean, deviation, peak and length of a clip, then mean, deviation and sum of its magnitudes and where 85 % of them lie."""
    magnitude = np.abs(np.fft.rfft(samples))[: len(samples) // 2]
    if not len(magnitude):
        return np.array([samples.mean(), samples.std(), np.abs(samples).max(), len(samples), 0.0, 0.0, 0.0, 1.0])
    share = _rolloff(magnitude) / len(magnitude)
    return np.array([samples.mean(), samples.std(), np.abs(samples).max(), len(samples), magnitude.mean(), magnitude.std(), magnitude.sum(), share])


def _clips(batch: pa.RecordBatch, column: int) -> Iterator[np.ndarray | None]:
    for value in batch.column(column):
        yield np.asarray(value.values.to_numpy(zero_copy_only=False), dtype=np.float64) if value.is_valid and len(value.values) else None


def _framed(rate: float, frame: int, hop: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [None if clip is None else framed_features(clip, rate, frame, hop) for clip in _clips(batch, batch.num_columns - 1)]
        columns = [pa.array([None if f is None else f[:, k] for f in found], pa.list_(pa.float64())) for k in range(4)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], names=[*batch.schema.names[:-1], *FRAMED])


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [None if clip is None else clip_features(clip) for clip in _clips(batch, batch.num_columns - 1)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.list_(pa.float64()))], names=[*batch.schema.names[:-1], "features"])


def _keys(df: DataFrame, keys: list[str]) -> str:
    return ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)


def spectra(clips: DataFrame, keys: list[str], samples: str, rate: float, frame: int = 2048, hop: int = 512) -> DataFrame:
    """``keys`` with arrays of centroid, rolloff, bandwidth and crossings over the frames of a clip."""
    schema = f"{_keys(clips, keys)}, " + ", ".join(f"{c} array<double>" for c in FRAMED)
    return clips.select(*keys, samples).mapInArrow(partial(_framed, rate, frame, hop), schema)


def clip_vectors(clips: DataFrame, keys: list[str], samples: str) -> DataFrame:
    """``keys`` with ``features``, the eight numbers of ``CLIP``."""
    return clips.select(*keys, samples).mapInArrow(_vectors, f"{_keys(clips, keys)}, features array<double>")


def _mean(values: Column) -> Column:
    return F.try_divide(F.aggregate(values, F.lit(0.0), lambda s, x: s + x), F.size(values))


def _variance(values: Column, mean: Column) -> Column:
    return F.try_divide(F.aggregate(values, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)), F.size(values))


def _sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def spectral_excitement(found: DataFrame, high: float = 4000.0) -> DataFrame:
    """``found`` (as from ``spectra``) with spectral_score, high_freq_energy, bandwidth_var and crossing_mean; 0 without frames.

    The score is the mean of the share of frames with a centroid above ``high``, the
    spread of bandwidths and the rate of zero crossings, the last two by the logistic curve.
    """
    some = F.coalesce(F.size("centroid"), F.lit(0)) > 0
    rated = found.withColumn("mean_", _mean(F.col("bandwidth")))
    rated = rated.withColumn("high_freq_energy", F.when(some, F.try_divide(F.size(F.filter("centroid", lambda c: c > high)), F.size("centroid"))).otherwise(0.0))
    rated = rated.withColumn("bandwidth_var", F.when(some, _variance(F.col("bandwidth"), F.col("mean_"))).otherwise(0.0)).withColumn("crossing_mean", F.when(some, _mean(F.col("crossings"))).otherwise(0.0))
    score = (F.col("high_freq_energy") + _sigmoid(F.col("bandwidth_var") / 10000) + _sigmoid(F.col("crossing_mean") * 100)) / 3
    return rated.withColumn("spectral_score", F.when(some, score).otherwise(0.0)).drop("mean_")
