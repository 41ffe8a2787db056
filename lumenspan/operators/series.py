"""Smoothing, correlation and outliers of ordered series (series, t, v)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from lumenspan.operators.scans import exponential_mean
from lumenspan.operators.temporal import band_join


def moving_average(series: DataFrame, width: float = 10.0, strength: float | None = None) -> DataFrame:
    """``smooth``: mean over half the width on both sides; with ``strength``, blended with the value."""
    half = f"CAST({width / 2} AS DOUBLE)"
    mean = F.expr(f"avg(v) OVER (PARTITION BY series ORDER BY t RANGE BETWEEN {half} PRECEDING AND {half} FOLLOWING)")
    return series.withColumn("smooth", mean if strength is None else (1 - strength) * F.col("v") + strength * mean)


def moving_median(series: DataFrame, strength: float = 0.3) -> DataFrame:
    """The median of up to five neighbouring rows, blended with the value."""
    frame = Window.partitionBy("series").orderBy("t", "id").rowsBetween(-2, 2)
    return series.withColumn("smooth", (1 - strength) * F.col("v") + strength * F.percentile("v", 0.5).over(frame))


def gaussian(series: DataFrame, width: float = 10.0, strength: float = 0.3) -> DataFrame:
    """Kernel mean with a deviation of a third of the width, cut at four deviations, blended with the value."""
    sigma = width / 3
    other = series.select("series", F.col("t").alias("t2"), F.col("v").alias("v2"))
    pairs = band_join(series, other, ["series"], "t", "t2", 4 * sigma)
    w = F.exp(-F.pow(F.col("t") - F.col("t2"), 2) / (2 * sigma * sigma))
    mean = pairs.groupBy("series", "id", "t", "v").agg((F.sum(w * F.col("v2")) / F.sum(w)).alias("mean"))
    return mean.withColumn("smooth", (1 - strength) * F.col("v") + strength * F.col("mean")).drop("mean")


def exponential(series: DataFrame, alpha: float) -> DataFrame:
    """Rows (series, id, t, v, smooth) of the exponential mean in order of time."""
    return exponential_mean(series.select("series", "id", "t", "v"), ["series"], ["t", "id"], "v", alpha, "smooth", "exponential")


def _moments(t: Column, v: Column, over: WindowSpec) -> Column:
    """Struct of number, means, variances, covariance and ends of the pairs (t, v) in a window; pairs with a null are left out."""
    t, v = F.when(v.isNotNull(), t), F.when(t.isNotNull(), v)
    found = {"n": F.count(v), "mt": F.avg(t), "mv": F.avg(v), "vt": F.var_pop(t), "vv": F.var_pop(v), "tv": F.covar_pop(t, v), "t0": F.min(t), "t1": F.max(t), "v0": F.min(v), "v1": F.max(v)}
    return F.struct(*[x.over(over).alias(n) for n, x in found.items()])


def _joint_correlation(a: Column, b: Column) -> Column:
    """Correlation over two sets of pairs together, from their moments; 0 where a value never changes or nothing is known."""
    n, m = a["n"], b["n"]
    each = lambda x, k: F.when(k > 0, k * x).otherwise(0.0)
    apart = lambda p, q: F.when((n > 0) & (m > 0), (b[p] - a[p]) * (b[q] - a[q]) * (n * m / (n + m))).otherwise(0.0)
    joint = lambda x, p, q: each(a[x], n) + each(b[x], m) + apart(p, q)
    still = (F.least(a["v0"], b["v0"]) == F.greatest(a["v1"], b["v1"])) | (F.least(a["t0"], b["t0"]) == F.greatest(a["t1"], b["t1"]))
    found = F.try_divide(joint("tv", "mt", "mv"), F.sqrt(joint("vt", "mt", "mt")) * F.sqrt(joint("vv", "mv", "mv")))
    return F.when(still, 0.0).otherwise(F.coalesce(found, F.lit(0.0)))


def time_correlation(series: DataFrame, width: float = 30.0, keys: tuple[str, ...] = ("series",)) -> DataFrame:
    """Per series the mean absolute correlation of value and time over the windows that start at each row.

    Time is cut into buckets of the width. A window is the rest of its start's bucket and
    the beginning of the next; moments run on along both and are put together, so the work
    does not grow with the rows in a window, and a series is spread over its buckets.
    """
    bucket = F.floor(F.col("t") / width).cast("long")
    # Each row is a start beside its bucket, at the end of its window, and goes on the bucket before.
    place = lambda starts, k, at: F.struct(F.lit(starts).alias("starts_"), (bucket + k).alias("bucket_"), at.alias("at_"))
    rows = series.select(*keys, "t", "v", F.explode(F.array(place(True, 0, F.col("t") + width), place(False, -1, F.col("t") + 0.0))).alias("x")).select(*keys, "t", "v", "x.*").where("starts_ OR t IS NOT NULL")
    beside = Window.partitionBy(*keys, "bucket_")
    rest = beside.orderBy(F.desc("at_")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    begun = beside.orderBy("at_").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    starts, t, v = F.col("starts_"), F.col("t"), F.col("v").cast("double")
    local = rows.select(
        *keys, "starts_", (F.count_if(starts).over(rest) + F.count_if(~starts).over(begun)).alias("n"),
        _moments(F.when(starts, t), F.when(starts, v), rest).alias("a"), _moments(F.when(~starts, t), F.when(~starts, v), begun).alias("b"),
    )
    found = local.where("starts_ AND n >= 3").withColumn("c", F.abs(_joint_correlation(F.col("a"), F.col("b"))))
    return found.groupBy(*keys).agg(F.avg("c").alias("correlation"))


def _smoothing_matrix(n: int) -> np.ndarray:
    """Row i gives the value at place i of the parabola fitted to n values."""
    x = np.vander(np.arange(n) - n // 2, 3)
    return x @ np.linalg.inv(x.T @ x) @ x.T


def savitzky_golay(series: DataFrame, strength: float = 0.3, most: int = 11) -> DataFrame:
    """``smooth``: parabolas fitted to eleven neighbouring values, at both ends to the outermost eleven, blended with the value.

    Shorter series of an odd length from five on are fitted as a whole; others stay as they are.
    """
    order = Window.partitionBy("series").orderBy("t", "id")
    whole = Window.partitionBy("series")
    half, matrix = most // 2, _smoothing_matrix(most)
    dot = lambda weights, values: F.aggregate(F.zip_with(weights, values, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    rows = lambda m: F.array(*[F.array(*[F.lit(float(w)) for w in r]) for r in m])
    marked = series.withColumn("i_", F.row_number().over(order) - 1).withColumn("n_", F.count("*").over(whole))
    # The values of the ends only: at most eleven a side.
    ends = marked.where((F.col("i_") < most) | (F.col("i_") >= F.col("n_") - most))
    place = F.struct("i_", "v")
    first = F.transform(F.array_sort(F.collect_list(F.when(F.col("i_") < most, place))), lambda x: x["v"])
    last = F.transform(F.array_sort(F.collect_list(F.when(F.col("i_") >= F.col("n_") - most, place))), lambda x: x["v"])
    sides = ends.groupBy("series").agg(first.alias("first_"), last.alias("last_"))
    middle = sum((float(matrix[half][k]) * (F.lag("v", half - k) if k < half else F.lead("v", k - half)).over(order) for k in range(most)), F.lit(0.0))
    joined = marked.withColumn("middle_", middle).join(sides, "series")
    i, n = F.col("i_"), F.col("n_")
    short = F.when(F.lit(False), None)
    for size in range(5, most, 2):
        short = short.when(n == size, dot(F.get(rows(_smoothing_matrix(size)), i), F.col("first_")))
    fitted = F.when(n < most, F.coalesce(short, F.col("v"))).when(i < half, dot(F.get(rows(matrix), i), F.col("first_"))).when(i >= n - half, dot(F.get(rows(matrix), i - n + most), F.col("last_"))).otherwise(F.col("middle_"))
    return joined.withColumn("smooth", (1 - strength) * F.col("v") + strength * fitted).drop("i_", "n_", "middle_", "first_", "last_")


def spacing_outliers(series: DataFrame, deviations: float = 3.0, fewest: int = 10) -> DataFrame:
    """``outlier``: whether the step from the row before lies far from the mean step of its series."""
    order, all_ = Window.partitionBy("series").orderBy("t", "id"), Window.partitionBy("series")
    stepped = series.withColumn("step", F.col("t") - F.lag("t").over(order))
    z = F.try_divide(F.abs(F.col("step") - F.avg("step").over(all_)), F.stddev_pop("step").over(all_))
    enough = F.count("*").over(all_) >= fewest
    return stepped.withColumn("outlier", F.coalesce(enough & (z > deviations), F.lit(False)))


def drift(pairs: DataFrame, last: int = 100, fewest: int = 10) -> DataFrame:
    """Per series the slope of (stream - reference) on the reference over the last pairs; 0 with too few."""
    newest = Window.partitionBy("series").orderBy(F.desc("ref"), F.desc("id"))
    recent = pairs.withColumn("nth", F.row_number().over(newest)).where(F.col("nth") <= last)
    return recent.groupBy("series").agg(F.when(F.count("*") >= fewest, F.regr_slope(F.col("t") - F.col("ref"), "ref")).otherwise(0.0).alias("drift"))


def local_peaks(series: DataFrame, height: float = 0.5) -> DataFrame:
    """Rows above ``height`` that are higher than the row before and not lower than the row after."""
    order = Window.partitionBy("series").orderBy("t", "id")
    before, after = F.lag("v").over(order), F.lead("v").over(order)
    marked = series.withColumn("before", before).withColumn("after", after)
    return marked.where((F.col("v") > F.col("before")) & (F.col("v") >= F.col("after")) & (F.col("v") >= height)).drop("before", "after")


def complexity(series: DataFrame) -> DataFrame:
    """Content complexity over the last hundred rows: spread and share of high values."""
    frame = Window.partitionBy("series").orderBy("t", "id").rowsBetween(-99, 0)
    clip = lambda c: F.least(F.lit(1.0), c)
    spread, share = clip(10 * F.var_pop("v").over(frame)), F.avg((F.col("v") > 0.5).cast("double")).over(frame)
    return series.withColumn("complexity", clip(0.4 * spread + 0.4 * share + 0.2 * clip(5 * F.var_pop("v").over(frame))))


def boundaries(series: DataFrame, scene: float = 0.8, lull: float = 0.3) -> DataFrame:
    """``boundary``: a high value among the last three, or five low ones in a row."""
    order = Window.partitionBy("series").orderBy("t", "id")
    three, five = order.rowsBetween(-2, 0), order.rowsBetween(-4, 0)
    calm = (F.count("*").over(five) >= 5) & (F.max("v").over(five) < lull)
    return series.withColumn("boundary", (F.count("*").over(three) >= 3) & ((F.max("v").over(three) > scene) | calm))


def place_at(series: DataFrame, moment: float) -> DataFrame:
    """Per series the place of a moment between its rows, by linear interpolation; no row outside of them."""
    order = Window.partitionBy("series").orderBy("t", "id")
    placed = series.withColumn("i_", F.row_number().over(order) - 1).withColumn("t2_", F.lead("t").over(order))
    found = placed.where((F.col("t") <= moment) & (F.col("t2_") > moment))
    return found.select("series", (F.col("i_") + (F.lit(moment) - F.col("t")) / (F.col("t2_") - F.col("t"))).alias("place"))


def smoothed(series: DataFrame, method: str = "savgol", width: float = 10.0, strength: float = 0.3) -> DataFrame:
    """``smooth`` by the named method."""
    if method == "average":
        return moving_average(series, width, strength)
    if method == "exponential":
        return exponential(series, strength)
    if method == "gaussian":
        return gaussian(series, width, strength)
    return moving_median(series, strength) if method == "median" else savitzky_golay(series, strength)
