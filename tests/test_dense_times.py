"""Alignment and correlation over streams with very many rows at near times."""

import time

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lumenspan.operators import fusion as U
from lumenspan.operators import series as S
from lumenspan.operators.temporal import nearest


def plain(rows, digits=9):
    return sorted(tuple(round(x, digits) if isinstance(x, float) else x for x in r) for r in rows)


def series_of(n, seconds, seed):
    """Values with ties in time, long stretches of one value, and some nulls."""
    rng = np.random.default_rng(seed)
    t = np.round(rng.uniform(0, seconds, n), 1)
    v = np.where((t // 40) % 2 == 0, np.round(rng.uniform(0, 1, n), 2), 0.37)
    return pd.DataFrame({"series": rng.integers(0, 3, n), "t": t, "v": pd.array(np.where(rng.uniform(size=n) < 0.05, np.nan, v), dtype="Float64")})


def test_time_correlation_equals_windows_of_sql(spark):
    rows = series_of(900, 400.0, 1)
    duck = duckdb.connect()
    duck.register("ser", rows)
    expected = duck.sql("""WITH local AS (SELECT series, COUNT(*) OVER w AS n, abs(corr(t, v) OVER w) AS c FROM ser WINDOW w AS (PARTITION BY series ORDER BY t RANGE BETWEEN CURRENT ROW AND 30 FOLLOWING))
      SELECT series, AVG(CASE WHEN c IS NULL OR isnan(c) THEN 0 ELSE c END) FROM local WHERE n >= 3 GROUP BY series""").fetchall()
    df = spark.createDataFrame([(int(a), float(b), None if pd.isna(c) else float(c)) for a, b, c in rows.itertuples(index=False)], "series long, t double, v double")
    assert plain(S.time_correlation(df).select("series", "correlation").collect()) == plain(expected)


def detections_of(n, seconds, seed):
    rng = np.random.default_rng(seed)
    t = np.round(rng.uniform(0, seconds, n), 1)
    kinds = np.array(U.MODALITIES)[rng.integers(0, 3, n)]
    return [(i, int(s), str(m), float(x), float(a), float(b)) for i, (s, m, x, a, b) in enumerate(zip(rng.integers(0, 3, n), kinds, t, rng.uniform(size=n), rng.uniform(size=n), strict=True))]


DETECTIONS = "seq long, stream_id long, modality string, t double, score double, confidence double"


@pytest.mark.parametrize("n", [40, 1500])
def test_alignment_equals_pairs(spark, n):
    """Sparse streams with gaps beyond the width, and dense ones with ties on both sides."""
    df = spark.createDataFrame(detections_of(n, 300.0, n), DETECTIONS)
    pairs = nearest(U.grid_of(df), df, ["stream_id", "modality"], ["stream_id", "moment", "modality"], "moment", "t", "seq", 5.0, ["seq", "score", "confidence"])
    found = U.align_window(df)
    assert found.columns == pairs.columns
    assert plain(found.collect()) == plain(pairs.collect())
    names = sorted(U.pivoted(pairs).columns)
    assert sorted(map(str, U.pivoted_window(df).select(names).collect())) == sorted(map(str, U.pivoted(pairs).select(names).collect()))


def dense(spark, n):
    """One stream with all its observations in a minute."""
    kind = F.element_at(F.array(*[F.lit(m) for m in U.MODALITIES]), (F.col("id") % 3 + 1).cast("int"))
    return spark.range(n).select(F.col("id").alias("seq"), F.lit(1).cast("long").alias("stream_id"), kind.alias("modality"), (F.col("id") * 60 / n).alias("t"), (F.col("id") * 7 % 101 / 100).alias("score"), (F.col("id") * 3 % 97 / 96).alias("confidence"))


def within(limit, action):
    began = time.time()
    rows = action()
    assert time.time() - began < limit
    return rows


def test_dense_correlations_in_time(spark):
    """F8: each window was read anew from its start."""
    wide = U.pivoted_window(dense(spark, 1000))
    U.combined_correlations(wide).collect()  # first compilation
    assert len(within(40, lambda: U.combined_correlations(U.pivoted_window(dense(spark, 60_000))).collect())) == 1


def test_dense_adaptive_fusion_in_time(spark):
    """pairs of all near observations, and windows read anew, made this fail by time."""
    assert within(60, lambda: U.fused(U.pivoted_window(dense(spark, 60_000)), "adaptive").count()) > 0


def test_dense_correlation_fusion_in_time(spark):
    """pairs of all near observations, and windows read anew, made this fail by time."""
    assert within(60, lambda: U.fused(U.pivoted_window(dense(spark, 60_000)), "correlation").count()) > 0


def test_dense_learned_fusion_in_time(spark):
    """pairs of all near observations, and windows read anew, made this fail by time."""
    assert within(60, lambda: U.fused(U.pivoted_window(dense(spark, 60_000)), "learned").count()) > 0


def test_dense_adapted_weights_in_time(spark):
    """the correlations behind the weights were windows read anew."""
    rows = within(60, lambda: U.adapted_weights(U.combined_correlations(U.pivoted_window(dense(spark, 60_000)))).collect())
    assert [round(r["w_video"] + r["w_audio"] + r["w_chat"], 9) for r in rows] == [1.0]
