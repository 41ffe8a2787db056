import random

import pytest

from lumenspan.operators import ranking, series, temporal


def test_band_join_equals_all_pairs(spark):
    r = random.Random(4)
    left = [(r.randrange(3), i, r.uniform(-50, 50)) for i in range(200)]
    right = [(r.randrange(3), i, r.choice((r.uniform(-50, 50), left[i][2] + 5))) for i in range(200)]
    a, b = spark.createDataFrame(left, "k int, i int, t double"), spark.createDataFrame(right, "k int, j int, u double")
    for strict in (False, True):
        found = {(x["i"], x["j"]) for x in temporal.band_join(a, b, ["k"], "t", "u", 5.0, strict).collect()}
        near = lambda x, y: abs(x - y) < 5.0 if strict else abs(x - y) <= 5.0
        assert found == {(i, j) for k, i, t in left for m, j, u in right if k == m and near(t, u)}


def test_fold_by_is_ordered_and_keeps_state_apart(spark):
    rows = [(k, i, float(i)) for k in range(5) for i in range(50)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "k long, i long, v double")

    def step(state, row):
        total = row["v"] + (state["total"] if state else 0.0)
        return {"total": total}, [{"k": row["k"], "i": row["i"], "total": total}]

    found = temporal.fold_by(df, ["k"], ["i"], step, "k long, i long, total double").collect()
    assert all(r["total"] == r["i"] * (r["i"] + 1) / 2 for r in found) and len(found) == 250
    ends = temporal.fold_by(df, ["k"], ["i"], lambda s, r: ({"k": r["k"], "n": (s["n"] if s else 0) + 1}, []), "k long, n long", lambda s: [s]).collect()
    assert sorted((r["k"], r["n"]) for r in ends) == [(k, 50) for k in range(5)]


def test_nulls_and_empty_tables(spark):
    df = spark.createDataFrame([(1, 1, 0.0, None), (1, 2, 1.0, 5.0)], "series long, id long, t double, v double")
    assert series.moving_average(df).count() == 2
    assert series.exponential(df.limit(0), 0.5).count() == 0
    empty = spark.createDataFrame([], "id long, stream_id long, start_time double, end_time double, score double, confidence double, category string")
    assert ranking.merged_in_order(empty).count() == 0 and ranking.merged_islands(empty).count() == 0 and ranking.temporal_clusters(empty).count() == 0


def test_drift_of_a_known_slope(spark):
    rows = [(1, i, float(i), i * 1.002) for i in range(30)] + [(2, i, float(i), float(i)) for i in range(5)]
    df = spark.createDataFrame(rows, "series long, id long, ref double, t double")
    found = {r["series"]: r["drift"] for r in series.drift(df).collect()}
    assert found[1] == pytest.approx(0.002) and found[2] == 0.0


def test_merges_do_not_depend_on_input_order(spark):
    rows = [(i, 7, float(i * 7 % 100), float(i * 7 % 100 + i % 13), i / 50, 0.5) for i in range(50)]
    schema = "id long, stream_id long, start_time double, end_time double, score double, confidence double"
    one = ranking.merged_in_order(spark.createDataFrame(rows, schema)).collect()
    two = ranking.merged_in_order(spark.createDataFrame(rows[::-1], schema).repartition(3)).collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, two))
