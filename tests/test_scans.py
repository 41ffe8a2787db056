import random

import pytest
from pyspark.sql import functions as F

from lumenspan.operators import detection, scans, states


@pytest.fixture(scope="module")
def rows(spark):
    """One key with most rows, ties, a null key and unknown values."""
    r = random.Random(3)
    made = [(r.choice(["hot", "hot", "hot", "b", "c", None]), r.randrange(300), i, r.random() if r.random() < 0.6 else None) for i in range(900)]
    df = spark.createDataFrame(made, "k string, t long, id long, v double").repartition(3).cache()
    return df, made


def by_key(made):
    keys = {}
    for row in sorted(made, key=lambda x: (x[1], x[2])):
        keys.setdefault(row[0], []).append(row)
    return keys


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_running_sums(rows, parts):
    df, made = rows
    found = {r["id"]: (r["nth"], r["v_upto"]) for r in scans.running_sums(df, ["k"], ["t", "id"], ["v"], "t", parts).collect()}
    assert len(found) == len(made)
    for key in by_key(made).values():
        total = None
        for n, (_, _, i, v) in enumerate(key, 1):
            total = total if v is None else (total or 0) + v
            assert found[i][0] == n
            assert found[i][1] == (None if total is None else pytest.approx(total))
    whole = scans.running_sums(df.fillna(0.0, ["v"]), [], ["t", "id"], ["v"], "t", parts).orderBy("nth").collect()
    assert [r["nth"] for r in whole] == list(range(1, len(made) + 1))
    assert whole[-1]["v_upto"] == pytest.approx(sum(v or 0 for *_, v in made))


@pytest.mark.parametrize("parts", [1, 9, 60])
def test_known_around(rows, parts):
    df, made = rows
    found = {r["id"]: (r["before"], r["after"]) for r in scans.known_around(df, ["k"], ["t", "id"], "v", "t", parts).collect()}
    for key in by_key(made).values():
        for n, (_, _, i, _) in enumerate(key):
            before = [v for *_, v in key[: n + 1] if v is not None]
            after = [v for *_, v in key[n:] if v is not None]
            assert found[i] == (before[-1] if before else None, after[0] if after else None)


@pytest.mark.parametrize(("parts", "block"), [(1, 64), (8, 64), (8, 5)])
def test_exponential_mean_equals_the_fold(rows, monkeypatch, parts, block):
    monkeypatch.setattr(scans, "BLOCK", block)
    df, made = rows
    known = df.fillna(0.5, ["v"])
    folded = {}
    for key in by_key(made).values():
        mean = None
        for _, _, i, v in key:
            v = 0.5 if v is None else v
            mean = folded[i] = v if mean is None else 0.3 * v + 0.7 * mean
    scanned = scans.exponential_mean(known, ["k"], ["t", "id"], "v", 0.3, "smooth", "t", parts)
    assert {r["id"]: pytest.approx(r["smooth"], rel=1e-12) for r in scanned.collect()} == folded
    assert "Python" not in scanned._jdf.queryExecution().executedPlan().toString()


def test_recurrence_over_a_long_key(spark):
    df = spark.range(10_000).select(F.lit(1).alias("k"), F.col("id").alias("t"))
    out = scans.recurrence(df, ["k"], ["t"], F.when(F.col("nth") % 3000 == 0, 0.0).otherwise(1.0), F.lit(1.0), "x", "t", 12)
    assert all(r["x"] == (r["nth"] - 3000 * (r["nth"] // 3000) + (1 if r["nth"] >= 3000 else 0)) for r in out.collect())


def test_empty(rows):
    none = rows[0].limit(0)
    assert scans.running_sums(none, ["k"], ["t"], ["v"], "t").count() == 0
    assert scans.known_around(none, ["k"], ["t"], "v", "t").count() == 0
    assert scans.exponential_mean(none, ["k"], ["t"], "v", 0.5, "x", "t").count() == 0


def test_spam_flags_equal_a_search(spark):
    r = random.Random(8)
    rows = [(i, r.choice([1, 1, 1, 2, 3]), r.choice([r.uniform(0, 900), float(r.randrange(0, 900, 60))]), r.choice(["gg", "gg", "hello there", "WOW GREAT", f"text {i}", "see https://x.y", "ok", None])) for i in range(400)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, t double, message string")
    found = {x["event_id"]: (x["n_near"], x["n_distinct"]) for x in detection.spam_flags(df).collect()}
    for i, user, t, _ in rows:
        near = [m for _, u, s, m in rows if u == user and abs(s - t) < 60]
        assert found[i] == (len(near), len(set(near)))


def test_streams_near_in_one_crowded_bucket(spark):
    frames = spark.range(100_000).selectExpr("id AS frame_id", "id % 50 AS stream_id", "id / 1e6 AS t", "false AS is_keyframe")
    found = states.streams_near(frames, "t", 0.2)
    assert [tuple(x) for x in found.groupBy("n_near").count().collect()] == [(49, 100_000)]
    joins = found._jdf.queryExecution().optimizedPlan().toString()
    assert joins.count("Join") == 1


@pytest.mark.parametrize("strict", [True, False])
def test_streams_near_equal_a_search(spark, strict):
    r = random.Random(2)
    rows = [(i, r.randrange(6), r.choice([r.uniform(-5, 30), float(r.randrange(0, 30))])) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, stream_id long, t double")
    found = {x["id"]: x["n_near"] for x in states.streams_near(df, "t", 1.0, strict).collect()}
    for i, s, t in rows:
        assert found[i] == len({o for _, o, u in rows if o != s and (abs(u - t) < 1 if strict else abs(u - t) <= 1)})
