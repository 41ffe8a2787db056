"""Choices in turn and fixed rules against plain row-by-row versions."""

import random

import pytest
from pyspark.sql import functions as F

from lumenspan.functions import scalar as C
from lumenspan.functions import text as X
from lumenspan.operators import billing as B
from lumenspan.operators import content as N
from lumenspan.operators import fusion as U
from lumenspan.operators import ranking as K
from lumenspan.operators.temporal import opened
from lumenspan.sources import shared

CANDIDATE = "stream_id long, id long, start_time double, end_time double, score double, confidence double"


@pytest.fixture(scope="module")
def rows():
    r = random.Random(4)
    out = []
    for i in range(60):
        start = r.uniform(0, 900)
        out.append((i % 3, i, start, start + r.uniform(5, 90), round(r.random(), 2), round(0.5 + r.random() / 2, 2)))
    return out


def gap(a, b):
    return (min(1.0, abs((a[2] + a[3]) / 2 - (b[2] + b[3]) / 2) / 30) + 0.5) / 2


def greedy(rows, most, value, least=None):
    out = {}
    for stream in {r[0] for r in rows}:
        left = sorted((r for r in rows if r[0] == stream), key=lambda r: (-round(r[4] * r[5], 9), r[1]))
        chosen = [left.pop(0)]
        while left and len(chosen) < most:
            scored = [round(value(r, sum(gap(r, c) for c in chosen) / len(chosen)), 9) for r in left]
            if least is not None and max(scored) <= least:
                break
            chosen.append(left.pop(scored.index(max(scored))))
        out[stream] = [r[1] for r in chosen]
    return out


def test_diverse_choice_equals_greedy(spark, rows):
    df = spark.createDataFrame(rows, CANDIDATE)
    expected = greedy(rows, 10, lambda r, d: 0.8 * r[4] * r[5] + 0.2 * d)
    found = K.diverse(df).collect()
    assert {s: [r["id"] for r in sorted(found, key=lambda r: r["place"]) if r["stream_id"] == s] for s in expected} == expected


def test_diverse_set_and_fill(spark, rows):
    df = K.ranked(spark.createDataFrame(rows, CANDIDATE))
    expected = greedy(rows, 10, lambda r, d: d, 0.1)
    found = K.diverse_set(df).collect()
    assert {s: {r["id"] for r in found if r["stream_id"] == s} for s in expected} == {s: set(v) for s, v in expected.items()}
    few = K.ranked(spark.createDataFrame([(1, i, 0.0, 10.0, 0.5, 0.9) for i in range(5)], CANDIDATE))
    assert K.diverse_set(few, 3, fewest=1).count() == 3  # equal middles are still 0.25 apart without features
    assert K.quality_balanced(few, 4).count() == 4


def test_created_in_turn_equals_row_by_row(spark, rows):
    r = random.Random(9)
    texts = [" ".join(r.choices(("goal", "save", "miss", "crowd"), k=2)) for _ in rows]
    df = spark.createDataFrame([(x[0], x[1], x[2], x[3], x[4], t) for x, t in zip(rows, texts, strict=True)], "stream_id long, id long, start_time double, end_time double, score double, description string")
    found = {x["id"] for x in N.created_in_turn(df).collect()}
    expected = set()
    for stream in range(3):
        made = []
        for x, t in sorted(((x, t) for x, t in zip(rows, texts, strict=True) if x[0] == stream), key=lambda p: (p[0][2], p[0][1])):
            if x[4] < 0.5 or (made and x[2] - made[-1][0][3] < 30):
                continue
            recent = [m for m in made if x[2] - m[0][2] <= 300]
            if len(recent) >= 3 and x[4] <= max(m[0][4] for m in recent) + 0.1:
                continue
            a = set(t.split())
            like = [m for m in made[-10:] if 0.6 * max(0, 1 - abs(x[2] - m[0][2]) / 120) + 0.4 * len(a & set(m[1].split())) / len(a | set(m[1].split())) > 0.8]
            if any(x[4] <= m[0][4] + 0.05 for m in like):
                continue
            made.append((x, t))
        expected |= {m[0][1] for m in made}
    assert found == expected


@pytest.mark.parametrize("strict", [False, True])
def test_opened_windows(spark, strict):
    times = [0.0, 5.0, 10.0, 10.0, 19.9, 20.0, 45.0, 55.0, 55.1]
    df = spark.createDataFrame([(s, i, t) for s in (1, 2) for i, t in enumerate(times)], "s long, i long, t double")
    expected, start = [], None
    for t in times:
        if start is None or t - start > 10 or (t - start == 10 and not strict):
            start = t
        expected.append(start)
    found = opened(df, ["s"], "t", "i", 10.0, strict).where("s = 2").orderBy("i").collect()
    assert [r["opened"] for r in found] == expected


def test_fixed_rules_of_messages(spark):
    cases = [("BUY NOW!!!!!!", 3 / 7), ("hi", 1 / 7), ("lol lol lol lol", 1 / 7), ("follow me at http://x.y", 1 / 7), ("a calm remark", 0.0), ("", 2 / 7)]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i long, t string")
    found = [r["s"] for r in df.select("i", X.spam_score(F.col("t")).alias("s")).orderBy("i").collect()]
    assert found[:5] == pytest.approx([s for _, s in cases[:5]])
    one = spark.createDataFrame([("love this awesome epic play :)", "xbot_1"), ("bad, awful lag :(", "ann")], "t string, u string")
    got = one.select(X.word_sentiment(F.col("t")).alias("w"), X.lexicon_sentiment(F.col("t")).alias("x"), X.is_bot(F.col("u")).alias("b"), X.emoji_count(F.col("t")).alias("e")).collect()
    assert [r["w"] for r in got] == [1.0, -1.0] and [r["b"] for r in got] == [True, False] and [r["e"] for r in got] == [1, 1]
    assert got[0]["x"]["score"] == 1.0 and got[0]["x"]["hype"] == pytest.approx(0.7) and got[1]["x"]["score"] == -1.0
    toxic = spark.createDataFrame([("you stupid noob",), ("KEEP SHOUTING LIKE THIS",), ("ok",)], "t string").select(X.toxicity(F.col("t")).alias("x")).collect()
    assert [r["x"] for r in toxic] == pytest.approx([0.4, 0.1, 0.0])


def test_fixed_tables(spark):
    limits = {r["plan_type"]: r for r in B.plans(spark).collect()}
    assert (limits["starter"]["max_members"], limits["professional"]["max_streams"], limits["custom"]["calls_per_minute"]) == (3, 5, 2000)
    rates = {(r["plan_type"], r["usage_type"]): r["plan_rate"] for r in B.rates(spark).collect()}
    assert len(rates) == 24 and rates["enterprise", "api_call"] == 0.00005
    assert all(abs(sum(w) - 1) < 1e-9 for w in C.DIMENSION_WEIGHTS.values())
    assert all(t["viable"] <= t["good"] <= t["exceptional"] <= t["legendary"] for t in C.THRESHOLDS.values())


def test_adapted_weights_move_only_with_correlation(spark):
    corr = spark.createDataFrame([(1, 0.9, 0.1, 0.2), (2, 0.0, 0.0, 0.0)], "stream_id long, video_audio double, video_chat double, audio_chat double")
    found = {r["stream_id"]: r for r in U.adapted_weights(corr).collect()}
    base = U.NORMALIZED
    total = sum(base.values())
    assert found[2]["w_video"] == pytest.approx(base["video"] / total)
    raised = {m: base[m] + (0.1 * (0.9 - 0.5) if m != "chat" else 0) for m in base}
    assert found[1]["w_chat"] == pytest.approx(raised["chat"] / sum(raised.values()))


def test_written_tables_are_removed(spark):
    path = shared.written(spark.range(5), "some").inputFiles()[0]
    assert shared.clean_up(spark) >= 1
    with pytest.raises(Exception):  # noqa: B017, PT011 - the file is gone
        spark.read.parquet(path).count()
