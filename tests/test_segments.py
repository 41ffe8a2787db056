"""Segments in batch form against a plain walk, and the live forms against the batch ones."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lumenspan.operators import sync
from lumenspan.streaming import segments as G

SCHEMA = "stream_id long, frame_id long, t double, is_keyframe boolean, quality double, motion double, scene double, audio double"
RULES = G.Rules(fewest=4, most=25, history=20, idle=12.0)


def made(seed, n=700, streams=3):
    r = random.Random(seed)
    rows, clock = [], [0.0] * streams
    for i in range(n):
        s = r.choice(range(streams))
        clock[s] = round(clock[s] + (r.choice([14.0, 40.0]) if r.random() < 0.02 else r.random()), 3)
        calm = (clock[s] // 40) % 2 == 0
        rows.append((s, i, clock[s], r.random() < 0.1, r.choice([0.0, r.random()]), 0.5 + 0.05 * r.random() if calm else r.random(), r.random() ** (9 if calm else 1), 0.5 if calm else r.random()))
    return rows


def walked(rows):
    """Adaptive segments frame by frame, as they are defined."""
    out = []
    for s in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == s), key=lambda r: (r[2], r[1]))
        cuts = [0, *(i for i in range(1, len(mine)) if mine[i][2] - mine[i - 1][2] > RULES.idle), len(mine)]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            start, held, seen = None, [], []
            slots = {}
            for row in mine[lo:hi]:
                slots.setdefault(int(row[2] // RULES.slot), []).append(row)
            for slot in sorted(slots):
                at = slot * RULES.slot
                start = at if start is None else start
                held += slots[slot]
                seen += slots[slot]
                m, c, a = ([row[k] for row in seen[-RULES.history :]] for k in (5, 6, 7))
                complexity = round(min(1.0, 0.4 * min(10 * np.var(m), 1) + 0.4 * sum(x > 0.5 for x in c) / len(c) + 0.2 * min(5 * np.var(a), 1)), 9)
                length = RULES.shortest if complexity > RULES.target else RULES.shortest + (RULES.longest - RULES.shortest) * (1 - complexity / RULES.target)
                edge = len(c) >= 3 and (any(x > 0.8 for x in c[-3:]) or (len(m) >= 5 and all(x < 0.3 for x in m[-5:])))
                if (at - start >= length or edge or len(held) >= RULES.most) and len(held) >= RULES.fewest:
                    out.append((s, start, at, len(held), sum(r[3] for r in held), complexity))
                    start, held = at, []
            if held:
                out.append((s, start, (slot + 1) * RULES.slot, len(held), sum(r[3] for r in held), 0.5))
    return sorted(out)


def flat(df, *columns):
    return sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.select(*columns).collect())


SHORT = ("stream_id", "start_time", "end_time", "n", "keyframes", "complexity")


@pytest.mark.parametrize("seed", [1, 2])
def test_adaptive_equals_a_walk(spark, seed):
    rows = made(seed)
    found = G.adaptive(spark.createDataFrame(rows, SCHEMA).repartition(3), RULES)
    wanted = walked(rows)
    assert flat(found, *SHORT) == sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in wanted)
    assert any(r[5] != 0.5 for r in wanted) and any(r[5] == 0.5 for r in wanted)
    assert G.adaptive(spark.createDataFrame([], SCHEMA), RULES).count() == 0


def test_long_stretches_are_searched_in_parts():
    """A cut beyond the first stretches of the search, and a run that goes on in the next batch."""
    import pyarrow as pa

    n = 1000
    batch = pa.table({"stream_id": [1] * n, "run": [1] * n, "slot": list(range(n)), "n": [1] * n, "complexity": [0.0] * n, "boundary": [i == 700 for i in range(n)]}).to_batches()[0]
    rules = G.Rules(fewest=650, most=10**9, longest=10**9)
    whole = pa.Table.from_batches(list(G._opened(rules, iter([batch])))).to_pandas()
    parts = pa.Table.from_batches(list(G._opened(rules, iter([batch.slice(0, 333), batch.slice(333, 300), batch.slice(633)])))).to_pandas()
    assert whole.equals(parts)
    assert whole["closes"].to_numpy().nonzero()[0].tolist() == [700] and set(whole["opened"]) == {0.0, 350.0}


LATE = 9_999


@pytest.fixture
def feed(spark, tmp_path):
    """Frames of three streams in two loads: out of order within the delay, the second one with frames behind the watermark."""
    rows = made(5, 500)
    cut = sorted(r[2] for r in rows)[300]
    first, second = [r for r in rows if r[2] <= cut], [r for r in rows if r[2] > cut]
    late = [(0, LATE, cut - 500, True, 1.0, 0.9, 0.9, 0.9)] if cut > 500 else [(0, LATE, 0.001, True, 1.0, 0.9, 0.9, 0.9)]
    end = [(77, 10_000, 1e6, False, 1.0, 0.5, 0.0, 0.5)]
    path = f"{tmp_path}/in"

    def load(part, name):
        random.Random(name).shuffle(part)
        pd.DataFrame(part, columns=[c.split()[0] for c in SCHEMA.split(", ")]).to_parquet(f"{path}/{name}.parquet")

    import os

    os.makedirs(path)
    return rows, load, first, second + late, end, f"file://{path}"


def pairs(df, *columns):
    return flat(df.where("stream_id <> 77"), *columns)


@pytest.mark.parametrize("form", ["adaptive", "keyframe_based", "fixed_duration", "reset_windows"])
def test_live_equals_batch_after_a_restart(spark, feed, tmp_path, form):
    rows, load, first, second, end, path = feed
    options = {"adaptive": {"rules": RULES}, "keyframe_based": {"fewest": 5}, "fixed_duration": {"seconds": 10.0}, "reset_windows": {"seconds": 30.0}}[form]
    out, checkpoint = f"file://{tmp_path}/out", f"file://{tmp_path}/checkpoint"
    for part, name in ((first, "a"), (second, "b"), (end, "c"), ([(78, 10_001, 1e6 + 1, False, 1.0, 0.5, 0.0, 0.5)], "d")):
        load(part, name)  # each load is drained by a query of its own, which goes on from the checkpoint
        stream = spark.readStream.schema(SCHEMA).parquet(path)
        G.drained(G.live(stream, G.machine(form, **options), "5 seconds"), out, checkpoint)
    live = spark.read.schema(G.SEGMENT).parquet(out)
    frames = spark.createDataFrame(rows, SCHEMA)
    if form == "adaptive":
        assert pairs(live, *SHORT, "quality") == flat(G.adaptive(frames, RULES), *SHORT, "quality")
    elif form == "keyframe_based":
        assert pairs(live, "stream_id", "start_time", "end_time", "n") == flat(sync.keyframe_segments(frames, fewest=5), "stream_id", "start_time", "end_time", "n")
    elif form == "fixed_duration":
        fixed = sync.segments(frames.withColumn("size_bytes", F.lit(1)), 10.0)
        assert pairs(live, "stream_id", "start_time", "end_time", "n", "keyframes", "quality") == flat(fixed, "stream_id", "start_time", "end_time", "n", "keyframes", "quality")
        means = sync.running_means(fixed).join(fixed.select("stream_id", "segment", "start_time"), ["stream_id", "segment"])
        assert pairs(live, "stream_id", "start_time", "avg_length", "avg_frames") == flat(means, "stream_id", "start_time", "avg_length", "avg_frames")
    else:
        windows = sync.window_groups(frames, "t", "frame_id", 30.0, [F.count("*").alias("n")])
        assert pairs(live, "stream_id", "start_time", "end_time", "n") == flat(windows, "stream_id", "start_time", "end_time", "n")


def test_unknown_strategy():
    with pytest.raises(ValueError, match="strategy"):
        G.machine("by_mood")
