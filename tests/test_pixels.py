"""Measures of frames against plain loops."""

import math

import numpy as np
import pytest

from lumenspan.operators import pixels as P


def plain_quality(g):
    h, w = len(g), len(g[0])
    at = lambda i, j: g[abs(i) if i < h else 2 * h - 2 - i][abs(j) if j < w else 2 * w - 2 - j]
    laplace = [at(i - 1, j) + at(i + 1, j) + at(i, j - 1) + at(i, j + 1) - 4 * g[i][j] for i in range(h) for j in range(w)]
    flat = [x for r in g for x in r]
    mean = lambda v: sum(v) / len(v)
    var = lambda v: mean([(x - mean(v)) ** 2 for x in v])
    share = [sum(int(x) == k for x in flat) / len(flat) for k in range(256)]
    entropy = -sum(p * math.log2(p + 1e-10) for p in share)
    return 0.4 * min(var(laplace) / 1000, 1) + 0.2 * (1 - abs(mean(flat) / 255 - 0.5) * 2) + 0.2 * min(math.sqrt(var(flat)) / 255 * 2, 1) + 0.2 * min(entropy / 8, 1)


def test_quality_and_edges_equal_plain_loops():
    r = np.random.default_rng(1)
    for shape in ((5, 7), (8, 8), (3, 3)):
        g = r.uniform(0, 255, shape)
        assert P.frame_quality(g) == pytest.approx(plain_quality(g.tolist()))
        found = P.edges(g)
        for i in range(1, shape[0] - 1):
            for j in range(1, shape[1] - 1):
                x = sum(k * g[i + a, j + b] for a, k1 in ((-1, 1), (0, 2), (1, 1)) for b, k in ((-1, -k1), (1, k1)))
                y = sum(k * g[i + a, j + b] for b, k1 in ((-1, 1), (0, 2), (1, 1)) for a, k in ((-1, -k1), (1, k1)))
                assert found[i, j] == pytest.approx(math.hypot(x, y))
        assert found[0].sum() == found[:, -1].sum() == 0


def test_frames_of_other_size_and_the_first(spark):
    rows = [(1, 1, [0.0] * 16), (1, 2, [255.0] * 16), (1, 3, [1.0] * 8), (2, 1, [9.0] * 16)]
    df = spark.createDataFrame(rows, "stream_id long, frame_id long, pixels array<double>")
    found = {(r["stream_id"], r["frame_id"]): r for r in P.measured_frames(df, 4, block=2).collect()}
    assert found[1, 1]["motion"] is None and found[2, 1]["color_change"] is None
    assert found[1, 2]["scene_change"] == 1.0 and found[1, 2]["color_change"] == 2.0
    assert found[1, 2]["motion"] == pytest.approx(255 / 4)  # of four blocks one is not at the border
    assert found[1, 3]["motion"] is None and found[1, 3]["color_change"] == 2.0
