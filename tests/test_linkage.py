"""Ward clusters and array features against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenspan.operators import linkage, pixels, spectrum


def plain_ward(rows, cut=0.3):
    """Merges the two nearest clusters again and again, distances by Lance and Williams."""
    def far(x, y):
        hull = max(x[2], y[2]) - min(x[1], y[1])
        overlap = max(0.0, min(x[2], y[2]) - max(x[1], y[1])) / hull if hull > 0 else 0.0
        a, b = np.array(x[3:], float), np.array(y[3:], float)
        norms = np.linalg.norm(a) * np.linalg.norm(b)
        return (1 - overlap + (1 - a @ b / norms if norms else 0.5)) / 2

    n = len(rows)
    d = np.array([[far(x, y) if x is not y else np.inf for y in rows] for x in rows]) ** 2
    groups = {i: [i] for i in range(n)}
    while len(groups) > 1:
        keys = list(groups)
        _, a, b = min((d[i, j], i, j) for k, i in enumerate(keys) for j in keys[k + 1 :])
        if d[a, b] > cut**2:
            break
        na, nb = len(groups[a]), len(groups[b])
        for c in groups:
            if c not in (a, b):
                nc = len(groups[c])
                d[a, c] = d[c, a] = ((na + nc) * d[a, c] + (nb + nc) * d[b, c] - nc * d[a, b]) / (na + nb + nc)
        groups[a] += groups.pop(b)
    return {rows[i][0]: min(rows[k][0] for k in g) for g in groups.values() for i in g}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_ward_equals_the_plain_version(spark, seed):
    r = random.Random(seed)
    streams = {}
    for s in range(3):
        spots = [r.uniform(0, 400) for _ in range(9)]
        streams[s] = [(1000 * s + i, (t := r.choice(spots) + r.gauss(0, 4)), t + r.choice([0.0, r.uniform(5, 60), 30 + r.gauss(0, 3)]), r.random(), r.choice([0.0, r.random()])) for i in range(70)]
    rows = [(s, *row) for s, mine in streams.items() for row in mine] + [(0, 77_777, 5.0, 30.0, None, 0.0)]
    streams[0].append((77_777, 5.0, 30.0, 0.0, 0.0))
    df = spark.createDataFrame(rows, "stream_id long, id long, start_time double, end_time double, score double, confidence double")
    found = {r["id"]: r["cluster"] for r in linkage.ward_clusters(df, ["score", "confidence"]).collect()}
    wanted = {k: v for mine in streams.values() for k, v in plain_ward(mine).items()}
    assert found == wanted
    assert 1 < len(set(wanted.values())) < len(wanted)
    assert linkage.ward_clusters(df.limit(0), ["score"]).count() == 0


def test_a_long_component_needs_no_matrix():
    r = np.random.default_rng(4)
    start = np.sort(r.uniform(0, 300, 1500))
    label = linkage.linked(start, start + 40, np.ones((1500, 1)))
    assert 10 < len(np.unique(label)) < 200 and (np.diff(label) >= 0).mean() > 0.9


@pytest.fixture
def clips(spark):
    r = random.Random(9)
    made = [(i, [r.uniform(-1, 1) for _ in range(n)]) for i, n in enumerate((64, 100, 33, 32, 1, 200))] + [(90, []), (91, None), (92, [0.0] * 64), (93, [float(np.sin(2 * np.pi * 5 * k / 64)) for k in range(64)])]
    return spark.createDataFrame(made, "id long, samples array<double>"), {k: np.array(v or []) for k, v in made}


def test_spectra(clips):
    df, plain = clips
    found = spectrum.spectral_excitement(spectrum.spectra(df, ["id"], "samples", 16000.0, 32, 8), 4000.0)
    for r in found.collect():
        x = plain[r["id"]]
        rows = []
        for i in range(0, len(x) - 32, 8):
            part = x[i : i + 32]
            m = np.abs(np.array([sum(part[t] * np.exp(-2j * np.pi * k * t / 32) for t in range(32)) for k in range(16)]))
            hz = np.arange(16) * 500.0
            c = (m * hz).sum() / m.sum() if m.sum() > 1e-12 else 0.0
            b = np.sqrt((m * (hz - c) ** 2).sum() / m.sum()) if m.sum() > 1e-12 else 0.0
            rows.append((c, b, np.abs(np.diff(np.sign(part))).sum() / 64))
        if not rows:
            assert r["spectral_score"] == 0 and not r["centroid"]
            continue
        c, b, z = (np.array(v) for v in zip(*rows, strict=True))
        assert np.allclose(r["centroid"], c) and np.allclose(r["bandwidth"], b) and np.allclose(r["crossings"], z)
        score = np.mean([(c > 4000).mean(), 1 / (1 + np.exp(-b.var() / 10000)), 1 / (1 + np.exp(-z.mean() * 100))])
        assert r["spectral_score"] == pytest.approx(score) and r["high_freq_energy"] == pytest.approx((c > 4000).mean())


def test_clip_vectors(clips):
    df, plain = clips
    for r in spectrum.clip_vectors(df, ["id"], "samples").collect():
        x = plain[r["id"]]
        if not len(x):
            assert r["features"] is None
            continue
        m = np.abs(np.fft.fft(x)[: len(x) // 2])
        at = np.flatnonzero(np.cumsum(m) >= 0.85 * m.sum()) if len(m) else []
        rolled = at[0] / len(m) if len(at) else 1.0
        assert r["features"] == pytest.approx([x.mean(), x.std(), abs(x).max(), len(x), m.mean() if len(m) else 0, m.std() if len(m) else 0, m.sum(), rolled])


def test_video_features(spark):
    r = random.Random(5)
    segments = {0: 6, 1: 1, 2: 3}
    rows, plain = [], {}
    for s, n in segments.items():
        plain[s] = np.array([[r.choice([0, 255, r.randrange(256)]) for _ in range(27)] for _ in range(n)], float)
        rows += [(s, i, [float(v) for v in f]) for i, f in enumerate(plain[s])]
    rows += [(3, 0, None), (3, 1, [])]
    df = spark.createDataFrame(rows, "segment long, i long, pixels array<double>")
    found = {r["segment"]: r["features"] for r in pixels.video_features(df, ["segment"], ["i"]).collect()}
    assert set(found) == {0, 1, 2}
    for s, f in plain.items():
        motion = np.abs(np.diff(f, axis=0)).mean() if len(f) > 1 else 0.0
        wanted = [f.mean(), f.std(), f.max() - f.min(), motion]
        for c in range(3):
            counts, _ = np.histogram(f.reshape(len(f), 9, 3)[..., c], bins=16, range=(0, 255))
            wanted += list(counts / counts.sum())
        assert found[s] == pytest.approx(wanted)
