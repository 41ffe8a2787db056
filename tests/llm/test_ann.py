import numpy as np
import pytest

from lumenspan.llm import ann

SCHEMA = "vec_id long, embedding array<float>, label string"


def table(spark, vectors, start=0):
    return spark.createDataFrame([(start + i, None if v is None else [None if x is None else float(x) for x in v], "x") for i, v in enumerate(vectors)], SCHEMA)


def brute(rows, queries, k):
    out = {}
    for q, x in queries:
        scored = sorted((-float(sum(float(a) * float(b) for a, b in zip(x, y))), i) for i, y in rows if i != q)
        out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def test_recall_and_exact_scores(spark):
    r = np.random.default_rng(2)
    centres = r.normal(size=(12, 32))
    data = np.float32(centres[r.integers(0, 12, 700)] + 0.4 * r.normal(size=(700, 32)))
    df = table(spark, data)
    found = ann.search(df, df.where("vec_id % 20 = 0")).collect()
    exact = brute([(i, v) for i, v in enumerate(data)], [(i, data[i]) for i in range(0, 700, 20)], 20)
    got = {}
    for row in found:
        got.setdefault(row["query_id"], {})[row["rank"]] = (row["vec_id"], row["score"])
    hits = sum(len({i for i, _ in exact[q]} & {i for i, _ in got[q].values()}) for q in exact)
    assert hits / (20 * len(exact)) >= 0.99
    for q, ranks in got.items():
        assert sorted(ranks) == list(range(1, 21))
        for i, s in ranks.values():
            assert s == pytest.approx(sum(float(a) * float(b) for a, b in zip(data[q], data[i])), rel=1e-12)


def test_bounds_hold():
    r = np.random.default_rng(3)
    data = r.normal(size=(400, 64))
    turn = ann.rotation(64)
    bits = turn.shape[1]
    rest = data - data.mean(0)
    far = np.linalg.norm(rest, axis=1)
    turned = rest @ turn / far[:, None]
    assert np.allclose(np.linalg.norm(turned, axis=1), 1)
    along = np.abs(turned).sum(1) / np.sqrt(bits)
    words = np.packbits(turned >= 0, axis=1, bitorder="little").view(np.uint64).T.copy()
    ones = np.bitwise_count(words).sum(axis=0, dtype=np.int64)
    signs = np.where(turned >= 0, 1, -1) / np.sqrt(bits)
    held = []
    for q in rest:
        planes, least, step = ann.query_planes(q @ turn)
        products = ann.code_products(words, ones, planes[None], np.array([least]), np.array([step]))[0]
        rounded = least + step * np.rint((q @ turn - least) / step)
        assert np.allclose(products, signs @ rounded)
        guess = products * far / along
        error = ann.BOUND * far / along * (np.linalg.norm(q) * np.sqrt((1 - along**2) / (bits - 1)) + step / np.sqrt(12))
        held.append(np.abs(guess - rest @ q) <= error)
    assert np.mean(held) > 0.997


def test_short_vectors_repeated_ids_and_clashing_names(spark):
    from pyspark.sql import functions as F

    rows = [(1, [1.0, 0.0]), (2, [3.0]), (2, [2.0, 5.0]), (20, [1.0, 1.0]), (20, [1.0, 1.0]), (None, [9.0, 9.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for name in ("v", "code", "block", "query_block", "far", "found", "rank", "score", "query_id"):
        df = df.withColumn(name, F.lit("x"))
    found = ann.search(df, df.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["vec_id"], r["score"]) for r in found] == [(20, 2, 7.0), (20, 2, 3.0), (20, 1, 1.0)]


def test_ties_nulls_and_odd_vectors(spark):
    same = [1.0, 2.0, 3.0, 4.0]
    rows = [same] * 50 + [None, [0.0] * 4, [1.0, None, 1.0, 1.0], [float("nan"), 1, 1, 1], [float("inf"), 1, 1, 1], [1.0, 2.0], [-1.0, 0, 0, 0]]
    df = table(spark, rows)
    found = ann.search(df, df.where("vec_id IN (0, 20, 50, 51)")).orderBy("query_id", "rank").collect()
    assert [r["vec_id"] for r in found if r["query_id"] == 0] == list(range(1, 21))
    assert [r["vec_id"] for r in found if r["query_id"] == 20] == [*range(20)]
    assert {r["query_id"] for r in found} == {0, 20}


def test_few_candidates_and_empty_tables(spark):
    df = table(spark, [[1.0, 0.0], [0.5, 0.5], [0.0, 1.0]])
    assert [(r["vec_id"], r["rank"]) for r in ann.search(df, df.where("vec_id = 0")).orderBy("rank").collect()] == [(1, 1), (2, 2)]
    assert ann.search(df.limit(0), df.limit(0)).count() == 0
    assert ann.search(df, df.limit(0)).count() == 0
