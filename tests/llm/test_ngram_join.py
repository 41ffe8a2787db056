import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lumenspan.llm import ngram_join
from test_minhash import near_copies, shingles


def brute(docs, percent):
    label = {i: i for i, _ in docs}
    sets = {i: shingles(t) for i, t in docs}

    def find(a):
        while label[a] != a:
            a = label[a]
        return a

    ids = sorted(label)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= percent * len(sets[x] | sets[y]):
                a, b = find(x), find(y)
                label[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


def found(df, percent=80):
    rows = ngram_join.jaccard_components(df, percent).collect()
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows}


def family(seed, n, words=60, edits=3):
    """Near copies of one text, some edited so much that they meet the others only through a chain or not at all."""
    r = random.Random(seed)
    base = [f"b{r.randrange(500)}" for _ in range(words)]
    out = []
    for k in range(n):
        w = list(base)
        for _ in range(r.randint(0, edits)):
            w[r.randrange(words)] = f"e{r.randrange(50)}"
        if r.random() < 0.3:
            w += [f"t{r.randrange(40)}" for _ in range(r.randint(1, 14))]
        out.append((1000 + k, " ".join(w)))
    return out


def test_equals_brute_force(docs):
    rows = near_copies(4) + family(1, 90) + family(2, 25, 12, 1)
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    assert found(docs(*rows, extra=True)) == brute(rows, 80)


@pytest.mark.parametrize("percent", [60, 90])
def test_other_thresholds(docs, percent):
    rows = [(i, t) for i, (_, t) in enumerate(near_copies(6, 90) + family(3, 60))]
    assert found(docs(*rows), percent) == brute(rows, percent)


def test_cells_of_few_members(docs, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 5)
    rows = [(i, t) for i, (_, t) in enumerate(family(7, 60, 40, 6) + family(8, 60, 90, 20))]
    assert found(docs(*rows)) == brute(rows, 80)


def test_nulls_empty_long_and_repeated_rows(docs):
    long = " ".join(f"x{i % 5000}y{i}" for i in range(60_000))
    df = docs((3, None), (4, ""), (5, " \n"), (6, long), (2, long + " end"), (7, "one two"), (8, "One  TWO"), (9, "a" * 2_000_000), (None, "one two"), (7, "one two"), (12, "now some quite other words here"), (12, "one two"))
    rows = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(df).collect()]
    assert sorted(rows, key=str) == sorted([(3, 0, 3), (4, 0, 4), (5, 0, 5), (6, 59_996, 2), (2, 59_997, 2), (7, 1, 7), (8, 1, 7), (9, 1, 9), (None, 1, None), (7, 1, 7), (12, 2, 12), (12, 1, 7)], key=str)
    assert ngram_join.jaccard_components(df.limit(0)).count() == 0


@settings(max_examples=150, deadline=None)
@given(seed=st.integers(0, 10**6), n=st.integers(1, 90), percent=st.sampled_from([50, 75, 80, 90]), common=st.sampled_from([1, 20, 2000, 10**6]))
def test_sets_at_the_threshold_share_an_entry(seed, n, percent, common):
    """Whatever the frequencies are; tokens of one set only have level 0, shared ones never."""
    r = np.random.default_rng(seed)
    universe = np.unique(r.integers(0, 1 << 63, 3 * n + 3, dtype=np.uint64))
    x = r.permutation(universe)[:n]
    gone = int(r.integers(0, max(1, n - ngram_join.least(n, percent)) + 1))
    rest = r.permutation(np.setdiff1d(universe, x))
    y = np.concatenate((r.permutation(x)[gone:], rest[: int(r.integers(0, gone + 2))]))
    union = len(np.union1d(x, y))
    both = len(np.intersect1d(x, y))
    if not both or 100 * both < percent * union or set(x) == set(y):
        return
    counts = dict(zip(universe.tolist(), r.integers(2, 2 + common, len(universe)), strict=True))
    level = lambda s, other: ngram_join.level(np.array([counts[t] if t in other or counts[t] % 2 else 1 for t in s.tolist()]))
    # A token's level is the same in both sets if it is in both.
    a = ngram_join.entries(x, level(x, set(y.tolist())), percent)
    b = ngram_join.entries(y, level(y, set(x.tolist())), percent)
    assert len(np.intersect1d(a, b))


def test_unlinked_entry_makes_no_cells(spark):
    """Nodes that share much, but have too many tokens of their own, drop out before any cell."""
    members = spark.range(3000).selectExpr("1L AS entry", "id AS node", "100L AS n", "15L AS own", f"unhex('{'ff' * (ngram_join.BITS // 8)}') AS bits")
    labels = spark.createDataFrame([], "id long, component long")
    assert ngram_join.apart_pairs(members, labels).count() == 0
    alone = members.selectExpr("entry", "node", "n", "IF(node = 0, 0L, own) AS own", "bits")
    assert ngram_join.apart_pairs(alone, labels).count() == 0


def test_a_round_gives_each_component_one_pair(spark):
    bits = f"unhex('{'ff' * (ngram_join.BITS // 8)}')"
    members = spark.range(400).selectExpr("1L AS entry", "id AS node", "100L AS n", "0L AS own", f"{bits} AS bits")
    labels = spark.createDataFrame([(i, 0) for i in range(100)], "id long, component long")
    every = ngram_join.apart_pairs(members, labels)
    assert every.count() == 300 * 299 // 2 + 300 * 100
    assert ngram_join.apart_pairs(members, labels, round_=0).count() <= 2 * 2 * 301


@settings(max_examples=100, deadline=None)
@given(seed=st.integers(0, 10**6), n=st.integers(1, 3000))
def test_bitmaps_never_bound_too_low(seed, n):
    r = np.random.default_rng(seed)
    universe = np.unique(r.integers(0, 1 << 63, 2 * n, dtype=np.uint64))
    x, y = (r.permutation(universe)[:n] for _ in range(2))
    a, b = (np.frombuffer(ngram_join.bitmap(t), np.uint64) for t in (x, y))
    assert len(np.intersect1d(x, y)) <= len(x) - int(np.bitwise_count(a & ~b).sum())


def test_unique_ids_need_no_second_look_at_their_texts(docs, monkeypatch):
    """Only of rows that repeat an id may one have another set than the class it stands for; empty rows count too."""
    rows = near_copies(4)
    expected = brute([(i, t) for i, (_, t) in enumerate(rows)], 80)

    def refused(batches):
        raise AssertionError("texts were looked at again")

    looked = ngram_join._own_sets
    monkeypatch.setattr(ngram_join, "_own_sets", refused)
    assert found(docs(*((i, t) for i, (_, t) in enumerate(rows)))) == expected
    monkeypatch.setattr(ngram_join, "_own_sets", looked)
    repeated = [(i, t) for i, (_, t) in enumerate(rows)] + [(0, None), (1, " ")]
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(docs(*repeated)).collect()]
    assert sorted(got) == sorted([(i, n, c) for i, (n, c) in expected.items()] + [(0, 0, 0), (1, 0, 1)])


def test_a_range_is_counted_in_slices():
    """Levels as if all were counted at once, in little more memory than the tokens, counts and levels themselves."""
    r = np.random.default_rng(5)
    tokens = [np.unique(r.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32)) for n in [60_000] * 30 + [1, 0, 7]]
    tokens += [np.sort(r.permutation(t)[: len(t) // 2]) for t in tokens]
    counts = [r.integers(1, 9, len(t)).astype(np.uint32) for t in tokens]
    sent = pa.table(
        {
            "batch": list(range(len(tokens))),
            "range": [3] * len(tokens),
            "tokens": pa.array([t.tobytes() for t in tokens], pa.binary()),
            "counts": pa.array([zlib.compress(c.tobytes(), 1) for c in counts], pa.binary()),
        }
    )
    tracemalloc.start()
    got = ngram_join._level_range(sent)
    held = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    values, which = np.unique(np.concatenate(tokens), return_inverse=True)
    levels = ngram_join.level(np.bincount(which, weights=np.concatenate(counts)))[which]
    assert got.column("batch").to_pylist() == list(range(len(tokens)))
    assert b"".join(zlib.decompress(b) for b in got.column("levels").to_pylist()) == levels.tobytes()
    assert held < 60


def test_sets_of_a_batch_are_made_in_slices(monkeypatch):
    r = np.random.default_rng(6)
    texts = [" ".join(f"w{x}" for x in r.integers(0, 100_000, 500)) for _ in range(2500)]
    places, counts = np.unique(ngram_join._places(np.concatenate(ngram_join.shingle_sets(texts)), 4), return_counts=True)
    made, make = [], ngram_join.shingle_sets
    monkeypatch.setattr(ngram_join, "shingle_sets", lambda t: made.append(len(t)) or make(t))
    got = ngram_join._count_batch(4, pa.table({"batch": pa.array([5] * len(texts), pa.int64()), "text": texts}))
    assert sum(made) == len(texts) and max(made) == ngram_join.SLICE
    assert got.column("range").to_pylist() == [0, 1, 2, 3]
    assert b"".join(got.column("tokens").to_pylist()) == places.astype(np.uint32).tobytes()
    assert b"".join(zlib.decompress(b) for b in got.column("counts").to_pylist()) == counts.astype(np.uint32).tobytes()
