import random
import re

import numpy as np

from lumenspan.llm import minhash
from lumenspan.operators.graph import components
from lumenspan.llm.shingles import shingle_sets


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(docs):
    label = {i: i for i, _ in docs}
    sets = {i: shingles(t) for i, t in docs}

    def find(a):
        while label[a] != a:
            a = label[a]
        return a

    ids = sorted(label)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= 75 * len(sets[x] | sets[y]):
                a, b = find(x), find(y)
                label[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}, {i: len(s) for i, s in sets.items()}


def near_copies(seed, n=160):
    """Texts with copies of all degrees around the threshold, shared passages, and short ones."""
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [r.choice(vocabulary) for _ in range(60)]
    out = []
    for i in range(n):
        if out and r.random() < 0.6:
            w = r.choice(out)[1].split()
            for _ in range(r.randint(0, max(1, len(w) // 14))):
                w[r.randrange(len(w))] = r.choice(vocabulary)
        else:
            w = [r.choice(vocabulary) for _ in range(r.choice((2, 5, 6, 40, 120)))]
            if r.random() < 0.5:
                w += passage
        out.append((i, " ".join(w) if r.random() < 0.8 else "\n".join(w).upper()))
    return out


def check(df, rows):
    found = {r["doc_id"]: r for r in minhash.near_duplicates(df).collect()}
    component, sizes = brute(rows)
    assert {i: r["component_id"] for i, r in found.items()} == component
    assert {i: r["n_shingles"] for i, r in found.items()} == sizes
    assert all(r["kept"] == (i == component[i]) for i, r in found.items())


def test_equals_brute_force(spark, docs):
    rows = near_copies(1)
    check(docs(*rows, extra=True), rows)


def test_buckets_larger_than_a_block(spark, docs, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 7)
    rows = near_copies(2)
    check(docs(*rows), rows)
    monkeypatch.setattr(minhash, "BLOCK", 1024)
    monkeypatch.setattr(minhash, "BLOCK_BYTES", 2000)
    check(docs(*rows), rows)


def test_nulls_empty_and_long_texts(spark, docs):
    long = " ".join(f"x{i % 5000}y{i}" for i in range(60_000))
    df = docs((3, None), (4, ""), (5, " \n"), (6, long), (2, long + " end"), (7, "one two"), (8, "One  TWO"), (9, "a" * 2_000_000), (None, "one two"))
    found = {r["doc_id"]: r for r in minhash.near_duplicates(df).collect()}
    assert [found[i]["component_id"] for i in (3, 4, 5, 6, 7, 8, 9)] == [3, 4, 5, 2, 7, 7, 9]
    assert found[None]["component_id"] is None and found[None]["kept"]
    assert found[3]["n_shingles"] == 0 and found[9]["n_shingles"] == 1


def test_deduplicate_keeps_one_row_a_group(spark, docs):
    df = docs((1, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f"), (5, "other text of its own"), (5, "other text of its own"), (None, "a b c d e f"), (9, ""), extra=True)
    out = minhash.deduplicate(df)
    assert out.columns == df.columns
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in out.collect()) == [(False, 1), (False, 5), (False, 9), (True, 0)]
    assert minhash.deduplicate(df.limit(0)).count() == 0
    two_texts = docs((1, "one text of five words"), (1, "and quite another text here"), (1, "one text of five words"))
    assert minhash.deduplicate(two_texts).count() == 2


def test_shingle_hashes_in_chunks(monkeypatch):
    texts = [t for _, t in near_copies(3, 30)] + ["", "z" * 500, "a  b\tc\x0bd e f"]
    whole = shingle_sets(texts)
    monkeypatch.setattr("lumenspan.llm.shingles.CHUNK", 64)
    for a, b, text in zip(whole, shingle_sets(texts), texts, strict=True):
        assert a.tolist() == b.tolist() and len(a) == len(shingles(text))


def test_estimate_is_corrected_for_chance():
    r = np.random.default_rng(0)
    x = r.integers(0, 1 << 63, 3000, dtype=np.uint64)
    for share in (0.0, 0.5, 0.9):
        n = int(2 * share / (1 + share) * 1500)
        low = minhash.minima([np.unique(x[:1500]), np.unique(np.concatenate((x[1500 - n : 1500], x[1500 : 3000 - n])))])
        a, b = minhash.signatures(low)
        equal = minhash._EQUAL[a ^ b].sum()
        assert abs(minhash.estimate(equal) - share) < 0.15


def test_components_of_chains_stars_and_no_links(spark):
    links = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 50)] + [(7000, 7000)]
    df = spark.createDataFrame(links, "a long, b long")
    found = {r["id"]: r["component"] for r in components(df).collect()}
    assert all(found[i] == 0 for i in range(301)) and all(found[1000 + i] == 1000 for i in range(50)) and 7000 not in found
    assert components(df.limit(0)).count() == 0
