import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lumenspan.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string"


def turn_lists(rows):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            convs[conv].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [x[2:] for x in sorted(t)] for c, t in convs.items()}


def rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20 if c >= 0 else -(abs(c) % 20))
        out[c] = convs.get(base, [])[:h] + own[h:]
    return out


def by_hand(convs):
    """Every node of the trie by walking each conversation."""
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(convs):
        path = tuple(convs[c])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
        ends[path].append(c)
    children = defaultdict(set)
    for p in members:
        if p:
            children[p[:-1]].add(p)
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, m in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(m) - 1) * words
    return {(m[0], len(p)): (members[p[:-1]][0] if p else None, len(m), len(children[p]), leaves[p], saved[p], hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest()) for p, m in members.items()}


def found(nodes):
    rows = nodes.collect()
    out = {(r["conv_id"], r["depth"]): (r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"]) for r in rows}
    assert len(out) == len(rows)
    return out, rows


def random_rows(seed, n=60, deep=40):
    """Conversations that branch at all depths, equal ones, ties, nulls and one of a third of all rows."""
    r = random.Random(seed)
    rows, made = [], {}
    for c in range(-3, n):
        if made and r.random() < 0.75:
            from_ = r.choice(list(made.values()))
            turns = from_[: r.randint(0, len(from_))]
        else:
            turns = []
        turns = turns + [(r.choice(["user", "assistant", None]), r.choice(["a b", "c", "", None, "d  e\nf", "😀"])) for _ in range(r.randint(0, 3))]
        made[c] = turns[:deep] or [("user", "only")]
    made[n] = [("user", f"long {k % 7}") for k in range(sum(map(len, made.values())) // 2)]
    for c, turns in made.items():
        rows += [(c, None if k == 0 and c % 5 == 0 else k, role, text) for k, (role, text) in enumerate(turns)]
    rows += [(0, 0, "user", "tied"), (0, 0, "user", "tied"), (None, 1, "user", "nobody"), (None, None, None, None)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_a_walk(spark, seed):
    rows = random_rows(seed)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("path", F.lit("x")).withColumn("depth", F.lit(3))
    placed = trie.materialize(trie.turns(df), "t")
    plain, nodes = found(trie.prefix_trie(placed.select("conv_id").distinct(), placed))
    assert plain == by_hand(turn_lists(rows))
    # Preorder: numbers are gapless, and an interval lies in its parent's.
    assert sorted(r["first"] for r in nodes) == list(range(1, len(nodes) + 1))
    spans = {(r["conv_id"], r["depth"]): (r["first"], r["last"]) for r in nodes}
    for r in nodes:
        if r["depth"]:
            first, last = spans[r["parent_conv_id"], r["depth"] - 1]
            assert first < r["first"] <= r["last"] <= last


def test_rebuilt_conversations_share_beginnings(spark):
    rows = [row for row in random_rows(5, 90) if row[0] not in (40, 60)]
    convs = rebuilt(turn_lists(rows))
    assert any(not t for t in convs.values()), "some conversation is left without turns"
    placed = trie.materialize(trie.turns(spark.createDataFrame(rows, SCHEMA)), "t")
    assert found(trie.prefix_trie(*trie.restarted(placed)))[0] == by_hand(convs)


def test_no_conversations(spark):
    for rows in ([], [(None, 1, "user", "nobody")]):
        placed = trie.materialize(trie.turns(spark.createDataFrame(rows, SCHEMA)), "t")
        assert trie.prefix_trie(*trie.restarted(placed)).count() == 0


def test_light_steps_stay_few(spark):
    """A thread with a branch at each of 200 turns, and its snapshots: no key grows with the depth."""
    rows = [(c, k, "user", f"t{k}") for c in range(0, 200, 2) for k in range(c)] + [(c, k, "user", f"t{k}" if k < c - 1 else "other") for c in range(1, 200, 2) for k in range(c)]
    placed = trie.materialize(trie.turns(spark.createDataFrame(rows, SCHEMA)), "t")
    assert found(trie.prefix_trie(placed.select("conv_id").distinct(), placed))[0] == by_hand(turn_lists(rows))
