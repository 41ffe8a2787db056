"""Documents whose sets of word n-grams overlap by Jaccard, by token-combination prefixes.

A document's set is its distinct 5-word shingles, here called tokens. Two sets x and y at
the threshold share at least ``least(x)`` tokens, so x lacks at most ``len(x) - least(x)``
of its tokens in y.

1. Equal sets become one node. All tokens of all nodes are counted exactly: batches of
   nodes send each range of token hashes their tokens and counts, and get back a level
   (a quarter of a power of two of the token's frequency). Tokens are ordered by level,
   then hash, the rarest first.
2. Tokens found in few nodes are indexed alone, frequent ones only in pairs and very
   frequent ones in threes, of the same hashed group. The prefix of a set is extended
   until it holds ``len(x) - least(x) + 1`` tokens, not counting the first one of every
   group of pairs and the first two of every group of threes. If two sets shared no
   index entry, one of them would lack that many of its prefix in the other; so any two
   sets at the threshold share an entry, whatever the classes are. The number of groups
   follows the size of the sets, in powers of two; a set that may have a partner in the
   next power is indexed for both. Tokens found in one node only count for the prefix but
   need no entry, so most documents have none at all.
3. Entries with the same members are one. Every member of an entry is compared with the
   smallest node that it most often meets there, on full sets; the links give first
   components.
4. Entries that still hold several components are compared in cells of bounded size:
   members that may be the smaller one of a pair against all of another component. A
   node with u tokens of its own can only meet sets of a size that follows from u, and a
   bitmap of its other tokens bounds what it shares with another from above, so documents
   that share much, but not enough, drop out. In each round every component of a cell
   proposes one pair, which is confirmed on full sets, and components are joined; when
   rounds find no more links, or after ``ROUNDS``, all pairs that are still apart and
   within the bounds are confirmed.

So no link between different components is lost, and no entry is turned into all its
pairs. Frequencies only steer the order; the hashed counts may join tokens, which costs
time at worst. Full sets are compared by 64-bit hashes of shingles.

Defined results: a document without words (null, empty or blank text) has an empty set and
is linked with nothing; rows without an id take no part (null component); rows that repeat
an id are rows of their own, with one component if their sets are equal; other columns are
dropped; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenspan.llm.common import materialize, shuffle_partitions
from lumenspan.llm.minhash import confirmed
from lumenspan.llm.shingles import mix, shingle_sets
from lumenspan.operators.graph import components

PERCENT = 80
#: Bytes of text of a batch, and tokens of a range of hashes, in expectation.
BATCH_BYTES, RANGE_TOKENS = 8 << 20, 4 << 20
#: Nodes that hold a token: up to the first it is indexed alone, up to the second in pairs.
ALONE, IN_PAIRS = 16, 1024
#: Members of a block; a cell holds two.
BLOCK = 256
#: Bits of the map of a node's tokens, and rounds in which components propose one pair each.
BITS, ROUNDS = 2048, 5
#: Texts, and tokens of a range, that are handled at a time.
SLICE, COUNTED = 256, 1 << 19

_LOW = np.uint64(0xFFFFFFFF)
_FACTORS = np.random.default_rng(11).integers(1, 1 << 63, 4, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def least(n: int, percent: int = PERCENT) -> int:
    """Tokens that a set of n shares with any partner."""
    return -(-percent * n // 100)


def level(count: np.ndarray) -> np.ndarray:
    """A quarter of a power of two; 0 for a token of one node only."""
    return np.minimum(255, np.floor(4 * np.log2(count))).astype(np.uint8)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            part = batch.slice(at, SLICE)
            sets = shingle_sets(part.column(1).to_pylist())
            keys = [hashlib.md5(s.tobytes()).digest() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary())], names=["doc_id", "n_shingles", "set_key"])


def _own_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (node, set_key, text) those whose text has that set."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            part = batch.slice(at, SLICE)
            keys = [hashlib.md5(s.tobytes()).digest() for s in shingle_sets(part.column(2).to_pylist())]
            yield part.filter(pa.array([k == own for k, own in zip(keys, part.column(1).to_pylist(), strict=True)], pa.bool_())).select(["node", "text"])


def _slices(texts: pa.ChunkedArray) -> Iterator[list[np.ndarray]]:
    """The sets of a batch's texts, for a slice at a time, so that words and places of a slice only are held."""
    for at in range(0, len(texts), SLICE):
        yield shingle_sets(texts.slice(at, SLICE).to_pylist())


def _places(tokens: np.ndarray, ranges: int) -> np.ndarray:
    """Range and place of tokens, as one number that sorts by range."""
    return (((tokens >> np.uint64(32)) % np.uint64(ranges)) << np.uint64(32)) | (tokens & _LOW)


def _count_batch(ranges: int, table: pa.Table) -> pa.Table:
    """The tokens of a batch and their counts, one row for each range."""
    places, counts = np.unique(np.concatenate([_places(np.concatenate(sets), ranges) for sets in _slices(table.column("text"))]), return_counts=True)
    found, starts = np.unique(places >> np.uint64(32), return_index=True)
    ends = [*starts[1:], len(places)]
    tokens = (places & _LOW).astype(np.uint32)
    counts = np.minimum(counts, 0xFFFFFFFF).astype(np.uint32)
    return pa.table(
        {
            "batch": pa.array([table.column("batch")[0].as_py()] * len(found), pa.int64()),
            "range": pa.array(found.astype(np.int64)),
            "tokens": pa.array([tokens[a:b].tobytes() for a, b in zip(starts, ends, strict=True)], pa.binary()),
            "counts": pa.array([zlib.compress(counts[a:b].tobytes(), 1) for a, b in zip(starts, ends, strict=True)], pa.binary()),
        }
    )


def _level_range(table: pa.Table) -> pa.Table:
    """The levels of a range's tokens, for each batch in the order it sent them, which is theirs by value.

    Some COUNTED tokens are counted at a time: those between two values, of all batches.
    """
    tokens = [np.frombuffer(b.as_buffer(), np.uint32) for b in table.column("tokens")]
    counts = [np.frombuffer(zlib.decompress(b.as_buffer()), np.uint32) for b in table.column("counts")]
    levels = [np.empty(len(t), np.uint8) for t in tokens]
    parts = math.ceil(sum(map(len, tokens)) / COUNTED)
    limits = (np.arange(1, parts, dtype=np.uint64) * np.uint64(1 << 32) // np.uint64(parts)).astype(np.uint32)
    cuts = [[0, *np.searchsorted(t, limits), len(t)] for t in tokens]
    for k in range(parts):
        within = [slice(c[k], c[k + 1]) for c in cuts]
        _, which = np.unique(np.concatenate([t[w] for t, w in zip(tokens, within, strict=True)]), return_inverse=True)
        found = level(np.bincount(which, weights=np.concatenate([n[w] for n, w in zip(counts, within, strict=True)])))[which]
        at = 0
        for own, w in zip(levels, within, strict=True):
            own[w] = found[at : at + w.stop - w.start]
            at += w.stop - w.start
    return pa.table({"batch": table.column("batch"), "range": table.column("range"), "levels": pa.array([zlib.compress(own, 1) for own in levels], pa.binary())})


def groups(size_class: int, percent: int) -> tuple[int, int]:
    """Groups of pairs and of threes for sets of a size from 2**size_class; what they leave uncounted is below ``least``."""
    spare = least(least(1 << size_class, percent), percent) - 1
    return int(0.4 * spare), int(0.3 * spare)


def entries(tokens: np.ndarray, levels: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The index entries of a set (tokens and their levels); none if it has no partner."""
    n = len(tokens)
    need = n - least(n, percent) + 1
    if n * (100 - percent) < percent:  # one more token breaks the link, so only an equal set could have it
        return np.zeros(0, np.uint64)
    need -= int(np.count_nonzero(levels == 0))
    if need <= 0:
        return np.zeros(0, np.uint64)
    order = np.lexsort((tokens, levels))
    order = order[levels[order] > 0]
    tokens, levels = tokens[order], levels[order]
    size_class = n.bit_length() - 1
    classes = [size_class] if 100 * n // percent < 2 << size_class else [size_class, size_class + 1]
    return np.unique(np.concatenate([_class_entries(tokens, levels, need, c, percent) for c in classes]))


def _class_entries(tokens: np.ndarray, levels: np.ndarray, need: int, size_class: int, percent: int) -> np.ndarray:
    pairs, threes = groups(size_class, percent)
    width = np.ones(len(tokens), dtype=np.int64)
    if pairs:
        width[levels > level(np.array([ALONE]))[0]] = 2
    if threes:
        width[levels > level(np.array([IN_PAIRS]))[0]] = 3
    spread = mix(tokens * _FACTORS[3])
    group = np.zeros(len(tokens), dtype=np.int64)
    for w, n in ((2, pairs), (3, threes)):
        chosen = width == w
        group[chosen] = (spread[chosen] % np.uint64(n or 1)).astype(np.int64) * 4 + w
    # The place of a token among those of its group, in order.
    by_group = np.argsort(group, kind="stable")
    opens = np.concatenate(([True], group[by_group][1:] != group[by_group][:-1]))
    starts = np.flatnonzero(opens)
    place = np.empty(len(tokens), dtype=np.int64)
    place[by_group] = np.arange(len(tokens)) - np.repeat(starts, np.diff([*starts, len(tokens)]))
    counted = np.cumsum((place >= width - 1) | (width == 1))
    prefix = slice(0, int(np.searchsorted(counted, need)) + 1)
    tokens, group, width = tokens[prefix], group[prefix], width[prefix]
    salt = np.uint64(size_class)
    out = [mix(tokens[width == 1] * _FACTORS[0] + salt)]
    many = np.flatnonzero(width > 1)
    many = many[np.lexsort((tokens[many], group[many]))]
    t, g, w = tokens[many], group[many], width[many]
    largest = int(np.bincount(g).max()) if len(g) else 0
    for d in range(1, largest):
        same = np.flatnonzero(g[:-d] == g[d:]) if d < len(g) else np.zeros(0, np.int64)
        if not len(same):
            break
        two = same[w[same] == 2]
        out.append(mix(t[two] * _FACTORS[0] + mix(t[two + d] * _FACTORS[1]) + salt))
        three = same[w[same] == 3]
        for between in range(1, d):
            out.append(mix(t[three] * _FACTORS[0] + mix(t[three + between] * _FACTORS[1] + mix(t[three + d] * _FACTORS[2])) + salt))
    return np.concatenate(out)


def bitmap(tokens: np.ndarray) -> bytes:
    """The bits that tokens hash to."""
    bits = np.zeros(BITS, dtype=bool)
    bits[(mix(tokens * _FACTORS[2]) % np.uint64(BITS)).astype(np.int64)] = True
    return np.packbits(bits).tobytes()


def _index_batch(ranges: int, percent: int, nodes: pa.Table, levels: pa.Table) -> pa.Table:
    """Rows (node, n, own, bits, entries) of a batch, for nodes that have entries."""
    out: list[tuple] = []
    if nodes.num_rows:
        sets = [s for part in _slices(nodes.column("text")) for s in part]
        places = _places(np.concatenate(sets), ranges)
        _, which = np.unique(places, return_inverse=True)
        by_range = sorted(zip(levels.column("range").to_pylist(), levels.column("levels").to_pylist(), strict=True))
        known = np.concatenate([np.frombuffer(zlib.decompress(b), np.uint8) for _, b in by_range])[which]
        cuts = np.cumsum([len(s) for s in sets])[:-1]
        for node, tokens, own in zip(nodes.column("node").to_pylist(), sets, np.split(known, cuts), strict=True):
            found = entries(tokens, own, percent)
            if len(found):
                out.append((node, len(tokens), int(np.count_nonzero(own == 0)), bitmap(tokens[own > 0]), found.view(np.int64)))
    node, n, own, bits, found = zip(*out, strict=True) if out else ((), (), (), (), ())
    return pa.table({"node": pa.array(node, pa.int64()), "n": pa.array(n, pa.int64()), "own": pa.array(own, pa.int64()), "bits": pa.array(bits, pa.binary()), "entries": pa.array(found, pa.list_(pa.int64()))})


def index(texts: DataFrame, n_tokens: int, n_bytes: int, percent: int = PERCENT) -> DataFrame:
    """Rows (node, n, own, bits, entries) of the nodes (node, text) that may have partners.

    own counts tokens of no other node, and bits are the map of the rest.
    """
    ranges = max(1, math.ceil(n_tokens / RANGE_TOKENS))
    batches = max(1, math.ceil(n_bytes / BATCH_BYTES), min(shuffle_partitions(texts.sparkSession), n_bytes >> 16))
    dealt = texts.withColumn("batch", F.pmod(F.xxhash64("node"), F.lit(batches)).cast("long"))
    sent = dealt.groupBy("batch").applyInArrow(lambda t: _count_batch(ranges, t), "batch long, range long, tokens binary, counts binary")
    levels = sent.groupBy("range").applyInArrow(_level_range, "batch long, range long, levels binary")
    return dealt.groupBy("batch").cogroup(levels.groupBy("batch")).applyInArrow(lambda n, v: _index_batch(ranges, percent, n, v), "node long, n long, own long, bits binary, entries array<long>")


def _cell_pairs(percent: int, round_: int | None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each cell the pairs of different components, the smaller one from side 0, that sizes and bitmaps allow.

    In a round every component keeps the most promising of its pairs, later ones with some
    noise so that a pair once refused makes way for others; without a round all are given.
    """
    for batch in batches:
        lists = batch.column(0)
        bounds, members = lists.offsets.to_numpy(), lists.values
        side, node, component, n, most, own = (members.field(k).to_numpy() for k in range(6))
        bits = np.frombuffer(b"".join(members.field(6).to_pylist()), dtype=np.uint64).reshape(-1, BITS // 64)
        shared = n - own
        out = [np.zeros((2, 0), np.int64)]
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            rows = np.arange(lo, hi)
            right = rows[side[lo:hi] == 1]
            found = []
            for x in rows[side[lo:hi] == 0]:
                y = right[(component[right] != component[x]) & (n[right] >= n[x]) & (n[right] <= most[x]) & (most[right] >= n[x]) & (percent * n[right] <= 100 * n[x])]
                common = np.minimum(shared[x] - np.bitwise_count(bits[x] & ~bits[y]).sum(axis=1, dtype=np.int64), shared[y] - np.bitwise_count(~bits[x] & bits[y]).sum(axis=1, dtype=np.int64))
                union = n[x] + n[y] - common
                near = 100 * common >= percent * union
                found.append((np.full(int(near.sum()), x), y[near], common[near] / union[near]))
            if not found:
                continue
            x, y, like = (np.concatenate(part) for part in zip(*found, strict=True))
            if round_ is not None and len(x):
                noise = mix(np.minimum(node[x], node[y]).astype(np.uint64) * _FACTORS[0] + np.maximum(node[x], node[y]).astype(np.uint64) * _FACTORS[1] + np.uint64(round_))
                order = np.argsort(-(like + (round_ > 0) * 0.1 * (noise >> np.uint64(11)) / (1 << 53)), kind="stable")
                x, y = x[order], y[order]
                first = [np.unique(component[side_], return_index=True)[1] for side_ in (x, y)]
                kept = np.unique(np.concatenate(first))
                x, y = x[kept], y[kept]
            out.append(np.unique(np.stack((np.minimum(node[x], node[y]), np.maximum(node[x], node[y]))), axis=1))
        pairs = np.unique(np.concatenate(out, axis=1), axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])


def apart_pairs(members: DataFrame, labels: DataFrame, percent: int = PERCENT, round_: int | None = None) -> DataFrame:
    """Pairs (a, b) of different components that share an entry and may reach the threshold; in a round, some of them.

    members: (entry, node, n, own, bits); labels: (id, component), for linked nodes.
    """
    shared = F.col("n") - F.col("own")
    most = F.floor(((100 + percent) * shared - percent * F.col("n")) / percent).cast("long")
    placed = members.join(labels.withColumnRenamed("id", "node"), "node", "left").select("entry", "node", "n", "own", "bits", most.alias("most"), F.coalesce("component", "node").alias("component"))
    placed = placed.withColumn("small", F.col("most") >= F.col("n"))
    ones = lambda c: F.sum(c.cast("long"))
    per = placed.groupBy("entry", "component").agg(F.count("*").alias("n_"), ones(F.col("small")).alias("small_"))
    whole = per.groupBy("entry").agg(F.count("*").alias("apart"), F.sum("n_").alias("all"), F.sum("small_").alias("smalls"), F.max(F.struct("n_", "component", "small_")).alias("top"))
    whole = whole.where("apart > 1 AND smalls > 0")
    blocks = lambda c: F.greatest(F.lit(1), F.ceil(c / BLOCK)).cast("int")
    whole = whole.select(
        "entry",
        F.col("top.component").alias("main"),
        blocks(F.col("all") - F.col("top.n_")).alias("rest_blocks"),
        blocks(F.col("all")).alias("all_blocks"),
        blocks(F.col("top.small_")).alias("small_main_blocks"),
        blocks(F.col("smalls") - F.col("top.small_")).alias("small_rest_blocks"),
    )
    dealt = placed.join(materialize(whole, "ngram-apart"), "entry").withColumn("is_main", F.col("component") == F.col("main"))
    own_block = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    cell = lambda kind, i, j, side: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), F.lit(side).alias("side"))
    none = F.array().cast("array<struct<kind:int,i:int,j:int,side:int>>")
    # Kind 0: small ones of the main component against the rest; kind 1: small ones of the rest against all.
    small = F.when(F.col("is_main"), F.transform(upto("rest_blocks"), lambda j: cell(0, own_block("small_main_blocks"), j, 0))).otherwise(F.transform(upto("all_blocks"), lambda j: cell(1, own_block("small_rest_blocks"), j, 0)))
    large = F.concat(F.when(F.col("is_main"), none).otherwise(F.transform(upto("small_main_blocks"), lambda i: cell(0, i, own_block("rest_blocks"), 1))), F.transform(upto("small_rest_blocks"), lambda i: cell(1, i, own_block("all_blocks"), 1)))
    dealt = dealt.select("entry", "node", "component", "n", "most", "own", "bits", F.explode(F.concat(F.when(F.col("small"), small).otherwise(none), large)).alias("cell"))
    grouped = dealt.groupBy("entry", "cell.kind", "cell.i", "cell.j").agg(F.collect_list(F.struct("cell.side", "node", "component", "n", "most", "own", "bits")).alias("members"))
    return grouped.select("members").mapInArrow(partial(_cell_pairs, percent, round_), "a long, b long").distinct()


def jaccard_components(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id), one for each row of ``docs``; components of the links at the threshold."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    sketches = materialize(docs.select("doc_id", "text").mapInArrow(_sketch, f"doc_id {id_type}, n_shingles long, set_key binary"), "ngram-sketches")
    named = sketches.where("doc_id IS NOT NULL AND set_key IS NOT NULL")
    classes = named.groupBy("set_key").agg(F.min("doc_id").alias("class_id"), F.first("n_shingles").alias("n"))
    # Written first, so that ids stay and Spark can split the join on a hot set.
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()), "ngram-classes")
    texts = docs.select(F.col("doc_id").alias("class_id"), "text").join(classes.select("class_id", "node", "set_key"), "class_id").select("node", "set_key", "text")
    ids = sketches.where("doc_id IS NOT NULL").select("doc_id")
    if ids.count() > ids.distinct().count():  # else the one row of a class's id has its set
        texts = texts.mapInArrow(_own_sets, "node long, text string").groupBy("node").agg(F.min("text").alias("text"))
    texts = texts.select("node", "text")
    texts = materialize(texts, "ngram-texts")
    sums = classes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], texts.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    indexed = materialize(index(texts, *sums, percent), "ngram-index")

    listed = indexed.select("node", F.explode("entries").alias("entry"))
    print_ = [F.bit_xor(F.xxhash64(F.lit(k), "node")).alias(f"x{k}") for k in (1, 2)]
    buckets = listed.groupBy("entry").agg(F.count("*").alias("members"), F.min("node").alias("center"), *print_).where("members > 1")
    chosen = buckets.groupBy("members", "center", "x1", "x2").agg(F.min("entry").alias("entry")).select("entry", "center")
    members = materialize(listed.join(materialize(chosen, "ngram-chosen"), "entry").select("entry", "node", "center"), "ngram-members")

    met = members.where("node <> center").groupBy("node", "center").agg(F.count("*").alias("times"))
    to_center = met.groupBy("node").agg(F.max_by("center", F.struct("times", -F.col("center"))).alias("b")).select(F.col("node").alias("a"), "b")
    by_node = texts.withColumnRenamed("node", "doc_id")
    links = materialize(confirmed(to_center, by_node, percent), "ngram-links")
    labels = materialize(components(links), "ngram-labels")
    members = members.join(indexed.select("node", "n", "own", "bits"), "node").select("entry", "node", "n", "own", "bits")
    for round_ in (*range(ROUNDS), None):
        pairs = materialize(apart_pairs(members, labels, percent, round_), "ngram-pairs")
        if pairs.isEmpty():
            break
        more = materialize(confirmed(pairs, by_node, percent), "ngram-links")
        if more.isEmpty() and round_ is not None:
            continue
        links = links.union(more)
        labels = materialize(components(links), "ngram-labels")

    known = classes.join(labels.withColumnRenamed("id", "node"), "node", "left").select("set_key", "class_id", F.coalesce("component", "node").alias("component"))
    lowest = known.groupBy("component").agg(F.min("class_id").alias("component_id"))
    named_class = materialize(known.join(lowest, "component").select("set_key", "component_id"), "ngram-components")
    full = sketches.join(named_class, "set_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return full.select("doc_id", "n_shingles", component.alias("component_id"))
