"""Near-duplicate documents by b-bit MinHash.

A document's set is its distinct 5-word shingles. Of 160 minima the whole values make
40 band keys of four; only the low 4 bits of each are kept as a packed signature of 80
bytes. Documents that share a band key are candidates. Their similarity is estimated
from the number of equal bit groups, corrected for chance agreement (1 in 16), and
pairs within five standard errors of the threshold or above go on to an exact check on
full shingle sets. A pair at similarity 0.75 shares no band with a chance of 2.5e-7.

No bucket is turned into all its pairs:

1. Equal sets become one class; only classes are compared.
2. Every member of a shared bucket is checked against the smallest member of its
   buckets; the confirmed links give first components.
3. In buckets that still hold several components, members of different components are
   compared by signature, in cells of bounded size: blocks of the most frequent
   component against blocks of the rest, and the rest among itself. Of each cell only
   the members that resemble another get their texts, and are checked against each
   other on full sets; a cell returns the links that join components, not all pairs.

So every pair of different components that shares a bucket is compared, while pairs
inside a component need not be. All stages are joins and aggregations on tables in the
shared folder.

Defined results: a document without words (null, empty or blank text) has an empty set
and is linked with nothing; rows without an id take no part and stay unlinked (null
component, kept); ids are taken to be unique, and of rows that repeat one a single text
is compared; other columns are passed through; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenspan.llm.common import materialize
from lumenspan.operators.graph import components
from lumenspan.llm.shingles import shingle_sets

BANDS, ROWS, BITS = 40, 4, 4
HASHES = BANDS * ROWS
PERCENT = 75
#: Members and text bytes of a block, in expectation; a cell holds two blocks.
BLOCK, BLOCK_BYTES = 256, 8 << 20
SLICE = 256  # texts handled at a time

_random = np.random.default_rng(7)
_FACTORS = _random.integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _random.integers(0, 1 << 63, HASHES, dtype=np.uint64)
_BAND_FACTORS = _random.integers(1, 1 << 63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Equal groups of bits in two bytes, by their exclusive or.
_EQUAL = np.array([(x & 15 == 0) + (x >> 4 == 0) for x in range(256)], dtype=np.uint8)


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """The minima of every non-empty set, a row of HASHES 32-bit numbers each."""
    out = np.empty((len(sets), HASHES), dtype=np.uint64)
    values = np.concatenate(sets)
    starts = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1]))
    hashed = np.empty_like(values)
    for k in range(HASHES):
        np.multiply(values, _FACTORS[k], out=hashed)
        hashed += _SHIFTS[k]
        hashed >>= np.uint64(32)
        out[:, k] = np.minimum.reduceat(hashed, starts)
    return out


def band_keys(low: np.ndarray) -> np.ndarray:
    """A key for each band of each row."""
    mixed = (low.reshape(len(low), BANDS, ROWS) * _BAND_FACTORS).sum(axis=2, dtype=np.uint64)
    return (mixed ^ (mixed >> np.uint64(29))).view(np.int64)


def signatures(low: np.ndarray) -> np.ndarray:
    """The low bits of the minima, two to a byte."""
    bits = (low & np.uint64(15)).astype(np.uint8)
    return bits[:, 0::2] | (bits[:, 1::2] << 4)


def fewest_equal(percent: int = PERCENT) -> int:
    """Equal bit groups that a pair at the threshold has at least, but for a chance below 1e-6."""
    similar = percent / 100
    p = similar + (1 - similar) / (1 << BITS)
    return math.floor(HASHES * p - 5 * math.sqrt(HASHES * p * (1 - p)))


def estimate(equal: np.ndarray) -> np.ndarray:
    """Similarity from the number of equal bit groups, corrected for chance agreement."""
    chance = 1 / (1 << BITS)
    return np.maximum(0.0, (equal / HASHES - chance) / (1 - chance))


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_shingles", "set_key", "bands", "signature"]
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            part = batch.slice(at, SLICE)
            sets = shingle_sets(part.column(1).to_pylist())
            full = [i for i, s in enumerate(sets) if len(s)]
            bands, packed = [None] * len(sets), [None] * len(sets)
            if full:
                low = minima([sets[i] for i in full])
                for i, b, s in zip(full, band_keys(low), signatures(low), strict=True):
                    bands[i], packed[i] = b, s.tobytes()
            keys = [hashlib.md5(s.tobytes()).digest() if len(s) else None for s in sets]
            sizes = pa.array([len(s) for s in sets], pa.int64())
            columns = [part.column(0), sizes, pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(packed, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=names)


def _confirm(percent: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept = []
        for at in range(0, batch.num_rows, SLICE):
            part = batch.slice(at, SLICE)
            texts = list(dict.fromkeys(part.column(2).to_pylist() + part.column(3).to_pylist()))
            sets = dict(zip(texts, shingle_sets(texts), strict=True))
            for i, (x, y) in enumerate(zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)):
                a, b = sets[x], sets[y]
                if 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)):
                    common = len(np.intersect1d(a, b, assume_unique=True))
                    if common and 100 * common >= percent * (len(a) + len(b) - common):
                        kept.append(at + i)
        yield batch.select(["a", "b"]).take(pa.array(kept, pa.int64()))


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough."""
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    kind = pairs.schema["a"].dataType.simpleString()
    return pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b").mapInArrow(partial(_confirm, percent), f"a {kind}, b {kind}")


def _similar(fewest: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each cell, the members that resemble one of another component.

    A pair counts in the first band that it shares, so later bands don't repeat it.
    """
    for batch in batches:
        kept: list[tuple[int, int]] = []
        band, i, j = (batch.column(k).to_pylist() for k in (0, 2, 3))
        lists = batch.column(4)
        bounds, members = lists.offsets.to_numpy(), lists.values
        component, side = (members.field(k).to_numpy() for k in (1, 2))
        packed = np.frombuffer(b"".join(members.field(3).to_pylist()), dtype=np.uint8).reshape(-1, HASHES // 2)
        keys = members.field(4).flatten().to_numpy().reshape(-1, BANDS)
        for cell, (lo, hi) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
            rows = np.arange(lo, hi)
            same, before = i[cell] == j[cell], band[cell]
            left, right = (rows, rows) if same else (rows[side[lo:hi] == 0], rows[side[lo:hi] == 1])
            like = np.zeros(hi - lo, dtype=bool)
            for x in left:
                others = right[right > x] if same else right
                others = others[component[others] != component[x]]
                if not len(others):
                    continue
                others = others[_EQUAL[packed[others] ^ packed[x]].sum(axis=1, dtype=np.int64) >= fewest]
                others = others[~(keys[others, :before] == keys[x, :before]).any(axis=1)]
                if len(others):
                    like[others - lo] = like[x - lo] = True
            kept += [(cell, r) for r in rows[like]]
        cells, rows = pa.array([c for c, _ in kept], pa.int64()), pa.array([r for _, r in kept], pa.int64())
        columns = [batch.column(k).take(cells) for k in range(4)] + [members.field(k).take(rows) for k in range(3)]
        yield pa.RecordBatch.from_arrays(columns, names=["band", "key", "i", "j", "id", "component", "side"])


def _link_cell(percent: int, same: bool, ids: list, component: list, side: list, sets: list[np.ndarray]) -> Iterator[tuple]:
    """Links between members of different components, but none within what earlier ones have joined."""
    _, codes = np.unique(np.concatenate(sets), return_inverse=True)
    sizes = np.array([len(s) for s in sets])
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    number = {c: n for n, c in enumerate(dict.fromkeys(component))}
    joined = np.array([number[c] for c in component])
    sides = np.array(side)
    marks = np.zeros(int(codes.max()) + 1, dtype=bool)
    for x in range(len(ids)) if same else np.flatnonzero(sides == 0):
        others = joined != joined[x]
        if not same:
            others &= sides == 1
        if not others.any():
            continue
        own = codes[starts[x] : starts[x] + sizes[x]]
        marks[own] = True
        common = np.add.reduceat(marks[codes], starts, dtype=np.int64)
        marks[own] = False
        for y in np.flatnonzero(others & (100 * common >= percent * (sizes + sizes[x] - common))):
            if joined[y] != joined[x]:
                joined[joined == joined[y]] = joined[x]
                yield ids[x], ids[y]


def _link_cells(percent: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by cell; a cell is held whole, and has at most some 2 * BLOCK rows and 2 * BLOCK_BYTES of text."""
    held: list[dict] = []

    def linked() -> pa.RecordBatch:
        sets = shingle_sets([r["text"] for r in held])
        same = held[0]["i"] == held[0]["j"]
        pairs = list(_link_cell(percent, same, *([r[k] for r in held] for k in ("id", "component", "side")), sets))
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], id_type) for k in (0, 1)], names=["a", "b"])

    for batch in batches:
        id_type = batch.schema.field("id").type
        for at in range(0, batch.num_rows, SLICE):
            for row in batch.slice(at, SLICE).to_pylist():
                if held and any(row[k] != held[0][k] for k in ("band", "key", "i", "j")):
                    yield linked()
                    held = []
                held.append(row)
    if held:
        yield linked()


def apart_links(members: DataFrame, labels: DataFrame, sketches: DataFrame, texts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Links (a, b) between different components that share a bucket; enough of them to join what belongs together.

    members: (band, key, id); labels: (id, component), for linked ids.
    """
    sizes = texts.select(F.col("doc_id").alias("id"), F.octet_length("text").alias("bytes"))
    placed = members.join(labels, "id", "left").join(sizes, "id").select("band", "key", "id", "bytes", F.coalesce("component", "id").alias("component"))
    per = placed.groupBy("band", "key", "component").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    buckets = per.groupBy("band", "key").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.max(F.struct("n", "component", "bytes")).alias("top"), F.count("*").alias("apart")).where("apart > 1")
    blocks = lambda n, size: F.greatest(F.ceil(n / BLOCK), F.ceil(size / BLOCK_BYTES)).cast("int")
    main_blocks = blocks(F.col("top.n"), F.col("top.bytes"))
    rest_blocks = blocks(F.col("n") - F.col("top.n"), F.col("bytes") - F.col("top.bytes"))
    buckets = buckets.select("band", "key", F.col("top.component").alias("main"), main_blocks.alias("main_blocks"), rest_blocks.alias("rest_blocks"))
    dealt = placed.join(buckets, ["band", "key"]).withColumn("is_main", F.col("component") == F.col("main"))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("id"), F.when(F.col("is_main"), F.col("main_blocks")).otherwise(F.col("rest_blocks"))).cast("int"))
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    cell = lambda i, j, side: F.struct(i.alias("i"), j.alias("j"), side.alias("side"))
    block, main = F.col("block"), F.lit(-1)
    # Cells of the main component against the rest have i < 0: the main block is -1 - i.
    against = F.transform(upto("rest_blocks"), lambda j: cell(main - block, j, F.lit(0)))
    for_main = F.transform(upto("main_blocks"), lambda i: cell(main - i, block, F.lit(1)))
    for_rest = F.transform(upto("rest_blocks"), lambda k: cell(F.least(block, k), F.greatest(block, k), F.when(block <= k, 0).otherwise(1)))
    cells = F.explode(F.when(F.col("is_main"), against).otherwise(F.concat(for_main, for_rest)))
    dealt = dealt.select("band", "key", "id", "component", cells.alias("cell"))
    signed = dealt.join(sketches.select(F.col("doc_id").alias("id"), "signature", "bands"), "id")
    keys = [F.col("band"), F.col("key"), F.col("cell.i").alias("i"), F.col("cell.j").alias("j")]
    grouped = signed.groupBy(*keys).agg(F.collect_list(F.struct("id", "component", "cell.side", "signature", "bands")).alias("members"))
    id_type = members.schema["id"].dataType.simpleString()
    rows = f"band int, key long, i int, j int, id {id_type}, component {id_type}, side int"
    alike = materialize(grouped.select("band", "key", "i", "j", "members").mapInArrow(partial(_similar, fewest_equal(percent)), rows), "minhash-alike")
    order = ["band", "key", "i", "j"]
    with_text = alike.join(texts.select(F.col("doc_id").alias("id"), "text"), "id").select(*order, "id", "component", "side", "text")
    return with_text.repartition(*order).sortWithinPartitions(*order).mapInArrow(partial(_link_cells, percent), f"a {id_type}, b {id_type}")


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id, kept), one for each row of ``docs``."""
    sketches = materialize(docs.select("doc_id", "text").mapInArrow(_sketch, _sketch_schema(docs)), "minhash-sketches")
    named = sketches.where("doc_id IS NOT NULL AND set_key IS NOT NULL")
    # Written first, so that the join on a hot set is dealt anew and Spark can split it.
    classes = materialize(named.groupBy("set_key").agg(F.min("doc_id").alias("class_id")), "minhash-classes")
    rows = materialize(sketches.select("doc_id", "n_shingles", "set_key").join(classes, "set_key", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("class_id")).alias("class_id")), "minhash-rows")
    first_of_class = rows.where("doc_id = class_id").select("doc_id").distinct()
    repeats = not named.groupBy("doc_id").count().where("count > 1").isEmpty()
    once = lambda df: df.dropDuplicates(["doc_id"]) if repeats else df
    chosen = named.join(first_of_class, "doc_id", "left_semi").select("doc_id", "bands", "signature")
    banded = once(chosen).select(F.col("doc_id").alias("id"), F.posexplode("bands").alias("band", "key"))
    buckets = banded.groupBy("band", "key").agg(F.min("id").alias("center"), F.count("*").alias("n")).where("n > 1").drop("n")
    members = materialize(banded.join(buckets, ["band", "key"]).select("band", "key", "id", "center"), "minhash-members")
    ids = members.select(F.col("id").alias("doc_id")).distinct()
    texts = materialize(once(docs.where("doc_id IS NOT NULL").select("doc_id", "text").join(ids, "doc_id", "left_semi")), "minhash-texts")
    signed = materialize(once(sketches.select("doc_id", "signature", "bands").join(ids, "doc_id", "left_semi")), "minhash-signatures")

    to_center = members.where("id <> center").groupBy("id").agg(F.min("center").alias("b")).select(F.col("id").alias("a"), "b")
    links = materialize(confirmed(to_center, texts, percent), "minhash-links")
    labels = materialize(components(links), "minhash-labels")
    more = materialize(apart_links(members, labels, signed, texts, percent), "minhash-links")
    if not more.isEmpty():
        labels = materialize(components(links.union(more)), "minhash-labels")
    joined = rows.join(labels.withColumnRenamed("id", "class_id"), "class_id", "left")
    component = F.coalesce("component", "class_id", "doc_id").alias("component_id")
    return joined.select("doc_id", "n_shingles", component, F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _sketch_schema(docs: DataFrame) -> str:
    return f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_shingles long, set_key binary, bands array<long>, signature binary"


def deduplicate(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One document of each group: the one with the smallest id. Columns unchanged; rows without an id stay.

    Of rows that repeat an id and a text, the first in the order of all columns stays;
    rows that repeat an id with another text all do.
    """
    kept = near_duplicates(docs, percent).where("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    own = docs.join(kept, "doc_id", "left_semi").select(docs.columns)
    repeated = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 AND doc_id IS NOT NULL").select("doc_id")
    if not repeated.isEmpty():
        rows = own.join(repeated, "doc_id", "left_semi").select(F.struct(*docs.columns).alias("row_"))
        once = rows.groupBy("row_.doc_id", "row_.text").agg(F.min("row_").alias("row_")).select("row_.*").select(docs.columns)
        own = own.join(repeated, "doc_id", "left_anti").select(docs.columns).unionByName(once)
    return own.unionByName(docs.where("doc_id IS NULL"))
