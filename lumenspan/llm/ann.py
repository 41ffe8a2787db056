"""Nearest neighbours by inner product with randomly rotated one-bit codes.

Vectors are taken relative to their mean, scaled to length one and turned by a fixed
random rotation into a space of ``code_bits`` dimensions; the signs there are the code,
packed to bits. Two scalars a vector, its distance from the mean and the product of
code and vector, turn the product of a code and a rotated query into an estimate of the
true product, with a bound on its error that shrinks with the square root of the number
of bits. A query is rounded to four bits a dimension, so its product with a code is a
weighted sum of the bit counts of four conjunctions; the rounding is part of the bound.

The rows with the best estimates are scored first; the k-th best of their scores is
beaten or met by every true neighbour. A row whose upper bound reaches it is reranked
with its original vector in double precision; all others are left out by their codes.

Queries and candidates meet in blocks of bounded bytes: each pair of a query block and
a candidate block is one group, so no task holds all of either table. Every group
returns the best k of each of its queries as one row, and those rows are merged by
query. Each row is sent once for each query block, so the rows sent are those of the
table times the number of queries over ``QUERIES``: the search is exhaustive, as vectors
spread evenly over the sphere leave nothing to prune without losing neighbours.

Defined results: vectors that are null, zero, or hold null, NaN or infinite components
take no part; neither do rows without an id; a vector shorter than the longest counts
as ending in zeros; ties go to the smaller id; a query never finds a row with its own
id; with fewer candidates than k, all are returned; repeated ids are candidates each,
as queries the one with the smallest vector is taken; empty tables give no rows.
"""

from __future__ import annotations

import math
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenspan.llm.common import materialize

K = 20
#: Standard errors of the bounds; beyond this a neighbour is missed with a chance of 0.0014.
BOUND = 3.0
CANDIDATES, QUERIES = 65_536, 65_536  # rows of a block at most, in expectation
BLOCK_BYTES = 64 << 20
LEAST_BLOCKS = 8
STEP = 8  # queries estimated at a time
LEAST_BITS = 256
PLANES = 4  # bits of a rounded query component
SEED = 3


def code_bits(dim: int) -> int:
    return max(LEAST_BITS, 64 * math.ceil(dim / 64))


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    """The first rows of a random orthogonal matrix: turns vectors into ``code_bits(dim)`` dimensions."""
    n = code_bits(dim)
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(n, n)))
    return (q * np.sign(np.diag(r)))[:dim]


def usable(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows (vec_id, v) that take part."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = rows.where(v.isNotNull() & F.col("vec_id").isNotNull()).where(finite & F.exists(v, lambda x: x != 0))
    return good.select("vec_id", v.alias("v"))


def padded(rows: DataFrame, dim: int) -> DataFrame:
    zero = F.lit(0).cast(rows.schema["v"].dataType.elementType)
    return rows.select("vec_id", F.slice(F.concat("v", F.array_repeat(zero, F.lit(dim) - F.size("v"))), 1, dim).alias("v"))


def _vectors(column, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _encode(turn: np.ndarray, mean: np.ndarray, batches):
    names = ["vec_id", "v", "code", "far", "along"]
    bits = turn.shape[1]
    for batch in batches:
        rest = _vectors(batch.column(1), len(mean)) - mean
        far = np.linalg.norm(rest, axis=1)
        turned = rest @ turn / np.where(far > 0, far, 1.0)[:, None]
        along = np.abs(turned).sum(axis=1) / math.sqrt(bits)  # the code times its own vector
        codes = pa.array([x.tobytes() for x in np.packbits(turned >= 0, axis=1, bitorder="little")], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), codes, pa.array(far), pa.array(along)], names=names)


def build_index(rows: DataFrame, vector: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """The codes of all usable rows (vec_id, v, code, far, along), written once, and the mean."""
    good = usable(rows, vector)
    dim = good.agg(F.max(F.size("v"))).first()[0] or 1
    good = padded(good, dim)
    means = good.agg(*[F.avg(F.get("v", F.lit(i)).cast("double")) for i in range(dim)]).first()
    mean = np.round(np.array([x or 0.0 for x in means]), 9)
    kinds = {n: good.schema[n].dataType.simpleString() for n in ("vec_id", "v")}
    coded = good.mapInArrow(partial(_encode, rotation(dim), mean), f"vec_id {kinds['vec_id']}, v {kinds['v']}, code binary, far double, along double")
    return materialize(coded, "ann-index"), mean


def exact_scores(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products, added up component by component."""
    total = np.zeros(len(vectors))
    for i in range(vectors.shape[1]):
        total += vectors[:, i] * query[i]
    return total


def query_planes(turned: np.ndarray) -> tuple[np.ndarray, float, float]:
    """A turned query rounded to PLANES bits: its bit planes as words, the least value and the step."""
    least, most = float(turned.min()), float(turned.max())
    step = (most - least) / ((1 << PLANES) - 1) or 1.0
    rounded = np.rint((turned - least) / step).astype(np.uint8)
    planes = np.packbits((rounded >> np.arange(PLANES, dtype=np.uint8)[:, None]) & 1, axis=1, bitorder="little")
    return planes.view(np.uint64), least, step


def code_products(words: np.ndarray, ones: np.ndarray, planes: np.ndarray, least: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Products of all codes (words by rows) with rounded queries (query, plane, word), by counting bits."""
    bits = 64 * len(words)
    weights = 1 << np.arange(PLANES)
    counts = np.zeros((len(planes), PLANES, words.shape[1]), dtype=np.uint16)
    for w, word in enumerate(words):
        counts += np.bitwise_count(word & planes[:, :, w, None])
    weighted = (weights.astype(np.float32)[:, None] * counts).sum(axis=1)
    total = step * (np.bitwise_count(planes).sum(axis=2, dtype=np.int64) @ weights) + least * bits
    return (2 * (step[:, None] * weighted + least[:, None] * ones) - total[:, None]) / math.sqrt(bits)


def best_of(ids: np.ndarray, vectors: np.ndarray, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k rows of the largest products, ties to smaller ids: summed exactly for those that plain products put near the k-th."""
    plain = vectors @ query
    if len(plain) > k:
        reached = np.partition(plain, len(plain) - k)[len(plain) - k]
        near = np.flatnonzero(plain >= reached - 1e-9 * (1 + abs(reached)))
    else:
        near = np.arange(len(plain))
    scores = exact_scores(vectors[near], query)
    order = np.lexsort((ids[near], -scores))[:k]
    return ids[near][order], scores[order]


def _search(k: int, bound: float, turn: np.ndarray, mean: np.ndarray, left: pa.Table, right: pa.Table) -> pa.Table:
    dim, bits = turn.shape
    kind = pa.list_(pa.struct([("vec_id", pa.int64()), ("score", pa.float64())]))
    if not left.num_rows or not right.num_rows:
        return pa.table({"query_id": pa.array([], pa.int64()), "found": pa.array([], kind)})
    ids = left.column("vec_id").to_numpy()
    flat = left.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    far, along = left.column("far").to_numpy(), left.column("along").to_numpy()
    words = np.ascontiguousarray(np.frombuffer(b"".join(left.column("code").to_pylist()), dtype=np.uint64).reshape(len(ids), -1).T)
    ones = np.bitwise_count(words).sum(axis=0, dtype=np.int64)
    toward = flat @ mean
    safe = np.where(along > 0, along, 1.0)
    scale = far / safe
    # What the code leaves out of a vector, as an error for a query of length one.
    spread = bound * np.sqrt(np.maximum(0.0, 1 - along**2) / max(1, bits - 1)) * scale
    out_q, out_rows = [], []
    asked, queries = right.column("vec_id").to_pylist(), _vectors(right.column("v").combine_chunks(), dim)
    for at in range(0, len(asked), STEP):
        some = queries[at : at + STEP]
        rest = some - mean
        planes, least, step = (np.array(x) for x in zip(*map(query_planes, rest @ turn), strict=True))
        # <o, q> = <o - c, q - c> + <o, c> + <q, c> - <c, c>
        guesses = code_products(words, ones, planes, least, step) * scale + toward + (some @ mean - mean @ mean)[:, None]
        errors = np.linalg.norm(rest, axis=1)[:, None] * spread + (bound / math.sqrt(12) * step)[:, None] * scale + 1e-6 * (1 + np.abs(some).sum(axis=1))[:, None]
        for own, q, guess, error in zip(asked[at : at + STEP], some, guesses, errors, strict=True):
            others = ids != own
            near = np.flatnonzero(others)
            if not len(near):
                continue
            if len(near) > 2 * k:
                guess[~others] = -np.inf
                first = np.argpartition(guess, len(guess) - 2 * k)[-2 * k :]
                reached = np.sort(flat[first].astype(np.float64) @ q)[k]
                near = np.flatnonzero(others & (guess + error >= reached))
            found, scores = best_of(ids[near], flat[near].astype(np.float64), q, k)
            out_q.append(own)
            out_rows.append([{"vec_id": int(i), "score": float(x)} for i, x in zip(found, scores, strict=True)])
    return pa.table({"query_id": pa.array(out_q, pa.int64()), "found": pa.array(out_rows, kind)})


def search(rows: DataFrame, queries: DataFrame, k: int = K, bound: float = BOUND, vector: str = "embedding") -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the k nearest rows found for every query (vec_id, embedding)."""
    index, mean = build_index(rows, vector)
    asked = padded(usable(queries, vector), len(mean)).groupBy("vec_id").agg(F.min("v").alias("v"))
    n_rows, n_asked = index.count(), asked.count()
    most = max(1, BLOCK_BYTES // (8 * len(mean)))
    blocks = max(LEAST_BLOCKS, math.ceil(n_rows / min(CANDIDATES, most)))
    query_blocks = max(1 if n_asked < LEAST_BLOCKS * STEP else 2, math.ceil(n_asked / min(QUERIES, most)))
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # The row's number is hashed too, so that rows of one id don't all fall into one block.
    left = index.withColumn("block", F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(blocks)).cast("int")).withColumn("query_block", upto(query_blocks))
    right = asked.withColumn("query_block", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(query_blocks)).cast("int")).withColumn("block", upto(blocks))
    met = left.groupBy("block", "query_block").cogroup(right.groupBy("block", "query_block"))
    found = met.applyInArrow(partial(_search, k, bound, rotation(len(mean)), mean), "query_id long, found array<struct<vec_id:long,score:double>>")
    best = F.slice(F.array_sort(F.flatten(F.collect_list("found")), lambda a, b: F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).when(a["vec_id"] < b["vec_id"], -1).otherwise(1)), 1, k)
    merged = found.groupBy("query_id").agg(best.alias("best"))
    return merged.select("query_id", F.posexplode("best").alias("place", "x")).select("query_id", (F.col("place") + 1).cast("int").alias("rank"), "x.vec_id", "x.score")
