"""Best-fit packing of tokenized documents after dominance reduction.

Documents are tokenized, ended with one id, and cut only where longer than a sequence.
The pieces' lengths form a histogram of at most ``capacity`` entries, which is all that
the plan needs. Dominance reduction (Martello and Toth) takes each length from the
longest down and fixes sets of one to three pieces for good where no other set with
that piece can do better: alone where nothing fits beside it, with an exact partner,
with the longest partner where only one fits, and with one or two partners where at
most two fit and these dominate. What is left is packed by best fit, longest first,
on groups of equal bins.

A piece finds its place by its rank among the pieces of its length: its number within
its partition plus the counts of the partitions before. The plan is broadcast; it has
at most about 60 entries for each distinct length: a group of equal bins is split at
most twice a length, and each time best fit fills it its room at least halves.

Defined results: a null text counts as empty and is one piece of one id; repeated rows
are packed each; an empty table gives no rows; a text of any length is cut, none of it
dropped.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial
from itertools import islice
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType
from pyspark.sql.window import Window
from tokenizers import Tokenizer, normalizers, pre_tokenizers

from lumenspan.llm.common import materialize

CAPACITY = 4096
END_ID = 1
VOCABULARY = "word_bpe_49k.json"
#: Characters of words whose ids a worker remembers before it forgets the older half; some 150 MB.
REMEMBERED = 6_000_000
SLICE = 128  # texts encoded at a time, fewer if they hold more than SLICE_CHARS characters
SLICE_CHARS = 500_000
#: Ids that a task holds before it hands them on.
HELD_IDS = 1_000_000
#: A special token of the vocabulary, used between words.
MARK = "<|startoftext|>"
#: Marks that the tokenizer parts from a letter or digit before them.
CLOSING = ".,!?;:#$%&*"


# ---- tokens -------------------------------------------------------------------------


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordTokenizer:
    """Ids of texts for a vocabulary that drops white space: words are encoded once and remembered.

    Spaces and line feeds part pieces that such a tokenizer never joins, so the ids of a
    text are those of its parts in a row. New words are encoded in one string, parted by
    a special token that no word holds. Words of lower-case letters alone come out of
    the tokenizer's normal form and pattern as they are; for these both are left out, and
    the words' ends are told by the vocabulary's own end marks.
    """

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.letters = Tokenizer.from_file(path)
        self.letters.normalizer = normalizers.Sequence([])
        self.letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends_word[[n for token, n in vocabulary.items() if token.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}
        self.size = 0

    def _parts(self, word: str) -> tuple[str, str]:
        """A word as its lower-cased body and its closing marks, where the tokenizer parts and lowers it likewise."""
        body = word.rstrip(CLOSING)
        if not body or not body[-1].isalnum() or max(body) > "\u024f":
            return word, ""
        lower = body.lower()
        return (lower, word[len(body) :]) if len(lower) == len(body) else (word, "")

    def _encode_letters(self, words: list[str]) -> None:
        ids = np.array(self.letters.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, dtype="<u4")
        ends = (4 * np.flatnonzero(self.ends_word[ids]) + 4).tolist()
        raw = ids.tobytes()
        self.known.update(zip(words, (raw[a:b] for a, b in zip([0, *ends], ends, strict=False)), strict=True))

    def _encode_words(self, words: list[str]) -> None:
        self.size += sum(map(len, words))
        letters = [w for w in words if w.isalpha() and (w.isascii() or max(w) <= "\u024f") and w == w.lower() and is_normalized("NFC", w)]
        if letters:
            self._encode_letters(letters)
            chosen = set(letters)
            words = [w for w in words if w not in chosen]
        if not words:
            return
        odd = [w for w in words if MARK[:2] in w]
        plain = [w for w in words if MARK[:2] not in w]
        whole = self.tokenizer.encode_batch_fast([f" {MARK} ".join(plain), *odd], add_special_tokens=False)
        ids = np.array(whole[0].ids, dtype="<u4")
        cuts = np.flatnonzero(ids == self.tokenizer.token_to_id(MARK))
        raw = ids.tobytes()
        starts, ends = [0, *(4 * cuts + 4).tolist()], [*(4 * cuts).tolist(), len(raw)]
        self.known.update(zip(plain, (raw[a:b] for a, b in zip(starts, ends, strict=True)), strict=bool(plain)))
        for w, e in zip(odd, whole[1:], strict=True):
            self.known[w] = np.array(e.ids, dtype="<u4").tobytes()

    def _learn(self, new: set[str]) -> None:
        parts = {w: self._parts(w) for w in new}
        needed = {x for pair in parts.values() for x in pair if x}
        self._encode_words(sorted(needed.difference(self.known)))
        for word, (body, marks) in parts.items():
            if word not in self.known:
                self.known[word] = self.known.get(body, b"") + self.known.get(marks, b"")
                self.size += len(word)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        words = [t.replace("\n", " ").split(" ") for t in texts]
        all_ = set().union(*words)
        if self.size > REMEMBERED:
            self.known = dict(islice(self.known.items(), len(self.known) // 2, None))
            self.size = sum(map(len, self.known))
        if new := all_.difference(self.known):
            self._learn(new)
        find = self.known.__getitem__
        return [b"".join(map(find, w)) for w in words]


_TOKENIZERS: dict[str, WordTokenizer] = {}


def word_tokenizer(path: str) -> WordTokenizer:
    """One tokenizer a worker process, so that tasks share what it remembers."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


def slices(column: pa.Array) -> Iterator[list[str]]:
    """The texts of a column in runs of at most SLICE and about SLICE_CHARS characters; null counts as empty."""
    run, chars = [], 0
    for value in column:
        text = value.as_py() or ""
        if run and (len(run) == SLICE or chars + len(text) > SLICE_CHARS):
            yield run
            run, chars = [], 0
        run.append(text)
        chars += len(text)
    if run:
        yield run


def _pieces(path: str | None, capacity: int, with_ids: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tokenizer = word_tokenizer(path or vocabulary_path())
    part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, dtype=np.int64)
    step, end = 4 * capacity, np.array([END_ID], dtype="<u4").tobytes()
    for batch in batches:
        rows, out, ids, held = [], [], [], 0

        def packed() -> pa.RecordBatch:
            piece, start, length, crc, nth = np.array(out, dtype=np.int64).reshape(-1, 5).T
            columns = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc), pa.array(np.full(len(rows), part, dtype=np.int64)), pa.array(nth)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "part_", "nth_"]
            if with_ids:
                offsets = np.concatenate(([0], np.cumsum(length))).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), dtype="<i4"))))
                names.append("ids")
            return pa.RecordBatch.from_arrays(columns, names=names)

        coded = (x for texts in slices(batch.column(1)) for x in tokenizer.encode(texts))
        for row, text_ids in enumerate(coded):
            whole = text_ids + end
            for n, at in enumerate(range(0, len(whole), step)):
                raw = whole[at : at + step]
                length = len(raw) // 4
                rows.append(row)
                out.append((n, at // 4, length, zlib.crc32(raw), seen[length]))
                seen[length] += 1
                held += length
                if with_ids:
                    ids.append(raw)
                if held >= HELD_IDS:
                    yield packed()
                    rows, out, ids, held = [], [], [], 0
        if rows:
            yield packed()


def tokenized_pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, with_ids: bool = True) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32, part_, nth_[, ids]), lazily."""
    fields = [docs.schema["doc_id"], StructField("piece", IntegerType()), *[StructField(n, LongType()) for n in ("start", "length", "ids_crc32", "part_", "nth_")]]
    fields += [StructField("ids", ArrayType(IntegerType()))] * with_ids
    return docs.select("doc_id", "text").mapInArrow(partial(_pieces, path, capacity, with_ids), StructType(fields))


# ---- the plan -----------------------------------------------------------------------


class Plan:
    """Where the pieces of each length go: entries (length, first rank, count, first sequence, per sequence, offset)."""

    def __init__(self, counts: np.ndarray, capacity: int = CAPACITY) -> None:
        self.capacity, self.left = capacity, counts.astype(object)  # Python integers
        self.used = [0] * (capacity + 1)
        self.entries: list[tuple[int, int, int, int, int, int]] = []
        self.sequences = self.fixed = 0
        self._reduce()
        self.fixed = self.sequences
        self._best_fit()

    def _take(self, length: int, count: int, sequence: int, each: int, offset: int) -> None:
        self.entries.append((length, self.used[length], count, sequence, each, offset))
        self.used[length] += count
        self.left[length] -= count

    def _fix(self, lengths: list[int], times: int) -> None:
        offset = 0
        for x in lengths:
            self._take(x, times, self.sequences, 1, offset)
            offset += x
        self.sequences += times

    def _largest(self, most: int, without: list[int]) -> int:
        """The greatest length up to ``most`` of which a piece is left besides ``without``; 0 if none."""
        x = min(most, self.capacity)
        while x > 0 and self.left[x] <= without.count(x):
            x -= 1
        return max(x, 0)

    def _smallest(self, n: int, without: int) -> list[int]:
        found: list[int] = []
        x = 1
        while x <= self.capacity and len(found) < n:
            found += [x] * int(min(n - len(found), self.left[x] - (x == without)))
            x += 1
        return found

    def _partners(self, length: int) -> list[int] | None:
        """The set that dominates all others with a piece of this length, without that piece; None if unproved."""
        rest = self.capacity - length
        low = self._smallest(3, length)
        if not low or low[0] > rest:
            return []
        k = self._largest(rest, [length])
        if k == rest or len(low) < 2 or low[0] + low[1] > rest:
            return [k]
        if len(low) == 3 and sum(low) <= rest:
            return None
        # At most two fit beside it.
        best, second = 0, 0
        x, y = k, low[0]
        while y and y <= x:
            partner = self._largest(rest - y, [length, y])
            if partner >= y:
                best, second = max(best, partner + y), y
            y = next((v for v in range(y + 1, x + 1) if self.left[v] > (v == length)), 0)
        if k >= best:
            return [k]
        b = self._largest(rest - k, [length, k])
        return [k, b] if b >= second else None

    def _reduce(self) -> None:
        for length in range(self.capacity, 0, -1):
            while self.left[length] > 0:
                partners = self._partners(length)
                if partners is None:
                    break
                whole = [length, *partners]
                self._fix(whole, int(min(self.left[x] // whole.count(x) for x in set(whole))))

    def _best_fit(self) -> None:
        room: dict[int, list[tuple[int, int]]] = {}  # free ids -> (first sequence, number of sequences)
        mask = 0  # bit r is set if room[r] has bins

        def put(free: int, first: int, n: int) -> None:
            nonlocal mask
            if n and free:
                room.setdefault(free, []).append((first, n))
                mask |= 1 << free

        for length in range(self.capacity, 0, -1):
            while self.left[length] > 0:
                above = mask >> length
                if above:
                    free = length + (above & -above).bit_length() - 1
                    first, n = room[free].pop()
                    if not room[free]:
                        mask &= ~(1 << free)
                else:
                    free, first = self.capacity, self.sequences
                    n = -(-self.left[length] // (free // length))
                    self.sequences += n
                each, count = free // length, self.left[length]
                full, over = divmod(int(min(count, n * each)), each)
                if full:
                    self._take(length, full * each, first, each, self.capacity - free)
                    put(free - each * length, first, full)
                if over:
                    self._take(length, over, first + full, over, self.capacity - free)
                    put(free - over * length, first + full, 1)
                put(free, first + full + bool(over), n - full - bool(over))

    def arrays(self) -> tuple[np.ndarray, ...]:
        table = np.array(sorted(self.entries), dtype=np.int64).reshape(-1, 6)
        return (table[:, 0] << 48) + table[:, 1], table[:, 1], table[:, 3], table[:, 4], table[:, 5]


# ---- placing ------------------------------------------------------------------------


def _place(plan, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys, ranks, sequences, each, offsets = plan.value
    for batch in batches:
        length, rank = (batch.column(batch.schema.get_field_index(n)).to_numpy() for n in ("length", "rank_"))
        i = np.searchsorted(keys, (length << 48) + rank, side="right") - 1
        nth, within = np.divmod(rank - ranks[i], each[i])
        names = [n for n in batch.schema.names if n != "rank_"]
        columns = [batch.column(batch.schema.get_field_index(n)) for n in names]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(sequences[i] + nth), pa.array(offsets[i] + within * length)], names=[*names, "sequence_id", "offset"])


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, with_ids: bool = True) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset)."""
    spark = docs.sparkSession
    pieces = materialize(tokenized_pieces(docs, path, capacity, with_ids), "pack-pieces")
    counts = pieces.groupBy("part_", "length").agg(F.count("*").alias("n_"))
    ahead = Window.partitionBy("length").orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("part_", "length", F.coalesce(F.sum("n_").over(ahead), F.lit(0)).alias("ahead_"))
    histogram = np.zeros(capacity + 1, dtype=np.int64)
    for row in counts.groupBy("length").agg(F.sum("n_").alias("n_")).collect():  # a row a length, at most capacity
        histogram[row["length"]] = row["n_"]
    plan = spark.sparkContext.broadcast(Plan(histogram, capacity).arrays())
    ranked = pieces.join(starts, ["part_", "length"]).withColumn("rank_", F.col("ahead_") + F.col("nth_"))
    kept = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
    schema = StructType([*[pieces.schema[n] for n in kept], StructField("sequence_id", LongType()), StructField("offset", LongType())])
    return ranked.select(*kept, "rank_").mapInArrow(partial(_place, plan), schema)


def sequences(packed: DataFrame) -> DataFrame:
    """Rows (sequence_id, ids): the pieces of each sequence in a row; at most ``capacity`` ids each."""
    pieces = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(pieces, lambda x: x["ids"])).alias("ids"))
